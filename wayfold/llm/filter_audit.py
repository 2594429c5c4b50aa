"""Audit of how five filters interact, whatever the order in which they run.

One pass makes a five-bit failure mask of every document; all that can be asked about an order of the
filters is a sum over the 32 cells (mask, number of documents) of a part. So texts are read once, rows are
counted into cells, and the 120 orders are worked out from cells, never from documents.

Four bits depend on the text alone. The fifth (a copy of a smaller doc_id's text, table-wide) needs the least
doc_id of every text: texts stand for themselves by their SHA-256, a map-side combined minimum finds the least id,
and a document is no copy iff it is found under (text, least id). That join has a key of its own for each
document, so a group of copies with a third of all rows makes no large task.

Edge cases: a null text is the empty text (it fails A alone, and E if another comes before); a null
doc_id is neither a copy nor the first of copies, and has no label; a null source and the empty one are one part;
repeated rows count one by one, and all rows with the least doc_id of a text are firsts; a doc_id with several
labels is good or toxic if any of them says so; an empty table gives no part and no rows; other columns are ignored.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfold.llm.common import cut, table

FILTERS = "ABCDE"
MIN_WORDS = 200
MIN_DISTINCT = 50  # percent of the words
MAX_CAPITALS = 2  # percent of the code points
SYMBOLS = "[#$%&*|]"


def failures(text: Column) -> list[Column]:
    """The conditions A to D, each true where the text fails; text is not null."""
    words = F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")
    n = F.size(words).cast("long")
    capitals = F.length(F.regexp_replace(text, "[^A-Z]+", "")).cast("long")
    return [
        n < MIN_WORDS,
        100 * F.size(F.array_distinct(words)).cast("long") < MIN_DISTINCT * n,
        100 * capitals > MAX_CAPITALS * F.length(text).cast("long"),
        text.rlike(SYMBOLS),
    ]


def masks(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask, good, toxic for every row of docs; bit k of mask: it fails the k-th filter."""
    text = F.coalesce(F.col("text"), F.lit(""))
    mask = F.lit(0)
    for k, fails in enumerate(failures(text)):
        mask = mask + F.when(fails, 1 << k).otherwise(0)
    rows = cut(docs.select(F.col("doc_id").alias("id"), F.coalesce(F.col("source"), F.lit("")).alias("part"), mask.alias("mask"), F.unhex(F.sha2(text, 256)).alias("digest")))
    least = rows.groupBy("digest").agg(F.min("id").alias("id")).where("id IS NOT NULL").withColumn("first", F.lit(True))
    marks = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("id"))
    marks = marks.agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic")).where("good OR toxic")
    known = rows.where("id IS NOT NULL").join(least, ["digest", "id"], "left").join(marks, "id", "left")
    copy = F.when(F.col("first"), 0).otherwise(1 << 4)
    known = known.select("part", (F.col("mask") + copy).alias("mask"), *[F.coalesce(c, F.lit(False)).alias(c) for c in ("good", "toxic")])
    return known.union(rows.where("id IS NULL").select("part", "mask", F.lit(False), F.lit(False)))


def cells(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask, n, good, toxic: the documents of each mask, at most 32 rows a part."""
    return masks(docs, labels).groupBy("part", "mask").agg(F.count(F.lit(1)).alias("n"), F.count_if("good").alias("good"), F.count_if("toxic").alias("toxic"))


def orders(found: DataFrame) -> DataFrame:
    """One row per part, order and step, from the cells alone."""
    every = " ".join("".join(p) for p in permutations(FILTERS))
    out = found.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells"))
    out = out.withColumn("filter_order", F.explode(F.split(F.lit(every), " ")))
    out = out.withColumn("step", F.explode(F.array(*[F.lit(i) for i in range(1, len(FILTERS) + 1)])))

    def bits(letters: Column) -> Column:
        return sum((F.when(F.contains(letters, F.lit(c)), 1 << k).otherwise(0) for k, c in enumerate(FILTERS)), F.lit(0))

    out = out.withColumn("own", bits(F.substring(F.col("filter_order"), F.col("step"), F.lit(1))))
    out = out.withColumn("before", bits(F.substring(F.col("filter_order"), F.lit(1), F.col("step") - 1)))
    own, before = F.col("own"), F.col("before")

    def total(value, where) -> Column:
        return F.aggregate("cells", F.lit(0).cast("long"), lambda s, c: s + F.when(where(c["mask"]), value(c)).otherwise(0))

    fails = lambda m: m.bitwiseAND(own) != 0
    gone = lambda m: m.bitwiseAND(before) != 0
    here = lambda m: fails(m) & ~gone(m)
    n = lambda c: c["n"]
    # of all orders of the filters that a document fails, each stands first in an equal share
    share = lambda c: F.floor(c["n"] * F.lit(120) / F.bit_count(c["mask"])).cast("long")
    return out.select(
        "part",
        "filter_order",
        "step",
        total(n, lambda m: ~fails(m) & ~gone(m)).alias("kept"),
        total(n, here).alias("removed"),
        total(n, lambda m: fails(m) & gone(m)).alias("redundant"),
        total(n, lambda m: m == own).alias("unique_fails"),
        total(lambda c: c["good"], here).alias("good_lost"),
        total(lambda c: c["toxic"], here).alias("toxic_lost"),
        total(share, fails).alias("shapley"),
    )


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return orders(cells(docs, labels))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


SQL = {
    "op11_filter_audit": """
WITH t AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS body, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS words FROM documents),
d AS (
  SELECT part, len(words) < 200 AS a, 100 * len(list_distinct(words)) < 50 * len(words) AS b,
         100 * len(regexp_replace(body, '[^A-Z]', '', 'g')) > 2 * len(body) AS c, regexp_matches(body, '[#$%&*|]') AS d,
         coalesce(doc_id > min(doc_id) OVER (PARTITION BY body), false) AS e,
         doc_id IN (SELECT doc_id FROM labels WHERE quality = 1 AND doc_id IS NOT NULL) AS good,
         doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1 AND doc_id IS NOT NULL) AS toxic
  FROM t),
x AS (SELECT part, [a, b, c, d, e] AS fail, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic FROM d),
f AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS l),
o AS (
  SELECT p.l || q.l || r.l || s.l || t.l AS filter_order FROM f p, f q, f r, f s, f t
  WHERE len(list_distinct([p.l, q.l, r.l, s.l, t.l])) = 5),
s AS (SELECT filter_order, unnest([1, 2, 3, 4, 5])::INTEGER AS step FROM o),
k AS (
  SELECT part, filter_order, step, substr(filter_order, step, 1) AS letter, good, toxic,
         fail[instr('ABCDE', substr(filter_order, step, 1))] AS own,
         len(list_filter(range(1, step), lambda i: fail[instr('ABCDE', substr(filter_order, i, 1))])) > 0 AS gone,
         len(list_filter(fail, lambda y: y)) AS fails
  FROM x, s),
r AS (
  SELECT part, filter_order, step, letter, count(*) FILTER (NOT own AND NOT gone) AS kept, count(*) FILTER (own AND NOT gone) AS removed,
         count(*) FILTER (own AND gone) AS redundant, count(*) FILTER (own AND fails = 1) AS unique_fails,
         count(*) FILTER (own AND NOT gone AND good) AS good_lost, count(*) FILTER (own AND NOT gone AND toxic) AS toxic_lost
  FROM k GROUP BY ALL)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       (sum(removed) OVER (PARTITION BY part, letter))::BIGINT AS shapley FROM r
"""
}
