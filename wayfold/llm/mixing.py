"""Mixing sources to target weights with a low-discrepancy schedule of equal-token blocks.

1. Sources sorted by code point (null last) weigh 5, 2, 1, 5, 2, 1, ... and share as many
   words as there are. A target stops at three times its source; what is over goes to the
   others by weight (water filling, solved in closed form over the sources sorted by
   3 * size / weight).
2. Every source is a shuffled stream of words (documents in the order of a seeded digest),
   cut into blocks of BLOCK words, the last one shorter.
3. Slot i of the schedule takes the van der Corput point of i. The point falls into one
   source's interval of cumulative weight, and the slot's rank among that source's slots
   names the block to take: block rank mod n, in epoch rank div n. Any stretch of slots
   therefore has the sources in proportion, and every block comes up equally often, at
   most one time more or less.
4. A source stops at its target exactly: slots beyond are left out, the last block is
   taken in part, and a source that the points gave a few slots too few (the discrepancy,
   logarithmic in the number of slots) gets the next ranks after the last slot.
5. A document is met at the slots of the block in which it begins, one for each time that it is taken:
   first_slot tells the first, and mix_table() puts out rows in the order of slots, so any stretch
   of its files has the sources in proportion.

Everything on the main path is DataFrame functions. Ranks and stream positions are sums
over buckets (common.running_total); no window holds a whole source.

Edge cases: a null or empty text has no words and takes none; a null source is a source;
repeated rows are documents of their own; an empty table gives an empty result; other
columns are ignored by op9 and carried by mix_table().
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wayfold.llm.common import cut, fresh, running_total, source_key, table, words

SEED = "mix-1"
WEIGHTS = (5, 2, 1)
#: No source is repeated more often than this.
MAX_REPEAT = 3
BLOCK = 4096
SLOT_BUCKET = 65536
#: Tables with a row a source are broadcast up to so many rows (some 100 bytes each); more are joined by a shuffle.
BROADCAST_SOURCES = 100_000


def sized(docs: DataFrame, seed: str = SEED) -> DataFrame:
    """doc_id, size, source key, digest: the narrow rows that all steps work on."""
    ident = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
    return docs.select(
        "doc_id",
        F.size(words(F.col("text"))).cast("long").alias("size"),
        source_key(F.col("source")).alias("_src"),
        F.md5(F.concat(F.lit(f"{seed}:"), ident)).alias("_h"),
    ).withColumn("_b", F.conv(F.substring("_h", 1, 3), 16, 10).cast("int"))


def targets(rows: DataFrame) -> DataFrame:
    """_src, source_size, target. One row a source; sources are few beside documents."""
    s = rows.groupBy("_src").agg(F.sum("size").alias("source_size"))
    one = Window.partitionBy(F.lit(0))
    turn = (F.row_number().over(one.orderBy("_src")) - 1) % len(WEIGHTS) + 1
    s = s.withColumn("_w", F.element_at(F.array(*[F.lit(float(w)) for w in WEIGHTS]), turn))
    cap = F.col("source_size") * F.lit(float(MAX_REPEAT))
    s = s.withColumn("_cap", cap).withColumn("_all", F.sum("source_size").over(one).cast("double"))
    order = one.orderBy(F.col("_cap") / F.col("_w"), "_src")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    onward = order.rowsBetween(0, Window.unboundedFollowing)
    # the share of a unit of weight if all sources before this one stand at their caps
    s = s.withColumn("_rate", (F.col("_all") - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))) / F.sum("_w").over(onward))
    s = s.withColumn("_free", F.col("_cap") >= F.col("_rate") * F.col("_w"))
    rate = F.min(F.when(F.col("_free"), F.struct(F.col("_cap") / F.col("_w"), F.col("_src"), F.col("_rate").alias("r")))).over(one)["r"]
    return s.select("_src", "source_size", F.least("_cap", F.coalesce(rate, F.lit(0.0)) * F.col("_w")).alias("target"))


def small(per_source: DataFrame) -> DataFrame:
    """A materialised table with a row a source, to be broadcast if its rows are few: else one task would get all rows of a source."""
    return F.broadcast(per_source) if per_source.count() <= BROADCAST_SOURCES else per_source


def schedule(sources: DataFrame, block: int = BLOCK) -> DataFrame:
    """_slot, _src, _rank: the slots of the mix in their order; rank r of a source is its r-th slot."""
    spark = sources.sparkSession
    goal = F.round("target").cast("long")
    s = sources.where(F.col("source_size") > 0).select(
        "_src",
        "source_size",
        goal.alias("_goal"),
        F.expr(f"(source_size + {block - 1}) div {block}").alias("_nb"),
    )
    rest = F.expr("_goal % source_size")
    s = s.withColumn("_need", F.expr("_goal div source_size") * F.col("_nb") + F.expr(f"((_goal % source_size) + {block - 1}) div {block}")).withColumn("_rest", rest)
    one = Window.partitionBy(F.lit(0))
    upto = F.sum("_need").over(one.orderBy("_src").rowsBetween(Window.unboundedPreceding, 0))
    s = s.withColumn("_hi", upto / F.sum("_need").over(one)).withColumn("_lo", (upto - F.col("_need")) / F.sum("_need").over(one))
    s = cut(s)  # a row a source
    slots = s.agg(F.sum("_need")).first()[0] or 0
    # van der Corput points: the bits of i mirrored at the binary point
    bits = 48
    point = F.conv(F.reverse(F.lpad(F.bin("id"), bits, "0")), 2, 10).cast("double") / F.lit(float(2**bits))
    points = spark.range(0, slots).select(F.col("id").alias("_slot"), point.alias("_x"))
    # each point takes the last interval that starts at or below it, found by one ordered
    # pass in every cell of [0, 1); an interval is put in all cells that it meets
    cells = max(1, min(1 << 20, slots // 10_000))
    cell = lambda x: F.least(F.floor(x * cells), F.lit(cells - 1)).cast("int")
    starts = s.where("_need > 0").select("_src", "_lo", F.explode(F.sequence(cell(F.col("_lo")), cell(F.col("_hi")))).alias("_cell"))
    marked = starts.select("_cell", F.col("_lo").alias("_x"), F.lit(-1).cast("long").alias("_slot"), "_src")
    found = points.select(cell(F.col("_x")).alias("_cell"), "_x", "_slot", F.lit(None).cast("string").alias("_src")).unionByName(marked)
    pass_ = Window.partitionBy("_cell").orderBy("_x", "_slot").rowsBetween(Window.unboundedPreceding, 0)
    found = found.withColumn("_src", F.last("_src", ignorenulls=True).over(pass_)).where("_slot >= 0").select("_slot", "_src")
    found = found.withColumn("_sb", F.expr(f"_slot div {SLOT_BUCKET}"))
    ranked = running_total(found, ["_src"], "_sb", [F.col("_slot")], None, "_rank").select("_slot", "_src", "_rank")
    given = ranked.groupBy("_src").agg(F.count(F.lit(1)).alias("_given"))
    short = s.join(given, "_src", "left").withColumn("_given", F.coalesce("_given", F.lit(0))).where("_given < _need")
    short = short.select("_src", "_given", F.explode(F.expr("sequence(_given, _need - 1)")).alias("_rank"))
    short = short.select((F.lit(slots) + F.col("_rank") - F.col("_given")).cast("long").alias("_slot"), "_src", "_rank")
    return ranked.unionByName(short).join(small(s).select("_src", "_need", "_nb", "_rest", "_goal", "source_size"), "_src").where("_rank < _need")


def block_takes(slots: DataFrame, block: int = BLOCK) -> DataFrame:
    """_src, _block, _times (whole takes), _part (words of the one take that stops at the target), _slots (of its takes, MAX_REPEAT + 1 at most)."""
    s = slots.withColumn("_block", F.expr("_rank % _nb")).withColumn("_epoch", F.expr("_rank div _nb"))
    last = F.col("_epoch") == F.expr("_goal div source_size")
    end = F.least((F.col("_block") + 1) * block, F.col("source_size"))
    whole = ~last | (end <= F.col("_rest"))
    return s.groupBy("_src", "_block").agg(
        F.count_if(whole).alias("_times"),
        F.coalesce(F.max(F.when(~whole, F.col("_rest") - F.col("_block") * block)), F.lit(0)).alias("_part"),
        F.sort_array(F.collect_list("_slot")).alias("_slots"),
    )


def taken(docs: DataFrame, seed: str = SEED, block: int = BLOCK) -> DataFrame:
    """doc_id, size, source_size, target, taken and first_slot (null if nothing is taken) for every row of docs, with copies, slots, _src and _start."""
    rows = cut(sized(docs, seed))  # narrow; texts are read and split once
    sources = cut(targets(rows))  # a row a source
    rows = running_total(rows, ["_src"], "_b", [F.col("_h"), F.col("doc_id"), F.col("size")], F.col("size"), "_start")
    takes = block_takes(schedule(sources, block), block)
    last = F.expr(f"(_start + greatest(size, 1) - 1) div {block}")
    pieces = rows.withColumn("_block", F.explode(F.sequence(F.expr(f"_start div {block}"), last)))
    pieces = pieces.join(takes, ["_src", "_block"], "left")
    lo = F.greatest(F.col("_start") - F.col("_block") * block, F.lit(0))
    hi = F.least(F.col("_start") + F.col("size") - F.col("_block") * block, F.lit(block))
    words_ = F.coalesce("_times", F.lit(0)) * (hi - lo) + F.greatest(F.least(hi, F.coalesce("_part", F.lit(0))) - lo, F.lit(0))
    starts_here = F.expr(f"_block = _start div {block}")
    copies = F.when(starts_here, F.coalesce("_times", F.lit(0)) + (lo < F.coalesce("_part", F.lit(0))).cast("int"))
    # the pieces of a row; equal rows have equal pieces and are told apart by their start
    per = pieces.groupBy("doc_id", "_src", "_start", "size", "_h").agg(F.sum(F.when(F.col("size") > 0, words_).otherwise(0)).alias("taken"), F.max(copies).alias("_copies"), F.max(F.when(starts_here, F.col("_slots"))).alias("_slots"), F.count_if(starts_here).alias("_rows"))
    # rows without words may share a start: they were counted together, give each its own row back
    per = per.withColumn("_again", F.explode(F.sequence(F.lit(1), F.greatest(F.col("_rows").cast("int"), F.lit(1)))))
    slots = F.coalesce(F.slice("_slots", 1, F.coalesce("_copies", F.lit(0)).cast("int")), F.array().cast("array<long>"))
    first = F.when(F.col("taken") > 0, F.try_element_at("_slots", F.lit(1)))
    return per.join(small(sources), "_src").select("doc_id", "size", "source_size", "target", F.col("taken").cast("long").alias("taken"), first.alias("first_slot"), F.col("_copies").alias("copies"), slots.alias("slots"), "_src", "_start")


def mix_table(docs: DataFrame, seed: str = SEED, block: int = BLOCK) -> DataFrame:
    """docs with each row as often as the mix starts it, in the order of slots: the columns of docs, whole texts.

    A row is repeated once for every take of the word it starts with, so a source's words
    differ from its target by less than one document. Rows with equal doc_id, source and
    size are equal to the mix and get the same number of copies on average. Rows without words go with the block that they stand in.
    """
    t = taken(docs, seed, block)
    row, ident_, src, n, slots, nth, slot = fresh(docs, "row", "id", "src", "n", "slots", "nth", "slot")
    ident = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
    t = t.groupBy(ident.alias(ident_), F.col("_src").alias(src), F.col("size").alias(n)).agg(F.sort_array(F.collect_list("slots")).alias(slots))
    key = [ident_, src, n]
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias(row), ident.alias(ident_), source_key(F.col("source")).alias(src), F.size(words(F.col("text"))).cast("long").alias(n))
    rows = rows.withColumn(nth, F.row_number().over(Window.partitionBy(*key).orderBy(F.lit(0)))).join(t, key)
    rows = rows.select(row, ident_, F.explode(F.element_at(slots, F.col(nth))).alias(slot))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [slot, F.md5(F.concat(F.lit(f"{seed}:"), F.col(ident_)))]
    return rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).select(f"{row}.*")


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return taken(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "first_slot")


SQL = {
    "op9_mixing": f"""
WITH d AS (
  SELECT doc_id, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size,
         CASE WHEN source IS NULL THEN '1' ELSE '0' || source END AS src, md5('{SEED}:' || coalesce(doc_id::VARCHAR, 'null')) AS h
  FROM documents),
s AS (SELECT src, sum(size)::BIGINT AS source_size FROM d GROUP BY src),
w AS (SELECT *, [5.0, 2.0, 1.0][((row_number() OVER (ORDER BY src) - 1) % 3 + 1)::INT]::DOUBLE AS w, source_size * 3.0::DOUBLE AS cap, (sum(source_size) OVER ())::DOUBLE AS total FROM s),
r AS (SELECT *, (total - coalesce(sum(cap) OVER (ORDER BY cap / w, src ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(w) OVER (ORDER BY cap / w, src ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rate FROM w),
q AS (SELECT coalesce(arg_min(rate, struct_pack(a := cap / w, b := src)), 0) AS rate FROM r WHERE cap >= rate * w),
t AS (SELECT src, source_size, least(cap, q.rate * w) AS target, CAST(round(least(cap, q.rate * w)) AS BIGINT) AS goal FROM r, q),
p AS (SELECT doc_id, size, d.src, sum(size) OVER (PARTITION BY d.src ORDER BY h, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - size AS start FROM d),
n AS (SELECT src, (goal // source_size) * ((source_size + {BLOCK - 1}) // {BLOCK}) + ((goal % source_size) + {BLOCK - 1}) // {BLOCK} AS need FROM t WHERE source_size > 0),
i AS (SELECT src, need, sum(need) OVER (ORDER BY src) / sum(need) OVER () AS hi, (sum(need) OVER (ORDER BY src) - need) / sum(need) OVER () AS lo, sum(need) OVER () AS slots FROM n),
v AS (SELECT slot, list_sum([((slot >> k) & 1) / pow(2.0, k + 1) for k in range(0, 48)]) AS x FROM (SELECT unnest(range(0, (SELECT max(slots)::BIGINT FROM i))) AS slot)),
g AS (SELECT i.src, v.slot, row_number() OVER (PARTITION BY i.src ORDER BY v.slot) - 1 AS rank FROM v JOIN i ON v.x >= i.lo AND v.x < i.hi),
c AS (SELECT src, count(*) AS given FROM g GROUP BY src),
a AS (SELECT src, slot, rank FROM g UNION ALL SELECT src, (slots + rank - given)::BIGINT, rank FROM (SELECT i.src, slots, coalesce(given, 0) AS given, unnest(range(coalesce(given, 0), need::BIGINT)) AS rank FROM i LEFT JOIN c USING (src))),
k AS (
  SELECT doc_id, size, source_size, target, src, start,
         CASE WHEN size = 0 THEN 0 ELSE goal // source_size * size + greatest(least(start + size, goal % source_size) - start, 0) END::BIGINT AS taken
  FROM p JOIN t USING (src))
SELECT doc_id, size, source_size, target, taken, CASE WHEN taken > 0 THEN a.slot END AS first_slot FROM k LEFT JOIN a ON a.src = k.src AND a.rank = k.start // {BLOCK}
"""
}
