"""Quality rules with risk-controlled cutoffs.

A few statistics of a text rise with poor quality. A document's risk is the largest of them, each
times a fixed factor (RULES). For every stratum (language) the cutoff on the risk is chosen on labelled
documents that pass the base: a cutoff is certified if the exact binomial test rejects "it rejects a
share of ALPHA or more of good documents" at the stratum's level, that is, if P(Binomial(n, ALPHA) <= k) is at
most that level for k of the n good documents above the cutoff, which is the one-sided Clopper-Pearson
bound. Cutoffs are tested from the laxest down and testing ends at the first failure (fixed
sequence; the bound rises as the cutoff falls), so they need no share of DELTA; strata share it (Bonferroni).

Strata with so few labels that not even a cutoff that rejects none of them could be certified share one pooled
stratum, whose bound holds for their good documents together. Which those are follows from the numbers of
labels alone: of the strata in falling order of labels the first m have cutoffs of their own, with the largest m for which
(1 - ALPHA)^n reaches the level DELTA / (m + 1) (DELTA / m without a rest) for each of them and for the rest together.
The last certified cutoff is used; with none, or without any label, the rule rejects nothing there.
With probability 1 - DELTA all strata at once, the pooled one
as a whole, lose at most ALPHA of the good documents that pass the base.
Base limits (fewer than 10 words, over 20 % repeated words) come before.

Main path: DataFrame functions only. Statistics are computed per text in one row, once,
and kept narrow in a checkpoint for both the labels and the verdict. Five-word windows are told apart by
64-bit hashes.

Edge cases: a null text has no words and fails the base; a null language is a stratum;
documents labelled twice count twice; without labels nothing but the base rejects;
repeated rows are judged alike; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wayfold.llm.common import cut, let, table, words

#: Share of good documents that the method may reject, and the chance of being wrong about it.
ALPHA = 0.01
DELTA = 0.05
#: Statistics, each between 0 and 1, and their factors: clean prose repeats lines and has capitals, but hardly symbols, bangs or words of over 24 characters.
RULES = {"symbol_share": 2.0, "dup_line_share": 1.0, "repeat_share": 1.0, "upper_share": 1.0, "bang_share": 2.0, "long_share": 2.0}
#: Cutoffs tried are 0, 1 / GRID, ... up to 1; a document is rejected above.
GRID = 40
POOLED = "pooled"


def _repeat_positions(w5: Column) -> Column:
    """Sorted first positions of all windows that occur twice or more."""
    pairs = F.sort_array(F.transform(w5, lambda w, i: F.struct(w.alias("w"), i.alias("i"))))

    def doubled(s: Column) -> Column:
        same = lambda k, o: F.try_element_at(s, k + o)["w"] == F.element_at(s, k)["w"]
        flagged = F.filter(
            F.sequence(F.lit(1), F.size(s)),
            lambda k: ((k > 1) & F.coalesce(same(k, F.when(k > 1, -1).otherwise(0)), F.lit(False))) | F.coalesce((k < F.size(s)) & same(k, F.lit(1)), F.lit(False)),
        )
        return F.sort_array(F.transform(flagged, lambda k: F.element_at(s, k)["i"]))

    return let(pairs, doubled)


def repeated_words(ws: Column, n: int = 5) -> Column:
    """Number of words covered by n-word windows that occur twice or more, first ones included."""

    def covered(p: Column) -> Column:
        gaps = F.transform(p, lambda x, i: F.least(F.lit(n), F.coalesce(F.try_element_at(p, i + 2) - x, F.lit(n))))
        return F.aggregate(gaps, F.lit(0).cast("long"), lambda a, x: a + x)

    def count(w5: Column) -> Column:
        return F.when(F.size(F.array_distinct(w5)) == F.size(w5), F.lit(0).cast("long")).otherwise(let(_repeat_positions(w5), covered))

    windows = lambda w: F.transform(F.sequence(F.lit(1), F.size(w) - n + 1), lambda i: F.xxhash64(F.slice(w, i, n)))
    return let(ws, lambda w: F.when(F.size(w) <= n, F.lit(0).cast("long")).otherwise(let(windows(w), count)))


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id, stratum, the base counts and the statistics of RULES for every row."""
    text = F.coalesce(F.col("text"), F.lit(""))
    # the word array is bound inside one expression, so that no part of it is computed twice
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    dup = let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long"))
    of_words = let(
        words(F.col("text")),
        lambda w: F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(F.concat_ws("", w)).cast("long").alias("word_chars"),
            repeated_words(w).alias("n_repeat_words"),
            F.size(F.filter(w, lambda x: F.length(x) > 24)).cast("long").alias("n_long"),
        ),
    )
    got = docs.select(
        "doc_id",
        F.when(F.col("lang").isNull(), "1").otherwise(F.concat(F.lit("0"), F.col("lang"))).alias("stratum"),
        of_words.alias("w"),
        F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        dup.alias("n_dup_lines"),
        F.size(F.split(text, "\n")).cast("long").alias("n_lines"),
        F.regexp_count(text, F.lit(r"[A-Z]")).cast("long").alias("n_upper"),
        F.regexp_count(text, F.lit(r"!")).cast("long").alias("n_bang"),
    ).select("*", "w.*").drop("w")
    share = lambda a, b: F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(b).cast("double")), F.lit(0.0))
    return got.select(
        "doc_id",
        "stratum",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        ((F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))).alias("base_failed"),
        F.least(share("n_symbols", "word_chars"), F.lit(1.0)).alias("symbol_share"),
        share("n_dup_lines", "n_lines").alias("dup_line_share"),
        F.least(share("n_repeat_words", "n_words"), F.lit(1.0)).alias("repeat_share"),
        share("n_upper", "word_chars").alias("upper_share"),
        F.least(share("n_bang", "n_words"), F.lit(1.0)).alias("bang_share"),
        share("n_long", "n_words").alias("long_share"),
    )


def _log_factorial(x: Column) -> Column:
    """ln x! by Stirling's series at x + 9, then down; good to 1e-12 for every x >= 0."""
    z = x + F.lit(9.0)
    series = (z + 0.5) * F.log(z) - z + F.lit(0.9189385332046727) + 1.0 / (12.0 * z) - 1.0 / (360.0 * z * z * z) + 1.0 / (1260.0 * z * z * z * z * z)
    down = F.lit(0.0)
    for i in range(1, 10):
        down = down + F.log(x + F.lit(float(i)))
    return series - down


def binomial_tail(n: Column, k: Column, p: float) -> Column:
    """P(Binomial(n, p) <= k), the terms added from k downwards; 1 where k is at or over the mean.

    Below the mean the terms fall at least geometrically away from k within some standard
    deviations, so 40 * sqrt(n) + 200 of them are all that a double can hold.
    """
    nd, kd = n.cast("double"), k.cast("double")
    first = F.exp(_log_factorial(nd) - _log_factorial(kd) - _log_factorial(nd - kd) + kd * F.log(F.lit(p)) + (nd - kd) * F.log(F.lit(1 - p)))
    steps = F.least(k.cast("long"), (40 * F.sqrt(nd) + 200).cast("long"))
    odds = (1 - p) / p
    zero = F.struct(F.lit(1.0).alias("t"), F.lit(1.0).alias("s"))

    def add(a: Column, j: Column) -> Column:
        t = a["t"] * (kd - j + 1) / (nd - kd + j) * F.lit(odds)
        return F.struct(t.alias("t"), (a["s"] + t).alias("s"))

    sums = F.when(steps > 0, F.aggregate(F.sequence(F.lit(1).cast("long"), F.greatest(steps, F.lit(1))), zero, add)["s"]).otherwise(F.lit(1.0))
    return F.when((n <= 0) | (kd >= nd * p), F.lit(1.0)).otherwise(F.least(first * sums, F.lit(1.0)))


def risk() -> Column:
    return F.greatest(*[F.col(r) * F.lit(f) for r, f in RULES.items()])


def cutoffs(stats: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """stratum, cutoff, n_good, n_rejected, pooled: the smallest certified cutoff of each stratum, if any.

    labels: doc_id and quality (1 is good; null is no label).
    """
    good = labels.where("quality = 1 AND doc_id IS NOT NULL").select("doc_id")
    # rejected by cutoff g / GRID are the risks above it: count by the cell of a risk, then add from above
    cell = F.least(F.ceil(risk() * GRID), F.lit(GRID)).cast("int")
    counts = stats.where("NOT base_failed").join(good, "doc_id").groupBy("stratum", cell.alias("cell")).agg(F.count(F.lit(1)).alias("c"))
    sizes = counts.groupBy("stratum").agg(F.sum("c").alias("n"))
    every = Window.partitionBy(F.lit(0))  # a row a stratum
    falling = every.orderBy(F.col("n").desc(), "stratum")
    rest = F.sum("n").over(falling.rowsBetween(1, Window.unboundedFollowing))
    sizes = sizes.withColumns({"i": F.row_number().over(falling), "all": F.count(F.lit(1)).over(every), "least": F.least("n", rest)})
    level = lambda m: F.lit(delta) / (m + (m < F.col("all")).cast("int"))
    enough = F.pow(F.lit(1 - alpha), F.col("least")) <= level(F.col("i"))
    sizes = sizes.withColumn("m", F.coalesce(F.max(F.when(enough, F.col("i"))).over(every), F.lit(0)))
    sizes = sizes.select("stratum", F.when(F.col("i") <= F.col("m"), F.concat(F.lit("="), F.col("stratum"))).otherwise(POOLED).alias("group"), level(F.col("m")).alias("level"))
    sizes = cut(sizes)
    per = counts.join(F.broadcast(sizes), "stratum").groupBy("group", "level", "cell").agg(F.sum("c").alias("c"))
    per = per.groupBy("group", "level").agg(F.sum("c").alias("n_good"), F.map_from_entries(F.collect_list(F.struct("cell", "c"))).alias("cells"))
    tried = per.withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(GRID - 1))))
    above = F.aggregate(F.map_entries("cells"), F.lit(0).cast("long"), lambda a, e: a + F.when(e["key"] > F.col("g"), e["value"]).otherwise(0))
    sure = tried.withColumn("n_rejected", above).where(binomial_tail(F.col("n_good"), F.col("n_rejected"), alpha) <= F.col("level"))
    best = sure.groupBy("group").agg(F.min(F.struct("g", "n_good", "n_rejected")).alias("b"))
    out = sizes.join(best, "group").select("stratum", (F.col("b.g") / F.lit(GRID)).alias("cutoff"), "b.n_good", "b.n_rejected", (F.col("group") == POOLED).alias("pooled"))
    return out


def judge(docs: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """One row per row of docs: base counts, base_failed, failed_rules and kept."""
    stats = cut(statistics(docs))
    out = stats.join(cutoffs(stats, labels, alpha, delta).select("stratum", F.col("cutoff").alias("_cut")), "stratum", "left")
    failed = F.filter(F.array(*[F.when(F.col(r) * F.lit(f) > F.col("_cut"), F.lit(r)) for r, f in RULES.items()]), lambda x: x.isNotNull())
    out = out.withColumn("failed_rules", F.concat_ws(",", failed))
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("failed_rules") == "")).drop("_cut")


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


SQL = {
    "op5_quality_rules": f"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, CASE WHEN lang IS NULL THEN '1' ELSE '0' || lang END AS stratum, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
g AS (SELECT r, unnest(range(1, len(ws) - 3)) AS i, unnest([array_to_string(ws[j:j + 4], ' ') for j in range(1, len(ws) - 3)]) AS w FROM d WHERE len(ws) >= 5),
f AS (SELECT r, i FROM (SELECT *, count(*) OVER (PARTITION BY r, w) AS c FROM g) WHERE c > 1),
rep AS (SELECT r, sum(least(5, coalesce(nx - i, 5)))::BIGINT AS n FROM (SELECT r, i, lead(i) OVER (PARTITION BY r ORDER BY i) AS nx FROM f) GROUP BY r),
c AS (
  SELECT d.r, doc_id, stratum, len(ws)::BIGINT AS n_words, coalesce(list_sum([length(x) for x in ws]), 0)::BIGINT AS word_chars,
         len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols,
         (len([x for x in ls if regexp_matches(x, '[^\\x20\\x09-\\x0D]')]) - len(list_distinct([x for x in ls if regexp_matches(x, '[^\\x20\\x09-\\x0D]')])))::BIGINT AS n_dup_lines,
         coalesce(rep.n, 0) AS n_repeat_words, len(ls) AS n_lines, len(regexp_extract_all(text, '[A-Z]')) AS n_upper, len(regexp_extract_all(text, '!')) AS n_bang,
         len([x for x in ws if length(x) > 24]) AS n_long
  FROM d LEFT JOIN rep ON rep.r = d.r),
s AS (
  SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed, greatest(
    2 * coalesce(least(n_symbols::DOUBLE / nullif(word_chars, 0), 1), 0), coalesce(n_dup_lines::DOUBLE / nullif(n_lines, 0), 0), coalesce(least(n_repeat_words::DOUBLE / nullif(n_words, 0), 1), 0),
    coalesce(n_upper::DOUBLE / nullif(word_chars, 0), 0), 2 * coalesce(least(n_bang::DOUBLE / nullif(n_words, 0), 1), 0), 2 * coalesce(n_long::DOUBLE / nullif(n_words, 0), 0)) AS risk
  FROM c),
h AS (SELECT s.stratum, least(ceil(s.risk * {GRID}), {GRID}) AS cell FROM s JOIN labels l ON l.doc_id = s.doc_id AND l.quality = 1 WHERE NOT s.base_failed),
z AS (SELECT *, row_number() OVER w AS i, count(*) OVER () AS total, least(n, sum(n) OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)) AS fewest FROM (SELECT stratum, count(*) AS n FROM h GROUP BY stratum) WINDOW w AS (ORDER BY n DESC, stratum)),
m AS (SELECT coalesce(max(i) FILTER (pow(1 - {ALPHA}, fewest) <= {DELTA} / (i + (i < total)::INT)), 0) AS m, any_value(total) AS total FROM z),
o AS (SELECT stratum, CASE WHEN i <= m.m THEN '=' || stratum ELSE '{POOLED}' END AS grp, {DELTA} / (m.m + (m.m < m.total)::INT) AS level FROM z, m),
t AS (SELECT grp, level, g.g, count(*) AS n, count(*) FILTER (cell > g.g) AS k FROM h JOIN o USING (stratum), (SELECT unnest(range(0, {GRID})) AS g) g GROUP BY ALL),
q AS (
  SELECT grp, min(g) / {GRID}.0 AS cutoff FROM t
  WHERE k < n * {ALPHA} AND list_sum([exp(lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1) + j * ln({ALPHA}) + (n - j) * ln(1 - {ALPHA})) for j in range(0, k + 1)]) <= level GROUP BY grp)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT coalesce(risk > cutoff, false) AS kept FROM s LEFT JOIN o USING (stratum) LEFT JOIN q USING (grp)
"""
}
