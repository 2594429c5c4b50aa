"""Flags, cohorts, gates, reports and paired comparisons over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wayfold.functions import flags as G
from wayfold.functions import prob as P
from wayfold.operators import compare as C
from wayfold.operators import metrics as M
from wayfold.operators import ranking as R
from wayfold.plans.base import FACTS, LIVES, WALK, Tables, facts, lived, query, walked
from wayfold.plans.trajectories import SUMMARY

#: First true flag wins; the last two never hold here.
PRIORITY = ("immediate_critical", "power_expiry", "danger_near", "dry_spell", "junction", "late_game", "respawn")
COHORTS = ("danger_near", "dry_spell", "immediate_critical", "late_game", "power_expiry")


def flagged(t: Tables) -> DataFrame:
    """Analysed rows with a map of five flags: k stands for a distance, frames for remaining time."""
    rows = walked(t)
    named = {
        "danger_near": F.col("k") <= 6,
        "dry_spell": F.col("dry") >= 4,
        "immediate_critical": F.col("lost"),
        "late_game": F.col("turn") >= 60,
        "power_expiry": (F.col("frames") >= 1) & (F.col("frames") <= 12_000) & (F.col("k") <= 30),
    }
    return rows.withColumn("flags", G.flag_map(named))


FLAGGED = WALK + """,
g AS (SELECT *, k <= 6 AS danger_near, dry >= 4 AS dry_spell, lost AS immediate_critical, turn >= 60 AS late_game, frames BETWEEN 1 AND 12000 AND k <= 30 AS power_expiry FROM a),
x AS (SELECT *, list_filter([CASE WHEN danger_near THEN 'danger_near' END, CASE WHEN dry_spell THEN 'dry_spell' END, CASE WHEN immediate_critical THEN 'immediate_critical' END,
        CASE WHEN late_game THEN 'late_game' END, CASE WHEN power_expiry THEN 'power_expiry' END], lambda n: n IS NOT NULL) AS names FROM g)"""


@query("cohort_names", f"WITH {FLAGGED} SELECT episode, turn, array_to_string(names, ',') AS cohorts FROM x")
def cohort_names(t: Tables) -> DataFrame:
    return flagged(t).select("episode", "turn", F.array_join(G.true_names(F.col("flags")), ",").alias("cohorts"))


@query(
    "primary_scenario",
    f"""WITH {FLAGGED} SELECT scenario, count(*) AS rows FROM (SELECT CASE WHEN immediate_critical THEN 'immediate_critical' WHEN power_expiry THEN 'power_expiry' WHEN danger_near THEN 'danger_near'
    WHEN dry_spell THEN 'dry_spell' WHEN late_game THEN 'late_game' END AS scenario FROM g) GROUP BY scenario""",
)
def primary_scenario(t: Tables) -> DataFrame:
    return flagged(t).groupBy(G.primary(F.col("flags"), PRIORITY).alias("scenario")).agg(F.count(F.lit(1)).alias("rows"))


@query(
    "cohort_rollup",
    f"""WITH {FLAGGED}, e AS (SELECT unnest(names) AS cohort, * FROM x)
    SELECT cohort, count(*) AS rows, count(*) FILTER (progress) AS progress_rows, count(*) FILTER (progress)::DOUBLE / count(*) AS progress_rate, sum(frames)::BIGINT AS frames FROM e GROUP BY cohort""",
)
def cohort_rollup(t: Tables) -> DataFrame:
    rows = flagged(t).withColumn("names", G.true_names(F.col("flags")))
    hit = M.n(F.col("progress"))
    return M.by_cohort(rows, "names", {"rows": F.count(F.lit(1)), "progress_rows": hit, "progress_rate": M.rate(hit, F.count(F.lit(1))), "frames": F.sum("frames")})


@query(
    "stratified_with_empty",
    f"""WITH {FLAGGED}, e AS (SELECT unnest(names) AS cohort, progress FROM x), s AS (SELECT cohort, count(*) AS n, avg(progress::INT) AS accuracy FROM e GROUP BY cohort),
    dim AS (SELECT unnest(['danger_near', 'dry_spell', 'immediate_critical', 'junction', 'late_game', 'power_expiry']) AS cohort)
    SELECT dim.cohort, coalesce(n, 0) AS n, accuracy FROM dim LEFT JOIN s USING (cohort)""",
)
def stratified_with_empty(t: Tables) -> DataFrame:
    rows = flagged(t).withColumn("names", G.true_names(F.col("flags")))
    found = M.by_cohort(rows, "names", {"n": F.count(F.lit(1)), "accuracy": F.avg(F.col("progress").cast("int"))})
    dim = t.spark.createDataFrame([(c,) for c in sorted([*COHORTS, "junction"])], "cohort string")
    return M.over_dimension(dim, found, ["cohort"], ["n"])


@query("flag_coverage", f"WITH {FLAGGED}, e AS (SELECT life, unnest(names) AS flag FROM x) SELECT life, flag, count(*) AS rows FROM e GROUP BY life, flag")
def flag_coverage(t: Tables) -> DataFrame:
    return M.flag_coverage(flagged(t), ["life"], "flags")


@query(
    "conditional_counters",
    f"""WITH {LIVES} SELECT episode, count(*) FILTER (lost AND k > 50) AS lost_high, count(*) FILTER (progress OR lost) AS either, count(*) FILTER (k % 4 = 0 OR pos = 'signup') AS sampled FROM l GROUP BY episode""",
)
def conditional_counters(t: Tables) -> DataFrame:
    keep = G.sampled(F.col("k"), F.create_map(F.lit("signup"), F.col("pos") == "signup"), 4, ["signup"])
    return lived(t).groupBy("episode").agg(M.n(F.col("lost") & (F.col("k") > 50)).alias("lost_high"), M.n(F.col("progress") | F.col("lost")).alias("either"), M.n(keep).alias("sampled"))


@query(
    "label_histogram",
    "SELECT CASE WHEN substr(md5(CAST(user_id AS VARCHAR)), 1, 1) IN ('0', '1', '2', '3') THEN 'development' ELSE 'train' END AS split, event_type AS label, count(*) AS rows FROM events GROUP BY 1, 2",
)
def label_histogram(t: Tables) -> DataFrame:
    return t("events").groupBy(split_of(F.col("user_id")).alias("split"), F.col("event_type").alias("label")).agg(F.count(F.lit(1)).alias("rows"))


def split_of(key):
    return F.when(F.substring(F.md5(key.cast("string")), 1, 1).isin("0", "1", "2", "3"), "development").otherwise("train")


_GATED = f"""WITH {WALK}, e AS ({SUMMARY}), g AS (SELECT *, array_to_string(list_filter([CASE WHEN life_losses > 12 THEN 'life_losses' END, CASE WHEN longest_dry > 8 THEN 'longest_dry' END,
  CASE WHEN longest_loop_streak > 2 THEN 'loop_streak' END], lambda n: n IS NOT NULL), ',') AS failures FROM e)"""


def gated(t: Tables) -> DataFrame:
    named = {"life_losses": F.col("life_losses") > 12, "longest_dry": F.col("longest_dry") > 8, "loop_streak": F.col("longest_loop_streak") > 2}
    return M.gate(M.episode_summary(walked(t)), named)


@query("episode_gates", f"{_GATED} SELECT episode, failures, failures = '' AS approved FROM g")
def episode_gates(t: Tables) -> DataFrame:
    return gated(t).select("episode", F.array_join("failures", ",").alias("failures"), "approved")


@query(
    "suite_qualification",
    f"""{_GATED}, p AS (SELECT episode % 5 AS level, avg((failures = '')::INT) AS clear_rate FROM g GROUP BY 1),
    w AS (SELECT unnest([0, 1, 2, 3, 4, 7]) AS level), m AS (SELECT count(*) FILTER (clear_rate IS NULL) AS missing_groups, count(*) FILTER (clear_rate < 0.5) AS low_groups FROM w LEFT JOIN p USING (level)),
    s AS (SELECT sum(life_losses)::BIGINT AS life_losses, sum(CASE WHEN failures = '' THEN 0 ELSE len(string_split(failures, ',')) END)::BIGINT AS failed_gates FROM g)
    SELECT missing_groups, low_groups, life_losses, failed_gates, concat_ws(',', CASE WHEN missing_groups > 0 THEN 'incomplete' END, CASE WHEN low_groups > 0 THEN 'clear_rate' END, CASE WHEN life_losses > 100 THEN 'life_losses' END) AS failures,
      missing_groups = 0 AND low_groups = 0 AND life_losses <= 100 AS approved FROM m, s""",
)
def suite_qualification(t: Tables) -> DataFrame:
    rows = gated(t).withColumn("level", F.col("episode") % 5)
    return M.qualify(rows, "level", [0, 1, 2, 3, 4, 7], 0.5, 100)


@query(
    "suite_means",
    f"""{_GATED} SELECT count(*) AS episodes, count(*) FILTER (failures = '') AS cleared, count(*) FILTER (decisions >= 70) AS capped, avg(decisions) AS mean_decisions, avg(frames) AS mean_frames,
    avg(life_losses) AS mean_life_losses, avg(progress_events) AS mean_progress_events, avg(longest_dry) AS mean_longest_dry FROM g""",
)
def suite_means(t: Tables) -> DataFrame:
    return M.suite_means(gated(t), ["decisions", "frames", "life_losses", "progress_events", "longest_dry"], F.col("approved"), F.col("decisions") >= 70)


@query(
    "behaviour_summary",
    f"""WITH {LIVES}, p AS (SELECT episode, life, count(*) AS decisions, count(*) FILTER (progress) AS progress_events FROM l GROUP BY 1, 2)
    SELECT life, count(*) AS episodes_reaching, avg(progress_events) AS mean_progress, avg(decisions) AS mean_decisions, max(decisions) AS longest FROM p GROUP BY life""",
)
def behaviour_summary(t: Tables) -> DataFrame:
    return M.per_life(lived(t)).groupBy("life").agg(F.count(F.lit(1)).alias("episodes_reaching"), F.avg("progress_events").alias("mean_progress"), F.avg("decisions").alias("mean_decisions"), F.max("decisions").alias("longest"))


@query(
    "safe_rates",
    f"""WITH {FACTS} SELECT episode, count(*) FILTER (k = 1) AS opportunities, count(*) FILTER (k = 1 AND lost) AS fatal, CASE WHEN count(*) FILTER (k = 1) = 0 THEN NULL ELSE count(*) FILTER (k = 1 AND lost)::DOUBLE / count(*) FILTER (k = 1) END AS fatal_rate FROM f GROUP BY episode""",
)
def safe_rates(t: Tables) -> DataFrame:
    opportunity, fatal = M.n(F.col("k") == 1), M.n((F.col("k") == 1) & F.col("lost"))
    return facts(t).groupBy("episode").agg(opportunity.alias("opportunities"), fatal.alias("fatal"), M.rate(fatal, opportunity).alias("fatal_rate"))


_HALVES = """h AS (SELECT *, ntile(2) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS half FROM orders),
 b AS (SELECT o_custkey, o_orderpriority, count(*) AS n, sum(CAST(round(o_totalprice * 100) AS BIGINT))::BIGINT AS cents FROM h WHERE half = 1 GROUP BY 1, 2),
 c AS (SELECT o_custkey, o_orderpriority, count(*) AS n, sum(CAST(round(o_totalprice * 100) AS BIGINT))::BIGINT AS cents FROM h WHERE half = 2 GROUP BY 1, 2)"""


def halves(t: Tables) -> tuple[DataFrame, DataFrame]:
    half = F.ntile(2).over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"))
    rows = t("orders").withColumn("half", half)
    agg = [F.count(F.lit(1)).alias("n"), F.sum(F.round(F.col("o_totalprice") * 100).cast("long")).alias("cents")]
    return tuple(rows.where(F.col("half") == k).groupBy("o_custkey", "o_orderpriority").agg(*agg) for k in (1, 2))


@query(
    "paired_comparison",
    f"WITH {_HALVES} SELECT o_custkey, o_orderpriority, b.n AS n_before, b.cents AS cents_before, c.n AS n_after, c.cents AS cents_after, c.n - b.n AS n_change, c.cents - b.cents AS cents_change FROM b JOIN c USING (o_custkey, o_orderpriority)",
)
def paired_comparison(t: Tables) -> DataFrame:
    key = ["o_custkey", "o_orderpriority"]
    before, after = halves(t)
    # keys of one side only are unpaired_keys; what is left must pass the guard
    return C.paired(before.join(after, key, "left_semi"), after.join(before, key, "left_semi"), key, ["n", "cents"])


@query(
    "unpaired_keys",
    f"WITH {_HALVES} SELECT coalesce(b.o_custkey, c.o_custkey) AS o_custkey, coalesce(b.o_orderpriority, c.o_orderpriority) AS o_orderpriority, CASE WHEN b.n IS NULL THEN 'after' ELSE 'before' END AS only_in FROM b FULL JOIN c ON b.o_custkey = c.o_custkey AND b.o_orderpriority = c.o_orderpriority WHERE b.n IS NULL OR c.n IS NULL",
)
def unpaired_keys(t: Tables) -> DataFrame:
    return C.unpaired(*halves(t), ["o_custkey", "o_orderpriority"])


_SOFT = """e AS (SELECT vec_id, label % 64 AS gold, list_transform(embedding, lambda v: v::DOUBLE) AS x FROM embeddings),
s AS (SELECT vec_id, gold, list_transform(x, lambda v: exp(v - list_max(x))) AS y FROM e), p AS (SELECT vec_id, gold, list_transform(y, lambda v: v / list_sum(y)) AS p FROM s)"""


def softened(t: Tables) -> DataFrame:
    x = F.transform("embedding", lambda v: v.cast("double"))
    names = F.array(*[F.lit(str(i)) for i in range(64)])
    return t("embeddings").select("vec_id", (F.col("label") % 64).cast("string").alias("gold"), F.map_from_arrays(names, P.softmax(x)).alias("p"))


@query(
    "snapshot_evaluation",
    f"""WITH {_SOFT}, c AS (SELECT *, list_position(p, list_max(p)) - 1 AS choice, p[gold + 1] AS pg, list_max(list_filter(p, lambda v, i: i <> gold + 1)) AS other FROM p)
    SELECT gold::VARCHAR AS gold, count(*) AS n, round(avg((choice = gold)::INT), 9) AS accuracy, round(avg(-ln(greatest(pg, 1e-12))), 9) AS cross_entropy, round(avg(pg - other), 9) AS margin FROM c GROUP BY gold""",
)
def snapshot_evaluation(t: Tables) -> DataFrame:
    p, gold = F.col("p"), F.col("gold")
    choice = P.argmax(p)
    rows = softened(t).withColumns({"right": choice == gold, "ce": P.cross_entropy(p, gold), "m": P.margin(p, gold)})
    return rows.groupBy("gold").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.col("right").cast("int")), 9).alias("accuracy"), F.round(F.avg("ce"), 9).alias("cross_entropy"), F.round(F.avg("m"), 9).alias("margin"))


@query(
    "hard_case_report",
    f"""WITH {_SOFT}, c AS (SELECT *, list_position(p, list_max(p)) - 1 AS choice, p[gold + 1] - list_max(list_filter(p, lambda v, i: i <> gold + 1)) AS margin FROM p),
    r AS (SELECT *, list_filter(['even' , CASE WHEN vec_id % 3 = 0 THEN 'third' END, CASE WHEN gold = 0 THEN 'zero' END], lambda n: n IS NOT NULL AND (n <> 'even' OR vec_id % 2 = 0)) AS cohorts, CASE WHEN vec_id % 2 = 0 THEN 'targeted' ELSE 'informative' END AS class FROM c),
    u AS (SELECT 'overall' AS grouping_kind, 'all' AS grp, * FROM r UNION ALL SELECT 'cohort', unnest(cohorts), * FROM r UNION ALL SELECT 'class', class, * FROM r)
    SELECT grouping_kind, grp, count(*) AS n, round(avg((choice = gold)::INT), 9) AS agreement, round(avg(margin), 9) AS margin FROM u GROUP BY 1, 2""",
)
def hard_case_report(t: Tables) -> DataFrame:
    p, gold = F.col("p"), F.col("gold")
    choice = P.argmax(p)
    cohorts = G.flag_map({"even": F.col("vec_id") % 2 == 0, "third": F.col("vec_id") % 3 == 0, "zero": gold == "0"})
    rows = softened(t).select((choice == gold).cast("int").alias("right"), P.margin(p, gold).alias("m"), G.true_names(cohorts).alias("cohorts"), F.when(F.col("vec_id") % 2 == 0, "targeted").otherwise("informative").alias("class"))
    # one pass: every row goes once to the whole, once to its class and once to each of its cohorts
    kind = lambda k, g: F.struct(F.lit(k).alias("grouping_kind"), g.alias("grp"))
    groups = F.concat(F.array(kind("overall", F.lit("all")), kind("class", F.col("class"))), F.transform("cohorts", lambda c: kind("cohort", c)))
    return rows.select("right", "m", F.inline(groups)).groupBy("grouping_kind", "grp").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("right"), 9).alias("agreement"), F.round(F.avg("m"), 9).alias("margin"))


@query(
    "distribution_checks",
    f"""WITH {_SOFT}, d AS (SELECT vec_id, CASE WHEN vec_id % 50 = 0 THEN list_transform(p, lambda v: v * 1.1) ELSE p END AS p, list_position(p, list_max(p)) AS c FROM p)
    SELECT vec_id, abs(list_sum(p) - 1) <= 0.02 AND p[CASE WHEN vec_id % 7 = 0 THEN 1 ELSE c END] >= list_max(p) - 1e-4 AND list_max(p) <= 1 AS valid, round(list_max(p) / list_sum(p), 9) AS top FROM d""",
)
def distribution_checks(t: Tables) -> DataFrame:
    p = F.col("p")
    best = P.argmax(p)
    rows = softened(t).withColumn("choice", F.when(F.col("vec_id") % 7 == 0, "0").otherwise(best))
    rows = rows.withColumn("p", F.when(F.col("vec_id") % 50 == 0, F.transform_values(p, lambda k, v: v * 1.1)).otherwise(p))
    keys = F.array(*[F.lit(str(i)) for i in range(64)])
    return rows.select("vec_id", P.valid(p, keys, F.col("choice")).alias("valid"), F.round(F.array_max(F.map_values(P.renormalised(p))), 9).alias("top"))


@query("dataset_audit", "SELECT CASE WHEN substr(md5(CAST(user_id AS VARCHAR)), 1, 1) IN ('0', '1', '2', '3') THEN 'development' ELSE 'train' END AS split, count(*) AS rows, count(*) FILTER (event_type = 'error') AS errors, count(*) FILTER (value > 100) AS large, count(DISTINCT user_id) AS families, count(DISTINCT props) AS states FROM events GROUP BY 1")
def dataset_audit(t: Tables) -> DataFrame:
    e = t("events")
    return e.groupBy(split_of(F.col("user_id")).alias("split")).agg(F.count(F.lit(1)).alias("rows"), M.n(F.col("event_type") == "error").alias("errors"), M.n(F.col("value") > 100).alias("large"), F.count_distinct("user_id").alias("families"), F.count_distinct("props").alias("states"))


@query(
    "role_report",
    f"WITH {FLAGGED}, e AS (SELECT episode % 3 AS split, unnest(names) AS role, props FROM x) SELECT split, role, count(DISTINCT props) AS requests FROM e GROUP BY split, role",
)
def role_report(t: Tables) -> DataFrame:
    rows = flagged(t).select((F.col("episode") % 3).alias("split"), F.explode(G.true_names(F.col("flags"))).alias("role"), "props")
    return rows.groupBy("split", "role").agg(F.count_distinct("props").alias("requests"))


@query(
    "pool_report",
    f"""WITH {FLAGGED}, e AS (SELECT unnest(names) AS flag FROM x), h AS (SELECT flag, count(*) AS have FROM e GROUP BY flag),
    fl AS (SELECT * FROM (VALUES ('danger_near', 100), ('dry_spell', 5000), ('junction', 3), ('power_expiry', 4000)) v(flag, floor))
    SELECT flag, floor::BIGINT AS floor, coalesce(have, 0) AS have, floor::BIGINT - coalesce(have, 0) AS missing FROM fl LEFT JOIN h USING (flag) WHERE floor > coalesce(have, 0)""",
)
def pool_report(t: Tables) -> DataFrame:
    have = flagged(t).select(F.explode(G.true_names(F.col("flags"))).alias("flag")).groupBy("flag").agg(F.count(F.lit(1)).alias("n"))
    return M.shortages(have, {"danger_near": 100, "dry_spell": 5000, "junction": 3, "power_expiry": 4000}, "flag", "n")


@query(
    "case_report",
    f"""{_GATED}, o AS (SELECT episode % 4 AS wave, failures = '' AS accepted, unnest(CASE WHEN failures = '' THEN ['accepted'] ELSE string_split(failures, ',') END) AS outcome FROM g)
    SELECT wave, outcome, count(*) AS cases FROM o GROUP BY wave, outcome""",
)
def case_report(t: Tables) -> DataFrame:
    outcome = F.when(F.col("approved"), F.array(F.lit("accepted"))).otherwise(F.col("failures"))
    return gated(t).select((F.col("episode") % 4).alias("wave"), F.explode(outcome).alias("outcome")).groupBy("wave", "outcome").agg(F.count(F.lit(1)).alias("cases"))


@query(
    "catalog_rollup",
    f"""WITH {FLAGGED}, c AS (SELECT episode % 2 AS split, episode, props, CASE WHEN immediate_critical THEN 'immediate_critical' WHEN power_expiry THEN 'power_expiry' WHEN danger_near THEN 'danger_near' WHEN dry_spell THEN 'dry_spell' WHEN late_game THEN 'late_game' END AS scenario FROM g),
    s AS (SELECT split, scenario, count(*) AS records, count(DISTINCT episode) AS games, count(DISTINCT props) AS families FROM c GROUP BY 1, 2),
    dim AS (SELECT * FROM (SELECT unnest([0, 1]) AS split), (SELECT unnest(['immediate_critical', 'power_expiry', 'danger_near', 'dry_spell', 'junction', 'late_game', 'respawn']) AS scenario))
    SELECT dim.split, dim.scenario, coalesce(records, 0) AS records, coalesce(games, 0) AS games, coalesce(families, 0) AS families FROM dim LEFT JOIN s ON s.split = dim.split AND s.scenario = dim.scenario""",
)
def catalog_rollup(t: Tables) -> DataFrame:
    rows = flagged(t).select((F.col("episode") % 2).alias("split"), "episode", "props", G.primary(F.col("flags"), PRIORITY).alias("scenario"))
    found = rows.groupBy("split", "scenario").agg(F.count(F.lit(1)).alias("records"), F.count_distinct("episode").alias("games"), F.count_distinct("props").alias("families"))
    dim = t.spark.createDataFrame([(s, c) for s in (0, 1) for c in PRIORITY], "split long, scenario string")
    return M.over_dimension(dim, found, ["split", "scenario"], ["records", "games", "families"])


@query("token_budget", "SELECT count(*) AS records, max(length(text)) AS longest, count(*) FILTER (length(text) > 4096) AS over_limit FROM documents")
def token_budget(t: Tables) -> DataFrame:
    return M.token_budget(t("documents").select(F.length("text").cast("long").alias("n")), "n", 4096)


@query(
    "padded_batches",
    "SELECT (doc_id // 32)::BIGINT AS batch, count(*) AS rows, max(length(text))::BIGINT AS longest, (count(*) * max(length(text)))::BIGINT AS padded FROM documents GROUP BY 1",
)
def padded_batches(t: Tables) -> DataFrame:
    return M.padded_batches(t("documents").select("doc_id", F.length("text").cast("long").alias("n")), "doc_id", "n", 32)


@query(
    "ordered_digest",
    """WITH f AS (SELECT n_name AS name, sha256(count(*) || ':' || sum(c_custkey)) AS sha FROM customer JOIN nation ON n_nationkey = c_nationkey GROUP BY 1)
    SELECT sha256(string_agg(name || ':' || sha || chr(10), '' ORDER BY name)) AS digest FROM f""",
)
def ordered_digest(t: Tables) -> DataFrame:
    """One digest over the customers of each nation, in the order of nations."""
    files = t("customer").join(t("nation"), F.col("n_nationkey") == F.col("c_nationkey")).groupBy(F.col("n_name").alias("name"))
    files = files.agg(F.sha2(F.concat_ws(":", F.count(F.lit(1)).cast("string"), F.sum("c_custkey").cast("string")), 256).alias("sha"))
    return M.ordered_digest(files, "name", "sha")


@query(
    "mix_scale",
    """WITH a AS (SELECT p_type, count(*) AS have, CASE WHEN p_type = 'ECONOMY' THEN 500 ELSE 300 END AS needed FROM part GROUP BY 1), s AS (SELECT least(1.0, min(have::DOUBLE / needed)) AS scale FROM a)
    SELECT p_type, have, needed::BIGINT AS needed, scale::DOUBLE AS scale, floor(needed * scale)::BIGINT AS target FROM a, s""",
)
def mix_scale(t: Tables) -> DataFrame:
    have = t("part").groupBy("p_type").agg(F.count(F.lit(1)).alias("have")).withColumn("needed", F.when(F.col("p_type") == "ECONOMY", 500).otherwise(300).cast("long"))
    return M.mix_scale(have, "needed", "have")


@query(
    "finite_metrics",
    """SELECT l_orderkey, l_linenumber FROM (SELECT *, CASE WHEN l_discount = 0 THEN 'inf'::DOUBLE ELSE l_tax / l_discount END AS x, CASE WHEN l_tax = 0 THEN 'nan'::DOUBLE ELSE l_quantity / l_tax END AS y FROM lineitem)
    WHERE NOT (isfinite(x) AND isfinite(y))""",
)
def finite_metrics(t: Tables) -> DataFrame:
    """Rows with a measure that is no finite number: ratios of all line items, by zero too."""
    x = F.when(F.col("l_discount") == 0, float("inf")).otherwise(F.try_divide("l_tax", "l_discount"))
    y = F.when(F.col("l_tax") == 0, float("nan")).otherwise(F.try_divide("l_quantity", "l_tax"))
    return t("lineitem").select("l_orderkey", "l_linenumber", x.alias("x"), y.alias("y")).where(~M.finite("x", "y")).select("l_orderkey", "l_linenumber")


@query(
    "structural_counters",
    f"WITH {FACTS} SELECT episode, count(*) FILTER (lost) AS lost, count(*) FILTER (pos IN ('error', 'signup') AND k > 10) AS unsafe FROM f GROUP BY episode HAVING count(*) FILTER (lost) <> count(*) FILTER (pos IN ('error', 'signup') AND k > 10)",
)
def structural_counters(t: Tables) -> DataFrame:
    per = facts(t).groupBy("episode").agg(M.n(F.col("lost")).alias("lost"), M.n(F.col("pos").isin("error", "signup") & (F.col("k") > 10)).alias("unsafe"))
    return per.where("lost <> unsafe")


@query("tied_options", "SELECT p_brand, p_partkey, p_size FROM (SELECT *, rank() OVER (PARTITION BY p_brand ORDER BY p_size) AS r FROM part) WHERE r = 1")
def tied_options(t: Tables) -> DataFrame:
    return R.with_ties(t("part"), ["p_brand"], F.col("p_size")).select("p_brand", "p_partkey", "p_size")


@query("best_by_rank", "SELECT p_brand, arg_min(p_partkey, struct_pack(a := p_size, b := -p_retailprice, c := p_partkey)) AS p_partkey FROM part GROUP BY p_brand")
def best_by_rank(t: Tables) -> DataFrame:
    return R.best_by_rank(t("part"), ["p_brand"], "p_partkey", F.col("p_size"), -F.col("p_retailprice"))


@query("lexicographic_rank", "SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority, o_orderstatus, -o_totalprice, o_orderkey) AS r FROM orders) WHERE r = 1")
def lexicographic_rank(t: Tables) -> DataFrame:
    rank = F.struct("o_orderpriority", "o_orderstatus", -F.col("o_totalprice"), "o_orderkey")
    return t("orders").groupBy("o_custkey").agg(F.min_by("o_orderkey", rank).alias("o_orderkey"))


@query("two_key_rank", "SELECT l_partkey, arg_max(l_suppkey, struct_pack(a := m, b := v, c := -l_suppkey)) AS l_suppkey FROM (SELECT l_partkey, l_suppkey, min(l_quantity) AS m, avg(l_quantity) AS v FROM lineitem GROUP BY 1, 2) GROUP BY l_partkey")
def two_key_rank(t: Tables) -> DataFrame:
    per = t("lineitem").groupBy("l_partkey", "l_suppkey").agg(F.min("l_quantity").alias("m"), F.avg("l_quantity").alias("v"))
    return per.groupBy("l_partkey").agg(F.max_by("l_suppkey", F.struct("m", "v", -F.col("l_suppkey"))).alias("l_suppkey"))


@query("two_level_sort", "SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey, o_orderstatus = 'F' ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders) WHERE r <= CASE WHEN o_orderstatus = 'F' THEN 3 ELSE 1 END")
def two_level_sort(t: Tables) -> DataFrame:
    return R.two_level(t("orders"), F.col("o_orderstatus") == "F", ["o_custkey"], [F.col("o_totalprice").desc(), F.col("o_orderkey")], 3, 1).select("o_custkey", "o_orderkey")


@query("route_min", "SELECT s_nationkey, min(abs(s_suppkey % 28 - p_partkey % 28) + least(abs(s_suppkey % 13 - p_size % 13), 13 - abs(s_suppkey % 13 - p_size % 13))) AS nearest FROM supplier JOIN lineitem ON l_suppkey = s_suppkey JOIN part ON p_partkey = l_partkey GROUP BY s_nationkey")
def route_min(t: Tables) -> DataFrame:
    from wayfold.functions.grid import wrapped_manhattan

    pairs = t("lineitem").select("l_suppkey", "l_partkey").join(t("supplier"), F.col("l_suppkey") == F.col("s_suppkey")).join(t("part"), F.col("p_partkey") == F.col("l_partkey"))
    d = wrapped_manhattan(F.col("s_suppkey") % 28, F.col("s_suppkey") % 13, F.col("p_partkey") % 28, (F.col("p_size") % 13).cast("long"), 13)
    return pairs.groupBy("s_nationkey").agg(F.min(d).alias("nearest"))


@query("scalar_math", "SELECT o_orderkey, round_even(o_totalprice / 1000 - 0.5, 0)::BIGINT AS even, CAST(ceil(o_orderkey / 8.0) AS BIGINT) AS ceil_div, ln(greatest(o_totalprice / 1e6, 1e-8)) AS log_floor, ((-o_orderkey) % 28 + 28) % 28 AS wrapped, abs(o_totalprice - round(o_totalprice)) <= 0.01 AS close FROM orders")
def scalar_math(t: Tables) -> DataFrame:
    k, p = F.col("o_orderkey"), F.col("o_totalprice")
    return t("orders").select("o_orderkey", F.bround(p / 1000 - 0.5).cast("long").alias("even"), F.expr("(o_orderkey + 7) div 8").alias("ceil_div"), F.log(F.greatest(p / 1e6, F.lit(1e-8))).alias("log_floor"), F.pmod(-k, F.lit(28)).alias("wrapped"), (F.abs(p - F.round(p)) <= 0.01).alias("close"))


@query("vector_products", "SELECT vec_id, round(list_sum(list_transform(embedding, lambda v: v::DOUBLE * v::DOUBLE)), 9) AS norm2, round(list_sum(list_transform(embedding, lambda v, i: v::DOUBLE * i)) / sqrt(64), 6) AS scaled FROM embeddings")
def vector_products(t: Tables) -> DataFrame:
    place = F.transform(F.sequence(F.lit(1), F.size("embedding")), lambda i: i.cast("double"))
    return t("embeddings").select("vec_id", F.round(P.dot(F.col("embedding"), F.col("embedding")), 9).alias("norm2"), F.round(P.dot(F.col("embedding"), place) / F.sqrt(F.lit(64.0)), 6).alias("scaled"))
