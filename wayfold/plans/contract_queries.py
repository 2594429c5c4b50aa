"""Contracts, behaviour roles, scouting and option ranking over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wayfold.functions import flags as G
from wayfold.operators import contracts as K
from wayfold.operators import ranking as R
from wayfold.operators import trajectory as T
from wayfold.plans.base import FACTS, LIVES, Tables, facts, lived, query
from wayfold.plans.pool_queries import POOL, pool


@query(
    "dataset_contract",
    f"""WITH {POOL}, b AS (SELECT event_id AS id, digest, split, label AS class, family, CASE WHEN event_id % 9 = 0 THEN CASE WHEN event_id % 5 = 1 THEN -event_id ELSE event_id - 1 END END AS parent, label FROM r),
    dg AS (SELECT digest, count(*) AS n, count(DISTINCT split) AS s FROM b GROUP BY digest), c AS (SELECT class, count(*) AS n FROM b GROUP BY class),
    q AS (SELECT * FROM (VALUES ('click', 1600), ('error', 100), ('none', 1), ('purchase', 1600), ('signup', 1600), ('view', 1600)) v(class, quota))
    SELECT 'duplicate digest' AS check, digest AS key, n::VARCHAR AS detail FROM dg WHERE n > 1
    UNION ALL SELECT 'digest in two splits', digest, s::VARCHAR FROM dg WHERE s > 1
    UNION ALL SELECT 'quota', coalesce(q.class, c.class), coalesce(n, 0) || '/' || quota FROM q FULL JOIN c ON c.class = q.class WHERE coalesce(n, 0) IS DISTINCT FROM quota
    UNION ALL SELECT 'family cap', family::VARCHAR, count(*)::VARCHAR FROM b GROUP BY family HAVING count(*) > 58
    UNION ALL SELECT 'parent', b.id::VARCHAR, b.parent::VARCHAR FROM b LEFT JOIN b p ON p.id = b.parent WHERE b.parent IS NOT NULL AND p.split IS DISTINCT FROM b.split
    UNION ALL SELECT 'illegal label', id::VARCHAR, label FROM b WHERE label = 'signup'""",
)
def dataset_contract(t: Tables) -> DataFrame:
    """The contract over all events; some parents are ids that no event has."""
    rows = pool(t).withColumnRenamed("event_id", "id").withColumn("class", F.col("label"))
    parent = F.when(F.col("id") % 5 == 1, -F.col("id")).otherwise(F.col("id") - 1)
    rows = rows.withColumn("parent", F.when(F.col("id") % 9 == 0, parent)).withColumn("options", F.array(*map(F.lit, ("click", "error", "purchase", "view"))))
    return K.dataset(rows, {"click": 1600, "error": 100, "none": 1, "purchase": 1600, "signup": 1600, "view": 1600}, 58)


@query(
    "seed_contract",
    """WITH s AS (SELECT CASE WHEN o_orderstatus = 'F' THEN 'train' ELSE 'test' END AS name, CASE WHEN o_orderkey % 50 = 0 THEN -o_orderkey ELSE o_custkey END AS seed FROM orders),
    a AS (SELECT seed, count(DISTINCT name) AS lists, count(*) AS n FROM s GROUP BY seed)
    SELECT 'not positive' AS check, seed::VARCHAR AS key, name AS detail FROM s WHERE seed IS NULL OR seed <= 0 UNION ALL SELECT 'in two lists', seed::VARCHAR, lists::VARCHAR FROM a WHERE lists > 1
    UNION ALL SELECT 'repeated', seed::VARCHAR, n::VARCHAR FROM a WHERE n > lists UNION ALL SELECT 'reserved', seed::VARCHAR, name FROM s WHERE seed IN (SELECT c_custkey FROM customer WHERE c_nationkey = 3)""",
)
def seed_contract(t: Tables) -> DataFrame:
    o = t("orders")
    seeds = o.select(F.when(F.col("o_orderstatus") == "F", "train").otherwise("test").alias("name"), F.when(F.col("o_orderkey") % 50 == 0, -F.col("o_orderkey")).otherwise(F.col("o_custkey")).alias("seed"))
    return K.seed_sets(seeds, t("customer").where("c_nationkey = 3").select(F.col("c_custkey").alias("seed")))


@query(
    "row_contract",
    """WITH c AS (SELECT l_orderkey * 10 + l_linenumber AS id, unnest(list_filter([CASE WHEN NOT l_quantity <= 45 THEN 'quantity' END, CASE WHEN NOT l_tax < 0.08 THEN 'tax' END, CASE WHEN NOT l_returnflag IN ('A', 'N') THEN 'flag' END], lambda x: x IS NOT NULL)) AS check FROM lineitem)
    SELECT "check", id::VARCHAR AS key, '' AS detail FROM c""",
)
def row_contract(t: Tables) -> DataFrame:
    rows = t("lineitem").withColumn("id", F.col("l_orderkey") * 10 + F.col("l_linenumber"))
    return K.row_checks(rows, "id", {"quantity": F.col("l_quantity") <= 45, "tax": F.col("l_tax") < 0.08, "flag": F.col("l_returnflag").isin("A", "N")})


@query("one_identity", "SELECT l_orderkey, count(DISTINCT l_returnflag) AS identities, min(l_returnflag) AS first, max(l_returnflag) AS last FROM lineitem GROUP BY l_orderkey HAVING count(DISTINCT l_returnflag) > 1")
def one_identity(t: Tables) -> DataFrame:
    return K.one_identity(t("lineitem"), ["l_orderkey"], "l_returnflag")


@query("frozen_config", "SELECT n_nationkey, n_name AS saved, CASE WHEN n_nationkey % 4 = 1 THEN upper(n_name) || '!' WHEN n_nationkey = 5 THEN NULL ELSE n_name END AS current FROM nation WHERE n_nationkey % 4 = 1 OR n_nationkey = 5")
def frozen_config(t: Tables) -> DataFrame:
    saved = t("nation").select("n_nationkey", F.col("n_name").alias("value"))
    now = saved.where("n_nationkey <> 5 OR n_nationkey % 4 = 1").withColumn("value", F.when(F.col("n_nationkey") % 4 == 1, F.concat(F.upper("value"), F.lit("!"))).otherwise(F.col("value")))
    return K.frozen(saved, now, ["n_nationkey"])


@query(
    "behaviour_roles",
    f"""WITH {LIVES}, n AS (SELECT *, lead(turn) OVER w = turn + 1 AND lead(frames) OVER w > frames AS escapes,
      min(CASE WHEN progress THEN turn END) OVER (PARTITION BY episode ORDER BY turn ROWS BETWEEN 1 FOLLOWING AND 24 FOLLOWING) - turn AS food FROM l WINDOW w AS (PARTITION BY episode, life ORDER BY turn)),
    x AS (SELECT episode, unnest(list_filter([CASE WHEN escapes AND k <= 20 THEN 'escape' END, CASE WHEN food <= 2 AND NOT progress THEN 'approach' END, CASE WHEN food IS NULL THEN 'cleanup' END, CASE WHEN lost THEN 'critical' END], lambda v: v IS NOT NULL)) AS role FROM n)
    SELECT role, count(*) AS rows, count(DISTINCT episode) AS games FROM x GROUP BY role""",
)
def behaviour_roles(t: Tables) -> DataFrame:
    rows = T.with_next_progress(T.with_next(lived(t), "frames"))
    roles = G.flag_map(
        {
            "escape": (F.col("next_frames") > F.col("frames")) & (F.col("k") <= 20),
            "approach": (F.col("progress_in") <= 2) & ~F.col("progress"),
            "cleanup": F.col("progress_in").isNull(),
            "critical": F.col("lost"),
        }
    )
    return rows.select("episode", F.explode(G.true_names(roles)).alias("role")).groupBy("role").agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("episode").alias("games"))


@query(
    "risk_predicates",
    """WITH c AS (SELECT l_orderkey, bool_or(l_returnflag = 'R') AS some_fatal, bool_and(l_returnflag = 'R') AS all_fatal, bool_or(l_returnflag = 'R' AND l_linenumber = 1) AS choice_fatal FROM lineitem GROUP BY l_orderkey)
    SELECT l_orderkey, some_fatal AND NOT all_fatal AS mixed, all_fatal, choice_fatal AND NOT all_fatal AS avoidable FROM c""",
)
def risk_predicates(t: Tables) -> DataFrame:
    option = F.struct(F.col("o").alias("o"), F.struct((F.col("f")).alias("life_lost")).alias("r"))
    per = t("lineitem").groupBy("l_orderkey", F.col("l_linenumber").cast("string").alias("o")).agg((F.max(F.when(F.col("l_returnflag") == "R", 1).otherwise(0)) == 1).alias("f"), (F.min(F.when(F.col("l_returnflag") == "R", 1).otherwise(0)) == 1).alias("every"))
    # an option is an order line number; its lines may differ, so fatal and always fatal are kept apart
    risks = per.groupBy("l_orderkey").agg(F.map_from_entries(F.collect_list(option)).alias("risks"), (F.min(F.col("every").cast("int")) == 1).alias("all_fatal"))
    some = F.exists(F.map_values("risks"), lambda r: r["life_lost"])
    return risks.select("l_orderkey", (some & ~F.col("all_fatal")).alias("mixed"), "all_fatal", (G.choice_fatal(F.col("risks"), F.lit("1")) & ~F.col("all_fatal")).alias("avoidable"))


@query(
    "danger_nearest",
    "SELECT l_orderkey, coalesce(min(l_suppkey) FILTER (l_returnflag = 'R'), 999) AS danger, coalesce(min(l_suppkey) FILTER (l_returnflag = 'A'), 999) AS frightened, coalesce(min(l_suppkey), 999) AS any_near FROM lineitem GROUP BY l_orderkey",
)
def danger_nearest(t: Tables) -> DataFrame:
    per = t("lineitem").groupBy("l_orderkey", "l_returnflag").agg(F.min("l_suppkey").alias("d"))
    near = per.groupBy("l_orderkey").agg(F.map_from_entries(F.collect_list(F.struct("l_returnflag", "d"))).alias("m"))
    return near.select("l_orderkey", G.nearest(F.col("m"), F.array(F.lit("R"))).alias("danger"), G.nearest(F.col("m"), F.array(F.lit("A"))).alias("frightened"), G.nearest(F.col("m")).alias("any_near"))


@query("clock_transitions", f"WITH {FACTS}, n AS (SELECT *, lead(k) OVER (PARTITION BY episode ORDER BY turn) AS nk FROM f) SELECT episode, turn, k AS before, nk % 10 AS after, coalesce(k > 0 AND nk % 10 = 0, false) AS expired FROM n")
def clock_transitions(t: Tables) -> DataFrame:
    after = F.lead("k").over(T.episode()) % 10
    return facts(t).withColumn("after_", after).select("episode", "turn", G.power_transition(F.col("k"), F.col("after_")).alias("p")).select("episode", "turn", "p.before", "p.after", F.coalesce("p.expired", F.lit(False)).alias("expired"))


@query(
    "ranked_alternatives",
    "SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderstatus = 'F', o_totalprice DESC, o_orderkey) AS place FROM orders WHERE o_orderpriority <> '5-LOW'",
)
def ranked_alternatives(t: Tables) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("o_custkey").orderBy(F.struct((F.col("o_orderstatus") == "F"), -F.col("o_totalprice"), F.col("o_orderkey"))))
    return t("orders").where("o_orderpriority <> '5-LOW'").select("o_custkey", "o_orderkey", rank.cast("long").alias("place"))


@query(
    "priority_scout",
    f"""WITH {POOL}, bad AS (SELECT digest FROM r GROUP BY digest HAVING count(DISTINCT split) > 1 OR count(DISTINCT label) > 1), b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY digest ORDER BY margin DESC, event_id) AS dn FROM r ANTI JOIN bad USING (digest)) WHERE dn = 1),
    t AS (SELECT *, row_number() OVER (PARTITION BY label, split ORDER BY margin DESC, event_id) AS tn FROM b)
    SELECT event_id, label, split, row_number() OVER (ORDER BY tn, label, split) AS place FROM t ORDER BY tn, label, split LIMIT 250""",
)
def priority_scout(t: Tables) -> DataFrame:
    from wayfold.operators.pools import quarantine

    best = R.keep_best(quarantine(pool(t), "digest", "split", "label"), ["digest"], F.col("margin").desc(), F.col("event_id"))
    return R.round_robin(best, ["label", "split"], [F.col("margin").desc(), F.col("event_id")], 250).select("event_id", "label", "split", "place")


@query(
    "scout_deficits",
    f"WITH {POOL}, c AS (SELECT label, split, count(DISTINCT digest) AS n FROM r WHERE margin > 30000 GROUP BY 1, 2) SELECT label, split, n, greatest(60 - n, 0) AS deficit FROM c",
)
def scout_deficits(t: Tables) -> DataFrame:
    per = pool(t).where("margin > 30000").groupBy("label", "split").agg(F.count_distinct("digest").alias("n"))
    return per.withColumn("deficit", F.greatest(F.lit(60) - F.col("n"), F.lit(0)))


@query("checklist_differences", "SELECT c_custkey, concat_ws(',', CASE WHEN c_nationkey <> c_custkey % 25 THEN 'nation' END, CASE WHEN (c_acctbal > 0) <> (c_custkey % 2 = 0) THEN 'sign' END) AS differs FROM customer WHERE c_nationkey <> c_custkey % 25 OR (c_acctbal > 0) <> (c_custkey % 2 = 0)")
def checklist_differences(t: Tables) -> DataFrame:
    pair = lambda a, b: F.struct(a.cast("string").alias("saved"), b.cast("string").alias("expected"))
    k = F.col("c_custkey")
    found = G.mismatches(F.create_map(F.lit("nation"), pair(F.col("c_nationkey").cast("long"), k % 25), F.lit("sign"), pair(F.col("c_acctbal") > 0, k % 2 == 0)))
    return t("customer").select("c_custkey", F.array_join(F.map_keys(found), ",").alias("differs")).where("differs <> ''")


@query("reserved_universe", "SELECT c_custkey AS seed FROM customer WHERE c_nationkey = 3 UNION SELECT s_suppkey FROM supplier UNION SELECT n_nationkey FROM nation")
def reserved_universe(t: Tables) -> DataFrame:
    lists = [t("customer").where("c_nationkey = 3").select(F.col("c_custkey").alias("seed")), t("supplier").select("s_suppkey"), t("nation").select(F.col("n_nationkey").cast("long"))]
    return lists[0].union(lists[1]).union(lists[2]).distinct()


@query(
    "decision_rows",
    f"""WITH {LIVES}, n AS (SELECT *, lead(pos) OVER w AS nx, sum(progress::INT) OVER (PARTITION BY episode ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS done FROM l WINDOW w AS (PARTITION BY episode ORDER BY turn))
    SELECT episode, turn, life AS life_index, 100 - coalesce(done, 0)::BIGINT AS pellets_before, 100 - coalesce(done, 0)::BIGINT - progress::BIGINT AS pellets_after, nx AS next_pos, CASE WHEN lost THEN 'life_lost' END AS outcome, 'Go ' || pos AS criterion FROM n""",
)
def decision_rows(t: Tables) -> DataFrame:
    from wayfold.functions.canon import criteria

    done = F.coalesce(F.sum(F.col("progress").cast("long")).over(T.past()), F.lit(0))
    step = F.col("progress").cast("long")
    return lived(t).select("episode", "turn", F.col("life").alias("life_index"), (100 - done).alias("pellets_before"), (100 - done - step).alias("pellets_after"), F.lead("pos").over(T.episode()).alias("next_pos"), F.when(F.col("lost"), "life_lost").alias("outcome"), criteria(F.array("pos"))[F.col("pos")].alias("criterion"))
