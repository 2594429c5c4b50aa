"""Fingerprints, conflicts, quarantine, selection, graph and contract queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wayfold.functions import canon
from wayfold.functions import flags as G
from wayfold.operators import compare as C
from wayfold.operators import graph, selection
from wayfold.operators import metrics as M
from wayfold.operators import pools as Q
from wayfold.operators import ranking as R
from wayfold.plans.base import FACTS, WALK, Tables, facts, query, walked
from wayfold.plans.rollups import split_of
from wayfold.plans.trajectories import SUMMARY
from wayfold.sources import files as S
from wayfold.sources.shared import cut, stored
from wayfold.streaming import folds as ST

SPLIT = "CASE WHEN substr(md5(CAST(user_id AS VARCHAR)), 1, 1) IN ('0', '1', '2', '3') THEN 'development' ELSE 'train' END"
POOL = f"r AS (SELECT event_id, user_id AS family, {SPLIT} AS split, sha256(concat_ws(chr(31), props, CAST(trunc(value) AS BIGINT)::VARCHAR)) AS digest, event_type AS label, CAST(round(value * 100) AS BIGINT) AS margin FROM events)"


def pool(t: Tables) -> DataFrame:
    """Records with a request digest, split, label, family and margin."""
    e = t("events")
    digest = canon.fingerprint("props", F.col("value").cast("int"))
    return e.select("event_id", F.col("user_id").alias("family"), split_of(F.col("user_id")).alias("split"), digest.alias("digest"), F.col("event_type").alias("label"), F.round(F.col("value") * 100).cast("long").alias("margin"))


@query("request_fingerprints", f"WITH {POOL} SELECT event_id, digest, substr(digest, 1, 24) AS id FROM r")
def request_fingerprints(t: Tables) -> DataFrame:
    return pool(t).select("event_id", "digest", canon.identifier(F.col("digest")).alias("id"))


@query("row_fingerprints", "SELECT o_orderkey, sha256(concat_ws(chr(31), o_orderkey::VARCHAR, o_orderstatus, coalesce(nullif(o_orderpriority, '5-LOW'), chr(0) || 'null'))) AS digest FROM orders")
def row_fingerprints(t: Tables) -> DataFrame:
    return t("orders").select("o_orderkey", canon.fingerprint("o_orderkey", "o_orderstatus", F.nullif(F.col("o_orderpriority"), F.lit("5-LOW"))).alias("digest"))


@query("json_fingerprints", """SELECT event_id, sha256('{"k":' || json_extract_string(props, '$.k') || '}') AS digest FROM events""")
def json_fingerprints(t: Tables) -> DataFrame:
    return t("events").select("event_id", canon.json_fingerprint(F.col("props")).alias("digest"))


@query(
    "conflicts",
    f"WITH {POOL} SELECT digest, count(DISTINCT split) AS n_split, string_agg(DISTINCT split, ',' ORDER BY split) AS split_values, count(DISTINCT label) AS n_label, string_agg(DISTINCT label, ',' ORDER BY label) AS label_values FROM r GROUP BY digest HAVING count(DISTINCT split) > 1 OR count(DISTINCT label) > 1",
)
def conflicts(t: Tables) -> DataFrame:
    return Q.conflicts(pool(t), "digest", "split", "label")


_CLEAN = f"{POOL}, bad AS (SELECT digest FROM r GROUP BY digest HAVING count(DISTINCT split) > 1 OR count(DISTINCT label) > 1), c AS (SELECT * FROM r ANTI JOIN bad USING (digest))"


@query("quarantine", f"WITH {_CLEAN} SELECT event_id, digest, split, label FROM c")
def quarantine(t: Tables) -> DataFrame:
    return Q.quarantine(pool(t), "digest", "split", "label").select("event_id", "digest", "split", "label")


@query("keep_best", f"WITH {POOL} SELECT digest, event_id FROM (SELECT *, row_number() OVER (PARTITION BY digest ORDER BY margin DESC, event_id) AS rn FROM r) WHERE rn = 1")
def keep_best(t: Tables) -> DataFrame:
    return R.keep_best(pool(t), ["digest"], F.col("margin").desc(), F.col("event_id")).select("digest", "event_id")


@query("exclude_used", f"WITH {POOL} SELECT event_id, digest FROM r WHERE split = 'train' AND digest NOT IN (SELECT digest FROM r WHERE split = 'development')")
def exclude_used(t: Tables) -> DataFrame:
    rows = pool(t)
    return Q.exclude(rows.where("split = 'train'"), rows.where("split = 'development'"), ["digest"]).select("event_id", "digest")


@query("split_overlap", f"WITH {POOL} SELECT digest FROM r WHERE split = 'train' INTERSECT SELECT digest FROM r WHERE split = 'development'")
def split_overlap(t: Tables) -> DataFrame:
    rows = pool(t)
    return Q.overlap(rows.where("split = 'train'"), rows.where("split = 'development'"), ["digest"])


@query(
    "set_differences",
    """WITH a AS (SELECT p_brand, p_size FROM part WHERE p_partkey % 2 = 0), b AS (SELECT p_brand, p_size FROM part WHERE p_partkey % 2 = 1)
    SELECT *, 'left' AS side FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b) UNION ALL SELECT *, 'right' AS side FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a)""",
)
def set_differences(t: Tables) -> DataFrame:
    part = t("part")
    return Q.set_differences(*[part.where(F.col("p_partkey") % 2 == k).select("p_brand", "p_size") for k in (0, 1)])


@query("exact_duplicates", "SELECT md5(text) AS digest, count(*) AS copies, min(doc_id) AS first_doc, count(DISTINCT source) AS sources FROM documents GROUP BY 1 HAVING count(*) > 1")
def exact_duplicates(t: Tables) -> DataFrame:
    return t("documents").groupBy(F.md5("text").alias("digest")).agg(F.count(F.lit(1)).alias("copies"), F.min("doc_id").alias("first_doc"), F.count_distinct("source").alias("sources")).where("copies > 1")


@query("declared_jobs", "SELECT c.conv_id, c.turn FROM conversations c WHERE EXISTS (SELECT 1 FROM (SELECT conv_id, max(turn) AS m FROM conversations GROUP BY conv_id) j WHERE j.conv_id = c.conv_id AND c.turn = j.m AND j.m >= 3)")
def declared_jobs(t: Tables) -> DataFrame:
    c = t("conversations")
    jobs = c.groupBy("conv_id").agg(F.max("turn").alias("turn")).where("turn >= 3")
    return c.join(jobs, ["conv_id", "turn"], "left_semi").select("conv_id", "turn")


@query("undeclared_jobs", "SELECT s_suppkey FROM supplier ANTI JOIN (SELECT DISTINCT l_suppkey AS s_suppkey FROM lineitem WHERE l_quantity > 49 AND l_discount > 0.095) USING (s_suppkey)")
def undeclared_jobs(t: Tables) -> DataFrame:
    declared = t("lineitem").where("l_quantity > 49 AND l_discount > 0.095").select(F.col("l_suppkey").alias("s_suppkey")).distinct()
    return Q.undeclared(t("supplier"), declared, ["s_suppkey"]).select("s_suppkey")


@query("job_grid", "SELECT n_nationkey, r_regionkey, level FROM nation, region, (SELECT unnest([1, 2, 3, 5]) AS level) WHERE n_regionkey = r_regionkey")
def job_grid(t: Tables) -> DataFrame:
    jobs = t("nation").join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return jobs.select("n_nationkey", "r_regionkey", F.explode(F.array(*map(F.lit, (1, 2, 3, 5)))).alias("level"))


@query("record_of_result", "SELECT l_orderkey, l_linenumber, o_orderpriority, c_mktsegment FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey WHERE l_quantity >= 48")
def record_of_result(t: Tables) -> DataFrame:
    few = t("lineitem").where("l_quantity >= 48").select("l_orderkey", "l_linenumber")
    return few.join(t("orders"), F.col("o_orderkey") == F.col("l_orderkey")).join(t("customer"), F.col("c_custkey") == F.col("o_custkey")).select("l_orderkey", "l_linenumber", "o_orderpriority", "c_mktsegment")


@query(
    "accepted_parents",
    f"WITH {FACTS} SELECT w.episode, w.turn FROM f w SEMI JOIN (SELECT episode, turn + 1 AS turn FROM f WHERE progress AND k > 50) p ON p.episode = w.episode AND p.turn = w.turn",
)
def accepted_parents(t: Tables) -> DataFrame:
    rows = facts(t)
    accepted = rows.where("progress AND k > 50").select("episode", (F.col("turn") + 1).alias("turn"))
    return rows.join(accepted, ["episode", "turn"], "left_semi").select("episode", "turn")


@query("proof_join", f"WITH {FACTS} SELECT f.episode, f.turn, e.event_type AS label FROM f LEFT JOIN events e ON e.event_id = f.event_id AND e.event_type <> 'signup'")
def proof_join(t: Tables) -> DataFrame:
    proofs = t("events").where("event_type <> 'signup'").select("event_id", F.col("event_type").alias("label"))
    return facts(t).join(proofs, "event_id", "left").select("episode", "turn", "label")


@query(
    "round_robin",
    "SELECT p_partkey, row_number() OVER (ORDER BY t, p_brand) AS place FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS t FROM part) ORDER BY t, p_brand LIMIT 500",
)
def round_robin(t: Tables) -> DataFrame:
    return R.round_robin(t("part"), ["p_brand"], [F.col("p_retailprice").desc(), F.col("p_partkey")], 500).select("p_partkey", "place")


@query(
    "merged_streams",
    "SELECT conv_id, turn, role, row_number() OVER (ORDER BY i, s, conv_id, turn) AS place FROM (SELECT *, row_number() OVER (PARTITION BY role ORDER BY conv_id, turn) AS i, CASE role WHEN 'system' THEN 0 WHEN 'user' THEN 1 ELSE 2 END AS s FROM conversations)",
)
def merged_streams(t: Tables) -> DataFrame:
    rows = t("conversations").withColumn("s", F.when(F.col("role") == "system", 0).when(F.col("role") == "user", 1).otherwise(2))
    return R.round_robin(rows, ["s"], [F.col("conv_id"), F.col("turn")]).select("conv_id", "turn", "role", "place")


@query(
    "spread_picks",
    "SELECT p_brand, p_partkey FROM (SELECT *, count(*) OVER (PARTITION BY p_brand) AS n, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1 AS i FROM part) WHERE i IN (0, n // 3, 2 * n // 3)",
)
def spread_picks(t: Tables) -> DataFrame:
    return R.spread(t("part"), ["p_brand"], [F.col("p_partkey")], 3).select("p_brand", "p_partkey")


@query("seeded_draw", "SELECT o_orderkey FROM orders ORDER BY md5(concat_ws(':', 'seed-7', o_orderkey::VARCHAR)), o_orderkey LIMIT 200")
def seeded_draw(t: Tables) -> DataFrame:
    return R.draw(t("orders"), 200, "seed-7", "o_orderkey").select("o_orderkey")


@query("family_cap", f"WITH {POOL} SELECT event_id, family FROM (SELECT *, row_number() OVER (PARTITION BY family ORDER BY margin DESC, event_id) AS rn FROM r) WHERE rn <= 4")
def family_cap(t: Tables) -> DataFrame:
    return R.first_rows(pool(t), ["family"], [F.col("margin").desc(), F.col("event_id")], 4).select("event_id", "family")


@query(
    "budget_fill",
    f"""WITH {POOL}, c AS (SELECT *, row_number() OVER (PARTITION BY label, split, family ORDER BY margin DESC, event_id) AS fr FROM r),
    k AS (SELECT *, row_number() OVER (PARTITION BY label, split ORDER BY margin DESC, event_id) AS rn FROM c WHERE fr <= 2)
    SELECT event_id, label, split FROM k WHERE rn <= CASE WHEN split = 'train' THEN 60 ELSE 20 END""",
)
def budget_fill(t: Tables) -> DataFrame:
    rows = pool(t)
    budgets = rows.select("label", "split").distinct().withColumn("budget", F.when(F.col("split") == "train", 60).otherwise(20))
    return selection.fill(rows, ["label", "split"], budgets, "family", 2, [F.col("margin").desc(), F.col("event_id")]).select("event_id", "label", "split")


@query("quota_arithmetic", "SELECT p_size, round_even(count(*) * 0.35, 0)::BIGINT AS first, (count(*) - round_even(count(*) * 0.35, 0))::BIGINT AS second FROM part GROUP BY p_size")
def quota_arithmetic(t: Tables) -> DataFrame:
    first, second = selection.quotas(F.col("n"), 0.35)
    return t("part").groupBy("p_size").agg(F.count(F.lit(1)).alias("n")).select("p_size", first.alias("first"), second.alias("second"))


@query(
    "replay_selection",
    f"""WITH {POOL}, u AS (SELECT family, count(*) AS used FROM r WHERE margin > 20000 GROUP BY family),
    o AS (SELECT *, row_number() OVER (PARTITION BY family ORDER BY md5(concat_ws(':', 'replay', event_id::VARCHAR)), event_id) AS rn FROM r WHERE margin <= 20000)
    SELECT o.event_id FROM o LEFT JOIN u USING (family) WHERE rn + coalesce(used, 0) <= 6""",
)
def replay_selection(t: Tables) -> DataFrame:
    rows = pool(t)
    used = rows.where("margin > 20000").groupBy("family").agg(F.count(F.lit(1)).alias("used"))
    rank = F.row_number().over(Window.partitionBy("family").orderBy(R.seeded("replay", "event_id"), "event_id"))
    rest = rows.where("margin <= 20000").withColumn("rn", rank).join(used, "family", "left")
    return rest.where(F.col("rn") + F.coalesce("used", F.lit(0)) <= 6).select("event_id")


@query(
    "strongest_family",
    "SELECT l_partkey, l_suppkey FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY s DESC, n DESC, l_suppkey) AS rn FROM (SELECT l_partkey, l_suppkey, max(l_quantity) AS s, count(*) AS n FROM lineitem GROUP BY 1, 2)) WHERE rn = 1",
)
def strongest_family(t: Tables) -> DataFrame:
    return selection.strongest_family(t("lineitem"), "l_partkey", "l_quantity", "l_suppkey")


@query(
    "cohort_sampler",
    f"""WITH {FACTS}, c AS (SELECT episode, turn, unnest(list_filter([CASE WHEN lost THEN 'lost' END, CASE WHEN progress THEN 'progress' END, CASE WHEN k < 20 THEN 'near' END], lambda n: n IS NOT NULL)) AS cohort FROM f),
    n AS (SELECT *, count(*) OVER (PARTITION BY episode, cohort) AS n, row_number() OVER (PARTITION BY episode, cohort ORDER BY turn) - 1 AS i FROM c)
    SELECT DISTINCT episode, turn FROM n WHERE i IN (0, n // 3, 2 * n // 3)""",
)
def cohort_sampler(t: Tables) -> DataFrame:
    names = G.true_names(G.flag_map({"lost": F.col("lost"), "near": F.col("k") < 20, "progress": F.col("progress")}))
    rows = facts(t).select("episode", "turn", F.explode(names).alias("cohort"))
    return R.spread(rows, ["episode", "cohort"], [F.col("turn")], 3).select("episode", "turn").distinct()


def _cover_input(t: Tables) -> DataFrame:
    rows = pool(t).join(facts(t).select("event_id", "lost", "progress", "k"), "event_id")
    flags = G.flag_map({"lost": F.col("lost"), "near": F.col("k") < 5, "progress": F.col("progress")})
    return rows.select(F.col("event_id").cast("string").alias("id"), "digest", F.col("margin").alias("priority"), flags.alias("flags"), "family", "margin", F.col("label").alias("class"), F.col("split").alias("origin"))


FLAGS = ("lost", "near", "progress")
_UNIQUE = f"""{FACTS}, {POOL},
j AS (SELECT r.*, f.lost, f.k < 5 AS near, f.progress, md5(concat_ws(':', 'cover', r.event_id::VARCHAR)) AS h FROM r JOIN f USING (event_id)),
u AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY digest ORDER BY margin DESC, h, event_id::VARCHAR) AS rn FROM j) WHERE rn = 1)"""


@query(
    "cover_verified",
    f"""WITH {_UNIQUE}, n AS (SELECT count(*) // 30 AS chosen, {', '.join(f'count(*) FILTER ({k}) // 60 AS {k}' for k in FLAGS)} FROM u)
    SELECT chosen, chosen AS digests, {', '.join(f'{k} AS {k}_floor, true AS {k}_met' for k in FLAGS)} FROM n""",
)
def cover_verified(t: Tables) -> DataFrame:
    """The greedy cover of a thirtieth of all digests, verified: its size, distinct digests, and whether each floor (half its share) is met."""
    rows = _cover_input(t)
    unique = selection.one_per_digest(rows, "cover")
    n = unique.agg(F.count(F.lit(1)).alias("all"), *[M.n(G.flag(F.col("flags"), k)).alias(k) for k in FLAGS]).first()
    floors = {k: n[k] // 60 for k in FLAGS}
    chosen = selection.balanced(rows, n["all"] // 30, {k: v for k, v in floors.items() if v}, "cover")
    got = unique.join(t.spark.createDataFrame([(i,) for i in chosen], "id string"), "id")
    met = [c for k, v in floors.items() for c in (F.lit(v).alias(f"{k}_floor"), (M.n(G.flag(F.col("flags"), k)) >= v).alias(f"{k}_met"))]
    return got.agg(F.count(F.lit(1)).alias("chosen"), F.count_distinct("digest").alias("digests"), *met)


_BUDGET = "least(count(*) FILTER (label = 'click' AND split = 'train'), count(*) FILTER (label = 'click' AND split = 'development'), count(*) FILTER (label = 'view')) // 10"


@query(
    "quota_verified",
    f"""WITH {_UNIQUE}, b AS (SELECT {_BUDGET} AS easy, count(*) FILTER (label = 'click' AND near) // 40 AS floor FROM u),
    q AS (SELECT 'click' AS class, 3 * easy AS n, floor FROM b UNION ALL SELECT 'view', easy, 0 FROM b)
    SELECT * FROM (SELECT class, origin, CASE WHEN origin = 'train' THEN round_even(n * 0.6, 0)::BIGINT ELSE n - round_even(n * 0.6, 0)::BIGINT END AS rows, true AS floor_met, true AS family_capped, true AS best_first
    FROM q, (SELECT unnest(['train', 'development']) AS origin)) WHERE rows > 0""",
)
def quota_verified(t: Tables) -> DataFrame:
    """Clicks three to one with views, 60 to 40 over splits, a tenth of the scarcest; verified: rows, the floor, family caps, and that no larger margin was passed over."""
    cap = 6
    # read a dozen times below; it stays in the shared folder, since the result reads it
    rows, _ = stored(selection.one_per_digest(_cover_input(t), "cover").withColumn("flags", F.map_filter("flags", lambda k, v: k == "near")))
    of = lambda c, *o: M.n((F.col("class") == c) & F.col("origin").isin(*o))
    n = rows.agg(F.least(of("click", "train"), of("click", "development"), of("view", "train", "development")).alias("least"), M.n((F.col("class") == "click") & G.flag(F.col("flags"), "near")).alias("near")).first()
    easy, floor = n["least"] // 10, n["near"] // 40
    chosen = selection.select_mix(rows, {"click": 3 * easy, "view": easy}, ("train", "development", 0.6), {"near": floor} if floor else {}, cap, "quota")
    got = cut(rows.join(t.spark.createDataFrame([(i,) for i in chosen], "id string"), "id"))
    full = got.groupBy("family").agg((F.count(F.lit(1)) >= cap).alias("full"), F.count(F.lit(1)).alias("n"))
    capped = full.agg((F.max("n") <= cap).alias("family_capped"))
    met = got.agg(F.lit(floor).alias("floor"), (M.n((F.col("class") == "click") & G.flag(F.col("flags"), "near")) >= floor).alias("floor_met"))
    # rows left out of open families, against the least margin among the rows taken without need of the floor
    least = got.where(~G.flag(F.col("flags"), "near")).groupBy("class", "origin").agg(F.min("margin").alias("least"))
    left = rows.join(got.select("id"), "id", "left_anti").join(full.where("full").select("family"), "family", "left_anti").groupBy("class", "origin").agg(F.max("margin").alias("most"))
    best = least.join(left, ["class", "origin"], "left").agg(F.coalesce(F.bool_and(F.col("most") <= F.col("least")), F.lit(True)).alias("best_first"))
    per = got.groupBy("class", "origin").agg(F.count(F.lit(1)).alias("rows"))
    return per.join(met.select("floor_met")).join(capped).join(best)  # each is one row


_ROLE_FLAGS = {"critical": "lost AND k < 10", "escape": "k < 4", "anticipatory": "k < 8"}


@query(
    "flow_verified",
    f"""WITH {FACTS}, u AS (SELECT role, count(*) FILTER (hit) // 20 AS assigned FROM (SELECT unnest([{', '.join(f"{{'role': '{r}', 'hit': {e}}}" for r, e in _ROLE_FLAGS.items())}], recursive := true) FROM f) GROUP BY role)
    SELECT role, assigned, true AS has_role, true AS family_capped, true AS once FROM u WHERE assigned > 0""",
)
def flow_verified(t: Tables) -> DataFrame:
    """The flow assignment of a twentieth of each role's requests, verified: requests per role, that they have it, family caps, each request once."""
    cap = 8
    roles = F.array_compact(F.array(*[F.when(F.expr(e), F.lit(r)) for r, e in _ROLE_FLAGS.items()]))
    rows = facts(t).select(F.col("event_id").alias("request"), F.col("episode").alias("family"), roles.alias("roles")).where("size(roles) > 0")
    have = rows.select(F.explode("roles").alias("role")).groupBy("role").count().collect()  # a row a role
    found = cut(selection.assign_roles(rows, {r["role"]: r["count"] // 20 for r in have if r["count"] // 20}, cap, "flow"))
    per_family = found.groupBy("family").agg(F.count(F.lit(1)).alias("n")).agg((F.max("n") <= cap * 3 // 4).alias("family_capped"))
    once = found.agg((F.count(F.lit(1)) == F.count_distinct("request")).alias("once"))
    right = found.join(rows.select("request", "roles"), "request").groupBy("role").agg(F.count(F.lit(1)).alias("assigned"), F.bool_and(F.array_contains("roles", F.col("role"))).alias("has_role"))
    return right.join(per_family).join(once)  # each is one row


_RING = "e AS (SELECT n_nationkey AS src, (n_nationkey + 1) % 25 AS dst FROM nation UNION ALL SELECT (n_nationkey + 1) % 25, n_nationkey FROM nation)"


def ring(t: Tables) -> DataFrame:
    n = t("nation").select(F.col("n_nationkey").alias("src"), ((F.col("n_nationkey") + 1) % 25).alias("dst"))
    return n.union(n.select("dst", "src"))


@query(
    "ring_distances",
    f"WITH RECURSIVE {_RING}, b(dst, d) AS (SELECT 0, 0 UNION SELECT e.dst, b.d + 1 FROM b JOIN e ON e.src = b.dst WHERE b.d < 25) SELECT 0 AS src, dst, min(d) AS d FROM b GROUP BY dst",
)
def ring_distances(t: Tables) -> DataFrame:
    return graph.distances(ring(t), t.spark.createDataFrame([(0,)], "src int"))


@query("all_distances", "SELECT a.n_nationkey AS src, b.n_nationkey AS dst, least(abs(a.n_nationkey - b.n_nationkey), 25 - abs(a.n_nationkey - b.n_nationkey)) AS d FROM nation a, nation b")
def all_distances(t: Tables) -> DataFrame:
    return graph.distances(ring(t), t("nation").select(F.col("n_nationkey").alias("src")))


@query(
    "grid_distances",
    """WITH RECURSIVE c AS (SELECT p_partkey::INT // 28 AS r, p_partkey::INT % 28 AS c FROM part WHERE p_partkey % 7 <> 3),
    s AS (SELECT r * 28 + c AS src, unnest([r * 28 + c + 28, r * 28 + c - 28, r * 28 + (c + 1) % 28, r * 28 + (c + 27) % 28]) AS dst FROM c),
    e AS (SELECT src, dst FROM s WHERE dst IN (SELECT r * 28 + c FROM c)),
    b(dst, d) USING KEY (dst) AS (SELECT 0, 0 UNION SELECT e.dst, min(b.d + 1) FROM b JOIN e ON e.src = b.dst WHERE e.dst NOT IN (SELECT dst FROM recurring.b) GROUP BY e.dst)
    SELECT 0 AS src, dst, d FROM b""",
)
def grid_distances(t: Tables) -> DataFrame:
    cells = t("part").where("p_partkey % 7 <> 3").select(F.expr("cast(p_partkey div 28 as int)").alias("row"), F.expr("cast(p_partkey % 28 as int)").alias("column"))
    return graph.distances(graph.grid_edges(cells, 1 << 30, 28), t.spark.createDataFrame([(0,)], "src int"))


@query(
    "penalised_cost",
    """WITH d AS (SELECT a.n_nationkey AS "at", b.n_nationkey AS food, least(abs(a.n_nationkey - b.n_nationkey), 25 - abs(a.n_nationkey - b.n_nationkey)) AS d FROM nation a, nation b),
    p AS (SELECT food, sum(greatest(6 - d, 0)) AS penalty FROM d WHERE "at" % 7 = 0 GROUP BY food)
    SELECT "at", min(d + 2 * coalesce(penalty, 0))::BIGINT AS cost FROM d LEFT JOIN p USING (food) WHERE food % 3 = 0 GROUP BY ("at") """,
)
def penalised_cost(t: Tables) -> DataFrame:
    d = graph.distances(ring(t), t("nation").select(F.col("n_nationkey").alias("src")))
    food = d.where("dst % 3 = 0").select(F.col("src").alias("at"), F.col("dst").alias("food"), "d")
    return graph.penalised_cost(food, d.where("src % 7 = 0").select(F.col("dst").alias("food"), "d"))


@query(
    "parent_closure",
    "WITH RECURSIVE p AS (SELECT p_partkey AS id, CASE WHEN p_partkey = 0 THEN NULL ELSE (p_partkey - 1) // 3 END AS parent FROM part), u(id, ancestor, depth) AS (SELECT id, parent, 1 FROM p WHERE parent IS NOT NULL UNION ALL SELECT u.id, p.parent, u.depth + 1 FROM u JOIN p ON p.id = u.ancestor WHERE p.parent IS NOT NULL) SELECT id, ancestor, depth FROM u",
)
def parent_closure(t: Tables) -> DataFrame:
    parents = t("part").select(F.col("p_partkey").alias("id"), F.when(F.col("p_partkey") > 0, F.expr("(p_partkey - 1) div 3")).alias("parent"))
    return graph.ancestors(parents)


@query(
    "stored_metrics",
    f"WITH {WALK}, e AS ({SUMMARY}) SELECT episode, concat_ws(',', CASE WHEN episode % 10 = 0 THEN 'frames' END, CASE WHEN episode % 15 = 0 AND longest_dry <> 5 THEN 'longest_dry' END) AS differs FROM e WHERE episode % 10 = 0 OR (episode % 15 = 0 AND longest_dry <> 5)",
)
def stored_metrics(t: Tables) -> DataFrame:
    e = M.episode_summary(walked(t)).select("episode", "frames", "longest_dry")
    stored = e.withColumn("frames", F.when(F.col("episode") % 10 == 0, F.col("frames") + 1).otherwise(F.col("frames"))).withColumn("longest_dry", F.when(F.col("episode") % 15 == 0, 5).otherwise(F.col("longest_dry")))
    return C.recomputed_differs(stored, e, ["episode"], ["frames", "longest_dry"])


@query(
    "binding_violations",
    """WITH j AS (SELECT l_orderkey, l_linenumber, list_filter([CASE WHEN o_orderkey IS NULL THEN 'order' END, CASE WHEN s_suppkey IS NULL THEN 'supplier' END, CASE WHEN p_partkey IS NULL THEN 'part' END,
      CASE WHEN l_shipdate < o_orderdate THEN 'date' END, CASE WHEN l_discount > 0.09 THEN 'discount' END], lambda x: x IS NOT NULL) AS v FROM lineitem LEFT JOIN orders ON o_orderkey = l_orderkey LEFT JOIN supplier ON s_suppkey = l_suppkey LEFT JOIN part ON p_partkey = l_partkey)
    SELECT l_orderkey, l_linenumber, array_to_string(v, ',') AS violations, count(*) AS n FROM j WHERE len(v) > 0 GROUP BY 1, 2, 3""",
)
def binding_violations(t: Tables) -> DataFrame:
    l = t("lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey", "l_shipdate", "l_discount")
    j = l.join(t("orders").select("o_orderkey", "o_orderdate"), F.col("o_orderkey") == F.col("l_orderkey"), "left").join(t("supplier").select("s_suppkey"), F.col("s_suppkey") == F.col("l_suppkey"), "left").join(t("part").select("p_partkey"), F.col("p_partkey") == F.col("l_partkey"), "left")
    checks = {"order": F.col("o_orderkey").isNull(), "supplier": F.col("s_suppkey").isNull(), "part": F.col("p_partkey").isNull(), "date": F.coalesce(F.col("l_shipdate") < F.col("o_orderdate"), F.lit(False)), "discount": F.col("l_discount") > 0.09}
    bad = M.gate(j, checks).where("NOT approved")
    return bad.groupBy("l_orderkey", "l_linenumber", F.array_join("failures", ",").alias("violations")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "record_mismatches",
    "SELECT o_orderkey FROM orders WHERE o_orderkey % 11 = 0 AND o_orderstatus <> 'F'",
)
def record_mismatches(t: Tables) -> DataFrame:
    o = t("orders")
    other = o.select("o_orderkey", F.struct(F.when(F.col("o_orderkey") % 11 == 0, "F").otherwise(F.col("o_orderstatus")).alias("s"), F.col("o_custkey").alias("c")).alias("b"))
    both = o.select("o_orderkey", F.struct(F.col("o_orderstatus").alias("s"), F.col("o_custkey").alias("c")).alias("a")).join(other, "o_orderkey")
    return both.where(~F.col("a").eqNullSafe(F.col("b"))).select("o_orderkey")


@query("safe_paths", r"SELECT page_id, regexp_matches(p, '^[^/\\\s][^\\]*$') AND NOT regexp_matches(p, '(^|/)\.{1,2}(/|$)|//|\s$') AND NOT regexp_matches(p, '^[A-Za-z]:') AS safe FROM (SELECT page_id, CASE WHEN page_id % 3 = 0 THEN regexp_replace(url, '^https?://', '') WHEN page_id % 3 = 1 THEN 'a/../' || page_id ELSE url END AS p FROM pages)")
def safe_paths(t: Tables) -> DataFrame:
    i = F.col("page_id") % 3
    p = F.when(i == 0, F.regexp_replace("url", "^https?://", "")).when(i == 1, F.concat(F.lit("a/../"), F.col("page_id").cast("string"))).otherwise(F.col("url"))
    return t("pages").select("page_id", canon.safe_path(p).alias("safe"))


_INDEX = "i AS (SELECT l_partkey::VARCHAR AS name, l_orderkey AS version, md5(l_returnflag || l_linestatus) AS sha256, l_linenumber AS archive FROM lineitem)"


def _index(t: Tables) -> DataFrame:
    return t("lineitem").select(F.col("l_partkey").cast("string").alias("name"), F.col("l_orderkey").alias("version"), F.md5(F.concat("l_returnflag", "l_linestatus")).alias("sha256"), F.col("l_linenumber").alias("archive"))


@query("latest_versions", f"WITH {_INDEX} SELECT name, max(version) AS version FROM i GROUP BY name")
def latest_versions(t: Tables) -> DataFrame:
    return S.latest_versions(_index(t)).select("name", "version")


@query("keep_newest", f"WITH {_INDEX}, d AS (SELECT DISTINCT name, version FROM i) SELECT name, version, rn AS rank FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY version DESC) AS rn FROM d) WHERE rn <= 2")
def keep_newest(t: Tables) -> DataFrame:
    return S.keep_newest(_index(t).select("name", "version").distinct(), ["name"], [F.col("version").desc()])


@query("to_back_up", f"WITH {_INDEX}, c AS (SELECT DISTINCT name, md5(name) AS sha256 FROM i UNION SELECT DISTINCT name, sha256 FROM i) SELECT name, sha256 FROM c ANTI JOIN (SELECT DISTINCT name, sha256 FROM i) USING (name, sha256)")
def to_back_up(t: Tables) -> DataFrame:
    index = _index(t)
    now = index.select("name", F.md5("name").alias("sha256")).union(index.select("name", "sha256")).distinct()
    return S.to_back_up(now, index)


@query("file_manifest", "SELECT page_id::VARCHAR AS name, sha256(html) AS sha256, strlen(html) AS bytes FROM pages")
def file_manifest(t: Tables) -> DataFrame:
    return S.manifest_of(t("pages").select(F.col("page_id").cast("string").alias("member"), F.col("html").cast("binary").alias("content")))


@query("routed_lines", "SELECT event_type AS route, count(*) AS lines, count(DISTINCT props) AS payloads FROM (SELECT CASE event_type WHEN 'view' THEN 'LAB_METRIC' WHEN 'click' THEN 'LAB_BATCH' WHEN 'error' THEN 'LAB_PHASE' ELSE 'other' END AS event_type, CASE WHEN event_type IN ('signup', 'purchase') THEN event_type || ' ' || props ELSE props END AS props FROM events) GROUP BY 1")
def routed_lines(t: Tables) -> DataFrame:
    tag = F.when(F.col("event_type") == "view", "LAB_METRIC").when(F.col("event_type") == "click", "LAB_BATCH").when(F.col("event_type") == "error", "LAB_PHASE").otherwise(F.col("event_type"))
    lines = ST.routed(t("events").select(F.concat_ws(" ", tag, "props").alias("value")))
    return lines.groupBy("route").agg(F.count(F.lit(1)).alias("lines"), F.count_distinct("payload").alias("payloads"))


@query("daily_events", "SELECT date_trunc('day', ts) AS day, event_type, count(*) AS n, sum(CAST(round(value * 100) AS BIGINT))::BIGINT AS cents FROM events GROUP BY 1, 2")
def daily_events(t: Tables) -> DataFrame:
    out = ST.daily(t("events").withColumn("ts", F.col("ts").cast("timestamp")))
    return out.withColumn("day", F.col("day").cast("timestamp_ntz"))


@query(
    "user_sessions",
    """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
    s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS id FROM g) SELECT user_id, min(ts) AS began, count(*) AS n FROM s GROUP BY user_id, id""",
)
def user_sessions(t: Tables) -> DataFrame:
    out = ST.sessions(t("events").withColumn("ts", F.col("ts").cast("timestamp")))
    return out.withColumn("began", F.col("began").cast("timestamp_ntz"))


@query("snapshot_schedule", f"WITH {FACTS} SELECT turn + 1 AS step, count(*) FILTER (turn = 0 OR (turn + 1) % 100 = 0 OR k * 4 >= 300) AS due, count(*) FILTER (((turn + 1) * 8) % 16 = 0) AS remapped FROM f GROUP BY turn")
def snapshot_schedule(t: Tables) -> DataFrame:
    step = F.col("turn") + 1
    due = ST.snapshot_due(step, F.col("k") * 4, F.lit(False))
    return facts(t).groupBy(step.alias("step")).agg(M.n(due).alias("due"), F.count(ST.remapped_offset(step, F.lit(8), F.lit(16))).alias("remapped"))


@query("eta", f"WITH {FACTS} SELECT episode, turn, CASE WHEN turn = 0 THEN NULL ELSE k::DOUBLE * (100 - turn) / turn END AS eta FROM f")
def eta(t: Tables) -> DataFrame:
    return facts(t).select("episode", "turn", ST.eta_seconds(F.col("turn"), F.lit(0), F.lit(100), F.col("k").cast("double")).alias("eta"))
