"""Closeness on grids, bitmaps and filters, VARIANT documents, table functions, and selections with their chosen rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wayfold.functions import variants
from wayfold.functions import flags as G
from wayfold.operators import decisions as D
from wayfold.operators import graph, harvest, selection, sketches
from wayfold.operators import metrics as M
from wayfold.plans import pool_queries as P
from wayfold.plans.base import FACTS, LIVES, SQL, Tables, facts, lived, query
from wayfold.plans.decision_log import DECISIONS, log
from wayfold.plans.rollups import split_of

_DEPTH = 9


@query(
    "grid_closeness",
    f"""WITH RECURSIVE c AS (SELECT p_partkey::INT // 28 AS r, p_partkey::INT % 28 AS c FROM part WHERE p_type <> 'ECONOMY'),
    s AS (SELECT r * 28 + c AS src, unnest([r * 28 + c + 28, r * 28 + c - 28, r * 28 + (c + 1) % 28, r * 28 + (c + 27) % 28]) AS dst FROM c),
    e AS (SELECT src, dst FROM s WHERE dst IN (SELECT r * 28 + c FROM c)),
    b AS (SELECT r * 28 + c AS src, r * 28 + c AS dst, 0 AS d FROM c UNION SELECT b.src, e.dst, b.d + 1 FROM b JOIN e ON e.src = b.dst WHERE b.d < {_DEPTH}),
    m AS (SELECT src, dst, min(d) AS d FROM b GROUP BY 1, 2)
    SELECT dst AS node, count(*) AS reached, sum(d)::BIGINT AS total, max(d)::INTEGER AS farthest FROM m GROUP BY 1""",
)
def grid_closeness(t: Tables) -> DataFrame:
    """Of every cell of the part grid (one type of parts are walls): the cells within nine steps, the sum of their distances and the largest; from all cells at once."""
    cells = t("part").where("p_type <> 'ECONOMY'").select(F.expr("cast(p_partkey div 28 as int)").alias("row"), F.expr("cast(p_partkey % 28 as int)").alias("column"))
    return graph.closeness(graph.grid_edges(cells, 1 << 30, 28), cells.select((F.col("row") * 28 + F.col("column")).alias("src")), _DEPTH)


_COHORTS = {"lost": "lost", "near": "k < 20", "progress": "progress"}
_SPLIT = "CASE WHEN substr(md5(CAST(episode AS VARCHAR)), 1, 1) IN ('0', '1', '2', '3') THEN 'development' ELSE 'train' END"


@query(
    "cohort_episodes",
    f"""WITH {FACTS}, c AS (SELECT {_SPLIT} AS split, k AS id, unnest(list_filter([{', '.join(f"CASE WHEN {e} THEN '{n}' END" for n, e in _COHORTS.items())}], lambda n: n IS NOT NULL)) AS cohort FROM f)
    SELECT 'split and cohort' AS grouping_kind, split || '/' || cohort AS grp, count(DISTINCT id) AS ids FROM c GROUP BY split, cohort
    UNION ALL SELECT 'cohort', cohort, count(DISTINCT id) FROM c GROUP BY cohort UNION ALL SELECT 'split', split, count(DISTINCT id) FROM c GROUP BY split UNION ALL SELECT 'all', 'all', count(DISTINCT id) FROM c""",
)
def cohort_episodes(t: Tables) -> DataFrame:
    """Different keys per split and cohort, and of every union of them, from one table of bitmaps."""
    names = G.true_names(G.flag_map({n: F.expr(e) for n, e in _COHORTS.items()}))
    rows = facts(t).select(split_of(F.col("episode")).alias("split"), F.col("k").alias("id"), F.explode(names).alias("cohort"))
    table = sketches.bitmaps(rows, ["split", "cohort"], "id").withColumn("all", F.lit("all"))
    parts = []
    for kind, by in (("split and cohort", ["split", "cohort"]), ("cohort", ["cohort"]), ("split", ["split"]), ("all", ["all"])):
        parts.append(sketches.distinct(table, by).select(F.lit(kind).alias("grouping_kind"), F.concat_ws("/", *by).alias("grp"), "ids"))
    return parts[0].union(parts[1]).union(parts[2]).union(parts[3])


@query("sieved_unused", SQL["exclude_used"])
def sieved_unused(t: Tables) -> DataFrame:
    """exclude_used behind a Bloom filter: only rows that it lets through meet the used keys."""
    rows = P.pool(t)
    return sketches.exclude(rows.where("split = 'train'").select("event_id", "digest"), rows.where("split = 'development'"), ["digest"])


_ODD, _EVEN = """{"z": %s, "a": {"list": [1, "x", 2.50], "none": null}, "k" :  true}""", """{"k":%s,"deep":{"b":{"c":[{"d":1.05e1},{"d":"t"}]}},"empty":{}}"""
_DOC_SQL = """SELECT event_id, CASE WHEN event_id % 2 = 1 THEN '{"a":{"list":[1,"x",2.5],"none":null},"k":true,"z":' || k || '}' ELSE '{"deep":{"b":{"c":[{"d":10.5},{"d":"t"}]}},"empty":{},"k":' || k || '}' END AS text FROM f"""


def _documents(t: Tables) -> DataFrame:
    """A document of each event, of two shapes and with blanks, orders and number forms of their own."""
    doc = F.when(F.col("event_id") % 2 == 1, F.format_string(_ODD, "k")).otherwise(F.format_string(_EVEN, "k"))
    return facts(t).select("event_id", doc.alias("js"))


@query("variant_fingerprints", f"WITH {FACTS}, v AS ({_DOC_SQL}) SELECT event_id, sha256(text) AS digest, CASE WHEN event_id % 2 = 0 THEN json_extract_string(text, '$.k')::BIGINT END AS k FROM v")
def variant_fingerprints(t: Tables) -> DataFrame:
    rows = _documents(t)
    return rows.select("event_id", variants.fingerprint(F.col("js")).alias("digest"), F.when(F.col("event_id") % 2 == 0, variants.read(F.col("js"), "$.k", "long")).alias("k"))


_FIELDS = {1: ["$.a.list[]|BIGINT", "$.a.list[]|STRING", "$.a.list[]|DECIMAL(2,1)", "$.a.none|VOID", "$.k|BOOLEAN", "$.z|BIGINT"], 0: ["$.deep.b.c[].d|DOUBLE", "$.deep.b.c[].d|STRING", "$.empty|OBJECT<>", "$.k|BIGINT"]}


@query("variant_fields", f"WITH {FACTS}, p AS (SELECT unnest(CASE WHEN event_id % 2 = 1 THEN {_FIELDS[1]} ELSE {_FIELDS[0]} END) AS x FROM f) SELECT split_part(x, '|', 1) AS path, split_part(x, '|', 2) AS kind, count(*) AS rows FROM p GROUP BY 1, 2")
def variant_fields(t: Tables) -> DataFrame:
    """Which fields occur in the documents, with what kinds of values, and how often."""
    return variants.leaves(_documents(t), "event_id", "js", 5).groupBy("path", "kind").agg(F.count(F.lit(1)).alias("rows"))


@query("harvested_windows", SQL["offset_windows"])
def harvested_windows(t: Tables) -> DataFrame:
    """offset_windows by a table function that reads each episode once."""
    from wayfold.plans.trajectories import OFFSETS

    rows = lived(t).where("k <> 5").select("episode", "turn", "life", F.col("progress").alias("root"))
    return harvest.windows(rows, OFFSETS)


@query("perturbed_prefixes")
def perturbed_prefixes(t: Tables) -> DataFrame:
    """Two forks of each episode within its first 24 rows; the draw is a generator's, so a test holds it against a plain loop."""
    return harvest.perturbed(log(t).select("episode", "turn", "choice", "legal"), 2, 24, "forks")


def _unique(t: Tables) -> DataFrame:
    return selection.one_per_digest(P._cover_input(t), "cover").withColumn("flags", F.map_filter("flags", lambda k, v: k == "near"))


def mix_budgets(rows: DataFrame) -> tuple[dict, dict]:
    of = lambda c, *o: M.n((F.col("class") == c) & F.col("origin").isin(*o))
    n = rows.agg(F.least(of("click", "train"), of("click", "development"), of("view", "train", "development")).alias("least"), M.n((F.col("class") == "click") & G.flag(F.col("flags"), "near")).alias("near")).first()
    floor = n["near"] // 40
    return {"click": 3 * (n["least"] // 10), "view": n["least"] // 10}, {"near": floor} if floor else {}


@query("mix_selection")
def mix_selection(t: Tables) -> DataFrame:
    """The rows that the quota selection takes, in the order in which it takes them."""
    rows = _unique(t)
    budgets, floors = mix_budgets(rows)
    chosen = selection.select_mix(rows, budgets, ("train", "development", 0.6), floors, 6, "quota")
    return t.spark.createDataFrame([(i, k) for k, i in enumerate(chosen, 1)], "id string, place long")


def cover_floors(rows: DataFrame) -> tuple[int, dict]:
    n = rows.agg(F.count(F.lit(1)).alias("all"), *[M.n(G.flag(F.col("flags"), k)).alias(k) for k in P.FLAGS]).first()
    return n["all"] // 30, {k: n[k] // 60 for k in P.FLAGS if n[k] // 60}


@query("cover_selection")
def cover_selection(t: Tables) -> DataFrame:
    """The rows of the greedy cover, in the order in which it takes them."""
    rows = P._cover_input(t)
    count, floors = cover_floors(selection.one_per_digest(rows, "cover"))
    return t.spark.createDataFrame([(i, k) for k, i in enumerate(selection.balanced(rows, count, floors, "cover"), 1)], "id string, place long")


_USED = "md5(concat_ws('|', row_::VARCHAR, column_::VARCHAR, dry::VARCHAR, pellets_before::VARCHAR))"


@query(
    "collected_states",
    f"""WITH {DECISIONS}, s AS (SELECT *, {_USED} AS state FROM dl), used AS (SELECT DISTINCT state FROM s WHERE turn < 12), c AS (SELECT * FROM s ANTI JOIN used USING (state) WHERE turn >= 12 AND turn % 4 = 0 AND n_legal >= 2),
    r AS (SELECT *, row_number() OVER (PARTITION BY state ORDER BY episode, turn) AS rn FROM c) SELECT episode, turn, state FROM r WHERE rn = 1""",
)
def collected_states(t: Tables) -> DataFrame:
    """The collection rule: from turn 12, every fourth turn, two moves at least, and a state that was not seen before, neither among those used nor earlier."""
    state = F.md5(F.concat_ws("|", *[F.col(c).cast("string") for c in ("row", "column", "dry", "pellets_before")]))
    rows = log(t).select("episode", "turn", "legal", state.alias("state"))
    open_ = sketches.exclude(rows.where(G.collectable(F.col("turn"), F.col("legal"))).select("episode", "turn", "state"), rows.where("turn < 12"), ["state"])
    return open_.groupBy("state").agg(F.min(F.struct("episode", "turn")).alias("f")).select("f.episode", "f.turn", "state")


@query(
    "qualified_rows",
    f"""WITH {DECISIONS}, q AS (SELECT episode FROM dl GROUP BY episode HAVING count(*) FILTER (lost) <= 14 AND count(*) FILTER (choice_fatal AND some_safe) <= 11) SELECT episode, turn FROM dl SEMI JOIN q USING (episode)""",
)
def qualified_rows(t: Tables) -> DataFrame:
    """Rows of episodes whose controller qualifies: fourteen lives lost at most and eleven avoidable fatal choices."""
    lost = F.coalesce(F.col("outcome") == "life_lost", F.lit(False))
    by = Window.partitionBy("episode")
    rows = log(t).select("episode", "turn", M.n(lost).over(by).alias("_l"), M.n(D.fatal(F.col("choice")) & D.some_safe()).over(by).alias("_a"))
    return rows.where("_l <= 14 AND _a <= 11").select("episode", "turn")


@query(
    "proofs_by_position",
    f"""WITH {LIVES}, s AS (SELECT *, row_number() OVER (PARTITION BY episode, life ORDER BY turn) - 1 AS i FROM l), p AS (SELECT episode, row_number() OVER (PARTITION BY episode ORDER BY turn) - 1 AS i, k AS proof FROM l WHERE progress)
    SELECT s.episode, life, turn, i AS suffix_index, proof, coalesce(k = proof, false) AS matches FROM s LEFT JOIN p USING (episode, i)""",
)
def proofs_by_position(t: Tables) -> DataFrame:
    """Candidates of each life against the episode's proofs by their place in both lists."""
    at = lambda by: (F.row_number().over(Window.partitionBy(*by).orderBy("turn")) - 1).cast("long")
    rows = lived(t)
    candidates = rows.select("episode", "life", "turn", "k", at(["episode", "life"]).alias("suffix_index"))
    proofs = rows.where("progress").select("episode", at(["episode"]).alias("suffix_index"), F.col("k").alias("proof"))
    return candidates.join(proofs, ["episode", "suffix_index"], "left").select("episode", "life", "turn", "suffix_index", "proof", F.coalesce(F.col("k") == F.col("proof"), F.lit(False)).alias("matches"))


@query(
    "informative_parents",
    f"""WITH {FACTS}, w AS (SELECT event_id, episode, turn, event_id - event_id % 7 AS parent FROM f WHERE NOT lost AND NOT progress), p AS (SELECT event_id, episode, progress, lost FROM f)
    SELECT w.event_id, w.parent, CASE WHEN p.event_id IS NULL THEN 'missing' WHEN NOT p.lost AND NOT p.progress THEN 'not accepted' WHEN NOT p.lost THEN 'not hard' WHEN p.episode <> w.episode THEN 'other episode' END AS problem
    FROM w LEFT JOIN p ON p.event_id = w.parent WHERE NOT coalesce(p.lost AND p.episode = w.episode, false)""",
)
def informative_parents(t: Tables) -> DataFrame:
    """Informative rows whose parent is missing, not accepted, not hard or of another episode."""
    rows = facts(t)
    parents = rows.select(F.col("event_id").alias("parent"), F.col("episode").alias("_e"), F.col("progress").alias("_p"), F.col("lost").alias("_l"))
    met = rows.where("NOT lost AND NOT progress").select("event_id", "episode", (F.col("event_id") - F.col("event_id") % 7).alias("parent")).join(parents, "parent", "left")
    why = F.when(F.col("_e").isNull(), "missing").when(~F.col("_l") & ~F.col("_p"), "not accepted").when(~F.col("_l"), "not hard").when(F.col("_e") != F.col("episode"), "other episode")
    return met.select("event_id", "parent", why.alias("problem")).where("problem IS NOT NULL")
