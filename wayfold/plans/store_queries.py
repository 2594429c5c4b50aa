"""Queries over what is written and read again: traces, streamed folds, backups, Merkle trees; and prefixes of episodes."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfold.operators import merkle, prefixes
from wayfold.operators import metrics as M
from wayfold.operators import trajectory as T
from wayfold.plans import decision_queries, trajectories  # noqa: F401  their SQL is shared
from wayfold.plans.base import FACTS, QUERIES, SQL, Tables, facts, lived, query
from wayfold.plans.decision_log import log
from wayfold.sources.shared import cut, shared_dir
from wayfold.sources.traces import TraceSource
from wayfold.streaming import backup, episodes


def _folder(t: Tables, name: str) -> str:
    return f"{shared_dir(t.spark)}/{name}-{uuid.uuid4().hex}"


def _traces(t: Tables, path: str, *parts: DataFrame) -> str:
    """A trace of some jobs, each with a receipt of its own."""
    t.spark.dataSource.register(TraceSource)
    for part in parts:
        part.write.format("traces").mode("append").save(path)
    return path


TRACE = "episode long, turn long, pos string, lost boolean, progress boolean, frames long, k long"


@query(
    "trace_receipts",
    f"""WITH {FACTS} SELECT episode, count(*) AS rows, count(*) FILTER (lost) AS lost, sum(frames)::BIGINT AS frames, count(DISTINCT pos) AS places, max(turn) AS last_turn,
    (SELECT count(*) FROM f WHERE k < 40) AS first_receipt FROM f GROUP BY episode""",
)
def trace_receipts(t: Tables) -> DataFrame:
    """The event log as a trace of two jobs, read again: what the receipts name is all rows, each once."""
    rows = facts(t).select(*[c.split()[0] for c in TRACE.split(", ")])
    path = _traces(t, _folder(t, "trace"), rows.where("k < 40"), rows.where("NOT coalesce(k < 40, false)"))
    from wayfold.sources.traces import _receipts

    first = _receipts(path)[0][1]["rows"]
    back = t.spark.read.format("traces").schema(TRACE).load(path)
    return back.groupBy("episode").agg(F.count(F.lit(1)).alias("rows"), M.n(F.col("lost")).alias("lost"), F.sum("frames").alias("frames"), F.count_distinct("pos").alias("places"), F.max("turn").alias("last_turn"), F.lit(first).cast("long").alias("first_receipt"))


_OBSERVED = "episode turn level seed heading choice legal risks pellets_before pellets_after row column next_row next_column action_frames outcome score_after http_ms normal_pellets power_pellets ghosts_eaten fruit_eaten".split()


def streamed_folds(t: Tables, jobs: int = 3) -> DataFrame:
    """The last running fold of each episode of the log, written as a trace whose jobs cut across episodes, and folded as a stream."""
    rows = cut(log(t).select(*_OBSERVED))
    # every job holds turns of all episodes out of their order: what comes early waits
    path = _traces(t, _folder(t, "decisions"), *[rows.where(F.pmod(F.col("turn"), F.lit(jobs)) == k) for k in reversed(range(jobs))])
    stream = t.spark.readStream.format("traces").schema(rows.schema).load(path)
    sink, ckpt = _folder(t, "folds"), _folder(t, "ckpt")

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{sink}/batch={number}")

    q = episodes.fold_stream(stream).writeStream.foreachBatch(keep).outputMode("update").option("checkpointLocation", ckpt).trigger(availableNow=True).start()
    q.awaitTermination()
    return episodes.latest(t.spark.read.schema(episodes.FOLD).option("recursiveFileLookup", True).parquet(sink))


@query("streamed_measures", SQL["decision_summary"])
def streamed_measures(t: Tables) -> DataFrame:
    """All measures of an episode by the stateful fold, equal to those of the batch."""
    ended = F.when(F.col("pellets_remaining") == 0, "level_cleared").when(F.col("decisions") >= 70, "decision_cap").when(F.col("last_lost"), "life_lost").otherwise("trace_end")
    out = episodes.measures(streamed_folds(t), ended)
    lives = F.transform(F.array_sort(F.map_entries("per_life")), lambda e: F.concat_ws("/", F.concat_ws(":", e["key"], e["value"]["decisions"]), e["value"]["pellets_collected"].cast("string"), e["value"]["life_lost"].cast("string")))
    periods = F.transform(F.array_sort(F.map_entries("loop_periods")), lambda e: F.concat_ws(":", e["key"], e["value"]))
    out = out.withColumns({"per_life": F.array_join(lives, ","), "loop_periods": F.array_join(periods, ",")})
    return out.select(*QUERIES["decision_summary"](t.spark, t.folder).columns)


def _versions(t: Tables) -> list[DataFrame]:
    """Three states of a set of files: customers, then every fifth changed, then some new names."""
    c = t("customer")
    name = F.concat(F.lit("c/"), F.col("c_custkey"))
    one = c.select(name.alias("name"), F.col("c_mktsegment").cast("binary").alias("content"))
    two = c.select(name.alias("name"), F.when(F.col("c_custkey") % 5 == 0, F.col("c_name")).otherwise(F.col("c_mktsegment")).cast("binary").alias("content"))
    three = t("supplier").select(F.concat(F.lit("s/"), F.col("s_suppkey")).alias("name"), F.col("s_name").cast("binary").alias("content"))
    return [one, two, three]


@query(
    "restored_files",
    """SELECT 'c/' || c_custkey AS name, sha256(CASE WHEN c_custkey % 5 = 0 THEN c_name ELSE c_mktsegment END) AS sha256, CASE WHEN c_custkey % 5 = 0 THEN 1 ELSE 0 END::BIGINT AS version,
    CASE WHEN c_custkey % 5 = 0 THEN c_name ELSE c_mktsegment END AS content FROM customer UNION ALL SELECT 's/' || s_suppkey, sha256(s_name), 2::BIGINT, s_name FROM supplier""",
)
def restored_files(t: Tables) -> DataFrame:
    """Three backups, each run twice as after a crash; the newest content of every file, and the version that brought it."""
    base = _folder(t, "backup")
    for batch, files in enumerate(_versions(t)):
        for _ in range(2):
            backup.back_up(files, base, "files", batch)
    return backup.restore(t.spark, base).select("name", "sha256", "version", F.col("content").cast("string").alias("content"))


_ROW = ("l_linenumber", "l_orderkey", "l_partkey", "l_returnflag", "l_suppkey")
_WIDTH = 64


def _lines(t: Tables) -> DataFrame:
    """Line items as texts, with the key as a number."""
    return t("lineitem").select(F.col("l_orderkey").cast("long").alias("key"), *[F.col(c).cast("string").alias(c) for c in _ROW])


def _levels() -> str:
    text = "||','||".join(f"""'"{c}":"' || {c} || '"'""" for c in _ROW)
    out = f"""h AS (SELECT l_orderkey AS key, l_orderkey // {_WIDTH} AS node, sha256('{{"key":' || l_orderkey || ',' || {text} || '}}') AS digest FROM lineitem),
    n0 AS (SELECT node, row_number() OVER (PARTITION BY node ORDER BY key, digest) - 1 AS slot, 1 AS rows, digest FROM h),
    n1 AS (SELECT node, slot // {merkle.FAN} AS slot, sum(rows) AS rows, sha256(string_agg(slot || ':' || digest, chr(10) ORDER BY slot)) AS digest FROM n0 GROUP BY 1, 2),
    l0 AS (SELECT node, sum(rows) AS rows, sha256(string_agg(slot || ':' || digest, chr(10) ORDER BY slot)) AS digest FROM n1 GROUP BY 1)"""
    for level in range(1, merkle.HEIGHT + 1):
        out += f""",\n    l{level} AS (SELECT node // {merkle.FAN} AS node, sum(rows) AS rows, sha256(string_agg(node || ':' || digest, chr(10) ORDER BY node)) AS digest FROM l{level - 1} GROUP BY 1)"""
    return out


@query("table_tree", f"WITH {_levels()} " + " UNION ALL ".join(f"SELECT {i}::INTEGER AS level, node::BIGINT AS node, rows::BIGINT AS rows, digest FROM l{i}" for i in range(merkle.HEIGHT + 1)))
def table_tree(t: Tables) -> DataFrame:
    """The Merkle tree of all line items."""
    return merkle.tree(_lines(t), "key", _WIDTH)


_EDIT = "l_partkey % 487 = 3"


@query(
    "changed_ranges",
    f"""WITH e AS (SELECT DISTINCT l_orderkey // {_WIDTH} AS leaf FROM lineitem WHERE {_EDIT} OR l_orderkey // {_WIDTH} % 50 = 7), r AS (SELECT DISTINCT l_orderkey // {_WIDTH} AS leaf FROM lineitem WHERE l_orderkey // {_WIDTH} % 50 <> 7)
    SELECT leaf::BIGINT AS leaf, (leaf * {_WIDTH})::BIGINT AS lo, (leaf * {_WIDTH} + {_WIDTH - 1})::BIGINT AS hi, CASE WHEN leaf IN (SELECT leaf FROM r) THEN 'both' ELSE 'left' END AS side FROM e""",
)
def changed_ranges(t: Tables) -> DataFrame:
    """The ranges in which an edited copy of the line items (rows changed, whole ranges gone) differs from them."""
    rows = _lines(t)
    edited = rows.where(F.pmod(F.expr(f"key div {_WIDTH}"), F.lit(50)) != 7).withColumn("l_returnflag", F.when(F.expr(_EDIT), "x").otherwise(F.col("l_returnflag")))
    return merkle.changed(cut(merkle.tree(rows, "key", _WIDTH)), cut(merkle.tree(edited, "key", _WIDTH)), _WIDTH)


@query(
    "shared_prefixes",
    f"""WITH {FACTS}, p AS (SELECT episode, turn + 1 AS n, string_agg(pos, '|') OVER (PARTITION BY episode ORDER BY turn) AS prefix FROM f),
    s AS (SELECT n, prefix FROM p GROUP BY 1, 2 HAVING count(*) > 1), m AS (SELECT episode, max(n) AS shared FROM p JOIN s USING (n, prefix) GROUP BY 1)
    SELECT episode, coalesce(shared, 0)::BIGINT AS shared FROM (SELECT DISTINCT episode FROM f) LEFT JOIN m USING (episode)""",
)
def shared_prefixes(t: Tables) -> DataFrame:
    """The longest beginning that each episode has in common with another."""
    return prefixes.shared_prefixes(facts(t), "pos")


@query(
    "repeated_slices",
    f"""WITH {FACTS}, p AS (SELECT episode, turn, string_agg(pos, '|') OVER (PARTITION BY episode ORDER BY turn ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS slice FROM f),
    q AS (SELECT *, min(turn) OVER (PARTITION BY episode, slice) AS first_turn FROM p WHERE turn >= 3) SELECT episode, turn, first_turn FROM q WHERE first_turn < turn""",
)
def repeated_slices(t: Tables) -> DataFrame:
    """Rows that end four positions which the episode has had before."""
    return prefixes.repeated_slices(facts(t), "pos", 4)


@query("cycle_periods", SQL["cycle_rows"])
def cycle_periods(t: Tables) -> DataFrame:
    """cycle_rows by sums over prefixes instead of slices."""
    rows = prefixes.with_periods(T.with_dry_spells(lived(t)))
    return T.with_streaks(rows, F.col("period").isNotNull()).where("period IS NOT NULL").select(*QUERIES["cycle_rows"](t.spark, t.folder).columns)
