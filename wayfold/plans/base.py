"""Registration of queries, and the decision log that the driver's event table stands for."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfold.operators.metrics import analysed
from wayfold.operators.trajectory import numbered, with_lives

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


class Tables:
    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder

    def __call__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")


def query(name: str, sql: str | None = None):
    """Registers f(tables) as query name, with its oracle."""

    def wrap(f: Callable[[Tables], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql is not None:
            SQL[name] = sql
        return f

    return wrap


#: Rows of the event log that a task takes: its windows hold them once each, widened by the columns derived from them.
TASK_ROWS = 100_000


def dealt(events: DataFrame, key: str, rows: int = TASK_ROWS) -> DataFrame:
    """events dealt out by key to as many tasks as their number asks for, which windows by key keep.

    Left to itself Spark joins up partitions by their size before the derived columns, so tasks grow with the table.
    """
    parts = -(-events.count() // rows)
    return events.repartition(max(parts, events.sparkSession.sparkContext.defaultParallelism), key) if parts > 1 else events


def facts(t: Tables) -> DataFrame:
    """episode, turn, pos, lost, progress, frames, props: users are episodes, errors lost lives, purchases progress."""
    rows = numbered(dealt(t("events"), "user_id"), "user_id", "ts", "event_id")
    kind = F.col("event_type")
    return rows.select("episode", "turn", "event_id", kind.alias("pos"), (kind == "error").alias("lost"), (kind == "purchase").alias("progress"), F.round(F.col("value") * 100).cast("long").alias("frames"), F.get_json_object("props", "$.k").cast("long").alias("k"), "props")


def lived(t: Tables) -> DataFrame:
    return with_lives(facts(t))


def walked(t: Tables) -> DataFrame:
    return analysed(facts(t))


#: Common table expressions: f facts, l with life, d with dry spells, a with cycles and streaks.
FACTS = """f AS (
  SELECT user_id AS episode, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS turn, event_id, event_type AS pos,
         event_type = 'error' AS lost, event_type = 'purchase' AS progress, CAST(round(value * 100) AS BIGINT) AS frames,
         CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, props
  FROM events)"""
LIVES = FACTS + """,
l AS (SELECT *, coalesce(sum(lost::INT) OVER (PARTITION BY episode ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS life FROM f)"""
DRY = LIVES + """,
l1 AS (SELECT *, (sum(progress::INT) OVER (PARTITION BY episode, life ORDER BY turn))::BIGINT AS spell FROM l),
d AS (SELECT *, CASE WHEN progress THEN 0 ELSE count(*) OVER w END AS dry, (CASE WHEN progress THEN 0 ELSE sum(frames) OVER w END)::BIGINT AS dry_frames
      FROM l1 WINDOW w AS (PARTITION BY episode, life, spell, progress ORDER BY turn))"""
WALK = DRY + """,
d1 AS (SELECT *, list(pos) OVER (PARTITION BY episode, life, spell, progress ORDER BY turn ROWS BETWEEN 127 PRECEDING AND CURRENT ROW) AS h FROM d),
d2 AS (SELECT * EXCLUDE (h), CASE WHEN NOT progress AND len(h) >= 4 THEN list_filter(range(2, least(64, len(h) // 2) + 1),
         lambda p: h[len(h) - p + 1:len(h)] = h[len(h) - 2 * p + 1:len(h) - p] AND len(list_distinct(h[len(h) - p + 1:len(h)])) >= 2)[1] END AS period FROM d1),
d3 AS (SELECT *, period IS NOT NULL AS loop, sum((period IS NULL)::INT) OVER (PARTITION BY episode ORDER BY turn) AS off FROM d2),
a AS (SELECT * EXCLUDE (loop, off), CASE WHEN loop THEN count(*) OVER (PARTITION BY episode, off, loop ORDER BY turn) ELSE 0 END AS streak FROM d3)"""
