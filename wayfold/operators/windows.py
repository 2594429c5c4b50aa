"""Context windows: rows at offsets from a root, in the same life and without a gap between."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfold.operators.ranking import first_rows
from wayfold.operators.trajectory import with_runs


def offset_windows(roots: DataFrame, rows: DataFrame, offsets: Sequence[int], carry: Sequence[str] = ()) -> DataFrame:
    """episode, root_turn, offset, turn and the carried columns of rows.

    Offsets are exploded and joined by (episode, turn): an equi-join, never a range join. A row
    counts if it is of the root's run, so neither a life nor a gap lies between.
    """
    marked = with_runs(rows).select("episode", "turn", "life", "run", *carry)
    at = marked.select("episode", F.col("turn").alias("root_turn"), F.col("life").alias("_life"), F.col("run").alias("_run"))
    asked = roots.select("episode", F.col("turn").alias("root_turn")).join(at, ["episode", "root_turn"])
    asked = asked.withColumn("offset", F.explode(F.array(*[F.lit(o) for o in offsets]))).withColumn("turn", F.col("root_turn") + F.col("offset"))
    met = asked.join(marked, ["episode", "turn"]).where("life = _life AND run = _run")
    return met.select("episode", "root_turn", F.col("offset").cast("long").alias("offset"), "turn", *carry)


def capped_windows(windows: DataFrame, per_root: int, *order: Column) -> DataFrame:
    """At most per_root windows of each root."""
    return first_rows(windows, ["episode", "root_turn"], [*order, F.col("offset")], per_root)


def lookback_roots(rows: DataFrame, fatal: Column, offsets: Sequence[int]) -> DataFrame:
    """Distinct (episode, turn) at the fatal rows and at offsets before them in the same run."""
    roots = rows.where(fatal).select("episode", "turn")
    return offset_windows(roots, rows, [0, *[-abs(o) for o in offsets]]).select("episode", "turn").distinct()
