"""Sequence operators over one trajectory.

Input rows have episode and turn; further columns by need: lost and progress (boolean),
frames (long), pos (orderable). Everything is a window partitioned by episode (or finer),
so one exchange on episode serves all of them and the aggregates that follow.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F


def episode() -> WindowSpec:
    return Window.partitionBy("episode").orderBy("turn")


def past() -> WindowSpec:
    return episode().rowsBetween(Window.unboundedPreceding, -1)


def so_far() -> WindowSpec:
    return episode().rowsBetween(Window.unboundedPreceding, 0)


def numbered(events: DataFrame, key: str, *order: str) -> DataFrame:
    """episode and turn (from 0) of a log ordered by order within key."""
    turn = F.row_number().over(Window.partitionBy(key).orderBy(*order)) - 1
    return events.withColumn("turn", turn.cast("long")).withColumnRenamed(key, "episode")


def with_lives(df: DataFrame) -> DataFrame:
    """life: number of lost rows before this one."""
    return df.withColumn("life", F.coalesce(F.sum(F.col("lost").cast("long")).over(past()), F.lit(0).cast("long")))


def with_dry_spells(df: DataFrame) -> DataFrame:
    """dry and dry_frames: rows and frames since the last progress in this life, this row included; 0 on progress rows.

    A progress row ends a spell and is no part of the next; a new life starts anew.
    """
    in_life = Window.partitionBy("episode", "life").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    spell = Window.partitionBy("episode", "life", "spell", "progress").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    df = df.withColumn("spell", F.sum(F.col("progress").cast("long")).over(in_life))
    dry = F.when(F.col("progress"), 0)
    return df.withColumn("dry", dry.otherwise(F.count(F.lit(1)).over(spell)).cast("long")).withColumn("dry_frames", dry.otherwise(F.sum("frames").over(spell)).cast("long"))


def with_cycles(df: DataFrame, max_period: int = 64, history: int = 128) -> DataFrame:
    """period: the smallest p >= 2 with the last p positions of the spell equal to the p before, on two places or more; else null."""
    spell = Window.partitionBy("episode", "life", "spell", "progress").orderBy("turn").rowsBetween(1 - history, 0)
    df = df.withColumn("_h", F.when(~F.col("progress"), F.collect_list("pos").over(spell)))
    n = F.size("_h")

    def repeats(p: Column) -> Column:
        last = F.slice("_h", n - p + 1, p)
        return (last == F.slice("_h", n - 2 * p + 1, p)) & (F.size(F.array_distinct(last)) >= 2)

    periods = F.filter(F.sequence(F.lit(2), F.least(F.lit(max_period), F.expr("size(_h) div 2"))), repeats)
    return df.withColumn("period", F.when(n >= 4, F.try_element_at(periods, F.lit(1))).cast("long")).drop("_h")


def with_streaks(df: DataFrame, flag: Column) -> DataFrame:
    """streak: consecutive rows of the episode, up to this one, on which flag holds."""
    on = F.coalesce(flag, F.lit(False))
    df = df.withColumn("_on", on).withColumn("_off", F.sum((~on).cast("long")).over(so_far()))
    run = Window.partitionBy("episode", "_off", "_on").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("streak", F.when(F.col("_on"), F.count(F.lit(1)).over(run)).otherwise(0).cast("long")).drop("_on", "_off")


def until(df: DataFrame, hit: Column) -> DataFrame:
    """Rows up to and including the first on which hit holds."""
    return df.withColumn("_hits", F.coalesce(F.sum(hit.cast("long")).over(past()), F.lit(0))).where("_hits = 0").drop("_hits")


def capped(df: DataFrame, max_frames: int, max_dry: int) -> DataFrame:
    """A run cut where its frames reach max_frames or a dry spell reaches max_dry rows."""
    df = df.withColumn("_sum", F.sum("frames").over(so_far()))
    return until(df, (F.col("_sum") >= max_frames) | (F.col("dry") >= max_dry)).drop("_sum")


def with_history(df: DataFrame, length: int = 64) -> DataFrame:
    """recent: the last length positions, this one included."""
    return df.withColumn("recent", F.collect_list("pos").over(episode().rowsBetween(1 - length, 0)))


def with_repeats(df: DataFrame, within: int = 12) -> DataFrame:
    """seen_recently: the position is among the last within before it; visits: times it was taken so far, now included."""
    before = F.collect_list("pos").over(episode().rowsBetween(-within, -1))
    visits = F.count(F.lit(1)).over(Window.partitionBy("episode", "pos").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumn("seen_recently", F.array_contains(before, F.col("pos"))).withColumn("visits", visits)


def with_runs(df: DataFrame, limit: int = 24) -> DataFrame:
    """run and run_place: stretches of one life without a gap in turn; ahead: rows of the stretch from here on, at most limit."""
    order = Window.partitionBy("episode", "life").orderBy("turn")
    df = df.withColumn("run", F.col("turn") - F.row_number().over(order))
    part = Window.partitionBy("episode", "life", "run")
    place = F.row_number().over(part.orderBy("turn")).cast("long")
    return df.withColumn("run_place", place).withColumn("ahead", F.least(F.count(F.lit(1)).over(part) - place + 1, F.lit(limit)).cast("long"))


def with_next(df: DataFrame, *columns: str) -> DataFrame:
    """next_<c> of the next row, null where that is of another life or missing."""
    after = Window.partitionBy("episode", "life").orderBy("turn")
    for c in columns:
        df = df.withColumn(f"next_{c}", F.when(F.lead("turn").over(after) == F.col("turn") + 1, F.lead(c).over(after)))
    return df


def gap_grows(now: Column, then: Column) -> Column:
    """All keys of map now are in map then, with a larger value: every pursuer fell back."""
    return F.forall(F.map_entries(now), lambda e: F.coalesce(F.try_element_at(then, e["key"]) > e["value"], F.lit(False))) & (F.cardinality(now) > 0)


def with_next_progress(df: DataFrame, limit: int = 24) -> DataFrame:
    """progress_in: rows until the next progress of the episode, if within limit."""
    ahead = episode().rowsBetween(1, limit)
    return df.withColumn("progress_in", F.min(F.when(F.col("progress"), F.col("turn"))).over(ahead) - F.col("turn"))


def with_prefix(df: DataFrame, column: str, out: str) -> DataFrame:
    """out: the values of column on all rows before this one, in order."""
    return df.withColumn(out, F.collect_list(column).over(past()))


def differences(df: DataFrame, step: str, columns: Sequence[str], reset: int) -> DataFrame:
    """Per-step values of accumulators that start anew after every reset steps."""
    by = Window.partitionBy("episode", F.expr(f"({step} - 1) div {reset}")).orderBy(step)
    for c in columns:
        df = df.withColumn(f"{c}_step", F.col(c) - F.coalesce(F.lag(c).over(by), F.lit(0)))
    return df


def after_terminal(df: DataFrame, terminal: Column) -> DataFrame:
    """Violations: terminal rows that another row follows."""
    return df.withColumn("_next", F.lead("turn").over(episode())).where(terminal & F.col("_next").isNotNull()).drop("_next")


def broken_chain(df: DataFrame, state: str, next_state: str) -> DataFrame:
    """Violations: rows whose turn or state does not follow from the row before."""
    gap = F.col("turn") != F.lag("turn").over(episode()) + 1
    differs = ~F.col(state).eqNullSafe(F.lag(next_state).over(episode())) & F.lag("turn").over(episode()).isNotNull()
    first = F.lag("turn").over(episode()).isNull() & (F.col("turn") != 0)
    return df.withColumn("_bad", F.coalesce(gap, F.lit(False)) | differs | first).where("_bad").drop("_bad")
