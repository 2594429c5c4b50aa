"""Folds of trajectories to episodes, gates over episodes, and roll-ups over overlapping cohorts.

Rates with denominator 0 are null, never 0. A row counts once in every cohort it has; totals
are aggregated on their own and never summed from cohorts.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfold.operators.trajectory import with_cycles, with_dry_spells, with_lives, with_streaks


def analysed(df: DataFrame) -> DataFrame:
    """Rows with life, dry spell, cycle period and loop streak."""
    return with_streaks(with_cycles(with_dry_spells(with_lives(df))), F.col("period").isNotNull())


def n(flag: Column) -> Column:
    return F.count_if(F.coalesce(flag, F.lit(False)))


def rate(part: Column, whole: Column) -> Column:
    return F.try_divide(part.cast("double"), whole.cast("double"))


def episode_summary(rows: DataFrame) -> DataFrame:
    """One row per episode of analysed rows."""
    progress = F.col("progress")
    return rows.groupBy("episode").agg(
        F.count(F.lit(1)).alias("decisions"),
        F.sum("frames").alias("frames"),
        n(F.col("lost")).alias("life_losses"),
        n(progress).alias("progress_events"),
        n(progress & (F.col("life") == 0)).alias("first_life_progress"),
        n(progress & (F.col("life") > 0)).alias("post_respawn_progress"),
        F.max("dry").alias("longest_dry"),
        F.max("dry_frames").alias("longest_dry_frames"),
        F.count("period").alias("loop_decisions"),
        F.max("streak").alias("longest_loop_streak"),
        rate(n(progress) * 1000, F.sum("frames")).alias("progress_per_1000_frames"),
        rate(F.count("period"), F.count(F.lit(1))).alias("loop_share"),
    )


def per_life(rows: DataFrame) -> DataFrame:
    """One row per episode and life."""
    return rows.groupBy("episode", "life").agg(F.count(F.lit(1)).alias("decisions"), n(F.col("progress")).alias("progress_events"), (n(F.col("lost")) > 0).alias("life_lost"))


def loop_periods(rows: DataFrame) -> DataFrame:
    """Histogram of cycle periods per episode."""
    return rows.where("period IS NOT NULL").groupBy("episode", "period").agg(F.count(F.lit(1)).alias("rows"))


def as_map(df: DataFrame, key: Sequence[str], name: str, *values: str) -> DataFrame:
    """key and a map from name to the value (or a struct of values)."""
    value = F.col(values[0]) if len(values) == 1 else F.struct(*values)
    return df.groupBy(*key).agg(F.map_from_entries(F.collect_list(F.struct(F.col(name).cast("string"), value))).alias("by_" + name))


def suite_means(episodes: DataFrame, measures: Sequence[str], cleared: Column, capped: Column) -> DataFrame:
    return episodes.agg(F.count(F.lit(1)).alias("episodes"), n(cleared).alias("cleared"), n(capped).alias("capped"), *[F.avg(m).alias(f"mean_{m}") for m in measures])


def gate(episodes: DataFrame, gates: Mapping[str, Column]) -> DataFrame:
    """failures: names of the gates that an episode fails, in the order given; approved if none."""
    failed = F.filter(F.array(*[F.when(F.coalesce(c, F.lit(True)), F.lit(name)) for name, c in gates.items()]), lambda x: x.isNotNull())
    return episodes.withColumn("failures", failed).withColumn("approved", F.size(failed) == 0)


def qualify(gated: DataFrame, group: str, declared: Sequence[int], min_rate: float, max_losses: int) -> DataFrame:
    """One row: approved and the reasons against a suite of gated episodes.

    Every declared group must be there, clear at min_rate at least, and all together lose max_losses lives at most.
    """
    per = gated.groupBy(group).agg(rate(n(F.col("approved")), F.count(F.lit(1))).alias("clear_rate"))
    wanted = gated.sparkSession.createDataFrame([(g,) for g in declared], f"{group} long")
    met = wanted.join(per, group, "left").agg(
        n(F.col("clear_rate").isNull()).alias("missing_groups"),
        n(F.col("clear_rate") < min_rate).alias("low_groups"),
    )
    total = gated.agg(F.sum("life_losses").alias("life_losses"), F.sum(F.size("failures")).cast("long").alias("failed_gates"))
    out = met.join(total)  # two one-row results
    reasons = F.concat_ws(",", F.when(F.col("missing_groups") > 0, "incomplete"), F.when(F.col("low_groups") > 0, "clear_rate"), F.when(F.col("life_losses") > max_losses, "life_losses"))
    return out.withColumn("failures", reasons).withColumn("approved", reasons == "")


def by_cohort(rows: DataFrame, cohorts: str, aggs: Mapping[str, Column]) -> DataFrame:
    """Aggregates per cohort of an array column; a row counts in each of its cohorts."""
    return rows.withColumn("cohort", F.explode(cohorts)).groupBy("cohort").agg(*[a.alias(k) for k, a in aggs.items()])


def over_dimension(dimension: DataFrame, facts: DataFrame, key: Sequence[str], counts: Sequence[str]) -> DataFrame:
    """facts for all members of dimension: counts are 0 where there are none, all else is null."""
    out = dimension.join(facts, list(key), "left")
    return out.withColumns({c: F.coalesce(c, F.lit(0)) for c in counts})


def flag_coverage(rows: DataFrame, key: Sequence[str], flags: str) -> DataFrame:
    """Rows per key and true flag of a map column."""
    named = rows.select(*key, F.explode(F.map_filter(flags, lambda k, v: F.coalesce(v, F.lit(False)))).alias("flag", "_v"))
    return named.groupBy(*key, "flag").agg(F.count(F.lit(1)).alias("rows"))


def shortages(have: DataFrame, floors: Mapping[str, int], key: str, count: str) -> DataFrame:
    """Floors that are not met: key, have, floor, missing. Nothing is filled in from elsewhere."""
    wanted = have.sparkSession.createDataFrame(list(floors.items()), f"{key} string, floor long")
    out = wanted.join(have.select(key, F.col(count).cast("long").alias("have")), key, "left").withColumn("have", F.coalesce("have", F.lit(0)))
    return out.withColumn("missing", F.col("floor") - F.col("have")).where("missing > 0")


def token_budget(lengths: DataFrame, column: str, limit: int) -> DataFrame:
    return lengths.agg(F.count(F.lit(1)).alias("records"), F.max(column).alias("longest"), n(F.col(column) > limit).alias("over_limit"))


def ordered_digest(files: DataFrame, name: str, digest: str) -> DataFrame:
    """One sha256 over (name, digest) pairs in the order of names. For manifests, which are small."""
    pairs = F.array_sort(F.collect_list(F.struct(name, digest)))
    return files.agg(F.sha2(F.concat_ws("", F.transform(pairs, lambda p: F.concat(p[name], F.lit(":"), p[digest], F.lit("\n")))), 256).alias("digest"))


def mix_scale(available: DataFrame, needed: str, have: str) -> DataFrame:
    """scale = min(1, smallest available / needed) and the floors of all targets at that scale."""
    scale = available.agg(F.least(F.lit(1.0), F.min(rate(F.col(have), F.col(needed)))).alias("scale"))
    return available.join(scale).withColumn("target", F.floor(F.col(needed) * F.col("scale")))  # scale is one row


def finite(*columns: str) -> Column:
    ok = None
    for c in columns:
        here = F.coalesce(~F.isnan(c) & (F.abs(F.col(c)) < float("inf")), F.lit(False))
        ok = here if ok is None else ok & here
    return ok


def padded_batches(rows: DataFrame, order: str, length: str, size: int) -> DataFrame:
    """Batches of size rows in order: rows, longest, and tokens when padded to the longest."""
    b = rows.withColumn("batch", F.expr(f"{order} div {size}"))
    return b.groupBy("batch").agg(F.count(F.lit(1)).alias("rows"), F.max(length).alias("longest"), (F.count(F.lit(1)) * F.max(length)).alias("padded"))
