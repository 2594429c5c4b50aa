"""Keep-best, caps, spreads, round robins and seeded draws: all row numbers over a key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayfold.sources.shared import cut


def first_rows(df: DataFrame, key: Sequence[str], order: Sequence[Column], n: int = 1) -> DataFrame:
    """The first n rows of each key in order (which must end in a unique column)."""
    rank = F.row_number().over(Window.partitionBy(*key).orderBy(*order))
    return df.withColumn("_rank", rank).where(F.col("_rank") <= n).drop("_rank")


def keep_best(df: DataFrame, key: Sequence[str], *priority: Column) -> DataFrame:
    """One row per key: the one of the highest priority."""
    return first_rows(df, key, priority)


def with_ties(df: DataFrame, key: Sequence[str], *order: Column) -> DataFrame:
    """All rows of each key that are as good as its best."""
    return df.withColumn("_rank", F.rank().over(Window.partitionBy(*key).orderBy(*order))).where("_rank = 1").drop("_rank")


def best_by_rank(df: DataFrame, key: Sequence[str], pick: str, *rank: Column) -> DataFrame:
    """key and the pick with the lexicographically smallest rank; ties go to the smaller pick."""
    return df.groupBy(*key).agg(F.min(F.struct(*[r.alias(f"r{i}") for i, r in enumerate(rank)], F.col(pick).alias("pick")))["pick"].alias(pick))


def spread(df: DataFrame, key: Sequence[str], order: Sequence[Column], slots: int) -> DataFrame:
    """Evenly spaced rows of each key: those at floor(j * n / slots), j = 0 .. slots - 1."""
    w = Window.partitionBy(*key)
    df = df.withColumn("_n", F.count(F.lit(1)).over(w)).withColumn("_i", F.row_number().over(w.orderBy(*order)) - 1)
    taken = F.exists(F.sequence(F.lit(0), F.lit(slots - 1)), lambda j: F.floor(j * F.col("_n") / slots) == F.col("_i"))
    return df.where(taken).drop("_n", "_i")


def round_robin(df: DataFrame, bucket: Sequence[str], order: Sequence[Column], limit: int | None = None) -> DataFrame:
    """Rows in turns of one per bucket: place counts them from 1; at most limit are kept.

    With a limit only the first limit turns of a bucket take part in one top-k; without, all rows are
    placed by ranges of (turn in the bucket, bucket).
    """
    df = df.withColumn("_turn", F.row_number().over(Window.partitionBy(*bucket).orderBy(*order)))
    if limit is not None:
        df = df.where(F.col("_turn") <= limit).orderBy("_turn", *bucket).limit(limit)
        return df.withColumn("place", F.row_number().over(Window.orderBy("_turn", *bucket)).cast("long")).drop("_turn")  # limit rows
    return placed(df, "place", "_turn", *bucket).drop("_turn")


def placed(df: DataFrame, name: str, *order: str) -> DataFrame:
    """df with each row's place from 1 in the order of all rows, which must tell rows apart; no task holds more than a range of them."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    # the number holds the partition and the row in it; cut, so that both uses see the same ranges
    ranged = cut(ranged.withColumn("_at", F.monotonically_increasing_id())).withColumn("_part", F.shiftright("_at", 33))
    per = ranged.groupBy("_part").agg(F.count(F.lit(1)).alias("_c"))  # a row a partition
    before = F.coalesce(F.sum("_c").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    per = F.broadcast(per.select("_part", before.alias("_before")))
    return ranged.join(per, "_part").withColumn(name, F.col("_before") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)) + 1).drop("_at", "_part", "_before")


def seeded(seed: str, *ids: str) -> Column:
    """A reproducible shuffle key."""
    return F.md5(F.concat_ws(":", F.lit(seed), *[F.col(i).cast("string") for i in ids]))


def draw(df: DataFrame, n: int, seed: str, *ids: str) -> DataFrame:
    """n rows without replacement, the same for the same seed."""
    return df.orderBy(seeded(seed, *ids), *ids).limit(n)


def two_level(df: DataFrame, first: Column, key: Sequence[str], order: Sequence[Column], n_first: int, n_second: int) -> DataFrame:
    """Of each key up to n_first rows of the first class and n_second of the other, each in order."""
    df = df.withColumn("_first", F.coalesce(first, F.lit(False)))
    rank = F.row_number().over(Window.partitionBy(*key, "_first").orderBy(*order))
    return df.withColumn("_rank", rank).where(F.col("_rank") <= F.when(F.col("_first"), n_first).otherwise(n_second)).drop("_rank", "_first")
