"""Paired comparisons of runs, of branches and of logged sequences."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def unpaired(before: DataFrame, after: DataFrame, key: Sequence[str]) -> DataFrame:
    """Keys that only one side has, with that side; must be empty for a fair comparison."""
    a = before.select(*key).distinct().withColumn("_a", F.lit(1))
    b = after.select(*key).distinct().withColumn("_b", F.lit(1))
    both = a.join(b, list(key), "full_outer").where("_a IS NULL OR _b IS NULL")
    return both.select(*key, F.when(F.col("_a").isNull(), "after").otherwise("before").alias("only_in"))


def paired(before: DataFrame, after: DataFrame, key: Sequence[str], measures: Sequence[str], strict: bool = True) -> DataFrame:
    """before, after and after - before of all measures per key; an error if keys differ and strict."""
    if strict and not unpaired(before, after, key).isEmpty():
        raise ValueError("the compared runs do not cover the same keys")
    a = before.select(*key, *[F.col(m).alias(f"{m}_before") for m in measures])
    b = after.select(*key, *[F.col(m).alias(f"{m}_after") for m in measures])
    out = a.join(b, list(key))
    return out.withColumns({f"{m}_change": F.col(f"{m}_after") - F.col(f"{m}_before") for m in measures})


def first_difference(expected: DataFrame, actual: DataFrame, key: str, index: str, state: str) -> DataFrame:
    """key and the first index at which two logged sequences differ or one has ended; no row for equal ones."""
    a = expected.select(key, index, F.struct(state).alias("_a"))
    b = actual.select(key, index, F.struct(state).alias("_b"))
    differs = a.join(b, [key, index], "full_outer").where(~F.col("_a").eqNullSafe(F.col("_b")))
    return differs.groupBy(key).agg(F.min(index).alias("first_difference"))


def recomputed_differs(stored: DataFrame, recomputed: DataFrame, key: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Rows whose stored values are not the recomputed ones, with the names of those that differ."""
    a = stored.select(*key, *[F.col(c).alias(f"_s_{c}") for c in columns], F.lit(1).alias("_s"))
    b = recomputed.select(*key, *[F.col(c).alias(f"_r_{c}") for c in columns], F.lit(1).alias("_r"))
    both = a.join(b, list(key), "full_outer")
    wrong = [F.when(~F.col(f"_s_{c}").eqNullSafe(F.col(f"_r_{c}")), F.lit(c)) for c in columns]
    missing = F.when(F.col("_s").isNull(), "not stored").when(F.col("_r").isNull(), "not recomputed")
    return both.withColumn("differs", F.concat_ws(",", missing, *wrong)).where("differs <> ''").select(*key, "differs")


def rebased(rows: DataFrame, roots: DataFrame, carried: Sequence[str]) -> DataFrame:
    """The rows from each root on, with turn and the carried counters counted from the root."""
    at = roots.select("episode", F.col("turn").alias("root_turn"), *[F.col(c).alias(f"_{c}") for c in carried])
    out = rows.join(at, "episode").where("turn >= root_turn").withColumn("suffix_turn", F.col("turn") - F.col("root_turn"))
    for c in carried:
        out = out.withColumn(c, F.col(c) - F.col(f"_{c}")).drop(f"_{c}")
    return out
