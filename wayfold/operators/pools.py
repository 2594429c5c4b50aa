"""Leak-free pools: conflicts, quarantine, disjointness, set equality."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def conflicts(df: DataFrame, key: str, *attributes: str) -> DataFrame:
    """Keys with more than one value of some attribute: key, n_<a> and <a>_values of each."""
    aggs = []
    for a in attributes:
        aggs += [F.count_distinct(a).alias(f"n_{a}"), F.concat_ws(",", F.sort_array(F.collect_set(a))).alias(f"{a}_values")]
    found = df.groupBy(key).agg(*aggs)
    bad = None
    for a in attributes:
        bad = (F.col(f"n_{a}") > 1) if bad is None else bad | (F.col(f"n_{a}") > 1)
    return found.where(bad)


def quarantine(df: DataFrame, key: str, *attributes: str) -> DataFrame:
    """df without all rows of keys in conflict."""
    return df.join(conflicts(df, key, *attributes).select(key), key, "left_anti")


def exclude(df: DataFrame, used: DataFrame, key: Sequence[str]) -> DataFrame:
    """Rows whose key is not among the used ones."""
    return df.join(used.select(*key).distinct(), list(key), "left_anti")


def overlap(a: DataFrame, b: DataFrame, key: Sequence[str]) -> DataFrame:
    """Keys of a that b has too; must be empty for disjoint sets."""
    return a.select(*key).distinct().join(b.select(*key).distinct(), list(key), "left_semi")


def set_differences(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows, with multiplicity, that only one side has: side, and the columns; empty if the sets are equal."""
    return a.exceptAll(b).withColumn("side", F.lit("left")).unionByName(b.exceptAll(a).withColumn("side", F.lit("right")))


def undeclared(done: DataFrame, declared: DataFrame, key: Sequence[str]) -> DataFrame:
    """Completed jobs that nobody declared; must be empty."""
    return done.join(declared, list(key), "left_anti")
