"""Pieces that several text operators share: checkpoints, distributed ranks, words in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wayfold.sources.shared import cut, shared_dir, stored

__all__ = ["WORD", "cut", "fresh", "let", "running_total", "shared_dir", "source_key", "stored", "table", "words"]

#: A word is a run of bytes other than space, \t, \n, \v, \f and \r.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def source_key(source: Column) -> Column:
    """A non-null key that sorts by code point with null last."""
    return F.when(source.isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), source))


def fresh(df: DataFrame, *names: str) -> tuple[str, ...]:
    """The names, each with underscores before it until df has no such column (case does not count)."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        out.append(name)
    return tuple(out)


def words(text: Column) -> Column:
    """array<string> of the words of a text; null has none."""
    spaced = F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x09-\x0D]", " ")
    return F.array_remove(F.split(spaced, " "), "")


def let(value: Column, body) -> Column:
    """body(value) with value computed once, however often body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def running_total(df: DataFrame, part: list[str], bucket: str, order: list[Column], weight: Column | None, out: str) -> DataFrame:
    """Sum of weight (or number of rows) before each row within part, without one task for a part.

    bucket is a column of df that is monotone in order; each (part, bucket) is summed
    inside its own window, and what earlier buckets hold is added from their totals.
    """
    w = F.lit(1).cast("long") if weight is None else weight.cast("long")
    totals = df.groupBy(*part, bucket).agg(F.sum(w).alias("_n"))
    before = Window.partitionBy(*part) if part else Window.partitionBy(F.lit(0))
    before = before.orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(*part, bucket, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    inside = Window.partitionBy(*part, bucket).orderBy(*order)
    own = F.row_number().over(inside).cast("long") - 1 if weight is None else F.sum(w).over(inside.rowsBetween(Window.unboundedPreceding, 0)) - w
    return df.join(totals, [*part, bucket]).withColumn(out, F.col("_base") + own).drop("_base")
