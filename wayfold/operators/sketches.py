"""Bitmaps and Bloom filters as aggregates: exact distinct counts that merge, and a sieve before an exact anti-join."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits of a bitmap (a bucket of ids, or a block of a filter).
BITS = 32_768


def bitmaps(rows: DataFrame, groups: Sequence[str], id_: str) -> DataFrame:
    """groups, bucket, bits: the ids of each group, 4 KB for up to 32768 dense ids. Null ids are left out."""
    known = rows.where(F.col(id_).isNotNull()).select(*groups, F.bitmap_bucket_number(id_).alias("bucket"), F.bitmap_bit_position(id_).alias("_p"))
    return known.groupBy(*groups, "bucket").agg(F.bitmap_construct_agg("_p").alias("bits"))


def distinct(table: DataFrame, groups: Sequence[str], out: str = "ids") -> DataFrame:
    """The number of different ids of any grouping coarser than that of a bitmaps() table, exact: bitmaps are united, not counts added."""
    whole = table.groupBy(*groups, "bucket").agg(F.bitmap_or_agg("bits").alias("bits"))
    return whole.groupBy(*groups).agg(F.sum(F.bitmap_count("bits")).alias(out))


def common(table: DataFrame, group: str, a: str, b: str) -> DataFrame:
    """One row: ids that are in a, in b, and in both (by inclusion and exclusion of united bitmaps)."""
    named = table.where(F.col(group).isin(a, b))
    of = lambda name: distinct(named.where(F.col(group) == name).select(F.lit(name).alias("set"), "bucket", "bits"), ["set"])
    either = distinct(named.select(F.lit("either").alias("set"), "bucket", "bits"), ["set"])
    found = of(a).union(of(b)).union(either)
    n = lambda name: F.coalesce(F.sum(F.when(F.col("set") == name, F.col("ids"))), F.lit(0))
    return found.agg(n(a).alias("left_ids"), n(b).alias("right_ids"), (n(a) + n(b) - n("either")).alias("both_ids"))


#: Bits of a filter per key, bits that a key sets, and the largest filter that goes to all tasks.
PER_KEY, SET, LARGEST = 12, 6, 64 << 20


def _places(key: Sequence[str], blocks: int) -> tuple[Column, list[Column]]:
    """The block of a key and the bits that it sets there."""
    h = [F.xxhash64(*[F.col(k) for k in key], F.lit(i)) for i in range(SET + 1)]
    return F.pmod(h[0], F.lit(blocks)), [F.pmod(x, F.lit(BITS)) for x in h[1:]]


def bloom(keys: DataFrame, key: Sequence[str], blocks: int) -> DataFrame:
    """block, bits: a filter in blocks, made by map-side combined aggregates; a row a block, so its size is blocks x 4 KB."""
    block, places = _places(key, blocks)
    return keys.select(block.alias("block"), F.explode(F.array(*places)).alias("_p")).groupBy("block").agg(F.bitmap_construct_agg("_p").alias("bits"))


def _bit(bits: Column, place: Column) -> Column:
    byte = F.conv(F.hex(F.substring(bits, (F.shiftright(place, 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    return byte.bitwiseAND(F.pow(F.lit(2), place % 8).cast("int")) != 0


def sieved(df: DataFrame, used: DataFrame, key: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(rows that are surely not among the used keys, rows that may be). Each row of df is in one of both."""
    keys = used.select(*key).distinct()
    n = keys.count()
    blocks = max(1, -(-n * PER_KEY // BITS))
    if blocks * BITS // 8 > LARGEST:
        return df.limit(0), df
    block, places = _places(key, blocks)
    met = df.withColumn("_block", block).join(F.broadcast(bloom(keys, key, blocks).withColumnRenamed("block", "_block")), "_block", "left")
    maybe = F.col("bits").isNotNull()
    for p in places:
        maybe = maybe & _bit(F.col("bits"), p)
    met = met.withColumn("_maybe", F.coalesce(maybe, F.lit(False))).drop("bits", "_block")
    return met.where(~F.col("_maybe")).drop("_maybe"), met.where("_maybe").drop("_maybe")


def exclude(df: DataFrame, used: DataFrame, key: Sequence[str]) -> DataFrame:
    """Rows whose key is not used, as pools.exclude: only those that the filter lets through are shuffled to the exact anti-join."""
    sure, maybe = sieved(df, used, key)
    return sure.select(*df.columns).unionByName(maybe.select(*df.columns).join(used.select(*key).distinct(), list(key), "left_anti").select(*df.columns))
