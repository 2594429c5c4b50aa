"""Sharding by proportional stratified interleaving.

Rows are shuffled by a seeded digest and ranked within their source. A row of rank r
in a source of n rows stands at (r + u) / n, where u in [0, 1) belongs to the source
(so that many one-row sources don't all stand at one place). Sorting by that fraction
interleaves the sources in proportion, and equal cuts of the order give shards that
match the mixture and whose row counts differ by one at most (law `rows`).

No step sorts everything in one task: ranks and positions are sums of bucket totals
plus a window inside the bucket (see common.running_total). Digest buckets are even by
construction, and the fractions of all sources together are uniform.

Edge cases: a null text has size 1 and the crc32 of no bytes; a null source is a source
of its own; repeated rows are placed one by one (their order among themselves is of no
account); an empty table gives an empty result; columns of the input other than doc_id,
text and source are ignored by assign() and carried by shard_table().
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wayfold.llm.common import cut, running_total, source_key, table

SEED = "shard-1"
#: Buckets of a source's shuffled order and of the interleaved order.
SHUFFLE_BUCKETS = 4096
ORDER_BUCKETS = 16384


def _unit(digest: Column) -> Column:
    """First 32 bits of a hex digest, as a double in [0, 1)."""
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(float(2**32))


def place(rows: DataFrame, shards: int, seed: str = SEED) -> DataFrame:
    """Adds shard and slot to rows that have _id (string), _src (non-null string) and _tie (any orderable)."""
    rows = rows.withColumn("_h", F.md5(F.concat(F.lit(f"{seed}:"), "_id")))
    rows = rows.withColumn("_b", F.conv(F.substring("_h", 1, 3), 16, 10).cast("int") * F.lit(SHUFFLE_BUCKETS // 4096))
    ranked = running_total(rows, ["_src"], "_b", [F.col("_h"), F.col("_id"), F.col("_tie")], None, "_rank")
    n = rows.groupBy("_src").agg(F.count(F.lit(1)).alias("_n"))
    at = (F.col("_rank") + _unit(F.md5(F.concat(F.lit(f"{seed}:"), "_src")))) / F.col("_n")
    placed = ranked.join(n, "_src").withColumn("_at", at).withColumn("_ob", F.floor(F.col("_at") * ORDER_BUCKETS).cast("int"))
    total = placed.groupBy("_ob").agg(F.count(F.lit(1)).alias("_c"))
    # at most ORDER_BUCKETS rows, whatever the input
    base = total.select(
        "_ob",
        F.coalesce(F.sum("_c").over(Window.partitionBy(F.lit(0)).orderBy("_ob").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_base"),
        F.sum("_c").over(Window.partitionBy(F.lit(0))).alias("_all"),
    )
    own = F.row_number().over(Window.partitionBy("_ob").orderBy("_at", "_src", "_h", "_id", "_tie")) - 1
    placed = placed.join(base, "_ob").withColumn("_pos", F.col("_base") + own)
    placed = placed.withColumn("shard", F.expr(f"_pos * {shards} div _all").cast("int"))
    placed = placed.withColumn("slot", F.expr(f"_pos - (shard * _all + {shards - 1}) div {shards}").cast("long"))
    return placed.drop("_h", "_b", "_rank", "_n", "_at", "_ob", "_base", "_all", "_pos")


def assign(docs: DataFrame, shards: int = 8, seed: str = SEED) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for every row of docs."""
    rows = docs.select(
        "doc_id",
        F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("_bytes"),
        F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("_tie"),
        F.coalesce(F.col("doc_id").cast("string"), F.lit("null")).alias("_id"),
        source_key(F.col("source")).alias("_src"),
    )
    return place(cut(rows), shards, seed).select(
        "doc_id",
        (F.col("_bytes") + 1).alias("size"),
        F.col("_tie").alias("text_crc32"),
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def _keys(docs: DataFrame) -> list[Column]:
    return [
        F.coalesce(F.col("doc_id").cast("string"), F.lit("null")).alias("_id"),
        source_key(F.col("source")).alias("_src"),
        F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("_tie"),
    ]


def shard_table(docs: DataFrame, shards: int = 8, seed: str = SEED) -> DataFrame:
    """All columns of docs plus shard and slot (existing columns of those names are replaced).

    Places are found on narrow rows; the texts move once, to meet them. The k-th of some
    equal rows takes the k-th of their places.
    """
    kept = docs.drop("shard", "slot")
    key = ["_id", "_src", "_tie"]
    places = place(cut(kept.select(*_keys(kept))), shards, seed).groupBy(*key).agg(F.sort_array(F.collect_list(F.struct("shard", "slot"))).alias("_places"))
    nth = F.row_number().over(Window.partitionBy(*key).orderBy(F.lit(0)))
    rows = kept.select(F.struct(*[F.col(f"`{c}`") for c in kept.columns]).alias("_row"), *_keys(kept)).withColumn("_nth", nth)
    at = F.element_at("_places", F.col("_nth"))
    return rows.join(places, key).select("_row.*", at["shard"].alias("shard"), at["slot"].alias("slot"))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign(table(spark, sf_dir, "documents"))


#: crc32 of the UTF-8 bytes of a text, through a table of the 256 remainders of one byte.
_CRC = """
  xor(4294967295, list_reduce(
    list_prepend(4294967295::BIGINT, [('0x' || substr(hx, 2 * i + 1, 2))::BIGINT for i in range(len(hx) // 2)]),
    lambda c, b: xor(c >> 8, crc_table[(xor(c, b) & 255) + 1])))
"""

SQL = {
    "op7_sharding": f"""
WITH crc_row AS (
  SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n::BIGINT, [0::BIGINT for i in range(8)]),
    lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS crc_table),
d AS (
  SELECT doc_id, coalesce(strlen(text), 0) + 1 AS size, {_CRC} AS crc,
         CASE WHEN source IS NULL THEN '1' ELSE '0' || source END AS src,
         md5('{SEED}:' || coalesce(doc_id::VARCHAR, 'null')) AS h
  FROM (SELECT *, hex(encode(coalesce(text, ''))) AS hx FROM documents), crc_row),
r AS (
  SELECT *, row_number() OVER (PARTITION BY src ORDER BY h, doc_id::VARCHAR, crc) - 1 AS rk, count(*) OVER (PARTITION BY src) AS n FROM d),
f AS (
  SELECT *, (rk + ('0x' || substr(md5('{SEED}:' || src), 1, 8))::BIGINT / 4294967296.0::DOUBLE) / n AS place FROM r),
p AS (
  SELECT *, row_number() OVER (ORDER BY place, src, h, doc_id::VARCHAR, crc) - 1 AS pos, count(*) OVER () AS total FROM f),
s AS (SELECT *, pos * 8 // total AS sh FROM p)
SELECT doc_id, size::BIGINT AS size, crc::BIGINT AS text_crc32, 'rows' AS law, sh::INTEGER AS shard,
       (pos - (sh * total + 7) // 8)::BIGINT AS slot, NULL::INTEGER AS grown_shard FROM s
"""
}
