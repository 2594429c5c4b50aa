"""JSON documents whose keys differ by row, as VARIANT: canonical text, fingerprints, typed reads, and the fields that occur."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def parsed(js: Column) -> Column:
    """The document, null where it does not parse."""
    return F.try_parse_json(js)


def canonical(js: Column) -> Column:
    """The document without blanks, object keys in order at all depths, numbers in their shortest form."""
    return F.to_json(parsed(js))


def fingerprint(js: Column) -> Column:
    """SHA-256 of the canonical text: equal documents have equal fingerprints however they are spelt."""
    return F.sha2(canonical(js), 256)


def read(js: Column, path: str, kind: str) -> Column:
    """What stands at a path as kind, null where it is missing or is no such value."""
    return F.try_variant_get(parsed(js), path, kind)


def schema(df: DataFrame, js: str) -> str:
    """The one schema that all documents fit, as a DDL text; a map-side combined aggregate."""
    return df.agg(F.schema_of_variant_agg(parsed(F.col(js)))).first()[0]


def leaves(df: DataFrame, key: str, js: str, depth: int = 8) -> DataFrame:
    """key, path, kind, value of every scalar in the documents (empty objects and arrays too), down to depth levels.

    Each level explodes what is still an object or an array; places in arrays are [] in the path, so a path
    names a field and not a row. What is nested deeper than depth is one value, its text.
    """
    spark = df.sparkSession
    level = df.select(F.col(key), parsed(F.col(js)).alias("v"), F.lit("$").alias("path")).where("v IS NOT NULL")
    kind = lambda v: F.schema_of_variant(v)
    nested = lambda v: kind(v).rlike("^(OBJECT<[^>]|ARRAY<(?!VOID>))")
    out = None
    for _ in range(depth):
        done = level.where(~nested(F.col("v"))).select(key, "path", kind(F.col("v")).alias("kind"), F.to_json("v").alias("value"))
        out = done if out is None else out.unionByName(done)
        more = spark.sql(f"SELECT d.`{key}`, d.path, e.key AS _k, e.value AS v FROM {{df}} AS d, LATERAL variant_explode(d.v) AS e", df=level.where(nested(F.col("v"))))
        level = more.select(key, "v", F.concat("path", F.when(F.col("_k").isNull(), "[]").otherwise(F.concat(F.lit("."), F.col("_k")))).alias("path"))
    return out.unionByName(level.select(key, "path", kind(F.col("v")).alias("kind"), F.to_json("v").alias("value")))
