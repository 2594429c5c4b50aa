"""Data contracts as violation tables: check, key, detail; no rows mean that the contract holds."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def violations(parts: Sequence[tuple[str, DataFrame, Column | str, Column | str]]) -> DataFrame:
    """The union of named checks, each a table of offending rows with a key and a detail."""
    out = None
    for name, df, key, detail in parts:
        k, d = (F.col(c) if isinstance(c, str) else c for c in (key, detail))
        part = df.select(F.lit(name).alias("check"), k.cast("string").alias("key"), d.cast("string").alias("detail"))
        out = part if out is None else out.unionByName(part)
    return out


def row_checks(rows: DataFrame, key: str, checks: Mapping[str, Column]) -> DataFrame:
    """One row per row and failed check, in one pass; a check that is null fails."""
    names = F.filter(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(n)) for n, ok in checks.items()]), lambda x: x.isNotNull())
    return rows.select(F.explode(names).alias("check"), F.col(key).cast("string").alias("key"), F.lit("").alias("detail"))


def dataset(rows: DataFrame, quotas: Mapping[str, int], family_cap: int) -> DataFrame:
    """Contract of a built dataset (id, digest, split, class, family, parent, label, options).

    Digests are unique and in one split, labels are legal, classes have their quota, families keep
    their cap, and parents are rows of the same split.
    """
    per_digest = rows.groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("split").alias("s"))
    counts = rows.groupBy("class").agg(F.count(F.lit(1)).alias("n"))
    wanted = rows.sparkSession.createDataFrame(list(quotas.items()), "class string, quota long")
    quota = wanted.join(counts, "class", "full_outer").where("NOT (coalesce(n, 0) <=> quota)")
    family = rows.groupBy("family").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > family_cap)
    parents = rows.select(F.col("id").alias("parent"), F.col("split").alias("_split"))
    orphans = rows.where("parent IS NOT NULL").join(parents, "parent", "left").where("NOT (split <=> _split)")
    return violations(
        [
            ("duplicate digest", per_digest.where("n > 1"), "digest", "n"),
            ("digest in two splits", per_digest.where("s > 1"), "digest", "s"),
            ("quota", quota, "class", F.concat_ws("/", F.coalesce("n", F.lit(0)), "quota")),
            ("family cap", family, "family", "n"),
            ("parent", orphans, "id", "parent"),
            ("illegal label", rows.where(~F.array_contains("options", F.col("label"))), "id", "label"),
        ]
    )


def seed_sets(seeds: DataFrame, reserved: DataFrame) -> DataFrame:
    """Violations of seed lists (name, seed): positive, unique within and across lists, none reserved."""
    across = seeds.groupBy("seed").agg(F.count_distinct("name").alias("lists"), F.count(F.lit(1)).alias("n"))
    return violations(
        [
            ("not positive", seeds.where("seed IS NULL OR seed <= 0"), "seed", "name"),
            ("in two lists", across.where("lists > 1"), "seed", "lists"),
            ("repeated", across.where("n > lists"), "seed", "n"),
            ("reserved", seeds.join(reserved.select("seed").distinct(), "seed", "left_semi"), "seed", "name"),
        ]
    )


def one_identity(rows: DataFrame, key: Sequence[str], identity: str) -> DataFrame:
    """Groups that were scored by more than one identity."""
    return rows.groupBy(*key).agg(F.count_distinct(identity).alias("identities"), F.min(identity).alias("first"), F.max(identity).alias("last")).where("identities > 1")


def frozen(saved: DataFrame, now: DataFrame, key: Sequence[str]) -> DataFrame:
    """Configurations (key, value) that changed, went or came between two runs."""
    a, b = saved.withColumnRenamed("value", "saved"), now.withColumnRenamed("value", "current")
    return a.join(b, list(key), "full_outer").where("NOT (saved <=> current)")
