"""Order-preserving Merkle trees of tables: one digest without one task, and the ranges in which two tables differ.

Rows are ordered by an integer key (ties by their own digest) and cut into leaves of `width` keys each, so a
leaf is the same range in every version of a table. Inside a leaf the rows' digests are folded FAN by FAN, level by level, to
one; then leaves are folded FAN by FAN by their number. A task only ever holds FAN digests of a node. Rows get
their places by a window over a leaf, where it has at most WIDE rows; those of larger leaves (one may hold a third of all rows) by ranges of
their whole order (ranking.placed).

    tree(df, key, width)      level, node, rows, digest: level 0 are leaves, level HEIGHT has the root alone
    changed(a, b)             lo, hi, side of the leaves that differ, found from the root down
    revalidated(df, key, ...) digests of given ranges only, read with a filter on the key that reaches the scan
"""

from __future__ import annotations

import hashlib
import itertools
import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayfold.operators.ranking import placed
from wayfold.operators.stages import row_text
from wayfold.sources.shared import cut

#: Children of a node, a power of two.
FAN = 64
#: Levels above the leaves, the same for all tables so that trees of growing tables compare: 64 ** 5 leaves.
HEIGHT = 5
#: Rows of a leaf beyond which it is dealt out over tasks, and rows that a task orders.
WIDE, TASK_ROWS = 1 << 18, 1_000_000
NODE = "level int, node long, rows long, digest string"


def _parent(place: Column) -> Column:
    """Rounded down, also below 0."""
    return F.shiftright(place, FAN.bit_length() - 1)


def _fold(nodes: DataFrame, by: Sequence[str], place: str) -> DataFrame:
    """One level up: the digest of a node is that of its children's (place, digest) in their order; rows add up."""
    parent = _parent(F.col(place))
    joined = F.array_sort(F.collect_list(F.struct(place, "digest")))
    text = F.array_join(F.transform(joined, lambda c: F.concat_ws(":", c[place].cast("string"), c["digest"])), "\n")
    return nodes.groupBy(*by, parent.alias("_up")).agg(F.sum("rows").alias("rows"), F.sha2(text, 256).alias("digest")).withColumnRenamed("_up", place)


def _numbered(rows: DataFrame, count: int) -> DataFrame:
    """at: a row's place in its leaf, from 0, by one exchange of keys and digests."""
    parts = max(-(-count // TASK_ROWS), int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    order = Window.partitionBy("leaf").orderBy("key", "digest")
    return rows.repartition(parts, "leaf").withColumn("at", F.row_number().over(order).cast("long") - 1)


def _ranged(rows: DataFrame) -> DataFrame:
    """The same where a leaf can be more than a task holds: its rows are placed by ranges."""
    rows = cut(placed(rows, "place", "leaf", "key", "digest"))
    first = rows.groupBy("leaf").agg(F.min("place").alias("_first"))
    return rows.join(first, "leaf").select("leaf", "key", "digest", (F.col("place") - F.col("_first")).alias("at"))


def leaves(df: DataFrame, key: str, width: int) -> DataFrame:
    """leaf, rows, digest for every leaf with rows; leaf = key div width (rounded down; a null key is before all)."""
    number = F.coalesce(F.floor(F.col(key) / width).cast("long"), F.lit(-(1 << 62)))
    # 32 bytes until they are folded: their order is that of the hexadecimal text
    rows = df.select(number.alias("leaf"), F.coalesce(F.col(key).cast("long"), F.lit(-(1 << 62))).alias("key"), F.unhex(F.sha2(row_text(df), 256)).alias("digest"))
    per = rows.groupBy("leaf").agg(F.count(F.lit(1)).alias("_n"))
    count, largest = per.agg(F.coalesce(F.sum("_n"), F.lit(0)), F.coalesce(F.max("_n"), F.lit(0))).first()
    if largest <= WIDE:
        nodes = _numbered(rows, count)
    else:
        wide = cut(per.where(F.col("_n") > WIDE).select("leaf"))
        nodes = _numbered(rows.join(wide, "leaf", "left_anti"), count).unionByName(_ranged(rows.join(wide, "leaf", "left_semi")))
    nodes = nodes.select("leaf", "at", F.lit(1).cast("long").alias("rows"), F.lower(F.hex("digest")).alias("digest"))
    for _ in range(max(1, math.ceil(math.log(max(largest, 2), FAN) - 1e-9))):
        nodes = _fold(nodes, ["leaf"], "at")
    return nodes.select("leaf", "rows", "digest")


def tree(df: DataFrame, key: str, width: int) -> DataFrame:
    """All nodes of the table's tree; an empty table has none."""
    at = cut(leaves(df, key, width).withColumnRenamed("leaf", "node"))
    parts = [at.withColumn("level", F.lit(0))]
    for level in range(1, HEIGHT + 1):
        at = _fold(at, [], "node")
        parts.append(at.withColumn("level", F.lit(level)))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select("level", "node", "rows", "digest")


def root(nodes: DataFrame) -> str | None:
    """The table's digest, that of the top nodes in their order (one, unless keys are negative, null or beyond the tree's span)."""
    top = nodes.where(F.col("level") == HEIGHT).select("node", "rows", "digest")
    while top.count() > FAN:
        top = _fold(top, [], "node")
    found = sorted((r["node"], r["digest"]) for r in top.collect())
    return hashlib.sha256("\n".join(f"{n}:{d}" for n, d in found).encode()).hexdigest() if found else None


def changed(a: DataFrame, b: DataFrame, width: int) -> DataFrame:
    """leaf, lo, hi, side (left, right, both) of the leaves that differ; only children of differing nodes are compared."""
    parents = None
    for level in range(HEIGHT, -1, -1):
        one, two = (x.where(F.col("level") == level).select("node", "digest") for x in (a, b))
        if parents is not None:
            near = lambda x: x.withColumn("_up", _parent(F.col("node"))).join(parents, "_up", "left_semi").drop("_up")  # noqa: B023, E731
            one, two = near(one), near(two)
        both = one.select("node", F.col("digest").alias("_a")).join(two.select("node", F.col("digest").alias("_b")), "node", "full_outer").where(~F.col("_a").eqNullSafe(F.col("_b")))
        both = cut(both)
        if level and both.isEmpty():
            break
        parents = both.select(F.col("node").alias("_up"))
    side = F.when(F.col("_b").isNull(), "left").when(F.col("_a").isNull(), "right").otherwise("both")
    return both.where(F.lit(level == 0)).select(F.col("node").alias("leaf"), (F.col("node") * width).alias("lo"), ((F.col("node") + 1) * width - 1).alias("hi"), side.alias("side"))


def within(key: str, ranges: Sequence[tuple[int, int]]) -> Column:
    """A filter of a few key ranges, which reaches the scan; neighbouring ranges are one."""
    merged: list[list[int]] = []
    for lo, hi in sorted(ranges):
        if merged and lo <= merged[-1][1] + 1:
            merged[-1][1] = max(hi, merged[-1][1])
        else:
            merged.append([lo, hi])
    conditions = [(F.col(key) >= lo) & (F.col(key) <= hi) for lo, hi in merged]
    return list(itertools.accumulate(conditions, lambda x, y: x | y))[-1] if conditions else F.lit(False)


#: So many changed ranges go into a filter; more are joined by leaf.
FEW = 200


def revalidated(df: DataFrame, key: str, width: int, ranges: DataFrame) -> DataFrame:
    """leaves() of the given ranges (changed()) only."""
    few = ranges.select("lo", "hi").limit(FEW + 1).collect()
    if len(few) <= FEW:
        part = df.where(within(key, [(r["lo"], r["hi"]) for r in few]))
    else:
        leaf = F.floor(F.col(key) / width).cast("long")
        part = df.withColumn("_leaf", leaf).join(ranges.select(F.col("leaf").alias("_leaf")), "_leaf", "left_semi").drop("_leaf")
    return leaves(part, key, width)
