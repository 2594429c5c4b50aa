"""Connected components of an edge table, without holding any component in one task."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfold.llm.common import cut
from wayfold.llm.textnp import column

#: So many edges (16 bytes each) are joined up in one pass of one task; more take rounds over all tasks.
ONE_TASK = 1_000_000


def _roots(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Vertices and the smallest vertex reachable from each, by rounds of hooking and pointer jumping."""
    names, at = np.unique(np.concatenate((a, b)), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    root = np.arange(len(names))
    while True:
        p, q = root[x], root[y]
        if (p == q).all():
            return names, names[root]
        np.minimum.at(root, np.maximum(p, q), np.minimum(p, q))
        while (root[root] != root).any():
            root = root[root]


def _in_one_task(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    parts = [(np.asarray(column(t, "a")), np.asarray(column(t, "b"))) for t in it]
    if parts:
        v, root = _roots(*(np.concatenate([p[i] for p in parts]) for i in range(2)))
        yield pa.RecordBatch.from_arrays([pa.array(v), pa.array(root)], names=["v", "component"])


def components(edges: DataFrame, one_task: int = ONE_TASK) -> DataFrame:
    """v, component for every vertex of edges (a, b: long); component is the smallest vertex reachable.

    Up to one_task edges are joined up by one task. With more, each round takes the smallest label
    of all neighbours (a map-side combined minimum, so a vertex with a third of all edges costs no more
    than its share) and then the label's own label, which halves distances; labels are cut in the shared
    folder after every round. Nulls and loops add nothing; repeated edges do no harm; no edges give no rows.
    """
    e = cut(edges.where("a IS NOT NULL AND b IS NOT NULL AND a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    if e.count() <= one_task:
        return cut(e.coalesce(1).mapInArrow(_in_one_task, "v long, component long"))
    e = cut(e.union(e.select("b", "a")))
    labels = cut(e.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("l")).withColumnRenamed("a", "v"))
    while True:
        near = e.join(labels.select(F.col("v").alias("b"), "l"), "b").groupBy(F.col("a").alias("v")).agg(F.min("l").alias("m"))
        step = labels.join(near, "v").select("v", "l", F.least("l", "m").alias("n"))
        up = labels.select(F.col("v").alias("n"), F.col("l").alias("nn"))
        step = cut(step.join(up, "n", "left").select("v", "l", F.least("n", F.coalesce("nn", "n")).alias("n")))
        labels, changed = step.select("v", F.col("n").alias("l")), step.where("n <> l").limit(1).count()
        if not changed:
            return labels.withColumnRenamed("l", "component")
