"""Distances on edge tables by blocks of nodes, closeness by words of sources, and ancestors by doubling."""

from __future__ import annotations

import heapq
import itertools
import math
import uuid
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfold.operators.ranking import placed
from wayfold.sources.shared import cut, drop, release, shared_dir, stored


def grid_edges(cells: DataFrame, height: int, width: int) -> DataFrame:
    """src, dst between open neighbours of a grid (open: row, column); columns wrap, rows do not."""
    number = F.col("row") * width + F.col("column")
    open_ = cells.select(number.cast("int").alias("dst"))
    near = F.array(
        F.struct((F.col("row") - 1).alias("r"), F.col("column").alias("c")),
        F.struct((F.col("row") + 1).alias("r"), F.col("column").alias("c")),
        F.struct(F.col("row").alias("r"), F.pmod(F.col("column") - 1, F.lit(width)).alias("c")),
        F.struct(F.col("row").alias("r"), F.pmod(F.col("column") + 1, F.lit(width)).alias("c")),
    )
    step = cells.select(number.cast("int").alias("src"), F.explode(near).alias("n")).where(f"n.r >= 0 AND n.r < {height}")
    return step.select("src", (F.col("n.r") * width + F.col("n.c")).cast("int").alias("dst")).join(open_, "dst").select("src", "dst").distinct()


#: So many edges (two ints each) go to the tasks with the closure at most; larger graphs are walked by blocks.
SMALL_GRAPH = 200_000


def _walks(steps: dict[int, list[int]]):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for src in batch.column("src").to_pylist():
                found, frontier = {src: 0}, [src]
                while frontier:
                    frontier = [b for b in dict.fromkeys(b for a in frontier for b in steps.get(a, ())) if b not in found]
                    level = max(found.values()) + 1
                    found.update(dict.fromkeys(frontier, level))
                yield pa.RecordBatch.from_arrays([pa.array([src] * len(found), pa.int64()), pa.array(list(found), pa.int64()), pa.array(list(found.values()), pa.int32())], names=["src", "dst", "d"])

    return run


#: So many edges are one block of a graph that is too large for a task.
BLOCK = 500_000
_LOG = "src long, node long, d int, sent boolean"


def _block_of(lows: Sequence[int], nodes: np.ndarray) -> np.ndarray:
    """Blocks hold ranges of nodes; lows are their first nodes."""
    return np.maximum(np.searchsorted(lows, nodes, side="right") - 1, 0)


def _placed_in(lows: Sequence[int]):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            src = batch.column("src").to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([pa.array(_block_of(lows, src), pa.int32()), *[pa.array(src, pa.int64())] * 2, pa.array(np.zeros(len(src)), pa.int32()), pa.array(np.ones(len(src), bool))], names=["block", "src", "node", "d", "sent"])

    return run


def _relaxed(lows: Sequence[int]):
    """Of one block and source: nodes that have come nearer by what other blocks have sent, and what follows for nodes of other blocks."""

    def run(key, steps: pa.Table, log: pa.Table) -> pa.Table:
        own, src = (k.as_py() for k in key)
        to: dict[int, list[int]] = {}
        for a, b in zip(steps.column("at").to_pylist(), steps.column("to").to_pylist(), strict=True):
            to.setdefault(a, []).append(b)
        low, high = (-math.inf if not own else lows[own]), (lows[own + 1] if own + 1 < len(lows) else math.inf)
        best: dict[int, int] = {}
        heard = []
        for node, d, fresh in zip(*[log.column(c).to_pylist() for c in ("node", "d", "fresh")], strict=True):
            if fresh:
                heard.append((d, node))
            elif d < best.get(node, math.inf):
                best[node] = d
        heap = [(d, node) for d, node in heard if d < best.get(node, math.inf)]
        best.update({node: d for d, node in sorted(heap, reverse=True)})
        heapq.heapify(heap)
        nearer: dict[int, int] = {}
        while heap:
            d, a = heapq.heappop(heap)
            if d > best[a] or nearer.get(a) == d:
                continue
            nearer[a] = d
            for b in to.get(a, ()):
                if d + 1 < best.get(b, math.inf):
                    best[b] = nearer[b] = d + 1
                    if low <= b < high:
                        del nearer[b]
                        heapq.heappush(heap, (d + 1, b))
        nodes = np.fromiter(nearer, np.int64, len(nearer))
        return pa.table({"block": pa.array(_block_of(lows, nodes), pa.int32()), "src": pa.array([src] * len(nodes), pa.int64()), "node": pa.array(nodes), "d": pa.array(list(nearer.values()), pa.int32()), "sent": pa.array((nodes < low) | (nodes >= high))})

    return run


def _by_blocks(edges: DataFrame, sources: DataFrame, block: int) -> DataFrame:
    """src, node, d. Each round walks the blocks that others have sent something nearer, as far as it leads within them.

    A path takes a round for each of its crossings between blocks, not for each of its steps, and a round reads only the blocks
    that it walks. All that a block has learnt is a log by block, whose least values are the distances.
    """
    spark, base = edges.sparkSession, f"{shared_dir(edges.sparkSession)}/blocks-{uuid.uuid4().hex}"
    step = edges.select(F.col("src").cast("long").alias("at"), F.col("dst").cast("long").alias("to")).where("at IS NOT NULL AND to IS NOT NULL")
    step = cut(step.distinct())
    ranged = step.repartitionByRange(-(-step.count() // block) or 1, "at").withColumn("part", F.spark_partition_id())
    ranged.write.partitionBy("part").parquet(f"{base}/step")
    step = spark.read.schema("at long, to long, part int").parquet(f"{base}/step")
    parts = sorted((r["low"], r["part"]) for r in step.groupBy("part").agg(F.min("at").alias("low")).collect())  # a row a block
    lows, names = [low for low, _ in parts], [part for _, part in parts]
    start = sources.where("src IS NOT NULL").select(F.col("src").cast("long").alias("src")).distinct()
    start.mapInArrow(_placed_in(lows), f"block int, {_LOG}").write.partitionBy("block").parquet(f"{base}/log/round=0")
    for k in itertools.count(1):
        log, again = (spark.read.schema(f"{_LOG}, round int, block int").parquet(f"{base}/log") for _ in range(2))
        sent = again.where((F.col("round") == k - 1) & F.col("sent")).select("block", "src").distinct()
        active = [r["block"] for r in sent.select("block").distinct().collect()]
        if not active:
            # the log is read by the result and stays until the session's folder is cleared
            drop(spark, f"{base}/step")
            return log.groupBy("src", "node").agg(F.min("d").alias("d"))
        number = F.create_map(*[F.lit(x) for b in active for x in (names[b], b)])
        mine = step.where(F.col("part").isin([names[b] for b in active])).withColumn("block", number[F.col("part")])
        mine = mine.join(sent, "block").select("block", "src", "at", "to")
        known = log.where(F.col("block").isin(active)).join(sent, ["block", "src"], "left_semi")
        known = known.select("block", "src", "node", "d", ((F.col("round") == k - 1) & F.col("sent")).alias("fresh"))
        walked = mine.groupBy("block", "src").cogroup(known.groupBy("block", "src")).applyInArrow(_relaxed(lows), f"block int, {_LOG}")
        walked.write.partitionBy("block").parquet(f"{base}/log/round={k}")


def distances(edges: DataFrame, sources: DataFrame, blocked: DataFrame | None = None, small: int = SMALL_GRAPH, block: int = BLOCK) -> DataFrame:
    """src, dst, d: the fewest steps from every source (column src) to all it reaches, itself at 0.

    A graph of at most small edges goes to the tasks, which walk it from their sources. A larger one is
    parted into blocks of nodes, which tasks walk in rounds until no block has anything nearer for another.
    """
    if blocked is not None:
        edges = edges.join(blocked.select(F.col("node").alias("dst")), "dst", "left_anti")
    kind = dict(edges.dtypes)["dst"]
    some = edges.select("src", "dst").distinct().limit(small + 1).collect()
    if len(some) <= small:
        steps: dict[int, list[int]] = {}
        for a, b in some:
            steps.setdefault(a, []).append(b)
        out = sources.select(F.col("src").cast("long").alias("src")).distinct().mapInArrow(_walks(steps), "src long, dst long, d int")
    else:
        out = _by_blocks(edges, sources, block).withColumnRenamed("node", "dst")
    return out.select(F.col("src").cast(kind).alias("src"), F.col("dst").cast(kind).alias("dst"), "d")


def ancestors(parents: DataFrame) -> DataFrame:
    """id, ancestor, depth of a forest (id, parent): the transitive closure, in as many rounds as the depth has binary digits.

    Each round joins the pairs of the greatest depth so far with all pairs, which doubles that depth.
    A circle raises.
    """
    have = cut(parents.where("parent IS NOT NULL").select("id", F.col("parent").alias("ancestor"), F.lit(1).alias("depth")))
    reach = 1
    while True:
        far = have.where(F.col("depth") == reach).select("id", F.col("ancestor").alias("_mid"))
        on = have.select(F.col("id").alias("_mid"), "ancestor", (F.col("depth") + reach).alias("depth"))
        more = cut(far.join(on, "_mid").select("id", "ancestor", "depth"))
        if more.isEmpty():
            return have
        if not more.where("id = ancestor").isEmpty():
            raise ValueError("a row is its own ancestor")
        have, reach = cut(have.unionByName(more)), 2 * reach


def penalised_cost(food: DataFrame, danger: DataFrame, reach: int = 6) -> DataFrame:
    """at, cost: least of food distance + 2 * sum of (reach - danger distance) over all near dangers of the food.

    food: at, food, d; danger: food, d.
    """
    near = danger.groupBy("food").agg(F.sum(F.greatest(F.lit(reach) - F.col("d"), F.lit(0))).alias("penalty"))
    joined = food.join(near, "food", "left")
    return joined.groupBy("at").agg(F.min(F.col("d") + 2 * F.coalesce("penalty", F.lit(0))).alias("cost"))


#: Sources of one word of a frontier.
WORD = 64


def closeness(edges: DataFrame, sources: DataFrame, depth: int | None = None) -> DataFrame:
    """node, reached, total, farthest: how many sources (column src) reach each node, the sum of their distances and the largest; within depth steps, if given.

    Frontiers of 64 sources are one long: a step ORs the words of a node's neighbours, and what was not there before is the next
    level. Only words with a bit are rows, so a node has as many as its sources fill, and no pair of a source and a node
    is ever a row. Nodes are those of the edges and the sources; a source reaches itself at 0.
    """
    spark = edges.sparkSession
    step = cut(edges.select(F.col("src").alias("_from"), F.col("dst").alias("node")).where("_from <> node").distinct())
    ids = cut(placed(sources.select(F.col("src").alias("node")).where("node IS NOT NULL").distinct(), "_i", "node"))
    bit, none = F.expr(f"shiftleft(1L, cast((_i - 1) % {WORD} as int))"), F.lit(0).cast("long")
    state = ids.select("node", F.expr(f"(_i - 1) div {WORD}").alias("word"), bit.alias("seen"), bit.alias("new"), F.lit(1).cast("long").alias("reached"), none.alias("total"), F.lit(0).alias("farthest"))
    level, last = 0, None
    while depth is None or level < depth:
        level += 1
        near = state.where("new <> 0").select(F.col("node").alias("_from"), "word", "new").join(step, "_from")
        near = near.select("node", "word", none.alias("seen"), F.col("new").alias("_near"), none.alias("reached"), none.alias("total"), F.lit(None).cast("int").alias("farthest"))
        met = state.select("node", "word", "seen", none.alias("_near"), "reached", "total", "farthest").union(near)
        met = met.groupBy("node", "word").agg(F.bit_or("seen").alias("seen"), F.bit_or("_near").alias("_near"), F.sum("reached").alias("reached"), F.sum("total").alias("total"), F.max("farthest").alias("farthest"))
        met = met.withColumn("_new", F.col("_near").bitwiseAND(F.bitwise_not("seen")))
        n = F.bit_count("_new").cast("long")
        met = met.select("node", "word", F.col("seen").bitwiseOR(F.col("_new")).alias("seen"), F.col("_new").alias("new"), (F.col("reached") + n).alias("reached"), (F.col("total") + level * n).alias("total"), F.when(n > 0, level).otherwise(F.col("farthest")).alias("farthest"))
        state, path = stored(met)
        if last:
            drop(spark, last)
        last = path
        release(spark)
        if state.where("new <> 0").isEmpty():
            break
    per = state.groupBy("node").agg(F.sum("reached").alias("reached"), F.sum("total").alias("total"), F.max("farthest").alias("farthest"))
    nodes = step.select("node").union(step.select(F.col("_from").alias("node"))).union(ids.select("node")).distinct()
    return nodes.join(per, "node", "left").select("node", F.coalesce("reached", none).alias("reached"), F.coalesce("total", none).alias("total"), "farthest")
