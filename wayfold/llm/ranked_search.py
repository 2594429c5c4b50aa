"""Ranked lexical search over a two-level quantised index.

The index holds, for every document, the query terms that it contains, and for each of them two levels: a byte
that is the term's impact in steps of STEP, rounded up, and the exact count. A document's impact for a term is
(1000000000 tf) div (1000 tf + 20 m), below 1000000, so a byte b says that the impact is in ((b - 1) STEP, b STEP].

1. Texts are read once into counts of the query terms, kept as a narrow table in the shared folder;
   document frequencies, N and L are map-side combined sums over it, and the index is that table with bytes.
2. Level one only: weighted sums of bytes bound every score from both sides. A task keeps the k highest
   lower bounds of each item, and the k-th highest of all tasks is the item's threshold.
3. Every document whose upper bound reaches the threshold is scored exactly from level two. A task passes on its
   k best, and the best k of all tasks are ranked. No document that belongs to the answer can be missed: k documents have
   scores at or above the threshold, and a document with a lower upper bound is below all of them.

Queries are taken in blocks of about BLOCK_TERMS term occurrences, the only data that is broadcast or held by the driver; one
block's terms, weights and thresholds go to all tasks. Per (task, item) at most k rows are shuffled, first
dealt by (item, salt), so no item gathers the rows of all tasks at once. Terms are told apart by 64-bit hashes.

Edge cases: a null or wordless text has no terms and is not in N; a null doc_id is ranked after the others of equal score;
repeated rows of documents are ranked one by one; rows of one item_id are one item with the terms of all of them (null is an item
of its own), and one without terms has no rows; an empty table on either side gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wayfold.llm.common import stored, table
from wayfold.llm.textnp import PUNCT, buffers, column, hashes, signed, slices, spans, unsigned
from wayfold.sources.shared import drop

K = 50
#: Impacts are below 1000000, so bytes go up to 245.
STEP = 4096
#: Term occurrences of the items that are searched at once, on average: some 30,000 items.
BLOCK_TERMS = 1_000_000
#: Cells (terms of all items, documents) that are worked on at once.
CELLS = 1 << 22
#: Over so many tasks the rows of an item are thinned before they meet.
SALTS = 64

COUNTS = "doc_id long, n long, terms array<int>, counts array<int>"
INDEX = "doc_id long, n long, terms array<int>, counts array<int>, bytes binary"


def _tokens(texts) -> tuple[np.ndarray, np.ndarray]:
    """Hash and text number of every term."""
    data, offsets = buffers(texts)
    start, end, doc = spans(data, offsets, PUNCT)
    return hashes(data, start, end), doc


def item_terms(benchmark: DataFrame) -> DataFrame:
    """item_id, term: the distinct terms of each item."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(it):
            h, doc = _tokens(column(batch, "text"))
            yield pa.RecordBatch.from_arrays([column(batch, "item_id").take(pa.array(doc)), pa.array(signed(h))], names=["item_id", "term"])

    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text")
    return rows.mapInArrow(run, "item_id long, term long").distinct()


@dataclass
class Queries:
    """A block of items: the sorted hashes of their terms, and for each item where its terms are in that order."""

    items: list[int | None]
    terms: np.ndarray
    at: np.ndarray  # places of all items' terms, item by item
    start: np.ndarray  # where each item begins in at
    weight: np.ndarray | None = None
    n_docs: int = 0
    n_terms: int = 1
    floor: np.ndarray | None = None  # by item, the least upper bound that is worth scoring

    @classmethod
    def of(cls, rows: pa.Table) -> Queries:
        items = rows.column("item_id").to_pylist()
        names = sorted(set(items), key=lambda i: (i is None, i))
        number = {i: k for k, i in enumerate(names)}
        own = np.array([number[i] for i in items], np.int64)
        term = unsigned(np.asarray(rows.column("term").combine_chunks() if rows.num_rows else pa.array([], pa.int64())).copy())
        terms, at = np.unique(term, return_inverse=True)
        order = np.lexsort((at, own))
        return cls(names, terms, at[order], np.searchsorted(own[order], np.arange(len(names))))


def count_terms(docs: DataFrame, queries) -> DataFrame:
    """doc_id, n, terms, counts for every document with a term; terms are places in the queries' order, rising."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = queries.value.terms
        for batch in slices(it):
            h, doc = _tokens(column(batch, "text"))
            n = np.bincount(doc, minlength=batch.num_rows)
            place = np.minimum(np.searchsorted(terms, h), max(0, len(terms) - 1))
            hit = terms[place] == h if len(terms) else np.zeros(len(h), bool)
            key, count = np.unique(doc[hit] * max(1, len(terms)) + place[hit], return_counts=True)
            ends = np.searchsorted(key, np.arange(batch.num_rows + 1) * max(1, len(terms))).astype(np.int32)
            lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array(x.astype(np.int32))) for x in (key % max(1, len(terms)), count)]
            out = pa.RecordBatch.from_arrays([column(batch, "doc_id"), pa.array(n.astype(np.int64)), *lists], names=["doc_id", "n", "terms", "counts"])
            yield out.filter(pa.array(n > 0))

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, COUNTS)


def impacts(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    """The exact integer impact of a term that occurs tf times in a document of relative length m."""
    return (1_000_000_000 * tf) // (1000 * tf + 20 * m)


def _lists(col) -> tuple[np.ndarray, np.ndarray]:
    """Values and row numbers of a list column."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    size = np.diff(np.asarray(col.offsets))
    return np.asarray(col.flatten()), np.repeat(np.arange(len(col)), size)


def quantised(counts: DataFrame, n_docs: int, n_terms: int) -> DataFrame:
    """The index: counts, and for each a byte that is the impact in steps of STEP, rounded up."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            tf, doc = _lists(column(batch, "counts"))
            m = 50 + 50 * np.asarray(column(batch, "n")) * n_docs // n_terms
            q = -(-impacts(tf.astype(np.int64), m[doc]) // STEP)
            ends = np.searchsorted(doc, np.arange(batch.num_rows + 1)).astype(np.int32)
            bytes_ = pa.Array.from_buffers(pa.binary(), batch.num_rows, [None, pa.py_buffer(ends), pa.py_buffer(q.astype(np.uint8))])
            yield pa.RecordBatch.from_arrays([*[column(batch, c) for c in ("doc_id", "n", "terms", "counts")], bytes_], names=["doc_id", "n", "terms", "counts", "bytes"])

    return counts.mapInArrow(run, INDEX)


def _blocks(it: Iterator[pa.RecordBatch], queries: Queries) -> Iterator[pa.RecordBatch]:
    """The batches in pieces whose dense table of bytes stays within CELLS."""
    size = max(1, min(512, CELLS // max(1, len(queries.terms))))
    for batch in it:
        for at in range(0, batch.num_rows, size):
            yield batch.slice(at, size)


def _bounds(block: pa.RecordBatch, queries: Queries) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """First item, lower and upper bounds (items, documents) of the scores, over slices of the items."""
    place, doc = _lists(column(block, "terms"))
    level = np.zeros((len(queries.terms), block.num_rows), np.uint8)
    level[place, doc] = buffers(column(block, "bytes").cast(pa.binary()))[0]
    ends = np.append(queries.start, len(queries.at))
    lo = 0
    while lo < len(queries.items):
        hi = int(np.searchsorted(ends, ends[lo] + CELLS // block.num_rows, "right")) - 1
        hi = min(max(hi, lo + 1), len(queries.items))
        at = queries.at[ends[lo] : ends[hi]]
        q, w = level[at], queries.weight[at][:, None]
        first = ends[lo:hi] - ends[lo]
        upper = np.add.reduceat(q * w, first, axis=0)
        held = np.add.reduceat((q > 0) * w, first, axis=0)
        yield lo, upper * STEP - held * (STEP - 1), upper * STEP
        lo = hi


def lower_bounds(index: DataFrame, queries, k: int) -> DataFrame:
    """item (its number in the block), low: the k highest positive lower bounds of each item in each task."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q = queries.value
        best = np.zeros((len(q.items), k), np.int64)
        for block in _blocks(it, q):
            for lo, lower, _ in _bounds(block, q):
                hi = lo + len(lower)
                both = np.concatenate((best[lo:hi], lower), axis=1)
                best[lo:hi] = np.partition(both, both.shape[1] - k, axis=1)[:, -k:]
        item, _ = np.nonzero(best)
        yield pa.RecordBatch.from_arrays([pa.array(item.astype(np.int32)), pa.array(best[best > 0])], names=["item", "low"])

    return index.select("terms", "bytes").mapInArrow(run, "item int, low long")


def exact_scores(index: DataFrame, queries, k: int) -> DataFrame:
    """item_id, doc_id, score of the k best documents of each item in each task, among those whose upper bound reaches the threshold."""

    def best(rows: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
        item, doc, null, score = (np.concatenate(c) for c in zip(*rows, strict=True))
        order = np.lexsort((doc, null, -score, item))
        item, doc, null, score = item[order], doc[order], null[order], score[order]
        keep = np.arange(len(item)) - np.searchsorted(item, item) < k
        return item[keep], doc[keep], null[keep], score[keep]

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q = queries.value
        ends = np.append(q.start, len(q.at))
        rows, waiting = [tuple(np.zeros(0, t) for t in (np.int64, np.int64, bool, np.int64))], 0
        for block in _blocks(it, q):
            ids = column(block, "doc_id")
            null, doc_id = np.asarray(ids.is_null()), np.asarray(ids.fill_null(0))
            m = 50 + 50 * np.asarray(column(block, "n")) * q.n_docs // q.n_terms
            tf = None
            for lo, _, upper in _bounds(block, q):
                reach = upper >= q.floor[lo : lo + len(upper), None]
                for i in np.flatnonzero(reach.any(axis=1)).tolist():
                    if tf is None:
                        place, doc = _lists(column(block, "terms"))
                        tf = np.zeros((len(q.terms), block.num_rows), np.int32)
                        tf[place, doc] = _lists(column(block, "counts"))[0]
                    who = np.flatnonzero(reach[i])
                    at = q.at[ends[lo + i] : ends[lo + i + 1]]
                    score = (q.weight[at][:, None] * impacts(tf[np.ix_(at, who)].astype(np.int64), m[who][None, :])).sum(axis=0)
                    who, score = who[score > 0], score[score > 0]
                    rows.append((np.full(len(who), lo + i), doc_id[who], null[who], score))
                    waiting += len(who)
            if waiting > CELLS // 16:
                rows, waiting = [best(rows)], 0
        item, doc, null, score = best(rows)
        names = pa.array(q.items, pa.int64()).take(pa.array(item))
        yield pa.RecordBatch.from_arrays([names, pa.array(doc, mask=null), pa.array(score)], names=["item_id", "doc_id", "score"])

    return index.mapInArrow(run, "item_id long, doc_id long, score long")


def _top(rows: DataFrame, key: str, order: list[Column], k: int, out: str) -> DataFrame:
    """The first k rows of each key with their place, thinned first by salts."""
    part = rows.withColumn("_salt", F.pmod(F.spark_partition_id(), F.lit(SALTS)))
    part = part.withColumn(out, F.row_number().over(Window.partitionBy(key, "_salt").orderBy(*order))).where(F.col(out) <= k).drop("_salt")
    return part.withColumn(out, F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col(out) <= k)


def _search(docs: DataFrame, queries: Queries, k: int) -> DataFrame:
    spark = docs.sparkSession
    sc = spark.sparkContext
    counts, raw = stored(count_terms(docs, sc.broadcast(queries)))
    n_docs, n_terms = counts.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    df = np.zeros(len(queries.terms), np.int64)
    for r in counts.select(F.explode("terms").alias("t")).groupBy("t").count().toLocalIterator():
        df[r[0]] = r[1]
    queries.weight = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * d + 1))) for d in df.tolist()], np.int64)
    queries.n_docs, queries.n_terms = n_docs, max(1, n_terms)
    index, _ = stored(quantised(counts, n_docs, max(1, n_terms)))
    drop(spark, raw)
    lows = _top(lower_bounds(index, sc.broadcast(queries), k), "item", [F.desc("low")], k, "rank")
    queries.floor = np.ones(len(queries.items), np.int64)
    for r in lows.where(F.col("rank") == k).select("item", "low").toLocalIterator():
        queries.floor[r[0]] = r[1]
    return exact_scores(index, sc.broadcast(queries), k)


def search(docs: DataFrame, benchmark: DataFrame, k: int = K, block_terms: int = BLOCK_TERMS) -> DataFrame:
    """item_id, rank, doc_id, score: the k best documents of every item."""
    spark = docs.sparkSession
    terms, path = stored(item_terms(benchmark))
    blocks = max(1, math.ceil(terms.count() / block_terms))
    found = spark.createDataFrame([], "item_id long, doc_id long, score long")
    for b in range(blocks):
        part = terms.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b)
        found = found.unionByName(_search(docs, Queries.of(part.toArrow()), k))
    drop(spark, path)
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    return _top(found, "item_id", order, k, "rank").select("item_id", "rank", "doc_id", "score")


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_TERMS = """regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"""

SQL = {
    "op13_ranked_search": f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_TERMS} AS terms FROM documents),
s AS (SELECT count(*) AS nd, sum(len(terms))::BIGINT AS nt FROM d WHERE len(terms) > 0),
q AS (SELECT DISTINCT item_id, unnest({_TERMS}) AS term FROM benchmark),
p AS (SELECT r, unnest(terms) AS term FROM d),
c AS (SELECT r, term, count(*) AS tf FROM p SEMI JOIN q USING (term) GROUP BY ALL),
w AS (SELECT term, floor(1000 * ln((2 * nd + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM c, s GROUP BY term, nd),
m AS (SELECT r, doc_id, 50 + (50 * len(terms) * nd) // nt AS m FROM d, s WHERE len(terms) > 0),
x AS (
  SELECT item_id, r, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m)))::BIGINT AS score
  FROM q JOIN c USING (term) JOIN w USING (term) JOIN m USING (r) GROUP BY ALL)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST, r)::INTEGER AS rank, doc_id, score
FROM x WHERE score > 0 QUALIFY rank <= {K}
"""
}
