"""Removal of repeated byte strings over a whole corpus by two-stage suffix sorting.

A byte goes if a string of WIDTH bytes that covers it starts earlier too (smaller doc_id, or
the same document and an earlier start). A suffix array of the whole corpus would be one
global sort of all suffixes; here suffixes meet only where they can share WIDTH bytes:

1. The minimizer of a WIDTH-byte string is its smallest hash of K bytes. Equal strings have
   equal minimizers, so the strings of a document fall into chunks, runs of neighbouring
   strings with one minimizer. Chunks (minimizer, id, start, length) are dealt by minimizer;
   one streaming pass keeps those whose minimizer has two chunks or more.
2. Only those fetch their bytes. They are dealt and sorted by (minimizer, bytes, id, start).
   Of equal chunks all but the first are repeats as a whole. The different chunks of one
   minimizer are concatenated, with separators, and their suffixes sorted in two stages
   (suffixes.suffix_array: those smaller than their successors directly, the others induced
   by bucket scans); adjacent common prefixes of WIDTH bytes give the groups of equal
   strings, and all but the earliest string of a group are repeats.
3. A minimizer with more than HOT chunks (a very common passage with ever different
   surroundings) isn't gathered: its strings go through step 2 one by one, each under the
   hash of its own bytes, which spreads them over all tasks.
4. The repeats of a document are merged into spans and cut out.

Edge cases: a null text is empty; texts shorter than WIDTH keep everything; matches never
cross documents; a null doc_id comes before all others; rows with one doc_id and different texts are
documents of their own, in the order of a hash of the text; rows with one doc_id and equal texts are one
document, each with its row in the result; an empty table gives an empty result; other columns
are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfold.llm.common import cut, table
from wayfold.llm.suffixes import common_prefixes, suffix_array
from wayfold.llm.textnp import _CODE, buffers, column, mix, signed, slices, unsigned

WIDTH, K = 100, 32
HOT = 50_000
#: Bytes of different chunks that are sorted at once.
SORT_BYTES = 1 << 20


def gram_hashes(data: np.ndarray, k: int = K) -> np.ndarray:
    """Hash of the k (a power of two) bytes from every place, by doubling."""
    h, width, factor = _CODE[data], 1, 0x9E3779B97F4A7C15
    while width < k:
        h = h[:-width] * np.uint64(factor) + h[width:] if len(h) > width else h[:0]
        factor = factor * factor % 2**64
        width *= 2
    return mix(h)


def _window_min(h: np.ndarray, w: int) -> np.ndarray:
    span = 1
    while span * 2 <= w:
        h = np.minimum(h[:-span], h[span:])
        span *= 2
    return np.minimum(h[: len(h) - (w - span)], h[w - span :]) if w > span else h


def chunks(data: np.ndarray, offsets: np.ndarray, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Minimizer, text number, start in the text and bytes of all chunks; the bytes count below zero if the minimizer comes twice in the chunk, which may then repeat within itself."""
    n = len(data) - width + 1
    if n <= 0:
        z = np.zeros(0, np.int64)
        return z.view(np.uint64), z, z, z
    grams = gram_hashes(data)
    least = _window_min(grams, width - K + 1)
    whole = offsets[:-1][np.diff(offsets) >= width]
    stop = offsets[1:][np.diff(offsets) >= width] - width + 1
    step = np.zeros(n + 1, np.int8)
    step[whole] += 1
    step[stop] -= 1
    valid = np.cumsum(step[:-1], dtype=np.int8) > 0
    new = valid.copy()
    new[1:] &= (least[1:] != least[:-1]) | ~valid[:-1]
    end = valid.copy()
    end[:-1] &= (least[1:] != least[:-1]) | ~valid[1:]
    start = np.flatnonzero(new)
    doc = np.searchsorted(offsets, start, "right") - 1
    last = np.flatnonzero(end)
    size = last - start + width
    # places of the minimizer: those where a string of the chunk starts, and those after its last start
    begins = np.concatenate(([0], np.cumsum((grams[:n] == least) & valid)))
    inner = begins[last + 1] - begins[start]
    twice = (inner > 1) | ((inner == 1) & (grams[last] != least[start]))
    none = np.flatnonzero(inner == 0)
    after = np.full(len(none), width - K)
    hits = grams[_ragged(last[none] + 1, after)] == np.repeat(least[start[none]], after)
    twice[none] = hits.reshape(len(none), width - K).sum(axis=1) > 1
    return least[start], doc, start - offsets[doc], np.where(twice, -size, size)


CHUNKS = "val long, id long, start int, size int"


def _chunk_rows(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(it):
        val, doc, start, size = chunks(*buffers(column(batch, "text")))
        ids = np.asarray(column(batch, "id"))[doc]
        yield pa.RecordBatch.from_arrays([pa.array(signed(val)), pa.array(ids), pa.array(start.astype(np.int32)), pa.array(size.astype(np.int32))], names=["val", "id", "start", "size"])


def _repeated(hot: int):
    """Of rows sorted by val those that may hold repeats: of a val with two rows or more, or marked as coming again in itself.

    is_hot marks the rows of a val with more than hot rows; at most hot rows of one val and a batch are held.
    """

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] | None = None  # rows of the last val, which may go on
        open_hot = None  # a val known to be hot, whose rows go straight through

        def out(rows: list[np.ndarray], is_hot: np.ndarray) -> pa.RecordBatch:
            rows = [*rows[:3], np.abs(rows[3])]
            return pa.RecordBatch.from_arrays([*[pa.array(r) for r in rows], pa.array(is_hot)], names=["val", "id", "start", "size", "is_hot"])

        def whole(rows: list[np.ndarray]) -> pa.RecordBatch:
            _, at, size = np.unique(rows[0], return_inverse=True, return_counts=True)
            keep = (size[at] > 1) | (rows[3] < 0)
            return out([r[keep] for r in rows], (size[at] > hot)[keep])

        for batch in it:
            rows = [np.asarray(column(batch, c)) for c in ("val", "id", "start", "size")]
            if open_hot is not None:
                n = int(np.searchsorted(rows[0] != open_hot, True)) if (rows[0] != open_hot).any() else len(rows[0])
                if n:
                    yield out([r[:n] for r in rows], np.ones(n, bool))
                    rows = [r[n:] for r in rows]
            if not len(rows[0]):
                continue
            open_hot = None
            if held is not None:
                rows = [np.concatenate((h, r)) for h, r in zip(held, rows, strict=True)]
            last = len(rows[0]) - int(np.argmax((rows[0] != rows[0][-1])[::-1])) if (rows[0] != rows[0][-1]).any() else 0
            if last:
                yield whole([r[:last] for r in rows])
            held = [r[last:] for r in rows]
            if len(held[0]) > hot:
                yield out(held, np.ones(len(held[0]), bool))
                open_hot, held = held[0][0], None
        if held is not None:
            yield whole(held)

    return run


def _ragged(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """first[0], first[0] + 1, ... (size[0] of them), first[1], ..."""
    begin = np.cumsum(size) - size
    return np.arange(int(size.sum()), dtype=np.int64) + np.repeat(first - begin, size)


def _chunk_bytes(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """val, bytes, id and start of the asked chunks of a batch (id, text, asked: list of val, start, size, is_hot).

    A hot chunk is given string by string, each under the hash of its own bytes.
    """
    for batch in slices(it):
        data, offsets = buffers(column(batch, "text"))
        asked = column(batch, "asked")
        flat = asked.flatten()
        doc = np.repeat(np.arange(batch.num_rows), np.diff(np.asarray(asked.offsets)))
        val, start, size, hot = (np.asarray(flat.field(c)) if c != "is_hot" else flat.field(c).to_numpy(zero_copy_only=False) for c in ("val", "start", "size", "is_hot"))
        start, size = start.astype(np.int64), size.astype(np.int64)
        if hot.any():
            n = size[hot] - WIDTH + 1
            single, of = _ragged(start[hot], n), np.repeat(doc[hot], n)
            h64 = gram_hashes(data, 64)  # two overlapping hashes cover a string
            at = offsets[of] + single
            own = signed(mix(h64[at] * np.uint64(3) + mix(h64[at + WIDTH - 64])))
            val, doc, start, size = (np.concatenate(x) for x in ((val[~hot], own), (doc[~hot], of), (start[~hot], single), (size[~hot], np.full(len(own), WIDTH))))
        ids = np.asarray(column(batch, "id"))[doc]
        first, step = 0, max(1, (64 << 20) // (int(size.max()) if len(size) else 1))
        while first < len(size):  # a batch of hot strings may hold a hundred times its text
            part = slice(first, first + step)
            first += step
            ends = np.concatenate(([0], np.cumsum(size[part]))).astype(np.int32)
            body = data[_ragged(offsets[doc[part]] + start[part], size[part])]
            chunk = pa.Array.from_buffers(pa.binary(), len(size[part]), [None, pa.py_buffer(ends), pa.py_buffer(body)])
            yield pa.RecordBatch.from_arrays([pa.array(val[part]), chunk, pa.array(ids[part]), pa.array(start[part].astype(np.int32))], names=["val", "chunk", "id", "start"])


COVERS = "id long, lo int, hi int"


def _covers(ids: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(ids.astype(np.int64)), pa.array(lo.astype(np.int32)), pa.array(hi.astype(np.int32))], names=["id", "lo", "hi"])


def repeats(val: np.ndarray, body: np.ndarray, size: np.ndarray, ids: np.ndarray, start: np.ndarray) -> pa.RecordBatch:
    """Strings that come again among different chunks (rows in the order of val, each with its first id and start)."""
    first = np.cumsum(size) - size
    of = np.repeat(np.arange(len(size)), size)
    # a chunk alone with its minimizer repeats inside only if the minimizer does
    grams = gram_hashes(body)
    inside = (_ragged(np.zeros(len(size), np.int64), size) <= np.repeat(size, size) - K)[: len(grams)]
    hits = (grams == unsigned(val)[of[: len(grams)]]) & inside
    need = np.bincount(of[: len(grams)][hits], minlength=len(size)) > 1
    same = val[1:] == val[:-1]
    need[1:] |= same
    need[:-1] |= same
    if not need.any():
        return _covers(*[np.zeros(0, np.int64)] * 3)
    size, ids, start, first = size[need], ids[need], start[need], first[need]
    text = np.zeros(int(size.sum()) + len(size), np.uint8)  # symbols 1..; 0 separates
    begin = np.cumsum(size + 1) - (size + 1)
    text[_ragged(begin, size)] = body[_ragged(first, size)] + np.uint8(1)
    order = suffix_array(text, WIDTH)
    alike = common_prefixes(text, order, WIDTH)
    group = np.cumsum(~alike)
    member = alike.copy()
    member[:-1] |= alike[1:]
    at, group = order[member], group[member]
    chunk = np.searchsorted(begin, at, "right") - 1
    id_, place = ids[chunk], start[chunk] + at - begin[chunk]
    by = np.lexsort((place, id_, group))
    again = np.ones(len(by), bool)
    again[1:] = group[by][1:] == group[by][:-1]
    again[:1] = False
    dup = np.sort(at[by[again]])
    if not len(dup):
        return _covers(*[np.zeros(0, np.int64)] * 3)
    edge = np.ones(len(dup), bool)
    edge[1:] = np.diff(dup) > 1  # chunks are a separator and WIDTH - 1 bytes apart
    lo, hi = dup[edge], dup[np.append(np.flatnonzero(edge)[1:] - 1, len(dup) - 1)]
    chunk = np.searchsorted(begin, lo, "right") - 1
    return _covers(ids[chunk], start[chunk] + lo - begin[chunk], start[chunk] + hi - begin[chunk] + WIDTH)


def _sorted_chunks(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Covers from rows sorted by (val, chunk, id, start); holds the different chunks of whole vals up to SORT_BYTES."""
    held: list[tuple] = []
    pending, last = 0, None

    def flush(parts: list[tuple]) -> pa.RecordBatch:
        val, size, ids, start = (np.concatenate([p[i] for p in parts]) for i in (0, 2, 3, 4))
        return repeats(val, np.concatenate([p[1] for p in parts]), size, ids, start)

    for whole in it:
        for at in range(0, whole.num_rows, 8192):
            batch = whole.slice(at, 8192)
            val, ids, start = (np.asarray(column(batch, c)) for c in ("val", "id", "start"))
            data, offsets = buffers(column(batch, "chunk").cast(pa.large_binary()))
            size = np.diff(offsets)
            new = np.ones(len(val), bool)
            near = np.flatnonzero((val[1:] == val[:-1]) & (size[1:] == size[:-1])) + 1
            if len(near):
                differ = data[_ragged(offsets[near], size[near])] != data[_ragged(offsets[near - 1], size[near])]
                new[near] = np.add.reduceat(differ, np.cumsum(size[near]) - size[near]) > 0
            head = (int(val[0]), data[: size[0]].tobytes())
            new[0] = head != last
            last = (int(val[-1]), data[offsets[-2] :].tobytes())
            again = ~new
            yield _covers(ids[again], start[again], start[again] + size[again])
            if not new.any():
                continue
            part = (val[new], data[_ragged(offsets[:-1][new], size[new])], size[new], ids[new], start[new].astype(np.int64))
            begun = np.flatnonzero(part[0] != part[0][-1])
            if pending + len(part[1]) > SORT_BYTES and (len(begun) or (held and held[-1][0][-1] != part[0][0])):
                k = int(begun[-1]) + 1 if len(begun) else 0  # the last val may go on
                b = int(part[2][:k].sum())
                yield flush([*held, (part[0][:k], part[1][:b], part[2][:k], part[3][:k], part[4][:k])])
                part = (part[0][k:], part[1][b:], part[2][k:], part[3][k:], part[4][k:])
                held, pending = [], 0
            held.append(part)
            pending += len(part[1])
    if held:
        yield flush(held)


KEPT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<lo:int,hi:int>>"


def _remove(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(it):
        data, offsets = buffers(column(batch, "text"))
        covers = column(batch, "covers")
        out: dict[str, list] = {k: [] for k in ("n_bytes", "n_removed", "n_spans", "kept_sha256", "spans")}
        for i in range(batch.num_rows):
            text = data[offsets[i] : offsets[i + 1]]
            got = covers[i].values
            spans = []
            if got is not None and len(got):
                lo, hi = np.asarray(got.field("lo")), np.asarray(got.field("hi"))
                by = np.argsort(lo, kind="stable")
                lo, hi = lo[by], np.maximum.accumulate(hi[by])
                cut_ = np.append(True, lo[1:] > hi[:-1])
                spans = list(zip(lo[cut_].tolist(), hi[np.append(np.flatnonzero(cut_)[1:] - 1, len(lo) - 1)].tolist(), strict=True))
            digest, at, gone = hashlib.sha256(), 0, 0
            for a, b in spans:
                b = min(b, len(text))
                digest.update(text[at:a].tobytes())
                at, gone = b, gone + b - a
            digest.update(text[at:].tobytes())
            for k, x in zip(out, (len(text), gone, len(spans), digest.hexdigest(), [{"lo": a, "hi": b} for a, b in spans]), strict=True):
                out[k].append(x)
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("lo", pa.int32()), ("hi", pa.int32())])))
        yield pa.RecordBatch.from_arrays([column(batch, "doc_id"), *[pa.array(x, k) for x, k in zip(out.values(), kinds, strict=True)]], names=["doc_id", *out])


def identified(docs: DataFrame) -> tuple[DataFrame, bool]:
    """doc_id, text and id, a number that rises with (doc_id, hash of the text) and is the doc_id itself where those are unique; and whether they are."""
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    clash = docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("c")).where("c > 1 OR doc_id IS NULL")
    if clash.isEmpty():
        # no null among them; said so, both joins ask for the same rows of one exchange
        return docs.select("doc_id", F.coalesce("doc_id", F.lit(0)).alias("id"), "text"), True
    docs = docs.withColumn("_tie", F.xxhash64("text"))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = docs.select("doc_id", "_tie").distinct().repartitionByRange(parts, "doc_id", "_tie").sortWithinPartitions("doc_id", "_tie")
    number = cut(ordered.select(F.col("doc_id").alias("_id"), F.col("_tie").alias("_of"), F.monotonically_increasing_id().alias("id")))
    return docs.join(number, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_tie") == F.col("_of"))).select("doc_id", "id", "text"), False


def dedup(docs: DataFrame, hot: int = HOT) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and the removed spans of every row of docs."""
    docs, unique = identified(docs)
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    searched = docs if unique else docs.dropDuplicates(["id"])
    found = searched.select("id", "text").mapInArrow(_chunk_rows, CHUNKS).repartition(parts, "val").sortWithinPartitions("val")
    found = found.mapInArrow(_repeated(hot), CHUNKS + ", is_hot boolean")
    asked = found.repartition(parts, "id").groupBy("id").agg(F.collect_list(F.struct("val", "start", "size", "is_hot")).alias("asked"))
    # one exchange of the texts serves the fetch of chunks and the removal, so both ask for the same columns
    dealt = docs.repartition(parts, "id")
    once = dealt if unique else searched.repartition(parts, "id")
    fetched = once.join(asked.hint("shuffle_hash"), "id").select("doc_id", "id", "text", "asked")
    chunk = fetched.mapInArrow(_chunk_bytes, "val long, chunk binary, id long, start int")
    covers = chunk.repartition(parts, "val").sortWithinPartitions("val", "chunk", "id", "start").mapInArrow(_sorted_chunks, COVERS)
    by_doc = covers.repartition(parts, "id").groupBy("id").agg(F.collect_list(F.struct("lo", "hi")).alias("covers"))
    return dealt.join(by_doc.hint("shuffle_hash"), "id", "left").select("doc_id", "text", "covers").mapInArrow(_remove, KEPT)


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


SQL = {
    "op1_suffix_dedup": """
WITH b AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS hx, strlen(coalesce(text, '')) AS n FROM documents),
w AS (SELECT doc_id, unnest(range(0, n - 99)) AS s, md5(unnest([substr(hx, 2 * i + 1, 200) for i in range(0, n - 99)])) AS h FROM b WHERE n >= 100),
u AS (SELECT doc_id, s FROM (SELECT *, row_number() OVER (PARTITION BY h ORDER BY doc_id, s) AS rn FROM w) WHERE rn > 1),
i AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY s) AS span FROM (SELECT *, CASE WHEN s - lag(s) OVER (PARTITION BY doc_id ORDER BY s) <= 100 THEN 0 ELSE 1 END AS new FROM u)),
v AS (SELECT doc_id, min(s) AS lo, max(s) + 100 AS hi FROM i GROUP BY doc_id, span),
g AS (SELECT *, coalesce(lag(hi) OVER (PARTITION BY doc_id ORDER BY lo), 0) AS prev FROM v),
k AS (SELECT g.doc_id, sum(hi - lo)::BIGINT AS n_removed, count(*) AS n_spans, max(hi) AS last, string_agg(substr(hx, 2 * prev + 1, 2 * (lo - prev)), '' ORDER BY lo) AS kept FROM g JOIN b USING (doc_id) GROUP BY g.doc_id)
SELECT b.doc_id, b.n::BIGINT AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
       sha256(unhex(coalesce(kept, '') || substr(hx, 2 * coalesce(last, 0) + 1))) AS kept_sha256
FROM b LEFT JOIN k USING (doc_id)
"""
}
