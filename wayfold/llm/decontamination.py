"""Benchmark decontamination: CGK embedding, bit-sampling LSH over windows, edit verification.

Texts and items are sequences of tokens (runs of letters, digits and non-ASCII bytes, A-Z as
a-z). A CGK walk reads a sequence from a start: at step j it puts out the token it stands on
and moves on one token or stays, by a hash bit of (walk, j, token). Two sequences at a small
edit distance agree in most places of their outputs, since walks that an edit put out of
step tend to meet again. Each of WALKS repetitions samples SAMPLES places of the output, the
first always; the sampled tokens are the LSH key.

Items are embedded from several starts (STARTS even stretches, the rarest token of each), the
texts from every token on, so an item-sized window is found by any stretch of it that was left as it was;
a window whose first token starts no item is out at once, and the others are followed from
sample to sample only as long as the samples are the beginning of some item's key.

Items of MIN_TOKENS to SHORT tokens leave a walk too little room: with a fifth of five tokens edited a walk
meets the edit more often than not. They are cut into limit + 1 pieces instead, one of which must stand unedited
(pigeonhole), so that none is missed. Longer ones are found with a recall of 0.9 at least at the full number of
edits (a test measures it for lengths up to 120).

Each hit fixes where the item would lie. Its edit distance there (in tokens, semi-global:
the best substring of the place with a margin) is computed exactly, bit-parallel. The item
is found if the distance is at most MAX_EDITS of its tokens.

The benchmark is the stated query set; it is read in blocks of ITEM_BLOCK items, each sent to
the tasks as one closure of bounded size, against all documents. Nothing of the documents
is gathered.

Edge cases: null or empty texts and items without tokens match nothing; items of fewer than
MIN_TOKENS tokens must appear exactly; repeated items and documents give a row each; a null
doc_id is carried; empty tables give empty results; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfold.llm.common import table
from wayfold.llm.textnp import PUNCT, buffers, column, combine, hashes, mix, slices, spans

MAX_EDITS = 0.2
WALKS, SAMPLES, STEPS, STARTS = 8, 5, 9, 6
MIN_TOKENS, SHORT = 5, 14
ITEM_BLOCK = 5000


def tokens(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Token hashes of all texts and the offsets of each text's."""
    data, offsets = buffers(col)
    start, end, doc = spans(data, offsets, PUNCT)
    size = np.bincount(doc, minlength=len(offsets) - 1)
    return hashes(data, start, end), np.concatenate(([0], np.cumsum(size)))


def sampled(walk: int, steps: int, samples: int) -> np.ndarray:
    """The sampled places of a walk's output: 0 and random later ones."""
    rng = np.random.Generator(np.random.PCG64([walk, steps, 91]))
    later = rng.permutation(np.arange(1, steps))[: max(0, min(samples, steps) - 1)]
    return np.concatenate(([0], np.sort(later)))


def _move(walk: int, j: int, token: np.ndarray) -> np.ndarray:
    return (mix(token ^ np.uint64((walk * 1009 + j + 1) * 0x9E3779B97F4A7C15 % 2**64)) & np.uint64(1)).astype(np.int64)


def _extend(key: np.ndarray, token: np.ndarray) -> np.ndarray:
    return mix(key * np.uint64(0x9E3779B97F4A7C15) + token)


class Index:
    """LSH keys of a block of items, by walk and number of samples."""

    def __init__(self, items: list[tuple[int, str | None]], max_edits: float = MAX_EDITS, walks: int = WALKS, samples: int = SAMPLES, steps: int = STEPS, starts: int = STARTS) -> None:
        self.walks, self.samples = walks, samples
        h, at = tokens(pa.array([t for _, t in items], pa.string()))
        self.ids = [i for i, _ in items]
        self.item = [h[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]
        data, offsets = buffers(pa.array([t for _, t in items], pa.string()))
        begin, end, _ = spans(data, offsets, PUNCT)
        _, of, count = np.unique(h, return_inverse=True, return_counts=True)
        common = count[of] * 1000 - np.minimum(end - begin, 99)  # of equally frequent tokens the longer is rarer in texts
        self.common = np.split(common, at[1:-1]) if len(items) else []
        self.classes = []
        self.pieces = self._cut([k for k, x in enumerate(self.item) if MIN_TOKENS <= len(x) <= SHORT], max_edits)
        # items that must appear exactly have short walks, so that no walk leaves its item
        for low, high in ((1, MIN_TOKENS), (SHORT + 1, 1 << 40)):
            some = [k for k, x in enumerate(self.item) if low <= len(x) < high]
            if some:
                self.classes.append(self._built(some, min(steps, low), starts))

    def _cut(self, some: list[int], max_edits: float) -> dict[int, tuple[np.ndarray, np.ndarray]]:
        """By length of pieces: their sorted hashes, and the item and place of each."""
        found: dict[int, list[tuple[int, int, int]]] = {}
        for k in some:
            n = len(self.item[k])
            ends = np.linspace(0, n, int(max_edits * n) + 2).astype(int)
            for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
                found.setdefault(b - a, []).append((int(combine(*self.item[k][a:b, None])[0]), k, a))
        out = {}
        for size, rows in found.items():
            rows.sort()
            out[size] = (np.array([r[0] for r in rows], np.uint64), np.array([r[1:] for r in rows]))
        return out

    def _starts(self, k: int, steps: int, starts: int) -> list[int]:
        """One start in each of starts even stretches of an item: the token that is rarest in the benchmark, so few windows begin like it."""
        room = max(0, len(self.item[k]) - steps) + 1
        return [int(part[np.argmin(self.common[k][part])]) for part in np.array_split(np.arange(room), starts) if len(part)]

    def _built(self, some: list[int], steps: int, starts: int) -> dict:
        places = sorted({(k, s) for k in some for s in self._starts(k, steps, starts)})
        flat = np.concatenate([self.item[k][s : s + steps] for k, s in places])
        base = np.concatenate(([0], np.cumsum([min(steps, len(self.item[k]) - s) for k, s in places])))[:-1]
        out = {"steps": steps, "places": np.array(places), "walks": []}
        for walk in range(self.walks):
            last = len(flat)
            stop = np.append(base[1:], last) - 1
            keys, full = self._follow(walk, steps, flat, base, stop, None)
            by = np.argsort(full, kind="stable")
            out["walks"].append({"prefix": [np.unique(k) for k in keys], "key": full[by], "place": by})
        first = np.unique(flat[base])
        mask = np.zeros(1 << 16, bool)
        mask[(first & np.uint64(0xFFFF)).astype(np.int64)] = True
        out["first"], out["mask"] = first, mask
        return out

    def _follow(self, walk: int, steps: int, x: np.ndarray, at: np.ndarray, stop: np.ndarray, prefix: list | None):
        """The walk from all places at once; with prefix, only places whose samples begin some key go on."""
        key, keys, alive = np.zeros(len(at), np.uint64), [], np.arange(len(at))
        places = set(sampled(walk, steps, self.samples).tolist())
        last = max(places)
        for j in range(last + 1):
            token = x[at]
            if j in places:
                key = _extend(key, token)
                if prefix is None:
                    keys.append(key)
                else:
                    wanted = prefix[len(keys)]
                    keys.append(None)
                    ok = wanted[np.minimum(np.searchsorted(wanted, key), len(wanted) - 1)] == key
                    alive, at, stop, key, token = alive[ok], at[ok], stop[ok], key[ok], token[ok]
            if j < last:
                at = np.minimum(at + _move(walk, j, token), stop)
        return (keys, key) if prefix is None else (alive, key)

    def hits(self, x: np.ndarray, offsets: np.ndarray) -> set[tuple[int, int, int]]:
        """(text, item, where the item would start in the text) of all key matches."""
        found = set()
        for size, (keys, places) in self.pieces.items():
            at = np.arange(max(0, len(x) - size + 1))
            doc = np.searchsorted(offsets, at, "right") - 1
            at, doc = at[at + size <= offsets[doc + 1]], doc[at + size <= offsets[doc + 1]]
            key = combine(*[x[at + i] for i in range(size)]) if len(at) else np.zeros(0, np.uint64)
            lo, hi = np.searchsorted(keys, key), np.searchsorted(keys, key, "right")
            for a in np.flatnonzero(hi > lo).tolist():
                for item, start in places[lo[a] : hi[a]].tolist():
                    found.add((int(doc[a]), item, int(at[a] - offsets[doc[a]] - start)))
        for c in self.classes:
            maybe = np.flatnonzero(c["mask"][(x & np.uint64(0xFFFF)).astype(np.int64)])
            maybe = maybe[np.isin(x[maybe], c["first"])]
            doc = np.searchsorted(offsets, maybe, "right") - 1
            for walk, w in enumerate(c["walks"]):
                alive, key = self._follow(walk, c["steps"], x, maybe, offsets[doc + 1] - 1, w["prefix"])
                lo, hi = np.searchsorted(w["key"], key), np.searchsorted(w["key"], key, "right")
                for a, l, r in zip(alive.tolist(), lo.tolist(), hi.tolist(), strict=True):
                    for place in w["place"][l:r].tolist():
                        item, start = c["places"][place]
                        found.add((int(doc[a]), int(item), int(maybe[a] - offsets[doc[a]] - start)))
        return found


def best_distance(item: list[int], text: list[int], limit: int) -> tuple[int, int]:
    """Least edit distance of item to a substring of text, and where that substring ends (bit-parallel)."""
    n = len(item)
    where: dict[int, int] = {}
    for i, t in enumerate(item):
        where[t] = where.get(t, 0) | 1 << i
    up, down, top, best, end = (1 << n) - 1, 0, 1 << n - 1, n, 0
    score, mask = n, (1 << n) - 1
    for j, t in enumerate(text):
        eq = where.get(t, 0)
        d0 = (((eq & up) + up) ^ up) | eq | down
        hp = down | ~(d0 | up) & mask
        hn = up & d0
        score += bool(hp & top) - bool(hn & top)
        hp, hn = hp << 1 & mask, hn << 1 & mask
        up, down = hn | ~(d0 | hp) & mask, hp & d0
        if score < best:
            best, end = score, j + 1
            if best == 0:
                break
    return best, end


def _matches(items: list[tuple[int, str | None]], max_edits: float):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(items, max_edits)
        lists = [x.tolist() for x in index.item]
        for batch in slices(it):
            x, offsets = tokens(column(batch, "text"))
            best: dict[tuple[int, int], tuple[int, int]] = {}
            for doc, item, start in sorted(index.hits(x, offsets)):
                n = len(lists[item])
                limit = int(max_edits * n) if n >= MIN_TOKENS else 0
                if best.get((doc, item), (n,))[0] == 0:
                    continue
                a, b = offsets[doc] + max(0, start - limit), min(offsets[doc] + start + n + limit, offsets[doc + 1])
                d, end = best_distance(lists[item], x[a:b].tolist(), limit)
                if d <= limit and d < best.get((doc, item), (n + 1,))[0]:
                    best[doc, item] = (d, int(a - offsets[doc]) + end)
            ids = column(batch, "doc_id").to_pylist()
            rows = [(ids[doc], index.ids[item], len(lists[item]), d, end) for (doc, item), (d, end) in best.items()]
            cols = list(zip(*rows, strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in cols], names=["doc_id", "item_id", "item_tokens", "edits", "end_token"])

    return run


def _blocks(benchmark: DataFrame, size: int) -> Iterator[list[tuple[int, str | None]]]:
    block: list = []
    for row in benchmark.select("item_id", "text").toLocalIterator():
        block.append((row[0], row[1]))
        if len(block) == size:
            yield block
            block = []
    if block:
        yield block


def contaminated(docs: DataFrame, benchmark: DataFrame, max_edits: float = MAX_EDITS, item_block: int = ITEM_BLOCK) -> DataFrame:
    """doc_id, item_id, item_tokens, edits, end_token: the benchmark items found in each row of docs."""
    schema = "doc_id long, item_id long, item_tokens long, edits long, end_token long"
    out = docs.sparkSession.createDataFrame([], schema)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    for block in _blocks(benchmark, item_block):
        out = out.unionByName(rows.mapInArrow(_matches(block, max_edits), schema))
    return out


def clean(docs: DataFrame, benchmark: DataFrame, max_edits: float = MAX_EDITS) -> DataFrame:
    """The rows of docs in which no benchmark item was found, with all columns."""
    names = docs.columns

    def keep(block):
        def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index = Index(block, max_edits)
            lists = [x.tolist() for x in index.item]
            for batch in slices(it):
                x, offsets = tokens(column(batch, "text"))
                bad = np.zeros(batch.num_rows, bool)
                for doc, item, start in index.hits(x, offsets):
                    n = len(lists[item])
                    limit = int(max_edits * n) if n >= MIN_TOKENS else 0
                    if not bad[doc]:
                        a, b = offsets[doc] + max(0, start - limit), min(offsets[doc] + start + n + limit, offsets[doc + 1])
                        bad[doc] = best_distance(lists[item], x[a:b].tolist(), limit)[0] <= limit
                yield batch.filter(pa.array(~bad))

        return run

    for block in _blocks(benchmark, ITEM_BLOCK):
        docs = docs.mapInArrow(keep(block), docs.schema)
    return docs.select(*[f"`{c}`" for c in names])


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
