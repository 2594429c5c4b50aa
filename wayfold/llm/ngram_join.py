"""N-gram Jaccard self-join by parity sketches, and the components of its links.

A document is its set of distinct k-word shingles (64-bit hashes). Two documents link if
|A & B| / |A | B| is at least NUM / DEN.

1. Documents with equal sets are one class from the start (groups of copies collapse).
2. Sizes fall into bands. A document takes part in its own band and in the next, if a
   partner that is larger by what the threshold allows can lie there. In a band whose
   largest size is m, linked sets differ in d = floor(2m(DEN - NUM) / (DEN + NUM)) shingles at most.
   A document's parity sketch is the XOR of one bit per shingle, of 2^64 bits: the Hamming
   distance of two sketches is at most the symmetric difference of the sets. It is cut by hash
   into nb = d + 1 + s blocks, and a block is told by a 64-bit digest that is linear in it (the XOR
   of a word per odd bit). Each differing shingle falls into one block, so linked sets have
   equal sketches in s + 1 blocks at least (pigeonhole).
3. (band, block, digest) keys are dealt and sorted by Spark; one pass streams over them and
   keeps the keys held by two classes or more, with the number of classes (up to HOT + 1).
4. In one total order of all keys (empty blocks, then the most frequent first) every class
   leaves out its first s keys of a band. Of the s + 1 blocks or more that linked sets share the
   last one in that order has s shared ones before it, so neither document leaves it out:
   common passages cost nothing unless a document is made of them, and no link is lost.
5. A key's leader is its class with most keys. Every class is compared with the leader that it
   shares most keys with; links so found are joined into components. Where a key still holds
   several components, one class of each is compared with the key's largest component; only
   what is open then is compared across components. So a large group of near copies costs a
   comparison or a few for each member, not for each pair, and no link between components is lost.
6. A comparison first asks sizes and 256-bit parity sketches of the whole sets, whose
   Hamming distance is at most the symmetric difference, between components also 4096-bit
   ones, then the sets themselves. Between components the sketches meet in blocks of BLOCK
   classes, so a pair that they tell apart is never a row; looking at them stays quadratic in
   the open classes of a key.

Edge cases: a null or empty text has no shingles, links with nothing and is its own
component; with fewer than k words the whole sequence is the one shingle; repeated rows
are documents with equal sets; a null doc_id forms no component of its own (its component
is that of its equals, or null); an empty table gives an empty result; other columns are
ignored. Sets are told apart by 64-bit hashes of shingles and by (size, 64-bit sum).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from wayfold.llm.common import cut, table
from wayfold.llm.components import components
from wayfold.llm.textnp import buffers, column, combine, hashes, mix, signed, slices, spans
from wayfold.sources.shared import drop, release, stored

#: Keys of more classes than this count as equally frequent; so many rows of a key are held.
HOT = 64
#: Rounds in which one class of each component of a key is compared, before all open ones are.
ROUNDS = 1
ONE = np.uint64(1)
BAND_BITS = np.uint64(8)
#: So many ids (8 bytes each) are broadcast at most; more are joined by a shuffle.
BROADCAST_IDS = 200_000
#: Partners of one class that are compared in one place.
SALT = 100


class Bands:
    """Sizes to bands and blocks, for shingles of k words and the threshold num / den."""

    def __init__(self, k: int = 3, num: int = 90, den: int = 100) -> None:
        self.k, self.num, self.den = k, num, den
        top, tops = 1, []
        while top < 1 << 31:
            tops.append(top)
            top = max(top + 1, int(top * (den / num) ** 2))
        self.tops = np.array(tops, np.int64)  # the largest size of each band
        self.d = 2 * self.tops * (den - num) // (den + num)
        self.slack = -(-self.d // 5) + 1
        self.blocks = self.d + 1 + self.slack

    def of(self, size: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.tops, size)


def shingle_sets(col: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of all texts, sorted within each, and the number of each text's."""
    data, offsets = buffers(col)
    start, end, doc = spans(data, offsets)
    h = hashes(data, start, end)
    n = len(offsets) - 1
    size = np.bincount(doc, minlength=n)
    full = np.arange(len(h))[: max(0, len(h) - k + 1)]
    full = full[doc[full] == doc[full + k - 1]] if len(full) else full
    sh = combine(*[h[full + i] for i in range(k)]) if len(full) else np.zeros(0, np.uint64)
    of = doc[full]
    first = np.cumsum(size) - size
    few = np.flatnonzero((size > 0) & (size < k))
    if len(few):  # the whole sequence is the shingle
        own = np.array([combine(*[h[first[d] + i : first[d] + i + 1] for i in range(size[d])])[0] ^ np.uint64(size[d]) for d in few], np.uint64)
        sh, of = np.concatenate((sh, own)), np.concatenate((of, few))
    order = np.lexsort((sh, of))
    sh, of = sh[order], of[order]
    new = np.ones(len(sh), bool)
    new[1:] = (sh[1:] != sh[:-1]) | (of[1:] != of[:-1])
    return sh[new], np.bincount(of[new], minlength=n)


def _segments(x: np.ndarray, sizes: np.ndarray, op: np.ufunc) -> np.ndarray:
    """op over each text's part of x; 0 for empty ones."""
    out = np.zeros(len(sizes), np.uint64)
    some = np.flatnonzero(sizes)
    if len(some):
        out[some] = op.reduceat(x, (np.cumsum(sizes) - sizes)[some])
    return out


def class_of(sh: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    return mix(_segments(mix(sh ^ np.uint64(0xA5A5A5A55A5A5A5A)), sizes, np.add) + sizes.astype(np.uint64))


CLASSES = "doc_id long, n long, cls long, s0 long, s1 long, s2 long, s3 long"


def _classes(k: int):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(it):
            sh, sizes = shingle_sets(column(batch, "text"), k)
            bit = mix(sh ^ np.uint64(0x1F83D9ABFB41BD6B))
            parity = []
            for j in range(4):
                here = ((bit >> np.uint64(6)) & np.uint64(3)) == j
                parity.append(_segments(np.where(here, ONE << (bit & np.uint64(63)), np.uint64(0)), sizes, np.bitwise_xor))
            cols = [column(batch, "doc_id"), pa.array(sizes.astype(np.int64)), pa.array(signed(class_of(sh, sizes))), *[pa.array(signed(p)) for p in parity]]
            yield pa.RecordBatch.from_arrays(cols, names=[c.split()[0] for c in CLASSES.split(", ")])

    return run


def block_keys(sh: np.ndarray, sizes: np.ndarray, cls: np.ndarray, bands: Bands) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Key (its first BAND_BITS are the band), class, and the number of keys that the class leaves out in that band.

    Empty blocks are the first in the order of keys, those of low number before others: they are left
    out as far as the slack goes, and what it has left is for the most frequent of the filled ones.
    """
    deal = mix(sh ^ np.uint64(0x5BE0CD19137E2179))
    word = mix(sh ^ np.uint64(0x9B05688C2B3E6C1F))
    own = bands.of(sizes)
    out = []
    for step in range(3):  # the own band and, where a larger partner can lie, the next ones
        band = np.minimum(own + step, len(bands.tops) - 1)
        lowest = np.where(step == 0, 0, bands.tops[np.maximum(band - 1, 0)] + 1)
        docs = (sizes > 0) & (sizes * bands.den >= lowest * bands.num) & (own + step < len(bands.tops)) & (bands.d[band] > 0)
        if not docs.any():
            continue
        take = np.repeat(docs, sizes)
        doc = np.repeat(np.arange(len(sizes)), sizes)[take]
        blocks = np.where(docs, bands.blocks[band], 0)
        block = ((deal[take] >> np.uint64(32)) * blocks[doc].astype(np.uint64)) >> np.uint64(32)
        first = np.cumsum(blocks) - blocks
        cell = first[doc] + block.astype(np.int64)
        order = np.argsort(cell, kind="stable")
        filled, at = np.unique(cell[order], return_index=True)
        owner = np.repeat(np.arange(len(sizes)), blocks)
        digest = np.zeros(len(owner), np.uint64)
        digest[filled] = np.bitwise_xor.reduceat(word[take][order], at)
        has = np.zeros(len(owner), bool)
        has[filled] = True
        gone = np.cumsum(~has)  # empty blocks up to each one, then of its own document
        gone -= np.concatenate(([0], gone))[first[owner]]
        slack = bands.slack[band]
        cells = np.flatnonzero(has | (gone > slack[owner]))
        who = owner[cells]
        spare = np.maximum(slack - (blocks - np.bincount(owner[filled], minlength=len(sizes))), 0)
        key = combine(band[who].astype(np.uint64), (cells - first[who]).astype(np.uint64), digest[cells])
        key = (key >> BAND_BITS) | (band[who].astype(np.uint64) << (np.uint64(64) - BAND_BITS))
        out.append((key, cls[who], spare[who].astype(np.int32)))
    if not out:
        z = np.zeros(0, np.uint64)
        return z, z, z.astype(np.int32)
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _emit_keys(bands: Bands):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()  # classes of this task so far
        for batch in slices(it):
            sh, sizes = shingle_sets(column(batch, "text"), bands.k)
            cls = class_of(sh, sizes)
            first = np.zeros(len(cls), bool)
            for i, c in enumerate(cls.tolist()):
                if c not in seen:
                    seen.add(c)
                    first[i] = True
            sh, sizes, cls = sh[np.repeat(first, sizes)], sizes[first], cls[first]
            key, who, spare = block_keys(sh, sizes, cls, bands)
            yield pa.RecordBatch.from_arrays([pa.array(signed(key)), pa.array(signed(who)), pa.array(spare)], names=["key", "cls", "spare"])

    return run


def _runs(key: np.ndarray) -> np.ndarray:
    """Where each run of equal values begins, and the end."""
    return np.concatenate(([0], np.flatnonzero(key[1:] != key[:-1]) + 1, [len(key)]))


SHARED = "key long, cls long, spare int, held int"


def _shared_keys(hot: int):
    """Rows of keys with two classes or more, from rows sorted by (key, cls), each class once; held: the classes of the key, up to hot + 1.

    At most hot rows of a key are held; the rows of a key with more go straight through.
    """

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # rows of the last key, which may go on
        open_hot = last = None  # a key known to be hot, and the class that came last in it

        def out(rows: list[np.ndarray], classes: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(rows[0]), pa.array(rows[1]), pa.array(rows[2], pa.int32()), pa.array(np.minimum(classes, hot + 1), pa.int32())], names=["key", "cls", "spare", "held"])

        for batch in it:
            rows = [np.asarray(column(batch, c)) for c in ("key", "cls", "spare")]
            if held is not None:
                rows = [np.concatenate((h, r)) for h, r in zip(held, rows, strict=True)]
                held = None
            new = np.ones(len(rows[0]), bool)
            new[1:] = (rows[0][1:] != rows[0][:-1]) | (rows[1][1:] != rows[1][:-1])
            if open_hot is not None and len(new):
                new[0] = rows[0][0] != open_hot or rows[1][0] != last
            rows = [r[new] for r in rows]
            if open_hot is not None and len(rows[0]):
                differs = rows[0] != open_hot
                n = int(np.argmax(differs)) if differs.any() else len(differs)
                if n:
                    yield out([r[:n] for r in rows], np.full(n, hot + 1))
                    last = rows[1][n - 1]
                    rows = [r[n:] for r in rows]
            if not len(rows[0]):
                continue
            open_hot = None
            at = _runs(rows[0])
            size = np.repeat(np.diff(at), np.diff(at))
            whole = np.arange(len(size)) < at[-2]  # all but the last key
            keep = whole & (size > 1)
            yield out([r[keep] for r in rows], size[keep])
            held = [r[at[-2] :] for r in rows]
            if len(held[0]) > hot:
                yield out(held, np.full(len(held[0]), hot + 1))
                open_hot, last, held = held[0][0], held[1][-1], None
        if held is not None and len(held[0]) > 1:
            yield out(held, np.full(len(held[0]), len(held[0])))

    return run


def _thinned(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """key, cls, shares from rows sorted by cls: without the first keys of each class and band (4. above); shares counts what stays.

    The rows of one class are held: as many as its document has blocks.
    """
    held = None

    def done(rows: list[np.ndarray]) -> pa.RecordBatch:
        key, cls, spare, many = rows
        band = (key.view(np.uint64) >> (np.uint64(64) - BAND_BITS)).astype(np.int64)
        order = np.lexsort((key, -many, band, cls))
        key, cls, spare, band = key[order], cls[order], spare[order], band[order]
        first = np.ones(len(key), bool)
        first[1:] = (cls[1:] != cls[:-1]) | (band[1:] != band[:-1])
        begin = np.flatnonzero(first)
        place = np.arange(len(key)) - np.repeat(begin, np.diff(np.append(begin, len(key))))
        keep = place >= spare
        key, cls = key[keep], cls[keep]
        at = _runs(cls) if len(cls) else np.zeros(1, np.int64)
        shares = np.repeat(np.diff(at), np.diff(at))
        return pa.RecordBatch.from_arrays([pa.array(key), pa.array(cls), pa.array(shares.astype(np.int32))], names=["key", "cls", "shares"])

    for batch in it:
        rows = [np.asarray(column(batch, c)) for c in ("key", "cls", "spare", "held")]
        if held is not None:
            rows = [np.concatenate((h, r)) for h, r in zip(held, rows, strict=True)]
        if not len(rows[0]):
            continue
        at = _runs(rows[1])
        if len(at) > 2:
            yield done([r[: at[-2]] for r in rows])
        held = [r[at[-2] :] for r in rows]
    if held is not None:
        yield done(held)


def _led(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """key, cls, lead from rows sorted by (key, shares and cls falling): the first of a key leads the others; it gets no row if it is alone."""
    at = lead = None
    for batch in it:
        key, cls = np.asarray(column(batch, "key")), np.asarray(column(batch, "cls"))
        if not len(key):
            continue
        begin = _runs(key)
        leads = cls[begin[:-1]]
        if key[0] == at:
            leads = np.concatenate(([lead], leads[1:]))
        every = np.repeat(leads, np.diff(begin))
        at, lead = key[-1], every[-1]
        yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(cls), pa.array(every)], names=["key", "cls", "lead"])


def _compared(bands: Bands):
    """x, y of linked pairs, from rows (x, salt, y, text) sorted so that the leader's own row (y null) comes first."""

    def sets(batch: pa.RecordBatch):
        sh, sizes = shingle_sets(column(batch, "text"), bands.k)
        return np.split(sh, np.cumsum(sizes)[:-1]), class_of(sh, sizes)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, lead = None, None
        for batch in slices(it):
            found, own = sets(batch)
            out: list[tuple[int, int]] = []
            rows = zip(column(batch, "x").to_pylist(), column(batch, "salt").to_pylist(), column(batch, "y").to_pylist(), found, own.tolist(), strict=True)
            for x, salt, y, sh, cls in rows:
                # a repeated doc_id may bring other texts along; the set must be of the class asked for
                if np.int64(x if y is None else y).view(np.uint64) != np.uint64(cls):
                    continue
                if y is None:
                    at, lead = (x, salt), sh
                elif at == (x, salt):
                    both = len(np.intersect1d(lead, sh, assume_unique=True))
                    if both * (bands.den + bands.num) >= (len(lead) + len(sh)) * bands.num:
                        out.append((x, y))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], pa.int64()) for i in range(2)], names=["x", "y"])

    return run


#: Bits of the wide sketch; a few thousand differing shingles still tell in it.
WIDE = 4096
#: So many classes of a key, about, are held against as many others in one place.
BLOCK = 2048


def _wide_rows(k: int):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(it):
            sh, sizes = shingle_sets(column(batch, "text"), k)
            right = class_of(sh, sizes) == np.asarray(column(batch, "cls")).view(np.uint64)
            n = len(sizes)
            cell = np.repeat(np.arange(n), sizes) * WIDE + (mix(sh ^ np.uint64(0x510E527FADE682D1)) % np.uint64(WIDE)).astype(np.int64)
            parity = np.packbits(np.bincount(cell, minlength=n * WIDE) & 1).view(np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * (WIDE // 64), pa.int32()), pa.array(parity))
            yield pa.RecordBatch.from_arrays([column(batch, "cls").filter(pa.array(right)), lists.filter(pa.array(right))], names=["cls", "wide"])

    return run


def _texts_of(ids: DataFrame, docs: DataFrame) -> DataFrame:
    """docs joined with rows of ids (doc_id and more); ids are broadcast if they are few."""
    ids = cut(ids)
    return docs.select("doc_id", "text").join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, "doc_id")


MET = "key long, i int, j int, part int, cls long, comp long, n long, s0 long, s1 long, s2 long, s3 long"


def _near(bands: Bands, wide: bool):
    """Classes of different components whose sizes and sketches allow a link, from rows MET sorted by (key, i, j).

    Rows of part i meet those of part j, or one another where i is j; some 2 BLOCK rows are held. By the narrow sketches alone
    the rows that have a partner are told; with a column wide, the pairs x, y.
    """
    gap, both = bands.den - bands.num, bands.den + bands.num
    names = [c.split()[0] for c in MET.split(", ")]

    def met(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        _, i, j, part, _, comp, n = rows[:7]
        a, b = np.flatnonzero(part == i[0]), np.flatnonzero(part == j[0])
        sketches = (np.stack(rows[7:11], 1), *rows[11:])
        found = [(a[:0], b[:0])]
        for start in range(0, len(a), 128):
            c = a[start : start + 128]
            most, least = np.maximum(n[c][:, None], n[b]), np.minimum(n[c][:, None], n[b])
            x, y = np.nonzero((comp[c][:, None] != comp[b]) & (least * bands.den >= most * bands.num))
            x, y = c[x], b[y]
            for sketch in sketches:
                passed = [np.zeros(0, bool)]
                for at in range(0, len(x), 1 << 14):
                    p, q = x[at : at + (1 << 14)], y[at : at + (1 << 14)]
                    bits = np.bitwise_count((sketch[p] ^ sketch[q]).view(np.uint64)).sum(1, dtype=np.int64)  # of signed numbers it counts the absolute value
                    passed.append(bits * both <= (n[p] + n[q]) * gap)
                ok = np.concatenate(passed)
                x, y = x[ok], y[ok]
            found.append((x, y))
        return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])

    def out(groups: list[list[np.ndarray]]) -> pa.RecordBatch:
        if wide:
            pairs = [np.sort(np.stack([rows[4][k] for k in met(rows)], 1), 1) for rows in groups]
            every = np.unique(np.concatenate(pairs), axis=0)
            return pa.RecordBatch.from_arrays([pa.array(every[:, 0]), pa.array(every[:, 1])], names=["x", "y"])
        some = [[r[at] for r in rows] for rows in groups for at in [np.unique(np.concatenate(met(rows)))]]
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*some, strict=True)], names=names)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # rows of the last (key, i, j), which may go on
        for batch in it:
            if not batch.num_rows:
                continue
            rows = [np.asarray(column(batch, c)) for c in names]
            if wide:
                rows.append(np.asarray(column(batch, "wide").flatten()).reshape(-1, WIDE // 64))
            if held is not None:
                rows = [np.concatenate((h, r)) for h, r in zip(held, rows, strict=True)]
            new = (rows[0][1:] != rows[0][:-1]) | (rows[1][1:] != rows[1][:-1]) | (rows[2][1:] != rows[2][:-1])
            at = np.concatenate(([0], np.flatnonzero(new) + 1))
            if len(at) > 1:
                yield out([[r[p:q] for r in rows] for p, q in zip(at[:-1], at[1:], strict=True)])
            held = [r[at[-1] :] for r in rows]
        if held is not None:
            yield out([held])

    return run


def _across(open_: DataFrame, classes: DataFrame, docs: DataFrame, bands: Bands) -> DataFrame:
    """x, y of classes of different components in one key (rows key, cls, comp) whose sizes and sketches allow a link, cut.

    A key's classes are dealt into parts of some BLOCK, each two of which meet in one place: a row goes there
    once for every BLOCK classes of its key. Rows without a partner by the narrow sketches go before the wide ones are asked.
    """
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    many = open_.groupBy("key").agg(F.expr(f"cast(1 + (count(1) - 1) div {BLOCK} as int)").alias("many"))
    dealt = open_.join(many, "key").withColumn("part", F.expr("cast(pmod(xxhash64(cls), many) as int)"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("many") - 1)))
    dealt = dealt.select("key", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), "part", "cls", "comp")
    rows = dealt.join(classes, "cls").select(*[c.split()[0] for c in MET.split(", ")])

    def placed(rows: DataFrame) -> DataFrame:
        return rows.repartition(parts, "key", "i", "j").sortWithinPartitions("key", "i", "j")

    some = cut(placed(rows).mapInArrow(_near(bands, False), MET))
    asked = some.select("cls").distinct().join(classes.select("cls", F.col("rep").alias("doc_id")), "cls")
    wide = _texts_of(asked, docs).select("cls", "text").mapInArrow(_wide_rows(bands.k), "cls long, wide array<long>").dropDuplicates(["cls"])
    return cut(placed(some.join(cut(wide), "cls")).mapInArrow(_near(bands, True), "x long, y long").distinct())


def _plausible(bands: Bands) -> Column:
    """Sizes and whole-set parity sketches allow a link of classes a and b."""
    bits = sum((F.bit_count(F.col(f"a.s{i}").bitwiseXOR(F.col(f"b.s{i}"))) for i in range(1, 4)), F.bit_count(F.col("a.s0").bitwiseXOR(F.col("b.s0"))))
    gap, both = bands.den - bands.num, bands.den + bands.num
    near = F.least("a.n", "b.n") * bands.den >= F.greatest("a.n", "b.n") * bands.num
    return near & (bits * both <= (F.col("a.n") + F.col("b.n")) * gap)


def _verified(likely: DataFrame, classes: DataFrame, docs: DataFrame, bands: Bands) -> DataFrame:
    """Of pairs (x, y) of classes those whose sets link, cut.

    Texts move (they compress; sets of hashes do not): each y's to its x, and x's own once to
    every SALT of its partners, where one streaming pass holds one leader's set at a time.
    """
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    salts = likely.groupBy("x").agg(F.count(F.lit(1)).alias("c")).select("x", F.expr(f"cast(1 + c div {SALT} as int)").alias("salts"))
    asked = likely.join(salts, "x").select(F.col("y").alias("cls"), "x", F.expr("cast(pmod(xxhash64(y), salts) as int)").alias("salt"), "y")
    own = salts.select(F.col("x").alias("cls"), "x", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(None).cast("long").alias("y"))
    rows = asked.union(own).join(classes.select("cls", F.col("rep").alias("doc_id")), "cls").drop("cls")
    texts = _texts_of(rows, docs).select("x", "salt", "y", "text")
    met = texts.repartition(parts, "x", "salt").sortWithinPartitions("x", "salt", F.col("y").asc_nulls_first())
    return cut(met.mapInArrow(_compared(bands), "x long, y long").distinct())


def _shared(docs: DataFrame, bands: Bands) -> tuple[DataFrame, str]:
    """key, cls, lead of all keys that two classes hold after 4., and the path where they are stored."""
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # a class whose rows have no id forms no component: it must not lead a key either
    keys = docs.where("doc_id IS NOT NULL").mapInArrow(_emit_keys(bands), "key long, cls long, spare int").repartition(parts, "key").sortWithinPartitions("key", "cls")
    keys = keys.mapInArrow(_shared_keys(HOT), SHARED).repartition(parts, "cls").sortWithinPartitions("cls", "key")
    keys = keys.mapInArrow(_thinned, "key long, cls long, shares int").repartition(parts, "key")
    keys = keys.sortWithinPartitions("key", F.col("shares").desc(), F.col("cls").desc())
    return stored(keys.mapInArrow(_led, "key long, cls long, lead long"))


def _joined(docs: DataFrame, k: int, num: int, den: int, vertex: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows with their class, classes with an id, and components of vertices: rep (classes with one id are one) or cls."""
    bands = Bands(k, num, den)
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text")
    rows = cut(docs.mapInArrow(_classes(k), CLASSES))
    own = rows.where("n > 0").groupBy("cls", "n").agg(F.min("doc_id").alias("rep"), *[F.first(f"s{i}").alias(f"s{i}") for i in range(4)])
    classes = cut(own.where("rep IS NOT NULL").withColumn("vertex", F.col(vertex)))
    shared, path = _shared(docs, bands)
    release(spark)
    a, b = classes.alias("a"), classes.alias("b")
    ends = classes.select("cls", "vertex")

    def plausible(pairs: DataFrame) -> DataFrame:
        return pairs.join(a, F.col("x") == F.col("a.cls")).join(b, F.col("y") == F.col("b.cls")).where(_plausible(bands))

    def by_vertex(e: DataFrame) -> DataFrame:
        e = e.join(ends.select(F.col("cls").alias("x"), F.col("vertex").alias("a")), "x")
        return e.join(ends.select(F.col("cls").alias("y"), F.col("vertex").alias("b")), "y").select("a", "b")

    def unordered(pairs: DataFrame) -> DataFrame:
        return pairs.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).distinct()

    star = shared.where("cls <> lead").groupBy(F.col("lead").alias("x"), F.col("cls").alias("y")).agg(F.count(F.lit(1)).alias("keys"))
    # first each class with the one leader that it shares most with; that settles most groups
    tried = cut(plausible(star).groupBy("y").agg(F.max(F.struct("keys", "x"))["x"].alias("x")).select("x", "y"))
    links = _verified(tried, classes, docs, bands)
    found = components(by_vertex(links))
    tried = cut(unordered(tried))
    open_ = shared
    for turn in range(ROUNDS + 1):
        # the component of every class of an open key; a key is open if some class is not of its leader's component
        here = open_.where("cls <> lead").select(F.explode(F.array("cls", "lead")).alias("cls")).distinct()
        member = ends.join(here, "cls").join(found, F.col("vertex") == F.col("v"), "left").select("cls", F.coalesce("component", "vertex").alias("comp"))
        member = cut(member)
        if member.isEmpty():
            if not turn:
                drop(spark, path)
            break
        comp_of = F.broadcast(member) if member.count() <= BROADCAST_IDS else member
        lead_of = comp_of.select(F.col("cls").alias("lead"), F.col("comp").alias("_lead"))
        strays = open_.where("cls <> lead").join(comp_of, "cls").join(lead_of, "lead").where("comp <> _lead").select("key").distinct()
        open_ = cut(open_.select("key", "cls", "lead").join(strays, "key").join(comp_of, "cls"))
        if not turn:
            drop(spark, path)  # all that was read from it is materialised
        if turn == ROUNDS:
            break
        per = open_.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("c"), F.min("cls").alias("y"))
        most = per.groupBy("key").agg(F.max(F.struct("c", "comp", "y")).alias("m")).select("key", F.col("m.comp").alias("_most"), F.col("m.y").alias("x"))
        asked = unordered(plausible(per.join(most, "key").where("comp <> _most").select("x", "y").distinct()).select("x", "y"))
        asked = cut(asked.join(tried, ["x", "y"], "left_anti"))
        if asked.isEmpty():
            break
        tried = cut(tried.union(asked))
        more = _verified(asked, classes, docs, bands)
        if more.isEmpty():
            break
        links = cut(links.union(more))
        found = components(by_vertex(links))
        open_ = open_.drop("comp")
    if "comp" in open_.columns:
        across = cut(_across(open_.select("key", "cls", "comp"), classes, docs, bands).join(tried, ["x", "y"], "left_anti"))
        if not across.isEmpty():
            links = links.union(_verified(across, classes, docs, bands))
            found = components(by_vertex(links))
    return rows, classes, found


def join_components(docs: DataFrame, k: int = 3, num: int = 90, den: int = 100) -> DataFrame:
    """doc_id, n_shingles, component_id for every row of docs (columns doc_id, text)."""
    rows, classes, found = _joined(docs, k, num, den, "rep")
    whole = found.withColumnRenamed("v", "rep")
    final = classes.select("cls", "n", "rep").join(whole, "rep", "left").select("cls", "n", F.coalesce("component", "rep").alias("component_id"))
    out = rows.join(final, ["cls", "n"], "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def row_firsts(docs: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """doc_id, cls, first_id, first_cls for every row of docs: its class, and the smallest (doc_id, class) that it is linked to.

    Texts with one doc_id are told apart. The first is null for rows without words and for a class without an id.
    """
    rows, classes, found = _joined(docs, k, num, den, "cls")
    linked = classes.join(found.withColumnRenamed("v", "cls"), "cls", "left").select("cls", "n", "rep", "component")
    first = linked.where("component IS NOT NULL").groupBy("component").agg(F.min(F.struct("rep", "cls")).alias("first"))
    final = linked.join(first, "component", "left").select("cls", "n", F.coalesce("first", F.struct("rep", "cls")).alias("first"))
    return rows.join(final, ["cls", "n"], "left").select("doc_id", "cls", F.col("first.rep").alias("first_id"), F.col("first.cls").alias("first_cls"))


def with_class(docs: DataFrame, k: int, name: str) -> DataFrame:
    """docs with the class of each row's text as a column called name."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(it):
            cls = class_of(*shingle_sets(column(batch, "text"), k))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(signed(cls))], names=[*batch.schema.names, name])

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField(name, LongType())]))


def op4_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join_components(table(spark, sf_dir, "documents"), 3, 90, 100)


SQL = {
    "op4_ngram_join": """
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) >= 3 THEN [array_to_string(ws[i:i + 2], ' ') for i in range(1, len(ws) - 1)] WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS sh FROM d),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 90 * (x.n + y.n - c)),
r(doc_id, reached) AS (SELECT doc_id, doc_id FROM d UNION SELECT r.doc_id, l.b FROM r JOIN l ON l.a = r.reached)
SELECT r.doc_id, coalesce(any_value(n.n), 0)::BIGINT AS n_shingles, min(reached) AS component_id FROM r LEFT JOIN n ON n.doc_id = r.doc_id GROUP BY r.doc_id
"""
}
