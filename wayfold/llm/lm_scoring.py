"""Language-model scores from a weighted backoff automaton of smoothed bigrams.

Model. Learned from the whole texts of the training documents (crc32 of the id as text,
mod 10, is not 0). The root state has an arc for every word with its smoothed unigram
probability p(w) = (c(w) + 0.1) / (N + 0.1 * (V + 1)). Every known word v (and the start
of a text) is a state; each bigram v w that was seen is an arc of v with the probability
(c(vw) + MU * p(w)) / (c(v) + MU), and v's failure arc leads to the root with the weight
MU / (c(v) + MU), which is what the arcs leave over times p of the rest: the
probabilities after any state sum to one. A text is read once, left to right: an arc
if the state has one, else the failure arc and an arc of the root; the next state is the
word if it is known, else the root. Weights are log10.

Distribution. The automaton grows with the corpus and is never held whole. Documents go
to blocks of about BLOCK_BYTES by a hash of the id. Each block counts its n-grams; counts
meet in hash buckets (one packed row per block and bucket), and a bucket tells a block
which of its counts differ from the totals, and those. N and V come from a first pass over words. So a block reads its
texts with exactly the arcs that they can take, and a task holds one block or one bucket,
whatever the size of the corpus; a frequent n-gram is one number a block. A block meets every bucket, as any
shuffle's map tasks meet its reduce tasks, so packed rows number bytes^2 / (block_bytes * bucket_bytes); both
are parameters, to be raised with the executors' memory (some 30 times either).

Edge cases: a null or empty text is the end token alone; a null id counts as text "" for
the split and is training; repeated rows count and score one by one; very long words are
words; without training documents every token has probability 1 / (V + 1) with V = 0;
an empty table gives an empty result; other columns are ignored. Words are told apart by
64-bit hashes.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfold.llm.common import table
from wayfold.llm.textnp import buffers, column, combine, hashes, slices, spans

#: Text bytes of a block, and of the text whose n-grams a bucket holds.
BLOCK_BYTES, BUCKET_BYTES = 6 << 20, 8 << 20
MU = 100.0
END, START = np.uint64(1), np.uint64(2)


def tokens(col: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word hash and predecessor's hash of all tokens, and the text of each; every text ends in END."""
    data, offsets = buffers(col)
    start, end, doc = spans(data, offsets)
    h = hashes(data, start, end)
    n = len(offsets) - 1
    size = np.bincount(doc, minlength=n)
    at = np.concatenate(([0], np.cumsum(size + 1)))
    out = np.empty(at[-1], np.uint64)
    is_end = np.zeros(at[-1], bool)
    is_end[at[1:] - 1] = True
    out[is_end], out[~is_end] = END, h
    before = np.empty_like(out)
    before[1:] = out[:-1]
    before[at[:-1]] = START
    return out, before, np.repeat(np.arange(n), size + 1)


def held_out(ids: pa.Array) -> np.ndarray:
    return np.array([zlib.crc32(("" if i is None else str(i)).encode()) % 10 == 0 and i is not None for i in ids.to_pylist()], bool)


def counted(keys: np.ndarray, train: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys, their training counts, and the place of each input key."""
    distinct, at = np.unique(keys, return_inverse=True)
    return distinct, np.bincount(at, weights=train, minlength=len(distinct)).astype(np.int64), at


_CODEC = "zstd"


def pack(x: np.ndarray) -> bytes:
    """Sorted or small numbers compress well with their bytes put plane by plane."""
    planes = np.ascontiguousarray(x).view(np.uint8).reshape(len(x), x.itemsize).T.tobytes()
    return len(x).to_bytes(8, "little") + pa.Codec(_CODEC, 1).compress(planes, asbytes=True)


def unpack(b: bytes, kind: type | str) -> np.ndarray:
    n, width = int.from_bytes(b[:8], "little"), np.dtype(kind).itemsize
    planes = pa.Codec(_CODEC).decompress(b[8:], n * width, asbytes=True)
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(width, n).T).reshape(-1).view(kind)


PARTS = "block int, bucket int, gram int, keys binary, counts binary"


def _bucket_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    return ((keys >> np.uint64(40)) % np.uint64(buckets)).astype(np.int64)


def _grams(t: pa.Table) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """Order, distinct keys, training counts and places of the n-grams of some texts; bigram keys have 48 bits."""
    w, v, doc = tokens(column(t, "text"))
    train = ~held_out(column(t, "doc_id"))[doc]
    yield 1, *counted(w, train)
    yield 2, *counted(combine(v, w), train)


def _by_bucket(keys: np.ndarray, buckets: int) -> Iterator[tuple[int, np.ndarray]]:
    """Bucket and places of its keys, which stay sorted."""
    b = _bucket_of(keys, buckets)
    order = np.argsort(b, kind="stable")
    for part in np.split(order, np.flatnonzero(np.diff(b[order])) + 1):
        if len(part):
            yield int(b[part[0]]), part


def _sent(keys: np.ndarray, gram: int) -> bytes:
    """Keys of one bucket. A bigram's last 16 bits stay behind: the bucket and 48 bits tell bigrams apart."""
    return pack(keys) if gram == 1 else pack(np.ascontiguousarray((keys >> np.uint64(16)).view(np.uint8).reshape(-1, 8)[:, :6]).reshape(-1).view("S6"))


def _received(b: bytes, gram: int) -> np.ndarray:
    if gram == 1:
        return unpack(b, np.uint64)
    six = unpack(b, "S6")
    wide = np.zeros((len(six), 8), np.uint8)
    wide[:, :6] = np.frombuffer(six.tobytes(), np.uint8).reshape(-1, 6)
    return wide.reshape(-1).view(np.uint64)


def _count_block(buckets: int):
    def count(t: pa.Table) -> pa.Table:
        rows: dict[str, list] = {k.split()[0]: [] for k in PARTS.split(", ")}
        block = column(t, "block")[0].as_py()
        for gram, keys, counts, _ in _grams(t):
            for b, part in _by_bucket(keys, buckets):
                for k, x in zip(rows, (block, b, gram, _sent(keys[part], gram), pack(counts[part])), strict=True):
                    rows[k].append(x)
        return pa.table([pa.array(x, k) for x, k in zip(rows.values(), (pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary()), strict=True)], names=list(rows))

    return count


def _merged(t: pa.Table) -> tuple[list[np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
    """Counts of each row, the distinct keys of all, their totals, and the places of all rows' keys."""
    gram = column(t, "gram")[0].as_py()
    keys = [_received(b, gram) for b in column(t, "keys").to_pylist()]
    counts = [unpack(b, np.int64) for b in column(t, "counts").to_pylist()]
    distinct, at = np.unique(np.concatenate(keys), return_inverse=True)
    return counts, distinct, np.bincount(at, weights=np.concatenate(counts), minlength=len(distinct)).astype(np.int64), at


TOTALS = "block int, bucket int, gram int, differs binary, totals binary"


def _merge_bucket(t: pa.Table) -> pa.Table:
    """For every block of a bucket which of its counts differ from the corpus totals, and those totals."""
    counts, _, total, at = _merged(t)
    rows: dict[str, list] = {"block": [], "bucket": [], "gram": [], "differs": [], "totals": []}
    i = 0
    for block, c in zip(column(t, "block").to_pylist(), counts, strict=True):
        all_ = total[at[i : i + len(c)]]
        i += len(c)
        differs = all_ != c
        if differs.any():
            for k, x in zip(rows, (block, column(t, "bucket")[0].as_py(), column(t, "gram")[0].as_py(), pack(np.packbits(differs)), pack(all_[differs])), strict=True):
                rows[k].append(x)
    return pa.table([pa.array(x, k) for x, k in zip(rows.values(), (pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary()), strict=True)], names=list(rows))


def _unigram_parts(buckets: int):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(it, size=BLOCK_BYTES):
            gram, keys, counts, _ = next(_grams(batch))
            rows = [(b, gram, pack(keys[part]), pack(counts[part])) for b, part in _by_bucket(keys, buckets)]
            cols = list(zip(*rows, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(cols, (pa.int32(), pa.int32(), pa.binary(), pa.binary()), strict=True)], names=["bucket", "gram", "keys", "counts"])

    return run


def _bucket_sums(t: pa.Table) -> pa.Table:
    _, distinct, total, _ = _merged(t)
    return pa.table({"n": [int(total.sum())], "v": [int((total > 0).sum())], "ends": [int(total[distinct == END].sum())]})


class Automaton:
    """The states and arcs that one block of texts can take."""

    def __init__(self, unigrams: np.ndarray, bigrams: np.ndarray, n: int, v: int, starts: int, mu: float = MU) -> None:
        self.arc = np.log10((unigrams + 0.1) / (n + 0.1 * (v + 1)))  # of the root, by local word number
        self.visits = np.concatenate((unigrams, [starts])).astype(float)  # of each state; the last is the start
        self.fail = np.log10(mu / (self.visits + mu))
        self.bigrams, self.mu = bigrams, mu

    def step(self, state: np.ndarray, word: np.ndarray, pair: np.ndarray) -> np.ndarray:
        """log10 weight of going on from state (-1: root) by word; pair: local number of the bigram."""
        root = self.arc[word]
        failed = np.where(state < 0, 0.0, self.fail[state]) + root
        seen = self.bigrams[pair]
        visits = self.visits[state]
        arc = np.log10((seen + self.mu * 10.0**root) / (visits + self.mu))
        return np.where((state >= 0) & (seen > 0), arc, failed)


SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"


def _score_block(buckets: int, n: int, v: int, starts: int):
    def score(docs: pa.Table, totals: pa.Table) -> pa.Table:
        ids = column(docs, "doc_id")
        if not docs.num_rows:
            return pa.table([pa.array([], k) for k in (pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64())], names=[c.split()[0] for c in SCORES.split(", ")])
        w, before, doc = tokens(column(docs, "text"))
        out = held_out(ids)
        grams, places = [], []
        for gram, keys, counts, at in ((1, *counted(w, ~out[doc])), (2, *counted(combine(before, w), ~out[doc]))):
            places_of = dict(_by_bucket(keys, buckets))
            for g, b, bits, x in zip(*(column(totals, c).to_pylist() for c in ("gram", "bucket", "differs", "totals")), strict=True):
                if g == gram:
                    part = places_of[b]
                    counts[part[np.unpackbits(unpack(bits, np.uint8), count=len(part)).astype(bool)]] = unpack(x, np.int64)
            grams.append((keys, counts))
            places.append(at)
        words, unigrams = grams[0]
        machine = Automaton(unigrams, grams[1][1], n, v, starts)
        # the state before a token is the word before it if that is known, else the root
        at = np.empty_like(places[0])
        at[1:] = places[0][:-1]
        first = before == START
        state = np.where(unigrams[at * ~first] > 0, at * ~first, -1)
        state[first] = len(words)
        step = machine.step(state, places[0], places[1])
        sums = lambda x: np.bincount(doc, weights=x, minlength=docs.num_rows)
        return pa.table(
            [ids.combine_chunks() if isinstance(ids, pa.ChunkedArray) else ids, pa.array(out), pa.array(sums(np.ones(len(w))).astype(np.int64)), pa.array(sums(unigrams[places[0]] > 0).astype(np.int64)), pa.array(sums(machine.arc[places[0]])), pa.array(sums(step))],
            names=[c.split()[0] for c in SCORES.split(", ")],
        )

    return score


def score(docs: DataFrame, block_bytes: int = BLOCK_BYTES, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every row."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks, buckets = (int(max(1, -(-size // b))) for b in (block_bytes, bucket_bytes))
    words = docs.select("doc_id", "text").mapInArrow(_unigram_parts(buckets), "bucket int, gram int, keys binary, counts binary")
    sums = words.groupBy("bucket").applyInArrow(_bucket_sums, "n long, v long, ends long")
    n, v, starts = sums.agg(*[F.coalesce(F.sum(c), F.lit(0)) for c in ("n", "v", "ends")]).first()
    # one exchange of the texts serves the counts and the scores; the text has a say in the block, so rows without an id are spread
    rows = docs.select("doc_id", "text", F.expr(f"cast(pmod(xxhash64(doc_id, text), {blocks}) as int)").alias("block")).repartition(blocks, "block")
    parts = rows.groupBy("block").applyInArrow(_count_block(buckets), PARTS)
    totals = parts.repartition(2 * buckets, "bucket", "gram").groupBy("bucket", "gram").applyInArrow(_merge_bucket, TOTALS).repartition(blocks, "block")
    scored = rows.groupBy("block").cogroup(totals.groupBy("block")).applyInArrow(_score_block(buckets, n, v, starts), SCORES)
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), "base_score", "score")


def op8_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"))


SQL = {
    "op8_lm_scoring": f"""
WITH d AS (
  SELECT doc_id, list_append(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+'), '<end> ') AS ws,
    xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, [ord(c)::BIGINT for c in string_split(doc_id::VARCHAR, '')]),
      lambda a, b: list_reduce(list_prepend(xor(a, b), [0::BIGINT for i in range(8)]), lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END))) % 10 = 0 AS held_out
  FROM documents),
t AS (SELECT row_number() OVER () AS r, * FROM d),
x AS (SELECT r, held_out, unnest(ws) AS w, unnest(list_prepend('<start> ', ws[:-2])) AS v FROM t),
u AS (SELECT w, count(*)::DOUBLE AS c FROM x WHERE NOT held_out GROUP BY w),
b AS (SELECT v, w, count(*)::DOUBLE AS c FROM x WHERE NOT held_out GROUP BY v, w),
g AS (SELECT coalesce(sum(c), 0) AS n, count(*) AS vocab, coalesce(max(c) FILTER (w = '<end> '), 0) AS starts FROM u),
p AS (
  SELECT x.r, u.c IS NOT NULL AS known, (coalesce(u.c, 0) + 0.1) / (g.n + 0.1 * (g.vocab + 1)) AS pw,
         CASE WHEN x.v = '<start> ' THEN g.starts ELSE coalesce(uv.c, 0) END AS cv, coalesce(b.c, 0) AS cb
  FROM x CROSS JOIN g LEFT JOIN u ON u.w = x.w LEFT JOIN u uv ON uv.w = x.v LEFT JOIN b ON b.v = x.v AND b.w = x.w)
SELECT any_value(t.doc_id) AS doc_id, any_value(t.held_out) AS held_out, count(*)::BIGINT AS n_tokens, count(*) FILTER (known)::BIGINT AS n_known,
       any_value(g.n)::BIGINT AS train_tokens, sum(log10(pw)) AS base_score, sum(log10((cb + {MU} * pw) / (cv + {MU}))) AS score
FROM p JOIN t USING (r) CROSS JOIN g GROUP BY p.r
"""
}
