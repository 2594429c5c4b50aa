"""Quality classifier: ordinal cumulative-link regression on graded ratings.

Grades: 0 toxic, 1 poor, 2 good. P(grade >= k) = sigmoid(w . x - b_k) with one weight vector w
for all grades and ordered thresholds b_1 < b_2. x has one entry per distinct token (a 64-bit
hash of a run of letters, digits and non-ASCII bytes, A-Z as a-z) and per shape of the text
(cells of upper-case, symbol, repetition, word-length and size ratios). The expected grade
is the sum of the tail probabilities; selection keeps documents whose tail probability
P(grade >= 2) reaches a cutoff.

Fit. On the driver, on a sample of at most SAMPLE labelled documents per grade, the smallest
by a seeded digest of the id; two thirds fit, a third sets the cutoff at the tail
probability that all but KEEP_MISS of its good documents reach (at most 0.5). Tokens enter the model if
their document frequencies differ between grades by Z standard errors (at most FEATURES of
them), so rare words of clean texts carry no weight. Frequencies are counted by Spark over all tokens of the sampled texts, whole;
then only hashes that may enter the model come to the driver, not texts: 3 * SAMPLE * 2 * FEATURES * 8 bytes at most, 400 MB, and a
hundredth of that as a rule. Gradient ascent with momentum and a step that is halved whenever the likelihood falls, L2.

Scoring reads every document's whole text once against the model (some thousand hashes and
weights, sent with the task).

Edge cases: a null or empty text has shapes only; labels with null quality and null toxic are
unused; a document with several labels takes the lowest grade; without both good and other
labels nothing can be learned and every document is kept with expected grade 2; ties in
the digest order break by id; of several texts of one sampled doc_id the one with the smallest list of hashes is fitted; repeated rows score alike; an empty table gives an empty
result; other columns are carried by select_good() and ignored by classify().
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfold.llm.common import cut, table
from wayfold.llm.textnp import PUNCT, buffers, column, hashes, mix, signed, slices, spans, unsigned

SAMPLE, FEATURES, Z = 2000, 4096, 4.5
SEED = "grade-1"
KEEP_MISS = 0.002
#: Steps of the fit.
ROUNDS = 600
CELLS = 16
SHAPES = ("upper", "symbol", "fresh", "wordlen", "length", "bang", "line")


def _segment_sum(x: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.concatenate(([0], np.cumsum(x, dtype=np.int64)))
    return (total[offsets[1:]] - total[offsets[:-1]]).astype(float)


_UPPER = np.array([65 <= c < 91 for c in range(256)])
_ALPHA = np.array([chr(c).isalpha() if c < 128 else c < 0xC0 for c in range(256)])  # a letter, or a character's last bytes
_SYMBOL = np.array([chr(c) in "#*$%&|<>{}[]=~^_@\\" for c in range(256)])
_BANG = np.array([chr(c) in "!?" for c in range(256)])


def shape_hash(kind: int, cell: np.ndarray) -> np.ndarray:
    return mix(np.uint64(0xABCDEF0123 + kind) * np.uint64(1000003) + cell.astype(np.uint64))


def features(col: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Token hash and text number of every token occurrence, and the shape hashes (texts x SHAPES)."""
    data, offsets = buffers(col)
    start, end, doc = spans(data, offsets, PUNCT)
    h = hashes(data, start, end)
    n = len(offsets) - 1
    words = np.bincount(doc, minlength=n).astype(float)
    order = np.lexsort((h, doc))
    new = np.ones(len(h), bool)
    new[1:] = (h[order][1:] != h[order][:-1]) | (doc[order][1:] != doc[order][:-1])
    fresh = np.bincount(doc[order][new], minlength=n)
    letters = np.maximum(_segment_sum(_ALPHA[data], offsets), 1)
    per = np.maximum(words, 1)
    size = np.diff(offsets).astype(float)
    ratio = (
        _segment_sum(_UPPER[data], offsets) / letters,
        4 * _segment_sum(_SYMBOL[data], offsets) / np.maximum(size, 1),
        # repetition beyond what a text of that many words has anyway
        fresh / per * np.log2(per + 2) / np.log2(1000),
        _segment_sum(~PUNCT[data], offsets) / per / 16,
        np.log2(words + 1) / 16,
        _segment_sum(_BANG[data], offsets) / per,
        8 * _segment_sum(data == 10, offsets) / per,
    )
    shapes = np.stack([shape_hash(k, np.minimum((np.sqrt(r) if k in (1, 5, 6) else r) * CELLS, CELLS).astype(np.int64)) for k, r in enumerate(ratio)], axis=1)
    return h, doc, shapes if n else np.zeros((0, len(SHAPES)), np.uint64)


@dataclass
class Model:
    keys: np.ndarray = field(default_factory=lambda: np.zeros(1, np.uint64))  # sorted
    weights: np.ndarray = field(default_factory=lambda: np.zeros(1))
    thresholds: tuple[float, float] = (-40.0, -40.0)
    cutoff: float = 0.5

    def tails(self, h: np.ndarray, doc: np.ndarray, shapes: np.ndarray) -> np.ndarray:
        """P(grade >= 1) and P(grade >= 2) of every text."""
        n = len(shapes)
        mask = np.zeros(1 << 18, bool)
        mask[(self.keys & np.uint64((1 << 18) - 1)).astype(np.int64)] = True
        some = np.flatnonzero(mask[(h & np.uint64((1 << 18) - 1)).astype(np.int64)])
        all_h = np.concatenate((h[some], shapes.reshape(-1)))
        all_doc = np.concatenate((doc[some], np.repeat(np.arange(n), shapes.shape[1])))
        at = np.minimum(np.searchsorted(self.keys, all_h), len(self.keys) - 1)
        ok = self.keys[at] == all_h
        pair = np.unique(all_doc[ok] * len(self.keys) + at[ok])  # each token of a text once
        score = np.bincount(pair // len(self.keys), weights=self.weights[pair % len(self.keys)], minlength=n)
        return np.stack([1 / (1 + np.exp(np.clip(b - score, -60, 60))) for b in self.thresholds], axis=1)


def fit(h: np.ndarray, doc: np.ndarray, grade: np.ndarray, held: np.ndarray, max_features: int = FEATURES, z: float = Z) -> Model:
    """h, doc: distinct features of each sampled text; grade: of each text; held: texts that set the cutoff."""
    n = len(grade)
    if len(set(grade.tolist())) < 2 or 2 not in grade:
        return Model()
    keys, at = np.unique(h, return_inverse=True)
    train = ~held
    strength = np.zeros(len(keys))
    for k in (1, 2):  # at or above k against below
        up, down = train & (grade >= k), train & (grade < k)
        if up.any() and down.any():
            a, b = (np.bincount(at, weights=m[doc].astype(float), minlength=len(keys)) for m in (up, down))
            p = (a + b + 1) / (train.sum() + 2)
            gap = np.abs(a / up.sum() - b / down.sum()) / np.sqrt(p * (1 - p) * (1 / up.sum() + 1 / down.sum()))
            strength = np.maximum(strength, np.where(a + b >= 4, gap, 0))
    is_shape = np.isin(keys, _shape_keys())
    chosen = np.flatnonzero((strength >= z) | is_shape)
    chosen = np.sort(chosen[np.argsort(-strength[chosen], kind="stable")[:max_features]])
    local = np.full(len(keys), -1)
    local[chosen] = np.arange(len(chosen))
    x = np.zeros((n, len(chosen)), np.float32)
    use = local[at] >= 0
    x[doc[use], local[at[use]]] = 1
    t, g = x[train], grade[train]
    weight = np.zeros(3)
    for k in range(3):
        weight[k] = 1 / max(1, 3 * (g == k).sum())
    wt = weight[g]
    w, b, v, vb = np.zeros(len(chosen)), np.array([-1.0, 1.0]), 0.0, 0.0
    step = 4.0 / max(1.0, float(t.sum(axis=1).mean()) / 8)
    top, kept = -np.inf, (w, b)
    for _ in range(ROUNDS):
        s = t @ w.astype(np.float32)
        p = 1 / (1 + np.exp(np.clip(b[None, :] - s[:, None], -60, 60)))  # P(>= 1), P(>= 2)
        up, lo = p[:, 0], p[:, 1]
        cell = np.clip(np.choose(g, (1 - up, up - lo, lo)), 1e-9, 1)
        value = float(wt @ np.log(cell) - 1e-4 * (w @ w))
        if value < top - 1e-9:  # too far: go back, take smaller steps
            (w, b), v, vb, step = kept, 0.0, 0.0, step / 2
            top = -np.inf  # the next value is that of kept
            continue
        top, kept = value, (w, b)
        d_up = np.choose(g, (-1.0, 1.0, 0.0)) / cell * up * (1 - up)
        d_lo = np.choose(g, (0.0, -1.0, 1.0)) / cell * lo * (1 - lo)
        gw = t.T @ (wt * (d_up + d_lo)).astype(np.float32) - 2e-4 * w
        gb = np.array([-(wt * d_up).sum(), -(wt * d_lo).sum()])
        v, vb = 0.9 * v + step * gw, 0.9 * vb + step * gb
        w, b = w + v, b + vb
        if b[1] < b[0] + 0.1:
            b = np.array([b.mean() - 0.05, b.mean() + 0.05])
    w, b = kept
    model = Model(keys[chosen], w, (float(b[0]), float(b[1])))
    good = held & (grade == 2)
    if good.any():
        s = x[good] @ w
        tail = np.sort(1 / (1 + np.exp(np.clip(b[1] - s, -60, 60))))
        model.cutoff = float(min(0.5, tail[int(KEEP_MISS * len(tail))]))
    return model


def sample(labels: DataFrame, size: int = SAMPLE) -> DataFrame:
    """doc_id, grade of the sampled labels: at most size per grade, so at most 3 * size rows."""
    toxic, quality = F.col("toxic") == 1, F.col("quality")
    grade = F.when(toxic, 0).when(quality == 0, 1).when(quality == 1, 2)
    rated = labels.where("doc_id IS NOT NULL").select("doc_id", grade.alias("grade")).where("grade IS NOT NULL").groupBy("doc_id").agg(F.min("grade").alias("grade"))
    rated = rated.withColumn("_h", F.md5(F.concat(F.lit(f"{SEED}:"), F.col("doc_id").cast("string"))))
    parts = [rated.where(F.col("grade") == k).orderBy("_h", "doc_id").limit(size) for k in range(3)]
    return parts[0].union(parts[1]).union(parts[2]).select("doc_id", "grade", "_h")


def _distinct(h: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each hash of a text once, sorted within the text."""
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    return h[new], doc[new]


def _sampled_features(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The distinct features of each text, all of them."""
    for batch in slices(it):
        h, doc, shapes = features(column(batch, "text"))
        doc = np.concatenate((doc, np.repeat(np.arange(batch.num_rows), shapes.shape[1])))
        h, doc = _distinct(np.concatenate((h, shapes.reshape(-1))), doc)
        ends = np.concatenate(([0], np.cumsum(np.bincount(doc, minlength=batch.num_rows)))).astype(np.int32)
        keys = pa.ListArray.from_arrays(pa.array(ends), pa.array(signed(np.ascontiguousarray(h))))
        yield pa.RecordBatch.from_arrays([column(batch, "doc_id"), column(batch, "grade"), column(batch, "_h"), keys], names=["doc_id", "grade", "h", "keys"])


def _shape_keys() -> np.ndarray:
    return np.concatenate([shape_hash(k, np.arange(CELLS + 1)) for k in range(len(SHAPES))])


def _candidates(rows: DataFrame, max_features: int, z: float) -> DataFrame:
    """key: features that fit() may choose, by their document frequencies in the texts that fit; at most twice max_features, and all shapes."""
    train = rows.where("NOT held")
    of = dict.fromkeys(range(3), 0) | {r["grade"]: r["count"] for r in train.groupBy("grade").count().collect()}  # a row a grade
    counts = train.select("grade", F.explode("keys").alias("key")).groupBy("key").agg(*[F.count_if(F.col("grade") == g).alias(f"c{g}") for g in range(3)])
    n, strength = sum(of.values()), F.lit(0.0)
    for k in (1, 2):  # at or above k against below, as fit() has it
        up, down = sum(of[g] for g in range(k, 3)), sum(of[g] for g in range(k))
        if up and down:
            a, b = (sum((F.col(f"c{g}") for g in gs), F.lit(0)) for gs in (range(k, 3), range(k)))
            p = (a + b + 1) / (n + 2)
            gap = F.abs(a / up - b / down) / F.sqrt(p * (1 - p) * (1 / up + 1 / down))
            strength = F.greatest(strength, F.when(a + b >= 4, gap).otherwise(0.0))
    strong = counts.withColumn("s", strength).where(F.col("s") >= z - 1e-6).orderBy(F.desc("s"), "key").limit(2 * max_features).select("key")
    shapes = rows.sparkSession.createDataFrame([(int(k),) for k in signed(_shape_keys())], "key long")
    return strong.union(shapes).distinct()


def train(docs: DataFrame, labels: DataFrame, size: int = SAMPLE) -> Model:
    chosen = F.broadcast(cut(sample(labels, size)))  # at most 3 * size rows
    rows = docs.select("doc_id", "text").join(chosen, "doc_id").mapInArrow(_sampled_features, "doc_id long, grade int, h string, keys array<long>")
    held = F.conv(F.substring("h", -4, 4), 16, 10).cast("int") % 3 == 0
    rows = cut(rows.groupBy("doc_id", "grade", "h").agg(F.min("keys").alias("keys")).withColumn("held", held))
    few = F.broadcast(cut(_candidates(rows, FEATURES, Z)))  # at most 2 * FEATURES rows and the shapes
    found = rows.select("doc_id", F.explode("keys").alias("key")).join(few, "key").groupBy("doc_id").agg(F.sort_array(F.collect_list("key")).alias("keys"))
    got = rows.drop("keys").join(found, "doc_id", "left").collect()
    if not got:
        return Model()
    got.sort(key=lambda r: (r["h"], r["doc_id"]))
    keys = [unsigned(np.array(r["keys"] or [], np.int64)) for r in got]
    doc = np.repeat(np.arange(len(got)), [len(k) for k in keys])
    return fit(np.concatenate(keys), doc, np.array([r["grade"] for r in got]), np.array([r["held"] for r in got]))


def classify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, expected_grade, p_poor_or_better, p_good, kept for every row."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(it):
            tail = model.tails(*features(column(batch, "text")))
            cols = [column(batch, "doc_id"), pa.array(tail.sum(axis=1)), pa.array(tail[:, 0].copy()), pa.array(tail[:, 1].copy()), pa.array(tail[:, 1] >= model.cutoff)]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "expected_grade", "p_poor_or_better", "p_good", "kept"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, expected_grade double, p_poor_or_better double, p_good double, kept boolean")


def select_good(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of docs that the model keeps, with all columns."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(it):
            yield batch.filter(pa.array(model.tails(*features(column(batch, "text")))[:, 1] >= model.cutoff))

    return docs.mapInArrow(run, docs.schema)


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return classify(docs, train(docs, table(spark, sf_dir, "labels")))
