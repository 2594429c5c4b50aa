"""The text operators against brute force on small tables with edge cases."""

import hashlib
import random
import re
import time
import zlib
from collections import Counter
from math import exp, log, log10

import numpy as np
import pyarrow as pa
import pytest
from fixtures import documents, empty, odd_rows, words
from pyspark.sql import functions as F

from wayfold.llm import components, decontamination, html_extraction, lm_scoring, mixing, near_dups, ngram_join, quality_classifier, quality_rules, sharding, suffix_dedup, suffixes, token_counts

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ASCII = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


@pytest.fixture(scope="module")
def docs(spark):
    return documents(spark).cache()


@pytest.fixture(scope="module")
def rows(docs):
    return [(r.doc_id, r.text, r.source) for r in docs.collect()]


# suffix sorting and dedup


@pytest.mark.parametrize("seed", range(40))
def test_suffix_array_and_prefixes(seed):
    rng = np.random.default_rng(seed)
    t = rng.integers(seed % 2, int(rng.integers(2, 5)), int(rng.integers(1, 150))).astype(np.uint8)
    depth = int(rng.integers(3, 30))
    order = suffixes.suffix_array(t, depth)
    keys = [bytes(t)[i : i + depth].split(b"\0")[0] for i in order]
    assert sorted(order) == list(range(len(t))) and keys == sorted(keys)
    alike = suffixes.common_prefixes(t, order, depth)
    assert all(alike[j] == (keys[j] == keys[j - 1] and len(keys[j]) == depth) for j in range(1, len(t)))


def brute_dedup(rows):
    seen, out = set(), {}
    for i, text in sorted((r[0], r[1]) for r in rows):
        b = (text or "").encode()
        gone = np.zeros(len(b), bool)
        for s in range(len(b) - 99):
            w = b[s : s + 100]
            if w in seen:
                gone[s : s + 100] = True
            seen.add(w)
        kept = np.frombuffer(b, np.uint8)[~gone].tobytes()
        out[i] = (len(b), int(gone.sum()), int((np.diff(np.concatenate(([0], gone.astype(int)))) == 1).sum()), hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("hot", [suffix_dedup.HOT, 2])
def test_suffix_dedup(docs, rows, hot):
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.dedup(docs, hot).collect()}
    assert got == brute_dedup(rows)


def test_suffix_dedup_tells_rows_of_one_id_apart(spark):
    rng = random.Random(8)
    a, b = " ".join(words(rng, 100)), " ".join(words(rng, 100))
    passage = "".join(rng.choice("abcdefgh ") for _ in range(400))
    rows = [(r[0], r[1]) for r in odd_rows()] + [(90, passage), (91, a + passage), (91, (b * 9)[: len(a)] + "x" * 400), (92, a), (92, a)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    ties = {(r.doc_id, r.text or ""): r.t for r in df.select("doc_id", "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("t")).collect()}
    order = sorted(ties, key=lambda k: (k[0] is not None, k[0] or 0, ties[k]))
    want = brute_dedup([(i, text) for i, (_, text) in enumerate(order)])
    want = Counter((key[0], *want[order.index(key)]) for key in [(i, t or "") for i, t in rows])
    got = Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.dedup(df).collect())
    assert got == want


def test_suffix_dedup_across_sort_batches(docs, rows, monkeypatch):
    chunks = [(int(v), c, i, s) for v, c, i, s in [(5, b"x" * 100, 1, 0), (5, b"x" * 100, 2, 4), (5, b"y" + b"x" * 120, 3, 9)]]
    batches = [pa.record_batch([pa.array([c[0]]), pa.array([c[1]], pa.binary()), pa.array([c[2]]), pa.array([c[3]], pa.int32())], names=["val", "chunk", "id", "start"]) for c in chunks]
    found = sorted((i, lo, hi) for b in suffix_dedup._sorted_chunks(iter(batches)) for i, lo, hi in zip(*(b.column(k).to_pylist() for k in range(3))))
    assert found == [(2, 4, 104), (3, 10, 130)]


# token counts


def test_token_counts(spark, docs, rows):
    count = token_counts.encoder(token_counts.default_vocabulary())
    lengths = Counter(zip([r.lang for r in docs.collect()], count([r[1] or "" for r in rows])))
    hist = token_counts.histogram(docs)
    assert {(r.lang, r.n_tokens): r.n_docs for r in hist.collect()} == lengths
    for r in token_counts.with_totals(hist).collect():
        own = [n for (lang, n), c in lengths.items() for _ in range(c) if lang == r.lang]
        assert r.docs_from == sum(n >= r.n_tokens for n in own) and r.tokens_from == sum(n for n in own if n >= r.n_tokens)
        assert r.cut_total == sum(min(n, r.n_tokens) for n in own) and r.docs_over == sum(n > r.n_tokens for n in own)
        assert r.docs_share == pytest.approx(sum(n <= r.n_tokens for n in own) / len(own))
    cut = {r.lang: r.cut_total for r in token_counts.truncated_total(hist, 100).collect()}
    assert cut["en"] == sum(min(n, 100) * c for (lang, n), c in lengths.items() if lang == "en")
    median = {r.lang: r.n_tokens for r in token_counts.quantile(hist, 0.5).collect()}
    own = sorted(n for (lang, n), c in lengths.items() for _ in range(c) if lang == "en")
    assert median["en"] == own[-(-len(own) // 2) - 1]


def test_long_runs_are_counted(spark, monkeypatch):
    """A megabyte of one character does not stop the count, and runs encoded apart change no count."""
    rng = random.Random(6)
    small = ["".join(rng.choice(["  ", "\n", "\t \u3000", "word", " a", "9", "$", "é", "\x1c"]) * rng.choice([1, 1, 7]) for _ in range(60)) for _ in range(60)]
    small += ["   ", "\n\n\n x", "x    ", "x \n \n y", "\u2028" * 9 + "z"]
    whole = token_counts.encoder(token_counts.default_vocabulary())(small)
    token_counts.encoder.cache_clear()
    monkeypatch.setattr(token_counts, "LONG_SPACE", 3)
    monkeypatch.setattr(token_counts, "_LONG_RUN", re.compile(f"(?<!{token_counts._SPACE}){token_counts._SPACE}{{3,}}"))
    assert token_counts.encoder(token_counts.default_vocabulary())(small) == whole
    monkeypatch.undo()
    token_counts.encoder.cache_clear()
    n = 1_000_000
    long_ = [" " * n + "x", "\n" * n, "x" + " " * n, "a" * n, " \n" * (n // 2) + "ab", None]
    got = token_counts.lengths(spark.createDataFrame([(t, "en") for t in long_], "text string, lang string")).collect()
    assert sorted(r.n_tokens for r in got) == sorted([n, n // 2, n + 1, n // 4, n + 1, 0])


# decontamination


def edit_distance(a, b):
    """Of a to the best substring of b."""
    row = [0] * (len(b) + 1)
    for x in a:
        last, row = row, [row[0] + 1]
        for j, y in enumerate(b):
            row.append(min(last[j] + (x != y), last[j + 1] + 1, row[j] + 1))
    return min(row)


@pytest.mark.parametrize("seed", range(30))
def test_bit_parallel_distance(seed):
    rng = random.Random(seed)
    a, b = [rng.randrange(4) for _ in range(rng.randint(1, 70))], [rng.randrange(4) for _ in range(rng.randint(0, 90))]
    assert decontamination.best_distance(a, b, len(a))[0] == min(edit_distance(a, b), len(a))


def test_decontamination_recall_and_precision(spark):
    rng = random.Random(4)
    items = [(k, " ".join(words(rng, rng.choice([3, 7, 15, 40, 70]), 2000))) for k in range(40)] + [(90, None), (91, "..."), (92, "")]
    planted, rows = {}, [(1, None, None), (2, "", None), (3, " ".join(words(rng, 3000, 2000)), None)]
    for n, (k, text) in enumerate(items[:40] * 3):
        w = text.split()
        for _ in range(int(0.12 * len(w))):
            p, kind = rng.randrange(len(w)), rng.random()
            w[p : p + 1] = [[f"new{n}"], [], [w[p], f"more{n}"]][int(kind * 3)]
        body = words(rng, 60, 2000)
        rows.append((100 + n, " ".join(body[:30]) + ", " + " ".join(w).upper() + "! " + " ".join(body[30:]), None))
        planted[100 + n] = k
    docs = spark.createDataFrame(rows, "doc_id long, text string, item_id string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    token = lambda s: re.findall(r"[0-9a-z\x80-\U0010ffff]+", (s or "").translate(ASCII))
    want = set()
    for i, t, _ in rows:
        for k, s in items:
            a, b = token(s), token(t)
            if a and edit_distance(a, b) <= (int(0.2 * len(a)) if len(a) >= 5 else 0):
                want.add((i, k))
    for block in (5000, 7):
        got = {(r.doc_id, r.item_id) for r in decontamination.contaminated(docs, bench, item_block=block).collect()}
        assert got <= want and len(got & want) >= 0.9 * len(want)
    left = decontamination.clean(docs, bench)
    assert left.columns == docs.columns and {r.doc_id for r in left.collect()} == {r[0] for r in rows} - {i for i, _ in got}
    assert decontamination.contaminated(docs.limit(0), bench).count() == 0 == decontamination.contaminated(docs, bench.limit(0)).count()


@pytest.mark.parametrize("n", [*range(5, 17), 20, 30, 60, 120])
def test_decontamination_recall_at_the_limit(n):
    rng, limit, trials = random.Random(n), int(0.2 * n), 150
    found = 0
    for _ in range(trials):
        w = words(rng, n, 4000)
        item = decontamination.Index([(0, " ".join(w))])
        edited = w[:]
        for p in rng.sample(range(n), limit):  # substitutions, deletions and insertions, at most limit edits
            edited[p] = rng.choice([f"sub{p}", "", f"{edited[p]} more{p}"])
        body = words(rng, 40, 4000)
        x, offsets = decontamination.tokens(pa.array([None, " ".join([*body, *edited, *body])]))
        tokens = [t.tolist() for t in item.item]
        for doc, k, start in item.hits(x, offsets):
            a, b = offsets[doc] + max(0, start - limit), min(offsets[doc] + start + n + limit, offsets[doc + 1])
            if decontamination.best_distance(tokens[k], x[a:b].tolist(), limit)[0] <= limit:
                found += 1
                break
    assert found == trials if n <= decontamination.SHORT else found >= 0.9 * trials


# n-gram join and components


def brute_components(rows, k, num, den):
    sets = {}
    for i, t, _ in rows:
        w = WORD.findall((t or "").translate(ASCII))
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if den * both >= num * (len(sets[a]) + len(sets[b]) - both):
                    x, y = find(a), find(b)
                    root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


@pytest.mark.parametrize(("k", "num", "den", "hot"), [(3, 90, 100, 64), (5, 80, 100, 64), (3, 90, 100, 2), (5, 80, 100, 1)])
def test_ngram_join(spark, k, num, den, hot, monkeypatch):
    monkeypatch.setattr(ngram_join, "HOT", hot)
    rng = random.Random(k)
    rows = [(r.doc_id, r.text, None) for r in documents(spark, 5, 40).collect()]
    for g in range(4):  # chains of near copies, each a step from the last
        w = words(rng, 30 * (g + 1))
        for j in range(10):
            rows.append((1000 + 100 * g + j, " ".join(w), None))
            w = w[:]
            w[rng.randrange(len(w))] = f"c{g}y{j}"
    df = spark.createDataFrame(rows, "doc_id long, text string, cls string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.join_components(df, k, num, den).collect()}
    assert got == brute_components(rows, k, num, den)


def test_ngram_join_null_id_centre(spark):
    rng = random.Random(21)
    rows, nulls = [], []
    for g in range(4):  # a text without an id, and copies of it with one edit each
        w = words(rng, 300)
        nulls.append((None, " ".join(w)))
        for j in range(5):
            rows.append((100 * g + j, " ".join([*w[: 40 * j + 20], f"c{g}y{j}", *w[40 * j + 21 :]]), None))
    df = spark.createDataFrame([*((i, t) for i, t, _ in rows), *nulls], "doc_id long, text string")
    got = ngram_join.join_components(df, 3, 90, 100).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got if r.doc_id is not None} == brute_components(rows, 3, 90, 100)
    assert [r.component_id for r in got if r.doc_id is None] == [None] * 4


@pytest.mark.parametrize("block", [2048, 7])
def test_ngram_join_of_many_unlinked_variants(spark, block, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK", block, raising=False)
    rng = random.Random(5)
    base = [f"w{i}" for i in range(400)]

    def varied(words, share):  # runs of two words replaced by words of its own
        out = list(words)
        for at in rng.sample(range(0, len(out), 10), int(share * len(out) / 10)):
            out[at : at + 2] = [f"v{rng.random()}", f"v{rng.random()}"]
        return out

    texts = [varied(base, 0.15) for _ in range(160)]
    texts += [varied(t, 0.1) for t in texts[:40:4]]
    texts += [texts[160][:200] + t[200:] for t in texts[1:40:4]]
    docs = [" ".join(t) for t in texts]
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    made = []
    cut = ngram_join.cut

    def counted(d):
        out = cut(d)
        if out.columns == ["x", "y"]:
            made.append(out.count())
        return out

    monkeypatch.setattr(ngram_join, "cut", counted)
    got = {r.doc_id: r.component_id for r in ngram_join.join_components(df, 5, 80, 100).collect()}
    sets = [{tuple(t[i : i + 5]) for i in range(len(t) - 4)} for t in texts]
    root = list(range(len(sets)))
    for i in range(len(sets)):
        for j in range(i):
            if (both := len(sets[i] & sets[j])) * 100 >= 80 * (len(sets[i]) + len(sets[j]) - both) and root[i] != root[j]:
                lo, hi = sorted((root[i], root[j]))
                root = [lo if r == hi else r for r in root]
    assert got == dict(enumerate(root)) and 100 < len(set(root)) < len(sets)
    assert max(made) <= 20 * len(docs)  # 10,041 when pairs that the wide sketches tell apart were rows


def test_near_dups_keep_one_of_each_group(spark):
    base = " ".join(words(random.Random(9), 200))
    rows = [(5, base), (7, base + " x"), (9, None), (10, ""), (11, "short text"), (11, "short text"), (None, base)]
    df = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(r.doc_id for r in near_dups.keep_first(df).collect()) == [5, 9, 10, 11]
    assert near_dups.keep_first(df.limit(0)).count() == 0


def test_near_dups_judge_rows_not_ids(spark):
    rng = random.Random(10)
    a, b, c, d, e = (" ".join(words(rng, 200)) for _ in range(5))
    rows = [(5, a), (None, a), (None, b), (None, c), (None, None), (8, c + " x"), (8, d), (8, d + " x"), (8, ""), (8, None), (9, a + " x"), (9, e), (3, c)]
    df = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = near_dups.keep_first(df)
    assert got.columns == df.columns
    left = [(r.doc_id, r.text) for r in got.collect()]
    assert {t for i, t in left if i is None} == {b, None} and sum(i is None for i, _ in left) == 2
    assert {(i, t) for i, t in left if i not in (None, 8)} == {(5, a), (9, e), (3, c)}
    eight = [t for i, t in left if i == 8]
    assert sum(not t for t in eight) == 1 and sum(t in (d, d + " x") for t in eight) == 1 and len(eight) == 2
    assert len(left) == 7


@pytest.mark.parametrize("one_task", [components.ONE_TASK, 3])
def test_components(spark, one_task):
    rng = random.Random(2)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(100 + i, 101 + i) for i in range(40)] + [(None, 3), (7, 7)]
    root = {}

    def find(i):
        root.setdefault(i, i)
        while root[i] != i:
            i = root[i]
        return i

    for a, b in edges:
        if a is not None and a != b:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    got = {r.v: r.component for r in components.components(spark.createDataFrame(edges, "a long, b long"), one_task).collect()}
    assert components.components(spark.createDataFrame([(None, 3), (7, 7)], "a long, b long"), one_task).count() == 0
    assert got == {i: find(i) for i in root}


# quality rules


def test_base_counts(docs, rows):
    got = {r.doc_id: r for r in quality_rules.statistics(docs).collect()}
    for i, text, _ in rows:
        t = text or ""
        w = WORD.findall(t)
        count = Counter(tuple(w[j : j + 5]) for j in range(len(w) - 4))
        repeated = {p for j in range(len(w) - 4) if count[tuple(w[j : j + 5])] > 1 for p in range(j, j + 5)}
        lines = [x for x in t.split("\n") if WORD.search(x)]
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)))
        assert (r.n_dup_lines, r.n_repeat_words) == (len(lines) - len(set(lines)), len(repeated))
        assert r.base_failed == (len(w) < 10 or 100 * len(repeated) > 20 * len(w))


@pytest.mark.parametrize(("n", "k", "p"), [(10, 0, 0.3), (100, 3, 0.1), (5000, 1, 0.002), (4000, 0, 0.002), (20, 20, 0.5), (0, 0, 0.1), (300, 29, 0.1)])
def test_binomial_tail(spark, n, k, p):
    from math import comb

    exact = sum(comb(n, j) * p**j * (1 - p) ** (n - j) for j in range(k + 1)) if k < n * p else 1.0
    got = spark.range(1).select(quality_rules.binomial_tail(F.lit(n), F.lit(k), p).alias("t")).first().t
    assert got == pytest.approx(exact, rel=1e-9)


def test_cutoffs_reject_poor_and_keep_good(spark):
    rng = random.Random(3)
    rows, labels = [], []
    for i in range(4000):
        good = i % 2 == 0
        w = words(rng, 60)
        rows.append((i, " ".join(w if good else [x + "***" for x in w]), "en", "s", 1))
        labels.append((i, int(good), 0))
    docs, lab = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    out = {r.doc_id: r.kept for r in quality_rules.judge(docs, lab, alpha=0.02).collect()}
    assert not any(out[i] for i in range(1, 4000, 2)) and sum(out[i] for i in range(0, 4000, 2)) >= 0.98 * 2000
    none = quality_rules.judge(docs, lab.limit(0)).where("NOT base_failed AND NOT kept")
    assert none.count() == 0


def test_cutoffs_by_stratum_and_pooled(spark):
    from math import comb

    rng = random.Random(12)
    sizes = {"en": 900, "de": 600, "fr": 150, "es": 90, None: 0, "it": 60}
    stats, labels, i = [], [], 0
    for lang, n in sizes.items():
        for _ in range(n + 5):
            share = rng.choice([0.0] * 60 + [0.05, 0.11, 0.3]) if lang != "de" else rng.choice([0.0] * 10 + [0.4])
            stats.append((i, "1" if lang is None else f"0{lang}", False, share, 0.0, 0.0, 0.0, 0.0, 0.0))
            labels.append((i, 1 if len(labels) < 10**9 and _ < n else 0))
            i += 1
    stats.append((i, "0en", True, 1.0, 1.0, 1.0, 1.0, 1.0, 1.0))  # fails the base: no matter to the method
    labels.append((i, 1))
    df = spark.createDataFrame(stats, "doc_id long, stratum string, base_failed boolean, " + ", ".join(f"{r} double" for r in quality_rules.RULES))
    alpha, delta, grid = 0.02, 0.1, quality_rules.GRID
    got = {r.stratum: (r.cutoff, r.n_good, r.n_rejected, r.pooled) for r in quality_rules.cutoffs(df, spark.createDataFrame(labels, "doc_id long, quality int"), alpha, delta).collect()}
    order = sorted((s for s in sizes if sizes[s]), key=lambda s: (-sizes[s], s))
    enough = lambda n, k: (1 - alpha) ** n <= delta / (k + (k < len(order)))
    m = max([0, *(k for k in range(1, 6) if enough(sizes[order[k - 1]], k) and (k == len(order) or enough(sum(sizes[s] for s in order[k:]), k)))])
    assert m == 2
    level = delta / (m + 1)
    groups = [[s] for s in order[:m]] + [order[m:]]
    want = {}
    for g in groups:
        values = [2 * x[3] for x, (_, q) in zip(stats, labels) if x[1] in {"1" if s is None else f"0{s}" for s in g} and q and not x[2]]
        for k in range(grid - 1, -1, -1):
            over = sum(v > k / grid for v in values)
            if sum(comb(len(values), j) * alpha**j * (1 - alpha) ** (len(values) - j) for j in range(over + 1)) > level:
                break
            for s in g:
                want["1" if s is None else f"0{s}"] = (k / grid, len(values), over, g == groups[-1])
    assert got == want and {s for s in want if want[s][3]} == {"0fr", "0es", "0it"}


# pages


def test_html_extraction(spark):
    same = "common words repeated here on every page of the host and more of it"
    rows = [(i, f"https://h{i % 2}.x/{i}", f"<html><body><div>{same}</div><div>unique text number {i} alone</div><nav>{same}</nav></body></html>") for i in range(6)]
    rows += [
        (9, None, None),
        (10, "x", "<head><title>no</title></head><body><nav><a>m</a></nav><article><h1>T &amp</h1><p>a&nbsp;b &lt;i&gt;<br>c<script>var t='</p>';</script><p><b>d <div class='ad'>ad</div><section class=comments><p>no</p></section><p>e\n f&#x41;</article><footer>f"),
        (11, "y", "<main>" + "long " * 20000 + "</main>"),
        (12, "z", "<div>< 5 & 6 > 3</div><p title='a>b'>q</p>"),
    ]
    pages = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, text int")
    got = {r.page_id: r for r in html_extraction.extract(pages).collect()}
    assert {got[i].text for i in range(6)} == {f"unique text number {i} alone" for i in range(6)}
    assert got[9].text == "" and got[9].n_chars == 0
    assert got[10].text == "T &\n\na b <i> c\n\nd\n\ne fA"
    assert got[11].text == ("long " * 20000).strip() and got[11].n_chars == 99999
    assert got[12].text == "< 5 & 6 > 3\n\nq"
    assert html_extraction.extract(pages.limit(0)).count() == 0


def brute_pages(rows):
    """Text and covered bytes of each page, from all pairs of strings."""
    run = html_extraction.RUN
    placed = [html_extraction._placed(h) for _, _, h in rows]
    host = [re.match(r"https?://([^/]*)", u or "") for _, u, _ in rows]
    host = [m[1] if m else "" for m in host]
    held = {}
    for i, blocks in enumerate(placed):
        for kind, _, text in blocks:
            raw = text.encode()
            if kind != "article":
                for lo in range(max(1, len(raw) - run + 1)):
                    held.setdefault((host[i], raw[lo : lo + run]), set()).add(rows[i])
    out = []
    for i, blocks in enumerate(placed):
        covers = []
        for kind, at, text in blocks:
            raw = text.encode()
            if kind != "article":
                covers += [(at + lo, at + min(lo + run, len(raw))) for lo in range(max(1, len(raw) - run + 1)) if len(held[host[i], raw[lo : lo + run]]) > 1]
        out.append((rows[i][0], *html_extraction.main_text(rows[i][2], covers)))
    return sorted(out, key=str)


@pytest.mark.parametrize(("hot", "parts"), [(html_extraction.HOT_BYTES, 40), (0, 4)])
def test_html_host_runs(spark, hot, parts, monkeypatch):
    monkeypatch.setattr(html_extraction, "HOT_BYTES", hot)
    rng = random.Random(17)
    pool = [" ".join(words(rng, rng.choice([2, 6, 12, 30]), 40)) for _ in range(12)]
    rows = []
    for i in range(40):
        parts_ = []
        for _ in range(rng.randrange(6)):
            own = " ".join(words(rng, rng.choice([1, 5, 20])))
            text = rng.choice([own, rng.choice(pool), f"{own} {rng.choice(pool)} {own}", rng.choice(pool) + " é"])
            parts_.append(rng.choice(["<div>{}</div>", "<nav>{}</nav>", "<article><p>{}</p></article>", "<p>{}</p>"]).format(text))
        rows.append((i // 2 if i > 4 else None, f"http://h{i % 3}/{i % 5}", "".join(parts_)))
    rows += [rows[7], (50, None, None), (51, "http://h1/", "")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        got = sorted(((r.page_id, r.text, r.n_repeated) for r in html_extraction.extract(df).collect()), key=str)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert got == brute_pages(rows)
    assert sum(n for _, _, n in got) > 500


def test_html_notices_in_articles(spark):
    notice = "this long notice stands in every article of the host " * 4
    quote = "a passage that three articles quote from one another " * 4
    rows = [(i, f"http://h/{i}", f"<article><p>own text of page {i}</p><p>{notice}</p>" + (f"<p>{quote}</p>" if i < 3 else "") + "</article>") for i in range(12)]
    got = {r.page_id: r.text for r in html_extraction.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[5] == "own text of page 5" and got[1] == f"own text of page 1\n\n{quote.strip()}"
    assert html_extraction.main_text("<article class='comment'><p>no</p></article><article><p>yes</p></article>", [])[0] == "yes"


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ('<div class="layout has-sidebar"><article><p>in</p></article><div class="sidebar">off</div></div>', "in"),
        ("<header>site</header><article><header><h1>Title</h1></header><p>body</p><footer>author</footer></article><footer>site</footer>", "Title\n\nbody\n\nauthor"),
        ('<article><div class="entry-header"><h1>Title</h1></div><p>Prices <span class="share">12</span> rose.</p></article>', "Title\n\nPrices 12 rose."),
        ("<article><p>in</p><div hidden>off</div><div hidden=until-found>found</div><p style='color:red; display : none'>off</p></article>", "in\n\nfound"),
        ('<article><p>a <span aria-hidden="true">x</span>b <button>ok</button>c</p><p>d</article>', "a b c\n\nd"),
        ('<article><p>a <i role="navigation">never closed</p><p>b</p></article>', "a\n\nb"),
        ("<article><p>in</p></article><div class='comments'><article><p>reader</p></article></div><aside><article>off</article></aside>", "in"),
        ("<html><head><title>t</title><body><article>in</article>", "in"),
        ("<article class='comment'><p>no</p></article><article><p data-x='class=sidebar'>yes</p></article>", "yes"),
        ('<body class="no-sidebar"><div class="page-sidebar-left"><p>the only text of the page</p></div><div class="menu">off</div></body>', "the only text of the page"),
        ("<article>a < b and c > d<!-- off", "a < b and c > d"),
        ("<article>a<script>var x = '</p>';", "a"),
    ],
)
def test_html_scopes(page, text):
    assert html_extraction.main_text(page, [])[0] == text


@pytest.mark.parametrize("bad", ['<a x="', "<a x='", "<a x=\"'>", "<!-- ", "<script>", '<p class="', "<", "<div ", '<a x="> ', "<span hidden>", "<p>"])
def test_html_broken_markup_is_linear(bad):
    for end in ("", ">"):
        began = time.perf_counter()
        html_extraction.blocks(bad * (1_000_000 // len(bad)) + end)
        assert time.perf_counter() - began < 10


# sharding and mixing


def test_sharding(spark, docs, rows):
    out = sharding.assign(docs).collect()
    assert len(out) == len(rows)
    by = Counter(r.shard for r in out)
    assert max(by.values()) - min(by.values()) <= 1
    for s in range(8):
        assert sorted(r.slot for r in out if r.shard == s) == list(range(by[s]))
    text = {i: (t or "").encode() for i, t, _ in rows}
    assert all(r["size"] == len(text[r.doc_id]) + 1 and r.text_crc32 == zlib.crc32(text[r.doc_id]) for r in out)
    source = {i: s for i, _, s in rows}
    for s in set(source.values()):
        per = Counter(r.shard for r in out if source[r.doc_id] == s)
        assert max(per[k] for k in range(8)) - min(per[k] for k in range(8)) <= 2
    assert sharding.assign(docs.limit(0)).count() == 0
    twice = docs.union(docs.limit(5))
    whole = sharding.shard_table(twice)
    assert whole.count() == len(rows) + 5 == whole.select("shard", "slot").distinct().count()
    assert whole.columns == [*docs.columns, "shard", "slot"]


def test_mixing(spark, docs, rows):
    out = mixing.taken(docs, block=64).collect()
    size = {i: len(WORD.findall(t or "")) for i, t, _ in rows}
    per = Counter()
    for i, _, s in rows:
        per[s] += size[i]
    names = sorted(per, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    target, open_, left = {}, set(names), float(sum(per.values()))
    while True:
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = [s for s in open_ if share[s] > 3 * per[s]]
        if not over:
            break
        for s in over:
            target[s] = 3.0 * per[s]
            left -= target[s]
            open_.discard(s)
    target |= share
    source = {i: s for i, _, s in rows}
    got = Counter()
    for r in out:
        s = source[r.doc_id]
        assert r["size"] == size[r.doc_id] and r.source_size == per[s] and r.target == pytest.approx(target[s])
        assert r.taken <= 3 * r["size"]
        got[s] += r.taken
    assert len(out) == len(rows) and all(abs(got[s] - target[s]) <= 1 for s in names)
    again = mixing.taken(docs, block=64).collect()
    assert sorted((r.doc_id, r.taken) for r in out) == sorted((r.doc_id, r.taken) for r in again)
    words_ = Counter()
    mixed = mixing.mix_table(docs, block=64)
    assert mixed.columns == docs.columns
    for r in mixed.collect():
        words_[r.source] += len(WORD.findall(r.text or ""))
    assert all(abs(words_[s] - target[s]) <= max(size.values()) for s in names)
    assert mixing.taken(docs.limit(0)).count() == 0 == mixing.mix_table(docs.limit(0)).count()


def test_schedule_is_even(spark):
    sources = spark.createDataFrame([("0a", 64_000, 64_000.0), ("0b", 64_000, 32_000.0), ("0c", 64_000, 8_000.0)], "_src string, source_size long, target double")
    slots = mixing.schedule(sources, block=64).orderBy("_slot").collect()
    assert Counter(r._src for r in slots) == {"0a": 1000, "0b": 500, "0c": 125}
    for upto in (200, 700, 1300):
        assert abs(sum(r._src == "0b" for r in slots[:upto]) - upto * 500 / 1625) < 8


def test_mix_is_even_all_the_way(spark):
    rng = random.Random(6)
    docs = spark.createDataFrame([(i, " ".join(words(rng, rng.randrange(1, 12))), "en", "abc"[rng.choice([0, 0, 0, 0, 1, 1, 2])], 1, "x") for i in range(3000)], "doc_id long, text string, lang string, source string, n_chars long, _slot string")
    info = {r.doc_id: r for r in mixing.taken(docs, block=40).collect()}
    mixed = [(r.doc_id, r.source, len(r.text.split())) for r in mixing.mix_table(docs, block=40).collect()]
    target = {s: next(info[i].target for i, x, _ in mixed if x == s) for s in "abc"}
    whole, have, far = sum(target.values()), Counter(), 0.0
    for _, s, n in mixed:
        have[s] += n
        done = sum(have.values())
        far = max(far, *(abs(have[x] - done * target[x] / whole) for x in "abc"))
    assert far < 8 * 40  # a few blocks at any place, of some 500
    first = {}
    for place, (i, _, _) in enumerate(mixed):
        first.setdefault(i, place)
    order = sorted(first, key=first.get)
    slots = [info[i].first_slot if info[i].first_slot is not None else -1 for i in order if info[i].taken]
    assert slots == sorted(slots) and len(set(slots)) > 300


# language model


def test_lm_scoring(spark, docs, rows):
    mu = lm_scoring.MU
    data = {i: [*WORD.findall((t or "").translate(ASCII)), None] for i, t, _ in rows}
    held = {i: zlib.crc32(str(i).encode()) % 10 == 0 for i in data}
    uni, bi = Counter(), Counter()
    for i, w in data.items():
        if not held[i]:
            uni.update(w)
            bi.update(zip([0, *w[:-1]], w))
    n, v, starts = sum(uni.values()), len(uni), uni[None]
    for block in (1 << 14, 1 << 30):
        got = {r.doc_id: r for r in lm_scoring.score(docs, block, 3 * block).collect()}
        assert len(got) == len(rows)
        for i, w in data.items():
            p = [(uni[x] + 0.1) / (n + 0.1 * (v + 1)) for x in w]
            c = [starts if y == 0 else uni[y] for y in [0, *w[:-1]]]
            s = sum(log10((bi[y, x] + mu * q) / (cc + mu)) for y, x, q, cc in zip([0, *w[:-1]], w, p, c))
            r = got[i]
            assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[i], len(w), sum(uni[x] > 0 for x in w), n)
            assert r.base_score == pytest.approx(sum(map(log10, p))) and r.score == pytest.approx(s)
    assert lm_scoring.score(docs.limit(0)).count() == 0


def test_lm_probabilities_sum_to_one():
    unigrams, bigrams = np.array([5, 3, 2]), np.array([2, 1, 0])
    m = lm_scoring.Automaton(unigrams, bigrams, 10, 3, 4, 7.0)
    state = np.zeros(3, int)
    total = (10 ** m.step(state, np.arange(3), np.arange(3))).sum()
    unseen = 0.1 / 10.4 * 7 / 12  # all words that training does not have, together
    assert total + unseen == pytest.approx((3 + 7) / 12)  # 5 visits of which 3 went on to these words


# classifier


def ordinal_objective(x, grade, w, b):
    """Weighted log-likelihood of graded ratings less the penalty."""
    s = x @ w
    tail = np.stack([np.ones(len(s)), 1 / (1 + np.exp(b[0] - s)), 1 / (1 + np.exp(b[1] - s)), np.zeros(len(s))])
    cell = tail[grade, np.arange(len(s))] - tail[grade + 1, np.arange(len(s))]
    return (np.log(np.maximum(cell, 1e-9)) / (3 * np.bincount(grade)[grade])).sum() - 1e-4 * (w * w).sum()


def test_classifier_against_plain_likelihood():
    rng = random.Random(31)
    vocabulary = [f"tok{i}" for i in range(30)]
    text, grade = [], []
    for i in range(600):
        g = i % 3
        text.append(" ".join(rng.choice(vocabulary[:12] if rng.random() < 0.25 + 0.25 * g else vocabulary[12:]) for _ in range(8)))
        grade.append(g)
    h, doc, shapes = quality_classifier.features(pa.array(text))
    keys, at = quality_classifier._distinct(np.concatenate((h, shapes.reshape(-1))), np.concatenate((doc, np.repeat(np.arange(600), shapes.shape[1]))))
    model = quality_classifier.fit(keys, at, np.array(grade), np.zeros(600, bool))
    known = {int(k): j for j, k in enumerate(model.keys)}
    rows = [[known[int(k)] for k in keys[at == i] if int(k) in known] for i in range(600)]
    x, g = np.zeros((600, len(known))), np.array(grade)
    for i, row in enumerate(rows):
        x[i, row] = 1
    value = lambda p: ordinal_objective(x, g, p[:-2], p[-2:])
    found = np.concatenate((model.weights, model.thresholds))
    assert value(found) > value(np.concatenate((np.zeros(len(known)), [log(1 / 2), log(2)]))) + 0.05  # better than the shares alone
    # a plain climb by differences, from the fit and from nothing, finds nothing much better
    for p in (found.copy(), np.concatenate((np.zeros(len(known)), [-1.0, 1.0]))):
        speed = np.zeros(len(p))
        for _ in range(400):
            slope = np.array([value(p + d) - value(p - d) for d in np.eye(len(p)) * 1e-4]) / 2e-4
            speed = 0.9 * speed + 0.5 * slope
            p = p + speed
        assert value(p) <= value(found) + 0.01
    tails = model.tails(h, doc, shapes)
    for i in range(0, 600, 37):
        s = sum(model.weights[j] for j in rows[i])
        assert tails[i].tolist() == pytest.approx([1 / (1 + exp(b - s)) for b in model.thresholds])
    assert model.thresholds[0] < model.thresholds[1]


def test_classifier_reads_whole_sampled_texts(spark):
    """What tells the grades stands among thousands of other words, so a text cut at any length would miss it in some; several texts of one id fit alike in any order."""
    rng = random.Random(12)
    rows, labels = [], []
    for i in range(120):
        body = [f"w{rng.randrange(10**6)}" for _ in range(6000 if i % 4 == 0 else 40)]
        body.insert(rng.randrange(len(body)), f"mark{i % 3}")
        rows.append((i, " ".join(body)))
        labels.append((i, i % 3 // 2, int(i % 3 == 0)))
    rows += [(3, "another text of this id"), (3, "a third")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    rated = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    one, two = quality_classifier.train(docs.repartition(3), rated, 100), quality_classifier.train(docs.orderBy(F.desc("text")).coalesce(1), rated, 100)
    assert (one.keys == two.keys).all() and (one.weights == two.weights).all()
    marks = [quality_classifier.features(pa.array([f"mark{k}"]))[0][0] for k in range(3)]
    assert all(np.isin(m, one.keys) for m in marks)
    grade = {r.doc_id: r.expected_grade for r in quality_classifier.classify(docs.where("doc_id <> 3"), one).collect()}
    mean = [np.mean([g for i, g in grade.items() if i % 3 == k]) for k in range(3)]
    assert mean[0] + 0.3 < mean[1] < mean[2] - 0.3


def test_classifier_on_held_out_grades(spark):
    rng = random.Random(6)
    bad = ["awful", "nasty", "horrid"]
    rows, labels = [], []
    for i in range(1500):
        w = words(rng, rng.randint(30, 300))
        kind = i % 3
        if kind == 0:
            for _ in range(4):
                w.insert(rng.randrange(len(w)), rng.choice(bad))
        if kind == 1:
            w = [x.upper() + "!!" for x in w]
        rows.append((i, " ".join(w), "en", "s", 1))
        if i < 900:
            labels.append((i, int(kind != 1), int(kind == 0)))
    docs = spark.createDataFrame([*rows, (9999, None, None, None, None)], "doc_id long, text string, lang string, source string, n_chars long")
    model = quality_classifier.train(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), 250)
    assert model.thresholds[0] < model.thresholds[1]
    out = {r.doc_id: r for r in quality_classifier.classify(docs, model).collect()}
    fresh = range(900, 1500)
    assert np.mean([out[i].kept == (i % 3 == 2) for i in fresh]) > 0.97
    means = [np.mean([out[i].expected_grade for i in fresh if i % 3 == k]) for k in range(3)]
    assert means[0] < means[1] < means[2]
    kept = quality_classifier.select_good(docs, model)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i, r in out.items() if r.kept}
    nothing = quality_classifier.train(docs, spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert all(r.kept for r in quality_classifier.classify(docs, nothing).collect())


# clashing columns and empty tables


def test_extra_columns_with_clashing_names(spark):
    docs = documents(spark, 2, 12, wide=True)
    n = docs.count()
    labels = spark.createDataFrame([(0, 1, 0), (3, 0, 1)], "doc_id long, quality int, toxic int")
    assert suffix_dedup.dedup(docs).count() == n
    assert ngram_join.join_components(docs).count() == n
    assert quality_rules.judge(docs, labels).count() == n
    assert sharding.assign(docs).count() == n == sharding.shard_table(docs).count()
    assert mixing.taken(docs).count() == n
    assert lm_scoring.score(docs).count() == n
    assert token_counts.histogram(docs).agg(F.sum("n_docs")).first()[0] == n
    assert near_dups.keep_first(docs).columns == docs.columns


def test_empty_documents(spark):
    docs = empty(spark)
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    for out in (suffix_dedup.dedup(docs), ngram_join.join_components(docs), quality_rules.judge(docs, labels), sharding.shard_table(docs), token_counts.with_totals(token_counts.histogram(docs)), quality_classifier.classify(docs, quality_classifier.train(docs, labels))):
        assert out.count() == 0
