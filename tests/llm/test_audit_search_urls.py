"""The filter audit, the url filters and the ranked search against brute force, with edge cases."""

import math
import random
import re
from collections import Counter, defaultdict
from itertools import permutations

import numpy as np
import pytest
from fixtures import WIDE, documents, empty, odd_rows
from pyspark.sql import functions as F

from wayfold.llm import filter_audit, ranked_search, url_filters

WORD = re.compile(r"[^\x20\x09-\x0D]+")
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOW = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})

# filter audit


def brute_audit(rows, labels):
    least = {}
    for i, text, _ in rows:
        if i is not None:
            least[text or ""] = min(i, least.get(text or "", i))
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    fails = []
    for i, text, source in rows:
        t = text or ""
        w = WORD.findall(t)
        f = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 2 * len(t), "D": bool(re.search("[#$%&*|]", t)), "E": i is not None and i > least[t]}
        fails.append((source or "", {k for k, v in f.items() if v}, i in good, i in toxic))
    out = {}
    for part in {f[0] for f in fails}:
        mine = [f for f in fails if f[0] == part]
        removed = Counter()
        for order in permutations("ABCDE"):
            for k, x in enumerate(order):
                here = [f for f in mine if x in f[1] and not f[1] & set(order[:k])]
                removed[x] += len(here)
                out[part, "".join(order), k + 1] = [sum(not f[1] & set(order[: k + 1]) for f in mine), len(here), sum(x in f[1] for f in mine) - len(here), sum(f[1] == {x} for f in mine), sum(f[2] for f in here), sum(f[3] for f in here)]
        for order in permutations("ABCDE"):
            for k, x in enumerate(order):
                out[part, "".join(order), k + 1].append(removed[x])
    return out


LABELS = [(i, i % 2, (i % 3 == 0) * 1) for i in range(0, 90)] + [(None, 1, 1), (5, None, 1), (5, 1, 0), (7, None, None)]


def audit_rows():
    rng = random.Random(5)
    words = [f"w{i}" for i in range(900)]
    texts = [" ".join(rng.sample(words, n)) for n in (10, 199, 200, 201, 300, 400)]
    texts += [" ".join(["aa bb"] * 150), "AB " * 100, "#" + texts[3], texts[4] + " * x", "É" * 40 + "A", "\x0b".join(texts[4].split()), "\n\n" + texts[3], "x" * 200_000, " ".join(words) * 40, "A" * 2 + "b" * 98, "A" * 3 + "b" * 97]
    rows = [(i, rng.choice(texts), rng.choice([None, "", "s0", "s0", "s1"])) for i in range(120)]
    return rows + [(None, texts[0], "s0"), (None, texts[0], "s0"), (3, rows[3][1], "s1"), (3, "other", "s1"), (200, None, "s0"), (201, None, None), (202, "", "s2")]


@pytest.mark.parametrize("partitions", [3, 40])
def test_filter_audit(spark, partitions):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    rows = audit_rows()
    docs = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], "doc_id long, text string, source string, mask int, part string, good int")
    labels = spark.createDataFrame([(*r, 1) for r in LABELS], "doc_id long, quality int, toxic int, mask int")
    got = filter_audit.audit(docs, labels).collect()
    spark.conf.set("spark.sql.shuffle.partitions", before)
    want = brute_audit(rows, LABELS)
    assert len(got) == len(want) == 600 * len({r[2] or "" for r in rows})
    assert {(r.part, r.filter_order, r.step): list(r[3:]) for r in got} == want


def test_filter_audit_of_nothing(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.audit(empty(spark), labels).count() == 0
    one = spark.createDataFrame([(None, None, None)], "doc_id long, text string, source string")
    got = filter_audit.audit(one, labels).collect()
    assert len(got) == 600 and {r.removed for r in got if r.filter_order[r.step - 1] == "A"} == {1} and sum(r.shapley for r in got) == 120 * 120


def test_hot_group_of_copies_stays_spread(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "one text").otherwise(F.concat(F.lit("t"), "id")).alias("text"), F.lit("s").alias("source"))
    labels = spark.createDataFrame([(0, 1, 0)], "doc_id long, quality int, toxic int")
    cells = {r["mask"]: (r["n"], r["good"]) for r in filter_audit.cells(docs, labels).collect()}
    assert cells == {1: (2001, 1), 17: (999, 0)}


# url filters


def brute_model(train, kept):
    """log P(next | before) of a class over whole texts, straight from the estimate."""
    order = url_filters.ORDER
    count = {k: Counter() for k in (True, False)}
    for text, ok in train:
        for i in range(len(text)):
            for k in range(1 if i == 0 else 0, min(order + 1, len(text) - i) + 1):
                count[ok][text[i : i + k]] += 1
    keep = {s for ok in count for s, c in count[ok].items() if c * kept >= count[ok][""]}
    follow = {ok: defaultdict(dict) for ok in count}
    for ok in count:
        for s, c in count[ok].items():
            if s and s != url_filters.START:
                follow[ok][s[:-1]][s[-1]] = c

    def p(ok, context, char):
        below = 1 / url_filters.ALPHABET if not context else None
        if context not in keep:
            return p(ok, context[1:], char)
        shorter = below if below else p(ok, context[1:], char)
        f = follow[ok][context]
        if not f:
            return shorter
        n, d = count[ok][context], len(f)
        e = d + sum(c for x, c in f.items() if context + x not in keep)
        own = f.get(char, 0) if context + char in keep else 0
        return (own + e * shorter) / (n + d)

    return p


URLS = ["http://%s.example.%s/%s/%s%d" % (random.Random(i).choice(["blog.tion", "www.pills", "news", "cheap-spam"]), random.Random(i * 7).choice(["net", "com", "org"]), random.Random(i * 13).choice(["en", "de", "fr", "es"]), "abcxyz"[i % 6], i) for i in range(240)]
ODD = [None, "", "no scheme.net/x", "http://", "HTTP://A.B.NET", "http://example.net/en/", "http://a.example.net/en/x?u=http://q.net/", "https://notexample.net/en/", "ftp://ORG/fr/é", "x://org#/fr/", "http://net/", "://net/a", "http://a.org/FR/", "http://a.com/\x02\x03q", "http://" + "lo" * 5000 + ".com/" + "z/" * 5000, "http://example.com/de", "http://sub.example.com/de/"]


def brute_parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.split("[/?#]", rest)[0]
    path = re.split("[?#]", rest[len(host) :])[0]
    return host.translate(LOW), path


def brute_rule(host, path):
    fits = [(len(h + p), v, h + p) for v, h, p in url_filters.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits)[1:] if fits else (None, None)


@pytest.mark.parametrize("kept", [url_filters.STRINGS, 60])
def test_url_filters(spark, kept):
    urls = URLS + ODD + URLS[:20]
    pages = spark.createDataFrame([(None if i == 3 else i, u, "<p>", "q", 1) for i, u in enumerate(urls)], "page_id long, url string, html string, text string, rule int")
    got = url_filters.judge(pages, kept=kept).collect()
    assert Counter(r.page_id for r in got) == Counter(None if i == 3 else i for i in range(len(urls)))
    text = lambda h, p: "\x02" + (h + p).translate(str.maketrans("123456789\x02\x03", "000000000  ")) + "\x03"
    import hashlib

    held = lambda t: hashlib.md5(t.encode()).hexdigest()[0] in "012"
    rows = [(*brute_parts(u), *brute_rule(*brute_parts(u))) for u in urls]
    train = [(text(h, p), v == "allow") for h, p, v, _ in rows if v and not held(text(h, p))]
    p = brute_model(train, kept)

    def micro(t):
        order, x = url_filters.ORDER, 0.0
        for i in range(1, len(t)):
            context = t[max(0, i - order) : i]
            x += math.log(p(True, context, t[i])) - math.log(p(False, context, t[i]))
        return x / (len(t) - 1)

    scores = {(h, q): micro(text(h, q)) for h, q, _, _ in rows}
    for r in got:
        assert (r.host, r.path) in scores and r.score == pytest.approx(scores[r.host, r.path], abs=2e-5)
        verdict, rule = brute_rule(r.host, r.path)
        assert r.rule == rule and (verdict is None or r.verdict == verdict)
    # the cutoff: no other threshold parts the held-out urls better
    of = {(r.host, r.path): r for r in got}
    calibrate = [(math.floor(of[h, q].score * 1000 + 1e-9), v == "allow") for h, q, v, _ in rows if v and held(text(h, q))]
    na, nr = sum(ok for _, ok in calibrate), sum(not ok for _, ok in calibrate)
    gain = lambda least: sum(b < least for b, ok in calibrate if not ok) * na - sum(b < least for b, ok in calibrate if ok) * nr
    least = url_filters.cutoff(spark.createDataFrame([(b * 1000, ok) for b, ok in calibrate], "micro long, accepted boolean"))
    assert na and nr and gain(least / 1000) == max(gain(b + 1) for b, _ in calibrate) > 0
    free = [r for r in got if r.rule is None]
    assert {r.verdict for r in free} == {"allow", "block"}
    assert all((r.verdict == "block") == (round(r.score * 1e6) < least) for r in free)


def test_url_models_sum_to_one():
    p = brute_model([("\x02ab.a\x03", True), ("\x02abc\x03", True), ("\x02bb\x03", False), ("\x02abab\x03", False)], 4)
    for ok in (True, False):
        for context in ("", "a", "ab", "\x02a", "zz"):
            seen = set("abc.\x03")
            rest = (url_filters.ALPHABET - len(seen)) * p(ok, context, "?")
            assert sum(p(ok, context, c) for c in seen) + rest == pytest.approx(1)


def test_url_filters_without_labels(spark):
    for urls in ([], ["http://a.com/x", None], ["http://a.net/x", "http://b.net/y"]):
        got = url_filters.judge(spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id long, url string")).collect()
        assert [(r.verdict, r.score) for r in got] == [("block" if "net" in (u or "") else "allow", 0.0) for u in urls]


# ranked search


def brute_search(docs, items, k=50):
    of = [(i, TERM.findall((t or "").translate(LOW))) for i, t in docs]
    n_docs, n_terms = sum(bool(t) for _, t in of), sum(len(t) for _, t in of)
    df = Counter(x for _, t in of for x in set(t))
    queries = defaultdict(set)
    for i, t in items:
        queries[i] |= set(TERM.findall((t or "").translate(LOW)))
    out = {}
    for item, terms in queries.items():
        found = []
        for i, t in of:
            tf = Counter(t)
            m = 50 + (50 * len(t) * n_docs) // max(1, n_terms)
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[x] + 1))) * ((1_000_000_000 * tf[x]) // (1000 * tf[x] + 20 * m)) for x in terms if tf[x])
            if score > 0:
                found.append((-score, i is None, i or 0))
        out |= {(item, rank): (None if null else i, -s) for rank, (s, null, i) in enumerate(sorted(found)[:k], 1)}
    return out


def items_of(rows):
    rng = random.Random(3)
    long_ = [r[1] for r in rows if r[1] and len(r[1].split()) > 30]
    items = [(i, " ".join(rng.choice(long_).split()[5:25])) for i in range(12)]
    return items + [(3, "w1x W2X"), (None, "w3x w4x"), (90, None), (91, " ... "), (92, "no-such term"), (93, "É À rep"), (94, long_[0]), items[0]]


@pytest.mark.parametrize("k,block,partitions", [(50, 10**6, 4), (3, 10**6, 3), (3, 20, 40)])
def test_ranked_search(spark, k, block, partitions):
    rows = [(r.doc_id, r.text) for r in documents(spark, n=90).collect()] + [(r[0], r[1]) for r in odd_rows()]
    docs = spark.createDataFrame([(*r, 1, "x", 2, 3) for r in rows], "doc_id long, text string, n int, terms string, rank int, item_id int").repartition(partitions)
    items = items_of(rows)
    bench = spark.createDataFrame([(*i, 1) for i in items], "item_id long, text string, term int")
    got = ranked_search.search(docs, bench, k, block).collect()
    assert len(got) == len({(r.item_id, r["rank"]) for r in got})
    assert {(r.item_id, r["rank"]): (r.doc_id, r.score) for r in got} == brute_search(rows, items, k)


def test_ranked_search_of_nothing(spark):
    bench = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    one = spark.createDataFrame([(1, "a"), (2, None)], "doc_id long, text string")
    assert ranked_search.search(empty(spark), bench).count() == 0
    assert ranked_search.search(one, none).count() == 0
    assert [(r.item_id, r["rank"], r.doc_id) for r in ranked_search.search(one, bench).collect()] == [(1, 1, 1)]


def test_bytes_bound_every_impact():
    rng = np.random.default_rng(1)
    tf, m = rng.integers(1, 10**6, 10**5), rng.integers(50, 10**7, 10**5)
    x = ranked_search.impacts(tf, m)
    q = -(-x // ranked_search.STEP)
    assert q.max() <= 255 and (x <= q * ranked_search.STEP).all() and (x[q > 0] > (q[q > 0] - 1) * ranked_search.STEP).all() and not x[q == 0].any()


def test_bounds_drop_most_documents(spark):
    """What the bytes leave to score exactly is little more than the answer."""
    rng = random.Random(2)
    docs = [(i, " ".join(rng.choice(["aa", "bb", "cc", f"r{rng.randrange(50)}", f"q{rng.randrange(900)}"]) for _ in range(rng.randrange(5, 300)))) for i in range(1500)]
    bench = [(i, f"aa r{i} q{i} q{i + 7}") for i in range(10)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    q = ranked_search.Queries.of(ranked_search.item_terms(spark.createDataFrame(bench, "item_id long, text string")).toArrow())
    got = ranked_search._search(df, q, 10).collect()
    assert len(got) <= 10 * 4 * 10 and (q.floor > 1).all()
    assert {(r.item_id, r["rank"]): (r.doc_id, r.score) for r in ranked_search._top(spark.createDataFrame(got), "item_id", [F.desc("score"), F.asc("doc_id")], 10, "rank").collect()} == brute_search(docs, bench, 10)
