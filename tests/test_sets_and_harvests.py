"""Closeness by bit sets, bitmaps, filters, VARIANT fields and table functions against plain loops, with nulls, repeats and nothing."""

import json
import random
from collections import Counter, defaultdict, deque

import pytest
from pyspark.sql import functions as F
from test_selection_supply import key, plain_mix, true

from wayfold.functions import variants
from wayfold.operators import graph, harvest, pools, sketches
from wayfold.operators import windows as W
from wayfold.plans import pool_queries as P
from wayfold.plans import set_queries as Q
from wayfold.plans.base import QUERIES, Tables


def plain_closeness(edges, sources, depth):
    near = defaultdict(set)
    for a, b in edges:
        near[a].add(b)
    out = {n: (0, 0, None) for n in {x for e in edges for x in e} | set(sources)}
    for s in set(sources):
        seen, frontier = {s: 0}, deque([s])
        while frontier:
            n = frontier.popleft()
            for m in near[n] - seen.keys():
                if depth is None or seen[n] < depth:
                    seen[m] = seen[n] + 1
                    frontier.append(m)
        for n, d in seen.items():
            r, t, f = out[n]
            out[n] = (r + 1, t + d, max(f or 0, d))
    return out


@pytest.mark.parametrize("depth", [None, 3])
def test_closeness(spark, depth):
    rng = random.Random(1)
    edges = [(rng.randrange(150), rng.randrange(150)) for _ in range(230)] + [(7, 7), (1, 2), (1, 2)] + [(200 + i, 201 + i) for i in range(8)]
    sources = [rng.randrange(150) for _ in range(130)] + [200, 500]  # more than two words, repeats, one off the graph
    df = spark.createDataFrame(edges, "src int, dst int")
    got = {r["node"]: (r["reached"], r["total"], r["farthest"]) for r in graph.closeness(df, spark.createDataFrame([(s,) for s in [*sources, None]], "src int"), depth).collect()}
    edges = [e for e in edges if e[0] != e[1]]
    assert got == plain_closeness(edges, sources, depth)


def test_closeness_holds_no_rows_of_empty_words(spark, monkeypatch):
    """A row per node and filled word: 2,000 pairs of nodes have 63 words, and no node more than two of them."""
    held, stored = [], graph.stored

    def counted(df):
        out = stored(df)
        held.append(out[0].count())
        return out

    monkeypatch.setattr(graph, "stored", counted)
    edges = spark.range(4000).selectExpr("id AS src", "id + 1 - 2 * (id % 2) AS dst")
    got = graph.closeness(edges, edges.select("src"), 3)
    assert got.where("reached = 2 AND total = 1 AND farthest = 1").count() == got.count() == 4000
    assert max(held) <= 8000


def test_closeness_of_nothing(spark):
    none = spark.createDataFrame([], "src int, dst int")
    assert graph.closeness(none, none.select("src")).count() == 0
    assert [tuple(r) for r in graph.closeness(none, spark.createDataFrame([(4,)], "src int")).collect()] == [(4, 1, 0, 0)]


def test_bitmaps(spark):
    rng = random.Random(2)
    rows = [(rng.choice("ab"), rng.choice(["x", "y", None]), rng.choice([None, rng.randrange(100_000), 5])) for _ in range(3000)]
    table = sketches.bitmaps(spark.createDataFrame(rows, "s string, c string, id long"), ["s", "c"], "id").cache()
    for by in (["s", "c"], ["s"], ["c"]):
        want = defaultdict(set)
        for s, c, i in rows:
            if i is not None:
                want[tuple({"s": s, "c": c}[b] for b in by)].add(i)
        assert {tuple(r[b] for b in by): r["ids"] for r in sketches.distinct(table, by).collect()} == {k: len(v) for k, v in want.items()}
    of = lambda s: {i for x, _, i in rows if x == s and i is not None}
    assert tuple(sketches.common(table, "s", "a", "b").first()) == (len(of("a")), len(of("b")), len(of("a") & of("b")))
    assert sketches.distinct(sketches.bitmaps(spark.createDataFrame([], "s string, id long"), ["s"], "id"), ["s"]).count() == 0


def test_filter_loses_and_adds_no_row(spark, monkeypatch):
    rng = random.Random(3)
    rows = [(i, rng.choice([None, f"d{rng.randrange(4000)}", "hot"])) for i in range(6000)]
    used = [(f"d{i}",) for i in range(0, 4000, 3)] + [("hot",), ("hot",), (None,)]
    df, u = spark.createDataFrame(rows, "id int, digest string"), spark.createDataFrame(used, "digest string")
    sure, maybe = sketches.sieved(df, u, ["digest"])
    taken = {d for (d,) in used}
    assert not {r["digest"] for r in sure.collect()} & (taken - {None})
    free = [r for r in rows if r[1] not in taken or r[1] is None]
    n = maybe.where("digest IS NOT NULL").count() - sum(r[1] in taken and r[1] is not None for r in rows)
    assert 0 <= n < 0.05 * len(free)  # rows shuffled without need
    plain = lambda d: sorted(map(tuple, d.select("id", "digest").collect()), key=str)
    want = plain(pools.exclude(df, u, ["digest"]))
    assert plain(sketches.exclude(df, u, ["digest"])) == want
    monkeypatch.setattr(sketches, "LARGEST", 1)
    assert plain(sketches.exclude(df, u, ["digest"])) == want
    assert sketches.exclude(df, u.limit(0), ["digest"]).count() == len(rows) and sketches.exclude(df.limit(0), u, ["digest"]).count() == 0


DOCS = ['{"b": 1, "a": {"y": [1, {"z": "t"}], "x": null}}', '{"a":{"x":null,"y":[1,{"z":"t"}]},"b":1}', '{"b": 1.0}', "[]", '"s"', "{}", "no json", None, '[[1, 2], [3]]', '{"é":"\\u00e9","c":"é"}']


def test_variants(spark):
    df = spark.createDataFrame(list(enumerate(DOCS)), "id int, js string")
    got = {r["id"]: r for r in df.select("id", variants.canonical(F.col("js")).alias("c"), variants.fingerprint(F.col("js")).alias("f"), variants.read(F.col("js"), "$.b", "long").alias("b"), variants.read(F.col("js"), "$.a.y[1].z", "string").alias("z")).collect()}
    assert got[0]["f"] == got[1]["f"] and got[0]["c"] == '{"a":{"x":null,"y":[1,{"z":"t"}]},"b":1}' and got[6]["c"] is None is got[7]["f"]
    assert [got[i]["b"] for i in (0, 2, 3)] == [1, 1, None] and got[0]["z"] == "t"

    def plain(v, path):
        if isinstance(v, dict) and v:
            return [x for k, w in v.items() for x in plain(w, f"{path}.{k}")]
        if isinstance(v, list) and v:
            return [x for w in v for x in plain(w, f"{path}[]")]
        return [(path, json.dumps(v, ensure_ascii=False))]

    found = Counter((r["id"], r["path"], r["value"]) for r in variants.leaves(df.where("id <> 2"), "id", "js").collect())
    want = Counter((i, *x) for i, d in enumerate(DOCS) if i not in (2, 6, 7) for x in plain(json.loads(d), "$"))
    assert found == want
    assert variants.schema(df.where("id < 3"), "js") == "OBJECT<a: OBJECT<x: VOID, y: ARRAY<VARIANT>>, b: DECIMAL(2,1)>" or "OBJECT<a" in variants.schema(df.where("id < 3"), "js")


def steps(seed=4):
    rng = random.Random(seed)
    rows = []
    for e in range(7):
        life = 0
        for t in range(60):
            if rng.random() < 0.05:
                life += 1
            if rng.random() > 0.06:
                rows.append((e, t, life, rng.random() < 0.2))
    return rows


def test_harvested_windows(spark):
    df = spark.createDataFrame(steps(), "episode long, turn long, life long, root boolean").repartition(5)
    offsets = (-8, -4, -1, 0, 1, 4, 8)
    plain = lambda d: sorted(map(tuple, d.collect()))
    assert plain(harvest.windows(df, offsets)) == plain(W.offset_windows(df.where("root"), df, offsets).select("episode", "root_turn", "offset", "turn"))
    assert harvest.windows(df.limit(0), offsets).count() == 0 and harvest.windows(df, (3,)).count() == W.offset_windows(df.where("root"), df, (3,)).count()


def test_perturbed_prefixes(spark):
    rng = random.Random(5)
    moves = ["up", "down", "left"]
    rows = []
    for e in range(40):
        for t in range(30):
            legal = rng.sample(moves, rng.randrange(1, 4))
            rows.append((e, t, "up" if t < 3 else rng.choice(legal), None if rng.random() < 0.05 else legal))
    df = spark.createDataFrame(rows, "episode long, turn long, choice string, legal array<string>").repartition(4)
    got = harvest.perturbed(df, 3, 12, "s").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, harvest.perturbed(df.repartition(7), 3, 12, "s").collect()))
    by = {(e, t): (c, legal) for e, t, c, legal in rows}
    names = defaultdict(set)
    for r in got:
        choice, legal = by[r["episode"], r["turn"]]
        assert r["turn"] < 12 and r["move"] in legal and r["move"] != choice and r["prefix_len"] == r["turn"]
        names[r["prefix_len"], r["prefix_id"]].add(tuple(by[r["episode"], t][0] for t in range(r["turn"])))
    assert all(len(v) == 1 for v in names.values()) and len({next(iter(v)) for v in names.values()}) == len(names)
    open_ = Counter(e for e, t, c, legal in rows if t < 12 and set(legal or []) - {c})
    assert Counter(r["episode"] for r in got) == {e: min(3, n) for e, n in open_.items()}


def test_selection_queries_equal_the_rule(spark, data):
    t = Tables(spark, data)
    rows = [r.asDict() for r in P._cover_input(t).collect()]
    best = {}
    for r in sorted(rows, key=lambda r: (-r["priority"], key("cover", r["id"]), r["id"])):
        best.setdefault(r["digest"], r)
    unique = list(best.values())
    count, floors = Q.cover_floors(spark.createDataFrame([(r["id"], r["flags"]) for r in unique], "id string, flags map<string,boolean>"))
    order, chosen, have = sorted(unique, key=lambda r: (key("cover", r["id"]), r["id"])), [], Counter()
    while len(chosen) < count and (short := {f for f, n in floors.items() if have[f] < n}):
        pick = max((r for r in order if r["id"] not in chosen), key=lambda r: sum(1 / floors[f] for f in sorted(true(r["flags"]) & short)))
        chosen.append(pick["id"])
        have.update(true(pick["flags"]) & floors.keys())
    chosen += [r["id"] for r in order if r["id"] not in chosen][: count - len(chosen)]
    assert [r["id"] for r in QUERIES["cover_selection"](spark, data).orderBy("place").collect()] == chosen
    near = [r | {"flags": {k: v for k, v in r["flags"].items() if k == "near"}} for r in unique]
    budgets, floor = Q.mix_budgets(Q._unique(t))
    want = plain_mix(near, budgets, ("train", "development", 0.6), floor, 6, "quota")
    assert [r["id"] for r in QUERIES["mix_selection"](spark, data).orderBy("place").collect()] == want
