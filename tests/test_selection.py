"""Solvers: floors, quotas, caps, flow; and that shortages raise."""

import hashlib
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from wayfold.operators import selection as S


def records(spark, n=30):
    rows = [(f"r{i:02d}", f"d{i % 20}", i, {"hard": i % 3 == 0, "late": i % 7 == 0}, f"f{i % 6}", float(i), "hard" if i % 2 else "replay", "old" if i % 4 < 2 else "new") for i in range(n)]
    return spark.createDataFrame(rows, "id string, digest string, priority int, flags map<string,boolean>, family string, margin double, class string, origin string")


def test_greedy_cover_meets_floors_and_dedups(spark):
    df = records(spark)
    got = S.balanced(df, 12, {"hard": 5, "late": 2}, "s")
    chosen = df.where(F.col("id").isin(got)).collect()
    assert len(chosen) == 12 == len({r.digest for r in chosen})
    assert sum(r.flags["hard"] for r in chosen) >= 5 and sum(r.flags["late"] for r in chosen) >= 2
    assert got == S.balanced(df, 12, {"hard": 5, "late": 2}, "s")


def brute(monkeypatch):
    monkeypatch.setattr(S, "prefix", lambda df, *rest: df)


def test_prefixes_change_no_choice(spark, monkeypatch):
    rng = random.Random(3)
    rows = [(f"c{i:04d}", f"copied{i % 3}", 10_000 + i, {"a": True, "b": True}) for i in range(500)]
    rows += [(f"f{i:03d}", f"d{i}", i, {"a": i % 3 == 0, "b": i % 5 == 0, "c": i % 7 == 0}) for i in range(300)]
    df = spark.createDataFrame(rows, "id string, digest string, priority int, flags map<string,boolean>")
    ask = lambda: S.balanced(df, 60, {"a": 20, "b": 15, "c": 9}, "cover")
    mixed = [(f"r{i}", f"d{i}", rng.choice(["hard", "easy", "hard"]), rng.choice(["old", "new"]), f"f{rng.randrange(40) ** 2 // 60}", rng.randrange(50), {"a": rng.random() < 0.1, "b": rng.random() < 0.3}) for i in range(900)]
    m = spark.createDataFrame(mixed, "id string, digest string, class string, origin string, family string, margin int, flags map<string,boolean>")
    mix = lambda: S.select_mix(m, {"hard": 40, "easy": 12}, ("old", "new", 0.6), {"a": 9, "b": 20}, 4, "mix")
    windows = spark.createDataFrame([(f"w{i}{k}", f"x{i}{k % 2}", r[4], r[0], k) for i, r in enumerate(mixed) for k in range(3)], "id string, digest string, family string, root string, place int")
    target = lambda: S.select_targeted(m, windows, (36, 12), {"a": 9, "b": 14}, 4, 2, "t")
    few = ask(), mix(), target()
    brute(monkeypatch)
    assert few == (ask(), mix(), target())
    by = {r[0]: r for r in mixed}
    chosen = [by[i] for i in few[1]]
    assert Counter((r[2], r[3]) for r in chosen) == {("hard", "old"): 24, ("hard", "new"): 16, ("easy", "old"): 7, ("easy", "new"): 5}
    assert max(Counter(r[4] for r in chosen).values()) <= 4 and sum(r[6]["a"] for r in chosen if r[2] == "hard") >= 9
    roots, near = few[2]
    family = Counter(by[i][4] for i in roots)
    assert len(roots) == 36 and len(near) == 12 and max(family.values()) <= 3
    parent = {f"w{i}{k}": r[0] for i, r in enumerate(mixed) for k in range(3)}
    assert {parent[w] for w in near} <= set(roots) and max(Counter(parent[w] for w in near).values()) <= 2
    assert max((family + Counter(by[parent[w]][4] for w in near)).values()) <= 4


def test_first_class_is_three_quarters(spark):
    with pytest.raises(ValueError, match="three quarters"):
        S.select_mix(records(spark), {"hard": 5, "replay": 2}, ("old", "new", 0.6), {}, 3, "s")


def test_root_sampler_and_queues(spark):
    rng = random.Random(5)
    rows = [(e, t, {"x": rng.random() < 0.1, "y": rng.random() < 0.4, "z": rng.random() < 0.2}) for e in range(6) for t in range(40)]
    df = spark.createDataFrame(rows, "episode long, turn long, flags map<string,boolean>")
    got = {}
    for r in S.root_sampler(df, "flags", ["x", "y", "z"], 3, 10, "s").collect():
        got.setdefault(r.episode, set()).add(r.turn)
    lists = {}
    for r in S.cohort_queues(df, "flags", ["x", "y", "z"], 7).orderBy("episode", "place").collect():
        lists.setdefault(r.episode, []).append(r.turn)
    for e in range(6):
        flags = {t: f for i, t, f in rows if i == e}
        taken = []
        for name in "xyz":
            open_ = [t for t in sorted(flags) if flags[t][name] and t not in taken]
            slots = min(3, len(open_), 10 - len(taken))
            taken += [open_[j * len(open_) // slots] for j in range(slots)]
        rest = sorted((t for t in flags if t not in taken and any(flags[t].values())), key=lambda t: hashlib.md5(f"s:{e}:{t}".encode()).hexdigest())
        assert got[e] == set(taken + rest[: 10 - len(taken)])
        queues = []
        for name in "xyz":
            open_ = [t for t in sorted(flags) if flags[t][name]]
            n = min(7, len(open_))
            queues.append([open_[j * len(open_) // n] for j in range(n)])
        want = []
        while any(queues) and len(want) < 7:
            for q in queues:
                while q and q[0] in want:
                    q.pop(0)
                if q and len(want) < 7:
                    want.append(q.pop(0))
        assert lists[e] == want


def test_shortages_raise(spark):
    with pytest.raises(S.Shortage):
        S.balanced(records(spark), 12, {"late": 19}, "s")
    with pytest.raises(S.Shortage):
        S.balanced(records(spark), 21, {}, "s")
    with pytest.raises(S.Shortage):
        S.select_mix(records(spark), {"hard": 15}, ("old", "new", 0.5), {}, 1, "s")


def assigned(spark, options, quota, cap):
    rows = {}
    for request, family, role in options:
        rows.setdefault((request, family), []).append(role)
    df = spark.createDataFrame([(*k, v) for k, v in rows.items()], "request string, family string, roles array<string>")
    return {r.request: r.role for r in S.assign_roles(df, quota, cap, "s").collect()}


def test_flow_keeps_the_rare_role(spark):
    options = [("a", "f1", "rare"), ("a", "f1", "common"), ("b", "f2", "common"), ("c", "f3", "common"), ("d", "f3", "other")]
    assert assigned(spark, options, {"rare": 1, "common": 2}, 4) == {"a": "rare", "b": "common", "c": "common"}


def test_flow_limits(spark):
    with pytest.raises(S.Shortage):  # one request serves one role
        assigned(spark, [("a", "f", "x"), ("a", "f", "y")], {"x": 1, "y": 1}, 4)
    with pytest.raises(S.Shortage):  # three quarters of the family cap
        assigned(spark, [(r, "f", "x") for r in "abcd"], {"x": 4}, 4)
    with pytest.raises(ValueError, match="several families"):
        assigned(spark, [("a", "f", "x"), ("a", "g", "x")], {"x": 1}, 4)
    many = [(f"r{i}", f"f{i % 5}", role) for i in range(60) for role in (["x", "y"] if i % 3 else ["y"])]
    got = Counter(assigned(spark, many, {"x": 7, "y": 8}, 4).values())
    assert got == {"x": 7, "y": 8}


def test_flow_over_classes_of_families(spark, monkeypatch):
    """Of 300 families the solver sees only how many are alike; their caps bind, and nobody else could give more."""
    monkeypatch.setattr(S, "MAX_CANDIDATES", 20)
    rows = [(f"f{f}-{i}", f"f{f}", ["x", "y"] if i else ["x"]) for f in range(200) for i in range(1 + f % 2)] + [(f"g{f}-{i}", f"g{f}", ["y", "z"]) for f in range(100) for i in range(9)]
    df = spark.createDataFrame(rows, "request string, family string, roles array<string>")
    got = S.assign_roles(df, {"x": 250, "y": 170, "z": 180}, 4, "s").collect()
    roles = {r[0]: r[2] for r in rows}
    assert Counter(r.role for r in got) == {"x": 250, "y": 170, "z": 180} and len({r.request for r in got}) == len(got)
    assert all(r.role in roles[r.request] and r.request.startswith(f"{r.family}-") for r in got)
    assert max(Counter(r.family for r in got).values()) == 3
    with pytest.raises(S.Shortage):
        S.assign_roles(df, {"x": 250, "y": 170, "z": 181}, 4, "s")


def test_window_picks():
    rows = [("w1", "r1", "f1", False), ("w2", "r1", "f1", True), ("w3", "r1", "f1", False), ("w4", "r2", "f2", False)]
    assert S.pick_windows(rows, 3, 1, 2, 3) == ["w2", "w1", "w4"]
    with pytest.raises(S.Shortage):
        S.pick_windows(rows, 4, 1, 2, 3)


def test_fill_and_strongest_family(spark):
    budgets = spark.createDataFrame([("hard", "old", 2), ("replay", "new", 1)], "class string, origin string, budget int")
    got = S.fill(records(spark), ["class", "origin"], budgets, "family", 1, [F.col("margin").desc(), F.col("id")])
    assert got.count() == 3
    rows = spark.createDataFrame([("q", "a", 1), ("q", "b", 2), ("q", "a", 2), ("p", "c", 1)], "request string, family string, strength int")
    assert {tuple(r) for r in S.strongest_family(rows, "request", "strength", "family").collect()} == {("q", "a"), ("p", "c")}
