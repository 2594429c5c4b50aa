"""Greedy selections against the plain rule over whole tables, with groups far larger than what the solver sees."""

import hashlib
import math
import random
from collections import Counter

import pytest

from wayfold.operators import selection as S


def key(seed, i):
    return hashlib.md5(f"{seed}:{i}".encode()).hexdigest()


def true(flags):
    return {k for k, v in (flags or {}).items() if v}


def plain_cover(rows, floors, take, free, have):
    """The rule itself: every step counts all rows that may be taken and weighs their flags by it."""
    while short := {f for f, n in floors.items() if have[f] < n}:
        open_ = [r for r in rows if free(r)]
        supply = Counter(f for r in open_ for f in true(r["flags"]) & short)
        best = max(open_, key=lambda r: math.fsum(1 / supply[f] for f in true(r["flags"]) & short), default=None)
        if best is None or not true(best["flags"]) & short:
            raise S.Shortage
        take(best)


def plain_mix(rows, budgets, mix, floors, cap, seed):
    rows = sorted(rows, key=lambda r: (-(r["margin"] or 0), key(seed, r["id"]), r["id"]))
    chosen, families, per, have, used = [], Counter(), Counter(), Counter(), set()

    def take(r):
        chosen.append(r["id"])
        used.add(r["id"])
        families[r["family"]] += 1
        per[r["class"], r["origin"]] += 1
        have.update(true(r["flags"]))

    for n, (kind, target) in enumerate(budgets.items()):
        first = round(target * mix[2])
        share = {mix[0]: first, mix[1]: target - first}
        mine = [r for r in rows if r["class"] == kind]
        free = lambda r: r["id"] not in used and families[r["family"]] < cap and per[r["class"], r["origin"]] < share.get(r["origin"], 0)  # noqa: B023, E731
        if n == 0:
            plain_cover(mine, floors, take, free, have)
        for origin, count in share.items():
            for r in mine:
                if per[kind, origin] < count and r["origin"] == origin and free(r):
                    take(r)
            if per[kind, origin] < count:
                raise S.Shortage
    return chosen


def plain_targets(rows, windows, budgets, floors, cap, per_root, seed):
    target, extra = budgets
    root_cap = cap * target // (target + extra)
    rows = sorted(rows, key=lambda r: (key(seed, r["id"]), r["id"]))
    chosen, families, have, digests = [], Counter(), Counter(), set()

    def take(r):
        chosen.append(r["id"])
        digests.add(r["digest"])
        families[r["family"]] += 1
        have.update(true(r.get("flags")))

    free = lambda r, most=root_cap: r["digest"] not in digests and families[r["family"]] < most
    plain_cover(rows, floors, take, free, have)
    queues = {}
    for r in rows:
        queues.setdefault(r["family"], []).append(r)
    while len(chosen) < target:
        for q in queues.values():
            while q and not free(q[0]):
                q.pop(0)
            if q and len(chosen) < target:
                take(q.pop(0))
    roots, taken = chosen[:], Counter()
    lists = [(i, sorted((w for w in windows if w["root"] == i), key=lambda w: (w["place"], w["id"]))) for i in sorted(roots, key=lambda i: key(seed, i))]
    while len(chosen) < target + extra:
        for root, q in lists:
            while q and not free(q[0], cap):
                q.pop(0)
            if q and taken[root] < per_root and len(chosen) < target + extra:
                taken[root] += 1
                take(q.pop(0))
    return roots, chosen[target:]


COLUMNS = "id string, digest string, class string, origin string, family string, margin int, flags map<string,boolean>"


def table(spark, rows):
    return spark.createDataFrame([tuple(r[c.split()[0]] for c in COLUMNS.split(", ")) for r in rows], COLUMNS)


def record(i, kind, origin, family, margin, **flags):
    return {"id": f"r{i}", "digest": f"d{i}", "class": kind, "origin": origin, "family": family, "margin": margin, "flags": flags}


def test_supply_is_that_of_the_whole_table(spark):
    """Thirty rows have A and twelve B; of both the solver sees only a few."""
    rows = [record(i, "hard", "old", f"f{i}", 100 - i, A=i < 30, B=i >= 30) for i in range(42)] + [record(i, "easy", "old", f"f{i}", 1) for i in range(42, 55)]
    ask = ({"hard": 3, "easy": 1}, ("old", "new", 1.0), {"A": 1, "B": 1}, 1, "s")
    got = S.select_mix(table(spark, rows), *ask)
    assert got == plain_mix(rows, *ask) and got[0] == "r30"


def crowd(seed, n=1500):
    """Few rows with rare flags, crowds of alike rows, and families from one row to a third of all."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        family = "big" if rng.random() < 0.33 else f"f{int(60 * rng.random() ** 2)}"
        p = rng.choice([0.02, 0.1, 0.5])
        flags = {f: rng.random() < p for f in "abcd"}
        rows.append(record(i, rng.choice(["hard", "hard", "easy"]), rng.choice(["old", "new"]), family, rng.choice([None, *range(8)]), **flags))
    return rows


@pytest.mark.parametrize("seed", range(4))
def test_mix_equals_the_rule(spark, seed):
    rows = crowd(seed)
    rows[7]["flags"] = None
    ask = ({"hard": 21, "easy": 7}, ("old", "new", 0.6), {"a": 6, "b": 9, "c": 5}, 2 + seed, f"m{seed}")
    assert S.select_mix(table(spark, rows), *ask) == plain_mix(rows, *ask)


@pytest.mark.parametrize("seed", range(3))
def test_targets_equal_the_rule(spark, seed):
    rng = random.Random(seed)
    rows = crowd(10 + seed, 900)
    windows = [{"id": f"w{i}-{k}", "digest": f"x{rng.randrange(900)}", "family": r["family"], "root": r["id"], "place": rng.randrange(4)} for i, r in enumerate(rows) for k in range(3)]
    near = spark.createDataFrame([tuple(w.values()) for w in windows], "id string, digest string, family string, root string, place int")
    ask = ((24, 8), {"a": 5, "b": 8}, 4, 2, f"t{seed}")
    assert S.select_targeted(table(spark, rows), near, *ask) == plain_targets(rows, windows, *ask)


def test_targets_of_many_families(spark, monkeypatch):
    """Families that cannot fill up, and rows beyond the budget, do not come to the solver."""
    rows = crowd(20, 900) + [record(i, "hard", "old", f"g{i // 5}", 1, a=i % 7 == 0, c=True) for i in range(900, 1500)]
    ask = ((24, 8), {"a": 5, "b": 8}, 8, 2, "many")
    monkeypatch.setattr(S, "MAX_CANDIDATES", 100)
    assert S.select_targeted(table(spark, rows), table(spark, []).selectExpr("id", "digest", "family", "id AS root", "1 AS place"), ((24, 0)), *ask[1:]) == plain_targets(rows, [], (24, 0), *ask[1:])


def test_nothing_to_choose_from(spark):
    none = table(spark, [])
    with pytest.raises(S.Shortage):
        S.select_mix(none, {"hard": 3, "easy": 1}, ("old", "new", 0.5), {"a": 1}, 1, "s")
    assert S.select_mix(none, {"hard": 0, "easy": 0}, ("old", "new", 0.5), {}, 1, "s") == []


def test_quota_does_not_read_the_events_again(spark, data):
    """What is chosen is verified against the stored rows, not against the log once more for every measure."""
    from wayfold.plans.base import QUERIES

    assert not any("events.parquet" in f for f in QUERIES["quota_verified"](spark, data).inputFiles())
