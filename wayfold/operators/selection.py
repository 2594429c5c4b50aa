"""Quota selection. Spark does what is relational; solvers get what they need of the candidates and no more.

A greedy selection of so many rows takes, of rows that are alike to it (one flag set, class, origin), the first in a
fixed order, except that it passes over rows of full families. So a prefix of each such group, whose length follows from
the budget and not from the data, holds all that it can take (see prefix). What it weighs flags by is the number of all rows
that it may still take, not of those in the prefix: Spark counts them by flag set and origin, and for families of the
prefix by family too, so that a taken row and a full family can be deducted (see Supply). The flow assignment sees counts per
family and role set only. More than MAX_CANDIDATES rows of any kind raise an error.
"""

from __future__ import annotations

import hashlib
import math
from collections import Counter, deque
from collections.abc import Iterable, Mapping, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from wayfold.operators.ranking import first_rows, placed, seeded
from wayfold.sources.shared import cut

MAX_CANDIDATES = 200_000


class Shortage(ValueError):
    """What could not be met; nothing easier is taken instead."""


def candidates(df: DataFrame, columns: Sequence[str]) -> list:
    rows = df.select(*columns).limit(MAX_CANDIDATES + 1).collect()
    if len(rows) > MAX_CANDIDATES:
        raise ValueError(f"more than {MAX_CANDIDATES} candidates for a solver")
    return rows


def flag_set(flags: str, names: Iterable[str] | None = None) -> Column:
    """The true flags of a map (of names only, if given), sorted and joined: rows with one flag set are alike to a solver."""
    true = F.array_sort(F.map_keys(F.map_filter(flags, lambda k, v: F.coalesce(v, F.lit(False)))))
    return F.concat_ws("\x00", true if names is None else F.filter(true, lambda f: f.isin(*names) if names else F.lit(False)))


def prefix(df: DataFrame, alike: Sequence[str], order: Sequence[Column], budget: int, family: str | None = None, cap: int = 0, flags: Iterable[str] | None = None) -> DataFrame:
    """All rows that a greedy choice of budget rows can take, if it takes alike rows in order, at most cap of a family.

    Of a family the first cap rows are enough. A row is passed over only if its family is full, and budget rows
    fill at most budget / cap families, so of every group 2 * budget rows are enough (budget without families).
    """
    named = df.withColumn("_set", flag_set("flags", flags))
    key = ["_set", *alike]
    if family is None:
        return first_rows(named, key, order, budget).drop("_set")
    return first_rows(first_rows(named, [*key, family], order, cap), key, order, 2 * budget).drop("_set")


def _true(flags: dict) -> frozenset[str]:
    return frozenset(k for k, v in (flags or {}).items() if v)


def greedy_cover(rows: Iterable[tuple[str, frozenset[str]]], count: int, floors: Mapping[str, int]) -> list[str]:
    """Ids (rows in their tie-break order): while a floor is short, the row with the largest sum of 1 / floor over short flags; then the first left."""
    left = dict(rows)
    if len(left) < count:
        raise Shortage(f"{len(left)} rows for {count}")
    place = {i: k for k, i in enumerate(left)}
    alike: dict[frozenset[str], deque[str]] = {}
    for i, flags in left.items():
        alike.setdefault(flags, deque()).append(i)
    have, chosen = dict.fromkeys(floors, 0), []
    while len(chosen) < count and (short := {f for f, n in floors.items() if have[f] < n}):
        best = max(((sum(1 / floors[f] for f in flags & short), -place[q[0]], flags) for flags, q in alike.items() if q), key=lambda x: x[:2])
        if not best[0]:
            raise Shortage(f"no rows left for {sorted(short)}")
        chosen.append(alike[best[2]].popleft())
        for f in left.pop(chosen[-1]) & have.keys():
            have[f] += 1
    if short := {f: n - have[f] for f, n in floors.items() if have[f] < n}:
        raise Shortage(f"short of {short}")
    return [*chosen, *list(left)[: count - len(chosen)]]


def one_per_digest(df: DataFrame, seed: str) -> DataFrame:
    """The row of the highest priority of each digest; ties go by the seeded order."""
    return first_rows(df, ["digest"], [F.col("priority").desc(), seeded(seed, "id"), F.col("id")])


def balanced(df: DataFrame, count: int, floors: Mapping[str, int], seed: str) -> list[str]:
    """Distinct digests (the best by priority of each), covered greedily; df: id, digest, priority, flags."""
    few = prefix(one_per_digest(df, seed), [], [seeded(seed, "id"), F.col("id")], count)
    rows = candidates(few.select("id", seeded(seed, "id").alias("k"), "flags"), ["id", "k", "flags"])
    return greedy_cover(((r["id"], _true(r["flags"])) for r in sorted(rows, key=lambda r: (r["k"], r["id"]))), count, floors)


def quotas(target: Column, share: float) -> tuple[Column, Column]:
    """round half to even of target * share, and the rest."""
    first = F.bround(target * share).cast("long")
    return first, target - first


def fill(df: DataFrame, per: Sequence[str], budgets: DataFrame, family: str, cap: int, order: Sequence[Column]) -> DataFrame:
    """Rows per (class, origin) up to the budget, at most cap of a family, in order. budgets: per, budget."""
    capped = first_rows(df, [*per, family], order, cap)
    rank = F.row_number().over(Window.partitionBy(*per).orderBy(*order))
    return capped.withColumn("_r", rank).join(budgets, list(per)).where("_r <= budget").drop("_r", "budget")


class _Taken:
    """What a selection has taken: digests, families and covered flags."""

    def __init__(self, floors: Mapping[str, int], used: Iterable[str] = ()) -> None:
        self.floors, self.digests, self.families = floors, set(used), Counter()
        self.have, self.chosen, self.per = Counter(), [], Counter()  # per: number by (class, origin)

    def free(self, r, cap: int) -> bool:
        return r["digest"] not in self.digests and self.families[r["family"]] < cap

    def take(self, r) -> None:
        self.chosen.append(r["id"])
        self.digests.add(r["digest"])
        self.families[r["family"]] += 1
        self.have.update(_true(r["flags"]))
        if "origin" in r:
            self.per[r["class"], r["origin"]] += 1

    def cover(self, rows: Sequence, supply: Supply, cap: int, open_, limit: int) -> None:
        """While a floor is short, the first free row with the largest sum of 1 / (free rows with the flag) over short flags.

        rows in order, each with _set and _kind; open_(kind): rows of that kind may be taken at present. Rows that are not free
        never are again, so a step looks at the heads of the queues of alike rows only.
        """
        queues: dict[tuple, deque] = {}
        for place, r in enumerate(rows):
            queues.setdefault((r["_kind"], _names(r["_set"])), deque()).append((place, r))
        while short := {f for f, n in self.floors.items() if self.have[f] < n}:
            weight, best = supply.weights(short, open_), None
            for (kind, flags), q in queues.items():
                if not open_(kind) or not flags & short:
                    continue
                while q and not self.free(q[0][1], cap):
                    q.popleft()
                if q:
                    best = max(best or (0, 0, None), (math.fsum(weight[f] for f in flags & short), -q[0][0], q), key=lambda x: x[:2])
            if best is None or len(self.chosen) >= limit:
                raise Shortage(f"short of { {f: self.floors[f] - self.have[f] for f in sorted(short)} }")
            row = best[2].popleft()[1]
            self.take(row)
            supply.take(row, full=self.families[row["family"]] >= cap)


class Supply:
    """Numbers of all rows that may still be taken, by kind and flag set.

    all_: (kind, flag set) -> rows of the whole table; by_family: the same for each family that may fill up, others need none.
    """

    def __init__(self, all_: Mapping[tuple, int], by_family: Mapping[object, Mapping[tuple, int]]) -> None:
        self.all = Counter(all_)
        self.by_family = {f: Counter(n) for f, n in by_family.items()}

    def weights(self, short: Iterable[str], open_) -> dict[str, float]:
        have = Counter()
        for (kind, flags), n in self.all.items():
            if open_(kind):
                have.update(dict.fromkeys(flags, n))
        return {f: 1 / max(have[f], 1) for f in short}

    def take(self, row, full: bool) -> None:
        key = (row["_kind"], _names(row["_set"]))
        self.all[key] -= 1
        if row["family"] in self.by_family:
            self.by_family[row["family"]][key] -= 1
        if full:
            self.all.subtract(self.by_family.pop(row["family"]))


def _names(joined: str) -> frozenset[str]:
    return frozenset(joined.split("\x00")) - {""}


def supply_of(df: DataFrame, few: DataFrame, cap: int) -> Supply:
    """Counts of df (_kind, _set, family); by family for those with cap rows in few, which alone can fill up."""
    alike = ["_kind", "_set"]
    all_ = candidates(df.groupBy(*alike).agg(F.count(F.lit(1)).alias("n")), [*alike, "n"])
    full = few.groupBy(F.col("family").alias("_f")).agg(F.count(F.lit(1)).alias("_c")).where(F.col("_c") >= cap)
    near = df.join(full, F.col("family").eqNullSafe(F.col("_f")), "left_semi").groupBy("family", *alike).agg(F.count(F.lit(1)).alias("n"))
    families: dict = {}
    for r in candidates(near, ["family", *alike, "n"]):
        families.setdefault(r["family"], {})[r["_kind"], _names(r["_set"])] = r["n"]
    return Supply({(r["_kind"], _names(r["_set"])): r["n"] for r in all_}, families)


_RECORD = ["id", "digest", "class", "origin", "family", "margin", "flags", "k", "_set", "_kind"]


def select_mix(df: DataFrame, budgets: Mapping[str, int], mix: tuple[str, str, float], floors: Mapping[str, int], cap: int, seed: str) -> list[str]:
    """Exact quotas of two classes, each shared by two origins, with floors of the first class; a digest once, cap of a family at most.

    budgets: the classes in order; the first must be three times the second at least. mix: the origin whose share is
    rounded half to even, the origin that gets the rest, and the share. Floors come first, scarce flags weigh most;
    then each origin is filled by margin. Nothing easier is taken instead: a shortage raises. df: id, digest (each
    once), class, origin, family, margin, flags.
    """
    (hard, n_hard), *rest = budgets.items()
    n_easy = sum(n for _, n in rest)
    if n_hard < 3 * n_easy:
        raise ValueError("the first class must be three quarters of the selection at least")
    order = [F.coalesce("margin", F.lit(0)).desc(), seeded(seed, "id"), F.col("id")]
    named = df.where(F.col("class").isin(*budgets)).withColumns({"_kind": F.col("origin"), "_set": flag_set("flags", floors)})
    few = cut(prefix(named.drop("_set"), ["class", "origin"], order, n_hard + n_easy, "family", cap, floors).withColumns({"k": seeded(seed, "id"), "_set": flag_set("flags", floors)}))
    rows = candidates(few, _RECORD)
    supply = supply_of(named.where(F.col("class") == hard), few.where(F.col("class") == hard), cap) if floors else None
    rows.sort(key=lambda r: (-(r["margin"] or 0), r["k"], r["id"]))
    state, missing = _Taken(floors), {}
    for kind, target in budgets.items():
        first = round(target * mix[2])
        share = {mix[0]: first, mix[1]: target - first}
        of_kind = [r for r in rows if r["class"] == kind]
        if kind == hard and floors:
            state.cover(of_kind, supply, cap, lambda origin, share=share: state.per[hard, origin] < share.get(origin, 0), target)
        for origin, n in share.items():
            for r in of_kind:
                if state.per[kind, origin] == n:
                    break
                if r["origin"] == origin and state.free(r, cap):
                    state.take(r)
            if state.per[kind, origin] < n:
                missing[f"{kind}/{origin}"] = n - state.per[kind, origin]
    if missing:
        raise Shortage(f"short of {missing}")
    return state.chosen


def select_targeted(df: DataFrame, windows: DataFrame, budgets: tuple[int, int], floors: Mapping[str, int], cap: int, per_root: int, seed: str) -> tuple[list[str], list[str]]:
    """Roots and windows: floors over roots, then a root of each family in turn, then a window of each root in turn.

    budgets: roots and windows; roots must be three times the windows at least, and take their share of a family's cap.
    A digest is taken once, a family cap times, a root per_root windows at most. df: id, digest (each once), family,
    flags; windows: id, digest, family, root, place (order within the root). Shortages raise.
    """
    target, n_windows = budgets
    if target < 3 * n_windows:
        raise ValueError("roots must be three quarters of the selection at least")
    root_cap = cap * target // (target + n_windows) if n_windows else cap
    order = [seeded(seed, "id"), F.col("id")]
    named = df.withColumns({"_kind": F.lit(0), "_set": flag_set("flags", floors)})
    state = _Taken(floors)
    if floors:
        # a row that covers has a flag that is short, so no more rows cover than the floors ask for
        some = named.where(F.col("_set") != "").drop("_kind", "_set")
        few = prefix(some, [], order, min(target, sum(floors.values())), "family", root_cap, floors)
        few = cut(few.withColumns({"k": seeded(seed, "id"), "_kind": F.lit(0), "_set": flag_set("flags", floors)}))
        rows = candidates(few, ["id", "digest", "family", "flags", "k", "_kind", "_set"])
        rows.sort(key=lambda r: (r["k"], r["id"]))
        state.cover(rows, supply_of(named, few, root_cap), root_cap, lambda kind: True, target)
    for r in _turns(df, state, target - len(state.chosen), root_cap, seed):
        state.take(r)
    if len(state.chosen) < target:
        raise Shortage(f"{len(state.chosen)} rows for {target}")
    roots = state.chosen[:]
    wanted = df.sparkSession.createDataFrame([(i,) for i in roots], "root string")
    found = candidates(windows.join(F.broadcast(wanted), "root").withColumn("flags", F.lit(None).cast("map<string,boolean>")), ["id", "digest", "family", "root", "place", "flags"])  # wanted: as many as the budget
    of: dict[str, list] = {}
    for w in found:
        of.setdefault(w["root"], []).append(w)
    lists = {i: deque(sorted(of.get(i, ()), key=lambda w: (w["place"], w["id"]))) for i in sorted(roots, key=lambda i: hashlib.md5(f"{seed}:{i}".encode()).hexdigest())}
    taken = Counter()

    def may(q) -> bool:
        ok = taken[q[0]["root"]] < per_root
        taken[q[0]["root"]] += ok
        return ok

    _in_turns(lists.values(), state, target + n_windows, lambda r: state.free(r, cap), may)
    return roots, state.chosen[target:]


def _turns(df: DataFrame, state: _Taken, count: int, cap: int, seed: str) -> list:
    """The next count rows, one of each family in turn, families in the order of their first rows; at most cap of a family with those taken before."""
    if count <= 0:
        return []
    spark, kind = df.sparkSession, df.schema["family"].dataType
    taken = spark.createDataFrame([(i,) for i in state.chosen], "_id string")
    had = spark.createDataFrame(list(state.families.items()), StructType([StructField("_f", kind), StructField("_n", LongType())]))
    rows = df.select("id", "digest", "family", "flags", seeded(seed, "id").alias("k"))
    first = F.min(F.struct("k", "id")).over(Window.partitionBy("family"))
    left = rows.withColumn("_first", first).join(F.broadcast(taken), F.col("id") == F.col("_id"), "left_anti")  # taken, had: as many as the budget
    left = left.withColumn("_turn", F.row_number().over(Window.partitionBy("family").orderBy("k", "id"))).join(F.broadcast(had), F.col("family").eqNullSafe(F.col("_f")), "left")
    open_ = left.where(F.col("_turn") + F.coalesce("_n", F.lit(0)) <= cap)
    return open_.orderBy("_turn", "_first").limit(count).select("id", "digest", "family", "flags").collect()


def _in_turns(queues: Iterable[deque], state: _Taken, until: int, allowed, may) -> None:
    """One row of each queue in turn until so many are chosen; rows that are not allowed are dropped, queues that may not are skipped."""
    queues = [q for q in queues if q]
    while len(state.chosen) < until:
        before = len(state.chosen)
        for q in queues:
            while q and not allowed(q[0]):
                q.popleft()
            if q and may(q):
                state.take(q.popleft())
                if len(state.chosen) == until:
                    return
        if len(state.chosen) == before:
            raise Shortage(f"{before} rows for {until}")


def root_sampler(rows: DataFrame, flags: str, order: Sequence[str], per_cohort: int, budget: int, seed: str) -> DataFrame:
    """Rows of each episode: of every cohort in order up to per_cohort evenly spaced ones that were not taken yet, then others with a flag in seeded order, budget in all.

    All windows are partitioned by episode, so one exchange serves them.
    """
    by = Window.partitionBy("episode")
    on = lambda name: F.coalesce(F.try_element_at(flags, F.lit(name)), F.lit(False))
    out = rows.withColumn("_took", F.lit(False))
    for name in order:
        out = out.withColumn("_open", on(name) & ~F.col("_took")).withColumn("_sum", F.count_if("_took").over(by))
        mine = Window.partitionBy("episode", "_open")
        out = out.withColumns({"_n": F.count(F.lit(1)).over(mine), "_i": F.row_number().over(mine.orderBy("turn")) - 1})
        out = out.withColumn("_slots", F.least(F.lit(per_cohort), F.col("_n"), F.lit(budget) - F.col("_sum")))
        spaced = F.exists(F.sequence(F.lit(0), F.lit(per_cohort - 1)), lambda j: (j < F.col("_slots")) & (F.expr("_i") == F.floor(j * F.col("_n") / F.greatest(F.col("_slots"), F.lit(1)))))
        out = out.withColumn("_took", F.col("_took") | (F.col("_open") & spaced))
    out = out.withColumn("_rest", ~F.col("_took") & (F.size(F.map_filter(flags, lambda k, v: v)) > 0)).withColumn("_sum", F.count_if("_took").over(by))
    place = F.row_number().over(Window.partitionBy("episode", "_rest").orderBy(seeded(seed, "episode", "turn"), "turn"))
    return out.withColumn("_place", place).where(F.col("_took") | (F.col("_rest") & (F.col("_place") <= budget - F.col("_sum")))).drop("_took", "_open", "_sum", "_n", "_i", "_slots", "_rest", "_place")


def cohort_queues(rows: DataFrame, flags: str, order: Sequence[str], budget: int) -> DataFrame:
    """episode, turn, place: cohorts of an episode in turn, each giving the next of its evenly spaced rows that no other gave, budget in all.

    A queue has at most budget rows, so an episode's queues are one bounded row of a batch.
    """
    named = rows.select("episode", "turn", F.explode(F.array(*[F.when(F.coalesce(F.try_element_at(flags, F.lit(c)), F.lit(False)), F.lit(i)) for i, c in enumerate(order)])).alias("queue")).where("queue IS NOT NULL")
    by = Window.partitionBy("episode", "queue")
    n, i = F.count(F.lit(1)).over(by), F.row_number().over(by.orderBy("turn")) - 1
    named = named.withColumns({"_n": n, "_i": i}).withColumn("_slots", F.least(F.col("_n"), F.lit(budget)))
    # row i is the j-th pick, j = ceil(i * slots / n), if that pick is row i
    j = F.ceil(F.col("_i") * F.col("_slots") / F.col("_n"))
    picks = named.where((j < F.col("_slots")) & (F.floor(j * F.col("_n") / F.col("_slots")) == F.col("_i")))
    lists = picks.groupBy("episode").agg(F.array_sort(F.collect_list(F.struct("queue", "turn"))).alias("q"))

    def run(it):
        for batch in it:
            out = []
            for episode, q in zip(batch.column("episode").to_pylist(), batch.column("q").to_pylist(), strict=True):
                queues: dict[int, deque] = {}
                for x in q:
                    queues.setdefault(x["queue"], deque()).append(x["turn"])
                seen: dict[int, None] = {}
                while queues and len(seen) < budget:
                    for k in list(queues):
                        while queues[k] and queues[k][0] in seen:
                            queues[k].popleft()
                        if queues[k] and len(seen) < budget:
                            seen[queues[k].popleft()] = None
                        if not queues[k]:
                            del queues[k]
                out += [(episode, turn, place) for place, turn in enumerate(seen, 1)]
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in out], pa.int64()) for c in range(3)], names=["episode", "turn", "place"])

    return lists.mapInArrow(run, "episode long, turn long, place long")


class Flow:
    """Maximum flow by blocking flows over level graphs."""

    def __init__(self) -> None:
        self.to: list[list[int]] = []  # node -> edge numbers
        self.head: list[int] = []
        self.left: list[int] = []
        self.number: dict[object, int] = {}

    def node(self, name: object) -> int:
        if name not in self.number:
            self.number[name] = len(self.to)
            self.to.append([])
        return self.number[name]

    def add(self, a: object, b: object, capacity: int) -> int:
        x, y = self.node(a), self.node(b)
        for u, v, c in ((x, y, capacity), (y, x, 0)):
            self.to[u].append(len(self.head))
            self.head.append(v)
            self.left.append(c)
        return len(self.head) - 2

    def used(self, edge: int) -> int:
        return self.left[edge ^ 1]

    def solve(self, a: object, b: object) -> int:
        s, t, total = self.node(a), self.node(b), 0
        while True:
            level = {s: 0}
            queue = deque([s])
            while queue:
                u = queue.popleft()
                for e in self.to[u]:
                    if self.left[e] and self.head[e] not in level:
                        level[self.head[e]] = level[u] + 1
                        queue.append(self.head[e])
            if t not in level:
                return total
            at = [0] * len(self.to)
            while True:  # one augmenting path of the level graph after another, without recursion
                path, u = [], s
                while u != t:
                    while at[u] < len(self.to[u]):
                        e = self.to[u][at[u]]
                        if self.left[e] and level.get(self.head[e]) == level[u] + 1:
                            break
                        at[u] += 1
                    if at[u] < len(self.to[u]):
                        path.append(self.to[u][at[u]])
                        u = self.head[path[-1]]
                    elif path:
                        u = self.head[path.pop() ^ 1]
                        at[u] += 1
                    else:
                        break
                if u != t:
                    break
                push = min(self.left[e] for e in path)
                for e in path:
                    self.left[e] -= push
                    self.left[e ^ 1] += push
                total += push


def role_flow(groups: Iterable[tuple[str, frozenset[str], int]], quota: Mapping[str, int], family_cap: int, share: float = 0.75, alike: Mapping[str, int] | None = None) -> list[tuple[str, frozenset[str], str, int]]:
    """(family, role set, role, number): how many requests of a family with one set of possible roles take each role.

    Role quotas are met exactly, a request takes one role, a family at most floor(share * cap), or so many times that
    as there are families that it stands for (alike). A shortage raises.
    """
    alike = alike or {}
    groups = sorted(((f, roles & frozenset(quota), n) for f, roles, n in groups if roles & frozenset(quota)), key=lambda g: (g[0], sorted(g[1])))
    flow, edges = Flow(), {}
    for role, n in sorted(quota.items()):
        flow.add("source", ("role", role), n)
    for family, roles, n in groups:
        flow.add(("group", family, roles), ("family", family), n)
        for role in sorted(roles):
            edges[family, roles, role] = flow.add(("role", role), ("group", family, roles), n)
    for family in sorted({g[0] for g in groups}):
        flow.add(("family", family), "sink", int(share * family_cap) * alike.get(family, 1))
    flow.node("source"), flow.node("sink")
    got = flow.solve("source", "sink")
    out = [(*key, flow.used(e)) for key, e in edges.items() if flow.used(e)]
    if got < sum(quota.values()):
        short = {role: n - sum(x[3] for x in out if x[2] == role) for role, n in quota.items()}
        raise Shortage(f"short of { {k: v for k, v in short.items() if v} }")
    return out


def assign_roles(df: DataFrame, quota: Mapping[str, int], family_cap: int, seed: str, share: float = 0.75) -> DataFrame:
    """request, family, role of df (request, family, roles: array of possible ones; a request has one family).

    Families with equal counts per role set (up to what a family may give) are alike, and the flow is solved over classes of
    them. Its requests, in the order of their sets, go to the families of a class in turn: so a family gives of each set, and
    in all, its share rounded up at most, which it has. Which requests of a family and set take a role is a seeded draw.
    """
    rows = df.select("request", "family", F.array_sort("roles").alias("roles"))
    if not (clash := rows.groupBy("request").agg(F.count_distinct("family").alias("n")).where("n > 1").limit(3)).isEmpty():
        raise ValueError(f"requests of several families: {[r['request'] for r in clash.collect()]}")
    possible = F.filter("roles", lambda r: r.isin(*quota) if quota else F.lit(False))
    rows = rows.dropDuplicates(["request"]).select("request", "family", F.concat_ws("\x00", possible).alias("_set")).where("_set <> ''")
    room = int(share * family_cap)
    per = rows.groupBy("family", "_set").agg(F.least(F.count(F.lit(1)), F.lit(room)).alias("n"))
    per = per.groupBy("family").agg(F.array_sort(F.collect_list(F.struct("_set", "n"))).alias("_sets"))
    ranked = cut(placed(per.withColumn("_class", F.to_json("_sets")), "_rank", "_class", "family"))
    classes = ranked.groupBy("_class").agg(F.first("_sets").alias("_sets"), F.count(F.lit(1)).alias("m"), F.min("_rank").alias("_from"))
    found = candidates(classes, ["_class", "_sets", "m", "_from"])
    groups = [(c["_class"], _names(g["_set"]), g["n"] * c["m"]) for c in found for g in c["_sets"]]
    of = {c["_class"]: (c["m"], c["_from"]) for c in found}
    ends, parts, starts = Counter(), [], {}
    for cls, roles, role, n in sorted(role_flow(groups, quota, family_cap, share, {c: m for c, (m, _) in of.items()}), key=lambda x: (x[0], sorted(x[1]), x[2])):
        start = starts.setdefault((cls, roles), ends[cls])
        parts.append((cls, "\x00".join(sorted(roles)), role, *of[cls], start, ends[cls], ends[cls] + n))
        ends[cls] += n
    given = df.sparkSession.createDataFrame(parts, "_class string, _set string, role string, _m long, _from long, _start long, _lo long, _hi long")
    place = F.row_number().over(Window.partitionBy("family", "_set").orderBy(seeded(seed, "request"), "request")) - 1
    met = rows.withColumn("_place", place).where(F.col("_place") < room)
    met = met.join(ranked.select(F.col("family").alias("_family"), "_class", "_rank"), F.col("family").eqNullSafe(F.col("_family"))).join(given, ["_class", "_set"])
    at = F.col("_start") + F.expr("pmod(_rank - _from - _start, _m)") + F.col("_place") * F.col("_m")
    return met.where((at >= F.col("_lo")) & (at < F.col("_hi"))).select("request", "family", "role")


def strongest_family(df: DataFrame, request: str, strength: str, family: str) -> DataFrame:
    """request and its family of the greatest strength (ties: more rows, then the smaller name)."""
    per = df.groupBy(request, family).agg(F.max(strength).alias("_s"), F.count(F.lit(1)).alias("_n"))
    return first_rows(per, [request], [F.col("_s").desc(), F.col("_n").desc(), F.col(family)]).select(request, family)


def pick_windows(windows: Iterable[tuple[str, str, str, bool]], count: int, minimum_post: int, per_root: int, family_cap: int, used: Mapping[str, int] | None = None) -> list[str]:
    """Window ids from (id, root, family, post), in order: first up to minimum_post post windows, then any, under both caps."""
    rows, roots, families, chosen, done = list(windows), {}, dict(used or {}), [], set()

    def sweep(only_post: bool, limit: int) -> None:
        for i, root, family, post in rows:
            if len(chosen) >= limit:
                return
            if i not in done and (post or not only_post) and roots.get(root, 0) < per_root and families.get(family, 0) < family_cap:
                roots[root], families[family] = roots.get(root, 0) + 1, families.get(family, 0) + 1
                done.add(i)
                chosen.append(i)

    sweep(True, minimum_post)
    if len(chosen) < minimum_post:
        raise Shortage(f"{len(chosen)} post windows for {minimum_post}")
    sweep(False, count)
    if len(chosen) < count:
        raise Shortage(f"{len(chosen)} windows for {count}")
    return chosen
