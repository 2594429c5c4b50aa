"""Scalar functions, gates, comparisons and pools on small rows."""

import pytest
from pyspark.sql import functions as F

from wayfold.functions import canon, grid, prob
from wayfold.functions import flags as G
from wayfold.operators import compare as C
from wayfold.operators import graph
from wayfold.operators import metrics as M
from wayfold.operators import pools as Q
from wayfold.operators import ranking as R


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def test_distribution_checks(spark):
    p = lambda **k: F.create_map(*[F.lit(x) for kv in k.items() for x in kv])
    keys = F.array(F.lit("left"), F.lit("right"))
    assert value(spark, prob.valid(p(left=0.8, right=0.2), keys, F.lit("left")))
    for bad, choice in ((p(left=0.8, right=0.3), "left"), (p(left=0.8, right=0.2), "right"), (p(left=1.0), "left"), (p(left=float("nan"), right=0.5), "right")):
        assert not value(spark, prob.valid(bad, keys, F.lit(choice)))
    assert value(spark, prob.margin(p(left=0.8, right=0.2), F.lit("left"))) == pytest.approx(0.6)
    assert value(spark, prob.margin(p(left=1.0), F.lit("left"))) == 1.0
    assert value(spark, prob.one_hot(keys, F.lit("right"))) == {"left": 0.0, "right": 1.0}
    assert sum(value(spark, prob.softmax(F.array(F.lit(1000.0), F.lit(1001.0))))) == pytest.approx(1)
    assert value(spark, prob.cross_entropy(p(left=1.0), F.lit("other"))) == pytest.approx(27.631, abs=1e-3)


def risks(**fatal):
    return F.create_map(*[x for k, v in fatal.items() for x in (F.lit(k), F.struct(F.lit(v).alias("life_lost")))])


def test_risk_predicates(spark):
    assert value(spark, G.mixed_risk(risks(up=True, left=False)))
    assert not value(spark, G.mixed_risk(risks(up=True, left=True)))
    assert value(spark, G.all_fatal(risks(up=True, left=True)))
    assert value(spark, G.avoidable(risks(up=True, left=False), F.lit("up")))
    hard = G.flag_map({"near": F.lit(True), "odd": F.lit(None).cast("boolean")})
    options = F.array(F.lit("up"), F.lit("left"))
    assert value(spark, G.targeted(options, risks(up=True, left=False), F.lit("left"), hard))
    assert not value(spark, G.targeted(options, risks(up=True, left=False), F.lit("up"), hard))
    assert value(spark, G.reverse(F.lit("down"), F.lit("up")))


def test_primary_and_strict(spark):
    none = G.flag_map({"late_game": F.lit(False)})
    assert value(spark, G.primary(none, ("late_game",))) is None
    with pytest.raises(Exception, match="no scenario applies"):
        value(spark, G.primary(none, ("late_game",), strict=True))
    assert value(spark, G.primary(G.flag_map({"late_game": F.lit(True), "dry_spell": F.lit(True)}), ("dry_spell", "late_game"))) == "dry_spell"


def test_expiry_needs_the_clock_to_run_out(spark):
    assert value(spark, G.power_transition(F.lit(5), F.lit(0))).expired
    assert not value(spark, G.power_transition(F.lit(5), F.lit(1))).expired


def test_checklist_keeps_mismatches_only(spark):
    pair = lambda a, b: F.struct(F.lit(a).alias("saved"), F.lit(b).alias("expected"))
    got = value(spark, G.mismatches(F.create_map(F.lit("x"), pair(1, 1), F.lit("y"), pair(1, 2))))
    assert list(got) == ["y"]


def test_grid(spark):
    assert value(spark, grid.wrapped_manhattan(F.lit(0), F.lit(0), F.lit(0), F.lit(3), 4)) == 1
    r, c = grid.destination(F.lit(1), F.lit(0), F.lit("left"), 28)
    assert (value(spark, r), value(spark, c)) == (1, 27)


def test_distances_by_blocks(spark):
    """A long path, ways back across blocks, a node without edges and one-way edges; a round for each block and not for each step."""
    edges = [(i, i + 1) for i in range(600)] + [(i + 1, i) for i in range(300)] + [(40, 450), (450, 10), (599, 320), (5, -7), (700, 3)]
    to: dict[int, list[int]] = {}
    for a, b in edges:
        to.setdefault(a, []).append(b)
    want = set()
    for s in (0, 310, 700, 900):
        found, frontier = {s: 0}, [s]
        while frontier:
            near = {b for a in frontier for b in to.get(a, ())} - found.keys()
            found.update(dict.fromkeys(near, found[frontier[0]] + 1))
            frontier = list(near)
        want |= {(s, b, d) for b, d in found.items()}
    df, src = spark.createDataFrame(edges, "src int, dst int"), spark.createDataFrame([(s,) for s in (0, 310, 700, 900, None)], "src int")
    got = [tuple(r) for r in graph.distances(df, src, small=0, block=150).collect()]
    assert len(got) == len(set(got)) and set(got) == {tuple(r) for r in graph.distances(df, src.where("src IS NOT NULL")).collect()} == want


def test_distances_with_wrap_and_both_forms(spark):
    cells = spark.createDataFrame([(r, c) for r in range(3) for c in range(4) if (r, c) != (1, 1)], "row int, column int")
    edges = graph.grid_edges(cells, 3, 4)
    src = spark.createDataFrame([(0,)], "src int")
    small = {tuple(r) for r in graph.distances(edges, src).collect()}
    assert small == {tuple(r) for r in graph.distances(edges, src, small=0).collect()}
    d = {b: n for _, b, n in small}
    assert d[3] == 1 and d[8] == 2 and len(d) == 11
    blocked = graph.distances(edges, src, blocked=spark.createDataFrame([(3,), (1,)], "node int"))
    assert {b: n for _, b, n in blocked.collect()}[7] == 2


def test_fingerprints(spark):
    assert value(spark, canon.json_fingerprint(F.lit('{"b":1,"a":null}'))) == value(spark, canon.json_fingerprint(F.lit('{"a": null, "b": 1}')))
    assert value(spark, canon.fingerprint(F.lit("a"), F.lit(None))) != value(spark, canon.fingerprint(F.lit("a"), F.lit("")))
    for path, ok in (("a/b.txt", True), ("../a", False), ("a/../b", False), ("/a", False), ("a//b", False), ("C:/a", False)):
        assert value(spark, canon.safe_path(F.lit(path))) is ok
    assert value(spark, canon.criteria(F.array(F.lit("up")))) == {"up": "Go up"}


GOOD = {"life_losses": 0, "longest_dry": 100, "loop": 1}


@pytest.mark.parametrize(("change", "failures"), [({}, []), ({"longest_dry": 129}, ["dry"]), ({"loop": 8}, ["loop"]), ({"life_losses": 5, "loop": 8}, ["lives", "loop"]), ({"loop": None}, ["loop"])])
def test_gates(spark, change, failures):
    df = spark.createDataFrame([tuple((GOOD | change).values())], "life_losses int, longest_dry int, loop int")
    gates = {"lives": F.col("life_losses") > 4, "dry": F.col("longest_dry") > 128, "loop": F.col("loop") > 7}
    row = M.gate(df, gates).first()
    assert row.failures == failures and row.approved == (not failures)


def test_paired_comparison_guards(spark):
    a = spark.createDataFrame([(1, 1, 5), (1, 2, 6)], "level int, seed int, x int")
    assert {r.x_change for r in C.paired(a, a, ["level", "seed"], ["x"]).collect()} == {0}
    with pytest.raises(ValueError, match="same keys"):
        C.paired(a, a.limit(1), ["level", "seed"], ["x"])


def test_rates_without_opportunity_are_null(spark):
    assert value(spark, M.rate(F.lit(0), F.lit(0))) is None


def test_quarantine_removes_from_both_splits(spark):
    df = spark.createDataFrame([("d", "train", "l"), ("d", "development", "l"), ("e", "train", "l"), ("f", "train", "l"), ("f", "train", "r")], "digest string, split string, label string")
    assert [r.digest for r in Q.quarantine(df, "digest", "split", "label").collect()] == ["e"]
    assert Q.overlap(df.where("split = 'train'"), df.where("split = 'development'"), ["digest"]).count() == 1
    assert Q.set_differences(df, df).count() == 0


def test_round_robin_and_draw(spark):
    df = spark.createDataFrame([("a", i) for i in range(3)] + [("b", i) for i in range(2)], "bucket string, i int")
    got = R.round_robin(df, ["bucket"], [F.col("i")]).orderBy("place").collect()
    assert [(r.bucket, r.i) for r in got] == [("a", 0), ("b", 0), ("a", 1), ("b", 1), ("a", 2)]
    assert R.draw(df, 2, "s", "bucket", "i").collect() == R.draw(df, 2, "s", "bucket", "i").collect()


def test_round_robin_over_many_ranges(spark):
    df = spark.createDataFrame([(f"b{i % 37:02d}", i) for i in range(900)], "bucket string, i int")
    got = R.round_robin(df, ["bucket"], [F.col("i")]).orderBy("place").collect()
    assert [r.place for r in got] == list(range(1, 901))
    assert [(r.i // 37, r.bucket) for r in got] == sorted((i // 37, f"b{i % 37:02d}") for i in range(900))
    assert R.round_robin(df.limit(0), ["bucket"], [F.col("i")]).count() == 0


def test_ancestors_of_a_long_chain(spark):
    chain = spark.createDataFrame([(i, i - 1 if i else None) for i in range(150)] + [(500, 7), (501, 500)], "id long, parent long")
    got = {(r.id, r.ancestor): r.depth for r in graph.ancestors(chain).collect()}
    assert got == {(i, j): i - j for i in range(150) for j in range(i)} | {(500, j): 8 - j for j in range(8)} | {(501, j): 9 - j for j in range(8)} | {(501, 500): 1}
    with pytest.raises(ValueError, match="own ancestor"):
        graph.ancestors(spark.createDataFrame([(1, 2), (2, 3), (3, 1)], "id long, parent long"))
    assert graph.ancestors(chain.limit(0)).count() == 0
