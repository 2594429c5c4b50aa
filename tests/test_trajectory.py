"""Golden cases of the sequence operators."""

import pytest
from pyspark.sql import functions as F

from wayfold.operators import metrics as M
from wayfold.operators import trajectory as T
from wayfold.operators import windows as W

SQUARE = [(8, 1), (8, 2), (9, 2), (9, 1)]
SCHEMA = "episode string, turn long, pos struct<r:int,c:int>, lost boolean, progress boolean, frames long"


def walk(spark, n, progress=False, life_every=0):
    rows = [("e", i, SQUARE[i % 4], bool(life_every) and i % life_every == life_every - 1, progress, 8) for i in range(n)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.mark.parametrize(("n", "loops", "streak"), [(12, 5, 5), (15, 8, 8), (7, 0, 0)])
def test_square_has_period_four(spark, n, loops, streak):
    rows = M.analysed(walk(spark, n))
    s = M.episode_summary(rows).first()
    assert (s.loop_decisions, s.longest_loop_streak, s.longest_dry_frames) == (loops, streak, 8 * n)
    assert {(r.period, r.rows) for r in M.loop_periods(rows).collect()} == ({(4, loops)} if loops else set())


@pytest.mark.parametrize("change", [{"progress": True}, {"life_every": 4}])
def test_progress_or_a_new_life_ends_loops(spark, change):
    assert M.episode_summary(M.analysed(walk(spark, 12, **change))).first().loop_decisions == 0


def test_standing_still_is_no_cycle(spark):
    rows = spark.createDataFrame([("e", i, (1, 1), False, False, 1) for i in range(10)], SCHEMA)
    assert M.analysed(rows).where("period IS NOT NULL").count() == 0


def test_empty_trajectories(spark):
    assert M.episode_summary(M.analysed(spark.createDataFrame([], SCHEMA))).count() == 0


def test_per_life_maps(spark):
    rows = T.with_lives(walk(spark, 8, life_every=4))
    m = M.as_map(M.per_life(rows), ["episode"], "life", "decisions", "life_lost").first().by_life
    assert {k: (v.decisions, v.life_lost) for k, v in m.items()} == {"0": (4, True), "1": (4, True)}


def test_runs_windows_and_gaps(spark):
    """Life changes at 10, progress at 9, root at 8: all windows stay below 10; without row 7 none lies before 8."""
    rows = [("e", i, int(i >= 10), i == 9) for i in range(20)]
    df = spark.createDataFrame(rows, "episode string, turn long, life long, progress boolean")
    roots = df.where("turn = 8")
    all_ = W.offset_windows(roots, df, (-8, -4, -1, 1, 4, 8))
    assert sorted(r.turn for r in all_.collect()) == [0, 4, 7, 9]
    gap = W.offset_windows(roots, df.where("turn <> 7"), (-8, -4, -1, 1, 4, 8))
    assert sorted(r.turn for r in gap.collect()) == [9]


def test_lookback_roots_stay_in_their_life(spark):
    df = spark.createDataFrame([("e", i, int(i >= 20), i == 30) for i in range(40)], "episode string, turn long, life long, fatal boolean")
    got = {r.turn for r in W.lookback_roots(df, F.col("fatal"), (1, 4, 8, 16)).collect()}
    assert got == {30, 29, 26, 22}


def test_accumulators_with_reset(spark):
    cum, rows = 0, []
    for step in range(1, 13):
        cum = step if step == 11 else cum + step
        rows.append(("e", step, float(cum)))
    out = T.differences(spark.createDataFrame(rows, "episode string, step int, ce double"), "step", ["ce"], 10)
    assert [r.ce_step for r in out.orderBy("step").collect()] == [float(i) for i in range(1, 13)]


def test_trace_audit(spark):
    rows = [("e", i, f"s{i}", f"s{i + 1}") for i in range(8)]
    df = spark.createDataFrame(rows, "episode string, turn long, state string, next_state string")
    assert T.broken_chain(df, "state", "next_state").count() == 0
    altered = df.withColumn("state", F.when(F.col("turn") == 5, "x").otherwise(F.col("state")))
    assert [r.turn for r in T.broken_chain(altered, "state", "next_state").collect()] == [5]


def test_gap_must_grow_for_the_same_pursuers(spark):
    m = lambda d: F.create_map(*[F.lit(x) for kv in d.items() for x in kv])
    row = spark.range(1)
    check = lambda a, b: row.select(T.gap_grows(m(a), m(b)).alias("g")).first().g
    assert check({"a": 3, "b": 2}, {"a": 4, "b": 3, "c": 1})
    assert not check({"a": 3, "b": 2}, {"a": 4})
    assert not check({"a": 3}, {"a": 3})


def test_prefix_chain_has_every_turn(spark, data):
    import hashlib

    from wayfold.registry import QUERIES

    got = {(r.episode, r.turn): (r.prefix_length, r.prefix_sha256) for r in QUERIES["prefix_chain"](spark, data).collect()}
    events = spark.read.parquet(f"{data}/events.parquet").select("user_id", "ts", "event_id", "event_type").collect()
    want, before = {}, {}
    for r in sorted(events, key=lambda r: (r.user_id, r.ts, r.event_id)):
        past = before.setdefault(r.user_id, [])
        want[r.user_id, len(past)] = (len(past), hashlib.sha256("|".join(past).encode()).hexdigest())
        past.append(r.event_type)
    assert got == want
