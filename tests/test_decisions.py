"""Flag sets, roles, branch evidence and measures on decisions written out by hand."""

import pytest
from conftest import rows_of
from pyspark.sql import functions as F

from wayfold.functions import flags as G
from wayfold.operators import decisions as D
from wayfold.operators import metrics as M
from wayfold.operators import trajectory as T
from wayfold.plans import base
from wayfold.schema import struct

BASE = {
    "episode": 1, "turn": 0, "level": 1, "seed": 1, "life": 0, "lives": 3, "heading": "up", "choice": "up", "gold": "up", "legal": ["up", "down", "left"],
    "risks": {"up": (False, 1, 10), "down": (False, 0, 12), "left": (False, 0, 8)}, "ghosts": [("a", True, False, 9), ("b", True, False, 20)],
    "frightened": False, "power": 0, "power_after": 0, "dry": 0, "visits": 0, "near_power": False, "pellets_before": 100, "pellets_after": 99,
    "row": 1, "column": 0, "next_row": 1, "next_column": 27, "action_frames": 10, "outcome": None, "score_after": 10, "http_ms": 1.0,
    "normal_pellets": 1, "power_pellets": 0, "ghosts_eaten": 0, "fruit_eaten": 0, "survival": {"up": 2, "down": 2, "left": 1}, "worth": {"up": 3, "down": 5, "left": 9},
    "probabilities": {"up": 0.5, "down": 0.3, "left": 0.2}, "origin": "expert", "learner_choice": None,
}


def rows(spark, *changes):
    return spark.createDataFrame([tuple((BASE | c).values()) for c in changes], struct(D.LOG))


def true(spark, flags, **change):
    return set(rows(spark, change).select(G.true_names(flags).alias("x")).first().x)


def test_columns_are_those_of_the_log(spark):
    assert list(BASE) == struct(D.LOG).names


def test_strata_and_versions(spark):
    assert true(spark, D.strata()) == {"junction", "search_survival_critical"}
    assert "post_respawn" in true(spark, D.strata(False), lives=2) and "post_respawn" not in true(spark, D.strata(), lives=2)
    near = [("a", True, False, 1), ("b", True, True, 0), ("c", False, False, 0)]
    assert {"danger_within_3_tiles", "danger_within_1_tile"} <= true(spark, D.strata(), ghosts=near)
    assert "danger_within_1_tile" not in true(spark, D.strata(), ghosts=near[1:])
    assert "revisited_over_4_times" in true(spark, D.strata(), visits=5) and "revisited_over_4_times" not in true(spark, D.strata(), visits=4)


@pytest.mark.parametrize(("after", "actual"), [(0, True), (1, False)])
def test_potential_and_actual_expiry(spark, after, actual):
    got = true(spark, D.offline_cohorts(), frightened=True, power=12, power_after=after, ghosts=[("a", True, True, 3)])
    assert "potential_expiry_during_action_near_ghost" in got
    assert ("actual_power_expiry_during_teacher_action_near_ghost" in got) is actual
    far = true(spark, D.offline_cohorts(), frightened=True, power=13, power_after=after, ghosts=[("a", True, True, 3)])
    assert "potential_expiry_during_action_near_ghost" not in far and "power_expiry" in far


def test_targeted_needs_a_safe_choice(spark):
    risks = {"up": (False, 1, 10), "down": (True, 0, 10)}
    ask = lambda **c: rows(spark, c).select(D.targeted(D.offline_cohorts()).alias("x")).first().x
    assert ask(risks=risks) and not ask(risks=risks, choice="down") and not ask(risks=risks, legal=["up"]) and not ask()


def test_pre_trap_looks_back_within_a_life(spark):
    bad = {"risks": {"up": (True, 0, 1), "down": (False, 0, 1)}}
    df = rows(spark, *[{"turn": i, "life": int(i > 2)} | (bad if i == 10 else {}) for i in range(11)])
    got = {r.turn: set(r.x) for r in D.with_candidate_flags(df).select("turn", G.true_names(F.col("flags")).alias("x")).collect()}
    assert {i for i, x in got.items() if "pre_trap" in x} == {9, 6} and "avoidable_fatal" in got[10]


def behaved(spark, *changes):
    return {r.turn: (set(r.x), r.evidence) for r in D.with_behaviour(T.with_runs(rows(spark, *changes))).select("turn", G.true_names(F.col("behaviour")).alias("x"), "evidence").collect()}


def test_roles(spark):
    flee = {"choice": "down", "heading": "left", "ghosts": [("a", True, False, 4)], "pellets_after": 100}
    fled = {"turn": 1, "ghosts": [("a", True, False, 5)], "pellets_after": 100}
    got = behaved(spark, flee, fled, {"turn": 2})
    assert got[0][0] == {"broad_exposure", "retreat_to_food"} and got[0][1].escape_kind == "same_ghost_geometric" and got[0][1].first_food_offset == 2
    assert not behaved(spark, flee, fled | {"ghosts": [("b", True, False, 5)]})[0][1].escape  # another ghost's gap proves nothing
    assert "retreat_to_food" not in behaved(spark, flee, fled, {"turn": 2, "life": 1})[0][0]
    back = {"choice": "down", "risks": {"up": (True, 0, 1), "down": (False, 0, 1)}}
    assert behaved(spark, back)[0][1].escape_kind == "critical_safe_reverse"
    assert "productive_routing" in behaved(spark, {"turn": 12, "visits": 2})[12][0] and "productive_routing" not in behaved(spark, {"turn": 11, "visits": 2})[11][0]
    assert "cleanup" in behaved(spark, {"pellets_before": 30, "pellets_after": 29})[0][0]


PAIR = {
    "p_decisions": 50, "p_frames": 500, "p_life_losses": 0, "p_level_cleared": True, "p_longest_dry": 5, "p_first_food": 3, "p_lost_before_food": False,
    "n_decisions": 50, "n_frames": 500, "n_life_losses": 0, "n_level_cleared": True, "n_longest_dry": 5, "n_power": 0, "n_power_after": 0, "n_scared_near": 999, "n_danger_near": 999,
}


def paired(spark, change, pair):
    return rows(spark, change).withColumns({k: F.lit(v) for k, v in (PAIR | pair).items()})


@pytest.mark.parametrize(
    ("change", "pair", "kind"),
    [
        ({"risks": {"up": (False, 0, 1), "down": (True, 0, 1)}}, {"n_life_losses": 1}, "immediate_fatal_with_safe_teacher"),
        ({}, {"n_life_losses": 1, "n_level_cleared": False}, "extra_life_loss_with_same_continuation_controller"),
        ({}, {"n_level_cleared": False, "n_decisions": 90, "n_frames": 900}, "incomplete_forced_first_branch_with_same_controller"),
        ({}, {"n_decisions": 58, "n_frames": 560}, "verified_route_cost"),
        ({}, {"n_decisions": 58, "n_frames": 559}, None),
        ({}, {"n_decisions": 58, "n_frames": 560, "p_life_losses": 1}, None),  # slower, but it saved a life
        ({}, {"n_longest_dry": 21, "n_frames": 560}, "verified_extended_pellet_stall"),
        ({}, {"n_longest_dry": 20, "n_frames": 560}, None),
    ],
)
def test_negative_evidence(spark, change, pair, kind):
    assert paired(spark, change, pair).select(D.negative_evidence(F.col("gold"), F.lit("down")).alias("x")).first().x == kind


def test_branch_flags_are_independent(spark):
    ask = lambda change, pair: set(paired(spark, change, pair).select(G.true_names(D.branch_flags(F.col("gold"), F.lit("left"))).alias("x")).first().x)
    assert ask({}, {}) == set()
    assert ask({}, {"n_level_cleared": False}) == {"anticipatory_harm"}
    fatal = {"risks": {"up": (False, 0, 1), "left": (True, 0, 1)}, "frightened": True}
    clock = {"n_power": 4, "n_scared_near": 2}
    assert ask(fatal, clock) == {"actual_expiry_fatal_alternative"}
    assert ask(fatal, clock | {"n_power_after": 1}) == ask(fatal, clock | {"n_danger_near": 3}) == set()
    dry = {"dry": 24, "gold": "down"}
    assert ask(dry, {"n_decisions": 58, "n_frames": 560}) == {"productive_retreat_to_food"}
    assert ask(dry, {"n_decisions": 58, "n_frames": 560, "p_first_food": 0}) == ask(dry, {"n_decisions": 57, "n_frames": 560}) == set()


def test_scenario_order_and_recovery(spark):
    name = lambda *on: rows(spark, {}).select(D.primary_scenario(G.flag_map({k: F.lit(True) for k in on} or {"x": F.lit(True)})).alias("x")).first().x
    assert name("food_dry", "ghost_intercept") == "nearby_dangerous_ghost" and name("post_respawn") is None
    assert name("power_expiry", "potential_expiry_during_action_near_ghost") == "potential_power_expiry_near_ghost"
    ask = lambda **c: true(spark, D.recovery_flags(F.lit(True), F.lit("up"), F.lit("down")), **c)
    assert ask() == {"productive_junction"} and ask(pellets_before=30) == {"sparse_cleanup"}
    assert ask(risks={"up": (False, 0, 1), "down": (True, 0, 1)}) == {"immediate_evasion"}


def test_summary(spark):
    # five steps along the wrap, one death, one step after it
    steps = [{"turn": i, "column": i % 2, "next_column": (i + 1) % 2 if i < 4 else 5, "pellets_after": 100, "normal_pellets": 0} for i in range(5)]
    died = {"turn": 5, "outcome": "life_lost", "risks": {"up": (True, 0, 1), "down": (False, 2, 1)}, "next_column": 0, "pellets_after": 100, "normal_pellets": 0}
    df = rows(spark, *steps, died, {"turn": 6, "life": 1})
    df = df.withColumns({"lost": F.col("outcome") == "life_lost", "progress": D.collected() > 0, "frames": F.col("action_frames"), "pos": F.struct("row", "column")})
    df = T.with_streaks(T.with_cycles(T.with_dry_spells(df)), F.col("period").isNotNull()).withColumnRenamed("dry", "dry_now").withColumn("dry", F.lit(0))
    r = D.summary(df, F.lit("trace_end")).first()
    assert (r.decisions, r.life_losses, r.pellets_collected, r.post_respawn_pellets, r.violations) == (7, 1, 1, 1, 0)
    assert (r.multi_tile_actions, r.stationary_actions, r.nonterminal_stationary_actions) == (1, 1, 0)
    assert (r.avoidable_immediate_deaths, r.avoidable_risk_decisions, r.unsafe_immediate_choice_rate) == (1, 1, 1.0)
    assert r.longest_no_pellet_decisions == 6 and r.loop_periods == {2: 2} and r.censored and not r.level_cleared
    assert {k: tuple(v) for k, v in r.per_life.items()} == {"0": (6, 0, True), "1": (1, 1, False)}
    assert (r.straight_available, r.straight_chosen, r.safe_immediate_pellet_skips_at_junction) == (7, 7, 6)


EPISODE = {"level": 1, "seed": 1, "longest_loop_streak_decisions": 7, "longest_no_pellet_decisions": 128, "nonterminal_multi_tile_actions": 0, "nonterminal_stationary_actions": 0, "avoidable_immediate_deaths": 0, "level_cleared": True, "pellets_remaining": 0, "life_losses": 0}
KINDS = "level long, seed long, longest_loop_streak_decisions long, longest_no_pellet_decisions long, nonterminal_multi_tile_actions long, nonterminal_stationary_actions long, avoidable_immediate_deaths long, level_cleared boolean, pellets_remaining long, life_losses long"


def gated(spark, *changes):
    return M.gate(spark.createDataFrame([tuple((EPISODE | c).values()) for c in changes], KINDS), D.quality_gates())


def test_gates_and_qualification(spark):
    bad = {"longest_loop_streak_decisions": 8, "longest_no_pellet_decisions": 129, "nonterminal_multi_tile_actions": 1, "nonterminal_stationary_actions": 1, "avoidable_immediate_deaths": 1, "pellets_remaining": 3}
    first, second = gated(spark, {}, bad).collect()
    assert first.approved and second.failures == [*D.GATE_NAMES, "maze incomplete"]
    games = [{"level": 1 + i % 2, "seed": i} for i in range(20)]
    expected = spark.createDataFrame([(g["level"], g["seed"]) for g in games], "level long, seed long")
    ask = lambda games, phase="qualification", errors=0: D.qualification(gated(spark, *games), expected, phase, errors).first().failures
    assert ask(games) == []
    assert ask(games, "development", 1) == ["native simulation errors", "not a qualification run"]
    assert ask(games[:-1]) == ["suite incomplete or duplicated", "too few games"]
    assert ask([*games, games[0]]) == ["suite incomplete or duplicated"]
    assert ask([games[0] | {"level_cleared": False}, *games[1:]]) == ["clear rate", "episode gates"]
    assert ask([games[0] | {"life_losses": 5}, *games[1:]]) == ["too many lives lost"]


def test_search_evaluation(spark):
    got = [rows(spark, {"choice": c}).select(*[v.alias(k) for k, v in D.search_evaluation().items()]).first() for c in ("up", "down", "left")]
    assert [tuple(r) for r in got] == [(False, False, 2), (True, False, 0), (False, True, None)]


@pytest.mark.parametrize(
    ("args", "want"),
    [((100, 2, 4, 4, 2, 8), (4, None)), ((100, 2, 4, 4, 3, 8), (None, "effective batch differs")), ((100, 2, 4, 4, 2, 7), (None, "no optimizer boundary")), ((100, 2, 4, 8, 1, 12), (3, None)), ((100, 3, 4, 12, 1, 34), (9, None)), ((101, 6, 1, 4, 2, 1), (None, "effective batch differs")), ((100, 6, 2, 4, 3, 2), (3, None)), ((100, 6, 1, 2, 3, 1), (3, None)), ((100, 2, 3, 6, 1, 51), (None, "no optimizer boundary")), ((100, 3, 4, 4, 3, 5), (None, "no optimizer boundary")), ((100, 2, 2, 4, 1, 50), (25, None)), ((100, 0, 4, 4, 2, 8), (None, "not positive"))],
)
def test_resume_position(spark, args, want):
    assert tuple(spark.range(1).select(D.resume_position(*map(F.lit, args)).alias("x")).first().x) == want


def test_events_are_dealt_out_by_their_number(spark, data):
    """So many tasks as the rows ask for, whatever the session joins up, and the windows by the key keep them."""
    events = spark.read.parquet(f"{data}/events.parquet")
    rows = base.dealt(events, "user_id", 60)
    parts = rows.rdd.getNumPartitions()
    assert parts >= events.count() / 60 and base.dealt(events, "user_id").rdd.getNumPartitions() == events.rdd.getNumPartitions()
    numbered = T.numbered(rows, "user_id", "ts", "event_id")
    assert numbered.rdd.getNumPartitions() == parts and numbered._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0].count("Exchange") == 1
    assert rows_of(numbered) == rows_of(T.numbered(events, "user_id", "ts", "event_id"))
