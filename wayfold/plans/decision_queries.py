"""Flag sets, roles, branch evidence, episode measures and reports over the decision log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayfold.functions import canon
from wayfold.functions import flags as G
from wayfold.functions import prob as P
from wayfold.operators import datasets as DS
from wayfold.operators import decisions as D
from wayfold.operators import metrics as M
from wayfold.operators import selection as S
from wayfold.plans.base import Tables, query
from wayfold.plans.decision_log import DECISIONS, MOVES, log


def names(flags: Column) -> Column:
    return F.array_join(G.true_names(flags), ",")


def listed(flags: dict[str, str]) -> str:
    """SQL: the names of the true flags, sorted and joined."""
    return "array_to_string(list_filter([" + ", ".join(f"CASE WHEN {e} THEN '{k}' END" for k, e in sorted(flags.items())) + "], lambda n: n IS NOT NULL), ',')"


_MIXED = "some_fatal AND some_safe"
_STRATA = {
    "junction": "n_legal >= 3",
    "danger_within_3_tiles": "danger <= 3",
    "danger_within_1_tile": "danger <= 1",
    "frightened": "frightened",
    "power_pellet_adjacent": "near_power",
    "late_maze_30_or_fewer": "pellets_before <= 30",
    "revisited_over_4_times": "visits > 4",
}
_SURVIVAL = "len(list_distinct(list_filter([" + ", ".join(f"CASE WHEN legal_{m} THEN surv_{m} END" for m in MOVES) + "], lambda n: n IS NOT NULL))) > 1"
_COHORTS = {
    "ghost_intercept": "danger <= 6",
    "power_expiry": "frightened AND power BETWEEN 1 AND 120",
    "food_dry": "dry >= 24",
    "sparse_food": "pellets_before <= 30",
    "post_respawn": "life > 0",
    "immediate_critical": _MIXED,
}
_POTENTIAL = "frightened AND any_near <= 3 AND power BETWEEN 1 AND longest_frames"
_V4 = _COHORTS | {"expiry_during_action_with_near_ghost": _POTENTIAL, "food_junction": "n_legal >= 3"}
_OFFLINE = _COHORTS | {"potential_expiry_during_action_near_ghost": _POTENTIAL, "actual_power_expiry_during_teacher_action_near_ghost": "frightened AND any_near <= 3 AND power > 0 AND power_after = 0"}


@query("decision_strata", f"WITH {DECISIONS} SELECT episode, turn, {listed(_STRATA | {'post_respawn': 'life > 0', 'search_survival_critical': _SURVIVAL})} AS versioned, {listed(_STRATA | {'post_respawn': 'lives < 3', 'search_survival_critical': _SURVIVAL})} AS first_version FROM dl")
def decision_strata(t: Tables) -> DataFrame:
    return log(t).select("episode", "turn", names(D.strata()).alias("versioned"), names(D.strata(False)).alias("first_version"))


@query("decision_cohorts", f"WITH {DECISIONS} SELECT episode, turn, {listed(_V4)} AS cohorts, {listed(_OFFLINE)} AS offline, n_legal >= 2 AND NOT choice_fatal AND ({_MIXED} OR danger <= 6 OR (frightened AND power BETWEEN 1 AND 120) OR dry >= 24 OR pellets_before <= 30) AS targeted FROM dl")
def decision_cohorts(t: Tables) -> DataFrame:
    rows = log(t).withColumn("offline", D.offline_cohorts())
    return rows.select("episode", "turn", names(D.cohorts()).alias("cohorts"), names(F.col("offline")).alias("offline"), D.targeted(F.col("offline")).alias("targeted"))


_TRAPS = " OR ".join(f"coalesce(lead(bad, {k}) OVER w AND lead(life, {k}) OVER w = life, false)" for k in (1, 4, 8, 16))
_CANDIDATE = {"avoidable_fatal": "bad", "risk_opportunity": _MIXED, "stalled": "dry >= 32", "power_expiry": "frightened AND power <= 60", "post_respawn": "life > 0", "late_maze": "pellets_before <= 30", "pre_trap": "trap"}


@query("candidate_flags", f"WITH {DECISIONS}, b AS (SELECT *, {_MIXED} AND choice_fatal AS bad FROM dl), c AS (SELECT *, {_TRAPS} AS trap FROM b WINDOW w AS (PARTITION BY episode ORDER BY turn)) SELECT episode, turn, {listed(_CANDIDATE)} AS flags FROM c")
def candidate_flags(t: Tables) -> DataFrame:
    return D.with_candidate_flags(log(t)).select("episode", "turn", names(F.col("flags")).alias("flags"))


_COVERAGE = _STRATA | {
    "post_respawn": "life > 0",
    "learner_visited": "origin = 'learner_visited'",
    "learner_disagreement": "learner_choice IS NOT NULL AND learner_choice <> gold",
    "immediate_survival_critical": _MIXED,
    "critical_reverse": f"{_MIXED} AND gold = backwards",
    "stalled_current": "dry >= 32",
    "power_expiry": "frightened AND power <= 60",
    **{f"level_{k}": f"level = {k}" for k in (1, 2, 3)},
}


@query("coverage_flags", f"WITH {DECISIONS} SELECT episode, turn, {listed(_COVERAGE)} AS flags FROM dl")
def coverage_flags(t: Tables) -> DataFrame:
    return log(t).select("episode", "turn", names(D.coverage_flags((1, 2, 3))).alias("flags"))


_DANGEROUS = "out_{g} AND NOT scared_{g}"
_NEXT = ", ".join(f"lead(CASE WHEN out_{g} AND NOT scared_{g} THEN d_{g} END) OVER w AS next_{g}" for g in "ab")
_GREW = " AND ".join(f"(NOT (out_{g} AND NOT scared_{g} AND d_{g} = danger) OR coalesce(next_{g} > d_{g}, false))" for g in "ab")
_OTHER_EMPTY = "(" + " OR ".join(f"(legal_{m} AND choice <> '{m}' AND NOT fatal_{m} AND food_{m} = 0)" for m in MOVES) + ")"
_CONTEXT = "(turn >= 12 AND (dry >= 8 OR visits >= 2 OR pellets_before <= 122))"
_MOVE_LIST = lambda cond: "array_to_string(list_filter([" + ", ".join(f"CASE WHEN legal_{m} AND {cond.format(m=m)} THEN '{m}' END" for m in MOVES) + "], lambda n: n IS NOT NULL), ',')"
_ROLES = {
    "immediate_evasion": "NOT choice_fatal AND some_fatal",
    "retreat_to_food": "escape AND food_in IS NOT NULL",
    "productive_routing": f"advantage AND n_legal >= 3 AND {_CONTEXT}",
    "cleanup": "advantage AND pellets_before <= 30",
    "broad_exposure": "danger <= 6 OR (frightened AND power BETWEEN 1 AND 120)",
}
_BEHAVED = f"""{DECISIONS},
r0 AS (SELECT *, {_NEXT}, lead(turn) OVER w IS NOT NULL AS has_next, min(CASE WHEN got > 0 THEN turn END) OVER (PARTITION BY episode, life ORDER BY turn ROWS BETWEEN 1 FOLLOWING AND 24 FOLLOWING) - turn AS food_in
       FROM dl WINDOW w AS (PARTITION BY episode, life ORDER BY turn)),
r1 AS (SELECT *, CASE WHEN has_next THEN least(coalesce(next_a, 999), coalesce(next_b, 999)) END AS danger_next, NOT choice_fatal AND some_fatal AND choice = backwards AS back,
       NOT choice_fatal AND choice_food > 0 AND {_OTHER_EMPTY} AS advantage FROM r0),
r2 AS (SELECT *, NOT choice_fatal AND choice <> heading AND (back OR (danger <= 6 AND coalesce(danger_next > danger, false) AND {_GREW})) AS escape FROM r1)"""


@query(
    "behaviour_evidence",
    f"""WITH {_BEHAVED} SELECT episode, turn, {listed(_ROLES)} AS roles, {_MOVE_LIST('fatal_{m}')} AS fatal_moves, {_MOVE_LIST("choice <> '{m}' AND NOT fatal_{m} AND food_{m} = 0")} AS surviving_without_food,
    choice_food AS pellets, food_in AS first_food_offset, {_CONTEXT} AS routing_context, escape, CASE WHEN escape THEN CASE WHEN back THEN 'critical_safe_reverse' ELSE 'same_ghost_geometric' END END AS escape_kind,
    danger AS danger_before, danger_next AS danger_after FROM r2""",
)
def behaviour_evidence(t: Tables) -> DataFrame:
    e = lambda c: F.col(f"evidence.{c}")
    rows = D.with_behaviour(log(t))
    moves = [F.array_join(e(c), ",").alias(c) for c in ("fatal_moves", "surviving_without_food")]
    plain = [e(c).alias(c) for c in ("pellets", "first_food_offset", "routing_context", "escape", "escape_kind", "danger_before", "danger_after")]
    return rows.select("episode", "turn", names(F.col("behaviour")).alias("roles"), *moves, *plain)


_PROOF = {
    "immediate_critical": _MIXED,
    "anticipatory_harm": "danger <= 3 AND NOT some_fatal",
    "actual_expiry_evasion": "power > 0 AND power_after = 0",
    "retreat_to_food": "visits = 3",
    "productive_junction": "got > 0",
    "sparse_cleanup": "pellets_before <= 10",
}
_PROVEN = {
    "immediate_evasion": f"({_PROOF['immediate_critical']}) OR ({_PROOF['actual_expiry_evasion']})",
    "anticipatory_escape": _PROOF["anticipatory_harm"],
    "actual_expiry_evasion": _PROOF["actual_expiry_evasion"],
    "retreat_to_food": _PROOF["retreat_to_food"],
    "productive_routing": f"got > 0 AND n_legal >= 3 AND {_CONTEXT}",
    "cleanup": _PROOF["sparse_cleanup"],
}


@query("proven_roles", f"WITH {DECISIONS} SELECT episode, turn, {listed(_PROVEN)} AS roles FROM dl")
def proven_roles(t: Tables) -> DataFrame:
    proof = G.flag_map({
        "immediate_critical": D.mixed(),
        "anticipatory_harm": (D.danger() <= 3) & ~D.some_fatal(),
        "actual_expiry_evasion": (F.col("power") > 0) & (F.col("power_after") == 0),
        "retreat_to_food": F.col("visits") == 3,
        "productive_junction": D.collected() > 0,
        "sparse_cleanup": F.col("pellets_before") <= 10,
    })
    return log(t).select("episode", "turn", names(D.proven_roles(proof)).alias("roles"))


_STATUS = "CASE WHEN max(pellets_after) FILTER (last) = 0 THEN 'level_cleared' WHEN count(*) >= 70 THEN 'decision_cap' WHEN bool_or(lost AND last) THEN 'life_lost' ELSE 'trace_end' END"
_AVOIDABLE = "some_fatal AND some_safe"
_SUMMARY = f"""lt AS (SELECT *, turn = max(turn) OVER (PARTITION BY episode) AS last, abs(row_ - next_row) + least(abs(column_ - next_column), 28 - abs(column_ - next_column)) AS moved FROM dl),
em AS (SELECT episode, any_value(level) AS level, any_value(seed) AS seed, count(*) AS decisions, max(score_after) FILTER (last) AS score, max(pellets_after) FILTER (last) AS pellets_remaining,
  sum(action_frames)::BIGINT AS simulation_frames, avg(http_ms) AS mean_http_ms, sum(got)::BIGINT AS pellets_collected, count(*) FILTER (lost) AS life_losses,
  count(*) FILTER (some_fatal) AS immediate_risk_decisions, count(*) FILTER ({_AVOIDABLE}) AS avoidable_risk_decisions, count(*) FILTER (NOT some_safe) AS all_immediate_actions_fatal,
  count(*) FILTER (choice_fatal) AS unsafe_immediate_choices, count(*) FILTER (lost AND some_safe) AS avoidable_immediate_deaths,
  count(*) FILTER (heading_legal) AS straight_available, count(*) FILTER (heading_legal AND choice = heading) AS straight_chosen,
  count(*) FILTER (heading_legal AND n_legal >= 3) AS junction_straight_available, count(*) FILTER (heading_legal AND n_legal >= 3 AND choice = heading) AS junction_straight_chosen,
  count(*) FILTER (n_legal >= 3 AND got = 0 AND some_safe_food) AS safe_immediate_pellet_skips_at_junction,
  count(*) FILTER (moved = 0) AS stationary_actions, count(*) FILTER (moved > 1) AS multi_tile_actions,
  count(*) FILTER (moved = 0 AND outcome IS NULL) AS nonterminal_stationary_actions, count(*) FILTER (moved > 1 AND outcome IS NULL) AS nonterminal_multi_tile_actions,
  sum(got)::BIGINT AS normal_pellets, sum(power_pellets)::BIGINT AS power_pellets, sum(ghosts_eaten)::BIGINT AS ghosts_eaten, sum(fruit_eaten)::BIGINT AS fruit_eaten,
  max(dry_now) AS longest_no_pellet_decisions, max(dry_frames) AS longest_no_pellet_frames, count(period) AS loop_decisions, max(streak) AS longest_loop_streak_decisions,
  coalesce(sum(got) FILTER (life = 0), 0)::BIGINT AS first_life_pellets, coalesce(sum(got) FILTER (life > 0), 0)::BIGINT AS post_respawn_pellets, {_STATUS} AS outcome FROM lt GROUP BY episode),
e AS (SELECT *, unsafe_immediate_choices::DOUBLE / nullif(immediate_risk_decisions, 0) AS unsafe_immediate_choice_rate, avoidable_immediate_deaths::DOUBLE / nullif(avoidable_risk_decisions, 0) AS avoidable_immediate_death_rate,
  straight_chosen::DOUBLE / nullif(straight_available, 0) AS straight_choice_rate, 0::BIGINT AS violations, outcome IN ('decision_cap', 'simulation_frame_cap', 'trace_end', 'no_progress_watchdog') AS censored,
  outcome = 'level_cleared' AS level_cleared FROM em)"""


def ended() -> Column:
    """How an episode of the log ended, from its last row."""
    last = F.max_by(F.struct("pellets_after", "lost"), "turn")
    return F.when(last["pellets_after"] == 0, "level_cleared").when(F.count(F.lit(1)) >= 70, "decision_cap").when(last["lost"], "life_lost").otherwise("trace_end")


def summaries(t: Tables) -> DataFrame:
    return D.summary(log(t), ended())


@query(
    "decision_summary",
    f"""WITH {DECISIONS}, {_SUMMARY},
    pl AS (SELECT episode, string_agg(life || ':' || n || '/' || p || '/' || l, ',' ORDER BY life::VARCHAR) AS per_life FROM (SELECT episode, life, count(*) AS n, sum(got)::BIGINT AS p, bool_or(lost) AS l FROM dl GROUP BY 1, 2) GROUP BY 1),
    lp AS (SELECT episode, string_agg(period || ':' || c, ',' ORDER BY period) AS loop_periods FROM (SELECT episode, period, count(*) AS c FROM dl WHERE period IS NOT NULL GROUP BY 1, 2) GROUP BY 1)
    SELECT e.*, per_life, coalesce(loop_periods, '') AS loop_periods FROM e JOIN pl USING (episode) LEFT JOIN lp USING (episode)""",
)
def decision_summary(t: Tables) -> DataFrame:
    lives = F.transform(F.map_entries("per_life"), lambda e: F.concat_ws("/", F.concat_ws(":", e["key"], e["value"]["decisions"]), e["value"]["pellets_collected"].cast("string"), e["value"]["life_lost"].cast("string")))
    periods = F.transform(F.map_entries("loop_periods"), lambda e: F.concat_ws(":", e["key"], e["value"]))
    return summaries(t).withColumns({"per_life": F.array_join(lives, ","), "loop_periods": F.array_join(periods, ",")})


_GATES = {
    "sustained no-pellet cycle": "longest_loop_streak_decisions > 7",
    "pellet stall": "longest_no_pellet_decisions > 128",
    "incorrect multi-tile action": "nonterminal_multi_tile_actions > 0",
    "incorrect stationary action": "nonterminal_stationary_actions > 0",
    "avoidable immediate death": "avoidable_immediate_deaths > 0",
    "maze incomplete": "NOT level_cleared OR pellets_remaining <> 0",
}
_FAILED = "list_filter([" + ", ".join(f"CASE WHEN {e} THEN '{k}' END" for k, e in _GATES.items()) + "], lambda n: n IS NOT NULL)"


@query("quality_gates", f"WITH {DECISIONS}, {_SUMMARY} SELECT episode, array_to_string({_FAILED}, ',') AS failures, len({_FAILED}) = 0 AS approved FROM e")
def quality_gates(t: Tables) -> DataFrame:
    return M.gate(summaries(t), D.quality_gates()).select("episode", F.array_join("failures", ",").alias("failures"), "approved")


@query(
    "qualification",
    f"""WITH {DECISIONS}, {_SUMMARY}, q AS (SELECT 'development' AS phase, 0.0 AS rate, 0 AS extra UNION ALL SELECT 'qualification', 1.0, 1),
    x AS (SELECT phase, rate, extra, count(*) AS games, sum(life_losses) AS losses, sum(avoidable_immediate_deaths) AS deaths, sum(len({_FAILED})) AS gate_failures, (SELECT min(r) FROM (SELECT avg(level_cleared::INT) AS r FROM e GROUP BY level)) AS low FROM e, q GROUP BY 1, 2, 3)
    SELECT phase, array_to_string(list_sort(list_filter([CASE WHEN phase <> 'qualification' THEN 'not a qualification run' END, CASE WHEN extra = 1 THEN 'suite incomplete or duplicated' END, CASE WHEN games < 20 THEN 'too few games' END,
      CASE WHEN low < rate THEN 'clear rate' END, CASE WHEN losses > 4 THEN 'too many lives lost' END, CASE WHEN deaths > 0 THEN 'avoidable immediate deaths' END, CASE WHEN gate_failures > 0 THEN 'episode gates' END], lambda n: n IS NOT NULL)), ',') AS failures FROM x""",
)
def qualification(t: Tables) -> DataFrame:
    gated = M.gate(summaries(t), D.quality_gates())
    expected = gated.select("level", "seed")
    more = expected.union(expected.limit(1).select("level", F.lit(-1).cast("long").alias("seed")))
    runs = [("development", D.qualification(gated, expected, "development", min_rate=0.0)), ("qualification", D.qualification(gated, more, "qualification"))]
    parts = [q.select(F.lit(phase).alias("phase"), F.array_join("failures", ",").alias("failures")) for phase, q in runs]
    return parts[0].union(parts[1])


_NAMED = listed(_STRATA | _V4 | {"search_survival_critical": _SURVIVAL})


@query(
    "native_cohorts",
    f"""WITH {DECISIONS}, n AS (SELECT *, unnest(string_split({_NAMED}, ',')) AS cohort FROM dl)
    SELECT cohort, count(*) AS decisions, sum(action_frames)::BIGINT AS frames, sum(got)::BIGINT AS pellets, count(*) FILTER ({_AVOIDABLE}) AS safe_alternative_opportunities, count(*) FILTER ({_AVOIDABLE} AND choice_fatal) AS avoidable_immediate_deaths,
    count(*) FILTER (NOT some_safe) AS all_immediate_actions_fatal, count(*) FILTER ({_AVOIDABLE} AND choice_fatal)::DOUBLE / nullif(count(*) FILTER ({_AVOIDABLE}), 0) AS fatal_choice_when_safe_available FROM n WHERE cohort <> '' GROUP BY cohort""",
)
def native_cohorts(t: Tables) -> DataFrame:
    rows = log(t).withColumn("names", G.true_names(F.map_concat(F.map_filter(D.strata(), lambda k, v: k != "post_respawn"), D.cohorts())))
    chance, died = M.n(D.mixed()), M.n(D.mixed() & D.fatal(F.col("choice")))
    measures = {"decisions": F.count(F.lit(1)), "frames": F.sum("action_frames"), "pellets": F.sum(D.collected()), "safe_alternative_opportunities": chance, "avoidable_immediate_deaths": died, "all_immediate_actions_fatal": M.n(~D.some_safe()), "fatal_choice_when_safe_available": M.rate(died, chance)}
    return M.by_cohort(rows, "names", measures)


_TOTALS = ("decisions", "simulation_frames", "pellets_collected", "life_losses", "avoidable_immediate_deaths", "avoidable_risk_decisions", "all_immediate_actions_fatal", "loop_decisions", "first_life_pellets", "post_respawn_pellets", "power_pellets", "ghosts_eaten")


@query(
    "native_totals",
    f"""WITH {DECISIONS}, {_SUMMARY} SELECT count(*) AS games, count(*) FILTER (level_cleared) AS clears, count(*) FILTER (censored) AS capped, {', '.join(f'sum({c})::BIGINT AS {c}' for c in _TOTALS)},
    1000 * sum(pellets_collected)::DOUBLE / nullif(sum(simulation_frames), 0) AS pellets_per_1000_native_frames, sum(avoidable_immediate_deaths)::DOUBLE / nullif(sum(avoidable_risk_decisions), 0) AS fatal_choice_when_safe_available,
    avg(first_life_pellets) AS mean_first_life_pellets, max(longest_no_pellet_decisions) AS maximum_pellet_free_decisions, max(longest_loop_streak_decisions) AS maximum_loop_streak FROM e""",
)
def native_totals(t: Tables) -> DataFrame:
    total = lambda c: F.sum(c)
    return summaries(t).agg(
        F.count(F.lit(1)).alias("games"), M.n(F.col("level_cleared")).alias("clears"), M.n(F.col("censored")).alias("capped"), *[total(c).alias(c) for c in _TOTALS],
        M.rate(1000 * total("pellets_collected"), total("simulation_frames")).alias("pellets_per_1000_native_frames"),
        M.rate(total("avoidable_immediate_deaths"), total("avoidable_risk_decisions")).alias("fatal_choice_when_safe_available"),
        F.avg("first_life_pellets").alias("mean_first_life_pellets"), F.max("longest_no_pellet_decisions").alias("maximum_pellet_free_decisions"), F.max("longest_loop_streak_decisions").alias("maximum_loop_streak"),
    )


_SAFE_BACK = "CASE backwards " + " ".join(f"WHEN '{m}' THEN legal_{m} AND NOT fatal_{m}" for m in MOVES) + " END"
_WEIGHTS = " + ".join(f"CASE WHEN legal_{m} THEN weight_{m} ELSE 0 END" for m in MOVES)


@query(
    "behaviour_totals",
    f"""WITH {DECISIONS} SELECT level, count(*) AS decisions, count(*) FILTER (choice = backwards) AS reversals, count(*) FILTER (choice = backwards)::DOUBLE / count(*) AS reversal_rate,
    count(*) FILTER ({_AVOIDABLE} AND choice_fatal AND {_SAFE_BACK}) AS avoidable_deaths_with_safe_reverse,
    count(*) FILTER ({_AVOIDABLE} AND choice_fatal AND CASE choice {' '.join(f"WHEN '{m}' THEN weight_{m}" for m in MOVES)} END::DOUBLE / ({_WEIGHTS}) >= 0.5) AS confident_avoidable_deaths FROM dl GROUP BY level""",
)
def behaviour_totals(t: Tables) -> DataFrame:
    choice, back = F.col("choice"), D.backwards()
    died = D.mixed() & D.fatal(choice)
    safe_back = F.coalesce(~F.try_element_at("risks", back)["life_lost"], F.lit(False))
    return log(t).groupBy("level").agg(
        F.count(F.lit(1)).alias("decisions"), M.n(choice == back).alias("reversals"), M.rate(M.n(choice == back), F.count(F.lit(1))).alias("reversal_rate"),
        M.n(died & safe_back).alias("avoidable_deaths_with_safe_reverse"), M.n(died & (F.try_element_at("probabilities", choice) >= 0.5)).alias("confident_avoidable_deaths"),
    )


_BEST = "greatest(" + ", ".join(f"CASE WHEN legal_{m} THEN surv_{m} * 100 + worth_{m} ELSE -1 END" for m in MOVES) + ")"
_OWN = "CASE choice " + " ".join(f"WHEN '{m}' THEN surv_{m} * 100 + worth_{m}" for m in MOVES) + " END"


@query(
    "search_evaluation",
    f"""WITH {DECISIONS}, s AS (SELECT *, {_BEST} AS best, {_OWN} AS own FROM dl)
    SELECT level, count(*) AS n, avg((choice = gold)::INT) AS accuracy, count(*) FILTER (outcome = 'life_lost') AS caught_next_turn, avg((best = own)::INT) AS tie_aware_accuracy, count(*) FILTER (own // 100 < best // 100) AS lower_survival_choices,
    avg(CASE WHEN own // 100 = best // 100 THEN best - own END) AS mean_regret FROM s GROUP BY level""",
)
def search_evaluation(t: Tables) -> DataFrame:
    rows = log(t).withColumns(D.search_evaluation())
    share = lambda c: F.avg(c.cast("int"))
    return rows.groupBy("level").agg(
        F.count(F.lit(1)).alias("n"), share(F.col("choice") == F.col("gold")).alias("accuracy"), M.n(F.col("outcome") == "life_lost").alias("caught_next_turn"),
        share(F.col("tie_correct")).alias("tie_aware_accuracy"), M.n(F.col("lower_survival")).alias("lower_survival_choices"), F.avg("regret").alias("mean_regret"),
    )


_GOLD_P = "CASE gold " + " ".join(f"WHEN '{m}' THEN weight_{m}" for m in MOVES) + f" END::DOUBLE / ({_WEIGHTS})"
_OTHER_P = "greatest(" + ", ".join(f"CASE WHEN legal_{m} AND gold <> '{m}' THEN weight_{m} ELSE 0 END" for m in MOVES) + f")::DOUBLE / ({_WEIGHTS})"


@query(
    "hard_case_groups",
    f"""WITH {DECISIONS}, s AS (SELECT *, {_GOLD_P} AS pg, {_OTHER_P} AS po, {_NAMED} AS cohorts, CASE WHEN event_id % 3 = 0 THEN 'targeted' ELSE 'informative' END AS class FROM dl),
    u AS (SELECT 'overall' AS kind, 'all' AS grp, * FROM s UNION ALL SELECT 'cohort', unnest(string_split(cohorts, ',')), * FROM s UNION ALL SELECT 'primary_role', CASE WHEN got > 0 THEN 'cleanup' ELSE 'immediate_evasion' END, * FROM s WHERE class = 'targeted')
    SELECT kind, grp, count(*) AS n, avg((choice = gold)::INT) AS teacher_agreement, round(avg(-ln(greatest(pg, 1e-12))), 9) AS mean_cross_entropy, round(avg(pg - po), 9) AS mean_margin FROM u WHERE grp <> '' GROUP BY 1, 2""",
)
def hard_case_groups(t: Tables) -> DataFrame:
    p, gold = F.col("probabilities"), F.col("gold")
    cohorts = G.true_names(F.map_concat(F.map_filter(D.strata(), lambda k, v: k != "post_respawn"), D.cohorts()))
    role = F.when(F.col("event_id") % 3 == 0, F.when(D.collected() > 0, "cleanup").otherwise("immediate_evasion"))
    kind = lambda k, g: F.struct(F.lit(k).alias("kind"), g.alias("grp"))
    # one pass: every row goes once to the whole, once to each of its cohorts and, if targeted, to its role
    groups = F.concat(F.array(kind("overall", F.lit("all"))), F.transform(cohorts, lambda c: kind("cohort", c)), F.when(role.isNotNull(), F.array(kind("primary_role", role))).otherwise(F.array().cast("array<struct<kind:string,grp:string>>")))
    rows = log(t).select((F.col("choice") == gold).cast("int").alias("right"), P.cross_entropy(p, gold).alias("ce"), P.margin(p, gold).alias("m"), F.inline(groups))
    return rows.groupBy("kind", "grp").agg(F.count(F.lit(1)).alias("n"), F.avg("right").alias("teacher_agreement"), F.round(F.avg("ce"), 9).alias("mean_cross_entropy"), F.round(F.avg("m"), 9).alias("mean_margin"))


_PAIRS = f"""{DECISIONS}, {_SUMMARY},
pr AS (SELECT * FROM dl WHERE turn = 0 AND episode % 2 = 0),
fb AS (SELECT episode, min(turn) FILTER (got > 0) AS first_food FROM dl GROUP BY episode),
lf AS (SELECT dl.episode, coalesce(bool_or(lost AND turn <= first_food), false) AS lost_before_food FROM dl JOIN fb USING (episode) GROUP BY dl.episode),
j AS (SELECT pr.*, p.decisions AS p_decisions, p.simulation_frames AS p_frames, p.life_losses AS p_life_losses, p.level_cleared AS p_level_cleared, p.longest_no_pellet_decisions AS p_longest_dry,
        m.decisions AS n_decisions, m.simulation_frames AS n_frames, m.life_losses AS n_life_losses, m.level_cleared AS n_level_cleared, m.longest_no_pellet_decisions AS n_longest_dry,
        first_food, lost_before_food, nr.power AS n_power, nr.power_after AS n_power_after, nr.scared_near AS n_scared_near, nr.danger AS n_danger_near
      FROM pr JOIN e p ON p.episode = pr.episode JOIN e m ON m.episode = pr.episode + 1 JOIN dl nr ON nr.episode = pr.episode + 1 AND nr.turn = 0 JOIN fb ON fb.episode = pr.episode JOIN lf ON lf.episode = pr.episode)"""
_HARM = {
    "anticipatory_harm": "NOT some_fatal AND (n_life_losses > 0 OR NOT n_level_cleared)",
    "actual_expiry_fatal_alternative": "choice_fatal AND frightened AND n_power > 0 AND n_power_after = 0 AND n_scared_near <= 3 AND n_danger_near > 3 AND NOT gold_fatal",
    "productive_retreat_to_food": "dry >= 24 AND gold = backwards AND coalesce(first_food BETWEEN 1 AND 32 AND NOT lost_before_food, false) AND n_life_losses = 0 AND n_level_cleared AND n_decisions - p_decisions >= 8 AND n_frames - p_frames >= 60",
}


def pairs(t: Tables) -> DataFrame:
    """Roots of even episodes with the measures of their own (p_) and of the next episode (n_)."""
    rows = log(t)
    measures = {"decisions": "decisions", "simulation_frames": "frames", "life_losses": "life_losses", "level_cleared": "level_cleared", "longest_no_pellet_decisions": "longest_dry"}
    done = summaries(t).select("episode", *measures)
    side = lambda p, key: done.select(key.alias("episode"), *[F.col(c).alias(f"{p}_{k}") for c, k in measures.items()])
    before = F.col("episode") - 1
    first = rows.where("turn = 0")
    clock = first.select(before.alias("episode"), F.col("power").alias("n_power"), F.col("power_after").alias("n_power_after"), D.nearest(lambda g: g["outside"] & g["frightened"]).alias("n_scared_near"), D.danger().alias("n_danger_near"))
    ate = rows.groupBy("episode").agg(F.min(F.when(D.collected() > 0, F.col("turn"))).alias("p_first_food"), F.min(F.when(F.col("lost"), F.col("turn"))).alias("_lost"))
    ate = ate.select("episode", "p_first_food", F.coalesce(F.col("_lost") <= F.col("p_first_food"), F.lit(False)).alias("p_lost_before_food"))
    return first.where("episode % 2 = 0").join(side("p", F.col("episode")), "episode").join(side("n", before), "episode").join(clock, "episode").join(ate, "episode")


_EVIDENCE = """CASE WHEN choice_fatal AND NOT gold_fatal THEN 'immediate_fatal_with_safe_teacher' WHEN n_life_losses > p_life_losses THEN 'extra_life_loss_with_same_continuation_controller'
  WHEN p_level_cleared AND NOT n_level_cleared THEN 'incomplete_forced_first_branch_with_same_controller'
  WHEN p_level_cleared AND n_level_cleared AND n_life_losses = p_life_losses AND n_decisions - p_decisions >= 8 AND n_frames - p_frames >= 60 THEN 'verified_route_cost'
  WHEN n_longest_dry - p_longest_dry >= 16 AND n_frames - p_frames >= 60 AND n_life_losses = p_life_losses AND p_level_cleared THEN 'verified_extended_pellet_stall' END"""
_RECOVERY = {
    "immediate_evasion": "p_life_losses < 14 AND choice_fatal AND NOT gold_fatal",
    "sparse_cleanup": "p_life_losses < 14 AND NOT choice_fatal AND NOT gold_fatal AND gold_food > choice_food AND pellets_before <= 30",
    "productive_junction": "p_life_losses < 14 AND NOT choice_fatal AND NOT gold_fatal AND gold_food > choice_food AND pellets_before > 30",
}


@query("branch_evidence", f"WITH {_PAIRS} SELECT episode, {listed(_HARM)} AS flags, {_EVIDENCE} AS harm, {listed(_RECOVERY)} AS recovery FROM j")
def branch_evidence(t: Tables) -> DataFrame:
    gold, choice = F.col("gold"), F.col("choice")
    return pairs(t).select("episode", names(D.branch_flags(gold, choice)).alias("flags"), D.negative_evidence(gold, choice).alias("harm"), names(D.recovery_flags(F.col("p_life_losses") < 14, gold, choice)).alias("recovery"))


_ERRORS = {"immediate_error": "choice_fatal AND some_safe", "routing_error": "NOT choice_fatal AND choice_food = 0 AND some_safe_food AND (n_legal >= 3 OR dry >= 24)"}
_SAFE2 = "n_legal >= 2 AND NOT choice_fatal"
_SCOUT = {"expiry": f"{_SAFE2} AND frightened AND power BETWEEN 1 AND 32 AND scared_near <= 6", "anticipatory": f"{_SAFE2} AND NOT some_fatal AND danger <= 6", "dry_recovery": f"{_SAFE2} AND dry >= 24"}


@query("recorded_errors", f"WITH {DECISIONS} SELECT episode, turn, {listed(_ERRORS)} AS errors FROM dl")
def recorded_errors(t: Tables) -> DataFrame:
    return log(t).select("episode", "turn", names(D.recorded_errors()).alias("errors"))


@query(
    "scouted_roots",
    f"""WITH {DECISIONS}, s AS (SELECT *, {_SCOUT['expiry']} AS ex, {_SCOUT['anticipatory']} AS an, {_SCOUT['dry_recovery']} AS dr FROM dl),
    o AS (SELECT *, row_number() OVER (PARTITION BY episode ORDER BY (ex AND some_fatal)::INT DESC, ex::INT DESC, visits DESC, an::INT DESC, -least(danger, 20) DESC, dr::INT DESC, CASE WHEN ex THEN -power ELSE 0 END DESC, turn) AS place FROM s WHERE ex OR an OR dr)
    SELECT episode, turn, {listed({'expiry': 'ex', 'anticipatory': 'an', 'dry_recovery': 'dr'})} AS flags, place FROM o""",
)
def scouted_roots(t: Tables) -> DataFrame:
    rows = log(t).withColumn("flags", D.scout_flags()).where(F.size(G.true_names(F.col("flags"))) > 0)
    place = F.row_number().over(Window.partitionBy("episode").orderBy(D.scout_score(F.col("flags"), F.col("visits")).desc(), "turn")).cast("long")
    return rows.select("episode", "turn", names(F.col("flags")).alias("flags"), place.alias("place"))


@query(
    "expiry_beam",
    f"""WITH {DECISIONS}, o AS (SELECT *, row_number() OVER (PARTITION BY episode ORDER BY (power BETWEEN 1 AND 7)::INT DESC, (scared_near <= 1)::INT DESC, -abs(scared_near - 1) DESC, (visits = 0)::INT DESC, -power DESC, turn) AS place FROM dl)
    SELECT episode, turn, place FROM o WHERE place <= 8""",
)
def expiry_beam(t: Tables) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("episode").orderBy(D.expiry_rank(F.col("visits")).desc(), "turn")).cast("long")
    return log(t).select("episode", "turn", place.alias("place")).where("place <= 8")


@query(
    "behaviour_windows",
    f"""WITH {_BEHAVED}, fd AS (SELECT *, min(CASE WHEN got > 0 THEN turn END) OVER (PARTITION BY episode, life ORDER BY turn ROWS BETWEEN CURRENT ROW AND 24 FOLLOWING) - turn AS food_from FROM r2),
    o AS (SELECT *, unnest(list_distinct(list_concat(CASE WHEN food_from IS NOT NULL THEN [greatest(2, food_from + 1), greatest(4, food_from + 4)] ELSE []::BIGINT[] END, [2, 4, 8, 16, 24, -1, -4, -8]::BIGINT[]))) AS off FROM fd WHERE n_legal >= 2 AND (escape OR advantage)),
    k AS (SELECT *, CASE WHEN (NOT choice_fatal AND some_fatal) OR escape THEN 'post_followthrough_with_progress' WHEN escape AND food_in IS NOT NULL THEN 'post_recovery_progress' ELSE 'post_routing_progress' END AS progress_kind FROM o WHERE abs(off) <= 24)
    SELECT k.episode, k.turn AS root, w.turn, off AS "offset", CASE WHEN off > 0 AND coalesce(food_from <= off - 1, false) THEN progress_kind WHEN off > 0 THEN 'post_followthrough' ELSE 'lead_in' END AS kind
    FROM k JOIN dl w ON w.episode = k.episode AND w.life = k.life AND w.turn = k.turn + off WHERE w.n_legal >= 2""",
)
def behaviour_windows(t: Tables) -> DataFrame:
    rows = D.with_behaviour(log(t))
    advantage = (D.food(F.col("choice")) > 0) & ~D.fatal(F.col("choice")) & (F.size("evidence.surviving_without_food") > 0)
    return D.behaviour_windows(rows, rows.where((F.size("legal") >= 2) & (F.col("evidence.escape") | advantage)))


_PRIMARY = "CASE " + " ".join(f"WHEN {_OFFLINE[key]} THEN '{name}'" for name, key in D.SCENARIOS.items()) + " END"
_KIND = "CASE visits WHEN 0 THEN 'lead_in' WHEN 1 THEN 'post_followthrough' ELSE 'recovery_followthrough' END"


@query(
    "scenario_catalog",
    f"""WITH {DECISIONS}, c AS (SELECT *, episode % 2 AS split, {_PRIMARY} AS own, CASE WHEN event_id % 7 = 0 THEN 'replay' WHEN event_id % 3 = 0 AND {_PRIMARY} IS NOT NULL THEN 'targeted' ELSE 'informative' END AS class FROM dl),
    i AS (SELECT *, last_value(CASE WHEN class = 'targeted' THEN own END IGNORE NULLS) OVER (PARTITION BY episode ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS inherited FROM c),
    p AS (SELECT *, CASE class WHEN 'replay' THEN '{D.REPLAY}' WHEN 'targeted' THEN own ELSE inherited END AS scenario FROM i),
    g AS (SELECT split, scenario, count(*) FILTER (class = 'targeted') AS targeted, count(*) FILTER (class = 'informative') AS informative, count(*) FILTER (class = 'replay') AS replay, count(*) AS total_examples, count(DISTINCT episode) AS games, count(DISTINCT origin) AS families FROM p WHERE scenario IS NOT NULL GROUP BY 1, 2),
    w AS (SELECT split, scenario, string_agg(kind || ':' || n, ',' ORDER BY kind) AS window_types FROM (SELECT split, scenario, {_KIND} AS kind, count(*) AS n FROM p WHERE class = 'informative' AND scenario IS NOT NULL GROUP BY 1, 2, 3) GROUP BY 1, 2),
    d AS (SELECT s.split, unnest({[*D.SCENARIOS, D.REPLAY]}) AS scenario FROM (SELECT unnest([0, 1]) AS split) s)
    SELECT d.split::BIGINT AS split, d.scenario, coalesce(targeted, 0) AS targeted, coalesce(informative, 0) AS informative, coalesce(replay, 0) AS replay, coalesce(total_examples, 0) AS total_examples, CASE WHEN d.scenario <> '{D.REPLAY}' THEN coalesce(games, 0) END AS games, coalesce(families, 0) AS families, coalesce(window_types, '') AS window_types
    FROM d LEFT JOIN g ON g.split = d.split AND g.scenario = d.scenario LEFT JOIN w ON w.split = d.split AND w.scenario = d.scenario""",
)
def scenario_catalog(t: Tables) -> DataFrame:
    rows = log(t).withColumn("own", D.primary_scenario(D.offline_cohorts())).withColumn("split", F.col("episode") % 2)
    kind = F.when(F.col("event_id") % 7 == 0, "replay").when((F.col("event_id") % 3 == 0) & F.col("own").isNotNull(), "targeted").otherwise("informative")
    rows = rows.withColumn("class", kind)
    parent = F.last(F.when(F.col("class") == "targeted", F.col("own")), ignorenulls=True).over(Window.partitionBy("episode").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("scenario", F.when(F.col("class") == "replay", D.REPLAY).when(F.col("class") == "targeted", F.col("own")).otherwise(parent)).where("scenario IS NOT NULL")
    window = F.when(F.col("visits") == 0, "lead_in").when(F.col("visits") == 1, "post_followthrough").otherwise("recovery_followthrough")
    count = lambda c: M.n(F.col("class") == c).alias(c)
    per = rows.groupBy("split", "scenario").agg(count("targeted"), count("informative"), count("replay"), F.count(F.lit(1)).alias("total_examples"), F.count_distinct("episode").alias("games"), F.count_distinct("origin").alias("families"))
    kinds = rows.where("class = 'informative'").groupBy("split", "scenario", window.alias("kind")).agg(F.count(F.lit(1)).alias("n"))
    kinds = kinds.groupBy("split", "scenario").agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "kind", "n"))), ",").alias("window_types"))
    dim = t.spark.createDataFrame([(s, c) for s in (0, 1) for c in [*D.SCENARIOS, D.REPLAY]], "split long, scenario string")
    out = M.over_dimension(dim, per, ["split", "scenario"], ["targeted", "informative", "replay", "total_examples", "games", "families"]).join(kinds, ["split", "scenario"], "left")
    return out.withColumns({"games": F.when(F.col("scenario") != D.REPLAY, F.col("games")), "window_types": F.coalesce("window_types", F.lit(""))})


_RESUMED = """p AS (SELECT o_orderkey, 40 + o_custkey % 60 AS n, 1 + o_orderkey % 4 AS ob, 1 + o_custkey % 4 AS oa, CASE WHEN o_orderkey % 5 = 0 THEN 1 + o_custkey % 4 ELSE 1 + o_orderkey % 4 END AS nb,
  CASE WHEN o_orderkey % 5 = 0 THEN 1 + o_orderkey % 4 ELSE 1 + o_custkey % 4 END AS na, o_orderkey % 30 AS stood FROM orders)"""


@query(
    "resume_positions",
    f"""WITH {_RESUMED}, q AS (SELECT *, ceil(n::DOUBLE / ob)::BIGINT AS steps, least(stood * ob, n) AS off FROM p),
    r AS (SELECT *, CASE WHEN ob * oa <> nb * na THEN 'effective batch differs' WHEN stood > steps OR (stood <> steps AND stood % oa <> 0) THEN 'no optimizer boundary' WHEN off < n AND off % nb <> 0 THEN 'records repeated or skipped' END AS problem FROM q)
    SELECT o_orderkey, CASE WHEN problem IS NULL THEN ceil(off::DOUBLE / nb)::BIGINT END AS position, problem FROM r""",
)
def resume_positions(t: Tables) -> DataFrame:
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    ob, oa, swapped = 1 + key % 4, 1 + cust % 4, key % 5 == 0
    got = D.resume_position(40 + cust % 60, ob, oa, F.when(swapped, oa).otherwise(ob), F.when(swapped, ob).otherwise(oa), key % 30)
    return t("orders").select("o_orderkey", got.alias("r")).select("o_orderkey", "r.position", "r.problem")


_X7 = ("avoidable_fatal", "pre_trap", "stalled", "power_expiry", "post_respawn", "late_maze", "risk_opportunity")


def _sampled_sql(per: int = 3, budget: int = 24) -> str:
    out, last = "x0 AS (SELECT *, false AS took FROM c)", "x0"
    for k, name in enumerate(_X7, 1):
        out += f""",
x{k}a AS (SELECT *, ({_CANDIDATE[name]}) AND NOT took AS open_, count(*) FILTER (took) OVER (PARTITION BY episode) AS sum_ FROM {last}),
x{k}b AS (SELECT *, count(*) OVER w AS n_, row_number() OVER (w ORDER BY turn) - 1 AS i_ FROM x{k}a WINDOW w AS (PARTITION BY episode, open_)),
x{k}c AS (SELECT *, least({per}, n_, {budget} - sum_) AS slots_ FROM x{k}b),
x{k} AS (SELECT * EXCLUDE (took, open_, sum_, n_, i_, slots_), took OR (open_ AND len(list_filter(range(0, {per}), lambda j: j < slots_ AND i_ = j * n_ // greatest(slots_, 1))) > 0) AS took FROM x{k}c)"""
        last = f"x{k}"
    any_ = " OR ".join(f"({e})" for e in _CANDIDATE.values())
    return out + f""",
r AS (SELECT *, NOT took AND ({any_}) AS rest, count(*) FILTER (took) OVER (PARTITION BY episode) AS sum_ FROM {last}),
q AS (SELECT *, row_number() OVER (PARTITION BY episode, rest ORDER BY md5(concat_ws(':', 'roots', episode::VARCHAR, turn::VARCHAR)), turn) AS place FROM r)
SELECT episode, turn FROM q WHERE took OR (rest AND place <= {budget} - sum_)"""


@query("root_sampler", f"WITH {DECISIONS}, b AS (SELECT *, {_MIXED} AND choice_fatal AS bad FROM dl), c AS (SELECT *, {_TRAPS} AS trap FROM b WINDOW w AS (PARTITION BY episode ORDER BY turn)), {_sampled_sql()}")
def root_sampler(t: Tables) -> DataFrame:
    return S.root_sampler(D.with_candidate_flags(log(t)), "flags", _X7, 3, 24, "roots").select("episode", "turn")


_X8 = ("expiry_during_action_with_near_ghost", "immediate_critical", "power_expiry", "ghost_intercept", "food_dry", "sparse_food", "post_respawn", "food_junction")


@query("cohort_queues")
def cohort_queues(t: Tables) -> DataFrame:
    """Roots by cohorts in turn; which one comes next depends on all before, so a test holds it against a plain loop."""
    rows = log(t).where((F.col("turn") >= 4) & (F.size("legal") >= 2)).withColumn("flags", D.cohorts())
    return S.cohort_queues(rows, "flags", _X8, 12)


_CLASSES = {"learner": ("fresh", "old"), "hard": ("hard", "informative", "replay"), "offline": ("targeted", "informative", "replay"), "balanced": ("targeted", "informative", "replay")}
_RECORDS = f"""{DECISIONS}, rc AS (SELECT event_id AS id, CASE WHEN episode % 4 = 0 AND event_id % 50 <> 1 THEN 'development' ELSE 'train' END AS split, event_id % 3 AS c, CASE WHEN event_id % 5 < 3 THEN 'off_policy' ELSE 'learner' END AS mixed,
  episode // 2 AS family, episode, (event_id - event_id % 97 // 90)::VARCHAR AS digest, gold AS label, CASE WHEN event_id % 3 = 1 THEN event_id - event_id % 7 END AS parent, CASE visits {' '.join(f"WHEN {i} THEN '{r}'" for i, r in enumerate(DS.CONTRACTS['balanced'].roles))} END AS role, * EXCLUDE (episode) FROM dl)"""


def _flag_sql(name: str) -> str:
    return {**_OFFLINE, **_V4, **_COVERAGE, "anticipatory_harm": "false", "post_respawn": "life > 0"}[name]


def _contract_sql(kind: str) -> str:
    c, names_ = DS.CONTRACTS[kind], _CLASSES[kind]
    cls = "CASE c " + " ".join(f"WHEN {i} THEN '{n}'" for i, n in enumerate(names_)) + f" ELSE '{names_[-1]}' END"
    legal = "CASE label " + " ".join(f"WHEN '{m}' THEN legal_{m}" for m in MOVES) + " ELSE false END"
    power = "frightened AND power <= 60" if kind == "learner" else _COHORTS["power_expiry"]
    flags = {f: power if f == "power_expiry" else _flag_sql(f) for f in c.floors}

    def need(table: dict) -> str:
        return "SELECT * FROM (VALUES " + ", ".join(f"('{s}', '{k}', {v[i]})" for k, v in table.items() for i, s in enumerate(DS.SPLITS)) + ") v(split, name, need)"

    def counted(check: str, table: dict, have: str, exact: bool) -> str:
        bad, join = ("coalesce(n, 0) <> coalesce(need, 0)", "FULL") if exact else ("coalesce(n, 0) < need", "LEFT")
        return f"SELECT '{check}' AS check, coalesce(w.split, h.split) || '/' || coalesce(w.name, h.name) AS key, coalesce(n, 0) || '/' || coalesce(need, 0) AS detail FROM ({need(table)}) w {join} JOIN ({have}) h ON h.split = w.split AND h.name = w.name WHERE {bad}"

    first = f"class = '{names_[0]}'"
    parts = [
        "SELECT 'repeated digest' AS check, digest AS key, count(*)::VARCHAR AS detail FROM k GROUP BY digest HAVING count(*) > 1",
        "SELECT 'digest in two splits', digest, count(DISTINCT split)::VARCHAR FROM k GROUP BY digest HAVING count(DISTINCT split) > 1",
        "SELECT 'family in two splits', family::VARCHAR, count(DISTINCT split)::VARCHAR FROM k GROUP BY family HAVING count(DISTINCT split) > 1",
        f"SELECT 'illegal label', id::VARCHAR, label FROM k WHERE NOT {legal}",
        counted("budget", c.budgets, "SELECT split, class AS name, count(*) AS n FROM k GROUP BY 1, 2", True),
        counted("floor", c.floors, " UNION ALL ".join(f"SELECT split, '{f}' AS name, count(*) AS n FROM k WHERE {first} AND ({e}) GROUP BY 1" for f, e in flags.items()), False),
    ]
    if c.roles:
        parts.append(counted("role", c.roles, f"SELECT split, role AS name, count(*) AS n FROM k WHERE {first} AND role IS NOT NULL GROUP BY 1, 2", True))
    if c.family_cap is not None:
        parts.append(f"SELECT 'family cap', family::VARCHAR, count(*)::VARCHAR FROM k GROUP BY family HAVING count(*) > {c.family_cap}")
    if c.episode_cap is not None:
        parts.append(f"SELECT 'episode cap', episode::VARCHAR, count(*)::VARCHAR FROM k WHERE {first} GROUP BY episode HAVING count(*) > {c.episode_cap}")
    if c.per_root is not None:
        parts.append(f"SELECT 'windows of a root', parent::VARCHAR, count(*)::VARCHAR FROM k WHERE parent IS NOT NULL GROUP BY parent HAVING count(*) > {c.per_root}")
    if c.mix:
        wanted = f"round_even(count(*) * {c.mix[1]}, 0)::BIGINT"
        parts.append(f"SELECT 'origin', split || '/' || class, count(*) FILTER (mixed = '{c.mix[0]}') || '/' || {wanted} FROM k WHERE class IN {tuple(names_[:2])} GROUP BY split, class HAVING count(*) FILTER (mixed = '{c.mix[0]}') <> {wanted}")
    if c.parents:
        parts.append(f"SELECT 'parent', k.id::VARCHAR, coalesce(k.parent::VARCHAR, 'null') FROM k LEFT JOIN k p ON p.id = k.parent WHERE k.class = '{c.parents[0]}' AND NOT coalesce(p.class = '{c.parents[1]}' AND p.episode = k.episode AND p.split = k.split, false)")
    return f"WITH {_RECORDS}, k AS (SELECT *, {cls} AS class FROM rc)\n" + "\nUNION ALL ".join(parts)


def records(t: Tables, kind: str) -> DataFrame:
    """The log as records of a dataset, with every kind of fault in it."""
    classes, roles = _CLASSES[kind], list(DS.CONTRACTS["balanced"].roles)
    id_ = F.col("event_id")
    pick = lambda c, values: F.element_at(F.array(*map(F.lit, values)), F.least(c, F.lit(len(values) - 1)).cast("int") + 1)
    flags = D.coverage_flags((1, 2, 3)) if kind == "learner" else F.map_concat(F.map_filter(D.cohorts(), lambda k, v: k.isin("expiry_during_action_with_near_ghost", "food_junction")), D.offline_cohorts())
    return log(t).select(
        id_.alias("id"), F.when((F.col("episode") % 4 == 0) & (id_ % 50 != 1), "development").otherwise("train").alias("split"), pick(id_ % 3, classes).alias("class"),
        F.when(id_ % 5 < 3, "off_policy").otherwise("learner").alias("origin"), F.expr("episode div 2").alias("family"), "episode", (id_ - F.expr("event_id % 97 div 90")).cast("string").alias("digest"),
        F.col("gold").alias("label"), F.col("legal").alias("options"), F.when(id_ % 3 == 1, id_ - id_ % 7).alias("parent"), pick(F.col("visits"), roles).alias("role"), flags.alias("flags"),
    )


def _contract_query(kind: str):
    @query(f"contract_{kind}", _contract_sql(kind))
    def run(t: Tables) -> DataFrame:
        return DS.violations(records(t, kind), DS.CONTRACTS[kind])


for _kind in DS.CONTRACTS:
    _contract_query(_kind)


_STORED = "sha256(concat_ws(chr(31), episode::VARCHAR, turn::VARCHAR, choice))"


@query(
    "proof_revalidation",
    f"""WITH {DECISIONS}, p AS (SELECT *, event_id % 11 = 0 AS bad_digest, event_id % 13 = 0 AND NOT frightened AS bad_flags, event_id % 17 = 0 AS bad_power FROM dl),
    c AS (SELECT event_id, unnest(list_filter([CASE WHEN bad_digest THEN 'digest' END, CASE WHEN bad_flags AND NOT pellets_before <= 30 THEN 'cohorts' END, CASE WHEN bad_power THEN 'power' END, CASE WHEN choice_fatal THEN 'fatal choice' END], lambda x: x IS NOT NULL)) AS check FROM p)
    SELECT "check", event_id::VARCHAR AS key, '' AS detail FROM c""",
)
def proof_revalidation(t: Tables) -> DataFrame:
    """Proofs of which some have another digest, a flag too many or another clock than their state."""
    rows, id_ = log(t), F.col("event_id")
    digest = canon.fingerprint(F.col("episode").cast("string"), F.col("turn").cast("string"), "choice")
    added = F.transform_values(D.offline_cohorts(), lambda k, v: v | ((k == "sparse_food") & (id_ % 13 == 0) & ~F.col("frightened")))
    stored = rows.withColumns({"digest": F.when(id_ % 11 == 0, F.lit("x")).otherwise(digest), "cohorts": added, "power_before": F.col("power") + (id_ % 17 == 0).cast("long"), "frames_taken": F.col("action_frames")})
    return DS.proof_problems(stored, "event_id", digest, D.offline_cohorts())


_MAX_W = "greatest(" + ", ".join(f"CASE WHEN legal_{m} THEN weight_{m} ELSE 0 END" for m in MOVES) + ")"
_CHOSEN_W = "CASE choice " + " ".join(f"WHEN '{m}' THEN weight_{m}" for m in MOVES) + " END"


@query(
    "trace_audit",
    f"""WITH {DECISIONS}, p AS (SELECT *, first_value(event_id % 23 = 0) OVER (PARTITION BY episode ORDER BY turn) AS first FROM dl),
    c AS (SELECT event_id, unnest(list_filter([CASE WHEN (event_id % 23 = 0) <> first THEN 'identity' END, CASE WHEN event_id % 9 = 0 OR {_CHOSEN_W} < {_MAX_W} THEN 'distribution' END], lambda x: x IS NOT NULL)) AS check FROM p)
    SELECT "check", event_id::VARCHAR AS key, '' AS detail FROM c""",
)
def trace_audit(t: Tables) -> DataFrame:
    """A trace in which some rows come from another model, and some distributions do not sum to one."""
    id_ = F.col("event_id")
    rows = log(t).withColumns({"identity": F.when(id_ % 23 == 0, "other").otherwise("model"), "probabilities": F.transform_values("probabilities", lambda k, v: F.when(id_ % 9 == 0, v * 0.9).otherwise(v))})
    return DS.trace_problems(rows, "event_id")


@query("request_projection", """SELECT o_orderkey, sha256('{"state":{"priority":"' || o_orderpriority || '","status":"' || o_orderstatus || '"}}') AS digest FROM orders""")
def request_projection(t: Tables) -> DataFrame:
    """Digest of what a model sees of a labelled record."""
    record = F.struct(F.struct(F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority")).alias("state"), F.col("o_custkey").alias("label"), F.lit("x").alias("src"), F.struct("o_orderkey").alias("_meta"))
    return t("orders").select("o_orderkey", canon.json_fingerprint(F.to_json(canon.request(record))).alias("digest"))
