"""What one decision tells: flag sets, roles, branch evidence, and the fold of decisions to an episode.

Rows are decisions with the columns of LOG. A move is fatal if its counterfactual loses the life, a
ghost is dangerous if it is outside and not frightened. Flag sets are maps of name to boolean.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayfold.functions.flags import OPPOSITE, flag, flag_map
from wayfold.operators.metrics import n, rate

#: One row per decision, flat where possible; dry counts decisions since the last pellet before this one.
LOG = """
episode long, turn long, level long, seed long, life long, lives int, heading string, choice string, gold string, legal array<string>,
risks map<string,struct<life_lost:boolean,pellets:long,frames:long>>, ghosts array<struct<name:string,outside:boolean,frightened:boolean,d:long>>,
frightened boolean, power long, power_after long, dry long, visits long, near_power boolean, pellets_before long, pellets_after long,
row long, column long, next_row long, next_column long, action_frames long, outcome string, score_after long, http_ms double,
normal_pellets long, power_pellets long, ghosts_eaten long, fruit_eaten long, survival map<string,long>, worth map<string,long>,
probabilities map<string,double>, origin string, learner_choice string
"""

# Limits of the flag sets, of the roles, of branch evidence and of the gates.
FAR = 999
INTERCEPT, NEAR, CLOSE, SPARSE, JUNCTION = 6, 3, 1, 30, 3
POWER_LOW, POWER_ENDING, DRY_LONG, DRY_STALLED, VISITS_MANY = 120, 60, 24, 32, 4
PRECURSORS = (1, 4, 8, 16)
OPENING, DRY_ROUTING, VISITS_ROUTING, PELLETS_ROUTING, FOLLOW = 12, 8, 2, 122, 24
FOOD_AFTER, EXTRA_DECISIONS, EXTRA_FRAMES, EXTRA_DRY = 32, 8, 60, 16
SCOUT_EXPIRY, SCOUT_FAR = 32, 20
COLUMNS = 28
HARD = ("immediate_critical", "ghost_intercept", "power_expiry", "food_dry", "sparse_food")
CAPPED = ("decision_cap", "simulation_frame_cap", "trace_end", "no_progress_watchdog")
#: Primary scenario and the flag that it stands for, in the order of priority.
SCENARIOS = {
    "immediate_collision_avoidance": "immediate_critical",
    "actual_power_expiry_near_ghost": "actual_power_expiry_during_teacher_action_near_ghost",
    "potential_power_expiry_near_ghost": "potential_expiry_during_action_near_ghost",
    "low_power_clock": "power_expiry",
    "nearby_dangerous_ghost": "ghost_intercept",
    "pellet_stall_routing": "food_dry",
    "sparse_pellet_cleanup": "sparse_food",
}
REPLAY = "prior_replay"


def nearest(where) -> Column:
    """Distance of the nearest ghost for which where holds, FAR without one."""
    return F.coalesce(F.array_min(F.transform(F.filter("ghosts", where), lambda g: g["d"])), F.lit(FAR))


def danger() -> Column:
    return nearest(lambda g: g["outside"] & ~g["frightened"])


def danger_map() -> Column:
    """Distances of the dangerous ghosts by name."""
    return F.map_from_entries(F.transform(F.filter("ghosts", lambda g: g["outside"] & ~g["frightened"]), lambda g: F.struct(g["name"], g["d"])))


def options() -> Column:
    return F.map_values("risks")


def some_fatal() -> Column:
    return F.exists(options(), lambda r: r["life_lost"])


def some_safe() -> Column:
    return F.exists(options(), lambda r: ~r["life_lost"])


def mixed() -> Column:
    return some_fatal() & some_safe()


def fatal(move: Column) -> Column:
    return F.coalesce(F.try_element_at("risks", move)["life_lost"], F.lit(False))


def food(move: Column) -> Column:
    return F.coalesce(F.try_element_at("risks", move)["pellets"], F.lit(0))


def backwards() -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in OPPOSITE.items() for x in kv]), F.col("heading"))


def collected() -> Column:
    return F.col("pellets_before") - F.col("pellets_after")


def power_within(limit) -> Column:
    return F.col("frightened") & (F.col("power") > 0) & (F.col("power") <= limit)


def strata(versioned: bool = True) -> Column:
    """Nine strata of a state; with versioned a respawn is a later life, else fewer than three lives."""
    d, junction = danger(), F.size("legal") >= JUNCTION
    return flag_map({
        "junction": junction,
        "danger_within_3_tiles": d <= NEAR,
        "danger_within_1_tile": d <= CLOSE,
        "frightened": F.col("frightened"),
        "power_pellet_adjacent": F.col("near_power"),
        "late_maze_30_or_fewer": F.col("pellets_before") <= SPARSE,
        "revisited_over_4_times": F.col("visits") > VISITS_MANY,
        "post_respawn": F.col("life") > 0 if versioned else F.col("lives") < 3,
        "search_survival_critical": F.size(F.array_distinct(F.map_values("survival"))) > 1,
    })


def _shared_cohorts() -> dict[str, Column]:
    return {
        "ghost_intercept": danger() <= INTERCEPT,
        "power_expiry": power_within(POWER_LOW),
        "food_dry": F.col("dry") >= DRY_LONG,
        "sparse_food": F.col("pellets_before") <= SPARSE,
        "post_respawn": F.col("life") > 0,
        "immediate_critical": mixed(),
    }


def _may_expire_near() -> Column:
    """The power may end during some move, with any ghost near."""
    longest = F.coalesce(F.array_max(F.transform(options(), lambda r: r["frames"])), F.lit(0))
    return power_within(longest) & (nearest(lambda g: g["outside"]) <= NEAR)


def cohorts() -> Column:
    """Eight cohorts of a decision; the expiry flag asks whether the power may end during a move."""
    return flag_map(_shared_cohorts() | {"expiry_during_action_with_near_ghost": _may_expire_near(), "food_junction": F.size("legal") >= JUNCTION})


def offline_cohorts() -> Column:
    """Eight cohorts in which a possible end of power is told from one that the chosen move saw."""
    actual = F.col("frightened") & (nearest(lambda g: g["outside"]) <= NEAR) & (F.col("power") > 0) & (F.col("power_after") == 0)
    return flag_map(_shared_cohorts() | {"potential_expiry_during_action_near_ghost": _may_expire_near(), "actual_power_expiry_during_teacher_action_near_ghost": actual})


def targeted(flags: Column) -> Column:
    """Two moves at least, a safe choice and a hard flag."""
    hard = flag(flags, HARD[0])
    for name in HARD[1:]:
        hard = hard | flag(flags, name)
    return (F.size("legal") >= 2) & ~fatal(F.col("choice")) & hard


def with_candidate_flags(rows: DataFrame, out: str = "flags") -> DataFrame:
    """Seven flags of candidate roots; pre_trap: an avoidable fatal choice follows 1, 4, 8 or 16 rows on in the same life."""
    by = Window.partitionBy("episode").orderBy("turn")
    rows = rows.withColumn("_bad", mixed() & fatal(F.col("choice")))
    ahead = None
    for k in PRECURSORS:
        hit = F.coalesce(F.lead("_bad", k).over(by) & (F.lead("life", k).over(by) == F.col("life")), F.lit(False))
        ahead = hit if ahead is None else ahead | hit
    rows = rows.withColumn("_trap", ahead)
    named = {
        "avoidable_fatal": F.col("_bad"),
        "risk_opportunity": mixed(),
        "stalled": F.col("dry") >= DRY_STALLED,
        "power_expiry": F.col("frightened") & (F.col("power") <= POWER_ENDING),
        "post_respawn": F.col("life") > 0,
        "late_maze": F.col("pellets_before") <= SPARSE,
        "pre_trap": F.col("_trap"),
    }
    return rows.withColumn(out, flag_map(named)).drop("_bad", "_trap")


def coverage_flags(levels: Sequence[int]) -> Column:
    """The strata that a record covers, with what is known of the learner, and its level."""
    base = strata()
    kept = ("junction", "danger_within_3_tiles", "danger_within_1_tile", "frightened", "power_pellet_adjacent", "late_maze_30_or_fewer", "revisited_over_4_times")
    own = {
        "post_respawn": F.col("life") > 0,
        "learner_visited": F.col("origin") == "learner_visited",
        "learner_disagreement": F.col("learner_choice").isNotNull() & (F.col("learner_choice") != F.col("gold")),
        "immediate_survival_critical": mixed(),
        "critical_reverse": mixed() & (F.col("gold") == backwards()),
        "stalled_current": F.col("dry") >= DRY_STALLED,
        "power_expiry": F.col("frightened") & (F.col("power") <= POWER_ENDING),
    }
    return flag_map({k: flag(base, k) for k in kept} | own | {f"level_{k}": F.col("level") == k for k in levels})


def routing_context() -> Column:
    return (F.col("turn") >= OPENING) & ((F.col("dry") >= DRY_ROUTING) | (F.col("visits") >= VISITS_ROUTING) | (F.col("pellets_before") <= PELLETS_ROUTING))


def in_sequence() -> list[str]:
    """Columns that tell unbroken stretches of one life apart (see trajectory.with_runs)."""
    return ["episode", "life", "run"]


def with_behaviour(rows: DataFrame) -> DataFrame:
    """behaviour (seven roles) and evidence of rows with run (trajectory.with_runs).

    A retreat is an escape with food within FOLLOW later rows of the stretch. An escape turns from the
    heading on a safe move, either straight back from a critical state or so that the gap to every nearest dangerous
    ghost grew by the next row. Two roles rest on branch proofs only and are false here.
    """
    choice = F.col("choice")
    by = Window.partitionBy(*in_sequence()).orderBy("turn")
    eaten = F.when(collected() > 0, F.col("turn"))
    rows = rows.withColumns({"_now": danger_map(), "_food": F.min(eaten).over(by.rowsBetween(1, FOLLOW)) - F.col("turn")})
    rows = rows.withColumn("_next", F.lead("_now").over(by))
    least = lambda m: F.coalesce(F.array_min(F.map_values(m)), F.lit(FAR))
    before, after = least(F.col("_now")), F.when(F.col("_next").isNotNull(), least(F.col("_next")))
    nearest_ones = F.filter(F.map_entries("_now"), lambda e: e["value"] == before)
    grew = F.forall(nearest_ones, lambda e: F.coalesce(F.try_element_at("_next", e["key"]) > e["value"], F.lit(False)))
    rows = rows.withColumns({"_before": before, "_after": after})
    geometric = (F.col("_before") <= INTERCEPT) & F.coalesce(F.col("_after") > F.col("_before"), F.lit(False)) & grew
    safe = ~fatal(choice)
    critical = safe & some_fatal()
    straight_back = critical & F.coalesce(choice == backwards(), F.lit(False))
    escape = safe & (choice != F.col("heading")) & (straight_back | geometric)
    others = F.filter(F.map_entries("risks"), lambda e: (e["key"] != choice) & ~e["value"]["life_lost"])
    advantage = safe & (food(choice) > 0) & F.exists(others, lambda e: e["value"]["pellets"] == 0)
    rows = rows.withColumns({"_escape": escape, "_back": straight_back, "_advantage": advantage})
    roles = {
        "immediate_evasion": critical,
        "anticipatory_escape": F.lit(False),
        "actual_expiry_evasion": F.lit(False),
        "retreat_to_food": F.col("_escape") & F.col("_food").isNotNull(),
        "productive_routing": F.col("_advantage") & (F.size("legal") >= JUNCTION) & routing_context(),
        "cleanup": F.col("_advantage") & (F.col("pellets_before") <= SPARSE),
        "broad_exposure": (danger() <= INTERCEPT) | power_within(POWER_LOW),
    }
    evidence = F.struct(
        choice.alias("gold"),
        F.transform(F.filter(F.map_entries("risks"), lambda e: e["value"]["life_lost"]), lambda e: e["key"]).alias("fatal_moves"),
        F.transform(F.filter(others, lambda e: e["value"]["pellets"] == 0), lambda e: e["key"]).alias("surviving_without_food"),
        food(choice).alias("pellets"),
        F.col("_food").alias("first_food_offset"),
        routing_context().alias("routing_context"),
        F.col("_escape").alias("escape"),
        F.when(F.col("_escape"), F.when(F.col("_back"), "critical_safe_reverse").otherwise("same_ghost_geometric")).alias("escape_kind"),
        F.col("_before").alias("danger_before"),
        F.col("_after").alias("danger_after"),
    )
    return rows.withColumns({"behaviour": flag_map(roles), "evidence": evidence}).drop("_now", "_next", "_food", "_before", "_after", "_escape", "_back", "_advantage")


def proven_roles(proof: Column) -> Column:
    """Seven roles from the flags of branch proofs, under either of their names."""
    has = lambda *names: F.array_max(F.array(*[flag(proof, k) for k in names]))
    expiry = has("actual_expiry_fatal_alternative", "actual_expiry_evasion")
    return flag_map({
        "immediate_evasion": has("immediate_critical", "immediate_evasion") | expiry,
        "anticipatory_escape": has("anticipatory_harm", "anticipatory_escape"),
        "actual_expiry_evasion": expiry,
        "retreat_to_food": has("productive_retreat_to_food", "retreat_to_food"),
        "productive_routing": has("productive_routing") | (has("productive_junction") & (F.size("legal") >= JUNCTION) & routing_context()),
        "cleanup": has("cleanup", "sparse_cleanup"),
        "broad_exposure": F.lit(False),
    })


def branch_flags(teacher: Column, other: Column) -> Column:
    """Three flags of a root (LOG columns) with its two branches.

    Further columns: p_ and n_ measures of the branch after teacher's and after the other move (decisions, frames,
    life_losses, level_cleared), p_first_food (offset of the first food, null without), p_lost_before_food, and the
    other branch's first transition: n_power, n_power_after, n_scared_near, n_danger_near.
    """
    expiry = fatal(other) & F.col("frightened") & (F.col("n_power") > 0) & (F.col("n_power_after") == 0) & (F.col("n_scared_near") <= NEAR) & (F.col("n_danger_near") > NEAR) & ~fatal(teacher)
    food_soon = F.coalesce(F.col("p_first_food").between(1, FOOD_AFTER) & ~F.col("p_lost_before_food"), F.lit(False))
    longer = (F.col("n_decisions") - F.col("p_decisions") >= EXTRA_DECISIONS) & (F.col("n_frames") - F.col("p_frames") >= EXTRA_FRAMES)
    return flag_map({
        "anticipatory_harm": ~some_fatal() & ((F.col("n_life_losses") > 0) | ~F.col("n_level_cleared")),
        "actual_expiry_fatal_alternative": expiry,
        "productive_retreat_to_food": (F.col("dry") >= DRY_LONG) & F.coalesce(teacher == backwards(), F.lit(False)) & food_soon & (F.col("n_life_losses") == 0) & F.col("n_level_cleared") & longer,
    })


def negative_evidence(teacher: Column, other: Column) -> Column:
    """Kind of harm that the other first move did, first match wins; null: none. Columns as in branch_flags, and p_, n_ longest_dry."""
    more = lambda c: F.col(f"n_{c}") - F.col(f"p_{c}")
    level, later = more("life_losses") == 0, more("frames") >= EXTRA_FRAMES
    return (
        F.when(fatal(other) & ~fatal(teacher), "immediate_fatal_with_safe_teacher")
        .when(more("life_losses") > 0, "extra_life_loss_with_same_continuation_controller")
        .when(F.col("p_level_cleared") & ~F.col("n_level_cleared"), "incomplete_forced_first_branch_with_same_controller")
        .when(F.col("p_level_cleared") & F.col("n_level_cleared") & level & (more("decisions") >= EXTRA_DECISIONS) & later, "verified_route_cost")
        .when((more("longest_dry") >= EXTRA_DRY) & later & level & F.col("p_level_cleared"), "verified_extended_pellet_stall")
    )


def recorded_errors() -> Column:
    """Whether a recorded choice was an immediate error (fatal with a safe move) or a routing error (food passed by)."""
    choice = F.col("choice")
    passed = F.exists(options(), lambda r: ~r["life_lost"] & (r["pellets"] > 0))
    where = (F.size("legal") >= JUNCTION) | (F.col("dry") >= DRY_LONG)
    return flag_map({"immediate_error": fatal(choice) & some_safe(), "routing_error": ~fatal(choice) & (food(choice) == 0) & passed & where})


def recovery_flags(qualified: Column, teacher: Column, other: Column) -> Column:
    """Three flags of a recovery whose teacher branch qualified."""
    productive = qualified & ~fatal(other) & ~fatal(teacher) & (food(teacher) > food(other))
    sparse = F.col("pellets_before") <= SPARSE
    return flag_map({"immediate_evasion": qualified & fatal(other) & ~fatal(teacher), "sparse_cleanup": productive & sparse, "productive_junction": productive & ~sparse})


def scout_flags() -> Column:
    """Whether a safe choice is worth a look as an expiry, a warning or a recovery root."""
    safe = (F.size("legal") >= 2) & ~fatal(F.col("choice"))
    return flag_map({
        "expiry": safe & power_within(SCOUT_EXPIRY) & (nearest(lambda g: g["outside"] & g["frightened"]) <= INTERCEPT),
        "anticipatory": safe & ~some_fatal() & (danger() <= INTERCEPT),
        "dry_recovery": safe & (F.col("dry") >= DRY_LONG),
    })


def scout_score(flags: Column, predicted_losses: Column) -> Column:
    """Rank of a scouted root, larger first: rare expiries, then predicted losses, then how near the danger is."""
    on = lambda name: flag(flags, name).cast("int")
    critical = (flag(flags, "expiry") & some_fatal()).cast("int")
    return F.struct(critical.alias("a"), on("expiry").alias("b"), predicted_losses.alias("c"), on("anticipatory").alias("d"), (-F.least(danger(), F.lit(SCOUT_FAR))).alias("e"), on("dry_recovery").alias("f"), F.when(flag(flags, "expiry"), -F.col("power")).otherwise(0).alias("g"))


def expiry_rank(pause: Column) -> Column:
    """Rank of a beam state at the end of power, larger first: about to end, a scared ghost one tile off, no pause, little left."""
    near = nearest(lambda g: g["outside"] & g["frightened"])
    return F.struct(F.col("power").between(1, 7).cast("int").alias("a"), (near <= CLOSE).cast("int").alias("b"), (-F.abs(near - 1)).alias("c"), (pause == 0).cast("int").alias("d"), (-F.col("power")).alias("e"))


def escape_parent() -> Column:
    """A root from which a followed window counts as an escape."""
    role = lambda name: flag(F.col("behaviour"), name)
    return role("immediate_evasion") | role("actual_expiry_evasion") | role("anticipatory_escape") | F.col("evidence.escape")


def behaviour_windows(rows: DataFrame, roots: DataFrame) -> DataFrame:
    """episode, root (turn), turn, offset, kind: windows around roots, of rows with run and roots with behaviour and evidence.

    Offsets: just after the first food (from the root itself on), then 2, 4, 8, 16, 24, then -1, -4, -8; each once, FOLLOW away at
    most, in the root's unbroken stretch of its life, with two moves or more.
    """
    by = Window.partitionBy(*in_sequence()).orderBy("turn")
    ate = rows.withColumn("_food", F.min(F.when(collected() > 0, F.col("turn"))).over(by.rowsBetween(0, FOLLOW)) - F.col("turn")).select(*in_sequence(), "turn", "_food")
    kind = F.when(escape_parent(), "post_followthrough_with_progress").when(flag(F.col("behaviour"), "retreat_to_food"), "post_recovery_progress").otherwise("post_routing_progress")
    r = roots.select(*in_sequence(), "turn", kind.alias("_kind")).join(ate, [*in_sequence(), "turn"])
    by_food = F.when(F.col("_food").isNotNull(), F.array(F.greatest(F.lit(2), F.col("_food") + 1), F.greatest(F.lit(4), F.col("_food") + 4))).otherwise(F.array().cast("array<long>"))
    fixed = F.array(*[F.lit(k).cast("long") for k in (2, 4, 8, 16, FOLLOW, -1, -4, -8)])
    r = r.withColumn("offset", F.explode(F.array_distinct(F.concat(by_food, fixed)))).where(F.abs("offset") <= FOLLOW)
    r = r.select(*in_sequence(), F.col("turn").alias("root"), (F.col("turn") + F.col("offset")).alias("turn"), "offset", "_kind", "_food")
    progress = (F.col("offset") > 0) & F.coalesce(F.col("_food") <= F.col("offset") - 1, F.lit(False))
    out = F.when(progress, F.col("_kind")).when(F.col("offset") > 0, "post_followthrough").otherwise("lead_in")
    return r.join(rows.where(F.size("legal") >= 2).select(*in_sequence(), "turn"), [*in_sequence(), "turn"]).select("episode", "root", "turn", "offset", out.alias("kind"))


def primary_scenario(flags: Column) -> Column:
    """The first scenario whose flag is true; null without."""
    out = None
    for name, key in SCENARIOS.items():
        out = F.when(flag(flags, key), name) if out is None else out.when(flag(flags, key), name)
    return out


def moved() -> Column:
    """Tiles between the places before and after; columns wrap."""
    across = F.abs(F.col("column") - F.col("next_column"))
    return F.abs(F.col("row") - F.col("next_row")) + F.least(across, F.lit(COLUMNS) - across)


def summary(rows: DataFrame, status: Column) -> DataFrame:
    """All measures of an episode, of rows of LOG with W1 to W4 (metrics.analysed); status: an aggregate that tells how it ended.

    violations counts rows whose chosen counterfactual contradicts the outcome; it must be 0.
    """
    choice, junction, straight = F.col("choice"), F.size("legal") >= JUNCTION, F.array_contains("legal", F.col("heading"))
    lost = F.coalesce(F.col("outcome") == "life_lost", F.lit(False))
    ahead, open_end = F.coalesce(choice == F.col("heading"), F.lit(False)), F.col("outcome").isNull()
    skipped = junction & (collected() == 0) & F.exists(options(), lambda r: ~r["life_lost"] & (r["pellets"] > 0))
    unsafe, risky, avoidable = n(fatal(choice)), n(some_fatal()), n(mixed())
    deaths = n(lost & some_safe())
    per_life = rows.groupBy("episode", F.col("life").alias("_l")).agg(F.count(F.lit(1)).alias("decisions"), F.sum(collected()).alias("pellets_collected"), (n(lost) > 0).alias("life_lost"))
    lives = per_life.groupBy("episode").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col("_l").cast("string"), F.struct("decisions", "pellets_collected", "life_lost"))))).alias("per_life"))
    periods = rows.where("period IS NOT NULL").groupBy("episode", "period").agg(F.count(F.lit(1)).alias("c"))
    periods = periods.groupBy("episode").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("period", "c")))).alias("loop_periods"))
    out = rows.groupBy("episode").agg(
        F.first("level").alias("level"),
        F.first("seed").alias("seed"),
        F.count(F.lit(1)).alias("decisions"),
        F.max_by("score_after", "turn").alias("score"),
        F.max_by("pellets_after", "turn").alias("pellets_remaining"),
        F.sum("action_frames").alias("simulation_frames"),
        F.avg("http_ms").alias("mean_http_ms"),
        F.sum(collected()).alias("pellets_collected"),
        n(lost).alias("life_losses"),
        risky.alias("immediate_risk_decisions"),
        avoidable.alias("avoidable_risk_decisions"),
        n(~some_safe()).alias("all_immediate_actions_fatal"),
        unsafe.alias("unsafe_immediate_choices"),
        deaths.alias("avoidable_immediate_deaths"),
        n(straight).alias("straight_available"),
        n(straight & ahead).alias("straight_chosen"),
        n(straight & junction).alias("junction_straight_available"),
        n(straight & junction & ahead).alias("junction_straight_chosen"),
        n(skipped).alias("safe_immediate_pellet_skips_at_junction"),
        n(moved() == 0).alias("stationary_actions"),
        n(moved() > 1).alias("multi_tile_actions"),
        n((moved() == 0) & open_end).alias("nonterminal_stationary_actions"),
        n((moved() > 1) & open_end).alias("nonterminal_multi_tile_actions"),
        *[F.sum(c).alias(c) for c in ("normal_pellets", "power_pellets", "ghosts_eaten", "fruit_eaten")],
        F.max("dry_now").alias("longest_no_pellet_decisions"),
        F.max("dry_frames").alias("longest_no_pellet_frames"),
        F.count("period").alias("loop_decisions"),
        F.max("streak").alias("longest_loop_streak_decisions"),
        F.sum(F.when(F.col("life") == 0, collected()).otherwise(0)).alias("first_life_pellets"),
        F.sum(F.when(F.col("life") > 0, collected()).otherwise(0)).alias("post_respawn_pellets"),
        status.alias("outcome"),
        rate(unsafe, risky).alias("unsafe_immediate_choice_rate"),
        rate(deaths, avoidable).alias("avoidable_immediate_death_rate"),
        rate(n(straight & ahead), n(straight)).alias("straight_choice_rate"),
        n(fatal(choice) != lost).alias("violations"),
    )
    out = out.withColumns({"censored": F.col("outcome").isin(*CAPPED), "level_cleared": F.coalesce(F.col("outcome") == "level_cleared", F.lit(False))})
    empty = F.map_from_arrays(F.array().cast("array<bigint>"), F.array().cast("array<bigint>"))
    return out.join(lives, "episode").join(periods, "episode", "left").withColumn("loop_periods", F.coalesce("loop_periods", empty))


#: Gate and the limit that it must not pass.
GATES = {"longest_loop_streak_decisions": 7, "longest_no_pellet_decisions": 128, "nonterminal_multi_tile_actions": 0, "nonterminal_stationary_actions": 0, "avoidable_immediate_deaths": 0}
GATE_NAMES = ("sustained no-pellet cycle", "pellet stall", "incorrect multi-tile action", "incorrect stationary action", "avoidable immediate death")


def quality_gates() -> dict[str, Column]:
    """Six reasons for which an episode summary fails, for metrics.gate."""
    out = {name: F.col(c) > limit for name, (c, limit) in zip(GATE_NAMES, GATES.items(), strict=True)}
    return out | {"maze incomplete": ~F.col("level_cleared") | (F.col("pellets_remaining") != 0)}


def qualification(gated: DataFrame, expected: DataFrame, phase: str, errors: int = 0, min_games: int = 20, min_rate: float = 1.0, max_losses: int = 4, max_avoidable: int = 0) -> DataFrame:
    """One row, approved and failures (sorted): a suite of gated summaries against the expected (level, seed) pairs, each once."""
    have = gated.groupBy("level", "seed").agg(F.count(F.lit(1)).alias("c"))
    differ = expected.distinct().withColumn("_e", F.lit(1)).join(have, ["level", "seed"], "full").agg(n(F.col("_e").isNull() | F.col("c").isNull() | (F.col("c") != 1)).alias("differ"))
    levels = expected.select("level").distinct().join(gated.groupBy("level").agg(rate(n(F.col("level_cleared")), F.count(F.lit(1))).alias("r")), "level", "left")
    low = levels.agg(n(F.coalesce("r", F.lit(0.0)) < min_rate).alias("low"))
    total = gated.agg(F.count(F.lit(1)).alias("games"), F.sum("life_losses").alias("losses"), F.sum("avoidable_immediate_deaths").alias("deaths"), F.sum(F.size("failures")).alias("gate_failures"))
    reasons = {
        "native simulation errors": F.lit(errors > 0),
        "not a qualification run": F.lit(phase != "qualification"),
        "suite incomplete or duplicated": F.col("differ") > 0,
        "too few games": F.col("games") < min_games,
        "clear rate": F.col("low") > 0,
        "too many lives lost": F.coalesce(F.col("losses") > max_losses, F.lit(False)),
        "avoidable immediate deaths": F.coalesce(F.col("deaths") > max_avoidable, F.lit(False)),
        "episode gates": F.coalesce(F.col("gate_failures") > 0, F.lit(False)),
    }
    failures = F.array_compact(F.array(*[F.when(c, F.lit(k)) for k, c in reasons.items()]))
    out = differ.join(low).join(total)  # three one-row results
    return out.withColumn("failures", F.array_sort(failures)).withColumn("approved", F.size("failures") == 0)


def search_evaluation() -> dict[str, Column]:
    """How a choice stands to the searched moves (survival, then worth): tie_correct, lower_survival, and regret within one survival."""
    pair = lambda m: F.struct(F.element_at("survival", m).alias("s"), F.element_at("worth", m).alias("v"))
    best = F.array_max(F.transform(F.map_keys("survival"), pair))
    own = pair(F.col("choice"))
    return {
        "tie_correct": own == best,
        "lower_survival": own["s"] < best["s"],
        "regret": F.when(own["s"] == best["s"], F.greatest(best["v"] - own["v"], F.lit(0))),
    }


def resume_position(count: Column, old_batch: Column, old_accum: Column, new_batch: Column, new_accum: Column, at: Column) -> Column:
    """struct(position, problem): where a run that stood at micro-batch at goes on with another batch size; one of both is null.

    The effective batch must stay the same, at must be a whole step (or the end of the data), and no record may be
    repeated or left out.
    """
    steps = F.ceil(count / old_batch)
    offset = F.least(at * old_batch, count)
    problem = (
        F.when((old_batch < 1) | (old_accum < 1) | (new_batch < 1) | (new_accum < 1), "not positive")
        .when(old_batch * old_accum != new_batch * new_accum, "effective batch differs")
        .when((at < 0) | (at > steps) | ((at != steps) & (at % old_accum != 0)), "no optimizer boundary")
        .when((offset < count) & (offset % new_batch != 0), "records repeated or skipped")
    )
    return F.struct(F.when(problem.isNull(), F.ceil(offset / new_batch)).alias("position"), problem.alias("problem"))
