"""Contracts of the four selected datasets: budgets, origins, floors, roles, caps, parents and disjoint splits.

Records have id, split, class, origin, family, episode, digest, label, options (array), parent (id of a root or
null), role and flags (map). Each check gives rows (check, key, detail); a dataset that keeps its contract gives none.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wayfold.functions.prob import valid
from wayfold.operators.contracts import row_checks

SPLITS = ("train", "development")


@dataclass(frozen=True)
class Contract:
    """What a dataset must hold; pairs are for the two SPLITS."""

    budgets: Mapping[str, tuple[int, int]]  # rows of each class
    floors: Mapping[str, tuple[int, int]] = field(default_factory=dict)  # rows of the first class with a flag, at least
    roles: Mapping[str, tuple[int, int]] = field(default_factory=dict)  # rows of the first class with a role, exactly
    family_cap: int | None = None
    episode_cap: int | None = None  # rows of the first class of an episode
    per_root: int | None = None  # rows that share a parent
    mix: tuple[str, float] | None = None  # origin and its share of each class, rounded half to even
    parents: tuple[str, str] | None = None  # class whose rows need a parent, and the class of the parent


# The budgets, floors, roles and caps of the four datasets.
CONTRACTS = {
    "learner": Contract(
        {"fresh": (2048, 256), "old": (2048, 256)},
        {"learner_visited": (128, 32), "learner_disagreement": (64, 16), "immediate_survival_critical": (512, 64), "critical_reverse": (256, 32), "post_respawn": (512, 64), "stalled_current": (128, 16), "power_expiry": (128, 16), "level_1": (256, 64), "level_2": (256, 64), "level_3": (256, 64)},
        episode_cap=24,
    ),
    "hard": Contract(
        {"hard": (3660, 384), "informative": (1220, 128), "replay": (912, 0)},
        {"ghost_intercept": (300, 48), "power_expiry": (120, 16), "food_dry": (180, 24), "sparse_food": (180, 24), "post_respawn": (120, 16), "anticipatory_harm": (300, 48), "expiry_during_action_with_near_ghost": (24, 4)},
        family_cap=128, mix=("off_policy", 0.6), parents=("informative", "hard"),
    ),
    "offline": Contract(
        {"targeted": (3660, 384), "informative": (1220, 128), "replay": (912, 0)},
        {"ghost_intercept": (300, 48), "power_expiry": (120, 16), "food_dry": (180, 24), "sparse_food": (180, 24), "post_respawn": (120, 16), "potential_expiry_during_action_near_ghost": (24, 4)},
        family_cap=128, per_root=4, parents=("informative", "targeted"),
    ),
    "balanced": Contract(
        {"targeted": (3660, 384), "informative": (1220, 128), "replay": (912, 0)},
        {"immediate_critical": (512, 64)},
        {"immediate_evasion": (640, 96), "anticipatory_escape": (64, 16), "actual_expiry_evasion": (16, 4), "retreat_to_food": (512, 48), "productive_routing": (1408, 128), "cleanup": (888, 78), "broad_exposure": (132, 14)},
        family_cap=128, per_root=4, parents=("informative", "targeted"),
    ),
}


def violations(df: DataFrame, contract: Contract) -> DataFrame:
    """check, key, detail of everything in which df departs from contract."""
    spark, first = df.sparkSession, next(iter(contract.budgets))
    roots = df.where(F.col("class") == first)
    out = []

    def add(found: DataFrame, check: str, key, detail) -> None:
        out.append(found.select(F.lit(check).alias("check"), key.cast("string").alias("key"), detail.cast("string").alias("detail")))

    def counted(check: str, wanted: Mapping[str, tuple[int, int]], have: DataFrame, exact: bool) -> None:
        """have: split, name, n. Names that nobody asked for are violations of an exact contract."""
        need = spark.createDataFrame([(s, k, v[i]) for k, v in wanted.items() for i, s in enumerate(SPLITS)], "split string, name string, need long")
        both = need.join(have, ["split", "name"], "full" if exact else "left").withColumns({"n": F.coalesce("n", F.lit(0)), "need": F.coalesce("need", F.lit(0))})
        bad = both.where(F.col("n") != F.col("need") if exact else F.col("n") < F.col("need"))
        add(bad, check, F.concat_ws("/", "split", "name"), F.concat_ws("/", "n", "need"))

    def over(check: str, rows: DataFrame, key: str, cap: int) -> None:
        add(rows.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > cap), check, F.col(key), F.col("n"))

    per = lambda rows, key, name: rows.groupBy("split", F.col(key).alias("name")).agg(F.count(F.lit(1)).alias(name))
    digests = df.groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("split").alias("s"))
    add(digests.where("n > 1"), "repeated digest", F.col("digest"), F.col("n"))
    add(digests.where("s > 1"), "digest in two splits", F.col("digest"), F.col("s"))
    families = df.groupBy("family").agg(F.count_distinct("split").alias("s")).where("s > 1")
    add(families, "family in two splits", F.col("family"), F.col("s"))
    add(df.where(~F.coalesce(F.array_contains("options", F.col("label")), F.lit(False))), "illegal label", F.col("id"), F.coalesce("label", F.lit("null")))
    counted("budget", contract.budgets, per(df, "class", "n"), True)
    if contract.floors:
        named = roots.select("split", F.explode(F.map_keys(F.map_filter("flags", lambda k, v: F.coalesce(v, F.lit(False))))).alias("flag"))
        counted("floor", contract.floors, per(named, "flag", "n"), False)
    if contract.roles:
        counted("role", contract.roles, per(roots.where("role IS NOT NULL"), "role", "n"), True)
    if contract.family_cap is not None:
        over("family cap", df, "family", contract.family_cap)
    if contract.episode_cap is not None:
        over("episode cap", roots, "episode", contract.episode_cap)
    if contract.per_root is not None:
        over("windows of a root", df.where("parent IS NOT NULL"), "parent", contract.per_root)
    if contract.mix:
        origin, share = contract.mix
        mixed = df.where(F.col("class").isin(*list(contract.budgets)[:2])).groupBy("split", "class").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("origin") == origin).alias("of"))
        need = F.bround(F.col("n") * share).cast("long")
        add(mixed.where(F.col("of") != need), "origin", F.concat_ws("/", "split", "class"), F.concat_ws("/", "of", need))
    if contract.parents:
        child, parent = contract.parents
        p = df.select(F.col("id").alias("parent"), F.col("class").alias("_c"), F.col("episode").alias("_e"), F.col("split").alias("_s"))
        met = df.where(F.col("class") == child).join(p, "parent", "left")
        ok = (F.col("_c") == parent) & (F.col("_e") == F.col("episode")) & (F.col("_s") == F.col("split"))
        add(met.where(~F.coalesce(ok, F.lit(False))), "parent", F.col("id"), F.coalesce(F.col("parent").cast("string"), F.lit("null")))
    all_ = out[0]
    for part in out[1:]:
        all_ = all_.unionAll(part)
    return all_


#: Roles of a plan that must not be empty, the share that broad exposure may have, and the floor of evasions per split.
NEEDED, BROAD_SHARE, EVASIONS = ("anticipatory_escape", "actual_expiry_evasion", "retreat_to_food", "productive_routing", "cleanup"), 0.15, (512, 64)


def plan_problems(plan: Mapping[str, Mapping[str, int]], contract: Contract = CONTRACTS["balanced"]) -> list[str]:
    """What is wrong with a plan of roles per split; an empty list if nothing."""
    out, total = [], next(iter(contract.budgets.values()))
    for i, split in enumerate(SPLITS):
        quota = plan.get(split)
        if quota is None or set(quota) != set(contract.roles) or any(isinstance(n, bool) or not isinstance(n, int) or n < 0 for n in quota.values()):
            out.append(f"{split}: roles are not those of the contract, with numbers from 0")
            continue
        if sum(quota.values()) != total[i]:
            out.append(f"{split}: {sum(quota.values())} of {total[i]}")
        if quota["broad_exposure"] > int(BROAD_SHARE * total[i]):
            out.append(f"{split}: too much broad exposure")
        if quota["immediate_evasion"] < EVASIONS[i]:
            out.append(f"{split}: too few evasions")
        out += [f"{split}: no {role}" for role in NEEDED if not quota[role]]
    return out


def harvest_problems(roots: int, perturbed: int, turns: int) -> list[str]:
    """What is wrong with harvest limits; an empty list if nothing."""
    whole = lambda x, least: isinstance(x, int) and not isinstance(x, bool) and x >= least
    out = [name for name, x, least in (("roots", roots, 1), ("perturbed", perturbed, 0), ("turns", turns, 1)) if not whole(x, least)]
    if not out and (perturbed > roots or turns > 16):
        out.append("perturbed roots are at most the roots, turns at most 16")
    return out


def proof_problems(proofs: DataFrame, key: str, digest, flags) -> DataFrame:
    """check, key, detail: proofs (columns of decisions.LOG) whose stored values are not those recomputed from their state.

    Stored: digest, cohorts (map), power_before, frames_taken; digest and flags are the recomputed columns.
    """
    named = F.map_keys(F.map_filter("cohorts", lambda k, v: F.coalesce(v, F.lit(False))))
    true = F.map_keys(F.map_filter(flags, lambda k, v: v))
    checks = {
        "digest": F.col("digest") == digest,
        "cohorts": F.array_sort(named) == F.array_sort(true),
        "power": F.col("power_before") == F.col("power"),
        "frames": F.col("frames_taken") == F.col("action_frames"),
        "choice": F.array_contains("legal", F.col("choice")),
        "risks": F.array_sort(F.map_keys("risks")) == F.array_sort("legal"),
        "fatal choice": ~F.try_element_at("risks", F.col("choice"))["life_lost"],
    }
    return row_checks(proofs, key, checks)


def trace_problems(trace: DataFrame, key: str) -> DataFrame:
    """check, key, detail: rows of a trace (episode, turn, identity, probabilities, legal, choice) with another identity than their episode's first, or no valid distribution."""
    first = F.first("identity").over(Window.partitionBy("episode").orderBy("turn"))
    checked = trace.withColumn("_first", first)
    return row_checks(checked, key, {"identity": F.col("identity").eqNullSafe(F.col("_first")), "distribution": valid(F.col("probabilities"), F.col("legal"), F.col("choice"))})
