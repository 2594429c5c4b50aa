"""A whole dataset from a decision log: pool, quarantine, budgets, roots and windows, replay, contract; in committed stages.

The build of the offline dataset: targeted roots and windows near them within shared family caps, floors of rare
flags, earlier rows for replay, and the contract over the result, whose faults fail the build. Budgets are those of the contract,
scaled down together where the log cannot meet them (a share `slack` of what is there), never filled with easier rows.
"""

from __future__ import annotations

import uuid
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wayfold.functions import canon
from wayfold.functions.flags import flag
from wayfold.operators import datasets as DS
from wayfold.operators import decisions as D
from wayfold.operators import metrics as M
from wayfold.operators import pools as Q
from wayfold.operators import selection as S
from wayfold.operators.ranking import seeded
from wayfold.operators.stages import Build, Stage
from wayfold.operators.windows import offset_windows
from wayfold.plans.base import Tables, query
from wayfold.plans.decision_log import log
from wayfold.sources.shared import shared_dir

_OFFLINE = DS.CONTRACTS["offline"]
# The window offsets around a root, in the order in which they are taken.
OFFSETS = (2, 4, 8, 16, 24, -1, -4, -8)

#: Of the contract's floors those whose flag occurs in the log at hand (no dry spell in it reaches the limit of food_dry).
CONFIG = {
    "budgets": {k: list(v) for k, v in _OFFLINE.budgets.items()},
    "floors": {k: list(v) for k, v in _OFFLINE.floors.items() if k != "food_dry"},
    "family_cap": _OFFLINE.family_cap,
    "per_root": _OFFLINE.per_root,
    "offsets": list(OFFSETS),
    "slack": 0.4,
    "seed": "offline-1",
}


def decision_pool(config: Mapping, decisions: DataFrame) -> DataFrame:
    """Records of all decisions. split goes by family, so no family is in two; the digest is that of the state."""
    state = [F.col(c).cast("string") for c in ("row", "column", "heading", "dry", "pellets_before", "power")] + [F.array_join(F.array_sort("legal"), ",")]
    family = F.expr("episode div 2")
    flags = D.offline_cohorts()
    safe = F.col("legal").isNotNull() & (F.size("legal") >= 2) & ~D.fatal(F.col("choice"))
    return decisions.select(
        F.col("event_id").cast("string").alias("id"),
        F.when(family % 4 == 0, "development").otherwise("train").alias("split"),
        family.cast("string").alias("family"),
        "episode", "turn", "life",
        canon.fingerprint(*state).alias("digest"),
        F.col("choice").alias("label"),
        F.col("legal").alias("options"),
        F.col("origin").alias("origin"),
        F.element_at("worth", F.col("choice")).cast("long").alias("priority"),
        F.map_filter(flags, lambda k, v: v).alias("flags"),
        D.targeted(flags).alias("targeted"),
        safe.alias("safe"),
    )


def clean_pool(config: Mapping, pool: DataFrame) -> DataFrame:
    """One record a digest, of digests that are of one split and one label only."""
    return S.one_per_digest(Q.quarantine(pool, "digest", "split", "label"), config["seed"])


def scaled_budgets(config: Mapping, clean: DataFrame) -> DataFrame:
    """split, kind (class or floor), name, need: the contract's numbers at the scale that the pool allows."""
    roots = clean.where("targeted")
    target, near = (config["budgets"][k] for k in ("targeted", "informative"))
    cap = [config["family_cap"] * t // max(1, t + n) for t, n in zip(target, near, strict=True)]
    per = roots.groupBy("split", "family").agg(F.count(F.lit(1)).alias("n"))
    room = per.groupBy("split").agg(F.sum(F.least("n", F.when(F.col("split") == DS.SPLITS[0], cap[0]).otherwise(cap[1]))).alias("n"))
    have = {(r["split"], "targeted"): r["n"] for r in room.collect()}  # a row a split
    flagged = roots.groupBy("split").agg(*[M.n(flag(F.col("flags"), f)).alias(f) for f in config["floors"]]).collect()
    have |= {(r["split"], f): r[f] for r in flagged for f in config["floors"]}
    have |= {(r["split"], "replay"): r["n"] for r in clean.where("safe").groupBy("split").agg(F.count(F.lit(1)).alias("n")).collect()}
    asked = [(s, k, v[i]) for i, s in enumerate(DS.SPLITS) for k, v in [("targeted", target), ("replay", config["budgets"]["replay"]), *config["floors"].items()] if v[i]]
    scale = min([1.0, *[config["slack"] * have.get((s, k), 0) / n for s, k, n in asked]])
    rows = []
    for i, s in enumerate(DS.SPLITS):
        part = {k: int(v[i] * scale) for k, v in config["budgets"].items()}
        part["targeted"] = max(part["targeted"], 3 * part["informative"])
        rows += [(s, "class", k, n) for k, n in part.items()] + [(s, "floor", k, int(v[i] * scale)) for k, v in config["floors"].items()]
    return clean.sparkSession.createDataFrame(rows, "split string, kind string, name string, need long")


def _need(budgets: DataFrame) -> dict[tuple[str, str, str], int]:
    return {(r["split"], r["kind"], r["name"]): r["need"] for r in budgets.collect()}  # two splits of a dozen names


def near_windows(config: Mapping, pool: DataFrame, clean: DataFrame) -> DataFrame:
    """id (row@root), digest, family, root, place: clean rows at the offsets from targeted roots, in the same life and run."""
    roots = clean.where("targeted").select("episode", "turn", F.col("id").alias("root"), "family", "split")
    met = offset_windows(roots, pool, config["offsets"], ("id",))
    met = met.join(clean.select("id", "digest"), "id").join(roots.withColumnRenamed("turn", "root_turn"), ["episode", "root_turn"])
    place = F.array_position(F.array(*map(F.lit, config["offsets"])), F.col("offset").cast("int")).cast("int")
    return met.select(F.concat_ws("@", "id", "root").alias("id"), F.col("id").alias("row"), "digest", "family", "root", "split", place.alias("place"))


def chosen_rows(config: Mapping, clean: DataFrame, windows: DataFrame, budgets: DataFrame) -> DataFrame:
    """id, class, parent: roots that meet the floors and fill families in turn, then windows of each root in turn."""
    spark, need = clean.sparkSession, _need(budgets)
    parts = []
    for s in DS.SPLITS:
        floors = {k: n for (split, kind, k), n in need.items() if split == s and kind == "floor" and n}
        budget = (need[s, "class", "targeted"], need[s, "class", "informative"])
        mine = clean.where((F.col("split") == s) & F.col("targeted"))
        roots, near = S.select_targeted(mine, windows.where(F.col("split") == s), budget, floors, config["family_cap"], config["per_root"], config["seed"])
        parts += [(i, "targeted", None) for i in roots] + [(w.split("@")[0], "informative", w.split("@")[1]) for w in near]
    return spark.createDataFrame(parts, "id string, class string, parent string")  # as many as the budget


def replay_rows(config: Mapping, clean: DataFrame, chosen: DataFrame, budgets: DataFrame) -> DataFrame:
    """id, class, parent: safe rows that nothing else took, in seeded order, within what the chosen rows leave of a family's cap."""
    need, parts = _need(budgets), []
    taken = clean.join(chosen.select("id"), "id", "left_semi").groupBy("family").agg(F.count(F.lit(1)).alias("taken"))
    rest = clean.where("safe").join(chosen.select("id"), "id", "left_anti").withColumn("k", seeded(config["seed"] + "/replay", "id"))
    place = F.row_number().over(Window.partitionBy("family").orderBy("k", "id"))
    open_ = rest.withColumn("_p", place).join(taken, "family", "left").where(F.col("_p") + F.coalesce("taken", F.lit(0)) <= config["family_cap"])
    for s in DS.SPLITS:
        if n := need[s, "class", "replay"]:
            part = open_.where(F.col("split") == s).orderBy("k", "id").limit(n)
            parts.append(part.select("id", F.lit("replay").alias("class"), F.lit(None).cast("string").alias("parent")))
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1]) if parts else chosen.limit(0)


def dataset(config: Mapping, clean: DataFrame, chosen: DataFrame, replay: DataFrame) -> DataFrame:
    records = clean.select("id", "split", "origin", "family", "episode", "turn", "digest", "label", "options", "flags")
    return records.join(chosen.unionByName(replay), "id").withColumn("role", F.lit(None).cast("string"))


def faults(config: Mapping, rows: DataFrame, budgets: DataFrame) -> DataFrame:
    """Departures from the contract at the scale of the budgets."""
    need = _need(budgets)
    pair = lambda kind, k: tuple(need[s, kind, k] for s in DS.SPLITS)
    held = DS.Contract({k: pair("class", k) for k in config["budgets"]}, {k: pair("floor", k) for k in config["floors"]}, family_cap=config["family_cap"], per_root=config["per_root"], parents=_OFFLINE.parents)
    found = DS.violations(rows, held)
    # a budget of no rows is met by no rows
    return found.where("NOT (check IN ('budget', 'floor') AND detail = '0/0')")


STAGES = (
    Stage("pool", ("decisions",), decision_pool),
    Stage("clean", ("pool",), clean_pool, ("seed",)),
    Stage("budgets", ("clean",), scaled_budgets, ("budgets", "floors", "family_cap", "slack")),
    Stage("windows", ("pool", "clean"), near_windows, ("offsets",)),
    Stage("chosen", ("clean", "windows", "budgets"), chosen_rows, ("family_cap", "per_root", "seed")),
    Stage("replay", ("clean", "chosen", "budgets"), replay_rows, ("family_cap", "seed")),
    Stage("dataset", ("clean", "chosen", "replay"), dataset),
    Stage("faults", ("dataset", "budgets"), faults, ("budgets", "floors", "family_cap", "per_root"), must_be_empty=True),
)


def offline_build(spark: SparkSession, folder: str, decisions: DataFrame, config: Mapping = CONFIG) -> Build:
    """The build over a folder; run() does what is not committed yet."""
    return Build(spark, folder, config, {"decisions": decisions}, STAGES)


def _decisions(t: Tables) -> DataFrame:
    return log(t).select("event_id", "episode", "turn", "life", "row", "column", "heading", "dry", "pellets_before", "power", "power_after", "frightened", "legal", "choice", "risks", "ghosts", "worth", "origin")


@query("dataset_build")
def dataset_build(t: Tables) -> DataFrame:
    """The offline dataset of the whole log; its selection depends on all choices before, so tests hold it against plain loops."""
    folder = f"{shared_dir(t.spark)}/build-{uuid.uuid4().hex}"
    out = offline_build(t.spark, folder, _decisions(t)).run()
    return out["dataset"].select("split", "class", "id", "parent", "family", "digest", "label")
