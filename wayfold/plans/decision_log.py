"""A decision log (operators.decisions.LOG) that the event table stands for, as a DataFrame and as SQL.

Users are episodes, errors lost lives, purchases food. What events do not have is derived from event_id by
arithmetic that both dialects read alike; STEPS hold it once. The DataFrame has maps and arrays, the SQL flat columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wayfold.operators import trajectory as T
from wayfold.plans.base import FACTS, Tables, facts

MOVES = ("up", "down", "left", "right")


def drawn(c: int) -> str:
    """A number from 0 to 65536 of an event, another for every c."""
    return f"(((event_id * {7919 + 2 * c} + {c * 104729 + 17}) % 1000003) * 31 % 65537)"


def _policy(c: int) -> str:
    return f"CASE WHEN legal_up AND {drawn(c)} % 3 = 0 THEN 'up' WHEN legal_left AND {drawn(c + 1)} % 2 = 0 THEN 'left' WHEN legal_down AND {drawn(c + 2)} % 3 = 0 THEN 'down' ELSE 'right' END"


_BEFORE = "(PARTITION BY episode ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
#: Columns by step; a step may use those of steps before.
STEPS = [
    {
        "legal_up": f"{drawn(1)} % 4 < 3",
        "legal_down": f"{drawn(2)} % 2 = 0",
        "legal_left": f"{drawn(3)} % 3 < 2",
        "legal_right": "event_id >= 0",
        "heading": f"CASE {drawn(10)} % 4 WHEN 0 THEN 'up' WHEN 1 THEN 'down' WHEN 2 THEN 'left' ELSE 'right' END",
        "wanted": f"CASE WHEN progress THEN 1 + {drawn(11)} % 2 ELSE 0 END",
        "action_frames": "4 + frames % 40",
        "level": "1 + episode % 3",
        "seed": "episode",
        "d_a": f"1 + {drawn(40)} % 12",
        "d_b": f"1 + {drawn(41)} % 12",
        "scared_a": f"{drawn(42)} % 3 = 0",
        "scared_b": f"{drawn(43)} % 3 = 0",
        "out_a": f"{drawn(44)} % 5 < 4",
        "out_b": f"{drawn(45)} % 5 < 4",
        "visits": f"{drawn(47)} % 7",
        "near_power": f"{drawn(48)} % 9 = 0",
        "row_": "length(pos) % 3",
        "column_": "length(pos) * 3 % 28",
        "origin": f"CASE WHEN {drawn(12)} % 3 = 0 THEN 'learner_visited' ELSE 'expert' END",
        "http_ms": f"({drawn(14)} % 1000) * 0.5e0",
        "power_pellets": f"CASE WHEN {drawn(51)} % 10 = 0 THEN 1 ELSE 0 END",
        "ghosts_eaten": f"{drawn(52)} % 8 % 3",
        "fruit_eaten": f"CASE WHEN {drawn(53)} % 20 = 0 THEN 1 ELSE 0 END",
        **{f"surv_{m}": f"{drawn(60 + i)} % 3" for i, m in enumerate(MOVES)},
        **{f"worth_{m}": f"{drawn(65 + i)} % 5" for i, m in enumerate(MOVES)},
        **{f"weight_{m}": f"1 + {drawn(70 + i)} % 9" for i, m in enumerate(MOVES)},
        **{f"frames_{m}": f"4 + {drawn(25 + i)} % 20" for i, m in enumerate(MOVES)},
    },
    {
        "choice": _policy(4),
        "gold": _policy(7),
        "frightened": "scared_a OR scared_b",
        "next_row": f"row_ + {drawn(54)} % 3 - 1",
        "next_column": f"(column_ + {drawn(55)} % 3 + 27) % 28",
        "lost_before": f"coalesce(sum(CASE WHEN lost THEN 1 ELSE 0 END) OVER {_BEFORE}, 0)",
        "eaten_before": f"coalesce(sum(wanted) OVER {_BEFORE}, 0)",
        "score_after": f"coalesce(sum(wanted) OVER {_BEFORE}, 0) * 10 + wanted * 10",
    },
    {
        "life": "lost_before",
        "lives": "greatest(3 - lost_before, 0)",
        "pellets_before": "greatest(25 + episode % 20 - eaten_before, 0)",
        "pellets_after": "greatest(25 + episode % 20 - eaten_before - wanted, 0)",
        "power": f"CASE WHEN frightened THEN 1 + {drawn(46)} % 150 ELSE 0 END",
        "learner_choice": f"CASE WHEN {drawn(13)} % 4 = 0 THEN NULL ELSE choice END",
    },
    {
        "got": "pellets_before - pellets_after",
        "power_after": "greatest(power - action_frames, 0)",
        "outcome": "CASE WHEN lost THEN 'life_lost' WHEN pellets_after = 0 AND pellets_before > 0 THEN 'level_cleared' END",
        **{f"fatal_{m}": f"CASE WHEN choice = '{m}' THEN lost ELSE {drawn(20 + i)} % 5 = 0 END" for i, m in enumerate(MOVES)},
    },
    {f"food_{m}": f"CASE WHEN choice = '{m}' THEN got ELSE {drawn(30 + i)} % 3 END" for i, m in enumerate(MOVES)},
]


def log(t: Tables) -> DataFrame:
    """The decision log with maps and arrays."""
    rows = facts(t)
    for step in STEPS:
        rows = rows.selectExpr("*", *[f"{e} AS {name}" for name, e in step.items()])
    legal = F.array_compact(F.array(*[F.when(F.col(f"legal_{m}"), F.lit(m)) for m in MOVES]))

    def per_move(value) -> F.Column:
        return F.map_filter(F.map_from_arrays(F.array(*map(F.lit, MOVES)), F.array(*[value(m) for m in MOVES])), lambda k, v: F.array_contains("legal", k))

    ghost = lambda g: F.struct(F.lit(g).alias("name"), F.col(f"out_{g}").alias("outside"), F.col(f"scared_{g}").alias("frightened"), F.col(f"d_{g}").alias("d"))
    rows = rows.withColumns({"legal": legal, "ghosts": F.array(ghost("a"), ghost("b")), "normal_pellets": F.col("got")})
    whole = sum((F.when(F.col(f"legal_{m}"), F.col(f"weight_{m}")).otherwise(0) for m in MOVES[1:]), F.when(F.col("legal_up"), F.col("weight_up")).otherwise(0))
    rows = rows.withColumns({
        "risks": per_move(lambda m: F.struct(F.col(f"fatal_{m}").alias("life_lost"), F.col(f"food_{m}").alias("pellets"), F.col(f"frames_{m}").alias("frames"))),
        "survival": per_move(lambda m: F.col(f"surv_{m}")),
        "worth": per_move(lambda m: F.col(f"worth_{m}")),
        "probabilities": per_move(lambda m: F.col(f"weight_{m}").cast("double") / whole.cast("double")),
    })
    flat = [f"{a}_{m}" for a in ("surv", "worth", "weight", "frames", "fatal", "food", "legal") for m in MOVES] + [f"{a}_{g}" for a in ("d", "out", "scared") for g in "ab"]
    rows = rows.drop(*flat, "wanted", "lost_before", "eaten_before").withColumnsRenamed({"row_": "row", "column_": "column"})
    # sequence columns: dry spells, cycles and streaks of the log's own food and frames
    rows = rows.withColumns({"progress": F.col("got") > 0, "frames": F.col("action_frames")}).withColumn("pos", F.struct("row", "column"))
    rows = T.with_streaks(T.with_cycles(T.with_dry_spells(rows)), F.col("period").isNotNull())
    in_life = Window.partitionBy("episode", "life").orderBy("turn")
    rows = rows.withColumnRenamed("dry", "dry_now").withColumn("dry", F.coalesce(F.lag("dry_now").over(in_life), F.lit(0)))
    return T.with_runs(rows).drop("run_place", "ahead", "spell", "got")


def _sql() -> str:
    out, last = FACTS, "f"
    for i, step in enumerate(STEPS):
        out += f",\ns{i} AS (SELECT *, {', '.join(f'{e} AS {name}' for name, e in step.items())} FROM {last})"
        last = f"s{i}"
    any_of = lambda e, join: "(" + join.join(f"(legal_{m} AND {e.format(m=m)})" for m in MOVES) + ")"
    pick = lambda c, of: f"CASE {of} " + " ".join(f"WHEN '{m}' THEN {c}_{m}" for m in MOVES) + " END"
    near = lambda cond: f"least(CASE WHEN {cond.format(g='a')} THEN d_a ELSE 999 END, CASE WHEN {cond.format(g='b')} THEN d_b ELSE 999 END)"
    return out + f""",
g0 AS (SELECT * EXCLUDE (progress, frames, pos), got > 0 AS progress, action_frames AS frames, row_ * 100 + column_ AS pos FROM {last}),
g1 AS (SELECT *, sum(progress::INT) OVER (PARTITION BY episode, life ORDER BY turn) AS spell FROM g0),
g2 AS (SELECT *, CASE WHEN progress THEN 0 ELSE count(*) OVER w END AS dry_now, (CASE WHEN progress THEN 0 ELSE sum(frames) OVER w END)::BIGINT AS dry_frames,
         list(pos) OVER (PARTITION BY episode, life, spell, progress ORDER BY turn ROWS BETWEEN 127 PRECEDING AND CURRENT ROW) AS h FROM g1 WINDOW w AS (PARTITION BY episode, life, spell, progress ORDER BY turn)),
g3 AS (SELECT * EXCLUDE (h), CASE WHEN NOT progress AND len(h) >= 4 THEN list_filter(range(2, least(64, len(h) // 2) + 1),
         lambda p: h[len(h) - p + 1:len(h)] = h[len(h) - 2 * p + 1:len(h) - p] AND len(list_distinct(h[len(h) - p + 1:len(h)])) >= 2)[1] END AS period FROM g2),
g4 AS (SELECT *, sum((period IS NULL)::INT) OVER (PARTITION BY episode ORDER BY turn) AS off FROM g3),
dl AS (
  SELECT * EXCLUDE (off), CASE WHEN period IS NOT NULL THEN count(*) OVER (PARTITION BY episode, off, period IS NOT NULL ORDER BY turn) ELSE 0 END AS streak,
    coalesce(lag(dry_now) OVER (PARTITION BY episode, life ORDER BY turn), 0) AS dry,
    legal_up::INT + legal_down::INT + legal_left::INT + legal_right::INT AS n_legal,
    {any_of('fatal_{m}', ' OR ')} AS some_fatal, {any_of('NOT fatal_{m}', ' OR ')} AS some_safe,
    {any_of('NOT fatal_{m} AND food_{m} > 0', ' OR ')} AS some_safe_food,
    {pick('fatal', 'choice')} AS choice_fatal, {pick('food', 'choice')} AS choice_food, {pick('fatal', 'gold')} AS gold_fatal, {pick('food', 'gold')} AS gold_food,
    {near('out_{g} AND NOT scared_{g}')} AS danger, {near('out_{g}')} AS any_near, {near('out_{g} AND scared_{g}')} AS scared_near,
    greatest({', '.join(f'CASE WHEN legal_{m} THEN frames_{m} ELSE 0 END' for m in MOVES)}) AS longest_frames,
    CASE heading WHEN 'up' THEN 'down' WHEN 'down' THEN 'up' WHEN 'left' THEN 'right' ELSE 'left' END AS backwards,
    {pick('legal', 'heading')} AS heading_legal
  FROM g4)"""


#: Common table expressions up to dl, the flat decision log.
DECISIONS = _sql()
