"""Sequence queries over the event log."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfold.operators import metrics as M
from wayfold.operators import ranking as R
from wayfold.operators import trajectory as T
from wayfold.operators import windows as W
from wayfold.operators.compare import first_difference, rebased
from wayfold.plans.base import DRY, FACTS, LIVES, WALK, Tables, facts, lived, query, walked

SUMMARY = """SELECT episode, count(*) AS decisions, sum(frames)::BIGINT AS frames, count(*) FILTER (lost) AS life_losses, count(*) FILTER (progress) AS progress_events,
  count(*) FILTER (progress AND life = 0) AS first_life_progress, count(*) FILTER (progress AND life > 0) AS post_respawn_progress,
  max(dry) AS longest_dry, max(dry_frames) AS longest_dry_frames, count(period) AS loop_decisions, max(streak) AS longest_loop_streak,
  (count(*) FILTER (progress) * 1000)::DOUBLE / nullif(sum(frames), 0)::DOUBLE AS progress_per_1000_frames, count(period)::DOUBLE / count(*) AS loop_share
  FROM a GROUP BY episode"""


@query("episode_summary", f"WITH {WALK} {SUMMARY}")
def episode_summary(t: Tables) -> DataFrame:
    return M.episode_summary(walked(t))


@query("life_segments", f"WITH {LIVES} SELECT episode, turn, life FROM l")
def life_segments(t: Tables) -> DataFrame:
    return lived(t).select("episode", "turn", "life")


@query("dry_spells", f"WITH {DRY} SELECT episode, turn, dry, dry_frames FROM d")
def dry_spells(t: Tables) -> DataFrame:
    return T.with_dry_spells(lived(t)).select("episode", "turn", "dry", "dry_frames")


@query("cycle_rows", f"WITH {WALK} SELECT episode, turn, period, streak FROM a WHERE period IS NOT NULL")
def cycle_rows(t: Tables) -> DataFrame:
    return walked(t).where("period IS NOT NULL").select("episode", "turn", "period", "streak")


@query("loop_streaks", f"WITH {WALK} SELECT episode, max(streak) AS longest, count(*) FILTER (streak = 1) AS streaks FROM a GROUP BY episode")
def loop_streaks(t: Tables) -> DataFrame:
    return walked(t).groupBy("episode").agg(F.max("streak").alias("longest"), F.count_if(F.col("streak") == 1).alias("streaks"))


@query("per_life", f"WITH {LIVES} SELECT episode, life, count(*) AS decisions, count(*) FILTER (progress) AS progress_events, bool_or(lost) AS life_lost FROM l GROUP BY episode, life")
def per_life(t: Tables) -> DataFrame:
    return M.per_life(lived(t))


@query("loop_periods", f"WITH {WALK} SELECT episode, period, count(*) AS rows FROM a WHERE period IS NOT NULL GROUP BY episode, period")
def loop_periods(t: Tables) -> DataFrame:
    return M.loop_periods(walked(t))


@query(
    "watchdog_cut",
    f"""WITH {DRY}, s AS (SELECT *, sum(frames) OVER (PARTITION BY episode ORDER BY turn) >= 600000 OR dry >= 10 AS hit FROM d),
    h AS (SELECT *, coalesce(sum(hit::INT) OVER (PARTITION BY episode ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS hits FROM s)
    SELECT episode, count(*) AS kept, max(turn) AS last_turn FROM h WHERE hits = 0 GROUP BY episode""",
)
def watchdog_cut(t: Tables) -> DataFrame:
    return T.capped(T.with_dry_spells(lived(t)), 600_000, 10).groupBy("episode").agg(F.count(F.lit(1)).alias("kept"), F.max("turn").alias("last_turn"))


@query("recent_history", f"WITH {FACTS} SELECT episode, turn, array_to_string(list(pos) OVER (PARTITION BY episode ORDER BY turn ROWS BETWEEN 11 PRECEDING AND CURRENT ROW), '>') AS recent FROM f")
def recent_history(t: Tables) -> DataFrame:
    return T.with_history(facts(t), 12).select("episode", "turn", F.array_join("recent", ">").alias("recent"))


@query(
    "position_repeats",
    f"""WITH {FACTS}, h AS (SELECT *, list(pos) OVER (PARTITION BY episode ORDER BY turn ROWS BETWEEN 12 PRECEDING AND 1 PRECEDING) AS before FROM f)
    SELECT episode, turn, coalesce(list_contains(before, pos), false) AS seen_recently, count(*) OVER (PARTITION BY episode, pos ORDER BY turn) AS visits FROM h""",
)
def position_repeats(t: Tables) -> DataFrame:
    return T.with_repeats(facts(t)).select("episode", "turn", "seen_recently", "visits")


@query(
    "contiguous_runs",
    f"""WITH {LIVES}, g AS (SELECT * REPLACE (turn + coalesce(sum((k % 10 = 0)::INT) OVER (PARTITION BY episode ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS turn) FROM l),
    r AS (SELECT *, turn - row_number() OVER (PARTITION BY episode, life ORDER BY turn) AS run FROM g),
    p AS (SELECT *, row_number() OVER (PARTITION BY episode, life, run ORDER BY turn) AS place, count(*) OVER (PARTITION BY episode, life, run) AS n FROM r)
    SELECT episode, turn, place AS run_place, least(n - place + 1, 24)::BIGINT AS ahead FROM p""",
)
def contiguous_runs(t: Tables) -> DataFrame:
    """Stretches of all rows, where a turn is missing after each row with a k of whole tens."""
    missing = F.coalesce(F.sum((F.col("k") % 10 == 0).cast("long")).over(T.past()), F.lit(0))
    return T.with_runs(lived(t).withColumn("_m", missing).withColumn("turn", F.col("turn") + F.col("_m"))).select("episode", "turn", "run_place", "ahead")


@query(
    "gap_grows",
    f"""WITH {LIVES}, n AS (SELECT *, lead(turn) OVER w = turn + 1 AS near, lead(frames) OVER w AS nf, lead(k) OVER w AS nk FROM l WINDOW w AS (PARTITION BY episode, life ORDER BY turn))
    SELECT episode, turn FROM n WHERE near AND nf > frames AND nk > k""",
)
def gap_grows(t: Tables) -> DataFrame:
    rows = lived(t).withColumn("gaps", F.create_map(F.lit("a"), F.col("frames"), F.lit("b"), F.col("k")))
    return T.with_next(rows, "gaps").where(T.gap_grows(F.col("gaps"), F.col("next_gaps"))).select("episode", "turn")


@query(
    "next_progress",
    f"""WITH {FACTS} SELECT episode, turn, min(CASE WHEN progress THEN turn END) OVER (PARTITION BY episode ORDER BY turn ROWS BETWEEN 1 FOLLOWING AND 24 FOLLOWING) - turn AS progress_in FROM f""",
)
def next_progress(t: Tables) -> DataFrame:
    return T.with_next_progress(facts(t)).select("episode", "turn", "progress_in")


@query(
    "prefix_chain",
    f"""WITH {FACTS}, p AS (SELECT *, list(pos) OVER (PARTITION BY episode ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM f)
    SELECT episode, turn, coalesce(len(before), 0)::BIGINT AS prefix_length, sha256(coalesce(array_to_string(before, '|'), '')) AS prefix_sha256 FROM p""",
)
def prefix_chain(t: Tables) -> DataFrame:
    rows = T.with_prefix(facts(t), "pos", "before")
    return rows.select("episode", "turn", F.size("before").cast("long").alias("prefix_length"), F.sha2(F.array_join("before", "|"), 256).alias("prefix_sha256"))


@query(
    "reset_differences",
    f"""WITH {FACTS}, s AS (SELECT episode, turn + 1 AS step, turn // 10 AS block, sum(frames) OVER (PARTITION BY episode, turn // 10 ORDER BY turn) AS cum FROM f)
    SELECT episode, step, (cum - coalesce(lag(cum) OVER (PARTITION BY episode, block ORDER BY step), 0))::BIGINT AS cum_step FROM s""",
)
def reset_differences(t: Tables) -> DataFrame:
    from pyspark.sql import Window

    cum = F.sum("frames").over(Window.partitionBy("episode", F.expr("turn div 10")).orderBy("turn"))
    rows = facts(t).select("episode", (F.col("turn") + 1).alias("step"), cum.alias("cum"))
    return T.differences(rows, "step", ["cum"], 10).select("episode", "step", "cum_step")


@query("after_terminal", f"WITH {FACTS}, n AS (SELECT *, lead(turn) OVER (PARTITION BY episode ORDER BY turn) AS nx FROM f) SELECT episode, turn FROM n WHERE pos = 'signup' AND k > 90 AND nx IS NOT NULL")
def after_terminal(t: Tables) -> DataFrame:
    return T.after_terminal(facts(t), (F.col("pos") == "signup") & (F.col("k") > 90)).select("episode", "turn")


@query(
    "broken_chain",
    f"""WITH {FACTS}, g AS (SELECT *, md5(concat(episode, ':', turn)) AS st, md5(concat(episode, ':', turn + CASE WHEN k = 7 THEN 2 ELSE 1 END)) AS ns FROM f WHERE k <> 3),
    c AS (SELECT *, lag(turn) OVER w AS pt, lag(ns) OVER w AS ps FROM g WINDOW w AS (PARTITION BY episode ORDER BY turn))
    SELECT episode, turn FROM c WHERE (pt IS NULL AND turn <> 0) OR (pt IS NOT NULL AND (turn <> pt + 1 OR st IS DISTINCT FROM ps))""",
)
def broken_chain(t: Tables) -> DataFrame:
    state = lambda n: F.md5(F.concat(F.col("episode").cast("string"), F.lit(":"), n.cast("string")))
    rows = facts(t).where("k <> 3").withColumn("st", state(F.col("turn"))).withColumn("ns", state(F.col("turn") + F.when(F.col("k") == 7, 2).otherwise(1)))
    return T.broken_chain(rows, "st", "ns").select("episode", "turn")


OFFSETS = (-8, -4, -1, 1, 4, 8)
_WINDOWS = """r AS (SELECT *, turn - row_number() OVER (PARTITION BY episode, life ORDER BY turn) AS run FROM g),
    o AS (SELECT unnest([{offsets}]) AS off),
    w AS (SELECT a.episode, a.turn AS root_turn, o.off, b.turn, b.progress, b.k FROM r a, o JOIN r b ON b.episode = a.episode AND b.turn = a.turn + o.off AND b.life = a.life AND b.run = a.run WHERE {root})"""


@query(
    "offset_windows",
    f"WITH {LIVES}, g AS (SELECT * FROM l WHERE k <> 5), {_WINDOWS.format(offsets=', '.join(map(str, OFFSETS)), root='a.progress')} SELECT episode, root_turn, off::BIGINT AS \"offset\", turn FROM w",
)
def offset_windows(t: Tables) -> DataFrame:
    rows = lived(t).where("k <> 5")
    return W.offset_windows(rows.where("progress"), rows, OFFSETS).select("episode", "root_turn", "offset", "turn")


@query(
    "capped_windows",
    f"""WITH {LIVES}, g AS (SELECT * FROM l WHERE k <> 5), {_WINDOWS.format(offsets='1, 4, 8, 16, 24, 32', root='a.lost = false AND a.k > 60')},
    n AS (SELECT *, row_number() OVER (PARTITION BY episode, root_turn ORDER BY progress DESC, off) AS rn FROM w WHERE off >= 2)
    SELECT episode, root_turn, off::BIGINT AS "offset", turn FROM n WHERE rn <= 2""",
)
def capped_windows(t: Tables) -> DataFrame:
    rows = lived(t).where("k <> 5")
    found = W.offset_windows(rows.where("NOT lost AND k > 60"), rows, (1, 4, 8, 16, 24, 32), ["progress"]).where("offset >= 2")
    return W.capped_windows(found, 2, F.col("progress").desc()).select("episode", "root_turn", "offset", "turn")


@query(
    "lookback_roots",
    f"WITH {LIVES}, g AS (SELECT * FROM l), {_WINDOWS.format(offsets='0, -1, -4, -8, -16', root='a.lost')} SELECT DISTINCT episode, turn FROM w",
)
def lookback_roots(t: Tables) -> DataFrame:
    return W.lookback_roots(lived(t), F.col("lost"), (1, 4, 8, 16))


@query(
    "dynamic_windows",
    f"""WITH {LIVES}, g AS (SELECT *, min(CASE WHEN progress THEN turn END) OVER (PARTITION BY episode ORDER BY turn ROWS BETWEEN 1 FOLLOWING AND 24 FOLLOWING) - turn AS food FROM l),
    r AS (SELECT *, turn - row_number() OVER (PARTITION BY episode, life ORDER BY turn) AS run FROM g),
    o AS (SELECT r.*, unnest(list_distinct([2, 4, 8, 16, 24, food + 1, food + 4])) AS off FROM r WHERE food IS NOT NULL AND k > 70)
    SELECT o.episode, o.turn AS root_turn, o.off::BIGINT AS "offset", b.turn FROM o JOIN r b ON b.episode = o.episode AND b.turn = o.turn + o.off AND b.life = o.life AND b.run = o.run WHERE o.off <= 24""",
)
def dynamic_windows(t: Tables) -> DataFrame:
    rows = T.with_runs(T.with_next_progress(lived(t)))
    roots = rows.where("progress_in IS NOT NULL AND k > 70")
    offs = F.array_distinct(F.array(*[F.lit(x).cast("long") for x in (2, 4, 8, 16, 24)], F.col("progress_in") + 1, F.col("progress_in") + 4))
    asked = roots.select("episode", "life", "run", F.col("turn").alias("root_turn"), F.explode(offs).alias("offset")).where("offset <= 24").withColumn("turn", F.col("root_turn") + F.col("offset"))
    return asked.join(rows.select("episode", "life", "run", "turn"), ["episode", "life", "run", "turn"]).select("episode", "root_turn", "offset", "turn")


@query(
    "suffix_rebased",
    f"""WITH {LIVES}, r AS (SELECT episode, min(turn) AS turn FROM l WHERE life = 1 GROUP BY episode)
    SELECT l.episode, l.turn - r.turn AS suffix_turn, l.life - x.life AS life FROM l JOIN r USING (episode) JOIN l x ON x.episode = r.episode AND x.turn = r.turn WHERE l.turn >= r.turn""",
)
def suffix_rebased(t: Tables) -> DataFrame:
    rows = lived(t)
    roots = R.first_rows(rows.where("life = 1"), ["episode"], [F.col("turn")])
    return rebased(rows, roots, ["life"]).select("episode", "suffix_turn", "life")


@query(
    "replay_differences",
    f"""WITH {FACTS}, b AS (SELECT episode, turn, CASE WHEN k = 50 THEN 'x' ELSE pos END AS pos FROM f WHERE NOT (k = 51 AND turn > 40))
    SELECT coalesce(f.episode, b.episode) AS episode, min(coalesce(f.turn, b.turn)) AS first_difference FROM f FULL JOIN b ON f.episode = b.episode AND f.turn = b.turn WHERE f.pos IS DISTINCT FROM b.pos GROUP BY 1""",
)
def replay_differences(t: Tables) -> DataFrame:
    rows = facts(t)
    other = rows.where("NOT (k = 51 AND turn > 40)").withColumn("pos", F.when(F.col("k") == 50, "x").otherwise(F.col("pos")))
    return first_difference(rows, other, "episode", "turn", "pos")


@query(
    "conversation_history",
    """SELECT conv_id, turn, count(*) FILTER (role = 'user') OVER (PARTITION BY conv_id ORDER BY turn) AS user_turns, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS before,
    row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) AS nth_of_role FROM conversations""",
)
def conversation_history(t: Tables) -> DataFrame:
    from pyspark.sql import Window

    w = Window.partitionBy("conv_id").orderBy("turn")
    nth = F.row_number().over(Window.partitionBy("conv_id", "role").orderBy("turn")).cast("long")
    return t("conversations").select("conv_id", "turn", F.count_if(F.col("role") == "user").over(w).alias("user_turns"), F.lag("role").over(w).alias("before"), nth.alias("nth_of_role"))
