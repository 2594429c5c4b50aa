"""The episode fold as rows arrive: value and map state on the RocksDB store, timers and time to live.

What a row tells alone is made by column expressions before the fold, as one array of numbers to add up
(ADDS, of decisions.LOG); what depends on the rows before is the processor's: lives, dry spells, cycles and streaks, as
operators.trajectory has them. Rows of an episode are folded in the order of turn whatever order they arrive in: one that comes early
waits in map state until all before it are there, and one that was seen is passed over, so a repeated batch changes nothing.

    fold_stream(decisions)           running measures of each episode, one row per episode and batch
    measures(fold)                   the same columns as decisions.summary
    quiet_stream(rows, key, ms)      which keys have gone quiet, by processing-time timers
    first_seen(rows, key, ttl_ms)    rows whose key was not seen within a time to live
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from wayfold.operators import decisions as D

#: Positions of a spell that cycles are looked for in, and the longest cycle.
HISTORY, LONGEST = 128, 64
_PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(spark: SparkSession) -> None:
    """Stateful processors need the RocksDB store, which also keeps state beyond memory on local disk."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", _PROVIDER)


def smallest_period(recent: list, longest: int = LONGEST) -> int | None:
    """The smallest p >= 2 for which the last p places equal the p before, on two places or more, in one linear pass.

    Z-array of the reversed places: reach[p] places from p on equal the first ones.
    """
    r = recent[::-1]
    n = len(r)
    same = next((i for i in range(n) if r[i] != r[0]), n)  # so many last places are one
    reach, lo, hi = [0] * n, 0, 0
    for p in range(1, n):
        k = min(hi - p, reach[p - lo]) if p < hi else 0
        while p + k < n and r[k] == r[p + k]:
            k += 1
        reach[p] = k
        if p + k > hi:
            lo, hi = p, p + k
        if 2 <= p <= longest and k >= p and same < p:
            return p
    return None


#: Numbers of a row that an episode adds up, each a condition or a value of decisions.LOG.
def adds() -> dict[str, Column]:
    choice, junction, straight = F.col("choice"), F.size("legal") >= D.JUNCTION, F.array_contains("legal", F.col("heading"))
    lost = F.coalesce(F.col("outcome") == "life_lost", F.lit(False))
    ahead, open_end = F.coalesce(choice == F.col("heading"), F.lit(False)), F.col("outcome").isNull()
    skipped = junction & (D.collected() == 0) & F.exists(D.options(), lambda r: ~r["life_lost"] & (r["pellets"] > 0))
    return {
        "simulation_frames": F.col("action_frames"),
        "http_micros": F.round(F.col("http_ms") * 1000),
        "pellets_collected": D.collected(),
        "life_losses": lost,
        "immediate_risk_decisions": D.some_fatal(),
        "avoidable_risk_decisions": D.mixed(),
        "all_immediate_actions_fatal": ~D.some_safe(),
        "unsafe_immediate_choices": D.fatal(choice),
        "avoidable_immediate_deaths": lost & D.some_safe(),
        "straight_available": straight,
        "straight_chosen": straight & ahead,
        "junction_straight_available": straight & junction,
        "junction_straight_chosen": straight & junction & ahead,
        "safe_immediate_pellet_skips_at_junction": skipped,
        "stationary_actions": D.moved() == 0,
        "multi_tile_actions": D.moved() > 1,
        "nonterminal_stationary_actions": (D.moved() == 0) & open_end,
        "nonterminal_multi_tile_actions": (D.moved() > 1) & open_end,
        **{c: F.col(c) for c in ("normal_pellets", "power_pellets", "ghosts_eaten", "fruit_eaten")},
        "violations": D.fatal(choice) != lost,
    }


ADDS = (
    "simulation_frames http_micros pellets_collected life_losses immediate_risk_decisions avoidable_risk_decisions all_immediate_actions_fatal unsafe_immediate_choices "
    "avoidable_immediate_deaths straight_available straight_chosen junction_straight_available junction_straight_chosen safe_immediate_pellet_skips_at_junction stationary_actions "
    "multi_tile_actions nonterminal_stationary_actions nonterminal_multi_tile_actions normal_pellets power_pellets ghosts_eaten fruit_eaten violations"
).split()
_PELLETS = ADDS.index("pellets_collected")

#: The numbers of a row before its ADDS. The processor takes all of them as one text, since every cell of a row is turned by itself on its way to Python.
STEP = "lost progress frames place level seed score pellets_left".split()
#: What the processor keeps and gives.
_SCALARS = "next_turn long, life long, dry long, dry_frames long, longest_dry long, longest_dry_frames long, streak long, longest_streak long, loop_decisions long, level long, seed long, score long, pellets_left long, last_lost boolean"
_STATE = f"{_SCALARS}, adds array<bigint>, recent array<bigint>, lives array<struct<life:bigint,decisions:bigint,pellets:bigint,lost:boolean>>, periods array<struct<period:bigint,times:bigint>>, waiting long"
FOLD = f"episode long, {_SCALARS}, adds array<bigint>, per_life map<string,struct<decisions:bigint,pellets_collected:bigint,life_lost:boolean>>, loop_periods map<bigint,bigint>, waiting long"


def steps(decisions: DataFrame) -> DataFrame:
    """episode, turn and step (STEP and ADDS, empty where null) of rows with the observed columns of decisions.LOG (no sequence columns are needed)."""
    numbers = adds()
    own = {
        "lost": F.coalesce(F.col("outcome") == "life_lost", F.lit(False)), "progress": D.collected() > 0, "frames": F.col("action_frames"), "place": F.col("row") * 1000 + F.col("column"),
        "level": F.col("level"), "seed": F.col("seed"), "score": F.col("score_after"), "pellets_left": F.col("pellets_after"),
    }
    texts = [*[F.coalesce(own[k].cast("long").cast("string"), F.lit("")) for k in STEP], *[F.coalesce(numbers[k].cast("long"), F.lit(0)).cast("string") for k in ADDS]]
    return decisions.select(F.col("episode").cast("long").alias("episode"), F.col("turn").cast("long").alias("turn"), F.concat_ws(",", *texts).alias("step"))


class EpisodeFold(StatefulProcessor):
    """One key is an episode. State is read once a batch, folded row by row in memory, and written once.

    Every call for state is a turn over a socket, so what a batch gives out again as a whole is one value; only rows that wait are a map.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.fold = handle.getValueState("fold", _STATE)
        self.early = handle.getMapState("early", "turn long", "step string")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802, N803
        held = self.fold.get()
        s = dict(zip((c.split()[0] for c in _SCALARS.split(", ")), held)) if held else dict(next_turn=0, life=0, dry=0, dry_frames=0, longest_dry=0, longest_dry_frames=0, streak=0, longest_streak=0, loop_decisions=0, level=None, seed=None, score=None, pellets_left=None, last_lost=None)
        sums, recent, lives, periods, waiting = ([*map(list, held[-5:-1]), held[-1]]) if held else ([0] * len(ADDS), [], [], [], 0)
        lives = {life: rest for life, *rest in lives}
        periods = dict(map(tuple, periods))
        new = {turn: step for _, turn, step in rows if turn >= s["next_turn"]}
        known = {k[0]: v[0] for k, v in self.early.iterator()} if waiting else {}
        ready = known | new
        while s["next_turn"] in ready:
            turn = s["next_turn"]
            lost, progress, frames, place, level, seed, score, left, *numbers = [int(x) if x else None for x in ready.pop(turn).split(",")]
            lost = lost == 1
            if turn in known:
                self.early.removeKey((turn,))
            now = s["life"]
            life = lives.get(now) or (0, 0, False)
            lives[now] = (life[0] + 1, life[1] + numbers[_PELLETS], life[2] or lost)
            sums = [a + b for a, b in zip(sums, numbers, strict=True)]
            period = None
            if progress:  # ends the spell and is no part of the next
                s["dry"] = s["dry_frames"] = 0
                recent = []
            else:
                s["dry"], s["dry_frames"] = s["dry"] + 1, s["dry_frames"] + frames
                recent = [*recent, place][-HISTORY:]
                period = smallest_period(recent) if len(recent) >= 4 else None
            s["longest_dry"], s["longest_dry_frames"] = max(s["longest_dry"], s["dry"]), max(s["longest_dry_frames"], s["dry_frames"])
            s["streak"] = s["streak"] + 1 if period else 0
            s["longest_streak"] = max(s["longest_streak"], s["streak"])
            if period:
                s["loop_decisions"] += 1
                periods[period] = periods.get(period, 0) + 1
            s |= {"level": level if s["level"] is None else s["level"], "seed": seed if s["seed"] is None else s["seed"], "score": score, "pellets_left": left, "last_lost": lost, "next_turn": turn + 1}
            if lost:  # the next row begins a new life, with a spell of its own
                s |= {"life": now + 1, "dry": 0, "dry_frames": 0}
                recent = []
        for turn, step in ready.items():
            if turn not in known:
                self.early.updateValue((turn,), (step,))
        self.fold.update((*s.values(), sums, recent, [(k, *v) for k, v in lives.items()], list(periods.items()), len(ready)))
        # maps go out as lists of pairs
        per_life = [(str(k), dict(zip(("decisions", "pellets_collected", "life_lost"), v, strict=True))) for k, v in lives.items()]
        yield Row(episode=key[0], **s, adds=sums, per_life=per_life, loop_periods=list(periods.items()), waiting=len(ready))

    def close(self) -> None:
        """Nothing is held outside the state."""


def fold_stream(decisions: DataFrame) -> DataFrame:
    """FOLD of every episode of the batch, in update mode. decisions: a stream with the observed columns of decisions.LOG."""
    use_rocksdb(decisions.sparkSession)
    return steps(decisions).groupBy("episode").transformWithState(EpisodeFold(), FOLD, "Update", "None")


def latest(folds: DataFrame) -> DataFrame:
    """The last row of each episode of a table of running folds."""
    return folds.groupBy("episode").agg(F.max_by(F.struct(*[c for c in folds.columns if c != "episode"]), F.struct("next_turn", F.lit(-1) * F.col("waiting"))).alias("f")).select("episode", "f.*")


def measures(fold: DataFrame, ended: Column) -> DataFrame:
    """The columns of decisions.summary; ended: how an episode ended, of decisions, pellets_remaining and last_lost."""
    at = {k: F.col("adds")[i] for i, k in enumerate(ADDS)}
    out = fold.select(
        "episode", "level", "seed", F.col("next_turn").alias("decisions"), "score", F.col("pellets_left").alias("pellets_remaining"),
        (at["http_micros"] / F.col("next_turn") / 1000).alias("mean_http_ms"), *[at[k].alias(k) for k in ADDS if k != "http_micros"],
        F.col("longest_dry").alias("longest_no_pellet_decisions"), F.col("longest_dry_frames").alias("longest_no_pellet_frames"), "loop_decisions", F.col("longest_streak").alias("longest_loop_streak_decisions"),
        F.coalesce(F.try_element_at("per_life", F.lit("0"))["pellets_collected"], F.lit(0)).alias("first_life_pellets"), "per_life", "loop_periods", "last_lost",
    )
    rate = lambda a, b: F.try_divide(F.col(a).cast("double"), F.col(b).cast("double"))
    out = out.withColumns({
        "post_respawn_pellets": F.col("pellets_collected") - F.col("first_life_pellets"),
        "outcome": ended,
        "unsafe_immediate_choice_rate": rate("unsafe_immediate_choices", "immediate_risk_decisions"),
        "avoidable_immediate_death_rate": rate("avoidable_immediate_deaths", "avoidable_risk_decisions"),
        "straight_choice_rate": rate("straight_chosen", "straight_available"),
    })
    return out.withColumns({"censored": F.col("outcome").isin(*D.CAPPED), "level_cleared": F.coalesce(F.col("outcome") == "level_cleared", F.lit(False))}).drop("last_lost")


class Quiet(StatefulProcessor):
    """A row with alive true when a key is heard, and one with alive false once it was quiet for so long; each hearing moves the timer."""

    def __init__(self, name: str, quiet_ms: int) -> None:
        self.name, self.quiet_ms = name, quiet_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.due = handle.getValueState("due", "at long, heard long")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802, N803
        heard = sum(1 for _ in rows)
        before = self.due.get() if self.due.exists() else None
        if before:
            self.handle.deleteTimer(before[0])
            heard += before[1]
        at = timerValues.getCurrentProcessingTimeInMs() + self.quiet_ms
        self.handle.registerTimer(at)
        self.due.update((at, heard))
        yield Row(**{self.name: key[0], "alive": True, "heard": heard})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        heard = self.due.get()[1] if self.due.exists() else 0
        self.due.clear()
        yield Row(**{self.name: key[0], "alive": False, "heard": heard})

    def close(self) -> None:
        """Nothing is held outside the state."""


def quiet_stream(rows: DataFrame, key: str, quiet_ms: int = 15_000) -> DataFrame:
    """key, alive, heard (rows since it was last quiet), by processing time."""
    use_rocksdb(rows.sparkSession)
    kind = dict(rows.dtypes)[key]
    return rows.select(key).groupBy(key).transformWithState(Quiet(key, quiet_ms), f"{key} {kind}, alive boolean, heard long", "Update", "ProcessingTime")


class FirstSeen(StatefulProcessor):
    """The first row of a key; its memory of the key ends by itself."""

    def __init__(self, ttl_ms: int) -> None:
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("seen", "seen boolean", self.ttl_ms)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802, N803
        if not self.seen.exists():
            self.seen.update((True,))
            yield next(rows)
        for _ in rows:
            pass

    def close(self) -> None:
        """Nothing is held outside the state."""


def first_seen(rows: DataFrame, key: str, ttl_ms: int) -> DataFrame:
    """The first row of each key within ttl_ms of processing time (collection of unseen states)."""
    use_rocksdb(rows.sparkSession)
    return rows.groupBy(key).transformWithState(FirstSeen(ttl_ms), rows.schema, "Append", "ProcessingTime")
