"""Streaming forms: routed log lines, incremental episode folds, heartbeats, idempotent sinks, event-time windows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

#: Prefixes of routed lines.
ROUTES = ("LAB_METRIC", "LAB_BATCH", "LAB_RESUMED", "LAB_PHASE")


def routed(lines: DataFrame, column: str = "value") -> DataFrame:
    """route (other without a prefix) and payload of each line; the same for batch and stream."""
    value = F.col(column)
    route = None
    for r in ROUTES:
        route = F.when(F.startswith(value, F.lit(r + " ")), r) if route is None else route.when(F.startswith(value, F.lit(r + " ")), r)
    route = route.otherwise("other")
    return lines.withColumn("route", route).withColumn("payload", F.when(route == "other", value).otherwise(F.expr(f"substring({column}, length(route) + 2)")))


def write_routed(lines: DataFrame, base: str, checkpoint: str) -> StreamingQuery:
    """Every micro-batch to a folder per route, once: the batch number names the folder, so a repeat replaces it."""

    def sink(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").partitionBy("route").json(f"{base}/batch={number}")

    return lines.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def append_files(rows: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append-only file sink; each row is committed once."""
    return rows.writeStream.format("json").outputMode("append").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


FOLD_STATE = "turn long, life long, decisions long, frames long, losses long, progress long, dry long, longest_dry long, dry_frames long, longest_dry_frames long"
FOLD = "episode long, decisions long, frames long, life_losses long, progress_events long, longest_dry long, longest_dry_frames long"


def _fold(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
    """One step of the episode fold per row, in the order of turn; rows at or before the last seen turn are repeats."""
    s = list(state.get) if state.exists else [-1, 0, 0, 0, 0, 0, 0, 0, 0, 0]
    rows = pd.concat(list(batches))
    for turn, lost, progress, frames in rows.sort_values("turn")[["turn", "lost", "progress", "frames"]].itertuples(index=False):
        if turn <= s[0]:
            continue
        dry, dry_frames = (0, 0) if progress else (s[6] + 1, s[8] + int(frames))
        s = [int(turn), s[1] + bool(lost), s[2] + 1, s[3] + int(frames), s[4] + bool(lost), s[5] + bool(progress), dry, max(s[7], dry), dry_frames, max(s[9], dry_frames)]
        if lost:  # the next row begins a new life
            s[6] = s[8] = 0
    state.update(tuple(s))
    yield pd.DataFrame([[key[0], s[2], s[3], s[4], s[5], s[7], s[9]]], columns=[c.split()[0] for c in FOLD.split(", ")])


def episode_folds(rows: DataFrame) -> DataFrame:
    """Running summary of each episode (rows: episode, turn, lost, progress, frames), updated as rows arrive in order."""
    return rows.groupBy("episode").applyInPandasWithState(_fold, FOLD, FOLD_STATE, "update", "NoTimeout")


def heartbeat(events: DataFrame, key: str, quiet_ms: int = 15_000) -> DataFrame:
    """key, alive for keys seen, and a row with alive false for each key that was quiet for quiet_ms of processing time."""

    def beat(k: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame({key: [k[0]], "alive": [False]})
            return
        for _ in batches:
            pass
        state.update((1,))
        state.setTimeoutDuration(quiet_ms)
        yield pd.DataFrame({key: [k[0]], "alive": [True]})

    kind = dict(events.dtypes)[key]
    return events.groupBy(key).applyInPandasWithState(beat, f"{key} {kind}, alive boolean", "seen int", "update", "ProcessingTimeTimeout")


def daily(events: DataFrame, watermark: str = "1 day") -> DataFrame:
    """Events per day and kind, final once the watermark has passed (ts must be a timestamp)."""
    seen = events.withWatermark("ts", watermark) if events.isStreaming else events
    out = seen.groupBy(F.window("ts", "1 day"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum(F.round(F.col("value") * 100).cast("long")).alias("cents"))
    return out.select(F.col("window.start").alias("day"), "event_type", "n", "cents")


def sessions(events: DataFrame, gap: str = "30 minutes", watermark: str = "1 day") -> DataFrame:
    """Sessions of each user, closed by a gap."""
    seen = events.withWatermark("ts", watermark) if events.isStreaming else events
    out = seen.groupBy(F.session_window("ts", gap), "user_id").agg(F.count(F.lit(1)).alias("n"))
    return out.select("user_id", F.col("session_window.start").alias("began"), "n")


def once(events: DataFrame, key: str, watermark: str = "1 day") -> DataFrame:
    """Rows with repeats of key within the watermark left out."""
    return events.withWatermark("ts", watermark).dropDuplicatesWithinWatermark([key]) if events.isStreaming else events.dropDuplicates([key])


def snapshot_due(step: Column, seconds_since: Column, last: Column, every: int = 100, period: int = 300) -> Column:
    """A snapshot is due at step 1, at every n-th step, after a period, and at the end."""
    return (step == 1) | (step % every == 0) | (seconds_since >= period) | last


def remapped_offset(step: Column, old_batch: Column, new_batch: Column) -> Column:
    """The step under a new batch size, null where the old one does not end on its boundary."""
    done = step * old_batch
    return F.when(done % new_batch == 0, F.expr("1") * (done / new_batch).cast("long"))


def eta_seconds(step: Column, first: Column, total: Column, elapsed: Column) -> Column:
    """Seconds left at the rate of this run alone; null before its first step is done."""
    return F.try_divide(elapsed * (total - step), step - first)


def drain(stream: DataFrame, name: str, mode: str = "update", then: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Everything available, through a memory sink; for tests and small results."""
    query = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
    out = stream.sparkSession.table(name)
    return then(out) if then else out
