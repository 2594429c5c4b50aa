"""Stateful processors: folds in any order of arrival, repeats, timers and time to live."""

import random
import time

import pytest
from pyspark.sql import functions as F

from wayfold.operators import decisions as D
from wayfold.plans import store_queries as Q
from wayfold.plans.base import Tables
from wayfold.plans.decision_log import log
from wayfold.sources.shared import cut
from wayfold.streaming import episodes as E


@pytest.fixture(scope="module")
def decisions(spark, data):
    return cut(log(Tables(spark, data)))


def ended():
    return F.when(F.col("pellets_remaining") == 0, "level_cleared").when(F.col("decisions") >= 70, "decision_cap").when(F.col("last_lost"), "life_lost").otherwise("trace_end")


def fold(spark, tmp_path, parts, rows):
    """Runs the fold over files that arrive one after another; the running folds of all batches."""
    source, sink, ckpt = (f"{tmp_path}/{k}" for k in ("in", "out", "ckpt"))
    for k, part in enumerate(parts):
        part.write.mode("append").parquet(source)
        stream = spark.readStream.schema(rows.schema).parquet(source)
        q = E.fold_stream(stream).writeStream.foreachBatch(lambda b, n, k=k: b.write.parquet(f"{sink}/{k}-{n}")).outputMode("update").option("checkpointLocation", ckpt).trigger(availableNow=True).start()
        q.awaitTermination()
    return spark.read.schema(E.FOLD).option("recursiveFileLookup", True).parquet(sink)


def test_any_order_and_repeats_give_the_batch_measures(spark, tmp_path, decisions):
    rows = cut(decisions.select(*Q._OBSERVED))
    rng = random.Random(1)
    turns = list(range(rows.agg(F.max("turn")).first()[0] + 1))
    rng.shuffle(turns)
    cutoff = len(turns) // 2
    early, late = rows.where(F.col("turn").isin(turns[:cutoff])), rows.where(F.col("turn").isin(turns[cutoff:]))
    folds = fold(spark, tmp_path, [early, early.limit(40), late, rows.limit(200)], rows)
    got = E.measures(E.latest(folds), ended())
    want = D.summary(decisions, F.max(F.lit("")))
    same = [c for c in want.columns if c not in ("outcome", "censored", "level_cleared", "mean_http_ms")]
    plain = lambda df: sorted(str({k: sorted(v.items()) if isinstance(v, dict) else v for k, v in r.asDict(True).items()}) for r in df.select(*same).collect())
    assert plain(got) == plain(want)
    assert E.latest(folds).where("waiting > 0").count() == 0 and folds.where("waiting > 0").count() > 0


def test_quiet_keys_are_told_by_timers(spark, tmp_path):
    source, ckpt = f"{tmp_path}/in", f"{tmp_path}/ckpt"
    spark.createDataFrame([("a",), ("b",), ("a",)], "job string").write.parquet(source)
    heard = []
    q = E.quiet_stream(spark.readStream.schema("job string").parquet(source), "job", 4000).writeStream.foreachBatch(lambda b, n: heard.extend(tuple(r) for r in b.collect())).outputMode("update").option("checkpointLocation", ckpt).trigger(processingTime="1 second").start()
    try:
        until = time.time() + 60
        while len(heard) < 4 and time.time() < until:
            time.sleep(0.5)
    finally:
        q.stop()
    assert sorted(heard) == [("a", False, 2), ("a", True, 2), ("b", False, 1), ("b", True, 1)]


@pytest.mark.parametrize("ttl,again", [(3_600_000, ["z"]), (1, ["x", "z"])])
def test_first_of_a_key_within_its_time(spark, tmp_path, ttl, again):
    """With processing time the query goes on by itself, so it is watched and stopped."""
    source, found = f"{tmp_path}/in", []
    arrive = lambda *keys: spark.createDataFrame([(k, i) for i, k in enumerate(keys)], "digest string, n int").coalesce(1).write.mode("append").parquet(source)
    arrive("x", "y", "x")
    first = E.first_seen(spark.readStream.schema("digest string, n int").parquet(source), "digest", ttl)
    q = first.writeStream.foreachBatch(lambda b, n: found.extend(r["digest"] for r in b.collect())).option("checkpointLocation", f"{tmp_path}/ckpt").trigger(processingTime="1 second").start()

    def wait(n):
        until = time.time() + 60
        while len(found) < n and time.time() < until:
            time.sleep(0.3)

    try:
        wait(2)
        assert sorted(found) == ["x", "y"]
        arrive("x", "z")
        wait(2 + len(again))
        assert sorted(found[2:]) == again
    finally:
        q.stop()


def test_an_episode_takes_few_calls_for_state():
    """Each is a turn over a socket: however many lives and cycles a batch has, its state is read once and written once."""
    calls = []

    class State:
        def __init__(self, name):
            self.name, self.held = name, None

        def __getattr__(self, call):
            def f(*args):
                calls.append(f"{self.name}.{call}")
                if call == "update":
                    self.held = args[0]
                return self.held if call == "get" else iter(())

            return f

    class Handle:
        def __getattr__(self, call):
            return lambda name, *schemas: State(name)

    fold = E.EpisodeFold()
    fold.init(Handle())
    row = lambda turn: E.Row(episode=1, turn=turn, step=",".join(map(str, [int(turn % 3 == 2), 0, 4, turn % 2, 1, 1, turn, "", *[1] * len(E.ADDS)])))
    for part in (range(0, 300), range(300, 600)):
        (out,) = fold.handleInputRows((1,), iter([row(t) for t in part]), None)
    assert out.next_turn == 600 and out.score == 599 and out.pellets_left is None and len(out.per_life) == 200 and {v["decisions"] for _, v in out.per_life} == {3}
    assert calls == ["fold.get", "fold.update"] * 2
