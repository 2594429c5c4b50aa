"""Sources, sinks, manifests and streaming folds in temporary folders."""

import json
import time
import zipfile

import pytest
from pyspark.sql import functions as F

from wayfold import schema
from wayfold.operators import metrics as M
from wayfold.operators import trajectory as T
from wayfold.plans.base import Tables, facts
from wayfold.sources import files as S
from wayfold.sources import shared
from wayfold.streaming import folds as ST

TELEMETRY = schema.TELEMETRY


def test_schemas_parse(spark):
    for ddl in (schema.DECISION, schema.OBSERVATION, schema.RESPONSE, schema.EPISODE_METRICS, schema.RECORD, schema.CATALOG, schema.MANIFEST, schema.EDGE):
        assert schema.struct(ddl).fields


def test_jsonl_round_trip_and_failfast(spark, tmp_path):
    df = spark.createDataFrame([(1, 0.5, 2), (2, 1.0, 4)], TELEMETRY)
    S.write_jsonl(df, f"{tmp_path}/t")
    assert sorted(S.read_jsonl(spark, f"{tmp_path}/t", TELEMETRY).collect()) == sorted(df.collect())
    with pytest.raises(Exception, match="already exists|ALREADY_EXISTS"):
        S.write_jsonl(df, f"{tmp_path}/t")
    (tmp_path / "blank.jsonl").write_text('{"step": 1}\n\n{"step": 2}\n')
    assert S.read_jsonl(spark, f"{tmp_path}/blank.jsonl", TELEMETRY).count() == 2
    (tmp_path / "bad.jsonl").write_text('{"step": \n')
    with pytest.raises(Exception, match="(?i)malformed|parse"):
        S.read_jsonl(spark, f"{tmp_path}/bad.jsonl", TELEMETRY).collect()


def test_write_once(spark, tmp_path):
    df = spark.range(5)
    assert S.write_once(df, f"{tmp_path}/w") is True
    assert S.write_once(df.repartition(3), f"{tmp_path}/w") is False
    with pytest.raises(ValueError, match="other contents"):
        S.write_once(spark.range(6), f"{tmp_path}/w")


def test_zip_source_bundle_and_manifest(spark, tmp_path):
    body = "\n".join(json.dumps({"step": i, "ce_cum": 1.0, "n_cum": i}) for i in range(3)) + "\n"
    assert S.pack({"b": b"2", "a": b"1"}) == S.pack({"a": b"1", "b": b"2"})
    (tmp_path / "x.zip").write_bytes(S.pack({"rows.jsonl": body.encode(), "note.txt": b"n"}))
    rows = S.read_zip_jsonl(spark, f"{tmp_path}/x.zip", TELEMETRY)
    assert sorted((r.member, r.line, r.step) for r in rows.collect()) == [("rows.jsonl", i, i) for i in range(3)]
    members = S.zip_members(spark, f"{tmp_path}/x.zip")
    archive, manifest = S.bundle(members, "member", "content")
    assert S.against_manifest(members, manifest).count() == 0
    changed = members.withColumn("content", F.when(F.col("member") == "note.txt", F.lit(b"m")).otherwise(F.col("content")))
    assert [tuple(r) for r in S.against_manifest(changed, manifest).collect()] == [("note.txt", "changed")]
    (tmp_path / "y.zip").write_bytes(archive)
    assert set(zipfile.ZipFile(tmp_path / "y.zip").namelist()) == {"rows.jsonl", "note.txt"}


def test_csv_with_nested_columns(spark, tmp_path):
    S.write_csv(spark.createDataFrame([("a", ["x", "y"])], "id string, tags array<string>"), f"{tmp_path}/c")
    row = spark.read.option("header", True).csv(f"{tmp_path}/c").first()
    assert row.id == "a" and "x" in row.tags


def test_receipts_parts_and_documents(spark, tmp_path):
    for k in (1, 2):
        (tmp_path / f"job{k}").mkdir()
        (tmp_path / f"job{k}" / "receipt.json").write_text(json.dumps({"step": k}))
    (tmp_path / "job1" / "partial.json").write_text("{")
    assert S.read_receipts(spark, str(tmp_path), TELEMETRY).count() == 2
    assert S.read_documents(spark, f"{tmp_path}/job1/receipt.json", TELEMETRY).first().step == 1
    a, b = spark.range(3), spark.range(2)
    both = S.concatenated([a, b], [S.content_digest(a), S.content_digest(b)])
    assert both.groupBy("part_no").count().orderBy("part_no").collect()[1]["count"] == 2
    with pytest.raises(ValueError, match="part 1"):
        S.concatenated([a, b], [S.content_digest(a), S.content_digest(a)])
    manifest = S.dataset_manifest(spark, {"train": a, "development": b})
    assert {r.name: r.rows for r in manifest.collect()} == {"train": 3, "development": 2}
    parts = spark.createDataFrame([(1, bytearray(b"lo")), (0, bytearray(b"hel"))], "n int, c binary")
    assert S.joined_parts(parts, "n", "c", "2cf24dba5fb0a30e26e83b2ac5b9e29e1b161e5c1fa7425e73043362938b9824") == b"hello"
    with pytest.raises(ValueError, match="digest"):
        S.joined_parts(parts, "n", "c", "0")


def test_streamed_fold_equals_batch_fold(spark, data, tmp_path):
    rows = facts(Tables(spark, data)).select("episode", "turn", "lost", "progress", "frames")
    for k in range(3):  # rows of an episode arrive in order, in three files
        rows.where(f"turn div 25 = {k}" if k < 2 else "turn >= 50").coalesce(1).write.json(f"{tmp_path}/in/{k}")
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).option("latestFirst", False).json(f"{tmp_path}/in/*")
    out = ST.drain(ST.episode_folds(stream), "folds")
    last = out.groupBy("episode").agg(F.max_by(F.struct(*out.columns[1:]), "decisions").alias("s")).select("episode", "s.*")
    want = M.episode_summary(T.with_streaks(T.with_dry_spells(T.with_lives(rows)), F.lit(False)).withColumn("period", F.lit(None).cast("long"))).select(*out.columns)
    assert sorted(last.collect()) == sorted(want.collect())


def test_routed_stream_is_idempotent(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "log.txt").write_text('LAB_METRIC {"a":1}\nLAB_PHASE train\nhello world\n')
    lines = spark.readStream.text(f"{tmp_path}/in")
    ST.write_routed(ST.routed(lines), f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination()
    ST.write_routed(ST.routed(lines), f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination()
    got = {(r.route, r.payload) for r in spark.read.json(f"{tmp_path}/out").collect()}
    assert got == {("LAB_METRIC", '{"a":1}'), ("LAB_PHASE", "train"), ("other", "hello world")}


def test_event_time_stream(spark, data, tmp_path):
    events = spark.read.parquet(f"{data}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    events.write.parquet(f"{tmp_path}/e")
    stream = spark.readStream.schema(events.schema).parquet(f"{tmp_path}/e")
    got = ST.drain(ST.daily(stream), "days", "complete")
    assert sorted(got.collect()) == sorted(ST.daily(events).collect())
    assert ST.drain(ST.once(stream, "event_id"), "uniq", "append").count() == events.count()


def test_heartbeat_tells_quiet_keys(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text('{"worker":"a"}\n{"worker":"a"}\n{"worker":"b"}\n')
    stream = spark.readStream.schema("worker string").json(f"{tmp_path}/in")
    query = ST.heartbeat(stream, "worker", 1000).writeStream.format("memory").queryName("beats").outputMode("update").trigger(processingTime="500 milliseconds").start()
    try:
        for _ in range(120):
            time.sleep(0.5)
            got = {tuple(r) for r in spark.table("beats").collect()}
            if len(got) == 4:
                break
    finally:
        query.stop()
    assert got == {("a", True), ("b", True), ("a", False), ("b", False)}


def test_shared_folder_is_needed_on_a_cluster(spark, monkeypatch):
    class Unset:
        def __getattr__(self, name):
            return self

        def __call__(self, *a):
            return self

        def isDefined(self):
            return False

        def get(self, *a):
            return None

        master = "spark://host:7077"

    fake = type("Session", (), {"sparkContext": Unset()})()
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared.shared_dir(fake)
