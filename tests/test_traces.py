"""The trace source: rows exist by receipts alone, batch and stream agree, failures leave nothing that can be read."""

import json
import random
import threading

import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from wayfold.sources import traces

DDL = "id long, name string, score double, ok boolean, tags array<string>, risks map<string,struct<lost:boolean,pellets:int>>, at timestamp"


@pytest.fixture(autouse=True)
def registered(spark):
    spark.dataSource.register(traces.TraceSource)


def rows(spark, n, start=0, parts=3):
    df = spark.range(start, start + n, 1, parts).select(
        "id", F.when(F.col("id") % 5 == 0, None).otherwise(F.concat(F.lit('é "q"\n'), "id")).alias("name"), (F.col("id") / 3).alias("score"), (F.col("id") % 2 == 0).alias("ok"),
        F.array(F.lit("a"), F.col("id").cast("string")).alias("tags"), F.create_map(F.lit("up"), F.struct(F.lit(True).alias("lost"), F.col("id").cast("int").alias("pellets"))).alias("risks"), F.timestamp_seconds("id").alias("at"),
    )
    return df


def read(spark, path, **options):
    return spark.read.format("traces").options(**options).schema(DDL).load(str(path))


def same(a, b):
    return sorted(map(str, a.collect())) == sorted(map(str, b.collect()))


def test_round_trip_and_splits(spark, tmp_path):
    df = rows(spark, 500)
    df.write.format("traces").mode("append").save(str(tmp_path))
    assert same(read(spark, tmp_path), df)
    assert same(read(spark, tmp_path, split=9000), df)
    few = rows(spark, 6, parts=1)
    few.write.format("traces").mode("append").save(str(tmp_path / "few"))
    for split in (40, 97, 300):  # pieces smaller than a line, and pieces that cut lines
        assert same(read(spark, tmp_path / "few", split=split), few)
    rows(spark, 7, 500).write.format("traces").mode("append").save(str(tmp_path))
    assert same(read(spark, tmp_path), rows(spark, 507))
    rows(spark, 4).write.format("traces").mode("overwrite").save(str(tmp_path))
    assert same(read(spark, tmp_path), rows(spark, 4))
    assert read(spark, tmp_path).select("id").where("id > 1").count() == 2
    assert traces.sweep(str(tmp_path)) == 0


def test_nothing_is_read_before_the_commit(spark, tmp_path):
    assert read(spark, tmp_path / "none").count() == 0
    rows(spark, 0).write.format("traces").mode("append").save(str(tmp_path / "empty"))
    assert read(spark, tmp_path / "empty").count() == 0
    w = traces.TraceWriter(str(tmp_path), rows(spark, 1).schema)
    message = w.write(iter(rows(spark, 5).collect()))
    assert message.parts[0]["rows"] == 5 and read(spark, tmp_path).count() == 0
    w.abort([message, None])
    assert not list((tmp_path / "parts").iterdir())
    w.commit([w.write(iter(rows(spark, 5).collect())), None])
    assert read(spark, tmp_path).count() == 5


def test_failed_task_leaves_nothing_to_read(spark, tmp_path):
    rows(spark, 10).write.format("traces").mode("append").save(str(tmp_path))
    bad = rows(spark, 40, parts=4).withColumn("score", F.when(F.col("id") == 35, float("nan")).otherwise(F.col("score")))
    with pytest.raises(Exception, match="finite"):
        bad.write.format("traces").mode("append").save(str(tmp_path))
    assert same(read(spark, tmp_path), rows(spark, 10)) and len(list((tmp_path / "receipts").glob("0*.json"))) == 1
    traces.sweep(str(tmp_path))
    assert len(list((tmp_path / "parts").iterdir())) == len(json.loads((tmp_path / "receipts" / f"{0:012d}.json").read_text())["parts"])


def test_changed_parts_and_misfits_fail(spark, tmp_path):
    rows(spark, 3, parts=1).write.format("traces").mode("append").save(str(tmp_path))
    with pytest.raises(Exception, match="is no bigint"):
        spark.read.format("traces").schema("name long").load(str(tmp_path)).collect()
    part = next((tmp_path / "parts").iterdir())
    part.write_text(part.read_text().replace('"id": 1', '"id": 9'))
    with pytest.raises(Exception, match="not what its receipt says"):
        read(spark, tmp_path).collect()
    with pytest.raises(Exception, match="explicit schema"):
        spark.read.format("traces").load(str(tmp_path))


def test_numbers_are_taken_once(tmp_path):
    threads = [threading.Thread(target=lambda i=i: traces._add_receipt(str(tmp_path), {"parts": [], "rows": i, "replaces": False})) for i in range(24)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    found = traces._receipts(str(tmp_path))
    assert [n for n, _ in found] == list(range(24)) and sorted(r["rows"] for _, r in found) == list(range(24))


def drain(spark, path, out, checkpoint, name):
    stream = spark.readStream.format("traces").schema(DDL).load(str(path))
    q = stream.writeStream.format("traces").option("stream", name).option("checkpointLocation", str(checkpoint)).trigger(processingTime="0 seconds").start(str(out))
    q.processAllAvailable()
    q.stop()


def test_stream_reads_and_writes_what_batches_do(spark, tmp_path):
    source, sink = tmp_path / "source", tmp_path / "sink"
    total = 0
    for n in random.Random(1).choices(range(1, 30), k=3):
        rows(spark, n, total).write.format("traces").mode("append").save(str(source))
        total += n
        drain(spark, source, sink, tmp_path / "ckpt", "copy")
        assert same(read(spark, sink), read(spark, source))
    before = len(traces._receipts(str(sink)))
    # a batch whose commit reached the trace but not the checkpoint is run again
    last = max(int(p.name) for p in (tmp_path / "ckpt" / "commits").iterdir() if p.name.isdigit())
    for p in (tmp_path / "ckpt" / "commits").iterdir():
        if p.name.strip(".").removesuffix(".crc") == str(last):
            p.unlink()
    drain(spark, source, sink, tmp_path / "ckpt", "copy")
    assert len(traces._receipts(str(sink))) == before and same(read(spark, sink), rows(spark, total))


def test_stream_refuses_replacement(spark, tmp_path):
    r = traces.TraceStreamReader(str(tmp_path), rows(spark, 1).schema, 1 << 20)
    assert r.initialOffset() == r.latestOffset() == {"receipt": -1}
    traces._add_receipt(str(tmp_path), {"parts": [], "rows": 0, "replaces": True})
    with pytest.raises(ValueError, match="replaces"):
        r.partitions({"receipt": -1}, r.latestOffset())
    with pytest.raises(ValueError, match="needs a name"):
        traces.TraceSource({"path": str(tmp_path)}).streamWriter(rows(spark, 1).schema, False)


def test_columns_are_what_single_values_are(spark):
    """Nested values, nulls on every level, slices and misfits: columns as _to_json and _fit have them, one value at a time."""
    kind = T.StructType.fromDDL("a array<map<string,struct<x:int,y:array<double>>>>, m map<int,string>, d decimal(5,2), s struct<t:date,e:map<string,bigint>>, f float")
    plain = [
        {"a": [{"k": {"x": 1, "y": [0.5, None]}, "l": None}, None, {}], "m": {"3": "c"}, "d": "1.25", "s": {"t": "2024-01-02", "e": {}}, "f": 2.0},
        {"a": None, "m": None, "d": None, "s": None, "f": None},
        {"a": [], "m": {}, "d": "7.00", "s": {"t": None, "e": {"q": None}}, "f": 3},
        {},
    ]
    fields = [f for f in kind if f.name != "m"]  # JSON has no numbers as keys
    for f in fields:
        to = to_arrow_type(f.dataType)
        values = [v.get(f.name) for v in plain]
        column = traces._column(values, f.dataType, to)
        assert column.equals(pa.array([traces._fit(v, f.dataType) for v in values], to)) and column.validate(full=True) is None
        back = traces._values(column, f.dataType)
        assert back == values and traces._values(column[1:3], f.dataType) == values[1:3]
    assert traces._values(pa.array([[(3, "c")], None, []], to_arrow_type(kind["m"].dataType)), kind["m"].dataType) == [{"3": "c"}, None, {}]
    for ddl, bad in (("v bigint", True), ("v array<int>", ["1"]), ("v map<string,int>", [1]), ("v struct<a:string>", {"a": 1}), ("v double", "1"), ("v boolean", 1)):
        f = T.StructType.fromDDL(ddl)[0]
        with pytest.raises(ValueError, match="is no"):
            traces._column([None, bad], f.dataType, to_arrow_type(f.dataType))
