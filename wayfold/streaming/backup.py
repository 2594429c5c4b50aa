"""Incremental backup of files by content: batches of a stream that compare and swap a versioned index.

    base/objects/...        contents of one batch (name, sha256, content), written once
    base/index/...          index rows (name, sha256, bytes, version, archive) of one batch, or of a compaction
    base/versions/N.json    what version N consists of; written by one exclusive move

A batch reads the newest version, keeps the files whose content the index does not hold for their name, writes their contents and index rows,
and claims the next version. If another writer took it first, the index rows are compared again with what it wrote. A version
names its stream and batch, so a batch that is run again after a crash finds itself done. Nothing that a version names is ever
changed or deleted; a crash leaves at most unnamed folders.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from wayfold.sources import store
from wayfold.sources.files import latest_versions

FILES = "path string, modificationTime timestamp, length long, content binary"
INDEX = "name string, sha256 string, bytes long, version long, archive string"
#: Parts of the index after which a version writes it anew, newest entries only.
COMPACT = 16


def versions(spark: SparkSession, base: str) -> list[int]:
    return [int(n.removesuffix(".json")) for n in store.names(spark, f"{base}/versions")]


def _version(spark: SparkSession, base: str, number: int) -> dict:
    return json.loads(store.read_text(spark, f"{base}/versions/{number:012d}.json"))


def index(spark: SparkSession, base: str, version: int | None = None) -> DataFrame:
    """The index at a version (the newest, if None): all entries that it still holds."""
    known = versions(spark, base)
    if version is None and known:
        version = known[-1]
    if version is None:
        return spark.createDataFrame([], INDEX)
    return spark.read.schema(INDEX).parquet(*[f"{base}/{p}" for p in _version(spark, base, version)["parts"]])


def back_up(files: DataFrame, base: str, stream: str, batch: int) -> int | None:
    """One batch of files (name, content): the version that it made, or None if all was there already.

    Of several contents of one name in a batch the last by its digest is kept; names and contents must not be null.
    """
    spark = files.sparkSession
    hashed = files.where("name IS NOT NULL AND content IS NOT NULL").select("name", F.sha2("content", 256).alias("sha256"), "content")
    hashed = hashed.groupBy("name").agg(F.max_by(F.struct("sha256", "content"), "sha256").alias("f")).select("name", "f.*")
    mine = uuid.uuid4().hex
    objects = None
    while True:
        known = versions(spark, base)
        done = [n for n in known if (v := _version(spark, base, n))["stream"] == stream and v["batch"] == batch]
        if done:
            return done[0]
        held = latest_versions(index(spark, base)).select("name", "sha256")
        if objects is None:
            new = hashed.join(held, ["name", "sha256"], "left_anti")
            new.write.option("compression", "zstd").parquet(f"{base}/objects/{mine}")
            objects = spark.read.schema("name string, sha256 string, content binary").parquet(f"{base}/objects/{mine}")
        number = known[-1] + 1 if known else 0
        rows = objects.join(held, ["name", "sha256"], "left_anti")
        rows = rows.select("name", "sha256", F.octet_length("content").cast("long").alias("bytes"), F.lit(number).cast("long").alias("version"), F.lit(f"objects/{mine}").alias("archive"))
        before = _version(spark, base, known[-1])["parts"] if known else []
        part = f"index/{number:012d}-{uuid.uuid4().hex}"
        if len(before) >= COMPACT:
            rows = latest_versions(index(spark, base).unionByName(rows))
            before = []
        rows.write.parquet(f"{base}/{part}")
        n = spark.read.schema(INDEX).parquet(f"{base}/{part}").where(F.col("version") == number).count()
        if not n:
            return None
        try:
            store.write_new(spark, f"{base}/versions/{number:012d}.json", json.dumps({"stream": stream, "batch": batch, "files": n, "parts": [*before, part]}, sort_keys=True))
            return number
        except store.Exists:
            continue


def backup_stream(files: DataFrame, base: str, checkpoint: str, name: str, seconds: int | None = 300) -> StreamingQuery:
    """A job that backs up a stream of files (name, content) every so many seconds; None: all that is there, then it ends."""

    def sink(batch: DataFrame, number: int) -> None:
        cached = batch.persist()
        back_up(cached, base, name, number)
        cached.unpersist()

    out = files.writeStream.foreachBatch(sink).queryName(name).option("checkpointLocation", checkpoint)
    return (out.trigger(availableNow=True) if seconds is None else out.trigger(processingTime=f"{seconds} seconds")).start()


def folder_stream(spark: SparkSession, folder: str, in_flight: int = 100) -> DataFrame:
    """name (the path), content of the files that appear in a folder, so many at most in a batch."""
    files = spark.readStream.format("binaryFile").schema(FILES).option("maxFilesPerTrigger", in_flight).option("recursiveFileLookup", True).load(folder)
    return files.select(F.col("path").alias("name"), "content")


def restore(spark: SparkSession, base: str, version: int | None = None) -> DataFrame:
    """name, sha256, content, version: the newest content of every file at a version; one that is not its digest fails the read."""
    wanted = latest_versions(index(spark, base, version))
    archives = [r[0] for r in wanted.select("archive").distinct().collect()]  # one a batch that still has a newest file
    if not archives:
        return wanted.select("name", "sha256", F.lit(None).cast("binary").alias("content"), "version")
    held = spark.read.schema("name string, sha256 string, content binary").parquet(*[f"{base}/{a}" for a in archives]).withColumn("archive", F.regexp_extract(F.col("_metadata.file_path"), r"(objects/[0-9a-f]{32})", 1))
    whole = wanted.join(held, ["name", "sha256", "archive"], "left")
    good = F.coalesce(F.sha2("content", 256) == F.col("sha256"), F.lit(False))
    content = F.when(good, F.col("content")).otherwise(F.raise_error(F.concat(F.lit("lost or changed: "), F.col("name"))).cast("binary"))
    return whole.select("name", "sha256", content.alias("content"), "version")
