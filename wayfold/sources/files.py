"""JSON-lines, JSON, CSV and archive sources and sinks; manifests; incremental backup.

Spark's readers and writers move the data, so any file system that Spark knows will do and
a write is committed as a whole. Archives are unpacked member by member on the executors.
"""

from __future__ import annotations

import hashlib
import io
import json
import zipfile
from collections.abc import Iterator, Mapping, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from wayfold.functions.canon import safe_path
from wayfold.operators.ranking import first_rows


def read_jsonl(spark: SparkSession, path: str | Sequence[str], schema: StructType | str) -> DataFrame:
    """One row per line; blank lines are skipped, lines that do not parse or do not fit fail the read."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def read_documents(spark: SparkSession, path: str | Sequence[str], schema: StructType | str) -> DataFrame:
    """One row per file that holds one JSON document, with its path."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path).withColumn("path", F.col("_metadata.file_path"))


def write_jsonl(df: DataFrame, path: str, replace: bool = False) -> None:
    """Written to a temporary place and committed as a whole; an existing path is an error unless replace."""
    df.write.mode("overwrite" if replace else "errorifexists").json(path)


def write_csv(df: DataFrame, path: str, one_file: bool = True) -> None:
    """With a header; arrays, maps and structs as JSON. One file is for reports, which are small."""
    nested = {f.name: F.to_json(f.name) for f in df.schema if f.dataType.typeName() in ("array", "map", "struct")}
    out = df.withColumns(nested)
    (out.coalesce(1) if one_file else out).write.mode("errorifexists").option("header", True).csv(path)


def content_digest(df: DataFrame) -> str:
    """A digest of the rows whatever their order and partitioning: sum of 64-bit row hashes and the count."""
    hashed = df.select(F.xxhash64(*[F.to_json(F.struct(*df.columns))]).alias("h"))
    row = hashed.agg(F.sum(F.col("h").cast("decimal(38,0)")).alias("s"), F.count(F.lit(1)).alias("c")).first()
    return f"{row['c']}:{row['s']}"


def write_once(df: DataFrame, path: str) -> bool:
    """Writes df if path is new; accepts an equal earlier write; raises if it differs. True if written."""
    from pyspark.errors import AnalysisException

    try:
        df.write.mode("errorifexists").parquet(path)
        return True
    except AnalysisException as e:
        if "PATH_ALREADY_EXISTS" not in str(e):
            raise
    stored = df.sparkSession.read.schema(df.schema).parquet(path)
    if content_digest(stored) != content_digest(df):
        raise ValueError(f"{path} exists with other contents")
    return False


def read_receipts(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """Receipts below path, whatever the folder; work in flight has none yet and so is invisible."""
    return spark.read.schema(schema).option("recursiveFileLookup", True).option("multiLine", True).option("pathGlobFilter", "receipt*.json").json(path)


def concatenated(parts: Sequence[DataFrame], digests: Sequence[str] | None = None) -> DataFrame:
    """Parts in their documented order, with part_no; each is checked against its digest if given."""
    out = None
    for k, part in enumerate(parts):
        if digests is not None and content_digest(part) != digests[k]:
            raise ValueError(f"part {k} is not what its digest says")
        part = part.withColumn("part_no", F.lit(k))
        out = part if out is None else out.unionByName(part)
    return out


def _members(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in it:
        for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
            with zipfile.ZipFile(io.BytesIO(content)) as archive:
                for name in archive.namelist():
                    if not name.endswith("/"):
                        body = archive.read(name)
                        yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([name]), pa.array([body], pa.binary())], names=["archive", "member", "content"])


def zip_members(spark: SparkSession, path: str) -> DataFrame:
    """archive, member, content of all files in the ZIP archives at path."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(_members, "archive string, member string, content binary")


def read_zip_jsonl(spark: SparkSession, path: str, schema: StructType | str, members: str = r"\.jsonl$") -> DataFrame:
    """Rows of the JSON-lines members, with archive, member and line (from 0)."""
    lines = zip_members(spark, path).where(F.col("member").rlike(members))
    lines = lines.select("archive", "member", F.posexplode(F.split(F.decode("content", "UTF-8"), "\n")).alias("line", "js")).where(F.trim("js") != "")
    row = F.from_json("js", schema, {"mode": "FAILFAST"})
    return lines.withColumn("row", row).select("archive", "member", "line", "row.*")


def pack(members: Mapping[str, bytes]) -> bytes:
    """A ZIP archive that is the same for the same members: sorted names, one fixed time."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as archive:
        for name in sorted(members):
            info = zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0))
            info.compress_type = zipfile.ZIP_DEFLATED
            archive.writestr(info, members[name])
    return out.getvalue()


def bundle(evidence: DataFrame, name: str, content: str) -> tuple[bytes, DataFrame]:
    """An archive of a small evidence table (one member per row) and its manifest of digests."""
    rows = evidence.select(name, F.col(content).cast("binary")).collect()
    return pack({r[0]: bytes(r[1]) for r in rows}), manifest_of(evidence, name, content)


def manifest_of(files: DataFrame, name: str = "member", content: str = "content") -> DataFrame:
    """name, sha256, bytes of each file."""
    return files.select(F.col(name).alias("name"), F.sha2(F.col(content), 256).alias("sha256"), F.octet_length(content).cast("long").alias("bytes"))


def against_manifest(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """Violations: files that are missing, unexpected or changed, or whose path is unsafe; empty if all is well."""
    have = manifest_of(files).withColumnRenamed("sha256", "found").drop("bytes")
    both = manifest.select("name", "sha256").join(have, "name", "full_outer")
    why = F.when(F.col("found").isNull(), "missing").when(F.col("sha256").isNull(), "unexpected").when(F.col("found") != F.col("sha256"), "changed").when(~safe_path(F.col("name")), "unsafe path")
    return both.select("name", why.alias("violation")).where("violation IS NOT NULL")


def dataset_manifest(spark: SparkSession, parts: Mapping[str, DataFrame]) -> DataFrame:
    """name, digest, rows of every part of a dataset."""
    rows = [(name, digest := content_digest(df), int(digest.split(":")[0])) for name, df in sorted(parts.items())]
    return spark.createDataFrame(rows, "name string, digest string, rows long")


def joined_parts(parts: DataFrame, order: str, content: str, sha256: str) -> bytes:
    """Ordered binary parts as one file, which must have the digest."""
    whole = b"".join(bytes(r[0]) for r in parts.orderBy(order).select(content).toLocalIterator())
    if hashlib.sha256(whole).hexdigest() != sha256:
        raise ValueError("the parts do not make the file that the digest names")
    return whole


def to_back_up(files: DataFrame, index: DataFrame) -> DataFrame:
    """Files that the index does not have with this content."""
    return files.join(index.select("name", "sha256").distinct(), ["name", "sha256"], "left_anti")


def latest_versions(index: DataFrame) -> DataFrame:
    """The newest entry of every name."""
    return first_rows(index, ["name"], [F.col("version").desc(), F.col("archive")])


def keep_newest(versions: DataFrame, key: Sequence[str], order: Sequence[Column], n: int = 2) -> DataFrame:
    """The newest n versions of each key, with their rank from 1."""
    return versions.withColumn("rank", F.row_number().over(Window.partitionBy(*key).orderBy(*order)).cast("long")).where(F.col("rank") <= n)


def load_config(text: str, required: Sequence[str]) -> dict:
    """A configuration document with exactly the required keys."""
    value = json.loads(text)
    if sorted(value) != sorted(required):
        raise ValueError(f"keys {sorted(value)} are not {sorted(required)}")
    return value
