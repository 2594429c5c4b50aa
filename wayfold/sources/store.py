"""Small files on any file system that Spark knows: read, write once, compare and swap, list."""

from __future__ import annotations

import json
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


class Exists(ValueError):
    """The file is there already."""


def _place(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    place, fs = _place(spark, path)
    return fs.exists(place)


def read_text(spark: SparkSession, path: str) -> str | None:
    """The whole file, or None if there is none."""
    place, fs = _place(spark, path)
    if not fs.exists(place):
        return None
    stream = fs.open(place)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def write_new(spark: SparkSession, path: str, text: str) -> None:
    """The whole file or nothing: written beside its place, then moved there; raises Exists if another was first."""
    jvm = spark._jvm
    place, fs = _place(spark, path)
    beside = jvm.org.apache.hadoop.fs.Path(place.getParent(), f"_{uuid.uuid4().hex}")
    out = fs.create(beside, False)
    out.write(bytearray(text.encode()))
    out.close()
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration())
    never_over = spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
    try:
        context.rename(beside, place, never_over)
    except Py4JJavaError as e:
        fs.delete(beside, False)
        if "FileAlreadyExists" in e.java_exception.getClass().getName():
            raise Exists(path) from None
        raise


def write_same(spark: SparkSession, path: str, value: object) -> bool:
    """A JSON document that never changes: True if written now, False if it was there; raises ValueError if it differs."""
    text = json.dumps(value, sort_keys=True, indent=1)
    try:
        write_new(spark, path, text)
        return True
    except Exists:
        if read_text(spark, path) != text:
            raise ValueError(f"{path} exists with other contents") from None
        return False


def names(spark: SparkSession, folder: str) -> list[str]:
    """Names in a folder, sorted; none if there is no folder. Work in flight (names with an underscore) is left out."""
    place, fs = _place(spark, folder)
    if not fs.exists(place):
        return []
    return sorted(n for s in fs.listStatus(place) if not (n := s.getPath().getName()).startswith(("_", ".")))
