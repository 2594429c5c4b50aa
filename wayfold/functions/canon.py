"""Fingerprints and request projections."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NULL = "\x00null"


def fingerprint(*columns: str | Column) -> Column:
    """sha256 over explicitly cast columns; the separator is a control character, nulls have a sentinel."""
    cols = [F.col(c) if isinstance(c, str) else c for c in columns]
    return F.sha2(F.concat_ws("\x1f", *[F.coalesce(c.cast("string"), F.lit(NULL)) for c in cols]), 256)


def json_fingerprint(js: Column) -> Column:
    """sha256 of a JSON text with its object keys sorted and no blanks, whatever their order was."""
    return F.sha2(F.to_json(F.parse_json(js)), 256)


def identifier(digest: Column, length: int = 24) -> Column:
    """The first characters of a digest, used as an id."""
    return F.substring(digest, 1, length)


def request(record: Column) -> Column:
    """A labelled record without what a model must not see."""
    return record.dropFields("label", "src", "_meta")


def criteria(moves: Column, prefix: str = "Go ") -> Column:
    """map of every legal move to its criterion text."""
    return F.map_from_arrays(moves, F.transform(moves, lambda m: F.concat(F.lit(prefix), m)))


def safe_path(path: Column) -> Column:
    """Relative, without parent steps, blanks at the ends, or empty parts."""
    return path.rlike(r"^[^/\\\s][^\\]*$") & ~path.rlike(r"(^|/)\.{1,2}(/|$)|//|\s$") & ~path.rlike(r"^[A-Za-z]:")
