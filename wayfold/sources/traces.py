"""A Spark data source of append-only traces: JSON lines that exist once a receipt names them.

    spark.dataSource.register(TraceSource)
    df.write.format("traces").mode("append").save(path)
    spark.read.format("traces").schema(ddl).load(path)

A task writes its rows to a part of its own; the receipt (parts with their SHA-256, rows and bytes) is written by the commit
of the job alone, under the next number, in one move that replaces nothing. So rows of a failed task or job are never read,
and what is read is held against the receipt's numbers. A receipt may replace all before it (mode overwrite).

The stream reader's offset is the number of the last receipt. The stream writer puts the stream's name and the batch number into
its receipts; a batch that was committed before a crash is not committed twice.

Folders may be on any file system that pyarrow opens. On stores without an exclusive move (object stores) receipts of one
path must come from one job at a time.
"""

from __future__ import annotations

import datetime
import hashlib
import itertools
import json
import math
import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceStreamReader, DataSourceStreamWriter, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import ArrayType, BooleanType, DataType, DateType, DecimalType, DoubleType, FloatType, IntegralType, MapType, StringType, StructType, TimestampNTZType, TimestampType

#: Bytes of a part that one task reads.
SPLIT_BYTES = 32 << 20
#: Rows that the reader passes on at once.
ROWS = 4096
_encode = json.JSONEncoder(ensure_ascii=False).encode


def _open(path: str) -> tuple[fs.FileSystem, str]:
    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), os.path.abspath(path))


def _receipts(path: str) -> list[tuple[int, dict]]:
    """(number, receipt) in their order; numbers have 12 digits."""
    store, base = _open(path)
    found = store.get_file_info(fs.FileSelector(f"{base}/receipts", allow_not_found=True))
    out = []
    for f in sorted(found, key=lambda f: f.base_name):
        if f.base_name.removesuffix(".json").isdigit():
            with store.open_input_stream(f.path) as s:
                out.append((int(f.base_name.removesuffix(".json")), json.loads(s.readall())))
    return out


def _add_receipt(path: str, receipt: dict) -> int:
    """Writes the receipt under the next free number and returns it."""
    store, base = _open(path)
    store.create_dir(f"{base}/receipts")
    beside = f"{base}/receipts/_{uuid.uuid4().hex}"
    with store.open_output_stream(beside) as s:
        s.write(json.dumps(receipt, sort_keys=True).encode())
    while True:
        number = max([n for n, _ in _receipts(path)], default=-1) + 1
        place = f"{base}/receipts/{number:012d}.json"
        try:
            if isinstance(store, fs.LocalFileSystem):
                os.link(beside, place)  # fails if another job took the number
                os.unlink(beside)
            elif store.get_file_info(place).type == fs.FileType.NotFound:
                store.move(beside, place)
            else:
                continue
            return number
        except FileExistsError:
            continue


def sweep(path: str) -> int:
    """Deletes parts that no receipt names (of failed tasks); only while nothing writes. The number of parts."""
    store, base = _open(path)
    named = {p["name"] for _, r in _receipts(path) for p in r["parts"]}
    loose = [f.path for f in store.get_file_info(fs.FileSelector(f"{base}/parts", allow_not_found=True)) if f.base_name not in named]
    for f in loose:
        store.delete_file(f)
    return len(loose)


def _to_json(v):
    """A value as JSON has it; a row (tuple with names) becomes an object."""
    if hasattr(v, "asDict"):
        return {k: _to_json(x) for k, x in v.asDict().items()}
    if isinstance(v, dict):
        return {str(k): _to_json(x) for k, x in v.items()}
    if isinstance(v, (list, tuple)):
        return [_to_json(x) for x in v]
    if isinstance(v, float) and not math.isfinite(v):
        raise ValueError("a trace holds finite numbers only")
    return v.isoformat() if isinstance(v, (datetime.date, datetime.datetime)) else v if v is None or isinstance(v, (str, bool, int, float)) else str(v)


def _fit(v, kind: DataType):
    """A JSON value as kind, or ValueError: nothing is bent to fit."""
    if v is None:
        return None
    if isinstance(kind, StructType):
        if isinstance(v, dict):
            return {f.name: _fit(v.get(f.name), f.dataType) for f in kind}
    elif isinstance(kind, MapType):
        if isinstance(v, dict):
            return [(_fit(k, kind.keyType), _fit(x, kind.valueType)) for k, x in v.items()]
    elif isinstance(kind, ArrayType):
        if isinstance(v, list):
            return [_fit(x, kind.elementType) for x in v]
    elif isinstance(kind, StringType):
        if isinstance(v, str):
            return v
    elif isinstance(kind, BooleanType):
        if isinstance(v, bool):
            return v
    elif isinstance(kind, IntegralType):
        if isinstance(v, int) and not isinstance(v, bool):
            return v
    elif isinstance(kind, (DoubleType, FloatType)):
        if isinstance(v, (int, float)) and not isinstance(v, bool):
            return float(v)
    elif isinstance(kind, (TimestampType, TimestampNTZType)):
        at = datetime.datetime.fromisoformat(v)
        return at.replace(tzinfo=datetime.timezone.utc) if isinstance(kind, TimestampType) and at.tzinfo is None else at
    elif isinstance(kind, DateType):
        return datetime.date.fromisoformat(v)
    elif isinstance(kind, DecimalType):
        import decimal

        return decimal.Decimal(str(v))
    raise ValueError(f"{v!r} is no {kind.simpleString()}")


#: Types whose values JSON has as they are, with the only Python types that they are read from.
_PLAIN = ((StringType, {str}), (BooleanType, {bool}), (IntegralType, {int}), ((DoubleType, FloatType), {float}))


def _plain(kind: DataType) -> set | None:
    return next((found for t, found in _PLAIN if isinstance(kind, t)), None)


def _column(values: list, kind: DataType, to: pa.DataType) -> pa.Array:
    """_fit of all values of a column, as one array: nested values level by level, so that what is plain is looked at once a column."""
    if plain := _plain(kind):
        if {*map(type, values)} <= plain | {type(None)}:
            return pa.array(values, to)
    elif isinstance(kind, (StructType, MapType, ArrayType)):
        holder = list if isinstance(kind, ArrayType) else dict
        if {*map(type, values)} <= {holder, type(None)}:
            gone = pa.array([v is None for v in values], pa.bool_())
            if isinstance(kind, StructType):
                held = [v or {} for v in values]
                parts = [_column([v.get(f.name) for v in held], f.dataType, to[i].type) for i, f in enumerate(kind)]
                return pa.StructArray.from_arrays(parts, fields=list(to), mask=gone) if parts else pa.array(values, to)
            ends = [0, *itertools.accumulate(len(v) if v else 0 for v in values)]
            if isinstance(kind, ArrayType):
                inner = _column([x for v in values if v for x in v], kind.elementType, to.value_type)
                return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), inner, type=to, mask=gone)
            keys = _column([k for v in values if v for k in v], kind.keyType, to.key_type)
            inner = _column([x for v in values if v for x in v.values()], kind.valueType, to.item_type)
            return pa.MapArray.from_arrays(pa.array(ends, pa.int32()), keys, inner, type=to, mask=gone)
    return pa.array([_fit(v, kind) for v in values], to)


def _values(column: pa.Array, kind: DataType) -> list:
    """_to_json of all values of a column, nested values level by level."""
    if isinstance(kind, (DoubleType, FloatType)) and not pc.all(pc.is_finite(column)).as_py() and len(column) > column.null_count:
        raise ValueError("a trace holds finite numbers only")
    if _plain(kind):
        return column.to_pylist()
    if isinstance(kind, (StructType, MapType, ArrayType)):
        there = column.is_valid().to_pylist()
        if isinstance(kind, StructType):
            parts = [_values(c, f.dataType) for c, f in zip(column.flatten(), kind, strict=True)]
            held = [dict(zip(kind.names, v, strict=True)) for v in zip(*parts, strict=True)] if parts else [{} for _ in there]
        else:
            ends = column.offsets.to_pylist()
            if isinstance(kind, ArrayType):
                inner = _values(column.values, kind.elementType)
                held = [inner[a:b] for a, b in itertools.pairwise(ends)]
            else:
                pairs = [*zip(map(str, column.keys.to_pylist()), _values(column.items, kind.valueType), strict=True)]
                held = [dict(pairs[a:b]) for a, b in itertools.pairwise(ends)]
        return [v if ok else None for v, ok in zip(held, there, strict=True)]
    return [_to_json(v) for v in column.to_pylist()]


@dataclass
class Written(WriterCommitMessage):
    parts: list[dict] = field(default_factory=list)


class _Parts:
    """Writing of one task's rows, and the removal of parts."""

    def __init__(self, path: str, schema: StructType, overwrite: bool = False) -> None:
        self.path, self.names, self.overwrite = path, schema.names, overwrite

    def write(self, rows: Iterator) -> Written:
        return self.put(({k: _to_json(v) for k, v in zip(self.names, row, strict=True)} for row in rows))

    def put(self, rows: Iterator[dict]) -> Written:
        store, base = _open(self.path)
        store.create_dir(f"{base}/parts")
        name, digest, n, size = f"{uuid.uuid4().hex}.jsonl", hashlib.sha256(), 0, 0
        with store.open_output_stream(f"{base}/parts/{name}") as out:
            for row in rows:
                line = (_encode(row) + "\n").encode()
                digest.update(line)
                out.write(line)
                n, size = n + 1, size + len(line)
        if not n:
            store.delete_file(f"{base}/parts/{name}")
            return Written()
        return Written([{"name": name, "sha256": digest.hexdigest(), "rows": n, "bytes": size}])

    def remove(self, messages) -> None:
        store, base = _open(self.path)
        for p in [p for m in messages if m is not None for p in m.parts]:
            store.delete_file(f"{base}/parts/{p['name']}")

    def receipt(self, messages, **more) -> dict:
        parts = sorted((p for m in messages if m is not None for p in m.parts), key=lambda p: p["name"])
        return {"parts": parts, "rows": sum(p["rows"] for p in parts), "replaces": self.overwrite, **more}


class TraceWriter(_Parts, DataSourceWriter):
    def commit(self, messages) -> None:
        _add_receipt(self.path, self.receipt(messages))

    def abort(self, messages) -> None:
        self.remove(messages)


class TraceArrowWriter(TraceWriter, DataSourceArrowWriter):
    """The same from Arrow batches, which are turned column by column."""

    def __init__(self, path: str, schema: StructType, overwrite: bool = False) -> None:
        super().__init__(path, schema, overwrite)
        self.schema = schema

    def write(self, rows: Iterator[pa.RecordBatch]) -> Written:
        return self.put(row for batch in rows for row in _values(batch.to_struct_array(), self.schema))


class TraceStreamWriter(_Parts, DataSourceStreamWriter):
    def __init__(self, path: str, schema: StructType, stream: str) -> None:
        super().__init__(path, schema)
        self.stream = stream

    def commit(self, messages, batchId: int) -> None:  # noqa: N803
        if any(r.get("stream") == self.stream and r.get("batch") == batchId for _, r in _receipts(self.path)):
            self.remove(messages)  # the batch was committed before a restart
            return
        _add_receipt(self.path, self.receipt(messages, stream=self.stream, batch=batchId))

    def abort(self, messages, batchId: int) -> None:  # noqa: N803
        self.remove(messages)


@dataclass
class Piece(InputPartition):
    """Lines of a part that begin in [start, end); whole: the part's digest and rows, if the piece is all of it."""

    part: str
    start: int
    end: int
    whole: dict | None = None

    def __post_init__(self) -> None:
        super().__init__(self.part)


class _Reading:
    def __init__(self, path: str, schema: StructType, split: int) -> None:
        self.path, self.schema, self.split = path, schema, split

    def pieces(self, receipts: list[dict]) -> list[Piece]:
        out = []
        for p in (p for r in receipts for p in r["parts"]):
            ends = [*range(self.split, p["bytes"], self.split), p["bytes"]]
            out += [Piece(p["name"], a, b, p if len(ends) == 1 else None) for a, b in zip([0, *ends], ends)]
        return out

    def read(self, piece: Piece) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        wanted = to_arrow_schema(self.schema)
        store, base = _open(self.path)
        rows: list[dict] = []
        n, digest = 0, hashlib.sha256()

        def batch():
            return pa.RecordBatch.from_arrays([_column([r.get(f.name) for r in rows], f.dataType, to.type) for f, to in zip(self.schema, wanted, strict=True)], schema=wanted)

        with store.open_input_file(f"{base}/parts/{piece.part}") as raw:
            at = max(0, piece.start - 1)
            raw.seek(at)
            lines = _lines(raw)
            if piece.start:  # the line that began before belongs to the piece before
                at += len(next(lines, b""))
            for line in lines:
                if at >= piece.end:
                    break
                at += len(line)
                digest.update(line)
                rows.append(json.loads(line))
                n += 1
                if len(rows) == ROWS:
                    yield batch()
                    rows = []
        if piece.whole and (n != piece.whole["rows"] or digest.hexdigest() != piece.whole["sha256"]):
            raise ValueError(f"{piece.part} is not what its receipt says")
        if rows:
            yield batch()


def _lines(raw, size: int = 1 << 20) -> Iterator[bytes]:
    """Lines with their ends, from where raw stands."""
    rest = b""
    while chunk := raw.read(size):
        *whole, rest = (rest + chunk).split(b"\n")
        for line in whole:
            yield line + b"\n"
    if rest:
        yield rest


class TraceReader(_Reading, DataSourceReader):
    def partitions(self) -> list[Piece]:
        live: list[dict] = []
        for _, r in _receipts(self.path):
            live = [r] if r["replaces"] else [*live, r]
        return self.pieces(live) or [Piece("", 0, 0)]

    def read(self, piece: Piece) -> Iterator[pa.RecordBatch]:
        return super().read(piece) if piece.part else iter(())


class TraceStreamReader(_Reading, DataSourceStreamReader):
    """Receipts in their order; one that replaces others cannot be followed and is an error."""

    def initialOffset(self) -> dict:  # noqa: N802
        return {"receipt": -1}

    def latestOffset(self) -> dict:  # noqa: N802
        return {"receipt": max([n for n, _ in _receipts(self.path)], default=-1)}

    def partitions(self, start: dict, end: dict) -> list[Piece]:
        new = [r for n, r in _receipts(self.path) if start["receipt"] < n <= end["receipt"]]
        if any(r["replaces"] for r in new):
            raise ValueError("a receipt replaces what the stream has read")
        return self.pieces(new)

    def commit(self, end: dict) -> None:
        """Receipts stay: they are the trace."""


class TraceSource(DataSource):
    """Options: path; split (bytes a task reads); stream (name of a writing stream)."""

    @classmethod
    def name(cls) -> str:
        return "traces"

    def schema(self) -> str:
        raise ValueError("a trace is read with an explicit schema")

    def _reading(self, schema: StructType) -> tuple:
        return self.options["path"], schema, int(self.options.get("split", SPLIT_BYTES))

    def reader(self, schema: StructType) -> TraceReader:
        return TraceReader(*self._reading(schema))

    def streamReader(self, schema: StructType) -> TraceStreamReader:  # noqa: N802
        return TraceStreamReader(*self._reading(schema))

    def writer(self, schema: StructType, overwrite: bool) -> TraceArrowWriter:
        return TraceArrowWriter(self.options["path"], schema, overwrite)

    def streamWriter(self, schema: StructType, overwrite: bool) -> TraceStreamWriter:  # noqa: N802
        if not self.options.get("stream"):
            raise ValueError("a writing stream needs a name (option stream)")
        return TraceStreamWriter(self.options["path"], schema, self.options["stream"])
