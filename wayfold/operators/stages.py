"""Builds in stages with committed results: data first, receipt last; what a receipt proves is not done again.

A stage is a function of the configuration and of the results before it. Its key is a digest of its name, of the settings
that it declares and of the content digests of its inputs, and its data lie in a folder that the key names. The
receipt (key, inputs, settings, rows, content digest) is written after the data in one move that never replaces
a file, so a build that is killed anywhere leaves whole stages and at most one folder without a receipt, which the next
run writes over. A folder belongs to one configuration and one set of sources: others are refused.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StructType

from wayfold.sources import store


class Changed(ValueError):
    """What a folder holds was made of something else."""


@dataclass(frozen=True)
class Stage:
    """run(config, *inputs) -> DataFrame; settings: the keys of the configuration that it reads."""

    name: str
    inputs: tuple[str, ...]
    run: Callable[..., DataFrame]
    settings: tuple[str, ...] = ()
    #: True for a stage whose rows are faults: any row fails the build
    must_be_empty: bool = False


def _plain(column: Column, kind: DataType) -> Column:
    """Maps as sorted entries, so that equal maps are equal texts."""
    if isinstance(kind, MapType):
        return F.array_sort(F.map_entries(column))
    if isinstance(kind, ArrayType) and isinstance(kind.elementType, (MapType, StructType, ArrayType)):
        return F.transform(column, lambda x: _plain(x, kind.elementType))
    if isinstance(kind, StructType):
        return F.when(column.isNotNull(), F.struct(*[_plain(column[f.name], f.dataType).alias(f.name) for f in kind]))
    return column


def row_text(df: DataFrame) -> Column:
    """A row as one JSON text, nulls included, columns in the order of their names."""
    fields = sorted(df.schema, key=lambda f: f.name)
    return F.to_json(F.struct(*[_plain(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in fields]), {"ignoreNullFields": "false"})


def content(df: DataFrame) -> tuple[str, int]:
    """A digest of the rows with their multiplicity, whatever their order and partitioning, and their number.

    Each row's SHA-256 is cut into four numbers of 60 bits; their sums are combined map-side, so no task sees more than its own rows.
    """
    h = df.select(F.sha2(row_text(df), 256).alias("h"))
    piece = lambda i: F.sum(F.conv(F.substring("h", 1 + 15 * i, 15), 16, 10).cast("decimal(38,0)"))
    row = h.agg(F.count(F.lit(1)).alias("n"), *[piece(i).alias(f"s{i}") for i in range(4)]).first()
    return hashlib.sha256(":".join(str(x) for x in row).encode()).hexdigest(), row["n"]


def _digest(value: object) -> str:
    return hashlib.sha256(json.dumps(value, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


class Build:
    """Stages in their order over a folder. sources: name -> DataFrame, whose contents are part of what the folder is bound to."""

    def __init__(self, spark: SparkSession, folder: str, config: Mapping, sources: Mapping[str, DataFrame], stages: Sequence[Stage]) -> None:
        known = set(sources)
        for s in stages:
            if s.name in known or not set(s.inputs) <= known or not set(s.settings) <= set(config):
                raise ValueError(f"stage {s.name}: a name of its own, inputs before it and settings of the configuration are needed")
            known.add(s.name)
        self.spark, self.folder, self.config, self.sources, self.stages = spark, folder.rstrip("/"), dict(config), dict(sources), list(stages)
        self.ran: list[str] = []

    def _bind(self) -> dict[str, str]:
        """Digests of the sources; the folder keeps them and the configuration, and refuses others."""
        found = {name: content(df)[0] for name, df in sorted(self.sources.items())}
        try:
            store.write_same(self.spark, f"{self.folder}/binding.json", {"configuration": self.config, "sources": found, "stages": [[s.name, *s.inputs] for s in self.stages]})
        except ValueError:
            raise Changed(f"{self.folder} holds a build of another configuration or other sources") from None
        return found

    def receipt(self, name: str) -> dict | None:
        text = store.read_text(self.spark, f"{self.folder}/receipts/{name}.json")
        return None if text is None else json.loads(text)

    def read(self, name: str) -> DataFrame:
        """A committed stage, as its receipt says."""
        if (r := self.receipt(name)) is None:
            raise ValueError(f"stage {name} is not committed")
        return self.spark.read.schema(StructType.fromJson(r["schema"])).parquet(f"{self.folder}/{r['data']}")

    def commit(self, stage: Stage, receipt: dict) -> None:
        """The one step that makes a stage exist."""
        store.write_same(self.spark, f"{self.folder}/receipts/{stage.name}.json", receipt)

    def run(self, verify: bool = False) -> dict[str, DataFrame]:
        """All stages, those without a receipt anew. verify: data of earlier runs are held against the content in their receipts."""
        digests, frames = self._bind(), dict(self.sources)
        for s in self.stages:
            settings = {k: self.config[k] for k in s.settings}
            inputs = {k: digests[k] for k in s.inputs}
            key = _digest([s.name, settings, inputs])
            receipt = self.receipt(s.name)
            if receipt is None:
                data = f"data/{s.name}-{key[:20]}"
                out = s.run(self.config, *[frames[k] for k in s.inputs])
                out.write.mode("overwrite").option("compression", "zstd").parquet(f"{self.folder}/{data}")
                written = self.spark.read.schema(out.schema).parquet(f"{self.folder}/{data}")
                digest, rows = content(written)
                if s.must_be_empty and rows:
                    raise ValueError(f"{s.name}: {rows} faults, first {[tuple(r) for r in written.limit(3).collect()]}")
                receipt = {"stage": s.name, "key": key, "inputs": inputs, "settings": _digest(settings), "rows": rows, "content": digest, "data": data, "schema": out.schema.jsonValue()}
                self.commit(s, receipt)
                self.ran.append(s.name)
            elif receipt["key"] != key:
                raise Changed(f"the receipt of {s.name} is of other inputs or settings")
            elif verify and content(self.read(s.name)) != (receipt["content"], receipt["rows"]):
                raise Changed(f"the data of {s.name} are not what the receipt says")
            digests[s.name], frames[s.name] = receipt["content"], self.read(s.name)
        return frames

    def receipts(self) -> DataFrame:
        """stage, rows, content, key of the committed stages, in their order."""
        found = [r for s in self.stages if (r := self.receipt(s.name))]
        return self.spark.createDataFrame([(r["stage"], r["rows"], r["content"], r["key"]) for r in found], "stage string, rows long, content string, key string")
