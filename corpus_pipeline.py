"""A corpus pipeline: quality classifier, near-duplicate join, decontamination, mixing, sharding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet
and read again as the next stage's docs. All but the last return the columns of documents.

Edge cases. Every stage gives an empty table for an empty one and carries columns beyond those of documents, whatever their
names. A null or empty text is scored by its shape (quality), links with nothing (near_duplicates), holds no item (decontaminate), goes
with the block that it stands in (mix) and takes one place (shard). Of rows with one doc_id and equal shingles one stays, other texts of that doc_id
are judged by themselves; a row without an id goes if a row with an id has its shingles. Equal rows are scored and decontaminated
alike; the mix and the shards place them one by one. A null source is a source, a null language a language.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from wayfold.llm import decontamination, mixing, near_dups, quality_classifier, sharding
from wayfold.llm.common import shared_dir
from wayfold.sources.shared import drop


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Quality classifier, fitted on the labels of docs; documents that it rejects go."""
    model = quality_classifier.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality_classifier.select_good(docs, model)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Jaccard join of five-word shingles at 0.8; the smallest doc_id of each group stays."""
    return near_dups.keep_first(docs, 5, 80, 100)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a benchmark passage (up to a fifth of its tokens edited) go."""
    return decontamination.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their target weights: every document as often as the mix takes it, in the order of the schedule."""
    return mixing.mix_table(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Eight shards, each with the mixture of the whole; adds shard and slot."""
    return sharding.shard_table(docs)


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("decontaminate", decontaminate),
    ("mix", mix),
    ("shard", shard),
]

#: The classifier is fitted numerically and has no SQL form; tests/llm/test_pipeline.py holds each stage against a plain one on its own input.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written in the shared folder before the next reads it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    base = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    last = None
    for k, (name, stage) in enumerate(STAGES):
        path = f"{base}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if last:  # nothing reads what the stage before has written any more
            drop(spark, last)
        last = path
    return docs
