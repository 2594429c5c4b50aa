"""One document of each near-duplicate group stays."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfold.llm.common import cut, fresh
from wayfold.llm.ngram_join import BROADCAST_IDS, row_firsts, with_class


def keep_first(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """The rows of docs without those linked (directly or not) to a smaller doc_id; all columns.

    Rows are judged each by its own text, also where several have one doc_id: of those with equal
    shingles (or no words at all) one stays, of linked ones one, and other texts all stay.
    Rows without words link with nothing. A row with a null doc_id goes if a row with an id has its
    shingles, and stays otherwise.
    """
    gone_id, gone_cls, again_id, of = fresh(docs, "gone", "gone_cls", "again", "cls")
    found = cut(row_firsts(docs, k, num, den))
    gone = found.where("first_id IS NOT NULL AND NOT (doc_id <=> first_id AND cls = first_cls)").select("doc_id", "cls").distinct()
    again = found.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").select("doc_id")
    ids = cut(gone.where("doc_id IS NOT NULL").select("doc_id").union(again).distinct())
    ids = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
    kept = docs.where("doc_id IS NOT NULL").join(ids.withColumnRenamed("doc_id", gone_id), F.col("doc_id") == F.col(gone_id), "left_anti")
    if again.isEmpty() and found.where("doc_id IS NULL").isEmpty():
        return kept
    # where a doc_id is no key, the class of the row's text tells its rows apart
    some = again.withColumnRenamed("doc_id", again_id)
    rest = docs.where("doc_id IS NOT NULL").join(some, F.col("doc_id") == F.col(again_id), "left_semi").unionByName(docs.where("doc_id IS NULL"))
    lost = gone.select(F.col("doc_id").alias(gone_id), F.col("cls").alias(gone_cls))
    rest = with_class(rest, k, of).join(lost, F.col("doc_id").eqNullSafe(F.col(gone_id)) & (F.col(of) == F.col(gone_cls)), "left_anti")
    once = rest.where("doc_id IS NOT NULL").dropDuplicates(["doc_id", of]).unionByName(rest.where("doc_id IS NULL"))
    return kept.unionByName(once.drop(of))
