"""Repeated ids on equal and other texts, null ids, clashing columns and empty partitions, through all operators and stages."""

import re
from collections import Counter

import pytest
from fixtures import WIDE, odd_rows
from pyspark.sql import functions as F

from wayfold.llm import decontamination, lm_scoring, mixing, near_dups, ngram_join, quality_classifier, quality_rules, sharding, suffix_dedup, token_counts

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(params=[3, 60])
def odd(request, spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(request.param))
    yield spark.createDataFrame([(*r, 1, "v", 7, "z", "q") for r in odd_rows()], WIDE)
    spark.conf.set("spark.sql.shuffle.partitions", before)


@pytest.fixture
def labels(spark):
    return spark.createDataFrame([(i, i % 2, None) for i in range(12)] + [(None, 1, 0), (5, None, 1), (5, 1, 0)], "doc_id long, quality int, toxic int")


def ids(rows):
    return Counter(r[0] for r in rows)


def test_operators_give_every_row(odd, labels):
    rows = odd_rows()
    out = {
        "op1": suffix_dedup.dedup(odd),
        "op4": ngram_join.join_components(odd),
        "op5": quality_rules.judge(odd, labels),
        "op7": sharding.assign(odd),
        "op8": lm_scoring.score(odd, 1 << 12, 1 << 13),
        "op9": mixing.taken(odd, block=64),
        "op10": quality_classifier.classify(odd, quality_classifier.train(odd, labels)),
    }
    got = {k: df.collect() for k, df in out.items()}
    assert {k: ids((r.doc_id,) for r in v) for k, v in got.items()} == dict.fromkeys(got, ids(rows))
    size = Counter((r[0], len((r[1] or "").encode())) for r in rows)
    assert Counter((r.doc_id, r.n_bytes) for r in got["op1"]) == size
    assert Counter((r.doc_id, r["size"] - 1) for r in got["op7"]) == size
    words = Counter((r[0], len(WORD.findall(r[1] or ""))) for r in rows)
    assert Counter((r.doc_id, r.n_words) for r in got["op5"]) == words == Counter((r.doc_id, r["size"]) for r in got["op9"])
    assert Counter((r.doc_id, r.n_tokens - 1) for r in got["op8"]) == words
    # equal rows are judged alike: what tells a row's text, and what was found for it
    alike = {"op1": ("n_bytes", "kept_sha256"), "op4": ("n_shingles", "component_id"), "op5": ("word_chars", "kept"), "op8": ("base_score", "score"), "op10": ("expected_grade", "kept")}
    for k, (text, verdict) in alike.items():
        found = {}
        for r in got[k]:
            found.setdefault((r.doc_id, r[text]), set()).add(r[verdict])
        assert all(len(v) == 1 for v in found.values()), k
    assert all(r.taken <= 3 * r["size"] for r in got["op9"])
    shards = Counter(r.shard for r in got["op7"])
    assert len(shards) == 8 and max(shards.values()) - min(shards.values()) <= 1
    assert sum(r.n_docs for r in token_counts.histogram(odd).collect()) == len(rows)


def test_contamination_of_odd_rows(odd, spark):
    rows = odd_rows()
    item = " ".join((rows[9][1] or rows[8][1]).split()[:40])
    bench = spark.createDataFrame([(1, item), (1, item), (None, None)], "item_id long, text string")
    hit = [r[0] for r in rows if item in " ".join((r[1] or "").split())]
    assert hit and Counter(r.doc_id for r in decontamination.contaminated(odd, bench).collect()) == Counter(hit * 2)
    left = decontamination.clean(odd, bench)
    assert left.columns == odd.columns and ids(left.collect()) == ids(rows) - Counter(hit)


def test_stages_carry_clashing_columns(odd, labels):
    model = quality_classifier.train(odd, labels)
    clash = odd.withColumnsRenamed({"id": "_gone", "val": "_row", "size": "_slot"}).withColumn("_cls", F.lit(1))
    for df in (quality_classifier.select_good(clash, model), near_dups.keep_first(clash), mixing.mix_table(clash, block=64)):
        assert df.columns == clash.columns
        assert set(ids(df.collect())) <= set(ids(odd_rows()))
    kept = near_dups.keep_first(clash).collect()
    text = lambda t: " ".join(WORD.findall((t or "").lower()))
    assert len({(r.doc_id, text(r.text)) for r in kept if r.doc_id is not None and text(r.text)}) == len([r for r in kept if r.doc_id is not None and text(r.text)])
    assert sharding.shard_table(clash.drop("shard")).columns == [*clash.drop("shard").columns, "shard", "slot"]
