"""The queries of this subpackage against their oracles, and the pipeline's stages."""

import re

import pytest
from conftest import rows_of, rows_of_duck

import corpus_pipeline
from wayfold.llm import decontamination, quality_classifier
from wayfold.llm.queries import QUERIES, SQL

ASCII = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_oracle(spark, data, duck, name):
    got, want = rows_of(QUERIES[name](spark, data)), rows_of_duck(duck.sql(SQL[name]))
    assert got == want


def test_a_query_for_every_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))


def tokens(text):
    return re.findall(r"[0-9a-z\x80-\U0010ffff]+", (text or "").translate(ASCII))


def shingles(text, k=5):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(ASCII))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def groups(rows):
    """The smallest id of each row's group, from all pairs."""
    sets, root = {i: shingles(t) for i, t in rows}, {i: i for i, _ in rows}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for n, i in enumerate(ids):
        for j in ids[n + 1 :]:
            a, b = sets[i], sets[j]
            if a and b and 5 * min(len(a), len(b)) >= 4 * max(len(a), len(b)):
                both = len(a & b)
                if 100 * both >= 80 * (len(a) + len(b) - both):
                    x, y = find(i), find(j)
                    root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def test_pipeline_stages(spark, data, tmp_path):
    """Each stage against a plain one, on what the stage before has kept."""
    docs = spark.read.parquet(f"{data}/documents.parquet")
    columns = docs.columns
    kept = [{r.doc_id: r for r in docs.collect()}]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, data).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        assert docs.columns[: len(columns)] == columns, name
        kept.append({r.doc_id: r for r in docs.collect()})
        assert set(kept[-1]) <= set(kept[-2]) and all(r[:5] == kept[0][i][:5] for i, r in kept[-1].items()), name
    every, good, alone, clean, mixed, _ = kept
    # quality: the verdicts of the classifier, which its own tests hold against a plain likelihood
    frame = spark.read.parquet(f"{data}/documents.parquet")
    model = quality_classifier.train(frame, spark.read.parquet(f"{data}/labels.parquet"))
    assert set(good) == {r.doc_id for r in quality_classifier.classify(frame, model).collect() if r.kept} and 0 < len(good) < len(every)
    first = groups([(i, r.text) for i, r in good.items()])
    assert set(alone) == {i for i in good if first[i] == i}
    # a document goes if and only if an item is in it; items as they stand are always found, edited ones nearly so
    items = [tokens(r.text) for r in spark.read.parquet(f"{data}/benchmark.parquet").collect()]
    text = {i: f" {' '.join(tokens(r.text))} " for i, r in alone.items()}
    exact = {i for i, t in text.items() if any(x and f" {' '.join(x)} " in t for x in items)}
    assert not exact & set(clean)
    for i in set(alone) - set(clean) - exact:
        t = tokens(alone[i].text)
        assert any(x and decontamination.best_distance(x, t, len(x))[0] <= int(0.2 * len(x)) for x in items)
    assert set(mixed) <= set(clean)
    shards = docs.groupBy("shard").count().collect()
    assert len(shards) == 8 and max(r["count"] for r in shards) - min(r["count"] for r in shards) <= 1
    assert docs.columns == [*columns, "shard", "slot"] and docs.select("shard", "slot").distinct().count() == docs.count()


def test_run(spark, data):
    assert corpus_pipeline.run(spark, data).count() > 0
