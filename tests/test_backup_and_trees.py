"""Content backup with compare and swap, Merkle trees, and identities of prefixes, against plain ones."""

import hashlib
import json
import random

import pytest

from wayfold.operators import merkle, prefixes
from wayfold.operators import trajectory as T
from wayfold.operators.stages import row_text
from wayfold.sources import store
from wayfold.streaming import backup
from wayfold.streaming.episodes import smallest_period


def files(spark, **contents):
    return spark.createDataFrame([(k, None if v is None else bytearray(v.encode())) for k, v in contents.items()], "name string, content binary")


def restored(spark, base, version=None):
    return {r["name"]: (bytes(r["content"]).decode(), r["version"]) for r in backup.restore(spark, base, version).collect()}


def test_backup_keeps_what_changed(spark, tmp_path):
    base = str(tmp_path)
    assert restored(spark, base) == {}
    assert backup.back_up(files(spark, a="1", b="2", n=None), base, "s", 0) == 0
    assert backup.back_up(files(spark, a="1", b="2"), base, "s", 1) is None  # nothing new: no version
    assert backup.back_up(files(spark, a="3", b="2", c="2"), base, "s", 2) == 1
    assert backup.back_up(files(spark, a="9"), base, "s", 2) == 1  # the batch is done
    assert backup.back_up(files(spark, a="1"), base, "s", 3) == 2  # an old content is new again
    assert restored(spark, base) == {"a": ("1", 2), "b": ("2", 0), "c": ("2", 1)}
    assert restored(spark, base, 1) == {"a": ("3", 1), "b": ("2", 0), "c": ("2", 1)} and restored(spark, base, 0) == {"a": ("1", 0), "b": ("2", 0)}


def test_backup_loses_no_race(spark, tmp_path, monkeypatch):
    base, real, raced = str(tmp_path), store.write_new, []

    def race(spark_, path, text):
        if "versions" in path and not raced:  # another writer takes the number first
            raced.append(path)
            backup.back_up(files(spark_, a="1", x="other"), base, "other", 0)
        real(spark_, path, text)

    monkeypatch.setattr(store, "write_new", race)
    assert backup.back_up(files(spark, a="1", b="2"), base, "s", 0) == 1
    assert restored(spark, base) == {"a": ("1", 0), "x": ("other", 0), "b": ("2", 1)}


def test_backup_compacts_and_finds_damage(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(backup, "COMPACT", 2)
    base = str(tmp_path)
    for i in range(5):
        backup.back_up(files(spark, same="s", one=str(i)), base, "s", i)
    assert restored(spark, base) == {"same": ("s", 0), "one": ("4", 4)} and restored(spark, base, 2)["one"] == ("2", 2)
    assert max(len(json.loads(p.read_text())["parts"]) for p in (tmp_path / "versions").glob("0*.json")) == 2
    archive = backup.index(spark, base).where("name = 'same'").first()["archive"]
    spark.createDataFrame([("same", hashlib.sha256(b"s").hexdigest(), bytearray(b"t"))], "name string, sha256 string, content binary").write.mode("overwrite").parquet(f"{base}/{archive}")
    with pytest.raises(Exception, match="lost or changed: same"):
        restored(spark, base)


def test_backup_stream_is_exactly_once(spark, tmp_path):
    source, base, ckpt = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "ckpt")
    source.mkdir()
    for i in range(5):
        (source / f"f{i}").write_text(str(i))
    run = lambda: backup.backup_stream(backup.folder_stream(spark, str(source), 2), base, ckpt, "job", None).awaitTermination()
    run()
    assert backup.versions(spark, base) == [0, 1, 2]  # two files at most in a batch
    (source / "g").write_text("g")
    run()
    last = max(int(p.name) for p in (tmp_path / "ckpt" / "commits").iterdir() if p.name.isdigit())
    for p in (tmp_path / "ckpt" / "commits").iterdir():
        if p.name.strip(".").removesuffix(".crc") == str(last):
            p.unlink()
    run()  # the last batch is run again
    assert backup.versions(spark, base) == [0, 1, 2, 3]
    assert {k.rsplit("/", 1)[1]: v[0] for k, v in restored(spark, base).items()} == {**{f"f{i}": str(i) for i in range(5)}, "g": "g"}


def plain_tree(rows, width, monkey_fan):
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    by = {}
    for key, digest in sorted(rows, key=lambda r: (r[0], r[1])):
        by.setdefault(key // width, []).append(digest)
    largest, depth = max(map(len, by.values()), default=0), 1
    while monkey_fan**depth < largest:
        depth += 1
    nodes = {}
    for leaf, digests in by.items():
        level = list(enumerate(digests))
        for _ in range(depth):
            up = {}
            for at, d in level:
                up.setdefault(at // monkey_fan, []).append(f"{at}:{d}")
            level = [(k, sha("\n".join(v))) for k, v in up.items()]
        nodes[leaf] = (len(digests), level[0][1])
    out = {(0, k): v for k, v in nodes.items()}
    for height in range(1, merkle.HEIGHT + 1):
        up = {}
        for k, v in sorted(nodes.items()):
            up.setdefault(k // monkey_fan, []).append((k, v))
        nodes = {k: (sum(v[0] for _, v in c), sha("\n".join(f"{i}:{v[1]}" for i, v in c))) for k, c in up.items()}
        out |= {(height, k): v for k, v in nodes.items()}
    return out


def table(spark, rows):
    return spark.createDataFrame(rows, "key long, text string").repartition(3)


def test_tree_equals_the_plain_one(spark):
    rng = random.Random(1)
    rows = [(rng.choice([5, rng.randrange(-50, 900)]), rng.choice([None, "a", "b", "é"])) for _ in range(400)] * 2  # a third or more on one key
    df = table(spark, rows)
    hashed = [(r["key"], hashlib.sha256(r["t"].encode()).hexdigest()) for r in df.select("key", row_text(df).alias("t")).collect()]
    got = {(r["level"], r["node"]): (r["rows"], r["digest"]) for r in merkle.tree(df, "key", 16).collect()}
    assert got == plain_tree(hashed, 16, merkle.FAN)
    assert merkle.root(merkle.tree(df, "key", 16)) == merkle.root(merkle.tree(df.orderBy("text"), "key", 16))


def test_rows_reach_their_leaves_by_one_exchange(spark, monkeypatch):
    """Leaves beyond WIDE are placed by ranges, the others by one exchange of keys and 32 bytes; both give the plain tree."""
    df = table(spark, [(i % 40 if i % 3 else 5, f"t{i}") for i in range(900)])
    plan = merkle.leaves(df, "key", 16)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "rangepartitioning" not in plan and "Scan ExistingRDD[leaf" not in plan
    hashed = [(r["key"], hashlib.sha256(r["t"].encode()).hexdigest()) for r in df.select("key", row_text(df).alias("t")).collect()]
    for wide in (10_000, 300, 1):
        monkeypatch.setattr(merkle, "WIDE", wide)
        got = {(r["level"], r["node"]): (r["rows"], r["digest"]) for r in merkle.tree(df, "key", 16).collect()}
        assert got == plain_tree(hashed, 16, merkle.FAN)


def test_changed_ranges_and_revalidation(spark):
    rows = [(i, f"t{i}") for i in range(2000)] + [(None, "n")]
    a = table(spark, rows)
    edits = {17: None, 18: "x", 1500: "y"}
    b = table(spark, [(k, edits.get(k, t)) for k, t in rows if k is None or not 640 <= k < 656] + [(5000, "new")])
    one, two = merkle.tree(a, "key", 16).cache(), merkle.tree(b, "key", 16).cache()
    found = merkle.changed(one, two, 16)
    assert sorted((r["leaf"], r["lo"], r["hi"], r["side"]) for r in found.collect()) == [(1, 16, 31, "both"), (40, 640, 655, "left"), (93, 1488, 1503, "both"), (312, 4992, 5007, "right")]
    assert merkle.changed(one, one, 16).count() == 0 and merkle.root(one) != merkle.root(two)
    again = {r["leaf"]: r["digest"] for r in merkle.revalidated(b, "key", 16, found).collect()}
    assert again == {r["node"]: r["digest"] for r in two.where("level = 0 AND node IN (1, 93, 312)").collect()}
    plan = b.where(merkle.within("key", [(16, 31), (32, 47), (90, 95)]))._jdf.queryExecution().toString()
    assert "47" in plan and "31" not in plan.split("Optimized")[1]
    none = a.limit(0)
    assert merkle.tree(none, "key", 16).count() == 0 and merkle.root(merkle.tree(none, "key", 16)) is None


def walk(spark, seed=1, episodes=8, n=90):
    rng = random.Random(seed)
    rows = []
    for e in range(episodes):
        pattern = [rng.randrange(3) for _ in range(rng.randrange(1, 7))]
        for t in range(n if e else 3):
            pos = pattern[t % len(pattern)] if rng.random() < 0.93 else rng.randrange(4)
            rows.append((e, t, None if pos == 3 else f"p{pos}", rng.random() < 0.02, rng.random() < 0.05, 3))
    rows += [(90, t, p, False, False, 1) for t, p in enumerate("abcabc")] + [(91, t, p, False, False, 1) for t, p in enumerate("abcabd")] + [(92, t, p, False, False, 1) for t, p in enumerate("abcabc")] + [(93, 0, "z", False, False, 1)]
    return rows, spark.createDataFrame(rows, "episode long, turn long, pos string, lost boolean, progress boolean, frames long")


def test_prefix_ids(spark):
    rows, df = walk(spark)
    seqs = {}
    for e, _, p, *_ in rows:
        seqs.setdefault(e, []).append(p)
    got = prefixes.with_prefix_ids(df, "pos").collect()
    names = {}
    for r in got:
        assert r["prefix_len"] == r["turn"]
        names.setdefault((r["prefix_len"], r["prefix_id"]), set()).add(tuple(seqs[r["episode"]][: r["turn"]]))
    assert all(len(v) == 1 for v in names.values()) and len({next(iter(v)) for v in names.values()}) == len(names)
    shared = {r["episode"]: r["shared"] for r in prefixes.shared_prefixes(df, "pos").collect()}
    common = lambda a, b: next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    assert shared == {e: max(common(s, o) for x, o in seqs.items() if x != e) for e, s in seqs.items()} and shared[90] == 6 and shared[91] == 5 and shared[93] == 0
    seen = {}
    want = set()
    for e, s in seqs.items():
        for t in range(3, len(s)):
            first = seen.setdefault((e, tuple(s[t - 3 : t + 1])), t)
            if first < t:
                want.add((e, t, first))
    assert {tuple(r) for r in prefixes.repeated_slices(df, "pos", 4).collect()} == want
    assert prefixes.shared_prefixes(df.limit(0), "pos").count() == 0


@pytest.mark.parametrize("longest,history", [(64, 128), (5, 12)])
def test_periods_equal_those_of_slices(spark, longest, history):
    _, df = walk(spark, 4)
    df = T.with_dry_spells(T.with_lives(df.where("pos IS NOT NULL")))
    key = lambda r: (r["episode"], r["turn"], r["period"])
    want = sorted(map(key, T.with_cycles(df, longest, history).collect()), key=str)
    assert sorted(map(key, prefixes.with_periods(df, longest, history).collect()), key=str) == want and any(w[2] for w in want)


def test_smallest_period():
    rng = random.Random(2)
    for _ in range(3000):
        base = [rng.randrange(2) for _ in range(rng.randrange(1, 6))]
        recent = [base[i % len(base)] if rng.random() < 0.9 else 2 for i in range(rng.randrange(1, 30))]
        n = len(recent)
        want = next((p for p in range(2, n // 2 + 1) if recent[n - p :] == recent[n - 2 * p : n - p] and len(set(recent[n - p :])) > 1), None)
        assert smallest_period(recent) == want
    assert smallest_period([]) is None



