"""Builds in committed stages: killed anywhere and resumed, refused where something changed, and the dataset against plain loops."""

import hashlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F
from test_selection_supply import key, plain_targets, true

from wayfold.operators.stages import Build, Changed, Stage, content
from wayfold.plans import builds
from wayfold.plans.base import Tables
from wayfold.sources import store


def small(spark, folder, config=None, rows=6):
    ran = []

    def step(name, f):
        def run(config, *inputs):
            ran.append(name)
            return f(config, *inputs)

        return run

    steps = (
        Stage("even", ("numbers",), step("even", lambda c, n: n.where("id % 2 = 0")), ()),
        Stage("scaled", ("even",), step("scaled", lambda c, n: n.select((F.col("id") * c["by"]).alias("id"))), ("by",)),
        Stage("both", ("even", "scaled"), step("both", lambda c, a, b: a.unionByName(b)), ()),
        Stage("negative", ("both",), step("negative", lambda c, n: n.where(f"id < {c['least']}")), ("least",), must_be_empty=True),
    )
    build = Build(spark, str(folder), {"by": 3, "least": 0, **(config or {})}, {"numbers": spark.range(rows)}, steps)
    return build, ran


class Killed(Exception):
    pass


def test_killed_between_any_two_stages(spark, tmp_path, monkeypatch):
    straight, _ = small(spark, tmp_path / "straight")
    want = sorted(r.id for r in straight.run()["both"].collect())
    assert want == [0, 0, 2, 4, 6, 12] and straight.ran == ["even", "scaled", "both", "negative"]
    for name in straight.ran:
        build, ran = small(spark, tmp_path / name)
        with monkeypatch.context() as m:
            real = Build.commit
            m.setattr(Build, "commit", lambda self, stage, receipt, name=name: (_ for _ in ()).throw(Killed) if stage.name == name else real(self, stage, receipt))
            with pytest.raises(Killed):
                build.run()
        done = build.ran[:]
        again, ran = small(spark, tmp_path / name)
        assert sorted(r.id for r in again.run()["both"].collect()) == want
        assert ran == straight.ran[len(done) :] and name in ran  # what had a receipt is not done again
        assert again.receipts().collect() == straight.receipts().collect()
        assert small(spark, tmp_path / name)[0].run(verify=True) and again.receipts().count() == 4


def test_partial_data_are_written_over(spark, tmp_path, monkeypatch):
    build, _ = small(spark, tmp_path)
    with monkeypatch.context() as m:
        m.setattr(Build, "commit", lambda *a: (_ for _ in ()).throw(Killed))
        with pytest.raises(Killed):
            build.run()
    part = next(p for p in (tmp_path / "data").rglob("*.parquet"))
    part.unlink()
    assert small(spark, tmp_path)[0].run()["both"].count() == 6


def test_changes_are_refused(spark, tmp_path):
    small(spark, tmp_path)[0].run()
    with pytest.raises(Changed, match="another configuration"):
        small(spark, tmp_path, {"by": 4})[0].run()
    with pytest.raises(Changed, match="other sources"):
        small(spark, tmp_path, rows=7)[0].run()
    text = (tmp_path / "receipts" / "scaled.json").read_text()
    for f in (tmp_path / "receipts").glob("*scaled.json*"):
        f.unlink()
    store.write_new(spark, f"{tmp_path}/receipts/scaled.json", text.replace('"key": "', '"key": "x'))
    with pytest.raises(Changed, match="receipt of scaled"):
        small(spark, tmp_path)[0].run()


def test_changed_data_are_found(spark, tmp_path):
    build, _ = small(spark, tmp_path)
    build.run()
    spark.range(9).write.mode("overwrite").parquet(f"{tmp_path}/{build.receipt('scaled')['data']}")
    assert small(spark, tmp_path)[0].run()
    with pytest.raises(Changed, match="data of scaled"):
        small(spark, tmp_path)[0].run(verify=True)


def test_faults_fail_the_build(spark, tmp_path):
    with pytest.raises(ValueError, match="negative: 2 faults"):
        small(spark, tmp_path, {"least": 1})[0].run()
    assert small(spark, tmp_path, {"least": 1})[0].receipt("negative") is None
    with pytest.raises(ValueError, match="stage x"):
        Build(spark, str(tmp_path), {}, {}, [Stage("x", ("nothing",), lambda c: None)])


def test_content_is_blind_to_order_only(spark):
    a = spark.createDataFrame([(1, {"x": True, "y": None}, "a"), (2, None, None), (2, None, None)], "id long, flags map<string,boolean>, t string")
    b = spark.createDataFrame([(2, None, None), (1, {"y": None, "x": True}, "a"), (2, None, None)], "id long, flags map<string,boolean>, t string").repartition(3)
    assert content(a) == content(b) and content(a)[1] == 3
    assert len({content(x)[0] for x in (a, a.limit(2), a.limit(0), a.withColumn("t", F.lit("b")), a.withColumn("u", F.lit(None).cast("string")))}) == 5


def test_store_writes_once(spark, tmp_path):
    assert store.write_same(spark, f"{tmp_path}/a/x.json", {"b": 1}) and not store.write_same(spark, f"{tmp_path}/a/x.json", {"b": 1})
    with pytest.raises(ValueError, match="other contents"):
        store.write_same(spark, f"{tmp_path}/a/x.json", {"b": 2})
    assert store.names(spark, f"{tmp_path}/a") == ["x.json"] and store.names(spark, f"{tmp_path}/none") == [] and store.read_text(spark, f"{tmp_path}/y") is None


def plain_dataset(pool, config, need):
    splits, labels = defaultdict(set), defaultdict(set)
    for r in pool:
        splits[r["digest"]].add(r["split"])
        labels[r["digest"]].add(r["label"])
    best = {}
    for r in sorted(pool, key=lambda r: (-r["priority"], key(config["seed"], r["id"]), r["id"])):
        if len(splits[r["digest"]]) == len(labels[r["digest"]]) == 1:
            best.setdefault(r["digest"], r)
    clean = list(best.values())
    by_place = {(r["episode"], r["turn"]): r for r in pool}
    kept = {r["id"]: r for r in clean}
    out, used = {}, Counter()
    for split in ("train", "development"):
        roots = [r for r in clean if r["targeted"] and r["split"] == split]
        windows = []
        for root in roots:
            for place, o in enumerate(config["offsets"], 1):
                between = [by_place.get((root["episode"], t)) for t in range(root["turn"] + min(o, 0), root["turn"] + max(o, 0) + 1)]
                row = by_place.get((root["episode"], root["turn"] + o))
                if all(b is not None and b["life"] == root["life"] for b in between) and row["id"] in kept:
                    windows.append({"id": f"{row['id']}@{root['id']}", "digest": row["digest"], "family": root["family"], "root": root["id"], "place": place})
        floors = {k: n for (s, kind, k), n in need.items() if s == split and kind == "floor" and n}
        budget = (need[split, "class", "targeted"], need[split, "class", "informative"])
        chosen, near = plain_targets(roots, windows, budget, floors, config["family_cap"], config["per_root"], config["seed"])
        out |= {i: ("targeted", None) for i in chosen} | {w.split("@")[0]: ("informative", w.split("@")[1]) for w in near}
    used.update(kept[i]["family"] for i in out)
    seeded = lambda r: (hashlib.md5(f"{config['seed']}/replay:{r['id']}".encode()).hexdigest(), r["id"])
    for split in ("train", "development"):
        rest, family = [], Counter(used)
        for r in sorted((r for r in clean if r["safe"] and r["id"] not in out), key=seeded):
            family[r["family"]] += 1
            if family[r["family"]] <= config["family_cap"] and r["split"] == split:
                rest.append(r["id"])
        out |= {i: ("replay", None) for i in rest[: need[split, "class", "replay"]]}
    return {(i, *v) for i, v in out.items()}


def test_dataset_build_equals_plain_loops(spark, data, tmp_path, monkeypatch):
    config = builds.CONFIG | {"family_cap": 40, "per_root": 2}
    decisions = builds._decisions(Tables(spark, data))
    straight = builds.offline_build(spark, f"{tmp_path}/straight", decisions, config)
    out = straight.run()
    assert out["faults"].count() == 0
    pool = [r.asDict() for r in out["pool"].collect()]
    need = {(r["split"], r["kind"], r["name"]): r["need"] for r in out["budgets"].collect()}
    got = {(r["id"], r["class"], r["parent"]) for r in out["dataset"].collect()}
    assert got == plain_dataset(pool, config, need)
    assert {c for _, c, _ in got} == {"targeted", "informative", "replay"} and any(true(r["flags"]) for r in pool)
    # killed before the receipt of each stage in turn, resumed each time
    for stage in builds.STAGES:
        with monkeypatch.context() as m:
            real = Build.commit
            m.setattr(Build, "commit", lambda self, s, r, stage=stage: (_ for _ in ()).throw(Killed) if s.name == stage.name else real(self, s, r))
            with pytest.raises(Killed):
                builds.offline_build(spark, f"{tmp_path}/killed", decisions, config).run()
    last = builds.offline_build(spark, f"{tmp_path}/killed", decisions, config)
    last.run()
    assert last.ran == ["faults"] and last.receipts().collect() == straight.receipts().collect()
    with pytest.raises(Changed):
        builds.offline_build(spark, f"{tmp_path}/killed", decisions, config | {"seed": "other"}).run()


def test_build_of_nothing(spark, data, tmp_path):
    out = builds.offline_build(spark, str(tmp_path), builds._decisions(Tables(spark, data)).limit(0)).run()
    assert out["dataset"].count() == 0 == out["faults"].count()
