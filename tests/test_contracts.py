"""Contracts return rows when a fixture is corrupted, and scorers are held to theirs."""

import sys

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from wayfold.operators import contracts as K
from wayfold.operators import datasets as DS
from wayfold.sources import scorers

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers cannot import test modules

ROWS = [("a", "d1", "train", "hard", "f", None, "up"), ("b", "d2", "train", "replay", "f", "a", "left")]
SCHEMA = "id string, digest string, split string, class string, family string, parent string, label string"
QUOTAS = {"hard": 1, "replay": 1}


def frame(spark, **changes):
    df = spark.createDataFrame(ROWS, SCHEMA).withColumn("options", F.array(F.lit("up"), F.lit("left")))
    for name, value in changes.items():
        df = df.withColumn(name, F.when(F.col("id") == "b", value).otherwise(F.col(name)))
    return df


def test_sound_dataset_has_no_violations(spark):
    assert K.dataset(frame(spark), QUOTAS, 2).count() == 0


@pytest.mark.parametrize(
    ("change", "checks"),
    [
        ({"digest": "d1"}, {"duplicate digest"}),
        ({"digest": "d1", "split": "development"}, {"duplicate digest", "digest in two splits", "parent"}),
        ({"label": "down"}, {"illegal label"}),
        ({"class": "hard"}, {"quota"}),
        ({"parent": "z"}, {"parent"}),
    ],
)
def test_corruption_is_named(spark, change, checks):
    assert {r.check for r in K.dataset(frame(spark, **change), QUOTAS, 2).collect()} == checks


def test_family_cap(spark):
    assert [r.key for r in K.dataset(frame(spark), QUOTAS, 1).collect()] == ["f"]


class Fixed:
    def __init__(self, answers=None, identities=("m1",)):
        self.answers, self.identities, self.asked = answers, list(identities), 0

    def identity(self):
        self.asked += 1
        return self.identities[min(self.asked - 1, len(self.identities) - 1)]

    def predict(self, requests):
        return self.answers or [("up", {"up": 0.75, "left": 0.25}) for _ in requests]


def test_scorers(spark):
    requests = spark.createDataFrame([(i, f"q{i}") for i in range(10)], "id long, request string")
    out = scorers.scored(requests, Fixed, batch=3).collect()
    assert len(out) == 10 and {(r.choice, r.identity) for r in out} == {("up", "m1")}
    for bad, why in ((lambda: Fixed([("up", {"up": 1.0})] * 99), "responses"), (lambda: Fixed(identities=("m1", "m2")), "changed"), (lambda: Fixed([("up", {"up": 0.2, "left": 0.8})]), "distribution")):
        with pytest.raises(Exception, match=why):
            scorers.scored(requests.limit(1), bad, batch=1).collect()
    assert scorers.concurrent(lambda s: s.upper(), ["a", "b", "c"], 2) == ["A", "B", "C"]


def test_dataset_contract_asks_every_event(spark, data):
    from wayfold.registry import QUERIES

    got = QUERIES["dataset_contract"](spark, data).collect()
    ids = {r.event_id: r.event_type for r in spark.read.parquet(f"{data}/events.parquet").select("event_id", "event_type").collect()}
    assert {int(r.key) for r in got if r.check == "illegal label"} == {i for i, t in ids.items() if t == "signup"}
    missing = {i for i in ids if i % 9 == 0 and i % 5 == 1 and -i not in ids}
    assert missing and missing <= {int(r.key) for r in got if r.check == "parent"}


def test_a_kept_dataset_contract_has_no_violations(spark):
    contract = DS.Contract({"hard": (3, 0), "easy": (1, 0)}, {"near": (2, 0)}, {"a": (2, 0), "b": (1, 0)}, family_cap=2, episode_cap=3, per_root=1, mix=("off", 0.6), parents=("easy", "hard"))
    kinds = "id long, split string, class string, origin string, family string, episode long, digest string, label string, options array<string>, parent long, role string, flags map<string,boolean>"
    good = [(i, "train", "hard", "off" if i < 2 else "on", f"f{i % 2}", 1, f"d{i}", "up", ["up"], None, "ab"[i // 2], {"near": i > 0}) for i in range(3)]
    good.append((9, "train", "easy", "off", "f1", 1, "d9", "up", ["up"], 2, None, None))
    ask = lambda rows: {r.check for r in DS.violations(spark.createDataFrame(rows, kinds), contract).collect()}
    assert ask(good) == set()
    change = lambda k, **c: [tuple((dict(zip([x.split()[0] for x in kinds.split(", ")], r)) | (c if r[0] == k else {})).values()) for r in good]
    assert ask(change(9, parent=9)) == ask(change(9, parent=None)) == {"parent"}
    assert ask(change(9, label="down")) == {"illegal label"} and ask(change(9, digest="d1")) == {"repeated digest"}
    assert ask(change(1, origin="on")) == {"origin"} and ask(change(1, flags=None)) == {"floor"} and ask(change(0, role="b")) == {"role"}
    assert ask(change(9, family="f0")) == {"family cap"}
    assert ask([*good, (10, "train", "easy", "on", "f2", 1, "d10", "up", ["up"], 2, None, None)]) == {"budget", "windows of a root"}


def test_plans_and_harvest_limits():
    plan = {s: {k: v[i] for k, v in DS.CONTRACTS["balanced"].roles.items()} for i, s in enumerate(DS.SPLITS)}
    assert DS.plan_problems(plan) == []
    assert DS.plan_problems({"train": plan["train"]}) == ["development: roles are not those of the contract, with numbers from 0"]
    more = plan | {"train": plan["train"] | {"broad_exposure": 600, "immediate_evasion": 172}}
    assert DS.plan_problems(more) == ["train: too much broad exposure", "train: too few evasions"]
    assert DS.plan_problems(plan | {"train": plan["train"] | {"cleanup": 0}}) == ["train: 2772 of 3660", "train: no cleanup"]
    assert DS.harvest_problems(8, 0, 16) == [] and DS.harvest_problems(8, 9, 4) == DS.harvest_problems(8, 2, 17) != []
    assert DS.harvest_problems(True, -1, 0) == ["roots", "perturbed", "turns"]
