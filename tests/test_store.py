"""Recordings at rest, revisions and the commands."""

import os

import pytest

from tidewell import api
from tidewell.api import Engine
from tidewell.plans.signals import GATES, holds, vectors
from tidewell.sources import adapter as ad
from tidewell.sources import store
from tidewell.sources.adapter import DAY, HOUR

SF = "/root/testdata/sf0.001"
NOON = 19_723 * DAY + DAY // 2


def test_days_are_replaced_one_by_one_and_pruned(spark, tmp_path):
    path = f"{tmp_path}/days"
    rows = spark.createDataFrame([(1, NOON, NOON + DAY, 5), (2, NOON, NOON + 10, 6)], "device long, start_ms long, end_ms long, energy int")
    store.write_days(rows, path)
    assert spark.read.parquet(path).count() == 3
    store.write_days(spark.createDataFrame([(1, NOON + DAY // 2 + 5, NOON + DAY // 2 + 9, 7)], rows.schema), path)
    got = {(r["device"], r["start_ms"], r["end_ms"], r["energy"]) for r in store.read_window(spark, path, 0, NOON + 10 * DAY).collect()}
    assert got == {(1, NOON, NOON + DAY // 2, 5), (1, NOON + DAY // 2 + 5, NOON + DAY // 2 + 9, 7), (2, NOON, NOON + 10, 6)}
    window = store.read_window(spark, path, NOON + 3, NOON + 5, device=2)
    assert [(r["start_ms"], r["end_ms"]) for r in window.collect()] == [(NOON + 3, NOON + 5)]
    assert "PartitionFilters: [isnotnull(day" in window._jdf.queryExecution().executedPlan().toString()
    assert [r["n"] for r in store.days(spark, path, limit=1).collect()] == [1]


def test_window_of_a_recording_is_the_recording(spark, tmp_path):
    spans = holds(spark, SF).where("channel = 0").select("device", "start_ms", "end_ms", "energy")
    store.write_days(spans, f"{tmp_path}/all")
    total = lambda df: df.selectExpr("sum(end_ms - start_ms)").first()[0]
    assert total(store.read_window(spark, f"{tmp_path}/all", 0, 10**13)) == total(spans)


def test_commands(spark, tmp_path):
    engine = Engine(spark, SF, str(tmp_path))
    assert engine.label_range("1", 0, 100, "present") == 1
    assert engine.label_several(["1", "2"], 40, 60, "not_present") == 2
    rows = lambda: sorted((r["owner"], r["start_ms"], r["end_ms"], r["state"]) for r in engine.labels.read().collect())
    assert rows() == [("1", 0, 40, "present"), ("1", 40, 60, "not_present"), ("1", 60, 100, "present"), ("2", 40, 60, "not_present")]
    with pytest.raises(store.Conflict):
        engine.label_range("1", 0, 5, "unknown", revision=1)
    engine.edit_label("2", (40, 60), 70, 80, "present", revision=2)
    engine.label_range("1", 0, 100, None)
    assert rows() == [("2", 70, 80, "present")]
    assert len(engine.labels.read(2).collect()) == 4
    for bad in ((5, 5, "present"), (0, 1, "maybe"), (0, 1.5, "present")):
        with pytest.raises(ValueError):
            engine.label_range("1", *bad)
    engine.configure("priority/z0", 2.5)
    engine.configure("priority/z0", 3.0)
    assert engine.setting("priority/z0") == 3.0 and engine.setting("other", 1) == 1
    page = engine.recording_rows(1, 19_724, limit=5)
    assert page.count() <= 5 and page.columns[0] == "start_ms"
    assert engine.series([1], [0, 1], 10**13, 10**7).count() > 0 and engine.recording_days(1).count() > 0


def test_a_revision_is_claimed(spark, tmp_path):
    table = store.Revisions(spark, f"{tmp_path}/t", "a long")
    rows = spark.createDataFrame([(1,)], "a long")
    assert table.commit(rows, 0) == 1
    (tmp_path / "t" / "_claim-2").touch()
    with pytest.raises(store.Conflict):
        table.commit(rows, 1)
    assert table.latest() == 1 and sorted(p.name for p in (tmp_path / "t").iterdir() if not p.name.startswith(".")) == ["_claim-2", "rev=1"]
    os.utime(tmp_path / "t" / "_claim-2", (0, 0))
    assert table.commit(rows, 1) == 2
    assert not list((tmp_path / "t").glob("_*"))


def test_live_labels_and_feedback(spark, tmp_path):
    engine = Engine(spark, SF, str(tmp_path))
    rows = lambda: sorted((r["owner"], r["start_ms"], r["end_ms"], r["state"], r["source"]) for r in engine.labels.read().collect())
    engine.set_training_state("1", "present", 100, timeout_ms=50)
    engine.set_training_state("1", "not_present", 400)
    assert rows() == [("1", 100, 150, "present", "live")]
    engine.set_training_state("1", "unknown", 460)
    assert rows() == [("1", 100, 150, "present", "live"), ("1", 400, 460, "not_present", "live")]
    assert engine.live.read().count() == 0
    with pytest.raises(ValueError):
        engine.set_training_state("1", "maybe", 500)
    assert [engine.auto_feedback(1, "not_present", ok) for ok in (True, False, False, True)] == [0.0, 0.4, 0.675, 0.625]
    assert engine.auto_feedback(1, "present", True) == -0.05
    zone = engine.query("current_stretch").where("state != 'unknown'").first()
    engine.room_estimate_feedback(zone["zone"], False)
    (said,) = [r for r in rows() if r[0] == zone["zone"]]
    assert said[2] == zone["end_ms"] and 0 < said[2] - said[1] <= HOUR and said[3] != zone["state"]
    with pytest.raises(ValueError):
        engine.room_estimate_feedback("nowhere", True)
    engine.clear(1)
    assert {r[0] for r in rows()} == {zone["zone"]}


def test_overnight_leaves_out_what_was_learned_from_the_same_evidence(spark, tmp_path, monkeypatch):
    engine, seen = Engine(spark, SF, str(tmp_path)), {(0, 0): "a", (0, 1): "b", (1, 0): "c"}
    monkeypatch.setattr(api, "signatures", lambda *_: spark.createDataFrame([(*k, v) for k, v in seen.items()], api.SIGNATURES))
    todo = lambda: sorted((r["device"], r["pattern"]) for r in engine.overnight().collect())
    assert todo() == [(0, 0), (0, 1), (1, 0)]
    engine.start_learning(0)
    assert todo() == [(1, 0)]
    seen[0, 1] = "d"
    assert todo() == [(0, 1), (1, 0)]
    engine.start_learning(0, 1)
    assert todo() == []


def test_learning_is_kept_and_applied(spark, tmp_path):
    engine = Engine(spark, SF, str(tmp_path))
    every = {r["device"]: list(r["thresholds"]) for r in engine.query("learn_thresholds").collect()}
    first, second = sorted(every)[:2]
    assert {r["device"]: list(r["thresholds"]) for r in engine.learn(first).collect()} == {first: every[first]}
    engine.start_learning(first, second)
    old = engine.thresholds(first)
    writes = engine.apply(first, second)
    assert engine.thresholds(first) == every[first]
    assert [(c, a, b) for d, c, a, b in writes if d == first] == sorted(((c, a, b) for c, (a, b) in enumerate(zip(old, every[first], strict=True)) if a != b), key=lambda w: (w[2] > w[1], w[0]))
    assert engine.apply(first, second) == []
    with pytest.raises(ValueError):
        engine.apply(first, slot="other")
    engine.set_gate_threshold(first, 0, 12.5)
    assert engine.thresholds(first) == [10, *every[first][1:]]
    for bad in ((9, 10), (0, 101), (0, float("nan"))):
        with pytest.raises(ValueError):
            engine.set_gate_threshold(first, *bad)
    engine.clear(first)
    assert {r["device"] for r in engine.results.read().collect()} == {second}
    zone = engine.query("learning_sets").first()["zone"]
    assert set(engine.members(zone)) >= {r["device"] for r in ad.groups(spark).where(f"zone = '{zone}'").collect()}
    with pytest.raises(ValueError):
        engine.members("nowhere")


def test_an_export_holds_the_recording(spark, tmp_path):
    engine = Engine(spark, SF, str(tmp_path))
    want = vectors(spark, SF).where("device = 1").select("device", "start_ms", "end_ms", *GATES)
    engine.export_file(1, f"{tmp_path}/out")
    back = spark.read.schema(want.schema).json(f"{tmp_path}/out").select(want.columns)
    assert want.count() == back.count() > 0 and want.exceptAll(back).isEmpty()
    store.write_days(want, f"{tmp_path}/days")
    engine.clear(1, f"{tmp_path}/days")
    assert not list((tmp_path / "days").glob("device=1"))
