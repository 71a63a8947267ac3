"""Registry semantics: latest version per name, tombstones, anti-join removal."""

import datetime as dt

import pytest

from tidepool.operators import models as ML
from tidepool.operators.registry import ModelRegistry
from tidepool.session import scratch_path


def spec(topic, algo="decision_tree"):
    return ML.ModelSpec(topic, "regression", algo, "value", ("user_id",))


def test_latest_tombstone_and_readd(spark):
    reg = ModelRegistry(spark, scratch_path(spark, "reg-sem"))
    a, b = spec("click"), spec("view")
    t = dt.datetime(2024, 1, 1)
    reg.record(a, 0, 10, "rmse", 1.0, "p0", built_at=t)
    reg.record(a, 1, 20, "rmse", 0.5, "p1", built_at=t)
    reg.record(a, 1, 20, "rmse", 0.5, "p1", built_at=t)  # a retried write
    reg.record(b, 0, 5, "rmse", 2.0, "q0", built_at=t)
    latest = {r["name"]: r["version"] for r in reg.latest().collect()}
    assert latest == {a.name: 1, b.name: 0}
    assert reg.latest_for(a.name)["version"] == 1
    reg.remove_topic("click")
    assert [r["name"] for r in reg.latest().collect()] == [b.name]
    assert reg.latest_for(a.name) is None and reg.latest_for(b.name)["version"] == 0
    reg.record(a, 3, 30, "rmse", 0.4, "p3", built_at=t)  # defined and built again
    assert {r["name"]: r["version"] for r in reg.latest().collect()} == {a.name: 3, b.name: 0}
    assert reg.latest_for(a.name)["version"] == 3 and reg.latest_for("unknown") is None


def test_versions_come_from_one_allocator(spark):
    reg = ModelRegistry(spark, scratch_path(spark, "reg-alloc"))
    s = spec("click")
    assert reg.allocate(s) == 0 and reg.allocate(s) == 1  # given, though not recorded yet
    reg.record(s, 1, 10, None, None, "p1")
    v = reg.allocate(s, "job", 0)
    reg.record(s, v, 20, None, None, "p2", job="job", batch_id=0)
    assert v == 2 and reg.allocate(s, "job", 0) == 2 and reg.recorded(s, "job", 0) and not reg.recorded(s, "job", 1)
    reg.remove_topic("click")
    again = ModelRegistry(spark, reg.root)  # another session's registry over the same log
    assert again.allocate(s, "job", 1) == 4 and again.latest_for(s) is None
    again.record(s, 4, 5, None, None, "p4", job="job", batch_id=1)
    again.record(s, 5, 0, None, None, None, status="skipped", reason="no rows")
    assert again.latest_for(s)["version"] == again.latest_for(s.name)["version"] == again.latest().first()["version"] == 4
    assert again.new_model_path(s, 4) != again.new_model_path(s, 4)


def test_models_whose_names_run_together(spark):
    reg = ModelRegistry(spark, scratch_path(spark, "reg-name"))
    a = ML.ModelSpec("a", "regression", "decision_tree", "regressionb", ("x",))
    b = ML.ModelSpec("aregression", "regression", "decision_tree", "b", ("x",))
    assert a.name == b.name
    reg.record(a, 0, 1, None, None, "pa")
    reg.record(b, 3, 1, None, None, "pb")
    assert reg.latest_for(a)["model_path"] == "pa" and reg.latest_for(b)["model_path"] == "pb" and reg.latest().count() == 2
    with pytest.raises(ValueError):
        reg.latest_for(a.name)


def test_remove_one_topic_of_several(spark):
    reg = ModelRegistry(spark, scratch_path(spark, "reg-anti"))
    assert reg.latest().count() == 0 and reg.latest_for(spec("click")) is None
    for topic in ("click", "view", "error"):
        reg.record(spec(topic), 0, 1, None, None, None)
    reg.remove_topic("click")
    reg.remove_topic("error")
    assert [r["topic"] for r in reg.latest().collect()] == ["view"]
