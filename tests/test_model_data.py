"""Models as records against the fitted pipelines, counts that add up, claims of versions."""

import json
import multiprocessing
import random
import threading

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidepool.operators import models as ML
from tidepool.operators.model_data import UnseenValue, export, score_rows, score_versions, scores
from tidepool.operators.registry import ModelRegistry, claim
from tidepool.operators.tally import N, fit_tallies, fit_tally, merge_tallies, tally
from tidepool.streaming.rebuild import rebuild_from_tally, rebuild_once, score_as_of, start_rebuild

EV = "/root/testdata/sf0.001/events.parquet"


@pytest.fixture(scope="module")
def events(spark):
    return spark.read.parquet(EV).withColumns({
        "hi": F.col("value") > 50, "odd": (F.col("user_id") % 2).cast("double"), "tag": F.concat(F.lit("t "), (F.col("event_id") % 7).cast("string")),
        "two": F.when(F.col("user_id") * 3 + F.col("value") > 170, "yes").otherwise("no"),
    }).drop("ts", "props")


CASES = [
    ("logit", "classification", "two", ("odd", "value", "tag"), {}),
    ("logit", "classification", "event_type", ("odd", "value", "tag"), {}),
    ("linear_svm", "classification", "two", ("value", "user_id", "hi"), {}),
    ("naive_bayes", "classification", "event_type", ("odd", "hi"), {}),
    ("decision_tree", "regression", "value", ("user_id", "tag", "event_type"), {}),
    ("decision_tree", "classification", "two", ("value", "tag"), {}),
    ("random_forest", "regression", "value", ("user_id", "tag"), {}),
    ("random_forest", "classification", "event_type", ("value", "tag", "hi"), {"numTrees": 5}),
]


def _fitted(spark, events, tmp_path, algorithm, kind, label, variables, params, **kw):
    spec = ML.ModelSpec("t", kind, algorithm, label, variables, split_key=("event_id",), params=tuple(params.items()), **kw)
    model = ML.fit(ML.prepare(events, spec), spec)
    path = ML.save(model, str(tmp_path / "model"))
    return spec, model, export(spark, model, path)


@pytest.mark.parametrize("case", CASES, ids=lambda c: f"{c[0]}-{c[2]}")
def test_record_scores_like_the_pipeline(spark, events, tmp_path, case):
    spec, model, record = _fitted(spark, events, tmp_path, *case)
    data = events.drop(spec.label)
    want = {r["event_id"]: r["prediction"] for r in ML.predict(model, data).collect()}
    got = {r["event_id"]: r["prediction"] for r in score_rows(data, record, "prediction", spec.kind == ML.CLASSIFICATION).collect()}
    if spec.kind == ML.CLASSIFICATION:
        assert got == want
    else:
        assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], rel=1e-12) for k in want)


@pytest.mark.parametrize("invalid", ["error", "skip", "keep"])
def test_unknown_levels(spark, events, tmp_path, invalid):
    spec, model, record = _fitted(spark, events, tmp_path, "logit", "classification", "two", ("tag", "event_type", "odd"), {}, handle_invalid=invalid)
    odd = events.drop("two").withColumn("tag", F.when(F.col("event_id") % 3 == 0, "new").otherwise(F.col("tag")))
    if invalid == "error":
        with pytest.raises(Exception, match="UnseenValue"):
            score_rows(odd, record, "prediction", True).collect()
        with pytest.raises(UnseenValue):
            scores(json.loads(record), {"tag": np.array([None], dtype=object), "event_type": np.array(["view"], dtype=object), "odd": np.array([1.0])})
        return
    # (the pipeline itself wants the label column when it skips rows)
    want = sorted((r["event_id"], r["prediction"]) for r in ML.predict(model, odd.withColumn("label", F.lit("yes"))).collect())
    assert sorted((r["event_id"], r["prediction"]) for r in score_rows(odd, record, "prediction", True).collect()) == want


def test_a_thousand_versions_in_one_plan(spark, events, tmp_path):
    made = []
    for seed, variables in enumerate([("user_id",), ("user_id", "tag"), ("tag", "event_type")]):
        spec, model, record = _fitted(spark, events, tmp_path / str(seed), "random_forest", "regression", "value", variables, {"numTrees": 3}, seed=seed)
        made.append((model, record))
    rng = random.Random(2)
    which = [rng.randrange(3) for _ in range(1000)]
    records = spark.createDataFrame([(v, made[k][1]) for v, k in enumerate(which)], "version long, record string")
    # a third of all rows in one version, some without a version, some with one that has no record
    version = F.when(F.col("event_id") % 3 == 0, 7).when(F.col("event_id") % 11 == 1, None).when(F.col("event_id") % 13 == 1, 5000).otherwise(F.pmod(F.hash("event_id"), F.lit(1000)))
    rows = events.drop("value").withColumns({"v": version.cast("long"), "part": F.col("event_id") % 4})
    out = score_versions(rows, records, "v", "part", "prediction", as_text=False)
    got = {r["event_id"]: (r["v"], r["prediction"]) for r in out.collect()}
    assert len(got) == rows.count() and out.columns == [c for c in rows.columns if c not in ("v", "part")] + ["v", "prediction"]
    by_model = [{r["event_id"]: r["prediction"] for r in ML.predict(m, events.drop("value")).collect()} for m, _ in made]
    for r in rows.collect():
        v, p = got[r["event_id"]]
        assert v == r["v"]
        if v is None or v == 5000:
            assert p is None
        else:
            assert p == pytest.approx(by_model[which[v]][r["event_id"]], rel=1e-12)
    plan = out._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("CoGroup") == 1 and plan.count("Scan") <= 4 and "BroadcastNestedLoop" not in plan


def test_score_as_of_reads_records_and_respects_removal(spark, tmp_path):
    ev = spark.read.parquet(EV)
    registry = ModelRegistry(spark, str(tmp_path / "reg"))
    spec = ML.ModelSpec("click", "regression", "decision_tree", "value", ("user_id",), split_key=("event_id",))
    cuts = [r[0] for r in ev.selectExpr("ts").orderBy("ts").collect()][200:800:200]
    for cut in cuts:
        rebuild_once(spark, ML.training_rows(ev.where(F.col("ts") < F.lit(cut)), spec), spec, registry, built_at=cut)
    registry.remove_topic("click")  # now, long after the rows
    got = score_as_of(spark, ev.select("event_id", "ts", "user_id"), spec, registry, "ts").collect()
    assert len(got) == ev.count()
    for r in got:
        want = sum(r["ts"] >= c for c in cuts) - 1
        assert r["model_version"] == (want if want >= 0 else None) and (r["prediction"] is None) == (want < 0)


def _bayes(events):
    return ML.ModelSpec("t", "classification", "naive_bayes", "event_type", ("odd", "hi"), split_key=("event_id",))


def test_added_counts_give_the_full_fit_digit_by_digit(spark, events):
    spec = _bayes(events)
    rows = ML.training_rows(events.withColumn("event_type", F.when(F.col("event_id") % 17 != 0, F.col("event_type"))), spec)
    parts = [tally(rows.where(F.pmod(F.hash(ML.SPLIT), F.lit(5)) == k), spec) for k in range(5)]
    record = json.loads(fit_tally(merge_tallies(merge_tallies(*parts[:2]), merge_tallies(*parts[2:])), spec))
    model = ML.fit(rows.where(F.col(ML.SPLIT) < spec.ratio), spec)
    assert record["labels"] == ML.class_labels(model)
    assert record["pi"] == model.stages[1].pi.toArray().tolist()
    assert record["theta"] == model.stages[1].theta.toArray().tolist()
    every = fit_tallies(tally(rows, spec).withColumn("v", F.lit(3).cast("long")), spec, "v").first()
    assert every["version"] == 3 and json.loads(every["record"]) == record


def test_rebuild_by_counts_over_batches(spark, events, tmp_path):
    spec = _bayes(events)
    data = events.select("event_id", "odd", "hi", "event_type")
    registry = ModelRegistry(spark, str(tmp_path / "reg"))

    def rebuild():
        rows = spark.readStream.schema(data.schema).parquet(str(tmp_path / "in"))
        start_rebuild(spark, rows, spec, registry, str(tmp_path / "rows"), str(tmp_path / "ckpt"), trigger="availableNow")

    for lo, hi in ((0, 300), (300, 301), (301, 1001)):
        data.where((F.col("event_id") >= lo) & (F.col("event_id") < hi)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        rebuild()
    entry = registry.latest_for(spec)
    full = rebuild_once(spark, ML.training_rows(data, spec), spec, ModelRegistry(spark, str(tmp_path / "full")))
    want = ModelRegistry(spark, str(tmp_path / "full")).latest_for(spec)
    assert full == 0 and entry["n_build"] == want["n_build"] == data.count() and entry["metric_value"] == want["metric_value"]
    assert sorted(map(tuple, entry["cells"])) == sorted(map(tuple, want["cells"]))
    # no rows are kept: at most a row per combination that occurs, in two turns
    kept = spark.read.parquet(str(tmp_path / "rows"))
    assert {r["turn"] for r in kept.select("turn").distinct().collect()} == {0, 1}
    assert kept.where("turn = 0").count() <= 2 * 2 * 2 * 5 and kept.where("turn = 0").agg(F.sum(N)).first()[0] == data.count()


def test_bad_counts_are_skipped(spark, events, tmp_path):
    spec = ML.ModelSpec("t", "classification", "naive_bayes", "event_type", ("user_id",), split_key=("event_id",))
    registry = ModelRegistry(spark, str(tmp_path))
    assert rebuild_from_tally(tally(ML.training_rows(events, spec), spec), spec, registry) is None
    assert registry.log().first()["status"] == "skipped" and "0/1" in registry.log().first()["reason"]
    assert rebuild_from_tally(tally(ML.training_rows(events.limit(0), spec), spec), spec, registry) is None


def _claims(root, n, out):
    for k in range(n):
        version = 0
        while not claim(None, f"{root}/v{version}", f"{out}-{k}"):
            version += 1
        with open(f"{root}-{out}", "a") as f:
            f.write(f"{version}\n")


def test_two_processes_never_get_one_version(tmp_path):
    ctx = multiprocessing.get_context("spawn")
    work = [ctx.Process(target=_claims, args=(str(tmp_path / "claims"), 50, name)) for name in ("a", "b")]
    for p in work:
        p.start()
    for p in work:
        p.join()
    got = [int(x) for name in ("a", "b") for x in open(f"{tmp_path}/claims-{name}")]
    assert sorted(got) == list(range(100))


def test_two_registries_allocate_apart(spark, tmp_path):
    spec = ML.ModelSpec("t", "regression", "decision_tree", "value", ("user_id",))
    got, registries = [], [ModelRegistry(spark, str(tmp_path)) for _ in range(2)]
    threads = [threading.Thread(target=lambda r=r: [got.append(r.allocate(spec)) for _ in range(20)]) for r in registries]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert sorted(got) == list(range(40))
    # a batch that is run again before its entry is written has its number
    assert registries[0].allocate(spec, "job", 4) == registries[1].allocate(spec, "job", 4) == 40


def test_claim_through_hadoop(spark, tmp_path):
    spark.sparkContext._jsc.hadoopConfiguration().set("fs.viewfs.mounttable.claims.link./in", f"file://{tmp_path}")
    assert claim(spark, "viewfs://claims/in/v0", "a") and claim(spark, "viewfs://claims/in/v0", "a") and not claim(spark, "viewfs://claims/in/v0", "b")
