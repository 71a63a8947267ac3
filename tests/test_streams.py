"""Stream = batch, running RMSE across micro-batches, timed rebuild."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidepool.operators import models as ML
from tidepool.operators.registry import ModelRegistry
from tidepool.operators.split import hash_fraction
from tidepool.session import scratch_path
from tidepool.sources.topic import TopicSource, publish, to_messages
from tidepool.streaming.ingest import subscribe
from tidepool.streaming.rebuild import rebuild_once, start_rebuild
from tidepool.streaming.score import running_rmse_stream, score_stream, scoring_rows

EV = "/root/testdata/sf0.001/events.parquet"
HINTS = {"ts": "timestamp_ntz"}


def _model(spark):
    ev = spark.read.parquet(EV).select("event_id", "ts", "event_type", "value")
    spec = ML.ModelSpec("events", "regression", "decision_tree", "value", ("event_type",), split_key=("event_id",))
    return ML.build_model(ev, spec).model


def test_stream_equals_batch(spark):
    ev = spark.read.parquet(EV)
    model = _model(spark)
    path = scratch_path(spark, "s=b")
    publish(to_messages(ev.repartition(3), "event_type"), TopicSource(None, path=path))
    sub = subscribe(spark, TopicSource(None, path=path, max_per_trigger=1), hints=HINTS)
    out = scratch_path(spark, "s=b-out")
    score_stream(spark, scoring_rows(spark, sub, "value"), model, f"{out}/t", f"{out}/c")
    streamed = spark.read.parquet(f"{out}/t").select("event_id", "prediction")
    batch = ML.predict(model, ev).select("event_id", "prediction")
    assert streamed.count() == ev.count()
    assert streamed.exceptAll(batch).count() == 0


def test_running_rmse_across_batches_equals_window(spark):
    ev = spark.read.parquet(EV).where(hash_fraction("event_id") >= 0.5)
    model = _model(spark)
    path = scratch_path(spark, "ordered")
    target = TopicSource(None, path=path)
    root = scratch_path(spark, "live")
    cuts = [0, 300, 650, 1001]
    sub = None
    for lo, hi in zip(cuts, cuts[1:]):
        # files arrive in event order, one run per arrival
        part = ev.where((F.col("event_id") >= lo) & (F.col("event_id") < hi))
        publish(to_messages(part, "event_type"), target, mode="append")
        if sub is None:
            sub = subscribe(spark, TopicSource(None, path=path), hints=HINTS)
        running_rmse_stream(
            spark, scoring_rows(spark, sub, "value"), model, f"{root}/out", f"{root}/state", f"{root}/ckpt", ["ts", "event_id"]
        )
    got = spark.read.parquet(f"{root}/out")
    assert got.select("batch_id").distinct().count() == 3
    scored = ML.predict(model, ev.withColumnRenamed("value", "label")).withColumnRenamed("event_type", "topic")
    w = Window.partitionBy("topic").orderBy("ts", "event_id")
    want = scored.select(
        "event_id",
        F.row_number().over(w).alias("seq_w"),
        F.sqrt(
            F.sum(F.pow(F.col("label") - F.col("prediction"), 2)).over(w.rowsBetween(Window.unboundedPreceding, 0))
            / F.row_number().over(w)
        ).alias("rmse_w"),
    )
    j = got.join(want, "event_id")
    assert j.count() == ev.count()
    assert j.where((F.col("seq") != F.col("seq_w")) | (F.abs(F.col("running_rmse") - F.col("rmse_w")) > 1e-9)).count() == 0


def test_timed_rebuild_versions(spark):
    ev = spark.read.parquet(EV)
    path = scratch_path(spark, "rebuild")
    publish(to_messages(ev.repartitionByRange(3, "event_id"), "event_type"), TopicSource(None, path=path))
    sub = subscribe(spark, TopicSource("click", path=path, max_per_trigger=1), hints=HINTS)
    registry = ModelRegistry(spark, scratch_path(spark, "reg"))
    n_click = ev.where(F.col("event_type") == "click").count()
    for mode in ("all", "new"):
        # two models of one topic (names differ by algorithm)
        algo = "decision_tree" if mode == "all" else "random_forest"
        spec = ML.ModelSpec("click", "regression", algo, "value", ("user_id",), split_key=("event_id",), rebuild_mode=mode)
        root = scratch_path(spark, "job")
        start_rebuild(spark, scoring_rows(spark, sub), spec, registry, f"{root}/rows", f"{root}/ckpt", trigger="availableNow")
    log = registry.log()
    assert log.groupBy("name").count().where(F.col("count") == 3).count() == 2
    latest = {r["name"]: r for r in registry.latest().collect()}
    assert latest["clickregressionvaluedecision_tree"]["n_build"] == n_click
    new_total = log.where(F.col("rebuild_mode") == "new").agg(F.sum("n_build")).first()[0]
    assert new_total == n_click
    reloaded = ML.load(latest["clickregressionvaluedecision_tree"]["model_path"])
    assert ML.predict(reloaded, ev).count() == ev.count()
    registry.remove_topic("click")
    assert registry.latest().count() == 0


def test_rebuild_on_processing_time_trigger(spark):
    ev = spark.read.parquet(EV)
    path = scratch_path(spark, "rebuild-timer")
    publish(to_messages(ev.repartitionByRange(2, "event_id"), "event_type"), TopicSource(None, path=path))
    sub = subscribe(spark, TopicSource("view", path=path, max_per_trigger=1), hints=HINTS)
    registry = ModelRegistry(spark, scratch_path(spark, "reg-timer"))
    spec = ML.ModelSpec("view", "regression", "decision_tree", "value", ("user_id",), split_key=("event_id",),
                        rebuild_mode="new", rebuild_minutes=1)
    root = scratch_path(spark, "job-timer")
    q = start_rebuild(spark, scoring_rows(spark, sub), spec, registry, f"{root}/rows", f"{root}/ckpt", trigger="1 second")
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    log = registry.log()
    assert log.count() == 2
    assert log.agg(F.sum("n_build")).first()[0] == ev.where(F.col("event_type") == "view").count()


def test_scoring_swaps_in_rebuilt_model(spark):
    from tidepool.streaming.score import score_with_registry

    ev = spark.read.parquet(EV)
    path = scratch_path(spark, "swap")
    target = TopicSource(None, path=path)
    registry = ModelRegistry(spark, scratch_path(spark, "reg-swap"))
    spec = ML.ModelSpec("click", "regression", "decision_tree", "value", ("user_id",), split_key=("event_id",))
    jobs, out = scratch_path(spark, "swap-jobs"), scratch_path(spark, "swap-out")
    for lo, hi in [(0, 500), (500, 1001)]:
        part = ev.where((F.col("event_id") >= lo) & (F.col("event_id") < hi))
        publish(to_messages(part, "event_type"), target, mode="append")
        click = subscribe(spark, TopicSource("click", path=path), hints=HINTS)
        view = subscribe(spark, TopicSource("view", path=path), hints=HINTS)
        start_rebuild(spark, scoring_rows(spark, click), spec, registry, f"{jobs}/rows", f"{jobs}/ckpt", trigger="availableNow")
        score_with_registry(spark, scoring_rows(spark, view), registry, spec.name, f"{out}/t", f"{out}/ckpt")
    used = {r["batch_id"]: r["model_version"] for r in spark.read.parquet(f"{out}/t").select("batch_id", "model_version").distinct().collect()}
    assert used == {0: 0, 1: 1}
    assert spark.read.parquet(f"{out}/t").count() == ev.where(F.col("event_type") == "view").count()


def test_rebuild_survives_unlucky_batches_and_other_builds(spark, tmp_path):
    """build -> rebuild -> score -> remove -> rebuild: one answer; a batch with a
    single row (no build row) is skipped, not fatal."""
    registry = ModelRegistry(spark, str(tmp_path / "reg"))
    spec = ML.ModelSpec("click", "regression", "decision_tree", "value", ("user_id",), split_key=("event_id",), rebuild_mode="new")
    ev = spark.read.parquet(EV).where(F.col("event_type") == "click").select("event_id", "user_id", "value")
    lone = ev.where(hash_fraction("event_id") >= 0.5).limit(1)
    assert rebuild_once(spark, ML.training_rows(ev, spec), spec, registry) == 0

    def rebuild():
        rows = spark.readStream.schema(ev.schema).parquet(str(tmp_path / "in"))
        start_rebuild(spark, rows, spec, registry, str(tmp_path / "rows"), str(tmp_path / "ckpt"), trigger="availableNow")

    for part in (lone, ev):
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        rebuild()
    log = {r["version"]: r["status"] for r in registry.log().collect()}
    assert log == {0: "built", 1: "skipped", 2: "built"}
    assert registry.latest_for(spec)["version"] == registry.latest().first()["version"] == 2
    registry.remove_topic("click")
    assert registry.latest_for(spec) is None
    ev.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    rebuild()
    assert registry.latest_for(spec)["version"] == registry.latest_for(spec.name)["version"] == 4


def test_classification_version_keeps_its_cells(spark, tmp_path):
    registry = ModelRegistry(spark, str(tmp_path / "reg"))
    ev = spark.read.parquet(EV).withColumn("kind", F.when(F.col("event_id") % 10 != 0, F.col("event_type")))
    spec = ML.ModelSpec("t", "classification", "decision_tree", "kind", ("value",), split_key=("event_id",))
    rebuild_once(spark, ML.training_rows(ev, spec), spec, registry)
    entry = registry.latest_for(spec)
    validation = ev.where(hash_fraction("event_id") >= 0.5).count()
    assert sum(c["n"] for c in entry["cells"]) == validation
    assert entry["n_unlabelled"] == ev.where("kind IS NULL").count() and entry["n_build"] == ev.count()


def test_workspace_flow(spark):
    from tidepool.workspace import Workspace

    ev = spark.read.parquet(EV)
    path = scratch_path(spark, "ws-topics")
    publish(to_messages(ev, "event_type"), TopicSource(None, path=path))
    ws = Workspace(spark)
    for t in ("click", "view"):
        ws.subscribe(TopicSource(t, path=path), hints=HINTS)
        ws.ingest(t)
    spec = ML.ModelSpec("click", "regression", "decision_tree", "value", ("user_id",), split_key=("event_id",),
                        build_source="click", scoring_source="view")
    ws.add_model(spec)
    ws.add_model(spec)  # same name: replaced, still one model
    assert list(ws.models) == [spec.name]
    ws.build(spec.name)
    ws.build(spec.name)
    assert sorted(r["version"] for r in ws.registry.log().collect()) == [0, 1]
    _, out = ws.score(spec.name)
    scored = spark.read.parquet(out)
    assert scored.count() == ev.where(F.col("event_type") == "view").count()
    assert {r[0] for r in scored.select("model_version").distinct().collect()} == {1}
    ws.remove_models("click")
    assert ws.models == {} and ws.registry.latest().count() == 0
    import uuid

    compacted = ws.compact("click", f"click_{uuid.uuid4().hex[:8]}", ["ts", "event_id"])
    assert compacted.count() == ws.history("click").count()
    import pytest

    with pytest.raises(LookupError):
        ws.add_model(ML.ModelSpec("nope", "regression", "decision_tree", "value", ("user_id",)))


def test_sequence_stream_across_batches(spark):
    from tidepool.streaming.score import prefix_stream, read_sequence

    ev = spark.read.parquet(EV)
    path = scratch_path(spark, "seq-ordered")
    target = TopicSource(None, path=path)
    root = scratch_path(spark, "seq")
    sub = None
    for lo, hi in [(0, 333), (333, 700), (700, 1001)]:
        publish(to_messages(ev.where((F.col("event_id") >= lo) & (F.col("event_id") < hi)), "event_type"), target, mode="append")
        sub = sub or subscribe(spark, TopicSource(None, path=path), hints=HINTS)
        rows = scoring_rows(spark, sub).select("topic", "ts", "event_id", "value")
        prefix_stream(spark, rows, f"{root}/out", f"{root}/state", f"{root}/ckpt", ["ts", "event_id"], sums={"cum": "value"})
    got = read_sequence(spark, f"{root}/out", f"{root}/state")
    w = Window.partitionBy("event_type").orderBy("ts", "event_id")
    want = ev.select(
        "event_id",
        F.row_number().over(w).alias("seq_w"),
        F.row_number().over(Window.partitionBy("event_type").orderBy(F.desc("ts"), F.desc("event_id"))).alias("new_w"),
        F.sum("value").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("cum_w"),
    )
    j = got.join(want, "event_id")
    assert j.count() == ev.count()
    bad = j.where((F.col("seq") != F.col("seq_w")) | (F.col("seq_newest") != F.col("new_w")) | (F.abs(F.col("cum") - F.col("cum_w")) > 1e-6))
    assert bad.count() == 0


def test_workspace_builds_from_csv(spark):
    from tidepool.workspace import Workspace

    ev = spark.read.parquet(EV)
    topics = scratch_path(spark, "ws-csv-topics")
    publish(to_messages(ev, "event_type"), TopicSource(None, path=topics))
    csv = scratch_path(spark, "upload") + ".csv"
    ev.select("event_id", "user_id", "value").write.option("header", True).csv(csv)
    ws = Workspace(spark)
    ws.subscribe(TopicSource("view", path=topics), hints=HINTS)
    ws.ingest("view")
    spec = ML.ModelSpec("view", "regression", "decision_tree", "value", ("user_id",), split_key=("event_id",),
                        build_source=csv, rebuild_minutes=None)
    ws.add_model(spec)
    ws.build(spec.name)
    (entry,) = ws.registry.latest().collect()
    assert entry["n_build"] == ev.count() and entry["metric_name"] == "rmse"
    _, out = ws.score(spec.name)
    assert spark.read.parquet(out).count() == ev.where(F.col("event_type") == "view").count()
