"""Timed model rebuild, and the model version in force at any time.

``start_rebuild`` is a streaming query over a topic with a processing-time
trigger equal to the rebuild interval.  Each micro-batch holds exactly the
rows that arrived since the previous rebuild -- Structured Streaming's offset
tracking *is* "only new data".  The model is fitted on those rows
(``rebuild_mode="new"``) or on all rows so far (``"all"``), saved,
judged on the validation side and recorded under the registry's next version.
"All" costs no copies: naive Bayes adds the batch's counts to those it has (see
``tally``; two folders take turns), other models read the one history that is given;
only without one are the training columns of every batch kept under ``batch_id=N``.
A batch that cannot build the model (no build row, one category ...) is
recorded as skipped with the reason; the standing model stays in force.

``rebuild_plan`` is the replayable form for analysis: ticks of event time,
rows new in each tick and rows available in total.  ``model_as_of`` finds for
every row the newest version built before it (an as-of join), ``score_as_of``
scores it with that version: one plan, however many versions are in force.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import metrics as M
from ..operators import models as ML
from ..operators.asof import asof_join
from ..operators.model_data import export, score_rows, score_versions
from ..operators.prefix import ordered_prefix
from ..operators.registry import ModelRegistry
from ..operators.tally import BUILD, N, fit_tally, merge_tallies, tally
from ..session import scratch_path


def rebuild_once(
    spark: SparkSession,
    rows: DataFrame,
    spec: ML.ModelSpec,
    registry: ModelRegistry,
    job: str = "build",
    batch_id: int | None = None,
    built_at: dt.datetime | None = None,
) -> int | None:
    """Build, judge and record one version from ``training_rows``; its number.
    None when there are no rows or they cannot build the model (recorded)."""
    try:
        built = ML.train(rows, spec)
    except ML.UnfitData as exc:
        version = registry.allocate(spec, job, batch_id)
        registry.record(spec, version, 0, None, None, None, built_at, status="skipped", reason=str(exc), job=job, batch_id=batch_id)
        return None
    if built is None:
        return None
    version = registry.allocate(spec, job, batch_id)
    path = ML.save(built.model, registry.new_model_path(spec, version))
    registry.put_record(spec, version, export(spark, built.model, path))
    registry.record(
        spec, version, built.n_rows, built.metric_name, built.metric_value, path, built_at,
        n_unlabelled=built.n_unlabelled, cells=built.cells, job=job, batch_id=batch_id,
    )
    return version


def rebuild_from_tally(
    counts: DataFrame,
    spec: ML.ModelSpec,
    registry: ModelRegistry,
    job: str = "build",
    batch_id: int | None = None,
    built_at: dt.datetime | None = None,
) -> int | None:
    """Build, judge and record a naive Bayes version from a tally of all rows; its number.
    None when the rows cannot build it (recorded) or there are none."""
    n, labelled = counts.agg(F.sum(N), F.sum(F.when(F.col("label").isNotNull(), F.col(N)))).first()
    if not n:
        return None
    try:
        record = fit_tally(counts, spec)
    except ML.UnfitData as exc:
        version = registry.allocate(spec, job, batch_id)
        registry.record(spec, version, 0, None, None, None, built_at, status="skipped", reason=str(exc), job=job, batch_id=batch_id)
        return None
    judged = score_rows(counts.where(~F.col(BUILD)), record, "prediction", as_text=True)
    cells = [tuple(r) for r in M.confusion_long(judged, weight=N).collect()]  # classes squared
    total = sum(c for _, _, c in cells)
    hits = sum(c for a, p, c in cells if a is not None and a == p)
    version = registry.allocate(spec, job, batch_id)
    registry.put_record(spec, version, record)
    registry.record(
        spec, version, int(n), "accuracy", hits / total if total else None, None, built_at,
        n_unlabelled=int(n - (labelled or 0)), cells=cells, job=job, batch_id=batch_id,
    )
    return version


def start_rebuild(
    spark: SparkSession,
    rows: DataFrame,
    spec: ML.ModelSpec,
    registry: ModelRegistry,
    data_path: str,
    checkpoint: str,
    trigger: str | None = None,
    history: Callable[[], DataFrame] | None = None,
) -> StreamingQuery:
    """Rebuild ``spec`` every ``spec.rebuild_minutes`` (or ``trigger``:
    ``"availableNow"`` replays the backlog, one version per micro-batch).
    ``history`` gives all rows so far for "all" rebuilds."""
    if spec.rebuild_minutes is None:
        raise ValueError("model has no rebuild interval (built from a file)")
    training = ML.training_rows(rows, spec)
    by_tally = spec.rebuild_mode == "all" and spec.algorithm == "naive_bayes" and not spec.params

    def add_up(batch: DataFrame, batch_id: int) -> DataFrame:
        counts = tally(batch, spec)
        try:
            if batch_id > 0:
                counts = merge_tallies(spark.read.schema(counts.schema).parquet(f"{data_path}/turn={(batch_id - 1) % 2}"), counts)
        except AnalysisException as exc:
            raise LookupError(f"the counts after batch {batch_id - 1} are missing under {data_path}") from exc
        # a retry of the batch finds the turn before as it was
        turn = f"{data_path}/turn={batch_id % 2}"
        counts.write.mode("overwrite").parquet(turn)
        return spark.read.schema(counts.schema).parquet(turn)

    def handle(batch: DataFrame, batch_id: int) -> None:
        if registry.recorded(spec, checkpoint, batch_id):
            return  # a retry of a batch that has its entry
        if by_tally:
            counts, new = add_up(batch, batch_id), not batch.isEmpty()
            if new:
                rebuild_from_tally(counts, spec, registry, checkpoint, batch_id)
            return
        if spec.rebuild_mode == "new":
            rebuild_once(spark, batch, spec, registry, checkpoint, batch_id)
            return
        if history is not None:
            if not batch.isEmpty():
                rebuild_once(spark, ML.training_rows(history(), spec), spec, registry, checkpoint, batch_id)
            return
        batch.write.mode("overwrite").parquet(f"{data_path}/batch_id={batch_id}")
        schema = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in training.schema.fields)}, batch_id bigint"
        so_far = spark.read.schema(schema).parquet(data_path).where(F.col("batch_id") <= batch_id)
        # nothing new since the last rebuild: the model stands
        if not so_far.where(F.col("batch_id") == batch_id).isEmpty():
            rebuild_once(spark, so_far.drop("batch_id"), spec, registry, checkpoint, batch_id)

    writer = training.writeStream.option("checkpointLocation", checkpoint).foreachBatch(handle)
    if trigger == "availableNow":
        q = writer.trigger(availableNow=True).start()
        q.awaitTermination()
        return q
    every = trigger or f"{spec.rebuild_minutes} minutes"
    return writer.trigger(processingTime=every).start()


def rebuild_plan(history: DataFrame, ts: str, every: str, group: str = "topic") -> DataFrame:
    """Per group and tick of ``every`` (event time): ``tick_end``, rows new
    in the tick (what an "only new data" rebuild uses) and rows available
    at the tick's end (what an "all data" rebuild uses)."""
    ticks = history.groupBy(group, F.window(F.col(ts), every).alias("w")).agg(F.count(F.lit(1)).alias("n_new"))
    ticks = ticks.select(group, F.col("w.end").alias("tick_end"), "n_new")
    return ordered_prefix(ticks, ["tick_end"], [group], sums={"n_all": "n_new"}).select(group, "tick_end", "n_new", "n_all")


def model_as_of(rows: DataFrame, versions: DataFrame, group: str, ts: str, built_at: str) -> DataFrame:
    """Every row with the newest model version built at or before its time."""
    return asof_join(rows, versions, [group], ts, built_at)


def score_as_of(spark: SparkSession, rows: DataFrame, spec: ML.ModelSpec, registry: ModelRegistry, ts: str) -> DataFrame:
    """Every row scored with the model version in force at its time ``ts``:
    ``prediction`` and ``model_version``, NULL before the first version and
    after a removal.

    The as-of join's rows are scored by their versions' records: one plan for all
    versions, and none is loaded.  Versions without a record (from before there were
    any) are loaded and written down once."""
    own = registry.entries(spec)
    if own is None:
        raise LookupError(f"model {spec.name!r} has no version")
    built = own.where(F.col("status") == "built")
    missing = built.join(registry.records(spec), "version", "left_anti").select("version", "model_path").dropDuplicates(["version"])
    for entry in missing.collect():  # versions of an older registry, once
        registry.put_record(spec, entry["version"], export(spark, ML.load(entry["model_path"]), entry["model_path"]))
    key = "_asof_model"
    entries = own.where(F.col("status") != "skipped").select(
        F.lit(0).alias(key), F.col("built_at").alias("_built_at"), F.col("version").alias("model_version"), F.col("removed").alias("_removed")
    )
    found = asof_join(rows.withColumn(key, F.lit(0)), entries, [key], ts, "_built_at").drop(key, "_built_at")
    found = found.withColumn("model_version", F.when(~F.col("_removed"), F.col("model_version"))).drop("_removed")
    # the join's partitions are bounded slices of the rows; written once, they keep their numbers
    path = scratch_path(spark, "score-as-of")
    found.withColumn("_part", F.spark_partition_id()).write.parquet(path)
    staged = spark.read.schema(f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in found.schema.fields)}, _part int").parquet(path)
    scored = score_versions(staged, registry.records(spec), "model_version", "_part", "prediction", spec.kind == ML.CLASSIFICATION)
    return scored.select(*rows.columns, "prediction", "model_version")
