"""Scoring streams: predict every incoming row once, and keep a running RMSE
across micro-batches.

``score_stream``: decoded topic rows -> ``PipelineModel.transform`` (all
stages are row-wise, so the model runs inside the streaming plan) -> append
sink.  Each row is scored exactly once; the dashboard's re-scoring of its
whole accumulated frame on every refresh is not reproduced.

``running_rmse_stream``: per micro-batch, the batch's rows are ranked and
their squared errors prefix-summed with the distributed ordered prefix,
shifted by the per-topic totals of all earlier batches (a small state
table).  Output is written under ``batch_id=N`` folders and state in two folders
that take turns, both with overwrite, so a retried batch replaces itself; batch N
reads the complete state written by batch N-1 only.  No key's rows ever meet in one task.

``prefix_stream`` is the general form (sequence axis and running sums of
any column); ``read_sequence`` adds newest-first numbering at read time.

``score_with_registry``: each micro-batch is scored with the newest
registered version of a model, so rebuilt models are swapped in.
"""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.utils import AnalysisException

from ..operators.model_data import score_rows
from ..operators.models import CLASSIFICATION, ModelSpec, load, predict
from ..operators.prefix import ordered_prefix
from ..sources.topic import read_stream
from .ingest import Subscription, decoded_rows


def _run(writer, trigger: str | None) -> StreamingQuery:
    if trigger == "availableNow":
        q = writer.trigger(availableNow=True).start()
        q.awaitTermination()
        return q
    return writer.trigger(processingTime=trigger).start() if trigger else writer.start()


def scoring_rows(spark: SparkSession, sub: Subscription, label: str | None = None, rescue: bool = False) -> DataFrame:
    """The topic's rows with the label column as ``label``; ``_rescued`` only if asked for
    (the history keeps it, and no model reads it)."""
    rows = decoded_rows(read_stream(spark, sub.source), sub.schema, sub.sep, rescue)
    if label and label != "label":
        rows = rows.withColumnRenamed(label, "label")
    return rows


def score_stream(
    spark: SparkSession,
    rows: DataFrame,
    model: PipelineModel,
    out_path: str,
    checkpoint: str,
    trigger: str | None = "availableNow",
) -> StreamingQuery:
    """Append every scored row (input columns + prediction) to ``out_path``."""
    scored = predict(model, rows)
    if "probability" in scored.columns:
        scored = scored.withColumn("probability", vector_to_array("probability"))
    writer = (
        scored.writeStream.format("parquet")
        .option("path", out_path)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
    )
    return _run(writer, trigger)


#: Number of the micro-batch that a state folder stands for.
STATE_BATCH = "_state_batch"


def _state_before(spark: SparkSession, state_path: str, batch_id: int, group: str, names: list[str]) -> DataFrame | None:
    """Totals per group after batch ``batch_id - 1``.

    Every batch writes the complete state (groups absent from it keep their
    totals); two folders take turns, so neither the files nor the reading
    grow with the stream's age, and a batch that is run again finds its predecessor's.
    """
    if batch_id == 0:
        return None
    try:
        state = spark.read.parquet(f"{state_path}/turn={(batch_id - 1) % 2}")
    except AnalysisException as exc:
        raise LookupError(f"the state after batch {batch_id - 1} is missing under {state_path}") from exc
    known = state.agg(F.max(STATE_BATCH)).first()[0]
    if known is not None and known != batch_id - 1:
        raise LookupError(f"the state under {state_path} is of batch {known}, not {batch_id - 1}")
    return state.select(group, "n", *names)


def prefix_stream(
    spark: SparkSession,
    rows: DataFrame,
    out_path: str,
    state_path: str,
    checkpoint: str,
    order_by: list[str],
    group: str = "topic",
    sums: dict | None = None,
    finish=None,
    trigger: str | None = "availableNow",
) -> StreamingQuery:
    """Sequence number ``seq`` (1 = first row ever seen in the group) and
    running sums for every arriving row, incrementally.

    Per micro-batch the rows are ranked with the distributed ordered prefix
    (by ``order_by`` inside the batch), shifted by the group totals carried
    from the previous batch.  ``finish(ranked)`` may add derived columns
    before the write.  Newest-first numbering is ``n - seq + 1`` with ``n``
    from the latest state, so old rows never need rewriting.
    """
    sums = dict(sums or {})
    names = list(sums)

    def handle(batch: DataFrame, batch_id: int) -> None:
        base = _state_before(spark, state_path, batch_id, group, names)
        # two staging folders take turns: scratch does not grow with the stream
        ranked = ordered_prefix(
            batch, order_by, [group], sums=sums, rank_col="seq", base=base, staging=f"{state_path}-staged/turn={batch_id % 2}"
        )
        if finish is not None:
            ranked = finish(ranked)
        ranked.write.mode("overwrite").parquet(f"{out_path}/batch_id={batch_id}")
        done = spark.read.parquet(f"{out_path}/batch_id={batch_id}")
        totals = done.groupBy(group).agg(
            F.max("seq").alias("n"), *[F.max_by(c, "seq").alias(c) for c in names]
        )
        if base is not None:
            # groups absent from this batch keep their totals
            totals = base.join(totals, base[group].eqNullSafe(totals[group]), "left_anti").unionByName(totals)
        totals.withColumn(STATE_BATCH, F.lit(batch_id).cast("bigint")).write.mode("overwrite").parquet(f"{state_path}/turn={batch_id % 2}")

    writer = rows.writeStream.option("checkpointLocation", checkpoint).foreachBatch(handle)
    return _run(writer, trigger)


def read_sequence(spark: SparkSession, out_path: str, state_path: str, group: str = "topic") -> DataFrame:
    """Rows of a prefix stream with ``seq_newest`` (1 = newest row)."""
    out = spark.read.parquet(out_path)
    last = spark.read.parquet(state_path).groupBy(F.col(group).alias("_group")).agg(F.max_by("n", STATE_BATCH).alias("_n"))
    return out.join(last, out[group].eqNullSafe(last["_group"])).withColumn(
        "seq_newest", F.col("_n") - F.col("seq") + 1
    ).drop("_n", "_group")


def running_rmse_stream(
    spark: SparkSession,
    rows: DataFrame,
    model: PipelineModel,
    out_path: str,
    state_path: str,
    checkpoint: str,
    order_by: list[str],
    group: str = "topic",
    trigger: str | None = "availableNow",
) -> StreamingQuery:
    """Score each row and emit ``(group, seq, running_rmse)`` with ``seq``
    counting from the first row ever scored in the group.  Rows are ordered
    by ``order_by`` inside a micro-batch and by arrival across batches."""
    scored = predict(model, rows).select(group, *order_by, "label", "prediction")
    err2 = F.pow(F.col("label").cast("double") - F.col("prediction").cast("double"), 2)
    return prefix_stream(
        spark, scored, out_path, state_path, checkpoint, order_by, group,
        sums={"sse": err2, "n_errors": err2.isNotNull().cast("double")},
        # rows without an error (no label) do not count, as in the batch RMSE
        finish=lambda r: r.withColumn("running_rmse", F.when(F.col("n_errors") > 0, F.sqrt(F.col("sse") / F.col("n_errors")))),
        trigger=trigger,
    )


def score_with_registry(
    spark: SparkSession,
    rows: DataFrame,
    registry,
    model: ModelSpec | str,
    out_path: str,
    checkpoint: str,
    trigger: str | None = "availableNow",
    prediction_type: str | None = None,
) -> StreamingQuery:
    """Score each micro-batch with the newest version of ``model`` (its
    definition, or its display name) in the registry at the time the batch runs, so a rebuilt model is swapped
    in without restarting the stream.  Rows carry the ``model_version``
    used; rows that come before the first model are kept with a NULL
    prediction (text for a classification; ``prediction_type`` says so where only
    a name is given).  Output goes to ``batch_id=N`` folders (overwritten on retry)."""
    loaded: dict[str, PipelineModel] = {}
    if prediction_type is None:
        prediction_type = "string" if isinstance(model, ModelSpec) and model.kind == CLASSIFICATION else "double"

    def handle(batch: DataFrame, batch_id: int) -> None:
        live = registry.latest_for(model)
        if live is None:
            # No model yet: the rows are kept, without a prediction.
            none = batch.withColumn("prediction", F.lit(None).cast(prediction_type)).withColumn("model_version", F.lit(None).cast("bigint"))
            none.write.mode("overwrite").parquet(f"{out_path}/batch_id={batch_id}")
            return
        path = live["model_path"]
        if path is None:  # built from counts: there is only its record
            if not isinstance(model, ModelSpec):
                raise ValueError("a model that is built from counts is scored by its definition, not its name")
            record = registry.records(model).where(F.col("version") == live["version"]).first()["record"]
            scored = score_rows(batch, record, "prediction", model.kind == CLASSIFICATION)
            scored = scored.withColumn("model_version", F.lit(live["version"]).cast("bigint"))
            scored.write.mode("overwrite").parquet(f"{out_path}/batch_id={batch_id}")
            return
        if path not in loaded:  # a version's files never change; only the one in force is kept
            loaded.clear()
            loaded[path] = load(path)
        scored = predict(loaded[path], batch).withColumn("model_version", F.lit(live["version"]).cast("bigint"))
        if "probability" in scored.columns:
            scored = scored.withColumn("probability", vector_to_array("probability"))
        scored.write.mode("overwrite").parquet(f"{out_path}/batch_id={batch_id}")

    writer = rows.writeStream.option("checkpointLocation", checkpoint).foreachBatch(handle)
    return _run(writer, trigger)
