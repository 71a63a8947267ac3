"""Subscribe to topics and keep their append-only history.

``subscribe`` checks the source, infers the message schema once over all
messages present and pins it.  ``ingest`` starts the Structured Streaming query:
message frame -> JSON decode (array-or-object, unreadable dropped) -> flatten
-> Parquet file sink partitioned by ``topic`` with a checkpoint (unpartitioned, the topic a
column of its files, where the source keeps no folder per topic).  The file
sink's metadata log gives exactly-once appends, and a restart on the same
checkpoint resumes where it stopped.

Order is never storage order: rows carry the message coordinates
(``_partition``, ``_offset``, ``_timestamp``, ``_pos``), the micro-batch time
``_ingested_at`` and their payload; "newest" is decided by a query (see
``operators.series``).
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..functions import json as J
from ..operators.series import latest
from ..session import scratch_path
from ..sources.topic import TopicSource, check_source, read_batch, read_stream, with_text_topic

#: Folders that a live aggregate's snapshots take turns in: a reader has some batches' time.
SNAPSHOTS = 4
BATCH = "_batch_id"
META_COLS = ["topic", "_partition", "_offset", "_timestamp"]
ARRIVAL = "_ingested_at"
#: In a compact table: the compaction run that brought a row.
RUN = "_compacted_by"
#: With a quarantine in the history: the folder a row is in, a message's reason and text.
KIND, REASON, RAW, ROWS = "_kind", "_reason", "_raw", "rows"


@dataclass
class Subscription:
    """A topic with its pinned schema and its history/checkpoint folders."""

    source: TopicSource
    schema: T.StructType
    history_path: str
    checkpoint_path: str
    sep: str = "_"
    rescue: bool = True
    quarantine: bool = False

    def _written(self, spark: SparkSession) -> DataFrame:
        found = spark.read.parquet(self.history_path).schema
        return spark.read.schema(with_text_topic(found)).parquet(self.history_path)

    def history(self, spark: SparkSession) -> DataFrame:
        """The append-only history written so far (a batch frame); topics are
        text, also where the folder's name looks like a number."""
        rows = self._written(spark)
        return rows.where(F.col(KIND) == ROWS).drop(KIND, REASON, RAW) if self.quarantine else rows

    def quarantined(self, spark: SparkSession) -> DataFrame:
        """The messages kept aside so far: coordinates, ``value`` and ``reason``."""
        if not self.quarantine:
            raise LookupError("the topic is not subscribed with quarantine=True")
        bad = self._written(spark).where(F.col(KIND) != ROWS)
        return bad.select(*META_COLS, ARRIVAL, F.col(RAW).alias("value"), F.col(REASON).alias("reason"))

    def attributes(self) -> list[tuple[str, str]]:
        return J.attributes(self.schema, self.sep)


def subscribe(
    spark: SparkSession,
    source: TopicSource,
    schema: T.StructType | None = None,
    hints: Mapping[str, str] | None = None,
    sample_rows: int | None = None,
    sep: str = "_",
    root: str | None = None,
    rescue: bool = True,
    quarantine: bool = False,
) -> Subscription:
    """Check the source, pin the message schema, allocate history folders.
    With ``quarantine`` the history's stream keeps messages that do not decode cleanly,
    too, in a folder of their own beside the rows: one reading, one commit for both.
    What the pinned schema cannot hold (unknown fields, values of another type)
    is kept as JSON text in the history's ``_rescued`` column unless ``rescue=False``."""
    # without a given schema, inference reads the messages anyway and an
    # empty topic shows up as an empty schema
    check_source(spark, source, probe=schema is not None)
    if schema is None:
        schema = J.infer_schema(read_batch(spark, source), sample_rows=sample_rows, hints=hints)
        if not schema.fields and source.name is not None:
            raise LookupError(f"topic {source.name!r} has no readable message")
    elif hints:
        schema = J.apply_hints(schema, hints)
    root = root or scratch_path(spark, "topic")
    return Subscription(source, schema, f"{root}/history", f"{root}/checkpoint", sep, rescue, quarantine)


def decoded_rows(messages: DataFrame, schema: T.StructType, sep: str = "_", rescue: bool = True, quarantine: bool = False) -> DataFrame:
    """Message frame -> one flat row per JSON object (metadata kept); a payload
    field called like one of the columns added here gets ``_msg`` behind its name."""
    renamed = messages.select(
        "topic",
        F.col("partition").alias("_partition"),
        F.col("offset").alias("_offset"),
        F.col("timestamp").alias("_timestamp"),
        "value",
    )
    rescued = "_rescued" if rescue else None
    bad = {"reason_col": REASON, "raw_col": RAW} if quarantine else {}
    reserved = [ARRIVAL, "_rescued", KIND, REASON, RAW]
    rows = J.decode(renamed, schema, keep=META_COLS, position_col="_pos", rescued_col=rescued, reserved=reserved, **bad)
    payload = [c for c in rows.columns if c not in META_COLS and c != "_pos"]
    flat = J.flatten(rows, sep=sep, columns=META_COLS + ["_pos"] + payload)
    # In a stream, current_timestamp() is the micro-batch's time, kept in the
    # offset log (a retried batch gets the same value): an arrival coordinate
    # for "rows new since the last build" on any topic.
    return flat.withColumn(ARRIVAL, F.current_timestamp())


def ingest(
    spark: SparkSession,
    sub: Subscription,
    trigger: str | None = "availableNow",
    query_name: str | None = None,
) -> StreamingQuery:
    """Start the history stream.  ``trigger="availableNow"`` replays what is
    there and stops (awaited here); ``"1 second"`` etc. runs continuously."""
    rows = decoded_rows(read_stream(spark, sub.source), sub.schema, sub.sep, sub.rescue, sub.quarantine)
    folders = ["topic"] if sub.source.topic_folders else []
    if sub.quarantine:
        rows = rows.withColumn(KIND, F.when(F.col(REASON).isNull(), F.lit(ROWS)).otherwise(F.lit("quarantine")))
        folders = [KIND, *folders]
    writer = (
        rows.writeStream.format("parquet")
        .option("path", sub.history_path)
        .option("checkpointLocation", sub.checkpoint_path)
        .outputMode("append")
    )
    if folders:
        writer = writer.partitionBy(*folders)
    if query_name:
        writer = writer.queryName(query_name)
    if trigger == "availableNow":
        q = writer.trigger(availableNow=True).start()
        q.awaitTermination()
        return q
    q = writer.trigger(processingTime=trigger).start() if trigger else writer.start()
    return q


def live_aggregate(
    spark: SparkSession,
    sub: Subscription,
    aggregate,
    name: str,
    trigger: str | None = "availableNow",
    rescue: bool = False,
) -> tuple[StreamingQuery, str]:
    """Run ``aggregate(rows) -> grouped frame`` as a streaming aggregation.
    Its rows have no ``_rescued`` unless ``rescue=True``: an aggregate rarely reads it,
    and it is most of the decoding.

    Complete mode: every micro-batch emits the whole current result (one
    row per group).  ``SNAPSHOTS`` folders take turns; each snapshot is one
    file (committed whole by its rename) whose rows carry the batch number, and
    ``read_live`` takes the newest -- neither the folder nor the reading grows
    with the stream's age, and a retried batch replaces itself.  Meant for
    aggregates with few groups (per topic); returns the query and the
    snapshot folder.

    The state store has the session's shuffle partitions, fixed when the query
    first starts and kept in its checkpoint.
    """
    root = f"{sub.checkpoint_path}-{name}"
    log_path = f"{root}/table"
    rows = decoded_rows(read_stream(spark, sub.source), sub.schema, sub.sep, rescue)
    result = aggregate(rows)

    def sink(batch: DataFrame, batch_id: int) -> None:
        snapshot = batch.withColumn(BATCH, F.lit(batch_id).cast("bigint")).coalesce(1)
        snapshot.write.mode("overwrite").parquet(f"{log_path}/turn={batch_id % SNAPSHOTS}")

    writer = result.writeStream.outputMode("complete").option("checkpointLocation", f"{root}/checkpoint").foreachBatch(sink)
    if trigger == "availableNow":
        writer = writer.trigger(availableNow=True)
    elif trigger:
        writer = writer.trigger(processingTime=trigger)
    q = writer.start()
    if trigger == "availableNow":
        q.awaitTermination()
    return q, log_path


def read_live(spark: SparkSession, log_path: str) -> DataFrame:
    """The newest snapshot of a live aggregate."""
    turns = spark.read.parquet(log_path).drop("turn")
    newest = turns.agg(F.max(BATCH)).first()[0]
    if newest is None:
        raise LookupError(f"no snapshot under {log_path}")
    return turns.where(F.col(BATCH) == newest).drop(BATCH)


def live_counts(
    spark: SparkSession,
    sub: Subscription,
    trigger: str | None = "availableNow",
) -> tuple[StreamingQuery, str]:
    """Running message count per topic (the "Total number of messages" box)."""
    return live_aggregate(
        spark,
        sub,
        lambda rows: rows.groupBy("topic").agg(F.count(F.lit(1)).alias("n_messages")),
        "counts",
        trigger,
    )


def read_counts(spark: SparkSession, counts_path: str) -> DataFrame:
    return read_live(spark, counts_path)


def live_latest(
    spark: SparkSession,
    sub: Subscription,
    order_by: list[str],
    trigger: str | None = "availableNow",
) -> tuple[StreamingQuery, str]:
    """Newest message per topic, kept as streaming state: one ``max_by``
    per topic, no sort and no history scan."""
    def newest(rows: DataFrame) -> DataFrame:
        payload = [c for c in rows.columns if c not in ("_partition", "_offset", "_timestamp", "_pos", "_ingested_at")]
        return latest(rows.select(*payload), order_by, ["topic"])

    return live_aggregate(spark, sub, newest, "latest", trigger)


def start_quarantine(
    spark: SparkSession, sub: Subscription, path: str | None = None, trigger: str | None = "availableNow"
) -> tuple[StreamingQuery, str]:
    """Keep messages that do not decode cleanly (a stream of its own; ``subscribe`` with
    ``quarantine=True`` reads each message once for both) -- unreadable text, JSON
    that is not objects, objects with a wrong-typed leaf or a number of more
    digits than its column -- with a ``reason``, in their own Parquet folder."""
    path = path or f"{sub.checkpoint_path}-quarantine/table"
    msgs = read_stream(spark, sub.source)
    bad = msgs.withColumn("reason", J.classify(msgs, sub.schema)).where(F.col("reason").isin(*J.BAD))
    writer = (
        bad.writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", f"{sub.checkpoint_path}-quarantine/checkpoint")
        .outputMode("append")
    )
    if trigger == "availableNow":
        q = writer.trigger(availableNow=True).start()
        q.awaitTermination()
    else:
        q = writer.trigger(processingTime=trigger).start() if trigger else writer.start()
    return q, path


def compact_history(spark: SparkSession, sub: Subscription, store, table: str, order_by: list[str]) -> DataFrame:
    """Bring a compact, clustered catalog table up to date with the history.

    A fast trigger leaves many small files in the live history.  This batch
    job (run periodically) range-partitions the rows by ``(topic,
    *order_by)`` -- AQE sizes the files, and a hot topic spans many of them
    -- and sorts each file, so every file covers a contiguous key range and
    Parquet min/max statistics prune time-range scans.  The live history stays untouched.

    Which rows are new is told by the history's files, not by a clock: the files whose
    rows the table has are listed under ``<history>-compacted``, in numbered runs.  A
    run first writes down its files, then its rows, which carry the run's number (``RUN``),
    then that it is done; a run that died is finished by the next call with the same
    files, without the rows it may have left.  One compaction at a time.
    """
    keys = ["topic", *order_by]
    log = f"{sub.history_path.rstrip('/')}-compacted"

    def runs(kind: str) -> DataFrame | None:
        try:
            return spark.read.schema("run bigint, file string").parquet(f"{log}/{kind}")
        except AnalysisException as exc:
            if exc.getCondition() == "PATH_NOT_FOUND":
                return None
            raise

    listed, done = runs("listed"), runs("done")
    last = -1 if listed is None else listed.agg(F.coalesce(F.max("run"), F.lit(-1))).first()[0]
    finished = -1 if done is None else done.agg(F.coalesce(F.max("run"), F.lit(-1))).first()[0]
    rows = sub.history(spark).withColumn("_file", F.col("_metadata.file_path"))
    run = last
    if last == finished:
        run = last + 1
        new = rows.select(F.col("_file").alias("file")).distinct()
        if listed is not None:
            new = new.join(listed.select("file"), "file", "left_anti")
        if new.isEmpty() and store.exists(table):
            return store.read(table)
        new.select(F.lit(run).cast("bigint").alias("run"), "file").coalesce(1).write.mode("overwrite").parquet(f"{log}/listed/n={run}")
    files = runs("listed").where(F.col("run") == run).select(F.col("file").alias("_file"))
    fresh = rows.join(files, "_file", "left_semi").drop("_file").withColumn(RUN, F.lit(run).cast("bigint"))
    if run == last and store.exists(table) and not store.read(table).where(F.col(RUN) == run).isEmpty():
        # rows of a run that died while, or after, it wrote
        store.overwrite(table, store.read(table).where(F.col(RUN) != run))
    store.append(table, fresh.repartitionByRange(*keys).sortWithinPartitions(*keys))
    marker = spark.range(1).select(F.lit(run).cast("bigint").alias("run"), F.lit(None).cast("string").alias("file"))
    marker.coalesce(1).write.mode("overwrite").parquet(f"{log}/done/n={run}")
    return store.read(table)
