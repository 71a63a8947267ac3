"""Topic sources and the message publisher.

A topic is an unbounded sequence of byte messages.  On a cluster the source
is Spark's Kafka source (``subscribe``, ``startingOffsets=earliest``; every
streaming query already consumes with its own group, so each subscription
replays the whole topic).  The same reader accepts file topics: a folder of
text files with one JSON message per line (``fmt="text"``/``"json"``) or of
Parquet files with a ``value`` column (``fmt="parquet"``), optionally split
into ``topic=<name>`` sub-folders or, where topics are many, with the ``topic`` as a column
of the files.  That is how the tests and the bench stage
topics derived from the given tables (the Kafka connector jar is not part of
a plain PySpark install).

Every reader returns the same message frame::

    topic STRING, partition INT, offset BIGINT, timestamp TIMESTAMP, value STRING

Files of a Parquet topic are its partitions and rows their offsets: ``partition`` is a
31-bit hash of the file's path, ``offset`` the row's place in the file, ``timestamp``
the time the file was written (Spark's file metadata, so they are the same in
streams, batches and after a restart).  Text files have no row numbers: the three are
NULL for text topics, whose order is a property of the payload (event time, id).
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.utils import AnalysisException

from ..functions.json import JSON_OPTIONS

FILE_FORMATS = ("text", "json", "parquet")


@dataclass(frozen=True)
class TopicSource:
    """Where a topic's messages come from.

    ``name`` is the topic (``None`` with a file folder = every ``topic=``
    sub-folder, the topic becoming a column).  ``max_per_trigger`` throttles a
    micro-batch (files for file topics, offsets for Kafka).  ``topic_folders=False``:
    the topic is a column of Parquet files instead, also in the history, so that
    files do not grow with the number of topics.
    """

    name: str | None
    fmt: str = "text"
    path: str | None = None
    bootstrap_servers: str | None = None
    max_per_trigger: int | None = None
    options: dict = field(default_factory=dict)
    topic_folders: bool = True

    def __post_init__(self):
        if not self.topic_folders and self.fmt != "parquet":
            raise ValueError("only Parquet files hold the topic as a column")
        if self.fmt == "kafka":
            if not self.bootstrap_servers or not self.bootstrap_servers.strip():
                raise ValueError("bootstrap servers are empty")
            if not self.name or not self.name.strip():
                raise ValueError("topic name is empty")
        elif self.fmt in FILE_FORMATS:
            if not self.path:
                raise ValueError("file topic needs a path")
            if self.name is not None and not self.name.strip():
                raise ValueError("topic name is empty")
        else:
            raise ValueError(f"unknown topic format {self.fmt!r}")


def _message_frame(df: DataFrame, src: TopicSource) -> DataFrame:
    if src.fmt == "kafka":
        return df.select(
            F.col("topic"),
            F.col("partition"),
            F.col("offset"),
            F.col("timestamp"),
            F.col("value").cast("string").alias("value"),
        )
    topic = F.col("topic").cast("string") if "topic" in df.columns else F.lit(src.name)
    if src.fmt == "parquet":
        return df.select(
            topic.alias("topic"),
            F.xxhash64("_metadata.file_path").bitwiseAND(0x7FFFFFFF).cast("int").alias("partition"),
            F.col("_metadata.row_index").alias("offset"),
            F.col("_metadata.file_modification_time").alias("timestamp"),
            F.col("value"),
        )
    return df.select(
        topic.alias("topic"),
        F.lit(None).cast("int").alias("partition"),
        F.lit(None).cast("bigint").alias("offset"),
        F.lit(None).cast("timestamp").alias("timestamp"),
        F.col("value"),
    )


def _kafka_reader(reader, src: TopicSource, streaming: bool):
    r = (
        reader.format("kafka")
        .option("kafka.bootstrap.servers", src.bootstrap_servers)
        .option("subscribe", src.name)
        .option("startingOffsets", "earliest")
    )
    if streaming and src.max_per_trigger:
        r = r.option("maxOffsetsPerTrigger", str(src.max_per_trigger))
    for k, v in src.options.items():
        r = r.option(k, v)
    return r


def _resolve(spark: SparkSession, src: TopicSource) -> str:
    """Folder to list.  A named topic inside a
    multi-topic folder reads only its ``topic=<name>`` sub-folder (the topic
    column then comes from the name), so other topics' files are never
    listed or read."""
    assert src.path is not None
    if src.name is None or not src.topic_folders:
        return src.path
    sub = f"{src.path.rstrip('/')}/topic={src.name}"
    try:
        spark.read.format("parquet" if src.fmt == "parquet" else "text").load(sub)
    except AnalysisException:
        return src.path
    return sub


def with_text_topic(schema: T.StructType) -> T.StructType:
    """``schema`` with ``topic`` as STRING: a partition folder's name is text,
    also where it looks like a number ("007")."""
    return T.StructType([T.StructField(f.name, T.StringType(), True) if f.name == "topic" else f for f in schema.fields])


def _file_reader(spark: SparkSession, reader, src: TopicSource, folder: str):
    """The reader of a file topic, the same for streams and batches."""
    fmt = "parquet" if src.fmt == "parquet" else "text"
    found = spark.read.format(fmt).options(**src.options).load(folder).schema
    reader = reader.format(fmt).options(**src.options)
    # A file stream of Parquet needs its schema up front; text needs one only for its folders.
    return reader.schema(with_text_topic(found)) if fmt == "parquet" or "topic" in found.names else reader


def read_stream(spark: SparkSession, src: TopicSource) -> DataFrame:
    """Streaming message frame of a topic, replayed from the earliest message."""
    if src.fmt == "kafka":
        return _message_frame(_kafka_reader(spark.readStream, src, True).load(), src)
    folder = _resolve(spark, src)
    reader = _file_reader(spark, spark.readStream, src, folder)
    if src.max_per_trigger:
        reader = reader.option("maxFilesPerTrigger", str(src.max_per_trigger))
    df = _message_frame(reader.load(folder), src)
    if src.name is not None:
        df = df.where(F.col("topic") == src.name)
    return df


def read_batch(spark: SparkSession, src: TopicSource) -> DataFrame:
    """The same messages as a bounded (batch) frame: used for schema samples
    and for replays that need no state."""
    if src.fmt == "kafka":
        return _message_frame(_kafka_reader(spark.read, src, False).load(), src)
    folder = _resolve(spark, src)
    df = _message_frame(_file_reader(spark, spark.read, src, folder).load(folder), src)
    if src.name is not None:
        df = df.where(F.col("topic") == src.name)
    return df


def check_source(spark: SparkSession, src: TopicSource, probe: bool = True) -> None:
    """Raise ``LookupError`` when a topic does not exist; with ``probe``
    also when a named topic has no message yet.

    Listing a Kafka topic's partitions fails where the broker does not know
    the topic; any other error (no connector, no broker) passes as it is.  The Kafka
    branch has not been run against a broker: neither one nor the connector is part of the
    test environment, so what its exception says (``UnknownTopicOrPartition``) is taken
    from Kafka's documentation."""
    if src.fmt == "kafka":
        try:
            empty = read_batch(spark, src).limit(1).isEmpty()
        except Exception as exc:
            if "UnknownTopicOrPartition" in str(exc):
                raise LookupError(f"topic {src.name!r} does not exist on {src.bootstrap_servers}") from exc
            raise
        if probe and empty:
            raise LookupError(f"topic {src.name!r} has no messages on {src.bootstrap_servers}")
        return
    try:
        df = read_batch(spark, src)
    except AnalysisException as exc:
        raise LookupError(f"topic source {src.path!r} does not exist") from exc
    if probe and src.name is not None and df.limit(1).count() == 0:
        raise LookupError(f"topic {src.name!r} has no messages under {src.path}")


def to_messages(df: DataFrame, topic_col: str | None = None) -> DataFrame:
    """Encode rows as JSON messages: ``(topic?, value)``.  Timestamps keep
    micro-seconds."""
    payload = [c for c in df.columns]
    value = F.to_json(F.struct(*[F.col(f"`{c}`") for c in payload]), JSON_OPTIONS)
    if topic_col:
        return df.select(F.col(topic_col).cast("string").alias("topic"), value.alias("value"))
    return df.select(value.alias("value"))


def publish(messages: DataFrame, target: TopicSource, mode: str = "append") -> None:
    """Write a ``(topic?, value)`` frame to a topic.

    Kafka: the DataFrame Kafka sink (``topic`` column decides the topic when
    the target has no name).  Files: text files, split into ``topic=``
    folders when the frame has a topic column and the target is multi-topic; with
    ``topic_folders=False`` every file keeps the topic as a column.
    The write is one distributed job; no rows pass through the driver.
    """
    if target.fmt == "kafka":
        out = messages
        if "topic" not in messages.columns:
            out = messages.withColumn("topic", F.lit(target.name))
        (
            out.selectExpr("topic", "CAST(value AS STRING) AS value")
            .write.format("kafka")
            .option("kafka.bootstrap.servers", target.bootstrap_servers)
            .save()
        )
        return
    fmt = "parquet" if target.fmt == "parquet" else "text"
    if target.name is None or not target.topic_folders:
        if "topic" not in messages.columns:
            raise ValueError("multi-topic folder needs a topic column")
    if not target.topic_folders:
        messages.select("topic", "value").write.mode(mode).format(fmt).save(target.path)
    elif target.name is None:
        messages.select("topic", "value").write.mode(mode).partitionBy("topic").format(fmt).save(target.path)
    else:
        messages.select("value").write.mode(mode).format(fmt).save(target.path)
