"""Registry of named queries (each with an optional DuckDB oracle) and the
inputs they share: the given tables, and topics staged from them."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path
from ..sources.topic import TopicSource, publish, to_messages


@dataclass(frozen=True)
class Query:
    name: str
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None
    covers: str


REGISTRY: dict[str, Query] = {}


def query(name: str, covers: str, sql: str | None = None):
    """Register ``fn(spark, sf_dir) -> DataFrame`` under ``name``; ``sql`` is
    the equivalent DuckDB query over the same tables (None = no SQL
    equivalent)."""

    def wrap(fn):
        if name in REGISTRY:
            raise ValueError(f"query {name!r} registered twice")
        REGISTRY[name] = Query(name, fn, sql, covers)
        return fn

    return wrap


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def r6(c: Column | str) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


def stage_topic(
    spark: SparkSession,
    rows: DataFrame,
    topic_col: str | None = None,
    name: str | None = None,
    files: int | None = None,
    order_col: str | None = None,
    topic_folders: bool = True,
) -> TopicSource:
    """Publish rows as JSON messages into a fresh file topic and return its
    source.  With ``topic_col`` each value becomes its own topic folder, or with
    ``topic_folders=False`` its own topic in files that hold many.
    ``files``/``order_col`` spread the messages over range-cut files so a
    throttled replay runs several micro-batches."""
    path = scratch_path(spark, "topic-files")
    msgs = rows
    if files:
        msgs = msgs.repartitionByRange(files, order_col) if order_col else msgs.repartition(files)
    msgs = to_messages(msgs, topic_col=topic_col)
    if topic_col:
        target = TopicSource(None, fmt="text" if topic_folders else "parquet", path=path, topic_folders=topic_folders)
    else:
        target = TopicSource(name or "topic", path=path)
    publish(msgs, target)
    return target
