"""Model registry: an append-only log of model versions.

Each entry is one immutable row in its model's own log folder, so readers never
see a half-written table and looking one model up reads that model's entries
only.  A model is (topic, kind, label, algorithm); ``name`` is its display text.
Versions come from one allocator (``allocate``), whoever builds, in whichever driver:
a version is taken by creating its claim file, which the file system allows once, so two
drivers never get one number.  A retried build gets its version again, and model
files go to a folder of their own per attempt, so a version's files never change.
What a version computes is also kept as a record (see ``model_data``), in a table per model.  ``status`` is ``built``,
``removed`` (a tombstone) or ``skipped`` (rows arrived that could not build
the model, with the reason; the standing model stays in force).
"""

from __future__ import annotations

import datetime as dt
import hashlib
import os
import uuid
from urllib.parse import unquote, urlparse

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from .models import ModelSpec

LOG_SCHEMA = (
    "name string, topic string, kind string, algorithm string, label string, rebuild_mode string, "
    "version bigint, built_at timestamp, n_build bigint, n_unlabelled bigint, metric_name string, metric_value double, "
    "cells array<struct<actual:string,predicted:string,n:bigint>>, "
    "model_path string, removed boolean, status string, reason string, job string, batch_id bigint"
)
RECORD_SCHEMA = "version bigint, record string"
IDENTITY = ["topic", "kind", "label", "algorithm"]


def latest_versions(log: DataFrame) -> DataFrame:
    """Newest entry per model (skipped builds aside), without models whose newest
    entry is a removal.  Equal versions: the later, then the greater path."""
    cols = [c for c in log.columns if c not in IDENTITY]
    order = F.struct("version", "removed", "built_at", "model_path")
    newest = log.where(F.col("status") != "skipped").groupBy(*IDENTITY).agg(F.max_by(F.struct(*cols), order).alias("_e"))
    flat = newest.select(*[F.col(c) if c in IDENTITY else F.col("_e").getField(c).alias(c) for c in log.columns])
    return flat.where(~F.col("removed")).drop("removed")


def _key(identity: tuple[str, ...]) -> str:
    return hashlib.md5("\x1f".join(identity).encode()).hexdigest()


def claim(spark: SparkSession, path: str, owner: str) -> bool:
    """Create ``path`` holding ``owner`` unless it exists; whether it is ``owner``'s now.

    Creation without overwriting is atomic in HDFS and in object stores with
    conditional writes (for S3A from Hadoop 3.4.2 on, others behind their connectors'
    documentation); local and mounted folders are opened exclusively, because
    Hadoop's local file system looks first and creates then."""
    local = urlparse(path).scheme in ("", "file")
    if local:
        name = unquote(urlparse(path).path) if path.startswith("file:") else path
        os.makedirs(os.path.dirname(name), exist_ok=True)
        try:
            with open(name, "x", encoding="utf-8") as f:
                f.write(owner)
            return True
        except FileExistsError:
            with open(name, encoding="utf-8") as f:
                return f.read() == owner
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    try:
        out = fs.create(target, False)
        out.write(bytearray(owner.encode()))
        out.close()
        return True
    except Py4JJavaError as exc:
        if not fs.exists(target):
            raise exc
        return spark.read.option("wholetext", True).text(path).first()["value"] == owner


class ModelRegistry:
    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root.rstrip("/")

    @property
    def log_path(self) -> str:
        return f"{self.root}/log"

    def new_model_path(self, spec: ModelSpec, version: int) -> str:
        """A folder nobody has used or will use again."""
        return f"{self.root}/models/{_key(spec.identity)}/v{version}-{uuid.uuid4().hex[:8]}"

    def allocate(self, spec: ModelSpec, job: str = "build", batch_id: int | None = None) -> int:
        """The version of a build: the next free one, or, for a batch of a
        job that has its entry (or its claim) already, that one's."""
        own = self.entries(spec)
        top = mine = None
        if own is not None:
            again = F.when((F.col("job") == job) & (F.col("batch_id") == batch_id), F.col("version"))
            top, mine = own.agg(F.max("version"), F.max(again)).first()
        if mine is not None:
            return int(mine)
        owner = uuid.uuid4().hex if batch_id is None else f"{job} {batch_id}"
        version = 0 if top is None else int(top) + 1
        while not claim(self.spark, f"{self.root}/claims/{_key(spec.identity)}/v{version}", owner):
            version += 1  # another driver's, or a build that never finished
        return version

    def put_record(self, spec: ModelSpec, version: int, record: str) -> None:
        """Keep what a version computes, as data."""
        row = self.spark.createDataFrame([(int(version), record)], RECORD_SCHEMA).coalesce(1)
        row.write.mode("append").parquet(f"{self.root}/records/model={_key(spec.identity)}")

    def records(self, spec: ModelSpec) -> DataFrame:
        """``version, record`` of a model's versions (of a retried build: one)."""
        found = self._read(f"{self.root}/records/model={_key(spec.identity)}", RECORD_SCHEMA)
        return self.spark.createDataFrame([], RECORD_SCHEMA) if found is None else found.dropDuplicates(["version"])

    def recorded(self, spec: ModelSpec, job: str, batch_id: int) -> bool:
        """Whether a batch of a job has its entry (a retry has nothing to do)."""
        own = self.entries(spec)
        return own is not None and bool(own.where((F.col("job") == job) & (F.col("batch_id") == batch_id)).take(1))

    def record(
        self,
        spec: ModelSpec,
        version: int,
        n_build: int,
        metric_name: str | None,
        metric_value: float | None,
        model_path: str | None,
        built_at: dt.datetime | None = None,
        status: str = "built",
        reason: str | None = None,
        n_unlabelled: int = 0,
        cells: list | None = None,
        job: str = "build",
        batch_id: int | None = None,
    ) -> None:
        built_at = built_at or dt.datetime.now(dt.timezone.utc).replace(tzinfo=None)
        value = None if metric_value is None else float(metric_value)
        row = (
            spec.name, spec.topic, spec.kind, spec.algorithm, spec.label, spec.rebuild_mode, int(version), built_at,
            int(n_build), int(n_unlabelled), metric_name, value, cells, model_path, status == "removed", status, reason, job, batch_id,
        )
        entry = self.spark.createDataFrame([row], LOG_SCHEMA).coalesce(1)
        entry.write.mode("append").parquet(self._folder(spec.identity))

    def _folder(self, identity: tuple[str, ...]) -> str:
        return f"{self.log_path}/model={_key(identity)}"

    def _read(self, path: str, schema: str = LOG_SCHEMA) -> DataFrame | None:
        try:
            return self.spark.read.schema(schema).parquet(path)
        except AnalysisException as exc:
            if exc.getCondition() == "PATH_NOT_FOUND":
                return None
            raise

    def log(self) -> DataFrame:
        """All entries (none before the first build)."""
        found = self._read(self.log_path, LOG_SCHEMA + ", model string")
        return self.spark.createDataFrame([], LOG_SCHEMA) if found is None else found.drop("model")

    def entries(self, spec: ModelSpec) -> DataFrame | None:
        """One model's entries, or None."""
        return self._read(self._folder(spec.identity))

    def latest_for(self, model: ModelSpec | str) -> Row | None:
        """Newest live entry of one model, or None.  A definition reads its own
        entries; a display name reads the log and must mean one model."""
        if isinstance(model, ModelSpec):
            own = self.entries(model)
            return None if own is None else latest_versions(own).first()
        rows = self.latest().where(F.col("name") == model).take(2)
        if len(rows) > 1:
            raise ValueError(f"several models are called {model!r}; look it up by its definition")
        return rows[0] if rows else None

    def latest(self) -> DataFrame:
        return latest_versions(self.log())

    def remove_topic(self, topic: str) -> None:
        """Remove every model of a topic: one tombstone each, above its newest version."""
        changed = {
            "version": F.col("version") + 1, "built_at": F.current_timestamp(), "n_build": F.lit(0), "n_unlabelled": F.lit(0),
            "removed": F.lit(True), "status": F.lit("removed"), "job": F.lit("remove"),
        }
        cleared = ("metric_name", "metric_value", "cells", "model_path", "reason", "batch_id")
        live = self.latest().where(F.col("topic") == topic).withColumn("removed", F.lit(False))
        schema = self.log().schema
        tombs = live.select(
            F.md5(F.concat_ws("\x1f", *IDENTITY)).alias("model"),
            *[
                (F.lit(None) if f.name in cleared else changed.get(f.name, F.col(f.name))).cast(f.dataType).alias(f.name)
                for f in schema.fields
            ],
        )
        tombs.coalesce(1).write.mode("append").partitionBy("model").parquet(self.log_path)
