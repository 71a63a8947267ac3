"""Session helpers and the shared scratch folder.

Every intermediate this library writes (staged topic fixtures, stream
checkpoints, history tables, model files, registry) lives under one root:
the folder the cluster names in ``spark.checkpoint.dir``.  We read it from
the session and only invent one (a fresh ``mkdtemp``) when it is unset, which
is the local-test situation.  Every run gets its own uuid sub-folder, so no
caller ever needs to delete or overwrite somebody else's files.
"""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"


def local_session(
    cpus: int | str = 8, shuffle_partitions: int = 8, app: str = "tidepool", extra: dict | None = None
) -> SparkSession:
    """Session for tests and the local bench (local[N], UI off, AQE on);
    ``extra`` adds configuration (e.g. an event log for stage timings)."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.default.parallelism", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.parquet.outputTimestampType", "TIMESTAMP_MICROS")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.sql.streaming.noDataMicroBatches.enabled", "false")
    )
    for k, v in (extra or {}).items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    checkpoint_root(spark)
    return spark


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder for lineage cuts and intermediates.

    Reads ``spark.checkpoint.dir`` (or the context's checkpoint dir); sets a
    fresh local one only when neither is set and the session is local (tests).
    On a cluster a machine's own folder would be unseen by the others: raises.
    """
    sc = spark.sparkContext
    root = spark.conf.get(CHECKPOINT_CONF, None) or sc.getConf().get(CHECKPOINT_CONF, None)
    if not root:
        root = sc.getCheckpointDir()
    if not root and not re.match(r"local(\[|$)", sc.master):
        raise ValueError(f"set {CHECKPOINT_CONF} to a folder that driver and executors share")
    if not root:
        root = tempfile.mkdtemp(prefix="tidepool-ckpt-")
        sc.setCheckpointDir(root)
    elif sc.getCheckpointDir() is None:
        sc.setCheckpointDir(root)
    return root.rstrip("/")


def scratch_path(spark: SparkSession, kind: str) -> str:
    """A new, unique folder name under the shared root (not created yet)."""
    return f"{checkpoint_root(spark)}/tidepool/{kind}-{uuid.uuid4().hex[:12]}"
