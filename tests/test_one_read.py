"""Rows and quarantine out of one reading, coordinates of file topics, bounded state."""

import glob
import os

import pytest
from pyspark.sql import functions as F

from tidepool.operators.split import hash_split
from tidepool.sources.topic import TopicSource, publish, read_batch, read_stream
from tidepool.streaming import score
from tidepool.streaming.ingest import ingest, start_quarantine, subscribe

TEXTS = [
    '{"a":1}', '{"a":2}{"a":3}', '{"a":9007199254740993}', '{"a":"x"}', "", "nothing", '[{"a":4},{"a":5}]', '[{"a":6},{"a":[]}]', "[]", "{}",
    '{"a":7,"new":1}', '{"_reason":"mine","_raw":"r","_kind":"k","a":8}', '{"a":1,"a":9}', '{"a":1} rest',
]
SCHEMA = "a double, _reason string, _raw string, _kind string"


def _topic(spark, path, texts, fmt="text"):
    src = TopicSource("t", fmt=fmt, path=str(path), max_per_trigger=1)
    publish(spark.createDataFrame([(t,) for t in texts], "value string").coalesce(1), src)
    return src


def test_rows_and_quarantine_of_one_stream(spark, tmp_path):
    src = _topic(spark, tmp_path / "in", TEXTS)
    _topic(spark, tmp_path / "in", TEXTS[:7])
    schema = spark.createDataFrame([], SCHEMA).schema
    both = subscribe(spark, src, schema=schema, quarantine=True)
    q = ingest(spark, both)
    assert sum(p["numInputRows"] for p in q.recentProgress) == len(TEXTS) + 7  # each message once
    alone = subscribe(spark, src, schema=schema)
    ingest(spark, alone)
    _, path = start_quarantine(spark, alone)
    drop = ["_ingested_at"]
    assert both.history(spark).columns == alone.history(spark).columns
    assert sorted(map(str, both.history(spark).drop(*drop).collect())) == sorted(map(str, alone.history(spark).drop(*drop).collect()))
    got = sorted((r["value"], r["reason"]) for r in both.quarantined(spark).collect())
    assert got == sorted((r["value"], r["reason"]) for r in spark.read.parquet(path).collect())
    assert both.history(spark).where("_reason_msg = 'mine' AND _raw_msg = 'r' AND _kind_msg = 'k' AND a = 8").count() == 1
    with pytest.raises(LookupError):
        alone.quarantined(spark)


def test_a_killed_batch_leaves_neither_output(spark, tmp_path):
    """A batch that dies while it writes shows no row and no quarantined message; run
    again, it gives both once."""
    src = _topic(spark, tmp_path / "in", TEXTS)
    schema = spark.createDataFrame([], SCHEMA).schema
    sub = subscribe(spark, src, schema=schema, quarantine=True)
    ingest(spark, sub)
    n_rows, n_bad = sub.history(spark).count(), sub.quarantined(spark).count()
    _topic(spark, tmp_path / "in", TEXTS)
    # the second batch's files are written and its log entry is not: what a kill leaves
    ingest(spark, sub)
    meta = os.path.join(sub.history_path.removeprefix("file:"), "_spark_metadata")
    ckpt = sub.checkpoint_path.removeprefix("file:")
    for name in (f"{meta}/1", f"{meta}/.1.crc", f"{ckpt}/commits/1", f"{ckpt}/commits/.1.crc"):
        if os.path.exists(name):
            os.replace(name, str(tmp_path / name.replace("/", "_")))
    assert (sub.history(spark).count(), sub.quarantined(spark).count()) == (n_rows, n_bad)
    ingest(spark, sub)
    assert (sub.history(spark).count(), sub.quarantined(spark).count()) == (2 * n_rows, 2 * n_bad)


def test_parquet_topics_have_coordinates(spark, tmp_path):
    texts = [f'{{"id":{i}}}' for i in range(50)]
    src = TopicSource("t", fmt="parquet", path=str(tmp_path / "in"))
    publish(spark.createDataFrame([(t,) for t in texts], "value string").repartition(3), src)
    batch = read_batch(spark, src)
    assert batch.select("partition").distinct().count() == 3
    assert batch.select("partition", "offset").distinct().count() == 50
    assert batch.where("partition IS NULL OR offset IS NULL OR timestamp IS NULL").count() == 0
    sub = subscribe(spark, TopicSource("t", fmt="parquet", path=str(tmp_path / "in"), max_per_trigger=1))
    ingest(spark, sub)
    hist = sub.history(spark)
    here = {(r["partition"], r["offset"]): r["value"] for r in batch.collect()}
    assert {(r["_partition"], r["_offset"]): f'{{"id":{r["id"]}}}' for r in hist.collect()} == here
    # the split goes by the coordinate, and new messages are those behind the newest offsets
    build, rest = hash_split(hist, 0.5)
    assert build.count() + rest.count() == 50
    seen = hist.groupBy("_partition").agg(F.max("_offset").alias("top"))
    publish(spark.createDataFrame([('{"id":99}',)], "value string").coalesce(1), src)
    ingest(spark, sub)
    new = sub.history(spark).join(seen, "_partition", "left").where(F.col("top").isNull() | (F.col("_offset") > F.col("top")))
    assert [r["id"] for r in new.collect()] == [99]
    assert read_stream(spark, src).columns == ["topic", "partition", "offset", "timestamp", "value"]


def test_state_does_not_grow_with_batches(spark, tmp_path):
    rows = spark.range(40).select(F.lit("t").alias("topic"), F.col("id"), F.lit(1.0).alias("v"))
    rows.repartitionByRange(8, "id").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out, state = str(tmp_path / "out"), str(tmp_path / "state")
    score.prefix_stream(spark, stream, out, state, str(tmp_path / "ckpt"), ["id"], sums={"cum": "v"})
    assert sorted(os.path.basename(p) for p in glob.glob(f"{state}/*")) == ["turn=0", "turn=1"]
    got = score.read_sequence(spark, out, state)
    assert sorted(r["seq"] for r in got.collect()) == list(range(1, 41))
    assert all(r["cum"] == r["seq"] and r["seq_newest"] == 41 - r["seq"] for r in got.collect())
    with pytest.raises(LookupError):
        score._state_before(spark, state, 5, "topic", ["cum"])
