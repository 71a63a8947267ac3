"""Subscription guards, topic sources, ingest restart."""

import pytest
from pyspark.sql import functions as F

from tidepool.sources.topic import TopicSource, publish, read_stream, to_messages
from tidepool.session import scratch_path
from tidepool.streaming.ingest import ingest, subscribe
from tidepool.workspace import Workspace

EV = "/root/testdata/sf0.001/events.parquet"


def test_empty_name_or_server():
    with pytest.raises(ValueError):
        TopicSource("", fmt="kafka", bootstrap_servers="host:9092")
    with pytest.raises(ValueError):
        TopicSource("t", fmt="kafka", bootstrap_servers=" ")
    with pytest.raises(ValueError):
        TopicSource("t", fmt="text")


def test_missing_topic(spark):
    src = TopicSource("t", path=scratch_path(spark, "nothing-here"))
    with pytest.raises(LookupError):
        subscribe(spark, src)


def test_duplicate_subscription(spark):
    ev = spark.read.parquet(EV)
    path = scratch_path(spark, "dup")
    publish(to_messages(ev, "event_type"), TopicSource(None, path=path))
    ws = Workspace(spark)
    ws.subscribe(TopicSource("click", path=path))
    with pytest.raises(ValueError):
        ws.subscribe(TopicSource("click", path=path))
    ws.subscribe(TopicSource("view", path=path))
    assert sorted(ws.subscriptions) == ["click", "view"]


def test_missing_named_topic_in_folder(spark):
    ev = spark.read.parquet(EV)
    path = scratch_path(spark, "named")
    publish(to_messages(ev, "event_type"), TopicSource(None, path=path))
    with pytest.raises(LookupError):
        subscribe(spark, TopicSource("no_such_topic", path=path))


def test_kafka_source_needs_connector(spark):
    src = TopicSource("t", fmt="kafka", bootstrap_servers="localhost:1")
    try:
        read_stream(spark, src)
    except Exception as exc:  # the connector jar is not installed here
        assert "kafka" in str(exc).lower()


def test_missing_kafka_topic(spark, monkeypatch):
    from tidepool.sources import topic

    src = TopicSource("t", fmt="kafka", bootstrap_servers="localhost:1")
    found = {"frame": spark.createDataFrame([("x",)], "value string")}
    monkeypatch.setattr(topic, "read_batch", lambda *_: found["frame"])
    topic.check_source(spark, src)
    found["frame"] = found["frame"].where("false")
    with pytest.raises(LookupError, match="no messages"):
        topic.check_source(spark, src)
    topic.check_source(spark, src, probe=False)

    def fails(text):
        def read(*_):
            raise RuntimeError(text)

        return read

    monkeypatch.setattr(topic, "read_batch", fails("org.apache.kafka.common.errors.UnknownTopicOrPartitionException"))
    with pytest.raises(LookupError, match="does not exist"):
        topic.check_source(spark, src, probe=False)
    monkeypatch.setattr(topic, "read_batch", fails("Timed out waiting for a node assignment"))
    with pytest.raises(RuntimeError, match="Timed out"):
        topic.check_source(spark, src)


def test_restart_resumes_without_duplicates(spark):
    ev = spark.read.parquet(EV)
    path = scratch_path(spark, "restart")
    target = TopicSource("events", path=path)
    first = ev.where(F.col("event_id") < 500)
    publish(to_messages(first), target)
    sub = subscribe(spark, TopicSource("events", path=path, max_per_trigger=1), hints={"ts": "timestamp_ntz"})
    ingest(spark, sub)
    assert sub.history(spark).count() == first.count()
    publish(to_messages(ev.where(F.col("event_id") >= 500)), target, mode="append")
    ingest(spark, sub)  # same checkpoint: only the new file is read
    hist = sub.history(spark)
    assert hist.count() == ev.count()
    assert hist.select("event_id").distinct().count() == ev.count()


def test_continuous_ingest_one_second_cadence(spark):
    ev = spark.read.parquet(EV)
    path = scratch_path(spark, "cadence")
    target = TopicSource("events", path=path)
    publish(to_messages(ev.repartition(2)), target)
    sub = subscribe(spark, TopicSource("events", path=path, max_per_trigger=1), hints={"ts": "timestamp_ntz"})
    q = ingest(spark, sub, trigger="1 second")
    try:
        q.processAllAvailable()
        publish(to_messages(ev.limit(10)), target, mode="append")  # a message arriving later
        q.processAllAvailable()
    finally:
        q.stop()
    assert sub.history(spark).count() == ev.count() + 10


def test_live_counts_resume_from_checkpoint_state(spark):
    from tidepool.streaming.ingest import live_counts, live_latest, read_counts, read_live

    ev = spark.read.parquet(EV)
    path = scratch_path(spark, "live-restart")
    target = TopicSource(None, path=path)
    publish(to_messages(ev.where(F.col("event_id") < 400), "event_type"), target)
    sub = subscribe(spark, TopicSource(None, path=path, max_per_trigger=2), hints={"ts": "timestamp_ntz"})
    live_counts(spark, sub)
    live_latest(spark, sub, ["ts", "event_id"])
    publish(to_messages(ev.where(F.col("event_id") >= 400), "event_type"), target, mode="append")
    _, counts = live_counts(spark, sub)  # restarted: state carries the first run's counts
    _, latest = live_latest(spark, sub, ["ts", "event_id"])
    want = {r["event_type"]: r["count"] for r in ev.groupBy("event_type").count().collect()}
    assert {r["topic"]: r["n_messages"] for r in read_counts(spark, counts).collect()} == want
    newest = ev.groupBy("event_type").agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("e"))
    assert {r["topic"]: r["event_id"] for r in read_live(spark, latest).collect()} == {
        r["event_type"]: r["e"] for r in newest.collect()
    }


def test_parquet_topic(spark):
    ev = spark.read.parquet(EV)
    path = scratch_path(spark, "pq-topic")
    publish(to_messages(ev, "event_type"), TopicSource(None, fmt="parquet", path=path))
    sub = subscribe(spark, TopicSource("click", fmt="parquet", path=path, max_per_trigger=1), hints={"ts": "timestamp_ntz"})
    ingest(spark, sub)
    hist = sub.history(spark)
    assert hist.count() == ev.where(F.col("event_type") == "click").count()
    assert hist.select("topic").distinct().first()[0] == "click"


def test_rows_new_since_last_ingest(spark):
    from tidepool.operators.setops import new_rows_since

    ev = spark.read.parquet(EV)
    path = scratch_path(spark, "arrivals")
    target = TopicSource("events", path=path)
    publish(to_messages(ev.where(F.col("event_id") < 600)), target)
    sub = subscribe(spark, TopicSource("events", path=path), hints={"ts": "timestamp_ntz"})
    ingest(spark, sub)
    built_until = sub.history(spark).agg(F.max("_ingested_at")).first()[0]
    publish(to_messages(ev.where(F.col("event_id") >= 600)), target, mode="append")
    ingest(spark, sub)
    fresh = new_rows_since(sub.history(spark), "_ingested_at", built_until)
    assert sorted(r[0] for r in fresh.select("event_id").collect()) == list(range(600, ev.count()))


def test_compact_history_into_clustered_table(spark):
    import uuid

    from tidepool.operators.relational import TableStore
    from tidepool.streaming.ingest import compact_history

    ev = spark.read.parquet(EV)
    path = scratch_path(spark, "compact")
    target = TopicSource(None, path=path)
    sub = None
    for lo, hi in [(0, 300), (300, 700), (700, 1001)]:  # three arrivals, many small files
        publish(to_messages(ev.where((F.col("event_id") >= lo) & (F.col("event_id") < hi)).repartition(4), "event_type"), target, mode="append")
        sub = sub or subscribe(spark, TopicSource(None, path=path), hints={"ts": "timestamp_ntz"})
        ingest(spark, sub)
    store = TableStore(spark, scratch_path(spark, "compact-tables"))
    name = f"hist_{uuid.uuid4().hex[:8]}"
    table = compact_history(spark, sub, store, name, ["ts", "event_id"])
    assert table.count() == ev.count()
    assert len(table.inputFiles()) < len(sub.history(spark).inputFiles())
    cut = table.where(F.col("ts") >= F.to_timestamp_ntz(F.lit("2024-01-01 12:00:00")))
    assert cut.count() == ev.where(F.col("ts") >= F.to_timestamp_ntz(F.lit("2024-01-01 12:00:00"))).count()
    # a run without new rows writes nothing, a later one appends the new rows only
    before = set(table.inputFiles())
    assert set(compact_history(spark, sub, store, name, ["ts", "event_id"]).inputFiles()) == before
    publish(to_messages(ev.where(F.col("event_id") < 50), "event_type"), target, mode="append")
    ingest(spark, sub)
    grown = compact_history(spark, sub, store, name, ["ts", "event_id"])
    assert before < set(grown.inputFiles())
    assert grown.groupBy("event_id").count().where("event_id < 50").agg(F.min("count"), F.max("count")).first() == (2, 2)
    assert grown.count() == sub.history(spark).count() == ev.count() + 50


def test_many_topics_share_files(spark):
    """Names stay text in both layouts; files grow with the topics only where each has a folder."""
    from tidepool.plans.common import stage_topic

    rows = spark.range(600).select("id", F.lpad((F.col("id") % 200).cast("string"), 5, "0").alias("name")).repartition(3)
    want = sorted((f"{i:05d}", 3) for i in range(200))
    src = stage_topic(spark, rows, topic_col="name", topic_folders=False)
    assert len(spark.read.parquet(src.path).inputFiles()) <= 3
    for quarantine in (False, True):
        sub = subscribe(spark, src, quarantine=quarantine)
        ingest(spark, sub)
        history = sub.history(spark)
        assert history.schema["topic"].dataType.simpleString() == "string"
        assert sorted(map(tuple, history.groupBy("topic").count().collect())) == want
        assert len(history.inputFiles()) <= 3
    one = TopicSource("00007", fmt="parquet", path=src.path, topic_folders=False)
    sub = subscribe(spark, one)
    ingest(spark, sub)
    assert sorted(r["id"] for r in sub.history(spark).collect()) == [7, 207, 407]
    folders = subscribe(spark, stage_topic(spark, rows.where("id % 200 < 4"), topic_col="name"))
    ingest(spark, folders)
    assert sorted(map(tuple, folders.history(spark).groupBy("topic").count().collect())) == want[:4]
    with pytest.raises(ValueError):
        TopicSource(None, path=src.path, topic_folders=False)
