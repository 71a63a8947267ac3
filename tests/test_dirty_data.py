"""Data that is not clean: NULL groups and labels, big ids, late fields, numeric topic names."""

from pyspark.sql import functions as F

from tidepool.functions import json as J
from tidepool.operators.metrics import rmse, running_rmse
from tidepool.operators.prefix import ordered_prefix
from tidepool.sources.topic import TopicSource, publish, read_batch, to_messages
from tidepool.streaming.ingest import ingest, subscribe
from tidepool.streaming.score import prefix_stream, read_sequence, score_with_registry


def test_prefix_null_numeric_group_and_big_ids(spark):
    big = 9007199254740993
    df = spark.createDataFrame([(None, i, big + i if i % 2 else None) for i in range(6)] + [(7, 9, big)], "g bigint, o int, id bigint")
    got = sorted(tuple(r) for r in ordered_prefix(df, ["o"], ["g"], sums={"s": "o"}, num_partitions=3).select("o", "seq", "id", "s").collect())
    assert got == [(i, i + 1, big + i if i % 2 else None, float(sum(range(i + 1)))) for i in range(6)] + [(9, 1, big, 9.0)]


def test_running_rmse_skips_rows_without_label(spark):
    df = spark.createDataFrame([(1, 10.0, 0.0), (2, None, 0.0), (3, 10.0, 0.0), (4, None, 0.0)], "o int, label double, prediction double")
    got = [r["running_rmse"] for r in running_rmse(df, ["o"]).orderBy("o").collect()]
    assert got == [10.0] * 4 and rmse(df).first()["rmse"] == 10.0
    first = spark.createDataFrame([(1, None, 0.0)], "o int, label double, prediction double")
    assert running_rmse(first, ["o"]).first()["running_rmse"] is None


def test_schema_of_all_messages(spark):
    rows = spark.range(12_000).select(
        F.when(F.col("id") < 11_500, F.format_string('{"v":%d}', "id")).otherwise(F.format_string('{"v":%d.5,"late":1}', "id")).alias("value")
    )
    schema = J.infer_schema(rows)
    assert schema.simpleString() == "struct<late:bigint,v:double>"


def test_numeric_topic_names_stay_text(spark, tmp_path):
    df = spark.createDataFrame([("007", 1), ("010", 2)], "t string, v int")
    src = TopicSource(None, path=str(tmp_path / "topics"))
    publish(to_messages(df.select("v", "t"), topic_col="t"), src)
    assert sorted(r["topic"] for r in read_batch(spark, src).collect()) == ["007", "010"]
    sub = subscribe(spark, src)
    ingest(spark, sub)
    assert sorted(r["topic"] for r in sub.history(spark).collect()) == ["007", "010"]


def test_batch_honours_options(spark, tmp_path):
    publish(spark.createDataFrame([('{"v":1}',)], "value string"), TopicSource("t", path=str(tmp_path / "x" / "y")))
    src = TopicSource("t", path=str(tmp_path / "x"), options={"recursiveFileLookup": "true"})
    assert read_batch(spark, src).count() == 1


def _stream(spark, tmp_path, batches):
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, "topic string, o int").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        yield i


def test_prefix_stream_null_topic_over_batches(spark, tmp_path):
    args = [str(tmp_path / p) for p in ("out", "state", "ckpt")]
    for i in _stream(spark, tmp_path, [[(None, 5 * i + k) for k in range(5)] for i in range(3)]):
        rows = spark.readStream.schema("topic string, o int").parquet(str(tmp_path / "in"))
        prefix_stream(spark, rows, *args, ["o"])
        assert i >= 0
    got = sorted((r["o"], r["seq"], r["seq_newest"]) for r in read_sequence(spark, args[0], args[1]).collect())
    assert got == [(k, k + 1, 15 - k) for k in range(15)]


class _NoModel:
    def latest_for(self, name):
        return None


def test_rows_before_the_first_model_are_kept(spark, tmp_path):
    list(_stream(spark, tmp_path, [[("a", 1), ("b", 2)]]))
    rows = spark.readStream.schema("topic string, o int").parquet(str(tmp_path / "in"))
    score_with_registry(spark, rows, _NoModel(), "m", str(tmp_path / "out"), str(tmp_path / "ckpt"))
    got = spark.read.parquet(str(tmp_path / "out"))
    assert got.count() == 2 and got.where("prediction IS NULL AND model_version IS NULL").count() == 2


def test_rescued_by_default_at_any_depth(spark, tmp_path):
    late = [
        '{"v":1,"in":{"a":1},"list":[{"b":1}]}',  # fits
        '{"v":"x","in":{"a":1},"list":[{"b":1}]}',  # a leaf of another type
        '{"v":1,"in":{"a":1,"new":2},"list":[{"b":1}]}',  # an unknown nested field
        '{"v":1,"in":{"a":"y"},"list":[{"b":1}]}',  # a nested leaf of another type
        '{"v":1,"in":{"a":1},"list":[{"b":1},{"b":"z"}]}',  # the same in a list
        '{"v":1,"in":7,"list":null}',  # no object
        '[{"v":1},{"v":2,"more":true}]',
    ]
    src = TopicSource("t", path=str(tmp_path / "in"))
    publish(spark.createDataFrame([(x,) for x in late], "value string"), src)
    schema = spark.createDataFrame([], "v bigint, `in` struct<a:bigint>, list array<struct<b:bigint>>").schema
    sub = subscribe(spark, src, schema=schema)
    ingest(spark, sub)
    got = sorted(((r["v"], r["_rescued"]) for r in sub.history(spark).collect()), key=str)
    want = [
        (1, None), (None, '{"v":"x"}'), (1, '{"in":"{\\"a\\":1,\\"new\\":2}"}'), (1, '{"in":"{\\"a\\":\\"y\\"}"}'),
        (1, '{"list":"[{\\"b\\":1},{\\"b\\":\\"z\\"}]"}'), (1, '{"in":"7"}'), (1, None), (2, '{"more":"true"}'),
    ]
    assert got == sorted(want, key=str)
