"""JSON edge vector: rows per message, flattening, quarantine."""

import pytest
from pyspark.sql import types as T

from tidepool.functions import json as J

SCHEMA = T.StructType(
    [
        T.StructField("a", T.LongType()),
        T.StructField("b", T.StructType([T.StructField("d", T.LongType())])),
        T.StructField("c", T.LongType()),
    ]
)

# message -> (rows, status)
CASES = [
    # b.d holds an object where the schema pins bigint: leaf NULL, raw kept
    ('{"a":1,"b":{"c":2,"d":{"e":"x"}},"l":[1,2]}', 1, "wrong_type"),
    ('{"a":1,"b":{"c":2,"d":4},"l":[1,2]}', 1, "ok"),
    ('[{"a":2},{"a":3}]', 2, "ok"),
    ("[]", 0, "ok"),
    ("{}", 1, "ok"),
    ("5", 0, "unreadable"),
    ('"s"', 0, "unreadable"),
    (None, 0, "empty"),
    ("", 0, "empty"),
    ("  ", 0, "empty"),
    ("not json", 0, "unreadable"),
    ("[1,2]", 0, "unreadable"),
    ('[{"a":1},{"a":', 0, "unreadable"),
    ('{"a":"str","c":1}', 1, "wrong_type"),
    ('{"a":1.5}', 1, "wrong_type"),
    ('{"a":1,"a":2}', 1, "ok"),
    ('{"z":1}', 1, "ok"),
]


@pytest.mark.parametrize("msg,rows,status", CASES)
def test_edge_vector(spark, msg, rows, status):
    df = spark.createDataFrame([(msg,)], "value string")
    assert J.decode(df, SCHEMA).count() == rows
    assert df.select(J.classify(df, SCHEMA).alias("s")).first()["s"] == status


def test_wrong_type_leaf_is_null_and_others_kept(spark):
    df = spark.createDataFrame([('{"a":"str","c":1}',)], "value string")
    row = J.decode(df, SCHEMA).first()
    assert row["a"] is None and row["c"] == 1


def test_duplicate_key_last_wins(spark):
    df = spark.createDataFrame([('{"a":1,"a":2}',)], "value string")
    assert J.decode(df, SCHEMA).first()["a"] == 2


def test_flatten_names_and_depth(spark):
    df = spark.createDataFrame([('{"a":1,"b":{"d":7},"c":3}',)], "value string")
    flat = J.flatten(J.decode(df, SCHEMA), sep=".")
    assert flat.columns == ["a", "b.d", "c"]
    assert flat.first()["b.d"] == 7
    assert J.flatten(J.decode(df, SCHEMA)).columns == ["a", "b_d", "c"]


def test_flatten_collision_raises(spark):
    schema = T.StructType(
        [T.StructField("a_b", T.LongType()), T.StructField("a", T.StructType([T.StructField("b", T.LongType())]))]
    )
    df = spark.createDataFrame([('{"a_b":1,"a":{"b":2}}',)], "value string")
    with pytest.raises(ValueError):
        J.flatten(J.decode(df, schema))


def test_quarantine_split(spark):
    msgs = [('{"a":1}',), ("oops",), (None,), ('{"a":"x"}',)]
    df = spark.createDataFrame(msgs, "value string")
    good, bad = J.split_quarantine(df, SCHEMA)
    assert good.count() == 2
    assert sorted(r["reason"] for r in bad.collect()) == ["unreadable", "wrong_type"]


def test_infer_schema_merges_sample(spark):
    df = spark.createDataFrame([('{"a":1}',), ('[{"b":"x"}]',), ("bad",)], "value string")
    s = J.infer_schema(df)
    assert {f.name: f.dataType.simpleString() for f in s.fields} == {"a": "bigint", "b": "string"}


def test_hints_override(spark):
    df = spark.createDataFrame([('{"ts":"2024-01-01T00:00:00.123456"}',)], "value string")
    s = J.infer_schema(df, hints={"ts": "timestamp_ntz"})
    row = J.decode(df, s).first()
    assert str(row["ts"]) == "2024-01-01 00:00:00.123456"


def test_rescued_keeps_unknown_fields(spark):
    msgs = [('{"a":1,"z":5,"y":{"q":1}}',), ('[{"a":2},{"a":3,"w":"x"}]',), ('{"a":4}',), ("bad",)]
    df = spark.createDataFrame(msgs, "value string")
    rows = sorted(J.decode(df, SCHEMA, rescued_col="_rescued").select("a", "_rescued").collect())
    assert [r["a"] for r in rows] == [1, 2, 3, 4]
    import json as pyjson

    assert pyjson.loads(rows[0]["_rescued"]) == {"z": "5", "y": '{"q":1}'}
    assert rows[1]["_rescued"] is None
    assert pyjson.loads(rows[2]["_rescued"]) == {"w": "x"}
    assert rows[3]["_rescued"] is None


def test_payload_field_named_like_metadata(spark):
    df = spark.createDataFrame([("t1", '{"topic":"inner","a":1}')], "topic string, value string")
    schema = J.infer_schema(df)
    row = J.decode(df, schema, keep=["topic"]).first()
    assert row["topic"] == "t1" and row["topic_msg"] == "inner" and row["a"] == 1
