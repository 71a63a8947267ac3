"""Strict, lossless decoding and the mergeable schema, against Python's JSON parser."""

import json as pyjson
import random

import pytest
from pyspark.sql import types as T

from tidepool.functions import json as J
from tidepool.functions import schema as S
from tidepool.sources.topic import TopicSource, publish
from tidepool.streaming.ingest import ingest, start_quarantine, subscribe


def _messages(spark, texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, value string")


def _decoded(spark, texts, schema):
    if isinstance(schema, str):
        schema = spark.createDataFrame([], schema).schema
    msgs = _messages(spark, texts)
    rows = sorted(J.decode(msgs, schema, keep=["i"], position_col="_pos", rescued_col="_rescued").collect(), key=lambda r: (r["i"], r["_pos"]))
    status = {r["i"]: r["s"] for r in msgs.select("i", J.classify(msgs, schema).alias("s")).collect()}
    return rows, [status[i] for i in range(len(texts))]


def test_second_object_and_trailing_text_are_unreadable(spark):
    texts = ['{"a":2}{"a":3}', '{"a":1} trailing', '{"a":1}]', '{"a":1}}', '{"a":1},{"a":2}', '[{"a":1}],[]', '[{"a":1}]]', "{'a':1}", '{"a":1}', ' [{"a":1}]\n']
    rows, status = _decoded(spark, texts, "a bigint")
    assert [(r["i"], r["a"]) for r in rows] == [(8, 1), (9, 1)]
    assert status == ["unreadable"] * 8 + ["ok"] * 2


def test_numbers_beyond_their_column_are_kept(spark):
    texts = ['{"a":9007199254740993}', '{"a":1.5}', '{"a":0.1}', '{"a":100}', '{"a":1.2345678901234567890123}', '{"a":1e400}',
             '{"a":123456789012345678901234567890123456789012345}', '{"b":9007199254740993}', '{"s":1.2345678901234567890123}', '[{"a":1},{"a":9007199254740993}]']
    rows, status = _decoded(spark, texts, "a double, b bigint, s string")
    rest = [None if r["_rescued"] is None else pyjson.loads(r["_rescued"]) for r in rows]
    assert rest[:4] == [{"a": "9007199254740993"}, None, None, None]
    assert rest[4] == {"a": "1.2345678901234567890123"}
    assert rest[5] == {"_message": texts[5]} and rest[6] == {"_message": texts[6]}
    assert rest[7] is None and rows[7]["b"] == 9007199254740993
    assert rest[8] == {"s": "1.2345678901234567890123"}
    assert rest[9:] == [None, {"a": "9007199254740993"}]
    assert status == ["inexact", "ok", "ok", "ok", "inexact", "inexact", "inexact", "ok", "inexact", "inexact"]


def test_decimal_columns(spark):
    rows, status = _decoded(spark, ['{"d":1.23}', '{"d":1.234}', '{"d":12345}'], "d decimal(5,2)")
    assert status == ["ok", "inexact", "wrong_type"]


def test_repeated_keys_give_the_last_value_and_block_nothing(spark, tmp_path):
    texts = ['{"a":1,"a":2}', '{"a":3}', '{"o":{"x":1,"x":"t"}}', '{"A":4}', '{"":5}', '{"x.y":6,"e`f":7}', '{"b":NaN}']
    src = TopicSource("t", path=str(tmp_path / "in"))
    publish(spark.createDataFrame([(t,) for t in texts], "value string"), src)
    sub = subscribe(spark, src)
    ingest(spark, sub)
    # Spark's names have no case: "A" comes first in byte order, "a" is kept aside.
    rows = sub.history(spark).collect()
    assert len(rows) == len(texts)
    held = sorted(str(r["A"]) for r in rows if r["A"] is not None)
    rescued = sorted(r["_rescued"] for r in rows if r["_rescued"])
    assert held == ["4"]
    assert any(pyjson.loads(r).get("_message") == texts[0] for r in rescued) and '{"a":"3"}' in rescued and '{"":"5"}' in rescued
    assert [r["x.y"] for r in rows if r["x.y"] is not None] == [6] and [r["e`f"] for r in rows if r["e`f"] is not None] == [7]
    low = S.pinned(S.observed_schema(_messages(spark, texts[:1])))
    assert low == T.StructType([T.StructField("a", T.LongType())])
    assert J.decode(_messages(spark, texts[:1]), low).first()["a"] == 2


@pytest.mark.parametrize("name", ["_ingested_at", "_rescued", "topic_msg", "topic", "Topic", "_pos", "_offset"])
def test_reserved_names_of_payload_fields(spark, tmp_path, name):
    src = TopicSource("t", path=str(tmp_path / "in"))
    publish(spark.createDataFrame([(f'{{"{name}":7,"topic":"mine","v":1}}',), ('{"v":2,"more":[1]}',)], "value string"), src)
    schema = S.pinned(S.observed_schema(_messages(spark, [f'{{"{name}":7,"topic":"mine","v":1}}'])))
    sub = subscribe(spark, src, schema=schema)
    ingest(spark, sub)
    rows = sorted(sub.history(spark).collect(), key=lambda r: r["v"])
    assert [r["v"] for r in rows] == [1, 2] and {r["topic"] for r in rows} == {"t"}
    assert rows[0]["_ingested_at"] is not None and rows[1]["_rescued"] == '{"more":"[1]"}'
    payload = [c for c in rows[0].asDict() if c.lower().startswith(name.lower()) or c.startswith("topic_msg")]
    assert 7 in [rows[0][c] for c in payload] or name.lower() == "topic"
    assert "mine" in [rows[0][c] for c in rows[0].asDict()] or name == "Topic"


def test_quarantine_stream_keeps_the_whole_text(spark, tmp_path):
    texts = ['{"a":1}', '{"a":2}{"a":3}', '{"a":9007199254740993}', '{"a":"x"}', "", "nothing"]
    src = TopicSource("t", path=str(tmp_path / "in"))
    publish(spark.createDataFrame([(t,) for t in texts], "value string"), src)
    sub = subscribe(spark, src, schema=spark.createDataFrame([], "a double").schema)
    _, path = start_quarantine(spark, sub)
    got = {r["value"]: r["reason"] for r in spark.read.parquet(path).collect()}
    assert got == {texts[1]: "unreadable", texts[2]: "inexact", texts[3]: "wrong_type", texts[5]: "unreadable"}


def _random_value(rng, depth=0):
    kind = rng.randrange(9 if depth < 2 else 7)
    if kind == 7:
        return [_random_value(rng, depth + 1) for _ in range(rng.randrange(3))]
    if kind == 8:
        return {rng.choice("abc"): _random_value(rng, depth + 1) for _ in range(rng.randrange(3))}
    return [None, True, rng.randrange(-5, 5), 2**53 + rng.randrange(9), rng.choice([0.5, 1.25, 1e300]), rng.choice(["", "x", "é\n", "12", "]{"]), 10**rng.randrange(18, 30)][kind]


def _random_texts(rng, n):
    out = []
    for _ in range(n):
        row = lambda: {k: _random_value(rng) for k in rng.sample("abcd", rng.randrange(4))}
        value = rng.choice([row(), row(), [row() for _ in range(rng.randrange(3))], _random_value(rng)])
        text = pyjson.dumps(value, ensure_ascii=rng.random() < 0.5)
        if rng.random() < 0.3:
            at = rng.randrange(len(text) + 1)
            text = rng.choice([text[:at], text[at:], text + text, text + ",", text + "]", text + " x", text[:at] + rng.choice('{}[],:"1') + text[at:]])
        out.append(text)
    return out


@pytest.mark.parametrize("seed", range(2))
def test_rows_are_those_of_a_strict_parser(spark, seed):
    """Same rows as Python's parser for random, often damaged messages; nothing is lost."""
    texts = _random_texts(random.Random(seed), 400)
    schema = S.pinned(S.observed_schema(_messages(spark, texts)))
    rows, status = _decoded(spark, texts, schema)
    by_message = {}
    for r in rows:
        by_message.setdefault(r["i"], []).append(r)
    for i, text in enumerate(texts):
        try:
            value = pyjson.loads(text)
        except ValueError:
            value = None
        objects = value if isinstance(value, list) else [value]
        if not text.strip():
            assert status[i] == "empty"
        elif not all(isinstance(o, dict) for o in objects):
            assert status[i] == "unreadable" and i not in by_message, text
        else:
            own = by_message.get(i, [])
            assert len(own) == len(objects) and status[i] != "unreadable", text
            for o, r in zip(objects, own, strict=True):
                aside = pyjson.loads(r["_rescued"] or "{}")
                for k, v in o.items():
                    if v is not None and "_message" not in aside and k not in aside:
                        held = r[k]
                        assert held is not None, (text, k)
                        if isinstance(v, (int, float)) and not isinstance(v, bool) and not isinstance(held, str):
                            assert held == v, (text, k)


@pytest.mark.parametrize("seed", range(2))
def test_schema_of_batches_merges_to_the_schema_of_all(spark, seed):
    rng = random.Random(seed + 50)
    texts = _random_texts(rng, 120) + ['{"a":1,"a":"x"}', '{"n":NaN}', '{"big":123456789012345678901234567890}', '{"Ä b":{"":[{"c.d":1.5}]}}']
    rng.shuffle(texts)
    every = S.observed_schema(_messages(spark, texts))
    cuts = [0, *sorted(rng.sample(range(1, len(texts)), 5)), len(texts)]
    parts = [S.observed_schema(_messages(spark, texts[a:b])) for a, b in zip(cuts, cuts[1:])]
    assert S.merge_all(parts) == every
    rng.shuffle(parts)
    assert S.merge_all(parts) == every


def test_lattice_is_associative_and_commutative():
    rng = random.Random(1)
    kinds = [S._of_value(_random_value(rng)) for _ in range(60)] + [T.DecimalType(38, 0), T.DecimalType(5, 4), S.MIXED, S.NOTHING]
    for _ in range(3000):
        a, b, c = rng.choices(kinds, k=3)
        assert S.merge(a, b) == S.merge(b, a)
        assert S.merge(S.merge(a, b), c) == S.merge(a, S.merge(b, c))
        assert S.merge(a, a) == a


def test_schema_log_versions(spark, tmp_path):
    log = S.SchemaLog(spark, str(tmp_path))
    one = S.observed_schema(_messages(spark, ['{"a":1}']))
    two = S.observed_schema(_messages(spark, ['{"a":"x","b":[]}']))
    assert log.current() == (-1, S.NOTHING)
    assert [log.add(one, 0), log.add(one, 1), log.add(two, 2), log.add(two, 2), log.add(one, 3)] == [0, 0, 1, 1, 1]
    assert log.current()[1] == S.merge(one, two)
    assert sorted((r["version"], r["batch_id"]) for r in log.versions().collect()) == [(0, 0), (1, 2)]


def test_nothing_is_written_for_a_schema(spark, tmp_path, monkeypatch):
    from pyspark.sql.readwriter import DataFrameWriter

    def fail(*a, **k):
        raise AssertionError("schema inference wrote a copy")

    for name in ("text", "parquet", "json", "save"):
        monkeypatch.setattr(DataFrameWriter, name, fail)
    assert J.infer_schema(_messages(spark, ['{"a":1}', '[{"b":"x"}]', "bad"])).names == ["a", "b"]
