"""Pixel columns of a line, difference by fingerprints, compaction by files."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tidepool.operators import series as S
from tidepool.operators import setops as X
from tidepool.operators.asof import asof_join
from tidepool.operators.relational import TableStore
from tidepool.session import scratch_path
from tidepool.sources.topic import TopicSource, publish
from tidepool.streaming import ingest as I


def _corners(points, lo, hi, width):
    out = {}
    for x, y in points:
        if x is None or y is None or not lo <= x <= hi:
            continue
        c = min(int((x - lo) * width // (hi - lo)), width - 1)
        out.setdefault(c, []).append((x, y))
    return {c: (min(p), max(p), min(p, key=lambda q: (q[1], q[0])), min(p, key=lambda q: (-q[1], q[0]))) for c, p in out.items()}


@pytest.mark.parametrize("seed", range(3))
def test_line_columns_and_their_merge(spark, seed):
    rng = random.Random(seed)
    points = [(rng.choice([None, *range(100)]), rng.choice([None, -1.5, 0.0, 2.0, rng.random()])) for _ in range(400)]
    df = spark.createDataFrame([(i, x, y) for i, (x, y) in enumerate(points)], "i int, x long, y double")
    want = _corners(points, 5, 90, 17)
    parts = [S.line_columns(df.where(F.col("i") % 3 == k), "x", "y", 5, 90, 17) for k in range(3)]
    for got in (S.line_columns(df, "x", "y", 5, 90, 17), S.merge_line_columns(*parts)):
        rows = {r["column"]: tuple(tuple(r[c]) for c in ("first", "last", "lowest", "highest")) for r in got.collect()}
        assert rows == want
    drawn = [tuple(r) for r in S.line_points(S.merge_line_columns(*parts)).collect()]
    assert drawn == sorted(set(drawn)) and set(drawn) == {p for corners in want.values() for p in corners}
    with pytest.raises(ValueError):
        S.line_columns(df, "x", "y", 0, 1, 0)
    assert S.line_columns(df, "x", "y", 7, 7, 3).count() == (1 if any(x == 7 and y is not None for x, y in points) else 0)


@pytest.mark.parametrize("bag", [False, True])
def test_difference_by_ranges_is_the_difference(spark, bag):
    rng = random.Random(4)
    row = lambda: (rng.choice([None, *range(-20, 200)]), rng.choice([None, "a", "b"]), rng.choice([None, 0.5, float("nan")]))
    old = [row() for _ in range(600)]
    new = old + [row() for _ in range(6)] + old[:3]
    rng.shuffle(new)
    a, b = (spark.createDataFrame(x, "k long, s string, v double") for x in (new, old))
    want = sorted(map(str, X.new_rows(a, b, bag).collect()))
    assert sorted(map(str, X.new_rows_by_range(a, b, "k", 7, bag).collect())) == want
    assert X.new_rows_by_range(b, b, "k", 7, bag).count() == 0
    assert sorted(map(str, X.new_rows_by_range(a, b.limit(0), "k", 7, bag).collect())) == sorted(map(str, X.new_rows(a, b.limit(0), bag).collect()))


def test_only_differing_ranges_are_compared(spark):
    day = dt.datetime(2024, 1, 1)
    rows = [(i, day + dt.timedelta(minutes=i)) for i in range(2000)]
    a = spark.createDataFrame(rows, "i int, t timestamp_ntz")
    b = a.where(F.col("i") != 1234)
    assert [r["i"] for r in X.new_rows_by_range(a, b, "t", 3600).collect()] == [1234]
    prints = [X.fingerprints(df, F.floor(F.unix_micros(F.col("t").cast("timestamp")) / 3.6e9), True) for df in (a, b)]
    assert prints[0].subtract(prints[1]).count() == 1


def _ingested(spark, sub, ids):
    publish(spark.createDataFrame([(f'{{"id":{i}}}',) for i in ids], "value string").coalesce(1), sub.source)
    I.ingest(spark, sub)


def _sub(spark, tmp_path):
    src = TopicSource("t", path=str(tmp_path / "in"))
    publish(spark.createDataFrame([('{"id":0}',)], "value string"), src)
    return I.subscribe(spark, src)


def test_compaction_goes_by_files_not_by_the_clock(spark, tmp_path, monkeypatch):
    import uuid

    sub, store, name = _sub(spark, tmp_path), TableStore(spark, scratch_path(spark, "tables")), f"c_{uuid.uuid4().hex[:8]}"
    _ingested(spark, sub, range(1, 10))
    assert I.compact_history(spark, sub, store, name, ["id"]).count() == 10
    # a restart on a clock that is an hour behind
    slow = F.current_timestamp
    monkeypatch.setattr(I.F, "current_timestamp", lambda: slow() - F.expr("INTERVAL 1 HOUR"))
    _ingested(spark, sub, range(10, 20))
    assert sorted(r["id"] for r in I.compact_history(spark, sub, store, name, ["id"]).collect()) == list(range(20))
    assert I.compact_history(spark, sub, store, name, ["id"]).count() == 20  # nothing new


def test_a_compaction_that_died_is_finished_once(spark, tmp_path, monkeypatch):
    import uuid

    sub, store, name = _sub(spark, tmp_path), TableStore(spark, scratch_path(spark, "tables")), f"c_{uuid.uuid4().hex[:8]}"
    I.ingest(spark, sub)
    I.compact_history(spark, sub, store, name, ["id"])
    _ingested(spark, sub, range(1, 10))
    append = store.append

    for before in (True, False):  # it dies before its rows are written, then right behind

        def dies(table, df, before=before):
            if not before:
                append(table, df)
            raise RuntimeError("lost")

        monkeypatch.setattr(store, "append", dies)
        with pytest.raises(RuntimeError):
            I.compact_history(spark, sub, store, name, ["id"])
    monkeypatch.setattr(store, "append", append)
    _ingested(spark, sub, range(10, 12))
    assert sorted(r["id"] for r in I.compact_history(spark, sub, store, name, ["id"]).collect()) == list(range(10))
    assert sorted(r["id"] for r in I.compact_history(spark, sub, store, name, ["id"]).collect()) == list(range(12))


def test_asof_join_with_a_map_on_the_right(spark):
    left = spark.createDataFrame([(1, 10), (1, 20)], "k int, t int").withColumn("t", F.col("t").cast("timestamp"))
    right = spark.createDataFrame([(1, 5, {"a": 1}), (1, 15, {"b": 2}), (1, 15, {"b": 2})], "k int, at int, m map<string,int>")
    got = asof_join(left, right.withColumn("at", F.col("at").cast("timestamp")), ["k"], "t", "at").collect()
    assert sorted(str(r["m"]) for r in got) == ["{'a': 1}", "{'b': 2}"]
