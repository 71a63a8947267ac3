"""Series helpers: types, display, stacking, order, latest."""

import pytest
from pyspark.sql import functions as F

from tidepool.operators import series as S
from tidepool.operators.asof import asof_join


def test_count_display(spark):
    df = spark.createDataFrame([(0,), (999,), (1000,), (1234567,)], "n bigint")
    got = [r[0] for r in df.select(S.count_display("n")).collect()]
    assert got == ["0", "999", "1,000", "1,234,567"]


def test_stacked_bars_split_signs(spark):
    df = spark.createDataFrame([("a", 3.0), ("a", -1.0), ("a", 2.0), ("b", -4.0), ("b", None)], "x string, y double")
    got = {r["x"]: (r["pos_height"], r["neg_height"], r["n_bars"]) for r in S.stacked_bars(df, "x", "y").collect()}
    assert got == {"a": (5.0, -1.0, 3), "b": (0.0, -4.0, 1)}


def test_series_xy_requires_numeric_y(spark):
    df = spark.createDataFrame([("a", "b")], "x string, y string")
    with pytest.raises(TypeError):
        S.series_xy(df, "x", "y")


def test_line_by_x_is_ordered(spark):
    df = spark.createDataFrame([(3, 1.0), (1, 2.0), (2, 0.5), (1, 1.0)], "x int, y double")
    assert [(r["x"], r["y"]) for r in S.line_by_x(df, "x", "y").collect()] == [(1, 1.0), (1, 2.0), (2, 0.5), (3, 1.0)]


def test_latest_without_groups(spark):
    df = spark.createDataFrame([(1, 10, "a"), (3, 5, "b"), (3, 7, "c")], "t int, id int, v string")
    assert S.latest(df, ["t", "id"]).first()["v"] == "c"


def test_asof_many_right_rows_of_one_key(spark):
    right = spark.range(10_001).select(F.lit("k").alias("k"), F.timestamp_seconds("id").alias("rt"), F.col("id").alias("version"))
    left = spark.createDataFrame([("k", 20_000), ("k", 77), ("z", 5), (None, 5), ("k", None)], "k string, lt int")
    left = left.withColumn("at", F.timestamp_seconds("lt"))
    got = sorted(asof_join(left, right, ["k"], "at", "rt").select("k", "lt", "version").collect(), key=str)
    assert got == sorted([("k", 20_000, 10_000), ("k", 77, 77), ("z", 5, None), (None, 5, None), ("k", None, None)], key=str)


from hypothesis import given, settings  # noqa: E402
from hypothesis import strategies as st  # noqa: E402


@settings(max_examples=8, deadline=None)
@given(
    rows=st.lists(
        st.tuples(st.sampled_from(["a", "b", None]), st.one_of(st.none(), st.integers(0, 5))), min_size=1, max_size=40
    )
)
def test_latest_property(spark, rows):
    data = [(g, t, i) for i, (g, t) in enumerate(rows)]
    df = spark.createDataFrame(data, "g string, t int, id int")
    got = {r["g"]: (r["t"], r["id"]) for r in S.latest(df, ["t", "id"], ["g"]).collect()}

    def key(r):  # NULL orders lowest
        return (r[1] is not None, r[1] if r[1] is not None else 0, r[2])

    want = {}
    for g in {r[0] for r in data}:
        best = max((r for r in data if r[0] == g), key=key)
        want[g] = (best[1], best[2])
    assert got == want
