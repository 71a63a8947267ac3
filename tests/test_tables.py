"""Relational operators and the catalog table store."""

import uuid

import pytest
from pyspark.sql import functions as F

from tidepool.operators import relational as R
from tidepool.operators import setops as X
from tidepool.session import scratch_path


def test_natural_join_needs_a_shared_column(spark):
    a = spark.createDataFrame([(1, "x")], "k int, a string")
    b = spark.createDataFrame([(1, "y")], "j int, b string")
    with pytest.raises(ValueError):
        R.natural_join(a, b)
    c = spark.createDataFrame([(1, "x", 3)], "k int, a string, z int")
    assert R.natural_join(a, c).columns == ["a", "k", "z"]


def test_table_store_cycle(spark):
    store = R.TableStore(spark, scratch_path(spark, "tables-test"))
    name = f"t_{uuid.uuid4().hex[:8]}"
    df = spark.range(10).withColumn("v", F.col("id") * 2)
    assert not store.exists(name)
    assert store.create_if_absent(name, df)
    assert not store.create_if_absent(name, df)
    store.append(name, df)
    assert store.read(name).count() == 20
    # the new contents are computed from the table being replaced
    store.overwrite(name, store.read(name).where(F.col("id") < 3).withColumn("v", F.lit(0).cast("bigint")))
    got = store.read(name)
    assert got.count() == 6 and got.agg(F.max("v")).first()[0] == 0
    with pytest.raises(LookupError):
        store.read(f"missing_{uuid.uuid4().hex[:8]}")


def test_conditional_update_keeps_type(spark):
    df = spark.createDataFrame([(1, 2.5), (2, 3.5)], "k int, v double")
    out = R.conditional_update(df, "v", F.col("k") == 1, 0)
    assert out.schema["v"].dataType.simpleString() == "double"
    assert sorted(r["v"] for r in out.collect()) == [0.0, 3.5]


def test_bag_and_set_difference(spark):
    a = spark.createDataFrame([(1,), (1,), (2,), (None,)], "x int")
    b = spark.createDataFrame([(1,), (None,)], "x int")
    assert sorted(r["x"] for r in X.new_rows(a, b).collect()) == [2]
    assert sorted(r["x"] for r in X.new_rows(a, b, bag=True).collect()) == [1, 2]


def test_union_by_name_fills_missing(spark):
    a = spark.createDataFrame([(1, 2)], "x int, y int")
    b = spark.createDataFrame([(3, 4)], "x int, z int")
    rows = X.union_by_name(a, b).orderBy("x").collect()
    assert rows[0]["z"] is None and rows[1]["y"] is None
