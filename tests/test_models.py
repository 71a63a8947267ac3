"""Model definition checks, fit/score invariants, save/load, split."""

import pytest
from pyspark.sql import functions as F

from tidepool.operators import models as ML
from tidepool.operators.split import hash_split
from tidepool.session import scratch_path

LI = "/root/testdata/sf0.001/lineitem.parquet"


@pytest.fixture(scope="module")
def li(spark):
    df = spark.read.parquet(LI)
    return df.withColumn("q25", (F.col("l_quantity") > 25).cast("double"))


def spec(kind, algo, label, variables, **kw):
    return ML.ModelSpec("t", kind, algo, label, tuple(variables), split_key=("l_orderkey", "l_linenumber"), **kw)


def test_kind_algorithm_compatibility():
    for algo in ("logit", "naive_bayes", "linear_svm"):
        with pytest.raises(ValueError):
            spec("regression", algo, "l_extendedprice", ["l_quantity"])
    spec("regression", "decision_tree", "l_extendedprice", ["l_quantity"])
    spec("classification", "random_forest", "l_returnflag", ["l_quantity"])


@pytest.mark.parametrize("bad", [0.0, 1.0, 1.5])
def test_ratio_bounds(bad):
    with pytest.raises(ValueError):
        spec("regression", "decision_tree", "l_extendedprice", ["l_quantity"], ratio=bad)


def test_label_not_a_variable():
    with pytest.raises(ValueError):
        spec("regression", "decision_tree", "l_quantity", ["l_quantity"])


def test_rebuild_interval_bounds():
    with pytest.raises(ValueError):
        spec("regression", "decision_tree", "l_extendedprice", ["l_quantity"], rebuild_minutes=0)


def test_other_label_column_rejected(li):
    s = spec("regression", "decision_tree", "l_extendedprice", ["l_quantity"])
    with pytest.raises(ValueError):
        ML.prepare(li.withColumn("label", F.lit(1)), s)


def test_naive_bayes_needs_binary(li):
    s = spec("classification", "naive_bayes", "l_returnflag", ["l_quantity"])
    with pytest.raises(ValueError):
        ML.build_model(li, s)


def test_svm_is_binary(li):
    s = spec("classification", "linear_svm", "l_returnflag", ["l_quantity"])
    with pytest.raises(ValueError):
        ML.build_model(li, s)


def test_empty_build_slice(li):
    s = spec("regression", "decision_tree", "l_extendedprice", ["l_quantity"])
    with pytest.raises(ValueError):
        ML.build_model(li.where(F.lit(False)), s)


def test_save_load_same_predictions(spark, li):
    s = spec("classification", "decision_tree", "l_returnflag", ["l_quantity", "l_linestatus"])
    fitted = ML.build_model(li, s)
    path = ML.save(fitted.model, scratch_path(spark, "model-test"))
    again = ML.predict(ML.load(path), ML.prepare(li, s))
    first = ML.predict(fitted.model, ML.prepare(li, s))
    key = ["l_orderkey", "l_linenumber", "l_partkey"]
    diff = first.select(*key, "prediction").exceptAll(again.select(*key, "prediction"))
    assert diff.count() == 0


def test_forest_regression_within_label_range(li):
    s = spec("regression", "random_forest", "l_extendedprice", ["l_quantity", "l_discount", "l_linestatus"])
    v = ML.build_model(li, s).validation
    lo, hi = li.agg(F.min("l_extendedprice"), F.max("l_extendedprice")).first()
    assert v.where((F.col("prediction") < lo) | (F.col("prediction") > hi)).count() == 0


def test_same_seed_same_predictions(li):
    s = spec("classification", "random_forest", "l_returnflag", ["l_quantity", "l_discount"])
    a = ML.build_model(li, s).validation.select("l_orderkey", "l_linenumber", "l_partkey", "prediction")
    b = ML.build_model(li, s).validation.select("l_orderkey", "l_linenumber", "l_partkey", "prediction")
    assert a.exceptAll(b).count() == 0


def test_prediction_is_label_text(li):
    s = spec("classification", "logit", "l_returnflag", ["l_quantity", "l_linestatus"])
    fitted = ML.build_model(li, s)
    assert set(r[0] for r in fitted.validation.select("prediction").distinct().collect()) <= {"A", "N", "R"}
    assert sorted(ML.class_labels(fitted.model)) == ["A", "N", "R"]


def test_unseen_category(spark, li):
    s = spec("regression", "decision_tree", "l_extendedprice", ["l_returnflag"])
    seen = li.where(F.col("l_returnflag") != "R")
    other = ML.prepare(li.where(F.col("l_returnflag") == "R"), s)
    fitted = ML.build_model(seen, s)
    with pytest.raises(Exception):
        # collect the prediction itself (a count alone prunes the model away)
        ML.predict(fitted.model, other).select("prediction").collect()
    keep = ML.ModelSpec("t", "regression", "decision_tree", "l_extendedprice", ("l_returnflag",),
                        split_key=("l_orderkey", "l_linenumber"), handle_invalid="keep")
    fitted = ML.build_model(seen, keep)
    assert len(ML.predict(fitted.model, other).select("prediction").collect()) == other.count()


def test_single_valued_category_rejected(li):
    s = spec("regression", "decision_tree", "l_extendedprice", ["l_linestatus"])
    with pytest.raises(ValueError):
        ML.build_model(li.where(F.col("l_linestatus") == "O"), s)


def test_hash_split_partition_invariant(spark):
    ev = spark.read.parquet("/root/testdata/sf0.01/events.parquet")
    a, _ = hash_split(ev.repartition(1), 0.35, "event_id")
    b, _ = hash_split(ev.repartition(7), 0.35, "event_id")
    assert a.select("event_id").exceptAll(b.select("event_id")).count() == 0
    assert a.count() == b.count()


def test_summary_names_features(spark, li):
    s = spec("classification", "logit", "l_returnflag", ["l_quantity", "l_linestatus"])
    fitted = ML.build_model(li, s)
    terms = [r["term"] for r in ML.summary(spark, fitted.model, fitted.build_rows.select(*s.variables, "label")).collect()]
    assert any("l_quantity" in t for t in terms) and any("l_linestatus" in t for t in terms)


def test_hash_split_covers_every_row_once(spark):
    df = spark.createDataFrame([(i if i % 5 else None, i) for i in range(200)], "k int, v int")
    build, validation = hash_split(df, 0.5, "k")
    assert build.count() + validation.count() == 200
    assert build.join(validation, "v").count() == 0
    b2, v2 = hash_split(df, 0.5, ["k", "v"])
    assert b2.count() + v2.count() == 200


def test_default_split_is_the_same_for_any_partitioning(li):
    s = ML.ModelSpec("t", "regression", "decision_tree", "l_extendedprice", ("l_quantity",))
    key = ["l_orderkey", "l_linenumber", "l_partkey"]
    one = ML.split(li.repartition(1), s)[0].select(*key)
    for n in (4, 7):
        other = ML.split(li.repartition(n), s)[0].select(*key)
        assert one.exceptAll(other).count() == other.exceptAll(one).count() == 0
    assert 0.4 < one.count() / li.count() < 0.6


def test_default_split_uses_the_message_coordinate(spark):
    rows = [("t", 0, i, 0, None, 1.0) for i in range(100)] + [("t", None, None, 0, None, float(i)) for i in range(100)]
    df = spark.createDataFrame(rows, "topic string, _partition int, _offset bigint, _pos int, _ingested_at timestamp, v double")
    build, validation = ML.hash_split(df, 0.5)
    assert build.count() + validation.count() == 200
    # equal payloads are told apart by their offsets
    assert 0 < build.where("_offset IS NOT NULL").count() < 100


def test_null_labels_do_not_break_a_fit(li):
    s = spec("classification", "decision_tree", "l_returnflag", ["l_quantity"])
    some = li.withColumn("l_returnflag", F.when(F.col("l_orderkey") % 50 != 0, F.col("l_returnflag")))
    assert ML.build_model(some, s).validation.count() > 0
