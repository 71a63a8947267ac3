"""Physical plan checks: filters reach the scan, aggregates combine map-side,
the big side of derived joins is never shuffled, no cartesian products."""

import contextlib
import io

from paths import SMALL

from tidepool.plans.catalog import REGISTRY


def plan(spark, name):
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        REGISTRY[name].run(spark, SMALL).explain(mode="formatted")
    return buf.getvalue()


def test_range_filter_pushed_to_scan(spark):
    p = plan(spark, "new_rows_by_offset")
    assert "PushedFilters: [IsNotNull(ts), GreaterThan(ts" in p
    assert "Exchange" not in p


def test_projection_pruned_at_scan(spark):
    p = plan(spark, "bar_by_x")
    assert "ReadSchema: struct<user_id:bigint,value:double>" in p


def test_partial_aggregation_before_shuffle(spark):
    p = plan(spark, "bar_by_x")
    assert "partial_sum" in p and "HashAggregate" in p


def test_latest_reads_its_input_once(spark):
    p = plan(spark, "latest_message")
    tree = p[: p.index("(1)")]  # the operators' tree, before their details
    assert tree.count("Scan parquet") <= 1 and "Join" not in tree
    assert "partial_max_by" in p


def test_prefix_neither_joins_nor_broadcasts(spark):
    p = plan(spark, "series_by_time")
    assert "Join" not in p and "Broadcast" not in p
    # no global (unpartitioned) window over data rows
    assert "SinglePartition" not in p


def test_asof_neither_joins_nor_collects_arrays(spark):
    p = plan(spark, "as_of_dense")
    assert "Join" not in p and "Broadcast" not in p and "collect_list" not in p
    assert "SinglePartition" not in p


def test_no_cartesian_anywhere_cheap(spark):
    for name in ("natural_join", "history_union", "new_rows", "accuracy", "class_metrics", "confusion_matrix"):
        p = plan(spark, name)
        assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p, name


def test_decode_stays_in_jvm(spark):
    p = plan(spark, "json_flatten")
    assert "from_json" in p
    assert "PythonUDF" not in p and "BatchEvalPython" not in p and "ArrowEvalPython" not in p
