"""Streaming queries: scoring stream, live RMSE, timed rebuild, registry,
model versions as of a time.

The scoring topic is the events table published as JSON messages (one
topic per ``event_type``); the model is the events regression model (tree
on the type, predicting ``value``) built on the hash-split build side, and
the stream scores the validation side.
"""

from __future__ import annotations

import json
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import models as ML
from ..operators.asof import asof_join
from ..operators.model_data import score_versions
from ..operators.prefix import ordered_prefix
from ..operators.registry import ModelRegistry
from ..operators.series import count_display
from ..operators.split import hash_fraction
from ..operators.tally import N, fit_tallies, tally
from ..session import scratch_path
from ..sources.topic import TopicSource, publish, to_messages
from ..streaming.ingest import subscribe
from ..streaming.rebuild import model_as_of as _model_as_of
from ..streaming.rebuild import rebuild_plan as _rebuild_plan
from ..streaming.rebuild import rebuild_once, score_as_of as _score_as_of, start_rebuild
from ..streaming.score import (
    prefix_stream,
    read_sequence,
    running_rmse_stream,
    score_stream,
    score_with_registry,
    scoring_rows,
)
from .common import query, r6, stage_topic, table
from .models import _EV_MODEL_CTE, events_model
from .topics import EVENT_HINTS


def _scoring_topic(spark: SparkSession, sf: str, files: int | None = None):
    src = stage_topic(spark, table(spark, sf, "events"), topic_col="event_type", files=files, order_col="event_id" if files else None)
    return subscribe(spark, src, hints=EVENT_HINTS)


def _validation_stream(spark: SparkSession, sub) -> DataFrame:
    rows = scoring_rows(spark, sub, label="value")
    return rows.where(hash_fraction("event_id") >= 0.5)


def _scored(spark: SparkSession, sf: str) -> DataFrame:
    model = events_model(spark, sf).model
    sub = _scoring_topic(spark, sf)
    root = scratch_path(spark, "scored")
    score_stream(spark, _validation_stream(spark, sub), model, f"{root}/table", f"{root}/checkpoint")
    return spark.read.parquet(f"{root}/table")


@query(
    "stream_score",
    "H1",
    _EV_MODEL_CTE + "SELECT event_type AS topic, event_id, round(label, 4) AS label, round(prediction, 4) AS prediction FROM pred",
)
def stream_score(spark: SparkSession, sf: str) -> DataFrame:
    s = _scored(spark, sf)
    return s.select("topic", "event_id", F.round("label", 4).alias("label"), F.round("prediction", 4).alias("prediction"))


_TOPIC_RMSE_SQL = (
    _EV_MODEL_CTE + "SELECT event_type AS topic, count(*) AS n, "
    "round(sqrt(avg((label - prediction) * (label - prediction))), 4) AS rmse FROM pred GROUP BY event_type"
)


def topic_rmse(scored: DataFrame) -> DataFrame:
    err2 = F.pow(F.col("label") - F.col("prediction"), 2)
    return scored.groupBy("topic").agg(F.count(F.lit(1)).alias("n"), F.round(F.sqrt(F.avg(err2)), 4).alias("rmse"))


@query("stream_topic_rmse", "H1 D4 D1", _TOPIC_RMSE_SQL)
def stream_topic_rmse(spark: SparkSession, sf: str) -> DataFrame:
    """Flagship: build on one side of the split, score the rest as a stream,
    count and RMSE per topic."""
    return topic_rmse(_scored(spark, sf))


@query(
    "metric_display",
    "B11 D4",
    _EV_MODEL_CTE + "SELECT event_type AS topic, round(sqrt(avg((label - prediction) * (label - prediction))), 4) AS rmse, "
    "format('{:,}', CAST(round(sqrt(avg((label - prediction) * (label - prediction)))) AS BIGINT)) AS rmse_display "
    "FROM pred GROUP BY event_type",
)
def metric_display(spark: SparkSession, sf: str) -> DataFrame:
    """The RMSE value box: the metric and its text, rounded to a whole
    number with thousands marks."""
    scored = events_model(spark, sf).validation.withColumnRenamed("event_type", "topic")
    err2 = F.pow(F.col("label") - F.col("prediction"), 2)
    per = scored.groupBy("topic").agg(F.sqrt(F.avg(err2)).alias("rmse"))
    return per.select("topic", F.round("rmse", 4).alias("rmse"), count_display("rmse").alias("rmse_display"))


@query(
    "model_save_load",
    "A7 G12",
    _EV_MODEL_CTE + "SELECT event_id, round(prediction, 4) AS prediction FROM pred",
)
def model_save_load(spark: SparkSession, sf: str) -> DataFrame:
    fitted = events_model(spark, sf)
    path = ML.save(fitted.model, scratch_path(spark, "model"))
    reloaded = ML.load(path)
    validation = table(spark, sf, "events").where(hash_fraction("event_id") >= 0.5)
    return ML.predict(reloaded, validation).select("event_id", F.round("prediction", 4).alias("prediction"))


@query(
    "stream_running_rmse",
    "H2 E1",
    _EV_MODEL_CTE + "SELECT event_type AS topic, event_id, "
    "row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS seq, "
    "round(sqrt(sum((label - prediction) * (label - prediction)) OVER (PARTITION BY event_type ORDER BY ts, event_id "
    "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) / row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id)), 6) "
    "AS running_rmse FROM pred",
)
def stream_running_rmse(spark: SparkSession, sf: str) -> DataFrame:
    """Live RMSE per topic, one value per scored message."""
    model = events_model(spark, sf).model
    sub = _scoring_topic(spark, sf)
    root = scratch_path(spark, "live-rmse")
    running_rmse_stream(
        spark, _validation_stream(spark, sub), model, f"{root}/out", f"{root}/state", f"{root}/checkpoint",
        ["ts", "event_id"],
    )
    out = spark.read.parquet(f"{root}/out")
    return out.select("topic", "event_id", F.col("seq").cast("bigint").alias("seq"), r6("running_rmse").alias("running_rmse"))


@query(
    "series_by_time_stream",
    "B9 D3",
    "SELECT event_type AS topic, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS seq, "
    "value AS y FROM events",
)
def series_by_time_stream(spark: SparkSession, sf: str) -> DataFrame:
    """The sequence axis kept incrementally by a stream: each arriving row
    gets its number once; newest-first is derived from the topic total."""
    sub = _scoring_topic(spark, sf)
    root = scratch_path(spark, "sequence")
    rows = scoring_rows(spark, sub).select("topic", "ts", "event_id", "value")
    prefix_stream(spark, rows, f"{root}/out", f"{root}/state", f"{root}/checkpoint", ["ts", "event_id"])
    seq = read_sequence(spark, f"{root}/out", f"{root}/state")
    return seq.select("topic", F.col("seq_newest").cast("bigint").alias("seq"), F.col("value").alias("y"))


@query(
    "rebuild_plan",
    "H3",
    "WITH t AS (SELECT event_type AS topic, date_trunc('day', ts) + INTERVAL 1 DAY AS tick_end, count(*) AS n_new "
    "FROM events GROUP BY 1, 2) SELECT topic, tick_end, n_new, "
    "CAST(sum(n_new) OVER (PARTITION BY topic ORDER BY tick_end) AS BIGINT) AS n_all FROM t",
)
def rebuild_plan(spark: SparkSession, sf: str) -> DataFrame:
    """Daily rebuild ticks: rows new in each tick and rows available."""
    hist = table(spark, sf, "events").withColumnRenamed("event_type", "topic")
    return _rebuild_plan(hist, "ts", "1 day")


@query(
    "model_as_of",
    "H4",
    "WITH t AS (SELECT event_type AS topic, date_trunc('day', ts) + INTERVAL 1 DAY AS built_at, count(*) AS n_new "
    "FROM events GROUP BY 1, 2), v AS (SELECT topic, built_at, "
    "CAST(sum(n_new) OVER (PARTITION BY topic ORDER BY built_at) AS BIGINT) AS model_rows FROM t) "
    "SELECT e.event_id, e.event_type AS topic, v.built_at, v.model_rows FROM events e "
    "ASOF LEFT JOIN v ON e.event_type = v.topic AND e.ts >= v.built_at",
)
def model_as_of(spark: SparkSession, sf: str) -> DataFrame:
    """Each message with the newest daily model version built before it."""
    hist = table(spark, sf, "events").withColumnRenamed("event_type", "topic")
    versions = _rebuild_plan(hist, "ts", "1 day").select(
        "topic", F.col("tick_end").alias("built_at"), F.col("n_all").alias("model_rows")
    )
    rows = hist.select("event_id", "topic", "ts")
    return _model_as_of(rows, versions, "topic", "ts", "built_at").select("event_id", "topic", "built_at", "model_rows")


@query(
    "as_of_dense",
    "H4",
    "WITH c AS (SELECT ts AS click_ts, max(event_id) AS click_id FROM events WHERE event_type = 'click' GROUP BY ts) "
    "SELECT e.event_id, c.click_ts, c.click_id FROM events e ASOF LEFT JOIN c ON e.ts >= c.click_ts",
)
def as_of_dense(spark: SparkSession, sf: str) -> DataFrame:
    """Every event with the newest click: one key that holds all rows."""
    ev = table(spark, sf, "events").select("event_id", "ts", F.lit(0).alias("all"))
    clicks = table(spark, sf, "events").where(F.col("event_type") == "click")
    right = clicks.select(F.lit(0).alias("all"), F.col("ts").alias("click_ts"), F.col("event_id").alias("click_id"))
    return asof_join(ev, right, ["all"], "ts", "click_ts").select("event_id", "click_ts", "click_id")


_VERSIONS_CTE = (
    "WITH ev AS (SELECT event_id, ts, event_type, CAST(user_id >= 75 AS DOUBLE) AS hi_user, value, "
    "('0x' || substr(md5(CAST(event_id AS VARCHAR)), 1, 8))::UBIGINT / 4294967296.0 AS u FROM events), "
    "b AS (SELECT epoch_us(min(ts)) AS lo, epoch_us(max(ts)) AS hi FROM events), "
    "c AS (SELECT k, make_timestamp(lo + (hi - lo) // 4 * k) AS cut FROM b, (VALUES (1), (2), (3)) AS t(k)), "
    "m AS (SELECT k, cut, hi_user, avg(value) AS p FROM ev JOIN c ON ts <= cut WHERE event_type = 'click' AND u < 0.5 GROUP BY ALL) "
)


def _dated_versions(spark: SparkSession, sf: str):
    """A model of the click topic built at three moments, from the rows until then."""
    ev = table(spark, sf, "events").withColumn("hi_user", (F.col("user_id") >= 75).cast("double"))
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    lo, hi = ev.agg(F.min(micros), F.max(micros)).first()
    registry = ModelRegistry(spark, scratch_path(spark, "registry"))
    spec = ML.ModelSpec("click", "regression", "decision_tree", "value", ("hi_user",), split_key=("event_id",))
    for k in (1, 2, 3):
        cut = F.timestamp_micros(F.lit(lo + (hi - lo) // 4 * k))
        until = ev.where((F.col("event_type") == "click") & (F.col("ts").cast("timestamp") <= cut))
        built_at = spark.range(1).select(cut).first()[0]
        rebuild_once(spark, ML.training_rows(until, spec), spec, registry, built_at=built_at)
    return ev, spec, registry


@query(
    "score_as_of",
    "H4 G12",
    _VERSIONS_CTE + "SELECT e.event_id, v.k - 1 AS model_version, round(m.p, 4) AS prediction FROM ev e "
    "ASOF LEFT JOIN c v ON e.ts >= v.cut LEFT JOIN m ON m.k = v.k AND m.hi_user = e.hi_user",
)
def score_as_of(spark: SparkSession, sf: str) -> DataFrame:
    """Each event scored with the model version in force at its time."""
    ev, spec, registry = _dated_versions(spark, sf)
    scored = _score_as_of(spark, ev.select("event_id", "ts", "hi_user"), spec, registry, "ts")
    return scored.select("event_id", F.col("model_version").cast("int").alias("model_version"), F.round("prediction", 4).alias("prediction"))


@query(
    "model_versions",
    "D8 D4 H3",
    _VERSIONS_CTE + "SELECT CAST(m.k - 1 AS BIGINT) AS version, any_value(n.n) AS n_build, "
    "round(sqrt(avg((value - p) * (value - p))), 6) AS rmse FROM ev JOIN m ON ev.hi_user = m.hi_user AND ev.ts <= m.cut "
    "JOIN (SELECT k, count(*) AS n FROM ev JOIN c ON ts <= cut WHERE event_type = 'click' GROUP BY k) n ON n.k = m.k "
    "WHERE event_type = 'click' AND u >= 0.5 GROUP BY m.k",
)
def model_versions(spark: SparkSession, sf: str) -> DataFrame:
    """Rows and validation error of every version in the registry."""
    _, spec, registry = _dated_versions(spark, sf)
    return registry.entries(spec).select("version", "n_build", F.round("metric_value", 6).alias("rmse"))


# --- timed rebuild into the registry -----------------------------------------

_REBUILT = {"click": "all", "view": "new"}


def _rebuilt_registry(spark: SparkSession, sf: str) -> ModelRegistry:
    """Replay two topics through timed rebuilds (one version per
    micro-batch): click rebuilt on all rows, view on new rows only."""
    sub = _scoring_topic(spark, sf, files=2)
    registry = ModelRegistry(spark, scratch_path(spark, "registry"))
    for topic, mode in _REBUILT.items():
        src = replace(sub.source, name=topic, max_per_trigger=1)
        rows = scoring_rows(spark, replace(sub, source=src))
        spec = ML.ModelSpec(topic, "regression", "decision_tree", "value", ("user_id",), split_key=("event_id",), rebuild_mode=mode)
        root = f"{registry.root}/jobs/{spec.name}"
        start_rebuild(spark, rows, spec, registry, f"{root}/rows", f"{root}/checkpoint", trigger="availableNow")
    return registry


def rows_covered(registry: ModelRegistry) -> DataFrame:
    """Per live model: rows its data covers -- the latest build's rows for
    "all" rebuilds, the sum over versions for "new" rebuilds."""
    latest = registry.latest()
    # a retried rebuild batch records its version again: count each once
    versions = registry.log().where(F.col("status") == "built").dropDuplicates(["name", "version"])
    sums = versions.groupBy("name").agg(F.sum("n_build").alias("n_sum"))
    return latest.join(sums, "name").select(
        "name",
        F.when(F.col("rebuild_mode") == "all", F.col("n_build")).otherwise(F.col("n_sum")).cast("bigint").alias("rows_covered"),
    )


@query(
    "model_registry_latest",
    "D8 H3",
    "SELECT event_type || 'regressionvaluedecision_tree' AS name, count(*) AS rows_covered FROM events "
    "WHERE event_type IN ('click', 'view') GROUP BY event_type",
)
def model_registry_latest(spark: SparkSession, sf: str) -> DataFrame:
    return rows_covered(_rebuilt_registry(spark, sf))


@query(
    "model_registry_remove",
    "G17",
    "SELECT event_type || 'regressionvaluedecision_tree' AS name, count(*) AS rows_covered FROM events "
    "WHERE event_type = 'view' GROUP BY event_type",
)
def model_registry_remove(spark: SparkSession, sf: str) -> DataFrame:
    registry = _rebuilt_registry(spark, sf)
    registry.remove_topic("click")
    return rows_covered(registry)


_HASH_EV = "('0x' || substr(md5(CAST(event_id AS VARCHAR)), 1, 8))::UBIGINT / 4294967296.0"


@query(
    "model_swap_score",
    "H4 H1 G15",
    "WITH ev AS (SELECT event_id, event_type, CAST(user_id >= 75 AS DOUBLE) AS hi_user, value, "
    f"{_HASH_EV} AS u, event_id * 2 // (max(event_id) OVER () + 1) AS half FROM events), "
    "m AS (SELECT v, hi_user, avg(value) AS p FROM ev JOIN (VALUES (0), (1)) AS t(v) ON half <= v "
    "WHERE event_type = 'click' AND u < 0.5 GROUP BY ALL) "
    "SELECT event_id, ev.hi_user, round(p, 4) AS prediction, CAST(half AS BIGINT) AS model_version FROM ev "
    "JOIN m ON ev.hi_user = m.hi_user AND m.v = half WHERE event_type = 'view'",
)
def model_swap_score(spark: SparkSession, sf: str) -> DataFrame:
    """The click topic's model is rebuilt ("all data") while the view topic is scored: the
    first half of the messages arrives, is built on and scored, then the second; each
    message carries the version that was newest when it came."""
    ev = table(spark, sf, "events").withColumn("hi_user", (F.col("user_id") >= 75).cast("double"))
    half = F.floor(F.col("event_id") * 2 / F.lit(ev.agg(F.max("event_id") + 1).first()[0]))
    target = TopicSource(None, path=scratch_path(spark, "swap-topics"))
    registry = ModelRegistry(spark, scratch_path(spark, "registry"))
    spec = ML.ModelSpec("click", "regression", "decision_tree", "value", ("hi_user",), split_key=("event_id",))
    jobs, out = f"{registry.root}/jobs/{spec.name}", scratch_path(spark, "swap-scored")
    sub = None
    for part in (0, 1):
        publish(to_messages(ev.where(half == part), "event_type"), target)
        sub = sub or subscribe(spark, target, hints=EVENT_HINTS)
        click, view = (replace(sub, source=replace(target, name=n)) for n in ("click", "view"))
        start_rebuild(spark, scoring_rows(spark, click), spec, registry, f"{jobs}/rows", f"{jobs}/checkpoint", trigger="availableNow")
        score_with_registry(spark, scoring_rows(spark, view), registry, spec, f"{out}/table", f"{out}/checkpoint")
    scored = spark.read.parquet(f"{out}/table")
    return scored.select("event_id", "hi_user", F.round("prediction", 4).alias("prediction"), "model_version")


# --- models as data and counts that add up ------------------------------------

_BAYES_CTE = (
    "WITH ev AS (SELECT event_id, ts, CAST(user_id >= 75 AS DOUBLE) AS hi_user, CAST(value > 50 AS DOUBLE) AS hi_value, "
    "CASE WHEN event_id % 5 = 0 THEN 'mixed' WHEN user_id >= 75 THEN 'upper' ELSE 'lower' END AS kind, "
    f"{_HASH_EV} AS u FROM events), "
)


def _bayes(spark: SparkSession, sf: str) -> tuple[DataFrame, ML.ModelSpec]:
    ev = table(spark, sf, "events").withColumns({
        "hi_user": (F.col("user_id") >= 75).cast("double"), "hi_value": (F.col("value") > 50).cast("double"),
        "kind": F.when(F.col("event_id") % 5 == 0, "mixed").when(F.col("user_id") >= 75, "upper").otherwise("lower"),
    })
    spec = ML.ModelSpec("events", "classification", "naive_bayes", "kind", ("hi_user", "hi_value"), split_key=("event_id",))
    return ev.select("event_id", "ts", "hi_user", "hi_value", "kind"), spec


@query(
    "rebuild_by_counts",
    "H3 G4 G11",
    _BAYES_CTE + "c AS (SELECT kind, count(*) AS n, sum(hi_user) AS s1, sum(hi_value) AS s2 FROM ev WHERE u < 0.5 GROUP BY kind), "
    "t AS (SELECT *, ln(n + 1) - ln(sum(n) OVER () + count(*) OVER ()) AS prior FROM c) "
    "SELECT 'rows' AS term, CAST(count(*) AS DOUBLE) AS value FROM ev UNION ALL SELECT kind || ':log_prior', round(prior, 9) FROM t "
    "UNION ALL SELECT kind || ':hi_user:log_likelihood', round(ln(s1 + 1) - ln(n + 2), 9) FROM t "
    "UNION ALL SELECT kind || ':hi_value:log_likelihood', round(ln(s2 + 1) - ln(n + 2), 9) FROM t",
)
def rebuild_by_counts(spark: SparkSession, sf: str) -> DataFrame:
    """A naive Bayes model rebuilt on all data after each of five micro-batches, by adding
    each batch's counts: rows covered and parameters of the last version."""
    ev, spec = _bayes(spark, sf)
    path = scratch_path(spark, "bayes-rows")
    ev.repartitionByRange(5, "event_id").write.parquet(path)
    rows = spark.readStream.schema(ev.schema).option("maxFilesPerTrigger", 1).parquet(path)
    registry = ModelRegistry(spark, scratch_path(spark, "registry"))
    jobs = f"{registry.root}/jobs/bayes"
    start_rebuild(spark, rows, spec, registry, f"{jobs}/rows", f"{jobs}/checkpoint", trigger="availableNow")
    live = registry.latest_for(spec)
    model = json.loads(registry.records(spec).where(F.col("version") == live["version"]).first()["record"])
    terms = [("rows", float(live["n_build"]))]
    for label, prior, theta in zip(model["labels"], model["pi"], model["theta"], strict=True):
        terms.append((f"{label}:log_prior", prior))
        terms += [(f"{label}:{v}:log_likelihood", t) for v, t in zip(spec.variables, theta, strict=True)]
    return spark.createDataFrame(terms, "term string, value double").select("term", F.round("value", 9).alias("value"))


@query(
    "score_many_versions",
    "H4 G12 G4",
    _BAYES_CTE + "b AS (SELECT date_trunc('day', min(ts)) + INTERVAL 1 DAY AS lo, max(ts) AS hi FROM ev), "
    "v AS (SELECT k AS version, lo + k * INTERVAL 2 HOUR AS built_at FROM b, range(0, 12 * 60) AS t(k) WHERE lo + k * INTERVAL 2 HOUR <= hi), "
    "c AS (SELECT version, kind, count(*) AS n, sum(hi_user) AS s1, sum(hi_value) AS s2 FROM v JOIN ev ON ts < built_at AND u < 0.5 GROUP BY ALL), "
    "m AS (SELECT *, ln(n + 1) - ln(sum(n) OVER (PARTITION BY version) + count(*) OVER (PARTITION BY version)) AS prior, "
    "(s1 + 1) / (n + 2) AS p1, (s2 + 1) / (n + 2) AS p2 FROM c), "
    "a AS (SELECT event_id, hi_user, hi_value, version FROM ev ASOF LEFT JOIN v ON ev.ts >= v.built_at), "
    "s AS (SELECT event_id, a.version, kind, row_number() OVER (PARTITION BY event_id ORDER BY round(prior "
    "+ ln(CASE WHEN hi_user = 1 THEN p1 ELSE 1 - p1 END) + ln(CASE WHEN hi_value = 1 THEN p2 ELSE 1 - p2 END), 9) DESC, n DESC, kind) AS r "
    "FROM a LEFT JOIN m ON a.version = m.version) "
    "SELECT event_id, CAST(version AS BIGINT) AS model_version, kind AS prediction FROM s WHERE r = 1",
)
def score_many_versions(spark: SparkSession, sf: str) -> DataFrame:
    """A model rebuilt on all data every two hours for a month (hundreds of versions, made
    from counts), and each event scored with the version in force at its time, in one plan."""
    ev, spec = _bayes(spark, sf)
    every = 2 * 3600 * 10**6
    lo, hi = ev.agg(F.min(F.unix_micros(F.date_trunc("day", "ts"))) + 24 * 3600 * 10**6, F.max(F.unix_micros(F.col("ts").cast("timestamp")))).first()
    last = (hi - lo) // every
    # the first version that knows a row: built after its time
    first = F.greatest(F.lit(0), F.floor((F.unix_micros(F.col("ts").cast("timestamp")) - F.lit(lo)) / F.lit(every)) + 1).cast("bigint")
    counts = tally(ML.training_rows(ev.withColumn("first", first), spec, keep=("first",)), spec, keep=("first",))
    group = [c for c in counts.columns if c not in ("first", N)]
    running = ordered_prefix(counts, ["first"], group, sums={"total": N}, rank_col="nth")
    until = F.lead("first", 1, last + 1).over(Window.partitionBy(*group).orderBy("first"))
    cumulative = running.withColumn("until", until - 1).where(F.col("first") <= F.col("until")).select(
        *group, F.col("total").alias(N), F.explode(F.sequence("first", "until")).alias("version")
    )
    records = fit_tallies(cumulative, spec, "version")
    versions = spark.range(last + 1).select(F.lit(0).alias("all"), F.col("id").alias("model_version"), F.timestamp_micros(F.lit(lo) + F.col("id") * every).alias("built_at"))
    found = asof_join(ev.withColumn("all", F.lit(0)), versions, ["all"], "ts", "built_at").drop("all", "built_at", "kind")
    path = scratch_path(spark, "as-of")
    found.withColumn("part", F.spark_partition_id()).write.parquet(path)
    scored = score_versions(spark.read.parquet(path), records, "model_version", "part", "prediction", as_text=True)
    return scored.select("event_id", "model_version", "prediction")
