"""Model queries: split, the five algorithms, evaluation, running metrics.

The oracles rest on closed forms (checked against MLlib): a tree on one
binary feature predicts the build-side mean (regression) or majority class
(classification) of each feature value; a logistic regression on one binary
feature is saturated, so its probability is the build-side rate; Bernoulli
naive Bayes has log priors ``ln(n_c+1) - ln(N+K)`` and log likelihoods
``ln(s_cf+1) - ln(n_c+2)``; a forest of whole trees equals its one tree; a
linear SVM is right on every row of separable classes.  Wider feature sets are
checked by invariants in the tests.
"""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import metrics as M
from ..operators import models as ML
from ..operators.series import series_by_time
from ..operators.split import hash_split
from ..session import scratch_path
from .common import query, r6, table

# --- shared inputs ---------------------------------------------------------

LI_KEY = ("l_orderkey", "l_linenumber")
HASH_LI = (
    "('0x' || substr(md5(CAST(l_orderkey AS VARCHAR) || '|' || CAST(l_linenumber AS VARCHAR)), 1, 8))::UBIGINT"
    " / 4294967296.0"
)
HASH_EV = "('0x' || substr(md5(CAST(event_id AS VARCHAR)), 1, 8))::UBIGINT / 4294967296.0"

LI_CTE = (
    "li AS (SELECT l_orderkey, l_linenumber, CAST(l_quantity > 25 AS DOUBLE) AS q25, "
    "CAST(l_discount > 0.05 AS DOUBLE) AS d05, l_extendedprice, l_returnflag, "
    f"{HASH_LI} AS u FROM lineitem)"
)


def _lineitem(spark: SparkSession, sf: str) -> DataFrame:
    li = table(spark, sf, "lineitem")
    return li.select(
        "l_orderkey",
        "l_linenumber",
        (F.col("l_quantity") > 25).cast("double").alias("q25"),
        (F.col("l_discount") > 0.05).cast("double").alias("d05"),
        "l_quantity",
        "l_discount",
        "l_extendedprice",
        "l_returnflag",
        "l_linestatus",
    )


def _spec(topic, kind, algorithm, label, variables, key, **kw) -> ML.ModelSpec:
    return ML.ModelSpec(topic, kind, algorithm, label, tuple(variables), split_key=tuple(key), **kw)


# --- G1: split -------------------------------------------------------------

_EV_COLS = "event_id, ts, user_id, event_type, value"


@query("split_build", "G1", f"SELECT {_EV_COLS} FROM events WHERE {HASH_EV} < 0.5")
def split_build(spark: SparkSession, sf: str) -> DataFrame:
    build, _ = hash_split(table(spark, sf, "events").drop("props"), 0.5, "event_id")
    return build


@query("split_validation", "G1", f"SELECT {_EV_COLS} FROM events WHERE {HASH_EV} >= 0.5")
def split_validation(spark: SparkSession, sf: str) -> DataFrame:
    _, validation = hash_split(table(spark, sf, "events").drop("props"), 0.5, "event_id")
    return validation


# --- trees on one binary feature ------------------------------------------

_DT_REG_SQL = (
    f"WITH {LI_CTE}, means AS (SELECT q25, avg(l_extendedprice) AS m FROM li WHERE u < 0.5 GROUP BY q25), "
    "pred AS (SELECT li.l_orderkey, li.l_linenumber, li.q25, li.l_extendedprice AS label, means.m AS prediction "
    "FROM li JOIN means ON li.q25 = means.q25 WHERE li.u >= 0.5) "
)


def _dt_regression(spark: SparkSession, sf: str) -> ML.FittedModel:
    spec = _spec("lineitem", "regression", "decision_tree", "l_extendedprice", ["q25"], LI_KEY)
    return ML.build_model(_lineitem(spark, sf), spec)


@query(
    "model_dt_reg",
    "G6 G2 G12",
    _DT_REG_SQL + "SELECT l_orderkey, l_linenumber, q25, round(label, 4) AS label, round(prediction, 4) AS prediction FROM pred",
)
def model_dt_reg(spark: SparkSession, sf: str) -> DataFrame:
    v = _dt_regression(spark, sf).validation
    return v.select(*LI_KEY, "q25", F.round("label", 4).alias("label"), F.round("prediction", 4).alias("prediction"))


@query(
    "rmse_validation",
    "D4 G14",
    _DT_REG_SQL + "SELECT round(sqrt(avg((label - prediction) * (label - prediction))), 4) AS rmse, count(*) AS n FROM pred",
)
def rmse_validation(spark: SparkSession, sf: str) -> DataFrame:
    m = M.rmse(_dt_regression(spark, sf).validation)
    return m.select(F.round("rmse", 4).alias("rmse"), "n")


_DT_CLS_SQL = (
    f"WITH {LI_CTE}, cnt AS (SELECT q25, l_returnflag, count(*) AS n FROM li WHERE u < 0.5 GROUP BY ALL), "
    "maj AS (SELECT q25, arg_max(l_returnflag, n) AS p FROM cnt GROUP BY q25), "
    "pred AS (SELECT li.l_orderkey, li.l_linenumber, li.q25, li.l_returnflag AS label, maj.p AS prediction "
    "FROM li JOIN maj ON li.q25 = maj.q25 WHERE li.u >= 0.5) "
)


def _dt_classification(spark: SparkSession, sf: str) -> ML.FittedModel:
    spec = _spec("lineitem", "classification", "decision_tree", "l_returnflag", ["q25"], LI_KEY)
    return ML.build_model(_lineitem(spark, sf), spec)


@query(
    "model_dt_class",
    "G5 G13",
    _DT_CLS_SQL + "SELECT l_orderkey, l_linenumber, q25, label, prediction FROM pred",
)
def model_dt_class(spark: SparkSession, sf: str) -> DataFrame:
    v = _dt_classification(spark, sf).validation
    return v.select(*LI_KEY, "q25", "label", "prediction")


@query(
    "confusion_matrix",
    "D5",
    _DT_CLS_SQL + "SELECT label AS actual, count(*) FILTER (WHERE prediction = 'A') AS \"A\", "
    "count(*) FILTER (WHERE prediction = 'N') AS \"N\", count(*) FILTER (WHERE prediction = 'R') AS \"R\" "
    "FROM pred GROUP BY label",
)
def confusion_matrix(spark: SparkSession, sf: str) -> DataFrame:
    fitted = _dt_classification(spark, sf)
    table_ = M.confusion_matrix(fitted.validation, ML.class_labels(fitted.model))
    return table_.where(F.col("actual") != M.OTHER).select("actual", "A", "N", "R")


@query(
    "confusion_matrix_nulls",
    "D5",
    _DT_CLS_SQL + ", m AS (SELECT CASE WHEN substr(md5(CAST(l_orderkey AS VARCHAR)), 1, 1) = 'a' THEN '(other)' "
    "WHEN label = 'N' THEN '(other)' ELSE label END AS actual, CASE WHEN prediction = 'N' THEN '(other)' ELSE prediction END AS p FROM pred), "
    "k(actual) AS (VALUES ('A'), ('R'), ('(other)')) "
    "SELECT k.actual, count(*) FILTER (WHERE p = 'A') AS \"A\", count(*) FILTER (WHERE p = 'R') AS \"R\", "
    "count(*) FILTER (WHERE p = '(other)') AS \"(other)\" FROM k LEFT JOIN m ON k.actual = m.actual GROUP BY k.actual",
)
def confusion_matrix_nulls(spark: SparkSession, sf: str) -> DataFrame:
    """Rows without a label and rows of a class outside the list keep a row and a column."""
    v = _dt_classification(spark, sf).validation
    unlabelled = F.substring(F.md5(F.col("l_orderkey").cast("string")), 1, 1) == "a"
    return M.confusion_matrix(v.withColumn("label", F.when(~unlabelled, F.col("label"))), ["A", "R"])


@query(
    "confusion_cells",
    "D5",
    _DT_CLS_SQL + "SELECT label AS actual, prediction AS predicted, count(*) AS n FROM pred GROUP BY ALL",
)
def confusion_cells(spark: SparkSession, sf: str) -> DataFrame:
    return M.confusion_long(_dt_classification(spark, sf).validation)


_PER_CLASS_SQL = (
    "cells AS (SELECT label AS a, prediction AS p, count(*) AS n FROM pred GROUP BY ALL), "
    "act AS (SELECT a AS c, sum(n) AS an, sum(n) FILTER (WHERE a = p) AS tp FROM cells GROUP BY a), "
    "prd AS (SELECT p AS c, sum(n) AS pn FROM cells GROUP BY p), "
    "per AS (SELECT coalesce(act.c, prd.c) AS c, coalesce(an, 0) AS an, coalesce(tp, 0) AS tp, coalesce(pn, 0) AS pn "
    "FROM act FULL OUTER JOIN prd ON act.c = prd.c), "
    "per2 AS (SELECT *, sum(an) OVER () AS tot FROM per) "
)


@query(
    "accuracy",
    "D6 D7",
    _DT_CLS_SQL + ", " + _PER_CLASS_SQL[:-1] + " "
    "SELECT round(sum(tp) / max(tot), 6) AS accuracy, "
    "round((sum(tp) / max(tot) - sum(an * pn) / (max(tot) * max(tot))) / (1 - sum(an * pn) / (max(tot) * max(tot))), 6) AS kappa, "
    "round(max(an) / max(tot), 6) AS no_information_rate, CAST(max(tot) AS BIGINT) AS n FROM per2",
)
def accuracy(spark: SparkSession, sf: str) -> DataFrame:
    m = M.overall_metrics(_dt_classification(spark, sf).validation)
    return m.select(r6("accuracy").alias("accuracy"), r6("kappa").alias("kappa"), r6("no_information_rate").alias("no_information_rate"), "n")


@query(
    "class_metrics",
    "D7",
    _DT_CLS_SQL + ", " + _PER_CLASS_SQL[:-1] + " "
    "SELECT c AS class, CAST(tp AS BIGINT) AS tp, CAST(pn - tp AS BIGINT) AS fp, CAST(an - tp AS BIGINT) AS fn, "
    "CAST(tot - an - pn + tp AS BIGINT) AS tn, "
    "round(tp / an, 6) AS sensitivity, round((tot - an - pn + tp) / (tot - an), 6) AS specificity, "
    "round(CASE WHEN pn > 0 THEN tp / pn END, 6) AS precision, "
    "round(CASE WHEN pn > 0 AND tp > 0 THEN 2 * (tp / pn) * (tp / an) / ((tp / pn) + (tp / an)) END, 6) AS f1, "
    "round(an / tot, 6) AS prevalence, round(tp / tot, 6) AS detection_rate, round(pn / tot, 6) AS detection_prevalence, "
    "round((tp / an + (tot - an - pn + tp) / (tot - an)) / 2, 6) AS balanced_accuracy FROM per2",
)
def class_metrics(spark: SparkSession, sf: str) -> DataFrame:
    m = M.class_metrics(_dt_classification(spark, sf).validation)
    rounded = ["sensitivity", "specificity", "precision", "f1", "prevalence", "detection_rate", "detection_prevalence", "balanced_accuracy"]
    return m.select("class", *[F.col(c).cast("bigint").alias(c) for c in ("tp", "fp", "fn", "tn")], *[r6(c).alias(c) for c in rounded])


# --- naive Bayes, logistic regression, SVM, forests ------------------------


@query(
    "model_nb",
    "G4",
    f"WITH {LI_CTE}, c AS (SELECT l_returnflag, count(*) AS nc, sum(q25) AS s1, sum(d05) AS s2 FROM li "
    "WHERE u < 0.5 GROUP BY l_returnflag), t AS (SELECT *, sum(nc) OVER () AS n, count(*) OVER () AS k FROM c) "
    "SELECT l_returnflag AS class, round(ln(nc + 1) - ln(n + k), 9) AS log_prior, "
    "round(ln(s1 + 1) - ln(nc + 2), 9) AS theta_q25, round(ln(s2 + 1) - ln(nc + 2), 9) AS theta_d05 FROM t",
)
def model_nb(spark: SparkSession, sf: str) -> DataFrame:
    """Bernoulli naive Bayes on two 0/1 features: fitted parameters."""
    spec = _spec("lineitem", "classification", "naive_bayes", "l_returnflag", ["q25", "d05"], LI_KEY)
    data = ML.prepare(_lineitem(spark, sf), spec)
    build, _ = ML.split(data, spec)
    model = ML.fit(build, spec)
    nb = model.stages[1]
    labels = ML.class_labels(model)
    pi, theta = nb.pi.toArray(), nb.theta.toArray()
    rows = [(labels[k], float(pi[k]), float(theta[k, 0]), float(theta[k, 1])) for k in range(len(labels))]
    df = spark.createDataFrame(rows, "class string, log_prior double, theta_q25 double, theta_d05 double")
    return df.select("class", *[F.round(c, 9).alias(c) for c in ("log_prior", "theta_q25", "theta_d05")])


@query(
    "model_logit",
    "G3",
    "WITH ev AS (SELECT event_id, CAST(value > 50 AS DOUBLE) AS hi, "
    f"CASE WHEN event_type = 'click' THEN 'click' ELSE 'other' END AS kind, {HASH_EV} AS u FROM events), "
    "rate AS (SELECT hi, avg(CASE WHEN kind = 'click' THEN 1.0 ELSE 0.0 END) AS r FROM ev WHERE u < 0.5 GROUP BY hi) "
    "SELECT event_id, ev.hi, round(r, 4) AS p_click FROM ev JOIN rate ON ev.hi = rate.hi WHERE u >= 0.5",
)
def model_logit(spark: SparkSession, sf: str) -> DataFrame:
    """Saturated logistic regression: P(click | value > 50)."""
    ev = table(spark, sf, "events").select(
        "event_id",
        (F.col("value") > 50).cast("double").alias("hi"),
        F.when(F.col("event_type") == "click", "click").otherwise("other").alias("kind"),
    )
    spec = _spec("events", "classification", "logit", "kind", ["hi"], ["event_id"], params=(("tol", 1e-10),))
    fitted = ML.build_model(ev, spec)
    scored = ML.class_probability(fitted.validation, fitted.model, "click", "p_click")
    return scored.select("event_id", "hi", F.round("p_click", 4).alias("p_click"))


@query(
    "model_logit_multiclass",
    "G3",
    f"WITH {LI_CTE}, rate AS (SELECT q25, avg(CAST(l_returnflag = 'A' AS DOUBLE)) AS a, avg(CAST(l_returnflag = 'N' AS DOUBLE)) AS n, "
    "avg(CAST(l_returnflag = 'R' AS DOUBLE)) AS r FROM li WHERE u < 0.5 GROUP BY q25) "
    "SELECT l_orderkey, l_linenumber, li.q25, l_returnflag AS label, round(a, 4) AS p_a, round(n, 4) AS p_n, round(r, 4) AS p_r "
    "FROM li JOIN rate ON li.q25 = rate.q25 WHERE u >= 0.5",
)
def model_logit_multiclass(spark: SparkSession, sf: str) -> DataFrame:
    """Saturated multinomial logistic regression: class rates per feature value."""
    spec = _spec("lineitem", "classification", "logit", "l_returnflag", ["q25"], LI_KEY, params=(("tol", 1e-10),))
    fitted = ML.build_model(_lineitem(spark, sf), spec)
    labels = ML.class_labels(fitted.model)
    p = vector_to_array("probability")
    rates = [F.round(p[labels.index(c)], 4).alias(f"p_{c.lower()}") for c in ("A", "N", "R")]
    return fitted.validation.select(*LI_KEY, "q25", "label", *rates)


@query(
    "model_svm",
    "G9",
    f"WITH li AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity > 25 THEN 'large' ELSE 'small' END AS label, {HASH_LI} AS u FROM lineitem) "
    "SELECT l_orderkey, l_linenumber, label, label AS prediction FROM li WHERE u >= 0.5",
)
def model_svm(spark: SparkSession, sf: str) -> DataFrame:
    """Linear SVM on separable classes: every validation row is right."""
    li = _lineitem(spark, sf).withColumn("size", F.when(F.col("l_quantity") > 25, "large").otherwise("small"))
    spec = _spec("lineitem", "classification", "linear_svm", "size", ["q25"], LI_KEY)
    return ML.build_model(li, spec).validation.select(*LI_KEY, "label", "prediction")


#: A forest whose trees all see every row and feature: each is the one tree.
WHOLE_TREES = (("bootstrap", False), ("featureSubsetStrategy", "all"), ("subsamplingRate", 1.0))


@query(
    "model_rf_reg",
    "G8",
    _DT_REG_SQL + "SELECT l_orderkey, l_linenumber, q25, round(label, 4) AS label, round(prediction, 4) AS prediction FROM pred",
)
def model_rf_reg(spark: SparkSession, sf: str) -> DataFrame:
    spec = _spec("lineitem", "regression", "random_forest", "l_extendedprice", ["q25"], LI_KEY, params=WHOLE_TREES)
    v = ML.build_model(_lineitem(spark, sf), spec).validation
    return v.select(*LI_KEY, "q25", F.round("label", 4).alias("label"), F.round("prediction", 4).alias("prediction"))


@query(
    "model_rf_class",
    "G7",
    _DT_CLS_SQL + "SELECT l_orderkey, l_linenumber, q25, label, prediction FROM pred",
)
def model_rf_class(spark: SparkSession, sf: str) -> DataFrame:
    spec = _spec("lineitem", "classification", "random_forest", "l_returnflag", ["q25"], LI_KEY, params=WHOLE_TREES)
    return ML.build_model(_lineitem(spark, sf), spec).validation.select(*LI_KEY, "q25", "label", "prediction")


@query(
    "model_summary",
    "G11",
    f"WITH {LI_CTE}, c AS (SELECT l_returnflag, count(*) AS nc, sum(q25) AS s1, sum(d05) AS s2 FROM li "
    "WHERE u < 0.5 GROUP BY l_returnflag), t AS (SELECT *, sum(nc) OVER () AS n, count(*) OVER () AS k FROM c) "
    "SELECT l_returnflag || ':log_prior' AS term, round(ln(nc + 1) - ln(n + k), 9) AS value FROM t "
    "UNION ALL SELECT l_returnflag || ':q25:log_likelihood', round(ln(s1 + 1) - ln(nc + 2), 9) FROM t "
    "UNION ALL SELECT l_returnflag || ':d05:log_likelihood', round(ln(s2 + 1) - ln(nc + 2), 9) FROM t",
)
def model_summary(spark: SparkSession, sf: str) -> DataFrame:
    """Parameters of a naive Bayes model by label text and feature name."""
    spec = _spec("lineitem", "classification", "naive_bayes", "l_returnflag", ["q25", "d05"], LI_KEY)
    build, _ = ML.split(ML.prepare(_lineitem(spark, sf), spec), spec)
    terms = ML.summary(spark, ML.fit(build, spec), build.select(*spec.variables, "label"))
    return terms.select("term", F.round("value", 9).alias("value"))


# --- A6 / G16: CSV build source ----------------------------------------------


def _csv_events(spark: SparkSession, sf: str) -> str:
    """Events written as CSV with header, ``NA`` for missing values."""
    ev = table(spark, sf, "events")
    na = F.substring(F.md5(F.col("event_id").cast("string")), 1, 1) == "a"
    rows = ev.select("event_id", "user_id", "event_type", F.when(na, F.lit(None)).otherwise(F.col("value")).alias("value"))
    path = scratch_path(spark, "csv")
    rows.write.option("header", True).option("nullValue", "NA").csv(path)
    return path


def read_build_csv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, header=True, inferSchema=True, nullValue="NA")


@query(
    "csv_build_source",
    "A6",
    # CSV type inference reads these ids as 32-bit integers
    "SELECT CAST(event_id AS INTEGER) AS event_id, CAST(user_id AS INTEGER) AS user_id, event_type, "
    "CASE WHEN substr(md5(CAST(event_id AS VARCHAR)), 1, 1) = 'a' THEN NULL ELSE value END AS value FROM events",
)
def csv_build_source(spark: SparkSession, sf: str) -> DataFrame:
    return read_build_csv(spark, _csv_events(spark, sf))


_CSV_MODEL_SQL = (
    "WITH ev AS (SELECT event_id, event_type, CASE WHEN substr(md5(CAST(event_id AS VARCHAR)), 1, 1) = 'a' THEN NULL "
    f"ELSE value END AS value, {HASH_EV} AS u FROM events), "
    "m AS (SELECT event_type, avg(value) AS p FROM ev WHERE u < 0.5 AND value IS NOT NULL GROUP BY event_type) "
    "SELECT CAST(event_id AS INTEGER) AS event_id, ev.event_type, round(value, 4) AS label, round(p, 4) AS prediction FROM ev JOIN m "
    "ON ev.event_type = m.event_type WHERE u >= 0.5 AND value IS NOT NULL"
)


@query("csv_build_model", "G16 G2", _CSV_MODEL_SQL)
def csv_build_model(spark: SparkSession, sf: str) -> DataFrame:
    """A model built once from an uploaded CSV (no rebuild): tree on the
    categorical ``event_type`` predicts the build mean of each type."""
    data = read_build_csv(spark, _csv_events(spark, sf)).where(F.col("value").isNotNull())
    spec = _spec("events", "regression", "decision_tree", "value", ["event_type"], ["event_id"], rebuild_minutes=None)
    v = ML.build_model(data, spec).validation
    return v.select("event_id", "event_type", F.round("label", 4).alias("label"), F.round("prediction", 4).alias("prediction"))


# --- E: running RMSE and prediction series -----------------------------------

_EV_MODEL_CTE = (
    f"WITH ev AS (SELECT event_id, ts, event_type, value, {HASH_EV} AS u FROM events), "
    "m AS (SELECT event_type, avg(value) AS p FROM ev WHERE u < 0.5 GROUP BY event_type), "
    "pred AS (SELECT ev.event_id, ev.ts, ev.event_type, ev.value AS label, m.p AS prediction FROM ev "
    "JOIN m ON ev.event_type = m.event_type WHERE u >= 0.5) "
)


def events_model(spark: SparkSession, sf: str) -> ML.FittedModel:
    """The events regression model: tree on the topic's type -> value."""
    ev = table(spark, sf, "events").select("event_id", "ts", "event_type", "value")
    spec = _spec("events", "regression", "decision_tree", "value", ["event_type"], ["event_id"])
    return ML.build_model(ev, spec)


@query(
    "running_rmse",
    "E1",
    _EV_MODEL_CTE + "SELECT event_type AS topic, event_id, "
    "row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS seq, "
    "round(sqrt(sum((label - prediction) * (label - prediction)) OVER (PARTITION BY event_type ORDER BY ts, event_id "
    "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) / row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id)), 6) "
    "AS running_rmse FROM pred",
)
def running_rmse(spark: SparkSession, sf: str) -> DataFrame:
    scored = events_model(spark, sf).validation.withColumnRenamed("event_type", "topic")
    r = M.running_rmse(scored, ["ts", "event_id"], ["topic"])
    return r.select("topic", "event_id", F.col("seq").cast("bigint").alias("seq"), r6("running_rmse").alias("running_rmse"))


@query(
    "running_rmse_nulls",
    "E1",
    "WITH ev AS (SELECT event_id, ts, nullif(user_id % 3, 0) AS grp, user_id * 1.0 AS prediction, "
    "CASE WHEN substr(md5(CAST(event_id AS VARCHAR)), 1, 1) <> 'a' THEN value END AS label FROM events), "
    "r AS (SELECT event_id, grp, row_number() OVER w AS seq, sum((label - prediction) * (label - prediction)) OVER w AS sse, "
    "count(label) OVER w AS k FROM ev WINDOW w AS (PARTITION BY grp ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) "
    "SELECT event_id, grp, seq, CASE WHEN k > 0 THEN round(sqrt(sse / k), 6) END AS running_rmse FROM r",
)
def running_rmse_nulls(spark: SparkSession, sf: str) -> DataFrame:
    """Rows without a label do not count; a NULL numeric group is a group."""
    third = F.col("user_id") % 3
    scored = table(spark, sf, "events").select(
        "event_id",
        "ts",
        F.when(third != 0, third).alias("grp"),
        F.col("user_id").cast("double").alias("prediction"),
        F.when(F.substring(F.md5(F.col("event_id").cast("string")), 1, 1) != "a", F.col("value")).alias("label"),
    )
    r = M.running_rmse(scored, ["ts", "event_id"], ["grp"])
    return r.select("event_id", "grp", F.col("seq").cast("bigint").alias("seq"), r6("running_rmse").alias("running_rmse"))


@query(
    "prediction_series",
    "E2",
    _EV_MODEL_CTE + "SELECT event_type AS topic, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS seq, "
    "round(prediction, 6) AS prediction FROM pred",
)
def prediction_series(spark: SparkSession, sf: str) -> DataFrame:
    scored = events_model(spark, sf).validation.withColumnRenamed("event_type", "topic")
    s = series_by_time(scored, "prediction", ["ts", "event_id"], ["topic"], newest_first=False)
    return s.select("topic", "seq", r6("y").alias("prediction"))


@query(
    "cross_stream_score",
    "G15",
    f"WITH ev AS (SELECT event_id, event_type, CAST(user_id >= 75 AS DOUBLE) AS hi_user, value FROM events), "
    "m AS (SELECT hi_user, avg(value) AS p FROM ev WHERE event_type = 'click' GROUP BY hi_user) "
    "SELECT event_id, ev.hi_user, round(p, 4) AS prediction FROM ev JOIN m ON ev.hi_user = m.hi_user "
    "WHERE event_type = 'view'",
)
def cross_stream_score(spark: SparkSession, sf: str) -> DataFrame:
    """Built on one topic (click), scoring another (view)."""
    ev = table(spark, sf, "events").select(
        "event_id", "event_type", (F.col("user_id") >= 75).cast("double").alias("hi_user"), "value"
    )
    spec = ML.ModelSpec(
        "click", "regression", "decision_tree", "value", ("hi_user",), build_source="click", scoring_source="view"
    )
    build = ML.prepare(ev.where(F.col("event_type") == spec.build_source), spec)
    model = ML.fit(build, spec)
    scored = ML.predict(model, ev.where(F.col("event_type") == spec.scoring_source))
    return scored.select("event_id", "hi_user", F.round("prediction", 4).alias("prediction"))

