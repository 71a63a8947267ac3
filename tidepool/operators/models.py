"""Supervised models on topic history: definition, fit, score, evaluate.

A ``ModelSpec`` is what the "Add new predictive model" form collects.  Fitting
is ``pyspark.ml``: the formula ``label ~ <variables>`` (``RFormula``: one-hot
string features, numeric and boolean kept, string label indexed for
classification), one of five estimators, and for classification an
``IndexToString`` stage so predictions come back as label text.  The
build/validation split is the hash split (reproducible); metrics are
aggregates over the scored validation rows (see ``metrics``).
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import (
    DecisionTreeClassifier,
    LinearSVC,
    LogisticRegression,
    NaiveBayes,
    RandomForestClassifier,
)
from pyspark.ml.feature import IndexToString, RFormula
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import DecisionTreeRegressor, RandomForestRegressor
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.storagelevel import StorageLevel

from . import metrics as M
from .split import default_key, hash_fraction, hash_split

REGRESSION = "regression"
CLASSIFICATION = "classification"
ALGORITHMS = ("logit", "naive_bayes", "decision_tree", "random_forest", "linear_svm")
CLASSIFICATION_ONLY = {"logit", "naive_bayes", "linear_svm"}

FEATURES = "_features"
LABEL_IDX = "_label_idx"
PRED_IDX = "_prediction_idx"
SPLIT = "_split"
INTERNAL = [FEATURES, LABEL_IDX, PRED_IDX, "rawPrediction"]


@dataclass(frozen=True)
class ModelSpec:
    """One model definition: at most one model per (topic, kind, label,
    algorithm).  ``identity`` is that tuple, ``name`` its display text."""

    topic: str
    kind: str
    algorithm: str
    label: str
    variables: tuple[str, ...]
    ratio: float = 0.5
    split_key: tuple[str, ...] | None = None
    seed: int = 42  # of the trees
    rebuild_minutes: int | None = 10
    rebuild_mode: str = "all"
    build_source: str | None = None
    scoring_source: str | None = None
    handle_invalid: str = "error"
    params: tuple = field(default_factory=tuple)

    def __post_init__(self):
        if self.kind not in (REGRESSION, CLASSIFICATION):
            raise ValueError(f"model kind must be regression or classification, got {self.kind!r}")
        if self.algorithm not in ALGORITHMS:
            raise ValueError(f"unknown algorithm {self.algorithm!r}")
        if self.kind == REGRESSION and self.algorithm in CLASSIFICATION_ONLY:
            raise ValueError(f"{self.algorithm} is a classification algorithm; regression needs decision_tree or random_forest")
        if not self.variables:
            raise ValueError("choose at least one variable")
        if self.label in self.variables:
            raise ValueError(f"label {self.label!r} is also a variable")
        if not 0.0 < self.ratio < 1.0:
            raise ValueError("ratio must be strictly between 0 and 1")
        if self.rebuild_minutes is not None and not 1 <= self.rebuild_minutes <= 100:
            raise ValueError("rebuild interval must be 1..100 minutes")
        if self.rebuild_mode not in ("all", "new"):
            raise ValueError("rebuild mode is 'all' or 'new'")
        if self.handle_invalid not in ("error", "skip", "keep"):
            raise ValueError("handle_invalid is error, skip or keep")

    @property
    def name(self) -> str:
        return f"{self.topic}{self.kind}{self.label}{self.algorithm}"

    @property
    def identity(self) -> tuple[str, str, str, str]:
        return (self.topic, self.kind, self.label, self.algorithm)


class UnfitData(ValueError):
    """The rows at hand cannot build the model (other rows may)."""


def prepare(df: DataFrame, spec: ModelSpec) -> DataFrame:
    """Rename the target to ``label`` (all columns kept)."""
    missing = [c for c in (*spec.variables, spec.label) if c not in df.columns]
    if missing:
        raise ValueError(f"columns not in data: {missing}")
    if spec.label != "label" and "label" in df.columns:
        raise ValueError("data already has another column named 'label'")
    return df.withColumnRenamed(spec.label, "label")


def training_projection(df: DataFrame, spec: ModelSpec) -> DataFrame:
    """Variables and label only (what the formula ``label ~ .`` sees)."""
    return prepare(df, spec).select(*[F.col(f"`{v}`") for v in spec.variables], "label")


def estimator(spec: ModelSpec):
    params = dict(spec.params)
    common = {"featuresCol": FEATURES, "labelCol": LABEL_IDX}
    cls = spec.kind == CLASSIFICATION
    pred = PRED_IDX if cls else "prediction"
    a = spec.algorithm
    if a == "logit":
        est = LogisticRegression(maxIter=100, predictionCol=pred, **common)
    elif a == "naive_bayes":
        est = NaiveBayes(modelType="bernoulli", smoothing=1.0, predictionCol=pred, **common)
    elif a == "linear_svm":
        est = LinearSVC(maxIter=100, regParam=0.0, predictionCol=pred, **common)
    elif a == "decision_tree":
        kw = dict(maxDepth=5, maxBins=32, predictionCol=pred, seed=spec.seed, **common)
        est = DecisionTreeClassifier(impurity="gini", **kw) if cls else DecisionTreeRegressor(**kw)
    else:
        kw = dict(numTrees=20, maxDepth=5, maxBins=32, seed=spec.seed, predictionCol=pred, **common)
        est = RandomForestClassifier(**kw) if cls else RandomForestRegressor(**kw)
    if params:
        est.setParams(**params)
    return est


def _check_inputs(build: DataFrame, spec: ModelSpec) -> None:
    """Errors the estimators would raise late, raised up front with a clear
    message (one small aggregate over the build rows)."""
    checks = [F.count(F.lit(1)).alias("n")]
    if spec.algorithm == "naive_bayes":
        for v in spec.variables:
            dtype = build.schema[v].dataType
            if isinstance(dtype, T.BooleanType):
                continue
            if not isinstance(dtype, T.NumericType):
                raise ValueError(f"naive bayes needs 0/1 features; {v!r} is {dtype.simpleString()}")
            bad = F.col(f"`{v}`").isNotNull() & ~F.col(f"`{v}`").cast("double").isin(0.0, 1.0)
            checks.append(F.sum(bad.cast("int")).alias(f"bad_{len(checks)}"))
    if spec.algorithm == "linear_svm":
        # two distinct labels are min and max; a third lies strictly between
        checks += [F.min("label").cast("string").alias("lo"), F.max("label").cast("string").alias("hi")]
    text_vars = [v for v in spec.variables if isinstance(build.schema[v].dataType, T.StringType)]
    for i, v in enumerate(text_vars):
        checks.append(F.approx_count_distinct(F.col(f"`{v}`")).alias(f"levels_{i}"))
    row = build.agg(*checks).first()
    if row["n"] == 0:
        raise UnfitData("the build slice is empty")
    for k, v in row.asDict().items():
        if k.startswith("bad_") and v:
            raise UnfitData("naive bayes needs features that are 0/1 (binarise them first)")
    for i, v in enumerate(text_vars):
        if row[f"levels_{i}"] < 2:
            raise UnfitData(f"categorical variable {v!r} has fewer than two values in the build rows")
    if spec.algorithm == "linear_svm":
        between = build.where(~F.col("label").cast("string").isin(row["lo"], row["hi"])).limit(1).count()
        if row["lo"] == row["hi"] or between:
            raise UnfitData(f"linear SVM is binary; the label has {'more than two' if between else 'fewer than two'} classes")


def fit(build: DataFrame, spec: ModelSpec, kept: bool = False) -> PipelineModel:
    """Fit on prepared build rows (``label`` + variables).  Rows without a label
    (live leaves of the wrong type decode to NULL) have nothing to learn from
    and are left out.  The projection is kept (memory, then executors' disks)
    while the checks, the formula and the estimator's passes read it, unless the
    caller keeps the rows itself (``kept``)."""
    data = build.select(*[F.col(f"`{v}`") for v in spec.variables], "label").where(F.col("label").isNotNull())
    if not kept:
        data = data.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        _check_inputs(data, spec)
        cls = spec.kind == CLASSIFICATION
        formula = RFormula(
            formula="label ~ .",
            featuresCol=FEATURES,
            labelCol=LABEL_IDX,
            forceIndexLabel=cls,
            handleInvalid=spec.handle_invalid,
        )
        fitted = Pipeline(stages=[formula, estimator(spec)]).fit(data)
        if not cls:
            return fitted
        meta = fitted.stages[0].transform(data.limit(0)).schema[LABEL_IDX].metadata
        labels = list(meta["ml_attr"]["vals"])
        to_text = IndexToString(inputCol=PRED_IDX, outputCol="prediction", labels=labels)
        return PipelineModel(stages=[*fitted.stages, to_text])
    finally:
        if not kept:
            data.unpersist()


def class_labels(model: PipelineModel) -> list[str] | None:
    last = model.stages[-1]
    return list(last.getLabels()) if isinstance(last, IndexToString) else None


def predict(model: PipelineModel, df: DataFrame) -> DataFrame:
    """Score rows: all input columns plus ``prediction`` (label text for
    classification) and ``probability`` where the model has one."""
    out = model.transform(df)
    return out.drop(*[c for c in INTERNAL if c in out.columns])


def class_probability(scored: DataFrame, model: PipelineModel, cls: str, name: str = "p") -> DataFrame:
    """Probability of class ``cls`` from the probability vector."""
    labels = class_labels(model)
    if labels is None or cls not in labels:
        raise ValueError(f"class {cls!r} unknown to the model")
    return scored.withColumn(name, vector_to_array("probability")[labels.index(cls)])


@dataclass
class FittedModel:
    spec: ModelSpec
    model: PipelineModel
    validation: DataFrame
    build_rows: DataFrame


def split(df: DataFrame, spec: ModelSpec) -> tuple[DataFrame, DataFrame]:
    return hash_split(df, spec.ratio, list(spec.split_key) if spec.split_key else None)


def build_model(data: DataFrame, spec: ModelSpec) -> FittedModel:
    """Rename, split, fit on the build side, score the validation side."""
    prepared = prepare(data, spec)
    build, validation = split(prepared, spec)
    model = fit(build, spec)
    return FittedModel(spec, model, predict(model, validation), build)


def training_rows(data: DataFrame, spec: ModelSpec, keep: tuple[str, ...] = ()) -> DataFrame:
    """What building and judging a model need of every row: variables, ``label``
    and the split's hash fraction (``SPLIT``, taken from the whole row); ``keep`` names
    columns to carry along."""
    prepared = prepare(data, spec)
    u = hash_fraction(list(spec.split_key) if spec.split_key else default_key(prepared))
    return prepared.select(*[F.col(f"`{v}`") for v in spec.variables], "label", u.alias(SPLIT), *keep)


@dataclass
class Trained:
    model: PipelineModel
    n_rows: int
    n_unlabelled: int
    metric_name: str
    metric_value: float | None
    cells: list  # contingency cells (actual, predicted, n) of a classification


def train(rows: DataFrame, spec: ModelSpec) -> Trained | None:
    """Build and judge a model on ``training_rows``; None when there are none.
    The rows are read once and kept while they are counted, fitted and judged."""
    rows = rows.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        n, labelled = rows.agg(F.count(F.lit(1)), F.count("label")).first()
        if n == 0:
            return None
        model = fit(rows.where(F.col(SPLIT) < spec.ratio), spec, kept=True)
        scored = predict(model, rows.where(F.col(SPLIT) >= spec.ratio))
        if spec.kind == REGRESSION:
            return Trained(model, n, n - labelled, "rmse", M.rmse(scored).first()["rmse"], [])
        cells = [tuple(r) for r in M.confusion_long(scored).collect()]  # classes squared
        judged = sum(c for _, _, c in cells)
        hits = sum(c for a, p, c in cells if a is not None and a == p)
        return Trained(model, n, n - labelled, "accuracy", hits / judged if judged else None, cells)
    finally:
        rows.unpersist()


def evaluate(fitted: FittedModel) -> DataFrame:
    """RMSE for regression; accuracy, kappa, no-information rate for
    classification (one row)."""
    if fitted.spec.kind == REGRESSION:
        return M.rmse(fitted.validation)
    return M.overall_metrics(fitted.validation)


def summary(spark: SparkSession, model: PipelineModel, data: DataFrame | None = None) -> DataFrame:
    """Model parameters as rows ``(term, value)``: coefficients and
    intercepts, class priors/likelihoods (by label text), or tree sizes and
    feature importances."""
    formula_model = model.stages[0]
    est = model.stages[1]
    names = _feature_names(formula_model, data, est.numFeatures)
    rows: list[tuple[str, float]] = []
    kind = type(est).__name__
    labels = class_labels(model) or []
    if hasattr(est, "coefficientMatrix") and kind.startswith("LogisticRegression"):
        mat = est.coefficientMatrix.toArray()
        icpt = est.interceptVector.toArray()
        # a two-class model has one row, the log odds of its second label
        for k, cls in enumerate(labels if mat.shape[0] > 1 else labels[1:]):
            rows.append((f"{cls}:(Intercept)", float(icpt[k])))
            for j, n in enumerate(names):
                rows.append((f"{cls}:{n}", float(mat[k, j])))
    elif hasattr(est, "coefficients") and hasattr(est, "intercept"):
        rows.append(("(Intercept)", float(est.intercept)))
        rows.extend((n, float(v)) for n, v in zip(names, est.coefficients.toArray()))
    elif hasattr(est, "pi") and hasattr(est, "theta"):
        pi = est.pi.toArray()
        theta = est.theta.toArray()
        for k, cls in enumerate(labels):
            rows.append((f"{cls}:log_prior", float(pi[k])))
            for j, n in enumerate(names):
                rows.append((f"{cls}:{n}:log_likelihood", float(theta[k, j])))
    if hasattr(est, "featureImportances"):
        rows.extend((f"importance:{n}", float(v)) for n, v in zip(names, est.featureImportances.toArray()))
    if hasattr(est, "numNodes"):
        rows.append(("num_nodes", float(est.numNodes)))
        rows.append(("depth", float(est.depth)))
    if hasattr(est, "getNumTrees"):
        rows.append(("num_trees", float(est.getNumTrees)))
    return spark.createDataFrame(rows, "term string, value double")


def _feature_names(formula_model, data: DataFrame | None, n: int) -> list[str]:
    if data is not None:
        meta = formula_model.transform(data.limit(0)).schema[FEATURES].metadata
        attrs = meta.get("ml_attr", {}).get("attrs", {})
        named = sorted((a["idx"], a["name"]) for group in attrs.values() for a in group)
        if len(named) == n:
            return [name for _, name in named]
    return [f"f{i}" for i in range(n)]


def save(model: PipelineModel, path: str) -> str:
    model.write().overwrite().save(path)
    return path


def load(path: str) -> PipelineModel:
    return PipelineModel.load(path)
