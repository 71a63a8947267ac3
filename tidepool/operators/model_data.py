"""Models as data: a fitted model as one record, and one evaluator for many of them.

``export`` writes down what a fitted pipeline computes -- how each variable becomes
feature columns, and the coefficients, class likelihoods or tree nodes -- as JSON text.
``score_versions`` scores rows that carry a model version with that version's record:
one plan however many versions there are.  Rows are grouped by (version, part), a part
being a bounded slice of the rows, and meet a copy of their version's record (a cogroup,
so neither rows nor records pass through the driver or are broadcast); inside
a group numpy scores all rows at once.

The evaluator follows the fitted pipeline: levels by the string indexer's order with
the last one as reference, the same treatment of unknown levels and missing numbers
(``error`` raises, ``skip`` drops the row, ``keep`` scores it), thresholds on the
left including equality, ties to the class with the lower index.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml import PipelineModel
from pyspark.ml.feature import IndexToString
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Version that stands for "no model" while rows are grouped.
NONE = -1


# --- export --------------------------------------------------------------------------------------


def _variables(formula) -> list[dict]:
    """The feature columns of an R formula, variable by variable: levels (in index order)
    and width of a categorical one, neither of a number."""
    levels, encoded, order = {}, {}, []
    for stage in formula._java_obj.pipelineModel().stages():
        kind = stage.getClass().getSimpleName()
        if kind == "StringIndexerModel":
            names = list(stage.getInputCols()) if stage.isSet(stage.getParam("inputCols")) else [stage.getInputCol()]
            outs = list(stage.getOutputCols()) if stage.isSet(stage.getParam("outputCols")) else [stage.getOutputCol()]
            for name, out, own in zip(names, outs, stage.labelsArray(), strict=True):
                levels[out] = (name, list(own))
        elif kind == "OneHotEncoderModel":
            for name, out, size in zip(list(stage.getInputCols()), list(stage.getOutputCols()), list(stage.categorySizes()), strict=True):
                encoded[out] = (*levels[name], size - (1 if stage.getDropLast() else 0))
        elif kind == "VectorAssembler":
            order = list(stage.getInputCols())
    return [{"name": encoded[c][0], "levels": encoded[c][1], "width": encoded[c][2]} if c in encoded else {"name": c} for c in order]


def _trees(spark: SparkSession, path: str, uid: str, several: bool) -> list[dict]:
    """Node tables of a saved tree or forest (a few thousand nodes a model)."""
    nodes = spark.read.parquet(f"{path}/stages/1_{uid}/data")
    if several:
        nodes = nodes.select("treeID", "nodeData.*")
    else:
        nodes = nodes.withColumn("treeID", F.lit(0))
    trees: dict[int, list] = {}
    for n in nodes.select("treeID", "id", "prediction", "impurityStats", "leftChild", "rightChild", "split").orderBy("treeID", "id").collect():
        trees.setdefault(n["treeID"], []).append(n)
    out = []
    for own in trees.values():
        at = {n["id"]: k for k, n in enumerate(own)}
        inner = [n["leftChild"] >= 0 for n in own]
        out.append({
            "feature": [n["split"]["featureIndex"] if i else 0 for n, i in zip(own, inner)],
            "threshold": [n["split"]["leftCategoriesOrThreshold"][0] if i and n["split"]["numCategories"] < 0 else None for n, i in zip(own, inner)],
            "left_of": [list(n["split"]["leftCategoriesOrThreshold"]) if i and n["split"]["numCategories"] >= 0 else None for n, i in zip(own, inner)],
            "left": [at[n["leftChild"]] if i else k for k, (n, i) in enumerate(zip(own, inner))],
            "right": [at[n["rightChild"]] if i else k for k, (n, i) in enumerate(zip(own, inner))],
            "prediction": [n["prediction"] for n in own],
            "stats": [list(n["impurityStats"]) for n in own],
        })
    return out


def export(spark: SparkSession, model: PipelineModel, path: str) -> str:
    """The record of a fitted pipeline that is saved under ``path``."""
    formula, est = model.stages[0], model.stages[1]
    kind = type(est).__name__.removesuffix("Model").removesuffix("ification").removesuffix("ression")
    record: dict = {
        "variables": _variables(formula),
        "invalid": formula.getHandleInvalid() if hasattr(formula, "getHandleInvalid") else formula.getOrDefault("handleInvalid"),
        "labels": list(model.stages[-1].getLabels()) if isinstance(model.stages[-1], IndexToString) else None,
    }
    name = type(est).__name__
    if name == "LogisticRegressionModel":
        record |= {"algorithm": "logit", "matrix": est.coefficientMatrix.toArray().tolist(), "intercept": est.interceptVector.toArray().tolist(),
                   "threshold": est.getThreshold() if est.numClasses <= 2 else None}
    elif name == "LinearSVCModel":
        record |= {"algorithm": "svm", "matrix": [est.coefficients.toArray().tolist()], "intercept": [est.intercept], "threshold": est.getThreshold()}
    elif name == "NaiveBayesModel":
        record |= {"algorithm": "naive_bayes", "pi": est.pi.toArray().tolist(), "theta": est.theta.toArray().tolist()}
    elif name.startswith(("DecisionTree", "RandomForest")):
        record |= {"algorithm": "trees", "trees": _trees(spark, path, est.uid, name.startswith("RandomForest"))}
    else:
        raise ValueError(f"no record for a {kind}")
    return json.dumps(record)


# --- evaluate ------------------------------------------------------------------------------------


class UnseenValue(ValueError):
    """A value that the model's variables do not know, under ``handle_invalid="error"``."""


def _matrix(record: dict, columns: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Feature matrix and which rows are scored at all."""
    blocks, scored = [], None
    for v in record["variables"]:
        values = columns[v["name"]]
        if "levels" in v:
            index = {level: k for k, level in enumerate(v["levels"])}
            code = np.array([index.get(x, -1) for x in values], dtype=np.int64)
            bad = code < 0
            block = np.zeros((len(code), v["width"]))
            hit = np.flatnonzero(~bad & (code < v["width"]))
            block[hit, code[hit]] = 1.0
        else:
            block = values.astype(np.float64)[:, None]
            bad = np.isnan(block[:, 0])
        if record["invalid"] == "error" and bad.any():
            raise UnseenValue(f"variable {v['name']!r} holds {values[np.flatnonzero(bad)[0]]!r}, which its model does not know")
        scored = ~bad if scored is None else scored & ~bad
        blocks.append(block)
    if record["invalid"] != "skip":
        scored = np.ones(len(scored), dtype=bool)
    return np.concatenate(blocks, axis=1), scored


def _leaves(tree: dict, x: np.ndarray) -> np.ndarray:
    feature, left, right = (np.array(tree[k], dtype=np.int64) for k in ("feature", "left", "right"))
    threshold = np.array([np.nan if t is None else t for t in tree["threshold"]])
    subsets = [None if s is None else np.array(s) for s in tree["left_of"]]
    at = np.zeros(len(x), dtype=np.int64)
    rows = np.arange(len(x))
    while True:
        value = x[rows, feature[at]]
        goes_left = value <= threshold[at]
        for node in {int(n) for n in np.unique(at) if subsets[n] is not None}:
            here = at == node
            goes_left[here] = np.isin(value[here], subsets[node])
        after = np.where(goes_left, left[at], right[at])
        if (after == at).all():
            return at
        at = after


def scores(record: dict, columns: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Prediction (label text of a classification) of every row, and which rows are scored."""
    x, scored = _matrix(record, columns)
    kind, labels = record["algorithm"], record["labels"]
    if kind in ("logit", "svm"):
        margin = x @ np.array(record["matrix"]).T + np.array(record["intercept"])
        if margin.shape[1] > 1:
            best = margin.argmax(1)
        elif kind == "svm":
            best = (margin[:, 0] > record["threshold"]).astype(np.int64)
        else:
            with np.errstate(over="ignore"):
                best = (1.0 / (1.0 + np.exp(-margin[:, 0])) > record["threshold"]).astype(np.int64)
    elif kind == "naive_bayes":
        theta, pi = np.array(record["theta"]), np.array(record["pi"])
        absent = np.log(1.0 - np.exp(theta))
        best = (x @ (theta - absent).T + (pi + absent.sum(1))).argmax(1)
    else:
        total = 0.0
        for tree in record["trees"]:
            at = _leaves(tree, x)
            if labels is None:
                total = total + np.array(tree["prediction"])[at]
            else:
                stats = np.array(tree["stats"])[at]
                total = total + (stats / np.maximum(stats.sum(1, keepdims=True), 1e-300) if len(record["trees"]) > 1 else stats)
        if labels is None:
            return total / len(record["trees"]), scored
        best = total.argmax(1)
    return np.array(labels, dtype=object)[best], scored


def _column(values: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """A column as an object array of text, or as doubles with NaN for NULL."""
    if pa.types.is_string(values.type) or pa.types.is_large_string(values.type):
        return np.array(values.to_pylist(), dtype=object)
    if pa.types.is_decimal(values.type) or pa.types.is_boolean(values.type):
        return np.array([np.nan if v is None else float(v) for v in values.to_pylist()])
    return values.cast(pa.float64(), safe=False).to_numpy(zero_copy_only=False) if isinstance(values, pa.Array) else values.cast(pa.float64(), safe=False).to_numpy()


def score_versions(rows: DataFrame, records: DataFrame, version: str, part: str, prediction: str, as_text: bool) -> DataFrame:
    """``rows`` (with a ``version`` and a ``part`` column, which are dropped) plus
    ``prediction``; NULL for rows whose version (or whose version's record) there is not.
    ``records`` has ``version, record``."""
    keep = [c for c in rows.columns if c not in (version, part)]
    out_type = T.StringType() if as_text else T.DoubleType()
    schema = T.StructType([*[rows.schema[c] for c in keep], T.StructField(version, T.LongType()), T.StructField(prediction, out_type)])
    grouped = rows.withColumn(version, F.coalesce(F.col(version).cast("long"), F.lit(NONE).cast("long")))
    pairs = grouped.select(F.col(version).alias("_v"), F.col(part).alias("_p")).distinct()
    needed = pairs.join(records.select(F.col("version").alias("_v"), "record"), "_v")

    def run(own: pa.Table, model: pa.Table) -> pa.Table:
        found = own.select([*keep, version])
        if own.num_rows and model.num_rows:
            record = json.loads(model.column("record")[0].as_py())
            names = {v["name"] for v in record["variables"]}
            value, scored = scores(record, {n: _column(own.column(n)) for n in names})
            return found.append_column(prediction, pa.array(value.tolist(), made)).filter(pa.array(scored))
        return found.append_column(prediction, pa.nulls(own.num_rows, made))

    made = pa.string() if as_text else pa.float64()
    scored = grouped.groupBy(version, part).cogroup(needed.groupBy("_v", "_p")).applyInArrow(run, schema)
    return scored.withColumn(version, F.when(F.col(version) != NONE, F.col(version)))


def score_rows(rows: DataFrame, record: str, prediction: str, as_text: bool) -> DataFrame:
    """``rows`` plus ``prediction`` by one record (a micro-batch, say), without a shuffle."""
    schema = T.StructType([*rows.schema.fields, T.StructField(prediction, T.StringType() if as_text else T.DoubleType())])
    made = pa.string() if as_text else pa.float64()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = json.loads(record)
        names = {v["name"] for v in model["variables"]}
        for batch in batches:
            value, scored = scores(model, {n: _column(batch.column(n)) for n in names})
            table = pa.Table.from_batches([batch]).append_column(prediction, pa.array(value.tolist(), made))
            yield from table.filter(pa.array(scored)).to_batches()

    return rows.mapInArrow(run, schema)
