"""Naive Bayes from counts that add up.

All that a Bernoulli naive Bayes model and its validation need of the rows is how often
each combination of variables and label occurs on each side of the split.  These
tallies are mergeable: those of two sets of rows, added, are the tallies of both.  So
a rebuild on all data adds the tallies of the new rows to those it has, and
neither keeps nor reads a row twice.  The variables are 0/1, so a tally has a
row per combination that occurs, not per message.

``fit_tally`` gives the model that the full fit gives, digit by digit, as a record (see
``model_data``): the log of (count + 1) over (total + 1 per class), and likewise per variable.
"""

from __future__ import annotations

import json
import math

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .models import SPLIT, ModelSpec, UnfitData

SMOOTHING = 1.0
N, BUILD = "_n", "_build"


def tally(rows: DataFrame, spec: ModelSpec, keep: tuple[str, ...] = ()) -> DataFrame:
    """``training_rows`` as ``(build side?, variables, label, n)``, variables as 0/1
    doubles; ``keep`` names columns to count apart by (a tick, say)."""
    for v in spec.variables:
        dtype = rows.schema[v].dataType
        if not isinstance(dtype, (T.BooleanType, T.NumericType)):
            raise ValueError(f"naive bayes needs 0/1 features; {v!r} is {dtype.simpleString()}")
    variables = [F.col(f"`{v}`").cast("double").alias(v) for v in spec.variables]
    cut = rows.select((F.col(SPLIT) < spec.ratio).alias(BUILD), *variables, F.col("label").cast("string").alias("label"), *keep)
    return cut.groupBy(*cut.columns).agg(F.count(F.lit(1)).alias(N))


def merge_tallies(*tallies: DataFrame) -> DataFrame:
    both = tallies[0]
    for t in tallies[1:]:
        both = both.unionByName(t)
    return both.groupBy(*[c for c in both.columns if c != N]).agg(F.sum(N).alias(N))


def _record(labels: list[tuple[str, float, list[float]]], spec: ModelSpec) -> str:
    """The record of a model from ``(label, rows, ones per variable)``."""
    # the string indexer's order: most frequent first, then by name
    labels = sorted(labels, key=lambda r: (-r[1], r[0].encode("utf-16-be")))
    total = math.log(sum(n for _, n, _ in labels) + len(labels) * SMOOTHING)
    return json.dumps({
        "variables": [{"name": v} for v in spec.variables], "invalid": spec.handle_invalid, "algorithm": "naive_bayes",
        "labels": [name for name, _, _ in labels],
        "pi": [math.log(n + SMOOTHING) - total for _, n, _ in labels],
        "theta": [[math.log(s + SMOOTHING) - math.log(n + 2.0 * SMOOTHING) for s in sums] for _, n, sums in labels],
    })


def _per_label(counts: DataFrame, spec: ModelSpec, *by: str) -> DataFrame:
    own = counts.where(F.col(BUILD) & F.col("label").isNotNull())
    sums = F.array(*[F.sum(F.col(f"`{v}`") * F.col(N)) for v in spec.variables])
    odd = F.lit(False)
    for v in spec.variables:
        odd = odd | ~F.coalesce(F.col(f"`{v}`").isin(0.0, 1.0), F.lit(False))
    return own.groupBy(*by, "label").agg(F.sum(N).cast("double").alias("n"), sums.alias("sums"), F.max(odd).alias("odd"))


def fit_tally(counts: DataFrame, spec: ModelSpec) -> str:
    """The record of the model of a tally's build side."""
    labels = _per_label(counts, spec).collect()  # a row a class
    if not labels:
        raise UnfitData("the build slice is empty")
    if any(r["odd"] for r in labels):
        raise UnfitData("naive bayes needs features that are 0/1 (binarise them first)")
    return _record([(r["label"], r["n"], r["sums"]) for r in labels], spec)


def fit_tallies(counts: DataFrame, spec: ModelSpec, version: str) -> DataFrame:
    """``version, record`` of the model of every version's tally (0/1 variables)."""

    def run(key: tuple, own: pd.DataFrame) -> pd.DataFrame:
        labels = list(zip(own["label"], own["n"], own["sums"], strict=True))
        return pd.DataFrame({"version": [key[0]], "record": [_record(labels, spec)]})

    return _per_label(counts, spec, version).groupBy(version).applyInPandas(run, "version long, record string")
