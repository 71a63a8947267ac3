"""Model evaluation as aggregates: RMSE, contingency table, accuracy, the
per-class statistics of a confusion matrix, and the running RMSE.

Everything reduces over the scored rows with partial aggregation; only the
K x K contingency cells (K = number of classes) are ever combined further.
Orientation: rows of the contingency table are the *actual* class, columns
the predicted one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .prefix import ordered_prefix


def _div(a: Column, b: Column) -> Column:
    return F.when(b != 0, a / b)


def rmse(df: DataFrame, label: str = "label", prediction: str = "prediction", by: list[str] | None = None) -> DataFrame:
    """Root mean squared error (per group when ``by`` is given)."""
    err2 = F.pow(F.col(label).cast("double") - F.col(prediction).cast("double"), 2)
    aggs = [F.sqrt(F.avg(err2)).alias("rmse"), F.count(err2).alias("n")]
    return df.groupBy(*by).agg(*aggs) if by else df.agg(*aggs)


def confusion_long(df: DataFrame, actual: str = "label", predicted: str = "prediction", weight: str | None = None) -> DataFrame:
    """Non-zero contingency cells ``(actual, predicted, n)``; ``weight`` names a column
    that says how many rows a row stands for."""
    n = F.count(F.lit(1)) if weight is None else F.sum(weight).cast("bigint")
    return df.groupBy(
        F.col(actual).cast("string").alias("actual"), F.col(predicted).cast("string").alias("predicted")
    ).agg(n.alias("n"))


OTHER = "(other)"


def confusion_matrix(
    df: DataFrame, classes: list[str], actual: str = "label", predicted: str = "prediction", other: str = OTHER
) -> DataFrame:
    """Square contingency table: one row per class (``actual``), one count
    column per class, zero-filled for pairs that never occur.

    ``classes`` are the model's (``models.class_labels``).  Rows whose class is
    NULL or not among them keep their own row and column ``other``, so the cells
    always sum to the number of scored rows.  One partial aggregation over the
    scored rows; nothing is collected."""
    if other in classes:
        raise ValueError(f"{other!r} is a class; name the rest otherwise")
    a = F.col(actual).cast("string")
    p = F.col(predicted).cast("string")
    row = F.when(a.isin(classes), a).otherwise(F.lit(other))
    cells = [F.count(F.when(p == c, 1)).alias(c) for c in classes]
    cells.append(F.count(F.when(F.coalesce(p.isin(classes), F.lit(False)), None).otherwise(1)).alias(other))
    counted = df.groupBy(row.alias("actual")).agg(*cells)
    every = df.sparkSession.createDataFrame([(c,) for c in [*classes, other]], "actual string")
    return every.join(counted, "actual", "left").na.fill(0, subset=[*classes, other])


def _per_class_counts(long: DataFrame) -> DataFrame:
    """Per class: rows actually in it, hits, rows predicted as it, and the
    grand total.  Each contingency cell contributes to its actual class and
    to its predicted class (one explode, so the scored rows are read once)."""
    hit = F.when(F.col("actual") == F.col("predicted"), F.col("n")).otherwise(F.lit(0).cast("bigint"))
    zero = F.lit(0).cast("bigint")
    sides = F.array(
        F.struct(F.col("actual").alias("class"), F.col("n").alias("actual_n"), hit.alias("tp"), zero.alias("pred_n")),
        F.struct(F.col("predicted").alias("class"), zero.alias("actual_n"), zero.alias("tp"), F.col("n").alias("pred_n")),
    )
    per = (
        long.select(F.explode(sides).alias("s"))
        .select("s.*")
        .groupBy("class")
        .agg(F.sum("actual_n").alias("actual_n"), F.sum("tp").alias("tp"), F.sum("pred_n").alias("pred_n"))
    )
    # K rows: the window over the whole (tiny) table gives the grand total.
    return per.withColumn("total", F.sum("actual_n").over(Window.partitionBy(F.lit(0))))


def class_metrics(df: DataFrame, actual: str = "label", predicted: str = "prediction") -> DataFrame:
    """Per class: tp, fp, fn, tn, sensitivity (recall), specificity,
    precision, F1, prevalence, detection rate, detection prevalence and
    balanced accuracy.  Undefined ratios (0/0) are NULL."""
    per = _per_class_counts(confusion_long(df, actual, predicted))
    tp, an, pn, tot = F.col("tp"), F.col("actual_n"), F.col("pred_n"), F.col("total")
    fp, fn = pn - tp, an - tp
    tn = tot - an - pn + tp
    sens = _div(tp.cast("double"), an.cast("double"))
    spec = _div(tn.cast("double"), (tot - an).cast("double"))
    prec = _div(tp.cast("double"), pn.cast("double"))
    return per.select(
        "class",
        tp.alias("tp"),
        fp.alias("fp"),
        fn.alias("fn"),
        tn.alias("tn"),
        sens.alias("sensitivity"),
        spec.alias("specificity"),
        prec.alias("precision"),
        _div(2 * prec * sens, prec + sens).alias("f1"),
        _div(an.cast("double"), tot.cast("double")).alias("prevalence"),
        _div(tp.cast("double"), tot.cast("double")).alias("detection_rate"),
        _div(pn.cast("double"), tot.cast("double")).alias("detection_prevalence"),
        ((sens + spec) / 2).alias("balanced_accuracy"),
    )


def overall_metrics(df: DataFrame, actual: str = "label", predicted: str = "prediction") -> DataFrame:
    """Accuracy, Cohen's kappa and the no-information rate, one row."""
    per = _per_class_counts(confusion_long(df, actual, predicted))
    agg = per.agg(
        F.sum("tp").alias("hits"),
        F.max("total").alias("n"),
        F.sum(F.col("actual_n").cast("double") * F.col("pred_n").cast("double")).alias("chance"),
        F.max("actual_n").alias("majority_n"),
    )
    po = F.col("hits") / F.col("n")
    pe = F.col("chance") / (F.col("n").cast("double") * F.col("n").cast("double"))
    return agg.select(
        po.alias("accuracy"),
        _div(po - pe, 1 - pe).alias("kappa"),
        (F.col("majority_n") / F.col("n")).alias("no_information_rate"),
        F.col("n").cast("bigint").alias("n"),
    )


def running_rmse(
    df: DataFrame,
    order_by: list[str],
    partition_by: list[str] | None = None,
    label: str = "label",
    prediction: str = "prediction",
    num_partitions: int | None = None,
    base: DataFrame | None = None,
) -> DataFrame:
    """RMSE over every row scored so far, one value per row, in
    ``order_by`` order (``seq`` 1 = oldest) inside each group; computed with
    the distributed ordered prefix (running count and sum of squared
    errors).  Rows without an error (a NULL label or prediction) do not count,
    as in ``rmse``.  ``base`` carries ``(group, n, sse, n_errors)`` of earlier
    rows."""
    err2 = F.pow(F.col(label).cast("double") - F.col(prediction).cast("double"), 2)
    ranked = ordered_prefix(
        df, list(order_by), partition_by, sums={"sse": err2, "n_errors": err2.isNotNull().cast("double")}, rank_col="seq", num_partitions=num_partitions, base=base
    )
    return ranked.withColumn("running_rmse", F.when(F.col("n_errors") > 0, F.sqrt(F.col("sse") / F.col("n_errors"))))
