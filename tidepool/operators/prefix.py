"""Ordered prefix operator: row number and running sums over a global order.

``row_number() OVER (PARTITION BY k ORDER BY o)`` and running sums are what
the dashboard's "Time" axis and running RMSE need.  Spark's window operator
puts every row of one ``k`` (or, without ``k``, of the whole frame) into one
task.  A topic may hold a third of all messages, so instead:

1. range-partition by ``(k, o)`` into ``n`` balanced partitions (Spark
   samples the key; the partition index is monotone in the key) and sort
   inside each partition;
2. the rows are written once, with their range partition's number, to the shared
   scratch folder (a lineage cut: the sampled range bounds are fixed once, and a
   lost executor re-reads files instead of re-sampling); windows over (partition,
   ``k``) give the *local* rank and running sums, so no window holds more than
   one range partition, NULL groups are groups and no value leaves the JVM;
3. per (partition, k) totals -- at most ``n + #k`` rows -- are prefix-summed
   with a small window and enter the rows' window as one leading row per
   (partition, k) that brings the count and sums of all earlier partitions, so
   nothing is joined or broadcast.

The result equals the global window (up to floating summation order) and no
task holds more than one range partition.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import scratch_path

_B = "_pfx_part"
_N = "_pfx_n"


def ordered_prefix(
    df: DataFrame,
    order_by: list[str],
    partition_by: list[str] | None = None,
    sums: Mapping[str, Column | str] | None = None,
    rank_col: str = "seq",
    descending: bool = False,
    num_partitions: int | None = None,
    base: DataFrame | None = None,
    staging: str | None = None,
) -> DataFrame:
    """Add ``rank_col`` (1-based row number) and one running sum per entry of
    ``sums`` (output name -> value column), in ``order_by`` order inside each
    ``partition_by`` group.  The order must be total (end it with a unique id).

    ``descending=True`` numbers newest-first (largest key gets 1) and sums
    from the end.  ``base`` is an optional frame ``(*partition_by, n, <sum
    names>...)`` of counts/sums that precede this frame (a stream's earlier
    micro-batches); it shifts ranks and sums.  ``staging`` names the folder for the
    range-partitioned rows (overwritten; by default a new scratch folder).  Sums of
    integer columns stay integers, others are doubles; NULL values add nothing.
    """
    spark = df.sparkSession
    part = list(partition_by or [])
    sums = dict(sums or {})
    n = num_partitions

    src = df
    if not part:
        # one global order: a constant group key keeps a single code path
        part = ["_pfx_all"]
        src = src.withColumn("_pfx_all", F.lit(0))
        if base is not None:
            base = base.withColumn("_pfx_all", F.lit(0))
    for name, expr in sums.items():
        src = src.withColumn(f"_pfx_v_{name}", F.col(expr) if isinstance(expr, str) else expr)
    value_cols = [f"_pfx_v_{name}" for name in sums]
    keys = part + list(order_by)
    # Without an explicit count the range shuffle uses the session's
    # partition count and AQE may merge small neighbouring partitions --
    # merging neighbours keeps partition order monotone in the key.
    ranged = (src.repartitionByRange(n, *keys) if n else src.repartitionByRange(*keys)).sortWithinPartitions(*keys)

    # Lineage cut: the range partitions are written once to the shared folder.
    path = staging or scratch_path(spark, "prefix")
    ranged = ranged.withColumn(_B, F.spark_partition_id())
    ranged.write.mode("overwrite").parquet(path)
    staged = spark.read.schema(ranged.schema).parquet(path)

    def total(c: str) -> str:
        return "bigint" if isinstance(ranged.schema[c].dataType, T.IntegralType) else "double"

    values = [F.coalesce(F.col(c).cast(total(c)), F.lit(0).cast(total(c))).alias(c) for c in value_cols]
    stats = staged.groupBy(_B, *part).agg(
        F.count(F.lit(1)).alias(_N), *[F.coalesce(F.sum(F.col(c).cast(total(c))), F.lit(0).cast(total(c))).alias(c) for c in value_cols]
    )
    earlier = Window.partitionBy(*part).orderBy(_B).rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy(*part)
    sizes = [_N, *value_cols]
    if base is not None:
        # earlier micro-batches count as a partition before the first
        stats = stats.unionByName(
            base.select(
                F.lit(-1).alias(_B), *part, F.col("n").cast("bigint").alias(_N),
                *[F.col(name).cast(total(c)).alias(c) for name, c in zip(sums, value_cols)],
            )
        )
    leading = stats.select(
        _B,
        *part,
        *[F.coalesce(F.sum(c).over(earlier), F.lit(0)).cast(stats.schema[c].dataType).alias(c) for c in sizes],
        *[F.sum(c).over(everything).alias(f"_pfx_tot_{c}") for c in sizes],
        F.lit(0).alias("_pfx_row"),
    ).where(F.col(_B) >= 0)
    rest = [c for c in staged.columns if c not in value_cols]
    rows = staged.select(
        *[F.col(f"`{c}`") for c in rest], *values,
        F.lit(1).cast("bigint").alias(_N), F.lit(1).alias("_pfx_row"),
    ).unionByName(leading, allowMissingColumns=True)
    inside = Window.partitionBy(_B, *part).orderBy("_pfx_row", *order_by).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    numbered = rows.withColumns(
        {
            **{f"_pfx_run_{c}": F.sum(c).over(inside) for c in sizes},
            **{f"_pfx_end_{c}": F.first(f"_pfx_tot_{c}").over(inside) for c in (sizes if descending else [])},
        }
    ).where(F.col("_pfx_row") == 1)

    cols = [F.col(f"`{c}`") for c in df.columns]
    for name, c in zip([rank_col, *sums], sizes):
        running = F.col(f"_pfx_run_{c}")
        cols.append((F.col(f"_pfx_end_{c}") - running + F.col(c) if descending else running).alias(name))
    return numbered.select(*cols)
