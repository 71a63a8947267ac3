"""As-of join: each left row with the newest right row at or before it.

Spark has no as-of join, and a window over the union of both sides would
sort every row of one key in one task.  Instead the carry of the ordered
prefix is used (see ``prefix``):

1. both sides are range-partitioned together by ``(key, time, side)``, so a key
   that holds a third of all rows spans many range partitions, and written once
   to the shared scratch folder;
2. per (range partition, key) the newest right row is found, and the newest one
   of all *earlier* range partitions is carried in -- at most range partitions +
   keys rows, added to the staged rows as one more row per (partition, key);
3. a window over (range partition, key) fills the last right row forward, so no
   window holds more than one range partition and nothing is broadcast.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import scratch_path

_B, _K, _T, _SIDE, _P, _L, _H, _O = (f"_asof_{c}" for c in ("part", "keys", "time", "side", "right", "left", "spread", "order"))


def _spread(df: DataFrame):
    """A hash of the row: left rows at one moment are ordered by it, so that they can be cut apart."""
    plain = [f.name for f in df.schema.fields if "map<" not in f.dataType.simpleString() and f.dataType.typeName() != "variant"]
    return F.xxhash64(*[F.col(f"`{c}`") for c in plain])


def asof_join(left: DataFrame, right: DataFrame, on: list[str], left_ts: str, right_ts: str) -> DataFrame:
    """Left join: every left row, plus the right columns of the newest right
    row with the same ``on`` keys and ``right_ts <= left_ts`` (NULL when
    there is none; a NULL key or time matches nothing).  Among right rows of one
    key and time the one whose columns compare greatest, in their order, wins (as JSON
    text where a column is of a type without an order, such as a map).
    Right columns other than the keys must not clash with left column names."""
    payload = [c for c in right.columns if c not in on]
    clash = set(payload) & set(left.columns)
    if clash:
        raise ValueError(f"right columns clash with left columns: {sorted(clash)}")
    spark = left.sparkSession

    def key(df: DataFrame):
        return F.struct(*[df[f"`{c}`"].cast(left.schema[c].dataType).alias(c) for c in on])

    def moment(df: DataFrame, c: str):
        return df[f"`{c}`"].cast("timestamp")

    r_row = F.struct(*[right[f"`{c}`"] for c in payload])
    l_row = F.struct(*[left[f"`{c}`"] for c in left.columns])
    ordered = not any("map<" in right.schema[c].dataType.simpleString() or right.schema[c].dataType.typeName() == "variant" for c in payload)
    rank = _P if ordered else _O
    usable = moment(right, right_ts).isNotNull()
    for c in on:
        usable = usable & right[f"`{c}`"].isNotNull()
    # right rows sort before left rows of the same moment
    rights = right.where(usable).select(
        key(right).alias(_K), moment(right, right_ts).alias(_T), F.lit(0).alias(_SIDE), r_row.alias(_P),
        F.lit(0).cast("bigint").alias(_H), *([] if ordered else [F.to_json(r_row).alias(_O)]),
    )
    lefts = left.select(
        key(left).alias(_K), moment(left, left_ts).alias(_T), F.lit(1).alias(_SIDE), l_row.alias(_L), _spread(left).alias(_H),
    )
    both = lefts.unionByName(rights, allowMissingColumns=True)

    # Lineage cut: range bounds are sampled once, lost executors re-read files.
    order = [_T, _SIDE, rank, _H]
    staged_path = scratch_path(spark, "asof")
    ranged = both.repartitionByRange(_K, *order).sortWithinPartitions(_K, *order).withColumn(_B, F.spark_partition_id())
    ranged.write.parquet(staged_path)
    staged = spark.read.schema(T.StructType([T.StructField(f.name, f.dataType, True) for f in ranged.schema.fields])).parquet(staged_path)

    newest = staged.groupBy(_B, _K).agg(F.max_by(_P, F.when(F.col(_SIDE) == 0, F.struct(_T, rank))).alias(_P))
    earlier = Window.partitionBy(_K).orderBy(_B).rowsBetween(Window.unboundedPreceding, -1)
    carried = newest.select(
        _B, _K, F.lit(None).cast("timestamp").alias(_T), F.lit(-1).alias(_SIDE), F.last(_P, ignorenulls=True).over(earlier).alias(_P)
    )
    # the carried row leads its (partition, key), whatever NULL times follow
    rows = staged.unionByName(carried, allowMissingColumns=True).withColumn("_asof_lead", F.col(_SIDE) >= 0)
    filled = Window.partitionBy(_B, _K).orderBy("_asof_lead", *order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last = F.last(_P, ignorenulls=True).over(filled)
    found = rows.withColumn("_asof_found", last).where(F.col(_SIDE) == 1)
    at = F.when(F.col(_T).isNotNull(), F.col("_asof_found"))
    return found.select(
        *[F.col(_L).getField(c).alias(c) for c in left.columns], *[at.getField(c).alias(c) for c in payload]
    )
