"""Row set operations on histories."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def union_by_name(*frames: DataFrame) -> DataFrame:
    """Rows of all frames, matched by column name; a column missing from a
    frame is NULL there."""
    if not frames:
        raise ValueError("nothing to union")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def new_rows(history: DataFrame, previous: DataFrame, bag: bool = False) -> DataFrame:
    """History rows not in a previous build ("only new data").

    ``bag=False`` is EXCEPT DISTINCT (duplicates collapse, NULLs match);
    ``bag=True`` is EXCEPT ALL (a row present twice in history and once in
    the build is kept once).  Both shuffle both sides on all columns; for a
    growing history prefer ``new_rows_since``.
    """
    return history.exceptAll(previous) if bag else history.subtract(previous)


def fingerprints(rows: DataFrame, bucket: Column, bag: bool) -> DataFrame:
    """Per bucket a fingerprint of its rows that does not depend on their order: how many
    there are and the sums and the exclusive or of two 64-bit hashes.  ``bag=False`` takes
    each distinct row once (a distinct pass before)."""
    columns = [F.col(f"`{c}`") for c in rows.columns]
    own = rows if bag else rows.distinct()
    one, other = F.xxhash64(*columns), F.xxhash64(F.lit("second"), *columns)
    marked = own.select(bucket.alias("_bucket"), one.alias("_h1"), other.alias("_h2"))
    wide = lambda c: F.sum(F.col(c).cast("decimal(20,0)"))
    return marked.groupBy("_bucket").agg(F.count(F.lit(1)).alias("_n"), wide("_h1").alias("_s1"), wide("_h2").alias("_s2"), F.bit_xor("_h1").alias("_x"))


def new_rows_by_range(history: DataFrame, previous: DataFrame, key: str, width: float, bag: bool = False) -> DataFrame:
    """The same rows as ``new_rows`` where most of the two sides is equal: both sides are
    cut into ranges of ``key`` (``width`` units: numbers, or seconds of a timestamp),
    fingerprinted, and only rows of ranges whose fingerprints differ are shuffled and
    compared.  One extra reading of both sides saves their shuffle.

    Fingerprints are reduced in every input partition (a row per range is shuffled).  Two
    different ranges look equal only if their row counts and 192 bits of hash sums agree.
    Hashing a whole row, a column of a type that Spark does not hash (maps) raises."""
    if history.columns != previous.columns:
        previous = previous.toDF(*history.columns)
    kind = history.schema[key].dataType

    def bucket(df: DataFrame) -> Column:
        c = df[f"`{key}`"]
        at = F.unix_micros(c.cast("timestamp")) / 1e6 if "timestamp" in kind.typeName() or kind.typeName() == "date" else c.cast("double")
        return F.floor(at / F.lit(float(width)))

    old = fingerprints(previous, bucket(previous), bag).toDF("_bucket", "_n0", "_s10", "_s20", "_x0")
    new = fingerprints(history, bucket(history), bag)
    pairs = new.join(old.withColumnRenamed("_bucket", "_old"), F.col("_bucket").eqNullSafe(F.col("_old")), "left")
    same = (F.col("_n") == F.col("_n0")) & (F.col("_s1") == F.col("_s10")) & (F.col("_s2") == F.col("_s20")) & (F.col("_x") == F.col("_x0"))
    differ = pairs.where(~F.coalesce(same, F.lit(False))).select("_bucket")

    def touched(df: DataFrame) -> DataFrame:
        marked = df.withColumn("_range", bucket(df))
        return marked.join(differ, F.col("_range").eqNullSafe(F.col("_bucket")), "left_semi").drop("_range")

    return new_rows(touched(history), touched(previous), bag)


def new_rows_since(history: DataFrame, col: str, after, until=None) -> DataFrame:
    """The scalable "only new data": a range predicate on an ordered column
    (offset or event time), ``after < col <= until``.  Pushed into the
    Parquet scan, so only new row groups are read."""
    cond = F.col(col) > F.lit(after)
    if until is not None:
        cond = cond & (F.col(col) <= F.lit(until))
    return history.where(cond)
