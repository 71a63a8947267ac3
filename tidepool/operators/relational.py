"""Table operations used by the user profile store, as general operators:
natural join, equality filter, conditional column update, and a versioned
table store (create if absent / append / overwrite / read)."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def natural_join(left: DataFrame, right: DataFrame, how: str = "inner") -> DataFrame:
    """Join on every column name the two frames share (sorted).  No shared
    name is an error, never a cross product.  The join strategy is left to
    Spark: with AQE a side whose *measured* shuffle size is under the
    broadcast threshold becomes a broadcast, otherwise sort-merge."""
    shared = sorted(set(left.columns) & set(right.columns))
    if not shared:
        raise ValueError("natural join: the frames share no column")
    return left.join(right, shared, how)


def where_eq(df: DataFrame, col: str, value) -> DataFrame:
    """Rows whose ``col`` equals ``value`` (pushed to the scan)."""
    return df.where(F.col(col) == F.lit(value))


def conditional_update(df: DataFrame, col: str, cond: Column, value) -> DataFrame:
    """``col`` set to ``value`` where ``cond`` holds, unchanged elsewhere."""
    v = value if isinstance(value, Column) else F.lit(value)
    return df.withColumn(col, F.when(cond, v.cast(df.schema[col].dataType)).otherwise(F.col(col)))


class TableStore:
    """Named tables in the Spark catalog, stored as external Parquet tables
    under one root (the shared folder on a cluster).

    ``exists`` / ``create_if_absent`` / ``append`` / ``read`` are the
    catalog's ``tableExists``, ``saveAsTable`` and ``spark.table``.
    ``overwrite`` never writes into the folder being read: it writes the new
    contents to a fresh folder, then points the table at it with ``ALTER
    TABLE ... SET LOCATION`` (one catalog update), so the new contents may
    be computed from the table itself.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root.rstrip("/")

    def _fresh_path(self, name: str) -> str:
        return f"{self.root}/{name}/{uuid.uuid4().hex[:12]}"

    def exists(self, name: str) -> bool:
        return self.spark.catalog.tableExists(name)

    def create_if_absent(self, name: str, df: DataFrame) -> bool:
        """Create the table holding ``df`` unless it exists."""
        if self.exists(name):
            return False
        df.write.format("parquet").option("path", self._fresh_path(name)).saveAsTable(name)
        return True

    def append(self, name: str, df: DataFrame) -> None:
        if not self.create_if_absent(name, df):
            df.write.format("parquet").mode("append").saveAsTable(name)

    def overwrite(self, name: str, df: DataFrame) -> str:
        """Replace the contents with ``df`` (which may read the table)."""
        if not self.exists(name):
            self.create_if_absent(name, df)
            return name
        path = self._fresh_path(name)
        df.write.parquet(path)
        self.spark.sql(f"ALTER TABLE {name} SET LOCATION '{path}'")
        self.spark.catalog.refreshTable(name)
        return path

    def read(self, name: str) -> DataFrame:
        if not self.exists(name):
            raise LookupError(f"table {name!r} does not exist")
        return self.spark.table(name)
