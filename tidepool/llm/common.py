"""Small helpers the training-data operators share."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepool.session import scratch_path

#: White space of the word contracts: blank and tab to carriage return.
WS = " \t\n\x0b\f\r"
#: Columns of the documents table.
DOCUMENT_COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


@dataclass(frozen=True)
class LlmQuery:
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None = None


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, kind: str, compression: str | None = None) -> DataFrame:
    """``df`` as a table in the shared scratch folder, read again: the lineage
    is cut and nothing is computed twice, and the files outlive any executor."""
    spark = df.sparkSession
    path = scratch_path(spark, kind)
    df.write.parquet(path, compression=compression)
    return spark.read.schema(df.schema).parquet(path)


def id_remainder(column: str, divisor: int) -> Column:
    """crc32 of the id as text, modulo ``divisor``; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % divisor


def fresh_names(taken: list[str], *wanted: str) -> list[str]:
    """``wanted`` names, each prefixed with underscores until none clashes
    (Spark compares column names without case)."""
    used = {c.lower() for c in taken}
    out = []
    for name in wanted:
        while name.lower() in used:
            name = f"_{name}"
        used.add(name.lower())
        out.append(name)
    return out


