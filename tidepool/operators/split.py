"""Build/validation split.

The split is a hash of a key: a row goes to the build side when the
first 32 bits of ``md5(key)``, read as a fraction of 2^32, are below the
ratio.  Without a given key that is the message's coordinate, or, where a row
has none (file topics, CSV), all of its payload.  It needs no shuffle and no sample, is the same on every run and for
any partitioning, keeps all rows of one key together, and any SQL engine
with ``md5`` reproduces it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TWO_POW_32 = 4294967296.0


def key_text(key: list[str] | str) -> Column:
    """The key as text; a NULL key reads as empty text, so its row still
    lands on exactly one side."""
    cols = [key] if isinstance(key, str) else list(key)
    if len(cols) == 1:
        return F.coalesce(F.col(cols[0]).cast("string"), F.lit(""))
    return F.concat_ws("|", *[F.col(c).cast("string") for c in cols])


#: What a decoded message row carries besides its payload.
COORDINATE = ("_partition", "_offset", "_pos")
ARRIVAL = ("_timestamp", "_ingested_at")


def default_key(df: DataFrame) -> Column:
    """The message coordinate as text; rows without one: the payload as JSON."""
    payload = F.to_json(F.struct(*[F.col(f"`{c}`") for c in sorted(df.columns) if c not in COORDINATE + ARRIVAL]))
    if not set(COORDINATE) <= set(df.columns):
        return payload
    place = F.concat_ws("|", *(["topic"] if "topic" in df.columns else []), *[F.col(c).cast("string") for c in COORDINATE])
    return F.when(F.col("_offset").isNotNull(), place).otherwise(payload)


def hash_fraction(key: list[str] | str | Column) -> Column:
    """Uniform value in [0, 1) from the key: md5 prefix / 2^32."""
    text = key if isinstance(key, Column) else key_text(key)
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / F.lit(TWO_POW_32)


def _check_ratio(ratio: float) -> None:
    if not 0.0 < ratio < 1.0:
        raise ValueError(f"ratio must be strictly between 0 and 1 (one side would be empty), got {ratio}")


def hash_split(df: DataFrame, ratio: float, key: list[str] | str | None = None) -> tuple[DataFrame, DataFrame]:
    """(build, validation) with about ``ratio`` of the keys in build."""
    _check_ratio(ratio)
    u = hash_fraction(default_key(df) if key is None else key)
    return df.where(u < F.lit(ratio)), df.where(u >= F.lit(ratio))
