"""Series behind the dashboard's value boxes and charts.

Each function takes a history (or scored) frame and returns the small or
per-row frame a chart draws: counts, (x, y) pairs, a time-sequence axis,
stacked bar heights, the newest message.  All are plain DataFrame plans;
the sequence axis uses the distributed ordered prefix instead of a
one-partition window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .prefix import ordered_prefix


def _require_numeric(df: DataFrame, name: str) -> None:
    dtype = df.schema[name].dataType
    if not isinstance(dtype, T.NumericType):
        raise TypeError(f"series value {name!r} must be numeric, is {dtype.simpleString()}")


def message_counts(history: DataFrame, by: str = "topic") -> DataFrame:
    """Number of rows per topic (the "Total number of messages" box)."""
    return history.groupBy(by).agg(F.count(F.lit(1)).alias("n_messages"))


def count_display(n: Column | str, decimals: int = 0) -> Column:
    """Count text with thousands marks, e.g. 12345 -> "12,345"."""
    c = F.col(n) if isinstance(n, str) else n
    return F.format_number(c, decimals)


def series_xy(df: DataFrame, x: str, y: str) -> DataFrame:
    """(x, y) pairs of a chart; y must be numeric."""
    _require_numeric(df, y)
    return df.select(F.col(f"`{x}`").alias("x"), F.col(f"`{y}`").cast("double").alias("y"))


def series_by_time(
    df: DataFrame,
    y: str,
    order_by: list[str],
    partition_by: list[str] | None = None,
    newest_first: bool = True,
    num_partitions: int | None = None,
) -> DataFrame:
    """y against the arrival sequence: ``seq`` 1 is the newest row of each
    topic (history charts) or, with ``newest_first=False``, the oldest
    (scoring charts).  ``order_by`` must end with a unique id."""
    _require_numeric(df, y)
    part = list(partition_by or [])
    base = df.select(*[F.col(c) for c in part + list(order_by)], F.col(f"`{y}`").cast("double").alias("y"))
    ranked = ordered_prefix(base, list(order_by), part, rank_col="seq", descending=newest_first, num_partitions=num_partitions)
    return ranked.select(*part, F.col("seq").cast("bigint").alias("seq"), "y")


def line_by_x(df: DataFrame, x: str, y: str) -> DataFrame:
    """Line chart points, joined in x order (ties by y)."""
    return series_xy(df, x, y).orderBy("x", "y")


def line_columns(df: DataFrame, x: str, y: str, start, end, width: int, partition_by: list[str] | None = None) -> DataFrame:
    """A line's points reduced to what ``width`` pixel columns between ``start`` and
    ``end`` (numbers, dates or timestamps; the end included) can show: per column the
    first, last, lowest and highest point (the earliest where several are equal).

    A line drawn through these at most four points a column covers the same pixels as one
    through all points.  One aggregate, reduced in every input partition; its rows are as
    many as columns, however long the series, and can be merged (``merge_line_columns``).
    Points with a NULL, or outside, are left out."""
    _require_numeric(df, y)
    if width < 1:
        raise ValueError("a line needs at least one pixel column")
    part = list(partition_by or [])
    dated = isinstance(df.schema[x].dataType, (T.TimestampType, T.TimestampNTZType, T.DateType))

    def place(c: Column) -> Column:
        return F.unix_micros(c.cast("timestamp")) if dated else c.cast("double")

    at = place(F.col(f"`{x}`"))
    lo, hi = (place(F.lit(v).cast(df.schema[x].dataType)) for v in (start, end))
    column = F.least(F.floor((at - lo) * F.lit(width) / F.greatest(hi - lo, F.lit(1 if dated else 1e-300))), F.lit(width - 1)).cast("int")
    value = F.col(f"`{y}`").cast("double")
    points = df.where(at.isNotNull() & value.isNotNull() & at.between(lo, hi))
    point = F.struct(F.col(f"`{x}`").alias("x"), value.alias("y"))
    tagged = points.select(*part, column.alias("column"), *[point.alias(c) for c in _CORNERS])
    return merge_line_columns(tagged, partition_by=part)


_CORNERS = ("first", "last", "lowest", "highest")


def merge_line_columns(*parts: DataFrame, partition_by: list[str] | None = None) -> DataFrame:
    """The pixel columns of several stretches of one series (batches, say) as one: the
    same as those of all their points."""
    both = parts[0]
    for p in parts[1:]:
        both = both.unionByName(p)
    x, y = (lambda c: F.col(f"{c}.x")), (lambda c: F.col(f"{c}.y"))
    # A structure that is least at the earliest of the highest points needs the x turned round, so ask for the least -y.
    best = {
        "first": F.min(F.struct(x("first"), y("first"), F.col("first").alias("p"))), "last": F.max(F.struct(x("last"), y("last"), F.col("last").alias("p"))),
        "lowest": F.min(F.struct(y("lowest"), x("lowest"), F.col("lowest").alias("p"))),
        "highest": F.min(F.struct(-y("highest"), x("highest"), F.col("highest").alias("p"))),
    }
    return both.groupBy(*(partition_by or []), "column").agg(*[best[c]["p"].alias(c) for c in _CORNERS])


def line_points(columns: DataFrame, partition_by: list[str] | None = None) -> DataFrame:
    """The points of pixel columns, each once, as ``(x, y)`` rows in x order."""
    points = columns.select(*(partition_by or []), F.explode(F.array_distinct(F.array(*_CORNERS))).alias("p"))
    return points.select(*(partition_by or []), "p.x", "p.y").orderBy(*(partition_by or []), "x", "y")


def stacked_bars(df: DataFrame, x: str, y: str) -> DataFrame:
    """Bar height per x when bars with equal x stack: positive and negative
    parts are summed apart (map-side partial aggregation, so a hot x costs
    no more than a cold one)."""
    _require_numeric(df, y)
    v = F.col(f"`{y}`").cast("double")
    return df.groupBy(F.col(f"`{x}`").alias("x")).agg(
        F.coalesce(F.sum(F.when(v >= 0, v)), F.lit(0.0)).alias("pos_height"),
        F.coalesce(F.sum(F.when(v < 0, v)), F.lit(0.0)).alias("neg_height"),
        F.count(v).alias("n_bars"),
    )


def latest(df: DataFrame, order_by: list[str], partition_by: list[str] | None = None) -> DataFrame:
    """Newest row per group (top-1 by ``order_by``; NULL orders lowest, a NULL
    group is a group): one ``max_by`` pass over batch or stream, reduced in every
    input partition before the shuffle, so a hot group costs no more than a cold one."""
    part = list(partition_by or [])
    others = [c for c in df.columns if c not in part]
    key = F.struct(*[F.col(f"`{c}`") for c in order_by])
    row = F.struct(*[F.col(f"`{c}`") for c in others])
    newest = df.groupBy(*part).agg(F.max_by(row, key).alias("_row"))
    return newest.select(*part, *[F.col("_row").getField(c).alias(c) for c in others])
