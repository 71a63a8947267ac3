"""Message schemas as a mergeable aggregate, and their versions.

Every JSON value has a type in a lattice: nothing seen < whole number < decimal <
double; text, truth, object (by field) and array (by element); anything else meets at
"mixed".  ``observed_schema`` finds the least type above all messages of a frame in one
scan (``schema_of_variant_agg`` merges inside each partition, then the partitions'
results: no message is copied anywhere), ``merge`` joins two results.  Merging is
associative and commutative, so batches may be observed one by one: the merge of their
schemas is the schema of all their messages.

``pinned`` turns a result into the Spark schema that messages are decoded with:
decimals become doubles (whole numbers beyond 64 bits decimals), nothing and mixed become
text.  Spark compares names without case, so of fields whose names differ in case only
the first (in byte order) has a column; a field without a name has none.  What has no
column is an unknown field to the decoder, which keeps it aside.

``SchemaLog`` keeps the merged schema of a topic as numbered versions, one for each
batch that changed it; ``track_schema`` feeds it from a stream.
"""

from __future__ import annotations

import json
import math
import re
from collections.abc import Iterable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

#: Marks the end of a message inside the array it is wrapped in for parsing.
END = "_end_of_message"
#: JSON texts here are strict, as the consumer's parser is.
STRICT = {"allowSingleQuotes": "false"}
#: Digits of the greatest whole number that Spark's merge takes for a 64-bit one.
_LONG_DIGITS = 20


def whole_variant(text: Column) -> Column:
    """The one JSON value that makes up all of ``text``; NULL where there is none, more
    than one or other text behind it (also for repeated keys and bare NaN, which a
    variant cannot hold)."""
    wrapped = F.try_parse_json(F.concat(F.lit("["), text, F.lit(f',"{END}"]')))

    def only(w: Column) -> Column:
        ends = (F.try_variant_get(w, "$[1]", "string") == END) & F.try_variant_get(w, "$[2]", "variant").isNull()
        return F.when(ends, F.try_variant_get(w, "$[0]", "variant"))

    return F.transform(F.array(wrapped), only)[0]  # parsed once


def _only_parsed_loosely(text: Column) -> Column:
    """Whether a text without a variant is one JSON value all the same."""
    fields = F.from_json(F.concat(F.lit('{"m":'), text, F.lit(f',"{END}":0}}')), "map<string,string>", STRICT)
    return F.coalesce((F.size(fields) == 2) & fields[END].isNotNull(), F.lit(False))


# --- the lattice ---------------------------------------------------------------------------------

NOTHING, MIXED = T.NullType(), T.VariantType()


def merge(a: T.DataType, b: T.DataType) -> T.DataType:
    """The least type above both."""
    if a == b or b == NOTHING:
        return a
    if a == NOTHING:
        return b
    if isinstance(a, T.StructType) and isinstance(b, T.StructType):
        types = {f.name: f.dataType for f in a.fields}
        for f in b.fields:
            types[f.name] = merge(types[f.name], f.dataType) if f.name in types else f.dataType
        return T.StructType([T.StructField(n, types[n]) for n in sorted(types, key=str.encode)])
    if isinstance(a, T.ArrayType) and isinstance(b, T.ArrayType):
        return T.ArrayType(merge(a.elementType, b.elementType))
    numbers = (T.LongType, T.DecimalType, T.DoubleType)
    if isinstance(a, numbers) and isinstance(b, numbers):
        if isinstance(a, T.DoubleType) or isinstance(b, T.DoubleType):
            return T.DoubleType()
        parts = [(20, 0) if isinstance(x, T.LongType) else (x.precision, x.scale) for x in (a, b)]
        scale = max(s for _, s in parts)
        precision = scale + max(p - s for p, s in parts)
        return T.DecimalType(precision, scale) if precision <= 38 else T.DoubleType()
    return MIXED


def merge_all(schemas: Iterable[T.DataType]) -> T.DataType:
    return reduce(merge, schemas, NOTHING)


def pinned(found: T.DataType) -> T.DataType:
    """The Spark type that values of a lattice type are decoded with."""
    if isinstance(found, T.StructType):
        fields, taken = [], set()
        for f in found.fields:
            if f.name and f.name.lower() not in taken:
                taken.add(f.name.lower())
                fields.append(T.StructField(f.name, pinned(f.dataType), True))
        return T.StructType(fields)
    if isinstance(found, T.ArrayType):
        return T.ArrayType(pinned(found.elementType))
    if isinstance(found, T.DecimalType):
        return T.DecimalType(38, 0) if found.scale == 0 and found.precision > _LONG_DIGITS else T.DoubleType()
    return T.StringType() if found in (NOTHING, MIXED) else found


# --- observing messages --------------------------------------------------------------------------


def _from_variant_schema(text: str | None) -> T.DataType:
    """The type that ``schema_of_variant_agg`` prints."""
    if text is None:
        return NOTHING
    names: list[str] = []

    def plain(m: re.Match) -> str:
        if m[0] == "OBJECT<":
            return "STRUCT<"
        names.append(m[0][1:-1].replace("``", "`"))
        return f"_q{len(names) - 1}_"

    # Quoted names are put aside: they may hold anything, or nothing.
    found = T._parse_datatype_string(f"c {re.sub('`(?:[^`]|``)*`|OBJECT<', plain, text)}")[0].dataType

    def named(t: T.DataType) -> T.DataType:
        if isinstance(t, T.StructType):
            back = [T.StructField(names[int(f.name[2:-1])] if re.fullmatch(r"_q\d+_", f.name) else f.name, named(f.dataType)) for f in t.fields]
            return T.StructType(sorted(back, key=lambda f: f.name.encode()))
        return T.ArrayType(named(t.elementType)) if isinstance(t, T.ArrayType) else t

    return named(found)


def _of_value(value: object) -> T.DataType:
    if value is None:
        return NOTHING
    if isinstance(value, bool):
        return T.BooleanType()
    if isinstance(value, str):
        return T.StringType()
    if isinstance(value, int):
        if -(1 << 63) <= value < 1 << 63:
            return T.LongType()
        return T.DecimalType(len(str(abs(value))), 0) if abs(value) < 10**38 else T.DoubleType()
    if isinstance(value, float):
        return T.DecimalType(2, 1) if math.isfinite(value) else T.DoubleType()
    if isinstance(value, list):
        return T.ArrayType(merge_all(map(_of_value, value)))
    return T.StructType([T.StructField(k, _of_value(value[k])) for k in sorted(value, key=str.encode)])


def _loose_schema(texts: DataFrame) -> T.DataType:
    """The schema of the few messages that only a lenient parser reads: of a repeated
    key the last value counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = NOTHING
        for batch in batches:
            for text in batch.column(0).to_pylist():
                try:
                    value = json.loads(text)
                except ValueError:
                    continue
                rows = value if isinstance(value, list) else [value]
                if all(isinstance(r, dict) for r in rows):
                    found = merge_all([found, *map(_of_value, rows)])
        if found != NOTHING:
            yield pa.RecordBatch.from_arrays([pa.array([found.json()])], names=["found"])

    return merge_all(T._parse_datatype_json_string(r["found"]) for r in texts.mapInArrow(run, "found string").collect())  # a row a partition


def observed_schema(messages: DataFrame, value_col: str = "value", sample_rows: int | None = None) -> T.DataType:
    """The lattice type of the row objects in a column of JSON texts: an object is a row,
    a top-level array of objects gives its elements, all other messages say nothing."""
    texts = messages.select(F.col(value_col).cast("string").alias("text")).where(F.trim("text") != "")
    if sample_rows is not None:
        texts = texts.limit(sample_rows)
    value = whole_variant(F.col("text"))
    first = F.substring(F.ltrim(F.col("text"), F.lit(" \t\r\n")), 1, 1)
    # one row out of a generator, so that the aggregates below read the value instead of parsing again
    read = texts.select("text", F.inline(F.array(F.struct(first.alias("first"), value.alias("value")))))
    rows = F.schema_of_variant("value").startswith("ARRAY<OBJECT<")
    found = read.agg(
        F.schema_of_variant_agg(F.when(F.col("first") == "{", F.col("value"))).alias("lone"),
        F.schema_of_variant_agg(F.when((F.col("first") == "[") & rows, F.col("value"))).alias("many"),
        F.count_if(F.col("value").isNull() & F.col("first").isin("{", "[") & _only_parsed_loosely(F.col("text"))).alias("loose"),
    ).first()
    many = _from_variant_schema(found["many"])
    schema = merge(_from_variant_schema(found["lone"]), many.elementType if isinstance(many, T.ArrayType) else NOTHING)
    if found["loose"]:
        schema = merge(schema, _loose_schema(read.where(F.col("value").isNull() & F.col("first").isin("{", "[")).select("text")))
    return schema


# --- versions ------------------------------------------------------------------------------------


class SchemaLog:
    """Numbered versions of a topic's merged schema under one folder, a small immutable
    entry for each batch that changed it.  One writer (a stream) per log; a batch that is
    run again changes nothing."""

    SCHEMA = "version long, batch_id long, schema string"

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")

    def versions(self) -> DataFrame:
        try:
            return self.spark.read.schema(self.SCHEMA).parquet(f"{self.root}/versions")
        except AnalysisException as exc:
            if exc.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], self.SCHEMA)

    def current(self) -> tuple[int, T.DataType]:
        """The newest version and its schema; (-1, nothing) before the first."""
        newest = self.versions().orderBy(F.desc("version")).first()
        return (-1, NOTHING) if newest is None else (newest["version"], T._parse_datatype_json_string(newest["schema"]))

    def add(self, found: T.DataType, batch_id: int) -> int:
        """Merge a batch's schema in; the version in force afterwards."""
        version, schema = self.current()
        merged = merge(schema, found)
        if merged == schema:
            return version
        entry = self.spark.createDataFrame([(version + 1, batch_id, merged.json())], self.SCHEMA).coalesce(1)
        entry.write.mode("overwrite").parquet(f"{self.root}/versions/entry={version + 1}")
        return version + 1


def track_schema(messages: DataFrame, log: SchemaLog, checkpoint: str, trigger: str | None = "availableNow") -> StreamingQuery:
    """Merge the schema of every micro-batch of a message stream into ``log``."""

    def handle(batch: DataFrame, batch_id: int) -> None:
        log.add(observed_schema(batch), batch_id)

    writer = messages.writeStream.option("checkpointLocation", checkpoint).foreachBatch(handle)
    if trigger == "availableNow":
        q = writer.trigger(availableNow=True).start()
        q.awaitTermination()
        return q
    return writer.trigger(processingTime=trigger).start() if trigger else writer.start()
