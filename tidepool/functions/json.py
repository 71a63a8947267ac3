"""Message decoding: schema inference, JSON -> rows, flattening, quarantine.

A message is one JSON text.  An object becomes one row, a top-level array of
objects becomes one row per element.  Unreadable text, JSON scalars, arrays of
scalars and NULL values give no row (the consumer's "skip and go on");
``classify`` names the reason so a caller can keep them in a quarantine output.

Reading is strict: a message is read inside an array that ends with a marker
of our own, so a second object, text behind the object or an unbalanced bracket
makes it unreadable instead of being dropped in silence.  That needs one
``from_json`` a message, also for a plain count.

Decoding is lossless where it is asked for (``rescued_col``): beside the typed row
the message is read as a VARIANT, and every field that the typed value does not hold in
full is kept as text -- unknown fields, other types, numbers with more digits than
the column's type keeps.  Of a repeated key the last value counts, as in the
consumer's parser; a message that no variant can hold (repeated keys, bare NaN, numbers of
more digits or greater exponents than a variant keeps) is kept whole under ``_message``.

Everything here is JVM-side column expressions (``from_json``, variants, ``explode``,
field access); no Python runs per message.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .schema import END, STRICT, observed_schema, pinned

CORRUPT_COL = "_corrupt_record"

# JSON timestamp text with micro-second precision; ``to_json`` would cut the
# fraction to milliseconds without it.
TS_NTZ_FORMAT = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"
JSON_OPTIONS = {"timestampNTZFormat": TS_NTZ_FORMAT, "timestampFormat": TS_NTZ_FORMAT + "XXX"}
_READ = JSON_OPTIONS | STRICT

#: Key under which a message that no variant can hold is kept whole.
WHOLE = "_message"
#: Numbers whose text a variant changes: over 38 digits, or long or far ones with an exponent.
_BEYOND_VARIANT = r"[:\[,]\s*-?([0-9][0-9.]{37,}|[0-9.]{17,}[eE]|[0-9.]+[eE][+-]?[0-9]{3,})"
#: What a decoded value is to its text, the worst of a message counts.
HELD, UNKNOWN_FIELD, INEXACT, WRONG_TYPE = range(4)
#: Decimal digits that a type keeps of any number.
_DIGITS = {T.DoubleType: 15, T.FloatType: 6}


def infer_schema(
    messages: DataFrame,
    value_col: str = "value",
    sample_rows: int | None = None,
    hints: Mapping[str, str] | None = None,
) -> T.StructType:
    """Schema of the row objects in a column of JSON texts.

    Inferred once, by default over all messages present, so that a late field
    or a late type change has its place; then pinned by the caller.  A caller
    may bound the scan to the first ``sample_rows`` messages.  Top-level
    arrays contribute their elements.  ``hints`` override the inferred type of
    top-level fields by DDL type name, e.g. ``{"ts": "timestamp_ntz"}``.
    One aggregate over one scan (see ``schema``); nothing is written.
    """
    found = pinned(observed_schema(messages, value_col, sample_rows))
    schema = found if isinstance(found, T.StructType) else T.StructType([])
    return apply_hints(schema, hints) if hints else schema


def apply_hints(schema: T.StructType, hints: Mapping[str, str]) -> T.StructType:
    fields = []
    known = set()
    for f in schema.fields:
        if f.name in hints:
            fields.append(T.StructField(f.name, T._parse_datatype_string(hints[f.name]), True))
        else:
            fields.append(f)
        known.add(f.name)
    for name, ddl in hints.items():
        if name not in known:
            fields.append(T.StructField(name, T._parse_datatype_string(ddl), True))
    return T.StructType(fields)


def free_name(name: str, taken: Iterable[str]) -> str:
    """``name`` with ``_msg`` behind it until nothing in ``taken`` is called so (in any case)."""
    used = {t.lower() for t in taken}
    while name.lower() in used:
        name += "_msg"
    return name


def _first_char(text: Column) -> Column:
    return F.substring(F.ltrim(text, F.lit(" \t\r\n")), 1, 1)


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once, however often ``use`` names it: Spark
    evaluates a costly expression again wherever it stands in a conditional branch."""
    return F.transform(F.array(value), use)[0]


def _once(messages: DataFrame, keep: list[str], **columns: Column) -> DataFrame:
    """``keep`` and new columns that later steps read instead of computing them again."""
    row = F.struct(*[c.alias(name) for name, c in columns.items()])
    return messages.select(*keep, F.inline(F.array(row)))


def message_rows(text: Column, schema: T.StructType) -> Column:
    """The row objects of a message as an array of structs (with a field for the end
    marker behind the schema's); NULL where the text is not an object or an
    array of objects from its first to its last character."""
    end = free_name(END, schema.names)
    row = T.StructType([*schema.fields, T.StructField(end, T.IntegerType())])
    mark = f'{{"{end}":0}}'
    lone = F.from_json(F.concat(F.lit("["), text, F.lit(f",{mark}]")), T.ArrayType(row), _READ)
    many = F.from_json(F.concat(F.lit("["), text, F.lit(f",[{mark}]]")), T.ArrayType(T.ArrayType(row)), _READ)

    def lone_rows(read: Column) -> Column:
        whole = (F.size(read) == 2) & (F.try_element_at(read, F.lit(2))[end] == 0)
        return F.when(whole, F.slice(read, 1, 1))

    def many_rows(read: Column) -> Column:
        whole = (F.size(read) == 2) & (F.try_element_at(F.try_element_at(read, F.lit(2)), F.lit(1))[end] == 0)
        rows = F.try_element_at(read, F.lit(1))
        return F.when(whole & F.forall(rows, lambda r: r.isNotNull()), rows)

    first = _first_char(text)
    return F.when(first == "{", _let(lone, lone_rows)).when(first == "[", _let(many, many_rows))


def _digits(number: Column) -> Column:
    """The significant digits of a number's text."""
    return F.btrim(F.regexp_replace(F.substring_index(F.upper(number), "E", 1), "[^0-9]", ""), F.lit("0"))


def _loss(found: Column, value: Column, dtype: T.DataType) -> Column:
    """How much of the variant ``found`` its decoded ``value`` holds (``HELD`` ...)."""
    return _let(found.cast("string"), lambda text: _text_loss(text, found, value, dtype))


def _text_loss(text: Column, found: Column, value: Column, dtype: T.DataType) -> Column:
    inside = F.lit(HELD)
    if isinstance(dtype, T.StructType):
        parts = F.try_variant_get(found, "$", "map<string,variant>")
        names = F.array(*[F.lit(f.name) for f in dtype.fields]).cast("array<string>")
        unknown = F.size(F.map_filter(parts, lambda k, _v: ~F.array_contains(names, k))) > 0
        losses = [_loss(parts[f.name], value.getField(f.name), f.dataType) for f in dtype.fields]
        inside = F.greatest(F.when(unknown, F.lit(UNKNOWN_FIELD)).otherwise(F.lit(HELD)), F.lit(HELD), *losses)
    elif isinstance(dtype, T.ArrayType):
        items = F.try_variant_get(found, "$", "array<variant>")
        pairs = F.arrays_zip(items.alias("found"), value.alias("value"))
        inside = F.coalesce(F.array_max(F.transform(pairs, lambda p: _loss(p["found"], p["value"], dtype.elementType))), F.lit(HELD))
    elif isinstance(dtype, T.DecimalType):
        inside = F.when(_digits(text) != _digits(value.cast("string")), F.lit(INEXACT)).otherwise(F.lit(HELD))
    elif type(dtype) in _DIGITS:
        digits, most = _digits(text), _DIGITS[type(dtype)]
        more = (F.length(text) > most) & (F.length(digits) > most)
        inside = F.when(more & (digits != _digits(value.cast("string"))), F.lit(INEXACT)).otherwise(F.lit(HELD))
    elif isinstance(dtype, T.StringType):
        # a long fraction that is not a JSON string was read as a double on its way to text
        fraction = (F.length(text) >= 18) & (text != value) & text.rlike(r"(?=[0-9.]{18})[0-9]*\.[0-9]")
        inside = F.when(fraction & (F.schema_of_variant(found) != "STRING"), F.lit(INEXACT)).otherwise(F.lit(HELD))
    return F.when(text.isNull(), F.lit(HELD)).when(value.isNull(), F.lit(WRONG_TYPE)).otherwise(F.coalesce(inside, F.lit(HELD)))


def _row_variants(text: Column) -> Column:
    """The row objects of a (whole) message as variants; NULL where no variant can hold it."""
    value = F.when(~text.rlike(_BEYOND_VARIANT), F.try_parse_json(text))
    is_array = _first_char(text) == "["
    return _let(value, lambda v: F.when(is_array, F.try_variant_get(v, "$", "array<variant>")).when(v.isNotNull(), F.array(v)))


def decode(
    messages: DataFrame,
    schema: T.StructType,
    value_col: str = "value",
    keep: list[str] | None = None,
    position_col: str | None = None,
    rescued_col: str | None = None,
    reserved: Iterable[str] = (),
    reason_col: str | None = None,
    raw_col: str | None = None,
) -> DataFrame:
    """Decode JSON messages into rows of ``schema`` (one per object).

    ``keep`` lists message columns carried onto every row (topic, offset,
    timestamp ...).  ``position_col`` names an optional column holding the
    element's index inside an array message (0 for lone objects), which
    together with the message key makes rows unique.  ``rescued_col`` names
    an optional column holding, as JSON text, the fields of the object that
    the pinned schema cannot hold in full (NULL when there are none): unknown
    ones, and ones with a value of another type, more digits than the type
    keeps, or an unknown field anywhere inside.  A message that no variant can
    hold stands there whole (key ``_message``, on its first row).

    A payload field named like a carried, position, rescued or ``reserved``
    column is called ``<name>_msg`` (again until the name is free).

    With ``reason_col`` and ``raw_col`` every message that belongs in a quarantine
    (see ``classify``) gives one more row, whose payload is NULL and which holds the
    reason and the message's text: rows and quarantine out of one reading.
    """
    keep = list(keep or [])
    text = F.col(value_col).cast("string")
    rows = message_rows(text, schema)
    if rescued_col or reason_col:
        known = F.array(*[F.lit(f.name) for f in schema.fields]).cast("array<string>")
        # (a null array would make the zipped one null)
        found = F.coalesce("_found", F.array().cast("array<variant>"))
        both = F.arrays_zip(F.col("_rows").alias("row"), found.alias("found"))

        def aside(pair: Column, i: Column) -> Column:
            def not_held(k: Column, v: Column) -> Column:
                out = ~F.array_contains(known, k)
                for f in schema.fields:
                    out = out | ((k == f.name) & (_loss(v, pair["row"].getField(f.name), f.dataType) > HELD))
                return out

            fields = F.try_variant_get(pair["found"], "$", "map<string,variant>")
            kept = F.transform_values(F.map_filter(fields, not_held), lambda _k, v: v.cast("string"))
            whole = F.when(i == 0, F.create_map(F.lit(WHOLE), F.col("_text")))
            return F.struct(pair["row"].alias("row"), F.when(F.col("_found").isNull(), whole).otherwise(kept).alias("extra"))

        read = _once(messages, keep, _text=text, _rows=rows, _found=_row_variants(text))
        read = read if reason_col else read.where(F.size("_rows") > 0)
        entries = F.transform(both, aside)
        if reason_col:
            status = _status(F.col("_text"), F.col("_rows"), F.col("_found"), schema)
            kind = read.select(entries.alias("e")).schema["e"].dataType
            bad = F.array(F.lit(None).cast(kind.elementType))
            # the quarantine's entry comes behind the rows, as a null
            good = F.coalesce(entries, F.array().cast(kind))
            read = _once(read, [*keep, "_text", "_rows", "_found"], _status=status)
            entries = F.when(F.col("_status").isin(*BAD), F.concat(good, bad)).otherwise(good)
        exploded = read.select(*keep, *(["_status", "_text"] if reason_col else []), F.posexplode(entries).alias("_pos", "_pair"))
        extra_cols = []
        if reason_col:
            aside_here = F.col("_pair").isNull()
            extra_cols = [F.when(aside_here, F.col("_status")).alias("_status"), F.when(aside_here, F.col("_text")).alias("_text")]
        position = F.when(F.col("_pair").isNotNull(), F.col("_pos")) if reason_col else F.col("_pos")
        exploded = exploded.select(*keep, position.alias("_pos"), F.col("_pair.row").alias("_msg"), F.col("_pair.extra").alias("_extra"), *extra_cols)
    else:
        exploded = messages.select(*keep, F.posexplode(rows).alias("_pos", "_msg"))
    cols = [F.col(k) for k in keep]
    if position_col:
        cols.append(F.col("_pos").alias(position_col))
    own = {f.name for f in schema.fields}
    taken = [*keep, *(c for c in (position_col, rescued_col, reason_col, raw_col) if c), *reserved]
    names: list[str] = []
    for f in schema.fields:
        clash = f.name.lower() in {t.lower() for t in taken}
        names.append(free_name(f.name, [*taken, *names, *(own - {f.name})]) if clash else f.name)
    cols += [F.col("_msg").getField(f.name).alias(name) for f, name in zip(schema.fields, names, strict=True)]
    if rescued_col:
        cols.append(F.when(F.size("_extra") > 0, F.to_json("_extra")).alias(rescued_col))
    if reason_col:
        cols += [F.col("_status").alias(reason_col), F.col("_text").alias(raw_col or "_raw")]
    return exploded.select(*cols)


#: Statuses of messages that go to a quarantine.
BAD = ("unreadable", "wrong_type", "inexact")


def classify(messages: DataFrame, schema: T.StructType, value_col: str = "value") -> Column:
    """Status of each message: ok | empty | unreadable | wrong_type | inexact.

    ``empty``: NULL or blank value (a tombstone; a text file can only hold
    a NULL message as an empty line).  ``unreadable``: not one JSON text from end to
    end (cut off, a second object, text behind it), a JSON scalar or an array that is
    not of objects.  ``wrong_type``: a leaf does not fit the pinned type (it
    decodes to NULL but the raw text is worth keeping).  ``inexact``: a number
    has more digits than its column keeps.
    """
    text = F.col(value_col).cast("string")
    return _status(text, message_rows(text, schema), _row_variants(text), schema)


def _status(text: Column, rows: Column, found: Column, schema: T.StructType) -> Column:
    worst = F.array_max(F.transform(F.arrays_zip(found.alias("found"), rows.alias("row")), lambda p: _loss(p["found"], p["row"], schema)))
    # Without a variant only a lone object's misfits can be told.
    with_corrupt = T.StructType(schema.fields + [T.StructField(CORRUPT_COL, T.StringType(), True)])
    obj = F.from_json(text, with_corrupt, {**_READ, "columnNameOfCorruptRecord": CORRUPT_COL})
    misfit = (_first_char(text) == "{") & obj.getField(CORRUPT_COL).isNotNull()
    return (
        F.when(text.isNull() | (F.trim(text) == ""), F.lit("empty"))
        .when(rows.isNull(), F.lit("unreadable"))
        .when(F.when(found.isNull(), misfit).otherwise(worst == WRONG_TYPE), F.lit("wrong_type"))
        .when(F.when(found.isNull(), text.rlike(_BEYOND_VARIANT)).otherwise(worst == INEXACT), F.lit("inexact"))
        .otherwise(F.lit("ok"))
    )


def split_quarantine(
    messages: DataFrame, schema: T.StructType, value_col: str = "value"
) -> tuple[DataFrame, DataFrame]:
    """(messages that decode, messages kept aside with a ``reason``).

    Wrong-typed and inexact objects go to both sides: their row survives (a wrong
    leaf is NULL) and the raw text is quarantined.  Empty (NULL) messages are
    tombstones and go to neither.
    """
    tagged = messages.withColumn("_status", classify(messages, schema, value_col))
    good = tagged.where(F.col("_status").isin("ok", "wrong_type", "inexact")).drop("_status")
    bad = tagged.where(F.col("_status").isin(*BAD)).withColumnRenamed("_status", "reason")
    return good, bad


def leaf_paths(schema: T.StructType, prefix: tuple[str, ...] = ()) -> list[tuple[str, ...]]:
    """All leaf field paths; arrays and maps are leaves, empty structs vanish."""
    out: list[tuple[str, ...]] = []
    for f in schema.fields:
        path = prefix + (f.name,)
        if isinstance(f.dataType, T.StructType):
            out.extend(leaf_paths(f.dataType, path))
        else:
            out.append(path)
    return out


def flatten(df: DataFrame, sep: str = "_", columns: list[str] | None = None) -> DataFrame:
    """Project nested struct columns to one column per leaf, named by joining
    the path with ``sep`` (``"."`` reproduces dotted names; ``"_"`` keeps the
    names usable in formulas).  Raises when two paths flatten to one name."""
    columns = columns or df.columns
    selected: list[Column] = []
    names: dict[str, tuple[str, ...]] = {}
    schema = df.schema
    for name in columns:
        dtype = schema[name].dataType
        if isinstance(dtype, T.StructType):
            paths = [(name,) + p for p in leaf_paths(dtype)]
        else:
            paths = [(name,)]
        for path in paths:
            flat = sep.join(path)
            if flat in names:
                raise ValueError(f"flattened name {flat!r} is produced by {names[flat]} and {path}: choose another separator than {sep!r}")
            names[flat] = path
            c = F.col("`" + path[0].replace("`", "``") + "`")
            for part in path[1:]:
                c = c.getField(part)
            selected.append(c.alias(flat))
    return df.select(*selected)


def attributes(schema: T.StructType, sep: str = "_") -> list[tuple[str, str]]:
    """(flattened name, Spark type name) per leaf, in schema order."""
    out = []
    for path in leaf_paths(schema):
        f_type: T.DataType = schema
        for part in path:
            f_type = f_type[part].dataType  # type: ignore[index]
        out.append((sep.join(path), f_type.simpleString()))
    return out
