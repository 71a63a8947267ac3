"""Queries over topics and their history: ingestion, decoding, series,
counts, set operations and table operations.

The topic fixtures are derived from ``events``: every row becomes one JSON
message, ``event_type`` names the topic.  Queries that exercise the stream
stage those messages as files in the shared scratch folder and replay them;
queries over the *history* read ``events`` directly, which is exactly what
the history of the staged topic holds.
"""

from __future__ import annotations

import uuid
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import json as J
from ..functions.schema import SchemaLog, observed_schema, pinned, track_schema
from ..operators import relational as R
from ..operators import series as S
from ..operators import setops as X
from ..operators.models import ModelSpec, training_projection
from ..session import scratch_path
from ..sources.topic import TopicSource, publish, read_batch, read_stream, to_messages
from ..streaming.ingest import ingest, live_counts, live_latest, read_counts, read_live, start_quarantine, subscribe
from .common import query, r6, stage_topic, table

EVENT_HINTS = {"ts": "timestamp_ntz"}
MD5_FIRST = "substr(md5(CAST(event_id AS VARCHAR)), 1, 1)"


def _history(spark: SparkSession, sf: str) -> DataFrame:
    """History of the events topics: one row per message, topic column."""
    return table(spark, sf, "events").withColumnRenamed("event_type", "topic")


# --- A: sources and sinks -------------------------------------------------


@query(
    "topic_replay",
    "A1 A3 A5 B1",
    "SELECT event_id, ts, user_id, event_type, value, props FROM events",
)
def topic_replay(spark: SparkSession, sf: str) -> DataFrame:
    """One topic replayed from the earliest message, one file per
    micro-batch, decoded and appended to the history."""
    ev = table(spark, sf, "events")
    src = replace(stage_topic(spark, ev, name="events", files=8, order_col="event_id"), max_per_trigger=1)
    sub = subscribe(spark, src, hints=EVENT_HINTS)
    ingest(spark, sub)
    return sub.history(spark).select("event_id", "ts", "user_id", "event_type", "value", "props")


@query(
    "drift_rescued",
    "A5 B1 B4",
    "SELECT event_id, value, CAST(user_id AS VARCHAR) AS rescued_user_id, event_type AS rescued_event_type FROM events",
)
def drift_rescued(spark: SparkSession, sf: str) -> DataFrame:
    """Schema drift: the topic's schema was pinned to (event_id, value);
    later messages carry more fields, which the history keeps as JSON text
    in ``_rescued`` instead of dropping them."""
    src = stage_topic(spark, table(spark, sf, "events"), name="events", files=4, order_col="event_id")
    pinned = T.StructType([T.StructField("event_id", T.LongType()), T.StructField("value", T.DoubleType())])
    sub = subscribe(spark, replace(src, max_per_trigger=2), schema=pinned, rescue=True)
    ingest(spark, sub)
    hist = sub.history(spark)
    return hist.select(
        "event_id",
        "value",
        F.get_json_object("_rescued", "$.user_id").alias("rescued_user_id"),
        F.get_json_object("_rescued", "$.event_type").alias("rescued_event_type"),
    )


@query(
    "schema_drift_full",
    "A5 B1 B5",
    "WITH cut AS (SELECT max(event_id) // 10 * 9 AS c FROM events) SELECT event_id, "
    "CASE WHEN event_id < c THEN floor(value) ELSE value END AS v, CASE WHEN event_id >= c THEN event_type END AS late FROM events, cut",
)
def schema_drift_full(spark: SparkSession, sf: str) -> DataFrame:
    """A number turns from integer to real and a field appears, both only in the
    last tenth of the messages: the schema is inferred over all of them."""
    ev = table(spark, sf, "events")
    cut = F.lit(ev.agg(F.max("event_id")).first()[0] // 10 * 9)
    early = F.to_json(F.struct("event_id", F.floor("value").cast("bigint").alias("v")))
    late = F.to_json(F.struct("event_id", F.col("value").alias("v"), F.col("event_type").alias("late")))
    src = TopicSource("drift", path=scratch_path(spark, "topic-files"))
    publish(ev.select(F.when(F.col("event_id") < cut, early).otherwise(late).alias("value")), src)
    sub = subscribe(spark, src)
    ingest(spark, sub)
    return sub.history(spark).select("event_id", "v", "late")


@query(
    "topic_numeric_name",
    "A1 A4",
    "SELECT lpad(CAST(user_id AS VARCHAR), 5, '0') AS topic, count(*) AS n FROM events GROUP BY ALL",
)
def topic_numeric_name(spark: SparkSession, sf: str) -> DataFrame:
    """Topics that look like numbers keep their names as text, leading zeros too.
    There is a topic for every user: the topic is a column of files, not a folder each."""
    ev = table(spark, sf, "events").select("event_id", F.lpad(F.col("user_id").cast("string"), 5, "0").alias("name"))
    sub = subscribe(spark, stage_topic(spark, ev.repartition("name"), topic_col="name", topic_folders=False))
    ingest(spark, sub)
    return S.message_counts(sub.history(spark)).withColumnRenamed("n_messages", "n")


@query(
    "history_table",
    "A4 A5",
    "SELECT event_type AS topic, event_id, ts, user_id, value, props FROM events",
)
def history_table(spark: SparkSession, sf: str) -> DataFrame:
    """Several topics in one subscription; history partitioned by topic."""
    src = stage_topic(spark, table(spark, sf, "events"), topic_col="event_type")
    sub = subscribe(spark, src, hints=EVENT_HINTS)
    ingest(spark, sub)
    return sub.history(spark).select("topic", "event_id", "ts", "user_id", "value", "props")


@query(
    "topic_counts",
    "D1 A4",
    "SELECT event_type AS topic, count(*) AS n_messages FROM events GROUP BY event_type",
)
def topic_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Running message count per topic as a streaming aggregation."""
    src = stage_topic(spark, table(spark, sf, "events"), topic_col="event_type", files=4, order_col="event_id")
    sub = subscribe(spark, replace(src, max_per_trigger=2), hints=EVENT_HINTS)
    _, counts = live_counts(spark, sub)
    return read_counts(spark, counts)


@query(
    "message_count_display",
    "B11 D1",
    "SELECT event_type AS topic, count(*) AS n_messages, format('{:,}', count(*)) AS n_display "
    "FROM events GROUP BY event_type",
)
def message_count_display(spark: SparkSession, sf: str) -> DataFrame:
    counts = S.message_counts(_history(spark, sf))
    return counts.withColumn("n_display", S.count_display("n_messages"))


# --- B: decode, projection, schema ----------------------------------------


@query(
    "json_decode",
    "B1",
    "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events",
)
def json_decode(spark: SparkSession, sf: str) -> DataFrame:
    """Decode a JSON text column with a schema inferred from a sample."""
    msgs = table(spark, sf, "events").select("event_id", F.col("props").alias("value"))
    schema = J.infer_schema(msgs)
    return J.decode(msgs, schema, keep=["event_id"])


@query(
    "json_flatten",
    "B2",
    "SELECT event_id, user_id AS u_id, event_type AS u_d_t, "
    "CAST(json_extract(props, '$.k') AS BIGINT) AS p_k FROM events",
)
def json_flatten(spark: SparkSession, sf: str) -> DataFrame:
    """Nested objects flattened to one column per leaf at any depth."""
    ev = table(spark, sf, "events")
    props_schema = T.StructType([T.StructField("k", T.LongType())])
    nested = ev.select(
        F.to_json(
            F.struct(
                "event_id",
                F.struct(F.col("user_id").alias("id"), F.struct(F.col("event_type").alias("t")).alias("d")).alias("u"),
                F.from_json("props", props_schema).alias("p"),
            )
        ).alias("value")
    )
    schema = J.infer_schema(nested)
    return J.flatten(J.decode(nested, schema), sep="_")


@query("json_array_rows", "B3", "SELECT event_id, value FROM events")
def json_array_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Messages holding an array of objects give one row per element; lone
    objects take the same path.  Messages group at most 64 consecutive
    events of a user, so no message grows with a hot user."""
    ev = table(spark, sf, "events")
    items = ev.groupBy("user_id", F.floor(F.col("event_id") / 64).alias("blk")).agg(
        F.collect_list(F.struct("event_id", "value")).alias("items")
    )
    msgs = items.select(
        F.when(F.size("items") == 1, F.to_json(F.col("items")[0])).otherwise(F.to_json("items")).alias("value")
    )
    schema = J.infer_schema(msgs)
    return J.decode(msgs, schema)


def _damaged_messages(spark: SparkSession, sf: str) -> DataFrame:
    """Messages of (event_id, value) with some cut (first byte removed),
    NULL (tombstones) and wrong-typed (value as text), chosen by the md5 of
    the id."""
    ev = table(spark, sf, "events")
    h = F.substring(F.md5(F.col("event_id").cast("string")), 1, 1)
    good = F.to_json(F.struct("event_id", "value"))
    wrong = F.to_json(F.struct("event_id", F.col("value").cast("string").alias("value")))
    value = (
        F.when(h == "0", F.expr("substring(to_json(struct(event_id, value)), 2)"))
        .when(h == "f", F.lit(None).cast("string"))
        .when(h == "1", wrong)
        .otherwise(good)
    )
    return ev.select(value.alias("value"))


DAMAGED_SCHEMA = T.StructType([T.StructField("event_id", T.LongType()), T.StructField("value", T.DoubleType())])


@query(
    "malformed_skipped",
    "B4",
    f"SELECT event_id, CASE WHEN {MD5_FIRST} = '1' THEN NULL ELSE value END AS value FROM events "
    f"WHERE {MD5_FIRST} NOT IN ('0', 'f')",
)
def malformed_skipped(spark: SparkSession, sf: str) -> DataFrame:
    """Unreadable and empty messages are skipped; a wrong-typed leaf is
    NULL."""
    return J.decode(_damaged_messages(spark, sf), DAMAGED_SCHEMA)


@query(
    "quarantine_counts",
    "B4",
    f"SELECT CASE {MD5_FIRST} WHEN '0' THEN 'unreadable' WHEN 'f' THEN 'empty' WHEN '1' THEN 'wrong_type' "
    "ELSE 'ok' END AS status, count(*) AS n_messages FROM events GROUP BY 1",
)
def quarantine_counts(spark: SparkSession, sf: str) -> DataFrame:
    msgs = _damaged_messages(spark, sf)
    return msgs.groupBy(J.classify(msgs, DAMAGED_SCHEMA).alias("status")).agg(F.count(F.lit(1)).alias("n_messages"))


@query(
    "quarantine_stream",
    "B4",
    f"SELECT CASE {MD5_FIRST} WHEN '0' THEN 'unreadable' ELSE 'wrong_type' END AS reason, count(*) AS n_messages "
    f"FROM events WHERE {MD5_FIRST} IN ('0', '1') GROUP BY 1",
)
def quarantine_stream(spark: SparkSession, sf: str) -> DataFrame:
    """Damaged messages of a topic kept aside by a stream, with a reason."""
    path = scratch_path(spark, "damaged-topic")
    target = TopicSource("damaged", path=path)
    publish(_damaged_messages(spark, sf), target)
    sub = subscribe(spark, replace(target, max_per_trigger=1), schema=DAMAGED_SCHEMA)
    _, qpath = start_quarantine(spark, sub)
    return spark.read.parquet(qpath).groupBy("reason").agg(F.count(F.lit(1)).alias("n_messages"))


#: Messages of ``lossless_decode`` by ``event_id % 8`` (SQL over ``id``, the id as text);
#: 2**53 + 2 + an odd id is a whole number that no double holds.
_LOSSLESS = {
    0: """'{"event_id":' || id || ',"value":' || id || '.5}'""",
    1: """'{"event_id":' || id || ',"value":1.5}{"event_id":' || id || '}'""",
    2: """'{"event_id":' || id || ',"value":2.5} and more'""",
    3: """'{"event_id":' || id || ',"value":' || CAST(9007199254740994 + event_id AS VARCHAR(20)) || '}'""",
    4: """'{"event_id":0,"event_id":' || id || ',"value":4.5}'""",
    5: """'{"event_id":' || id || ',"value":"' || id || '"}'""",
    6: """'{"event_id":' || id || ',"value":6.5,"more":{"a":[' || id || ']}}'""",
    7: """'[{"event_id":' || id || ',"value":7.5},{"event_id":-' || id || ',"value":null}]'""",
}
_LOSSLESS_TEXT = "CASE event_id % 8 " + " ".join(f"WHEN {k} THEN {v}" for k, v in _LOSSLESS.items()) + " END"


@query(
    "lossless_decode",
    "B1 B4 A5",
    f"""
WITH m AS (SELECT event_id, id, event_id % 8 AS kind, {_LOSSLESS_TEXT} AS text FROM (SELECT event_id, CAST(event_id AS VARCHAR) AS id FROM events))
SELECT 'row' AS kept_as, event_id,
  CASE kind WHEN 0 THEN event_id + 0.5 WHEN 3 THEN CAST(9007199254740994 + event_id AS DOUBLE) WHEN 4 THEN 4.5 WHEN 6 THEN 6.5 WHEN 7 THEN 7.5 END AS value,
  CASE kind WHEN 3 THEN CAST(9007199254740994 + event_id AS VARCHAR) WHEN 4 THEN text WHEN 5 THEN id WHEN 6 THEN '{{"a":[' || id || ']}}' END AS rest,
  CAST(NULL AS VARCHAR) AS reason FROM m WHERE kind NOT IN (1, 2)
UNION ALL SELECT 'row', -event_id, NULL, NULL, NULL FROM m WHERE kind = 7
UNION ALL SELECT 'quarantine', NULL, NULL, text, CASE kind WHEN 5 THEN 'wrong_type' WHEN 3 THEN 'inexact' ELSE 'unreadable' END
FROM m WHERE kind IN (1, 2, 3, 5)
""",
)
def lossless_decode(spark: SparkSession, sf: str) -> DataFrame:
    """A topic with second objects, text behind objects, numbers beyond 2**53 in a DOUBLE
    column, repeated keys, other types and unknown fields: what the typed row does not
    hold is in ``_rescued`` or in the quarantine."""
    ev = table(spark, sf, "events").select("event_id", F.col("event_id").cast("string").alias("id"))
    src = TopicSource("lossless", path=scratch_path(spark, "topic-files"))
    publish(ev.select(F.expr(_LOSSLESS_TEXT.replace("VARCHAR(20)", "STRING")).alias("value")), src)
    sub = subscribe(spark, src, schema=DAMAGED_SCHEMA)
    ingest(spark, sub)
    _, quarantine = start_quarantine(spark, sub)
    rest = F.coalesce(*[F.get_json_object("_rescued", f"$.{c}") for c in ("value", "more", "_message")])
    rows = sub.history(spark).select(F.lit("row").alias("kept_as"), "event_id", "value", rest.alias("rest"), F.lit(None).cast("string").alias("reason"))
    bad = spark.read.parquet(quarantine).select(
        F.lit("quarantine").alias("kept_as"), F.lit(None).cast("bigint").alias("event_id"), F.lit(None).cast("double").alias("value"),
        F.col("value").alias("rest"), "reason",
    )
    return rows.unionByName(bad)


@query(
    "ingest_two_outputs",
    "A5 B4 A1",
    "WITH m AS (SELECT event_id % 8 AS kind FROM events) "
    "SELECT 'rows' AS output, CAST(NULL AS VARCHAR) AS reason, sum(CASE WHEN kind = 7 THEN 2 WHEN kind IN (1, 2) THEN 0 ELSE 1 END)::BIGINT AS n FROM m "
    "UNION ALL SELECT 'quarantine', CASE kind WHEN 5 THEN 'wrong_type' WHEN 3 THEN 'inexact' ELSE 'unreadable' END AS r, count(*) "
    "FROM m WHERE kind IN (1, 2, 3, 5) GROUP BY r",
)
def ingest_two_outputs(spark: SparkSession, sf: str) -> DataFrame:
    """The messages of ``lossless_decode`` ingested by one stream that reads each once and
    commits rows and quarantine together."""
    ev = table(spark, sf, "events").select("event_id", F.col("event_id").cast("string").alias("id"))
    src = TopicSource("two", path=scratch_path(spark, "topic-files"), max_per_trigger=2)
    publish(ev.repartition(4).select(F.expr(_LOSSLESS_TEXT.replace("VARCHAR(20)", "STRING")).alias("value")), src)
    sub = subscribe(spark, src, schema=DAMAGED_SCHEMA, quarantine=True)
    ingest(spark, sub)
    n = F.count(F.lit(1)).alias("n")
    rows = sub.history(spark).agg(n).select(F.lit("rows").alias("output"), F.lit(None).cast("string").alias("reason"), "n")
    return rows.unionByName(sub.quarantined(spark).groupBy(F.lit("quarantine").alias("output"), "reason").agg(n))


@query(
    "topic_coordinates",
    "A1 A3 F3",
    "SELECT event_id, value FROM events, (SELECT max(event_id) // 10 * 9 AS c FROM events) WHERE event_id >= c",
)
def topic_coordinates(spark: SparkSession, sf: str) -> DataFrame:
    """A Parquet topic in two stretches: the messages behind the newest offset of every
    partition that the first ingest has seen."""
    ev = table(spark, sf, "events").select("event_id", "value")
    late = F.col("event_id") >= F.lit(ev.agg(F.max("event_id")).first()[0] // 10 * 9)
    src = TopicSource("coords", fmt="parquet", path=scratch_path(spark, "topic-files"))
    publish(to_messages(ev.where(~late).repartition(4)), src)
    sub = subscribe(spark, src, schema=DAMAGED_SCHEMA)
    ingest(spark, sub)
    path = scratch_path(spark, "offsets")
    sub.history(spark).groupBy("_partition").agg(F.max("_offset").alias("newest")).write.parquet(path)
    publish(to_messages(ev.where(late).repartition(2)), src)
    ingest(spark, sub)
    behind = sub.history(spark).join(spark.read.parquet(path), "_partition", "left").where(F.col("newest").isNull() | (F.col("_offset") > F.col("newest")))
    return behind.select("event_id", "value")


_SCHEMA_ATTRS = [("event_id", "bigint"), ("l", "array<bigint>"), ("m", "string"), ("n", "double"), ("o_x", "bigint"), ("o_y", "string"), ("z", "string")]


@query(
    "schema_by_batches",
    "B5 A3",
    "WITH e AS (SELECT event_id, event_id * 10 // (max(event_id) OVER () + 1) AS tenth FROM events) "
    + " UNION ALL ".join(f"SELECT DISTINCT '{n}' AS name, '{t}' AS type, true AS same_as_at_once FROM e" for n, t in _SCHEMA_ATTRS)
    + " UNION ALL SELECT DISTINCT 'f' || CAST(tenth AS VARCHAR), 'bigint', true FROM e",
)
def schema_by_batches(spark: SparkSession, sf: str) -> DataFrame:
    """A topic whose messages change their shape every tenth: the schema merged over its
    micro-batches, and whether it is the schema of all messages observed at once."""
    ev = table(spark, sf, "events").select("event_id")
    tenth = F.floor(F.col("event_id") * 10 / F.lit(ev.agg(F.max("event_id") + 1).first()[0])).cast("int")
    d = F.col("tenth")
    value = F.concat(
        F.lit('{"event_id":'), F.col("event_id"), F.lit(',"n":'), F.when(d < 5, F.lit("3")).otherwise(F.lit("3.25")),
        F.lit(',"m":'), F.when(d % 2 == 0, F.lit("3")).otherwise(F.lit('"x"')), F.lit(',"f'), d, F.lit('":1,"o":'),
        F.when(d < 3, F.lit('{"x":1}')).otherwise(F.lit('{"x":1,"y":"t"}')),
        F.lit(',"l":'), F.when(d < 7, F.lit("[]")).otherwise(F.lit("[1]")), F.lit(',"z":null}'),
    )
    src = TopicSource("shapes", path=scratch_path(spark, "topic-files"), max_per_trigger=1)
    publish(ev.repartitionByRange(10, "event_id").withColumn("tenth", tenth).select(value.alias("value")), src)
    log = SchemaLog(spark, scratch_path(spark, "schema-log"))
    track_schema(read_stream(spark, src), log, scratch_path(spark, "schema-checkpoint"))
    merged = pinned(log.current()[1])
    at_once = dict(J.attributes(pinned(observed_schema(read_batch(spark, src)))))
    attributes = [(name, kind, at_once.get(name) == kind and len(at_once) == len(J.attributes(merged))) for name, kind in J.attributes(merged)]
    return spark.createDataFrame(attributes, "name string, type string, same_as_at_once boolean")


_ATTRS = [
    ("event_id", "bigint"),
    ("event_type", "string"),
    ("props", "string"),
    ("ts", "string"),
    ("user_id", "bigint"),
    ("value", "double"),
]


@query(
    "attributes",
    "B5",
    " UNION ALL ".join(f"SELECT '{n}' AS name, '{t}' AS type, count({n}) AS n_present FROM events" for n, t in _ATTRS),
)
def attributes(spark: SparkSession, sf: str) -> DataFrame:
    """Attribute catalogue of a topic: name and type from the inferred
    schema, and how many messages carry each attribute (one aggregate)."""
    messages = to_messages(table(spark, sf, "events"))
    schema = J.infer_schema(messages)
    rows = J.flatten(J.decode(messages, schema))
    attrs = J.attributes(schema)
    counts = rows.agg(*[F.count(F.col(f"`{n}`")).alias(f"c{i}") for i, (n, _) in enumerate(attrs)])
    stack = ", ".join(f"'{n}', '{t}', c{i}" for i, (n, t) in enumerate(attrs))
    return counts.selectExpr(f"stack({len(attrs)}, {stack}) AS (name, type, n_present)")


@query(
    "train_projection",
    "B6 B7",
    "SELECT event_type, user_id, value AS label FROM events",
)
def train_projection(spark: SparkSession, sf: str) -> DataFrame:
    spec = ModelSpec("events", "regression", "decision_tree", "value", ("event_type", "user_id"))
    return training_projection(table(spark, sf, "events"), spec)


@query("series_xy", "B8", "SELECT event_type AS x, value AS y FROM events")
def series_xy(spark: SparkSession, sf: str) -> DataFrame:
    return S.series_xy(table(spark, sf, "events"), "event_type", "value")


@query(
    "series_by_time",
    "B9 B10 D3",
    "SELECT event_type AS topic, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS seq, "
    "value AS y FROM events",
)
def series_by_time(spark: SparkSession, sf: str) -> DataFrame:
    """Value against the sequence axis, newest message first per topic."""
    return S.series_by_time(_history(spark, sf), "value", ["ts", "event_id"], ["topic"], newest_first=True)


@query(
    "series_by_time_null_group",
    "B9 D3",
    "WITH ev AS (SELECT event_id, ts, value, CASE WHEN user_id % 2 = 1 THEN user_id END AS grp FROM events) "
    "SELECT grp, row_number() OVER (PARTITION BY grp ORDER BY ts DESC, event_id DESC) AS seq, value AS y FROM ev",
)
def series_by_time_null_group(spark: SparkSession, sf: str) -> DataFrame:
    """The sequence axis where half of the rows have no (numeric) group."""
    ev = table(spark, sf, "events").withColumn("grp", F.when(F.col("user_id") % 2 == 1, F.col("user_id")))
    return S.series_by_time(ev, "value", ["ts", "event_id"], ["grp"], newest_first=True)


# --- C: filters and top-k --------------------------------------------------

_LATEST_SQL = (
    "SELECT event_type AS topic, event_id, ts, user_id, value, props FROM events "
    "QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) = 1"
)


@query("latest_message_stream", "C1 A4", _LATEST_SQL)
def latest_message_stream(spark: SparkSession, sf: str) -> DataFrame:
    """Newest message per topic maintained by a streaming aggregation over
    several micro-batches (arrival order differs from event order)."""
    src = stage_topic(spark, table(spark, sf, "events"), topic_col="event_type", files=3)
    sub = subscribe(spark, replace(src, max_per_trigger=4), hints=EVENT_HINTS)
    _, log = live_latest(spark, sub, ["ts", "event_id"])
    return read_live(spark, log).select("topic", "event_id", "ts", "user_id", "value", "props")



@query("latest_message", "C1", _LATEST_SQL)
def latest_message(spark: SparkSession, sf: str) -> DataFrame:
    return S.latest(_history(spark, sf), ["ts", "event_id"], ["topic"])


@query("filter_eq", "C2", "SELECT * FROM customer WHERE c_mktsegment = 'BUILDING'")
def filter_eq(spark: SparkSession, sf: str) -> DataFrame:
    return R.where_eq(table(spark, sf, "customer"), "c_mktsegment", "BUILDING")


@query("line_by_x", "C3", "SELECT ts AS x, value AS y FROM events ORDER BY x, y")
def line_by_x(spark: SparkSession, sf: str) -> DataFrame:
    return S.line_by_x(table(spark, sf, "events"), "ts", "value")


_COLUMNS = 200


@query(
    "line_columns",
    "C3 B8",
    f"""
WITH b AS (SELECT epoch_us(min(ts)) AS lo, epoch_us(max(ts)) AS hi FROM events),
p AS (SELECT event_type AS topic, ts AS x, value AS y,
  least(floor((epoch_us(ts) - lo) * {_COLUMNS} / (hi - lo)), {_COLUMNS - 1}) AS c FROM events, b)
SELECT DISTINCT topic, x, y FROM (
  SELECT *, row_number() OVER (PARTITION BY topic, c ORDER BY x, y) AS f, row_number() OVER (PARTITION BY topic, c ORDER BY x DESC, y DESC) AS l,
    row_number() OVER (PARTITION BY topic, c ORDER BY y, x) AS lo, row_number() OVER (PARTITION BY topic, c ORDER BY y DESC, x) AS hi FROM p)
WHERE f = 1 OR l = 1 OR lo = 1 OR hi = 1
""",
)
def line_columns(spark: SparkSession, sf: str) -> DataFrame:
    """Lines of all topics at 200 pixel columns, merged from two halves of the history."""
    hist = _history(spark, sf).select("topic", "event_id", "ts", "value")
    lo, hi = hist.agg(F.min("ts"), F.max("ts")).first()
    halves = [S.line_columns(hist.where(F.col("event_id") % 2 == k), "ts", "value", lo, hi, _COLUMNS, ["topic"]) for k in (0, 1)]
    return S.line_points(S.merge_line_columns(*halves, partition_by=["topic"]), ["topic"])


# --- D: aggregations -------------------------------------------------------


@query(
    "bar_by_x",
    "D2",
    "SELECT user_id AS x, "
    "round(coalesce(sum(CASE WHEN value - 50 >= 0 THEN value - 50 END), 0), 6) AS pos_height, "
    "round(coalesce(sum(CASE WHEN value - 50 < 0 THEN value - 50 END), 0), 6) AS neg_height, "
    "count(*) AS n_bars FROM events GROUP BY user_id",
)
def bar_by_x(spark: SparkSession, sf: str) -> DataFrame:
    """Stacked bar heights of a signed series (value - 50) per user."""
    signed = table(spark, sf, "events").withColumn("signed", F.col("value") - 50)
    bars = S.stacked_bars(signed, "user_id", "signed")
    return bars.select("x", r6("pos_height").alias("pos_height"), r6("neg_height").alias("neg_height"), "n_bars")


# --- F: set operations -----------------------------------------------------


@query(
    "history_union",
    "F1",
    "SELECT event_id, ts, CASE WHEN event_type = 'click' THEN value END AS value, "
    "CASE WHEN event_type <> 'click' THEN user_id END AS user_id FROM events",
)
def history_union(spark: SparkSession, sf: str) -> DataFrame:
    """Rows of two topics with different attributes, bound by name."""
    ev = table(spark, sf, "events")
    a = ev.where(F.col("event_type") == "click").select("event_id", "ts", "value")
    b = ev.where(F.col("event_type") != "click").select("event_id", "ts", "user_id")
    return X.union_by_name(a, b)


_CUT = "TIMESTAMP '2024-01-20 00:00:00'"
_UNTIL = "TIMESTAMP '2024-01-25 00:00:00'"


def _ntz(text: str):
    return F.to_timestamp_ntz(F.lit(text))


@query(
    "new_rows",
    "F2",
    "SELECT event_id, ts, event_type, value FROM events EXCEPT "
    f"SELECT event_id, ts, event_type, value FROM events WHERE ts < {_CUT}",
)
def new_rows(spark: SparkSession, sf: str) -> DataFrame:
    """History rows not in the previous build (set difference)."""
    hist = table(spark, sf, "events").select("event_id", "ts", "event_type", "value")
    previous = hist.where(F.col("ts") < _ntz("2024-01-20 00:00:00"))
    return X.new_rows(hist, previous)


@query(
    "new_rows_bag",
    "F2",
    "(SELECT event_id, event_type, value FROM events UNION ALL "
    "SELECT event_id, event_type, value FROM events WHERE event_type = 'click') EXCEPT ALL "
    "SELECT event_id, event_type, value FROM events",
)
def new_rows_bag(spark: SparkSession, sf: str) -> DataFrame:
    """Bag difference: a message delivered twice and built once stays once."""
    ev = table(spark, sf, "events").select("event_id", "event_type", "value")
    history = ev.unionByName(ev.where(F.col("event_type") == "click"))
    return X.new_rows(history, ev, bag=True)


_RANGE_EDITS = (
    "cur AS (SELECT event_id, event_type, value FROM events UNION ALL SELECT event_id, event_type, value FROM events WHERE event_id % 500 = 3), "
    "old AS (SELECT event_id, event_type, CASE WHEN event_id % 700 = 5 THEN value + 1 ELSE value END AS value FROM events) "
)


@query("new_rows_by_range", "F2", f"WITH {_RANGE_EDITS} (SELECT * FROM cur EXCEPT ALL SELECT * FROM old)")
def new_rows_by_range(spark: SparkSession, sf: str) -> DataFrame:
    """Bag difference of two histories that differ in a few rows: only ranges of 100 ids
    whose fingerprints differ are compared."""
    ev = table(spark, sf, "events").select("event_id", "event_type", "value")
    current = ev.unionByName(ev.where(F.col("event_id") % 500 == 3))
    old = ev.withColumn("value", F.when(F.col("event_id") % 700 == 5, F.col("value") + 1).otherwise(F.col("value")))
    return X.new_rows_by_range(current, old, "event_id", 100, bag=True)


@query(
    "new_rows_by_offset",
    "F3",
    f"SELECT event_id, ts, event_type, value FROM events WHERE ts > {_CUT} AND ts <= {_UNTIL}",
)
def new_rows_by_offset(spark: SparkSession, sf: str) -> DataFrame:
    hist = table(spark, sf, "events").select("event_id", "ts", "event_type", "value")
    return X.new_rows_since(hist, "ts", _ntz("2024-01-20 00:00:00"), _ntz("2024-01-25 00:00:00"))


# --- I: table operations ---------------------------------------------------


@query("natural_join", "I1", "SELECT * FROM documents NATURAL JOIN labels")
def natural_join(spark: SparkSession, sf: str) -> DataFrame:
    return R.natural_join(table(spark, sf, "documents"), table(spark, sf, "labels"))


_UPDATE_SQL = (
    "SELECT c_custkey, c_name, c_nationkey, "
    "CASE WHEN c_mktsegment = 'AUTOMOBILE' THEN 0.0 ELSE c_acctbal END AS c_acctbal, c_mktsegment FROM customer"
)


def _update(df: DataFrame) -> DataFrame:
    return R.conditional_update(df, "c_acctbal", F.col("c_mktsegment") == "AUTOMOBILE", 0.0)


@query("conditional_update", "I2", _UPDATE_SQL)
def conditional_update(spark: SparkSession, sf: str) -> DataFrame:
    return _update(table(spark, sf, "customer"))


@query("table_overwrite_roundtrip", "I3", _UPDATE_SQL)
def table_overwrite_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    """Create if absent, append, overwrite from the table itself, read."""
    store = R.TableStore(spark, scratch_path(spark, "tables"))
    name = f"profiles_{uuid.uuid4().hex[:8]}"
    cust = table(spark, sf, "customer")
    store.create_if_absent(name, cust.where(F.col("c_mktsegment") != "AUTOMOBILE"))
    store.append(name, cust.where(F.col("c_mktsegment") == "AUTOMOBILE"))
    if store.create_if_absent(name, cust):
        raise AssertionError("create_if_absent replaced an existing table")
    store.overwrite(name, _update(store.read(name)))
    return store.read(name)
