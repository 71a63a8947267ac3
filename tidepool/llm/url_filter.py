"""URL filters by a sort-merge range join (operator 11).

A rule is (host, path, verdict): it fits its host and every subdomain where the
url's path starts with the rule's, and the longest fitting rule wins (by
code points of host and path together, then of the host).  Two canonical keys turn that
into intervals of bytes, because all keys with one prefix lie together:

- hosts: labels reversed, each with a dot behind (``com.example.``);
- paths: the rule's host, byte FF (which no UTF-8 text holds), the path.

Rules' intervals nest or are apart.  A first sweep over the rules' starts and ends
(a running sum of +1 and -1) gives each rule its nesting level.  A second sweep runs
over rules and urls sorted together and keeps a stack of active rules, a slot a
level: a start fills its level's slot, and a rule whose interval has ended counts no
more.  The host sweep finds the rule hosts above a url (at most its labels), the path
sweep the longest path rule of each of them; the longest of these is the verdict.

Everything is DataFrame functions.  Rows are dealt by ranges of the sorted key with a
hash behind it, so one host, or one url, with a third of all rows spans many tasks; each
range gets the stack that is open where it begins (a row a range), so no window
holds more than one range and nothing is broadcast or collected but the nesting depth.

Defined results: a null url, or one without ``://``, has empty host and path (an empty
path fits only an empty rule path); no fitting rule gives a null rule and the default
verdict; of equal rules with different verdicts ``block`` wins; rules with a null part
are left out; repeated urls and ids give a row each; empty tables give empty results.
Only the two named columns are read, so others cannot clash.
"""

from __future__ import annotations

import string
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.prefix import ordered_prefix
from .common import LlmQuery, table, written

ALLOW, BLOCK = "allow", "block"
#: (host, path, verdict) of the registered query.
RULES = (
    ("com", "/", ALLOW),
    ("example.com", "/en/", BLOCK),
    ("www.example.com", "/en/", ALLOW),
    ("net", "/es/", BLOCK),
    ("net", "/fr/", BLOCK),
)


def _after(prefix: Column | str) -> Column:
    """The least byte string above all that start with ``prefix``."""
    return F.concat(prefix, F.unhex(F.lit("FF")))


def lower_ascii(text: Column) -> Column:
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; both empty without ``://``."""
    at = F.locate("://", F.coalesce(url, F.lit("")))
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(F.substr(rest, F.length(host) + 1), "^[^?#]*", 0)
    return lower_ascii(host), path


def host_key(host: Column) -> Column:
    return F.encode(F.concat(F.array_join(F.reverse(F.split(host, "[.]", -1)), "."), F.lit(".")), "UTF-8")


def path_key(host: Column, path: Column) -> Column:
    return F.concat(_after(F.encode(host, "UTF-8")), F.encode(path, "UTF-8"))


def nested(intervals: DataFrame) -> tuple[DataFrame, int]:
    """``intervals`` (distinct ``lo``) with ``level``, the number of intervals open at
    their start, themselves included; and the greatest level."""
    starts = intervals.select(F.col("lo").alias("at"), F.lit(1).alias("step"), F.struct(*intervals.columns).alias("own"))
    ends = intervals.select(_after("lo").alias("at"), F.lit(-1).alias("step"))
    running = ordered_prefix(starts.unionByName(ends, allowMissingColumns=True), ["at"], sums={"level": "step"})
    levels = written(running.where(F.col("step") == 1).select("own.*", F.col("level").cast("int").alias("level")), "url-rules")
    return levels, int(levels.agg(F.max("level")).first()[0] or 0)


def active_rules(points: DataFrame, rules: DataFrame) -> DataFrame:
    """``points`` (a column ``at``) with ``stack``, the ``rule`` values of all intervals
    ``[lo, lo + FF)`` of ``rules`` that hold ``at``, outermost first."""
    levels, depth = nested(rules)
    kind = rules.schema["rule"].dataType.simpleString()
    row = F.struct(*points.columns)
    if depth == 0:
        return points.withColumn("stack", F.array().cast(f"array<{kind}>"))
    starts = levels.select(
        F.col("lo").alias("at"), F.lit(0).alias("side"), F.lit(0).cast("bigint").alias("spread"),
        "level", F.struct("lo", "rule").alias("start"),
    )
    urls = points.select("at", F.lit(1).alias("side"), F.xxhash64(*points.columns).alias("spread"), row.alias("url"))
    order = ["at", "side", "spread"]
    ranged = urls.unionByName(starts, allowMissingColumns=True).repartitionByRange(*order).withColumn("range", F.spark_partition_id())
    staged = written(ranged, "url-sweep")

    slots = [f"slot_{n}" for n in range(1, depth + 1)]
    own = {s: F.when(F.col("level") == n, F.col("start")) for n, s in enumerate(slots, 1)}
    last_of = staged.groupBy("range").agg(*[F.max_by(c, F.when(c.isNotNull(), F.col("at"))).alias(s) for s, c in own.items()])
    before = Window.partitionBy(F.lit(0)).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    open_at = last_of.select("range", F.lit(-1).alias("side"), *[F.last(s, ignorenulls=True).over(before).alias(s) for s in slots])
    rows = staged.withColumns(own).drop("start", "level").unionByName(open_at, allowMissingColumns=True)
    sweep = Window.partitionBy("range").orderBy(F.col("side") >= 0, *order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    seen = rows.withColumns({s: F.last(s, ignorenulls=True).over(sweep) for s in slots}).where(F.col("side") == 1)

    def holds(slot: Column) -> Column:
        return slot.isNotNull() & (F.col("at") < _after(slot["lo"]))

    stack = F.transform(F.filter(F.array(*slots), holds), lambda slot: slot["rule"])
    return seen.select("url.*", stack.alias("stack"))


def judge(urls: DataFrame, rules: DataFrame, key: str = "page_id", url: str = "url", default: str = ALLOW) -> DataFrame:
    """``key, host, path, rule, verdict`` of every url; ``rules`` has ``host, path, verdict``."""
    given = rules.select(lower_ascii(F.col("host")).alias("host"), "path", "verdict").dropna()
    given = given.groupBy("host", "path").agg(F.max(F.struct(F.col("verdict") == BLOCK, "verdict"))["verdict"].alias("verdict"))
    hosts = given.select("host").distinct().select(host_key(F.col("host")).alias("lo"), F.col("host").alias("rule"))
    paths = given.select(
        path_key(F.col("host"), F.col("path")).alias("lo"),
        F.struct((F.length("host") + F.length("path")).alias("length"), F.length("host").alias("host_length"),
                 F.concat("host", "path").alias("rule"), "verdict").alias("rule"),
    )
    host, path = url_parts(F.col(url).cast("string"))
    points = urls.select(F.col(key).alias("key"), host.alias("host"), path.alias("path"))
    points = points.withColumn("row", F.monotonically_increasing_id()).withColumn("at", host_key(F.col("host")))
    above = written(active_rules(points, hosts).drop("at"), "url-hosts")
    under = above.select("row", F.explode("stack").alias("rule_host"), "path").select("row", path_key(F.col("rule_host"), F.col("path")).alias("at"))
    best = active_rules(under, paths).where(F.size("stack") > 0).groupBy("row").agg(F.max(F.try_element_at("stack", F.lit(-1))).alias("best"))
    return above.join(best, "row", "left").select(
        F.col("key").alias(key), "host", "path", F.col("best.rule").alias("rule"),
        F.coalesce("best.verdict", F.lit(default)).alias("verdict"),
    )


def rule_table(spark: SparkSession, rules: Iterable[tuple[str, str, str]]) -> DataFrame:
    return spark.createDataFrame(list(rules), "host string, path string, verdict string")


def _run(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"), rule_table(spark, RULES))


_VALUES = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in RULES)
SQL = f"""
WITH rest AS (
  SELECT row_number() OVER () AS id, page_id,
    CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages
), split AS (
  SELECT id, page_id, regexp_extract(rest, '^[^/?#]*') AS host, rest FROM rest
), parts AS (
  SELECT id, page_id, translate(host, '{string.ascii_uppercase}', '{string.ascii_lowercase}') AS host,
    regexp_extract(substr(rest, length(host) + 1), '^[^?#]*') AS path FROM split
), rules(rule_host, rule_path, verdict) AS (VALUES {_VALUES}
), best AS (
  SELECT id, arg_max(rule_host || rule_path, length(rule_host || rule_path)) AS rule, arg_max(verdict, length(rule_host || rule_path)) AS verdict
  FROM parts JOIN rules ON starts_with(path, rule_path) AND (host = rule_host OR ends_with(host, '.' || rule_host))
  GROUP BY id
)
SELECT page_id, host, path, rule, coalesce(best.verdict, 'allow') AS verdict FROM parts LEFT JOIN best USING (id)
"""

QUERY = LlmQuery(_run, SQL)
