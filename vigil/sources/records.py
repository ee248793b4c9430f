"""Newline-delimited JSON records in and out.

A record counts only if all its keys are present and well formed; any other line is dropped. A key's value is what
follows its first occurrence, up to the closing quote or else to the next comma or brace, so numbers may be quoted and
of repeated keys the first counts, even if it is malformed. Floating-point numbers are those of C, hexadecimal ones
included. Lines are flat objects without escapes; each is searched once for the names of all keys and once for values. ``id`` is assigned in arrival order, so it
stands for the order of lines, which a distributed scan doesn't keep.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vigil.schema import ALERT, EVENT, EVENT_TYPES, RULE, RULE_KINDS

_FLAGS = ("approved", "present")
_WIRE_EVENT = T.StructType([T.StructField(f.name, T.LongType() if f.name in _FLAGS else f.dataType) for f in EVENT])
_HEX = r"(?i)^\s*[+-]?0x([0-9a-f]+\.?[0-9a-f]*|\.[0-9a-f]+)(p[+-]?[0-9]+)?$"
_WORDS = r"(?i)^\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)(e[+-]?[0-9]+)?$|^\s*[+-]?(inf|infinity|nan)$"


def _value(found: Column, kind: T.DataType) -> Column:
    """A value as found in a line, with its quotes or the sign that ends it; null if it has no end or is malformed."""
    quoted = F.startswith(found, F.lit('"'))
    raw = F.when(quoted, F.substr(found, F.lit(2), F.length(found) - 2)).otherwise(F.left(found, F.length(found) - 1))
    out, bare = raw, lambda x: F.btrim(x, F.lit(" \t\n\x0b\f\r")).try_cast(kind)
    if kind == T.LongType():  # of what has these signs only, a cast takes what is a number
        out = F.when(F.translate(raw, "0123456789-", "") == "", raw.try_cast(kind))
    if kind == T.DoubleType():  # so here; then other forms, of which Java wants an exponent of hexadecimal ones
        out = F.when(F.translate(raw, "0123456789.+-eE", "") == "", raw.try_cast(kind)).when(raw.rlike(_WORDS), bare(raw))
        out = out.when(raw.rlike(_HEX), bare(F.when(F.contains(F.lower(raw), F.lit("p")), raw).otherwise(F.concat(raw, F.lit("p0")))))
    return F.when(found != "", out)


def _complete(lines: DataFrame, schema: T.StructType, text: Column) -> DataFrame:
    # values are looked at without being taken: the quote that ends one may begin the next key
    found = F.struct(
        F.regexp_extract_all(text, F.lit(r'"(\w+)":'), F.lit(1)).alias("keys"),
        F.regexp_extract_all(text, F.lit(r'"\w+":(?=("[^"]*"|(?!")[^,}]*[,}])?)'), F.lit(1)).alias("values"),
    )
    first = F.struct(*[F.get("values", (F.array_position("keys", c) - 1).cast("int")).alias(c) for c in schema.names])
    value = F.struct(*[_value(F.col(f.name), f.dataType).alias(f.name) for f in schema])
    # each step is generated from an array of one: what is asked of it stays above, so that no step is done twice
    row = lines.select(F.inline(F.array(found))).select(F.inline(F.array(first))).select(F.inline(F.array(value)))
    return row.na.drop("any")


def parse_events(lines: DataFrame, column: str = "value") -> DataFrame:
    """EVENT rows of JSON lines."""
    rows = _complete(lines, _WIRE_EVENT, F.col(column)).filter(F.col("type").isin(*EVENT_TYPES))
    return rows.select(*[(F.col(f.name) != 0 if f.name in _FLAGS else F.col(f.name)).alias(f.name) for f in EVENT])


def parse_rules(lines: DataFrame, column: str = "value") -> DataFrame:
    """RULE rows of JSON lines."""
    return _complete(lines, RULE, F.col(column)).filter(F.col("kind").isin(*RULE_KINDS))


def read_events(spark: SparkSession, path: str) -> DataFrame:
    return parse_events(spark.read.text(path))


def read_rules(spark: SparkSession, path: str) -> DataFrame:
    return parse_rules(spark.read.text(path))


def stream_events(spark: SparkSession, path: str, lateness: str = "60 seconds", **options: object) -> DataFrame:
    """A stream of EVENT rows with ``event_time`` and its watermark, from files that arrive below ``path``."""
    rows = parse_events(spark.readStream.options(**options).text(path))
    return rows.withColumn("event_time", F.timestamp_millis("ts")).withWatermark("event_time", lateness)


def event_json() -> Column:
    """An EVENT row as a JSON line, flags as 0 and 1."""
    return F.to_json(F.struct(*[(F.col(f.name).cast("int") if f.name in _FLAGS else F.col(f.name)).alias(f.name) for f in EVENT]))


def alert_json() -> Column:
    return F.to_json(F.struct(*ALERT.names))


def write_alerts(alerts: DataFrame, path: str, by_pattern: bool = False) -> None:
    """Write alerts as JSON lines, in one folder for each pattern if so wanted."""
    rows = alerts.select(*(["pattern"] if by_pattern else []), alert_json().alias("value"))
    writer = rows.write.partitionBy("pattern") if by_pattern else rows.write
    writer.text(path)
