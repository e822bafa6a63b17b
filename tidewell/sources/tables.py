"""Tables as log lines (labels, ts_ns, line, seq) and metric samples (labels, ts_ms, value, is_stale)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EPOCH = "TIMESTAMP_NTZ '1970-01-01 00:00:00'"


def micros(ts: Column) -> Column:
    """Microseconds since the epoch of a timestamp with or without zone (UTC)."""
    return F.unix_micros(ts.cast("timestamp"))


def label_map(**values: Column) -> Column:
    """Label map without null and empty values."""
    pairs = F.map_from_arrays(F.array(*[F.lit(k) for k in values]), F.array(*[v.cast("string") for v in values.values()]))
    return F.map_filter(pairs, lambda _, v: v.isNotNull() & (v != ""))


def event_lines(events: DataFrame) -> DataFrame:
    """Events as log lines; the line is the JSON text of the properties."""
    labels = label_map(source=F.lit("events"), event_type=F.col("event_type"))
    return events.select(labels.alias("labels"), (micros(F.col("ts")) * 1000).alias("ts_ns"), F.col("props").alias("line"), F.col("event_id").alias("seq"))


def event_samples(events: DataFrame) -> DataFrame:
    """Events as samples of a gauge, one series for each type of event."""
    labels = label_map(__name__=F.lit("event_value"), event_type=F.col("event_type"))
    return events.select(labels.alias("labels"), F.floor(micros(F.col("ts")) / 1000).cast("long").alias("ts_ms"), F.col("value"), F.lit(False).alias("is_stale"))


def container_lines(rows: DataFrame) -> DataFrame:
    """Container log rows as lines, one for each (source, seq); the newline is not part of the line."""
    once = rows.where(F.col("log").isNotNull()).groupBy("source", "seq").agg(F.min(F.struct("time_ns", "log", "stream")).alias("r"), F.first("labels", True).alias("labels"))
    stream = label_map(stream=F.col("r.stream"), source=F.col("source"))
    own = F.map_filter(F.coalesce("labels", F.create_map().cast("map<string,string>")), lambda k, _: ~k.isin("stream", "source"))
    return once.select(F.map_concat(own, stream).alias("labels"), F.col("r.time_ns").alias("ts_ns"), F.rtrim(F.col("r.log"), F.lit("\r\n")).alias("line"), "seq")
