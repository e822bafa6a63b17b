"""Alert instances and log counters on streams."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidewell.functions import labels as L
from tidewell.operators.alerts import OUT, TIMELINE, Instance, _whole, told_incomplete

STATE = "phase string, active_ms long, fired_ms long, missing_since long, stale boolean, flagged boolean, value double, content string, last_ms long"


def _advance(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    last = -1
    instance = Instance()
    if state.exists:
        *values, last = state.get
        instance = Instance(*values)
    rows = pd.concat(list(batches)).sort_values(["eval_ms", "observed"], ascending=[True, False])
    out = []
    for _, _, ts, observed, incomplete, flagged, value, content, for_ms, keep_ms in rows[list(TIMELINE)].itertuples(index=False):
        if ts <= last:
            continue  # repeated or late
        last = int(ts)
        t = instance.step(last, bool(observed), bool(incomplete), bool(flagged), None if pd.isna(value) else float(value), content, _whole(for_ms), _whole(keep_ms))
        if t:
            out.append((*key, t, last, instance.active_ms, instance.fired_ms, instance.value, told_incomplete(t, instance)))
    if instance.phase is None:
        if state.exists:
            state.remove()
    else:
        state.update((instance.phase, instance.active_ms, instance.fired_ms, instance.missing_since, instance.stale, instance.flagged, instance.value, instance.content, last))
    yield pd.DataFrame(out, columns=[c.split()[0] for c in OUT.split(", ")]).astype({"fired_ms": "Int64"})


def stream_transitions(timeline: DataFrame) -> DataFrame:
    """Transitions of a stream of ticks (columns of :func:`tidewell.operators.alerts.transitions`).

    A tick that is not later than the last one of its instance is ignored.
    """
    return timeline.select(*TIMELINE).groupBy("rule_id", "instance_key").applyInPandasWithState(_advance, OUT, STATE, "append", GroupStateTimeout.NoTimeout)


def stream_counts(lines: DataFrame, by: tuple[str, ...], range_s: int, *, late_s: int | None = None) -> DataFrame:
    """Lines of a stream counted by labels in buckets of a rule's counter.

    lines: ``labels, ts TIMESTAMP, line``, already filtered.  The bucket width is a
    sixtieth of the range, one second at least; lines later than ``late_s`` (the
    range if None) behind the newest are dropped.
    """
    width = max(range_s // 60, 1)
    marked = lines.withWatermark("ts", f"{range_s if late_s is None else late_s} seconds")
    group = [L.value_of(F.col("labels"), n).alias(n) for n in by]
    return marked.groupBy(F.window("ts", f"{width} seconds").alias("bucket"), *group).agg(F.count("*").alias("lines"), F.sum(F.octet_length("line")).alias("bytes")).select("bucket.start", *by, "lines", "bytes")


def counter_value(buckets: DataFrame, by: tuple[str, ...], range_s: int, at_s: int) -> DataFrame:
    """Value of a bucketed counter at a time: its older edge is rounded down to a bucket."""
    width = max(range_s // 60, 1)
    low, high = (at_s - range_s) // width * width, at_s // width * width
    start = F.unix_seconds("start")
    return buckets.where((start >= low) & (start <= high)).groupBy(*by).agg(F.sum("lines").alias("lines"), F.sum("bytes").alias("bytes"))


def apply_stream(stream: DataFrame, apply_batch, checkpoint: str, query_name: str = "feed"):
    """Start a query that hands each micro-batch to ``apply_batch(frame, batch_id)``; a repeated batch has the same id."""
    return stream.writeStream.queryName(query_name).foreachBatch(apply_batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
