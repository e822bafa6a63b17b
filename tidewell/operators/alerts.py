"""Alert instances: pending, firing, kept firing, stale, resolved.

The state of one instance is advanced tick by tick by :class:`Instance`.  In
batch, timelines are sorted by (rule, instance, time) and walked by a streaming
map, so that a partition never holds more than one batch; on a stream the same
steps run as keyed state (:mod:`tidewell.streaming.alerts`).
"""

from __future__ import annotations

from dataclasses import asdict, dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PENDING, FIRING = "pending", "firing"
OUT = "rule_id string, instance_key string, transition string, eval_ms long, active_ms long, fired_ms long, value double, incomplete boolean"
TIMELINE = ("rule_id", "instance_key", "eval_ms", "observed", "incomplete", "flagged", "value", "content", "for_ms", "keep_ms")


@dataclass
class Instance:
    """State of one alert instance between ticks."""

    phase: str | None = None
    active_ms: int = 0
    fired_ms: int | None = None
    missing_since: int | None = None
    stale: bool = False
    flagged: bool = False
    value: float | None = None
    content: str | None = None

    def step(self, ts: int, observed: bool, incomplete: bool, flagged: bool, value: float | None, content: str | None, for_ms: int, keep_ms: int) -> str | None:
        """Advance to ``ts``; the transition to tell, if any.

        content stands for the labels, annotations, summary and resources: a
        change of it is an update, a change of the value alone is none.
        """
        if observed:
            if self.phase is None:
                self.__init__(phase=PENDING, active_ms=ts)
            changed = self.stale or self.flagged != flagged or self.content != content
            self.value, self.content, self.flagged = value, content, flagged
            self.stale, self.missing_since = False, None
            if self.phase == PENDING:
                if ts - self.active_ms >= for_ms:
                    self.phase, self.fired_ms = FIRING, ts
                    return "firing"
                return None
            if ts - self.active_ms < for_ms:  # the rule now waits longer
                self.phase, self.fired_ms = PENDING, None
                return "resolved"
            return "update" if changed else None
        if self.phase is None:
            return None
        if incomplete:  # missing telemetry never resolves
            if self.phase == FIRING and not self.stale:
                self.stale = True
                return "stale"
            return None
        if self.phase == PENDING:
            self.phase = None
            return None
        if self.missing_since is None:
            self.missing_since = ts
        if ts - self.missing_since < keep_ms:
            if ts - self.active_ms < for_ms:
                self.phase, self.fired_ms, self.missing_since = PENDING, None, None
                return "resolved"
            return None
        self.phase = None
        return "resolved"

    def restore(self, down_from: int, up_at: int, tolerance_ms: int = 3_600_000) -> None:
        """After a downtime: what was pending is moved by it, or dropped beyond the tolerance."""
        if self.phase == PENDING:
            if up_at - down_from > tolerance_ms:
                self.phase = None
            else:
                self.active_ms += up_at - down_from

    def to_dict(self) -> dict:
        return asdict(self)


def told_incomplete(transition: str, state: Instance) -> bool:
    """Is a transition told as incomplete?  A stale one is, a resolved one never, others if the evaluation was flagged."""
    return transition == "stale" or transition != "resolved" and state.flagged


def transitions(timeline: DataFrame) -> DataFrame:
    """Transitions of all instances.

    timeline: one row for each (rule_id, instance_key, eval_ms) with observed,
    incomplete, flagged, value, content, for_ms and keep_ms.  Repeated rows of a
    tick count once, observed ones first; nulls of the flags count as false and
    of the durations as 0; rows with a null key or time are ignored.
    """
    rows = timeline.select(*TIMELINE).where(F.col("rule_id").isNotNull() & F.col("instance_key").isNotNull() & F.col("eval_ms").isNotNull())
    rows = rows.repartition("rule_id", "instance_key").sortWithinPartitions("rule_id", "instance_key", "eval_ms", F.desc("observed"))

    def walk(batches):
        key, state, last = None, Instance(), None
        for pdf in batches:
            out = []
            for rule, instance, ts, observed, incomplete, flagged, value, content, for_ms, keep_ms in zip(*(pdf[c].tolist() for c in TIMELINE)):
                if key != (rule, instance):
                    key, state, last = (rule, instance), Instance(), None
                if last == ts:
                    continue
                last = ts
                t = state.step(ts, observed is True, incomplete is True, flagged is True, None if value != value else value, content, _whole(for_ms), _whole(keep_ms))
                if t:
                    out.append((rule, instance, t, ts, state.active_ms, state.fired_ms, state.value, told_incomplete(t, state)))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in OUT.split(", ")]).astype({"fired_ms": "Int64"})

    return rows.mapInPandas(walk, OUT)


def _whole(x) -> int:
    return 0 if x is None or x != x else int(x)


def timeline(observed: DataFrame, ticks: DataFrame) -> DataFrame:
    """Timelines from observations and evaluations, for :func:`transitions`.

    observed: ``rule_id, instance_key, eval_ms, value, content``.  ticks: one row
    for each evaluation, ``rule_id, eval_ms, incomplete, flagged, for_ms,
    keep_ms``.  An instance is looked at from its first observation on.
    """
    seen = observed.groupBy("rule_id", "instance_key").agg(F.min("eval_ms").alias("since"))
    grid = ticks.join(seen, "rule_id").where("eval_ms >= since").drop("since")
    once = observed.groupBy("rule_id", "instance_key", "eval_ms").agg(F.max(F.struct("value", "content")).alias("o"))
    joined = grid.join(once, ["rule_id", "instance_key", "eval_ms"], "left")
    return joined.select("rule_id", "instance_key", "eval_ms", F.col("o").isNotNull().alias("observed"), "incomplete", "flagged", "o.value", "o.content", "for_ms", "keep_ms")


def single_observations(observed: DataFrame) -> DataFrame:
    """``observed`` with an error where a rule yields a key more than once in one evaluation, as the rule then fails."""
    n = observed.groupBy("rule_id", "instance_key", "eval_ms").agg(F.count("*").alias("n"))
    clash = F.raise_error(F.concat(F.lit("one labelset twice after applying alert labels: "), F.col("instance_key")))
    return observed.join(n.where(F.when(F.col("n") > 1, clash.cast("boolean")).otherwise(F.lit(True))), ["rule_id", "instance_key", "eval_ms"]).drop("n")


def duplicate_observations(observed: DataFrame) -> DataFrame:
    """Keys that a rule yields more than once in one evaluation: an error of the rule."""
    return observed.groupBy("rule_id", "eval_ms", "instance_key").agg(F.count("*").alias("n")).where("n > 1")
