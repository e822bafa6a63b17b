"""Findings: episodes of alerts by dedup key, their summaries and notifications."""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPDATE_EVERY_MS = 60_000
LATE_MS = 900_000
EVENTS = "dedup_key string, finding_id string, event string, at_ms long, first_seen_ms long, last_seen_ms long, count long, resources array<string>, late boolean"


def finding_id(target: str, key: str, first_seen: int) -> str:
    """Identifier of an episode: a digest of its target, key and start."""
    return hashlib.sha256(json.dumps(["finding", target, key, first_seen]).encode()).hexdigest()[:32]


def dedup_key(rule_id: Column, labels: Column, volatile: tuple[str, ...] = ("value",), only: tuple[str, ...] | None = None) -> Column:
    """Rule id and sorted labels, without the volatile ones."""
    kept = F.map_filter(labels, lambda k, _: (k.isin(*only) if only else F.lit(True)) & ~k.isin(*volatile))
    pairs = F.transform(F.array_sort(F.map_entries(kept)), lambda e: F.concat(e["key"], F.lit("="), F.to_json(F.struct(e["value"].alias("v")))))
    return F.concat(rule_id, F.lit("{"), F.array_join(pairs, ","), F.lit("}"))


@dataclass
class Episode:
    """The open episode of one dedup key."""

    id: str | None = None
    first_seen: int = 0
    last_seen: int = 0
    last_emit: int = 0
    count: int = 0
    stale: bool = False
    pending: bool = False
    resources: list[str] = field(default_factory=list)
    used: int | None = None  # first_seen of the last episode

    def step(self, target: str, key: str, now: int, transition: str, seen: int, n: int, resources) -> str | None:
        """Advance by one observation; the event to emit, if any."""
        if transition == "resolved":
            if self.id is None:
                return None
            self.last_seen = max(self.last_seen, seen)
            return "resolved"
        if transition == "stale":
            if self.id is None or self.stale:
                return None
            self.stale = True
            return "stale"
        if self.id is None:
            start = seen if self.used is None or seen > self.used else self.used + 1
            self.__init__(id=finding_id(target, key, start), first_seen=start, last_seen=max(seen, start), last_emit=now, count=max(n, 1), resources=sorted(set(resources)), used=start)
            return "firing"
        self.count += max(n, 1)
        self.last_seen = max(self.last_seen, seen)
        self.resources = sorted({*self.resources, *resources})
        if self.stale:
            self.stale, self.last_emit, self.pending = False, now, False
            return "fresh"
        if now - self.last_emit >= UPDATE_EVERY_MS:
            self.last_emit, self.pending = now, False
            return "update"
        self.pending = True
        return None

    def close(self) -> None:
        self.__init__(used=self.first_seen)


def episodes(observations: DataFrame) -> DataFrame:
    """Events of all episodes, from ``target_id, dedup_key, now_ms, transition, seen_ms, n, resources`` in order of time.

    Rows with a null key or time are ignored; null counts are 1 and null
    resources none.
    """
    cols = ["target_id", "dedup_key", "now_ms", "transition", "seen_ms", "n", "resources"]
    rows = observations.select(*cols).where(F.col("dedup_key").isNotNull() & F.col("now_ms").isNotNull())
    rows = rows.withColumn("target_id", F.coalesce("target_id", F.lit(""))).withColumn("n", F.coalesce("n", F.lit(1)).cast("long")).withColumn("seen_ms", F.coalesce("seen_ms", "now_ms")).withColumn("resources", F.coalesce("resources", F.array().cast("array<string>")))
    rows = rows.repartition("target_id", "dedup_key").sortWithinPartitions("target_id", "dedup_key", "now_ms", "transition")

    def walk(batches):
        key, state = None, Episode()
        for pdf in batches:
            out = []
            for target, dedup, now, transition, seen, n, resources in zip(*(pdf[c].tolist() for c in cols)):
                if key != (target, dedup):
                    key, state = (target, dedup), Episode()
                event = state.step(target, dedup, now, transition, seen, n, list(resources))
                if event:
                    out.append((dedup, state.id, event, now, state.first_seen, state.last_seen, state.count, list(state.resources), now - seen > LATE_MS))
                if event == "resolved":
                    state.close()
            yield pd.DataFrame(out, columns=[c.split()[0] for c in EVENTS.split(", ")])

    return rows.mapInPandas(walk, EVENTS)


def merge_evidence(rows: DataFrame, cap_bytes: int) -> DataFrame:
    """Evidence of a finding: equal (source, text, labels) merged, then kept in order of time up to a size.

    rows: ``finding_id, source, text, labels, time_ms, n``.  Adds ``first_ms,
    last_ms, n, kept``.
    """
    from pyspark.sql import Window

    merged = rows.groupBy("finding_id", "source", "text", "labels").agg(F.min("time_ms").alias("first_ms"), F.max("time_ms").alias("last_ms"), F.sum("n").alias("n"))
    order = Window.partitionBy("finding_id").orderBy("first_ms", "source", "text").rowsBetween(Window.unboundedPreceding, 0)
    return merged.withColumn("size", F.sum(F.octet_length("text")).over(order)).withColumn("kept", F.col("size") <= cap_bytes).drop("size")


def with_finding(entries: DataFrame) -> DataFrame:
    """``entries`` with the ``finding`` that each row means.

    Letter case and surrounding blanks of finding_id mean nothing.  A row
    without one means the finding of its target with the same dedup_key and
    first_seen; if that has no name, the two stand for it, and a row without one
    of them stands for itself.
    """
    s = entries.withColumn("finding", F.nullif(F.lower(F.trim("finding_id")), F.lit(""))).drop("finding_id")
    told = ["target_id", "dedup_key", "first_seen"]
    names = s.where(F.col("finding").isNotNull()).dropna(subset=told).groupBy(*told).agg(F.min("finding").alias("named"))
    bare = s.where(F.col("finding").isNull())
    own = F.when(F.col("dedup_key").isNull() | F.col("first_seen").isNull(), F.concat(F.lit("row "), F.col("delivery_id").cast("string")))
    key = F.concat_ws(" ", F.lit("key"), F.col("first_seen").cast("string"), F.col("dedup_key"))
    bare = bare.join(names, told, "left").withColumn("finding", F.coalesce(F.col("named"), own, key)).select(*s.columns)
    return s.where(F.col("finding").isNotNull()).unionByName(bare)


def lifecycle_summary(entries: DataFrame, after: int, watermark: int, keys: list[str], seq: str = "seq") -> DataFrame:
    """Last entry at or before the watermark of each finding touched in (after, watermark]."""
    rest = [c for c in entries.columns if c not in keys]
    best = entries.where(F.col(seq) <= watermark).groupBy(*keys).agg(F.max(seq).alias("touched"), F.max_by(F.struct(*rest), F.struct(seq, *[c for c in rest if c != seq and dict(entries.dtypes)[c] in ("bigint", "int", "string")])).alias("e"))
    return best.where(F.col("touched") > after).select(*keys, "e.*")


def notifications(entries: DataFrame, watermark: Column | int, keys: list[str], state: str = "state", seq: str = "seq") -> DataFrame:
    """First firing of each finding above the watermark: ``keys, seq``."""
    return entries.where((F.col(state) == "firing") & (F.col(seq) > watermark)).groupBy(*keys).agg(F.min(seq).alias(seq))
