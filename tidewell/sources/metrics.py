"""Metric samples: the text exposition format, staleness, label conflicts, retention, snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewell.functions import labels as L
from tidewell.functions.numbers import float_of

LINE = r'^([a-zA-Z_:][a-zA-Z0-9_:]*)\s*(?:\{((?:[^"}]|"(?:\\.|[^"\\])*")*)\})?\s+([^\s]+)(?:\s+(-?\d+))?\s*$'
PAIR = r'([a-zA-Z_][a-zA-Z0-9_]*)\s*=\s*"((?:\\.|[^"\\])*)"'


def parse_exposition(raw: Column, scraped_ms: Column) -> Column:
    """STRUCT labels, ts_ms, value of a line of the text format; null for comments and what is malformed."""
    body = F.regexp_extract(raw, LINE, 2)
    unescape = lambda v: F.replace(F.replace(F.replace(F.replace(v, F.lit("\\\\"), F.lit("\u0001")), F.lit("\\n"), F.lit("\n")), F.lit('\\"'), F.lit('"')), F.lit("\u0001"), F.lit("\\"))
    keys, values = F.regexp_extract_all(body, F.lit(PAIR), 1), F.transform(F.regexp_extract_all(body, F.lit(PAIR), 2), unescape)
    pairs = F.filter(F.arrays_zip(keys.alias("k"), values.alias("v")), lambda p: (p["k"] != "__name__") & (p["v"] != ""))
    labels = F.map_concat(F.map_from_entries(pairs), F.create_map(F.lit("__name__"), F.regexp_extract(raw, LINE, 1)))
    value = float_of(F.regexp_extract(raw, LINE, 3))
    at = F.coalesce(F.nullif(F.regexp_extract(raw, LINE, 4), F.lit("")).try_cast("long"), scraped_ms)
    return F.when(raw.rlike(LINE) & ~raw.startswith("#") & value.isNotNull(), F.struct(labels.alias("labels"), at.alias("ts_ms"), value.alias("value")))


def with_target(labels: Column, target: Column) -> Column:
    """Labels of a scraped series: those of the target win, the scraped ones move to ``exported_``."""

    def moved(k: Column) -> Column:
        once = F.concat(F.lit("exported_"), k)
        return F.when(~F.map_contains_key(target, k), k).when(F.map_contains_key(labels, once) | F.map_contains_key(target, once), F.concat(F.lit("exported_"), once)).otherwise(once)

    return F.map_concat(F.transform_keys(labels, lambda k, _: moved(k)), F.map_filter(target, lambda _, v: v != ""))


def stale_markers(previous: DataFrame, current: DataFrame, at_ms: int) -> DataFrame:
    """A marker for each series of the last scrape that this one lacks."""
    gone = previous.select(L.canonical(F.col("labels")).alias("sid"), "labels").join(current.select(L.canonical(F.col("labels")).alias("sid")).distinct(), "sid", "left_anti")
    return gone.groupBy("sid").agg(F.first("labels").alias("labels")).select("labels", F.lit(at_ms).cast("long").alias("ts_ms"), F.lit(float("nan")).alias("value"), F.lit(True).alias("is_stale"))


def expand_family(rows: DataFrame) -> DataFrame:
    """Samples of metric families: ``name, kind, labels, value, sum, count, points ARRAY<STRUCT<at DOUBLE, value DOUBLE>>``.

    Counters, gauges and untyped metrics give one sample; summaries one for each
    quantile, histograms one for each bound and one for +Inf, both with _sum and _count.
    """
    number = lambda x: F.when(x == float("inf"), F.lit("+Inf")).when(x == F.floor(x), x.cast("long").cast("string")).otherwise(x.cast("string"))
    sample = lambda suffix, more, v: F.struct(F.concat("name", F.lit(suffix)).alias("name"), (F.map_concat("labels", more) if more is not None else F.col("labels")).alias("labels"), v.alias("value"))
    is_hist = F.col("kind") == "histogram"
    points = F.transform("points", lambda p: F.when(is_hist, sample("_bucket", F.create_map(F.lit("le"), number(p["at"])), p["value"])).otherwise(sample("", F.create_map(F.lit("quantile"), number(p["at"])), p["value"])))
    inf = F.when(is_hist & ~F.exists("points", lambda p: p["at"] == float("inf")), F.array(sample("_bucket", F.create_map(F.lit("le"), F.lit("+Inf")), F.col("count")))).otherwise(F.slice(points, 1, 0))
    full = F.concat(points, inf, F.array(sample("_sum", None, F.col("sum")), sample("_count", None, F.col("count"))))
    flat = F.when(F.col("kind").isin("summary", "histogram"), full).otherwise(F.array(sample("", None, F.col("value"))))
    return rows.select(F.explode(flat).alias("s")).select(F.map_concat("s.labels", F.create_map(F.lit("__name__"), F.col("s.name"))).alias("labels"), "s.value")


def retain(samples: DataFrame, retention_ms: int) -> DataFrame:
    """Samples not older than the retention behind the newest."""
    return samples.crossJoin(samples.agg(F.max("ts_ms").alias("newest"))).where(F.col("ts_ms") >= F.col("newest") - retention_ms).drop("newest")


def merge_sources(samples: DataFrame) -> DataFrame:
    """One sample for each (labels, ts_ms): of the sources the first by name wins."""
    return samples.groupBy("labels", "ts_ms").agg(F.min_by(F.struct("value", "is_stale"), "source").alias("s")).select("labels", "ts_ms", "s.*")


def sample_snapshots(samples: DataFrame, interval_ms: int) -> DataFrame:
    """Changes at once, unchanged values only each interval since the last one kept.

    Runs of one value are found by built-in windows; within a run the kept ones
    depend on the last kept, which a streaming walk in order of time tells.
    """
    import pandas as pd

    keyed = samples.withColumn("sid", L.canonical(F.col("labels"))).repartition("sid").sortWithinPartitions("sid", "ts_ms")

    def walk(batches):
        sid, kept, value = None, None, None
        for pdf in batches:
            mask = []
            for s, t, v in zip(pdf["sid"], pdf["ts_ms"], pdf["value"]):
                same = s == sid and (v == value or v != v and value != value)
                take = not same or t - kept >= interval_ms
                if take:
                    sid, kept, value = s, t, v
                mask.append(take)
            yield pdf[pd.Series(mask, index=pdf.index, dtype=bool)]

    return keyed.mapInPandas(walk, keyed.schema).drop("sid")


def label_values(samples: DataFrame, name: str | None = None) -> DataFrame:
    """Distinct label names, or the values of one."""
    if name is None:
        return samples.select(F.explode(F.map_keys("labels")).alias("name")).distinct()
    return samples.select(F.element_at("labels", F.lit(name)).alias("value")).where(F.col("value").isNotNull()).distinct()


def admit_series(samples: DataFrame, max_series: int) -> DataFrame:
    """Samples of the first ``max_series`` series in label order; the limit is the feature."""
    series = samples.select(L.canonical(F.col("labels")).alias("sid")).distinct()
    kept = series.orderBy("sid").limit(max_series)
    return samples.withColumn("sid", L.canonical(F.col("labels"))).join(kept, "sid", "left_semi").drop("sid")


def changed_facts(old: Column, new: Column, floors: dict[str, float], relative: float = 0.1) -> Column:
    """Did facts change enough to be told?  A key came or went, a text changed, or a number by more than both bounds."""
    keys = F.array_union(F.map_keys(old), F.map_keys(new))

    def moved(k: Column) -> Column:
        a, b = F.element_at(old, k), F.element_at(new, k)
        x, y = a.try_cast("double"), b.try_cast("double")
        floor = F.lit(0.0)
        for suffix in sorted(floors, key=len):  # the longest suffix counts
            floor = F.when(F.endswith(k, F.lit(suffix)), F.lit(float(floors[suffix]))).otherwise(floor)
        delta = F.abs(y - x)
        number = (delta > 0) & (delta > relative * F.abs(x)) & (delta >= floor)
        return F.when(a.isNull() | b.isNull(), F.lit(True)).when(x.isNull() | y.isNull(), ~a.eqNullSafe(b)).otherwise(number)

    return F.exists(keys, moved)
