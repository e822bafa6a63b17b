"""Results within limits, with what was left out; throttles; reports of scrapes; saved findings; bundle switches."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from tidewell.functions import labels as L
from tidewell.operators.history import content_digest


def bound_series_told(series: DataFrame, time: str, *, max_series: int, max_samples: int, max_bytes: int, source: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(samples of the series kept, one row ``limit, omitted`` if any was left out).

    Series (labels, time, value) are ordered by source and labels and kept as a
    prefix: the first that breaks a limit and all after it are left out.  A series
    takes 16 bytes for each sample and those of its labels and source.  Ranks run
    over one row for each series.
    """
    src = F.coalesce(F.col(source), F.lit("")) if source else F.lit("")
    keyed = series.withColumn("_src", src).withColumn("_sid", L.canonical(F.col("labels")))
    width = F.aggregate(F.map_entries(F.first("labels")), F.lit(0).cast("long"), lambda a, e: a + F.octet_length(e["key"]) + F.octet_length(e["value"]))
    sizes = keyed.groupBy("_src", "_sid").agg(F.count("*").alias("n"), width.alias("w")).withColumn("size", F.octet_length("_src") + F.col("w") + 16 * F.col("n"))
    order = Window.orderBy("_src", "_sid")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    # one row for each series, of which more than the limit are cut before the sums
    first = sizes.orderBy("_src", "_sid").limit(max_series + 1).withColumn("i", F.row_number().over(order)).withColumn("samples", F.sum("n").over(upto)).withColumn("bytes", F.sum("size").over(upto))
    broken = F.when(F.col("i") > max_series, "series").when(F.col("samples") > max_samples, "samples").when(F.col("bytes") > max_bytes, "bytes")
    marked = first.withColumn("limit", broken)
    kept = marked.where("limit is null").select("_src", "_sid")
    total = sizes.agg(F.count("*").alias("all"))
    told = marked.where("limit is not null").agg(F.min_by("limit", "i").alias("limit"), (F.min("i") - 1).alias("kept")).where("limit is not null").crossJoin(total).select("limit", (F.col("all") - F.col("kept")).alias("omitted"))
    return keyed.join(kept, ["_src", "_sid"], "left_semi").drop("_src", "_sid"), told


def bound_items(items: DataFrame, order: list[Column], *, max_items: int, max_bytes: int) -> DataFrame:
    """The first items in order within both limits, an item being as large as its JSON text; ``limited`` tells of a cut."""
    near = items.withColumn("_size", F.octet_length(F.to_json(F.struct(*items.columns)))).orderBy(*order).limit(max_items + 1)
    w = Window.orderBy(*order)
    sized = near.withColumn("_i", F.row_number().over(w)).withColumn("_used", F.sum("_size").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    over = (F.col("_i") > max_items) | (F.col("_used") > max_bytes)
    told = sized.withColumn("limited", F.max(over).over(Window.partitionBy()))
    return told.where(~over).drop("_size", "_i", "_used")


def cap_cardinality(counters: DataFrame, group: str, key: str, seen: str, *, max_series: int, expire_before: Column | int) -> tuple[DataFrame, DataFrame]:
    """(counters kept, ``group, dropped``): of each group the series not expired, in order of their first sight, up to a bound."""
    live = counters.where(F.col(seen) >= expire_before)
    firsts = live.groupBy(group, key).agg(F.min(seen).alias("_first"))
    rank = firsts.withColumn("_rank", F.row_number().over(Window.partitionBy(group).orderBy("_first", key)))
    kept = rank.where(F.col("_rank") <= max_series).select(group, key)
    dropped = rank.groupBy(group).agg(F.count_if(F.col("_rank") > max_series).alias("dropped"))
    return live.join(kept, [group, key], "left_semi"), dropped


def throttle(updates: DataFrame, key: str, at: str, interval: int) -> DataFrame:
    """Updates that are told: the first of each key, then the newest whenever ``interval`` has passed since the last one told.

    ``told_at`` is when; what is pending when the interval ends is told then, as a
    timer would.  Keys are walked in order of time within sorted partitions.
    """
    rows = updates.where(F.col(key).isNotNull() & F.col(at).isNotNull()).repartition(key).sortWithinPartitions(key, at)
    schema = StructType([*rows.schema.fields, StructField("told_at", LongType())])

    def walk(batches):
        k, last, pending = None, 0, None
        columns = [f.name for f in schema]
        for pdf in batches:
            out = []
            for row in pdf.itertuples(index=False, name=None):
                now, mine = int(row[a]), row[i]
                if mine != k:
                    if pending is not None:
                        out.append((*pending, last + interval))
                    k, last, pending = mine, now, None
                    out.append((*row, now))
                    continue
                if pending is not None and now >= last + interval:
                    last += interval
                    out.append((*pending, last))
                    pending = None
                if now >= last + interval:
                    last = now
                    out.append((*row, now))
                else:
                    pending = row
            yield pd.DataFrame(out, columns=columns)
        if pending is not None:
            yield pd.DataFrame([(*pending, last + interval)], columns=columns)

    i, a = rows.columns.index(key), rows.columns.index(at)
    return rows.mapInPandas(walk, schema)


def scrape_report(samples: DataFrame, scrapes: DataFrame, *, max_series: int) -> tuple[DataFrame, DataFrame]:
    """(samples within budget, ``target, ts_ms, name, value`` of ``up``, ``scrape_duration_seconds`` and ``scrape_samples_scraped``).

    scrapes: ``target, ts_ms, duration_s, error``; samples: ``target, ts_ms,
    labels, value``.  A scrape with an error is down.  Beyond the budget a target
    keeps its first series in label order; families are whole or left out.
    """
    family = F.regexp_replace(F.element_at("labels", F.lit("__name__")), "_(bucket|sum|count)$", "")
    each = samples.withColumn("_family", family)
    sizes = each.groupBy("target", "ts_ms", "_family").agg(F.count_distinct(L.canonical(F.col("labels"))).alias("n"))
    used = sizes.withColumn("used", F.sum("n").over(Window.partitionBy("target", "ts_ms").orderBy("_family").rowsBetween(Window.unboundedPreceding, 0)))
    kept = each.join(used.where(F.col("used") <= max_series).select("target", "ts_ms", "_family"), ["target", "ts_ms", "_family"], "left_semi").drop("_family")
    scraped = samples.groupBy("target", "ts_ms").agg(F.count("*").cast("double").alias("n"))
    told = scrapes.join(scraped, ["target", "ts_ms"], "left")
    values = F.explode(F.map_from_arrays(F.array(F.lit("up"), F.lit("scrape_duration_seconds"), F.lit("scrape_samples_scraped")), F.array(F.when(F.col("error").isNull(), 1.0).otherwise(0.0), F.col("duration_s").cast("double"), F.coalesce("n", F.lit(0.0)))))
    return kept, told.select("target", "ts_ms", values.alias("name", "value"))


def union_sources(sources: list[tuple[str, DataFrame]]) -> DataFrame:
    """Rows of several sources with their ``source`` and ``source_rank``; columns that one lacks are null there."""
    out = None
    for rank, (name, df) in enumerate(sources):
        mine = df.withColumn("source", F.lit(name)).withColumn("source_rank", F.lit(rank))
        out = mine if out is None else out.unionByName(mine, allowMissingColumns=True)
    return out


def saved_finding(rows: DataFrame, query: str, claimed: str | None = None) -> DataFrame:
    """``query, rows, hash, confirmed``: a query's result to be saved; confirmed if it has the hash that was claimed for it."""
    text = F.to_json(F.struct(*sorted(rows.columns)))
    got = content_digest(rows.withColumn("query", F.lit(query)), ("query",), text)
    return got.select("query", F.col("n").alias("rows"), F.sha2("digest", 256).alias("hash")).withColumn("confirmed", F.lit(True) if claimed is None else F.col("hash") == claimed)


def switch_bundle(instances: DataFrame, old: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(instances that go on, those told stale) when a bundle replaces another.

    instances: ``rule_id, instance_key, phase, ...``; old, new: ``rule_id, class,
    evaluated``.  Rules that are gone, no longer evaluated or of another class
    lose their instances; only firing ones that are not stale are told.
    """
    same = old.select("rule_id", F.col("class").alias("was")).join(new.where("evaluated").select("rule_id", "class"), "rule_id").where("was = class").select("rule_id")
    gone = instances.join(same, "rule_id", "left_anti").where((F.col("phase") == "firing") & ~F.coalesce("stale", F.lit(False)))
    return instances.join(same, "rule_id", "left_semi"), gone.withColumn("stale", F.lit(True))


def shrink_evidence(evidence: DataFrame, max_bytes: int, key: str = "finding_id") -> DataFrame:
    """Evidence (key, time_ms, text) of each finding within a size: the newest and the oldest are kept, the middle goes first."""
    w = Window.partitionBy(key)
    ranked = evidence.withColumn("_up", F.row_number().over(w.orderBy("time_ms", "text"))).withColumn("_down", F.row_number().over(w.orderBy(F.desc("time_ms"), F.desc("text"))))
    near = Window.partitionBy(key).orderBy(F.least("_up", "_down"), "_up").rowsBetween(Window.unboundedPreceding, 0)
    return ranked.withColumn("_used", F.sum(F.octet_length("text")).over(near)).where(F.col("_used") <= max_bytes).drop("_up", "_down", "_used")


def permanent_addresses(addresses: DataFrame) -> DataFrame:
    """``host, interface, addresses`` of interfaces (host, interface, address, temporary), without temporary and loopback ones."""
    held = addresses.where(~F.coalesce("temporary", F.lit(False)) & (F.col("interface") != "lo") & F.col("address").isNotNull())
    return held.groupBy("host", "interface").agg(F.array_sort(F.collect_set("address")).alias("addresses"))
