"""A feed of inserts, updates and deletes, applied newest first.

The feed is cut into batches by its order column.  Batches are processed from
the newest to the oldest.  In each batch the newest image of every field is
aggregated (map-side first, so that a hot entity shrinks before the shuffle),
entities already resolved by a later create or delete are anti-joined away, and
so are fields that already have a later image.  What is left is recorded: a
first-seen image, or a tombstone for a removed field or a deleted entity.  At
last the rows of the base that nothing touched are appended.

An image waits until an older create confirms its entity: an update of an
entity that is not live has no effect, and newest-first does not know that yet.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.workspace import Workspace


@dataclass(frozen=True)
class FeedColumns:
    """Names of the columns of a change feed and the codes of its operations."""

    scope: str = "epoch"
    key: str = "uid"
    seq: str = "seq"
    idx: str = "idx"
    op: str = "op"
    fields: str = "fields"
    removed: str = "removed"
    create: int = 1
    update: int = 2
    delete: int = 3


def _cells(feed: DataFrame, c: FeedColumns, with_values: bool) -> DataFrame:
    """One row for each field that an op touches, one with a null field for each create or delete."""
    value = (lambda e: e["value"]) if with_values else (lambda e: F.lit(None).cast("string"))

    def cell(name: Column, gone: Column, val: Column) -> Column:
        return F.struct(name.alias("f"), gone.alias("gone"), val.alias("v"))

    none = F.lit(None).cast("string")
    empty = F.array().cast("array<struct<f:string,gone:boolean,v:string>>")
    ends = F.col("op") != c.update
    given = F.when(
        F.col("op") != c.delete,
        F.transform(F.map_entries(F.from_json("fields", "map<string,string>")), lambda e: cell(e["key"], e["value"].isNull(), value(e))),
    )
    taken = F.when(F.col("op") == c.update, F.transform(F.filter("removed", lambda r: r.isNotNull()), lambda r: cell(r, F.lit(True), none)))
    marker = F.when(ends, F.array(cell(none, F.col("op") == c.delete, none)))
    cells = F.concat(F.coalesce(given, empty), F.coalesce(taken, empty), F.coalesce(marker, empty))
    return feed.select("scope", "key", "seq", "idx", F.explode(cells).alias("c")).select("scope", "key", "seq", "idx", F.col("c.f").alias("f"), F.col("c.gone").alias("gone"), F.col("c.v").alias("v"))


def _cuts(feed: DataFrame, batches: int) -> list[int]:
    """Order values that cut the feed into batches of about equal size; at most ``batches - 1`` numbers."""
    if batches < 2:
        return []
    shares = [i / batches for i in range(1, batches)]
    row = feed.agg(F.percentile_approx("seq", F.array(*[F.lit(s) for s in shares]), F.lit(1000)).alias("q")).first()
    return sorted(set(row["q"] or []))


def apply_changes(feed: DataFrame, base: DataFrame | None = None, *, columns: FeedColumns | None = None, batches: int = 3, with_values: bool = True) -> DataFrame:
    """Current fields of every live entity, one row for each field.

    feed: a change feed with the columns named by ``columns``; others are ignored,
        whatever their names.  ``fields`` is a JSON object, ``removed`` a list of names.
    base: optional ``scope, key, field, value`` rows that were live before the feed.

    Returns ``scope, key, field, value, set_seq``.  ``set_seq`` is null for
    untouched base rows, ``value`` is the JSON text of the value as Spark reads it
    (null if ``with_values`` is off).

    Defined results: repeated deliveries of an op count once, since only the
    newest (seq, idx) of a field matters; if one op both sets and removes a field
    it is removed; a null in ``fields`` removes, in a create the field is not
    held; a create of a live entity starts it anew; rows with a null scope, key,
    order or op, or an op that is none of the three, are ignored; an unreadable
    ``fields`` counts as no fields; an empty feed yields the base.
    """
    c = columns or FeedColumns()
    spark = feed.sparkSession
    ws = Workspace(spark)
    ops = feed.select(
        F.col(c.scope).alias("scope"), F.col(c.key).alias("key"), F.col(c.seq).cast("long").alias("seq"), F.col(c.idx).cast("long").alias("idx"),
        F.col(c.op).cast("int").alias("op"), F.col(c.fields).alias("fields"), F.col(c.removed).alias("removed"),
    ).where(F.col("op").isin(c.create, c.update, c.delete) & F.col("scope").isNotNull() & F.col("key").isNotNull() & F.col("seq").isNotNull()).withColumn("idx", F.coalesce("idx", F.lit(0)))

    cuts = _cuts(ops, batches)
    edges = [None, *cuts, None]
    images: DataFrame | None = None  # newest image or tombstone of each field, of the batches so far
    resolved: DataFrame | None = None  # entities whose last create or delete is known
    for low, high in reversed(list(zip(edges, edges[1:]))):
        batch = ops
        if low is not None:
            batch = batch.where(F.col("seq") > low)
        if high is not None:
            batch = batch.where(F.col("seq") <= high)
        newest = _cells(batch, c, with_values).groupBy("scope", "key", "f").agg(F.max(F.struct("seq", "idx", "gone", "v")).alias("last"))
        if resolved is not None:
            newest = newest.join(resolved, ["scope", "key"], "left_anti")
        seen = ws.write(newest.select("scope", "key", "f", "last.*"), "seen")
        ended = seen.where(F.col("f").isNull()).select("scope", "key", F.struct("seq", "idx").alias("at"), (~F.col("gone")).alias("alive"))
        fresh = seen.where(F.col("f").isNotNull()).join(ended.select("scope", "key", "at"), ["scope", "key"], "left").where(F.col("at").isNull() | (F.struct("seq", "idx") >= F.col("at"))).drop("at")
        if images is not None:
            fresh = fresh.join(images, ["scope", "key", "f"], "left_anti")
        ended = ended.drop("at")
        images = fresh if images is None else images.unionByName(fresh)
        resolved = ended if resolved is None else resolved.unionByName(ended)
        if low is not None:
            images = ws.write(images, "images")

    live = resolved.where("alive").select("scope", "key")
    columns_out = ["scope", "key", F.col("f").alias("field"), F.col("v").alias("value"), F.col("seq").alias("set_seq")]
    held = images.where(~F.col("gone"))
    if base is None:
        return held.join(live, ["scope", "key"], "left_semi").select(*columns_out)
    rows = base.select("scope", "key", F.col("field").alias("f"), F.col("value").alias("v"))
    untouched = rows.join(resolved, ["scope", "key"], "left_anti")
    live = live.unionByName(untouched.select("scope", "key").distinct())
    kept = untouched.join(images, ["scope", "key", "f"], "left_anti").select("scope", "key", F.col("f").alias("field"), F.col("v").alias("value"), F.lit(None).cast("long").alias("set_seq"))
    return held.join(live, ["scope", "key"], "left_semi").select(*columns_out).unionByName(kept)
