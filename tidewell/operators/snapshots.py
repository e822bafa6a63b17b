"""What changed between consecutive full snapshots.

Both snapshots of a pair are united, each row tagged with its side, and grouped
by (pair, key).  One row hash for each side is enough to classify, so a single
aggregation shuffle does it, pre-aggregated on the map side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewell.workspace import Workspace


def follow(checkpoints: DataFrame) -> DataFrame:
    """``record_id, prev_record``: each checkpoint with the one before it.

    Repeated deliveries of a record count once.  Within (target, epoch)
    checkpoints follow by seq; the first of an epoch follows the last one of the
    epoch it names in prev_epoch.  A checkpoint without one before it is left out.
    """
    named = checkpoints.where(F.col("record_id").isNotNull()).groupBy("record_id").agg(
        F.min(F.struct(F.col("target_id"), F.col("epoch"), F.col("seq"), F.col("prev_epoch"))).alias("c")
    ).select("record_id", "c.*")
    order = Window.partitionBy("target_id", "epoch").orderBy("seq", "record_id")
    inside = named.withColumn("prev_record", F.lag("record_id").over(order))
    last = named.groupBy(F.col("target_id").alias("t"), F.col("epoch").alias("e")).agg(F.max_by("record_id", F.struct("seq", "record_id")).alias("last_record"))
    first = F.col("prev_record").isNull() & F.col("prev_epoch").isNotNull() & (F.col("prev_epoch") != F.col("epoch"))
    joined = inside.join(last, first & (F.col("prev_epoch") == F.col("e")) & F.col("target_id").eqNullSafe(F.col("t")), "left")
    return joined.select("record_id", F.coalesce("prev_record", "last_record").alias("prev_record")).where(F.col("prev_record").isNotNull())


# fixed values: the tokens of a JSON text; a number with an exponent
_TOKENS = r'("(?:\\.|[^"\\])*"|-?\d+(?:\.\d+)?(?:[eE][+-]?\d+)?|[\[\]{}:,]|true|false|null)'
_EXPONENT = r"\d[eE][+-]?\d"


def _plain_numbers(text: Column) -> Column:
    """The JSON text with numbers in exponent form written out, where 38 digits hold them."""

    def plain(t: Column) -> Column:
        whole, exact = t.try_cast("decimal(38,0)"), t.try_cast("decimal(38,18)")
        number = F.regexp_replace(exact.cast("string"), r"\.?0+$", "")  # the scale of 18 always ends it
        big = F.when(t.try_cast("double") == whole.cast("double"), whole.cast("string"))
        return F.when(t.rlike(r"^-?\d.*[eE]"), F.coalesce(F.when(exact.isNotNull(), number), big, t)).otherwise(t)

    return F.when(text.rlike(_EXPONENT), F.array_join(F.transform(F.regexp_extract_all(text, F.lit(_TOKENS), 1), plain), "")).otherwise(text)


def canonical_json(json: Column) -> Column:
    """JSON text with sorted keys, without spacing and null members; numbers by value (1e2 is 100, 1.50 is 1.5).

    A null or empty text counts as an object without members; of a repeated
    member the last one counts; a null inside a member is a value.  Text that is
    not JSON, or repeats a member of an inner object, stands for itself.
    """
    text = _plain_numbers(F.coalesce(json, F.lit("{}")))

    def joined(flat: Column) -> Column:
        every, n = F.map_entries(flat), F.size(flat)
        last = F.filter(every, lambda e, i: ~F.exists(F.slice(every, i + 2, n), lambda x: x["key"] == e["key"]))
        entries = F.when(F.size(F.array_distinct(F.map_keys(flat))) < n, last).otherwise(every)
        held = F.filter(entries, lambda e: e["value"].isNotNull() & ~F.is_variant_null(e["value"]))
        return F.array_join(F.array_sort(F.transform(held, lambda e: F.concat(F.to_json(F.struct(e["key"].alias("k"))), F.to_json(e["value"])))), ",")

    # bound as a lambda's argument, so that the text is parsed once
    return F.coalesce(F.transform(F.array(F.from_json(text, "map<string,variant>")), joined)[0], text)


def snapshot_changes(pairs: DataFrame, rows: DataFrame, *, record: str = "record_id", key: str = "uid", content: list[Column]) -> DataFrame:
    """``record_id, key, change_type`` for each key that differs in a pair of snapshots.

    pairs: ``record_id, prev_record``.  rows: the rows inside the snapshots; a
    snapshot without rows is empty.  content: columns whose values make a change.

    The pairs are written first, so that Spark knows their size: below its
    threshold for broadcasts the rows are tagged in place and the aggregation is
    the only shuffle, above it the rows are shuffled once more by their record.

    Defined results: repeated rows count once; should one snapshot hold a key
    twice with unlike content, its greatest row hashes stand for it; rows with a
    null record or key are ignored; null content differs from empty text.
    """
    ws = Workspace(rows.sparkSession)
    sized = F.concat_ws("|", *[F.when(x.isNull(), F.lit("-")).otherwise(F.concat(F.length(x).cast("string"), F.lit(":"), x)) for x in content])
    hashed = rows.where(F.col(record).isNotNull() & F.col(key).isNotNull()).select(F.col(record).alias("r"), F.col(key).alias("key"), F.sha2(sized, 256).alias("h"))
    # 120 bits of the digest as two numbers: those aggregate by hashing, a text would be sorted
    hashed = hashed.select("r", "key", *[F.conv(F.substring("h", 1 + 15 * i, 15), 16, 10).cast("long").alias(f"h{i}") for i in (0, 1)])
    sides = pairs.select(
        F.explode(F.array(F.struct(F.col("record_id").alias("r"), F.lit(1).alias("after"), F.col("record_id").alias("pair")), F.struct(F.col("prev_record").alias("r"), F.lit(0).alias("after"), F.col("record_id").alias("pair")))).alias("s")
    ).select("s.*")
    tagged = hashed.join(ws.write(sides, "sides"), "r")
    both = tagged.groupBy("pair", "key").agg(*[F.max(F.when(F.col("after") == side, F.col(f"h{i}"))).alias(f"{name}{i}") for side, name in ((0, "old"), (1, "new")) for i in (0, 1)])
    differs = (F.col("old0") != F.col("new0")) | (F.col("old1") != F.col("new1"))
    kind = F.when(F.col("old0").isNull(), "added").when(F.col("new0").isNull(), "removed").when(differs, "changed")
    return both.select(F.col("pair").alias("record_id"), F.col("key").alias(key), kind.alias("change_type")).where(F.col("change_type").isNotNull())
