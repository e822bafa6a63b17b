"""Runs of records: canonical order, folding, replay from a checkpoint, chains, ingest cursors, coalescing.

A run is folded by the first and the last op of each key; nothing is replayed
record by record except chain hashes, which are sequential by nature and are
walked in order within sorted partitions.
"""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewell.operators.changes import FeedColumns, apply_changes
from tidewell.operators.state import CREATE, DELETE, EDGE_ADD, EDGE_REMOVE, EDGE_REPLACE, SCOPE_SET, UPDATE, fold, in_spans

RESOURCE_OPS, EDGE_OPS = (CREATE, UPDATE, DELETE), (EDGE_ADD, EDGE_REMOVE, EDGE_REPLACE)


def op_class(op: Column) -> Column:
    """1 for ops of resources, 2 of edges, 3 of scopes: their order in a record."""
    return F.when(op.isin(*RESOURCE_OPS), 1).when(op.isin(*EDGE_OPS), 2).when(op == SCOPE_SET, 3)


def canonical_order(ops: DataFrame, scope: tuple[str, ...] = ("epoch",)) -> DataFrame:
    """``ops`` with ``position``: their order in a record (resources, edges, scopes; then by key), from 1."""
    order = Window.partitionBy(*scope).orderBy(op_class(F.col("op")), F.coalesce("uid", F.lit("")), F.coalesce("edge_type", F.lit("")), F.coalesce("to_uid", F.lit("")), F.coalesce("scope_key", F.lit("")), "seq", "idx")
    return ops.withColumn("position", F.row_number().over(order))


def once(ops: DataFrame, scope: tuple[str, ...] = ("epoch",)) -> DataFrame:
    """Each op once: of repeated deliveries of (scope, seq, idx) the least row counts."""
    columns = [c for c in ("op", "uid", "kind", "namespace", "name", "fields", "removed", "reason", "edge_type", "to_uid", "attrs", "prev_attrs", "scope_key", "scope") if c in ops.columns and c not in scope]
    return ops.groupBy(*scope, "seq", "idx").agg(F.min(F.struct(*columns)).alias("o")).select(*scope, "seq", "idx", "o.*")


def fold_errors(ops: DataFrame, scope: tuple[str, ...] = ("epoch",)) -> DataFrame:
    """``scope, seq, idx, op, reason`` of ops that no run may hold after the ones before them.

    An op on a resource after its delete, a create of one that the run has seen,
    an edge added twice, an edge removed or replaced after its removal.
    """
    mine = ops.where(F.col("op").isin(*RESOURCE_OPS, *EDGE_OPS) & F.col("uid").isNotNull()).dropDuplicates([*scope, "seq", "idx"])
    is_edge = F.col("op").isin(*EDGE_OPS)
    key = [*scope, "uid", F.when(is_edge, F.col("edge_type")), F.when(is_edge, F.col("to_uid")), is_edge]
    before = F.lag("op").over(Window.partitionBy(*key).orderBy("seq", "idx"))
    mine = mine.withColumn("b", before)
    why = (
        F.when(~is_edge & (F.col("b") == DELETE), "after delete of the resource").when((F.col("op") == CREATE) & F.col("b").isNotNull(), "create of an existing resource").when((F.col("op") == EDGE_ADD) & F.col("b").isin(EDGE_ADD, EDGE_REPLACE), "add of an existing edge")
        .when(F.col("op").isin(EDGE_REMOVE, EDGE_REPLACE) & (F.col("b") == EDGE_REMOVE), "remove or replace of an absent edge")
    )
    return mine.withColumn("reason", why).where(F.col("reason").isNotNull()).select(*scope, "seq", "idx", "op", "reason")


def fold_edges(ops: DataFrame, scope: tuple[str, ...] = ("epoch",)) -> DataFrame:
    """Net effect of a run on each edge: ``scope, op, from_uid, type, to_uid, attrs, prev_attrs``; equal attributes are no change."""
    edges = ops.where(F.col("op").isin(*EDGE_OPS)).dropna(subset=[*scope, "uid", "to_uid", "seq"])
    at = F.struct("seq", "idx", "op", "attrs", "prev_attrs")
    ends = edges.groupBy(*scope, F.col("uid").alias("from_uid"), F.col("edge_type").alias("type"), "to_uid").agg(F.min(at).alias("a"), F.max(at).alias("z"))
    before, now = F.col("a.op") != EDGE_ADD, F.col("z.op") != EDGE_REMOVE
    old = F.when(F.col("a.op") == EDGE_REMOVE, F.col("a.attrs")).otherwise(F.col("a.prev_attrs"))
    same = _values(old).eqNullSafe(_values(F.col("z.attrs")))
    op = F.when(~before & now, EDGE_ADD).when(before & ~now, EDGE_REMOVE).when(before & now & ~same, EDGE_REPLACE)
    return ends.select(*scope, op.alias("op"), "from_uid", "type", "to_uid", F.when(op == EDGE_REMOVE, old).otherwise(F.col("z.attrs")).alias("attrs"), F.when(op == EDGE_REPLACE, old).alias("prev_attrs")).where(F.col("op").isNotNull())


def _values(attrs: Column) -> Column:
    from tidewell.operators.snapshots import canonical_json

    return canonical_json(attrs)


def fold_scopes(ops: DataFrame, scope: tuple[str, ...] = ("epoch",)) -> DataFrame:
    """The last status of each scope key of a run."""
    last = ops.where(F.col("op") == SCOPE_SET).groupBy(*scope, "scope_key").agg(F.max(F.struct("seq", "idx", F.col("scope").alias("s"))).alias("z"))
    return last.select(*scope, F.lit(SCOPE_SET).alias("op"), "scope_key", "z.s.*")


def fold_run(ops: DataFrame, scope: tuple[str, ...] = ("epoch",)) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(resources, edges, scopes, errors) of a run; what has an error must not be used."""
    return fold(ops, scope), fold_edges(ops, scope), fold_scopes(ops, scope), fold_errors(ops, scope)


def run_breaks(records: DataFrame, scope: tuple[str, ...] = ("epoch",)) -> DataFrame:
    """``scope, seq, parent, before``: records (scope, seq, parent) that do not follow the one before them."""
    single = records.select(*scope, "seq", "parent").distinct()
    before = F.lag("seq").over(Window.partitionBy(*scope).orderBy("seq"))
    return single.withColumn("before", before).where(F.col("before").isNotNull() & ~F.col("parent").eqNullSafe(F.col("before")))


def reconstruct(ops: DataFrame, base: DataFrame, base_seq: DataFrame, at: DataFrame, spans: DataFrame | None = None) -> DataFrame:
    """``epoch, uid, field, value, set_seq`` of the live resources of each epoch at a point of its history.

    base: ``epoch, uid, field, value`` of the checkpoints; base_seq: ``epoch,
    from_seq``; at: ``epoch, seq``.  Ops after the checkpoint up to the point are
    applied to it.  spans: ``epoch, from_seq, to_seq`` of coalesced ranges; an
    epoch whose point lies within one has no rows, since its state there is lost.
    """
    if spans is not None:
        lost = in_spans(at.select("epoch", "seq"), spans, "epoch", "seq", "from_seq", "to_seq")
        at = at.join(lost.select("epoch"), "epoch", "left_anti")
    bound = at.select("epoch", F.col("seq").alias("until")).join(base_seq, "epoch", "left")
    run = ops.join(bound, "epoch").where((F.col("seq") <= F.col("until")) & (F.col("from_seq").isNull() | (F.col("seq") > F.col("from_seq"))))
    held = base.join(at.select("epoch"), "epoch", "left_semi").select(F.col("epoch").alias("scope"), F.col("uid").alias("key"), "field", "value")
    got = apply_changes(run, held, columns=FeedColumns())
    return got.select(F.col("scope").alias("epoch"), F.col("key").alias("uid"), "field", "value", "set_seq")


def boundaries(checkpoints: DataFrame, replayed: DataFrame) -> DataFrame:
    """``record_id, expected, got``: checkpoints (record_id, digest) whose content is not what replay gave (record_id, digest)."""
    both = checkpoints.select("record_id", F.col("digest").alias("expected")).join(replayed.select("record_id", F.col("digest").alias("got")), "record_id")
    return both.where(~F.col("expected").eqNullSafe(F.col("got")))


def content_digest(rows: DataFrame, keys: tuple[str, ...], content: Column) -> DataFrame:
    """``keys, n, digest`` of sets of rows, whatever their order and repetition: sums of row hashes.

    A sum aggregates on the map side, so that no set is collected; two sets would
    have to agree in two sums of 60-bit parts of a SHA-256.
    """
    h = F.sha2(content, 256)
    part = lambda i: F.conv(F.substring("h", 1 + 15 * i, 15), 16, 10).cast("decimal(38,0)")
    hashed = rows.select(*keys, h.alias("h")).distinct()
    return hashed.groupBy(*keys).agg(F.count("*").alias("n"), F.concat_ws("-", F.sum(part(0)).cast("string"), F.sum(part(1)).cast("string")).alias("digest"))


def chain_hashes(records: DataFrame, scope: str = "epoch", genesis: str = "") -> DataFrame:
    """``scope, seq, chain``: SHA-256 of the hash before and each record's ``hash`` (text), from the genesis of the scope on.

    Records must be single; a scope is sorted over its partition and streamed, so
    that only one hash is held at a time.
    """
    rows = records.select(scope, "seq", "hash").repartition(scope).sortWithinPartitions(scope, "seq")

    def walk(batches):
        at, chain = None, ""
        for pdf in batches:
            out = []
            for s, h in zip(pdf[scope], pdf["hash"]):
                if s != at:
                    at, chain = s, genesis
                chain = hashlib.sha256((chain + (h or "")).encode()).hexdigest()
                out.append(chain)
            yield pd.DataFrame({scope: pdf[scope], "seq": pdf["seq"], "chain": out})

    return rows.mapInPandas(walk, f"{scope} string, seq long, chain string")


def admit_items(items: DataFrame, cursors: DataFrame, keys: tuple[str, ...] = ("node", "queue")) -> tuple[DataFrame, DataFrame]:
    """(items to take, cursors after): items with a seq up to the cursor of their queue were taken before.

    Repeated deliveries of (keys, seq) count once.  A repeated call with the
    cursors that it returned takes nothing, so that a retried batch is harmless.
    """
    rest = [c for c in items.columns if c not in (*keys, "seq")]
    single = items.dropna(subset=[*keys, "seq"]).groupBy(*keys, "seq").agg(F.min(F.struct(*rest)).alias("r")).select(*keys, "seq", "r.*")
    known = cursors.groupBy(*keys).agg(F.max("cursor").alias("cursor"))
    fresh = single.join(known, list(keys), "left").where(F.col("cursor").isNull() | (F.col("seq") > F.col("cursor"))).drop("cursor")
    after = known.unionByName(single.groupBy(*keys).agg(F.max("seq").alias("cursor"))).groupBy(*keys).agg(F.max("cursor").alias("cursor"))
    return fresh, after


def forget(records: DataFrame, committed: DataFrame, scope: str = "epoch") -> DataFrame:
    """Records (scope, seq, hash) that must be kept: those above the committed seq, all where the hash at it disagrees."""
    at = committed.select(scope, F.col("seq").alias("done"), F.col("hash").alias("done_hash"))
    agrees = records.join(at, scope).where((F.col("seq") == F.col("done")) & (F.col("hash") == F.col("done_hash"))).select(scope, "done").distinct()
    return records.join(agrees, scope, "left").where(F.col("done").isNull() | (F.col("seq") > F.col("done"))).drop("done")


def coalesce_oldest(records: DataFrame, target: int, scope: str = "epoch", size: str = "bytes") -> DataFrame:
    """``scope, from_seq, to_seq, records, bytes``: the oldest run of each scope that must be folded so that the rest fits ``target``.

    Runs of one record are left as they are.
    """
    newest = Window.partitionBy(scope).orderBy(F.desc("seq")).rowsBetween(Window.unboundedPreceding, 0)
    old = records.withColumn("kept", F.sum(size).over(newest)).where(F.col("kept") > target)
    return old.groupBy(scope).agg(F.min("seq").alias("from_seq"), F.max("seq").alias("to_seq"), F.count("*").alias("records"), F.sum(size).alias("bytes")).where("records > 1")


def write_rate(writes: DataFrame, alpha: float = 0.3, scope: str = "epoch", value: str = "bytes", at: str = "seq") -> DataFrame:
    """``scope, rate``: exponential average of the values in order, the first one as its start.

    In closed form: weights fall by ``1 - alpha`` from the newest on; those under
    the smallest double are 0.
    """
    back = F.row_number().over(Window.partitionBy(scope).orderBy(F.desc(at))) - 1
    first = F.col("back") == F.max("back").over(Window.partitionBy(scope))
    weight = F.pow(F.lit(1 - alpha), F.col("back")) * F.when(first, 1.0).otherwise(alpha)
    return writes.withColumn("back", back).withColumn("w", weight).groupBy(scope).agg(F.sum(F.col("w") * F.col(value)).alias("rate"))


def overview(records: DataFrame, scope: tuple[str, ...] = ("epoch",)) -> DataFrame:
    """``scope, first_seq, head, records, ops, missing, first_ms, last_ms`` of each epoch; each op counts once."""
    single = records.groupBy(*scope, "seq", "idx").agg(F.min("time_ms").alias("t"))
    got = single.groupBy(*scope).agg(F.min("seq").alias("first_seq"), F.max("seq").alias("head"), F.count_distinct("seq").alias("records"), F.count("*").alias("ops"), F.min("t").alias("first_ms"), F.max("t").alias("last_ms"))
    return got.withColumn("missing", F.col("head") - F.col("first_seq") + 1 - F.col("records"))


def kv_state(changes: DataFrame, prefix: str = "") -> DataFrame:
    """``key, value`` of a key-value store after its changes (seq, key, value, deleted): the last change of a key counts."""
    mine = changes.where(F.col("key").startswith(prefix) & F.col("seq").isNotNull())
    last = mine.groupBy("key").agg(F.max(F.struct("seq", F.coalesce("deleted", F.lit(False)).alias("gone"), "value")).alias("z"))
    return last.where("not z.gone").select("key", "z.value")


def queue_after(appended: DataFrame, acked: DataFrame, keys: tuple[str, ...] = ("node", "queue")) -> DataFrame:
    """Items that a durable queue still holds: appended ones above what was acknowledged (keys, seq), each once, oldest first in ``place``."""
    fresh, _ = admit_items(appended, acked.withColumnRenamed("seq", "cursor"), keys)
    return fresh.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy("seq")))
