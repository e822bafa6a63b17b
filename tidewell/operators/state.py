"""Resource and edge state: diff, apply, fold, reconstruction, histories, graph walks.

States are three frames: resources (uid, kind, namespace, name, fields MAP of
JSON texts), edges (from_uid, type, to_uid, attrs) and scopes.  Everything is a
key-wise aggregation or an equi-join; nothing replays records one by one.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CREATE, UPDATE, DELETE, EDGE_ADD, EDGE_REMOVE, EDGE_REPLACE, SCOPE_SET = range(1, 8)


def fields_map(json: Column) -> Column:
    """JSON object as a map of JSON texts; null members stay null."""
    values = F.from_json(json, "map<string,variant>")
    return F.transform_values(values, lambda _, v: F.when(v.isNotNull() & ~F.is_variant_null(v), F.to_json(v)))


def field_changes(old: Column, new: Column) -> Column:
    """Fields that are new or differ, with null for those that are gone."""
    both = F.map_zip_with(old, new, lambda _, a, b: F.struct(a.alias("a"), b.alias("b")))
    changed = F.map_filter(both, lambda _, v: ~v["a"].eqNullSafe(v["b"]))
    return F.transform_values(changed, lambda _, v: v["b"])


def diff_resources(old: DataFrame, new: DataFrame, keys: tuple[str, ...] = ("uid",)) -> DataFrame:
    """``keys, op, kind, namespace, name, fields``: creates, updates and deletes from old to new.

    A changed kind, namespace or name is told as an update of those columns.
    """
    rest = ["kind", "namespace", "name", "fields"]
    a = old.select(*keys, F.struct(*rest).alias("old"))
    b = new.select(*keys, F.struct(*rest).alias("new"))
    joined = a.join(b, list(keys), "full_outer")
    same = reduce(lambda x, y: x & y, [F.col(f"old.{c}").eqNullSafe(F.col(f"new.{c}")) for c in rest[:3]])
    changes = field_changes(F.coalesce("old.fields", F.create_map().cast("map<string,string>")), F.coalesce("new.fields", F.create_map().cast("map<string,string>")))
    op = F.when(F.col("old").isNull(), CREATE).when(F.col("new").isNull(), DELETE).when(~same | (F.size(changes) > 0), UPDATE)
    fields = F.when(F.col("old").isNull(), F.col("new.fields")).when(F.col("new").isNotNull(), changes)
    return joined.select(*keys, op.alias("op"), *[F.coalesce(F.col(f"new.{c}"), F.col(f"old.{c}")).alias(c) for c in rest[:3]], fields.alias("fields")).where(F.col("op").isNotNull())


def diff_edges(old: DataFrame, new: DataFrame, keys: tuple[str, ...] = ("from_uid", "type", "to_uid")) -> DataFrame:
    """``keys, op, attrs, prev_attrs``: edges added, removed and replaced; attributes (JSON texts) are compared by value."""
    from tidewell.operators.snapshots import canonical_json

    a = old.select(*keys, F.lit(True).alias("in_old"), F.col("attrs").alias("prev_attrs"))
    b = new.select(*keys, F.lit(True).alias("in_new"), "attrs")
    op = F.when(F.col("in_old").isNull(), EDGE_ADD).when(F.col("in_new").isNull(), EDGE_REMOVE).when(~canonical_json(F.col("attrs")).eqNullSafe(canonical_json(F.col("prev_attrs"))), EDGE_REPLACE)
    return a.join(b, list(keys), "full_outer").withColumn("op", op).where(F.col("op").isNotNull()).select(*keys, "op", "attrs", "prev_attrs")


def _newest(ops: DataFrame, keys: list[str], *columns: str) -> DataFrame:
    """The last op of each key, by (seq, idx)."""
    return ops.groupBy(*keys).agg(F.max(F.struct("seq", "idx", *columns)).alias("last"))


def edges_at(ops: DataFrame, scope: tuple[str, ...] = ("epoch",)) -> DataFrame:
    """``scope, from_uid, type, to_uid, attrs`` of the edges that stand after the ops."""
    edge = ops.where(F.col("op").isin(EDGE_ADD, EDGE_REMOVE, EDGE_REPLACE)).select(*scope, "seq", "idx", "op", "attrs", F.col("uid").alias("from_uid"), F.col("edge_type").alias("type"), "to_uid")
    last = _newest(edge, [*scope, "from_uid", "type", "to_uid"], "op", "attrs")
    return last.where(F.col("last.op") != EDGE_REMOVE).select(*scope, "from_uid", "type", "to_uid", "last.attrs")


def scopes_at(ops: DataFrame, scope: tuple[str, ...] = ("epoch",)) -> DataFrame:
    """Last status of each scope key."""
    return _newest(ops.where(F.col("op") == SCOPE_SET), [*scope, "scope_key"], "scope").select(*scope, "scope_key", "last.scope.*")


def resources_at(ops: DataFrame, scope: tuple[str, ...] = ("epoch",)) -> DataFrame:
    """``scope, uid, kind, namespace, name, fields`` of the live resources after the ops.

    Point-in-time reconstruction: filter the ops to seq <= n first.  Kind,
    namespace and name are those of the last create.
    """
    own = [*scope, "uid"]
    mine = ops.where(F.col("op").isin(CREATE, UPDATE, DELETE) & F.col("uid").isNotNull())
    life = _newest(mine.where(F.col("op") != UPDATE), own, "op", "kind", "namespace", "name")
    alive = life.where(F.col("last.op") == CREATE).select(*own, "last.kind", "last.namespace", "last.name", F.struct("last.seq", "last.idx").alias("born"))
    given = F.transform(F.map_entries(F.coalesce(fields_map(F.col("fields")), F.create_map().cast("map<string,string>"))), lambda e: F.struct(e["key"].alias("k"), e["value"].isNull().alias("gone"), e["value"].alias("v")))
    taken = F.transform(F.coalesce("removed", F.array().cast("array<string>")), lambda k: F.struct(k.alias("k"), F.lit(True).alias("gone"), F.lit(None).cast("string").alias("v")))
    cells = mine.where(F.col("op") != DELETE).select(*own, "seq", "idx", F.explode(F.concat(given, taken)).alias("c")).select(*own, "seq", "idx", "c.*")
    newest = _newest(cells, [*own, "k"], "gone", "v")
    held = newest.join(alive.select(*own, "born"), own).where((F.struct("last.seq", "last.idx") >= F.col("born")) & ~F.col("last.gone"))
    fields = held.groupBy(*own).agg(F.map_from_entries(F.collect_list(F.struct("k", "last.v"))).alias("fields"))
    return alive.drop("born").join(fields, own, "left").withColumn("fields", F.coalesce("fields", F.create_map().cast("map<string,string>")))


def fold(ops: DataFrame, scope: tuple[str, ...] = ("epoch",)) -> DataFrame:
    """Net effect of a contiguous run of ops on each resource: ``scope, uid, op, fields``.

    Created and deleted again: no row.  Created: one create with the fields in
    force.  Deleted: one delete.  Else one update in which a null stands for a
    removed field.
    """
    own = [*scope, "uid"]
    mine = ops.where(F.col("op").isin(CREATE, UPDATE, DELETE) & F.col("uid").isNotNull())
    ends = mine.groupBy(*own).agg(F.min(F.struct("seq", "idx", "op")).alias("first"), F.max(F.struct("seq", "idx", "op")).alias("last"), F.max(F.when(F.col("op") == CREATE, F.struct("seq", "idx"))).alias("born"))
    before, after = F.col("first.op") != CREATE, F.col("last.op") != DELETE
    net = F.when(~before & after, CREATE).when(before & ~after, DELETE).when(before & after, UPDATE)
    ends = ends.select(*own, net.alias("net"), "born").where(F.col("net").isNotNull())
    given = F.transform(F.map_entries(F.coalesce(fields_map(F.col("fields")), F.create_map().cast("map<string,string>"))), lambda e: F.struct(e["key"].alias("k"), e["value"].alias("v")))
    taken = F.transform(F.coalesce("removed", F.array().cast("array<string>")), lambda k: F.struct(k.alias("k"), F.lit(None).cast("string").alias("v")))
    cells = mine.where(F.col("op") != DELETE).select(*own, "seq", "idx", F.explode(F.concat(given, taken)).alias("c")).select(*own, "seq", "idx", "c.*")
    newest = _newest(cells, [*own, "k"], "v").join(ends, own).where(F.col("born").isNull() | (F.struct("last.seq", "last.idx") >= F.col("born")))
    newest = newest.where((F.col("net") == UPDATE) | (F.col("net") == CREATE) & F.col("last.v").isNotNull())
    fields = newest.groupBy(*own).agg(F.map_from_entries(F.collect_list(F.struct("k", "last.v"))).alias("fields"))
    return ends.join(fields, own, "left").select(*own, F.col("net").cast("int").alias("op"), "fields")


def illegal_ops(ops: DataFrame, scope: tuple[str, ...] = ("epoch",)) -> DataFrame:
    """Ops that do not fit the state they meet: ``scope, seq, idx, op, reason``.

    A create of a live resource, an update or delete of one that is not; the
    state before an op is that of the last create or delete before it.
    """
    own = [*scope, "uid"]
    mine = ops.where(F.col("op").isin(CREATE, UPDATE, DELETE) & F.col("uid").isNotNull()).select(*own, "seq", "idx", "op").dropDuplicates([*own, "seq", "idx"])
    w = Window.partitionBy(*own).orderBy("seq", "idx").rowsBetween(Window.unboundedPreceding, -1)
    state = F.last(F.when(F.col("op") != UPDATE, F.col("op")), ignorenulls=True).over(w)
    live = F.coalesce(state == CREATE, F.lit(False))
    why = F.when((F.col("op") == CREATE) & live, "create of a live resource").when((F.col("op") == UPDATE) & ~live, "update of an absent resource").when((F.col("op") == DELETE) & ~live, "delete of an absent resource")
    return mine.withColumn("reason", why).where(F.col("reason").isNotNull()).select(*scope, "seq", "idx", "op", "uid", "reason")


def edge_history(ops: DataFrame, uid: str | None = None, edge_type: str | None = None, start_ms: int | None = None, end_ms: int | None = None) -> DataFrame:
    """Edge ops that touch a resource, of a type, in a closed time range; each op once."""
    df = ops.where(F.col("op").isin(EDGE_ADD, EDGE_REMOVE, EDGE_REPLACE))
    if uid is not None:
        df = df.where((F.col("uid") == uid) | (F.col("to_uid") == uid))
    if edge_type is not None:
        df = df.where(F.col("edge_type") == edge_type)
    if start_ms is not None:
        df = df.where(F.col("time_ms") >= start_ms)
    if end_ms is not None:
        df = df.where(F.col("time_ms") <= end_ms)
    cols = ["epoch", "seq", "idx", "op", "uid", "edge_type", "to_uid", "time_ms"]
    return df.select(*cols).dropDuplicates(["epoch", "seq", "idx"])


def record_duplicates(records: DataFrame, keys: tuple[str, ...], content_hash: Column) -> DataFrame:
    """``keys, copies, divergent``: records delivered more than once, and whether their contents differ."""
    return records.groupBy(*keys).agg(F.count("*").alias("copies"), (F.min(content_hash) != F.max(content_hash)).alias("divergent")).where("copies > 1")


def chain_gaps(records: DataFrame, scope: tuple[str, ...] = ("epoch",), seq: str = "seq") -> DataFrame:
    """``scope, after_seq, next_seq`` of holes in the numbering."""
    w = Window.partitionBy(*scope).orderBy(seq)
    once = records.select(*scope, seq).distinct()
    return once.select(*scope, F.col(seq).alias("after_seq"), F.lead(seq).over(w).alias("next_seq")).where(F.col("next_seq") > F.col("after_seq") + 1)


def in_spans(points: DataFrame, spans: DataFrame, scope: str, at: str, start: str, end: str) -> DataFrame:
    """Points that lie in a closed span of their scope (unavailable ranges); spans of a scope may overlap.

    Both are swept together in order, so that no range join is planned.
    """
    ups = spans.select(scope, F.col(start).alias("x"), F.lit(0).alias("o"), F.lit(1).alias("d"), F.lit(None).cast("struct<_:int>").alias("row"))
    downs = spans.select(scope, F.col(end).alias("x"), F.lit(2).alias("o"), F.lit(-1).alias("d"), F.lit(None).cast("struct<_:int>").alias("row"))
    tagged = points.select(scope, F.col(at).alias("x"), F.lit(1).alias("o"), F.lit(0).alias("d"), F.struct(*points.columns).alias("row"))
    marks = ups.unionByName(downs).drop("row").withColumn("row", F.lit(None).cast(tagged.schema["row"].dataType))
    w = Window.partitionBy(scope).orderBy("x", "o").rowsBetween(Window.unboundedPreceding, 0)
    return tagged.unionByName(marks).withColumn("open", F.sum("d").over(w)).where("row is not null and open > 0").select("row.*")


def absent_from_list(known: DataFrame, listed: DataFrame, keys: list[str]) -> DataFrame:
    """Scope reconciliation: what is known in a scope but not in its full list, hence deleted."""
    return known.join(listed.select(*keys), keys, "left_anti")


def carry_forward(previous: DataFrame, current: DataFrame, keys: list[str], failed_scopes: DataFrame, scope: str) -> DataFrame:
    """Current rows, and the previous ones of scopes whose collection failed."""
    kept = previous.join(failed_scopes.select(scope).distinct(), scope, "left_semi").join(current.select(*keys), keys, "left_anti")
    return current.unionByName(kept)


def neighbours(edges: DataFrame, direction: str = "out", types: tuple[str, ...] | None = None, scope: tuple[str, ...] = ("epoch",)) -> DataFrame:
    """``scope, uid, edges``: neighbours of each resource with edge attributes, in order of their uids."""
    df = edges.where(F.col("type").isin(*types)) if types else edges
    a, b = ("from_uid", "to_uid") if direction == "out" else ("to_uid", "from_uid")
    return df.groupBy(*scope, F.col(a).alias("uid")).agg(F.array_sort(F.collect_list(F.struct(F.col(b).alias("uid"), "type", "attrs"))).alias("edges"))


def graph_walk(edges: DataFrame, starts: DataFrame, *, depth: int = 5, direction: str = "both", types: tuple[str, ...] | None = None, scope: tuple[str, ...] = ("epoch",), visible: DataFrame | None = None) -> DataFrame:
    """``scope, start, uid, depth``: resources within ``depth`` hops (1 to 5) of each start, at their least depth.

    visible: optional ``scope, uid`` that a walk may enter.  Each level is an
    equi-join with the frontier and an anti-join with what was reached before.
    """
    if not 1 <= depth <= 5:
        raise ValueError("depth must be from 1 to 5")
    df = edges.where(F.col("type").isin(*types)) if types else edges
    out = df.select(*scope, F.col("from_uid").alias("uid"), F.col("to_uid").alias("next"))
    back = df.select(*scope, F.col("to_uid").alias("uid"), F.col("from_uid").alias("next"))
    steps = {"out": out, "in": back, "both": out.unionByName(back)}[direction].distinct()
    if visible is not None:
        steps = steps.join(visible.select(*scope, F.col("uid").alias("next")), [*scope, "next"], "left_semi")
    reached = frontier = starts.select(*scope, F.col("uid").alias("start"), "uid", F.lit(0).alias("depth")).distinct()
    key = [*scope, "start", "uid"]
    for d in range(1, depth + 1):
        new = frontier.join(steps, [*scope, "uid"]).select(*scope, "start", F.col("next").alias("uid"), F.lit(d).alias("depth")).distinct()
        frontier = new.join(reached.select(*key), key, "left_anti")
        reached = reached.unionByName(frontier)
    return reached


def selector_edges(owners: DataFrame, pods: DataFrame, edge_type: str) -> DataFrame:
    """``from_uid, type, to_uid``: label selectors that match the labels of objects in their namespace.

    owners: ``uid, namespace, selector MAP, expressions ARRAY<STRUCT<key, operator,
    values>>``; pods: ``uid, namespace, labels MAP``.  A selector with a pair is
    joined on (namespace, one pair of it); the rest of the selector is checked on
    what that join finds.  Only selectors without any pair are joined on the
    namespace alone.
    """
    least = F.element_at(F.array_sort(F.map_entries("selector")), 1)
    hung = owners.withColumn("selector", F.coalesce("selector", F.create_map().cast("map<string,string>"))).withColumn("pair", F.when(F.size("selector") > 0, least))
    o = hung.select(F.col("uid").alias("from_uid"), "namespace", "selector", "expressions", F.col("pair.key").alias("k"), F.col("pair.value").alias("v"))
    p = pods.select(F.col("uid").alias("to_uid"), "namespace", F.coalesce("labels", F.create_map().cast("map<string,string>")).alias("labels"))
    by_pair = o.where("k is not null").join(p.select("*", F.explode("labels").alias("k", "v")), ["namespace", "k", "v"])
    wide = o.where("k is null and expressions is not null and size(expressions) > 0").join(p, "namespace")
    value = lambda k: F.element_at(F.col("labels"), k)
    all_pairs = F.forall(F.map_entries("selector"), lambda e: F.coalesce(value(e["key"]) == e["value"], F.lit(False)))
    said = F.forall(
        F.coalesce("expressions", F.array().cast("array<struct<key:string,operator:string,values:array<string>>>")),
        lambda x: F.when(x["operator"] == "In", F.coalesce(F.array_contains(x["values"], value(x["key"])), F.lit(False))).when(x["operator"] == "NotIn", ~F.coalesce(F.array_contains(x["values"], value(x["key"])), F.lit(False))).when(x["operator"] == "Exists", value(x["key"]).isNotNull()).when(x["operator"] == "DoesNotExist", value(x["key"]).isNull()).otherwise(F.lit(False)),
    )
    cols = ["from_uid", "to_uid", "selector", "expressions", "labels"]
    return by_pair.select(*cols).unionByName(wide.select(*cols)).where(all_pairs & said).select("from_uid", F.lit(edge_type).alias("type"), "to_uid").distinct()


def state_query(resources: DataFrame, *, kinds: tuple[str, ...] | None = None, namespaces: tuple[str, ...] | None = None, names: tuple[str, ...] | None = None, where: dict[str, str] | None = None) -> DataFrame:
    """Resources by kind, namespace, name and field values (JSON text), in order of kind, namespace, name, uid."""
    df = resources
    for column, wanted in (("kind", kinds), ("namespace", namespaces), ("name", names)):
        df = df.where(F.col(column).isin(*wanted)) if wanted else df
    for path, text in (where or {}).items():
        df = df.where(F.element_at("fields", F.lit(path)) == text)
    return df.orderBy("kind", "namespace", "name", "uid")
