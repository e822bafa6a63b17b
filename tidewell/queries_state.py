"""Queries over the change history, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.operators import state as st
from tidewell.operators.snapshots import follow
from tidewell.queries_core import SQL as CORE_SQL
from tidewell.workspace import Workspace

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def middle(ops: DataFrame) -> DataFrame:
    """``epoch, cut``: the point half way through each epoch's numbers."""
    return ops.groupBy("epoch").agg(F.floor((F.min("seq") + F.max("seq")) / 2).alias("cut"))


_CUT = "c AS (SELECT epoch, (min(seq) + max(seq)) // 2 AS cut FROM ops GROUP BY epoch)"


def pairs_text(fields: Column) -> Column:
    """A map of JSON texts as one text, in order of its keys; numbers as they are written."""
    return F.array_join(F.transform(F.array_sort(F.map_entries(fields)), lambda e: F.concat(e["key"], F.lit("="), F.coalesce(e["value"], F.lit("null")))), "; ")


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_O = "o AS (SELECT epoch, uid, op, fields, removed, kind, name, {'s': seq, 'i': idx} AS pos, seq FROM ops WHERE op IN (1, 2, 3))"
_CELLS = """cells AS (
  SELECT epoch, uid, pos, k, json_extract(fields, '$."' || k || '"') AS v FROM (SELECT *, unnest(json_keys(fields)) AS k FROM {o} WHERE op IN (1, 2) AND fields IS NOT NULL)
  UNION ALL SELECT epoch, uid, pos, unnest(removed), NULL FROM {o} WHERE op = 2 AND removed IS NOT NULL),
cell AS (SELECT epoch, uid, k, pos, bool_or(v IS NULL OR json_type(v) = 'NULL') AS gone, max(v::VARCHAR) AS v FROM cells GROUP BY ALL)"""
# a number is shown by its value, anything else as its JSON text without spaces
_SHOWN = "CASE WHEN gone THEN 'null' WHEN json_type(v) IN ('UBIGINT', 'BIGINT') THEN v WHEN json_type(v) = 'DOUBLE' THEN regexp_replace(v, '\\.0$', '') ELSE json(v)::VARCHAR END"


@query
def state_at_seq(spark: SparkSession, d: str) -> DataFrame:
    """Live resources of each epoch with their fields, half way through its history."""
    ops = table(spark, d, "ops")
    got = st.resources_at(ops.join(middle(ops), "epoch").where("seq <= cut"))
    return got.select("epoch", "uid", "kind", "name", F.size("fields").alias("n_fields"), pairs_text(F.col("fields")).alias("fields"))


SQL["state_at_seq"] = f"""WITH {_CUT}, {_O}, p AS (SELECT o.* FROM o JOIN c ON c.epoch = o.epoch AND seq <= cut), {_CELLS.format(o='p')},
life AS (SELECT epoch, uid, max(pos) AS born, arg_max(op, pos) AS op, arg_max(kind, pos) AS kind, arg_max(name, pos) AS name FROM p WHERE op <> 2 GROUP BY ALL),
n AS (SELECT c.epoch, c.uid, c.k, arg_max(c.gone, c.pos) AS gone, arg_max(c.v, c.pos) AS v FROM cell c JOIN life l ON l.epoch = c.epoch AND l.uid = c.uid AND c.pos >= l.born GROUP BY ALL)
SELECT l.epoch, l.uid, l.kind, l.name, (count(n.k) FILTER (NOT n.gone))::INT AS n_fields, coalesce(string_agg(k || '=' || {_SHOWN}, '; ' ORDER BY k) FILTER (NOT n.gone), '') AS fields
FROM life l LEFT JOIN n ON n.epoch = l.epoch AND n.uid = l.uid WHERE l.op = 1 GROUP BY ALL"""


@query
def state_fold(spark: SparkSession, d: str) -> DataFrame:
    """Net effect of the second half of each epoch on each resource."""
    ops = table(spark, d, "ops")
    got = st.fold(ops.join(middle(ops), "epoch").where("seq > cut"))
    return got.select("epoch", "uid", "op", F.coalesce(F.size("fields"), F.lit(0)).alias("n_fields"), F.coalesce(pairs_text(F.col("fields")), F.lit("")).alias("fields"))


_FOLDED = f"""WITH {_CUT}, {_O}, p AS (SELECT o.* FROM o JOIN c ON c.epoch = o.epoch AND seq > cut), {_CELLS.format(o='p')},
e AS (SELECT epoch, uid, arg_min(op, pos) AS f, arg_max(op, pos) AS z, max(pos) FILTER (op = 1) AS born FROM p GROUP BY ALL),
n AS (SELECT epoch, uid, born, CASE WHEN f = 1 AND z <> 3 THEN 1 WHEN f <> 1 AND z = 3 THEN 3 WHEN f <> 1 THEN 2 END AS op FROM e WHERE NOT (f = 1 AND z = 3)),
x AS (SELECT cell.epoch, cell.uid, k, arg_max(gone, pos) AS gone, arg_max(v, pos) AS v FROM cell JOIN n ON n.epoch = cell.epoch AND n.uid = cell.uid AND (n.born IS NULL OR pos >= n.born) GROUP BY ALL)
"""
SQL["state_fold"] = _FOLDED + f"""SELECT n.epoch, n.uid, n.op, (count(x.k) FILTER (n.op = 2 OR n.op = 1 AND NOT x.gone))::INT AS n_fields, coalesce(string_agg(k || '=' || {_SHOWN}, '; ' ORDER BY k) FILTER (n.op = 2 OR n.op = 1 AND NOT x.gone), '') AS fields
FROM n LEFT JOIN x ON x.epoch = n.epoch AND x.uid = n.uid GROUP BY n.epoch, n.uid, n.op"""


@query
def illegal_ops(spark: SparkSession, d: str) -> DataFrame:
    return st.illegal_ops(table(spark, d, "ops"))


SQL["illegal_ops"] = """WITH o AS (SELECT DISTINCT epoch, uid, seq, idx, op FROM ops WHERE op IN (1, 2, 3)),
s AS (SELECT *, coalesce(last_value(CASE WHEN op <> 2 THEN op END IGNORE NULLS) OVER (PARTITION BY epoch, uid ORDER BY seq, idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) = 1, false) AS live FROM o)
SELECT epoch, seq, idx, op, uid, CASE op WHEN 1 THEN 'create of a live resource' WHEN 2 THEN 'update of an absent resource' ELSE 'delete of an absent resource' END AS reason
FROM s WHERE (op = 1) = live"""


@query
def standing_edges(spark: SparkSession, d: str) -> DataFrame:
    """Edges that stand at the end of each epoch, of every type."""
    return st.edges_at(table(spark, d, "ops")).select("epoch", "from_uid", "type", "to_uid")


_EDGES = "e AS (SELECT epoch, uid AS from_uid, edge_type AS type, to_uid FROM (SELECT epoch, uid, edge_type, to_uid, arg_max(op, {'s': seq, 'i': idx}) AS op FROM ops WHERE op IN (4, 5, 6) GROUP BY ALL) WHERE op <> 5)"
SQL["standing_edges"] = f"WITH {_EDGES} SELECT * FROM e"


@query
def graph_reach(spark: SparkSession, d: str) -> DataFrame:
    """Resources within three hops along owns and runs-on edges of every resource that a standing edge leaves.

    Resources are numbered first, so that the walk shuffles numbers and not uids.
    """
    ws = Workspace(spark)
    edges = ws.write(st.edges_at(table(spark, d, "ops").withColumn("attrs", F.lit(None).cast("string"))).drop("attrs"), "edges")
    ends = edges.select("epoch", F.col("from_uid").alias("uid")).union(edges.select("epoch", "to_uid")).distinct()
    nodes = ws.write(ends.withColumn("id", F.monotonically_increasing_id()), "nodes")
    source = nodes.select("epoch", F.col("uid").alias("from_uid"), F.col("id").alias("a"))
    target = nodes.select("epoch", F.col("uid").alias("to_uid"), F.col("id").alias("b"))
    links = ws.write(edges.join(source, ["epoch", "from_uid"]).join(target, ["epoch", "to_uid"]).select(F.col("a").alias("from_uid"), "type", F.col("b").alias("to_uid")), "links")
    walk = st.graph_walk(links, links.select(F.col("from_uid").alias("uid")), depth=3, direction="out", types=("owns", "runs-on"), scope=())
    found = walk.groupBy("start").agg(F.count("*").alias("reached"), F.max("depth").alias("deepest"))
    return found.join(nodes, found["start"] == nodes["id"]).select("epoch", F.col("uid").alias("start"), "reached", "deepest")


SQL["graph_reach"] = f"""WITH RECURSIVE {_EDGES}, g AS (SELECT epoch, from_uid AS a, to_uid AS b FROM e WHERE type IN ('owns', 'runs-on')),
w AS (SELECT DISTINCT epoch, from_uid AS start, from_uid AS uid, 0 AS depth FROM e
  UNION SELECT w.epoch, w.start, g.b, w.depth + 1 FROM w JOIN g ON g.epoch = w.epoch AND g.a = w.uid WHERE w.depth < 3),
m AS (SELECT epoch, start, uid, min(depth) AS depth FROM w GROUP BY ALL)
SELECT epoch, start, count(*) AS reached, max(depth)::INT AS deepest FROM m GROUP BY ALL"""


@query
def scope_status(spark: SparkSession, d: str) -> DataFrame:
    return st.scopes_at(table(spark, d, "ops")).select("epoch", "scope_key", "state", "reason", "since_ms")


SQL["scope_status"] = "SELECT epoch, scope_key, s.state AS state, s.reason AS reason, s.since_ms AS since_ms FROM (SELECT epoch, scope_key, arg_max(scope, {'s': seq, 'i': idx}) AS s FROM ops WHERE op = 7 GROUP BY ALL)"


@query
def edge_history(spark: SparkSession, d: str) -> DataFrame:
    """Edge ops of every type in the second half of the table's time."""
    ops = table(spark, d, "ops")
    low, high = ops.agg(F.min("time_ms"), F.max("time_ms")).first()
    return st.edge_history(ops, start_ms=None if low is None else (low + high) // 2)


SQL["edge_history"] = "SELECT DISTINCT epoch, seq, idx, op, uid, edge_type, to_uid, time_ms FROM ops WHERE op IN (4, 5, 6) AND time_ms >= (SELECT (min(time_ms) + max(time_ms)) // 2 FROM ops)"


@query
def record_copies(spark: SparkSession, d: str) -> DataFrame:
    """Ops delivered more than once."""
    ops = table(spark, d, "ops")
    return st.record_duplicates(ops, ("epoch", "seq", "idx"), F.xxhash64("op", "uid", "to_uid", "edge_type", "scope_key"))


SQL["record_copies"] = "SELECT epoch, seq, idx, count(*) AS copies, count(DISTINCT (op, uid, to_uid, edge_type, scope_key)) > 1 AS divergent FROM ops GROUP BY epoch, seq, idx HAVING count(*) > 1"


@query
def numbering_gaps(spark: SparkSession, d: str) -> DataFrame:
    return st.chain_gaps(table(spark, d, "ops"))


SQL["numbering_gaps"] = "SELECT * FROM (SELECT epoch, seq AS after_seq, lead(seq) OVER (PARTITION BY epoch ORDER BY seq) AS next_seq FROM (SELECT DISTINCT epoch, seq FROM ops)) WHERE next_seq > after_seq + 1"


@query
def snapshot_diff_ops(spark: SparkSession, d: str) -> DataFrame:
    """Creates, updates and deletes between consecutive checkpoints, counted."""
    rows = table(spark, d, "checkpoint_resources").dropDuplicates(["record_id", "uid"]).withColumn("fields", F.map_filter(F.coalesce(st.fields_map(F.col("fields")), F.create_map().cast("map<string,string>")), lambda _, v: v.isNotNull()))
    pairs = follow(table(spark, d, "checkpoints"))
    old = rows.join(pairs.select("record_id", "prev_record").withColumnsRenamed({"record_id": "pair", "prev_record": "record_id"}), "record_id").drop("record_id")
    new = rows.join(pairs.select("record_id"), "record_id").withColumnRenamed("record_id", "pair")
    return st.diff_resources(old, new, ("pair", "uid")).groupBy("pair", "op").agg(F.count("*").alias("n"))


SQL["snapshot_diff_ops"] = f"WITH f AS ({CORE_SQL['p4_found']}) SELECT record_id AS pair, CASE change_type WHEN 'added' THEN 1 WHEN 'removed' THEN 3 ELSE 2 END AS op, count(*) AS n FROM f GROUP BY ALL"
