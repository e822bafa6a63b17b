"""The queries of the core problems, each with the SQL that it must agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.operators.changes import apply_changes
from tidewell.operators.dedup import further_copies
from tidewell.operators.findings import with_finding
from tidewell.operators.hierarchy import hierarchy, paths, standing_links
from tidewell.operators.snapshots import canonical_json, follow, snapshot_changes

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    now = apply_changes(table(spark, sf_dir, "ops"), with_values=False)
    return now.select(F.col("scope").alias("epoch"), F.col("key").alias("uid"), F.col("field").alias("field_name"), "set_seq")


_CELLS = """
WITH o AS (SELECT epoch, uid, op, fields, removed, {'s': seq, 'i': idx} AS pos FROM ops WHERE op IN (1, 2, 3)),
life AS (SELECT epoch, uid, arg_max(op, pos) AS op, max(pos) AS born FROM o WHERE op IN (1, 3) GROUP BY ALL),
alive AS (SELECT epoch, uid, born FROM life WHERE op = 1),
given AS (SELECT epoch, uid, pos, fields, unnest(json_keys(fields)) AS k FROM o WHERE op IN (1, 2) AND fields IS NOT NULL),
cells AS (
  SELECT epoch, uid, k, pos, json_extract(fields, '$."' || k || '"') AS v FROM given
  UNION ALL SELECT epoch, uid, unnest(removed), pos, NULL FROM o WHERE op = 2 AND removed IS NOT NULL),
gone AS (SELECT epoch, uid, k, pos, bool_or(v IS NULL OR json_type(v) = 'NULL') AS gone, max(v::VARCHAR) AS v FROM cells GROUP BY ALL),
newest AS (
  SELECT c.epoch, c.uid, c.k, max(c.pos) AS pos, arg_max(c.gone, c.pos) AS gone FROM gone c JOIN alive a ON a.epoch = c.epoch AND a.uid = c.uid AND c.pos >= a.born GROUP BY ALL)
"""
SQL["p1_found"] = _CELLS + "SELECT epoch, uid, k AS field_name, pos.s AS set_seq FROM newest WHERE NOT gone"


@query
def p1_current(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The live resources with the values of their fields."""
    now = apply_changes(table(spark, sf_dir, "ops"))
    return now.select(F.col("scope").alias("epoch"), F.col("key").alias("uid"), F.col("field").alias("field_name"), "value", "set_seq")


SQL["p1_current"] = _CELLS + """, last AS (SELECT c.epoch, c.uid, c.k, arg_max(c.v, c.pos) AS v FROM gone c JOIN alive a ON a.epoch = c.epoch AND a.uid = c.uid AND c.pos >= a.born GROUP BY ALL)
SELECT n.epoch, n.uid, n.k AS field_name, CASE WHEN json_type(l.v) = 'VARCHAR' THEN json_extract_string(l.v, '$') ELSE l.v END AS value, n.pos.s AS set_seq
FROM newest n JOIN last l ON l.epoch = n.epoch AND l.uid = n.uid AND l.k = n.k WHERE NOT n.gone"""


@query
def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = with_finding(table(spark, sf_dir, "summary_entries").select("delivery_id", "recv_ms", "target_id", "epoch", "seq", "dedup_key", "first_seen", "finding_id"))
    return further_copies(rows, [F.col("target_id"), F.col("epoch"), F.col("seq"), F.col("finding")], rank="recv_ms", row_id="delivery_id")


FINDINGS_SQL = """
WITH s AS (SELECT *, nullif(lower(trim(finding_id)), '') AS f FROM summary_entries),
n AS (SELECT target_id, dedup_key, first_seen, min(f) AS named FROM s WHERE f IS NOT NULL AND dedup_key IS NOT NULL GROUP BY ALL),
r AS (
  SELECT s.* EXCLUDE (f), coalesce(s.f, n.named, CASE WHEN s.dedup_key IS NULL OR s.first_seen IS NULL THEN 'row ' || s.delivery_id END, 'key ' || s.first_seen || ' ' || s.dedup_key) AS finding
  FROM s LEFT JOIN n ON s.target_id = n.target_id AND s.dedup_key = n.dedup_key AND s.first_seen = n.first_seen)
"""
SQL["p3_found"] = FINDINGS_SQL + """, k AS (SELECT delivery_id, row_number() OVER (PARTITION BY target_id, epoch, seq, finding ORDER BY recv_ms, delivery_id) AS n FROM r)
SELECT delivery_id FROM k WHERE n > 1"""


@query
def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = follow(table(spark, sf_dir, "checkpoints"))
    content = [F.col("kind"), F.col("namespace"), F.col("name"), canonical_json(F.col("fields"))]
    return snapshot_changes(pairs, table(spark, sf_dir, "checkpoint_resources"), content=content)


SQL["p4_found"] = """
WITH c AS (SELECT DISTINCT record_id, target_id, epoch, seq, prev_epoch FROM checkpoints),
i AS (SELECT *, lag(record_id) OVER (PARTITION BY target_id, epoch ORDER BY seq) AS p FROM c),
l AS (SELECT target_id, epoch, arg_max(record_id, seq) AS last FROM c GROUP BY ALL),
pairs AS (
  SELECT i.record_id, coalesce(i.p, l.last) AS p FROM i LEFT JOIN l ON i.p IS NULL AND i.prev_epoch = l.epoch AND i.target_id = l.target_id
  WHERE coalesce(i.p, l.last) IS NOT NULL),
cell AS (SELECT record_id, uid, kind, namespace, name, fields, unnest(CASE WHEN fields = '{}' THEN [NULL] ELSE json_keys(fields) END) AS k FROM checkpoint_resources),
v AS (SELECT DISTINCT record_id, uid, kind, namespace, name, k, json_extract(fields, '$."' || k || '"') AS v FROM cell),
r AS (
  SELECT record_id, uid, any_value(kind) AS kind, any_value(namespace) AS namespace, any_value(name) AS name,
    list_sort(list(k || '=' || CASE WHEN json_type(v) IN ('UBIGINT', 'BIGINT', 'DOUBLE') THEN (v::DOUBLE)::VARCHAR ELSE json(v)::VARCHAR END) FILTER (v IS NOT NULL AND json_type(v) <> 'NULL')) AS f
  FROM v GROUP BY record_id, uid),
n AS (SELECT pairs.record_id, r.* EXCLUDE (record_id) FROM pairs JOIN r ON r.record_id = pairs.record_id),
o AS (SELECT pairs.record_id, r.* EXCLUDE (record_id) FROM pairs JOIN r ON r.record_id = pairs.p),
b AS (
  SELECT coalesce(n.record_id, o.record_id) AS record_id, coalesce(n.uid, o.uid) AS uid,
    CASE WHEN o.uid IS NULL THEN 'added' WHEN n.uid IS NULL THEN 'removed'
      WHEN n.kind IS DISTINCT FROM o.kind OR n.namespace IS DISTINCT FROM o.namespace OR n.name IS DISTINCT FROM o.name OR n.f IS DISTINCT FROM o.f THEN 'changed' END AS change_type
  FROM n FULL JOIN o ON n.record_id = o.record_id AND n.uid = o.uid)
SELECT record_id, uid, change_type FROM b WHERE change_type IS NOT NULL"""


@query
def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = hierarchy(standing_links(table(spark, sf_dir, "ops")))
    return nodes.select(F.col("scope").alias("epoch"), "uid", "root_uid", "depth", "on_cycle")


_LINKS = """
WITH RECURSIVE e AS (
  SELECT epoch, uid, to_uid, arg_max(op, {'s': seq, 'i': idx}) AS op, arg_max(coalesce(attrs, '{}'), {'s': seq, 'i': idx}) AS attrs
  FROM ops WHERE op IN (4, 5, 6) AND edge_type = 'owns' GROUP BY ALL),
l AS (SELECT epoch, uid AS p, to_uid AS v FROM e WHERE op <> 5 AND json_extract(attrs, '$.controller')::VARCHAR = 'true'),
nodes AS (SELECT epoch, p AS uid FROM l UNION SELECT epoch, v FROM l),
tree AS (
  SELECT epoch, uid, uid AS root, 0 AS depth, [uid] AS path FROM nodes n WHERE NOT EXISTS (SELECT 1 FROM l WHERE l.epoch = n.epoch AND l.v = n.uid)
  UNION ALL SELECT t.epoch, l.v, t.root, t.depth + 1, list_append(t.path, l.v) FROM tree t JOIN l ON l.epoch = t.epoch AND l.p = t.uid),
stuck AS (SELECT n.epoch, n.uid FROM nodes n LEFT JOIN tree t ON t.epoch = n.epoch AND t.uid = n.uid WHERE t.uid IS NULL),
up AS (
  SELECT s.epoch, s.uid, l.p AS a FROM stuck s JOIN l ON l.epoch = s.epoch AND l.v = s.uid
  UNION SELECT u.epoch, u.uid, l.p FROM up u JOIN l ON l.epoch = u.epoch AND l.v = u.a),
ring AS (SELECT epoch, uid FROM up WHERE uid = a)
"""
SQL["p5_found"] = _LINKS + """
SELECT epoch, uid, root AS root_uid, depth, 0 AS on_cycle FROM tree
UNION ALL SELECT u.epoch, u.uid, min(u.a) FILTER (r.uid IS NOT NULL), -1, max(CASE WHEN u.uid = u.a THEN 1 ELSE 0 END)
FROM up u LEFT JOIN ring r ON r.epoch = u.epoch AND r.uid = u.a GROUP BY u.epoch, u.uid"""


@query
def p5_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Full path and number of descendants of each resource that is on no cycle and below none."""
    nodes = hierarchy(standing_links(table(spark, sf_dir, "ops")))
    size = nodes.select("scope", "uid", (F.col("exit") - F.col("enter")).alias("n_descendants"))
    return paths(nodes).join(size, ["scope", "uid"]).select(F.col("scope").alias("epoch"), "uid", F.array_join("path", "/").alias("path"), "n_descendants")


SQL["p5_paths"] = _LINKS + """
, below AS (SELECT epoch, unnest(path) AS uid FROM tree)
SELECT t.epoch, t.uid, array_to_string(t.path, '/') AS path, b.n - 1 AS n_descendants
FROM tree t JOIN (SELECT epoch, uid, count(*) AS n FROM below GROUP BY ALL) b ON b.epoch = t.epoch AND b.uid = t.uid"""
