"""Runs of records, and joins of facts, series and images with the graph, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.api import Engine, Scope
from tidewell.operators import history, joins
from tidewell.operators import state as st
from tidewell.operators.findings import lifecycle_summary, with_finding
from tidewell.operators.snapshots import canonical_json, follow
from tidewell.queries_core import FINDINGS_SQL
from tidewell.queries_core import SQL as CORE_SQL
from tidewell.queries_engine import span
from tidewell.queries_state import _CUT, _EDGES, middle
from tidewell.sources.tables import event_samples, label_map
from tidewell.workspace import Workspace

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_ONCE = "u AS (SELECT DISTINCT epoch, seq, idx, op, uid, edge_type, to_uid, scope_key FROM ops)"


@query
def ops_ordered(spark: SparkSession, d: str) -> DataFrame:
    """Place of each op in the canonical order of its record."""
    ops = table(spark, d, "ops").select("epoch", "seq", "idx", "op", "uid", "edge_type", "to_uid", "scope_key").distinct()
    return history.canonical_order(ops, ("epoch", "seq")).select("epoch", "seq", "idx", "position")


SQL["ops_ordered"] = f"""WITH {_ONCE} SELECT epoch, seq, idx, row_number() OVER (PARTITION BY epoch, seq ORDER BY CASE WHEN op <= 3 THEN 1 WHEN op <= 6 THEN 2 ELSE 3 END, coalesce(uid, ''), coalesce(edge_type, ''), coalesce(to_uid, ''), coalesce(scope_key, ''), idx)::INT AS position FROM u"""


@query
def fold_errors(spark: SparkSession, d: str) -> DataFrame:
    """Ops that the run of an epoch's second half must not hold."""
    ops = table(spark, d, "ops")
    return history.fold_errors(ops.join(middle(ops), "epoch").where("seq > cut"))


SQL["fold_errors"] = f"""WITH {_CUT}, {_ONCE}, m AS (SELECT u.* FROM u JOIN c ON c.epoch = u.epoch AND seq > cut WHERE op <= 6 AND uid IS NOT NULL),
b AS (SELECT *, lag(op) OVER (PARTITION BY epoch, uid, op > 3, CASE WHEN op > 3 THEN edge_type END, CASE WHEN op > 3 THEN to_uid END ORDER BY seq, idx) AS b FROM m),
r AS (SELECT epoch, seq, idx, op, CASE WHEN op <= 3 AND b = 3 THEN 'after delete of the resource' WHEN op = 1 AND b IS NOT NULL THEN 'create of an existing resource' WHEN op = 4 AND b IN (4, 6) THEN 'add of an existing edge' WHEN op IN (5, 6) AND b = 5 THEN 'remove or replace of an absent edge' END AS reason FROM b)
SELECT * FROM r WHERE reason IS NOT NULL"""


@query
def fold_edges(spark: SparkSession, d: str) -> DataFrame:
    """Net effect of the second half of each epoch on each edge."""
    ops = table(spark, d, "ops")
    got = history.fold_edges(ops.join(middle(ops), "epoch").where("seq > cut"))
    text = lambda c: F.get_json_object(c, "$.controller")
    return got.select("epoch", "op", "from_uid", "type", "to_uid", text("attrs").alias("controller"), text("prev_attrs").alias("before"))


_JSON = "coalesce(array_to_string(list_sort(list_transform(json_keys({0}), lambda k: k || '=' || json_extract({0}, '$.\"' || k || '\"')::VARCHAR)), ','), '')"
SQL["fold_edges"] = f"""WITH {_CUT}, m AS (SELECT ops.epoch, uid, edge_type, to_uid, op, attrs, prev_attrs, {{'s': seq, 'i': idx}} AS pos FROM ops JOIN c ON c.epoch = ops.epoch AND seq > cut WHERE op IN (4, 5, 6)),
e AS (SELECT epoch, uid, edge_type, to_uid, arg_min(op, pos) AS a, arg_max(op, pos) AS z, arg_min(coalesce(CASE WHEN op = 5 THEN attrs ELSE prev_attrs END, '-'), pos) AS old, arg_max(coalesce(attrs, '-'), pos) AS now FROM m GROUP BY ALL),
v AS (SELECT *, nullif(old, '-') AS o, nullif(now, '-') AS w FROM e),
n AS (SELECT *, CASE WHEN a = 4 AND z <> 5 THEN 4 WHEN a <> 4 AND z = 5 THEN 5 WHEN a <> 4 AND {_JSON.format('o')} IS DISTINCT FROM {_JSON.format('w')} THEN 6 END AS op FROM v WHERE NOT (a = 4 AND z = 5))
SELECT epoch, op, uid AS from_uid, edge_type AS type, to_uid, json_extract_string(CASE WHEN op = 5 THEN o ELSE w END, '$.controller') AS controller, CASE WHEN op = 6 THEN json_extract_string(o, '$.controller') END AS before FROM n WHERE op IS NOT NULL"""


@query
def fold_scopes(spark: SparkSession, d: str) -> DataFrame:
    ops = table(spark, d, "ops")
    return history.fold_scopes(ops.join(middle(ops), "epoch").where("seq > cut")).select("epoch", "scope_key", "state", "since_ms")


SQL["fold_scopes"] = f"WITH {_CUT}, m AS (SELECT ops.epoch, scope_key, arg_max(scope, {{'s': seq, 'i': idx}}) AS s FROM ops JOIN c ON c.epoch = ops.epoch AND seq > cut WHERE op = 7 GROUP BY ALL) SELECT epoch, scope_key, s.state AS state, s.since_ms AS since_ms FROM m"


@query
def reconstructed(spark: SparkSession, d: str) -> DataFrame:
    """Fields at the end of each epoch, from a checkpoint half way and the ops after it."""
    ops = table(spark, d, "ops")
    cut = middle(ops)
    half = st.resources_at(ops.join(cut, "epoch").where("seq <= cut"))
    base = Workspace(spark).write(half.select("epoch", "uid", F.explode("fields").alias("field", "json")).select("epoch", "uid", "field", F.coalesce(F.get_json_object(F.concat(F.lit('{"v":'), "json", F.lit("}")), "$.v"), F.col("json")).alias("value")), "base")
    at = ops.groupBy("epoch").agg(F.max("seq").alias("seq"))
    got = history.reconstruct(ops, base, cut.withColumnRenamed("cut", "from_seq"), at)
    return got.groupBy("epoch", "uid").agg(F.count("*").alias("n_fields"), F.count("set_seq").alias("set_later"))


SQL["reconstructed"] = f"""WITH {_CUT}, x AS ({CORE_SQL['p1_found']}) SELECT x.epoch, uid, count(*) AS n_fields, count(*) FILTER (set_seq > cut) AS set_later FROM x JOIN c ON c.epoch = x.epoch GROUP BY ALL"""


@query
def unavailable_points(spark: SparkSession, d: str) -> DataFrame:
    """Epochs whose middle lies in a hole of their numbering, and those with a state there."""
    ops = table(spark, d, "ops")
    spans = st.chain_gaps(ops).select("epoch", (F.col("after_seq") + 1).alias("from_seq"), (F.col("next_seq") - 1).alias("to_seq"))
    at = middle(ops).withColumnRenamed("cut", "seq")
    lost = st.in_spans(at, spans, "epoch", "seq", "from_seq", "to_seq")
    return at.join(lost.select("epoch", F.lit(True).alias("hit")), "epoch", "left").select("epoch", "seq", F.coalesce("hit", F.lit(False)).alias("unavailable"))


SQL["unavailable_points"] = f"WITH {_CUT} SELECT epoch, cut AS seq, NOT EXISTS (SELECT 1 FROM ops WHERE ops.epoch = c.epoch AND ops.seq = c.cut) AS unavailable FROM c"


@query
def checkpoint_boundaries(spark: SparkSession, d: str) -> DataFrame:
    """Checkpoints whose content differs from the one before, told by digests of their rows."""
    rows = table(spark, d, "checkpoint_resources").where("uid is not null")
    digests = Workspace(spark).write(history.content_digest(rows, ("record_id",), F.to_json(F.struct("uid", "kind", "namespace", "name", canonical_json(F.col("fields")).alias("f")))), "digests")
    pairs = follow(table(spark, d, "checkpoints"))
    before = pairs.join(digests.withColumnRenamed("record_id", "prev_record"), "prev_record").select("record_id", "digest")
    return history.boundaries(digests, before).select("record_id")


@query
def chain_hashes(spark: SparkSession, d: str) -> DataFrame:
    """Chain hash of every op of each epoch, from the hash before it and its own."""
    ops = table(spark, d, "ops").select("epoch", F.col("seq").cast("long"), "idx", "op").distinct()
    records = ops.groupBy("epoch", "seq").agg(F.md5(F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "idx", "op"))), ",")).alias("hash"))
    got = history.chain_hashes(records, genesis="g")
    return got.groupBy("epoch").agg(F.max_by("chain", "seq").alias("head_hash"), F.count("*").alias("records"))


SQL["chain_hashes"] = """WITH u AS (SELECT DISTINCT epoch, seq, idx, op FROM ops), r AS (SELECT epoch, seq, md5(string_agg(idx || ':' || op, ',' ORDER BY idx || ':' || op)) AS h FROM u GROUP BY ALL),
l AS (SELECT epoch, list(h ORDER BY seq) AS hs FROM r GROUP BY epoch) SELECT epoch, list_reduce(list_prepend('g', hs), lambda a, b: sha256(a || b)) AS head_hash, len(hs) AS records FROM l"""


@query
def ingest_again(spark: SparkSession, d: str) -> DataFrame:
    """Cursors of delivered entries after two batches, and how many items each of them took."""
    s = table(spark, d, "summary_entries").select(F.col("target_id").alias("node"), F.col("epoch").alias("queue"), "seq", "state")
    first, cursors = history.admit_items(s.where("seq % 3 <> 0"), spark.createDataFrame([], "node string, queue string, cursor long"))
    cursors = Workspace(spark).write(cursors, "cursors")
    second, after = history.admit_items(s, cursors)
    took = lambda df, n: df.groupBy("node", "queue").agg(F.count("*").alias(n))
    return after.join(took(first, "first"), ["node", "queue"], "left").join(took(second, "second"), ["node", "queue"], "left").na.fill(0, ["first", "second"])


SQL["ingest_again"] = """WITH s AS (SELECT DISTINCT target_id AS node, epoch AS queue, seq FROM summary_entries WHERE target_id IS NOT NULL AND epoch IS NOT NULL AND seq IS NOT NULL),
c AS (SELECT node, queue, max(seq) FILTER (seq % 3 <> 0) AS m, count(*) FILTER (seq % 3 <> 0) AS first, max(seq) AS cursor FROM s GROUP BY ALL)
SELECT c.node, c.queue, c.cursor, c.first, (SELECT count(*) FROM s WHERE s.node = c.node AND s.queue = c.queue AND (c.m IS NULL OR s.seq > c.m)) AS second FROM c"""


@query
def forgotten(spark: SparkSession, d: str) -> DataFrame:
    """Records that stay after the first half of each epoch was committed; half of the commits disagree in their hash."""
    ops = table(spark, d, "ops")
    records = ops.select("epoch", "seq").distinct().withColumn("hash", F.md5(F.concat_ws("/", "epoch", "seq")))
    point = records.join(middle(ops), "epoch").where("seq <= cut").groupBy("epoch").agg(F.max("seq").alias("seq"))
    done = point.withColumn("hash", F.when(F.col("seq") % 2 == 0, F.md5(F.concat_ws("/", "epoch", "seq"))).otherwise("no"))
    return history.forget(records, done).groupBy("epoch").agg(F.count("*").alias("kept"), F.min("seq").alias("first"))


SQL["forgotten"] = f"""WITH {_CUT}, r AS (SELECT DISTINCT epoch, seq FROM ops), p AS (SELECT r.epoch, max(seq) AS done FROM r JOIN c ON c.epoch = r.epoch AND seq <= cut GROUP BY ALL)
SELECT r.epoch, count(*) AS kept, min(seq) AS first FROM r JOIN p ON p.epoch = r.epoch WHERE done % 2 <> 0 OR seq > done GROUP BY r.epoch"""


@query
def coalesced(spark: SparkSession, d: str) -> DataFrame:
    """Oldest runs of each epoch that must be folded so that the rest fits, and the rate of writing."""
    records = table(spark, d, "ops").select("epoch", "seq", "idx").distinct().groupBy("epoch", "seq").agg((F.count("*") * 100).alias("bytes"))
    rate = history.write_rate(records)
    return history.coalesce_oldest(records, 20_000).join(rate, "epoch").select("epoch", "from_seq", "to_seq", "records", "bytes", F.round("rate", 4).alias("rate"))


SQL["coalesced"] = """WITH r AS (SELECT epoch, seq, count(DISTINCT idx) * 100 AS bytes FROM ops GROUP BY ALL), k AS (SELECT *, sum(bytes) OVER (PARTITION BY epoch ORDER BY seq DESC) AS kept, row_number() OVER (PARTITION BY epoch ORDER BY seq DESC) - 1 AS back, count(*) OVER (PARTITION BY epoch) AS n FROM r),
w AS (SELECT epoch, round(sum(bytes * pow(0.7, back) * CASE WHEN back = n - 1 THEN 1 ELSE 0.3 END), 4) AS rate FROM k GROUP BY epoch)
SELECT k.epoch, min(seq) AS from_seq, max(seq) AS to_seq, count(*) AS records, sum(bytes)::BIGINT AS bytes, any_value(rate) AS rate FROM k JOIN w ON w.epoch = k.epoch WHERE kept > 20000 GROUP BY k.epoch HAVING count(*) > 1"""


@query
def epochs(spark: SparkSession, d: str) -> DataFrame:
    return history.overview(table(spark, d, "ops"))


SQL["epochs"] = "WITH u AS (SELECT epoch, seq, idx, min(time_ms) AS t FROM ops GROUP BY ALL) SELECT epoch, min(seq) AS first_seq, max(seq) AS head, count(DISTINCT seq) AS records, count(*) AS ops, min(t) AS first_ms, max(t) AS last_ms, max(seq) - min(seq) + 1 - count(DISTINCT seq) AS missing FROM u GROUP BY epoch"


@query
def run_breaks(spark: SparkSession, d: str) -> DataFrame:
    """Records that do not follow the one before them, were each the child of the number below it."""
    records = table(spark, d, "ops").select("epoch", "seq", (F.col("seq") - 1).alias("parent"))
    return history.run_breaks(records)


SQL["run_breaks"] = "SELECT epoch, seq, seq - 1 AS parent, before FROM (SELECT epoch, seq, lag(seq) OVER (PARTITION BY epoch ORDER BY seq) AS before FROM (SELECT DISTINCT epoch, seq FROM ops)) WHERE before <> seq - 1"


@query
def neighbours_of(spark: SparkSession, d: str) -> DataFrame:
    """Children of each resource at the end of each epoch, and the first of them."""
    got = st.neighbours(st.edges_at(table(spark, d, "ops")), "out", ("owns", "runs-on"))
    back = st.neighbours(st.edges_at(table(spark, d, "ops")), "in", ("owns",)).select("epoch", "uid", F.size("edges").alias("n_in"))
    return got.join(back, ["epoch", "uid"], "left").select("epoch", "uid", F.size("edges").alias("n_out"), F.get("edges", F.lit(0))["uid"].alias("first"), F.coalesce("n_in", F.lit(0)).alias("n_in"))


SQL["neighbours_of"] = f"WITH {_EDGES}, i AS (SELECT epoch, to_uid, count(*)::INT AS n FROM e WHERE type = 'owns' GROUP BY ALL) SELECT e.epoch, from_uid AS uid, count(*)::INT AS n_out, min(e.to_uid) AS first, coalesce(any_value(i.n), 0) AS n_in FROM e LEFT JOIN i ON i.epoch = e.epoch AND i.to_uid = e.from_uid WHERE type IN ('owns', 'runs-on') GROUP BY ALL"


@query
def edges_synced(spark: SparkSession, d: str) -> DataFrame:
    """Edges added, removed and replaced between the middle and the end of each epoch."""
    ops = table(spark, d, "ops")
    half = st.edges_at(ops.join(middle(ops), "epoch").where("seq <= cut"))
    return st.diff_edges(half, st.edges_at(ops), ("epoch", "from_uid", "type", "to_uid")).groupBy("epoch", "op").agg(F.count("*").alias("n"))


SQL["edges_synced"] = f"""WITH {_CUT}, m AS (SELECT ops.epoch, uid, edge_type, to_uid, op, coalesce(attrs, '-') AS attrs, {{'s': seq, 'i': idx}} AS pos, seq <= cut AS early FROM ops JOIN c ON c.epoch = ops.epoch WHERE op IN (4, 5, 6)),
e AS (SELECT epoch, uid, edge_type, to_uid, arg_max(op, pos) FILTER (early) AS a, nullif(arg_max(attrs, pos) FILTER (early), '-') AS x, arg_max(op, pos) AS z, nullif(arg_max(attrs, pos), '-') AS y FROM m GROUP BY ALL),
o AS (SELECT epoch, CASE WHEN coalesce(a, 5) = 5 AND z <> 5 THEN 4 WHEN a <> 5 AND z = 5 THEN 5 WHEN a <> 5 AND {_JSON.format('x')} <> {_JSON.format('y')} THEN 6 END AS op FROM e) SELECT epoch, op, count(*) AS n FROM o WHERE op IS NOT NULL GROUP BY ALL"""


@query
def scope_reconciled(spark: SparkSession, d: str) -> DataFrame:
    """Resources of each checkpoint that the next one no longer lists, and those carried over where a kind failed."""
    rows = table(spark, d, "checkpoint_resources").select("record_id", "uid", "kind").distinct()
    pairs = follow(table(spark, d, "checkpoints"))
    old = rows.withColumnRenamed("record_id", "prev_record").join(pairs, "prev_record").select("record_id", "uid", "kind")
    gone = st.absent_from_list(old, rows.select("record_id", "uid"), ["record_id", "uid"])
    failed = spark.createDataFrame([("Pod",)], "kind string")
    kept = st.carry_forward(old, rows.join(pairs.select("record_id"), "record_id", "left_semi"), ["record_id", "uid"], failed, "kind")
    return gone.groupBy("record_id").agg(F.count("*").alias("gone")).join(kept.groupBy("record_id").agg(F.count("*").alias("carried")), "record_id")


_PAIRS = CORE_SQL["p4_found"].split(",\ncell AS")[0]
SQL["scope_reconciled"] = _PAIRS + """, d AS (SELECT DISTINCT record_id, uid, kind FROM checkpoint_resources), n AS (SELECT pairs.record_id, uid, kind FROM pairs JOIN d ON d.record_id = pairs.record_id), b AS (SELECT pairs.record_id, uid, kind FROM pairs JOIN d ON d.record_id = pairs.p),
g AS (SELECT record_id, uid, kind FROM b WHERE (record_id, uid) NOT IN (SELECT (record_id, uid) FROM n))
SELECT x.record_id, x.gone, x.pods + coalesce(y.n, 0) AS carried FROM (SELECT record_id, count(*) AS gone, count(*) FILTER (kind = 'Pod') AS pods FROM g GROUP BY ALL) x LEFT JOIN (SELECT record_id, count(*) AS n FROM n GROUP BY ALL) y ON y.record_id = x.record_id WHERE x.pods + coalesce(y.n, 0) > 0"""
SQL["checkpoint_boundaries"] = f"WITH f AS ({CORE_SQL['p4_found']}) SELECT DISTINCT f.record_id FROM f WHERE record_id IN (SELECT record_id FROM checkpoint_resources) AND record_id IN (SELECT record_id FROM ({_PAIRS} SELECT record_id FROM pairs WHERE p IN (SELECT record_id FROM checkpoint_resources)))"


@query
def events_in_spans(spark: SparkSession, d: str) -> DataFrame:
    """Events within a minute after an error, counted by type: points in spans, swept in order."""
    e = table(spark, d, "events").select(F.lit("all").alias("scope"), F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), "event_type", "event_id")
    spans = e.where("event_type = 'error'").select("scope", F.col("us").alias("a"), (F.col("us") + 60_000_000).alias("b"))
    # one scope is one task: hours are scopes, and a span that reaches over an hour's end is in both
    hour = lambda c: F.floor(c / 3_600_000_000)
    spans = spans.withColumn("scope", F.explode(F.sequence(hour(F.col("a")), hour(F.col("b")))))
    got = st.in_spans(e.withColumn("scope", hour(F.col("us"))), spans, "scope", "us", "a", "b")
    return got.groupBy("event_type").agg(F.count("*").alias("n"))


SQL["events_in_spans"] = "WITH s AS (SELECT epoch_us(ts) AS a FROM events WHERE event_type = 'error') SELECT event_type, count(*) AS n FROM events WHERE EXISTS (SELECT 1 FROM s WHERE epoch_us(ts) >= a AND epoch_us(ts) <= a + 60000000) GROUP BY ALL"


@query
def lifecycle(spark: SparkSession, d: str) -> DataFrame:
    """Last entry up to the watermark of each finding touched between two points."""
    s = with_finding(table(spark, d, "summary_entries")).select("target_id", "epoch", "finding", "seq", "recv_ms", "delivery_id", "state")
    return lifecycle_summary(s, 20, 60, ["target_id", "epoch", "finding"]).select("target_id", "epoch", "finding", "seq")


SQL["lifecycle"] = FINDINGS_SQL + "SELECT target_id, epoch, finding, max(seq) AS seq FROM r WHERE seq <= 60 GROUP BY ALL HAVING max(seq) > 20"


# -- joins: pods are the files of docker_lines, named by their paths
def pods(spark: SparkSession, d: str) -> DataFrame:
    files = table(spark, d, "docker_lines").where("labels is not null").groupBy("source").agg(F.max(F.struct(*[F.element_at("labels", F.lit(k)).alias(k) for k in ("namespace", "pod", "container", "node")])).alias("l"))
    return files.select("source", "l.*", F.regexp_extract("source", r"/[^/_]+_[^/_]+_([^/_]+)/", 1).alias("uid")).where("pod is not null and node is not null and uid <> ''")


_PODS = r"""f AS (SELECT source, max({'n': labels['namespace'], 'p': labels['pod'], 'c': labels['container'], 'o': labels['node']}) AS l, regexp_extract(source, '/[^/_]+_[^/_]+_([^/_]+)/', 1) AS uid FROM docker_lines WHERE labels IS NOT NULL GROUP BY source),
p AS (SELECT source, l.n AS namespace, l.p AS pod, l.c AS container, l.o AS node, uid FROM f WHERE l.p IS NOT NULL AND l.o IS NOT NULL AND uid <> '')"""


@query
def facts_placed(spark: SparkSession, d: str) -> DataFrame:
    """Metric facts of every container, volume claim and node, placed on resources."""
    p = pods(spark, d)
    own = F.xxhash64("source") * 0 + F.length("source")
    facts = p.select(
        F.when(own % 5 == 0, "elsewhere").otherwise(F.col("node")).alias("node"), "namespace", "pod", F.when(own % 2 == 0, F.col("uid")).alias("uid"), F.lit(None).cast("string").alias("claim"), "container", F.lit(1).alias("value")
    )
    none = F.lit(None).cast("string")
    volumes = p.select("node", "namespace", none.alias("pod"), none.alias("uid"), F.concat(F.lit("data-"), "pod").alias("claim"), none.alias("container"), F.lit(2).alias("value")).distinct()
    hosts = p.select("node", none.alias("namespace"), none.alias("pod"), none.alias("uid"), none.alias("claim"), none.alias("container"), F.lit(3).alias("value")).distinct()
    live = p.groupBy("uid", "namespace", F.col("pod").alias("name"), "node").agg(F.array(F.concat(F.lit("data-"), F.min("pod"))).alias("claims"))
    claims = p.where(own % 3 != 0).select(F.concat(F.lit("pvc-"), "pod").alias("uid"), "namespace", F.concat(F.lit("data-"), "pod").alias("name")).distinct()
    nodes = p.select(F.concat(F.lit("node/"), "node").alias("uid"), F.col("node").alias("name")).distinct()
    return joins.place_facts(facts.unionByName(volumes).unionByName(hosts), live, claims, nodes).groupBy("value", "target_uid", "prefix", "placed").agg(F.count("*").alias("n"))


SQL["facts_placed"] = f"""WITH {_PODS}, own AS (SELECT *, CASE WHEN length(source) % 5 = 0 THEN 'elsewhere' ELSE node END AS told, length(source) % 2 = 0 AS by_uid FROM p),
u AS (SELECT DISTINCT uid, namespace, pod, node FROM p), s AS (SELECT node, namespace, pod, min(uid) AS uid FROM u GROUP BY ALL HAVING count(*) = 1),
c AS (SELECT DISTINCT namespace, pod FROM p WHERE length(source) % 3 <> 0),
a AS (
  SELECT 1 AS value, CASE WHEN by_uid THEN (SELECT u.uid FROM u WHERE u.uid = own.uid AND u.namespace = own.namespace AND u.pod = own.pod AND u.node = own.told) ELSE (SELECT s.uid FROM s WHERE s.node = own.told AND s.namespace = own.namespace AND s.pod = own.pod) END AS target_uid, CASE WHEN container IS NULL THEN '' ELSE 'containers.' || container || '.' END AS prefix FROM own
  UNION ALL SELECT 2, CASE WHEN EXISTS (SELECT 1 FROM c WHERE c.namespace = x.namespace AND c.pod = x.pod) THEN 'pvc-' || x.pod END, '' FROM (SELECT DISTINCT node, namespace, pod FROM p) x
  UNION ALL SELECT 3, 'node/' || node, '' FROM (SELECT DISTINCT node FROM p))
SELECT value, target_uid, prefix, target_uid IS NOT NULL AS placed, count(*) AS n FROM a GROUP BY ALL"""


@query
def facts_sent(spark: SparkSession, d: str) -> DataFrame:
    """Facts of which the value moved beyond the thresholds since they were sent, or whose pod is another one."""
    p = pods(spark, d).groupBy("namespace", "pod").agg(F.min("uid").alias("uid"), F.max(F.length("source")).cast("long").alias("x"))
    number = lambda c: F.create_map(F.lit("metric.cpu"), c.cast("string"))
    last = p.where("x % 7 <> 0").select("namespace", "pod", F.when(F.col("x") % 5 == 0, "old").otherwise(F.col("uid")).alias("uid"), number(F.lit(100)).alias("facts"))
    now = p.select("namespace", "pod", "uid", number(100 + F.col("x") % 24).alias("facts"))
    got = joins.facts_to_send(now, last, p.where("x % 11 <> 0").select("namespace", "pod", "uid"), ("namespace", "pod"), {".cpu": 12.0})
    return got.select("namespace", "pod", "uid", F.element_at("facts", F.lit("metric.cpu")).alias("cpu"))


SQL["facts_sent"] = f"""WITH {_PODS}, q AS (SELECT namespace, pod, min(uid) AS uid, max(length(source)) AS x FROM p GROUP BY ALL)
SELECT namespace, pod, uid, (100 + x % 24)::VARCHAR AS cpu FROM q WHERE x % 11 <> 0 AND (x % 7 = 0 OR x % 5 = 0 OR x % 24 >= 12)"""


@query
def instances_gone(spark: SparkSession, d: str) -> DataFrame:
    """Alert instances of event types that have no live series at the end of the events."""
    samples = event_samples(table(spark, d, "events"))
    _, at = span(samples.select("ts_ms"))
    kinds = table(spark, d, "events").select("event_type").distinct().unionByName(spark.createDataFrame([("never",)], "event_type string"))
    instances = kinds.select(F.col("event_type").alias("instance_key"), label_map(event_type=F.col("event_type"), severity=F.lit("page")).alias("labels"))
    ended = samples.where(F.element_at("labels", F.lit("event_type")) == "view").groupBy("labels").agg(F.lit(at).cast("long").alias("ts_ms")).select("labels", "ts_ms", F.lit(float("nan")).alias("value"), F.lit(True).alias("is_stale"))
    return joins.gone_instances(instances, samples.unionByName(ended), ("event_value",), at, lookback_ms=3_600_000, own_labels=("severity",)).select("instance_key")


SQL["instances_gone"] = "WITH z AS (SELECT max(epoch_us(ts) // 1000) AS z FROM events), l AS (SELECT DISTINCT event_type FROM events, z WHERE epoch_us(ts) // 1000 >= z - 3600000 AND event_type <> 'view') SELECT event_type AS instance_key FROM (SELECT DISTINCT event_type FROM events UNION SELECT 'never') WHERE event_type NOT IN (SELECT event_type FROM l)"


@query
def resolved_uids(spark: SparkSession, d: str) -> DataFrame:
    """Resources that the labels of files name."""
    p = pods(spark, d)
    resources = p.where(F.length("source") % 3 > 0).select("uid", F.lit("Pod").alias("kind"), "namespace", F.col("pod").alias("name"))
    seen = p.select("source", label_map(namespace=F.col("namespace"), pod=F.col("pod")).alias("labels"))
    return joins.resolve_resources(seen, resources, "Pod", "pod", "namespace").select("source", "resource_uid")


SQL["resolved_uids"] = f"WITH {_PODS} SELECT source, (SELECT min(q.uid) FROM p q WHERE length(q.source) % 3 > 0 AND q.namespace = p.namespace AND q.pod = p.pod) AS resource_uid FROM p"


@query
def pods_related(spark: SparkSession, d: str) -> DataFrame:
    """Pods related to each resource that stands at the end of an epoch, within four hops."""
    ops = table(spark, d, "ops")
    edges = st.edges_at(ops.withColumn("attrs", F.lit(None).cast("string")))
    tag = lambda c: F.concat_ws("|", "epoch", c)
    links = edges.select(tag("from_uid").alias("from_uid"), "type", tag("to_uid").alias("to_uid"))
    live = st.resources_at(ops.where("op <> 2")).select(tag("uid").alias("uid"), "kind")
    links, live = (Workspace(spark).write(x) for x in (links, live))
    got = joins.pods_of(live.where("kind <> 'Pod'").select("uid"), live, links)
    return got.groupBy("start").agg(F.count("*").alias("pods"))


SQL["pods_related"] = f"""WITH RECURSIVE {_EDGES}, life AS (SELECT epoch, uid, arg_max(op, {{'s': seq, 'i': idx}}) AS op, arg_max(kind, {{'s': seq, 'i': idx}}) AS kind FROM ops WHERE op IN (1, 3) GROUP BY ALL), r AS (SELECT epoch, uid, kind FROM life WHERE op = 1),
s AS (SELECT DISTINCT epoch, from_uid AS a, to_uid AS b FROM e WHERE type IN ('owns', 'selects', 'targets', 'guards', 'routes', 'scales') UNION SELECT epoch, to_uid, from_uid FROM e WHERE type IN ('mounts', 'binds')),
w AS (SELECT epoch, uid AS start, uid AS cur, kind, 0 AS d FROM r WHERE kind <> 'Pod'
  UNION SELECT w.epoch, w.start, s.b, r.kind, w.d + 1 FROM w JOIN s ON s.epoch = w.epoch AND s.a = w.cur JOIN r ON r.epoch = s.epoch AND r.uid = s.b WHERE w.d < 4 AND (w.d = 0 OR w.kind NOT IN ('Pod', 'Namespace', 'Node')))
SELECT epoch || '|' || start AS start, count(DISTINCT cur) AS pods FROM w WHERE kind = 'Pod' GROUP BY ALL"""


@query
def images_running(spark: SparkSession, d: str) -> DataFrame:
    """Nodes on which each image runs, and the best answer of their inventories."""
    p = pods(spark, d)
    digest = F.sha2("container", 256)
    fields = F.create_map(F.lit("nodeName"), F.col("node"), F.lit("containers.a.imageID"), F.concat(F.lit("docker.io/x@sha256:"), digest), F.lit("containers.a.image"), F.lit("x"))
    nodes = joins.image_nodes(p.select(fields.alias("fields")))
    n = F.length("node") + F.ascii(F.substring("node", -1, 1))
    answers = nodes.select("digest", "node", F.when(n % 3 == 0, "ready").when(n % 3 == 1, "pending").otherwise("unavailable").alias("status"), (n % 2 == 0).alias("truncated"))
    best = joins.best_answer(answers)
    return nodes.groupBy("digest").agg(F.count("*").alias("nodes")).join(best.select("digest", "status", "truncated"), "digest").select("digest", "nodes", "status", F.when(F.col("status") == "ready", F.col("truncated")).alias("truncated"))


SQL["images_running"] = f"""WITH {_PODS}, n AS (SELECT DISTINCT 'sha256:' || sha256(container) AS digest, node, length(node) + ascii(node[-1:]) AS x FROM p WHERE container IS NOT NULL),
r AS (SELECT *, CASE WHEN x % 3 = 0 AND x % 2 = 1 THEN 0 WHEN x % 3 = 0 THEN 1 WHEN x % 3 = 1 THEN 2 ELSE 3 END AS k FROM n)
SELECT digest, count(*) AS nodes, CASE min(k) WHEN 0 THEN 'ready' WHEN 1 THEN 'ready' WHEN 2 THEN 'pending' ELSE 'unavailable' END AS status, CASE min(k) WHEN 0 THEN false WHEN 1 THEN true END AS truncated FROM r GROUP BY digest"""


@query
def nodes_merged(spark: SparkSession, d: str) -> DataFrame:
    """Status of every node that was asked for lines, with the oldest time that it holds."""
    p = pods(spark, d)
    lines = table(spark, d, "docker_lines").join(p.select("source", "node"), "source").groupBy("node").agg(F.min("time_ns").alias("oldest_ms"))
    asked = p.select("node").distinct().unionByName(spark.createDataFrame([("quiet",)], "node string")).withColumn("error", F.when(F.length("node") + F.ascii(F.substring("node", -1, 1)) > 62, "timeout"))
    rows, status = joins.merge_nodes(lines, asked)
    return status.join(rows.select("node", F.lit(True).alias("merged")), "node", "left").select("node", "status", "rows", "oldest_ms", F.coalesce("merged", F.lit(False)).alias("merged"))


SQL["nodes_merged"] = f"""WITH {_PODS}, l AS (SELECT node, min(time_ns) AS oldest_ms FROM docker_lines d JOIN p ON p.source = d.source GROUP BY node), a AS (SELECT DISTINCT node FROM p UNION SELECT 'quiet'), s AS (SELECT node, length(node) + ascii(node[-1:]) > 62 AS bad FROM a)
SELECT s.node, CASE WHEN bad THEN 'error' WHEN l.node IS NULL THEN 'empty' ELSE 'ok' END AS status, CASE WHEN l.node IS NULL THEN 0 ELSE 1 END::BIGINT AS rows, oldest_ms, l.node IS NOT NULL AND NOT bad AS merged FROM s LEFT JOIN l ON l.node = s.node"""


@query
def series_replaced(spark: SparkSession, d: str) -> DataFrame:
    """A store of samples after its source sent all its series again, without one of them."""
    s = event_samples(table(spark, d, "events")).groupBy("labels", "ts_ms", "is_stale").agg(F.max("value").alias("value"))
    low, high = span(s.select("ts_ms"))
    half = (low + high) // 2
    store = s.where(F.col("ts_ms") <= half).withColumn("source", F.lit("a"))
    sent = s.where(F.element_at("labels", F.lit("event_type")) != "view")
    got = joins.replace_series(store, sent, "a", high, 20 * 86_400_000)
    return got.groupBy(F.element_at("labels", F.lit("event_type")).alias("event_type")).agg(F.count("*").alias("n"), F.count_if("is_stale").alias("stale"), F.min("ts_ms").alias("oldest"))


SQL["series_replaced"] = """WITH s AS (SELECT DISTINCT event_type, epoch_us(ts) // 1000 AS ms FROM events), z AS (SELECT min(ms) AS a, max(ms) AS b FROM s),
k AS (SELECT event_type, ms, 0 AS stale FROM s, z WHERE ms >= b - 1728000000 AND (event_type <> 'view' OR ms <= (a + b) // 2) UNION ALL SELECT 'view', b, 1 FROM z)
SELECT event_type, count(*) AS n, sum(stale)::BIGINT AS stale, min(ms) AS oldest FROM k GROUP BY event_type"""


# -- the query surface
def engine(spark: SparkSession, d: str, scope: Scope) -> Engine:
    ops = table(spark, d, "ops")
    tag = lambda c: F.concat_ws("|", "epoch", c).alias(c)
    resources = st.resources_at(ops).select(tag("uid"), "kind", "namespace", "name", "fields")
    edges = st.edges_at(ops).select(tag("from_uid"), "type", tag("to_uid"), "attrs")
    return Engine(resources=resources, edges=edges, scope=scope)


@query
def api_state(spark: SparkSession, d: str) -> DataFrame:
    """Pods of a scope with a value in one field, through the query surface."""
    got = engine(spark, d, Scope(namespaces=("payments", "checkout"))).state_query(kinds=("Pod",), where={"status.ready": "false"})
    return got.select("uid", "namespace", "name")


SQL["api_state"] = f"""WITH x AS ({CORE_SQL['p1_current']}), life AS (SELECT epoch, uid, arg_max(kind, {{'s': seq, 'i': idx}}) AS kind, arg_max(namespace, {{'s': seq, 'i': idx}}) AS namespace, arg_max(name, {{'s': seq, 'i': idx}}) AS name FROM ops WHERE op = 1 GROUP BY ALL)
SELECT l.epoch || '|' || l.uid AS uid, namespace, name FROM life l JOIN x ON x.epoch = l.epoch AND x.uid = l.uid WHERE kind = 'Pod' AND namespace IN ('payments', 'checkout') AND field_name = 'status.ready' AND value = 'false'"""


@query
def api_objects(spark: SparkSession, d: str) -> DataFrame:
    """Objects within a scope, redacted by their kind."""
    from tidewell.functions.redact import redact_object

    e = engine(spark, d, Scope(namespaces=("payments",)))
    seen = e.scope.visible(e.resources)
    raw = F.concat(F.lit('{"metadata":{"name":"'), "name", F.lit('","managedFields":[1]},"spec":{"env":[{"name":"A","value":"v"}],"dbPassword":"p","n":1}}'))
    return seen.select("uid", redact_object("kind", raw).alias("object"))


SQL["api_objects"] = """WITH life AS (SELECT epoch, uid, arg_max(op, {'s': seq, 'i': idx}) AS op, arg_max(namespace, {'s': seq, 'i': idx}) AS namespace, arg_max(name, {'s': seq, 'i': idx}) AS name FROM ops WHERE op IN (1, 3) GROUP BY ALL)
SELECT epoch || '|' || uid AS uid, '{"metadata":{"name":"' || name || '"},"spec":{"env":[{"name":"A","value":"<redacted>"}],"dbPassword":"<redacted>","n":1}}' AS object FROM life WHERE op = 1 AND namespace = 'payments'"""


@query
def api_missing(spark: SparkSession, d: str) -> DataFrame:
    """Inputs of a rule without samples in its reach; what is asked for its absence is not missed."""
    samples = event_samples(table(spark, d, "events"))
    _, at = span(samples.select("ts_ms"))
    return Engine(samples=samples).missing_inputs("event_value > 1 and other_metric or absent(third_metric)", at)


SQL["api_missing"] = "SELECT 'other_metric' AS metric"


@query
def records_framed(spark: SparkSession, d: str) -> DataFrame:
    """Every op as a record, packed into batch frames, unpacked and decoded again."""
    from tidewell.sources.records import decode_records, encode, frames, unpack

    ops = table(spark, d, "ops").select("epoch", "seq", "idx", "op", "uid").distinct().groupBy("epoch", "seq").agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", F.lpad(F.col("idx").cast("string"), 6, "0"), "op", F.coalesce("uid", F.lit(""))))), ",").alias("text"))

    def write(batches):
        import pandas as pd

        for pdf in batches:
            raw = [encode({0: 1, 1: 2, 2: "t", 3: bytes.fromhex(e), 4: int(s), 5: b"w" * 16, 6: 0, 7: int(s) - 1, 8: 1, 9: 0, 10: 1, 11: {"ops": t}}) for e, s, t in zip(pdf["epoch"], pdf["seq"], pdf["text"])]
            yield pd.DataFrame({"epoch": pdf["epoch"], "seq": pdf["seq"], "raw": raw})

    records = ops.mapInPandas(write, "epoch string, seq long, raw binary")
    got = decode_records(unpack(frames(records, ("epoch",))))
    return got.where("error is null").select("epoch", "seq", "parent", F.get_json_object("body", "$.ops").alias("ops"))


SQL["records_framed"] = """WITH u AS (SELECT DISTINCT epoch, seq, idx, op, uid FROM ops)
SELECT epoch, seq, seq - 1 AS parent, string_agg(lpad(idx::VARCHAR, 6, '0') || ':' || op || ':' || coalesce(uid, ''), ',' ORDER BY lpad(idx::VARCHAR, 6, '0') || ':' || op || ':' || coalesce(uid, '')) AS ops FROM u GROUP BY epoch, seq"""


@query
def readable_records(spark: SparkSession, d: str) -> DataFrame:
    """Ops as readable JSON objects, without what is null."""
    ops = table(spark, d, "ops").where("op = 1").select("epoch", "seq", "idx", "uid", "kind", "namespace", "name").distinct()
    return ops.select("epoch", "seq", "idx", F.to_json(F.struct("uid", "kind", "namespace", "name")).alias("text"))


SQL["readable_records"] = """SELECT DISTINCT epoch, seq, idx, '{"uid":"' || uid || '"' || coalesce(',"kind":"' || kind || '"', '') || coalesce(',"namespace":"' || namespace || '"', '') || coalesce(',"name":"' || name || '"', '') || '}' AS text FROM ops WHERE op = 1 AND uid IS NOT NULL"""


@query
def store_scanned(spark: SparkSession, d: str) -> DataFrame:
    """A key-value store after all creates and deletes of resources, and a queue of the creates after half of them were acknowledged."""
    ops = table(spark, d, "ops").where("op in (1, 3)")
    order = F.col("seq").cast("long") * 1_000_000 + F.col("idx")
    changes = ops.select(order.alias("seq"), F.concat_ws("/", "epoch", "uid").alias("key"), F.col("name").alias("value"), (F.col("op") == 3).alias("deleted"))
    kept = history.kv_state(changes, "").groupBy(F.substring_index("key", "/", 1).alias("epoch")).agg(F.count("*").alias("keys"))
    items = ops.where("op = 1").select(F.col("epoch").alias("node"), F.lit("q").alias("queue"), order.alias("seq"), "uid")
    acked = items.groupBy("node", "queue").agg(F.expr("floor((min(seq) + max(seq)) / 2)").alias("seq"))
    waiting = history.queue_after(items, acked).groupBy(F.col("node").alias("epoch")).agg(F.max("place").cast("long").alias("waiting"))
    return kept.join(waiting, "epoch", "left").na.fill(0, ["waiting"])


SQL["store_scanned"] = """WITH c AS (SELECT epoch, uid, op, seq::BIGINT * 1000000 + idx AS s FROM ops WHERE op IN (1, 3)), k AS (SELECT epoch, count(*) AS keys FROM (SELECT epoch, uid, arg_max(op, s) AS op FROM c GROUP BY ALL) WHERE op = 1 GROUP BY epoch),
q AS (SELECT epoch, (min(s) + max(s)) // 2 AS half FROM c WHERE op = 1 GROUP BY epoch), w AS (SELECT c.epoch, count(DISTINCT s) AS waiting FROM c JOIN q ON q.epoch = c.epoch AND s > half WHERE op = 1 GROUP BY c.epoch)
SELECT k.epoch, keys, coalesce(waiting, 0) AS waiting FROM k LEFT JOIN w ON w.epoch = k.epoch"""


@query
def lookback_external(spark: SparkSession, d: str) -> DataFrame:
    """A range query over an external source of samples, in the scope of a namespace."""
    samples = event_samples(table(spark, d, "events")).withColumn("labels", F.map_concat("labels", F.create_map(F.lit("namespace"), F.when(F.element_at("labels", F.lit("event_type")) < "d", "a").otherwise("b"))))
    low, high = span(samples.select("ts_ms"))
    day = 86_400_000
    e = Engine(external={"archive": samples}, scope=Scope(namespaces=("a",)))
    got = e.lookback("archive", "sum(count_over_time(event_value[1d]))", -(-low // day) * day, -(-high // day) * day, day)
    return got.select("ts_ms", "value")


SQL["lookback_external"] = """WITH s AS (SELECT epoch_us(ts) // 1000 AS ms FROM events WHERE event_type < 'd'), b AS (SELECT min(epoch_us(ts) // 1000) AS a, max(epoch_us(ts) // 1000) AS z FROM events),
g AS (SELECT unnest(range((a + 86399999) // 86400000 * 86400000, (z + 86399999) // 86400000 * 86400000 + 1, 86400000::BIGINT)) AS t FROM b) SELECT t AS ts_ms, count(*)::DOUBLE AS value FROM g JOIN s ON ms > t - 86400000 AND ms <= t GROUP BY t"""
