"""Objects written from the driver's tables, normalised into fields, edges and series, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.operators import kube, normalize
from tidewell.operators import state as st
from tidewell.plans import cel
from tidewell.sources.discovery import kubelet_targets, pod_targets
from tidewell.workspace import Workspace

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held(spark: SparkSession, d: str, *kinds: str) -> DataFrame:
    """Resources of every checkpoint once, by a uid of their own: the least row of repeated ones counts."""
    rows = table(spark, d, "checkpoint_resources").where(F.col("kind").isin(*kinds) & F.col("uid").isNotNull())
    once = rows.groupBy("record_id", "uid").agg(F.min(F.struct("kind", "namespace", "name", "fields")).alias("r")).select(F.concat_ws("|", "record_id", "uid").alias("uid"), "r.*")
    return once.withColumn("f", F.from_json("fields", "map<string,string>"))


_HELD = "h AS (SELECT record_id || '|' || uid AS uid, min({'k': kind, 's': namespace, 'n': name, 'f': fields}) AS r FROM checkpoint_resources WHERE uid IS NOT NULL AND kind IN (%s) GROUP BY record_id, uid), x AS (SELECT uid, r.k AS kind, r.s AS namespace, r.n AS name, r.f::JSON AS f FROM h)"


def at(key: str) -> Column:
    return F.element_at("f", F.lit(key))


def meta(**more: Column) -> Column:
    return F.struct(F.col("uid"), F.col("namespace"), F.col("name"), *[v.alias(k) for k, v in more.items()]).alias("metadata")


def pods(spark: SparkSession, d: str) -> DataFrame:
    """``kind, object`` of the pods of every checkpoint."""
    ready = F.when(at("status.ready") == "true", "True").otherwise("False")
    restarts = at("status.restarts").try_cast("int")
    container = F.struct(F.lit("main").alias("name"), F.lit("img:1").alias("image"), F.struct(F.create_map(F.lit("cpu"), F.concat(F.coalesce(at("spec.priority").try_cast("int"), F.lit(0)).cast("string"), F.lit("m"))).alias("requests")).alias("resources"))
    status = F.struct(at("status.phase").alias("phase"), F.array(F.struct(F.lit("Ready").alias("type"), ready.alias("status"))).alias("conditions"), F.array(F.struct(F.lit("main").alias("name"), restarts.alias("restartCount"), F.lit("docker.io/a@sha256:1").alias("imageID"))).alias("containerStatuses"))
    spec = F.struct(at("spec.node").alias("nodeName"), F.array(container).alias("containers"))
    labels = F.create_map(F.lit("app"), F.col("name"), F.lit("private"), F.lit("x")).alias("labels")
    owner = F.when(F.length("name") % 2 == 0, F.array(F.struct(F.lit("ReplicaSet").alias("kind"), F.lit("rs").alias("name"), F.concat(F.lit("own-"), "uid").alias("uid"), F.lit(True).alias("controller")))).alias("ownerReferences")
    df = held(spark, d, "Pod").where("name is not null")
    return df.select("kind", F.to_json(F.struct(meta(labels=labels, ownerReferences=owner), spec.alias("spec"), status.alias("status"))).alias("object"))


_POD = _HELD % "'Pod'" + """, q AS (SELECT uid, namespace, name, json_extract_string(f, '$."spec.node"') AS node, json_extract_string(f, '$."status.phase"') AS phase, json_extract_string(f, '$."status.ready"') AS ready, try_cast(json_extract_string(f, '$."status.restarts"') AS INT) AS restarts, coalesce(try_cast(json_extract_string(f, '$."spec.priority"') AS INT), 0) AS prio FROM x WHERE name IS NOT NULL)"""


def field(name: str) -> Column:
    return kube.text_of(F.col("fields"), name)


@query
def kube_pods(spark: SparkSession, d: str) -> DataFrame:
    """Fields of the pods of every checkpoint."""
    n = normalize.normalize(pods(spark, d))
    return n.select("uid", field("nodeName").alias("node"), field("phase").alias("phase"), field("ready").alias("ready"), field("containers.main.restarts").alias("restarts"), F.round(field("containers.main.requests.cpu").try_cast("double"), 6).alias("cpu"), field("labels.app").alias("app"), field("labels.private").alias("private"), field("owners.ReplicaSet.rs").alias("owner"), field("conditions.Ready.status").alias("condition"))


SQL["kube_pods"] = f"""WITH {_POD} SELECT uid, node, phase, CASE WHEN ready = 'true' THEN 'true' ELSE 'false' END AS ready, restarts::VARCHAR AS restarts, round(prio * 0.001, 6)::DOUBLE AS cpu, name AS app, NULL::VARCHAR AS private,
  CASE WHEN length(name) % 2 = 0 THEN 'true' END AS owner, CASE WHEN ready = 'true' THEN 'True' ELSE 'False' END AS condition FROM q"""


@query
def kube_series(spark: SparkSession, d: str) -> DataFrame:
    """Published series of the pods, counted and summed by name and one label."""
    s = kube.kube_series(normalize.normalize(pods(spark, d)))
    label = F.coalesce(F.element_at("labels", F.lit("condition")), F.element_at("labels", F.lit("resource")), F.element_at("labels", F.lit("owner_kind")), F.lit(""))
    return s.where("name <> 'kube_pod_status_phase'").groupBy("name", label.alias("label")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 6).alias("total"))


SQL["kube_series"] = f"""WITH {_POD}
SELECT 'kube_pod_info' AS name, '' AS label, count(*) AS n, count(*)::DOUBLE AS total FROM q UNION ALL SELECT 'kube_pod_container_info', '', count(*), count(*) FROM q
UNION ALL SELECT 'kube_pod_status_ready', c, count(*), count(*) FILTER (c = CASE WHEN ready = 'true' THEN 'true' ELSE 'false' END) FROM q, (SELECT unnest(['true', 'false', 'unknown']) AS c) GROUP BY c
UNION ALL SELECT 'kube_pod_container_status_restarts_total', '', count(*), sum(restarts) FROM q WHERE restarts IS NOT NULL
UNION ALL SELECT 'kube_pod_container_resource_requests', 'cpu', count(*), round(sum(prio) * 0.001, 6) FROM q
UNION ALL SELECT 'kube_pod_owner', CASE WHEN length(name) % 2 = 0 THEN 'ReplicaSet' ELSE '<none>' END, count(*), count(*) FROM q GROUP BY 2"""


@query
def kube_node_series(spark: SparkSession, d: str) -> DataFrame:
    """Series of the node with the most pods: only those of its own pods."""
    ws = Workspace(spark)
    s = ws.write(kube.kube_series(normalize.normalize(pods(spark, d))), "series")
    node = F.element_at("labels", F.lit("node"))
    top = s.where("name = 'kube_pod_info'").groupBy(node.alias("node")).agg(F.count("*").alias("n")).where("node is not null").orderBy(F.desc("n"), "node").first()
    return kube.node_series(s, top["node"] if top else "").groupBy("name").agg(F.count("*").alias("n"))


SQL["kube_node_series"] = f"""WITH {_POD}, t AS (SELECT node FROM q WHERE node IS NOT NULL GROUP BY node ORDER BY count(*) DESC, node LIMIT 1), m AS (SELECT q.* FROM q JOIN t ON t.node = q.node)
SELECT unnest(['kube_pod_info', 'kube_pod_container_info', 'kube_pod_container_resource_requests', 'kube_pod_owner']) AS name, count(*) AS n FROM m HAVING count(*) > 0 UNION ALL SELECT 'kube_pod_status_ready', 3 * count(*) FROM m HAVING count(*) > 0
UNION ALL SELECT 'kube_pod_status_phase', 5 * count(*) FROM m WHERE phase IS NOT NULL HAVING count(*) > 0 UNION ALL SELECT 'kube_pod_container_status_restarts_total', count(*) FROM m WHERE restarts IS NOT NULL HAVING count(*) > 0"""


@query
def kube_workloads(spark: SparkSession, d: str) -> DataFrame:
    """Fields of the deployments, stateful sets, cron jobs and claims of every checkpoint."""
    kinds = {"Deployment": "apps/Deployment", "StatefulSet": "apps/StatefulSet", "CronJob": "batch/CronJob", "PersistentVolumeClaim": "PersistentVolumeClaim"}
    df = held(spark, d, *kinds)
    kind = F.element_at(F.create_map(*[F.lit(x) for kv in kinds.items() for x in kv]), F.col("kind"))
    number = lambda k: at(k).try_cast("int")
    claim = F.when(F.col("kind") == "PersistentVolumeClaim", F.struct(F.create_map(F.lit("storage"), F.concat(number("spec.size").cast("string"), F.lit("Gi"))).alias("requests")))
    spec = F.struct(number("spec.replicas").alias("replicas"), at("spec.service").alias("serviceName"), at("spec.schedule").alias("schedule"), (at("spec.suspend") == "true").alias("suspend"), at("spec.class").alias("storageClassName"), claim.alias("resources"))
    objects = df.select(kind.alias("kind"), F.to_json(F.struct(meta(), spec.alias("spec"), F.struct(number("status.ready_replicas").alias("readyReplicas"), at("status.phase").alias("phase")).alias("status"))).alias("object"))
    n = normalize.normalize(objects)
    return n.select("uid", "kind", *[field(k).alias(k) for k in ("replicas", "readyReplicas", "serviceName", "schedule", "suspend", "storageClassName", "phase")], field("requests.storage").try_cast("double").alias("bytes"))


SQL["kube_workloads"] = f"""WITH {_HELD % "'Deployment', 'StatefulSet', 'CronJob', 'PersistentVolumeClaim'"}, y AS (SELECT uid, kind AS k, try_cast(json_extract_string(f, '$."spec.replicas"') AS INT) AS replicas, try_cast(json_extract_string(f, '$."status.ready_replicas"') AS INT) AS ready, json_extract_string(f, '$."spec.service"') AS service, json_extract_string(f, '$."spec.schedule"') AS schedule, json_extract_string(f, '$."spec.suspend"') AS suspend, json_extract_string(f, '$."spec.class"') AS class, json_extract_string(f, '$."status.phase"') AS phase, try_cast(json_extract_string(f, '$."spec.size"') AS INT) AS size FROM x)
SELECT uid, CASE k WHEN 'CronJob' THEN 'batch/CronJob' WHEN 'PersistentVolumeClaim' THEN k ELSE 'apps/' || k END AS kind, CASE WHEN k IN ('Deployment', 'StatefulSet') THEN coalesce(replicas, 1)::VARCHAR END AS replicas, CASE WHEN k IN ('Deployment', 'StatefulSet') THEN ready::VARCHAR END AS readyReplicas,
  CASE WHEN k = 'StatefulSet' THEN service END AS serviceName, CASE WHEN k = 'CronJob' THEN schedule END AS schedule, CASE WHEN k = 'CronJob' THEN CASE suspend WHEN 'true' THEN 'true' ELSE CASE WHEN suspend IS NOT NULL THEN 'false' END END END AS suspend,
  CASE WHEN k = 'PersistentVolumeClaim' THEN class END AS storageClassName, CASE WHEN k = 'PersistentVolumeClaim' THEN phase END AS phase, CASE WHEN k = 'PersistentVolumeClaim' THEN (size * 1073741824.0)::DOUBLE END AS bytes FROM y"""


def web(spark: SparkSession, d: str) -> DataFrame:
    """Services, ingresses and network policies written from the suppliers."""
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("n"), F.col("s_nationkey").cast("string").alias("ns"))
    own = lambda kind: F.struct(F.concat(F.lit(f"{kind}-"), F.col("n").cast("string")).alias("uid"), F.col("ns").alias("namespace"), F.concat(F.lit("svc-"), (F.col("n") % 40).cast("string")).alias("name") if kind == "svc" else F.concat(F.lit(f"{kind}-"), F.col("n").cast("string")).alias("name")).alias("metadata")
    service = F.to_json(F.struct(own("svc"), F.struct(F.lit("NodePort").alias("type"), F.create_map(F.lit("tier"), F.lit("web"), F.lit("app"), (F.col("n") % 3).cast("string")).alias("selector"), F.array(F.struct(F.lit("http").alias("name"), F.lit(80).alias("port"), (F.col("n") % 100 + 30000).cast("int").alias("nodePort"), F.lit("8080").alias("targetPort"))).alias("ports")).alias("spec")))
    backend = lambda k: F.struct(F.struct(F.concat(F.lit("svc-"), (k % 40).cast("string")).alias("name"), F.struct((k % 2 + 80).cast("int").alias("number")).alias("port")).alias("service"))
    rule = F.struct(F.concat(F.lit("h"), (F.col("n") % 5).cast("string")).alias("host"), F.struct(F.array(F.struct(F.lit("/a").alias("path"), F.lit("Prefix").alias("pathType"), backend(F.col("n") + 1).alias("backend"))).alias("paths")).alias("http"))
    ingress = F.to_json(F.struct(own("ing"), F.struct(F.lit("nginx").alias("ingressClassName"), backend(F.col("n")).alias("defaultBackend"), F.array(rule, rule).alias("rules"), F.when(F.col("n") % 2 == 0, F.array(F.lit("x"))).alias("tls")).alias("spec")))
    policy = F.to_json(F.struct(own("pol"), F.struct(F.struct(F.create_map(F.lit("b"), F.lit("1")).alias("matchLabels"), F.array(F.struct(F.lit("a").alias("key"), F.lit("NotIn").alias("operator"), F.array(F.lit("y"), F.lit("x")).alias("values"))).alias("matchExpressions")).alias("podSelector"), F.array(F.lit("Ingress"), F.lit("Egress")).alias("policyTypes"), F.array(F.lit(1)).alias("ingress")).alias("spec")))
    rows = s.select(F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), o.alias("object")) for k, o in (("Service", service), ("networking.k8s.io/Ingress", ingress), ("networking.k8s.io/NetworkPolicy", policy))])).alias("x"))
    return rows.select("x.*")


@query
def kube_web(spark: SparkSession, d: str) -> DataFrame:
    """Fields of services, ingresses and network policies."""
    n = normalize.normalize(web(spark, d))
    keys = ("selector", "nodePorts", "ports", "hosts", "backends", "paths", "tls", "podSelector", "policyTypes", "ingressRules", "egressRules")
    return n.select("uid", *[field(k).alias(k) for k in keys])


SQL["kube_web"] = """WITH s AS (SELECT s_suppkey AS n FROM supplier)
SELECT 'svc-' || n AS uid, 'app=' || n % 3 || ',tier=web' AS selector, '["http:' || n % 100 + 30000 || '/TCP"]' AS nodePorts, '["http:80/TCP->8080"]' AS ports, NULL AS hosts, NULL AS backends, NULL AS paths, NULL AS tls, NULL AS podSelector, NULL AS policyTypes, NULL AS ingressRules, NULL AS egressRules FROM s
UNION ALL SELECT 'ing-' || n, NULL, NULL, NULL, '["h' || n % 5 || '"]', '["' || array_to_string(list_sort(['svc-' || n % 40 || ':' || n % 2 + 80, 'svc-' || (n + 1) % 40 || ':' || (n + 1) % 2 + 80]), '","') || '"]', '["h' || n % 5 || ' /a Prefix -> svc-' || (n + 1) % 40 || ':' || (n + 1) % 2 + 80 || '"]', CASE WHEN n % 2 = 0 THEN 'true' ELSE 'false' END, NULL, NULL, NULL, NULL FROM s
UNION ALL SELECT 'pol-' || n, NULL, NULL, NULL, NULL, NULL, NULL, NULL, 'a notin (x,y),b=1', '["Egress","Ingress"]', '1', '0' FROM s"""


@query
def kube_routes(spark: SparkSession, d: str) -> DataFrame:
    """Routes of ingresses to the services of their backends."""
    objects = Workspace(spark).write(web(spark, d), "objects")
    return normalize.routes(objects, normalize.normalize(objects)).groupBy("from_uid").agg(F.count("*").alias("n"), F.min("to_uid").alias("first"))


SQL["kube_routes"] = """WITH s AS (SELECT s_suppkey AS n, s_nationkey AS ns FROM supplier), b AS (SELECT n, ns, n % 40 AS k FROM s UNION SELECT n, ns, (n + 1) % 40 FROM s)
SELECT 'ing-' || b.n AS from_uid, count(*) AS n, min('svc-' || t.n) AS first FROM b JOIN s t ON t.ns = b.ns AND t.n % 40 = b.k GROUP BY b.n"""


@query
def kube_edges(spark: SparkSession, d: str) -> DataFrame:
    """Edges of the pods to their nodes and from their owners, while both ends are there."""
    objects = Workspace(spark).write(pods(spark, d), "objects")
    get = lambda p: F.get_json_object("object", p)
    own = objects.select(get("$.metadata.uid").alias("uid"), "kind", get("$.metadata.namespace").alias("namespace"), get("$.metadata.name").alias("name"), get("$.spec.nodeName").alias("node"))
    nodes = own.where("node is not null").select(F.concat(F.lit("node/"), "node").alias("uid"), F.lit("Node").alias("kind"), F.lit(None).cast("string").alias("namespace"), F.col("node").alias("name")).distinct()
    owners = own.where(F.length("name") % 4 == 0).select(F.concat(F.lit("own-"), "uid").alias("uid"), F.lit("apps/ReplicaSet").alias("kind"), "namespace", F.lit("rs").alias("name"))
    resources = own.drop("node").unionByName(nodes).unionByName(owners)
    return normalize.object_edges(objects, resources).groupBy("type").agg(F.count("*").alias("n"), F.count_distinct("from_uid").alias("sources"), F.count_distinct("to_uid").alias("targets"))


SQL["kube_edges"] = f"""WITH {_POD} SELECT 'runs-on' AS type, count(*) AS n, count(DISTINCT uid) AS sources, count(DISTINCT node) AS targets FROM q WHERE node IS NOT NULL HAVING count(*) > 0
UNION ALL SELECT 'owns', count(*), count(*), count(*) FROM q WHERE length(name) % 4 = 0 HAVING count(*) > 0"""


@query
def volume_placement(spark: SparkSession, d: str) -> DataFrame:
    """Placement of volumes written from the parts: node affinity, pinned nodes, limitations."""
    n = F.col("p_partkey")
    one = F.array(F.struct(F.when(n % 3 == 0, "kubernetes.io/hostname").when(n % 3 == 1, "topology.kubernetes.io/zone").otherwise("disk").alias("key"), F.when(n % 7 == 0, "NotIn").otherwise("In").alias("operator"), F.array((n % 9).cast("string"), F.lit("0")).alias("values")))
    affinity = F.when(n % 5 > 0, F.struct(F.struct(F.array(F.struct(one.alias("matchExpressions"))).alias("nodeSelectorTerms")).alias("required")))
    modes = F.when(n % 4 == 0, F.array(F.lit("ReadWriteMany"))).when(n % 4 == 1, F.array(F.lit("ReadWriteOnce"))).when(n % 4 == 2, F.array(F.lit("ReadWriteOncePod")))
    o = F.to_json(F.struct(F.struct(n.cast("string").alias("name")).alias("metadata"), F.struct(affinity.alias("nodeAffinity"), modes.alias("accessModes")).alias("spec")))
    got = normalize.placement(table(spark, d, "part").select(o.alias("object")))
    return got.select("name", "node_affinity", F.array_join("pinned_nodes", ",").alias("pinned"), "zonal", F.array_join(F.transform("limitations", lambda x: F.left(x, F.lit(17))), ";").alias("limits"))


SQL["volume_placement"] = """WITH p AS (SELECT p_partkey AS n, p_partkey % 5 > 0 AS has, p_partkey % 7 <> 0 AS isin, list_sort(list_distinct([(p_partkey % 9)::VARCHAR, '0'])) AS vals FROM part)
SELECT n::VARCHAR AS name, CASE WHEN has THEN CASE n % 3 WHEN 0 THEN 'kubernetes.io/hostname' WHEN 1 THEN 'topology.kubernetes.io/zone' ELSE 'disk' END || CASE WHEN isin THEN ' in (' ELSE ' notin (' END || array_to_string(vals, ',') || ')' ELSE '' END AS node_affinity,
  CASE WHEN has AND isin AND n % 3 = 0 THEN array_to_string(vals, ',') ELSE '' END AS pinned, has AND isin AND n % 3 = 1 AS zonal,
  array_to_string(list_sort(list_filter([CASE WHEN has AND isin AND n % 3 = 0 THEN 'volume is node-lo' WHEN has AND isin AND n % 3 = 1 THEN 'volume is zonal (' END, CASE n % 4 WHEN 0 THEN 'ReadWriteMany is ' WHEN 1 THEN 'ReadWriteOnce wit' WHEN 3 THEN 'no access mode re' END], lambda x: x IS NOT NULL)), ';') AS limits FROM p"""


@query
def scrape_targets(spark: SparkSession, d: str) -> DataFrame:
    """Scrape targets of annotated pods, written from the suppliers, and of nodes."""
    n = F.col("s_suppkey")
    notes = F.map_filter(F.create_map(F.lit("prometheus.io/scrape"), F.when(n % 4 > 0, "true"), F.lit("prometheus.io/port"), F.when(n % 3 == 0, (n % 2 * 9000 + 80).cast("string")), F.lit("prometheus.io/path"), F.when(n % 5 == 0, "stats"), F.lit("prometheus.io/scheme"), F.when(n % 7 == 0, "ftp").when(n % 7 == 1, "https")), lambda _, v: v.isNotNull())
    ports = F.array(F.struct(F.lit("a").alias("container"), F.lit(80).alias("port"), F.lit(None).cast("string").alias("protocol")), F.struct(F.lit("b").alias("container"), F.lit(81).alias("port"), F.lit("UDP").alias("protocol")), F.struct(F.lit("c").alias("container"), F.lit(82).alias("port"), F.lit("tcp").alias("protocol")))
    s = table(spark, d, "supplier")
    asked = s.select(n.cast("string").alias("uid"), F.when(n % 2 == 0, "::1").otherwise("10.0.0.1").alias("ip"), F.when(n % 11 > 0, "Running").otherwise("Pending").alias("phase"), notes.alias("annotations"), ports.alias("ports"))
    nodes = kubelet_targets(table(spark, d, "nation").select(F.col("n_name").alias("name"), F.lit("10.1.1.1").alias("ip")))
    return pod_targets(asked).select("url", "uid", "container").unionByName(nodes.select("url", F.element_at("labels", F.lit("node")).alias("uid"), F.element_at("labels", F.lit("metrics_path")).alias("container")))


SQL["scrape_targets"] = """WITH s AS (SELECT s_suppkey AS n FROM supplier WHERE s_suppkey % 4 > 0 AND s_suppkey % 7 <> 0 AND s_suppkey % 11 > 0),
p AS (SELECT n, 80 AS port, 'a' AS container FROM s WHERE n % 3 > 0 UNION ALL SELECT n, 82, 'c' FROM s WHERE n % 3 > 0 UNION ALL SELECT n, n % 2 * 9000 + 80, CASE WHEN n % 2 = 0 THEN 'a' ELSE '' END FROM s WHERE n % 3 = 0)
SELECT CASE WHEN n % 7 = 1 THEN 'https' ELSE 'http' END || '://' || CASE WHEN n % 2 = 0 THEN '[::1]' ELSE '10.0.0.1' END || ':' || port || CASE WHEN n % 5 = 0 THEN '/stats' ELSE '/metrics' END AS url, n::VARCHAR AS uid, container FROM p
UNION ALL SELECT 'https://10.1.1.1:10250' || m, n_name, m FROM nation, (SELECT unnest(['/metrics', '/metrics/cadvisor']) AS m)"""


@query
def warnings_counted(spark: SparkSession, d: str) -> DataFrame:
    """Warnings of the last two days for each object by reason: versions of events, of which each counts what it adds."""
    e = table(spark, d, "events").select((F.unix_micros(F.col("ts").cast("timestamp")) / 1000).cast("long").alias("ms"), "event_type", "event_id")
    now = (e.agg(F.max("ms")).first()[0] or 0) + 1
    key = F.pmod("event_id", F.lit(997))
    versions = e.select(
        key.cast("string").alias("event_uid"), F.concat(F.lit("o"), (key % 50).cast("string")).alias("object_uid"), F.when(key % 4 > 0, "Warning").otherwise("Normal").alias("type"), F.concat(F.lit("Why not "), (key % 30).cast("string")).alias("reason"),
        (F.floor(F.col("event_id") / 997) + 1).alias("count"), F.lit(0).cast("long").alias("first_ms"), F.col("ms").alias("last_ms"), F.col("event_id").alias("version"),
    )
    return kube.warning_counts(versions, now, 2 * 86_400_000, top=3)


SQL["warnings_counted"] = """WITH e AS (SELECT epoch_us(ts) // 1000 AS ms, event_id AS v, event_id % 997 AS k, event_id // 997 + 1 AS c FROM events), z AS (SELECT max(ms) + 1 AS now FROM e),
d AS (SELECT k, ms, CASE WHEN lag(c) OVER (PARTITION BY k ORDER BY v) IS NOT NULL THEN c - lag(c) OVER (PARTITION BY k ORDER BY v) WHEN ms < now - 172800000 THEN 0 ELSE greatest(1, floor(c * (ms - (now - 172800000)) / greatest(ms, 1))) END AS n, now FROM e, z WHERE k % 4 > 0),
w AS (SELECT 'o' || k % 50 AS object_uid, 'Why_not_' || k % 30 AS reason, sum(n) AS n FROM d WHERE n > 0 AND ms // 2880000 * 2880000 >= now - 172800000 GROUP BY ALL),
r AS (SELECT object_uid, CASE WHEN row_number() OVER (PARTITION BY object_uid ORDER BY n DESC, reason) <= 3 THEN reason ELSE '_other' END AS reason, n FROM w) SELECT object_uid, reason, sum(n)::BIGINT AS n FROM r GROUP BY ALL"""


@query
def selected_pods(spark: SparkSession, d: str) -> DataFrame:
    """Selectors written from the nations and the pods whose labels they match."""
    pods_ = table(spark, d, "supplier").select(F.concat(F.lit("p"), F.col("s_suppkey").cast("string")).alias("uid"), F.lit("ns").alias("namespace"), F.create_map(F.lit("app"), (F.col("s_suppkey") % 5).cast("string"), F.lit("tier"), (F.col("s_suppkey") % 2).cast("string")).alias("labels"))
    n = F.col("n_nationkey")
    said = F.array(F.struct(F.lit("tier").alias("key"), F.when(n % 4 == 0, "In").when(n % 4 == 1, "NotIn").when(n % 4 == 2, "Exists").otherwise("DoesNotExist").alias("operator"), F.array(F.lit("1")).alias("values")))
    owners = table(spark, d, "nation").select(F.concat(F.lit("n"), n.cast("string")).alias("uid"), F.lit("ns").alias("namespace"), F.when(n % 3 > 0, F.create_map(F.lit("app"), (n % 5).cast("string"))).alias("selector"), said.alias("expressions"))
    return st.selector_edges(owners, pods_, "selects").groupBy("from_uid").agg(F.count("*").alias("n"))


SQL["selected_pods"] = """SELECT 'n' || n_nationkey AS from_uid, count(*) AS n FROM nation, supplier WHERE (n_nationkey % 3 = 0 OR s_suppkey % 5 = n_nationkey % 5) AND CASE n_nationkey % 4 WHEN 0 THEN s_suppkey % 2 = 1 WHEN 1 THEN s_suppkey % 2 <> 1 WHEN 2 THEN true ELSE false END GROUP BY 1"""


# -- state predicates
@query
def cel_owned(spark: SparkSession, d: str) -> DataFrame:
    """Deployments that control a replica set, and pods that are run on nothing known, at the end of each epoch."""
    ops = table(spark, d, "ops")
    tag = lambda c: F.concat_ws("|", "epoch", c)
    live = st.resources_at(ops.where("op <> 2")).select(tag("uid").alias("uid"), "kind", "namespace", "name", F.lit("{}").alias("fields"))
    edges = st.edges_at(ops).select(tag("from_uid").alias("from_uid"), "type", tag("to_uid").alias("to_uid"), "attrs")
    live, edges = (Workspace(spark).write(x) for x in (live, edges))
    owns = cel.evaluate(live, 'out(r, "owns").exists(x, x.kind == "ReplicaSet" && x.edge.controller == true)', 0, kinds=("Deployment",), edges=edges).groupBy("kind").agg(F.count_if("holds").alias("hold"), F.count("*").alias("n"), F.count_if(F.col("error").isNotNull()).alias("errors"))
    free = cel.evaluate(live, 'size(in(r, "owns")) == 0', 0, kinds=("Pod",), edges=edges).groupBy("kind").agg(F.count_if("holds").alias("hold"), F.count("*").alias("n"), F.count_if(F.col("error").isNotNull()).alias("errors"))
    return owns.unionByName(free)


SQL["cel_owned"] = """WITH life AS (SELECT epoch, uid, arg_max(op, {'s': seq, 'i': idx}) AS op, arg_max(kind, {'s': seq, 'i': idx}) AS kind FROM ops WHERE op IN (1, 3) GROUP BY ALL), r AS (SELECT epoch, uid, kind FROM life WHERE op = 1),
e AS (SELECT epoch, uid, to_uid, json_extract(attrs, '$.controller')::VARCHAR AS c FROM (SELECT epoch, uid, edge_type, to_uid, arg_max(op, {'s': seq, 'i': idx}) AS op, arg_max(coalesce(attrs, '{}'), {'s': seq, 'i': idx}) AS attrs FROM ops WHERE op IN (4, 5, 6) AND edge_type = 'owns' GROUP BY ALL) WHERE op <> 5),
x AS (SELECT r.epoch, r.uid, bool_or(e.c = 'true') AS yes, bool_or(e.c IS NULL) AS odd FROM r JOIN e ON e.epoch = r.epoch AND e.uid = r.uid JOIN r t ON t.epoch = e.epoch AND t.uid = e.to_uid AND t.kind = 'ReplicaSet' WHERE r.kind = 'Deployment' GROUP BY ALL),
i AS (SELECT DISTINCT e.epoch, e.to_uid AS uid FROM e JOIN r ON r.epoch = e.epoch AND r.uid = e.uid)
SELECT 'Deployment' AS kind, count(*) FILTER (yes) AS hold, count(*) AS n, count(*) FILTER (NOT coalesce(yes, false) AND odd) AS errors FROM r LEFT JOIN x ON x.epoch = r.epoch AND x.uid = r.uid WHERE kind = 'Deployment' HAVING count(*) > 0
UNION ALL SELECT 'Pod', count(*) FILTER (i.uid IS NULL), count(*), 0 FROM r LEFT JOIN i ON i.epoch = r.epoch AND i.uid = r.uid WHERE kind = 'Pod' HAVING count(*) > 0"""


@query
def cel_late_jobs(spark: SparkSession, d: str) -> DataFrame:
    """Cron jobs that last ran before their schedule's previous time, were the newest run the present; a null in a field that is read is an error."""
    jobs = held(spark, d, "CronJob").select("uid", "kind", "namespace", "name", "fields")
    now = jobs.agg(F.max(F.get_json_object("fields", "$['status.last_run']").try_cast("long"))).first()[0] or 0
    got = cel.evaluate(jobs, 'field(r, "status.last_run", 0) < cronPrevious("30 */6 * * *", "", int(now) * 1000)', now, kinds=("CronJob",), labels={"schedule": '=field(r, "spec.schedule", "none")'})
    return got.select("uid", "holds", F.element_at("labels", F.lit("schedule")).alias("schedule"))


SQL["cel_late_jobs"] = f"""WITH {_HELD % "'CronJob'"}, y AS (SELECT uid, json_type(f, '$."status.last_run"') AS k, json_type(f, '$."spec.schedule"') AS l, try_cast(json_extract_string(f, '$."status.last_run"') AS BIGINT) AS t, coalesce(json_extract_string(f, '$."spec.schedule"'), 'none') AS s FROM x),
z AS (SELECT (max(t) // 1000 * 1000 - 1800000) // 21600000 * 21600000 + 1800000 AS p FROM y), v AS (SELECT *, CASE WHEN coalesce(k, 'UBIGINT') IN ('UBIGINT', 'BIGINT') AND (coalesce(t, 0) >= p OR coalesce(l, '') <> 'NULL') THEN coalesce(t, 0) < p END AS holds FROM y, z)
SELECT uid, holds, CASE WHEN holds THEN s END AS schedule FROM v"""


@query
def cel_macros(spark: SparkSession, d: str) -> DataFrame:
    """Resources with a metric above three, by kind: macros over the keys of their fields."""
    rows = held(spark, d, "Pod", "Node", "Deployment").select("uid", "kind", "namespace", "name", "fields")
    got = cel.evaluate(rows, 'r.fields.exists(k, k.startsWith("metric.") && double(r.fields[k]) > 3.0) && !r.fields.all(k, k.endsWith("p95"))', 0, kinds=("Pod", "Node", "Deployment"))
    return got.groupBy("kind").agg(F.count_if("holds").alias("hold"), F.count("*").alias("n"))


SQL["cel_macros"] = f"""WITH {_HELD % "'Pod', 'Node', 'Deployment'"}, k AS (SELECT uid, kind, f, unnest(CASE WHEN len(json_keys(f)) = 0 THEN [NULL] ELSE json_keys(f) END) AS k FROM x),
y AS (SELECT uid, kind, coalesce(bool_or(k LIKE 'metric.%' AND try_cast(json_extract(f, '$."' || k || '"')::VARCHAR AS DOUBLE) > 3), false) AS hit, coalesce(bool_and(k LIKE '%p95'), true) AS every FROM k GROUP BY uid, kind)
SELECT kind, count(*) FILTER (hit AND NOT every) AS hold, count(*) AS n FROM y GROUP BY kind"""
