"""Joins between alerts, metric facts, series, images and the resource graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewell.functions import labels as L
from tidewell.sources.metrics import changed_facts

# fixed values: edges that lead from a resource toward pods, followed forward or against their direction
TOWARD_PODS = ("owns", "selects", "targets", "guards", "routes", "scales")
FROM_PODS = ("mounts", "binds")


def resolve_resources(observed: DataFrame, resources: DataFrame, kind: str, name_label: str, namespace_label: str | None = None) -> DataFrame:
    """``observed`` (labels) with ``resource_uid``: the resource of a kind that its labels name; null if there is none.

    Of several resources of one name the least uid counts.
    """
    named = resources.where(F.col("kind") == kind).groupBy(F.coalesce("namespace", F.lit("")).alias("ns"), F.col("name").alias("nm")).agg(F.min("uid").alias("resource_uid"))
    ns = L.value_of(F.col("labels"), namespace_label) if namespace_label else F.lit("")
    keyed = observed.withColumn("nm", L.value_of(F.col("labels"), name_label)).withColumn("ns", ns)
    return keyed.join(named, ["ns", "nm"], "left").drop("ns", "nm")


def place_facts(facts: DataFrame, pods: DataFrame, claims: DataFrame, nodes: DataFrame) -> DataFrame:
    """``facts`` (node, namespace, pod, uid, claim, container, facts MAP) with ``target_uid``, ``prefix`` and ``placed``.

    pods: ``uid, namespace, name, node, claims ARRAY``; claims: ``uid, namespace,
    name``; nodes: ``uid, name``.  A node tells only of its own: a pod is found by
    its uid if namespace, name and node agree, without a uid by its name if that
    is single on the node; a claim only if a pod of the node mounts it.  Facts of
    neither are the node's.  What is not found has ``placed`` false.
    """
    by_uid = pods.select(F.col("uid").alias("uid"), "namespace", F.col("name").alias("pod"), "node", F.col("uid").alias("uid_found")).distinct()
    single = pods.groupBy("node", "namespace", F.col("name").alias("pod")).agg(F.min("uid").alias("name_found"), F.count_distinct("uid").alias("k")).where("k = 1").drop("k")
    mounted = pods.select("node", "namespace", F.explode("claims").alias("claim")).distinct().join(claims.select("namespace", F.col("name").alias("claim"), F.col("uid").alias("claim_found")), ["namespace", "claim"])
    hosts = nodes.select(F.col("name").alias("node"), F.col("uid").alias("node_found"))
    out = facts.join(by_uid, ["uid", "namespace", "pod", "node"], "left").join(single, ["node", "namespace", "pod"], "left").join(mounted, ["node", "namespace", "claim"], "left").join(hosts, "node", "left")
    target = F.when(F.col("claim").isNotNull(), F.col("claim_found")).when(F.col("pod").isNotNull(), F.when(F.col("uid").isNotNull(), F.col("uid_found")).otherwise(F.col("name_found"))).otherwise(F.col("node_found"))
    prefix = F.when(F.col("claim").isNull() & F.col("pod").isNotNull() & F.col("container").isNotNull(), F.concat(F.lit("containers."), "container", F.lit("."))).otherwise("")
    return out.select(*facts.columns, target.alias("target_uid"), prefix.alias("prefix"), target.isNotNull().alias("placed"))


def facts_to_send(facts: DataFrame, last_sent: DataFrame, live: DataFrame, key: tuple[str, ...], floors: dict[str, float]) -> DataFrame:
    """Facts (key, uid, facts MAP of texts) whose pod is live and that are new, of another pod, or changed beyond the thresholds.

    last_sent: key, ``uid``, ``facts`` as sent before; live: key, ``uid`` of the
    pods that run now.
    """
    now = live.select(*key, F.col("uid").alias("live_uid"))
    sent = last_sent.select(*key, F.col("uid").alias("sent_uid"), F.col("facts").alias("sent"))
    empty = F.create_map().cast("map<string,string>")
    joined = facts.drop("uid").join(now, list(key)).join(sent, list(key), "left")
    moved = ~F.col("live_uid").eqNullSafe(F.col("sent_uid")) | changed_facts(F.coalesce("sent", empty), F.col("facts"), floors)
    return joined.where(moved).select(*key, F.col("live_uid").alias("uid"), "facts")


def gone_instances(instances: DataFrame, samples: DataFrame, inputs: tuple[str, ...], at_ms: int, *, lookback_ms: int = 300_000, own_labels: tuple[str, ...] = ()) -> DataFrame:
    """Active instances (instance_key, labels) without a live series of any input that carries their labels.

    A series is live if its last sample within the lookback is no stale marker.
    Of an instance only the labels count that series of the input have and that
    the rule itself does not set.  Instances and series meet by equality of those
    labels: each set of label names is a join of its own key, not a scan.
    """
    near = samples.where((F.col("ts_ms") >= at_ms - lookback_ms) & (F.col("ts_ms") <= at_ms)).withColumn("metric", F.element_at("labels", F.lit("__name__"))).where(F.col("metric").isin(*inputs))
    last = near.groupBy("metric", "labels").agg(F.max(F.struct("ts_ms", "is_stale")).alias("z"))
    carried = last.select("metric", F.explode(F.map_keys("labels")).alias("n")).where(~F.col("n").isin("__name__", "alertname", *own_labels)).groupBy("metric").agg(F.array_sort(F.collect_set("n")).alias("carried"))
    mine = instances.withColumn("metric", F.explode(F.array(*[F.lit(n) for n in inputs]))).join(carried, "metric")
    names = F.array_sort(F.array_intersect(F.map_keys("labels"), "carried"))
    mine = mine.withColumn("names", names).withColumn("key", _key(F.col("labels"), F.col("names")))
    kinds = mine.select("metric", "names").distinct()
    series = last.where("not z.is_stale").join(kinds, "metric").select("metric", "names", _key(F.col("labels"), F.col("names")).alias("key")).distinct()
    live = mine.join(series, ["metric", "names", "key"], "left_semi").select("instance_key").distinct()
    return instances.join(live, "instance_key", "left_anti")


def _key(labels: Column, names: Column) -> Column:
    return F.to_json(F.transform(names, lambda n: F.coalesce(F.element_at(labels, n), F.lit(""))))


def pods_of(starts: DataFrame, resources: DataFrame, edges: DataFrame, *, hops: int = 4) -> DataFrame:
    """``start, pod_uid``: pods related to each start (uid) within ``hops``, never past a pod, a namespace or a node."""
    steps = edges.where(F.col("type").isin(*TOWARD_PODS)).select(F.col("from_uid").alias("a"), F.col("to_uid").alias("b")).unionByName(edges.where(F.col("type").isin(*FROM_PODS)).select(F.col("to_uid").alias("a"), F.col("from_uid").alias("b"))).distinct()
    kinds = resources.select(F.col("uid").alias("b"), "kind")
    seen = frontier = starts.select(F.col("uid").alias("start"), F.col("uid").alias("at"))
    found = None
    for _ in range(hops):
        near = frontier.join(steps, frontier["at"] == steps["a"]).select("start", "b").distinct().join(seen.select("start", F.col("at").alias("b")), ["start", "b"], "left_anti").join(kinds, "b")
        pods = near.where("kind = 'Pod'").select("start", F.col("b").alias("pod_uid"))
        found = pods if found is None else found.unionByName(pods)
        seen = seen.unionByName(near.select("start", F.col("b").alias("at")))
        frontier = near.where(~F.col("kind").isin("Pod", "Namespace", "Node")).select("start", F.col("b").alias("at"))
    return found


def image_nodes(pods: DataFrame) -> DataFrame:
    """``digest, node``: nodes on which pods (fields MAP of texts) run an image, by its digest."""
    ids = pods.select(F.element_at("fields", F.lit("nodeName")).alias("node"), F.explode("fields").alias("k", "v")).where(F.col("k").rlike(r"^(?:containers|initContainers)\..*\.imageID$"))
    return ids.select(F.nullif(F.regexp_extract("v", r"(sha256:[0-9a-f]{64})\b", 1), F.lit("")).alias("digest"), "node").dropna().distinct()


def best_answer(answers: DataFrame, key: str = "digest") -> DataFrame:
    """The best answer (key, node, status, truncated, ...) of all nodes: ready whole, ready cut, pending, else unavailable."""
    rank = F.when((F.col("status") == "ready") & ~F.coalesce("truncated", F.lit(False)), 0).when(F.col("status") == "ready", 1).when(F.col("status") == "pending", 2).otherwise(3)
    first = Window.partitionBy(key).orderBy("rank", "node")
    return answers.withColumn("rank", rank).withColumn("n", F.row_number().over(first)).where("n = 1").drop("n", "rank")


def merge_nodes(results: DataFrame, asked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows of all nodes, status of each): rows (node, oldest_ms, ...) of one source each; asked: ``node, error``.

    A node with an error, or without rows, is told as such; the oldest time that
    all answers cover is the latest of their oldest ones.
    """
    told = results.groupBy("node").agg(F.count("*").alias("rows"), F.min("oldest_ms").alias("oldest_ms"))
    status = asked.join(told, "node", "left").select("node", F.when(F.col("error").isNotNull(), "error").when(F.col("rows").isNull(), "empty").otherwise("ok").alias("status"), F.coalesce("rows", F.lit(0)).alias("rows"), "oldest_ms")
    return results.join(asked.where("error is null").select("node"), "node", "left_semi"), status


def replace_series(store: DataFrame, incoming: DataFrame, source: str, at_ms: int, retention_ms: int) -> DataFrame:
    """A store of samples (source, labels, ts_ms, value, is_stale) after a source sent all of its series.

    Only samples newer than the newest of their series are taken; a series that
    the source no longer has is marked stale at ``at_ms``; what is older than the
    retention goes.
    """
    sid = L.canonical(F.col("labels"))
    mine = store.where(F.col("source") == source).withColumn("sid", sid)
    newest = mine.groupBy("sid").agg(F.max("ts_ms").alias("newest"), F.max_by("is_stale", "ts_ms").alias("ended"), F.first("labels").alias("labels"))
    sent = incoming.withColumn("sid", sid)
    fresh = sent.join(newest.select("sid", "newest"), "sid", "left").where(F.col("newest").isNull() | (F.col("ts_ms") > F.col("newest")))
    gone = newest.where("not ended").join(sent.select("sid").distinct(), "sid", "left_anti").where(F.col("newest") < at_ms)
    columns = ["source", "labels", "ts_ms", "value", "is_stale"]
    marks = gone.select(F.lit(source).alias("source"), "labels", F.lit(at_ms).cast("long").alias("ts_ms"), F.lit(float("nan")).alias("value"), F.lit(True).alias("is_stale"))
    out = store.select(*columns).unionByName(fresh.withColumn("source", F.lit(source)).select(*columns)).unionByName(marks)
    return out.where(F.col("ts_ms") >= at_ms - retention_ms)
