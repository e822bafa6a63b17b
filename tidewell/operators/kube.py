"""Kubernetes objects: normalised fields, published series, graph edges, warning-event counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PHASES = {"Pod": ("Pending", "Running", "Succeeded", "Failed", "Unknown"), "PersistentVolumeClaim": ("Pending", "Bound", "Lost")}
STATUSES = ("true", "false", "unknown")
SERIES = "struct<name:string,labels:map<string,string>,value:double>"


def text_of(fields: Column, key: str | Column) -> Column:
    """Field (a JSON text in a map) as plain text, null if absent."""
    raw = F.element_at(fields, F.lit(key) if isinstance(key, str) else key)
    return F.get_json_object(F.concat(F.lit('{"v":'), raw, F.lit("}")), "$.v")


def quantity(text: Column) -> Column:
    """Resource quantity in base units: 100m is 0.1, 1Ki is 1024."""
    number = F.regexp_extract(text, r"^([+-]?[\d.]+(?:[eE][+-]?\d+)?)", 1).try_cast("double")
    unit = F.regexp_extract(text, r"^[+-]?[\d.]+(?:[eE][+-]?\d+)?(n|u|m|k|M|G|T|P|E|Ki|Mi|Gi|Ti|Pi|Ei)?$", 1)
    scale = {"n": 1e-9, "u": 1e-6, "m": 1e-3, "": 1.0} | {u: 1000.0 ** (i + 1) for i, u in enumerate(("k", "M", "G", "T", "P", "E"))} | {f"{u}i": 1024.0 ** (i + 1) for i, u in enumerate("KMGTPE")}
    table = F.create_map(*[x for k, v in scale.items() for x in (F.lit(k), F.lit(v))])
    return F.when(text.rlike(r"^[+-]?[\d.]+(?:[eE][+-]?\d+)?(n|u|m|k|M|G|T|P|E|Ki|Mi|Gi|Ti|Pi|Ei)?$"), number * F.element_at(table, unit))


def unit_of(resource: Column) -> Column:
    return F.when(resource == "cpu", "core").when(resource.isin("memory", "storage", "ephemeral-storage") | resource.startswith("hugepages-") | resource.startswith("attachable-volumes-"), "byte").otherwise("integer")


def _sample(name: str, value: Column, **labels: Column) -> Column:
    pairs = F.map_from_arrays(F.array(*[F.lit(k) for k in labels]), F.array(*[v.cast("string") for v in labels.values()]))
    return F.struct(F.lit(name).alias("name"), F.map_filter(pairs, lambda _, v: v.isNotNull() & (v != "")).alias("labels"), value.cast("double").alias("value"))


def _keys(fields: Column, pattern: str) -> Column:
    return F.filter(F.map_keys(fields), lambda k: k.rlike(pattern))


def kube_series(resources: DataFrame) -> DataFrame:
    """``name, labels, value`` of the published series, from ``uid, kind, namespace, name, fields`` (map of JSON texts).

    Empty label values are left out; a pod without owners has one owner series with <none>.
    """
    f = F.col("fields")
    get = lambda k: text_of(f, k)
    num = lambda k: get(k).try_cast("double")
    flag = lambda k: F.when(get(k) == "true", 1.0).when(get(k) == "false", 0.0)
    pod = {"namespace": F.col("namespace"), "pod": F.col("name"), "uid": F.col("uid")}
    none = F.array().cast(f"array<{SERIES}>")

    def simple(series: str, label: str, key: str) -> Column:
        return F.when(num(key).isNotNull(), F.array(_sample(series, num(key), namespace=F.col("namespace"), **{label: F.col("name")}))).otherwise(none)

    def per_key(series: str, pattern: str, own: dict, names: dict[str, int], value, where=None, **more) -> Column:
        made = F.transform(_keys(f, pattern), lambda k: _sample(series, value(k), **own, **{n: F.regexp_extract(k, pattern, i) for n, i in names.items()}, **{n: g(k) for n, g in more.items()}))
        return F.filter(made, lambda s: s["value"].isNotNull() if where is None else where(s))

    one = lambda k: F.lit(1.0)
    text = lambda k: text_of(f, k)
    number = lambda k: F.coalesce(text(k).try_cast("double"), quantity(text(k)))
    owners = r"^owners\.([^.]+)\.(.+)$"
    own_series = F.transform(_keys(f, owners), lambda k: _sample("kube_pod_owner", F.lit(1.0), **pod, owner_kind=F.regexp_extract(k, owners, 1), owner_name=F.regexp_extract(k, owners, 2), owner_is_controller=text(k)))
    nobody = F.array(_sample("kube_pod_owner", F.lit(1.0), **pod, owner_kind=F.lit("<none>"), owner_name=F.lit("<none>"), owner_is_controller=F.lit("<none>")))
    controller = F.get(F.filter(_keys(f, owners), lambda k: text(k) == "true"), 0)
    container = r"^containers\.([^.]+)\."

    def phases(kind: str, series: str, own: dict) -> Column:
        return F.when(get("phase").isNotNull(), F.array(*[_sample(series, (get("phase") == p).cast("double"), **own, phase=F.lit(p)) for p in PHASES[kind]])).otherwise(none)

    def conditions(series: str, own: dict, pattern: str, label: str) -> Column:
        each = F.transform(_keys(f, pattern), lambda k: F.array(*[_sample(series, (F.lower(text(k)) == s).cast("double"), **own, **({label: F.lit(s)} if label == "condition" else {"condition": F.regexp_extract(k, pattern, 1), label: F.lit(s)})) for s in STATUSES]))
        return F.flatten(each)

    info = _sample("kube_pod_info", F.lit(1.0), **pod, host_ip=get("hostIP"), pod_ip=get("podIP"), node=get("nodeName"), created_by_kind=F.regexp_extract(controller, owners, 1), created_by_name=F.regexp_extract(controller, owners, 2), priority_class=get("priorityClassName"), host_network=F.coalesce(get("hostNetwork"), F.lit("false")))
    with_node = pod | {"node": get("nodeName")}
    images = F.transform(_keys(f, container + r"image$"), lambda k: _sample("kube_pod_container_info", F.lit(1.0), **pod, container=F.regexp_extract(k, container, 1), image_spec=text(k), image=text(k), image_id=text(F.concat(F.regexp_extract(k, r"^(.*\.)image$", 1), F.lit("imageID")))))
    pods = F.concat(
        F.array(info), phases("Pod", "kube_pod_status_phase", pod), conditions("kube_pod_status_ready", pod, r"^conditions\.(Ready)\.status$", "condition"), images,
        per_key("kube_pod_container_status_restarts_total", container + r"restarts$", pod, {"container": 1}, number),
        per_key("kube_pod_container_status_waiting_reason", container + r"waitingReason$", pod, {"container": 1}, one, reason=text),
        per_key("kube_pod_container_status_last_terminated_reason", container + r"lastTerminatedReason$", pod, {"container": 1}, one, reason=text),
        per_key("kube_pod_container_resource_requests", container + r"requests\.(.+)$", with_node, {"container": 1, "resource": 2}, number, unit=lambda k: unit_of(F.regexp_extract(k, container + r"requests\.(.+)$", 2))),
        per_key("kube_pod_container_resource_limits", container + r"limits\.(.+)$", with_node, {"container": 1, "resource": 2}, number, unit=lambda k: unit_of(F.regexp_extract(k, container + r"limits\.(.+)$", 2))),
        F.when(F.size(own_series) > 0, own_series).otherwise(nobody),
    )
    node = {"node": F.col("name")}
    node_info = _sample("kube_node_info", F.lit(1.0), **node, kernel_version=get("kernelVersion"), os_image=get("osImage"), container_runtime_version=get("containerRuntimeVersion"), kubelet_version=get("kubeletVersion"), provider_id=get("providerID"), pod_cidr=get("podCIDR"), internal_ip=get("internalIP"))
    nodes = F.concat(
        F.array(node_info), conditions("kube_node_status_condition", node, r"^conditions\.([^.]+)\.status$", "status"),
        *[per_key(f"kube_node_status_{what}", rf"^{what}\.(.+)$", node, {"resource": 1}, number, unit=lambda k, w=what: unit_of(F.regexp_extract(k, rf"^{w}\.(.+)$", 1))) for what in ("capacity", "allocatable")],
        F.array(_sample("kube_node_spec_unschedulable", F.coalesce(flag("unschedulable"), F.lit(0.0)), **node)),
    )
    claim = {"namespace": F.col("namespace"), "persistentvolumeclaim": F.col("name")}
    claims = F.concat(
        phases("PersistentVolumeClaim", "kube_persistentvolumeclaim_status_phase", claim), F.when(number(F.lit("requests.storage")).isNotNull(), F.array(_sample("kube_persistentvolumeclaim_resource_requests_storage_bytes", number(F.lit("requests.storage")), **claim))).otherwise(none),
        F.array(_sample("kube_persistentvolumeclaim_info", F.lit(1.0), **claim, storageclass=get("storageClassName"), volumename=get("volumeName"), volumemode=get("volumeMode"))),
    )
    tables = {
        "apps/Deployment": [("kube_deployment_spec_replicas", "deployment", "replicas"), ("kube_deployment_status_replicas_available", "deployment", "availableReplicas"), ("kube_deployment_status_replicas_unavailable", "deployment", "unavailableReplicas")],
        "apps/StatefulSet": [("kube_statefulset_replicas", "statefulset", "replicas"), ("kube_statefulset_status_replicas_ready", "statefulset", "readyReplicas")],
        "apps/DaemonSet": [("kube_daemonset_status_desired_number_scheduled", "daemonset", "desiredNumberScheduled"), ("kube_daemonset_status_number_ready", "daemonset", "numberReady")],
        "batch/Job": [("kube_job_status_failed", "job_name", "failed")],
    }
    kind = F.col("kind")
    series = F.when(kind == "Pod", pods).when(kind == "Node", nodes).when(kind == "PersistentVolumeClaim", claims)
    for k, rows in tables.items():
        series = series.when(kind == k, F.concat(*[simple(*r) for r in rows]))
    return resources.where(F.col("fields").isNotNull()).select(F.explode(series).alias("s")).select("s.*")


def node_series(series: DataFrame, node: str) -> DataFrame:
    """Series of one node: its own, and those of pods that kube_pod_info places there."""
    uid = F.element_at("labels", F.lit("uid"))
    here = series.where((F.col("name") == "kube_pod_info") & (F.element_at("labels", F.lit("node")) == node)).select(uid.alias("pod_uid"))
    pods = series.where(F.col("name").startswith("kube_pod_")).withColumn("pod_uid", uid).join(here, "pod_uid", "left_semi").drop("pod_uid")
    own = series.where(F.col("name").startswith("kube_node_") & (F.element_at("labels", F.lit("node")) == node))
    return pods.select("name", "labels", "value").unionByName(own.select("name", "labels", "value"))


def warning_counts(events: DataFrame, now_ms: int, window_ms: int = 3_600_000, top: int = 16) -> DataFrame:
    """``object_uid, reason, n``: warnings of the window for each object, the ``top`` reasons, the rest as ``_other``.

    events: versions of events, ``event_uid, object_uid, type, reason, count,
    first_ms, last_ms, version``.  A version counts what it adds to the one
    before; the first seen counts in full if it began in the window, else its
    share of the window.
    """
    warn = events.where((F.col("type") == "Warning") & F.col("object_uid").isNotNull() & F.col("event_uid").isNotNull())
    c, last = F.greatest(F.coalesce("count", F.lit(1)), F.lit(1)), F.least(F.coalesce("last_ms", "first_ms", F.lit(now_ms)), F.lit(now_ms))
    rows = warn.withColumn("c", c).withColumn("last", last)
    order = Window.partitionBy("event_uid").orderBy("version")
    start = now_ms - window_ms
    share = F.greatest(F.lit(1), F.floor(F.col("c") * (F.col("last") - start) / F.greatest(F.col("last") - F.col("first_ms"), F.lit(1))))
    fresh = F.when(F.col("first_ms") >= start, F.col("c")).when(F.col("last") < start, F.lit(0)).otherwise(share)
    before = F.lag("c").over(order)
    delta = F.when(before.isNotNull(), F.col("c") - before).otherwise(fresh)
    width = window_ms // 60
    sums = rows.withColumn("d", delta).where("d > 0").where(F.floor(F.col("last") / width) * width >= start)
    sums = sums.groupBy("object_uid", F.left(F.regexp_replace(F.when(F.coalesce("reason", F.lit("")) == "", F.lit("Unknown")).otherwise(F.col("reason")), "[^A-Za-z0-9_-]", "_"), F.lit(64)).alias("reason")).agg(F.sum("d").alias("n"))
    rank = F.row_number().over(Window.partitionBy("object_uid").orderBy(F.desc("n"), "reason"))
    named = sums.withColumn("reason", F.when(rank <= top, F.col("reason")).otherwise(F.lit("_other")))
    return named.groupBy("object_uid", "reason").agg(F.sum("n").cast("long").alias("n"))


def normalize_metadata(meta: Column, labels: tuple[str, ...] = (), annotations: tuple[str, ...] = ()) -> Column:
    """Fields of an object's metadata (a VARIANT): created, terminating, allowed labels and annotations, owners.

    A pattern is a name, or a prefix with a star.
    """
    def allowed(k: Column, patterns: tuple[str, ...]) -> Column:
        hit = F.lit(False)
        for p in patterns:
            hit = hit | (k.startswith(p[:-1]) if p.endswith("*") else k == p)
        return hit

    get = lambda path, kind="string": F.try_variant_get(meta, path, kind)
    millis = lambda path: F.unix_millis(F.try_to_timestamp(get(path))).cast("string")
    empty = F.create_map().cast("map<string,string>")
    own = F.coalesce(get("$.ownerReferences", "array<struct<kind:string,name:string,controller:boolean>>"), F.array().cast("array<struct<kind:string,name:string,controller:boolean>>"))
    owners = F.map_from_entries(F.transform(own, lambda o: F.struct(F.concat_ws(".", F.lit("owners"), o["kind"], o["name"]).alias("k"), F.coalesce(o["controller"], F.lit(False)).cast("string").alias("v"))))

    def chosen(what: str, patterns: tuple[str, ...]) -> Column:
        held = F.map_filter(F.coalesce(get(f"$.{what}", "map<string,string>"), empty), lambda k, _: allowed(k, patterns))
        return F.transform_keys(held, lambda k, _: F.concat(F.lit(f"{what}."), k))

    parts = [
        F.map_filter(F.create_map(F.lit("created"), millis("$.creationTimestamp")), lambda _, v: v.isNotNull()),
        F.map_filter(F.create_map(F.lit("terminating"), F.when(get("$.deletionTimestamp").isNotNull(), F.lit("true"))), lambda _, v: v.isNotNull()),
        chosen("labels", labels),
        chosen("annotations", annotations),
        owners,
    ]
    return F.map_concat(*parts)


def normalize_conditions(conditions: Column, pattern: str = r"^[A-Za-z][A-Za-z0-9-]*$", most: int = 32) -> Column:
    """``conditions.<type>.status`` and ``.reason`` of an ARRAY<STRUCT<type, status, reason>>; at most ``most`` types, which is the format's bound."""
    good = F.slice(F.array_sort(F.filter(conditions, lambda c: c["type"].rlike(pattern))), 1, most)
    entries = F.flatten(F.transform(good, lambda c: F.array(F.struct(F.concat(F.lit("conditions."), c["type"], F.lit(".status")).alias("k"), c["status"].alias("v")), F.struct(F.concat(F.lit("conditions."), c["type"], F.lit(".reason")).alias("k"), c["reason"].alias("v")))))
    return F.map_from_entries(F.filter(entries, lambda e: e["v"].isNotNull()))


def host_object_edges(owners: DataFrame, owned: DataFrame, on: list[str], edge_type: str) -> DataFrame:
    """Edges between resources that share key columns (unit-process, mount-device, socket-process...)."""
    a = owners.select(*on, F.col("uid").alias("from_uid"))
    b = owned.select(*on, F.col("uid").alias("to_uid"))
    return a.join(b, on).select("from_uid", F.lit(edge_type).alias("type"), "to_uid").distinct()
