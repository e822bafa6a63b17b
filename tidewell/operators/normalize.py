"""Kubernetes objects (JSON) to flat fields and graph edges, by built-in columns.

Fields are a map of JSON texts.  Simple fields are paths in a table for each
kind; containers, conditions, owners and references are projected by their own
functions.  Values of secrets and config maps are never read, only their keys.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.operators.kube import normalize_conditions, normalize_metadata, quantity
from tidewell.workspace import Workspace

# --- fixed values: exported fields of each kind ----------------------------------
# field: path below the object; after a colon the type: i int, b bool, t time, q quantity, l list of
# strings, text otherwise; after an equals sign the default
_WORKLOAD = "generation=metadata.generation:i observedGeneration=status.observedGeneration:i"
FIELDS = {
    "Namespace": "phase=status.phase",
    "Node": "unschedulable=spec.unschedulable:b kubeletVersion=status.nodeInfo.kubeletVersion containerRuntimeVersion=status.nodeInfo.containerRuntimeVersion osImage=status.nodeInfo.osImage kernelVersion=status.nodeInfo.kernelVersion architecture=status.nodeInfo.architecture operatingSystem=status.nodeInfo.operatingSystem providerID=spec.providerID podCIDR=spec.podCIDR",
    "Pod": "phase=status.phase reason=status.reason nodeName=spec.nodeName hostIP=status.hostIP podIP=status.podIP qosClass=status.qosClass priorityClassName=spec.priorityClassName hostNetwork=spec.hostNetwork:b serviceAccountName=spec.serviceAccountName",
    "apps/Deployment": f"replicas=spec.replicas:i?1 paused=spec.paused:b strategy=spec.strategy.type statusReplicas=status.replicas:i readyReplicas=status.readyReplicas:i availableReplicas=status.availableReplicas:i updatedReplicas=status.updatedReplicas:i unavailableReplicas=status.unavailableReplicas:i {_WORKLOAD}",
    "apps/ReplicaSet": f"replicas=spec.replicas:i?1 statusReplicas=status.replicas:i readyReplicas=status.readyReplicas:i availableReplicas=status.availableReplicas:i {_WORKLOAD}",
    "apps/StatefulSet": f"replicas=spec.replicas:i?1 serviceName=spec.serviceName podManagementPolicy=spec.podManagementPolicy updateStrategy=spec.updateStrategy.type statusReplicas=status.replicas:i readyReplicas=status.readyReplicas:i availableReplicas=status.availableReplicas:i currentReplicas=status.currentReplicas:i updatedReplicas=status.updatedReplicas:i currentRevision=status.currentRevision updateRevision=status.updateRevision {_WORKLOAD}",
    "apps/DaemonSet": f"updateStrategy=spec.updateStrategy.type desiredNumberScheduled=status.desiredNumberScheduled:i currentNumberScheduled=status.currentNumberScheduled:i numberReady=status.numberReady:i numberAvailable=status.numberAvailable:i numberUnavailable=status.numberUnavailable:i numberMisscheduled=status.numberMisscheduled:i updatedNumberScheduled=status.updatedNumberScheduled:i {_WORKLOAD}",
    "batch/Job": "completions=spec.completions:i parallelism=spec.parallelism:i backoffLimit=spec.backoffLimit:i suspend=spec.suspend:b completionMode=spec.completionMode active=status.active:i succeeded=status.succeeded:i failed=status.failed:i",
    "batch/CronJob": "schedule=spec.schedule timeZone=spec.timeZone suspend=spec.suspend:b concurrencyPolicy=spec.concurrencyPolicy lastScheduleTime=status.lastScheduleTime:t lastSuccessfulTime=status.lastSuccessfulTime:t",
    "Service": "externalName=spec.externalName type=spec.type clusterIP=spec.clusterIP sessionAffinity=spec.sessionAffinity externalTrafficPolicy=spec.externalTrafficPolicy internalTrafficPolicy=spec.internalTrafficPolicy",
    "PersistentVolumeClaim": "phase=status.phase storageClassName=spec.storageClassName accessModes=spec.accessModes:l requests.storage=spec.resources.requests.storage:q capacity.storage=status.capacity.storage:q volumeName=spec.volumeName volumeMode=spec.volumeMode",
    "PersistentVolume": "phase=status.phase storageClassName=spec.storageClassName capacity.storage=spec.capacity.storage:q accessModes=spec.accessModes:l reclaimPolicy=spec.persistentVolumeReclaimPolicy volumeMode=spec.volumeMode driver=spec.csi.driver",
    "autoscaling/HorizontalPodAutoscaler": "target.kind=spec.scaleTargetRef.kind target.name=spec.scaleTargetRef.name minReplicas=spec.minReplicas:i?1 maxReplicas=spec.maxReplicas:i currentReplicas=status.currentReplicas:i desiredReplicas=status.desiredReplicas:i",
    "policy/PodDisruptionBudget": "currentHealthy=status.currentHealthy:i desiredHealthy=status.desiredHealthy:i disruptionsAllowed=status.disruptionsAllowed:i expectedPods=status.expectedPods:i",
    "storage.k8s.io/StorageClass": "provisioner=provisioner reclaimPolicy=reclaimPolicy volumeBindingMode=volumeBindingMode allowVolumeExpansion=allowVolumeExpansion:b",
    "networking.k8s.io/Ingress": "ingressClassName=spec.ingressClassName", "networking.k8s.io/NetworkPolicy": "policyTypes=spec.policyTypes:l",
    "ConfigMap": "immutable=immutable:b", "Secret": "type=type immutable=immutable:b",
}
CONDITIONS = {"Pod": "PodScheduled|PodReadyToStartContainers|Initialized|ContainersReady|Ready|DisruptionTarget", "apps/Deployment": "Available|Progressing|ReplicaFailure"}
POD_SPEC = {"Pod": "spec", "batch/CronJob": "spec.jobTemplate.spec.template.spec"} | dict.fromkeys(("apps/Deployment", "apps/ReplicaSet", "apps/StatefulSet", "apps/DaemonSet", "batch/Job"), "spec.template.spec")
# ---------------------------------------------------------------------------------

_CONTAINER = "array<struct<name:string,image:string,resources:struct<requests:map<string,string>,limits:map<string,string>>,ports:array<struct<name:string,containerPort:int,protocol:string>>,envFrom:array<struct<configMapRef:struct<name:string>,secretRef:struct<name:string>>>,env:array<struct<name:string,valueFrom:struct<configMapKeyRef:struct<name:string,key:string>,secretKeyRef:struct<name:string,key:string>>>>>>"
_STATE = "struct<waiting:struct<reason:string>,running:struct<startedAt:string>,terminated:struct<reason:string,exitCode:int>>"
_STATUS = f"array<struct<name:string,imageID:string,ready:boolean,restartCount:int,state:{_STATE},lastState:{_STATE}>>"
_VOLUME = "array<struct<name:string,configMap:struct<name:string>,secret:struct<secretName:string>,persistentVolumeClaim:struct<claimName:string>>>"


def _text(v: Column) -> Column:
    """A value as JSON text."""
    return F.regexp_extract(F.to_json(F.struct(v.alias("v"))), r'(?s)^\{"v":(.*)\}$', 1)


def _map(pairs: list[tuple[str, Column]]) -> Column:
    """Map of JSON texts from named columns; nulls are left out."""
    entries = F.array(*[F.when(v.isNotNull(), F.struct(F.lit(k).alias("k"), _text(v).alias("v"))) for k, v in pairs])
    return F.map_from_entries(F.filter(entries, lambda e: e.isNotNull()))


def _simple(o: Column, kind: str) -> list[tuple[str, Column]]:
    out = []
    for item in FIELDS[kind].split():
        name, _, path = item.partition("=")
        path, _, rest = path.partition(":")
        of, _, default = rest.partition("?")
        get = lambda t, p=path: F.try_variant_get(o, f"$.{p}", t)
        v = {"i": lambda: get("bigint"), "b": lambda: get("boolean"), "t": lambda: F.unix_millis(F.try_to_timestamp(get("string"))), "q": lambda: quantity(get("string")), "l": lambda: F.array_sort(get("array<string>"))}.get(of, lambda: get("string"))()
        out.append((name, F.coalesce(v, F.lit(int(default))) if default else v))
    return out


def _amount(resource: Column, text: Column) -> Column:
    return _text(F.coalesce(quantity(text), F.lit(0.0)))


def _containers(o: Column, spec: str, which: str, statuses: str | None) -> Column:
    """Entries (k, v) of the containers of a pod spec and of their statuses."""
    none = F.array().cast("array<struct<k:string,v:string>>")
    held = F.coalesce(F.try_variant_get(o, f"$.{spec}.{which}", _CONTAINER), F.array().cast(_CONTAINER))

    def entry(c: Column, field: str, v: Column) -> Column:
        return F.struct(F.concat_ws(".", F.lit(which), c["name"], F.lit(field)).alias("k"), v.alias("v"))

    def of_spec(c: Column) -> Column:
        resources = [F.coalesce(_amounts(c, part), none) for part in ("requests", "limits")]
        ports = F.array_sort(F.transform(c["ports"], lambda p: F.concat(F.coalesce(F.concat(p["name"], F.lit(":")), F.lit("")), p["containerPort"].cast("string"), F.lit("/"), F.coalesce(p["protocol"], F.lit("TCP")))))
        own = F.array(entry(c, "image", _text(c["image"])), entry(c, "ports", F.when(F.size(ports) > 0, _text(ports))))
        return F.concat(own, *resources)

    def _amounts(c: Column, part: str) -> Column:
        return F.transform(F.map_entries(c["resources"][part]), lambda e: F.struct(F.concat_ws(".", F.lit(which), c["name"], F.lit(part), e["key"]).alias("k"), _amount(e["key"], e["value"]).alias("v")))

    def of_status(s: Column) -> Column:
        kind = F.when(s["state"]["waiting"].isNotNull(), "waiting").when(s["state"]["terminated"].isNotNull(), "terminated").when(s["state"]["running"].isNotNull(), "running")
        told = {"imageID": s["imageID"], "ready": s["ready"], "restarts": s["restartCount"], "state": kind, "waitingReason": s["state"]["waiting"]["reason"], "terminatedReason": s["state"]["terminated"]["reason"], "terminatedExitCode": s["state"]["terminated"]["exitCode"], "lastTerminatedReason": s["lastState"]["terminated"]["reason"], "lastTerminatedExitCode": s["lastState"]["terminated"]["exitCode"]}
        return F.array(*[entry(s, k, F.when(v.isNotNull(), _text(v))) for k, v in told.items()])

    out = F.flatten(F.transform(held, of_spec))
    if statuses:
        out = F.concat(out, F.flatten(F.transform(F.coalesce(F.try_variant_get(o, f"$.{statuses}", _STATUS), F.array().cast(_STATUS)), of_status)))
    return out


def references(o: Column, spec: str) -> dict[str, Column]:
    """Sorted names of the config maps, secrets and claims that a pod spec uses."""
    empty = F.array().cast("array<string>")
    volumes = F.coalesce(F.try_variant_get(o, f"$.{spec}.volumes", _VOLUME), F.array().cast(_VOLUME))
    held = F.concat(*[F.coalesce(F.try_variant_get(o, f"$.{spec}.{w}", _CONTAINER), F.array().cast(_CONTAINER)) for w in ("containers", "initContainers")])
    env = F.flatten(F.transform(held, lambda c: F.coalesce(c["env"], F.array().cast("array<struct<name:string,valueFrom:struct<configMapKeyRef:struct<name:string,key:string>,secretKeyRef:struct<name:string,key:string>>>>"))))
    env_from = F.flatten(F.transform(held, lambda c: F.coalesce(c["envFrom"], F.array().cast("array<struct<configMapRef:struct<name:string>,secretRef:struct<name:string>>>"))))
    pull = F.transform(F.coalesce(F.try_variant_get(o, f"$.{spec}.imagePullSecrets", "array<struct<name:string>>"), F.array().cast("array<struct<name:string>>")), lambda x: x["name"])
    names = {
        "refs.configMaps": F.concat(F.transform(volumes, lambda v: v["configMap"]["name"]), F.transform(env, lambda e: e["valueFrom"]["configMapKeyRef"]["name"]), F.transform(env_from, lambda e: e["configMapRef"]["name"])),
        "refs.secrets": F.concat(F.transform(volumes, lambda v: v["secret"]["secretName"]), F.transform(env, lambda e: e["valueFrom"]["secretKeyRef"]["name"]), F.transform(env_from, lambda e: e["secretRef"]["name"]), pull),
        "refs.claims": F.transform(volumes, lambda v: v["persistentVolumeClaim"]["claimName"]),
    }
    return {k: F.array_sort(F.array_distinct(F.filter(F.coalesce(v, empty), lambda n: n.isNotNull()))) for k, v in names.items()}


_EXPRESSIONS = "array<struct<key:string,operator:string,values:array<string>>>"
_TERMS = f"array<struct<matchExpressions:{_EXPRESSIONS},matchFields:{_EXPRESSIONS}>>"


def _names(texts: Column) -> Column:
    """Distinct texts in order, null if there are none."""
    held = F.array_sort(F.array_distinct(F.filter(texts, lambda x: x.isNotNull() & (x != ""))))
    return F.when(F.size(held) > 0, held)


def selector_text(pairs: Column, expressions: Column | None = None) -> Column:
    """A label selector as text: requirements in order of their keys, * if there are none."""
    none = F.array().cast("array<struct<key:string,text:string>>")
    of = F.transform(F.map_entries(pairs), lambda e: F.struct(e["key"].alias("key"), F.concat(e["key"], F.lit("="), e["value"]).alias("text")))
    all_of = F.coalesce(of, none)
    if expressions is not None:

        def shown(x: Column) -> Column:
            values = F.concat(F.lit(" ("), F.array_join(F.array_sort(F.array_distinct(x["values"])), ","), F.lit(")"))
            return F.when(x["operator"] == "Exists", x["key"]).when(x["operator"] == "DoesNotExist", F.concat(F.lit("!"), x["key"])).otherwise(F.concat(x["key"], F.lit(" "), F.lower(x["operator"]), values))

        all_of = F.concat(all_of, F.coalesce(F.transform(expressions, lambda x: F.struct(x["key"].alias("key"), shown(x).alias("text"))), none))
    text = F.array_join(F.transform(F.array_sort(all_of), lambda x: x["text"]), ",")
    return F.when(text == "", "*").otherwise(text)


def affinity_text(terms: Column) -> Column:
    """Required node affinity: requirements of a term joined by commas, terms by ||, both distinct and in order."""

    def shown(x: Column, field: bool) -> Column:
        key = F.concat(F.lit("field:"), x["key"]) if field else x["key"]
        bare = F.concat(key, F.lit(" "), F.lower(x["operator"]))
        return F.when(x["operator"].isin("Exists", "DoesNotExist"), bare).otherwise(F.concat(bare, F.lit(" ("), F.array_join(F.array_sort(F.array_distinct(F.coalesce(x["values"], F.array().cast("array<string>")))), ","), F.lit(")")))

    none = F.array().cast("array<string>")
    each = F.transform(terms, lambda t: F.array_join(F.array_sort(F.array_distinct(F.concat(F.coalesce(F.transform(t["matchExpressions"], lambda x: shown(x, False)), none), F.coalesce(F.transform(t["matchFields"], lambda x: shown(x, True)), none)))), ","))
    return F.coalesce(F.array_join(F.array_sort(F.array_distinct(F.filter(each, lambda x: x != ""))), " || "), F.lit(""))


def _ingress(o: Column) -> list[tuple[str, Column]]:
    """Hosts, backends, paths and TLS of an ingress."""
    backend = "struct<service:struct<name:string,port:struct<name:string,number:int>>>"
    get = lambda path, t: F.try_variant_get(o, f"$.{path}", t)
    rules = F.coalesce(get("spec.rules", f"array<struct<host:string,http:struct<paths:array<struct<path:string,pathType:string,backend:{backend}>>>>>"), F.array().cast(f"array<struct<host:string,http:struct<paths:array<struct<path:string,pathType:string,backend:{backend}>>>>>"))
    target = lambda b: F.when(b["service"]["name"] != "", F.concat(b["service"]["name"], F.lit(":"), F.coalesce(F.nullif(b["service"]["port"]["name"], F.lit("")), b["service"]["port"]["number"].cast("string"), F.lit("0"))))
    text = lambda c: F.coalesce(c, F.lit(""))
    paths = lambda r: F.coalesce(r["http"]["paths"], F.array().cast(f"array<struct<path:string,pathType:string,backend:{backend}>>"))
    shown = F.flatten(F.transform(rules, lambda r: F.transform(paths(r), lambda p: F.concat(F.trim(F.concat(text(r["host"]), F.lit(" "), text(p["path"]), F.lit(" "), text(p["pathType"]))), F.lit(" -> "), text(target(p["backend"]))))))
    ends = F.concat(F.array(target(get("spec.defaultBackend", backend))), F.flatten(F.transform(rules, lambda r: F.transform(paths(r), lambda p: target(p["backend"])))))
    balancer = F.flatten(F.transform(get("status.loadBalancer.ingress", "array<struct<ip:string,hostname:string>>"), lambda i: F.array(i["ip"], i["hostname"])))
    return [("hosts", _names(F.transform(rules, lambda r: r["host"]))), ("backends", _names(ends)), ("paths", _names(shown)), ("tls", F.coalesce(F.size(get("spec.tls", "array<variant>")) > 0, F.lit(False))), ("loadBalancerIngress", _names(balancer))]


def routes(objects: DataFrame, resources: DataFrame) -> DataFrame:
    """``from_uid, type, to_uid, attrs``: ingresses to the services of their backends, with the ports."""
    o = F.col("o")
    parsed = objects.where(F.col("kind") == "networking.k8s.io/Ingress").withColumn("o", F.try_parse_json("object")).where(F.col("o").isNotNull())
    ends = F.from_json(F.element_at(_map(_ingress(o)), "backends"), "array<string>")
    each = parsed.select(F.try_variant_get(o, "$.metadata.uid", "string").alias("from_uid"), F.coalesce(F.try_variant_get(o, "$.metadata.namespace", "string"), F.lit("")).alias("ns"), F.explode(ends).alias("b"))
    each = each.select("from_uid", "ns", F.substring_index("b", ":", 1).alias("n"), F.substring_index("b", ":", -1).alias("port")).groupBy("from_uid", "ns", "n").agg(F.array_sort(F.collect_set("port")).alias("ports"))
    services = resources.where(F.col("kind") == "Service").select(F.col("uid").alias("to_uid"), F.coalesce("namespace", F.lit("")).alias("ns"), F.col("name").alias("n"))
    return each.join(services, ["ns", "n"]).select("from_uid", F.lit("routes").alias("type"), "to_uid", F.to_json(F.struct("ports")).alias("attrs"))


# fixed values: limitations of a volume's placement
PINNED = "volume is node-local (nodeAffinity): the coordinator is pinned to its node"
ZONAL = "volume is zonal (nodeAffinity): the coordinator can only be rescheduled within its zone"
RWO = "ReadWriteOnce without ReadWriteOncePod: single writer relies on the spool file lock"
RWX = "ReadWriteMany is not supported for the coordinator spool"
NO_MODE = "no access mode reported"


def placement(volumes: DataFrame) -> DataFrame:
    """``name, node_affinity, pinned_nodes, zonal, limitations`` of volumes (``object`` JSON text)."""
    o = F.col("o")
    parsed = volumes.withColumn("o", F.try_parse_json("object")).where(F.col("o").isNotNull())
    none = F.array().cast(_EXPRESSIONS)
    terms = F.coalesce(F.try_variant_get(o, "$.spec.nodeAffinity.required.nodeSelectorTerms", _TERMS), F.array().cast(_TERMS))
    held = lambda part: F.filter(F.flatten(F.transform(terms, lambda t: F.coalesce(t[part], none))), lambda x: x["operator"] == "In")
    by_label, by_field = held("matchExpressions"), held("matchFields")
    nodes = F.flatten(F.concat(F.transform(F.filter(by_label, lambda x: x["key"] == "kubernetes.io/hostname"), lambda x: x["values"]), F.transform(F.filter(by_field, lambda x: x["key"] == "metadata.name"), lambda x: x["values"])))
    pinned = F.array_sort(F.array_distinct(nodes))
    zonal = F.exists(by_label, lambda x: x["key"].endswith("/zone"))
    modes = F.coalesce(F.try_variant_get(o, "$.spec.accessModes", "array<string>"), F.array().cast("array<string>"))
    has = lambda m: F.array_contains(modes, m)
    access = F.when(has("ReadWriteMany"), RWX).when(has("ReadWriteOncePod"), None).when(has("ReadWriteOnce"), RWO).when(F.size(modes) == 0, NO_MODE)
    where = F.when(F.size(pinned) > 0, PINNED).when(zonal, ZONAL)
    limits = F.array_sort(F.filter(F.array(where, access), lambda x: x.isNotNull()))
    return parsed.select(F.try_variant_get(o, "$.metadata.name", "string").alias("name"), affinity_text(terms).alias("node_affinity"), pinned.alias("pinned_nodes"), zonal.alias("zonal"), limits.alias("limitations"))


def _fields_of(o: Column, kind: str, labels: tuple[str, ...]) -> Column:
    get = lambda path, t: F.try_variant_get(o, f"$.{path}", t)
    pairs = _simple(o, kind)
    if kind == "Node":
        taints = F.array_sort(F.array_distinct(F.transform(get("spec.taints", "array<struct<key:string,value:string,effect:string>>"), lambda t: F.concat(t["key"], F.lit("="), F.coalesce(t["value"], F.lit("")), F.lit(":"), t["effect"]))))
        address = F.get(F.filter(get("status.addresses", "array<struct<type:string,address:string>>"), lambda a: a["type"] == "InternalIP"), 0)["address"]
        pairs += [("taints", taints), ("internalIP", address)] + [(n, F.element_at(get("metadata.labels", "map<string,string>"), F.lit(f"topology.kubernetes.io/{n}"))) for n in ("zone", "region")]
    if kind == "Pod":
        ready = F.get(F.filter(get("status.conditions", "array<struct<type:string,status:string>>"), lambda c: c["type"] == "Ready"), 0)["status"]
        pairs.append(("ready", ready == "True"))
    if kind == "batch/CronJob":
        pairs.append(("active", F.size(get("status.active", "array<variant>"))))
    if kind == "networking.k8s.io/Ingress":
        pairs += _ingress(o)
    if kind == "networking.k8s.io/NetworkPolicy":
        pairs += [("podSelector", selector_text(get("spec.podSelector.matchLabels", "map<string,string>"), get("spec.podSelector.matchExpressions", _EXPRESSIONS)))]
        pairs += [(f"{w}Rules", F.coalesce(F.size(get(f"spec.{w}", "array<variant>")), F.lit(0))) for w in ("ingress", "egress")]
    if kind == "Service":
        chosen = get("spec.selector", "map<string,string>")
        balancer = F.flatten(F.transform(get("status.loadBalancer.ingress", "array<struct<ip:string,hostname:string>>"), lambda i: F.array(i["ip"], i["hostname"])))
        node_ports = F.transform(F.filter(get("spec.ports", "array<struct<name:string,nodePort:int,protocol:string>>"), lambda p: p["nodePort"] > 0), lambda p: F.concat(F.coalesce(F.concat(p["name"], F.lit(":")), F.lit("")), p["nodePort"].cast("string"), F.lit("/"), F.coalesce(p["protocol"], F.lit("TCP"))))
        pairs += [("selector", F.when(F.size(chosen) > 0, selector_text(chosen))), ("loadBalancerIngress", _names(balancer)), ("nodePorts", _names(node_ports))]
        ports = F.transform(get("spec.ports", "array<struct<name:string,port:int,protocol:string,targetPort:string>>"), lambda p: F.concat(F.coalesce(F.concat(p["name"], F.lit(":")), F.lit("")), p["port"].cast("string"), F.lit("/"), F.coalesce(p["protocol"], F.lit("TCP")), F.lit("->"), F.coalesce(p["targetPort"], p["port"].cast("string"))))
        pairs += [("ports", F.array_sort(ports)), ("hasSelector", F.coalesce(F.size(get("spec.selector", "map<string,string>")) > 0, F.lit(False)))]
    if kind == "PersistentVolume":
        pairs.append(("claim", F.concat_ws("/", get("spec.claimRef.namespace", "string"), get("spec.claimRef.name", "string"))))
        pairs.append(("nodeAffinity", F.nullif(affinity_text(get("spec.nodeAffinity.required.nodeSelectorTerms", _TERMS)), F.lit(""))))
    if kind in ("ConfigMap", "Secret"):  # names only: the values are never projected
        pairs.append(("keys", F.array_sort(F.map_keys(get("data", "map<string,variant>")))))
    if kind in POD_SPEC:
        pairs += [(k, F.when(F.size(v) > 0, v)) for k, v in references(o, POD_SPEC[kind]).items()]
        if kind != "Pod":
            pairs.append(("serviceAccountName", get(f"{POD_SPEC[kind]}.serviceAccountName", "string")))
    quote = lambda m: F.transform_values(m, lambda k, v: F.when(k.startswith("owners.") | k.isin("created", "terminating"), v).otherwise(_text(v)))
    conditions = normalize_conditions(F.coalesce(get("status.conditions", "array<struct<type:string,status:string,reason:string>>"), F.array().cast("array<struct<type:string,status:string,reason:string>>")), f"^(?:{CONDITIONS[kind]})$" if kind in CONDITIONS else r"^[A-Za-z][A-Za-z0-9-]*$")
    maps = [_map(pairs), quote(normalize_metadata(F.try_variant_get(o, "$.metadata", "variant"), labels)), quote(conditions)]
    if kind == "Node":
        for what in ("capacity", "allocatable"):
            m = F.coalesce(get(f"status.{what}", "map<string,string>"), F.create_map().cast("map<string,string>"))
            maps.append(F.map_from_entries(_scaled(m, what)))
    if kind in POD_SPEC:
        entries = [_containers(o, POD_SPEC[kind], w, s if kind == "Pod" else None) for w, s in (("containers", "status.containerStatuses"), ("initContainers", "status.initContainerStatuses"))]
        maps.append(F.map_from_entries(F.filter(F.concat(*entries), lambda e: e["v"].isNotNull())))
    return F.map_concat(*maps)


def _scaled(m: Column, what: str) -> Column:
    return F.transform(F.map_entries(m), lambda e: F.struct(F.concat(F.lit(f"{what}."), e["key"]).alias("k"), _amount(e["key"], e["value"]).alias("v")))


def normalize(objects: DataFrame, *, labels: tuple[str, ...] = ("app", "app.kubernetes.io/*", "k8s-app")) -> DataFrame:
    """``uid, kind, namespace, name, fields`` of objects (``kind, object`` JSON text).

    Kinds are named with their group but without a version.  Objects of other
    kinds, without uid, or that are no JSON are left out.

    Objects are written by kind first, so that each kind is read once, by the
    plan of its own fields, and only kinds that occur get one.
    """
    o = F.col("o")
    ws = Workspace(objects.sparkSession)
    written = ws.write(objects.where(F.col("kind").isin(*FIELDS)).select("object", "kind"), "objects", ("kind",))
    present = sorted(r["kind"] for r in written.select("kind").distinct().collect())  # at most one row for each kind of the table
    parsed = written.withColumn("o", F.try_parse_json("object")).where(F.col("o").isNotNull())
    get = lambda path: F.try_variant_get(o, f"$.metadata.{path}", "string")
    each = [parsed.where(F.col("kind") == kind).select(get("uid").alias("uid"), "kind", get("namespace").alias("namespace"), get("name").alias("name"), _fields_of(o, kind, labels).alias("fields")) for kind in present or ["Namespace"]]
    return reduce(DataFrame.unionByName, each).where(F.col("uid").isNotNull())


def object_edges(objects: DataFrame, resources: DataFrame) -> DataFrame:
    """``from_uid, type, to_uid, attrs`` between objects: owners, nodes, claims, volumes, scale targets, secrets.

    Every edge is an equi-join on uid or on (namespace, kind, name); an edge
    exists only while both ends are in ``resources``.
    """
    o = F.col("o")
    parsed = objects.withColumn("o", F.try_parse_json("object")).where(F.col("o").isNotNull())
    get = lambda path, t="string": F.try_variant_get(o, f"$.{path}", t)
    uid, ns = get("metadata.uid"), F.coalesce(get("metadata.namespace"), F.lit(""))
    ends = resources.select(F.col("uid").alias("end_uid"), F.coalesce("namespace", F.lit("")).alias("ns"), F.col("kind").alias("k"), F.col("name").alias("n"))
    here = resources.select("uid")
    owners = parsed.select(uid.alias("to_uid"), F.explode(get("metadata.ownerReferences", "array<struct<uid:string,controller:boolean>>")).alias("w")).select(F.col("w.uid").alias("from_uid"), F.lit("owns").alias("type"), "to_uid", F.to_json(F.struct(F.coalesce("w.controller", F.lit(False)).alias("controller"))).alias("attrs"))

    def named(kinds: tuple[str, ...], target: Column, names: Column, scope: Column, edge: str) -> DataFrame:
        refs = parsed.where(F.col("kind").isin(*kinds)).select(uid.alias("from_uid"), scope.alias("ns"), target.alias("k"), F.explode(names).alias("n")).where(F.col("n").isNotNull())
        return refs.distinct().join(ends, ["ns", "k", "n"]).select("from_uid", F.lit(edge).alias("type"), F.col("end_uid").alias("to_uid"), F.lit(None).cast("string").alias("attrs"))

    cluster = F.lit("")
    scaled = F.when(get("spec.scaleTargetRef.apiVersion").contains("/"), F.concat_ws("/", F.substring_index(get("spec.scaleTargetRef.apiVersion"), "/", 1), get("spec.scaleTargetRef.kind"))).otherwise(get("spec.scaleTargetRef.kind"))
    found = [
        owners,
        named(("Pod",), F.lit("Node"), F.array(get("spec.nodeName")), cluster, "runs-on"),
        named(("Pod",), F.lit("PersistentVolumeClaim"), references(o, "spec")["refs.claims"], ns, "mounts"),
        named(("PersistentVolumeClaim",), F.lit("PersistentVolume"), F.array(get("spec.volumeName")), cluster, "binds"),
        named(("autoscaling/HorizontalPodAutoscaler",), scaled, F.array(get("spec.scaleTargetRef.name")), ns, "scales"),
        *[named((kind,), F.lit("Secret"), references(o, spec)["refs.secrets"], ns, "uses-secret") for kind, spec in POD_SPEC.items()],
    ]
    both = reduce(DataFrame.unionByName, found)
    return both.join(here.withColumnRenamed("uid", "from_uid"), "from_uid", "left_semi").join(here.withColumnRenamed("uid", "to_uid"), "to_uid", "left_semi").select("from_uid", "type", "to_uid", "attrs").distinct()
