"""Kubernetes resources, warning events, metric facts, selectors and diffs."""

import json

import pytest
from pyspark.sql import functions as F

from tidewell.operators import kube, state
from tidewell.plans.metricfacts import container_facts


def test_series(spark):
    pod = {"phase": "Running", "nodeName": "n1", "podIP": "1.2.3.4", "conditions.Ready.status": "True", "containers.c.image": "img", "containers.c.imageID": "sha", "containers.c.restarts": 3, "containers.c.waitingReason": "Why", "containers.c.requests.cpu": 0.5, "containers.c.limits.memory": 1024, "owners.ReplicaSet.rs-1": True}
    rows = [("u1", "Pod", "shop", "p", json.dumps(pod)), ("u2", "Pod", "shop", "q", "{}"), ("u3", "Node", None, "n1", json.dumps({"conditions.Ready.status": "False", "capacity.cpu": 4, "unschedulable": True})), ("u4", "apps/Deployment", "shop", "d", json.dumps({"replicas": 2})), ("u5", "PersistentVolumeClaim", "shop", "v", json.dumps({"phase": "Bound", "requests.storage": "1Gi"})), ("u6", "Other", None, "o", "{}")]
    df = spark.createDataFrame(rows, "uid string, kind string, namespace string, name string, j string").withColumn("fields", state.fields_map(F.col("j"))).drop("j")
    got = {}
    for r in kube.kube_series(df).collect():
        got.setdefault(r.name, []).append((r.labels, r.value))
    (info,) = [x for x in got["kube_pod_info"] if x[0]["pod"] == "p"]
    assert info[0] == {"namespace": "shop", "pod": "p", "uid": "u1", "pod_ip": "1.2.3.4", "node": "n1", "created_by_kind": "ReplicaSet", "created_by_name": "rs-1", "host_network": "false"}
    assert sum(v for _, v in got["kube_pod_status_phase"]) == 1 and len(got["kube_pod_status_phase"]) == 5
    assert {x["condition"]: v for x, v in got["kube_pod_status_ready"]} == {"true": 1, "false": 0, "unknown": 0}
    assert got["kube_pod_container_info"][0][0]["image_id"] == "sha" and got["kube_pod_container_status_restarts_total"][0][1] == 3
    assert got["kube_pod_container_status_waiting_reason"][0][0]["reason"] == "Why"
    assert got["kube_pod_container_resource_requests"][0] == ({"namespace": "shop", "pod": "p", "uid": "u1", "node": "n1", "container": "c", "resource": "cpu", "unit": "core"}, 0.5)
    assert {(x["pod"], x["owner_kind"]) for x, _ in got["kube_pod_owner"]} == {("p", "ReplicaSet"), ("q", "<none>")}
    assert {x["status"]: v for x, v in got["kube_node_status_condition"]} == {"true": 0, "false": 1, "unknown": 0} and got["kube_node_spec_unschedulable"][0][1] == 1
    assert got["kube_node_status_capacity"][0] == ({"node": "n1", "resource": "cpu", "unit": "core"}, 4)
    assert got["kube_deployment_spec_replicas"] == [({"namespace": "shop", "deployment": "d"}, 2)] and "kube_deployment_status_replicas_available" not in got
    assert got["kube_persistentvolumeclaim_resource_requests_storage_bytes"][0][1] == 2**30
    here = kube.node_series(kube.kube_series(df), "n1")
    assert {r.labels.get("pod") for r in here.where("name like 'kube_pod%'").collect()} == {"p"} and here.where("name = 'kube_node_info'").count() == 1


def test_quantities(spark):
    df = spark.createDataFrame([("100m",), ("1Ki",), ("2",), ("1.5G",), ("x",), ("1e3",)], "q string").select(kube.quantity(F.col("q")).alias("v"))
    assert [r.v for r in df.collect()] == [pytest.approx(0.1), 1024, 2, 1.5e9, None, 1000]


def test_warning_counts(spark):
    now = 10_000_000
    rows = [("e1", "o", "Warning", "Back off", 5, now - 1000, now - 900, 1), ("e1", "o", "Warning", "Back off", 8, now - 1000, now - 800, 2), ("e2", "o", "Warning", None, 100, now - 7_200_000, now - 1_800_000, 1), ("e3", "o", "Normal", "x", 5, now, now, 1), ("e4", "o", "Warning", "old", 9, 0, 100, 1)]
    rows += [(f"m{i}", "many", "Warning", f"r{i:02d}", 20 - i, now - 10, now - 5, 1) for i in range(20)]
    df = spark.createDataFrame(rows, "event_uid string, object_uid string, type string, reason string, count long, first_ms long, last_ms long, version long")
    got = {(r.object_uid, r.reason): r.n for r in kube.warning_counts(df, now).collect()}
    assert got["o", "Back_off"] == 8 and got["o", "Unknown"] == 33 and ("o", "old") not in got
    assert got["many", "_other"] == 4 + 3 + 2 + 1 and len([k for k in got if k[0] == "many"]) == 17


def test_normalize(spark):
    meta = {"creationTimestamp": "2026-09-05T00:00:00Z", "deletionTimestamp": "x", "labels": {"app": "a", "team/x": "t", "no": "z"}, "ownerReferences": [{"kind": "RS", "name": "r", "controller": True}]}
    df = spark.createDataFrame([(json.dumps(meta),), ("{}",)], "j string").select(kube.normalize_metadata(F.parse_json("j"), ("app", "team/*")).alias("m"))
    a, b = [r.m for r in df.collect()]
    assert a == {"created": "1788566400000", "terminating": "true", "labels.app": "a", "labels.team/x": "t", "owners.RS.r": "true"} and b == {}
    c = spark.createDataFrame([([("Ready", "True", None), ("bad type", "x", "y")],)], "c array<struct<type:string,status:string,reason:string>>").select(kube.normalize_conditions(F.col("c")).alias("m")).first().m
    assert c == {"conditions.Ready.status": "True"}


def test_facts(spark):
    rows, t0 = [], 1_700_000_000_000
    for i in range(41):
        base = {"namespace": "n", "pod": "p", "container": "c", "node": "x"}
        for name, v, more in (("container_cpu_usage_seconds_total", i * 15.0, {}), ("container_memory_working_set_bytes", 1000.0 + i, {}), ("kube_pod_container_resource_limits", 0.52, {"resource": "cpu"}), ("kube_pod_container_resource_limits", 2000.0, {"resource": "memory"}), ("kube_pod_container_status_restarts_total", float(i > 20), {})):
            rows.append(({"__name__": name, **base, **more}, t0 + i * 30_000, v, False))
    df = spark.createDataFrame(rows, "labels map<string,string>, ts_ms long, value double, is_stale boolean")
    (got,) = container_facts(df, t0 + 1_200_000, 900).collect()
    assert got.facts["cpu_p95"] == 0.5 and got.facts["memory_p50"] == pytest.approx(1026, abs=1) and got.facts["restarts"] == 1 and got.facts["restarts_per_hour"] == 4
    assert got.facts["cpu_p95_of_limit"] == 0.9615 and got.facts["cpu_saturated"] == 1 and got.facts["memory_saturated"] == 0


def test_state_algebra(spark):
    schema = "uid string, kind string, namespace string, name string, fields map<string,string>"
    old = spark.createDataFrame([("a", "K", None, "n", {"x": "1", "y": "2"}), ("b", "K", None, "n", {}), ("c", "K", None, "n", {"z": "0"})], schema)
    new = spark.createDataFrame([("a", "K", None, "n", {"x": "1", "y": "3", "w": "4"}), ("c", "K", None, "n", {"z": "0"}), ("d", "K", "s", "n", None)], schema)
    got = {r.uid: (r.op, r.fields) for r in state.diff_resources(old, new).collect()}
    assert got == {"a": (2, {"y": "3", "w": "4"}), "b": (3, None), "d": (1, None)}
    e = "from_uid string, type string, to_uid string, attrs string"
    edges = state.diff_edges(spark.createDataFrame([("a", "t", "b", "1"), ("a", "t", "c", "1")], e), spark.createDataFrame([("a", "t", "b", "2"), ("a", "u", "c", None)], e))
    assert {(r.type, r.to_uid): r.op for r in edges.collect()} == {("t", "b"): 6, ("t", "c"): 5, ("u", "c"): 4}
    owners = spark.createDataFrame([("s1", "ns", {"app": "a", "tier": "x"}, None), ("s2", "ns", {}, [("app", "In", ["a", "b"])]), ("s3", "ns", {"app": "a"}, [("tier", "NotIn", ["x"]), ("z", "DoesNotExist", [])]), ("s4", "ns", {}, None)], "uid string, namespace string, selector map<string,string>, expressions array<struct<key:string,operator:string,values:array<string>>>")
    pods = spark.createDataFrame([("p1", "ns", {"app": "a", "tier": "x"}), ("p2", "ns", {"app": "a"}), ("p3", "other", {"app": "a"}), ("p4", "ns", None)], "uid string, namespace string, labels map<string,string>")
    assert {(r.from_uid, r.to_uid) for r in state.selector_edges(owners, pods, "selects").collect()} == {("s1", "p1"), ("s2", "p1"), ("s2", "p2"), ("s3", "p2")}
    walk = spark.createDataFrame([("e", "a", "t", "b"), ("e", "b", "t", "c"), ("e", "c", "u", "d"), ("e", "c", "t", "a")], "epoch string, from_uid string, type string, to_uid string")
    got = {(r.uid, r.depth) for r in state.graph_walk(walk, spark.createDataFrame([("e", "a")], "epoch string, uid string"), depth=2, direction="out").collect()}
    assert got == {("a", 0), ("b", 1), ("c", 2)}
    points = spark.createDataFrame([("e", i) for i in range(10)], "epoch string, seq long")
    spans = spark.createDataFrame([("e", 2, 4), ("e", 3, 6)], "epoch string, a long, b long")
    assert sorted(r.seq for r in state.in_spans(points, spans, "epoch", "seq", "a", "b").collect()) == [2, 3, 4, 5, 6]
