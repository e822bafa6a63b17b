"""Kubernetes objects to fields and edges."""

import json

from tidewell.operators.kube import kube_series
from tidewell.operators.normalize import normalize, object_edges

POD = {
    "metadata": {"uid": "u1", "name": "p", "namespace": "shop", "creationTimestamp": "2026-09-05T00:00:00Z", "labels": {"app": "a", "x": "y"}, "ownerReferences": [{"uid": "r1", "kind": "ReplicaSet", "name": "rs", "controller": True}]},
    "spec": {"nodeName": "n1", "hostNetwork": True, "volumes": [{"name": "d", "persistentVolumeClaim": {"claimName": "c1"}}, {"name": "s", "secret": {"secretName": "sec"}}], "containers": [{"name": "c", "image": "img", "resources": {"requests": {"cpu": "100m", "memory": "1Ki"}}, "ports": [{"containerPort": 80, "name": "web"}], "env": [{"name": "E", "valueFrom": {"configMapKeyRef": {"name": "cm", "key": "k"}}}], "envFrom": [{"secretRef": {"name": "sec2"}}]}]},
    "status": {"phase": "Running", "conditions": [{"type": "Ready", "status": "True"}, {"type": "Odd", "status": "True"}], "containerStatuses": [{"name": "c", "imageID": "sha", "ready": True, "restartCount": 2, "state": {"waiting": {"reason": "Why"}}, "lastState": {"terminated": {"reason": "OOMKilled", "exitCode": 137}}}]},
}
OBJECTS = [
    ("Pod", POD), ("apps/ReplicaSet", {"metadata": {"uid": "r1", "name": "rs", "namespace": "shop"}, "spec": {}}), ("Node", {"metadata": {"uid": "n", "name": "n1", "labels": {"topology.kubernetes.io/zone": "z"}}, "spec": {"taints": [{"key": "b", "effect": "NoSchedule"}, {"key": "a", "value": "1", "effect": "X"}]}, "status": {"capacity": {"cpu": "4", "memory": "1Gi"}, "addresses": [{"type": "InternalIP", "address": "1.1.1.1"}], "nodeInfo": {"kernelVersion": "6"}}}),
    ("PersistentVolumeClaim", {"metadata": {"uid": "c", "name": "c1", "namespace": "shop"}, "spec": {"volumeName": "v1", "accessModes": ["b", "a"]}}), ("PersistentVolume", {"metadata": {"uid": "v", "name": "v1"}, "spec": {"claimRef": {"namespace": "shop", "name": "c1"}}}),
    ("Secret", {"metadata": {"uid": "s", "name": "sec", "namespace": "shop"}, "data": {"z": "hidden", "a": "hidden"}}), ("apps/Deployment", {"metadata": {"uid": "d", "name": "dep", "namespace": "shop"}, "spec": {}}), ("autoscaling/HorizontalPodAutoscaler", {"metadata": {"uid": "h", "name": "h", "namespace": "shop"}, "spec": {"scaleTargetRef": {"apiVersion": "apps/v1", "kind": "Deployment", "name": "dep"}}}),
    ("Service", {"metadata": {"uid": "svc", "name": "svc", "namespace": "shop"}, "spec": {"selector": {"app": "a"}, "ports": [{"port": 80, "name": "w"}]}}), ("batch/CronJob", {"metadata": {"uid": "cj", "name": "cj", "namespace": "shop"}, "spec": {"schedule": "* * * * *"}, "status": {"lastScheduleTime": "2026-09-05T00:00:00Z"}}), ("Odd", {"metadata": {"uid": "o"}}),
]


def test_normalize(spark):
    df = spark.createDataFrame([(k, json.dumps(o)) for k, o in OBJECTS] + [("Pod", "broken"), ("Pod", "{}"), ("Pod", None)], "kind string, object string")
    resources = normalize(df).cache()
    got = {r.uid: {k: json.loads(v) for k, v in r.fields.items()} for r in resources.collect()}
    assert len(got) == 10
    pod = got["u1"]
    assert pod == {
        "phase": "Running", "nodeName": "n1", "hostNetwork": True, "ready": True, "created": 1788566400000, "labels.app": "a", "owners.ReplicaSet.rs": True, "conditions.Ready.status": "True", "containers.c.image": "img", "containers.c.ports": ["web:80/TCP"], "containers.c.requests.cpu": 0.1, "containers.c.requests.memory": 1024.0, "containers.c.imageID": "sha",
        "containers.c.ready": True, "containers.c.restarts": 2, "containers.c.state": "waiting", "containers.c.waitingReason": "Why", "containers.c.lastTerminatedReason": "OOMKilled", "containers.c.lastTerminatedExitCode": 137, "refs.configMaps": ["cm"], "refs.secrets": ["sec", "sec2"], "refs.claims": ["c1"],
    }
    assert got["n"]["taints"] == ["a=1:X", "b=:NoSchedule"] and got["n"]["capacity.memory"] == 2**30 and got["n"]["zone"] == "z" and got["n"]["internalIP"] == "1.1.1.1"
    assert got["s"] == {"keys": ["a", "z"]} and got["d"]["replicas"] == 1 and got["c"]["accessModes"] == ["a", "b"] and got["v"]["claim"] == "shop/c1"
    assert got["svc"]["ports"] == ["w:80/TCP->80"] and got["svc"]["hasSelector"] is True and got["cj"]["lastScheduleTime"] == 1788566400000
    edges = {(r.from_uid, r.type, r.to_uid) for r in object_edges(df, resources).collect()}
    assert edges == {("r1", "owns", "u1"), ("u1", "runs-on", "n"), ("u1", "mounts", "c"), ("c", "binds", "v"), ("h", "scales", "d"), ("u1", "uses-secret", "s")}
    assert kube_series(resources).where("name = 'kube_pod_container_status_restarts_total' and value = 2").count() == 1
