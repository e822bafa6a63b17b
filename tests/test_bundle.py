"""Rule bundles and their evaluation."""

import pytest
from pyspark.sql import functions as F

from tidewell.plans import bundle

yaml = pytest.importorskip("yaml")
MANIFEST = """
rules:
- {id: s, class: state, severity: high, dedup_key: "kind,name", required_fields: [phase]}
- {id: p, class: promql}
- {id: p2, class: promql}
- {id: l, class: logql}
- {id: odd, class: magic}
- {id: bad, class: promql}
- {id: wide, class: logql}
"""
RULES = """
- {id: s, kinds: [Pod], expr: 'field(r, "phase", "") == "Pending"', for: 5m, labels: {phase: '=field(r, "phase", "")'}}
- {id: p, expr: 'up  == 0', labels: {team: x}}
- {id: p2, expr: 'up == 0'}
- {id: l, expr: 'sum by (pod) (count_over_time({app="a"} |= "err" [5m])) > 1'}
- {id: odd, expr: x}
- {id: bad, expr: '{a="b"}'}
- {id: wide, expr: 'rate({app="a"}[500ms])'}
"""


def test_bundle(spark):
    rules = bundle.load(MANIFEST, [RULES])
    states = bundle.validate(rules, frozenset({"p2"}))
    assert {k: v[0] for k, v in states.items()} == {"s": "active", "p": "active", "p2": "disabled", "l": "active", "odd": "unsupported", "bad": "rejected", "wide": "rejected"}
    assert rules[0].for_ms == 300_000 and rules[0].dedup == ("kind", "name") and rules[0].required == ("phase",)
    assert bundle.validate([bundle.Rule("k", "promql", "kube_nope > 1")], metrics=frozenset({"kube_pod_info"}))["k"][0] == "rejected"
    good = [r for r in rules if states[r.id][0] in ("active", "disabled")]
    assert len(bundle.programs(good)) == 3
    samples = spark.createDataFrame([({"__name__": "up", "job": "j"}, 1000, 0.0, False), ({"__name__": "up", "job": "k"}, 1000, 1.0, False)], "labels map<string,string>, ts_ms long, value double, is_stale boolean")
    lines = spark.createDataFrame([({"app": "a", "pod": "p"}, 10**9 - i, "err", i) for i in range(3)], "labels map<string,string>, ts_ns long, line string, seq long")
    resources = spark.createDataFrame([("u", "Pod", "n", "x", '{"phase":"Pending"}'), ("v", "Pod", "n", "y", "{}")], "uid string, kind string, namespace string, name string, fields string")
    got = {(r.rule_id, r.instance_key): (r.value, r.error) for r in bundle.observations(good, 1000, samples=samples, lines=lines, resources=resources).collect()}
    assert got[("s", "u")] == (1.0, None) and got[("s", "v")][0] is None and "phase" in got[("s", "v")][1]
    assert got[("p", '{alertname="p", job="j", team="x"}')] == (0.0, None) and got[("l", '{alertname="l", pod="p"}')][0] == 3 and len(got) == 5


def test_states_and_evidence(spark):
    df = spark.createDataFrame([(True, True), (False, True), (False, False)], "d boolean, s boolean").select(bundle.rule_state({"stale": F.col("s"), "disabled": F.col("d")}).alias("x"))
    assert [r.x for r in df.collect()] == ["disabled", "stale", "active"]
    st = spark.createDataFrame([("r", 1, "active", 0), ("r", 1, "stale", 2)], "rule_id string, version int, state string, coverage int")
    row = bundle.rollup(st).first()
    assert (row.active, row.stale, row.failed, row.worst_coverage) == (1, 1, 0, 2)
    ev = spark.createDataFrame([("r", {"pod": "p", "x": "1"}, 1, 1), ("r", {"pod": "q"}, 2, 2)], "rule_id string, labels map<string,string>, ts_ns long, seq long")
    alerts = spark.createDataFrame([("r", "a", 5, {"pod": "p"}), ("r", "b", 1, {"pod": "p", "y": "2"}), ("r", "c", 1, {"pod": "z"})], "rule_id string, instance_key string, active_ms long, labels map<string,string>")
    assert {(r.seq, r.instance_key) for r in bundle.match_evidence(ev, alerts).collect()} == {(1, "b")}
    assert bundle.counter_bytes(60 * 10**9) == 61 * 1000 * 24
