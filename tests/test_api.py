"""The query surface: scopes, limits, redaction."""

import pytest
from pyspark.sql import functions as F

from tidewell.api import Engine, Limits, Scope
from tidewell.functions.redact import MASK, expand_template, redact_json, redact_object, redact_labels, redact_text, truncate_utf8


@pytest.fixture(scope="module")
def tables(spark):
    lines = spark.createDataFrame([({"namespace": ns, "pod": f"{ns}-{i}"}, i * 10**9, f"password=hunter{i} line", i) for ns in ("shop", "bank") for i in range(4)], "labels map<string,string>, ts_ns long, line string, seq long")
    samples = spark.createDataFrame([({"__name__": "up", "namespace": ns, "pod": f"{ns}-{i}"}, 1000, float(i), False) for ns in ("shop", "bank") for i in range(4)], "labels map<string,string>, ts_ms long, value double, is_stale boolean")
    resources = spark.createDataFrame([("p1", "Pod", "shop", "a", {"nodeName": '"n1"'}), ("p2", "Pod", "bank", "b", {"nodeName": '"n2"'}), ("n1", "Node", None, "n1", {}), ("n2", "Node", None, "n2", {})], "uid string, kind string, namespace string, name string, fields map<string,string>")
    edges = spark.createDataFrame([("p1", "runs-on", "n1", None), ("p2", "runs-on", "n1", None), ("p2", "runs-on", "n2", None)], "from_uid string, type string, to_uid string, attrs string")
    return {"lines": lines, "samples": samples, "resources": resources, "edges": edges}


def test_scope_narrows(tables):
    e = Engine(**tables, scope=Scope(namespaces=("shop",)))
    assert {r.labels["namespace"] for r in e.promql("up", 1000).collect()} == {"shop"}
    assert e.promql('up{namespace="bank"}', 1000).count() == 0
    got = e.logql('{pod=~".+"}', 0, 10**10, max_lines=2).collect()
    assert [r.line for r in got] == [f"password={MASK} line"] * 2 and [r.ts_ns for r in got] == [3 * 10**9, 2 * 10**9]
    assert {r.uid for r in e.state_query().collect()} == {"p1"}
    assert {r.uid for r in Engine(**tables, scope=Scope(nodes=("n1",))).state_query().collect()} == {"p1", "n1"}
    assert len(Scope(namespaces=("a", "b")).matchers()) == 1 and Scope().matchers() == []


def test_graph_and_objects(spark, tables):
    e = Engine(**tables)
    assert {(r.uid, r.depth) for r in e.graph_query("p1", depth=2).collect()} == {("p1", 0), ("n1", 1), ("p2", 2)}
    seen = Engine(**tables, scope=Scope(namespaces=("shop",), nodes=("n1",)))
    assert {r.uid for r in seen.graph_query("p1", depth=3).collect()} == {"p1", "n1"}
    objects = spark.createDataFrame([("p1", '{"env":{"DB_PASSWORD":"x","url":"http://u:pw@h/"},"n":[1]}')], "uid string, object string")
    assert e.object_get(objects, "p1").first().object == f'{{"env":{{"DB_PASSWORD":"{MASK}","url":"http://u:{MASK}@h/"}},"n":[1]}}'
    assert seen.object_get(objects, "p2").count() == 0


def test_limits(tables):
    e = Engine(**tables)
    assert e.promql("up", 1000, max_series=3).count() == 3 and e.promql("up", 1000, max_samples=2).count() == 2
    with pytest.raises(ValueError, match="negative"):
        Limits().clamp(max_lines=-1)
    assert Limits().clamp(max_lines=0, max_bytes=10**9) == Limits()
    with pytest.raises(ValueError, match="exceed"):
        e.promql("up", 0, 10**9, 1)
    assert [r.metric for r in e.missing_inputs("up > 1 and nothing", 1000).collect()] == ["nothing"]
    assert e.logql('sum by (namespace) (count_over_time({pod=~".+"} [10s]))', 5 * 10**9).count() == 2


def test_texts(spark):
    row = spark.createDataFrame([("Authorization: Bearer abcdefgh.ijk token: \"q w\" ok", {"api_key": "1", "x": "token=abc"}, "héé€")], "t string, m map<string,string>, u string")
    r = row.select(redact_text(F.col("t")).alias("t"), redact_labels(F.col("m")).alias("m"), *[truncate_utf8(F.col("u"), n).alias(f"u{n}") for n in (1, 2, 3, 7, 8)], expand_template("{{ $labels.x }} is {{$value}}!", F.col("m"), F.lit(2.5)).alias("e"), redact_json(F.lit("token=zzz")).alias("j")).first()
    assert r.t == f"Authorization: {MASK}" and r.m == {"api_key": MASK, "x": f"token={MASK}"}
    assert (r.u1, r.u2, r.u3, r.u7, r.u8) == ("h", "h", "hé", "héé", "héé€") and r.e == "token=abc is 2.5!" and r.j == f"token={MASK}"


def test_redaction(spark):
    """Own cases of every kind of secret; what only looks like one stays."""
    key = "-----BEGIN EC PRIVATE KEY-----\nq\n-----END EC PRIVATE KEY----- rest"
    want = {
        "pwd=a1 zone=b": f"pwd={MASK} zone=b", 'x={"dsn": "a b"}': f'x={{"dsn": "{MASK}"}}', "cookie: 'k v'; ok": f"cookie: '{MASK}'; ok", key: f"{MASK} rest", "-----BEGIN PRIVATE KEY----- cut": MASK,
        "Proxy-Authorization = Basic Zm9vOmJhcg==, next": f"Proxy-Authorization = {MASK}, next", "sent basic Zm9vOmJhcg==": f"sent basic {MASK}", "ASIA0123456789ABCDEF!": f"{MASK}!", "ghs_" + "a1" * 12: MASK, "xoxb-0123456789-a": MASK,
        "amqp://who:what@mq/v": f"amqp://who:{MASK}@mq/v", "tokens: 5": "tokens: 5", "sessions are basic": "sessions are basic", "http://mq:5672/v": "http://mq:5672/v", None: None, "": "",
    }
    rows = spark.createDataFrame(list(want.items()), "t string, want string")
    assert [(r.t, r.got) for r in rows.select("t", "want", redact_text(F.col("t")).alias("got")).collect() if r.got != want[r.t]] == []
    secret = '{"metadata":{"managedFields":[1],"annotations":{"a":"b"}},"data":{"k":"v"},"spec":{"env":[{"name":"N","value":"v"}],"dbPassword":"x","secretName":"s","n":1}}'
    got = spark.createDataFrame([("Secret", secret), ("Pod", secret), ("Pod", "pwd=1"), (None, None)], "kind string, o string").select(redact_object("kind", "o").alias("o")).collect()
    spec = f'"spec":{{"env":[{{"name":"N","value":"{MASK}"}}],"dbPassword":"{MASK}","secretName":"s","n":1}}'
    assert got[0].o == f'{{"metadata":{{"annotations":{{"a":"{MASK}"}}}},"data":{{"k":"{MASK}"}},{spec}}}'
    assert got[1].o == f'{{"metadata":{{"annotations":{{"a":"b"}}}},"data":{{"k":"v"}},{spec}}}' and got[2].o == f"pwd={MASK}" and got[3].o is None
