"""Runs of records, joins with the graph, limits: dirty rows, ties, empty tables, clashing columns."""

import hashlib

import pytest
from pyspark.sql import functions as F

from tidewell.operators import history, joins, limits
from tidewell.operators.normalize import affinity_text, normalize, placement, routes, selector_text
from tidewell.plans import cel, promql_syntax
from tidewell.sources.discovery import kubelet_targets, pod_targets

OPS = "epoch string, seq long, idx int, op tinyint, uid string, kind string, namespace string, name string, fields string, removed array<string>, edge_type string, to_uid string, attrs string, prev_attrs string, scope_key string, scope struct<state:tinyint,reason:string,since_ms:bigint>, v string"


def op(seq, code, uid=None, fields=None, edge=None, to=None, attrs=None, prev=None, key=None, state=None, epoch="e", idx=0):
    return (epoch, seq, idx, code, uid, "K", None, "n", fields, None, edge, to, attrs, prev, key, (state, "", 1) if state else None, "clash")


@pytest.fixture(scope="module")
def ops(spark):
    rows = [
        op(1, 1, "a", '{"x":1,"y":2}'), op(2, 2, "a", '{"x":null,"z":3}'), op(3, 1, "b", "{}"), op(4, 3, "b"), op(5, 2, "b", "{}"), op(6, 1, "a", "{}"), op(7, 3, "c"),
        op(1, 4, "a", edge="owns", to="b", attrs='{"k": 1}', idx=1), op(2, 4, "a", edge="owns", to="b", attrs="{}", idx=1), op(3, 5, "a", edge="owns", to="b", idx=1), op(4, 5, "a", edge="owns", to="b", idx=1),
        op(5, 6, "a", edge="owns", to="c", attrs='{"k":1.0}', prev='{"k": 1}', idx=1), op(6, 6, "a", edge="owns", to="d", attrs='{"k":2}', prev='{"k": 1}', idx=1), op(7, 5, "a", edge="owns", to="f", attrs='{"k":3}', idx=1),
        op(8, 7, key="s", state=1), op(9, 7, key="s", state=2), op(None, 1, "q", "{}"), op(1, 1, None, "{}", idx=7), (None, 1, 0, 1, "n", *[None] * 11, "clash"),
    ]
    return spark.createDataFrame([*rows, rows[1], rows[5]], OPS).cache()


def test_fold(ops):
    wrong = {(x.seq, x.reason) for x in history.fold_errors(ops).where("epoch = 'e'").collect()}
    assert wrong == {(5, "after delete of the resource"), (6, "create of an existing resource"), (2, "add of an existing edge"), (4, "remove or replace of an absent edge")}
    edges = {(x.op, x.to_uid, x.attrs, x.prev_attrs) for x in history.fold_edges(ops).collect()}
    assert edges == {(6, "d", '{"k":2}', '{"k": 1}'), (5, "f", '{"k":3}', None)}  # added and removed again: nothing; equal values: nothing
    assert [(x.scope_key, x.state) for x in history.fold_scopes(ops).collect()] == [("s", 2)]
    none = ops.where("false")
    assert all(x.count() == 0 for x in history.fold_run(none))
    places = [x.op for x in history.canonical_order(history.once(ops.where("epoch = 'e' and seq = 1")), ("epoch", "seq")).orderBy("position").collect()]
    assert places == sorted(places) and len(places) == 3


def test_reconstruct(spark, ops):
    feed = ops.where("seq <= 2 and op <= 2").unionByName(ops.where("seq = 7 and op = 3"))
    base = spark.createDataFrame([("e", "c", "f", "1"), ("e", "d", "g", "2"), ("x", "k", "g", "2")], "epoch string, uid string, field string, value string")
    at = lambda n: spark.createDataFrame([("e", n)], "epoch string, seq long")
    start = spark.createDataFrame([("e", 0)], "epoch string, from_seq long")
    rows = lambda n, spans=None: {(x.uid, x.field) for x in history.reconstruct(feed, base, start, at(n), spans).collect()}
    assert rows(0) == {("c", "f"), ("d", "g")}
    assert rows(1) == {("a", "x"), ("a", "y"), ("c", "f"), ("d", "g")}
    assert rows(7) == {("a", "y"), ("a", "z"), ("d", "g")}
    lost = spark.createDataFrame([("e", 3, 6), ("e", 5, 5)], "epoch string, from_seq long, to_seq long")
    assert rows(4, lost) == set() and rows(7, lost) == rows(7)


def test_chains_and_digests(spark):
    df = spark.createDataFrame([("a", 2, "y"), ("a", 1, "x"), ("b", 9, None)], "epoch string, seq long, hash string")
    got = {(x.epoch, x.seq): x.chain for x in history.chain_hashes(df, genesis="g").collect()}
    first = hashlib.sha256(b"gx").hexdigest()
    assert got == {("a", 1): first, ("a", 2): hashlib.sha256((first + "y").encode()).hexdigest(), ("b", 9): hashlib.sha256(b"g").hexdigest()}
    sets = spark.createDataFrame([(1, "p"), (1, "q"), (2, "q"), (2, "p"), (2, "p"), (3, "p"), (4, None)], "k int, h string")
    d = {x.k: (x.n, x.digest) for x in history.content_digest(sets, ("k",), F.coalesce("h", F.lit(""))).collect()}
    assert d[1] == d[2] != d[3] and d[4][0] == 1
    breaks = spark.createDataFrame([("a", 1, 0), ("a", 2, 1), ("a", 2, 1), ("a", 5, 3)], "epoch string, seq long, parent long")
    assert [(x.seq, x.parent, x.before) for x in history.run_breaks(breaks).collect()] == [(5, 3, 2)]


def test_ingest(spark):
    items = spark.createDataFrame([("n", "q", 1, "a"), ("n", "q", 2, "b"), ("n", "q", 2, "b"), ("m", "q", 1, None), (None, "q", 4, "x")], "node string, queue string, seq long, v string")
    cursors = spark.createDataFrame([("n", "q", 1)], "node string, queue string, cursor long")
    fresh, after = history.admit_items(items, cursors)
    assert {(x.node, x.seq) for x in fresh.collect()} == {("n", 2), ("m", 1)}
    again, same = history.admit_items(items, after)
    assert again.count() == 0 and {tuple(x) for x in same.collect()} == {tuple(x) for x in after.collect()} == {("n", "q", 2), ("m", "q", 1)}
    records = spark.createDataFrame([("e", i, f"h{i}", 10) for i in range(1, 6)] + [("f", 1, "h", 10)], "epoch string, seq long, hash string, bytes long")
    done = spark.createDataFrame([("e", 3, "h3"), ("f", 1, "other")], "epoch string, seq long, hash string")
    assert {(x.epoch, x.seq) for x in history.forget(records, done).collect()} == {("e", 4), ("e", 5), ("f", 1)}
    assert [tuple(x) for x in history.coalesce_oldest(records, 20).collect()] == [("e", 1, 3, 3, 30)]
    assert {x.epoch: x.rate for x in history.write_rate(records, 0.5).collect()} == {"e": 10.0, "f": 10.0}


def test_facts(spark):
    pods = spark.createDataFrame([("u1", "a", "p", "n1", ["c"]), ("u2", "a", "p", "n2", []), ("u3", "a", "q", "n1", None), ("u4", "a", "q", "n1", None)], "uid string, namespace string, name string, node string, claims array<string>")
    claims = spark.createDataFrame([("v1", "a", "c"), ("v2", "a", "d")], "uid string, namespace string, name string")
    nodes = spark.createDataFrame([("m1", "n1")], "uid string, name string")
    facts = [("n1", "a", "p", None, None, "x"), ("n1", "a", "q", None, None, "x"), ("n1", "a", "q", "u3", None, None), ("n1", "a", "p", "u2", None, None), ("n1", "a", None, None, "c", None), ("n1", "a", None, None, "d", None), ("n1", None, None, None, None, None), ("n9", None, None, None, None, None)]
    df = spark.createDataFrame([(*f, i) for i, f in enumerate(facts)], "node string, namespace string, pod string, uid string, claim string, container string, i int")
    got = {x.i: (x.target_uid, x.prefix, x.placed) for x in joins.place_facts(df, pods, claims, nodes).collect()}
    assert got == {0: ("u1", "containers.x.", True), 1: (None, "containers.x.", False), 2: ("u3", "", True), 3: (None, "", False), 4: ("v1", "", True), 5: (None, "", False), 6: ("m1", "", True), 7: (None, "", False)}
    assert joins.place_facts(df.where("false"), pods, claims, nodes).count() == 0


def test_instances_and_series(spark):
    samples = [({"__name__": "m", "pod": "a", "zone": "1"}, 90, 1.0, False), ({"__name__": "m", "pod": "b", "zone": "1"}, 90, 1.0, False), ({"__name__": "m", "pod": "b", "zone": "1"}, 95, None, True), ({"__name__": "m", "pod": "c"}, 10, 1.0, False), ({"__name__": "other", "pod": "d"}, 90, 1.0, False)]
    s = spark.createDataFrame(samples, "labels map<string,string>, ts_ms long, value double, is_stale boolean")
    seen = spark.createDataFrame([(k, {"pod": k, "severity": "x"}) for k in "abcd"] + [("z", {"zone": "1"}), ("bare", {})], "instance_key string, labels map<string,string>")
    assert {x.instance_key for x in joins.gone_instances(seen, s, ("m",), 100, lookback_ms=50, own_labels=("severity",)).collect()} == {"b", "c", "d"}
    store = spark.createDataFrame([("s", {"a": "1"}, 5, 1.0, False), ("s", {"a": "2"}, 5, 1.0, False), ("t", {"a": "1"}, 5, 1.0, False), ("s", {"a": "3"}, 1, 1.0, False)], "source string, labels map<string,string>, ts_ms long, value double, is_stale boolean")
    sent = spark.createDataFrame([({"a": "1"}, 5, 9.0, False), ({"a": "1"}, 6, 2.0, False)], "labels map<string,string>, ts_ms long, value double, is_stale boolean")
    rows = {(x.source, x.labels["a"], x.ts_ms, x.is_stale) for x in joins.replace_series(store, sent, "s", 10, 6).collect()}
    assert rows == {("s", "1", 5, False), ("s", "1", 6, False), ("s", "2", 5, False), ("s", "2", 10, True), ("t", "1", 5, False), ("s", "3", 10, True)}


def test_walks_and_images(spark):
    res = spark.createDataFrame([("d", "Deployment"), ("r", "ReplicaSet"), ("p", "Pod"), ("p2", "Pod"), ("c", "PersistentVolumeClaim"), ("n", "Node")], "uid string, kind string")
    edges = spark.createDataFrame([("d", "owns", "r"), ("r", "owns", "p"), ("r", "owns", "d"), ("p", "mounts", "c"), ("p2", "mounts", "c"), ("p", "runs-on", "n"), ("p", "owns", "gone"), (None, "owns", "p")], "from_uid string, type string, to_uid string")
    got = {(x.start, x.pod_uid) for x in joins.pods_of(res.select("uid"), res, edges).collect()}
    assert got == {("d", "p"), ("r", "p"), ("c", "p"), ("c", "p2")}
    digest = "sha256:" + "a" * 64
    pods = spark.createDataFrame([({"nodeName": "n", "containers.x.imageID": f"r/i@{digest}", "containers.y.image": digest},), ({"nodeName": "m", "initContainers.x.imageID": "none"},), (None,)], "fields map<string,string>")
    assert [tuple(x) for x in joins.image_nodes(pods).collect()] == [(digest, "n")]
    answers = spark.createDataFrame([("d", "a", "pending", None), ("d", "b", "ready", True), ("d", "c", "ready", False), ("e", "a", "unavailable", None)], "digest string, node string, status string, truncated boolean")
    assert {(x.digest, x.node) for x in joins.best_answer(answers).collect()} == {("d", "c"), ("e", "a")}


def test_limits(spark):
    s = spark.createDataFrame([({"a": str(i)}, t, 1.0, "clash") for i in range(4) for t in range(i + 1)], "labels map<string,string>, ts long, value double, w string")
    for bound, want, told in ((dict(max_series=2), 3, ("series", 2)), (dict(max_samples=5), 3, ("samples", 2)), (dict(max_bytes=18), 1, ("bytes", 3)), ({}, 10, None)):
        kept, left = limits.bound_series_told(s, "ts", **{"max_series": 9, "max_samples": 99, "max_bytes": 9999} | bound)
        assert kept.count() == want and [tuple(x) for x in left.collect()] == ([told] if told else []), bound
    items = spark.range(5).select("id")
    assert [(x.id, x.limited) for x in limits.bound_items(items, [F.col("id")], max_items=2, max_bytes=99).collect()] == [(0, True), (1, True)]
    assert {x.limited for x in limits.bound_items(items, [F.col("id")], max_items=9, max_bytes=999).collect()} == {False}
    u = spark.createDataFrame([("a", t) for t in (0, 3, 4, 9, 40, 41)] + [("b", 7), (None, 1), ("a", None)], "k string, t long")
    told = sorted((x.k, x.t, x.told_at) for x in limits.throttle(u, "k", "t", 10).collect())
    assert told == [("a", 0, 0), ("a", 9, 10), ("a", 40, 40), ("a", 41, 50), ("b", 7, 7)]
    a = spark.createDataFrame([("f", t, "x" * 4) for t in range(10)], "finding_id string, time_ms long, text string")
    assert sorted(x.time_ms for x in limits.shrink_evidence(a, 16).collect()) == [0, 1, 8, 9]
    one = limits.saved_finding(items, "q").first()
    assert limits.saved_finding(items.orderBy(F.desc("id")), "q", one.hash).first().confirmed and not limits.saved_finding(items.limit(4), "q", one.hash).first().confirmed
    both = limits.union_sources([("x", items), ("y", items.withColumn("more", F.lit(1)))])
    assert both.count() == 10 and both.where("source = 'x' and more is null and source_rank = 0").count() == 5
    addr = spark.createDataFrame([("h", "eth0", "b", False), ("h", "eth0", "a", None), ("h", "eth0", "t", True), ("h", "lo", "l", False), ("h", "eth1", None, False)], "host string, interface string, address string, temporary boolean")
    assert [(x.interface, x.addresses) for x in limits.permanent_addresses(addr).collect()] == [("eth0", ["a", "b"])]
    firing = spark.createDataFrame([("r1", "i", "firing", False), ("r2", "i", "firing", None), ("r2", "j", "pending", None), ("r3", "i", "firing", False)], "rule_id string, instance_key string, phase string, stale boolean")
    rules = lambda rows: spark.createDataFrame(rows, "rule_id string, class string, evaluated boolean")
    on, stale = limits.switch_bundle(firing, rules([("r1", "p", True), ("r2", "p", True), ("r3", "p", True)]), rules([("r1", "p", True), ("r2", "l", True), ("r3", "p", False)]))
    assert {x.rule_id for x in on.collect()} == {"r1"} and {(x.rule_id, x.instance_key) for x in stale.collect()} == {("r2", "i"), ("r3", "i")}


def test_scrapes(spark):
    s = spark.createDataFrame([("t", 1, {"__name__": n, "le": le}, 1.0) for n, le in (("h_bucket", "1"), ("h_bucket", "2"), ("h_sum", ""), ("a", ""), ("z", ""))], "target string, ts_ms long, labels map<string,string>, value double")
    scrapes = spark.createDataFrame([("t", 1, 0.5, None), ("t", 2, 1.0, "timeout")], "target string, ts_ms long, duration_s double, error string")
    kept, told = limits.scrape_report(s, scrapes, max_series=3)
    assert [x.labels["__name__"] for x in kept.collect()] == ["a"]  # the histogram would be cut: it is left out whole
    assert {(x.ts_ms, x.name, x.value) for x in told.collect()} == {(1, "up", 1.0), (1, "scrape_duration_seconds", 0.5), (1, "scrape_samples_scraped", 5.0), (2, "up", 0.0), (2, "scrape_duration_seconds", 1.0), (2, "scrape_samples_scraped", 0.0)}


def test_targets(spark):
    port = "array<struct<container:string,port:int,protocol:string>>"
    on = {"prometheus.io/scrape": "true"}
    rows = [("1", "1.1.1.1", "Running", on, [("a", 80, None), ("b", 81, "UDP"), ("c", 0, None)]), ("2", "::1", "Running", on | {"prometheus.io/port": " 9 ", "prometheus.io/path": "x"}, None), ("3", "1.1.1.1", "Running", on | {"prometheus.io/port": "many"}, [("a", 80, None)]), ("4", None, "Running", on, None), ("5", "1.1.1.1", "Failed", on, None), ("6", "1.1.1.1", "Running", None, None), ("7", "1.1.1.1", "Running", on | {"prometheus.io/scheme": "udp"}, [("a", 80, None)])]
    df = spark.createDataFrame(rows, f"uid string, ip string, phase string, annotations map<string,string>, ports {port}")
    assert {(x.uid, x.url, x.container) for x in pod_targets(df).collect()} == {("1", "http://1.1.1.1:80/metrics", "a"), ("2", "http://[::1]:9/x", "")}
    nodes = spark.createDataFrame([("n", "1.1.1.1"), ("m", None)], "name string, ip string")
    assert {x.url for x in kubelet_targets(nodes).collect()} == {"https://1.1.1.1:10250/metrics", "https://1.1.1.1:10250/metrics/cadvisor"}


def test_objects(spark):
    ing = '{"metadata":{"uid":"i","namespace":"a","name":"x"},"spec":{"rules":[{"host":"h"},{"http":{"paths":[{"path":"/p","backend":{"service":{"name":"s","port":{"name":"web"}}}},{"backend":{}}]}}],"tls":[{}]}}'
    svc = '{"metadata":{"uid":"s1","namespace":"a","name":"s"},"spec":{"externalName":"e"}}'
    df = spark.createDataFrame([("networking.k8s.io/Ingress", ing), ("Service", svc), ("Service", "{}"), ("Other", svc), ("Service", None), (None, svc)], "kind string, object string").withColumn("o", F.lit("clash"))
    n = normalize(df)
    f = {x.uid: x.fields for x in n.collect()}
    assert set(f) == {"i", "s1"} and f["i"]["hosts"] == '["h"]' and f["i"]["backends"] == '["s:web"]' and f["i"]["tls"] == "true" and f["s1"]["externalName"] == '"e"'
    assert [(x.from_uid, x.to_uid, x.attrs) for x in routes(df, n).collect()] == [("i", "s1", '{"ports":["web"]}')]
    assert normalize(df.where("false")).count() == 0
    row = spark.range(1).select(selector_text(F.create_map().cast("map<string,string>")).alias("all"), selector_text(F.create_map(F.lit("b"), F.lit("1"), F.lit("a"), F.lit("2"))).alias("two"), affinity_text(F.lit(None).cast("array<struct<matchExpressions:array<struct<key:string,operator:string,values:array<string>>>,matchFields:array<struct<key:string,operator:string,values:array<string>>>>>")).alias("none")).first()
    assert (row["all"], row.two, row.none) == ("*", "a=2,b=1", "")
    pv = '{"metadata":{"name":"v"},"spec":{"accessModes":["ReadWriteOnce"],"nodeAffinity":{"required":{"nodeSelectorTerms":[{"matchFields":[{"key":"metadata.name","operator":"In","values":["n2","n1","n1"]}]},{"matchExpressions":[{"key":"x","operator":"Exists"}]}]}}}}'
    p = placement(spark.createDataFrame([(pv,), ("no json",), (None,)], "object string")).collect()
    assert len(p) == 1 and p[0].node_affinity == "field:metadata.name in (n1,n2) || x exists" and p[0].pinned_nodes == ["n1", "n2"] and len(p[0].limitations) == 2


def test_cost_and_parts(spark):
    df = spark.createDataFrame([("u", "Pod", None, "n", '{"l":[1,2,3,4]}')], "uid string, kind string, namespace string, name string, fields string")
    text = "r.fields.l.all(x, r.fields.l.all(y, x > 0))"
    assert cel.evaluate(df, text, 0, kinds=("Pod",)).first().holds is True
    assert cel.evaluate(df, text, 0, kinds=("Pod",), cost=10).first().error == "cost limit exceeded"
    parts, total = promql_syntax.histogram_parts(promql_syntax.parse("histogram_quantile(0.9, sum by (le, job) (rate(x_bucket[5m])))"))
    assert [n for n, _ in parts] == ["part"] and str(total).startswith("histogram_quantile(0.9, sum by (le, job)")
    with pytest.raises(promql_syntax.PromQLError):
        promql_syntax.histogram_parts(promql_syntax.parse("histogram_quantile(0.9, x_bucket)"))
