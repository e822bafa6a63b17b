"""Readers of logs, metrics and host facts."""

from pyspark.sql import functions as F

from tidewell.sources import hosts, logs, metrics


def test_container_formats(spark):
    df = spark.createDataFrame([("2026-09-05T21:26:52.123456789Z stdout F hello  x",), ("2026-09-05T23:26:52+02:00 stderr P:x part",), ("junk",)], "raw string")
    a, b, c = [r.c for r in df.select(logs.parse_cri(F.col("raw")).alias("c")).collect()]
    assert a.time_ns == 1788643612123456789 and (a.stream, a.final, a.text) == ("stdout", True, "hello  x")
    assert b.time_ns == 1788643612000000000 and not b.final and b.text == "part" and c is None
    d = spark.createDataFrame([('{"log":"x\\n","stream":"stdout","time":"2026-09-05T21:26:52.5Z"}',), ('{"log":"x"',)], "raw string").select(logs.parse_docker(F.col("raw")).alias("c")).collect()
    assert (d[0].c.time_ns, d[0].c.final, d[0].c.text) == (1788643612500000000, True, "x") and d[1].c is None
    rows = spark.createDataFrame([("p", "s", 1, 10, False, "ab"), ("p", "s", 2, 20, True, "cd"), ("p", "s", 3, 30, True, "e"), ("p", "t", 4, 40, False, "open")], "path string, stream string, offset long, time_ns long, final boolean, text string")
    got = {(x.stream, x.offset): (x.time_ns, x.text, x.truncated) for x in logs.assemble(rows, max_bytes=3).collect()}
    assert got == {("s", 1): (10, "abc", True), ("s", 3): (30, "e", False), ("t", 4): (40, "ope", True)}
    lab = spark.range(1).select(logs.pod_labels(F.lit("/var/log/pods/shop_web-1_u-9/main/0.log"), F.lit("stdout"), "n1", F.create_map(F.lit("pod"), F.lit("no"), F.lit("team"), F.lit("x"))).alias("l")).first().l
    assert lab == {"namespace": "shop", "pod": "web-1", "pod_uid": "u-9", "container": "main", "stream": "stdout", "node": "n1", "team": "x"}


def test_files_and_host_lines(spark, tmp_path):
    folder = tmp_path / "shop_web_u" / "main"
    folder.mkdir(parents=True)
    (folder / "0.log").write_text("2026-09-05T21:26:52Z stdout F one\n2026-09-05T21:26:53Z stdout F two\n")
    got = logs.read_pod_logs(spark, str(tmp_path)).select(logs.parse_cri(F.col("raw"))["text"].alias("t")).collect()
    assert [r.t for r in got] == ["one", "two"]
    rows = spark.createDataFrame([("f", i, r, 7) for i, r in enumerate(["no time", "Sep  5 21:26:52 h x", "  more", "2026-09-05T21:26:53.5Z y"])], "path string, line_no int, raw string, mtime_ns long")
    assert [r.ts_ns for r in logs.host_lines(rows, 2026).orderBy("line_no").collect()] == [7, 1788643612000000000, 1788643612000000000, 1788643613500000000]


def test_limits(spark):
    df = spark.createDataFrame([("r", {"a": "b"}, i, "x" * 10, i) for i in range(10)] + [("q", {}, 1, "y" * 90, 1)], "rule_id string, labels map<string,string>, ts_ns long, line string, seq long")
    assert [r.ts_ns for r in logs.range_read(df.where("rule_id = 'r'"), 2, 8, max_lines=5, max_bytes=35).collect()] == [8, 7, 6]
    assert logs.newest_evidence(df, 3).count() == 4
    kept = logs.evidence_ring(df, spark.createDataFrame([("r", 1.0), ("q", 1.0)], "rule_id string, weight double"), 100).collect()
    assert sorted(r.ts_ns for r in kept) == [5, 6, 7, 8, 9] and all(r.limited for r in kept)


def test_exposition(spark):
    text = ["# HELP x y", 'reqs_total{a="b\\"c",path="/x\\\\n\\n"} 1.5e3 1700', "up 1", "bad{", "nan_m NaN", 'inf{le="+Inf"} +Inf']
    got = [r.s for r in spark.createDataFrame([(x,) for x in text], "raw string").select(metrics.parse_exposition(F.col("raw"), F.lit(9)).alias("s")).collect()]
    assert got[0] is None and got[3] is None
    assert got[1].labels == {"__name__": "reqs_total", "a": 'b"c', "path": "/x\\n\n"} and (got[1].value, got[1].ts_ms) == (1500, 1700)
    assert (got[2].value, got[2].ts_ms) == (1, 9) and got[4].value != got[4].value and got[5].value == float("inf")
    lab = spark.range(1).select(metrics.with_target(F.create_map(*map(F.lit, ["job", "x", "exported_job", "y", "z", "1"])), F.create_map(*map(F.lit, ["job", "t", "e", ""]))).alias("l")).first().l
    assert lab == {"exported_exported_job": "x", "exported_job": "y", "z": "1", "job": "t"}


def test_series(spark):
    schema = "labels map<string,string>, ts_ms long, value double, is_stale boolean, source string"
    df = spark.createDataFrame([({"a": "1"}, t, v, False, "s") for t, v in [(0, 1.0), (10, 1.0), (20, 1.0), (25, 2.0), (30, 2.0), (60, 2.0)]] + [({"a": "2"}, 0, 5.0, False, "s"), ({"a": "2"}, 0, 6.0, False, "r")], schema)
    assert sorted((r.labels["a"], r.ts_ms) for r in metrics.sample_snapshots(df.where("source = 's'"), 20).collect()) == [("1", 0), ("1", 20), ("1", 25), ("1", 60), ("2", 0)]
    assert metrics.retain(df, 35).count() == 3 and metrics.merge_sources(df).where("ts_ms = 0 and value = 6").count() == 1
    gone = metrics.stale_markers(df, df.where("labels['a'] = '1'"), 99).collect()
    assert [(r.labels, r.is_stale) for r in gone] == [({"a": "2"}, True)]
    assert {r.value for r in metrics.label_values(df, "a").collect()} == {"1", "2"} and metrics.admit_series(df, 1).count() == 6
    fam = spark.createDataFrame([("h", "histogram", {"x": "y"}, None, 3.0, 4.0, [(0.5, 1.0), (1.0, 3.0)]), ("g", "gauge", {}, 7.0, None, None, None)], "name string, kind string, labels map<string,string>, value double, sum double, count double, points array<struct<at:double,value:double>>")
    got = {(r.labels["__name__"], r.labels.get("le")): r.value for r in metrics.expand_family(fam).collect()}
    assert got == {("h_bucket", "0.5"): 1, ("h_bucket", "1"): 3, ("h_bucket", "+Inf"): 4, ("h_sum", None): 3, ("h_count", None): 4, ("g", None): 7}
    facts = spark.createDataFrame([({"cpu_p95": "1.0"}, {"cpu_p95": "1.05"}), ({"cpu_p95": "1.0"}, {"cpu_p95": "1.5"}), ({"a": "x"}, {"a": "y"}), ({"a": "x"}, {})], "o map<string,string>, n map<string,string>")
    assert [r.c for r in facts.select(metrics.changed_facts(F.col("o"), F.col("n"), {"p95": 0.1, "cpu_p95": 0.2}).alias("c")).collect()] == [False, True, True, True]


def test_hosts(spark):
    deb = spark.createDataFrame([("Package: bash\nStatus: install ok installed\nArchitecture: amd64\nSource: bash-src (5.0)\nVersion: 5.1\nDescription: x\n more: y",), ("junk",)], "value string")
    assert tuple(hosts.deb_packages(deb).first()) == ("dpkg", "bash", "5.1", "amd64", "installed", "bash-src", "5.0") and hosts.deb_packages(deb).count() == 1
    apk = spark.createDataFrame([("P:musl\nV:1.2\nA:x86\no:musl-src",)], "value string")
    assert tuple(hosts.apk_packages(apk).first())[:6] == ("apk", "musl", "1.2", "x86", "installed", "musl-src")
    osr = spark.createDataFrame([('# c\nNAME="Linux X"\nID=x\nID=y\n',)], "value string").select(hosts.key_values(F.col("value")).alias("m")).first().m
    assert osr == {"NAME": "Linux X", "ID": "y"}
    socks = spark.createDataFrame([("h", "tcp", "LISTEN", "::", 80, 0, 9, 7), ("h", "tcp", "LISTEN", "::", 80, 5, 8, 3), ("h", "tcp", "ESTAB", "::", 80, 5, 8, 3)], "host string, protocol string, state string, address string, port int, uid int, inode long, pid int")
    (s,) = hosts.listening_sockets(socks).collect()
    assert (s.uids, s.inodes, s.owner_pid) == ([0, 5], [8, 9], 3)
    b = spark.createDataFrame([(57, None), (57, 60), (57, 50), (62, 50), (58, 60)], "p int, q int").select(hosts.used_bucket(F.col("p"), F.col("q")).alias("b"))
    assert [r.b for r in b.collect()] == [50, 50, 50, 60, 60]
    m = spark.range(1).select(hosts.mounts(F.lit("36 35 98:0 /r /mnt\\0402 rw - ext3 /dev/root rw")).alias("m"), hosts.memory_info(F.lit("MemTotal:  10 kB\nHuge: 3")).alias("i")).first()
    assert (m.m.mountpoint, m.m.fstype, m.i) == ("/mnt 2", "ext3", {"MemTotal": 10240, "Huge": 3})
    files = spark.createDataFrame([("i", 0, "a/x", "1"), ("i", 0, "a/y", "1"), ("i", 0, "b/z", "1"), ("i", 0, "c/k", "1"), ("i", 1, "a/.wh.x", ""), ("i", 1, "b/.wh..wh..opq", ""), ("i", 1, "b/new", "2"), ("i", 2, ".wh.c", ""), ("i", 2, "a/y", "3")], "image string, layer int, path string, data string")
    assert {(r.path, r.data) for r in hosts.overlay_files(files).collect()} == {("a/y", "3"), ("b/new", "2")}
    pk = spark.createDataFrame([(h, "dpkg", n, "1", "", "", "", "") for h in ("h1", "h2") for n in ("b", "a", "b")] + [("h3", "dpkg", "", "1", "", "", "", "")], "host string, manager string, name string, version string, arch string, state string, source string, source_version string")
    assert hosts.package_sets(pk.where("host <> 'h3'")).select("digest").distinct().count() == 1
    assert hosts.normalize_packages(pk, 150).groupBy("host").count().collect() != []
