"""Alert instances, findings and streams."""

from pyspark.sql import functions as F

from tidewell.operators.alerts import Instance, duplicate_observations, timeline, transitions
from tidewell.operators.findings import Episode, dedup_key, episodes, lifecycle_summary, merge_evidence, notifications
from tidewell.streaming.alerts import counter_value, stream_counts, stream_transitions

MIN = 60_000
ROW = "rule_id string, instance_key string, eval_ms long, observed boolean, incomplete boolean, flagged boolean, value double, content string, for_ms long, keep_ms long, phase string"


def run(seen, for_ms=MIN, keep_ms=MIN):
    """seen: '+' observed, '-' absent, '?' incomplete, one for each minute."""
    x, out = Instance(), []
    for i, c in enumerate(seen):
        t = x.step(i * MIN, c == "+", c == "?", False, 1.0, "c", for_ms, keep_ms)
        if t:
            out.append((i, t))
    return out


def test_instance_timelines():
    assert run("++++------") == [(1, "firing"), (5, "resolved")]
    assert run("+-+-+") == []
    assert run("++?---") == [(1, "firing"), (2, "stale"), (4, "resolved")]
    assert run("++???+") == [(1, "firing"), (2, "stale"), (5, "update")]
    assert run("++-+-+") == [(1, "firing")]
    assert run("+--", for_ms=0, keep_ms=0) == [(0, "firing"), (1, "resolved")]
    assert run("?-+") == []


def test_longer_wait_demotes_and_restore():
    x = Instance()
    assert x.step(0, True, False, False, 1, "c", 0, 0) == "firing"
    assert x.step(MIN, True, False, False, 1, "c", 5 * MIN, 0) == "resolved" and x.phase == "pending"
    assert x.step(5 * MIN, True, False, True, 1, "c", 5 * MIN, 0) == "firing"
    assert x.step(6 * MIN, True, False, False, 2, "c", 5 * MIN, 0) == "update"
    y = Instance(phase="pending", active_ms=10)
    y.restore(100, 200)
    assert y.active_ms == 110
    y.restore(0, 4_000_000)
    assert y.phase is None


def ticks():
    rows = []
    for key, seen in (("a", "++++------"), ("b", "++?---"), ("hot", "+" * 50 + "-" * 5)):
        rows += [("r", key, i * MIN, c == "+", c == "?", False, float(i), "c", MIN, MIN, "clash") for i, c in enumerate(seen)]
    return rows + rows[:3] + [(None, "a", 1, True, None, None, None, None, None, None, ""), ("r", None, 1, True, None, None, None, None, None, None, "")]


WANT = {("a", MIN, "firing"), ("a", 5 * MIN, "resolved"), ("b", MIN, "firing"), ("b", 2 * MIN, "stale"), ("b", 4 * MIN, "resolved"), ("hot", MIN, "firing"), ("hot", 51 * MIN, "resolved")}


def test_batch_transitions(spark):
    df = spark.createDataFrame(ticks(), ROW)
    assert {(x.instance_key, x.eval_ms, x.transition) for x in transitions(df).collect()} == WANT
    assert transitions(df.where("false")).count() == 0


def test_stream_transitions(spark, tmp_path):
    rows = [t for t in ticks() if t[0] and t[1]]
    for k in range(3):
        spark.createDataFrame(rows[k::3] if k == 9 else [r for r in rows if (r[2] // MIN) % 60 // 20 == k], ROW).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(ROW).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = stream_transitions(stream).writeStream.format("memory").queryName("alerts").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {(x.instance_key, x.eval_ms, x.transition) for x in spark.table("alerts").collect()}
    assert got == WANT


def test_timeline(spark):
    seen = spark.createDataFrame([("r", "a", 0, 1.0, "c"), ("r", "a", MIN, 2.0, "c"), ("r", "a", MIN, 2.0, "c")], "rule_id string, instance_key string, eval_ms long, value double, content string")
    grid = spark.createDataFrame([("r", i * MIN, False, False, MIN, 0) for i in range(-1, 4)], "rule_id string, eval_ms long, incomplete boolean, flagged boolean, for_ms long, keep_ms long")
    assert {(x.eval_ms, x.transition) for x in transitions(timeline(seen, grid)).collect()} == {(MIN, "firing"), (2 * MIN, "resolved")}
    assert duplicate_observations(seen).count() == 1


def test_episodes(spark):
    e = Episode()
    assert e.step("t", "k", 0, "firing", 0, 1, ["b", "a"]) == "firing" and e.resources == ["a", "b"]
    first = e.id
    assert e.step("t", "k", 1000, "update", 1000, 2, ["c"]) is None and e.pending and e.count == 3
    assert e.step("t", "k", 61_000, "update", 61_000, 0, []) == "update" and e.count == 4
    assert e.step("t", "k", 62_000, "stale", 0, 0, []) == "stale" and e.step("t", "k", 63_000, "stale", 0, 0, []) is None
    assert e.step("t", "k", 64_000, "update", 64_000, 1, []) == "fresh"
    assert e.step("t", "k", 65_000, "resolved", 65_000, 1, []) == "resolved"
    e.close()
    assert e.step("t", "k", 65_001, "firing", 0, 1, []) == "firing" and e.first_seen == 1 and e.id != first
    rows = [("t", "k", i * 1000, "firing" if i < 3 else "resolved", i * 1000, None, None) for i in range(4)] + [("t", None, 1, "firing", 1, 1, ["x"])]
    got = episodes(spark.createDataFrame(rows, "target_id string, dedup_key string, now_ms long, transition string, seen_ms long, n int, resources array<string>"))
    assert [(x.event, x["count"]) for x in got.orderBy("at_ms").collect()] == [("firing", 1), ("resolved", 3)]


def test_keys_and_summaries(spark):
    df = spark.createDataFrame([({"b": "2", "a": 'x"', "value": "9"},)], "labels map<string,string>")
    assert df.select(dedup_key(F.lit("r"), F.col("labels"))).first()[0] == 'r{a={"v":"x\\""},b={"v":"2"}}'
    e = spark.createDataFrame([("f", 1, "firing"), ("f", 3, "resolved"), ("f", 9, "firing"), ("g", 2, "firing")], "finding string, seq long, state string")
    assert {tuple(r) for r in lifecycle_summary(e, 2, 5, ["finding"]).collect()} == {("f", 3, "resolved")}
    assert {tuple(r) for r in notifications(e, 1, ["finding"]).collect()} == {("f", 9), ("g", 2)}
    ev = spark.createDataFrame([("f", "log", "aaaa", 1, 1), ("f", "log", "aaaa", 5, 2), ("f", "log", "bbbb", 2, 1)], "finding_id string, source string, text string, time_ms long, n long").withColumn("labels", F.lit("{}"))
    got = {x.text: (x.first_ms, x.last_ms, x.n, x.kept) for x in merge_evidence(ev, 5).collect()}
    assert got == {"aaaa": (1, 5, 3, True), "bbbb": (2, 2, 1, False)}


def test_stream_counts(spark, tmp_path):
    rows = [({"pod": f"p{i % 2}"}, 1_700_000_000 + i, "x" * (i % 3)) for i in range(100)]
    spark.createDataFrame(rows, "labels map<string,string>, s long, line string").select("labels", F.timestamp_seconds("s").alias("ts"), "line").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("labels map<string,string>, ts timestamp, line string").parquet(str(tmp_path / "in"))
    q = stream_counts(stream, ("pod",), 120).writeStream.format("memory").queryName("counts").outputMode("complete").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    total = counter_value(spark.table("counts"), ("pod",), 120, 1_700_000_099).agg(F.sum("lines"), F.sum("bytes")).first()
    assert tuple(total) == (100, sum(i % 3 for i in range(100)))
    late = counter_value(spark.table("counts"), ("pod",), 10, 1_700_000_099).agg(F.sum("lines")).first()[0]
    assert late in (10, 11, 12)
