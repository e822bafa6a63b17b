"""State predicates and cron schedules."""

import json
from datetime import UTC, datetime

import pytest
from pyspark.sql import functions as F

from tidewell.functions.cron import CronError, previous
from tidewell.plans.cel import CelError, compile_cel, evaluate

R = {"uid": "u", "kind": "Pod", "namespace": "ns", "name": "n", "fields": {"a.b": 1, "m": {"x": {"y": "deep"}}, "events.warning.A": 12, "events.warning.B": 9.0, "list": [1, 2, 3]}}
ENV = {"r": R, "now": datetime(2026, 10, 21, 15, 7, 30, tzinfo=UTC)}


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ('r.fields.exists(k, k.startsWith("list") && r.fields[k] == [1, 2, 3])', True),
        ('field(r, "a.b", 0) + 1', 2), ('field(r, "m.x.y", "")', "deep"), ('field(r, "a.c", "no")', "no"),
        ('r.fields.filter(k, k.startsWith("events.warning.")).all(k, double(r.fields[k]) > 8.5)', True), ('[3, 1, 2].filter(x, [3, 1, 2].all(y, x <= y))', [1]), ('"a.b.c".split(".").map(x, x + x)[2]', "cc"),
        ('"x" in ["x", "y"] && !(2 in [1.0, 3.0])', True), ('r.fields.events == 1 || true', True), ('false && r.nope', False), ("has(r.fields.list) && !has(r.fields.zip)", True),
        ("1 == 1.0 && 3 > 2.5 && 7 / 2 == 3 && -7 % 4 == -3 && 7.0 / 2.0 == 3.5", True), ('string(size(r.fields.list)) + "x".upperAscii() + "abcdef".substring(1, 3)', "3Xbc"),
        ("int(now) * 1000", 1792595250000), ('now - timestamp("2026-10-21T15:00:00Z") > duration("5m")', True), ('string(timestamp(0))', "1970-01-01T00:00:00Z"), ("math.greatest(1, 2.5)", 2.5), ("r.fields.list.exists_one(x, x == 2)", True), ('r"a\\d" + \'q\'', "a\\dq"), ("{'a': 1}['a']", 1),
        ('cronPrevious("20 11 * * *", "", int(now) * 1000)', int(datetime(2026, 10, 21, 11, 20, tzinfo=UTC).timestamp() * 1000)),
    ],
)
def test_expressions(text, want):
    assert compile_cel(text)(ENV) == want


@pytest.mark.parametrize("text", ["r.nope", "1 + 1.0", '"a" < 1', "1 / 0", "r.fields[5]", "[1][2]", "true && r.nope", '"a".nope()', "field(r)", "(", "nope(1)", "1 + ", "has(1)"])
def test_errors(text):
    with pytest.raises(CelError):
        compile_cel(text)(ENV)


def test_evaluate(spark):
    rows = [("p1", "Pod", "a", "x", json.dumps({"phase": "Running", "n": 1})), ("p2", "Pod", "a", "y", json.dumps({"phase": "Pending"})), ("p3", "Pod", None, "z", None), ("n1", "Node", None, "node", json.dumps({"ready": False})), ("p4", "Pod", "a", "w", "broken")]
    df = spark.createDataFrame(rows, "uid string, kind string, namespace string, name string, fields string").withColumn("out", F.lit("clash"))
    edges = spark.createDataFrame([("p1", "runs-on", "n1", '{"w":2}'), ("p2", "runs-on", "gone", None)], "from_uid string, type string, to_uid string, attrs string")
    got = {x.uid: x for x in evaluate(df, 'out(r, "runs-on").exists(n, n.fields.ready == false && n.edge.w == 2)', 0, kinds=("Pod",), labels={"team": "t", "phase": '=field(r, "phase", "")'}, edges=edges).collect()}
    assert got["p1"].holds and got["p1"].labels == {"kind": "Pod", "namespace": "a", "name": "x", "team": "t", "phase": "Running"}
    assert got["p2"].holds is False and got["p3"].holds is False and got["p4"].holds is None and got["p4"].error
    back = {x.uid: x.holds for x in evaluate(df, 'in(r, "runs-on").size() == 1', 0, kinds=("Node",), edges=edges).collect()}
    assert back == {"n1": True}
    need = {x.uid: x.error for x in evaluate(df, "true", 0, kinds=("Pod",), required=("n",)).collect()}
    assert need["p1"] is None and "required" in need["p2"]
    assert {x.error for x in evaluate(df, "1", 0, kinds=("Node",)).collect()} == {"not a bool"}


NOW = datetime(2025, 3, 12, 6, 41, 9, tzinfo=UTC)  # a Wednesday


def utc(*when):
    return int(datetime(*when, tzinfo=UTC).timestamp() * 1000)


def at(spec, zone="", now=NOW):
    return previous(spec, zone, int(now.timestamp() * 1000))


def test_cron_fields():
    assert at("41 6 * * *") == utc(2025, 3, 12, 6, 41)  # the minute of the instant itself
    assert at("42 6 * * *") == utc(2025, 3, 11, 6, 42)
    assert at("*/25 3-5 * * *") == utc(2025, 3, 12, 5, 50)
    assert at("10/20 * * * *") == utc(2025, 3, 12, 6, 30)  # a value with a step runs to the end
    assert at("0 0 29 feb *") == utc(2024, 2, 29)
    assert at("5 4 1-7 * Tue") == utc(2025, 3, 11, 4, 5)  # without a star either day counts
    assert at("5 4 */2 * *") == utc(2025, 3, 11, 4, 5)


def test_cron_sunday_is_0_and_7():
    sunday = utc(2025, 3, 9, 12)
    assert at("0 12 * * 7") == at("0 12 * * 0") == at("0 12 * * sun") == sunday
    assert at("0 12 * * 7,3") == sunday and at("0 12 * * 6-7") == sunday
    assert at("0 5 * * 5-7/2") == utc(2025, 3, 9, 5)


def test_cron_names_and_zones():
    assert at("@Daily") == at("@MIDNIGHT") == utc(2025, 3, 12)
    assert at("@every 90m") == int(NOW.timestamp() * 1000) // 5_400_000 * 5_400_000
    assert at("TZ=Asia/Tokyo 0 7 * * *") == utc(2025, 3, 11, 22)
    assert at("TZ=Asia/Tokyo 0 7 * * *", "America/Lima") == utc(2025, 3, 11, 12)  # the given zone beats the text's
    assert at("30 1 * * *", "Europe/Paris", datetime(2025, 3, 30, 4, tzinfo=UTC)) == utc(2025, 3, 30, 0, 30)


@pytest.mark.parametrize("spec", ["1 2 3 4", "0 0 0 * *", "0 0 * 13 *", "0 0 31 4 *", "8-3 * * * *", "1/x * * * *", "@every 20ms", "@sometimes", "0 0 * * 9", "TZ=Nowhere/City 0 0 * * *"])
def test_bad_cron(spec):
    with pytest.raises(CronError):
        at(spec)
