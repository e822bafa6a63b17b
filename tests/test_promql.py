"""PromQL: selectors, ranges, aggregation, matching, against worked values and a plain evaluator."""

import math

import pytest

from tidewell.plans import promql_syntax as S
from tidewell.plans.logql_syntax import Matcher
from tidewell.plans.promql import Grid, query

SAMPLES = "labels map<string,string>, ts_ms long, value double, is_stale boolean"
T0 = 1_700_000_000_000


@pytest.fixture(scope="module")
def samples(spark):
    rows = []
    for node, pods in enumerate([["a/p1", "b/p2"], ["a/p3", "c/p4"], ["a/p5", "b/p6", "b/p7"]]):
        for k, np_ in enumerate(pods):
            ns, pod = np_.split("/")
            rate = (node + 1) * 10 + k
            for i in range(16):
                rows.append(({"__name__": "reqs_total", "namespace": ns, "pod": pod, "node": f"n{node}"}, T0 + i * 60_000, float(rate * i * 60), False))
    for i in range(16):
        rows.append(({"__name__": "temp", "room": "x"}, T0 + i * 60_000, [3, 1, 2, 2, 5, 4, float("nan"), 8, 1, 1, 0, -2, 7, 7, 7, 6][i] * 1.0, False))
        rows.append(({"__name__": "reset_total"}, T0 + i * 60_000, float(i % 5 * 10), False))
        for le, n in (("0.1", 10), ("1", 30), ("+Inf", 40)):
            rows.append(({"__name__": "lat_bucket", "le": le}, T0 + i * 60_000, n * i * 1.0, False))
    rows += [({"__name__": "info", "pod": p, "team": t}, T0 + 900_000, 1.0, False) for p, t in (("p1", "red"), ("p2", "blue"))]
    rows += [({"__name__": "gone"}, T0 + 840_000, 1.0, False), ({"__name__": "gone"}, T0 + 870_000, 0.0, True)]
    return spark.createDataFrame(rows, SAMPLES).cache()


END = T0 + 900_000


def at(samples, q, t=END):
    return {tuple(sorted(r.labels.items())): r.value for r in query(samples, q, Grid(t)).collect()}


def one(samples, q, t=END):
    (v,) = at(samples, q, t).values()
    return v


def test_selectors(samples):
    assert len(at(samples, "reqs_total")) == 7
    assert len(at(samples, 'reqs_total{namespace!~"a|b"}')) == 1
    assert len(at(samples, 'reqs_total{absent=""}')) == 7
    assert at(samples, "gone") == {} and one(samples, "gone", T0 + 860_000) == 1
    assert at(samples, "temp", END + 299_999) and not at(samples, "temp", END + 300_000)
    assert one(samples, "temp offset 1m") == 7


def test_rates(samples):
    assert {k[0][1] if k else "": round(v, 9) for k, v in at(samples, "sum by (namespace) (rate(reqs_total[5m]))").items()} == {"a": 60, "b": 74, "c": 21}
    assert set(at(samples, "sum by (namespace) (rate(reqs_total[5m])) > 50")) == {(("namespace", "a"),), (("namespace", "b"),)}
    # 20, 30, 40, 0, 10 in (10m, 15m]: 20 + a reset; extrapolated over 5 minutes
    values = [(i % 5) * 10.0 for i in range(11, 16)]
    rise = values[-1] - values[0] + 40
    assert math.isclose(one(samples, "increase(reset_total[5m])"), rise * (240 + 60) / 240)
    assert one(samples, "irate(reset_total[5m])") == 0 and one(samples, "irate(reset_total[5m])", END - 60_000) == pytest.approx(10 / 60)
    assert one(samples, "resets(reset_total[20m])") == 3
    assert one(samples, "idelta(reset_total[5m])") == values[-1] - values[-2]
    assert at(samples, "rate(temp[1m])") == {}
    assert math.isclose(one(samples, 'deriv(reqs_total{pod="p1"}[10m])'), 10)
    assert math.isclose(one(samples, 'predict_linear(reqs_total{pod="p1"}[10m], 60)'), 9000 + 600)


def test_over_time(samples):
    w = [7.0, 7.0, 7.0, 6.0]  # (11m, 15m]
    assert one(samples, "avg_over_time(temp[4m])") == sum(w) / 4 and one(samples, "sum_over_time(temp[4m])") == 27
    assert one(samples, "min_over_time(temp[12m])") == -2 and one(samples, "max_over_time(temp[12m])") == 8
    assert one(samples, "count_over_time(temp[4m])") == 4 and one(samples, "last_over_time(temp[4m])") == 6 and one(samples, "present_over_time(temp[4m])") == 1
    assert math.isclose(one(samples, "stddev_over_time(temp[4m])"), math.sqrt(0.1875)) and one(samples, "changes(temp[4m])") == 1
    assert one(samples, "quantile_over_time(0.5, temp[4m])") == 7 and one(samples, "quantile_over_time(2, temp[4m])") == math.inf
    assert one(samples, "max_over_time(sum(rate(reqs_total[2m]))[5m:1m])") == pytest.approx(155)
    assert at(samples, 'absent(nothing{a="b", c=~"d"})') == {(("a", "b"),): 1} and at(samples, "absent(temp)") == {} and at(samples, "absent_over_time(temp[1m])") == {}


def test_aggregation(samples):
    q = 'temp or reqs_total{pod="p1"} / 1000'
    assert one(samples, f"count({q})") == 2 and one(samples, f"group({q})") == 1 and one(samples, f"stdvar({q})") == pytest.approx(2.25)
    assert one(samples, f"quantile(0.5, {q})") == pytest.approx(7.5)
    assert set(at(samples, "topk by (namespace) (1, reqs_total)")) == {k for k in at(samples, "reqs_total") if dict(k)["pod"] in ("p5", "p7", "p4")}
    assert len(at(samples, "bottomk(2, reqs_total)")) == 2
    assert at(samples, 'count_values("v", temp)') == {(("v", "6"),): 1}
    assert set(at(samples, "sum without (pod, node) (reqs_total)")) == {(("namespace", n),) for n in "abc"}


def test_matching(samples):
    got = at(samples, "reqs_total * on (pod) group_left (team) info")
    assert {(dict(k)["pod"], dict(k)["team"]) for k in got} == {("p1", "red"), ("p2", "blue")} and all("__name__" not in dict(k) for k in got)
    assert at(samples, "info * on (pod) group_right (team) reqs_total") == got
    assert len(at(samples, "reqs_total and on (pod) info")) == 2 and len(at(samples, "reqs_total unless on (pod) info")) == 5
    assert len(at(samples, "info or reqs_total")) == 9
    with pytest.raises(Exception, match="many-to-many"):
        at(samples, "reqs_total * on (namespace) group_left () reqs_total")
    with pytest.raises(Exception, match="many-to-many"):
        at(samples, "reqs_total + on (namespace) reqs_total")
    assert len(at(samples, "reqs_total == reqs_total")) == 7 and set(at(samples, "reqs_total > bool 10000").values()) <= {0, 1}
    assert at(samples, "temp > 5 < 7") == {(("__name__", "temp"), ("room", "x")): 6} and at(samples, "7 > temp") != {}
    assert at(samples, "-temp ^ 2") == {(("room", "x"),): -36}


def test_functions(samples):
    assert one(samples, "clamp_min(temp, 10)") == 10 and one(samples, "clamp(temp, 1, 2)") == 2 and one(samples, "round(temp / 4, 0.5)") == 1.5
    assert one(samples, "ln(temp - 6)") == -math.inf and math.isnan(one(samples, "ln(temp - 7)")) and one(samples, "sgn(-temp)") == -1
    assert one(samples, "scalar(temp) + vector(1)") == 7 and math.isnan(one(samples, "scalar(reqs_total) + vector(1)"))
    assert one(samples, "time()") == END / 1000 and one(samples, "timestamp(temp)") == END / 1000 and one(samples, "hour()") == 22 and one(samples, "days_in_month(vector(0))") == 31
    assert at(samples, 'label_replace(temp, "y", "$1-z", "room", "(.*)")') == {(("__name__", "temp"), ("room", "x"), ("y", "x-z")): 6}
    assert at(samples, 'label_replace(temp, "room", "", "room", "x")') == {(("__name__", "temp"),): 6} and at(samples, 'label_replace(temp, "y", "1", "room", "q")') == at(samples, "temp")
    assert at(samples, 'label_join(temp, "j", "/", "room", "no", "room")') == {(("__name__", "temp"), ("j", "x//x"), ("room", "x")): 6}
    assert one(samples, "histogram_quantile(0.5, rate(lat_bucket[5m]))") == pytest.approx(0.1 + 0.9 * 0.5)
    assert one(samples, "histogram_quantile(0.9, sum by (le) (lat_bucket))") == 1 and one(samples, "histogram_quantile(0.1, lat_bucket)") == pytest.approx(0.04)
    assert one(samples, "temp / 0") == math.inf and math.isnan(one(samples, "temp % 0"))


@pytest.mark.parametrize("q", ["sum by (node) (rate(reqs_total[3m]))", "temp", "changes(reset_total[5m])", "max_over_time(temp[90s]) > 2", "avg_over_time(sum(temp)[4m:30s])", "quantile_over_time(0.3, temp[3m] offset 1m)", "absent(gone)"])
def test_range_equals_instants(samples, q):
    grid = Grid.of(T0 - 60_000, END + 400_000, 70_000)
    many = {}
    for r in query(samples, q, grid).collect():
        many.setdefault(r.ts_ms, {})[tuple(sorted(r.labels.items()))] = repr(round(r.value, 9))
    for i in range(0, grid.count, 3):
        t = grid.start + i * grid.step
        assert many.get(t, {}) == {k: repr(round(v, 9)) for k, v in at(samples, q, t).items()}, t


@pytest.mark.parametrize("op", ["sum", "count", "min", "max", "avg"])
def test_decomposition(spark, samples, op):
    whole = S.parse(f"{op} by (namespace) (reqs_total)")
    parts, coordinator = S.decompose(whole)
    rows = []
    for node in ("n0", "n1", "n2"):
        for name, expr in parts:
            scoped = S.inject_scope(str(expr), [Matcher("node", "=", node)])
            rows += [({**dict(k), "__name__": name, "node": node}, END, v, False) for k, v in at(samples, scoped).items()]
    merged = spark.createDataFrame(rows, SAMPLES)
    assert at(merged, str(coordinator)) == at(samples, str(whole))


@pytest.mark.parametrize("text", ["foo offset -5m", "foo @ 10", "rate(foo)", "sum(", "1 > 2", "nope(foo)", "foo[5m]", '{a=~".*"}', "foo and 1"])
def test_rejections(text):
    with pytest.raises(S.PromQLError):
        S.parse(text)


def test_rule_validation():
    assert S.inputs(S.validate_rule("foo > 1 and absent(bar)")) == {"foo"}
    with pytest.raises(S.PromQLError, match="name its metric"):
        S.validate_rule('{a="b"}')
    assert S.reach(S.parse("rate(foo[5m] offset 10m)")) == 900_000
    assert S.derived_labels(S.parse('label_join(foo, "x", "", "y")')) == {"x"} and S.aggregates(S.parse("1 + sum(foo)"))


def test_replacement_templates():
    from tidewell.plans.promql import java_replacement

    want = {"$1x": "", "${1}x": "$1x", "${1}0": "$1\\0", "$1-$2": "$1-$2", "$$1": "\\$1", "$word": "$2", "$none.": ".", "a\\b": "a\\\\b", "$9": "", "$": "\\$"}
    assert {k: java_replacement(k, "(.)(?P<word>.*)") for k in want} == want
