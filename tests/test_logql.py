"""LogQL: grammar, stages, windows, and the small fixture with its expected values."""

import pytest
from pyspark.sql import functions as F

from tidewell.plans import logql_syntax as S
from tidewell.plans.logql import Grid, log_query, metric_query, pipeline

SEC = 10**9
NOON = 1_650_024_000 * SEC
LINES = "labels map<string,string>, ts_ns long, line string, seq long"
#: (service, zone, seconds after noon, text): a slow service, a chatty one in two zones, and one that only starts
ENTRIES = [
    *[("billing", "z1", 7 * i, f"took={3 * i}ms rc={i % 3}") for i in range(9)],
    *[("search", f"z{1 + i % 2}", 2 * i + 1, f"hit q=w{i} rc=0") for i in range(30)],
    ("boot", "z2", 33, "started"),
]


@pytest.fixture(scope="module")
def lines(spark):
    return spark.createDataFrame([({"service": s, "zone": z}, NOON + t * SEC, text, n) for n, (s, z, t, text) in enumerate(ENTRIES)], LINES).cache()


def brute(service, low, high, want=lambda text: True):
    """Entries of a service in (low, high] seconds after noon."""
    return [(z, text) for s, z, t, text in ENTRIES if s == service and low < t <= high and want(text)]


def vector(df):
    return {(tuple(sorted(r.labels.items())), r.ts_ns): r.value for r in df.collect()}


def instant(lines, q, after=60):
    return {k: v for (k, _), v in vector(metric_query(lines, q, Grid(NOON + after * SEC))).items()}


def test_counts_and_rates(lines):
    assert instant(lines, 'sum by (zone) (count_over_time({service="search"}[20s]))', 40) == {(("zone", z),): len([1 for x, _ in brute("search", 20, 40) if x == z]) for z in ("z1", "z2")}
    assert instant(lines, 'sum(count_over_time({service="billing"} | logfmt | rc="2" [1m]))') == {(): len(brute("billing", 0, 60, lambda x: "rc=2" in x))}
    assert instant(lines, 'sum(rate({service="search"}[50s]))', 50) == {(): len(brute("search", 0, 50)) / 50}
    assert instant(lines, 'bytes_over_time({service="boot"}[1m])') == {(("service", "boot"), ("zone", "z2")): len("started")}
    assert instant(lines, 'count_over_time({service="boot"}[20s])') == {} == instant(lines, 'sum(count_over_time({service="absent"}[1h]))')


def test_aggregations(lines):
    per = {s: len([1 for x in ENTRIES if x[0] == s]) - (1 if s == "billing" else 0) for s in ("billing", "search", "boot")}  # the first is not after noon
    assert instant(lines, 'count(count_over_time({zone=~"z."}[1m]))') == {(): 4}
    assert instant(lines, 'topk(1, sum by (service) (count_over_time({zone=~".+"}[1m])))') == {(("service", "search"),): per["search"]}
    assert instant(lines, 'max without (zone) (count_over_time({service=~"s.+|boot"}[1m]))') == {(("service", "search"),): 15, (("service", "boot"),): 1}
    assert instant(lines, 'avg by (service) (count_over_time({zone=~".+"}[1m])) % 4') == {(("service", "search"),): 3, (("service", "billing"),): per["billing"] % 4, (("service", "boot"),): 1}


def test_arithmetic(lines):
    one = 'sum(count_over_time({service="boot"}[1m]))'
    assert instant(lines, f"{one} > 1") == {} and instant(lines, f"{one} >= bool 2") == {(): 0}
    assert instant(lines, f"{one} / 0") == {(): float("inf")} and instant(lines, f"3 ^ 2 ^ 2 - {one}") == {(): 80}
    assert instant(lines, f"5 * {one} * 0 == bool 0") == {(): 1}


def test_window_is_open_at_its_start(lines):
    for width in ("1s", "2s", "7s", "7500ms"):
        low = 35 - float(width.rstrip("ms")) / (1000 if width.endswith("ms") else 1)
        want = len(brute("billing", low, 35))
        assert instant(lines, f'sum(count_over_time({{service="billing"}}[{width}]))', 35) == ({(): want} if want else {}), width


def test_range_equals_instants(lines):
    for q in ('sum by (zone) (count_over_time({service="search"}[5s]))', 'rate({zone=~".+"} |= "rc=0" [9s])'):
        grid = Grid.of(NOON - 4 * SEC, NOON + 70 * SEC, 11 * SEC + 3)
        many = vector(metric_query(lines, q, grid))
        for i in range(grid.count):
            t = grid.start + i * grid.step
            got = {k: v for (k, _), v in vector(metric_query(lines, q, Grid(t))).items()}
            assert {k: v for (k, s), v in many.items() if s == t} == got, (q, i)


def test_log_query(lines):
    def took(df):
        return [r.line.split("ms")[0] for r in df.collect()]

    q, end = '{service="billing"} != "rc=1"', NOON + 60 * SEC
    assert took(log_query(lines, q, NOON, end)) == ["took=24", "took=18", "took=15", "took=9", "took=6", "took=0"]
    assert took(log_query(lines, q, NOON, end, limit=2)) == ["took=24", "took=18"]
    assert took(log_query(lines, q, NOON, end, limit=2, backward=False)) == ["took=0", "took=6"]
    assert took(log_query(lines, q, NOON, end, max_bytes=2 * len("took=24ms rc=2"))) == ["took=24", "took=18"]
    assert took(log_query(lines, q, NOON + 14 * SEC, NOON + 21 * SEC)) == ["took=6"]  # closed at its start, open at its end
    assert took(log_query(lines, q, NOON, end, max_bytes=5)) == []


STAGES = [
    ("| json", '{"a":"x","n":1.50,"b":true,"o":{"p q":2,"o":{"z":""}},"l":[1],"u":null,"app":"y","9k":1}', {"a": "x", "n": "1.50", "b": "true", "o_p_q": "2", "o_o_z": "", "app_extracted": "y", "_9k": "1"}),
    ("| json", ' {"a": "é\\u00e9\\n"}', {"a": "éé\n"}),
    ("| json", "[1]", {"__error__": "JSONParserErr"}),
    ("| json", '{"a":1', {"__error__": "JSONParserErr"}),
    ("| json", '{"a":NaN}', {"__error__": "JSONParserErr"}),
    ('| json x="a.b", y="c[1]", z="d[\\"k k\\"]", w', '{"a":{"b":{"q":1.0}},"c":[1,[2, "x"]],"d":{"k k":null}}', {"x": '{"q":1.0}', "y": '[2,"x"]', "z": "", "w": ""}),
    ('| json x="a"', ' {"a":1}', {"__error__": "JSONParserErr"}),
    ('| json x="a"', "", {}),
    ("| logfmt", 'a=1 b="x \\"y\\"" bare c= d=x=y e="u"f=2 "k=v g=3', {"a": "1", "b": 'x "y"', "e": "u", "f": "2", "g": "3"}),
    ("| logfmt", 'a=1 b="open c=2', {"a": "1"}),
    ('| pattern "<ip> - <_> [<t>] <rest>"', "1.2.3.4 - me [now] GET /x", {"ip": "1.2.3.4", "t": "now", "rest": "GET /x"}),
    ('| pattern "<ip> - <u> [<t>]"', "1.2.3.4 - me no more", {"ip": "1.2.3.4", "u": "me no more"}),
    ('| pattern "lead <x> end"', "no lead", {}),
    ('| pattern "lead <x>end"', "lead end", {"x": ""}),
    ('| regexp "(?P<m>GET|PUT) (?P<p>/\\\\S+)(?P<q>!)?"', "x GET /a b", {"m": "GET", "p": "/a", "q": ""}),
    ('| regexp "(?P<m>GET)"', "POST", {}),
    ('| logfmt | n>2', "n=x", {"n": "x", "__error__": "LabelFilterErr"}),
    ('| logfmt | n>2', "n=1", None),
    ('| logfmt | n>2', "m=1", None),
    ('| logfmt | d>=1m30s', "d=90s", {"d": "90s"}),
    ('| logfmt | d>1m30s', "d=1.5m", None),
    ('| logfmt | s=10KB', "s=10kb", {"s": "10kb"}),
    ('| logfmt | s>1KiB', "s=1,025", {"s": "1,025"}),
    ('| logfmt | a="1" or n>2', "a=1 n=x", {"a": "1", "n": "x"}),
    ('| logfmt | a="2" or n>2', "a=1 n=x", {"a": "1", "n": "x", "__error__": "LabelFilterErr"}),
    ('| logfmt | n>2 and a="1"', "a=1 n=x", {"a": "1", "n": "x", "__error__": "LabelFilterErr"}),
    ('| logfmt | n>2 | __error__=""', "n=x", None),
    ('| json | logfmt | a="1"', "a=1", {"a": "1", "__error__": "JSONParserErr"}),
    ('| missing=""', "x", {}),
    ('| app=~"a.+"', "x", {}),
    ('| app!~"a.*"', "x", None),
    ('|= "" != "z" |~ "^a.c$" !~ "b$"', "abc", {}),
    ('!= ""', "abc", None),
    ('|~ "(?i)ABC"', "abc", {}),
]


@pytest.mark.parametrize(("stages", "line", "want"), STAGES)
def test_stages(spark, stages, line, want):
    df = spark.createDataFrame([({"app": "api", "empty": ""}, 1, line, 1)], LINES)
    rows = pipeline(df, S.parse('{app="api"} ' + stages)).collect()
    if want is None:
        assert rows == []
    else:
        got = dict(rows[0].labels) | dict(rows[0].parsed) | ({"__error__": rows[0].err} if rows[0].err else {})
        assert got == {"app": "api"} | want


def test_errors_fail_metric_queries(spark):
    df = spark.createDataFrame([({"app": "api"}, 1, "no json", 1)], LINES)
    for q in ('count_over_time({app="api"} | json [1m])', 'sum(count_over_time({app="api"} | json [1m]))'):
        with pytest.raises(Exception, match="JSONParserErr"):
            metric_query(df, q, Grid(1)).collect()
    assert vector(metric_query(df, 'sum by (__error__) (count_over_time({app="api"} | json [1m]))', Grid(1))) == {((("__error__", "JSONParserErr"),), 1): 1}
    assert vector(metric_query(df, 'sum(count_over_time({app="api"} | json | __error__!="" [1m]))', Grid(1))) == {((), 1): 1}


@pytest.mark.parametrize(
    "text",
    ['{a="b"} |= "x" | json x="a.b", y | x==1 and (y="2" or z>5s)', 'topk(3, sum by (a, b) (rate({a="b"} [1d])))', '(1 + 2) * rate({a=~".+"} [90s]) ^ 2 ^ 3', 'sum without () (count_over_time({a="b"} [250µs])) > bool 1', '-1 * (count_over_time({a="b"} [5m]) - 2)'],
)
def test_printing(text):
    assert S.parse(str(S.parse(text))) == S.parse(text)


@pytest.mark.parametrize(
    ("text", "named"),
    [('{a="b"} | line_format "x"', "line_format"), ('sum_over_time({a="b"}[1m])', "sum_over_time"), ('rate({a="b"}[1m]) + rate({a="b"}[1m])', "two vectors"), ('rate({a="b"}[5m:1m])', "subquery"), ('rate({a="b"}[1m] offset 5m)', "offset"), ('{a=~".*"}', "empty string"), ('{a="b"} |~ "(?=x)"', "regular expression"), ("1 + 2", "log streams"), ('{a="b"} | pattern "<a><b>"', "adjacent"), ('topk(0, rate({a="b"}[1m]))', "positive"), ('sum(1)', "vector")],
)
def test_rejections(text, named):
    with pytest.raises(S.LogQLError, match=named):
        S.parse(text)


def test_scope(lines):
    scoped = S.inject_scope('sum(count_over_time({namespace="other"}[1m])) + 1', [S.Matcher("namespace", "=", "shop")])
    assert scoped == 'sum(count_over_time({namespace="other", namespace="shop"} [1m])) + 1'
    assert instant(lines, scoped) == {}


def test_complexity():
    assert S.complexity(S.parse('sum(rate({a="b"} |= "x" [1m])) > 1')) == 7


def test_no_range_join(lines):
    plan = metric_query(lines, 'sum by (zone) (count_over_time({service="search"}[5s]))', Grid.of(NOON, NOON + 19 * SEC, SEC))._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
