"""LogQL stages, filters and the query surface over all lines, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.api import Engine, Scope
from tidewell.functions import labels as L
from tidewell.plans import logql, logql_syntax
from tidewell.queries_engine import _ALL, _EVENTS, _ROWS, DAY_NS, _days, _label, log_metric, of_containers, of_events, shown, span, up
from tidewell.queries_engine import QUERIES as _Q
from tidewell.queries_engine import SQL as _S

QUERIES: dict = {}
SQL: dict[str, str] = {}


def metric(name: str, text: str, step: int | None, source, names: tuple[str, ...], sql: str) -> None:
    log_metric(name, text, step, source, names, sql)
    QUERIES[name], SQL[name] = _Q.pop(name), _S.pop(name)


def events(body: str) -> str:
    return f"WITH {_EVENTS}, g AS ({_days()}), w AS (SELECT g.t, e.* FROM g JOIN e ON ns > t - {DAY_NS} AND ns <= t) {body}"


metric(
    "logql_duration_filter", r'sum by (namespace) (count_over_time({source=~".+"} | regexp `(?:took|for|in) (?P<d>\d+(?:ms|s|m|h)) ` | d > 45m or d < 100ms [all]))', None, of_containers, ("namespace",),
    f"WITH {_ROWS}, p AS (SELECT {_label('namespace')} AS namespace, regexp_extract(line, '(?:took|for|in) (\\d+)(ms|s|m|h) ', ['n', 'u']) AS m FROM l), q AS (SELECT namespace, m.n::BIGINT * CASE m.u WHEN 'ms' THEN 1 WHEN 's' THEN 1000 WHEN 'm' THEN 60000 ELSE 3600000 END AS ms FROM p WHERE m.n <> '') SELECT namespace, {_ALL}, count(*)::DOUBLE AS value FROM q WHERE ms > 2700000 OR ms < 100 GROUP BY namespace",
)
metric(
    "logql_json_paths", 'sum by (k, none) (count_over_time({source="events"} | json k="k", none="a.b[0]" | k >= 95 [1d]))', DAY_NS, of_events, ("k", "none"),
    events("SELECT line->>'k' AS k, '' AS \"none\", t AS ts_ns, count(*)::DOUBLE AS value FROM w WHERE (line->>'k')::DOUBLE >= 95 GROUP BY ALL"),
)
metric(
    "logql_json_escapes", r'sum by (msg) (count_over_time({source=~".+"} | json | msg=~".*\"(debug|u[a-z]+)\".*" [all]))', None, of_containers, ("msg",),
    f"WITH {_ROWS}, p AS (SELECT CASE WHEN line LIKE '{{%' AND json_valid(line) THEN line->>'msg' END AS msg FROM l) SELECT msg, {_ALL}, count(*)::DOUBLE AS value FROM p WHERE regexp_matches(msg, '\"(debug|u[a-z]+)\"') GROUP BY msg",
)
metric(
    "logql_collision", r'sum by (event_type, event_type_extracted) (count_over_time({source="events"} | regexp "(?P<event_type>[0-9])" | event_type_extracted > 6 [1d]))', DAY_NS, of_events, ("event_type", "event_type_extracted"),
    events("SELECT event_type, regexp_extract(line, '[0-9]') AS event_type_extracted, t AS ts_ns, count(*)::DOUBLE AS value FROM w WHERE regexp_extract(line, '[0-9]') IN ('7', '8', '9') GROUP BY ALL"),
)
metric(
    "logql_parser_errors", r'sum by (__error__) (count_over_time({source=~".+"} |= "{" | json | __error__!="" [all]))', None, of_containers, ("__error__",),
    f"WITH {_ROWS} SELECT 'JSONParserErr' AS __error__, {_ALL}, count(*)::DOUBLE AS value FROM l WHERE line LIKE '%{{%' AND NOT coalesce(json_valid(line) AND json_type(CASE WHEN json_valid(line) THEN line END) = 'OBJECT', false) HAVING count(*) > 0",
)
metric(
    "logql_scalars", '(2 + 3) * 2 - sum by (event_type) (count_over_time({source="events"} [1d])) / 4 ^ 2 >= bool -1 + 2 - 100', DAY_NS, of_events, ("event_type",),
    events("SELECT event_type, t AS ts_ns, (10 - count(*) / 16.0 >= -99)::INT::DOUBLE AS value FROM w GROUP BY ALL"),
)
metric(
    "logql_min", 'min by (source) (sum by (source, event_type) (count_over_time({source="events", event_type=~"[a-z]+"} [1d])))', DAY_NS, of_events, ("source",),
    events(", s AS (SELECT event_type, t, count(*) AS n FROM w GROUP BY ALL) SELECT 'events' AS source, t AS ts_ns, min(n)::DOUBLE AS value FROM s GROUP BY t"),
)
metric(
    "logql_line_regexp", r'sum by (container) (count_over_time({namespace=~".+"} |~ "(?i)retry [0-9]+ of" !~ "short|skipped" != "slow" [1d]))', DAY_NS, of_containers, ("container",),
    f"WITH {_ROWS}, g AS ({_days(of='l')}) SELECT {_label('container')} AS container, t AS ts_ns, count(*)::DOUBLE AS value FROM g JOIN l ON ns > t - 86400000000000 AND ns <= t WHERE {_label('namespace')} <> '' AND regexp_matches(line, '(?i)retry [0-9]+ of') AND NOT regexp_matches(line, 'short|skipped') AND line NOT LIKE '%slow%' GROUP BY ALL",
)


def logql_printed(spark: SparkSession, d: str) -> DataFrame:
    """A query printed in canonical form and read again gives the same."""
    lines, times = of_events(spark, d)
    first, last = span(times)
    text = str(logql_syntax.parse('sum by(event_type)(rate({ source = "events" }|="7"|json|k>10 and k<=90[2d]))*86400'))
    assert logql_syntax.complexity(logql_syntax.parse(text)) < 500
    return shown(logql.metric_query(lines, text, logql.Grid.of(up(first, DAY_NS), up(last, DAY_NS), DAY_NS)), "ts_ns", "event_type")


QUERIES["logql_printed"] = logql_printed
SQL["logql_printed"] = f"WITH {_EVENTS}, g AS ({_days()}) SELECT event_type, t AS ts_ns, round(count(*) / 172800.0 * 86400, 9) AS value FROM g JOIN e ON ns > t - {2 * DAY_NS} AND ns <= t WHERE line LIKE '%7%' AND (line->>'k')::DOUBLE > 10 AND (line->>'k')::DOUBLE <= 90 GROUP BY ALL"


def logql_scoped(spark: SparkSession, d: str) -> DataFrame:
    """A metric query within the scope of two namespaces, the first three series in label order."""
    lines, times = of_containers(spark, d)
    first, last = span(times)
    end = up(last, DAY_NS)
    engine = Engine(lines=lines, scope=Scope(namespaces=("checkout", "payments")))
    got = engine.logql(f'sum by (namespace, stream) (count_over_time({{source=~".+"}} [{(end - first) // DAY_NS + 1}d]))', end, max_series=3)
    return shown(got, "ts_ns", "namespace", "stream")


QUERIES["logql_scoped"] = logql_scoped
SQL["logql_scoped"] = f"WITH {_ROWS}, s AS (SELECT {_label('namespace')} AS namespace, coalesce(stream, '') AS stream, count(*)::DOUBLE AS value FROM l WHERE {_label('namespace')} IN ('checkout', 'payments') GROUP BY ALL) SELECT namespace, stream, {_ALL}, value FROM s ORDER BY namespace, stream LIMIT 3"


def logql_page(spark: SparkSession, d: str) -> DataFrame:
    """Oldest lines of a scope, redacted, within the limits of a call."""
    lines, times = of_containers(spark, d)
    first, last = span(times)
    engine = Engine(lines=lines, scope=Scope(namespaces=("checkout",)))
    got = engine.logql('{source=~".+"} |= "retry"', first, last + 1, backward=False, max_lines=100_000)
    return got.groupBy(L.value_of(F.col("labels"), "namespace").alias("namespace")).agg(F.count("*").alias("n"), F.min("ts_ns").alias("first_ns"))


QUERIES["logql_page"] = logql_page
SQL["logql_page"] = f"WITH {_ROWS}, n AS (SELECT ns FROM l WHERE {_label('namespace')} = 'checkout' AND line LIKE '%retry%' ORDER BY ns LIMIT 5000) SELECT 'checkout' AS namespace, count(*) AS n, min(ns) AS first_ns FROM n HAVING count(*) > 0"
