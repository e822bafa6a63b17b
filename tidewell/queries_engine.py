"""Queries in LogQL and PromQL over the driver's tables, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.functions import labels as L
from tidewell.plans import logql, promql
from tidewell.sources.tables import container_lines, event_lines, event_samples

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
Source = Callable[[SparkSession, str], tuple[DataFrame, DataFrame]]  # lines and the times of the rows
DAY = 86_400
HOUR_NS, DAY_NS = 3600 * 10**9, DAY * 10**9
STEP_MS = 6 * 3_600_000  # of the PromQL grids; all grids run over the times of their tables


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shown(df: DataFrame, time: str, *names: str) -> DataFrame:
    """Labels as columns, values rounded."""
    return df.select(*[L.value_of(F.col("labels"), n).alias(n) for n in names], time, rounded(F.col("value")).alias("value"))


def rounded(v: Column) -> Column:
    return F.round(v, 9)


def span(times: DataFrame) -> tuple[int, int]:
    """First and last of the times in the only column; zeros if there are none."""
    first, last = times.agg(*[f(times.columns[0]) for f in (F.min, F.max)]).first()
    return (0, 0) if first is None else (first, last)


def up(time: int, step: int) -> int:
    return -(-time // step) * step


def log_metric(name: str, text: str, step: int | None, source: Source, names: tuple[str, ...], sql: str) -> None:
    """A metric query over all lines of a table: at each step, or once with ``[all]`` in whole days up to the end of the last."""

    def run(spark: SparkSession, d: str) -> DataFrame:
        lines, times = source(spark, d)
        first, last = span(times)
        end = up(last, step or DAY_NS)
        grid = logql.Grid.of(up(first, step), end, step) if step else logql.Grid(end)
        return shown(logql.metric_query(lines, text.replace("[all]", f"[{(end - first) // DAY_NS + 1}d]"), grid), "ts_ns", *names)

    QUERIES[name], SQL[name] = run, sql


def prom(name: str, text: str, names: tuple[str, ...], sql: str, offset_ms: int = 0) -> None:
    """A query each six hours until all events have been in its windows."""

    def run(spark: SparkSession, d: str) -> DataFrame:
        samples, step = event_samples(table(spark, d, "events")), STEP_MS
        first, last = span(samples.select("ts_ms"))
        return shown(promql.query(samples, text, promql.Grid.of(up(first, step), up(last + offset_ms, step), step)), "ts_ms", *names)

    QUERIES[name], SQL[name] = run, sql


def of_events(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    lines = event_lines(table(spark, d, "events"))
    return lines, lines.select("ts_ns")


def of_containers(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    rows = table(spark, d, "docker_lines")
    return container_lines(rows), rows.where(F.col("log").isNotNull()).select("time_ns")


_EVENTS = "e AS (SELECT event_type, epoch_us(ts) * 1000 AS ns, props AS line, event_id FROM events)"


def _up(time: str, step: int) -> str:
    return f"(({time}) + {step - 1}) // {step} * {step}"


def _days(step: int = DAY_NS, of: str = "e") -> str:
    """Steps from the first to the last time of a table that was named before."""
    return f"SELECT unnest(range({_up('min(ns)', step)}, {_up('max(ns)', step)} + 1, {step}::BIGINT)) AS t FROM {of}"


_ALL = f"(SELECT {_up('max(ns)', DAY_NS)} FROM l) AS ts_ns"
_ROWS = """l AS (SELECT source, seq, any_value(rtrim(log, chr(13) || chr(10))) AS line, any_value(stream) AS stream, any_value(time_ns) AS ns,
  any_value(labels) AS labels FROM docker_lines WHERE log IS NOT NULL GROUP BY source, seq)"""


def _label(name: str) -> str:
    return f"coalesce(labels['{name}'], '')"


log_metric(
    "logql_count_over_time", 'sum by (event_type) (count_over_time({source="events"} |~ "7" != "77" [1d]))', DAY_NS, of_events, ("event_type",),
    f"WITH {_EVENTS}, g AS ({_days()}) SELECT event_type, t AS ts_ns, count(*)::DOUBLE AS value FROM g JOIN e ON ns > t - 86400000000000 AND ns <= t WHERE line LIKE '%7%' AND line NOT LIKE '%77%' GROUP BY ALL",
)
log_metric(
    "logql_json_rate", 'sum by (event_type) (rate({source="events"} | json | k > 50 and k <= 90 [6h])) * 3600', 6 * HOUR_NS, of_events, ("event_type",),
    f"WITH {_EVENTS}, g AS ({_days(6 * HOUR_NS)}) SELECT event_type, t AS ts_ns, round(count(*) / 6.0, 9) AS value FROM g JOIN e ON ns > t - 21600000000000 AND ns <= t WHERE (line->>'k')::DOUBLE > 50 AND (line->>'k')::DOUBLE <= 90 GROUP BY ALL",
)
log_metric(
    "logql_topk_bytes", 'topk(2, sum by (event_type) (bytes_over_time({source="events"} [1d])))', DAY_NS, of_events, ("event_type",),
    f"WITH {_EVENTS}, g AS ({_days()}), s AS (SELECT event_type, t, sum(strlen(line))::DOUBLE AS v FROM g JOIN e ON ns > t - 86400000000000 AND ns <= t GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY t ORDER BY v DESC, event_type) AS n FROM s) SELECT event_type, t AS ts_ns, v AS value FROM r WHERE n <= 2",
)
log_metric(
    "logql_aggregations", 'max without (event_type) (avg by (event_type, source) (count_over_time({source="events", event_type!~"view|click"} [1d]))) % 100', DAY_NS, of_events, ("source",),
    f"WITH {_EVENTS}, g AS ({_days()}), s AS (SELECT event_type, t, count(*)::DOUBLE AS v FROM g JOIN e ON ns > t - 86400000000000 AND ns <= t WHERE event_type NOT IN ('view', 'click') GROUP BY ALL) SELECT 'events' AS source, t AS ts_ns, max(v) % 100 AS value FROM s GROUP BY t",
)
log_metric(
    "logql_container_errors", 'sum by (namespace, stream) (count_over_time({namespace=~".+"} |= "error" [1d])) > 1', DAY_NS, of_containers, ("namespace", "stream"),
    f"WITH {_ROWS}, g AS ({_days(of='l')}) SELECT {_label('namespace')} AS namespace, coalesce(stream, '') AS stream, t AS ts_ns, count(*)::DOUBLE AS value FROM g JOIN l ON ns > t - 86400000000000 AND ns <= t WHERE {_label('namespace')} <> '' AND line LIKE '%error%' GROUP BY ALL HAVING count(*) > 1",
)
log_metric(
    "logql_pattern_status", r'sum by (method, status) (count_over_time({source=~".+"} | pattern "<ip> - - [<_>] \"<method> <path> HTTP/<_>\" <status> <size> \"<_>" | size > 1KB | status >= 400 | __error__="" [all]))', None, of_containers, ("method", "status"),
    f"WITH {_ROWS}, p AS (SELECT ns, regexp_extract(line, '^(.*?) - - \\[.*?\\] \"(.*?) (.*?) HTTP/.*?\" (.*?) (.*?)(?: \"|$)', ['ip', 'method', 'path', 'status', 'size']) AS m FROM l) SELECT m.method AS method, m.status AS status, {_ALL}, count(*)::DOUBLE AS value FROM p WHERE try_cast(m.size AS DOUBLE) > 1000 AND try_cast(m.status AS DOUBLE) >= 400 GROUP BY ALL",
)
log_metric(
    "logql_regexp_level", r'sum by (lvl) (count_over_time({container=~"[a-m].*"} | regexp `^\d{4}-\d\d-\d\d \d\d:\d\d:\d\d,\d+ (?P<lvl>[A-Z]+)` | lvl!="" [all]))', None, of_containers, ("lvl",),
    f"WITH {_ROWS}, p AS (SELECT ns, regexp_extract(line, '^\\d{{4}}-\\d\\d-\\d\\d \\d\\d:\\d\\d:\\d\\d,\\d+ ([A-Z]+)', 1) AS lvl FROM l WHERE regexp_full_match({_label('container')}, '[a-m].*')) SELECT lvl, {_ALL}, count(*)::DOUBLE AS value FROM p WHERE lvl <> '' GROUP BY ALL",
)
log_metric(
    "logql_logfmt_level", 'sum by (lvl) (count_over_time({source=~".+"} | logfmt | lvl=~"(?i)warn.*|wrn" [all]))', None, of_containers, ("lvl",),
    f"WITH {_ROWS}, p AS (SELECT ns, regexp_extract(regexp_replace(line, '\"(\\\\.|[^\"\\\\])*\"', '\"\"', 'g'), '(?:^|\\s)lvl=([^\\s=\"]+)(?:\\s|$)', 1) AS lvl FROM l) SELECT lvl, {_ALL}, count(*)::DOUBLE AS value FROM p WHERE regexp_full_match(lvl, '(?i)warn.*|wrn') GROUP BY ALL",
)


def logql_lines(spark: SparkSession, d: str) -> DataFrame:
    """The newest lines of errors, within both limits of a log query."""
    lines, times = of_events(spark, d)
    first, last = span(times)
    got = logql.log_query(lines, '{event_type="error"} |= "9"', first, last + 1, limit=200, max_bytes=1500)
    return got.select(L.value_of(F.col("labels"), "event_type").alias("event_type"), "ts_ns", "line")


QUERIES["logql_lines"] = logql_lines
SQL["logql_lines"] = f"""WITH {_EVENTS}, n AS (SELECT * FROM e WHERE event_type = 'error' AND line LIKE '%9%' ORDER BY ns DESC, event_id DESC LIMIT 200),
s AS (SELECT *, sum(strlen(line)) OVER (ORDER BY ns DESC, event_id DESC) AS size FROM n) SELECT event_type, ns AS ts_ns, line FROM s WHERE size <= 1500"""


def _prom_rows(window_ms: int, body: str, where: str = "", offset_ms: int = 0) -> str:
    return f"""WITH s AS (SELECT event_type, epoch_us(ts) // 1000 AS ms, value AS v FROM events),
g AS (SELECT unnest(range({_up('min(ms)', STEP_MS)}, {_up(f'max(ms) + {offset_ms}', STEP_MS)} + 1, {STEP_MS}::BIGINT)) AS t FROM s),
w AS (SELECT g.t, s.* FROM g JOIN s ON s.ms > g.t - {offset_ms + window_ms} AND s.ms <= g.t - {offset_ms} {where}) {body}"""


prom("promql_lookback", "sum by (event_type) (event_value) or vector(0) * 1", ("event_type",), _prom_rows(300_000, ", l AS (SELECT event_type, t, max({'ms': ms, 'v': v}).v AS v FROM w GROUP BY ALL) SELECT event_type, t AS ts_ms, round(v, 9) AS value FROM l UNION ALL SELECT '', t, 0 FROM g"))
prom("promql_avg_over_time", "avg_over_time(event_value[12h]) > 50", ("event_type",), _prom_rows(43_200_000, "SELECT event_type, t AS ts_ms, round(avg(v), 9) AS value FROM w GROUP BY ALL HAVING avg(v) > 50"))
prom("promql_quantile_over_time", 'quantile_over_time(0.95, event_value{event_type=~"e.*|c.*"}[1d] offset 6h)', ("event_type",), _prom_rows(86_400_000, "SELECT event_type, t AS ts_ms, round(quantile_cont(v, 0.95), 9) AS value FROM w WHERE event_type SIMILAR TO 'e.*|c.*' GROUP BY ALL", offset_ms=21_600_000), offset_ms=21_600_000)
prom("promql_ratio", "count by (event_type) (event_value) / ignoring (event_type) group_left () count(event_value) + on () group_left () vector(1)", ("event_type",), _prom_rows(300_000, ", l AS (SELECT DISTINCT event_type, t FROM w) SELECT event_type, t AS ts_ms, round(1 / (count(*) OVER (PARTITION BY t)) + 1, 9) AS value FROM l"))
prom("promql_share_of_count", "sum by (event_type) (count_over_time(event_value[1d])) / scalar(sum(count_over_time(event_value[1d])))", ("event_type",), _prom_rows(86_400_000, ", l AS (SELECT event_type, t, count(*) AS n FROM w GROUP BY ALL) SELECT event_type, t AS ts_ms, round(n / sum(n) OVER (PARTITION BY t), 9) AS value FROM l"))
prom("promql_topk", "topk(2, max_over_time(event_value[6h]))", ("event_type",), _prom_rows(21_600_000, ", l AS (SELECT event_type, t, max(v) AS v FROM w GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY t ORDER BY v DESC, event_type) AS n FROM l) SELECT event_type, t AS ts_ms, round(v, 9) AS value FROM r WHERE n <= 2"))
prom("promql_changes", "changes(event_value[6h])", ("event_type",), _prom_rows(21_600_000, ", l AS (SELECT event_type, t, v, lag(v) OVER (PARTITION BY event_type, t ORDER BY ms) AS p FROM w) SELECT event_type, t AS ts_ms, (count(*) FILTER (p IS NOT NULL AND p <> v))::DOUBLE AS value FROM l GROUP BY ALL"))
prom("promql_predict_linear", "predict_linear(event_value[1d], 3600)", ("event_type",), _prom_rows(86_400_000, "SELECT event_type, t AS ts_ms, round(regr_intercept(v, (ms - t) / 1000.0) + 3600 * regr_slope(v, (ms - t) / 1000.0), 9) AS value FROM w GROUP BY ALL HAVING count(*) > 1"))
prom("promql_stddev_set", 'stddev_over_time(event_value[6h]) unless on (event_type) event_value{event_type="view"}', ("event_type",), _prom_rows(21_600_000, ", x AS (SELECT DISTINCT t FROM w WHERE event_type = 'view' AND ms > t - 300000) SELECT event_type, t AS ts_ms, round(stddev_pop(v), 9) AS value FROM w WHERE NOT (event_type = 'view' AND t IN (SELECT t FROM x)) GROUP BY ALL"))
prom(
    "promql_increase", "increase(event_value[6h])", ("event_type",),
    _prom_rows(21_600_000, """, l AS (SELECT event_type, t, ms, v, lag(v) OVER (PARTITION BY event_type, t ORDER BY ms) AS p FROM w),
a AS (SELECT event_type, t, arg_min(v, ms) AS f, arg_max(v, ms) AS z, min(ms) AS a, max(ms) AS b, count(*) AS n, coalesce(sum(p) FILTER (v < p), 0) AS r FROM l GROUP BY ALL HAVING count(*) > 1),
d AS (SELECT *, z - f + r AS c, (b - a) / 1000.0 AS s, (a - (t - 21600000)) / 1000.0 AS q0, (t - b) / 1000.0 AS q1 FROM a),
x AS (SELECT *, s / (n - 1) AS k FROM d),
y AS (SELECT *, CASE WHEN q0 >= k * 1.1 THEN k / 2 ELSE q0 END AS e0, CASE WHEN q1 >= k * 1.1 THEN k / 2 ELSE q1 END AS e1 FROM x)
SELECT event_type, t AS ts_ms, round(c * (s + CASE WHEN c > 0 AND f >= 0 AND s * f / c < e0 THEN s * f / c ELSE e0 END + e1) / s, 9) AS value FROM y"""),
)
