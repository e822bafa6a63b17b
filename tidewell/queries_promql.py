"""PromQL functions, aggregators and matching over all events, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.plans import promql, promql_syntax
from tidewell.queries_engine import STEP_MS, _prom_rows, shown, span, table, up
from tidewell.sources.tables import event_lines, event_samples, label_map, micros

QUERIES: dict = {}
SQL: dict[str, str] = {}
HOURS6, DAY = STEP_MS, 86_400_000
#: last sample of each series within five minutes of each step, as ``l (event_type, t, v)``
_LAST = ", l AS (SELECT event_type, t, arg_max(v, ms) AS v, max(ms) AS ms FROM w GROUP BY ALL)"


def prom(name: str, text: str, names: tuple[str, ...], sql: str) -> None:
    """A query each six hours until all events have been in its windows."""

    def run(spark: SparkSession, d: str) -> DataFrame:
        samples = event_samples(table(spark, d, "events"))
        first, last = span(samples.select("ts_ms"))
        return shown(promql.query(samples, text, promql.Grid.of(up(first, STEP_MS), up(last, STEP_MS), STEP_MS)), "ts_ms", *names)

    QUERIES[name], SQL[name] = run, sql


def last(body: str) -> str:
    return _prom_rows(300_000, _LAST + body)


def over(window: int, body: str) -> str:
    return _prom_rows(window, body)


def simple(value: str, where: str = "") -> str:
    return f" SELECT event_type, t AS ts_ms, round({value}, 9) AS value FROM l{where}"


_EDGES = """, p AS (SELECT event_type, t, ms, v, lag(v) OVER (PARTITION BY event_type, t ORDER BY ms) AS p, lag(ms) OVER (PARTITION BY event_type, t ORDER BY ms) AS pms FROM w),
a AS (SELECT event_type, t, arg_min(v, ms) AS f, arg_max(v, ms) AS z, min(ms) AS a, max(ms) AS b, count(*) AS n, coalesce(sum(p) FILTER (v < p), 0) AS r, arg_max(p, ms) AS lp, arg_max(pms, ms) AS lpms FROM p GROUP BY ALL HAVING count(*) > 1),
x AS (SELECT *, (b - a) / 1000.0 AS s, (b - a) / 1000.0 / (n - 1) AS k FROM a),
y AS (SELECT *, CASE WHEN (a - (t - 21600000)) / 1000.0 >= k * 1.1 THEN k / 2 ELSE (a - (t - 21600000)) / 1000.0 END AS e0, CASE WHEN (t - b) / 1000.0 >= k * 1.1 THEN k / 2 ELSE (t - b) / 1000.0 END AS e1 FROM x)"""
_RATE = "CASE WHEN z - f + r > 0 AND f >= 0 AND s * f / (z - f + r) < e0 THEN s * f / (z - f + r) ELSE e0 END"

prom("promql_rate", "rate(event_value[6h]) * 3600", ("event_type",), over(HOURS6, _EDGES + f" SELECT event_type, t AS ts_ms, round((z - f + r) * (s + {_RATE} + e1) / s / 21600 * 3600, 9) AS value FROM y"))
prom("promql_delta", "delta(event_value[6h])", ("event_type",), over(HOURS6, _EDGES + " SELECT event_type, t AS ts_ms, round((z - f) * (s + e0 + e1) / s, 9) AS value FROM y"))
prom("promql_irate", "irate(event_value[6h])", ("event_type",), over(HOURS6, _EDGES + " SELECT event_type, t AS ts_ms, round((CASE WHEN z < lp THEN z ELSE z - lp END) / ((b - lpms) / 1000.0), 9) AS value FROM y"))
prom("promql_idelta", "-idelta(event_value[6h])", ("event_type",), over(HOURS6, _EDGES + " SELECT event_type, t AS ts_ms, round(-(z - lp), 9) AS value FROM y"))
prom("promql_resets", "resets(event_value[6h])", ("event_type",), over(HOURS6, ", p AS (SELECT event_type, t, v, lag(v) OVER (PARTITION BY event_type, t ORDER BY ms) AS p FROM w) SELECT event_type, t AS ts_ms, (count(*) FILTER (v < p))::DOUBLE AS value FROM p GROUP BY ALL"))
prom("promql_deriv", "deriv(event_value[1d]) * 1000", ("event_type",), over(DAY, " SELECT event_type, t AS ts_ms, round(regr_slope(v, (ms - t) / 1000.0) * 1000, 9) AS value FROM w GROUP BY ALL HAVING count(*) > 1"))
prom("promql_one_to_one", "max_over_time(event_value[6h]) - on (event_type) min_over_time(event_value[6h])", ("event_type",), over(HOURS6, " SELECT event_type, t AS ts_ms, round(max(v) - min(v), 9) AS value FROM w GROUP BY ALL"))
prom("promql_sum_last", "sum_over_time(event_value[6h]) / ignoring (__name__) last_over_time(event_value[6h]) * present_over_time(event_value[6h]) + stdvar_over_time(event_value[6h])", ("event_type",), over(HOURS6, " SELECT event_type, t AS ts_ms, round(sum(v) / arg_max(v, ms) + var_pop(v), 9) AS value FROM w GROUP BY ALL"))
prom("promql_absent", 'absent(event_value{event_type="none"}) + on () group_right () count(event_value) or absent(event_value)', (), last(", n AS (SELECT t, count(*) AS n FROM l GROUP BY t) SELECT g.t AS ts_ms, (1 + coalesce(n.n, 0))::DOUBLE AS value FROM g LEFT JOIN n ON n.t = g.t"))
prom("promql_absent_over_time", 'absent_over_time(event_value{event_type="view"}[30s])', ("event_type",), _prom_rows(30_000, " SELECT 'view' AS event_type, t AS ts_ms, 1.0::DOUBLE AS value FROM g WHERE t NOT IN (SELECT t FROM w WHERE event_type = 'view')"))
prom("promql_spread", "quantile(0.25, event_value) + stddev(event_value) - stdvar(event_value) / (max(event_value) - min(event_value) + 1) + avg(event_value) * group(event_value)", (), last(" SELECT t AS ts_ms, round(quantile_cont(v, 0.25) + stddev_pop(v) - var_pop(v) / (max(v) - min(v) + 1) + avg(v), 9) AS value FROM l GROUP BY t"))
prom("promql_bottomk", "bottomk(2, event_value)", ("event_type",), last(", r AS (SELECT *, row_number() OVER (PARTITION BY t ORDER BY v, event_type) AS n FROM l) SELECT event_type, t AS ts_ms, round(v, 9) AS value FROM r WHERE n <= 2"))
prom("promql_count_values", 'count_values("floor", floor(event_value / 50))', ("floor",), last(" SELECT floor(v / 50)::BIGINT::VARCHAR AS floor, t AS ts_ms, count(*)::DOUBLE AS value FROM l GROUP BY ALL"))
prom("promql_label_replace", 'label_replace(event_value, "kind", "$1-${2}", "event_type", "(.)(.*)")', ("kind",), last(" SELECT event_type[1:1] || '-' || event_type[2:] AS kind, t AS ts_ms, round(v, 9) AS value FROM l"))
prom("promql_label_join", 'label_join(event_value, "kind", "/", "event_type", "none", "event_type")', ("kind",), last(" SELECT event_type || '//' || event_type AS kind, t AS ts_ms, round(v, 9) AS value FROM l"))
prom("promql_math", "clamp(event_value, 20, 60) + ceil(sqrt(abs(event_value))) - round(event_value, 5) + ln(abs(event_value) + 1) * sgn(event_value) + clamp_min(floor(exp(event_value / 100)), 2) - clamp_max(log2(abs(event_value) + 2), 3) + log10(abs(event_value) + 10)", ("event_type",), last(simple("least(60, greatest(20, v)) + ceil(sqrt(abs(v))) - floor(v * 0.2 + 0.5) / 0.2 + ln(abs(v) + 1) * sign(v) + greatest(floor(exp(v / 100)), 2) - least(log2(abs(v) + 2), 3) + log10(abs(v) + 10)")))
prom("promql_times", "hour(timestamp(event_value)) * 100 + minute(timestamp(event_value)) + day_of_week(timestamp(event_value)) * 10000 + day_of_month(timestamp(event_value)) * 100000 + month(timestamp(event_value)) * 10000000", ("event_type",), last(simple("(hour(make_timestamp(ms * 1000)) * 100 + minute(make_timestamp(ms * 1000)) + dayofweek(make_timestamp(ms * 1000)) * 10000 + dayofmonth(make_timestamp(ms * 1000)) * 100000 + month(make_timestamp(ms * 1000)) * 10000000)::DOUBLE")))
prom("promql_calendar", "day_of_year() * 1000000 + days_in_month() * 10000 + year() + time() / 3600", (), last(" SELECT t AS ts_ms, round(dayofyear(make_timestamp(t * 1000)) * 1000000 + dayofmonth(last_day(make_timestamp(t * 1000))) * 10000 + year(make_timestamp(t * 1000)) + t / 3600000, 9)::DOUBLE AS value FROM g"))
prom("promql_and", "event_value and on (event_type) (avg_over_time(event_value[5m]) > 50)", ("event_type",), _prom_rows(300_000, _LAST + ", m AS (SELECT event_type, t FROM w GROUP BY ALL HAVING avg(v) > 50) SELECT event_type, t AS ts_ms, round(v, 9) AS value FROM l SEMI JOIN m USING (event_type, t)"))
prom("promql_group_left", 'event_value * on (event_type) group_left (kind) label_replace(sum by (event_type) (event_value), "kind", "$1", "event_type", "(..).*") % 7', ("event_type", "kind"), last(" SELECT event_type, event_type[1:2] AS kind, t AS ts_ms, round(v * v % 7, 9) AS value FROM l"))
prom("promql_scalars", "(event_value >= bool 50) + scalar(count(event_value)) ^ 2 + (1 < bool 2)", ("event_type",), last(" SELECT event_type, t AS ts_ms, ((v >= 50)::INT + (count(*) OVER (PARTITION BY t)) ** 2 + 1)::DOUBLE AS value FROM l"))
prom("promql_chained", "30 <= event_value < 70 unless on (event_type) (event_value > 60)", ("event_type",), last(simple("v", " WHERE v >= 30 AND v <= 60")))
prom("promql_atan2", "event_value atan2 on (event_type) avg_over_time(event_value[5m])", ("event_type",), _prom_rows(300_000, _LAST + ", m AS (SELECT event_type, t, avg(v) AS a FROM w GROUP BY ALL) SELECT event_type, t AS ts_ms, round(atan2(v, a), 9) AS value FROM l JOIN m USING (event_type, t)"))

_HOUR = 3_600_000
prom(
    "promql_subquery", "max_over_time(sum by (event_type) (event_value)[12h:1h])", ("event_type",),
    f"""WITH s AS (SELECT event_type, epoch_us(ts) // 1000 AS ms, value AS v FROM events),
b AS (SELECT (min(ms) + {STEP_MS - 1}) // {STEP_MS} * {STEP_MS} AS a, (max(ms) + {STEP_MS - 1}) // {STEP_MS} * {STEP_MS} AS z FROM s),
h AS (SELECT unnest(range(a - 12 * {_HOUR}, z + 1, {_HOUR}::BIGINT)) AS h FROM b), g AS (SELECT unnest(range(a, z + 1, {STEP_MS}::BIGINT)) AS t FROM b),
i AS (SELECT h, event_type, arg_max(v, ms) AS v FROM h JOIN s ON ms > h - 300000 AND ms <= h GROUP BY ALL)
SELECT event_type, t AS ts_ms, round(max(v), 9) AS value FROM g JOIN i ON h > t - 12 * {_HOUR} AND h <= t GROUP BY ALL""",
)


def bucket_counts(rows: DataFrame, *keys: str) -> DataFrame:
    """``keys, le, value``: how many values are up to each bound, none included."""
    counts = [F.count_if(F.col("value") <= b).alias(str(b)) for b in (10, 25, 50, 75, 90)] + [F.count("*").alias("+Inf")]
    names = ["10", "25", "50", "75", "90", "+Inf"]
    wide = rows.groupBy(*keys).agg(*counts)
    return wide.select(*keys, F.explode(F.map_from_arrays(F.array(*[F.lit(n) for n in names]), F.array(*[F.col(f"`{n}`").cast("double") for n in names]))).alias("le", "value"))


def promql_histogram(spark: SparkSession, d: str) -> DataFrame:
    """Median of the values of the last day, from buckets counted by bound, for each type of event."""
    events = table(spark, d, "events")
    low, high = span(event_samples(events).select("ts_ms"))
    day = F.floor(micros(F.col("ts")) / (DAY * 1000))
    counts = bucket_counts(events.select("event_type", day.alias("day"), "value"), "event_type", "day")
    labels = label_map(__name__=F.lit("v_bucket"), event_type=F.col("event_type"), le=F.col("le"))
    samples = counts.select(labels.alias("labels"), ((F.col("day") + 1) * DAY).cast("long").alias("ts_ms"), "value", F.lit(False).alias("is_stale"))
    grid = promql.Grid.of(up(low, DAY), up(high, DAY), DAY)
    return shown(promql.query(samples, "histogram_quantile(0.5, sum by (event_type, le) (v_bucket))", grid), "ts_ms", "event_type")


QUERIES["promql_histogram"] = promql_histogram
SQL["promql_histogram"] = """WITH c AS (SELECT event_type, (epoch_us(ts) // 86400000000 + 1) * 86400000 AS t, value AS v FROM events),
n AS (SELECT event_type, t, unnest([10, 25, 50, 75, 90]) AS le, unnest([0, 10, 25, 50, 75]) AS low, count(*) FILTER (v <= 10) AS a, count(*) FILTER (v <= 25) AS b, count(*) FILTER (v <= 50) AS c, count(*) FILTER (v <= 75) AS d, count(*) FILTER (v <= 90) AS e, count(*) / 2.0 AS rank FROM c GROUP BY event_type, t),
k AS (SELECT *, CASE le WHEN 10 THEN a WHEN 25 THEN b WHEN 50 THEN c WHEN 75 THEN d ELSE e END AS upto, CASE le WHEN 10 THEN 0 WHEN 25 THEN a WHEN 50 THEN b WHEN 75 THEN c ELSE d END AS below FROM n),
f AS (SELECT * FROM k WHERE upto >= rank QUALIFY row_number() OVER (PARTITION BY event_type, t ORDER BY le) = 1)
SELECT x.event_type, x.t AS ts_ms, round(coalesce(f.low + (f.le - f.low) * (f.rank - f.below) / nullif(f.upto - f.below, 0), CASE WHEN f.le IS NULL THEN 90 ELSE f.le END), 9) AS value
FROM (SELECT DISTINCT event_type, t FROM c) x LEFT JOIN f ON f.event_type = x.event_type AND f.t = x.t"""


def promql_instant(spark: SparkSession, d: str) -> DataFrame:
    """One instant at the end of the events: the reach of the query decides which samples are read."""
    samples = event_samples(table(spark, d, "events"))
    _, at = span(samples.select("ts_ms"))
    text = "sort_desc(avg_over_time(event_value[2d] offset 1d))"
    reach = promql_syntax.reach(promql_syntax.parse(text))
    near = samples.where(F.col("ts_ms") > at - reach)
    return shown(promql.query(near, text, promql.Grid(at)), "ts_ms", "event_type")


QUERIES["promql_instant"] = promql_instant
SQL["promql_instant"] = """WITH s AS (SELECT event_type, epoch_us(ts) // 1000 AS ms, value AS v FROM events), z AS (SELECT max(ms) AS z FROM s)
SELECT event_type, z AS ts_ms, round(avg(v), 9) AS value FROM s, z WHERE ms > z - 3 * 86400000 AND ms <= z - 86400000 GROUP BY ALL"""


def promql_scoped(spark: SparkSession, d: str) -> DataFrame:
    """A query after a scope was injected: its matchers narrow every selector."""
    from tidewell.plans.logql_syntax import Matcher

    samples = event_samples(table(spark, d, "events"))
    first, last_ms = span(samples.select("ts_ms"))
    scoped = promql_syntax.inject_scope("count(event_value) + on () sum(count_over_time(event_value[1h]))", [Matcher("event_type", "=~", "c.*|view")])
    return shown(promql.query(samples, str(scoped), promql.Grid.of(up(first, STEP_MS), up(last_ms, STEP_MS), STEP_MS)), "ts_ms")


QUERIES["promql_scoped"] = promql_scoped
SQL["promql_scoped"] = _prom_rows(3_600_000, ", k AS (SELECT * FROM w WHERE event_type LIKE 'c%' OR event_type = 'view') SELECT t AS ts_ms, (count(*) + count(DISTINCT event_type) FILTER (ms > t - 300000))::DOUBLE AS value FROM k GROUP BY t HAVING count(*) FILTER (ms > t - 300000) > 0")


def promql_stale(spark: SparkSession, d: str) -> DataFrame:
    """Series end where their target went: a stale marker after each day's last event hides the value that the lookback would find."""
    samples = event_samples(table(spark, d, "events"))
    first, end = span(samples.select("ts_ms"))
    ends = samples.groupBy("labels", F.floor(F.col("ts_ms") / DAY).alias("day")).agg((F.max("ts_ms") + 1).alias("ts_ms"))
    marked = samples.unionByName(ends.select("labels", "ts_ms", F.lit(float("nan")).alias("value"), F.lit(True).alias("is_stale")))
    return shown(promql.query(marked, "event_value or count_over_time(event_value[5m]) * 0 - 1", promql.Grid.of(up(first, HOURS6), up(end, HOURS6), HOURS6)), "ts_ms", "event_type")


QUERIES["promql_stale"] = promql_stale
SQL["promql_stale"] = _prom_rows(300_000, ", m AS (SELECT event_type, max(ms) AS ms FROM s GROUP BY event_type, ms // 86400000), l AS (SELECT w.event_type, w.t, arg_max(w.v, w.ms) AS v, max(w.ms) AS ms FROM w GROUP BY ALL) SELECT l.event_type, l.t AS ts_ms, CASE WHEN m.ms IS NOT NULL AND l.ms < l.t THEN -1 ELSE round(l.v, 9) END AS value FROM l LEFT JOIN m ON m.event_type = l.event_type AND m.ms = l.ms")
