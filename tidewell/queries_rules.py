"""Queries of the rule and finding layer, with their SQL where there is any."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.operators.alerts import timeline, transitions
from tidewell.operators import limits
from tidewell.operators.findings import notifications, with_finding
from tidewell.plans import cel, promql
from tidewell.queries_core import FINDINGS_SQL
from tidewell.queries_promql import bucket_counts
from tidewell.sources.logs import newest_evidence
from tidewell.sources.tables import event_lines, event_samples, micros

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
RESTARTS = 'field(r, "status.restarts", 0) > 40 && !(field(r, "status.phase", "") in ["healthy", "quiet"]) && field(r, "status.ready", true) == true'


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def cel_state_rule(spark: SparkSession, d: str) -> DataFrame:
    """A state predicate on the pods of every checkpoint; a field of another type makes it incomplete."""
    rows = table(spark, d, "checkpoint_resources").dropDuplicates(["record_id", "uid"]).withColumn("uid", F.concat_ws("|", "record_id", "uid"))
    got = cel.evaluate(rows, RESTARTS, 0, kinds=("Pod",))
    return got.groupBy("namespace").agg(F.count_if(F.col("holds")).alias("hold"), F.count_if(F.col("error").isNotNull()).alias("incomplete"), F.count("*").alias("pods"))


SQL["cel_state_rule"] = """
WITH r AS (SELECT record_id, uid, namespace, json_extract(any_value(fields), '$."status.restarts"') AS n, json_extract(any_value(fields), '$."status.phase"') AS p, json_extract(any_value(fields), '$."status.ready"') AS y FROM checkpoint_resources WHERE kind = 'Pod' GROUP BY ALL),
t AS (SELECT namespace, coalesce(json_type(n), 'UBIGINT') IN ('UBIGINT', 'BIGINT', 'DOUBLE') AS number, coalesce(CASE WHEN json_type(n) IN ('UBIGINT', 'BIGINT', 'DOUBLE') THEN n::DOUBLE END, 0) > 40 AS many,
  coalesce(p::VARCHAR, '""') NOT IN ('"healthy"', '"quiet"') AND coalesce(y::VARCHAR, 'true') = 'true' AS rest FROM r)
SELECT namespace, count(*) FILTER (number AND many AND rest) AS hold, count(*) FILTER (NOT number AND rest) AS incomplete, count(*) AS pods FROM t GROUP BY namespace"""


@query
def finding_current(spark: SparkSession, d: str) -> DataFrame:
    """Current state of each finding: its last record wins."""
    s = with_finding(table(spark, d, "summary_entries"))
    last = s.groupBy("target_id", "epoch", "finding").agg(F.max(F.struct("seq", "recv_ms", "delivery_id", "state")).alias("l"), F.count("*").alias("deliveries"))
    return last.select("target_id", "epoch", "finding", "l.seq", "l.state", "deliveries")


SQL["finding_current"] = FINDINGS_SQL + "SELECT target_id, epoch, finding, max(seq) AS seq, arg_max(state, {'s': seq, 'r': recv_ms, 'd': delivery_id}) AS state, count(*) AS deliveries FROM r GROUP BY ALL"


@query
def finding_notifications(spark: SparkSession, d: str) -> DataFrame:
    """First firing of each finding above a watermark."""
    s = with_finding(table(spark, d, "summary_entries"))
    return notifications(s, 20, ["target_id", "epoch", "finding"])


SQL["finding_notifications"] = FINDINGS_SQL + "SELECT target_id, epoch, finding, min(seq) AS seq FROM r WHERE state = 'firing' AND seq > 20 GROUP BY ALL"


@query
def evidence_newest(spark: SparkSession, d: str) -> DataFrame:
    """The newest ten lines of each type of event."""
    lines = event_lines(table(spark, d, "events")).withColumn("rule_id", F.element_at("labels", F.lit("event_type")))
    return newest_evidence(lines, 10).select("rule_id", "ts_ns", "line")


SQL["evidence_newest"] = "SELECT event_type AS rule_id, epoch_us(ts) * 1000 AS ts_ns, props AS line FROM events QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) <= 10"


@query
def alert_transitions(spark: SparkSession, d: str) -> DataFrame:
    """Alerts of a PromQL rule evaluated each hour over all events: pending two hours, kept firing one."""
    events = table(spark, d, "events")
    ends = events.agg(F.floor(F.min(micros(F.col("ts"))) / 3_600_000_000).alias("a"), F.ceil(F.max(micros(F.col("ts"))) / 3_600_000_000).alias("b")).first()
    if ends["a"] is None:
        ends = {"a": 0, "b": 0}
    hour = 3_600_000
    grid = promql.Grid.of(ends["a"] * hour, ends["b"] * hour, hour)
    seen = promql.query(event_samples(events), "avg_over_time(event_value[3h]) > 55", grid)
    seen = seen.select(F.lit("high").alias("rule_id"), F.element_at("labels", F.lit("event_type")).alias("instance_key"), F.col("ts_ms").alias("eval_ms"), "value", F.lit("").alias("content"))
    ticks = spark.range(grid.count).select(F.lit("high").alias("rule_id"), (F.col("id") * hour + grid.start).alias("eval_ms"), F.lit(False).alias("incomplete"), F.lit(False).alias("flagged"), F.lit(2 * hour).cast("long").alias("for_ms"), F.lit(hour).cast("long").alias("keep_ms"))
    return transitions(timeline(seen, ticks)).select("instance_key", "transition", "eval_ms", "active_ms", "fired_ms")


SQL["alert_transitions"] = """WITH RECURSIVE s AS (SELECT event_type, epoch_us(ts) AS us, value AS v FROM events),
b AS (SELECT min(us) // 3600000000 * 3600000 AS a, (max(us) + 3599999999) // 3600000000 * 3600000 AS z FROM s), g AS (SELECT unnest(range(a, z + 1, 3600000::BIGINT)) AS t FROM b),
m AS (SELECT event_type, us // 1000 AS ms, v FROM s), o AS (SELECT event_type AS k, t FROM g JOIN m ON ms > t - 10800000 AND ms <= t GROUP BY ALL HAVING avg(v) > 55),
x AS (SELECT f.k, g.t, o.t IS NOT NULL AS seen FROM (SELECT k, min(t) AS t FROM o GROUP BY k) f JOIN g ON g.t >= f.t LEFT JOIN o ON o.k = f.k AND o.t = g.t),
w AS (SELECT k, min(t) AS t, 'pending' AS phase, min(t) AS active, NULL::BIGINT AS fired, NULL::BIGINT AS missing, NULL::VARCHAR AS told FROM o GROUP BY k
  UNION ALL SELECT x.k, x.t,
    CASE WHEN seen AND phase = 'none' THEN 'pending' WHEN seen AND x.t - active >= 7200000 THEN 'firing' WHEN seen THEN phase WHEN phase = 'firing' AND x.t - coalesce(missing, x.t) < 3600000 THEN 'firing' ELSE 'none' END,
    CASE WHEN seen AND phase = 'none' THEN x.t ELSE active END,
    CASE WHEN seen AND phase = 'none' THEN NULL WHEN seen AND phase = 'pending' AND x.t - active >= 7200000 THEN x.t ELSE fired END,
    CASE WHEN seen OR phase <> 'firing' THEN NULL ELSE coalesce(missing, x.t) END,
    CASE WHEN seen AND phase = 'pending' AND x.t - active >= 7200000 THEN 'firing' WHEN NOT seen AND phase = 'firing' AND x.t - coalesce(missing, x.t) >= 3600000 THEN 'resolved' END
  FROM w JOIN x ON x.k = w.k AND x.t = w.t + 3600000)
SELECT k AS instance_key, told AS transition, t AS eval_ms, active AS active_ms, fired AS fired_ms FROM w WHERE told IS NOT NULL"""


def prom_samples(spark: SparkSession, d: str) -> DataFrame:
    return event_samples(table(spark, d, "events")).select("labels", "ts_ms", "value")


@query
def limits_told(spark: SparkSession, d: str) -> DataFrame:
    """What a series limit and a byte limit leave out of all samples."""
    s = prom_samples(spark, d)
    sizes = s.groupBy(F.element_at("labels", F.lit("event_type")).alias("k")).agg(F.count("*").alias("n"))
    out = None
    for name, bound in (("series", {"max_series": 2, "max_samples": 10**9, "max_bytes": 10**12}), ("none", {"max_series": 99, "max_samples": 10**9, "max_bytes": 10**12}), ("bytes", {"max_series": 99, "max_samples": 10**9, "max_bytes": 100})):
        kept, told = limits.bound_series_told(s, "ts_ms", **bound)
        row = kept.agg(F.count("*").alias("kept")).crossJoin(sizes.agg(F.count("*").alias("series"))).join(told, F.lit(True), "left").select(F.lit(name).alias("case"), "kept", "series", "limit", "omitted")
        out = row if out is None else out.unionByName(row)
    return out


SQL["limits_told"] = """WITH s AS (SELECT event_type AS k, count(*) AS n FROM events GROUP BY ALL), c AS (SELECT count(*) AS all_ FROM s)
SELECT 'series' AS case, (SELECT sum(n) FROM (SELECT n FROM s ORDER BY k LIMIT 2))::BIGINT AS kept, all_ AS series, CASE WHEN all_ > 2 THEN 'series' END AS limit, CASE WHEN all_ > 2 THEN all_ - 2 END AS omitted FROM c
UNION ALL SELECT 'none', (SELECT sum(n) FROM s)::BIGINT, all_, NULL, NULL FROM c UNION ALL SELECT 'bytes', 0, all_, 'bytes', all_ FROM c"""


@query
def first_items(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers in order, as many as 40 items and 1,500 bytes of JSON take."""
    rows = table(spark, d, "supplier").select("s_suppkey", "s_name")
    return limits.bound_items(rows, [F.col("s_suppkey")], max_items=40, max_bytes=1500)


SQL["first_items"] = """WITH s AS (SELECT s_suppkey, s_name, sum(strlen('{"s_suppkey":' || s_suppkey || ',"s_name":"' || s_name || '"}')) OVER (ORDER BY s_suppkey) AS used, row_number() OVER (ORDER BY s_suppkey) AS i FROM supplier)
SELECT s_suppkey, s_name, (SELECT count(*) FROM s WHERE i <= 41 AND (i > 40 OR used > 1500)) > 0 AS limited FROM s WHERE i <= 40 AND used <= 1500"""


@query
def capped_series(spark: SparkSession, d: str) -> DataFrame:
    """Counters of each event type by tenth of a value, ten at most and none that was last seen long ago."""
    e = table(spark, d, "events").select("event_type", F.floor(F.col("value") / 2).cast("string").alias("k"), micros(F.col("ts")).alias("us"))
    low = (e.agg(F.max("us")).first()[0] or 0) - 20 * 86_400_000_000
    kept, dropped = limits.cap_cardinality(e, "event_type", "k", "us", max_series=10, expire_before=low)
    return kept.groupBy("event_type").agg(F.count("*").alias("n"), F.count_distinct("k").alias("series")).join(dropped, "event_type")


SQL["capped_series"] = """WITH e AS (SELECT event_type, floor(value / 2)::BIGINT::VARCHAR AS k, epoch_us(ts) AS us FROM events), l AS (SELECT * FROM e WHERE us >= (SELECT max(us) FROM e) - 1728000000000),
r AS (SELECT event_type, k, count(*) AS n, row_number() OVER (PARTITION BY event_type ORDER BY min(us), k) AS i FROM l GROUP BY event_type, k)
SELECT event_type, (sum(n) FILTER (i <= 10))::BIGINT AS n, count(*) FILTER (i <= 10) AS series, count(*) FILTER (i > 10) AS dropped FROM r GROUP BY event_type"""


@query
def throttled(spark: SparkSession, d: str) -> DataFrame:
    """Events of each type told once in a day at most."""
    e = table(spark, d, "events").select("event_type", F.floor(micros(F.col("ts")) / 1000).cast("long").alias("ms")).distinct()
    return limits.throttle(e, "event_type", "ms", 86_400_000).groupBy("event_type").agg(F.count("*").alias("n"), F.max("told_at").alias("last"))


SQL["throttled"] = """WITH RECURSIVE e AS (SELECT DISTINCT event_type AS k, epoch_us(ts) // 1000 AS ms FROM events), z AS (SELECT k, min(ms) AS a, max(ms) AS b FROM e GROUP BY k),
w AS (SELECT k, a AS told, 1 AS i FROM z UNION ALL SELECT w.k, CASE WHEN EXISTS (SELECT 1 FROM e WHERE e.k = w.k AND e.ms > w.told AND e.ms < w.told + 86400000) THEN w.told + 86400000 ELSE (SELECT min(e.ms) FROM e WHERE e.k = w.k AND e.ms >= w.told + 86400000) END, i + 1 FROM w JOIN z ON z.k = w.k WHERE w.told < z.b)
SELECT k AS event_type, count(*) AS n, max(told) AS last FROM w WHERE told IS NOT NULL GROUP BY k"""


@query
def scrape_reports(spark: SparkSession, d: str) -> DataFrame:
    """Reports of one scrape an hour, of which some failed."""
    s = prom_samples(spark, d).withColumn("target", F.element_at("labels", F.lit("event_type"))).withColumn("ts_ms", F.floor(F.col("ts_ms") / 3_600_000).cast("long") * 3_600_000)
    scrapes = s.select("target", "ts_ms").distinct().withColumn("duration_s", F.lit(0.5)).withColumn("error", F.when(F.col("ts_ms") / 3_600_000 % 5 == 0, "timeout"))
    kept, report = limits.scrape_report(s, scrapes, max_series=10)
    return report.groupBy("target", "name").agg(F.sum("value").alias("total"), F.count("*").alias("n"))


SQL["scrape_reports"] = """WITH s AS (SELECT event_type AS target, epoch_us(ts) // 3600000000 AS h, count(*) AS n FROM events GROUP BY ALL)
SELECT target, 'up' AS name, (count(*) FILTER (h % 5 <> 0))::DOUBLE AS total, count(*) AS n FROM s GROUP BY target UNION ALL SELECT target, 'scrape_duration_seconds', count(*) * 0.5::DOUBLE, count(*) FROM s GROUP BY target UNION ALL SELECT target, 'scrape_samples_scraped', sum(n)::DOUBLE, count(*) FROM s GROUP BY target"""


@query
def bundle_switched(spark: SparkSession, d: str) -> DataFrame:
    """Firing findings that go on, and those told stale, when a bundle drops and changes rules."""
    s = with_finding(table(spark, d, "summary_entries")).where("rule_id is not null")
    last = s.groupBy("target_id", "epoch", "finding").agg(F.max(F.struct("seq", "recv_ms", "delivery_id", "state", "rule_id")).alias("l")).select(F.col("l.rule_id").alias("rule_id"), F.concat_ws("|", "target_id", "epoch", "finding").alias("instance_key"), F.col("l.state").alias("phase"), F.lit(False).alias("stale"))
    rules = last.select("rule_id").distinct()
    n = F.length("rule_id")
    old = rules.withColumn("class", F.lit("promql")).withColumn("evaluated", F.lit(True))
    new = rules.where(n % 3 > 0).withColumn("class", F.when(n % 4 == 0, "logql").otherwise("promql")).withColumn("evaluated", n % 5 > 0)
    on, told = limits.switch_bundle(last, old, new)
    return on.select(F.lit("on").alias("what"), "rule_id").unionByName(told.select(F.lit("stale").alias("what"), "rule_id")).groupBy("what", "rule_id").agg(F.count("*").alias("n"))


SQL["bundle_switched"] = FINDINGS_SQL + """, l AS (SELECT target_id, epoch, finding, arg_max(state, {'s': seq, 'r': recv_ms, 'd': delivery_id}) AS state, arg_max(rule_id, {'s': seq, 'r': recv_ms, 'd': delivery_id}) AS rule_id FROM r WHERE rule_id IS NOT NULL GROUP BY ALL),
k AS (SELECT *, length(rule_id) % 3 > 0 AND length(rule_id) % 4 <> 0 AND length(rule_id) % 5 > 0 AS stays FROM l)
SELECT CASE WHEN stays THEN 'on' ELSE 'stale' END AS what, rule_id, count(*) AS n FROM k WHERE stays OR state = 'firing' GROUP BY ALL"""


@query
def evidence_shrunk(spark: SparkSession, d: str) -> DataFrame:
    """Evidence of each type of event within 4,000 bytes: oldest and newest stay."""
    e = table(spark, d, "events").select(F.col("event_type").alias("finding_id"), micros(F.col("ts")).alias("time_ms"), F.concat("props", F.lit("#"), F.col("event_id").cast("string")).alias("text"))
    return limits.shrink_evidence(e, 4000).groupBy("finding_id").agg(F.count("*").alias("n"), F.min("time_ms").alias("first"), F.max("time_ms").alias("last"))


SQL["evidence_shrunk"] = """WITH e AS (SELECT event_type AS k, epoch_us(ts) AS us, props || '#' || event_id AS t FROM events), r AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY us, t) AS u, row_number() OVER (PARTITION BY k ORDER BY us DESC, t DESC) AS d FROM e),
s AS (SELECT *, sum(strlen(t)) OVER (PARTITION BY k ORDER BY least(u, d), u) AS used FROM r) SELECT k AS finding_id, count(*) AS n, min(us) AS first, max(us) AS last FROM s WHERE used <= 4000 GROUP BY k"""


@query
def histogram_by_parts(spark: SparkSession, d: str) -> DataFrame:
    """A quantile of buckets summed by nodes first: each type of event is a node; the same as over all at once."""
    from tidewell.plans import promql_syntax
    from tidewell.sources.tables import label_map

    counts = bucket_counts(table(spark, d, "events").select("event_type", "value"), "event_type")
    samples = counts.select(label_map(__name__=F.lit("v_bucket"), event_type=F.col("event_type"), le=F.col("le")).alias("labels"), F.lit(0).cast("long").alias("ts_ms"), "value", F.lit(False).alias("is_stale"))
    parts, total = promql_syntax.histogram_parts(promql_syntax.parse("histogram_quantile(0.5, sum by (le) (v_bucket))"))
    nodes = None
    for name, x in parts:
        text = str(x).replace("sum by (le)", "sum by (le, event_type)")
        got = promql.query(samples, text, promql.Grid(0)).withColumn("labels", F.map_concat("labels", F.create_map(F.lit("__name__"), F.lit(name))))
        nodes = got if nodes is None else nodes.unionByName(got)
    return promql.query(nodes.withColumn("is_stale", F.lit(False)), str(total), promql.Grid(0)).select("ts_ms", F.round("value", 9).alias("value"))


SQL["histogram_by_parts"] = """WITH n AS (SELECT unnest([10, 25, 50, 75, 90]) AS le, unnest([0, 10, 25, 50, 75]) AS low FROM (SELECT 1)), k AS (SELECT le, low, (SELECT count(*) FROM events WHERE value <= le) AS upto, CASE WHEN low = 0 THEN 0 ELSE (SELECT count(*) FROM events WHERE value <= low) END AS below, (SELECT count(*) / 2.0 FROM events) AS rank FROM n)
SELECT 0::BIGINT AS ts_ms, round(coalesce(min(low + (le - low) * (rank - below) / (upto - below)) FILTER (upto >= rank AND below < rank), 90), 9)::DOUBLE AS value FROM k"""


@query
def evidence_matched(spark: SparkSession, d: str) -> DataFrame:
    """Lines of events with the first alert of their rule whose shared labels agree: alerts of one type, of any, and of another source."""
    from tidewell.plans.bundle import match_evidence
    from tidewell.sources.tables import label_map

    lines = event_lines(table(spark, d, "events")).withColumn("rule_id", F.lit("r"))
    kinds = table(spark, d, "events").select("event_type").distinct()
    one = kinds.where("event_type like 'c%'").select(F.concat(F.lit("one-"), "event_type").alias("instance_key"), F.lit(1).alias("active_ms"), label_map(event_type=F.col("event_type"), pod=F.lit("p")).alias("labels"))
    any_ = spark.range(1).select(F.lit("any").alias("instance_key"), F.lit(2).alias("active_ms"), label_map(pod=F.lit("p")).alias("labels"))
    other = spark.range(1).select(F.lit("other").alias("instance_key"), F.lit(0).alias("active_ms"), label_map(source=F.lit("elsewhere")).alias("labels"))
    alerts = one.unionByName(any_).unionByName(other).withColumn("rule_id", F.lit("r"))
    return match_evidence(lines, alerts).groupBy(F.element_at("labels", F.lit("event_type")).alias("event_type"), "instance_key").agg(F.count("*").alias("n"))


SQL["evidence_matched"] = "SELECT event_type, CASE WHEN event_type LIKE 'c%' THEN 'one-' || event_type ELSE 'any' END AS instance_key, count(*) AS n FROM events GROUP BY ALL"
