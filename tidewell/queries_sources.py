"""Sources and their functions over the driver's tables written in the sources' own formats, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.functions.redact import NAMES, PATTERNS, redact_text
from tidewell.operators.findings import dedup_key, merge_evidence
from tidewell.operators.kube import quantity
from tidewell.sources import hosts, logs, metrics
from tidewell.sources.tables import container_lines, event_lines, event_samples, micros

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
DAY_MS = 86_400_000


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def log_rows(spark: SparkSession, d: str) -> DataFrame:
    """Each row of a log file once, without carriage returns."""
    rows = table(spark, d, "docker_lines").where(F.col("log").isNotNull() & F.col("time_ns").isNotNull())
    return rows.groupBy("source", "seq").agg(F.min(F.struct("log", F.coalesce("stream", F.lit("stdout")).alias("stream"), "time_ns")).alias("r")).select("source", "seq", F.replace("r.log", F.lit("\r"), F.lit("")).alias("log"), "r.stream", "r.time_ns")


_ROWS = """r AS (SELECT source, seq, min(replace(log, chr(13), '')) AS log, min(coalesce(stream, 'stdout')) AS stream, min(time_ns) AS ns FROM docker_lines WHERE log IS NOT NULL AND time_ns IS NOT NULL GROUP BY source, seq),
s AS (SELECT *, CASE WHEN coalesce(lag(log) OVER w, chr(10)) LIKE '%' || chr(10) THEN 1 ELSE 0 END AS starts FROM r WINDOW w AS (PARTITION BY source, stream ORDER BY seq)),
n AS (SELECT *, sum(starts) OVER (PARTITION BY source, stream ORDER BY seq) AS line FROM s),
l AS (SELECT source, stream, line, min(seq) AS seq, arg_min(ns, seq) AS time_ns, rtrim(string_agg(log, '' ORDER BY seq), chr(10)) AS text FROM n GROUP BY source, stream, line)"""


def rfc3339(ns: Column) -> Column:
    """Text of a time in nanoseconds, in UTC whatever the session's zone."""
    day = F.date_format(F.date_add(F.lit("1970-01-01").cast("date"), F.floor(ns / 86_400_000_000_000).cast("int")), "yyyy-MM-dd")
    second = F.pmod(F.floor(ns / 1_000_000_000), F.lit(86_400))
    two = lambda x: F.lpad(x.cast("int").cast("string"), 2, "0")
    clock = F.concat_ws(":", two(F.floor(second / 3600)), two(F.floor(second / 60) % 60), two(second % 60))
    return F.concat(day, F.lit("T"), clock, F.lit("."), F.lpad(F.pmod(ns, F.lit(1_000_000_000)).cast("string"), 9, "0"), F.lit("Z"))


@query
def cri_lines(spark: SparkSession, d: str) -> DataFrame:
    """Log rows written as CRI lines, parsed and assembled from their partial rows."""
    rows = log_rows(spark, d)
    flag = F.when(rows["log"].endswith("\n"), "F").otherwise("P")
    raw = rows.select("source", "seq", F.concat_ws(" ", rfc3339(F.col("time_ns")), "stream", flag, F.rtrim("log", F.lit("\n"))).alias("raw"))
    parsed = raw.select(F.col("source").alias("path"), F.col("seq").alias("offset"), logs.parse_cri(F.col("raw")).alias("p")).select("path", "offset", "p.*")
    return logs.assemble(parsed).select(F.col("path").alias("source"), "stream", F.col("offset").alias("seq"), "time_ns", "text")


SQL["cri_lines"] = f"WITH {_ROWS} SELECT source, stream, seq, time_ns, text FROM l"


@query
def docker_lines_cut(spark: SparkSession, d: str) -> DataFrame:
    """Log rows written as json-file lines, parsed and assembled; lines beyond 80 bytes are cut."""
    rows = log_rows(spark, d)
    raw = rows.select("source", "seq", F.to_json(F.struct("log", "stream", rfc3339(F.col("time_ns")).alias("time"))).alias("raw"))
    parsed = raw.select(F.col("source").alias("path"), F.col("seq").alias("offset"), logs.parse_docker(F.col("raw")).alias("p")).select("path", "offset", "p.*")
    got = logs.assemble(parsed, max_bytes=80)
    return got.groupBy(F.col("path").alias("source"), "stream").agg(F.count("*").alias("n_lines"), F.count_if("truncated").alias("n_truncated"), F.sum(F.when(~F.col("truncated"), F.octet_length("text"))).alias("whole_bytes"), F.max(F.octet_length("text") <= 80).alias("within"))


SQL["docker_lines_cut"] = f"WITH {_ROWS} SELECT source, stream, count(*) AS n_lines, count(*) FILTER (strlen(text) > 80) AS n_truncated, (sum(strlen(text)) FILTER (strlen(text) <= 80))::BIGINT AS whole_bytes, true AS within FROM l GROUP BY ALL"


@query
def file_labels(spark: SparkSession, d: str) -> DataFrame:
    """Stream labels of every pod log file, from its path; enrichment does not override them."""
    files = table(spark, d, "docker_lines").select("source").distinct()
    labels = logs.pod_labels(F.col("source"), F.lit(None).cast("string"), "n1", F.create_map(F.lit("namespace"), F.lit("other"), F.lit("team"), F.lit("core")))
    named = files.select("source", labels.alias("m"))
    return named.select("source", *[F.element_at("m", F.lit(k)).alias(k) for k in ("namespace", "pod", "pod_uid", "container", "node", "team")])


_PATH = r"'/([^/_]+)_([^/_]+)_([^/_]+)/([^/]+)/(\d+)\.log'"
SQL["file_labels"] = f"SELECT DISTINCT source, nullif(regexp_extract(source, {_PATH}, 1), '') AS namespace, nullif(regexp_extract(source, {_PATH}, 2), '') AS pod, nullif(regexp_extract(source, {_PATH}, 3), '') AS pod_uid, nullif(regexp_extract(source, {_PATH}, 4), '') AS container, 'n1' AS node, 'core' AS team FROM docker_lines".replace("nullif(regexp_extract(source, " + _PATH + ", 1), '') AS namespace", "CASE WHEN regexp_extract(source, " + _PATH + ", 1) = '' THEN 'other' ELSE regexp_extract(source, " + _PATH + ", 1) END AS namespace")


@query
def host_line_times(spark: SparkSession, d: str) -> DataFrame:
    """Times of the rows read as a host's log file: their own, else that of the row before, else the file's."""
    rows = log_rows(spark, d).select(F.col("source").alias("path"), F.col("seq").alias("line_no"), F.col("log").alias("raw"), F.lit(7).cast("long").alias("mtime_ns"))
    return logs.host_lines(rows, 2026).select("path", "line_no", "ts_ns")


_OWN_ISO = r"'^(\d{4}-\d\d-\d\d)[T ](\d\d:\d\d:\d\d)(?:\.(\d+))?(Z|[+-]\d\d:\d\d)'"
SQL["host_line_times"] = f"""WITH {_ROWS.split(',' + chr(10) + 's AS')[0]},
p AS (SELECT source, seq, regexp_extract(log, {_OWN_ISO}, ['d', 't', 'f', 'z']) AS m, regexp_extract(log, '^((?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec) [ \\d]\\d \\d\\d:\\d\\d:\\d\\d)', 1) AS y FROM r),
o AS (SELECT source, seq, CASE
  WHEN m.d <> '' THEN (epoch(strptime(m.d || ' ' || m.t, '%Y-%m-%d %H:%M:%S'))::BIGINT - CASE WHEN m.z = 'Z' THEN 0 ELSE (CASE m.z[1] WHEN '-' THEN -1 ELSE 1 END) * (m.z[2:3]::INT * 3600 + m.z[5:6]::INT * 60) END) * 1000000000 + rpad(m.f, 9, '0')[1:9]::BIGINT
  WHEN y <> '' THEN epoch(strptime('2026 ' || replace(y, '  ', ' '), '%Y %b %d %H:%M:%S'))::BIGINT * 1000000000 END AS ns FROM p)
SELECT source AS path, seq AS line_no, coalesce(last_value(ns IGNORE NULLS) OVER (PARTITION BY source ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 7) AS ts_ns FROM o"""


@query
def range_newest(spark: SparkSession, d: str) -> DataFrame:
    """The newest lines of the last ten days of events, within both limits of a range read."""
    lines = event_lines(table(spark, d, "events"))
    end = lines.agg(F.max("ts_ns")).first()[0] or 0
    return logs.range_read(lines, end - 10 * DAY_MS * 10**6, end, max_lines=250, max_bytes=2000).select("ts_ns", "line", "seq")


SQL["range_newest"] = """WITH e AS (SELECT epoch_us(ts) * 1000 AS ts_ns, props AS line, event_id AS seq FROM events), z AS (SELECT max(ts_ns) AS z FROM e),
n AS (SELECT e.* FROM e, z WHERE ts_ns >= z - 864000000000000 ORDER BY ts_ns DESC, seq DESC LIMIT 250),
s AS (SELECT *, sum(strlen(line)) OVER (ORDER BY ts_ns DESC, seq DESC) AS size FROM n) SELECT ts_ns, line, seq FROM s WHERE size <= 2000"""


@query
def evidence_kept(spark: SparkSession, d: str) -> DataFrame:
    """Lines that an evidence ring keeps of each type of event: shares by weight, the oldest are evicted."""
    lines = event_lines(table(spark, d, "events")).withColumn("rule_id", F.element_at("labels", F.lit("event_type")))
    weights = lines.select("rule_id").distinct().withColumn("weight", F.length("rule_id"))
    return logs.evidence_ring(lines, weights, 6000).select("rule_id", "seq", "limited")


SQL["evidence_kept"] = """WITH e AS (SELECT event_type AS rule_id, epoch_us(ts) * 1000 AS ts_ns, strlen(props) AS size, event_id AS seq FROM events),
k AS (SELECT rule_id, floor(6000 * length(rule_id) / sum(length(rule_id)) OVER ()) AS share FROM (SELECT DISTINCT rule_id FROM e)),
u AS (SELECT e.*, sum(size) OVER (PARTITION BY e.rule_id ORDER BY ts_ns DESC, seq DESC) AS used, share FROM e JOIN k ON k.rule_id = e.rule_id WHERE size <= share),
t AS (SELECT rule_id, count(*) AS n FROM e GROUP BY ALL), kept AS (SELECT * FROM u WHERE used <= share)
SELECT kept.rule_id, seq, (SELECT count(*) FROM kept k2 WHERE k2.rule_id = kept.rule_id) < t.n AS limited FROM kept JOIN t ON t.rule_id = kept.rule_id"""


@query
def evidence_merged(spark: SparkSession, d: str) -> DataFrame:
    """Equal texts of one file merged, and kept in order of time up to a size."""
    lines = container_lines(table(spark, d, "docker_lines"))
    rows = lines.select(F.element_at("labels", F.lit("source")).alias("finding_id"), F.lit("log").alias("source"), F.col("line").alias("text"), F.lit("").alias("labels"), F.col("ts_ns").alias("time_ms"), F.lit(1).alias("n"))
    return merge_evidence(rows, 3000).groupBy("finding_id").agg(F.count("*").alias("texts"), F.sum("n").alias("n"), F.count_if("kept").alias("kept"))


SQL["evidence_merged"] = r"""WITH l AS (SELECT source, seq, any_value(rtrim(log, chr(13) || chr(10))) AS line, any_value(time_ns) AS ns FROM docker_lines WHERE log IS NOT NULL GROUP BY source, seq),
m AS (SELECT source, line, min(ns) AS first, count(*) AS n FROM l GROUP BY ALL), s AS (SELECT *, sum(strlen(line)) OVER (PARTITION BY source ORDER BY first, line ROWS UNBOUNDED PRECEDING) AS size FROM m)
SELECT source AS finding_id, count(*) AS texts, sum(n)::BIGINT AS n, count(*) FILTER (size <= 3000) AS kept FROM s GROUP BY source"""


@query
def exposition_samples(spark: SparkSession, d: str) -> DataFrame:
    """Events written in the text exposition format, parsed, and joined with the labels of their target."""
    e = table(spark, d, "events")
    raw = F.concat(F.lit('event_value{job="own",note="a \\"b\\" \\\\",event_type="'), "event_type", F.lit('"} '), F.col("value").cast("string"), F.lit(" "), F.floor(micros(F.col("ts")) / 1000).cast("string"))
    text = e.select(F.explode(F.array(F.lit("# HELP event_value x"), F.lit("broken{ 1"), raw)).alias("raw"))
    s = text.select(metrics.parse_exposition(F.col("raw"), F.lit(0).cast("long")).alias("s")).where("s is not null").select("s.*")
    target = F.create_map(F.lit("job"), F.lit("scraped"), F.lit("node"), F.lit("n1"))
    named = s.withColumn("labels", metrics.with_target(F.col("labels"), target))
    at = lambda k: F.element_at("labels", F.lit(k)).alias(k)
    return named.select(*[at(k) for k in ("__name__", "job", "exported_job", "note", "event_type", "node")], "ts_ms", "value").groupBy("__name__", "job", "exported_job", "note", "event_type", "node").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"), F.max("ts_ms").alias("newest"))


SQL["exposition_samples"] = """SELECT 'event_value' AS __name__, 'scraped' AS job, 'own' AS exported_job, 'a "b" \\' AS note, event_type, 'n1' AS node, count(*) AS n, round(sum(value), 4) AS total, max(epoch_us(ts) // 1000) AS newest FROM events GROUP BY event_type"""


@query
def family_samples(spark: SparkSession, d: str) -> DataFrame:
    """Histograms of the values of each day as samples: buckets, sum and count."""
    e = table(spark, d, "events").select("event_type", "value")
    points = F.array(*[F.struct(F.lit(float(b)).alias("at"), F.count_if(F.col("value") <= b).cast("double").alias("value")) for b in (10, 50)])
    rows = e.groupBy("event_type").agg(points.alias("points"), F.round(F.sum("value"), 4).alias("sum"), F.count("*").cast("double").alias("count"))
    rows = rows.select(F.lit("v").alias("name"), F.lit("histogram").alias("kind"), F.create_map(F.lit("event_type"), F.col("event_type")).alias("labels"), F.lit(None).cast("double").alias("value"), "sum", "count", "points")
    got = metrics.expand_family(rows)
    return got.select(*[F.element_at("labels", F.lit(k)).alias(k) for k in ("__name__", "event_type", "le")], "value")


SQL["family_samples"] = """WITH a AS (SELECT event_type, count(*) FILTER (value <= 10)::DOUBLE AS a, count(*) FILTER (value <= 50)::DOUBLE AS b, count(*)::DOUBLE AS n, round(sum(value), 4) AS s FROM events GROUP BY ALL)
SELECT 'v_bucket' AS __name__, event_type, '10' AS le, a AS value FROM a UNION ALL SELECT 'v_bucket', event_type, '50', b FROM a UNION ALL SELECT 'v_bucket', event_type, '+Inf', n FROM a
UNION ALL SELECT 'v_sum', event_type, NULL, s FROM a UNION ALL SELECT 'v_count', event_type, NULL, n FROM a"""


@query
def stale_series(spark: SparkSession, d: str) -> DataFrame:
    """Markers of the series that were there in the last hour but one and not in the last two minutes."""
    s = event_samples(table(spark, d, "events"))
    end = s.agg(F.max("ts_ms")).first()[0] or 0
    got = metrics.stale_markers(s.where(F.col("ts_ms").between(end - 7_200_000, end - 3_600_000)), s.where(F.col("ts_ms") > end - 120_000), end)
    return got.select(F.element_at("labels", F.lit("event_type")).alias("event_type"), "ts_ms", "is_stale", F.isnan("value").alias("no_number"))


SQL["stale_series"] = """WITH s AS (SELECT event_type, epoch_us(ts) // 1000 AS ms FROM events), z AS (SELECT max(ms) AS z FROM s)
SELECT DISTINCT event_type, z AS ts_ms, true AS is_stale, true AS no_number FROM s, z WHERE ms BETWEEN z - 7200000 AND z - 3600000 AND event_type NOT IN (SELECT event_type FROM s, z WHERE ms > z - 120000)"""


@query
def retained(spark: SparkSession, d: str) -> DataFrame:
    """Samples within a retention of three days and four hours behind the newest."""
    s = metrics.retain(event_samples(table(spark, d, "events")), 76 * 3_600_000)
    return s.groupBy(F.element_at("labels", F.lit("event_type")).alias("event_type")).agg(F.count("*").alias("n"), F.min("ts_ms").alias("oldest"))


SQL["retained"] = "WITH s AS (SELECT event_type, epoch_us(ts) // 1000 AS ms FROM events) SELECT event_type, count(*) AS n, min(ms) AS oldest FROM s WHERE ms >= (SELECT max(ms) FROM s) - 273600000 GROUP BY ALL"


@query
def label_index(spark: SparkSession, d: str) -> DataFrame:
    """Names of all labels, and all values of one."""
    s = event_samples(table(spark, d, "events"))
    names = metrics.label_values(s).select(F.lit("name").alias("what"), F.col("name").alias("text"))
    return names.unionByName(metrics.label_values(s, "event_type").select(F.lit("event_type").alias("what"), F.col("value").alias("text")))


SQL["label_index"] = "SELECT 'name' AS what, unnest(['__name__', 'event_type']) AS text UNION ALL SELECT DISTINCT 'event_type', event_type FROM events WHERE event_type IS NOT NULL AND event_type <> ''"


@query
def merged_sources(spark: SparkSession, d: str) -> DataFrame:
    """Samples of two sources, of which the first by name wins where both have one."""
    s = event_samples(table(spark, d, "events"))
    once = s.groupBy("labels", "ts_ms").agg(F.max("value").alias("value")).withColumn("is_stale", F.lit(False))
    other = once.where("value > 50").withColumn("value", -F.col("value")).withColumn("source", F.lit("a"))
    got = metrics.merge_sources(once.withColumn("source", F.lit("b")).unionByName(other))
    return got.groupBy(F.element_at("labels", F.lit("event_type")).alias("event_type")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


SQL["merged_sources"] = "WITH s AS (SELECT event_type, epoch_us(ts) // 1000 AS ms, max(value) AS v FROM events GROUP BY ALL) SELECT event_type, count(*) AS n, round(sum(CASE WHEN v > 50 THEN -v ELSE v END), 4) AS total FROM s GROUP BY event_type"


@query
def admitted_series(spark: SparkSession, d: str) -> DataFrame:
    """Samples of the first two series in label order."""
    s = metrics.admit_series(event_samples(table(spark, d, "events")), 2)
    return s.groupBy(F.element_at("labels", F.lit("event_type")).alias("event_type")).agg(F.count("*").alias("n"))


SQL["admitted_series"] = "SELECT event_type, count(*) AS n FROM events WHERE event_type IN (SELECT DISTINCT event_type FROM events ORDER BY event_type LIMIT 2) GROUP BY ALL"


def _secrets() -> list[Column]:
    return [
        F.lit("pwd="), F.md5("props"), F.lit(' {"api_key" : "'), F.col("event_type"), F.lit("\"} amqp://u:"), F.col("event_type"), F.lit("@mq/ Authorization: Bearer "), F.md5("props"),
        F.lit(", token "), F.md5("event_type"), F.lit(" key AKIA"), F.upper(F.substring(F.md5("props"), 1, 16)), F.lit(" x-api-key='"), F.col("event_type"), F.lit("' plain "), F.col("props"),
    ]


@query
def redacted(spark: SparkSession, d: str) -> DataFrame:
    """Texts with secrets of several kinds, redacted."""
    e = table(spark, d, "events")
    return e.select("event_id", redact_text(F.concat(*_secrets())).alias("text"))


def _redacted_sql() -> str:
    named = "(?:" + "|".join(n.replace(".", "\\.") for n in NAMES) + ")"
    rules = [*PATTERNS, (rf'(?i)("{named}"\s*:\s*")([^"]*)(")', "$1<redacted>$3"), (rf'(?i)\b({named}\s*[=:]\s*")([^"]*)(")', "$1<redacted>$3"), (rf"(?i)\b({named}\s*[=:]\s*')([^']*)(')", "$1<redacted>$3"), (rf"(?i)\b({named}\s*[=:]\s*)([^\s,;&\"'}}\]]+)", "$1<redacted>")]
    text = """'pwd=' || md5(props) || ' {"api_key" : "' || event_type || '"} amqp://u:' || event_type || '@mq/ Authorization: Bearer ' || md5(props) || ', token ' || md5(event_type) || ' key AKIA' || upper(md5(props)[1:16]) || ' x-api-key=''' || event_type || ''' plain ' || props"""
    for pattern, replacement in rules:
        for i in "123":
            replacement = replacement.replace(f"${i}", f"\\{i}")
        text = "regexp_replace(" + text + ", '" + pattern.replace("'", "''") + "', '" + replacement + "', 'g')"
    return f"SELECT event_id, {text} AS text FROM events"


SQL["redacted"] = _redacted_sql()


@query
def dedup_keys(spark: SparkSession, d: str) -> DataFrame:
    """Canonical keys of the labels of every file."""
    files = table(spark, d, "docker_lines").where("labels is not null").select(dedup_key(F.lit("rule"), F.col("labels"), ("node",)).alias("key"))
    return files.groupBy("key").agg(F.count("*").alias("n"))


SQL["dedup_keys"] = """WITH f AS (SELECT map_entries(labels) AS e FROM docker_lines WHERE labels IS NOT NULL)
SELECT 'rule{' || coalesce(array_to_string(list_transform(list_sort(list_filter(e, lambda x: x.key <> 'node')), lambda x: x.key || '=' || to_json({'v': x.value})), ','), '') || '}' AS key, count(*) AS n FROM f GROUP BY 1"""


@query
def quantities(spark: SparkSession, d: str) -> DataFrame:
    """Resource quantities with every unit, in base units."""
    units = F.element_at(F.array(*[F.lit(u) for u in ("m", "", "k", "Ki", "Mi", "G", "e2", "x")]), (F.col("l_linenumber") % 8 + 1).cast("int"))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.round(quantity(F.concat(F.col("l_quantity").cast("int").cast("string"), units)), 6).alias("value"))


SQL["quantities"] = "SELECT l_orderkey, l_linenumber, round(l_quantity::INT * CASE l_linenumber % 8 WHEN 0 THEN 0.001 WHEN 1 THEN 1 WHEN 2 THEN 1000 WHEN 3 THEN 1024 WHEN 4 THEN 1048576 WHEN 5 THEN 1000000000 WHEN 6 THEN 100 END, 6)::DOUBLE AS value FROM lineitem"


@query
def used_buckets(spark: SparkSession, d: str) -> DataFrame:
    """Used shares in tens, which stay while the share is near the last bucket."""
    percent = F.pmod(F.floor(F.col("l_extendedprice")), F.lit(101)).cast("int")
    previous = F.when(F.col("l_linenumber") > 1, (F.pmod(F.col("l_orderkey"), F.lit(10)) * 10).cast("int"))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", hosts.used_bucket(percent, previous).cast("int").alias("bucket"))


SQL["used_buckets"] = """WITH x AS (SELECT l_orderkey, l_linenumber, floor(l_extendedprice)::BIGINT % 101 AS p, CASE WHEN l_linenumber > 1 THEN l_orderkey % 10 * 10 END AS b FROM lineitem)
SELECT l_orderkey, l_linenumber, (CASE WHEN b IS NOT NULL AND p >= b - 2 AND p < b + 12 THEN b ELSE p // 10 * 10 END)::INT AS bucket FROM x"""


@query
def deb_installed(spark: SparkSession, d: str) -> DataFrame:
    """Packages from the blocks of a status file, one for each part."""
    field = lambda name, c: F.concat(F.lit(f"{name}: "), c, F.lit("\n"))
    source = F.when(F.col("p_size") > 25, F.concat(F.lit("src-"), F.col("p_size").cast("string"), F.lit(" (9.1)"))).otherwise(F.lit("plain"))
    block = F.concat(field("Package", F.replace("p_name", F.lit(" "), F.lit("-"))), field("Status", F.lit("install ok installed")), field("Version", F.concat(F.lit("1:2."), F.col("p_size").cast("string"))), field("Description", F.concat(F.lit("x\n "), F.col("p_type"))), field("Architecture", F.lit("amd64")), field("Source", source))
    return hosts.deb_packages(table(spark, d, "part").select(block.alias("value")))


SQL["deb_installed"] = """SELECT 'dpkg' AS manager, replace(p_name, ' ', '-') AS name, '1:2.' || p_size AS version, 'amd64' AS arch, 'installed' AS state,
  CASE WHEN p_size > 25 THEN 'src-' || p_size ELSE 'plain' END AS source, CASE WHEN p_size > 25 THEN '9.1' ELSE '1:2.' || p_size END AS source_version FROM part"""


@query
def packages_fit(spark: SparkSession, d: str) -> DataFrame:
    """Distinct packages of each brand as hosts, as a prefix that fits, and how many hosts share their set."""
    part = table(spark, d, "part")
    rows = part.select(F.col("p_brand").alias("host"), F.lit("dpkg").alias("manager"), F.col("p_type").alias("name"), F.col("p_size").cast("string").alias("version"), F.lit("amd64").alias("arch"), F.lit("installed").alias("state"), F.lit("s").alias("source"), F.lit("1").alias("source_version"))
    fit = hosts.normalize_packages(rows, 2000)
    return fit.groupBy("host").agg(F.count("*").alias("n"), F.max("truncated").alias("truncated"), F.max("name").alias("last"))


SQL["packages_fit"] = """WITH r AS (SELECT DISTINCT p_brand AS host, p_type AS name, p_size::VARCHAR AS version FROM part),
s AS (SELECT *, sum(strlen('{"manager":"dpkg","name":"' || name || '","version":"' || version || '","arch":"amd64","state":"installed","source":"s","source_version":"1"}')) OVER (PARTITION BY host ORDER BY name, version) AS size FROM r),
t AS (SELECT host, max(size) > 2000 AS truncated FROM s GROUP BY host) SELECT host, count(*) AS n, any_value(truncated) AS truncated, max(name) AS last FROM s JOIN t USING (host) WHERE size <= 2000 GROUP BY host"""


@query
def sockets_open(spark: SparkSession, d: str) -> DataFrame:
    """Listening sockets grouped by protocol, address and port, one row of the suppliers for each socket."""
    s = table(spark, d, "supplier")
    n = F.col("s_suppkey")
    rows = s.select(F.col("s_nationkey").cast("string").alias("host"), F.when(n % 3 == 0, "udp").otherwise("tcp6").alias("protocol"), F.when(n % 3 == 0, "UNCONN").when(n % 3 == 1, "LISTEN").otherwise("ESTAB").alias("state"), F.lit("::").alias("address"), (n % 2 + 80).cast("int").alias("port"), (n % 5).cast("int").alias("uid"), n.alias("inode"), (n * 7 % 1000).cast("int").alias("pid"))
    got = hosts.listening_sockets(rows)
    return got.select("host", "protocol", "port", F.array_join(F.transform("uids", lambda x: x.cast("string")), ",").alias("uids"), F.size("inodes").alias("inodes"), "owner_pid")


SQL["sockets_open"] = """SELECT s_nationkey::VARCHAR AS host, CASE WHEN s_suppkey % 3 = 0 THEN 'udp' ELSE 'tcp6' END AS protocol, (s_suppkey % 2 + 80)::INT AS port, array_to_string(list_sort(list(DISTINCT s_suppkey % 5)), ',') AS uids, count(DISTINCT s_suppkey)::INT AS inodes, min(s_suppkey * 7 % 1000)::INT AS owner_pid
FROM supplier WHERE s_suppkey % 3 <> 2 GROUP BY 1, 2, 3"""


@query
def image_files(spark: SparkSession, d: str) -> DataFrame:
    """Files of images after their layers, with whiteouts of files and of whole folders."""
    p = table(spark, d, "part")
    n = F.col("p_partkey")
    folder = F.concat(F.lit("d"), (n % 7).cast("string"))
    path = F.when(n % 11 == 0, F.concat(folder, F.lit("/.wh..wh..opq"))).when(n % 13 == 0, F.concat(folder, F.lit("/.wh.f"), (n % 5).cast("string"))).otherwise(F.concat(folder, F.lit("/f"), (n % 5).cast("string")))
    files = p.select(F.col("p_brand").alias("image"), (n % 6).cast("int").alias("layer"), path.alias("path"), n.alias("data")).groupBy("image", "layer", "path").agg(F.max("data").alias("data"))
    return hosts.overlay_files(files)


SQL["image_files"] = """WITH f AS (SELECT p_brand AS image, (p_partkey % 6)::INT AS layer, 'd' || p_partkey % 7 AS folder, CASE WHEN p_partkey % 11 = 0 THEN 'opq' WHEN p_partkey % 13 = 0 THEN 'wh' ELSE 'file' END AS what, 'f' || p_partkey % 5 AS name, max(p_partkey) AS data
  FROM part GROUP BY ALL),
k AS (SELECT * FROM f WHERE what = 'file' AND NOT EXISTS (SELECT 1 FROM f w WHERE w.image = f.image AND w.folder = f.folder AND w.layer > f.layer AND (w.what = 'opq' OR w.what = 'wh' AND w.name = f.name)))
SELECT image, folder || '/' || name AS path, max(layer) AS layer, arg_max(data, layer) AS data FROM k GROUP BY 1, 2"""


@query
def cpu_seconds(spark: SparkSession, d: str) -> DataFrame:
    """Seconds of each processor by mode and bytes of each device, from texts written of the suppliers."""
    n = F.col("s_suppkey")
    text = F.concat(F.lit("cpu  1 1 1 1 1 1 1 1\ncpu0 "), n.cast("string"), F.lit(" 0 "), (n * 3).cast("string"), F.lit(" 4 5 6 7 8 0 0\nintr 5"))
    net = F.concat(F.lit("Inter-| Receive\n face |bytes packets\n  eth0: "), n.cast("string"), F.lit(" 1 2 3 4 5 6 7 "), (n * 2).cast("string"), F.lit(" 9 0\n"))
    s = table(spark, d, "supplier").select(n.alias("k"), hosts.cpu_times(text).alias("c"), hosts.network_bytes(net).alias("n"))
    return s.select("k", F.size("c").cast("long").alias("modes"), F.filter("c", lambda x: x["mode"] == "system")[0]["seconds"].alias("system"), F.col("n")[0]["device"].alias("device"), F.col("n")[0]["received"].alias("received"), F.col("n")[0]["sent"].alias("sent"))


SQL["cpu_seconds"] = "SELECT s_suppkey AS k, 8::BIGINT AS modes, s_suppkey * 3 / 100.0::DOUBLE AS system, 'eth0' AS device, s_suppkey AS received, s_suppkey * 2 AS sent FROM supplier"


@query
def journal_read_on(spark: SparkSession, d: str) -> DataFrame:
    """Journal entries after a cursor half way through each file: their number, and the place of the first."""
    e = table(spark, d, "events").select(F.col("event_type").alias("__SEQNUM_ID"), F.col("event_id").cast("string").alias("__SEQNUM"), micros(F.col("ts")).cast("string").alias("__REALTIME_TIMESTAMP"), F.col("props").alias("MESSAGE"))
    half = (e.agg(F.max(F.col("__SEQNUM").cast("long"))).first()[0] or 0) // 2
    cursor = logs.journal_cursor(e.where((F.col("__SEQNUM").cast("long") <= half) & (F.col("__SEQNUM_ID") != "view")))
    left = logs.journal_after(e.unionByName(e.where("__SEQNUM_ID = 'click'")), cursor)
    return left.groupBy(F.col("__SEQNUM_ID").alias("file")).agg(F.count("*").alias("n"), F.min("place.us").alias("first_us"))


SQL["journal_read_on"] = "WITH h AS (SELECT max(event_id) // 2 AS h FROM events) SELECT event_type AS file, count(*) AS n, min(epoch_us(ts)) AS first_us FROM events, h WHERE event_type = 'view' OR event_id > h GROUP BY event_type"
