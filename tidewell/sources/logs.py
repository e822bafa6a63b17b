"""Container and host log files as lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewell.functions.redact import truncate_utf8
from tidewell.sources.tables import label_map

CRI = r"^(\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d(?:\.\d+)?(?:Z|[+-]\d\d:\d\d)) (stdout|stderr) ([FP])(?::[^ ]*)? ?(.*)$"
POD_PATH = r"/([^/_]+)_([^/_]+)_([^/_]+)/([^/]+)/(\d+)\.log"
DOCKER = "log string, stream string, time string, attrs map<string,string>"


def nanos(text: Column) -> Column:
    """Nanoseconds since the epoch of an RFC 3339 time, to the last digit."""
    whole = F.unix_seconds(F.try_to_timestamp(F.concat(F.regexp_extract(text, r"^([^.Z+]*?\d\d:\d\d:\d\d)", 1), F.regexp_extract(text, r"(Z|[+-]\d\d:\d\d)$", 1))))
    fraction = F.rpad(F.regexp_extract(text, r"\.(\d+)", 1), 9, "0")
    return whole * 1_000_000_000 + F.coalesce(F.substring(fraction, 1, 9).try_cast("long"), F.lit(0))


def parse_cri(raw: Column) -> Column:
    """STRUCT time_ns, stream, final, text of a CRI line; null if it is none."""
    made = F.struct(nanos(F.regexp_extract(raw, CRI, 1)).alias("time_ns"), F.regexp_extract(raw, CRI, 2).alias("stream"), (F.regexp_extract(raw, CRI, 3) == "F").alias("final"), F.regexp_extract(raw, CRI, 4).alias("text"))
    return F.when(raw.rlike(CRI), made)


def parse_docker(raw: Column) -> Column:
    """The same of a line of a json-file log; without a newline at its end a row is partial."""
    j = F.from_json(raw, DOCKER)
    made = F.struct(nanos(j["time"]).alias("time_ns"), j["stream"].alias("stream"), F.endswith(j["log"], F.lit("\n")).alias("final"), F.rtrim(j["log"], F.lit("\n")).alias("text"))
    return F.when(j["log"].isNotNull() & j["time"].isNotNull(), made)


def assemble(rows: DataFrame, keys: tuple[str, ...] = ("path", "stream"), order: str = "offset", max_bytes: int = 1 << 20) -> DataFrame:
    """``keys, time_ns, text, truncated``: partial rows joined until a final one; the time is that of the first.

    rows: keys, order, time_ns, final, text.  A line longer than ``max_bytes`` keeps the whole characters of its beginning.
    """
    w = Window.partitionBy(*keys).orderBy(order)
    line = F.coalesce(F.sum(F.col("final").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    groups = rows.withColumn("line_no", line).groupBy(*keys, "line_no")
    joined = groups.agg(F.min(F.struct(order, "time_ns")).alias("f"), F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col("text").alias("t")))).alias("parts"))
    text = F.array_join(F.transform("parts", lambda p: p["t"]), "")
    return joined.select(*keys, F.col(f"f.{order}").alias(order), F.col("f.time_ns").alias("time_ns"), truncate_utf8(text, max_bytes).alias("text"), (F.octet_length(text) > max_bytes).alias("truncated"))


def pod_labels(path: Column, stream: Column, node: str | None = None, more: Column | None = None) -> Column:
    """Stream labels of a pod log path; enrichment never overrides them."""
    names = ("namespace", "pod", "pod_uid", "container")
    base = label_map(**{n: F.regexp_extract(path, POD_PATH, i) for i, n in enumerate(names, 1)}, stream=stream, node=F.lit(node))
    return base if more is None else F.map_concat(F.map_filter(more, lambda k, v: ~F.map_contains_key(base, k) & v.isNotNull()), base)


def read_pod_logs(spark: SparkSession, root: str, node: str | None = None, stream: bool = False) -> DataFrame:
    """Raw rows ``path, raw`` of pod log files, compressed ones included; as a stream, new files are followed."""
    reader = spark.readStream if stream else spark.read
    return reader.format("text").option("recursiveFileLookup", True).load(root).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("raw"), F.lit(node).alias("node"))


def host_lines(rows: DataFrame, year: int, keys: tuple[str, ...] = ("path",), order: str = "line_no", mtime: str = "mtime_ns") -> DataFrame:
    """Host log lines with ``ts_ns``: of an RFC 3339 or syslog prefix, else that of the line before, else the file's."""
    iso = F.regexp_extract("raw", r"^(\d{4}-\d\d-\d\d[T ]\d\d:\d\d:\d\d(?:\.\d+)?(?:Z|[+-]\d\d:\d\d))", 1)
    syslog = F.regexp_extract("raw", r"^((?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec) [ \d]\d \d\d:\d\d:\d\d)", 1)
    padded = F.regexp_replace(syslog, "  ", " 0")
    own = F.when(iso != "", nanos(F.regexp_replace(iso, " ", "T"))).when(syslog != "", F.unix_seconds(F.try_to_timestamp(F.concat(F.lit(f"{year} "), padded), F.lit("yyyy MMM dd HH:mm:ss"))) * 1_000_000_000)
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("own_ns", own).withColumn("ts_ns", F.coalesce(F.last("own_ns", True).over(w), mtime)).drop("own_ns")


def range_read(lines: DataFrame, start_ns: int, end_ns: int, *, max_lines: int = 5000, max_bytes: int = 4 << 20) -> DataFrame:
    """Lines of the closed range, the newest kept under both limits."""
    near = lines.where(F.col("ts_ns").between(start_ns, end_ns)).orderBy(F.desc("ts_ns"), F.desc("seq")).limit(max_lines)
    size = F.sum(F.octet_length("line")).over(Window.orderBy(F.desc("ts_ns"), F.desc("seq")).rowsBetween(Window.unboundedPreceding, 0))
    return near.withColumn("size", size).where(F.col("size") <= max_bytes).drop("size")


def journal_lines(exported: DataFrame) -> DataFrame:
    """Lines of a journal exported as JSON objects: labels unit, syslog_identifier, priority, transport."""
    labels = label_map(unit=F.col("_SYSTEMD_UNIT"), syslog_identifier=F.col("SYSLOG_IDENTIFIER"), priority=F.col("PRIORITY"), transport=F.col("_TRANSPORT"))
    return exported.select(labels.alias("labels"), (F.col("__REALTIME_TIMESTAMP").cast("long") * 1000).alias("ts_ns"), F.col("MESSAGE").alias("line"), F.col("__SEQNUM").cast("long").alias("seq"))


def journal_cursor(exported: DataFrame) -> DataFrame:
    """One row ``seqnum_id, seqnum, realtime_us``: where a reader of these entries (journal exported as JSON) has come to, for each boot log."""
    place = F.struct(F.col("__SEQNUM").cast("long").alias("seqnum"), F.col("__REALTIME_TIMESTAMP").cast("long").alias("realtime_us"))
    return exported.groupBy(F.col("__SEQNUM_ID").alias("seqnum_id")).agg(F.max(place).alias("p")).select("seqnum_id", "p.*")


def journal_after(exported: DataFrame, cursor: DataFrame) -> DataFrame:
    """Entries after the cursor, each once, with their ``place`` in the order of all files: by time, then by number.

    A file whose numbering the cursor does not know is read from its start.
    """
    once = exported.dropDuplicates(["__SEQNUM_ID", "__SEQNUM"])
    known = cursor.select(F.col("seqnum_id").alias("__SEQNUM_ID"), F.col("seqnum").alias("_done"))
    left = once.join(known, "__SEQNUM_ID", "left").where(F.col("_done").isNull() | (F.col("__SEQNUM").cast("long") > F.col("_done"))).drop("_done")
    return left.withColumn("place", F.struct(F.col("__REALTIME_TIMESTAMP").cast("long").alias("us"), "__SEQNUM_ID", F.col("__SEQNUM").cast("long").alias("n")))


def newest_evidence(lines: DataFrame, n: int, key: str = "rule_id") -> DataFrame:
    """The newest n lines of each rule."""
    order = Window.partitionBy(key).orderBy(F.desc("ts_ns"), F.desc("seq"))
    return lines.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n).drop("rank")


def evidence_ring(lines: DataFrame, weights: DataFrame, ceiling: int, key: str = "rule_id") -> DataFrame:
    """Lines that a ring of ``ceiling`` bytes keeps: each rule has a share by weight, the oldest are evicted.

    A line larger than the share is never kept.  Adds ``limited``: did the rule lose lines?
    """
    total = weights.agg(F.sum("weight").alias("all_weights"))
    share = weights.crossJoin(total).select(key, F.floor(F.lit(ceiling) * F.col("weight") / F.col("all_weights")).alias("share"))
    sized = lines.join(share, key).withColumn("size", F.octet_length("line"))
    fit = sized.where("size <= share")
    newest = Window.partitionBy(key).orderBy(F.desc("ts_ns"), F.desc("seq")).rowsBetween(Window.unboundedPreceding, 0)
    kept = fit.withColumn("used", F.sum("size").over(newest)).where("used <= share")
    lost = sized.groupBy(key).agg(F.count("*").alias("all_lines")).join(kept.groupBy(key).agg(F.count("*").alias("kept_lines")), key, "left").select(key, (F.coalesce("kept_lines", F.lit(0)) < F.col("all_lines")).alias("limited"))
    return kept.join(lost, key).drop("used", "share", "size")
