"""Log entries, and the SQL that they must agree with: one pattern for each layout of the test tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.operators.logentries import LETTERS, LEVELS, SYSLOG, log_entries

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


@query
def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = log_entries(spark.read.parquet(f"{sf_dir}/docker_lines.parquet"), with_message=False)
    return entries.where("headed").select("source", "first_seq", "last_seq", "entry_sec", "level", "component")


@query
def p2_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The message of every entry, with the lines that follow its header."""
    entries = log_entries(spark.read.parquet(f"{sf_dir}/docker_lines.parquet"))
    return entries.where("headed").select("source", "stream", "first_seq", "message")


# layouts: name, pattern up to the message, and the groups that hold stamp, level and component (0: none)
_ISO = r"\d{4}-\d\d-\d\d[T ]\d\d:\d\d:\d\d(?:[.,]\d+)?(?: ?(?:Z|UTC|[+-]\d\d:?\d\d))?"
_WORD, _NAME = r"([A-Za-z]+)", r"([\w-]+(?:\.[\w-]+)+)"
_LAYOUTS = [
    ("bracket", rf"\[({_ISO})\] +\[[^\[\]]*\] +\[{_WORD}\] +{_NAME}: +", 1, 2, 3),
    ("dash", rf"({_ISO}) +{_WORD} +\[[^\[\]]*\] +{_NAME} +- +", 1, 2, 3),
    ("access", r"\d+\.\d+\.\d+\.\d+ - - \[(\d\d/\w{3}/\d{4}:\d\d:\d\d:\d\d [+-]\d{4})\] ", 1, 0, 0),
    ("round", rf"\[({_ISO})\] +{_WORD} +\({_NAME}\) +", 1, 2, 3),
    ("nameFirst", rf"({_ISO}) +\[{_NAME}\] +{_WORD}: +", 1, 3, 2),
    ("levelFirst", rf"({_ISO}) +\[{_WORD}\] +{_NAME}: +", 1, 2, 3),
    ("bar", rf"\[{_WORD} *\] +{_NAME} +\| +", 0, 1, 2),
    ("slash", rf"(\d{{4}}/\d\d/\d\d \d\d:\d\d:\d\d) +{_NAME}: +{_WORD} ", 1, 3, 2),
    ("pipe", rf"(\d{{10,13}}(?:\.\d+)?)\|{_WORD}\|{_NAME}\|", 1, 2, 3),
    ("klog", r"([A-Z])(\d{4} \d\d:\d\d:\d\d\.\d+) +\d+ ([\w-]+(?:\.[\w-]+)+):", 2, 1, 3),
    ("plain", rf"{_WORD}: {_NAME}: ", 0, 1, 2),
    ("syslog", r"<(\d{1,3})>([A-Z][a-z]{2} [ \d]\d \d\d:\d\d:\d\d) +[\w-]+-\d+ +([\w-]+(?:\.[\w-]+)+)", 2, 1, 3),
]


def _text(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def _cases(pairs: dict, of: str) -> str:
    by: dict[str, list] = {}
    for k, v in pairs.items():
        by.setdefault(v, []).append(str(k))
    return "CASE " + " ".join("WHEN {} IN ({}) THEN '{}'".format(of, ", ".join(f"'{k}'" for k in ks), v) for v, ks in by.items()) + " ELSE '' END"


def _key(*names: str) -> str:
    return "coalesce(" + ", ".join(f"nullif(json_extract(o, '$.\"{n}\"'), 'null'::JSON)" for n in names) + ")"


def _pair(*names: str, of: str = "other") -> str:
    """Value of a key=value pair; ``other`` is the line without its message, which may hold pairs of its own."""
    one = "regexp_extract(" + of + ", '(?:^|\\s){}=(\"(?:\\\\.|[^\"\\\\])*\"|[^\\s\"]*)', 1)"
    return "coalesce(" + ", ".join("nullif(" + one.format(n) + ", '')" for n in names) + ", '')"


_ZONE = r"regexp_extract(z, '([+-])(\d\d):?(\d\d)$', ['s', 'h', 'm'])"
_SHIFT = f"coalesce(CASE WHEN {_ZONE}.s = '' THEN 0 ELSE (CASE {_ZONE}.s WHEN '-' THEN -1 ELSE 1 END) * ({_ZONE}.h::INT * 3600 + {_ZONE}.m::INT * 60) END, 0)"
_SECONDS = rf"""CASE
  WHEN regexp_matches(z, '^\d{{4}}[-/]\d\d[-/]\d\d') THEN epoch(try_strptime(replace(z[1:10], '/', '-') || ' ' || z[12:19], '%Y-%m-%d %H:%M:%S'))::BIGINT - CASE WHEN length(z) > 19 THEN {_SHIFT} ELSE 0 END
  WHEN regexp_matches(z, '^\d\d/') THEN epoch(try_strptime(z[1:20], '%d/%b/%Y:%H:%M:%S'))::BIGINT - {_SHIFT}
  WHEN regexp_matches(z, '^[A-Z]') THEN epoch(try_strptime('2026 ' || regexp_replace(z, ' +', ' ', 'g'), '%Y %b %d %H:%M:%S'))::BIGINT
  WHEN regexp_matches(z, '^\d{{4}} ') THEN epoch(try_strptime('2026' || z[1:13], '%Y%m%d %H:%M:%S'))::BIGINT
  WHEN regexp_matches(z, '^\d{{13}}') THEN z[1:10]::BIGINT
  WHEN regexp_matches(z, '^\d+') THEN regexp_extract(z, '^\d+')::BIGINT END"""
_LEVEL_WORDS = "(" + ", ".join(f"'{w}'" for w in LEVELS) + ")"
_GROUPS = "['a', 'b', 'c']"
_HEADS = " ".join(
    f"WHEN regexp_matches(t, {_text('^' + p)})" + (f" AND lower(regexp_extract(t, {_text('^' + p)}, {level})) IN {_LEVEL_WORDS}" if level and name not in ("klog", "syslog") else "") + f" THEN '{name}'"
    for name, p, _, level, _ in _LAYOUTS
)


def _part(index: int) -> str:
    return "CASE layout " + " ".join(f"WHEN '{row[0]}' THEN regexp_extract(t, {_text('^' + row[1])}, {row[index]})" for row in _LAYOUTS if row[index]) + " ELSE '' END"


_AFTER = "CASE layout " + " ".join(f"WHEN '{row[0]}' THEN substr(whole, length(regexp_extract(whole, {_text('^' + row[1])})) + 1)" for row in _LAYOUTS) + " END"
_PAIRS = r'^(?:[A-Za-z_@][\w.@-]*=(?:"(?:\\.|[^"\\])*"|[^\s"]*)(?:\s+|$))+$'
_ENTRIES = f"""
WITH r AS (SELECT source, coalesce(stream, '') AS stream, seq, any_value(log) AS log, any_value(time_ns) AS ns FROM docker_lines WHERE source IS NOT NULL AND seq IS NOT NULL AND log IS NOT NULL GROUP BY ALL),
s AS (SELECT *, CASE WHEN coalesce(lag(log) OVER w, chr(10)) LIKE '%' || chr(10) THEN 1 ELSE 0 END AS starts FROM r WINDOW w AS (PARTITION BY source, stream ORDER BY seq)),
n AS (SELECT *, sum(starts) OVER (PARTITION BY source, stream ORDER BY seq) AS line FROM s),
l AS (SELECT source, stream, line, min(seq) AS first_seq, max(seq) AS last_seq, arg_min(ns, seq) AS ns, string_agg(log, '' ORDER BY seq) AS text FROM n GROUP BY ALL),
c AS (SELECT *, regexp_replace(text, '\\x1b\\[[0-9;]*m', '', 'g') AS t, rtrim(regexp_replace(text, '\\x1b\\[[0-9;]*m', '', 'g'), chr(13) || chr(10)) AS bare FROM l),
h AS (SELECT *, CASE WHEN regexp_matches(text, '^\\{{\\s*("|\\}}|$)') THEN 'json' {_HEADS}
    WHEN regexp_matches(bare, {_text(_PAIRS)}) AND regexp_matches(bare, '(^|\\s)(t|ts|time|lvl|level|severity)=') THEN 'pairs' END AS layout FROM c),
e AS (SELECT *, sum(CASE WHEN layout IS NOT NULL THEN 1 ELSE 0 END) OVER (PARTITION BY source, stream ORDER BY line) AS entry FROM h),
g AS (SELECT source, stream, entry, min(first_seq) AS first_seq, max(last_seq) AS last_seq, arg_min(ns, line) AS ns, arg_min(layout, line) AS layout, arg_min(t, line) AS t, arg_min(bare, line) AS bare,
    string_agg(text, '' ORDER BY line) AS raw, string_agg(t, '' ORDER BY line) AS whole FROM e WHERE entry > 0 GROUP BY source, stream, entry),
j AS (SELECT *, CASE WHEN layout = 'json' THEN CASE WHEN json_valid(bare) THEN bare ELSE regexp_extract(raw, '(?s)^\\{{.*?\\n\\}}') END END AS object FROM g),
o AS (SELECT *, CASE WHEN json_valid(object) THEN object::JSON END AS o, regexp_replace(bare, 'msg="(\\\\.|[^"\\\\])*"', '') AS other FROM j),
p AS (SELECT *,
    CASE layout WHEN 'json' THEN json_extract_string({_key('@timestamp', 'ts', 'time')}, '$') WHEN 'pairs' THEN trim({_pair('time', 'ts', 't')}, '"') ELSE {_part(2)} END AS z,
    CASE layout WHEN 'json' THEN json_extract_string({_key('lvl', 'level', 'severity')}, '$') WHEN 'pairs' THEN trim({_pair('severity', 'level', 'lvl')}, '"') ELSE {_part(3)} END AS v,
    coalesce(CASE layout WHEN 'json' THEN json_extract_string({_key('module', 'logger', 'component')}, '$') WHEN 'pairs' THEN trim({_pair('module', 'component', 'logger')}, '"') ELSE {_part(4)} END, '') AS component FROM o)
"""
SQL["p2_found"] = _ENTRIES + f"""SELECT source, first_seq, last_seq, coalesce({_SECONDS}, ns // 1000000000) AS entry_sec,
  CASE layout WHEN 'klog' THEN {_cases(LETTERS, 'v')} WHEN 'syslog' THEN {_cases({str(k): x for k, x in SYSLOG.items()}, "(v::INT % 8)::VARCHAR")}
    ELSE CASE v WHEN '10' THEN 'trace' WHEN '20' THEN 'debug' WHEN '30' THEN 'info' WHEN '40' THEN 'warn' WHEN '50' THEN 'error' WHEN '60' THEN 'fatal' ELSE {_cases(LEVELS, 'lower(v)')} END END AS level,
  component FROM p"""
SQL["p2_messages"] = _ENTRIES + f"""SELECT source, nullif(stream, '') AS stream, first_seq, CASE layout
  WHEN 'json' THEN CASE WHEN o IS NULL THEN raw ELSE trim(coalesce(json_extract_string({_key('event', 'msg', 'message')}, '$'), '') || chr(10) || trim(substr(raw, length(object) + 1), chr(13) || chr(10)), chr(10)) END
  WHEN 'pairs' THEN trim(coalesce(json_extract_string(CASE WHEN {_pair('msg', of='bare')} LIKE '"%' THEN {_pair('msg', of='bare')} ELSE to_json({_pair('msg', of='bare')}) END, '$'), '') || chr(10) || CASE WHEN raw LIKE '%' || chr(10) || '%' THEN substr(raw, strpos(raw, chr(10)) + 1) ELSE '' END, chr(13) || chr(10))
  ELSE trim({_AFTER}, chr(13) || chr(10)) END AS message FROM p"""
