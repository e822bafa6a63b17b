"""Queries that answer for all of their tables, from the first to the last row."""

from collections import Counter
from pathlib import Path

import pytest

import __spark_entry__ as entry
from tests.oracle import canon, duck
from tidewell.operators.findings import with_finding
from tidewell.operators.logentries import log_entries, mine_layouts

SMALL = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SMALL).exists(), reason="no test tables here")


def agree(spark, name, sql, sf_dir=SMALL):
    df = entry.queries()[name](spark, sf_dir)
    cols = sorted(df.columns)
    mine = Counter(repr([canon(x) for x in r]) for r in df.select(*cols).collect())
    rel = duck(sf_dir).execute(sql)
    at = [[d[0] for d in rel.description].index(c) for c in cols]
    theirs = Counter(repr([canon(r[i]) for i in at]) for r in rel.fetchall())
    assert theirs
    assert (list((mine - theirs).elements())[:5], list((theirs - mine).elements())[:5]) == ([], [])
    return mine


def test_graph_reach_starts_everywhere(spark):
    got = agree(spark, "graph_reach", entry.oracle_sql()["graph_reach"])
    starts = duck(SMALL).execute("SELECT count(DISTINCT (epoch, from_uid)) FROM (" + entry.oracle_sql()["standing_edges"] + ")").fetchone()[0]
    assert got.total() == starts == 175


def test_finding_of_a_row_without_finding_id(spark):
    rows = [(1, "t", " F1", "k", 5), (2, "t", None, "k", 5), (3, "t", "  ", "k", 5), (4, "u", None, "k", 5), (5, "t", None, None, 5)]
    got = with_finding(spark.createDataFrame(rows, "delivery_id long, target_id string, finding_id string, dedup_key string, first_seen long"))
    assert {r.delivery_id: r.finding for r in got.collect()} == {1: "f1", 2: "f1", 3: "f1", 4: "key 5 k", 5: "row 5"}


@pytest.mark.parametrize("name", ["logql_count_over_time", "promql_lookback"])
def test_grids_cover_the_table(spark, name):
    """Days counted from the table alone: the first and the last day of the events have rows."""
    unit = 10**9 if name.startswith("logql") else 10**3
    times = {r[0] // unit for r in entry.queries()[name](spark, SMALL).select("ts_ns" if unit == 10**9 else "ts_ms").distinct().collect()}
    first, last = duck(SMALL).execute("SELECT epoch(min(ts)), epoch(max(ts)) FROM events").fetchone()
    assert min(times) - first <= 86_400 and max(times) >= last


LOG = "source string, seq long, log string, stream string, time_ns long, labels string"


def log_rows(source, texts):
    return [(source, i, t, "stdout", 10**9, "x") for i, t in enumerate(texts)]


def test_keys_of_a_small_file_beside_a_large_one(spark):
    rows = log_rows("hot", ['{"main":"x","at":1789651869,"lvl":"info"}\n'] * 2100)
    rows += log_rows("small", ['{"stamp":"2026-09-17T13:31:09Z","sev":"warn","unit":"spool.writer"}\n'] * 2)
    rows += log_rows("numbers", [f'{{"t":"2026-09-17T13:31:09Z","grade":{g},"text":"a b"}}\n' for g in (10, 30, 50)])
    got = {(r.source, r.first_seq): (r.entry_sec, r.level, r.component) for r in log_entries(spark.createDataFrame(rows, LOG)).collect()}
    assert got["small", 1] == (1789651869, "warn", "spool.writer")
    assert [got["numbers", i][:2] for i in range(3)] == [(1789651869, x) for x in ("trace", "info", "error")]


def test_half_a_key_has_no_role(spark):
    rows = log_rows("a", ["level=info ts=2026-09-08T04:27:52Z msg=\"a b\"\n"] * 30 + ["vel=info msg=\"a b\"\n"])
    assert mine_layouts(spark.createDataFrame(rows, LOG))["roles"]["pairs"]["L"] == ["level"]


ACCESS = '10.1.2.3 - - [24/Sep/2026:01:52:49 -0700] "PUT /catalog/52cd34 HTTP/1.1" '


@pytest.mark.parametrize("cut", ["500 ", "500", '500 - "-" "curl"', '- 5000 "-" "curl"', ""])
def test_access_lines_without_size_or_status_are_left_out(spark, tmp_path, cut):
    """A line may be cut anywhere; one whose size or status is no number does not fail the query."""
    texts = [ACCESS + t for t in ('500 5000 "-" "curl"\n', '404 1001 "-" "curl"\n', '404 1000 "-" "curl"\n', '204 5000 "-" "curl"\n', "500 50000", f"{cut}\n")]
    rows = [("a", i, t, "stdout", 10**9, {"namespace": "x"}) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, LOG.replace("labels string", "labels map<string,string>")).write.parquet(f"{tmp_path}/docker_lines.parquet")
    got = agree(spark, "logql_pattern_status", entry.oracle_sql()["logql_pattern_status"], str(tmp_path))
    assert got == Counter(["['PUT', '404', 86400000000000, 1.0]", "['PUT', '500', 86400000000000, 2.0]"])
