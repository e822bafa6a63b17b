"""The data-processing operators against brute force, with dirty rows."""

import json
import random

import pytest
from pyspark.sql import functions as F

from tidewell.operators.changes import apply_changes
from tidewell.operators.dedup import SeenIndex, further_copies, identifier
from tidewell.operators.hierarchy import descendants, hierarchy, paths, standing_links
from tidewell.operators.logentries import Miner, Parser, head_of, head_pattern, lcs_template, level_of, log_entries, mine_layouts, seconds_of, tokens_of
from tidewell.operators.snapshots import canonical_json, follow, snapshot_changes

OPS = "epoch string, seq long, idx int, op tinyint, uid string, fields string, removed array<string>, scope string, key string"


def replay(ops, base=()):
    """Ops in order; base: (epoch, uid, field, value)."""
    state, base_rows = {}, set()
    for e, u, f, v in base:
        state.setdefault((e, u), {})[f] = (v, None)
    for e, s, i, op, u, fields, removed in sorted({(o[0], o[1], o[2] or 0, o[3], o[4], o[5], tuple(o[6]) if o[6] is not None else None) for o in ops if None not in (o[0], o[1], o[4])}, key=lambda o: (o[1], o[2])):
        d = {}
        try:
            d = json.loads(fields) if fields else {}
        except ValueError:
            pass
        if op == 1:
            state[e, u] = {k: (v, s) for k, v in d.items() if v is not None}
        elif op == 2 and (e, u) in state:
            state[e, u].update({k: (v, s) for k, v in d.items()})
            for k in [k for k, v in d.items() if v is None] + list(removed or ()):
                state[e, u].pop(k, None)
        elif op == 3:
            state.pop((e, u), None)
    return {(e, u, f): s for (e, u), x in state.items() for f, (_, s) in x.items()}


@pytest.mark.parametrize(("seed", "batches", "with_base"), [(1, 1, False), (2, 3, False), (3, 5, True), (4, 2, True)])
def test_apply_changes(spark, seed, batches, with_base):
    r = random.Random(seed)
    ops = []
    for s in range(1, 160):
        op = r.choice([1, 2, 2, 2, 2, 3, 4])
        fields = json.dumps({f: r.choice([1, None, "x", [1]]) for f in r.sample("abcd", r.randint(0, 3))}, separators=r.choice([(",", ":"), (" , ", " : ")]))
        ops.append((r.choice(["e1", "e2"]), s // 2, s % 2, op, r.choice("uvwxy"), None if op == 3 or r.random() < 0.1 else fields, r.sample("abcd", 2) if op == 2 and r.random() < 0.4 else None, "clash", "clash"))
    ops += r.sample(ops, 40) + [(None, 1, 0, 1, "u", "{}", None, "", ""), ("e1", None, 0, 1, "u", "{}", None, "", ""), ("e1", 3, 9, 1, None, "{}", None, "", ""), ("e1", 500, 0, 2, "u", "no json", None, "", "")]
    r.shuffle(ops)
    base = [(e, u, f, "0") for e in ("e1", "e2") for u in ("u", "z") for f in "ab"] if with_base else []
    df = spark.createDataFrame(ops, OPS)
    rows = apply_changes(df, spark.createDataFrame(base, "scope string, key string, field string, value string") if with_base else None, batches=batches).collect()
    assert {(x.scope, x.key, x.field): x.set_seq for x in rows} == replay([o[:7] for o in ops], base)
    assert len({(x.scope, x.key, x.field) for x in rows}) == len(rows)


def test_apply_no_changes(spark):
    none = spark.createDataFrame([], OPS)
    assert apply_changes(none).count() == 0
    base = spark.createDataFrame([("e", "u", "f", "1")], "scope string, key string, field string, value string")
    assert [tuple(r) for r in apply_changes(none, base).collect()] == [("e", "u", "f", "1", None)]


def test_further_copies(spark):
    r = random.Random(7)
    rows = [(i, r.choice([None, *range(30)]), r.choice("abc"), r.choice(["x", "y", "z", None]), "clash") for i in range(500)] + [(1000 + i, 5, "a", "hot", "") for i in range(300)] + [(None, 5, "a", "hot", "")]
    r.shuffle(rows)
    first = {}
    for i, t, a, b, _ in sorted((x for x in rows if x[0] is not None), key=lambda x: (-1 if x[1] is None else x[1], x[0])):
        first.setdefault((a, b), i)
    df = spark.createDataFrame(rows, "n long, t long, a string, b string, id string")
    for batches in (1, 6):
        got = further_copies(df, [F.col("a"), F.col("b")], rank="t", row_id="n", batches=batches, fan_in=2)
        ids = sorted(x.n for x in got.collect())
        assert ids == sorted(x[0] for x in rows if x[0] is not None and x[0] not in first.values())
    assert further_copies(df.where("false"), [F.col("a")], rank="t", row_id="n").count() == 0


def test_index_admits_once(spark):
    index = SeenIndex(spark, prefix_bits=2, fan_in=2)
    rows = spark.range(100).select(identifier(F.col("id") % 10).alias("id"), F.col("id").alias("rank"), F.col("id").alias("row_id"))
    assert sorted(r.row_id for r in index.admit(rows).collect()) == list(range(10))
    assert index.admit(rows).count() == 0
    more = spark.range(15).select(identifier(F.col("id")).alias("id"), F.col("id").alias("rank"), F.col("id").alias("row_id"))
    assert sorted(r.row_id for r in index.admit(more).collect()) == [10, 11, 12, 13, 14]
    assert index.admit(more).count() == 0 and len(index.runs) <= 3


def test_index_persists(spark, tmp_path):
    def rows(n):
        return spark.range(n).select(identifier(F.col("id")).alias("id"), F.col("id").alias("rank"), F.col("id").alias("row_id"))

    path = str(tmp_path / "seen")
    for n, novel in ((10, 10), (25, 15), (25, 0), (30, 5), (31, 1)):
        index = SeenIndex(spark, path, prefix_bits=2, fan_in=2)  # opened anew for each batch
        assert index.admit(rows(n)).count() == novel
        index.vacuum()
    assert len(index.runs) <= 2 and index.bits == 2
    assert SeenIndex(spark, path, prefix_bits=9).bits == 2  # the manifest decides


def test_canonical_json(spark):
    same = [['{"b":1.50,"a":null}', '{"b" : 1.5}'], ["{}", None, "", '{"a":null}'], ['{"a":{"y":1,"x":[1,2.0]}}', '{"a": {"x": [1, 2], "y": 1.0}}'], ['{"a":3}'], ['{"a":"3"}'], ['{"a":[1,2]}'], ['{"a":[2,1]}'], ['{"a":"null"}'], ["no json"], ['{"a":true}']]
    same += [['{"b":[100,{"c":1e2}]}', '{"b":[1e2,{"c":100.0}]}'], ['{"n":1E7}', '{"n":10000000}', '{"n":1.0e+7}'], ['{"n":-25e-3}', '{"n":-0.025}'], ['{"n":1e25}', '{"n":10000000000000000000000000}'], ['{"n":"1e2"}'], ['{"a":1,"a":9}', '{"a":9}'], ['{"a":{"x":null}}'], ['{"a":{}}']]
    got = [{r.c for r in spark.createDataFrame([(x,) for x in g], "x string").select(canonical_json(F.nullif("x", F.lit(""))).alias("c")).collect()} for g in same]
    assert all(len(x) == 1 for x in got)
    assert len(set.union(*got)) == len(same)


def test_snapshot_changes(spark):
    ck = [("t/a/1", "t", "a", 1, None), ("t/a/5", "t", "a", 5, None), ("t/a/5", "t", "a", 5, None), ("t/b/1", "t", "b", 1, "a"), ("t/b/9", "t", "b", 9, None), ("t/c/1", "t", "c", 1, "lost"), (None, "t", "c", 2, None), ("s/a/1", "s", "a2", 1, "a")]
    res = [("t/a/1", "u", "K", None, "n", '{"x":1}'), ("t/a/1", "v", "K", "ns", "n", "{}"), ("t/a/5", "u", "K", None, "n", '{"x": 1.0, "y": null}'), ("t/a/5", "u", "K", None, "n", '{"x":1}'), ("t/a/5", "v", "K", None, "n", "{}"), ("t/a/5", "w", "K", "", "n", None)]
    res += [("t/b/9", "u", "K", None, "n", "{}"), ("t/a/5", None, "K", None, "n", "{}"), ("nowhere", "u", "K", None, "n", "{}")]
    df = spark.createDataFrame(res, "record_id string, uid string, kind string, namespace string, name string, fields string").withColumn("h", F.lit("clash"))
    pairs = follow(spark.createDataFrame(ck, "record_id string, target_id string, epoch string, seq long, prev_epoch string"))
    assert {tuple(r) for r in pairs.collect()} == {("t/a/5", "t/a/1"), ("t/b/1", "t/a/5"), ("t/b/9", "t/b/1")}
    got = snapshot_changes(pairs, df, content=[F.col("kind"), F.col("namespace"), F.col("name"), canonical_json(F.col("fields"))])
    want = {("t/a/5", "v", "changed"), ("t/a/5", "w", "added"), ("t/b/1", "u", "removed"), ("t/b/1", "v", "removed"), ("t/b/1", "w", "removed"), ("t/b/9", "u", "added")}
    assert {tuple(r) for r in got.collect()} == want
    assert snapshot_changes(pairs.where("false"), df, content=[F.col("kind")]).count() == 0


def brute_tree(parent: dict) -> dict:
    out = {}
    for n in set(parent) | set(parent.values()):
        way, x = [n], n
        while x in parent and parent[x] not in way:
            x = parent[x]
            way.append(x)
        if x not in parent:
            out[n] = (x, len(way) - 1, 0, list(reversed(way)))
        else:
            ring = way[way.index(parent[x]) :]
            out[n] = (min(ring), -1, int(n in ring), None)
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_hierarchy(spark, seed):
    r = random.Random(seed)
    parent = {f"n{i}": f"n{r.randint(max(0, i - 6), i - 1)}" for i in range(1, 60)}  # deep
    parent |= {f"h{i}": "n0" for i in range(40)}  # a hot parent
    parent |= {"c1": "c2", "c2": "c3", "c3": "c1", "c4": "c1", "c5": "c4", "c6": "c5", "c7": "c6", "c8": "c7", "c9": "c8", "s": "s", "s1": "s", "r1": "r0"}
    links = [("e", p, c) for c, p in parent.items()]
    df = spark.createDataFrame([*links, *links[:5], ("f", "n1", "n2"), (None, "a", "b"), ("e", None, "b"), ("e", "a", None)], "epoch string, uid string, to_uid string").withColumn("v", F.lit("clash"))
    nodes = hierarchy(df).cache()
    want = brute_tree(parent)
    got = {x.uid: (x.root_uid, x.depth, x.on_cycle) for x in nodes.where("scope = 'e'").collect()}
    assert got == {k: v[:3] for k, v in want.items()}
    assert {(x.uid, x.depth) for x in nodes.where("scope = 'f'").collect()} == {("n1", 0), ("n2", 1)}
    walked = {x.uid: x.path for x in paths(nodes.where("scope = 'e'"), block=8).collect()}
    assert walked == {k: v[3] for k, v in want.items() if v[3]}
    below = {(x.uid, x.descendant) for x in descendants(nodes.where("scope = 'e'")).collect()}
    assert below == {(a, k) for k, v in want.items() if v[3] for a in v[3][:-1]}
    span = {x.uid: (x.enter, x.exit) for x in nodes.where("scope = 'e' and enter is not null").collect()}
    assert all((span[a][0] < span[d][0] <= span[a][1]) == ((a, d) in below) for a in span for d in span if want[a][0] == want[d][0] and a != d)


def test_hierarchy_of_nothing(spark):
    assert hierarchy(spark.createDataFrame([], "epoch string, uid string, to_uid string")).count() == 0


def test_standing_links(spark):
    rows = [("e", 1, 0, 4, "a", "owns", "b", '{"controller":true}'), ("e", 2, 0, 4, "a", "owns", "c", '{"controller": "true"}'), ("e", 3, 1, 4, "a", "owns", "d", '{"controller" : true}'), ("e", 3, 2, 5, "a", "owns", "d", None), ("e", 4, 0, 4, "a", "owns", "f", None), ("e", 5, 0, 6, "a", "owns", "f", '{"controller":true}'), ("e", 6, 0, 4, "a", "binds", "g", '{"controller":true}'), ("e", 7, 0, 3, "b", None, None, None)]
    df = spark.createDataFrame([*rows, rows[2]], "epoch string, seq long, idx int, op tinyint, uid string, edge_type string, to_uid string, attrs string")
    assert {tuple(r) for r in standing_links(df).collect()} == {("e", "a", "b"), ("e", "a", "f")}


LOG = "source string, seq long, log string, stream string, time_ns long, labels string"


def lines(source, texts, stream="stdout", start=0):
    return [(source, start + i, t, stream, (1000 + i) * 10**9 + 5, "x") for i, t in enumerate(texts)]


def test_log_entries(spark):
    rows = lines("a.log", [f"[2026-09-05 21:26:{i:02d} +0200] [13] [ERROR] graph.query: loaded {i}\n" for i in range(8)] + ["\tat io.x.Y(Z.java:1)\n", "KeeperError: no info: here\n", "> 2026-09-05 21:26:52 WARN quoted\n", "[2026-09-05 21:27:00 +0200] [14] [WARN", "ING] spool.", "writer: cut\n"])
    rows += lines("b.log", ['{"time":"2026-09-17T13:31:09.404Z","severity":40,"component":"spool.writer","message":"m one"}\n', "{\n", '  "time": 1789651869404,\n', '  "severity": 30, "component": "a.b", "message": "two words"\n', "}\n", "see info\n"] + ['{"time":1789651869.9,"severity":"INF","component":"c.d","message":"x y"}\n'] * 3, stream=None)
    rows += lines("c.log", ["I0918 04:26:59.029844    2596 spool_writer.go:689] request\n"] * 3 + ["goroutine 1 [running]:\n", ""] + ["<157>Sep  6 09:02:03 node-295 quota.guard[913]: hi\n"] * 3, stream="stderr")
    rows += lines("d.log", ["left over\n"] + ['ts=2026-09-08T04:27:52.399+02:00 lvl=INFO logger=cache.tier msg="level=warn \\"x\\" kept"\n'] * 3 + ["active=5 over budget\n", "\r\n"])
    rows += lines("e.log", ["\x1b[1m\n"] + ["2026-09-03T15:42:19.907Z [\x1b[36mCritical\x1b[0m] auth.tokens: failed\r\n"] * 3 + ["info: a.b: word\n"] * 3 + ["tail"])
    dirty = [("a.log", None, "x\n", None, 1, ""), (None, 1, "x\n", None, 1, ""), ("b.log", 99, None, None, 1, "")]
    df = spark.createDataFrame(rows + rows[:10] + dirty, LOG)
    for parts in (1, 7):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        spark.conf.set("spark.sql.adaptive.enabled", parts == 1)
        got = {(x.source, x.first_seq): x for x in log_entries(df).collect()}
        spark.conf.set("spark.sql.shuffle.partitions", 4)
        spark.conf.set("spark.sql.adaptive.enabled", True)
        short = {k: (x.last_seq, x.entry_sec, x.level, x.component) for k, x in got.items() if x.headed}
        assert short["a.log", 7] == (10, seconds_of("2026-09-05 21:26:07 +0200"), "error", "graph.query")
        assert short["a.log", 11] == (13, seconds_of("2026-09-05 19:27:00"), "warn", "spool.writer")
        assert got["a.log", 7].message == "loaded 7\n\tat io.x.Y(Z.java:1)\nKeeperError: no info: here\n> 2026-09-05 21:26:52 WARN quoted"
        assert short["b.log", 0] == (0, 1789651869, "warn", "spool.writer")
        assert short["b.log", 1] == (5, 1789651869, "info", "a.b") and got["b.log", 1].stream is None
        assert got["b.log", 1].message == "two words\nsee info"
        assert short["c.log", 2] == (3, seconds_of("2026-09-18T04:26:59Z"), "info", "spool_writer.go")
        assert short["c.log", 4][0] == 5  # an empty row has no newline: its line goes on in the next row
        assert short["c.log", 6][1:] == (seconds_of("2026-09-06T09:02:03"), "info", "quota.guard")
        assert short["d.log", 3] == (5, seconds_of("2026-09-08T02:27:52"), "info", "cache.tier")
        assert not got["d.log", 0].headed and got["d.log", 1].message == 'level=warn "x" kept'
        assert short["e.log", 3] == (3, seconds_of("2026-09-03T15:42:19"), "fatal", "auth.tokens")
        assert short["e.log", 6] == (7, 1006, "info", "a.b")
        assert len(got) == 9 + 5 + 6 + 4 + 7, sorted(got)
    assert log_entries(df.where("false")).count() == 0


def test_templates():
    a = tokens_of("2026-09-04 12:10:18,564 ERROR [main] cart.pricing - retry 12 of x after y")
    b = tokens_of("2026-09-04 12:10:19,564 INFO  [io-worker 7] lease.keeper - retry 9 of z after w")
    merged = lcs_template(a, b)
    assert [x for x in merged if x in ("retry", "of", "after")] == ["retry", "of", "after"] and "*" in merged
    m = Miner()
    assert m.add(a) == m.add(b)
    assert head_of(m.templates[0]).replace("\x1f", "") == "<T> <L> [*] <I> - "
    p = Parser({"patterns": [head_pattern(head_of(a))], "json": False, "pairs": False, "roles": {}})
    line = "2026-09-04 12:10:18,564 CRITICAL [io-worker 7] cart.pricing - finished\n"
    assert p.parse(p.start(line), line) == (1788523818, "fatal", "cart.pricing", "finished")
    assert p.start("  last attempt 2026-09-09T21:14:57.200Z ERROR x.y: z") is None
    assert head_of(tokens_of("Caused by: io.willow.StateFault: x")) == "" and head_of(tokens_of("BillingError: watch")) == ""


def test_the_lines_before_do_not_matter():
    long, short = "<T>\x1f \x1f<L>\x1f \x1f<I>\x1f:", "<T>\x1f \x1f<L>"
    rows = ["2026-09-04 12:10:18 WARN com.acme.Foo: x\n", "2026-09-04 12:10:18 WARN plain text\n"]
    p = Parser({"patterns": [head_pattern(long), head_pattern(short)], "heads": [long, short], "json": False, "pairs": False, "roles": {}})
    for order in (rows, rows[::-1], rows * 2):
        assert {p.parse(p.start(x), x)[2] for x in order if "acme" in x} == {"com.acme.Foo"}


def test_longest_head_first(spark):
    rows = lines("a", [f"2026-09-05 21:26:{i:02d} WARN com.acme.Foo: x {i}\n" for i in range(20)]) + lines("b", [f"2026-09-05 21:26:{i:02d} WARN plain {i}\n" for i in range(20)])
    lay = mine_layouts(spark.createDataFrame(rows, LOG))
    sizes = [len(h.split("\x1f")) for h in lay["heads"]]
    assert len(sizes) == 2 and sizes == sorted(sizes, reverse=True) and lay["rejected"] == 0


def test_a_layout_that_begins_late(spark):
    """A tenth of one file, led by no other file, is a layout of its own."""
    old = [f"2026-09-05 21:{i // 60:02d}:{i % 60:02d} [WARN] cache.tier: kept {i}\n" for i in range(900)]
    new = [f"[2026-09-05 22:{i // 60:02d}:{i % 60:02d} UTC] INFO (cache.tier) moved {i}\n" for i in range(100)]
    df = spark.createDataFrame(lines("a", old + new), LOG)
    assert log_entries(df).where("headed").count() == 1000
    none = mine_layouts(df, lead=2.0)
    assert none["rejected"] == 100 and log_entries(df, layouts=none).where("headed").count() == 900
    assert log_entries(df, layouts=mine_layouts(df)).where("component = 'cache.tier'").count() == 1000


def test_long_entries_are_not_held_whole(spark):
    """Without messages, what goes on for many rows travels as one row."""
    from tidewell.operators.logentries import HELD, _cut_partition

    head = "2026-09-05 21:26:07 [WARN] cache.tier: kept\n"
    texts = ["lost\n"] * 5000 + [head] + ["\tat x\n"] * 9000 + [head] * 30 + ['{"ts":"2026-09-05T21:26:07Z",\n'] + ['"a": 1,\n'] * 4000 + ['"level":"warn"}\n', "more\n"]
    df = spark.createDataFrame(lines("a", texts), LOG)
    lay = mine_layouts(df.where("seq between 13900 and 14040")) | {"json": True, "roles": {"json": {"T": ["ts"], "L": ["level"], "I": [], "M": []}}}
    spark.conf.set("spark.sql.adaptive.enabled", False)
    for parts in (1, 5):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        got = {x.first_seq: (x.last_seq, x.level) for x in log_entries(df, layouts=lay, with_message=False).where("headed").collect()}
        assert got[5000] == (14000, "warn") and got[14001] == (14001, "warn") and len(got) == 32
        assert got[14031] == (14031 + 4002, "warn") or parts == 5 and got[14031][0] == 14031 + 4002
    spark.conf.set("spark.sql.shuffle.partitions", 4)
    spark.conf.set("spark.sql.adaptive.enabled", True)
    plain = df.select("source", "stream", "seq", "log", "time_ns").where("seq < 5000").coalesce(1).sortWithinPartitions("seq")
    from tidewell.operators.logentries import _CUT_SCHEMA

    assert plain.mapInArrow(_cut_partition(lay, False), _CUT_SCHEMA).count() <= HELD + 2


def test_stamps_and_levels():
    want = 1789960553
    for s in ["21/Sep/2026:03:15:53 +0000", "2026-09-21T03:15:53.9Z", "2026-09-21 08:45:53,123 +05:30", "Sep 21 03:15:53", "0921 03:15:53.000001", "1789960553.999", "1789960553999", 1789960553999, 1789960553.999, "2026/09/21 03:15:53", "2026-09-21 03:15:53.5 UTC"]:
        assert seconds_of(s) == want, s
    assert seconds_of("") is None and seconds_of("gibberish") is None and seconds_of(None) is None
    assert [level_of(x) for x in ("Warning", "PANIC", 40, "50", True, None, "hm", 7)] == ["warn", "fatal", "warn", "error", "", "", "", ""]


def test_layouts_of_nothing(spark):
    lay = mine_layouts(spark.createDataFrame([], LOG))
    assert lay["patterns"] == [] and not lay["json"]
