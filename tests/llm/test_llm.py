"""Text operators against brute force on small fixtures."""

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidewell.llm.mixing import fit_counts, mix_sources
from tidewell.llm.packing import best_fit_decreasing, exchange, lower_bound, pack_texts, packing_report
from tidewell.llm.spans import codes_of, shared_characters, shared_spans, sliding_min, window_hashes
from tidewell.llm.tokens import with_tokens


def brute_shared(texts: dict, width: int) -> dict:
    owners: dict = {}
    for d, t in texts.items():
        for i in range(len(t or "") - width + 1):
            owners.setdefault(t[i : i + width], set()).add(d)
    out = {}
    for d, t in texts.items():
        hit = set()
        for i in range(len(t or "") - width + 1):
            if len(owners[t[i : i + width]]) > 1:
                hit.update(range(i, i + width))
        if hit:
            out[d] = len(hit)
    return out


def corpus(seed: int) -> dict:
    r = random.Random(seed)
    words = ["".join(r.choice("abcdé漢😀") for _ in range(r.randint(1, 4))) for _ in range(40)]
    blocks = [" ".join(r.choice(words) for _ in range(r.randint(5, 25))) for _ in range(6)]
    texts = {i: " ".join(r.choice(blocks) if r.random() < 0.4 else " ".join(r.choice(words) for _ in range(8)) for _ in range(r.randint(0, 6))) for i in range(30)}
    texts |= {100: None, 101: "", 102: "-" * 300, 103: "-" * 200, 104: texts[0], 105: texts[0], 106: "ab" * 200, 107: "x" + "ab" * 30}
    return texts


@pytest.mark.parametrize(("seed", "hot", "k"), [(1, 20_000, 12), (2, 0, 12), (3, 2, 30), (4, 20_000, 1), (5, 20_000, 40)])
def test_shared_spans(spark, seed, hot, k):
    texts = corpus(seed)
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").withColumn("doc", F.lit("clash")).withColumn("h", F.lit(1))
    got = {r.doc_id: r.shared_chars for r in shared_characters(shared_spans(df, width=40, k=k, hot=hot)).collect()}
    assert got == brute_shared(texts, 40)


def test_spans_of_nothing(spark):
    assert shared_spans(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_long_text_in_pieces(spark, monkeypatch):
    import tidewell.llm.spans as spans

    r = random.Random(0)
    base = "".join(r.choice("abcdefgh") for _ in range(2000))
    texts = {1: base, 2: "zz" + base[300:1500], 3: base[1900:]}
    monkeypatch.setattr(spans, "PIECE", 256)
    found = list(spans.runs(list(texts.values()), 40, 12))
    covered = {i: sum(int(e[-1]) for j, _, _, e, _ in found if j == i) for i in range(3)}
    assert covered == {0: 1961, 1: 1163, 2: 61}


def test_window_hash_is_of_content():
    codes = codes_of("abracadabra")
    h = window_hashes(codes, 4, np.uint64(0x9E3779B97F4A7C15))
    assert h[0] == h[7] and len(set(h.tolist())) == 7
    assert sliding_min(np.array([5, 3, 4, 1, 9, 9]), 3).tolist() == [3, 1, 1, 1]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 20), max_size=30))
def test_best_fit_decreasing(sizes):
    sizes = np.array(sizes, np.int64)
    bins = best_fit_decreasing(sizes, 20)
    if len(sizes):
        fill = np.bincount(bins, weights=sizes)
        assert fill.max() <= 20
        assert lower_bound(sizes, 20) <= int((fill > 0).sum())


def exact_bins(sizes, capacity):
    best = [len(sizes)]

    def go(i, bins):
        if len(bins) >= best[0]:
            return
        if i == len(sizes):
            best[0] = len(bins)
            return
        for j in range(len(bins)):
            if bins[j] + sizes[i] <= capacity:
                go(i + 1, bins[:j] + [bins[j] + sizes[i]] + bins[j + 1 :])
        go(i + 1, [*bins, sizes[i]])

    go(0, [])
    return best[0]


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(1, 12), min_size=1, max_size=8))
def test_lower_bound_never_exceeds_the_optimum(sizes):
    assert lower_bound(np.array(sizes), 12) <= exact_bins(sorted(sizes, reverse=True), 12)


def test_bound_counts_large_items():
    assert lower_bound(np.array([7, 7, 7]), 12) == 3  # the volume alone says 2


def test_pack_texts(spark):
    r = random.Random(3)
    rows = [(i, r.randint(0, 150)) for i in range(400)] + [(1000, 1030), (1001, 300), (1002, None), (None, 5)]
    df = spark.createDataFrame(rows, "doc_id long, n_tokens long").withColumn("part", F.lit("clash"))
    got = pack_texts(df, capacity=100, per_partition=50).collect()
    size = {i: n or 0 for i, n in rows if i is not None}
    by_text, fill = {}, {}
    for x in got:
        by_text[x.id] = by_text.get(x.id, 0) + x.size
        fill[x.container] = fill.get(x.container, 0) + x.size
        assert x.start == x.piece * 100
    assert by_text == size and max(fill.values()) <= 100
    assert all(fill[x.container] == x.filled for x in got)
    assert len({(x.id, x.piece) for x in got}) == len(got)
    assert sum(x.piece > 0 for x in got) == sum(max(0, -(-n // 100) - 1) for n in size.values())
    report = packing_report(pack_texts(df, capacity=100, per_partition=50), capacity=100).first()
    assert report.containers <= report.lower_bound * 1.03 + 1
    assert pack_texts(df.where("false")).count() == 0


@settings(max_examples=80, deadline=None)
@given(st.dictionaries(st.integers(1, 30), st.integers(1, 6), min_size=1, max_size=8), st.integers(0, 300), st.integers(10, 60))
def test_fit_counts(hist, budget, table):
    lengths, counts = np.array(sorted(hist)), np.array([hist[k] for k in sorted(hist)])
    take = fit_counts(lengths, counts, budget, table)
    assert (take >= 0).all() and (take <= counts).all() and int((lengths * take).sum()) <= budget
    if budget <= table:  # then the table is exact
        sums = {0}
        for n, c in hist.items():
            sums = {s + n * j for s in sums for j in range(c + 1)}
        assert int((lengths * take).sum()) == max(s for s in sums if s <= budget)


def test_exchange_meets_the_bound():
    """Falling order leaves a gap here that exchanges close."""
    sizes = np.array([6, 5, 5, 4, 4, 3, 3] + [7, 7, 3, 3, 5, 4, 3, 3, 2, 2, 6, 4])
    start, bound = best_fit_decreasing(sizes, 11), lower_bound(sizes, 11)
    got = exchange(sizes, start, 11, bound, 2000)
    fill = np.bincount(got, weights=sizes)
    assert len(got) == len(sizes) and fill.max() <= 11 and len(fill) <= int(start.max()) + 1
    r = random.Random(8)
    sizes = np.array([r.randint(1, 60) for _ in range(500)])
    start, bound = best_fit_decreasing(sizes, 100), lower_bound(sizes, 100)
    assert int(exchange(sizes, np.arange(500), 100, bound, 5000).max()) + 1 == bound
    assert (exchange(sizes, start, 100, bound, 0) == np.unique(start, return_inverse=True)[1]).all()


def test_one_partition_is_repacked(spark):
    r = random.Random(11)
    rows = [(i, r.randint(20, 60)) for i in range(1200)]
    df = spark.createDataFrame(rows, "doc_id long, n_tokens long")
    one = packing_report(pack_texts(df, capacity=100, tries=0), capacity=100).first()
    best = packing_report(pack_texts(df, capacity=100), capacity=100).first()
    assert best.lower_bound <= best.containers <= one.containers


def test_long_texts_enter_the_table():
    lengths, counts = np.array([700, 900, 1100]), np.array([3, 3, 3])
    take = fit_counts(lengths, counts, 4300, table=50)
    sums = {a * 700 + b * 900 + c * 1100 for a in range(4) for b in range(4) for c in range(4)}
    assert int((lengths * take).sum()) == max(x for x in sums if x <= 4300)


def test_mix_sources(spark):
    r = random.Random(5)
    docs = [(i, r.choice(["a", "a", "a", "b", "c"]), r.randint(0, 40)) for i in range(600)] + [(9001, None, 5), (None, "a", 5), (9002, "untargeted", 9)]
    targets = [("a", 2.0, 1), ("b", 1.0, 3), ("c", 1.0, 2), ("none", 5.0, 2), ("zero", 0.0, 1), (None, 1.0, 1)]
    df = spark.createDataFrame(docs, "doc_id long, source string, n_tokens long").withColumn("weight", F.lit("clash"))
    got = mix_sources(df, spark.createDataFrame(targets, "source string, weight double, max_repeats int")).collect()
    assert len({x.doc_id for x in got}) == len(got)
    size, cap = {i: n for i, _, n in docs}, {s: m for s, _, m in targets}
    total = sum(x.uses * x.n_tokens for x in got)
    for s, share in (("a", 0.5), ("b", 0.25), ("c", 0.25)):
        mine = [x for x in got if x.source == s]
        assert all(1 <= x.uses <= cap[s] and size[x.doc_id] == x.n_tokens for x in mine)
        tokens = sum(x.uses * x.n_tokens for x in mine)
        assert abs(tokens - share * total) <= 2 and abs(mine[0].reached_share - tokens / total) < 1e-9
        assert mine[0].target_share == share
    assert {x.source for x in got} == {"a", "b", "c"}
    assert mix_sources(df.where("false"), spark.createDataFrame(targets, "source string, weight double, max_repeats int")).count() == 0


def test_tokens(spark):
    df = spark.createDataFrame([(1, "hello world"), (2, ""), (3, None), (4, "<|endoftext|>")], "doc_id long, text string").withColumn("x", F.lit(1))
    got = {r.doc_id: r.n_tokens for r in with_tokens(df).collect()}
    assert got[1] == 2 and got[2] == got[3] == 0 and got[4] > 1
