"""Long spans that appear verbatim in more than one text.

Windows of ``width`` code points are compared.  Consecutive windows that share a
minimiser (the least hash of their ``k``-mers) travel as one packed string, a
super-k-mer, to the bucket of that minimiser, where sorting the windows counts
them exactly.

1. Each text sends the minimisers of its runs; those that occur once cannot
   belong to a shared window.  What is left is kept as a bitmap of fixed size,
   which is the only thing broadcast; a full bitmap costs work, never rows.
2. Runs whose minimiser is in the bitmap are packed.  Equal strings are
   aggregated on the map side, so copies and boilerplate shrink at once.
3. Buckets sort their windows.  A bucket with more than ``hot`` code points is not
   put into one task: its windows are grouped over the cluster, first by their
   hashes, then those whose hashes more than one text has by their content.
4. The shared windows of each text are united and their code points counted.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewell.workspace import Workspace

PIECE = 1 << 18  # code points that are hashed at a time
BITS = 1 << 26  # of the bitmap of minimisers: 8 MB, whatever the input
_B1, _B2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)  # odd multipliers


def _mix(x: np.ndarray) -> np.ndarray:
    """Bijective scrambling of 64-bit words."""
    x = x ^ (x >> np.uint64(31))
    x *= np.uint64(0x7FB5D329728EA185)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x81DADEF4BC2DD44D)
    x ^= x >> np.uint64(33)
    return x


def _power(base: np.uint64, n: int) -> np.uint64:
    return np.uint64(pow(int(base), n, 1 << 64))


def window_hashes(codes: np.ndarray, n: int, base: np.uint64) -> np.ndarray:
    """Polynomial hash of every n consecutive codes, by doubling: h(a+b) = h(a) * base^b + h(b)."""
    h, length, done, width = _mix(codes.astype(np.uint64) + base), 1, None, 0
    while True:
        if n & length:
            if done is None:
                done, width = h, length
            else:
                m = len(codes) - width - length + 1
                done = done[:m] * _power(base, length) + h[width : width + m]
                width += length
        if width == n:
            return done
        m = len(h) - length
        if m <= 0:
            return np.empty(0, np.uint64)
        h = h[:m] * _power(base, length) + h[length : length + m]
        length *= 2


def sliding_min(x: np.ndarray, n: int) -> np.ndarray:
    """Least of every n consecutive values."""
    length = 1
    while length * 2 <= n:
        x = np.minimum(x[:-length], x[length:])
        length *= 2
    return x if length == n else np.minimum(x[: len(x) - (n - length)], x[n - length :])


def codes_of(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def runs(texts: list[str], width: int, k: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """(text number, offset of the piece, starts, ends, minimisers) of runs of windows; starts and ends count windows.

    Long texts are cut into pieces that overlap by ``width - 1``, short ones are
    hashed together; a window lies in exactly one piece.
    """
    pieces: list[tuple[int, int, np.ndarray]] = []
    size = 0

    def flush():
        codes = np.concatenate([c for _, _, c in pieces])
        least = sliding_min(_mix(window_hashes(codes, k, _B1)), width - k + 1)
        at = 0
        for i, off, c in pieces:
            mine = least[at : at + len(c) - width + 1]
            cut = np.flatnonzero(mine[1:] != mine[:-1]) + 1
            starts = np.concatenate(([0], cut))
            yield i, off, starts, np.concatenate((cut, [len(mine)])), mine[starts]
            at += len(c)

    for i, text in enumerate(texts):
        if text is None or len(text) < width:
            continue
        codes = codes_of(text)
        for off in range(0, len(codes) - width + 1, PIECE):
            piece = codes[off : off + PIECE + width - 1]
            pieces.append((i, off, piece))
            size += len(piece)
            if size >= PIECE:
                yield from flush()
                pieces, size = [], 0
    if pieces:
        yield from flush()


def _minimisers(width: int, k: int):
    def scan(batches):
        for batch in batches:
            found, last, own = [], -1, []
            for i, _, _, _, h in runs(batch.column(0).to_pylist(), width, k):
                if i != last and own:
                    found.append(np.unique(np.concatenate(own)))
                    own = []
                last = i
                own.append(h)
            if own:
                found.append(np.unique(np.concatenate(own)))
            h = np.concatenate(found).view(np.int64) if found else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(h)], names=["h"])

    return scan


def _packed(width: int, k: int, bitmap):
    def scan(batches):
        bits = np.frombuffer(bitmap.value, np.uint8)
        for batch in batches:
            texts, ids = batch.column(1).to_pylist(), batch.column(0).to_pylist()
            doc, pos, packed, hs = [], [], [], []
            for i, off, starts, ends, h in runs(texts, width, k):
                slot = h & np.uint64(BITS - 1)
                hit = np.flatnonzero(bits[slot >> np.uint64(3)] >> (slot & np.uint64(7)).astype(np.uint8) & 1)
                for j in hit.tolist():
                    a = off + int(starts[j])
                    doc.append(ids[i])
                    pos.append(a)
                    packed.append(texts[i][a : off + int(ends[j]) + width - 1])
                    hs.append(int(h[j].view(np.int64)))
                    if len(doc) == 20_000:
                        yield pa.RecordBatch.from_pydict({"doc": doc, "pos": pos, "h": hs, "s": packed}, schema=_PACKED)
                        doc, pos, packed, hs = [], [], [], []
            yield pa.RecordBatch.from_pydict({"doc": doc, "pos": pos, "h": hs, "s": packed}, schema=_PACKED)

    return scan


_PACKED = pa.schema([("doc", pa.int64()), ("pos", pa.int64()), ("h", pa.int64()), ("s", pa.string())])
_SHARED = pa.schema([("u", pa.int64()), ("a", pa.int64()), ("b", pa.int64())])


def _window_index(strings: list[str], width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(codes, start of each window, its string, hash, second hash) of all windows of the strings."""
    codes = codes_of("".join(strings))
    lengths = np.fromiter(map(len, strings), np.int64, len(strings))
    counts = lengths - width + 1
    owner = np.repeat(np.arange(len(strings)), counts)
    first = np.concatenate(([0], np.cumsum(lengths)[:-1]))
    inside = np.arange(len(owner)) - np.repeat(np.concatenate(([0], np.cumsum(counts)[:-1])), counts)
    start = first[owner] + inside
    return codes, start, owner, window_hashes(codes, width, _B1)[start], window_hashes(codes, width, _B2)[start]


def _same(codes: np.ndarray, a: np.ndarray, b: np.ndarray, width: int) -> bool:
    """Are the windows at a and at b the same, code by code?"""
    view = np.lib.stride_tricks.sliding_window_view(codes, width)
    return all(np.array_equal(view[a[i : i + 4096]], view[b[i : i + 4096]]) for i in range(0, len(a), 4096))


def shared_windows(strings: list[str], low: np.ndarray, high: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(string, first, last window) of maximal runs of windows whose texts are more than one.

    low, high: least and greatest text in which each string occurs.
    """
    codes, start, owner, h1, h2 = _window_index(strings, width)
    order = np.lexsort((h2, h1))
    s1, s2 = h1[order], h2[order]
    fresh = np.concatenate(([True], (s1[1:] != s1[:-1]) | (s2[1:] != s2[:-1])))
    again = np.flatnonzero(~fresh)
    if not _same(codes, start[order[again]], start[order[again - 1]], width):  # two hashes met: sort the texts themselves
        text = [codes[a : a + width].tobytes() for a in start]
        order = np.array(sorted(range(len(text)), key=text.__getitem__))
        fresh = np.array([True] + [text[order[i]] != text[order[i - 1]] for i in range(1, len(order))])
    heads = np.flatnonzero(fresh)
    group = np.cumsum(fresh) - 1
    two = np.minimum.reduceat(low[owner[order]], heads) != np.maximum.reduceat(high[owner[order]], heads)
    hit = np.zeros(len(owner), bool)
    hit[order] = two[group]
    edge = np.concatenate(([True], owner[1:] != owner[:-1]))
    begins = np.flatnonzero(hit & (edge | ~np.concatenate(([False], hit[:-1]))))
    stops = np.flatnonzero(hit & (np.concatenate((edge[1:], [True])) | ~np.concatenate((hit[1:], [False]))))
    base = np.flatnonzero(edge)[np.cumsum(edge) - 1]
    return owner[begins], begins - base[begins], stops - base[stops]


def _buckets(width: int, most: int = 1 << 20):
    """Sorts the windows of whole buckets; rows (u, h, s, lo, hi) come sorted by h."""

    def work(rows):
        strings = [r[2] for r in rows]
        i, a, b = shared_windows(strings, np.array([r[3] for r in rows]), np.array([r[4] for r in rows]), width)
        u = np.array([r[0] for r in rows], np.int64)
        return pa.RecordBatch.from_arrays([pa.array(u[i]), pa.array(a), pa.array(b)], schema=_SHARED)

    def scan(batches):
        ready, size, bucket, h = [], 0, [], None
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if row[1] != h:
                    if len(bucket) > 1 or bucket and bucket[0][3] != bucket[0][4]:
                        ready += bucket
                        size += sum(len(r[2]) for r in bucket)
                    bucket, h = [], row[1]
                    if size >= most:
                        yield work(ready)
                        ready, size = [], 0
                bucket.append(row)
        if len(bucket) > 1 or bucket and bucket[0][3] != bucket[0][4]:
            ready += bucket
        if ready:
            yield work(ready)

    return scan


def _exploded(width: int):
    """(u, a, w1, w2, lo, hi): every window of the strings of a hot bucket."""

    def scan(batches):
        for batch in batches:
            u, _, strings, lo, hi = (c.to_pylist() for c in batch.columns)
            for i in range(0, len(u), 2000):
                part = strings[i : i + 2000]
                _, _, owner, h1, h2 = _window_index(part, width)
                edge = np.concatenate(([True], owner[1:] != owner[:-1]))
                inside = np.arange(len(owner)) - np.flatnonzero(edge)[np.cumsum(edge) - 1]
                take = owner + i
                yield pa.RecordBatch.from_arrays([pa.array(np.array(u)[take]), pa.array(inside), pa.array(h1.view(np.int64)), pa.array(h2.view(np.int64)), pa.array(np.array(lo)[take]), pa.array(np.array(hi)[take])], names=["u", "a", "w1", "w2", "lo", "hi"])

    return scan


def shared_spans(docs: DataFrame, *, id_column: str = "doc_id", text_column: str = "text", width: int = 160, k: int = 48, hot: int = 1 << 22) -> DataFrame:
    """``doc, first, last`` (code points, both inside): maximal shared spans of each text, not overlapping.

    docs: ``id_column`` a unique BIGINT; other columns are ignored.

    Defined results: null, empty and short texts and rows with a null id have no
    spans; a span repeated only within one text does not count; two rows with the
    same text share all of it; an empty table gives none.
    """
    if not 1 <= k <= width:
        raise ValueError("k must be from 1 to width")
    spark = docs.sparkSession
    ws = Workspace(spark)
    texts = docs.select(F.col(id_column).cast("long").alias("doc"), F.col(text_column).alias("text")).where(F.col("doc").isNotNull() & (F.length("text") >= width))
    often = texts.select("text").mapInArrow(_minimisers(width, k), "h long").groupBy("h").agg(F.count("*").alias("n")).where("n > 1")
    slot = F.col("h").bitwiseAND(F.lit(BITS - 1)) + 1
    blocks = often.groupBy(F.bitmap_bucket_number(slot).alias("block")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(slot)).alias("bits"))
    bitmap = bytearray(BITS // 8)
    for r in blocks.collect():  # at most BITS / 32768 rows of 4 KB
        bitmap[(r["block"] - 1) * 4096 : r["block"] * 4096] = r["bits"].ljust(4096, b"\0")
    shared_bitmap = spark.sparkContext.broadcast(bytes(bitmap))

    packed = ws.write(texts.mapInArrow(_packed(width, k, shared_bitmap), "doc long, pos long, h long, s string"), "packed")
    strings = packed.groupBy("h", "s").agg(F.min("doc").alias("lo"), F.max("doc").alias("hi"))
    strings = ws.write(strings.withColumn("u", F.monotonically_increasing_id()), "strings")
    several = strings.groupBy("h").agg(F.sum(F.length("s")).alias("n"), F.min("lo").alias("l"), F.max("hi").alias("m")).where("l <> m").select("h", (F.col("n") > hot).alias("is_hot"))
    left = ws.write(strings.join(several, "h").select("u", "h", "s", "lo", "hi", "is_hot"), "buckets")
    columns = ["u", "h", "s", "lo", "hi"]
    found = left.where("not is_hot").select(*columns).repartition("h").sortWithinPartitions("h").mapInArrow(_buckets(width), "u long, a long, b long")
    windows = left.where("is_hot").select(*columns).mapInArrow(_exploded(width), "u long, a long, w1 long, w2 long, lo long, hi long")
    wide = windows.groupBy("w1", "w2").agg(F.min("lo").alias("l"), F.max("hi").alias("m")).where("l <> m").select("w1", "w2")
    alike = windows.join(wide, ["w1", "w2"], "left_semi").join(left.where("is_hot").select("u", "s"), "u")
    alike = ws.write(alike.select("w1", "w2", F.substring("s", F.col("a") + 1, F.lit(width)).alias("w"), "u", "a", "lo", "hi"), "alike")
    equal = alike.groupBy("w1", "w2", "w").agg(F.min("lo").alias("l"), F.max("hi").alias("m")).where("l <> m").select("w1", "w2", "w")
    found = found.unionByName(alike.join(equal, ["w1", "w2", "w"], "left_semi").select("u", "a", F.col("a").alias("b")))
    at = packed.join(strings.select("h", "s", "u"), ["h", "s"]).select("u", "doc", "pos").join(found, "u")
    spans = at.select("doc", (F.col("pos") + F.col("a")).alias("first"), (F.col("pos") + F.col("b") + width - 1).alias("last"))
    order = Window.partitionBy("doc").orderBy("first", "last")
    reach = F.max("last").over(order.rowsBetween(Window.unboundedPreceding, -1))
    spans = spans.withColumn("new", F.when(reach.isNull() | (F.col("first") > reach), 1).otherwise(0)).withColumn("span", F.sum("new").over(order))
    return spans.groupBy("doc", "span").agg(F.min("first").alias("first"), F.max("last").alias("last")).select("doc", "first", "last")


def shared_characters(spans: DataFrame) -> DataFrame:
    """``doc_id, shared_chars``: how many code points of each text lie in shared spans."""
    return spans.groupBy(F.col("doc").alias("doc_id")).agg(F.sum(F.col("last") - F.col("first") + 1).alias("shared_chars"))
