"""Filling containers of fixed capacity: bound-certified repacking.

Texts are packed by best-fit decreasing in partitions.  For each partition lower
bounds by dual feasible functions tell how many containers it needs at least; a
partition that reaches its bound is certified and stays.  The others give up the
documents of their containers that are not full, exchange them - two partitions
become one - and pack them again.  In the last partition the exchange goes on
between its containers: the documents of a few of them are packed anew until
their number meets the bound or the stated number of tries is used up.
"""

from __future__ import annotations

import itertools

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.workspace import Workspace

PER_PARTITION = 20_000  # pieces packed by one task
FEW, PARTS = 500, 8  # small inputs: partitions of at least so many pieces, up to so many partitions
TRIES = 30_000  # repackings of a few containers in the last partition, about 5 seconds
ITEMS = "part long, id long, piece int, size long"


def lower_bound(sizes: np.ndarray, capacity: int, counts: np.ndarray | None = None) -> int:
    """Containers that items of these sizes (each ``counts`` times) need at least.

    The best of the bounds by the volume and by two families of dual feasible
    functions: rounding to multiples of 1/k, and cutting off small items.
    """
    if counts is None:
        sizes, counts = np.unique(sizes, return_counts=True)
    values, counts = sizes[sizes > 0].astype(np.int64), counts[sizes > 0].astype(np.int64)
    if not len(values):
        return 0
    best = -(-int((values * counts).sum()) // capacity)
    for k in range(1, 33):  # u_k: x stays if x (k + 1) is whole, else becomes floor(x (k + 1)) / k
        scaled = values * (k + 1)
        whole = scaled % capacity == 0
        # in units of capacity * k
        u = np.where(whole, values * k, scaled // capacity * capacity)
        best = max(best, -(-int((u * counts).sum()) // (capacity * k)))
    for small in np.unique(values[values <= capacity // 2]):  # items under `small` vanish, those above its complement fill a container
        u = np.where(values > capacity - small, capacity, np.where(values < small, 0, values))
        best = max(best, -(-int((u * counts).sum()) // capacity))
    return best


def best_fit_decreasing(sizes: np.ndarray, capacity: int, order: np.ndarray | None = None) -> np.ndarray:
    """Container number of each item; items larger than the capacity are not allowed.

    order: the items in another order than by falling size.
    """
    order = np.argsort(-sizes, kind="stable") if order is None else order
    out = [0] * len(sizes)
    open_bins: dict[int, list[int]] = {}  # by space left
    spaces = 0  # bit r is set if a container with r left is open
    used = 0
    values = sizes.tolist()
    for i in order.tolist():
        s = values[i]
        fit = spaces >> s
        if fit:
            left = s + (fit & -fit).bit_length() - 1
            held = open_bins[left]
            b = held.pop()
            if not held:
                spaces &= ~(1 << left)
        else:
            left, b = capacity, used
            used += 1
        out[i] = b
        if left > s or s == 0:
            open_bins.setdefault(left - s, []).append(b)
            spaces |= 1 << (left - s)
    return np.array(out, np.int64)


def exchange(sizes: np.ndarray, bins: np.ndarray, capacity: int, bound: int, tries: int, seed: int = 0) -> np.ndarray:
    """``bins`` after exchanges between containers, until they meet ``bound`` or all tries are used.

    A try takes the least filled container, some that are not full and some
    others, and packs their documents anew in a blurred falling order.  It is
    kept if it needs fewer containers, or as many and leaves the space in fewer
    of them.
    """
    bins = np.unique(bins, return_inverse=True)[1]
    fill = np.bincount(bins, weights=sizes).astype(np.int64)
    held = [np.flatnonzero(bins == b) for b in range(len(fill))] if len(fill) * len(bins) < 1 << 24 else np.split(np.argsort(bins, kind="stable"), np.cumsum(np.bincount(bins))[:-1])
    held, r = dict(enumerate(held)), np.random.default_rng(seed)
    for _ in range(tries):
        if len(held) <= bound or len(held) < 2:
            break
        names = np.fromiter(held, np.int64, len(held))
        open_ = names[fill[names] < capacity]
        if not len(open_):
            break
        least = open_[np.argmin(fill[open_])]
        some = r.choice(open_, min(len(open_), int(r.integers(2, 30))), replace=False)
        others = r.choice(names, min(len(names), int(r.integers(0, 20))), replace=False)
        pick = np.unique(np.concatenate(([least], some, others)))
        items = np.concatenate([held[b] for b in pick.tolist()])
        mine = sizes[items]
        order = np.argsort(-mine * (1 + 0.1 * r.random() * r.random(len(mine))), kind="stable")
        new = best_fit_decreasing(mine, capacity, order)
        count = int(new.max()) + 1
        filled = np.bincount(new, weights=mine, minlength=count).astype(np.int64)
        if count < len(pick) or count == len(pick) and (filled**2).sum() >= (fill[pick] ** 2).sum():
            by_bin = np.split(items[np.argsort(new, kind="stable")], np.cumsum(np.bincount(new, minlength=count))[:-1])
            for b, docs, f in zip(pick.tolist(), by_bin, filled.tolist()):
                held[b], fill[b] = docs, f
            for b in pick[count:].tolist():
                del held[b]
    out = np.empty(len(sizes), np.int64)
    for number, docs in enumerate(held.values()):
        out[docs] = number
    return out


def _pack(capacity: int, round_no: int, tries: int):
    def pack(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["id", "piece"], kind="stable")
        sizes = rows["size"].to_numpy()
        bins = best_fit_decreasing(sizes, capacity)
        bound = max(lower_bound(sizes, capacity), 1)
        if tries and int(bins.max()) + 1 > bound:
            bins = exchange(sizes, bins, capacity, bound, tries)
        n = int(bins.max()) + 1
        fill = np.bincount(bins, weights=sizes, minlength=n).astype(np.int64)
        part = int(rows["part"].iloc[0])
        return rows.assign(bin=[f"{round_no}-{part}-{b}" for b in bins], fill=fill[bins], bins=n, bound=bound)

    return pack


def pack_texts(sizes: DataFrame, *, id_column: str = "doc_id", size_column: str = "n_tokens", capacity: int = 2048, per_partition: int = PER_PARTITION, full: float = 0.99, tries: int = TRIES) -> DataFrame:
    """``id, piece, start, size, container, filled, bound_gap``: where each text goes.

    sizes: ``id_column`` a unique BIGINT and ``size_column``; others are ignored.
    A text larger than the capacity is cut into full pieces and a rest (``piece``
    counts from 0, ``start`` is the first token of the piece); no other is cut.
    ``filled`` is what its container holds.  ``bound_gap``: by how many
    containers the pack of its partition exceeds the certified lower bound.

    A partition that meets its bound keeps its containers filled to ``full`` of
    the capacity, one with a gap only those that are exactly full.  The texts of
    the others are exchanged in rounds that at least halve the partitions, until
    all that are left are in one, where full containers join as far as it has
    room; there containers exchange texts up to ``tries`` times, or until they
    meet the bound.

    Defined results: null or negative sizes count as 0; a text of size 0 takes a
    place but no space; null ids are ignored; an empty table gives none.
    """
    spark = sizes.sparkSession
    ws = Workspace(spark)
    clean = sizes.select(F.col(id_column).cast("long").alias("id"), F.greatest(F.coalesce(F.col(size_column), F.lit(0)), F.lit(0)).cast("long").alias("total")).where(F.col("id").isNotNull())
    last = F.greatest(F.ceil(F.col("total") / capacity) - 1, F.lit(0))
    pieces = clean.withColumn("piece", F.explode(F.sequence(F.lit(0), last.cast("int"))))
    pieces = ws.write(pieces.select("id", "piece", F.least(F.lit(capacity), F.col("total") - F.col("piece") * capacity).alias("size")), "pieces")
    whole = pieces.where(F.col("size") == capacity).select("id", "piece", "size", F.concat_ws("-", F.lit("full"), "id", "piece").alias("bin"), F.lit(capacity).cast("long").alias("fill"), F.lit(0).alias("gap"))
    loose = pieces.where(F.col("size") < capacity)
    n = loose.count()
    parts = max(1, min(PARTS, n // FEW), -(-n // per_partition))
    todo = loose.select(F.pmod(F.xxhash64("id", "piece"), F.lit(parts)).alias("part"), "id", "piece", "size")
    done = [whole]
    schema = ITEMS + ", bin string, fill long, bins long, bound long"
    for r in itertools.count():
        last_round = parts == 1
        packed = ws.write(todo.groupBy("part").applyInPandas(_pack(capacity, r, tries if last_round else 0), schema), "packed").withColumn("gap", F.col("bins") - F.col("bound"))
        stays = F.lit(True) if last_round else (F.col("gap") == 0) & (F.col("fill") >= full * capacity) | (F.col("fill") == capacity)
        left, of = packed.agg(F.count_if(~stays), F.count("*")).first()
        if left and left < per_partition:  # the last partition has room: whole containers come along, to exchange with
            share = min(1.0, (per_partition - left) / max(1, of - left))
            stays = stays & (F.pmod(F.xxhash64("bin"), F.lit(1 << 20)) >= int(share * (1 << 20)))
            if of > left:
                left = packed.where(~stays).count()
        done.append(packed.where(stays).select("id", "piece", "size", "bin", "fill", F.col("gap").cast("int").alias("gap")))
        if last_round or not left:
            break
        again = packed.where(~stays)
        parts = max(1, min(parts // 2, -(-left // max(1, per_partition))))
        todo = again.select(F.pmod(F.col("part"), F.lit(parts)).alias("part"), "id", "piece", "size")
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out.select("id", "piece", (F.col("piece") * capacity).cast("long").alias("start"), "size", F.col("bin").alias("container"), F.col("fill").alias("filled"), F.col("gap").alias("bound_gap"))


def packing_report(packed: DataFrame, *, capacity: int = 2048) -> DataFrame:
    """One row: ``containers, lower_bound, tokens, fill`` of a whole pack, bounded over all pieces."""
    used = packed.agg(F.count_distinct("container").alias("containers"), F.sum("size").alias("tokens"))
    sizes = packed.groupBy("size").agg(F.count("*").alias("n"))  # at most one row for each size up to the capacity

    def bound(rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"lower_bound": [lower_bound(rows["size"].to_numpy(), capacity, rows["n"].to_numpy())]})

    low = sizes.groupBy(F.lit(1).alias("one")).applyInPandas(bound, "lower_bound long")
    return used.crossJoin(low).select("containers", "lower_bound", "tokens", (F.col("tokens") / (F.col("containers") * capacity)).alias("fill"))
