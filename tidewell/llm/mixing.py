"""Mixing sources to target shares of all tokens: subset-sum budget fitting.

Texts are counted by source and exact length.  The largest total that all
sources can supply fixes a budget for each.  A source uses all its texts as
often as the budget allows; what is left of the budget is spread over the
lengths in proportion, and a bounded-knapsack program over the length counts
fits the last of it exactly.  From each length as many texts as were decided are
taken in a seeded order.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewell.workspace import Workspace

TABLE = 16_384  # tokens that the knapsack table covers, or four of the longest texts if that is more
PARTS = 256  # parts of a length's texts in the seeded order


def fit_counts(lengths: np.ndarray, counts: np.ndarray, budget: int, table: int = TABLE) -> np.ndarray:
    """How many texts of each length to take, so that their sum comes as near to the budget as possible from below.

    Shares in proportion come first, then the longest that fit until the rest is
    within the table, then bounded knapsack with split counts.  The table covers
    four of the longest texts at least, so that every length enters it.
    """
    total = int((lengths * counts).sum())
    if budget <= 0 or not total:
        return np.zeros(len(lengths), np.int64)
    if budget >= total:
        return counts.astype(np.int64)
    table = max(table, 4 * int(lengths.max()))
    take = np.array([int(c) * budget // total for c in counts.tolist()], np.int64)
    rest = budget - int((lengths * take).sum())
    order = np.argsort(-lengths, kind="stable")
    for i in order.tolist():
        if rest <= table:
            break
        more = min(int(counts[i] - take[i]), (rest - table) // int(lengths[i]) + 1, rest // int(lengths[i]))
        take[i] += more
        rest -= more * int(lengths[i])
    # some of what was taken is given back, so that the table has all lengths to choose from
    for i in order[::-1].tolist():
        room = max(0, table - rest) // int(lengths[i])
        back = min(int(take[i]), 2, room)
        take[i] -= back
        rest += back * int(lengths[i])
    parts = []  # (length number, copies, tokens)
    for i in order[::-1].tolist():  # short ones first: their sums fill the table soonest
        left, size = min(int(counts[i] - take[i]), rest // int(lengths[i])), 1
        while left > 0:
            n = min(size, left)
            parts.append((i, n, n * int(lengths[i])))
            left, size = left - n, size * 2
    mask, reach, history = (1 << (rest + 1)) - 1, 1, []
    for _, _, w in parts:
        history.append(reach)
        reach = (reach | reach << w) & mask
        if reach >> rest & 1:
            break
    at = reach.bit_length() - 1
    for (i, n, w), before in zip(reversed(parts[: len(history)]), reversed(history)):
        if not before >> at & 1:
            take[i] += n
            at -= w
    return take


def mix_sources(docs: DataFrame, targets: DataFrame, *, total: int | None = None, seed: int = 0, id_column: str = "doc_id", source_column: str = "source", size_column: str = "n_tokens") -> DataFrame:
    """``doc_id, source, uses, n_tokens, target_share, reached_share``: how often each text is used, if at all.

    docs: sizes of the texts by source.  targets: ``source, weight,
    max_repeats``; a text is used at most max_repeats times.  total: tokens of
    the mix; the largest possible if None, and never more than that.

    Defined results: weights are scaled over the sources that have text; sources
    without target, null sources, null ids and texts without tokens are left
    out; targets that are null, not positive or without repeats count as none;
    of repeated targets of a source the first by weight and repeats counts; if
    the budget of a source can't be met exactly, it is met from below.
    """
    ws = Workspace(docs.sparkSession)
    texts = docs.select(F.col(id_column).alias("doc_id"), F.col(source_column).alias("source"), F.col(size_column).cast("long").alias("n_tokens")).dropna().where("n_tokens > 0")
    wanted = targets.select("source", F.col("weight").cast("double").alias("weight"), F.col("max_repeats").cast("long").alias("max_repeats")).dropna().where("weight > 0 and max_repeats > 0")
    wanted = wanted.groupBy("source").agg(F.min(F.struct("weight", "max_repeats")).alias("t")).select("source", "t.*")
    texts = ws.write(texts.join(wanted.select("source"), "source", "left_semi"), "texts")
    lengths = ws.write(texts.groupBy("source", "n_tokens").agg(F.count("*").alias("n")), "lengths")
    supply = lengths.groupBy("source").agg(F.sum(F.col("n") * F.col("n_tokens")).alias("tokens")).join(wanted, "source")
    # one row for each target
    rows = supply.collect()
    if not rows:
        return texts.select("doc_id", "source", F.lit(0).alias("uses"), "n_tokens", F.lit(0.0).alias("target_share"), F.lit(0.0).alias("reached_share")).where(F.lit(False))
    weight = math.fsum(r["weight"] for r in rows)
    most = min(r["tokens"] * r["max_repeats"] * weight / r["weight"] for r in rows)
    total = most if total is None else min(total, most)
    budget = {r["source"]: min(round(total * r["weight"] / weight), r["tokens"] * r["max_repeats"]) for r in rows}
    plans = docs.sparkSession.createDataFrame([(r["source"], r["weight"] / weight, budget[r["source"]] // r["tokens"], budget[r["source"]] % r["tokens"]) for r in rows], "source string, share double, rounds long, rest long")

    def fit(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("n_tokens")
        return part.assign(take=fit_counts(part["n_tokens"].to_numpy(), part["n"].to_numpy(), int(part["rest"].iloc[0])))

    # a source has at most one row for each length, however many texts it has
    counted = lengths.join(F.broadcast(plans), "source").select("source", "n_tokens", "n", "rest")
    taken = ws.write(counted.groupBy("source").applyInPandas(fit, "source string, n_tokens long, n long, rest long, take long"), "taken")

    # the seeded order of a length is cut into parts, so that no task ranks all texts of a length
    seeded = texts.withColumn("r", F.xxhash64(F.lit(seed), "doc_id")).withColumn("part", F.pmod(F.shiftright("r", 32), F.lit(PARTS)))
    sizes = seeded.groupBy("source", "n_tokens", "part").agg(F.count("*").alias("m"))
    before = F.coalesce(F.sum("m").over(Window.partitionBy("source", "n_tokens").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.withColumn("before", before).join(taken.select("source", "n_tokens", "take"), ["source", "n_tokens"]).where(F.col("before") < F.col("take"))
    chosen = seeded.join(sizes.select("source", "n_tokens", "part", (F.col("take") - F.col("before")).alias("room"), (F.col("take") >= F.col("before") + F.col("m")).alias("all")), ["source", "n_tokens", "part"])
    rank = F.row_number().over(Window.partitionBy("source", "n_tokens", "part").orderBy("r", "doc_id"))
    once = chosen.where("all").select("doc_id", "source", "n_tokens").unionByName(chosen.where("not all").withColumn("k", rank).where("k <= room").select("doc_id", "source", "n_tokens"))
    several = texts.join(F.broadcast(plans), "source").where("rounds > 0").select("doc_id", "source", "n_tokens", F.col("rounds").alias("uses"))
    uses = once.withColumn("uses", F.lit(1).cast("long")).unionByName(several).groupBy("doc_id", "source", "n_tokens").agg(F.sum("uses").alias("uses"))
    # the shares are those of the rows that come out, not of the plan
    uses = ws.write(uses, "uses")
    got = plans.join(uses.groupBy("source").agg(F.sum(F.col("uses") * F.col("n_tokens")).alias("reached")), "source").select("source", F.col("share").alias("target_share"), "reached")
    whole = got.agg(F.sum("reached").alias("of"))
    shares = got.crossJoin(whole).select("source", "target_share", (F.col("reached") / F.col("of")).alias("reached_share"))
    return uses.join(F.broadcast(shares), "source").select("doc_id", "source", F.col("uses").cast("int").alias("uses"), "n_tokens", "target_share", "reached_share")
