"""Parent links to full hierarchies: root, depth, intervals, paths, cycles.

1. Leaves are peeled layer by layer.  A peeled node knows its place among its
   siblings, so that its interval follows from its parent's later on.
2. What stays is exposed by pointer doubling: nodes from which no root can be
   reached lie on a cycle or below one.
3. The trees that stay get Euler tours (one arc into and one out of each node),
   ranked by parallel list ranking: each round doubles the stretch that an arc
   has summed up.  The sums give depth, entry and exit.
4. The peeled layers are put back, last first.

Joins are merges: no side is collected to the driver, and AQE splits skewed
partitions (hot parents, roots of giant trees) of a merge join.

Entry and exit number the nodes of a tree so that d is a descendant of v iff
both have the same root and v.enter < d.enter <= v.exit.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewell.workspace import Workspace

PEEL = 4  # layers of leaves that are peeled before the tours
SPREAD = 64  # parts into which the children of one parent are split


def _siblings(rows: DataFrame, with_next: bool = False) -> DataFrame:
    """``rows`` (v, p, w, ...) with ``before``: sum of w over earlier siblings, and ``nxt``: the next sibling.

    The children of one parent may be a third of all nodes, so a window covers
    one of SPREAD parts of them, and a second one only the parts' sums.
    """
    parts = rows.withColumn("part", F.pmod(F.hash("v"), F.lit(SPREAD)))
    inside = Window.partitionBy("p", "part").orderBy("v")
    if with_next:
        parts = parts.withColumn("nxt", F.lead("v").over(inside))
    parts = parts.withColumn("before", F.coalesce(F.sum("w").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    sums = rows.withColumn("part", F.pmod(F.hash("v"), F.lit(SPREAD))).groupBy("p", "part").agg(F.sum("w").alias("pw"), F.min("v").alias("first"))
    across = Window.partitionBy("p").orderBy("part")
    sums = sums.select("p", "part", F.coalesce(F.sum("pw").over(across.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("pb"), F.lead("first").over(across).alias("pn"))
    out = parts.join(sums.hint("merge"), ["p", "part"]).withColumn("before", F.col("before") + F.col("pb"))
    if with_next:
        out = out.withColumn("nxt", F.coalesce("nxt", "pn"))
    return out.drop("part", "pb", "pn")


def _double(links: DataFrame, ws: Workspace, done: int) -> DataFrame:
    """``v, j, m`` of the nodes from which no root can be reached.

    j is the node a long way up (it lies on the cycle), m the smallest node on
    the way there.  links: v, p of the nodes that were not peeled.
    """
    # a node without a link is a root; j is null once the way up has ended
    now = links.select("v", F.col("p").alias("j"), F.least("v", "p").alias("m"))
    known, steps, bound, path = done, 1, None, None
    while known:
        # an acyclic node that is not done after `steps` has that many ancestors done and all others not
        bound = known + steps if bound is None else min(bound, known + steps)
        if steps > bound:
            break
        up = now.select(F.col("v").alias("j"), F.col("j").alias("j2"), F.col("m").alias("m2"))
        # nodes whose pointer has no row have come to a root: they leave
        new = now.join(up.hint("merge"), "j").select("v", F.col("j2").alias("j"), F.least("m", "m2").alias("m"))
        new_path, known = ws.save_counting(new, "double")
        now = ws.read(new_path, new)
        if path:
            ws.drop(path)
        path, steps = new_path, steps * 2
    return now


def _tours(core: DataFrame, ws: Workspace) -> DataFrame:
    """``v, root, depth, enter, size`` of the non-root nodes of the unpeeled trees.

    core: v, p, own (1 and the size of what was peeled below v).
    """
    rows = core.select("v", "p", "own", F.lit(1).alias("w"))
    rows = ws.write(_siblings(rows, with_next=True).select("v", "p", "own", "nxt"), "siblings")
    first = rows.groupBy(F.col("p").alias("v")).agg(F.min(F.struct(F.pmod(F.hash("v"), F.lit(SPREAD)).alias("part"), F.col("v").alias("c"))).alias("f")).select("v", F.col("f.c").alias("first"))
    inner = rows.select(F.col("v").alias("p"), F.lit(True).alias("p_inner"))
    known = rows.join(first.hint("merge"), "v", "left").join(inner.hint("merge"), "p", "left")
    # arc 2v leads into v, arc 2v + 1 out of it
    into = F.struct((F.col("v") * 2).alias("arc"), F.coalesce(F.col("first") * 2, F.col("v") * 2 + 1).alias("next"), F.col("own").alias("n"), F.lit(1).cast("long").alias("d"), F.lit(None).cast("long").alias("root"))
    after = F.when(F.col("nxt").isNotNull(), F.col("nxt") * 2).when(F.col("p_inner"), F.col("p") * 2 + 1)
    root = F.when(after.isNull(), F.col("p"))
    out = F.struct((F.col("v") * 2 + 1).alias("arc"), after.alias("next"), F.lit(0).cast("long").alias("n"), F.lit(-1).cast("long").alias("d"), root.alias("root"))
    arcs = known.select(F.explode(F.array(into, out)).alias("a")).select("a.*")
    on_the_way = F.col("next").isNotNull()
    path, left = ws.save_counting(arcs, "arcs", on_the_way)
    now = ws.read(path, arcs)
    while left:
        to = now.select(F.col("arc").alias("next"), F.col("next").alias("next2"), F.col("n").alias("n2"), F.col("d").alias("d2"), F.col("root").alias("root2"))
        moved = now.where(F.col("next").isNotNull()).join(to.hint("merge"), "next").select("arc", F.col("next2").alias("next"), (F.col("n") + F.col("n2")).alias("n"), (F.col("d") + F.col("d2")).alias("d"), F.col("root2").alias("root"))
        both = moved.unionByName(now.where(F.col("next").isNull()))
        new_path, left = ws.save_counting(both, "arcs", on_the_way)
        now = ws.read(new_path, both)
        ws.drop(path)
        path = new_path
    total = now.groupBy("root").agg(F.max("n").alias("total"))
    # sums run from an arc to the end of its tour
    ranks = now.groupBy(F.shiftright("arc", 1).alias("v"), "root").agg(F.max("n").alias("n_in"), F.min("n").alias("n_out"), F.min_by("d", F.col("arc") % 2).alias("d"))
    return ranks.join(total.hint("merge"), "root").select("v", "root", (1 - F.col("d")).alias("depth"), (F.col("total") - F.col("n_in") + 1).alias("tour"), (F.col("n_in") - F.col("n_out")).alias("size"))


def hierarchy(links: DataFrame, *, scope: str = "epoch", parent: str = "uid", child: str = "to_uid") -> DataFrame:
    """``scope, uid, root_uid, depth, on_cycle, parent_uid, enter, exit`` of every node at either end of a link.

    links: one row for each link; other columns are ignored.  A child has at
    most one parent within a scope; if rows contradict that, its smallest parent
    counts.  Nodes on a cycle or below one have depth -1, the smallest node of
    the cycle as root, and null enter and exit; a self link is a cycle.  Links
    with a null in scope, parent or child are ignored; repeated links count
    once; no links yield no rows.
    """
    ws = Workspace(links.sparkSession)
    named = links.select(F.col(scope).alias("scope"), F.col(parent).alias("parent"), F.col(child).alias("child")).dropna()
    named = ws.write(named.groupBy("scope", "child").agg(F.min("parent").alias("parent")), "links")
    ends = named.select("scope", F.explode(F.array("child", "parent")).alias("uid")).groupBy("scope", "uid").agg(F.lit(1).alias("one"))
    # numbers in the order of the names, so that the smallest number is the smallest name
    nodes = ws.write(ends.orderBy("scope", "uid").select("scope", "uid", F.monotonically_increasing_id().alias("id")), "nodes")
    by_child = named.join(nodes.hint("merge").select("scope", F.col("uid").alias("child"), F.col("id").alias("v")), ["scope", "child"])
    all_links = by_child.join(nodes.hint("merge").select("scope", F.col("uid").alias("parent"), F.col("id").alias("p")), ["scope", "parent"]).select("v", "p")
    rest = whole = ws.write(all_links.withColumn("own", F.lit(1).cast("long")), "rest")

    # peel: `own` is 1 and the size of what was peeled below; of roots it is kept in `below`
    layers: list[DataFrame] = []
    below: DataFrame | None = None
    unpeeled = None
    for _ in range(PEEL):
        inner = rest.select(F.col("p").alias("v")).distinct()
        marked = rest.join(inner.hint("merge"), "v", "left_anti")
        path, n_leaves = ws.save_counting(marked, "leaves")
        if not n_leaves:  # only cycles are left, or nothing
            break
        leaves = ws.read(path, marked)
        kept = rest.join(inner.hint("merge"), "v", "left_semi")
        placed = _siblings(leaves.select("v", "p", F.col("own").alias("w")))
        sums = leaves.groupBy(F.col("p").alias("v")).agg(F.sum("own").alias("add"))
        shift = kept.select("v", "own") if below is None else kept.select("v", "own").unionByName(below.select("v", "own"))
        placed = placed.join(shift.hint("merge").select(F.col("v").alias("p"), "own"), "p", "left")
        # read once, when the layer is put back: its tables are written, so it need not be
        layers.append(placed.select("v", "p", F.col("w").alias("size"), (F.coalesce("own", F.lit(1)) + F.col("before")).alias("offset")))
        roots = sums.join(kept.hint("merge").select("v"), "v", "left_anti").select("v", (F.col("add") + 1).alias("own"))
        if below is not None:
            more = roots.select("v", (F.col("own") - 1).alias("own"))
            roots = below.unionByName(more.join(below.hint("merge").select("v"), "v", "left_semi")).unionByName(roots.join(below.hint("merge").select("v"), "v", "left_anti")).groupBy("v").agg(F.sum("own").alias("own"))
        below = ws.write(roots, "below")
        kept = kept.join(sums.hint("merge"), "v", "left").select("v", "p", (F.col("own") + F.coalesce("add", F.lit(0))).alias("own"))
        path, unpeeled = ws.save_counting(kept, "rest")
        rest = ws.read(path, kept)
        if not unpeeled:
            break

    # cycles, and what hangs below them unpeeled
    unpeeled = rest.count() if unpeeled is None else unpeeled
    below = whole.select("v", "own").where(F.lit(False)) if below is None else below
    stuck = _double(rest, ws, unpeeled)
    on_cycle = stuck.groupBy(F.col("j").alias("v")).agg(F.lit(1).alias("on_cycle"))
    smallest = stuck.join(on_cycle.hint("merge"), "v", "left_semi").select(F.col("v").alias("j"), F.col("m").alias("root"))
    cyclic = ws.write(
        stuck.select("v", "j").join(smallest.hint("merge"), "j").join(on_cycle.hint("merge"), "v", "left").select("v", "root", F.lit(-1).cast("long").alias("depth"), F.lit(None).cast("long").alias("enter"), F.lit(None).cast("long").alias("size"), F.coalesce("on_cycle", F.lit(0)).alias("on_cycle")), "cyclic"
    )

    core = ws.write(rest.join(cyclic.hint("merge").select("v"), "v", "left_anti"), "core")
    tours = ws.write(_tours(core, ws), "tours")
    # what was peeled right below the root comes before its tours
    tours = tours.join(below.hint("merge").select(F.col("v").alias("root"), F.col("own").alias("ahead")), "root", "left")
    tours = tours.select("v", "root", "depth", (F.col("tour") + F.coalesce("ahead", F.lit(1)) - 1).alias("enter"), "size", F.lit(0).alias("on_cycle"))
    all_roots = whole.select(F.col("p").alias("r")).distinct().join(whole.hint("merge").select(F.col("v").alias("r")), "r", "left_anti")
    sizes = core.join(all_roots.hint("merge"), core["p"] == all_roots["r"], "left_semi").join(tours.hint("merge").select("v", F.col("size").alias("s")), "v").groupBy(F.col("p").alias("v")).agg(F.sum("s").alias("s"))
    roots = all_roots.select(F.col("r").alias("v")).join(below.hint("merge"), "v", "left").join(sizes.hint("merge"), "v", "left")
    roots = roots.select("v", F.col("v").alias("root"), F.lit(0).cast("long").alias("depth"), F.lit(0).cast("long").alias("enter"), (F.coalesce("own", F.lit(1)) + F.coalesce("s", F.lit(0))).alias("size"), F.lit(0).alias("on_cycle"))
    roots = roots.join(cyclic.hint("merge").select("v"), "v", "left_anti")
    done = ws.write(roots.unionByName(tours).unionByName(cyclic), "done")
    for layer in reversed(layers):
        above = done.select(F.col("v").alias("p"), "root", F.col("depth").alias("pd"), F.col("enter").alias("pe"))
        back = layer.join(above.hint("merge"), "p").select("v", "root", F.when(F.col("pd") < 0, F.col("pd")).otherwise(F.col("pd") + 1).alias("depth"), (F.col("pe") + F.col("offset")).alias("enter"), F.when(F.col("pe").isNotNull(), F.col("size")).alias("size"), F.lit(0).alias("on_cycle"))
        done = done.unionByName(ws.write(back, "back"))
    name = nodes.select(F.col("id").alias("v"), "scope", "uid")
    out = done.join(name.hint("merge"), "v").join(nodes.hint("merge").select(F.col("id").alias("root"), F.col("uid").alias("root_uid")), "root")
    out = out.join(named.hint("merge").select("scope", F.col("child").alias("uid"), F.col("parent").alias("parent_uid")), ["scope", "uid"], "left")
    return out.select("scope", "uid", "root_uid", F.col("depth").cast("int").alias("depth"), F.col("on_cycle").cast("int").alias("on_cycle"), "parent_uid", "enter", (F.col("enter") + F.col("size") - 1).alias("exit"))


BLOCK = 4096  # entries of a tree that are walked by one task


def paths(nodes: DataFrame, *, block: int = BLOCK) -> DataFrame:
    """``scope, uid, path``: the uids from the root to each node of a tree, from the intervals.

    nodes: what :func:`hierarchy` returns; nodes with null enter (cycles) get no
    path.  A large tree is cut into blocks of entries; a node whose interval
    reaches into later blocks is sent there as well, so that each block can be
    walked alone in order of entry.
    """
    tree = nodes.where(F.col("enter").isNotNull()).select("scope", "root_uid", "uid", "enter", "exit")
    cut = tree.withColumn("block", F.floor(F.col("enter") / block))
    ahead = F.sequence(F.col("block"), F.floor(F.col("exit") / block))
    sent = cut.withColumn("block", F.explode(ahead)).withColumn("own", F.floor(F.col("enter") / block) == F.col("block"))
    sorted_blocks = sent.repartition("scope", "root_uid", "block").sortWithinPartitions("scope", "root_uid", "block", "enter")

    def walk(batches):
        where, stack = None, []  # (uid, exit) from the root to the last node
        for rows in batches:
            out = ([], [], [])
            for scope, root, part, uid, enter, end, own in zip(*(rows[c] for c in ("scope", "root_uid", "block", "uid", "enter", "exit", "own"))):
                if where != (scope, root, part):
                    where, stack = (scope, root, part), []
                while stack and stack[-1][1] < enter:
                    stack.pop()
                stack.append((uid, end))
                if own:
                    for o, x in zip(out, (scope, uid, [u for u, _ in stack])):
                        o.append(x)
            yield pd.DataFrame({"scope": out[0], "uid": out[1], "path": out[2]})

    return sorted_blocks.mapInPandas(walk, "scope string, uid string, path array<string>")


def descendants(nodes: DataFrame, walked: DataFrame | None = None) -> DataFrame:
    """``scope, uid, descendant``: one row for each ancestor of each node, from its path."""
    walked = paths(nodes) if walked is None else walked
    above = walked.select("scope", F.col("uid").alias("descendant"), F.explode(F.slice("path", F.lit(1), F.size("path") - 1)).alias("uid"))
    return above.select("scope", "uid", "descendant")


def standing_links(ops: DataFrame, *, edge_type: str = "owns", add: int = 4, remove: int = 5, replace: int = 6) -> DataFrame:
    """``epoch, uid, to_uid`` of the parent links that stand at the end of each epoch.

    Edge ops take effect once each, in order of seq, then idx, whatever the order
    of delivery.  A parent link has attrs in which ``controller`` is the JSON true.
    """
    edges = ops.where(F.col("op").isin(add, remove, replace) & (F.col("edge_type") == edge_type)).dropna(subset=["epoch", "uid", "to_uid", "seq"])
    last = edges.groupBy("epoch", "uid", "to_uid").agg(F.max(F.struct("seq", "idx", "op", "attrs")).alias("last"))
    held = F.from_json("last.attrs", "controller boolean")["controller"]
    return last.where((F.col("last.op") != remove) & F.coalesce(held, F.lit(False))).select("epoch", "uid", "to_uid")
