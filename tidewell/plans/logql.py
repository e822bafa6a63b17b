"""LogQL compiled to DataFrame plans.

Lines are ``labels MAP, ts_ns BIGINT, line STRING, seq BIGINT``.  Everything but
the JSON and logfmt parsers is made of built-in columns.  A metric query maps
each line to the steps whose window holds it by arithmetic on the step index, so
no range join is planned; lines are counted by (labels, first step, last step)
before they are spread over the steps.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewell.functions import labels as L
from tidewell.functions import numbers as N
from tidewell.functions import parsers as P
from tidewell.plans import logql_syntax as S

ERROR = "__error__"


@dataclass(frozen=True)
class Grid:
    """Evaluation times start, start + step, ... in nanoseconds."""

    start: int
    step: int = 1
    count: int = 1

    @staticmethod
    def of(start: int, end: int, step: int) -> Grid:
        if step <= 0 or end < start:
            raise ValueError("a range query needs a positive step and an end after its start")
        return Grid(start, step, (end - start) // step + 1)

    @property
    def last(self) -> int:
        return self.start + self.step * (self.count - 1)


def select_streams(lines: DataFrame, matchers: tuple[S.Matcher, ...]) -> DataFrame:
    for m in matchers:
        lines = lines.where(L.matches(L.value_of(F.col("labels"), m.name), m.op, m.value))
    return lines


def _label(name: str, err: Column) -> Column:
    """Current value of a label, null if absent: stream labels are never overwritten."""
    if name == ERROR:
        return err
    return F.coalesce(F.element_at("labels", F.lit(name)), F.element_at("parsed", F.lit(name)))


def _label_filter(test, err: Column) -> tuple[Column, Column]:
    """(keep, error after it)."""
    if isinstance(test, S.And):  # both sides are evaluated
        left, err = _label_filter(test.left, err)
        right, err = _label_filter(test.right, err)
        return left & right, err
    if isinstance(test, S.Or):  # the right side only if the left does not hold
        left, after = _label_filter(test.left, err)
        right, both = _label_filter(test.right, after)
        return left | right, F.when(left, after).otherwise(both)
    if isinstance(test, S.Matcher):
        return L.matches(F.coalesce(_label(test.name, err), F.lit("")), test.op, test.value), err
    raw = _label(test.name, err)
    value = {"number": N.float_of, "duration": N.duration_of, "bytes": N.bytes_of}[test.kind](raw)
    keep = F.when(raw.isNull(), F.lit(False)).when(value.isNull(), F.lit(True)).otherwise(N.compare(test.op, value, F.lit(float(test.value))))
    bad = raw.isNotNull() & value.isNull()
    return keep, F.coalesce(err, F.when(bad, F.lit("LabelFilterErr")))


def _extracted(found: Column) -> Column:
    """Parsed labels after a parser: names of stream labels get a suffix, later parsers overwrite."""
    renamed = F.transform_keys(found, lambda k, _: F.when(F.map_contains_key("labels", k), F.concat(k, F.lit("_extracted"))).otherwise(k))
    return F.map_concat(F.map_filter("parsed", lambda k, _: ~F.map_contains_key(renamed, k)), renamed)


def pipeline(lines: DataFrame, query: S.LogQuery) -> DataFrame:
    """Lines that pass, with ``labels``, ``parsed`` and ``err`` columns."""
    df = select_streams(lines, query.matchers)
    # empty stream labels are absent
    df = df.withColumn("labels", F.map_filter("labels", lambda _, v: v.isNotNull() & (v != "")))
    df = df.withColumn("parsed", L.empty_map()).withColumn("err", F.lit(None).cast("string"))
    line = F.col("line")
    for st in query.stages:
        if isinstance(st, S.LineFilter):
            hit = F.contains(line, F.lit(st.value)) if st.op in ("|=", "!=") else line.rlike(S.check_re2(st.value))
            df = df.where(hit if st.op[0] == "|" else ~hit)
        elif isinstance(st, S.JsonStage):
            df = df.withColumn("found", (P.json_paths(st) if st.paths else P.json_labels)(line))
            df = df.withColumn("err", F.when(F.col("found").isNull(), F.lit(P.JSON_ERROR)).otherwise(F.col("err")))
            df = df.withColumn("parsed", _extracted(F.coalesce("found", L.empty_map()))).drop("found")
        elif isinstance(st, S.LogfmtStage):
            df = df.withColumn("found", P.logfmt_labels(line)).withColumn("parsed", _extracted(F.coalesce("found", L.empty_map()))).drop("found")
        elif isinstance(st, S.PatternStage):
            parts = st.parts or S.pattern_parts(st.text)
            df = df.withColumn("parsed", _extracted(P.pattern_labels(line, parts)))
        elif isinstance(st, S.RegexpStage):
            df = df.withColumn("parsed", _extracted(P.regexp_labels(line, st.text, S.check_re2(st.text))))
        else:
            held, err = _label_filter(st.test, F.col("err"))
            df = df.withColumn("keep", held).withColumn("err", err).where("keep").drop("keep")
    return df


def _all_labels() -> Column:
    error = F.when(F.col("err").isNotNull(), F.create_map(F.lit(ERROR), F.col("err"))).otherwise(L.empty_map())
    return F.map_concat("labels", "parsed", error)


def log_query(lines: DataFrame, text: str | S.LogQuery, start: int, end: int, *, limit: int = 1000, max_bytes: int = 1 << 20, backward: bool = True) -> DataFrame:
    """``labels, ts_ns, line`` of the lines in [start, end) nearest the chosen end, within both limits.

    The limits are the feature: the line limit is a top-k over the cluster, the
    byte limit runs over what it left.
    """
    q = S.parse(text) if isinstance(text, str) else text
    if not isinstance(q, S.LogQuery):
        raise S.LogQLError("logql: a log query is needed")
    found = pipeline(lines.where((F.col("ts_ns") >= start) & (F.col("ts_ns") < end)), q).select(_all_labels().alias("labels"), "ts_ns", "line", "seq")
    order = [F.desc("ts_ns"), F.desc("seq")] if backward else [F.asc("ts_ns"), F.asc("seq")]
    near = found.orderBy(*order).limit(limit)
    size = F.sum(F.octet_length("line")).over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return near.withColumn("size", size).where(F.col("size") <= max_bytes).orderBy(*order).select("labels", "ts_ns", "line")


def _mentions_error(query: S.LogQuery, by: tuple[str, ...] | None) -> bool:
    def inside(t) -> bool:
        return inside(t.left) or inside(t.right) if isinstance(t, (S.And, S.Or)) else t.name == ERROR

    return ERROR in (by or ()) or any(isinstance(s, S.LabelFilter) and inside(s.test) for s in query.stages)


class Compiler:
    """Compiles metric expressions over one lines table and one grid; result ``labels, step, value``."""

    def __init__(self, lines: DataFrame, grid: Grid):
        self.lines, self.grid = lines, grid

    def compile(self, x) -> DataFrame:
        if isinstance(x, S.RangeAgg):
            return self.range_agg(x, None)
        if isinstance(x, S.VectorAgg):
            return self.vector_agg(x)
        if isinstance(x, S.Binary):
            return self.binary(x)
        raise S.LogQLError(f"logql: {type(x).__name__} is no vector")

    def range_agg(self, x: S.RangeAgg, under_sum: S.VectorAgg | None) -> DataFrame:
        g, r = self.grid, x.range_ns
        near = self.lines.where((F.col("ts_ns") > g.start - r) & (F.col("ts_ns") <= g.last))
        df = pipeline(near, x.query)
        all_labels = _all_labels()
        handled = under_sum is not None and not under_sum.without and _mentions_error(x.query, under_sum.by)
        if under_sum is not None:  # lines are counted by what the sum keeps
            all_labels = L.project(all_labels, under_sum.by, under_sum.without)
        # a line at ts lies in the window of t if ts <= t < ts + r
        if g.count > 1:
            first = F.greatest(_ceil_div(F.col("ts_ns") - g.start, g.step), F.lit(0))
            last = F.least(_ceil_div(F.col("ts_ns") + r - g.start, g.step) - 1, F.lit(g.count - 1))
        else:
            first = last = F.lit(0)
        what = F.octet_length("line").cast("long") if x.op == "bytes_over_time" else F.lit(1).cast("long")
        if not handled:  # a sample with an error fails the query
            told = F.concat(F.lit('logql: pipeline error "'), F.col("err"), F.lit('"'))
            what = F.when(F.col("err").isNotNull(), F.raise_error(told).cast("long")).otherwise(what)
        counted = df.select(all_labels.alias("labels"), first.cast("long").alias("lo"), last.cast("long").alias("hi"), what.alias("n")).where("lo <= hi")
        counted = counted.groupBy("labels", "lo", "hi").agg(F.sum("n").alias("n"))
        spread = counted.withColumn("step", F.explode(F.sequence("lo", "hi"))) if g.count > 1 else counted.withColumn("step", F.col("lo"))
        out = spread.groupBy("labels", "step").agg(F.sum("n").cast("double").alias("value"))
        return out.withColumn("value", F.col("value") / F.lit(r / 1e9)) if x.op == "rate" else out

    def vector_agg(self, x: S.VectorAgg) -> DataFrame:
        if x.op == "sum" and isinstance(x.arg, S.RangeAgg):
            return self.range_agg(x.arg, x)
        df = self.compile(x.arg)
        group = L.project(F.col("labels"), x.by, x.without)
        if x.op == "topk":
            order = Window.partitionBy("grp", "step").orderBy(F.isnan("value"), F.desc("value"), L.canonical(F.col("labels")))
            return df.withColumn("grp", L.canonical(group)).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= x.k).select("labels", "step", "value")
        v = F.col("value")
        how = {"sum": F.sum(v), "count": F.count(F.lit(1)).cast("double"), "avg": F.avg(v), "min": N.nan_min(v), "max": N.nan_max(v)}[x.op]
        return df.select(group.alias("labels"), "step", "value").groupBy("labels", "step").agg(how.alias("value"))

    def scalar(self, x) -> Column:
        if isinstance(x, S.Scalar):
            return F.lit(float(x.value))
        a, b = self.scalar(x.left), self.scalar(x.right)
        return N.compare(x.op, a, b).cast("double") if x.op in S.COMPARISONS else N.arithmetic(x.op, a, b)

    def binary(self, x: S.Binary) -> DataFrame:
        vector_left = not S.is_scalar(x.left)
        df = self.compile(x.left if vector_left else x.right)
        number = self.scalar(x.right if vector_left else x.left)
        a, b = (F.col("value"), number) if vector_left else (number, F.col("value"))
        if x.op not in S.COMPARISONS:
            return df.withColumn("value", N.arithmetic(x.op, a, b))
        held = N.compare(x.op, a, b)
        return df.withColumn("value", held.cast("double")) if x.bool_ else df.where(held)


def _ceil_div(a: Column, b: int) -> Column:
    """Ceiling of a division of whole numbers, exact for 64 bits."""
    return F.expr("0") - F.call_function("div", -a - F.pmod(-a, F.lit(b)), F.lit(b))


def metric_query(lines: DataFrame, text: str, grid: Grid) -> DataFrame:
    """``labels, ts_ns, value`` of a metric query at every time of the grid at which it has a sample."""
    x = S.parse(text)
    if isinstance(x, S.LogQuery):
        raise S.LogQLError("logql: a metric query is needed")
    out = Compiler(lines, grid).compile(x)
    return out.select("labels", (F.lit(grid.start) + F.col("step") * grid.step).alias("ts_ns"), "value")
