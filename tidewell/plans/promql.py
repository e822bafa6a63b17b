"""PromQL compiled to DataFrame plans.

Samples are ``labels MAP (with __name__), ts_ms BIGINT, value DOUBLE, is_stale
BOOLEAN``.  Every vector is a frame ``labels, step, value`` over a grid of
evaluation times.  A sample is sent to the steps whose window holds it by
arithmetic on the step index; functions over a range are plain aggregates with
map-side combination, so that a long series is not gathered in one task.
"""

from __future__ import annotations

import re

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewell.functions import labels as L
from tidewell.functions import numbers as N
from tidewell.plans import promql_syntax as S
from tidewell.plans.logql_syntax import COMPARISONS, check_re2

LOOKBACK = 300_000
BLOCK = 3_600_000  # milliseconds of a series in which the sample before is looked up by one window
NAME = "__name__"


@dataclass(frozen=True)
class Grid:
    """Evaluation times start, start + step, ... in milliseconds."""

    start: int
    step: int = 1
    count: int = 1

    @staticmethod
    def of(start: int, end: int, step: int) -> Grid:
        if step <= 0 or end < start:
            raise S.PromQLError("promql: a range query needs a positive step and an end after its start")
        return Grid(start, step, (end - start) // step + 1)

    @property
    def last(self) -> int:
        return self.start + self.step * (self.count - 1)

    def time(self) -> Column:
        return F.lit(self.start) + F.col("step") * self.step


@dataclass(frozen=True)
class ScalarValue:
    """A number for each step: an expression over ``step``, or a frame ``step, scalar``."""

    column: Column
    frame: DataFrame | None = None


def _div_up(a: Column, b: int) -> Column:
    return F.lit(0) - F.call_function("div", -a - F.pmod(-a, F.lit(b)), F.lit(b))


def _spread(samples: DataFrame, grid: Grid, window: int, offset: int, combine: bool) -> DataFrame:
    """Samples of the grid's windows (t - window, t] with ``step``.

    combine: only the last sample of a window matters, so that of samples with
    the same first step only the last is sent on.
    """
    at = F.col("ts_ms") + offset
    near = samples.where((at > grid.start - window) & (at <= grid.last))
    if grid.count == 1:
        return near.withColumn("step", F.lit(0).cast("long"))
    first = F.greatest(_div_up(at - grid.start, grid.step), F.lit(0))
    last = F.least(_div_up(at + window - grid.start, grid.step) - 1, F.lit(grid.count - 1))
    near = near.withColumn("lo", first.cast("long")).withColumn("hi", last.cast("long")).where("lo <= hi")
    if combine:
        near = near.groupBy("labels", "lo").agg(F.max(F.struct("ts_ms", "value", "is_stale", "hi")).alias("m")).select("labels", "lo", "m.*")
    return near.withColumn("step", F.explode(F.sequence("lo", "hi"))).drop("lo", "hi")


def with_previous(samples: DataFrame) -> DataFrame:
    """Samples with ``prev`` (value) and ``prev_ms`` of the sample before in the series.

    A window covers one block of a series, and a second one only the last sample
    of each block.
    """
    keyed = samples.withColumn("sid", L.canonical(F.col("labels"))).withColumn("block", F.floor(F.col("ts_ms") / BLOCK))
    inside = Window.partitionBy("sid", "block").orderBy("ts_ms")
    ends = keyed.groupBy("sid", "block").agg(F.max(F.struct("ts_ms", "value")).alias("end"))
    ends = ends.select("sid", "block", F.lag("end").over(Window.partitionBy("sid").orderBy("block")).alias("before"))
    near = keyed.withColumn("pv", F.lag("value").over(inside)).withColumn("pt", F.lag("ts_ms").over(inside)).join(ends, ["sid", "block"])
    return near.select(*samples.columns, F.coalesce("pv", F.when(F.col("pt").isNull(), F.col("before.value"))).alias("prev"), F.coalesce("pt", "before.ts_ms").alias("prev_ms"))


def _drop_name(labels: Column) -> Column:
    return L.drop(labels, (NAME,))


def _quantile(q: Column, values: Column) -> Column:
    """Quantile of an array, interpolated; NaN sorts first as the language has it."""
    ordered = F.array_sort(F.transform(values, lambda v: F.when(F.isnan(v), F.lit(-math.inf)).otherwise(v)))
    n = F.size(values)
    rank = q * (n - 1)
    lo = F.greatest(F.floor(rank), F.lit(0)).cast("int")
    hi = F.least(lo + 1, n - 1)
    weight = rank - F.floor(rank)
    inside = F.get(ordered, lo) * (1 - weight) + F.get(ordered, hi) * weight
    return F.when((n == 0) | F.isnan(q), F.lit(N.NAN)).when(q < 0, F.lit(-N.INF)).when(q > 1, F.lit(N.INF)).when(F.get(ordered, lo) == F.get(ordered, hi), F.get(ordered, lo)).otherwise(inside)


class Compiler:
    def __init__(self, samples: DataFrame, grid: Grid, *, lookback: int = LOOKBACK, default_step: int = 60_000):
        self.samples, self.grid, self.lookback, self.default_step = samples, grid, lookback, default_step
        self.spark: SparkSession = samples.sparkSession

    # -- scalars
    def steps(self) -> DataFrame:
        return self.spark.range(self.grid.count).select(F.col("id").alias("step"))

    def scalar(self, x) -> ScalarValue:
        if isinstance(x, S.Number):
            return ScalarValue(F.lit(float(x.value)))
        if isinstance(x, S.Negate):
            inner = self.scalar(x.expr)
            return ScalarValue(-inner.column, inner.frame)
        if isinstance(x, S.Call) and x.name == "pi":
            return ScalarValue(F.lit(math.pi))
        if isinstance(x, S.Call) and x.name == "time":
            return ScalarValue(self.grid.time() / F.lit(1000.0))
        if isinstance(x, S.Call) and x.name == "scalar":
            one = self.vector(x.args[0]).groupBy("step").agg(F.count("*").alias("n"), F.first("value").alias("v"))
            frame = self.steps().join(one, "step", "left").select("step", F.when(F.col("n") == 1, F.col("v")).otherwise(F.lit(N.NAN)).alias("scalar"))
            return ScalarValue(F.col("scalar"), frame)
        if isinstance(x, S.Binary) and S.is_scalar(x):
            a, b = self.scalar(x.left), self.scalar(x.right)
            combine = lambda p, q: N.compare(x.op, p, q).cast("double") if x.op in COMPARISONS else N.arithmetic(x.op, p, q)
            if a.frame is None and b.frame is None:
                return ScalarValue(combine(a.column, b.column))
            left, right = self._framed(a, "a"), self._framed(b, "b")
            return ScalarValue(F.col("scalar"), left.join(right, "step").select("step", combine(F.col("a"), F.col("b")).alias("scalar")))
        raise S.PromQLError(f"promql: {x} is no scalar")

    def _framed(self, s: ScalarValue, name: str) -> DataFrame:
        return (self.steps() if s.frame is None else s.frame).select("step", s.column.alias(name))

    def _with_scalar(self, df: DataFrame, s: ScalarValue, name: str = "scalar_value") -> DataFrame:
        if s.frame is None:
            return df.withColumn(name, s.column)
        return df.join(self._framed(s, name), "step")

    # -- selectors
    def series(self, x: S.Selector) -> DataFrame:
        df = self.samples
        for m in x.matchers:
            df = df.where(L.matches(L.value_of(F.col("labels"), m.name), m.op, m.value))
        return df.select("labels", "ts_ms", "value", "is_stale")

    def instant(self, x: S.Selector, timestamps: bool = False) -> DataFrame:
        sent = _spread(self.series(x), self.grid, self.lookback, x.offset_ms, True)
        last = sent.groupBy("labels", "step").agg(F.max(F.struct("ts_ms", "value", "is_stale")).alias("m")).where("not m.is_stale")
        return last.select("labels", "step", (F.col("m.ts_ms") / F.lit(1000.0) if timestamps else F.col("m.value")).alias("value"))

    def range_samples(self, x) -> tuple[DataFrame, int, int]:
        """(samples without stale markers, window, offset)."""
        if isinstance(x, S.Selector):
            return self.series(x).where("not is_stale"), x.range_ms, x.offset_ms
        step = x.step_ms or self.default_step
        low, high = self.grid.start - x.offset_ms - x.range_ms, self.grid.last - x.offset_ms
        first = (low // step + 1) * step
        if first > high:
            first = high // step * step
        inner = Compiler(self.samples, Grid.of(first, max(first, high), step), lookback=self.lookback, default_step=self.default_step)
        got = inner.vector(x.expr)
        return got.select("labels", inner.grid.time().alias("ts_ms"), "value", F.lit(False).alias("is_stale")), x.range_ms, x.offset_ms

    # -- vectors
    def vector(self, x) -> DataFrame:
        if S.is_scalar(x):
            s = self.scalar(x)
            return self._framed(s, "value").select(L.empty_map().alias("labels"), "step", "value")
        if isinstance(x, S.Selector):
            return self.instant(x)
        if isinstance(x, S.Negate):
            return self.vector(x.expr).select(_drop_name(F.col("labels")).alias("labels"), "step", (-F.col("value")).alias("value"))
        if isinstance(x, S.Aggregate):
            return self.aggregate(x)
        if isinstance(x, S.Call):
            return self.over_range(x) if x.name in S.RANGE_FUNCTIONS else self.call(x)
        if isinstance(x, S.Binary):
            return self.binary(x)
        raise S.PromQLError(f"promql: {x} can't be evaluated here")

    def over_range(self, x: S.Call) -> DataFrame:
        f = x.name
        samples, window, offset = self.range_samples(x.args[1 if f == "quantile_over_time" else 0])
        if f == "absent_over_time":
            return self._absent(_spread(samples, self.grid, window, offset, False).select("step").distinct(), x.args[0])
        needs_prev = f in ("rate", "increase", "irate", "idelta", "resets", "changes")
        sent = _spread(with_previous(samples) if needs_prev else samples, self.grid, window, offset, False)
        groups = sent.groupBy("labels", "step")
        v, t = F.col("value"), F.col("ts_ms")
        seconds = (t + offset - self.grid.time()) / F.lit(1000.0)
        keep_name = f == "last_over_time"
        where = None
        if f in ("rate", "increase", "delta"):
            reset = F.when(v < F.col("prev"), F.col("prev")).otherwise(F.lit(0.0)) if needs_prev else F.lit(0.0)
            agg = groups.agg(F.min(F.struct(t.alias("t"), v.alias("v"), reset.alias("r"))).alias("a"), F.max(F.struct(t.alias("t"), v.alias("v"))).alias("z"), F.count("*").alias("n"), F.sum(reset).alias("r"))
            where = F.col("n") > 1
            # resets between the samples of the window, not before its first
            change = F.col("z.v") - F.col("a.v") + F.col("r") - F.col("a.r")
            end = self.grid.time() - offset
            to_start, to_end = (F.col("a.t") - (end - window)) / F.lit(1000.0), (end - F.col("z.t")) / F.lit(1000.0)
            sampled = (F.col("z.t") - F.col("a.t")) / F.lit(1000.0)
            apart = sampled / (F.col("n") - 1)
            near = apart * 1.1
            to_start = F.when(to_start >= near, apart / 2).otherwise(to_start)
            if f != "delta":  # a counter is not extrapolated below zero
                to_zero = sampled * N.arithmetic("/", F.col("a.v"), change)
                to_start = F.when((change > 0) & (F.col("a.v") >= 0) & (to_zero < to_start), to_zero).otherwise(to_start)
            to_end = F.when(to_end >= near, apart / 2).otherwise(to_end)
            value = change * ((sampled + to_start + to_end) / sampled)
            value = value / F.lit(window / 1000.0) if f == "rate" else value
        elif f in ("irate", "idelta"):
            agg = groups.agg(F.max(F.struct(t.alias("t"), v.alias("v"), F.col("prev").alias("p"), F.col("prev_ms").alias("pt"))).alias("z"))
            where = F.col("z.pt") > self.grid.time() - offset - window
            change = F.col("z.v") - F.col("z.p")
            value = change if f == "idelta" else F.when(change < 0, F.col("z.v")).otherwise(change) / ((F.col("z.t") - F.col("z.pt")) / F.lit(1000.0))
        elif f in ("resets", "changes"):
            differs = (v < F.col("prev")) if f == "resets" else (v != F.col("prev")) & ~(F.isnan(v) & F.isnan("prev"))
            hit = F.when(F.col("prev").isNotNull() & differs, 1).otherwise(0)
            agg = groups.agg(F.sum(hit).alias("n"), F.min(F.struct(t.alias("t"), hit.alias("h"))).alias("a"))
            value = (F.col("n") - F.col("a.h")).cast("double")
        elif f in ("deriv", "predict_linear"):
            agg = groups.agg(F.regr_slope(v, seconds).alias("slope"), F.regr_intercept(v, seconds).alias("intercept"), F.count("*").alias("n"))
            where = F.col("n") > 1
            value = F.col("slope")
            if f == "predict_linear":
                agg = self._with_scalar(agg, self.scalar(x.args[1]))
                value = F.col("intercept") + F.col("slope") * F.col("scalar_value")
        elif f == "quantile_over_time":
            if isinstance(x.args[0], S.Number) and 0 <= x.args[0].value <= 1:  # counts by value, merged on the map side
                agg = groups.agg(F.percentile(F.when(F.isnan(v), F.lit(-math.inf)).otherwise(v), x.args[0].value).alias("q"))
                value = F.col("q")
            else:
                agg = self._with_scalar(groups.agg(F.collect_list(v).alias("values")), self.scalar(x.args[0]))
                value = _quantile(F.col("scalar_value"), F.col("values"))
        else:
            how = {
                "avg_over_time": F.avg(v), "sum_over_time": F.sum(v), "min_over_time": N.nan_min(v), "max_over_time": N.nan_max(v), "count_over_time": F.count(F.lit(1)).cast("double"),
                "last_over_time": F.max_by(v, t), "present_over_time": F.lit(1.0), "stddev_over_time": F.stddev_pop(v), "stdvar_over_time": F.var_pop(v),
            }[f]
            agg = groups.agg(F.count("*").alias("rows"), how.alias("value"))
            value = F.col("value")
        if where is not None:
            agg = agg.where(where)
        labels = F.col("labels") if keep_name else _drop_name(F.col("labels"))
        return agg.select(labels.alias("labels"), "step", value.alias("value"))

    def _absent(self, present: DataFrame, x) -> DataFrame:
        """1 at steps without any series, with the labels that equality matchers tell."""
        told: dict[str, str] = {}
        x = x.expr if isinstance(x, S.Subquery) else x
        if isinstance(x, S.Selector):
            names = [m.name for m in x.matchers]
            told = {m.name: m.value for m in x.matchers if m.op == "=" and names.count(m.name) == 1 and m.name != NAME and m.value}
        labels = F.create_map(*[F.lit(y) for kv in told.items() for y in kv]) if told else L.empty_map()
        return self.steps().join(present, "step", "left_anti").select(labels.alias("labels"), "step", F.lit(1.0).alias("value"))

    def call(self, x: S.Call) -> DataFrame:
        f, args = x.name, x.args
        v = F.col("value")
        if f == "absent":
            return self._absent(self.vector(args[0]).select("step").distinct(), args[0])
        if f == "vector":
            return self._framed(self.scalar(args[0]), "value").select(L.empty_map().alias("labels"), "step", "value")
        if f in ("sort", "sort_desc"):
            return self.vector(args[0])
        if f == "timestamp":
            df = self.instant(args[0], True) if isinstance(args[0], S.Selector) else self.vector(args[0]).withColumn("value", self.grid.time() / F.lit(1000.0))
            return df.withColumn("labels", _drop_name(F.col("labels")))
        if f == "histogram_quantile":
            return self.histogram_quantile(args)
        if f in ("label_replace", "label_join"):
            return self.relabel(x)
        if f in S.CALENDAR_FUNCTIONS:
            df = self.vector(args[0]) if args else self.vector(S.Call("time", ()))
            at = F.timestamp_seconds(F.floor(v).cast("long"))
            how = {"hour": F.hour(at), "minute": F.minute(at), "month": F.month(at), "year": F.year(at), "day_of_week": F.dayofweek(at) - 1, "day_of_month": F.dayofmonth(at), "day_of_year": F.dayofyear(at), "days_in_month": F.dayofmonth(F.last_day(at))}[f]
            return df.select(_drop_name(F.col("labels")).alias("labels"), "step", how.cast("double").alias("value"))
        df = self.vector(args[0])
        extra = []
        for i, a in enumerate(args[1:]):
            df = self._with_scalar(df, self.scalar(a), f"p{i}")
            extra.append(F.col(f"p{i}"))
        if f in ("clamp", "clamp_min", "clamp_max"):
            low = extra[0] if f != "clamp_max" else F.lit(-N.INF)
            high = extra[-1] if f != "clamp_min" else F.lit(N.INF)
            df = df.where(low <= high) if f == "clamp" else df
            value = F.when(F.isnan(v), v).otherwise(F.greatest(low, F.least(high, v)))
        elif f == "round":
            unit = F.lit(1.0) / (extra[0] if extra else F.lit(1.0))
            value = N.arithmetic("/", _floor(v * unit + 0.5), unit)
        else:
            zero_inf = lambda g: F.when(v == 0, F.lit(-N.INF)).when((v < 0) | F.isnan(v), F.lit(N.NAN)).otherwise(g)
            value = {
                "abs": lambda: F.abs(v), "ceil": lambda: -_floor(-v), "floor": lambda: _floor(v), "exp": lambda: F.exp(v), "sqrt": lambda: F.sqrt(v), "ln": lambda: zero_inf(F.ln(v)), "log2": lambda: zero_inf(F.log2(v)), "log10": lambda: zero_inf(F.log10(v)),
                "sgn": lambda: F.when(F.isnan(v), v).otherwise(F.signum(v)), "sin": lambda: F.sin(v), "cos": lambda: F.cos(v), "tan": lambda: F.tan(v), "asin": lambda: F.asin(v), "acos": lambda: F.acos(v), "atan": lambda: F.atan(v), "sinh": lambda: F.sinh(v), "cosh": lambda: F.cosh(v), "tanh": lambda: F.tanh(v),
                "asinh": lambda: F.asinh(v), "acosh": lambda: F.acosh(v), "atanh": lambda: F.atanh(v), "deg": lambda: F.degrees(v), "rad": lambda: F.radians(v),
            }[f]()
        return df.select(_drop_name(F.col("labels")).alias("labels"), "step", value.cast("double").alias("value"))

    def relabel(self, x: S.Call) -> DataFrame:
        df = self.vector(x.args[0])
        text = [a.value for a in x.args[1:]]
        labels = F.col("labels")
        if x.name == "label_join":
            target, sep, names = text[0], text[1], text[2:]
            value = F.concat_ws(sep, *[L.value_of(labels, n) for n in names])
            hit = F.lit(True)
        else:
            target, replacement, source, pattern = text
            old = L.value_of(labels, source)
            java = java_replacement(replacement, pattern)
            hit = old.rlike(L.anchored(pattern))
            value = F.regexp_replace(old, F.lit(rf"\A(?s:{check_re2(pattern)})\z"), F.lit(java))
        rest = L.drop(labels, (target,))
        made = F.when(value == "", rest).otherwise(F.map_concat(rest, F.create_map(F.lit(target), value)))
        return df.withColumn("labels", F.when(hit, made).otherwise(labels))

    def histogram_quantile(self, args) -> DataFrame:
        df = self.vector(args[1])
        le = N.float_of(L.value_of(F.col("labels"), "le"))
        buckets = df.withColumn("le", le).where(F.col("le").isNotNull()).withColumn("labels", L.drop(F.col("labels"), ("le", NAME)))
        # equal bounds are added up, then one short array for each histogram
        buckets = buckets.groupBy("labels", "step", "le").agg(F.sum("value").alias("v")).groupBy("labels", "step").agg(F.array_sort(F.collect_list(F.struct("le", "v"))).alias("b"))
        buckets = self._with_scalar(buckets, self.scalar(args[0]))
        # counts must not fall with the bound
        rise = F.aggregate("b", F.array().cast("array<struct<le:double,v:double>>"), lambda a, x: F.array_append(a, F.struct(x["le"].alias("le"), F.greatest(x["v"], F.coalesce(F.get(a, F.size(a) - 1)["v"], x["v"])).alias("v"))))
        buckets = buckets.withColumn("b", rise)
        q, n = F.col("scalar_value"), F.size("b")
        at = lambda i: F.get(F.col("b"), i)
        total = at(n - 1)["v"]
        rank = q * total
        i = F.size(F.filter("b", lambda x: x["v"] < rank))
        low = F.when(i > 0, at(i - 1)["le"]).otherwise(F.lit(0.0))
        below = F.when(i > 0, at(i - 1)["v"]).otherwise(F.lit(0.0))
        inside = low + (at(i)["le"] - low) * ((rank - below) / F.nullif(at(i)["v"] - below, F.lit(0.0)))
        value = (
            F.when((at(n - 1)["le"] != N.INF) | (n < 2) | (total == 0) | F.isnan(total) | F.isnan(q), F.lit(N.NAN)).when(q < 0, F.lit(-N.INF)).when(q > 1, F.lit(N.INF)).when(i >= n - 1, at(n - 2)["le"]).when((i == 0) & (at(0)["le"] <= 0), at(0)["le"]).otherwise(F.coalesce(inside, at(i)["le"]))
        )
        return buckets.select("labels", "step", value.alias("value"))

    def aggregate(self, x: S.Aggregate) -> DataFrame:
        df = self.vector(x.arg)
        labels = F.col("labels")
        group = L.drop(labels, (*x.labels, NAME)) if x.without else L.keep(labels, x.labels)
        v = F.col("value")
        if x.op in ("topk", "bottomk"):
            df = self._with_scalar(df, self.scalar(x.param)).withColumn("grp", L.canonical(group))
            order = Window.partitionBy("grp", "step").orderBy(F.isnan(v), F.desc("value") if x.op == "topk" else F.asc("value"), L.canonical(labels))
            return df.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= F.col("scalar_value")).select("labels", "step", "value")
        if x.op == "count_values":
            shown = F.when(F.isnan(v), F.lit("NaN")).when(F.abs(v) == N.INF, F.when(v > 0, F.lit("+Inf")).otherwise(F.lit("-Inf"))).when((v == F.floor(v)) & (F.abs(v) < 1e15), v.cast("decimal(20,0)").cast("string")).otherwise(v.cast("string"))
            made = F.map_concat(L.drop(group, (x.param.value,)), F.create_map(F.lit(x.param.value), shown))
            return df.select(made.alias("labels"), "step").groupBy("labels", "step").agg(F.count("*").cast("double").alias("value"))
        groups = df.select(group.alias("labels"), "step", "value").groupBy("labels", "step")
        if x.op == "quantile":
            got = self._with_scalar(groups.agg(F.collect_list(v).alias("values")), self.scalar(x.param))
            return got.select("labels", "step", _quantile(F.col("scalar_value"), F.col("values")).alias("value"))
        how = {"sum": F.sum(v), "avg": F.avg(v), "min": N.nan_min(v), "max": N.nan_max(v), "count": F.count(F.lit(1)).cast("double"), "group": F.max(F.lit(1.0)), "stddev": F.stddev_pop(v), "stdvar": F.var_pop(v)}[x.op]
        return groups.agg(how.alias("value"))

    # -- binary operators
    def binary(self, x: S.Binary) -> DataFrame:
        left_scalar, right_scalar = S.is_scalar(x.left), S.is_scalar(x.right)
        if left_scalar or right_scalar:
            df = self._with_scalar(self.vector(x.right if left_scalar else x.left), self.scalar(x.left if left_scalar else x.right))
            a, b = (F.col("scalar_value"), F.col("value")) if left_scalar else (F.col("value"), F.col("scalar_value"))
            bare = _drop_name(F.col("labels")).alias("labels")
            if x.op not in COMPARISONS:
                return df.select(bare, "step", N.arithmetic(x.op, a, b).alias("value"))
            held = N.compare(x.op, a, b)
            return df.select(bare, "step", held.cast("double").alias("value")) if x.bool_ else df.where(held).select("labels", "step", "value")
        m = x.matching
        left, right = self._keyed(self.vector(x.left), m), self._keyed(self.vector(x.right), m)
        if x.op in S.SET_OPS:
            keys = lambda df: df.select("key", "step").distinct()
            cols = ["labels", "step", "value"]
            if x.op == "and":
                return left.join(keys(right), ["key", "step"], "left_semi").select(*cols)
            if x.op == "unless":
                return left.join(keys(right), ["key", "step"], "left_anti").select(*cols)
            return left.select(*cols).unionByName(right.join(keys(left), ["key", "step"], "left_anti").select(*cols))
        many, one = (right, left) if m.group == "right" else (left, right)
        # several series of the side with one: an error, told when the plan runs
        told = F.raise_error(F.lit(f"promql: many-to-many matching not allowed: matching labels must be unique on one side of {x.op}"))
        single = one.groupBy("key", "step").agg(F.count("*").alias("n"), F.first("labels").alias("one_labels"), F.first("value").alias("one_value"))
        pairs = many.join(single, ["key", "step"])
        if m.group is None:
            pairs = pairs.groupBy("key", "step").agg(F.count("*").alias("k"), F.first("n").alias("n"), F.first("labels").alias("labels"), F.first("value").alias("value"), F.first("one_labels").alias("one_labels"), F.first("one_value").alias("one_value"))
            clash = (F.col("n") > 1) | (F.col("k") > 1)
        else:
            clash = F.col("n") > 1
        many_value = F.when(clash, told.cast("double")).otherwise(F.col("value"))
        a, b = (F.col("one_value"), many_value) if m.group == "right" else (many_value, F.col("one_value"))
        labels = F.col("labels")
        if x.op not in COMPARISONS or x.bool_:
            labels = _drop_name(labels)
        if m.group is None:
            labels = L.keep(labels, m.labels) if m.on else L.drop(labels, m.labels)
        elif m.include:
            taken = F.map_filter(L.keep(F.col("one_labels"), m.include), lambda _, v: v != "")
            labels = F.map_concat(L.drop(labels, m.include), taken)
        if x.op not in COMPARISONS:
            return pairs.select(labels.alias("labels"), "step", N.arithmetic(x.op, a, b).alias("value"))
        held = N.compare(x.op, a, b)
        if x.bool_:
            return pairs.select(labels.alias("labels"), "step", held.cast("double").alias("value"))
        return pairs.where(held).select(labels.alias("labels"), "step", F.col("one_value" if m.group == "right" else "value").alias("value"))

    def _keyed(self, df: DataFrame, m: S.Matching) -> DataFrame:
        by = L.keep(F.col("labels"), m.labels) if m.on else L.drop(F.col("labels"), (*m.labels, NAME))
        # an empty label is an absent one
        return df.withColumn("key", L.canonical(F.map_filter(by, lambda _, v: v != "")))


def java_replacement(text: str, pattern: str) -> str:
    """A replacement with $1, ${1}, $name and $$ as Java writes it; a name is as long as it can be, groups that are missing are empty."""
    compiled = re.compile(pattern)

    def group(m: re.Match) -> str:
        name = m[1] or m[2]
        if name is None:
            return r"\$"
        if name.isdigit():
            return f"${int(name)}" if int(name) <= compiled.groups else ""
        return f"${compiled.groupindex[name]}" if name in compiled.groupindex else ""

    parts, at = [], 0
    for m in re.finditer(r"\$(?:\{(\w+)\}|(\w+)|\$)", text):
        parts += [re.sub(r"([\\$])", r"\\\1", text[at : m.start()]), group(m)]
        at = m.end()
    rest = re.sub(r"([\\$])", r"\\\1", text[at:])
    # a digit right after a group would be read as part of its number
    out = ""
    for x in [*parts, rest]:
        out += ("\\" + x if re.search(r"(?<!\\)\$\d+$", out) and x[:1].isdigit() else x)
    return out


def _floor(v: Column) -> Column:
    """Floor of a double as a double; numbers beyond 2^53 are whole already."""
    big = (F.abs(v) >= 2.0**52) | F.isnan(v)
    return F.when(big, v).otherwise(F.floor(F.when(big, F.lit(0.0)).otherwise(v)).cast("double"))


def query(samples: DataFrame, text: str, grid: Grid, *, lookback: int = LOOKBACK, default_step: int = 60_000) -> DataFrame:
    """``labels, ts_ms, value`` of the query at every time of the grid at which it has a sample."""
    c = Compiler(samples, grid, lookback=lookback, default_step=default_step)
    return c.vector(S.parse(text)).select("labels", grid.time().alias("ts_ms"), "value")
