"""The query surface: one engine over tables of lines, samples, resources and edges, within a scope and limits."""

from __future__ import annotations

import re
from dataclasses import dataclass, field, fields, replace

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewell.functions import labels as L
from tidewell.functions.redact import redact_json, redact_object, redact_text
from tidewell.operators import state
from tidewell.plans import logql, logql_syntax, promql, promql_syntax
from tidewell.plans.logql_syntax import Matcher
from tidewell.sources.logs import newest_evidence


@dataclass(frozen=True)
class Limits:
    """What a call may return; a request can only lower them, 0 means the maximum."""

    max_lines: int = 5000
    max_bytes: int = 4 << 20
    max_series: int = 1000
    max_samples: int = 500_000
    max_depth: int = 5

    def clamp(self, **asked: int) -> Limits:
        for name, n in asked.items():
            if n < 0:
                raise ValueError(f"{name} must not be negative")
        return replace(self, **{f.name: min(asked[f.name], getattr(self, f.name)) for f in fields(self) if asked.get(f.name)})


@dataclass(frozen=True)
class Scope:
    """What a caller may see; scopes only ever narrow a query.  Empty means the whole cluster."""

    namespaces: tuple[str, ...] = ()
    nodes: tuple[str, ...] = ()
    uids: tuple[str, ...] = ()

    def matchers(self) -> list[Matcher]:
        out = []
        for label, values in (("namespace", self.namespaces), ("node", self.nodes)):
            if len(values) == 1:
                out.append(Matcher(label, "=", values[0]))
            elif values:
                out.append(Matcher(label, "=~", "|".join(re.escape(v).replace(r"\-", "-") for v in sorted(values))))
        return out

    def visible(self, resources: DataFrame) -> DataFrame:
        if not (self.namespaces or self.nodes or self.uids):
            return resources
        node = F.element_at("fields", F.lit("nodeName"))
        seen = F.col("namespace").isin(*self.namespaces) | F.col("uid").isin(*self.uids) | ((F.col("kind") == "Node") & F.col("name").isin(*self.nodes)) | node.isin(*[f'"{n}"' for n in self.nodes])
        return resources.where(F.coalesce(seen, F.lit(False)))


@dataclass
class Engine:
    """lines and samples as in the plans; resources: uid, kind, namespace, name, fields MAP; edges: from_uid, type, to_uid, attrs."""

    lines: DataFrame | None = None
    samples: DataFrame | None = None
    resources: DataFrame | None = None
    edges: DataFrame | None = None
    evidence: DataFrame | None = None
    external: dict[str, DataFrame] = field(default_factory=dict)
    limits: Limits = field(default_factory=Limits)
    scope: Scope = field(default_factory=Scope)

    def state_query(self, **where) -> DataFrame:
        return state.state_query(self.scope.visible(self.resources), **where)

    def object_get(self, objects: DataFrame, uid: str) -> DataFrame:
        """One object (uid, kind, namespace, name, object JSON), redacted."""
        seen = self.scope.visible(self.resources).select("uid")
        return objects.where(F.col("uid") == uid).join(seen, "uid", "left_semi").withColumn("object", redact_object("kind", "object") if "kind" in objects.columns else redact_json("object"))

    def graph_query(self, uid: str, *, depth: int = 1, direction: str = "both", types: tuple[str, ...] | None = None) -> DataFrame:
        """Resources within ``depth`` hops of one, and their least depth; resources out of scope are not entered."""
        seen = self.scope.visible(self.resources)
        starts = seen.where(F.col("uid") == uid).select("uid")
        walk = state.graph_walk(self.edges, starts, depth=min(depth, self.limits.max_depth), direction=direction, types=types, scope=(), visible=seen)
        return walk.join(seen, "uid").select("uid", "kind", "namespace", "name", "depth")

    def promql(self, text: str, start_ms: int, end_ms: int | None = None, step_ms: int | None = None, **limits: int) -> DataFrame:
        grid = promql.Grid(start_ms) if end_ms is None else promql.Grid.of(start_ms, end_ms, step_ms or 60_000)
        bound = self.limits.clamp(**limits)
        if grid.count > bound.max_samples:
            raise promql_syntax.PromQLError(f"promql: {grid.count} points exceed {bound.max_samples}")
        got = promql.query(self.samples, promql_syntax.inject_scope(text, self.scope.matchers()), grid)
        return bound_series(got, "ts_ms", bound)

    def logql(self, text: str, start_ns: int, end_ns: int | None = None, step_ns: int | None = None, *, backward: bool = True, **limits: int) -> DataFrame:
        """A log query over [start, end), a metric query at start, or on the grid from start to end."""
        bound = self.limits.clamp(**limits)
        scoped = logql_syntax.inject_scope(text, self.scope.matchers())
        if isinstance(logql_syntax.parse(scoped), logql_syntax.LogQuery):
            if end_ns is None:
                raise logql_syntax.LogQLError("logql: a log query needs an end")
            got = logql.log_query(self.lines, scoped, start_ns, end_ns, limit=bound.max_lines, max_bytes=bound.max_bytes, backward=backward)
            return got.withColumn("line", redact_text(F.col("line")))
        grid = logql.Grid(start_ns) if end_ns is None else logql.Grid.of(start_ns, end_ns, step_ns or 60 * 10**9)
        if grid.count > bound.max_samples:
            raise logql_syntax.LogQLError(f"logql: {grid.count} steps exceed {bound.max_samples}")
        return bound_series(logql.metric_query(self.lines, scoped, grid), "ts_ns", bound)

    def lookback(self, source: str, text: str, start: int, end: int | None = None, step: int | None = None, **limits: int) -> DataFrame:
        """A query over an external source of lines or samples, within the same scope and limits; times as its language has them."""
        if source not in self.external:
            raise ValueError(f"no source {source!r}")
        rows = self.external[source]
        if "line" in rows.columns:
            return replace(self, lines=rows).logql(text, start, end, step, **limits)
        return replace(self, samples=rows).promql(text, start, end, step, **limits)

    def evidence_query(self, n: int = 10) -> DataFrame:
        """Newest evidence lines of each rule, within the scope."""
        return newest_evidence(logql.select_streams(self.evidence, tuple(self.scope.matchers())), n)

    def missing_inputs(self, text: str, at_ms: int) -> DataFrame:
        """``metric``: names that a query reads and that have no sample within its reach."""
        x = promql_syntax.parse(text)
        spark = self.samples.sparkSession
        wanted = spark.createDataFrame([(n,) for n in sorted(promql_syntax.inputs(x))], "metric string")
        near = self.samples.where((F.col("ts_ms") > at_ms - promql_syntax.reach(x)) & (F.col("ts_ms") <= at_ms))
        return wanted.join(near.select(F.element_at("labels", F.lit("__name__")).alias("metric")).distinct(), "metric", "left_anti")


def bound_series(got: DataFrame, time: str, limits: Limits) -> DataFrame:
    """Series in label order, as many as fit both limits: a prefix, with no series cut.

    Ranks run over one row for each series, not over the samples.
    """
    keyed = got.withColumn("sid", L.canonical(F.col("labels")))
    sizes = keyed.groupBy("sid").agg(F.count("*").alias("n"))
    order = Window.orderBy("sid").rowsBetween(Window.unboundedPreceding, 0)
    first = sizes.orderBy("sid").limit(limits.max_series)
    kept = first.withColumn("so_far", F.sum("n").over(order)).where(F.col("so_far") <= limits.max_samples)
    return keyed.join(kept.select("sid"), "sid", "left_semi").drop("sid").orderBy(L.canonical(F.col("labels")), time)
