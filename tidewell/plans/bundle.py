"""Rule bundles: loading, validation, and evaluation of rules to observations."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.functions import labels as L
from tidewell.plans import cel, logql, logql_syntax, promql, promql_syntax
from tidewell.plans.logql_syntax import parse_duration

CLASSES = ("state", "promql", "logql")
#: Of several states of a rule the first of these holds.
STATES = ("disabled", "unsupported", "budget_limited", "failed", "converging", "stale", "warming", "evidence", "active")
MAX_BUCKET_BYTES, MAX_SERIES, BUCKET = 4 << 20, 1000, 24


@dataclass(frozen=True)
class Rule:
    id: str
    cls: str
    expr: str
    version: int = 1
    kinds: tuple[str, ...] = ()
    labels: dict[str, str] = field(default_factory=dict)
    for_ms: int = 0
    keep_ms: int = 0
    interval_ms: int = 60_000
    severity: str = ""
    dedup: tuple[str, ...] = ()
    required: tuple[str, ...] = ()
    enabled: bool = True
    max_complexity: int = 500


def _millis(text) -> int:
    ns = 0 if text in (None, "", 0, "0s") else parse_duration(str(text))
    if ns is None:
        raise ValueError(f"bad duration {text!r}")
    return ns // 10**6


def load(manifest: str, files: Iterable[str]) -> list[Rule]:
    """Rules of a bundle: its manifest and rule files, both YAML texts."""
    import yaml

    meta = {r["id"]: r for r in (yaml.safe_load(manifest) or {}).get("rules", [])}
    out = []
    for text in files:
        for r in yaml.safe_load(text) or []:
            m = meta.get(r["id"], {})
            dedup = m.get("dedup_key", "")
            out.append(
                Rule(
                    r["id"], m.get("class", r.get("class", "")), str(r["expr"]).strip(), int(r.get("version", 1)), tuple(r.get("kinds", ())), {k: str(v) for k, v in (r.get("labels") or {}).items()}, _millis(r.get("for")), _millis(r.get("keep_firing_for")), _millis(r.get("interval", "1m")),
                    m.get("severity", ""), tuple(x for x in dedup.split(",") if x), tuple(m.get("required_fields", ())), bool(m.get("enabled", True)), int((m.get("budget") or {}).get("max_complexity", 500)),
                )
            )
    return out


def counter_bytes(range_ns: int, series: int = MAX_SERIES) -> int:
    """Memory of a bucketed counter: sixty buckets of the range, one second wide at least."""
    width = max(range_ns // 60, 10**9)
    return (-(-range_ns // width) + 1) * series * BUCKET


def _ranges(x) -> list[int]:
    if isinstance(x, logql_syntax.RangeAgg):
        return [x.range_ns]
    return [r for c in (getattr(x, "arg", None), getattr(x, "left", None), getattr(x, "right", None)) if c is not None for r in _ranges(c)]


def validate(rules: list[Rule], disabled: frozenset[str] = frozenset(), metrics: frozenset[str] | None = None) -> dict[str, tuple[str, str]]:
    """State and reason of each rule: active, disabled, unsupported or rejected.

    A bundle with a rejected rule must not be used.  metrics: known ``kube_``
    names; a rule that reads another is rejected.
    """
    out: dict[str, tuple[str, str]] = {}
    for r in rules:
        if r.id in out:
            out[r.id] = ("rejected", "duplicate rule id")
            continue
        if r.cls not in CLASSES:
            out[r.id] = ("unsupported", f"class {r.cls!r}")
            continue
        try:
            if r.cls == "state":
                if not r.kinds:
                    raise ValueError("a state rule needs kinds")
                for text in [r.expr, *[v[1:] for v in r.labels.values() if v.startswith("=")]]:
                    cel.compile_cel(text, r.max_complexity)
            elif r.cls == "promql":
                x = promql_syntax.validate_rule(r.expr, r.max_complexity)
                unknown = {n for n in promql_syntax.inputs(x, False) if metrics is not None and n.startswith("kube_") and n not in metrics}
                if unknown:
                    raise ValueError(f"unknown series {', '.join(sorted(unknown))}")
            else:
                x = logql_syntax.parse(r.expr)
                if isinstance(x, logql_syntax.LogQuery):
                    raise ValueError("a rule needs a metric query")
                if logql_syntax.complexity(x) > r.max_complexity:
                    raise ValueError("the query is too complex")
                for ns in _ranges(x):
                    if ns < 10**9:
                        raise ValueError("a range must be a second at least")
                    if counter_bytes(ns) > MAX_BUCKET_BYTES:
                        raise ValueError(f"counters of {counter_bytes(ns)} bytes exceed {MAX_BUCKET_BYTES}")
        except (ValueError, cel.CelError) as e:
            out[r.id] = ("rejected", str(e))
            continue
        out[r.id] = ("disabled", "") if r.id in disabled or not r.enabled else ("active", "")
    return out


def programs(rules: list[Rule]) -> dict[str, list[Rule]]:
    """Rules by canonical expression: equal programs are evaluated once."""
    out: dict[str, list[Rule]] = {}
    for r in rules:
        text = str(logql_syntax.parse(r.expr)) if r.cls == "logql" else str(promql_syntax.parse(r.expr)) if r.cls == "promql" else r.expr
        out.setdefault(f"{r.cls}:{text}", []).append(r)
    return out


def observations(rules: list[Rule], at_ms: int, *, samples: DataFrame | None = None, lines: DataFrame | None = None, resources: DataFrame | None = None, edges: DataFrame | None = None) -> DataFrame:
    """``rule_id, instance_key, eval_ms, labels, value, error`` of one evaluation of all rules.

    An instance is keyed by its labels, of state rules by the resource's uid; a
    null value with an error is an incomplete evaluation.
    """
    frames = []
    for same in programs(rules).values():
        first = same[0]
        if first.cls == "state":
            for r in same:
                got = cel.evaluate(resources, r.expr, at_ms, kinds=r.kinds, labels=r.labels, required=r.required, edges=edges).where(F.col("holds") | F.col("error").isNotNull())
                frames.append(got.select(F.lit(r.id).alias("rule_id"), F.col("uid").alias("instance_key"), "labels", F.when(F.col("holds"), 1.0).alias("value"), "error"))
            continue
        if first.cls == "promql":
            got = promql.query(samples, first.expr, promql.Grid(at_ms)).select("labels", "value")
        else:
            got = logql.metric_query(lines, first.expr, logql.Grid(at_ms * 10**6)).select("labels", "value")
        for r in same:
            own = F.create_map(*[F.lit(x) for kv in r.labels.items() for x in kv], F.lit("alertname"), F.lit(r.id))
            labels = F.map_concat(L.drop(F.col("labels"), ("__name__", "alertname", *r.labels)), own)
            frames.append(got.select(F.lit(r.id).alias("rule_id"), L.canonical(labels).alias("instance_key"), labels.alias("labels"), "value", F.lit(None).cast("string").alias("error")))
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out.withColumn("eval_ms", F.lit(at_ms).cast("long"))


def rule_state(flags: dict[str, Column]) -> Column:
    """The first state in order of precedence whose flag holds; ``active`` if none does."""
    state = None
    for name in STATES[:-1]:
        if name in flags:
            state = F.when(flags[name], name) if state is None else state.when(flags[name], name)
    return F.lit("active") if state is None else state.otherwise("active")


def rollup(statuses: DataFrame) -> DataFrame:
    """Nodes in each state for each rule version, and the worst coverage (a rank)."""
    counts = [F.count_if(F.col("state") == s).alias(s) for s in STATES]
    return statuses.groupBy("rule_id", "version").agg(*counts, F.max("coverage").alias("worst_coverage"))


def match_evidence(evidence: DataFrame, alerts: DataFrame) -> DataFrame:
    """Each line with the first alert of its rule whose shared labels agree; of a rule the oldest alert counts first.

    Lines and alerts meet by equality: for each pair of sets of label names (few
    for a rule) the values of the shared names are a key, of which only the first
    alert is kept before the join.  So no line is paired with every alert.
    """
    from pyspark.sql import Window

    names_of = F.array_sort(F.map_keys("labels"))
    lines, told = evidence.withColumn("_names", names_of), alerts.select("rule_id", "instance_key", "active_ms", F.col("labels").alias("_labels"), names_of.alias("_told"))
    sets = lines.select("rule_id", "_names").distinct().join(told.select("rule_id", "_told").distinct(), "rule_id").withColumn("_shared", F.array_sort(F.array_intersect("_names", "_told")))

    def key(labels: str):
        return F.to_json(F.transform("_shared", lambda n: F.element_at(F.col(labels), n)))

    firsts = told.join(sets, ["rule_id", "_told"]).groupBy("rule_id", "_names", "_shared", key("_labels").alias("_key")).agg(F.min(F.struct("active_ms", "instance_key")).alias("_first"))
    keyed = lines.join(sets.select("rule_id", "_names", "_shared").distinct(), ["rule_id", "_names"]).withColumn("_key", key("labels"))
    both = keyed.join(firsts, ["rule_id", "_names", "_shared", "_key"])
    best = Window.partitionBy("rule_id", "ts_ns", "seq").orderBy("_first")
    return both.withColumn("_rank", F.row_number().over(best)).where("_rank = 1").select(*evidence.columns, F.col("_first.instance_key").alias("instance_key"))
