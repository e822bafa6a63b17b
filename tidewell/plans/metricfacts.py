"""Summaries of container and volume metrics over an interval, as PromQL over the samples."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.functions import labels as L
from tidewell.plans import promql

BY = "namespace, pod, container, node"


def fact_queries(interval_s: int) -> dict[str, str]:
    """PromQL of each fact of an interval: quantiles of use, last requests and limits, restarts."""
    step = min(30, max(1, interval_s // 4))
    rate = max(120, 4 * step)
    cpu = f"sum by ({BY}) (rate(container_cpu_usage_seconds_total[{rate}s]))[{interval_s}s:{step}s]"
    memory = f"sum by ({BY}) (container_memory_working_set_bytes)[{interval_s}s:{step}s]"
    out = {f"{name}_p{q}": f"quantile_over_time({q / 100}, {sub})" for name, sub in (("cpu", cpu), ("memory", memory)) for q in (50, 95)}
    for what in ("requests", "limits"):
        for resource in ("cpu", "memory"):
            out[f"{resource}_{what[:-1]}"] = f'max by ({BY}) (last_over_time(kube_pod_container_resource_{what}{{resource="{resource}"}}[{interval_s}s]))'
    total = "kube_pod_container_status_restarts_total"
    out["restarts"] = f"sum by ({BY}) (max_over_time({total}[{interval_s}s]) - min_over_time({total}[{interval_s}s]))"
    return out


def container_facts(samples: DataFrame, at_ms: int, interval_s: int) -> DataFrame:
    """``namespace, pod, container, facts MAP<STRING,DOUBLE>``.

    CPU is rounded to four digits and bytes to whole ones before shares are
    derived; what is not finite is left out.
    """
    frames = None
    for name, text in fact_queries(interval_s).items():
        got = promql.query(samples, text, promql.Grid(at_ms)).select(*[L.value_of(F.col("labels"), n).alias(n) for n in ("namespace", "pod", "container")], F.lit(name).alias("fact"), F.round("value", 4 if name.startswith("cpu") else 0).alias("value"))
        frames = got if frames is None else frames.unionByName(got)
    finite = frames.where(~F.isnan("value") & (F.abs("value") != float("inf")))
    # a restart count may lack the node: facts are keyed by the container
    facts = finite.groupBy("namespace", "pod", "container").agg(F.map_from_entries(F.collect_list(F.struct("fact", "value"))).alias("facts"))
    get = lambda k: F.element_at("facts", F.lit(k))
    derived = F.create_map(
        F.lit("restarts_per_hour"), F.round(get("restarts") / (interval_s / 3600), 4),
        *[x for r in ("cpu", "memory") for x in (F.lit(f"{r}_p95_of_limit"), F.round(F.try_divide(get(f"{r}_p95"), get(f"{r}_limit")), 4), F.lit(f"{r}_saturated"), (get(f"{r}_p95") > 0.9 * get(f"{r}_limit")).cast("double"))],
    )
    return facts.select("namespace", "pod", "container", F.map_concat("facts", F.map_filter(derived, lambda _, v: v.isNotNull())).alias("facts"))
