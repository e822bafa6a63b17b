"""Scrape targets from nodes and annotated pods."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values: annotations of pods, paths of a kubelet
SCRAPE, PORT, PATH, SCHEME = "prometheus.io/scrape", "prometheus.io/port", "prometheus.io/path", "prometheus.io/scheme"
KUBELET_PATHS = ("/metrics", "/metrics/cadvisor")


def _host(ip: Column, port: Column) -> Column:
    return F.concat(F.when(ip.contains(":"), F.concat(F.lit("["), ip, F.lit("]"))).otherwise(ip), F.lit(":"), port.cast("string"))


def kubelet_targets(nodes: DataFrame, port: int = 10250) -> DataFrame:
    """``url, labels``: both paths of the kubelet of each node (name, ip)."""
    paths = nodes.where(F.coalesce("ip", F.lit("")) != "").withColumn("path", F.explode(F.array(*[F.lit(p) for p in KUBELET_PATHS])))
    labels = F.map_filter(F.create_map(F.lit("job"), F.lit("kubelet"), F.lit("metrics_path"), F.col("path"), F.lit("node"), F.col("name")), lambda _, v: v.isNotNull() & (v != ""))
    return paths.select(F.concat(F.lit("https://"), _host(F.col("ip"), F.lit(port)), "path").alias("url"), labels.alias("labels"))


def pod_targets(pods: DataFrame) -> DataFrame:
    """``url, uid, container, port`` of the running pods that ask to be scraped.

    pods: ``uid, ip, phase, annotations MAP, ports ARRAY<STRUCT<container, port,
    protocol>>``.  With a port annotation there is one target, else one for each
    TCP port; a port or a scheme that is none leaves the pod out.
    """
    note = lambda k: F.element_at("annotations", F.lit(k))
    asked = pods.where((note(SCRAPE) == "true") & (F.coalesce("ip", F.lit("")) != "") & (F.col("phase") == "Running"))
    scheme = F.coalesce(F.nullif(note(SCHEME), F.lit("")), F.lit("http"))
    path = F.coalesce(F.nullif(note(PATH), F.lit("")), F.lit("/metrics"))
    path = F.when(path.startswith("/"), path).otherwise(F.concat(F.lit("/"), path))
    held = F.coalesce("ports", F.array().cast("array<struct<container:string,port:int,protocol:string>>"))
    told = F.when(F.trim(note(PORT)).rlike(r"^\+?\d{1,9}$"), F.trim(note(PORT)).try_cast("int"))
    owner = F.element_at(F.filter(held, lambda p: p["port"] == told), -1)["container"]
    by_note = F.when(told.between(1, 65535), F.array(F.struct(told.alias("port"), F.when(F.size(F.filter(held, lambda p: p["port"] == told)) > 0, owner).otherwise("").alias("container"))))
    tcp = F.filter(held, lambda p: p["port"].between(1, 65535) & (F.coalesce(p["protocol"], F.lit("")).isin("") | (F.upper(p["protocol"]) == "TCP")))
    ports = F.when(note(PORT).isNotNull(), by_note).otherwise(F.transform(tcp, lambda p: F.struct(p["port"].alias("port"), p["container"].alias("container"))))
    each = asked.where(scheme.isin("http", "https")).select("uid", "ip", scheme.alias("scheme"), path.alias("path"), F.explode(ports).alias("p"))
    return each.select(F.concat("scheme", F.lit("://"), _host(F.col("ip"), F.col("p.port")), "path").alias("url"), "uid", "p.container", "p.port").distinct()
