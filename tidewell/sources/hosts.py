"""Facts of hosts from their text files: release, packages, sockets, mounts, memory."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PACKAGE = ("manager", "name", "version", "arch", "state", "source", "source_version")


def key_values(text: Column, sep: str = "=") -> Column:
    """Map of the lines KEY=value of a text; quotes around a value are taken off, comments left out."""
    rows = F.filter(F.split(text, "\n"), lambda r: r.contains(sep) & ~F.startswith(F.ltrim(r), F.lit("#")))
    pairs = F.transform(rows, lambda r: F.struct(F.trim(F.substring_index(r, sep, 1)).alias("k"), F.regexp_replace(F.trim(F.substr(r, F.instr(r, F.lit(sep)) + len(sep))), r"""^(["'])(.*)\1$""", "$2").alias("v")))
    return F.map_from_entries(_last_of(pairs))


def _last_of(pairs: Column) -> Column:
    """Pairs with each key once, the last of it."""
    return F.aggregate(pairs, F.slice(pairs, 1, 0), lambda a, x: F.array_append(F.filter(a, lambda y: y["k"] != x["k"]), x))


def deb_packages(blocks: DataFrame) -> DataFrame:
    """Packages from the blocks (column ``value``) of a dpkg status file."""
    at = key_values(F.regexp_replace("value", r"\n[ \t][^\n]*", ""), ":")
    df = blocks.select(at.alias("m"))
    get = lambda k: F.element_at("m", F.lit(k))
    source = F.coalesce(get("Source"), get("Package"))
    version = F.regexp_extract(source, r"\(([^)]*)\)", 1)
    return df.where(get("Package").isNotNull() & get("Version").isNotNull()).select(F.lit("dpkg").alias("manager"), get("Package").alias("name"), get("Version").alias("version"), get("Architecture").alias("arch"), F.element_at(F.split(get("Status"), " "), -1).alias("state"), F.trim(F.regexp_replace(source, r"\(.*", "")).alias("source"), F.when(version != "", version).otherwise(get("Version")).alias("source_version"))


def apk_packages(blocks: DataFrame) -> DataFrame:
    """Packages from the blocks of an apk database."""
    at = key_values(F.col("value"), ":")
    df = blocks.select(at.alias("m"))
    get = lambda k: F.element_at("m", F.lit(k))
    return df.where(get("P").isNotNull() & get("V").isNotNull()).select(F.lit("apk").alias("manager"), get("P").alias("name"), get("V").alias("version"), get("A").alias("arch"), F.lit("installed").alias("state"), F.coalesce(get("o"), get("P")).alias("source"), get("V").alias("source_version"))


def normalize_packages(packages: DataFrame, max_bytes: int, key: str = "host") -> DataFrame:
    """Distinct valid packages of each host in order, as a prefix that fits; ``truncated`` tells of a cut."""
    from pyspark.sql import Window

    valid = packages.where((F.coalesce("name", F.lit("")) != "") & (F.coalesce("version", F.lit("")) != "")).dropDuplicates([key, *PACKAGE])
    order = Window.partitionBy(key).orderBy("name", "version", "arch", "manager")
    size = F.sum(F.octet_length(F.to_json(F.struct(*PACKAGE)))).over(order.rowsBetween(Window.unboundedPreceding, 0))
    sized = valid.withColumn("size", size).withColumn("truncated", F.max("size").over(Window.partitionBy(key)) > max_bytes)
    return sized.where(F.col("size") <= max_bytes).drop("size")


def package_sets(packages: DataFrame, key: str = "host") -> DataFrame:
    """``key, digest``: hosts with the same packages share a digest."""
    row = F.sha2(F.to_json(F.struct(*PACKAGE)), 256)
    return packages.groupBy(key).agg(F.sha2(F.array_join(F.array_sort(F.collect_set(row)), ","), 256).alias("digest"))


def listening_sockets(sockets: DataFrame, keys: tuple[str, ...] = ("host",)) -> DataFrame:
    """Listening sockets grouped by protocol, address and port: uids, inodes, and the lowest process as owner."""
    mine = sockets.where((F.col("protocol").startswith("tcp") & (F.col("state") == "LISTEN")) | (F.col("protocol").startswith("udp") & (F.col("state") == "UNCONN")))
    return mine.groupBy(*keys, "protocol", "address", "port").agg(F.array_sort(F.collect_set("uid")).alias("uids"), F.array_sort(F.collect_set("inode")).alias("inodes"), F.min("pid").alias("owner_pid"))


def mounts(lines: Column) -> Column:
    """STRUCT of a mountinfo line."""
    halves = F.split(lines, " - ", 2)
    a, b = F.split(F.get(halves, 0), " "), F.split(F.get(halves, 1), " ")
    return F.struct(F.get(a, 0).cast("int").alias("id"), F.get(a, 1).cast("int").alias("parent"), F.get(a, 2).alias("device"), F.get(a, 3).alias("root"), F.replace(F.get(a, 4), F.lit("\\040"), F.lit(" ")).alias("mountpoint"), F.get(a, 5).alias("options"), F.get(b, 0).alias("fstype"), F.get(b, 1).alias("source"))


def used_bucket(percent: Column, previous: Column) -> Column:
    """Used share in tens; the last bucket stays while the share is within 2 below and 12 above it."""
    stays = previous.isNotNull() & (percent >= previous - 2) & (percent < previous + 12)
    return F.when(stays, previous).otherwise((F.floor(percent / 10) * 10).cast("int"))


def memory_info(text: Column) -> Column:
    """Map of /proc/meminfo in bytes."""
    return F.transform_values(key_values(text, ":"), lambda _, v: F.regexp_extract(v, r"^(\d+)", 1).try_cast("long") * F.when(v.contains("kB"), F.lit(1024)).otherwise(F.lit(1)))


def overlay_files(files: DataFrame, image: str = "image") -> DataFrame:
    """Files of an image after its layers (``image, layer, path, data``): whiteouts hide what lies below.

    ``.wh.name`` removes a path and all under it in lower layers, ``.wh..wh..opq``
    hides the directory's content of lower layers; of a path the last layer wins.
    Whiteouts are joined with the directories above each file, not by ranges.
    """
    base = F.element_at(F.split("path", "/"), -1)
    folder = F.regexp_replace("path", r"/?[^/]*$", "")
    wh = files.where(base.startswith(".wh."))
    under = F.when(folder == "", F.lit("")).otherwise(F.concat(folder, F.lit("/")))
    opaque = base == ".wh..wh..opq"
    hides = wh.select(image, F.col("layer").alias("wl"), F.when(opaque, folder).otherwise(F.concat(under, F.substr(base, F.lit(5)))).alias("at"), opaque.alias("opaque"))
    real = files.where(~base.startswith(".wh.")).withColumn("parts", F.split("path", "/"))
    tops = F.transform(F.sequence(F.lit(0), F.size("parts")), lambda n: F.array_join(F.slice("parts", F.lit(1), n), "/"))
    hit = real.select(image, "layer", "path", F.explode(tops).alias("at")).join(hides, [image, "at"]).where((F.col("wl") > F.col("layer")) & (~F.col("opaque") | (F.col("at") != F.col("path"))))
    left = real.drop("parts").join(hit.select(image, "layer", "path").distinct(), [image, "layer", "path"], "left_anti")
    rest = [c for c in files.columns if c not in (image, "path")]
    return left.groupBy(image, "path").agg(F.max_by(F.struct(*rest), "layer").alias("f")).select(image, "path", "f.*")


CPU_MODES = ("user", "nice", "system", "idle", "iowait", "irq", "softirq", "steal")


def cpu_times(text: Column, per_second: int = 100) -> Column:
    """ARRAY<STRUCT<cpu, mode, seconds>> of /proc/stat; the total line is left out."""
    rows = F.filter(F.split(text, "\n"), lambda r: r.rlike(r"^cpu\d+ "))

    def each(r: Column) -> Column:
        parts = F.split(F.regexp_replace(r, " +", " "), " ")
        return F.array(*[F.struct(F.substr(F.get(parts, 0), F.lit(4)).alias("cpu"), F.lit(m).alias("mode"), (F.get(parts, i).try_cast("double") / per_second).alias("seconds")) for i, m in enumerate(CPU_MODES, 1)])

    return F.filter(F.flatten(F.transform(rows, each)), lambda x: x["seconds"].isNotNull())


def network_bytes(text: Column) -> Column:
    """ARRAY<STRUCT<device, received, sent>> of /proc/net/dev."""
    rows = F.filter(F.split(text, "\n"), lambda r: r.rlike(r"^\s*[^\s|:]+:\s*\d"))

    def each(r: Column) -> Column:
        numbers = F.split(F.trim(F.regexp_replace(F.substring_index(r, ":", -1), r"\s+", " ")), " ")
        return F.struct(F.trim(F.substring_index(r, ":", 1)).alias("device"), F.get(numbers, 0).try_cast("long").alias("received"), F.get(numbers, 8).try_cast("long").alias("sent"))

    return F.transform(rows, each)
