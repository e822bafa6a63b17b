"""Messages delivered at least once: keep exactly one copy of each.

An index of the identifiers seen so far is persisted as immutable runs.  A run
holds, for each hash prefix, one sorted array of 128-bit identifiers.  An incoming
batch is reduced to one row per identifier on the map side, shuffled by prefix,
and each prefix binary-searches its own arrays, which it reads straight from the
shared folder: the index itself is never shuffled.  What is novel is written as
the next run in the same job; runs are merged when there are more than
``fan_in``.  An index in a folder of its own outlives the session: a manifest
names its runs, and is replaced only after a run is whole.
"""

from __future__ import annotations

import json
import math
import uuid

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.workspace import Workspace

WIDTH = 16  # bytes of an identifier


def identifier(*parts: Column) -> Column:
    """128-bit digest of the parts; nulls are equal to each other and to nothing else."""
    sized = [F.when(p.isNull(), F.lit("-")).otherwise(F.concat(F.length(p.cast("string")).cast("string"), F.lit(":"), p.cast("string"))) for p in parts]
    return F.unhex(F.md5(F.concat_ws("|", *sized)))


def _file_system(uri: str):
    from pyarrow import fs

    if "://" not in uri and not uri.startswith("file:"):
        return fs.LocalFileSystem(), uri
    return fs.FileSystem.from_uri(uri.replace("s3a://", "s3://", 1))


def _load(run: str, prefix: int) -> np.ndarray:
    """The sorted identifiers of one prefix of one run."""
    import pyarrow.parquet as pq
    from pyarrow import fs

    system, base = _file_system(run)
    files = [f.path for f in system.get_file_info(fs.FileSelector(f"{base}/prefix={prefix}", allow_not_found=True)) if f.path.endswith(".parquet")]
    blobs = [b for f in files for b in pq.read_table(system.open_input_file(f), columns=["ids"]).column("ids").to_pylist()]
    if not blobs:
        return np.empty(0, f"S{WIDTH}")
    ids = np.frombuffer(b"".join(blobs), f"S{WIDTH}")
    return ids if len(blobs) == 1 else np.sort(ids)


def _known(ids: np.ndarray, sorted_run: np.ndarray) -> np.ndarray:
    if not len(sorted_run):
        return np.zeros(len(ids), bool)
    at = np.searchsorted(sorted_run, ids)
    return sorted_run[np.minimum(at, len(sorted_run) - 1)] == ids


class SeenIndex:
    """Identifiers seen so far, as sorted arrays by hash prefix in immutable runs.

    path: folder in which the index persists; opened again it knows all that was
    admitted before.  Without one it lives in the session's workspace.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, *, prefix_bits: int = 6, fan_in: int = 4):
        if not 1 <= prefix_bits <= 16:
            raise ValueError("prefix_bits must be from 1 to 16")
        self.ws = Workspace(spark)
        self.path = (path or f"{self.ws.path}/index").rstrip("/")
        self.spark, self.bits, self.fan_in, self.runs = spark, prefix_bits, fan_in, []
        if path and (known := self._manifest()):
            self.bits, self.runs = known["prefix_bits"], known["runs"]

    def _manifest(self) -> dict | None:
        system, base = _file_system(self.path)
        from pyarrow import fs

        found = [f.path for f in system.get_file_info(fs.FileSelector(base, allow_not_found=True)) if f.base_name.startswith("manifest-")]
        if not found:
            return None
        with system.open_input_stream(max(found)) as f:  # numbered: the last one counts
            return json.loads(f.read())

    def _commit(self, runs: list[str]) -> None:
        system, base = _file_system(self.path)
        system.create_dir(base, recursive=True)
        from pyarrow import fs

        old = [f.path for f in system.get_file_info(fs.FileSelector(base)) if f.base_name.startswith("manifest-")]
        number = max((int(x.rsplit("-", 1)[1]) for x in old), default=0) + 1
        with system.open_output_stream(f"{base}/manifest-{number:012d}") as f:
            f.write(json.dumps({"prefix_bits": self.bits, "runs": runs}).encode())
        self.runs = runs
        for x in sorted(old)[:-1]:  # the one before stays for readers that hold it
            system.delete_file(x)

    def admit(self, batch: DataFrame) -> DataFrame:
        """``row_id`` of the rows of ``batch`` (id BINARY, rank, row_id BIGINT) that are the first of an unseen identifier.

        The lowest (rank, row_id) of an identifier is its first.  The novel
        identifiers enter the index as a new run, written by the same job.
        """
        runs, bits = tuple(self.runs), self.bits
        firsts = batch.groupBy("id").agg(F.min(F.struct("rank", "row_id")).alias("first")).select("id", F.col("first.row_id").alias("row_id"))
        firsts = firsts.withColumn("prefix", F.shiftright(F.conv(F.hex(F.substring("id", 1, 2)), 16, 10).cast("int"), 16 - bits))

        def probe(rows: pd.DataFrame) -> pd.DataFrame:
            prefix = int(rows["prefix"].iloc[0])
            ids = np.frombuffer(b"".join(rows["id"]), f"S{WIDTH}")
            order = np.argsort(ids)
            ids, row_ids = ids[order], rows["row_id"].to_numpy()[order]
            known = np.zeros(len(ids), bool)
            for run in runs:
                known |= _known(ids, _load(run, prefix))
            return pd.DataFrame({"prefix": [prefix], "ids": [ids[~known].tobytes()], "rows": [row_ids[~known]]})

        run = f"{self.path}/run-{uuid.uuid4().hex}"
        firsts.groupBy("prefix").applyInPandas(probe, RUN).write.partitionBy("prefix").option("compression", "zstd").parquet(run)
        self._commit([*self.runs, run])
        novel = self.spark.read.schema(RUN).parquet(run).select(F.explode("rows").alias("row_id"))
        if len(self.runs) > self.fan_in:
            self._merge()
        return novel

    def _merge(self) -> None:
        """All runs become one; each prefix is merged by a task that reads its arrays itself."""
        old = tuple(self.runs)

        def merged(batches):
            for rows in batches:
                for prefix in rows["prefix"].tolist():
                    ids = np.sort(np.concatenate([_load(run, prefix) for run in old]))
                    yield pd.DataFrame({"prefix": [prefix], "ids": [ids.tobytes()], "rows": [[]]})

        run, count = f"{self.path}/run-{uuid.uuid4().hex}", 1 << self.bits
        prefixes = self.spark.range(0, count, 1, min(count, self.spark.sparkContext.defaultParallelism * 2)).select(F.col("id").cast("int").alias("prefix"))
        prefixes.mapInPandas(merged, RUN).write.partitionBy("prefix").option("compression", "zstd").parquet(run)
        self.retired = [*getattr(self, "retired", []), *old]
        self._commit([run])

    def vacuum(self) -> None:
        """Delete the runs that merges of this session replaced; what ``admit`` returned must have been read."""
        for run in getattr(self, "retired", []):
            self.ws.drop(run)
        self.retired = []


RUN = "ids binary, rows array<long>, prefix int"


def further_copies(rows: DataFrame, id_columns: list[Column], *, rank: str, row_id: str, batches: int = 6, prefix_bits: int | None = None, fan_in: int = 4) -> DataFrame:
    """``row_id`` of each row that is a further copy of its message.

    rows: deliveries; ``rank`` orders them by arrival and ``row_id`` is unique.
    They are admitted in batches of about equal size, in order of rank, so that
    the copy with the lowest (rank, row_id) is the one that stays.

    Defined results: null identifier parts are equal to each other; rows with a
    null row_id are ignored; a null rank comes first; an empty table yields none.
    """
    spark = rows.sparkSession
    ws = Workspace(spark)
    keyed = rows.select(identifier(*id_columns).alias("id"), F.coalesce(F.col(rank), F.lit(-(2**62))).cast("long").alias("rank"), F.col(row_id).cast("long").alias("row_id")).where(F.col("row_id").isNotNull())
    keyed = ws.write(keyed, "keyed")  # narrow, and read once for each batch
    shares = [i / batches for i in range(1, batches)]
    stats = keyed.agg(F.count("*").alias("n"), F.percentile_approx("rank", F.array(*[F.lit(s) for s in shares or [0.5]]), F.lit(1000)).alias("q")).first()
    if prefix_bits is None:  # about half a million identifiers of the whole index for each prefix
        prefix_bits = min(16, max(3, math.ceil(math.log2(max(1, stats["n"] / 500_000)))))
    index = SeenIndex(spark, prefix_bits=prefix_bits, fan_in=fan_in)
    edges = [None, *(sorted(set(stats["q"] or [])) if batches > 1 else []), None]
    kept: DataFrame | None = None
    for low, high in zip(edges, edges[1:]):
        batch = keyed
        if low is not None:
            batch = batch.where(F.col("rank") > low)
        if high is not None:
            batch = batch.where(F.col("rank") <= high)
        firsts = index.admit(batch)
        kept = firsts if kept is None else kept.unionByName(firsts)
    return keyed.select("row_id").join(kept, "row_id", "left_anti").select(F.col("row_id").cast(rows.schema[row_id].dataType).alias(row_id))
