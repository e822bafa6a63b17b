"""Tables written to the shared folder, to cut lineage where a plan is used again.

The folder is the one that the cluster names in ``spark.checkpoint.dir``; a
local one is set only where the session has none and its master is local (tests,
a laptop): elsewhere a missing setting is an error.  Parquet
is used rather than ``Dataset.checkpoint`` because it is compressed, keeps
column statistics and is committed atomically, so a lost executor costs a
retried task and nothing else.
"""

from __future__ import annotations

import atexit
import io
import itertools
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``, or a temporary one if unset and the master is local."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    fallback = getattr(shared_dir, "fallback", None)
    if fallback is None:
        fallback = shared_dir.fallback = tempfile.mkdtemp(prefix="tidewell-")
    spark.conf.set("spark.checkpoint.dir", f"file://{fallback}")
    return f"file://{fallback}"


class Workspace:
    """A private folder below the shared one, holding the tables of one job."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.path = f"{shared_dir(spark)}/tidewell-{uuid.uuid4().hex}"
        self._numbers = itertools.count()
        atexit.register(self.clear)

    def write(self, df: DataFrame, name: str = "t", partition_by: tuple[str, ...] = ()) -> DataFrame:
        """Write ``df`` and return a frame that reads it back."""
        return self.read(self.save(df, name, partition_by), df)

    def save(self, df: DataFrame, name: str = "t", partition_by: tuple[str, ...] = ()) -> str:
        path = f"{self.path}/{next(self._numbers)}-{name}"
        writer = df.write.option("compression", "zstd")
        (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
        return path

    def save_counting(self, df: DataFrame, name: str = "t", what: Column | None = None) -> tuple[str, int]:
        """Path of a written table and its number of rows (or of those for which ``what`` holds), counted by the job that writes it."""
        seen = Observation()
        counted = F.count(F.lit(1)) if what is None else F.count_if(what)
        path = self.save(df.observe(seen, counted.alias("n")), name)
        return path, seen.get["n"]

    def read(self, path: str, like: DataFrame) -> DataFrame:
        return self.spark.read.schema(like.schema).parquet(path)

    def drop(self, path: str) -> None:
        """Delete a table that no later plan reads."""
        try:
            jvm = self.spark.sparkContext._jvm
            target = jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
        except Exception:  # the session may be gone at exit
            pass

    def clear(self) -> None:
        if self.spark.sparkContext._jsc is not None:
            self.drop(self.path)


def ship(spark: SparkSession) -> None:
    """Send this package to the workers, once for each session, through the shared folder."""
    sc = spark.sparkContext
    if getattr(ship, "done", None) == sc.applicationId:
        return
    root, packed = Path(__file__).resolve().parent, io.BytesIO()
    with zipfile.ZipFile(packed, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent).as_posix())
    name = f"{shared_dir(spark)}/tidewell-{uuid.uuid4().hex}.zip"
    path = sc._jvm.org.apache.hadoop.fs.Path(name)
    out = path.getFileSystem(sc._jsc.hadoopConfiguration()).create(path)
    out.write(packed.getvalue())
    out.close()
    sc.addPyFile(name)
    ship.done = sc.applicationId


def empty_like(spark: SparkSession, schema) -> DataFrame:
    return spark.createDataFrame([], schema)
