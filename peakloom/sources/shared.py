"""Tables in the folder that a cluster's driver and executors share."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: Setting that deletes the shuffle files of a query when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Used only where spark.checkpoint.dir is unset and one process does all work (tests, a laptop).
LOCAL_SHARED = "/tmp/checkpoints/peakloom"
_roots: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The shared folder, from spark.checkpoint.dir; several machines must name one."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    master = spark.sparkContext.master
    if not folder and master != "local" and not master.startswith("local["):
        raise ValueError("spark.checkpoint.dir is unset: name a folder that the driver and all executors share")
    return (folder or LOCAL_SHARED).rstrip("/")


def clear_scratch() -> None:
    """Delete the tables of every Scratch of this process; results that read them end with it."""
    while _roots:
        spark, root = _roots.pop()
        try:
            _delete(spark, root)
        except Exception:  # noqa: BLE001  the session, and with it the way to the store, may be gone
            if not root.startswith(LOCAL_SHARED):
                continue
            shutil.rmtree(root, ignore_errors=True)


def _delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


atexit.register(clear_scratch)


class Scratch:
    """Tables written to the shared folder: they cut lineage and outlive a lost executor.

    What is not dropped before is deleted when the driver's process ends, or by clear_scratch.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
        self.count = 0
        _roots.append((spark, self.root))

    def save(self, df: DataFrame) -> DataFrame:
        """Write ``df`` once and return a frame that reads the files.

        Shuffle files of the write go at its end: nothing reads them once the table is there.
        """
        self.count += 1
        path = f"{self.root}/{self.count}"
        before = self.spark.conf.get(CLEANUP, None)
        self.spark.conf.set(CLEANUP, "true")
        try:
            df.write.parquet(path)
        finally:
            self.spark.conf.unset(CLEANUP) if before is None else self.spark.conf.set(CLEANUP, before)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def drop(self, *frames: DataFrame) -> None:
        """Delete saved tables that no later step reads."""
        for df in frames:
            if path := getattr(df, "_scratch_path", None):
                _delete(self.spark, path)


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors, which need not share the driver's folders.

    A local master runs its tasks beside the driver and needs no copy, if the package is on the
    path it hands on. The archive is written by the driver for itself and travels through
    Spark's file server.
    """
    root = Path(__file__).resolve().parents[2]
    known = [*os.environ.get("PYTHONPATH", "").split(os.pathsep), os.getcwd()]
    context = spark.sparkContext
    beside = context.master == "local" or context.master.startswith("local[")
    if (beside and any(p and Path(p).resolve() == root for p in known)) or context.applicationId in _shipped:
        return
    folder = tempfile.mkdtemp(prefix="peakloom-")  # served from here while the driver lives
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    archive = Path(folder) / "peakloom.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for p in sorted((root / "peakloom").rglob("*.py")):
            z.write(p, p.relative_to(root))
    context.addPyFile(str(archive))
    _shipped.add(context.applicationId)


_shipped: set[str] = set()
