"""Session helpers and the shared scratch folder."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def session(cores: int | str = "*", partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session with the settings the operators are written for."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("lodeworks")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from ``spark.checkpoint.dir``.

    A temporary folder is set only where the session names none and runs in one
    process (tests, local mode); on a cluster the setting must be there.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    known = spark.sparkContext.getCheckpointDir()
    if known:
        return known.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    made = tempfile.mkdtemp(prefix="lodeworks-")
    spark.sparkContext.setCheckpointDir(made)
    atexit.register(_remove, spark, made)
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # the session may be gone by then
        pass


def ship(spark: SparkSession) -> None:
    """Make this package importable in the Python workers, once per session."""
    context = spark.sparkContext
    here = Path(__file__).resolve().parent
    if context.master.startswith("local") and str(here.parent) in os.environ.get("PYTHONPATH", "").split(":"):
        return
    if getattr(context, "_lodeworks", False):
        return
    folder = tempfile.mkdtemp(prefix="lodeworks-code-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    context.addPyFile(shutil.make_archive(f"{folder}/lodeworks", "zip", here.parent, here.name))
    context._lodeworks = True


class Stage:
    """Intermediate tables, written once to the shared folder and read many times.

    A written table cuts the lineage and outlives lost executors. ``drop`` removes
    what was written; what is left is removed when the process ends.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
        atexit.register(_remove, spark, self.path)

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` under ``name`` and return it as read back."""
        at = f"{self.path}/{name}"
        df.write.mode("overwrite").parquet(at)
        return self.spark.read.schema(df.schema).parquet(at)

    def drop(self, name: str | None = None) -> None:
        _remove(self.spark, f"{self.path}/{name}" if name else self.path)


#: Bytes of a single file from which its rows are spread over all cores before work on them.
SPREAD = 1_000_000


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A test table, read as Parquet so that filters and columns reach the scan.

    A table that is one small file of one row group would keep a single core busy; its
    rows are spread. Tables of several splits, as any large one, are read as they are.
    """
    ship(spark)
    path = f"{folder}/{name}.parquet"
    df = spark.read.parquet(path)
    here = Path(path)
    if here.is_file() and here.stat().st_size >= SPREAD and df.rdd.getNumPartitions() == 1:
        return df.repartition(spark.sparkContext.defaultParallelism)
    return df
