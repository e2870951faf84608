"""Session helpers shared by every operator: tables, lineage cuts, parallelism."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def ship(spark: SparkSession) -> SparkSession:
    """Makes this package importable in the Python workers where PYTHONPATH doesn't already do so.

    The archive is read by the driver alone; executors fetch it through Spark.
    """
    sc, home = spark.sparkContext, Path(__file__).resolve().parent.parent
    if not getattr(sc, "_quadloom_shipped", False):
        if str(home) not in os.environ.get("PYTHONPATH", "").split(os.pathsep):
            made = tempfile.mkdtemp(prefix="quadloom-")
            atexit.register(shutil.rmtree, made, True)
            sc.addPyFile(shutil.make_archive(f"{made}/quadloom", "zip", home, "quadloom"))
        sc._quadloom_shipped = True
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as the cluster names it in spark.checkpoint.dir.

    Where the setting is missing (tests on one machine) a temporary folder is made and removed at exit.
    """
    sc = spark.sparkContext
    where = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not where:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        where = tempfile.mkdtemp(prefix="quadloom-")
        atexit.register(shutil.rmtree, where, True)
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(where)
    return where


_OPEN: set[Spool] = set()


class Spool:
    """Intermediate tables written as parquet to the shared folder; columnar, so re-reads prune columns."""

    def __init__(self, spark: SparkSession) -> None:
        ship(spark)
        self.spark, self.root = spark, f"{shared_dir(spark).rstrip('/')}/quadloom-{uuid.uuid4().hex}"
        self.n = 0
        _OPEN.add(self)
        atexit.register(_delete, spark, self.root)

    def write(self, df: DataFrame) -> DataFrame:
        self.n += 1
        path = f"{self.root}/{self.n}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def forget(self, df: DataFrame) -> None:
        """Deletes a table of this spool that no later plan reads; tables from elsewhere are left alone."""
        for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            if "/".join(self.root.rsplit("/", 1)[1:]) in path:
                _delete(self.spark, path)

    def drop(self) -> None:
        _delete(self.spark, self.root)
        _OPEN.discard(self)


def release() -> None:
    """Deletes what all queries so far have spooled. Results that were not consumed can't be read any more."""
    for spool in list(_OPEN):
        spool.drop()


def _delete(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session is gone; the cluster owner clears the folder
        pass


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def task_slots(spark: SparkSession) -> int:
    """Reduce-side tasks to plan for: the session's shuffle partitions, at least the default parallelism."""
    return max(shuffle_partitions(spark), spark.sparkContext.defaultParallelism)
