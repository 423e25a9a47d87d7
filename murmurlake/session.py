"""Session defaults and the shared working folder."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"


def local_session(app: str = "murmurlake", cores: str = "*", memory: str = "8g", shuffle: int = 8) -> SparkSession:
    """A local session with the settings every plan of this library expects (UTC, ANSI, AQE)."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` of the session, or a checkpoint folder set on it.

    Only where neither is set and the master is local (tests, notebooks) a local folder takes its place. On a
    cluster that is an error, as a folder of one machine would lose tables.
    """
    sc = spark.sparkContext
    path = spark.conf.get(CHECKPOINT_KEY, None) or sc.getCheckpointDir()
    if not path:
        if not sc.master.startswith("local"):
            raise RuntimeError(f"set {CHECKPOINT_KEY} to a folder that all executors share")
        path = os.path.join(tempfile.gettempdir(), f"murmurlake-{os.getpid()}")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(path)
    return path


_SCRATCH: list[str] = []


def scratch_table(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder for a table that a plan writes and reads again."""
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    _SCRATCH.append(path)
    return path


def materialise(df: DataFrame) -> DataFrame:
    """Write ``df`` once to a table in the shared folder and read it back.

    Runs a job when it is called, not when the result is used. This cuts lineage, survives lost executors,
    and, other than a checkpoint, keeps columns apart and lets the optimiser know the size, so small tables
    are broadcast only if they are small.
    """
    spark = df.sparkSession
    path = scratch_table(spark, "table")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Delete the tables written to the shared folder within the block when it is left; results that read
    them must be written or collected by then."""
    mark = len(_SCRATCH)
    try:
        yield
    finally:
        _drop(spark, mark)


def drop_scratch(spark: SparkSession) -> None:
    """Delete the tables that this process wrote to the shared folder; what reads them must be over."""
    _drop(spark, 0)


def _drop(spark: SparkSession, mark: int) -> None:
    jvm = spark.sparkContext._jvm
    while len(_SCRATCH) > mark:
        path = jvm.org.apache.hadoop.fs.Path(_SCRATCH.pop())
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def let_workers_import(spark: SparkSession) -> None:
    """Add this package's folder to the import path of the Python workers, wherever the driver was started."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        env["PYTHONPATH"] = os.pathsep.join([root, *paths])
