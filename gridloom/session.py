"""Session helpers: a local test session and the folder that driver and executors share."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_DIR = "spark.checkpoint.dir"


def local_session(cores: int | str = "*", partitions: int = 8, **conf: str) -> SparkSession:
    """A single-machine session for tests and the benchmark; a cluster supplies its own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("gridloom")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.driver.memory", os.environ.get("GRIDLOOM_DRIVER_MEMORY", "8g"))
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; where that is unset, one of our own on a single machine only, as the
    executors of a cluster share no local folder."""
    path = spark.conf.get(CHECKPOINT_DIR, None)
    if not path:
        master = spark.sparkContext.master
        if master.split("[")[0] != "local":
            raise RuntimeError(f"set {CHECKPOINT_DIR} to a folder that all executors of {master} share")
        path = "file://" + tempfile.mkdtemp(prefix="gridloom-shared-")
        spark.conf.set(CHECKPOINT_DIR, path)
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh sub-folder of the shared folder (not created yet)."""
    return f"{shared_dir(spark)}/gridloom/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str = "table") -> DataFrame:
    """Write ``df`` to the shared folder as Parquet and read it back.

    This cuts the lineage like a checkpoint, but the result is a table: later scans prune columns and push filters
    down, and a lost executor costs nothing because no block lives on it. ``discard`` takes it away again.
    """
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table.gridloom_folder = path
    return table


def discard(table: DataFrame) -> None:
    """Delete the folder of a materialised table that nothing will read any more."""
    path = getattr(table, "gridloom_folder", None)
    if path:
        context = table.sparkSession.sparkContext
        folder = context._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(context._jsc.hadoopConfiguration()).delete(folder, True)
