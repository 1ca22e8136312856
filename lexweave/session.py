"""Session helpers: lineage cuts that survive the loss of an executor."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder of the cluster. Where none is configured a local master (tests) has a temporary one, and any other
    is an error, since executors would not see each other's files."""
    conf = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if conf:
        return conf
    current = spark.sparkContext._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise RuntimeError("spark.checkpoint.dir is not set; name a folder that all executors share")
    path = os.path.join(tempfile.gettempdir(), "lexweave-checkpoints")
    spark.sparkContext.setCheckpointDir(path)
    return path


def stage_dir(spark: SparkSession) -> str:
    """This application's own folder within the shared one; it is deleted when the driver ends."""
    sc = spark.sparkContext
    path = f"{checkpoint_dir(spark).rstrip('/')}/lexweave-{sc.applicationId}"
    if not getattr(sc, "_lexweave_clears", False):
        sc._lexweave_clears = True
        atexit.register(_clear_at_exit, spark)
    return path


def clear_stages(spark: SparkSession) -> None:
    """Deletes what `stage` wrote in this application; DataFrames made from it can't be read any more."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(stage_dir(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def _clear_at_exit(spark: SparkSession) -> None:
    try:
        if spark.sparkContext._jsc is not None:
            clear_stages(spark)
    except Exception:  # noqa: BLE001 - the JVM may be gone; the folder's owner cleans up then
        pass


def stage(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write df as a table into the shared folder and read it back: its lineage ends there, its columns stay
    prunable, and every executor can read it again after a loss."""
    spark = df.sparkSession
    path = f"{stage_dir(spark)}/{name.replace(' ', '-')}-{uuid.uuid4().hex}.parquet"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per application; they need not have it on their path."""
    sc = spark.sparkContext
    if getattr(sc, "_lexweave_shipped", False):
        return
    root = Path(__file__).resolve().parent
    path = os.path.join(tempfile.mkdtemp(prefix="lexweave-"), "lexweave.zip")
    with zipfile.ZipFile(path, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    sc.addPyFile(path)
    sc._lexweave_shipped = True


def small_side(df: DataFrame, most_rows: int = 1_000_000) -> DataFrame:
    """Marked for broadcast only where it is counted to be small; otherwise left to a shuffled join."""
    from pyspark.sql import functions as F

    return F.broadcast(df) if df.limit(most_rows + 1).count() <= most_rows else df
