"""Session helpers: settings the jobs rely on and the shared work folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Set only where the cluster has not chosen a value itself.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
}


def local_session(cores: str = "*", shuffle_partitions: int = 8, app: str = "clickloom") -> SparkSession:
    """A single-machine session for tests and benchmarks."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        # MLlib reads its training rows back in many short jobs
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in DEFAULTS.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def work_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder below the shared ``spark.checkpoint.dir`` of the session.

    A local master may fall back to a temporary folder; on a cluster the setting is required,
    because executors must all see the folder and it must outlive any of them.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that every executor can reach")
        base = tempfile.mkdtemp(prefix="clickloom-")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write a derived table to the shared folder and read it back.

    For tables that many jobs read: the lineage ends there, and losing an executor loses nothing. The table is
    deleted when the driver ends, as lazy results may read it until then.
    """
    spark = df.sparkSession
    path = work_dir(spark, name)
    df.write.parquet(path)
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(folder)
    return spark.read.parquet(path)


def set_checkpoint_dir(spark: SparkSession) -> None:
    """Give MLlib's iterative trainers a reliable checkpoint folder if none is set."""
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(work_dir(spark, "checkpoint"))
