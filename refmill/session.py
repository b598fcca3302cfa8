"""Session helpers shared by every operator."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One Parquet table of the input folder; only the columns used later are read."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The folder for checkpoint(): the cluster's shared one if it names one, else (tests, one machine) a temporary one."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    shared = sc.getConf().get(CHECKPOINT_KEY) or spark.conf.get(CHECKPOINT_KEY, None)
    if not shared:
        if not sc.master.startswith("local["):
            raise ValueError(f"{CHECKPOINT_KEY} must name a shared folder on a cluster")
        shared = "file://" + tempfile.mkdtemp(prefix="refmill-checkpoint-")
    sc.setCheckpointDir(shared)
    return shared


def _shared_file_system(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def cut(df: DataFrame) -> DataFrame:
    """df written as a table in the shared folder and read again: its lineage ends there, so lost executors cost only a read.

    Parquet keeps the table small and lets later steps read only the columns they need. The folder goes when the
    process ends.
    """
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/refmill-{uuid.uuid4().hex}"
    df.write.parquet(path)
    where, fs = _shared_file_system(spark, path)
    fs.deleteOnExit(where)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def dropping_shuffles(spark: SparkSession) -> Iterator[None]:
    """Within, a job's shuffle files go as soon as its result is written: else they stay until the driver collects its garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def local_session(cores: int | None = None, app: str = "refmill", **conf: str) -> SparkSession:
    """A session for tests and benches on one machine."""
    n = cores or os.cpu_count() or 4
    builder = (
        SparkSession.builder.master(f"local[{n}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(n))
        .config("spark.driver.memory", conf.pop("driver_memory", "8g"))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
