"""Session helpers: shared scratch tables and worker import paths."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def local_session(cores: int | str = 8, partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A single-node session with the settings that the tests and the bench use."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("lexmill")
        .config("spark.sql.shuffle.partitions", partitions)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", memory)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def expose_package(spark: SparkSession) -> None:
    """Lets Python workers import this package where it is not installed."""
    known = spark.sparkContext.environment.get("PYTHONPATH", "")
    if ROOT not in known.split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(x for x in (ROOT, known) if x)


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Arrow batches of fewer rows, for operators on long texts: a batch stands in memory on both sides, in each running task."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)


def scratch_dir(spark: SparkSession) -> str:
    """The folder shared by driver and executors: spark.checkpoint.dir, or a new local one where that is unset."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="lexmill-")
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/lexmill-{spark.sparkContext.applicationId}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Writes df as Parquet to the shared scratch folder and reads it back, which cuts the lineage.

    The rows survive lost executors. Folders go when the application ends, or by release().
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(jpath)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Deletes every table that this application has materialised."""
    jpath = spark._jvm.org.apache.hadoop.fs.Path(scratch_dir(spark))
    jpath.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jpath, True)
