"""Session settings and staged tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_DIR = "spark.checkpoint.dir"
LISTING_TASKS = 128


def prepare_session(spark: SparkSession) -> SparkSession:
    """Settings the rules rely on: UTC times, and the last of repeated JSON keys wins. Files are
    listed by a bounded number of tasks, not by one for each file."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.variant.allowDuplicateKeys", "true")
    spark.conf.set("spark.sql.sources.parallelPartitionDiscovery.parallelism", LISTING_TASKS)
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared folder; a temporary one only for a local session without any."""
    folder = spark.conf.get(CHECKPOINT_DIR, None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError(f"set {CHECKPOINT_DIR} to a folder all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="payload-metrics-"))
    return spark.sparkContext.getCheckpointDir()


def staged_path(spark: SparkSession, name: str) -> str:
    """A new folder for a staged table."""
    return f"{shared_folder(spark)}/staged/{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """Writes ``df`` once for several readers. It survives lost executors and prunes columns."""
    spark = df.sparkSession
    path = path or staged_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def folder_names(spark: SparkSession, path: str) -> list[str]:
    """Names of what lies in a folder; none if there is no such folder."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not files.exists(hadoop):
        return []
    return [entry.getPath().getName() for entry in files.listStatus(hadoop)]


def mark(spark: SparkSession, path: str) -> None:
    """Creates an empty file."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(hadoop, True).close()


def discard(spark: SparkSession, path: str) -> None:
    """Removes a staged table that no DataFrame will read again."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)
