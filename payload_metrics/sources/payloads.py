"""Payload scans: landed response files, payload tables, and both as streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PAYLOAD_SCHEMA = (
    "source string, scrape_id string, window_id int, window_start timestamp, "
    "window_end timestamp, fetched_at timestamp, payload string"
)
#: The number of a window in the path of its file.
WINDOW_IN_NAME = r"(\d+)\.json$"
#: Bytes of files that a micro-batch takes.
BATCH_BYTES = 1 << 28


def read_payload_files(
    spark: SparkSession, path: str, source: str, scrape_id: str | None = None, window_pattern: str = WINDOW_IN_NAME
) -> DataFrame:
    """Response files below ``path``, one whole JSON document per file.

    The first group of ``window_pattern`` in a file's path is its window. A file without a number
    is a scrape of its own, named by the file, so that files of one time are ordered by name. The
    others belong to ``scrape_id``, or if none is given to the scrape their folder is named by.
    ``fetched_at`` is the time of the file. Spark passes over files without a single byte; a blank
    one is a payload, and rejected by extraction.
    """
    reader = spark.read.format("text").option("wholetext", True).option("recursiveFileLookup", True)
    return _payloads(reader.load(path), source, scrape_id, window_pattern)


def stream_payload_files(
    spark: SparkSession,
    path: str,
    source: str,
    scrape_id: str | None = None,
    window_pattern: str = WINDOW_IN_NAME,
    max_files: int | None = None,
) -> DataFrame:
    """The same files as a stream over the folder they land in.

    A micro-batch takes ``BATCH_BYTES`` of files, or ``max_files`` if given. Its jobs cost the same
    for few files as for many, so batches of a number of small files would be mostly overhead.
    """
    reader = spark.readStream.format("text").schema("value string").option("wholetext", True)
    reader = reader.option("recursiveFileLookup", True)
    if max_files is None:
        reader = reader.option("maxBytesPerTrigger", BATCH_BYTES)
    else:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return _payloads(reader.load(path), source, scrape_id, window_pattern)


def _payloads(files: DataFrame, source: str, scrape_id: str | None, window_pattern: str) -> DataFrame:
    path = F.col("_metadata.file_path")
    number = F.regexp_extract(path, window_pattern, 1).try_cast("int")
    scrape = F.element_at(F.split(path, "/"), -2) if scrape_id is None else F.lit(scrape_id)
    own = F.concat_ws("/", scrape, F.col("_metadata.file_name"))
    none = F.lit(None).cast("timestamp")
    return files.select(
        F.lit(source).alias("source"),
        F.when(number.isNull(), own).otherwise(scrape).alias("scrape_id"),
        F.coalesce(number, F.lit(0)).alias("window_id"),
        none.alias("window_start"),
        none.alias("window_end"),
        F.col("_metadata.file_modification_time").alias("fetched_at"),
        F.col("value").alias("payload"),
    )


def read_payload_table(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """A payload table with the columns of ``PAYLOAD_SCHEMA``."""
    return spark.read.schema(PAYLOAD_SCHEMA).format(fmt).load(path)


def stream_payload_table(
    spark: SparkSession, path: str, fmt: str = "parquet", max_files: int = 1000
) -> DataFrame:
    """The same table as a stream over its landing folder."""
    reader = spark.readStream.schema(PAYLOAD_SCHEMA).option("maxFilesPerTrigger", max_files)
    return reader.format(fmt).load(path)
