"""Payloads written as files to the shared folder, and read from there in batch and as a stream."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driver_queries import query
from driver_queries.inputs import PAGE, PAGES_PER_SCRAPE, event_pages, spec
from payload_metrics.operators.extract import extract
from payload_metrics.operators.fields import fields_of
from payload_metrics.sources.outputs import FingerprintLog
from payload_metrics.sources.payloads import read_payload_files, stream_payload_files
from payload_metrics.sources.tables import shared_folder
from payload_metrics.streaming import streams

WINDOW = r"/window=(\d+)/"
_BROKEN = f"event_id // {PAGE} % 7 = 3"


def _land(spark: SparkSession, sf_dir: str) -> str:
    """A file per page of events, some of which hold no JSON; returns their folder."""
    folder = f"{shared_folder(spark)}/landed/{uuid.uuid4().hex}"
    page = (F.col("scrape_id").cast("int") * PAGES_PER_SCRAPE + F.col("window_id")).alias("window")
    pages = event_pages(spark, sf_dir).select(page, "payload")
    text = F.when(F.col("window") % 7 == 3, F.substring("payload", 1, 300)).otherwise(F.col("payload"))
    # A file costs a task the same whatever its size, so partitions are not merged by size. Every
    # task moves its files into place; the driver would move all of them one by one.
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    landing = pages.withColumn("payload", text).repartition(tasks, "window").write.partitionBy("window")
    landing.option("mapreduce.fileoutputcommitter.algorithm.version", "2").text(folder)
    return folder


def _event_ids(records: DataFrame) -> DataFrame:
    number = fields_of(records).number("event_id").cast("bigint").alias("event_id")
    return records.select(number, F.col("window_id").cast("bigint").alias("window_id"))


@query(f"SELECT event_id, event_id // {PAGE} AS window_id FROM events WHERE NOT ({_BROKEN})")
def landed_files(spark, sf_dir):
    """Batch scan of landed files."""
    payloads = read_payload_files(spark, _land(spark, sf_dir), "events", "landed", WINDOW)
    records, _ = extract(payloads, spec(dataKey="data.records"))
    return _event_ids(records)


@query(f"SELECT DISTINCT 'landed' AS scrape_id, event_id // {PAGE} AS window_id, 300 AS snippet FROM events WHERE {_BROKEN}")
def landed_rejects(spark, sf_dir):
    """The files without JSON, with the beginning of what they hold."""
    payloads = read_payload_files(spark, _land(spark, sf_dir), "events", "landed", WINDOW)
    _, rejects = extract(payloads, spec(dataKey="data.records"))
    kept = F.when(F.col("snippet").startswith('{"status":"ok"'), 300).alias("snippet")
    return rejects.select("scrape_id", F.col("window_id").cast("bigint").alias("window_id"), kept)


@query(
    f"SELECT 'record' AS kind, event_id AS id FROM events WHERE NOT ({_BROKEN}) UNION ALL "
    f"SELECT DISTINCT 'reject', event_id // {PAGE} FROM events WHERE {_BROKEN} UNION ALL SELECT 'run', 1"
)
def landed_stream(spark, sf_dir):
    """A whole source over a stream of landed files: records, rejects and failed runs."""
    landed, out = _land(spark, sf_dir), f"{shared_folder(spark)}/streams/{uuid.uuid4().hex}"
    payloads = stream_payload_files(spark, landed, "events", "landed", WINDOW)
    log = FingerprintLog(spark, f"{out}/fingerprints")
    config = spec(dataKey="data.records")
    streams.start(config, payloads, log, out, f"{out}/checkpoint", availableNow=True).awaitTermination()
    event_id = F.get_json_object("body", "$.record.event_id").cast("bigint").alias("id")
    records = spark.read.parquet(f"{out}/log_records").select(F.lit("record").alias("kind"), event_id)
    rejects = spark.read.parquet(f"{out}/rejects").select(F.lit("reject").alias("kind"), F.col("window_id").cast("bigint").alias("id"))
    failed = spark.read.parquet(f"{out}/scrape_runs").where("status = 'error'")
    runs = failed.select("scrape_id").distinct().select(F.lit("run").alias("kind"), F.lit(1).cast("bigint").alias("id"))
    return records.unionByName(rejects).unionByName(runs)
