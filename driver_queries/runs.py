"""Whole runs over landed payloads, with their output tables."""

from __future__ import annotations

import uuid
from datetime import datetime, timezone

from pyspark.sql import functions as F

from driver_queries import query
from driver_queries.deltas import KEYS
from driver_queries.inputs import PAGE, PAGES_PER_SCRAPE, event_pages, spec, table
from payload_metrics.plans.pipeline import run
from payload_metrics.sources.outputs import FingerprintLog
from payload_metrics.sources.tables import shared_folder

NOW = datetime(2024, 2, 1, tzinfo=timezone.utc)


def _order_pages(spark, sf_dir):
    """A payload per page of orders."""
    orders = table(spark, sf_dir, "orders")
    page = F.expr(f"o_orderkey div {PAGE}")
    pages = orders.groupBy(page.alias("page")).agg(F.collect_list(F.struct("o_orderkey", "o_orderpriority")).alias("records"))
    none = F.lit(None).cast("timestamp")
    return pages.select(
        F.lit("orders").alias("source"),
        F.lit("all").alias("scrape_id"),
        F.col("page").cast("int").alias("window_id"),
        none.alias("window_start"),
        none.alias("window_end"),
        F.lit(NOW).cast("timestamp").alias("fetched_at"),
        F.to_json(F.struct("records")).alias("payload"),
    )


@query(
    "SELECT 'events' AS source, count(DISTINCT (user_id, event_type)) AS logs, "
    "CAST(count(DISTINCT (user_id, event_type)) AS DOUBLE) AS counted, count(DISTINCT (user_id, event_type)) AS touched, "
    f"count(DISTINCT event_id // {PAGE * PAGES_PER_SCRAPE}) AS runs FROM events UNION ALL "
    "SELECT 'orders', count(*), CAST(count(*) AS DOUBLE), count(*), 1 FROM orders"
)
def shared_tables(spark, sf_dir):
    """Two sources in one folder and one fingerprint log, with the same run id."""
    folder = f"{shared_folder(spark)}/runs/{uuid.uuid4().hex}"
    log = FingerprintLog(spark, f"{folder}/fingerprints")
    order_keys = {"enabled": True, "fingerprintMode": "keys", "fingerprintKeys": ["o_orderkey"]}
    for payloads, config in [
        (event_pages(spark, sf_dir), spec(dataKey="data.records", deltaDetection=KEYS, counterReadings=[{"name": "c"}])),
        (
            _order_pages(spark, sf_dir),
            spec(name="orders", dataKey="records", deltaDetection=order_keys, counterReadings=[{"name": "c"}]),
        ),
    ]:
        result = run(config, payloads, log.touched(before_batch=1), NOW)
        result.write(folder, run_id="1")
        log.append(result.touches, 1, config.name)

    def per_source(name, value, alias):
        return spark.read.parquet(f"{folder}/{name}").groupBy("source").agg(value.alias(alias))

    touched = log.touched().groupBy("source").agg(F.count("*").alias("touched"))
    joined = per_source("log_records", F.count("*"), "logs").join(per_source("metric_points", F.sum("value"), "counted"), "source")
    joined = joined.join(touched, "source").join(per_source("scrape_runs", F.count("*"), "runs"), "source")
    return joined.select("source", "logs", "counted", "touched", "runs")


_PAGED = f"(SELECT event_id // {PAGE} AS page, count(*) AS n FROM events GROUP BY 1)"
_FAILED = f"page % {PAGES_PER_SCRAPE} % 7 = 3"


@query(
    f"SELECT 'events' AS source, lpad(CAST(page // {PAGES_PER_SCRAPE} AS VARCHAR), 15, '0') AS scrape_id, "
    f"CASE WHEN bool_or({_FAILED}) THEN 'error' ELSE 'success' END AS status, "
    f"CAST(coalesce(sum(n) FILTER (NOT ({_FAILED})), 0) AS BIGINT) AS records FROM {_PAGED} GROUP BY 2 UNION ALL "
    f"SELECT 'idle', 'run-{int(NOW.timestamp())}', 'success', 0"
)
def run_status_rows(spark, sf_dir):
    """Run rows of a source with failed windows, and of one without any payload."""
    broken = F.when(F.col("window_id") % 7 == 3, "no JSON").otherwise(F.col("payload"))
    payloads = event_pages(spark, sf_dir).withColumn("payload", broken)
    rows = [run(spec(name=name, dataKey="data.records"), payloads, None, NOW).scrape_runs for name in ("events", "idle")]
    return rows[0].unionByName(rows[1]).select("source", "scrape_id", "status", "records")
