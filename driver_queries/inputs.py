"""The given tables as payloads and as typed records.

Payload packing groups on ``event_id``, which is unique, in pages of fixed size. So a payload
holds at most ``PAGE`` records however the data is skewed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from payload_metrics.operators.extract import typed_records
from payload_metrics.sources.tables import prepare_session
from payload_metrics.spec import SourceSpec

PAGE = 100
PAGES_PER_SCRAPE = 1000
TIME_TEXT = "yyyy-MM-dd HH:mm:ss.SSSSSS"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare_session(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with ``ts`` as TIMESTAMP and ``props`` as a struct."""
    raw = table(spark, sf_dir, "events")
    return raw.withColumn("ts", F.col("ts").cast("timestamp")).withColumn(
        "props", F.from_json("props", "k bigint")
    )


def event_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as one typed batch of records, in event order."""
    return typed_records(events(spark, sf_dir), "events", order_by="event_id", fetched_at=F.col("ts"))


def event_pages(spark: SparkSession, sf_dir: str, document: Column | None = None) -> DataFrame:
    """A payload per page of events. ``document`` builds it from the list ``records``."""
    doc = F.struct(F.lit("ok").alias("status"), F.struct("records").alias("data"))
    return _pages(events(spark, sf_dir), doc if document is None else document)


def event_chapters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A payload per page of events, its records in a list of sheets of ten."""
    page_rows = F.transform(
        F.sequence(F.lit(0), F.lit(PAGE // 10 - 1)),
        lambda i: F.struct(
            i.alias("sheet"),
            F.filter("records", lambda r: F.pmod(r["event_id"], F.lit(PAGE)).between(i * 10, i * 10 + 9)).alias("records"),
        ),
    )
    sheets = F.filter(page_rows, lambda s: F.size(s["records"]) > 0)
    return _pages(events(spark, sf_dir), F.struct(sheets.alias("sheets")))


def _pages(rows: DataFrame, document: Column) -> DataFrame:
    page = F.expr(f"event_id div {PAGE}")
    one = F.struct("event_id", F.date_format("ts", TIME_TEXT).alias("ts"), "user_id", "event_type", "value", "props")
    grouped = rows.groupBy(page.alias("page")).agg(
        F.sort_array(F.collect_list(one)).alias("records"), F.max("ts").alias("fetched_at")
    )
    none = F.lit(None).cast("timestamp")
    return grouped.select(
        F.lit("events").alias("source"),
        F.lpad(F.expr(f"page div {PAGES_PER_SCRAPE}").cast("string"), 15, "0").alias("scrape_id"),
        F.pmod("page", F.lit(PAGES_PER_SCRAPE)).cast("int").alias("window_id"),
        none.alias("window_start"),
        none.alias("window_end"),
        "fetched_at",
        F.to_json(document).alias("payload"),
    )


def spec(**parts) -> SourceSpec:
    """A spec for the events source."""
    base = {"name": "events", "frequency": "1h", "scrape": {"type": "instant"}}
    return SourceSpec.from_dict(base | parts)
