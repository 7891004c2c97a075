"""Scrape windows, last success and run outcome, as table operations."""

from __future__ import annotations

from collections.abc import Iterable
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from payload_metrics.functions.durations import unit_seconds_col
from payload_metrics.functions.timetext import format_time
from payload_metrics.spec import SourceSpec

SPEC_SCHEMA = (
    "source string, api_type string, frequency_seconds bigint, slice_seconds bigint, "
    "first_scrape_start timestamp, run_first_scrape boolean, range_unit string, "
    "range_value string, take_negative boolean, has_bounds boolean"
)
FROM_CONFIG = "from-config"
MICROS = 1_000_000


def spec_table(spark: SparkSession, specs: Iterable[SourceSpec]) -> DataFrame:
    """One row per configured source, with what window planning needs."""
    rows = []
    for spec in specs:
        keys, parallel = spec.scrape.rangeKeys, spec.scrape.parallelWindow
        rows.append(
            (
                spec.name,
                spec.scrape.type,
                spec.frequency_seconds,
                parallel.seconds if parallel else None,
                spec.first_scrape_start(),
                spec.runFirstScrape,
                keys.unit if keys else None,
                str(keys.value) if keys and keys.value is not None else None,
                bool(keys and keys.takeNegative),
                bool(keys and keys.startKey and keys.endKey),
            )
        )
    return spark.createDataFrame(rows, SPEC_SCHEMA)


def last_success(runs: DataFrame) -> DataFrame:
    """Start of the newest run per source; a run counts even when windows of it failed."""
    return runs.groupBy("source").agg(F.max("started_at").alias("last_success"))


def plan_windows(sources: DataFrame, success: DataFrame, now: datetime | Column) -> DataFrame:
    """Windows to fetch: ``[last success, now)``, sliced where the source says so.

    Instant sources get one window without bounds. Sources that skip their first run get none.
    """
    at = _time(now)
    due = sources.join(success, "source", "left").where(
        F.col("last_success").isNotNull() | F.col("run_first_scrape")
    )
    back = F.timestamp_micros(F.unix_micros(at) - F.col("frequency_seconds") * MICROS)
    start = F.coalesce("last_success", "first_scrape_start", back)
    bounded = due.select(
        "source",
        "api_type",
        F.when(F.col("api_type") == "range", start).alias("range_start"),
        F.when(F.col("api_type") == "range", at).alias("range_end"),
        "slice_seconds",
    )
    return _cut(bounded)


def slice_range(ranges: DataFrame) -> DataFrame:
    """``(source, range_start, range_end, slice_seconds)`` cut into contiguous windows.

    The last window may be short; a range that is empty or reversed has none.
    """
    return _cut(ranges.where(F.col("slice_seconds") > 0))


def _cut(ranges: DataFrame) -> DataFrame:
    """One window per slice, or the range as it is where ``slice_seconds`` is NULL."""
    start, end = F.unix_micros("range_start"), F.unix_micros("range_end")
    step = F.col("slice_seconds") * MICROS
    count = F.when(step.isNull(), 1).otherwise(F.ceil((end - start) / step)).cast("bigint")
    numbered = ranges.withColumn("_count", count).where(F.col("_count") > 0)
    numbered = numbered.withColumn("_n", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_count") - 1)))
    begin = start + F.coalesce(F.col("_n") * step, F.lit(0))
    finish = F.when(step.isNull(), end).otherwise(F.least(begin + step, end))
    return numbered.select(
        "source",
        F.col("_n").cast("int").alias("window_id"),
        F.timestamp_micros(begin).alias("window_start"),
        F.timestamp_micros(finish).alias("window_end"),
    )


def window_texts(windows: DataFrame, spec: SourceSpec) -> DataFrame:
    """Window bounds as text in the source's own time format."""
    return windows.withColumns(
        {
            "start_text": format_time(F.col("window_start"), spec.time_format),
            "end_text": format_time(F.col("window_end"), spec.time_format),
        }
    )


def relative_values(sources: DataFrame) -> DataFrame:
    """How many units back a relative source asks for; explicit values pass through.

    A source that names both a start and an end key is asked for its bounds instead.
    """
    unbounded = ~F.coalesce("has_bounds", F.lit(False))
    relative = sources.where((F.col("api_type") == "range") & F.col("range_unit").isNotNull() & unbounded)
    derived = F.floor(F.col("frequency_seconds") / unit_seconds_col(F.col("range_unit")))
    derived = F.when(F.col("take_negative"), -derived).otherwise(derived)
    value = F.when(F.col("range_value") == FROM_CONFIG, derived.cast("string")).otherwise(F.col("range_value"))
    return relative.select("source", F.col("range_unit").alias("unit"), value.alias("value"))


def first_run_rows(sources: DataFrame, success: DataFrame, now: datetime | Column) -> DataFrame:
    """Run rows for sources that only record their state on the first run."""
    at = _time(now)
    fresh = sources.where(~F.col("run_first_scrape")).join(success, "source", "left_anti")
    zero = F.lit(0).cast("bigint")
    return fresh.select(
        "source", F.lit("first").alias("scrape_id"), "api_type", F.lit("success").alias("status"),
        at.alias("started_at"), at.alias("ended_at"), zero.alias("records"),
        zero.alias("hits"), zero.alias("misses"), zero.alias("total"),
    )


def run_outcome(attempts: DataFrame) -> DataFrame:
    """Status per scrape from ``errored`` per window: one failed window makes it an error."""
    failed = F.max(F.col("errored").cast("int")) == 1
    return attempts.groupBy("source", "scrape_id").agg(
        F.count("*").alias("windows"),
        F.count_if("errored").alias("failed_windows"),
        F.when(failed, "error").otherwise("success").alias("status"),
    )


def _time(now: datetime | Column) -> Column:
    return now if isinstance(now, Column) else F.lit(now).cast("timestamp")
