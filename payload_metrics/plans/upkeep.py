"""Clean-up of the fingerprint log: expired entries, orphans, capacity."""

from __future__ import annotations

from collections.abc import Iterable
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession

from payload_metrics.operators.dedupe import drop_orphans, expire, trim
from payload_metrics.sources.outputs import FingerprintLog
from payload_metrics.sources.tables import stage
from payload_metrics.spec import SourceSpec

CLEANUP_SCHEMA = "job string, backend string, started_at timestamp, ended_at timestamp, items bigint"


def clean_up(
    log: FingerprintLog, specs: Iterable[SourceSpec], now: datetime, path: str, batch_id: int
) -> tuple[FingerprintLog, DataFrame]:
    """A compacted log at ``path`` without expired, orphaned and surplus entries, and run rows.

    Batches after ``batch_id`` go to the new log. Each step is staged, since its row count and
    the next step both read it.
    """
    specs = list(specs)
    whole = stage(log.snapshot(), "snapshot")
    spark = whole.sparkSession
    active = spark.createDataFrame([(s.name,) for s in specs], "source string")
    capacity = spark.createDataFrame(
        [(s.name, s.deltaDetection.capacity()) for s in specs], "source string, max_entries bigint"
    )
    rows = []

    def step(job: str, before: DataFrame, after: DataFrame) -> DataFrame:
        began = datetime.now(timezone.utc)
        done = stage(after, job)
        items = before.count() - done.count()
        rows.append((job, "table", began, datetime.now(timezone.utc), items))
        return done

    fresh = step("fingerprint_cleanup", whole, expire(whole, int(now.timestamp())))
    owned = step("orphan_cleanup", fresh, drop_orphans(fresh, active))
    within = step("capacity_cleanup", owned, trim(owned, capacity))
    return log.compacted(within, path, batch_id), _run_rows(spark, rows)


def _run_rows(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    return spark.createDataFrame(rows, CLEANUP_SCHEMA)
