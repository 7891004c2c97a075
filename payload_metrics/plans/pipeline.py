"""One scrape run: payloads in, metric points, log rows, touches and run rows out."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from payload_metrics.operators.dedupe import dedupe, fingerprint, numbered, touches
from payload_metrics.operators.extract import REJECT_COLUMNS, extract_selected, selected_records, slim_records
from payload_metrics.operators.logs import log_records
from payload_metrics.operators.metrics import metric_points
from payload_metrics.sources.outputs import write_part
from payload_metrics.sources.tables import stage
from payload_metrics.spec import SourceSpec


@dataclass(frozen=True)
class RunResult:
    """Frames of a run; all read staged tables, so each can be used on its own."""

    source: str
    kept: DataFrame
    rejects: DataFrame
    metric_points: DataFrame
    log_records: DataFrame
    touches: DataFrame | None
    scrape_runs: DataFrame

    def write(self, path: str, run_id: str) -> None:
        """Writes the output tables; a run that is written again replaces itself."""
        for name in ("metric_points", "log_records", "rejects", "scrape_runs"):
            write_part(getattr(self, name), f"{path}/{name}", f"run_id={run_id}", self.source)


def run(spec: SourceSpec, payloads: DataFrame, store: DataFrame | None, now: datetime) -> RunResult:
    """Extract, filter, cap, dedupe and map the payloads of one source at time ``now``.

    Payloads are parsed once: the selected records are staged, and so are the kept ones, since
    both feed several outputs. Emit ``touches`` to the store only after the outputs are written.
    """
    # A payload without a time has that of the run, in metrics, logs and run rows alike.
    mine = payloads.where(F.col("source") == spec.name)
    mine = mine.withColumn("fetched_at", F.coalesce("fetched_at", F.lit(now).cast("timestamp")))
    rows = numbered(prepare_rows(mine, spec))
    records = selected_records(rows)
    rejects = rows.where(F.col("reason").isNotNull()).select(*REJECT_COLUMNS)
    seconds = int(now.timestamp())
    kept = dedupe(records, store, spec, seconds)
    if spec.deltaDetection.enabled:
        kept = stage(kept, "kept")
    return RunResult(
        source=spec.name,
        kept=kept,
        rejects=rejects,
        metric_points=metric_points(kept, spec),
        log_records=log_records(kept, spec, F.lit(now).cast("timestamp")),
        touches=touches(kept, spec, seconds) if spec.deltaDetection.enabled else None,
        scrape_runs=run_rows(spec, rows, kept, now, always=True),
    )


def prepare_rows(payloads: DataFrame, spec: SourceSpec) -> DataFrame:
    """Selected records and reject rows, fingerprinted, with no more fields than needed."""
    rows = extract_selected(payloads, spec)
    if spec.deltaDetection.enabled:
        rows = fingerprint(rows, spec)
    return rows if spec.emitLogs else slim_records(rows, spec)


def dry_run(spec: SourceSpec, payloads: DataFrame, store: DataFrame | None, now: datetime) -> DataFrame:
    """Record counts per source of what a run would emit; writes no output."""
    rows = prepare_rows(payloads.where(F.col("source") == spec.name), spec)
    kept = dedupe(selected_records(rows), store, spec, int(now.timestamp()))
    return kept.groupBy("source").agg(F.count("*").alias("records"))


def run_rows(spec: SourceSpec, rows: DataFrame, kept: DataFrame, now: datetime, always: bool = False) -> DataFrame:
    """One row per scrape, from the staged rows of every payload and the kept records.

    With ``always``, a source without any payload has one successful run of its own, named by
    its time, so that the next range starts where this one ended.
    """
    scrape = ["source", "scrape_id"]
    failed = F.count_if(F.col("reason").isNotNull()) if "reason" in rows.columns else F.lit(0)
    seen = rows.groupBy(*scrape).agg(
        F.max("fetched_at").alias("ended_at"),
        failed.alias("_failed"),
        F.count_if(F.col("record_idx").isNotNull() if "record_idx" in rows.columns else F.lit(True)).alias("_total"),
    )
    if always:
        name = f"run-{int(now.timestamp())}"
        empty = rows.sparkSession.createDataFrame([(spec.name, name, 0, 0)], "source string, scrape_id string, _failed long, _total long")
        empty = empty.join(seen, "source", "left_anti").withColumn("ended_at", F.lit(None).cast("timestamp"))
        seen = seen.unionByName(empty)
    emitted = kept.groupBy(*scrape).agg(F.count("*").alias("_emitted"))
    misses = F.coalesce("_emitted", F.lit(0).cast("bigint"))
    started = F.lit(now).cast("timestamp")
    return seen.join(emitted, scrape, "left").select(
        *scrape,
        F.lit(spec.scrape.type).alias("api_type"),
        F.when(F.col("_failed") > 0, "error").otherwise("success").alias("status"),
        started.alias("started_at"),
        F.greatest("ended_at", started).alias("ended_at"),
        misses.alias("records"),
        (F.col("_total") - misses).alias("hits"),
        misses.alias("misses"),
        F.col("_total").alias("total"),
    )
