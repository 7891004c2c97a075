"""Streams over landed payloads: extraction, TTL dedupe, windowed metrics and sinks."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from datetime import datetime, timezone

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from payload_metrics.operators.dedupe import RECORD_ORDER, fingerprint, numbered, replay, touches
from payload_metrics.operators.extract import REJECT_COLUMNS, extract_selected, selected_records
from payload_metrics.operators.logs import log_records
from payload_metrics.operators.metrics import metric_points
from payload_metrics.plans.pipeline import prepare_rows, run_rows
from payload_metrics.sources.outputs import FingerprintLog, PointLog, source_folder, write_part
from payload_metrics.sources.tables import discard, folder_names, stage, staged_path
from payload_metrics.spec import SourceSpec

#: Batches after which a log is folded into a snapshot.
COMPACT_EVERY = 50
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def stream_records(payloads: DataFrame, spec: SourceSpec) -> DataFrame:
    """Records of a payload stream after filters and cap. Stateless."""
    mine = payloads.where(F.col("source") == spec.name)
    return selected_records(extract_selected(mine, spec))


def coarse_dedupe(records: DataFrame, spec: SourceSpec) -> DataFrame:
    """Built-in TTL dedupe. State expires between micro-batches only, so a batch that spans more
    than the TTL emits one row per fingerprint; use it when batches are much shorter. Rows later
    than the TTL are dropped by the watermark; ``exact_dedupe`` and ``table_sink`` keep them."""
    ttl = f"{spec.deltaDetection.ttl()} seconds"
    return fingerprint(records, spec).withWatermark("fetched_at", ttl).dropDuplicatesWithinWatermark(["hash"])


def exact_dedupe(records: DataFrame, spec: SourceSpec, late: str | None = None) -> DataFrame:
    """TTL dedupe with the last emission of every fingerprint as state, for typed records.

    Needs the RocksDB state store. Repeats within a second are combined before the shuffle, so
    a frequent fingerprint does not send all its rows to one task. Rows later than ``late`` (the TTL
    if not given) are dropped. A state goes once the watermark has passed the TTL of its emission,
    since whatever comes then is emitted anyway. Rows without a time come before all others.

    Every column of a row passes through Python and back. Records that were fingerprinted before
    keep their ``hash`` and may be cut to the fields that are used behind it.
    """
    ttl = spec.deltaDetection.ttl()
    seconds = F.coalesce(F.unix_seconds("fetched_at"), F.lit(0).cast("bigint"))
    hashed = records if "hash" in records.columns else fingerprint(records, spec)
    hashed = hashed.withColumn("seen_at", seconds)
    combined = hashed.mapInArrow(_first_per_second, hashed.schema)
    # A watermark set before the Arrow step would not drop late rows behind it.
    kept = combined.withWatermark("fetched_at", late or f"{ttl} seconds").groupBy("hash").transformWithState(
        statefulProcessor=_LastEmission(ttl),
        outputStructType=hashed.schema,
        outputMode="Append",
        timeMode="EventTime",
    )
    return kept.drop("seen_at")


def _first_per_second(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Keeps, of every Arrow batch, the first row per fingerprint and second."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        keys = batch.select(["hash", "seen_at", *RECORD_ORDER])
        ascending = [(name, "ascending") for name in keys.schema.names]
        order = pc.sort_indices(keys, sort_keys=ascending, null_placement="at_start")
        hashes = keys["hash"].take(order).to_numpy(zero_copy_only=False)
        seconds = keys["seen_at"].take(order).to_numpy(zero_copy_only=False)
        fresh = np.ones(len(order), dtype=bool)
        fresh[1:] = (hashes[1:] != hashes[:-1]) | (seconds[1:] != seconds[:-1])
        yield batch.take(order.filter(pa.array(fresh)))


def _in_order(row: Row) -> list[tuple]:
    """By ``RECORD_ORDER``, nulls first."""
    return [(row[name] is not None, row[name]) for name in RECORD_ORDER]


class _LastEmission(StatefulProcessor):
    """Keeps the second of a fingerprint's last emission until the watermark makes it useless.

    It takes plain rows: most fingerprints have few in a batch, and a frame for each would cost
    far more than its rows.
    """

    def __init__(self, ttl: int):
        self._ttl = ttl

    def init(self, handle: StatefulProcessorHandle) -> None:
        schema = T.StructType([T.StructField("at", T.LongType())])
        self._handle, self._last = handle, handle.getValueState("last_emission", schema)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        # Only the first row of a second can be emitted, so the rows held are bounded by the
        # seconds a micro-batch spans, not by its repeats.
        first = {}
        for row in rows:
            held = first.get(row["seen_at"])
            if held is None or _in_order(row) < _in_order(held):
                first[row["seen_at"]] = row
        state = self._last.get()
        last, emitted = None if state is None else state[0], []
        for at in sorted(first):
            if last is None or at > last + self._ttl:
                emitted.append(first[at])
                last = at
        if emitted:
            self._last.update((last,))
            self._handle.registerTimer(self._useless_from(last))
        return iter(emitted)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        state = self._last.get()
        # A later emission has a timer of its own.
        if state is not None and self._useless_from(state[0]) <= expiredTimerInfo.getExpiryTimeInMs():
            self._last.clear()
        return iter(())

    def _useless_from(self, last: int) -> int:
        return (last + self._ttl + 1) * 1000

    def close(self) -> None:
        pass


def windowed_metrics(records: DataFrame, spec: SourceSpec, every: str, late: str) -> DataFrame:
    """Metric points per tumbling event-time window. Rows later than ``late`` are dropped.

    In append mode a window comes when the watermark has passed it; in update mode, as
    ``start_windows`` runs it, with every batch that changes it.
    """
    return metric_points(records.withWatermark("fetched_at", late), spec, every=every)


def window_sink(spec: SourceSpec, log: PointLog, compact_every: int = COMPACT_EVERY) -> Callable[[DataFrame, int], None]:
    """``foreachBatch`` function for windowed metrics in update mode: the state of every window a
    batch changed goes to a folder of the batch, so a batch that is run again changes nothing."""

    def process(points: DataFrame, batch_id: int) -> None:
        log.append(points, batch_id, spec.name)
        if batch_id and batch_id % compact_every == 0:
            log.compact(spec.name, batch_id)

    return process


def start_windows(
    spec: SourceSpec,
    records: DataFrame,
    every: str,
    late: str,
    log: PointLog,
    checkpoint: str,
    compact_every: int = COMPACT_EVERY,
    **trigger,
) -> StreamingQuery:
    """Keeps ``log.points()`` at the state of all windows, those still open included."""
    _refuse_second_start(records, checkpoint, spec.name, log.parts(spec.name)["batch_id"])
    points = windowed_metrics(records, spec, every, late)
    writer = points.writeStream.outputMode("update").foreachBatch(window_sink(spec, log, compact_every))
    return writer.option("checkpointLocation", checkpoint).trigger(**trigger).start()


def table_sink(
    spec: SourceSpec, log: FingerprintLog, out: str, compact_every: int = COMPACT_EVERY, late: int | None = None
) -> Callable[[DataFrame, int], None]:
    """``foreachBatch`` function: exact TTL dedupe against the log, then metric and log tables.

    Takes record rows, with or without the reject rows of ``extract_selected``. Every output
    lies in a folder named by the batch and the source, and the probe reads earlier batches only,
    so a batch that is run again gives the same tables. What a batch has staged goes with it.

    Every ``compact_every`` batches the log of the source is folded into a snapshot, so its folders
    stay few. Fingerprints that expired more than ``late`` seconds (the TTL if not given) before the
    newest one then go; a row that comes later than that after its fingerprint is emitted again.
    """
    ttl, source = spec.deltaDetection.ttl(), spec.name

    def process(batch: DataFrame, batch_id: int) -> None:
        part, spark = f"batch_id={batch_id}", batch.sparkSession
        now = datetime.now(timezone.utc)
        folder = staged_path(spark, f"batch-{batch_id}")
        timed = batch.withColumn("fetched_at", F.coalesce("fetched_at", F.lit(now).cast("timestamp")))
        if spec.deltaDetection.enabled and "hash" not in timed.columns:
            timed = fingerprint(timed, spec)
        rows = numbered(timed, f"{folder}/rows")
        envelopes = rows
        if "reason" in rows.columns:
            rejects = rows.where(F.col("reason").isNotNull())
            write_part(rejects.select(*REJECT_COLUMNS), f"{out}/rejects", part, source)
            rows = selected_records(rows)
        kept = rows
        if spec.deltaDetection.enabled:
            if batch_id and batch_id % compact_every == 0:
                log.compact(source, batch_id, ttl if late is None else late)
            oldest = rows.agg(F.unix_seconds(F.min("fetched_at"))).first()[0] or 0
            # What has expired under its own TTL before the oldest row suppresses nothing.
            past = log.touched(batch_id, source, alive_at=oldest)
            kept = stage(replay(rows, ttl, past, folder=folder), f"kept-{batch_id}", f"{folder}/kept")
            log.append(touches(kept, spec), batch_id, source)
        write_part(metric_points(kept, spec), f"{out}/metric_points", part, source)
        write_part(log_records(kept, spec), f"{out}/log_records", part, source)
        write_part(run_rows(spec, envelopes, kept, now), f"{out}/scrape_runs", part, source)
        discard(spark, folder)

    return process


def start(
    spec: SourceSpec, payloads: DataFrame, log: FingerprintLog, out: str, checkpoint: str, **trigger
) -> StreamingQuery:
    """Runs a source over a payload stream, with the trigger given (such as ``availableNow=True``)."""
    runs = folder_names(payloads.sparkSession, f"{out}/scrape_runs/batch_id=0")
    _refuse_second_start(payloads, checkpoint, spec.name, [n for n in runs if n == source_folder(spec.name)])
    rows = prepare_rows(payloads.where(F.col("source") == spec.name), spec)
    writer = rows.writeStream.queryName(spec.name).foreachBatch(table_sink(spec, log, out))
    return writer.option("checkpointLocation", checkpoint).trigger(**trigger).start()


def _refuse_second_start(stream: DataFrame, checkpoint: str, source: str, batches: list[str]) -> None:
    """A stream with a new checkpoint counts its batches from 0 and would replace those of another."""
    if batches and not folder_names(stream.sparkSession, f"{checkpoint}/offsets"):
        raise ValueError(f"the output holds batches of {source!r} that are not of checkpoint {checkpoint}; use a new output")
