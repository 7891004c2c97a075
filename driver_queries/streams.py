"""Streaming forms, run to the end of the available files."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driver_queries import query
from driver_queries.deltas import _HASHED, _REPLAY, KEYS
from driver_queries.inputs import TIME_TEXT, spec, table
from driver_queries.mapping import BUCKETS, BY_TYPE
from payload_metrics.operators.dedupe import RECORD_ORDER, fingerprint
from payload_metrics.operators.extract import typed_records
from payload_metrics.operators.fields import fields_of
from payload_metrics.sources.outputs import FingerprintLog, PointLog
from payload_metrics.sources.tables import folder_names, shared_folder
from payload_metrics.streaming import streams


def _event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events file as a stream, typed like the batch records."""
    schema = table(spark, sf_dir, "events").schema
    raw = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    return _with_types(raw)


def _with_types(raw: DataFrame) -> DataFrame:
    return raw.withColumn("ts", F.col("ts").cast("timestamp")).withColumn("props", F.from_json("props", "k bigint"))


def _typed(raw: DataFrame) -> DataFrame:
    return typed_records(_with_types(raw), "events", order_by="event_id", fetched_at=F.col("ts"))


def _typed_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _event_stream(spark, sf_dir)
    return typed_records(rows, "events", order_by="event_id", fetched_at=F.col("ts"))


def _folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/streams/{uuid.uuid4().hex}"


def _drain(stream: DataFrame) -> DataFrame:
    """Runs a stream into a parquet table and reads it back."""
    spark = stream.sparkSession
    folder = _folder(spark)
    writer = stream.writeStream.format("parquet").option("checkpointLocation", f"{folder}/checkpoint")
    writer.trigger(availableNow=True).start(f"{folder}/out").awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/out")


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events WHERE event_type <> 'error'")
def stream_extract(spark, sf_dir):
    """One payload per event: stateless extraction, filter and mapping."""
    rows = _event_stream(spark, sf_dir)
    one = F.struct("event_id", F.date_format("ts", TIME_TEXT).alias("ts"), "user_id", "event_type", "value", "props")
    payloads = rows.select(
        F.lit("events").alias("source"),
        F.col("event_id").cast("string").alias("scrape_id"),
        F.lit(0).alias("window_id"),
        F.col("ts").alias("fetched_at"),
        F.to_json(F.struct(F.array(one).alias("records"))).alias("payload"),
    )
    drop = [{"any": [{"field": "event_type", "matchType": "equals", "value": "error"}]}]
    records = streams.stream_records(payloads, spec(dataKey="records", filters={"drop": drop}))
    fields = fields_of(records)
    return _drain(
        records.select(
            fields.number("event_id").cast("bigint").alias("event_id"),
            fields.number("props.k").cast("bigint").alias("k"),
        )
    )


@query(f"{_REPLAY} SELECT event_id, hash FROM r WHERE emitted")
def stream_dedupe(spark, sf_dir):
    """Exact TTL dedupe with keyed state."""
    # One file is read by few tasks, so its rows are dealt to all before they are hashed.
    rows = _event_stream(spark, sf_dir).repartition("event_id")
    return _exact(typed_records(rows, "events", order_by="event_id", fetched_at=F.col("ts")))


@query(f"{_REPLAY} SELECT event_id, hash FROM r WHERE emitted")
def stream_dedupe_batches(spark, sf_dir):
    """The same in several micro-batches: the state lasts from one to the next."""
    return _exact(_typed(_in_parts(spark, sf_dir, [(1, 8), (9, 16), (17, 24), (25, 31)])))


#: Rows of a range of days that go to one file, on average.
ROWS_A_FILE = 100_000


def _in_parts(spark: SparkSession, sf_dir: str, days: list[tuple[int, int]], in_order: bool = False) -> DataFrame:
    """Events of ranges of days as a stream that reads one range after the other.

    Every range is dealt to the same number of files, so that it takes as many tasks as it has rows
    for. With ``in_order`` it is one file, whose rows come sorted.
    """
    folder, rows = f"{_folder(spark)}/in", table(spark, sf_dir, "events")
    files = 1 if in_order else 1 + rows.count() // (len(days) * ROWS_A_FILE)
    day = F.dayofmonth(F.col("ts").cast("timestamp"))
    for done, (low, high) in enumerate(days):
        part = rows.where(day.between(low, high))
        part = part.coalesce(1) if files == 1 else part.repartition(files)
        part.sortWithinPartitions("ts", "event_id").write.mode("append").parquet(folder)
        _fill_up(rows, folder, files * (done + 1))
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", files).parquet(folder)


def _fill_up(rows: DataFrame, folder: str, files: int) -> None:
    """Adds empty files up to a number: a task without rows writes none, and a batch that takes too
    few would go on with those of the next range."""
    written = [name for name in folder_names(rows.sparkSession, folder) if name.startswith("part-")]
    for _ in range(files - len(written)):
        rows.limit(0).coalesce(1).write.mode("append").parquet(folder)


def _exact(records: DataFrame) -> DataFrame:
    """Drains the exact dedupe with the state store it needs, and gives the session's own back.

    Beside the hash only time, order and the field that is read behind it pass through the state.
    """
    conf, key = records.sparkSession.conf, "spark.sql.streaming.stateStore.providerClass"
    config = spec(deltaDetection=KEYS | {"ttlSeconds": 86400})
    slim = fingerprint(records, config).select("hash", *RECORD_ORDER, F.struct("record.event_id").alias("record"))
    before = conf.get(key, None)
    conf.set(key, streams.ROCKSDB)
    try:
        kept = streams.exact_dedupe(slim, config)
        return _drain(kept.select(F.col("record.event_id").alias("event_id"), "hash"))
    finally:
        conf.unset(key) if before is None else conf.set(key, before)


_COARSE_DAYS = [(1, 8), (9, 16), (17, 24), (25, 31)]
_COARSE = f"""
WITH RECURSIVE e AS (
  SELECT *, CASE {" ".join(f"WHEN day(ts) <= {high} THEN {i}" for i, (_, high) in enumerate(_COARSE_DAYS))} END AS batch FROM {_HASHED}
), marks AS (
  SELECT batch, max(ts) - INTERVAL 1 DAY AS mark FROM e GROUP BY 1
), firsts AS (
  SELECT hash, batch, min_by(event_id, (ts, event_id)) AS event_id, min(ts) + INTERVAL 1 DAY AS expires FROM e GROUP BY 1, 2
), t AS (
  -- A state goes at the end of the first later batch that starts with a watermark past it.
  SELECT f.*, row_number() OVER (PARTITION BY hash ORDER BY f.batch) AS rn,
    coalesce((SELECT min(m.batch) + 1 FROM marks m WHERE m.batch >= f.batch AND m.mark >= f.expires), 99) AS gone
  FROM firsts f
), r AS (
  SELECT hash, batch, event_id, rn, gone, true AS emitted FROM t WHERE rn = 1
  UNION ALL
  SELECT t.hash, t.batch, t.event_id, t.rn, CASE WHEN t.batch > r.gone THEN t.gone ELSE r.gone END, t.batch > r.gone
  FROM r JOIN t ON t.hash = r.hash AND t.rn = r.rn + 1
)"""


@query(f"{_COARSE} SELECT batch, event_id, hash FROM r WHERE emitted")
def stream_dedupe_coarse(spark, sf_dir):
    """Built-in TTL dedupe in several micro-batches: a key is emitted again in a batch that starts
    after its state went."""
    config = spec(deltaDetection=KEYS | {"ttlSeconds": 86400})
    kept = streams.coarse_dedupe(_typed(_in_parts(spark, sf_dir, _COARSE_DAYS, in_order=True)), config)
    day = F.dayofmonth("fetched_at")
    batch = F.lit(0)
    for i, (low, _) in enumerate(_COARSE_DAYS):
        batch = F.when(day >= low, i).otherwise(batch)
    return _drain(kept.select(batch.alias("batch"), F.col("record.event_id").alias("event_id"), "hash"))


@query(f"{_REPLAY} SELECT event_id, hash FROM r WHERE emitted")
def stream_compacted(spark, sf_dir):
    """Micro-batch dedupe in ten batches, the fingerprint log folded after every third."""
    config = spec(deltaDetection=KEYS | {"ttlSeconds": 86400})
    folder, log = _folder(spark), FingerprintLog(spark, f"{_folder(spark)}/fingerprints")
    sink = streams.table_sink(config, log, folder, compact_every=3)
    days = [(low, low + 2 if low < 28 else 31) for low in range(1, 31, 3)]
    writer = _typed(_in_parts(spark, sf_dir, days)).writeStream.foreachBatch(sink)
    writer.option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    body = F.from_json("body", "source string, record struct<event_id: bigint, user_id: bigint, event_type: string>")
    records = spark.read.parquet(f"{folder}/log_records").select(body["record"].alias("record"))
    hashed = fingerprint(records, config)
    return hashed.select(F.col("record.event_id").alias("event_id"), "hash")


@query(
    f"{_REPLAY} SELECT event_type AS kind, count(*) AS logs, CAST(count(*) AS DOUBLE) AS counted "
    "FROM r JOIN events USING (event_id) WHERE emitted GROUP BY 1"
)
def stream_sink(spark, sf_dir):
    """Micro-batch dedupe against the fingerprint log, into metric and log tables."""
    config = spec(
        deltaDetection=KEYS | {"ttlSeconds": 86400}, attributes=BY_TYPE, counterReadings=[{"name": "c"}]
    )
    folder = _folder(spark)
    sink = streams.table_sink(config, FingerprintLog(spark, f"{folder}/fingerprints"), folder)
    writer = _typed_stream(spark, sf_dir).writeStream.foreachBatch(sink)
    writer = writer.option("checkpointLocation", f"{folder}/checkpoint")
    writer.trigger(availableNow=True).start().awaitTermination()
    kind = F.col("attrs")["kind"].alias("kind")
    points = spark.read.parquet(f"{folder}/metric_points").groupBy(kind).agg(F.sum("value").alias("counted"))
    logs = spark.read.parquet(f"{folder}/log_records").groupBy(kind).agg(F.count("*").alias("logs"))
    return points.join(logs, "kind").select("kind", "logs", "counted")


@query(
    f"{_REPLAY} SELECT 'success' AS status, count(*) AS records, (SELECT count(*) FROM events) - count(*) AS hits, "
    "(SELECT count(*) FROM events) AS total FROM r WHERE emitted"
)
def stream_runs(spark, sf_dir):
    """The run rows a stream leaves."""
    config = spec(deltaDetection=KEYS | {"ttlSeconds": 86400}, emitLogs=False)
    folder = _folder(spark)
    sink = streams.table_sink(config, FingerprintLog(spark, f"{folder}/fingerprints"), folder)
    writer = _typed_stream(spark, sf_dir).writeStream.foreachBatch(sink)
    writer.option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    runs = spark.read.parquet(f"{folder}/scrape_runs")
    counted = runs.groupBy("status").agg(*[F.sum(c).alias(c) for c in ("records", "hits", "total")])
    return counted.select("status", "records", "hits", "total")


def _window_points(spark: SparkSession, sf_dir: str, config) -> DataFrame:
    """Daily points in update mode over four batches, folded once, the open windows included."""
    records = _typed(_in_parts(spark, sf_dir, [(1, 8), (9, 16), (17, 24), (25, 31)]))
    return _points_of(records, config, "1 hour")


def _points_of(records: DataFrame, config, late: str) -> DataFrame:
    spark = records.sparkSession
    folder = _folder(spark)
    log = PointLog(spark, f"{folder}/points")
    started = streams.start_windows(
        config, records, "1 day", late, log, f"{folder}/checkpoint", compact_every=2, availableNow=True
    )
    started.awaitTermination()
    return log.points().withColumn("kind", F.col("attrs")["kind"])


@query(
    "SELECT strftime(ts, '%Y-%m-%d') AS day, event_type AS kind, count(*) AS count, round(sum(value), 2) AS total, "
    "count(*) FILTER (value <= 10) AS b0 FROM events GROUP BY 1, 2"
)
def stream_counters(spark, sf_dir):
    """Counter and histogram per day, up to the last day, which is still open."""
    config = spec(
        attributes=BY_TYPE,
        counterReadings=[{"name": "c", "dataKey": "value"}],
        histogramReadings=[{"name": "h", "dataKey": "value", "buckets": BUCKETS}],
    )
    out = _window_points(spark, sf_dir, config)
    return out.groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day"), "kind").agg(
        F.max("count").alias("count"),
        F.round(F.max("value"), 2).alias("total"),
        F.max(F.try_element_at("bucket_counts", F.lit(1))).alias("b0"),
    )


@query(
    "SELECT strftime(ts, '%Y-%m-%d') AS day, event_type AS kind, CAST(count(*) * CASE event_type WHEN 'error' THEN 3 ELSE 1 END "
    "AS DOUBLE) AS outcome FROM events WHERE event_type IN ('error', 'click') GROUP BY 1, 2"
)
def stream_attr_metric(spark, sf_dir):
    """An attribute as a metric, beside a counter with another attribute, per day."""
    mapped = {"name": "kind", "dataKey": "event_type", "asMetric": {"metricName": "outcome", "valueMapping": {"error": 3, "click": 1}}}
    config = spec(attributes=[mapped, {"name": "user", "dataKey": "user_id"}], counterReadings=[{"name": "c"}])
    out = _window_points(spark, sf_dir, config).where("metric = 'outcome'")
    return out.select(F.date_format("ts", "yyyy-MM-dd").alias("day"), "kind", F.col("value").alias("outcome"))


_EARLY = "(day(ts) BETWEEN 10 AND 20 AND event_id % 2 = 0)"


@query(
    "SELECT strftime(ts, '%Y-%m-%d') AS day, event_type AS kind, CAST(count(*) AS DOUBLE) AS counted FROM events "
    f"WHERE {_EARLY} OR date_trunc('day', ts) + INTERVAL 1 DAY > "
    f"(SELECT max(ts) - INTERVAL 36 HOUR FROM events WHERE {_EARLY}) GROUP BY 1, 2"
)
def stream_late(spark, sf_dir):
    """Half of some days first, another day, then all else: rows of days that the watermark of the
    first batch has passed are dropped, others join the windows that are still open.

    A batch drops rows by the watermark that the batch before it started with.
    """
    folder, rows = f"{_folder(spark)}/in", table(spark, sf_dir, "events")
    early = F.expr("dayofmonth(CAST(ts AS TIMESTAMP)) BETWEEN 10 AND 20 AND event_id % 2 = 0")
    next_day = F.expr("dayofmonth(CAST(ts AS TIMESTAMP)) = 21")
    for part in (rows.where(early), rows.where(next_day), rows.where(~early & ~next_day)):
        part.coalesce(1).write.mode("append").parquet(folder)
    raw = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(folder)
    out = _points_of(_typed(raw), spec(attributes=BY_TYPE, counterReadings=[{"name": "c"}]), "36 hours")
    return out.select(F.date_format("ts", "yyyy-MM-dd").alias("day"), "kind", F.col("value").alias("counted"))
