"""Fingerprints, TTL dedupe and upkeep of the fingerprint table."""

from __future__ import annotations

from pyspark.sql import functions as F

from driver_queries import query
from driver_queries.inputs import event_pages, event_records, events, spec, table
from payload_metrics.operators import dedupe as d
from payload_metrics.operators.extract import extract, typed_records
from payload_metrics.operators.fields import fields_of

NOW = 1706745600  # 2024-02-01T00:00:00Z
SPLIT = 1705708800  # 2024-01-20T00:00:00Z
DAYS_15 = 1296000

KEYS = {"enabled": True, "fingerprintMode": "keys", "fingerprintKeys": ["user_id", "event_type"]}

_KEY_TEXT = """'events:{"event_type":"' || event_type || '","user_id":' || user_id || '}'"""
_HASHED = f"(SELECT *, CAST(floor(epoch(ts)) AS BIGINT) AS s, sha256({_KEY_TEXT}) AS hash FROM events)"


def _keyed(ttl: int | None = None):
    return spec(deltaDetection=KEYS | ({"ttlSeconds": ttl} if ttl else {}))


def _hashed_events(spark, sf_dir):
    return d.fingerprint(event_records(spark, sf_dir), _keyed())


@query(f"SELECT event_id, hash FROM {_HASHED}")
def fingerprint_keys(spark, sf_dir):
    records, _ = extract(event_pages(spark, sf_dir), spec(dataKey="data.records"))
    hashed = d.fingerprint(records, _keyed())
    return hashed.select(fields_of(hashed).number("event_id").cast("bigint").alias("event_id"), "hash")


@query(f"SELECT event_id, hash FROM {_HASHED}")
def fingerprint_keys_typed(spark, sf_dir):
    return _hashed_events(spark, sf_dir).select(F.col("record.event_id").alias("event_id"), "hash")


@query(
    "SELECT event_id, sha256('events:{\"event_id\":' || event_id || ',\"event_type\":\"' || event_type || "
    "'\",\"props\":{\"k\":' || json_extract(props, '$.k') || '},\"ts\":\"' || strftime(ts, '%Y-%m-%d %H:%M:%S.%f') || "
    "'\",\"user_id\":' || user_id || ',\"value\":' || "
    "CASE WHEN value = floor(value) THEN CAST(CAST(value AS BIGINT) AS VARCHAR) ELSE CAST(value AS VARCHAR) END || "
    "'}') AS hash FROM events"
)
def fingerprint_full(spark, sf_dir):
    records, _ = extract(event_pages(spark, sf_dir), spec(dataKey="data.records"))
    hashed = d.fingerprint(records, spec())
    return hashed.select(fields_of(hashed).number("event_id").cast("bigint").alias("event_id"), "hash")


@query(
    f"SELECT hash, min_by(event_id, (ts, event_id)) AS event_id, count(*) AS n_seen FROM {_HASHED} GROUP BY hash"
)
def dedupe_first(spark, sf_dir):
    kept = d.dedupe(event_records(spark, sf_dir), None, _keyed(), NOW)
    return kept.select("hash", F.col("record.event_id").alias("event_id"), "n_seen")


def _history(spark, sf_dir):
    """Early events as a fingerprint table."""
    early = _hashed_events(spark, sf_dir).where(F.col("fetched_at") < F.timestamp_seconds(F.lit(SPLIT)))
    empty = spark.createDataFrame([], d.FINGERPRINT_SCHEMA)
    return d.upsert(empty, d.touches(early, _keyed(DAYS_15)))


_STORE = (
    f"(SELECT 'events' AS source, hash, min(s) AS first_seen, max(s) AS last_seen, {DAYS_15} AS ttl_seconds "
    f"FROM {_HASHED} WHERE s < {SPLIT} GROUP BY hash)"
)


@query(
    f"SELECT hash, min_by(event_id, (ts, event_id)) AS event_id, count(*) AS n_seen FROM {_HASHED} WHERE s >= {SPLIT} "
    f"AND hash NOT IN (SELECT hash FROM {_STORE} WHERE {NOW} - last_seen <= ttl_seconds) GROUP BY hash"
)
def dedupe_ttl_store(spark, sf_dir):
    late = event_records(spark, sf_dir).where(F.col("fetched_at") >= F.timestamp_seconds(F.lit(SPLIT)))
    kept = d.dedupe(late, _history(spark, sf_dir), _keyed(DAYS_15), NOW)
    return kept.select("hash", F.col("record.event_id").alias("event_id"), "n_seen")


@query(
    "SELECT strftime(ts, '%Y-%m-%d') AS scrape_id, count(*) AS total, count(*) FILTER (rn = 1) AS misses, "
    "count(*) FILTER (rn > 1) AS hits FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type "
    "ORDER BY ts, event_id) AS rn FROM events) GROUP BY 1"
)
def dedupe_stats(spark, sf_dir):
    day = F.date_format("ts", "yyyy-MM-dd")
    records = typed_records(
        events(spark, sf_dir), "events", order_by="event_id", scrape_id=day, fetched_at=F.col("ts")
    )
    stats = d.dedupe_stats(records, d.dedupe(records, None, _keyed(), NOW))
    return stats.select("scrape_id", "total", "misses", "hits")


@query("SELECT count(*) AS total, count(*) AS misses, CAST(0 AS BIGINT) AS hits FROM events")
def dedupe_disabled(spark, sf_dir):
    records = event_records(spark, sf_dir)
    kept = d.dedupe(records, None, spec(deltaDetection=KEYS | {"enabled": False}), NOW)
    return d.dedupe_stats(records, kept).select("total", "misses", "hits")


_REPLAY = f"""
WITH RECURSIVE t AS (
  SELECT event_id, hash, s, row_number() OVER (PARTITION BY hash ORDER BY ts, event_id) AS rn FROM {_HASHED}
), r AS (
  SELECT event_id, hash, rn, s AS last, true AS emitted FROM t WHERE rn = 1
  UNION ALL
  SELECT t.event_id, t.hash, t.rn, CASE WHEN t.s - r.last > 86400 THEN t.s ELSE r.last END, t.s - r.last > 86400
  FROM r JOIN t ON t.hash = r.hash AND t.rn = r.rn + 1
)"""


@query(f"{_REPLAY} SELECT event_id, hash FROM r WHERE emitted")
def dedupe_replay(spark, sf_dir):
    emitted = d.replay(_hashed_events(spark, sf_dir), 86400)
    return emitted.select(F.col("record.event_id").alias("event_id"), "hash")


_STORED = f"""
WITH RECURSIVE st AS (SELECT hash, max(s) AS stored FROM {_HASHED} WHERE s < {SPLIT} GROUP BY hash), t AS (
  SELECT event_id, hash, s, row_number() OVER (PARTITION BY hash ORDER BY ts, event_id) AS rn
  FROM {_HASHED} LEFT JOIN st USING (hash) WHERE stored IS NULL OR s > stored + {DAYS_15 // 3}
), r AS (
  SELECT event_id, hash, rn, s AS last, true AS emitted FROM t WHERE rn = 1
  UNION ALL
  SELECT t.event_id, t.hash, t.rn, CASE WHEN t.s - r.last > 86400 THEN t.s ELSE r.last END, t.s - r.last > 86400
  FROM r JOIN t ON t.hash = r.hash AND t.rn = r.rn + 1
)"""


@query(f"{_STORED} SELECT event_id, hash FROM r WHERE emitted")
def replay_with_store(spark, sf_dir):
    """A stored TTL other than the spec's, and rows older than what is stored."""
    hashed = _hashed_events(spark, sf_dir)
    early = hashed.where(F.col("fetched_at") < F.timestamp_seconds(F.lit(SPLIT)))
    emitted = d.replay(hashed, 86400, d.touches(early, _keyed(DAYS_15 // 3)))
    return emitted.select(F.col("record.event_id").alias("event_id"), "hash")


@query(
    "SELECT 'events' AS source, hash, max(begins) AS first_seen, max(s) AS last_seen, CAST(86400 AS BIGINT) AS ttl_seconds "
    "FROM (SELECT hash, s, CASE WHEN lag(s) OVER w IS NULL OR lag(s) OVER w + 86400 < s THEN s END AS begins "
    f"FROM {_HASHED} WINDOW w AS (PARTITION BY hash ORDER BY s)) GROUP BY hash"
)
def store_snapshot(spark, sf_dir):
    """A log of touches folded: a fingerprint that had expired starts afresh."""
    return d.fold_touches(d.touches(_hashed_events(spark, sf_dir), _keyed(86400)))


@query(
    f"SELECT 'events' AS source, hash, min(s) FILTER (WHERE NOT fresh OR s >= {SPLIT}) AS first_seen, "
    "max(s) AS last_seen, max(ttl) AS ttl_seconds FROM ("
    f"SELECT *, CASE WHEN min(s) FILTER (WHERE s >= {SPLIT}) OVER (PARTITION BY hash) > "
    f"max(s) FILTER (WHERE s < {SPLIT}) OVER (PARTITION BY hash) + {DAYS_15} THEN true ELSE false END AS fresh, "
    f"CASE WHEN max(s) OVER (PARTITION BY hash) >= {SPLIT} THEN 600 ELSE {DAYS_15} END AS ttl FROM {_HASHED}"
    ") GROUP BY hash"
)
def store_upsert(spark, sf_dir):
    late = _hashed_events(spark, sf_dir).where(F.col("fetched_at") >= F.timestamp_seconds(F.lit(SPLIT)))
    return d.upsert(_history(spark, sf_dir), d.touches(late, _keyed(600)))


def _user_store(spark, sf_dir):
    """Events as touches; the event type is the source, the user the fingerprint."""
    seconds = F.unix_seconds("ts")
    return events(spark, sf_dir).groupBy(
        F.col("event_type").alias("source"), F.sha2(F.col("user_id").cast("string"), 256).alias("hash")
    ).agg(
        F.min(seconds).alias("first_seen"),
        # Whole days, so that many entries share their last second.
        (F.floor(F.max(seconds) / 86400) * 86400).alias("last_seen"),
        F.lit(86400).cast("bigint").alias("ttl_seconds"),
    )


_USER_STORE = (
    "(SELECT event_type AS source, sha256(CAST(user_id AS VARCHAR)) AS hash, "
    "CAST(min(floor(epoch(ts))) AS BIGINT) AS first_seen, "
    "CAST(max(floor(epoch(ts))) AS BIGINT) // 86400 * 86400 AS last_seen, CAST(86400 AS BIGINT) AS ttl_seconds "
    "FROM events GROUP BY ALL)"
)
_COLUMNS = "source, hash, first_seen, last_seen, ttl_seconds"


@query(
    f"SELECT {_COLUMNS} FROM {_USER_STORE} "
    "QUALIFY row_number() OVER (PARTITION BY source ORDER BY last_seen DESC, hash) <= 40"
)
def store_trim(spark, sf_dir):
    return d.trim(_user_store(spark, sf_dir), 40)


@query(f"SELECT {_COLUMNS} FROM {_USER_STORE} WHERE last_seen + ttl_seconds >= {NOW - 3 * 86400}")
def store_expire(spark, sf_dir):
    return d.expire(_user_store(spark, sf_dir), NOW - 3 * 86400)


@query(f"SELECT {_COLUMNS} FROM {_USER_STORE} WHERE source IN (SELECT event_type FROM events WHERE value > 350)")
def store_orphans(spark, sf_dir):
    active = table(spark, sf_dir, "events").where(F.col("value") > 350)
    return d.drop_orphans(_user_store(spark, sf_dir), active.select(F.col("event_type").alias("source")))
