"""Extraction from payloads packed out of ``events``."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import functions as F

from driver_queries import query
from driver_queries.inputs import event_chapters, event_pages, events, spec, table
from payload_metrics.functions.durations import frequency_seconds_col
from payload_metrics.functions.timetext import format_time, parse_time
from payload_metrics.functions.values import map_value, strict_double
from payload_metrics.operators.extract import extract
from payload_metrics.operators.fields import fields_of
from payload_metrics.plans.pipeline import dry_run


def _event_fields(records, *more):
    fields = fields_of(records)
    return records.select(
        fields.number("event_id").cast("bigint").alias("event_id"),
        fields.text("event_type").alias("event_type"),
        fields.number("value").alias("value"),
        *more,
    )


@query("SELECT event_id, event_type, value, event_id % 100 AS record_idx FROM events")
def extract_list(spark, sf_dir):
    pages = event_pages(spark, sf_dir, document=F.col("records"))
    records, _ = extract(pages, spec())
    return _event_fields(records, "record_idx")


@query(
    "SELECT event_id, event_type, value, CAST(json_extract(props, '$.k') AS BIGINT) AS k, "
    "strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS ts_text FROM events"
)
def extract_nested(spark, sf_dir):
    records, _ = extract(event_pages(spark, sf_dir), spec(dataKey="data.records"))
    fields = fields_of(records)
    k = fields.number("props.k").cast("bigint").alias("k")
    return _event_fields(records, k, fields.text("ts").alias("ts_text"))


@query("SELECT event_id, event_type, value FROM events")
def extract_all_items(spark, sf_dir):
    records, _ = extract(event_chapters(spark, sf_dir), spec(dataKey="sheets[].records"))
    return _event_fields(records)


@query(
    "SELECT event_id, event_type, value FROM events "
    "QUALIFY event_id // 10 = max(event_id // 10) OVER (PARTITION BY event_id // 100)"
)
def extract_index(spark, sf_dir):
    records, _ = extract(event_chapters(spark, sf_dir), spec(dataKey="sheets[-1].records"))
    return _event_fields(records)


@query(
    "SELECT event_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY event_id // 100 "
    "ORDER BY event_id) - 1 AS i FROM events) WHERE i >= 1 AND i < 3"
)
def extract_slice(spark, sf_dir):
    records, _ = extract(event_pages(spark, sf_dir), spec(dataKey="data.records[1:3]"))
    return _event_fields(records)


@query(
    "SELECT event_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY event_id // 100 "
    "ORDER BY event_id DESC) AS i FROM events) WHERE i <= 2"
)
def extract_slice_tail(spark, sf_dir):
    records, _ = extract(event_pages(spark, sf_dir), spec(dataKey="data.records[-2:]"))
    return _event_fields(records)


@query("SELECT event_id, event_type, value FROM events")
def extract_literal_dot(spark, sf_dir):
    doc = F.struct(F.struct(F.col("records").alias("c")).alias("a.b"))
    records, _ = extract(event_pages(spark, sf_dir, doc), spec(dataKey="a/.b.c"))
    return _event_fields(records)


_SHAPES = """
SELECT event_id, event_type,
  CASE event_type
    WHEN 'error' THEN '{"items": [{"id": ' || event_id
    WHEN 'click' THEN '{"items": {"id": ' || event_id || '}}'
    WHEN 'view' THEN '{"items": [{"id": ' || event_id || '}, {"id": ' || user_id || '}]}'
    WHEN 'purchase' THEN '{"items": [' || event_id || ', ' || user_id || ']}'
    ELSE '{"items": "' || event_type || event_id || '"}' END AS payload
FROM events"""


def _shaped(spark, sf_dir):
    """One payload per event, whose shape depends on the event type."""
    rows = events(spark, sf_dir)
    event, user, kind = (F.col(c).cast("string") for c in ("event_id", "user_id", "event_type"))
    payload = (
        F.when(kind == "error", F.concat(F.lit('{"items": [{"id": '), event))
        .when(kind == "click", F.concat(F.lit('{"items": {"id": '), event, F.lit("}}")))
        .when(kind == "view", F.concat(F.lit('{"items": [{"id": '), event, F.lit('}, {"id": '), user, F.lit("}]}")))
        .when(kind == "purchase", F.concat(F.lit('{"items": ['), event, F.lit(", "), user, F.lit("]}")))
        .otherwise(F.concat(F.lit('{"items": "'), kind, event, F.lit('"}')))
    )
    return rows.select(
        F.lit("events").alias("source"),
        event.alias("scrape_id"),
        F.lit(0).alias("window_id"),
        F.col("ts").alias("fetched_at"),
        payload.alias("payload"),
    )


@query(
    "SELECT CAST(event_id AS VARCHAR) AS scrape_id, CASE event_type WHEN 'error' THEN 'payload is not valid JSON' "
    "WHEN 'purchase' THEN 'expected a list of objects' ELSE 'expected an object or a list of objects' END AS reason, "
    f"substr(payload, 1, 200) AS snippet FROM ({_SHAPES}) WHERE event_type NOT IN ('click', 'view')"
)
def extract_rejects(spark, sf_dir):
    _, rejects = extract(_shaped(spark, sf_dir), spec(dataKey="items"))
    return rejects.select("scrape_id", "reason", "snippet")


@query(
    "SELECT CAST(event_id AS VARCHAR) AS scrape_id, event_id AS id FROM events WHERE event_type IN ('click', 'view') "
    "UNION ALL SELECT CAST(event_id AS VARCHAR), user_id FROM events WHERE event_type = 'view'"
)
def extract_mixed_shapes(spark, sf_dir):
    records, _ = extract(_shaped(spark, sf_dir), spec(dataKey="items"))
    return records.select("scrape_id", fields_of(records).number("id").cast("bigint").alias("id"))


@query(
    "SELECT event_id, CAST(count(*) OVER (PARTITION BY event_id // 100) AS BIGINT) AS page_size, "
    "first_value(event_type) OVER (PARTITION BY event_id // 100 ORDER BY event_id) AS first_type FROM events"
)
def root_lookup(spark, sf_dir):
    doc = F.struct(
        F.size("records").alias("limit"),
        F.struct(F.col("records")[0]["event_type"].alias("type")).alias("first"),
        "records",
    )
    attrs = [{"name": "size", "dataKey": "$root.limit"}, {"name": "first", "dataKey": "$root.first.type"}]
    records, _ = extract(event_pages(spark, sf_dir, doc), spec(dataKey="records", attributes=attrs))
    fields = fields_of(records)
    return records.select(
        fields.number("event_id").cast("bigint").alias("event_id"),
        fields.number("$root.limit").cast("bigint").alias("page_size"),
        fields.text("$root.first.type").alias("first_type"),
    )


@query(
    "SELECT 'events' AS source, count(*) AS records FROM events WHERE event_type <> 'error' AND value >= 0"
)
def dry_run_counts(spark, sf_dir):
    drop = [{"any": [{"field": "event_type", "matchType": "equals", "value": "error"}]}]
    config = spec(dataKey="data.records", filters={"drop": drop})
    return dry_run(config, event_pages(spark, sf_dir), None, datetime(2024, 2, 1, tzinfo=timezone.utc))


@query(
    "SELECT event_id, CAST(json_extract(props, '$.k') AS VARCHAR) AS k_text, "
    "CAST(NULL AS VARCHAR) AS missing_text, CAST(NULL AS VARCHAR) AS list_text FROM events"
)
def path_lookup(spark, sf_dir):
    records, _ = extract(event_pages(spark, sf_dir), spec(dataKey="data.records"))
    fields = fields_of(records)
    return records.select(
        fields.number("event_id").cast("bigint").alias("event_id"),
        fields.text("props.k").alias("k_text"),
        fields.text("props.none.k").alias("missing_text"),
        fields.text("props[0].k").alias("list_text"),
    )


@query(
    "SELECT event_id, CASE event_type WHEN 'click' THEN value WHEN 'view' THEN CAST(user_id AS DOUBLE) "
    "WHEN 'error' THEN NULL WHEN 'signup' THEN 1.0 ELSE CAST(event_id * 1000 AS DOUBLE) END AS number FROM events"
)
def numeric_coerce(spark, sf_dir):
    rows = events(spark, sf_dir)
    kind, value = F.col("event_type"), F.col("value").cast("string")
    text = (
        F.when(kind == "click", F.concat(F.lit(" "), value, F.lit(" ")))
        .when(kind == "view", F.concat(F.lit("+"), F.col("user_id").cast("string"), F.lit(".")))
        .when(kind == "error", F.concat(value, F.lit("d")))
        .when(kind == "signup", F.lit("1e0"))
        .otherwise(F.concat(F.col("event_id").cast("string"), F.lit("_000")))
    )
    return rows.select("event_id", strict_double(text).alias("number"))


@query(
    "SELECT event_id, CASE event_type WHEN 'error' THEN 0.0 WHEN 'view' THEN 0.5 WHEN 'purchase' THEN 1.0 END "
    "AS mapped FROM events"
)
def value_mapping(spark, sf_dir):
    records, _ = extract(event_pages(spark, sf_dir), spec(dataKey="data.records"))
    fields = fields_of(records)
    mapping = {"error": 0.0, "view": 0.5, "purchase": 1.0}
    mapped = map_value(fields.printed("event_type"), fields.text("event_type"), mapping)
    return records.select(fields.number("event_id").cast("bigint").alias("event_id"), mapped.alias("mapped"))


@query(
    "SELECT c_custkey, CASE c_nationkey // 5 WHEN 0 THEN 60 WHEN 1 THEN 3600 WHEN 2 THEN 86400 WHEN 3 THEN 2592000 END "
    "* c_custkey AS seconds FROM customer"
)
def frequency_seconds(spark, sf_dir):
    """Customer numbers with a unit by nation; the unit ``s`` is not valid."""
    units = F.element_at(F.array(*[F.lit(u) for u in ("min", "h", "d", "mon", "s")]), F.expr("int(c_nationkey div 5) + 1"))
    text = F.concat(F.col("c_custkey").cast("string"), units)
    customers = table(spark, sf_dir, "customer")
    return customers.select("c_custkey", frequency_seconds_col(text).alias("seconds"))


@query(
    "SELECT event_id, strftime(ts, '%d/%m/%Y %H:%M') AS short_text, "
    "CAST(epoch(date_trunc('second', ts)) AS BIGINT) AS seconds, "
    "strftime(ts, '%Y-%m-%dT%H:%M:%S+0000') AS offset_text FROM events"
)
def time_text(spark, sf_dir):
    rows = events(spark, sf_dir)
    fmt = "%Y-%m-%dT%H:%M:%S%z"
    written = format_time(F.col("ts"), fmt)
    return rows.select(
        "event_id",
        format_time(F.col("ts"), "%d/%m/%Y %H:%M").alias("short_text"),
        F.unix_seconds(parse_time(written, fmt)).alias("seconds"),
        written.alias("offset_text"),
    )
