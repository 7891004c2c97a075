"""Records to metric points and log rows."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import functions as F

from driver_queries import query
from driver_queries.deltas import KEYS
from driver_queries.inputs import event_pages, event_records, events, spec, table
from payload_metrics.operators.dedupe import dedupe
from payload_metrics.operators.extract import extract_selected, selected_records, typed_records
from payload_metrics.operators.fields import fields_of
from payload_metrics.operators.logs import log_records
from payload_metrics.operators.metrics import (
    attribute_map,
    attribute_texts,
    cumulative_points,
    latest_gauges,
    metric_points,
    series_text,
)
from payload_metrics.plans.pipeline import prepare_rows, run

BY_TYPE = [{"name": "kind", "dataKey": "event_type"}]
BUCKETS = [10, 50, 100]


def _attr(name: str):
    return F.col("attrs")[name].alias(name)


def _event_points(spark, sf_dir, **readings):
    return metric_points(event_records(spark, sf_dir), spec(attributes=BY_TYPE, **readings))


@query(
    "SELECT event_type AS kind, count(*) FILTER (rn = 1) AS records, "
    "round(sum(CASE WHEN rn = 1 THEN value END), 2) AS value_sum, "
    "count(*) FILTER (rn = 1 AND value <= 10) AS le_10, count(*) FILTER (rn = 1 AND value <= 50) AS le_50, "
    "count(*) FILTER (rn = 1 AND value <= 100) AS le_100 FROM (SELECT *, row_number() OVER ("
    "PARTITION BY user_id, event_type ORDER BY max_ts, event_id) AS rn FROM (SELECT *, max(ts) OVER ("
    "PARTITION BY event_id // 100) AS max_ts FROM events WHERE value >= 0.05 AND event_type <> 'signup')) GROUP BY 1"
)
def payloads_to_metrics(spark, sf_dir):
    """The whole way: payload pages, drop and keep rules, key dedupe, counter and histogram."""
    config = spec(
        dataKey="data.records",
        emitLogs=False,
        filters={
            "drop": [{"any": [{"field": "event_type", "matchType": "equals", "value": "signup"}]}],
            "keep": [{"all": [{"field": "value", "matchType": "regex", "value": r"^(\d\d|[1-9]|0\.(0[5-9]|[1-9]))"}]}],
        },
        deltaDetection=KEYS,
        attributes=BY_TYPE,
        counterReadings=[{"name": "records_total"}, {"name": "value_total", "dataKey": "value"}],
        histogramReadings=[{"name": "value", "dataKey": "value", "buckets": BUCKETS}],
    )
    records = selected_records(prepare_rows(event_pages(spark, sf_dir), config))
    points = metric_points(dedupe(records, None, config, 0), config)

    def of(metric):
        return F.col("metric") == metric

    def up_to(n):
        first = F.slice("bucket_counts", 1, n)
        total = F.aggregate(first, F.lit(0).cast("bigint"), lambda a, b: a + b)
        return F.sum(F.when(of("value"), total))

    return points.groupBy(_attr("kind")).agg(
        F.sum(F.when(of("records_total"), F.col("value"))).cast("bigint").alias("records"),
        F.round(F.sum(F.when(of("value_total"), F.col("value"))), 2).alias("value_sum"),
        *[up_to(i + 1).alias(f"le_{b}") for i, b in enumerate(BUCKETS)],
    )


@query(
    "SELECT event_id, 'events' AS source, event_type AS kind, CAST(json_extract(props, '$.k') AS VARCHAR) AS k, "
    "CAST(2 + CASE WHEN json_extract(props, '$.k') IS NULL THEN 0 ELSE 1 END AS INTEGER) AS n_attrs FROM events"
)
def attributes(spark, sf_dir):
    records = event_records(spark, sf_dir)
    config = spec(attributes=[*BY_TYPE, {"name": "k", "dataKey": "props.k"}, {"name": "none", "dataKey": "no.such"}])
    attrs = attribute_map(attribute_texts(fields_of(records), config)).alias("attrs")
    found = records.select(F.col("record.event_id").alias("event_id"), attrs)
    return found.select("event_id", _attr("source"), _attr("kind"), _attr("k"), F.size("attrs").alias("n_attrs"))


@query(
    "SELECT lpad(CAST(event_id // 100000 AS VARCHAR), 15, '0') AS scrape_id, 'success' AS status, "
    "count(*) FILTER (rn = 1) AS records, count(*) FILTER (rn = 1) AS misses, count(*) FILTER (rn > 1) AS hits, "
    "count(*) AS total FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type "
    "ORDER BY max_ts, event_id) AS rn FROM (SELECT *, max(ts) OVER (PARTITION BY event_id // 100) AS max_ts "
    "FROM events WHERE event_type <> 'signup')) GROUP BY 1"
)
def run_rows(spark, sf_dir):
    """A whole run with staged tables; its run rows."""
    drop = [{"any": [{"field": "event_type", "matchType": "equals", "value": "signup"}]}]
    config = spec(dataKey="data.records", filters={"drop": drop}, deltaDetection=KEYS, attributes=BY_TYPE)
    result = run(config, event_pages(spark, sf_dir), None, datetime(2024, 2, 1, tzinfo=timezone.utc))
    return result.scrape_runs.select("scrape_id", "status", "records", "misses", "hits", "total")


@query("SELECT event_type AS kind, max_by(value, event_id) AS value FROM events GROUP BY 1")
def gauge_last(spark, sf_dir):
    points = _event_points(spark, sf_dir, gaugeReadings=[{"name": "g", "dataKey": "value"}])
    return points.select(_attr("kind"), "value")


@query("SELECT DISTINCT event_type AS kind, 2.5::DOUBLE AS value, 's' AS unit FROM events")
def gauge_fixed(spark, sf_dir):
    gauge = {"name": "g", "dataKey": "value", "fixedValue": 2.5, "unit": "s"}
    return _event_points(spark, sf_dir, gaugeReadings=[gauge]).select(_attr("kind"), "value", "unit")


@query("SELECT event_type AS kind, CAST(count(*) AS DOUBLE) AS value FROM events GROUP BY 1")
def counter_default(spark, sf_dir):
    return _event_points(spark, sf_dir, counterReadings=[{"name": "c"}]).select(_attr("kind"), "value")


@query("SELECT event_type AS kind, count(*) * 3.0::DOUBLE AS value FROM events GROUP BY 1")
def counter_fixed(spark, sf_dir):
    counter = {"name": "c", "fixedValue": 3}
    return _event_points(spark, sf_dir, counterReadings=[counter]).select(_attr("kind"), "value")


@query(
    "SELECT event_type AS kind, round(sum(value), 2) AS value, CAST(count(*) AS DOUBLE) AS no_number "
    "FROM events GROUP BY 1"
)
def counter_field(spark, sf_dir):
    points = _event_points(
        spark,
        sf_dir,
        counterReadings=[{"name": "c", "dataKey": "value"}, {"name": "t", "dataKey": "event_type"}],
    )
    one = points.groupBy(_attr("kind")).agg(
        F.round(F.sum(F.when(F.col("metric") == "c", F.col("value"))), 2).alias("value"),
        F.sum(F.when(F.col("metric") == "t", F.col("value"))).alias("no_number"),
    )
    return one


def _buckets(n: int):
    return [F.element_at("bucket_counts", i + 1).alias(f"b{i}") for i in range(n)]


@query(
    "SELECT event_type AS kind, count(*) AS count, round(sum(value), 2) AS sum, count(*) FILTER (value <= 10) AS b0, "
    "count(*) FILTER (value > 10 AND value <= 50) AS b1, count(*) FILTER (value > 50 AND value <= 100) AS b2, "
    "count(*) FILTER (value > 100) AS b3 FROM events GROUP BY 1"
)
def hist_field(spark, sf_dir):
    hist = {"name": "h", "dataKey": "value", "buckets": BUCKETS}
    points = _event_points(spark, sf_dir, histogramReadings=[hist])
    return points.select(_attr("kind"), "count", F.round("sum", 2).alias("sum"), *_buckets(4))


@query(
    "SELECT event_type AS kind, count(*) AS count, count(*) * 10.0::DOUBLE AS sum, count(*) AS b0, "
    "CAST(0 AS BIGINT) AS b1, CAST(0 AS BIGINT) AS b2, CAST(0 AS BIGINT) AS b3 FROM events GROUP BY 1"
)
def hist_fixed(spark, sf_dir):
    hist = {"name": "h", "fixedValue": 10, "buckets": BUCKETS}
    points = _event_points(spark, sf_dir, histogramReadings=[hist])
    return points.select(_attr("kind"), "count", "sum", *_buckets(4))


@query(
    "SELECT event_type AS status, count(*) * CASE event_type WHEN 'error' THEN 0.0::DOUBLE WHEN 'view' "
    "THEN 0.5::DOUBLE ELSE 2.0::DOUBLE END AS value FROM events "
    "WHERE event_type IN ('error', 'view', 'click') GROUP BY event_type"
)
def attr_metric(spark, sf_dir):
    status = {
        "name": "status",
        "dataKey": "event_type",
        "asMetric": {"metricName": "status_code", "valueMapping": {"error": 0, "view": 0.5, "click": 2}},
    }
    config = spec(attributes=[status, {"name": "user", "dataKey": "user_id"}])
    return metric_points(event_records(spark, sf_dir), config).select(_attr("status"), "value")


def _daily_points(spark, sf_dir, **readings):
    """Event points per day; each day is one scrape."""
    day = F.date_trunc("day", "ts")
    records = typed_records(
        events(spark, sf_dir), "events", order_by="event_id", scrape_id=day.cast("string"), fetched_at=day
    )
    return metric_points(records, spec(attributes=BY_TYPE, **readings))


_DAY = "strftime(ts, '%Y-%m-%d')"


@query(
    f"SELECT kind, day, round(sum(v) OVER w, 2) AS total, CAST(sum(n) OVER w AS BIGINT) AS observations FROM ("
    f"SELECT event_type AS kind, {_DAY} AS day, sum(value) AS v, count(*) AS n FROM events GROUP BY 1, 2) "
    "WINDOW w AS (PARTITION BY kind ORDER BY day)"
)
def counter_cumulative(spark, sf_dir):
    points = _daily_points(
        spark,
        sf_dir,
        counterReadings=[{"name": "c", "dataKey": "value"}],
        histogramReadings=[{"name": "h", "dataKey": "value", "buckets": BUCKETS}],
    )
    totals = cumulative_points(points).groupBy(_attr("kind"), F.date_format("ts", "yyyy-MM-dd").alias("day"))
    return totals.agg(
        F.round(F.max("total_value"), 2).alias("total"), F.max("total_count").alias("observations")
    )


@query(
    f"SELECT kind, day, {', '.join(f'CAST(sum(b{i}) OVER w AS BIGINT) AS b{i}' for i in range(4))} FROM ("
    f"SELECT event_type AS kind, {_DAY} AS day, count(*) FILTER (value <= 10) AS b0, "
    "count(*) FILTER (value > 10 AND value <= 50) AS b1, count(*) FILTER (value > 50 AND value <= 100) AS b2, "
    "count(*) FILTER (value > 100) AS b3 FROM events GROUP BY 1, 2) WINDOW w AS (PARTITION BY kind ORDER BY day)"
)
def hist_cumulative(spark, sf_dir):
    """Bucket counts added up from day to day."""
    points = _daily_points(spark, sf_dir, histogramReadings=[{"name": "h", "dataKey": "value", "buckets": BUCKETS}])
    totals = cumulative_points(points)
    buckets = [F.element_at("total_bucket_counts", i + 1).alias(f"b{i}") for i in range(len(BUCKETS) + 1)]
    return totals.select(_attr("kind"), F.date_format("ts", "yyyy-MM-dd").alias("day"), *buckets)


@query("SELECT event_type AS kind, max_by(value, event_id) AS value FROM events GROUP BY 1")
def gauge_latest(spark, sf_dir):
    points = _daily_points(spark, sf_dir, gaugeReadings=[{"name": "g", "dataKey": "value"}])
    series = points.withColumn("series", series_text(F.col("attrs")))
    newest = latest_gauges(series.withColumn("kind_attr", F.col("attrs")["kind"]), ["kind_attr", "series"])
    return newest.select(F.col("kind_attr").alias("kind"), "value")


@query(
    "WITH l AS (SELECT l_returnflag AS flag, l_linestatus AS status, count(*) AS n, sum(l_quantity) AS q, "
    "sum(l_extendedprice) AS p, count(*) FILTER (l_extendedprice <= 20000) AS b0, "
    "count(*) FILTER (l_extendedprice > 20000 AND l_extendedprice <= 50000) AS b1, "
    "count(*) FILTER (l_extendedprice > 50000) AS b2, max(l_discount) AS d FROM lineitem GROUP BY 1, 2) "
    "SELECT 'lines_total' AS metric, 'counter' AS kind, '1' AS unit, flag, status, CAST(n AS DOUBLE) AS value, "
    "CAST(NULL AS BIGINT) AS count, CAST(NULL AS DOUBLE) AS sum, CAST(NULL AS BIGINT) AS b0, "
    "CAST(NULL AS BIGINT) AS b1, CAST(NULL AS BIGINT) AS b2 FROM l "
    "UNION ALL SELECT 'quantity_total', 'counter', 'items', flag, status, round(q, 2), NULL, NULL, NULL, NULL, NULL FROM l "
    "UNION ALL SELECT 'rate', 'gauge', '1', flag, status, 0.5, NULL, NULL, NULL, NULL, NULL FROM l "
    "UNION ALL SELECT 'price', 'histogram', '1', flag, status, NULL, n, round(p, 2), b0, b1, b2 FROM l"
)
def all_metrics(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem")
    position = F.col("l_orderkey") * 8 + F.col("l_linenumber")
    config = spec(
        attributes=[{"name": "flag", "dataKey": "l_returnflag"}, {"name": "status", "dataKey": "l_linestatus"}],
        counterReadings=[
            {"name": "lines_total"},
            {"name": "quantity_total", "dataKey": "l_quantity", "unit": "items"},
        ],
        gaugeReadings=[{"name": "rate", "fixedValue": 0.5}],
        histogramReadings=[{"name": "price", "dataKey": "l_extendedprice", "buckets": [20000, 50000]}],
    )
    points = metric_points(typed_records(rows, "events", order_by=position), config)
    return points.select(
        "metric", "kind", "unit", _attr("flag"), _attr("status"), F.round("value", 2).alias("value"),
        "count", F.round("sum", 2).alias("sum"), *_buckets_or_null(3),
    )


def _buckets_or_null(n: int):
    return [F.try_element_at("bucket_counts", F.lit(i + 1)).alias(f"b{i}") for i in range(n)]


STATUS = {
    "name": "event_type",
    "error": {"value": "error"},
    "warning": {"value": ["signup", "click"], "matchType": "in"},
    "info": {"value": "view"},
}

_SEVERITY = (
    "SELECT event_id, CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'signup' THEN 'WARNING' WHEN 'click' "
    "THEN 'WARNING' ELSE 'INFO' END AS severity_text, CAST(CASE event_type WHEN 'error' THEN 17 WHEN 'signup' "
    "THEN 13 WHEN 'click' THEN 13 ELSE 9 END AS INTEGER) AS severity_number, event_type AS kind FROM events"
)


@query(_SEVERITY)
def log_severity(spark, sf_dir):
    config = spec(dataKey="data.records", logStatusField=STATUS, attributes=BY_TYPE)
    records = selected_records(extract_selected(event_pages(spark, sf_dir), config))
    rows = log_records(records, config)
    event_id = F.get_json_object("body", "$.record.event_id").cast("bigint")
    return rows.select(event_id.alias("event_id"), "severity_text", "severity_number", _attr("kind"))


@query(
    "SELECT event_id, event_type AS kind, '{\"source\":\"events\",\"record\":{\"event_id\":' || event_id || "
    "',\"event_type\":\"' || event_type || '\",\"user_id\":' || user_id || '}}' AS body FROM events"
)
def log_body(spark, sf_dir):
    rows = events(spark, sf_dir).select("event_id", "user_id", "event_type")
    records = typed_records(rows, "events", order_by="event_id")
    logs = log_records(records, spec(attributes=BY_TYPE))
    event_id = F.get_json_object("body", "$.record.event_id").cast("bigint")
    return logs.select(event_id.alias("event_id"), _attr("kind"), "body")


@query("SELECT 'orders' AS source, count(*) AS n FROM orders")
def log_switch(spark, sf_dir):
    """Two sources, of which only one writes log rows."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority")
    on = log_records(typed_records(orders, "orders", order_by="o_orderkey"), spec(name="orders"))
    off = log_records(event_records(spark, sf_dir), spec(emitLogs=False))
    return on.unionByName(off).groupBy("source").agg(F.count("*").alias("n"))
