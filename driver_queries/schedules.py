"""Window planning with customers and suppliers as sources, and run state with events as runs."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import functions as F

from driver_queries import query
from driver_queries.inputs import events, spec, table
from payload_metrics.operators import windows as w

NOW = datetime(2024, 2, 1, tzinfo=timezone.utc)
TEXT = "yyyy-MM-dd HH:mm:ss"
_TEXT = "'%Y-%m-%d %H:%M:%S'"


def _sources(spark, sf_dir):
    """Customers and suppliers as configured sources; the settings vary with nation and segment."""
    customers = table(spark, sf_dir, "customer").select(
        F.col("c_name").alias("source"), F.col("c_nationkey").cast("bigint").alias("n"), F.col("c_mktsegment").alias("segment")
    )
    suppliers = table(spark, sf_dir, "supplier").select(
        F.col("s_name").alias("source"), F.col("s_nationkey").cast("bigint").alias("n"), F.lit("BUILDING").alias("segment")
    )
    n = F.col("n")
    is_range = F.col("segment") != "FURNITURE"
    return customers.unionByName(suppliers).select(
        "source",
        F.when(is_range, "range").otherwise("instant").alias("api_type"),
        ((n + 1) * 3600).alias("frequency_seconds"),
        F.when(is_range & (F.col("segment") != "MACHINERY"), (n + 1) * 5 * 86400).alias("slice_seconds"),
        F.when(n > 20, F.lit(datetime(2024, 1, 1, tzinfo=timezone.utc)).cast("timestamp")).alias("first_scrape_start"),
        (n % 2 == 0).alias("run_first_scrape"),
        F.when(n > 12, "hours").otherwise("minutes").alias("range_unit"),
        F.when(n % 3 == 0, "7").otherwise("from-config").alias("range_value"),
        (n % 5 == 0).alias("take_negative"),
        (n % 7 == 0).alias("has_bounds"),
    )


_PARTIES = """(SELECT c_name AS source, c_nationkey AS n, c_mktsegment AS segment FROM customer
  UNION ALL SELECT s_name, s_nationkey, 'BUILDING' FROM supplier)"""

_SOURCES = f"""(SELECT source, n,
  CASE WHEN segment <> 'FURNITURE' THEN 'range' ELSE 'instant' END AS api_type,
  (n + 1) * 3600 AS freq,
  CASE WHEN segment NOT IN ('FURNITURE', 'MACHINERY') THEN (n + 1) * 5 * 86400 END AS slice,
  CASE WHEN n > 20 THEN TIMESTAMP '2024-01-01' END AS first_start,
  n % 2 = 0 AS run_first FROM {_PARTIES})"""


def _success(spark, sf_dir):
    """The newest order of a customer as its last successful run; suppliers have none."""
    orders = table(spark, sf_dir, "orders").withColumn("o_orderdate", F.col("o_orderdate").cast("timestamp"))
    runs = orders.join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return w.last_success(runs.select(F.col("c_name").alias("source"), F.col("o_orderdate").alias("started_at")))


_SUCCESS = """(SELECT c_name AS source, max(o_orderdate) AS last_success FROM orders JOIN customer
  ON o_custkey = c_custkey GROUP BY 1)"""

_DUE = f"""(SELECT s.*, CASE WHEN api_type = 'range' THEN
  coalesce(last_success, first_start, TIMESTAMP '2024-02-01' - to_seconds(freq)) END AS a,
  CASE WHEN api_type = 'range' THEN TIMESTAMP '2024-02-01' END AS b
  FROM {_SOURCES} s LEFT JOIN {_SUCCESS} t USING (source) WHERE last_success IS NOT NULL OR run_first)"""


def _text(columns):
    return [F.date_format(c, TEXT).alias(c) for c in columns]


@query(
    f"SELECT source, CAST(i AS INTEGER) AS window_id, strftime(a + to_seconds(i * slice), {_TEXT}) AS window_start, "
    f"strftime(least(a + to_seconds((i + 1) * slice), b), {_TEXT}) AS window_end FROM ("
    "SELECT source, a, b, slice, unnest(generate_series(0, CAST(ceil(epoch(b - a) / slice) AS BIGINT) - 1)) AS i "
    f"FROM {_DUE} WHERE slice IS NOT NULL AND a < b) "
    f"UNION ALL SELECT source, 0, strftime(a, {_TEXT}), strftime(b, {_TEXT}) FROM {_DUE} WHERE slice IS NULL"
)
def window_plan(spark, sf_dir):
    plan = w.plan_windows(_sources(spark, sf_dir), _success(spark, sf_dir), NOW)
    return plan.select("source", "window_id", *_text(["window_start", "window_end"]))


@query(
    "SELECT o_orderkey, CAST(i AS INTEGER) AS window_id, "
    f"strftime(o_orderdate + to_days(CAST(i AS INTEGER) * 300), {_TEXT}) AS window_start, "
    f"strftime(least(o_orderdate + to_days(CAST(i AS INTEGER) * 300 + 300), TIMESTAMP '2002-01-01'), {_TEXT}) AS window_end "
    "FROM (SELECT o_orderkey, o_orderdate, unnest(generate_series(0, CAST(ceil(date_diff('day', o_orderdate, "
    "TIMESTAMP '2002-01-01') / 300) AS BIGINT) - 1)) AS i FROM orders WHERE o_orderdate < TIMESTAMP '2002-01-01')"
)
def window_slices(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    ranges = orders.select(
        F.col("o_orderkey").alias("source"),
        F.col("o_orderdate").cast("timestamp").alias("range_start"),
        F.lit(datetime(2002, 1, 1, tzinfo=timezone.utc)).cast("timestamp").alias("range_end"),
        F.lit(300 * 86400).cast("bigint").alias("slice_seconds"),
    )
    sliced = w.slice_range(ranges)
    return sliced.select(F.col("source").alias("o_orderkey"), "window_id", *_text(["window_start", "window_end"]))


@query(
    "SELECT o_orderkey, strftime(o_orderdate, '%d.%m.%y %H:%M') AS start_text, "
    "CAST(CAST(epoch(o_orderdate) AS BIGINT) AS VARCHAR) AS epoch_text, "
    "strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') || '+00:00' AS iso_text FROM orders"
)
def window_texts(spark, sf_dir):
    at = F.col("o_orderdate").cast("timestamp")
    texts = table(spark, sf_dir, "orders").select("o_orderkey", at.alias("window_start"), at.alias("window_end"))
    for name, fmt in (("start_text", "%d.%m.%y %H:%M"), ("epoch_text", "%s"), ("iso_text", "%Y-%m-%dT%H:%M:%S+00:00")):
        keys = {"startKey": "from", "endKey": "to", "dateFormat": fmt}
        source = spec(scrape={"type": "range", "rangeKeys": keys})
        written = w.window_texts(texts, source)
        texts = written.select(*texts.columns, F.col("end_text" if name == "iso_text" else "start_text").alias(f"_{name}"))
    return texts.select("o_orderkey", *[F.col(f"_{n}").alias(n) for n in ("start_text", "epoch_text", "iso_text")])


@query(
    "SELECT source, CASE WHEN n > 12 THEN 'hours' ELSE 'minutes' END AS unit, "
    "CASE WHEN n % 3 = 0 THEN '7' ELSE CAST((CASE WHEN n % 5 = 0 THEN -1 ELSE 1 END) * "
    "((n + 1) * 3600 // (CASE WHEN n > 12 THEN 3600 ELSE 60 END)) AS VARCHAR) END AS value "
    f"FROM {_PARTIES} WHERE segment <> 'FURNITURE' AND n % 7 <> 0"
)
def relative_window(spark, sf_dir):
    return w.relative_values(_sources(spark, sf_dir))


@query(f"SELECT source, strftime(last_success, {_TEXT}) AS last_success FROM {_SUCCESS}")
def last_success(spark, sf_dir):
    return _success(spark, sf_dir).select("source", *_text(["last_success"]))


@query(
    f"SELECT source, api_type, 'success' AS status, CAST(0 AS BIGINT) AS records FROM {_SOURCES} s "
    f"WHERE NOT run_first AND source NOT IN (SELECT source FROM {_SUCCESS})"
)
def first_run_skip(spark, sf_dir):
    rows = w.first_run_rows(_sources(spark, sf_dir), _success(spark, sf_dir), NOW)
    return rows.select("source", "api_type", "status", "records")


@query(
    "SELECT CAST(user_id AS VARCHAR) AS source, strftime(ts, '%Y-%m-%d') AS scrape_id, count(*) AS windows, "
    "count(*) FILTER (event_type = 'error') AS failed_windows, "
    "CASE WHEN bool_or(event_type = 'error') THEN 'error' ELSE 'success' END AS status FROM events GROUP BY 1, 2"
)
def run_outcome(spark, sf_dir):
    attempts = events(spark, sf_dir).select(
        F.col("user_id").cast("string").alias("source"),
        F.date_format("ts", "yyyy-MM-dd").alias("scrape_id"),
        (F.col("event_type") == "error").alias("errored"),
    )
    return w.run_outcome(attempts)
