"""Monitoring with events as scrape runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from driver_queries import query
from driver_queries.inputs import event_records, events, spec
from payload_metrics.operators.metrics import metric_points
from payload_metrics.plans import monitor

HOUR = 3600


def _runs(spark, sf_dir):
    """One run per event; its value is the duration, ``k`` the records it saw."""
    rows = events(spark, sf_dir)
    k = F.col("props.k")
    end = F.unix_micros("ts") + F.round(F.col("value") * 1_000_000).cast("bigint")
    return rows.select(
        F.concat(F.lit("user-"), F.col("user_id").cast("string")).alias("source"),
        F.col("event_id").cast("string").alias("scrape_id"),
        F.when(k % 2 == 0, "range").otherwise("instant").alias("api_type"),
        F.when(F.col("event_type") == "error", "error").otherwise("success").alias("status"),
        F.col("ts").alias("started_at"),
        F.timestamp_micros(end).alias("ended_at"),
        (k - k % 3).alias("records"),
        (k % 3).alias("hits"),
        (k - k % 3).alias("misses"),
        k.alias("total"),
        "event_id",
    )


_RUNS = """(SELECT event_id, 'user-' || user_id AS source, CAST(event_id AS VARCHAR) AS scrape_id,
  CASE WHEN k % 2 = 0 THEN 'range' ELSE 'instant' END AS api_type,
  CASE WHEN event_type = 'error' THEN 'error' ELSE 'success' END AS status,
  ts AS started_at, ts + to_microseconds(CAST(round(value * 1000000) AS BIGINT)) AS ended_at, value AS duration,
  k - k % 3 AS records, k % 3 AS hits, k - k % 3 AS misses, k AS total,
  CASE WHEN k > 0 THEN (k % 3) / k ELSE 0.0 END AS hit_rate
  FROM (SELECT *, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events))"""

_ATTRS = ("source", "status", "api_type")


def _attr(name):
    return F.col("attrs")[name].alias(name)


def _value(metric, name):
    return F.sum(F.when(F.col("metric") == metric, F.col("value"))).alias(name)


@query(
    "SELECT source, status, api_type, CAST(count(*) AS DOUBLE) AS runs, CAST(sum(records) AS DOUBLE) AS records, "
    "count(*) AS n, round(sum(duration), 2) AS duration, count(*) FILTER (duration <= 10) AS le_10, "
    f"count(*) FILTER (duration <= 60) AS le_60 FROM {_RUNS} GROUP BY 1, 2, 3"
)
def self_runs(spark, sf_dir):
    points = monitor.run_points(_runs(spark, sf_dir))
    add = lambda a, b: a + b
    zero = F.lit(0).cast("bigint")
    return points.groupBy(*[_attr(a) for a in _ATTRS]).agg(
        _value("scraper_runs_total", "runs"),
        _value("scraper_records_emitted_total", "records"),
        F.sum("count").alias("n"),
        F.round(F.sum("sum"), 2).alias("duration"),
        F.sum(F.aggregate(F.slice("bucket_counts", 1, 3), zero, add)).alias("le_10"),
        F.sum(F.aggregate(F.slice("bucket_counts", 1, 5), zero, add)).alias("le_60"),
    )


@query(
    "SELECT source, status, api_type, max_by(duration, ended_at) AS last_duration, "
    f"CAST(max_by(records, ended_at) AS DOUBLE) AS last_records FROM {_RUNS} GROUP BY 1, 2, 3"
)
def self_last(spark, sf_dir):
    points = monitor.run_points(_runs(spark, sf_dir))
    return points.groupBy(*[_attr(a) for a in _ATTRS]).agg(
        _value("scraper_last_run_duration_seconds", "last_duration"),
        _value("scraper_last_records_emitted", "last_records"),
    )


@query(
    "SELECT source, api_type, CAST(sum(hits) AS DOUBLE) AS hits, CAST(sum(misses) AS DOUBLE) AS misses, "
    "CAST(sum(total) AS DOUBLE) AS total, round(max_by(hit_rate, ended_at), 6) AS hit_rate "
    f"FROM {_RUNS} GROUP BY 1, 2"
)
def self_dedupe_rate(spark, sf_dir):
    points = monitor.dedupe_points(_runs(spark, sf_dir))
    return points.groupBy(_attr("source"), _attr("api_type")).agg(
        _value("scraper_dedupe_hits_total", "hits"),
        _value("scraper_dedupe_misses_total", "misses"),
        _value("scraper_dedupe_total", "total"),
        F.round(_value("scraper_dedupe_hit_rate", "hit_rate"), 6).alias("hit_rate"),
    )


def _cleanups(spark, sf_dir):
    """Runs as clean-up jobs; failed ones do not know what they removed."""
    job = F.when(F.col("api_type") == "range", "fingerprint_cleanup").otherwise("orphan_cleanup")
    items = F.when(F.col("status") == "success", F.col("records"))
    return _runs(spark, sf_dir).select(
        job.alias("job"), F.lit("table").alias("backend"), "started_at", "ended_at", items.alias("items")
    )


@query(
    "SELECT CASE WHEN api_type = 'range' THEN 'fingerprint_cleanup' ELSE 'orphan_cleanup' END AS job, "
    "count(*) AS n, round(sum(duration), 2) AS duration, max_by(duration, ended_at) AS last_duration, "
    "CAST(sum(records) FILTER (status = 'success') AS DOUBLE) AS items, "
    "CAST(max_by(records, ended_at) FILTER (status = 'success') AS DOUBLE) AS last_items "
    f"FROM {_RUNS} GROUP BY 1"
)
def self_cleanup(spark, sf_dir):
    points = monitor.cleanup_points(_cleanups(spark, sf_dir))
    return points.groupBy(_attr("job")).agg(
        F.sum("count").alias("n"),
        F.round(F.sum("sum"), 2).alias("duration"),
        _value("scraper_cleanup_last_duration_seconds", "last_duration"),
        _value("scraper_cleanup_items_total", "items"),
        _value("scraper_cleanup_last_items", "last_items"),
    )


@query(
    "SELECT scrape_id, CASE status WHEN 'success' THEN 'INFO' ELSE 'ERROR' END AS severity_text, "
    "CAST(CASE status WHEN 'success' THEN 9 ELSE 17 END AS INTEGER) AS severity_number, source, records "
    f"FROM {_RUNS}"
)
def self_log(spark, sf_dir):
    logs = monitor.self_logs(_runs(spark, sf_dir))
    return logs.select(
        "scrape_id",
        "severity_text",
        "severity_number",
        F.get_json_object("body", "$.source").alias("source"),
        F.get_json_object("body", "$.record_count").cast("bigint").alias("records"),
    )


def _window(column, seconds):
    return f"CAST(floor(epoch({column}) / {seconds}) AS BIGINT) * {seconds}"


def _start(df, *columns):
    return df.select(F.unix_seconds("window_start").alias("window_start"), *columns)


@query(
    f"SELECT {_window('ts', 300)} AS window_start, event_type AS kind, round(sum(value) / 300, 6) AS rate "
    "FROM events GROUP BY 1, 2"
)
def counter_rate(spark, sf_dir):
    config = spec(
        attributes=[{"name": "kind", "dataKey": "event_type"}],
        counterReadings=[{"name": "c", "dataKey": "value"}],
    )
    points = metric_points(event_records(spark, sf_dir), config, every="1 minute")
    rate = monitor.counter_rate(points.withColumn("kind", F.col("attrs")["kind"]), ["kind"], 300)
    return _start(rate, "kind", F.round("rate", 6).alias("rate"))


@query(
    f"SELECT {_window('ended_at', 86400)} AS window_start, source, "
    f"round(count(*) FILTER (status = 'success') / count(*), 6) AS ratio FROM {_RUNS} GROUP BY 1, 2"
)
def success_ratio(spark, sf_dir):
    ratio = monitor.success_ratio(_runs(spark, sf_dir), 86400)
    return _start(ratio, "source", F.round("ratio", 6).alias("ratio"))


@query(
    f"SELECT {_window('ended_at', 86400)} AS window_start, source, round(sum(duration) / count(*), 6) AS avg_duration "
    f"FROM {_RUNS} GROUP BY 1, 2"
)
def avg_duration(spark, sf_dir):
    mean = monitor.average_duration(_runs(spark, sf_dir), 86400)
    return _start(mean, "source", F.round("avg_duration", 6).alias("avg_duration"))


@query(
    f"SELECT {_window('ended_at', HOUR)} AS window_start, source, round(sum(records) / {HOUR}, 8) AS per_second "
    f"FROM {_RUNS} GROUP BY 1, 2"
)
def records_throughput(spark, sf_dir):
    rate = monitor.records_throughput(_runs(spark, sf_dir), HOUR)
    return _start(rate, "source", F.round("per_second", 8).alias("per_second"))


@query(
    "SELECT source, round(avg(h), 6) AS avg_hit_rate FROM (SELECT source, api_type, "
    f"max_by(hit_rate, ended_at) AS h FROM {_RUNS} GROUP BY 1, 2) GROUP BY 1"
)
def avg_hit_rate(spark, sf_dir):
    rate = monitor.average_hit_rate(_runs(spark, sf_dir))
    return rate.select("source", F.round("avg_hit_rate", 6).alias("avg_hit_rate"))


BOUNDS = (10.0, 50.0, 100.0)


def _quantile_sql(q: float, total: str, counts: list[str], bounds=BOUNDS) -> str:
    """The interpolation rule written out over cumulative bucket counts."""
    out, before, lower = "CASE", "0", 0.0
    for count, upper in zip(counts, bounds):
        out += (
            f" WHEN {count} >= {q} * {total} THEN {lower} + {upper - lower} * "
            f"CASE WHEN {count} > {before} THEN ({q} * {total} - {before}) / ({count} - {before}) ELSE 1.0 END"
        )
        before, lower = count, upper
    return f"{out} ELSE {bounds[-1]} END"


@query(
    f"SELECT kind, round({_quantile_sql(0.5, 'n', ['b0', 'b1', 'b2'])}, 6) AS p50, "
    f"round({_quantile_sql(0.95, 'n', ['b0', 'b1', 'b2'])}, 6) AS p95, "
    f"round({_quantile_sql(0.99, 'n', ['b0', 'b1', 'b2'])}, 6) AS p99 FROM ("
    "SELECT event_type AS kind, count(*) AS n, count(*) FILTER (value <= 10) AS b0, "
    "count(*) FILTER (value <= 50) AS b1, count(*) FILTER (value <= 100) AS b2 FROM events GROUP BY 1)"
)
def hist_quantile(spark, sf_dir):
    config = spec(
        attributes=[{"name": "kind", "dataKey": "event_type"}],
        histogramReadings=[{"name": "h", "dataKey": "value", "buckets": list(BOUNDS)}],
    )
    points = metric_points(event_records(spark, sf_dir), config, every="1 hour")
    keyed = points.withColumn("kind_attr", F.col("attrs")["kind"])
    out = monitor.histogram_quantiles(keyed, ["kind_attr"], BOUNDS, {"p50": 0.5, "p95": 0.95, "p99": 0.99})
    return out.select(
        F.col("kind_attr").alias("kind"), *[F.round(p, 6).alias(p) for p in ("p50", "p95", "p99")]
    )


@query(
    f"SELECT kind, round({_quantile_sql(0.5, 'n', ['b0', 'b1', 'b2'])}, 6) AS p50, "
    f"round({_quantile_sql(0.99, 'n', ['b0', 'b1', 'b2'])}, 6) AS p99 FROM ("
    "SELECT event_type AS kind, count(*) AS n, count(*) FILTER (value <= 10) AS b0, "
    "count(*) FILTER (value <= 50) AS b1, count(*) FILTER (value <= 100) AS b2 FROM events GROUP BY 1)"
)
def hist_quantile_mixed(spark, sf_dir):
    """Two sources with bounds of their own, merged at the edges they share."""
    parts = []
    for name, rest, bounds in (("even", 0, [5, *BOUNDS, 200]), ("odd", 1, [*BOUNDS, 150])):
        config = spec(
            name=name,
            attributes=[{"name": "kind", "dataKey": "event_type"}],
            histogramReadings=[{"name": "h", "dataKey": "value", "buckets": bounds}],
        )
        records = event_records(spark, sf_dir).where(F.col("record.event_id") % 2 == rest)
        parts.append(metric_points(records, config, every="1 hour"))
    keyed = parts[0].unionByName(parts[1]).select(F.col("attrs")["kind"].alias("kind"), "bounds", "bucket_counts")
    out = monitor.histogram_quantiles(keyed, ["kind"], None, {"p50": 0.5, "p99": 0.99})
    return out.select("kind", F.round("p50", 6).alias("p50"), F.round("p99", 6).alias("p99"))


NOW = 1706745600  # 2024-02-01T00:00:00Z


def _grid_sql(sums: str, names: list[str], seconds: int, end: str | int | None = None, step: int = HOUR) -> str:
    """Hourly rows per source with trailing sums, from its first run until they are empty, or to ``end``."""
    rolled = ", ".join(
        f"CAST(sum(coalesce({n}, 0)) OVER (PARTITION BY source ORDER BY step_end RANGE BETWEEN {seconds - step} PRECEDING "
        f"AND CURRENT ROW) AS BIGINT) AS {n}"
        for n in names
    )
    end = f"max(step_end) + {seconds}" if end is None else end
    return (
        f"(SELECT source, step_end, {rolled} FROM (SELECT source, unnest(generate_series(min(step_end), {end}, {step})) AS step_end "
        f"FROM (SELECT source, {_window('ended_at', step)} + {step} AS step_end FROM {_RUNS}) GROUP BY source) "
        f"LEFT JOIN (SELECT source, {_window('ended_at', step)} + {step} AS step_end, {sums} FROM {_RUNS} GROUP BY 1, 2) "
        "USING (source, step_end))"
    )


def _steps_sql(grid: str, condition: str, hold: int, columns: str, step: int = HOUR) -> str:
    """Every row of ``grid``, whether the condition has held there for ``hold`` seconds, and while it
    has, since when, from when it fires and until when, NULL if to the end of the grid."""
    frame = f"(PARTITION BY source ORDER BY step_end RANGE BETWEEN {hold} PRECEDING AND CURRENT ROW)"
    return (
        f"SELECT source, step_end, {columns}, firing, CASE WHEN firing THEN min(step_end) OVER s - {hold} END AS since, "
        "CASE WHEN firing THEN min(step_end) OVER s END AS fires_from, "
        f"CASE WHEN firing AND max(step_end) OVER s < last THEN max(step_end) OVER s + {step} END AS until "
        "FROM (SELECT *, max(step_end) OVER (PARTITION BY source) AS last, "
        f"step_end - {step} * row_number() OVER (PARTITION BY source, firing ORDER BY step_end) AS island FROM ("
        f"SELECT *, bool_and(coalesce({condition}, false)) OVER w AND step_end - min(step_end) OVER w >= {hold} "
        f"AS firing FROM {grid} WINDOW w AS {frame})) WINDOW s AS (PARTITION BY source, firing, island)"
    )


_RUN_GRID = _grid_sql("count(*) AS runs, count(*) FILTER (status = 'error') AS errors", ["runs", "errors"], 24 * HOUR)


@query(
    "SELECT source, step_end AS at, lead(step_end) OVER (PARTITION BY source ORDER BY step_end) AS until, runs, errors FROM ("
    "SELECT *, sum(n) OVER (PARTITION BY source ORDER BY step_end RANGE BETWEEN CURRENT ROW AND CURRENT ROW) AS here, "
    f"sum(n) OVER (PARTITION BY source ORDER BY step_end RANGE BETWEEN {24 * HOUR} PRECEDING AND {24 * HOUR} PRECEDING) AS gone "
    f"FROM {_RUN_GRID} LEFT JOIN (SELECT source, {_window('ended_at', HOUR)} + {HOUR} AS step_end, count(*) AS n FROM {_RUNS} "
    "GROUP BY 1, 2) USING (source, step_end)) WHERE here > 0 OR gone > 0"
)
def run_changes(spark, sf_dir):
    """Runs and failures of the last day as of every hour, one row per change."""
    return monitor.run_changes(_runs(spark, sf_dir), seconds=24 * HOUR, step=HOUR)


@query(_steps_sql(_RUN_GRID, "CASE WHEN runs > 0 THEN errors / runs END > 0.1", 12 * HOUR, "runs, errors"))
def alert_error_ratio(spark, sf_dir):
    """Runs, failures and the state of the alert at every hour."""
    return monitor.alert_error_ratio(_runs(spark, sf_dir), seconds=24 * HOUR, hold=12 * HOUR, step=HOUR, every_step=True)


_SLOW_COUNTS = ["b0", "b1", "b2"]


@query(
    _steps_sql(
        "(SELECT *, CASE WHEN n > 0 THEN "
        + _quantile_sql(0.95, "n", _SLOW_COUNTS)
        + " END AS p FROM "
        + _grid_sql(
            "count(*) AS n, count(*) FILTER (duration <= 10) AS b0, count(*) FILTER (duration <= 50) AS b1, "
            "count(*) FILTER (duration <= 100) AS b2",
            ["n", *_SLOW_COUNTS],
            48 * HOUR,
        )
        + ")",
        "p > 60",
        12 * HOUR,
        "round(p, 6) AS p",
    )
)
def alert_slow(spark, sf_dir):
    """The quantile and the state of the alert at every hour."""
    slow = monitor.alert_slow(
        _runs(spark, sf_dir), bounds=BOUNDS, seconds=48 * HOUR, hold=12 * HOUR, step=HOUR, every_step=True
    )
    return slow.withColumn("p", F.round("p", 6))


@query(
    _steps_sql(
        _grid_sql(
            "CAST(sum(misses) AS BIGINT) AS misses", ["misses"], 3 * HOUR, f"greatest(max(step_end) + {3 * HOUR}, {NOW})"
        ),
        "misses = 0",
        6 * HOUR,
        "misses",
    )
)
def alert_stalled(spark, sf_dir):
    """New records and the state of the alert at every hour, up to ``NOW`` at least. The sources that
    are still stalled have no end."""
    return monitor.alert_stalled(
        _runs(spark, sf_dir), seconds=3 * HOUR, hold=6 * HOUR, step=HOUR, now=NOW, every_step=True
    )


@query(
    f"SELECT {_window('ended_at', 600)} AS window_start, CASE WHEN api_type = 'range' THEN 'fingerprint_cleanup' "
    "ELSE 'orphan_cleanup' END AS job, round(sum(records) FILTER (status = 'success') / 600, 6) AS rate "
    f"FROM {_RUNS} GROUP BY 1, 2"
)
def cleanup_rate(spark, sf_dir):
    """Items per second, from the item counter of the clean-up points. Windows whose clean-ups all do
    not know their items have no such point but one of the durations, and a rate of NULL."""
    points = monitor.cleanup_points(_cleanups(spark, sf_dir), every="10 minutes")
    counter = F.col("metric") == "scraper_cleanup_items_total"
    points = points.where(counter | (F.col("metric") == "scraper_cleanup_duration_seconds"))
    items = points.select(F.col("attrs")["job"].alias("job"), "ts", F.when(counter, F.col("value")).alias("value"))
    return _start(monitor.counter_rate(items, ["job"], 600), "job", F.round("rate", 6).alias("rate"))


@query(
    f"SELECT {_window('ended_at', 3600)} AS window_start, CASE WHEN api_type = 'range' THEN 'fingerprint_cleanup' "
    f"ELSE 'orphan_cleanup' END AS job, round(count(*) / 3600, 6) AS rate FROM {_RUNS} GROUP BY 1, 2"
)
def cleanup_frequency(spark, sf_dir):
    """Clean-ups per second and hour, from the duration histogram of the clean-up points."""
    points = monitor.cleanup_points(_cleanups(spark, sf_dir), every="1 hour")
    counted = points.where(F.col("metric") == "scraper_cleanup_duration_seconds")
    counted = counted.select(F.col("attrs")["job"].alias("job"), "ts", F.col("count").alias("value"))
    return _start(monitor.counter_rate(counted, ["job"], 3600), "job", F.round("rate", 6).alias("rate"))


@query(
    "SELECT 'by_user' AS metric, count(DISTINCT (event_type, user_id)) AS series FROM events "
)
def cardinality(spark, sf_dir):
    config = spec(
        attributes=[{"name": "kind", "dataKey": "event_type"}, {"name": "user", "dataKey": "user_id"}],
        counterReadings=[{"name": "by_user"}],
    )
    return monitor.cardinality(metric_points(event_records(spark, sf_dir), config, every="1 day"))


@query(
    "SELECT 'by_user' AS metric, count(DISTINCT CAST(ts AS DATE)) AS days, TRUE AS within_error FROM events"
)
def cardinality_sketch(spark, sf_dir):
    """Series over all days from one sketch per day; three standard errors of the exact number."""
    config = spec(
        attributes=[{"name": "kind", "dataKey": "event_type"}, {"name": "user", "dataKey": "user_id"}],
        counterReadings=[{"name": "by_user"}],
    )
    points = metric_points(event_records(spark, sf_dir), config, every="1 day")
    estimated = monitor.sketched_cardinality(monitor.daily_series_sketches(points))
    exact = monitor.cardinality(points).withColumnRenamed("series", "exact")
    error = 3 * 1.04 / 2 ** (monitor.SKETCH_LOG2_SIZE / 2)
    within = F.abs(F.col("series") - F.col("exact")) <= error * F.col("exact")
    return estimated.join(exact, "metric").select("metric", "days", within.alias("within_error"))
