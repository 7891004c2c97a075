"""Monitoring over ``scrape_runs``, ``cleanup_runs`` and metric points.

Rates and quantiles follow the public Prometheus definitions, on delta points.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from payload_metrics.operators.extract import typed_records
from payload_metrics.operators.logs import severity_number
from payload_metrics.operators.metrics import metric_points, series_text
from payload_metrics.spec import SourceSpec

# Names of the self-monitoring metrics and their attributes.
RUN_SPEC = SourceSpec.from_dict(
    {
        "name": "scraper.self",
        "frequency": "1min",
        "scrape": {"type": "instant"},
        "attributes": [
            {"name": "source", "dataKey": "source"},
            {"name": "status", "dataKey": "status"},
            {"name": "api_type", "dataKey": "api_type"},
        ],
        "counterReadings": [
            {"name": "scraper_runs_total"},
            {"name": "scraper_records_emitted_total", "dataKey": "records"},
        ],
        "gaugeReadings": [
            {"name": "scraper_last_run_duration_seconds", "dataKey": "duration", "unit": "s"},
            {"name": "scraper_last_records_emitted", "dataKey": "records"},
        ],
        "histogramReadings": [
            {
                "name": "scraper_run_duration_seconds",
                "dataKey": "duration",
                "unit": "s",
                "buckets": [1, 5, 10, 30, 60, 120, 300, 600],
            }
        ],
    }
)
DEDUPE_SPEC = SourceSpec.from_dict(
    {
        "name": "scraper.self",
        "frequency": "1min",
        "scrape": {"type": "instant"},
        "attributes": [
            {"name": "source", "dataKey": "source"},
            {"name": "api_type", "dataKey": "api_type"},
        ],
        "counterReadings": [
            {"name": "scraper_dedupe_hits_total", "dataKey": "hits"},
            {"name": "scraper_dedupe_misses_total", "dataKey": "misses"},
            {"name": "scraper_dedupe_total", "dataKey": "total"},
        ],
        "gaugeReadings": [{"name": "scraper_dedupe_hit_rate", "dataKey": "hit_rate"}],
    }
)
CLEANUP_SPEC = SourceSpec.from_dict(
    {
        "name": "scraper.self",
        "frequency": "1min",
        "scrape": {"type": "instant"},
        "attributes": [
            {"name": "job", "dataKey": "job"},
            {"name": "backend", "dataKey": "backend"},
        ],
        "counterReadings": [{"name": "scraper_cleanup_items_total", "dataKey": "known_items"}],
        "gaugeReadings": [
            {"name": "scraper_cleanup_last_duration_seconds", "dataKey": "duration", "unit": "s"},
            {"name": "scraper_cleanup_last_items", "dataKey": "items"},
        ],
        "histogramReadings": [
            {
                "name": "scraper_cleanup_duration_seconds",
                "dataKey": "duration",
                "unit": "s",
                "buckets": [1, 5, 10, 30, 60, 120, 300, 600],
            }
        ],
    }
)


#: Rows of a mergeable sketch of series, as a power of two.
SKETCH_LOG2_SIZE = 12


def run_duration() -> Column:
    return (F.unix_micros("ended_at") - F.unix_micros("started_at")) / 1e6


def run_points(runs: DataFrame) -> DataFrame:
    """Run counter, records counter, duration histogram and last-value gauges."""
    return _self_points(runs.withColumn("duration", run_duration()), RUN_SPEC)


def dedupe_points(runs: DataFrame) -> DataFrame:
    """Hit, miss and total counters, and the newest hit rate (0 when nothing was seen)."""
    return _self_points(runs.withColumn("hit_rate", hit_rate()), DEDUPE_SPEC)


def cleanup_points(cleanups: DataFrame, every: str | None = None) -> DataFrame:
    """The same for clean-ups: ``(job, backend, started_at, ended_at, items)``, in one point per
    series or per window of ``every``.

    A clean-up whose item count is unknown adds nothing to the item counter.
    """
    # Counters ignore negative amounts; a missing one would count as 1.
    known = F.coalesce("items", F.lit(-1))
    return _self_points(cleanups.withColumns({"duration": run_duration(), "known_items": known}), CLEANUP_SPEC, every)


def hit_rate() -> Column:
    return F.when(F.col("total") > 0, F.col("hits") / F.col("total")).otherwise(F.lit(0.0))


def self_logs(runs: DataFrame) -> DataFrame:
    """A log row per run: INFO on success, else ERROR."""
    text = F.when(F.col("status") == "success", "INFO").otherwise("ERROR")
    body = F.struct(
        "source", "status", run_duration().alias("duration_seconds"), F.col("records").alias("record_count")
    )
    return runs.select(
        F.lit(RUN_SPEC.name).alias("source"),
        F.col("ended_at").alias("ts"),
        severity_number(text).alias("severity_number"),
        text.alias("severity_text"),
        F.to_json(body).alias("body"),
        F.create_map(F.lit("component"), F.lit("scraper")).alias("attrs"),
        "scrape_id",
    )


def _self_points(rows: DataFrame, spec: SourceSpec, every: str | None = None) -> DataFrame:
    records = typed_records(
        rows, spec.name, order_by=F.unix_micros("ended_at"), fetched_at=F.col("ended_at")
    )
    return metric_points(records, spec, every=every)


def counter_rate(points: DataFrame, series: list[str], seconds: int = 300) -> DataFrame:
    """Increase per second of each series and tumbling window, from delta ``value``."""
    return _per_window(points, series, seconds).agg((F.sum("value") / seconds).alias("rate"))


def success_ratio(runs: DataFrame, seconds: int = 300) -> DataFrame:
    ratio = F.count_if(F.col("status") == "success") / F.count("*")
    return _per_window(_at_end(runs), ["source"], seconds).agg(ratio.alias("ratio"))


def average_duration(runs: DataFrame, seconds: int = 300) -> DataFrame:
    duration = F.sum(run_duration()) / F.count("*")
    return _per_window(_at_end(runs), ["source"], seconds).agg(duration.alias("avg_duration"))


def records_throughput(runs: DataFrame, seconds: int = 60) -> DataFrame:
    per_second = F.sum("records") / seconds
    return _per_window(_at_end(runs), ["source"], seconds).agg(per_second.alias("per_second"))


def average_hit_rate(runs: DataFrame) -> DataFrame:
    """Newest hit rate of each ``(source, api_type)``, averaged by source."""
    newest = F.max_by(hit_rate(), F.unix_micros("ended_at"))
    series = runs.groupBy("source", "api_type").agg(newest.alias("hit_rate"))
    return series.groupBy("source").agg(F.avg("hit_rate").alias("avg_hit_rate"))


def cardinality(points: DataFrame) -> DataFrame:
    """Number of series per metric."""
    return _series_keys(points).groupBy("metric").agg(F.count_distinct("series").alias("series"))


def approx_cardinality(points: DataFrame, error: float = 0.02) -> DataFrame:
    """The same from a sketch, without shuffling the series."""
    return _series_keys(points).groupBy("metric").agg(F.approx_count_distinct("series", error).alias("series"))


def daily_series_sketches(points: DataFrame, log2_size: int = SKETCH_LOG2_SIZE) -> DataFrame:
    """``(day, metric, sketch)``: a sketch of each day's series, to be kept and merged later. Points
    without a time have no day, and a sketch of their own."""
    keyed = _series_keys(points, F.to_date("ts").alias("day"))
    return keyed.groupBy("day", "metric").agg(F.hll_sketch_agg("series", F.lit(log2_size)).alias("sketch"))


def sketched_cardinality(sketches: DataFrame) -> DataFrame:
    """``(metric, days, series)``: the number of series over all days of ``sketches``, estimated.

    The standard error is ``1.04 / sqrt(2 ** log2_size)`` or less, 1.6 % by default; series that
    several days share count once.
    """
    merged = F.hll_sketch_estimate(F.hll_union_agg("sketch"))
    return sketches.groupBy("metric").agg(F.count("*").alias("days"), merged.alias("series"))


def _series_keys(points: DataFrame, *more: Column) -> DataFrame:
    series = F.concat_ws("|", "source", series_text(F.col("attrs"))).alias("series")
    return points.select("metric", series, *more)


def histogram_quantiles(
    points: DataFrame, series: list[str | Column], bounds: tuple[float, ...] | None, qs: dict[str, float]
) -> DataFrame:
    """Quantiles of merged histogram points, one column per name in ``qs``.

    With ``bounds``, all points have them, and any other point raises an error; bucket counts then
    add up position by position in one plain hash aggregation. Without, every point is taken by its
    own bounds, and the points of a series are merged at the edges all of them have: there the
    number of values below is known exactly. Without a common edge the quantiles are NULL.
    """
    points = points.where(F.col("bucket_counts").isNotNull())
    if bounds is None:
        return _quantiles_at_common_edges(points, series, qs)
    own = F.col("bounds") == F.array(*[F.lit(float(b)) for b in bounds])
    wrong = F.raise_error(F.format_string(f"a point with bounds %s among points with {list(bounds)}", F.to_json("bounds")))
    counts = F.when(own, F.col("bucket_counts")).otherwise(wrong)
    names = [f"_b{i}" for i in range(len(bounds) + 1)]
    sums = [F.sum(F.element_at("_counts", i + 1)).alias(n) for i, n in enumerate(names)]
    merged = points.withColumn("_counts", counts).groupBy(*series).agg(*sums)
    columns = [F.col(n) for n in names]
    return merged.withColumns({k: quantile(columns, bounds, q) for k, q in qs.items()}).drop(*names)


def _quantiles_at_common_edges(points: DataFrame, series: list[str | Column], qs: dict[str, float]) -> DataFrame:
    # Points of equal bounds add up by position first; what is left is bounded by the specs.
    buckets = points.select(*series, "bounds", F.posexplode("bucket_counts").alias("_at", "_n"))
    keys = [name for name in buckets.columns if name not in ("bounds", "_at", "_n")]
    kinds = buckets.groupBy(*keys, "bounds", "_at").agg(F.sum("_n").alias("_n"))
    below = Window.partitionBy(*keys, "bounds").orderBy("_at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    edge = F.coalesce(F.get("bounds", F.col("_at")), F.lit(float("inf"))).alias("edge")
    edges = kinds.select(*keys, edge, F.sum("_n").over(below).alias("_below"))
    edges = edges.groupBy(*keys, "edge").agg(F.sum("_below").alias("below"), F.count("*").alias("_kinds"))
    # Every kind of bounds has the open end, so an edge that all have is met as often.
    all_kinds = F.max("_kinds").over(Window.partitionBy(*keys))
    common = edges.withColumn("_all", all_kinds).where("_kinds = _all")
    listed = common.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("edge", "below"))).alias("_edges"))
    return listed.withColumns({name: _quantile_of_edges(F.col("_edges"), q) for name, q in qs.items()}).drop("_edges")


def _quantile_of_edges(edges: Column, q: float) -> Column:
    """The rule of ``quantile`` on a sorted list ``(edge, below)`` that ends with infinity."""
    if not 0 <= q <= 1:
        raise ValueError("a quantile lies between 0 and 1")
    size = F.size(edges)
    total = F.element_at(edges, -1)["below"]
    rank = F.lit(float(q)) * total
    at = F.size(F.filter(edges, lambda e: e["below"] < rank))
    here, one_less = F.get(edges, at), F.get(edges, at - 1)
    lower, before = F.coalesce(one_less["edge"], F.lit(0.0)), F.coalesce(one_less["below"], F.lit(0))
    inside = here["below"] - before
    share = F.when(inside > 0, (rank - before) / inside).otherwise(F.lit(1.0))
    value = F.when((at == 0) & (here["edge"] <= 0), here["edge"]).otherwise(lower + (here["edge"] - lower) * share)
    return F.when((size > 1) & (total > 0), F.when(at == size - 1, F.get(edges, size - 2)["edge"]).otherwise(value))


def quantile(counts: list[Column], bounds: tuple[float, ...], q: float) -> Column:
    """Linear interpolation inside the bucket that holds rank ``q * total``; NULL if empty.

    A rank in the last, open bucket gives the largest bound.
    """
    if not 0 <= q <= 1:
        raise ValueError("a quantile lies between 0 and 1")
    cumulative, running = [], None
    for n in counts:
        running = n if running is None else running + n
        cumulative.append(running)
    total = cumulative[-1]
    rank = F.lit(float(q)) * total
    out = F.lit(float(bounds[-1]))
    for i in reversed(range(len(bounds))):
        upper = float(bounds[i])
        before = cumulative[i - 1] if i else F.lit(0)
        if i == 0 and upper <= 0:
            inside = F.lit(upper)
        else:
            lower = float(bounds[i - 1]) if i else 0.0
            share = F.when(counts[i] > 0, (rank - before) / counts[i]).otherwise(F.lit(1.0))
            inside = F.lit(lower) + F.lit(upper - lower) * share
        out = F.when(cumulative[i] >= rank, inside).otherwise(out)
    return F.when(total > 0, out)


def change_points(rows: DataFrame, values: dict[str, Column], seconds: int, step: int) -> DataFrame:
    """Sums of ``values`` over the last ``seconds`` as of every ``step``, where they change:
    ``(source, at, until, ...)`` holds at the steps from ``at`` on and before ``until``, in epoch
    seconds; a NULL ``until`` means for ever.

    A row enters the sums at the step after it and leaves them ``seconds`` later, so a source has at
    most two changes per row, and per step; a time without rows costs nothing.
    """
    if seconds <= 0 or seconds % step:
        raise ValueError(f"a window of {seconds} s is no multiple of the step of {step} s")
    enters = (F.floor(F.unix_micros("ts") / (step * 1_000_000)) * step + step).cast("bigint")
    held = {name: F.coalesce(value.cast("bigint"), F.lit(0).cast("bigint")) for name, value in values.items()}
    entry = F.struct(enters.alias("at"), *[value.alias(name) for name, value in held.items()])
    leave = F.struct((enters + seconds).alias("at"), *[(-value).alias(name) for name, value in held.items()])
    moves = rows.select("source", F.explode(F.array(entry, leave)).alias("m")).select("source", "m.*")
    moves = moves.groupBy("source", "at").agg(*[F.sum(name).alias(name) for name in held])
    in_turn = Window.partitionBy("source").orderBy("at")
    so_far = in_turn.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = [F.sum(name).over(so_far).alias(name) for name in held]
    return moves.select("source", "at", F.lead("at").over(in_turn).alias("until"), *sums)


def run_changes(runs: DataFrame, seconds: int = 300, step: int = 60) -> DataFrame:
    """Runs and failed runs of the last ``seconds``, where their numbers change."""
    values = {"runs": F.lit(1), "errors": F.col("status") == "error"}
    return change_points(_at_end(runs), values, seconds, step)


def firing(changes: DataFrame, condition: Column, hold: int, now: int | None = None) -> DataFrame:
    """``(source, since, fires_from, until)``, a row for each time a condition on the sums of
    ``changes`` held for at least ``hold`` seconds.

    The alert fires at the steps from ``fires_from`` on and before ``until``, NULL while it still
    does. With ``now``, an epoch second, steps after it have not come yet.
    """
    in_turn = Window.partitionBy("source").orderBy("at")
    marked = changes.select("source", "at", F.coalesce(condition, F.lit(False)).alias("_true"))
    turns = marked.withColumn("_was", F.lag("_true", 1, False).over(in_turn)).where("_true <> _was")
    spells = turns.withColumn("until", F.lead("at").over(in_turn)).where("_true")
    found = spells.select("source", F.col("at").alias("since"), (F.col("at") + hold).alias("fires_from"), "until")
    found = found.where("until IS NULL OR fires_from < until")
    if now is None:
        return found
    until = F.when(F.col("until") <= now, F.col("until")).alias("until")
    return found.where(F.col("fires_from") <= now).select("source", "since", "fires_from", until)


def firing_steps(changes: DataFrame, condition: Column, hold: int, step: int, now: int | None = None) -> DataFrame:
    """The sums of ``changes`` at every step, whether the alert is ``firing`` there, and while it does
    ``since``, ``fires_from`` and ``until`` as ``firing`` has them.

    ``step_end`` goes from a source's first change to its last or, if that is later, to ``now``;
    ``until`` is NULL if the alert still fires at the last step. A row per source and step: the
    result grows with the time covered, but all that is shuffled and sorted are the changes.
    """
    in_turn, backwards = Window.partitionBy("source").orderBy("at"), Window.partitionBy("source").orderBy(F.desc("at"))
    so_far = in_turn.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    to_come = backwards.rowsBetween(Window.unboundedPreceding, -1)
    shown = [name for name in changes.columns if name not in ("source", "at", "until")]
    marked = changes.where("at IS NOT NULL").withColumn("_true", F.coalesce(condition, F.lit(False)))
    turned = marked.withColumn("_was", F.lag("_true", 1, False).over(in_turn))
    turned = turned.withColumn("_since", F.max(F.when(F.expr("_true AND NOT _was"), F.col("at"))).over(so_far))
    turned = turned.withColumn("_ended", F.min(F.when(F.expr("_was AND NOT _true"), F.col("at"))).over(to_come))
    at, size = F.col("at"), F.lit(step).cast("bigint")
    last = at if now is None else F.greatest(at, F.lit(now // step * step).cast("bigint"))
    every = F.explode(F.sequence(at, F.coalesce(F.col("until") - size, last), size)).alias("step_end")
    fires_from = F.col("_since") + hold
    full = turned.select("source", every, *shown, "_true", "_since", "_ended")
    full = full.withColumn("firing", F.col("_true") & (F.col("step_end") >= fires_from))
    spell = {"since": F.col("_since"), "fires_from": fires_from, "until": F.col("_ended")}
    return full.select("source", "step_end", *shown, "firing", *[F.when(F.col("firing"), c).alias(n) for n, c in spell.items()])


def _alert(
    changes: DataFrame, condition: Column, hold: int, step: int, now: int | None, every_step: bool
) -> DataFrame:
    return firing_steps(changes, condition, hold, step, now) if every_step else firing(changes, condition, hold, now)


def alert_error_ratio(
    runs: DataFrame,
    threshold: float = 0.1,
    seconds: int = 300,
    hold: int = 300,
    step: int = 60,
    now: int | None = None,
    every_step: bool = False,
) -> DataFrame:
    """Firing times of: more than ``threshold`` of the runs of the last ``seconds`` failed. With
    ``every_step``, the runs, the failed ones and the state of the alert at all steps."""
    changes = run_changes(runs, seconds, step)
    ratio = F.when(F.col("runs") > 0, F.col("errors") / F.col("runs"))
    return _alert(changes, ratio > threshold, hold, step, now, every_step)


def alert_slow(
    runs: DataFrame,
    bounds: tuple[float, ...] = RUN_SPEC.histogramReadings[0].bounds,
    limit: float = 60,
    q: float = 0.95,
    seconds: int = 300,
    hold: int = 600,
    step: int = 60,
    now: int | None = None,
    every_step: bool = False,
) -> DataFrame:
    """Firing times of: the ``q`` quantile of the durations of the last ``seconds`` is above ``limit``.
    With ``every_step``, the quantile ``p`` and the state of the alert at all steps."""
    duration = run_duration()
    edges = [None, *bounds, None]
    values = {}
    for i, (low, high) in enumerate(zip(edges, edges[1:])):
        above = F.lit(True) if low is None else duration > low
        below = F.lit(True) if high is None else duration <= high
        values[f"_b{i}"] = above & below
    changes = change_points(_at_end(runs), values, seconds, step)
    valued = changes.withColumn("p", quantile([F.col(n) for n in values], bounds, q)).drop(*values)
    return _alert(valued, F.col("p") > limit, hold, step, now, every_step)


def alert_stalled(
    runs: DataFrame,
    seconds: int = 900,
    hold: int = 1800,
    step: int = 60,
    now: int | None = None,
    every_step: bool = False,
) -> DataFrame:
    """Firing times of: no new records in the last ``seconds``. A source that never runs again
    fires from its last record on, if that lies before ``now``. With ``every_step``, the new records
    and the state of the alert at all steps."""
    changes = change_points(_at_end(runs), {"misses": F.col("misses")}, seconds, step)
    return _alert(changes, F.col("misses") == 0, hold, step, now, every_step)


def _at_end(runs: DataFrame) -> DataFrame:
    return runs.withColumn("ts", F.col("ended_at"))


def _per_window(rows: DataFrame, series: list[str], seconds: int):
    start = F.window("ts", f"{seconds} seconds").start.alias("window_start")
    return rows.groupBy(start, *series)
