from __future__ import annotations

import random
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from payload_metrics.plans import monitor

AT = datetime(2025, 1, 1, tzinfo=timezone.utc)
RUNS = (
    "source string, scrape_id string, api_type string, status string, started_at timestamp, ended_at timestamp, "
    "records bigint, hits bigint, misses bigint, total bigint"
)


def run_row(i, minute, status="success", seconds=1.0, hits=0, misses=1, source="s"):
    end = AT + timedelta(minutes=minute)
    start = end - timedelta(seconds=seconds)
    return (source, str(i), "instant", status, start, end, misses, hits, misses, hits + misses)


def runs(spark, rows):
    return spark.createDataFrame(rows, RUNS)


def test_run_points(spark):
    rows = [run_row(0, 0, seconds=0.5), run_row(1, 5, seconds=70, misses=4), run_row(2, 9, "error", seconds=5)]
    points = monitor.run_points(runs(spark, rows)).collect()
    by = {(p["metric"], p["attrs"]["status"]): p for p in points}
    assert by["scraper_runs_total", "success"]["value"] == 2
    assert by["scraper_records_emitted_total", "success"]["value"] == 5
    assert by["scraper_last_run_duration_seconds", "success"]["value"] == 70
    assert by["scraper_last_records_emitted", "error"]["value"] == 1
    assert by["scraper_run_duration_seconds", "success"]["count"] == 2
    assert by["scraper_run_duration_seconds", "success"]["unit"] == "s"
    assert {p["attrs"]["source"] for p in points} == {"s"}


def test_dedupe_points(spark):
    rows = [run_row(0, 0, hits=5, misses=3), run_row(1, 1, hits=0, misses=0, source="idle")]
    by = {(p["metric"], p["attrs"]["source"]): p["value"] for p in monitor.dedupe_points(runs(spark, rows)).collect()}
    assert by["scraper_dedupe_hit_rate", "s"] == 0.625
    assert by["scraper_dedupe_total", "s"] == 8
    assert by["scraper_dedupe_hit_rate", "idle"] == 0


def test_cleanup_points(spark):
    rows = [("j", "table", AT, AT + timedelta(seconds=2), 5), ("j", "table", AT, AT + timedelta(seconds=4), None)]
    df = spark.createDataFrame(rows, "job string, backend string, started_at timestamp, ended_at timestamp, items bigint")
    by = {p["metric"]: p for p in monitor.cleanup_points(df).collect()}
    assert by["scraper_cleanup_items_total"]["value"] == 5
    assert by["scraper_cleanup_last_items"]["value"] == 5
    assert by["scraper_cleanup_last_duration_seconds"]["value"] == 4
    assert by["scraper_cleanup_duration_seconds"]["count"] == 2


def test_self_logs(spark):
    rows = monitor.self_logs(runs(spark, [run_row(0, 0), run_row(1, 1, "error")])).orderBy("ts").collect()
    assert [(r["severity_text"], r["severity_number"]) for r in rows] == [("INFO", 9), ("ERROR", 17)]
    assert rows[0]["attrs"] == {"component": "scraper"}


def prometheus_quantile(q, bounds, counts):
    """The published rule, on a plain list of per-bucket counts."""
    total = sum(counts)
    if total == 0:
        return None
    rank, so_far = q * total, 0
    for i, n in enumerate(counts):
        if so_far + n >= rank:
            break
        so_far += n
    if i == len(bounds):
        return bounds[-1]
    if i == 0 and bounds[0] <= 0:
        return bounds[0]
    low = bounds[i - 1] if i else 0.0
    return low + (bounds[i] - low) * ((rank - so_far) / counts[i] if counts[i] else 1.0)


@pytest.mark.parametrize("bounds", [(1.0, 2.0, 5.0), (-1.0, 0.0, 4.0), (10.0,)])
def test_quantiles(spark, bounds):
    rng = random.Random(len(bounds))
    rows = [(i, [rng.choice([0, 0, 1, 7]) for _ in range(len(bounds) + 1)]) for i in range(25)]
    points = spark.createDataFrame([(*r, list(bounds)) for r in rows], "i int, bucket_counts array<bigint>, bounds array<double>")
    qs = {"a": 0.01, "b": 0.5, "c": 0.95, "d": 1.0}
    got = {r["i"]: r for r in monitor.histogram_quantiles(points, ["i"], bounds, qs).collect()}
    for i, counts in rows:
        for name, q in qs.items():
            want = prometheus_quantile(q, bounds, counts)
            assert got[i][name] == (want if want is None else pytest.approx(want)), (counts, q)
    # By the points' own bounds the same comes out.
    own = monitor.histogram_quantiles(points, ["i"], None, qs)
    for r in own.collect():
        assert [r[n] for n in qs] == [pytest.approx(got[r["i"]][n]) for n in qs]
    with pytest.raises(ValueError):
        monitor.quantile([F.lit(1)], (1.0,), 2)
    with pytest.raises(ValueError):
        monitor.histogram_quantiles(points, ["i"], None, {"a": -1})


MIXED = "i int, kind string, bounds array<double>, bucket_counts array<bigint>"


def test_quantiles_at_common_edges(spark):
    """Points with bounds of their own, against the rule on the buckets between common edges."""
    rng = random.Random(3)
    bounds = {"a": [1.0, 2.0, 5.0, 9.0], "b": [2.0, 4.0, 9.0], "c": [0.5, 2.0, 9.0, 20.0]}
    rows, merged = [], {}
    for i in range(30):
        for kind in rng.sample("abc", rng.randint(1, 3)) * 2:
            counts = [rng.choice([0, 0, 1, 6]) for _ in range(len(bounds[kind]) + 1)]
            rows.append((i, kind, bounds[kind], counts))
            merged.setdefault(i, []).append((bounds[kind], counts))
    qs = {"p10": 0.1, "p50": 0.5, "p99": 0.99}
    got = {r["i"]: r for r in monitor.histogram_quantiles(spark.createDataFrame(rows, MIXED), ["i"], None, qs).collect()}
    assert len(got) == len(merged)
    for i, points in merged.items():
        edges = sorted(set.intersection(*[set(b) for b, _ in points]))
        below = [sum(n for b, c in points for n, upper in zip(c, b) if upper <= e) for e in edges]
        total = sum(sum(c) for _, c in points)
        counts = [b - a for a, b in zip([0, *below], [*below, total])]
        for name, q in qs.items():
            want = prometheus_quantile(q, edges, counts)
            assert got[i][name] == (want if want is None else pytest.approx(want)), (edges, counts, q)


def test_quantiles_of_bounds_that_do_not_fit(spark):
    rows = [(1, "a", [1.0, 2.0], [1, 2, 3]), (1, "b", [3.0], [4, 4]), (2, "a", None, None)]
    points = spark.createDataFrame(rows, MIXED)
    (got,) = monitor.histogram_quantiles(points, ["i"], None, {"p": 0.5}).collect()
    assert got["i"] == 1 and got["p"] is None
    with pytest.raises(Exception, match="bounds \\[3.0\\] among"):
        monitor.histogram_quantiles(points, ["i"], (1.0, 2.0), {"p": 0.5}).collect()
    assert monitor.histogram_quantiles(points.limit(0), ["i"], None, {"p": 0.5}).count() == 0


def firing(df, last, step=60):
    """Steps up to ``last`` at which the alert fires."""
    out = []
    for r in df.orderBy("since").collect():
        end = last + step if r["until"] is None else min(r["until"], last + step)
        out += range(r["fires_from"], end, step)
    return out


def brute(events, first, last, step, seconds, hold, test):
    """Ends of firing steps by looking at every step and event."""
    ends = range(first, last + 1, step)
    true = {t: test([x for at, x in events if t - seconds <= at < t]) for t in ends}
    return [t for t in ends if t - hold >= first and all(true[u] for u in range(t - hold, t + 1, step))]


@pytest.mark.parametrize("seed", range(4))
def test_error_alert_against_brute_force(spark, seed):
    rng = random.Random(seed)
    minutes, at = [], 0.0
    for _ in range(60):
        at += rng.choice([0, 0.3, 1, 1.7, 4, 30])
        minutes.append(at)
    rows = [run_row(i, m, rng.choice(["success", "success", "error"])) for i, m in enumerate(minutes)]
    epoch = int(AT.timestamp())
    events = [(epoch + round(m * 60), r[3]) for m, r in zip(minutes, rows)]
    first = events[0][0] // 60 * 60 + 60
    last = events[-1][0] // 60 * 60 + 60 + 900

    def test(recent):
        return bool(recent) and recent.count("error") / len(recent) > 0.3

    want = brute(events, first, last, 60, 300, 240, test)
    frame = runs(spark, rows)
    got = monitor.alert_error_ratio(frame, threshold=0.3, seconds=300, hold=240, step=60)
    assert firing(got, last) == want and want
    assert got.where("until IS NULL").count() == 0
    # As of any time, the steps until then.
    for now in rng.sample(range(first, last), 4):
        seen = monitor.alert_error_ratio(frame, threshold=0.3, seconds=300, hold=240, step=60, now=now)
        assert firing(seen, now // 60 * 60) == [t for t in want if t <= now]


def test_changes_are_bounded_by_the_runs(spark):
    """A gap of a year adds nothing, and repeats within a step are one change."""
    minutes = [0, 0.2, 0.4, 10, 60 * 24 * 365]
    changes = monitor.run_changes(runs(spark, [run_row(i, m, "error") for i, m in enumerate(minutes)]))
    epoch = int(AT.timestamp())
    year = epoch + 86400 * 365
    got = [tuple(r) for r in changes.orderBy("at").select("at", "until", "runs", "errors").collect()]
    assert got == [
        (epoch + 60, epoch + 360, 3, 3),
        (epoch + 360, epoch + 660, 0, 0),
        (epoch + 660, epoch + 960, 1, 1),
        (epoch + 960, year + 60, 0, 0),
        (year + 60, year + 360, 1, 1),
        (year + 360, None, 0, 0),
    ]
    with pytest.raises(ValueError):
        monitor.run_changes(runs(spark, []), seconds=90, step=60)
    assert monitor.alert_slow(runs(spark, [])).count() == 0


def test_stalled_alert(spark):
    rows = [run_row(0, 0), *[run_row(i, i * 5, misses=0, hits=3) for i in range(1, 14)]]
    epoch = int(AT.timestamp())
    frame = runs(spark, rows)
    # The last news leaves the 15 minute range after step 16; 30 minutes later it fires.
    (open_end,) = monitor.alert_stalled(frame, now=epoch + 7200).collect()
    assert tuple(open_end) == ("s", epoch + 60 * 16, epoch + 60 * 46, None)
    assert monitor.alert_stalled(frame, now=epoch + 60 * 46 - 1).count() == 0
    again = frame.unionByName(runs(spark, [run_row(99, 100)]))
    (closed,) = monitor.alert_stalled(again, now=epoch + 7200).collect()
    assert closed["until"] == epoch + 60 * 101


def test_slow_alert(spark):
    rows = [run_row(i, i, seconds=200 if i >= 5 else 1) for i in range(40)]
    epoch = int(AT.timestamp())
    (got,) = monitor.alert_slow(runs(spark, rows)).collect()
    # Until the last slow run has left the five minutes.
    assert got["fires_from"] >= epoch + 60 * 16 and got["until"] == epoch + 60 * 45


def test_rates_and_ratios(spark):
    rows = [run_row(0, 0.5, misses=6), run_row(1, 1.5, "error", seconds=3, misses=0), run_row(2, 7, misses=2, hits=2)]
    df = runs(spark, rows)
    assert [r["ratio"] for r in monitor.success_ratio(df).orderBy("window_start").collect()] == [0.5, 1.0]
    assert [r["avg_duration"] for r in monitor.average_duration(df).orderBy("window_start").collect()] == [2.0, 1.0]
    assert [r["per_second"] for r in monitor.records_throughput(df).orderBy("window_start").collect()] == [0.1, 0.0, 2 / 60]
    assert monitor.average_hit_rate(df).first()["avg_hit_rate"] == 0.5
    points = df.select("source", F.col("ended_at").alias("ts"), F.col("records").cast("double").alias("value"))
    assert [r["rate"] for r in monitor.counter_rate(points, ["source"]).orderBy("window_start").collect()] == [0.02, 2 / 300]


def test_cardinality(spark):
    rows = [("m", "s", {"k": str(i % 7), "source": "s"}) for i in range(50)] + [("n", "s", {"source": "s"})]
    df = spark.createDataFrame(rows, "metric string, source string, attrs map<string,string>")
    assert {r["metric"]: r["series"] for r in monitor.cardinality(df).collect()} == {"m": 7, "n": 1}
    assert {r["metric"]: r["series"] for r in monitor.approx_cardinality(df).collect()} == {"m": 7, "n": 1}


def test_sketches_of_days_merge(spark):
    rows = [("m", "s", AT + timedelta(days=d), {"k": str(i)}) for d in range(4) for i in range(d * 1000, d * 1000 + 2000)]
    points = spark.createDataFrame(rows, "metric string, source string, ts timestamp, attrs map<string,string>")
    sketches = monitor.daily_series_sketches(points)
    assert sketches.count() == 4
    (got,) = monitor.sketched_cardinality(sketches).collect()
    # 5,000 series, of which neighbouring days share half.
    assert got["days"] == 4 and abs(got["series"] - 5000) <= 5000 * 3 * 0.01625
    assert monitor.sketched_cardinality(sketches.limit(0)).count() == 0


def test_cleanup_points_scan_once(spark):
    df = spark.createDataFrame([("j", "table", AT, AT, None), ("k", "table", AT, AT, 0)], "job string, backend string, started_at timestamp, ended_at timestamp, items bigint")
    points = monitor.cleanup_points(df)
    plan = points._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and plan.count("Scan ExistingRDD") == 1
    items = {p["attrs"]["job"]: p["value"] for p in points.where("metric = 'scraper_cleanup_items_total'").collect()}
    assert items == {"k": 0.0}


@pytest.mark.parametrize("now", [None, 40_000])
def test_alerts_at_every_step(spark, now):
    """All steps with their sums, those at which nothing fires included, and the same firing times."""
    rng = random.Random(7)
    minutes, at = [], 0.0
    for _ in range(60):
        at += rng.choice([0, 0.3, 1, 1.7, 4, 30])
        minutes.append(at)
    rows = [run_row(i, m, rng.choice(["success", "error"]), misses=rng.choice([0, 0, 1])) for i, m in enumerate(minutes)]
    epoch, frame = int(AT.timestamp()), runs(spark, rows)
    events = [(epoch + round(m * 60), r) for m, r in zip(minutes, rows)]
    first, last = events[0][0] // 60 * 60 + 60, events[-1][0] // 60 * 60 + 60 + 300
    now = now and epoch + now
    last = max(last, (now or 0) // 60 * 60)
    sizes = {"seconds": 300, "hold": 240, "step": 60, "now": now}
    got = monitor.alert_error_ratio(frame, threshold=0.3, every_step=True, **sizes).orderBy("step_end").collect()
    assert [r["step_end"] for r in got] == list(range(first, last + 1, 60))
    recent = [[r for at, r in events if t - 300 <= at < t] for t in range(first, last + 1, 60)]
    assert [r["runs"] for r in got] == [len(x) for x in recent]
    assert [r["errors"] for r in got] == [sum(r[3] == "error" for r in x) for x in recent]
    spells = monitor.alert_error_ratio(frame, threshold=0.3, **sizes)
    assert [r["step_end"] for r in got if r["firing"]] == firing(spells, last)
    of_steps = {(r["since"], r["fires_from"], r["until"]) for r in got if r["firing"]}
    assert of_steps == {tuple(r)[1:] for r in spells.collect()} and of_steps
    assert {(r["since"], r["fires_from"], r["until"]) for r in got if not r["firing"]} == {(None, None, None)}
    stalled = monitor.alert_stalled(frame, every_step=True, **sizes)
    fires = [r["step_end"] for r in stalled.where("firing").orderBy("step_end").collect()]
    assert fires == firing(monitor.alert_stalled(frame, **sizes), last) and fires
    slow = monitor.alert_slow(frame, limit=0, every_step=True, **sizes)
    assert slow.count() == len(got) and slow.where("firing").count() == len(firing(monitor.alert_slow(frame, limit=0, **sizes), last))


def test_rate_of_cleanups_that_know_nothing(spark, tmp_path):
    """A window whose clean-ups all failed has a rate of NULL, and is not left out."""
    from driver_queries import QUERIES, load_all

    load_all()
    rows = [(0, AT, 1, "error", 2.0, '{"k": 4}'), (1, AT + timedelta(hours=1), 1, "view", 2.0, '{"k": 6}')]
    frame = spark.createDataFrame(rows, "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string")
    frame.coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    got = QUERIES["cleanup_rate"](spark, str(tmp_path)).orderBy("window_start").collect()
    assert [r["rate"] for r in got] == [None, 0.01]
