from __future__ import annotations

from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from payload_metrics.functions.durations import frequency_seconds_col, unit_seconds_col
from payload_metrics.functions.timetext import format_time, parse_time
from payload_metrics.operators import windows as w
from payload_metrics.spec import SourceSpec

NOW = datetime(2025, 1, 10, tzinfo=timezone.utc)
RUNS = "source string, scrape_id string, started_at timestamp"


def make(name="s", **parts):
    base = {"name": name, "frequency": "1h", "scrape": {"type": "instant"}, "runFirstScrape": True}
    return SourceSpec.from_dict(base | parts)


def ranged(name="s", keys=None, parallel=None, **parts):
    scrape = {"type": "range", "rangeKeys": {"startKey": "from", "endKey": "to"} | (keys or {})}
    if parallel:
        scrape["parallelWindow"] = parallel
    return make(name, scrape=scrape, **parts)


def planned(spark, specs, runs=()):
    success = w.last_success(spark.createDataFrame(list(runs), RUNS))
    rows = w.plan_windows(w.spec_table(spark, specs), success, NOW).orderBy("source", "window_id").collect()
    return [(r["source"], r["window_id"], r["window_start"], r["window_end"]) for r in rows]


def at(hours):
    return (NOW - timedelta(hours=hours)).replace(tzinfo=None)


def test_instant_and_first_range(spark):
    assert planned(spark, [make()]) == [("s", 0, None, None)]
    assert planned(spark, [ranged()]) == [("s", 0, at(1), at(0))]


def test_range_starts(spark):
    first = ranged("first", {"firstScrapeStart": "2025-01-09T00:00:00+0000"})
    known = ranged("known", {"firstScrapeStart": "2025-01-09T00:00:00+0000"})
    runs = [("known", "1", NOW - timedelta(hours=9)), ("known", "2", NOW - timedelta(hours=3)), ("gone", "1", NOW)]
    assert planned(spark, [first, known], runs) == [("first", 0, at(24), at(0)), ("known", 0, at(3), at(0))]


def test_slices(spark):
    spec = ranged(parallel={"unit": "minutes", "value": 25})
    got = planned(spark, [spec])
    assert [round((b - a).total_seconds()) for _, _, a, b in got] == [1500, 1500, 600]
    assert got[0][2] == at(1) and got[-1][3] == at(0)
    assert all(x[3] == y[2] for x, y in zip(got, got[1:]))
    assert planned(spark, [spec], [("s", "1", NOW)]) == []
    assert planned(spark, [spec], [("s", "1", NOW + timedelta(hours=1))]) == []


def test_first_run_is_skipped_once(spark):
    specs = [make("skip", runFirstScrape=False), make("go")]
    table, nothing = w.spec_table(spark, specs), w.last_success(spark.createDataFrame([], RUNS))
    assert [r["source"] for r in w.plan_windows(table, nothing, NOW).collect()] == ["go"]
    rows = w.first_run_rows(table, nothing, NOW)
    assert [(r["source"], r["status"], r["records"]) for r in rows.collect()] == [("skip", "success", 0)]
    after = w.last_success(rows)
    assert sorted(r["source"] for r in w.plan_windows(table, after, NOW).collect()) == ["go", "skip"]


@pytest.mark.parametrize(
    ("keys", "frequency", "value"),
    [
        ({"unit": "minutes"}, "1h", "60"),
        ({"unit": "hours", "takeNegative": True}, "2d", "-48"),
        ({"unit": "weeks"}, "1d", "0"),
        ({"unit": "months"}, "2mon", "2"),
        ({"unit": "days", "value": 5, "takeNegative": True}, "1d", "5"),
        ({"unit": "days", "value": "now-3"}, "1d", "now-3"),
        ({"unit": "days", "startKey": "from"}, "3d", "3"),
        ({"unit": "days", "startKey": "from", "endKey": "to"}, "3d", None),
    ],
)
def test_relative_values(spark, keys, frequency, value):
    table = w.spec_table(spark, [ranged(keys={"endKey": None} | keys, frequency=frequency), make("other")])
    found = [(r["unit"], r["value"]) for r in w.relative_values(table).collect()]
    assert found == ([] if value is None else [(keys["unit"], value)])


def test_window_texts(spark):
    windows = spark.createDataFrame([(NOW, NOW + timedelta(minutes=5))], "window_start timestamp, window_end timestamp")

    def texts(spec):
        row = w.window_texts(windows, spec).first()
        return row["start_text"], row["end_text"]

    assert texts(ranged()) == ("2025-01-10T00:00:00+0000", "2025-01-10T00:05:00+0000")
    assert texts(ranged(keys={"dateFormat": "%d/%m/%y %H:%M"})) == ("10/01/25 00:00", "10/01/25 00:05")
    assert texts(ranged(keys={"dateFormat": "%s"})) == ("1736467200", "1736467500")


def test_run_outcome(spark):
    rows = [("s", "1", False), ("s", "1", True), ("s", "2", False)]
    got = w.run_outcome(spark.createDataFrame(rows, "source string, scrape_id string, errored boolean"))
    assert sorted((r["scrape_id"], r["status"], r["failed_windows"]) for r in got.collect()) == [
        ("1", "error", 1),
        ("2", "success", 0),
    ]


def test_time_texts_both_ways(spark):
    formats = [None, "%Y-%m-%dT%H:%M:%S%z", "%d %b %Y %I:%M:%S %p", "%Y%m%d%H%M%S", "day %j of %Y", "%Y-%m-%d %H:%M:%S.%f"]
    moments = [datetime(2025, 2, 3, 4, 5, 6, 789000, tzinfo=timezone.utc), datetime(2024, 12, 31, 23, 0, 0, tzinfo=timezone.utc)]
    df = spark.createDataFrame([(m,) for m in moments], "t timestamp")
    for fmt in formats:
        texts = [r[0] for r in df.select(format_time(F.col("t"), fmt)).collect()]
        assert texts == [m.strftime(fmt) if fmt else m.isoformat() for m in moments], fmt
        if fmt and "%b" not in fmt and "%j" not in fmt:
            back = spark.createDataFrame([(t,) for t in texts], "x string").select(parse_time(F.col("x"), fmt))
            wants = [datetime.strptime(t, fmt).replace(tzinfo=None) for t in texts]
            assert [r[0] for r in back.collect()] == wants, fmt


def test_reading_offsets(spark):
    df = spark.createDataFrame([("2025-01-01T01:00:00+0100",), ("2025-01-01T00:00:00Z",), ("x",)], "x string")
    got = [r[0] for r in df.select(parse_time(F.col("x"), "%Y-%m-%dT%H:%M:%S%z")).collect()]
    assert got == [datetime(2025, 1, 1), datetime(2025, 1, 1), None]
    iso = [r[0] for r in df.select(parse_time(F.col("x"), None)).collect()]
    assert iso == got


def iso_texts():
    """Well-formed and broken texts of all forms, put together from parts."""
    dates = [
        "2025", "2025-03", "202503", "2025-03-09", "20250309", "2025-3-9", "2025-W01", "2025W01", "2025-W01-1", "2025W537", "2025-W53-7",
        "2025-W00-1", "2025-W01-8", "2025-W54-1", "2024-366", "2025-366", "2025001", "2025-000", "0000-01-01", "0001-01-01", "2025-02-30",
        "2025-13-01", "20250011", " 2025-03-09", "9999-12-31", "2025-01-011", "25-01-01", "", "x",
    ]
    times = [
        "", "T", "T10", "T1030", "T10:30", "T10:3", " 10:30:15", "x103015", "T10:30:15.5", "T103015,123456789", "T10:30:60", "T10:60",
        "T24:00", "T24", "T24:00:01", "T24:00:00.000", "T25", "T10:3015", "T1030:15", "T10.5", "T10:30.5", "T10:30:15.", "0", "011",
    ]
    offsets = ["", "Z", "z", "+05", "-0530", "+05:30", "-00:00", "+24:00", "+05:60", " +05:00", "+5", "ZZ"]
    return [d + t + o for d in dates for t in times for o in offsets] + ["２０２５-01-01", "2025-01-01T10:30\n", "\n2025-01-01"]


def test_iso_texts_against_a_parser(spark):
    """Every text gives the moment the parser gives, and NULL where it raises an error."""
    isoparse = pytest.importorskip("dateutil.parser").isoparse

    def want(text):
        try:
            moment = isoparse(text)
            moment = moment if moment.tzinfo else moment.replace(tzinfo=timezone.utc)
            return (moment - datetime(1970, 1, 1, tzinfo=timezone.utc)) // timedelta(microseconds=1)
        except (ValueError, OverflowError):
            return None

    texts = iso_texts()
    df = spark.createDataFrame([(t,) for t in texts], "x string")
    got = {r["x"]: r["at"] for r in df.select("x", F.unix_micros(parse_time(F.col("x"), None)).alias("at")).collect()}
    wrong = [(t, got[t], want(t)) for t in texts if got[t] != want(t)]
    assert not wrong, (len(wrong), wrong[:20])
    assert sum(v is not None for v in got.values()) > 800
    assert spark.sql("SELECT CAST(NULL AS STRING) AS x").select(parse_time(F.col("x"), None)).first()[0] is None


def test_duration_columns(spark):
    df = spark.createDataFrame([("5min", "hours"), ("2mon", "weeks"), ("30s", None), (" 1m ", "x")], "f string, u string")
    got = df.select(frequency_seconds_col(F.col("f")), unit_seconds_col(F.col("u"))).collect()
    assert [tuple(r) for r in got] == [(300, 3600), (5184000, 604800), (None, 1), (60, 1)]
