from __future__ import annotations

import json
from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from payload_metrics.operators.extract import extract, typed_records
from payload_metrics.operators.logs import log_records
from payload_metrics.operators.metrics import cumulative_points, latest_gauges, metric_points, series_text
from payload_metrics.sources.payloads import PAYLOAD_SCHEMA
from payload_metrics.spec import SourceSpec

AT = datetime(2025, 1, 1, tzinfo=timezone.utc)


def make(**parts):
    return SourceSpec.from_dict({"name": "s", "frequency": "5min", "scrape": {"type": "instant"}} | parts)


def records_of(spark, docs, spec):
    rows = [("s", "1", i, None, None, AT, json.dumps(doc)) for i, doc in enumerate(docs)]
    return extract(spark.createDataFrame(rows, PAYLOAD_SCHEMA), spec)[0]


def points_of(spark, docs, **parts):
    spec = make(**parts)
    return metric_points(records_of(spark, docs, spec), spec)


def values(points):
    """``{(metric, attributes): value or (count, sum, buckets)}``"""
    out = {}
    for r in points.collect():
        attrs = tuple(sorted((k, v) for k, v in r["attrs"].items() if k != "source"))
        assert (r["metric"], attrs) not in out
        hist = (r["count"], r["sum"], r["bucket_counts"])
        out[(r["metric"], attrs)] = hist if r["kind"] == "histogram" else r["value"]
    return out


LEVEL = {"name": "level", "dataKey": "tank.level"}


def test_numeric_texts(spark):
    docs = [[{"tank": {"level": " 7.25"}, "drops": "1e2"}, {"tank": {"level": "-0.5"}, "drops": "40"}]]
    got = points_of(
        spark,
        docs,
        gaugeReadings=[LEVEL],
        counterReadings=[{"name": "drops", "dataKey": "drops"}],
        histogramReadings=[LEVEL | {"name": "levels", "buckets": [0, 5]}],
    )
    assert values(got) == {("level", ()): -0.5, ("drops", ()): 140.0, ("levels", ()): (2, 6.75, [1, 0, 1])}
    assert {r["source"] for r in got.collect()} == {"s"}


def test_bad_values(spark):
    docs = [[{"tank": {"level": "n/a"}, "drops": [3]}, {"tank": "gone"}, {"drops": {}}]]
    got = points_of(
        spark,
        docs,
        gaugeReadings=[LEVEL],
        counterReadings=[{"name": "drops", "dataKey": "drops"}],
        histogramReadings=[LEVEL | {"name": "levels", "buckets": [5]}],
    )
    assert values(got) == {("drops", ()): 3.0}


def test_last_gauge_wins_across_windows(spark):
    docs = [[{"k": "a", "v": 1}, {"k": "a", "v": 2}, {"k": "b", "v": 3}], [{"k": "a", "v": 5}, {"k": "a", "v": None}]]
    attrs = [{"name": "k", "dataKey": "k"}]
    got = points_of(spark, docs, attributes=attrs, gaugeReadings=[{"name": "g", "dataKey": "v"}])
    assert values(got) == {("g", (("k", "a"),)): 5.0, ("g", (("k", "b"),)): 3.0}


def test_fixed_values_and_negatives(spark):
    got = points_of(
        spark,
        [[{"v": -4}, {"v": 3}, {"v": True}]],
        gaugeReadings=[{"name": "g", "dataKey": "v", "fixedValue": 9}],
        counterReadings=[{"name": "c", "dataKey": "v"}, {"name": "f", "dataKey": "v", "fixedValue": 0}, {"name": "n"}],
        histogramReadings=[{"name": "h", "dataKey": "none", "fixedValue": 2, "buckets": [2, 1, 2]}],
    )
    assert values(got) == {
        ("g", ()): 9.0, ("c", ()): 4.0, ("f", ()): 0.0, ("n", ()): 3.0, ("h", ()): (3, 6.0, [0, 3, 0]),
    }


def test_attributes(spark):
    attrs = [
        {"name": "depot", "dataKey": "where.depot"},
        {"name": "fleet", "dataKey": "$root.fleet"},
        {"name": "source", "dataKey": "feed"},
        {"name": "depot", "dataKey": "moved_to"},
        {"name": "late", "dataKey": "late"},
    ]
    vans = [{"where": {"depot": 14}}, {"where": {"depot": "quay"}, "feed": "radio", "moved_to": "hill", "late": False}]
    got = points_of(spark, [{"fleet": 2.5, "vans": vans}], dataKey="vans", attributes=attrs, counterReadings=[{"name": "c"}])
    assert sorted((sorted(r["attrs"].items()) for r in got.collect())) == [
        [("depot", "14"), ("fleet", "2.5"), ("source", "s")],
        [("depot", "hill"), ("fleet", "2.5"), ("late", "false"), ("source", "radio")],
    ]


def test_attribute_metrics(spark):
    gear = {"name": "gear", "dataKey": "box.gear", "asMetric": {"valueMapping": {"third": 3, "idle": 0}}}
    docs = [[{"box": {"gear": g}, "km": i} for i, g in enumerate(["third", "idle", "third", "third", "reverse"])]]
    got = points_of(spark, docs, attributes=[gear, {"name": "km", "dataKey": "km"}])
    assert values(got) == {("gear", (("gear", "third"),)): 9.0, ("gear", (("gear", "idle"),)): 0.0}
    open_door = {"name": "door", "dataKey": "door", "asMetric": {"metricName": "doors", "unit": "d", "valueMapping": {"false": 4, "None": 5}}}
    got = points_of(spark, [[{"door": False}, {"door": True}, {}, {"door": False}]], attributes=[open_door])
    assert values(got) == {("doors", (("door", "false"),)): 8.0, ("doors", ()): 5.0}
    assert {r["unit"] for r in got.collect()} == {"d"}


def test_same_name_twice(spark):
    got = points_of(
        spark,
        [[{"v": 1}, {"v": 2}]],
        counterReadings=[{"name": "c", "dataKey": "v"}, {"name": "c"}],
        gaugeReadings=[{"name": "g", "dataKey": "v"}, {"name": "g", "fixedValue": 8}],
        histogramReadings=[{"name": "h", "dataKey": "v", "buckets": [1]}, {"name": "h", "dataKey": "v", "buckets": [1]}],
    )
    assert values(got) == {("c", ()): 5.0, ("g", ()): 8.0, ("h", ()): (4, 6.0, [2, 2])}


def test_no_metrics_configured(spark):
    assert points_of(spark, [[{"v": 1}]]).count() == 0


def test_all_kinds_of_one_source(spark):
    """Trips of a fleet: a counter, a histogram and a mapped attribute over shared attributes."""
    trips = [
        {"van": "v1", "end": "home", "min": 35.5},
        {"van": "v1", "end": "home", "min": 80},
        {"van": "v2", "end": "towed", "min": 12, "cause": "tyre"},
        {"van": "v2", "end": "towed", "cause": "tyre"},
    ]
    end = {"name": "end", "dataKey": "end", "asMetric": {"metricName": "outcome", "valueMapping": {"home": 1, "towed": 2}}}
    got = values(
        points_of(
            spark,
            [{"day": {"trips": trips[:1]}}, {"day": {"trips": trips[1:]}}],
            dataKey="day.trips",
            attributes=[{"name": "van", "dataKey": "van"}, end, {"name": "cause", "dataKey": "cause"}],
            counterReadings=[{"name": "trips"}],
            histogramReadings=[{"name": "minutes", "dataKey": "min", "buckets": [20, 60]}],
        )
    )
    home, towed = (("end", "home"), ("van", "v1")), (("cause", "tyre"), ("end", "towed"), ("van", "v2"))
    assert got == {
        ("trips", home): 2.0,
        ("trips", towed): 2.0,
        ("minutes", home): (2, 115.5, [0, 1, 1]),
        ("minutes", towed): (1, 12.0, [1, 0, 0]),
        ("outcome", (("end", "home"),)): 2.0,
        ("outcome", (("end", "towed"),)): 4.0,
    }


def test_cumulative_and_latest(spark):
    spec = make(
        attributes=[{"name": "k", "dataKey": "k"}],
        counterReadings=[{"name": "c", "dataKey": "v"}],
        gaugeReadings=[{"name": "g", "dataKey": "v"}],
        histogramReadings=[{"name": "h", "dataKey": "v", "buckets": [2]}],
    )
    rows = [(i, day * 86400 + i * 60, f"{day}-{i}", "ab"[i % 2], float(i)) for i, day in enumerate([0, 0, 0, 1, 1, 3, 3, 9])]
    df = spark.createDataFrame(rows, "pos bigint, at bigint, run string, k string, v double")
    points = metric_points(
        typed_records(df, "s", "pos", scrape_id=F.col("run"), fetched_at=F.timestamp_seconds("at")), spec
    )
    for key in "ab":
        mine = [r for r in rows if r[3] == key]
        series = cumulative_points(points).where(F.col("attrs")["k"] == key).orderBy("ts").collect()
        totals = [r["total_value"] for r in series if r["metric"] == "c"]
        assert totals == [sum(r[4] for r in mine[: i + 1]) for i in range(len(mine))]
        counts = [r["total_count"] for r in series if r["metric"] == "h"]
        assert counts == list(range(1, len(mine) + 1))
    lost = cumulative_points(points.withColumn("ts", F.when(F.col("ts") > F.timestamp_seconds(F.lit(0)), F.col("ts"))))
    assert lost.count() == points.where("kind != 'gauge'").count()
    keyed = points.withColumn("series", series_text(F.col("attrs")))
    newest = {r["series"]: r["value"] for r in latest_gauges(keyed, ["source", "metric", "series"]).collect()}
    assert newest == {'{"k":"a","source":"s"}': 6.0, '{"k":"b","source":"s"}': 7.0}


def test_one_aggregation_for_all_metrics(spark, capsys):
    df = spark.createDataFrame([(1, 2.0)], "pos bigint, v double")
    spec = make(
        counterReadings=[{"name": "a"}, {"name": "b", "dataKey": "v"}],
        gaugeReadings=[{"name": "g", "dataKey": "v"}],
        histogramReadings=[{"name": "h", "dataKey": "v", "buckets": [1, 2, 3]}],
    )
    metric_points(typed_records(df, "s", "pos"), spec).explain("simple")
    plan = capsys.readouterr().out
    assert plan.count("Exchange") == 1 and plan.count("HashAggregate") == 2 and "SortAggregate" not in plan


LAMP = {
    "name": "lamp",
    "error": {"value": ["red", "off"], "matchType": "in"},
    "warning": {"value": "amber"},
    "info": {"value": "green"},
}


@pytest.mark.parametrize("lamp", [LAMP, None])
def test_severity(spark, lamp):
    shown = {"red": "ERROR", "amber": "WARNING", "blue": "INFO", "off": "ERROR", "green": "INFO", None: "INFO"}
    numbers = {"ERROR": 17, "WARNING": 13, "INFO": 9}
    spec = make(logStatusField=lamp) if lamp else make()
    logs = log_records(records_of(spark, [[{"lamp": s} for s in shown]], spec), spec).collect()
    expected = list(shown.values()) if lamp else ["INFO"] * len(shown)
    assert [(r["severity_text"], r["severity_number"]) for r in logs] == [(t, numbers[t]) for t in expected]


def test_severity_substring_and_root(spark):
    spec = make(dataKey="r", logStatusField={"name": "$root.state", "error": {"value": "bad", "matchType": "in"}})
    docs = [{"state": "very bad", "r": [{"x": 1}]}, {"state": "fine", "r": [{"x": 2}]}]
    logs = log_records(records_of(spark, docs, spec), spec).orderBy("body").collect()
    assert [r["severity_text"] for r in logs] == ["ERROR", "INFO"]


def test_log_rows(spark):
    spec = make(attributes=[{"name": "k", "dataKey": "k"}])
    records = records_of(spark, [[{"k": "a", "n": None}]], spec)
    row = log_records(records, spec).first()
    assert json.loads(row["body"]) == {"source": "s", "record": {"k": "a", "n": None}}
    assert row["attrs"] == {"source": "s", "k": "a"} and row["ts"] == AT.replace(tzinfo=None)
    assert log_records(records, make(emitLogs=False)).count() == 0


def test_attribute_metrics_share_the_only_exchange(spark):
    """One shuffle for all metrics, and hash aggregation only."""
    mapped = {"name": "kind", "dataKey": "kind", "asMetric": {"valueMapping": {"x": 1, "y": 2}}}
    spec = make(
        attributes=[mapped, {"name": "id", "dataKey": "id"}],
        counterReadings=[{"name": "c"}],
        gaugeReadings=[{"name": "g", "dataKey": "v"}],
        histogramReadings=[{"name": "h", "dataKey": "v", "buckets": [1, 5]}],
    )
    df = spark.createDataFrame([(i, "xyz"[i % 3], i % 4, float(i)) for i in range(60)], "pos bigint, kind string, id bigint, v double")
    points = metric_points(typed_records(df, "s", "pos"), spec)
    plan = points._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "SortAggregate" not in plan
    got = {(p["metric"], p["attrs"].get("kind"), p["attrs"].get("id")): p["value"] for p in points.collect()}
    assert got["kind", "x", None] == 20 and got["kind", "y", None] == 40 and ("kind", "z", None) not in got
    assert got["c", "x", "0"] == 5 and got["c", "z", "2"] == 5 and got["g", "y", "1"] == 49


def test_counters_with_two_sources_are_added_up(spark):
    """An attribute metric and a reading of one name and attribute set are one series."""
    mapped = {"name": "kind", "dataKey": "kind", "asMetric": {"metricName": "c", "valueMapping": {"x": 10}}}
    spec = make(attributes=[mapped], counterReadings=[{"name": "c"}, {"name": "d"}])
    df = spark.createDataFrame([(0, "x"), (1, "x"), (2, "y"), (3, None)], "pos bigint, kind string")
    points = metric_points(typed_records(df, "s", "pos"), spec).collect()
    got = sorted((p["metric"], p["attrs"].get("kind") or "", p["value"]) for p in points)
    assert got == [("c", "", 1.0), ("c", "x", 22.0), ("c", "y", 1.0), ("d", "", 1.0), ("d", "x", 2.0), ("d", "y", 1.0)]


def test_attributes_of_one_name_add_up_their_metrics(spark):
    first = {"name": "k", "dataKey": "a", "asMetric": {"valueMapping": {"x": 1}}}
    second = {"name": "k", "dataKey": "b", "asMetric": {"valueMapping": {"x": 100, "y": 1000}}}
    df = spark.createDataFrame([(0, "x", "x"), (1, "x", "y")], "pos bigint, a string, b string")
    points = metric_points(typed_records(df, "s", "pos"), make(attributes=[first, second])).collect()
    assert sorted((p["attrs"]["k"], p["value"]) for p in points) == [("x", 102.0), ("y", 1000.0)]


def test_readings_of_one_series_are_one_point(spark):
    spec = make(
        gaugeReadings=[{"name": "g", "dataKey": "a"}, {"name": "g", "dataKey": "b"}],
        counterReadings=[{"name": "c", "dataKey": "a"}, {"name": "c", "fixedValue": 10}],
        histogramReadings=[{"name": "h", "dataKey": n, "buckets": [1, 5]} for n in ("a", "b")],
    )
    df = spark.createDataFrame([(0, 1.0, 7.0), (1, 4.0, None)], "pos bigint, a double, b double")
    got = {p["metric"]: p for p in metric_points(typed_records(df, "s", "pos"), spec).collect()}
    # The later reading wins where it has a value at all.
    assert got["g"]["value"] == 7 and got["c"]["value"] == 25 and len(got) == 3
    assert (got["h"]["count"], got["h"]["sum"], got["h"]["bucket_counts"]) == (3, 12.0, [1, 1, 1])
