from __future__ import annotations

from datetime import datetime, timezone

import pytest

from payload_metrics.functions.durations import frequency_seconds
from payload_metrics.functions.regexes import to_java_regex
from payload_metrics.functions.timetext import READ_PATTERNS, WRITE_PATTERNS, java_pattern
from payload_metrics.paths import DataStep, EveryItem, ItemAt, ItemRange, data_steps, key_parts, variant_path
from payload_metrics.spec import SourceSpec, SpecError, load_specs

MINIMAL = {"name": "s", "frequency": "5min", "scrape": {"type": "instant"}}


def make(**parts):
    return SourceSpec.from_dict(MINIMAL | parts)


def test_key_parts():
    assert key_parts(None) == []
    assert key_parts("a.b/.c.d") == ["a", "b.c", "d"]
    assert key_parts(".a..b") == ["a", "b"]
    assert key_parts("items[0].x") == ["items[0]", "x"]


def test_data_steps():
    assert data_steps("a.b[].c") == [DataStep("a"), DataStep("b", EveryItem()), DataStep("c")]
    assert data_steps("a[-1]") == [DataStep("a", ItemAt(-1))]
    assert data_steps("a[1:3].b[:2]") == [DataStep("a", ItemRange(1, 3)), DataStep("b", ItemRange(None, 2))]
    assert data_steps("a/.b[0]") == [DataStep("a.b", ItemAt(0))]
    with pytest.raises(ValueError):
        data_steps("a[x]")


def test_variant_path():
    assert variant_path(["a", "b.c", 'd"e']) == """$["a"]["b.c"]['d"e']"""


@pytest.mark.parametrize(
    ("text", "seconds"),
    [("5min", 300), ("2m", 120), ("2h", 7200), ("1d", 86400), ("1w", 604800), ("2mon", 5184000)],
)
def test_frequency(text, seconds):
    assert frequency_seconds(text) == seconds


@pytest.mark.parametrize("text", ["bad", "30s", "", "-1h", "1.5h", "h"])
def test_bad_frequency(text):
    with pytest.raises(ValueError):
        frequency_seconds(text)
    with pytest.raises(SpecError):
        make(frequency=text)


def test_java_pattern():
    assert java_pattern("%Y-%m-%dT%H:%M:%S%z", WRITE_PATTERNS) == "yyyy'-'MM'-'dd'T'HH':'mm':'ssxx"
    assert java_pattern("it's %d", READ_PATTERNS) == "'it''s 'dd"
    with pytest.raises(ValueError):
        java_pattern("%Q", WRITE_PATTERNS)


def test_regex_rewriting():
    assert to_java_regex(r"(?P<my_x>a)(?P=my_x)\Z") == r"(?d)(?<g0>a)\k<g0>\z"
    assert to_java_regex(r"\d+") == r"(?dU)\d+"
    with pytest.raises(ValueError):
        to_java_regex("(a)?(?(1)b|c)")


@pytest.mark.parametrize(
    "parts",
    [
        {"unknown": 1},
        {"scrape": {"type": "range"}},
        {"scrape": {"type": "sometimes"}},
        {"scrape": {"type": "instant", "parallelWindow": {"unit": "hours", "value": 1}}},
        {"filters": {"keep": [{"all": [{"field": "a", "matchType": "like", "value": 1}]}]}},
        {"filters": {"keep": [{"all": [{"field": "$root.a", "matchType": "equals", "value": 1}]}]}},
        {"filters": {"drop": [{"any": [{"field": "a", "matchType": "regex", "value": "("}]}]}},
        {"deltaDetection": {"fingerprintKeys": ["$root.x"]}},
        {"deltaDetection": {"fingerprintMode": "some"}},
        {"gaugeReadings": [{"name": "g", "valueKey": "x"}]},
        {"histogramReadings": [{"name": "h", "dataKey": "x"}]},
        {"counterReadings": [{"name": "c", "labels": []}]},
        {"dataKey": "a[b]"},
    ],
)
def test_rejected_specs(parts):
    with pytest.raises(SpecError):
        make(**parts)


def test_fetch_keys_are_ignored():
    spec = make(auth={"type": "basic"}, baseUrl="https://x", endpoint="/y", allowOverlapScans=True)
    assert spec.name == "s" and spec.emitLogs


def test_defaults_and_ttl():
    spec = make(deltaDetection={"enabled": True, "ttlSeconds": 0})
    assert spec.deltaDetection.ttl() == 86400
    assert spec.deltaDetection.ttl(10) == 10
    assert spec.deltaDetection.capacity() == 50000
    assert make(deltaDetection={"maxEntries": 7}).deltaDetection.capacity() == 7
    assert make(deltaDetection={"fingerprintMode": "keys", "fingerprintKeys": []}).deltaDetection.key_paths == ()


def test_first_scrape_start():
    keys = {"startKey": "f", "endKey": "t", "firstScrapeStart": "2025-01-02T00:00:00+0100"}
    spec = make(scrape={"type": "range", "rangeKeys": keys})
    assert spec.first_scrape_start() == datetime(2025, 1, 1, 23, tzinfo=timezone.utc)
    epoch = keys | {"dateFormat": "%s", "firstScrapeStart": "2025-01-02T00:00:00"}
    assert make(scrape={"type": "range", "rangeKeys": epoch}).first_scrape_start().day == 2


def test_uses_root():
    assert make(gaugeReadings=[{"name": "g", "dataKey": "$root.a"}]).uses_root
    assert make(logStatusField={"name": "$root.s"}).uses_root
    assert not make(gaugeReadings=[{"name": "g", "dataKey": "a"}]).uses_root


def test_load_specs(tmp_path):
    path = tmp_path / "config.yaml"
    path.write_text(
        "scraper: {otelCollectorEndpoint: x}\n"
        "sources:\n"
        "  - {name: a, frequency: 1h, baseUrl: u, endpoint: e, scrape: {type: instant, httpMethod: POST}}\n"
        "  - {name: b, frequency: 1d, scrape: {type: instant}}\n"
    )
    assert sorted(load_specs(path)) == ["a", "b"]


def test_config_defaults_fill_gaps(tmp_path):
    path = tmp_path / "config.yaml"
    path.write_text(
        "scraper:\n"
        "  defaultTimeFormat: '%Y'\n"
        "  fingerprintStore: {defaultTtlSeconds: 60, maxEntriesPerSource: 9}\n"
        "sources:\n"
        "  - {name: a, frequency: 1h, scrape: {type: instant}}\n"
        "  - {name: b, frequency: 1h, scrape: {type: instant, timeFormat: '%d'}, deltaDetection: {ttlSeconds: 5}}\n"
    )
    specs = load_specs(path)
    assert [specs[n].deltaDetection.ttl() for n in "ab"] == [60, 5]
    assert [specs[n].deltaDetection.capacity() for n in "ab"] == [9, 9]
    assert [specs[n].time_format for n in "ab"] == ["%Y", "%d"]
