from __future__ import annotations

import json
import os
import random
from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from payload_metrics.operators.extract import extract, extract_selected, selected_records
from payload_metrics.sources.payloads import PAYLOAD_SCHEMA, read_payload_files, stream_payload_files
from payload_metrics.spec import SourceSpec

AT = datetime(2025, 1, 1, tzinfo=timezone.utc)


def make(**parts):
    return SourceSpec.from_dict({"name": "s", "frequency": "5min", "scrape": {"type": "instant"}} | parts)


def payloads(spark, texts):
    rows = [("s", "1", i, None, None, AT, t if isinstance(t, str) else json.dumps(t)) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, PAYLOAD_SCHEMA)


def extracted(spark, texts, **parts):
    """Records per payload as Python values, or the reject reason."""
    records, rejects = extract(payloads(spark, texts), make(**parts))
    out = {i: [] for i in range(len(texts))}
    for row in records.select("window_id", "record_idx", F.to_json("record").alias("r")).orderBy("record_idx").collect():
        out[row["window_id"]].append(json.loads(row["r"]))
    for row in rejects.collect():
        assert out[row["window_id"]] == []
        out[row["window_id"]] = row["reason"]
    return [out[i] for i in range(len(texts))]


PLANTS = [{"id": f"p{n}", "mw": n * 1.5} for n in (4, 7, 9, 12, 20)]
GRID = {"zone": "north", "plants": PLANTS, "meta.v2": {"totals": {"peak": 31}, "notes": [None, {"by": "ops"}]}}
TREE = {"sites": [{"units": [{"t": 1}, {"t": 2}, {"t": 3}]}, {"units": []}, {"name": "bare"}, {"units": [{"t": 9}]}]}


@pytest.mark.parametrize(
    ("payload", "key", "expected"),
    [
        (PLANTS, None, PLANTS),
        (["north", 0.5, False, None], None, ["north", 0.5, False, None]),
        ([], None, []),
        (GRID, "plants[]", PLANTS),
        (GRID, "plants", PLANTS),
        (GRID, "plants[3]", [PLANTS[3]]),
        (GRID, "plants[-5]", [PLANTS[0]]),
        (GRID, "plants[2:4]", PLANTS[2:4]),
        (GRID, "plants[:-3]", PLANTS[:2]),
        (GRID, "plants[4:]", PLANTS[4:]),
        (GRID, "plants[8:]", []),
        (GRID, "plants[-1:1]", []),
        (GRID, "meta/.v2", [GRID["meta.v2"]]),
        (GRID, "meta/.v2.totals", [{"peak": 31}]),
        (GRID, "meta/.v2.notes[1]", [{"by": "ops"}]),
        (GRID, "plants[].owner", []),
        (GRID, "meta.v2", []),
        (TREE, "sites[].units", [{"t": 1}, {"t": 2}, {"t": 3}, {"t": 9}]),
        (TREE, "sites[].units[]", [{"t": 1}, {"t": 2}, {"t": 3}, {"t": 9}]),
        (TREE, "sites[0].units[-2:]", [{"t": 2}, {"t": 3}]),
        (TREE, "sites[3:].units[0]", [{"t": 9}]),
        ({"pages": [[{"t": 5}, {"t": 6}], [{"t": 7}]]}, "pages[]", [{"t": 5}, {"t": 6}, {"t": 7}]),
        ({"plants": None}, "plants", []),
        ({"plants": None}, "plants[]", []),
        ({"plants": []}, "plants", []),
        ("12.5", "plants", []),
    ],
)
def test_records(spark, payload, key, expected):
    assert extracted(spark, [payload], dataKey=key) == [expected]


@pytest.mark.parametrize(
    ("payload", "key"),
    [
        (GRID, None),
        ("true", None),
        ("null", None),
        (GRID, "zone"),
        (GRID, "zone[]"),
        (GRID, "meta/.v2[]"),
        (GRID, "plants[9]"),
        (GRID, "plants[-6]"),
        (GRID, "meta/.v2.notes[0]"),
        (GRID, "meta/.v2.notes[]"),
        (TREE, "sites[].units[2]"),
        ({"readings": ["low", "high"]}, "readings"),
        ({"readings": [{"t": 1}, "high"]}, "readings[]"),
        ({"deep": [[[{"t": 1}]]]}, "deep[]"),
        ('{"plants": [', "plants"),
        ("", None),
        ("[{}] trailing", None),
        ("[{}];[{}]", None),
        ('{"plants": [{}]} {"plants": []}', "plants"),
    ],
)
def test_rejects(spark, payload, key):
    assert isinstance(extracted(spark, [payload], dataKey=key)[0], str)


def test_one_bad_payload_does_not_stop_others(spark):
    got = extracted(spark, [{"a": [{"x": 1}]}, "nonsense", {"a": 3}, {"a": {"x": 2}}], dataKey="a")
    assert got[0] == [{"x": 1}] and got[3] == [{"x": 2}]
    assert isinstance(got[1], str) and isinstance(got[2], str)


def test_snippet_length(spark):
    _, rejects = extract(payloads(spark, ["x" * 1000]), make())
    assert len(rejects.first()["snippet"]) == 200


def test_last_of_repeated_keys_wins(spark):
    assert extracted(spark, ['[{"a": 1, "a": 2}]']) == [[{"a": 2}]]


def test_root_must_be_an_object(spark):
    gauge = [{"name": "g", "dataKey": "$root.n"}]
    got = extracted(spark, [{"n": 1, "r": [{"x": 1}]}, [{"x": 1}]], dataKey="r", gaugeReadings=gauge)
    assert got == [[{"x": 1}], "root lookups need an object payload"]


def test_slices_and_indexes_agree_with_python(spark):
    rng = random.Random(5)
    texts, keys, expected = [], [], []
    for _ in range(12):
        items = [{"v": i} for i in range(rng.randrange(0, 7))]
        start, stop = (rng.choice([None, *range(-8, 9)]) for _ in range(2))
        keys.append(f"items[{'' if start is None else start}:{'' if stop is None else stop}]")
        texts.append({"items": items})
        expected.append(items[start:stop])
    for key, text, want in zip(keys, texts, expected):
        assert extracted(spark, [text], dataKey=key) == [want], key


def test_selection_inside_payloads_equals_rules_on_rows(spark):
    from payload_metrics.operators.filters import apply_filters, cap

    rng = random.Random(9)
    texts = [{"r": [{"k": rng.randrange(4), "i": i} for i in range(rng.randrange(0, 12))]} for _ in range(8)]
    rules = {
        "drop": [{"any": [{"field": "k", "matchType": "equals", "value": 0}]}],
        "keep": [{"all": [{"field": "k", "matchType": "in", "value": [1, 2]}]}],
        "limits": {"maxRecordsPerScrape": 3},
    }
    spec = make(dataKey="r", filters=rules)
    source = payloads(spark, [*texts, "bad"])
    inside = extract_selected(source, spec)
    records, _ = extract(source, spec)
    outside = cap(apply_filters(records, spec), spec)

    def keys(df):
        return sorted(map(tuple, df.select("window_id", "record_idx").collect()))

    expected = []
    for w, text in enumerate(texts):
        chosen = [i for i, r in enumerate(text["r"]) if r["k"] in (1, 2)]
        expected += [(w, i) for i in chosen[:3]]
    assert keys(selected_records(inside)) == expected
    assert keys(outside) == expected
    assert inside.where("reason is not null").select("window_id").collect() == [(8,)]


def test_parse_runs_once_per_plan(spark, capsys):
    source = payloads(spark, [GRID])
    records, rejects = extract(source, make(dataKey="plants"))
    for frame in (records, rejects, selected_records(extract_selected(source, make(dataKey="plants")))):
        frame.explain("simple")
        assert capsys.readouterr().out.count("parseJson") == 1


def test_payload_files(spark, tmp_path):
    for i, doc in enumerate([[{"a": 1}], [{"a": 2}, {"a": 3}]]):
        (tmp_path / f"page-{i}.json").write_text(json.dumps(doc, indent=2))
    found = read_payload_files(spark, str(tmp_path), "s", "x")
    records, _ = extract(found, make())
    got = records.select("window_id", F.to_json("record").alias("r")).collect()
    assert sorted(map(tuple, got)) == [(0, '{"a":1}'), (1, '{"a":2}'), (1, '{"a":3}')]


def test_payload_files_without_a_number(spark, tmp_path):
    """They are scrapes of their own, ordered by name; folders name the other scrapes."""
    for folder in ("run-a", "run-b"):
        (tmp_path / folder).mkdir()
    texts = {"run-a/1.json": "[1", "run-a/2.json": '[{"v": 2}]', "run-b/west.json": '[{"v": 4}]', "run-b/east.json": '[{"v": 3}]', "run-b/none.json": ""}
    for name, text in texts.items():
        (tmp_path / name).write_text(text)
        os.utime(tmp_path / name, (1_700_000_000, 1_700_000_000))
    found = read_payload_files(spark, str(tmp_path), "s")
    records, rejects = extract(found, make())
    got = records.orderBy("fetched_at", "scrape_id", "record_pos").select("scrape_id", "window_id", F.to_json("record").alias("r")).collect()
    assert list(map(tuple, got)) == [("run-a", 2, '{"v":2}'), ("run-b/east.json", 0, '{"v":3}'), ("run-b/west.json", 0, '{"v":4}')]
    # Spark lists no files without a byte.
    assert [(r["scrape_id"], r["window_id"]) for r in rejects.collect()] == [("run-a", 1)]


def test_payload_files_as_a_stream(spark, tmp_path):
    """The stream gives what the batch gives, also from files that land later."""
    landing = tmp_path / "in"
    landing.mkdir()

    def drained():
        stream = stream_payload_files(spark, str(landing), "s", max_files=1)
        writer = stream.writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/checkpoint")
        writer.trigger(availableNow=True).start(f"{tmp_path}/out").awaitTermination()
        return sorted(map(str, spark.read.schema(PAYLOAD_SCHEMA).parquet(f"{tmp_path}/out").collect()))

    for names in (["a-1.json", "b-2.json"], ["plain.json", "c-3.json"]):
        for name in names:
            (landing / name).write_text(f'[{{"file": "{name}"}}]')
        got = drained()
        batch = read_payload_files(spark, str(landing), "s")
        assert got == sorted(map(str, batch.collect())) and batch.schema.simpleString().startswith("struct<source:string")
    assert len(got) == 4


def test_small_files_share_a_batch(spark, tmp_path, monkeypatch):
    """1,200 small files are one micro-batch; a bound on bytes makes more of them."""
    from payload_metrics.sources import payloads

    (tmp_path / "in").mkdir()
    for i in range(1200):
        (tmp_path / "in" / f"{i}.json").write_text('{"a": 1}')
    for bound, batches in ((None, 1), (8 * 700, 2)):
        if bound:
            monkeypatch.setattr(payloads, "BATCH_BYTES", bound)
        seen = []
        stream = stream_payload_files(spark, f"{tmp_path}/in", "s", "1")
        writer = stream.select("window_id").writeStream.foreachBatch(lambda df, i: seen.append(df.count()))
        writer.option("checkpointLocation", f"{tmp_path}/{bound}").trigger(availableNow=True).start().awaitTermination()
        assert len(seen) == batches and sum(seen) == 1200
