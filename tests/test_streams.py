from __future__ import annotations

import os
import random
import time
import uuid
from datetime import datetime, timezone

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from payload_metrics.operators.dedupe import RECORD_ORDER, fingerprint
from payload_metrics.operators.extract import extract_selected, selected_records, typed_records
from payload_metrics.operators.metrics import metric_points, series_text
from payload_metrics.sources.outputs import FingerprintLog, PointLog
from payload_metrics.sources.payloads import PAYLOAD_SCHEMA, stream_payload_table
from payload_metrics.spec import SourceSpec
from payload_metrics.streaming import streams
from tests.test_dedupe import greedy

TTL = 20
EVENTS = "pos bigint, at bigint, id bigint, kind string"


def make(**parts):
    base = {
        "name": "s",
        "frequency": "5min",
        "scrape": {"type": "instant"},
        "attributes": [{"name": "kind", "dataKey": "kind"}],
        "counterReadings": [{"name": "c"}],
        "deltaDetection": {"enabled": True, "fingerprintMode": "keys", "fingerprintKeys": ["id"], "ttlSeconds": TTL},
    }
    return SourceSpec.from_dict(base | parts)


def typed(df):
    return typed_records(df, "s", "pos", fetched_at=F.timestamp_seconds("at"))


def rows_in_time_order(n, keys, span, seed=1):
    rng = random.Random(seed)
    times = sorted(rng.randrange(1, span) for _ in range(n))
    return [(i, at, rng.randrange(keys), rng.choice("xy")) for i, at in enumerate(times)]


def land(spark, folder, rows, parts=3):
    """Rows as files that a stream reads one by one, in order."""
    size = -(-len(rows) // parts)
    for i in range(0, len(rows), size):
        spark.createDataFrame(rows[i : i + size], EVENTS).coalesce(1).write.mode("append").parquet(folder)


def open_stream(spark, folder):
    return typed(spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).parquet(folder))


def drain(stream, tmp_path):
    out = f"{tmp_path}/{uuid.uuid4().hex}"
    writer = stream.writeStream.format("parquet").option("checkpointLocation", f"{out}-checkpoint")
    writer.trigger(availableNow=True).start(out).awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(out)


@pytest.fixture
def rocksdb(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, streams.ROCKSDB)
    yield
    spark.conf.set(key, before)


def test_exact_dedupe_over_batches(spark, tmp_path, rocksdb):
    rows = rows_in_time_order(120, 5, 300)
    land(spark, f"{tmp_path}/in", rows)
    kept = streams.exact_dedupe(open_stream(spark, f"{tmp_path}/in"), make())
    got = drain(kept.select("record_pos"), tmp_path)
    assert sorted(r[0] for r in got.collect()) == greedy([r[:3] for r in rows], TTL)


def last_emissions(spark, checkpoint):
    """What the state store holds after the last batch."""
    reader = spark.read.format("statestore").option("path", checkpoint).option("stateVarName", "last_emission")
    return {r["key"]["hash"]: r["value"]["at"] for r in reader.load().collect()}


def drain_exact(spark, tmp_path, name):
    kept = streams.exact_dedupe(open_stream(spark, f"{tmp_path}/in"), make(), late="10 seconds")
    writer = kept.select("record_pos").writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/checkpoint")
    writer.trigger(availableNow=True).start(f"{tmp_path}/{name}").awaitTermination()
    return sorted(r[0] for r in spark.read.parquet(f"{tmp_path}/{name}").collect())


def test_state_of_exact_dedupe_goes_after_the_ttl(spark, tmp_path, rocksdb):
    """Fifty keys at first; later batches move the watermark past their TTL."""
    first = [(i, 1 + i % 5, i, "x") for i in range(50)]
    parts = [first, [(50, 30, 0, "x"), (51, 32, 99, "x")], [(52, 100, 99, "y")], [(53, 125, 0, "x"), (54, 127, 99, "y")]]
    want_after = [50, 42, 1, 2]
    checkpoint = f"{tmp_path}/checkpoint"
    for part, want in zip(parts, want_after):
        spark.createDataFrame(part, EVENTS).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        got = drain_exact(spark, tmp_path, "out")
        # A drained stream ends with the watermark 10 s before its newest row: of 51 keys, the 9
        # whose last emission is of second 1 go after the second part.
        assert len(last_emissions(spark, checkpoint)) == want
    # Key 0 comes again 30 s after its emission, key 99 after 68 s and after 27 s.
    assert got == list(range(55))
    assert set(last_emissions(spark, checkpoint).values()) == {125, 127}


def test_late_rows_of_exact_dedupe(spark, tmp_path, rocksdb):
    """A row within the lateness meets its state; a later one is dropped, not emitted again."""
    for part in [[(0, 100, 1, "x")], [(1, 200, 2, "x")], [(2, 195, 2, "x"), (3, 195, 3, "x"), (4, 110, 1, "x")]]:
        spark.createDataFrame(part, EVENTS).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        got = drain_exact(spark, tmp_path, "out")
    assert got == [0, 1, 3]


def test_exact_dedupe_of_rows_without_a_time(spark, tmp_path, rocksdb):
    land(spark, f"{tmp_path}/in", [(0, None, 1, "x"), (1, None, 1, "x"), (2, 5, 2, "x")], parts=1)
    assert drain_exact(spark, tmp_path, "out") == [0, 2]


def test_coarse_dedupe_emits_each_key_of_a_batch_once(spark, tmp_path):
    land(spark, f"{tmp_path}/in", rows_in_time_order(60, 5, 300), parts=1)
    kept = streams.coarse_dedupe(open_stream(spark, f"{tmp_path}/in"), make())
    assert drain(kept.select("hash"), tmp_path).count() == 5


def run_sink(spark, tmp_path, spec, folder):
    sink = streams.table_sink(spec, FingerprintLog(spark, f"{tmp_path}/log"), f"{tmp_path}/out")
    writer = open_stream(spark, folder).writeStream.foreachBatch(sink)
    writer.option("checkpointLocation", f"{tmp_path}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return sink


def test_sink_over_batches_and_a_repeated_batch(spark, tmp_path):
    rows = rows_in_time_order(120, 5, 300, seed=2)
    land(spark, f"{tmp_path}/in", rows)
    sink = run_sink(spark, tmp_path, make(), f"{tmp_path}/in")
    want = greedy([r[:3] for r in rows], TTL)

    def positions():
        logs = spark.read.parquet(f"{tmp_path}/out/log_records")
        pos = F.get_json_object("body", "$.record.pos").cast("bigint").alias("pos")
        return sorted(r[0] for r in logs.select(pos).collect())

    def counted():
        return spark.read.parquet(f"{tmp_path}/out/metric_points").agg(F.sum("value")).first()[0]

    assert positions() == want and counted() == len(want)
    last = rows[80:]
    sink(typed(spark.createDataFrame(last, EVENTS)), 2)
    assert positions() == want and counted() == len(want)


def test_sink_without_dedupe(spark, tmp_path):
    rows = rows_in_time_order(30, 3, 50)
    land(spark, f"{tmp_path}/in", rows)
    run_sink(spark, tmp_path, make(deltaDetection={"enabled": False}), f"{tmp_path}/in")
    assert spark.read.parquet(f"{tmp_path}/out/log_records").count() == 30


def test_stream_extraction_equals_batch(spark, tmp_path):
    spec = make(
        dataKey="d",
        filters={"drop": [{"any": [{"field": "v", "matchType": "equals", "value": 0}]}], "limits": {"maxRecordsPerScrape": 2}},
    )
    texts = ['{"d": [{"v": 0}, {"v": 1}, {"v": 2}, {"v": 3}]}', "bad", '{"d": {"v": 4}}', '{"d": [{"v": 0}]}']
    batch = spark.createDataFrame(
        [("s", "1", i, None, None, None, t) for i, t in enumerate(texts)] + [("t", "1", 9, None, None, None, texts[0])],
        PAYLOAD_SCHEMA,
    )
    batch.write.parquet(f"{tmp_path}/payloads")
    stream = streams.stream_records(stream_payload_table(spark, f"{tmp_path}/payloads"), spec)
    text = F.to_json("record").alias("record")
    got = drain(stream.select("window_id", text), tmp_path)
    want = selected_records(extract_selected(batch.where("source = 's'"), spec)).select("window_id", text)
    assert sorted(got.collect()) == sorted(want.collect()) and want.count() == 3


def test_whole_source_as_a_stream(spark, tmp_path):
    spec = make(dataKey="d", logStatusField={"name": "kind", "error": {"value": "y"}})
    at = [datetime(2025, 1, 1, 0, 0, s, tzinfo=timezone.utc) for s in (0, 10, 30)]
    docs = ['{"d": [{"id": 1, "kind": "x"}, {"id": 2, "kind": "y"}]}', '{"d": [{"id": 1, "kind": "x"}]}', '{"d": {"id": 1, "kind": "x"}}']
    for i, text in enumerate([*docs, "broken"]):
        row = ("s", str(i), 0, None, None, at[min(i, 2)], text)
        spark.createDataFrame([row], PAYLOAD_SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    source = stream_payload_table(spark, f"{tmp_path}/in", max_files=1)
    log, out = FingerprintLog(spark, f"{tmp_path}/log"), f"{tmp_path}/out"
    streams.start(spec, source, log, out, f"{tmp_path}/checkpoint", availableNow=True).awaitTermination()
    logs = spark.read.parquet(f"{out}/log_records")
    # The repeat after 10 s lies within the TTL of 20 s, the one after 30 s does not.
    assert sorted((r["scrape_id"], r["severity_text"]) for r in logs.collect()) == [("0", "ERROR"), ("0", "INFO"), ("2", "INFO")]
    assert [r["snippet"] for r in spark.read.parquet(f"{out}/rejects").collect()] == ["broken"]


def test_rows_are_combined_before_the_shuffle():
    batch = pa.RecordBatch.from_pydict(
        {
            "hash": ["b", "a", "a", "a", "b", "c", "c"],
            "seen_at": [1, 1, 1, 2, 1, 3, 3],
            "fetched_at": [1.5, 1.0, 1.0, 2.0, 1.25, 3.0, None],
            "scrape_id": ["1", "2", "2", "1", "1", "1", "2"],
            "record_pos": [1, 9, 3, 5, 4, 1, 7],
            "x": list("vwxyztu"),
        }
    )
    (out,) = streams._first_per_second(iter([batch]))
    # The time comes before the position, as in batches, and no time comes first.
    assert list(zip(*out.select(["hash", "seen_at", "x"]).to_pydict().values())) == [
        ("a", 1, "x"), ("a", 2, "y"), ("b", 1, "z"), ("c", 3, "u"),
    ]


def test_windowed_metrics_equal_batch(spark, tmp_path):
    rows = rows_in_time_order(200, 5, 600)
    land(spark, f"{tmp_path}/in", rows)
    spec = make(histogramReadings=[{"name": "h", "dataKey": "id", "buckets": [1, 3]}])
    stream = streams.windowed_metrics(open_stream(spark, f"{tmp_path}/in"), spec, "1 minute", "30 seconds")
    columns = ["ts", "metric", F.col("attrs")["kind"].alias("kind"), "value", "count", "sum", F.col("bucket_counts").cast("string").alias("b")]
    got = drain(stream.select(*columns), tmp_path).collect()
    batch = metric_points(typed(spark.createDataFrame(rows, EVENTS)), spec, every="1 minute")
    closed = max(r[1] for r in rows) - 30
    want = batch.where(F.unix_seconds("ts") + 60 <= closed).select(*columns).collect()
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(got, key=key) == sorted(want, key=key) and len(want) > 10


def test_late_rows_are_dropped_by_windows_only(spark, tmp_path):
    parts = [[(0, 10, 1, "x"), (1, 400, 2, "x")], [(2, 20, 3, "x"), (3, 500, 4, "x")], [(4, 30, 5, "x"), (5, 900, 6, "x")]]
    for rows in parts:
        spark.createDataFrame(rows, EVENTS).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        time.sleep(1.1)  # files are read in order of their times
    stream = open_stream(spark, f"{tmp_path}/in")
    points = streams.windowed_metrics(stream, make(), "1 minute", "100 seconds")
    got = drain(points.select(F.unix_seconds("ts").alias("at"), "value"), tmp_path)
    # The watermark is 300 s after the first file. It closes windows at the end of the second
    # batch, which still takes its own late row, and drops late rows from the third on.
    assert {r["at"]: r["value"] for r in got.collect()} == {0: 2.0, 360: 1.0, 480: 1.0}
    run_sink(spark, tmp_path, make(), f"{tmp_path}/in")
    assert spark.read.parquet(f"{tmp_path}/out/log_records").count() == 6


MAPPED = [{"name": "kind", "dataKey": "kind", "asMetric": {"metricName": "score", "valueMapping": {"x": 1, "y": 10}}}, {"name": "id", "dataKey": "id"}]


def point_rows(points):
    columns = ["ts", "metric", series_text(F.col("attrs")).alias("attrs"), "value", "count", "sum", F.col("bucket_counts").cast("string").alias("b")]
    return sorted(map(str, points.select(*columns).collect()))


def test_attribute_metrics_of_windows(spark, tmp_path):
    """In append mode as in batches, for the windows the watermark has passed."""
    rows = rows_in_time_order(60, 3, 300)
    land(spark, f"{tmp_path}/in", rows)
    stream = streams.windowed_metrics(open_stream(spark, f"{tmp_path}/in"), make(attributes=MAPPED), "1 minute", "1 second")
    closed = max(r[1] for r in rows) - 1
    batch = metric_points(typed(spark.createDataFrame(rows, EVENTS)), make(attributes=MAPPED), every="1 minute")
    assert point_rows(drain(stream, tmp_path)) == point_rows(batch.where(F.unix_seconds("ts") + 60 <= closed))


def test_two_sources_of_one_counter_need_foreach_batch(spark, tmp_path):
    land(spark, f"{tmp_path}/in", rows_in_time_order(5, 2, 10), parts=1)
    spec = make(attributes=[MAPPED[0]], counterReadings=[{"name": "score"}])
    with pytest.raises(ValueError, match="score"):
        streams.windowed_metrics(open_stream(spark, f"{tmp_path}/in"), spec, "1 minute", "1 second")


def test_open_windows_equal_batch(spark, tmp_path):
    """Update mode over six batches, folded twice: every window, also those still open."""
    rows = rows_in_time_order(180, 4, 600, seed=5)
    land(spark, f"{tmp_path}/in", rows, parts=6)
    spec = make(attributes=MAPPED, histogramReadings=[{"name": "h", "dataKey": "id", "buckets": [1, 3]}])
    log = PointLog(spark, f"{tmp_path}/points")
    started = streams.start_windows(
        spec, open_stream(spark, f"{tmp_path}/in"), "1 minute", "30 seconds", log, f"{tmp_path}/c", compact_every=2, availableNow=True
    )
    started.awaitTermination()
    batch = metric_points(typed(spark.createDataFrame(rows, EVENTS)), spec, every="1 minute")
    assert point_rows(log.points("s")) == point_rows(batch)
    kept = log.parts("s")
    assert len(kept["snapshot_id"]) == 1 and len(kept["batch_id"]) <= 3
    # A batch that is run again replaces its own states.
    last = max(int(p.rpartition("=")[2]) for p in kept["batch_id"])
    again = log.read("s").where(F.col("batch_id") == last).drop("batch_id")
    streams.window_sink(spec, log, compact_every=2)(spark.createDataFrame(again.collect(), again.schema), last)
    assert point_rows(log.points()) == point_rows(batch)


def test_stream_goes_on_across_compactions(spark, tmp_path):
    """Eight batches in two runs of the stream, the log folded after every second."""
    rows = rows_in_time_order(160, 5, 400, seed=8)
    log = FingerprintLog(spark, f"{tmp_path}/log")
    sink = streams.table_sink(make(), log, f"{tmp_path}/out", compact_every=2)
    for half in (rows[:80], rows[80:]):
        land(spark, f"{tmp_path}/in", half, parts=4)
        writer = open_stream(spark, f"{tmp_path}/in").writeStream.foreachBatch(sink)
        writer.option("checkpointLocation", f"{tmp_path}/checkpoint").trigger(availableNow=True).start().awaitTermination()

    def positions():
        pos = F.get_json_object("body", "$.record.pos").cast("bigint").alias("pos")
        return sorted(r[0] for r in spark.read.parquet(f"{tmp_path}/out/log_records").select(pos).collect())

    want = greedy([r[:3] for r in rows], TTL)
    assert positions() == want
    kept = log.parts("s")
    assert [p.rpartition("=")[2] for p in kept["snapshot_id"]] == ["5"] and len(kept["batch_id"]) == 2
    # The last batch again, and one that was folded already when it failed.
    sink(typed(spark.createDataFrame(rows[140:], EVENTS)), 7)
    assert positions() == want
    sink(typed(spark.createDataFrame(rows[120:140], EVENTS)), 6)
    assert positions() == want


def test_a_new_checkpoint_does_not_replace_old_batches(spark, tmp_path):
    payload = ("s", "1", 0, None, None, datetime(2025, 1, 1, tzinfo=timezone.utc), '[{"id": 1}]')
    spark.createDataFrame([payload], PAYLOAD_SCHEMA).write.parquet(f"{tmp_path}/in")
    source = stream_payload_table(spark, f"{tmp_path}/in")
    log, out = FingerprintLog(spark, f"{tmp_path}/log"), f"{tmp_path}/out"
    for checkpoint in ("a", "a"):
        streams.start(make(), source, log, out, f"{tmp_path}/{checkpoint}", availableNow=True).awaitTermination()
    with pytest.raises(ValueError, match="not of checkpoint"):
        streams.start(make(), source, log, out, f"{tmp_path}/b", availableNow=True)
    points = PointLog(spark, f"{tmp_path}/points")
    records = streams.stream_records(source, make())
    streams.start_windows(make(), records, "1 day", "1 hour", points, f"{tmp_path}/c", availableNow=True).awaitTermination()
    with pytest.raises(ValueError, match="not of checkpoint"):
        streams.start_windows(make(), records, "1 day", "1 hour", points, f"{tmp_path}/d", availableNow=True)
    # Another source may share the tables.
    other = make(name="t")
    streams.start(other, source, log, out, f"{tmp_path}/b", availableNow=True).awaitTermination()


TOUCHES = "source string, hash string, first_seen bigint, last_seen bigint, ttl_seconds bigint"


def test_listing_stays_short(spark, tmp_path):
    """200 batches of two sources, folded every 20: one snapshot and the batches since, and no
    fingerprint that expired long before the newest."""
    log = FingerprintLog(spark, f"{tmp_path}/log")
    for batch in range(200):
        # As ``append`` writes it, without a job.
        os.makedirs(f"{tmp_path}/log/source=s/batch_id={batch}")
        touch = {"hash": [f"h{batch % 150}"], "first_seen": [batch * 100], "last_seen": [batch * 100], "ttl_seconds": [500]}
        pq.write_table(pa.table(touch), f"{tmp_path}/log/source=s/batch_id={batch}/part-0.parquet")
        if batch and batch % 20 == 0:
            log.compact("s", batch, late=1000)
            log.compact("s", batch, late=1000)
    log.append(spark.createDataFrame([("t/u", "x", 5, 5, 10)], TOUCHES), 3, "t/u")
    parts = log.parts()
    assert len(parts["snapshot_id"]) == 1 and len(parts["batch_id"]) == 21
    names = os.listdir(f"{tmp_path}/log/source=s")
    assert len([n for n in names if n.startswith(("batch", "snapshot"))]) == 21
    touched = log.touched(source="s")
    # Those of the last 20 batches, and of the 16 before them whose TTL ended in the last 1,000 s.
    assert sorted(r[0] for r in touched.select("last_seen").collect()) == [b * 100 for b in range(164, 200)]
    assert log.touched(before_batch=185, source="s").count() == 21
    alive = log.touched(source="s", alive_at=18_000)
    assert sorted(r[0] for r in alive.select("last_seen").collect()) == [b * 100 for b in range(175, 200)]
    assert [r["hash"] for r in log.touched(source="t/u").collect()] == ["x"]


def test_half_written_snapshots_do_not_count(spark, tmp_path):
    log = FingerprintLog(spark, f"{tmp_path}/log")
    for batch in range(4):
        log.append(spark.createDataFrame([("s", f"h{batch}", batch, batch, 500)], TOUCHES), batch, "s")
    os.makedirs(f"{tmp_path}/log/source=s/snapshot_id=2/day=1970-01-01")
    assert log.parts("s")["snapshot_id"] == [] and log.touched().count() == 4
    log.compact("s", 3, late=0)
    assert len(log.parts("s")["batch_id"]) == 1 and log.touched().count() == 4
    other = FingerprintLog(spark, f"{tmp_path}/none")
    other.compact("s", 3, late=0)
    assert other.touched().count() == 0


def test_snapshots_are_pruned_by_day(spark, tmp_path):
    log = FingerprintLog(spark, f"{tmp_path}/log")
    day = 86400
    log.append(spark.createDataFrame([("s", f"h{d}", d * day, d * day, 10) for d in range(9)], TOUCHES), 0, "s")
    log.compact("s", 1, late=100 * day)
    alive = log.touched(source="s", alive_at=6 * day)
    plan = alive._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(day" in plan and alive.count() == 3


def test_exact_dedupe_of_cut_records(spark, tmp_path, rocksdb):
    """Records that have a hash may be cut to less than it was made of; whole numbers stay exact
    beside nulls."""
    rows = [*rows_in_time_order(60, 4, 200, seed=3), (2**53 + 1, 500, 9, None)]
    land(spark, f"{tmp_path}/in", rows)
    hashed = fingerprint(open_stream(spark, f"{tmp_path}/in"), make())
    big = F.when(F.col("record.pos") > 100, F.col("record.pos")).alias("big")
    slim = hashed.select("hash", *RECORD_ORDER, F.struct("record.pos", big).alias("record"))
    got = drain(streams.exact_dedupe(slim, make()).select("record.*"), tmp_path).collect()
    assert sorted(r["pos"] for r in got) == greedy([r[:3] for r in rows], TTL)
    assert [r["big"] for r in got if r["big"] is not None] == [2**53 + 1]


def test_a_fingerprint_costs_little_in_python():
    """Most fingerprints have few rows in a batch: 20,000 of them in a few seconds at most."""

    class State:
        value = None

        def get(self):
            return self.value

        def update(self, value):
            self.value = value

    class Handle:
        timers = 0

        def getValueState(self, name, schema):
            return State()

        def registerTimer(self, at):
            self.timers += 1

    row, keeper, handle = Row("seen_at", *RECORD_ORDER), streams._LastEmission(TTL), Handle()
    began, emitted = time.process_time(), []
    for key in range(20_000):
        keeper.init(handle)
        rows = [row(at, None if at == 7 else at, "", pos) for at, pos in ((30, key), (5, 3), (5, 2), (26, 1), (7, 0))]
        emitted.append([r["record_pos"] for r in keeper.handleInputRows((key,), iter(rows), None)])
    assert time.process_time() - began < 10
    # Seconds 7 and 30 lie within the TTL of 5 and 26.
    assert emitted == [[2, 1]] * 20_000 and handle.timers == 20_000


def test_ranges_of_days_in_several_files(spark, tmp_path, monkeypatch):
    """Every batch takes all files of its range and no others, also where a range has fewer rows
    than files; before, a range was one file and so a task."""
    from driver_queries import streams as queries

    monkeypatch.setattr(queries, "ROWS_A_FILE", 4)
    stamp = F.timestamp_seconds(F.lit(1704067200) + F.col("day") * 86400)
    days = [(i, day) for i, day in enumerate([0] * 20 + [9] * 2 + [20] * 26)]
    rows = spark.createDataFrame(days, "event_id bigint, day bigint").withColumn("ts", stamp)
    rows.coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    seen = []

    def batch(df, batch_id):
        found = df.select("day", F.input_file_name().alias("file")).collect()
        seen.append((len({r["file"] for r in found}), sorted(r["day"] for r in found)))

    parts = queries._in_parts(spark, str(tmp_path), [(1, 8), (9, 16), (17, 31)])
    writer = parts.writeStream.foreachBatch(batch).option("checkpointLocation", f"{tmp_path}/c")
    writer.trigger(availableNow=True).start().awaitTermination()
    assert [found for _, found in seen] == [[0] * 20, [9] * 2, [20] * 26]
    assert seen[0][0] > 1 and seen[2][0] > 1
