from __future__ import annotations

import hashlib
import json
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from payload_metrics.operators import dedupe as d
from payload_metrics.operators.extract import typed_records
from payload_metrics.sources import tables
from payload_metrics.sources.outputs import FingerprintLog
from payload_metrics.spec import SourceSpec


def make(**delta):
    base = {"name": "s", "frequency": "1h", "scrape": {"type": "instant"}}
    return SourceSpec.from_dict(base | {"deltaDetection": {"enabled": True} | delta})


BY_ID = {"fingerprintMode": "keys", "fingerprintKeys": ["id"]}


def records(spark, rows, schema="pos bigint, at bigint, id bigint, status string"):
    df = spark.createDataFrame(rows, schema)
    return typed_records(df, "s", "pos", fetched_at=F.timestamp_seconds("at"))


def store(spark, rows):
    return spark.createDataFrame(rows, d.FINGERPRINT_SCHEMA)


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def positions(df):
    return sorted(r[0] for r in df.select("record_pos").collect())


def test_fingerprint_text(spark):
    rec = spark.createDataFrame([('{"b": [1, {"z": null, "y": "é"}], "a": null, "n": {"k": 2}}',)], "t string")
    dynamic = rec.select(F.parse_json("t").alias("record"))
    whole = '{"a":null,"b":[1,{"y":"é","z":null}],"n":{"k":2}}'
    keys = '{"a":null,"n.k":2,"none":null}'
    full, by_keys = make(), make(fingerprintMode="keys", fingerprintKeys=["none", "n.k", "a", "a"])
    assert dynamic.select(d.fingerprint_text(dynamic, full)).first()[0] == f"s:{whole}"
    assert dynamic.select(d.fingerprint_text(dynamic, by_keys)).first()[0] == f"s:{keys}"
    assert d.fingerprint(dynamic, full).first()["hash"] == digest(f"s:{whole}")
    no_keys = make(fingerprintMode="keys", fingerprintKeys=[])
    assert d.fingerprint(dynamic, no_keys).first()["hash"] == digest(f"s:{whole}")


def test_typed_and_dynamic_fingerprints_agree(spark):
    rec = spark.createDataFrame([(1, "x", None)], "id bigint, t string, gone string")
    typed = rec.select(F.struct("*").alias("record"))
    dynamic = rec.select(F.parse_json(F.lit('{"id":1,"t":"x","gone":null}')).alias("record"))
    for spec in (make(), make(fingerprintMode="keys", fingerprintKeys=["t", "id", "gone"])):
        assert d.fingerprint(typed, spec).first()["hash"] == d.fingerprint(dynamic, spec).first()["hash"]


def test_first_of_a_batch_wins(spark):
    batch = records(spark, [(0, 5, 1, "ok"), (1, 5, 1, "changed"), (2, 5, 2, "ok")])
    kept = d.dedupe(batch, store(spark, []), make(**BY_ID), 100)
    assert positions(kept) == [0, 2]
    assert sorted(r[0] for r in kept.select("n_seen").collect()) == [1, 2]
    stats = d.dedupe_stats(batch, kept).first()
    assert (stats["hits"], stats["misses"], stats["total"]) == (1, 2, 3)


def test_full_record_mode_sees_every_field(spark):
    batch = records(spark, [(0, 5, 1, "ok"), (1, 5, 1, "ok")])
    assert positions(d.dedupe(batch, None, make(), 100)) == [0, 1]


@pytest.mark.parametrize(("age", "ttl", "kept"), [(10, 10, []), (11, 10, [0]), (0, 10, []), (500, 1000, []), (60, 0, []), (61, 0, [0])])
def test_ttl_of_the_stored_row_decides(spark, age, ttl, kept):
    spec = make(ttlSeconds=60, **BY_ID)
    seen = store(spark, [("s", digest('s:{"id":1}'), 0, 1000 - age, ttl)])
    batch = records(spark, [(0, 5, 1, "ok")])
    assert positions(d.dedupe(batch, seen, spec, 1000)) == kept


def test_other_sources_do_not_count(spark):
    seen = store(spark, [("other", digest('s:{"id":1}'), 0, 1000, 60)])
    assert positions(d.dedupe(records(spark, [(0, 5, 1, "ok")]), seen, make(**BY_ID), 1000)) == [0]


def test_disabled_passes_everything(spark):
    batch = records(spark, [(0, 5, 1, "ok"), (1, 5, 1, "ok")])
    kept = d.dedupe(batch, None, make(enabled=False), 0)
    assert positions(kept) == [0, 1]
    stats = d.dedupe_stats(batch, kept).first()
    assert (stats["hits"], stats["misses"], stats["total"]) == (0, 2, 2)


def test_hits_do_not_refresh(spark):
    """The same record every 6 s with TTL 10 is emitted at 0, 12, 24."""
    spec, log, emitted = make(ttlSeconds=10, **BY_ID), store(spark, []), []
    for now in range(0, 30, 6):
        kept = d.dedupe(records(spark, [(0, now, 1, "ok")]), log, spec, now)
        if kept.count():
            emitted.append(now)
            log = store(spark, d.upsert(log, d.touches(kept, spec, now)).select("source", "hash", "first_seen", "last_seen", "ttl_seconds").collect())
    assert emitted == [0, 12, 24]


def test_upsert(spark):
    old = store(spark, [("s", "live", 1, 90, 20), ("s", "gone", 1, 50, 20), ("s", "idle", 1, 10, 5)])
    new = store(spark, [("s", "live", 100, 100, 30), ("s", "gone", 100, 100, 30), ("s", "new", 100, 100, 30)])
    got = {r["hash"]: (r["first_seen"], r["last_seen"], r["ttl_seconds"]) for r in d.upsert(old, new).collect()}
    assert got == {"live": (1, 100, 30), "gone": (100, 100, 30), "idle": (1, 10, 5), "new": (100, 100, 30)}


def test_expire_keeps_the_boundary(spark):
    rows = [("s", "a", 0, 90, 10), ("s", "b", 0, 89, 10)]
    assert [r["hash"] for r in d.expire(store(spark, rows), 100).collect()] == ["a"]


def test_orphans(spark):
    rows = [("keep", "a", 0, 1, 1), ("drop", "b", 0, 1, 1)]
    active = spark.createDataFrame([("keep",)], "source string")
    assert [r["source"] for r in d.drop_orphans(store(spark, rows), active).collect()] == ["keep"]
    assert d.drop_orphans(store(spark, rows), active.limit(0)).count() == 0


def test_trim_against_sorting(spark):
    rng = random.Random(3)
    rows = []
    for source, n in (("few", 3), ("exact", 20), ("many", 90), ("same", 70)):
        for i in range(n):
            last = 50 if source == "same" else rng.randrange(12)
            rows.append((source, digest(f"{source}{i}"), 0, last, 60))
    limits = {"few": 20, "exact": 20, "many": 31, "same": 20}
    want = set()
    for source, limit in limits.items():
        mine = sorted((r for r in rows if r[0] == source), key=lambda r: (-r[3], r[1]))
        want |= {r[1] for r in mine[:limit]}
    capacity = spark.createDataFrame(list(limits.items()), "source string, max_entries bigint")
    got = [r["hash"] for r in d.trim(store(spark, rows), capacity).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert d.trim(store(spark, rows), 1000).count() == len(rows)
    assert d.trim(store(spark, rows), 1).count() == 4


def greedy(rows, ttl):
    """Rows ``(pos, at, id)`` in order; emitted positions by the plain rule."""
    last, out = {}, []
    for pos, at, key in sorted(rows, key=lambda r: (r[1], r[0])):
        if key not in last or at - last[key] > ttl:
            last[key] = at
            out.append(pos)
    return sorted(out)


@pytest.mark.parametrize(("ttl", "keys", "span"), [(5, 3, 60), (0, 2, 20), (40, 6, 400), (1000, 2, 50)])
def test_replay_against_a_loop(spark, ttl, keys, span):
    rng = random.Random(ttl)
    rows = [(i, rng.randrange(span), rng.randrange(keys)) for i in range(300)]
    batch = records(spark, [(p, at, k, "x") for p, at, k in rows])
    spec = make(**BY_ID)
    assert positions(d.replay(d.fingerprint(batch, spec), ttl)) == greedy(rows, ttl)


def test_replay_starts_from_the_newest_stored_touch(spark):
    """The stored TTL counts, and rows at or before the stored emission are suppressed."""
    rng = random.Random(21)
    rows = [(i, rng.randrange(300), rng.randrange(5)) for i in range(200)]
    spec = make(ttlSeconds=20, **BY_ID)
    hashed = d.fingerprint(records(spark, [(p, at, k, "x") for p, at, k in rows]), spec)
    ids = {r["hash"]: r["id"] for r in hashed.select("hash", "record.id").distinct().collect()}
    stored = {0: (100, 90), 1: (150, 0), 2: (10, 400)}
    touched = [("s", h, 0, stored[k][0], stored[k][1]) for h, k in ids.items() if k in stored]
    touched += [("s", h, 0, 5, 10_000) for h, k in ids.items() if k in stored]
    until = {k: at + (ttl or 20) for k, (at, ttl) in stored.items()}
    expected = greedy([r for r in rows if r[1] > until.get(r[2], -1)], 20)
    assert positions(d.replay(hashed, 20, store(spark, touched))) == expected


def test_replay_of_rows_without_a_time(spark):
    rows = [(0, None, 1, "x"), (1, 10, 1, "x"), (2, 1000, 1, "x"), (3, None, 2, "x")]
    df = spark.createDataFrame(rows, "pos bigint, at bigint, id bigint, status string")
    batch = typed_records(df, "s", "pos", fetched_at=F.timestamp_seconds("at"))
    hashed = d.fingerprint(batch, make(**BY_ID))
    assert positions(d.replay(hashed, 20)) == [0, 2, 3]
    assert positions(d.replay(hashed, 20, now=1015)) == [1, 2, 3]


def test_replay_in_parts_equals_replay_at_once(spark):
    rng = random.Random(11)
    rows = sorted((rng.randrange(200), i) for i in range(200))
    rows = [(i, at, i % 4) for i, (at, _) in enumerate(rows)]
    spec = make(ttlSeconds=13, **BY_ID)
    seen, got = store(spark, []), []
    for part in (rows[:70], rows[70:71], rows[71:]):
        hashed = d.fingerprint(records(spark, [(p, at, k, "x") for p, at, k in part]), spec)
        kept = d.replay(hashed, 13, seen)
        got += positions(kept)
        seen = store(spark, [*seen.collect(), *d.touches(kept, spec).collect()])
    assert sorted(got) == greedy(rows, 13)


def test_scan_carries_state_over_batches():
    hashes, times = list("aaaaaabbc"), [1, 2, 6, 7, 12, 20, 3, 9, 9]
    batch = pa.RecordBatch.from_pydict({"hash": hashes, "seen_at": times, "ttl": [5] * 9})
    for size in (1, 2, 3, 9):
        parts = [batch.slice(i, size) for i in range(0, len(hashes), size)]
        out = pa.Table.from_batches(d._emitted(iter(parts))).to_pydict()
        assert list(zip(out["hash"], out["seen_at"])) == [("a", 1), ("a", 7), ("a", 20), ("b", 3), ("b", 9), ("c", 9)]


def test_replay_of_dynamic_records(spark):
    texts = [(i, f'{{"id": {i % 2}, "n": {{"deep": [{i}]}}}}') for i in range(6)]
    df = spark.createDataFrame(texts, "i bigint, t string").select(
        F.lit("s").alias("source"), F.lit("1").alias("scrape_id"), F.timestamp_seconds(F.col("i") * 10).alias("fetched_at"),
        F.col("i").alias("record_pos"), F.parse_json("t").alias("record"),
    )
    kept = d.replay(d.fingerprint(df, make(**BY_ID)), 25)
    got = sorted(r[0] for r in kept.select(F.to_json("record")).collect())
    assert got == sorted(f'{{"id":{i % 2},"n":{{"deep":[{i}]}}}}' for i in (0, 1, 4, 5))


def test_hot_fingerprint(spark):
    """One fingerprint with most of the rows: the scan sees one row per second of it."""
    batch = spark.range(200_000).select(
        F.col("id").alias("pos"), (F.col("id") % 600).alias("at"),
        F.when(F.col("id") % 3 > 0, F.lit(-1)).otherwise(F.col("id")).alias("id"), F.lit("x").alias("status"),
    )
    hashed = d.fingerprint(typed_records(batch, "s", "pos", fetched_at=F.timestamp_seconds("at")), make(**BY_ID))
    kept = d.replay(hashed, 100).groupBy((F.col("record.id") == -1).alias("hot")).count()
    assert {r["hot"]: r["count"] for r in kept.collect()} == {True: 6, False: 66667}
    firsts = d.dedupe(hashed, None, make(**BY_ID), 0)
    assert firsts.where("record.id = -1").select("n_seen").first()[0] == 133333


def test_fingerprint_log(spark, tmp_path):
    log = FingerprintLog(spark, f"{tmp_path}/log")
    assert log.touched().count() == 0
    log.append(store(spark, [("s", "a", 1, 1, 5), ("t", "b", 1, 1, 5)]), 0, "s")
    log.append(store(spark, [("t", "b", 1, 1, 5)]), 0, "t")
    log.append(store(spark, [("s", "a", 9, 9, 5)]), 1, "s")
    log.append(store(spark, [("s", "a", 9, 9, 5)]), 1, "s")
    assert log.touched().count() == 3
    assert log.touched(before_batch=1).count() == 2
    folded = {r["hash"]: (r["first_seen"], r["last_seen"]) for r in log.snapshot().collect()}
    assert folded == {"a": (9, 9), "b": (1, 1)}
    again = log.compacted(d.trim(log.snapshot(), 10), f"{tmp_path}/next", 1)
    assert FingerprintLog(spark, f"{tmp_path}/next").touched().count() == again.touched().count() == 2


def test_json_numbers_hash_by_value(spark):
    texts = ['{"v": 1.50}', '{"v":1.5}']
    df = spark.createDataFrame([(t,) for t in texts], "t string").select(F.parse_json("t").alias("record"))
    assert d.fingerprint(df, make()).select("hash").distinct().count() == 1
    assert json.loads(texts[0]) == json.loads(texts[1])


def carriers(plan, column):
    """Aggregates, sorts, exchanges and Python steps of a physical plan whose output has the column."""
    out, stack = [], [plan]
    while stack:
        node = stack.pop()
        name = node.nodeName()
        if name == "AdaptiveSparkPlan":
            stack.append(node.initialPlan())
        columns = [node.output().apply(i).name() for i in range(node.output().size())]
        if column in columns and any(k in name for k in ("Aggregate", "Sort", "Exchange", "Arrow", "Window")):
            out.append(name)
        stack += [node.children().apply(i) for i in range(node.children().size())]
    return out


def plan_of(df):
    return df._jdf.queryExecution().executedPlan()


def steps_of_jobs(spark, monkeypatch, work):
    """Plans of all tables that are written while ``work`` runs, and of what it returns."""
    plans = []

    def noted(df, name, path=None):
        plans.append(plan_of(df))
        return tables.stage(df, name, path)

    monkeypatch.setattr(d, "stage", noted)
    return [*plans, plan_of(work())]


@pytest.mark.parametrize("at_once", [1_000_000, 0])
def test_records_are_fetched_at_the_end(spark, monkeypatch, at_once):
    """No aggregate, sort or Arrow step carries the record; past the broadcast one exchange does."""
    monkeypatch.setattr(d, "FETCHED_AT_ONCE", at_once)
    spec = make(ttlSeconds=20, **BY_ID)
    batch = d.numbered(d.fingerprint(records(spark, [(i, i, i % 7, "x") for i in range(100)]), spec))
    seen = store(spark, [("s", "a" * 64, 1, 1, 20)])
    for work in (
        lambda: d.dedupe(batch, None, spec, 0),
        lambda: d.dedupe(batch, seen, spec, 0),
        lambda: d.replay(batch, 20, seen),
    ):
        plans = steps_of_jobs(spark, monkeypatch, work)
        found = [name for plan in plans for name in carriers(plan, "record")]
        assert found == ([] if at_once else ["Exchange"])


def test_rows_from_files_are_numbered_without_a_copy(spark, monkeypatch, tmp_path):
    """Both passes read the files; with a shuffle or a random column below, the rows are written."""
    rng = random.Random(5)
    rows = [(i, rng.randrange(400), rng.randrange(40), f"text {i}") for i in range(3000)]
    schema = "pos bigint, at bigint, id bigint, status string"
    spark.createDataFrame(rows, schema).repartition(7).write.parquet(f"{tmp_path}/in")
    read = spark.read.parquet(f"{tmp_path}/in")
    files = typed_records(read.where("id < 35"), "s", "pos", fetched_at=F.timestamp_seconds("at"))
    hashed = d.fingerprint(files, make(**BY_ID))
    written = []
    monkeypatch.setattr(d, "stage", lambda df, name, path=None: written.append(name) or tables.stage(df, name, path))
    few = [r[:3] for r in rows if r[2] < 35]
    assert positions(d.replay(hashed, 20)) == greedy(few, 20)
    firsts = {}
    for pos, at, key in few:
        firsts[key] = min(firsts.get(key, (at, pos)), (at, pos))
    kept = d.dedupe(hashed, None, make(**BY_ID), 0)
    assert positions(kept) == sorted(p for _, p in firsts.values()) and written == []
    assert sorted(r["status"] for r in kept.select("record.status").collect()) == sorted(f"text {p}" for _, p in firsts.values())
    assert carriers(plan_of(kept), "record") == []
    for other in (hashed.repartition(3), hashed.withColumn("x", F.rand()), hashed.unionByName(hashed)):
        d.numbered(other)
    assert written == ["numbered"] * 3


def test_store_is_filtered_before_it_is_shuffled(spark):
    spec = make(ttlSeconds=20, **BY_ID)
    batch = d.numbered(d.fingerprint(records(spark, [(i, i, i, "x") for i in range(100)]), spec))
    hashes = sorted(r["hash"] for r in batch.collect())
    big = spark.range(50_000).select(
        F.lit("s").alias("source"), F.sha2(F.col("id").cast("string"), 256).alias("hash"),
        *[F.lit(v).cast("bigint").alias(c) for c, v in (("first_seen", 90), ("last_seen", 90), ("ttl_seconds", 20))],
    )
    touched = big.unionByName(store(spark, [("s", h, 90, 90, 20) for h in hashes[:30]]))
    left = d.among(touched, batch.select("hash"))
    got = [r["hash"] for r in left.collect()]
    # Everything that is met passes; of the rest about 100 in 2**26 would.
    assert set(hashes[:30]) <= set(got) and len(got) <= 35
    assert "Exchange" not in [n for n in carriers(plan_of(left), "ttl_seconds") if "Broadcast" not in n]
    assert sorted(r["hash"] for r in d.dedupe(batch, touched, spec, 100).collect()) == hashes[30:]


@pytest.mark.parametrize("seed", range(3))
def test_bitmap_lets_all_members_pass(spark, seed):
    """Hashes at the ends of the range and in between."""
    rng = random.Random(seed)
    some = ["0" * 64, "f" * 64, *[f"{rng.getrandbits(256):064x}" for _ in range(500)]]
    members = spark.createDataFrame([(h,) for h in some], "hash string")
    others = [f"{rng.getrandbits(256):064x}" for _ in range(500)]
    both = spark.createDataFrame([(h, i) for i, h in enumerate(some + others)], "hash string, i int")
    got = {r["hash"] for r in d.among(both, members).collect()}
    assert set(some) <= got and len(got) < len(some) + 5
    assert d.among(both, members.limit(0)).count() == 0
