"""Delta detection: fingerprints, TTL probe, and upkeep of the fingerprint table.

A hash covers the source name, so records group on the hash alone; sorts and partitions split
even when one source holds most rows. Repeats of one hash are combined before the shuffle, so a
hash of any frequency reaches its task as one row per map task.

Rows are numbered, in a written table unless they come straight from files. What is grouped, sorted,
scanned and probed are hash, time, order and number only; records are fetched at the end, by the
numbers that are left. Of the store only rows whose hash may be in the batch are shuffled, as a
bitmap of the batch's hashes says.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from payload_metrics.functions.values import sha256
from payload_metrics.operators.fields import fields_of
from payload_metrics.sources.tables import stage
from payload_metrics.spec import DEFAULT_MAX_ENTRIES, DEFAULT_TTL_SECONDS, SourceSpec

FINGERPRINT_SCHEMA = "source string, hash string, first_seen bigint, last_seen bigint, ttl_seconds bigint"
STORE_KEY = ["hash", "source"]
#: Of equal records the first in this order is emitted, in batches, replays and streams alike.
RECORD_ORDER = ["fetched_at", "scrape_id", "record_pos"]
#: The number of a row.
ROW = "_row"
#: Steps of a plan that give the same rows in the same places whenever they run.
REPEATABLE = {"Project", "Filter", "LogicalRelation"}
#: Row numbers that go to every task instead of being shuffled with the records; 16 bytes each.
FETCHED_AT_ONCE = 1_000_000
COUNTED_BYTES = 1 << 28
#: A hash is one of 2**26 bits in the probe's bitmap, which is 8 MB at most, in parts of 4 KB.
BITMAP_BITS, PART_BITS = 26, 15


def fingerprint_text(records: DataFrame, spec: SourceSpec) -> Column:
    """``source:`` plus canonical JSON of the record or of the listed paths, keys sorted."""
    fields = fields_of(records)
    paths = spec.deltaDetection.key_paths
    if not paths:
        body = F.to_json(fields.whole())
    else:
        entries = F.struct(*[fields.key_entry(p).alias(p) for p in paths])
        body = F.to_json(entries, {"ignoreNullFields": "false"})
    return F.concat(F.lit(f"{spec.name}:"), body)


def fingerprint(records: DataFrame, spec: SourceSpec) -> DataFrame:
    return records.withColumn("hash", sha256(fingerprint_text(records, spec)))


def stored_ttl(default: int = DEFAULT_TTL_SECONDS) -> Column:
    """A fingerprint's own TTL; a stored TTL of 0 stands for the default."""
    return F.when(F.col("ttl_seconds") == 0, default).otherwise(F.col("ttl_seconds"))


def live(store: DataFrame, now: int, default_ttl: int = DEFAULT_TTL_SECONDS) -> DataFrame:
    """Fingerprints still within their own TTL; exactly at the TTL counts as seen."""
    return store.where(F.lit(now) - F.col("last_seen") <= stored_ttl(default_ttl))


def numbered(rows: DataFrame, path: str | None = None) -> DataFrame:
    """``rows`` with numbers that the slim passes and the fetch at the end agree on.

    Rows that are read from files and only projected and filtered are numbered by their place, and
    read again at the end: a number stands for a partition and a place in it, which columns and
    retries do not change. All others are written once.
    """
    marked = rows.withColumn(ROW, F.monotonically_increasing_id())
    return marked if _repeatable(rows) else stage(marked, "numbered", path)


def _repeatable(rows: DataFrame) -> bool:
    nodes = [rows._jdf.queryExecution().optimizedPlan()]
    while nodes:
        node = nodes.pop()
        if node.nodeName() not in REPEATABLE or not node.deterministic():
            return False
        nodes += [node.children().apply(i) for i in range(node.children().size())]
    return True


def first_of_batch(hashed: DataFrame) -> DataFrame:
    """One row per fingerprint: the number of its first record in batch order, and ``n_seen``
    records in all."""
    grouped = hashed.groupBy("hash").agg(F.min(F.struct(*RECORD_ORDER, ROW)).alias("_first"), F.count("*").alias("n_seen"))
    return grouped.select("hash", F.col(f"_first.{ROW}").alias(ROW), "n_seen")


def fetch(rows: DataFrame, chosen: DataFrame, path: str | None = None) -> DataFrame:
    """The numbered ``rows`` whose number is in ``chosen``, with its other columns.

    Few numbers are sent to the rows. Many meet them in one shuffle, hashed and not sorted.
    """
    # Large tables are not counted: that would be one more pass over them.
    size = int(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    few = size <= COUNTED_BYTES and rows.count() <= FETCHED_AT_ONCE
    if not few:
        chosen = stage(chosen, "chosen", path)
        few = chosen.count() <= FETCHED_AT_ONCE
    return rows.join(F.broadcast(chosen) if few else chosen.hint("shuffle_hash"), ROW).drop(ROW)


def among(store: DataFrame, hashes: DataFrame) -> DataFrame:
    """Rows of ``store`` whose hash may be in ``hashes``: all that are, and a share of the others of
    at most the number of hashes over 2**26. Nothing of the store is shuffled.
    """
    bit = F.shiftright(F.conv(F.substring("hash", 1, 7), 16, 10).cast("bigint"), 28 - BITMAP_BITS)
    part, place = F.shiftright("_bit", PART_BITS), F.col("_bit").bitwiseAND(F.lit((1 << PART_BITS) - 1))
    bits = hashes.select(bit.alias("_bit")).distinct().select(part.alias("_part"), place.alias("_place"))
    bitmap = bits.groupBy("_part").agg(F.bitmap_construct_agg("_place").alias("_map"))
    probed = store.withColumn("_bit", bit).withColumns({"_part": part, "_place": place})
    probed = probed.join(F.broadcast(bitmap), "_part")
    byte = "CAST(conv(hex(substring(_map, CAST(_place DIV 8 AS INT) + 1, 1)), 16, 10) AS INT)"
    marked = F.expr(f"shiftright({byte}, CAST(_place % 8 AS INT)) & 1 = 1")
    return probed.where(marked).select(*store.columns)


def unseen(firsts: DataFrame, store: DataFrame, spec: SourceSpec, now: int) -> DataFrame:
    """Rows of ``firsts``, a written table, whose fingerprint is not live in the store.

    No broadcast hint: what is left of the store grows with the batch.
    """
    mine = live(store, now, spec.deltaDetection.ttl()).where(F.col("source") == spec.name)
    return firsts.join(among(mine.select("hash"), firsts), "hash", "left_anti")


def dedupe(records: DataFrame, store: DataFrame | None, spec: SourceSpec, now: int) -> DataFrame:
    """Records to emit, with ``hash`` and ``n_seen``; all of them when detection is off.

    Uses the ``hash`` column if the records were fingerprinted before, and their numbers if they
    come from a ``numbered`` table.
    """
    if not spec.deltaDetection.enabled:
        return records
    hashed = records if "hash" in records.columns else fingerprint(records, spec)
    hashed = hashed if ROW in hashed.columns else numbered(hashed)
    firsts = first_of_batch(hashed)
    if store is not None:
        firsts = unseen(stage(firsts, "firsts"), store, spec, now)
    return fetch(hashed, firsts.drop("hash"))


def dedupe_stats(records: DataFrame, kept: DataFrame) -> DataFrame:
    """Hits, misses and total per scrape."""
    scrape = ["source", "scrape_id"]
    total = records.groupBy(*scrape).agg(F.count("*").alias("total"))
    misses = kept.groupBy(*scrape).agg(F.count("*").alias("misses"))
    joined = total.join(misses, scrape, "left")
    found = F.coalesce("misses", F.lit(0).cast("bigint"))
    return joined.select(*scrape, (F.col("total") - found).alias("hits"), found.alias("misses"), "total")


def touches(kept: DataFrame, spec: SourceSpec, now: int | None = None) -> DataFrame:
    """Store rows for emitted records, at ``now`` or at their own ``fetched_at``.

    Suppressed records never refresh their fingerprint.
    """
    seen = F.unix_seconds("fetched_at") if now is None else F.lit(now).cast("bigint")
    return kept.select(
        "source",
        "hash",
        seen.alias("first_seen"),
        seen.alias("last_seen"),
        F.lit(spec.deltaDetection.ttl()).cast("bigint").alias("ttl_seconds"),
    )


def upsert(store: DataFrame, new: DataFrame) -> DataFrame:
    """Store after touches: last touch and its TTL win, ``first_seen`` stays.

    An entry that had expired when it was touched starts afresh. Only BIGINT buffers, so one
    hash aggregation with map-side combine does it, whatever the number of touches per key.
    """
    both = store.withColumn("_new", F.lit(False)).unionByName(new.withColumn("_new", F.lit(True)))
    merged = both.groupBy(*STORE_KEY).agg(
        F.min(F.when(~F.col("_new"), F.col("first_seen"))).alias("_old_first"),
        F.max(F.when(~F.col("_new"), F.col("last_seen") + stored_ttl())).alias("_old_until"),
        F.min(F.when(F.col("_new"), F.col("first_seen"))).alias("_new_first"),
        F.max("last_seen").alias("last_seen"),
        F.max_by("ttl_seconds", "last_seen").alias("ttl_seconds"),
    )
    expired = F.col("_old_until") < F.col("_new_first")
    first_seen = F.when(F.coalesce(expired, F.lit(False)), F.col("_new_first")).otherwise(
        F.least("_old_first", "_new_first")
    )
    return merged.select("source", "hash", first_seen.alias("first_seen"), "last_seen", "ttl_seconds")


def fold_touches(touched: DataFrame) -> DataFrame:
    """One row per fingerprint from its touches of all time, as if each had been upserted.

    ``first_seen`` is that of the last touch which found its fingerprint expired or unknown. A
    fingerprint has at most one touch per TTL, so its touches are bounded by time.
    """
    in_turn = Window.partitionBy(*STORE_KEY).orderBy("last_seen", "first_seen")
    until = F.lag(F.col("last_seen") + stored_ttl()).over(in_turn)
    begins = F.when(until.isNull() | (until < F.col("first_seen")), F.col("first_seen"))
    begun = touched.withColumn("_begins", begins)
    return begun.groupBy(*STORE_KEY).agg(
        F.max("_begins").alias("first_seen"),
        F.max("last_seen").alias("last_seen"),
        F.max_by("ttl_seconds", "last_seen").alias("ttl_seconds"),
    ).select("source", "hash", "first_seen", "last_seen", "ttl_seconds")


def expire(store: DataFrame, now: int) -> DataFrame:
    return store.where(F.col("last_seen") + stored_ttl() >= F.lit(now))


def drop_orphans(store: DataFrame, active: DataFrame) -> DataFrame:
    """Entries of sources that are still configured (``active`` has a ``source`` column)."""
    return store.join(active.select("source").distinct(), "source", "left_semi")


def trim(store: DataFrame, capacity: DataFrame | int = DEFAULT_MAX_ENTRIES) -> DataFrame:
    """The newest N entries of each source; equal ``last_seen`` keeps the lower hash.

    ``capacity`` is one number or a frame ``(source, max_entries)``. A source may hold most of
    the store, so its entries are never ranked in one task. Counts per second find the second
    at which the capacity runs out; counts per hash prefix find the prefix within it; only
    that sliver is ranked.
    """
    limited = _with_capacity(store, capacity)
    by_second = _running(limited, "last_seen", F.col("last_seen").desc())
    cut = by_second.where(
        (F.col("_before") < F.col("max_entries"))
        & (F.col("_before") + F.col("_n") > F.col("max_entries"))
    ).select("source", F.col("last_seen").alias("cut_second"), (F.col("max_entries") - F.col("_before")).alias("room"))
    full = by_second.where(F.col("_before") + F.col("_n") <= F.col("max_entries"))
    oldest_full = full.groupBy("source").agg(F.min("last_seen").alias("full_from"))

    # One row per source: adaptive execution broadcasts them when few, and splits a hot source.
    marks = oldest_full.join(cut, "source", "full_outer")
    marked = store.join(marks, "source", "left")
    newer = marked.where(F.col("last_seen") >= F.col("full_from"))
    tied = marked.where(F.col("last_seen") == F.col("cut_second")).withColumn(
        "_prefix", F.substring("hash", 1, 4)
    )
    room = tied.withColumn("max_entries", F.col("room"))
    by_prefix = _running(room, "_prefix", F.col("_prefix").asc())
    by_prefix = by_prefix.where(F.col("_before") < F.col("max_entries"))
    inside = tied.join(by_prefix.select("source", "_prefix", "_before"), ["source", "_prefix"])
    order = Window.partitionBy("source", "_prefix").orderBy("hash")
    ranked = inside.withColumn("_rank", F.row_number().over(order) + F.col("_before"))
    sliver = ranked.where(F.col("_rank") <= F.col("room"))
    return newer.select(*store.columns).unionByName(sliver.select(*store.columns))


def _with_capacity(store: DataFrame, capacity: DataFrame | int) -> DataFrame:
    if isinstance(capacity, int):
        return store.withColumn("max_entries", F.lit(capacity).cast("bigint"))
    limits = capacity.select("source", F.col("max_entries").cast("bigint"))
    default = F.lit(DEFAULT_MAX_ENTRIES).cast("bigint")
    return store.join(limits, "source", "left").withColumn(
        "max_entries", F.coalesce("max_entries", default)
    )


def _running(df: DataFrame, step: str, order: Column) -> DataFrame:
    """Entries per source and step, and how many come before each step."""
    counts = df.groupBy("source", step).agg(
        F.count("*").alias("_n"), F.max("max_entries").alias("max_entries")
    )
    before = Window.partitionBy("source").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    total = F.coalesce(F.sum("_n").over(before), F.lit(0).cast("bigint"))
    return counts.withColumn("_before", total)


def replay(
    hashed: DataFrame, ttl_seconds: int, store: DataFrame | None = None, now: int | None = None, folder: str | None = None
) -> DataFrame:
    """Dedupe of a whole time-stamped history in one job, as if each batch ran at ``fetched_at``.

    A fingerprint is emitted when first met and again once more than the TTL has passed since
    its last emission. The newest touch in ``store`` is the emission to start from, with the TTL
    stored there; rows at or before it are suppressed. A row without a time has the time ``now``,
    or lies before all others. Same-second repeats are combined first, so a fingerprint has at
    most one row per second of history, and a sorted scan streams those rows with a constant state.
    Tables are written in ``folder``, if given.
    """
    numbers, chosen = (f"{folder}/numbered", f"{folder}/chosen") if folder else (None, None)
    hashed = hashed if ROW in hashed.columns else numbered(hashed, numbers)
    unknown = F.lit(0 if now is None else now).cast("bigint")
    timed = hashed.withColumn("seen_at", F.coalesce(F.unix_seconds("fetched_at"), unknown))
    firsts = timed.groupBy("hash", "seen_at").agg(F.min(F.struct(*RECORD_ORDER, ROW)).alias("_first"))
    ttl = F.lit(ttl_seconds).cast("bigint")
    moments = firsts.select("hash", "seen_at", F.lit(True).alias("new"), ttl.alias("ttl"), F.col(f"_first.{ROW}").alias(ROW))
    if store is not None:
        # Only fingerprints of the history; the store may hold many more.
        met = among(store, hashed.select("hash"))
        past = met.groupBy("hash").agg(
            F.max("last_seen").alias("seen_at"), F.max_by(stored_ttl(ttl_seconds), "last_seen").alias("ttl")
        )
        past = past.select("hash", "seen_at", F.lit(False).alias("new"), "ttl")
        moments = moments.unionByName(past, allowMissingColumns=True)
    ordered = moments.repartition("hash").sortWithinPartitions("hash", "new", "seen_at")
    emitted = ordered.mapInArrow(_emitted, moments.schema)
    return fetch(hashed, emitted.where("new").select(ROW), chosen)


def _emitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Scan of batches sorted by ``(hash, new, seen_at)``; remembers only until when the last
    emission suppresses others."""
    last_hash, last_until = None, 0
    for batch in batches:
        if batch.num_rows == 0:
            continue
        hashes = batch["hash"].to_numpy(zero_copy_only=False)
        times = batch["seen_at"].to_numpy(zero_copy_only=False)
        until = times + batch["ttl"].to_numpy(zero_copy_only=False)
        starts = np.concatenate(([0], np.flatnonzero(hashes[1:] != hashes[:-1]) + 1))
        ends = np.append(starts[1:], len(hashes))
        keep = np.zeros(len(hashes), dtype=bool)
        # The first row of a fingerprint is emitted; only longer runs need the scan, and the
        # first run, which may continue the batch before.
        keep[starts[1:]] = True
        longer = np.flatnonzero(ends - starts > 1)
        for run in longer if len(longer) and longer[0] == 0 else [0, *longer]:
            at, end = starts[run], ends[run]
            if run == 0 and hashes[0] == last_hash:
                at += np.searchsorted(times[:end], last_until, side="right")
            while at < end:
                keep[at] = True
                at += 1 + np.searchsorted(times[at + 1 : end], until[at], side="right")
        tail = np.flatnonzero(keep[starts[-1] :])
        if len(tail):
            last_until = until[starts[-1] + tail[-1]]
        last_hash = hashes[-1]
        yield batch.filter(pa.array(keep))
