"""Near duplicates by SimHash: 64-bit fingerprints within a few bits, found by multi-index hashing.

A fingerprint is cut into a high and a low half of 32 bits. If two fingerprints differ in at most
4 bits, their high halves differ in at most 2 or their low halves in at most 1. Both are found by
equality in a table of small Hamming balls: every fingerprint enters the ball of radius 1 around
its high half (two balls of radius 1 meet if the halves differ by 2 bits), its low half itself,
and, as a probe only, the low halves 1 bit away. Entries that meet are verified on all 64 bits.
Only distinct fingerprints enter, so copies cost nothing.

Entries of one key are handled together, a key with many entries in square blocks, and a block
returns the links of a spanning forest only.

Defined cases: null texts count as empty; texts without a word have fingerprint zero and are
linked like any other; repeated rows share a fingerprint; null ids never become a component's
name, so a component of null ids only has a null name. Other columns are never read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from payload_metrics.llm.common import new_folder, text_of
from payload_metrics.llm.components import connected_components
from payload_metrics.sources.tables import stage

HALF = 32
BLOCK = 4096
HASHED_AT_ONCE = 65_536


def fingerprint_of(text: str, shingle_words: int = 4, seed: int = 42) -> int:
    """SimHash over word shingles, repeats included; A-Z in lower case, words by ASCII space."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    ends = np.cumsum(lengths + 1) - 1
    last = max(len(words) - shingle_words + 1, 1)
    starts = (ends - lengths)[:last].tolist()
    stops = ends[min(shingle_words, len(words)) - 1 :].tolist()
    ones = np.zeros(64, dtype=np.int64)
    digest = xxhash.xxh64_intdigest
    for at in range(0, last, HASHED_AT_ONCE):
        pieces = zip(starts[at : at + HASHED_AT_ONCE], stops[at : at + HASHED_AT_ONCE])
        hashes = np.array([digest(joined[a:b], seed) for a, b in pieces], dtype="<u8")
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > last, bitorder="little").view("<u8")[0])


def _fingerprints(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for texts in batches:
        values = np.array([fingerprint_of(text) for text in texts], dtype=np.uint64)
        yield pd.Series(values.view(np.int64))


def fingerprint(text: Column) -> Column:
    """The 64 bits as a signed long."""
    return F.pandas_udf(_fingerprints, "bigint")(F.coalesce(text, F.lit("")))


def as_hex(fingerprint: Column) -> Column:
    return F.lower(F.lpad(F.hex(fingerprint), 16, "0"))


def links(distinct: DataFrame) -> DataFrame:
    """Verified links ``(a, b)`` between distinct fingerprints ``(fp)``: a spanning forest of those
    that share a table key, so the components are those of all pairs within 4 bits."""
    high = F.shiftrightunsigned("fp", HALF)
    low = F.col("fp").bitwiseAND(F.lit((1 << HALF) - 1))
    ball = [F.lit(0).cast("long"), *[F.lit(1 << bit).cast("long") for bit in range(HALF)]]
    around_high = F.array(*[F.struct(F.lit(0).alias("side"), high.bitwiseXOR(b).alias("key"), F.lit(True).alias("owner")) for b in ball])
    around_low = F.array(*[F.struct(F.lit(1).alias("side"), low.bitwiseXOR(b).alias("key"), F.lit(i == 0).alias("owner")) for i, b in enumerate(ball)])
    entries = distinct.select("fp", F.explode(F.concat(around_high, around_low)).alias("e")).select("e.*", "fp")
    met = Window.partitionBy("side", "key")
    entries = entries.withColumn("n", F.count("*").over(met)).withColumn("owners", F.max("owner").over(met))
    # Nearly all keys hold one entry, or probes only, and end here.
    shared = entries.where("n > 1 AND owners")
    ordered = shared.withColumn("block", ((F.row_number().over(met.orderBy("fp")) - 1) / BLOCK).cast("int"))
    blocks = F.sequence(F.lit(0), ((F.col("n") - 1) / BLOCK).cast("int"))
    squares = ordered.select("side", "key", "fp", "owner", "block", F.explode(blocks).alias("other"))
    square = ["side", "key", "upper", "lower"]
    squares = squares.select(
        "side", "key", F.greatest("block", "other").alias("upper"), F.least("block", "other").alias("lower"), "fp", "owner"
    )
    sorted_squares = squares.repartition(*square).sortWithinPartitions(*square)
    return sorted_squares.mapInArrow(_verify, "a long, b long").distinct()


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links within each run of equal keys."""
    rest: pd.DataFrame | None = None
    square = ["side", "key", "upper", "lower"]
    for batch in batches:
        rows = batch.to_pandas()
        rows = rows if rest is None else pd.concat([rest, rows], ignore_index=True)
        if not len(rows):
            continue
        keys = rows[square].to_numpy(dtype=np.int64)
        cuts = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
        if len(cuts):
            yield _linked(rows.iloc[: cuts[-1]], cuts[:-1])
            rows = rows.iloc[cuts[-1] :]
        rest = rows
    if rest is not None:
        yield _linked(rest, np.array([], dtype=int))


def _linked(rows: pd.DataFrame, cuts: np.ndarray) -> pa.RecordBatch:
    found: list[tuple[int, int]] = []
    fps = rows["fp"].to_numpy(dtype=np.int64)
    owners = rows["owner"].to_numpy(dtype=bool)
    bounds = [0, *cuts.tolist(), len(rows)]
    for start, stop in zip(bounds[:-1], bounds[1:]):
        found += forest(fps[start:stop], owners[start:stop])
    a, b = zip(*found) if found else ((), ())
    return pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def forest(fps: np.ndarray, owners: np.ndarray, distance: int = 4) -> list[tuple[int, int]]:
    """Links of a spanning forest of ``fps`` within ``distance`` bits.

    Two probes never link here: they may differ by 2 bits in this half, and their link is found
    at another key.
    """
    parent = list(range(len(fps)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    bits = fps.view(np.uint64)
    found = []
    for i in np.flatnonzero(owners).tolist():
        near = np.flatnonzero(np.bitwise_count(bits ^ bits[i]) <= distance)
        for j in near.tolist():
            a, b = root(i), root(j)
            if a != b:
                parent[max(a, b)] = min(a, b)
                found.append((int(fps[i]), int(fps[j])))
    return found


def components(fingerprinted: DataFrame) -> DataFrame:
    """``(fp, root, component_id)`` for each fingerprint of ``(doc_id, fp)``: the smallest
    fingerprint and the smallest id reachable.

    ``fingerprinted`` is read several times and should be a written table.
    """
    spark = fingerprinted.sparkSession
    path = new_folder(spark, "fingerprints")
    smallest = stage(fingerprinted.groupBy("fp").agg(F.min("doc_id").alias("least")), "fingerprints", path)
    roots = connected_components(links(smallest.select("fp")))
    rooted = smallest.join(roots.withColumnRenamed("node", "fp"), "fp", "left")
    rooted = rooted.withColumn("root", F.coalesce("root", "fp"))
    names = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.select("fp", "root").join(names, "root").select("fp", "root", "component_id")
    # Written, so that the join with all documents can split a fingerprint that many share.
    return stage(named, "components", new_folder(spark, "components"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """``(doc_id, fp, component_id)`` for every row of ``docs``."""
    spark = docs.sparkSession
    rows = docs.select("doc_id", fingerprint(text_of()).alias("fp"))
    rows = stage(rows, "rows", new_folder(spark, "simhash-rows"))
    return rows.join(components(rows), "fp").select("doc_id", "fp", "component_id")


def deduplicate(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each component: the one with the smallest id.

    Of several rows with that id one stays; a component of null ids keeps one row as well.
    """
    # The document travels as one value, so that none of its columns can clash.
    marked = docs.select(
        F.struct("*").alias("doc"), fingerprint(text_of()).alias("fp"), F.monotonically_increasing_id().alias("row")
    )
    rows = stage(marked, "rows", new_folder(docs.sparkSession, "simhash-docs"))
    ids = rows.select("doc.doc_id", "fp", "row")
    named = ids.join(components(ids.select("doc_id", "fp")), "fp")
    # One value orders ids before nulls, and rows of equal ids by their place.
    first = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")
    kept = named.groupBy("root").agg(F.min(first).alias("first")).select("first.row")
    return rows.join(kept, "row", "left_semi").select("doc.*")
