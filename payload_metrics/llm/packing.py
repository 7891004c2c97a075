"""Best-fit packing planned on a histogram of lengths.

The number of pieces of each length fits on one page, however many documents there are, so the
plan is made over counts: lengths from long to short, each placed as often as it occurs into the
fullest bins that take it. Bins of equal content are one group with a count, and a placement
splits at most one group. The plan says which ranks of a length go to which bins of a group at
which offset. Every piece gets a rank within its length, planned slots become one row each, and
pieces take their slots by a join on length and rank.

Defined cases: null and empty texts are documents of the end token alone; a repeated document is
packed again; ties between equal lengths are broken by id, piece and content; an empty table
gives an empty result; other columns are never read.
"""

from __future__ import annotations

import bisect
import os
import re
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from payload_metrics.llm.common import new_folder, text_of
from payload_metrics.sources.tables import stage

CAPACITY = 4096
END_ID = 1
REMEMBERED = 400_000
#: Letters that are their own normal form, with a stop or comma of their own piece.
PLAIN = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([.,]?)")
#: Pieces per salt when ranks within a length are counted.
RANKED_TOGETHER = 100_000
#: Slots of one plan row that become rows together.
SLOTS_TOGETHER = 10_000
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def _words(text: str) -> list[str]:
    """Split at white space; four separators that only Python takes for it stay in their words."""
    if any(separator in text for separator in "\x1c\x1d\x1e\x1f"):
        return re.findall(r"[^ \t\r\n]+", text)
    return text.split()


class _Words(dict):
    """Ids of words as bytes; unknown words are looked up in ``old``, then tokenized."""

    def __init__(self, tokenizer, old: dict[str, bytes]):
        self._tokenizer, self._pieces, self.old = tokenizer, tokenizer.model.tokenize, old

    def __missing__(self, word: str) -> bytes:
        found = self.old.get(word)
        if found is None:
            found = self._ids(word)
        self[word] = found
        return found

    def _ids(self, word: str) -> bytes:
        if (match := PLAIN.fullmatch(word)) is None:
            return np.array(self._tokenizer.encode(word, add_special_tokens=False).ids, dtype="<u4").tobytes()
        letters, stop = match.groups()
        if stop or not letters.islower():
            return self[letters.lower()] + (self[stop] if stop else b"")
        return b"".join([piece.id.to_bytes(4, "little") for piece in self._pieces(letters.translate(BYTE_LETTERS))])


def _byte_letters() -> dict[int, str]:
    """How the tokenizer's model writes the bytes of the letters beyond ASCII."""
    from tokenizers.pre_tokenizers import ByteLevel

    written = ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str
    return {ord(c): written(c)[0][0] for c in map(chr, range(0xDF, 0x100)) if PLAIN.fullmatch(c)}


os.environ["TOKENIZERS_PARALLELISM"] = "false"
BYTE_LETTERS = _byte_letters()


class WordTokenizer:
    """Ids of a text as little-endian 32-bit numbers, from the ids of its words.

    The tokenizer drops white space and never joins across it, so the ids of a text are those
    of its words, one after the other. Words of late are remembered. Plain words skip the
    tokenizer's normal forms and patterns, which leave them as they are, and go to its model.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        self._known = _Words(self._tokenizer, {})

    def ids(self, text: str) -> bytes:
        if len(self._known) > REMEMBERED:
            old, self._known.old = dict(self._known), {}
            self._known = _Words(self._tokenizer, old)
        return b"".join(map(self._known.__getitem__, _words(text)))


_tokenizers: dict[str, WordTokenizer] = {}


def _cut(path: str, capacity: int, with_ids: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    end = np.array([END_ID], dtype="<u4").tobytes()
    names = ["doc_id", "piece", "start", "length", "ids_crc32", *(["ids"] if with_ids else [])]
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), *([pa.binary()] if with_ids else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _tokenizers:
            _tokenizers[path] = WordTokenizer(path)
        tokenizer = _tokenizers[path]
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                some = batch.slice(at, 1000)
                rows = []
                for doc_id, text in zip(some["doc_id"].to_pylist(), some["text"].to_pylist()):
                    ids = tokenizer.ids(text) + end
                    for piece, start in enumerate(range(0, len(ids) // 4, capacity)):
                        own = ids[4 * start : 4 * (start + capacity)]
                        row = (doc_id, piece, start, len(own) // 4, zlib.crc32(own))
                        rows.append((*row, own) if with_ids else row)
                columns = zip(*rows) if rows else [[] for _ in names]
                yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

    return run


def tokenize(docs: DataFrame, path: str, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """Pieces of at most ``capacity`` ids, each document with an end token; ``ids`` as binary."""
    texts = docs.select(F.col("doc_id").cast("long"), text_of().alias("text"))
    schema = PIECES + (", ids binary" if with_ids else "")
    return texts.mapInArrow(_cut(path, capacity, with_ids), schema)


@dataclass
class Bins:
    """``count`` bins with equal content: ``items`` holds (length, per bin, first rank, offset)."""

    count: int
    room: int
    items: list[tuple[int, int, int, int]] = field(default_factory=list)


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[Bins]:
    """Best-fit decreasing over counts.

    Within a group the bins of one placement take consecutive ranks: bin b of the group holds
    ranks ``first + b * per_bin`` to ``first + (b + 1) * per_bin - 1`` of that length.
    """
    by_room: dict[int, list[Bins]] = {}
    rooms: list[int] = []
    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0
        at = bisect.bisect_left(rooms, length)
        while left:
            if at < len(rooms):
                room = rooms[at]
                group = by_room[room].pop()
                if not by_room[room]:
                    del by_room[room], rooms[at]
            else:
                group = Bins(-(-left // (capacity // length)), capacity)
            # Once in a bin, equal lengths fit best into that bin until it is full.
            per_bin = min(group.room // length, left)
            filled = min(group.count, left // per_bin)
            parts = [(filled, per_bin)]
            if filled < group.count and left - filled * per_bin:
                parts.append((1, left - filled * per_bin))
            taken = 0
            for count, each in parts:
                offset = capacity - group.room
                part = Bins(count, group.room - each * length, [*group.items, (length, each, rank, offset)])
                part.items = _shifted(part.items[:-1], taken) + part.items[-1:]
                rank += count * each
                left -= count * each
                taken += count
                _add(by_room, rooms, part)
            if taken < group.count and group.items:
                _add(by_room, rooms, Bins(group.count - taken, group.room, _shifted(group.items, taken)))
            at = bisect.bisect_left(rooms, length)
    return [group for groups in by_room.values() for group in groups]


def _shifted(items: list[tuple[int, int, int, int]], bins: int) -> list[tuple[int, int, int, int]]:
    """The items of a group without its first ``bins`` bins."""
    return [(length, each, rank + bins * each, offset) for length, each, rank, offset in items]


def _add(by_room: dict[int, list[Bins]], rooms: list[int], group: Bins) -> None:
    if group.room not in by_room:
        bisect.insort(rooms, group.room)
    by_room.setdefault(group.room, []).append(group)


def plan_rows(groups: list[Bins]) -> Iterator[tuple[int, int, int, int, int, int]]:
    """(length, first rank, bins, per bin, first sequence, offset) for every placement."""
    sequence = 0
    for group in groups:
        for length, each, rank, offset in group.items:
            for at in range(0, group.count, SLOTS_TOGETHER):
                bins = min(SLOTS_TOGETHER, group.count - at)
                yield length, rank + at * each, bins, each, sequence + at, offset
        sequence += group.count


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` (a written table) with ``sequence_id`` and ``offset``."""
    spark = pieces.sparkSession
    histogram = {r.length: r.n for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    total = sum(histogram.values())
    schema = "length long, first_rank long, bins long, each long, first_sequence long, first_offset long"
    rows = list(plan_rows(plan(histogram, capacity)))
    planned = spark.createDataFrame(rows, schema)
    slots = planned.repartition(spark.sparkContext.defaultParallelism).select(
        "length",
        "first_rank",
        "each",
        "first_sequence",
        "first_offset",
        F.explode(F.sequence(F.lit(0), F.col("bins") * F.col("each") - 1)).alias("i"),
    )
    slots = slots.select(
        "length",
        (F.col("first_rank") + F.col("i")).alias("rank"),
        (F.col("first_sequence") + F.floor(F.col("i") / F.col("each"))).alias("sequence_id"),
        (F.col("first_offset") + F.col("i") % F.col("each") * F.col("length")).alias("offset"),
    )
    return ranked(pieces, total).join(slots, ["length", "rank"]).drop("rank")


def ranked(pieces: DataFrame, total: int) -> DataFrame:
    """``rank`` from 0 within each length. A length may hold most pieces, so it is ranked in
    salted parts, and a part starts where the counts of the parts before it end."""
    salts = max(1, -(-total // RANKED_TOGETHER))
    salted = pieces.withColumn("_salt", F.pmod(F.xxhash64("doc_id", "piece", "start"), F.lit(salts)))
    counts = salted.groupBy("length", "_salt").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("length").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("length", "_salt", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    order = Window.partitionBy("length", "_salt").orderBy("doc_id", "piece", "ids_crc32")
    placed = salted.withColumn("_rank", F.row_number().over(order) - 1)
    placed = placed.join(starts, ["length", "_salt"])
    return placed.withColumn("rank", F.col("_start") + F.col("_rank")).drop("_salt", "_rank", "_start")


def pack_documents(docs: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    """Tokenized, cut and packed documents, without the ids themselves."""
    pieces = stage(tokenize(docs, path, capacity), "pieces", new_folder(docs.sparkSession, "pieces"))
    columns = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    return pack(pieces, capacity).select(*columns)


def sequences(packed: DataFrame) -> DataFrame:
    """``(sequence_id, ids)`` of packed pieces that carry their ``ids``: at most one capacity each."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    grouped = packed.groupBy("sequence_id").agg(parts.alias("parts"))
    joined = F.aggregate("parts", F.lit("").cast("binary"), lambda a, x: F.concat(a, x["ids"]))
    return grouped.select("sequence_id", joined.alias("ids"))
