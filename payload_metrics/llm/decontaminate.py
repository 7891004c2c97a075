"""Benchmark decontamination by pigeonhole edit matching.

A test item may occur in a document with an error budget of k edits, a share of its length. It is
split into k + 1 pieces: an occurrence within the budget leaves at least one piece untouched. An
Aho-Corasick automaton finds all exact piece hits in one pass over the text; every hit names a
place where the whole item may lie, and Myers' bit-parallel algorithm computes its distance there.
Items and texts are compared in lower case with each run of white space as one space.

Items are a stated set of queries. They pass in blocks of bounded size, one automaton for each
block, and every block is held against all documents. With several blocks each is a job of its own,
whose result is written before the next block is read, so that neither the driver nor a task holds
more than two blocks.

Defined cases: null and empty texts contain nothing; null and empty items are not searched; an item
without an id is searched like any other and found under a null id; a repeated item id is searched
once for each of its texts; a repeated document has its own matches; items that share pieces are all
verified. Other columns are kept.
"""

from __future__ import annotations

import bisect
import re
from collections import defaultdict
from collections.abc import Callable, Iterator
from itertools import chain

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from payload_metrics.llm.common import new_folder
from payload_metrics.sources.tables import stage

ERROR_SHARE = 0.06
BLOCK_CHARS = 4_000_000
MATCHES = "array<struct<item_id: bigint, start: bigint, end: bigint, distance: int>>"

Item = tuple[int | None, str]


def normal(text: str) -> str:
    return " ".join(text.lower().split())


def pieces(item: str, budget: int) -> list[tuple[int, str]]:
    """``budget + 1`` pieces of nearly equal length, each with its offset."""
    cuts = [len(item) * i // (budget + 1) for i in range(budget + 2)]
    return [(a, item[a:b]) for a, b in zip(cuts[:-1], cuts[1:]) if b > a]


def distances(pattern: str, text: str, anchored: bool = False) -> Iterator[int]:
    """Myers: after each character of ``text``, the edit distance of ``pattern`` to the nearest
    substring that ends there, or to the whole text so far if ``anchored``."""
    masks: dict[str, int] = defaultdict(int)
    for i, char in enumerate(pattern):
        masks[char] |= 1 << i
    full, top = (1 << len(pattern)) - 1, 1 << (len(pattern) - 1)
    plus, minus, distance = full, 0, len(pattern)
    for char in text:
        match = masks.get(char, 0)
        diagonal = (((match & plus) + plus) ^ plus) | match | minus
        up = minus | (full & ~(diagonal | plus))
        down = plus & diagonal
        distance += 1 if up & top else -1 if down & top else 0
        up, down = (up << 1 | anchored) & full, (down << 1) & full
        plus = down | (full & ~(diagonal | up))
        minus = up & diagonal
        yield distance


class Matcher:
    """Occurrences of a block of items in a text, each within the item's own budget."""

    def __init__(self, items: list[Item], error_share: float = ERROR_SHARE):
        self._items = [(item_id, found) for item_id, text in items if (found := normal(text))]
        self._budgets = [int(len(text) * error_share) for _, text in self._items]
        places: dict[str, list[tuple[int, int]]] = defaultdict(list)
        for i, (_, text) in enumerate(self._items):
            for offset, piece in pieces(text, self._budgets[i]):
                places[piece].append((i, offset))
        self._automaton = ahocorasick.Automaton()
        for piece, where in places.items():
            self._automaton.add_word(piece, (len(piece), where))
        self._empty = not places
        if places:
            self._automaton.make_automaton()

    def find(self, text: str) -> list[tuple[int, int, int, int]]:
        """``(item_id, start, end, distance)`` in code points of ``text``."""
        plain = normal(text)
        if self._empty or not plain:
            return []
        begins: dict[int, set[int]] = defaultdict(set)
        for last, (length, where) in self._automaton.iter(plain):
            for i, offset in where:
                begins[i].add(last + 1 - length - offset)
        found = []
        for i, starts in begins.items():
            found += self._verified(i, sorted(starts), plain)
        if not found:
            return []
        place = _places(text)
        matches = [(item_id, place(a), place(b - 1) + 1, d) for item_id, a, b, d in found]
        return sorted(matches, key=lambda m: (m[0] is None, m[0] or 0, *m[1:]))

    def _verified(self, i: int, starts: list[int], plain: str) -> list[tuple[int, int, int, int]]:
        """Starts a budget apart may be one occurrence; the best of each such run is returned."""
        (item_id, item), budget = self._items[i], self._budgets[i]
        found, at = [], 0
        while at < len(starts):
            stop = at + 1
            while stop < len(starts) and starts[stop] - starts[stop - 1] <= budget and starts[stop] - starts[at] <= len(item):
                stop += 1
            low = max(0, starts[at] - budget)
            window = plain[low : starts[stop - 1] + len(item) + budget]
            best, end = min(((d, e) for e, d in enumerate(distances(item, window), 1)), default=(budget + 1, 0))
            if best <= budget:
                back = distances(item[::-1], window[:end][::-1], anchored=True)
                _, length = min((d, n) for n, d in enumerate(back, 1))
                match = (item_id, low + end - length, low + end, best)
                if not found or found[-1][2] <= match[1]:
                    found.append(match)
                elif match[3] < found[-1][3]:
                    found[-1] = match
            at = stop
        return found


def _places(text: str) -> Callable[[int], int]:
    """From places in the normal form to places in ``text``."""
    starts, normal_starts, at = [], [], 0
    for word in re.finditer(r"\S+", text):
        starts.append(word.span())
        normal_starts.append(at)
        at += len(word[0].lower()) + 1

    def place(offset: int) -> int:
        i = bisect.bisect_right(normal_starts, offset) - 1
        start, end = starts[i]
        return min(start + offset - normal_starts[i], end - 1)

    return place


def blocks(benchmark: DataFrame, block_chars: int = BLOCK_CHARS) -> Iterator[list[Item]]:
    """Items in blocks of about ``block_chars`` characters, in order of their ids."""
    items = benchmark.where(F.col("text").isNotNull()).select(F.col("item_id").cast("long"), "text")
    block: list[Item] = []
    size = 0
    for item_id, text in items.distinct().orderBy("item_id", "text").toLocalIterator():
        block.append((item_id, text))
        size += len(text)
        if size >= block_chars:
            yield block
            block, size = [], 0
    if block:
        yield block


def matches(text: Column, block: list[Item], error_share: float = ERROR_SHARE) -> Column:
    """Every occurrence of an item of ``block`` in ``text``, as an array of structs."""
    return F.pandas_udf(_finder(block, error_share), MATCHES)(F.coalesce(text, F.lit("")))


_matchers: dict[tuple, Matcher] = {}


def _finder(items: list[Item], error_share: float) -> Callable[[Iterator[pd.Series]], Iterator[pd.Series]]:
    key = (error_share, *items)

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        if key not in _matchers:
            _matchers.clear()
            _matchers[key] = Matcher(items, error_share)
        matcher = _matchers[key]
        names = ("item_id", "start", "end", "distance")
        for texts in batches:
            yield pd.Series([[dict(zip(names, m)) for m in matcher.find(text)] for text in texts], dtype=object)

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return run


def contaminated(
    docs: DataFrame, benchmark: DataFrame, error_share: float = ERROR_SHARE, block_chars: int = BLOCK_CHARS
) -> DataFrame:
    """One row ``(doc_id, item_id, start, end, distance)`` for every occurrence."""
    out = None
    for block, only in _with_only(blocks(benchmark, block_chars)):
        found = docs.select("doc_id", F.explode(matches(F.col("text"), block, error_share)).alias("m")).select("doc_id", "m.*")
        found = found if only else stage(found, "matches", new_folder(docs.sparkSession, "matches"))
        out = found if out is None else out.unionByName(found)
    none = F.array().cast(MATCHES)
    return docs.select("doc_id", F.explode(none).alias("m")).select("doc_id", "m.*") if out is None else out


def decontaminate(
    docs: DataFrame, benchmark: DataFrame, error_share: float = ERROR_SHARE, block_chars: int = BLOCK_CHARS
) -> DataFrame:
    """``docs`` without those that contain a benchmark item."""
    for block, only in _with_only(blocks(benchmark, block_chars)):
        docs = docs.where(F.size(matches(F.col("text"), block, error_share)) == 0)
        docs = docs if only else stage(docs, "clean", new_folder(docs.sparkSession, "clean"))
    return docs


def _with_only(found: Iterator[list[Item]]) -> Iterator[tuple[list[Item], bool]]:
    """Blocks, each with whether it is the only one."""
    first = next(found, None)
    second = next(found, None) if first is not None else None
    for block in filter(None, chain((first, second), found)):
        yield block, second is None
