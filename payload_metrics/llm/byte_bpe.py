"""Byte-level BPE: texts to token ids with byte offsets, and back.

Pre-tokenisation uses no regex. The texts of a batch become one array of code points; a table maps
each to a class (letter, number, white space, other), and a look at the next code points turns the
class into a symbol, such as an apostrophe that opens ``'ll``. Every symbol is a function from the
scanner's state before it to the state behind it. Composition of functions is associative, so the
array is cut into lanes of equal length: each lane's functions are composed, a doubling scan over
the lanes gives the state each lane starts in, and a last walk through all lanes in step marks where
pieces begin. A text's first symbol forgets the state, so texts do not see each other.

The pieces are the matches of

    's|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+

Each piece's bytes are merged by the lowest rank, the leftmost first; merged pieces are remembered
up to a bounded number. Ids come with the byte offset behind each token, by which decoding puts
every token's bytes in place at once.

Defined cases: null and empty texts have no tokens and decode to no bytes; a very long text is a
batch of its own; a piece of any length is merged in n log n steps. ``decode`` takes nulls as
empty, and raises an error for an id without a rank. Other columns are never read.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

LETTER, NUMBER, OTHER, SHORT, LONG, SPACES, BLANK, BREAK = range(8)
#: Symbols from here on are the first of a text; the last symbol changes nothing.
FIRST, NOTHING = 8, 16
#: States: a piece is complete; inside letters, numbers, others, white space; behind a leading blank;
#: one or two code points short of the end of a contraction.
DONE, IN_LETTERS, IN_NUMBERS, IN_OTHERS, IN_SPACES, LED, LAST_ONE, LAST_TWO = range(8)
STATES = 8
# The endings of contractions.
ONE_LETTER, TWO_LETTERS = "stmd", ("re", "ve", "ll")
# Code points that became letters or numbers after Unicode 16, the tokenizer's version.
AFTER_16 = [
    (0x0558, 0x0558), (0x058b, 0x058c), (0x088f, 0x088f), (0x0c5c, 0x0c5c), (0x0cdc, 0x0cdc), (0x208f, 0x208f),
    (0x209d, 0x209f), (0xa7ce, 0xa7cf), (0xa7d2, 0xa7d2), (0xa7d4, 0xa7d4), (0xa7dd, 0xa7dd), (0xa7e2, 0xa7e2),
    (0xa7f1, 0xa7f1), (0xab6c, 0xab6d), (0x107bb, 0x107bf), (0x10940, 0x10959), (0x10ec5, 0x10ec7),
    (0x10ed9, 0x10eee), (0x11b0a, 0x11b0a), (0x11db0, 0x11ddb), (0x11de0, 0x11de9), (0x11df1, 0x11df1),
    (0x1246f, 0x1246f), (0x12475, 0x1247f), (0x12550, 0x12686), (0x16ea0, 0x16eb8), (0x16ebb, 0x16ed3),
    (0x16ff2, 0x16ff6), (0x187f8, 0x187ff), (0x18cd6, 0x18cda), (0x18d09, 0x18d20), (0x18d80, 0x18df2),
    (0x18e00, 0x19191), (0x191a0, 0x191d2), (0x1b123, 0x1b128), (0x1b168, 0x1b168), (0x1d6a6, 0x1d6a6),
    (0x1df1f, 0x1df24), (0x1df2b, 0x1df81), (0x1df90, 0x1df96), (0x1dfcd, 0x1dfff), (0x1e6c0, 0x1e6de),
    (0x1e6e0, 0x1e6e2), (0x1e6e4, 0x1e6e5), (0x1e6e7, 0x1e6ed), (0x1e6f0, 0x1e6f4), (0x1e6fe, 0x1e6ff),
    (0x2b73a, 0x2b73f), (0x2b81e, 0x2b81e), (0x2cea2, 0x2cead), (0x323b0, 0x33479), (0x3d000, 0x3fc3f),
]
LANE = 256
BYTES_AT_ONCE = 1 << 19
TOKENS_AT_ONCE = 1 << 17
REMEMBERED = 1 << 18
#: Bytes up to which pieces are merged in step.
SHORT_PIECE, NO_RANK = 48, 1 << 31
ENCODED = "struct<ids: array<int>, ends: array<int>>"
ENCODED_ARROW = pa.struct([("ids", pa.list_(pa.int32())), ("ends", pa.list_(pa.int32()))])


@lru_cache(maxsize=1)
def classes() -> np.ndarray:
    """The class of every code point."""
    import regex  # for its properties, which are of a later Unicode version than the tokenizer's

    table = np.full(0x110000, OTHER, dtype=np.uint8)
    # Every code point but surrogates, which no text holds.
    every = "".join(map(chr, chain(range(0xD800), range(0xE000, 0x110000))))
    for category, number in ((r"\p{L}+", LETTER), (r"\p{N}+", NUMBER), (r"\s+", SPACES)):
        for found in regex.finditer(category, every):
            table[ord(found[0][0]) : ord(found[0][-1]) + 1] = number
    for first, last in AFTER_16:
        table[first : last + 1] = OTHER
    return table


@lru_cache(maxsize=1)
def machine() -> tuple[np.ndarray, np.ndarray]:
    """The state behind, and whether a piece begins at, each (symbol, state before)."""
    states = np.zeros((NOTHING + 1, STATES), dtype=np.uint8)
    begins = np.zeros((NOTHING + 1, STATES), dtype=bool)
    inside = {LETTER: IN_LETTERS, NUMBER: IN_NUMBERS, OTHER: IN_OTHERS, SHORT: IN_OTHERS, LONG: IN_OTHERS}
    fresh = {SHORT: LAST_ONE, LONG: LAST_TWO, SPACES: IN_SPACES, BLANK: LED, BREAK: DONE}
    for symbol in range(FIRST):
        for state in range(STATES):
            run = inside.get(symbol, IN_SPACES if symbol == SPACES else None)
            if state in (LAST_ONE, LAST_TWO):
                states[symbol, state] = DONE if state == LAST_ONE else LAST_ONE
            elif run is not None and (state == run or (state == LED and symbol in inside)):
                states[symbol, state] = run
            else:
                begins[symbol, state] = True
                states[symbol, state] = fresh.get(symbol, inside.get(symbol))
        states[FIRST + symbol], begins[FIRST + symbol] = states[symbol, DONE], begins[symbol, DONE]
    states[NOTHING] = np.arange(STATES)
    return states, begins


def symbols(points: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The symbol of every code point; ``starts`` are the first positions of the texts."""
    found = classes()[points]
    text_ends = np.zeros(len(points) + 2, dtype=bool)
    text_ends[starts] = True
    text_ends[len(points) :] = True
    following = np.append(points, [0, 0]).astype(np.uint32)
    one, two = following[1:-1].copy(), following[2:].copy()
    one[text_ends[1:-1]] = 0
    two[text_ends[1:-1] | text_ends[2:]] = 0
    marks = np.flatnonzero(points == ord("'"))
    first, second = one[marks], two[marks]
    found[marks[np.isin(first, [ord(c) for c in ONE_LETTER])]] = SHORT
    for ending in TWO_LETTERS:
        found[marks[(first == ord(ending[0])) & (second == ord(ending[1]))]] = LONG
    white = found == SPACES
    before_text = white & ~text_ends[1:-1] & ~np.append(white[1:], True)
    found[before_text & (points == ord(" "))] = BLANK
    found[before_text & (points != ord(" "))] = BREAK
    found[starts] += FIRST
    return found


def beginnings(found: np.ndarray, lane: int = LANE) -> np.ndarray:
    """Positions at which pieces begin, by a scan over the symbols' transition functions."""
    states, begins = machine()
    flat = states.ravel()
    lanes = max(-(-len(found) // lane), 1)
    padded = np.full(lanes * lane, NOTHING, dtype=np.uint8)
    padded[: len(found)] = found
    steps = np.ascontiguousarray(padded.reshape(lanes, lane).T) * np.uint8(STATES)
    whole = np.tile(np.arange(STATES, dtype=np.uint8), (lanes, 1))
    for step in steps:
        whole = flat[step[:, None] + whole]
    shift = 1
    while shift < lanes:
        whole[shift:] = np.take_along_axis(whole[shift:], whole[:-shift].astype(np.int64), axis=1)
        shift *= 2
    state = np.concatenate([[DONE], whole[:-1, DONE]]).astype(np.uint8)
    marks = np.empty((lane, lanes), dtype=bool)
    for at, step in enumerate(steps):
        marks[at] = begins.ravel()[step + state]
        state = flat[step + state]
    return np.flatnonzero(marks.T.ravel()[: len(found)])


def pieces(texts: list[str]) -> tuple[list[str], np.ndarray]:
    """The pieces of all texts in turn, and how many each text has."""
    lengths = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
    joined = "".join(texts)
    if not joined:
        return [], np.zeros(len(texts), dtype=np.int64)
    points = np.frombuffer(joined.encode("utf-32-le"), dtype="<u4")
    edges = np.concatenate([[0], np.cumsum(lengths)])
    starts = beginnings(symbols(points, edges[:-1][lengths > 0]))
    bounds = [*starts.tolist(), len(joined)]
    found = [joined[a:b] for a, b in zip(bounds, bounds[1:])]
    return found, np.diff(np.searchsorted(starts, edges))


class Merges:
    """A vocabulary, and the ids of the pieces it was asked for lately."""

    def __init__(self, path: str):
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        size = max(self.ranks.values()) + 1
        self.lengths = np.full(size, -1, dtype=np.int64)
        for token, rank in self.ranks.items():
            self.lengths[rank] = len(token)
        self.starts = np.zeros(size, dtype=np.int64)
        ordered = sorted(self.ranks.items(), key=lambda item: item[1])
        self.bytes = np.frombuffer(b"".join(token for token, _ in ordered), dtype=np.uint8)
        known = np.maximum(self.lengths, 0)
        self.starts[1:] = np.cumsum(known)[:-1]
        self.of_byte = np.array([self.ranks[bytes([b])] for b in range(256)])
        self._pair_table()
        # Two generations: what is asked for again moves to the younger, the older one goes as a whole.
        self.younger: dict[str, tuple[int, ...]] = {}
        self.older: dict[str, tuple[int, ...]] = {}

    def _pair_table(self) -> None:
        """Every pair of tokens that makes a token, in open addressing, at most a quarter full."""
        pairs = [
            (self.ranks[token[:i]], self.ranks[token[i:]], rank)
            for token, rank in self.ranks.items()
            for i in range(1, len(token))
            if token[:i] in self.ranks and token[i:] in self.ranks
        ]
        left, right, rank = np.array(pairs, dtype=np.int64).T
        self.slots = 1 << (4 * len(pairs)).bit_length()
        self.pair_keys = np.full(self.slots, -1, dtype=np.int64)
        self.pair_ranks = np.full(self.slots, NO_RANK, dtype=np.int64)
        keys = left << 32 | right
        slots, rest = self._slot(left, right), np.arange(len(pairs))
        while len(rest):
            free = self.pair_keys[slots[rest]] < 0
            self.pair_keys[slots[rest[free]]] = keys[rest[free]]
            won = self.pair_keys[slots[rest]] == keys[rest]
            self.pair_ranks[slots[rest[won]]] = rank[rest[won]]
            rest = rest[~won]
            slots[rest] = (slots[rest] + 1) % self.slots

    def _slot(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        return ((left * 0x9E3779B1 + right * 0x85EBCA77) >> 15) % self.slots

    def pair_rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of every pair, or ``NO_RANK``."""
        keys, slots = left << 32 | right, self._slot(left, right)
        found = self.pair_ranks[slots]
        rest = np.flatnonzero(self.pair_keys[slots] != keys)
        while len(rest):
            empty = self.pair_keys[slots[rest]] < 0
            found[rest[empty]] = NO_RANK
            rest = rest[~empty]
            slots[rest] = (slots[rest] + 1) % self.slots
            found[rest] = self.pair_ranks[slots[rest]]
            rest = rest[self.pair_keys[slots[rest]] != keys[rest]]
        return found

    def ids_of(self, pieces: list[str]) -> list[tuple[int, ...]]:
        """The ids of every piece; those not remembered are merged together."""
        if len(self.younger) >= REMEMBERED // 2:
            self.older, self.younger = self.younger, {}
        new = set(pieces).difference(self.younger)
        known = {piece: self.older[piece] for piece in new if piece in self.older}
        unknown = [piece for piece in new if piece not in known]
        data = [piece.encode("utf-8") for piece in unknown]
        short = [i for i, d in enumerate(data) if len(d) <= SHORT_PIECE]
        for i, ids in zip(short, self.merge_many([data[i] for i in short])):
            known[unknown[i]] = ids
        long = {unknown[i]: self.merge(d) for i, d in enumerate(data) if len(d) > SHORT_PIECE}
        self.younger.update(known)
        if not long:
            return list(map(self.younger.__getitem__, pieces))
        return [long[piece] if piece in long else self.younger[piece] for piece in pieces]

    def merge_many(self, data: list[bytes]) -> list[tuple[int, ...]]:
        """Merges, in all pieces in step, the pair of lowest rank, the leftmost first."""
        sizes = np.fromiter(map(len, data), dtype=np.int64, count=len(data))
        tokens = self.of_byte[np.frombuffer(b"".join(data), dtype=np.uint8)]
        owners = np.repeat(np.arange(len(data)), sizes)
        ranks = np.full(len(tokens), NO_RANK, dtype=np.int64)

        def look_up(at: np.ndarray) -> None:
            at = at[at < len(tokens) - 1]
            ranks[at] = np.where(owners[at] == owners[at + 1], self.pair_rank(tokens[at], tokens[at + 1]), NO_RANK)

        look_up(np.arange(len(tokens)))
        done: list[tuple[np.ndarray, np.ndarray]] = []
        while len(tokens):
            starts = np.flatnonzero(np.append(True, owners[1:] != owners[:-1]))
            lowest = np.minimum.reduceat(ranks, starts)
            lengths = np.diff(np.append(starts, len(tokens)))
            active = np.repeat(lowest < NO_RANK, lengths)
            done.append((owners[~active], tokens[~active]))
            hits = np.flatnonzero(active & (ranks == np.repeat(lowest, lengths)))
            hits = hits[np.append(True, owners[hits[1:]] != owners[hits[:-1]])] if len(hits) else hits
            tokens[hits] = ranks[hits]
            kept = active.copy()
            kept[hits + 1] = False
            places = np.cumsum(kept) - 1
            tokens, owners, ranks = tokens[kept], owners[kept], ranks[kept]
            at = places[hits]
            # The last token of a piece has no pair.
            if len(ranks):
                ranks[-1] = NO_RANK
            look_up(at)
            look_up(at[at > 0] - 1)
        if not done:
            return []
        owners, tokens = (np.concatenate(parts) for parts in zip(*done))
        order = np.argsort(owners, kind="stable")
        flat, ends = tokens[order].tolist(), np.cumsum(np.bincount(owners, minlength=len(data))).tolist()
        return [tuple(flat[a:b]) for a, b in zip([0, *ends], ends)]

    def merge(self, data: bytes) -> tuple[int, ...]:
        """The same for one long piece, in n log n steps."""
        ranks = self.ranks
        size = len(data)
        # Parts as a linked list over their first bytes; a part that was merged away ends at -1.
        end, before = list(range(1, size + 1)), list(range(-1, size - 1))
        heap = [(ranks[data[i : i + 2]], i, i + 2) for i in range(size - 1) if data[i : i + 2] in ranks]
        heapq.heapify(heap)
        while heap:
            _, at, stop = heapq.heappop(heap)
            middle = end[at]
            if middle == -1 or middle >= size or end[middle] != stop:
                continue
            end[at], end[middle] = stop, -1
            if stop < size:
                before[stop] = at
                after = ranks.get(data[at : end[stop]])
                if after is not None:
                    heapq.heappush(heap, (after, at, end[stop]))
            earlier = before[at]
            if earlier >= 0:
                joint = ranks.get(data[earlier:stop])
                if joint is not None:
                    heapq.heappush(heap, (joint, earlier, stop))
        found, at = [], 0
        while at < size:
            found.append(ranks[data[at : end[at]]])
            at = end[at]
        return tuple(found)


@lru_cache(maxsize=2)
def merges(path: str) -> Merges:
    """One per Python worker and vocabulary."""
    return Merges(path)


def _groups(texts: pa.Array) -> Iterator[list[str]]:
    """Consecutive texts of bounded length together; a longer text is alone."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    start, room = 0, BYTES_AT_ONCE
    for at, size in enumerate(sizes.tolist()):
        if size > room and at > start:
            yield texts.slice(start, at - start).to_pylist()
            start, room = at, BYTES_AT_ONCE
        room -= size
    if start < len(texts):
        yield texts.slice(start).to_pylist()


def encode_texts(texts: list[str], vocabulary: Merges) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids of all texts, the byte offset in its text behind each id, and the ids' number per text."""
    found, n_pieces = pieces(texts)
    merged = vocabulary.ids_of(found)
    per_piece = np.fromiter(map(len, merged), dtype=np.int64, count=len(merged))
    ids = np.fromiter(chain.from_iterable(merged), dtype=np.int32, count=int(per_piece.sum()))
    edges = np.concatenate([[0], np.cumsum(per_piece)])[np.concatenate([[0], np.cumsum(n_pieces)])]
    reached = np.concatenate([[0], np.cumsum(vocabulary.lengths[ids])])
    counts = np.diff(edges)
    return ids, (reached[1:] - np.repeat(reached[edges[:-1]], counts)).astype(np.int32), counts


def decode_ids(ids: np.ndarray, ends: np.ndarray, counts: np.ndarray, vocabulary: Merges) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts in turn, and each text's number of bytes.

    ``ends`` says where in its text each token ends, so many tokens are put in place together.
    """
    if len(ids) and (ids.min() < 0 or ids.max() >= len(vocabulary.lengths) or vocabulary.lengths[ids].min() < 0):
        raise ValueError("an id without a rank")
    edges = np.concatenate([[0], np.cumsum(counts)])
    sizes = np.zeros(len(counts), dtype=np.int64)
    some = counts > 0
    sizes[some] = ends[edges[1:][some] - 1]
    bases = np.concatenate([[0], np.cumsum(sizes)])
    places = np.repeat(bases[:-1], counts) + ends
    out = np.zeros(int(bases[-1]), dtype=np.uint8)
    for start in range(0, len(ids), TOKENS_AT_ONCE):
        some_ids = ids[start : start + TOKENS_AT_ONCE]
        lengths = vocabulary.lengths[some_ids]
        # Numbers the bytes of every token backwards from its end, from 1.
        back = np.repeat(np.cumsum(lengths), lengths) - np.arange(int(lengths.sum()))
        stops = vocabulary.starts[some_ids] + lengths
        out[np.repeat(places[start : start + TOKENS_AT_ONCE], lengths) - back] = vocabulary.bytes[np.repeat(stops, lengths) - back]
    return out, sizes


def encode(text: Column, path: str) -> Column:
    """``ids`` and ``ends``, the byte offset behind each token, of every text."""

    def encoded(texts: pa.Array) -> pa.Array:
        parts = []
        for group in _groups(texts):
            ids, ends, counts = encode_texts(group, merges(path))
            edges = pa.array(_edges(counts))
            lists = [pa.ListArray.from_arrays(edges, pa.array(values)) for values in (ids, ends)]
            parts.append(pa.StructArray.from_arrays(lists, names=["ids", "ends"]))
        return pa.concat_arrays(parts) if parts else pa.array([], ENCODED_ARROW)

    return F.arrow_udf(encoded, ENCODED)(F.coalesce(text.cast("string"), F.lit("")))


def decode(encoded: Column, path: str) -> Column:
    """The bytes of every text, by its ids and their offsets."""

    def decoded(rows: pa.Array) -> pa.Array:
        return _decoded(rows, path)

    return F.arrow_udf(decoded, "binary")(encoded)


def read_back(encoded: Column, path: str) -> Column:
    """``n_tokens``, ``packed`` (the ids as little-endian unsigned 32-bit integers) and ``decoded``
    of every text. Straight on ``encode``, both run in one Python worker."""

    def read(rows: pa.Array) -> pa.Array:
        ids, _, counts = _lists(rows)
        columns = [pa.array(counts), _binary(ids.astype("<u4").view(np.uint8), 4 * counts), _decoded(rows, path)]
        return pa.StructArray.from_arrays(columns, names=["n_tokens", "packed", "decoded"])

    return F.arrow_udf(read, "struct<n_tokens: long, packed: binary, decoded: binary>")(encoded)


def _edges(counts: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)


def _lists(rows: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids and ends of all rows, and the ids' number per row; null rows and lists are empty."""
    ids, ends = rows.flatten()
    counts = pc.fill_null(ids.value_lengths(), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    return ids.flatten().to_numpy(zero_copy_only=False), ends.flatten().to_numpy(zero_copy_only=False), counts


def _decoded(rows: pa.Array, path: str) -> pa.Array:
    ids, ends, counts = _lists(rows)
    return _binary(*decode_ids(ids, ends, counts, merges(path)))


def _binary(data: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """Consecutive stretches of ``data`` as binary values."""
    buffers = [None, pa.py_buffer(_edges(sizes)), pa.py_buffer(np.ascontiguousarray(data))]
    return pa.Array.from_buffers(pa.binary(), len(sizes), buffers)
