"""Hidden Markov language model, trained by Baum-Welch over the whole corpus.

Each state emits symbols: the ``HEAD`` most frequent training words, the end of a text, and 256
classes for all other words, by a hash of a word's last two bytes. A word of a class has a share
of the class that does not depend on the state, so the probability of a text factors into a
forward recursion over symbols, which needs only the head, and one factor for each tail word,
which needs the word's count. The head is bounded and goes to every task; the tail, which grows
with the corpus, is looked up by a shuffled join and comes back as sums per text.

Training starts from parameters fitted to a bounded sample of whole texts, which only breaks the
symmetry of the states. Then every pass runs the scaled forward and backward recursions over all
training texts; expected counts are summed within a task, then across tasks by symbol, and the
new parameters come from these sums alone. Recursions run over many texts in step.

Defined cases: null texts count as empty, and an empty text is its end alone; without a training
text every symbol is equally likely; a repeated row is a text of its own; null ids are training
texts. Other columns are never read.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from payload_metrics.llm.common import new_folder, text_of
from payload_metrics.sources.tables import stage

HEAD = 65_536
CLASSES = 256
STATES = 6
PASSES = 2
SAMPLE_TEXTS = 400
SAMPLE_PASSES = 15
COUNTED = 250_000
TOGETHER = 400_000
INITIAL, TRANSITION = -1, -2


def words_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").lower().split()


def class_of(word: bytes) -> int:
    return zlib.crc32(word[-2:]) % CLASSES


def _class_column(word: str) -> Column:
    return (F.crc32(F.substring(F.col(word).cast("binary"), -2, 2)) % CLASSES).cast("int")


@dataclass
class Vocabulary:
    """Counts of the training texts. ``counts (word, c)`` is a written table of all words."""

    counts: DataFrame
    head: dict[bytes, int]
    head_counts: np.ndarray
    texts: int
    tokens: int
    distinct: int
    class_tokens: np.ndarray
    class_words: np.ndarray

    @property
    def symbols(self) -> int:
        return len(self.head) + 1 + CLASSES

    def symbol_counts(self) -> np.ndarray:
        return np.concatenate([self.head_counts, [self.texts], self.class_tokens]).astype(float)


@dataclass
class Parameters:
    initial: np.ndarray
    transition: np.ndarray
    emission: np.ndarray  # a row for each symbol, a column for each state


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial counts; handed on when many words have gathered."""
    counts: Counter[bytes] = Counter()

    def part() -> pa.RecordBatch:
        words = pa.array(counts.keys(), pa.binary()).cast(pa.string())
        return pa.record_batch([words, pa.array(counts.values(), pa.int64())], names=["word", "c"])

    for batch in batches:
        for text in batch["text"].to_pylist():
            counts.update(words_of(text))
            if len(counts) > COUNTED:
                yield part()
                counts.clear()
    yield part()


def vocabulary(training: DataFrame, head: int = HEAD) -> Vocabulary:
    """Counts every word of ``training (text)``, a frame without null texts."""
    spark = training.sparkSession
    parts = training.select("text").mapInArrow(_count_words, "word string, c long")
    counts = parts.groupBy("word").agg(F.sum("c").alias("c"))
    counts = stage(counts, "words", new_folder(spark, "hmm-words"))
    texts = training.count()
    top = counts.orderBy(F.desc("c"), "word").limit(head).collect()
    per_class = counts.groupBy(_class_column("word").alias("k")).agg(F.sum("c"), F.count("*")).collect()
    tokens, words = np.zeros(CLASSES, dtype=np.int64), np.zeros(CLASSES, dtype=np.int64)
    for k, n_tokens, n_words in per_class:
        tokens[k], words[k] = n_tokens, n_words
    all_tokens, all_words = int(tokens.sum()), int(words.sum())
    for row in top:  # the head leaves its classes
        k = class_of(row.word.encode())
        tokens[k] -= row.c
        words[k] -= 1
    return Vocabulary(
        counts=counts,
        head={row.word.encode(): i for i, row in enumerate(top)},
        head_counts=np.array([row.c for row in top], dtype=np.int64),
        texts=texts,
        tokens=all_tokens + texts,
        distinct=all_words + (texts > 0),
        class_tokens=tokens,
        class_words=words,
    )


def encode(words: list[bytes], head: dict[bytes, int]) -> np.ndarray:
    """Symbols of a text, its end included."""
    end = len(head)
    found = [head[w] if w in head else end + 1 + class_of(w) for w in words]
    found.append(end)
    return np.array(found, dtype=np.int64)


class _InStep:
    """Symbols of several texts, ordered by place and then by text, longest texts first."""

    def __init__(self, texts: list[np.ndarray]):
        lengths = np.array([len(t) for t in texts])
        self.order = np.argsort(-lengths, kind="stable")
        lengths = lengths[self.order]
        text = np.repeat(np.arange(len(texts)), lengths)
        place = np.arange(len(text)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        by_place = np.argsort(place, kind="stable")
        self.symbols = np.concatenate([texts[i] for i in self.order])[by_place]
        self.text = text[by_place]
        self.active = np.bincount(place)
        self.start = np.concatenate([[0], np.cumsum(self.active)])

    def forward(self, p: Parameters) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Scaled forward probabilities, the scales, and the emissions."""
        emitted = p.emission[self.symbols]
        alpha, scale = np.empty_like(emitted), np.empty(len(emitted))
        before = None
        for t, n in enumerate(self.active.tolist()):
            rows = slice(self.start[t], self.start[t] + n)
            now = emitted[rows] * (p.initial if before is None else before[:n] @ p.transition)
            total = now.sum(axis=1)
            now /= total[:, None]
            alpha[rows], scale[rows], before = now, total, now
        return alpha, scale, emitted

    def log10(self, scale: np.ndarray) -> np.ndarray:
        """log10 probability of each text, in the order the texts were given."""
        sums = np.bincount(self.text, weights=np.log10(scale))
        found = np.empty(len(sums))
        found[self.order] = sums
        return found

    def expected(self, p: Parameters) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Expected counts of first states, of transitions, and of each symbol in each state."""
        alpha, scale, emitted = self.forward(p)
        beta = np.ones_like(alpha)
        # What comes after place t + 1 is known when place t is reached.
        ahead = emitted / scale[:, None]
        for t in range(len(self.active) - 2, -1, -1):
            n = self.active[t + 1]
            later = slice(self.start[t + 1], self.start[t + 1] + n)
            ahead[later] *= beta[later]
            beta[self.start[t] : self.start[t] + n] = ahead[later] @ p.transition.T
        gamma = alpha * beta
        later = np.arange(self.start[1], len(alpha))
        sooner = later - np.repeat(self.active[:-1], self.active[1:])
        transitions = p.transition * (alpha[sooner].T @ ahead[later])
        emissions = np.stack([np.bincount(self.symbols, gamma[:, k], len(p.emission)) for k in range(gamma.shape[1])], axis=1)
        return gamma[: self.active[0]].sum(axis=0), transitions, emissions


def _together(texts: list[np.ndarray]) -> Iterator[list[int]]:
    """Indices of texts of like length, up to so many symbols at once."""
    group, size = [], 0
    for i in sorted(range(len(texts)), key=lambda i: -len(texts[i])):
        group.append(i)
        size += len(texts[i])
        if size >= TOGETHER:
            yield group
            group, size = [], 0
    if group:
        yield group


def maximised(initial: np.ndarray, transition: np.ndarray, emission: np.ndarray, counts: np.ndarray) -> Parameters:
    """Parameters from expected counts, each with a small prior: even for states, by the symbols'
    counts for emissions, so that nothing is impossible."""
    share = (counts + 1) / (counts + 1).sum()
    emission = emission + share[:, None]
    initial, transition = initial + 0.1, transition + 0.1
    return Parameters(
        initial / initial.sum(), transition / transition.sum(axis=1, keepdims=True), emission / emission.sum(axis=0)
    )


def first_parameters(texts: list[np.ndarray], counts: np.ndarray, states: int, passes: int) -> Parameters:
    """Baum-Welch on a sample, from states that differ by chance."""
    rng = np.random.default_rng(5)
    share = (counts + 1) / (counts + 1).sum()
    emission = share[:, None] * rng.gamma(2.0, size=(len(counts), states))
    transition = np.full((states, states), 0.1 / max(states - 1, 1)) + (0.9 - 0.1 / max(states - 1, 1)) * np.eye(states)
    p = Parameters(np.full(states, 1 / states), transition / transition.sum(axis=1, keepdims=True), emission / emission.sum(axis=0))
    for _ in range(passes if texts else 0):
        sums = [np.zeros(states), np.zeros((states, states)), np.zeros_like(emission)]
        for group in _together(texts):
            for total, part in zip(sums, _InStep([texts[i] for i in group]).expected(p)):
                total += part
        p = maximised(*sums, counts)
    return p


def _expectation(head, shared) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Expected counts of one task, a row for each symbol it has seen and each state."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p, ids = shared.value, head.value
        states = len(p.initial)
        sums = [np.zeros(states), np.zeros((states, states)), np.zeros_like(p.emission)]
        for batch in batches:
            texts = [encode(words_of(text), ids) for text in batch["text"].to_pylist()]
            for group in _together(texts):
                for total, part in zip(sums, _InStep([texts[i] for i in group]).expected(p)):
                    total += part
        seen = np.flatnonzero(sums[2].any(axis=1))
        symbols = [*seen.tolist(), INITIAL, *[TRANSITION - k for k in range(states)]]
        values = np.vstack([sums[2][seen], sums[0], sums[1]])
        columns = [pa.array(symbols, pa.int32()), *[pa.array(values[:, k]) for k in range(states)]]
        yield pa.record_batch(columns, names=["symbol", *[f"s{k}" for k in range(states)]])

    return run


def train(
    training: DataFrame, vocab: Vocabulary, states: int = STATES, passes: int = PASSES, sample_texts: int = SAMPLE_TEXTS
) -> Parameters:
    """Baum-Welch over all of ``training (doc_id, text)``.

    The starting point is fitted to at most ``sample_texts`` whole texts, picked by hash.
    """
    context = training.sparkSession.sparkContext
    counts = vocab.symbol_counts()
    head = context.broadcast(vocab.head)
    picked = training.select("doc_id", F.xxhash64("doc_id", F.lit(3)).alias("h")).where("doc_id IS NOT NULL")
    picked = F.broadcast(picked.distinct().orderBy("h", "doc_id").limit(sample_texts))
    # Encoded where the texts are; the driver gets symbols only.
    symbols = F.pandas_udf(_encoder(head), "array<int>")
    sample = training.join(picked, "doc_id", "left_semi").select(symbols("text").alias("symbols"))
    texts = [np.array(row.symbols, dtype=np.int64) for row in sample.collect()]
    p = first_parameters(texts, counts, states, SAMPLE_PASSES)
    names = [f"s{k}" for k in range(states)]
    schema = ", ".join(["symbol int", *[f"{name} double" for name in names]])
    for _ in range(passes):
        shared = context.broadcast(p)
        parts = training.select("text").mapInArrow(_expectation(head, shared), schema)
        total = parts.groupBy("symbol").agg(*[F.sum(name).alias(name) for name in names]).collect()
        sums = [np.zeros(states), np.zeros((states, states)), np.zeros((vocab.symbols, states))]
        for symbol, *values in total:
            if symbol >= 0:
                sums[2][symbol] = values
            elif symbol == INITIAL:
                sums[0] += values
            else:
                sums[1][TRANSITION - symbol] = values
        p = maximised(*sums, counts)
        shared.unpersist()
    return p


def _encoder(head):
    import pandas as pd

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([encode(words_of(text), head.value).astype(np.int32) for text in texts], dtype=object)

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return run


LOCAL = (
    "doc_id long, row long, n_tokens long, head_known long, head_base double, forward double, "
    "tail array<struct<word: string, n: int>>"
)


def _local_scores(model) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """What a text's score needs without the tail, and its tail words with their numbers."""
    kind = pa.list_(pa.struct([("word", pa.string()), ("n", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p, head, base = model.value
        end = len(head)
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                some = batch.slice(at, 2000)
                words = [words_of(text) for text in some["text"].to_pylist()]
                texts = [encode(w, head) for w in words]
                forward = np.empty(len(texts))
                for group in _together(texts):
                    step = _InStep([texts[i] for i in group])
                    forward[group] = step.log10(step.forward(p)[1])
                tails = [Counter(w for w in ws if w not in head) for ws in words]
                own = [t[t <= end] for t in texts]
                columns = [
                    some["doc_id"],
                    some["row"],
                    pa.array([len(t) for t in texts], pa.int64()),
                    pa.array([int((base[o] > base[-1]).sum()) for o in own], pa.int64()),
                    pa.array([float(base[o].sum()) for o in own]),
                    pa.array(forward),
                    pa.array([[{"word": w.decode(), "n": n} for w, n in tail.items()] for tail in tails], kind),
                ]
                yield pa.record_batch(columns, names=[f.split()[0] for f in LOCAL.split(", ", 6)])

    return run


def score(docs: DataFrame, vocab: Vocabulary, p: Parameters) -> DataFrame:
    """``(doc_id, n_tokens, n_known, base_score, score)`` for every row of ``docs``."""
    spark = docs.sparkSession
    mass = vocab.tokens + vocab.distinct + 1
    unseen = math.log10(1 / mass)
    base = np.append(np.log10((np.append(vocab.head_counts, vocab.texts) + 1) / mass), unseen)
    model = spark.sparkContext.broadcast((p, vocab.head, base))
    rows = docs.select(F.col("doc_id").cast("long"), text_of().alias("text"), F.monotonically_increasing_id().alias("row"))
    local = stage(rows.mapInArrow(_local_scores(model), LOCAL), "scores", new_folder(spark, "hmm-scores"))
    tail = local.select("row", F.explode("tail").alias("t")).select("row", "t.word", "t.n")
    class_mass = F.array(*[F.lit(float(m)) for m in vocab.class_tokens + vocab.class_words + 1])
    joined = tail.join(vocab.counts, "word", "left").withColumn("c", F.coalesce("c", F.lit(0)))
    in_class = F.log10((F.col("c") + 1) / F.element_at(class_mass, _class_column("word") + 1))
    sums = joined.groupBy("row").agg(
        F.sum(F.when(F.col("c") > 0, F.col("n")).otherwise(0)).alias("tail_known"),
        F.sum(F.col("n") * F.log10((F.col("c") + 1) / F.lit(float(mass)))).alias("tail_base"),
        F.sum(F.col("n") * in_class).alias("tail_share"),
    )
    both = local.drop("tail").join(sums, "row", "left")
    none = F.lit(0.0)
    return both.select(
        "doc_id",
        "n_tokens",
        (F.col("head_known") + F.coalesce("tail_known", F.lit(0))).alias("n_known"),
        (F.col("head_base") + F.coalesce("tail_base", none)).alias("base_score"),
        (F.col("forward") + F.coalesce("tail_share", none)).alias("score"),
    )
