"""Quality classifier: histogram gradient-boosted trees over statistics of a document.

Statistics are computed from whole texts where the texts are. Trees are grown level by level from
histograms of gradients over at most ``BINS`` quantile bins per statistic, and flattened into
arrays: every tree is complete to one depth, so a batch of documents descends all trees at once
with ``2 * node + 1 + (value > threshold)``.

Defined cases: null and empty texts have statistics of zero and are scored like any other; null
labels are no labels; of repeated labels the larger holds; without both classes among the labels
every score is the share of label 1 (0.5 without labels). Other columns are kept and never read.
"""

from __future__ import annotations

import operator
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from payload_metrics.llm.common import known_labels, labelled_sample

BINS, DEPTH, ROUNDS, RATE, RIDGE, LEAST = 64, 4, 80, 0.15, 1.0, 2.0
STATISTICS = [
    "words",
    "mean_word",
    "deviation_word",
    "longest_word",
    "distinct_words",
    "commonest_word",
    "repeated_next",
    "letters",
    "capitals",
    "digits",
    "blanks",
    "stops",
    "symbols",
    "beyond_ascii",
    "line_length",
    "repeated_lines",
]


def _byte_kinds() -> np.ndarray:
    """256 rows, a column each for letters, capitals, digits, blanks, stops, symbols, the rest."""
    kinds = np.zeros((256, 7))
    for byte in range(256):
        char = chr(byte)
        if byte >= 128:
            kinds[byte, 6] = 1
        elif char.isalpha():
            kinds[byte, 0] = 1
            kinds[byte, 1] = char.isupper()
        elif char.isdigit():
            kinds[byte, 2] = 1
        elif char.isspace():
            kinds[byte, 3] = 1
        else:
            kinds[byte, 4 if char in ".,;:?'\"-()" else 5] = 1
    return kinds


BYTE_KINDS = _byte_kinds()


def statistics(text: str) -> list[float]:
    """The values of ``STATISTICS`` for a whole text."""
    words = text.split()
    if not words:
        return [0.0] * len(STATISTICS)
    data = text.encode("utf-8", "surrogatepass")
    kinds = np.bincount(np.frombuffer(data, np.uint8), minlength=256) @ BYTE_KINDS / len(data)
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    counts = Counter(words)
    lines = text.split("\n")
    return [
        float(np.log1p(len(words))),
        float(lengths.mean()),
        float(lengths.std()),
        float(np.log1p(lengths.max())),
        len(counts) / len(words),
        max(counts.values()) / len(words),
        sum(map(operator.eq, words, words[1:])) / len(words),
        *kinds.tolist(),
        float(np.log1p(len(text) / len(lines))),
        1 - len(set(lines)) / len(lines),
    ]


@dataclass(frozen=True)
class Forest:
    """``feature`` and ``threshold`` hold the inner nodes of each tree, ``leaf`` its leaves."""

    prior: float
    feature: np.ndarray
    threshold: np.ndarray
    leaf: np.ndarray

    def margins(self, x: np.ndarray) -> np.ndarray:
        trees, inner = self.feature.shape
        if not trees:
            return np.full(len(x), self.prior)
        rows, tree = np.arange(len(x))[:, None], np.arange(trees)
        node = np.zeros((len(x), trees), dtype=np.int64)
        while node[0, 0] < inner if len(x) else False:
            above = x[rows, self.feature[tree, node]] > self.threshold[tree, node]
            node = 2 * node + 1 + above
        return self.prior + self.leaf[tree, node - inner].sum(axis=1)

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margins(x), -30, 30)))


def fit(x: np.ndarray, y: np.ndarray, rounds: int = ROUNDS, depth: int = DEPTH) -> Forest:
    """Boosted trees for labels 0 and 1."""
    inner = 2**depth - 1
    share = y.mean() if len(y) else 0.5
    if share in (0.0, 1.0) or not len(y):
        prior = float(np.clip(np.log(share / (1 - share)) if 0 < share < 1 else 60 * share - 30, -30, 30))
        empty = np.zeros((0, inner))
        return Forest(prior, empty.astype(np.int64), empty, np.zeros((0, inner + 1)))
    edges = [np.unique(np.quantile(column, np.linspace(0, 1, BINS + 1)[1:-1])) for column in x.T]
    binned = np.stack([np.searchsorted(e, column, side="left") for e, column in zip(edges, x.T)], axis=1)
    n, width = binned.shape
    place = binned + np.arange(width) * BINS
    prior = float(np.log(share / (1 - share)))
    margin = np.full(n, prior)
    features, thresholds, leaves = [], [], []
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-margin))
        slope, curve = p - y, p * (1 - p)
        feature, cut = np.zeros(inner, dtype=np.int64), np.full(inner, BINS)
        node = np.zeros(n, dtype=np.int64)
        for level in range(depth):
            first, count = 2**level - 1, 2**level
            cells = ((node - first)[:, None] * (width * BINS) + place).ravel()
            shape = (count, width, BINS)
            g = np.bincount(cells, np.repeat(slope, width), count * width * BINS).reshape(shape).cumsum(axis=2)
            h = np.bincount(cells, np.repeat(curve, width), count * width * BINS).reshape(shape).cumsum(axis=2)
            all_g, all_h = g[:, :, -1:], h[:, :, -1:]
            gain = g**2 / (h + RIDGE) + (all_g - g) ** 2 / (all_h - h + RIDGE) - all_g**2 / (all_h + RIDGE)
            gain[(h < LEAST) | (all_h - h < LEAST)] = 0
            best = gain.reshape(count, -1).argmax(axis=1)
            good = gain.reshape(count, -1)[np.arange(count), best] > 1e-6
            feature[first : first + count] = np.where(good, best // BINS, 0)
            cut[first : first + count] = np.where(good, best % BINS, BINS)
            node = 2 * node + 1 + (binned[np.arange(n), feature[node]] > cut[node])
        leaf_of = node - inner
        g, h = (np.bincount(leaf_of, w, inner + 1) for w in (slope, curve))
        leaf = -RATE * g / (h + RIDGE)
        margin += leaf[leaf_of]
        ends = [np.append(e, np.full(BINS + 1 - len(e), np.inf)) for e in edges]
        features.append(feature)
        thresholds.append(np.array([ends[f][c] for f, c in zip(feature, cut)]))
        leaves.append(leaf)
    return Forest(prior, np.array(features), np.array(thresholds), np.array(leaves))


def train(docs: DataFrame, labels: DataFrame, per_class: int = 10_000) -> Forest:
    """Trees from ``labels (doc_id, quality)``.

    Learns from at most ``per_class`` labelled documents of each class, whole texts, picked by a
    hash of the id; the driver sees their statistics only.
    """
    sample = labelled_sample(docs, known_labels(labels, "quality"), per_class)
    found = F.pandas_udf(_statistics, "array<double>")
    # In one order, so that equal inputs give equal trees.
    rows = sample.select("doc_id", "y", found("text").alias("x")).orderBy("doc_id", "x").collect()
    x = np.array([row.x for row in rows]).reshape(len(rows), len(STATISTICS))
    return fit(x, np.array([row.y for row in rows], dtype=float))


def _statistics(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for texts in batches:
        yield pd.Series([statistics(text) for text in texts], dtype=object)


def _scorer(forest: Forest) -> Callable[[Iterator[pd.Series]], Iterator[pd.Series]]:
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            x = np.array([statistics(text) for text in texts]).reshape(len(texts), len(STATISTICS))
            parts = [forest.probabilities(x[at : at + 4096]) for at in range(0, len(x), 4096)]
            yield pd.Series(np.concatenate(parts) if parts else np.zeros(0))

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return run


def score(text: Column, forest: Forest) -> Column:
    """Probability of label 1."""
    return F.pandas_udf(_scorer(forest), "double")(F.coalesce(text, F.lit("")))
