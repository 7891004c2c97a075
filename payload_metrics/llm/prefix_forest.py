"""Approximate nearest neighbours by a forest of hash prefixes.

Every tree gives a vector a string of 64 bits, the sides of 64 random planes it lies on, and is
the sorted array of these strings. Vectors that share a longer prefix with a query are nearer to
it, and lie next to each other in the array. A query descends in every tree to its longest
matches; then all trees ascend together, one bit at a time, until enough different candidates
share the prefix. Candidates are ranked by exact cosine in double precision.

Vectors are dealt by a hash of their id into slices of bounded size, each with a forest of its
own, and queries into blocks; a task holds one slice and one block, and returns the nearest few
of its slice for each query of its block. A group of equal vectors is dealt out like any other.

The candidates of a slice are a share of it. On data whose neighbours are hardly nearer than
other vectors recall needs a large share; ``recall`` measures it against all pairs.

Defined cases: vectors that are null, empty, zero, or hold a null or non-finite component take no
part; vectors of another length than the query's are no candidates; rows with the query's id are
its own; equal scores go to the smaller id; rows of equal id and equal vector count once; an empty
table gives an empty result. Other columns are never read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BITS = 64
TREES = 32
SHARE = 0.45
LEAST = 400
SLICE_ROWS = 8192
BLOCK_QUERIES = 2048
FOUND = "query_id long, vec_id long, score double"


def usable(vector: Column) -> Column:
    """Not null or empty, all components finite, and not all zero."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & ~F.coalesce(bad, F.lit(True)) & F.exists(vector, lambda x: x != 0)


def nearest(
    vectors: DataFrame,
    is_query: Column,
    k: int = 5,
    trees: int = TREES,
    share: float = SHARE,
    least: int = LEAST,
    slice_rows: int = SLICE_ROWS,
    block_queries: int = BLOCK_QUERIES,
) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the ``k`` nearest found for the rows of ``is_query``."""
    used = vectors.where(F.col("vec_id").isNotNull() & usable(F.col("embedding")))
    used = used.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>")).distinct()
    queries = used.where(is_query)
    n, n_queries = used.count(), queries.count()
    slices, blocks = max(1, -(-n // slice_rows)), max(1, -(-n_queries // block_queries))
    every_block = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    every_slice = F.explode(F.sequence(F.lit(0), F.lit(slices - 1)))
    index = used.withColumn("slice", F.pmod(F.xxhash64("vec_id", "embedding"), F.lit(slices)).cast("int"))
    index = index.withColumn("block", every_block).groupBy("slice", "block")
    asked = queries.withColumn("block", F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(blocks)).cast("int"))
    asked = asked.withColumn("slice", every_slice).groupBy("slice", "block")

    def search(rows: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        return _search(rows, queries, k, trees, share, least)

    found = index.cogroup(asked).applyInPandas(search, FOUND)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    best = found.distinct().withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return best.select("query_id", "rank", "vec_id", "score")


class SliceForest:
    """Sorted hash strings of each tree over the rows of a slice."""

    def __init__(self, vectors: np.ndarray, trees: int):
        self._planes = np.random.default_rng(17).standard_normal((vectors.shape[1], trees * BITS))
        codes = self.codes(vectors)
        self._order = np.argsort(codes, axis=1, kind="stable")
        self._sorted = np.take_along_axis(codes, self._order, axis=1)

    def codes(self, vectors: np.ndarray) -> np.ndarray:
        """A row for each tree: the hash string of each vector, as a number that sorts like it."""
        found = []
        for tree in range(self._planes.shape[1] // BITS):
            sides = vectors @ self._planes[:, tree * BITS : (tree + 1) * BITS] > 0
            found.append(np.packbits(sides, axis=1).view(">u8").astype(np.uint64)[:, 0])
        return np.stack(found)

    def ranges(self, codes: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
        """Where, in each tree, the strings are that share the first ``length`` bits."""
        rest = np.uint64((1 << (BITS - length)) - 1)
        low = np.stack([np.searchsorted(s, c & ~rest, "left") for s, c in zip(self._sorted, codes)])
        high = np.stack([np.searchsorted(s, c | rest, "right") for s, c in zip(self._sorted, codes)])
        return low, high

    def candidates(self, vectors: np.ndarray, enough: int) -> list[np.ndarray]:
        """For each query the rows met when all trees have ascended far enough."""
        codes = self.codes(vectors)
        n = self._sorted.shape[1]
        enough = min(enough, n)
        by_length = {}
        # The longest prefix with enough matches, repeats between trees included, by bisection.
        low, high = np.zeros(len(vectors), dtype=int), np.full(len(vectors), BITS)
        while (low < high).any():
            middle = (low + high + 1) // 2
            for length in np.unique(middle).tolist():
                if length not in by_length:
                    by_length[length] = self.ranges(codes, length)
            met = np.array([(by_length[m][1][:, q] - by_length[m][0][:, q]).sum() for q, m in enumerate(middle.tolist())])
            low, high = np.where(met >= enough, middle, low), np.where(met >= enough, high, middle - 1)
        found = []
        for q, length in enumerate(low.tolist()):
            seen = np.zeros(n, dtype=bool)
            while True:
                if length not in by_length:
                    by_length[length] = self.ranges(codes, length)
                starts, stops = by_length[length]
                for order, a, b in zip(self._order, starts[:, q].tolist(), stops[:, q].tolist()):
                    seen[order[a:b]] = True
                if length == 0 or np.count_nonzero(seen) >= enough:
                    break
                length -= 1
            found.append(np.flatnonzero(seen))
        return found


def cosines(rows: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Row by row in one order of summation, so that equal rows score equally."""
    norms = np.sqrt((rows * rows).sum(axis=1)) * np.sqrt((query * query).sum())
    return (rows * query).sum(axis=1) / norms


def scaled(vectors: np.ndarray) -> np.ndarray:
    """Every vector by a power of two, so that its largest component lies in [0.5, 1): no square
    overflows, and nothing is rounded that is not tiny beside it."""
    return np.ldexp(vectors, -np.frexp(np.abs(vectors).max(axis=1, keepdims=True))[1])


def _search(rows: pd.DataFrame, queries: pd.DataFrame, k: int, trees: int, share: float, least: int) -> pd.DataFrame:
    found = []
    lengths = rows["embedding"].map(len) if len(rows) else pd.Series(dtype=int)
    for length in lengths.unique().tolist():
        own = rows[lengths == length]
        asked = queries[queries["embedding"].map(len) == length] if len(queries) else queries
        if not len(asked):
            continue
        ids = own["vec_id"].to_numpy()
        vectors, wanted = np.stack(own["embedding"].to_numpy()), np.stack(asked["embedding"].to_numpy())
        vectors, wanted = scaled(vectors), scaled(wanted)
        unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
        forest = SliceForest(vectors, trees)
        met = forest.candidates(wanted, max(least, int(np.ceil(share * len(ids)))))
        for query_id, query, candidates in zip(asked["vec_id"].tolist(), wanted, met):
            candidates = candidates[ids[candidates] != query_id]
            if not len(candidates):
                continue
            rough = unit[candidates] @ (query / np.linalg.norm(query))
            if len(rough) > k:
                # All that rounding could bring among the first, ties included.
                candidates = candidates[rough >= np.partition(rough, -k)[-k] - 1e-9]
            exact = cosines(vectors[candidates], query)
            first = np.lexsort((ids[candidates], -exact))[:k]
            found += zip([query_id] * len(first), ids[candidates][first].tolist(), exact[first].tolist())
    return pd.DataFrame(found, columns=["query_id", "vec_id", "score"])


def recall(vectors: DataFrame, is_query: Column, found: DataFrame, k: int = 5) -> float:
    """Share of the true ``k`` nearest that were found, by exact search over all rows."""
    exact = nearest(vectors, is_query, k, trees=1, share=1.0)
    hits = exact.join(found.select("query_id", "vec_id"), ["query_id", "vec_id"]).count()
    return hits / max(exact.count(), 1)
