"""Columns and small steps that several operators share."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from payload_metrics.sources.tables import shared_folder

DOCUMENT_COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(name: str = "text") -> Column:
    """The text column; null counts as empty."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def fold_of(name: str, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; a null id is in fold 0."""
    return F.coalesce(F.crc32(F.col(name).cast("string")), F.lit(0)) % folds


def new_folder(spark: SparkSession, name: str) -> str:
    """A folder of its own in the cluster's shared folder."""
    return f"{shared_folder(spark)}/llm/{name}-{uuid.uuid4().hex}"


def known_labels(labels: DataFrame, name: str) -> DataFrame:
    """One row ``(doc_id, y)`` per labelled document; of repeated labels the largest holds."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col(name).isNotNull())
    return known.groupBy("doc_id").agg(F.max(F.col(name).cast("int")).alias("y"))


def labelled_sample(docs: DataFrame, labels: DataFrame, per_class: int, hash_seed: int = 0) -> DataFrame:
    """Whole texts ``(doc_id, text, y)`` of at most ``per_class`` labelled documents per class.

    Documents are picked by a hash of their id, so the pick does not depend on their order.
    Only ids and labels are ranked; the texts are then found by a join on the picked ids. An id
    that several rows have gives one of them, the smallest text, so the bound holds for rows.
    """
    ranked = labels.withColumn("_h", F.xxhash64("doc_id", F.lit(hash_seed)))
    picked = None
    for y in (0, 1):
        one = ranked.where(F.col("y") == y).orderBy("_h", "doc_id").limit(per_class).drop("_h")
        picked = one if picked is None else picked.unionByName(one)
    found = docs.select("doc_id", text_of().alias("text")).join(F.broadcast(picked), "doc_id")
    return found.groupBy("doc_id", "y").agg(F.min("text").alias("text")).select("doc_id", "text", "y")


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3, steps: int = 50) -> np.ndarray:
    """Weights and a last intercept, by Newton's method on standardised columns."""
    mean, scale = x.mean(0), x.std(0)
    scale[scale == 0] = 1.0
    z = np.column_stack([(x - mean) / scale, np.ones(len(x))])
    w = np.zeros(z.shape[1])
    penalty = np.full(z.shape[1], ridge * len(y))
    penalty[-1] = 1e-6
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        slope = z.T @ (p - y) + penalty * w
        curve = (z * (p * (1 - p))[:, None]).T @ z + np.diag(penalty) + 1e-9 * np.eye(len(w))
        step = np.linalg.solve(curve, slope)
        w -= np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    plain = w[:-1] / scale
    return np.append(plain, w[-1] - plain @ mean)


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    """Where the public tokenizer lies on every machine."""
    import public_tokenizers

    return public_tokenizers.path(name)
