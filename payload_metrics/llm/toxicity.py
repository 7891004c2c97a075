"""Toxicity by compression distance: one zstandard dictionary each for toxic and ordinary text.

A window of text is compressed twice, once with the ordinary dictionary and once with the toxic
dictionary laid over it; the bytes that the toxic dictionary saves are the window's distance. A
document's score is a logistic function of how many of its windows save at least so many bytes,
with weights calibrated on labelled documents that the dictionaries have not seen.

Both dictionaries are trained on the windows of labelled texts alone, a window as often as there are
texts that hold it. A toxic text is ordinary for the most part, and so is its first dictionary. Some
rounds of compression part the two: windows of ordinary texts that the toxic dictionary shortens
are added to the ordinary one, and the toxic dictionary is trained anew on the windows of toxic
texts that it still shortens.

Windows are single words, because an insult is one word among hundreds. zstandard stores tiny
blocks as they are and finds no match in the last 8 bytes of a block, so every window is
compressed between a fixed lead and tail that both dictionaries hold. Equal windows have equal
lengths, so a worker remembers them.

Defined cases: null and empty texts have no window and get the score of a text that saves
nothing; documents without a label are scored like any other; a null label is no label; of
repeated labels the larger holds; without both classes among the labels every score is the share
of toxic labels (0 without labels). Other columns are kept and never read.
"""

from __future__ import annotations

import itertools
import random
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from payload_metrics.llm.common import fit_logistic, known_labels, labelled_sample, new_folder
from payload_metrics.sources.tables import discard, stage

LEAD, TAIL = b"\x01\x02lead-in of words\x03 ", b" \x04tail of words\x05"
SAVED = (1, 2, 3, 4)
#: Lengths of the byte groups that the trainer counts, and of the pieces it puts together from them.
GROUP, TOXIC_PIECE, ORDINARY_PIECE = 6, 14, 32
REMEMBERED = 80_000
AT_ONCE = 20_000
LEAST_CONTENT = 32_768
CHUNK = 100


@dataclass(frozen=True)
class ToxicityModel:
    toxic: bytes
    ordinary: bytes
    weights: tuple[float, ...]

    @property
    def constant(self) -> bool:
        return len(self.weights) == 1


def train(
    docs: DataFrame,
    labels: DataFrame,
    per_class: int = 3000,
    toxic_bytes: int = 65_536,
    ordinary_bytes: int = 300_000,
    windows: int = 400_000,
    rounds: int = 3,
) -> ToxicityModel:
    """Dictionaries and thresholds from ``labels (doc_id, toxic)``.

    Learns from a sample of at most ``per_class`` labelled documents of each class, whole texts,
    picked by a hash of the id. Two thirds of them train the dictionaries, of at most so many bytes
    at first, from about ``windows`` windows of each class, picked by a hash; one third calibrates.
    """
    spark = docs.sparkSession
    known = known_labels(labels, "toxic")
    path = new_folder(spark, "toxicity-sample")
    sample = stage(labelled_sample(docs, known, per_class), "toxicity-sample", path)
    per_y = dict(sample.groupBy("y").count().collect())
    if len(per_y) < 2:
        return ToxicityModel(b"", b"", (float(max(per_y, default=0)),))
    part = F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(3)) != 0
    toxic, ordinary = _dictionaries(_windows(sample.where(part), windows), toxic_bytes, ordinary_bytes, rounds)
    model = ToxicityModel(toxic, ordinary, ())
    features = F.arrow_udf(_scorer(model), "array<double>")
    rows = sample.select("y", (~part).alias("held"), features("text").alias("x")).collect()
    discard(spark, path)
    held = [r for r in rows if r.held]
    used = held if len({r.y for r in held}) == 2 else rows
    x, y = np.array([r.x for r in used]), np.array([r.y for r in used], dtype=float)
    return ToxicityModel(toxic, ordinary, tuple(fit_logistic(x, y).tolist()))


def _windows(sample: DataFrame, windows: int) -> dict[int, dict[bytes, int]]:
    """For each class, its windows and in how many of the different texts each stands."""
    texts = sample.groupBy("text").agg(F.max("y").alias("y"))
    words = F.split(F.lower("text"), r"\s+")
    each = texts.select("y", F.xxhash64("text").alias("of"), F.explode(F.array_distinct(words)).alias("word")).where("word != ''")
    totals = dict(each.groupBy("y").count().collect())
    found: dict[int, dict[bytes, int]] = {0: {}, 1: {}}
    for y, total in totals.items():
        picked = F.pmod(F.xxhash64("of", "word"), F.lit(1 << 20)) < int((1 << 20) * min(windows / total, 1))
        counted = each.where((F.col("y") == y) & picked).groupBy("word").agg(F.count("*").alias("n")).orderBy("word").toArrow()
        found[y] = {word.encode(): n for word, n in zip(counted["word"].to_pylist(), counted["n"].to_pylist())}
    return found


def _dictionaries(
    counts: dict[int, dict[bytes, int]], toxic_bytes: int, ordinary_bytes: int, rounds: int
) -> tuple[bytes, bytes]:
    ordinary = _trained(ordinary_bytes, counts[0], ORDINARY_PIECE)
    toxic = _trained(toxic_bytes, counts[1], TOXIC_PIECE)
    for _ in range(rounds):
        saved = WindowDistance(ToxicityModel(toxic, ordinary, ())).lengths(list(counts[0]))
        shortened = [word for word, n in saved.items() if n > 0]
        ordinary = b" ".join([b"", *shortened, b""]) + ordinary
        saved = WindowDistance(ToxicityModel(toxic, ordinary, ())).lengths(list(counts[1]))
        toxic = _trained(toxic_bytes, {word: counts[1][word] for word, n in saved.items() if n > 0}, TOXIC_PIECE)
    return toxic, ordinary


def _trained(size: int, counts: dict[bytes, int], piece: int) -> bytes:
    """A dictionary trained on windows, each as often as counted, in an order of no meaning; windows
    too few for the trainer are the dictionary themselves."""
    # Short words are repeated so that the trainer sees them whole, with a space on each side.
    samples = [b" " + (w + b" ") * max(2, -(-16 // (len(w) + 1))) for w, n in counts.items() for _ in range(n)]
    random.Random(size).shuffle(samples)
    try:
        return zstandard.train_dictionary(size, samples, k=piece, d=GROUP, level=3).as_bytes()
    except zstandard.ZstdError:
        return b"".join(dict.fromkeys(samples))[-size:]


def score(text: Column, model: ToxicityModel) -> Column:
    """Probability that ``text`` is toxic."""
    if model.constant:
        return F.lit(model.weights[0])
    features = F.arrow_udf(_scorer(model), "double")
    return features(F.coalesce(text, F.lit("")))


def classify(docs: DataFrame, model: ToxicityModel, threshold: float = 0.7) -> DataFrame:
    """``docs`` with ``toxic_score`` and ``toxic_predicted``; columns of these names are replaced."""
    scored = docs.withColumn("toxic_score", score(F.col("text"), model))
    return scored.withColumn("toxic_predicted", (F.col("toxic_score") >= threshold).cast("int"))


def _compressor(content: bytes) -> zstandard.ZstdCompressor:
    # Below 16 KB zstandard matches in another way, which would tell dictionaries apart by their size.
    content = content.rjust(LEAST_CONTENT, b"\0")
    dictionary = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    params = zstandard.ZstdCompressionParameters(
        window_log=19,
        hash_log=18,
        chain_log=19,
        search_log=9,
        min_match=4,
        target_length=64,
        strategy=zstandard.STRATEGY_GREEDY,
        format=zstandard.FORMAT_ZSTD1_MAGICLESS,
        write_content_size=False,
        write_checksum=False,
        write_dict_id=False,
    )
    dictionary.precompute_compress(compression_params=params)
    return zstandard.ZstdCompressor(dict_data=dictionary, compression_params=params)


class WindowDistance:
    """Bytes saved by the toxic dictionary, for words; remembers the words of late."""

    def __init__(self, model: ToxicityModel):
        shared = model.ordinary + LEAD + TAIL
        self._ordinary = _compressor(shared)
        self._toxic = _compressor(model.toxic + shared)
        self._young: dict[bytes, int] = {}
        self._old: dict[bytes, int] = {}

    def of(self, documents: list[list[bytes]]) -> list[list[int]]:
        """For each document the distances of its windows, without those of 0."""
        if len(self._young) > REMEMBERED:
            self._old, self._young = self._young, {}
        young, old = self._young, self._old
        new = set().union(*documents) - young.keys()
        fresh = []
        for word in new:
            if word in old:
                young[word] = old[word]
            else:
                fresh.append(word)
        young.update(self.lengths(fresh))
        return [[saved for word in words if (saved := young[word])] for words in documents]


    def lengths(self, windows: list[bytes]) -> dict[bytes, int]:
        """What the toxic dictionary saves of each window."""
        saved = {}
        for some in itertools.batched(windows, AT_ONCE):
            framed = [LEAD + window + TAIL for window in some]
            ordinary = self._ordinary.multi_compress_to_buffer(framed, threads=1)
            toxic = self._toxic.multi_compress_to_buffer(framed, threads=1)
            saved |= {window: len(ordinary[i]) - len(toxic[i]) for i, window in enumerate(some)}
        return saved


def _features(saved: list[int], n_words: int) -> list[float]:
    bytes_saved = np.array(saved, dtype=float)
    counts = [float((bytes_saved >= k).sum()) for k in SAVED]
    total = float(bytes_saved[bytes_saved >= SAVED[1]].sum())
    shares = [np.log1p(1000 * c / max(n_words, 1)) for c in [*counts, total]]
    return [*np.log1p(counts).tolist(), *shares]


_distances: dict[ToxicityModel, WindowDistance] = {}


def _distance(model: ToxicityModel) -> WindowDistance:
    """One per worker and model; what it remembers outlives a task."""
    if model not in _distances:
        _distances.clear()
        _distances[model] = WindowDistance(model)
    return _distances[model]


def _scorer(model: ToxicityModel) -> Callable[[pa.Array], pa.Array]:
    """Features of each text, or its probability once the model has weights."""

    def run(texts: pa.Array) -> pa.Array:
        distance, weights = _distance(model), np.array(model.weights)
        rows = []
        # A few texts at a time are taken out of the batch.
        for start in range(0, len(texts), CHUNK):
            words = [text.lower().encode().split() for text in texts.slice(start, CHUNK).to_pylist()]
            rows += [_features(s, len(w)) for s, w in zip(distance.of(words), words)]
        if not len(weights):
            return pa.array(rows, pa.list_(pa.float64()))
        x = np.array(rows).reshape(len(rows), len(weights) - 1)
        return pa.array(1 / (1 + np.exp(-np.clip(x @ weights[:-1] + weights[-1], -30, 30))))

    run.__annotations__ = {"texts": pa.Array, "return": pa.Array}
    return run
