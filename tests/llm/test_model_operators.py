"""Packing, archives, the language model, quality and neighbours on small fixtures, and the pipeline."""

from __future__ import annotations

import bisect
import gzip
import hashlib
import itertools
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from payload_metrics.llm import hidden_markov, packing, prefix_forest, quality, warc
from payload_metrics.llm.common import DOCUMENT_COLUMNS, new_folder, tokenizer_path
from payload_metrics.llm.queries import QUERIES
from payload_metrics.sources.tables import stage


def words(rng, n):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8))) for _ in range(n))


# --- packing


def best_fit_decreasing(histogram, capacity):
    rooms, bins = [], 0
    for length in sorted(histogram, reverse=True):
        for _ in range(histogram[length]):
            at = bisect.bisect_left(rooms, length)
            bins += at == len(rooms)
            room = rooms.pop(at) if at < len(rooms) else capacity
            bisect.insort(rooms, room - length)
    return bins


@pytest.mark.parametrize("seed", range(40))
def test_plan_is_best_fit(seed):
    rng = random.Random(seed)
    capacity = rng.choice([10, 64, 4096])
    histogram = {rng.randint(1, capacity): rng.randint(1, rng.choice([3, 40])) for _ in range(rng.randint(0, 40))}
    groups = packing.plan(histogram, capacity)
    ranks, content = {}, {}
    for length, rank, bins, each, sequence, offset in packing.plan_rows(groups):
        for b in range(bins):
            for i in range(each):
                ranks.setdefault(length, []).append(rank + b * each + i)
                content.setdefault(sequence + b, []).append((offset + i * length, length))
    assert {k: sorted(v) for k, v in ranks.items()} == {k: list(range(n)) for k, n in histogram.items()}
    for pieces in content.values():
        pieces.sort()
        ends = list(itertools.accumulate(length for _, length in pieces))
        assert [o for o, _ in pieces] == [0, *ends[:-1]] and ends[-1] <= capacity
    assert len(content) <= best_fit_decreasing(histogram, capacity)


def test_packing_round_trip(spark, monkeypatch):
    from tokenizers import Tokenizer

    monkeypatch.setattr(packing, "RANKED_TOGETHER", 20)
    rng = random.Random(1)
    texts = [None, "", " \n", "Don't stop <|endoftext|> now", "a\x1cb ﬁ é", words(rng, 3000)]
    texts += [words(rng, rng.choice([5, 5, 5, 300])) for _ in range(80)]
    rows = [(i, t, 1) for i, t in enumerate(texts)] + [(None, "null id", 1), (0, None, 1), (3, texts[3], 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, length int")
    pieces = stage(packing.tokenize(docs, tokenizer_path(), 512, with_ids=True), "pieces")
    packed = packing.pack(pieces, 512)
    joined = {r.sequence_id: r.ids for r in packing.sequences(packed).collect()}
    tokenizer = Tokenizer.from_file(tokenizer_path())
    found = {}
    for r in packed.collect():
        own = joined[r.sequence_id][4 * r.offset : 4 * (r.offset + r.length)]
        assert own == r.ids and zlib.crc32(own) == r.ids_crc32 and r.start == 512 * r.piece
        found.setdefault((r.doc_id, r.piece), []).append(own)
    expected = {}
    for i, text, _ in rows:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [packing.END_ID]
        for piece, at in enumerate(range(0, len(ids), 512)):
            expected.setdefault((i, piece), []).append(np.array(ids[at : at + 512], dtype="<u4").tobytes())
    assert {k: sorted(v) for k, v in found.items()} == {k: sorted(v) for k, v in expected.items()}
    assert sum(map(len, joined.values())) == sum(len(x) for v in expected.values() for x in v)
    assert packing.pack_documents(docs.limit(0), tokenizer_path()).count() == 0


# --- archives


def test_archives_round_trip(spark):
    rng = random.Random(2)
    long = "<p>Été\r\n\r\nWARC/1.1\r\nContent-Length: 5\r\n\r\n" + words(rng, 60)
    pages = [(i, f"http://h/{i}", rng.choice([long, long + "x", words(rng, 30), "short", "", None])) for i in range(80)]
    pages += [(None, "http://h/null", long), (None, None, None), (5, "http://h/again", pages[5][2]), (200, "http://a b\n", long)]
    frame = spark.createDataFrame([(*p, 1, "d") for p in pages], "page_id long, url string, html string, row int, digest string")
    path = new_folder(spark, "test-archives")
    captured = warc.captures(frame)
    warc.write_archives(captured, path, "2025-01-01T00:00:00Z")
    records = stage(warc.read_archives(spark, path), "records")
    found = warc.resolved(records).collect()
    firsts, expected = {}, []
    for page_id, _, html in sorted(pages, key=lambda p: (p[0] is None, p[0] or 0)):
        payload = (html or "").encode()
        digest = hashlib.sha256(payload).hexdigest()
        first = len(payload) < warc.MIN_BYTES or digest not in firsts
        if first and len(payload) >= warc.MIN_BYTES:
            firsts[digest] = page_id
        expected.append((page_id, "response" if first else "revisit", None if first else firsts[digest], len(payload), digest))
    assert sorted(map(tuple, found), key=repr) == sorted(expected, key=repr)
    assert {bytes(r.payload).decode() for r in records.where("type = 'response'").collect()} == {p[2] or "" for p in pages}
    again = new_folder(spark, "test-archives")
    warc.write_archives(warc.from_archive(records), again, "2025-02-02T00:00:00Z")
    anew = stage(warc.read_archives(spark, again), "records")
    assert sorted(map(tuple, warc.resolved(anew).collect()), key=repr) == sorted(map(tuple, found), key=repr)
    assert not {r.record_id for r in anew.collect()} & {r.record_id for r in records.collect()}
    assert {r.date for r in anew.collect()} == {"2025-02-02T00:00:00Z"}
    empty = new_folder(spark, "test-archives")
    warc.write_archives(warc.captures(frame.limit(0)), empty, "2025-01-01T00:00:00Z")
    assert warc.read_archives(spark, empty).count() == 0


def test_members_of_a_gzip_file_are_one_stream():
    data = random.Random(3).randbytes(200_000)
    content = b"".join(gzip.compress(data[i : i + 30_000]) for i in range(0, len(data), 30_000))
    assert warc._opened(content).read() == data


# --- hidden Markov model


def all_paths(p, symbols):
    """Probability of the symbols, and of each state at each place, by summing over every path."""
    states, total = range(len(p.initial)), 0.0
    visits = np.zeros((len(symbols), len(p.initial)))
    for path in itertools.product(states, repeat=len(symbols)):
        weight = p.initial[path[0]] * p.emission[symbols[0], path[0]]
        for a, b, s in zip(path, path[1:], symbols[1:]):
            weight *= p.transition[a, b] * p.emission[s, b]
        total += weight
        for t, k in enumerate(path):
            visits[t, k] += weight
    return total, visits / total


def test_recursions_match_all_paths():
    rng = np.random.default_rng(4)
    p = hidden_markov.Parameters(rng.dirichlet([1] * 3), rng.dirichlet([1] * 3, 3), rng.dirichlet([1] * 5, 3).T)
    texts = [rng.integers(0, 5, n) for n in (1, 6, 3, 3, 5, 1)]
    step = hidden_markov._InStep(texts)
    scores = step.log10(step.forward(p)[1])
    initial, transition, emission = step.expected(p)
    expected = np.zeros_like(p.emission)
    for text, score in zip(texts, scores):
        total, visits = all_paths(p, text)
        assert score == pytest.approx(math.log10(total))
        for s, v in zip(text, visits):
            expected[s] += v
    assert emission == pytest.approx(expected)
    assert initial.sum() == pytest.approx(len(texts))
    assert transition.sum() == pytest.approx(sum(len(t) - 1 for t in texts))


def test_language_model_on_documents(spark):
    rng = random.Random(5)
    tongues = [[words(rng, 1) for _ in range(60)] for _ in range(2)]
    rows = [(i, " ".join(rng.choices(tongues[i % 2], k=rng.randint(1, 40)))) for i in range(150)]
    rows += [(900, None), (901, ""), (902, "UNKNOWN ünknown"), (None, "null id"), rows[0]]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    training = docs.where("doc_id IS NULL OR doc_id % 5 != 0").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    vocab = hidden_markov.vocabulary(training, head=40)
    p = hidden_markov.train(training, vocab, states=2)
    found = hidden_markov.score(docs, vocab, p).collect()
    counts = Counter()
    for i, text in rows:
        if i is None or i % 5:
            counts.update([*(text or "").encode().lower().split(), None])
    tokens, distinct = sum(counts.values()), len(counts)
    assert (vocab.tokens, vocab.distinct) == (tokens, distinct)
    expected, forward = [], {}
    for i, text in rows:
        own = [*(text or "").encode().lower().split(), None]
        base = sum(math.log10((counts[w] + 1) / (tokens + distinct + 1)) for w in own)
        step = hidden_markov._InStep([hidden_markov.encode(own[:-1], vocab.head)])
        score = step.log10(step.forward(p)[1])[0]
        for w in own[:-1]:
            if w not in vocab.head:
                k = hidden_markov.class_of(w)
                score += math.log10((counts[w] + 1) / (vocab.class_tokens[k] + vocab.class_words[k] + 1))
        expected.append((i or -1, len(own), sum(counts[w] > 0 for w in own), round(base, 6), round(score, 6)))
    got = [(r.doc_id or -1, r.n_tokens, r.n_known, round(r.base_score, 6), round(r.score, 6)) for r in found]
    assert sorted(got) == sorted(expected)
    assert sum(r.score for r in found) > sum(r.base_score for r in found)
    assert p.emission.sum(axis=0) == pytest.approx(1) and p.transition.sum(axis=1) == pytest.approx(1)


def test_language_model_without_training(spark):
    docs = spark.createDataFrame([(1, "some words"), (2, None)], "doc_id long, text string")
    nothing = docs.where("doc_id > 9")
    vocab = hidden_markov.vocabulary(nothing)
    found = hidden_markov.score(docs, vocab, hidden_markov.train(nothing, vocab)).collect()
    assert {(r.doc_id, r.n_tokens, r.n_known, r.base_score) for r in found} == {(1, 3, 0, 0.0), (2, 1, 0, 0.0)}
    assert all(r.score < 0 for r in found)


# --- quality


def plain_margin(forest, row):
    total = forest.prior
    for feature, threshold, leaf in zip(forest.feature, forest.threshold, forest.leaf):
        node = 0
        while node < len(feature):
            node = 2 * node + 1 + bool(row[feature[node]] > threshold[node])
        total += leaf[node - len(feature)]
    return total


def test_trees_learn_and_flatten():
    rng = np.random.default_rng(6)
    x = rng.random((1500, 5)).round(2)
    y = ((x[:, 0] > 0.5) ^ (x[:, 3] > 0.3)).astype(float)
    forest = quality.fit(x[:1000], y[:1000])
    assert ((forest.probabilities(x[1000:]) >= 0.5) == y[1000:]).mean() > 0.97
    assert forest.margins(x[:50]) == pytest.approx([plain_margin(forest, row) for row in x[:50]])
    for share in (0.0, 1.0):
        assert quality.fit(x, np.full(1500, share)).probabilities(x[:3]) == pytest.approx(share)
    assert quality.fit(np.zeros((0, 5)), np.zeros(0)).probabilities(x[:3]) == pytest.approx(0.5)


def test_quality_of_documents(spark):
    rng = random.Random(7)
    rows, labels = [], []
    for i in range(200):
        text = words(rng, rng.randint(5, 60))
        rows.append((i, text if i % 2 else text.replace(" ", " %$ "), "x"))
        labels.append((i, i % 2))
    rows += [(900, None, "x"), (901, " ", "x"), (902, words(rng, 30_000), "x"), rows[0]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string")
    known = spark.createDataFrame([*[x for x in labels if x[0] % 3], (1, None), (None, 0)], "doc_id long, quality int")
    forest = quality.train(docs, known)
    found = docs.select("doc_id", quality.score(F.col("text"), forest).alias("p")).collect()
    scores = {r.doc_id: r.p for r in found}
    assert len(found) == len(rows) and all((scores[i] >= 0.5) == bool(y) for i, y in labels)
    assert scores[900] == scores[901] and scores[902] > 0.5


# --- nearest neighbours


def test_forest_against_all_pairs(spark):
    rng = np.random.default_rng(8)
    vectors = rng.standard_normal((1200, 16)).astype(np.float32)
    vectors[600:] = vectors[:600] + 0.2 * rng.standard_normal((600, 16)).astype(np.float32)
    vectors[100:180] = vectors[3]  # ties between equal vectors
    rows = [(i, v.tolist(), 1) for i, v in enumerate(vectors)]
    odd = [(5000, None, 1), (5050, [], 1), (5100, [0.0] * 16, 1), (5150, [float("nan")] * 16, 1), (5200, [None] + [1.0] * 15, 1)]
    odd += [(5250, [1.0, 2.0], 1), (5300, [2.0, 4.0], 1), (5350, [float("inf")] * 16, 1), (None, [1.0] * 16, 1), rows[50]]
    frame = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>, score int")
    is_query = F.col("vec_id") % 50 == 0
    found = prefix_forest.nearest(frame, is_query, share=0.2, least=60, slice_rows=500, block_queries=10)
    exact = prefix_forest.nearest(frame, is_query, trees=1, share=1.0)
    assert prefix_forest.recall(frame, is_query, found) >= 0.9
    got = {}
    for r in exact.orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r["rank"], r.score))
    wide = vectors.astype(float)
    for q in range(0, 1200, 50):
        scores = (wide * wide[q]).sum(axis=1) / np.sqrt((wide**2).sum(axis=1) * (wide[q] ** 2).sum())
        order = [i for i in np.lexsort((np.arange(1200), -scores.round(12))) if i != q][:5]
        assert [v for v, _, _ in got[q]] == order and [k for _, k, _ in got[q]] == [1, 2, 3, 4, 5]
        assert [s for _, _, s in got[q]] == pytest.approx(scores[order])
    assert [v for v, _, _ in got[5250]] == [5300] and set(got) == {*range(0, 1200, 50), 5250, 5300}
    assert prefix_forest.nearest(frame.limit(0), is_query).count() == 0


# --- pipeline


def test_pipeline_stages(spark, tmp_path):
    rng = random.Random(9)
    item = words(rng, 30)
    rows = [(i, words(rng, 40) + "\nall rights reserved", "en", f"s{i % 2}", 10) for i in range(60)]
    rows += [(100, rows[7][1], "en", "s1", 10), (101, words(rng, 9) + " " + item, "en", "s0", 10), (102, None, None, None, None)]
    rows += [(200 + i, words(rng, 30) + " blorgface znit quxhead blorgface", "en", "s0", 10) for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(i, 1, int(i >= 200)) for i, *_ in rows if i < 60 or i >= 200]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    kept = []
    for name, run in corpus_pipeline.STAGES:
        docs = stage(run(spark, docs, str(tmp_path)), name)
        kept.append({r.doc_id for r in docs.collect()})
        if name != "packing":
            assert docs.columns == DOCUMENT_COLUMNS
        if name == "line_dedup":
            cut = docs.where("doc_id < 60").collect()
            assert all("rights" not in r.text and r.n_chars == len(r.text) for r in cut)
    toxic = set(range(200, 220))
    every = {r[0] for r in rows}
    assert len(kept[0] & toxic) <= 2 and kept[0] >= every - toxic
    assert kept[1] == kept[0] and kept[2] == kept[1] - {100} and kept[3] == kept[2] - {101} == kept[4]
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == docs.count()


def test_pipeline_on_empty_tables(spark, tmp_path):
    for name, schema in [
        ("documents", "doc_id long, text string, lang string, source string, n_chars long"),
        ("labels", "doc_id long, quality int, toxic int"),
        ("benchmark", "item_id long, text string"),
    ]:
        spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_queries_on_empty_tables(spark, tmp_path, name):
    """Every query runs on tables without a row and gives none."""
    schemas = {
        "documents": "doc_id long, text string, lang string, source string, n_chars long",
        "labels": "doc_id long, quality int, toxic int",
        "benchmark": "item_id long, text string",
        "pages": "page_id long, url string, html string",
        "embeddings": "vec_id long, embedding array<float>, label int",
    }
    for table, schema in schemas.items():
        spark.createDataFrame([], schema).write.parquet(str(tmp_path / f"{table}.parquet"))
    assert QUERIES[name](spark, str(tmp_path)).collect() == []


def test_scores_of_the_markov_model_beside_clashing_columns(spark):
    """Columns of the operator's own names do not get in its way."""
    rows = [(i, f"a b c {'d' * (i % 3 + 1)}", 7, 7.0, "x") for i in range(12)] + [(99, None, 1, 1.0, "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int, score double, word string")
    plain = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    vocab = hidden_markov.vocabulary(plain)
    scored = hidden_markov.score(docs.withColumn("text", F.coalesce("text", F.lit(""))), vocab, hidden_markov.train(plain, vocab))
    same = hidden_markov.score(plain, vocab, hidden_markov.train(plain, vocab))
    want = {r["doc_id"]: r["n_tokens"] for r in same.collect()}
    assert {r["doc_id"]: r["n_tokens"] for r in scored.select(*same.columns).collect()} == want
