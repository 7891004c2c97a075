"""One query per operator over its whole table, with its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from payload_metrics.llm import (
    byte_bpe,
    decontaminate,
    hidden_markov,
    packing,
    prefix_forest,
    quality,
    secrets,
    simhash,
    site_lines,
    spelling,
    toxicity,
    warc,
    whitening,
)
from payload_metrics.llm.common import fold_of, new_folder, table, text_of, tokenizer_path
from payload_metrics.sources.tables import stage

Query = Callable[[SparkSession, str], DataFrame]


def op1_boosted_tree_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = fold_of("doc_id", 4) == 2
    forest = quality.train(docs, table(spark, sf_dir, "labels").where(~held_out))
    scored = docs.select("doc_id", held_out.alias("held_out"), quality.score(F.col("text"), forest).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.7).cast("int"))


def op2_simhash_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return named.select("doc_id", simhash.as_hex(F.col("fp")).alias("fingerprint"), "component_id")


def op3_pigeonhole_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, benchmark = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    return decontaminate.contaminated(docs, benchmark)


def op4_compression_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = fold_of("doc_id", 3) == 1
    model = toxicity.train(docs, table(spark, sf_dir, "labels").where(~held_out))
    scored = toxicity.classify(docs.select("doc_id", "text"), model)
    return scored.select(
        "doc_id",
        held_out.alias("held_out"),
        F.col("toxic_score").alias("score"),
        F.col("toxic_predicted").alias("predicted"),
    )


def op5_hidden_markov_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", text_of().alias("text"))
    held_out = fold_of("doc_id", 7) == 2
    training = docs.where(~held_out)
    vocab = hidden_markov.vocabulary(training)
    scored = hidden_markov.score(docs, vocab, hidden_markov.train(training, vocab))
    return scored.select(
        "doc_id",
        held_out.alias("held_out"),
        "n_tokens",
        "n_known",
        F.lit(vocab.tokens).cast("long").alias("train_tokens"),
        "base_score",
        "score",
    )


def op6_prefix_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_forest.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op7_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_folder(spark, "archives")
    warc.write_archives(warc.captures(table(spark, sf_dir, "pages")), path, date="2025-01-01T00:00:00Z")
    headers = warc.read_archives(spark, path, with_payload=False).drop("payload")
    records = warc.resolved(stage(headers, "records", new_folder(spark, "records")))
    return records.select(
        "page_id",
        F.col("full_bytes").alias("payload_bytes"),
        F.col("full_digest").alias("payload_digest"),
        F.col("type").alias("record_type"),
        "refers_to",
    )


def op8_histogram_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer_path())


def op9_site_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    counts = {name: F.col(name).cast("long") for name in site_lines.COUNTS}
    return site_lines.drop_boilerplate(docs).withColumns(counts)


def op10_structural_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = docs.select("doc_id", secrets.spans(F.col("text")).alias("found"))
    return found.select(
        "doc_id",
        *[secrets.count(F.col("found"), kind).alias(f"n_{kind}") for kind in secrets.BASE_KINDS],
        F.sha2(secrets.listed(F.col("found"), secrets.BASE_KINDS), 256).alias("base_sha256"),
        secrets.listed(F.col("found")).alias("spans"),
    )


def op11_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = tokenizer_path("byte_bpe_50k.tiktoken")
    encoded = byte_bpe.encode(F.col("text"), path)
    read = table(spark, sf_dir, "documents").select("doc_id", byte_bpe.read_back(encoded, path).alias("r"))
    return read.select(
        "doc_id",
        "r.n_tokens",
        F.sha2("r.packed", 256).alias("ids_sha256"),
        F.sha2("r.decoded", 256).alias("decoded_sha256"),
    )


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(spelling.words(table(spark, sf_dir, "documents")))


def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A deviation beyond a long, from some millions of vectors on, is null here."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    whitened = whitening.whiten(rows, whitening.fit(rows))
    return whitened.withColumn("deviation", F.col("deviation").try_cast("long"))


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in [
        op1_boosted_tree_quality,
        op2_simhash_multi_index,
        op3_pigeonhole_decontamination,
        op4_compression_toxicity,
        op5_hidden_markov_model,
        op6_prefix_forest,
        op7_warc_revisits,
        op8_histogram_packing,
        op9_site_lines,
        op10_structural_secrets,
        op11_byte_bpe,
        op12_spelling_variants,
        op13_embedding_whitening,
    ]
}
ORACLES: dict[str, str] = {
    "op7_warc_revisits": f"""
        WITH payloads AS (
            SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes,
                sha256(coalesce(html, '')) AS payload_digest
            FROM pages
        ),
        firsts AS (
            SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM payloads
        )
        SELECT page_id, payload_bytes, payload_digest,
            CASE WHEN payload_bytes >= {warc.MIN_BYTES} AND first_id <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
            CASE WHEN payload_bytes >= {warc.MIN_BYTES} AND first_id <> page_id THEN first_id END AS refers_to
        FROM firsts
    """,
    "op9_site_lines": f"""
        WITH pages AS (
            SELECT doc_id, source, text, string_split(text, chr(10)) AS lines FROM documents
        ),
        seen AS (SELECT source, unnest(list_distinct(lines)) AS line FROM pages),
        on_pages AS (SELECT source, line, count(*) AS n FROM seen GROUP BY source, line),
        totals AS (SELECT source, count(*) AS total FROM pages GROUP BY source),
        drops AS (
            SELECT o.source, list(line) AS drops
            FROM on_pages o JOIN totals t ON o.source IS NOT DISTINCT FROM t.source
            WHERE n >= {site_lines.MIN_PAGES} AND n > {site_lines.RATIO}::DOUBLE * total
            GROUP BY o.source
        ),
        filtered AS (
            SELECT p.*, list_filter(lines, lambda x: NOT coalesce(list_contains(d.drops, x), false)) AS left_over
            FROM pages p LEFT JOIN drops d ON p.source IS NOT DISTINCT FROM d.source
        ),
        kept AS (
            SELECT *, CASE WHEN len(list_filter(left_over, lambda x: x <> '')) = 0 THEN lines ELSE left_over END AS kept
            FROM filtered
        )
        SELECT doc_id, source, array_to_string(kept, chr(10)) AS text,
            coalesce(len(lines), 0) AS n_lines, coalesce(len(lines) - len(kept), 0) AS n_dropped
        FROM kept
    """,
}
