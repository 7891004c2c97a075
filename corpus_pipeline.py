"""A training corpus from ``documents``: five stages, each an operator of ``payload_metrics.llm``.

Every stage works on all that the stage before it kept, and all but the last return the columns
of ``documents``. A toxic document goes; boilerplate lines are cut, and ``n_chars`` follows the
text; one document of each group whose SimHash fingerprints link stays (the contract of the SimHash
query: four-word shingles, at most 4 differing bits); a document that holds a benchmark item goes;
the rest is packed. Null texts count as empty, and an empty table passes every stage.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from payload_metrics.llm import decontaminate, packing, simhash, site_lines, toxicity
from payload_metrics.llm.common import DOCUMENT_COLUMNS, fold_of, new_folder, table, tokenizer_path

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learns from the labels that the toxicity query learns from, and keeps what it clears."""
    labels = table(spark, sf_dir, "labels").where(fold_of("doc_id", 3) != 1)
    docs = docs.select(*DOCUMENT_COLUMNS)
    model = toxicity.train(docs, labels)
    return toxicity.classify(docs, model).where("toxic_predicted = 0").select(*DOCUMENT_COLUMNS)


def drop_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    cut = site_lines.drop_boilerplate(docs.select(*DOCUMENT_COLUMNS))
    n_chars = F.when(F.col("n_dropped") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return cut.withColumn("n_chars", n_chars).select(*DOCUMENT_COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.deduplicate(docs.select(*DOCUMENT_COLUMNS))


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminate(docs.select(*DOCUMENT_COLUMNS), table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs, tokenizer_path())


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_boilerplate),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_benchmark),
    ("packing", pack),
]
#: Trained dictionaries, word hashes, edit distances and tokenizers cannot be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's result is written once and read by the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = new_folder(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
