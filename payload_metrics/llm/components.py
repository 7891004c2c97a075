"""Connected components by alternating large and small stars, all as joins of edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from payload_metrics.llm.common import new_folder
from payload_metrics.sources.tables import discard, stage


def connected_components(edges: DataFrame) -> DataFrame:
    """``(node, root)`` for every node of ``edges (a, b)``; the root is the smallest node.

    Every round is written to the shared folder, so lineage stays short and a lost executor
    costs one round. Nodes are only ever grouped by the larger end of an edge, where the
    minimum is combined before the shuffle; the hub of a large component is its smallest node
    and is never gathered. Loops and edges with a null end are ignored.
    """
    spark = edges.sparkSession
    links = edges.where(F.col("a") != F.col("b"))
    links = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    path = new_folder(spark, "links")
    links, before = stage(links, "links", path), None
    while (now := _summary(links)) != before:
        before = now
        # Large star: every node hands its larger neighbours to its smallest neighbour.
        low_path = new_folder(spark, "low")
        low = stage(_smallest(links).withColumnRenamed("u", "v"), "low", low_path)
        large = links.join(low, "v", "left").select("u", F.coalesce("low", "v").alias("v")).distinct()
        # Small star: every node hands its smaller neighbours to the smallest of them.
        large_path = new_folder(spark, "large")
        large = stage(large, "large", large_path)
        chosen = large.join(_smallest(large), "u")
        handed = chosen.where("v != low").select(F.col("v").alias("u"), F.col("low").alias("v"))
        kept = chosen.select("u", F.col("low").alias("v"))
        next_path = new_folder(spark, "links")
        links = stage(kept.unionByName(handed).distinct(), "links", next_path)
        for old in (path, low_path, large_path):
            discard(spark, old)
        path = next_path
    roots = links.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return links.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)


def _smallest(links: DataFrame) -> DataFrame:
    return links.groupBy("u").agg(F.min("v").alias("low"))


def _summary(links: DataFrame) -> tuple:
    """Number and xor of the links; equal before and after a round that changed nothing."""
    return tuple(links.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())
