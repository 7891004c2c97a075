"""Boilerplate lines by site-relative frequency, with DataFrame functions only.

A line is boilerplate on a host if more than ``ratio`` of the host's pages contain it, and at
least ``min_pages`` of them do. Only 16-byte digests of lines are grouped, and counts are combined
before the shuffle, so neither a common line nor a large host gathers in one task. Digests that
are on too few pages end there; the rest are at most lines-per-page / ratio for each host, and
are joined to the pages as one small array per host.

Defined cases: a null text has no line and stays null; an empty text is one empty line; a null
host is a host; a line repeated on a page counts once; repeated rows are pages of their own. A
page on which every line with content is boilerplate is left as it is, since it would be lost
whole: copies of one page on a small host are no boilerplate. Other columns are kept, but for
columns named like the two counts, which are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from payload_metrics.llm.common import new_folder
from payload_metrics.sources.tables import stage

#: A line on one page in 200 is no content of a page; below 1,000 pages ``MIN_PAGES`` decides.
RATIO = 0.005
MIN_PAGES = 5
COUNTS = ("n_lines", "n_dropped")


def _lines(text: str) -> Column:
    return F.split(F.col(text), "\n")


def _digest(line: Column) -> Column:
    return F.unhex(F.md5(line))


def boilerplate(
    pages: DataFrame, host: str = "source", text: str = "text", ratio: float = RATIO, min_pages: int = MIN_PAGES
) -> DataFrame:
    """``(host, drops)``: digests of the boilerplate lines of each host that has any."""
    pages = pages.select(F.col(host).alias("_host"), F.col(text).alias("_text"))
    digests = F.array_distinct(F.transform(_lines("_text"), _digest))
    seen = pages.select("_host", F.explode(digests).alias("digest"))
    on_pages = seen.groupBy("_host", "digest").agg(F.count("*").alias("n")).where(F.col("n") >= min_pages)
    total = pages.groupBy(F.col("_host").alias("_of")).agg(F.count("*").alias("total"))
    frequent = on_pages.join(total, F.col("_host").eqNullSafe(F.col("_of")))
    frequent = frequent.where(F.col("n") > F.lit(ratio) * F.col("total"))
    return frequent.groupBy(F.col("_of").alias("_host")).agg(F.collect_list("digest").alias("_drops"))


def drop_boilerplate(
    pages: DataFrame, host: str = "source", text: str = "text", ratio: float = RATIO, min_pages: int = MIN_PAGES
) -> DataFrame:
    """``pages`` with boilerplate lines cut from ``text``, and ``n_lines`` and ``n_dropped``.

    The arrays are written first, so that the join with the pages is planned by their size and,
    if it is shuffled, can split a host that holds most pages.
    """
    spark = pages.sparkSession
    drops = stage(boilerplate(pages, host, text, ratio, min_pages), "drops", new_folder(spark, "site-lines"))
    # The page travels as one value, so that none of its columns can clash.
    whole = pages.select(F.struct("*").alias("page"), F.col(host).alias("_of"), F.col(text).alias("_text"))
    joined = whole.join(drops, F.col("_of").eqNullSafe(F.col("_host")), "left")
    marked = joined.withColumn("_lines", _lines("_text"))
    kept = F.filter("_lines", lambda line: ~F.array_contains("_drops", _digest(line)))
    marked = marked.withColumn("_kept", F.when(F.col("_drops").isNull(), F.col("_lines")).otherwise(kept))
    emptied = ~F.exists("_kept", lambda line: line != "")
    marked = marked.withColumn("_kept", F.when(emptied, F.col("_lines")).otherwise(F.col("_kept")))
    columns = [F.array_join("_kept", "\n").alias(c) if c == text else F.col(f"page.`{c}`") for c in pages.columns if c not in COUNTS]
    dropped = F.size("_lines") - F.size("_kept")
    return marked.select(
        *columns,
        F.when(F.col("_text").isNull(), 0).otherwise(F.size("_lines")).alias("n_lines"),
        F.when(F.col("_text").isNull(), 0).otherwise(dropped).alias("n_dropped"),
    )
