"""Drop and keep rules, and the per-window record cap."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from payload_metrics.operators.fields import StructFields, VariantFields, all_of, any_of, fields_of, matches
from payload_metrics.spec import Filters, SourceSpec

CAP_SALTS = 32


def passes(fields: VariantFields | StructFields, filters: Filters) -> Column:
    """True for records no drop rule hits and, if there are keep rules, some keep rule takes."""

    def test(p):
        return matches(fields, p.field, p.matchType, p.value)

    conditions = [~test(p) for rule in filters.drop for p in rule.any]
    if filters.keep:
        conditions.append(any_of([all_of([test(p) for p in rule.all]) for rule in filters.keep]))
    return all_of(conditions)


def apply_filters(records: DataFrame, spec: SourceSpec) -> DataFrame:
    if not spec.filters.drop and not spec.filters.keep:
        return records
    return records.where(passes(fields_of(records), spec.filters))


def cap(records: DataFrame, spec: SourceSpec) -> DataFrame:
    """The first N records of each window.

    Two rounds: each window is first cut within salted slices, so a window of any size is
    spread over ``CAP_SALTS`` tasks and the last round sees at most N rows per slice.
    """
    n = spec.filters.cap
    if n is None:
        return records
    window = ["source", "scrape_id", "window_id"]
    salted = records.withColumn("_salt", F.pmod(F.xxhash64("record_pos"), F.lit(CAP_SALTS)))
    return _first(_first(salted, [*window, "_salt"], n), window, n).drop("_salt")


def _first(df: DataFrame, group: list[str], n: int) -> DataFrame:
    order = Window.partitionBy(*group).orderBy("record_pos")
    return df.withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= n).drop("_rank")
