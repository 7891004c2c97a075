"""Records to severity-tagged log rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from payload_metrics.operators.fields import StructFields, VariantFields, fields_of, matches
from payload_metrics.operators.metrics import attribute_map, attribute_texts
from payload_metrics.spec import SourceSpec

# Severity texts and numbers of the public OpenTelemetry log data model.
SEVERITIES = {"ERROR": 17, "WARNING": 13, "INFO": 9}


def severity_text(fields: VariantFields | StructFields, spec: SourceSpec) -> Column:
    """Error rule first, then warning; everything else is INFO."""
    status = spec.logStatusField
    if status is None:
        return F.lit("INFO")
    text = F.lit("INFO")
    for name, rule in (("WARNING", status.warning), ("ERROR", status.error)):
        if rule is None:
            continue
        expected = list(rule.value) if isinstance(rule.value, tuple) else rule.value
        text = F.when(matches(fields, status.name, rule.matchType, expected), name).otherwise(text)
    return text


def severity_number(text: Column) -> Column:
    number = F.lit(None).cast("int")
    for name, value in SEVERITIES.items():
        number = F.when(text == name, value).otherwise(number)
    return number


def log_records(records: DataFrame, spec: SourceSpec, ts: Column | None = None) -> DataFrame:
    """One row per record; empty when the source does not log. One time per batch."""
    fields = fields_of(records)
    body = F.struct(F.lit(spec.name).alias("source"), fields.whole().alias("record"))
    rows = records if spec.emitLogs else records.where(F.lit(False))
    rows = rows.select(
        "source",
        (F.col("fetched_at") if ts is None else ts).alias("ts"),
        severity_text(fields, spec).alias("severity_text"),
        F.to_json(body).alias("body"),
        attribute_map(attribute_texts(fields, spec)).alias("attrs"),
        "scrape_id",
    )
    return rows.select(
        "source", "ts", severity_number(F.col("severity_text")).alias("severity_number"),
        "severity_text", "body", "attrs", "scrape_id",
    )
