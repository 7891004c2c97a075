"""Drop and keep rules and the record cap."""

from __future__ import annotations

from pyspark.sql import functions as F

from driver_queries import query
from driver_queries.inputs import event_pages, event_records, events, spec, table
from payload_metrics.operators.extract import extract_selected, selected_records, typed_records
from payload_metrics.operators.fields import fields_of
from payload_metrics.operators.filters import apply_filters, cap


def _keep(*predicates):
    return {"keep": [{"all": [_predicate(*p) for p in predicates]}]}


def _predicate(field, match_type, value):
    return {"field": field, "matchType": match_type, "value": value}


def _kept_ids(records, filters):
    return apply_filters(records, spec(filters=filters)).select(F.col("record.event_id").alias("event_id"))


def _page_ids(spark, sf_dir, filters):
    """The same through payloads, with the rules applied inside each payload."""
    config = spec(dataKey="data.records", filters=filters)
    records = selected_records(extract_selected(event_pages(spark, sf_dir), config))
    return records.select(fields_of(records).number("event_id").cast("bigint").alias("event_id"))


@query("SELECT event_id FROM events WHERE event_type = 'purchase'")
def filter_equals(spark, sf_dir):
    return _kept_ids(event_records(spark, sf_dir), _keep(("event_type", "equals", "purchase")))


@query("SELECT event_id FROM events WHERE user_id = 7 AND event_type = 'view'")
def filter_equals_payload(spark, sf_dir):
    rules = _keep(("user_id", "equals", 7.0), ("event_type", "equals", "view"), ("no.such", "equals", None))
    return _page_ids(spark, sf_dir, rules)


@query("SELECT event_id FROM events WHERE CAST(json_extract(props, '$.k') AS BIGINT) <> 5")
def filter_not_equals(spark, sf_dir):
    rules = _keep(("props.k", "not_equals", 5), ("props.none", "not_equals", 5), ("user_id", "not_equals", "7"))
    return _kept_ids(event_records(spark, sf_dir), rules)


@query("SELECT event_id FROM events WHERE CAST(json_extract(props, '$.k') AS BIGINT) <> 5")
def filter_not_equals_payload(spark, sf_dir):
    rules = _keep(("props.k", "not_equals", 5), ("props.none", "not_equals", 5), ("user_id", "not_equals", "7"))
    return _page_ids(spark, sf_dir, rules)


@query("SELECT event_id FROM events WHERE event_type IN ('view', 'click') AND user_id IN (1, 2, 3)")
def filter_in(spark, sf_dir):
    rules = _keep(("event_type", "in", ["view", "click", 5]), ("user_id", "in", [1, 2.0, 3, "4", None]))
    return _kept_ids(event_records(spark, sf_dir), rules)


@query("SELECT event_id FROM events WHERE event_type IN ('view', 'click') AND user_id IN (1, 2, 3)")
def filter_in_payload(spark, sf_dir):
    rules = _keep(("event_type", "in", ["view", "click", 5]), ("user_id", "in", [1, 2.0, 3, "4", None]))
    return _page_ids(spark, sf_dir, rules)


@query("SELECT event_id FROM events WHERE contains(event_type, 'i') AND (user_id = 9 OR event_type = 'signup')")
def filter_contains(spark, sf_dir):
    rows = events(spark, sf_dir).withColumn(
        "tags", F.array(F.when(F.col("user_id") == 9, "nine").otherwise("other"), F.col("event_type"))
    )
    records = typed_records(rows, "events", order_by="event_id")
    rules = [_predicate("event_type", "in", "i")]
    nine, signup = _predicate("tags", "in", "nine"), _predicate("tags", "in", "signup")
    return _kept_ids(records, {"keep": [{"all": [*rules, nine]}, {"all": [*rules, signup]}]})


@query("SELECT o_orderkey FROM orders WHERE regexp_matches(o_orderpriority, '^[12]-(URGENT|HIGH)')")
def filter_regex(spark, sf_dir):
    records = typed_records(table(spark, sf_dir, "orders"), "orders", order_by="o_orderkey")
    rules = _keep(("o_orderpriority", "regex", r"^[12]-(?P<level>URGENT|HIGH)"))
    return apply_filters(records, spec(filters=rules)).select(F.col("record.o_orderkey").alias("o_orderkey"))


@query(
    "SELECT c_custkey FROM customer WHERE NOT (c_mktsegment = 'BUILDING' OR c_nationkey IN (1, 2)) "
    "AND (c_mktsegment = 'MACHINERY' AND c_nationkey <> 3 OR regexp_matches(c_name, '7$'))"
)
def filter_drop_keep(spark, sf_dir):
    rules = {
        "drop": [
            {"any": [_predicate("c_mktsegment", "equals", "BUILDING")]},
            {"any": [_predicate("c_nationkey", "in", [1, 2])]},
        ],
        "keep": [
            {"all": [_predicate("c_mktsegment", "equals", "MACHINERY"), _predicate("c_nationkey", "not_equals", 3)]},
            {"all": [_predicate("c_name", "regex", "7$")]},
        ],
    }
    records = typed_records(table(spark, sf_dir, "customer"), "customers", order_by="c_custkey")
    return apply_filters(records, spec(filters=rules)).select(F.col("record.c_custkey").alias("c_custkey"))


@query(
    "SELECT event_id FROM events WHERE event_type <> 'error' "
    "QUALIFY row_number() OVER (PARTITION BY CAST(ts AS DATE) ORDER BY event_id) <= 50"
)
def cap_per_window(spark, sf_dir):
    day = F.date_format("ts", "yyyy-MM-dd")
    records = typed_records(events(spark, sf_dir), "events", order_by="event_id", scrape_id=day)
    rules = {
        "drop": [{"any": [_predicate("event_type", "equals", "error")]}],
        "limits": {"maxRecordsPerScrape": 50},
    }
    kept = cap(apply_filters(records, spec(filters=rules)), spec(filters=rules))
    return kept.select(F.col("record.event_id").alias("event_id"))


@query(
    "SELECT event_id FROM events WHERE event_type <> 'error' "
    "QUALIFY row_number() OVER (PARTITION BY event_id // 100 ORDER BY event_id) <= 10"
)
def cap_per_payload(spark, sf_dir):
    rules = {
        "drop": [{"any": [_predicate("event_type", "equals", "error")]}],
        "limits": {"maxRecordsPerScrape": 10},
    }
    return _page_ids(spark, sf_dir, rules)
