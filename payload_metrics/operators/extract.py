"""Payload documents to record rows, with a reason for every payload that does not fit.

``parse`` reads each payload text once and keeps its records as one ``array<variant>``, so
filters and caps can run inside the payload row, before any row is multiplied or shuffled.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from payload_metrics.functions.values import snippet
from payload_metrics.operators.fields import VariantFields
from payload_metrics.operators.filters import passes
from payload_metrics.paths import DataStep, EveryItem, ItemAt, ItemRange, data_steps, is_root_path, key_parts, variant_path
from payload_metrics.spec import SourceSpec

ENVELOPE = ("source", "scrape_id", "window_id", "fetched_at")
REJECT_COLUMNS = ("source", "scrape_id", "window_id", "reason", "snippet")
BAD_JSON = "payload is not valid JSON"
BAD_ROOT = "root lookups need an object payload"


def extract(payloads: DataFrame, spec: SourceSpec) -> tuple[DataFrame, DataFrame]:
    """All records of the payloads, and the rejected payloads."""
    parsed = parse(payloads, spec)
    return record_rows(parsed, spec), reject_rows(parsed)


def extract_selected(payloads: DataFrame, spec: SourceSpec) -> DataFrame:
    """Records after drop, keep and cap rules, plus one row per rejected or empty payload.

    A window's records all lie in one payload row, so the rules run on its array: no
    shuffle, and dropped records are never materialised. Reject rows carry ``reason``; a payload
    that leaves no record has a row without either, so that every payload can be counted.
    """
    parsed = parse(payloads, spec)
    numbered = F.transform(F.col("items"), lambda x, i: F.struct(i.alias("record_idx"), x.alias("record")))
    chosen = F.filter(numbered, lambda r: passes(VariantFields(r["record"]), spec.filters))
    if spec.filters.cap:
        chosen = F.slice(chosen, 1, spec.filters.cap)
    exploded = parsed.select(*ENVELOPE, *_root(spec), "reason", "snippet", F.explode_outer(chosen).alias("one"))
    idx = F.col("one.record_idx").cast("bigint")
    return exploded.select(
        *ENVELOPE,
        idx.alias("record_idx"),
        _position(idx).alias("record_pos"),
        F.col("one.record").alias("record"),
        *_root(spec),
        "reason",
        "snippet",
    )


def parse(payloads: DataFrame, spec: SourceSpec) -> DataFrame:
    """Adds ``items`` (records, NULL if rejected), ``reason``, ``snippet`` and maybe ``root``.

    ``root`` has one field per ``$root.`` path in the spec: it is copied to every record, so
    it must not be the whole payload.

    Callers must not filter on these columns before they explode: such a filter is pushed below
    the parse, which then runs again for every mention of its result.
    """
    # Wrapped in a list, so junk behind a complete document no longer parses.
    wrapped = F.try_parse_json(F.concat(F.lit("["), F.col("payload"), F.lit("]")))
    whole = payloads.select(*ENVELOPE, "payload", wrapped.alias("_wrapped")).withColumn(
        "_document",
        F.when(
            F.try_variant_get("_wrapped", "$[1]", "variant").isNull(),
            F.try_variant_get("_wrapped", "$[0]", "variant"),
        ),
    )
    document = F.col("_document")
    if spec.uses_root:
        found = [_getter(variant_path(key_parts(p)))(document).alias(p) for p in spec.root_paths]
        whole = whole.withColumn("root", F.struct(*found))
    whole, items, problem = _walk(whole, data_steps(spec.dataKey))
    reason = F.when(document.isNull(), F.lit(BAD_JSON))
    if spec.uses_root:
        reason = reason.when(~_is_object(document), F.lit(BAD_ROOT))
    reason = reason.otherwise(problem)
    with_reason = whole.withColumn("reason", reason)
    ok = F.col("reason").isNull()
    return with_reason.select(
        *ENVELOPE,
        *_root(spec),
        F.when(ok, items).alias("items"),
        "reason",
        F.when(~ok, snippet(F.col("payload"))).alias("snippet"),
    )


def record_rows(parsed: DataFrame, spec: SourceSpec) -> DataFrame:
    # Outer explode, tested afterwards: filters below it would run the parse twice.
    rows = parsed.select(
        *ENVELOPE, *_root(spec), F.posexplode_outer("items").alias("idx", "record")
    ).where(F.col("idx").isNotNull())
    idx = F.col("idx").cast("bigint")
    return rows.select(
        *ENVELOPE, idx.alias("record_idx"), _position(idx).alias("record_pos"), "record", *_root(spec)
    )


def reject_rows(parsed: DataFrame) -> DataFrame:
    bad = F.when(F.col("reason").isNotNull(), F.array(F.struct("reason", "snippet")))
    rows = parsed.select("source", "scrape_id", "window_id", F.explode_outer(bad).alias("bad"))
    return rows.where(F.col("bad").isNotNull()).select("source", "scrape_id", "window_id", "bad.*")


def selected_records(rows: DataFrame) -> DataFrame:
    """The record rows of ``extract_selected``. Tests a column made by the explode."""
    return rows.where(F.col("record_idx").isNotNull()).drop("reason", "snippet")


def slim_records(records: DataFrame, spec: SourceSpec) -> DataFrame:
    """Dynamic records cut to the top-level fields the outputs look up.

    For sources without log rows: whole records are then needed for the fingerprint only, and
    need not be staged or shuffled. Columns inside a VARIANT are not pruned by Spark itself.
    """
    keys = {key_parts(p)[0] for p in spec.field_paths() if not is_root_path(p) and key_parts(p)}
    if isinstance(records.schema["record"].dataType, T.StructType):
        return records
    if not keys:
        return records.withColumn("record", F.parse_json(F.lit("{}")))
    fields = [_getter(variant_path([k]))(F.col("record")).alias(k) for k in sorted(keys)]
    return records.withColumn("record", F.to_variant_object(F.struct(*fields)))


def typed_records(
    df: DataFrame,
    source: str,
    order_by: str | Column,
    scrape_id: str | Column = "",
    window_id: int | Column = 0,
    fetched_at: Column | None = None,
) -> DataFrame:
    """Records from any DataFrame: its columns become the fields of a STRUCT ``record``.

    ``order_by`` is a BIGINT that is unique and rises with record order over the whole batch.
    """
    order = F.col(order_by) if isinstance(order_by, str) else order_by
    return df.select(
        F.lit(source).alias("source"),
        (F.lit(scrape_id) if isinstance(scrape_id, str) else scrape_id).alias("scrape_id"),
        (F.lit(window_id) if isinstance(window_id, int) else window_id).alias("window_id"),
        (F.lit(None).cast("timestamp") if fetched_at is None else fetched_at).alias("fetched_at"),
        order.cast("bigint").alias("record_idx"),
        order.cast("bigint").alias("record_pos"),
        F.struct(*df.columns).alias("record"),
    )


def _root(spec: SourceSpec) -> list[str]:
    return ["root"] if spec.uses_root else []


def _position(idx: Column) -> Column:
    """Batch-wide record order as one BIGINT: window in the high half, position in the low.

    Positions are array indexes, which stay below 2**31.
    """
    window = F.coalesce(F.col("window_id"), F.lit(0)).cast("bigint")
    return F.shiftleft(window, 32) + idx


def _is_object(value: Column) -> Column:
    """Casting to an empty struct works for objects only and reads no field."""
    return F.try_variant_get(value, "$", "struct<>").isNotNull()


def _as_list(value: Column) -> Column:
    return F.try_variant_get(value, "$", "array<variant>")


def _present(value: Column) -> Column:
    return value.isNotNull() & ~F.is_variant_null(value)


def _walk(df: DataFrame, steps: list[DataStep]) -> tuple[DataFrame, Column, Column]:
    """Records array and problem text (NULL when the payload fits), on top of ``df``.

    Every step is a column of its own, since the checks mention it several times.
    """
    if not steps:
        df = df.withColumn("_list", _as_list(F.col("_document")))
        return df, F.col("_list"), F.when(F.col("_list").isNull(), F.lit("expected a list at the payload root"))

    # While no list has been expanded there is one value, and plain steps join into one path.
    parts: list[str] = []
    problems: list[Column] = []
    value = F.col("_document")
    for n, step in enumerate(steps):
        parts.append(step.name)
        if step.selector is None:
            continue
        df = df.withColumn(f"_value{n}", F.try_variant_get(value, variant_path(parts), "variant"))
        value, parts = F.col(f"_value{n}"), []
        if not isinstance(step.selector, ItemAt):
            fanned = F.when(_present(value), F.array(value)).otherwise(_no_items())
            df = df.withColumn("_fanned", fanned)
            many, problem = _select_many(F.col("_fanned"), step)
            df = df.withColumn("_many", many)
            return _finish_many(df, F.col("_many"), [*problems, problem], steps[n + 1 :])
        df = df.withColumn(f"_list{n}", _as_list(value))
        items = F.col(f"_list{n}")
        problems.append(F.when(_present(value) & items.isNull(), _not_a_list(step)))
        problems.append(F.when(_outside(items, step.selector.index), _no_such_item(step)))
        value = _item_at(items, step.selector.index)
    if parts:
        value = F.try_variant_get(value, variant_path(parts), "variant")
    df = df.withColumn("_value", value)
    value = F.col("_value")
    df = df.withColumns({"_list": _as_list(value), "_is_object": _is_object(value)})
    items, single = F.col("_list"), F.when(F.col("_is_object"), F.array(value))
    bad = F.when(
        items.isNotNull(), F.when(F.exists(items, lambda x: ~_is_object(x)), _not_objects())
    ).when(_present(value) & ~F.col("_is_object"), _no_record())
    # An explicit null picked by an index is a value, and no record.
    if steps[-1].selector is not None:
        bad = bad.when(F.is_variant_null(value), _no_record())
    return df, F.coalesce(items, single, _no_items()), F.coalesce(*problems, bad)


def _select_many(values: Column, step: DataStep) -> tuple[Column, Column]:
    """Applies a selector to every value; the result is flat again."""
    selector = step.selector
    if selector is None:
        return values, F.lit(None).cast("string")
    lists = F.transform(values, _as_list)
    problem = F.when(F.exists(lists, lambda x: x.isNull()), _not_a_list(step))
    lists = F.filter(lists, lambda x: x.isNotNull())
    if isinstance(selector, EveryItem):
        return F.flatten(lists), problem
    if isinstance(selector, ItemRange):
        return F.flatten(F.transform(lists, lambda x: _item_range(x, selector))), problem
    outside = F.exists(lists, lambda x: _outside(x, selector.index))
    problem = F.coalesce(problem, F.when(outside, _no_such_item(step)))
    return F.transform(lists, lambda x: _item_at(x, selector.index)), problem


def _finish_many(
    df: DataFrame, values: Column, problems: list[Column], steps: list[DataStep]
) -> tuple[DataFrame, Column, Column]:
    for n, step in enumerate(steps):
        inner = F.transform(values, _getter(variant_path([step.name])))
        df = df.withColumn(f"_inner{n}", F.filter(inner, _present))
        chosen, problem = _select_many(F.col(f"_inner{n}"), step)
        df = df.withColumn(f"_chosen{n}", chosen)
        values = F.col(f"_chosen{n}")
        problems.append(problem)
    as_lists = F.transform(values, lambda x: F.coalesce(_as_list(x), F.array(x)))
    df = df.withColumn("_items", F.coalesce(F.flatten(as_lists), _no_items()))
    items = F.col("_items")
    bad = F.when(F.exists(items, lambda x: ~_is_object(x)), _not_objects())
    return df, items, F.coalesce(*problems, bad)


def _getter(path: str) -> Callable[[Column], Column]:
    return lambda x: F.try_variant_get(x, path, "variant")


def _outside(items: Column, index: int) -> Column:
    need = index + 1 if index >= 0 else -index
    return F.size(items) < need


def _item_at(items: Column, index: int) -> Column:
    return F.try_element_at(items, F.lit(index + 1 if index >= 0 else index))


def _item_range(items: Column, selector: ItemRange) -> Column:
    n = F.size(items)

    def bound(at: int | None, default: Column) -> Column:
        if at is None:
            return default
        return F.least(F.lit(at), n) if at >= 0 else F.greatest(n + F.lit(at), F.lit(0))

    start, stop = bound(selector.start, F.lit(0)), bound(selector.stop, n)
    return F.slice(items, start + 1, F.greatest(stop - start, F.lit(0)))


def _no_items() -> Column:
    return F.array().cast("array<variant>")


def _not_a_list(step: DataStep) -> Column:
    return F.lit(f"expected a list at {step.name!r}")


def _no_such_item(step: DataStep) -> Column:
    return F.lit(f"index {step.selector.index} is out of bounds at {step.name!r}")


def _not_objects() -> Column:
    return F.lit("expected a list of objects")


def _no_record() -> Column:
    return F.lit("expected an object or a list of objects")
