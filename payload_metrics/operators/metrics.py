"""Records to gauge, counter and histogram points.

All metrics of a source share its attribute set, so one aggregation on the plain attribute
columns computes every metric at once. An attribute that is a metric has series of its own; each
record then enters the same aggregation once more for it, under a group number. Rows fan out to one
per metric only afterwards, when there is one row per series; attribute maps are built then, too.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from payload_metrics.functions.values import map_value
from payload_metrics.operators.fields import StructFields, VariantFields, fields_of
from payload_metrics.sources.tables import stage
from payload_metrics.spec import Attribute, SourceSpec

POINT_COLUMNS = (
    "source", "metric", "kind", "unit", "attrs", "scrape_id", "ts",
    "value", "count", "sum", "bounds", "bucket_counts",
)

POINT_SCHEMA = (
    "source string, metric string, kind string, unit string, attrs map<string,string>, scrape_id string, ts timestamp, "
    "value double, count bigint, sum double, bounds array<double>, bucket_counts array<bigint>"
)


def attribute_texts(fields: VariantFields | StructFields, spec: SourceSpec) -> dict[str, Column]:
    """Text per attribute name. Of equal names the last present value wins."""
    by_name: dict[str, list[Column]] = {"source": [F.lit(spec.name)]}
    for attr in spec.attributes:
        by_name.setdefault(attr.name, []).insert(0, fields.text(attr.dataKey))
    return {name: F.coalesce(*texts) for name, texts in by_name.items()}


def attribute_map(texts: dict[str, Column]) -> Column:
    """``MAP<STRING,STRING>`` without the missing attributes."""
    pairs = [F.struct(F.lit(name).alias("key"), text.alias("value")) for name, text in texts.items()]
    return F.map_from_entries(F.filter(F.array(*pairs), lambda p: p["value"].isNotNull()))


def metric_points(records: DataFrame, spec: SourceSpec, every: str | None = None) -> DataFrame:
    """Delta points, one row per series and scrape.

    With ``every`` (such as ``"5 minutes"``) there is one row per series and tumbling window
    of ``fetched_at`` instead, which also works on a stream with a watermark.
    """
    fields = fields_of(records)
    texts = attribute_texts(fields, spec)
    keyed = {f"a{i}": text for i, text in enumerate(texts.values())}
    mapped = _mapped_attributes(spec)
    readings = _readings(fields, spec)
    inputs = {name: value for r in readings for name, value in r.inputs.items()}
    batch = F.col("scrape_id") if every is None else F.lit(None).cast("string").alias("scrape_id")
    slim = records.select(
        "source", batch, "fetched_at", "record_pos",
        *[c.alias(n) for n, c in keyed.items()],
        *[c.alias(n) for n, c in inputs.items()],
        *[c.alias(n) for attr in mapped.items() for n, c in _mapped_inputs(fields, *attr).items()],
    )
    groups = [F.struct(F.lit(0).alias("g"), *keyed, F.lit(None).cast("double").alias("m"), *inputs)]
    groups += [_attribute_group(i, keyed, inputs) for i in mapped]
    if mapped:
        shared = ["source", "scrape_id", "fetched_at", "record_pos"]
        slim = slim.select(*shared, F.explode(F.array(*groups)).alias("_group")).select(*shared, "_group.*")
        slim = slim.where("g = 0 OR m >= 0")
    else:
        slim = slim.withColumns({"g": F.lit(0), "m": F.lit(None).cast("double")})
    series = ["source", "scrape_id", "g", *keyed]
    aggregates = [agg.alias(name) for r in readings for name, agg in r.aggregates.items()]
    aggregates.append(F.sum("m").alias("mapped"))
    if every is None:
        per_series = slim.groupBy(*series).agg(F.max("fetched_at").alias("ts"), *aggregates)
    else:
        span = F.window("fetched_at", every).alias("_span")
        per_series = slim.groupBy(*series, span).agg(*aggregates)
        per_series = per_series.withColumn("ts", F.col("_span.start"))

    attrs = attribute_map({name: F.col(f"a{i}") for i, name in enumerate(texts)})
    structs = [_joint_point(same, attrs) for same in _by_series(readings)]
    structs += [_attribute_point(i, attr, spec) for i, attr in mapped.items()]
    if not structs:
        structs = [_point("", "", "", attrs, present=F.lit(False))]
    points = per_series.select(
        "source", "scrape_id", "ts", F.explode(F.array(*structs)).alias("p")
    ).where("p.present")
    points = points.select("source", "scrape_id", "ts", "p.*").drop("present").select(*POINT_COLUMNS)
    shared_names = _shared_counters(spec)
    if not shared_names:
        return points
    if records.isStreaming:
        raise ValueError(f"counters {sorted(shared_names)} have two sources, which needs foreachBatch on a stream")
    shared = (F.col("kind") == "counter") & F.col("metric").isin(sorted(shared_names))
    return points.where(~shared).unionByName(_added_up(points.where(shared), every is not None))


class _Reading:
    """One configured metric: its input columns, aggregates and point."""

    def __init__(self, i: int, kind: str, spec, value: Column):
        self.name, self.kind, self.unit = spec.name, kind, spec.unit
        self.x = f"x{i}"
        self.inputs = {self.x: value}
        self.bounds: tuple[float, ...] = ()
        x, pos = F.col(self.x), F.col("record_pos")
        if kind == "gauge":
            valid = F.when(x.isNotNull(), pos)
            self.aggregates = {f"g{i}": F.max_by(x, valid)}
        elif kind == "counter":
            # Counters only rise; negative amounts are ignored.
            self.aggregates = {f"c{i}": F.sum(F.when(x >= 0, x))}
        else:
            self.bounds = spec.bounds
            self.aggregates = {f"hn{i}": F.count(x), f"hs{i}": F.sum(x)}
            for j, bound in enumerate(self.bounds):
                self.aggregates[f"h{i}_{j}"] = F.count_if(x <= bound)

    @property
    def series(self) -> tuple:
        return (self.name, self.kind, self.unit, self.bounds)


def _by_series(readings: list[_Reading]) -> list[list[_Reading]]:
    """Readings that make the same series, together."""
    found: dict[tuple, list[_Reading]] = {}
    for reading in readings:
        found.setdefault(reading.series, []).append(reading)
    return list(found.values())


def _joint_point(readings: list[_Reading], attrs: Column) -> Column:
    """The point of one or more readings of the same series, which lie in one row: the last gauge
    that is present, or the sum of counters and histograms."""
    first = readings[0]
    outs = [[F.col(name) for name in r.aggregates] for r in readings]
    if first.kind == "gauge":
        value = F.coalesce(*[out[0] for out in reversed(outs)])
        return _point(first.name, first.kind, first.unit, attrs, present=value.isNotNull(), value=value)
    if first.kind == "counter":
        present = F.coalesce(*[out[0] for out in outs]).isNotNull()
        return _point(first.name, first.kind, first.unit, attrs, present=present, value=_sum([out[0] for out in outs]))
    count, total = _sum([out[0] for out in outs]), _sum([out[1] for out in outs])
    steps = [_sum(list(edge)) for edge in zip(*[out[2:] for out in outs])] + [count]
    per_bucket = [n if j == 0 else n - steps[j - 1] for j, n in enumerate(steps)]
    return _point(
        first.name, first.kind, first.unit, attrs,
        present=count > 0, count=count, total=total, bounds=first.bounds, buckets=per_bucket,
    )


def _sum(parts: list[Column]) -> Column:
    """Missing parts count 0; a single part stays as it is."""
    if len(parts) == 1:
        return parts[0]
    total = F.lit(0)
    for part in parts:
        total = total + F.coalesce(part, F.lit(0))
    return total


def _readings(fields: VariantFields | StructFields, spec: SourceSpec) -> list[_Reading]:
    out: list[_Reading] = []

    def add(kind: str, reading, default: Column) -> None:
        if reading.fixedValue is not None:
            value = F.lit(float(reading.fixedValue))
        elif not reading.dataKey:
            value = default
        else:
            value = fields.number(reading.dataKey)
            if kind == "counter":
                # Whatever cannot be counted counts once.
                value = F.coalesce(value, F.lit(1.0))
        out.append(_Reading(len(out), kind, reading, value))

    for gauge in spec.gaugeReadings:
        add("gauge", gauge, F.lit(None).cast("double"))
    for counter in spec.counterReadings:
        add("counter", counter, F.lit(1.0))
    for histogram in spec.histogramReadings:
        add("histogram", histogram, F.lit(None).cast("double"))
    return out


def _mapped_attributes(spec: SourceSpec) -> dict[int, Attribute]:
    return {i: a for i, a in enumerate(spec.attributes) if a.asMetric is not None}


def _mapped_inputs(fields: VariantFields | StructFields, i: int, attr: Attribute) -> dict[str, Column]:
    text = fields.text(attr.dataKey)
    return {f"m{i}": map_value(fields.printed(attr.dataKey), text, attr.asMetric.valueMapping).cast("double"), f"v{i}": text}


def _attribute_group(i: int, keyed: dict[str, Column], inputs: dict[str, Column]) -> Column:
    """A record as it enters the series of an attribute: its value is the first key, no reading
    sees it."""
    keys = [F.col(f"v{i}") if n == 0 else F.lit(None).cast("string") for n in range(len(keyed))]
    none = [F.lit(None).cast("double").alias(name) for name in inputs]
    return F.struct(
        F.lit(i + 1).alias("g"), *[key.alias(name) for key, name in zip(keys, keyed)], F.col(f"m{i}").alias("m"), *none
    )


def _attribute_point(i: int, attr: Attribute, spec: SourceSpec) -> Column:
    """Counter over the mapped values of an attribute."""
    texts = {"source": F.lit(spec.name)} | {attr.name: F.col("a0")}
    return _point(
        attr.asMetric.metricName or attr.name, "counter", attr.asMetric.unit, attribute_map(texts),
        present=(F.col("g") == i + 1) & F.col("mapped").isNotNull(), value=F.col("mapped"),
    )


def _shared_counters(spec: SourceSpec) -> set[str]:
    """Names of counters that two attributes, or an attribute and a reading, may both add to."""
    of_attributes = [a.asMetric.metricName or a.name for a in _mapped_attributes(spec).values()]
    counters = {c.name for c in spec.counterReadings}
    return {name for name in of_attributes if of_attributes.count(name) > 1 or name in counters}


def _point(
    name: str,
    kind: str,
    unit: str,
    attrs: Column,
    present: Column,
    value: Column | None = None,
    count: Column | None = None,
    total: Column | None = None,
    bounds: tuple[float, ...] | None = None,
    buckets: list[Column] | None = None,
) -> Column:
    """One point."""

    def typed(col: Column | None, as_type: str) -> Column:
        return (F.lit(None) if col is None else col).cast(as_type)

    return F.struct(
        F.lit(name).alias("metric"),
        F.lit(kind).alias("kind"),
        F.lit(unit).alias("unit"),
        attrs.alias("attrs"),
        present.alias("present"),
        typed(value, "double").alias("value"),
        typed(count, "bigint").alias("count"),
        typed(total, "double").alias("sum"),
        typed(F.array(*[F.lit(b) for b in bounds]) if bounds is not None else None, "array<double>").alias("bounds"),
        typed(F.array(*buckets) if buckets else None, "array<bigint>").alias("bucket_counts"),
    )


def _added_up(counters: DataFrame, windowed: bool) -> DataFrame:
    """One point per series of counters that came from several groups."""
    window = F.col("ts") if windowed else F.lit(None).cast("timestamp")
    series = ["source", "scrape_id", "metric", "kind", "unit", "attrs"]
    folded = counters.groupBy(*series, window.alias("_window")).agg(F.max("ts").alias("ts"), F.sum("value").alias("value"))
    nothing = {name: F.lit(None).cast(counters.schema[name].dataType) for name in ("count", "sum", "bounds", "bucket_counts")}
    return folded.withColumns(nothing).select(*POINT_COLUMNS)


def series_text(attrs: Column) -> Column:
    """Attributes as comparable text, names sorted; maps can be grouped but not joined."""
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(attrs))))


def newest_points(states: DataFrame) -> DataFrame:
    """The state with the largest ``batch_id`` of each point, told apart by series and time."""
    series = ["source", "metric", "kind", "unit", "attrs", "scrape_id", "ts"]
    values = [c for c in POINT_COLUMNS if c not in series]
    newest = states.groupBy(*series).agg(F.max_by(F.struct(*values), "batch_id").alias("_newest"))
    return newest.select(*series, "_newest.*").select(*POINT_COLUMNS)


def cumulative_points(points: DataFrame) -> DataFrame:
    """Delta counters and histograms with ``total_value``, ``total_count``, ``total_sum`` and
    ``total_bucket_counts``.

    The points are written once, since day totals, running sums and buckets all read them.
    """
    series = ["source", "metric", "_series"]
    rising = points.where(F.col("kind").isin("counter", "histogram"))
    keyed = stage(rising.withColumn("_series", series_text(F.col("attrs"))), "rising")
    out = running_totals(keyed, series, ["value", "count", "sum"])
    each = keyed.select(*series, "ts", F.posexplode("bucket_counts").alias("_bucket", "n"))
    run = running_totals(each, [*series, "_bucket"], ["n"])
    # Points of one series and time have one total, and a series has as many buckets as its spec.
    totals = run.groupBy(*series, F.col("ts").alias("_at")).agg(
        F.array_sort(F.collect_set(F.struct("_bucket", "total_n"))).alias("_totals")
    )
    totals = totals.select(*series, "_at", F.transform("_totals", lambda t: t["total_n"]).alias("total_bucket_counts"))
    same = [out[c] == totals[c] for c in series] + [F.col("ts").eqNullSafe(F.col("_at"))]
    joined = out.join(totals, same, "left")
    return joined.select(*[out[c] for c in out.columns if c != "_series"], "total_bucket_counts")


def running_totals(points: DataFrame, series: list[str], values: list[str]) -> DataFrame:
    """Cumulative counters and histogram parts over delta points, per series in time order.

    Days are totalled first and added up, then each day runs on its own with its offset, so
    a series of any length is spread over its days. Points without a time come before all others.
    """
    dated = points.withColumn("_day", F.coalesce(F.to_date("ts"), F.lit("0001-01-01").cast("date")))
    days = dated.groupBy(*series, "_day").agg(*[F.sum(v).alias(f"_day_{v}") for v in values])
    earlier = Window.partitionBy(*series).orderBy("_day").rowsBetween(Window.unboundedPreceding, -1)
    offsets = days.select(
        *series, "_day",
        *[F.coalesce(F.sum(f"_day_{v}").over(earlier), F.lit(0)).alias(f"_base_{v}") for v in values],
    )
    within = Window.partitionBy(*series, "_day").orderBy("ts").rangeBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    running = dated.withColumns({f"_in_{v}": F.sum(v).over(within) for v in values})
    joined = running.join(offsets, [*series, "_day"])
    totals = {f"total_{v}": F.col(f"_base_{v}") + F.col(f"_in_{v}") for v in values}
    return joined.withColumns(totals).select(*points.columns, *totals)


def latest_gauges(points: DataFrame, series: list[str]) -> DataFrame:
    """Newest value of each gauge series across scrapes."""
    newest = F.max_by("value", F.unix_micros("ts")).alias("value")
    return points.where(F.col("kind") == "gauge").groupBy(*series).agg(newest, F.max("ts").alias("ts"))
