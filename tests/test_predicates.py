"""Predicates on dynamic and typed records against the same rules in Python."""

from __future__ import annotations

import json
import re

import pytest
from pyspark.sql import functions as F

from payload_metrics.functions.regexes import to_java_regex
from payload_metrics.functions.values import map_value, strict_double
from payload_metrics.operators.extract import typed_records
from payload_metrics.operators.fields import fields_of, matches
from payload_metrics.operators.filters import apply_filters
from payload_metrics.spec import SourceSpec

VALUES = [
    None, True, False, 0, 1, 2, 1.5, -3, 10**17 + 1, "", "1", "1.0", "a", "abc", "a\nc", "true", "True", "é",
    [], ["a"], ["a", 1], [1.0, None], [[1]], {"a": 1}, {},
]
LITERALS = [None, True, False, 0, 1, 1.0, 1.5, 10**17 + 1, "1", "a", "true", [], ["a"], {"a": 1}]
LISTS = [[], [1, "a"], [None], [True], ["1", 1.5], [0, "abc", None]]
PATTERNS = ["a.c", "^a$", r"\d", "True", "^$", r"\w", "^1"]


def python_equal(a, b):
    return a == b


def python_in(value, expected):
    if isinstance(expected, list):
        return value in expected
    if isinstance(value, list):
        return expected in value
    return isinstance(value, str) and isinstance(expected, str) and expected in value


def python_regex(value, pattern):
    if value is None:
        return False
    return re.search(pattern, str(value)) is not None


@pytest.fixture(scope="module")
def dynamic(spark):
    rows = [(i, json.dumps({"v": {"x": v}})) for i, v in enumerate(VALUES)]
    rows.append((len(VALUES), "{}"))
    df = spark.createDataFrame(rows, "i int, t string").withColumn("record", F.parse_json("t"))
    return df.cache()


def answers(df, tests):
    """For every test, the set of row numbers that match."""
    fields = fields_of(df)
    columns = [matches(fields, "v.x", kind, value).alias(f"t{n}") for n, (kind, value) in enumerate(tests)]
    got = df.select("i", *columns).collect()
    return [{row["i"] for row in got if row[f"t{n}"]} for n in range(len(tests))]


def check(df, values, tests, rule):
    for (kind, value), got in zip(tests, answers(df, tests)):
        want = {i for i, v in enumerate(values) if rule(v, value)}
        assert got == want, (kind, value)


def test_equals(dynamic):
    check(dynamic, [*VALUES, None], [("equals", x) for x in LITERALS], python_equal)


def test_not_equals(dynamic):
    check(dynamic, [*VALUES, None], [("not_equals", x) for x in LITERALS], lambda a, b: a != b)


def test_in(dynamic):
    literals = [x for x in LITERALS if not isinstance(x, list)]
    check(dynamic, [*VALUES, None], [("in", x) for x in [*LISTS, *literals]], python_in)


def test_regex(dynamic):
    plain = [(i, v) for i, v in enumerate([*VALUES, None]) if not isinstance(v, (list, dict))]
    for pattern, got in zip(PATTERNS, answers(dynamic, [("regex", p) for p in PATTERNS])):
        assert {i for i, v in plain if i in got} == {i for i, v in plain if python_regex(v, pattern)}, pattern


TYPED = {
    "string": ["a", "abc", "1", "true", None],
    "bigint": [0, 1, 2, 10**17 + 1, None],
    "double": [0.0, 1.0, 1.5, None],
    "boolean": [True, False, None],
    "array<string>": [["a"], ["a", "b"], [], None],
}


@pytest.mark.parametrize("kind", sorted(TYPED))
def test_typed(spark, kind):
    values = TYPED[kind]
    df = spark.createDataFrame([(i, {"x": v}) for i, v in enumerate(values)], f"i int, v struct<x:{kind}>")
    records = df.select("i", F.struct("v").alias("record"))
    check(records, values, [("equals", x) for x in LITERALS], python_equal)
    check(records, values, [("not_equals", x) for x in LITERALS], lambda a, b: a != b)
    literals = [x for x in LITERALS if not isinstance(x, list)]
    check(records, values, [("in", x) for x in [*LISTS, *literals]], python_in)
    if kind in ("string", "bigint", "boolean"):
        check(records, values, [("regex", p) for p in PATTERNS], python_regex)


def test_numbers_from_text(spark):
    texts = [
        "1", " 2 ", "\t3\n", "+4.5", "-.5", "5.", "1e3", "1_000", "inf", "-Infinity", "1.5d", "2f", "", " ", "x",
        "0x10", "1__0", "_1", "1e", "1 2", "NaN", "+nan", "1e400", "١",
    ]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r["i"]: r["n"] for r in df.select("i", strict_double(F.col("t")).alias("n")).collect()}
    for i, text in enumerate(texts):
        try:
            want = float(text)
        except ValueError:
            want = None
        if text == "١":
            continue  # digits of other scripts are not numbers here
        assert repr(got[i]) == repr(want), text


def test_numbers_from_json(spark):
    docs = ["true", "false", "null", "7", "1.25", '"3"', '"x"', "[1]", "{}"]
    df = spark.createDataFrame([(i, f'{{"x": {d}}}') for i, d in enumerate(docs)], "i int, t string")
    df = df.withColumn("record", F.parse_json("t"))
    got = [r[0] for r in df.select(fields_of(df).number("x")).collect()]
    assert got == [1.0, 0.0, None, 7.0, 1.25, 3.0, None, None, None]


def test_regexes_agree_with_python(spark):
    texts = ["", "a", "ab", "a[b", "a]b", "a&&b", "x{,2}", "aaa", "A", "é", "é9", "a\n", "a\nb", "a\r", "aa-aa", "\\\\Z", "\\Z", "٣"]
    patterns = [
        r"[[]", r"[]]", r"[^[]b", r"[a&&b]+$", r"^a{,2}$", r"^\w+$", r"^\d$", r"a\Z", r"\\Z", r"a$", r"^b", r"(?m)^b",
        r"(?P<x_1>a+)-(?P=x_1)", r"(?i)^a$", r"(?i)É", r"a.b", r"(?s)a.b", r"\[", r"[\]\[]", r"^a.$", r"\bb",
    ]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    columns = [F.col("t").rlike(to_java_regex(p)).alias(f"p{n}") for n, p in enumerate(patterns)]
    got = {r["i"]: r for r in df.select("i", *columns).collect()}
    for n, pattern in enumerate(patterns):
        for i, text in enumerate(texts):
            assert got[i][f"p{n}"] == bool(re.search(pattern, text)), (pattern, text)


def test_mapping_keys(spark):
    docs = ["true", '"us"', "null", "5"]
    df = spark.createDataFrame([(f'{{"x": {d}}}',) for d in docs], "t string").withColumn("record", F.parse_json("t"))
    f = fields_of(df)

    def mapped(table):
        return [r[0] for r in df.select(map_value(f.printed("x"), f.text("x"), table)).collect()]

    assert mapped({"true": 1, "us": 2, "None": 3}) == [1.0, 2.0, 3.0, None]
    assert mapped({"True": 1, "5": 4}) == [1.0, None, None, 4.0]
    assert mapped({}) == [None] * 4


def spec(**filters):
    return SourceSpec.from_dict(
        {"name": "s", "frequency": "1h", "scrape": {"type": "instant"}, "filters": filters}
    )


def p(field, kind, value):
    return {"field": field, "matchType": kind, "value": value}


def test_drop_comes_before_keep(spark):
    rows = [(1, "ignore", "ok"), (2, "use", "ok"), (3, "use", "fail")]
    records = typed_records(spark.createDataFrame(rows, "id bigint, type string, status string"), "s", "id")
    config = spec(drop=[{"any": [p("type", "equals", "ignore")]}], keep=[{"all": [p("status", "equals", "ok")]}])
    assert [r[0] for r in apply_filters(records, config).select("record.id").collect()] == [2]


def test_rule_without_predicates(spark):
    records = typed_records(spark.createDataFrame([(1,), (2,)], "id bigint"), "s", "id")
    assert apply_filters(records, spec(keep=[{"all": []}])).count() == 2
    assert apply_filters(records, spec(drop=[{"any": []}])).count() == 2
    assert apply_filters(records, spec()).count() == 2


def test_typed_rules_reach_the_scan(spark, tmp_path, capsys):
    spark.range(10).selectExpr("id", "cast(id as string) t", "id * 2 unused").write.parquet(f"{tmp_path}/t")
    records = typed_records(spark.read.parquet(f"{tmp_path}/t"), "s", "id")
    kept = apply_filters(records, spec(keep=[{"all": [p("t", "in", ["1", "2"]), p("id", "equals", 1)]}]))
    kept.select("record.t").explain("formatted")
    plan = capsys.readouterr().out
    assert "In(t, [1,2])" in plan and "EqualNullSafe(id,1)" in plan
    assert "ReadSchema: struct<id:bigint,t:string>" in plan
