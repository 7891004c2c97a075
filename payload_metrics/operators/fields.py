"""Field access on the ``record`` column, the only place that knows its type.

``VariantFields`` reads dynamic records (``record VARIANT``), ``StructFields`` reads typed
records (``record STRUCT``). Both give the same answers, so every operator is written once.
"""

from __future__ import annotations

import json
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from payload_metrics.functions.regexes import to_java_regex
from payload_metrics.functions.values import strict_double
from payload_metrics.paths import ROOT_PREFIX, is_root_path, key_parts, variant_path

# JSON numbers read from text; a boolean also counts as a number (true is 1).
_NUMBER_TYPES = "^(BIGINT|DOUBLE|FLOAT|DECIMAL|BOOLEAN)"


def fields_of(df: DataFrame) -> "VariantFields | StructFields":
    """Field access for a records frame, chosen by its schema."""
    record = df.schema["record"].dataType
    if isinstance(record, T.StructType):
        return StructFields(record)
    return VariantFields(F.col("record"), F.col("root") if "root" in df.columns else None)


class VariantFields:
    """Fields of a VARIANT record. Lists are not traversed; a JSON null counts as missing.

    ``root`` is a struct with a VARIANT per root path.
    """

    def __init__(self, record: Column, root: Column | None = None):
        self._record = record
        self._root = root

    def _get(self, path: str, as_type: str) -> Column:
        scope = self._record
        if is_root_path(path):
            if self._root is None:
                raise ValueError(f"{path!r} needs a root column")
            scope, path = self._root.getField(path.removeprefix(ROOT_PREFIX)), ""
        return F.try_variant_get(scope, variant_path(key_parts(path)), as_type)

    def value(self, path: str) -> Column:
        return self._get(path, "variant")

    def text(self, path: str) -> Column:
        """Text of any value (JSON text for objects and lists), NULL when missing."""
        return self._get(path, "string")

    def _type(self, path: str) -> Column:
        return F.schema_of_variant(self.value(path))

    def _is_string(self, path: str) -> Column:
        return self._type(path) == "STRING"

    def printed(self, path: str) -> Column:
        """Like ``text``, with booleans capitalised."""
        text = self.text(path)
        is_bool = text.isin("true", "false") & ~self._is_string(path)
        return F.when(is_bool, F.initcap(text)).otherwise(text)

    def number(self, path: str) -> Column:
        """DOUBLE of a number, boolean or numeric text, else NULL."""
        return F.when(self._is_string(path), strict_double(self.text(path))).otherwise(
            self._get(path, "double")
        )

    def missing(self, path: str) -> Column:
        value = self.value(path)
        return value.isNull() | F.is_variant_null(value)

    def json(self, path: str) -> Column:
        return F.to_json(self.value(path))

    def key_entry(self, path: str) -> Column:
        return self.value(path)

    def whole(self) -> Column:
        return self._record

    def equals(self, path: str, literal: Any) -> Column:
        """Typed equality, never NULL."""
        if literal is None:
            return self.missing(path)
        if isinstance(literal, str):
            return _sure((self.text(path) == literal) & self._is_string(path))
        if isinstance(literal, (bool, int, float)):
            kind, as_lit = _number_literal(literal)
            # The type test matters for texts, which would be cast to a number.
            return _sure((self._get(path, kind) == as_lit) & self._type(path).rlike(_NUMBER_TYPES))
        return _sure(self.json(path) == _canonical(literal))

    def member(self, path: str, literals: list[Any]) -> Column:
        """Equal to one of the literals; texts are tested at once."""
        texts = [x for x in literals if isinstance(x, str)]
        tests = [self.equals(path, x) for x in literals if not isinstance(x, str)]
        if texts:
            tests.append(_sure(self.text(path).isin(texts) & self._is_string(path)))
        return any_of(tests)

    def holds(self, path: str, literal: Any) -> Column:
        """Substring of a text field, or item of a list field."""
        items = self._get(path, "array<variant>")
        in_list = F.exists(items, lambda x: VariantFields(x).equals("", literal))
        if isinstance(literal, str):
            in_text = self.text(path).contains(literal) & self._is_string(path)
            return _sure(in_text) | _sure(in_list)
        return _sure(in_list)


class StructFields:
    """Fields of a STRUCT record; value types are known when the plan is built."""

    def __init__(self, record: T.StructType):
        self._record = record

    def _find(self, path: str) -> tuple[Column, T.DataType] | None:
        if is_root_path(path):
            raise ValueError(f"{path!r}: typed records have no root; make it a column of the record")
        col, kind = F.col("record"), self._record
        for part in key_parts(path):
            if not isinstance(kind, T.StructType) or part not in kind.names:
                return None
            kind = kind[part].dataType
            col = col.getField(part)
        return col, kind

    def text(self, path: str) -> Column:
        found = self._find(path)
        if found is None:
            return F.lit(None).cast("string")
        col, kind = found
        if isinstance(kind, (T.StructType, T.ArrayType, T.MapType)):
            return F.to_json(F.to_variant_object(col))
        return col.cast("string")

    def printed(self, path: str) -> Column:
        found = self._find(path)
        if found is not None and isinstance(found[1], T.BooleanType):
            return F.initcap(found[0].cast("string"))
        return self.text(path)

    def number(self, path: str) -> Column:
        found = self._find(path)
        if found is not None:
            col, kind = found
            if isinstance(kind, (T.NumericType, T.BooleanType)):
                return col.cast("double")
            if isinstance(kind, T.StringType):
                return strict_double(col)
        return F.lit(None).cast("double")

    def missing(self, path: str) -> Column:
        found = self._find(path)
        return F.lit(True) if found is None else found[0].isNull()

    def key_entry(self, path: str) -> Column:
        found = self._find(path)
        if found is None:
            return F.lit(None).cast("variant")
        col, kind = found
        nested = isinstance(kind, (T.StructType, T.ArrayType, T.MapType))
        return F.to_variant_object(col) if nested else col

    def whole(self) -> Column:
        return F.to_variant_object(F.col("record"))

    def equals(self, path: str, literal: Any) -> Column:
        if literal is None:
            return self.missing(path)
        found = self._find(path)
        if found is None:
            return F.lit(False)
        col, kind = found
        if isinstance(kind, (T.StructType, T.ArrayType, T.MapType)):
            return F.to_json(F.to_variant_object(col)).eqNullSafe(_canonical(literal))
        is_number = isinstance(literal, (bool, int, float))
        if isinstance(kind, T.BooleanType):
            return col.cast("int").eqNullSafe(F.lit(literal).cast("double")) if is_number else F.lit(False)
        if isinstance(kind, T.NumericType):
            if not is_number or (isinstance(kind, T.IntegralType) and float(literal) % 1):
                return F.lit(False)
            return col.eqNullSafe(_number_literal(literal)[1])
        if isinstance(literal, str):
            return (col if isinstance(kind, T.StringType) else col.cast("string")).eqNullSafe(literal)
        return F.lit(False)

    def member(self, path: str, literals: list[Any]) -> Column:
        """Equal to one of the literals. Plain texts and integers become one IN for the scan."""
        found = self._find(path)
        plain: list[Any] = []
        if found is not None and isinstance(found[1], T.StringType):
            plain = [x for x in literals if isinstance(x, str)]
        elif found is not None and isinstance(found[1], T.IntegralType):
            plain = [x for x in literals if isinstance(x, int) and abs(x) < 2**31]
        tests = [self.equals(path, x) for x in literals if x not in plain]
        if plain:
            tests.append(found[0].isNotNull() & found[0].isin([_plain(x) for x in plain]))
        return any_of(tests)

    def holds(self, path: str, literal: Any) -> Column:
        found = self._find(path)
        if found is None:
            return F.lit(False)
        col, kind = found
        if isinstance(kind, T.StringType) and isinstance(literal, str):
            return _sure(col.contains(literal))
        if isinstance(kind, T.ArrayType):
            items = F.try_variant_get(F.to_variant_object(col), "$", "array<variant>")
            return _sure(F.exists(items, lambda x: VariantFields(x).equals("", literal)))
        return F.lit(False)


def matches(fields: VariantFields | StructFields, path: str, match_type: str, value: Any) -> Column:
    """One predicate as a BOOLEAN column that is never NULL."""
    if match_type == "equals":
        return fields.equals(path, value)
    if match_type == "not_equals":
        return ~fields.equals(path, value)
    if match_type == "in":
        if isinstance(value, (list, tuple)):
            return fields.member(path, list(value))
        return fields.holds(path, value)
    if match_type == "regex":
        return _sure(fields.printed(path).rlike(to_java_regex(str(value))))
    raise ValueError(f"unknown match type {match_type!r}")


def any_of(conditions: list[Column]) -> Column:
    out = F.lit(False)
    for i, condition in enumerate(conditions):
        out = condition if i == 0 else out | condition
    return out


def all_of(conditions: list[Column]) -> Column:
    out = F.lit(True)
    for i, condition in enumerate(conditions):
        out = condition if i == 0 else out & condition
    return out


def _sure(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False))


def _plain(literal: Any) -> Any:
    """Booleans count as numbers."""
    return int(literal) if isinstance(literal, bool) else literal


def _number_literal(literal: bool | int | float) -> tuple[str, Column]:
    """Type to compare in and the literal; wide integers stay exact."""
    if isinstance(literal, bool) or (isinstance(literal, float) and literal.is_integer()):
        literal = int(literal)
    if isinstance(literal, int):
        if abs(literal) < 2**53:
            return "double", F.lit(literal)
        if abs(literal) < 10**38:
            return "decimal(38,0)", F.expr(f"cast('{literal}' as decimal(38,0))")
    return "double", F.lit(float(literal))


def _canonical(literal: Any) -> Column:
    return F.to_json(F.parse_json(F.lit(json.dumps(literal))))
