"""Value coercions shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the texts that count as a number, blanks around them allowed.
NUMBER_TEXT = r"(?i)^\s*[+-]?(\d+(_\d+)*\.?(\d+(_\d+)*)?|\.\d+(_\d+)*)(e[+-]?\d+(_\d+)*)?\s*$"
INFINITE_TEXT = r"(?i)^\s*[+-]?inf(inity)?\s*$"
NAN_TEXT = r"(?i)^\s*[+-]?nan\s*$"

SNIPPET_CHARS = 200


def strict_double(text: Column) -> Column:
    """DOUBLE of a numeric text; NULL for anything else, such as ``1.5d``."""
    plain = F.replace(text, F.lit("_"), F.lit(""))
    return (
        F.when(text.rlike(NUMBER_TEXT), plain.try_cast("double"))
        .when(text.rlike(INFINITE_TEXT), text.try_cast("double"))
        .when(text.rlike(NAN_TEXT), F.lit(float("nan")))
    )


def map_value(printed: Column, plain: Column, mapping: dict[str, float]) -> Column:
    """Mapped number of a text, NULL when unmapped. Booleans match ``True`` and ``true``.

    A missing value has the text ``None``, which a mapping may name.
    """
    if not mapping:
        return F.lit(None).cast("double")
    pairs = [F.lit(x) for key, number in mapping.items() for x in (key, float(number))]
    table = F.create_map(*pairs)
    first = F.try_element_at(table, F.coalesce(printed, F.lit("None")))
    return F.coalesce(first, F.try_element_at(table, F.coalesce(plain, F.lit("None"))))


def snippet(text: Column) -> Column:
    """The first characters of a bad payload, for a reject row only."""
    return F.substring(text, 1, SNIPPET_CHARS)


def sha256(text: Column) -> Column:
    """Hex digest. Declared not NULL, so joins on it add no test that hashes a second time."""
    return F.coalesce(F.sha2(text, 256), F.lit(""))
