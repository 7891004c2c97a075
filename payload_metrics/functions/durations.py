"""Frequency texts such as ``5min`` or ``1mon`` as seconds."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Frequency units; a month counts as 30 days.
FREQUENCY_UNITS = {
    "min": 60,
    "m": 60,
    "h": 3600,
    "d": 86400,
    "w": 604800,
    "mon": 2592000,
}

# Units of relative ranges and parallel windows.
UNIT_SECONDS = {
    "minutes": 60,
    "hours": 3600,
    "days": 86400,
    "weeks": 604800,
    "months": 2592000,
}

# Fixed value: how a frequency is written.
FREQUENCY_PATTERN = r"^\s*(\d+)(min|mon|m|h|d|w)\s*$"


def frequency_seconds(text: str) -> int:
    match = re.match(FREQUENCY_PATTERN, text)
    if match is None:
        raise ValueError(f"bad frequency {text!r}")
    return int(match[1]) * FREQUENCY_UNITS[match[2]]


def frequency_seconds_col(text: Column) -> Column:
    """BIGINT seconds, NULL where the text is no frequency."""
    unit = F.regexp_extract(text, FREQUENCY_PATTERN, 2)
    count = F.regexp_extract(text, FREQUENCY_PATTERN, 1).try_cast("bigint")
    return count * _lookup(FREQUENCY_UNITS, unit)


def unit_seconds_col(unit: Column) -> Column:
    """Seconds of a relative unit; 1 for anything unknown."""
    return F.coalesce(_lookup(UNIT_SECONDS, unit), F.lit(1).cast("bigint"))


def _lookup(table: dict[str, int], key: Column) -> Column:
    pairs = [F.lit(x) for name, seconds in table.items() for x in (name, seconds)]
    return F.try_element_at(F.create_map(*pairs), key).cast("bigint")
