"""strftime-style time formats on Spark timestamps (session time zone UTC)."""

from __future__ import annotations

import re
from datetime import datetime, timezone

from pyspark.sql import Column
from pyspark.sql import functions as F

# Strftime directives and their Java patterns.
WRITE_PATTERNS = {
    "%Y": "yyyy",
    "%y": "yy",
    "%m": "MM",
    "%d": "dd",
    "%H": "HH",
    "%I": "hh",
    "%M": "mm",
    "%S": "ss",
    "%f": "SSSSSS",
    "%p": "a",
    "%j": "DDD",
    "%a": "EEE",
    "%A": "EEEE",
    "%b": "MMM",
    "%B": "MMMM",
    "%z": "xx",
    "%Z": "zzz",
    "%F": "yyyy-MM-dd",
    "%T": "HH:mm:ss",
}
# Reading is laxer than writing: "%z" also takes "Z" and "+00:00".
READ_PATTERNS = WRITE_PATTERNS | {"%z": "[XXX][XX]", "%f": "[SSSSSS][SSSSS][SSSS][SSS][SS][S]"}

# Date and time texts of ISO 8601. Dates come first and are not reconsidered; whole dates alone may
# have a time, after any one character. The groups of alternative spellings exclude each other.
_DAY = r"-(\d{2})-(\d{2})|(\d{2})(\d{2})|-W(\d{2})-(\d)|W(\d{2})(\d)|-(\d{3})|(\d{3})"
_TIME = r"(\d{2})(?::(\d{2})(?::(\d{2})(?:[.,](\d+))?)?|(\d{2})(?:(\d{2})(?:[.,](\d+))?)?)?"
_OFFSET = r"(Z|z|[+-]\d{2}(?::?\d{2})?)?"
ISO = rf"(?s)^(\d{{4}})(?:-(\d{{2}})$|-W(\d{{2}})$|W(\d{{2}})$|$|(?>{_DAY})(?:$|.(?:{_TIME}{_OFFSET}|([+-]\d{{2}}(?::?\d{{2}})?))$))"
#: Year, month, day, week, day of week, day of year, hour, minute, second, fraction, offset.
ISO_PARTS = "$1|$2$5$7|$6$8|$3$4$9$11|$10$12|$13$14|$15|$16$19|$17$20|$18$21|$22$23"

#: The first microsecond after the year 9999.
LAST_MICRO = 253_402_300_800_000_000
_TOKEN = re.compile(r"%.|[^%]+", re.DOTALL)


def java_pattern(fmt: str, table: dict[str, str]) -> str:
    out = []
    for token in _TOKEN.findall(fmt):
        if not token.startswith("%"):
            out.append("'" + token.replace("'", "''") + "'")
        elif token in table:
            out.append(table[token])
        else:
            raise ValueError(f"no Java pattern for {token!r} in {fmt!r}")
    return "".join(out)


def parse_time_text(text: str, fmt: str | None) -> datetime:
    """Driver-side reading for spec values; naive times are UTC."""
    value = datetime.strptime(text, fmt) if fmt else datetime.fromisoformat(text)
    return value.replace(tzinfo=timezone.utc) if value.tzinfo is None else value.astimezone(timezone.utc)


def parse_time(text: Column, fmt: str | None) -> Column:
    """TIMESTAMP, NULL where the text does not fit; naive times are UTC."""
    if fmt is None:
        return _iso_time(text)
    return F.try_to_timestamp(text, F.lit(java_pattern(fmt, READ_PATTERNS)))


def _iso_time(text: Column) -> Column:
    """Calendar dates, years and months, week dates and days of the year, with dashes or without;
    times to the hour, minute, second or fraction (of which six digits count), with colons or
    without, 24:00 as the next day; ``Z`` or an offset."""
    parts = F.split(F.regexp_replace(text, ISO, ISO_PARTS), r"\|")

    def part(at: int, default: int | None = None) -> Column:
        return F.coalesce(F.nullif(F.get(parts, F.lit(at)), F.lit("")).try_cast("int"), F.lit(default))

    year, week, weekday, of_year = F.get(parts, F.lit(0)), part(3), part(4, 1), part(5)
    first, fourth = [F.concat(year, F.lit(f"-01-{day}")).try_cast("date") for day in ("01", "04")]
    monday = F.date_sub(fourth, F.weekday(fourth))
    by_week = F.when(week.between(1, 53) & weekday.between(1, 7), F.date_add(monday, (week - 1) * 7 + weekday - 1))
    numbered = F.date_add(first, of_year - 1)
    by_number = F.when((of_year >= 1) & (F.year(numbered) == F.year(first)), numbered)
    by_month = F.concat_ws("-", year, F.lpad(part(1, 1).cast("string"), 2, "0"), F.lpad(part(2, 1).cast("string"), 2, "0"))
    date = F.when(week.isNotNull(), by_week).when(of_year.isNotNull(), by_number).otherwise(by_month.try_cast("date"))

    hour, minute, second = part(6, 0), part(7, 0), part(8, 0)
    micro = F.rpad(F.substring(F.get(parts, F.lit(9)), 1, 6), 6, "0").cast("bigint")
    of_day = ((hour * 60 + minute) * 60 + second).cast("bigint") * 1_000_000 + micro
    real = (minute < 60) & (second < 60) & (of_day <= 86_400_000_000)
    offset = F.regexp_replace(F.get(parts, F.lit(10)), "[:Zz]", "")
    ahead = F.substring(offset, 2, 2).try_cast("int"), F.coalesce(F.nullif(F.substring(offset, 4, 2), F.lit("")).try_cast("int"), F.lit(0))
    away = F.when(offset == "", 0).when((ahead[0] < 24) & (ahead[1] < 60), (ahead[0] * 60 + ahead[1]) * F.when(F.substring(offset, 1, 1) == "-", -60).otherwise(60))
    local = F.unix_date(date).cast("bigint") * 86_400_000_000 + of_day
    known = text.rlike(ISO) & real & (year >= "0001") & (local < LAST_MICRO)
    return F.when(known, F.timestamp_micros(local - away.cast("bigint") * 1_000_000))


def format_time(ts: Column, fmt: str | None) -> Column:
    """Time as text; ISO-8601 with offset when no format is given."""
    if fmt is None:
        fraction = F.when(F.date_format(ts, "SSSSSS") != "000000", F.date_format(ts, ".SSSSSS"))
        return F.concat(
            F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss"), F.coalesce(fraction, F.lit("")), F.lit("+00:00")
        )
    pieces = []
    for i, chunk in enumerate(re.split(r"(?<!%)%s", fmt)):
        if i:
            pieces.append(F.unix_seconds(ts).cast("string"))
        if chunk:
            pieces.append(F.date_format(ts, java_pattern(chunk, WRITE_PATTERNS)))
    return F.concat(*pieces)
