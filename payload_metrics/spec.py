"""Declarative source specs: frozen dataclasses, validated on the driver.

A spec never touches data. The operators read it once to build Spark columns.
"""

from __future__ import annotations

import dataclasses
import re
import types
import typing
from dataclasses import dataclass, field
from datetime import datetime
from pathlib import Path
from typing import Any

import yaml

from payload_metrics.functions.regexes import to_java_regex
from payload_metrics.functions.timetext import parse_time_text
from payload_metrics.functions.durations import UNIT_SECONDS, frequency_seconds
from payload_metrics.paths import ROOT_PREFIX, data_steps, is_root_path, key_parts

# The defaults users of the config format rely on.
DEFAULT_TTL_SECONDS = 86400
DEFAULT_MAX_ENTRIES = 50000
DEFAULT_TIME_FORMAT = "%Y-%m-%dT%H:%M:%S%z"

# The kinds of match a filter and a severity rule may name.
MATCH_TYPES = ("equals", "not_equals", "in", "regex")
SEVERITY_MATCH_TYPES = ("equals", "in")

# Config keys that belong to fetching or scheduling; accepted, never read.
FETCH_KEYS = frozenset({"auth", "allowOverlapScans", "endpoint", "baseUrl"})
SCRAPE_FETCH_KEYS = frozenset(
    {"httpMethod", "maxConcurrency", "urlEncodeTimeKeys", "extraHeaders", "extraArgs"}
)


class SpecError(ValueError):
    """The source spec is not valid."""


@dataclass(frozen=True)
class Predicate:
    field: str
    matchType: str
    value: Any

    def __post_init__(self) -> None:
        _require(self.matchType in MATCH_TYPES, f"unknown matchType {self.matchType!r}")
        _no_root(self.field, "filter field")
        if self.matchType == "regex":
            _checked(to_java_regex, str(self.value))


@dataclass(frozen=True)
class DropRule:
    any: tuple[Predicate, ...]


@dataclass(frozen=True)
class KeepRule:
    all: tuple[Predicate, ...]


@dataclass(frozen=True)
class Limits:
    maxRecordsPerScrape: int | None = None


@dataclass(frozen=True)
class Filters:
    drop: tuple[DropRule, ...] = ()
    keep: tuple[KeepRule, ...] = ()
    limits: Limits = field(default_factory=Limits)

    @property
    def cap(self) -> int | None:
        n = self.limits.maxRecordsPerScrape
        return n if n is not None and n > 0 else None


@dataclass(frozen=True)
class DeltaDetection:
    enabled: bool = False
    fingerprintMode: str = "full_record"
    fingerprintKeys: tuple[str, ...] | None = None
    ttlSeconds: int | None = None
    maxEntries: int | None = None

    def __post_init__(self) -> None:
        _require(
            self.fingerprintMode in ("full_record", "keys"),
            f"unknown fingerprintMode {self.fingerprintMode!r}",
        )
        for key in self.fingerprintKeys or ():
            _no_root(key, "fingerprint key")

    @property
    def key_paths(self) -> tuple[str, ...]:
        """Paths to hash, sorted; empty means the whole record."""
        if self.fingerprintMode != "keys" or not self.fingerprintKeys:
            return ()
        return tuple(sorted(set(self.fingerprintKeys)))

    def ttl(self, default: int = DEFAULT_TTL_SECONDS) -> int:
        return self.ttlSeconds or default

    def capacity(self, default: int = DEFAULT_MAX_ENTRIES) -> int:
        return self.maxEntries or default


@dataclass(frozen=True)
class Gauge:
    name: str
    dataKey: str | None = None
    fixedValue: float | None = None
    unit: str = "1"


@dataclass(frozen=True)
class Counter:
    name: str
    dataKey: str | None = None
    fixedValue: float | None = None
    unit: str = "1"


@dataclass(frozen=True)
class Histogram:
    name: str
    buckets: tuple[float, ...]
    dataKey: str | None = None
    fixedValue: float | None = None
    unit: str = "1"

    @property
    def bounds(self) -> tuple[float, ...]:
        return tuple(sorted({float(b) for b in self.buckets}))


@dataclass(frozen=True)
class AttributeMetric:
    metricName: str | None = None
    valueMapping: dict[str, float] = field(default_factory=dict)
    unit: str = "1"


@dataclass(frozen=True)
class Attribute:
    name: str
    dataKey: str
    asMetric: AttributeMetric | None = None


@dataclass(frozen=True)
class SeverityRule:
    value: str | tuple[str, ...]
    matchType: str = "equals"

    def __post_init__(self) -> None:
        _require(
            self.matchType in SEVERITY_MATCH_TYPES,
            f"unknown severity matchType {self.matchType!r}",
        )


@dataclass(frozen=True)
class StatusField:
    name: str
    info: SeverityRule | None = None
    warning: SeverityRule | None = None
    error: SeverityRule | None = None


@dataclass(frozen=True)
class RangeKeys:
    startKey: str | None = None
    endKey: str | None = None
    firstScrapeStart: str | None = None
    unit: str | None = None
    value: str | int | None = "from-config"
    takeNegative: bool = False
    dateFormat: str | None = None

    def __post_init__(self) -> None:
        _require(self.unit is None or self.unit in UNIT_SECONDS, f"unknown unit {self.unit!r}")


@dataclass(frozen=True)
class ParallelWindow:
    unit: str
    value: int

    def __post_init__(self) -> None:
        _require(self.unit in ("minutes", "hours", "days"), f"unknown unit {self.unit!r}")
        _require(self.value > 0, "parallelWindow value must be positive")

    @property
    def seconds(self) -> int:
        return self.value * UNIT_SECONDS[self.unit]


@dataclass(frozen=True)
class Scrape:
    type: str
    timeFormat: str | None = None
    parallelWindow: ParallelWindow | None = None
    rangeKeys: RangeKeys | None = None

    def __post_init__(self) -> None:
        _require(self.type in ("range", "instant"), f"unknown scrape type {self.type!r}")
        _require(self.type != "range" or self.rangeKeys is not None, "range needs rangeKeys")
        _require(
            self.parallelWindow is None or self.type == "range",
            "an instant source has no range to cut into parallel windows",
        )


@dataclass(frozen=True)
class SourceSpec:
    """One source: how to find its records and what to make of them."""

    name: str
    frequency: str
    scrape: Scrape
    emitLogs: bool = True
    dataKey: str | None = None
    filters: Filters = field(default_factory=Filters)
    deltaDetection: DeltaDetection = field(default_factory=DeltaDetection)
    gaugeReadings: tuple[Gauge, ...] = ()
    counterReadings: tuple[Counter, ...] = ()
    histogramReadings: tuple[Histogram, ...] = ()
    attributes: tuple[Attribute, ...] = ()
    logStatusField: StatusField | None = None
    runFirstScrape: bool = False

    def __post_init__(self) -> None:
        _require(bool(self.name), "a source needs a name")
        _checked(frequency_seconds, self.frequency)
        _checked(data_steps, self.dataKey)
        for path in self.field_paths():
            _checked(key_parts, path.removeprefix(ROOT_PREFIX))
        if self.scrape.rangeKeys and self.scrape.rangeKeys.firstScrapeStart:
            _checked(self.first_scrape_start)

    @classmethod
    def from_dict(cls, raw: dict[str, Any]) -> "SourceSpec":
        return _build(cls, raw, "source")

    @classmethod
    def from_yaml(cls, text: str) -> "SourceSpec":
        return cls.from_dict(yaml.safe_load(text))

    def field_paths(self) -> list[str]:
        """Every record or root path the outputs look up."""
        readings = (*self.gaugeReadings, *self.counterReadings, *self.histogramReadings)
        paths = [r.dataKey for r in readings if r.dataKey]
        paths += [a.dataKey for a in self.attributes]
        if self.logStatusField:
            paths.append(self.logStatusField.name)
        return paths

    @property
    def root_paths(self) -> tuple[str, ...]:
        """Distinct ``$root.`` paths of the outputs, without the prefix."""
        paths = {p.removeprefix(ROOT_PREFIX) for p in self.field_paths() if is_root_path(p)}
        return tuple(sorted(paths))

    @property
    def uses_root(self) -> bool:
        return bool(self.root_paths)

    @property
    def frequency_seconds(self) -> int:
        return frequency_seconds(self.frequency)

    @property
    def time_format(self) -> str:
        keys = self.scrape.rangeKeys
        return (keys and keys.dateFormat) or self.scrape.timeFormat or DEFAULT_TIME_FORMAT

    def first_scrape_start(self) -> datetime | None:
        """Configured start of the first range, as an aware UTC time."""
        keys = self.scrape.rangeKeys
        if not keys or not keys.firstScrapeStart:
            return None
        try:
            return parse_time_text(keys.firstScrapeStart, self.time_format)
        except ValueError:
            # "%s" formats and the like cannot be read back; ISO text always can.
            return parse_time_text(keys.firstScrapeStart, None)


def load_specs(path: str | Path) -> dict[str, SourceSpec]:
    """Read the ``sources`` of a YAML config file, by name.

    Defaults of the ``scraper`` section fill in what a source leaves open.
    """
    raw = yaml.safe_load(Path(path).read_text(encoding="utf-8")) or {}
    specs = [_with_defaults(SourceSpec.from_dict(item), raw.get("scraper") or {}) for item in raw.get("sources", [])]
    by_name = {spec.name: spec for spec in specs}
    _require(len(by_name) == len(specs), "source names must be unique")
    return by_name


def _with_defaults(spec: SourceSpec, scraper: dict[str, Any]) -> SourceSpec:
    store = scraper.get("fingerprintStore") or {}
    delta = spec.deltaDetection
    delta = dataclasses.replace(
        delta,
        ttlSeconds=delta.ttlSeconds or store.get("defaultTtlSeconds"),
        maxEntries=delta.maxEntries or store.get("maxEntriesPerSource"),
    )
    time_format = spec.scrape.timeFormat or scraper.get("defaultTimeFormat")
    scrape = dataclasses.replace(spec.scrape, timeFormat=time_format)
    return dataclasses.replace(spec, deltaDetection=delta, scrape=scrape)


def _require(ok: bool, message: str) -> None:
    if not ok:
        raise SpecError(message)


def _checked(fn, *args):
    try:
        return fn(*args)
    except (ValueError, re.error) as exc:
        raise SpecError(str(exc)) from exc


def _no_root(path: str, what: str) -> None:
    _require(not is_root_path(path), f"{what} {path!r} cannot use {ROOT_PREFIX}")


def _build(cls: type, raw: Any, where: str) -> Any:
    """Build a spec dataclass from plain YAML data, rejecting unknown keys."""
    _require(isinstance(raw, dict), f"{where}: expected a mapping")
    hints = typing.get_type_hints(cls)
    ignored = {SourceSpec: FETCH_KEYS, Scrape: SCRAPE_FETCH_KEYS}.get(cls, frozenset())
    unknown = set(raw) - set(hints) - ignored
    _require(not unknown, f"{where}: unknown keys {sorted(unknown)}")
    kwargs = {
        key: _coerce(hints[key], value, f"{where}.{key}")
        for key, value in raw.items()
        if key in hints
    }
    missing = [
        f.name
        for f in dataclasses.fields(cls)
        if f.name not in kwargs
        and f.default is dataclasses.MISSING
        and f.default_factory is dataclasses.MISSING
    ]
    _require(not missing, f"{where}: missing keys {missing}")
    return cls(**kwargs)


def _coerce(hint: Any, value: Any, where: str) -> Any:
    if hint is Any:
        return value
    if dataclasses.is_dataclass(hint):
        return _build(hint, value, where)
    origin, args = typing.get_origin(hint), typing.get_args(hint)
    if origin is types.UnionType:
        if value is None:
            _require(type(None) in args, f"{where}: must not be null")
            return None
        for option in args:
            if option is type(None):
                continue
            try:
                return _coerce(option, value, where)
            except SpecError:
                if dataclasses.is_dataclass(option):
                    raise
        raise SpecError(f"{where}: bad value {value!r}")
    if origin is tuple:
        _require(isinstance(value, list), f"{where}: expected a list")
        return tuple(_coerce(args[0], item, where) for item in value)
    if origin is dict:
        _require(isinstance(value, dict), f"{where}: expected a mapping")
        return {str(k): _coerce(args[1], v, where) for k, v in value.items()}
    if hint is float:
        _require(isinstance(value, (int, float)), f"{where}: expected a number")
        return float(value)
    if hint is int:
        _require(isinstance(value, int), f"{where}: expected an integer")
        return int(value)
    _require(isinstance(value, hint), f"{where}: expected {hint.__name__}")
    return value


