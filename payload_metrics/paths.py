"""Dotted path notation: ``a.b`` steps, ``/.`` for a literal dot, ``[...]`` selectors."""

from __future__ import annotations

import re
from dataclasses import dataclass

ROOT_PREFIX = "$root."

# A separator is a dot that is not written as "/.".
_SEPARATOR = re.compile(r"(?<!/)\.")
_SELECTED = re.compile(r"(?P<name>[^\[]*)\[(?P<selector>.*)\]", re.DOTALL)


@dataclass(frozen=True)
class EveryItem:
    """``name[]``: all items of a list."""


@dataclass(frozen=True)
class ItemAt:
    """``name[2]`` or ``name[-1]``: one item."""

    index: int


@dataclass(frozen=True)
class ItemRange:
    """``name[1:3]``: half-open range, either end open, negatives from the end."""

    start: int | None
    stop: int | None


@dataclass(frozen=True)
class DataStep:
    name: str
    selector: EveryItem | ItemAt | ItemRange | None = None


def is_root_path(path: str | None) -> bool:
    return path is not None and path.startswith(ROOT_PREFIX)


def key_parts(path: str | None) -> list[str]:
    """Object keys of a lookup path; selectors are ordinary characters here."""
    pieces = _SEPARATOR.split(path or "")
    return [_quotable(p.replace("/.", ".")) for p in pieces if p]


def data_steps(path: str | None) -> list[DataStep]:
    """Steps of a ``dataKey``, where list selectors count."""
    return [_data_step(piece) for piece in _SEPARATOR.split(path or "") if piece]


def variant_path(parts: list[str]) -> str:
    """Bracket-quoted path for ``variant_get``."""
    quoted = (f"['{p}']" if '"' in p else f'["{p}"]' for p in parts)
    return "$" + "".join(quoted)


def _data_step(piece: str) -> DataStep:
    piece = piece.replace("/.", ".")
    match = _SELECTED.fullmatch(piece)
    if match is None:
        return DataStep(_quotable(piece))
    return DataStep(_quotable(match["name"]), _selector(match["selector"]))


def _selector(text: str) -> EveryItem | ItemAt | ItemRange:
    if text == "":
        return EveryItem()
    if ":" not in text:
        return ItemAt(int(text))
    ends = [int(end) if end else None for end in text.split(":", 1)]
    return ItemRange(*ends)


def _quotable(name: str) -> str:
    if '"' in name and "'" in name:
        raise ValueError(f"key {name!r} mixes both quote characters")
    return name
