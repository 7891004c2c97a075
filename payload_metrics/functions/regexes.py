"""Python regular expressions rewritten for Spark's ``rlike``."""

from __future__ import annotations

import re

_CONDITIONAL = re.compile(r"\(\?\(")
# One escape, one character class, one named group or reference, or one open-ended count.
_PIECE = re.compile(
    r"\\.|\[(?P<not>\^?)(?P<body>\]?(?:\\.|[^\]\\])*)\]|\(\?P<(?P<name>\w+)>|\(\?P=(?P<ref>\w+)\)|\{,(?P<most>\d+)\}",
    re.DOTALL,
)
_IN_CLASS = re.compile(r"\\.|[\[\]&]", re.DOTALL)


def to_java_regex(pattern: str) -> str:
    """The same language under Java's rules for groups, classes, end anchors and line ends."""
    re.compile(pattern)
    if _CONDITIONAL.search(pattern):
        raise ValueError(f"conditional groups are not supported: {pattern!r}")
    groups: dict[str, str] = {}

    def piece(match: re.Match) -> str:
        if match["name"]:
            # Java allows letters and digits only.
            return f"(?<{groups.setdefault(match['name'], f'g{len(groups)}')}>"
        if match["ref"]:
            return rf"\k<{groups[match['ref']]}>"
        if match["most"]:
            return f"{{0,{match['most']}}}"
        if match["body"] is not None:
            # A bare bracket or ampersand would nest or intersect classes.
            return f"[{match['not']}{_IN_CLASS.sub(_escaped, match['body'])}]"
        return r"\z" if match[0] == r"\Z" else match[0]

    java = _PIECE.sub(piece, pattern)
    # (?d): only "\n" ends a line. (?U): \w, \d, \s and \b cover Unicode.
    flags = "dU" if re.search(r"\\[wWdDsSbB]|\(\?i", pattern) else "d"
    return f"(?{flags}){java}"


def _escaped(match: re.Match) -> str:
    return match[0] if match[0].startswith("\\") else "\\" + match[0]
