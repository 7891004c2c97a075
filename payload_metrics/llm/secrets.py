"""Secrets in texts: three patterns, and encodings that are confirmed by their structure.

Patterns name their spans ``assign``, ``access`` and ``hex``. Beyond them, base64 and hex
candidates are decoded, and reported only if the bytes parse: as a private key in DER, whose
nested lengths must fill one another exactly (``key``, or ``pem`` inside PEM lines), as an OpenSSH
private key (likewise), or as a signed token, whose header is a JSON object that names an
algorithm and whose claims are a JSON object (``jwt``). Random letters, digests, public keys and
certificates do not parse as any of these. PEM lines may end in line breaks or in the two characters
``\\n``, as keys in JSON and environment files do, and may begin with header lines. Where these say
that the key is encrypted, they must name a cipher and a hex start value, and the body must fill
whole blocks of that value's length.

Defined cases: null texts count as empty and have no span; spans are in code points, end
exclusive, ordered by start and then by kind; kinds may overlap; a repeated document is scanned
again. Other columns are kept.
"""

from __future__ import annotations

import base64
import binascii
import json
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# The patterns, and the fewest characters of a match.
ASSIGN = re.compile(
    r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
ASSIGN_VALUE, ACCESS_LENGTH, HEX_LENGTH = 12, 18, 16
ASSIGN_NAMES = ("password", "passwd", "secret", "token", "apikey", "api_key")
BASE_KINDS = ["assign", "access", "hex"]
KINDS = [*BASE_KINDS, "pem", "key", "jwt"]

LONG_HEX = re.compile(r"(?<![0-9A-Fa-f])[0-9A-Fa-f]{64,}(?![0-9A-Fa-f])")
LONG_BASE64 = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{40,}={0,2}")
PEM = re.compile(
    r"-----BEGIN ([A-Z0-9 ]*PRIVATE KEY)-----(?:\s|\\[nr])*"
    r"((?:[A-Za-z0-9-]+:[^\\\r\n]*(?:\s|\\[nr])+)*)"
    r"((?:[A-Za-z0-9+/=\s]|\\[nr])+)-----END \1-----"
)
PEM_BREAK = re.compile(r"\s|\\[nr]")
ENCRYPTED = re.compile(r"Proc-Type:\s*4,\s*ENCRYPTED(?![A-Z])")
CIPHER = re.compile(r"DEK-Info:\s*[A-Z0-9-]{3,},\s*((?:[0-9A-Fa-f]{2}){8,16})(?![0-9A-Fa-f])")
SIGNED = re.compile(r"(?<![A-Za-z0-9_.-])([A-Za-z0-9_-]{8,})\.([A-Za-z0-9_-]{2,})\.([A-Za-z0-9_-]*)")
OPENSSH = b"openssh-key-v1\x00"
INTEGER, OCTETS, OBJECT, SEQUENCE = 0x02, 0x04, 0x06, 0x30
SPANS = "array<struct<kind: string, start: bigint, end: bigint>>"


def elements(data: bytes) -> list[tuple[int, bytes]] | None:
    """Tags and contents of the DER elements that fill ``data`` exactly, else None."""
    found, at = [], 0
    while at < len(data):
        if at + 2 > len(data):
            return None
        tag, length, at = data[at], data[at + 1], at + 2
        if length & 0x80:
            width = length & 0x7F
            if not 1 <= width <= 4 or at + width > len(data):
                return None
            length, at = int.from_bytes(data[at : at + width], "big"), at + width
        if at + length > len(data):
            return None
        found.append((tag, data[at : at + length]))
        at += length
    return found


def _algorithm(content: bytes) -> bool:
    inner = elements(content)
    return bool(inner) and inner[0][0] == OBJECT and len(inner[0][1]) >= 3


def is_private_key(data: bytes) -> bool:
    """PKCS#1, PKCS#8 (plain or encrypted), SEC 1 or OpenSSH."""
    if data.startswith(OPENSSH):
        return _openssh(data[len(OPENSSH) :])
    outer = elements(data) if data[:1] == bytes([SEQUENCE]) else None
    if not outer or len(outer) != 1:
        return False
    parts = elements(outer[0][1])
    if not parts:
        return False
    tags = [tag for tag, _ in parts]
    first = parts[0][1]
    if tags[:3] == [INTEGER, SEQUENCE, OCTETS]:
        return first in (b"\x00", b"\x01") and _algorithm(parts[1][1])
    if tags == [INTEGER] * 9:
        return first == b"\x00" and all(content for _, content in parts)
    if tags[:2] == [INTEGER, OCTETS]:
        return first == b"\x01" and len(parts[1][1]) >= 16
    return tags == [SEQUENCE, OCTETS] and _algorithm(parts[0][1]) and len(parts[1][1]) >= 16


def _openssh(data: bytes) -> bool:
    """Cipher, derivation, its options, one key, public and private part, by their lengths."""
    at, strings = 0, []
    for field in range(6):
        if at + 4 > len(data):
            return False
        length, at = int.from_bytes(data[at : at + 4], "big"), at + 4
        if field == 3:
            if length != 1:
                return False
            continue
        if at + length > len(data):
            return False
        strings.append(data[at : at + length])
        at += length
    return len(strings[0]) >= 4 and len(strings[3]) >= 16 and len(strings[4]) >= 16


def _encrypted(header: str, body: bytes) -> bool:
    cipher = CIPHER.search(header)
    return cipher is not None and len(body) % (len(cipher[1]) // 2) == 0


def from_base64(text: str) -> bytes | None:
    plain = text.rstrip("=").replace("-", "+").replace("_", "/")
    try:
        return base64.b64decode(plain + "=" * (-len(plain) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def _json_object(part: str) -> dict:
    try:
        found = json.loads((from_base64(part) or b"").decode())
    except (UnicodeDecodeError, ValueError, RecursionError):
        return {}
    return found if isinstance(found, dict) else {}


def confirmed(text: str) -> Iterator[tuple[str, int, int]]:
    """Spans whose decoded bytes have the structure of a key or a signed token."""
    if "-----BEGIN" in text:
        for match in PEM.finditer(text):
            body = from_base64(PEM_BREAK.sub("", match[3]))
            if body and (_encrypted(match[2], body) if ENCRYPTED.search(match[2]) else is_private_key(body)):
                yield "pem", *match.span()
    for match in LONG_BASE64.finditer(text):
        body = from_base64(match[0])
        if body and is_private_key(body):
            yield "key", *match.span()
    for match in LONG_HEX.finditer(text):
        if len(match[0]) % 2 == 0 and is_private_key(bytes.fromhex(match[0])):
            yield "key", *match.span()
    if "eyJ" in text or "ewo" in text or "eyA" in text:  # how an encoded JSON object begins
        for match in SIGNED.finditer(text):
            if isinstance(_json_object(match[1]).get("alg"), str) and _json_object(match[2]):
                yield "jwt", *match.span()


def base(text: str, longest_word: int) -> Iterator[tuple[str, int, int]]:
    """Spans of the three patterns; a match that is too short is dropped, not looked into.

    Two of them cannot be longer than the longest word.
    """
    lower = text.lower()
    if any(name in lower for name in ASSIGN_NAMES):
        for match in ASSIGN.finditer(text):
            if len(match[1]) >= ASSIGN_VALUE:
                yield "assign", *match.span()
    if longest_word >= ACCESS_LENGTH and "AKIA" in text:
        for match in ACCESS.finditer(text):
            if len(match[0]) >= ACCESS_LENGTH:
                yield "access", *match.span()
    if longest_word >= HEX_LENGTH:
        for match in HEX.finditer(text):
            if len(match[0]) >= HEX_LENGTH:
                yield "hex", *match.span()


def spans_of(text: str) -> list[tuple[str, int, int]]:
    longest_word = max(map(len, text.split()), default=0)
    found = list(base(text, longest_word))
    # PEM bodies may be cut into short lines; all else is one word.
    if longest_word >= 20 or "-----BEGIN" in text:
        found += confirmed(text)
    return sorted(set(found), key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def _find(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for texts in batches:
        rows = [[{"kind": k, "start": a, "end": b} for k, a, b in spans_of(text)] for text in texts]
        yield pd.Series(rows, dtype=object)


def spans(text: Column) -> Column:
    """All spans of ``text`` as an array of ``(kind, start, end)``."""
    return F.pandas_udf(_find, SPANS)(F.coalesce(text, F.lit("")))


def count(found: Column, kind: str) -> Column:
    return F.size(F.filter(found, lambda s: s["kind"] == kind)).cast("long")


def listed(found: Column, kinds: list[str] = KINDS) -> Column:
    """``kind:start:end`` of the spans of ``kinds``, comma-joined."""
    some = F.filter(found, lambda s: s["kind"].isin(kinds))
    each = F.transform(some, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string")))
    return F.array_join(each, ",")
