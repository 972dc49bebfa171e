"""Typed identifiers and catalogue codes."""

from __future__ import annotations

from hashlib import sha256

from pyspark.sql import Column
from pyspark.sql import functions as F

from .columns import CROCKFORD
from .wire import WireError

#: Prefixes of public identifiers, and those that only services use.
KINDS = {"rel": "release", "edn": "edition", "ast": "asset", "trk": "track", "rev": "revolution", "rcp": "receipt", "rgt": "rights", "bsc": "sidecar", "att": "attestation", "aut": "authorization"}
SERVICE_KINDS = {"key": "key", "usr": "user", "job": "job", "upl": "upload", "ses": "session"}
#: Seed of a catalogue code's check symbol.
CODE_SYMBOLS, CODE_SEED = 10, 0x15


def kind(text: Column, service: bool = False) -> Column:
    """The kind of a prefixed identifier, or null if it is not well formed."""
    known = KINDS | (SERVICE_KINDS if service else {})
    good = F.regexp_like(text, F.lit(f"^[a-z]{{3}}_[0-7][{CROCKFORD}]{{25}}$"))
    named = F.element_at(F.create_map(*(F.lit(x) for pair in known.items() for x in pair)), F.substring(text, 1, 3))
    return F.when(good, named)


def to_bytes(text: str) -> bytes:
    """The sixteen bytes of a prefixed identifier."""
    prefix, _, ulid = text.partition("_")
    if prefix not in KINDS | SERVICE_KINDS or len(ulid) != 26 or ulid[0] > "7" or any(c not in CROCKFORD for c in ulid):
        raise WireError("identifier is malformed")
    value = 0
    for c in ulid:
        value = value << 5 | CROCKFORD.index(c)
    return value.to_bytes(16, "big")


def from_bytes(data: bytes, prefix: str = "rel") -> str:
    """The prefixed identifier of sixteen bytes."""
    value = int.from_bytes(data, "big")
    return f"{prefix}_" + "".join(CROCKFORD[value >> 5 * k & 31] for k in range(25, -1, -1))


def check_symbol(values: list[int], weights: tuple[int, ...]) -> int:
    """Weighted check of a code's symbols, modulo 32."""
    return (CODE_SEED + sum((v + 1) * w for v, w in zip(values, weights, strict=True))) % 32


def catalogue_code(release_id: bytes, domain: bytes, weights: tuple[int, ...]) -> str:
    """Eleven symbols of a release: fifty bits of a hash under a domain, and their check."""
    bits = int.from_bytes(sha256(domain + release_id).digest(), "big") >> 256 - 5 * CODE_SYMBOLS
    values = [bits >> 5 * k & 31 for k in range(CODE_SYMBOLS - 1, -1, -1)]
    return "".join(CROCKFORD[v] for v in [*values, check_symbol(values, weights)])


def read_code(text: str, weights: tuple[int, ...], prefix: str = "") -> str:
    """A catalogue code as written by people: separators, lower case and look-alikes allowed."""
    bare = text.strip().upper()
    if prefix and bare.startswith(prefix.upper()) and (len(bare) == len(prefix) or bare[len(prefix)] in "- .·_"):
        bare = bare[len(prefix) :]
    symbols = ["0" if c == "O" else "1" if c in "IL" else c for c in bare if c not in "- .·_"]
    if len(symbols) != CODE_SYMBOLS + 1 or any(c not in CROCKFORD for c in symbols):
        raise WireError("catalogue code is malformed")
    values = [CROCKFORD.index(c) for c in symbols]
    if check_symbol(values[:-1], weights) != values[-1]:
        raise WireError("catalogue code has a wrong check symbol")
    return "".join(symbols)


def slug(code: str) -> str:
    return f"{code[:5]}-{code[5:10]}-{code[10]}".lower()
