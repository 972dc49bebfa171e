"""Ed25519 verification as RFC 8032 states it, for signature columns."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from hashlib import sha512

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

P = 2**255 - 19
ORDER = 2**252 + 27742317777372353535851937790883648493
D = -121665 * pow(121666, P - 2, P) % P

Point = tuple[int, int, int, int]


def _add(a: Point, b: Point) -> Point:
    e, f = (a[1] - a[0]) * (b[1] - b[0]) % P, (a[1] + a[0]) * (b[1] + b[0]) % P
    g, h = 2 * a[3] * b[3] * D % P, 2 * a[2] * b[2] % P
    w, x, y, z = f - e, h - g, h + g, f + e
    return w * x % P, y * z % P, x * y % P, w * z % P


def _times(k: int, a: Point) -> Point:
    out = (0, 1, 1, 0)
    while k:
        out = _add(out, a) if k & 1 else out
        a = _add(a, a)
        k >>= 1
    return out


def _same(a: Point, b: Point) -> bool:
    return (a[0] * b[2] - b[0] * a[2]) % P == 0 and (a[1] * b[2] - b[1] * a[2]) % P == 0


@lru_cache(maxsize=4096)
def _point(data: bytes) -> Point | None:
    y, odd = int.from_bytes(data, "little") & (1 << 255) - 1, data[31] >> 7
    if y >= P:
        return None
    square = (y * y - 1) * pow(D * y * y + 1, P - 2, P) % P
    x = pow(square, (P + 3) // 8, P)
    if (x * x - square) % P:
        x = x * pow(2, (P - 1) // 4, P) % P
    if (x * x - square) % P or x == 0 and odd:
        return None
    x = P - x if x & 1 != odd else x
    return x, y, 1, x * y % P


BASE = _point((4 * pow(5, P - 2, P) % P).to_bytes(32, "little"))


def verify(key: bytes | None, message: bytes | None, signature: bytes | None) -> bool:
    """Whether a signature over a message is a key's; anything malformed is not."""
    if key is None or message is None or signature is None or len(key) != 32 or len(signature) != 64:
        return False
    a, r, s = _point(key), _point(signature[:32]), int.from_bytes(signature[32:], "little")
    if a is None or r is None or s >= ORDER:
        return False
    h = int.from_bytes(sha512(signature[:32] + key + message).digest(), "little") % ORDER
    return _same(_times(s, BASE), _add(r, _times(h, a)))


@F.arrow_udf(T.BooleanType())
def _verified(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    for batch in batches:
        yield pa.array([verify(*row) for row in zip(*(x.to_pylist() for x in batch), strict=True)], pa.bool_())


def verified(key: Column, message: Column, signature: Column) -> Column:
    return _verified(key, message, signature)
