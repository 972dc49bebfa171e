"""Reading of wire scalars from bytes, for the parsers that run in Arrow batches."""

from __future__ import annotations

import unicodedata

U64 = 1 << 64


class WireError(ValueError):
    """What is wrong with some bytes; it becomes the error of their row."""


class Cursor:
    """Reads forward over bytes and names what it could not read."""

    __slots__ = ("at", "data")

    def __init__(self, data: bytes, at: int = 0):
        self.data, self.at = data, at

    @property
    def left(self) -> int:
        return len(self.data) - self.at

    def take(self, n: int, what: str) -> bytes:
        if n > self.left:
            raise WireError(f"{what} is truncated")
        self.at += n
        return self.data[self.at - n : self.at]

    def uint(self, width: int, what: str) -> int:
        return int.from_bytes(self.take(width, what), "big")

    def varuint(self, what: str) -> int:
        value, self.at = read_varuint(self.data, self.at, what)
        return value

    def text(self, what: str) -> str:
        return plain_text(self.take(self.uint(2, f"{what} length"), what), what, empty=False)

    def end(self, what: str) -> None:
        if self.left:
            raise WireError(f"{what} has {self.left} trailing bytes")


def read_varuint(data: bytes, at: int, what: str) -> tuple[int, int]:
    """A canonical LEB128 number below 2**64 and the offset after it."""
    value = 0
    for k in range(10):
        if at + k >= len(data):
            raise WireError(f"{what} is truncated")
        byte = data[at + k]
        value |= (byte & 0x7F) << 7 * k
        if value >= U64:
            raise WireError(f"{what} exceeds 64 bits")
        if byte < 0x80:
            if k and byte == 0:
                raise WireError(f"{what} is overlong")
            return value, at + k + 1
    raise WireError(f"{what} is longer than ten bytes")


def write_varuint(value: int) -> bytes:
    out = bytearray()
    while value > 0x7F:
        out.append(value & 0x7F | 0x80)
        value >>= 7
    out.append(value)
    return bytes(out)


def plain_text(data: bytes, what: str, empty: bool = True) -> str:
    """UTF-8 without control characters."""
    try:
        text = data.decode("utf-8")
    except UnicodeDecodeError as e:
        raise WireError(f"{what} is not UTF-8") from e
    if not text and not empty:
        raise WireError(f"{what} is empty")
    if any(unicodedata.category(c) == "Cc" for c in text):
        raise WireError(f"{what} has control characters")
    return text


def quiet_filler(seed: int, n: int) -> bytes:
    """The filler of a gap: xorshift32 over a mid grey of 128, six either way."""
    state, out = seed or 0x9E3779B9, bytearray(n)
    for k in range(n):
        state ^= state << 13 & 0xFFFFFFFF
        state ^= state >> 17
        state ^= state << 5 & 0xFFFFFFFF
        out[k] = 128 + state % 13 - 6
    return bytes(out)
