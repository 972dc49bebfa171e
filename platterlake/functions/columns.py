"""Scalar functions of the wire formats, as column expressions."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Crockford's base 32, in order of value.
CROCKFORD = "0123456789ABCDEFGHJKMNPQRSTVWXYZ"


def u16be(data: Column, offset: Column | int) -> Column:
    """Big-endian u16 at a byte offset; null where the bytes do not reach."""
    return _unsigned(data, offset, 2)


def u32be(data: Column, offset: Column | int) -> Column:
    """Big-endian u32 at a byte offset; null where the bytes do not reach."""
    return _unsigned(data, offset, 4)


def _unsigned(data: Column, offset: Column | int, width: int) -> Column:
    at = (F.lit(offset) if isinstance(offset, int) else offset) + 1
    part = F.substring(data, at.cast("int"), F.lit(width))
    return F.when(F.octet_length(part) == width, F.conv(F.hex(part), 16, 10).cast("bigint"))


def round_half_up(x: Column) -> Column:
    """floor(x + 0.5): the rounding of pixels, unlike SQL's for negatives."""
    return F.floor(x + 0.5)


def isrc(text: Column) -> Column:
    """Twelve characters without separators, or null: two letters, three letters or digits, seven digits."""
    bare = F.upper(F.regexp_replace(text, r"[\s-]", ""))
    return F.when(F.regexp_like(bare, F.lit("^[A-Z]{2}[A-Z0-9]{3}[0-9]{7}$")), bare)


def check_digit(digits: Column) -> Column:
    """Weighted sum by 3 and 1 from the right, as what completes it to tens."""
    values = F.transform(F.filter(F.split(F.reverse(digits), ""), lambda d: d != ""), lambda d, i: d.cast("int") * F.when(i % 2 == 0, 3).otherwise(1))
    return F.pmod(F.lit(10) - F.aggregate(values, F.lit(0), lambda s, x: s + x) % 10, F.lit(10))


def upc(text: Column) -> Column:
    """12 to 14 digits whose last is their check digit, without separators; or null."""
    bare = F.regexp_replace(text, r"[\s-]", "")
    good = F.regexp_like(bare, F.lit("^[0-9]{12,14}$"))
    body = F.when(good, F.substring(bare, F.lit(1), F.length(bare) - 1))
    return F.when(good & (check_digit(body) == F.substring(bare, -1, 1).try_cast("int")), bare)


def ulid_millis(text: Column) -> Column:
    """Milliseconds since the epoch of a ULID's first ten symbols, or null."""
    upper = F.upper(text)
    good = F.regexp_like(upper, F.lit(f"^[0-7][{CROCKFORD}]{{25}}$"))
    symbols = F.filter(F.split(F.substring(upper, 1, 10), ""), lambda c: c != "")
    value = F.aggregate(symbols, F.lit(0).cast("bigint"), lambda s, c: s * 32 + F.instr(F.lit(CROCKFORD), c) - 1)
    return F.when(good, value)


def equal_area_radius(fraction: Column, inner: Column, outer: Column) -> Column:
    """Normalised radius, 0 at the outer edge, of a share of an annulus's area."""
    f = F.least(F.greatest(fraction, F.lit(0.0)), F.lit(1.0))
    radius = F.sqrt(F.greatest(outer * outer - f * (outer * outer - inner * inner), F.lit(0.0)))
    return F.when(outer > inner, F.least(F.greatest((outer - radius) / (outer - inner), F.lit(0.0)), F.lit(1.0))).otherwise(f)


def revolution_digest(domain: bytes, release_id: Column, index: Column, entry_sha256: Column) -> Column:
    """SHA-256 over domain, release id, index (u32be) and an entry's digest; all binary."""
    return F.unhex(F.sha2(F.concat(F.lit(domain), release_id, F.unhex(F.lpad(F.hex(index.cast("bigint")), 8, "0")), entry_sha256), 256))


def release_digest(domain: bytes, release_id: Column, profile_code: Column, encoding_code: Column, stream_sha256: Column, revolutions: Column, descriptor_sha256: Column | None = None) -> Column:
    """SHA-256 over a release's parts and its ordered revolution digests (array<binary>)."""
    count = F.unhex(F.lpad(F.hex(F.size(revolutions).cast("bigint")), 8, "0"))
    joined = F.unhex(F.array_join(F.transform(revolutions, lambda r: F.hex(r)), ""))
    code = lambda c: F.unhex(F.lpad(F.hex(c.cast("bigint")), 2, "0"))
    parts = [F.lit(domain), release_id, code(profile_code), code(encoding_code), stream_sha256]
    return F.unhex(F.sha2(F.concat(*parts, *([] if descriptor_sha256 is None else [descriptor_sha256]), count, joined), 256))


def unsigned(value: Column, width: int) -> Column:
    """Big-endian bytes of a number that fits in so many."""
    return F.unhex(F.lpad(F.hex(value.cast("bigint")), 2 * width, "0"))


def varuint(value: Column) -> Column:
    """Canonical LEB128 of a number from 0 to 2**63 - 1; null of a null."""
    v = value.cast("bigint")
    size = F.greatest(F.ceil(F.length(F.bin(v)) / 7), F.lit(1)).cast("int")
    byte = lambda i: F.shiftrightunsigned(v, 7 * i).bitwiseAND(F.lit(127)) if isinstance(i, int) else F.call_function("shiftrightunsigned", v, 7 * i).bitwiseAND(F.lit(127))
    each = F.transform(F.sequence(F.lit(0), size - 1), lambda i: F.lpad(F.hex(byte(i) + F.when(i < size - 1, 128).otherwise(0)), 2, "0"))
    return F.when(v.isNotNull(), F.unhex(F.array_join(each, "")))


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)``, with the value worked out once however often it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


def varuint_at(data: Column, offset: Column | int = 0) -> Column:
    """struct<value, next> of canonical LEB128 at a byte offset; null if it is cut off, overlong or beyond 63 bits."""
    at = F.lit(offset) if isinstance(offset, int) else offset

    def read(codes: Column) -> Column:
        last = F.array_position(F.transform(codes, lambda c: F.coalesce(c < 128, F.lit(False))), F.lit(True)).cast("int")
        return let(last, lambda n: counted(codes, n))

    def counted(codes: Column, n: Column) -> Column:
        value = F.aggregate(F.reverse(F.slice(codes, 1, F.greatest(n, F.lit(1)))), F.lit(0).cast("bigint"), lambda s, c: F.shiftleft(s, 7).bitwiseOR(c.bitwiseAND(F.lit(127))))
        good = (n > 0) & ((n == 1) | (F.try_element_at(codes, n) > 0))
        return F.when(good, F.struct(value.alias("value"), (at + n).cast("bigint").alias("next")))

    # nine bytes at most, as hexadecimal digits, cut out once
    digits = F.hex(F.substring(data, (at + 1).cast("int"), F.lit(9)))
    code = lambda d, i: F.conv(F.nullif(F.substring(d, 2 * i + 1, F.lit(2)), F.lit("")), 16, 10).cast("bigint")
    return let(let(digits, lambda d: F.transform(F.sequence(F.lit(0), F.lit(8)), lambda i: code(d, i))), read)


def wire_text(text: Column) -> Column:
    """UTF-8 after its length as a u16."""
    data = F.encode(text, "UTF-8")
    return F.concat(unsigned(F.octet_length(data), 2), data)


def _symbols(value: Column, n: int) -> Column:
    """The low 5 n bits of a number in Crockford's base 32."""
    return F.concat(*(F.substring(F.lit(CROCKFORD), (F.shiftright(value, 5 * i).bitwiseAND(F.lit(31)) + 1).cast("int"), F.lit(1)) for i in range(n - 1, -1, -1)))


def typed_id(prefix: str, millis: Column, entropy: Column) -> Column:
    """A prefixed identifier from a time (48 bits) and ten bytes."""
    half = lambda i: F.conv(F.hex(F.substring(entropy, i, 5)), 16, 10).cast("bigint")
    return F.when(F.octet_length(entropy) == 10, F.concat(F.lit(f"{prefix}_"), _symbols(millis.bitwiseAND(F.lit(2**48 - 1)), 10), _symbols(half(1), 8), _symbols(half(6), 8)))


def code_slug(code: Column) -> Column:
    """A catalogue code of eleven symbols as five, five and one, in lower case."""
    return F.lower(F.concat_ws("-", F.substring(code, 1, 5), F.substring(code, 6, 5), F.substring(code, 11, 1)))


def code_label(code: Column, prefix: str, separator: str) -> Column:
    """A catalogue code as it is printed."""
    return F.concat(F.lit(f"{prefix} "), F.concat_ws(separator, F.substring(code, 1, 5), F.substring(code, 6, 5), F.substring(code, 11, 1)))


#: Rec. 709 weights and chroma scales.
LUMA, CHROMA = (0.2126, 0.7152, 0.0722), (1.8556, 1.5748)


def luma(r: Column, g: Column, b: Column) -> Column:
    return LUMA[0] * r + LUMA[1] * g + LUMA[2] * b


def chroma(r: Column, g: Column, b: Column) -> Column:
    """struct<blue, red>: how far a colour is from grey."""
    y = luma(r, g, b)
    return F.struct(((b - y) / CHROMA[0]).alias("blue"), ((r - y) / CHROMA[1]).alias("red"))


def pixel_angle(x: Column, y: Column, centre: Column) -> Column:
    """Clockwise angle of a pixel from twelve o'clock, 0 to 2 pi."""
    return F.pmod(F.lit(math.pi / 2) - F.atan2(centre - y, x - centre), F.lit(2 * math.pi))


def pixel_radius(x: Column, y: Column, centre: Column) -> Column:
    """Distance of a pixel from the centre as a share of half the side."""
    return F.hypot(x - centre, centre - y) / centre


def _times(z: Column, by: int) -> Column:
    """Product of two 64-bit numbers modulo 2**64, as a signed one; halves keep decimals from overflowing."""
    c, word = F.lit(str(by)).cast("decimal(20,0)"), F.lit(2**32).cast("decimal(10,0)")
    wide = lambda x: x.cast("decimal(10,0)")
    low, high = wide(z.bitwiseAND(F.lit(2**32 - 1))), wide(F.shiftrightunsigned(z, 32))
    two64 = F.lit(str(2**64)).cast("decimal(20,0)")
    upper = ((high * c) % word).cast("decimal(10,0)")
    lower = ((low * c) % two64).cast("decimal(20,0)")
    whole = ((upper * word).cast("decimal(20,0)") + lower) % two64
    return F.when(whole >= F.lit(str(2**63)).cast("decimal(20,0)"), whole - two64).otherwise(whole).cast("bigint")


def splitmix64(state: Column) -> Column:
    """The draw of the seeded generator that follows from an advanced state; see ``advanced``."""
    z = _times(state.bitwiseXOR(F.shiftrightunsigned(state, 30)), 0xBF58476D1CE4E5B9)
    z = _times(z.bitwiseXOR(F.shiftrightunsigned(z, 27)), 0x94D049BB133111EB)
    return z.bitwiseXOR(F.shiftrightunsigned(z, 31))


def advanced(seed: Column, steps: int) -> Column:
    """The generator's state after so many steps, modulo 2**64."""
    two64 = F.lit(str(2**64)).cast("decimal(20,0)")
    whole = (seed.cast("decimal(20,0)") + F.lit(str(0x9E3779B97F4A7C15 * steps % 2**64)).cast("decimal(20,0)") + two64) % two64
    return F.when(whole >= F.lit(str(2**63)).cast("decimal(20,0)"), whole - two64).otherwise(whole).cast("bigint")


def unit(draw: Column) -> Column:
    """A draw as a number from 0 to 1, by its upper 53 bits."""
    return F.shiftrightunsigned(draw, 11).cast("double") / 2.0**53


def chunk_aad(domain: bytes, metadata: Column) -> Column:
    """Associated data of a stream's encrypted chunks."""
    return F.concat(F.lit(domain), unsigned(F.octet_length(metadata), 4), metadata)


def sampled(n: Column, samples: Column) -> Column:
    """So many evenly spaced numbers from 0 to below ``n``: all of them if they fit, the first alone for one sample or none."""
    last = F.greatest(samples - 1, F.lit(1))
    spaced = F.transform(F.sequence(F.lit(0), last), lambda k: F.floor(k.cast("bigint") * (n - 1) / last).cast("bigint"))
    few = F.slice(F.sequence(F.lit(0).cast("bigint"), F.greatest(n, F.lit(1)).cast("bigint")), 1, F.greatest(n, F.lit(0)).cast("int"))
    return F.when(n <= samples, few).when(samples <= 1, F.array(F.lit(0).cast("bigint"))).otherwise(spaced)
