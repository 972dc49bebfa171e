"""Record descriptors: a fixed prefix and typed segments, as one row and a child table."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import columns, signatures, wheel
from ..functions.wire import Cursor, WireError, plain_text
from .streams import child, parsed

MAGIC, PREFIX, VERSIONS = b"BRD1", 29, (4, 5)
NEWEST_LEAD_OUT = 4
#: Names by wire code.
PROFILES = {0: "single45", 1: "lp", 2: "ten", 3: "single45vintage"}
ENCODINGS = {0: "rgb", 1: "toned-v1", 2: "toned-v2"}
#: The segment that holds a secret; its bytes never leave the parser.
SECRET = 23

_SIGNATURE = [("version", pa.int32()), ("commitment", pa.binary()), ("key_id", pa.binary()), ("signature", pa.binary()), ("role", pa.string())]
_ISRC = [("track_index", pa.int32()), ("code", pa.string())]
_SEGMENT = [("ord", pa.int32()), ("type", pa.int32()), ("len", pa.int32()), ("payload", pa.binary())]
_LISTS = {"isrcs": _ISRC, "signatures": _SIGNATURE, "segments": _SEGMENT}
_SCALARS = [("version", pa.int32()), ("b_value", pa.float64()), ("b_value_bits", pa.binary()), ("cut_inner_radius", pa.int32()), ("silent_groove_b_value", pa.float64()), ("stream_byte_length", pa.int64()), ("record_profile", pa.string()), ("payload_encoding", pa.string()), ("title", pa.string()), ("artist", pa.string()), ("release_id", pa.binary()), ("catalog_number", pa.string()), ("label", pa.string()), ("artwork_credit", pa.string()), ("canonical_url", pa.string()), ("created_at", pa.int64()), ("copyright_year", pa.int32()), ("copyright_holder", pa.string()), ("upc", pa.string()), ("clockwise", pa.bool_()), ("lead_out_revision", pa.int32())]
ARROW = pa.schema([("path", pa.string()), ("stream_len", pa.int64()), *_SCALARS, *((k, pa.list_(pa.struct(v))) for k, v in _LISTS.items()), ("error", pa.string())])
_SQL = {pa.int32(): "int", pa.int64(): "bigint", pa.string(): "string", pa.binary(): "binary", pa.bool_(): "boolean", pa.float64(): "double"}
SCHEMA = ", ".join(["path string", "stream_len bigint", *(f"{n} {_SQL[t]}" for n, t in _SCALARS), *(f"{k} array<struct<{', '.join(f'{n}: {_SQL[t]}' for n, t in v)}>>" for k, v in _LISTS.items()), "error string"])


def _uint(width: int) -> Callable[[bytes, str], int]:
    def read(data: bytes, what: str) -> int:
        if len(data) != width:
            raise WireError(f"{what} segment has {len(data)} bytes, not {width}")
        return int.from_bytes(data, "big")

    return read


def _named(names: dict[int, str]) -> Callable[[bytes, str], str]:
    def read(data: bytes, what: str) -> str:
        if (code := _uint(1)(data, what)) not in names:
            raise WireError(f"{what} {code} is unknown")
        return names[code]

    return read


def _sized(n: int) -> Callable[[bytes, str], bytes]:
    def read(data: bytes, what: str) -> bytes:
        if len(data) != n:
            raise WireError(f"{what} segment has {len(data)} bytes, not {n}")
        return data

    return read


def _positive(data: bytes, what: str) -> int:
    if not (value := _uint(4)(data, what)):
        raise WireError(f"{what} is zero")
    return value


def barcode(data: bytes, what: str) -> str:
    """12 to 14 digits with a right check digit."""
    digits = plain_text(data, what).replace("-", "").replace(" ", "")
    if not (digits.isascii() and digits.isdigit() and 12 <= len(digits) <= 14):
        raise WireError(f"{what} is not 12 to 14 digits")
    if sum(int(d) * (3 if k % 2 else 1) for k, d in enumerate(reversed(digits))) % 10:
        raise WireError(f"{what} has a wrong check digit")
    return digits


def _lead_out(data: bytes, what: str) -> int:
    if len(data) != 1 and len(data) < 4:
        raise WireError(f"{what} segment has {len(data)} bytes")
    if data[0] > NEWEST_LEAD_OUT:
        raise WireError(f"{what} revision {data[0]} is newer than {NEWEST_LEAD_OUT}")
    return data[0]


#: Column and reader of the segments that become columns, by type.
FIELDS: dict[int, tuple[str, Callable]] = {
    2: ("stream_byte_length", _positive),
    4: ("record_profile", _named(PROFILES)),
    5: ("title", plain_text),
    6: ("artist", plain_text),
    7: ("payload_encoding", _named(ENCODINGS)),
    8: ("release_id", _sized(16)),
    9: ("catalog_number", plain_text),
    10: ("label", plain_text),
    11: ("artwork_credit", plain_text),
    13: ("canonical_url", plain_text),
    14: ("created_at", _uint(8)),
    24: ("copyright_year", _uint(2)),
    25: ("copyright_holder", plain_text),
    28: ("upc", barcode),
    34: ("clockwise", lambda d, w: bool(_uint(1)(d, w))),
    35: ("lead_out_revision", _lead_out),
}
CRC, SIGNED, ISRCS, ATTESTED, MORE_SIGNED, ANCHOR, SPANS, WHEEL = 1, 16, 27, 29, 31, 26, 22, 32


def signature(data: bytes, role: str) -> dict:
    """One signature envelope."""
    c = Cursor(data)
    version = c.uint(1, "signature version")
    if version != 2:
        raise WireError(f"signature version {version} is unknown")
    out = {"version": version, "commitment": c.take(32, "commitment"), "key_id": c.take(c.uint(2, "key id length"), "key id"), "signature": c.take(64, "signature"), "role": role}
    c.end("signature")
    return out


def isrc_list(data: bytes) -> list[dict]:
    """Track codes in strictly ascending order of their tracks."""
    c = Cursor(data)
    n, out = c.uint(2, "ISRC count"), []
    for _ in range(n):
        track = c.uint(2, "ISRC track")
        code = plain_text(c.take(12, "ISRC"), "ISRC").upper()
        if not (code[:2].isalpha() and code[2:5].isalnum() and code[5:].isdigit() and code.isascii()):
            raise WireError(f"ISRC {code} is malformed")
        if out and track <= out[-1]["track_index"]:
            raise WireError("ISRCs are not in ascending track order")
        out.append({"track_index": track, "code": code})
    c.end("ISRC list")
    return out


def _more_signatures(data: bytes) -> list[dict]:
    c = Cursor(data)
    n = c.uint(2, "signature count")
    out = [signature(c.take(c.uint(2, "signature length"), "signature"), "additional") for _ in range(n)]
    c.end("signature list")
    if not out:
        raise WireError("signature list is empty")
    return out


def parse(data: bytes) -> dict:
    """A whole descriptor; unknown segments are kept in ``segments`` and otherwise passed over."""
    c = Cursor(data)
    if c.take(4, "descriptor magic") != MAGIC:
        raise WireError("descriptor magic is invalid")
    version, total, count, body = c.uint(1, "version"), c.uint(2, "length"), c.uint(2, "segment count"), c.uint(2, "segment bytes")
    bits, inner, silent = c.take(8, "pitch"), c.uint(2, "inner radius"), c.take(8, "silent pitch")
    if version not in VERSIONS:
        raise WireError(f"descriptor version {version} is unknown")
    if total != PREFIX + body or total > len(data):
        raise WireError("descriptor length is invalid")
    pitch = struct.unpack(">d", bits)[0]
    out: dict = {"version": version, "b_value": pitch, "b_value_bits": bits, "cut_inner_radius": inner, "silent_groove_b_value": struct.unpack(">d", silent)[0], "isrcs": [], "signatures": [], "segments": [], "clockwise": False, "lead_out_revision": 0}
    c = Cursor(data[:total], PREFIX)
    seen: dict[int, tuple[int, bytes]] = {}
    while c.left:
        kind, length = c.uint(1, "segment type"), c.uint(2, "segment length")
        at, payload = c.at, c.take(length, f"segment {kind}")
        out["segments"].append({"ord": len(out["segments"]), "type": kind, "len": length, "payload": None if kind == SECRET else payload})
        known = kind in FIELDS or kind in (CRC, SIGNED, ISRCS, ATTESTED, MORE_SIGNED, ANCHOR, SPANS, WHEEL, 21, SECRET, 30, 33)
        if known and kind in seen:
            raise WireError(f"segment {kind} is repeated")
        seen[kind] = (at, payload)
        if kind in FIELDS:
            name, read = FIELDS[kind]
            value = read(payload, name)
            out[name] = None if value == "" else value
    if len(out["segments"]) != count:
        raise WireError("segment count is wrong")
    _crc(data[:total], seen)
    if not 0 < pitch < float("inf"):
        raise WireError("pitch is not a positive number")
    for name in ("record_profile", "stream_byte_length", "payload_encoding"):
        if out.get(name) is None:
            raise WireError(f"{name} is missing")
    if (SPANS in seen) != (out["payload_encoding"] == "toned-v1") or (WHEEL in seen) != (out["payload_encoding"] == "toned-v2"):
        raise WireError("tone segments do not fit the payload encoding")
    if WHEEL in seen:
        wheel.read(seen[WHEEL][1], out["stream_byte_length"])
    _signed(out, seen)
    return out


def _crc(data: bytes, seen: dict[int, tuple[int, bytes]]) -> None:
    """The CRC covers everything, with its own four bytes as zeros."""
    at, stored = seen.get(CRC, (0, b""))
    if len(stored) != 4:
        raise WireError("descriptor CRC is missing or has a wrong length")
    if zlib.crc32(data[:at] + bytes(4) + data[at + 4 :]) != int.from_bytes(stored, "big"):
        raise WireError("descriptor CRC is wrong")


def _signed(out: dict, seen: dict[int, tuple[int, bytes]]) -> None:
    part = lambda k: seen[k][1]
    if ISRCS in seen:
        out["isrcs"] = isrc_list(part(ISRCS))
    if SIGNED in seen:
        out["signatures"].append(signature(part(SIGNED), "release"))
    if MORE_SIGNED in seen:
        out["signatures"] += _more_signatures(part(MORE_SIGNED))
    if len({s["commitment"] for s in out["signatures"]}) > 1 or len({s["key_id"] for s in out["signatures"]}) < len(out["signatures"]):
        raise WireError("signatures differ in commitment or repeat a key")
    deferred = ANCHOR in seen or bool(out["isrcs"]) or out.get("upc") is not None
    if deferred != (ATTESTED in seen):
        raise WireError("deferred fields and their attestation do not go together")
    if ATTESTED in seen:
        out["signatures"].append(signature(part(ATTESTED), "deferred"))


def descriptors(files: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """One row a file: the descriptor's columns, lists of structs, and an error."""
    return parsed(files, parse, path, content, ARROW, SCHEMA)


def _segment(kind: int) -> Column:
    return F.try_element_at(F.filter("segments", lambda s: s["type"] == kind), F.lit(1))["payload"]


def _tagged(tag: int, value: Column) -> Column:
    """A tag, a u32 length and the bytes; null is written as none."""
    data = F.coalesce(value, F.unhex(F.lit("")))
    return F.concat(columns.unsigned(F.lit(tag), 1), columns.unsigned(F.octet_length(data), 4), data)


def identity(domain: bytes) -> Column:
    """The canonical bytes a release signature covers, of a parsed descriptor under a domain.

    Null for descriptors with tone spans, a cache key or a varied pitch, whose
    parts the parser does not keep in canonical form.
    """
    text = lambda tag, name: _tagged(tag, F.encode(F.col(name), "UTF-8"))
    named = ((3, "title"), (4, "artist")), ((6, "catalog_number"), (7, "label"), (8, "artwork_credit"), (9, "canonical_url"))
    parts = [
        F.lit(domain),
        columns.unsigned(F.col("version"), 1),
        columns.unsigned(F.lit(1), 1),
        F.col("b_value_bits"),
        text(1, "record_profile"),
        columns.unsigned(F.col("stream_byte_length"), 8),
        text(2, "payload_encoding"),
        *(text(t, n) for t, n in named[0]),
        _tagged(5, F.col("release_id")),
        *(text(t, n) for t, n in named[1]),
        _tagged(10, columns.unsigned(F.col("created_at"), 8)),
        _tagged(11, _segment(21)),
        _tagged(12, F.lit(None).cast("binary")),
        _tagged(13, columns.unsigned(F.col("copyright_year"), 2)),
        text(14, "copyright_holder"),
        _tagged(15, F.lit(None).cast("binary")),
        F.when(_segment(WHEEL).isNotNull(), _tagged(17, _segment(WHEEL))).otherwise(F.unhex(F.lit(""))),
    ]
    plain = F.col("error").isNull() & ~F.exists("segments", lambda s: s["type"].isin(SPANS, SECRET, 30))
    return F.when(plain, F.concat(*parts))


def deferred_identity(domain: bytes, release_domain: bytes) -> Column:
    """The canonical bytes a deferred attestation covers: the release identity's digest, anchor, track codes and barcode."""
    codes = F.transform("isrcs", lambda i: F.concat(columns.unsigned(i["track_index"], 2), F.encode(i["code"], "UTF-8")))
    listed = F.concat(columns.unsigned(F.size("isrcs"), 2), F.unhex(F.array_join(F.transform(codes, lambda b: F.hex(b)), "")))
    return F.concat(F.lit(domain), F.unhex(F.sha2(identity(release_domain), 256)), _tagged(1, _segment(ANCHOR)), _tagged(2, listed), _tagged(3, F.encode("upc", "UTF-8")))


def differing(a: Column, b: Column) -> Column:
    """Name of the first field in which two payload descriptors differ, or null."""
    fields = ("container", "codec", "sample_rate", "channels", "block_samples", "output_offset_samples", "output_samples", "codec_metadata")
    return F.coalesce(*(F.when(~a[f].eqNullSafe(b[f]), F.lit(f)) for f in fields))


def silent_extent(payload: Column) -> Column:
    """struct<outer, inner, pixels, encoding, bytes, claim, claimed> of a silent groove's extent (13 or 21 bytes), or null if it is not one."""
    outer, inner, room = columns.u16be(payload, 0), columns.u16be(payload, 2), columns.u32be(payload, 9)
    claimed = F.octet_length(payload) >= 21
    tag, used = F.substring(payload, 14, 4), columns.u32be(payload, 17)
    good = (F.octet_length(payload) >= 13) & (inner < outer) & (~claimed | ((used <= room) & (F.hex(tag) != "00000000")))
    encoding = F.conv(F.hex(F.substring(payload, 9, 1)), 16, 10).cast("int")
    return F.when(good, F.struct(outer.alias("outer"), inner.alias("inner"), columns.u32be(payload, 4).alias("pixels"), encoding.alias("encoding"), room.alias("bytes"), F.when(claimed, tag).alias("claim"), F.when(claimed, used).otherwise(0).alias("claimed")))


def segments(found: DataFrame) -> DataFrame:
    return child(found, "segments")


def signature_status(found: DataFrame, trusted: DataFrame) -> DataFrame:
    """(path, role, key_id, status) against a table of (key_id, trusted); a key that is not in it is untrusted.

    Whether a signature is right is for a verifier that the caller brings; this
    says who would have to have made it.
    """
    each = child(found, "signatures")
    named = each.join(trusted.select("key_id", "trusted"), "key_id", "left")
    return named.select("path", "role", "key_id", F.when(F.col("trusted").isNull(), "untrusted").when(F.col("trusted"), "unverified").otherwise("revoked").alias("status"))


def verification(found: DataFrame, keys: DataFrame) -> DataFrame:
    """(path, role, key_id, status) of every descriptor that parsed, against a table of (key_id, public_key, trusted).

    A signature is Verified or Invalid by Ed25519 over its commitment,
    UntrustedKey if its key is not in the table or a row there does not trust it,
    and Unsupported if the key is not one of 32 bytes. A descriptor without a
    release signature has a row that says Missing.
    """
    known = keys.groupBy("key_id").agg(F.min(F.coalesce("trusted", F.lit(False))).alias("trusted"), F.max("public_key").alias("public_key"))
    each = child(found, "signatures").join(known, "key_id", "left")
    status = F.when(~F.coalesce("trusted", F.lit(False)), "UntrustedKey").when(F.coalesce(F.octet_length("public_key"), F.lit(0)) != 32, "Unsupported").when(F.col("right"), "Verified").otherwise("Invalid")
    right = signatures.verified(F.col("public_key"), F.col("commitment"), F.col("signature"))
    signed = each.withColumn("right", right).select("path", "role", "key_id", status.alias("status"))
    bare = found.where(F.col("error").isNull() & ~F.exists("signatures", lambda s: s["role"] == "release"))
    return signed.unionByName(bare.select("path", F.lit("release").alias("role"), F.lit(None).cast("binary").alias("key_id"), F.lit("Missing").alias("status")))
