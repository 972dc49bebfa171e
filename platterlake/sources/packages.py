"""Packages: a directory and two or three sections, checked and split."""

from __future__ import annotations

import zlib
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.wire import Cursor, WireError
from . import descriptors, streams

MAGIC, PREFIX, ENTRY = b"BPK1", 24, 52
#: Section names by code.
SECTIONS = {1: "BRD1", 2: "BRS1", 3: "BSC1"}
_SECTION = [("ord", pa.int32()), ("kind", pa.string()), ("byte_offset", pa.int64()), ("byte_length", pa.int64()), ("sha256", pa.binary()), ("content", pa.binary())]
ARROW = pa.schema([("path", pa.string()), ("stream_len", pa.int64()), ("has_sidecar", pa.bool_()), ("sections", pa.list_(pa.struct(_SECTION))), ("error", pa.string())])
SCHEMA = "path string, stream_len bigint, has_sidecar boolean, sections array<struct<ord: int, kind: string, byte_offset: bigint, byte_length: bigint, sha256: binary, content: binary>>, error string"


def directory(head: bytes, size: int) -> list[tuple[str, int, int, bytes]]:
    """(kind, offset, length, digest) of the sections of a package of ``size`` bytes, from its prefix and directory alone."""
    c = Cursor(head)
    if c.take(4, "package magic") != MAGIC:
        raise WireError("package magic is invalid")
    version, flags, count = c.uint(1, "version"), c.uint(1, "flags"), c.uint(2, "section count")
    if version != 1 or flags > 1 or count != 2 + flags:
        raise WireError("package version, flags or section count is invalid")
    header, total, crc = c.uint(4, "header length"), c.uint(8, "total length"), c.uint(4, "header CRC")
    if header != PREFIX + count * ENTRY or header > size or total != size:
        raise WireError("package lengths are not canonical")
    if zlib.crc32(head[: PREFIX - 4] + bytes(4) + head[PREFIX:header]) != crc:
        raise WireError("package header CRC is wrong")
    found, at = [], header
    for k in range(count):
        kind, spare = c.uint(1, "section kind"), c.uint(3, "section reserve")
        offset, length, digest = c.uint(8, "section offset"), c.uint(8, "section length"), c.take(32, "section digest")
        if kind != k + 1 or spare or offset != at or not length or offset + length > size:
            raise WireError(f"section {k} is out of order, empty or out of place")
        found.append((SECTIONS[kind], offset, length, digest))
        at = offset + length
    if at != size:
        raise WireError("package has trailing bytes")
    return found


def parse(data: bytes) -> dict:
    """The sections of a package in canonical form; their digests must agree."""
    found = []
    for k, (kind, offset, length, digest) in enumerate(directory(data, len(data))):
        body = data[offset : offset + length]
        if sha256(body).digest() != digest:
            raise WireError(f"section {k} digest is wrong")
        found.append({"ord": k, "kind": kind, "byte_offset": offset, "byte_length": length, "sha256": digest, "content": body})
    flags = len(found) > 2
    described = descriptors.parse(found[0]["content"])
    streams.parse(found[1]["content"])
    if described["stream_byte_length"] != found[1]["byte_length"]:
        raise WireError("descriptor and stream disagree on the stream's length")
    if (21 in {s["type"] for s in described["segments"]}) != flags:
        raise WireError("sidecar and sidecar pointer do not go together")
    return {"has_sidecar": flags, "sections": found}


def packages(files: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """One row a package, with its sections and an error."""
    return streams.parsed(files, parse, path, content, ARROW, SCHEMA)


def section(found: DataFrame, kind: str) -> DataFrame:
    """(path, content) of one kind of section, ready for its own parser."""
    return streams.child(found, "sections").where(F.col("kind") == kind).select("path", "content")


def inspection(found: DataFrame) -> DataFrame:
    """One flat row a package."""
    return found.select("path", "error", "has_sidecar", F.size("sections").alias("n_sections"), F.transform("sections", lambda s: s["byte_length"]).alias("section_bytes"))


__all__ = ["directory", "inspection", "packages", "parse", "section"]
