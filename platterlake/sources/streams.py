"""Record streams: bytes to nested structs, and the child tables of these.

Parsing runs in Arrow batches, one file a row; a stream that does not parse stays
as a row with its error. Everything after that is relational.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import columns
from ..functions.columns import let
from ..functions.wire import Cursor, WireError, quiet_filler
from ..operators import relational

MAGIC, METADATA_VERSION = b"BRS1", 2
#: Flags of the metadata and of a payload descriptor, containers by code.
ENCRYPTED, DESCRIPTOR_INDEXES, TRACK_MAPPINGS, TRACK_GAPS = 1, 2, 4, 8
CODEC, SAMPLE_RATE, CHANNELS, GEOMETRY, CODEC_METADATA = 1, 2, 4, 8, 16
CONTAINERS = {1: "ECDC", 2: "MOSSNANO"}
PLAYABLE = tuple(CONTAINERS.values())
EXTENSION = 255
NONCE_BYTES, MOST_CODEC_METADATA = 12, 65_536
GAP_MAGIC, GAP_HEADER = b"GAP1", 28

_DESCRIPTOR = [("idx", pa.int32()), ("container", pa.string()), ("codec", pa.string()), ("sample_rate", pa.int64()), ("channels", pa.int32()), ("block_samples", pa.int64()), ("output_offset_samples", pa.int64()), ("output_samples", pa.int64()), ("codec_metadata", pa.string())]
_ENTRY = [("idx", pa.int32()), ("byte_length", pa.int64()), ("descriptor_idx", pa.int32()), ("samples", pa.int64()), ("sha256", pa.binary())]
_TRACK = [("number", pa.int32()), ("title", pa.string()), ("first_rev", pa.int64()), ("rev_count", pa.int64())]
_GAP = [("idx", pa.int32()), ("first_rev", pa.int64()), ("rev_count", pa.int64()), ("after_track", pa.int32())]
_CHUNK = [("idx", pa.int32()), ("start", pa.int64()), ("end", pa.int64()), ("payload_start", pa.int64()), ("payload_end", pa.int64()), ("crc32", pa.int64()), ("nonce", pa.binary()), ("crc_ok", pa.bool_())]
_LISTS = {"payload_descriptors": _DESCRIPTOR, "entries": _ENTRY, "tracks": _TRACK, "track_gaps": _GAP, "chunks": _CHUNK}
ARROW = pa.schema([("path", pa.string()), ("stream_len", pa.int64()), ("encrypted", pa.bool_()), *((k, pa.list_(pa.struct(v))) for k, v in _LISTS.items()), ("error", pa.string())])
#: Bytes a batch of parsed files may take, about, and what one nested row takes as a dictionary: a file more than that is a batch of its own.
BATCH_BYTES, NESTED_BYTES = 32 << 20, 500
_SQL = {pa.int32(): "int", pa.int64(): "bigint", pa.string(): "string", pa.binary(): "binary", pa.bool_(): "boolean"}
SCHEMA = ", ".join([*(f"{n} {_SQL[ARROW.field(n).type]}" for n in ("path", "stream_len", "encrypted")), *(f"{k} array<struct<{', '.join(f'{n}: {_SQL[t]}' for n, t in v)}>>" for k, v in _LISTS.items()), "error string"])


def payload_descriptor(c: Cursor, idx: int) -> dict:
    """One typed payload descriptor, with the rules that hold inside it."""
    what = f"payload descriptor {idx}"
    code = c.uint(1, f"{what} container")
    if code not in CONTAINERS and code != EXTENSION:
        raise WireError(f"{what} has unknown container {code}")
    out: dict = dict.fromkeys(n for n, _ in _DESCRIPTOR) | {"idx": idx, "container": CONTAINERS.get(code) or c.text(f"{what} container")}
    flags = c.uint(1, f"{what} flags")
    if flags > 31:
        raise WireError(f"{what} has unknown flags")
    if flags & CODEC:
        out["codec"] = c.text(f"{what} codec")
    if flags & SAMPLE_RATE:
        out["sample_rate"] = c.uint(4, f"{what} sample rate")
    if flags & CHANNELS:
        out["channels"] = c.uint(1, f"{what} channels")
    if flags & GEOMETRY:
        block, offset, samples = (c.uint(4, f"{what} geometry") for _ in range(3))
        if not block or not samples or offset + samples > block:
            raise WireError(f"{what} has an output range outside its block")
        out |= {"block_samples": block, "output_offset_samples": offset, "output_samples": samples}
    if flags & CODEC_METADATA:
        length = c.uint(4, f"{what} codec metadata length")
        if length > MOST_CODEC_METADATA:
            raise WireError(f"{what} codec metadata is too long")
        out["codec_metadata"] = codec_metadata(c.take(length, f"{what} codec metadata"), what)
    if out["container"].upper() == "GAP":
        bad = (out["codec"] or "").upper() != "GAP" or not out["sample_rate"] or not out["channels"] or flags & (GEOMETRY | CODEC_METADATA)
        if bad:
            raise WireError(f"{what} is not a well-formed GAP descriptor")
    return out


def codec_metadata(data: bytes, what: str) -> str:
    """JSON text that does not repeat the typed geometry."""
    try:
        text = data.decode("utf-8")
        value = json.loads(text)
    except ValueError as e:
        raise WireError(f"{what} codec metadata is not JSON") from e
    if isinstance(value, dict) and value.keys() & {"block_samples", "output_offset_samples", "output_samples"}:
        raise WireError(f"{what} codec metadata repeats its geometry")
    return text


def metadata(data: bytes) -> dict:
    """Descriptors, entries, tracks and gaps of a stream's metadata."""
    c = Cursor(data)
    if (version := c.uint(1, "metadata version")) != METADATA_VERSION:
        raise WireError(f"metadata version {version} is unknown")
    flags = c.uint(1, "metadata flags")
    if flags > 15:
        raise WireError("metadata has unknown flags")
    n = c.uint(1, "payload descriptor count")
    descriptors = [payload_descriptor(c, i) for i in range(n)]
    entries = []
    for i in range(c.uint(2, "entry count")):
        length = c.varuint(f"entry {i} length")
        which = c.uint(1, f"entry {i} descriptor") if flags & DESCRIPTOR_INDEXES else 0
        if not length or which >= n:
            raise WireError(f"entry {i} is empty or names no descriptor")
        entries.append({"idx": i, "byte_length": length, "descriptor_idx": which, "samples": None, "sha256": None})
    tracks = []
    for i in range(c.uint(2, "track count")):
        title = c.text(f"track {i} title")
        first, count = (c.varuint(f"track {i} first"), c.varuint(f"track {i} count")) if flags & TRACK_MAPPINGS else (i, 1)
        if not title.strip() or not count or first + count > len(entries):
            raise WireError(f"track {i} is untitled, empty or out of range")
        tracks.append({"number": i + 1, "title": title, "first_rev": first, "rev_count": count})
    gaps: list[dict] = []
    for i in range(c.uint(2, "track gap count") if flags & TRACK_GAPS else 0):
        first, count, after = (c.varuint(f"track gap {i}") for _ in range(3))
        late = gaps and first <= gaps[-1]["first_rev"]
        if not count or after >= len(tracks) or first + count > len(entries) or late:
            raise WireError(f"track gap {i} is empty, out of range or out of order")
        gaps.append({"idx": i, "first_rev": first, "rev_count": count, "after_track": after + 1})
    c.end("metadata")
    for name, rows in (("payload descriptor", descriptors), ("entry", entries), ("track", tracks)):
        if not rows:
            raise WireError(f"there is no {name}")
    return {"encrypted": bool(flags & ENCRYPTED), "payload_descriptors": descriptors, "entries": entries, "tracks": tracks, "track_gaps": gaps}


def chunks(data: bytes, at: int, encrypted: bool) -> list[dict]:
    """The transport frames from an offset to the very end."""
    c, out = Cursor(data, at), []
    while c.left:
        start = c.at
        length = c.varuint("chunk length")
        if not length:
            raise WireError(f"chunk at byte {start} is empty")
        crc = c.uint(4, f"CRC of the chunk at byte {start}")
        nonce = c.take(NONCE_BYTES, f"nonce of the chunk at byte {start}") if encrypted else None
        payload = c.take(length, f"chunk at byte {start}")
        out.append({"idx": len(out), "start": start, "end": c.at, "payload_start": c.at - length, "payload_end": c.at, "crc32": crc, "nonce": nonce, "crc_ok": zlib.crc32(payload) == crc})
    return out


def gap_samples(data: bytes) -> int:
    """Samples of a gap payload whose header and filler are as its seed says."""
    c = Cursor(data)
    if c.take(4, "gap magic") != GAP_MAGIC or c.uint(1, "gap version") != 1 or c.uint(1, "gap flags") or c.uint(2, "gap reserve"):
        raise WireError("gap header is invalid")
    samples, length, seed = c.uint(8, "gap samples"), c.uint(8, "gap length"), c.uint(4, "gap seed")
    if not samples or length != len(data) or data[GAP_HEADER:] != quiet_filler(seed, c.left):
        raise WireError("gap length, samples or filler disagree with its header")
    return samples


def parse(data: bytes) -> dict:
    """A whole stream; raises ``WireError`` for what its bytes alone can tell."""
    from hashlib import sha256

    c = Cursor(data)
    if c.take(4, "stream magic") != MAGIC:
        raise WireError("stream magic is invalid")
    out = metadata(c.take(c.uint(4, "metadata length"), "metadata"))
    out["chunks"] = chunks(data, c.at, out["encrypted"])
    if not out["chunks"] or not all(x["crc_ok"] for x in out["chunks"]):
        raise WireError("there is no chunk, or a chunk's CRC is wrong")
    if out["encrypted"]:
        return out
    payload, at = b"".join(data[x["payload_start"] : x["payload_end"]] for x in out["chunks"]), 0
    if sum(e["byte_length"] for e in out["entries"]) != len(payload):
        raise WireError("entry lengths do not add up to the payload")
    for e in out["entries"]:
        body, at = payload[at : at + e["byte_length"]], at + e["byte_length"]
        kind = out["payload_descriptors"][e["descriptor_idx"]]
        e["sha256"] = sha256(body).digest()
        # What a container of another kind lasts is not known, whatever its descriptor says.
        e["samples"] = gap_samples(body) if kind["container"].upper() == "GAP" else kind["output_samples"] if kind["container"].upper() in PLAYABLE else None
    return out


def parsed_batches(batches: Iterator[pa.RecordBatch], parser: Callable[[bytes], dict], arrow: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Parsed files of batches of (path, content), in as many batches as their nested rows ask for.

    A task so holds a bounded number of these however many files came in a batch.
    """
    for batch in batches:
        rows, held = [], 0
        for name, data in zip(batch.column(0), batch.column(1), strict=True):
            raw = data.as_py()
            row = {"path": name.as_py(), "stream_len": None if raw is None else len(raw)}
            try:
                row |= parser(raw or b"")
            except WireError as e:
                row["error"] = str(e)
            rows.append(row)
            held += len(raw or b"") + NESTED_BYTES * sum(len(v) for v in row.values() if isinstance(v, list))
            if held >= BATCH_BYTES:
                yield pa.RecordBatch.from_pylist(rows, schema=arrow)
                rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=arrow)


def parsed(files: DataFrame, parser: Callable[[bytes], dict] = parse, path: str = "path", content: str = "content", arrow: pa.Schema = ARROW, schema: str = SCHEMA) -> DataFrame:
    """Rows of ``arrow`` from (path, content); a file that does not parse has only path, length and error."""
    return files.select(path, content).mapInArrow(lambda batches: parsed_batches(batches, parser, arrow), schema)


def _playable(e: Column) -> Column:
    return F.upper(F.element_at("payload_descriptors", e["descriptor_idx"] + 1)["container"]).isin(*PLAYABLE)


def _ranges() -> Column:
    """The record's tracks and gaps as ranges with their owner, by where they begin."""
    whole = lambda r, kind, number, title: F.struct(r["first_rev"].alias("first"), (r["first_rev"] + r["rev_count"]).alias("end"), F.struct(F.lit(kind).alias("kind"), r[number].alias("number"), title.alias("title")).alias("owner"))
    tracks = F.transform("tracks", lambda t: whole(t, "track", "number", t["title"]))
    return F.array_sort(F.concat(tracks, F.transform("track_gaps", lambda g: whole(g, "gap", "after_track", F.lit(None).cast("string")))))


def _crossing(ranges: Column) -> Column:
    """Whether some sorted ranges overlap: then two neighbours do."""
    later = F.slice(ranges, 2, F.greatest(F.size(ranges) - 1, F.lit(0)))
    return F.exists(F.arrays_zip(F.transform(later, lambda r: r["first"]).alias("first"), F.transform(ranges, lambda r: r["end"]).alias("end")), lambda p: F.coalesce(p["first"] < p["end"], F.lit(False)))


def _held(ranges: str | Column) -> Column:
    """How many revolutions ranges hold in all, each as often as it is held."""
    return F.aggregate(ranges, F.lit(0).cast("bigint"), lambda s, r: s + r["rev_count"])


def fault() -> Column:
    """What is wrong with a parsed record beyond its bytes, or null: work within the row, nothing is joined.

    A payload of the first container states its codec, rate, channels and codec
    metadata; tracks and gaps are as ``misplaced`` asks.
    """
    stated = lambda d: (F.upper(d["codec"]) == "ECDC") & (d["sample_rate"] > 0) & (d["channels"] > 0) & d["codec_metadata"].isNotNull()
    bare = F.exists("payload_descriptors", lambda d: (F.upper(d["container"]) == "ECDC") & ~F.coalesce(stated(d), F.lit(False)))
    return F.when(bare, "a descriptor does not state codec, rate, channels and codec metadata").otherwise(misplaced())


def misplaced() -> Column:
    """What is wrong with the tracks and gaps of a parsed record, or null.

    Each revolution of a playable container lies in one track or gap, tracks follow
    one another, and neither holds an auxiliary revolution; a record without a
    playable one is not asked. Ranges are sorted and never taken apart into
    revolutions; they are looked at one by one only if no two of them overlap.
    """
    ends = F.transform("tracks", lambda t: t["first_rev"] + t["rev_count"])
    late = F.exists(F.arrays_zip(F.transform(F.slice("tracks", 2, F.greatest(F.size("tracks") - 1, F.lit(0))), lambda t: t["first_rev"]).alias("first"), ends.alias("end")), lambda p: F.coalesce(p["first"] < p["end"], F.lit(False)))
    playable = F.size(F.filter("entries", _playable))
    kinds = F.encode(F.array_join(F.transform("entries", lambda e: F.when(_playable(e), "p").otherwise("a")), ""), "UTF-8")
    auxiliary = let(kinds, lambda k: F.exists(F.concat(F.transform("tracks", _span), F.transform("track_gaps", _span)), lambda r: F.contains(F.substring(k, r["at"], r["n"]), F.lit(b"a"))))
    owned = _held("tracks") + _held("track_gaps")
    return (
        F.when(playable == 0, None)
        .when(late, "a track begins inside the one before it")
        .when(_crossing(_ranges()), "a revolution is covered twice")
        .when(auxiliary, "a track or gap holds an auxiliary revolution")
        .when(owned < playable, "a revolution is not covered")
    )


def _span(r: Column) -> Column:
    return F.struct((r["first_rev"] + 1).cast("int").alias("at"), r["rev_count"].cast("int").alias("n"))


def records(files: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """As ``parsed``, and a record that breaks a rule of ``fault`` has it as its error."""
    found = parsed(files, path=path, content=content)
    return found.withColumn("error", F.coalesce("error", F.when(F.col("error").isNull(), fault())))


def read_files(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """(path, content) of the files below a folder, one row each."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(folder).select("path", "content")


def child(streams: DataFrame, name: str) -> DataFrame:
    """One child table (``entries``, ``tracks``, ...) with its record's path."""
    return streams.where("error is null").select("path", F.explode(name).alias("c")).select("path", "c.*")


def entries(streams: DataFrame) -> DataFrame:
    """Entries with their byte offsets."""
    return relational.running_offsets(child(streams, "entries"), ["path"], ["idx"], "byte_length").drop("byte_end")


def uncovered(streams: DataFrame) -> DataFrame:
    """(path, first_rev, rev_count, times) of the stretches of revolutions not covered exactly once by a track or a gap.

    Where ranges begin and end, the number that hold a revolution changes; stretches
    of one number follow from the running sum of the changes.
    """
    both = child(streams, "tracks").select("path", "first_rev", "rev_count").unionAll(child(streams, "track_gaps").select("path", "first_rev", "rev_count"))
    edges = F.explode(F.array(F.struct(F.col("first_rev").alias("at"), F.lit(1).alias("more")), F.struct((F.col("first_rev") + F.col("rev_count")).alias("at"), F.lit(-1).alias("more")))).alias("e")
    ends = streams.where("error is null").select("path", F.explode(F.array(F.lit(0).cast("bigint"), F.size("entries").cast("bigint"))).alias("at"), F.lit(0).alias("more"))
    steps = both.select("path", edges).select("path", "e.at", "e.more").unionByName(ends).groupBy("path", "at").agg(F.sum("more").alias("more"))
    order = Window.partitionBy("path").orderBy("at")
    runs = steps.select("path", F.col("at").alias("first_rev"), (F.lead("at").over(order) - F.col("at")).alias("rev_count"), F.sum("more").over(order).alias("times"))
    return runs.where((F.col("rev_count") > 0) & (F.col("times") != 1))


def chunks_outside(streams: DataFrame) -> DataFrame:
    """Chunks of plain streams whose payload lies in no single entry."""
    plain = streams.where("not encrypted")
    lengths = child(plain, "chunks").withColumn("n", F.col("payload_end") - F.col("payload_start"))
    placed = relational.running_offsets(lengths, ["path"], ["idx"], "n", "from", "to")
    ranges = relational.running_offsets(child(plain, "entries"), ["path"], ["idx"], "byte_length", "from", "to").select("path", "from", "to")
    return relational.contained(placed.select("path", "idx", "from", "to"), ranges, "path", "from", "to")


def untimed() -> Column:
    """Why a record has no programme map, or null: an entry of unknown duration, under no track or gap or under two, or no rate or channels."""
    return (
        F.when(F.exists("entries", lambda e: e["samples"].isNull()), "an entry has no known duration")
        .when(_crossing(_ranges()), "an entry is under two tracks or gaps")
        .when(_held("tracks") + _held("track_gaps") < F.size("entries"), "an entry is under no track or gap")
        .when(~F.exists("payload_descriptors", lambda d: d["sample_rate"].isNotNull()) | ~F.exists("payload_descriptors", lambda d: d["channels"].isNotNull()), "no descriptor states a rate or channels")
    )


def regions(streams: DataFrame, inner: Column | None = None, outer: Column | None = None) -> DataFrame:
    """Timed regions of each programme that has a map: track entries merge with their neighbours, gap entries do not.

    Places are in samples, in seconds of the first stated rate, and as a share of
    the payload's bytes; with the radii of the programme's band (constants, or
    columns of ``streams``) also as a share of the band.
    """
    mapped = streams.where(F.col("error").isNull() & untimed().isNull())
    stated = lambda f: F.element_at(F.filter(F.transform("payload_descriptors", lambda d: d[f]), lambda x: x.isNotNull()), 1)
    total = F.aggregate("entries", F.lit(0).cast("bigint"), lambda s, e: s + e["byte_length"])
    # a record with a map has disjoint ranges that hold all its entries, so the sorted ranges line up with them
    owners = F.flatten(F.transform(_ranges(), lambda r: F.array_repeat(r["owner"], (r["end"] - r["first"]).cast("int"))))
    radii = [x.cast("double") if x is not None else F.lit(None).cast("double") for x in (inner, outer)]
    head = mapped.select("path", stated("sample_rate").alias("sample_rate"), stated("channels").alias("channels"), total.alias("total"), radii[0].alias("inner"), radii[1].alias("outer"), F.explode(F.arrays_zip(F.col("entries").alias("entry"), owners.alias("owner"))).alias("e"))
    each = head.select("path", "sample_rate", "channels", "total", "inner", "outer", "e.entry.idx", "e.entry.byte_length", "e.entry.samples", "e.owner")
    owned = relational.running_offsets(each, ["path"], ["idx"], "byte_length")
    keys = ["path", "sample_rate", "channels", "total", "inner", "outer"]
    merged = relational.merged_regions(owned, ["path"], ["idx"], "owner", "samples", F.col("owner.kind") == "gap", {**{k: F.first(k) for k in keys[1:]}, "byte_start": F.min("byte_offset"), "byte_end": F.max("byte_end")})
    share = lambda c: F.col(c) / F.col("total")
    radial = lambda c: F.when(F.col("outer").isNotNull(), columns.equal_area_radius(share(c), F.col("inner"), F.col("outer")))
    return merged.select("path", F.col("ordinal").alias("ord"), "owner.kind", "owner.number", "owner.title", F.col("start").alias("start_sample"), F.col("end").alias("end_sample"), "sample_rate", "channels", "byte_start", "byte_end", share("byte_start").alias("share_start"), share("byte_end").alias("share_end"), radial("byte_start").alias("radial_start"), radial("byte_end").alias("radial_end"))


def summary(streams: DataFrame) -> DataFrame:
    """One row a record: what it holds, in counts and sums."""
    total = lambda of, f: F.aggregate(of, F.lit(0).cast("bigint"), lambda s, x: s + x[f])
    return streams.select("path", "error", "encrypted", "stream_len", F.size("payload_descriptors").alias("n_descriptors"), F.size("entries").alias("n_entries"), F.size("tracks").alias("n_tracks"), F.size("chunks").alias("n_chunks"), total("entries", "byte_length").alias("payload_bytes"), total("entries", "samples").alias("total_samples"))
