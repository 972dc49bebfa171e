"""Reports over parsed records: a long table of checks, and JSON documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry
from ..operators import relational
from ..sources import streams


def stream_checks(found: DataFrame) -> DataFrame:
    """(path, label, ok) for every stream, whether it parsed or not."""
    crossed = streams.chunks_outside(found).select("path").distinct().withColumn("crossed", F.lit(True))
    both = found.join(crossed, "path", "left")
    parsed = F.col("error").isNull()
    total = lambda of, f: F.aggregate(of, F.lit(0).cast("bigint"), lambda s, x: s + x[f])
    payload = F.aggregate("chunks", F.lit(0).cast("bigint"), lambda s, c: s + c["payload_end"] - c["payload_start"])
    predicates = {
        "chunk checksums agree": parsed & F.forall("chunks", lambda c: c["crc_ok"]),
        "chunks lie inside entries": parsed & (F.col("encrypted") | F.col("crossed").isNull()),
        "entries add up to the payload": parsed & (F.col("encrypted") | (total("entries", "byte_length") == payload)),
        "descriptors, tracks and gaps keep the rules": parsed & streams.fault().isNull(),
        "sample rate and channels are stated": parsed & (F.size("payload_descriptors") > 0) & F.forall("payload_descriptors", lambda d: F.coalesce((d["sample_rate"] > 0) & (d["channels"] > 0), F.lit(False))),
        "programme has a map": parsed & streams.untimed().isNull(),
        "stream parses": parsed,
    }
    return relational.checks(both, ["path"], predicates)


def _problems(*rules: tuple[Column, str]) -> Column:
    """The texts of the rules that are broken, joined; null if none is. A rule of unknown outcome is broken."""
    said = F.array_join(F.array_compact(F.array(*(F.when(~F.coalesce(rule, F.lit(False)), text) for rule, text in rules))), "; ")
    return F.nullif(said, F.lit(""))


def findings(found: DataFrame, profile: Column | None = None) -> DataFrame:
    """(path, label, idx, ok, detail): every check of a record, of each of its payload descriptors and of each entry.

    ``found`` comes from ``streams.parsed`` or ``streams.records``. ``idx`` numbers
    descriptors and entries and is null for what holds for the record. ``detail`` says
    what was found where a check holds and what is wrong where it does not. A stream
    that does not parse has the one row that says so; entries of an encrypted record
    fail, because their bytes are not read. ``profile`` is the name that the record's
    descriptor states; without it that check is left out. One pass within the rows:
    nothing is joined, and a record gives as many rows as it has parts.
    """
    read = F.col("entries").isNotNull()
    text = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))
    none = F.lit(None).cast("int")

    def row(label: str, idx: Column, problem: Column, good: Column) -> Column:
        return F.struct(F.lit(label).alias("label"), idx.alias("idx"), problem.isNull().alias("ok"), F.coalesce(problem, good).alias("detail"))

    total = lambda of, size: F.aggregate(of, F.lit(0).cast("bigint"), lambda s, x: s + size(x))
    held, stored = total("entries", lambda e: e["byte_length"]), total("chunks", lambda c: c["payload_end"] - c["payload_start"])
    whole = [
        row("stream parses", none, F.lit(None).cast("string"), text(F.col("stream_len"), " bytes")),
        row("metadata version", none, F.lit(None).cast("string"), text(f"version {streams.METADATA_VERSION}")),
        row("tracks and gaps", none, streams.misplaced(), text(F.size("tracks"), " tracks and ", F.size("track_gaps"), " gaps hold every playable entry once")),
        row("bytes of the entries", none, F.when(~F.col("encrypted") & (held != stored), text("entries hold ", held, " bytes of ", stored)), text(F.size("entries"), " entries hold ", held, " bytes")),
        row("programme map", none, streams.untimed(), text(total("entries", lambda e: F.coalesce(e["samples"], F.lit(0).cast("bigint"))), " samples in ", F.size("entries"), " entries")),
    ]
    if profile is not None:
        name = F.trim(profile)
        whole.append(row("record profile", none, F.when(~F.coalesce(name.isin(*geometry.MILLIMETRES), F.lit(False)), text("profile ", F.coalesce(profile, F.lit("")), " is unknown")), name))

    kind = lambda d: F.upper(d["container"])
    named = lambda d, codec: (F.upper(d["codec"]) == codec, f"codec is not {codec}")
    sound = lambda d: [(d["sample_rate"] > 0, "sample rate is not stated"), (d["channels"] > 0, "channels are not stated")]
    shaped = lambda d: (d["block_samples"].isNotNull(), "output range is not stated")
    json = lambda d: (F.try_parse_json(d["codec_metadata"]).isNotNull(), "codec metadata is not JSON")
    ranged = lambda d: (d["output_offset_samples"] + d["output_samples"] <= d["block_samples"]) | d["block_samples"].isNull()
    bare = lambda d: [(d["block_samples"].isNull(), "silence has an output range"), (d["codec_metadata"].isNull(), "silence has codec metadata")]

    def of_descriptor(d: Column) -> Column:
        each = row("descriptor is valid", d["idx"], _problems((ranged(d), "output range is outside its block")), text("container ", d["container"]))
        music = row("music is described", d["idx"], _problems(named(d, "ECDC"), *sound(d), shaped(d), json(d)), text("codec, format, output range and codec metadata are stated"))
        silence = row("silence is described", d["idx"], _problems(named(d, "GAP"), *sound(d), *bare(d)), text("codec and format are stated, and nothing else"))
        return F.when(kind(d) == "ECDC", F.array(each, music)).when(kind(d) == "GAP", F.array(each, silence)).otherwise(F.array(each))

    def of_entry(e: Column) -> Column:
        container = kind(F.element_at("payload_descriptors", e["descriptor_idx"] + 1))
        lasting = F.when(F.col("encrypted"), "entry is encrypted").when(F.coalesce(e["samples"], F.lit(0)) == 0, "entry has no samples")
        good = text(e["samples"], " samples, ", e["byte_length"], " bytes")
        return F.when(container == "ECDC", F.array(row("music has a length", e["idx"], lasting, good))).when(container == "GAP", F.array(row("silence has a length", e["idx"], lasting, good))).otherwise(F.array().cast("array<struct<label: string, idx: int, ok: boolean, detail: string>>"))

    parts = F.concat(F.array(*whole), F.flatten(F.transform("payload_descriptors", of_descriptor)), F.flatten(F.transform("entries", of_entry)))
    broken = F.array(F.struct(F.lit("stream parses").alias("label"), none.alias("idx"), F.lit(False).alias("ok"), F.col("error").alias("detail")))
    return found.select("path", F.explode(F.when(read, parts).otherwise(broken)).alias("f")).select("path", "f.*")


def record_checks(found: DataFrame, described: DataFrame) -> DataFrame:
    """(path, label, ok) of descriptors against their streams, by path."""
    lengths = found.select("path", F.col("stream_len").alias("held"), F.size("tracks").alias("n_tracks"))
    both = described.join(lengths, "path", "left")
    parsed = F.col("error").isNull()
    predicates = {
        "codes name tracks that exist": parsed & F.forall("isrcs", lambda i: i["track_index"] < F.col("n_tracks")),
        "descriptor parses": parsed,
        "stream is as long as described": parsed & (F.col("stream_byte_length") == F.col("held")),
    }
    return relational.checks(both, ["path"], predicates)


def tally(checks: DataFrame) -> DataFrame:
    """(label, passed, failed) over all records."""
    return checks.groupBy("label").agg(F.count_if("ok").alias("passed"), F.count_if(~F.col("ok")).alias("failed"))


def rollup(checks: DataFrame, dims: list[str]) -> DataFrame:
    """(dims, label, level, passed, failed): the tally for each dimension, for all of them together and for none, by label and in all.

    One pass: each check is expanded to its groups and summed before the shuffle.
    ``level`` is Spark's grouping_id over (dims, label), so a null that stands for all
    is told from one that is a value.
    """
    sets = [[*dims, "label"], *([d, "label"] for d in dims if len(dims) > 1), ["label"], *([d] for d in dims), []]
    return checks.groupingSets(sets, *dims, "label").agg(F.grouping_id().cast("bigint").alias("level"), F.count_if("ok").alias("passed"), F.count_if(~F.col("ok")).alias("failed"))


def signing_coverage(described: DataFrame) -> DataFrame:
    """(path, field, present, covered): which stated fields a release signature or the deferred attestation covers."""
    has = lambda role: F.exists("signatures", lambda s: s["role"] == role)
    late = {"isrcs": F.size("isrcs") > 0, "upc": F.col("upc").isNotNull()}
    early = {n: F.col(n).isNotNull() for n in ("title", "artist", "release_id", "catalog_number", "label", "artwork_credit", "canonical_url", "created_at", "copyright_year", "copyright_holder")}
    rows = [F.struct(F.lit(n).alias("field"), p.alias("present"), (p & has("release")).alias("covered")) for n, p in early.items()]
    rows += [F.struct(F.lit(n).alias("field"), p.alias("present"), (p & has("deferred")).alias("covered")) for n, p in late.items()]
    return described.where("error is null").select("path", F.explode(F.array(*rows)).alias("r")).select("path", "r.*")


def _hexed(df: DataFrame, skip: tuple[str, ...] = ()) -> list[Column]:
    return [F.lower(F.hex(n)).alias(n) if kind == "binary" else F.col(n) for n, kind in df.dtypes if n not in skip]


def stream_json(found: DataFrame) -> DataFrame:
    """(path, json) of every stream, with digests and nonces in hexadecimal."""
    entries = F.transform("entries", lambda e: e.withField("sha256", F.lower(F.hex(e["sha256"]))))
    chunks = F.transform("chunks", lambda c: c.withField("nonce", F.lower(F.hex(c["nonce"]))))
    return found.withColumns({"entries": entries, "chunks": chunks}).select("path", F.to_json(F.struct("*")).alias("json"))


def descriptor_json(described: DataFrame) -> DataFrame:
    """(path, json) of every descriptor; segments are left to their own table."""
    flat = described.withColumn("signatures", F.transform("signatures", lambda s: s.withField("commitment", F.lower(F.hex(s["commitment"]))).withField("key_id", F.lower(F.hex(s["key_id"]))).withField("signature", F.lower(F.hex(s["signature"])))))
    return flat.select("path", F.to_json(F.struct(*_hexed(flat, ("segments",)))).alias("json"))


def record_json(files: DataFrame, found: DataFrame, described: DataFrame | None = None) -> DataFrame:
    """(path, json): one document of each stream, with its digests, and of its descriptor where there is one of its path.

    ``record`` has the file's length and SHA-256; ``stream`` the metadata, the
    SHA-256 of the payload and, for each chunk, where it lies and the SHA-256 of its
    payload; ``descriptor`` what ``descriptor_json`` has. A stream that does not parse
    has its error and the digest of the file. A null content is an empty file.
    """
    content = F.coalesce(F.col("content"), F.lit(b""))
    body = lambda c: F.substring(content, (c["payload_start"] + 1).cast("int"), (c["payload_end"] - c["payload_start"]).cast("int"))
    chunks = F.transform("chunks", lambda c: F.struct(c["idx"].alias("idx"), c["start"].alias("start"), c["end"].alias("end"), c["payload_start"].alias("payload_start"), c["payload_end"].alias("payload_end"), c["crc32"].alias("crc32"), F.lower(F.hex(c["nonce"])).alias("nonce"), F.sha2(body(c), 256).alias("sha256")))
    payload = F.unhex(F.array_join(F.transform("chunks", lambda c: F.hex(body(c))), ""))
    entries = F.transform("entries", lambda e: e.withField("sha256", F.lower(F.hex(e["sha256"]))))
    stream = F.struct("encrypted", "payload_descriptors", entries.alias("entries"), "tracks", "track_gaps", F.size("chunks").alias("n_chunks"), F.octet_length(payload).alias("payload_bytes"), F.sha2(payload, 256).alias("payload_sha256"), chunks.alias("chunks"))
    record = F.struct(F.octet_length(content).alias("byte_length"), F.sha2(content, 256).alias("sha256"), "error")
    both = files.select(F.col("path").alias("of"), "content").join(found, F.col("of") == F.col("path"))
    whole = both.select("path", record.alias("record"), F.when(F.col("entries").isNotNull(), stream).alias("stream"))
    if described is None:
        return whole.select("path", F.to_json(F.struct("record", "stream")).alias("json"))
    said = descriptor_json(described).select(F.col("path").alias("of"), F.col("json").alias("said"))
    joined = whole.join(said, F.col("of") == F.col("path"), "left")
    # a document within the document, as it is and not as a string
    inner = F.when(F.col("said").isNotNull(), F.try_parse_json("said"))
    return joined.select("path", F.to_json(F.struct("record", "stream", inner.alias("descriptor"))).alias("json"))


def programme_json(found: DataFrame) -> DataFrame:
    """(path, json): each programme's tracks and gaps in order, with samples, milliseconds and places, and its totals."""
    millis = lambda c: (F.col(c) * 1000 / F.col("sample_rate")).alias(c.replace("_sample", "_ms"))
    region = F.struct("ord", "number", "title", "start_sample", "end_sample", millis("start_sample"), millis("end_sample"), "share_start", "share_end", "radial_start", "radial_end")
    of = lambda kind: F.array_sort(F.collect_list(F.when(F.col("kind") == kind, region)))
    whole = streams.regions(found).groupBy("path").agg(F.first("sample_rate").alias("sample_rate"), F.first("channels").alias("channels"), F.max("end_sample").alias("total_samples"), of("track").alias("tracks"), of("gap").alias("gaps"))
    return whole.select("path", F.to_json(F.struct("sample_rate", "channels", "total_samples", "tracks", "gaps")).alias("json"))


def json_shape(text: Column) -> Column:
    """struct<kind, members>: whether JSON is an object, an array or a scalar, and how many members it has; null if it is none."""
    value = F.try_parse_json(text)
    kind = F.schema_of_variant(value)
    shape = F.when(F.startswith(kind, F.lit("OBJECT")), F.struct(F.lit("object").alias("kind"), F.size(F.json_object_keys(text)).alias("members")))
    shape = shape.when(F.startswith(kind, F.lit("ARRAY")), F.struct(F.lit("array").alias("kind"), F.json_array_length(text).alias("members")))
    return F.when(value.isNotNull(), shape.otherwise(F.struct(F.lit("scalar").alias("kind"), F.lit(0).alias("members"))))


def manifest(found: DataFrame, described: DataFrame) -> DataFrame:
    """(path, section, label, value, ok) of every record: what its descriptor and stream say, and the checks, as rows."""
    text = lambda col: F.col(col).cast("string")
    rows = lambda section, names: [F.struct(F.lit(section).alias("section"), F.lit(n).alias("label"), text(n).alias("value")) for n in names]
    structural = rows("RECORD", ("stream_len", "record_profile", "payload_encoding", "stream_byte_length")) + rows("IDENTITY", ("title", "artist", "label", "created_at", "copyright_year", "copyright_holder", "upc"))
    said = described.where("error is null").select("path", F.explode(F.array(*structural)).alias("r"))
    counted = streams.summary(found).where("error is null").select("path", F.explode(F.array(*rows("AUDIO", ("n_descriptors", "n_entries", "n_tracks", "n_chunks", "payload_bytes", "total_samples")))).alias("r"))
    timed = streams.regions(found).select("path", F.struct(F.lit("PROGRAMME").alias("section"), F.concat_ws(" ", text("ord"), F.col("kind"), text("number")).alias("label"), F.concat_ws("-", text("start_sample"), text("end_sample")).alias("value")).alias("r"))
    plain = said.unionByName(counted).unionByName(timed).select("path", "r.*", F.lit(None).cast("boolean").alias("ok")).where("value is not null")
    checked = stream_checks(found).unionByName(record_checks(found, described)).select("path", F.lit("CHECKS").alias("section"), "label", text("ok").alias("value"), "ok")
    return plain.unionByName(checked)


def manifest_json(rows: DataFrame) -> DataFrame:
    """(path, json): a record's manifest rows as one document, with how many checks passed and failed."""
    each = F.array_sort(F.collect_list(F.struct("section", "label", "value", "ok")))
    return rows.groupBy("path").agg(F.count_if("ok").alias("checks_passed"), F.count_if(~F.col("ok")).alias("checks_failed"), each.alias("rows")).select("path", F.to_json(F.struct("checks_passed", "checks_failed", "rows")).alias("json"))


__all__ = ["descriptor_json", "findings", "json_shape", "manifest", "manifest_json", "programme_json", "record_checks", "record_json", "rollup", "signing_coverage", "stream_checks", "stream_json", "tally"]
