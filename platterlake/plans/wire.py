"""Records on the wire, written from the given tables, and queries that run the parsers over them.

Each order is a stream: its lines are entries, their quantities lengths, and some
orders are spoiled on purpose, so that errors are compared too. Parts are descriptors
and suppliers packages. The writers are column expressions and serve these queries
alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as c
from ..functions import geometry
from ..operators import sweep
from ..sources import descriptors, packages, streams
from . import report


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _hex(text: str) -> Column:
    return F.unhex(F.lit(text))


def _u(value: Column | int, width: int) -> Column:
    return c.unsigned(F.lit(value) if isinstance(value, int) else value, width)


def _bytes(text: str) -> Column:
    return F.encode(F.lit(text), "UTF-8")


def _joined(parts: Column) -> Column:
    """Binary of an array of binaries."""
    return F.unhex(F.array_join(F.transform(parts, lambda b: F.hex(b)), ""))


def _chunk(payload: Column) -> Column:
    return F.concat(c.varuint(F.octet_length(payload)), _u(F.crc32(payload), 4), payload)


def order_streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, content): a stream for each order; the remainder of its key by eleven says how it is spoiled.

    0 magic, 1 checksum, 2 trailing byte of metadata, 3 payload one byte short, 4 gap
    left out, 5 second track over the gap, 6 blank title, 7 a chunk across entries.
    Every fifth order of three lines or more ends in an auxiliary entry; playable
    entries are a track, and from three on two tracks with a gap of one between.
    """
    line = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", F.col("l_quantity").cast("bigint").alias("n"))
    orders = _table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o")).agg(F.array_sort(F.collect_list(line)).alias("lines"))
    spoiled = F.col("o") % 11
    n = F.size("lines")
    orders = orders.withColumn("aux", ((F.col("o") % 5 == 0) & (n >= 3)).cast("int")).withColumn("p", n - F.col("aux"))
    two = F.col("p") >= 3
    title = lambda k: c.wire_text(F.when(spoiled == 6, " ").otherwise(F.concat(F.lit("Side "), F.col("o").cast("string"), F.lit(f"-{k}"))))
    track = lambda k, first, count: F.concat(title(k), c.varuint(first), c.varuint(count))
    late = F.when(spoiled == 5, F.col("p") - 2).otherwise(F.col("p") - 1)
    tracks = F.when(two, F.concat(_u(2, 2), track(1, F.lit(0), F.col("p") - 2), track(2, late, F.col("p") - late))).otherwise(F.concat(_u(1, 2), track(1, F.lit(0), F.col("p"))))
    gaps = F.when(two & (spoiled != 4), F.concat(_u(1, 2), c.varuint(F.col("p") - 2), c.varuint(F.lit(1)), c.varuint(F.lit(0)))).otherwise(_u(0, 2))
    samples = 1000 + F.col("o") % 7
    first = F.concat(_hex("011F"), c.wire_text(F.lit("ECDC")), _u(48_000, 4), _u(2, 1), _u(samples + 9, 4), _u(5, 4), _u(samples, 4), _u(2, 4), _bytes("{}"))
    # the auxiliary kind states rate and channels in even orders
    note = F.when(F.col("o") % 2 == 0, F.concat(_u(6, 1), _u(48_000, 4), _u(2, 1))).otherwise(_u(0, 1))
    kinds = F.concat(_u(2, 1), first, _hex("FF"), c.wire_text(F.lit("NOTE")), note)
    entries = F.transform("lines", lambda x, i: F.concat(c.varuint(x["n"]), _u((i >= F.col("p")).cast("int"), 1)))
    meta = F.concat(_hex("020E"), kinds, _u(n, 2), _joined(entries), tracks, gaps, F.when(spoiled == 2, _hex("00")).otherwise(_hex("")))
    bodies = F.transform("lines", lambda x: F.encode(F.repeat(F.chr(97 + x["l_linenumber"] % 26), x["n"].cast("int")), "UTF-8"))
    made = orders.select("o", meta.alias("meta"), bodies.alias("bodies"), _joined(bodies).alias("payload"), (F.col("lines")[0]["n"] + 1).cast("int").alias("cut"))
    size = F.octet_length("payload")
    short, head, tail = F.substring(F.col("payload"), F.lit(1), size - 1), F.substring(F.col("payload"), F.lit(1), F.col("cut")), F.substring(F.col("payload"), F.col("cut") + 1, size)
    across = F.when(F.col("cut") < size, F.concat(_chunk(head), _chunk(tail))).otherwise(_chunk(F.col("payload")))
    chunks = F.when(spoiled == 3, _chunk(short)).when(spoiled == 7, across).otherwise(_joined(F.transform("bodies", _chunk)))
    wrong = F.concat(c.varuint(size), _u(F.crc32("payload").bitwiseXOR(F.lit(1)), 4), F.col("payload"))
    content = F.concat(F.when(spoiled == 0, _bytes("BRS2")).otherwise(_bytes("BRS1")), _u(F.octet_length("meta"), 4), F.col("meta"), F.when(spoiled == 1, wrong).otherwise(chunks))
    return made.select(F.col("o").cast("string").alias("path"), content.alias("content"))


def _key(df: DataFrame) -> Column:
    return F.col("path").cast("bigint").alias("l_orderkey")


def stream_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return streams.records(order_streams(spark, sf_dir)).select(F.col("path").cast("bigint").alias("l_orderkey"), "error")


def stream_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = streams.entries(streams.records(order_streams(spark, sf_dir)))
    return found.select(_key(found), "idx", "byte_length", "byte_offset", "descriptor_idx", "samples", F.lower(F.hex("sha256")).alias("sha256"))


def stream_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = streams.child(streams.records(order_streams(spark, sf_dir)), "chunks")
    return found.select(_key(found), "idx", "start", "payload_start", "payload_end", "end", "crc_ok")


def stream_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    lp = geometry.profile("lp")
    found = streams.regions(streams.records(order_streams(spark, sf_dir)), F.lit(lp.inner_radius), F.lit(lp.outer_radius))
    micros = lambda x: F.floor(F.col(x) * 1e6 + 0.5).cast("bigint").alias(x.replace("radial", "micros"))
    return found.select(_key(found), F.col("ord").cast("bigint").alias("ord"), "kind", "number", "title", "start_sample", "end_sample", "sample_rate", "channels", "byte_start", "byte_end", micros("radial_start"), micros("radial_end"))


def stream_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = streams.summary(streams.records(order_streams(spark, sf_dir))).where("error is null")
    return found.select(_key(found), "encrypted", "stream_len", "n_descriptors", "n_entries", "n_tracks", "n_chunks", "payload_bytes", "total_samples")


def stream_chunks_across(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = streams.chunks_outside(sweep.settle(streams.records(order_streams(spark, sf_dir))))  # it reads the records three times
    return found.select(_key(found), "idx", F.col("from").alias("first_byte"), F.col("to").alias("last_byte"))


def stream_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.tally(report.stream_checks(sweep.settle(streams.records(order_streams(spark, sf_dir)))))  # it reads the records twice


def _segment(kind: int, data: Column) -> Column:
    return F.concat(_u(kind, 1), _u(F.octet_length(data), 2), data)


def _descriptor(parts: list[Column], count: Column | int, spoiled: Column) -> Column:
    body = F.concat(_segment(1, _hex("00000000")), *parts)
    size = F.octet_length(body)
    # pitch 0.4, inner radius 113, silent pitch 0.9
    whole = F.concat(_bytes("BRD1"), _u(4, 1), _u(size + 29, 2), _u(count, 2), _u(size, 2), _hex("3FD999999999999A"), _u(113, 2), _hex("3FECCCCCCCCCCCCD"), body)
    return F.concat(F.substring(whole, 1, 32), _u(F.crc32(whole).bitwiseXOR(spoiled.cast("bigint")), 4), F.substring(whole, F.lit(37), F.octet_length(whole) - 36))


def part_descriptors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, content): a descriptor for each part; by thirteen, 0 has a wrong checksum, 1 an unknown profile, 2 a title twice."""
    part = _table(spark, sf_dir, "part")
    spoiled = F.col("p_partkey") % 13
    title = _segment(5, F.encode("p_name", "UTF-8"))
    parts = [
        _segment(2, _u(F.col("p_size") * 10, 4)),
        _segment(4, _u(F.when(spoiled == 1, 9).otherwise(F.col("p_partkey") % 4), 1)),
        title,
        F.when(spoiled == 2, title).otherwise(_hex("")),
        _segment(6, F.encode("p_brand", "UTF-8")),
        _segment(7, _u(0, 1)),
        _segment(14, _u(F.col("p_partkey") * 1000, 8)),
        _segment(24, _u(F.col("p_size") + 1900, 2)),
        _segment(34, _u(F.col("p_partkey") % 2, 1)),
        _segment(99, F.encode("p_type", "UTF-8")),
    ]
    return part.select(F.col("p_partkey").cast("string").alias("path"), _descriptor(parts, F.when(spoiled == 2, 11).otherwise(10), spoiled == 0).alias("content"))


def descriptor_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = descriptors.descriptors(part_descriptors(spark, sf_dir))
    fields = ["title", "artist", "record_profile", "payload_encoding", "stream_byte_length", "created_at", "copyright_year", "clockwise", "b_value", "cut_inner_radius", "silent_groove_b_value"]
    kept = F.transform("segments", lambda s: F.concat_ws(":", s["ord"].cast("string"), s["type"].cast("string"), s["len"].cast("string")))
    return found.select(F.col("path").cast("bigint").alias("p_partkey"), *(F.when(F.col("error").isNull(), F.col(f)).alias(f) for f in fields), F.when(F.col("error").isNull(), F.array_join(kept, ",")).alias("segments"), "error")


def supplier_packages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, content): a package for each supplier; by five, 0 has a wrong digest, 1 a descriptor of another length, 2 a trailing byte."""
    n = F.col("s_suppkey") % 50 + 1
    spoiled = F.col("s_suppkey") % 5
    kind = F.concat(_hex("011F"), c.wire_text(F.lit("ECDC")), _u(48_000, 4), _u(2, 1), _u(20, 4), _u(5, 4), _u(10, 4), _u(2, 4), _bytes("{}"))
    meta = F.concat(_hex("0204"), _u(1, 1), kind, _u(1, 2), c.varuint(n), _u(1, 2), c.wire_text(F.col("s_name")), c.varuint(F.lit(0)), c.varuint(F.lit(1)))
    stream = F.concat(_bytes("BRS1"), _u(F.octet_length(meta), 4), meta, _chunk(F.encode(F.repeat(F.lit("x"), n.cast("int")), "UTF-8")))
    made = _table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", stream.alias("stream"))
    parts = [_segment(2, _u(F.octet_length("stream") + (spoiled == 1).cast("int"), 4)), _segment(4, _u(1, 1)), _segment(5, F.encode("s_name", "UTF-8")), _segment(7, _u(0, 1))]
    both = made.withColumn("desc", _descriptor(parts, 5, F.lit(False)))
    sized = lambda k, at, data: F.concat(_u(k, 1), _u(0, 3), _u(at, 8), _u(F.octet_length(data), 8), F.unhex(F.sha2(F.concat(data, F.when((spoiled == 0) & F.lit(k == 2), _hex("00")).otherwise(_hex(""))), 256)))
    directory = F.concat(sized(1, 128, F.col("desc")), sized(2, F.octet_length("desc") + 128, F.col("stream")))
    total = F.octet_length("desc") + F.octet_length("stream") + 128
    head = F.concat(_bytes("BPK1"), _u(1, 1), _u(0, 1), _u(2, 2), _u(128, 4), _u(total, 8))
    content = F.concat(head, _u(F.crc32(F.concat(head, _u(0, 4), directory)), 4), directory, F.col("desc"), F.col("stream"), F.when(spoiled == 2, _hex("00")).otherwise(_hex("")))
    return both.select(F.col("s_suppkey").cast("string").alias("path"), content.alias("content"))


def package_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = packages.inspection(packages.packages(supplier_packages(spark, sf_dir)))
    return found.select(F.col("path").cast("bigint").alias("s_suppkey"), "error", "has_sidecar", F.when(F.col("error").isNull(), F.col("n_sections")).alias("n_sections"), F.element_at("section_bytes", 1).alias("descriptor_bytes"), F.element_at("section_bytes", 2).alias("stream_bytes"))


def varuint_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers on the wire and back, with one byte before them; every third one is cut off.

    An order whose number is beyond 63 bits has a row without a number; the SQL ends in an error there.
    """
    value = F.try_multiply(F.try_multiply("o_custkey", "o_orderkey"), F.col("o_orderkey"))
    wire = F.concat(_hex("07"), c.varuint(value))
    seen = F.when(F.col("o_orderkey") % 3 == 0, F.substring(wire, F.lit(1), F.octet_length(wire) - 1)).otherwise(wire)
    read = c.varuint_at(seen, 1)
    return _table(spark, sf_dir, "orders").select("o_orderkey", F.lower(F.hex(wire)).alias("wire"), read["value"].alias("value"), read["next"].alias("next_byte"))


def typed_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Identifiers from a time and ten bytes, and what is read from them again."""
    from ..functions import identifiers

    millis = F.col("event_id") * 86_400_007
    entropy = F.unhex(F.substring(F.sha2(F.encode(F.col("event_id").cast("string"), "UTF-8"), 256), 1, 20))
    named = _table(spark, sf_dir, "events").select("event_id", c.typed_id("trk", millis, entropy).alias("id"))
    seen = F.when(F.col("event_id") % 4 == 0, F.lower("id")).when(F.col("event_id") % 4 == 1, F.concat(F.lit("xyz"), F.substring(F.col("id"), F.lit(4), F.lit(40)))).otherwise(F.col("id"))
    code = F.substring("id", 15, 11)
    return named.select("event_id", "id", identifiers.kind(seen).alias("kind"), c.ulid_millis(F.substring("id", 5, 26)).alias("millis"), c.code_slug(code).alias("slug"), c.code_label(code, "YL", "-").alias("label"))


def track_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Track codes as people write them, in canonical form or null."""
    body = F.concat(F.lit("us-"), F.substring("c_mktsegment", 1, 3), F.lit("-"), F.lpad(F.col("c_custkey").cast("string"), 7, "0"))
    seen = F.when(F.col("c_custkey") % 3 == 0, F.concat(body, F.lit("1"))).when(F.col("c_custkey") % 3 == 1, F.lower(body)).otherwise(F.concat(F.lit(" "), body))
    return _table(spark, sf_dir, "customer").select("c_custkey", seen.alias("written"), c.isrc(seen).alias("code"))


def profile_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cuts (parts, at a pitch and a share of the band) on their profiles: turns, widths, stops."""
    part = _table(spark, sf_dir, "part").select("p_partkey", (F.col("p_partkey") % 4).cast("int").alias("code"), (F.col("p_size") / 20.0).alias("pitch"), ((F.col("p_partkey") % 5) / 4.0).alias("share"))
    both = part.join(F.broadcast(geometry.profiles(spark)), "code")  # four rows
    inner, outer = F.col("inner_radius").cast("double"), F.col("outer_radius").cast("double")
    turns = geometry.turns(inner, outer, F.col("pitch"))
    micros = lambda x: F.floor(x * 1e6 + 0.5).cast("bigint")
    return both.select("p_partkey", "profile", "label_radius", "inner_radius", "outer_radius", "lead_in_px", micros(F.col("px_per_mm")).alias("px_per_mm_micros"), micros(F.col("lock_radius")).alias("lock_micros"), micros(turns).alias("turns_micros"), micros(geometry.turn_width(F.col("pitch"))).alias("width_micros"), micros(geometry.pitch_for_turns(inner, outer, turns)).alias("pitch_micros"), geometry.cut_inner_radius(F.col("inner_radius"), outer, F.col("floor_radius"), F.col("share")).alias("stop"))


def pixel_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where pixels of a 576-pixel record lie, and what colour is seen there."""
    x, y, centre = (F.col("vec_id") * 37 % 576).cast("double"), (F.col("vec_id") * 101 % 576).cast("double"), F.lit(288.0)
    red, green, blue = ((F.col("vec_id") * k % 256).cast("double") for k in (3, 5, 7))
    micros = lambda v: F.floor(v * 1e6 + 0.5).cast("bigint")
    tone = c.chroma(red, green, blue)
    return _table(spark, sf_dir, "embeddings").select("vec_id", micros(c.pixel_angle(x, y, centre)).alias("angle_micros"), micros(c.pixel_radius(x, y, centre)).alias("radius_micros"), micros(c.luma(red, green, blue)).alias("luma_micros"), micros(tone["blue"]).alias("blue_micros"), micros(tone["red"]).alias("red_micros"))


def seeded_draws(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first two draws of the generator from each order's key."""
    seed = F.col("o_orderkey") * 1_000_003
    draws = [c.splitmix64(c.advanced(seed, k)) for k in (1, 2)]
    return _table(spark, sf_dir, "orders").select("o_orderkey", *(F.lower(F.lpad(F.hex(d), 16, "0")).alias(f"draw_{k}") for k, d in enumerate(draws, 1)), F.floor(c.unit(draws[0]) * 1e9).cast("bigint").alias("unit_nanos"))


def entry_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each conversation is a release and its turns are revolutions: their digests, and the release's over them in order."""
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", F.unhex(F.sha2(F.encode(F.coalesce("text", F.lit("")), "UTF-8"), 256)).alias("entry"))
    release = _u(F.col("conv_id"), 16)
    each = turns.select("conv_id", F.struct("turn", c.revolution_digest(b"revolution\n", release, F.col("turn"), F.col("entry")).alias("digest")).alias("r"), "entry")
    ordered = each.groupBy("conv_id").agg(F.array_sort(F.collect_list("r")).alias("rs"), F.count(F.lit(1)).alias("n"))
    revolutions = F.transform("rs", lambda r: r["digest"])
    stream = F.unhex(F.sha2(F.encode(F.col("conv_id").cast("string"), "UTF-8"), 256))
    parts = (release, F.lit(1), F.lit(0), stream, revolutions)
    lower = lambda x: F.lower(F.hex(x))
    return ordered.select("conv_id", "n", lower(F.element_at(revolutions, 1)).alias("first_sha256"), lower(c.release_digest(b"release-1\n", *parts)).alias("release_sha256"), lower(c.release_digest(b"release-2\n", *parts, F.unhex(F.sha2(stream, 256)))).alias("release_v2_sha256"))


def gap_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gaps of so many seconds on their profiles: samples, turns and bytes."""
    from ..functions import timeline

    seconds = F.col("o_totalprice") / 20_000
    profile = F.element_at(F.array(*map(F.lit, ("single45", "ten", "lp", "single45vintage"))), (F.col("o_orderkey") % 4 + 1).cast("int"))
    return _table(spark, sf_dir, "orders").select("o_orderkey", profile.alias("profile"), timeline.gap_samples(seconds, F.lit(48_000)).alias("samples"), F.floor(timeline.gap_turns(seconds, profile) * 1e6 + 0.5).cast("bigint").alias("turn_micros"), timeline.gap_bytes(seconds, profile, F.lit(1500)).alias("gap_bytes"))


def segment_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments that each customer's orders and the gaps after them fill, and where they begin."""
    from ..functions import timeline

    tracks = _table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.floor("o_totalprice").cast("bigint").alias("samples"), ((F.col("o_orderkey") % 4).cast("double") / 2).alias("gap"))
    return timeline.segment_budget(tracks, ["o_custkey"], ["o_orderkey"], "samples", "gap", 1000, 640)


_RELEASE, _DEFERRED = b"identity-1", b"deferred-1"


def descriptor_identities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of what a release signature and a deferred attestation cover, for every descriptor that parses."""
    found = descriptors.descriptors(part_descriptors(spark, sf_dir)).where("error is null")
    return found.select(F.col("path").cast("bigint").alias("p_partkey"), F.sha2(descriptors.identity(_RELEASE), 256).alias("identity_sha256"), F.sha2(descriptors.deferred_identity(_DEFERRED, _RELEASE), 256).alias("deferred_sha256"))


def signature_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each supplier's descriptor, signed by key k0 to k4 in turn, or not at all, against a table of keys."""
    n = F.col("s_suppkey") % 6
    envelope = F.concat(_u(2, 1), F.unhex(F.sha2(F.encode("s_name", "UTF-8"), 256)), _u(2, 2), F.encode(F.concat(F.lit("k"), n.cast("string")), "UTF-8"), F.unhex(F.repeat(F.lit("5A"), 64)))
    parts = [_segment(2, _u(100, 4)), _segment(4, _u(1, 1)), _segment(7, _u(0, 1)), F.when(n == 5, _hex("")).otherwise(_segment(16, envelope))]
    made = _table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("string").alias("path"), _descriptor(parts, F.when(n == 5, 4).otherwise(5), F.lit(False)).alias("content"))
    keys = spark.createDataFrame([(bytearray(b"k0"), bytearray(32), True), (bytearray(b"k1"), bytearray(32), False), (bytearray(b"k2"), bytearray(31), True), (bytearray(b"k3"), None, True)], "key_id binary, public_key binary, trusted boolean")
    found = descriptors.verification(descriptors.descriptors(made), keys)
    return found.select(F.col("path").cast("bigint").alias("s_suppkey"), "role", F.decode("key_id", "UTF-8").alias("key_name"), "status")


def silent_extents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extents of silent grooves: every third claimed; some with radii the wrong way round, claims too long or without a tag."""
    o = F.col("o_orderkey")
    outer, inner, room = o % 200 + 100, o % 7 * 50, o % 1000
    free = F.concat(_u(outer, 2), _u(inner, 2), _u(o % 5000, 4), _u(o % 3, 1), _u(room, 4))
    claim = F.concat(F.when(o % 4 == 0, _u(0, 4)).otherwise(_bytes("TAG1")), _u(o % 1500, 4))
    data = F.when(o % 3 == 0, F.concat(free, claim)).when(o % 11 == 0, F.substring(free, 1, 12)).otherwise(free)
    found = _table(spark, sf_dir, "orders").select("o_orderkey", descriptors.silent_extent(data).alias("e"))
    return found.select("o_orderkey", *(F.col(f"e.{f}").alias(f) for f in ("outer", "inner", "pixels", "encoding", "bytes", "claimed")), F.decode("e.claim", "UTF-8").alias("claim"))


def descriptor_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payload descriptors of neighbouring lines of an order: the first field in which they differ."""
    kind = F.struct(F.lit("ECDC").alias("container"), F.col("l_returnflag").alias("codec"), F.lit(48_000).alias("sample_rate"), (F.col("l_linenumber") % 2).alias("channels"), F.lit(9).alias("block_samples"), F.lit(0).alias("output_offset_samples"), F.col("l_quantity").cast("bigint").alias("output_samples"), F.nullif(F.col("l_linestatus"), F.lit("O")).alias("codec_metadata"))
    lines = _table(spark, sf_dir, "lineitem").select("l_orderkey", F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", kind.alias("kind")).alias("line"))
    orders = lines.groupBy("l_orderkey").agg(F.array_sort(F.collect_list("line")).alias("lines"))  # seven lines at most
    pairs = F.transform(F.sequence(F.lit(2), F.size("lines")), lambda i: F.struct(F.element_at("lines", i - 1)["kind"].alias("a"), F.element_at("lines", i)["kind"].alias("b")))
    each = orders.where(F.size("lines") > 1).select("l_orderkey", F.posexplode(pairs).alias("idx", "p"))
    return each.select("l_orderkey", "idx", descriptors.differing(F.col("p.a"), F.col("p.b")).alias("field"))


def json_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The kind of each event's properties as JSON, and how many fields or items it has at the top."""
    return _table(spark, sf_dir, "events").select("event_id", report.json_shape(F.col("props")).alias("s")).select("event_id", "s.kind", "s.members")


def palette_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evenly spaced symbols of palettes of as many colours as a part is large."""
    part = _table(spark, sf_dir, "part").select("p_partkey", c.sampled(F.col("p_size"), (F.col("p_partkey") % 9).cast("int")).alias("s"))
    return part.select("p_partkey", F.array_join(F.transform("s", lambda x: x.cast("string")), ",").alias("symbols"))


def overridden_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Profiles with the label, clearance or outer radius that a part sets, where the bands still fit."""
    k = F.col("p_partkey")
    part = _table(spark, sf_dir, "part").select("p_partkey", (k % 4).cast("int").alias("code"), F.when(k % 3 == 0, F.col("p_size") * 6 - 12).alias("label"), F.when(k % 5 == 0, k % 40).alias("clearance"), F.when(k % 7 == 0, F.col("p_size") + 200).alias("outer"))
    both = part.join(F.broadcast(geometry.profiles(spark)), "code")  # four rows
    found = geometry.overridden(F.coalesce("label", "label_radius"), F.coalesce("clearance", F.col("inner_radius") - F.col("label_radius")), F.coalesce("outer", "outer_radius"), 12)
    return both.select("p_partkey", found.alias("g")).select("p_partkey", "g.label_radius", "g.inner_radius", "g.outer_radius")


def codec_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codec metadata as compact JSON in the order of its wire names, and what the stream's rule says of it."""
    k = F.col("p_partkey")
    fields = {"m": F.col("p_brand"), "nc": F.col("p_size"), "lm": k % 2 == 0, "fp": k, "mr": k % 7, "acv": k % 3, "fl": k * 2}
    text = F.to_json(F.struct(*(v.alias(n) for n, v in fields.items())))
    return _table(spark, sf_dir, "part").select("p_partkey", text.alias("json"), report.json_shape(text)["members"].alias("members"))


def chunk_aads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What binds a stream's encrypted chunks to its metadata, for every order's stream: how long its metadata and the associated data are, and a digest of the latter."""
    made = order_streams(spark, sf_dir)
    size = c.u32be(F.col("content"), 4)
    framed = made.select("path", F.substring(F.col("content"), F.lit(9), size.cast("int")).alias("meta"))
    aad = c.chunk_aad(b"aad-1", F.col("meta"))
    return framed.select(_key(framed), F.octet_length("meta").cast("bigint").alias("n"), F.octet_length(aad).cast("bigint").alias("aad_bytes"), F.sha2(aad, 256).alias("aad_sha256"))


_P = geometry.MILLIMETRES
_STREAMS = """l AS (SELECT l_orderkey AS o, l_linenumber, CAST(l_quantity AS BIGINT) AS len, count(*) OVER (PARTITION BY l_orderkey) AS n,
        row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, CAST(l_quantity AS BIGINT)) - 1 AS idx FROM lineitem),
    t AS (SELECT *, CAST(sum(len) OVER (PARTITION BY o ORDER BY idx) - len AS BIGINT) AS pos FROM l),
    r AS (SELECT o, any_value(n) AS n, o % 11 AS s, CASE WHEN o % 5 = 0 AND any_value(n) >= 3 THEN any_value(n) - 1 ELSE any_value(n) END AS p,
        CAST(sum(len) AS BIGINT) AS total, any_value(len) FILTER (WHERE idx = 0) + 1 AS cut FROM l GROUP BY o),
    e AS (SELECT *, 1000 + o % 7 AS samples, CASE WHEN p >= 3 THEN 2 ELSE 1 END AS n_tracks,
        CASE WHEN s = 0 THEN 'stream magic is invalid' WHEN s = 1 THEN 'there is no chunk, or a chunk''s CRC is wrong' WHEN s = 2 THEN 'metadata has 1 trailing bytes'
             WHEN s = 3 THEN 'entry lengths do not add up to the payload' WHEN s = 4 AND p >= 3 THEN 'a revolution is not covered'
             WHEN s = 5 AND p >= 3 THEN 'a revolution is covered twice' WHEN s = 6 THEN 'track 0 is untitled, empty or out of range' END AS error FROM r),
    c AS (SELECT t.o, t.idx, t.pos, t.len AS b FROM t JOIN e USING (o) WHERE error IS NULL AND s <> 7
        UNION ALL SELECT o, 0, 0, least(cut, total) FROM e WHERE s = 7 UNION ALL SELECT o, 1, cut, total - cut FROM e WHERE s = 7 AND cut < total),
    h AS (SELECT o, 8 + 2 + 1 + 31 + 8 + CASE WHEN o % 2 = 0 THEN 5 ELSE 0 END + 2 + 2 * n + 2 + n_tracks * (4 + strlen('Side ' || o || '-1')) + 2 + CASE WHEN p >= 3 AND s <> 4 THEN 3 ELSE 0 END AS head FROM e),
    f AS (SELECT o, idx, pos, b, 4 + CASE WHEN b >= 128 THEN 2 ELSE 1 END AS frame, head FROM c JOIN h USING (o)),
    g AS (SELECT *, CAST(head + pos + sum(frame) OVER (PARTITION BY o ORDER BY idx) AS BIGINT) AS body FROM f),
    x AS (SELECT o, idx, pos, pos + b AS until FROM c WHERE NOT EXISTS (SELECT 1 FROM t WHERE t.o = c.o AND c.pos >= t.pos AND c.pos + c.b <= t.pos + t.len))"""
_32 = "'0123456789ABCDEFGHJKMNPQRSTVWXYZ'"
_SYMBOLS = "array_to_string(list_transform(range({n} - 1, -1, -1), lambda i: substr(" + _32 + ", CAST(({v} >> CAST(5 * i AS INT)) & 31 AS INT) + 1, 1)), '')"
_RADIUS = "CAST(floor(least(greatest((281.0::DOUBLE - sqrt(greatest(281.0::DOUBLE * 281.0 - ({f}) * (281.0::DOUBLE * 281.0 - 115.0::DOUBLE * 115.0), 0.0))) / (281.0 - 115.0), 0.0), 1.0) * 1e6 + 0.5) AS BIGINT)"
_MUL = "CAST((((CAST({z} >> 32 AS HUGEINT) * {c}) % 4294967296) * 4294967296 + (CAST({z} & 4294967295::UBIGINT AS HUGEINT) * {c}) % 18446744073709551616) % 18446744073709551616 AS UBIGINT)"


def _draw(k: int) -> str:
    """The k-th draw as steps of common table expressions over ``seeds``."""
    first = _MUL.format(z="a", c=0xBF58476D1CE4E5B9)
    second = _MUL.format(z="b", c=0x94D049BB133111EB)
    return f"""s{k} AS (SELECT o, CAST((seed + {0x9E3779B97F4A7C15 * k % 2**64}::HUGEINT) % 18446744073709551616 AS UBIGINT) AS z FROM seeds),
        u{k} AS (SELECT o, xor(z, z >> 30) AS a FROM s{k}), v{k} AS (SELECT o, {first} AS m FROM u{k}), w{k} AS (SELECT o, xor(m, m >> 27) AS b FROM v{k}),
        y{k} AS (SELECT o, {second} AS m FROM w{k}), d{k} AS (SELECT o, xor(m, m >> 31) AS draw FROM y{k})"""


def _leb(value: str) -> str:
    """Hexadecimal of a number below 16,384 as LEB128 in SQL."""
    return f"CASE WHEN {value} < 128 THEN lpad(to_hex({value}), 2, '0') ELSE lpad(to_hex(({value}) % 128 + 128), 2, '0') || lpad(to_hex(({value}) // 128), 2, '0') END"


def _tlv(tag: int, value: str | None) -> str:
    """Hexadecimal of a tag, a length and a value that is itself hexadecimal in SQL."""
    return f"'{tag:02x}00000000'" if value is None else f"'{tag:02x}' || lpad(to_hex(length({value}) // 2), 8, '0') || {value}"


_IDENTITY = " || ".join([
    f"'{_RELEASE.hex()}0401' || '3fd999999999999a'",
    _tlv(1, "hex(encode(['single45', 'lp', 'ten', 'single45vintage'][p_partkey % 4 + 1]))"),
    "lpad(to_hex(CAST(p_size * 10 AS BIGINT)), 16, '0')",
    _tlv(2, "hex(encode('rgb'))"), _tlv(3, "hex(encode(p_name))"), _tlv(4, "hex(encode(p_brand))"),
    *(_tlv(t, None) for t in range(5, 10)),
    _tlv(10, "lpad(to_hex(p_partkey * 1000), 16, '0')"), _tlv(11, None), _tlv(12, None),
    _tlv(13, "lpad(to_hex(CAST(p_size + 1900 AS BIGINT)), 4, '0')"), _tlv(14, None), _tlv(15, None),
])

ORACLE_SQL = {
    "descriptor_identities": f"""WITH i AS (SELECT p_partkey, sha256(unhex({_IDENTITY})) AS s FROM part WHERE p_partkey % 13 > 2)
        SELECT p_partkey, s AS identity_sha256, sha256(unhex('{_DEFERRED.hex()}' || s || {_tlv(1, None)} || {_tlv(2, "'0000'")} || {_tlv(3, None)})) AS deferred_sha256 FROM i""",
    "signature_states": """SELECT s_suppkey, 'release' AS role, CASE WHEN s_suppkey % 6 < 5 THEN 'k' || s_suppkey % 6 END AS key_name,
        ['Invalid', 'UntrustedKey', 'Unsupported', 'Unsupported', 'UntrustedKey', 'Missing'][s_suppkey % 6 + 1] AS status FROM supplier""",
    "silent_extents": """WITH d AS (SELECT o_orderkey, o_orderkey AS o, o_orderkey % 3 = 0 AS claimed_, CAST(o_orderkey % 200 + 100 AS BIGINT) AS outer_, CAST(o_orderkey % 7 * 50 AS BIGINT) AS inner_ FROM orders),
        g AS (SELECT *, inner_ < outer_ AND (claimed_ OR o % 11 <> 0) AND (NOT claimed_ OR o % 1500 <= o % 1000 AND o % 4 <> 0) AS good FROM d)
        SELECT o_orderkey, CASE WHEN good THEN outer_ END AS outer, CASE WHEN good THEN inner_ END AS inner, CASE WHEN good THEN o % 5000 END AS pixels, CASE WHEN good THEN CAST(o % 3 AS INT) END AS encoding,
            CASE WHEN good THEN o % 1000 END AS bytes, CASE WHEN good THEN CASE WHEN claimed_ THEN o % 1500 ELSE 0 END END AS claimed, CASE WHEN good AND claimed_ THEN 'TAG1' END AS claim FROM g""",
    "descriptor_differences": """WITH l AS (SELECT *, row_number() OVER w - 2 AS idx, lag(l_returnflag) OVER w AS codec, lag(l_linenumber) OVER w % 2 AS channels, CAST(lag(l_quantity) OVER w AS BIGINT) AS samples, lag(nullif(l_linestatus, 'O')) OVER w AS meta
            FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_returnflag, l_quantity))
        SELECT l_orderkey, CAST(idx AS INT) AS idx, CASE WHEN codec IS DISTINCT FROM l_returnflag THEN 'codec' WHEN channels IS DISTINCT FROM l_linenumber % 2 THEN 'channels' WHEN samples IS DISTINCT FROM CAST(l_quantity AS BIGINT) THEN 'output_samples'
            WHEN meta IS DISTINCT FROM nullif(l_linestatus, 'O') THEN 'codec_metadata' END AS field FROM l WHERE idx >= 0""",
    "json_shapes": """SELECT event_id, CASE WHEN json_valid(props) THEN CASE json_type(props) WHEN 'OBJECT' THEN 'object' WHEN 'ARRAY' THEN 'array' ELSE 'scalar' END END AS kind,
        CASE WHEN json_valid(props) THEN CASE json_type(props) WHEN 'OBJECT' THEN CAST(len(json_keys(props)) AS INT) WHEN 'ARRAY' THEN CAST(json_array_length(props) AS INT) ELSE 0 END END AS members FROM events""",
    "palette_samples": """WITH p AS (SELECT p_partkey, CAST(p_size AS BIGINT) AS n, p_partkey % 9 AS k FROM part)
        SELECT p_partkey, array_to_string(CASE WHEN n <= k THEN range(0, n) WHEN k <= 1 THEN [0] ELSE list_transform(range(0, k), lambda i: i * (n - 1) // (k - 1)) END, ',') AS symbols FROM p""",
    "overridden_bands": "WITH m(code, finished, outside, inside, margin, label) AS (VALUES "
    + ", ".join(f"({geometry.CODES[k]}, {v[0]}::DOUBLE, {v[2]}::DOUBLE, {v[3]}::DOUBLE, {v[1]}::DOUBLE, {v[4]}::DOUBLE)" for k, v in _P.items())
    + """), s AS (SELECT *, 287 / (finished / 2) AS scale FROM m),
        q AS (SELECT code, CAST(round(label / 2 * scale) AS INT) AS l, CAST(round(inside / 2 * scale) AS INT) AS i, CAST(286 - round(margin / 2 * scale) + round(outside / 2 * scale) AS INT) AS o FROM s),
        p AS (SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN p_size * 6 - 12 ELSE l END AS label, CASE WHEN p_partkey % 5 = 0 THEN p_partkey % 40 ELSE i - l END AS clearance, CASE WHEN p_partkey % 7 = 0 THEN p_size + 200 ELSE o END AS outer_ FROM part JOIN q ON q.code = p_partkey % 4),
        g AS (SELECT *, label >= 1 AND clearance >= 12 AND label + clearance < outer_ AS good FROM p)
        SELECT p_partkey, CASE WHEN good THEN CAST(label AS INT) END AS label_radius, CASE WHEN good THEN CAST(label + clearance AS INT) END AS inner_radius, CASE WHEN good THEN CAST(outer_ AS INT) END AS outer_radius FROM g""",
    "codec_metadata": """SELECT p_partkey, '{"m":"' || p_brand || '","nc":' || p_size || ',"lm":' || CASE WHEN p_partkey % 2 = 0 THEN 'true' ELSE 'false' END || ',"fp":' || p_partkey || ',"mr":' || p_partkey % 7 || ',"acv":' || p_partkey % 3 || ',"fl":' || p_partkey * 2 || '}' AS json, 7 AS members FROM part""",
    "chunk_aads": f"""WITH {_STREAMS}, b AS (SELECT o, string_agg({_leb("len")} || CASE WHEN idx >= p THEN '01' ELSE '00' END, '' ORDER BY idx) AS entries FROM t JOIN e USING (o) GROUP BY o),
        d AS (SELECT *, CASE WHEN s = 6 THEN '000120' ELSE lpad(to_hex(strlen('Side ' || o || '-1')), 4, '0') || hex(encode('Side ' || o || '-1')) END AS one,
            CASE WHEN s = 6 THEN '000120' ELSE lpad(to_hex(strlen('Side ' || o || '-2')), 4, '0') || hex(encode('Side ' || o || '-2')) END AS two, CASE WHEN s = 5 THEN p - 2 ELSE p - 1 END AS late FROM e JOIN b USING (o)),
        m AS (SELECT o, unhex('020E02' || '011F' || '0004' || hex(encode('ECDC')) || '0000BB80' || '02' || lpad(to_hex(samples + 9), 8, '0') || '00000005' || lpad(to_hex(samples), 8, '0') || '00000002' || hex(encode('{{}}'))
            || 'FF' || '0004' || hex(encode('NOTE')) || CASE WHEN o % 2 = 0 THEN '06' || '0000BB80' || '02' ELSE '00' END || lpad(to_hex(n), 4, '0') || entries
            || CASE WHEN p >= 3 THEN '0002' || one || '00' || {_leb("p - 2")} || two || {_leb("late")} || {_leb("p - late")} ELSE '0001' || one || '00' || {_leb("p")} END
            || CASE WHEN p >= 3 AND s <> 4 THEN '0001' || {_leb("p - 2")} || '0100' ELSE '0000' END || CASE WHEN s = 2 THEN '00' ELSE '' END) AS meta FROM d)
        SELECT o AS l_orderkey, octet_length(meta) AS n, octet_length(meta) + 9 AS aad_bytes, sha256(encode('aad-1') || unhex(lpad(to_hex(octet_length(meta)), 8, '0')) || meta) AS aad_sha256 FROM m""",
    "stream_errors": f"WITH {_STREAMS} SELECT o AS l_orderkey, CASE WHEN s = 3 AND total = 1 THEN 'chunk at byte ' || head || ' is empty' ELSE error END AS error FROM e JOIN h USING (o)",
    "stream_entries": f"""WITH {_STREAMS} SELECT o AS l_orderkey, CAST(idx AS INT) AS idx, len AS byte_length, pos AS byte_offset, CAST(idx >= p AS INT) AS descriptor_idx,
        CASE WHEN idx < p THEN samples END AS samples, sha256(repeat(chr(CAST(97 + l_linenumber % 26 AS INT)), len)) AS sha256 FROM t JOIN e USING (o) WHERE error IS NULL""",
    "stream_chunks": f"WITH {_STREAMS} SELECT o AS l_orderkey, CAST(idx AS INT) AS idx, body - frame AS start, body AS payload_start, body + b AS payload_end, body + b AS \"end\", true AS crc_ok FROM g",
    "stream_regions": f"""WITH {_STREAMS}, q AS (SELECT * FROM e WHERE error IS NULL AND n = p),
        z AS (SELECT o, 1 AS ord, 'track' AS kind, 1 AS number, 0 AS a, CASE WHEN p >= 3 THEN p - 2 ELSE p END AS b FROM q
            UNION ALL SELECT o, 2, 'gap', 1, p - 2, p - 1 FROM q WHERE p >= 3 UNION ALL SELECT o, 3, 'track', 2, p - 1, p FROM q WHERE p >= 3),
        w AS (SELECT z.*, (SELECT pos FROM t WHERE t.o = z.o AND t.idx = z.a) AS byte_start, (SELECT pos + len FROM t WHERE t.o = z.o AND t.idx = z.b - 1) AS byte_end FROM z)
        SELECT w.o AS l_orderkey, CAST(ord AS BIGINT) AS ord, kind, CAST(number AS INT) AS number, CASE WHEN kind = 'track' THEN 'Side ' || w.o || '-' || number END AS title, CAST(a * samples AS BIGINT) AS start_sample, CAST(b * samples AS BIGINT) AS end_sample,
            CAST(48000 AS BIGINT) AS sample_rate, CAST(2 AS INT) AS channels, byte_start, byte_end, {_RADIUS.format(f="byte_start / total")} AS micros_start, {_RADIUS.format(f="byte_end / total")} AS micros_end FROM w JOIN q USING (o)""",
    "stream_summary": f"""WITH {_STREAMS}, k AS (SELECT o, count(*) AS n_chunks, CAST(max(body + b) AS BIGINT) AS stream_len FROM g GROUP BY o)
        SELECT o AS l_orderkey, false AS encrypted, stream_len, 2 AS n_descriptors, CAST(n AS INT) AS n_entries, CAST(n_tracks AS INT) AS n_tracks, CAST(n_chunks AS INT) AS n_chunks, total AS payload_bytes,
            CASE WHEN n = p THEN CAST(n * samples AS BIGINT) END AS total_samples FROM e JOIN k USING (o) WHERE error IS NULL""",
    "stream_chunks_across": f"WITH {_STREAMS} SELECT o AS l_orderkey, CAST(idx AS INT) AS idx, pos AS first_byte, until AS last_byte FROM x",
    "stream_checks": f"""WITH {_STREAMS}, a AS (SELECT e.*, error IS NULL AS ok, o IN (SELECT o FROM x) AS crossed FROM e),
        k AS (SELECT unnest([{{'label': 'chunk checksums agree', 'ok': ok}}, {{'label': 'chunks lie inside entries', 'ok': ok AND NOT crossed}}, {{'label': 'entries add up to the payload', 'ok': ok}},
            {{'label': 'descriptors, tracks and gaps keep the rules', 'ok': ok}}, {{'label': 'sample rate and channels are stated', 'ok': ok AND o % 2 = 0}},
            {{'label': 'programme has a map', 'ok': ok AND n = p}}, {{'label': 'stream parses', 'ok': ok}}]) AS k FROM a)
        SELECT k.label AS label, count(*) FILTER (WHERE k.ok) AS passed, count(*) FILTER (WHERE NOT k.ok) AS failed FROM k GROUP BY ALL""",
    "descriptor_scan": """WITH d AS (SELECT *, CASE p_partkey % 13 WHEN 0 THEN 'descriptor CRC is wrong' WHEN 1 THEN 'record_profile 9 is unknown' WHEN 2 THEN 'segment 5 is repeated' END AS error FROM part)
        SELECT p_partkey, CASE WHEN error IS NULL THEN p_name END AS title, CASE WHEN error IS NULL THEN p_brand END AS artist,
            CASE WHEN error IS NULL THEN ['single45', 'lp', 'ten', 'single45vintage'][p_partkey % 4 + 1] END AS record_profile, CASE WHEN error IS NULL THEN 'rgb' END AS payload_encoding,
            CASE WHEN error IS NULL THEN CAST(p_size * 10 AS BIGINT) END AS stream_byte_length, CASE WHEN error IS NULL THEN p_partkey * 1000 END AS created_at, CASE WHEN error IS NULL THEN p_size + 1900 END AS copyright_year,
            CASE WHEN error IS NULL THEN p_partkey % 2 = 1 END AS clockwise, CASE WHEN error IS NULL THEN 0.4::DOUBLE END AS b_value, CASE WHEN error IS NULL THEN 113 END AS cut_inner_radius, CASE WHEN error IS NULL THEN 0.9::DOUBLE END AS silent_groove_b_value,
            CASE WHEN error IS NULL THEN '0:1:4,1:2:4,2:4:1,3:5:' || strlen(p_name) || ',4:6:' || strlen(p_brand) || ',5:7:1,6:14:8,7:24:2,8:34:1,9:99:' || strlen(p_type) END AS segments, error FROM d""",
    "package_scan": """WITH d AS (SELECT *, CASE s_suppkey % 5 WHEN 0 THEN 'section 1 digest is wrong' WHEN 1 THEN 'descriptor and stream disagree on the stream''s length' WHEN 2 THEN 'package lengths are not canonical' END AS error FROM supplier)
        SELECT s_suppkey, error, CASE WHEN error IS NULL THEN false END AS has_sidecar, CASE WHEN error IS NULL THEN 2 END AS n_sections,
            CASE WHEN error IS NULL THEN 54 + strlen(s_name) END AS descriptor_bytes, CASE WHEN error IS NULL THEN 57 + strlen(s_name) + s_suppkey % 50 END AS stream_bytes FROM d""",
    "varuint_scan": """WITH v AS (SELECT o_orderkey, o_custkey * o_orderkey * o_orderkey AS v FROM orders), k AS (SELECT *, CAST(ceil(length(bin(v)) / 7.0) AS INT) AS k FROM v)
        SELECT o_orderkey, '07' || array_to_string(list_transform(range(0, k), lambda i: printf('%02x', ((v >> CAST(7 * i AS INT)) & 127) + CASE WHEN i < k - 1 THEN 128 ELSE 0 END)), '') AS wire,
            CASE WHEN o_orderkey % 3 <> 0 THEN v END AS value, CASE WHEN o_orderkey % 3 <> 0 THEN CAST(1 + k AS BIGINT) END AS next_byte FROM k""",
    "typed_ids": f"""WITH e AS (SELECT event_id, event_id * 86400007 AS m, sha256(CAST(event_id AS VARCHAR)) AS h FROM events),
        b AS (SELECT *, CAST('0x' || h[1:10] AS BIGINT) AS x, CAST('0x' || h[11:20] AS BIGINT) AS y FROM e),
        n AS (SELECT event_id, m, 'trk_' || {_SYMBOLS.format(n=10, v="m")} || {_SYMBOLS.format(n=8, v="x")} || {_SYMBOLS.format(n=8, v="y")} AS id FROM b)
        SELECT event_id, id, CASE WHEN event_id % 4 > 1 THEN 'track' END AS kind, m AS millis, lower(id[15:19] || '-' || id[20:24] || '-' || id[25]) AS slug, 'YL ' || id[15:19] || '-' || id[20:24] || '-' || id[25] AS label FROM n""",
    "track_codes": """WITH b AS (SELECT c_custkey, 'us-' || c_mktsegment[1:3] || '-' || lpad(CAST(c_custkey AS VARCHAR), 7, '0') AS body FROM customer)
        SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN body || '1' WHEN 1 THEN lower(body) ELSE ' ' || body END AS written, CASE WHEN c_custkey % 3 <> 0 THEN upper(replace(body, '-', '')) END AS code FROM b""",
    "profile_lookup": "WITH m(code, profile, finished, margin, outside, inside, label, lock) AS (VALUES "
    + ", ".join(f"({geometry.CODES[k]}, '{k}', {', '.join(f'{x}::DOUBLE' for x in v)}, {geometry.LOCK_7_MM if k.startswith('single45') else geometry.LOCK_10_12_MM}::DOUBLE)" for k, v in _P.items())
    + """), s AS (SELECT *, 287 / (finished / 2) AS scale FROM m),
        r AS (SELECT code, profile, scale, CAST(round(label / 2 * scale) AS INT) AS label_radius, CAST(round(inside / 2 * scale) AS INT) AS inner_radius, CAST(round(margin / 2 * scale) - round(outside / 2 * scale) AS INT) AS lead_in_px, lock * scale AS lock FROM s),
        q AS (SELECT *, 286 - lead_in_px AS outer_radius, CAST(ceil(lock + 3.2::DOUBLE * scale + 6.0) AS INT) AS floor_radius FROM r),
        p AS (SELECT p_partkey, CAST(p_partkey % 4 AS INT) AS code, p_size / 20.0::DOUBLE AS pitch, (p_partkey % 5) / 4.0::DOUBLE AS share FROM part),
        t AS (SELECT *, (outer_radius - inner_radius) / ((2 * pi()) * pitch) AS turns, CAST(greatest(least(floor_radius, inner_radius), 1) AS DOUBLE) AS low FROM p JOIN q USING (code))
        SELECT p_partkey, profile, label_radius, inner_radius, outer_radius, lead_in_px, CAST(floor(scale * 1e6 + 0.5) AS BIGINT) AS px_per_mm_micros, CAST(floor(lock * 1e6 + 0.5) AS BIGINT) AS lock_micros, CAST(floor(turns * 1e6 + 0.5) AS BIGINT) AS turns_micros,
            CAST(floor((2 * pi()) * pitch * 1e6 + 0.5) AS BIGINT) AS width_micros, CAST(floor(greatest((outer_radius - inner_radius) / ((2 * pi()) * turns), 1e-7) * 1e6 + 0.5) AS BIGINT) AS pitch_micros,
            CASE WHEN share > 0 THEN CAST(greatest(floor(outer_radius - (outer_radius - low) * share + 0.5), ceil(low)) AS INT) END AS stop FROM t""",
    "pixel_places": """WITH v AS (SELECT vec_id, CAST(vec_id * 37 % 576 AS DOUBLE) AS x, CAST(vec_id * 101 % 576 AS DOUBLE) AS y, CAST(vec_id * 3 % 256 AS DOUBLE) AS r, CAST(vec_id * 5 % 256 AS DOUBLE) AS g, CAST(vec_id * 7 % 256 AS DOUBLE) AS b FROM embeddings),
        a AS (SELECT *, pi() / 2 - atan2(288.0 - y, x - 288.0) AS angle, 0.2126::DOUBLE * r + 0.7152::DOUBLE * g + 0.0722::DOUBLE * b AS luma FROM v)
        SELECT vec_id, CAST(floor((angle - floor(angle / (2 * pi())) * (2 * pi())) * 1e6 + 0.5) AS BIGINT) AS angle_micros, CAST(floor(sqrt((x - 288.0) ** 2 + (288.0 - y) ** 2) / 288.0::DOUBLE * 1e6 + 0.5) AS BIGINT) AS radius_micros,
            CAST(floor(luma * 1e6 + 0.5) AS BIGINT) AS luma_micros, CAST(floor((b - luma) / 1.8556::DOUBLE * 1e6 + 0.5) AS BIGINT) AS blue_micros, CAST(floor((r - luma) / 1.5748::DOUBLE * 1e6 + 0.5) AS BIGINT) AS red_micros FROM a""",
    "seeded_draws": f"""WITH seeds AS (SELECT o_orderkey AS o, CAST(o_orderkey * 1000003 AS HUGEINT) AS seed FROM orders), {_draw(1)}, {_draw(2)}
        SELECT d1.o AS o_orderkey, lpad(lower(to_hex(d1.draw)), 16, '0') AS draw_1, lpad(lower(to_hex(d2.draw)), 16, '0') AS draw_2, CAST(floor(CAST(d1.draw >> 11 AS DOUBLE) / 9007199254740992.0::DOUBLE * 1e9) AS BIGINT) AS unit_nanos FROM d1 JOIN d2 USING (o)""",
    "entry_digests": """WITH t AS (SELECT conv_id, turn, sha256(coalesce(text, '')) AS entry, unhex(lpad(to_hex(conv_id), 32, '0')) AS release FROM conversations),
        d AS (SELECT conv_id, turn, release, sha256(encode('revolution' || chr(10)) || release || unhex(lpad(to_hex(CAST(turn AS BIGINT)), 8, '0')) || unhex(entry)) AS digest FROM t),
        r AS (SELECT conv_id, count(*) AS n, arg_min(digest, turn) AS first_sha256, any_value(release) AS release, sha256(CAST(conv_id AS VARCHAR)) AS stream, string_agg(digest, '' ORDER BY turn) AS digests FROM d GROUP BY conv_id)
        SELECT conv_id, n, first_sha256, sha256(encode('release-1' || chr(10)) || release || unhex('0100' || stream || lpad(to_hex(n), 8, '0') || digests)) AS release_sha256,
            sha256(encode('release-2' || chr(10)) || release || unhex('0100' || stream || sha256(unhex(stream)) || lpad(to_hex(n), 8, '0') || digests)) AS release_v2_sha256 FROM r""",
    "gap_sizes": """WITH o AS (SELECT o_orderkey, o_totalprice / 20000 AS s, ['single45', 'ten', 'lp', 'single45vintage'][o_orderkey % 4 + 1] AS profile, [4 / 3.0::DOUBLE, 4 / 3.0::DOUBLE, 9 / 5.0::DOUBLE, NULL][o_orderkey % 4 + 1] AS rev FROM orders),
        t AS (SELECT *, CAST(floor(s * 48000 + 0.5) AS BIGINT) AS samples, CASE WHEN s > 0 AND rev IS NOT NULL THEN least(greatest(s / rev, 0.25), 8.0) END AS turns FROM o)
        SELECT o_orderkey, profile, CASE WHEN s > 0 AND samples BETWEEN 1 AND 192000 * 3600 THEN samples END AS samples, CAST(floor(turns * 1e6 + 0.5) AS BIGINT) AS turn_micros, CASE WHEN turns IS NOT NULL THEN CAST(greatest(round(turns * 1500) * 3, 28) AS BIGINT) END AS gap_bytes FROM t""",
    "segment_budget": """WITH o AS (SELECT o_custkey, o_orderkey, CAST(ceil(greatest(floor(o_totalprice), 1) / 640) AS BIGINT) AS track_segments, CASE WHEN o_orderkey % 4 > 0 THEN CAST(greatest(round((o_orderkey % 4) / 2.0 * 1000), 1) AS BIGINT) ELSE 0 END AS gap_samples FROM orders),
        g AS (SELECT *, CAST(ceil(gap_samples / 640) AS BIGINT) AS gap_segments FROM o)
        SELECT o_custkey, o_orderkey, track_segments, gap_samples, gap_segments, CAST(coalesce(sum(track_segments + gap_segments) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS first_segment FROM g""",
}

QUERIES = {f.__name__: f for f in (stream_errors, stream_entries, stream_chunks, stream_regions, stream_summary, stream_chunks_across, stream_checks, descriptor_scan, package_scan, varuint_scan, typed_ids, track_codes, profile_lookup, pixel_places, seeded_draws, entry_digests, gap_sizes, segment_budget, descriptor_identities, signature_states, silent_extents, descriptor_differences, json_shapes, palette_samples, overridden_bands, codec_metadata, chunk_aads)}

__all__ = ["ORACLE_SQL", "QUERIES", "order_streams", "part_descriptors"]
