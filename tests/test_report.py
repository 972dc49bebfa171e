"""Check tables and JSON over hand-built records."""

import json
from hashlib import sha256

from pyspark.sql import functions as F

from platterlake.plans import report
from platterlake.sources import descriptors, streams
from tests.test_sources import descriptor, envelope, files, stream


def test_checks_and_json(spark):
    good = stream()
    found = streams.parsed(files(spark, good, stream(cut=(6, 2, 4, 4, 4)), good[:-1])).cache()
    described = descriptors.descriptors(files(spark, descriptor([(5, b"T"), (16, envelope())], stream_len=len(good)), descriptor(stream_len=5), b"x")).cache()
    rows = {(r.path, r.label): r.ok for r in report.stream_checks(found).collect()}
    assert len(rows) == 21 and all(ok for (p, _), ok in rows.items() if p == "f0") and not any(ok for (p, _), ok in rows.items() if p == "f2")
    assert [k for k, ok in rows.items() if k[0] == "f1" and not ok] == [("f1", "chunks lie inside entries")]
    assert {r.label: (r.passed, r.failed) for r in report.tally(report.record_checks(found, described)).collect()}["stream is as long as described"] == (1, 2)
    cover = {r.field: (r.present, r.covered) for r in report.signing_coverage(described).where("path = 'f0'").collect()}
    assert cover["title"] == (True, True) and cover["artist"] == (False, False) and cover["upc"] == (False, False)
    one = json.loads(report.stream_json(found).where("path = 'f0'").first()["json"])
    assert one["tracks"][0]["title"] == "One" and len(one["entries"][0]["sha256"]) == 64
    assert json.loads(report.descriptor_json(described).where("path = 'f0'").first()["json"])["title"] == "T"
    rows = report.manifest(found, described).cache()
    values = {(r.section, r.label): r.value for r in rows.where("path = 'f0'").collect()}
    assert (values["AUDIO", "n_entries"], values["IDENTITY", "title"], values["PROGRAMME", "2 gap 1"], values["CHECKS", "stream parses"]) == ("5", "T", "128000-192000", "true")
    assert {s for (s, _) in values} == {"RECORD", "IDENTITY", "AUDIO", "PROGRAMME", "CHECKS"}
    whole = json.loads(report.manifest_json(rows).where("path = 'f0'").first()["json"])
    assert whole["checks_passed"] == 10 and whole["checks_failed"] == 0 and len(whole["rows"]) == len(values)
    regions = json.loads(report.programme_json(found).where("path = 'f0'").first()["json"])
    assert [r["ord"] for r in regions["tracks"]] == [1, 3] and [r["ord"] for r in regions["gaps"]] == [2]
    assert (regions["sample_rate"], regions["total_samples"], regions["gaps"][0]["start_ms"]) == (48_000, 320_000, 128_000 / 48)


def test_every_descriptor_states_rate_and_channels(spark):
    found = streams.parsed(files(spark, stream()))
    silent = F.transform("payload_descriptors", lambda d: d.withField("channels", F.lit(None).cast("int")))
    part = found.withColumns({"path": F.lit("part"), "payload_descriptors": F.concat("payload_descriptors", silent)})
    label = "sample rate and channels are stated"
    assert {r.path: r.ok for r in report.stream_checks(found.unionByName(part)).where(F.col("label") == label).collect()} == {"f0": True, "part": False}


def test_findings_by_descriptor_and_entry(spark):
    """Each family of checks at its fault; a part that says nothing is broken, not unknown."""
    found = streams.parsed(files(spark, stream(), b"x")).withColumn("error", F.coalesce("error", F.lit(None).cast("string")))
    rows = {(r.path, r.label, r.idx): (r.ok, r.detail) for r in report.findings(found, F.lit("lp")).collect()}
    assert [k for k in rows if k[0] == "f1"] == [("f1", "stream parses", None)] and not rows["f1", "stream parses", None][0]
    assert all(ok for (p, _, _), (ok, _) in rows.items() if p == "f0") and rows["f0", "record profile", None] == (True, "lp")
    music = F.lit("ECDC")
    bare = lambda d: F.struct(*(F.lit(v).cast(t).alias(n) for n, t, v in (("idx", "int", 0), ("container", "string", "ecdc"), ("codec", "string", None), ("sample_rate", "bigint", 0), ("channels", "int", None), ("block_samples", "bigint", None), ("output_offset_samples", "bigint", None), ("output_samples", "bigint", None), ("codec_metadata", "string", "{"))))
    spoiled = found.where("path = 'f0'").withColumn("payload_descriptors", F.transform("payload_descriptors", lambda d, i: F.when(i == 0, bare(d)).otherwise(d.withField("container", F.lit("GAP")).withField("codec", music))))
    spoiled = spoiled.withColumn("entries", F.transform("entries", lambda e: e.withField("samples", F.lit(0).cast("bigint")).withField("byte_length", e["byte_length"] + 1)))
    bad = {(r.label, r.idx): r.detail for r in report.findings(spoiled, F.lit("unheard of")).where("not ok").collect()}
    assert bad["music is described", 0] == "codec is not ECDC; sample rate is not stated; channels are not stated; output range is not stated; codec metadata is not JSON"
    assert bad["record profile", None] == "profile unheard of is unknown" and bad["bytes of the entries", None].startswith("entries hold ")
    assert bad["music has a length", 0] == "entry has no samples"
    wide = found.where("path = 'f0'").withColumn("payload_descriptors", F.transform("payload_descriptors", lambda d: d.withField("output_samples", d["block_samples"] + 1)))
    assert {r.detail for r in report.findings(wide).where("not ok and label = 'descriptor is valid'").collect()} == {"output range is outside its block"}
    assert report.findings(found.limit(0)).collect() == []


def test_findings_of_many_entries(spark):
    """65,535 entries of one record are as many rows, by one pass."""
    found = streams.parsed(files(spark, stream())).withColumn("entries", F.transform(F.sequence(F.lit(0), F.lit(65_534)), lambda i: F.get("entries", F.lit(0)).withField("idx", i)))
    got = report.findings(found).where("label = 'music has a length'")
    assert got.agg(F.count("*"), F.count_distinct("idx")).first()[:] == (65_535, 65_535)


def test_one_document_of_a_record(spark):
    good = stream()
    raw = files(spark, good, b"", good[:-1]).union(spark.createDataFrame([("f3", None)], "path string, content binary"))
    found = streams.parsed(raw)
    described = descriptors.descriptors(files(spark, descriptor([(5, b"T")], stream_len=len(good))))
    docs = {r.path: json.loads(r.json) for r in report.record_json(raw, found, described).collect()}
    one, parsed = docs["f0"], found.where("path = 'f0'").first()
    payload = b"".join(good[c.payload_start : c.payload_end] for c in parsed.chunks)
    assert one["record"] == {"byte_length": len(good), "sha256": sha256(good).hexdigest()}
    assert one["stream"]["payload_sha256"] == sha256(payload).hexdigest() and one["stream"]["payload_bytes"] == len(payload)
    assert [c["sha256"] for c in one["stream"]["chunks"]] == [sha256(good[c.payload_start : c.payload_end]).hexdigest() for c in parsed.chunks]
    assert one["descriptor"]["title"] == "T"
    assert "stream" not in docs["f2"] and docs["f2"]["record"]["error"] and docs["f1"]["record"]["sha256"] == docs["f3"]["record"]["sha256"] == sha256(b"").hexdigest()
    assert "descriptor" not in json.loads(report.record_json(raw, found).where("path = 'f0'").first()["json"])
