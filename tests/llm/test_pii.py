"""Personal data against brute force by Python's own engine."""

import random
import re
import time

from pyspark.sql import functions as F

from platterlake.llm import pii

SCHEMA = "doc_id bigint, text string, voted string, row string"


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def slow(text):
    """By kind, the contract's spans, with its patterns as written."""
    digits = lambda m: re.sub("[^0-9]", "", m)
    rules = [
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 13 <= len(digits(m)) <= 19 and luhn(digits(m))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(digits(m)) <= 15),
    ]
    return [(k, m.start(), m.end()) for k, p, ok in rules for m in re.finditer(p, text or "") if ok(m.group())]


def texts():
    rnd = random.Random(8)
    bits = ["bob.x+1@mail.example.com", "a@b.c@d.e_f@g.hi", "@", "x@y", "1.2.3.4", "001.02.3.4.5.6.7.8", "300.1.1.1", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (988) 555-2485", "+49 30 1234", "+1+2 345 678 901", "12345678901234567890123", "ü🙂", "..", "7", "-", "Version 2.0.", "(555) 123-4567", "123-45-6789"]
    out = [None, "", "1" * 20_000, "1 " * 15_000, "a" * 50_000, "a." * 20_000 + "@b" + ".c" * 20_000, "+1" + " 2" * 9000]
    return out + ["".join(rnd.choice(bits) + rnd.choice([" ", "", "\n", "é", ".", "-"]) for _ in range(n)) for n in (2, 8, 40) for _ in range(25)]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "x", None) for i, t in enumerate(rows)], SCHEMA)


def test_base_spans_brute_force(spark):
    rows = texts()
    got = {r.row.doc_id: r for r in pii.detect(frame(spark, rows)).collect()}
    for i, t in enumerate(rows):
        assert [(s.kind, s.start, s.end) for s in got[i].base_spans] == slow(t), i
        assert [s for s in got[i].spans if s.kind in pii.BASE] == got[i].base_spans
    assert pii.detect(frame(spark, [])).collect() == []


def test_added_spans(spark):
    rows = ["call me, phone (555) 123-4567 now", "version 123-45-6789", "ssn 123-45-6788", "bob [at] example [dot] com", "nothing here at all"] * 30
    got = {r.row.doc_id: r for r in pii.detect(frame(spark, rows)).collect()}
    assert [(s.kind, s.start, s.end) for s in got[0].spans] == [("phone_local", 15, 29)]
    assert [s.kind for s in got[2].spans] == ["national_id"]
    assert [s.kind for s in got[3].spans] == ["email_spelled"]
    assert got[4].spans == []


def test_em_learns_reliability():
    rnd = random.Random(1)
    true_rates, counts = (0.9, 0.75, 0.6), {}
    for _ in range(20_000):
        y = rnd.random() < 0.6
        votes = tuple((1 if (rnd.random() < r) == y else -1) if rnd.random() < 0.9 else 0 for r in true_rates)
        counts[votes] = counts.get(votes, 0) + 1
    table = [pii.Pattern("ip", v, 0, n) for v, n in counts.items()]
    fit = pii.reliabilities(table, 300)
    assert abs(fit.share["ip"] - 0.6) < 0.1 and all(abs(a - b) < 0.08 for a, b in zip(fit.right["ip"], true_rates, strict=True))
    weights = pii.train(table, fit.post)
    assert weights[1] > weights[2] > weights[3] > 0
    assert pii.reliabilities([]).pooled == [0.8] * 3
    # The same labelers turned around on another kind are told apart.
    table += [pii.Pattern("iban", tuple(-v for v in votes[:1]) + votes[1:], 0, n) for votes, n in counts.items()]
    fit = pii.reliabilities(table, 300)
    assert fit.right["ip"][0] > fit.right["iban"][0] + 0.2


def test_many_spans_in_one_text(spark):
    many = 100_000
    text = " ".join(["1.2.3.4"] * many) + " ssn 123-45-6788"
    began = time.monotonic()
    row = pii.detect(frame(spark, [text])).select(F.size("base_spans").alias("n"), F.element_at("base_spans", -1).alias("last"), F.element_at("spans", -1).alias("added")).first()
    assert (row.n, row.last.start, row.last.end) == (many, 8 * many - 8, 8 * many - 1)
    assert (row.added.kind, row.added.start) == ("national_id", 8 * many + 4)
    assert time.monotonic() - began < 60


def test_added_spans_beside_base_ones(spark):
    rnd = random.Random(5)
    found = [(k, sorted(rnd.sample(range(60), 2))) for _ in range(200) for k in (rnd.randrange(len(pii.KINDS)),)]
    rows = [sorted((k, a, b) for k, (a, b) in found[i : i + n]) for i in range(0, 200, 10) for n in (0, 1, 3, 10)]
    kind = "array<struct<k: int, kind: string, start: int, end: int, form: int, gazetteer: int, context: int, long: int>>"
    frame = spark.createDataFrame([(i, [(k, pii.KINDS[k], a, b, 1, 0, 1, 0) for k, a, b in r]) for i, r in enumerate(rows)], f"i int, voted {kind}")
    got = {r.i: [(x.k, x.start, x.end) for x in r.v] for r in frame.select("i", pii.without_touching(F.col("voted")).alias("v")).collect()}
    for i, r in enumerate(rows):
        base = [(a, b) for k, a, b in r if k < len(pii.BASE)]
        assert got[i] == [(k, a, b) for k, a, b in r if k < len(pii.BASE) or not any(x < b and a < y for x, y in base)]
