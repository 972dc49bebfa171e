"""States, change feeds, documents by schema and rollups on small and hostile tables."""

import random
from collections import Counter

from pyspark.sql import functions as F

from platterlake.operators import feeds, states
from platterlake.plans import report
from platterlake.sources import bundles

SCHEMA = "day int, hll string, who string, period double"


def test_states_merge_to_what_all_rows_give(spark):
    rng = random.Random(2)
    rows = [(rng.choice([1, 2, 3, 9, None]), rng.choice(["a", "a", None]), rng.choice([None, *(f"u{k}" for k in range(3000))]), rng.choice([None, rng.random()])) for _ in range(6000)]
    df = spark.createDataFrame(rows, SCHEMA)
    make = lambda part: states.states(part, F.col("day"), ["hll_"], "who", "period_")
    df = df.withColumnsRenamed({"hll": "hll_", "period": "period_"})
    grown = states.add(make(df.where("day < 3")), make(df.where("day >= 3 and who < 'u2'")), ["hll_"])
    grown = states.add(grown, make(df.where("day >= 3 and (who is null or who >= 'u2')")), ["hll_"])
    got = {(r.period, r.hll_): r for r in states.read(states.ranged(grown, ["hll_"], 3), (0.0, 0.5, 1.0)).collect()}
    for until in (1, 2, 3, 4, 5, 9):
        for key in ("a", None):
            own = [r for r in rows if r[1] == key and r[0] is not None and until - 3 < r[0] <= until]
            if not own:
                assert (until, key) not in got
                continue
            r, who, numbers = got[until, key], {x[2] for x in own} - {None}, sorted(x[3] for x in own if x[3] is not None)
            assert abs(r.hll_count - len(who)) <= 0.06 * len(who) and abs(r.theta_count - len(who)) <= 0.06 * len(who) and r.n == len(numbers)
            assert (r.quantiles[0], r.quantiles[2]) == (numbers[0], numbers[-1]) and abs(sum(x <= r.quantiles[1] for x in numbers) / len(numbers) - 0.5) < 0.05
    assert states.read(states.ranged(make(df.where("false")), ["hll_"], 3)).collect() == []


def test_changes_and_their_application(spark):
    rng = random.Random(1)
    draw = lambda n: [(rng.choice(["a", "b", "hot", "hot", None]), rng.choice(["x", "y", None]), rng.randint(0, 1)) for _ in range(n)]
    before, after = draw(60), draw(55)
    schema = "path string, times_ string, change_ int"
    b, a = spark.createDataFrame(before, schema), spark.createDataFrame(after, schema)
    feed = feeds.changes(b, a, ["path"], ["times_", "change_"])
    diff = Counter(after)
    diff.subtract(Counter(before))
    rows = [tuple(r) for r in feed.collect()]
    assert {r[:3]: r[3] for r in rows} == {k: n for k, n in diff.items() if n} and len(rows) == len({r[:3] for r in rows})
    for key, *_, n, change in rows:
        signs = {(m > 0) for k, m in diff.items() if m and k[0] == key}
        assert change == ("altered" if len(signs) == 2 else "added" if n > 0 else "gone")
    assert Counter(tuple(r) for r in feeds.applied(b, feed, ["path"], ["times_", "change_"]).collect()) == Counter(after)
    assert feeds.changes(b, b, ["path"], ["times_", "change_"]).collect() == []
    assert {r.change for r in feeds.changes(b.where("false"), a, ["path"], ["times_", "change_"]).collect()} == {"added"}


def test_changes_are_one_shuffle(spark):
    df = spark.range(100).selectExpr("id", "id % 3 AS v")
    old = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = feeds.changes(df, df, ["id"], ["v"])._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", old)
    assert plan.count("Exchange ") == 1


def test_bundles(spark):
    rows = {"ok": '{"name":"n","rate":3,"model":{"layers":2},"extra":[1]}', "no rate": '{"name":"n","model":{"layers":null}}', "cut": '{"name":"n"', "word": '{"name":"n","rate":"three","model":{}}', "array": '[{"name":"n"}]', "scalar": "7", "lacks": '{"rate":1}', "blank": "  ", "none": None, "long": '{"name":"' + "x" * 100_000 + '","model":{}}'}
    files = spark.createDataFrame([(k, v and bytearray(v.encode())) for k, v in rows.items()], "path string, content binary")
    found = bundles.read(files, "name string, rate int, model struct<layers: int>", ["name", "model"])
    good, bad = bundles.split(found)
    assert {(r.path, r.rate, r.model.layers) for r in good.collect()} == {("ok", 3, 2), ("no rate", None, None), ("long", None, None)}
    got = {r.path: (r.reason, r.raw) for r in bad.collect()}
    want = {"cut": "it is not JSON", "word": "a field has another type", "array": "it is not an object", "scalar": "it is not an object", "lacks": "it lacks name, model", "blank": "there is no document", "none": "there is no document"}
    assert {k: r for k, (r, _) in got.items()} == want and all(raw == rows[k] for k, (_, raw) in got.items())
    assert bundles.read(files.withColumn("content", F.col("content").cast("string")), "name string").where("reason is null").count() == 5
    assert bundles.read(files.where("false"), "name string").collect() == []


def test_rollup(spark):
    rows = [("p", "lp", 1, "a", True), ("q", "lp", 2, "a", False), ("r", None, 1, "b", True), ("r", None, 1, "a", True)]
    got = {(r.profile, r.side, r.label, r.level): (r.passed, r.failed) for r in report.rollup(spark.createDataFrame(rows, "path string, profile string, side int, label string, ok boolean"), ["profile", "side"]).collect()}
    assert got[None, None, None, 7] == (3, 1) and got[None, None, "a", 6] == (2, 1) and got[None, 1, "a", 0] == (1, 0)
    assert got["lp", None, None, 3] == (1, 1) and got[None, None, None, 3] == (2, 0) and got[None, 1, None, 5] == (3, 0) and got["lp", None, "a", 2] == (1, 1)
