"""Registered queries over summaries: mergeable states, change feeds, grouping sets, documents by schema."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import feeds, relational, states, sweep
from ..sources import bundles, descriptors
from . import report, wire

#: Days of a range, and how far estimates may be off: a share of a count, and a share of the rows for a median.
DAYS, OFF, RANK_OFF = 7, 0.06, 0.05


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def weekly_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users of each event type in the week up to each day: exact, and whether the stored daily states come near enough when merged."""
    day = F.unix_date(F.col("ts").cast("date"))
    events = _table(spark, sf_dir, "events").select("event_type", "user_id", "value", day.cast("bigint").alias("day"))
    path = f"{sweep.shared_folder(spark)}/states-{uuid.uuid4().hex}"
    states.states(events, F.col("day"), ["event_type"], "user_id", "value").write.parquet(path)
    found = states.read(states.ranged(spark.read.parquet(path), ["event_type"], DAYS), (0.5,)).withColumnRenamed("event_type", "kind")
    weeks = events.select("event_type", "user_id", "value", F.explode(F.sequence(F.col("day"), F.col("day") + (DAYS - 1))).alias("until"))
    met = weeks.join(found, (F.col("event_type") == F.col("kind")) & (F.col("until") == F.col("period")))
    whole = met.groupBy("event_type", "until").agg(F.count_distinct("user_id").alias("users"), F.count("value").alias("rows"), F.first("n").alias("n"), F.first("hll_count").alias("hll"), F.first("theta_count").alias("theta"), F.count_if(F.col("value") <= F.col("quantiles")[0]).alias("below"))
    near = lambda c: F.abs(F.col(c) - F.col("users")) <= OFF * F.col("users") + 1
    return whole.select("event_type", F.col("until").alias("day"), "users", "n", near("hll").alias("hll_near"), near("theta").alias("theta_near"), (F.abs(F.col("below") / F.col("rows") - 0.5) <= F.lit(RANK_OFF) + 1 / F.col("rows")).alias("median_near"))


def line_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes of the lines' labels from one manifest to the next: by part, some go, some come twice, some change, some come new."""
    lines = _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_returnflag", "l_linestatus")
    k = F.col("l_partkey")
    kept = lines.where(k % 17 != 0).withColumn("l_returnflag", F.when(k % 13 == 0, "X").otherwise(F.col("l_returnflag")))
    new = lines.where(k % 23 == 0).withColumn("l_orderkey", -F.col("l_orderkey"))
    after = kept.unionAll(lines.where(k % 19 == 0)).unionAll(new)
    return feeds.changes(lines, after, ["l_orderkey", "l_partkey"], ["l_returnflag", "l_linestatus"])


def check_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Checks of the parts' descriptors by profile, copyright decade, label and in all."""
    found = descriptors.descriptors(wire.part_descriptors(spark, sf_dir))
    good = F.col("error").isNull()
    decade = F.floor(F.col("copyright_year") / 10).cast("int")
    keyed = found.select("path", F.col("record_profile").alias("profile"), decade.alias("decade"), "error", "title", "stream_byte_length")
    checked = relational.checks(keyed, ["path", "profile", "decade"], {"descriptor parses": good, "stream is under 256 bytes": good & (F.col("stream_byte_length") < 256), "title is given": good & F.col("title").isNotNull()})
    return report.rollup(checked, ["profile", "decade"])


def bundle_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as codec documents: by six, 0 is cut short, 1 has a word for a number, 2 lacks its name, 3 is an array."""
    customer = _table(spark, sf_dir, "customer")
    kind = F.col("c_custkey") % 6
    whole = F.to_json(F.struct(F.when(kind != 2, F.col("c_name")).alias("name"), F.col("c_nationkey").alias("rate"), F.struct((F.col("c_custkey") % 4).alias("layers")).alias("model"), F.lit("more").alias("other")))
    text = F.when(kind == 0, F.substring(whole, F.lit(1), F.length(whole) - 1)).when(kind == 1, F.replace(whole, F.lit('"rate":'), F.lit('"rate":"x","was":'))).when(kind == 3, F.concat(F.lit("["), whole, F.lit("]"))).otherwise(whole)
    found = bundles.read(customer.select(F.col("c_custkey").cast("string").alias("path"), F.encode(text, "UTF-8").alias("content")), "name string, rate int, model struct<layers: int>", ["name", "model"])
    return found.select(F.col("path").cast("bigint").alias("c_custkey"), "bundle.name", "bundle.rate", "bundle.model.layers", "reason", F.length("raw").alias("kept"))


QUERIES = {f.__name__: f for f in (weekly_users, line_changes, check_rollup, bundle_documents)}

ORACLE_SQL = {
    "weekly_users": f"""WITH e AS (SELECT event_type, user_id, value, CAST(CAST(ts AS DATE) - DATE '1970-01-01' AS BIGINT) AS d FROM events),
        l AS (SELECT event_type, max(d) AS last FROM e GROUP BY event_type),
        w AS (SELECT event_type, user_id, value, unnest(range(d, d + {DAYS})) AS day FROM e)
        SELECT w.event_type, day, count(DISTINCT user_id) AS users, count(value) AS n, true AS hll_near, true AS theta_near, true AS median_near FROM w JOIN l USING (event_type) WHERE day <= last GROUP BY ALL""",
    "line_changes": """WITH l AS (SELECT l_orderkey, l_partkey, l_returnflag, l_linestatus FROM lineitem),
        a AS (SELECT l_orderkey, l_partkey, CASE WHEN l_partkey % 13 = 0 THEN 'X' ELSE l_returnflag END AS l_returnflag, l_linestatus FROM l WHERE l_partkey % 17 <> 0
              UNION ALL SELECT * FROM l WHERE l_partkey % 19 = 0 UNION ALL SELECT -l_orderkey, l_partkey, l_returnflag, l_linestatus FROM l WHERE l_partkey % 23 = 0),
        b AS (SELECT *, count(*) AS n FROM l GROUP BY ALL), c AS (SELECT *, count(*) AS n FROM a GROUP BY ALL),
        d AS (SELECT l_orderkey, l_partkey, l_returnflag, l_linestatus, coalesce(c.n, 0) - coalesce(b.n, 0) AS times FROM b FULL JOIN c USING (l_orderkey, l_partkey, l_returnflag, l_linestatus))
        SELECT *, CASE WHEN max(times) OVER k > 0 AND min(times) OVER k < 0 THEN 'altered' WHEN times > 0 THEN 'added' ELSE 'gone' END AS change FROM d WHERE times <> 0 WINDOW k AS (PARTITION BY l_orderkey, l_partkey)""",
    "check_rollup": """WITH p AS (SELECT *, p_partkey % 13 > 2 AS good FROM part),
        d AS (SELECT CASE WHEN good THEN ['single45', 'lp', 'ten', 'single45vintage'][p_partkey % 4 + 1] END AS profile, CASE WHEN good THEN CAST((p_size + 1900) // 10 AS INT) END AS decade,
            unnest([('descriptor parses', good), ('stream is under 256 bytes', good AND p_size * 10 < 256), ('title is given', good)]) AS c FROM p),
        e AS (SELECT profile, decade, c[1] AS label, c[2] AS ok FROM d)
        SELECT profile, decade, label, CAST(grouping_id(profile, decade, label) AS BIGINT) AS level, count(*) FILTER (WHERE ok) AS passed, count(*) FILTER (WHERE NOT ok) AS failed FROM e
        GROUP BY GROUPING SETS ((profile, decade, label), (profile, label), (decade, label), (label), (profile), (decade), ())""",
    "bundle_documents": """WITH c AS (SELECT *, c_custkey % 6 AS k, 55 + strlen(c_name) + strlen(CAST(c_nationkey AS VARCHAR)) AS n FROM customer)
        SELECT c_custkey, CASE WHEN k > 3 THEN c_name END AS name, CASE WHEN k > 3 THEN c_nationkey END AS rate, CASE WHEN k > 3 THEN c_custkey % 4 END AS layers,
            CASE k WHEN 0 THEN 'it is not JSON' WHEN 1 THEN 'a field has another type' WHEN 2 THEN 'it lacks name' WHEN 3 THEN 'it is not an object' END AS reason,
            CAST(CASE k WHEN 0 THEN n - 1 WHEN 1 THEN n + 10 WHEN 2 THEN n - strlen(c_name) - 10 WHEN 3 THEN n + 2 END AS INT) AS kept FROM c""",
}
