"""A walk over JSON values of any shape: what each holds, one row for each member."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def kind(value: Column) -> Column:
    """object, array, string, number, boolean, null, or another scalar's type, of a VARIANT."""
    name = F.regexp_extract(F.schema_of_variant(value), r"^[A-Z_]+", 0)
    number = name.isin("BIGINT", "DECIMAL", "DOUBLE", "FLOAT")
    return F.when(name == "VOID", "null").when(number, "number").otherwise(F.lower(name))


def walk(df: DataFrame, keys: list[str], text: str) -> DataFrame:
    """(keys, root, pos, field, kind, first_kind, members) of each member of the JSON in ``text``.

    ``root`` is the kind of the whole; an object's members have a ``field``, an
    array's only their place. ``first_kind`` is the kind of a member's own first item
    and ``members`` how many it has, if it is an object or array (objects hold their
    fields by name). A scalar or an empty whole gives one row without a member, and so
    does a text that is not JSON or null, whose root is null.
    """
    spark = df.sparkSession
    rooted = df.select(*keys, F.try_parse_json(text).alias("whole"))
    rooted = rooted.select(*keys, "whole", kind(F.col("whole")).alias("root"))
    each = rooted.lateralJoin(spark.tvf.variant_explode_outer(F.col("whole").outer())).select(*keys, "root", "pos", F.col("key").alias("field"), "value")
    inner = F.to_json(F.col("value"))
    held = kind(F.col("value"))
    members = F.when(held == "array", F.json_array_length(inner)).when(held == "object", F.size(F.json_object_keys(inner)))
    first = F.when(held == "array", F.try_variant_get("value", "$[0]", "variant")).when(held == "object", F.try_variant_get("value", F.concat(F.lit("$['"), F.get(F.json_object_keys(inner), F.lit(0)), F.lit("']")), "variant"))
    return each.select(*keys, "root", "pos", "field", held.alias("kind"), kind(first).alias("first_kind"), members.alias("members"))
