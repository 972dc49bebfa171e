"""Codec bundle documents by a stated schema; what does not fit is kept apart with its reason."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_CORRUPT = "_corrupt"


def read(files: DataFrame, schema: str, required: Sequence[str] = (), path: str = "path", content: str = "content") -> DataFrame:
    """(path, bundle, reason, raw): each document as ``schema`` has it, or why not and its text.

    ``files`` has texts or UTF-8 bytes. A document is turned away if it is null or
    blank, no JSON object, has a field of another type, or lacks a ``required`` one.
    Fields that the schema does not name are passed over. Rows stay as they are.
    """
    kind = T._parse_datatype_string(schema)
    text = F.decode(F.col(content), "UTF-8") if isinstance(files.schema[content].dataType, T.BinaryType) else F.col(content).cast("string")
    wide = T.StructType([*kind.fields, T.StructField(_CORRUPT, T.StringType())])
    parsed = files.select(F.col(path).alias("path"), text.alias("raw")).withColumn("found", F.from_json("raw", wide, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": _CORRUPT}))
    lacks = F.array_compact(F.array(*(F.when(F.col("found").getField(c).isNull(), F.lit(c)) for c in required))) if required else F.array().cast("array<string>")
    root = F.schema_of_variant(F.try_parse_json("raw"))
    reason = (
        F.when(F.col("raw").isNull() | (F.trim("raw") == ""), "there is no document")
        .when(root.isNull(), "it is not JSON")
        .when(~F.startswith(root, F.lit("OBJECT")), "it is not an object")
        .when(F.col("found").isNull() | F.col("found").getField(_CORRUPT).isNotNull(), "a field has another type")
        .when(F.size(lacks) > 0, F.concat(F.lit("it lacks "), F.array_join(lacks, ", ")))
    )
    judged = parsed.withColumn("reason", reason)
    return judged.select("path", F.when(F.col("reason").isNull(), F.struct(*(F.col("found").getField(f.name).alias(f.name) for f in kind.fields))).alias("bundle"), "reason", F.when(F.col("reason").isNotNull(), F.col("raw")).alias("raw"))


def split(found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The documents, flat, and the quarantine (path, reason, raw)."""
    return found.where("reason is null").select("path", "bundle.*"), found.where("reason is not null").select("path", "reason", "raw")
