"""New files as they arrive: a stream of records through the same parsers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

FILES = "path string, modificationTime timestamp, length bigint, content binary"


def arriving(spark: SparkSession, folder: str, pattern: str = "*", files_a_batch: int = 1000) -> DataFrame:
    """(path, content) of files as they appear below a folder."""
    reader = spark.readStream.format("binaryFile").schema(FILES).option("pathGlobFilter", pattern).option("recursiveFileLookup", "true")
    return reader.option("maxFilesPerTrigger", files_a_batch).load(folder).select("path", "content")


def keep(files: DataFrame, parser: Callable[[DataFrame], DataFrame], out: str, checkpoint: str) -> StreamingQuery:
    """Parse what has arrived and append it to a table; each file once."""
    return parser(files).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
