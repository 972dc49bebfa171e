"""Transport frames as a table function: rows one by one, from SQL too, however many a record has.

    frames.register(spark)
    SELECT r.path, f.* FROM records r, LATERAL stream_frames(r.content) f
    SELECT * FROM frame_places(TABLE(...) PARTITION BY path ORDER BY idx)
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql.functions import OrderingColumn, PartitioningColumn, udtf
from pyspark.sql.types import BinaryType, BooleanType, IntegerType, LongType, StringType, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from ..functions.wire import Cursor, WireError
from .streams import ENCRYPTED, MAGIC, NONCE_BYTES


def _frame_schema(payload: bool) -> StructType:
    plain = StructType().add("idx", IntegerType()).add("start", LongType()).add("payload_start", LongType()).add("payload_end", LongType()).add("end", LongType()).add("crc_ok", BooleanType())
    return (plain.add("payload", BinaryType()) if payload else plain).add("error", StringType())


@udtf
class Frames:
    """The frames of one stream's bytes, in order; the last row has an error instead if the bytes end within one.

    ``payload => true`` adds each frame's bytes to its row. A null is a stream of no bytes.
    """

    @staticmethod
    def analyze(content: AnalyzeArgument, payload: AnalyzeArgument = AnalyzeArgument(BooleanType(), False, False, True)) -> AnalyzeResult:
        if content.dataType != BinaryType():
            raise ValueError("stream_frames takes binary content")
        if not payload.isConstantExpression:
            raise ValueError("payload is a constant")
        return AnalyzeResult(_frame_schema(bool(payload.value)))

    def eval(self, content: bytes, payload: bool = False) -> Iterator[tuple]:
        data, idx = bytes(content or b""), 0
        try:
            c = Cursor(data)
            if c.take(4, "stream magic") != MAGIC:
                raise WireError("stream magic is invalid")
            meta = c.take(c.uint(4, "metadata length"), "metadata")
            encrypted = len(meta) > 1 and meta[1] & ENCRYPTED
            while c.left:
                start = c.at
                length, crc = c.varuint("chunk length"), c.uint(4, "chunk CRC")
                if not length:
                    raise WireError(f"chunk at byte {start} is empty")
                if encrypted:
                    c.take(NONCE_BYTES, "chunk nonce")
                body = c.take(length, f"chunk at byte {start}")
                yield (idx, start, c.at - length, c.at, c.at, zlib.crc32(body) == crc, *([body] if payload else []), None)
                idx += 1
        except WireError as e:
            yield (idx, *([None] * (6 if payload else 5)), str(e))


@udtf
class FramePlaces:
    """(path, idx, first_byte, last_byte) of frames (path, idx, length) in their record's payload, in one pass over each record."""

    @staticmethod
    def analyze(rows: AnalyzeArgument) -> AnalyzeResult:
        if not rows.isTable:
            raise ValueError("frame_places takes a table")
        return AnalyzeResult(StructType().add("path", StringType()).add("idx", IntegerType()).add("first_byte", LongType()).add("last_byte", LongType()), partitionBy=[PartitioningColumn("path")], orderBy=[OrderingColumn("idx")])

    def __init__(self) -> None:
        self.at = 0

    def eval(self, row: Row) -> Iterator[tuple]:
        start, self.at = self.at, self.at + row["length"]
        yield row["path"], row["idx"], start, self.at


def register(spark: SparkSession) -> None:
    """Make both functions known to SQL."""
    spark.udtf.register("stream_frames", Frames)
    spark.udtf.register("frame_places", FramePlaces)


def frames(files: DataFrame, payload: bool = False) -> DataFrame:
    """(path, idx, start, ..., error) of every frame of (path, content)."""
    register(files.sparkSession)
    return files.sparkSession.sql(f"SELECT r.path, f.* FROM {{files}} r, LATERAL stream_frames(r.content, payload => {str(payload).lower()}) f", files=files)


def places(found: DataFrame) -> DataFrame:
    """Where each frame of ``frames`` lies in its record's payload."""
    register(found.sparkSession)
    lengths = found.where("error is null").selectExpr("path", "idx", "payload_end - payload_start AS length")
    return found.sparkSession.sql("SELECT * FROM frame_places(TABLE(SELECT * FROM {lengths}))", lengths=lengths)
