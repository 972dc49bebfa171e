"""Packages as a data source: only what is asked for is read from each file.

    package_source.register(spark)
    spark.read.format("packages").schema("path string, title string").load(folder)

A scan reads each file's prefix and directory. The descriptor is read only if one of
its fields is in the schema or in a filter on the profile, which is decided before
anything else is read; a section's bytes only if its column is in the schema. Digests
are checked for what is read. Files are put together into partitions of about
``partition_bytes`` bytes to be read, or of so many files that are barely opened.
Paths are of any file system that pyarrow knows.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from hashlib import sha256

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, InputPartition
from pyspark.sql.types import StructType

from ..functions.wire import WireError
from . import descriptors, packages

SECTIONS = {"descriptor": "BRD1", "stream": "BRS1", "sidecar": "BSC1"}
FIELDS = ("record_profile", "title", "artist", "release_id", "stream_byte_length")
SCHEMA = "path string, size bigint, n_sections int, has_sidecar boolean, stream_length bigint, record_profile string, title string, artist string, release_id string, stream_byte_length bigint, descriptor binary, stream binary, sidecar binary, bytes_read bigint, error string"
#: Bytes of a prefix with the longest directory, and what opening a file counts as.
_HEAD, _OPEN = packages.PREFIX + len(packages.SECTIONS) * packages.ENTRY, 1 << 20


def filesystem(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    return fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", path)) if ":/" in path else (fs.LocalFileSystem(), path)


class _Files(InputPartition):
    def __init__(self, files: list[tuple[str, int]]) -> None:
        self.files = files


class _Reader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict[str, str]) -> None:
        self.names = schema.fieldNames()
        self.folder, self.most = options["path"], int(options.get("partition_bytes", 128 << 20))
        self.profile: str | None = None

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """A profile is decided here; everything else is left to Spark."""
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("record_profile",) and self.profile in (None, f.value):
                self.profile = f.value
            else:
                yield f

    def _weight(self, size: int) -> int:
        return _OPEN + (size if {"stream", "sidecar"} & {*self.names} else min(size, _HEAD))

    def partitions(self) -> list[InputPartition]:
        where, path = filesystem(self.folder)
        found = where.get_file_info(fs.FileSelector(path, recursive=True))
        parts: list[list[tuple[str, int]]] = []
        left = 0
        for size, name in sorted((f.size, f.path) for f in found if f.is_file and not f.base_name.startswith((".", "_"))):
            if not parts or self._weight(size) > left:
                parts.append([])
                left = self.most
            parts[-1].append((name, size))
            left -= self._weight(size)
        return [_Files(p) for p in parts] or [_Files([])]

    def read(self, partition: _Files) -> Iterator[tuple]:
        where, _ = filesystem(self.folder)
        for name, size in partition.files:
            with where.open_input_file(name) as f:
                row = self._row(f, name, size)
            if row is not None:
                yield tuple(row.get(c) for c in self.names)

    def _row(self, f: pa.NativeFile, name: str, size: int) -> dict | None:
        count = 0

        def ranged(offset: int, length: int) -> bytes:
            nonlocal count
            count += length
            return f.read_at(length, offset)

        row: dict = {"path": name, "size": size}
        try:
            found = {kind: (offset, length, digest) for kind, offset, length, digest in packages.directory(ranged(0, min(_HEAD, size)), size)}
            row |= {"n_sections": len(found), "has_sidecar": "BSC1" in found, "stream_length": found["BRS1"][1]}
            wanted = [c for c in SECTIONS if c in self.names and SECTIONS[c] in found]
            if self.profile is not None or {*FIELDS} & {*self.names}:
                wanted = ["descriptor", *(c for c in wanted if c != "descriptor")]
            for column in wanted:
                offset, length, digest = found[SECTIONS[column]]
                row[column] = ranged(offset, length)
                if sha256(row[column]).digest() != digest:
                    raise WireError(f"{column} digest is wrong")
                if column == "descriptor":
                    said = descriptors.parse(row[column])
                    row |= {c: said.get(c) for c in FIELDS}
                    if self.profile not in (None, said.get("record_profile")):
                        return None
        except WireError as e:
            if self.profile is not None:
                return None  # of no profile
            row = {"path": name, "size": size, "error": str(e)}
        return row | {"bytes_read": count}


class PackageSource(DataSource):
    """The source as Spark knows it; a schema given by the caller says what is read."""

    @classmethod
    def name(cls) -> str:
        return "packages"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(schema, self.options)


def register(spark: SparkSession) -> None:
    """Make the format known, and let filters reach it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(PackageSource)


def write_files(files: DataFrame, folder: str, suffix: str = ".pkg") -> DataFrame:
    """Write each (path, content) as a file of its own below ``folder``, from the executors; (path, size) of what was written.

    A file is complete before it has its name, so a task that is tried again or twice does no harm.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import uuid

        where, top = filesystem(folder)
        where.create_dir(top, recursive=True)
        for batch in batches:
            names, sizes = [f"{top}/{n}{suffix}" for n in batch.column(0).to_pylist()], []
            for name, data in zip(names, batch.column(1).to_pylist(), strict=True):
                aside = f"{top}/.{uuid.uuid4().hex}"
                with where.open_output_stream(aside) as f:
                    f.write(data or b"")
                where.move(aside, name)
                sizes.append(len(data or b""))
            yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(sizes, pa.int64())], names=["path", "size"])

    return files.select("path", "content").mapInArrow(run, "path string, size bigint")
