"""Blu-ray subtitle streams as a data source, format("sup"): one row a segment, read by ranges of bytes. (S3)"""

from __future__ import annotations

import struct
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .files import PART_BYTES, StagedWriter, file_system, files_under, found_files, parted, spread

SCHEMA = "path string, at long, pts long, dts long, kind int, payload binary"
#: Magic, header (magic, pts, dts, kind, size), and kinds of segments. Fixed values.
MAGIC, HEADER, HEADER_BYTES, KINDS = b"PG", ">2sIIBH", 13, {0x14, 0x15, 0x16, 0x17, 0x80}
#: Segments in a row that prove a beginning.
CHAIN = 4


@dataclass
class Range:
    """Segments that begin in these bytes of a file."""

    path: str
    start: int
    end: int
    size: int


@dataclass
class Ranges(InputPartition):
    """Ranges that one task reads."""

    parts: list[Range]


class _Bytes:
    """Random access to a file through blocks."""

    def __init__(self, data, size: int, block: int = 1 << 20):
        self.data, self.size, self.block, self.at, self.held = data, size, block, 0, b""

    def get(self, at: int, n: int) -> bytes:
        if not (self.at <= at and at + n <= self.at + len(self.held)):
            self.data.seek(at)
            self.at, self.held = at, self.data.read(max(n, self.block))
        return self.held[at - self.at : at - self.at + n]


def _strength(data: _Bytes, at: int) -> int:
    """How well a segment may begin at a place: 2 if others follow it or it ends the file, 1 if what follows is none, 0 if it is none."""
    valid = 0
    while valid < CHAIN:
        if at == data.size:
            return 2 * bool(valid)
        head = data.get(at, HEADER_BYTES)
        if len(head) < HEADER_BYTES:
            return min(valid, 1) + (valid > 0 and head[:2] == MAGIC[: len(head)])
        magic, _, _, kind, size = struct.unpack(HEADER, head)
        if magic != MAGIC or kind not in KINDS:
            return min(valid, 2)
        if at + HEADER_BYTES + size > data.size:
            return 2 if valid else 0
        valid, at = valid + 1, at + HEADER_BYTES + size
    return 2


def _first(data: _Bytes, start: int, end: int) -> int | None:
    """Where the first segment of a range begins: by its magic and those that follow it."""
    if start == 0:
        return 0
    weak, at = None, start
    while at < end:
        held = data.get(at, min(1 << 16, end - at + 1))
        k = held.find(MAGIC)
        while k >= 0 and at + k < end:
            strength = _strength(data, at + k)
            if strength == 2:
                return at + k
            if strength and weak is None:
                weak = at + k
            held = data.get(at, min(1 << 16, end - at + 1))
            k = held.find(MAGIC, k + 1)
        at += max(len(held) - 1, 1)
    return weak


def segments(data, size: int, start: int, end: int) -> Iterator[tuple[int, int, int, int | None, bytes | None]]:
    """(at, pts, dts, kind, payload) of a range; where no segment follows before the end, a last row without kind tells."""
    source = _Bytes(data, size)
    at = _first(source, start, end)
    while at is not None and at < end:
        head = source.get(at, HEADER_BYTES)
        magic, pts, dts, kind, n = struct.unpack(HEADER, head) if len(head) == HEADER_BYTES else (b"", 0, 0, 0, 0)
        if magic != MAGIC or at + HEADER_BYTES + n > size:
            yield at, 0, 0, None, None
            return
        yield at, pts, dts, kind, source.get(at + HEADER_BYTES, n)
        at += HEADER_BYTES + n


def batches_of(folder: str, parts: Iterable[Range]) -> Iterator[pa.RecordBatch]:
    """The segments of ranges, some thousand rows or some megabytes at a time."""
    system, _ = file_system(folder)
    schema = pa.schema([("path", pa.string()), ("at", pa.int64()), ("pts", pa.int64()), ("dts", pa.int64()), ("kind", pa.int32()), ("payload", pa.binary())])
    batch = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
    rows, held = [], 0
    for part in parts:
        with system.open_input_file(part.path) as data:
            for row in segments(data, part.size, part.start, part.end):
                rows.append((part.path, *row))
                held += len(row[-1] or b"")
                if held > 8 << 20 or len(rows) >= 10_000:
                    yield batch(rows)
                    rows, held = [], 0
    if rows:
        yield batch(rows)


class SupReader(DataSourceReader):
    def __init__(self, path: str, split: int):
        self.path, self.split = path, split

    def partitions(self) -> list[Ranges]:
        found = [Range(f.path, a, min(a + self.split, f.size), f.size) for f in files_under(self.path, ".sup") for a in range(0, f.size, self.split)]
        return [Ranges(some) for some in parted(found, lambda r: r.end - r.start)]

    def read(self, partition: Ranges) -> Iterator[pa.RecordBatch]:
        return batches_of(self.path, partition.parts)


class SupWriter(StagedWriter):
    ending = ".sup"

    def encoded(self, rows: list[dict]) -> bytes:
        rows = sorted(rows, key=lambda r: r["at"])
        return b"".join(struct.pack(HEADER, MAGIC, r["pts"], r["dts"], r["kind"], len(r["payload"])) + r["payload"] for r in rows)


class SupSource(DataSource):
    """Segments of .sup files: (path, at, pts, dts, kind, payload); at is where the segment begins.

    Files are cut every splitBytes bytes; a task has one range or several small ones, finds the first segment of each and
    reads those that begin in it. A file counts up to where no segment follows another: there the range has a row without
    kind, and what lies behind it in the file doesn't count.
    """

    @classmethod
    def name(cls) -> str:
        return "sup"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> SupReader:
        return SupReader(self.options["path"], int(self.options.get("splitbytes", PART_BYTES)))

    def writer(self, schema, overwrite: bool) -> SupWriter:
        return SupWriter(self.options["path"], overwrite)


def read_sup(spark: SparkSession, path: str, split: int = PART_BYTES) -> DataFrame:
    """The segments of all files, with a row without kind where one breaks; see operators.screens, which stops there. Files are listed by tasks, so the driver holds no names. (S3)"""
    ranges = found_files(spark, path, ".sup").where("size > 0").select("path", "size", F.explode(F.sequence(F.lit(0).cast("long"), F.col("size") - 1, F.lit(split).cast("long"))).alias("start"))
    ranges = ranges.withColumn("end", F.least(F.col("start") + split, F.col("size")))
    parts = spread(ranges.withColumn("bytes", F.col("end") - F.col("start")), "bytes").select("path", "start", "end", "size")
    return parts.mapInArrow(lambda batches: batches_of(path, (Range(*row.values()) for b in batches for row in b.to_pylist())), SCHEMA)


def write_sup(segments: DataFrame, folder: str, mode: str = "append") -> None:
    """segments(path, at, pts, dts, kind, payload) as one file a path under folder, ordered by at."""
    segments.sparkSession.dataSource.register(SupSource)
    rows = segments.select("path", "at", "pts", "dts", "kind", "payload")
    rows.repartition("path").sortWithinPartitions("path", "at").write.format("sup").mode(mode).save(folder)
