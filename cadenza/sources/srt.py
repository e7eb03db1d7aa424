"""SRT files as a data source, format("srt"): one row a cue, in and out."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader

from .files import PART_BYTES, Files, StagedWriter, file_system, files_under, found_files, packed, spread

SCHEMA = "path string, pos long, start_ms long, end_ms long, text string, encoding string"
#: Encodings in the order in which they are tried; the last one fits all bytes. Fixed values.
ENCODINGS = ("utf-8", "utf-8-sig", "cp1252", "latin-1")
_STAMP = r"(\d+):(\d\d):(\d\d)[,.](\d{1,3})"
TIME_LINE = re.compile(rf"\s*{_STAMP}\s*-->\s*{_STAMP}")


def decoded(data: bytes) -> tuple[str, str]:
    """The text and the first encoding that fits it; a byte order mark is no text."""
    for encoding in ENCODINGS[:-1]:
        try:
            return data.decode(encoding).removeprefix("﻿"), encoding
        except UnicodeDecodeError:
            pass
    return data.decode(ENCODINGS[-1]), ENCODINGS[-1]


def cues_of(text: str) -> Iterator[tuple[int, int, str]]:
    """(start_ms, end_ms, text) of each time line: what stands up to the next one, without that one's number."""
    lines = text.replace("\r\n", "\n").replace("\r", "\n").split("\n")
    found = [(i, m) for i, m in ((i, TIME_LINE.match(x)) for i, x in enumerate(lines) if "-->" in x) if m]
    for k, (i, m) in enumerate(found):
        body = lines[i + 1 : found[k + 1][0] if k + 1 < len(found) else len(lines)]
        if k + 1 < len(found) and body and body[-1].strip().isdigit():
            body.pop()
        h, mi, s, f, h2, mi2, s2, f2 = m.groups()
        start, end = ((int(a) * 3600 + int(b) * 60 + int(c)) * 1000 + int(d.ljust(3, "0")) for a, b, c, d in ((h, mi, s, f), (h2, mi2, s2, f2)))
        yield start, end, "\n".join(x.rstrip() for x in body).strip()


def stamp(ms: int) -> str:
    return f"{ms // 3_600_000:02d}:{ms // 60_000 % 60:02d}:{ms // 1000 % 60:02d},{ms % 1000:03d}"


def batches_of(folder: str, paths: Iterable[str]) -> Iterator[pa.RecordBatch]:
    """The cues of files, some thousand rows at a time."""
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]
    batch = lambda: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)
    system, _ = file_system(folder)
    rows: list[tuple] = []
    for path in paths:
        with system.open_input_stream(path) as data:
            text, encoding = decoded(data.read())
        rows += [(path, k, start, end, body, encoding) for k, (start, end, body) in enumerate(cues_of(text))]
        if len(rows) >= 10_000:
            yield batch()
            rows = []
    if rows:
        yield batch()


class SrtReader(DataSourceReader):
    def __init__(self, path: str, most: int):
        self.path, self.most = path, most

    def partitions(self) -> list[Files]:
        return packed(files_under(self.path, ".srt"), self.most)

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        return batches_of(self.path, partition.paths)


class SrtWriter(StagedWriter):
    ending = ".srt"

    def encoded(self, rows: list[dict]) -> bytes:
        rows = sorted((r for r in rows if (r["text"] or "").strip()), key=lambda r: r["pos"])
        parts = [f"{k}\n{stamp(r['start_ms'])} --> {stamp(r['end_ms'])}\n{r['text'].strip()}\n\n" for k, r in enumerate(rows, 1)]
        return "".join(parts).encode((rows[0]["encoding"] if rows else None) or "utf-8")


class SrtSource(DataSource):
    """Cues of SRT files: (path, pos, start_ms, end_ms, text, encoding).

    Read: all .srt files under a path, packed into partitions of maxPartitionBytes; each in the first
    encoding that fits. Write: path is a name under the folder; the rows of a name stand together in one
    task (see write_srt). Cues are ordered by pos and numbered anew, those without text go, a
    file is in the encoding of its first row, UTF-8 where that is null. A character that the encoding
    lacks fails the write. Files appear when all tasks have ended, or none does. The driver plans a read by the names of
    all files; read_srt_files does without.
    """

    @classmethod
    def name(cls) -> str:
        return "srt"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> SrtReader:
        return SrtReader(self.options["path"], int(self.options.get("maxpartitionbytes", PART_BYTES)))

    def writer(self, schema, overwrite: bool) -> SrtWriter:
        return SrtWriter(self.options["path"], overwrite)


def read_srt_files(spark: SparkSession, path: str) -> DataFrame:
    """format("srt"), but files are listed by tasks, so the driver holds no names."""
    paths = spread(found_files(spark, path, ".srt"), "size").select("path")
    return paths.mapInArrow(lambda batches: batches_of(path, (x for b in batches for x in b.column(0).to_pylist())), SCHEMA)


def write_srt(cues: DataFrame, folder: str, mode: str = "append", together: bool = False) -> None:
    """cues(path, pos, start_ms, end_ms, text, encoding) as one file a path under folder: a shuffle by path brings a file's rows together, unless they stand together in a task."""
    cues.sparkSession.dataSource.register(SrtSource)
    rows = cues.select("path", "pos", "start_ms", "end_ms", "text", "encoding")
    (rows if together else rows.repartition("path").sortWithinPartitions("path", "pos")).write.format("srt").mode(mode).save(folder)
