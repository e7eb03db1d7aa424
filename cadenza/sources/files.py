"""What the file formats share: files packed into partitions by bytes, and writers whose files appear all at once or not at all."""

from __future__ import annotations

import hashlib
import io
import json
import os
import uuid
from abc import abstractmethod
from collections import Counter, deque
from collections.abc import Callable, Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from typing import Any

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSourceArrowWriter, InputPartition, WriterCommitMessage

from ..shared import stored

#: Bytes of one partition, and what opening a file counts for.
PART_BYTES, OPEN_BYTES = 64 << 20, 256 << 10
#: What a file of found_files() counts for beside its bytes, and folders that one task lists.
SMALL_BYTES, FOLDERS = 16 << 10, 200
#: Files that are moved at once, names of files that the driver holds, and digests of names.
MOVES, NAMES, DIGESTS = 16, 10_000, 4_000_000
#: The file of a task's staging folder that names the others.
LIST = "names"


def file_system(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI that pyarrow knows (local, s3, gs, hdfs), and the path in it."""
    return fs.FileSystem.from_uri(path)


def _entries(system: fs.FileSystem, folder: str) -> Iterator[tuple[str, int, bool]]:
    """(path, size, whether it is a folder) of what is in a folder; names that begin with _ or . aside. A local folder is read entry by entry."""
    if isinstance(system, fs.LocalFileSystem):
        with os.scandir(folder) as found:
            for e in found:
                if e.name[:1] not in ("_", ".") and (e.is_dir() or e.is_file()):
                    yield e.path, 0 if e.is_dir() else e.stat().st_size, e.is_dir()
    else:
        for f in system.get_file_info(fs.FileSelector(folder)):
            if f.base_name[:1] not in ("_", "."):
                yield f.path, f.size or 0, f.type == fs.FileType.Directory


def files_in(path: str, ending: str) -> Iterator[tuple[str, int]]:
    """(path, size) of files of one ending, in any case, folder by folder; those in folders whose name begins with _ or . aside. A file stands for itself."""
    system, root = file_system(path)
    info = system.get_file_info(root)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    if info.type == fs.FileType.File:
        yield info.path, info.size
        return
    folders = deque([root])
    while folders:
        for at, size, is_folder in _entries(system, folders.popleft()):
            if is_folder:
                folders.append(at)
            elif at.lower().endswith(ending):
                yield at, size


def files_under(path: str, ending: str) -> list[fs.FileInfo]:
    """files_in() by path, all of them."""
    return [fs.FileInfo(at, type=fs.FileType.File, size=size) for at, size in sorted(files_in(path, ending))]


def found_files(spark: SparkSession, path: str, ending: str) -> DataFrame:
    """(path, size) of the files of files_in(), listed by tasks: a level of the tree is one job, and only counts come to the driver."""
    system, root = file_system(path)
    info = system.get_file_info(root)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    if info.type == fs.FileType.File:
        return spark.createDataFrame([(info.path, info.size)], "path string, size long")

    def listing(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, _ = file_system(path)
        rows: list[tuple] = []
        batch = lambda: pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.string(), pa.int64(), pa.bool_()))], ["path", "size", "is_folder"])
        for some in batches:
            for folder in some.column(0).to_pylist():
                for row in _entries(system, folder):
                    if row[2] or row[0].lower().endswith(ending):
                        rows.append(row)
                    if len(rows) >= NAMES:
                        yield batch()
                        rows.clear()
        if rows:
            yield batch()

    level, levels, n = spark.createDataFrame([(root,)], "path string"), [], 1
    while n:
        levels.append(stored(level.repartition(-(-n // FOLDERS)).mapInArrow(listing, "path string, size long, is_folder boolean"), "files"))
        level = levels[-1].where("is_folder").select("path")
        n = level.count()
    out = levels[0]
    for more in levels[1:]:
        out = out.unionByName(more)
    return out.where("not is_folder").select("path", "size")


def spread(found: DataFrame, size: str, most: int = PART_BYTES) -> DataFrame:
    """What is to be read, dealt out to tasks by the bytes that the column size tells."""
    total = found.agg(F.coalesce(F.sum(F.col(size) + SMALL_BYTES), F.lit(0))).first()[0]
    return found.repartition(max(1, -(-total // most)))


@dataclass
class Files(InputPartition):
    """Files that one task reads."""

    paths: list[str]


def parted(found: list, size: Callable[[Any], int], most: int = PART_BYTES, opening: int = OPEN_BYTES) -> list[list]:
    """What is to be read, in order, as much to a part as its bytes allow, one at least."""
    parts: list[list] = []
    held = 0
    for f in found:
        cost = size(f) + opening
        if not parts or held + cost > most:
            parts.append([])
            held = 0
        parts[-1].append(f)
        held += cost
    return parts


def packed(found: list[fs.FileInfo], most: int = PART_BYTES, opening: int = OPEN_BYTES) -> list[Files]:
    """Files in order, as many to a partition as its bytes allow."""
    return [Files([f.path for f in some]) for some in parted(found, lambda f: f.size, most, opening)]


@dataclass
class Written(WriterCommitMessage):
    """The folder that a task has staged its files in, and how many they are; what they are to be called is listed there."""

    folder: str
    count: int


class StagedWriter(DataSourceArrowWriter):
    """Rows of a file stand together in a task; each task stages its files, the driver moves them when all have ended.

    What a failed or repeated task has staged is in a folder of that attempt and goes with the staging folder. To append,
    a name must be free; to overwrite, files of the format's ending that were there go. A task lists the names of its files
    beside them, and the driver reads these lists NAMES at a time.
    """

    ending = ""

    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite = path, overwrite
        self.staging = f"_staging-{uuid.uuid4().hex}"

    @abstractmethod
    def encoded(self, rows: list[dict]) -> bytes:
        """The bytes of one file, from its rows."""

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        system, root = file_system(self.path)
        context = TaskContext.get()
        folder = f"{root}/{self.staging}/{context.partitionId()}-{context.attemptNumber()}-{context.taskAttemptId()}"
        system.create_dir(folder, recursive=True)
        done: dict[str, None] = {}

        def put(name: str, rows: list[dict]) -> None:
            if name in done:
                raise ValueError(f"rows of {name} don't stand together")
            if not name or any(part in ("", ".", "..") for part in name.split("/")):
                raise ValueError(f"{name!r} is no name for a file")
            with system.open_output_stream(f"{folder}/{len(done)}") as out:
                out.write(self.encoded(rows))
            done[name] = None

        held: list[dict] = []
        for batch in iterator:
            for row in batch.to_pylist():
                if held and row["path"] != held[0]["path"]:
                    put(held[0]["path"], held)
                    held = []
                held.append(row)
        if held:
            put(held[0]["path"], held)
        with system.open_output_stream(f"{folder}/{LIST}") as out:
            for name in done:
                out.write(f"{json.dumps(name)}\n".encode())
        return Written(folder, len(done))

    def _moves(self, messages: list[WriterCommitMessage | None]) -> Iterator[list[tuple[str, str]]]:
        """What is to be moved where, NAMES at a time."""
        system, root = file_system(self.path)
        for m in messages:
            if m and m.count:
                with io.BufferedReader(system.open_input_file(f"{m.folder}/{LIST}")) as names:
                    some = []
                    for k, line in enumerate(names):
                        some.append((f"{m.folder}/{k}", f"{root}/{json.loads(line)}"))
                        if len(some) >= NAMES:
                            yield some
                            some = []
                    yield some

    def _check_names(self, messages: list[WriterCommitMessage | None]) -> None:
        """Each name is one task's: digests of names are held, DIGESTS at a time, and names only where digests are equal."""
        digest = lambda name: int.from_bytes(hashlib.blake2b(name.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")
        parts = -(-sum(m.count for m in messages if m) // DIGESTS)
        for part in range(parts):
            held = [np.fromiter((x for _, t in some if (x := digest(t)) % parts == part), np.uint64) for some in self._moves(messages)]
            values, counts = np.unique(np.concatenate(held), return_counts=True)
            if again := set(values[counts > 1].tolist()):
                names = Counter(t for some in self._moves(messages) for _, t in some if digest(t) in again)
                if max(names.values()) > 1:
                    raise ValueError("rows of a file are spread over tasks")

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        system, _ = file_system(self.path)
        try:
            self._check_names(messages)
            if self.overwrite:
                for old, _ in files_in(self.path, self.ending):
                    system.delete_file(old)
            else:
                for some in self._moves(messages):
                    if taken := [i.path for i in system.get_file_info([t for _, t in some]) if i.type != fs.FileType.NotFound]:
                        raise FileExistsError(taken[0])
            with ThreadPoolExecutor(MOVES) as pool:
                for some in self._moves(messages):
                    for folder in {t.rsplit("/", 1)[0] for _, t in some}:
                        system.create_dir(folder, recursive=True)
                    deque(pool.map(lambda m: system.move(*m), some), 0)
        finally:
            self.abort(messages)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        system, root = file_system(self.path)
        if system.get_file_info(f"{root}/{self.staging}").type != fs.FileType.NotFound:
            system.delete_dir(f"{root}/{self.staging}")
