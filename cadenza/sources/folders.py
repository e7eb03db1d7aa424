"""Folders on a disk that driver and executors share, listed by Spark: each level of the tree is one job."""

from __future__ import annotations

import os
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..shared import stored

SCHEMA = "folder string, name string, path string, is_dir boolean, size long"
#: Folders that one task lists.
PER_TASK = 200


def _entries(folders: Iterable[str]) -> Iterator[tuple[str, str, str, bool, int | None]]:
    for folder in folders:
        try:
            with os.scandir(folder) as found:
                for e in found:
                    try:
                        if e.is_symlink():
                            continue
                        if e.is_dir(follow_symlinks=False):
                            yield folder, e.name, e.path, True, None
                        elif e.is_file(follow_symlinks=False):
                            yield folder, e.name, e.path, False, e.stat(follow_symlinks=False).st_size
                    except OSError:
                        continue
        except OSError:
            continue


def walked(spark: SparkSession, root: str) -> DataFrame:
    """(folder, name, path, is_dir, size) of all files and folders under root, links aside; what can't be read is left out.

    The folders of a level are dealt out, listed, and written; those found are the next level. So a tree costs
    a job a level, no task holds more than PER_TASK folders' names, and nothing but counts comes to the driver.
    """

    def listing(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["folder", "name", "path", "is_dir", "size"]
        kinds = [pa.string(), pa.string(), pa.string(), pa.bool_(), pa.int64()]
        for batch in batches:
            rows: list[tuple] = []
            for row in _entries(batch.column(0).to_pylist()):
                rows.append(row)
                if len(rows) >= 10_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    level, levels = spark.createDataFrame([(os.path.abspath(root),)], "folder string"), []
    n = 1
    while n:
        levels.append(stored(level.repartition(-(-n // PER_TASK)).mapInArrow(listing, SCHEMA), "level"))
        level = levels[-1].where("is_dir").select(F.col("path").alias("folder"))
        n = level.count()
    out = levels[0]
    for more in levels[1:]:
        out = out.unionByName(more)
    return out


def listed(entries: DataFrame) -> DataFrame:
    """walked() rows with their place in their folder: folders first, then names without case."""
    order = Window.partitionBy("folder").orderBy(F.desc("is_dir"), F.lower("name"), "name")
    return entries.withColumn("place", F.row_number().over(order))


def folder_sizes(entries: DataFrame, root: str) -> DataFrame:
    """(folder, size, files): the bytes and number of files under each folder below root and under root itself.

    Each file counts for all folders above it, summed before the shuffle, so the root is a row a task.
    """
    root = os.path.abspath(root)
    parts = F.split(F.substr(F.col("folder"), F.lit(len(root) + 2)), "/")
    below = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.concat(F.lit(f"{root}/"), F.array_join(F.slice(parts, 1, n), "/")))
    above = F.when(F.col("folder") == root, F.array(F.lit(root))).otherwise(F.concat(F.array(F.lit(root)), below))
    files = entries.where("not is_dir").select(F.explode(above).alias("folder"), "size").groupBy("folder").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("files"))
    folders = entries.where("is_dir").select(F.col("path").alias("folder")).unionByName(entries.sparkSession.createDataFrame([(root,)], "folder string"))
    return folders.join(files, "folder", "left").na.fill(0, ["size", "files"])
