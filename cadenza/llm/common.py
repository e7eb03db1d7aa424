"""Shared plumbing: tables in the shared folder, joins on skewed keys, digests."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a maximal run of anything but the six ASCII blanks.
WORD = r"[^\x20\x09-\x0D]+"
#: Keys held by more than one row in HOT_SHARE are joined by broadcast, so at most HOT_SHARE rows are sent.
HOT_SHARE = 1000
#: Rows of text in one Arrow batch: long texts must not add up to more than a Python worker's memory.
TEXT_ROWS = 256


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from spark.checkpoint.dir. Where that is unset and all runs in one process, as in tests, one of this machine."""
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = f"{tempfile.gettempdir()}/checkpoints/cadenza"
    return folder.rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read back: cuts lineage, computes once, outlives a lost executor."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def chunk_of(row: Column | str) -> Column:
    """The chunk that a row of numbered() is in."""
    return F.shiftright(row, 33).cast("long")


def by_chunk(df: DataFrame, name: str, buckets: int) -> DataFrame:
    """df written once, bucketed by its column chunk, and read back.

    What is found out about rows is joined on (chunk, row): it goes to the chunk's bucket, and the rows stay where
    they are. For that Spark may not ask that both columns deal out both sides, so this is set for the session.
    """
    spark = df.sparkSession
    spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
    table_name = f"{name}_{uuid.uuid4().hex}"
    df.write.option("path", f"{shared_dir(spark)}/{table_name}").bucketBy(buckets, "chunk").saveAsTable(table_name)
    found = spark.table(table_name)
    spark.sql(f"drop table {table_name}")  # the files stay; only the name goes
    return found


def numbered(df: DataFrame, name: str, n_bytes: int) -> DataFrame:
    """df with row, a number of its own for each row, and chunk, the task that wrote it; see by_chunk()."""
    rows = df.select(F.monotonically_increasing_id().alias("row"), "*").select(chunk_of("row").alias("chunk"), "*")
    return by_chunk(rows, name, parts_for(n_bytes, 32 << 20, df.sparkSession))


def small_batches(spark: SparkSession, rows: int = TEXT_ROWS) -> None:
    """Bound the Arrow batches that carry whole texts; a lower bound that is set stays, as several results may be waiting to be run."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key))
    if not 0 < now <= rows:
        spark.conf.set(key, str(rows))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def map_batches(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterable[pa.RecordBatch]], schema: str) -> DataFrame:
    return df.mapInArrow(fn, schema)


def parts_for(n_rows: int, per_part: int, spark: SparkSession) -> int:
    """Partitions for n_rows, never fewer than the session's shuffle setting."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n_rows // per_part))


def join_skewed(big: DataFrame, small: DataFrame, key: str, hot: DataFrame, how: str = "left") -> DataFrame:
    """big join small on key where a few keys may hold most of big's rows.

    small has one row a key. hot lists keys that each hold over 1/HOT_SHARE of big's rows, hence at
    most HOT_SHARE of them: their part of small is broadcast, and only the other keys are shuffled.
    Null keys match nothing. how is left or inner.
    """
    flag = f"hot {uuid.uuid4().hex}"
    hot = hot.select(key).where(F.col(key).isNotNull()).distinct().withColumn(flag, F.lit(True))
    marked = big.join(F.broadcast(hot), key, "left")
    hot_small = small.join(F.broadcast(hot.drop(flag)), key, "left_semi")
    spread = marked.where(F.col(f"`{flag}`")).drop(flag).join(F.broadcast(hot_small), key, how)
    rest = marked.where(F.col(f"`{flag}`").isNull() & F.col(key).isNotNull()).drop(flag).join(small, key, how)
    out = spread.unionByName(rest)
    if how == "left":
        none = marked.where(F.col(key).isNull()).drop(flag)
        out = out.unionByName(none, allowMissingColumns=True)
    return out


def hot_keys(counts: DataFrame, key: str, n: str, total: int) -> DataFrame:
    """Keys of counts(key, n) that hold over 1/HOT_SHARE of total rows: at most HOT_SHARE rows."""
    return counts.where(F.col(n) > max(1, total // HOT_SHARE)).select(key)


def sha256_hex(x: Column | str) -> Column:
    return F.sha2(F.col(x) if isinstance(x, str) else x, 256)


def crc32_mod(column: str, modulus: int) -> Column:
    """crc32 of the column as text, modulo modulus; a null counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % modulus


def utf8(array: pa.Array) -> list[bytes]:
    """The texts of a string column as bytes, null as empty."""
    return [b"" if x is None else x for x in array.cast(pa.large_binary()).to_pylist()]
