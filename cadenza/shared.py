"""Tables written to the folder that driver and executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from spark.checkpoint.dir. Where that is unset and all runs in one process, as in tests, one of this machine."""
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = f"{tempfile.gettempdir()}/checkpoints/cadenza"
    return folder.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    """A folder of its own in the shared one."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read back: computed once, and what comes after outlives a lost executor."""
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def parts_for(n_bytes: int, spark: SparkSession, most: int = 32 << 20) -> int:
    """Partitions of so many bytes at most, never fewer than the session's shuffle setting."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n_bytes // most))


def dealt(df: DataFrame, name: str, key: str, parts: int) -> DataFrame:
    """df written to the shared folder, dealt out by key, and read back: steps that need the rows of a key together, joins too, then shuffle nothing.

    Rows that lie in partitions by this key and number are written where they are.
    """
    spark = df.sparkSession
    named = f"{name}_{uuid.uuid4().hex}"
    df.write.option("path", f"{shared_dir(spark)}/{named}").option("compression", "zstd").bucketBy(parts, key).saveAsTable(named)
    found = spark.table(named)
    spark.sql(f"drop table {named}")  # the files stay; only the name goes
    return found
