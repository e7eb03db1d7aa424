"""The corpus pipeline: documents in, a cleaned, deduplicated and mixed corpus out.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept. All but the last
return the columns of documents; the last returns what the mix takes of each document.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza.llm.common import chunk_of, numbered, stored, table
from cadenza.llm.decontaminate import clean
from cadenza.llm.langid import accepted, train
from cadenza.llm.linededup import drop_boilerplate
from cadenza.llm.mixing import mix
from cadenza.llm.nearcopies import one_of_each


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the compressor can't tell go; the model learns from those labelled.

    Each row is decided by its own text, whatever its id: repeated rows share their fate, null and
    letterless texts go.
    """
    return accepted(docs, train(docs))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Boilerplate lines of a source go from the texts; n_chars follows. No row goes; null texts and rows without a source stay as they are."""
    out = drop_boilerplate(docs)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("n_dropped") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return out.select(docs.columns)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies stays: that with the smallest id; rows without an id come last.

    Near copies have a similarity of 0.8 or more on five-word shingles. Each row counts by itself, so
    of equal rows, whether their ids are equal or null, one stays.
    """
    n_bytes = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    rows = numbered(docs.select(F.struct("*").alias("doc")), "rows", n_bytes)
    kept = stored(one_of_each(rows.select("chunk", "row", F.col("doc.doc_id").alias("id"), F.col("doc.text").cast("string").alias("text")), n_bytes), "kept")
    return rows.join(kept.select(chunk_of("row").alias("chunk"), "row").hint("shuffle_hash"), ["chunk", "row"], "left_semi").select("doc.*")


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go; each row is decided by its own text, whatever its id."""
    return clean(docs, table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the mix takes of every document that is left, a row each; repeated rows are taken like others."""
    return mix(docs, table(spark, sf_dir, "labels"))


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("simhash_near_dedup", simhash_near_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("mixing", mixing),
]
#: Compression, SimHash and Hamming blocks have no form in SQL; tests/llm/test_pipeline.py holds the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each one's result is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    name, stage = STAGES[-1]
    return stage(spark, docs, sf_dir)
