"""The registered queries of this subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import brown, collocations, linededup, mixing, packing, periodic, secrets, warc
from .common import crc32_mod, table
from .decontaminate import contaminated
from .langid import identify, train
from .linededup import drop_boilerplate
from .mixing import mix
from .postings import nearest
from .simhash import near_duplicates
from .suffixes import remove_repeats
from .warc import archive


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every document; the models learn from a bounded sample of them."""
    docs = table(spark, sf_dir, "documents")
    return secrets.find_secrets(docs, secrets.train(docs))


def op2_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    return near_duplicates(table(spark, sf_dir, "documents"), words=3, radius=3)


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of every document; a third of them are held out of training."""
    docs = table(spark, sf_dir, "documents").withColumn("held_out", crc32_mod("doc_id", 3) == 1)
    found = identify(docs, train(docs.where(~F.col("held_out"))))
    return found.select("doc_id", (crc32_mod("doc_id", 3) == 1).alias("held_out"), "lang_pred", "score", "rejected")


def op4_class_ngrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class-based and unigram log-probability of every document; a seventh of them is held out."""
    return brown.score(table(spark, sf_dir, "documents"), crc32_mod("doc_id", 7) == 2)


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without the strings of 50 bytes that earlier ones hold."""
    return remove_repeats(table(spark, sf_dir, "documents"))


def op6_warc_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page as written to WARC files and read back, in the order of the merged index."""
    return archive(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op7_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best window of each document for each benchmark item it holds."""
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest of every hundredth vector."""
    vectors = table(spark, sf_dir, "embeddings")
    return nearest(vectors, vectors.where(F.col("vec_id") % 100 == 0), 10)


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the mix takes of every document."""
    return mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the boilerplate lines of its source."""
    return drop_boilerplate(table(spark, sf_dir, "documents")).select("doc_id", "source", "n_lines", "n_dropped", F.coalesce("text", F.lit("")).alias("text"))


def op11_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 2,000 most tightly bound phrases of two or three words in each language."""
    return collocations.collocations(table(spark, sf_dir, "documents"), most=3, least=10, inside=50, top=2000)


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periodic runs of every document, some of which repeat a stretch of theirs."""
    return periodic.find_runs(table(spark, sf_dir, "documents"), plant=True).drop("runs", "text")


def op13_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every document and its place in a sequence of 1,024 tokens."""
    import public_tokenizers

    packed = packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k[:2] == "op" and k[2:3].isdigit()}


def oracle_sql() -> dict[str, str]:
    return {"op6_warc_archive": warc.ORACLE_SQL, "op9_mixing": mixing.ORACLE_SQL, "op10_line_dedup": linededup.ORACLE_SQL, "op11_phrase_collocations": collocations.ORACLE_SQL}
