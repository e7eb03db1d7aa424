"""Language identification by compression against per-language zstandard dictionaries."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import small_batches, utf8

#: What is between letters: encoded as one blank, so that case, digits and marks don't decide.
OTHER, LETTER = regex.compile(r"[^\p{L}\p{M}]+"), regex.compile(r"\p{L}")


@dataclass(frozen=True)
class Options:
    """The bounded training sample: dict_docs labelled documents a language, dict_bytes of each, from a place that the id's hash tells."""

    dict_docs: int = 128
    dict_bytes: int = 512
    #: Texts are encoded in blocks of so many bytes, so that the dictionary and not the text's own past decides.
    block: int = 1024
    level: int = 5
    #: A text is rejected if the best language saves less than this share of the second best's size, or fewer bytes.
    margin: float = 0.002
    margin_bytes: int = 1


def letters(text: bytes) -> bytes:
    """The text in lower case, with each run of other characters than letters and their marks as one blank; empty without a letter."""
    out = OTHER.sub(" ", text.decode("utf-8", "replace").lower()).strip()
    return out.encode() if LETTER.search(out) else b""


def train(docs: DataFrame, options: Options = Options()) -> dict[str, bytes]:
    """Raw dictionary content of each language, from the labelled rows of docs(doc_id, text, lang).

    The sample is the dict_docs rows with the smallest hashes of the id, so it doesn't depend on the
    order of rows. Rows without text or language teach nothing.
    """
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (F.length("text") > 0))
    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    ids = rows.select("doc_id", "lang").withColumn("r", F.row_number().over(order)).where(F.col("r") <= options.dict_docs)
    picked = ids.select("doc_id", "lang").distinct().collect()
    languages = sorted({r.lang for r in picked})
    if not picked:
        return {}
    chosen = rows.where(F.col("doc_id").isin([r.doc_id for r in picked if r.doc_id is not None]))
    words = F.regexp_replace(F.lower("text"), r"[^\p{L}\p{M}]+", " ")
    at = F.pmod(F.xxhash64("doc_id", F.lit(1)), F.greatest(F.length(words) - options.dict_bytes + 1, F.lit(1))) + 1
    piece = F.substr(words, at.cast("int"), F.lit(options.dict_bytes))
    sample = chosen.select("lang", piece.alias("piece"), F.xxhash64("doc_id").alias("o"), "doc_id").distinct()
    content: dict[str, list[bytes]] = {k: [] for k in languages}
    first = sample.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy("o", "doc_id", "piece"))).where(F.col("r") <= options.dict_docs)
    for r in sorted(first.collect(), key=lambda r: (r.lang, r.r)):
        content[r.lang].append(r.piece.encode())
    return {k: b"\n".join(v) for k, v in content.items() if v}


def classify(texts: list[bytes], dictionaries: dict[str, bytes], options: Options) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(language, score, rejected) of each text. The score is the posterior share of the best code length."""
    names = sorted(dictionaries)
    encoders = []
    for k in names:
        d = zstandard.ZstdCompressionDict(dictionaries[k], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        d.precompute_compress(level=options.level)
        encoders.append(zstandard.ZstdCompressor(dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False).compress)
    lang, score, rejected = [], np.zeros(len(texts)), np.ones(len(texts), bool)
    for i, text in enumerate(map(letters, texts)):
        if not names or not text:
            lang.append("und")
            continue
        blocks = [text[a : a + options.block] for a in range(0, len(text), options.block)]
        size = np.array([sum(map(len, map(encode, blocks))) for encode in encoders])
        best = int(size.argmin())
        lang.append(names[best])
        score[i] = 1 / np.exp2(-8.0 * np.minimum(size - size[best], 100)).sum()
        if len(names) > 1:
            second = int(np.partition(size, 1)[1])
            rejected[i] = second - size[best] < max(options.margin_bytes, options.margin * second)
        else:
            rejected[i] = False
    return lang, score, rejected


def identify(docs: DataFrame, dictionaries: dict[str, bytes], options: Options = Options()) -> DataFrame:
    """(doc_id, lang_pred, score, rejected) for every row of docs, from whole texts alone.

    A null text or one without a letter is `und`, scores 0 and is rejected, as is every text where
    nothing was learned. A tie goes to the smaller code and is rejected. Repeated rows stay; only
    doc_id and text are read, so other columns may clash. An empty table gives no rows.
    """
    small_batches(docs.sparkSession)
    kind = dict(docs.dtypes)["doc_id"]
    sent = docs.sparkSession.sparkContext.broadcast(dictionaries)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for batch in batches:
            lang, score, rejected = classify(utf8(batch.column(1)), sent.value, options)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lang, pa.string()), pa.array(score), pa.array(rejected)], ["doc_id", "lang_pred", "score", "rejected"])

    return docs.select("doc_id", F.col("text").cast("string")).mapInArrow(run, f"doc_id {kind}, lang_pred string, score double, rejected boolean")


def accepted(docs: DataFrame, dictionaries: dict[str, bytes], options: Options = Options()) -> DataFrame:
    """The rows of docs that identify() doesn't reject, each decided by its own text alone, with all their columns."""
    small_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(dictionaries)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(~classify(utf8(batch.column(at)), sent.value, options)[2]))

    return docs.mapInArrow(run, docs.schema)
