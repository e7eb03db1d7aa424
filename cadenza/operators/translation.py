"""Translation of subtitle files by services: batches out, answers in, what failed to the next service."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from . import batches, structure_line, text_blocks
from ..functions.payloads import escape_controls, json_slice, with_texts
from ..progress import Progress
from ..shared import stored

#: Takes the texts of a batch and gives a service's answer, JSON with the texts; or raises.
Translator = Callable[[list[str]], str]


def dictionary(words: dict[str, str]) -> Translator:
    """A translator without a network: words that the dictionary has are replaced, letter case aside."""

    def run(texts: list[str]) -> str:
        said = [" ".join(words.get(w.lower(), w) for w in t.split(" ")) for t in texts]
        return json.dumps([{"index": str(i), "content": t} for i, t in enumerate(said)])

    return run


def asked(items: DataFrame, translator: Translator) -> DataFrame:
    """items(track_id, batch, texts), whether they were answered or not, with (n, payload, error) beside their columns: a row a batch.

    A translator that raises fails its batch alone; error is what it said. Batches of one task are asked one
    after another, so partitions are the requests under way at once.
    """

    def ask(found: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in found:
            sizes, payloads, errors = [], [], []
            for texts in some.column("texts").to_pylist():
                sizes.append(len(texts))
                try:
                    payloads.append(translator(texts))
                    errors.append(None)
                except Exception as error:  # a service's failure is a row, whatever it is
                    payloads.append(None)
                    errors.append(f"{type(error).__name__}: {error}")
            more = [pa.array(sizes, pa.int32()), pa.array(payloads, pa.string()), pa.array(errors, pa.string())]
            yield pa.RecordBatch.from_arrays([*some.columns, *more], [*some.schema.names, "n", "payload", "error"])

    schema = StructType([*items.schema.fields, StructField("n", IntegerType()), StructField("payload", StringType()), StructField("error", StringType())])
    return items.mapInArrow(ask, schema)


def translated_batches(items: DataFrame, translators: list[tuple[str, Translator]], progress: Progress | None = None) -> DataFrame:
    """items(track_id, batch, texts) as (track_id, batch, translator, texts, error): texts from the first translator that gave all of them.

    Those that raise, or whose answer is no list of all texts, leave the batch to the next one. A batch
    that none has translated has null texts and the last one's error. Other columns of items go along. A service's answers
    are read and written in one pass without a shuffle, the texts of batches that it failed beside them, so that no service is asked
    twice for what it has answered. progress is told the texts that each service has translated and the batches that it
    failed, counted as they are written.
    """
    progress = progress or Progress()
    others = [c for c in items.columns if c not in ("track_id", "batch", "texts")]
    waiting, done, errors = items, [], None
    for name, translator in translators:
        answers = asked(waiting, translator).withColumnRenamed("texts", "source")
        # an answer is read as it is, else as what is between its brackets, repaired
        fine = F.when(F.try_parse_json("payload").isNotNull(), F.col("payload")).otherwise(escape_controls(json_slice(F.col("payload"))))
        read = with_texts(answers.withColumn("payload", F.when(F.col("payload").isNotNull(), fine)))
        error = F.when(F.col("valid"), None).otherwise(F.coalesce("error", F.lit("answer without all texts")))
        read = read.select("track_id", "batch", *others, F.lit(name).alias("translator"), "texts", error.alias("error"), F.when(~F.col("valid"), F.col("source")).alias("source"))
        failed = F.col("error").isNotNull()
        counts = {"texts": F.coalesce(F.sum(F.when(~failed, F.size("texts"))), F.lit(0)), "failed": F.count_if(failed)}
        read = stored(progress.watched(read, name, **counts), "translated")
        progress.advance(progress.at(name)["texts"])
        done.append(read.where("error is null").drop("source"))
        errors = read.where("error is not null")
        waiting = errors.select("track_id", "batch", *others, F.col("source").alias("texts"))
    errors = errors.drop("source")
    for more in done:
        errors = errors.unionByName(more)
    return errors


def translate(lines: DataFrame, translators: list[tuple[str, Translator]], most: int = 50, chars: int = 0, parts: int | None = None, callback: Callable[[int, int], None] | None = None) -> tuple[DataFrame, DataFrame]:
    """lines(track_id, line_no, line) of SRT files, translated, and the batches with who translated them and what failed.

    Text blocks go in batches of at most `most` texts and `chars` characters (0: any) through
    translated_batches() and come back where they were: a batch knows the lines that its blocks begin at, so the new
    lines and those of structure are the result, without a join. A track with a batch that none has translated
    has no lines: half a translation is none. parts limits how many batches are under way at once;
    callback(texts translated, all texts) is called when a service has ended. (X3)
    """
    progress = Progress(callback)
    blocks = text_blocks(lines, begins=True).withColumnRenamed("block", "pos")
    numbered = batches(blocks, most, chars, keep=("line_no", "text"))
    ordered = F.sort_array(F.collect_list(F.struct("pos", "line_no", "text")))
    items = numbered.groupBy("track_id", "batch").agg(ordered.alias("all")).select("track_id", "batch", F.col("all.line_no").alias("begins"), F.col("all.text").alias("texts"))
    items = items if parts is None else items.repartition(parts)
    items = stored(progress.watched(items, "batches", texts=F.coalesce(F.sum(F.size("texts")), F.lit(0))), "batches")
    progress.total = progress.at("batches")["texts"]
    found = translated_batches(items, translators, progress)
    new = found.where("error is null").select("track_id", F.explode(F.arrays_zip("begins", "texts")).alias("x")).select("track_id", F.col("x.begins").alias("line_no"), F.col("x.texts").alias("line"))
    out = lines.where(structure_line()).select("track_id", "line_no", "line").unionByName(new)
    if progress.at(translators[-1][0])["failed"]:
        failed = found.where("error is not null").select(F.col("track_id").alias("failed")).distinct()
        out = out.join(failed, F.col("track_id").eqNullSafe(F.col("failed")), "left_anti")
    return out, found.drop("begins")
