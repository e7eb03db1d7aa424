"""Readers of timed text: SRT blocks as DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.languages import normalize_language

TIMES = r"(\d+):(\d\d):(\d\d)[,.](\d{3})\s*-->\s*(\d+):(\d\d):(\d\d)[,.](\d{3})"


def parse_srt(files: DataFrame) -> DataFrame:
    """files(path, text) to (path, pos, start_ms, end_ms, raw_text), one row a block with a time line."""
    text = F.regexp_replace(F.regexp_replace("text", "^﻿", ""), r"\r\n?", "\n")
    blocks = files.select("path", F.posexplode(F.split(text, r"\n[ \t]*\n+")).alias("pos", "block"))
    ms = lambda k: sum((F.regexp_extract("block", TIMES, k + i).cast("long") * f for i, f in enumerate((3_600_000, 60_000, 1000, 1))), F.lit(0))
    body = F.regexp_replace("block", r"(?s)^.*?-->[^\n]*\n?", "")
    return blocks.where(F.col("block").rlike(TIMES)).select("path", F.col("pos").cast("long").alias("pos"), ms(1).alias("start_ms"), ms(5).alias("end_ms"), F.btrim(body, F.lit(" \t\n")).alias("raw_text"))


#: Characters of code page 1252 at 80 to 9F; the others there are not used.
CP1252 = "€\x81‚ƒ„…†‡ˆ‰Š‹Œ\x8dŽ\x8f\x90‘’“”•–—˜™š›œ\x9džŸ"


def decoded(content: Column) -> Column:
    """Bytes as text: UTF-8, else code page 1252, else Latin-1; the first that fits."""
    latin = F.decode(content, "ISO-8859-1")
    upper = "".join(map(chr, range(0x80, 0xA0)))
    page = F.when(~latin.rlike("[\x81\x8d\x8f\x90\x9d]"), F.translate(latin, upper, CP1252))
    return F.coalesce(F.try_validate_utf8(content), page, latin)


def read_srt(spark: SparkSession, path: str) -> DataFrame:
    """Whole SRT files under path, each in the encoding that fits it."""
    files = spark.read.format("binaryFile").load(path)
    return parse_srt(files.select("path", decoded(F.col("content")).alias("text")))


def speech_streams(probes: DataFrame) -> DataFrame:
    """probes(id, probe), a media probe's JSON, as its audio streams: (id, duration_s, stream, codec, language)."""
    shape = "struct<format:struct<duration:string>,streams:array<struct<index:int,codec_type:string,codec_name:string,tags:struct<language:string>>>>"
    p = probes.select("id", F.from_json("probe", shape).alias("p"))
    p = p.select("id", F.coalesce(F.col("p.format.duration").try_cast("double"), F.lit(0.0)).alias("duration_s"), F.explode("p.streams").alias("s")).where("s.codec_type = 'audio'")
    return p.select("id", "duration_s", F.col("s.index").alias("stream"), F.coalesce("s.codec_name", F.lit("")).alias("codec"), normalize_language(F.col("s.tags.language")).alias("language"))


def suggestions(answers: DataFrame) -> DataFrame:
    """answers(id, answer), a title search's JSON, as titles with an id: (id, place, title_id, title, year, kind)."""
    p = answers.select("id", F.from_json("answer", "struct<d:array<struct<id:string,l:string,y:int,q:string>>>").alias("a"))
    p = p.select("id", F.posexplode("a.d").alias("place", "t")).where("coalesce(t.id, '') <> '' and coalesce(t.l, '') <> ''")
    return p.select("id", F.col("place").cast("long").alias("place"), F.col("t.id").alias("title_id"), F.col("t.l").alias("title"), F.col("t.y").alias("year"), F.col("t.q").alias("kind"))
