"""Queries on files written and read again: subtitle texts, and Blu-ray streams made of documents."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from ..operators import screens as S
from ..shared import new_folder
from ..sources import idx, srt, sup
from .common import CUES, dealt_cues, table


def srt_files(spark, sf_dir):
    """Every track written as an SRT file, a third of them in code page 1252 where that has all their letters, and read again."""
    cues, _ = dealt_cues(spark, sf_dir)
    plain = F.bool_and(F.col("raw_text").rlike(r"^[\x00-\x7f\xa0-\xff]*$")).over(Window.partitionBy("track_id"))
    named = cues.withColumn("encoding", F.when((F.col("track_id") % 3 == 1) & plain, "cp1252").otherwise("utf-8")).select(F.concat(F.lit("t"), F.col("track_id") % 7, F.lit("/"), "track_id", F.lit(".synced.srt")).alias("path"), "pos", "start_ms", "end_ms", F.col("raw_text").alias("text"), "encoding")
    folder = new_folder(spark, "srt")
    srt.write_srt(named, folder, together=True)
    back = srt.read_srt_files(spark, folder)
    return back.select(F.regexp_extract("path", r"(\d+)\.synced\.srt$", 1).cast("long").alias("track_id"), "pos", "start_ms", "end_ms", "text", "encoding")


def _hex(x: Column | int, n: int) -> Column:
    return F.lpad(F.hex(x if isinstance(x, Column) else F.lit(x).cast("long")), 2 * n, "0")


def _segments(docs):
    """Blu-ray streams from documents: a screen of one object, whose data are the text's bytes in fragments of 500, with a palette; two of three are cleared."""
    d = docs.where("text is not null").select("doc_id", F.encode("text", "UTF-8").alias("data"), F.octet_length("text").alias("n"))
    i, n = F.col("doc_id"), F.col("n")
    composition = lambda k: F.concat(_hex(1920, 2), _hex(1080, 2), _hex(16, 1), _hex(i % 65536, 2), _hex(128, 1), _hex(0, 1), _hex(i % 256, 1), _hex(k, 1))
    placed = F.concat(_hex(i % 60000, 2), _hex(0, 1), _hex(0, 1), _hex(n % 1000, 2), _hex(n % 700, 2))
    entry = lambda k: F.concat(_hex((k * 5) % 7, 1), _hex((i * 3 + k * 31) % 256, 1), _hex((i * 7 + k) % 256, 1), _hex((i + n * k) % 256, 1), _hex((n + k) % 256, 1))
    palette = F.concat(_hex(0, 1), _hex(0, 1), F.array_join(F.transform(F.sequence(F.lit(0).cast("long"), F.lit(8).cast("long")), entry), ""))
    last = F.floor((F.greatest(n, F.lit(1)) - 1) / 500)
    flag = lambda k: F.when(k == 0, 128).otherwise(0) + F.when(k == last, 64).otherwise(0)
    part = lambda k: F.concat(
        _hex(i % 60000, 2), _hex(0, 1), _hex(flag(k), 1), F.when(k == 0, F.concat(_hex(0, 3), _hex(n % 1000, 2), _hex(n % 700, 2))).otherwise(""), F.hex(F.substring("data", (k * 500 + 1).cast("int"), F.lit(500)))
    )
    row = lambda late, kind, body: F.struct(late.alias("late"), F.lit(kind).alias("kind"), body.alias("body"))
    zero = F.lit(0).cast("long")
    fragments = F.transform(F.sequence(zero, last), lambda k: row(zero, S.OBJECT, part(k)))
    clear = F.when(i % 3 != 0, F.array(row(2000 + n, S.COMPOSITION, composition(0)))).otherwise(F.array().cast("array<struct<late:bigint,kind:int,body:string>>"))
    rows = F.concat(F.array(row(zero, S.COMPOSITION, F.concat(composition(1), placed)), row(zero, S.PALETTE, palette)), fragments, clear)
    out = d.select("doc_id", F.posexplode(rows).alias("at", "r"))
    return out.select(F.concat("doc_id", F.lit(".sup")).alias("path"), F.col("at").cast("long").alias("at"), ((i * 1000 % 1_000_000 + F.col("r.late")) * 90).alias("pts"), F.lit(0).cast("long").alias("dts"), F.col("r.kind").alias("kind"), F.unhex("r.body").alias("payload"))


def _screens(spark, sf_dir):
    folder = new_folder(spark, "sup")
    sup.write_sup(_segments(table(spark, sf_dir, "documents")), folder)
    return S.screens(sup.read_sup(spark, folder, 64 << 10).withColumn("path", F.regexp_extract("path", r"(\d+)\.sup$", 1)))


def sup_screens(spark, sf_dir):
    """Screens and their objects, from streams written and read by ranges of bytes."""
    rows = _screens(spark, sf_dir)
    one = S.objects(rows).select("path", "screen", F.col("id"), F.octet_length("data").alias("bytes"), F.md5("data").alias("digest"))
    out = S.shown(rows).join(one, ["path", "screen"])
    return out.select(F.col("path").cast("long").alias("doc_id"), "screen", "start_ms", "end_ms", "width", "height", "number", "palette", F.col("objects")[0]["x"].alias("x"), F.col("objects")[0]["y"].alias("y"), "id", F.col("bytes").cast("long").alias("bytes"), "digest")


def sup_palettes(spark, sf_dir):
    """The colours of every stream's palette, of entries named twice the last."""
    return S.palettes(_screens(spark, sf_dir)).select(F.col("path").cast("long").alias("doc_id"), "entry", "red", "green", "blue", "alpha")


def idx_pictures(spark, sf_dir):
    """Pictures of IDX files made of events, fifty lines each: remarks, two palettes of which one is short, and files without any."""
    i, k = F.col("event_id"), F.col("event_id") % 50
    stamp = F.format_string("%02d:%02d:%02d:%03d", (i % 30).cast("int"), (i % 60).cast("int"), ((i * 7) % 60).cast("int"), (i % 1000).cast("int"))
    colours = lambda n: F.array_join(F.transform(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")), lambda j: F.lpad(F.lower(F.hex((i + j) * 4111 % 16777216)), 6, "0")), ", ")
    line = (
        F.when(k == 3, F.when(F.floor(i / 50) % 5 == 4, F.lit("")).otherwise(F.concat(F.lit(" Palette: "), colours(18)))).when(k == 5, F.concat(F.lit("palette: "), colours(15)))
        .when(k % 7 == 0, F.concat(F.lit("# timestamp: "), stamp, F.lit(", filepos: 0"))).otherwise(F.concat(F.lit("  timestamp: "), stamp, F.lit(" ,filepos: "), F.lpad(F.hex(i * 2048), 9, "0"), F.lit(" ")))
    )
    lines = table(spark, sf_dir, "events").select(F.floor(i / 50).cast("long").alias("path"), i.alias("line_no"), line.alias("line"))
    return idx.idx_entries(lines).select("path", "pos", "start_ms", "filepos", F.array_join(F.col("palette").cast("array<string>"), ",").alias("palette"))


SQL = {
    "idx_pictures": """with l as (select event_id as i, event_id // 50 as path, event_id % 50 as k from events),
p as (select path, (select string_agg(((i + j) * 4111 % 16777216)::varchar, ',' order by j) from range(0, 16) r(j)) as palette from l where k = 3 and path % 5 <> 4)
select path, row_number() over (partition by path order by i) - 1 as pos, (i % 30 * 3600 + i % 60 * 60 + i * 7 % 60) * 1000 + i % 1000 as start_ms, i * 2048 as filepos, palette from l join p using (path) where k not in (3, 5) and k % 7 <> 0""",
    "srt_files": rf"""with {CUES}, t as (select track_id, case when track_id % 3 = 1 and bool_and(regexp_full_match(raw_text, '[\x00-\x7f\x{{a0}}-\x{{ff}}]*')) then 'cp1252' else 'utf-8' end as encoding, bool_and(regexp_full_match(raw_text, '[\x00-\x7f]*')) as ascii from cues group by track_id)
select track_id, pos, start_ms, end_ms, raw_text as text, case when ascii then 'utf-8' else encoding end as encoding from cues join t using (track_id)""",
    "sup_screens": """with d as (select doc_id as i, text, strlen(text) as n from documents where text is not null)
select i as doc_id, 1::bigint as screen, i * 1000 % 1000000 as start_ms, i * 1000 % 1000000 + case when i % 3 <> 0 then 2000 + n else 3000 end as end_ms, 1920::bigint as width, 1080::bigint as height, i % 65536 as number, i % 256 as palette,
n % 1000 as x, n % 700 as y, i % 60000 as id, n as bytes, md5(text) as digest from d""",
    "sup_palettes": """with d as (select doc_id as i, strlen(text) as n from documents where text is not null), e as (select i, n, unnest(range(0, 9)) as k from d),
c as (select i as doc_id, k, k * 5 % 7 as entry, (((i * 3 + k * 31) % 256 - 16) * 1.164383562::double) as y, (i * 7 + k) % 256 - 128 as cr, (i + n * k) % 256 - 128 as cb, (n + k) % 256 as alpha from e),
l as (select * from c qualify row_number() over (partition by doc_id, entry order by k desc) = 1)
select doc_id, entry, greatest(0, least(255, trunc(y + cr * 1.792741071::double + 0.5)))::int as red, greatest(0, least(255, trunc(y - cr * 0.5329093286::double - cb * 0.2132486143::double + 0.5)))::int as green,
greatest(0, least(255, trunc(y + cb * 2.112401786::double + 0.5)))::int as blue, alpha from l""",
}
