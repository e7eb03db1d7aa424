"""Queries on names, folders and texts as files hold them."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from .. import functions as T
from .. import operators as O
from .common import CUES, cue_rows, table


def bulk_rename(spark, sf_dir):
    """Parts renamed: skipped without a change, failed where the new name is taken."""
    k = F.col("p_partkey")
    old = F.concat("p_name", F.lit(" "), (k % 4).cast("string"))
    new = F.when(k % 2 == 0, F.replace(old, F.lit(" 2"), F.lit(" 0"))).otherwise(F.replace(old, F.lit(" 1"), F.lit(" 9")))
    p = table(spark, sf_dir, "part").select("p_partkey", old.alias("old_name"), new.alias("new_name"))
    taken = p.select(F.col("old_name").alias("new_name")).distinct().withColumn("taken", F.lit(True))
    status = F.when(F.col("new_name") == F.col("old_name"), "skipped").when(F.col("taken"), "failed").otherwise("renamed")
    return p.join(taken, "new_name", "left").select("p_partkey", "new_name", status.alias("status"))


def unique_names(spark, sf_dir):
    """Names with (2), (3) after the first of the same. (K6)"""
    p = table(spark, sf_dir, "part")
    n = F.row_number().over(Window.partitionBy("p_name").orderBy("p_partkey"))
    return p.select("p_partkey", F.when(n == 1, F.col("p_name")).otherwise(F.format_string("%s (%d)", "p_name", n)).alias("name"))


def page_sizes(spark, sf_dir):
    """Readable sizes of pages, every third counted as two hundred, and if they are over 500 KiB."""
    n = (F.octet_length(F.coalesce("html", F.lit(""))) * F.when(F.col("page_id") % 3 == 0, 200).otherwise(1)).cast("long")
    return table(spark, sf_dir, "pages").select("page_id", T.file_size(n).alias("size"), (n >= 500 * 1024).alias("large"))


def turns_merged(spark, sf_dir):
    """The texts of each role of a conversation as one, in the order of turns. (A4)"""
    c = table(spark, sf_dir, "conversations")
    turns = F.array_sort(F.collect_list(F.struct("turn", F.coalesce("text", F.lit("")).alias("text"))))
    return c.groupBy("conv_id", "role").agg(F.array_join(F.transform(turns, lambda x: x["text"]), "\n").alias("text"))


def end_times(spark, sf_dir):
    """Cues with every third duration unknown, their ends filled."""
    c = cue_rows(spark, sf_dir).withColumn("duration_ms", F.when(F.col("pos") % 3 != 0, F.col("end_ms") - F.col("start_ms")))
    return O.fill_ends(c.drop("end_ms")).select("track_id", "pos", "end_ms")


def srt_blocks(spark, sf_dir):
    """The text blocks between the structure lines of rendered tracks."""
    c = cue_rows(spark, sf_dir)
    lines = c.select("track_id", "pos", F.posexplode(F.array((F.col("pos") + 1).cast("string"), F.lit("00:00:00,000 --> 00:00:01,000"), "raw_text", F.lit(""))).alias("k", "line"))
    return O.text_blocks(lines.select("track_id", (F.col("pos") * 4 + F.col("k")).alias("line_no"), "line"))


SQL = {
    "bulk_rename": """with o as (select p_partkey, p_name || ' ' || p_partkey % 4 as o from part), n as (select *, case when p_partkey % 2 = 0 then replace(o, ' 2', ' 0') else replace(o, ' 1', ' 9') end as n from o)
select p_partkey, n as new_name, case when n = o then 'skipped' when n in (select o from o) then 'failed' else 'renamed' end as status from n""",
    "unique_names": """with n as (select *, row_number() over (partition by p_name order by p_partkey) as n from part)
select p_partkey, case when n = 1 then p_name else p_name || ' (' || n || ')' end as name from n""",
    "page_sizes": """with n as (select page_id, strlen(coalesce(html, '')) * case when page_id % 3 = 0 then 200 else 1 end as n from pages),
u as (select *, case when n >= 1073741824 then 3 when n >= 1048576 then 2 when n >= 1024 then 1 else 0 end as u from n)
select page_id, n >= 512000 as large, case when n = 0 then '0 B' else regexp_replace(printf('%.2f', round(n / pow(1024, u), 2)), '\\.?0+$', '') || ' ' || (['B', 'KB', 'MB', 'GB'])[u + 1] end as size from u""",
    "turns_merged": "select conv_id, role, string_agg(coalesce(text, ''), chr(10) order by turn, coalesce(text, '')) as text from conversations group by all",
    "end_times": f"""with {CUES} select track_id, pos, case when pos % 3 <> 0 then end_ms else coalesce(lead(start_ms) over (partition by track_id order by pos), start_ms + 3000) end as end_ms from cues""",
    "srt_blocks": rf"""with {CUES} select track_id, (row_number() over (partition by track_id order by pos) - 1)::bigint as block, trim(raw_text) as text from cues
where not regexp_full_match(trim(raw_text), '[0-9]*') and not contains(raw_text, '-->')""",
}
SQL["page_sizes"] = SQL["page_sizes"].replace("\\\\", "\\")
