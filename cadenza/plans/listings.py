"""Queries on listings: folders, pairs of files, free names, titles, keys, and results of several sources."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from .. import functions as T
from .. import sources
from ..functions.releases import title_kind
from .common import JOBS, job_rows, table
from .releases import _NAMES, file_names


def folder_listing(spark, sf_dir):
    """Suppliers' nations as folders and suppliers as files: folders first, then names without case; files with sizes."""
    s = table(spark, sf_dir, "supplier")
    size = F.floor(F.abs("s_acctbal") * 100).cast("long")
    sizes = s.groupBy("s_nationkey").agg(F.sum(size).alias("size"))
    folders = table(spark, sf_dir, "nation").join(sizes, F.col("n_nationkey") == F.col("s_nationkey"), "left").select(F.col("n_name").alias("name"), F.lit(True).alias("folder"), "size")
    files = s.select(F.when(F.col("s_suppkey") % 2 == 0, F.lower("s_name")).otherwise(F.col("s_name")).alias("name"), F.lit(False).alias("folder"), size.alias("size"))
    # the list of one folder is ordered by ranges; its place is the row's rank
    place = F.row_number().over(Window.partitionBy("folder").orderBy(F.lower("name"), "name"))
    return folders.unionByName(files).select("name", "folder", "size", place.alias("place"))


def existing_images(spark, sf_dir):
    """Image subtitles that can be read: .sup alone, .sub only beside an .idx of its name; the others with what they lack."""
    n = table(spark, sf_dir, "part").select("p_partkey", F.replace("p_name", F.lit(" "), F.lit(".")).alias("stem"), F.element_at(F.array(*map(F.lit, (".sub", ".idx", ".sup", ".SUB", ".srt"))), (F.col("p_partkey") % 5 + 1).cast("int")).alias("ending"))
    found = n.where("ending = '.idx'").select("stem").distinct().withColumn("beside", F.lit(True))
    asked = n.where(F.lower("ending").isin(".sub", ".sup")).join(found, "stem", "left")
    return asked.select("p_partkey", F.concat("stem", "ending").alias("name"), ((F.lower("ending") == ".sup") | F.coalesce("beside", F.lit(False))).alias("readable"))


def sync_pairs(spark, sf_dir):
    """Choices of files that are one video and one SRT."""
    n = file_names(spark, sf_dir).withColumn("choice", F.floor(F.col("p_partkey") / 2))
    kind = T.extension(F.col("name"))
    both = n.groupBy("choice").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(kind == "mkv").alias("videos"), F.count_if(kind == "srt").alias("subtitles"),
        F.min(F.when(kind == "mkv", F.col("name"))).alias("video"), F.min(F.when(kind == "srt", F.col("name"))).alias("subtitle"),
    )
    return both.where("n = 2 and videos = 1 and subtitles = 1").select("choice", "video", "subtitle")


def free_names(spark, sf_dir):
    """For each name the smallest free one: itself, else with .1, .2 and so on. (K7)"""
    p = table(spark, sf_dir, "part").select(F.replace("p_name", F.lit(" "), F.lit(".")).alias("base"), (F.col("p_partkey") % 5).alias("i")).distinct()
    taken = p.where("i < 4")  # the base itself is taken as 0
    gap = taken.withColumn("place", F.row_number().over(Window.partitionBy("base").orderBy("i")) - 1).where("place <> i").groupBy("base").agg(F.min("place").alias("gap"))
    ends = p.groupBy("base").agg(F.count_if(F.col("i") < 4).alias("n"))
    free = ends.join(gap, "base", "left").select("base", F.coalesce("gap", "n").alias("free"))
    return free.select("base", F.when(F.col("free") == 0, F.concat("base", F.lit(".srt"))).otherwise(F.concat("base", F.lit("."), F.col("free").cast("string"), F.lit(".srt"))).alias("name"))


def copy_list(spark, sf_dir):
    """A list of parts with a selection added, each once: those on the list first. (U4)"""
    p = table(spark, sf_dir, "part").select("p_name", "p_partkey")
    listed = p.where("p_partkey % 3 = 0").groupBy("p_name").agg(F.min("p_partkey").alias("k")).withColumn("list", F.lit(0))
    chosen = p.where("p_partkey % 2 = 0").groupBy("p_name").agg(F.min("p_partkey").alias("k")).withColumn("list", F.lit(1))
    return listed.unionByName(chosen.join(listed, "p_name", "left_anti"))


def shared_configs(spark, sf_dir):
    """Configurations that more than one key has, with how many and the last of them."""
    s = table(spark, sf_dir, "supplier").withColumn("config", F.when(F.col("s_suppkey") % 3 > 0, F.floor(F.col("s_acctbal") / 500).cast("long")))
    return s.where("config is not null").groupBy("config").agg(F.count(F.lit(1)).alias("keys"), F.max_by("s_name", "s_suppkey").alias("last_key")).where("keys > 1")


def found_subtitles(spark, sf_dir):
    """The results of three services together, and each user's best five by score."""
    e = table(spark, sf_dir, "events")
    one = lambda kind: e.where(F.col("event_type") == kind).select(F.lit(kind).alias("service"), "event_id", "user_id", "value")
    every = one("view").unionByName(one("click")).unionByName(one("purchase"))
    best = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("value"), "event_id"))
    return every.withColumn("best", best).where("best <= 5")


def newest_jobs(spark, sf_dir):
    """The hundred newest jobs. (T5)"""
    return job_rows(spark, sf_dir).orderBy(F.desc("created_us"), F.desc("id")).limit(100).select("id", "job_type", "status")


def first_of_names(spark, sf_dir):
    """The first part of each name without case, as listed."""
    first = F.row_number().over(Window.partitionBy(F.lower("p_name")).orderBy("p_partkey"))
    return table(spark, sf_dir, "part").withColumn("first", first).where("first = 1").select("p_partkey", "p_name")


def archive_choice(spark, sf_dir):
    """The largest subtitle of each archive's members, the first among equals."""
    n = file_names(spark, sf_dir).select("p_partkey", "name", F.floor(F.col("p_partkey") / 6).alias("archive"), (F.col("p_partkey") * 37 % 11).alias("size"))
    n = n.where(T.extension(F.col("name")).isin("srt", "ass", "ssa"))
    return n.groupBy("archive").agg(F.max_by("name", F.struct("size", -F.col("p_partkey"))).alias("name"), F.max("size").alias("size"))


def _answers(spark, sf_dir):
    """Answers of a title search: three titles an order; some lack an id or a name."""
    o = table(spark, sf_dir, "orders")
    item = lambda i, kind: F.concat(F.when(F.col("o_orderkey") % 5 == i, F.lit('{"l":"Title ')).otherwise(F.concat(F.lit('{"id":"tt'), F.col("o_orderkey").cast("string"), F.lit(f'{i}","l":"Title '))), F.col("o_custkey").cast("string"), F.lit(f'","y":{1990 + i},"q":"{kind}"}}'))
    return o.select(F.col("o_orderkey").alias("id"), F.concat(F.lit('{"d":['), F.concat_ws(",", item(0, "TV series"), item(1, "feature"), item(2, "tvEpisode")), F.lit("]}")).alias("answer"))


def title_suggestions(spark, sf_dir):
    """Titles with an id of each search, and if they are movie or tv."""
    t = sources.suggestions(_answers(spark, sf_dir)).where("place < 15")
    return t.select("id", "place", "title_id", "title", "year", title_kind(F.col("kind")).alias("kind"))


def _probes(spark, sf_dir):
    """Probes of media: a video and two audio streams a customer; some lack a language or a duration."""
    c = F.col("c_custkey")
    tag = F.element_at(F.array(*map(F.lit, ("ger", "EN", "und", ""))), (c % 4 + 1).cast("int"))
    first = F.when(c % 5 == 0, F.lit('{"index":1,"codec_type":"audio","codec_name":"aac"}')).otherwise(F.concat(F.lit('{"index":1,"codec_type":"audio","codec_name":"aac","tags":{"language":"'), tag, F.lit('"}}')))
    duration = F.when(c % 6 == 0, F.lit("{}")).otherwise(F.concat(F.lit('{"duration":"'), c.cast("string"), F.lit('.5"}')))
    probe = F.concat(F.lit('{"streams":[{"index":0,"codec_type":"video","codec_name":"h264"},'), first, F.lit(',{"index":2,"codec_type":"audio","tags":{"language":"fre"}}],"format":'), duration, F.lit("}"))
    return table(spark, sf_dir, "customer").select(c.alias("id"), probe.alias("probe"))


def audio_streams(spark, sf_dir):
    """Audio streams and their languages."""
    return sources.speech_streams(_probes(spark, sf_dir))


SQL = {
    "folder_listing": """with f as (select s_nationkey, sum(floor(abs(s_acctbal) * 100)::bigint)::bigint as size from supplier group by s_nationkey),
u as (select n_name as name, true as folder, f.size from nation left join f on n_nationkey = s_nationkey union all
select case when s_suppkey % 2 = 0 then lower(s_name) else s_name end, false, floor(abs(s_acctbal) * 100)::bigint from supplier)
select *, row_number() over (partition by folder order by lower(name), name)::int as place from u""",
    "existing_images": """with n as (select p_partkey, replace(p_name, ' ', '.') as stem, (['.sub', '.idx', '.sup', '.SUB', '.srt'])[p_partkey % 5 + 1] as e from part)
select p_partkey, stem || e as name, lower(e) = '.sup' or stem in (select stem from n where e = '.idx') as readable from n where lower(e) in ('.sub', '.sup')""",
    "sync_pairs": f"""with {_NAMES}, k as (select p_partkey // 2 as choice, name, lower(regexp_extract(name, '\\.([^.]+)$', 1)) as e from names)
select choice::bigint as choice, min(name) filter (where e = 'mkv') as video, min(name) filter (where e = 'srt') as subtitle from k group by choice
having count(*) = 2 and count(*) filter (where e = 'mkv') = 1 and count(*) filter (where e = 'srt') = 1""",
    "free_names": """with p as (select distinct replace(p_name, ' ', '.') as base, p_partkey % 5 as i from part), b as (select distinct base from p),
c as (select base, k from b, range(0, 6) r(k) where not exists (select 1 from p where p.base = b.base and p.i = k and p.i < 4)), f as (select base, min(k) as k from c group by base)
select base, case when k = 0 then base || '.srt' else base || '.' || k || '.srt' end as name from f""",
    "copy_list": """with l as (select p_name, min(p_partkey) as k from part where p_partkey % 3 = 0 group by p_name), s as (select p_name, min(p_partkey) as k from part where p_partkey % 2 = 0 group by p_name)
select p_name, k, 0 as list from l union all select p_name, k, 1 from s where p_name not in (select p_name from l)""",
    "shared_configs": """select floor(s_acctbal / 500)::bigint as config, count(*) as keys, arg_max(s_name, s_suppkey) as last_key from supplier where s_suppkey % 3 > 0 group by 1 having count(*) > 1""",
    "found_subtitles": """select event_type as service, event_id, user_id, value, row_number() over (partition by user_id order by value desc, event_id)::int as best
from events where event_type in ('view', 'click', 'purchase') qualify best <= 5""",
    "newest_jobs": f"with {JOBS} select id, job_type, status from jobs order by created_us desc, id desc limit 100",
    "first_of_names": "select arg_min(p_name, p_partkey) as p_name, min(p_partkey) as p_partkey from part group by lower(p_name)",
    "archive_choice": f"""with {_NAMES}, m as (select p_partkey, name, (p_partkey // 6)::bigint as archive, p_partkey * 37 % 11 as size from names where lower(regexp_extract(name, '\\.([^.]+)$', 1)) in ('srt', 'ass', 'ssa'))
select archive, name, size from m qualify row_number() over (partition by archive order by size desc, p_partkey) = 1""",
    "title_suggestions": """with i as (select o_orderkey as id, o_custkey, i.i from orders, (values (0), (1), (2)) i(i))
select id, i::bigint as place, 'tt' || id || i as title_id, 'Title ' || o_custkey as title, 1990 + i as year, case i when 1 then 'movie' else 'tv' end as kind from i where id % 5 <> i""",
    "audio_streams": """select c_custkey as id, case when c_custkey % 6 = 0 then 0.0 else c_custkey + 0.5 end::double as duration_s, 1 as stream, 'aac' as codec,
case when c_custkey % 5 = 0 then null else (['deu', 'eng', 'und', null])[c_custkey % 4 + 1] end as language from customer
union all select c_custkey, case when c_custkey % 6 = 0 then 0.0 else c_custkey + 0.5 end::double, 2, '', 'fra' from customer""",
}
