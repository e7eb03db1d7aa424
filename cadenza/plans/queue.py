"""Queries on jobs: admission, dashboards, upkeep, and the choice of keys, languages and streams."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..shared import new_folder
from ..sources import settings as S
from ..sources.jobtable import JobTable
from ..streaming import lifecycle
from .common import JOBS, LIMITS, job_rows, jobs, table

MINUTE, HOUR, DAY = 60_000_000, 3_600_000_000, 86_400_000_000
#: Slots for running jobs, as a share of those that run, and jobs that a dashboard lists as waiting.
SLOTS, SHOWN = (21, 20), 50


def _with_now(jobs):
    """Jobs with now_us, the time of the last one: a row that is broadcast."""
    return jobs.join(F.broadcast(jobs.agg(F.max("created_us").alias("now_us"))))


def job_admission(spark, sf_dir):
    """The waiting jobs that the free slots take, oldest first; there are a twentieth more slots than running jobs."""
    j = job_rows(spark, sf_dir)
    running = j.where("status = 'running'").count()
    slots = -(-running * SLOTS[0] // SLOTS[1]) - running
    first = j.where("status = 'pending'").orderBy("created_us", "id").limit(slots)
    placed = first.withColumn("place", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("created_us", "id")))
    return placed.select("id", "job_type", "place")


def job_running(spark, sf_dir):
    """Running jobs with when they began."""
    return job_rows(spark, sf_dir).where("status = 'running'").select("id", "job_type", "started_us")


def job_recent_failed(spark, sf_dir):
    """Jobs that failed or timed out within a day of the last event. (T4)"""
    j = _with_now(job_rows(spark, sf_dir))
    return j.where(F.col("status").isin("failed", "timeout") & (F.col("completed_us") >= F.col("now_us") - DAY)).select("id", "status", "completed_us")


def job_retention(spark, sf_dir):
    """Jobs that stay when finished ones of over seven days go."""
    j = _with_now(job_rows(spark, sf_dir))
    old = F.col("status").isin("completed", "failed", "timeout") & (F.col("completed_us") < F.col("now_us") - 7 * DAY)
    return j.where(~F.coalesce(old, F.lit(False))).select("id", "status")


def job_delete_pending(spark, sf_dir):
    """Jobs that stay when every third waiting one is deleted; others can't be. (P5)"""
    return job_rows(spark, sf_dir).where("not (id % 3 = 0 and status = 'pending')").select("id", "status")


def job_table(spark, sf_dir):
    """What a stored job table holds after it was filled in two lots, waiting jobs were deleted, and old ended ones went."""
    j = job_rows(spark, sf_dir).withColumn("completed_us", F.when(F.col("id") % 4 == 0, F.col("completed_us") - 5 * DAY).otherwise(F.col("completed_us")))
    stored = JobTable(spark, new_folder(spark, "jobs"))
    stored.insert(j.where("id % 2 = 0"))
    stored.insert(j.where("id % 2 = 1"))
    stored.delete_pending(j.where("id % 3 = 0").select("id"))
    stored.retain(j.agg(F.max("created_us")).first()[0])
    return stored.rows().select("id", "status", "created_us", "completed_us")


def job_stream(spark, sf_dir):
    """The job table's changes as a stream with keyed state: the last row of each job, running ones over their limit timed out."""
    # a pattern, as the stream's source wants what may be a folder or a file
    events = spark.readStream.schema(table(spark, sf_dir, "events").schema).parquet(f"{sf_dir}/events.parque[t]")
    j = jobs(events)
    at = lambda c: F.timestamp_micros(c).alias("ts")
    ended = F.col("status").isin("completed", "failed", "timeout")
    steps = F.array(
        F.struct(F.lit("pending").alias("status"), at("created_us")), F.when(F.col("started_us").isNotNull(), F.struct(F.lit("running").alias("status"), at("started_us"))),
        F.when(ended, F.struct(F.col("status"), at("completed_us"))),
    )
    changes = j.select("id", "job_type", F.explode(F.array_compact(steps)).alias("s")).select("id", "job_type", "s.status", "s.ts")
    folder = new_folder(spark, "stream")
    lifecycle.follow(lifecycle.job_updates(changes, LIMITS), f"{folder}/rows", f"{folder}/checkpoint").awaitTermination()
    last = lifecycle.latest(spark, f"{folder}/rows")
    return last.select(F.col("job_id").alias("id"), "status", F.unix_micros("started_at").alias("started_us"), F.unix_micros("completed_at").alias("completed_us"))


def job_dashboard(spark, sf_dir):
    """The oldest waiting jobs, all running ones, and those that failed within an hour, with their panel."""
    j = _with_now(job_rows(spark, sf_dir))
    waiting = j.where("status = 'pending'").orderBy("created_us", "id").limit(SHOWN).select(F.lit("pending").alias("panel"), "id", "job_type")
    others = j.where((F.col("status") == "running") | ((F.col("status") == "failed") & (F.col("completed_us") >= F.col("now_us") - HOUR)))
    return waiting.unionByName(others.select(F.col("status").alias("panel"), "id", "job_type"))


def provider_settings(spark, sf_dir):
    """Waiting times, switches and keys of each service from settings made of events: texts and objects, blank keys, several active ones."""
    i = F.col("event_id")
    key = lambda j: F.when((i + j) % 5 == 4, F.concat(F.lit('"  k'), j, F.lit(' "'))).when((i + j) % 7 == 6, F.lit('{"value": " ", "active": true}')).otherwise(
        F.concat(F.lit('{"value":"k'), j, F.lit('","active":'), F.when((i + j) % 3 == 0, F.lit("1")).otherwise(F.lit('""')), F.lit(',"vpn_config":"v'), (i + j * j) % 4, F.lit('","last_error":""}'))
    )
    keys = lambda n: F.concat(F.lit("["), F.array_join(F.transform(F.sequence(F.lit(1).cast("long"), n), key), ","), F.lit("]"))
    wait = F.when(i % 6 == 0, F.lit('"3.7"')).when(i % 6 == 1, F.lit('" 12"')).when(i % 6 == 2, F.lit("4.9")).otherwise(i.cast("string"))
    text = F.concat(F.lit('{"wait_ms":{"Azure":'), wait, F.lit('},"retry_after_days":['), i, F.lit('],"auto_change_key_on_error":{"Gemini":"false"},"provider_keys":{"DeepL":'), keys(i % 6 + 1), F.lit(',"Azure":'), keys(i % 2 + 1), F.lit(',"Gemini":"none"}}'))
    found = S.read_provider_settings(table(spark, sf_dir, "events").select(i.alias("id"), text.alias("settings")))
    shown = lambda p: F.array_join(F.transform(F.col("provider_keys")[p], lambda k: F.concat_ws(":", k["value"], k["active"].cast("string"), F.coalesce(k["vpn_config"], F.lit("-")), F.coalesce(k["last_error"], F.lit("-")))), ",")
    return found.select(
        "id", F.col("wait_ms")["Azure"].alias("azure_wait"), F.col("wait_ms")["DeepL"].alias("deepl_wait"), F.col("retry_after_days")["Azure"].alias("retry"), F.col("auto_change_key_on_error")["Gemini"].alias("gemini_changes"), F.col("auto_change_key_on_error")["Azure"].alias("azure_changes"),
        shown("DeepL").alias("deepl"), shown("Azure").alias("azure"), F.size(F.col("provider_keys")["Gemini"]).alias("gemini"), F.array_join("shared", ",").alias("shared"),
    )


def single_active(spark, sf_dir):
    """One active key of each group: the first active one, else the first."""
    s = table(spark, sf_dir, "supplier").select("s_nationkey", "s_suppkey", (F.col("s_suppkey") % 7 == 0).alias("active"))
    rank = F.row_number().over(Window.partitionBy("s_nationkey").orderBy(F.desc("active"), "s_suppkey"))
    return s.select("s_nationkey", "s_suppkey", (rank == 1).alias("active"))


def round_robin(spark, sf_dir):
    """Each key's successor in its group, the first after the last."""
    s = table(spark, sf_dir, "supplier")
    group = Window.partitionBy("s_nationkey")
    after = F.coalesce(F.lead("s_suppkey").over(group.orderBy("s_suppkey")), F.min("s_suppkey").over(group))
    return s.select("s_nationkey", "s_suppkey", after.alias("next_key"))


def language_fallback(spark, sf_dir):
    """Results and downloads of each language up to the first one of a source that has a download."""
    d = table(spark, sf_dir, "documents").where("source is not null and lang is not null")
    tried = d.groupBy("source", "lang").agg(F.count(F.lit(1)).alias("results"), F.count_if(F.length("text") >= 5000).alias("downloaded"))
    stop = F.min(F.when(F.col("downloaded") > 0, F.col("lang"))).over(Window.partitionBy("source"))
    return tried.withColumn("stop", stop).where("stop is null or lang <= stop").select("source", "lang", "results", "downloaded")


def stream_priority(spark, sf_dir):
    """A user's events by kind, views before clicks before others, in their own order inside."""
    e = table(spark, sf_dir, "events")
    kind = F.when(F.col("event_type") == "view", 0).when(F.col("event_type") == "click", 1).otherwise(2)
    place = F.row_number().over(Window.partitionBy("user_id").orderBy(kind, "event_id"))
    return e.select("user_id", "event_id", place.alias("place"))


def stream_choice(spark, sf_dir):
    """The first event of the kind that a user's id asks for, else their first."""
    e = table(spark, sf_dir, "events")
    wanted = F.element_at(F.array(*map(F.lit, ("view", "click", "signup"))), (F.col("user_id") % 3 + 1).cast("int"))
    best = F.struct((F.col("event_type") != wanted).alias("other"), "event_id")
    return e.groupBy("user_id").agg(F.min(best)["event_id"].alias("event_id"))


def events_top(spark, sf_dir):
    """The eight largest values of each user."""
    place = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("value"), "event_id"))
    return table(spark, sf_dir, "events").withColumn("place", place).where("place <= 8").select("user_id", "place", "event_id", "value")


def settings_clamp(spark, sf_dir):
    """A number read from JSON settings, within bounds."""
    from ..functions import clamp

    k, i = F.get_json_object("props", "$.k"), F.col("event_id")
    told = F.when(i % 7 == 0, F.concat(k, F.lit("x"))).when(i % 11 == 0, "3.7").otherwise(k)
    return table(spark, sf_dir, "events").select("event_id", clamp(told, 20, 10, 60, "int").alias("k"), clamp(told, 0.5, 0.25, 40.5).alias("share"))


def _settings(spark, sf_dir):
    """Settings of customers: numbers, numbers in quotes, words, lists and lines, older names, and what is no JSON."""
    c, k = F.col("c_custkey"), F.col("c_custkey").cast("string")
    number = F.when(c % 4 == 0, k).when(c % 4 == 1, F.concat(F.lit('"'), k, F.lit('"'))).when(c % 4 == 2, F.concat(k, F.lit(".75"))).otherwise(F.concat(F.lit('"'), k, F.lit('.5"')))
    part = F.concat(F.lit('"0.'), (c % 97 + 10).cast("string"), F.lit('"'))
    target = F.when(c % 3 == 0, F.lit('"translation_target_language":"de","target_language":"fr"')).when(c % 3 == 1, F.lit('"translation_target_language":"","target_language":"fr"')).otherwise(F.lit('"a":1'))
    listed = F.when(c % 5 == 0, F.lit('" en, ,de"')).when(c % 5 == 1, F.lit('["fr"," ","pt "]')).when(c % 5 == 2, F.lit("[]")).when(c % 5 == 3, F.lit('""')).otherwise(F.lit("7"))
    service = F.when(c % 2 == 0, "Azure").otherwise("Other")
    text = F.concat(*[x if not isinstance(x, str) else F.lit(x) for x in ('{"sync_sample_minutes":', number, ',"sync_anchor_max_window_size":', number, ',"sync_max_scale_delta":', part, ',"provider":"', service, '",', target, ',"subtitle_search_languages":', listed, "}")])
    return table(spark, sf_dir, "customer").select(c.alias("id"), F.when(c % 13 == 0, "no json").otherwise(text).alias("settings"))


def settings_table(spark, sf_dir):
    """Settings read with defaults, bounds and older names."""
    from ..sources.settings import read_settings

    return read_settings(_settings(spark, sf_dir))


def _settings_sql() -> str:
    from ..sources.settings import numbers

    given = {"sync_sample_minutes": "n", "sync_anchor_max_window_size": "n", "sync_max_scale_delta": "d"}
    columns = [f"cast(greatest({low}, least({most}, coalesce({given.get(name, 'null')}, {default}))) as {'integer' if kind == 'int' else 'double'}) as {name}" for name, kind, default, low, most in numbers()]
    return f"""with c as (select c_custkey as id, c_custkey % 13 = 0 as bad, case when c_custkey % 4 = 3 then null else c_custkey end as n, cast('0.' || (c_custkey % 97 + 10) as double) as d, c_custkey as c from customer),
g as (select id, bad, c, case when bad then null else n end as n, case when bad then null else d end as d from c)
select id, {', '.join(columns)}, case when c % 2 = 0 and not bad then 'Azure' else 'DeepL' end as provider, case when bad then '' when c % 3 = 0 then 'de' when c % 3 = 1 then 'fr' else '' end as translation_target_language,
case when bad then 'en' when c % 5 = 0 then 'en,de' when c % 5 = 1 then 'fr,pt' when c % 5 = 4 then '7' else 'en' end as subtitle_search_languages from g"""


_NOW = "(select max(created_us) from jobs)"
_DONE = JOBS.replace("from j)", "from j),\ndone as (select *, case when status not in ('pending', 'running') then started_us + (id * 37 % 9000) * 1000000 end as completed_us from jobs)")
_LIMIT = f"case job_type {' '.join(f"when '{k}' then {v}" for k, v in LIMITS.items())} else 600 end * 1000000::bigint"
_ENDS = "e as (select *, case when status not in ('pending', 'running') then started_us + (id * 37 % 9000) * 1000000 end as completed_us from jobs)"
SQL = {
    "provider_settings": """with e as (select event_id as i from events), p as (select i, 'DeepL' as p, i % 6 + 1 as n from e union all select i, 'Azure', i % 2 + 1 from e),
k as (select i, p, unnest(range(1, n + 1)) as j from p), v as (select *, (i + j) % 5 = 4 as plain, 'k' || j as val, case when (i + j) % 5 <> 4 then 'v' || (i + j * j) % 4 end as vpn from k where (i + j) % 5 = 4 or (i + j) % 7 <> 6),
m as (select *, not plain and (i + j) % 3 = 0 as marked from v), f as (select *, j = coalesce(min(j) filter (where marked) over w, min(j) over w) as active from m window w as (partition by i, p)),
s as (select i, p, string_agg(val || ':' || active || ':' || coalesce(vpn, '-') || ':-', ',' order by j) as keys from f group by i, p),
d as (select i, string_agg(vpn, ',' order by vpn) as shared from (select i, vpn from m where vpn is not null group by i, vpn having count(*) > 1) group by i)
select e.i as id, case e.i % 6 when 0 then 0 when 1 then 12 when 2 then 4 else e.i end::int as azure_wait, 0 as deepl_wait, 0 as retry, true as gemini_changes, false as azure_changes, coalesce(a.keys, '') as deepl, coalesce(b.keys, '') as azure, 0 as gemini, coalesce(shared, '') as shared
from e left join s a on a.i = e.i and a.p = 'DeepL' left join s b on b.i = e.i and b.p = 'Azure' left join d on d.i = e.i""",
    "job_table": f"""with {JOBS}, {_ENDS}, f as (select id, status, created_us, case when id % 4 = 0 then completed_us - 5 * {DAY} else completed_us end as completed_us from e)
select * from f where not (id % 3 = 0 and status = 'pending') and not coalesce(status in ('completed', 'failed', 'timeout') and completed_us < (select max(created_us) from f) - 7 * {DAY}, false)""",
    "job_stream": f"""with {JOBS}, {_ENDS}, n as (select *, started_us + {_LIMIT} as due, (select max(greatest(created_us, coalesce(started_us, 0), coalesce(completed_us, 0))) from e) // 1000 as now_ms from e)
select id, case when status = 'running' and due // 1000 + 1 <= now_ms then 'timeout' else status end as status, started_us, case when status = 'running' and due // 1000 + 1 <= now_ms then due else completed_us end as completed_us from n""",
    "job_admission": f"""with {JOBS}, w as (select id, job_type, row_number() over (order by created_us, id)::int as place from jobs where status = 'pending'),
r as (select count(*) as n from jobs where status = 'running') select w.* from w, r where place <= (n * {SLOTS[0]} + {SLOTS[1] - 1}) // {SLOTS[1]} - n""",
    "job_running": f"with {JOBS} select id, job_type, started_us from jobs where status = 'running'",
    "job_recent_failed": f"with {_DONE} select id, status, completed_us from done where status in ('failed', 'timeout') and completed_us >= {_NOW} - {DAY}",
    "job_retention": f"with {_DONE} select id, status from done where completed_us is null or completed_us >= {_NOW} - 7 * {DAY}",
    "job_delete_pending": f"with {JOBS} select id, status from jobs where not (id % 3 = 0 and status = 'pending')",
    "job_dashboard": f"""with {_DONE} select * from (select 'pending' as panel, id, job_type from done where status = 'pending' order by created_us, id limit {SHOWN})
union all select status, id, job_type from done where status = 'running' or (status = 'failed' and completed_us >= {_NOW} - {HOUR})""",
    "single_active": "select s_nationkey, s_suppkey, row_number() over (partition by s_nationkey order by (s_suppkey % 7 = 0) desc, s_suppkey) = 1 as active from supplier",
    "round_robin": """select s_nationkey, s_suppkey, coalesce(lead(s_suppkey) over (partition by s_nationkey order by s_suppkey), min(s_suppkey) over (partition by s_nationkey)) as next_key from supplier""",
    "language_fallback": """with t as (select source, lang, count(*) as results, count(*) filter (where length(text) >= 5000) as downloaded from documents where source is not null and lang is not null group by all),
s as (select source, min(lang) filter (where downloaded > 0) as stop from t group by source)
select t.* from t join s on t.source = s.source where s.stop is null or t.lang <= s.stop""",
    "stream_priority": """select user_id, event_id, row_number() over (partition by user_id order by case event_type when 'view' then 0 when 'click' then 1 else 2 end, event_id)::int as place from events""",
    "stream_choice": "select user_id, arg_min(event_id, struct_pack(o := event_type <> (['view', 'click', 'signup'])[user_id % 3 + 1], e := event_id)) as event_id from events group by user_id",
    "events_top": "select user_id, event_id, value, row_number() over (partition by user_id order by value desc, event_id)::int as place from events qualify place <= 8",
    "settings_table": _settings_sql(),
    "settings_clamp": """with t as (select event_id, case when event_id % 7 = 0 then json_extract_string(props, '$.k') || 'x' when event_id % 11 = 0 then '3.7' else json_extract_string(props, '$.k') end as k from events)
select event_id, greatest(10, least(60, coalesce(case when contains(k, '.') then null else try_cast(k as integer) end, 20))) as k, greatest(0.25, least(40.5, coalesce(try_cast(k as double), 0.5)))::double as share from t""",
}
