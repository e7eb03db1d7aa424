"""The registered queries of the timed-text operators, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import functions as T
from .. import operators as O
from ..streaming import job_states
from . import discs, files, listings, matching, payloads, queue, releases
from .common import CUES, JOBS, KINDS, LIMITS, cue_rows as _cues, job_rows as _jobs, table as _table

def cue_table(spark, sf_dir):
    return _cues(spark, sf_dir)


def cue_windows(spark, sf_dir):
    return O.sliding_windows(_cues(spark, sf_dir))


def cue_times(spark, sf_dir):
    return O.renumbered(_cues(spark, sf_dir))


def cue_batches(spark, sf_dir):
    return O.batches(_cues(spark, sf_dir).select("track_id", "pos", F.col("norm_text").alias("text")), 50, 400)


def cue_retimed(spark, sf_dir):
    """Cues moved by the segments between every tenth of them; the true answer is 51/50 and 1500 ms."""
    cues = _cues(spark, sf_dir)
    anchors = cues.where("pos % 10 = 0").select("track_id", "pos", F.col("start_ms").alias("cue_ms"), (F.col("start_ms") * 51 / 50 + 1500).alias("said_ms"))
    found = O.segment_of(cues, O.piecewise_segments(anchors)).where("seg is not null")
    return found.select("track_id", "pos", T.retime(F.col("start_ms"), F.col("scale"), F.col("offset_ms")).alias("new_ms"))


def job_counts(spark, sf_dir):
    return _jobs(spark, sf_dir).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def job_queue(spark, sf_dir):
    return _jobs(spark, sf_dir).where("status = 'pending'").orderBy("created_us", "id").limit(50).select("id", "job_type", "created_us")


def job_timeouts(spark, sf_dir):
    """Running jobs that ran longer than their kind may, by the time of the last event."""
    j = _jobs(spark, sf_dir)
    limit = F.coalesce(*[F.when(F.col("job_type") == k, F.lit(v)) for k, v in LIMITS.items()], F.lit(600))
    now = j.agg(F.max("created_us").alias("now_us"))
    late = j.where("status = 'running'").join(F.broadcast(now)).where(F.col("now_us") - F.col("started_us") > limit.cast("long") * 1_000_000)
    return late.select("id", "job_type", ((F.col("now_us") - F.col("started_us"))).alias("elapsed_us"))


def job_latest(spark, sf_dir):
    """The latest state of each user's events as those of a job, when it began, and when it ended."""
    kind = F.col("event_type")
    status = F.when(kind == "view", "running").when(kind == "purchase", "completed").when(kind == "error", "failed").otherwise("pending")
    states = job_states(_table(spark, sf_dir, "events").select(F.col("user_id").alias("id"), status.alias("status"), F.struct("ts", "event_id").alias("ts")))
    return states.select("job_id", "status", *[F.col(f"{c}.ts").alias(c) for c in ("at", "started_at", "completed_at")])


def folder_counts(spark, sf_dir):
    """Pages and bytes under every folder of the URLs' paths."""
    p = _table(spark, sf_dir, "pages").select(F.explode(T.path_prefixes(F.col("url"))).alias("folder"), F.octet_length(F.coalesce("html", F.lit(""))).cast("long").alias("n"))
    return p.groupBy("folder").agg(F.count(F.lit(1)).alias("pages"), F.sum("n").alias("bytes"))


_TIME = "printf('%02d:%02d:%02d,%03d', {0} // 3600000, {0} // 60000 % 60, {0} // 1000 % 60, {0} % 1000)"
SQL = {
    "cue_table": f"with {CUES} select * from cues",
    "cue_windows": f"""with {CUES},
b as (select *, coalesce((start_ms - lag(end_ms) over (partition by track_id order by pos) > 3500)::int, 0) as broken from cues),
i as (select *, sum(broken) over (partition by track_id order by pos) as island from b)
select a.track_id, a.pos as first_pos, z.pos as last_pos, a.start_ms, z.end_ms, string_agg(m.norm_text, ' ' order by m.pos) as text
from i a join i z on a.track_id = z.track_id and a.island = z.island and z.pos between a.pos and a.pos + 2
join i m on m.track_id = a.track_id and m.pos between a.pos and z.pos group by all""",
    "cue_times": f"""with {CUES} select track_id, (row_number() over (partition by track_id order by pos))::int as no,
{_TIME.format('start_ms')} || ' --> ' || {_TIME.format('end_ms')} as times, raw_text from cues where trim(raw_text) <> ''""",
    "cue_retimed": f"""with {CUES}, n as (select track_id, max(pos) as m from cues group by track_id)
select c.track_id, c.pos, floor(c.start_ms * 51 / 50 + 1500 + 0.5)::bigint as new_ms from cues c join n on c.track_id = n.track_id where n.m >= 10""",
    "cue_batches": f"""with recursive {CUES}, t as (select track_id, pos, length(norm_text) as n from cues),
f as (select track_id, pos, 0 as batch, 1 as count, n as held from t where pos = 0
  union all select t.track_id, t.pos, f.batch + (f.count >= 50 or f.held + t.n > 400)::int, case when f.count >= 50 or f.held + t.n > 400 then 1 else f.count + 1 end,
    case when f.count >= 50 or f.held + t.n > 400 then t.n else f.held + t.n end from f join t on t.track_id = f.track_id and t.pos = f.pos + 1)
select track_id, pos, batch from f""",
    "job_counts": f"with {JOBS} select status, count(*) as n from jobs group by status",
    "job_queue": f"with {JOBS} select id, job_type, created_us from jobs where status = 'pending' order by created_us, id limit 50",
    "job_timeouts": f"""with {JOBS} select id, job_type, (select max(created_us) from jobs) - started_us as elapsed_us from jobs where status = 'running'
and (select max(created_us) from jobs) - started_us > 1000000::bigint * case job_type {' '.join(f"when '{k}' then {v}" for k, v in LIMITS.items())} else 600 end""",
    "job_latest": """with e as (select user_id, event_id, ts, case event_type when 'view' then 'running' when 'purchase' then 'completed' when 'error' then 'failed' else 'pending' end as status from events)
select user_id as job_id, arg_max(status, struct_pack(t := ts, e := event_id)) as status, max(ts) as at, min(ts) filter (where status = 'running') as started_at, min(ts) filter (where status in ('completed', 'failed')) as completed_at
from e group by user_id""",
    "folder_counts": """with s as (select list_filter(string_split(url, '/'), lambda x: x <> '') as l, strlen(coalesce(html, '')) as n from pages where url is not null),
e as (select unnest(list_transform(range(1, greatest(len(l), 1) + 1), lambda i: array_to_string(l[1:i], '/'))) as folder, n from s)
select folder, count(*) as pages, sum(n)::bigint as bytes from e group by folder""",
}


PARTS = (queue, matching, files, releases, listings, payloads, discs)
_OWN = list(SQL)
for _part in PARTS:
    SQL |= _part.SQL


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = {k: globals()[k] for k in _OWN} | {k: getattr(matching, k) for k in ("track_anchors", "retimed_tracks")}
    for part in PARTS:
        found |= {k: getattr(part, k) for k in part.SQL}
    return found


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
