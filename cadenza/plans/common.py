"""The tables that the queries share: cues from documents, jobs from events, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import operators as O
from ..shared import parts_for

#: Seconds that a job of each kind may run; others 600. Fixed values.
LIMITS = {"extract": 300, "sup_to_srt": 600, "translate": 1800, "search_subtitles": 600, "sync_subtitles": 7200, "publish_subtitles": 600}
KINDS, STATES = list(LIMITS), ["pending", "running", "completed", "failed", "timeout"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cue_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.cues(table(spark, sf_dir, "documents"))


def dealt_cues(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, int]:
    """cue_rows() dealt out by track, and the number of parts: whole documents are, before they are cut, so what follows by track shuffles nothing."""
    docs = table(spark, sf_dir, "documents").where("text is not null").select("doc_id", "text")
    parts = parts_for(docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0], spark)
    return O.cues(docs.repartition(parts, "doc_id")), parts


def jobs(events: DataFrame) -> DataFrame:
    """Jobs made from events: (id, job_type, status, created_us, started_us, completed_us)."""
    pick = lambda names: F.element_at(F.array(*map(F.lit, names)), (F.col("event_id") % len(names) + 1).cast("int"))
    created = F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), F.col("ts"))
    out = events.select(F.col("event_id").alias("id"), pick(KINDS).alias("job_type"), pick(STATES).alias("status"), created.alias("created_us"))
    out = out.withColumn("started_us", F.when(F.col("status") != "pending", F.col("created_us") + (F.col("id") % 7) * 60_000_000))
    return out.withColumn("completed_us", F.when(~F.col("status").isin("pending", "running"), F.col("started_us") + (F.col("id") * 37 % 9000) * 1_000_000))


def job_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs(table(spark, sf_dir, "events"))


CUES = r"""
cues as (
  with parts as (select doc_id as track_id, unnest(regexp_split_to_array(text, '[.\n]')) as part, generate_subscripts(regexp_split_to_array(text, '[.\n]'), 1) - 1 as p
    from documents),
  raw as (select track_id, p, trim(part) as raw_text from parts),
  norm as (select *, trim(regexp_replace(regexp_replace(regexp_replace(lower(raw_text), '<[^>]+>|\{[^}]+\}', ' ', 'g'), '[^\p{L}\p{N}\s]', ' ', 'g'), '\s+', ' ', 'g')) as norm_text from raw),
  timed as (select *, 800 + 15 * length(raw_text) as dur, 200 + ((track_id * 7 + p * 13) % 8) * 700 as gap from norm where norm_text <> '')
  select track_id, (p + 1)::bigint as cue_no, (row_number() over o - 1)::bigint as pos,
    coalesce(sum(dur + gap) over (partition by track_id order by p rows between unbounded preceding and 1 preceding), 0)::bigint as start_ms,
    (coalesce(sum(dur + gap) over (partition by track_id order by p rows between unbounded preceding and 1 preceding), 0) + dur)::bigint as end_ms, raw_text, norm_text
  from timed window o as (partition by track_id order by p))"""
JOBS = """
jobs as (
  with j as (select event_id as id, (['extract','sup_to_srt','translate','search_subtitles','sync_subtitles','publish_subtitles'])[event_id % 6 + 1] as job_type,
    (['pending','running','completed','failed','timeout'])[event_id % 5 + 1] as status, epoch_us(ts) as created_us from events)
  select *, case when status <> 'pending' then created_us + (id % 7) * 60000000 end as started_us from j)"""
