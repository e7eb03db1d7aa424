"""Mixing sources to target weights by Efraimidis-Spirakis keys and prefix sums."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, stored

#: Weights of the sources in code-point order, repeating.
WEIGHTS = (5, 2, 1)
#: All targets together, as a share of all sizes, and each target's limit as a multiple of its source's size.
SHARE, LIMIT = 1.5, 2
#: Sampling weight of a document by its quality label; without a label 1.
QUALITY = {1: 2.0, 0: 0.5}
#: Documents in one range of keys, whose prefix sums one task makes.
RANGE_ROWS = 20_000


def targets(sizes: DataFrame) -> DataFrame:
    """sizes(source, source_size) with target: shares by weight, filled up to LIMIT times the size.

    Capping in the order of limit / weight gives what repeated resharing of the excess ends in.
    The table has a row a source, so its windows need no split.
    """
    rank = F.row_number().over(Window.orderBy(F.asc_nulls_last("source"))) - 1
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (rank % len(WEIGHTS)) + 1)
    t = sizes.withColumn("weight", weight.cast("double")).withColumn("cap", F.col("source_size").cast("double") * LIMIT)
    every = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing).partitionBy(F.lit(0))
    before = Window.partitionBy(F.lit(0)).orderBy(F.col("cap") / F.col("weight"), F.asc_nulls_last("source")).rowsBetween(Window.unboundedPreceding, -1)
    t = t.withColumn("budget", F.sum("source_size").over(every) * F.lit(SHARE)).withColumn("weights", F.sum("weight").over(every))
    spare = (F.col("budget") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (F.col("weights") - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    t = t.withColumn("full", F.col("cap") / F.col("weight") <= spare)
    free = F.try_divide(
        F.col("budget") - F.sum(F.when(F.col("full"), F.col("cap")).otherwise(0.0)).over(every),
        F.sum(F.when(F.col("full"), F.lit(0.0)).otherwise(F.col("weight"))).over(every),
    )
    return t.withColumn("target", F.when(F.col("full"), F.col("cap")).otherwise(free * F.col("weight")))


def uniform(id_col: str) -> Column:
    """In (0, 1), from the id's MD5: the same in every run."""
    digest = F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary"))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / F.lit(float(1 << 52))


def mix(docs: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """(doc_id, source, size, source_size, target, epochs, taken) for every row of docs.

    Whole epochs of a source come first. What the target leaves is filled in the order of the keys
    -ln(u) / quality weight: a document is taken if half of it still fits, so a source ends within
    half a document of its target. Sizes count words; null texts have 0. A null source is one source,
    the last. Null ids share one u; ties go by id, then size. Repeated rows are taken like others.
    Where a document has several labels the largest quality counts, null and other values as none.
    Keys are cut into ranges that one task each sums, so one source may hold most rows.
    """
    sized = docs.select("doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"))
    if labels is not None:
        best = labels.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("quality").alias("quality"))
        sized = sized.join(best, "doc_id", "left")
    else:
        sized = sized.withColumn("quality", F.lit(None).cast("int"))
    weight = F.coalesce(*[F.when(F.col("quality") == k, F.lit(v)) for k, v in QUALITY.items()], F.lit(1.0))
    sized = stored(sized.select("doc_id", "source", "size", (-F.log(uniform("doc_id")) / weight).alias("key")), "sized")
    n = sized.count()
    ranges = max(64, -(-n // RANGE_ROWS))
    cut = F.least(F.floor((1 - F.exp(-F.col("key"))) * ranges), F.lit(ranges - 1)).cast("int")
    sized = sized.withColumn("range", cut).withColumn("s", F.coalesce("source", F.lit(""))).withColumn("none", F.col("source").isNull())

    sums = sized.groupBy("source", "s", "none", "range").agg(F.sum("size").alias("range_size"))
    ahead = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("ahead", F.coalesce(F.sum("range_size").over(ahead), F.lit(0)))
    per_source = targets(sums.groupBy("source").agg(F.sum("range_size").alias("source_size")))
    per_source = per_source.withColumn("epochs", F.coalesce(F.floor(F.try_divide("target", "source_size")), F.lit(0)).cast("long"))
    per_source = per_source.select(
        F.coalesce("source", F.lit("")).alias("s"), F.col("source").isNull().alias("none"), "source_size", "target", "epochs",
        (F.col("target") - F.col("epochs") * F.col("source_size")).alias("rest"),
    )
    sums = sums.drop("source").join(per_source, ["s", "none"])

    so_far = Window.partitionBy("s", "none", "range").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ordered = sized.withColumn("upto", F.sum("size").over(so_far)).join(sums, ["s", "none", "range"])
    fits = F.col("ahead") + F.col("upto") - F.col("size") / 2.0 <= F.col("rest")
    more = F.when(fits & (F.col("rest") > 0), 1).otherwise(0)
    return ordered.select("doc_id", "source", "size", "source_size", "target", "epochs", ((F.col("epochs") + more) * F.col("size")).cast("long").alias("taken"))


ORACLE_SQL = f"""
with best as (select doc_id, max(quality) as quality from labels group by doc_id),
sized as (
  select d.doc_id, d.source, coalesce(len(regexp_extract_all(d.text, '[^\\x20\\x09-\\x0D]+')), 0) as size,
    -ln((cast(('0x' || substr(md5(cast(d.doc_id as varchar)), 1, 13)) as bigint) + 0.5::double) / 4503599627370496::double)
      / (case b.quality when 1 then 2.0::double when 0 then 0.5::double else 1.0::double end) as k
  from documents d left join best b on d.doc_id = b.doc_id),
per as (select source, sum(size)::bigint as source_size from sized group by source),
weighed as (
  select source, source_size, source_size * {LIMIT}::double as cap,
    (case (row_number() over (order by source nulls last) - 1) % 3 when 0 then {WEIGHTS[0]} when 1 then {WEIGHTS[1]} else {WEIGHTS[2]} end)::double as w
  from per),
filled as (
  select *, sum(source_size) over () * {SHARE}::double as budget,
    cap / w <= ((sum(source_size) over () * {SHARE}::double - coalesce(sum(cap) over o, 0)) / (sum(w) over () - coalesce(sum(w) over o, 0))) as is_full
  from weighed window o as (order by cap / w, source nulls last rows between unbounded preceding and 1 preceding)),
aimed as (
  select source, source_size, case when is_full then cap else
    (budget - sum(case when is_full then cap else 0 end) over ()) / sum(case when is_full then 0 else w end) over () * w end as target
  from filled),
ordered as (
  select s.doc_id, s.source, s.size, a.source_size, a.target,
    coalesce(floor(a.target / nullif(a.source_size, 0)), 0)::bigint as epochs,
    sum(s.size) over (partition by s.source order by s.k, s.doc_id, s.size rows unbounded preceding) as upto
  from sized s join aimed a on s.source is not distinct from a.source)
select doc_id, source, size::bigint as size, source_size, target, epochs,
  ((epochs + case when upto - size / 2.0::double <= target - epochs * source_size and target - epochs * source_size > 0 then 1 else 0 end) * size)::bigint as taken
from ordered
"""
