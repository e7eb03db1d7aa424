"""Site-relative line frequency: lines on too large a share of a site's pages are boilerplate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import hot_keys, join_skewed, stored

#: Lines on more than this share of a site's pages go.
RATIO = 0.05
#: A line on fewer pages than this is kept: one page repeats nothing, and on a site of few pages each of its lines has a large share.
MIN_PAGES = 2
#: Boilerplate lines that may be broadcast as hashes of 32 characters, for all sites together.
BROADCAST_LINES = 50_000


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _key(line: Column) -> Column:
    """A line's identity: without blanks at its ends."""
    return F.md5(F.btrim(line, F.lit(" \t\r")))


def boilerplate(docs: DataFrame, site_col: str, text_col: str, ratio: float, min_pages: int) -> DataFrame:
    """(site, key): the lines to drop. Counts combine on the map side, so a line or site may be on any share of rows.

    Over a site of n pages at most (lines a page) / ratio lines can pass the ratio.
    """
    pages = docs.where(F.col(site_col).isNotNull()).groupBy(F.col(site_col).alias("site")).agg(F.count(F.lit(1)).alias("n_pages"))
    some = F.filter(_lines(F.col(text_col)), lambda x: F.btrim(x, F.lit(" \t\r")) != "")
    lines = docs.where(F.col(site_col).isNotNull() & F.col(text_col).isNotNull()).select(
        F.col(site_col).alias("site"), F.explode(F.array_distinct(F.transform(some, _key))).alias("key")
    )
    often = lines.groupBy("site", "key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_pages)
    return often.join(pages, "site").where(F.col("n") > F.col("n_pages") * F.lit(float(ratio))).select("site", "key")


def drop_boilerplate(
    docs: DataFrame, site_col: str = "source", text_col: str = "text", ratio: float = RATIO, min_pages: int = MIN_PAGES
) -> DataFrame:
    """docs with boilerplate lines removed from text, and the columns n_lines and n_dropped.

    A line is boilerplate if it is on at least min_pages pages and on over ratio of its site's pages
    (a page counts once, however often it repeats the line; repeated rows are pages of their own).
    Blank lines stay. A null text stays null with 0 lines; an empty one has one line. Rows without a
    site are no site's pages and stay as they are. Extra columns pass through; clashing names n_lines,
    n_dropped are replaced. An empty table gives no rows.
    """
    drops = stored(boilerplate(docs, site_col, text_col, ratio, min_pages), "boilerplate")
    by_site = drops.groupBy("site").agg(F.collect_set("key").alias("drop"))
    # the row travels as one column, so that no name of its own can clash
    keyed = docs.select(F.struct("*").alias("row"), F.col(site_col).alias("site"), F.col(text_col).cast("string").alias("text"))
    if drops.count() <= BROADCAST_LINES:
        joined = keyed.join(F.broadcast(by_site), "site", "left")
    else:
        sites = keyed.groupBy("site").agg(F.count(F.lit(1)).alias("n"))
        joined = join_skewed(keyed, by_site, "site", hot_keys(sites, "site", "n", docs.count()))
    lines = _lines(F.col("text"))
    kept = F.when(F.col("drop").isNull(), lines).otherwise(F.filter(lines, lambda x: ~F.array_contains("drop", _key(x))))
    none = F.col("text").isNull()
    out = joined.withColumn("kept", kept).withColumn("n_lines", F.when(none, 0).otherwise(F.size(lines)))
    out = out.withColumn("n_dropped", F.when(none, 0).otherwise(F.col("n_lines") - F.size("kept")))
    out = out.withColumn("text", F.when(F.col("n_dropped") == 0, F.col("text")).otherwise(F.array_join("kept", "\n")))
    columns = [F.col("text").alias(c) if c == text_col else F.col("row").getField(c).alias(c) for c in docs.columns if c not in ("n_lines", "n_dropped")]
    return out.select(*columns, "n_lines", "n_dropped")


ORACLE_SQL = f"""
with lines as (
  select distinct doc_id, source, md5(trim(line, chr(32) || chr(9) || chr(13))) as k
  from (select doc_id, source, unnest(string_split(text, chr(10))) as line from documents)
  where trim(line, chr(32) || chr(9) || chr(13)) <> '' and source is not null),
pages as (select source, count(*) as n_pages from documents group by source),
often as (select source, k, count(*) as n from lines group by source, k having count(*) >= {MIN_PAGES}),
drops as (select o.source, list(o.k) as ks from often o join pages p on o.source = p.source
          where o.n > p.n_pages * cast({RATIO} as double) group by o.source),
cut as (
  select d.doc_id, d.source, string_split(d.text, chr(10)) as l,
         list_filter(string_split(d.text, chr(10)), lambda x: not coalesce(list_contains(s.ks, md5(trim(x, chr(32) || chr(9) || chr(13)))), false)) as kept
  from documents d left join drops s on d.source = s.source)
select doc_id, source, cast(len(l) as integer) as n_lines, cast(len(l) - len(kept) as integer) as n_dropped,
       coalesce(array_to_string(kept, chr(10)), '') as text
from cut
"""
