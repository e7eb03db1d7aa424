"""Queries on what file names tell: languages, releases, episodes."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import functions as T
from ..functions import languages as L
from ..functions import releases as R
from .common import table

#: What names made of parts have of a source, a mark of the hearing impaired, a language and an ending.
SOURCES = ("BDRip", "DVDRip", "HDTV", "CAM", "WEB", "BluRay", "x264", "BDRemux")
MARKS, CODES, ENDINGS = ("", ".SDH", ".HI", ".hint"), (".de", ".eng", ".fre", ".rod", ".xx", ".en.2", "", ".deutsch"), (".srt", ".mkv", ".ass", ".sup")


def file_names(spark, sf_dir):
    """(p_partkey, name): names of releases made of parts; every kind of source, mark, code and ending occurs."""
    k = F.col("p_partkey")
    pick = lambda names, n: F.element_at(F.array(*map(F.lit, names)), (n % len(names) + 1).cast("int"))
    name = F.concat(F.replace("p_name", F.lit(" "), F.lit(".")), F.lit("."), pick(SOURCES, k), pick(MARKS, F.floor(k / 8)), pick(CODES, F.floor(k / 32)), pick(ENDINGS, F.floor(k / 3)))
    return table(spark, sf_dir, "part").select("p_partkey", name.alias("name"))


def release_names(spark, sf_dir):
    """Release, language, quality and mark of every name, and its name when re-timed."""
    n, release = file_names(spark, sf_dir), R.release_name(F.col("name"))
    return n.select(
        "p_partkey", release.alias("release"), T.squash(release).alias("squashed"), R.release_language(F.col("name")).alias("lang"), T.release_quality(release).alias("quality"),
        T.hearing_impaired(release).alias("impaired"), R.synced_name(F.col("name")).alias("synced"),
    )


def subtitle_languages(spark, sf_dir):
    """The known language at the end of every name."""
    return file_names(spark, sf_dir).select("p_partkey", L.subtitle_language(F.col("name")).alias("language"))


TAGS = ("de", " EN-us", "ger", "pt_BR", "zz", "fre", "x", "nob", "", "tlh")


def _tag():
    return F.element_at(F.array(*map(F.lit, TAGS)), (F.col("p_partkey") % len(TAGS) + 1).cast("int"))


def language_tags(spark, sf_dir):
    """Language tags in three letters, and lists of them."""
    tag = _tag()
    listed = F.concat_ws(",", tag, F.lit("de"), F.lit(" "), tag, F.lit("zh-cn"))
    p = table(spark, sf_dir, "part").select("p_partkey", tag.alias("tag"), F.when(F.col("p_partkey") % 7 == 0, " , ").otherwise(listed).alias("listed"))
    return p.select("p_partkey", L.normalize_language(F.col("tag")).alias("language"), L.language_list(T.comma_list(F.col("listed"))).alias("languages"))


def content_kinds(spark, sf_dir):
    """movie or tv of told types and of kinds of titles, and the first and last episode."""
    kinds = ("TV series", "movie", "tvEpisode", " TV ", "short", "Mini-Series", "tv")
    kind = F.element_at(F.array(*map(F.lit, kinds)), (F.col("p_partkey") % len(kinds) + 1).cast("int"))
    p = table(spark, sf_dir, "part").select("p_partkey", kind.alias("kind"), F.col("p_partkey").alias("k"))
    episodes = F.when(F.col("k") % 4 > 0, F.sequence(F.col("k") % 20, F.col("k") % 20 + F.col("k") % 4 - 1)).otherwise(F.array().cast("array<bigint>"))
    first, last = R.episode_range(F.col("e"))
    return p.withColumn("e", episodes).select("p_partkey", R.content_type(F.col("kind")).alias("told"), R.title_kind(F.col("kind")).alias("guessed"), first.alias("first_episode"), last.alias("last_episode"))


def file_kinds(spark, sf_dir):
    """Endings of names and if they are subtitles. (F16)"""
    name = F.col("name")
    return file_names(spark, sf_dir).select("p_partkey", T.extension(name).alias("ending"), T.extension(name).isin("srt", "sup", "sub", "ass", "ssa").alias("subtitle"))


def _list(names) -> str:
    return "[" + ", ".join(f"'{x}'" for x in names) + "]"


def _rows(text: str) -> str:
    return ", ".join(f"('{a}', '{b}')" for a, b in L.pairs(text))


_NAMES = f"""names as (select p_partkey, replace(p_name, ' ', '.') || '.' || ({_list(SOURCES)})[p_partkey % 8 + 1] || ({_list(MARKS)})[p_partkey // 8 % 4 + 1]
  || ({_list(CODES)})[p_partkey // 32 % 8 + 1] || ({_list(ENDINGS)})[p_partkey // 3 % 4 + 1] as name from part),
stems as (select *, regexp_replace(name, '\\.[^.]*$', '') as stem, regexp_replace(regexp_replace(name, '\\.[^.]*$', ''), '\\.[a-zA-Z]{{2,3}}$', '') as release from names)"""
_CODES = f"iso(a, b) as (values {_rows(L.ALPHA3)}), old(a, b) as (values {_rows(L.BIBLIOGRAPHIC)})"
_THREE = "case length(c) when 2 then (select b from iso where iso.a = c) when 3 then coalesce((select b from old where old.a = c), c) end"
SQL = {
    "release_names": f"""with {_NAMES} select p_partkey, release, regexp_replace(lower(release), '[^a-z0-9]+', '', 'g') as squashed,
case when regexp_extract(stem, '\\.([a-zA-Z]{{2,3}})(?:\\.[0-9]+)?$', 1) = '' then 'EN' else upper(regexp_extract(stem, '\\.([a-zA-Z]{{2,3}})(?:\\.[0-9]+)?$', 1)) end as lang,
case when regexp_matches(lower(release), 'bluray|bdrip|bdremux') then 'bluray' when contains(lower(release), 'dvd') then 'dvd' when contains(lower(release), 'hdtv') then 'hdtv'
when contains(lower(release), 'cam') then 'cam' else 'web' end as quality, regexp_matches(lower(release), '\\b(hi|sdh)\\b') as impaired, stem || '.synced.srt' as synced from stems""",
    "subtitle_languages": f"""with {_NAMES}, {_CODES}, c as (select p_partkey, lower(regexp_extract(stem, '\\.([a-zA-Z]{{2,3}})$', 1)) as c from stems), t as (select p_partkey, {_THREE} as language from c)
select p_partkey, case when language in (select b from iso) then language end as language from t""",
    "language_tags": f"""with {_CODES}, g as (select p_partkey, ({_list(TAGS)})[p_partkey % 10 + 1] as tag from part),
c as (select *, split_part(replace(lower(trim(tag)), '_', '-'), '-', 1) as c, case when p_partkey % 7 = 0 then ' , ' else tag || ',de, ,' || tag || ',zh-cn' end as listed from g),
x as (select p_partkey, c, list_filter(list_transform(string_split(listed, ','), lambda x: trim(x)), lambda x: x <> '') as l from c),
y as (select *, list_transform(case when len(l) = 0 then ['en'] else l end, lambda x: upper(replace(x, '-', '_'))) as u from x)
select p_partkey, {_THREE} as language, array_to_string(list_filter(u, lambda x, i: list_position(u, x) = i), ',') as languages from y""",
    "content_kinds": """with k as (select p_partkey, (['TV series', 'movie', 'tvEpisode', ' TV ', 'short', 'Mini-Series', 'tv'])[p_partkey % 7 + 1] as kind from part)
select p_partkey, case when lower(trim(kind)) in ('movie', 'tv') then lower(trim(kind)) else 'movie' end as told, case when regexp_matches(lower(kind), 'tv|series|episode') then 'tv' else 'movie' end as guessed,
case when p_partkey % 4 > 0 then p_partkey % 20 end as first_episode, case when p_partkey % 4 > 1 then p_partkey % 20 + p_partkey % 4 - 1 end as last_episode from k""",
    "file_kinds": f"with {_NAMES} select p_partkey, lower(regexp_extract(name, '\\.([^.]+)$', 1)) as ending, lower(regexp_extract(name, '\\.([^.]+)$', 1)) in ('srt', 'sup', 'sub', 'ass', 'ssa') as subtitle from names",
}
