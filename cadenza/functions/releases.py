"""What the names of files and releases tell."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LANGUAGE = r"\.([a-zA-Z]{2,3})(?:\.[0-9]+)?$"


def stem(name: Column) -> Column:
    """A file name without folders and its last ending."""
    return F.regexp_replace(F.regexp_extract(name, r"[^/]*$", 0), r"(?<=.)\.[^.]*$", "")


def release_language(name: Column) -> Column:
    """The upper-case code before a number or the ending; EN without one."""
    code = F.regexp_extract(stem(name), LANGUAGE, 1)
    return F.when(code == "", "EN").otherwise(F.upper(code))


def release_name(name: Column) -> Column:
    """The stem without the code that it ends in; a code before a number stays."""
    return F.regexp_replace(stem(name), r"\.[a-zA-Z]{2,3}$", "")


def synced_name(name: Column) -> Column:
    """The name that a re-timed copy is saved by. (K3)"""
    return F.concat(F.regexp_replace(name, r"(?<=[^/])\.[^./]*$", ""), F.lit(".synced.srt"))


def content_type(kind: Column) -> Column:
    """movie or tv as told, else movie."""
    k = F.lower(F.btrim(kind))
    return F.when(k.isin("movie", "tv"), k).otherwise("movie")


def title_kind(kind: Column) -> Column:
    """tv if the kind of a title speaks of tv, a series or an episode, else movie."""
    k = F.lower(F.coalesce(kind, F.lit("")))
    return F.when(F.contains(k, F.lit("tv")) | F.contains(k, F.lit("series")) | F.contains(k, F.lit("episode")), "tv").otherwise("movie")


def episode_range(episodes: Column) -> tuple[Column, Column]:
    """The first of several episodes, and the last if there are two or more."""
    return F.try_element_at(episodes, F.lit(1)), F.when(F.size(episodes) > 1, F.element_at(episodes, -1))
