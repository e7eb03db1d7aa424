"""From cues and recognised speech to new times, in one call."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import phrases, retimed
from . import matching as M
from ..functions import phonetic_codes
from ..shared import stored


@dataclass(frozen=True)
class SyncOptions:
    """What steers the matching of a track."""

    #: Cues of a window at most, and the longest gap inside one.
    window: int = 3
    gap_ms: int = 3500
    #: Segments of a phrase at most, its least characters, and the longest gap inside one (none: any).
    segments: int = 3
    length: int = 18
    speech_gap_ms: int | None = None
    #: Tracks with fewer phrases get no anchors.
    phrases: int = 3
    #: Least similarity of a match, what a radius off its place costs, and matches kept of a phrase.
    least: float = 0.38
    weight: float = 0.18
    most: int = 8


def coded(rows: DataFrame) -> DataFrame:
    """rows(norm_text, ...) with codes, the distinct phonetic codes of the text, unless they have them."""
    return rows if "codes" in rows.columns else rows.withColumn("codes", phonetic_codes(F.col("norm_text")))


def matches(cues: DataFrame, speech: DataFrame, options: SyncOptions = SyncOptions()) -> DataFrame:
    """The best windows of each phrase in its band. cues and speech(track_id, pos, start_ms, end_ms, norm_text) are best a written table with codes, dealt out by track: then nothing is shuffled."""
    said = phrases(coded(speech), options.segments, options.length, options.speech_gap_ms, sets="codes")
    return M.code_pairs(said, coded(cues), options.window, options.gap_ms, options.least, (options.weight, options.most))


def anchors(cues: DataFrame, speech: DataFrame, options: SyncOptions = SyncOptions()) -> DataFrame:
    """(track_id, anchor, pos, last_pos, cue_ms, said_ms, similarity) of tracks with enough phrases and a stable chain."""
    return M.align(matches(cues, speech, options).where(F.col("phrases") >= options.phrases), together=True)


def synced(cues: DataFrame, speech: DataFrame, options: SyncOptions = SyncOptions(), keep: Callable[[DataFrame, str], DataFrame] = stored) -> DataFrame:
    """(track_id, pos, start_ms, end_ms, new_start_ms, new_end_ms) of the cues of tracks that have anchors; keep writes these."""
    found = keep(anchors(cues, speech, options).select("track_id", "pos", "cue_ms", "said_ms"), "anchors")
    return retimed(cues.select("track_id", "pos", "start_ms", "end_ms"), found)
