"""Windows, joins and batches over tracks; every window is partitioned by its track."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import clean_override_tags, normalize_text


def track():
    return Window.partitionBy("track_id").orderBy("pos")


def cues(docs: DataFrame) -> DataFrame:
    """(track_id, cue_no, pos, start_ms, end_ms, raw_text, norm_text): documents cut into timed cues."""
    parts = docs.select(F.col("doc_id").alias("track_id"), F.posexplode(F.split("text", r"[.\n]", -1)).alias("p", "part"))
    parts = parts.withColumn("raw_text", F.trim("part"))
    parts = parts.withColumn("norm_text", normalize_text(F.col("raw_text"))).where("norm_text <> ''")
    by_part = Window.partitionBy("track_id").orderBy("p")
    length = 800 + 15 * F.length("raw_text") + 200 + ((F.col("track_id") * 7 + F.col("p") * 13) % 8) * 700
    start = F.coalesce(F.sum(length).over(by_part.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return parts.select(
        "track_id", (F.col("p") + 1).cast("long").alias("cue_no"), (F.row_number().over(by_part) - 1).cast("long").alias("pos"),
        start.cast("long").alias("start_ms"), (start + 800 + 15 * F.length("raw_text")).cast("long").alias("end_ms"), "raw_text", "norm_text",
    )


def _runs(cues: DataFrame, size: int, gap_ms: int, sets: str | None) -> tuple[DataFrame, Callable[[Column], list[Column]]]:
    """cues with run, itself and up to size - 1 that follow without a longer gap, and what gives the text (and sets) of a run's first n. One pass of leads over the track; no self-join."""
    out = cues.withColumn("broken", (F.col("start_ms") - F.lag("end_ms").over(track()) > gap_ms).cast("int"))
    out = out.withColumn("island", F.sum(F.coalesce("broken", F.lit(0))).over(track()))
    ahead = track().rowsBetween(0, size - 1)
    cue = F.struct("pos", "island", "end_ms", "norm_text", *([sets] if sets else []))
    out = out.withColumn("run", F.filter(F.collect_list(cue).over(ahead), lambda x: x["island"] == F.col("island")))

    def parts(n: Column) -> list[Column]:
        first = F.slice("run", 1, n)
        text = F.array_join(F.transform(first, lambda x: x["norm_text"]), " ").alias("text")
        return [text, *([F.array_distinct(F.flatten(F.transform(first, lambda x: x[sets]))).alias(sets)] if sets else [])]

    return out, parts


def sliding_windows(cues: DataFrame, size: int = 3, gap_ms: int = 3500, sets: str | None = None) -> DataFrame:
    """(track_id, first_pos, last_pos, start_ms, end_ms, text): all runs of up to size cues without a longer gap inside.

    One pass of leads over the track; no self-join. sets names a column of arrays whose union a run has, too.
    """
    out, parts = _runs(cues, size, gap_ms, sets)
    out = out.select("track_id", F.col("pos").alias("first_pos"), "start_ms", "run", F.explode(F.sequence(F.lit(1), F.size("run"))).alias("n"))
    last = F.element_at("run", F.col("n"))
    return out.select("track_id", "first_pos", last["pos"].alias("last_pos"), "start_ms", last["end_ms"].alias("end_ms"), *parts(F.col("n")))


def shown_until(screens: DataFrame, default_ms: int = 3000) -> DataFrame:
    """screens(track_id, pos, start_ms, objects) with objects, and their end: the next screen if that is empty, else a default."""
    nxt = lambda c: F.lead(c).over(track())
    out = screens.withColumn("end_ms", F.coalesce(F.when(nxt("objects") == 0, nxt("start_ms")), F.col("start_ms") + default_ms))
    return out.where("objects > 0")


def absolute_times(segments: DataFrame) -> DataFrame:
    """segments(track_id, chunk_ms, seg_no, start_ms, end_ms, words, text) with times from the start of all.

    Times are relative to chunk_ms. The first and last of words(start_ms, end_ms) that have both times
    take the place of the segment's own. Segments without text go.
    """
    timed = F.filter("words", lambda w: w["start_ms"].isNotNull() & w["end_ms"].isNotNull())
    some = F.size(timed) > 0
    start = F.coalesce(F.when(some, F.element_at(timed, 1)["start_ms"]), F.col("start_ms"))
    end = F.coalesce(F.when(some, F.element_at(timed, -1)["end_ms"]), F.col("end_ms"))
    kept = segments.where(F.btrim("text") != "")
    return kept.select("track_id", "seg_no", (start + F.col("chunk_ms")).alias("start_ms"), (end + F.col("chunk_ms")).alias("end_ms"), F.btrim("text").alias("text"))


def fill_ends(cues: DataFrame, default_ms: int = 3000) -> DataFrame:
    """end_ms from a positive duration, else the next start, else a default."""
    shown = F.when(F.col("duration_ms") > 0, F.col("start_ms") + F.col("duration_ms"))
    return cues.withColumn("end_ms", F.coalesce(shown, F.lead("start_ms").over(track()), F.col("start_ms") + default_ms))


def piecewise_segments(anchors: DataFrame) -> DataFrame:
    """(track_id, seg, from_ms, to_ms, scale, offset_ms) between neighbouring anchors(track_id, pos, cue_ms, said_ms)."""
    nxt = lambda c: F.lead(c).over(track())
    out = anchors.withColumns({"to_ms": nxt("cue_ms"), "to_said": nxt("said_ms"), "seg": F.row_number().over(track())}).where("to_ms > cue_ms")
    out = out.withColumn("scale", (F.col("to_said") - F.col("said_ms")) / (F.col("to_ms") - F.col("cue_ms")))
    return out.select("track_id", "seg", F.col("cue_ms").alias("from_ms"), "to_ms", "scale", (F.col("said_ms") - F.col("cue_ms") * F.col("scale")).alias("offset_ms"))


def segment_of(cues: DataFrame, segments: DataFrame, at: str = "start_ms") -> DataFrame:
    """Each cue with the first segment that ends at or after its time `at`, else the last one.

    An as-of join in one running window, latest first: both sides are ordered by time within the track, so no
    pairs are made. Of equal ends the segment of the highest number is the last one.
    """
    seg = F.struct("seg", "from_ms", "to_ms", "scale", "offset_ms")
    right = segments.select("track_id", F.col("to_ms").alias("t"), F.lit(1).alias("side"), seg.alias("segment"))
    left = cues.withColumns({"t": F.col(at), "side": F.lit(0)})
    both = left.unionByName(right, allowMissingColumns=True)
    backwards = Window.partitionBy("track_id").orderBy(F.desc("t"), F.desc("side"), F.desc("segment.seg"))
    after = F.last("segment", ignorenulls=True).over(backwards.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    final = F.first("segment", ignorenulls=True).over(backwards.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return both.withColumn("found", F.coalesce(after, final)).where("side = 0").select(*cues.columns, "found.seg", "found.scale", "found.offset_ms")


def retimed(cues: DataFrame, anchors: DataFrame) -> DataFrame:
    """(track_id, pos, start_ms, end_ms, new_start_ms, new_end_ms): cues moved by the segments between a track's anchors.

    anchors(track_id, pos, cue_ms, said_ms) must rise in both times. Both ends of a cue move by the segment that they lie
    in, the first one that ends at or after them, else the last one; times are rounded to even, not before 0, and an end is never before its
    start. Tracks of fewer than two anchors have no rows. Cues and anchors of a track meet in a row, so tables dealt out by track stay where they are.
    """
    from .blocks import beside, by_track, flat

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            (at, cue), (at_a, anchor) = flat(batch["cues"], "pos"), flat(batch["anchors"], "pos")
            ends = [cue[c].to_numpy() for c in ("start_ms", "end_ms")]
            new = [np.zeros(len(cue), np.int64) for _ in ends]
            moved = np.zeros(len(cue), bool)
            from_ms, said = anchor["cue_ms"].to_numpy(), anchor["said_ms"].to_numpy()
            for low, high, a, z in zip(at[:-1].tolist(), at[1:].tolist(), at_a[:-1].tolist(), at_a[1:].tolist()):
                x, y = from_ms[a:z], said[a:z]
                seg = np.flatnonzero(x[1:] > x[:-1])
                if not len(seg):
                    continue
                scale = (y[seg + 1] - y[seg]) / (x[seg + 1] - x[seg])
                offset = y[seg] - x[seg] * scale
                order = np.lexsort((seg, x[seg + 1]))
                until = x[seg + 1][order]
                moved[low:high] = True
                for k, t in enumerate(ends):
                    found = order[np.minimum(np.searchsorted(until, t[low:high]), len(seg) - 1)]
                    new[k][low:high] = np.rint(np.maximum(t[low:high] * scale[found] + offset[found], 0))
            kept = np.flatnonzero(moved)
            track = np.repeat(np.arange(batch.num_rows), np.diff(at))
            values = [cue["pos"].to_numpy()[kept], *(t[kept] for t in ends), new[0][kept], np.maximum(*new)[kept]]
            yield pa.RecordBatch.from_arrays([batch["track_id"].take(pa.array(track[kept])), *map(pa.array, values)], names)

    names = ["track_id", "pos", "start_ms", "end_ms", "new_start_ms", "new_end_ms"]
    longs = lambda df, *columns: df.select("track_id", *[F.col(c).cast("long").alias(c) for c in columns])
    both = beside(by_track(longs(cues, "pos", "start_ms", "end_ms"), "cues"), by_track(longs(anchors, "pos", "cue_ms", "said_ms"), "anchors"))
    return both.mapInArrow(run, ", ".join(f"{c} {'long' if k else dict(cues.dtypes)['track_id']}" for k, c in enumerate(names)))


def batches(items: DataFrame, most: int = 50, chars: int = 2000, keep: tuple[str, ...] = ()) -> DataFrame:
    """items(track_id, pos, text) as (track_id, batch, pos): in order, a batch ends before it holds too many items or characters.

    An item of over chars characters is a batch of its own; chars = 0 sets no such limit, and batches are
    counted off. Else where a batch ends depends on all before it, so each track is folded by itself, in one pass.
    keep names further columns that go along.
    """
    if not chars:
        place = F.row_number().over(Window.partitionBy("track_id").orderBy(F.asc_nulls_last("pos"))) - 1
        return items.select("track_id", F.floor(place / max(most, 1)).cast("int").alias("batch"), "pos", *keep)
    kinds = dict(items.dtypes)

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("pos")
        out, batch, count, held = [], 0, 0, 0
        for n in table["n"].to_pylist():
            if count and (count >= most or held + n > chars):
                batch, count, held = batch + 1, 0, 0
            count, held = count + 1, held + n
            out.append(batch)
        return pa.table([table["track_id"], pa.array(out, pa.int32()), *[table[c] for c in ("pos", *keep)]], ["track_id", "batch", "pos", *keep])

    sized = items.select("track_id", "pos", *keep, F.coalesce(F.length("text"), F.lit(0)).alias("n"))
    return sized.groupBy("track_id").applyInArrow(run, ", ".join([f"track_id {kinds['track_id']}, batch int, pos {kinds['pos']}", *[f"{c} {kinds[c]}" for c in keep]]))


def renumbered(cues: DataFrame) -> DataFrame:
    """SRT entries of a track: numbered anew after empty texts are dropped, with time codes. (K1)"""
    from ..functions import time_code

    kept = cues.where(F.trim("raw_text") != "")
    return kept.select("track_id", F.row_number().over(track()).alias("no"), F.concat(time_code(F.col("start_ms")), F.lit(" --> "), time_code(F.col("end_ms"))).alias("times"), "raw_text")


def transcript(cues: DataFrame, *keep: str) -> DataFrame:
    """(track_id, pos, start_ms, end_ms, norm_text, *keep): speech made of cues, every fifth unheard, 2 % slower and 1.5 s late."""
    said = lambda c: (F.floor(F.col(c) * 51 / 50) + 1500).cast("long").alias(c)
    heard = cues.where("pos % 5 <> 4")
    return heard.select("track_id", (F.row_number().over(track()) - 1).cast("long").alias("pos"), said("start_ms"), said("end_ms"), "norm_text", *keep)


def phrases(segments: DataFrame, size: int = 3, least: int = 18, gap_ms: int | None = None, sets: str | None = None) -> DataFrame:
    """(track_id, phrase_no, said_ms, text): from each segment the shortest run of up to size that has `least` characters.

    sets names a column of arrays whose union a run has, too.
    """
    run, parts = _runs(segments, size, gap_ms if gap_ms is not None else 1 << 60, sets)
    reaches = [(F.size("run") >= n) & (F.length(parts(F.lit(n))[0]) >= least) for n in range(1, size + 1)]
    run = run.withColumn("n", F.coalesce(*[F.when(x, n) for n, x in enumerate(reaches, 1)])).where("n is not null")
    number = F.row_number().over(track()) - 1
    return run.select("track_id", number.cast("long").alias("phrase_no"), F.col("start_ms").alias("said_ms"), *parts(F.col("n")))


def edge_candidates(segments: DataFrame, from_end: bool = False, starts: int = 2, size: int = 4, least: int = 12, sets: str | None = None) -> DataFrame:
    """(track_id, seg_no, last_no, anchor_ms, text): runs of up to size segments from the first ones of a track.

    From the end segments count backwards, texts are joined in that order, and the anchor is the end of the run's first one.
    sets names a column of arrays whose union a run has, too.
    """
    more = [sets] if sets else []
    if from_end:
        back = F.row_number().over(Window.partitionBy("track_id").orderBy(F.desc("pos"))) - 1
        segments = segments.withColumn("back", back.cast("long")).select("track_id", F.col("back").alias("pos"), F.col("end_ms").alias("start_ms"), F.lit(None).cast("long").alias("end_ms"), "norm_text", *more)
    runs = sliding_windows(segments.where(F.col("pos") < starts + size - 1), size, 1 << 60, sets)
    runs = runs.where((F.col("first_pos") < starts) & (F.length("text") >= least))
    return runs.select("track_id", F.col("first_pos").alias("seg_no"), F.col("last_pos").alias("last_no"), F.col("start_ms").alias("anchor_ms"), "text", *more)


def linear_transform(ends: DataFrame, drift: float = 0.08, error_ms: float = 1000.0) -> DataFrame:
    """ends(track_id, a_cue, a_said, z_cue, z_said), each with cue_ms and said_ms times, as (track_id, scale, offset_ms, status).

    status is ok, backward (times that don't move forward), drift (a scale too far from 1), or error (the
    end is missed); only ok ones have an offset.
    """
    cue, said = F.col("z_cue") - F.col("a_cue"), F.col("z_said") - F.col("a_said")
    scale = F.try_divide(said, cue)
    out = ends.withColumn("scale", F.when((cue > 0) & (said > 0), scale))
    offset = F.col("a_said") - F.col("a_cue") * F.col("scale")
    missed = F.abs(F.col("z_cue") * F.col("scale") + offset - F.col("z_said")) > error_ms
    status = F.when(F.col("scale").isNull(), "backward").when(F.abs(F.col("scale") - 1) > drift, "drift").when(missed, "error").otherwise("ok")
    return out.withColumn("status", status).select("track_id", "scale", F.when(F.col("status") == "ok", offset).alias("offset_ms"), "status")


def expected_places(phrases: DataFrame, cues: DataFrame) -> DataFrame:
    """phrases(track_id, phrase_no, ...) with where their cue should be and how far around: (expected, radius, cues, phrases).

    cues and phrases are the numbers of them in the track.
    """
    sizes = cues.groupBy("track_id").agg(F.count(F.lit(1)).alias("cues")).withColumn("radius", F.greatest(F.floor(F.col("cues") / 12), F.lit(70)))
    p = phrases.withColumn("phrases", F.count(F.lit(1)).over(Window.partitionBy("track_id"))).join(sizes, "track_id")
    share = F.col("phrase_no") / F.greatest(F.col("phrases") - 1, F.lit(1))
    return p.withColumn("expected", F.bround(share * F.greatest(F.col("cues") - 1, F.lit(1)), 0).cast("long"))


def in_band() -> Column:
    """Whether a window lies within the radius around a phrase's expected place."""
    return (F.col("first_pos") >= F.col("expected") - F.col("radius")) & (F.col("last_pos") <= F.least(F.col("cues") - 1, F.col("expected") + F.col("radius")))


def band_cells(placed: DataFrame, windows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both sides with `cell`, a stretch of a radius: a phrase has the three around its place, a window the one it begins in."""
    around = F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda k: F.floor(F.col("expected") / F.col("radius")) + k)
    radius = placed.groupBy("track_id").agg(F.max("radius").alias("radius"))
    w = windows.join(radius, "track_id").withColumn("cell", F.floor(F.col("first_pos") / F.col("radius"))).drop("radius")
    return placed.withColumn("cell", F.explode(around)), w


def position_band(phrases: DataFrame, windows: DataFrame, cues: DataFrame) -> DataFrame:
    """Phrases with the windows near their expected place: (track_id, phrase_no, expected, radius, first_pos, last_pos, ...).

    Places are cut into cells of a radius, and a phrase is joined with the three cells around it, so
    a long track is spread over many keys and no pair outside of the band's cells is made.
    """
    p, w = band_cells(expected_places(phrases, cues), windows.drop("text"))
    return p.join(w, ["track_id", "cell"]).where(in_band()).drop("cell")


def band_counts(phrases: DataFrame, windows: DataFrame, cues: DataFrame, size: int = 3) -> DataFrame:
    """(track_id, phrase_no, windows, low, high): how many windows position_band() gives each phrase, their first and last cue.

    No pairs are made: windows of up to size cues are counted from the start of the track up to each cue, and a band's are
    those up to its last cue without those up to the one before its first and those that go beyond its last. windows
    are sliding_windows(cues), whose runs from a cue are of every length up to the longest, so a band has its first and last cue.
    """
    reach = windows.groupBy("track_id", F.col("first_pos").alias("pos")).agg(F.max("last_pos").alias("reach"))
    upto = track().rowsBetween(Window.unboundedPreceding, Window.currentRow)
    beyond = sum((F.greatest(F.coalesce(F.lag("reach", k).over(track()), F.lit(0)) - F.col("pos"), F.lit(0)) for k in range(size - 1)), F.lit(0))
    counted = reach.select("track_id", "pos", F.sum(F.col("reach") - F.col("pos") + 1).over(upto).alias("upto"), beyond.alias("beyond"))
    p = expected_places(phrases.select("track_id", "phrase_no"), cues)
    p = p.select("track_id", "phrase_no", F.greatest(F.col("expected") - F.col("radius"), F.lit(0)).alias("low"), F.least(F.col("cues") - 1, F.col("expected") + F.col("radius")).alias("high"))
    ends = counted.select("track_id", F.col("pos").alias("high"), (F.col("upto") - F.col("beyond")).alias("inside"))
    starts = counted.select("track_id", (F.col("pos") + 1).alias("low"), F.col("upto").alias("before"))
    out = p.join(ends, ["track_id", "high"]).join(starts, ["track_id", "low"], "left")
    return out.select("track_id", "phrase_no", (F.col("inside") - F.coalesce("before", F.lit(0))).alias("windows"), "low", "high")


def chunks(tracks: DataFrame, size_ms: int) -> DataFrame:
    """tracks(track_id, end_ms) cut into (track_id, from_ms, to_ms), the last one short."""
    starts = F.sequence(F.lit(0).cast("long"), F.col("end_ms") - 1, F.lit(size_ms).cast("long"))
    out = tracks.where("end_ms > 0").select("track_id", "end_ms", F.explode(starts).alias("from_ms"))
    return out.select("track_id", "from_ms", F.least(F.col("from_ms") + size_ms, F.col("end_ms")).alias("to_ms"))


def structure_line() -> Column:
    """Blank, numeric and time lines."""
    shape = F.btrim("line")
    return (shape == "") | shape.rlike(r"^[\p{Nd}¹²³⁰⁴-⁹₀-₉]+$") | F.contains("line", F.lit("-->"))


def text_blocks(lines: DataFrame, begins: bool = False) -> DataFrame:
    """lines(track_id, line_no, line) to (track_id, block, text): runs between blank, numeric and time lines, joined by blanks.

    begins: with line_no, the line that a block begins at.
    """
    order = Window.partitionBy("track_id").orderBy("line_no")
    shape = F.btrim("line")
    marked = lines.withColumn("structure", structure_line())
    marked = marked.withColumn("island", F.sum(F.col("structure").cast("int")).over(order)).where(~F.col("structure"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", shape.alias("line")))), lambda x: x["line"]), " ")
    blocks = marked.groupBy("track_id", "island").agg(F.min("line_no").alias("line_no"), text.alias("text"))
    number = F.row_number().over(Window.partitionBy("track_id").orderBy("island")) - 1
    return blocks.select("track_id", number.cast("long").alias("block"), *(["line_no"] if begins else []), "text")


def ass_lines(lines: DataFrame) -> DataFrame:
    """lines(track_id, line_no, line) of ASS files, cleaned: (track_id, line_no, line).

    Events (dialogue and comments) stay if their style is Default and a text is left without drawings
    and tags. Fields follow the last format line. Every other line stays. A file whose first styles
    section has no Default style has no rows.
    """
    shape = F.regexp_replace("line", r"^\s+|\s+$", "")
    low = F.lower(shape)
    upto = Window.partitionBy("track_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = Window.partitionBy("track_id")
    header = F.startswith(shape, F.lit("["))
    x = lines.withColumns({"low": low, "shape": shape, "events": F.last(F.when(low == "[events]", True).when(header, False), ignorenulls=True).over(upto)})
    # the first styles section: from its header to the next other header
    begun = F.min(F.when(F.col("low") == "[v4+ styles]", F.col("line_no"))).over(whole)
    x = x.withColumn("begun", begun)
    over = F.min(F.when(header & (F.col("low") != "[v4+ styles]") & (F.col("line_no") > F.col("begun")), F.col("line_no"))).over(whole)
    x = x.withColumn("over", over)
    name = F.btrim(F.element_at(F.split(F.substr("shape", F.lit(7)), ","), 1))
    default = F.startswith(F.col("low"), F.lit("style:")) & (name == "Default") & (F.col("line_no") > F.col("begun")) & (F.col("line_no") < F.coalesce("over", F.lit(1 << 62)))
    x = x.withColumn("good", F.max(F.coalesce(default, F.lit(False))).over(whole)).where("good")
    is_format = F.coalesce("events", F.lit(False)) & F.startswith("low", F.lit("format:"))
    fields = F.transform(F.split(F.substr("low", F.lit(8)), ","), lambda f: F.btrim(f))
    x = x.withColumn("fields", F.last(F.when(is_format, fields), ignorenulls=True).over(upto))
    n, text_at, style_at = F.size("fields"), F.array_position("fields", F.lit("text")), F.array_position("fields", F.lit("style"))
    is_event = F.coalesce("events", F.lit(False)) & (F.startswith("low", F.lit("dialogue:")) | F.startswith("low", F.lit("comment:"))) & F.coalesce(text_at > 0, F.lit(False))
    head = F.regexp_extract("line", r"^[^:]*:\s*", 0)
    parts = F.split(F.substr("line", F.length(head) + 1), ",", F.greatest(n, F.lit(1)))
    x = x.withColumn("parts", F.when(is_event, parts))
    x = x.withColumn("parts", F.when(F.size("parts") >= n, F.col("parts")))
    at = lambda i: F.get("parts", (i - 1).cast("int"))
    clean = clean_override_tags(at(text_at))
    kept = F.col("parts").isNull() | (((style_at == 0) | (F.btrim(at(style_at)) == "Default")) & (clean != ""))
    rebuilt = F.concat(head, F.array_join(F.transform("parts", lambda p, i: F.when(i == text_at - 1, clean).otherwise(p)), ","))
    return x.where(kept).select("track_id", "line_no", F.when(F.col("parts").isNull(), F.col("line")).otherwise(rebuilt).alias("line"))


def rejoined(lines: DataFrame, blocks: DataFrame) -> DataFrame:
    """lines(track_id, line_no, line) with each text block replaced by blocks(track_id, block, text): (track_id, line_no, line).

    A block's text comes where its first line was; structure lines stay; blocks without a text go.
    """
    order = Window.partitionBy("track_id").orderBy("line_no")
    marked = lines.withColumn("structure", structure_line())
    begins = ~F.col("structure") & F.coalesce(F.lag("structure").over(order), F.lit(True))
    marked = marked.withColumn("begins", begins).withColumn("block", F.sum(F.col("begins").cast("long")).over(order) - 1)
    kept = marked.where("structure or begins").join(blocks.select("track_id", "block", F.col("text").alias("new")), ["track_id", "block"], "left")
    return kept.where("structure or new is not null").select("track_id", "line_no", F.when(F.col("structure"), F.col("line")).otherwise(F.col("new")).alias("line"))
