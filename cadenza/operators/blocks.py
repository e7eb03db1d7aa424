"""Tracks whose phrases and cues stand beside each other, compared in blocks of the band, and groups of rows read as a stream of Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows that are gathered before their groups are handled or given out, and pairs of a track that are held before each phrase's best are picked.
ROWS, PAIRS = 8192, 1 << 20
#: What is told of each phrase beside its number.
PLACED = ("expected", "radius", "cues", "phrases")


def grouped(rows: DataFrame, keys: list[str], order: list[str], handle: Callable[[pa.Table, np.ndarray], Iterator[pa.RecordBatch]], schema: str, together: bool = False) -> DataFrame:
    """handle(table, bounds) on whole groups of keys, many at once: group i is rows bounds[i] to bounds[i + 1] of the table, by order.

    A shuffle brings groups together; a task reads them as they come and holds ROWS and one group. together: rows of a
    group stand together in a partition already, in order, as those of banded() do, and stay where they are.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def whole(last: bool) -> Iterator[pa.RecordBatch]:
            table = pa.Table.from_batches(held).combine_chunks()
            new = np.zeros(max(table.num_rows - 1, 0), bool)
            for k in keys:
                new |= pc.not_equal(table[k][1:], table[k][:-1]).to_numpy()
            bounds = np.concatenate([[0], np.flatnonzero(new) + 1, [table.num_rows] if last else []]).astype(np.int64)
            if len(bounds) > 1:
                yield from handle(table, bounds)
            held[:] = table.slice(bounds[-1]).to_batches()

        n = 0
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                n += batch.num_rows
            if n >= ROWS:
                yield from whole(False)
                n = 0
        if held:
            yield from whole(True)

    return (rows if together else rows.repartition(*keys).sortWithinPartitions(*keys, *order)).mapInArrow(run, schema)


def by_track(rows: DataFrame, name: str) -> DataFrame:
    """(track_id, name): the rows of each track as one array of structs, in no order. Rows that are dealt out by track stay where they are."""
    return rows.groupBy("track_id").agg(F.collect_list(F.struct(*[c for c in rows.columns if c != "track_id"])).alias(name))


def beside(a: DataFrame, b: DataFrame, how: str = "inner") -> DataFrame:
    """by_track() of two tables, a row a track; where both are dealt out by track alike, without a shuffle."""
    return a.hint("merge").join(b, "track_id", how)


def flat(column: pa.Array, order: str) -> tuple[np.ndarray, pa.Table]:
    """Where the arrays of a by_track() column begin and end in their joined structs, and these as a table, each array by `order`."""
    lengths = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    table = pa.Table.from_batches([pa.RecordBatch.from_struct_array(pc.list_flatten(column))])
    no, row = table[order].to_numpy(), np.repeat(np.arange(len(column)), lengths)
    if not ((no[1:] >= no[:-1]) | (row[1:] != row[:-1])).all():
        table = table.take(pa.array(np.lexsort((no, row))))
    return np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64), table


def best_of(phrase: np.ndarray, first: np.ndarray, last: np.ndarray, similarity: np.ndarray, expected: np.ndarray, radius: np.ndarray, weight: float, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The pairs that matching.candidates() keeps: where they are, by phrase and place, their scores and their places."""
    far = np.abs(first - expected)
    score = similarity - far / np.maximum(radius, 1) * weight
    order = np.lexsort((first, far, -last, -similarity, -score, phrase))
    begins = np.flatnonzero(np.diff(phrase[order], prepend=-1))
    place = np.arange(1, len(order) + 1) - np.repeat(begins, np.diff(begins, append=len(order)))
    kept = place <= most
    return order[kept], score[order[kept]], place[kept].astype(np.int32)


def tracks_beside(phrases: DataFrame, cues: DataFrame, told: list[str], seen: list[str]) -> DataFrame:
    """(track_id, said, seen): phrases and cues of a track, with what is told of phrases and seen of cues, as a row of two arrays."""
    said = phrases.select("track_id", F.col("phrase_no").cast("long").alias("phrase_no"), *told)
    return beside(by_track(said, "said"), by_track(cues.select("track_id", F.col("pos").cast("long").alias("pos"), "start_ms", "end_ms", *seen), "seen"))


def compared(batch: pa.RecordBatch, over: Callable, schema: str, size: int, gap_ms: int, block: int, best: tuple[float, int] | None = None) -> Iterator[pa.RecordBatch]:
    """The pairs of banded() of a batch of tracks_beside()."""
    names = ["phrase_no", *PLACED, "first_pos", "last_pos", *(c.split()[0] for c in schema.split(", ")), *(["score", "place"] if best else [])]
    (at_p, said), (at_c, heard) = flat(batch["said"], "phrase_no"), flat(batch["seen"], "pos")
    multiply = over(said, heard)
    no, pos, start_ms, end_ms = (t[c].to_numpy() for t, c in ((said, "phrase_no"), (heard, "pos"), (heard, "start_ms"), (heard, "end_ms")))
    island = np.cumsum(np.concatenate([[0], start_ms[1:] - end_ms[:-1] > gap_ms]))
    track, expected, radius, n_cues, n_phrases = (np.zeros(len(no), np.int64) for _ in range(5))
    held: list[list[np.ndarray]] = []
    n = 0

    def given(whole: bool) -> Iterator[pa.RecordBatch]:
        """What is held: of a track that goes on only each phrase's best stay, if these are asked for."""
        nonlocal held, n
        x, *more = (np.concatenate(c) for c in zip(*held))
        if best:
            kept, *ranked = best_of(x, more[0], more[1], more[2], expected[x], radius[x], *best)
        else:
            kept, ranked = np.argsort(x, kind="stable"), []
        x, more = x[kept], [c[kept] for c in more]
        held, n = ([[x, *more]], len(x)) if best and not whole else ([], 0)
        if not held:
            values = [no[x], *(c[x] for c in (expected, radius, n_cues, n_phrases)), *more, *ranked]
            yield pa.RecordBatch.from_arrays([batch["track_id"].take(pa.array(track[x])), *map(pa.array, values)], ["track_id", *names])

    for t, (p0, p1, c0, c1) in enumerate(zip(at_p[:-1].tolist(), at_p[1:].tolist(), at_c[:-1].tolist(), at_c[1:].tolist())):
        mine, count = slice(p0, p1), c1 - c0
        wide = max(count // 12, 70)
        width = min(wide, block)
        track[mine], radius[mine], n_cues[mine], n_phrases[mine] = t, wide, count, p1 - p0
        expected[mine] = np.rint(no[mine] / max(p1 - p0 - 1, 1) * max(count - 1, 1))
        low, high = np.maximum(expected[mine] - wide, 0) // width, np.minimum(expected[mine] + wide, count - 1) // width
        here = pos[c0:c1]
        for b in range(int(low[0]), int(high[-1]) + 1):
            p = slice(p0 + int(np.searchsorted(high, b)), p0 + int(np.searchsorted(low, b, "right")))
            c = slice(c0 + int(np.searchsorted(here, b * width)), c0 + int(np.searchsorted(here, (b + 1) * width + size - 1)))
            if p.start == p.stop or c.start == c.stop:
                continue
            # a window of the block begins in it; cues of the next one are there only for its end
            at, isle, m = pos[c], island[c], c.stop - c.start
            own = at < (b + 1) * width
            first, last = [], []
            for k in range(min(size, m)):
                i = np.flatnonzero(own[: m - k] & (isle[: m - k] == isle[k:]) & (at[k:] == at[: m - k] + k))
                first.append(i)
                last.append(i + k)
            i, j = np.concatenate(first), np.concatenate(last)
            if not len(i):
                continue
            start, end = at[i], at[j]
            for x, y, *more in multiply(p, c, i, j):
                x = x + p.start
                keep = (start[y] >= expected[x] - wide) & (end[y] <= np.minimum(count - 1, expected[x] + wide))
                x, y = x[keep], y[keep]
                held.append([x, start[y], end[y], *(v[keep] for v in more)])
                n += len(x)
            if n > PAIRS:
                yield from given(not best)
        if n > ROWS * 8:
            yield from given(True)
    if held:
        yield from given(True)


def pairs_schema(kind: str, schema: str, best: tuple | None = None) -> str:
    """The schema of banded() for track_id of a kind."""
    return f"track_id {kind}, phrase_no long, expected long, radius long, cues long, phrases long, first_pos long, last_pos long, {schema}{', score double, place int' if best else ''}"


def banded(phrases: DataFrame, cues: DataFrame, told: list[str], seen: list[str], over: Callable, schema: str, size: int, gap_ms: int, block: int, best: tuple[float, int] | None = None) -> DataFrame:
    """Pairs of phrases and windows in their band, from over() on blocks: (track_id, phrase_no, *PLACED, first_pos, last_pos, *schema).

    Phrases and cues of a track meet in a row of two arrays, so tables dealt out by track stay where they are and nothing of them
    is shuffled. Cues are taken in blocks of a radius, `block` at most, with what windows need of the next one, and phrases whose band
    has some of them. over(phrases, cues) gets both of a batch of tracks as tables and gives a function (p, c, first, last), which is told where in these the block's
    phrases and cues are, p and c, and at which of its cues windows begin and end, and yields (phrases, windows, columns of
    schema), places in these; pairs outside of the band go. told and seen are columns of phrases and cues for it. best, a weight and
    a number, keeps of each phrase what matching.candidates() would, with score and place; the first column of schema
    is then the similarity, and the rows of a track stand together, by phrase.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield from compared(batch, over, schema, size, gap_ms, block, best)

    return tracks_beside(phrases, cues, told, seen).mapInArrow(run, pairs_schema(dict(phrases.dtypes)["track_id"], schema, best))


def lists(column: pa.ChunkedArray) -> tuple[np.ndarray, pa.Array]:
    """Where a column's lists begin and end in their joined values, null ones empty, and these values."""
    whole = column.combine_chunks()
    lengths = pc.fill_null(pc.list_value_length(whole), 0).to_numpy(zero_copy_only=False)
    return np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64), pc.list_flatten(whole)
