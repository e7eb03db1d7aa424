"""Matches of phrases and cue windows by the angle between their vectors, as products of blocks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shared import stored
from .blocks import banded, compared, lists, pairs_schema, tracks_beside

#: Cues of one block at most, and tracks that share what vectors they need.
BLOCK, TRACKS = 2048, 512


def similar(a: np.ndarray, v: np.ndarray, i: np.ndarray, j: np.ndarray, least: float) -> Iterator[tuple]:
    """(phrases, windows, similarity) of at least `least`, of phrases' vectors a and windows from cue i to cue j of v."""
    sums = np.concatenate([np.zeros((1, v.shape[1])), np.cumsum(v, axis=0)])
    w = sums[j + 1] - sums[i]
    lengths = np.sqrt((w * w).sum(1))
    for at in range(0, len(a), 256):
        some = a[at : at + 256]
        norm = np.sqrt((some * some).sum(1))[:, None] * lengths[None]
        dot = some @ w.T
        cosine = np.clip(np.divide(dot, norm, out=np.zeros_like(dot), where=norm > 0), 0.0, 1.0)
        x, y = np.nonzero(cosine >= least)
        yield x + at, y, cosine[x, y]


def vector_pairs(phrases: DataFrame, cues: DataFrame, size: int = 3, gap_ms: int = 3500, least: float = 0.38) -> DataFrame:
    """(track_id, phrase_no, expected, radius, cues, phrases, first_pos, last_pos, similarity): pairs of the band at least so similar.

    phrases(track_id, phrase_no, vector) and cues(track_id, pos, start_ms, end_ms, vector), vectors of whole
    numbers and one length; a null one counts as zero. A window's vector is the sum of its cues'. similarity
    is the cosine, 0 for a zero vector, cut to 0 to 1. In a block of the band all window vectors come from running sums and all similarities from one product of matrices.
    """

    def over(said: pa.Table, seen: pa.Table) -> Callable:
        sides = [lists(t["vector"]) for t in (said, seen)]
        wide = max(max(int(np.diff(at).max(initial=0)) for at, _ in sides), 1)

        def matrix(side: tuple[np.ndarray, pa.Array], at: slice) -> np.ndarray:
            ends, values = side[0][at.start : at.stop + 1], side[1]
            out = np.zeros((at.stop - at.start, wide))
            out[np.diff(ends) > 0] = values.slice(ends[0], ends[-1] - ends[0]).to_numpy(zero_copy_only=False).reshape(-1, wide)
            return out

        def multiply(p: slice, c: slice, i: np.ndarray, j: np.ndarray) -> Iterator[tuple]:
            yield from similar(matrix(sides[0], p), matrix(sides[1], c), i, j, least)

        return multiply

    return banded(phrases, cues, ["vector"], ["vector"], over, "similarity double", size, gap_ms, BLOCK)


def lent_pairs(phrases: DataFrame, cues: DataFrame, vectors: DataFrame, size: int = 3, gap_ms: int = 3500, least: float = 0.38, best: tuple[float, int] | None = None, keep: Callable[[DataFrame, str], DataFrame] = stored) -> DataFrame:
    """vector_pairs() of phrases(track_id, phrase_no, vec_id) and cues(track_id, pos, start_ms, end_ms, vec_id), whose vectors(vec_id, vector) are in a table of their own.

    Vectors don't travel with every phrase and cue: TRACKS tracks of neighbouring numbers are a group, each vector comes to a group once,
    and there rows look it up. Numbers that vectors doesn't have count as zero vectors. keep writes the tracks, which are read twice. best, a weight and a number, keeps what
    matching.candidates() would, with score and place.
    """
    group = F.floor(F.col("track_id") / TRACKS).cast("long").alias("group")
    both = keep(tracks_beside(phrases, cues, ["vec_id"], ["vec_id"]).select(group, "track_id", "said", "seen"), "tracks")
    ids = F.array_distinct(F.concat(F.array_distinct(F.col("said.vec_id")), F.array_distinct(F.col("seen.vec_id"))))
    wanted = both.select(F.col("group").alias("wanted"), F.explode(ids).alias("vec_id")).distinct().join(vectors.where("vector is not null").select("vec_id", "vector"), "vec_id")

    def run(tracks: pa.Table, found: pa.Table) -> pa.Table:
        numbers = found["vec_id"].to_numpy()
        order = np.argsort(numbers)
        numbers = np.append(numbers[order], np.iinfo(np.int64).max)
        ends, values = lists(found["vector"])
        wide = max(int(np.diff(ends).max(initial=0)), 1)
        table = np.zeros((len(numbers), wide), values.type.to_pandas_dtype())
        at = np.flatnonzero(np.diff(ends) > 0)
        table[at] = values.to_numpy(zero_copy_only=False).reshape(-1, wide)
        table[:-1] = table[order]
        table[-1] = 0

        def over(said: pa.Table, seen: pa.Table) -> Callable:
            rows = []
            for t in (said, seen):
                mine = t["vec_id"].fill_null(-1).to_numpy()
                place = np.searchsorted(numbers, mine)
                rows.append(np.where(numbers[place] == mine, place, len(numbers) - 1))
            return lambda p, c, i, j: similar(table[rows[0][p]].astype(float), table[rows[1][c]].astype(float), i, j, least)

        parts = [out for b in tracks.combine_chunks().to_batches() for out in compared(b, over, "similarity double", size, gap_ms, BLOCK, best)] if tracks.num_rows else []
        types = {"similarity": pa.float64(), "score": pa.float64(), "place": pa.int32(), "track_id": tracks.schema.field("track_id").type}
        return pa.Table.from_batches(parts) if parts else pa.schema([(k, types.get(k, pa.int64())) for k in names]).empty_table()

    schema = pairs_schema(dict(phrases.dtypes)["track_id"], "similarity double", best)
    names = [x.split()[0] for x in schema.split(", ")]
    return both.groupBy("group").cogroup(wanted.groupBy("wanted")).applyInArrow(run, schema)
