"""Scored matches of phrases and cue windows, and the anchors that a track keeps of them."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import operators as O
from ..functions import cologne
from . import band_cells
from .blocks import banded, grouped, lists

#: Fixed values of a step from one match to the next, by how sure it is: how far the shares of cues and
#: phrases passed may differ and what more costs, the same for the smallest and largest scale, and for cues passed.
STEPS = {
    "recovered": (0.08, 0.55, 0.20, 0.45, 2.40, 0.45, 18, 0.004),
    "strong": (0.05, 0.85, 0.35, 1.40, 2.10, 0.80, 14, 0.008),
    "plain": (0.03, 1.40, 0.45, 2.40, 1.90, 1.10, 10, 0.015),
}
#: A strong match, one that may recover an offset (similarity, score), the bonus from a similarity on,
#: the cost of a phrase without a match, and of the share by which a place differs from that of its phrase.
STRONG, RECOVERS, BONUS, SKIPPED, PLACE = 0.74, (0.69, 0.68), (0.68, 0.9, 0.08), 0.22, (0.12, 0.35)
#: Neighbours are strong from this similarity, help matches so many cues around them by so much,
#: and a phrase is short up to so many words or characters.
NEIGHBOUR, AROUND, HELP, SHORT_WORDS, SHORT = 0.72, 18, 0.18, 3, 24
#: Cues of one block at most, and codes of it that are looked at together.
BLOCK, CODES = 1024, 4096
#: Scales of stable neighbours, fewest anchors, and those kept: the first ones, similar ones, and about so many.
SCALES, LEAST, FIRST, SIMILAR, TARGET = (0.35, 2.5), 4, 8, 0.80, 10


def word_codes(texts: DataFrame) -> DataFrame:
    """(word, code) of the distinct words of texts(text): phonetics are worked out once a word."""
    words = texts.select(F.explode(F.split("text", " ")).alias("word")).where("word <> ''").distinct()
    return words.select("word", cologne(F.col("word")).alias("code")).where("code <> ''")


def _coded_words(rows: DataFrame, codes: DataFrame, keys: list[str], text: str) -> DataFrame:
    words = rows.select(*keys, F.explode(F.array_distinct(F.split(text, " "))).alias("word"))
    return words.join(codes, "word").select(*keys, "code").distinct()


def code_counts(cues: DataFrame, codes: DataFrame) -> DataFrame:
    """(track_id, code, n): the cues of a track that have a code."""
    return _coded_words(cues, codes, ["track_id", "pos"], "norm_text").groupBy("track_id", "code").agg(F.count(F.lit(1)).alias("n"))


def code_sets(rows: DataFrame, codes: DataFrame, keys: list[str], text: str, counts: DataFrame) -> DataFrame:
    """rows with codes, the distinct phonetic codes of their text as (n, code), rare ones of the track first; keys, with track_id, tell rows apart."""
    ranked = _coded_words(rows, codes, keys, text).join(counts, ["track_id", "code"], "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))
    sets = ranked.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("n", "code"))).alias("codes"))
    return rows.join(sets, keys, "left").withColumn("codes", F.coalesce("codes", F.array().cast("array<struct<n:bigint,code:string>>")))


def overlap(a: Column, b: Column) -> Column:
    """Shared codes as a share of the larger set."""
    return F.size(F.array_intersect(a, b)) / F.greatest(F.size(a), F.size(b), F.lit(1))


def similar_pairs(phrases: DataFrame, windows: DataFrame, cues: DataFrame, least: float = 0.38) -> DataFrame:
    """position_band() of phrases(..., codes) and windows(..., window_codes), but only pairs that may overlap by `least`.

    Sets are ordered by how rare a code is in the track, and an overlap of that share needs a common code among the
    first n - ceil(least n) + 1 of either set of n. So both sides are joined on the codes of these
    prefixes within a cell of the band, each pair by its first common code only, and pairs go whose sizes
    or codes left after it can't reach the overlap. Empty sets have no pairs.
    """
    need = lambda n: F.ceil(n * least - 1e-9)
    prefix = lambda c: F.slice(c, 1, F.greatest((F.size(c) - need(F.size(c)) + 1).cast("int"), F.lit(0)))
    p, w = band_cells(O.expected_places(phrases, cues), windows.drop("text").withColumn("window_codes", F.array_sort("window_codes")))
    p = p.withColumn("head", prefix(F.col("codes")))
    w = w.withColumn("window_head", prefix(F.col("window_codes")))
    p = p.select("*", F.posexplode("head").alias("at", "key"))
    w = w.select("*", F.posexplode("window_head").alias("window_at", "key"))
    both = p.join(w, ["track_id", "cell", "key"]).where(O.in_band())
    n, m = F.size("codes"), F.size("window_codes")
    reach = F.least(n - F.col("at"), m - F.col("window_at"))
    fits = (reach >= need(F.greatest(n, m))) & (F.element_at(F.array_intersect("head", "window_head"), 1) == F.col("key"))
    return both.where(fits).drop("cell", "key", "head", "window_head", "at", "window_at")


def code_pairs(phrases: DataFrame, cues: DataFrame, size: int = 3, gap_ms: int = 3500, least: float = 0.38, best: tuple[float, int] | None = None) -> DataFrame:
    """(track_id, phrase_no, expected, radius, cues, phrases, first_pos, last_pos, similarity, start_ms, said_ms, words, chars): pairs of the band whose codes overlap by `least`.

    phrases(track_id, phrase_no, said_ms, text, codes) and cues(track_id, pos, start_ms, end_ms, codes), codes distinct. A window's
    codes are those of its cues. In a block of the band all shared codes are counted by one product of matrices of
    which code is where. best, a weight and a number, keeps what candidates() would, with score and place, without a shuffle.
    """
    told = phrases.withColumns({"words": F.when(F.col("text") == "", 0).otherwise(F.size(F.split("text", " "))).cast("long"), "chars": F.length("text").cast("long")})

    def over(said: pa.Table, seen: pa.Table) -> Callable:
        (at_p, mine), (at_c, theirs) = lists(said["codes"]), lists(seen["codes"])
        code = pa.concat_arrays([mine, theirs]).dictionary_encode().indices.to_numpy()
        sides = [(at_p, code[: len(mine)]), (at_c, code[len(mine) :])]
        said_ms, words, chars = (said[k].to_numpy() for k in ("said_ms", "words", "chars"))
        start_ms = seen["start_ms"].to_numpy()

        def multiply(p: slice, c: slice, i: np.ndarray, j: np.ndarray) -> Iterator[tuple]:
            n, m = p.stop - p.start, c.stop - c.start
            # only codes of the block's cues can be shared
            names = np.unique(sides[1][1][at_c[c.start] : at_c[c.stop]])
            if not len(names):
                return
            rows, places = [], []
            for (ends, codes), at in zip(sides, (p, c)):
                some = codes[ends[at.start] : ends[at.stop]]
                place = np.minimum(np.searchsorted(names, some), len(names) - 1)
                known = names[place] == some
                rows.append(np.repeat(np.arange(at.stop - at.start), np.diff(ends[at.start : at.stop + 1]))[known])
                places.append(place[known])

            def there(side: int, low: int, high: int, a: int) -> np.ndarray:
                some = slice(*np.searchsorted(rows[side], [low, high]))
                row, place = rows[side][some], places[side][some]
                mine = (place >= a) & (place < a + CODES)
                out = np.zeros((high - low, min(CODES, len(names) - a)), np.float32)
                out[row[mine] - low, place[mine] - a] = 1
                return out

            start, lengths = start_ms[c], np.diff(at_p[p.start : p.stop + 1])
            ys = [np.flatnonzero(j - i == k) for k in range(min(size, m))]
            for low in range(0, n, BLOCK):
                high = min(low + BLOCK, n)
                shared, has = [0.0] * len(ys), [0.0] * len(ys)
                for a in range(0, len(names), CODES):
                    mine, run = there(0, low, high, a), (alone := there(1, 0, m, a))
                    for k, y in enumerate(ys):
                        run = np.maximum(run[:-1], alone[k:]) if k else run
                        some = run[i[y]]
                        shared[k], has[k] = shared[k] + mine @ some.T, has[k] + some.sum(1)
                for k, y in enumerate(ys):
                    share = shared[k] / np.maximum(np.maximum(lengths[low:high, None], has[k][None]), 1).astype(float)
                    x, z = np.nonzero(share >= least)
                    similarity, x = share[x, z], x + low
                    at = x + p.start
                    yield x, y[z], similarity, start[i[y[z]]], said_ms[at], words[at], chars[at]

        return multiply

    return banded(told, cues, ["said_ms", "words", "chars", "codes"], ["codes"], over, "similarity double, start_ms long, said_ms long, words long, chars long", size, gap_ms, BLOCK, best)


def candidates(pairs: DataFrame, similarity: Column, least: float = 0.38, weight: float = 0.18, most: int = 8) -> DataFrame:
    """Of pairs(track_id, phrase_no, expected, radius, first_pos, last_pos, ...) each phrase's best, with similarity, score and place.

    The score falls with the distance from the expected place. Equal scores go by similarity, later
    end, nearness, and the earlier start.
    """
    far = F.abs(F.col("first_pos") - F.col("expected"))
    out = pairs.withColumn("similarity", similarity).where(F.col("similarity") >= least)
    out = out.withColumn("score", F.col("similarity") - far / F.greatest("radius", F.lit(1)) * weight)
    order = Window.partitionBy("track_id", "phrase_no").orderBy(F.desc("score"), F.desc("similarity"), F.desc("last_pos"), far, "first_pos")
    return out.withColumn("place", F.row_number().over(order)).where(F.col("place") <= most)


_STEPS = np.array(list(STEPS.values())).T
#: Steps between matches that are worked out at once, matches before a phrase that are looked at first, and by how much one further back must fall short to be left aside.
STEPS_AT_ONCE, NEAR, SHORT_BY = 1 << 15, 96, 1e-6


def _bonus(similarity: np.ndarray) -> np.ndarray:
    floor, slope, most = BONUS
    return np.clip((similarity - floor) * slope, 0, most)


class Matches:
    """The candidates of one track as arrays, in order of phrase, window and score."""

    def __init__(self, phrase, first, last, cue_ms, said_ms, similarity, score, place, cues: int, phrases: int):
        order = np.lexsort((score, last, first, phrase))
        columns = (phrase, first, last, cue_ms, said_ms, similarity, score, place)
        self.phrase, self.first, self.last, self.cue, self.said, self.similarity, self.score, self.place = (np.asarray(c)[order] for c in columns)
        self.cues, self.phrases = cues, phrases
        self._chain: np.ndarray | None = None

    def take(self, keep: np.ndarray, score: np.ndarray | None = None) -> Matches:
        columns = [c[keep] for c in (self.phrase, self.first, self.last, self.cue, self.said, self.similarity, self.score if score is None else score, self.place)]
        return Matches(*columns, self.cues, self.phrases)

    def off_place(self) -> np.ndarray:
        apart = np.abs(self.first / max(self.cues - 1, 1) - self.phrase / max(self.phrases - 1, 1))
        return np.maximum(apart - PLACE[0], 0) * PLACE[1]

    def steps(self, before: slice, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """What it costs to go on to matches i from each of those before, endless where it can't be done, and what the phrases between cost."""
        i = i[:, None]
        cue, said = self.cue[i] - self.cue[before], self.said[i] - self.said[before]
        apart = self.phrase[i] - self.phrase[before] - 1
        phrase_gap = np.maximum(apart, 0)
        cue_gap = np.maximum(self.first[i] - self.last[before] - 1, 0)
        recovers = (self.similarity[i] >= RECOVERS[0]) & (self.score[i] >= RECOVERS[1])
        strong = (self.similarity[before] >= STRONG) & (self.similarity[i] >= STRONG)
        kind = np.where((phrase_gap <= 1) & recovers, 0, np.where(strong, 1, 2))
        far, far_cost, slow, slow_cost, fast, fast_cost, jump, jump_cost = (column[kind] for column in _STEPS)
        forward = (cue > 0) & (said > 0)
        scale = np.divide(said, cue, out=np.ones(kind.shape), where=forward)
        shares = np.abs(cue_gap / max(self.cues - 1, 1) - phrase_gap / max(self.phrases - 1, 1))
        over = lambda x, cost: np.maximum(x, 0) * cost
        cost = over(shares - far, far_cost) + over(slow - scale, slow_cost) + over(scale - fast, fast_cost)
        cost = np.where(forward, cost + over(cue_gap - np.maximum(phrase_gap * 9, jump), jump_cost), 1e6)
        cost[self.last[before] >= self.first[i]] = np.inf
        return cost, SKIPPED * apart

    def chain(self) -> np.ndarray:
        """The matches of the best chain that moves on in phrases and cues; none if it has fewer than LEAST."""
        if self._chain is None:
            self._chain = self._best_chain()
        return self._chain

    def _best_chain(self) -> np.ndarray:
        n = len(self.phrase)
        if not n:
            return np.empty(0, np.int64)
        own = self.score + _bonus(self.similarity)
        edge = self.off_place()
        best, count, previous = own - SKIPPED * self.phrase - edge, np.ones(n, np.int64), np.full(n, -1)
        # matches of one phrase stand together and are never steps of each other; steps are worked out for many phrases at once
        starts = np.flatnonzero(np.diff(self.phrase, prepend=self.phrase[0] - 1)).tolist()
        groups = list(zip(starts[1:], [*starts[2:], n]))
        # what a chain has gained up to each match, and the most up to it: a step costs nothing or more, so a match that gained too little can't be the one to come from
        gained = np.full(n, -np.inf)
        gained[: starts[1] if groups else n] = np.maximum.accumulate((best + SKIPPED * (self.phrase + 1))[: starts[1] if groups else n])
        until = 0
        for low, high in groups:
            if high > until:
                base, near = low, max(0, low - NEAR)
                until = max(high, min(n, low + STEPS_AT_ONCE // (low - near + NEAR)))
                until = next(z for _, z in groups if z >= until)
                steps, skipped = self.steps(slice(near, until), np.arange(base, until))
            whole = own[low:high] - SKIPPED * self.phrase[low:high]
            total = best[near:low] + own[low:high, None]
            total -= steps[low - base : high - base, : low - near]
            total -= skipped[low - base : high - base, : low - near]
            first = near
            if near:
                least = (np.maximum(total.max(1), best[low:high]) - whole).min() - SHORT_BY
                first = min(int(np.searchsorted(gained[:near], least)), near)
                if first < near:
                    far, apart = self.steps(slice(first, near), np.arange(low, high))
                    total = np.concatenate([best[first:near] + own[low:high, None] - far - apart, total], 1)
            at = total.argmax(1)
            top = total[np.arange(high - low), at]
            at += first
            better = top > best[low:high]
            best[low:high] = np.where(better, top, best[low:high])
            count[low:high] = np.where(better, count[at] + 1, 1)
            previous[low:high] = np.where(better, at, -1)
            total -= best[low:high, None]
            # nearly equal chains that come later count if they are longer
            close = total > -1e-9
            if np.count_nonzero(close) > np.count_nonzero(better):
                for k in range(high - low):
                    tied = np.flatnonzero(close[k]) + first
                    tied = tied[(tied > previous[low + k]) & (count[tied] + 1 > count[low + k])]
                    if len(tied):
                        t = tied[count[tied].argmax()]
                        best[low + k], count[low + k], previous[low + k] = best[low + k] + total[k, t - first], count[t] + 1, t
            if n > NEAR:
                gained[low:high] = np.maximum(gained[low - 1], np.maximum.accumulate(best[low:high] + SKIPPED * (self.phrase[low:high] + 1)))
        final = best - SKIPPED * (self.phrases - self.phrase - 1) - edge
        path = [int(np.lexsort((-np.arange(n), count, final))[-1])]
        while previous[path[-1]] >= 0:
            path.append(int(previous[path[-1]]))
        return np.array(path[::-1] if len(path) >= LEAST else [], np.int64)

    def reranked(self, words: dict[int, int], length: dict[int, int]) -> Matches:
        """Scores raised near the strong matches of the phrases beside, where a phrase is short or has no strong match."""
        chain = self.chain()
        strong = {int(self.phrase[i]): int(self.first[i]) for i in chain if self.similarity[i] >= NEIGHBOUR}
        if not strong:
            return self
        top = {int(p): s for p, s, k in zip(self.phrase, self.similarity, self.place) if k == 1}
        score = self.score.copy()
        for i, p in enumerate(self.phrase.tolist()):
            beside = [strong[q] for q in (p - 1, p + 1) if q in strong]
            if beside and (words[p] <= SHORT_WORDS or length[p] <= SHORT or top[p] < NEIGHBOUR):
                near = min(abs(int(self.first[i]) - x) for x in beside)
                score[i] += max(0.0, 1 - near / AROUND) * HELP
        return self.take(np.arange(len(score)), score)


def stable(cue: np.ndarray, said: np.ndarray) -> np.ndarray:
    """For each two neighbours, if both times rise and the scale between them is within SCALES."""
    a, b = np.diff(cue), np.diff(said)
    scale = np.divide(b, a, out=np.zeros(len(a)), where=a > 0)
    return (a > 0) & (b > 0) & (scale >= SCALES[0]) & (scale <= SCALES[1])


def pruned(m: Matches, keep: np.ndarray) -> np.ndarray:
    """keep, by cue time, without what makes neighbours unstable, as long as more than LEAST are left.

    Of the two of the first unstable pair that goes whose loss leaves the pair around it and the one
    after that stable, then one not next to an end, then the less similar, then the earlier. The ends
    never go.
    """
    keep = keep[np.argsort(m.cue[keep], kind="stable")]
    while len(keep) > LEAST:
        wrong = np.flatnonzero(~stable(m.cue[keep], m.said[keep]))
        if not len(wrong):
            break
        inner = [i for i in (int(wrong[0]), int(wrong[0]) + 1) if 0 < i < len(keep) - 1]
        if not inner:
            break

        def worth(i: int) -> tuple:
            around = np.delete(keep, i)[i - 1 : i + 2]
            return bool(stable(m.cue[around], m.said[around]).all()), i not in (1, len(keep) - 2), -m.similarity[keep[i]], -i

        keep = np.delete(keep, max(inner, key=worth))
    return keep


def thinned(m: Matches, chain: np.ndarray) -> np.ndarray:
    """The anchors of a chain: the first ones, similar ones, and every so many-th, pruned; all of it where these are unstable."""
    chain = chain[np.argsort(m.first[chain], kind="stable")]
    n, at = len(chain), np.arange(len(chain))
    some = (at < FIRST) | (m.similarity[chain] >= SIMILAR) | (n <= TARGET) | (at == n - 1) | (at % max(n // (TARGET - 1), 1) == 0)
    keep = pruned(m, chain[some])
    if len(keep) < 2 or not stable(m.cue[keep], m.said[keep]).all():
        keep = pruned(m, chain)
    return keep if len(keep) >= LEAST else keep[:0]


def align(matches: DataFrame, together: bool = False) -> DataFrame:
    """(track_id, anchor, pos, last_pos, cue_ms, said_ms, similarity): the anchors of each track.

    matches are candidates() with text, or words and chars (how many it has), said_ms, start_ms (of the window), cues and
    phrases. A track is one group: its chain is a search over all of its matches. A track without a stable chain has no rows.
    together: the rows of a track stand together, by phrase, as code_pairs() gives the best, and needn't be shuffled.
    """
    sized = matches if "words" in matches.columns else matches.withColumns({"words": F.size(F.filter(F.split("text", r"\s+"), lambda w: w != "")).cast("long"), "chars": F.length("text").cast("long")})
    columns = ["phrase_no", "first_pos", "last_pos", "start_ms", "said_ms", "similarity", "score", "place", "cues", "phrases", "words", "chars"]

    def run(table: pa.Table, bounds: np.ndarray) -> Iterator[pa.RecordBatch]:
        every = {k: table[k].to_numpy() for k in columns}
        found = []
        for low, high in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
            c = {k: v[low:high] for k, v in every.items()}
            m = Matches(c["phrase_no"], c["first_pos"], c["last_pos"], c["start_ms"].astype(float), c["said_ms"].astype(float), c["similarity"], c["score"], c["place"], int(c["cues"][0]), int(c["phrases"][0]))
            m = m.reranked(*(dict(zip(c["phrase_no"].tolist(), c[k].tolist())) for k in ("words", "chars")))
            keep = thinned(m, m.chain())
            if len(keep):
                found.append((np.full(len(keep), low), np.arange(1, len(keep) + 1), m.first[keep], m.last[keep], m.cue[keep].astype(np.int64), m.said[keep].astype(np.int64), m.similarity[keep]))
        if found:
            at, *values = (np.concatenate(c) for c in zip(*found))
            yield pa.RecordBatch.from_arrays([table["track_id"].combine_chunks().take(pa.array(at)), *map(pa.array, values)], ["track_id", "anchor", "pos", "last_pos", "cue_ms", "said_ms", "similarity"])

    kind = dict(matches.dtypes)["track_id"]
    return grouped(sized.select("track_id", *columns), ["track_id"], ["phrase_no"], run, f"track_id {kind}, anchor long, pos long, last_pos long, cue_ms long, said_ms long, similarity double", together)


def anchor_search(phrases: DataFrame, windows: DataFrame, cues: DataFrame, similarity: Column, from_end: bool = False, least: float = 0.5) -> DataFrame:
    """The best pair of each track in its first or last half, the first in order among equals.

    phrases(track_id, no, anchor_ms, codes), windows(track_id, first_pos, last_pos, start_ms, end_ms, window_codes).
    From the end windows are met last first, up to the first one that ends before the middle.
    """
    half = cues.groupBy("track_id").agg(F.floor(F.count(F.lit(1)) / 2).alias("half"))
    inside = (F.col("first_pos") >= F.col("half")) | ((F.col("first_pos") == F.col("half") - 1) & (F.col("last_pos") >= F.col("half"))) if from_end else F.col("first_pos") <= F.col("half")
    near = windows.drop("text").join(half, "track_id").where(inside)
    both = phrases.join(near, "track_id").withColumn("similarity", similarity).where(F.col("similarity") >= least)
    way = -1 if from_end else 1
    order = F.struct(-F.col("similarity"), "no", F.col("first_pos") * way, F.col("last_pos") * way)
    columns = [c for c in both.columns if c != "track_id"]
    return both.groupBy("track_id").agg(F.min_by(F.struct(*columns), order).alias("best")).select("track_id", *[F.col("best")[c].alias(c) for c in columns])
