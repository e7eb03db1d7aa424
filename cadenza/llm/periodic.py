"""Periodic runs: stretches of words that repeat at once, found on a harmonic grid by prefix hashes."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, utf8

#: A run has so many words at least, and its period so often.
LEAST, TIMES = 6, 4
#: Words that are searched together, and (period, grid point) pairs that are held at a time.
WORDS, PAIRS = 400_000, 1 << 20
#: Odd base of the prefix hashes, and the multiplier that spreads word numbers. Any odd numbers do.
BASE, SPREAD = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93


class Grid:
    """Words of several documents in a row, with hashes of all prefixes.

    words are numbers, equal ones for equal words; begin[d] is where document d begins, and the last
    entry where all end.
    """

    def __init__(self, words: np.ndarray, begin: np.ndarray):
        self.words, self.begin = words, begin
        n = len(words)
        value = (words.astype(np.uint64) + np.uint64(1)) * np.uint64(SPREAD)
        value ^= value >> np.uint64(29)
        power = np.full(n + 1, BASE, np.uint64)
        power[:1] = 1
        self.power = np.cumprod(power, dtype=np.uint64)
        self.prefix = np.zeros(n + 1, np.uint64)
        np.cumsum(value * self.power[:-1], out=self.prefix[1:], dtype=np.uint64)

    def same(self, x: np.ndarray, period: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Whether the n words from x are those from x + period, by their hashes."""
        y = x + period
        return (self.prefix[x + n] - self.prefix[x]) * self.power[period] == self.prefix[y + n] - self.prefix[y]

    def longest(self, x: np.ndarray, period: np.ndarray, most: np.ndarray, back: bool) -> np.ndarray:
        """For all pairs at once by binary search: how many words from x on (before x, if back) are those a period later."""
        low, high = np.zeros_like(most), most.copy()
        while (open_ := low < high).any():
            mid = (low + high + 1) >> 1
            ok = self.same(x - mid if back else x, period, mid)
            low = np.where(open_ & ok, mid, low)
            high = np.where(open_ & ~ok, mid - 1, high)
        return low

    def pairs(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(document, period, grid point), some at a time; the grid of a period has every third multiple of it.

        A run of four periods has three of them in which a word is that a period later, hence a grid point.
        """
        size = np.diff(self.begin)
        tops = np.where(size >= LEAST, size // TIMES, 0)
        doc = np.repeat(np.arange(len(size)), tops)
        period = np.arange(len(doc)) - np.repeat(np.cumsum(tops) - tops, tops) + 1
        step = (TIMES - 1) * period
        points = -(-(size[doc] - period) // step)
        upto = np.cumsum(points)
        at = 0
        while at < len(doc):
            end = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + PAIRS, "right")))
            some = points[at:end]
            which = np.repeat(np.arange(at, end), some)
            turn = np.arange(len(which)) - np.repeat(np.cumsum(some) - some, some)
            yield doc[which], period[which], self.begin[doc[which]] + turn * step[which]
            at = end

    def runs(self) -> np.ndarray:
        """Rows (document, start, length, period) of all runs, by document, start, and period; starts count from the document's first word."""
        found = [np.zeros((0, 4), np.int64)]
        for doc, period, x in self.pairs():
            hit = self.words[x] == self.words[x + period]
            doc, period, x = doc[hit], period[hit], x[hit]
            after = self.longest(x, period, self.begin[doc + 1] - x - period, back=False)
            before = self.longest(x, period, x - self.begin[doc], back=True)
            long = after + before + period >= np.maximum(LEAST, TIMES * period)
            doc, period, x, after, before = (v[long] for v in (doc, period, x, after, before))
            found.append(np.stack([doc, x - before, after + before + period, period], axis=1))
        rows = np.unique(np.concatenate(found), axis=0)
        rows = np.array([r for row in rows.tolist() for r in self._verified(*row)], np.int64).reshape(-1, 4)
        rows = np.unique(rows, axis=0)
        # of one stretch the smallest period counts: others are multiples of it
        first = np.ones(len(rows), bool)
        first[1:] = (rows[1:, :3] != rows[:-1, :3]).any(axis=1)
        rows = rows[first]
        rows[:, 1] -= self.begin[rows[:, 0]]
        return rows

    def _verified(self, doc: int, start: int, length: int, period: int) -> list[tuple[int, int, int, int]]:
        """The run itself if its words agree. Else its hashes have met by chance, and the runs inside are read off the words."""
        low, high = int(self.begin[doc]), int(self.begin[doc + 1])
        equal = self.words[start : start + length - period] == self.words[start + period : start + length]
        bounded = (start == low or self.words[start - 1] != self.words[start - 1 + period]) and (start + length == high or self.words[start + length] != self.words[start + length - period])
        if equal.all() and bounded:
            return [(doc, start, length, period)]
        equal = self.words[low : high - period] == self.words[low + period : high]
        edges = np.flatnonzero(np.diff(np.concatenate([[0], equal.view(np.int8), [0]])))
        spans = ((int(a), int(b - a) + period) for a, b in zip(edges[::2], edges[1::2], strict=True))
        return [(doc, low + a, n, period) for a, n in spans if n >= max(LEAST, TIMES * period)]


def kept_words(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """Which of n words stay: those that no run(start, length, period) holds after its first period."""
    change = np.zeros(n + 1, np.int64)
    for start, length, period in runs:
        change[start + period] += 1
        change[start + length] -= 1
    return np.cumsum(change[:-1]) == 0


def strongest(runs: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run(start, length, period) of most repetitions, exactly; of equal ones the first, then that of the smallest period."""
    best = None
    for run in sorted(runs, key=lambda r: (r[0], r[2])):
        if best is None or run[1] * best[2] > best[1] * run[2]:
            best = run
    return best


def planted(words: list[bytes], doc_id: object) -> list[bytes]:
    """Words with the repetition that the id of some documents sets: every tenth one repeats a stretch from some word on. A null id sets none."""
    if doc_id is None or not words:
        return words
    h, n = crc32(str(doc_id).encode()), len(words)
    g = h // 10
    if h % 10:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + i % p] for i in range(n - a)]


def find_runs(docs: DataFrame, plant: bool = False) -> DataFrame:
    """Per document its runs and what collapsing them leaves of its words.

    docs(doc_id, text) to (doc_id, n_runs, start, length, period, exponent_milli, runs_sha256,
    collapsed_sha256, runs, text). Words are runs of anything but the six ASCII blanks. A run is a
    stretch whose words agree with those a period later, of LEAST words and TIMES periods or more, that
    no neighbour extends; start to exponent_milli are those of the strongest run, null without one;
    text has the words that stay, joined by one space. plant repeats words first, as planted() tells.

    Each document is judged alone, in one pass without a shuffle; a task holds some WORDS words and
    the largest document. Null and empty texts have no words and no runs, and the digests of nothing.
    Repeated and null ids are documents like others; other columns are ignored.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    small_batches(docs.sparkSession)

    def find(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list[object] = []
        texts: list[list[bytes]] = []
        held = 0
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), utf8(batch.column(1)), strict=True):
                words = planted(text.split(), doc_id) if plant else text.split()
                ids.append(doc_id)
                texts.append(words)
                held += len(words)
                if held >= WORDS or len(ids) >= 2000:
                    yield _judged(ids, texts, arrow)
                    ids, texts, held = [], [], 0
        if ids:
            yield _judged(ids, texts, arrow)

    schema = f"doc_id {kind}, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string, runs array<struct<start: long, length: long, period: long>>, text string"
    arrow = _arrow(schema)
    return docs.select("doc_id", F.col("text").cast("string")).mapInArrow(find, schema)


def _judged(ids: list[object], texts: list[list[bytes]], arrow: pa.Schema) -> pa.RecordBatch:
    number: dict[bytes, int] = {}
    flat = np.fromiter((number.setdefault(w, len(number)) for words in texts for w in words), np.int64)
    begin = np.concatenate([[0], np.cumsum([len(words) for words in texts])]).astype(np.int64)
    by_doc: dict[int, list[tuple[int, int, int]]] = {}
    for doc, start, length, period in Grid(flat, begin).runs().tolist():
        by_doc.setdefault(doc, []).append((start, length, period))
    rows = []
    for doc, (doc_id, words) in enumerate(zip(ids, texts, strict=True)):
        runs = by_doc.get(doc, [])
        best = strongest(runs)
        if runs:
            words = [words[i] for i in np.flatnonzero(kept_words(len(words), runs)).tolist()]
        left = b" ".join(words)
        listed = "".join(f"{s},{n},{p}\n" for s, n, p in runs)
        rows.append(
            {
                "doc_id": doc_id, "n_runs": len(runs), "start": best and best[0], "length": best and best[1], "period": best and best[2],
                "exponent_milli": best and 1000 * best[1] // best[2], "runs_sha256": hashlib.sha256(listed.encode()).hexdigest(),
                "collapsed_sha256": hashlib.sha256(left).hexdigest(), "runs": [dict(zip(("start", "length", "period"), r, strict=True)) for r in runs], "text": left.decode(),
            }
        )
    return pa.RecordBatch.from_pylist(rows, arrow)


def _arrow(schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    return to_arrow_schema(_parse_datatype_string(schema))
