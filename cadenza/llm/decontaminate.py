"""Benchmark decontamination: SimHash of item-sized windows, Hamming blocks, exact weighted similarity."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, utf8

WORDS, SIMILARITY = 5, 0.8
#: At similarity 0.8 the vectors of shingle counts are at 27 degrees, which differ in 9.7 of 64 bits
#: on average with a deviation of 2.9; the radius is three deviations more.
RADIUS = 19
BLOCKS, WIDTH = 4, 16
#: Bytes of items sent to the tasks at a time; a larger benchmark goes in several rounds over the documents.
ROUND_BYTES = 32 << 20
TOKEN = re.compile(r"\w+")


def tokens(text: str | None) -> list[str]:
    return TOKEN.findall(text.lower()) if text else []


class Index:
    """Items by their number of words; shingles and multi-index Hamming blocks to find them by."""

    def __init__(self, items: list[tuple[int, str]], words: int, similarity: float, radius: int):
        self.words, self.similarity, self.radius = words, similarity, radius
        self.ids = [i for i, _ in items]
        self.tokens = [tokens(t) for _, t in items]
        vocabulary = sorted({w for t in self.tokens for w in t})
        self.word_id = {w: i + 1 for i, w in enumerate(vocabulary)}
        self.bits = np.array([xxhash.xxh64_intdigest(w.encode(), 42) for w in vocabulary] or [0], np.uint64)
        self.coded = [np.array([self.word_id[w] for w in t], np.int64) for t in self.tokens]
        self.shingles = [self.keys(c, self.size(len(c))) for c in self.coded]
        self.counts = [Counter(s.tolist()) for s in self.shingles]
        self.sizes = sorted({self.size(len(c)) for c in self.coded if len(c)})
        # which item lengths a shingle occurs in
        pairs = sorted({(int(k), len(c)) for c, s in zip(self.coded, self.shingles) for k in s})
        self.known = np.array([k for k, _ in pairs], np.uint64)
        self.known_length = np.array([m for _, m in pairs], np.int64)
        self.lengths = sorted({len(c) for c in self.coded if len(c)})
        self.prints = np.array([self.simhash(s, np.array([0]), len(s))[0] if len(s) else 0 for s in self.shingles], np.uint64)
        # blocks of the fingerprints of items of one length, side by side
        self.of_length = {m: np.array([i for i, c in enumerate(self.coded) if len(c) == m], np.int64) for m in self.lengths}
        self.blocks = {m: self.cut(self.prints[own]) for m, own in self.of_length.items()}

    @staticmethod
    def cut(prints: np.ndarray) -> np.ndarray:
        """The BLOCKS blocks [block, fingerprint] of fingerprints."""
        return np.stack([(prints >> np.uint64(block * WIDTH) & np.uint64((1 << WIDTH) - 1)).astype(np.uint16) for block in range(BLOCKS)])

    def size(self, n: int) -> int:
        """Words of a shingle: shorter items than a shingle are one shingle."""
        return min(self.words, n)

    def keys(self, coded: np.ndarray, size: int) -> np.ndarray:
        """One hash for each run of size words, from the words' hashes."""
        n = len(coded) - size + 1
        if n <= 0 or size == 0:
            return np.empty(0, np.uint64)
        word = self.bits[coded - 1]
        key = np.full(n, size, np.uint64)
        for j in range(size):
            key = (key ^ word[j : j + n]) * np.uint64(0x9E3779B97F4A7C15)
            key ^= key >> np.uint64(29)
        return key

    @staticmethod
    def simhash(shingles: np.ndarray, starts: np.ndarray, n: int) -> np.ndarray:
        """SimHash of the n shingles from each start; a bit is 1 if set in over half of them."""
        mixed = (shingles ^ shingles >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)
        mixed ^= mixed >> np.uint64(32)
        bits = np.unpackbits(mixed.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        total = np.zeros((len(bits) + 1, 64), np.int32)
        np.cumsum(bits, axis=0, out=total[1:], dtype=np.int32)
        ones = (total[starts + n] - total[starts]) * 2 > n
        return np.packbits(ones, axis=1, bitorder="little").view("<u8").ravel()

    def search(self, text: str | None) -> list[tuple[int, int, int, float]]:
        """(item id, first word, words, similarity) of the best window for each item found in text."""
        found: dict[int, tuple[float, int, int]] = {}
        words = tokens(text)
        ids = np.fromiter((self.word_id.get(w, 0) for w in words), np.int64, len(words))
        if not ids.any():
            return []
        for size in self.sizes:
            self._search(ids, size, found)
        return [(self.ids[i], start, n, s) for i, (s, start, n) in sorted(found.items())]

    def _search(self, ids: np.ndarray, size: int, found: dict) -> None:
        n = len(ids) - size + 1
        if n <= 0:
            return
        # runs of words that items have; only they can hold an item's shingle
        good = np.ones(n, bool)
        for j in range(size):
            good &= ids[j : j + n] != 0
        at = np.flatnonzero(good)
        if not len(at):
            return
        key = np.full(len(at), size, np.uint64)
        for j in range(size):
            key = (key ^ self.bits[ids[at + j] - 1]) * np.uint64(0x9E3779B97F4A7C15)
            key ^= key >> np.uint64(29)
        low = np.searchsorted(self.known, key)
        high = np.searchsorted(self.known, key, side="right")
        hit = high > low
        if not hit.any():
            return
        # a window that is similar to an item shares a shingle with it: look around the shared ones
        around: dict[int, list[int]] = {}
        for p, a, b in zip(at[hit].tolist(), low[hit].tolist(), high[hit].tolist()):
            for m in set(self.known_length[a:b].tolist()):
                if self.size(m) == size:
                    around.setdefault(m, []).append(p)
        every = None
        for m, places in around.items():
            if every is None:  # shingles with foreign words hash by position: they equal no item's
                every = np.full(n, 0, np.uint64)
                every[at] = key
                odd = np.flatnonzero(~good)
                every[odd] = (odd.astype(np.uint64) + np.uint64(1)) * np.uint64(0xC2B2AE3D27D4EB4F)
            length = min(m, len(ids))
            shingles = length - size + 1
            mark = np.zeros(len(ids) - length + 2, np.int32)
            for p in places:
                mark[max(0, p + size - length)] += 1
                mark[min(p, len(ids) - length) + 1] -= 1
            starts = np.flatnonzero(np.cumsum(mark[:-1]) > 0)
            for run in np.split(starts, np.flatnonzero(np.diff(starts) > 1) + 1):
                if not len(run):
                    continue
                base = int(run[0])
                part = every[base : int(run[-1]) + shingles]
                prints = self.simhash(part, run - base, shingles)
                for w, i in self.candidates(m, prints):
                    s = self.weighed(part[w : w + shingles], i)
                    if s >= self.similarity and (i not in found or s > found[i][0]):
                        found[i] = (s, base + w, length)

    def candidates(self, length: int, prints: np.ndarray) -> list[tuple[int, int]]:
        """(window, item) with fingerprints within the radius.

        Two such fingerprints differ in radius // BLOCKS bits at most in one of their blocks, so only
        those pairs are held against each other whole. Windows are taken a bounded number at a time.
        """
        own, blocks = self.of_length[length], self.blocks[length]
        pairs = []
        step = max(1, (1 << 20) // max(len(own), 1))
        for a in range(0, len(prints), step):
            part = prints[a : a + step]
            mine = self.cut(part)
            near = np.zeros((len(part), len(own)), bool)
            for block in range(BLOCKS):
                near |= np.bitwise_count(mine[block][:, None] ^ blocks[block][None]) <= self.radius // BLOCKS
            w, k = np.nonzero(near)
            fine = np.bitwise_count(part[w] ^ self.prints[own[k]]) <= self.radius
            pairs += zip((w[fine] + a).tolist(), own[k[fine]].tolist())
        return pairs

    def weighed(self, shingles: np.ndarray, item: int) -> float:
        """Weighted Jaccard similarity: shared repeats over all repeats."""
        own, other = self.counts[item], Counter(shingles.tolist())
        both = sum(min(n, other.get(k, 0)) for k, n in own.items())
        return both / (sum(own.values()) + len(shingles) - both)


def _rounds(benchmark: DataFrame) -> list[list[tuple]]:
    """The items (item_id, text) in rounds of about ROUND_BYTES each, one at a time on the driver."""
    items = benchmark.select("item_id", F.col("text").cast("string").alias("text")).where(F.col("text").isNotNull())
    n = max(1, -(-items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0] // ROUND_BYTES))
    for r in range(n):
        some = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == r) if n > 1 else items
        yield sorted(((x.item_id, x.text) for x in some.collect()), key=lambda x: (x[0] is not None, x[0] if x[0] is not None else 0, x[1]))


def contaminated(
    docs: DataFrame, benchmark: DataFrame, words: int = WORDS, similarity: float = SIMILARITY, radius: int = RADIUS
) -> DataFrame:
    """(doc_id, item_id, first_word, n_words, similarity): the best window of each document for each benchmark item.

    Words are runs of word characters in lower case. A window has as many words as the item (the
    whole text where that is shorter); it matches at weighted similarity of `similarity` or more on
    shingles of `words` words. Every text is read whole. A window can only pass if it shares a
    shingle with the item, so windows without one are not hashed. Null or wordless texts and items
    match nothing; equal items each match; repeated rows and documents give a row each. Other
    columns are not read. A benchmark is sent in rounds of ROUND_BYTES, each over all documents.
    """
    spark = docs.sparkSession
    small_batches(spark)
    kind, item_kind = dict(docs.dtypes)["doc_id"], dict(benchmark.dtypes)["item_id"]
    schema = f"doc_id {kind}, item_id {item_kind}, first_word long, n_words long, similarity double"
    names = ["doc_id", "item_id", "first_word", "n_words", "similarity"]
    out = None
    for items in _rounds(benchmark):
        sent = spark.sparkContext.broadcast(items)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterable[pa.RecordBatch]:
            index = Index(sent.value, words, similarity, radius)
            for batch in batches:
                rows = [(d, *hit) for d, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for hit in index.search(text)]
                columns = list(zip(*rows)) or [()] * 5
                types = [batch.schema.field(0).type, None, pa.int64(), pa.int64(), pa.float64()]
                types[1] = pa.int64() if item_kind == "bigint" else pa.string() if item_kind == "string" else None
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)

        found = docs.select("doc_id", F.col("text").cast("string")).mapInArrow(run, schema)
        out = found if out is None else out.unionByName(found)
    return out


def clean(docs: DataFrame, benchmark: DataFrame, words: int = WORDS, similarity: float = SIMILARITY, radius: int = RADIUS) -> DataFrame:
    """The rows of docs in which contaminated() finds nothing, each decided by its own text alone, with all their columns."""
    spark = docs.sparkSession
    small_batches(spark)
    at = docs.columns.index("text")
    out = docs
    for items in _rounds(benchmark):
        sent = spark.sparkContext.broadcast(items)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterable[pa.RecordBatch]:
            index = Index(sent.value, words, similarity, radius)
            for batch in batches:
                yield batch.filter(pa.array([not index.search(t.decode()) for t in utf8(batch.column(at))], pa.bool_()))

        out = out.mapInArrow(run, docs.schema)
    return out
