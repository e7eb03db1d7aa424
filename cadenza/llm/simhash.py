"""SimHash near-duplicates: fingerprints, BK-trees in Hamming blocks, connected components."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bktree import Forest, components
from .common import hot_keys, join_skewed, parts_for, small_batches, stored, utf8
from .components import connected

BITS = 64
#: Fingerprints in one shard of a bucket: bounds a tree, its queries and a task's memory.
SHARD = 8192
#: Rows that a task holds at once, besides those of one group.
CHUNK = 65536


def shingle_spans(text: bytes, words: int) -> tuple[bytes, list[int], list[int]]:
    """The text's words joined by single spaces, lower-cased in A-Z, and where its shingles start and end."""
    found = text.lower().split()
    joined = b" ".join(found)
    if not found:
        return joined, [], []
    ends = (np.cumsum([len(w) for w in found]) + np.arange(len(found))).tolist()
    if len(found) <= words:
        return joined, [0], [len(joined)]
    return joined, [0, *(e + 1 for e in ends[: -words])], ends[words - 1 :]


def fingerprints(texts: list[bytes], words: int, seed: int = 42) -> np.ndarray:
    """SimHash of each text; a bit is 1 if set in over half of the shingles' XXH64, repeats included."""
    digest = xxhash.xxh64_intdigest
    hashes: list[int] = []
    n = np.zeros(len(texts), np.int64)
    for i, text in enumerate(texts):
        joined, starts, ends = shingle_spans(text, words)
        hashes += [digest(joined[a:b], seed) for a, b in zip(starts, ends)]
        n[i] = len(starts)
    out = np.zeros(len(texts), np.uint64)
    some = np.flatnonzero(n)
    if len(some):
        bits = np.unpackbits(np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        sums = np.add.reduceat(bits, (np.cumsum(n) - n)[some], axis=0, dtype=np.int64)
        ones = np.packbits(sums * 2 > n[some, None], axis=1, bitorder="little")
        out[some] = ones.view("<u8").ravel()
    return out


def with_fingerprints(docs: DataFrame, words: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp): the SimHash of every whole text as a signed long. Null or blank texts get zero."""
    small_batches(docs.sparkSession)
    kind = dict(docs.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for batch in batches:
            fp = fingerprints(utf8(batch.column(1)), words).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp)], [id_col, "fp"])

    return docs.select(id_col, F.col(text_col).cast("string")).mapInArrow(run, f"{id_col} {kind}, fp long")


def _blocks(radius: int, n: int) -> list[list[tuple[int, int]]]:
    """Bit ranges (start, width) of the keys: two fingerprints within radius agree on some key.

    radius + 1 blocks leave one block without a difference. While 16-bit buckets stay small that is
    the key; beyond that the rest, which holds up to radius differences, is cut again in the same way.
    """
    m = radius + 1
    cut = [(i * BITS // m, (i + 1) * BITS // m - i * BITS // m) for i in range(m)]
    if n <= 512 << cut[0][1]:
        return [[c] for c in cut]
    keys = []
    for c in cut:
        rest = [b for b in range(BITS) if not c[0] <= b < c[0] + c[1]]
        size = len(rest)
        for j in range(m):
            bits = rest[j * size // m : (j + 1) * size // m]
            runs = [(bits[0], 0)]
            for b in bits:
                runs[-1:] = [(runs[-1][0], runs[-1][1] + 1)] if b == runs[-1][0] + runs[-1][1] else [runs[-1], (b, 1)]
            keys.append([c, *runs])
    return keys


def _spanning(radius: int):
    """Edges that connect what is linked inside each group of rows (bucket, a, b, own, fp)."""

    def links(rows: list[np.ndarray]) -> pa.RecordBatch:
        bucket, a, b, own, fp = rows
        new = np.ones(len(fp), bool)
        new[1:] = (bucket[1:] != bucket[:-1]) | (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        group = np.cumsum(new) - 1
        value = fp.view(np.uint64)
        in_tree, asks = np.flatnonzero(own == a), np.flatnonzero(own == b)
        forest = Forest(group[in_tree], value[in_tree])
        step = 256 if np.bincount(group).max() > 1024 else 4096

        def hits():
            for s in range(0, len(asks), step):
                part = asks[s : s + step]
                for q, i in forest.search(group[part], value[part], radius):
                    yield part[q], in_tree[i]

        label = components(len(fp), hits())
        tied = np.flatnonzero(label != np.arange(len(fp)))
        return pa.RecordBatch.from_arrays([pa.array(fp[tied]), pa.array(fp[label[tied]])], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        held: list[np.ndarray] = [np.empty(0, np.int64)] * 5
        for batch in batches:
            held = [np.concatenate([h, c.to_numpy(zero_copy_only=False)]) for h, c in zip(held, batch.columns)]
            if len(held[0]) >= CHUNK:
                last = (held[0] == held[0][-1]) & (held[1] == held[1][-1]) & (held[2] == held[2][-1])
                cut = int(np.argmax(last))
                if cut:
                    yield links([h[:cut] for h in held])
                    held = [h[cut:] for h in held]
        if len(held[0]):
            yield links(held)

    return run


def linked(distinct: DataFrame, n: int, radius: int = 3, shard: int = SHARD) -> DataFrame:
    """Edges (a, b) whose components are those of all pairs in distinct(fp) that differ in at most radius bits.

    Buckets agree on one Hamming block. A bucket of over `shard` fingerprints is dealt into shards,
    and each pair of shards is one group: a BK-tree of one, searched by the other. Trees travel by
    shuffle, since all of them together grow with the corpus and could not be broadcast.
    """
    spark = distinct.sparkSession

    def bits(parts: list[tuple[int, int]]):
        key = F.lit(0).cast("long")
        for start, width in parts:
            key = F.shiftleft(key, width).bitwiseOR(F.shiftrightunsigned("fp", start).bitwiseAND(F.lit((1 << width) - 1)))
        return key

    cuts = _blocks(radius, n)
    keys = distinct.select("fp", F.posexplode(F.array(*[bits(c) for c in cuts])).alias("cut", "bits"))
    keys = keys.select("fp", (F.shiftleft(F.col("bits"), 8) + F.col("cut")).alias("bucket"))
    large = keys.groupBy("bucket").count().where(F.col("count") > shard).select("bucket", F.ceil(F.col("count") / shard).alias("shards"))
    keys = keys.join(large, "bucket", "left").withColumn("shards", F.coalesce("shards", F.lit(1)).cast("long"))
    keys = keys.withColumn("own", F.pmod(F.xxhash64("fp"), "shards"))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("shards") - 1))
    keys = keys.select("bucket", "own", "fp", other.alias("other"))
    keys = keys.select("bucket", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"), "own", "fp")
    parts = parts_for(n * len(cuts), 500_000, spark)
    keys = keys.repartition(parts, "bucket", "a", "b").sortWithinPartitions("bucket", "a", "b")
    return keys.mapInArrow(_spanning(radius), "a long, b long")


def near_duplicates(docs: DataFrame, words: int = 3, radius: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fingerprint, component_id) for every row of docs.

    Fingerprints of all texts link at radius or fewer differing bits; component_id is the smallest id
    reachable. Null, empty and blank texts share the fingerprint zero. Repeated rows stay, with one
    component. A null id keeps its row and counts only where a component has no other id (then null).
    Columns other than id and text are not read; an empty table gives no rows.
    """
    fp = stored(with_fingerprints(docs, words, id_col, text_col), "simhash")
    distinct = stored(fp.groupBy("fp").agg(F.min(id_col).alias("first_id"), F.count(F.lit(1)).alias("n")), "fps")
    n, rows = distinct.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    roots = connected(linked(distinct.select("fp"), n, radius))
    tied = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    groups = tied.groupBy("root").agg(F.min("first_id").alias("component_id"))
    label = tied.select("fp", "root").join(groups, "root").select("fp", "component_id")
    out = join_skewed(fp, label, "fp", hot_keys(distinct, "fp", "n", rows))
    return out.select(id_col, F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
