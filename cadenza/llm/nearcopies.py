"""Near copies at an exact shingle similarity: rare shingles and SimHash find candidates, whole texts decide."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bktree import Forest, components
from .common import by_chunk, chunk_of, parts_for, small_batches, stored, utf8
from .components import connected
from .simhash import CHUNK, SHARD, shingle_spans

WORDS = 5
#: Similarity from which texts are near copies, as a fraction of whole numbers.
SHARED, OF = 4, 5
#: Bits in which fingerprints of candidates may differ: at similarity 0.8 they differ in 9.7 on
#: average with a deviation of 2.9 (12 and 3.1 for texts of five shingles).
RADIUS = 24
#: One in so many rows is counted to order shingles by how common they are; a shingle is common from
#: so many of those rows on. The order only decides what a search costs, never what it finds.
COUNTED, COMMON, MOST_COMMON = 8, 8, 500_000
#: Bytes of text in one shard of a candidate component.
SHARD_BYTES = 8_000_000


def shingle_set(text: bytes, words: int = WORDS) -> np.ndarray:
    """The distinct hashes of a text's shingles, ascending; a text of fewer words is one shingle."""
    joined, starts, ends = shingle_spans(text, words)
    digest = xxhash.xxh64_intdigest
    return np.unique(np.array([digest(joined[a:b], 42) for a, b in zip(starts, ends)], np.uint64))


def fingerprint(shingles: np.ndarray) -> int:
    """SimHash of a set of shingles as a signed long; none give zero."""
    if not len(shingles):
        return 0
    bits = np.unpackbits(shingles.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return int(np.packbits(bits.sum(0, dtype=np.int64) * 2 > len(shingles), bitorder="little").view("<i8")[0])


def prefix(shingles: np.ndarray, common: np.ndarray) -> np.ndarray:
    """The first shingles in an order that all texts share: the rare ones, then the common ones.

    Two sets of similarity SHARED / OF or more have at least that share of either in common, so the
    first n - ceil(n * SHARED / OF) + 1 of each have one in common.
    """
    n = len(shingles)
    if not n:
        return shingles
    if len(common):
        at = np.minimum(np.searchsorted(common, shingles), len(common) - 1)
        often = common[at] == shingles
        shingles = np.concatenate([shingles[~often], shingles[often]])
    return shingles[: n - -(-n * SHARED // OF) + 1]


def similar_components(sets: list[np.ndarray]) -> np.ndarray:
    """Smallest number reachable from each set over pairs of similarity SHARED / OF or more.

    Every set is held once against all sets that no earlier one has reached.
    """
    n = len(sets)
    label = np.arange(n)
    size = np.array([len(s) for s in sets], np.int64)
    if not n or not size.sum():
        return label
    _, code = np.unique(np.concatenate(sets), return_inverse=True)
    start = np.concatenate([[0], np.cumsum(size)])
    owner = np.repeat(np.arange(n), size)
    open_ = size > 0

    def postings():
        held = open_[owner]
        order = np.argsort(code[held], kind="stable")
        return owner[held][order], np.concatenate([[0], np.cumsum(np.bincount(code[held], minlength=code.max() + 1))])

    at, first = postings()
    left = indexed = int(open_.sum())
    for root in range(n):
        if not open_[root]:
            continue
        open_[root] = False
        left -= 1
        waiting = [root]
        while waiting and left:
            if left * 2 < indexed:
                at, first = postings()
                indexed = left
            x = waiting.pop()
            mine = code[start[x] : start[x + 1]]
            low, n_low = first[mine], first[mine + 1] - first[mine]
            where = np.repeat(low - (np.cumsum(n_low) - n_low), n_low) + np.arange(n_low.sum())
            both = np.bincount(at[where], minlength=n)
            found = np.flatnonzero(open_ & (both * OF >= (size[x] + size - both) * SHARED) & (both > 0))
            label[found] = root
            open_[found] = False
            left -= len(found)
            waiting += found.tolist()
    return label


def _common(rows: DataFrame) -> np.ndarray:
    """Hashes of common shingles, ascending; at most MOST_COMMON come to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(t) for t in utf8(batch.column(0))]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([*sets, np.empty(0, np.uint64)]).view(np.int64))], ["shingle"])

    counted = rows.where(F.pmod(F.xxhash64("row"), F.lit(COUNTED)) == 0).select("text").mapInArrow(run, "shingle long")
    often = counted.groupBy("shingle").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= COMMON)
    return np.sort(often.orderBy(F.desc("n"), "shingle").limit(MOST_COMMON).select("shingle").toArrow()["shingle"].to_numpy().view(np.uint64))


def _sets(rows: DataFrame, common: np.ndarray) -> DataFrame:
    """(chunk, row, id, bytes, n, fp, digest, prefix) of rows(chunk, row, id, text); equal sets have one digest."""
    sent = rows.sparkSession.sparkContext.broadcast(common)
    kind = dict(rows.dtypes)["id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for batch in batches:
            texts = utf8(batch.column(2))
            sets = [shingle_set(t) for t in texts]
            columns = [
                batch.column(0), batch.column(1), pa.array([len(t) for t in texts], pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array([fingerprint(s) for s in sets], pa.int64()),
                pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary()),
                pa.array([prefix(s, sent.value).view(np.int64) for s in sets], pa.list_(pa.int64())),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["row", "id", "bytes", "n", "fp", "digest", "prefix"])

    found = rows.select("row", "id", "text").mapInArrow(run, f"row long, id {kind}, bytes long, n long, fp long, digest binary, prefix array<long>")
    return found.select(chunk_of("row").alias("chunk"), "*")


def _dealt(keys: DataFrame, group: str, shards: DataFrame, item: str) -> DataFrame:
    """keys with the columns a and b: a group of several shards(group, shards) becomes one group for each two of them."""
    keys = keys.join(F.broadcast(shards), group, "left").withColumn("shards", F.coalesce("shards", F.lit(1)).cast("long"))
    keys = keys.withColumn("own", F.pmod(F.xxhash64(item), "shards"))
    keys = keys.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("shards") - 1)))
    # a shard alone is part of its pairs with others
    keys = keys.where((F.col("shards") == 1) | (F.col("own") != F.col("other")))
    return keys.withColumn("a", F.least("own", "other")).withColumn("b", F.greatest("own", "other")).drop("own", "other", "shards")


def _candidates(rows: list[np.ndarray]) -> pa.RecordBatch:
    """Edges that connect what is within RADIUS inside each group of (bucket, a, b, fp, n), if sizes n allow the similarity.

    What is near its group's first fingerprint links to that; all others ask the group's BK-tree.
    """
    bucket, a, b, fp, size = rows
    new = np.ones(len(fp), bool)
    new[1:] = (bucket[1:] != bucket[:-1]) | (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    group, value = np.cumsum(new) - 1, fp.view(np.uint64)
    first = np.flatnonzero(new)[group]

    def allowed(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        return np.minimum(size[x], size[y]) * OF >= np.maximum(size[x], size[y]) * SHARED

    near = (np.bitwise_count(value ^ value[first]) <= RADIUS) & allowed(np.arange(len(fp)), first)
    mixed = np.bincount(group, ~near) > 0
    items, asks = np.flatnonzero(mixed[group]), np.flatnonzero(~near)

    def hits():
        yield np.flatnonzero(near), first[near]
        if len(asks):
            forest = Forest(group[items], value[items])
            step = 256 if np.bincount(group[items]).max() > 1024 else 4096
            for s in range(0, len(asks), step):
                part = asks[s : s + step]
                for q, i in forest.search(group[part], value[part], RADIUS):
                    ok = allowed(part[q], items[i])
                    yield part[q][ok], items[i][ok]

    label = components(len(fp), hits())
    tied = np.flatnonzero(fp[label] != fp)
    return pa.RecordBatch.from_arrays([pa.array(fp[tied]), pa.array(fp[label[tied]])], ["a", "b"])


def _linked(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
    held: list[np.ndarray] = [np.empty(0, np.int64)] * 5
    more: list[pa.RecordBatch] = []

    def all_of() -> list[np.ndarray]:
        return [np.concatenate([h, *(b.column(i).to_numpy(zero_copy_only=False) for b in more)]) for i, h in enumerate(held)]

    for batch in batches:
        more.append(batch)
        if len(more) * batch.num_rows >= CHUNK or len(more) > CHUNK // 64:
            held, more = all_of(), []
            last = (held[0] == held[0][-1]) & (held[1] == held[1][-1]) & (held[2] == held[2][-1])
            cut = int(np.argmax(last))
            if cut:
                yield _candidates([h[:cut] for h in held])
                held = [h[cut:] for h in held]
    held = all_of()
    if len(held[0]):
        yield _candidates(held)


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
    """Edges that connect the similar texts of each group of (root, a, b, row, text)."""

    def links() -> pa.RecordBatch:
        label = similar_components(sets)
        tied = np.flatnonzero(label != np.arange(len(sets)))
        rows = np.array(own, np.int64)
        return pa.RecordBatch.from_arrays([pa.array(rows[tied]), pa.array(rows[label[tied]])], ["a", "b"])

    key, own, sets = None, [], []
    for batch in batches:
        groups = zip(*(batch.column(i).to_pylist() for i in range(3)))
        for group, row, text in zip(groups, batch.column(3).to_pylist(), utf8(batch.column(4))):
            if group != key:
                if len(own) > 1:
                    yield links()
                key, own, sets = group, [], []
            own.append(row)
            sets.append(shingle_set(text))
    if len(own) > 1:
        yield links()


def one_of_each(rows: DataFrame, n_bytes: int) -> DataFrame:
    """(row): one row of each group of near copies among rows(chunk, row, id, text) of numbered(), that with the smallest id.

    Texts are near copies at a Jaccard similarity of SHARED / OF or more on sets of WORDS-word
    shingles, each pair held against each other on whole texts; groups are connected over such pairs.
    Candidates share one of the shingles of `prefix`, which no such pair can avoid, and differ in at
    most RADIUS bits of their SimHash. n_bytes are those of the texts. row is unique and from a stored table. A null id comes after
    all others; equal ids are settled by row. Texts without words are copies of each other.
    """
    spark: SparkSession = rows.sparkSession
    small_batches(spark)
    sets = by_chunk(_sets(rows, _common(rows)), "sets", parts_for(n_bytes, 32 << 20, spark))
    keep = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "row")).alias("keep")
    equal = stored(sets.groupBy("digest").agg(F.min("row").alias("row"), keep), "equal").drop("digest")
    one = sets.join(equal.select(chunk_of("row").alias("chunk"), "row").hint("shuffle_hash"), ["chunk", "row"], "left_semi")
    # large buckets are told from a share of the rows: their shards only decide what a search costs
    keys = sets.select("fp", "n", F.explode("prefix").alias("bucket"))
    some = keys.where(F.pmod(F.xxhash64("fp"), F.lit(COUNTED)) == 0).groupBy("bucket").count().where(F.col("count") > SHARD // COUNTED)
    large = some.select("bucket", F.ceil(F.col("count") * COUNTED / SHARD).cast("long").alias("shards"))
    keys = one.select("fp", "n", F.explode("prefix").alias("bucket"))
    n = sets.agg(F.coalesce(F.sum(F.size("prefix")), F.lit(0))).first()[0]
    dealt = _dealt(keys, "bucket", stored(large, "large"), "fp").select("bucket", "a", "b", "fp", "n")
    dealt = dealt.repartition(parts_for(n, 500_000, spark), "bucket", "a", "b").sortWithinPartitions("bucket", "a", "b")
    roots = connected(dealt.mapInArrow(_linked, "a long, b long")).withColumnRenamed("node", "fp")
    # a root is a node of its own, and so is a fingerprint of several texts
    one = stored(one.select("row", "bytes", "fp"), "one")
    alone = one.groupBy("fp").count().where("count > 1").select("fp", F.col("fp").alias("root"))
    roots = roots.unionByName(roots.select(F.col("root").alias("fp"), "root")).unionByName(alone)
    roots = roots.groupBy("fp").agg(F.min("root").alias("root"))
    asked = stored(one.join(roots, "fp").select("row", "bytes", "root"), "asked")
    size = asked.groupBy("root").agg(F.sum("bytes").alias("bytes")).where(F.col("bytes") > SHARD_BYTES)
    size = size.select("root", F.ceil(F.col("bytes") / SHARD_BYTES).cast("long").alias("shards"))
    # rows stay where they are, what is asked for goes to them
    texts = rows.select("chunk", "row", "text").join(asked.select(chunk_of("row").alias("chunk"), "row", "root").hint("shuffle_hash"), ["chunk", "row"])
    texts = _dealt(texts, "root", stored(size, "size"), "row").select("root", "a", "b", "row", "text")
    n = asked.agg(F.coalesce(F.sum("bytes"), F.lit(0))).first()[0]
    texts = texts.repartition(parts_for(n, 32 << 20, spark), "root", "a", "b").sortWithinPartitions("root", "a", "b")
    same = connected(texts.mapInArrow(_verified, "a long, b long")).withColumnRenamed("node", "row")
    group = equal.join(same, "row", "left").groupBy(F.coalesce("root", "row").alias("root")).agg(F.min("keep").alias("keep"))
    return group.select(F.col("keep.row").alias("row"))
