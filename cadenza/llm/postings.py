"""Nearest neighbours by balanced posting lists whose centroids are searched by a graph."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import parts_for, stored


@dataclass(frozen=True)
class Options:
    """The index is fitted on about train_rows vectors of train_bytes at most, those whose ids' hashes are below a threshold; every vector is in it."""

    train_rows: int = 50_000
    train_bytes: int = 64 << 20
    #: Vectors a posting list holds on average.
    list_rows: int = 256
    #: Lists on the first level; where they grow beyond `shard` vectors each task cuts its own into lists again.
    max_lists: int = 1024
    #: A vector is also in lists whose centroids are so many times as far as its nearest one, up to copies lists.
    replicate: float = 1.1
    copies: int = 4
    #: A query reads the lists whose centroids are so many times as far as its nearest one, of the beam that the
    #: graph keeps; both are widened until so large a share of nearest vectors of the sample would be read.
    probe: float = 1.15
    reach: float = 0.98
    asked: int = 256
    #: The beam holds so many lists, or this share of all of them if that is more.
    beam: int = 64
    beam_share: float = 0.25
    #: Lists are also read until they hold so many vectors.
    least: int = 256
    #: Vectors of one list that one group holds, in bytes; larger lists are dealt into several.
    shard_bytes: int = 16 << 20
    #: Bytes of differences between queries and vectors that are held at a time.
    block_bytes: int = 32 << 20
    links: int = 16
    seed: int = 7


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None] - 2 * a @ b.T, 0)


def balanced_centroids(x: np.ndarray, lists: int, options: Options) -> np.ndarray:
    """Centroids of a k-means that keeps cutting the largest parts until each holds len(x) / lists at most."""
    rng = np.random.default_rng(options.seed)
    most = max(1, -(-len(x) // lists))
    todo, done = [x], []
    while todo:
        part = todo.pop()
        ways = min(16, -(-len(part) // most), len(part))
        if ways < 2:
            done.append(part.mean(0))
            continue
        center = part[rng.choice(len(part), ways, replace=False)]
        for _ in range(8):
            near = squared(part, center).argmin(1)
            n = np.bincount(near, minlength=ways)
            total = np.zeros_like(center)
            np.add.at(total, near, part)
            center = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], center)
        pieces = [part[near == k] for k in range(ways) if n[k]]
        if len(pieces) == 1:  # equal vectors
            done.append(part.mean(0))
        else:
            todo += pieces
    return np.array(done)


def width(lists: int, options: Options) -> int:
    """Centroids that a search's beam holds."""
    return min(lists, max(options.beam, int(lists * options.beam_share)))


def calibrated(x: np.ndarray, centers: np.ndarray, options: Options, k: int = 10) -> tuple[float, int]:
    """(probe, beam) that reach the lists of a share `reach` of the nearest vectors of some of the sample x, by brute force inside of it."""
    rng = np.random.default_rng(options.seed)
    q = x[rng.choice(len(x), min(options.asked, len(x)), replace=False)]
    near = np.concatenate([np.argpartition(squared(q[a : a + 32], x), min(k, len(x) - 1), axis=1)[:, : k + 1] for a in range(0, len(q), 32)])
    gap = np.sqrt(squared(q, centers))
    rank = gap.argsort(1).argsort(1)
    row = np.repeat(np.arange(len(q)), near.shape[1])
    own = np.concatenate([squared(x[near.ravel()[a : a + 4096]], centers).argmin(1) for a in range(0, near.size, 4096)])
    ratio = gap[row, own] / np.maximum(gap.min(1)[row], 1e-300)
    return max(options.probe, float(np.quantile(ratio, options.reach))), max(width(len(centers), options), int(np.quantile(rank[row, own], options.reach)) + 2)


class Graph:
    """Centroids linked to their nearest ones and a few far ones; searched from spread entries, best first."""

    def __init__(self, centroids: np.ndarray, beam: int, options: Options):
        rng = np.random.default_rng(options.seed)
        n = len(centroids)
        self.centroids, self.beam = centroids, min(n, beam)
        k = min(options.links, n - 1)
        near = np.empty((n, k), np.int64)
        for a in range(0, n, 512):
            near[a : a + 512] = np.argsort(squared(centroids[a : a + 512], centroids), axis=1)[:, 1 : k + 1]
        far = rng.integers(0, n, (n, min(4, n)))
        self.links = np.concatenate([near, far], axis=1)
        self.entries = rng.choice(n, min(n, 32), replace=False)

    def search(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(centroids, distances) that the beam ends with for each row of x, nearest first."""
        n, width = len(self.centroids), self.beam
        row = np.arange(len(x))[:, None]
        distance = np.full((len(x), n), np.inf)
        open_ = np.zeros((len(x), n), bool)

        def visit(r: np.ndarray, c: np.ndarray) -> None:
            d = self.centroids[c] - x[r]
            distance[r, c] = np.sqrt(np.einsum("ij,ij->i", d, d))
            open_[r, c] = True

        visit(np.repeat(np.arange(len(x)), len(self.entries)), np.tile(self.entries, len(x)))
        while True:
            best = np.argpartition(distance, width - 1, axis=1)[:, :width]
            todo = open_[row, best] & np.isfinite(distance[row, best])
            if not todo.any():
                break
            r, k = np.nonzero(todo)
            c = best[r, k]
            open_[r, c] = False
            pairs = np.unique(np.repeat(r, self.links.shape[1]) * n + self.links[c].ravel())
            pr, pc = pairs // n, pairs % n
            new = ~np.isfinite(distance[pr, pc])
            visit(pr[new], pc[new])
        order = np.argsort(distance[row, best], axis=1, kind="stable")
        best = best[row, order]
        return best, distance[row, best]


def usable(vector: str):
    """The rows that take part, as a condition: no null, non-finite or all-zero vector."""
    v = F.col(vector)
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    return v.isNotNull() & (F.size(v) > 0) & F.forall(v, finite) & F.exists(v, lambda x: x != 0)


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 10, options: Options = Options(), id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, id, score): the k nearest found of vectors for each of queries, by Euclidean distance in double precision.

    A row is no candidate for the query of its own id. Vectors that are null, all zero, of another
    length than most, or with null or non-finite components take no part, nor do null ids. Ties go
    to the smaller id; repeated rows of an id count once, with their nearest vector. Queries read
    lists until enough candidates are in reach, so fewer than k come back only where fewer exist.
    Other columns are not read; no usable vectors give no rows.
    """
    spark = vectors.sparkSession
    kind, vector = dict(vectors.dtypes)[id_col], dict(vectors.dtypes)[vector_col]
    vector = vector if vector == "array<float>" else "array<double>"
    good = F.col(id_col).isNotNull() & usable(vector_col)
    both = [F.col(id_col).alias("id"), F.col(vector_col).cast(vector).alias("v")]
    rows, asked = vectors.where(good).select(*both), queries.where(good).select(*both)
    sizes = rows.groupBy(F.size("v").alias("w")).count().orderBy(F.desc("count"), "w").limit(1).collect()
    if not sizes:
        return spark.createDataFrame([], f"query_id {kind}, rank int, {id_col} {kind}, score double")
    dims, n = sizes[0]
    rows, asked = rows.where(F.size("v") == dims), asked.where(F.size("v") == dims)

    # ids are chosen by their hashes, so no vector moves but the chosen ones
    most = min(options.train_rows, max(1, options.train_bytes // (8 * dims)))
    picked = rows.where(F.pmod(F.xxhash64("id"), F.lit(n)) < most) if n > most else rows
    sample = picked.select("v").toArrow()["v"].combine_chunks()
    x = np.unique(np.asarray(sample.flatten(), float).reshape(-1, dims), axis=0)
    if not len(x):
        x = np.asarray(rows.limit(1).toArrow()["v"].combine_chunks().flatten(), float).reshape(-1, dims)
    lists = int(min(options.max_lists, max(1, n // options.list_rows)))
    shard_rows = max(1, options.shard_bytes // (8 * dims))
    centers = balanced_centroids(x, lists, options)
    probe, beam = calibrated(x, centers, options, k)
    centroids = spark.sparkContext.broadcast(centers)

    def assigned(ratio: float, copies: int):
        """Rows (id, v) to rows (list, near, id, v): the lists within ratio, nearest first."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
            graph = Graph(centroids.value, beam, options)
            for batch in batches:
                values = batch.column(1)
                points = np.asarray(values.flatten(), float).reshape(-1, dims)
                best, distance = graph.search(points)
                take = (distance <= distance[:, :1] * ratio) & np.isfinite(distance)
                take[:, copies:] = False
                r, c = np.nonzero(take)
                index = pa.array(r)
                yield pa.RecordBatch.from_arrays([pa.array(best[r, c]), pa.array(c, pa.int32()), batch.column(0).take(index), values.take(index)], ["list", "near", "id", "v"])

        return run

    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "256")
    out = f"list long, near int, id {kind}, v {vector}"
    postings = stored(rows.mapInArrow(assigned(options.replicate, options.copies), out), "postings")
    counts = stored(postings.groupBy("list").agg(F.count(F.lit(1)).alias("n")), "lists")  # at most max_lists rows
    counts = counts.withColumn("shards", F.ceil(F.col("n") / shard_rows).cast("long"))
    probes = stored(asked.mapInArrow(assigned(float("inf"), beam), out), "probes")
    probes = probes.join(F.broadcast(counts), "list")
    so_far = Window.partitionBy("id", "v").orderBy("near").rowsBetween(Window.unboundedPreceding, -1)
    center = spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centroids.value)], "list long, c array<double>")
    gap = F.sqrt(F.aggregate(F.zip_with(F.col("v").cast("array<double>"), "c", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, y: s + y))
    probes = probes.join(F.broadcast(center), "list").withColumn("gap", gap).drop("c")
    probes = probes.withColumn("held", F.coalesce(F.sum("n").over(so_far), F.lit(0))).withColumn("least", F.min("gap").over(Window.partitionBy("id", "v")))
    probes = probes.where((F.col("gap") <= F.col("least") * probe) | (F.col("held") < options.least + 2 * k))

    shard = F.pmod(F.xxhash64("id"), F.col("shards"))
    left = postings.join(F.broadcast(counts), "list").select("list", shard.alias("shard"), F.lit(False).alias("asks"), "id", "v")
    right = probes.select("list", F.explode(F.sequence(F.lit(0).cast("long"), F.col("shards") - 1)).alias("shard"), F.lit(True).alias("asks"), "id", "v")
    return ranked(left.unionByName(right), k, kind, n, dims, id_col, options)


def best_of(ids: np.ndarray, points: np.ndarray, own: np.ndarray, asked: np.ndarray, k: int, options: Options) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query number, id, score) of the k nearest of points, which are in order of ids, for each asked vector but its own id's."""
    if not len(points) or not len(asked):
        return np.empty(0, np.int64), ids[:0], np.empty(0)
    step = max(1, options.block_bytes // (8 * len(points)))
    most = (points * points).sum(1).max()
    found = []
    for a in range(0, len(asked), step):
        q = asked[a : a + step]
        rough = squared(q, points)
        rough[own[a : a + step][:, None] == ids[None]] = np.inf
        last = np.partition(rough, min(k, len(points)) - 1, axis=1)[:, min(k, len(points)) - 1]
        # products round off: all that may be among the nearest are measured exactly
        r, c = np.nonzero((rough <= (last + 1e-9 * ((q * q).sum(1) + most))[:, None]) & np.isfinite(rough))
        score = np.empty(len(r))
        width = max(1, options.block_bytes // (8 * points.shape[1]))
        for b in range(0, len(r), width):
            d = q[r[b : b + width]] - points[c[b : b + width]]
            score[b : b + width] = np.sqrt(np.einsum("ij,ij->i", d, d))
        order = np.lexsort((c, score, r))  # ties: smaller ids come first
        r, c, score = r[order], c[order], score[order]
        fine = np.arange(len(r)) - np.searchsorted(r, r) < k
        found.append((r[fine] + a, ids[c[fine]], score[fine]))
    return tuple(np.concatenate(c) for c in zip(*found))


def inside(ids: np.ndarray, points: np.ndarray, own: np.ndarray, asked: np.ndarray, k: int, options: Options) -> Iterator[tuple]:
    """best_of() in one group: a group of many vectors is cut into lists again, of which a query reads the near ones."""
    order = np.argsort(ids, kind="stable")
    ids, points = ids[order], points[order]
    if len(points) < 16 * options.list_rows or len(asked) * 4 < len(points) // options.list_rows:
        yield own, *best_of(ids, points, own, asked, k, options)
        return
    centers = balanced_centroids(np.unique(points[:: max(1, len(points) // (options.list_rows * 64))], axis=0), len(points) // options.list_rows, options)
    probe, beam = calibrated(points[:: max(1, len(points) // 20_000)], centers, options, k)
    at = np.concatenate([np.argpartition(squared(points[a : a + 4096], centers), min(1, len(centers) - 1), axis=1)[:, :2] for a in range(0, len(points), 4096)])
    gap = np.sqrt(squared(asked, centers))
    near = np.argsort(gap, axis=1, kind="stable")
    size = np.bincount(at.ravel(), minlength=len(centers))
    held = np.cumsum(size[near], axis=1) - size[near]
    reads = (np.take_along_axis(gap, near, 1) <= gap.min(1, keepdims=True) * probe) | (held < 2 * (options.least + 2 * k))
    reads[:, beam:] &= held[:, beam:] < 2 * (options.least + 2 * k)
    q, c = np.nonzero(reads)
    c = near[q, c]
    for one in range(len(centers)):
        mine, members = q[c == one], np.flatnonzero((at == one).any(1))
        yield own[mine], *best_of(ids[members], points[members], own[mine], asked[mine], k, options)


def ranked(rows: DataFrame, k: int, kind: str, n: int, dims: int, id_col: str, options: Options) -> DataFrame:
    """The k nearest of each query inside every (list, shard), then over all of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        held = None
        for batch in _with_end(batches):
            if batch is not None:
                new = (np.stack([batch.column(0).to_numpy(), batch.column(1).to_numpy()], 1), batch.column(2).to_numpy(zero_copy_only=False), batch.column(3).to_numpy(zero_copy_only=False), np.asarray(batch.column(4).flatten(), float).reshape(-1, dims))
                held = new if held is None else tuple(np.concatenate(x) for x in zip(held, new))
            if held is None or not len(held[0]):
                continue
            edges = np.flatnonzero((held[0][1:] != held[0][:-1]).any(1)) + 1
            cuts = [0, *edges, *([len(held[0])] if batch is None else [])]
            for a, b in zip(cuts, cuts[1:]):
                asks, ids, points = held[1][a:b], held[2][a:b], held[3][a:b]
                for own, q, i, s in inside(ids[~asks], points[~asks], ids[asks], points[asks], k, options):
                    yield pa.RecordBatch.from_arrays([pa.array(own[q]), pa.array(i), pa.array(s)], ["query_id", id_col, "score"])
            held = tuple(x[cuts[-1] :] for x in held)

    parts = parts_for(n * dims, 8_000_000, rows.sparkSession)
    groups = rows.repartition(parts, "list", "shard").sortWithinPartitions("list", "shard")
    found = groups.select("list", "shard", "asks", "id", "v").mapInArrow(run, f"query_id {kind}, {id_col} {kind}, score double")
    found = found.groupBy("query_id", id_col).agg(F.min("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", id_col))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int"), id_col, "score")


def _with_end(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    yield from batches
    yield None
