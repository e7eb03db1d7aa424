"""Vector matches against every pair of the band."""

import math
import random

import pytest
from pyspark.sql import functions as F

from cadenza.operators import matching as M
from cadenza.operators import vectors
from cadenza.shared import stored


@pytest.mark.parametrize("block", [vectors.BLOCK, 16])
def test_vector_pairs(spark, monkeypatch, block):
    """Tracks of one and of many blocks, gaps in time, null and zero vectors, no phrases, no cues."""
    monkeypatch.setattr(vectors, "BLOCK", block)
    r = random.Random(2)
    vector = lambda: r.choice([None, [0, 0, 0], [r.randint(-9, 9) for _ in range(3)], [r.randint(-9, 9) for _ in range(3)]])
    cues, phrases, want = [], [], []
    for track, n, m in ((1, 260, 90), (2, 1, 1), (3, 5, 2), (4, 0, 3), (5, 4, 0)):
        mine, t = [], 0
        for p in range(n):
            t += r.choice([100, 100, 5000])
            mine.append((track, p, t, t + 50, vector()))
            t += 50
        said = [(track, k, vector()) for k in range(m)]
        cues, phrases = cues + mine, phrases + said
        radius = max(n // 12, 70)
        for _, k, v in said:
            expected = round(k / max(m - 1, 1) * max(n - 1, 1))
            for i in range(n):
                for j in range(i, min(i + 3, n)):
                    if any(mine[x + 1][2] - mine[x][3] > 3500 for x in range(i, j)) or i < expected - radius or j > min(n - 1, expected + radius):
                        continue
                    w = [sum((mine[x][4] or [0, 0, 0])[d] for x in range(i, j + 1)) for d in range(3)]
                    norm = math.sqrt(sum(x * x for x in v or [0])) * math.sqrt(sum(x * x for x in w))
                    cosine = sum(a * b for a, b in zip(v or [0, 0, 0], w)) / norm if norm else 0.0
                    if cosine >= 0.38:
                        want.append((track, k, i, j, min(cosine, 1.0)))
    c = spark.createDataFrame(cues, "track_id long, pos long, start_ms long, end_ms long, vector array<long>")
    p = spark.createDataFrame(phrases, "track_id long, phrase_no long, vector array<long>")
    got = sorted((x.track_id, x.phrase_no, x.first_pos, x.last_pos, x.similarity) for x in vectors.vector_pairs(p, c).collect())
    assert [g[:4] for g in got] == [w[:4] for w in sorted(want)] and all(g[4] == pytest.approx(w[4]) for g, w in zip(got, sorted(want)))


def test_lent_vectors(spark, monkeypatch):
    """Vectors in a table of their own, unknown and null ones too, give the pairs of vectors beside the rows; a vector comes once to a group of tracks."""
    monkeypatch.setattr(vectors, "TRACKS", 2)
    r = random.Random(5)
    some = {k: [r.randint(-9, 9) for _ in range(3)] for k in range(12)} | {3: None, 4: [0, 0, 0]}
    cues = [(t, p, p * 200, p * 200 + 100, r.randrange(14)) for t, n in ((1, 150), (2, 3), (4, 30), (5, 1), (9, 2)) for p in range(n)]
    said = [(t, k, r.choice([None, *range(14)])) for t, n in ((1, 50), (2, 3), (4, 9), (5, 1), (7, 4)) for k in range(n)] + [(9, 0, 13)]
    c = spark.createDataFrame(cues, "track_id long, pos long, start_ms long, end_ms long, vec_id long")
    p = spark.createDataFrame(said, "track_id long, phrase_no long, vec_id long")
    v = spark.createDataFrame(list(some.items()), "vec_id long, vector array<smallint>")
    plain = vectors.vector_pairs(p.join(v, "vec_id", "left").drop("vec_id"), c.join(v, "vec_id", "left").drop("vec_id"))
    kept = []
    found = vectors.lent_pairs(p, c, v, keep=lambda df, name: kept.append(df) or stored(df, name))
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, plain.collect())) and plain.count() > 1000
    assert "vector" not in kept[0].schema.simpleString()  # they don't travel with rows
    want = M.candidates(plain, F.col("similarity"), 0.38, 0.18, 3)
    assert sorted(map(str, vectors.lent_pairs(p, c, v, best=(0.18, 3)).select(want.columns).collect())) == sorted(map(str, want.collect()))
