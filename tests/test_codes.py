"""Codes of whole texts, overlaps in blocks, and anchors of edges, against plain rules."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from cadenza import functions as T
from cadenza import operators as O
from cadenza.operators import matching as M

CUES = "track_id long, pos long, start_ms long, end_ms long, codes array<string>"


def test_phonetic_codes(spark):
    """All words of up to three telling letters, in the midst of a text and at its ends."""
    words = ["".join(x).lower() for n in (1, 2, 3) for x in itertools.product("ABCDFGHKLPQRSTXZ", repeat=n)] + ["straße", "ärger", "cxc", "dcx", "scx", "phph", "12", "aa0", "école", "h"]
    texts = [" ".join(words[i : i + 3]) for i in range(0, len(words), 3)] + [""]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    plain = F.array_remove(F.array_distinct(F.transform(F.split("text", " "), T.cologne)), "")
    assert df.where(T.phonetic_codes(F.col("text")) != plain).count() == 0 and df.count() > 1400


@pytest.mark.parametrize("block, codes", [(M.BLOCK, M.CODES), (16, 3)])
def test_code_pairs(spark, monkeypatch, block, codes):
    """Tracks of one and of many blocks, gaps in time, no codes, no phrases, no cues: the pairs of the band."""
    monkeypatch.setattr(M, "BLOCK", block)
    monkeypatch.setattr(M, "CODES", codes)
    r = random.Random(4)
    some = lambda: r.sample("123456789", r.choice([0, 1, 2, 4]))
    cues, phrases, want = [], [], []
    for track, n, m in ((1, 230, 60), (2, 1, 1), (3, 5, 2), (4, 0, 3), (5, 4, 0)):
        mine, t = [], 0
        for p in range(n):
            t += r.choice([100, 100, 5000])
            mine.append((track, p, t, t + 50, some()))
            t += 50
        said = [(track, k, k * 10, "a bc", some()) for k in range(m)]
        cues, phrases = cues + mine, phrases + said
        radius = max(n // 12, 70)
        for _, k, at, _, c in said:
            expected = round(k / max(m - 1, 1) * max(n - 1, 1))
            for i in range(n):
                for j in range(i, min(i + 3, n)):
                    if any(mine[x + 1][2] - mine[x][3] > 3500 for x in range(i, j)) or i < expected - radius or j > min(n - 1, expected + radius):
                        continue
                    w = set().union(*(mine[x][4] for x in range(i, j + 1)))
                    share = len(w & set(c)) / max(len(w), len(c), 1)
                    if share >= 0.38:
                        want.append((track, k, i, j, share, mine[i][2], at, 2, 4))
    found = M.code_pairs(spark.createDataFrame(phrases, "track_id long, phrase_no long, said_ms long, text string, codes array<string>"), spark.createDataFrame(cues, CUES))
    got = sorted(tuple(x) for x in found.select("track_id", "phrase_no", "first_pos", "last_pos", "similarity", "start_ms", "said_ms", "words", "chars").collect())
    assert got == sorted(want) and len(want) > 1000


def test_chain_in_parts(monkeypatch):
    """Steps worked out a few at a time give the same chains."""
    r = random.Random(6)
    for n in (5, 30, 60):
        rows = sorted((p, f, f + r.randint(0, 2), f * 1000.0, p * 4080.0 + 1500, r.uniform(0.4, 1), r.choice([0.5, 0.7]), 1) for p in range(n) for f in r.sample(range(4 * n), 4))
        of = lambda: M.Matches(*map(list, zip(*rows)), 4 * n, n).chain().tolist()
        whole = of()
        monkeypatch.setattr(M, "STEPS_AT_ONCE", 1)
        assert of() == whole
        monkeypatch.undo()


def test_edges_have_the_codes_of_their_cues(spark):
    """Sets of runs from either end, and phrases with theirs, are the unions of their segments' sets."""
    rows = [(1, p, p * 1000, p * 1000 + 900, f"wort{p} lang genug", [str(p), "x"]) for p in range(9)]
    speech = spark.createDataFrame(rows, "track_id long, pos long, start_ms long, end_ms long, norm_text string, codes array<string>")
    for back in (False, True):
        for e in O.edge_candidates(speech, back, sets="codes").collect():
            numbers = range(e.seg_no, e.last_no + 1)
            assert sorted(e.codes) == sorted({"x", *(str(8 - k if back else k) for k in numbers)})
    assert {(p.phrase_no, tuple(sorted(p.codes))) for p in O.phrases(speech, least=30, sets="codes").collect()} == {(k, (str(k), str(k + 1), "x")) for k in range(8)}
