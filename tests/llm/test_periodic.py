"""Periodic runs against a search of every period at every place."""

import hashlib
import random
from zlib import crc32

import numpy as np
import pytest

from cadenza.llm import periodic


def plain_runs(words):
    """All runs by comparing each word with that a period later."""
    n, found = len(words), {}
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j - i + q >= max(6, 4 * q) and j > i:
                found.setdefault((i, j - i + q), q)
            i = j + 1
    return sorted((s, n, q) for (s, n), q in found.items())


def plain_row(doc_id, text):
    words = [w for w in text.encode().replace(b"\t", b" ").replace(b"\n", b" ").split(b" ") if w]
    n, h = len(words), crc32(str(doc_id).encode())
    g = h // 10
    if doc_id is not None and h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = plain_runs(words)
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    best = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=None)
    text = b" ".join(w for i, w in enumerate(words) if i not in gone)
    out = (len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2], hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()).hexdigest())
    return *out, hashlib.sha256(text).hexdigest()


@pytest.mark.parametrize("weak", [False, True])
def test_grid(weak, monkeypatch):
    """All runs of random documents of few words; also where hashes meet by chance all the time."""
    if weak:
        monkeypatch.setattr(periodic, "BASE", 1)
    monkeypatch.setattr(periodic, "PAIRS", 50)
    rng = random.Random(5)
    for _ in range(300):
        docs = []
        for _ in range(rng.randint(1, 4)):
            words = [rng.randint(0, rng.choice([1, 2, 9])) for _ in range(rng.randint(0, 60))]
            if rng.random() < 0.7 and words:
                some = words[: rng.randint(1, len(words))]
                words += (some * 6)[: rng.randint(0, 6 * len(some))] + words[:3]
            docs.append(words)
        flat = np.array([w for d in docs for w in d], np.int64)
        got = periodic.Grid(flat, np.cumsum([0, *map(len, docs)])).runs().tolist()
        assert got == [[i, *r] for i, d in enumerate(docs) for r in plain_runs(d)]


def test_strongest_is_exact():
    big = 10**9
    assert periodic.strongest([(5, 4 * big + 1, big), (1, 4 * big, big)]) == (5, 4 * big + 1, big)
    assert periodic.strongest([(9, 8, 2), (3, 12, 3), (3, 8, 2)]) == (3, 8, 2)
    assert periodic.strongest([]) is None


def test_find_runs(spark):
    rng = random.Random(7)
    texts = ["", None, " \t\n ", "a " * 6, "a a a a a", "Ab ab " * 5, "x y z " * 4 + "x\ty", "é " * 7 + "e", "one\x0btwo " * 4, "a b " * 8]
    texts += [" ".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 200))) for _ in range(60)]
    texts.append(" ".join(rng.choice(["a", "b", "c"]) for _ in range(3_000)))
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, "q r " * 9), (3, "q r " * 9), (3, "q r " * 9)]
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, n_runs int, start string")
    got = periodic.find_runs(docs, plant=True).collect()
    key = lambda r: tuple(str(x) for x in r)
    want = [(i, *plain_row(i, (t or "").replace("\x0b", " "))) for i, t in rows]
    assert sorted((tuple(r[:8]) for r in got), key=key) == sorted(want, key=key)
    assert sum(r.n_runs > 0 for r in got) > 10 and any(crc32(str(i).encode()) % 10 == 0 for i, _ in rows)
    whole = {r.text for r in periodic.find_runs(docs.where("doc_id = 3")).collect()}
    assert whole == {"a", "q r"}
    assert periodic.find_runs(docs.limit(0)).count() == 0
