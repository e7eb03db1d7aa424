"""Collocations against counts and cuts in plain Python."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from cadenza.llm import collocations as C

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "text string, lang string, phrase string, n long, rank int"


def plain(rows, most, least, inside, top):
    """Every gram counted, every cut scored."""
    grams, total = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            words = [w for w in re.split(r"[\x20\x09]+", piece) if w]
            total[lang] += len(words)
            for k in range(1, most + 1):
                for i in range(len(words) - k + 1):
                    grams[lang, tuple(words[i : i + k])] += 1
    cands = {g: a for g, a in grams.items() if len(g[1]) > 1 and a >= least}
    out = {}
    for (lang, w), a in cands.items():
        longer = (b for (m, v), b in cands.items() if m == lang and len(v) > len(w) and any(v[i : i + len(w)] == w for i in range(len(v))))
        if any(100 * b >= inside * a for b in longer):
            continue
        cuts = [(10**6 * a * a // (grams[lang, w[:k]] * grams[lang, w[k:]]), k) for k in range(1, len(w))]
        score, k = min(cuts)
        out.setdefault(lang, []).append((-score, -a, " ".join(w).encode(), grams[lang, w[:k]], grams[lang, w[k:]]))
    return sorted((lang, i + 1, p.decode(), -a, l, r, total[lang], -s) for lang, found in out.items() for i, (s, a, p, l, r) in enumerate(sorted(found)[:top]))


def rows_of(seed):
    rng = random.Random(seed)
    words = ["New", "york", "CITY", "a", "b", "é", "10", "x\x0b", "in\tthe", "\xa0z"]
    text = lambda: "".join(rng.choice(words) + rng.choice([" ", " ", " ", "  ", ", ", ".", "\n", "\r"]) for _ in range(rng.randint(0, 80)))
    rows = [(text(), rng.choice(["en", "de", None, "und"])) for _ in range(80)]
    return rows + [(None, "en"), ("", "en"), (" .. ", None), ("new york city " * 400, "fr"), ("the end of it. " * 3000, "en"), ("one two", "it")] + [("same row here", "en")] * 12


@pytest.mark.parametrize("most,least,inside,top,bits", [(3, 10, 50, 2000, 1 << 28), (4, 3, 80, 15, 1 << 28), (2, 10, 50, 2000, 1 << 16), (3, 10, 50, 2000, 8)])
def test_collocations(spark, monkeypatch, most, least, inside, top, bits):
    """Levels of up to four words; with a filter of eight bits, which lets nearly all pass, too."""
    monkeypatch.setattr(C, "MOST_BITS", bits)
    monkeypatch.setattr(C, "WORDS", 700)
    rows = rows_of(most)
    docs = spark.createDataFrame([(t, g, "p", 1, 2) for t, g in rows], SCHEMA)
    got = C.collocations(docs, most, least, inside, top).collect()
    assert sorted(tuple(r) for r in got) == plain(rows, most, least, inside, top)
    assert len(got) > 5


def test_nothing(spark):
    docs = spark.createDataFrame([], SCHEMA)
    assert C.collocations(docs).count() == 0
    assert C.collocations(spark.createDataFrame([("a b c", "en", "", 1, 1)], SCHEMA)).count() == 0


def test_filter_has_all(spark):
    level = spark.createDataFrame([("en", f"w{i} v{i % 7}") for i in range(3000)], "lang string, phrase string")
    known = C.Frequent(C.frequent_bits(level, 3000))
    h = lambda *w: C._extend(np.array([C._word_hash(b"en", w[0])], np.uint64), np.array([C._word_hash(b"en", w[1])], np.uint64))
    assert all(known.has(h(b"w%d" % i, b"v%d" % (i % 7)))[0] for i in range(3000))
    assert sum(known.has(h(b"w%d" % i, b"u"))[0] for i in range(3000)) < 120
    big = spark.createDataFrame([("en", "x y", 10**12), ("en", "z", 1)], "lang string, phrase string, n long")
    words = spark.createDataFrame([("en", "x", 10**13), ("en", "y", 10**12)], "lang string, phrase string, n long")
    total = spark.createDataFrame([("en", 10**14)], "lang string, n long")
    row = C._ranked([words, big.where("phrase <> 'z'")], total, 50, 10).first()
    assert row.score == 10**6 * 10**24 // (10**13 * 10**12)
