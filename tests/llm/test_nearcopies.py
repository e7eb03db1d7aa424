"""The pipeline's near-copy stage against brute force over all pairs."""

import random

import numpy as np
import pytest

from cadenza.llm import nearcopies

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def shingles(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute_kept(rows):
    """Sorted (doc_id, text) of what stays: the smallest id of each group linked at 0.8 or more."""
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def top(i):
        return i if root[i] == i else top(root[i])

    for i, x in enumerate(sets):
        for j, y in enumerate(sets[:i]):
            if x == y or 5 * len(x & y) >= 4 * len(x | y) > 0:
                a, b = sorted((top(i), top(j)))
                root[b] = a
    best = {}
    for i, (d, t) in enumerate(rows):
        k = top(i)
        best[k] = min(best.get(k, (True, 0, len(rows))), (d is None, d or 0, i))
    return [rows[i][0] for _, _, i in best.values()]


def planted(n=120, seed=4):
    r = random.Random(seed)
    rows = []
    for g in range(n):
        words = [f"w{r.randrange(5000)}" for _ in range(r.choice([6, 30, 120, 400]))]
        rows.append((1000 * g + 500, " ".join(words)))
        for c in range(r.randrange(4)):
            edited = list(words)
            for _ in range(r.randrange(1, max(2, len(words) // 30))):
                edited[r.randrange(len(edited))] = f"x{r.randrange(5000)}"
            rows.append((r.choice([1000 * g + c, 1000 * g + c, None]), " ".join(edited)))
    rows += [(7, rows[0][1]), (7, rows[0][1]), (None, rows[9][1].upper()), (8, None), (9, ""), (None, " \n")]
    return rows


@pytest.mark.parametrize("shard", [nearcopies.SHARD_BYTES, 700])
def test_near_copies(spark, sf_dir, monkeypatch, shard):
    import corpus_pipeline

    monkeypatch.setattr(nearcopies, "SHARD_BYTES", shard)
    monkeypatch.setattr(nearcopies, "SHARD", 8 if shard == 700 else nearcopies.SHARD)
    rows = planted()
    df = spark.createDataFrame([(d, t, "en", "s", 1) for d, t in rows], COLUMNS)
    got = [r.doc_id for r in corpus_pipeline.simhash_near_dedup(spark, df, sf_dir).collect()]
    assert sorted(got, key=str) == sorted(brute_kept(rows), key=str)
    assert corpus_pipeline.simhash_near_dedup(spark, df.limit(0), sf_dir).count() == 0


def test_near_copies_of_documents(spark, sf_dir):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = [r.doc_id for r in corpus_pipeline.simhash_near_dedup(spark, docs, sf_dir).collect()]
    assert sorted(got) == sorted(brute_kept([(r.doc_id, r.text) for r in docs.collect()]))


def test_similar_components():
    r = np.random.default_rng(2)
    base = r.integers(0, 1 << 60, 300).astype(np.uint64)
    sets = [np.unique(r.choice(base[k * 40 : k * 40 + 60], 50, replace=False)) for k in range(6) for _ in range(8)] + [base[:0], base[:0]]
    label = nearcopies.similar_components(sets)
    want = list(range(len(sets)))
    for _ in sets:
        for i, x in enumerate(sets):
            for j, y in enumerate(sets):
                both = len(np.intersect1d(x, y))
                if both and 5 * both >= 4 * (len(x) + len(y) - both):
                    want[i] = min(want[i], want[j])
    assert label.tolist() == want
