"""Packing: ids against the tokenizer itself, bins against their sum and plain best fit."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from cadenza.llm import packing

PATH = public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "doc_id long, text string, bin long, fill int, piece int"


@pytest.fixture(scope="module")
def tokenizer():
    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    return t


def odd_texts():
    rng = random.Random(3)
    pieces = ["the", "The", " ", "  ", "\n", "\n\n ", "\t", "it's", "'s", "é", "数", "12", "3.4", "--", "\xa0", " ", "\x1c", "\x85", "<|endoftext|>", "a" * 70, "😀", ",", " a", "\r\n"]
    return ["", " ", "  x", "x  ", "a b", "<|endoftext|>"] + ["".join(rng.choice(pieces) for _ in range(rng.randint(1, 40))) for _ in range(400)]


@pytest.mark.parametrize("memory", [packing.MEMORY, 40])
def test_encoder(tokenizer, monkeypatch, memory):
    """The same ids as of whole texts, whatever stands around a space; also if little is remembered."""
    monkeypatch.setattr(packing, "MEMORY", memory)
    encode = packing.Encoder(tokenizer.to_str())
    texts = odd_texts()
    want = [np.array(tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    assert encode(texts) == want
    assert [encode([t])[0] for t in texts] == want
    assert max(map(len, encode.parts)) <= packing.REMEMBERED


@pytest.mark.parametrize("low,high,start", [(1, 40, "fit"), (20, 60, "fit"), (20, 60, "alone"), (1, 99, "alone"), (34, 70, "alone"), (100, 100, "alone"), (1, 1, "alone")])
def test_search(low, high, start):
    """Nothing is lost, no bin overflows, squares never fall; from single items it gets near best fit."""
    rng = random.Random(low + high)
    lengths = [rng.randint(low, high) for _ in range(600)]
    fit = packing.best_fit(lengths, 100)
    before = fit if start == "fit" else [[i] for i in range(600)]
    squares = lambda bins: sum(sum(lengths[i] for i in b) ** 2 for b in bins)
    after = packing.Search([list(b) for b in before], lengths, 100).run()
    assert sorted(i for b in after for i in b) == list(range(600))
    assert max(sum(lengths[i] for i in b) for b in after) <= 100
    assert squares(after) >= squares(before)
    used, least = sum(map(bool, after)), -(-sum(lengths) // 100)
    assert least <= used <= len(before) and used <= 1.05 * len(fit) + 1
    if low == 20 and start == "fit":
        assert used < len(fit)  # swaps empty bins that best fit leaves


@pytest.mark.parametrize("kind", ["swap", "two for one", "one for two"])
def test_steps(kind):
    """Each kind of step by a case that only it solves."""
    cases = {"swap": ([60, 40], [50, 48], []), "two for one": ([30, 25, 45], [52, 46], [99]), "one for two": ([60, 37], [30, 26, 40], [99])}
    bins = [b for b in cases[kind] if b]
    lengths = [n for b in bins for n in b]
    ends = np.cumsum([len(b) for b in bins]).tolist()
    numbered = [list(range(e - len(b), e)) for b, e in zip(bins, ends)]
    search = packing.Search([list(b) for b in numbered], lengths, 100)
    fills = sum(f * f for f in search.fill)
    a = min(range(len(bins)), key=lambda b: search.fill[b])
    search._unlist(a)
    moved = search._step(a)
    assert not moved or sum(f * f for f in search.fill) > fills
    assert sorted(i for b in search.bins for i in b) == list(range(len(lengths)))


@pytest.mark.parametrize("group", [packing.GROUP, 25])
def test_pack(spark, tokenizer, monkeypatch, group):
    """Pieces, digests and places of odd documents; with small groups underfull bins meet again."""
    monkeypatch.setattr(packing, "GROUP", group)
    rng = random.Random(1)
    texts = odd_texts()[:60] + [" ".join(rng.choice(["lorem", "ipsum", "dolor"]) for _ in range(rng.randint(1, 300))) for _ in range(150)] + ["word " * 5000, "x" * 3000, None]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, "no id"), (3, "same id"), (3, "same id"), (1000, "a" + " b" * 1022), (1001, "a" + " b" * 1023)]
    docs = spark.createDataFrame([(i, t, 1, 2, 3) for i, t in rows], SCHEMA).repartition(5)
    packed = packing.pack(docs, PATH, with_ids=True)
    got = packed.collect()
    want = []
    for i, t in rows:
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids + [2]
        n = len(ids)
        starts = [0, *range(n % 1024 or 1024, n, 1024)]
        for k, a in enumerate(starts):
            b = starts[k + 1] if k + 1 < len(starts) else n
            want.append((i, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())))
    assert sorted((tuple(r[:5]) for r in got), key=str) == sorted(want, key=str)
    bins = {}
    for r in got:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in bins.values():
        parts.sort()
        assert [o for o, _ in parts] == [sum(n for _, n in parts[:k]) for k in range(len(parts))] and sum(n for _, n in parts) <= 1024
    least = -(-sum(r.length for r in got) // 1024)
    assert len(bins) <= least + (1 if group > 1000 else 4)
    made = {r.sequence_id: r for r in packing.sequences(packed).collect()}
    assert {k: r.length for k, r in made.items()} == {k: sum(n for _, n in p) for k, p in bins.items()}
    for r in got:
        ids = bytes(made[r.sequence_id].ids)[4 * r.offset : 4 * (r.offset + r.length)]
        assert zlib.crc32(ids) == r.ids_crc32 and r.offset in made[r.sequence_id].starts


def test_pack_nothing(spark):
    assert packing.pack(spark.createDataFrame([], SCHEMA), PATH).count() == 0
    with pytest.raises(ValueError):
        packing.pack(spark.createDataFrame([], SCHEMA), PATH, size=0)
