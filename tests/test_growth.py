"""Steps whose cost must not outgrow their input: counts without pairs, one sort, each value worked out once."""

import contextlib
import io
import random

import numpy as np
from pyspark.sql import functions as F

from cadenza import operators as O
from cadenza.functions import payloads
from cadenza.operators import blocks, sync, translation
from cadenza.operators import matching as M
from cadenza.shared import dealt, stored
from cadenza.sources import settings


def plan(df) -> str:
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain()
    return out.getvalue()


def test_band_counts(spark):
    """The counts are those of the pairs, on short and long tracks with gaps."""
    r, cues, phrases = random.Random(5), [], []
    for track, n, m in ((1, 400, 90), (2, 1, 1), (3, 5, 7), (4, 2, 1), (5, 160, 200)):
        t = 0
        for p in range(n):
            t += r.choice([100, 100, 5000])
            cues.append((track, p, t, t + 50, "a"))
            t += 50
        phrases += [(track, k) for k in range(m)]
    c = spark.createDataFrame(cues, "track_id long, pos long, start_ms long, end_ms long, norm_text string")
    p = spark.createDataFrame(phrases, "track_id long, phrase_no long")
    w = O.sliding_windows(c)
    pairs = O.position_band(p, w, c).groupBy("track_id", "phrase_no").agg(F.count(F.lit(1)).alias("windows"), F.min("first_pos").alias("low"), F.max("last_pos").alias("high"))
    got = sorted(map(tuple, O.band_counts(p, w, c).select("track_id", "phrase_no", "windows", "low", "high").collect()))
    assert got == sorted(map(tuple, pairs.collect())) and len(got) == len(phrases)


def test_segments_by_one_sort(spark):
    """Cues meet their segments in one order: before the first, between, at ends, and after the last."""
    segments = spark.createDataFrame([(1, 1, 0, 10, 1.0, 0.0), (1, 2, 10, 20, 2.0, 0.0), (1, 3, 20, 30, 3.0, 0.0), (2, 1, 5, 6, 9.0, 0.0)], "track_id long, seg int, from_ms long, to_ms long, scale double, offset_ms double")
    cues = spark.createDataFrame([(1, p, t) for p, t in enumerate((0, 10, 11, 30, 31, 99))] + [(2, 0, 7), (3, 0, 1)], "track_id long, pos long, start_ms long")
    found = O.segment_of(cues, segments)
    assert sorted((x.track_id, x.pos, x.seg) for x in found.where("seg is not null").collect()) == [(1, 0, 1), (1, 1, 1), (1, 2, 2), (1, 3, 3), (1, 4, 3), (1, 5, 3), (2, 0, 1)]
    assert plan(found).count("Sort [") == 1


def test_settings_once(spark):
    """A settings text is parsed once, and a list of keys is read once however many keys it has."""
    files = spark.createDataFrame([(1, '{"provider_keys":{"DeepL":["a",{"value":"b","active":1,"vpn_config":"v"},{"value":"c","vpn_config":"v"}]}}')], "id long, settings string")
    found = settings.read_provider_settings(files)
    r = found.first()
    assert [(k.value, k.active, k.vpn_config) for k in r.provider_keys["DeepL"]] == [("a", False, None), ("b", True, "v"), ("c", False, "v")] and r.shared == ["v"]
    optimized = found._jdf.queryExecution().optimizedPlan().toString()
    assert optimized.count("provider_keys.DeepL") == 2  # the kind of the list, and its items


def test_answers_in_place(spark):
    """Answers are read without a shuffle: each row by itself, texts of one index joined, an index out of range or no text at all aside."""
    some = ['["a", "b"]', '[{"index": 1, "text": "y"}, {"index": "0", "content": "x"}, {"index": "1", "content": "z"}]', "[]", None, '{"data": [{"q": "p"}, "r", {"index": 9, "text": "s"}]}', '["a", null]', '["a", 5]', '["a"]', "7"]
    found = payloads.payload_texts(spark.createDataFrame([(i, 2, x) for i, x in enumerate(some)], "id long, n int, payload string"))
    got = {r.id: (r.valid, r.texts) for r in found.collect()}
    assert got == {0: (True, ["a", "b"]), 1: (True, ["x", "y\nz"]), 4: (True, ["p", "r"])} | {k: (False, None) for k in (2, 3, 5, 6, 7, 8)}
    assert "Exchange" not in plan(found)


def test_translation_is_stored_twice(spark, tmp_path, monkeypatch):
    """Texts are written as batches and as what each service made of them, the second one's only where the first failed; lines come back without a join."""
    kept = []
    monkeypatch.setattr(translation, "stored", lambda df, name: kept.append((name, (out := stored(df, name)).count())) or out)
    lines = spark.createDataFrame([(t, 2 * k + j, x) for t in range(30) for k in range(7) for j, x in enumerate((f"{t} x{k}", ""))], "track_id long, line_no long, line string")
    out, found = translation.translate(lines, [("some", lambda texts: "[]" if len(texts) == 1 else str(texts).replace("'", '"')), ("all", lambda texts: str(texts).replace("'", '"'))], most=2)
    assert kept == [("batches", 120), ("translated", 120), ("translated", 30)]
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, lines.collect())) and "Join" not in plan(out)


def test_tracks_stay_where_they_are(spark):
    """Matches, anchors and new times of cues that are dealt out by track shuffle nothing."""
    rows = [(t, p, p * 3000, p * 3000 + 2000, f"wort{p % 7}a lang{t} genug{p}", [str(p % 7), str(t), str(p)]) for t in range(40) for p in range(30)]
    df = spark.createDataFrame(rows, "track_id long, pos long, start_ms long, end_ms long, norm_text string, codes array<string>")
    cues = dealt(df.repartition(8, "track_id"), "cues", "track_id", 8)
    speech = O.transcript(cues, "codes")
    found = sync.anchors(cues, speech)
    assert "Exchange" not in plan(found) and "Exchange" not in plan(sync.matches(cues, speech))
    kept = dealt(found, "anchors", "track_id", 8)
    moved = O.retimed(cues, kept)
    assert "Exchange" not in plan(moved)
    loose = O.transcript(df, "codes")
    got, want = (sorted(map(tuple, x.collect())) for x in (moved, O.retimed(df, sync.anchors(df, loose))))
    assert got == want and len(got) > 900


def test_best_pairs_in_place(spark):
    """Pairs picked as they are found, in pieces too, are those that candidates() picks of all."""
    r, cues, said = random.Random(8), [], []
    some = lambda: r.sample("123456", r.choice([0, 1, 2, 3]))
    for track, n, m in ((1, 300, 80), (2, 40, 30), (3, 1, 1)):
        cues += [(track, p, p * 1000, p * 1000 + 900, some()) for p in range(n)]
        said += [(track, k, k, "a b", some()) for k in range(m)]
    c = spark.createDataFrame(cues, "track_id long, pos long, start_ms long, end_ms long, codes array<string>")
    p = spark.createDataFrame(said, "track_id long, phrase_no long, said_ms long, text string, codes array<string>")
    pairs = M.code_pairs(p, c)
    want = M.candidates(pairs, F.col("similarity"), 0.38, 0.18, 3)
    found = M.code_pairs(p, c, best=(0.18, 3))
    assert sorted(map(str, found.select(want.columns).collect())) == sorted(map(str, want.collect())) and want.count() > 200
    # picking again from what was picked before and what came later changes nothing
    rows = np.array([[i % 5, r.randrange(90), 0, r.choice([0.4, 0.5, 0.9])] for i in range(400)])
    x, first, similarity = rows[:, 0].astype(int), rows[:, 1].astype(int), rows[:, 3]
    best = lambda at: at[blocks.best_of(x[at], first[at], first[at] + 1, similarity[at], np.full(len(at), 40), np.full(len(at), 70), 0.18, 8)[0]]
    parted = best(np.arange(150))
    for low in (150, 290):
        parted = best(np.concatenate([parted, np.arange(low, {150: 290, 290: 400}[low])]))
    key = lambda at: [(x[i], first[i], similarity[i]) for i in at]
    assert key(parted) == key(best(np.arange(400)))
