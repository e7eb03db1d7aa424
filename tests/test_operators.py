"""Timed-text operators against plain versions and by example."""

import random

import pytest
from pyspark.sql import functions as F

from cadenza import operators as O
from cadenza import sources, streaming
from cadenza.functions import payloads
from cadenza.operators import matching as M
from cadenza.operators import sync


def step(a, b, cues, phrases):
    """What going from match a to match b costs, said plainly."""
    cue, said = b["start_ms"] - a["start_ms"], b["said_ms"] - a["said_ms"]
    if cue <= 0 or said <= 0:
        return 1e6
    gap, cue_gap = max(b["phrase_no"] - a["phrase_no"] - 1, 0), max(b["first_pos"] - a["last_pos"] - 1, 0)
    if gap <= 1 and b["similarity"] >= 0.69 and b["score"] >= 0.68:
        t = (0.08, 0.55, 0.20, 0.45, 2.40, 0.45, 18, 0.004)
    elif a["similarity"] >= 0.74 and b["similarity"] >= 0.74:
        t = (0.05, 0.85, 0.35, 1.40, 2.10, 0.80, 14, 0.008)
    else:
        t = (0.03, 1.40, 0.45, 2.40, 1.90, 1.10, 10, 0.015)
    apart = abs(cue_gap / max(cues - 1, 1) - gap / max(phrases - 1, 1))
    return max(0, apart - t[0]) * t[1] + max(0, t[2] - said / cue) * t[3] + max(0, said / cue - t[4]) * t[5] + max(0, cue_gap - max(gap * 9, t[6])) * t[7]


def value(path, cues, phrases):
    off = lambda m: max(0, abs(m["first_pos"] / max(cues - 1, 1) - m["phrase_no"] / max(phrases - 1, 1)) - 0.12) * 0.35
    total = sum(m["score"] + min(max(m["similarity"] - 0.68, 0) * 0.9, 0.08) for m in path) - off(path[0]) - off(path[-1])
    total -= 0.22 * (path[0]["phrase_no"] + phrases - path[-1]["phrase_no"] - 1)
    return total - sum(step(a, b, cues, phrases) + 0.22 * (b["phrase_no"] - a["phrase_no"] - 1) for a, b in zip(path, path[1:]))


def every_path(matches):
    """All chains that move on in phrases and cues."""
    def after(path):
        yield path
        for m in matches:
            if m["phrase_no"] > path[-1]["phrase_no"] and m["first_pos"] > path[-1]["last_pos"]:
                yield from after([*path, m])

    for m in matches:
        yield from after([m])


def as_matches(rows, cues, phrases):
    names = ("phrase_no", "first_pos", "last_pos", "start_ms", "said_ms", "similarity", "score", "place")
    return M.Matches(*[[r[n] for r in rows] for n in names], cues, phrases)


@pytest.mark.parametrize("seed", range(12))
def test_chain(seed):
    r = random.Random(seed)
    rows = []
    for p in range(7):
        for k in range(r.randint(0, 3)):
            first = max(0, p * 4 + r.randint(-6, 6))
            rows.append({"phrase_no": p, "first_pos": first, "last_pos": first + r.randint(0, 2), "start_ms": first * 1000.0, "said_ms": p * 4080.0 + 1500, "similarity": r.uniform(0.4, 1), "score": r.uniform(0.2, 0.9), "place": k + 1})
    m = as_matches(rows, 30, 7)
    got = [dict(phrase_no=int(m.phrase[i]), first_pos=int(m.first[i]), last_pos=int(m.last[i]), start_ms=m.cue[i], said_ms=m.said[i], similarity=m.similarity[i], score=m.score[i]) for i in m.chain()]
    best = max(every_path(rows), key=lambda p: value(p, 30, 7), default=[])
    if len(best) >= 4:
        assert value(got, 30, 7) == pytest.approx(value(best, 30, 7)) and all(a["first_pos"] > b["last_pos"] for a, b in zip(got[1:], got))
    else:
        assert not got


def test_rerank_thin_prune():
    row = lambda p, first, s, score, place=1: {"phrase_no": p, "first_pos": first, "last_pos": first, "start_ms": first * 1000.0, "said_ms": first * 1020.0, "similarity": s, "score": score, "place": place}
    rows = [row(p, p * 2, 0.9, 0.9) for p in range(5)] + [row(5, 11, 0.5, 0.40), row(5, 60, 0.5, 0.45, 2)] + [row(p, p * 2, 0.9, 0.9) for p in range(6, 9)]
    m = as_matches(rows, 70, 9)
    new = m.reranked({p: 9 for p in range(9)}, {p: 60 for p in range(9)})
    raised = {(int(p), int(f)): s for p, f, s in zip(new.phrase, new.first, new.score)}
    assert raised[5, 11] == pytest.approx(0.40 + (1 - 1 / 18) * 0.18) and raised[5, 60] == 0.45 and raised[4, 8] == 0.9
    # an anchor out of order goes, the ends stay
    import numpy as np

    wrong = as_matches([row(p, p * 2, 0.9, 0.9) | ({"said_ms": 1.0, "similarity": 0.5} if p == 3 else {}) for p in range(8)], 20, 8)
    assert wrong.phrase[M.pruned(wrong, np.arange(8))].tolist() == [0, 1, 2, 4, 5, 6, 7]
    long = as_matches([row(p, p * 2, 0.9 if p == 17 else 0.5, 0.5) for p in range(30)], 60, 30)
    assert long.phrase[M.thinned(long, np.arange(30))].tolist() == [0, 1, 2, 3, 4, 5, 6, 7, 9, 12, 15, 17, 18, 21, 24, 27, 29]


def plain_pruned(anchors):
    """Pruning said plainly; anchors are (cue, said, similarity) by cue time."""
    def fine(a, b):
        return b[0] > a[0] and b[1] > a[1] and 0.35 <= (b[1] - a[1]) / (b[0] - a[0]) <= 2.5

    while len(anchors) > 4:
        bad = [i for i in range(len(anchors) - 1) if not fine(anchors[i], anchors[i + 1])]
        if not bad:
            break
        keys = {}
        for i in (bad[0], bad[0] + 1):
            if 0 < i < len(anchors) - 1:
                left = anchors[:i] + anchors[i + 1 :]
                local = all(fine(left[k], left[k + 1]) for k in range(max(i - 1, 0), min(i + 1, len(left) - 1)))
                keys[i] = (local, i not in (1, len(anchors) - 2), -anchors[i][2])
        if not keys:
            break
        go = max(keys, key=lambda i: (keys[i], -i))
        anchors = anchors[:go] + anchors[go + 1 :]
    return anchors


def random_anchors(r, n):
    cue = sorted(r.sample(range(1000), n))
    return [(c * 1000.0, c * 1000.0 * r.choice([1, 1, 1, 1.02]) + r.choice([0, 0, 0, r.uniform(-60_000, 60_000)]), r.choice([0.5, 0.6, 0.7, 0.9])) for c in cue]


def test_prune_thin_plain():
    """Thousands of random tracks: pruned and thinned anchors are those of the plain rule."""
    import numpy as np

    r, cut = random.Random(8), 0
    for k in range(3000):
        a = random_anchors(r, r.randint(2, 13) if k % 2 else r.randint(12, 40))
        m = as_matches([{"phrase_no": i, "first_pos": i * 2, "last_pos": i * 2, "start_ms": c, "said_ms": s, "similarity": q, "score": q, "place": 1} for i, (c, s, q) in enumerate(a)], 99, len(a))
        rows = lambda keep: [(m.cue[i], m.said[i], m.similarity[i]) for i in keep]
        want = plain_pruned(a)
        assert rows(M.pruned(m, np.arange(len(a)))) == want
        cut += len(want) < len(a)
        n, stride = len(a), max(len(a) // 9, 1)
        chosen = a if n <= 10 else [a[i] for i in sorted({0, n - 1, *range(stride, n - 1, stride)} | {i for i in range(n) if i < 8 or a[i][2] >= 0.8})]
        thin = plain_pruned(chosen)
        steady = len(thin) >= 2 and all(y[0] > x[0] and y[1] > x[1] and 0.35 <= (y[1] - x[1]) / (y[0] - x[0]) <= 2.5 for x, y in zip(thin, thin[1:]))
        thin = thin if steady else want
        assert rows(M.thinned(m, np.arange(n))) == (thin if len(thin) >= 4 else [])
    assert cut > 500


def test_retimed(spark):
    """Times between, before, and after anchors; ends never before starts, nothing before 0, halves to even."""
    anchors = spark.createDataFrame([(1, 0, 1000, 500), (1, 1, 2000, 1000), (1, 2, 3000, 3000), (2, 0, 5, 5)], "track_id long, pos long, cue_ms long, said_ms long")
    cues = spark.createDataFrame([(1, 0, 0, 1), (1, 1, 1001, 1003), (1, 2, 1500, 2500), (1, 3, 2000, 2000), (1, 4, 9000, 9001), (1, 5, 2900, 400), (2, 0, 1, 2), (3, 0, 1, 2)], "track_id long, pos long, start_ms long, end_ms long")
    got = {(x.track_id, x.pos): (x.new_start_ms, x.new_end_ms) for x in O.retimed(cues, anchors).collect()}
    assert got == {(1, 0): (0, 0), (1, 1): (500, 502), (1, 2): (750, 2000), (1, 3): (1000, 1000), (1, 4): (15000, 15002), (1, 5): (2800, 2800)}


def test_anchors_of_a_track(spark):
    """A track whose speech is 2 % slower and 1.5 s late gets anchors that say so."""
    r = random.Random(3)
    cues = spark.createDataFrame([(1, p, p * 3000, p * 3000 + 2000, " ".join(f"wort{r.choice('bdfgklmnprs')}{r.choice('bdfgklmnprs')}{r.choice('bdfgklmnprs')}a" for _ in range(5))) for p in range(60)], "track_id long, pos long, start_ms long, end_ms long, norm_text string")
    codes = M.word_codes(cues.select(F.col("norm_text").alias("text")))
    counts = M.code_counts(cues, codes)
    windows = O.sliding_windows(M.code_sets(cues, codes, ["track_id", "pos"], "norm_text", counts), sets="codes").withColumnRenamed("codes", "window_codes")
    phrases = M.code_sets(O.phrases(O.transcript(cues)), codes, ["track_id", "phrase_no"], "text", counts)
    same = M.overlap(F.col("codes"), F.col("window_codes"))
    whole = M.candidates(O.position_band(phrases, windows, cues), same)
    found = M.candidates(M.similar_pairs(phrases, windows, cues), same)
    plain = [c for c in whole.columns if c != "window_codes"]
    assert sorted(map(str, found.select(plain).collect())) == sorted(map(str, whole.select(plain).collect())) and found.first().phrases == phrases.count()
    got = M.align(found).orderBy("pos").collect()
    moved = sync.synced(cues, O.transcript(cues)).collect()
    assert len(moved) == 60 and all(abs(m.new_start_ms - (m.start_ms * 1.02 + 1500)) <= 2 and abs(m.new_end_ms - (m.end_ms * 1.02 + 1500)) <= 2 for m in moved)
    assert sync.anchors(cues, O.transcript(cues), sync.SyncOptions(phrases=100)).count() == 0
    assert len(got) >= 4 and all(abs(g.said_ms - (g.cue_ms * 1.02 + 1500)) <= 1 for g in got)


def test_ass(spark):
    lines = ["[V4+ Styles]", "Style: Default,Arial", "[Events]", "Comment: 1,Sign,x", "Format: Layer, Style, Text", "Dialogue: 0,Default,{\\i1}a, b{}", "Dialogue: 0,Sign,c", "Comment:  0, Default ,d", "Dialogue: 0,Default,{\\p1}m 0", "Dialogue: 0", "[Fonts]", "Dialogue: 0,Sign,e"]
    df = spark.createDataFrame([(1, i, x) for i, x in enumerate(lines)] + [(2, 0, "[Events]")], "track_id long, line_no int, line string")
    got = [r.line for r in O.ass_lines(df).orderBy("line_no").collect()]
    assert got == [*lines[:5], "Dialogue: 0,Default,a, b{}", "Comment:  0, Default ,d", "Dialogue: 0", "[Fonts]", "Dialogue: 0,Sign,e"]


def test_encodings(spark, tmp_path):
    text = "1\n00:00:01,000 --> 00:00:02,000\ncafé {}\n"
    for name, code, mark in (("a", "utf-8", "€"), ("b", "utf-8-sig", "€"), ("c", "cp1252", "€"), ("d", "latin-1", "\x81")):
        (tmp_path / f"{name}.srt").write_bytes(text.format(mark).encode(code))
    got = {r.path[-5]: r.raw_text for r in sources.read_srt(spark, str(tmp_path)).collect()}
    assert got == {"a": "café €", "b": "café €", "c": "café €", "d": "café \x81"}


def test_payload_texts(spark):
    some = ['[{"index":"1","content":"b"},{"index":0,"text":"a"},{"index":"0","content":"c"}]', '{"data":3,"result":["x","y"]}', '[{"index":" 1 ","only":"q"}]', '[{"z":"only"},{"index":"no","content":"place"}]', "[1,2]", '["a"]', "not json", '{"items":{}}', '[{"content":5},{"translation":"t"}]']
    df = spark.createDataFrame([(i, 2, x) for i, x in enumerate(some)], "id long, n int, payload string")
    got = {r.id: (r.valid, r.texts) for r in payloads.payload_texts(df).collect()}
    assert got == {0: (True, ["a\nc", "b"]), 1: (True, ["x", "y"]), 2: (False, None), 3: (True, ["only", "place"]), 4: (False, None), 5: (False, None), 6: (False, None), 7: (False, None), 8: (True, ["5", "t"])}


def test_json_repair(spark):
    import json

    text = '```JSON\nSure:\n[{"a\\"":"x\n\ty\x01 \\\\"},\n "z"] done\n```'
    got = spark.createDataFrame([(text,), (None,), ('"open\n',)], "t string").select(payloads.escape_controls(payloads.json_slice(F.col("t")))).collect()
    assert json.loads(got[0][0]) == [{'a"': "x\n\ty\x01 \\"}, "z"] and got[1][0] == "" and got[2][0] == '"open'


def test_job_stream(spark, tmp_path):
    rows = [(1, "pending", "2024-01-01 00:00:00"), (1, "running", "2024-01-01 00:10:00"), (2, "failed", "2024-01-01 05:00:00"), (1, "completed", "2024-01-01 01:00:00"), (3, "running", "2024-01-03 00:00:00")]
    df = spark.createDataFrame(rows, "id long, status string, ts string").withColumn("ts", F.to_timestamp("ts"))
    df.write.parquet(str(tmp_path / "in"))
    query = streaming.job_states(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))).writeStream.format("memory").queryName("states").outputMode("update").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "state")).start()
    query.awaitTermination()
    got = {r.job_id: (r.status, r.started_at and r.started_at.hour * 60 + r.started_at.minute, r.completed_at is not None) for r in spark.table("states").collect()}
    assert got == {1: ("completed", 10, True), 2: ("failed", None, True), 3: ("running", 0, False)}
    assert {(r.job_id, r.status) for r in streaming.job_states(df).collect()} == {(1, "completed"), (2, "failed"), (3, "running")}


def test_anchor_search(spark):
    cues = spark.createDataFrame([(1, p) for p in range(6)], "track_id long, pos long")
    windows = spark.createDataFrame([(1, a, b, a * 10, b * 10 + 9, [str(x) for x in range(a, b + 1)]) for a in range(6) for b in range(a, min(6, a + 2))], "track_id long, first_pos long, last_pos long, start_ms long, end_ms long, window_codes array<string>")
    phrases = spark.createDataFrame([(1, 0, 5, ["2", "3"]), (1, 1, 6, ["4"])], "track_id long, no int, anchor_ms long, codes array<string>")
    same = M.overlap(F.col("codes"), F.col("window_codes"))
    first, last = M.anchor_search(phrases, windows, cues, same).first(), M.anchor_search(phrases, windows, cues, same, from_end=True).first()
    assert (first.no, first.first_pos, first.last_pos) == (0, 2, 3) and (last.no, last.first_pos, last.last_pos) == (0, 2, 3)


