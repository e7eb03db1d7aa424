"""Translation against a plain loop, and the job table's changes and the files that they leave alone."""

import json
import os
import sys

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from cadenza.operators import translation as T
from cadenza.sources.jobtable import DAY_US, JobTable

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def first(texts):
    if "boom" in texts:
        raise ValueError("boom")
    if "short" in texts:
        return json.dumps([{"index": "0", "content": "x"}])
    if "talk" in texts:
        return "Here you are:\n```json\n[" + ",".join(f'"<{t}\n>"' for t in texts) + "]\n```"
    return json.dumps([{"index": str(i), "content": f"1 {t}"} for i, t in reversed(list(enumerate(texts)))])


def second(texts):
    if "never" in texts:
        return "no"
    return json.dumps({"data": [f"2 {t}" for t in texts]})


def plain(tracks, most, chars):
    """Every file by itself: blocks, batches, the first service that gives all texts, and back."""
    out = {}
    for track, texts in tracks.items():
        batches, now = [], []
        for t in texts:
            if now and (len(now) >= most or (chars and sum(map(len, now)) + len(t) > chars)):
                batches.append(now)
                now = []
            now.append(t)
        batches += [now] if now else []
        said = []
        for b in batches:
            if "boom" in b or ("short" in b and len(b) > 1):
                said += None if "never" in b else [f"2 {t}" for t in b]
            elif "short" in b:
                said += ["x"]
            elif "talk" in b:
                said += [f"<{t}\n>" for t in b]
            else:
                said += [f"1 {t}" for t in b]
        out[track] = said
    return out


@pytest.mark.parametrize("most,chars", [(2, 0), (3, 12), (50, 0), (1, 0)])
def test_translate(spark, most, chars):
    tracks = {1: ["a", "b", "boom", "c", "d"], 2: ["one", "short", "two", "three three three"], 3: ["talk", "say x"], 4: ["é", "talk", "boom"]}
    rows = [(t, 4 * k + j, line) for t, texts in {**tracks, 5: []}.items() for k, text in enumerate(texts) for j, line in enumerate([str(k + 1), "00:00:01,000 --> 00:00:02,000", text, ""])]
    rows += [(5, 0, "1"), (5, 1, "")]
    seen = []
    lines, found = T.translate(spark.createDataFrame(rows, "track_id long, line_no long, line string"), [("first", first), ("second", second)], most, chars, parts=3, callback=lambda *x: seen.append(x))
    got = {}
    for r in lines.orderBy("track_id", "line_no").collect():
        got.setdefault(r.track_id, []).append((r.line_no, r.line))
    want = {}
    for t, said in {**plain(tracks, most, chars), 5: []}.items():
        want[t] = [(n, said[n // 4] if n % 4 == 2 else line) for track, n, line in rows if track == t]
    assert got == want
    n = sum(map(len, tracks.values()))
    assert [t for _, t in seen] == [n, n] and seen[-1][0] == n and seen[0][0] == sum(len(r.texts) for r in found.where("translator = 'first'").collect())
    assert {r.translator for r in found.collect()} <= {"first", "second"} and found.where("error is not null").count() == 0


def test_translate_fails(spark):
    """A batch that none translates: its track has no lines, its error is told; others stay."""
    rows = [(1, 0, "boom"), (1, 1, ""), (1, 2, "never"), (2, 0, "fine"), (3, 0, "")]
    df = spark.createDataFrame(rows, "track_id long, line_no long, line string")
    lines, found = T.translate(df, [("first", first), ("second", second)])
    assert sorted(tuple(r) for r in lines.collect()) == [(2, 0, "1 fine"), (3, 0, "")]
    bad = found.where("error is not null").collect()
    assert [(r.track_id, r.translator, r.texts, r.error) for r in bad] == [(1, "second", None, "answer without all texts")]
    lines, found = T.translate(df.limit(0), [("first", first)])
    assert lines.count() == 0 and found.count() == 0


def test_dictionary():
    said = json.loads(T.dictionary({"cat": "chat", "the": "le"})(["The cat sat", ""]))
    assert said == [{"index": "0", "content": "le chat sat"}, {"index": "1", "content": ""}]


def files(folder):
    return {os.path.join(d, f) for d, _, names in os.walk(folder) for f in names if f.endswith(".parquet")}


def test_job_table(spark, tmp_path):
    folder = str(tmp_path / "jobs")
    schema = "id long, job_type string, status string, created_us long, started_us long, completed_us long"
    rows = [(i, "extract", ["pending", "running", "completed", "failed", "timeout"][i % 5], i % 4 * DAY_US + i, None, i % 4 * DAY_US + i if i % 5 > 1 else None) for i in range(40)]
    t = JobTable(spark, folder)
    assert t.rows().count() == 0
    t.insert(spark.createDataFrame(rows, schema))
    t.insert(spark.createDataFrame([(None, "extract", "pending", 3 * DAY_US, None, None)] * 3, schema))
    ids = sorted(r.id for r in t.rows().collect())
    assert ids[:40] == list(range(40)) and len(set(ids)) == 43 and ids[40] > 39
    before = files(folder)
    # waiting jobs of one day: the other days' files keep their names
    t.delete_pending(spark.createDataFrame([(0,), (20,), (20,), (1,), (999,), (None,)], "id long"))
    assert sorted(r.id for r in t.rows().collect()) == [i for i in ids if i not in (0, 20)]
    after = files(folder)
    assert {f for f in before if "day=1970-01-01" not in f} == {f for f in after if "day=1970-01-01" not in f} and before != after
    t.delete_pending(spark.createDataFrame([(1,)], "id long"))
    assert files(folder) == after
    # a day that loses all its jobs goes
    t.retain(9 * DAY_US + 100)
    gone = lambda r: r[2] in ("completed", "failed", "timeout") and r[5] < 2 * DAY_US + 100
    left = [r[0] for r in rows if not gone(r) and r[0] not in (0, 20)] + ids[40:]
    assert sorted(r.id for r in t.rows().collect()) == sorted(left)
    spark_ids = [r[0] for r in rows if r[3] // DAY_US == 1 and r[2] == "pending"]
    t.delete_pending(spark.createDataFrame([(i,) for i in spark_ids], "id long"))
    running = [i for i in left if i not in spark_ids]
    assert sorted(r.id for r in t.rows().collect()) == sorted(running)
    t.truncate()
    assert t.rows().count() == 0 and not files(folder)
    t.insert(spark.createDataFrame(rows[:2], schema))
    t.delete_pending(spark.createDataFrame([(0,)], "id long"))
    assert [r.id for r in t.rows().collect()] == [1]
