"""Files in and out: subtitle texts as they were, Blu-ray streams however they are cut."""

import io
import os
import pickle
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cadenza.operators import screens as S
from cadenza.sources import files, srt, sup

CUES = "path string, pos long, start_ms long, end_ms long, text string, encoding string"


def tree(folder):
    return sorted(os.path.relpath(os.path.join(d, f), folder) for d, _, names in os.walk(folder) for f in names)


def test_srt_round_trip(spark, tmp_path):
    rows = [("a/x.synced.srt", 1, 3_723_004, 3_724_000, "two\nlines", "utf-8"), ("a/x.synced.srt", 0, 0, 999, "12", "utf-8"), ("a/x.synced.srt", 2, 5, 6, " \n", "utf-8"), ("a/x.synced.srt", 3, 360_000_000, 360_000_001, "last 7\n\n8", "utf-8"),
            ("b.srt", 0, 1, 2, "café €", "cp1252"), ("c.srt", 0, 1, 2, "\x81é", "latin-1"), ("d.srt", 4, 1, 2, "数 😀", None), ("e.srt", 0, 1, 2, None, "utf-8")]
    folder = str(tmp_path / "out")
    srt.write_srt(spark.createDataFrame(rows, CUES), folder)
    assert tree(folder) == ["a/x.synced.srt", "b.srt", "c.srt", "d.srt", "e.srt"]
    assert (tmp_path / "out/b.srt").read_bytes() == "1\n00:00:00,001 --> 00:00:00,002\ncafé €\n\n".encode("cp1252")
    got = sorted(tuple(r) for r in srt.read_srt_files(spark, folder).withColumn("path", F.regexp_replace("path", "^.*/out/", "")).collect())
    assert got == [("a/x.synced.srt", 0, 0, 999, "12", "utf-8"), ("a/x.synced.srt", 1, 3_723_004, 3_724_000, "two\nlines", "utf-8"), ("a/x.synced.srt", 2, 360_000_000, 360_000_001, "last 7\n\n8", "utf-8"),
                   ("b.srt", 0, 1, 2, "café €", "cp1252"), ("c.srt", 0, 1, 2, "\x81é", "latin-1"), ("d.srt", 0, 1, 2, "数 😀", "utf-8")]
    # a name that is taken fails and leaves all as it was; to overwrite, the old files go
    more = spark.createDataFrame([("b.srt", 0, 1, 2, "new", None), ("z.srt", 0, 1, 2, "new", None)], CUES)
    with pytest.raises(Exception, match="b.srt"):
        srt.write_srt(more, folder)
    assert tree(folder) == ["a/x.synced.srt", "b.srt", "c.srt", "d.srt", "e.srt"]
    srt.write_srt(more, folder, "overwrite")
    assert tree(folder) == ["b.srt", "z.srt"]


def test_srt_failure_leaves_nothing(spark, tmp_path):
    """One cue that its encoding can't write: no file of any task appears, nothing staged stays."""
    folder = tmp_path / "out"
    folder.mkdir()
    rows = [(f"{i}.srt", 0, 1, 2, "数" if i == 77 else "x", "cp1252") for i in range(100)]
    with pytest.raises(Exception, match="charmap|encode"):
        srt.write_srt(spark.createDataFrame(rows, CUES), str(folder))
    assert tree(folder) == [] and os.listdir(folder) == []
    with pytest.raises(Exception, match="no name"):
        srt.write_srt(spark.createDataFrame([("../x.srt", 0, 1, 2, "x", None)], CUES), str(folder))
    assert tree(tmp_path) == []


def test_srt_odd_texts():
    text = "﻿7\r\n00:00:01,5 --> 00:00:02.25 X1:0\r\n\r\n9\r\n0:00:03,000-->0:00:04,000\r\nno number after\r\n00:00:05,000 --> 00:00:06,000\r\n<i>42</i>\r\n\r\n43\r\n\r\n44\r\nnot --> a time\r\n"
    assert list(srt.cues_of(text)) == [(1500, 2250, ""), (3000, 4000, "no number after"), (5000, 6000, "<i>42</i>\n\n43\n\n44\nnot --> a time")]
    assert list(srt.cues_of("")) == [] and srt.decoded(b"\xef\xbb\xbfa") == ("a", "utf-8")


def test_packed():
    class Info:
        def __init__(self, path, size):
            self.path, self.size = path, size

    parts = files.packed([Info(str(i), n) for i, n in enumerate([5, 5, 100, 1, 1, 1, 8])], 12, 1)
    assert [p.paths for p in parts] == [["0", "1"], ["2"], ["3", "4", "5"], ["6"]]


def stream(n=40, seed=1, tail=b""):
    """A .sup file of small segments, some of whose payloads look like segments."""
    r = random.Random(seed)
    out, rows = b"", []
    for i in range(n):
        kind = r.choice(sorted(sup.KINDS))
        payload = r.choice([b"", b"PG", b"PGPGPG" * 3, bytes(r.randrange(256) for _ in range(r.randint(0, 40))), b"PG" + bytes(8) + b"\x99\x00\x05", b"P" * 20])
        rows.append((len(out), i * 90, i, kind, payload))
        out += sup.struct.pack(sup.HEADER, sup.MAGIC, i * 90, i, kind, len(payload)) + payload
    return out + tail, rows


@pytest.mark.parametrize("tail", [b"", b"PG\x00", sup.struct.pack(sup.HEADER, b"PG", 1, 1, 0x16, 99) + b"short", b"no segment at all, PG or not, and then more"])
def test_sup_cut_anywhere(tail):
    """Two ranges, cut at every byte, and ranges of every small size give the segments of the whole, and say where it breaks."""
    data, rows = stream(tail=tail)
    read = lambda a, b: list(sup.segments(io.BytesIO(data), len(data), a, b))
    whole = read(0, len(data))
    broken = len(data) - len(tail)
    assert [x for x in whole if x[3] is not None] == rows and [x[0] for x in whole if x[3] is None] == ([broken] if tail else [])

    def kept(parts):
        stop = min((x[0] for x in parts if x[3] is None), default=len(data))
        return [x for x in parts if x[3] is not None and x[0] < stop]

    for cut in range(1, len(data)):
        assert kept(read(0, cut) + read(cut, len(data))) == rows, cut
    for size in (60, 100, 333):
        assert kept([x for a in range(0, len(data), size) for x in read(a, min(a + size, len(data)))]) == rows


def test_sup_files(spark, tmp_path):
    for name, n, tail in (("a", 200, b""), ("b", 90, b"garbage" * 9), ("c", 0, b"")):
        (tmp_path / f"{name}.SUP").write_bytes(stream(n, ord(name), tail)[0])
    want = sorted((name, *r) for name, n in (("a", 200), ("b", 90)) for r in stream(n, ord(name))[1])
    for split in (64, 1000, 1 << 20):
        got = sup.read_sup(spark, str(tmp_path), split).where("kind is not null").collect()
        assert sorted((os.path.basename(r.path)[0], r.at, r.pts, r.dts, r.kind, bytes(r.payload)) for r in got) == want


def test_screens(spark):
    """Fragments, clears, segments without a screen, short ones, and what stands behind a break."""
    pcs = lambda n, *objects: b"\x07\x80\x04\x38\x10\x00\x05\x80\x80\x03" + bytes([n]) + b"".join(objects)
    placed = b"\x00\x09\x00\x00\x00\x10\x00\x20"
    first = lambda d: b"\x00\x09\x00\x80\x00\x00\x09\x00\x02\x00\x03" + d
    rows = [(0x15, first(b"lost")), (0x16, b"short"), (0x16, pcs(2, placed)), (0x14, b"\x00\x01" + bytes([1, 16, 128, 128, 9]) + bytes([1, 235, 128, 128, 255]) + bytes([2, 255, 255, 0, 1]) + b"rest"), (0x15, b"\x00\x09\x00\x00early"), (0x15, first(b"ab")), (0x15, b"\x00\x09\x00\x40cd"),
            (0x15, b"\x00\x09\x00\x80short"), (0x15, first(b"")), (0x16, pcs(0)), (0x15, first(b"closed")), (0x16, pcs(1, placed)), (0x16, pcs(1, placed)), (0x80, b""), (None, None), (0x16, pcs(0))]
    df = spark.createDataFrame([("f", i, 90_000 * i + 89, kind, data) for i, (kind, data) in enumerate(rows)], "path string, at long, pts long, kind int, payload binary")
    s = S.screens(df)
    shown = [(r.screen, r.start_ms, r.end_ms, r.width, r.height, r.number, r.palette, [tuple(o) for o in r.objects]) for r in S.shown(s).orderBy("screen").collect()]
    assert shown == [(1, 2000, 9000, 1920, 1080, 5, 3, [(9, 16, 32)]), (2, 11000, 14000, 1920, 1080, 5, 3, [(9, 16, 32)]), (3, 12000, 15000, 1920, 1080, 5, 3, [(9, 16, 32)])]
    got = [(r.screen, r.object_no, r.id, r.width, r.height, bytes(r.data)) for r in S.objects(s).orderBy("object_no").collect()]
    assert got == [(1, 1, 9, 2, 3, b"abcd"), (1, 2, 9, 2, 3, b"")]
    colours = {r.entry: (r.red, r.green, r.blue, r.alpha) for r in S.palettes(s).collect()}
    y, cr, cb = (255 - 16) * 1.164383562, 127, -128
    clamp = lambda x: max(0, min(255, int(x + 0.5)))
    assert colours == {1: (255, 255, 255, 255), 2: (clamp(y + cr * 1.792741071), clamp(y - cr * 0.5329093286 - cb * 0.2132486143), clamp(y + cb * 2.112401786), 1)}


def test_sup_small_files_share_tasks(spark, tmp_path):
    """Hundreds of small files are not a task each; a large one is still cut."""
    for k in range(300):
        (tmp_path / f"{k}.sup").write_bytes(stream(3, k)[0])
    (tmp_path / "large.sup").write_bytes(stream(400, 7)[0])
    df = sup.read_sup(spark, str(tmp_path), 1000)
    parts = sup.SupReader(str(tmp_path), 1000).partitions()
    assert len(parts) <= 3 and sum(r.path.endswith("large.sup") for p in parts for r in p.parts) > 5
    assert df.where("kind is not null").count() == 300 * 3 + 400


def test_names_stay_with_their_tasks(spark, tmp_path, monkeypatch):
    """What a task tells the driver is as large for one file as for many; names are read a few at a time; one name in two tasks fails and moves nothing; a read plans no names."""
    monkeypatch.setattr(files, "NAMES", 3)
    monkeypatch.setattr(files, "DIGESTS", 5)
    task = [0]
    context = type("Context", (), {"partitionId": lambda _: task[0], "attemptNumber": lambda _: 0, "taskAttemptId": lambda _: task[0]})()
    monkeypatch.setattr(files, "TaskContext", type("Task", (), {"get": lambda: context}))

    def wrote(writer, names):
        task[0] += 1
        rows = [{"path": n, "pos": 0, "start_ms": 1, "end_ms": 2, "text": n, "encoding": None} for n in names]
        return writer.write(iter([pa.RecordBatch.from_pylist(rows)] if rows else []))

    folder = str(tmp_path / "out")
    names = [f"t{k % 3}/{k} .srt" for k in range(40)]
    writer = srt.SrtWriter(folder, False)
    messages = [wrote(writer, names[:32]), wrote(writer, names[32:33]), wrote(writer, []), None, wrote(writer, names[33:])]
    assert len(pickle.dumps(messages[0])) == len(pickle.dumps(messages[1]))
    writer.commit(messages)
    assert tree(folder) == sorted(names) and "_staging" not in str(os.listdir(folder))
    assert (tmp_path / "out" / names[7]).read_text().endswith(f"{names[7]}\n\n")
    twice = srt.SrtWriter(folder, True)
    with pytest.raises(ValueError, match="spread"):
        twice.commit([wrote(twice, [*map(str, range(9)), "x.srt"]), wrote(twice, ["y.srt", "x.srt"])])
    assert tree(folder) == sorted(names)
    back = srt.read_srt_files(spark, folder)
    assert sorted(r.text for r in back.collect()) == sorted(n.strip() for n in names) and "BatchScan" not in back._jdf.queryExecution().executedPlan().toString()
    assert sorted(r.path for r in files.found_files(spark, folder, ".srt").collect()) == sorted(f"{folder}/{n}" for n in names) == [f.path for f in files.files_under(folder, ".srt")]
