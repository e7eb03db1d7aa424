"""Trees listed by Spark against a plain walk; lines of IDX files."""

import os
import random

from cadenza.sources import folders, idx


def test_walk(spark, tmp_path):
    """Deep and wide folders, empty ones, links to files, folders, and around in circles, names of any case."""
    r, root = random.Random(4), tmp_path / "root"
    root.mkdir()
    made = [root]
    for k in range(60):
        d = r.choice(made) / r.choice(["A", "b", "Ä", "x y", ".h"]).__add__(str(k))
        d.mkdir()
        made.append(d)
    for k in range(150):
        (r.choice(made) / f"{r.choice('abcABC')}{k}.srt").write_bytes(b"x" * r.randint(0, 99))
    (made[3] / "loop").symlink_to(root)
    (root / "file link").symlink_to(next(p for p in root.rglob("*.srt")))
    (root / "nowhere").symlink_to("/no such place")
    entries = folders.walked(spark, str(root))
    want = [(d, n, is_dir) for d, dirs, files in os.walk(root) for is_dir, names in ((True, dirs), (False, files)) for n in names if not os.path.islink(os.path.join(d, n))]
    assert sorted((e.folder, e.name, e.is_dir) for e in entries.collect()) == sorted(want)
    sizes = {f.folder: (f.size, f.files) for f in folders.folder_sizes(entries, str(root)).collect()}
    plain = {str(d): [f for f in d.rglob("*.srt") if not f.is_symlink() and "loop" not in f.relative_to(d).parts] for d in made}
    assert sizes == {d: (sum(f.stat().st_size for f in fs), len(fs)) for d, fs in plain.items()}
    here = [e.name for e in folders.listed(entries.where(entries.folder == str(root))).orderBy("place").collect()]
    assert here == sorted(here, key=lambda n: (not os.path.isdir(root / n), n.lower(), n))
    assert folders.walked(spark, str(tmp_path / "not there")).count() == 0


def test_idx(spark):
    full = "palette: " + ", ".join(f"{k:06x}" for k in range(17))
    files = {"a": ["# VobSub", "", " PALETTE: 1, 2", full, "timestamp: 00:00:01:002, filepos: 00000000a", "#timestamp: 00:00:09:000, filepos: 1", "x timestamp:01:00:00:000 , filepos:FF y", "palette: " + "f, " * 16],
             "b": ["timestamp: 00:00:01:000, filepos: 0"], "c": [full], "d": [full, "timestamp: 0:00:01:000, filepos: 0"]}
    lines = spark.createDataFrame([(p, i, x) for p, xs in files.items() for i, x in enumerate(xs)], "path string, line_no long, line string")
    got = [(x.path, x.pos, x.start_ms, x.filepos, x.palette) for x in idx.idx_entries(lines).orderBy("pos").collect()]
    assert got == [("a", 0, 1002, 10, [15] * 16), ("a", 1, 3_600_000, 255, [15] * 16)]
