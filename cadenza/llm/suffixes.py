"""Suffix-array dedup: equal 50-byte strings meet in one bucket, whose suffixes are grouped in linear time."""

from __future__ import annotations

import hashlib
import marshal
import uuid
from array import array
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hot_keys, join_skewed, parts_for, shared_dir, small_batches, stored, utf8


@dataclass(frozen=True)
class Options:
    length: int = 50
    #: A string's bucket is the smallest hash of the pieces of so many bytes inside it. A bucket with too many
    #: different segments is cut again by the next size; at the last one a bucket is one string.
    pieces: tuple[int, ...] = (20, 50)
    #: Different segments from which on a bucket is cut again.
    bucket: int = 256
    #: Bytes of segments that one task orders at a time, about.
    ordered: int = 48 << 20
    #: Bytes of text in a chunk, the unit in which texts meet what was found out about them.
    chunk: int = 4 << 20
    #: Bytes of bucket keys that one task counts at a time.
    part: int = 32 << 20
    #: Bytes of text hashed at a time.
    slab: int = 1 << 16


def suffix_array(text: list[int]) -> list[int]:
    """Order of the suffixes of text, whose last symbol must be its smallest and unique.

    Phase one starts with a group for each first symbol and takes the groups in descending order. For
    each suffix of a group it finds the previous one that is in a smaller group; the suffixes so
    pointed at move to the end of their own groups, those with more pointers further back. Then each
    group is one Lyndon prefix. Phase two emits: the suffix before one already placed, and those its
    pointers lead to, are the next of their groups. Groups keep their suffixes in the order of the
    text, and pointers of a group's suffixes never cross, so nothing is sorted but the alphabet.
    """
    n = len(text)
    members: dict[int, list[int]] = {}
    for i, c in enumerate(text):
        members.setdefault(c, []).append(i)
    start = [0] * n  # where the suffix's group starts, which also ranks the groups
    groups: list[list[int]] = [[]] * n  # by start; may still list suffixes that have moved away
    size = [0] * n
    ends = [0] * (n + 1)  # the group that ends at a place
    at = 0
    for c in sorted(members):
        own = members[c]
        groups[at], size[at], ends[at + len(own)] = own, len(own), at
        for i in own:
            start[i] = at
        at += len(own)
    previous = [-1] * n
    high = n
    while high > 0:
        low = ends[high]
        pointed: list[int] = []
        times: list[int] = []
        last = -1
        for s in groups[low]:
            if start[s] != low:
                continue
            p = s - 1
            while p >= 0 and start[p] >= low:
                p = previous[p]
            previous[s] = p
            if p >= 0:
                if p == last:
                    times[-1] += 1
                else:
                    pointed.append(p)
                    times.append(1)
                    last = p
        if len(pointed) == 1:
            p = last
            g = start[p]
            if size[g] > 1:
                end = g + size[g]
                size[g] -= 1
                new = end - 1
                size[new], ends[end], ends[new], groups[new], start[p] = 1, new, g, [p], new
        elif pointed:
            by_times: list[list[int]] = [[] for _ in range(max(times))]
            for p, k in zip(pointed, times):
                by_times[k - 1].append(p)
            for moving in reversed(by_times):
                moves: dict[int, list[int]] = {}
                for p in moving:
                    moves.setdefault(start[p], []).append(p)
                for g, own in moves.items():
                    k = len(own)
                    if k == size[g]:
                        continue
                    end = g + size[g]
                    new = end - k
                    size[g] -= k
                    size[new], ends[end], ends[new], groups[new] = k, new, g, own
                    for p in own:
                        start[p] = new
        high = low
    order = [0] * n
    order[0] = n - 1
    placed = bytearray(n)
    placed[n - 1] = 1
    nxt = list(range(n))
    nxt[0] = 1
    for i in range(n):
        s = order[i] - 1
        while s >= 0 and not placed[s]:
            g = start[s]
            order[nxt[g]] = s
            nxt[g] += 1
            placed[s] = 1
            s = previous[s]
    return order


def shared_firsts(segments: list[bytes], firsts: list, length: int) -> list[list]:
    """For each start in each segment, the smallest of firsts among the segments that hold its string of `length` bytes."""
    joined = b"\0".join(segments)
    symbols: list[int] = []
    owner, offset, good = [], [], []
    for k, x in enumerate(segments):
        n = len(x) - length + 1
        symbols += [c + 2 for c in x]
        symbols.append(1)
        owner += [k] * (len(x) + 1)
        offset += range(len(x) + 1)
        good += [True] * n + [False] * length
    symbols.append(0)
    good.append(False)
    out = [[f] * (len(x) - length + 1) for x, f in zip(segments, firsts)]
    run: list[int] = []
    last = b""

    def close() -> None:
        if len(run) > 1:
            least = min(firsts[owner[s]] for s in run)
            for s in run:
                out[owner[s]][offset[s]] = least

    for s in suffix_array(symbols):
        if good[s]:
            this = joined[s : s + length]
            if this != last:
                close()
                run, last = [], this
            run.append(s)
    close()
    return out


_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_BYTE = np.array([xxhash.xxh64_intdigest(bytes([i]), 42) for i in range(256)], np.uint64)


def piece_hashes(text: bytes, piece: int) -> np.ndarray:
    """A hash of each piece of so many bytes."""
    power, done = _BYTE[np.frombuffer(text, np.uint8)], None
    step, taken = 1, 0
    while step <= piece:
        if piece & step:  # pieces double; the binary digits of the size say which are joined
            if done is None:
                done = power
            else:
                m = len(power) - taken
                done = (done[:m] * _A ^ power[taken:]) * _B
            taken += step
        power = power[:-step] * _A + (power[step:] ^ power[step:] >> np.uint64(29)) * _B
        step *= 2
    out = (done ^ done >> np.uint64(32)) * _A
    return out ^ out >> np.uint64(31)


def window_keys(text: bytes, length: int, piece: int) -> np.ndarray:
    """For each string of `length` bytes, the smallest hash of its pieces."""
    n = len(text) - length + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    least = piece_hashes(text, piece)
    width, have = length - piece + 1, 1
    while have < width:
        more = min(have, width - have)
        least = np.minimum(least[:-more], least[more:])
        have += more
    return least[:n]


def _mixed(least: np.ndarray) -> np.ndarray:
    """Keys spread evenly: the smallest of many hashes are small."""
    key = least * _B
    return key ^ key >> np.uint64(32)


def piece_places(segments: list[bytes], keys: np.ndarray, length: int, piece: int) -> np.ndarray:
    """Where in each segment the piece is whose hash is its key; all of the segment's strings hold it."""
    size = np.array([len(x) for x in segments], np.int64)
    begin = np.cumsum(size) - size
    hashes = piece_hashes(b"".join(segments), piece)
    out = size - length  # the last string's start
    left = np.arange(len(segments))
    while len(left):
        left = left[_mixed(hashes[begin[left] + out[left]]) != keys[left]]
        out[left] += 1
    return out


def runs_of(texts: list[bytes], piece: int, options: Options) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text number, first start, starts, key, content) of the runs of neighbouring strings with one key.

    content is a hash of the bytes that a run's strings cover; it only tells how many differ.
    """
    found: list[list[np.ndarray]] = []
    a = 0
    while a < len(texts):
        b, size = a, 0
        while b < len(texts) and (size == 0 or size < options.slab):
            size += len(texts[b])
            b += 1
        slab = b"".join(texts[a:b])
        key = _mixed(window_keys(slab, options.length, piece))
        if len(key):
            begin = np.cumsum([0, *map(len, texts[a:b])])
            valid = np.ones(len(key) + 1, np.int32)
            valid[-1] = 0
            for end in begin[1:-1].tolist():  # strings over the end of a text are none
                valid[max(0, end - options.length + 1) : end] = 0
            new = np.ones(len(key) + 1, bool)
            if piece < options.length:  # otherwise each string is a run of its own
                new[1:-1] = (key[1:] != key[:-1]) | (valid[1:-1] != valid[:-2])
            new[begin[(begin > 0) & (begin < len(key))]] = True
            edge = np.flatnonzero(new)
            good = valid[edge[:-1]] > 0
            first, end = edge[:-1][good], edge[1:][good]
            if len(first):
                place = np.full(len(slab) + 1, 1, np.uint64)
                place[1:] = _A
                place = np.multiply.accumulate(place)
                sums = np.zeros(len(slab) + 1, np.uint64)
                np.cumsum(_BYTE[np.frombuffer(slab, np.uint8)] * place[:-1], out=sums[1:])
                content = (sums[end + (options.length - 1)] - sums[first]) * place[len(slab) - first]
                content = content * _B
                owner = np.searchsorted(begin, first, side="right") - 1
                found.append([owner + a, first - begin[owner], end - first, key[first], content ^ content >> np.uint64(32)])
        a = b
    if not found:
        return (np.empty(0, np.int64),) * 3 + (np.empty(0, np.uint64),) * 2
    return tuple(np.concatenate(c) for c in zip(*found))


def key_parts(n_bytes: int, options: Options) -> int:
    """Parts of the key space; each is counted by one task at a time. Beyond 2 ** 16 of them parts grow."""
    return 1 << max(6, min(16, (n_bytes * 3 // 8 // options.part).bit_length()))


def pairs_of(key: np.ndarray, content: np.ndarray, parts: int) -> np.ndarray:
    """Bits of the key, the part's first and 32 more, then 16 of content."""
    return key >> np.uint64(33 - parts.bit_length()) << np.uint64(16) | content & np.uint64(0xFFFF)


#: What a key is: not repeated, repeated, or of so many different segments that they are cut again.
NONE, REPEATED, CUT = range(3)
RIGHT = "chunk long, level int, part int, marks binary, rows array<int>"


class Chunk:
    """The representatives of a chunk's texts, and the marks of their bucket keys level by level."""

    def __init__(self, left: pa.Table, right: pa.Table, parts: int, options: Options):
        self.options, self.parts = options, parts
        level, part = right["level"].to_numpy(), right["part"].to_numpy()
        keep = right["rows"].to_pylist()
        kept = sorted(r for i in np.flatnonzero(level < 0).tolist() for r in keep[i])
        at = np.argsort(left["row"].to_numpy(), kind="stable")[kept] if kept else np.empty(0, np.int64)
        self.rows = np.array(kept, np.int64)
        taken = left.take(pa.array(at))
        self.ids = taken["doc_id"].to_pylist()
        self.texts = utf8(taken["text"].combine_chunks()) if len(kept) else []
        self.marks: dict[int, np.ndarray] = {}
        blobs = right["marks"].to_pylist()
        for one in np.unique(level[level >= 0]).tolist():
            own = np.flatnonzero(level == one)
            self.marks[one] = np.frombuffer(b"".join(blobs[i] for i in own[np.argsort(part[own])].tolist()), np.uint8)

    def descend(self, levels: int) -> tuple[list[bytes], np.ndarray, np.ndarray, list[tuple]]:
        """(texts, owners, places) of what is still to be cut after so many levels, and the repeated runs on the way."""
        texts, owner, place = self.texts, np.arange(len(self.texts)), np.zeros(len(self.texts), np.int64)
        repeated = []
        for level in range(levels):
            which, at, n, key, content = runs_of(texts, self.options.pieces[level], self.options)
            pairs, inverse = np.unique(pairs_of(key, content, self.parts), return_inverse=True)
            mark = self.marks.get(level, np.zeros(len(pairs), np.uint8))[inverse]
            some = np.flatnonzero(mark == REPEATED)
            repeated.append((level, texts, which[some], at[some], n[some], key[some], owner[which[some]], place[which[some]] + at[some]))
            hot = np.flatnonzero(mark == CUT)
            ends = at[hot] + n[hot] + (self.options.length - 1)
            cut = [texts[i][a:b] for i, a, b in zip(which[hot].tolist(), at[hot].tolist(), ends.tolist())]
            texts, owner, place = cut, owner[which[hot]], place[which[hot]] + at[hot]
        return texts, owner, place, repeated


def keyed(texts: DataFrame, right: DataFrame, level: int, parts: int, options: Options) -> DataFrame:
    """(part, chunk, pairs, more): each chunk's distinct bucket keys of a level, and if it has them more than once."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        names = ["part", "chunk", "pairs", "more"]
        chunk = right["chunk"][0].as_py() if right.num_rows else None
        rest = Chunk(left, right, parts, options).descend(level)[0] if chunk is not None else []
        _, _, _, key, content = runs_of(rest, options.pieces[level], options)
        pairs, n = np.unique(pairs_of(key, content, parts), return_counts=True)
        edges = np.searchsorted(pairs >> np.uint64(48), np.arange(parts + 1, dtype=np.uint64))
        low = pairs.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]
        rows = [(p, chunk, low[a:b].tobytes(), np.packbits(n[a:b] > 1).tobytes()) for p, (a, b) in enumerate(zip(edges.tolist(), edges[1:].tolist())) if a < b]
        columns = list(zip(*rows)) or [()] * 4
        types = [pa.int32(), pa.int64(), pa.binary(), pa.binary()]
        return pa.table([pa.array(c, t) for c, t in zip(columns, types)], names)

    both = texts.select("chunk", "row", "doc_id", "text").groupBy("chunk").cogroup(right.groupBy("chunk"))
    return both.applyInArrow(run, "part int, chunk long, pairs binary, more binary")


def marked(keys: DataFrame, level: int, parts: int, options: Options) -> DataFrame:
    """keyed rows to (chunk, level, part, marks, rows): for each pair what it is.

    What a task holds at a time is one part's keys, packed.
    """
    last = level == len(options.pieces) - 1

    def count(part: int, blobs: list[tuple[int, bytes, bytes]]) -> Iterator[pa.RecordBatch]:
        size = [len(b[1]) // 6 for b in blobs]
        wide = np.zeros((sum(size), 8), np.uint8)
        wide[:, :6] = np.frombuffer(b"".join(b[1] for b in blobs), np.uint8).reshape(-1, 6)
        value = wide.view("<u8").ravel()
        more = np.concatenate([np.unpackbits(np.frombuffer(b[2], np.uint8), count=n) for b, n in zip(blobs, size)])
        order = np.argsort(value, kind="stable")
        ordered = value[order]
        key = ordered >> np.uint64(16)
        new = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        different = np.ones(len(ordered), np.int64)
        different[1:] = ordered[1:] != ordered[:-1]
        n = np.diff(np.append(new, len(key)))
        mark = (n + np.add.reduceat(more[order].astype(np.int64), new) > 1).astype(np.uint8) * REPEATED
        if not last:
            mark[(mark == REPEATED) & (np.add.reduceat(different, new) > options.bucket)] = CUT
        out = np.empty(len(ordered), np.uint8)
        out[order] = np.repeat(mark, n)
        ends = np.cumsum(size)
        for a in range(0, len(blobs), 1024):
            some = blobs[a : a + 1024]
            marks = [out[e - m : e].tobytes() for e, m in zip(ends[a : a + 1024].tolist(), size[a : a + 1024])]
            columns = [pa.array([b[0] for b in some], pa.int64()), pa.array([level] * len(some), pa.int32()), pa.array([part] * len(some), pa.int32()), pa.array(marks, pa.binary()), pa.nulls(len(some), pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays(columns, ["chunk", "level", "part", "marks", "rows"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        part, blobs = None, []
        for batch in batches:
            for p, *blob in zip(*(c.to_pylist() for c in batch.columns)):
                if p != part and blobs:
                    yield from count(part, blobs)
                    blobs = []
                part = p
                blobs.append(blob)
        if blobs:
            yield from count(part, blobs)

    dealt = keys.repartition(parts_for(parts, 4, keys.sparkSession), "part").sortWithinPartitions("part")
    return dealt.mapInArrow(run, RIGHT)


def repeated_runs(texts: DataFrame, right: DataFrame, parts: int, ordered: int, options: Options) -> DataFrame:
    """(part, body): the distinct repeated runs of each chunk and their places, packed for each of `ordered` parts of the keys.

    A run is its bytes and where its piece is in them; at the last level, where it is one string, a
    128-bit digest of these.
    """
    shift = np.uint64(65 - ordered.bit_length())

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        chunk = Chunk(left, right, parts, options)
        me = right["chunk"][0].as_py() if right.num_rows else 0
        ids = np.array(chunk.ids) if chunk.ids and isinstance(chunk.ids[0], int) else chunk.ids
        pack = zstandard.ZstdCompressor(level=3).compress
        out_part, out_body = [], []
        for level, source, which, at, n, key, owner, place in chunk.descend(len(options.pieces))[3]:
            if not len(which):
                continue
            ends = at + n + (options.length - 1)
            segs = [source[i][a:b] for i, a, b in zip(which.tolist(), at.tolist(), ends.tolist())]
            firsts: dict[bytes, int] = {}
            number = np.array([firsts.setdefault(x, k) for k, x in enumerate(segs)], np.int64)
            order = np.argsort(number, kind="stable")
            first, count = np.unique(number, return_counts=True)
            begin = np.cumsum(count) - count
            segs = [segs[i] for i in first.tolist()]
            if options.pieces[level] < options.length:
                spot = piece_places(segs, key[first], options.length, options.pieces[level])
            else:
                spot = np.full(len(segs), -1)
                segs = [hashlib.blake2b(x, digest_size=16).digest() for x in segs]
            places = np.column_stack([chunk.rows[owner], place, place + ends - at]).astype("<i4")[order]
            whose = owner[order]
            part = (key[first] >> shift).astype(np.int64)
            by_part = np.argsort(part, kind="stable")
            edges = np.searchsorted(part[by_part], np.arange(ordered + 1)).tolist()
            for p, (a, b) in enumerate(zip(edges, edges[1:])):
                if a == b:
                    continue
                own = by_part[a:b]
                where = np.repeat(begin[own] - (np.cumsum(count[own]) - count[own]), count[own]) + np.arange(count[own].sum())
                docs = ids[whose[where]].astype("<i8").tobytes() if isinstance(ids, np.ndarray) else [ids[i] for i in whose[where].tolist()]
                some = [segs[i] for i in own.tolist()]
                body = (me, key[first[own]].tobytes(), spot[own].astype("<i4").tobytes(), np.array([len(x) for x in some], "<i4").tobytes(), b"".join(some), count[own].astype("<i4").tobytes(), places[where].tobytes(), docs)
                out_part.append(p)
                out_body.append(pack(marshal.dumps(body)))
        return pa.table([pa.array(out_part, pa.int32()), pa.array(out_body, pa.binary())], ["part", "body"])

    both = texts.select("chunk", "row", "doc_id", "text").groupBy("chunk").cogroup(right.groupBy("chunk"))
    return both.applyInArrow(run, "part int, body binary")


def near_pieces(segments: list[bytes], spots: list[int], length: int, piece: int) -> list[int]:
    """Numbers of the segments that may share a string of `length` bytes with another one, all around one piece.

    Such a string has so many bytes before the piece and the rest behind it. One of four splits of
    that rest is equal in both segments: bytes before, the piece, and bytes behind it.
    """
    rest = length - piece
    step = -(-(rest + 1) // 4)
    cuts = [(a, rest - min(a + step - 1, rest)) for a in range(0, rest + 1, step)]
    count: dict[tuple, int] = {}
    keys = []
    for x, p in zip(segments, spots):
        own = [(c, x[p - before : p + piece + after]) for c, (before, after) in enumerate(cuts) if p >= before and p + piece + after <= len(x)]
        keys.append(own)
        for k in own:
            count[k] = count.get(k, 0) + 1
    return [i for i, own in enumerate(keys) if any(count[k] > 1 for k in own)]


def solved(segs: dict[bytes, list], options: Options) -> dict[bytes, list]:
    """segs(name: [bytes, place of the piece or -1, smallest id]) to the smallest id for each string, or to one for all."""
    out = {d: [x[2]] for d, x in segs.items()}
    names = [d for d, x in segs.items() if x[1] >= 0]
    if len(names) > 1:
        names = [names[i] for i in near_pieces([segs[d][0] for d in names], [segs[d][1] for d in names], options.length, options.pieces[0])]
        if len(names) > 1:
            found = shared_firsts([segs[d][0] for d in names], [segs[d][2] for d in names], options.length)
            out |= {d: f if any(x != f[0] for x in f) else f[:1] for d, f in zip(names, found)}
    return out


class Entries:
    """The packed runs of one part of the keys."""

    def __init__(self, bodies: list[bytes]):
        unpack = zstandard.ZstdDecompressor().decompress
        loaded = [marshal.loads(unpack(b)) for b in bodies]
        ints = lambda i: np.concatenate([np.frombuffer(x[i], "<i4") for x in loaded]).astype(np.int64)
        self.key = np.concatenate([np.frombuffer(x[1], np.uint64) for x in loaded])
        self.chunk = np.repeat([x[0] for x in loaded], [len(x[1]) // 8 for x in loaded]).tolist()
        self.spot, size, count = ints(2).tolist(), ints(3), ints(5)
        self.text = b"".join(x[4] for x in loaded)
        self.places = ints(6).reshape(-1, 3)
        if isinstance(loaded[0][7], list):
            self.docs = [d for x in loaded for d in x[7]]
        else:
            self.docs = np.concatenate([np.frombuffer(x[7], "<i8") for x in loaded]).tolist()
        self.seg_ends, self.place_ends = np.cumsum(size), np.cumsum(count)
        self.seg_starts, self.place_starts = (self.seg_ends - size).tolist(), (self.place_ends - count).tolist()
        self.seg_ends, self.place_ends = self.seg_ends.tolist(), self.place_ends.tolist()


def removed(runs: DataFrame, ordered: int, options: Options) -> DataFrame:
    """(chunk, spans): the bytes that go from the texts of a chunk, as row, start and end.

    A task holds the runs of one part of the keys. Of one bucket these are at most `bucket` different
    segments, with one entry for each chunk that has them.
    """
    length = options.length

    def solve(bodies: list[bytes]) -> dict[int, array]:
        e = Entries(bodies)
        spans: dict[int, array] = {}
        order = np.argsort(e.key, kind="stable")
        edges = np.flatnonzero(np.concatenate([[True], e.key[order][1:] != e.key[order][:-1], [True]])).tolist()
        order = order.tolist()
        text, docs, places = e.text, e.docs, e.places
        for a, b in zip(edges, edges[1:]):
            group = order[a:b]
            if len(group) == 1 and e.place_ends[group[0]] - e.place_starts[group[0]] == 1:
                continue
            segs: dict[bytes, list] = {}
            for i in group:
                name = text[e.seg_starts[i] : e.seg_ends[i]]
                least = min(docs[e.place_starts[i] : e.place_ends[i]])
                have = segs.get(name)
                if have is None:
                    segs[name] = [name, e.spot[i], least]
                elif least < have[2]:
                    have[2] = least
            found = solved(segs, options)
            for i in group:
                first = found[text[e.seg_starts[i] : e.seg_ends[i]]]
                for k in range(e.place_starts[i], e.place_ends[i]):
                    doc = docs[k]
                    if min(first) >= doc:
                        continue
                    row, at, end = places[k].tolist()
                    out = spans.get(e.chunk[i])
                    if out is None:
                        out = spans[e.chunk[i]] = array("i")
                    if len(first) == 1:
                        out.extend((row, at, end))
                        continue
                    begin = -1
                    for j, x in enumerate(first):
                        if x < doc:
                            if begin < 0:
                                begin = j
                        elif begin >= 0:
                            out.extend((row, at + begin, at + j - 1 + length))
                            begin = -1
                    if begin >= 0:
                        out.extend((row, at + begin, end))
        return spans

    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        part, bodies = None, []
        for batch in batches:
            for p, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if p != part and bodies:
                    yield made(solve(bodies))
                    bodies = []
                part = p
                bodies.append(body)
        if bodies:
            yield made(solve(bodies))

    def made(spans: dict[int, array]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(spans), pa.int64()), pa.array([v.tobytes() for v in spans.values()], pa.binary())], ["chunk", "spans"])

    dealt = runs.repartition(parts_for(ordered, 2, runs.sparkSession), "part").sortWithinPartitions("part")
    return dealt.mapInArrow(run, "chunk long, spans binary")


def cut(text: bytes, spans: np.ndarray) -> tuple[int, int, str]:
    """(bytes removed, maximal removed runs, SHA-256 of the rest) of a text without its spans."""
    gone = np.zeros(len(text) + 1, np.int32)
    np.add.at(gone, spans[:, 0], 1)
    np.add.at(gone, spans[:, 1], -1)
    out = np.cumsum(gone[:-1]) > 0
    kept = np.frombuffer(text, np.uint8)[~out].tobytes()
    return int(out.sum()), int((np.diff(out.astype(np.int8), prepend=0) == 1).sum()), hashlib.sha256(kept).hexdigest()


def cut_texts(texts: DataFrame, spans: DataFrame) -> DataFrame:
    """(digest, n_removed, n_spans, kept) of the texts that lose something."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        every = np.frombuffer(b"".join(right["spans"].to_pylist()), "i4").reshape(-1, 3)
        every = every[np.argsort(every[:, 0], kind="stable")]
        rows, begin = np.unique(every[:, 0], return_index=True)
        by_row = np.argsort(left["row"].to_numpy(), kind="stable")
        taken = left.take(pa.array(by_row[rows] if len(rows) else np.empty(0, np.int64)))
        found = []
        for text, a, b in zip(utf8(taken["text"].combine_chunks()) if len(rows) else [], begin.tolist(), [*begin[1:].tolist(), len(every)]):
            found.append(cut(text, every[a:b, 1:]))
        columns = list(zip(*found)) or [()] * 3
        return pa.table([taken["digest"], *(pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.string())))], ["digest", "n_removed", "n_spans", "kept"])

    both = texts.select("chunk", "row", "digest", "text").groupBy("chunk").cogroup(spans.groupBy("chunk"))
    return both.applyInArrow(run, "digest binary, n_removed long, n_spans long, kept string")


def chunked(docs: DataFrame, kind: str, n_bytes: int, options: Options) -> DataFrame:
    """docs(doc_id, text) written once as (chunk, row, doc_id, n_bytes, digest, text), bucketed by chunk.

    What is found out about a chunk is sent to its bucket, so texts are never shuffled.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        chunk, row, size = TaskContext.get().partitionId() << 32, 0, 0
        for batch in batches:
            texts = utf8(batch.column(1))
            chunks, rows = [], []
            for text in texts:
                if size and size + len(text) > options.chunk:
                    chunk, row, size = chunk + 1, 0, 0
                chunks.append(chunk)
                rows.append(row)
                row += 1
                size += len(text)
            columns = [pa.array(chunks, pa.int64()), pa.array(rows, pa.int32()), batch.column(0), pa.array([len(t) for t in texts], pa.int64()),
                       pa.array([hashlib.sha256(t).digest() for t in texts], pa.binary()), pa.array(texts, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["chunk", "row", "doc_id", "n_bytes", "digest", "text"])

    spark = docs.sparkSession
    name = f"suffix_chunks_{uuid.uuid4().hex}"
    out = docs.mapInArrow(run, f"chunk long, row int, doc_id {kind}, n_bytes long, digest binary, text binary")
    buckets = parts_for(n_bytes, 32 << 20, spark)
    out.write.option("path", f"{shared_dir(spark)}/{name}").option("compression", "zstd").bucketBy(buckets, "chunk").saveAsTable(name)
    found = spark.table(name)
    spark.sql(f"drop table {name}")  # the files stay; only the name goes
    return found


def remove_repeats(docs: DataFrame, options: Options = Options()) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) for every row of docs(doc_id, text).

    A byte goes if a string of `length` bytes over it also starts in a row with a smaller doc_id. Null
    texts are empty; texts shorter than `length` stay whole. Rows of one doc_id don't remove from each
    other. A null doc_id neither removes nor loses. Other columns are not read; no rows give no rows.

    Of equal texts (by SHA-256) the row with the smallest id stands for all; later ones go whole.
    Equal strings of the others share a bucket key (the smallest hash of their pieces), so neighbours
    with one key travel as one segment. Keys are counted packed, and each chunk of texts gets back
    which of its keys occur elsewhere. Segments of those meet in their bucket, where suffixes are
    ordered and equal strings found by their bytes; a bucket of one segment has no order to find. A
    key of very many different segments is cut again by longer pieces before anything is sent, at last
    into strings, of which only those travel that occur elsewhere, each as a digest.
    """
    spark = docs.sparkSession
    small_batches(spark, 64)
    kind = dict(docs.dtypes)["doc_id"]
    base = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    n_bytes = base.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    texts = chunked(base, kind, n_bytes, options)
    long = texts.where(F.col("doc_id").isNotNull() & (F.col("n_bytes") >= options.length))
    equal = long.groupBy("digest").agg(F.min(F.struct("doc_id", "chunk", "row")).alias("first"), F.count(F.lit(1)).alias("n"))
    equal = stored(equal.select("digest", "n", "first.*"), "equal")
    nothing = [F.lit(-1).alias("level"), F.lit(-1).alias("part"), F.lit(b"").alias("marks")]
    right = stored(equal.groupBy("chunk").agg(F.collect_list("row").alias("rows")).select("chunk", *nothing, "rows"), "kept")
    parts = key_parts(n_bytes, options)
    for level in range(len(options.pieces)):
        marks = stored(marked(keyed(texts, right, level, parts, options), level, parts, options), "marks")
        right = right.unionByName(marks)
        if level + 1 < len(options.pieces) and not marks.where(F.contains("marks", F.lit(bytes([CUT])))).limit(1).count():
            break
    ordered = 1 << max(6, (n_bytes // options.ordered).bit_length())
    spans = removed(repeated_runs(texts, right, parts, ordered, options), ordered, options)
    losing = cut_texts(texts, spans)
    empty = F.lit(None)
    facts = equal.where("n > 1").select("digest", F.col("doc_id").alias("first"), empty.cast("long").alias("n_removed"), empty.cast("long").alias("n_spans"), empty.cast("string").alias("kept"))
    facts = facts.unionByName(losing.withColumn("first", empty.cast(kind))).groupBy("digest").agg(*[F.max(c).alias(c) for c in ("first", "n_removed", "n_spans", "kept")])
    rows = texts.select("doc_id", "n_bytes", "digest")
    total = equal.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    out = join_skewed(rows, stored(facts, "facts"), "digest", hot_keys(equal, "digest", "n", total))
    able = F.col("doc_id").isNotNull() & (F.col("n_bytes") >= options.length)
    whole = able & F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False))
    some = able & F.col("n_removed").isNotNull()
    pick = lambda all_, part, none: F.when(whole, all_).when(some, part).otherwise(none)
    return out.select(
        "doc_id", "n_bytes", pick(F.col("n_bytes"), F.col("n_removed"), F.lit(0)).cast("long").alias("n_removed"), pick(F.lit(1), F.col("n_spans"), F.lit(0)).cast("long").alias("n_spans"),
        pick(F.lit(hashlib.sha256(b"").hexdigest()), F.col("kept"), F.lower(F.hex("digest"))).alias("kept_sha256"),
    )
