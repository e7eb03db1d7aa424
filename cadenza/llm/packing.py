"""Best-fit packing: token sequences of one size, filled by best fit and then by swaps between underfull bins."""

from __future__ import annotations

import gc
import heapq
import os
import re
import sys
import zlib
from array import array
from collections import defaultdict
from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, stored, utf8

#: Pieces that one task packs at a time.
GROUP = 50_000
#: Times that underfull bins are dealt out anew, among other bins than before.
ROUNDS = 4
#: Bins in a row that can't be emptied before a search gives up.
PATIENCE = 64
#: Parts of texts that a task remembers the ids of, and the longest of them.
MEMORY, REMEMBERED = 1 << 19, 48
#: A space between two visible characters: byte-level BPE always begins a word there, so texts are encoded part by
#: part. It also does so between a letter and such marks, and at a line's first letter.
CUT = re.compile(r"(?<=\S) (?=\S)")
FINE = re.compile(r"(?<=[A-Za-z])(?=[.,;:!?\n])|(?<=\S\n)(?=[A-Za-z])")
#: A word of plain letters, which the model's alphabet writes as they are, with its sign for a space.
PLAIN, SPACE = re.compile(r" ?[A-Za-z]+"), "\u0120"
#: Spaces that aren't such cuts, if the text is ASCII.
OTHER_SPACES = ["  "] + [p for c in "\t\n\r\x0b\x0c\x1c\x1d\x1e\x1f" for p in (" " + c, c + " ")]

_ITEM = "array<struct<doc_id: {id}, piece: int, start: long, length: int, offset: int, ids_crc32: long, ids: binary>>"


class Encoder:
    """Token ids of texts as little-endian unsigned 32-bit numbers.

    Parts between single spaces have ids of their own, whatever stands around them. Those met lately are
    remembered, in two generations, the older of which goes when the younger is full. New ones are cut
    finer: a plain word goes to the model as it is, the rest are encoded together and told apart by the
    bytes that each token stands for.
    """

    def __init__(self, tokenizer: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        if sys.byteorder != "little" or array("I").itemsize != 4:
            raise ValueError("ids are little-endian 32-bit numbers")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(tokenizer)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        vocabulary = self.tokenizer.get_vocab()
        self.bytes = np.zeros(max(vocabulary.values()) + 1, np.int64)
        for token, i in vocabulary.items():
            self.bytes[i] = len(token)  # one character a byte
        self.parts: dict[str, bytes] = {}  # without the space before them
        self.old: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")

    @staticmethod
    def _even(text: str) -> bool:
        """Whether all spaces of a text are cuts, as far as a quick look tells."""
        return text.isascii() and text[:1] != " " and text[-1:] != " " and not any(p in text for p in OTHER_SPACES)

    def _plain(self, word: str) -> bytes:
        """Ids of a word of plain letters, which is one word to the tokenizer, too."""
        return array("I", [t.id for t in self.tokenizer.model.tokenize(word)]).tobytes()

    def _learn(self, parts: list[str]) -> None:
        """Parts that aren't remembered."""
        found, hard = self.parts, []
        for x in parts:
            if (ids := self.old.get(x)) is not None:
                found[x] = ids
            elif x.isascii() and x.isalpha():
                found[x] = self._plain(SPACE + x)
            else:
                hard.append(x)
        fine = [FINE.split(" " + x) for x in hard]
        words, new = self.words, set().union(*fine).difference(self.words)
        spaced = []
        for word in new:
            if PLAIN.fullmatch(word):
                words[word] = self._plain(word.replace(" ", SPACE))
            elif CUT.match("x" + word, 1):
                spaced.append(word)
            else:
                words[word] = self._ids(word).tobytes()
        for i in range(0, len(spaced), 4096):
            self._learn_together(spaced[i : i + 4096])
        for x, p in zip(hard, fine, strict=True):
            found[x] = b"".join(map(words.__getitem__, p))
        for word in new:
            if len(word) > REMEMBERED:
                del words[word]

    def _learn_together(self, words: list[str]) -> None:
        """Words that begin with a space as a cut wants it, so they may stand one after another."""
        ids = self._ids("".join(words))
        ends = np.cumsum([len(x.encode()) for x in words])
        at = np.cumsum(self.bytes[ids])
        cuts = np.searchsorted(at, ends)
        if not (len(at) and cuts[-1] < len(at) and (at[cuts] == ends).all()):
            raise ValueError("the tokenizer's words cross single spaces")
        data, begin = ids.tobytes(), 0
        for x, cut in zip(words, (4 * (cuts + 1)).tolist(), strict=True):
            self.words[x] = data[begin:cut]
            begin = cut

    def __call__(self, texts: list[str]) -> list[bytes]:
        if len(self.parts) > MEMORY:
            self.old, self.parts = self.parts, {}
        if len(self.words) > MEMORY:
            self.words = {}
        get = self.parts.get
        heads, rest, ids, open_ = [], [], [], []
        new: set[str] = set()
        for k, text in enumerate(texts):
            head, *parts = text.split(" ") if self._even(text) else CUT.split(text)
            heads.append(head)
            rest.append(parts)
            found = list(map(get, parts))
            if None in found:
                new.update([x for x, y in zip(parts, found, strict=True) if y is None])
                open_.append(k)
                ids.append(b"")
            else:
                ids.append(b"".join(found))
        self._learn(list(new))
        for k in open_:
            ids[k] = b"".join(map(self.parts.__getitem__, rest[k]))
        for x in new:
            if len(x) > REMEMBERED:
                del self.parts[x]
        return [self._ids(head).tobytes() + x for head, x in zip(heads, ids, strict=True)]


def best_fit(lengths: list[int], size: int) -> list[list[int]]:
    """Bins as lists of items: each item, longest first, goes where it leaves the least room."""
    bins: list[list[int]] = []
    rooms: dict[int, list[int]] = defaultdict(list)
    mask = 0  # bit f: some bin has room f
    for i in sorted(range(len(lengths)), key=lambda k: -lengths[k]):
        n = lengths[i]
        fit = mask >> n
        if fit:
            room = n + (fit & -fit).bit_length() - 1
            b = rooms[room].pop()
            if not rooms[room]:
                mask ^= 1 << room
            bins[b].append(i)
        else:
            room, b = size, len(bins)
            bins.append([i])
        if room > n:
            rooms[room - n].append(b)
            mask |= 1 << (room - n)
    return bins


class Search:
    """Local search over bins: moves and swaps that raise the sum of squared fills, until no bin can be emptied.

    The least filled bin gives: an item that fits elsewhere, one or two items for a shorter one, or one
    for two shorter ones. Whatever it gives makes it emptier and another bin fuller, so each step
    raises the sum and the search ends. It stops early when the bins are as few as their sum allows.
    """

    def __init__(self, bins: list[list[int]], lengths: list[int], size: int):
        self.bins, self.lengths, self.size = bins, lengths, size
        self.fill = [sum(lengths[i] for i in b) for b in bins]
        self.rooms: dict[int, set[int]] = defaultdict(set)
        self.holders: dict[tuple[int, int], set[int]] = defaultdict(set)
        self.mask = 0
        for b in range(len(bins)):
            self._list(b)

    def _list(self, b: int) -> None:
        room = self.size - self.fill[b]
        if room and self.bins[b]:
            self.rooms[room].add(b)
            self.mask |= 1 << room
            for n in {self.lengths[i] for i in self.bins[b]}:
                self.holders[n, room].add(b)

    def _unlist(self, b: int) -> None:
        room = self.size - self.fill[b]
        if b not in self.rooms.get(room, ()):
            return
        self.rooms[room].discard(b)
        if not self.rooms[room]:
            del self.rooms[room]
            self.mask ^= 1 << room
        for n in {self.lengths[i] for i in self.bins[b]}:
            self.holders[n, room].discard(b)
            if not self.holders[n, room]:
                del self.holders[n, room]

    def _swap(self, a: int, give: list[int], b: int, take: list[int]) -> None:
        """Items of these lengths change places; a is not listed."""
        self._unlist(b)
        for source, target, lengths in ((a, b, give), (b, a, take)):
            for n in lengths:
                i = next(i for i in self.bins[source] if self.lengths[i] == n)
                self.bins[source].remove(i)
                self.bins[target].append(i)
                self.fill[source] -= n
                self.fill[target] += n
        self._list(b)

    def _step(self, a: int) -> bool:
        own = sorted({self.lengths[i] for i in self.bins[a]}, reverse=True)
        for n in own:  # moves
            if fit := self.mask >> n:
                room = n + (fit & -fit).bit_length() - 1
                if self.size - room + n > self.fill[a]:
                    self._swap(a, [n], next(iter(self.rooms[room])), [])
                    return True
        if not self.holders:
            return False
        many = defaultdict(int)
        for i in self.bins[a]:
            many[self.lengths[i]] += 1
        gives = [[n] for n in own] + [[m, n] for m, n in combinations(own, 2)] + [[n, n] for n in own if many[n] > 1]
        length, room = np.array(list(self.holders)).T
        best = self._best(np.array([sum(g) for g in gives]), length, room, a)
        if best:
            g, k = best
            self._swap(a, gives[g], next(iter(self.holders[int(length[k]), int(room[k])])), [int(length[k])])
            return True
        for room, some in list(self.rooms.items()):  # one for two
            for b in some:
                have = sorted(self.lengths[i] for i in self.bins[b])
                if len(have) < 2 or have[0] + have[1] >= own[0]:
                    continue
                pairs = [p for p in combinations(have[:64], 2) if p[0] + p[1] < own[0]]
                best = self._best(np.array(own), np.array([sum(p) for p in pairs]), np.full(len(pairs), room), a)
                if best:
                    self._swap(a, [own[best[0]]], b, list(pairs[best[1]]))
                    return True
        return False

    def _best(self, gives: np.ndarray, takes: np.ndarray, room: np.ndarray, a: int) -> tuple[int, int] | None:
        """The swap that raises the squares most."""
        more = gives[:, None] - takes[None, :]
        gain = np.where((more > 0) & (more <= room), more * (self.size - room - self.fill[a] + more), 0)
        at = int(gain.argmax())
        return divmod(at, len(takes)) if gain.flat[at] > 0 else None

    def run(self) -> list[list[int]]:
        alive, total, failed = sum(map(bool, self.bins)), sum(self.fill), 0
        queue = [(f, b) for b, f in enumerate(self.fill) if 0 < f < self.size]
        heapq.heapify(queue)
        while queue and failed < PATIENCE and alive * self.size - total >= self.size:
            f, a = heapq.heappop(queue)
            if f != self.fill[a]:  # has changed since
                if 0 < self.fill[a] < self.size:
                    heapq.heappush(queue, (self.fill[a], a))
                continue
            self._unlist(a)
            while self.bins[a] and self._step(a):
                pass
            if self.bins[a]:
                self._list(a)
                failed += 1
            else:
                alive, failed = alive - 1, 0
        return self.bins


def _emit(numbers: list[int], bins: list[list[int]], items: list[tuple], size: int, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Bins that hold anything as rows, some thousand to a batch; items get their offsets."""
    rows = []
    for number, members in zip(numbers, bins, strict=True):
        if not members:
            continue
        held, at = [], 0
        for i in members:
            doc_id, piece, start, length, crc, ids = items[i]
            held.append({"doc_id": doc_id, "piece": piece, "start": start, "length": length, "offset": at, "ids_crc32": crc, "ids": ids})
            at += length
        rows.append({"bin": number, "fill": at, "items": held})
        if len(rows) >= 2000:
            yield pa.RecordBatch.from_pylist(rows, schema)
            rows = []
    if rows:
        yield pa.RecordBatch.from_pylist(rows, schema)


def _pieces(total: int, size: int) -> Iterator[tuple[int, int]]:
    """(start, length) of a document's pieces: what doesn't fill a sequence comes first."""
    first = total % size
    if first:
        yield 0, first
    for start in range(first, total, size):
        yield start, size


def pack(docs: DataFrame, tokenizer: str, end: int = 2, size: int = 1024, with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset, ids): docs(doc_id, text) in as few sequences as found.

    tokenizer is the file of a byte-level BPE, read on the driver (some MB, sent to each task). A
    document is its ids and `end`; one of over size tokens is cut, the remainder first. Each task
    encodes its texts and packs them, GROUP pieces at a time, by best fit and Search; then underfull
    bins, whole, are dealt out and searched again, until they fit one task, none is emptied, or ROUNDS
    are over. Only lengths and digests travel, with_ids also the ids (null else), from which
    sequences() makes the sequences.

    A null text is empty, an empty one is its end token. Repeated and null ids are documents like
    others. Columns besides doc_id and text are ignored. A bin number is made of the task's, so
    a lost task is run again to the same rows.
    """
    spark = docs.sparkSession
    if size < 1:
        raise ValueError("size must be positive")
    model = spark.sparkContext.broadcast({"tokenizer": open(tokenizer, encoding="utf-8").read()})
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"bin long, fill int, items {_ITEM.format(id=kind)}"
    arrow = _arrow(spark, schema)
    small_batches(spark)

    def encode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = model.value  # a Python worker keeps it from task to task, and with it the parts that it has met
        if "encoder" not in held:
            held["encoder"] = Encoder(held["tokenizer"])
        encoder, tail = held["encoder"], np.array([end], "<u4").tobytes()
        number = TaskContext.get().partitionId() << 40
        items: list[tuple] = []

        def packed() -> Iterator[pa.RecordBatch]:
            nonlocal number, items
            whole = [[i] for i, x in enumerate(items) if x[3] == size]
            part = [i for i, x in enumerate(items) if x[3] < size]
            lengths = [items[i][3] for i in part]
            bins = Search(best_fit(lengths, size), lengths, size).run()
            bins = whole + [[part[i] for i in b] for b in bins]
            yield from _emit(list(range(number, number + len(bins))), bins, items, size, arrow)
            number, items = number + len(bins), []

        gc.disable()  # many small objects live long, none of them in cycles
        try:
            for batch in batches:
                ids = encoder([x.decode() for x in utf8(batch.column(1))])
                for doc_id, mine in zip(batch.column(0).to_pylist(), ids, strict=True):
                    mine += tail
                    for piece, (start, length) in enumerate(_pieces(len(mine) // 4, size)):
                        cut = mine[4 * start : 4 * (start + length)]
                        items.append((doc_id, piece, start, length, zlib.crc32(cut), cut if with_ids else None))
                    if len(items) >= GROUP:
                        yield from packed()
            yield from packed()
        finally:
            gc.enable()

    def again(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers: list[int] = []
        bins: list[list[int]] = []
        items: list[tuple] = []

        def searched() -> Iterator[pa.RecordBatch]:
            yield from _emit(numbers, Search(bins, [x[3] for x in items], size).run(), items, size, arrow)

        for batch in batches:
            for number, held in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                bins.append(list(range(len(items), len(items) + len(held))))
                numbers.append(number)
                items += [(x["doc_id"], x["piece"], x["start"], x["length"], x["ids_crc32"], x["ids"]) for x in held]
            if len(items) >= 2 * GROUP:
                yield from searched()
                numbers, bins, items = [], [], []
        yield from searched()

    found = stored(docs.select("doc_id", F.col("text").cast("string")).mapInArrow(encode, schema), "packed")
    done = []
    for turn in range(ROUNDS):
        open_bins = found.where(F.col("fill") < size)
        n_bins, n_items, held = open_bins.agg(F.count(F.lit(1)), F.sum(F.size("items")), F.sum("fill")).first()
        if n_bins * size - (held or 0) < size:
            break
        done.append(found.where(F.col("fill") == size))
        groups = -(-n_items // GROUP)
        dealt = open_bins.repartition(groups, F.xxhash64("bin", F.lit(turn))) if groups > 1 else open_bins.repartition(1)
        found = stored(dealt.mapInArrow(again, schema), "packed")
        if groups == 1 or found.count() == n_bins:
            break
    for df in done:
        found = found.unionByName(df)
    item = F.col("item")
    return found.select("bin", F.explode("items").alias("item")).select(
        *[item[c].alias(c) for c in ("doc_id", "piece", "start")], item["length"].cast("long").alias("length"), item["ids_crc32"].alias("ids_crc32"),
        F.col("bin").alias("sequence_id"), item["offset"].cast("long").alias("offset"), item["ids"].alias("ids"),
    )


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, length, ids, doc_ids, starts): pack(..., with_ids=True) as sequences to train on.

    ids are little-endian unsigned 32-bit numbers; doc_ids and starts tell which document holds the
    tokens from each offset on. A sequence is a bounded group: `size` tokens.
    """
    parts = F.array_sort(F.collect_list(F.struct("offset", "length", "doc_id", "ids")))
    rows = packed.groupBy("sequence_id").agg(parts.alias("parts"))
    joined = F.unhex(F.array_join(F.transform("parts", lambda p: F.hex(p["ids"])), ""))
    return rows.select("sequence_id", F.aggregate("parts", F.lit(0).cast("long"), lambda n, p: n + p["length"]).alias("length"), joined.alias("ids"), F.col("parts.doc_id").alias("doc_ids"), F.col("parts.offset").alias("starts"))


def _arrow(spark, schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    return to_arrow_schema(_parse_datatype_string(schema))
