"""Class-based language model: exchange clustering, class transitions and word emissions."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import parts_for, small_batches, stored, utf8

#: The token that ends every text; no word holds a blank.
END = "\n"


@dataclass(frozen=True)
class Options:
    """Exchange starts on the driver with the head words, whose table is bounded, and then takes in all others."""

    head: int = 2048
    classes: int = 48
    rounds: int = 6
    #: Sweeps of the exchange over all words that aren't in the head.
    sweeps: int = 1
    #: Commonest words whose counts and classes are broadcast; those of all others come by a join. It changes no result
    #: unless there are several sweeps: between them neighbours of other words are left out.
    sent: int = 100_000
    #: Added to each count of a class transition.
    prior: float = 0.5
    #: Distinct words (or pairs) that a task adds up before it passes them on.
    held: int = 200_000
    #: Tokens whose neighbours a task adds up before it passes them on.
    tokens: int = 3_000_000


def words_of(text: bytes) -> list[bytes]:
    return text.lower().split()


def _summed(texts: Iterator[pa.RecordBatch], parts_of, held: int) -> Iterator[tuple[list, list]]:
    """(keys, counts) of what parts_of(text) yields, added up over many texts."""
    counts: Counter = Counter()
    for batch in texts:
        for text in utf8(batch.column(0)):
            counts.update(parts_of(text))
        if len(counts) > held:
            yield list(counts), list(counts.values())
            counts = Counter()
    if counts:
        yield list(counts), list(counts.values())


def vocabulary(train: DataFrame, options: Options) -> DataFrame:
    """(word, n) of all words of train(text), the end of texts included."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for keys, n in _summed(batches, lambda t: [*words_of(t), END.encode()], options.held):
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()).cast(pa.string()), pa.array(n, pa.int64())], ["word", "n"])

    return train.select("text").mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def pair_counts(train: DataFrame, ids: dict[bytes, int], size: int, options: Options) -> np.ndarray:
    """Counts of neighbouring ids over all of train, as a table of size x size; size is bounded by the head."""
    sent = train.sparkSession.sparkContext.broadcast(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        get, row, counts = sent.value.get, [0], np.zeros(size * size, np.int64)

        def counted() -> np.ndarray:
            c = np.array(row, np.int64)
            return np.bincount(c[:-1] * size + c[1:], minlength=size * size)

        for batch in batches:
            for text in utf8(batch.column(0)):
                row += [get(w, 1) for w in words_of(text)]
                row.append(0)
            if len(row) > options.tokens:
                counts += counted()
                row = [0]
        counts += counted()
        pair = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(pair), pa.array(counts[pair])], ["pair", "n"])

    found = train.select("text").mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).toArrow()
    table = np.zeros(size * size)
    table[found["pair"].to_numpy()] = found["n"].to_numpy()
    return table.reshape(size, size)


def _f(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1))


def exchange(pairs: np.ndarray, classes: int, rounds: int) -> np.ndarray:
    """Class of each id: 0 (end) and 1 (other words) keep their own, the rest move to the class that gains most.

    The gain is that of the mutual information of neighbouring classes. Words start dealt by rank;
    a round that moves nothing ends the search.
    """
    n = len(pairs)
    k = 2 + min(classes, max(n - 2, 0))
    label = np.concatenate([[0, 1], 2 + np.arange(n - 2) % max(k - 2, 1)]).astype(np.int64)
    for _ in range(rounds):
        moved = 0
        of = np.zeros((n, k))
        of[np.arange(n), label] = 1
        cells = of.T @ pairs @ of
        for w in range(2, n):
            old, own = label[w], pairs[w, w]
            after = np.bincount(label, pairs[w], k)
            before = np.bincount(label, pairs[:, w], k)
            after[old] -= own
            before[old] -= own
            cells[old] -= after
            cells[:, old] -= before
            cells[old, old] -= own
            gain = _f(cells + after).sum(1) - _f(cells).sum(1) + _f(cells + before[:, None]).sum(0) - _f(cells).sum(0)
            d = np.diagonal(cells)
            gain += _f(d + after + before + own) - _f(d + after) - _f(d + before) + _f(d)
            rows, columns = cells.sum(1), cells.sum(0)
            gain -= _f(rows + after.sum() + own) - _f(rows) + _f(columns + before.sum() + own) - _f(columns)
            new = 2 + int(gain[2:].argmax())
            if gain[new] <= gain[old] + 1e-9:
                new = old
            moved += new != old
            label[w] = new
            cells[new] += after
            cells[:, new] += before
            cells[new, new] += own
        if not moved:
            break
    return label


SIDE = 64  # codes of a word's neighbours: their class before it, SIDE + their class after it


class Classes:
    """words(word, n, class) of the training rows, the commonest of them, and their numbers.

    Class 0 is the end, 1 an unseen word. label and counts have the commonest words, which travel by
    broadcast; a seen word has its share of its class, an unseen one as much as one of all words.
    """

    def __init__(self, words: DataFrame, label: dict[bytes, int], counts: dict[bytes, int], total: int, distinct: int, once: int, per_class: np.ndarray):
        self.words, self.label, self.counts, self.total, self.distinct = words, label, counts, total, distinct
        self.log_class = np.log10(np.maximum(per_class, 1))
        self.unseen = -float(np.log10(distinct + 1))
        self.new = (once + 1) / (total + 2)
        self.end_count = counts.get(END.encode(), 0)


class Model(Classes):
    """Classes and move[a, b], log10 of P(b | a), from the neighbours of all training tokens; the share of unseen words is that of tokens seen once."""

    def __init__(self, classes: Classes, move: np.ndarray):
        self.__dict__.update(classes.__dict__)
        self.move = move


class _Ids(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def _sequences(batches: Iterator[pa.RecordBatch], label: dict[bytes, int], tokens: int) -> Iterator[tuple[list[bytes], np.ndarray, np.ndarray]]:
    """(words, sequence of their numbers with an end before and after each text, classes by number) of many texts at a time."""

    def made():
        known = [label.get(w, 1) for w in ids]
        return list(ids), np.array(row, np.int64), np.array([0, *known[1:]], np.int64)

    ids, row = _Ids({END.encode(): 0}), [0]
    for batch in batches:
        for text in utf8(batch.column(0)):
            row += map(ids.__getitem__, words_of(text))
            row.append(0)
            if len(row) > tokens:
                yield made()
                ids, row = _Ids({END.encode(): 0}), [0]
    if len(row) > 1:
        yield made()


def class_cells(train: DataFrame, label: dict[bytes, int], k: int, options: Options) -> np.ndarray:
    """Counts [k, k] of neighbouring classes, of words that label has a class for: what a further sweep starts from."""
    sent = train.sparkSession.sparkContext.broadcast(label)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        cells = np.zeros(k * k, np.int64)
        for _, row, known in _sequences(batches, sent.value, options.tokens):
            c = known[row]
            cells += np.bincount(c[:-1] * k + c[1:], minlength=k * k)
        cell = np.flatnonzero(cells)
        yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(cells[cell])], ["cell", "n"])

    out = np.zeros(k * k)
    for r in train.select("text").mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect():
        out[r.cell] = r.n
    out = out.reshape(k, k)
    out[1], out[:, 1] = 0, 0
    return out


def contexts(train: DataFrame, label: dict[bytes, int], options: Options) -> DataFrame:
    """(word, codes): how often a word has which class of word before and after it, packed and still in parts."""
    sent = train.sparkSession.sparkContext.broadcast(label)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for words, row, known in _sequences(batches, sent.value, options.tokens):
            c = known[row]
            code, n = np.unique(np.concatenate([row[1:] * (2 * SIDE) + c[:-1], row[:-1] * (2 * SIDE) + SIDE + c[1:]]), return_counts=True)
            packed = ((code % (2 * SIDE)) << 56 | n).astype("<i8")
            edges = np.searchsorted(code // (2 * SIDE), np.arange(len(words) + 1))
            for a in range(1, len(words), 20_000):
                b = min(a + 20_000, len(words))
                own = packed[edges[a] : edges[b]].tobytes()
                at = pa.array((edges[a : b + 1] - edges[a]).astype(np.int32) * 8)
                codes = pa.Array.from_buffers(pa.binary(), b - a, [None, at.buffers()[1], pa.py_buffer(own)])
                yield pa.RecordBatch.from_arrays([pa.array(words[a:b], pa.binary()).cast(pa.string()), codes], ["word", "codes"])

    return train.select("text").mapInArrow(run, "word string, codes binary")


def best_classes(word: np.ndarray, code: np.ndarray, n: np.ndarray, m: int, cells: np.ndarray, old: np.ndarray) -> np.ndarray:
    """The class of each of m words that gains most by its neighbours (word number, code, count), sorted by word.

    The gain is that of the mutual information of neighbouring classes; a word is first taken out of
    the class it is in (old, 0 if none). Words that are neighbours of their own count as such once.
    """
    k = len(cells)
    side, c = code >= SIDE, code % SIDE
    rows, columns = cells.sum(1), cells.sum(0)
    # what a class of words would have after and before it
    table = np.where(side[:, None], cells[:, c].T, cells[c])
    inside = (np.arange(k)[None] == old[word][:, None]) * n[:, None].astype(float)
    table = np.maximum(table - inside, 0)
    gain = np.zeros((m, k))
    if len(word):
        first = np.flatnonzero(np.diff(word, prepend=-1))
        gain[word[first]] = np.add.reduceat(_f(table + n[:, None]) - _f(table), first, axis=0)
    for of_side, sums in ((True, rows), (False, columns)):
        own = np.bincount(word[side == of_side], n[side == of_side], m)
        left = np.maximum(sums[None] - (np.arange(k)[None] == old[:, None]) * own[:, None], 0)
        gain -= _f(left + own[:, None]) - _f(left)
    return 2 + gain[:, 2:].argmax(1)


def swept(train: DataFrame, label: dict[bytes, int], fixed: set[bytes], cells: np.ndarray, options: Options, n_words: int) -> DataFrame:
    """(word, class) of all words but the fixed ones, each moved to the class that gains most while all others stay."""
    sent = train.sparkSession.sparkContext.broadcast((label, fixed, cells))

    def classes(words: list[str], codes: list[list[bytes]]) -> pa.RecordBatch:
        label, fixed, cells = sent.value
        word = np.repeat(np.arange(len(words)), [sum(map(len, x)) // 8 for x in codes])
        packed = np.frombuffer(b"".join(b"".join(x) for x in codes), "<i8")
        pair, inverse = np.unique(word * (2 * SIDE) + (packed >> 56), return_inverse=True)
        n = np.bincount(inverse, (packed & ((1 << 56) - 1)).astype(float), len(pair))
        names = [w.encode() for w in words]
        old = np.array([label.get(w, 0) for w in names])
        new = best_classes(pair // (2 * SIDE), pair % (2 * SIDE), n, len(words), cells, old)
        new = np.array([o if w in fixed else c for w, o, c in zip(names, old.tolist(), new.tolist())], np.int32)
        return pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(new)], ["word", "class"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        words: list[str] = []
        codes: list[list[bytes]] = []
        for batch in batches:
            for w, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if words and words[-1] == w:
                    codes[-1].append(x)
                    continue
                if len(words) == 8192:
                    yield classes(words, codes)
                    words, codes = [], []
                words.append(w)
                codes.append([x])
        if words:
            yield classes(words, codes)

    parts = parts_for(n_words, 500_000, train.sparkSession)
    return contexts(train, label, options).repartition(parts, "word").sortWithinPartitions("word").mapInArrow(run, "word string, class int")


def classes(train: DataFrame, options: Options = Options()) -> Classes:
    """Classes of all words of train(text): the head's by exchange, all others' by sweeps over the neighbours of all their occurrences."""
    small_batches(train.sparkSession)
    words = stored(vocabulary(train, options), "words")
    total, distinct, once = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1)), F.count_if(F.col("n") == 1)).first()
    common = words.orderBy(F.desc("n"), "word").limit(options.sent + 1).toArrow().to_pydict()
    counts = {w.encode(): n for w, n in zip(common["word"], common["n"])}
    head = [w for w in counts if w != END.encode()][: options.head]
    ids = {w: i + 2 for i, w in enumerate(head)}
    pairs = pair_counts(train, ids, len(head) + 2, options)
    labels = exchange(pairs, min(options.classes, SIDE - 2), options.rounds)
    k = max(int(labels.max()) + 1, 3)
    of = np.zeros((len(labels), k))
    of[np.arange(len(labels)), labels] = 1
    cells = of.T @ pairs @ of
    label = {w: int(labels[i]) for w, i in ids.items()}
    fixed, known = set(label), words.where(F.col("word") != END)
    found = words.sparkSession.createDataFrame([(w.decode(), c) for w, c in label.items()], "word string, class int")
    if distinct > len(head) + 1:
        for sweep in range(max(options.sweeps, 1)):
            if sweep:
                cells = class_cells(train, label, k, options)
            found = stored(swept(train, label, fixed, cells, options, distinct), "classes")
            some = found.join(F.broadcast(words.sparkSession.createDataFrame([(w.decode(),) for w in counts], "word string")), "word").toArrow().to_pydict()
            label = {w.encode(): c for w, c in zip(some["word"], some["class"])}
    known = stored(known.join(found, "word"), "known")
    per_class = np.zeros(k)
    for r in known.groupBy("class").agg(F.sum("n").alias("n")).collect():
        per_class[r["class"]] = r.n
    return Classes(known, label, counts, total, distinct, once, per_class)


def transitions(rows: DataFrame, found: Classes, options: Options = Options()) -> np.ndarray:
    """log10 of P(class | class before) from all neighbours in rows(codes) of resolved(): only a table of classes comes to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        cells = np.zeros(SIDE * SIDE, np.int64)
        for batch in batches:
            cells += np.bincount(np.frombuffer(b"".join(utf8(batch.column(0))), "<u2"), minlength=SIDE * SIDE)
        cell = np.flatnonzero(cells)
        yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(cells[cell])], ["cell", "n"])

    k = len(found.log_class)
    cells = np.zeros((SIDE, SIDE))
    for r in rows.select("codes").mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect():
        cells[divmod(r.cell, SIDE)] = r.n
    cells = cells[:k, :k] + options.prior
    cells[:, 1] = 0
    move = (1 - found.new) * cells / cells.sum(1, keepdims=True)
    move[:, 1] = found.new
    return np.log10(move)


def fit(train: DataFrame, options: Options = Options()) -> Model:
    """Classes of all words of train(text), and the class-based model that they make."""
    found = classes(train, options)
    base = train.select(F.lit(0).alias("doc_id"), "text", F.lit(False).alias("held_out"))
    return Model(found, transitions(resolved(base, found), found, options))


def score(docs: DataFrame, held_out: Column, options: Options = Options()) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) for every row of docs(doc_id, text).

    The model learns from all rows that aren't held_out. base_score adds up log10((c + 1) / (N + V + 1)).
    score adds up log10 of P(class | class before) P(word | class). Every training word has a class: the
    head's are exchanged until nothing moves, then all others move to the class that gains most by the
    neighbours of all their occurrences; transitions are counted over all neighbours. Unseen words share
    a class. A null or empty text is one end token. Repeated rows each get a result and teach again;
    other columns are not read. Nothing to learn from leaves even distributions; an empty table gives
    no rows.
    """
    small_batches(docs.sparkSession)
    base = docs.select("doc_id", F.col("text").cast("string").alias("text"), held_out.alias("held_out"))
    found = classes(base.where(~F.col("held_out")), options)
    rows = resolved(base, found)
    return summed(rows, Model(found, transitions(rows.where(~F.col("held_out")), found, options)))


def scored(base: DataFrame, model: Model) -> DataFrame:
    """base(doc_id, text, held_out) scored by the model."""
    return summed(resolved(base, model), model)


def resolved(base: DataFrame, model: Classes) -> DataFrame:
    """base(doc_id, text, held_out) as (doc_id, held_out, n_tokens, n_known, base, score, codes), written.

    codes has each step of a text as SIDE * class + class after it; score has what words add to it.
    Steps between words whose classes are broadcast are known at once. Those that meet any other word
    stay open: the word's count and class come by a join of the distinct words of texts.
    """
    spark = base.sparkSession
    kind = dict(base.dtypes)["doc_id"]
    known = {w: i for i, w in enumerate(w for w in model.label if w in model.counts)}
    label = np.array([model.label[w] for w in known], np.int64)
    counted = np.array([model.counts[w] for w in known], float)
    whole = len(known) + (model.end_count > 0) >= model.distinct
    log_class, unseen = model.log_class, model.unseen
    sent = spark.sparkContext.broadcast((known, label, np.log10(counted) - log_class[label], np.log10(counted + 1)))
    end, ended = float(np.log10(model.end_count + 1)), int(model.end_count > 0)
    names = ["doc_id", "held_out", "n_tokens", "n_known", "base", "score", "codes", "asks", "asked", "open"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        known, label, emit, logs = sent.value
        get = known.get
        for batch in batches:
            rows = []
            for text in utf8(batch.column(1)):
                found = words_of(text)
                number = np.array([get(w, -1) for w in found], np.int64)
                have = number >= 0
                some = number[have]
                value, sums, n_known = float(emit[some].sum()), end + float(logs[some].sum()), ended + len(some)
                at = np.zeros(len(found) + 2, np.int64)
                at[1:-1][have] = label[some]
                asks: dict[bytes, int] = {}
                open_ = np.flatnonzero(~have).tolist()
                which = [asks.setdefault(found[i], len(asks)) for i in open_]
                asked = np.bincount(which, minlength=len(asks)).tolist() if asks else []
                if asks:
                    at[1:-1][~have] = SIDE + np.array(which, np.int64)
                before, after = at[:-1], at[1:]
                if whole:  # what is not known was never seen
                    before, after = np.where(before >= SIDE, 1, before), np.where(after >= SIDE, 1, after)
                    value += unseen * sum(asked)
                    asks, asked = {}, []
                settled = (before < SIDE) & (after < SIDE)
                codes = (before[settled] * SIDE + after[settled]).astype("<u2").tobytes()
                rows.append((len(found) + 1, n_known, sums, value, codes, [w.decode() for w in asks], asked, (before[~settled] << 32 | after[~settled]).tolist()))
            columns = list(zip(*rows)) or [()] * 8
            types = [pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.binary(), pa.list_(pa.string()), pa.list_(pa.int32()), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), *(pa.array(c, t) for c, t in zip(columns, types))], names)

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        def lists(column: pa.Array) -> Iterator[np.ndarray]:
            at, values = column.offsets.to_numpy(), column.values.to_numpy()
            return (values[a:b] for a, b in zip(at, at[1:]))

        for batch in batches:
            c = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
            all_codes = []
            for codes, n, steps, words, found in zip(c["codes"].to_pylist(), c["words"].to_pylist(), lists(c["open"]), lists(c["which"]), lists(c["classes"])):
                label = np.ones(SIDE + n, np.int64)
                label[:SIDE] = np.arange(SIDE)
                label[SIDE + words] = found
                all_codes.append(codes + (label[steps >> 32] * SIDE + label[steps & 0xFFFFFFFF]).astype("<u2").tobytes())
            yield pa.RecordBatch.from_arrays([*(c[n] for n in names[:6]), pa.array(all_codes, pa.binary())], names[:7])

    plain = f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, base double, score double, codes binary"
    out = base.select("doc_id", "text", "held_out").mapInArrow(run, f"{plain}, asks array<string>, asked array<int>, open array<long>")
    if whole:
        return stored(out.select(*names[:7]), "resolved")
    # no word that is asked for holds more than 1 / sent of all tokens
    out = stored(out.withColumn("row", F.monotonically_increasing_id()), "scored")
    asks = out.select("row", F.posexplode("asks").alias("i", "word"), "asked").select("row", "i", "word", F.element_at("asked", F.col("i") + 1).alias("m"))
    share = F.log10("n") - F.element_at(F.array(*map(F.lit, log_class.tolist())), F.col("class") + 1)
    found = asks.join(model.words, "word").groupBy("row").agg(
        F.sum("m").alias("more"), F.sum(F.col("m") * F.log10(F.col("n") + 1.0)).alias("sums"), F.sum(F.col("m") * share).alias("shares"), F.collect_list(F.struct("i", "class")).alias("found")
    )
    out = out.join(found, "row", "left").na.fill(0, ["more", "sums", "shares"])
    unknown = F.aggregate("asked", F.lit(0).cast("long"), lambda s, x: s + x) - F.col("more")
    out = out.withColumns({"n_known": F.col("n_known") + F.col("more"), "base": F.col("base") + F.col("sums"), "score": F.col("score") + F.col("shares") + unknown * unseen})
    empty = F.array().cast("array<int>")
    which = F.coalesce(F.transform("found", lambda x: x["i"]), empty).alias("which")
    of = F.coalesce(F.transform("found", lambda x: x["class"]), empty).alias("classes")
    return stored(out.select(*names[:7], F.size("asked").alias("words"), "open", which, of).mapInArrow(settle, plain), "resolved")


def summed(rows: DataFrame, model: Model) -> DataFrame:
    """rows of resolved() with their scores: what words and steps add up to."""
    kind = dict(rows.dtypes)["doc_id"]
    table = np.zeros((SIDE, SIDE))
    table[: len(model.move), : len(model.move)] = model.move
    flat = table.ravel()

    def add(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for batch in batches:
            steps = np.array([flat[np.frombuffer(x, "<u2")].sum() for x in batch.column(6).to_pylist()], float)
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(5)), pa.array(batch.column(5).to_numpy() + steps)], batch.schema.names[:6])

    plain = f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, base double, score double"
    out = rows.select("doc_id", "held_out", "n_tokens", "n_known", "base", "score", "codes").mapInArrow(add, plain)
    return out.select(
        "doc_id", "held_out", "n_tokens", "n_known", F.lit(model.total).cast("long").alias("train_tokens"),
        (F.col("base") - F.col("n_tokens") * float(np.log10(model.total + model.distinct + 1))).alias("base_score"), "score",
    )
