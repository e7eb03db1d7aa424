"""Phrase collocations: Apriori passes over the pieces of texts, one a level, and scores from the level tables."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import small_batches, stored, utf8

#: Words that a task counts at a time before it passes sums on.
WORDS = 1_000_000
#: Bits for each frequent gram in a level's filter, and the most bits that it may have: 32 MB are broadcast at most.
BITS, MOST_BITS = 16, 1 << 28
#: Multipliers of the word hashes in a gram's, and of its second probe. Any odd numbers do.
MIX, PROBE = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F
#: A-Z as a-z, and what ends a piece as a full stop that is a word of its own. Fixed values.
_LOWER = bytes.maketrans(bytes(range(65, 91)) + b",;:!?\n\x0b\x0c\r", bytes(range(97, 123)) + b"." * 9)


def _words(text: bytes) -> list[bytes]:
    """Lower-cased words, with b"." between pieces."""
    return text.translate(_LOWER).replace(b".", b" . ").split()


def _word_hash(lang: bytes, word: bytes) -> int:
    return xxhash.xxh64_intdigest(lang + b"\n" + word)


def _extend(h: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Hashes of grams that go on by one word."""
    h = (h ^ (h >> np.uint64(31))) * np.uint64(MIX) + words
    return h ^ (h >> np.uint64(29))


def _slots(h: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The two bits of each hash in a filter of so many bits, a power of two."""
    top = np.uint64(64 - (bits.bit_length() - 1))
    return (h * np.uint64(MIX)) >> top, ((h ^ (h >> np.uint64(32))) * np.uint64(PROBE)) >> top


class Frequent:
    """A filter of the frequent grams of a level: none is missed, and one that is not frequent passes seldom.

    A gram that passes wrongly is counted in vain and dropped by its count, so results don't depend on
    the filter. Its size follows the level but never passes MOST_BITS, which bounds the broadcast.
    """

    def __init__(self, data: np.ndarray):
        self.data = data

    def has(self, h: np.ndarray) -> np.ndarray:
        out = np.ones(len(h), bool)
        for at in _slots(h, 8 * len(self.data)):
            out &= (self.data[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & np.uint8(1) > 0
        return out


def frequent_bits(level: DataFrame, n: int) -> np.ndarray:
    """The bits of the filter of the n grams of level(lang, phrase), made in Spark: only its bits come to the driver."""
    bits = min(MOST_BITS, 1 << max(16, (BITS * n - 1).bit_length()))

    def slots(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes = []
            for lang, phrase in zip(utf8(batch.column(0)), utf8(batch.column(1)), strict=True):
                words = np.array([[_word_hash(lang, w)] for w in phrase.split(b" ")], np.uint64)
                h = words[0]
                for w in words[1:]:
                    h = _extend(h, w)
                hashes.append(h[0])
            both = np.concatenate(_slots(np.array(hashes, np.uint64), bits)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(both + 1)], ["slot"])

    found = level.select("lang", "phrase").mapInArrow(slots, "slot long")
    blocks = found.groupBy(F.bitmap_bucket_number("slot").alias("block")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("slot")).alias("bits"))
    out = np.zeros(bits // 8, np.uint8)
    for block, data in blocks.toLocalIterator():
        at = (block - 1) * 4096
        out[at : at + 4096] |= np.frombuffer(data, np.uint8)[: len(out) - at]
    return out


def _chunks(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[bytes, list[bytes]]]:
    """(language, words) of some texts at a time; a full stop stands between pieces and texts."""
    held: dict[bytes, list[bytes]] = {}
    n = 0
    for batch in batches:
        for lang, text in zip(utf8(batch.column(0)), utf8(batch.column(1)), strict=True):
            words = _words(text)
            words.append(b".")
            held.setdefault(lang, []).extend(words)
            n += len(words)
            if n >= WORDS:
                yield from held.items()
                held, n = {}, 0
    yield from held.items()


def _numbered(words: list[bytes]) -> tuple[np.ndarray, list[bytes]]:
    """Words as numbers, and the words by number; 0 is the full stop."""
    number = {b".": 0}
    return np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words)), list(number)


def _counted(lang: bytes, phrases: list[bytes], counts: np.ndarray) -> pa.RecordBatch:
    text = pa.array(phrases, pa.binary()).cast(pa.string())
    return pa.RecordBatch.from_arrays([pa.array([lang.decode()] * len(phrases), pa.string()), text, pa.array(counts, pa.int64())], ["lang", "phrase", "n"])


def count_words(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, phrase, n) of single words; a null phrase has the number of all."""
    for lang, words in _chunks(batches):
        at, names = _numbered(words)
        counts = np.bincount(at, minlength=len(names))[1:]
        yield _counted(lang, [*names[1:], None], np.append(counts, counts.sum()))


def count_grams(size: int, known: Frequent, batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, phrase, n) of grams of `size` words both of whose subgrams of one word less may be frequent."""
    for lang, words in _chunks(batches):
        at, names = _numbered(words)
        one = np.array([0] + [_word_hash(lang, w) for w in names[1:]], np.uint64)[at]
        inside = at > 0
        h, n = one, len(at)
        for k in range(1, size - 1):
            h = _extend(h[: n - k], one[k:])
            inside = inside[: n - k] & (at[k:] > 0)
        ok = np.zeros(len(h), bool)
        ok[inside] = known.has(h[inside])
        first = np.flatnonzero(ok[:-1] & ok[1:])
        if not len(first):
            continue
        gram = at[first]
        for k in range(1, size):  # exact: the number of what goes before, then the word
            _, place, gram, counts = np.unique(gram * len(names) + at[first + k], return_index=True, return_inverse=True, return_counts=True)
        begin = first[place].tolist()
        for i in range(0, len(begin), 100_000):
            phrases = [b" ".join(words[b : b + size]) for b in begin[i : i + 100_000]]
            yield _counted(lang, phrases, counts[i : i + 100_000])


def collocations(docs: DataFrame, most: int = 3, least: int = 10, inside: int = 50, top: int = 2000) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score) of each language's first `top` phrases of 2 to `most` words.

    docs(text, lang): A-Z are lower-cased, texts end pieces at .,;:!? and line ends, and words stand
    between blanks and tabs. a = occurrences of the phrase within pieces, `least` or more; n = those of all
    words of the language. A phrase's score is the lowest over its cuts, floor(1000000 a a / (l r)) with
    the occurrences l and r of its two parts, the first such cut in case of ties. Phrases lose their
    place to a longer one around them that has `inside` percent of their occurrences.

    A pass over the texts a level: a gram is counted only if both grams of one word less in it pass the
    filter of frequent ones, which is broadcast and bounded; see Frequent. Sums travel, chunk by chunk
    and combined before the shuffle, so a frequent phrase is a row a task. Cuts join the level tables.

    Null and empty texts have no words. A null language is `und`, so is a language named so. Repeated rows
    count again; other columns are ignored; without candidates there are no rows.
    """
    spark = docs.sparkSession
    small_batches(spark)
    texts = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("string").alias("text"))
    summed = lambda df: df.groupBy("lang", "phrase").agg(F.sum("n").alias("n")).where((F.col("n") >= least) | F.col("phrase").isNull())
    level = stored(summed(texts.mapInArrow(count_words, "lang string, phrase string, n long")), "level")
    totals = level.where("phrase is null").select("lang", "n")
    levels = [level.where("phrase is not null")]
    for size in range(2, most + 1):
        found = levels[-1].count()
        if not found:
            break
        known = spark.sparkContext.broadcast(frequent_bits(levels[-1], found))

        def grams(batches: Iterable[pa.RecordBatch], size: int = size, known=known) -> Iterator[pa.RecordBatch]:
            yield from count_grams(size, Frequent(known.value), batches)

        levels.append(stored(summed(texts.mapInArrow(grams, "lang string, phrase string, n long")), "level"))
    return _ranked(levels, totals, inside, top)


def _part(words: Column, begin: Column | int, n: Column | int) -> Column:
    return F.array_join(F.slice(words, begin, n), " ")


def _ranked(levels: list[DataFrame], totals: DataFrame, inside: int, top: int) -> DataFrame:
    parts = levels[0]
    for level in levels[1:]:
        parts = parts.unionByName(level)
    if len(levels) < 2:
        longer = levels[0].where("false")
    else:
        longer = levels[1]
        for level in levels[2:]:
            longer = longer.unionByName(level)
    words = F.split("phrase", " ", -1)
    grams = longer.select("lang", "phrase", F.col("n").alias("a"), words.alias("words"))
    # what each candidate is cut into, and the parts' counts
    cut = grams.select("lang", "phrase", "a", "words", F.explode(F.sequence(F.lit(1), F.size("words") - 1)).alias("k"))
    cut = cut.select("lang", "phrase", "a", "k", _part(F.col("words"), 1, F.col("k")).alias("left"), _part(F.col("words"), F.col("k") + 1, F.size("words")).alias("right"))
    cut = cut.join(parts.select("lang", F.col("phrase").alias("left"), F.col("n").alias("l")), ["lang", "left"])
    cut = cut.join(parts.select("lang", F.col("phrase").alias("right"), F.col("n").alias("r")), ["lang", "right"])
    wide = lambda c: F.col(c).cast("decimal(19,0)")
    cut = cut.withColumn("up", (F.lit(1_000_000).cast("decimal(7,0)") * (wide("a") * wide("a")).cast("decimal(31,0)")).cast("decimal(38,0)"))
    cut = cut.withColumn("score", F.expr("up div (cast(l as decimal(19,0)) * cast(r as decimal(19,0)))"))
    scored = cut.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    # what longer candidates hold
    span = lambda n: F.transform(F.sequence(F.lit(1), F.size("words") - n + 1), lambda i: _part(F.col("words"), i, n))
    within = grams.where(F.size("words") > 2).select("lang", "a", F.explode(F.flatten(F.transform(F.sequence(F.lit(2), F.size("words") - 1), span))).alias("phrase"))
    within = within.groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    kept = scored.join(within, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (F.col("longer") * 100 < F.col("a") * inside))
    kept = kept.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    best = kept.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return best.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


ORACLE_SQL = r"""
with pieces as (select coalesce(lang, 'und') as lang, unnest(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\n\x0B\x0C\r]')) as piece from documents),
split as (select lang, list_filter(regexp_split_to_array(piece, '[ \t]+'), lambda x: x <> '') as w from pieces),
places as (select lang, w, unnest(range(1, len(w) + 1)) as i from split),
grams as (select lang, size, array_to_string(w[i:i + size - 1], ' ') as phrase, count(*) as f from places, (values (1), (2), (3)) s(size) where i + size - 1 <= len(w) group by all),
totals as (select lang, sum(f)::bigint as n from grams where size = 1 group by lang),
cand as (select lang, size, phrase, f as a, string_split(phrase, ' ') as w from grams where size > 1 and f >= 10),
cuts as (select *, unnest(range(1, size)) as k from cand),
scored as (select c.lang, c.size, c.phrase, c.a, k, x.f as l, y.f as r, (1000000::hugeint * c.a * c.a // (x.f::hugeint * y.f))::bigint as score
  from cuts c join grams x on x.lang = c.lang and x.phrase = array_to_string(w[1:k], ' ') and x.size = k join grams y on y.lang = c.lang and y.phrase = array_to_string(w[k + 1:], ' ') and y.size = c.size - k),
lowest as (select * from scored qualify row_number() over (partition by lang, phrase order by score, k) = 1),
kept as (select * from lowest s where not exists (select 1 from cand b where b.lang = s.lang and b.size > s.size and 100 * b.a >= 50 * s.a and contains(' ' || b.phrase || ' ', ' ' || s.phrase || ' ')))
select * exclude (part) from (select k.lang, row_number() over (partition by k.lang order by score desc, a desc, phrase) as rank, phrase, a, l, r, n, score, 0 as part from kept k join totals t on t.lang = k.lang) where rank <= 2000"""
