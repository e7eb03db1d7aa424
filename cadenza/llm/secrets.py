"""Secret scans: patterns, and character Markov models compared by log-likelihood ratio."""

from __future__ import annotations

import hashlib
import random
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches

#: Fixed patterns: kind, pattern, smallest length, and the group that is measured.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
KINDS = ("assign", "access", "hex", "markov")

#: What a random string or an identifier is made of; anything else ends a candidate.
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
CODE = np.full(128, -1, np.int64)
CODE[[ord(c) for c in ALPHABET]] = np.arange(len(ALPHABET))
START = len(ALPHABET)  # the state before the first character
UPPER, LOWER, DIGITS = ALPHABET[:26], ALPHABET[26:52], ALPHABET[52:62]
#: What the random strings of the labelled sample are drawn from.
ALPHABETS = {"hex": DIGITS + "ABCDEF", "base32": UPPER + "234567", "base36": LOWER + DIGITS, "base62": UPPER + LOWER + DIGITS, "base64": ALPHABET[:64], "base64url": UPPER + LOWER + DIGITS + "-_"}
RANDOM = (*ALPHABETS, "matched")
ORDINARY = ("words", "numbers", "runs")
#: Random by their characters, but names and not secrets.
UUID = re.compile(r"[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}")
#: Words that the identifiers of the labelled sample are put together from, besides those of documents.
WORDS = """access action address agent api array async average batch binary body browser buffer bundle call cancel channel child class close code color command
config connection context copy count current data date default delta depth description device directory disable document download dynamic edge email
encoding engine error exception execute factory feature field filter format frame get group handler header history host identifier index init insert
integer interface job label language layout level library link load local log manager map memory message meta metric model module mount network node
object option order owner page parameter parse path pattern permission plugin point pool prefix previous profile property protocol query range read
reference register remove replace request reset response retry role route run sample scale schema scope service set shape signal source stack state
storage stream style summary sync table target task test thread time trace transaction type unit upload user value view wait window worker zone"""


@dataclass(frozen=True)
class Options:
    """The bounded training sample: about train_docs documents, those whose hashes are below a threshold."""

    train_docs: int = 4000
    #: Strings of each kind that the labelled sample adds, from a fixed seed.
    samples: int = 2000
    seed: int = 42
    min_length: int = 20
    #: Weights of a kind's letters and of the even distribution over the alphabet in each row of transitions.
    letters: float = 0.12
    even: float = 0.04
    #: Log-likelihood ratio, in nats, from which a candidate is a secret.
    threshold: float = 8.0


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the fixed patterns' matches that are long enough, in order of kinds."""
    found = []
    if "=" in text or ":" in text:
        found += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
    if "AKIA" in text:
        found += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    found += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return found


def candidate_pattern(options: Options) -> re.Pattern:
    """Runs of the alphabet; an equals sign is part of one only as padding at its end."""
    return re.compile(rf"[A-Za-z0-9+/_-]{{{options.min_length},}}={{0,2}}")


def codes(token: str) -> np.ndarray:
    return CODE[np.frombuffer(token.encode("ascii"), np.uint8)]


def add(counts: np.ndarray, token: str) -> None:
    c = codes(token)
    np.add.at(counts, (np.concatenate([[START], c[:-1]]), c), 1)


def labelled(options: Options, words: list[str] = WORDS.split()) -> Iterator[tuple[str, str]]:
    """(kind, string): random strings over several alphabets, and identifiers, paths, dates and rulers."""
    r = random.Random(options.seed)
    for _ in range(options.samples):
        for kind, letters in ALPHABETS.items():
            yield kind, "".join(r.choices(letters, k=r.randint(20, 64)))
        some = [r.choice(words) for _ in range(r.randint(2, 7))]
        some = [w + str(r.randint(0, 99)) if r.random() < 0.1 else w for w in some]
        yield "words", some[0] + "".join(w.capitalize() for w in some[1:])
        yield "words", "".join(w.capitalize() for w in some)
        yield "words", r.choice("_-/").join(some)
        yield "words", "_".join(some).upper()
        yield "words", "/".join(["".join(w.capitalize() for w in some[:2]), *some[2:], f"v{r.randint(1, 9)}"])
        day = lambda: f"{r.randint(1990, 2035)}-{r.randint(1, 12):02}-{r.randint(1, 28):02}"
        yield "numbers", r.choice("-_/").join([day(), day(), r.choice(words)])
        yield "numbers", r.choice("-_/+").join(str(r.randint(0, 10 ** r.randint(1, 12))) for _ in range(r.randint(1, 6)))
        yield "runs", (r.choice((UPPER, LOWER, DIGITS)) * 3)[r.randint(0, 9) :][: r.randint(12, 30)]
        yield "runs", "".join(r.choice(ALPHABET) * r.randint(12, 60) for _ in range(r.randint(1, 2)))


def samples(text: str) -> Iterator[tuple[str, str]]:
    """(kind, token): labelled strings of a text. The values of base matches are random ones, what
    looks like a word or an identifier outside of them is ordinary."""
    spans = base_spans(text)
    for start, end, kind in spans:
        value = ASSIGN.match(text, start).group(2) if kind == "assign" else text[start:end]
        value = "".join(c for c in value if c in ALPHABET)
        if value:
            yield "matched", value
    taken = sorted((a, b) for a, b, _ in spans)
    at = 0
    for m in re.finditer(r"[A-Za-z][A-Za-z0-9/_-]{4,}", text):
        while at < len(taken) and taken[at][1] <= m.start():
            at += 1
        if at == len(taken) or m.end() <= taken[at][0]:
            yield "words", m.group()


def train(docs: DataFrame, options: Options = Options()) -> np.ndarray:
    """Log transition probabilities [kind, state, character] of RANDOM, then ORDINARY kinds of strings.

    The labelled strings are those of `labelled` and those of about train_docs documents. Their texts
    stay where they are: only transition counts are added up and come to the driver.
    """
    size, kinds = len(ALPHABET), RANDOM + ORDINARY

    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        counts = np.zeros((len(kinds), size + 1, size), np.int64)
        for batch in batches:
            for text in batch.column(0).to_pylist():
                for kind, token in samples(text or ""):
                    add(counts[kinds.index(kind)], token)
        cell = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(counts.ravel()[cell])], ["cell", "n"])

    n = max(1, docs.count())
    picked = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(n)) < options.train_docs).select(F.col("text").cast("string"))
    counts = np.zeros(len(kinds) * (size + 1) * size)
    for r in picked.mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect():
        counts[r.cell] = r.n
    counts = counts.reshape(len(kinds), size + 1, size)
    for kind, token in labelled(options):
        add(counts[kinds.index(kind)], token)
    return transitions(counts, options)


def transitions(counts: np.ndarray, options: Options) -> np.ndarray:
    """Smoothed log probabilities of counts [kind, state, character]."""
    size = counts.shape[2]
    letters = (counts.sum(1, keepdims=True) + 0.1) / (counts.sum((1, 2), keepdims=True) + 0.1 * size)
    seen = (counts + letters) / (counts.sum(2, keepdims=True) + 1)
    return np.log((1 - options.letters - options.even) * seen + options.letters * letters + options.even / size)


def log_ratio(token: str, model: np.ndarray) -> float:
    """How much likelier token is under the best of the random models than under the best of the ordinary ones, in nats."""
    c = codes(token)
    total = model[:, np.concatenate([[START], c[:-1]]), c].sum(1)
    return float(total[: len(RANDOM)].max() - total[len(RANDOM) :].max())


def judged(text: str, a: int, b: int, model: np.ndarray, options: Options) -> list[tuple[int, int, str]]:
    """The candidate text[a:b] as a span if the models call it random; else those of its parts between slashes."""
    if b - a < options.min_length or UUID.fullmatch(text, a, b):
        return []
    if log_ratio(text[a:b], model) >= options.threshold:
        return [(a, b, "markov")]
    parts = [(a + m.start(), a + m.end()) for m in re.finditer(r"[^/]+", text[a:b])]
    if len(parts) < 2:
        return []
    return [(x, y, "markov") for x, y in parts if y - x >= options.min_length and log_ratio(text[x:y], model) >= options.threshold]


def scan(text: str, model: np.ndarray, options: Options, pattern: re.Pattern) -> tuple[list, list, int]:
    """(base spans, all spans, base spans that the models call random too); what base spans leave of a candidate is judged."""
    base = base_spans(text)
    taken = sorted((a, b) for a, b, _ in base)
    more = []
    for m in pattern.finditer(text):
        a, end = m.span()
        for x, y in taken:
            if y <= a or x >= end:
                continue
            more += judged(text, a, x, model, options)
            a = max(a, y)
        more += judged(text, a, end, model, options)
    alike = sum(log_ratio("".join(c for c in text[a:b].split("=")[-1] if c in ALPHABET) or "a", model) >= 0 for a, b, _ in base)
    order = lambda s: (s[0], KINDS.index(s[2]))
    return sorted(base, key=order), sorted(base + more, key=order), alike


def joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in spans)


def find_secrets(docs: DataFrame, model: np.ndarray, options: Options = Options()) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, n_markov, n_alike, base_sha256, spans) for every row.

    Offsets are code points, ends exclusive. Null and empty texts have no spans. Overlapping kinds
    are all kept; a model's span never meets one of a pattern. n_alike counts the patterns' spans
    that the models call random as well. Repeated rows stay; columns other than doc_id and text are
    not read. An empty table gives no rows.
    """
    small_batches(docs.sparkSession)
    kind = dict(docs.dtypes)["doc_id"]
    sent = docs.sparkSession.sparkContext.broadcast(model)
    names = ["doc_id", "n_assign", "n_access", "n_hex", "n_markov", "n_alike", "base_sha256", "spans"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        pattern = candidate_pattern(options)
        for batch in batches:
            rows = []
            for text in batch.column(1).to_pylist():
                base, every, alike = scan(text or "", sent.value, options, pattern)
                n = [sum(k == x for _, _, k in every) for x in KINDS]
                rows.append((*n, alike, hashlib.sha256(joined(base).encode()).hexdigest(), joined(every)))
            columns = list(zip(*rows)) or [()] * 7
            types = [pa.int64()] * 5 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(columns, types))], names)

    schema = f"doc_id {kind}, n_assign long, n_access long, n_hex long, n_markov long, n_alike long, base_sha256 string, spans string"
    return docs.select("doc_id", F.col("text").cast("string")).mapInArrow(run, schema)
