"""The pipeline's stages against plain versions of them, and their edge cases."""

import re
from collections import Counter

import pytest
import regex
import zstandard
from test_nearcopies import brute_kept

import corpus_pipeline
from cadenza.llm import langid
from cadenza.llm.linededup import MIN_PAGES, RATIO

STAGES = dict(corpus_pipeline.STAGES)
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, row string, site string, key string, kept int"
PROSE = "the quick brown fox jumps over the lazy dog while seven wizards quietly boil rice beside a frozen lake and nobody asks them why they sing so loudly at night"


def fixture(spark, sf_dir):
    """Documents of the smallest table beside odd rows, with columns whose names the stages use themselves."""
    docs = [(r.doc_id, r.text, r.lang, r.source) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source").collect()]
    item = spark.read.parquet(f"{sf_dir}/benchmark.parquet").first().text
    odd = [(None, item, "en", "a"), (7, "nothing of that kind is here to be found " + item, None, None), (7, "another text with the same id stays as it is", "en", "a"), (8, None, "en", "a"), (8, "", None, "a"),
           (9, " \n\t", "en", None), (10, "½ ² 12", "en", "a"), (None, PROSE, "en", "a"), (None, PROSE, "en", "a"), (11, "\n".join(["Home | About", PROSE, "", "Home | About"]), None, "b"), (12, "Home | About", None, "b"), (13, PROSE * 300, None, "c")]
    rows = docs + odd
    return rows, spark.createDataFrame([(d, t, k, s, len(t or ""), "r", "s", "k", 1) for d, t, k, s in rows], COLUMNS), [i.text for i in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]


def ids_and_texts(df):
    return sorted(((r.doc_id, r.text) for r in df.collect()), key=str)


def keeps(rows, decide):
    return sorted(((d, t) for d, t, *_ in rows if decide(t)), key=str)


def test_language_stage(spark, sf_dir):
    rows, docs, _ = fixture(spark, sf_dir)
    model = langid.train(docs)
    options = langid.Options()
    coders = [zstandard.ZstdCompressor(level=options.level, dict_data=zstandard.ZstdCompressionDict(model[k], dict_type=zstandard.DICT_TYPE_RAWCONTENT), write_content_size=False, write_checksum=False, write_dict_id=False) for k in sorted(model)]

    def told(text):
        x = regex.sub(r"[^\p{L}\p{M}]+", " ", (text or "").lower()).strip().encode()
        if not regex.search(r"\p{L}", text or ""):
            return "und", None
        sizes = [sum(len(c.compress(x[a : a + 1024])) for a in range(0, len(x), 1024)) for c in coders]
        one, two = sorted(sizes)[:2]
        return sorted(model)[sizes.index(one)], two - one >= max(1, 0.002 * two)

    out = STAGES["language_id"](spark, docs, sf_dir)
    assert out.columns == docs.columns and ids_and_texts(out) == keeps(rows, lambda t: told(t)[1])
    found = {(r.doc_id, r.lang_pred) for r in langid.identify(docs, model).collect()}
    assert found == {(d, told(t)[0]) for d, t, *_ in rows}


def test_line_stage(spark, sf_dir):
    rows, docs, _ = fixture(spark, sf_dir)
    trim = lambda x: x.strip(" \t\r")
    pages, lines = Counter(s for *_, s in rows), Counter()
    for _, t, _, s in rows:
        if s is not None:
            lines.update((s, x) for x in {trim(x) for x in (t or "").split("\n")} if x)
    drop = {(s, x) for (s, x), n in lines.items() if n >= MIN_PAGES and n > RATIO * pages[s]}
    want = [(d, t if t is None or s is None else "\n".join(x for x in t.split("\n") if (s, trim(x)) not in drop)) for d, t, _, s in rows]
    out = STAGES["line_dedup"](spark, docs, sf_dir)
    assert out.columns == docs.columns and ids_and_texts(out) == sorted(want, key=str) and drop
    assert all(r.n_chars == len(r.text) for r in out.where("text is not null").collect())


def test_near_copy_stage(spark, sf_dir):
    rows, docs, _ = fixture(spark, sf_dir)
    out = STAGES["simhash_near_dedup"](spark, docs, sf_dir)
    assert out.columns == docs.columns and sorted((r.doc_id for r in out.collect()), key=str) == sorted(brute_kept([r[:2] for r in rows]), key=str)


def holds(text, item, words=5, similarity=0.8):
    """If any window of an item's length is as similar: all windows, plainly."""
    a, b = (re.findall(r"\w+", (x or "").lower()) for x in (text, item))
    if not a or not b:
        return False
    size, length = min(words, len(b)), min(len(a), len(b))
    grams = lambda w: Counter(tuple(w[i : i + size]) for i in range(len(w) - size + 1))
    own = grams(b)
    if not set(own) & set(grams(a)):
        return False
    for i in range(len(a) - length + 1):
        other = grams(a[i : i + length])
        both = sum((own & other).values())
        if both >= similarity * (sum(own.values()) + sum(other.values()) - both) and both:
            return True
    return False


def test_benchmark_stage(spark, sf_dir):
    rows, docs, items = fixture(spark, sf_dir)
    short = [r for r in rows if len(r[1] or "") < 20_000]
    some = docs.where("length(coalesce(text, '')) < 20000")
    out = STAGES["benchmark_decontamination"](spark, some, sf_dir)
    want = keeps(short, lambda t: not any(holds(t, i) for i in items))
    assert out.columns == docs.columns and ids_and_texts(out) == want and len(want) < len(short)


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_empty(spark, sf_dir, name):
    docs = spark.createDataFrame([], COLUMNS)
    assert STAGES[name](spark, docs, sf_dir).count() == 0


def test_run(spark, sf_dir):
    """run() is the stages one after the other, over all rows."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, kept, sf_dir)
        assert kept.columns == docs.columns
        kept = spark.createDataFrame(kept.collect(), docs.schema)
    want = corpus_pipeline.STAGES[-1][1](spark, kept, sf_dir).collect()
    assert sorted(map(str, corpus_pipeline.run(spark, sf_dir).collect())) == sorted(map(str, want))
    assert 0.5 * docs.count() < len(want) < docs.count()
