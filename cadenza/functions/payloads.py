"""Text out of markup and out of what models and services answer."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Entities of markup.
ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&nbsp;", "\u00a0"), ("&amp;", "&"))
#: Keys under which a list of texts may be wrapped, and keys of a text.
WRAPPERS, TEXTS = ("translations", "items", "data", "result", "output"), ("content", "text", "translation")


def html_text(html: Column) -> Column:
    """The text of HTML: without comments, scripts, styles and tags, the commonest entities resolved.

    It approximates a parser: markup is found by patterns.
    """
    x = F.regexp_replace(html, r"(?is)<!--.*?-->|<(script|style)\b[^>]*>.*?</\1\s*>", "")
    x = F.regexp_replace(x, r"<[/!a-zA-Z][^>]*>", "")
    for a, b in ENTITIES:
        x = F.replace(x, F.lit(a), F.lit(b))
    return x


def hocr_text(hocr: Column) -> Column:
    """The text of hOCR: words of lines by blanks, lines by line ends; else that of all spans without others inside."""
    every = lambda x, pattern: F.regexp_extract_all(x, F.lit(pattern), F.lit(1))
    quiet = lambda x: F.regexp_replace(x, "<[^>]+>", "")

    def word(x: Column) -> Column:
        x = quiet(x)
        for a, b in (ENTITIES[-1], *ENTITIES[:5]):
            x = F.replace(x, F.lit(a), F.lit(b))
        return F.btrim(x, F.lit(" \t\r\n"))

    full = lambda xs: F.filter(xs, lambda x: x != "")
    line = lambda x: F.array_join(full(F.transform(every(x, r"(?s)<span class=[\"']ocrx_word[\"'][^>]*>(.*?)</span>"), word)), " ")
    lines = full(F.transform(every(hocr, r"(?s)<span class=[\"']ocr_line[\"'][^>]*>(.*?)</span>"), line))
    spans = F.filter(every(hocr, r"(?s)<span[^>]*>(.*?)</span>"), lambda x: ~F.contains(x, F.lit("<span")))
    other = full(F.transform(spans, lambda x: F.btrim(quiet(x), F.lit(" \t\r\n"))))
    return F.array_join(F.when(F.size(lines) > 0, lines).otherwise(other), "\n")


def json_slice(text: Column) -> Column:
    """What is between the first [ and the last ] of an answer, without code fences."""
    blank = r"^\s+|\s+$"
    x = F.regexp_replace(F.coalesce(text, F.lit("")), blank, "")
    x = F.regexp_replace(F.regexp_replace(F.regexp_replace(x, r"(?i)^```(?:json)?\s*", ""), r"\s*```\s*$", ""), blank, "")
    inner = F.regexp_extract(x, r"(?s)\[.*\]", 0)
    return F.when(inner != "", inner).otherwise(x)


_STRING = re.compile(r'"(?:[^"\\]|\\.)*(?:"|$)', re.DOTALL)
_CONTROL = re.compile(r"\\.|[\x00-\x1f]", re.DOTALL)
_SHORT = {"\n": "\\n", "\r": "\\r", "\t": "\\t"}


def _escaped(m: re.Match) -> str:
    return _CONTROL.sub(lambda c: c[0] if c[0][0] == "\\" else _SHORT.get(c[0], f"\\u{ord(c[0]):04x}"), m[0])


def _repaired(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for some in texts:
        yield some.map(lambda x: None if x is None else _STRING.sub(_escaped, x))


def escape_controls(text: Column) -> Column:
    """JSON text whose strings hold raw control characters, with these escaped."""
    return F.pandas_udf(_repaired, "string")(text)


def with_texts(answers: DataFrame) -> DataFrame:
    """answers with columns n and payload, and beside them valid and texts, as payload_texts() has them.

    Each row is worked out by itself, over arrays: nothing is shuffled.
    """
    kind = lambda x: F.schema_of_variant(x)
    x = answers.withColumn("_root", F.try_parse_json("payload"))
    root = F.col("_root")
    wrapped = F.coalesce(*[F.when(kind(F.try_variant_get(root, f"$.{k}", "variant")).startswith("ARRAY"), F.try_variant_get(root, f"$.{k}", "variant")) for k in WRAPPERS])
    listed = F.when(kind(root).startswith("OBJECT"), wrapped).when(kind(root).startswith("ARRAY"), root)

    def read(x: Column) -> Column:
        text = lambda v: F.try_variant_get(v, "$", "string")
        fields, pos = x["fields"], x["pos"]
        alone = F.when(F.size(fields) == 1, F.element_at(F.map_values(fields), 1).cast("string"))
        plain = F.when(kind(x["item"]) == "STRING", text(x["item"]))
        content = F.when(fields.isNotNull(), F.coalesce(*[text(fields[k]) for k in TEXTS], alone)).otherwise(plain)
        index = F.coalesce(F.btrim(text(fields["index"])).try_cast("int"), pos)
        return F.struct(F.when(fields.isNotNull(), index).otherwise(pos).alias("i"), pos.alias("pos"), content.alias("text"))

    # an object is taken apart once, as its kind is not cheaper to find
    parts = F.transform(listed.cast("array<variant>"), lambda v, pos: F.struct(v.alias("item"), v.try_cast("map<string,variant>").alias("fields"), pos.alias("pos")))
    x = x.withColumn("_items", F.sort_array(F.transform(parts, read)))
    # items of one index stand together: where each index begins, and its items
    at = lambda k: F.get("_items", k)["i"]
    places = F.when(F.size("_items") > 0, F.sequence(F.lit(0), F.size("_items") - 1))
    x = x.withColumn("_begins", F.filter(places, lambda k: (k == 0) | (at(k) != at(k - 1))))
    groups = F.transform("_begins", lambda k, g: F.slice("_items", k + 1, F.coalesce(F.get("_begins", g + 1), F.size("_items")) - k))
    x = x.withColumn("_groups", F.filter(groups, lambda g: (g[0]["i"] >= 0) & (g[0]["i"] < F.col("n"))))
    valid = F.coalesce(~F.exists("_items", lambda y: y["text"].isNull()) & (F.size("_items") > 0) & (F.size("_groups") == F.col("n")), F.lit(False))
    joined = F.transform("_groups", lambda g: F.array_join(F.transform(g, lambda y: y["text"]), "\n"))
    return x.withColumn("valid", valid).withColumn("texts", F.when(F.col("valid"), joined)).drop("_root", "_items", "_begins", "_groups")


def payload_texts(payloads: DataFrame) -> DataFrame:
    """payloads(id, n, payload) to (id, valid, texts): the n texts of a JSON answer in order of their index.

    A list, or the first list under one of WRAPPERS. An item is a text, or an object with one of TEXTS
    or a single value, and an index; without a readable one its place counts. Texts of one index are
    joined by line ends. An answer that is no such list, holds other items, or lacks an index below n
    is not valid and has no texts.
    """
    return with_texts(payloads.select("id", "n", "payload")).select("id", "valid", "texts")
