"""Column functions of timed text: normalising, time codes, languages, phonetics."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def normalize_text(text: Column) -> Column:
    """Lower case without tags, braces and marks, words joined by single blanks; null gives an empty text. (F1)"""
    x = F.lower(F.coalesce(text, F.lit("")))
    x = F.regexp_replace(x, r"<[^>]+>|\{[^}]+\}", " ")
    x = F.regexp_replace(x, r"[^\p{L}\p{N}\s]", " ")
    return F.btrim(F.regexp_replace(x, r"\s+", " "))


def collapse_whitespace(text: Column) -> Column:
    """Blanks, line ends and the literal \\N as one blank. (F2)"""
    return F.btrim(F.regexp_replace(F.replace(text, F.lit("\\N"), F.lit(" ")), r"\s+", " "))


def clean_override_tags(text: Column) -> Column:
    """Without drawings and override tags; empty braces stay."""
    return F.btrim(F.regexp_replace(F.regexp_replace(text, r"\{[^}]*\\p[1-9][^}]*\}.*", ""), r"\{[^}]+\}", ""))


def squash(text: Column) -> Column:
    """Letters and digits only, in lower case."""
    return F.regexp_replace(F.lower(text), "[^a-z0-9]+", "")


def comma_list(text: Column, default: str = "en") -> Column:
    """The trimmed parts of a comma list; without any, the default. (F8)"""
    parts = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), ","), lambda x: F.btrim(x)), lambda x: x != "")
    return F.when(F.size(parts) > 0, parts).otherwise(F.array(F.lit(default)))


def clamp(value: Column, default: float, low: float, high: float, kind: str = "double") -> Column:
    """The value within bounds; the default where it can't be read as a number."""
    number = F.coalesce(value.try_cast(kind), F.lit(default).cast(kind))
    return F.greatest(F.lit(low).cast(kind), F.least(number, F.lit(high).cast(kind)))


def release_quality(name: Column) -> Column:
    """Kind of source that a release name tells."""
    n = F.lower(name)
    has = lambda *words: F.greatest(F.lit(False), *[F.contains(n, F.lit(w)) for w in words])
    return F.when(has("bluray", "bdrip", "bdremux"), "bluray").when(has("dvd"), "dvd").when(has("hdtv"), "hdtv").when(has("cam"), "cam").otherwise("web")


def hearing_impaired(name: Column) -> Column:
    return F.lower(name).rlike(r"\b(hi|sdh)\b")


def time_code(ms: Column) -> Column:
    """HH:MM:SS,mmm. (K2)"""
    ms = ms.cast("long")
    part = lambda unit, size: F.floor(ms / unit) % size if size else F.floor(ms / unit)
    return F.format_string("%02d:%02d:%02d,%03d", part(3_600_000, 0), part(60_000, 60), part(1000, 60), ms % 1000)


def retime(ms: Column, scale: Column | float, offset_ms: Column | float) -> Column:
    """A linear change of time, never below zero."""
    return F.greatest(F.floor(F.round(ms * scale + offset_ms, 6) + 0.5).cast("long"), F.lit(0).cast("long"))


def path_prefixes(path: Column) -> Column:
    """Every folder above and including a path."""
    parts = F.filter(F.split(path, "/"), lambda x: x != "")
    return F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts), F.lit(1))), lambda i: F.array_join(F.slice(parts, 1, i), "/"))


def subtitle_format(text: Column) -> Column:
    """ass, ssa or srt by what the text holds."""
    t = F.lower(text)
    return F.when(F.contains(t, F.lit("[script info]")), F.when(F.contains(t, F.lit("scripttype: v4.00+")), "ass").otherwise("ssa")).otherwise("srt")


def file_size(n: Column) -> Column:
    """Bytes in the largest unit of 1024 that leaves 1 or more, two decimals, without trailing zeros."""
    out = F.lit("0 B")
    for i, unit in enumerate(("B", "KB", "MB", "GB", "TB")):
        text = F.regexp_replace(F.format_string("%.2f", F.round(n / F.lit(float(1024**i)), 2)), r"\.?0+$", "")
        out = F.when(n >= 1024**i, F.concat(text, F.lit(f" {unit}"))).otherwise(out)
    return out


def extension(name: Column) -> Column:
    """What follows the last point of the last path part, in lower case; else empty. (F16)"""
    return F.lower(F.regexp_extract(name, r"\.([^./?#]+)$", 1))


def language_suffix(name: Column) -> Column:
    """The two or three letters before a file name's ending, in lower case; else null."""
    found = F.regexp_extract(name, r"\.([a-zA-Z]{2,3})(?:\.[0-9]+)?\.[^.]+$", 1)
    return F.when(found != "", F.lower(found))


#: Cologne phonetics as (letters, before, after, code); the first rule that fits counts.
#: ^ is the start of a word, $ its end, * anything.
COLOGNE = """AEIJOUY * * 0, B * * 1, P * H 3, P * * 1, DT * $CSZ 8, DT * * 2, FVW * * 3, GKQ * * 4,
X ^CKQ * 8, X * * 48, L * * 5, MN * * 6, R * * 7, SZ * * 8, C ^ $AHKLOQRUX 4, C ^ * 8, C SZ * 4, C * $AHKOQUX 4, C * * 8"""


def cologne_rules() -> list[tuple[list[str], list[str] | None, list[str] | None, str]]:
    """COLOGNE as (letters, letters before or none, letters after or none, code); an edge is an empty letter."""
    some = lambda x: None if x == "*" else ["" if c in "^$" else c for c in x]
    return [(list(c), some(b), some(a), code) for c, b, a, code in (rule.split() for rule in COLOGNE.split(","))]


def cologne(word: Column) -> Column:
    """Cologne phonetics, where the end of a word counts as any following letter."""
    letters = F.upper(word)
    for a, b in (("Ä", "A"), ("Ö", "O"), ("Ü", "U"), ("ß", "SS")):
        letters = F.replace(letters, F.lit(a), F.lit(b))
    letters = F.regexp_replace(letters, "[^A-Z]", "")

    def code(i: Column) -> Column:
        at = lambda k: F.substr(letters, k, F.lit(1))
        c, after, before = at(i), at(i + 1), F.when(i > 1, at(i - 1)).otherwise("")
        out = F
        for own, prior, later, digit in cologne_rules():
            fits = c.isin(own)
            for where, x in ((before, prior), (after, later)):
                fits = fits if x is None else fits & where.isin(x)
            out = out.when(fits, digit)
        return out.otherwise("")

    n = F.length(letters)
    codes = F.when(n > 0, F.array_join(F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), code), "")).otherwise("")
    once = F.regexp_replace(codes, r"(.)\1+", "$1")
    return F.concat(F.substring(once, 1, 1), F.replace(F.substr(once, F.lit(2)), F.lit("0"), F.lit("")))


#: What marked letters (see phonetic_codes) and others stand for; H stands for nothing.
_LETTERS, _DIGITS = "AEIJOUYBPpDTdFVWGKQxLMNRSZcCH", "0000000113228333444856678848"


def phonetic_codes(text: Column) -> Column:
    """The distinct Cologne codes of the words of a text between single blanks, without empty ones: cologne() of all words in a few passes.

    Letters whose digit depends on their neighbours are marked by lower case first: P as 3, D and T as 8, C as 4, X as 8.
    """
    x = F.upper(text)
    for a, b in (("Ä", "A"), ("Ö", "O"), ("Ü", "U"), ("ß", "SS")):
        x = F.replace(x, F.lit(a), F.lit(b))
    x = F.regexp_replace(x, "[^A-Z ]+", "")
    for pattern, mark in ((r"P(?=H)", "p"), (r"[DT](?=[CSZ ]|\z)", "d"), (r"(?<=[SZ])C|C(?=[AHKOQUX ]|\z)|(?:(?<= )|^)C(?=[LR])", "c"), (r"(?:(?<=[CcKQ ])|^)X", "x")):
        x = F.regexp_replace(x, pattern, mark)
    x = F.translate(F.replace(x, F.lit("X"), F.lit("48")), _LETTERS, _DIGITS)
    x = F.regexp_replace(F.regexp_replace(x, r"([0-9])\1+", "$1"), "(?<=[0-9])0", "")
    return F.array_remove(F.array_distinct(F.split(x, " ")), "")
