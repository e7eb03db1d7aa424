"""Queries on texts inside of files and answers: markup, events, translations put back."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import functions as T
from .. import operators as O
from ..functions import payloads as P
from ..operators import translation
from .common import CUES, cue_rows, table

STYLES, TAGS = ("Default", "Sign", " Default", "Default"), ("", "{\\i1}", "{}", "{\\p1}m 0 0")


def page_texts(spark, sf_dir):
    """The text of every page, words by single blanks."""
    text = F.btrim(F.regexp_replace(P.html_text(F.coalesce("html", F.lit(""))), r"[\s ]+", " "))
    return table(spark, sf_dir, "pages").select("page_id", text.alias("text"))


def _turns(spark, sf_dir):
    """Turns with their whole text, all but letters, digits and blanks made blanks."""
    plain = F.btrim(F.regexp_replace(F.coalesce("text", F.lit("")), "[^a-zA-Z0-9 ]", " "))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", plain.alias("text"))


def hocr_texts(spark, sf_dir):
    """Text of scanned lines made of turns, quotes of both kinds. A line ends at its first word's end, so words come by their spans."""
    quote, text = F.when(F.col("turn") % 2 == 0, "'").otherwise('"'), F.concat(F.lit("<em>"), F.col("text"), F.lit("</em> &amp;&lt;"))
    word = F.concat(F.lit("<span class="), quote, F.lit("ocrx_word"), quote, F.lit(" id=1>"), text, F.lit("</span>"))
    hocr = F.when(F.col("turn") % 3 == 0, F.concat(F.lit("<span class="), quote, F.lit("ocr_line"), quote, F.lit(">"), word, word, F.lit("</span>"))).otherwise(word)
    return _turns(spark, sf_dir).select("conv_id", "turn", P.hocr_text(hocr).alias("text"))


def translated_texts(spark, sf_dir):
    """The texts of answers in every form that services give, in order, and which are not valid."""
    t = _turns(spark, sf_dir)
    form = F.col("conv_id") % 6
    quoted = F.concat(F.lit('"'), F.col("text"), F.lit('"'))
    index = F.col("i").cast("string")
    item = (
        F.when(form == 0, F.concat(F.lit('{"index":"'), index, F.lit('","content":'), quoted, F.lit("}")))
        .when(form == 1, F.concat(F.lit('{"text":'), quoted, F.lit(',"index":'), index, F.lit("}")))
        .when(form == 2, quoted).when(form == 3, F.concat(F.lit('{"translation":'), quoted, F.lit("}"))).when(form == 4, F.concat(F.lit('{"other":'), quoted, F.lit("}")))
        .otherwise(F.concat(F.lit('{"index":"'), (F.col("i") + 1).cast("string"), F.lit('","content":'), quoted, F.lit("}")))
    )
    one = t.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("all"))
    items = one.select("conv_id", F.size("all").alias("n"), F.posexplode("all").alias("i", "x")).select("conv_id", "n", "i", F.col("x.text").alias("text")).withColumn("item", item)
    # the last of form 0 is cut in two items of one index
    items = items.groupBy("conv_id", "n").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "item"))), lambda x: x["item"]), ",").alias("items"))
    listed = F.concat(F.lit("["), F.col("items"), F.when(form == 0, F.lit(',{"index":"0","content":"more"}')).otherwise(""), F.lit("]"))
    payload = F.when(form == 1, F.concat(F.lit('{"note":1,"items":'), listed, F.lit("}"))).otherwise(listed)
    found = P.payload_texts(items.select(F.col("conv_id").alias("id"), "n", payload.alias("payload")))
    return found.select("id", "valid", F.array_join("texts", " / ").alias("texts"))


def repaired_json(spark, sf_dir):
    """Answers in fences and with raw line ends inside of strings, as JSON."""
    wrapped = F.concat(F.lit("```json\nHere: ["), F.lit('{"a":"'), F.col("text"), F.lit('\n\t'), F.lit('","b":\n"'), F.col("text"), F.lit('\r"}]\n```'))
    return _turns(spark, sf_dir).select("conv_id", "turn", P.escape_controls(P.json_slice(wrapped)).alias("json"))


def text_formats(spark, sf_dir):
    """Format, collapsed text and cleaned line of texts with headers."""
    head = F.element_at(F.array(*map(F.lit, ("[Script Info]\nScriptType: v4.00+\\N", "[script info]\n", "1\\N\n", "{}{\\p2}x"))), (F.col("turn") % 4 + 1).cast("int"))
    t = _turns(spark, sf_dir).withColumn("x", F.concat(head, F.lit(" {\\b1}"), "text"))
    return t.select("conv_id", "turn", T.subtitle_format(F.col("x")).alias("format"), T.collapse_whitespace(F.col("x")).alias("flat"), T.clean_override_tags(F.element_at(F.split("x", "\n"), -1)).alias("clean"))


def _ass(spark, sf_dir):
    """ASS files of tracks: every fifth without a Default style, all styles and tags in turn."""
    pick = lambda xs, n: F.element_at(F.array(*map(F.lit, xs)), (n % len(xs) + 1).cast("int"))
    c = cue_rows(spark, sf_dir)
    event = F.concat(F.when(F.col("pos") % 9 == 0, "Comment: ").otherwise("Dialogue: "), F.lit("0,0:00:01.00,"), pick(STYLES, F.col("pos")), F.lit(",,"), pick(TAGS, F.floor(F.col("pos") / 4)), F.lit("a, "), "raw_text")
    events = c.select("track_id", (F.col("pos") + 10).alias("line_no"), event.alias("line"))
    style = F.when(F.col("track_id") % 5 == 0, "Style: Other,Default").otherwise("Style: Default,Arial")
    head = F.array(F.lit("[Script Info]"), F.lit("[V4+ Styles]"), style, F.lit("[Events]"), F.lit("Format: Layer, Start, Style, Name, Text"))
    return events.unionByName(c.where("pos = 0").select("track_id", F.posexplode(head).alias("line_no", "line")))


def ass_events(spark, sf_dir):
    """Cleaned ASS files."""
    return O.ass_lines(_ass(spark, sf_dir))


def translated_files(spark, sf_dir):
    """Rendered tracks with a marked text put back for every block."""
    c = cue_rows(spark, sf_dir)
    lines = c.select("track_id", "pos", F.posexplode(F.array((F.col("pos") + 1).cast("string"), F.lit("00:00:00,000 --> 00:00:01,000"), "raw_text", F.lit(""))).alias("k", "line"))
    lines = lines.select("track_id", (F.col("pos") * 4 + F.col("k")).alias("line_no"), "line")
    blocks = O.text_blocks(lines)
    return O.rejoined(lines, blocks.withColumn("text", F.concat(F.lit("+ "), "text")))


def _upper(texts: list[str]) -> str:
    """A service that is down for texts with a z at the end of a batch, and forgets the last of a batch that begins with an a."""
    import json

    if texts[-1].lower().endswith("z") or len(texts) % 9 == 0:
        raise ConnectionError("down")
    return "```json\n" + json.dumps([{"index": i, "content": t.replace("a", "4")} for i, t in enumerate(texts[: -1 if texts[0].lower().startswith("a") else None])]) + "\n```"


def _marked(texts: list[str]) -> str:
    import json

    return json.dumps({"items": [f"+ {t}" for t in texts]})


def translated_tracks(spark, sf_dir):
    """Rendered tracks translated in batches of twenty by a service that fails some, and these by a second one."""
    c = cue_rows(spark, sf_dir).select("track_id", "pos", "raw_text")
    lines = c.select("track_id", "pos", F.posexplode(F.array((F.col("pos") + 1).cast("string"), F.lit("00:00:00,000 --> 00:00:01,000"), "raw_text", F.lit(""))).alias("k", "line"))
    lines = lines.select("track_id", (F.col("pos") * 4 + F.col("k")).alias("line_no"), "line")
    return translation.translate(lines, [("letters", _upper), ("marks", _marked)], most=20)[0]


def speech_times(spark, sf_dir):
    """Recognised segments of ten-minute pieces with times from the start; words' times come first."""
    c = cue_rows(spark, sf_dir)
    chunk = F.floor(F.col("start_ms") / 600_000) * 600_000
    start, end = F.col("start_ms") - chunk, F.col("end_ms") - chunk
    word = lambda a, b: F.struct(a.cast("long").alias("start_ms"), b.cast("long").alias("end_ms"))
    words = F.when(F.col("pos") % 3 == 0, F.array(word(start + 5, F.lit(None)), word(start + 40, start + 90), word(end - 60, end - 20))).otherwise(F.array().cast("array<struct<start_ms:bigint,end_ms:bigint>>"))
    segments = c.select("track_id", chunk.alias("chunk_ms"), F.col("pos").alias("seg_no"), start.alias("start_ms"), end.alias("end_ms"), words.alias("words"), F.when(F.col("pos") % 11 == 0, "  ").otherwise(F.col("raw_text")).alias("text"))
    return O.absolute_times(segments)


def screen_ends(spark, sf_dir):
    """Screens of image subtitles with their ends: the next one if it is empty."""
    c = cue_rows(spark, sf_dir)
    return O.shown_until(c.select("track_id", "pos", "start_ms", F.when(F.col("pos") % 3 == 1, 0).otherwise(2).alias("objects"))).select("track_id", "pos", "end_ms")


_TURNS = "turns as (select conv_id, turn, trim(regexp_replace(coalesce(text, ''), '[^a-zA-Z0-9 ]', ' ', 'g')) as text from conversations)"
SQL = {
    "page_texts": r"""with a as (select page_id, regexp_replace(regexp_replace(coalesce(html, ''), '<!--.*?-->|<script\b[^>]*>.*?</script\s*>|<style\b[^>]*>.*?</style\s*>', '', 'gsi'), '<[/!a-zA-Z][^>]*>', '', 'g') as x from pages),
b as (select page_id, replace(replace(replace(replace(replace(replace(replace(x, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&apos;', ''''), '&nbsp;', chr(160)), '&amp;', '&') as x from a)
select page_id, trim(regexp_replace(x, '[\s\x{00a0}]+', ' ', 'g')) as text from b""",
    "hocr_texts": f"""with {_TURNS} select conv_id, turn, trim(text || ' &amp;&lt;') as text from turns""",
    "translated_texts": f"""with {_TURNS}, o as (select conv_id, list(text order by turn, text) as l from turns group by conv_id)
select conv_id as id, conv_id % 6 <> 5 as valid, case when conv_id % 6 = 5 then null else array_to_string(case when conv_id % 6 = 0 then list_concat([l[1] || chr(10) || 'more'], l[2:]) else l end, ' / ') end as texts from o""",
    "repaired_json": f"""with {_TURNS} select conv_id, turn, '[{{"a":"' || text || '\\n\\t","b":' || chr(10) || '"' || text || '\\r"}}]' as json from turns""",
    "text_formats": f"""with {_TURNS}, h as (select conv_id, turn, (['[Script Info]' || chr(10) || 'ScriptType: v4.00+\\N', '[script info]' || chr(10), '1\\N' || chr(10), '{{}}{{\\p2}}x'])[turn % 4 + 1] || ' {{\\b1}}' || text as x from turns)
select conv_id, turn, case turn % 4 when 0 then 'ass' when 1 then 'ssa' else 'srt' end as format, trim(regexp_replace(replace(x, '\\N', ' '), '\\s+', ' ', 'g')) as flat,
trim(regexp_replace(regexp_replace(string_split(x, chr(10))[-1], '\\{{[^}}]*\\\\p[1-9][^}}]*\\}}.*', '', 'g'), '\\{{[^}}]+\\}}', '', 'g')) as clean from h""",
    "ass_events": f"""with {CUES}, e as (select track_id, pos, (['Default', 'Sign', ' Default', 'Default'])[pos % 4 + 1] as style, (['', '{{\\i1}}', '{{}}', '{{\\p1}}m 0 0'])[pos // 4 % 4 + 1] as tag, raw_text from cues where track_id % 5 <> 0),
k as (select track_id, pos, style, trim(regexp_replace(case when tag = '{{\\p1}}m 0 0' then '' when tag = '{{\\i1}}' then '' else tag end || case when tag = '{{\\p1}}m 0 0' then '' else regexp_replace('a, ' || raw_text, '\\{{[^}}]*\\\\p[1-9][^}}]*\\}}.*', '') end, '\\{{[^}}]+\\}}', '', 'g')) as t from e where trim(style) = 'Default')
select track_id, pos + 10 as line_no, case when pos % 9 = 0 then 'Comment: ' else 'Dialogue: ' end || '0,0:00:01.00,' || style || ',,' || t as line from k where t <> ''
union all select distinct track_id, h.i, h.line from cues, (values (0, '[Script Info]'), (1, '[V4+ Styles]'), (2, 'Style: Default,Arial'), (3, '[Events]'), (4, 'Format: Layer, Start, Style, Name, Text')) h(i, line) where track_id % 5 <> 0""",
    "translated_tracks": f"""with {CUES}, l as (select track_id, pos * 4 + k as line_no, case k when 0 then (pos + 1)::varchar when 1 then '00:00:00,000 --> 00:00:01,000' when 2 then raw_text else '' end as line, k from cues, range(0, 4) r(k)),
t as (select *, case when k = 2 and not regexp_full_match(trim(line), '[0-9]*') and not contains(line, '-->') then trim(line) end as text from l),
b as (select *, (row_number() over (partition by track_id order by line_no) - 1) // 20 as batch from t where text is not null),
g as (select track_id, batch, count(*) as n, arg_min(text, line_no) as first, arg_max(text, line_no) as last from b group by all),
f as (select track_id, batch, lower(last) like '%z' or n % 9 = 0 or lower(first) like 'a%' as second from g)
select t.track_id, t.line_no, coalesce(case when second then '+ ' || b.text else replace(b.text, 'a', '4') end, t.line) as line from t left join b using (track_id, line_no) left join f on f.track_id = b.track_id and f.batch = b.batch""",
    "translated_files": f"""with {CUES}, l as (select track_id, pos * 4 + k as line_no, case k when 0 then (pos + 1)::varchar when 1 then '00:00:00,000 --> 00:00:01,000' when 2 then raw_text else '' end as line, k from cues, range(0, 4) r(k))
select track_id, line_no, case when k = 2 and not regexp_full_match(trim(line), '[0-9]*') and not contains(line, '-->') then '+ ' || trim(line) else line end as line from l""",
    "speech_times": f"""with {CUES} select track_id, pos as seg_no, start_ms + case when pos % 3 = 0 then 40 else 0 end as start_ms, end_ms - case when pos % 3 = 0 then 20 else 0 end as end_ms, trim(raw_text) as text from cues where pos % 11 <> 0""",
    "screen_ends": f"""with {CUES}, n as (select *, lead(start_ms) over (partition by track_id order by pos) as nxt from cues)
select track_id, pos, case when (pos + 1) % 3 = 1 and nxt is not null then nxt else start_ms + 3000 end as end_ms from n where pos % 3 <> 1""",
}
