"""Settings kept as JSON, read with defaults, bounds and the names that older files used."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import comma_list

#: Numbers that steer matching, as name, kind, default, least and most.
NUMBERS = """sync_sample_minutes int 6 1 30, sync_anchor_min_similarity double 0.38 0.0 1.0, sync_anchor_max_window_size int 5 1 20,
sync_anchor_max_candidates_from_edges int 8 1 16, sync_anchor_max_phrase_segments int 3 1 10, sync_anchor_min_text_length int 18 1 200,
sync_max_scale_delta double 0.08 0.0 0.5, sync_max_end_error_seconds double 1.0 0.0 10.0, sync_heavy_max_cue_gap_seconds double 3.5 0.0 30.0,
sync_heavy_max_transcript_gap_seconds double 3.5 0.0 30.0, sync_heavy_step_segments int 1 1 16"""
#: Services that may be asked; the first is the default.
SERVICES = ("DeepL", "Azure", "Gemini")


def numbers() -> list[tuple[str, str, float, float, float]]:
    rows = (x.split() for x in NUMBERS.split(","))
    return [(name, kind, *(int(v) if kind == "int" else float(v) for v in rest)) for name, kind, *rest in rows]


def read_settings(files: DataFrame) -> DataFrame:
    """files(id, settings) to one column a setting.

    A number that is missing or can't be read as its kind is the default, others are kept within bounds;
    a whole number may be written with a fraction, which goes, but not inside of quotes. What is no
    JSON object has defaults only. The target language may stand under its older name.
    """
    root = F.try_parse_json("settings")
    at = lambda key, kind: F.try_variant_get(root, f"$.{key}", kind)
    columns = []
    for name, kind, default, least, most in numbers():
        value = F.coalesce(at(name, kind), F.lit(default).cast(kind))
        columns.append(F.greatest(F.lit(least).cast(kind), F.least(value, F.lit(most).cast(kind))).alias(name))
    full = lambda x: F.when(x != "", x)
    target = F.coalesce(full(at("translation_target_language", "string")), full(at("target_language", "string")), F.lit(""))
    service = at("provider", "string")
    listed = at("subtitle_search_languages", "array<string>")
    some = F.filter(F.transform(listed, lambda x: F.btrim(x)), lambda x: x != "")
    languages = F.when(F.size(some) > 0, some).when(listed.isNotNull(), F.array(F.lit("en"))).otherwise(comma_list(at("subtitle_search_languages", "string")))
    return files.select(
        "id", *columns, F.when(service.isin(*SERVICES), service).otherwise(SERVICES[0]).alias("provider"), target.alias("translation_target_language"), F.array_join(languages, ",").alias("subtitle_search_languages"),
    )


#: Services with a key list and with days or switches of their own.
KEYED = ("DeepL", "Azure", "Gemini")


def _let(x: Column, f: Callable[[Column], Column]) -> Column:
    """f of x, which is worked out once however often f names it."""
    return F.element_at(F.transform(F.array(x), f), 1)


def _kind(x: Column) -> Column:
    return F.schema_of_variant(x)


def truthy(x: Column) -> Column:
    """Whether a JSON value counts as set: true, a number but 0, a text, list, or object that isn't empty."""
    text = x.try_cast("string")
    number = F.coalesce(text.try_cast("double") != 0, F.lit(True))
    known = lambda kind: F.when(x.isNull() | (kind == "VOID"), False).when(kind == "BOOLEAN", text == "true").when(kind == "STRING", text != "").when(kind.startswith("ARRAY") | kind.startswith("OBJECT"), ~F.to_json(x).isin("[]", "{}")).otherwise(number)
    return _let(_kind(x), known)


def _text(x: Column) -> Column:
    """A JSON value as text; lists and objects as JSON."""
    return F.coalesce(x.try_cast("string"), F.to_json(x))


def normalized_keys(listed: Column) -> Column:
    """A variant list of keys as array<struct<value, active, last_usage, last_error, last_error_at, vpn_config>>.

    An item is an object, or just the key. Blank ones go, as does all of what is no list. Exactly one key is active: the
    first that is marked so, else the first.
    """
    field = lambda x, name: F.try_variant_get(x, f"$.{name}", "variant")
    own = lambda x, is_object, name: _let(F.when(is_object, field(x, name)), lambda v: F.when(truthy(v), _text(v))).alias(name)
    value = lambda x, is_object: F.btrim(F.coalesce(F.when(is_object, F.coalesce(_let(field(x, "value"), _text), F.lit(""))).otherwise(_text(x)), F.lit("")))
    names = ("last_usage", "last_error", "last_error_at", "vpn_config")
    row = lambda x, o: F.struct(value(x, o).alias("value"), (o & truthy(field(x, "active"))).alias("marked"), *[own(x, o, n) for n in names])
    items = F.when(_kind(listed).startswith("ARRAY"), listed.try_cast("array<variant>"))
    rows = F.transform(F.coalesce(items, F.array().cast("array<variant>")), lambda x: _let(_kind(x).startswith("OBJECT"), lambda o: row(x, o)))
    full = F.filter(rows, lambda k: k["value"] != "")
    first = lambda ks: F.greatest(F.array_position(F.transform(ks, lambda k: k["marked"]), F.lit(True)), F.lit(1)) - 1
    chosen = lambda ks, at: F.transform(ks, lambda k, i: F.struct(k["value"].alias("value"), (i == at).alias("active"), *[k[n].alias(n) for n in names]))
    return _let(full, lambda ks: _let(first(ks), lambda at: chosen(ks, at)))


def shared_configs(keys: Column) -> Column:
    """Of map<provider, keys> the configurations that more than one key has, in order; each may belong to one only."""
    used = F.flatten(F.transform(F.map_values(keys), lambda ks: F.filter(F.transform(ks, lambda k: k["vpn_config"]), lambda c: c.isNotNull())))
    return _let(used, lambda all: F.array_sort(F.filter(F.array_distinct(all), lambda c: F.size(F.filter(all, lambda d: d == c)) > 1)))


def read_provider_settings(files: DataFrame) -> DataFrame:
    """files(id, settings) to (id, wait_ms, max_chars_per_request, retry_after_days, auto_change_key_on_error, provider_keys, shared).

    Maps from each service to its number, switch, or keys, in place and without exploding; a number that is
    missing or can't be read is 0, as are all of them where the map is no object.
    """
    files = files.select("id", F.try_parse_json("settings").alias("root"))
    root = F.col("root")
    number = lambda key, names: F.create_map(*[x for n in names for x in (F.lit(n), F.coalesce(F.try_variant_get(root, f"$.{key}.{n}", "int"), F.lit(0)))])
    switch = F.create_map(*[x for n in KEYED for x in (F.lit(n), truthy(F.try_variant_get(root, f"$.auto_change_key_on_error.{n}", "variant")))])
    keys = F.create_map(*[x for n in KEYED for x in (F.lit(n), normalized_keys(F.try_variant_get(root, f"$.provider_keys.{n}", "variant")))])
    out = files.select(
        "id", number("wait_ms", SERVICES).alias("wait_ms"), number("max_chars_per_request", SERVICES).alias("max_chars_per_request"), number("retry_after_days", KEYED).alias("retry_after_days"),
        switch.alias("auto_change_key_on_error"), keys.alias("provider_keys"),
    )
    return out.withColumn("shared", shared_configs(F.col("provider_keys")))
