"""JSON held in text cells: tolerant parsing and flattening, all inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column, SparkSession, functions as F

from ratetally.functions.text import bind, strip, text


def read_repeated_names(spark: SparkSession) -> None:
    """From now on the last member of a repeated name counts; without this such an object is not read at all."""
    spark.conf.set("spark.sql.variant.allowDuplicateKeys", "true")


def _first_object(s: Column) -> Column:
    """Text of the first JSON object that starts at any ``{`` of ``s``; what follows it is ignored."""
    starts = F.filter(F.sequence(F.lit(1), F.length(s)), lambda i: F.substr(s, i, F.lit(1)) == "{")
    none = F.lit(None).cast("string")

    def at(found, i):
        here = F.get_json_object(F.substr(s, i), "$")
        return F.when(found.isNotNull(), found).otherwise(F.when(here.startswith("{"), here))

    # Nothing is parsed once an object is found.
    return F.when(s.contains("{"), F.aggregate(starts, none, at))


def _clean(s: Column) -> Column:
    return F.regexp_replace(strip(s), "^﻿+", "")


def _decode_once(s: Column) -> Column:
    """Struct (obj, inner): the object in ``s``, or the string that ``s`` encodes."""
    undoubled = F.when(s.contains('""'), F.replace(s, F.lit('""'), F.lit('"')))
    as_is = F.try_parse_json(s)
    as_undoubled = F.try_parse_json(undoubled)

    def pick(v):
        kind = F.schema_of_variant(v)
        obj = F.when(kind.startswith("OBJECT"), F.to_json(v))
        inner = F.when(kind == "STRING", F.try_variant_get(v, "$", "string"))
        return F.struct(obj.alias("obj"), inner.alias("inner"))

    def finish(v):
        searched = F.coalesce(_first_object(s), _first_object(undoubled))
        embedded = F.struct(searched.alias("obj"), F.lit(None).cast("string").alias("inner"))
        return F.when(v.isNotNull(), pick(v)).otherwise(embedded)

    return bind(F.coalesce(as_is, as_undoubled), finish)


def parse_json_cell(c: Column, depth: int = 4) -> Column:
    """JSON object text held by a cell, or null.

    Accepts a byte-order mark, quotes doubled by SQL literals, text around the object, and up to
    ``depth`` levels of an object encoded as a JSON string.
    """
    start = F.struct(F.lit(None).cast("string").alias("obj"), _clean(text(c)).alias("inner"))

    def step(acc, _):
        again = bind(_clean(acc["inner"]), _decode_once)
        return F.when(acc["obj"].isNull() & (acc["inner"] != ""), again).otherwise(
            F.struct(acc["obj"].alias("obj"), F.lit(None).cast("string").alias("inner"))
        )

    walked = F.aggregate(F.sequence(F.lit(1), F.lit(depth)), start, step)
    return F.when(text(c).contains("{"), walked["obj"])


def json_members(json_text: Column) -> Column:
    """MAP<STRING, VARIANT> of the members of a JSON object text."""
    return F.try_variant_get(F.try_parse_json(json_text), "$", "map<string,variant>")


def has_nested_object(json_text: Column) -> Column:
    return F.coalesce(
        F.exists(F.map_values(json_members(json_text)), lambda v: F.schema_of_variant(v).startswith("OBJECT")),
        F.lit(False),
    )


def unwrap_from(member: Column, depth: int = 4) -> Column:
    """Follow ``FROM`` inside nested objects up to ``depth`` levels and return text."""
    inner = F.aggregate(
        F.sequence(F.lit(1), F.lit(depth)),
        member,
        lambda acc, _: F.coalesce(F.try_variant_get(acc, "$.FROM", "variant"), acc),
    )
    return inner.cast("string")


def flatten_json(json_text: Column, depth: int = 4) -> Column:
    """MAP<STRING, STRING> of a JSON object text with ``FROM`` wrappers removed."""
    return F.transform_values(json_members(json_text), lambda _, v: unwrap_from(v, depth))


def parse_column_map(c: Column) -> Column:
    """MAP of a stored column mapping: trimmed, blank left names dropped, not an object gives an empty map."""
    pairs = F.transform(
        F.map_entries(F.coalesce(flatten_json_plain(c), F.create_map().cast("map<string,string>"))),
        lambda e: F.struct(strip(e["key"]).alias("key"), strip(e["value"]).alias("value")),
    )
    return distinct_map(F.filter(pairs, lambda e: e["key"] != ""))


def flatten_json_plain(json_text: Column) -> Column:
    """MAP<STRING, STRING> of a JSON object text, values as text."""
    return F.transform_values(json_members(json_text), lambda _, v: v.cast("string"))


def distinct_map(entries: Column) -> Column:
    """MAP from an ARRAY of (key, value) structs; the last value of a key wins, at its first place."""

    def mapped(own):
        keys = F.array_distinct(F.transform(own, lambda e: e["key"]))
        return F.map_from_arrays(keys, F.transform(keys, lambda k: F.element_at(F.filter(own, lambda e: e["key"] == k), -1)["value"]))

    # Within the array of one the entries are a variable; named in the lambdas they would be made anew for every key.
    return F.transform(F.array(entries), mapped)[0]


def invert_map(m: Column) -> Column:
    """MAP of upper-cased value to key; the last entry wins."""
    return distinct_map(
        F.transform(F.map_entries(m), lambda e: F.struct(F.upper(strip(e["value"])).alias("key"), e["key"].alias("value")))
    )


def paired_count(m: Column) -> Column:
    """Number of entries with text on both sides."""
    return F.size(F.filter(F.map_entries(m), lambda e: (strip(e["key"]) != "") & (strip(e["value"]) != "")))


def left_for_right(m: Column, right_name: str) -> Column:
    """First key whose value is ``right_name`` without regard to case, else null."""
    hits = F.filter(F.map_entries(m), lambda e: F.upper(strip(e["value"])) == right_name.strip().upper())
    return F.get(hits, F.lit(0))["key"]


def record_text(cell: Column) -> Column:
    """Display text of a record cell held as JSON: ``display_value``, else ``value``, else the plain text."""
    is_object = F.coalesce(cell.startswith("{"), F.lit(False))
    shown = F.coalesce(F.get_json_object(cell, "$.display_value"), F.get_json_object(cell, "$.value"))
    return strip(F.when(is_object, shown).otherwise(cell))
