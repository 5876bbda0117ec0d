"""Record lists captured from data APIs: choosing the call, labelling the columns, collecting attachments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ratetally.functions import urls
from ratetally.functions.jsontext import distinct_map
from ratetally.functions.text import bind, text
from ratetally.operators.spread import first_per_group

LIST_CALL = "/api/now/sp/rectangle/"
RESPONSE = (
    "result struct<data:struct<table:string, title:string, fields:string, "
    "column_labels:map<string,string>, row_count:string, list:array<string>>, template:string>"
)
CELL = "display_value string, value string, type string"
# White space of any kind, as ``strip`` takes it.
SPACES = "\t\n\x0b\f\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def _parsed(calls: DataFrame) -> DataFrame:
    """Calls with the parts of their response that are needed, read in one pass."""
    return calls.withColumn("_r", F.from_json("data_sample", RESPONSE)["result"])


def _get(name: str) -> Column:
    return F.col(f"_r.data.{name}")


def _is_list_call() -> Column:
    return F.coalesce(F.lower("url").contains(LIST_CALL) & (F.col("method") == "POST"), F.lit(False))


def _rank() -> list[Column]:
    """What ranks a parsed list call, the higher the better: numbers that are never null."""
    table, title = F.lower(text(_get("table"))), F.lower(text(_get("title")))
    priority = (
        F.when(table.contains("fee_codes") | table.contains("covered_code"), 0)
        .when(table.contains("fee_schedule"), 4)
        .when(title.contains("fee schedule") | title.contains("current fee"), 3)
        .when(title.contains("excel") | title.contains("download"), 2)
        .otherwise(1)
    )
    return [
        priority.alias("priority"), F.when(title.contains("archiv"), 0).otherwise(1).alias("active"),
        F.when(F.get_json_object("payload", "$").startswith("{") & (F.size(F.coalesce(F.json_object_keys("payload"), F.array().cast("array<string>"))) > 0), 1).otherwise(0).alias("has_payload"),
        F.coalesce(F.array_size(_get("list")), F.lit(0)).alias("listed"),
        F.coalesce(_get("row_count").try_cast("long"), F.lit(0).cast("long")).alias("declared"),
    ]


def list_calls(calls: DataFrame) -> DataFrame:
    """Calls (scope, call_no, url, method, payload, data_sample) that returned a record list, with their rank."""
    return _parsed(calls.where(_is_list_call())).withColumn("rank", F.struct(*_rank()))


def pick_best(calls: DataFrame, scope: list[str]) -> DataFrame:
    """The call of each scope that lists the published files best; the earlier one in a tie."""
    return first_per_group(list_calls(calls), scope, [F.col("rank").desc(), F.col("call_no")])


def _seen() -> Column:
    """Download prefix in the address of a call, else empty."""
    return F.regexp_extract(text(F.col("url")), r"^(.*?pubatt/dl/)", 1)


def _template_base(template: Column) -> Column:
    """Download prefix that a page template shows, else null."""
    template = text(template)
    absolute = F.regexp_extract(template, r"(?i)(https?://[^\"'\s>]+/pubatt/dl/)", 1)
    relative = F.regexp_extract(template, r"(/api/[A-Za-z0-9_]+/pubatt/dl/)", 1)
    origin = F.concat(urls.scheme(F.col("url")), F.lit("://"), urls.host(F.col("url")))
    return F.when(absolute != "", absolute).when(relative != "", F.concat(origin, relative))


def _first_base() -> Column:
    """Of a group of calls the prefix of the first address, else of the first template that has one."""
    return F.coalesce(F.min_by("seen", F.when(F.col("seen").isNotNull(), F.col("call_no"))), F.min_by("shown", F.when(F.col("shown").isNotNull(), F.col("call_no"))))


def download_base(calls: DataFrame, scope: list[str]) -> DataFrame:
    """Public download prefix of each scope, taken from the first call or page template that shows one."""
    template = F.from_json("data_sample", "result struct<template:string>")["result"]["template"]
    c = calls.select(*scope, "call_no", F.when(_seen() != "", _seen()).alias("seen"), _template_base(template).alias("shown"))
    return c.groupBy(*scope).agg(_first_base().alias("base"))


def flatten_records(calls: DataFrame, scope: list[str]) -> DataFrame:
    """Records of the best list call of each scope as catalog rows.

    Cells are keyed by the column labels of the call, ``sys_id`` is kept, attachments become links.
    Records with an id already seen are dropped. ``complete`` tells whether all declared rows are there.
    The calls are shuffled once, by scope, each task sending one call per scope at most. A list is one cell, so repeated ids are found within its row, by
    sorting ids and places; its records are read one by one after that and go nowhere. Of a repeated member of a cell the last one counts.
    """
    data, seen, shown = F.col("_r.data"), _seen(), _template_base(F.col("_r.template"))
    # The earlier, the better: complements of the numbers turn their order round.
    place = F.struct(*[F.bitwise_not(c).alias(f"o{i}") for i, c in enumerate(_rank())], F.col("call_no"))
    c = _parsed(calls).select(
        *scope, "call_no", F.when(_is_list_call(), place).alias("_place"), F.struct("url", data.alias("data")).alias("_call"),
        F.when(seen != "", seen).alias("seen"), shown.alias("shown"),
    )
    best = c.groupBy(*scope).agg(F.min_by("_call", "_place").alias("_best"), _first_base().alias("base")).where(F.col("_best").isNotNull())
    get = lambda name: F.col(f"_best.data.{name}")
    best = best.select(
        *scope, F.col("_best.url").alias("url"), "base",
        F.split(F.nullif(get("fields"), F.lit("")), ",").alias("fields"),
        get("column_labels").alias("labels"),
        F.coalesce(get("row_count").try_cast("long"), F.array_size(get("list")).cast("long")).alias("declared"),
        get("table").alias("source_table"),
        get("list").alias("list"),
    )
    listed = F.transform("list", lambda s, i: F.struct(i.alias("row_no"), s.alias("record"), F.get_json_object(s, "$.sys_id").alias("id")))
    best = best.withColumn("_records", first_of_ids(F.filter(listed, lambda x: x["record"].startswith("{")))).drop("list")
    origin = F.concat(urls.scheme(F.col("url")), F.lit("://"), urls.host(F.col("url")))
    best = best.withColumn("origin", origin).withColumn("_kept", F.size("_records"))
    # Outer, since a filter for empty lists would be put before the step that makes them and make them twice.
    r = best.withColumn("_record", F.explode_outer("_records")).where(F.col("_record").isNotNull()).drop("_records")

    # A record is read once and every cell of it once.
    label = lambda f: F.coalesce(F.element_at("labels", f), f)
    is_object = lambda cell: F.coalesce(cell.startswith("{"), F.lit(False))
    holds_object = lambda cell: is_object(cell) | (cell.contains("{") & cell.rlike(r"^[ \t\r\n]+\{"))
    shows = lambda e: F.when(is_object(e["cell"]), F.coalesce(e["read"]["display_value"], e["read"]["value"])).otherwise(e["cell"])
    is_file = lambda e: F.lower(e["read"]["type"]) == "file_attachment"

    def cells_of(rec):
        one = lambda f, cell: F.struct(label(f).alias("key"), cell.alias("cell"), F.when(holds_object(cell), F.from_json(cell, CELL)).alias("read"))
        cells = F.transform(F.coalesce("fields", F.map_keys(rec)), lambda f: one(f, F.element_at(rec, f)))
        return F.transform(cells, lambda e: F.struct(e["key"].alias("key"), trimmed(shows(e)).alias("value"), F.when(is_file(e), trimmed(e["read"]["value"])).alias("file")))

    def link(e):
        return F.struct(
            F.when(F.col("base").isNotNull(), F.concat("base", e["file"])).otherwise(F.concat("origin", F.lit("/api/now/attachment/"), e["file"], F.lit("/file"))).alias("url"),
            F.when(e["value"] != "", e["value"]).otherwise("Download").alias("text"), F.lit(False).alias("superseded"), F.lit("").alias("slot"),
        )

    r = r.select(
        "*", F.col("_record.row_no").alias("row_no"), record_id(F.col("_record.id")).alias("sys_id"),
        bind(F.from_json("_record.record", "map<string,string>"), cells_of).alias("_cells"),
    )
    own = lambda c: F.when(F.col("sys_id") != "", F.array(c)).otherwise(F.array().cast("array<string>"))
    keys, shown = F.concat("_cells.key", own(F.lit("sys_id"))), F.concat("_cells.value", own(F.col("sys_id")))
    entries = F.zip_with(keys, shown, lambda k, v: F.struct(k.alias("key"), v.alias("value")))
    cells = F.when(F.size(F.array_distinct(keys)) == F.size(keys), F.map_from_arrays(keys, shown)).otherwise(distinct_map(entries))
    return r.select(
        *scope, "url", "row_no", "source_table", "declared", "sys_id", F.col("_cells.key").alias("columns"), cells.alias("cells"),
        F.transform(F.filter("_cells", lambda e: F.coalesce(e["file"] != "", F.lit(False))), link).alias("links"),
        (F.col("_kept") >= F.col("declared")).alias("complete"),
    )


def first_of_ids(records: Column) -> Column:
    """Of an ARRAY of structs with an ``id`` cell the first of every id and all without one, in any order."""

    def firsts(rs, ids):
        placed = lambda keep: F.filter(F.transform(ids, lambda x, i: F.struct(x.alias("id"), i.alias("at"))), keep)
        heads = lambda s: F.filter(s, lambda x, i: (i == 0) | (F.get(s, i - 1)["id"] != x["id"]))
        named = bind(F.array_sort(placed(lambda x: x["id"] != "")), heads)
        return F.transform(F.concat(named, placed(lambda x: x["id"] == "")), lambda x: F.get(rs, x["at"]))

    def chosen(rs):
        ids = F.transform(rs, lambda x: record_id(x["id"]))
        return bind(ids, lambda i: F.when(F.size(F.array_distinct(i)) < F.size(i), firsts(rs, i)).otherwise(rs))

    return bind(records, chosen)


def trimmed(s: Column) -> Column:
    """``strip`` without a pattern."""
    return F.coalesce(F.trim(s, F.lit(SPACES)), F.lit(""))


def record_id(cell: Column) -> Column:
    """Id text of a record: its value, else what it displays, else the plain text."""
    is_object = F.coalesce(cell.startswith("{"), F.lit(False))
    return trimmed(F.when(is_object, F.coalesce(F.get_json_object(cell, "$.value"), F.get_json_object(cell, "$.display_value"))).otherwise(cell))
