"""JSON cell queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import check, read
from ratetally.functions import jsontext as j
from ratetally.operators import jsoncols, records

KINDS = "event_id % 6"


def messy(spark, sf):
    n, p = F.col("event_id") % 6, F.col("props")
    q = F.lit('"')
    v = (
        F.when(n == 0, p).when(n == 1, F.replace(p, q, F.lit('""'))).when(n == 2, F.concat(F.lit("note { x "), p, F.lit(" } end")))
        .when(n == 3, F.concat(q, F.replace(p, q, F.lit('\\"')), q)).when(n == 4, F.concat(F.lit("﻿ "), p)).otherwise(F.lit("plain { text"))
    )
    return read(spark, sf, "events").select("event_id", v.alias("v"))


@check(f"SELECT event_id, CASE WHEN {KINDS} < 5 THEN json_extract_string(props, '$.k') ELSE '' END AS k FROM events")
def json_cells(spark, sf):
    return messy(spark, sf).select("event_id", F.coalesce(F.get_json_object(j.parse_json_cell(F.col("v")), "$.k"), F.lit("")).alias("k"))


WRAP = """'{"FAC": {"FROM": {"FROM": "' || p_retailprice::decimal(18,2) || '"}}, "CODE": "' || p_partkey || '", "MISC": {"TO": 1}, "MOD": null}'"""


@check(f"""SELECT p_partkey, cast(cast(p_retailprice AS decimal(18,2)) AS varchar) AS fac, cast(p_partkey AS varchar) AS code, '{{"TO":1}}' AS misc, '' AS modifier FROM part""")
def unwrapped_json(spark, sf):
    v = F.concat(F.lit('{"FAC": {"FROM": {"FROM": "'), F.col("p_retailprice").cast("decimal(18,2)").cast("string"), F.lit('"}}, "CODE": "'), F.col("p_partkey").cast("string"), F.lit('", "MISC": {"TO": 1}, "MOD": null}'))
    m = read(spark, sf, "part").select("p_partkey", j.flatten_json(j.parse_json_cell(v)).alias("m"))
    get = lambda k: F.coalesce(F.element_at("m", F.lit(k)), F.lit(""))
    return m.select("p_partkey", get("FAC").alias("fac"), get("CODE").alias("code"), get("MISC").alias("misc"), get("MOD").alias("modifier"))


@check("""SELECT 'event_type' AS column_name, count(*) AS filled, cast(0 AS bigint) AS objects, cast(0 AS bigint) AS nested, false AS expand FROM events UNION ALL
SELECT 'props', count(*), count(*) FILTER (json_type(props) = 'OBJECT'), cast(0 AS bigint), true FROM events""")
def json_column_detection(spark, sf):
    return jsoncols.json_columns(read(spark, sf, "events"))


@check("SELECT DISTINCT unnest(json_keys(props)) AS key FROM events")
def json_key_union(spark, sf):
    return jsoncols.json_keys(read(spark, sf, "events"), ["props"])


@check("""SELECT event_id, event_type, json_extract_string(props, '$.k') AS k FROM events""")
def expanded_json_table(spark, sf):
    e = read(spark, sf, "events").select("event_id", "event_type", "props")
    return jsoncols.expand_json(e)


def calls(spark, sf):
    """One list call per order, its records built from the order lines."""
    rec = F.concat(
        F.lit('{"sys_id": "r'), (F.col("l_partkey") % 40).cast("string"), F.lit('", "name": {"display_value": "Part '), F.col("l_partkey").cast("string"),
        F.lit('", "value": "p"}, "qty": {"value": "'), F.col("l_quantity").cast("int").cast("string"), F.lit('"}, "file": {"type": "file_attachment", "value": "att'), F.col("l_suppkey").cast("string"),
        F.lit('", "display_value": "Sheet"}}'),
    )
    lines = read(spark, sf, "lineitem").select(F.col("l_orderkey").alias("scope"), F.struct("l_partkey", "l_suppkey", "l_extendedprice", rec.alias("rec")).alias("r"))
    lst = F.array_join(F.transform(F.array_sort(F.collect_list("r")), lambda r: r["rec"]), ",")
    body = F.concat(
        F.lit('{"result": {"data": {"table": "x_fee_schedule", "title": "Current", "fields": "name,qty,file", "column_labels": {"name": "Title", "qty": "Units", "file": "Link"}, "row_count": "'),
        F.count(F.lit(1)).cast("string"), F.lit('", "list": ['), lst, F.lit("]}}}"),
    )
    noise = '{"result": {"data": {"table": "fee_codes", "row_count": "99999", "list": [{"sys_id": "z"}]}}}'
    both = lines.groupBy("scope").agg(body.alias("data_sample")).withColumn("call_no", F.explode(F.array(F.lit(2), F.lit(1))))
    return both.select(
        "scope", "call_no", F.lit("https://s.example.com/api/now/sp/rectangle/w1").alias("url"), F.lit("POST").alias("method"), F.lit('{"p": 1}').alias("payload"),
        F.when(F.col("call_no") == 2, F.col("data_sample")).otherwise(noise).alias("data_sample"),
    )


@check("SELECT l_orderkey AS scope, 2 AS call_no FROM lineitem GROUP BY l_orderkey")
def best_list_call(spark, sf):
    return records.pick_best(calls(spark, sf), ["scope"]).select("scope", "call_no")


@check("""WITH o AS (SELECT l_orderkey, l_partkey, l_suppkey, l_quantity, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey, l_suppkey, l_extendedprice) - 1 AS n,
  count(*) OVER (PARTITION BY l_orderkey) AS total FROM lineitem),
d AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_partkey % 40 ORDER BY n) AS rn FROM o),
k AS (SELECT *, count(*) OVER (PARTITION BY l_orderkey) AS kept FROM d WHERE rn = 1)
SELECT l_orderkey AS scope, cast(n AS integer) AS row_no, 'r' || (l_partkey % 40) AS sys_id, 'Part ' || l_partkey AS title, cast(cast(l_quantity AS integer) AS varchar) AS units,
 'https://s.example.com/api/now/attachment/att' || l_suppkey || '/file' AS link, kept >= total AS complete FROM k""")
def flattened_records(spark, sf):
    r = records.flatten_records(calls(spark, sf), ["scope"])
    get = lambda k: F.element_at("cells", F.lit(k))
    return r.select("scope", "row_no", "sys_id", get("Title").alias("title"), get("Units").alias("units"), F.col("links")[0]["url"].alias("link"), "complete")
