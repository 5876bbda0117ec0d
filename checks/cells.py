"""Queries over the cell, text and date functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import check, read
from ratetally.functions import cells, dates, names, text
from ratetally.operators import links
from ratetally.operators.registry import resolve_state
from ratetally.operators.spread import number_rows

WS = r"trim(regexp_replace({0}, '\s+', ' ', 'g'))"


@check(f"SELECT doc_id, md5({WS.format('text')}) AS t, md5(replace(replace(upper({WS.format('text')}), 'ß', 'SS'), 'ẞ', 'SS')) AS k FROM documents")
def normalized_text(spark, sf):
    d = read(spark, sf, "documents")
    return d.select("doc_id", F.md5(text.norm_text(F.col("text"))).alias("t"), F.md5(text.norm_key(F.col("text"))).alias("k"))


@check(f"SELECT doc_id, md5(lower({WS.format('nfc_normalize(text)')})) AS t FROM documents")
def normalized_labels(spark, sf):
    return read(spark, sf, "documents").select("doc_id", F.md5(text.norm_label(F.col("text"))).alias("t"))


DIRTY = """CASE l_linenumber % 6 WHEN 0 THEN '$' || p WHEN 1 THEN '(' || p || ')' WHEN 2 THEN ' ' || p || ' USD' WHEN 3 THEN 'J' || cast(l_partkey AS varchar) WHEN 4 THEN '-' || p ELSE '1-2' END"""


def dirty_prices(spark, sf):
    p = F.col("l_extendedprice").cast("decimal(18,2)").cast("string")
    n = F.col("l_linenumber") % 6
    v = (
        F.when(n == 0, F.concat(F.lit("$"), p)).when(n == 1, F.concat(F.lit("("), p, F.lit(")"))).when(n == 2, F.concat(F.lit(" "), p, F.lit(" USD")))
        .when(n == 3, F.concat(F.lit("J"), F.col("l_partkey").cast("string"))).when(n == 4, F.concat(F.lit("-"), p)).otherwise("1-2")
    )
    return read(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", v.alias("v"))


@check(f"""SELECT l_orderkey, l_linenumber, l_partkey, coalesce(cast(cast(round(x * 100, 0) AS bigint) AS varchar), '') AS loose,
 coalesce(cast(CASE WHEN l_linenumber % 6 IN (0, 4) THEN cast(round(x * 100, 0) AS bigint) WHEN l_linenumber % 6 = 1 THEN -cast(round(x * 100, 0) AS bigint) END AS varchar), '') AS strict
 FROM (SELECT *, try_cast(regexp_replace({DIRTY}, '[^0-9.\\-]', '', 'g') AS decimal(37,10)) AS x FROM (SELECT *, cast(cast(l_extendedprice AS decimal(18,2)) AS varchar) AS p FROM lineitem))""")
def loose_and_strict_numbers(spark, sf):
    cents = lambda c: F.coalesce(F.round(c * 100, 0).cast("bigint").cast("string"), F.lit(""))
    d = dirty_prices(spark, sf)
    return d.select("l_orderkey", "l_linenumber", "l_partkey", cents(cells.loose_decimal(F.col("v"))).alias("loose"), cents(cells.strict_decimal(F.col("v"))).alias("strict"))


@check("""SELECT p_partkey, x = y OR abs(x - y) <= 0.005 AS plain, x = y OR round(x, 2) = round(y, 2) AS money,
 CASE WHEN x = y THEN cast(x AS varchar) ELSE cast(cast(round(x, 2) AS decimal(20,2)) AS varchar) END AS shown
 FROM (SELECT p_partkey, cast(p_retailprice AS decimal(18,3)) AS x, cast(cast(p_retailprice AS decimal(18,3)) + cast((p_partkey % 13) AS decimal(18,3)) / 1000 AS decimal(18,3)) AS y FROM part)""")
def cell_comparison(spark, sf):
    x = F.col("p_retailprice").cast("decimal(18,3)")
    y = (x + ((F.col("p_partkey") % 13).cast("decimal(18,3)") / 1000)).cast("decimal(18,3)")
    plain, money = cells.compare_cells(x, y, False), cells.compare_cells(x, y, True)
    return read(spark, sf, "part").select("p_partkey", plain["same"].alias("plain"), money["same"].alias("money"), money["left_value"].alias("shown"))


NAMES = ["Facility Rate", "facility_rate", "unit_fee", "Procedure Code", "Effective Date", "Allowed", "NFC", "Reimbursement", "Fee Description", "non-facility", "Charge", "year cost"]


@check(f"""SELECT p_partkey, (p_partkey % 12) IN (0, 1, 6, 7, 8, 9, 11) AS money, (p_partkey % 12) IN (0, 1, 6, 7, 8, 9, 10) AS preview FROM part""")
def money_names(spark, sf):
    n = F.element_at(F.array(*[F.lit(x) for x in NAMES]), (F.col("p_partkey") % 12 + 1).cast("int"))
    return read(spark, sf, "part").select("p_partkey", names.money_name(n).alias("money"), names.money_name(n, "preview").alias("preview"))


@check("""SELECT o_orderkey, rtrim(rtrim(cast(cast(o_totalprice AS decimal(18,4)) AS varchar), '0'), '.') AS price, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') AS at,
 cast(cast(o_orderdate AS date) AS varchar) AS day, CASE WHEN o_orderkey % 2 = 0 THEN 'true' ELSE '' END AS flag FROM orders""")
def displayed_values(spark, sf):
    o = read(spark, sf, "orders").select(
        "o_orderkey", F.col("o_totalprice").cast("decimal(18,4)").alias("price"), F.col("o_orderdate").alias("at"), F.to_date("o_orderdate").alias("day"),
        F.when(F.col("o_orderkey") % 2 == 0, True).alias("flag"),
    )
    m = o.withColumn("m", cells.display_row(o))
    return m.select("o_orderkey", *[F.element_at("m", F.lit(c)).alias(c) for c in ("price", "at", "day", "flag")])


@check("""SELECT p_partkey, 'brand#' || lpad('' || length(regexp_extract(p_brand, '\\d+')), 4, '0') || regexp_extract(p_brand, '\\d+') || ' no ' || lpad('' || length('' || p_partkey), 4, '0') || p_partkey AS k FROM part""")
def natural_keys(spark, sf):
    v = F.concat(F.col("p_brand"), F.lit(" No 00"), F.col("p_partkey").cast("string"))
    p = read(spark, sf, "part").select("p_partkey", text.natural_key(v).alias("k"))
    return p.orderBy("k")


@check("""SELECT p_partkey, lower(replace(p_name, ' ', '_') || '_' || p_type || '_') || (p_partkey % 10) AS slug FROM part""")
def slugs(spark, sf):
    v = F.concat(F.lit(" --"), F.col("p_name"), F.lit(" ("), F.col("p_type"), F.lit(") "), (F.col("p_partkey") % 10).cast("string"), F.lit("/ "))
    return read(spark, sf, "part").select("p_partkey", text.slug(v).alias("slug"))


@check("""SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN '' ELSE lower(c_name) || '@example.com' END AS email FROM customer""")
def emails(spark, sf):
    v = F.concat(F.lit(" "), F.col("c_name"), F.when(F.col("c_custkey") % 4 == 0, "").otherwise("@Example.COM "))
    return read(spark, sf, "customer").select("c_custkey", F.coalesce(text.norm_email(v), F.lit("")).alias("email"))


@check("""SELECT l_orderkey, l_linenumber, l_partkey, CASE l_linenumber % 5 WHEN 0 THEN 'money' WHEN 1 THEN 'rate_id' WHEN 2 THEN 'short_word' WHEN 3 THEN 'short_number' ELSE 'text' END AS shape FROM lineitem""")
def cell_shapes(spark, sf):
    n = F.col("l_linenumber") % 5
    v = (
        F.when(n == 0, F.col("l_extendedprice").cast("decimal(18,2)").cast("string"))
        .when(n == 1, F.concat(F.lpad((F.col("l_partkey") % 10000).cast("string"), 5, "1"), F.lit("HR")))
        .when(n == 2, F.col("l_returnflag")).when(n == 3, F.col("l_quantity").cast("int").cast("string")).otherwise(F.concat("l_returnflag", F.lit(" text")))
    )
    return read(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", cells.cell_shape(v).alias("shape"))


@check("""SELECT p_partkey, cast(CASE p_partkey % 4 WHEN 0 THEN 22 WHEN 1 THEN 24 WHEN 2 THEN 6 ELSE 0 END AS bigint) AS bonus FROM part""")
def header_words(spark, sf):
    n = F.col("p_partkey") % 4
    v = F.when(n == 0, "program name").when(n == 1, "rate code effective").when(n == 2, "fee schedule").otherwise(F.col("p_name"))
    return read(spark, sf, "part").select("p_partkey", cells.header_bonus(F.lower(v)).cast("bigint").alias("bonus"))


@check("""SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN '10.1%' WHEN 1 THEN '100%' WHEN 2 THEN '' ELSE '7.25' END AS shown FROM part""")
def percent_cells(spark, sf):
    n = F.col("p_partkey") % 4
    v = F.when(n == 0, "0.101").when(n == 1, "1.0").when(n == 2, "0.0").otherwise("7.25")
    return read(spark, sf, "part").select("p_partkey", cells.percent_text(v).alias("shown"))


def spelled(spark, sf, forms):
    d = F.col("o_orderdate")
    v = None
    for i, (before, fmt, after) in enumerate(forms):
        t = F.concat(F.lit(before), F.date_format(d, fmt), F.lit(after))
        v = F.when(F.col("o_orderkey") % (len(forms) + 1) == i, t) if v is None else v.when(F.col("o_orderkey") % (len(forms) + 1) == i, t)
    return read(spark, sf, "orders").select("o_orderkey", v.otherwise("no date 12").alias("v"))


def day_sql(n, ok=None):
    keep = f"o_orderkey % {n + 1} < {n}" if ok is None else ok
    return f"SELECT o_orderkey, CASE WHEN {keep} THEN cast(cast(o_orderdate AS date) AS varchar) ELSE '' END AS day FROM orders"


PORTAL = [("", "yyyy-MM-dd", ""), ("", "MM-dd-yyyy", " 08:30"), (" ", "MM/dd/yyyy", " "), ("", "MM/dd/yy", ""), ("", "yyyy/MM/dd", " x"), ("rev. ", "yyyy-MM-dd", ")"), ("from ", "MMMM d, yyyy", ""), ("", "MMM d yyyy", " on")]


@check(day_sql(8))
def portal_dates(spark, sf):
    return spelled(spark, sf, PORTAL).select("o_orderkey", F.coalesce(dates.portal_date(F.col("v")), F.lit("")).alias("day"))


@check(day_sql(8))
def row_portal_dates(spark, sf):
    m = F.create_map(F.lit("Title"), F.lit("2001-01-01"), F.lit("Posted"), F.lit("soon"), F.lit("Date"), F.col("v"))
    cols = F.array(F.lit("Title"), F.lit("Posted"), F.lit("Date"))
    return spelled(spark, sf, PORTAL).select("o_orderkey", F.coalesce(dates.row_portal_date(m, cols), F.lit("")).alias("day"))


@check(day_sql(5, "o_orderkey % 6 < 4"))
def link_text_dates(spark, sf):
    forms = [("Order Effective ", "MMMM d, yyyy", ""), ("effective ", "M/d/yyyy", " (PDF)"), ("Effective ", "M/d/yy", ""), ("x ", "yyyy-MM-dd", ""), ("Effective Foo", " d, yyyy", "")]
    return spelled(spark, sf, forms).select("o_orderkey", F.coalesce(dates.label_date(F.col("v")), F.lit("")).alias("day"))


@check(day_sql(5, "o_orderkey % 6 < 4"))
def hint_dates(spark, sf):
    forms = [("", "yyyy-MM-dd", "T00"), ("", "M/d/yyyy", " 7:05:00"), ("", "M-d-yyyy", ""), ("as of ", "yyyy-MM-dd", ""), ("", "M/d/yyyy", " tail")]
    return spelled(spark, sf, forms).select("o_orderkey", F.coalesce(dates.hint_date(F.col("v")).cast("string"), F.lit("")).alias("day"))


@check("""SELECT o_orderkey, CASE WHEN o_orderkey % 5 < 4 THEN strftime(o_orderdate, '%m/%d/%Y') ELSE '' END AS day FROM orders""")
def cell_dates(spark, sf):
    forms = [("", "yyyy-MM-dd", " 00:00"), ("", "M/d/yyyy", ""), ("", "yyyy-MM-dd", ""), ("", "MMM d, yyyy", "")]
    return spelled(spark, sf, forms).select("o_orderkey", F.coalesce(dates.us_date(dates.cell_date(F.col("v"))), F.lit("")).alias("day"))


@check("""SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') ELSE '' END AS at FROM orders""")
def http_dates(spark, sf):
    forms = [("Sun, ", "dd MMM yyyy HH:mm:ss", " GMT")]
    out = spelled(spark, sf, forms)
    return out.select("o_orderkey", F.coalesce(F.date_format(dates.http_date(F.col("v")), "yyyy-MM-dd HH:mm:ss"), F.lit("")).alias("at"))


@check("""SELECT o_orderkey FROM orders WHERE cast(o_orderdate AS date) BETWEEN date '1995-03-15' AND date '1995-12-31'""")
def year_tail_filter(spark, sf):
    o = read(spark, sf, "orders").select("o_orderkey", F.date_format("o_orderdate", "MM/dd/yyyy").alias("eff"))
    return o.where(dates.in_year_tail(dates.cell_date(F.col("eff")), F.lit("1995-03-15").cast("date"))).select("o_orderkey")


@check("SELECT DISTINCT cast(cast(o_orderdate AS date) AS varchar) AS day FROM orders")
def effective_days(spark, sf):
    o = read(spark, sf, "orders").select(F.date_format("o_orderdate", "M/d/yyyy").alias("eff"))
    return o.select(dates.cell_date(F.col("eff")).cast("string").alias("day")).distinct().orderBy("day")


@check("""SELECT s_suppkey, CASE s_suppkey % 3 WHEN 0 THEN 'NY' WHEN 1 THEN 'NC' ELSE '' END AS code FROM supplier""")
def state_codes(spark, sf):
    n = F.col("s_suppkey") % 3
    s = read(spark, sf, "supplier").select("s_suppkey", F.when(n == 0, " n.y ").when(n == 1, "north  carolina").otherwise(F.col("s_name")).alias("state"))
    return resolve_state(s, "state").select("s_suppkey", F.coalesce("resolved_state", F.lit("")).alias("code"))


@check("""SELECT c_custkey, coalesce(cast(n_nationkey AS varchar), '') AS code FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey AND c_custkey % 2 = 0""")
def dimension_codes(spark, sf):
    dim = read(spark, sf, "nation").select(F.col("n_nationkey").cast("string").alias("code"), F.translate("n_name", "0123456789", "ABCDEFGHIJ").alias("name"))
    n = read(spark, sf, "nation").select("n_nationkey", F.lower(F.translate("n_name", "0123456789", "ABCDEFGHIJ")).alias("n"))
    c = read(spark, sf, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    c = c.select("c_custkey", F.when(F.col("c_custkey") % 2 == 0, F.replace("n", F.lit("_"), F.lit("  "))).otherwise("nowhere").alias("state"))
    return resolve_state(c, "state", dim).select("c_custkey", F.coalesce("resolved_state", F.lit("")).alias("code"))


ROLE_SQL = """SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'Fee Schedule' WHEN 1 THEN 'Rate Schedule' WHEN 2 THEN 'Document Title' ELSE 'Other' END AS schedule,
 CASE WHEN p_partkey % 4 < 3 THEN 'Program' ELSE '' END AS program, 'Eff Date' AS effective, CASE WHEN p_partkey % 4 = 3 THEN 'Other' ELSE 'HCPCS' END AS sort FROM part"""


@check(ROLE_SQL)
def column_roles(spark, sf):
    n = F.col("p_partkey") % 4
    third = F.when(n == 0, "Fee Schedule").when(n == 1, "Rate Schedule").otherwise("Document Title")
    cols = F.when(n < 3, F.array(F.lit("HCPCS"), F.lit("Program"), third, F.lit("End Date"), F.lit("Eff Date"))).otherwise(F.array(F.lit("Other"), F.lit("Term Date"), F.lit("Eff Date")))
    role = lambda r: F.coalesce(links.column_role(F.col("cols"), r), F.lit(""))
    return read(spark, sf, "part").select("p_partkey", cols.alias("cols")).select(
        "p_partkey", role("schedule").alias("schedule"), role("program").alias("program"), role("effective_date").alias("effective"), role("sort").alias("sort")
    )


@check("""SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN '2024-01-0' || (p_partkey % 9 + 1) WHEN p_partkey % 3 = 1 THEN 'yes' ELSE '' END AS hint FROM part""")
def effective_hints(spark, sf):
    n = F.col("p_partkey") % 3
    day = F.concat(F.lit("2024-01-0"), (F.col("p_partkey") % 9 + 1).cast("string"))
    m = F.when(n == 0, F.create_map(F.lit("EFFECT_X"), F.lit("zzzzzzzzzzzzz"), F.lit("Effective Date"), day)).when(
        n == 1, F.create_map(F.lit("EFFECT_X"), F.lit("yes"), F.lit("Effective Date"), F.lit(" "))
    ).otherwise(F.create_map(F.lit("CODE"), F.lit("1")))
    return read(spark, sf, "part").select("p_partkey", cells.effective_hint(m).alias("hint"))


@check("SELECT doc_id, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS place FROM documents")
def numbered_rows(spark, sf):
    d = read(spark, sf, "documents").select("doc_id", "lang")
    return number_rows(d, ["lang"], "doc_id", "place", rows_per_slice=97).select("doc_id", "place")
