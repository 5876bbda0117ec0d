"""Queries over catalog rows and their links."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from checks import check, read
from checks.pages import BUILT, HOME, URL, elements
from ratetally.functions.text import norm_catalog_value
from ratetally.operators import dedupe, links as l, pages as p

LINK = "struct<url:string,text:string,superseded:boolean,slot:string>"


def catalog(spark, sf) -> DataFrame:
    return p.html_tables(elements(spark, sf))


DAY = "'2024-01-' || substr(day, 4, 2)"
HEAD = "'Jan ' || cast(cast(substr(day, 4, 2) AS integer) AS varchar) || ', 2024'"


@check(f"""WITH {BUILT} SELECT page_id, {URL} AS file_url, CASE WHEN shown = '' THEN title ELSE 'PDF' END AS label, p_type || ' — ' || title || ' — ' || {HEAD} AS catalog_display_label,
 CASE WHEN shown = '' THEN lower(replace(title, ' ', '_')) ELSE 'pdf' END AS logical_schedule_key, {DAY} AS portal_date, 'row_cell' AS effective_date_source, false AS superseded_hint FROM t""")
def file_candidates(spark, sf):
    out = l.file_candidates(catalog(spark, sf), ["page_id"])
    return out.select("page_id", "file_url", "label", "catalog_display_label", "logical_schedule_key", "portal_date", "effective_date_source", "superseded_hint")


@check(f"""WITH {BUILT} SELECT page_id, k, CASE WHEN shown = '' THEN {URL} ELSE 'PDF' END AS cell FROM t""")
def hydrated_links(spark, sf):
    h = l.hydrate_links(catalog(spark, sf))
    k = F.regexp_extract(F.col("links")[0]["url"], r"(\d+)\.pdf", 1).cast("bigint")
    return h.select("page_id", k.alias("k"), F.element_at("cells", F.lit("Download PDF")).alias("cell"))


@check(f"""WITH {BUILT} SELECT page_id, {URL} AS url, shown AS label, false AS portal FROM t""")
def primary_links(spark, sf):
    c = catalog(spark, sf)
    return c.select("page_id", l.primary_link(F.col("cells"), F.col("columns"), F.col("links")).alias("x")).select("page_id", "x.url", "x.label", "x.portal")


@check(f"""WITH {BUILT}, o(ord, name) AS (VALUES (1, 'Program'), (2, 'Fee Schedule'), (3, 'Effective Date'), (4, 'Download PDF')) SELECT page_id, cast(ord AS integer) AS ord, name FROM o, (SELECT page_id FROM c WHERE n > 0)""")
def ordered_table_columns(spark, sf):
    return l.ordered_columns(catalog(spark, sf), ["page_id"], "columns")


def part_rows(spark, sf) -> DataFrame:
    """Catalog rows from parts: script links, file links, superseded and paging rows."""
    k = F.col("p_partkey")
    link = lambda u, t: F.struct(u.alias("url"), t.alias("text"), F.lit(False).alias("superseded"), F.lit("").alias("slot"))
    file = link(F.concat(F.lit("d/"), k.cast("string"), F.lit(".pdf")), F.lit("Rate order"))
    script = link(F.concat(F.lit("javascript:__doPostBack('g$lnkSelect"), k.cast("string"), F.lit("')")), F.lit("Select"))
    n = k % 4
    title = F.when(n == 3, F.lit(" 12 ")).otherwise(F.concat(F.col("p_name"), F.lit(" fee schedule"), F.when(k % 10 == 0, " (Superseded)").otherwise("")))
    cells = F.create_map(F.lit("Title"), title, F.lit("File Type"), F.when(n == 2, "Adobe PDF").otherwise(""), F.lit("_meta"), F.lit("superseded"))
    return read(spark, sf, "part").select(
        F.col("p_brand").alias("scope"), k.alias("row_no"), F.lit(0).alias("table_no"), F.lit("https://h.example.com").alias("url"), F.array(F.lit("Title"), F.lit("File Type")).alias("columns"), cells.alias("cells"),
        F.when(n == 0, F.array(file)).when(n == 1, F.array(script)).when(n == 2, F.array(script, file)).otherwise(F.array(file)).alias("links"),
    )


@check("""SELECT p_brand AS scope, count(*) FILTER (p_partkey % 4 < 3) AS catalog_file_like_rows, count(*) FILTER (p_partkey % 4 IN (0, 2)) AS rows_with_http_download_urls, count(*) FILTER (p_partkey % 4 = 1) AS rows_with_postback_only_links FROM part GROUP BY p_brand""")
def link_availability(spark, sf):
    return l.link_availability(part_rows(spark, sf), ["scope"]).select("scope", "catalog_file_like_rows", "rows_with_http_download_urls", "rows_with_postback_only_links")


@check("""SELECT p_partkey, p_partkey % 4 < 3 AS published, p_partkey % 4 = 2 AS entry, p_partkey % 10 = 0 AND p_partkey % 4 < 3 AS superseded, p_partkey % 3 = 0 AS paging FROM part""")
def row_predicates(spark, sf):
    r = part_rows(spark, sf)
    pager = F.array(F.when(F.col("row_no") % 3 == 0, "1 2").otherwise("1"), F.when(F.col("row_no") % 3 == 0, "Next >").otherwise("Next door"))
    no_links = F.array().cast(f"array<{LINK}>")
    return r.select(
        F.col("row_no").alias("p_partkey"), l.is_published_row(F.col("cells"), F.col("links")).alias("published"), l.is_publication_entry(F.col("cells")).alias("entry"),
        l.is_superseded(F.col("cells"), F.lit("order")).alias("superseded"), p.is_paging_row(no_links, pager).alias("paging"),
    )


def order_links(spark, sf) -> DataFrame:
    """Three links per order in shuffled places."""
    k = F.col("o_orderkey")
    link = lambda i, t, e, s: F.struct(F.lit(i).alias("pos"), F.concat(F.lit("https://h/"), k.cast("string"), F.lit(e)).alias("url"), F.lit(t).alias("text"), s.alias("superseded"))
    a = F.array(link(0, "Regulation text", ".pdf", F.lit(False)), link(1, "Order", ".doc", k % 3 == 0), link(2, "Orders of the director", ".xlsx", k % 2 == 0))
    return read(spark, sf, "orders").select(k.alias("row_id"), F.inline(a))


ORDER_LINKS = """o AS (SELECT o_orderkey AS k, unnest([{'pos': 0, 'e': '.pdf', 's': 0, 'r': 0}, {'pos': 1, 'e': '.doc', 's': (o_orderkey % 3 = 0)::int, 'r': 2}, {'pos': 2, 'e': '.xlsx', 's': (o_orderkey % 2 = 0)::int, 'r': 3}]) AS x FROM orders),
q AS (SELECT k, x.pos AS pos, x.e AS e, row_number() OVER (PARTITION BY k ORDER BY x.s, -x.r) AS rk FROM o)"""


@check(f"WITH {ORDER_LINKS} SELECT k AS row_id, cast(rk AS integer) AS place, 'https://h/' || k || e AS url, CASE WHEN rk = 1 THEN 'primary' ELSE 'alternate' END AS slot FROM q")
def ranked_links(spark, sf):
    s = order_links(spark, sf).withColumn("slot", F.lit(""))
    r = s.groupBy("row_id").agg(F.array_sort(F.collect_list(F.struct("pos", F.struct("url", "text", "superseded", "slot").alias("x")))).alias("a"))
    r = r.select("row_id", F.posexplode(l.rank_links(F.transform("a", lambda z: z["x"]))).alias("place", "x"))
    return r.select("row_id", (F.col("place") + 1).alias("place"), "x.url", "x.slot")


@check("""SELECT o_orderkey AS row_id, pos, CASE WHEN pos = 1 AND o_orderkey % 5 = 0 THEN 'Administrative director ' || o_orderkey ELSE ['Regulation text', 'Order', 'Orders of the director'][pos + 1] END AS text,
 cast(row_number() OVER (PARTITION BY o_orderkey ORDER BY CASE WHEN pos = 2 THEN o_orderkey % 2 = 0 WHEN pos = 1 AND o_orderkey % 5 = 0 THEN false WHEN pos = 1 THEN o_orderkey % 3 = 0 ELSE false END,
   CASE WHEN pos = 1 AND o_orderkey % 5 = 0 THEN -3 WHEN pos = 2 THEN -3 WHEN pos = 1 THEN -2 ELSE 0 END, CASE pos WHEN 2 THEN -3 WHEN 0 THEN -4 ELSE -1 END) AS integer) AS link_rank
 FROM orders, (VALUES (0), (1), (2)) v(pos)""")
def relabelled_links(spark, sf):
    o = order_links(spark, sf)
    k = F.col("row_id")
    lab = o.where("pos = 1 AND row_id % 5 = 0 OR pos = 0").select(
        F.concat(F.upper(F.lit("https://h")), F.substr("url", F.lit(10)), F.lit("#frag")).alias("url"), F.concat(F.lit(" Administrative director "), k.cast("string")).alias("display_label"), F.lit(False).alias("superseded"), k.alias("position"),
    )
    allowed = o.where("pos = 1").select("url")
    return l.apply_link_labels(o, lab, allowed, ["row_id"]).select("row_id", "pos", "text", "link_rank")


@check("""SELECT p_partkey, CASE WHEN p_brand <> 'Brand#1' AND p_partkey % 3 = 1 THEN 'New ' || p_partkey ELSE p_name END AS title, p_brand = 'Brand#1' AS restored FROM part WHERE p_brand = 'Brand#1' OR p_partkey % 3 <> 0""")
def outside_decisions(spark, sf):
    k = F.col("p_partkey")
    u = F.concat(F.lit("https://h/"), k.cast("string"))
    c = read(spark, sf, "part").select("p_partkey", F.col("p_brand").alias("scope"), u.alias("url"), F.col("p_name").alias("title"))
    gone = (F.col("p_brand") == "Brand#1") | (k % 3 == 0)
    d = read(spark, sf, "part").where(gone | (k % 3 == 1)).select(
        F.col("p_brand").alias("scope"), F.concat(u, F.lit(" ")).alias("url"), k.alias("position"), F.when(gone, False).alias("include"), F.when(k % 3 == 1, F.concat(F.lit(" New "), k.cast("string"))).alias("display_title"),
    )
    return l.apply_decisions(c, d, ["scope"]).select("p_partkey", "title", "restored")


@check("""SELECT (SELECT count(*) FROM part) AS rows_in, count(*) AS rows_out, cast(0 AS bigint) AS rows_restored FROM part WHERE p_partkey % 3 <> 0""")
def decision_totals(spark, sf):
    k = F.col("p_partkey")
    c = read(spark, sf, "part").select("p_partkey", F.lit("run").alias("scope"), k.cast("string").alias("url"), F.col("p_name").alias("title"))
    d = c.where("p_partkey % 3 = 0").select("scope", "url", k.alias("position"), F.lit(False).alias("include"), F.lit(None).cast("string").alias("display_title"))
    return l.decision_counts(c, l.apply_decisions(c, d, ["scope"]))


@check("""SELECT p_partkey AS row_no, p_brand AS scope FROM part QUALIFY row_number() OVER (PARTITION BY p_brand, p_type, p_size % 5 ORDER BY p_partkey) = 1""")
def deduplicated_rows(spark, sf):
    k = F.col("p_partkey")
    link = F.struct(F.col("p_type").alias("url"), F.col("p_name").alias("text"), F.lit(False).alias("superseded"), F.lit("").alias("slot"))
    c = F.when(k % 2 == 0, F.create_map(F.lit("a"), F.col("p_type"), F.lit("b"), (F.col("p_size") % 5).cast("string"))).otherwise(F.create_map(F.lit("b"), (F.col("p_size") % 5).cast("string"), F.lit("a"), F.col("p_type")))
    r = read(spark, sf, "part").select(k.alias("row_no"), F.col("p_brand").alias("scope"), c.alias("cells"), F.array(link).alias("links"))
    return dedupe.dedupe_rows(r, ["scope"], [F.col("row_no")]).select("row_no", "scope")


@check("""SELECT p_partkey FROM part WHERE p_size % 7 = 0 UNION ALL (SELECT p_partkey FROM part WHERE p_size % 7 <> 0 QUALIFY row_number() OVER (PARTITION BY p_name ORDER BY p_partkey) = 1)""")
def deduplicated_by_id(spark, sf):
    r = read(spark, sf, "part").select("p_partkey", F.when(F.col("p_size") % 7 == 0, " ").otherwise(F.col("p_name")).alias("id"))
    return dedupe.dedupe_by_id(r, "id", [F.col("p_partkey")]).select("p_partkey")


@check("""SELECT o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey % 10, o_orderpriority ORDER BY o_orderkey) = 1""")
def deduplicated_tables(spark, sf):
    first = F.array(F.col("o_orderpriority"), F.rpad(F.lit("x"), 60, "y"), F.lit("z"))
    t = read(spark, sf, "orders").select("o_orderkey", (F.col("o_custkey") % 10).alias("page"), dedupe.table_fingerprint(first).alias("fp"))
    return dedupe.dedupe_tables(t, ["page"], "fp", [F.col("o_orderkey")]).select("o_orderkey")


@check("""SELECT 'c' || c_custkey AS id, c_name AS a, '' AS b FROM customer UNION ALL SELECT 's' || s_suppkey, '', s_name FROM supplier""")
def union_of_tables(spark, sf):
    c = read(spark, sf, "customer").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("id"), F.col("c_name").alias("a"))
    s = read(spark, sf, "supplier").select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("id"), F.col("s_name").alias("b"))
    return dedupe.union_tables([c, s], c.limit(3)).fillna("")


def linkable(spark, sf, side) -> DataFrame:
    k = F.col("p_partkey")
    title = F.concat(F.col("p_name"), F.lit(" no "), F.lpad(k.cast("string"), 7, "0"))
    shown = title if side == "a" else F.when(k % 3 == 0, title).when(k % 3 == 1, F.upper(title)).otherwise(F.concat(F.lit("the "), title, F.lit(" pdf")))
    extra = F.lit("x") if side == "a" else F.when(k % 3 == 0, "x").otherwise("y")
    cells = F.create_map(F.lit("Title"), shown, F.lit("Note"), extra)
    t = read(spark, sf, "part").where("p_partkey % 7 <> 0" if side == "a" else "p_partkey % 5 <> 0")
    return t.select(
        k.alias(f"{side}_id"), l.row_fingerprint(cells).alias("fingerprint"), F.concat(F.lit("t"), (F.col("p_size") % 9).cast("string")).alias("token"), norm_catalog_value(shown, False).alias("title")
    )


@check("""SELECT p_partkey AS a_id, p_partkey AS b_id, CASE p_partkey % 3 WHEN 0 THEN 'fingerprint' WHEN 1 THEN 'title' ELSE 'contained' END AS how FROM part WHERE p_partkey % 7 <> 0 AND p_partkey % 5 <> 0""")
def linked_rows(spark, sf):
    return l.link_rows(linkable(spark, sf, "a"), linkable(spark, sf, "b"))


@check(f"""WITH {BUILT} SELECT page_id, k, 'current_fee_schedules' AS topic, 'primary' AS slot FROM t""")
def annotated_sections(spark, sf):
    e = elements(spark, sf)
    c = p.html_tables(e).withColumn("columns", F.concat("columns", F.array(F.lit("documents"))))
    heads = p.table_blocks(e).select("page_id", "table_no", F.col("heading_hint").alias("section"))
    out = l.annotate_sections(c.join(heads, ["page_id", "table_no"]))
    k = F.regexp_extract(F.col("links")[0]["url"], r"(\d+)\.pdf", 1).cast("bigint")
    return out.select("page_id", k.alias("k"), F.element_at("cells", F.lit("_fee_topic_slug")).alias("topic"), F.col("links")[0]["slot"].alias("slot"))
