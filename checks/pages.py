"""Page queries: on the given pages, and on pages with tables that Spark writes from suppliers and parts."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from checks import check, read
from ratetally.functions import urls
from ratetally.operators import frontier, links, pages as p
from ratetally.operators.spread import cut_lineage, stored_columns
from ratetally.sources.html import page_elements

HOME = "https://portal.example.com/rates/"
# Pages that one task builds and parses.
PAGES_PER_TASK = 250


def built_pages(spark, sf) -> DataFrame:
    """One page per supplier with a table of its parts, the same table again, an archive section and a footer."""
    n = read(spark, sf, "supplier").count()
    k = F.col("p_partkey")
    day = F.concat(F.lit("01/"), F.lpad((F.col("p_size") % 28 + 1).cast("string"), 2, "0"), F.lit("/2024"))
    shown = F.when(k % 2 == 0, "").otherwise("PDF")
    row = F.concat(
        F.lit("<tr><td></td><td>"), F.col("p_type"), F.lit("</td><td><b>"), F.col("p_name"), F.lit("</b> "), k.cast("string"), F.lit("</td><td>"), day,
        F.lit('</td><td><a href="files/'), k.cast("string"), F.lit('.pdf">'), shown, F.lit("</a></td></tr>"),
    )
    rows = read(spark, sf, "part").select((k % n).alias("page_id"), k.alias("k"), row.alias("row"))
    rows = rows.groupBy("page_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "row"))), lambda r: r["row"]), "\n").alias("body"))
    s = F.col("page_id").cast("string")
    table = F.concat(
        F.lit('<table><tr><td>User information</td><td>Login</td></tr><tr><th>Program</th><th>» Fee Schedule</th><th>Effective Date</th><th>Download PDF</th></tr>'),
        F.col("body"), F.lit('<tr><td>1 2</td><td>Next &gt;</td></tr></table>'),
    )
    html = F.concat(
        F.lit('<!DOCTYPE html><html><head><title>T</title><script>var next="<td>";</script></head><body><nav><a href="/home">Home</a> <a href="'), (F.col("page_id") + 1).cast("string"), F.lit('/index.html#top">Next page</a></nav><h2>Current  Fee Schedules</h2><p>All rates.</p>'),
        table, F.lit("<h3>Again</h3>"), table, F.lit('<h3>Archive</h3><p>Old ones, file updated 01/02/23</p><p><a href="/rates/'), s, F.lit('/../old/'), s, F.lit('.xlsx">Rate manual</a></p><footer><a href="/f.pdf">f</a></footer></body></html>'),
    )
    # The pages are far larger than the ids they are made of, so the ids are dealt out before.
    ids = read(spark, sf, "supplier").select(F.col("s_suppkey").alias("page_id")).repartition(n // PAGES_PER_TASK + 1, "page_id")
    return ids.join(rows, "page_id", "left").withColumn("body", F.coalesce("body", F.lit(""))).select(
        "page_id", F.concat(F.lit(HOME), s, F.lit("/index.html")).alias("url"), html.alias("html")
    )


def elements(spark, sf, *kinds):
    # Every operator below reads the elements several times: the pages are parsed once and stored, with the kinds it reads.
    return stored_columns(page_elements(built_pages(spark, sf), kinds or None))


BUILT = """s AS (SELECT s_suppkey AS page_id FROM supplier),
t AS (SELECT p_partkey % (SELECT count(*) FROM supplier) AS page_id, p_partkey AS k, p_type, p_name || ' ' || p_partkey AS title, '01/' || lpad('' || (p_size % 28 + 1), 2, '0') || '/2024' AS day,
  CASE WHEN p_partkey % 2 = 0 THEN '' ELSE 'PDF' END AS shown, row_number() OVER (PARTITION BY p_partkey % (SELECT count(*) FROM supplier) ORDER BY p_partkey) AS n FROM part),
c AS (SELECT s.page_id, count(k) AS n FROM s LEFT JOIN t USING (page_id) GROUP BY 1)"""
URL = f"'{HOME}' || page_id || '/files/' || k || '.pdf'"


@check("""WITH a AS (SELECT page_id, url, unnest(regexp_extract_all(html, '<a href="([^"]*)"', 1)) AS href FROM pages)
SELECT page_id, regexp_extract(url, '^https?://[^/?#]+') || replace(href, '&amp;', '&') AS link FROM a""")
def anchors_of_given_pages(spark, sf):
    e = page_elements(read(spark, sf, "pages"))
    return e.where("kind = 'anchor'").select("page_id", urls.join_url(F.col("url"), F.col("href")).alias("link"))


@check("""SELECT page_id, len(regexp_extract_all(html, '<h[1-5]>')) AS headings, len(regexp_extract_all(html, '<(ul|ol|article|main|button|select|input|form)[ >]')) AS controls FROM pages""")
def counts_of_given_pages(spark, sf):
    e = page_elements(read(spark, sf, "pages"))
    return e.groupBy("page_id").agg(F.count_if(F.col("kind") == "heading").alias("headings"), F.count_if(F.col("kind") == "control").alias("controls"))


@check("""SELECT page_id, w AS is_wall, NOT w AND (html LIKE '%<input%' OR html LIKE '%<button%' OR html LIKE '%<select%'
 OR regexp_matches(lower(regexp_replace(html, '<script.*?</script>|<style.*?</style>|<!--.*?-->|<[^>]*>', chr(10), 'g')), 'fee|schedule|reimbursement|provider|rate book|rate manual|medi-cal|medicaid|hcpcs|cpt|allowable'))
 AS is_real FROM (SELECT *, length(html) < 400 OR regexp_matches(lower(html), 'access denied|request id:|request blocked|automated access|bot detection|verify you are human') AS w FROM pages)""")
def gate_of_given_pages(spark, sf):
    g = read(spark, sf, "pages")
    return p.page_gate(g, cut_lineage(page_elements(g))).select("page_id", "is_wall", "is_real")


@check("SELECT s_nationkey AS page_id, '' || s_suppkey AS code, 'v60 ' || s_suppkey AS last, cast(60 AS integer) AS width FROM supplier")
def wide_tables_with_one_header(spark, sf):
    """Pages with two tables of sixty columns that share their header and differ in their rows."""
    k = F.col("s_suppkey")
    cells = F.array_join(F.transform(F.sequence(F.lit(2), F.lit(60)), lambda i: F.concat(F.lit("<td>v"), i.cast("string"), F.lit(" "), k.cast("string"), F.lit("</td>"))), "")
    row = F.concat(F.lit("<tr><td>"), k.cast("string"), F.lit("</td>"), cells, F.lit("</tr>"))
    head = "<tr><th>Procedure Code</th>" + "".join(f"<th>Rate {i}</th>" for i in range(2, 61)) + "</tr>"
    body = F.array_join(F.array_sort(F.collect_list("row")), "")
    tables = read(spark, sf, "supplier").select(F.col("s_nationkey").alias("page_id"), (k % 2).alias("half"), row.alias("row")).groupBy("page_id", "half").agg(F.concat(F.lit(f"<table>{head}"), body, F.lit("</table>")).alias("t"))
    pages = tables.groupBy("page_id").agg(F.concat(F.lit("<html><body>"), F.array_join(F.array_sort(F.collect_list("t")), ""), F.lit("</body></html>")).alias("html"))
    out = p.html_tables(cut_lineage(page_elements(pages.select("page_id", F.lit(HOME).alias("url"), "html"))))
    return out.select("page_id", F.element_at("cells", F.lit("Procedure Code")).alias("code"), F.element_at("cells", F.lit("Rate 60")).alias("last"), F.size("columns").alias("width"))


@check(f"""WITH {BUILT} SELECT page_id, cast(1 AS bigint) AS tables, n + 3 AS table_rows, 2 * n + 4 AS links, cast(0 AS bigint) AS lists, n + 2 AS file_links, 'pdf,xlsx' AS file_types FROM c""")
def page_counters(spark, sf):
    return p.page_counts(elements(spark, sf)).select("page_id", *[F.col(c).cast("bigint").alias(c) for c in ("tables", "table_rows", "links", "lists", "file_links")], "file_types")


@check(f"""WITH {BUILT} SELECT page_id, 'dynamic_application_rendered' AS page_type, CASE page_id % 3 WHEN 0 THEN 'C4_BLOCKED' WHEN 1 THEN 'C3_SPA_APP' ELSE 'C1_STATIC_HTML' END AS page_class, 'high' AS sure FROM c""")
def page_types_and_classes(spark, sf):
    st = p.page_structure(p.page_counts(elements(spark, sf)))
    n = F.col("page_id") % 3
    out = p.page_class(st, n == 0, F.when(n == 1, F.array(F.lit("https://x/API/now/list"))).otherwise(F.array(F.lit("https://x/y"))))
    return out.select("page_id", "page_type", "page_class", F.when(F.col("confidence") >= 0.9, "high").otherwise("low").alias("sure"))


@check(f"""WITH {BUILT} SELECT page_id, 0 AS table_no, cast(n + 1 AS integer) AS row_no, 'Program|Fee Schedule|Effective Date|Download PDF' AS columns, p_type AS program, title, day, shown, {URL} AS link FROM t""")
def html_table_rows(spark, sf):
    t = p.html_tables(elements(spark, sf))
    get = lambda k: F.element_at("cells", F.lit(k))
    return t.select(
        "page_id", "table_no", "row_no", F.array_join("columns", "|").alias("columns"), get("Program").alias("program"), get("Fee Schedule").alias("title"),
        get("Effective Date").alias("day"), get("Download PDF").alias("shown"), F.col("links")[0]["url"].alias("link"),
    )


@check(f"""WITH {BUILT} SELECT page_id, '{HOME}' || page_id || '/files/' || k || '.pdf' AS file_url, CASE WHEN shown = '' THEN k || '.pdf' ELSE 'PDF' END AS title, 'Current  Fee Schedules' AS section, 'pdf' AS file_type, '' AS updated FROM t
UNION ALL SELECT page_id, 'https://portal.example.com/rates/old/' || page_id || '.xlsx', 'Rate manual', 'Archive', 'xlsx', '01/02/23' FROM s""")
def file_link_catalog(spark, sf):
    out = p.file_link_catalog(elements(spark, sf, "heading", "anchor"))
    return out.select("page_id", "file_url", "title", "section", "file_type", F.when(F.col("file_type") == "xlsx", F.col("updated")).otherwise("").alias("updated"))


@check(f"""WITH {BUILT} SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY n) AS place, k || '.pdf' AS leaf FROM t QUALIFY place <= 5""")
def capped_file_link_catalog(spark, sf):
    out = p.file_link_catalog(elements(spark, sf, "heading", "anchor"), 5)
    from pyspark.sql import Window

    place = F.row_number().over(Window.partitionBy("page_id").orderBy("pos"))
    out = out.withColumn("place", place.cast("bigint"))
    return out.where("file_type = 'pdf'").select("page_id", "place", F.regexp_extract("file_url", "([^/]*)$", 1).alias("leaf"))


@check(f"""WITH {BUILT} SELECT c.page_id, section_no, title, text_start, has_table, cast(files AS bigint) AS file_count FROM c, LATERAL (
 SELECT 1 AS section_no, 'Current  Fee Schedules' AS title, 'All rates. User information' AS text_start, true AS has_table, n AS files UNION ALL
 SELECT 2, 'Again', 'User information Login Prog', true, n UNION ALL SELECT 3, 'Archive', 'Old ones, file updated 01/0', false, 2) z""")
def page_sections(spark, sf):
    out = p.page_sections(elements(spark, sf))
    return out.select("page_id", F.col("section_no").cast("int").alias("section_no"), "title", F.substring("text_sample", 1, 27).alias("text_start"), "has_table", F.col("file_count").cast("bigint").alias("file_count"))


@check(f"""WITH {BUILT} SELECT page_id, 'table_0' AS block_id, 'Current  Fee Schedules' AS heading_hint, n + 3 AS row_count, cast(n + 2 AS integer) AS samples, cast(n AS integer) AS link_samples, n > 0 AS has_file_links FROM c""")
def table_blocks(spark, sf):
    b = p.table_blocks(elements(spark, sf))
    return b.select("page_id", "block_id", "heading_hint", "row_count", F.size("data_sample").alias("samples"), F.size("link_samples").alias("link_samples"), "has_file_links")


@check(f"""WITH {BUILT} SELECT page_id, 'table_0' AS block_id, cast(1 AS integer) AS block_rank, cast(n * 61 AS integer) AS score FROM c""")
def ranked_blocks(spark, sf):
    return p.rank_blocks(p.table_blocks(elements(spark, sf)), 3).select("page_id", "block_id", "block_rank", "score")


@check(f"""WITH {BUILT} SELECT page_id, 'static_catalog' AS page_type, cast(CASE WHEN n > 0 THEN 95 ELSE 85 END AS integer) AS points, 'table_0' AS block_id, CASE WHEN n > 0 THEN 'one fee schedule' ELSE 'one record' END AS row_represents FROM c""")
def page_summaries(spark, sf):
    e = elements(spark, sf)
    st = p.page_class(p.page_structure(p.page_counts(e)))
    out = p.page_summary(st, p.table_blocks(e), p.page_sections(e))
    return out.select("page_id", "page_type", F.round(F.col("confidence") * 100).cast("int").alias("points"), "block_id", "row_represents")


@check("""SELECT c_nationkey AS page_id, c_custkey AS table_no FROM customer QUALIFY row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey % 50 DESC, c_custkey % 2 DESC, c_custkey) = 1""")
def primary_tables(spark, sf):
    k = F.col("c_custkey")
    b = read(spark, sf, "customer").select(F.col("c_nationkey").alias("page_id"), k.alias("table_no"), (k % 50).alias("row_count"), (k % 2 == 1).alias("has_file_links"), F.array(F.lit("a")).alias("columns"))
    return p.primary_table(b).select("page_id", "table_no")


@check("""SELECT c_custkey AS id, c_custkey % 50 AS n_rows, c_custkey % 7 AS linked_rows, c_custkey % 3 = 0 AS failed FROM customer""")
def table_order(spark, sf):
    k = F.col("c_custkey")
    t = read(spark, sf, "customer").select(k.alias("id"), (k % 50).alias("n_rows"), (k % 7).alias("linked_rows"), F.when(k % 3 == 0, "bad").alias("error"), F.col("c_name").alias("block_id"))
    return p.order_tables(t).select("id", "n_rows", "linked_rows", F.col("error").isNotNull().alias("failed"))


@check("SELECT cast(sum(CASE WHEN c_custkey % 3 = 0 THEN c_custkey % 50 ELSE 7 END) AS bigint) AS total_rows FROM customer")
def declared_total_rows(spark, sf):
    k = F.col("c_custkey")
    t = read(spark, sf, "customer").select(F.when(k % 3 == 0, k % 50).when(k % 3 == 1, -1).alias("row_count"), F.lit(7).alias("n_rows"))
    return p.total_rows(t)


@check(f"""WITH {BUILT} SELECT page_id, k, true AS is_file FROM t UNION ALL SELECT page_id, k, true FROM t UNION ALL SELECT page_id, -1, false FROM s UNION ALL SELECT page_id, -1, false FROM s UNION ALL SELECT page_id, -2, true FROM s UNION ALL SELECT page_id, -3, true FROM s""")
def file_link_flags(spark, sf):
    e = p.file_links(elements(spark, sf, "anchor", "cell"))
    k = F.regexp_extract("href", r"files/(\d+)\.pdf", 1)
    key = F.when(k != "", k.try_cast("bigint")).when(F.col("href").contains("xlsx"), -2).when(F.col("href") == "/f.pdf", -3).otherwise(-1)
    return e.select("page_id", key.alias("k"), F.col("is_file_link").alias("is_file"))


@check(f"""WITH {BUILT}, l AS (SELECT page_id, {URL} AS u, 12 + 5 AS score FROM t UNION ALL SELECT page_id, 'https://portal.example.com/rates/old/' || page_id || '.xlsx', 9 + 12 + 5 FROM s
 UNION ALL SELECT page_id, 'https://portal.example.com/f.pdf', 12 FROM s UNION ALL SELECT page_id, '{HOME}' || page_id || '/' || (page_id + 1) || '/index.html#top', 5 FROM s)
SELECT page_id, u AS link_url, score, row_number() OVER (PARTITION BY page_id ORDER BY score DESC, u) AS link_rank FROM l QUALIFY link_rank <= 10""")
def related_links(spark, sf):
    out = links.rank_related_links(elements(spark, sf, "anchor"), 10)
    return out.select("page_id", "link_url", "score", F.col("link_rank").cast("bigint").alias("link_rank"))


def supplier_edges(spark, sf):
    """Edges between supplier pages by arithmetic, with many more edges on the first page."""
    k = F.col("s_suppkey")
    n = read(spark, sf, "supplier").agg(F.max("s_suppkey")).scalar()
    s = read(spark, sf, "supplier").select(F.explode(F.array(F.struct(k.alias("a"), ((k * 3 + 1) % (n + 1)).alias("b")), F.struct(k.alias("a"), ((k * 7 + 2) % (n + 1)).alias("b")))).alias("e"))
    u = lambda c: F.concat(F.lit("u"), c.cast("string"))
    return s.select(u(F.col("e.a")).alias("src"), u(F.col("e.b")).alias("dst"), F.lit(0).alias("pos"))


@check("""WITH RECURSIVE n AS (SELECT max(s_suppkey) + 1 AS n FROM supplier), e AS (SELECT s_suppkey AS a, (s_suppkey * 3 + 1) % n AS b FROM supplier, n UNION SELECT s_suppkey, (s_suppkey * 7 + 2) % n FROM supplier, n),
r(x, d) AS (SELECT cast(5 AS bigint), 0 UNION SELECT b, d + 1 FROM r JOIN e ON a = x WHERE d < 3) SELECT 'u' || x AS url, min(d) AS depth FROM r GROUP BY x""")
def expanded_frontier(spark, sf):
    seed = read(spark, sf, "supplier").where("s_suppkey = 5").select(F.concat(F.lit("u"), F.col("s_suppkey").cast("string"), F.lit("#top")).alias("url"))
    return frontier.expand_frontier(supplier_edges(spark, sf), seed, depth=4)


@check(f"""WITH {BUILT} SELECT '{HOME}' || page_id || '/index.html' AS src, '{HOME}' || page_id || '/' || (page_id + 1) || '/index.html' AS dst FROM s""")
def page_link_edges(spark, sf):
    return frontier.page_edges(elements(spark, sf), path_must_contain="/Rates/").select("src", "dst")
