"""URL and file name queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import check, read
from ratetally.functions import urls
from ratetally.sources import files

NORMAL = r"""regexp_extract(lower(url), '^https?://[^/?#]+') || regexp_replace(regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1), '/+$', '') ||
 CASE WHEN url LIKE '%?%' THEN '?' || array_to_string(list_sort(string_split(regexp_extract(url, '\?([^#]*)', 1), '&')), '&') ELSE '' END"""


@check(f"SELECT page_id, {NORMAL} AS u FROM pages")
def normalized_urls(spark, sf):
    p = read(spark, sf, "pages")
    q = F.col("url")
    n = F.col("page_id") % 3
    upper = F.concat(F.upper(F.regexp_extract(q, "^(https?://[^/?#]+)", 1)), F.regexp_replace(q, "^https?://[^/?#]+", ""))
    noisy = F.when(n == 0, upper).when((n == 1) & ~q.contains("#"), F.concat(F.lit(" "), q, F.lit("#frag "))).otherwise(q)
    return p.select("page_id", urls.normalize_url(noisy).alias("u"))


@check(f"""WITH a AS (SELECT page_id, url, unnest(regexp_extract_all(html, '<a href="([^"]*)"', 1)) AS href FROM pages)
SELECT page_id, regexp_extract(url, '^https?://[^/?#]+') || href AS root, regexp_extract(url, '^https?://[^/?#]+') || '/x' || href AS up,
 regexp_extract(url, '^https?:') || '//cdn.example.com' || href AS other, '' AS script FROM a""")
def resolved_links(spark, sf):
    p = read(spark, sf, "pages")
    a = p.select("page_id", "url", F.explode(F.regexp_extract_all("html", F.lit('<a href="([^"]*)"'), 1)).alias("href"))
    base = F.concat(F.regexp_extract("url", "^(https?://[^/?#]+)", 1), F.lit("/x/y/z/page.html?q=1"))
    return a.select(
        "page_id", urls.join_url(F.col("url"), F.col("href")).alias("root"), urls.join_url(base, F.concat(F.lit("./../.."), F.col("href"))).alias("up"),
        urls.join_url(F.col("url"), F.concat(F.lit("//cdn.example.com"), F.col("href"))).alias("other"),
        urls.absolute_url(F.col("url"), F.concat(F.lit("javascript:__doPostBack"), F.col("href"))).alias("script"),
    )


ENDS = [".pdf", ".XLSX?v=1", ".xls", ".csv#x", ".zip", ".aspx", "/pubatt/dl/", "?format=pdf", "/getfile", ".docx"]


def part_urls(spark, sf):
    k = F.col("p_partkey")
    end = F.element_at(F.array(*[F.lit(e) for e in ENDS]), (k % 10 + 1).cast("int"))
    return read(spark, sf, "part").select("p_partkey", "p_type", "p_name", "p_brand", F.concat(F.lit("https://h.example.com/d/"), k.cast("string"), end).alias("u"))


@check("""SELECT p_partkey, p_partkey % 10 <> 5 AS is_file, ['pdf','xlsx','xls','csv','zip','http','http','http','http','http'][cast(p_partkey % 10 + 1 AS integer)] AS kind,
 ['pdf','xlsx','xls','csv','zip','unknown','unknown','unknown','unknown','unknown'][cast(p_partkey % 10 + 1 AS integer)] AS name FROM part""")
def file_urls_and_kinds(spark, sf):
    u = F.col("u")
    return part_urls(spark, sf).select("p_partkey", urls.is_file_url(u).alias("is_file"), urls.link_kind(u).alias("kind"), urls.kind_name(u).alias("name"))


@check("""SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'xls,xlsx,csv,any_http' WHEN 1 THEN 'pdf' WHEN 2 THEN 'any_http' ELSE '' END AS kinds,
 CASE p_partkey % 4 WHEN 0 THEN (p_partkey % 10) <> 99 WHEN 1 THEN p_partkey % 10 = 0 WHEN 2 THEN true ELSE false END AS fits FROM part""")
def expected_link_kinds(spark, sf):
    n = F.col("p_partkey") % 4
    h = F.when(n == 0, "Excel Download").when(n == 1, "PDF").when(n == 2, "Link").otherwise("Rate")
    k = urls.expected_kinds(h)
    return part_urls(spark, sf).select("p_partkey", F.array_join(k, ",").alias("kinds"), urls.kind_fits(urls.link_kind(F.col("u")), k).alias("fits"))


@check("""SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN p_partkey || '_x.pdf' ELSE 'download' END AS leaf, CASE WHEN p_partkey % 2 = 0 THEN p_partkey || '_x' ELSE 'download' END AS stem,
 CASE WHEN p_partkey % 2 = 0 THEN '.pdf' ELSE '.xlsx' END AS ext, p_partkey % 5 = 0 AS opaque,
 lower(p_brand) || '/' || lower(replace(p_name, ' ', '_')) || '/2024-01-01__' || substr(sha256(cast(p_partkey AS varchar)), 1, 16) || '_f.pdf' AS stored FROM (SELECT * REPLACE (replace(p_brand, '#', '#') AS p_brand) FROM part)""")
def file_names(spark, sf):
    k = F.col("p_partkey")
    u = F.when(k % 2 == 0, F.concat(F.lit("https://h/a%20b/"), k.cast("string"), F.lit("%20x.pdf?z=1"))).otherwise("https://h.example.com")
    name = F.when(k % 5 == 0, F.substring(F.sha2(k.cast("string"), 256), 1, 30)).otherwise(F.concat(F.lit("rates-"), k.cast("string")))
    leaf = urls.leaf_name(u)
    return read(spark, sf, "part").select(
        "p_partkey", leaf.alias("leaf"), urls.stem(leaf).alias("stem"), urls.guess_extension(u, F.lit("application/vnd.ms-excel; x")).alias("ext"), urls.is_opaque_name(name).alias("opaque"),
        urls.stored_path(F.col("p_brand"), F.col("p_name"), F.lit("2024-01-01"), F.sha2(k.cast("string"), 256), F.lit("f.pdf")).alias("stored"),
    )


@check("""SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'A_b c.pdf' WHEN 1 THEN 'rates ' || p_partkey || '.pdf' ELSE 'fee_schedule_' || p_partkey || '.pdf' END AS name,
 CASE p_partkey % 3 WHEN 0 THEN 'sec_1' WHEN 1 THEN lower(replace(p_name, ' ', '_')) ELSE 'order_' || p_partkey END AS k FROM part WHERE p_partkey > 0""")
def download_names_and_keys(spark, sf):
    k = F.col("p_partkey")
    n = k % 3
    label = F.when(n == 0, "x/A:b  c.pdf").when(n == 1, "Download").otherwise("")
    fname = F.when(n == 1, F.concat(F.lit("rates "), k.cast("string"), F.lit(".x"))).when(n == 2, F.concat(F.md5(k.cast("string")), F.lit(".pdf"))).otherwise("z")
    key = urls.candidate_key(F.when(n == 0, "sec_1").otherwise(""), F.col("p_name"), F.when(n == 1, " Click here").otherwise(F.concat(F.lit("Order "), k.cast("string"))))
    return read(spark, sf, "part").where("p_partkey > 0").select("p_partkey", urls.download_name(label, fname, k, F.lit(".pdf")).alias("name"), key.alias("k"))


@check("""SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'pdf' WHEN 1 THEN 'html_masquerade' WHEN 2 THEN 'xlsx' WHEN 3 THEN 'delimited' ELSE 'text_lines' END AS kind,
 CASE doc_id % 5 WHEN 0 THEN '.pdf' WHEN 1 THEN '.html' WHEN 2 THEN '.xlsx' ELSE '' END AS suffix, octet_length(encode(CASE doc_id % 5 WHEN 0 THEN '%PDF' WHEN 1 THEN '<!DOCTYPE html>' WHEN 2 THEN 'PK' || chr(3) || chr(4) ELSE 'a' END || text)) AS bytes_size,
 sha256(CASE doc_id % 5 WHEN 0 THEN '%PDF' WHEN 1 THEN '<!DOCTYPE html>' WHEN 2 THEN 'PK' || chr(3) || chr(4) ELSE 'a' END || text) AS content_sha256 FROM documents""")
def fingerprinted_files(spark, sf):
    n = F.col("doc_id") % 5
    head = F.when(n == 0, "%PDF").when(n == 1, "<!DOCTYPE html>").when(n == 2, "PK\x03\x04").otherwise("a")
    name = F.when(n == 0, "x.bin").when(n == 1, "x.pdf").when(n == 2, "x").when(n == 3, "x.CSV").otherwise("notes.txt")
    d = read(spark, sf, "documents").select("doc_id", F.concat(head, F.col("text")).cast("binary").alias("content"), name.alias("original_filename"), F.lit("").alias("mime_type"))
    out = files.classify_file(files.fingerprint(d))
    return out.select("doc_id", "kind", F.col("sniffed_suffix").alias("suffix"), "bytes_size", "content_sha256")
