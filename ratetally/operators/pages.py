"""Structure of pages: sections, tables, signals and classes, all over element rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ratetally.functions import urls
from ratetally.functions.jsontext import distinct_map
from ratetally.functions.text import strip, text
from ratetally.operators.spread import attach, first_per_group, lookup_join, number_rows, running, top_per_group

PAGE = ["page_id"]
TABLE = ["page_id", "table_no"]
ROW = ["page_id", "table_no", "row_no"]

# What tells a link to a document from other links.
LINK_EXTENSIONS = r"\.(pdf|xlsx|xls|csv|zip|docx|doc)"
ANCHOR_WORDS = r"(?i)\b(pdf|xlsx|xls|csv|excel|spreadsheet)\b|\([^)]*(excel|pdf|xls|xlsx)[^)]*\)| -\s*(PDF|Excel)\s*$"
HREF_WORDS = (
    r"(?i)(download|getfile|viewfile|fileid|documentid|document|attachment|\.ashx|/file/|"
    r"mediahandler|blob\.|contentdisposition)"
)
ROW_WORDS = r"(?i)\b(pdf|xlsx|xls|excel|csv)\b"
NAV_WORDS = (
    r"(?i)\b(user information|login|logout|sign in|register|password|forgot|"
    r"menu|navigation|contact us|privacy policy|skip to content)\b"
)
HEADER_WORDS = (
    r"(?i)\b(fee|schedule|document|title|type|date|file|name|effective|code|description|"
    r"download|format|version|category|posted|updated)\b"
)
# Phrases of pages that refuse automated visitors.
HARD_WALL = [
    "access denied", "you don't have permission to access", "request id:", "errors.edgesuite.net", "akamai ghost",
    "akamaighost", "attention required! | cloudflare", "request blocked", "verify you are human", "bot detection",
    "automated access",
]
SOFT_WALL = ["just a moment...", "checking your browser", "enable javascript", "enable cookies"]
REAL_WORDS = [
    "fee schedule", "fee", "schedule", "reimbursement", "provider", "rate book", "rate manual", "medi-cal", "medicaid",
    "hcpcs", "cpt", "allowable",
]
# Parts of URLs that belong to data APIs.
API_SIGNS = ["/api/now/", "/servicenow", "/query", "/list", "/search", "/export", "/datatable"]


def any_of(c: Column, words) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | c.contains(w)
    return out


def carry_section(elements: DataFrame, tags=("h1", "h2", "h3", "h4"), name: str = "section", column: str = "tight") -> DataFrame:
    """Every element with the text of the latest non-empty heading before it on its page."""
    heading = F.when(F.col("kind").isin("heading", "hint") & F.col("tag").isin(*tags) & (F.col(column) != ""), F.col(column))
    return running(elements, PAGE, "pos", name, heading, "last", before=True).withColumn(name, F.coalesce(name, F.lit("")))


def file_link_catalog(elements: DataFrame, max_rows: int | None = None) -> DataFrame:
    """Links to files on the host of their page, outside the footer, once per page, with the heading above them."""
    href = strip(F.col("href"))
    a = carry_section(elements.where("kind IN ('heading', 'anchor')"))
    a = a.where((F.col("kind") == "anchor") & ~F.col("in_footer") & (href != "") & ~href.startswith("#") & ~F.lower(href).startswith("javascript:"))
    a = a.withColumn("file_url", urls.join_url(F.col("url"), href))
    a = a.where((urls.host(F.col("file_url")) == urls.host(F.col("url"))) & urls.has_file_extension(F.col("file_url"), urls.CATALOG_EXTENSIONS))
    a = first_per_group(a, ["page_id", "file_url"], [F.col("pos")])
    if max_rows is not None:
        a = top_per_group(a, PAGE, [F.col("pos")], max_rows)
    leaf = F.regexp_extract(urls.path(F.col("file_url")), r"([^/]*)$", 1)
    title = F.coalesce(F.nullif(F.col("text"), F.lit("")), F.nullif(leaf, F.lit("")), F.col("file_url"))
    return a.select("page_id", "pos", "section", title.alias("title"), "file_url", urls.kind_name(F.col("file_url")).alias("file_type"), "updated")


def file_links(elements: DataFrame) -> DataFrame:
    """Anchors with ``is_file_link``: by extension, link text, URL shape or a file word in their table row."""
    href = strip(F.col("href"))
    in_row = elements.where("kind = 'cell'").groupBy(*ROW).agg(F.max(F.col("text").rlike(ROW_WORDS)).alias("_row_file"))
    a = elements.where((F.col("kind") == "anchor") & F.col("href").isNotNull()).join(in_row, ROW, "left")
    plain = ~href.startswith("#") & ~F.lower(href).startswith("javascript:") & (href != "")
    looks = (
        F.lower(href).rlike(LINK_EXTENSIONS) | F.col("text").rlike(ANCHOR_WORDS) | href.rlike(HREF_WORDS)
        | F.coalesce(F.col("_row_file"), F.lit(False))
    )
    return a.withColumn("is_file_link", plain & looks).drop("_row_file")


def first_row_fingerprints(elements: DataFrame) -> DataFrame:
    """Per table the texts of its first row: ten cells, fifty characters each."""
    first = elements.where("kind = 'cell' AND row_no = 0 AND col_no < 10")
    cells = F.array_sort(F.collect_list(F.struct("col_no", F.substring("tight", 1, 50).alias("t"))))
    return first.groupBy(*TABLE).agg(F.array_join(F.transform(cells, lambda c: c["t"]), "|").alias("fingerprint"))


def table_fingerprints(elements: DataFrame) -> DataFrame:
    """Per table a 128-bit hash of its rows, cells and links; rows are hashed first, so no task holds a table."""
    cell = F.struct("pos", "kind", "row_no", "col_no", "tight", "href")
    own = elements.where("kind IN ('cell', 'anchor') AND table_no IS NOT NULL")
    rows = own.groupBy(*TABLE, "row_no").agg(F.array_sort(F.collect_list(cell)).alias("_cells"))
    rows = rows.withColumn("_cells", F.to_json(F.transform("_cells", lambda c: F.struct(c["kind"], c["col_no"], c["tight"], c["href"]))))
    rows = rows.select(*TABLE, F.struct("row_no", F.md5("_cells").alias("h")).alias("_row"))
    return rows.groupBy(*TABLE).agg(F.md5(F.to_json(F.array_sort(F.collect_list("_row")))).alias("fingerprint"))


def unique_tables(elements: DataFrame, by_first_row: bool = False) -> DataFrame:
    """(page_id, table_no, table_index): tables of a page whose content has not been seen before on it.

    ``by_first_row`` takes tables for equal when the beginnings of their first rows are.
    """
    t = elements.where("kind = 'table'").select(*TABLE)
    prints = first_row_fingerprints(elements) if by_first_row else table_fingerprints(elements)
    t = t.join(prints, TABLE, "left").withColumn("fingerprint", F.coalesce("fingerprint", F.lit("")))
    named = first_per_group(t.where("fingerprint <> ''"), ["page_id", "fingerprint"], [F.col("table_no")])
    kept = named.unionByName(t.where("fingerprint = ''"))
    w = Window.partitionBy("page_id").orderBy("table_no")
    return kept.select(*TABLE, (F.row_number().over(w) - 1).alias("table_index"))


def page_counts(elements: DataFrame) -> DataFrame:
    """Counters per page: tables, table rows, links, buttons, inputs, selects, lists, file links and their types."""
    kept = unique_tables(elements).select(*TABLE, F.lit(True).alias("_kept"))
    tag = lambda *t: F.count_if(F.col("tag").isin(*t))
    per_page = elements.groupBy(*PAGE).agg(
        tag("a").alias("links"), tag("button").alias("buttons"), tag("select").alias("selects"), tag("input").alias("inputs"),
        tag("ul", "ol").alias("lists"), tag("form").alias("forms"), tag("main", "article").alias("mains"), tag("tr").alias("all_rows"),
        F.count_if(((F.col("kind") == "anchor") & F.col("href").isNotNull() & (F.col("n_texts") == 1) & F.lower("text").contains("next"))
                   | ((F.col("kind") == "text") & F.col("text").rlike(r"(?i)\bnext\b"))).alias("next_marks"),
    )
    rows = elements.where("kind = 'row'").groupBy(*TABLE).agg(F.count(F.lit(1)).alias("n"))
    tables = kept.join(rows, TABLE, "left").groupBy(*PAGE).agg(F.count(F.lit(1)).alias("tables"), F.coalesce(F.sum("n"), F.lit(0)).alias("table_rows"))
    h = F.lower("href")
    files = file_links(elements).where("is_file_link").groupBy("page_id", "href").agg(F.lit(1).alias("_one"))
    files = files.groupBy(*PAGE).agg(
        F.count(F.lit(1)).alias("file_links"),
        F.max(h.contains(".pdf")).alias("_pdf"), F.max(h.contains(".xls")).alias("_xls"), F.max(h.contains(".csv")).alias("_csv"),
    )
    types = F.array_compact(F.array(F.when(F.col("_csv"), "csv"), F.when(F.col("_pdf"), "pdf"), F.when(F.col("_xls"), "xlsx")))
    out = per_page.join(tables, PAGE, "left").join(files, PAGE, "left")
    return out.select(
        *per_page.columns,
        *[F.coalesce(c, F.lit(0)).alias(c) for c in ("tables", "table_rows", "file_links")],
        F.array_join(types, ",").alias("file_types"),
    )


def page_structure(counts: DataFrame) -> DataFrame:
    """Signals, page type and confidence from page counters."""
    t, f = F.col("tables") > 0, F.col("file_links") > 0
    b, n = (F.col("links") > 0) | (F.col("buttons") > 0), F.col("next_marks") > 0
    return counts.withColumns({
        "has_table": t, "has_file_links": f, "has_buttons": b, "has_pagination": n,
        "has_dropdowns": F.col("selects") > 0, "has_search": F.col("inputs") > 0, "has_list": F.col("lists") > 0,
        "page_type": F.when(t & b & n, "dynamic_application_rendered").when(t, "static_html").when(f, "file_repository").otherwise("unstructured_page"),
        "confidence": F.when(t, 0.9).when(f, 0.85).otherwise(0.5),
        "primary_source": F.when(t & b & n, "api").when(t, "mixed").when(f, "files").otherwise("unknown"),
        "api_detected": t & b & n,
    })


def page_class(signals: DataFrame, blocked: Column | None = None, endpoints: Column | None = None) -> DataFrame:
    """Class of a page. ``blocked`` and ``endpoints`` (array of called URLs) come from the caller when known."""
    blocked = F.lit(False) if blocked is None else F.coalesce(blocked, F.lit(False))
    endpoints = F.array().cast("array<string>") if endpoints is None else endpoints
    data_api = F.exists(endpoints, lambda e: any_of(F.lower(e), API_SIGNS))
    c = (
        F.when(blocked, "C4_BLOCKED")
        .when(F.col("api_detected") & F.coalesce(data_api, F.lit(False)), "C3_SPA_APP")
        .when(F.col("has_table") & F.col("has_file_links"), "C1_STATIC_HTML")
        .when(F.col("has_buttons") | F.col("has_dropdowns") | F.col("has_pagination"), "C2_INTERACTIVE_HTML")
        .otherwise("C5_NOT_DATA_PAGE")
    )
    return signals.withColumn("page_class", c)


def page_gate(pages: DataFrame, elements: DataFrame) -> DataFrame:
    """Is a page a wall for automated visitors, and is it a real page?"""
    rows = elements.where("kind = 'row' AND table_no IS NOT NULL").groupBy(*TABLE).agg(F.count(F.lit(1)).alias("n"))
    big = rows.where("table_no < 5 AND n >= 3").select("page_id").distinct().withColumn("_big", F.lit(True))
    e = elements.groupBy(*PAGE).agg(
        F.count_if((F.col("kind") == "anchor") & F.lower("href").rlike(LINK_EXTENSIONS)).alias("_files"),
        F.count_if(F.col("kind") == "table").alias("_tables"), F.count_if(F.col("kind") == "row").alias("_rows"),
        F.count_if(F.col("tag").isin("main", "article")).alias("_mains"),
        F.count_if(F.col("tag").isin("select", "form")).alias("_forms"),
        F.count_if(F.col("tag").isin("select", "button", "input")).alias("_ui"),
        F.count_if((F.col("kind") == "text") & any_of(F.lower("text"), REAL_WORDS)).alias("_words"),
    )
    j = pages.join(e, PAGE, "left").join(big, PAGE, "left").fillna(0, ["_files", "_tables", "_rows", "_mains", "_forms", "_ui", "_words"])
    low = F.lower(text(F.col("html")))
    data = (F.col("_files") > 0) | F.coalesce(F.col("_big"), F.lit(False))
    shell = (
        data | (F.length(text(F.col("html"))) >= 28000) | ((F.col("_tables") > 0) & (F.col("_rows") >= 4))
        | ((F.col("_mains") > 0) & ((F.col("_tables") > 0) | (F.col("_forms") > 0)))
    )
    wall = (F.length(text(F.col("html"))) < 400) | any_of(low, HARD_WALL) | (any_of(low, SOFT_WALL) & ~shell)
    return j.select(*pages.columns, wall.alias("is_wall"), (~wall & ((F.col("_ui") > 0) | (F.col("_words") > 0) | data)).alias("is_real"))


def clean_labels(labels: Column) -> Column:
    """Header labels without blanks, list marks and result counters."""
    marked = F.transform(labels, lambda t: F.when(strip(t).startswith("»"), strip(F.regexp_replace(strip(t), "^»+", ""))).otherwise(strip(t)))
    keep = lambda t: ~(F.lower(t).contains("rows returned") & F.lower(t).contains("fee schedule"))
    blank_gone = F.filter(F.arrays_zip(labels.alias("l"), marked.alias("m")), lambda z: (strip(z["l"]) != "") & keep(z["m"]))
    return F.transform(blank_gone, lambda z: z["m"])


def table_rows(elements: DataFrame) -> DataFrame:
    """One row per table row with its cells in order. A row of a document is as wide as it is written."""
    c = elements.where("kind = 'cell'").groupBy("url", *ROW).agg(
        F.array_sort(F.collect_list(F.struct("col_no", "text", "tight", (F.col("tag") == "th").alias("th"), "in_thead"))).alias("cells")
    )
    return c


def table_headers(rows: DataFrame, scan_rows: int | None = None) -> DataFrame:
    """Columns of each table and the row they were found in (-1 for a head section).

    A head section decides; otherwise the best scoring row, the earlier one in a tie. ``scan_rows`` looks at the
    first rows only.
    """
    is_head = lambda c: c["th"] & c["in_thead"]
    texts = F.transform("cells", lambda c: c["tight"])
    near = rows if scan_rows is None else rows.where((F.col("row_no") <= scan_rows) | F.exists("cells", is_head))
    near = near.withColumn("filled", F.filter(texts, lambda t: t != "")).withColumn("columns", clean_labels(texts))
    nxt = F.lead(F.size("filled")).over(Window.partitionBy(*TABLE).orderBy("row_no"))
    near = near.withColumn("_next", F.coalesce(nxt, F.lit(-1)))
    n = F.size("columns")
    joined = F.array_join("filled", " ")
    nav = joined.rlike(NAV_WORDS) | ((F.size("filled") == 2) & F.exists("filled", lambda t: F.lower(t).contains("login")))
    score = (
        n * 4 - F.greatest(n - 24, F.lit(0)) * 25
        + F.when(F.array_join("columns", " ").rlike(HEADER_WORDS), 18).otherwise(0)
        + F.size(F.filter("cells", lambda c: c["th"])) * 2
        + F.size(F.filter("filled", lambda t: F.length(t) <= 45))
        - F.size(F.filter("filled", lambda t: F.length(t) > 90)) * 3
        + F.when(F.col("_next") >= F.greatest(F.lit(2), n - 1), 8).otherwise(0)
    )
    usable = F.lit(True) if scan_rows is None else F.col("row_no") < scan_rows
    usable = usable & (F.size("filled") >= 2) & ~nav & (n >= 2)
    # A very wide row scores low but may still be the only header of its table.
    score = F.when(n > 24, F.greatest(score, F.lit(0))).otherwise(score)
    near = near.withColumn("score", F.when(usable, score))
    head_cells = F.transform(F.filter("cells", is_head), lambda c: c["tight"])
    found = near.groupBy(*TABLE).agg(
        F.array_sort(F.collect_list(F.when(F.exists("cells", is_head), F.struct("row_no", head_cells.alias("t"))))).alias("h"),
        F.max(F.when(F.col("score") >= 0, F.struct("score", (-F.col("row_no")).alias("up"), "columns"))).alias("b"),
    ).withColumn("_head", clean_labels(F.flatten(F.transform("h", lambda r: r["t"]))))
    use_head = F.size("_head") > 0
    return found.where(use_head | F.col("b").isNotNull()).select(
        *TABLE, F.when(use_head, F.col("_head")).otherwise(F.col("b.columns")).alias("columns"), F.when(use_head, -1).otherwise(-F.col("b.up")).alias("header_row")
    )


def is_paging_row(links: Column, values: Column) -> Column:
    """Rows that only move between pages of a list."""
    u = lambda l: F.lower(l["url"])
    link_hit = F.coalesce(F.exists(links, lambda l: u(l).contains("__dopostback") & (u(l).contains("nextpage") | u(l).contains("pager"))), F.lit(False))
    joined = F.array_join(F.filter(F.transform(values, strip), lambda v: v != ""), " ")
    return link_hit | joined.rlike(r"(?i)\bnext\s*>\s*$") | joined.rlike(r"(?i)^\d(\s+\d)*\s+next\s*>?$")


def align_values(values: Column, width: Column) -> Column:
    """Values cut or padded to ``width``; surplus cells are first taken from the empty ones in front."""
    lead = F.coalesce(F.array_position(F.transform(values, lambda v: strip(v) != ""), F.lit(True)), F.lit(0))
    lead = F.when(lead == 0, F.size(values)).otherwise(lead - 1)
    drop = F.least(lead, F.greatest(F.size(values) - width, F.lit(0))).cast("int")
    kept = F.slice(values, drop + 1, F.greatest(width, F.lit(0)))
    return F.concat(kept, F.array_repeat(F.lit(""), F.greatest(width - F.size(kept), F.lit(0))))


def row_links(elements: DataFrame) -> DataFrame:
    """Links of each table row in order, URLs made absolute."""
    href = strip(F.col("href"))
    a = elements.where((F.col("kind") == "anchor") & F.col("row_no").isNotNull() & (href != "") & ~href.startswith("#"))
    link = F.struct("pos", urls.join_url(F.col("url"), href).alias("url"), F.col("text").alias("text"))
    return a.groupBy(*ROW).agg(
        F.transform(
            F.array_sort(F.collect_list(link)),
            lambda l: F.struct(l["url"].alias("url"), l["text"].alias("text"), F.lit(False).alias("superseded"), F.lit("").alias("slot")),
        ).alias("links")
    )


EMPTY_LINKS = "array<struct<url:string,text:string,superseded:boolean,slot:string>>"


def html_tables(elements: DataFrame) -> DataFrame:
    """Catalog rows of all tables: page_id, url, table_no, row_no, columns, cells (MAP) and links.

    Repeated tables of a page are taken once; blank rows and paging rows are left out.
    """
    rows = table_rows(elements)
    rows = rows.join(unique_tables(elements).select(*TABLE), TABLE, "left_semi")
    heads = table_headers(rows)
    body = rows.join(heads, TABLE).where(
        F.when(F.col("header_row") < 0, ~F.exists("cells", lambda c: c["in_thead"])).otherwise(F.col("row_no") > F.col("header_row"))
    )
    body = body.withColumn("vals", F.transform("cells", lambda c: c["text"])).where(F.exists("vals", lambda v: v != ""))
    body = body.join(row_links(elements), ROW, "left").withColumn("links", F.coalesce("links", F.array().cast(EMPTY_LINKS)))
    body = body.where(~is_paging_row(F.col("links"), F.col("vals")))
    vals = align_values(F.col("vals"), F.size("columns"))
    entries = F.transform("columns", lambda c, i: F.struct(c.alias("key"), F.get(F.col("_v"), i).alias("value")))
    return body.withColumn("_v", vals).select("page_id", "url", "table_no", "row_no", "columns", distinct_map(entries).alias("cells"), "links")


def table_blocks(elements: DataFrame, samples: int | None = None, link_samples: int | None = None) -> DataFrame:
    """One row per unique table: heading above it, columns, row count, data rows and links, and what all its links score.

    ``samples`` and ``link_samples`` show the first data rows and links only.
    """
    hints = carry_section(
        elements.where("kind IN ('heading', 'hint', 'table') AND tag <> 'h5'"), ("h1", "h2", "h3", "h4", "strong", "legend"), "hint_text", "text"
    ).where("kind = 'table'").select(*TABLE, "hint_text")
    captions = elements.where("tag = 'caption'").groupBy(*TABLE).agg(F.min_by("text", "pos").alias("caption"))
    rows = table_rows(elements)
    n_rows = elements.where("kind = 'row'").groupBy(*TABLE).agg(F.count(F.lit(1)).alias("row_count"))
    td = F.transform(F.filter("cells", lambda c: ~c["th"]), lambda c: c["text"])
    data = rows.withColumn("td", td).where(F.exists("td", lambda t: t != ""))
    data = (data if samples is None else top_per_group(data, TABLE, [F.col("row_no")], samples)).groupBy(*TABLE).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("row_no", "td"))), lambda r: r["td"]).alias("data_sample")
    )
    links = elements.where("kind = 'anchor' AND href IS NOT NULL AND trim(href) <> '' AND table_no IS NOT NULL")
    points = links.groupBy(*TABLE).agg(F.sum(link_points(F.col("href"), F.col("text")) + 1).alias("link_score"))
    links = (links if link_samples is None else top_per_group(links, TABLE, [F.col("pos")], link_samples)).groupBy(*TABLE).agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("pos", "href", "text"))),
            lambda l: F.struct(l["href"].alias("href"), l["text"].alias("text")),
        ).alias("link_samples")
    )
    out = unique_tables(elements).join(table_headers(rows).drop("header_row"), TABLE, "left")
    for side in (n_rows, captions, hints, data, links, points):
        out = out.join(side, TABLE, "left")
    return out.select(
        "page_id", "table_no", F.concat(F.lit("table_"), F.col("table_index").cast("string")).alias("block_id"),
        F.coalesce("caption", "hint_text", F.lit("")).alias("heading_hint"),
        F.coalesce("columns", F.array().cast("array<string>")).alias("columns"),
        F.coalesce("row_count", F.lit(0)).alias("row_count"),
        F.coalesce("data_sample", F.array().cast("array<array<string>>")).alias("data_sample"),
        F.coalesce("link_samples", F.array().cast("array<struct<href:string,text:string>>")).alias("link_samples"),
        F.col("link_samples").isNotNull().alias("has_file_links"),
        F.coalesce("link_score", F.lit(0)).cast("long").alias("link_score"),
    )


def page_sections(elements: DataFrame, sample: int | None = None) -> DataFrame:
    """Sections between headings: title, text, tables, file links and their types.

    ``sample`` keeps that many characters of the text; only the pieces that hold them are gathered. Without it the
    text of a section is whole.

    A page without headings is one section named ``Entire Page``. Sections and places in them are counted in slices of
    the page, so a page of any length is spread over tasks; the elements are stored once.
    """
    e = elements.where(~((F.col("kind") == "heading") & (F.col("tag") == "h5")))
    opens = (F.col("kind") == "heading").cast("int")
    e = running(e, PAGE, "pos", "section_no", opens)
    # What stands in front of the first heading belongs to no section; pages without headings are one.
    headed = e.where("kind = 'heading'").select("page_id").distinct()
    e = e.where("section_no > 0").unionByName(attach(e.where("section_no = 0"), headed, PAGE, "anti"))
    titles = e.where("kind = 'heading'").select("page_id", "section_no", F.col("tight").alias("title"), F.col("pos").alias("_from"), F.col("n_texts").alias("_own"))
    section = ["page_id", "section_no"]
    body = number_rows(e.where("kind = 'text'").select(*section, "pos", "text"), section, "pos", "_rank")
    body = lookup_join(body, titles.select(*section, "_own"), section, "_hit").where(F.col("_rank") >= F.coalesce("_hit._own", F.lit(0)))
    if sample is not None:
        body = running(body, section, "pos", "_before", F.length("text") + 1, before=True).where(F.col("_before") < sample)
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda t: t["text"]), " ")
    texts = body.groupBy("page_id", "section_no").agg((whole if sample is None else F.substring(whole, 1, sample)).alias("text_sample"))
    links = file_links(e).where("is_file_link")
    low = F.lower("text")
    marks = links.groupBy("page_id", "section_no").agg(
        F.count(F.lit(1)).alias("file_count"),
        F.max(low.contains("csv")).alias("_csv"), F.max(low.contains("pdf")).alias("_pdf"), F.max(low.rlike("xls|excel")).alias("_xls"),
        F.max(~low.rlike("csv|pdf|xls|excel")).alias("_unk"),
    )
    tables = e.groupBy("page_id", "section_no").agg(F.max(F.col("kind") == "table").alias("has_table"))
    types = F.array_compact(F.array(F.when(F.col("_csv"), "csv"), F.when(F.col("_pdf"), "pdf"), F.when(F.col("_unk"), "unknown"), F.when(F.col("_xls"), "xlsx")))
    out = tables
    for side in (titles.drop("_from", "_own"), texts, marks):
        out = out.join(side, ["page_id", "section_no"], "left")
    return out.select(
        "page_id", "section_no", F.coalesce("title", F.lit("Entire Page")).alias("title"),
        F.coalesce("text_sample", F.lit("")).alias("text_sample"), "has_table",
        F.coalesce(F.col("file_count") > 0, F.lit(False)).alias("has_file_links"),
        F.array_join(types, ",").alias("file_types"), F.coalesce("file_count", F.lit(0)).alias("file_count"),
    )


def primary_table(blocks: DataFrame) -> DataFrame:
    """Main table of each page: most rows, then links, then most columns, then the first."""
    order = [F.col("row_count").desc(), F.col("has_file_links").desc(), F.size("columns").desc(), F.col("table_no")]
    return first_per_group(blocks, PAGE, order)


def page_summary(structure: DataFrame, blocks: DataFrame, sections: DataFrame, outside_confidence: Column | None = None) -> DataFrame:
    """Summary of each page with a confidence between 0.6 and 1."""
    main = primary_table(blocks).select("page_id", "block_id", "heading_hint", "columns", "row_count", F.col("has_file_links").alias("_files"))
    first = sections.where("section_no <= 2").groupBy("page_id").agg(
        F.max((F.col("text_sample") != "") & ~F.col("has_table")).alias("intro_present"), F.count(F.lit(1)).alias("_n")
    )
    j = structure.join(main, PAGE, "left").join(first, PAGE, "left")
    has = F.col("block_id").isNotNull()
    pts = (
        F.lit(60) + F.when(has, 20).otherwise(0) + F.when(has & F.col("_files"), 10).otherwise(0)
        + F.when(has & (F.size("columns") > 0), 5).otherwise(0)
        + F.when(F.coalesce(outside_confidence if outside_confidence is not None else F.lit(0.0), F.lit(0.0)) > 0.7, 5).otherwise(0)
    )
    cols = F.lower(F.array_join("columns", " "))
    about = F.when(has & F.col("_files") & cols.rlike("fee|schedule|rate"), "one fee schedule").when(has, "one record").otherwise("")
    kind = F.col("page_class")
    mapped = F.when(kind == "C1_STATIC_HTML", "static_catalog").when(kind == "C3_SPA_APP", "dynamic_application").when(kind == "C4_BLOCKED", "not_accessible").otherwise("unknown")
    return j.select(
        "page_id", mapped.alias("page_type"), (F.least(pts, F.lit(100)) / 100).alias("confidence"),
        F.coalesce(F.col("_n") > 0, F.lit(False)).alias("header_present"), F.coalesce("intro_present", F.lit(False)).alias("intro_present"),
        F.col("has_buttons").alias("navigation_present"), "block_id", F.coalesce("heading_hint", F.lit("")).alias("title"),
        F.coalesce("row_count", F.lit(0)).alias("row_count"), about.alias("row_represents"),
    )


def link_points(href: Column, label: Column) -> Column:
    """What a link says for its table (fixed values)."""
    h, t = F.lower(href), F.lower(label)
    return (
        F.when(h.contains("__dopostback") | h.startswith("javascript:"), 150).otherwise(0)
        + F.when(h.rlike(LINK_EXTENSIONS) | t.rlike(LINK_EXTENSIONS), 60).otherwise(0)
        + F.when(t.rlike("fee|schedule|cpt|hcpcs|reimburse"), 12).otherwise(0)
    )


def rank_blocks(blocks: DataFrame, k: int) -> DataFrame:
    """Top ``k`` tables of each page by all their links, then by rows."""
    return top_per_group(blocks.withColumn("score", F.col("link_score").cast("int")), PAGE, [F.col("score").desc(), F.col("row_count").desc(), F.col("table_no")], k, rank="block_rank")


def order_tables(tables: DataFrame) -> DataFrame:
    """Presentation order: most rows, most linked rows, without error, by id."""
    return tables.orderBy(F.col("n_rows").desc(), F.col("linked_rows").desc(), F.col("error").isNotNull(), F.coalesce("block_id", F.lit("")))


def total_rows(tables: DataFrame) -> DataFrame:
    """Sum of the declared row counts, the actual ones where none is declared."""
    declared = F.when(F.col("row_count") >= 0, F.col("row_count"))
    return tables.agg(F.coalesce(F.sum(F.coalesce(declared, F.col("n_rows"))), F.lit(0)).alias("total_rows"))
