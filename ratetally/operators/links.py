"""Catalog rows and their links: labels, candidates, ranking, hydration, outside decisions, row linkage."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ratetally.functions import dates, urls
from ratetally.functions.jsontext import distinct_map
from ratetally.functions.text import bind, norm_catalog_value, slug, strip, text
from ratetally.operators.contained import contained_or_containing
from ratetally.operators.spread import attach, cut_lineage, first_per_group, lookup_join, top_per_group

# Weights of phrases in a link that may lead to rates.
PHRASE_WEIGHTS = {
    "fee schedule": 10, "feeschedule": 10, "rate book": 9, "rate manual": 9, "provider manual": 8, "reimbursement": 8,
    "remittance": 6, "medi-cal": 7, "medicaid": 7, "cpt": 4, "hcpcs": 4, "allowable": 5, "vendor drug": 7, "pharmacy": 5,
    "physician": 4, "dental": 4, "behavioral health": 6, "bulletin": 3, "archive": 2,
}
PATH_WORDS = r"(?i)(fee|rate|reimburs|provider|manual|schedule|bulletin|policy|chapter)"
FILE_WORDS = r"\.(pdf|xlsx|xls|csv|zip)"
FILE_TYPE_WORDS = r"(?i)\b(pdf|xlsx?|docx?|csv|zip|txt|htm|html|xml|rtf)\b"
TITLE_NAMES = ["title", "document", "name", "publication"]


def _first(columns: Column, test) -> Column:
    return F.get(F.filter(columns, test), F.lit(0))


def column_role(columns: Column, role: str) -> Column:
    """Column of an ARRAY of names that plays a role: schedule, program, effective_date or sort."""
    low = lambda c: F.lower(c)
    if role == "schedule":
        return F.coalesce(
            _first(columns, lambda c: low(c).rlike(r"\bfee\s*schedule\b")),
            _first(columns, lambda c: low(c).rlike(r"\bschedule\b") & ~low(c).contains("program")),
            _first(columns, lambda c: low(c).rlike(r"\bschedule\b")),
            _first(columns, lambda c: low(c).rlike(r"\b(title|name|document|description)\b")),
            F.when((F.size(columns) >= 2) & low(F.get(columns, F.lit(0))).contains("program"), F.get(columns, F.lit(1))),
            F.get(columns, F.lit(0)),
        )
    if role == "program":
        fee = column_role(columns, "schedule")
        word = r"\b(program|service category|service line|category|department|division)\b"
        return _first(
            columns,
            lambda c: (c != fee) & (strip(c) != "") & ~c.startswith("_") & low(c).rlike(word) & ~(low(c).contains("fee") & low(c).contains("schedule")),
        )
    if role == "effective_date":
        from ratetally.functions.names import EFFECTIVE_DATE_NAMES

        norm = lambda c: F.regexp_replace(F.regexp_replace(F.lower(strip(c)), r"\s+", "_"), "[^a-z0-9_]", "")
        named = lambda wanted: _first(columns, lambda c: norm(c) == wanted)
        exact = [named(wanted) for wanted in EFFECTIVE_DATE_NAMES]
        return F.coalesce(
            *exact,
            _first(columns, lambda c: norm(c).contains("effective") & norm(c).contains("date")),
            _first(columns, lambda c: norm(c).endswith("date") & ~norm(c).rlike("term|end|expir")),
        )
    if role == "sort":
        return F.coalesce(
            _first(columns, lambda c: (low(c).rlike(r"\bprocedure\b") & low(c).rlike(r"\bcode\b")) | low(c).rlike(r"^(hcpcs|cpt)\b")),
            _first(columns, lambda c: F.trim(low(c)) == "code"),
            F.get(columns, F.lit(0)),
        )
    raise ValueError(f"Unknown role {role!r}")


def ordered_columns(rows: DataFrame, keys: Sequence[str], declared: str | None = None) -> DataFrame:
    """(keys, ord, name): declared column names first, then names first seen in the row cells.

    Names starting with ``_`` are metadata and hidden. The order of unseen names follows the first row
    (column ``row_no``) and place they occur at.
    """
    seen = rows.select(*keys, "row_no", F.posexplode(F.map_keys("cells")).alias("place", "name")).where(~F.col("name").startswith("_"))
    seen = seen.groupBy(*keys, "name").agg(F.min(F.struct(F.lit(1).alias("side"), F.col("row_no").cast("long").alias("row_no"), "place")).alias("at"))
    if declared:
        d = rows.select(*keys, F.posexplode(declared).alias("place", "name")).select(*keys, strip(F.col("name")).alias("name"), "place").where("name <> ''")
        d = d.groupBy(*keys, "name").agg(F.min(F.struct(F.lit(0).alias("side"), F.lit(-1).cast("long").alias("row_no"), "place")).alias("at"))
        seen = seen.unionByName(d).groupBy(*keys, "name").agg(F.min("at").alias("at"))
    return seen.withColumn("ord", F.row_number().over(Window.partitionBy(*keys).orderBy("at"))).select(*keys, "ord", "name")


def is_superseded(cells: Column, label: Column) -> Column:
    """``SUPERSEDED`` in the link text or in any visible cell."""
    shown = F.filter(F.map_entries(cells), lambda e: ~e["key"].startswith("_"))
    blob = F.concat_ws(" ", label, F.array_join(F.transform(shown, lambda e: text(e["value"])), " "))
    return F.upper(blob).contains("SUPERSEDED")


def row_title(cells: Column, schedule: Column) -> Column:
    """Section of a row if it has one, else its cell in the ``schedule`` column."""
    section = strip(F.element_at(cells, F.lit("_schedule_section")))
    return F.when(section != "", section).otherwise(strip(F.element_at(cells, schedule)))


def compose_label(cells: Column, schedule: Column, program: Column, portal_date: Column, fallback: Column) -> Column:
    """``Program — Schedule — Jan 5, 2026`` with whatever of the three is known; else a short link text.

    ``schedule`` and ``program`` name the columns of these roles, see ``column_role``.
    """
    fee_cell = strip(F.element_at(cells, schedule))
    fee = F.when(fee_cell != "", fee_cell).otherwise(row_title(cells, schedule))
    prog = strip(F.element_at(cells, program))
    fb = strip(fallback)
    fb_ok = (F.length(fb) <= 48) & ~fb.rlike("(?i)^https?://") & ~F.lower(fb).isin("download", "download file", "click here", "here")
    base = (
        F.when((prog != "") & (fee != "") & (F.lower(prog) != F.lower(fee)), F.concat(prog, F.lit(" — "), fee))
        .when(fee != "", fee)
        .when(prog != "", prog)
        .when((fb != "") & fb_ok, fb)
        .otherwise("")
    )
    suffix = F.when(strip(portal_date) != "", dates.date_heading(portal_date)).otherwise("")
    return bind(
        F.struct(base.alias("b"), suffix.alias("s")),
        lambda x: F.trim(
            F.when((x["s"] == "") | F.lower(x["b"]).contains(F.lower(x["s"])), x["b"])
            .when(x["b"] == "", x["s"])
            .otherwise(F.concat(x["b"], F.lit(" — "), x["s"]))
        ),
    )


def file_candidates(catalog: DataFrame, scope: Sequence[str], base: str = "url", dedupe_on: str = "raw") -> DataFrame:
    """Files to fetch, found in the links and URL cells of catalog rows.

    Within ``scope`` (one portal run) every URL is taken once, where it occurs first. Gives url, label,
    display label, schedule key, portal date and its source, superseded flag and slot.
    """
    place = [*scope, "table_no", "row_no"]
    c = catalog.select(*dict.fromkeys([*place, base, "columns", "cells", "links"]))
    item = lambda side, raw, lab, sup, slot: F.struct(
        F.lit(side).alias("side"), raw.alias("raw"), lab.alias("lab"), sup.alias("link_sup"), slot.alias("slot")
    )
    in_links = F.transform("links", lambda k: item(
        0, k["url"], text(k["text"]), F.coalesce(k["superseded"], F.lit(False)), text(k["slot"])
    ))
    shown = F.filter(F.map_entries("cells"), lambda e: ~e["key"].startswith("_") & strip(e["value"]).rlike("^https?://"))
    in_cells = F.transform(shown, lambda e: item(1, e["value"], F.lit(""), F.lit(False), F.lit("")))
    both = c.withColumn("_items", F.concat(in_links, in_cells)).drop("links")
    both = both.select("*", F.posexplode("_items").alias("at", "_item")).select("*", "_item.*").drop("_items", "_item")
    # The URL is long to compute and read by the test: both come out of one expression.
    target = bind(urls.absolute_url(F.col(base), F.col("raw")), lambda u: F.when(urls.is_file_url(u), u))
    both = both.withColumn("found_url", target).where(F.col("found_url").isNotNull())
    one = F.col("found_url") if dedupe_on == "raw" else urls.normalize_url(F.col("found_url"))
    order = [F.col(x) for x in ("table_no", "row_no", "side", "at") if x not in scope]
    kept = first_per_group(both.withColumn("_one", one), [*scope, "_one"], order)

    # Roles, dates and titles are used several times below, so each is a column of its own first.
    kept = kept.withColumns({
        "_lab": strip(F.col("lab")), "_fee": column_role(F.col("columns"), "schedule"), "_prog": column_role(F.col("columns"), "program"),
        "_row_date": F.coalesce(dates.row_portal_date(F.col("cells"), F.col("columns")), F.lit("")),
    })
    kept = kept.withColumns({
        "_title": F.coalesce(row_title(F.col("cells"), F.col("_fee")), F.lit("")), "_link_date": F.coalesce(dates.label_date(F.col("_lab")), F.lit("")),
    })
    day = F.when(F.col("_link_date") != "", F.col("_link_date")).otherwise(F.col("_row_date"))
    return kept.withColumn("_day", day).select(
        *scope,
        *[x for x in ("table_no", "row_no") if x not in scope],
        F.col("found_url").alias("file_url"),
        F.when(F.col("_lab") != "", F.col("_lab")).otherwise(F.col("_title")).alias("label"),
        compose_label(F.col("cells"), F.col("_fee"), F.col("_prog"), F.col("_day"), F.col("_lab")).alias("catalog_display_label"),
        urls.candidate_key(F.element_at("cells", F.lit("_fee_topic_slug")), F.col("_title"), F.col("_lab")).alias("logical_schedule_key"),
        F.col("_day").alias("portal_date"),
        F.when(F.col("_link_date") != "", "link_text").when(F.col("_row_date") != "", "row_cell").otherwise("").alias("effective_date_source"),
        (is_superseded(F.col("cells"), F.col("_lab")) | F.col("link_sup")).alias("superseded_hint"),
        F.col("slot").alias("artifact_slot"),
    )


def is_published_row(cells: Column, links: Column) -> Column:
    """Rows that announce a file: a dated document row, or a title with a file type or a telling phrase."""
    names = F.lower(F.array_join(F.filter(F.map_keys(cells), lambda k: ~k.startswith("_")), " "))
    get = lambda *ks: F.coalesce(*[F.nullif(strip(F.element_at(cells, F.lit(k))), F.lit("")) for k in ks], F.lit(""))
    title = get("Title", "title")
    low = F.lower(title)
    paging = low.startswith("< previous") | low.contains("previous 1") | title.rlike(r"^\s*\d+\s*$")
    kind = F.upper(get("File Type", "file type")).rlike("PDF|XLS|CSV|ZIP|EXCEL|WORD|DOC")
    phrase = low.rlike("fee schedule|crosswalk|allowable|zipped fee|base unit|drug list")
    return (names.contains("effective date") & (F.size(links) > 0)) | ((title != "") & ~paging & (kind | phrase))


def is_publication_entry(cells: Column) -> Column:
    """Rows of a publication list that name a file type, in any cell, in their type column or as a title suffix."""
    values = F.array_join(F.transform(F.map_values(cells), lambda v: norm_catalog_value(v, unicode_forms=False)), " ")
    lower_keys = F.map_from_entries(F.array_distinct(F.transform(F.map_entries(cells), lambda e: F.struct(e["key"], e["value"]))))
    pick = lambda names: F.get(
        F.filter(F.map_entries(lower_keys), lambda e: F.lower(strip(e["key"])).isin(*names) & (strip(e["value"]) != "")), F.lit(0)
    )["value"]
    title = text(pick(TITLE_NAMES))
    return values.rlike(FILE_TYPE_WORDS) | F.lower(title).rlike(r"\.(pdf|xlsx|xls|csv|docx|doc|zip)$")


def link_availability(catalog: DataFrame, scope: Sequence[str], base: str = "url") -> DataFrame:
    """Per portal run: rows that look like files, those with a file URL, those with script links only, and a message."""
    u = lambda l: urls.absolute_url(F.col(base), l["url"])
    http = F.exists("links", lambda l: urls.is_file_url(u(l)))
    script = F.exists("links", lambda l: F.lower(l["url"]).rlike("javascript:|__dopostback"))
    like = (F.size("links") > 0) & is_published_row(F.col("cells"), F.col("links"))
    out = catalog.groupBy(*scope).agg(
        F.count_if(like).alias("catalog_file_like_rows"),
        F.count_if(like & http).alias("rows_with_http_download_urls"),
        F.count_if(like & ~http & script).alias("rows_with_postback_only_links"),
    )
    only = F.col("rows_with_postback_only_links")
    message = F.when(
        (F.col("catalog_file_like_rows") > 0) & (only > 0) & (F.col("rows_with_http_download_urls") == 0),
        F.concat(only.cast("string"), F.lit(" file row(s) use script postbacks instead of direct file links.")),
    ).when(F.col("catalog_file_like_rows") == 0, "No catalog rows with recognizable file links were found.")
    return out.withColumn("user_message", message)


def _rank_key(l, i):
    t, p = F.lower(text(l["text"])), F.regexp_extract(F.lower(text(l["url"])), r"^([^?]*)", 1)
    sup = (F.coalesce(l["superseded"], F.lit(False)) | F.upper(text(l["text"])).contains("SUPERSEDED")).cast("int")
    order = (
        F.when(t.contains("administrative director") | t.rlike(r"\borders of\b"), 3)
        .when(t.rlike(r"\border\b") & ~F.substring(t, 1, 20).contains("regulation"), 2)
        .when(t.contains("order"), 1)
        .otherwise(0)
    )
    ext = F.when(p.endswith(".pdf"), 4).when(p.rlike(r"\.xlsx?$"), 3).when(p.endswith(".docx"), 2).when(p.endswith(".doc"), 1).otherwise(0)
    reg = (t.contains("regulation") & ~t.contains("order")).cast("int")
    return F.struct(sup.alias("a"), (-order).alias("b"), (-ext).alias("c"), reg.alias("d"), F.length(t).alias("e"), i.alias("i"), l.alias("link"))


def rank_links(links: Column) -> Column:
    """Links of a row best first: not superseded, orders, file type, no bare regulation, short text.

    The first one becomes the primary slot, the others alternates.
    """
    ranked = F.array_sort(F.transform(links, _rank_key))
    return F.transform(
        ranked,
        lambda r, i: F.struct(
            r["link"]["url"].alias("url"), r["link"]["text"].alias("text"), r["link"]["superseded"].alias("superseded"),
            F.when(i == 0, "primary").otherwise("alternate").alias("slot"),
        ),
    )


def is_effective_date_table(columns: Column) -> Column:
    """Tables that list documents by effective date."""
    blob = F.lower(F.array_join(columns, " "))
    return (F.size(columns) >= 2) & blob.contains("effective") & blob.contains("date") & blob.rlike("document|regulation|order")


def annotate_sections(catalog: DataFrame, section: str = "section") -> DataFrame:
    """Rows of effective-date tables get their section, its slug and ranked links; other rows stay as they are."""
    use = is_effective_date_table(F.col("columns")) & (strip(F.col(section)) != "")
    extra = F.create_map(
        F.lit("_schedule_section"), strip(F.col(section)), F.lit("_fee_topic_slug"), slug(F.col(section))
    )
    return catalog.withColumn("cells", F.when(use, F.map_concat("cells", extra)).otherwise(F.col("cells"))).withColumn(
        "links", F.when(use, rank_links(F.col("links"))).otherwise(F.col("links"))
    )


def hydrate_links(catalog: DataFrame) -> DataFrame:
    """Fill empty file columns of each row from its unused links.

    Columns are served in order, each by the first link whose kind its header announces (script links
    last); a second pass gives what is left to any column that stands for a download.
    """
    items = F.transform("links", lambda l, i: F.struct(i.alias("i"), strip(l["url"]).alias("url"), urls.link_kind(l["url"]).alias("kind")))
    any_http = F.array(F.lit("any_http"))

    def serve(acc, want, column):
        free = F.filter(items, lambda x: ~F.array_contains(acc["used"], x["i"]))
        plain = F.filter(free, lambda x: (x["kind"] != "portal") & urls.kind_fits(x["kind"], want))
        portal = F.filter(free, lambda x: (x["kind"] == "portal") & F.array_contains(want, F.lit("any_http")))
        hit = F.coalesce(F.get(plain, F.lit(0)), F.get(portal, F.lit(0)))
        blank = (strip(F.element_at("cells", column)) == "") & ~F.exists(acc["put"], lambda p: p["key"] == column)
        use = blank & (F.size(want) > 0) & hit.isNotNull() & F.map_contains_key(F.col("cells"), column)
        return F.when(
            use,
            F.struct(
                F.concat(acc["used"], F.array(hit["i"])).alias("used"),
                F.concat(acc["put"], F.array(F.struct(column.alias("key"), hit["url"].alias("value")))).alias("put"),
            ),
        ).otherwise(acc)

    start = F.struct(
        F.array().cast("array<int>").alias("used"), F.array().cast("array<struct<key:string,value:string>>").alias("put")
    )
    once = F.aggregate("columns", start, lambda acc, c: serve(acc, urls.expected_kinds(c), c))
    twice = F.aggregate(
        F.filter("columns", lambda c: F.array_contains(urls.expected_kinds(c), F.lit("any_http"))), once, lambda acc, c: serve(acc, any_http, c)
    )
    filled = distinct_map(F.concat(F.map_entries("cells"), twice["put"]))
    return catalog.withColumn("cells", F.when(F.size("links") > 0, filled).otherwise(F.col("cells")))


def primary_link(cells: Column, columns: Column, links: Column) -> Column:
    """Best link of a row as struct (url, label, portal): by the columns most like a file, else the first usable link."""
    def weight(c):
        t = F.lower(c)
        return (
            F.when(t.rlike(r"\bexcel\b|\.xls|spreadsheet|workbook"), 6).otherwise(0)
            + F.when(t.rlike(r"\bpdf\b|acrobat"), 4).otherwise(0)
            + F.when(t.rlike("download|attachment|file|hyperlink"), 2).otherwise(0)
        )

    ranked = F.array_sort(F.transform(columns, lambda c, i: F.struct((-weight(c)).alias("w"), i.alias("i"), c.alias("c"))))

    def match(c):
        kinds = urls.expected_kinds(c, urls.VIEW_HEADER_KINDS)
        fits = F.filter(links, lambda l: (strip(l["url"]) != "") & urls.kind_fits(urls.link_kind(l["url"]), kinds))
        return strip(F.get(fits, F.lit(0))["url"])

    hits = F.filter(
        F.transform(ranked, lambda r: F.struct(match(r["c"]).alias("url"), strip(F.element_at(cells, r["c"])).alias("label"), F.lit(False).alias("portal"))),
        lambda h: urls.is_http_url(h["url"]),
    )
    usable = F.filter(links, lambda l: urls.is_script_url(l["url"]) | urls.is_http_url(l["url"]))
    any_link = F.transform(usable, lambda l: F.struct(strip(l["url"]).alias("url"), strip(l["text"]).alias("label"), urls.is_script_url(l["url"]).alias("portal")))
    return F.coalesce(F.get(hits, F.lit(0)), F.get(any_link, F.lit(0)))


def related_score(url: Column, anchor: Column, weights: Mapping[str, int] = PHRASE_WEIGHTS) -> Column:
    """Points of a link for its phrases, a file extension and a telling path."""
    blob = F.concat(F.lower(text(anchor)), F.lit(" "), F.lower(text(url)))
    score = F.lit(0)
    for phrase, points in weights.items():
        score = score + F.when(blob.contains(phrase), points).otherwise(0)
    return score + F.when(F.lower(url).rlike(FILE_WORDS), 12).otherwise(0) + F.when(url.rlike(PATH_WORDS), 5).otherwise(0)


def rank_related_links(elements: DataFrame, k: int, same_host: bool = True, min_score: int = 3, weights: Mapping[str, int] = PHRASE_WEIGHTS) -> DataFrame:
    """Top ``k`` links per page that may lead to rates, best first; a link counts where it occurs first."""
    href = strip(F.col("href"))
    a = elements.where((F.col("kind") == "anchor") & (href != "") & ~href.startswith("#") & ~F.lower(href).startswith("javascript:"))
    a = a.withColumn("link_url", urls.join_url(F.col("url"), href))
    if same_host:
        a = a.where(urls.host(F.col("link_url")) == urls.host(F.col("url")))
    a = first_per_group(a, ["page_id", "link_url"], [F.col("pos")])
    a = a.withColumn("_s", related_score(F.col("link_url"), F.col("text"), weights)).withColumn("is_file_url", F.lower("link_url").rlike(FILE_WORDS))
    a = a.where((F.col("_s") >= min_score) | F.col("is_file_url")).withColumn("score", F.greatest("_s", F.lit(1)))
    a = top_per_group(a, ["page_id"], [F.col("score").desc(), F.col("link_url")], k, rank="link_rank")
    return a.select("page_id", "link_rank", "link_url", F.col("text").alias("anchor_text"), "score", "is_file_url")


def apply_decisions(candidates: DataFrame, decisions: DataFrame, scope: Sequence[str]) -> DataFrame:
    """Candidates after outside decisions (scope, url, include, display_title; the last one per URL counts by ``position``).

    No decision keeps a row, ``include = false`` drops it, a title replaces its own. When a scope would
    lose every row, its rows are kept unchanged and ``restored`` is true.
    """
    scope = list(scope)
    key = [*scope, "url"]
    last = decisions.withColumn("url", strip(F.col("url"))).groupBy(*key).agg(F.max(F.struct("position", "include", "display_title")).alias("_d"))
    tagged = lookup_join(candidates, last, ["url", *scope], "_hit")
    tagged = tagged.withColumn("_drop", F.coalesce(F.col("_hit._d.include") == F.lit(False), F.lit(False)))
    alive = tagged.groupBy(*scope).agg(F.max(~F.col("_drop")).alias("_any"))
    j = attach(tagged, alive, scope) if scope else tagged.withColumn("_any", tagged.agg(F.max(~F.col("_drop"))).scalar())
    title = strip(F.col("_hit._d.display_title"))
    return j.where(~F.col("_any") | ~F.col("_drop")).select(
        *[F.col(c) for c in candidates.columns if c != "title"],
        F.when(F.col("_any") & (title != ""), title).otherwise(F.col("title")).alias("title"),
        (~F.col("_any")).alias("restored"),
    )


def decision_counts(candidates: DataFrame, kept: DataFrame) -> DataFrame:
    """One row: candidates in, rows out, rows of scopes that were restored."""
    n = candidates.agg(F.count(F.lit(1))).scalar()
    return kept.agg(F.count(F.lit(1)).alias("rows_out"), F.count_if("restored").alias("rows_restored")).select(n.alias("rows_in"), "rows_out", "rows_restored")


def apply_link_labels(links: DataFrame, labels: DataFrame, allowed: DataFrame, row_keys: Sequence[str]) -> DataFrame:
    """Links (row_keys, pos, url, text, superseded) relabelled from outside and ranked again within their row.

    Only URLs on the allow-list may be relabelled; labels are cut to 500 characters. ``slot`` tells the
    primary link of a row from its alternates.
    """
    ok = allowed.select(urls.normalize_url(F.col("url")).alias("_u")).where("_u <> ''").distinct()
    lab = labels.withColumn("_u", urls.normalize_url(F.col("url"))).join(ok, "_u", "left_semi")
    lab = lab.groupBy("_u").agg(F.max(F.struct("position", strip(F.col("display_label")).alias("new_text"), F.col("superseded").alias("new_sup"))).alias("_l"))
    j = lookup_join(links.withColumn("_u", urls.normalize_url(F.col("url"))), lab, ["_u"], "_hit")
    new = F.col("_hit._l")
    j = j.withColumn("text", F.when(new["new_text"] != "", new["new_text"]).otherwise(F.col("text"))).withColumn(
        "superseded", F.coalesce(F.when(new["new_text"] != "", new["new_sup"]), F.col("superseded"))
    )
    w = Window.partitionBy(*row_keys).orderBy(_rank_key(F.struct("url", "text", "superseded"), F.col("pos")))
    j = j.withColumn("link_rank", F.row_number().over(w))
    return j.select(*[F.col(c) for c in links.columns], "link_rank", F.when(F.col("link_rank") == 1, "primary").otherwise("alternate").alias("slot"))


def match_rules(df: DataFrame, url: str, rules: Sequence[Mapping[str, str]], name: str = "rule_ids") -> DataFrame:
    """Ids of the rules a URL meets: host part, path part and pattern, all that a rule states.

    Rules are configuration (id, host_contains, path_contains, url_regex), so they become one projection.
    """
    u = strip(F.col(url))
    host, path, full = F.lower(urls.host(u)), F.lower(urls.path(u)), F.lower(u)
    hits = []
    for r in rules:
        parts = [
            (r.get("host_contains"), lambda v: host.contains(v.lower().strip())),
            (r.get("path_contains"), lambda v: path.contains(v.lower().strip()) | full.contains(v.lower().strip())),
            (r.get("url_regex"), lambda v: u.rlike("(?i)" + v)),
        ]
        stated = [make(v) for v, make in parts if v]
        if not stated:
            raise ValueError(f"Rule {r.get('id')!r} states nothing to match.")
        cond = stated[0]
        for s in stated[1:]:
            cond = cond & s
        hits.append(F.when(cond, F.lit(r["id"])))
    return df.withColumn(name, F.array_compact(F.array(*hits)))


def row_fingerprint(cells: Column, unicode_forms: bool = False) -> Column:
    """Hash of the normalised non-empty (column, value) pairs of a row, whatever their order."""
    pairs = F.transform(
        F.map_entries(cells),
        lambda e: F.struct(F.lower(strip(e["key"])).alias("k"), norm_catalog_value(e["value"], unicode_forms).alias("v")),
    )
    return F.sha2(F.to_json(F.array_sort(F.filter(pairs, lambda p: (p["v"] != "") & ~p["k"].startswith("_links")))), 256)


def link_rows(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of ``b`` (b_id, fingerprint, token, title) linked to rows of ``a`` (a_id, fingerprint, token, title).

    First by fingerprint. What is left on both sides links by title under the same token (or no token on
    the a side): an equal title if exactly one row has it, else a title that contains or is contained in
    the other one if exactly one row has such a title. Contained titles are found by an index of all titles of a
    token along which the others run, on distinct titles with counts; see ``contained_or_containing``. Groups of equal rows
    are never paired up with each other. Titles only ever meet under one token. The sides are read once; titles are stored.
    """
    one = a.groupBy("fingerprint").agg(F.max("a_id").alias("a_id"))
    by_print = cut_lineage(lookup_join(b, one, ["fingerprint"], "_hit"))
    exact = by_print.where("_hit IS NOT NULL").select("b_id", F.col("_hit.a_id").alias("a_id"), F.lit("fingerprint").alias("how"))
    rest_b = by_print.where("_hit IS NULL AND token <> '' AND title <> ''").select("b_id", "token", "title")
    rest_a = attach(a, exact.select("a_id").distinct(), ["a_id"], "anti").where("title <> ''")
    titles = cut_lineage(rest_a.groupBy(F.col("token").alias("scope"), "title").agg(F.count(F.lit(1)).alias("n"), F.min("a_id").alias("a_id")))
    # A title of the b side is looked up under its own token and among the titles without one.
    scopes = F.explode(F.array(F.col("token"), F.lit("")))
    wanted = rest_b.select("token", "title").distinct().withColumn("scope", scopes)

    def hits(pairs):
        return pairs.groupBy("token", "title").agg(F.sum("n").alias("n"), F.min("a_id").alias("a_id"))

    same = wanted.join(titles.select(F.col("scope").alias("_s"), F.col("title").alias("_t"), "n", "a_id"), (F.col("scope") == F.col("_s")) & (F.col("title") == F.col("_t")), "left")
    same = cut_lineage(hits(same.select("token", "title", "n", "a_id")))
    open_titles = same.where("n IS NULL").select("token", "title").withColumn("scope", scopes)

    near = contained_or_containing(open_titles.select("scope", "title").distinct(), titles)
    part = hits(open_titles.join(near, ["scope", "title"]).select("token", "title", "n", "a_id"))
    found = same.where("n = 1").withColumn("how", F.lit("title")).unionByName(part.where("n = 1").withColumn("how", F.lit("contained")))
    linked = lookup_join(rest_b, found.select("token", "title", "a_id", "how"), ["title", "token"], "_hit").where("_hit IS NOT NULL")
    linked = linked.select("b_id", F.col("_hit.a_id").alias("a_id"), F.col("_hit.how").alias("how"))
    return exact.unionByName(linked)
