"""Breadth-first expansion over stored link edges."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from ratetally.functions import urls
from ratetally.operators.spread import cut_lineage, top_per_group

# Extensions of documents, which are collected rather than followed.
SKIP_EXTENSIONS = ["pdf", "xlsx", "xls", "docx", "doc", "csv", "zip", "xlsm"]


def page_edges(
    elements: DataFrame, path_must_contain: str = "", same_host: bool = True, max_links: int | None = None,
    skip: Sequence[str] = SKIP_EXTENSIONS,
) -> DataFrame:
    """(src, pos, dst): links of each page that may be followed, each target once per page; the first ``max_links`` where given."""
    href = F.trim(F.coalesce("href", F.lit("")))
    a = elements.where((F.col("kind") == "anchor") & (href != "") & ~href.startswith("#") & ~F.lower(href).startswith("javascript:"))
    a = a.withColumn("_full", urls.join_url(F.col("url"), href))
    keep = urls.scheme(F.col("_full")).isin("http", "https") & ~F.lower(urls.path(F.col("_full"))).rlike(r"\.(" + "|".join(skip) + ")$")
    if same_host:
        keep = keep & (F.lower(urls.host(F.col("_full"))) == F.lower(urls.host(F.col("url"))))
    if path_must_contain:
        keep = keep & F.lower(urls.path(F.col("_full"))).contains(path_must_contain.lower().strip())
    e = a.where(keep).select(urls.drop_fragment(F.col("url")).alias("src"), "pos", urls.drop_fragment(F.col("_full")).alias("dst"))
    e = e.groupBy("src", "dst").agg(F.min("pos").alias("pos"))
    if max_links is not None:
        e = top_per_group(e, ["src"], [F.col("pos"), F.col("dst")], max_links)
    return e.select("src", "pos", "dst")


def expand_frontier(edges: DataFrame, seeds: DataFrame, depth: int = 2, max_pages: int | None = None) -> DataFrame:
    """(url, depth) of every page reached from ``seeds`` (url) in fewer than ``depth`` steps, at its least depth.

    ``max_pages`` keeps the first pages by depth and URL. A round joins the pages that the one before has added with
    their edges and stores what is new, nothing else; it ends when a round adds nothing. Targets are compared with the
    URLs of all rounds, which are only read.
    """
    start = seeds.select(urls.drop_fragment(F.col("url")).alias("url")).where("url <> ''").distinct()
    last = seen = cut_lineage(start.withColumn("depth", F.lit(0)))
    for d in range(1, depth):
        found = edges.join(last.select(F.col("url").alias("src")), "src", "left_semi").select(F.col("dst").alias("url")).distinct()
        fresh = cut_lineage(found.join(seen.select("url"), "url", "left_anti").withColumn("depth", F.lit(d)))
        if fresh.isEmpty():
            break
        last, seen = fresh, seen.unionByName(fresh)
    if max_pages is not None:
        seen = seen.orderBy("depth", "url").limit(max_pages)
    return seen
