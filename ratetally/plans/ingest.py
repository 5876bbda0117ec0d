"""One ingest run: candidates to stored versions, current flags, pruning and a summary."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from ratetally.functions import urls
from ratetally.functions.dates import hint_date
from ratetally.functions.text import blank_to_null, strip
from ratetally.operators.spread import attach, cut_lineage, first_per_group
from ratetally.operators.versions import append_versions, mark_current, state_key, with_known_content


def unpublished(registry: DataFrame, published: DataFrame, fail_open: bool = True) -> DataFrame:
    """Registry rows whose normalised URL is no longer published in their state.

    ``published`` has state_code and url. A state for which nothing was published loses nothing when
    ``fail_open`` holds.
    """
    key = ["_url", "_state"]
    pub = published.select(urls.normalize_url(F.col("url")).alias("_url"), state_key(F.col("state_code")).alias("_state")).where("_url <> ''").distinct()
    reg = registry.withColumn("_url", urls.normalize_url(F.col("source_url"))).withColumn("_state", state_key(F.col("state_code")))
    gone = attach(reg.where("_url <> ''"), pub, key, "anti")
    if fail_open:
        gone = attach(gone, pub.select("_state").distinct(), ["_state"], "semi")
    return gone.drop("_url", "_state")


def prune(registry: DataFrame, published: DataFrame, fail_open: bool = True) -> DataFrame:
    """Registry without the rows that are no longer published."""
    gone = unpublished(registry, published, fail_open).select("artifact_id")
    return registry.join(gone, "artifact_id", "left_anti").select(*registry.columns)


@dataclass(frozen=True)
class IngestRun:
    """Next registry, the outcome of every fetched file, and one summary row per state."""

    registry: DataFrame
    outcomes: DataFrame
    summary: DataFrame


def run_summary(outcomes: DataFrame, run: str = "state_code") -> DataFrame:
    """Per run: candidates, written, skipped, errors, truncated and pruned files (column ``outcome``)."""
    n = lambda o: F.count_if(F.col("outcome") == o)
    return outcomes.groupBy(run).agg(
        F.count_if(F.col("outcome") != "pruned").alias("candidates"), n("written").alias("written"), n("skipped").alias("skipped"),
        n("error").alias("errors"), n("truncated").alias("truncated"), n("pruned").alias("pruned"),
    )


def ingest_run(registry: DataFrame, fetched: DataFrame, fetched_at: Column) -> IngestRun:
    """Register fetched files and bring the registry up to date.

    ``fetched`` (position, state_code, url, logical_schedule_key, source_label, content_sha256, bytes_size,
    mime_type, portal_date, effective_date_source, superseded_hint, error) is one discovery run: rows with
    an error were not fetched. Content that is stored already, or occurs earlier in the run under the same
    state and key, is skipped. Versions that are no longer published are pruned, current flags elected.
    """
    leaf = urls.leaf_name(F.col("url"))
    key = F.coalesce(blank_to_null(F.col("logical_schedule_key")), urls.folder_slug(F.regexp_replace(leaf, r"\.[^.]*$", "")))
    day = hint_date(F.col("portal_date"))
    hint = strip(F.col("portal_date"))
    prefix = F.coalesce(day.cast("string"), F.nullif(hint, F.lit("")), F.date_format(fetched_at, "yyyy-MM-dd"))
    f = fetched.withColumn("state_code", F.nullif(state_key(F.col("state_code")), F.lit(""))).withColumn("logical_schedule_key", key)
    good = f.where("error IS NULL")
    new = good.select(
        "position", "state_code", "logical_schedule_key", F.col("url").alias("source_url"), "content_sha256",
        urls.stored_path(F.col("state_code"), F.col("logical_schedule_key"), prefix, F.col("content_sha256"), leaf).alias("stored_rel_path"),
        leaf.alias("original_filename"), "mime_type", "bytes_size", fetched_at.alias("fetched_at_utc"), "source_label",
        day.alias("portal_effective_date"),
        F.coalesce(blank_to_null(F.col("effective_date_source")), F.when(day.isNotNull(), "catalog")).alias("effective_date_source"),
        F.col("superseded_hint").alias("is_superseded_hint"),
    )
    judged = with_known_content(new, registry)
    fresh = first_per_group(judged.where("known_artifact_id IS NULL"), ["state_code", "logical_schedule_key", "content_sha256"], [F.col("position")])
    # The next steps read the new rows and the grown registry several times: each is stored once.
    fresh = cut_lineage(fresh.drop("known_artifact_id"))
    grown = cut_lineage(append_versions(registry, fresh, "position"))
    gone = cut_lineage(unpublished(grown, f.select("state_code", "url")).select("artifact_id", "state_code", "source_url"))
    final = mark_current(grown.join(gone.select("artifact_id"), "artifact_id", "left_anti").select(*registry.columns))

    written = fresh.select("position", F.lit("written").alias("_w"))
    out = f.join(written, "position", "left").select(
        F.coalesce("state_code", F.lit("")).alias("state_code"), "url",
        F.when(F.col("error").isNotNull(), "error").when(F.col("_w").isNotNull(), "written").otherwise("skipped").alias("outcome"),
    )
    out = out.unionByName(gone.select(state_key(F.col("state_code")).alias("state_code"), F.col("source_url").alias("url"), F.lit("pruned").alias("outcome")))
    return IngestRun(final, out, run_summary(out))
