"""Registry of file versions: electing the current one, skipping known content, listing and history."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ratetally.functions.text import blank_to_null, natural_key, norm_key, strip, text
from ratetally.operators.spread import dense_ids, first_per_group, lookup_join, top_per_group

# Text columns of a stored version; blank ones are stored as null.
VERSION_TEXTS = (
    "state_code", "logical_schedule_key", "source_url", "content_sha256", "stored_rel_path", "original_filename", "mime_type",
    "source_label", "remote_etag", "effective_date_source",
)


def state_key(c: Column) -> Column:
    """Upper-cased state code, '' when there is none."""
    return F.upper(strip(c))


def schedule_key(key: Column, artifact_id: Column) -> Column:
    """Key a mapping is stored under: the key of the file, else ``artifact:<id>``."""
    return F.coalesce(blank_to_null(key), F.concat(F.lit("artifact:"), artifact_id.cast("string")))


def effective_day(effective: Column, fetched: Column) -> Column:
    """Day a version counts from: its effective date, else the day it was fetched."""
    return F.coalesce(effective, F.to_date(fetched), F.lit("0001-01-01").cast("date"))


def _rank():
    """Order of versions within a key; the greatest one is current."""
    return F.struct(
        (~F.coalesce(F.col("is_superseded_hint"), F.lit(False))).alias("live"),
        effective_day(F.col("portal_effective_date"), F.col("fetched_at_utc")).alias("day"),
        F.col("artifact_id").alias("artifact_id"),
    )


def _keyed(registry: DataFrame) -> DataFrame:
    return registry.withColumn("_state", state_key(F.col("state_code"))).withColumn("_key", strip(F.col("logical_schedule_key")))


def winners(registry: DataFrame) -> DataFrame:
    """(state, key, artifact_id) of the current version of every non-blank key.

    Versions that are not superseded come first, then the latest effective day, then the highest id.
    """
    best = _keyed(registry).where("_key <> ''").groupBy("_state", "_key").agg(F.max(_rank()).alias("best"))
    return best.select("_state", "_key", F.col("best.artifact_id").alias("artifact_id"))


def mark_current(registry: DataFrame) -> DataFrame:
    """Registry with ``is_current`` set anew. The join is on the id too, so a long history is spread out."""
    won = winners(registry).withColumn("_won", F.lit(True))
    marked = _keyed(registry).join(won, ["_state", "_key", "artifact_id"], "left")
    return marked.withColumn("is_current", F.coalesce(F.col("_won"), F.lit(False))).select(
        *[c for c in registry.columns if c != "is_current"], "is_current"
    )


def mark_current_for(registry: DataFrame, state: str) -> DataFrame:
    """``mark_current`` for one state; other states keep their flags."""
    inside = state_key(F.col("state_code")) == state.strip().upper()
    cols = registry.columns
    return mark_current(registry.where(inside)).select(*cols).unionByName(registry.where(~inside))


def current_versions(registry: DataFrame) -> DataFrame:
    """The current row of every key."""
    order = [F.col("_rank").desc()]
    ranked = _keyed(registry).where("_key <> ''").withColumn("_rank", _rank())
    return first_per_group(ranked, ["_state", "_key"], order).drop("_rank", "_state", "_key")


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row per key, the first in ``order``."""
    return first_per_group(df, keys, order)


def with_known_content(new: DataFrame, registry: DataFrame) -> DataFrame:
    """``new`` with ``known_artifact_id``: the newest stored row of the same state, key and content, or null."""
    same = ["_state", "_key", "_sha"]
    tag = lambda df: _keyed(df).withColumn("_sha", strip(F.col("content_sha256")))
    stored = tag(registry).where("_key <> '' AND _sha <> ''").groupBy(*same).agg(F.max("artifact_id").alias("known_artifact_id"))
    found = lookup_join(tag(new), stored, same, "_hit")
    return found.select(*[F.col(f"`{c}`") for c in new.columns], F.col("_hit.known_artifact_id").alias("known_artifact_id"))


def skip_known(new: DataFrame, registry: DataFrame) -> DataFrame:
    """Rows of ``new`` whose content is not stored yet under their state and key."""
    return with_known_content(new, registry).where("known_artifact_id IS NULL").drop("known_artifact_id")


def norm_etag(c: Column) -> Column:
    """Entity tag without blanks; null when there is none."""
    return blank_to_null(c)


def with_unchanged(heads: DataFrame, registry: DataFrame) -> DataFrame:
    """``heads`` (state_code, logical_schedule_key, remote_etag) with ``unchanged``: the current version has the same tag."""
    current = _keyed(current_versions(registry)).select("_state", "_key", norm_etag(F.col("remote_etag")).alias("stored_etag"))
    found = lookup_join(_keyed(heads), current, ["_state", "_key"], "_hit")
    same = norm_etag(F.col("remote_etag")) == F.col("_hit.stored_etag")
    return found.select(*[F.col(f"`{c}`") for c in heads.columns], F.coalesce(same, F.lit(False)).alias("unchanged"))


def clean_version(df: DataFrame) -> DataFrame:
    """Text columns as they are stored: trimmed, blanks as null, states upper-cased."""
    stored = {c: blank_to_null(F.upper(F.col(c)) if c == "state_code" else F.col(c)) for c in VERSION_TEXTS if c in df.columns}
    return df.withColumns(stored)


def append_versions(registry: DataFrame, new: DataFrame, position: str | None = None) -> DataFrame:
    """Registry plus ``new`` with fresh ids above the highest one; new rows are not current yet.

    ``position`` (an integer column of ``new``) fixes the order of the ids.
    """
    top = F.coalesce(registry.agg(F.max("artifact_id")).scalar(), F.lit(0))
    fresh = clean_version(new)
    by = ["state_code", "logical_schedule_key", "content_sha256", "source_url"]
    fresh = dense_ids(fresh, "artifact_id", top, position, by).withColumn("is_current", F.lit(False))
    have = set(fresh.columns)
    cols = [
        F.col(c) if c in have else F.lit(None).cast(registry.schema[c].dataType).alias(c) for c in registry.columns
    ]
    return registry.unionByName(fresh.select(*cols))


def remove_versions(registry: DataFrame, ids: DataFrame) -> DataFrame:
    """Registry without the given ``artifact_id`` values, current flags elected anew."""
    left = registry.join(ids.select("artifact_id").distinct(), "artifact_id", "left_anti")
    return mark_current(left.select(*registry.columns))


def list_versions(registry: DataFrame, state: str | None = None, current_only: bool = True, limit: int | None = None) -> DataFrame:
    """Listing by state, key, effective date (newest first, none last), fetch time and id.

    Everything is listed unless ``limit`` says otherwise.
    """
    out = registry
    if state:
        out = out.where(state_key(F.col("state_code")) == state.strip().upper())
    if current_only:
        out = out.where("is_current")
    out = out.orderBy(
        F.col("state_code").asc(), F.col("logical_schedule_key").asc(), F.col("portal_effective_date").desc_nulls_last(),
        F.col("fetched_at_utc").desc(), F.col("artifact_id").desc(),
    )
    return out if limit is None else out.limit(limit)


def version_history(registry: DataFrame) -> DataFrame:
    """All versions by natural order of the key, latest edition first."""
    edition = F.coalesce(F.col("portal_effective_date").cast("timestamp_ntz"), F.col("fetched_at_utc").cast("timestamp_ntz"))
    return registry.withColumn("edition", edition).orderBy(
        natural_key(F.col("logical_schedule_key")).asc(), F.col("edition").desc_nulls_last(), F.col("artifact_id").desc()
    )


def recent(history: DataFrame, user: str, at: str, n: int = 35, tie: Sequence[str] = ()) -> DataFrame:
    """Newest ``n`` rows per user."""
    return top_per_group(history, [user], [F.col(at).desc(), *[F.col(c).desc() for c in tie]], n, rank="recency")


def state_dashboard(registry: DataFrame, compares: DataFrame, portals: DataFrame) -> DataFrame:
    """Per portal state: stored current files, compares run, label and time of the last one, last sync."""
    files = registry.where("is_current").groupBy(state_key(F.col("state_code")).alias("state_code")).agg(F.count(F.lit(1)).alias("file_count"))
    runs = compares.groupBy(state_key(F.col("state_code")).alias("state_code")).agg(
        F.count(F.lit(1)).alias("compare_count"),
        F.max(F.struct("at", "label")).alias("_last"),
    )
    sites = portals.groupBy(state_key(F.col("state_code")).alias("state_code")).agg(F.max("last_agent_run_at_utc").alias("last_sync"))
    return (
        sites.join(files, "state_code", "left").join(runs, "state_code", "left").select(
            "state_code",
            F.coalesce("file_count", F.lit(0)).alias("file_count"),
            F.coalesce("compare_count", F.lit(0)).alias("compare_count"),
            F.col("_last.label").alias("last_compare"),
            F.col("_last.at").alias("last_compare_at"),
            "last_sync",
        )
    )


def latest_mapping(mappings: DataFrame) -> DataFrame:
    """Newest mapping per (state, key) by its last change."""
    changed = F.coalesce(F.col("updated_at_utc"), F.col("created_at_utc"))
    return first_per_group(
        mappings, ["state_code", "state_logical_schedule_key"], [changed.desc(), F.col("mapping_id").desc()]
    )


def merge_lists(current: DataFrame, history: DataFrame, key: str) -> DataFrame:
    """Union on ``key`` in which rows of ``current`` win."""
    both = current.withColumn("_src", F.lit(0)).unionByName(history.withColumn("_src", F.lit(1)), allowMissingColumns=True)
    rest = [F.col(f"`{c}`") for c, t in both.dtypes if c not in (key, "_src") and "map<" not in t and "variant" not in t]
    return first_per_group(both, [key], [F.col("_src"), *rest]).drop("_src")
