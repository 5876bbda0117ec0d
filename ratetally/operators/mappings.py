"""Column mappings as data: lookup, label resolution, grouping of long rows, bulk import."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ratetally.functions.jsontext import distinct_map, paired_count, parse_column_map
from ratetally.functions.text import artifact_label, blank_to_null, file_stem, norm_label, strip, text
from ratetally.operators.registry import upsert_mappings
from ratetally.operators.spread import attach, cut_lineage, lookup_join, previous_value, top_per_group
from ratetally.operators.versions import current_versions, latest_mapping, schedule_key, state_key
from ratetally.sources.textfiles import read_delimited_grid

# Header spellings of the bulk file and the field each one stands for.
HEADER_ALIASES = {
    "stateschedule": "state_schedule", "state_fee_schedule": "state_schedule", "state": "state_schedule",
    "artifactid": "artifact_id", "artifact_id": "artifact_id",
    "dstschedule": "dst_schedule", "dst_fee_schedule": "dst_schedule", "dst_table": "dst_schedule", "dst": "dst_schedule",
    "statecolumn": "state_column", "state_col": "state_column",
    "dstcolumn": "dst_column", "dst_col": "dst_column",
    "action": "action", "mode": "action",
}
TABLE_NAME = r"^[A-Za-z_][A-Za-z0-9_]{0,127}$"


def canonical_header(c: Column, aliases: Mapping[str, str] = HEADER_ALIASES) -> Column:
    """Field a header stands for, null when unknown. Case, blanks, ``_`` and ``-`` do not matter."""
    squeeze = lambda s: s.replace("_", "").replace("-", "").replace(" ", "").lower()
    table = {squeeze(k): v for k, v in aliases.items()}
    lookup = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    return F.element_at(lookup, F.regexp_replace(norm_label(c, unicode_forms=False), "[ _-]", ""))


def rename_headers(df: DataFrame, aliases: Mapping[str, str] = HEADER_ALIASES) -> DataFrame:
    """Only the columns with a known header, under their field names. Fails when a needed one is missing."""
    squeeze = lambda s: "".join(ch for ch in s.strip().lower() if ch not in " _-")
    table = {squeeze(k): v for k, v in aliases.items()}
    found = {table[squeeze(c)]: c for c in df.columns if squeeze(c) in table}
    if not {"state_schedule", "artifact_id"} & set(found):
        raise ValueError("missing_state_column")
    if "dst_schedule" not in found:
        raise ValueError("missing_dst_schedule_column")
    if not {"state_column", "dst_column"} <= set(found):
        raise ValueError("missing_mapping_columns")
    return df.select(*[strip(F.col(f"`{c}`")).alias(f) for f, c in found.items()])


def read_mapping_file(spark: SparkSession, path: str) -> DataFrame:
    """Rows of delimited mapping files for ``bulk_import``: row_no (the header is row 1) and the six fields as text.

    Headers go by ``canonical_header``, the last of two equal ones counts; columns that are absent are blank. Fails when a
    file lacks a needed column, like ``rename_headers``.
    """
    cells = read_delimited_grid(spark, path)
    head = cells.where("row_idx = 0").withColumn("field", canonical_header(F.col("cell"))).where("field IS NOT NULL").select("file_id", "col_idx", "field")
    has = lambda f: F.array_contains("f", f)
    wrong = (
        F.when(~has("state_schedule") & ~has("artifact_id"), "missing_state_column").when(~has("dst_schedule"), "missing_dst_schedule_column")
        .when(~has("state_column") | ~has("dst_column"), "missing_mapping_columns")
    )
    files = cells.select("file_id").distinct().join(head.groupBy("file_id").agg(F.collect_set("field").alias("f")), "file_id", "left")
    files = files.withColumn("f", F.coalesce("f", F.array().cast("array<string>")))
    bad = files.select(wrong.alias("w")).where("w IS NOT NULL").first()
    if bad is not None:
        raise ValueError(bad["w"])
    named = attach(cells.where("row_idx > 0"), head, ["file_id", "col_idx"])
    fields = sorted(set(HEADER_ALIASES.values()))
    value = lambda f: F.coalesce(F.max_by(strip(F.col("cell")), F.when(F.col("field") == f, F.col("col_idx"))), F.lit("")).alias(f)
    rows = named.groupBy("file_id", "row_idx").agg(*[value(f) for f in fields])
    return rows.select((F.col("row_idx") + 1).cast("long").alias("row_no"), *fields)


def artifact_labels(artifacts: DataFrame) -> DataFrame:
    """(label, artifact_id): every normalised text a file can be called by, once per file."""
    key, name = F.col("logical_schedule_key"), F.col("original_filename")
    candidates = F.array(
        artifact_label(F.col("artifact_id"), F.col("source_label"), key, name),
        F.col("source_label"),
        F.replace(text(key), F.lit("_"), F.lit(" ")),
        key,
        file_stem(name),
        F.concat(F.lit("artifact:"), F.col("artifact_id").cast("string")),
        F.col("artifact_id").cast("string"),
    )
    long = artifacts.select("artifact_id", F.explode(candidates).alias("label"))
    return long.select(norm_label(F.col("label")).alias("label"), "artifact_id").where("label <> ''").distinct()


def resolve_labels(labels: DataFrame, artifacts: DataFrame, shown: int = 12) -> DataFrame:
    """``labels`` (column ``label``) with the number of matching files, the id when it is unique, and a status.

    Of an ambiguous label only the ``shown`` lowest ids are listed, so a label shared by very many files
    stays one short row.
    """
    index = artifact_labels(artifacts)
    counts = index.groupBy("label").agg(F.count(F.lit(1)).alias("matches"), F.min("artifact_id").alias("lowest"))
    few = top_per_group(index, ["label"], [F.col("artifact_id")], shown)
    few = few.groupBy("label").agg(F.array_join(F.array_sort(F.collect_list("artifact_id")).cast("array<string>"), ", ").alias("ids"))
    table = counts.join(few, "label").withColumnRenamed("label", "_label")
    found = lookup_join(labels.withColumn("_label", norm_label(F.col("label"))), table, ["_label"], "_hit")
    n = F.coalesce(F.col("_hit.matches"), F.lit(0))
    return found.select(
        *labels.columns,
        n.alias("matches"),
        F.when(n == 1, F.col("_hit.lowest")).alias("artifact_id"),
        F.coalesce(F.col("_hit.ids"), F.lit("")).alias("candidate_ids"),
        F.when(n == 0, "unknown").when(n == 1, "resolved").otherwise("ambiguous").alias("resolution"),
    )


def lookup_mapping(requests: DataFrame, mappings: DataFrame) -> DataFrame:
    """Mapping for each request (state_code, schedule_key, dst_fsname).

    With a target table the exact triple is wanted, without one the newest mapping of the state and key.
    """
    maps = mappings.select(
        "state_code", F.col("state_logical_schedule_key").alias("schedule_key"), "dst_fsname", "mapping_id", "column_map_json",
        F.coalesce("updated_at_utc", "created_at_utc").alias("_changed"),
    )
    req = requests.select(
        *[c for c in requests.columns if c not in ("state_code", "schedule_key", "dst_fsname")],
        state_key(F.col("state_code")).alias("state_code"), strip(F.col("schedule_key")).alias("schedule_key"),
        strip(F.col("dst_fsname")).alias("dst_fsname"),
    )
    value = F.struct("_changed", "mapping_id", "dst_fsname", "column_map_json")
    exact = maps.groupBy("state_code", "schedule_key", "dst_fsname").agg(F.max(value).alias("m"))
    newest = maps.groupBy("state_code", "schedule_key").agg(F.max(value).alias("m"))
    with_table = lookup_join(req.where("dst_fsname <> ''"), exact, ["schedule_key", "state_code", "dst_fsname"], "_hit")
    without = lookup_join(req.where("dst_fsname = ''"), newest, ["schedule_key", "state_code"], "_hit")
    out = with_table.select(*req.columns, F.col("_hit.m").alias("m")).unionByName(
        without.select(*req.columns, F.col("_hit.m").alias("m"))
    )
    return out.select(
        *req.columns,
        F.col("m.mapping_id").alias("mapping_id"), F.col("m.dst_fsname").alias("found_table"),
        F.col("m.column_map_json").alias("column_map_json"), F.col("m").isNotNull().alias("found"),
    )


def mapping_inventory(mappings: DataFrame, artifacts: DataFrame) -> DataFrame:
    """Mappings with their paired column count and the id and readable label of the file they belong to."""
    label = artifact_label(F.col("artifact_id"), F.col("source_label"), F.col("logical_schedule_key"), F.col("original_filename"))
    cur = current_versions(artifacts).select(
        state_key(F.col("state_code")).alias("state_code"), F.col("logical_schedule_key").alias("_k"),
        F.col("artifact_id").alias("_cur_id"), label.alias("_cur_label"),
    )
    by_id = artifacts.select(F.col("artifact_id").alias("_ref"), label.alias("_ref_label"))
    key = strip(F.col("state_logical_schedule_key"))
    ref = F.regexp_extract(F.lower(key), r"^artifact:(\d+)$", 1).try_cast("long")
    m = mappings.withColumn("_ref", ref).withColumn("_k", F.when(F.lower(key).startswith("artifact:"), F.lit(None)).otherwise(key))
    m = m.join(cur, ["state_code", "_k"], "left").join(by_id, "_ref", "left")
    plain = F.when(key == "", "Unknown schedule").when(F.col("_ref").isNotNull(), key).otherwise(F.replace(key, F.lit("_"), F.lit(" ")))
    return m.select(
        "mapping_id", "state_code", "state_logical_schedule_key", "dst_fsname",
        paired_count(parse_column_map(F.col("column_map_json"))).alias("paired_column_count"),
        F.coalesce("_cur_id", "_ref").alias("artifact_id"),
        F.coalesce("_cur_label", "_ref_label", plain).alias("schedule_label"),
        F.coalesce("updated_at_utc", "created_at_utc").alias("changed_at_utc"), "updated_by",
    )


@dataclass(frozen=True)
class Assembled:
    """Long rows grouped into mappings: one row per group, one per pair, and the overwrite warnings."""

    groups: DataFrame
    pairs: DataFrame
    warnings: DataFrame


def assemble_mappings(rows: DataFrame) -> Assembled:
    """Group rows (row_no, group_key, dst_schedule, state_column, dst_column, action, …) into mappings.

    Of a repeated left column the last row counts, at the place of the first one. The last row of a
    group decides between merge and replace. The rows are combined once, by pair; groups follow from the pairs.
    """
    keys = ["group_key", "dst_schedule"]
    action = F.when(F.col("action").startswith("merg"), "merge").otherwise("replace").alias("a")
    pairs = cut_lineage(rows.groupBy(*keys, "state_column").agg(
        F.max(F.struct("row_no", "dst_column", action)).alias("_l"), F.min("row_no").alias("ord"),
        F.min(F.when(F.col("state_schedule") != "", F.struct("row_no", "state_schedule"))).alias("_s"), F.max("artifact_id").alias("artifact_id"),
    ))
    groups = pairs.groupBy(*keys).agg(
        F.max("_l").alias("_l"), F.min("ord").alias("first_row"), F.min("_s").alias("_s"), F.max("artifact_id").alias("artifact_id")
    ).select(*keys, F.col("_l.a").alias("action"), "first_row", F.coalesce("_s.state_schedule", F.lit("")).alias("state_schedule"), "artifact_id")
    pairs = pairs.select(*keys, "state_column", F.col("_l.dst_column").alias("dst_column"), "ord")
    prior = previous_value(rows.select(*keys, "state_column", "row_no", "dst_column"), [*keys, "state_column"], "row_no", "dst_column", "replaced")
    warnings = prior.where(F.col("replaced").isNotNull() & (F.col("replaced") != F.col("dst_column")))
    return Assembled(groups, pairs, warnings)


@dataclass(frozen=True)
class BulkImport:
    """Outcome of a bulk import. ``mappings`` is the next snapshot (unchanged on a dry run)."""

    applied: DataFrame
    errors: DataFrame
    warnings: DataFrame
    mappings: DataFrame


def bulk_import(
    rows: DataFrame, artifacts: DataFrame, mappings: DataFrame, state: str, now: Column,
    dry_run: bool = False, updated_by: str | None = None,
) -> BulkImport:
    """Import long mapping rows (row_no, state_schedule, artifact_id, dst_schedule, state_column, dst_column, action).

    Each group of rows is resolved to a stored file by id or by label, checked, merged with or put in
    place of the saved mapping, and written back. Failed rows and groups are reported, the rest applied.
    """
    sc = state.strip().upper()
    r = rows.select(
        F.col("row_no").cast("long").alias("row_no"),
        *[text(strip(F.col(c))).alias(c) for c in ("state_schedule", "artifact_id", "dst_schedule", "state_column", "dst_column")],
        F.lower(F.coalesce(blank_to_null(F.col("action")), F.lit("replace"))).alias("action"),
    )
    r = r.withColumn("_id", F.col("artifact_id").try_cast("double").try_cast("long"))
    message = (
        F.when((F.col("dst_schedule") == "") | (F.col("state_column") == "") | (F.col("dst_column") == ""),
               "DstSchedule, StateColumn, and DstColumn are required.")
        .when((F.col("artifact_id") != "") & F.col("_id").isNull(), F.concat(F.lit("Invalid ArtifactId: "), F.col("artifact_id")))
        .when((F.col("artifact_id") == "") & (F.col("state_schedule") == ""), "StateSchedule or ArtifactId is required.")
    )
    # The rows feed the groups, the pairs and the warnings: the parsed form is stored once.
    r = cut_lineage(r.withColumn("message", message))
    row_errors = r.where("message IS NOT NULL").select("row_no", "message")
    group_key = F.when(F.col("_id").isNotNull(), F.concat(F.lit("aid:"), F.col("_id").cast("string"))).otherwise(norm_label(F.col("state_schedule")))
    good = r.where("message IS NULL").withColumn("group_key", group_key).drop("artifact_id", "message").withColumnRenamed("_id", "artifact_id")
    parts = assemble_mappings(good)

    mine = artifacts.where(state_key(F.col("state_code")) == sc)
    named = resolve_labels(parts.groups.where("artifact_id IS NULL").drop("artifact_id").withColumn("label", F.col("group_key")), mine)
    named = named.drop("label")
    by_id = parts.groups.where("artifact_id IS NOT NULL").select(
        *[c for c in named.columns if c not in ("matches", "artifact_id", "candidate_ids", "resolution")],
        F.lit(1).cast("long").alias("matches"), "artifact_id", F.lit("").alias("candidate_ids"), F.lit("resolved").alias("resolution"),
    )
    groups = named.unionByName(by_id)
    facts = artifacts.select("artifact_id", F.col("state_code").alias("_art_state"), F.col("logical_schedule_key").alias("_key"), F.lit(True).alias("_exists"))
    groups = groups.join(facts, "artifact_id", "left")
    problem = (
        F.when(~F.col("dst_schedule").rlike(TABLE_NAME), "Invalid table name")
        .when(F.col("resolution") == "unknown", F.concat(F.lit("No saved file matches StateSchedule "), F.col("state_schedule"), F.lit(f" for {sc}.")))
        .when(F.col("resolution") == "ambiguous",
              F.concat(F.lit("Multiple artifacts match "), F.col("state_schedule"), F.lit(": ids "), F.col("candidate_ids"),
                       F.when(F.col("matches") > 12, "…").otherwise(""), F.lit(". Set ArtifactId column to disambiguate.")))
        .when(F.col("_exists").isNull(), F.concat(F.lit("Artifact "), F.col("artifact_id").cast("string"), F.lit(" not found.")))
        .when((state_key(F.col("_art_state")) != "") & (state_key(F.col("_art_state")) != sc),
              F.concat(F.lit("Artifact "), F.col("artifact_id").cast("string"), F.lit(" belongs to state "), state_key(F.col("_art_state")), F.lit(f", not {sc}.")))
    )
    groups = groups.withColumn("message", problem).withColumn("logical_schedule_key", schedule_key(F.col("_key"), F.col("artifact_id")))
    groups = cut_lineage(groups)
    errors = row_errors.unionByName(groups.where("message IS NOT NULL").select(F.col("first_row").alias("row_no"), "message"))
    fine = groups.where("message IS NULL").select("group_key", "dst_schedule", "action", "first_row", "artifact_id", "logical_schedule_key")

    # Saved pairs of merged groups come first, in their order; new pairs overwrite or follow.
    stored = mappings.where(F.col("state_code") == sc).select(
        F.col("state_logical_schedule_key").alias("logical_schedule_key"), F.col("dst_fsname").alias("dst_schedule"),
        F.posexplode(parse_column_map(F.col("column_map_json"))).alias("pos", "state_column", "dst_column"),
    )
    old = fine.where("action = 'merge'").join(stored, ["logical_schedule_key", "dst_schedule"]).select(
        "group_key", "dst_schedule", "state_column", "dst_column", F.lit(0).alias("side"), F.col("pos").cast("long").alias("ord")
    )
    new = parts.pairs.select("group_key", "dst_schedule", "state_column", "dst_column", F.lit(1).alias("side"), "ord")
    merged = old.unionByName(new).groupBy("group_key", "dst_schedule", "state_column").agg(
        F.max(F.struct("side", "dst_column")).alias("_v"), F.min(F.struct("side", "ord")).alias("_o")
    )
    # One JSON object per mapping is the stored form; it is as long as the mapped table is wide.
    objects = merged.groupBy("group_key", "dst_schedule").agg(
        F.count(F.lit(1)).alias("pairs"),
        F.array_sort(F.collect_list(F.struct("_o", F.col("state_column").alias("k"), F.col("_v.dst_column").alias("v")))).alias("_e"),
    ).select(
        "group_key", "dst_schedule", "pairs",
        F.to_json(F.map_from_entries(F.transform("_e", lambda e: F.struct(e["k"], e["v"])))).alias("column_map_json"),
    )
    ready = fine.join(objects, ["group_key", "dst_schedule"])
    applied = ready.select("artifact_id", F.col("dst_schedule").alias("dst_fsname"), "logical_schedule_key", "pairs", "action", F.lit(dry_run).alias("dry_run"))
    warnings = parts.warnings.select(
        "row_no",
        F.concat(F.lit("Duplicate StateColumn "), F.col("state_column"), F.lit(": overwriting "), F.col("replaced"), F.lit(" → "), F.col("dst_column")).alias("message"),
    )
    if dry_run:
        return BulkImport(applied, errors, warnings, mappings)
    incoming = ready.select(
        F.lit(sc).alias("state_code"), F.col("logical_schedule_key").alias("state_logical_schedule_key"),
        F.col("dst_schedule").alias("dst_fsname"), "column_map_json", F.lit(updated_by).cast("string").alias("updated_by"),
        F.col("first_row").alias("row_no"),
    )
    nxt, _ = upsert_mappings(mappings, incoming, now, "row_no")
    return BulkImport(applied, errors, warnings, nxt)
