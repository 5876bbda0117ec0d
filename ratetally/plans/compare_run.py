"""Compare one stored file with one warehouse table through its saved mapping."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from ratetally.functions.names import parse_mapping, validate_table_name
from ratetally.operators.compare import Reconciliation, reconcile
from ratetally.operators.jsoncols import expand_json
from ratetally.operators.versions import schedule_key, state_key
from ratetally.sources.tables import clean_table


def saved_mapping(artifacts: DataFrame, mappings: DataFrame, state: str, artifact_id: int, table: str) -> dict[str, str]:
    """Mapping saved for a file and a table. Fails when the file, its state or the mapping does not fit."""
    sc = state.strip().upper()
    if not sc:
        raise ValueError("state_code is required")
    validate_table_name(table)
    found = artifacts.where(F.col("artifact_id") == artifact_id).select(
        state_key(F.col("state_code")).alias("sc"), schedule_key(F.col("logical_schedule_key"), F.col("artifact_id")).alias("key")
    ).first()
    if found is None:
        raise ValueError("Artifact not found")
    if found["sc"] and found["sc"] != sc:
        raise ValueError("Artifact state_code does not match the requested state")
    saved = mappings.where(
        (F.col("state_code") == sc) & (F.col("state_logical_schedule_key") == found["key"]) & (F.col("dst_fsname") == table)
    ).orderBy(F.coalesce("updated_at_utc", "created_at_utc").desc()).first()
    if saved is None:
        raise ValueError(f"No column mapping found for this file and table {table}.")
    mapping = parse_mapping(saved["column_map_json"])
    if not mapping:
        raise ValueError("The saved mapping is empty.")
    return mapping


def compare_run(
    published: DataFrame, warehouse: DataFrame, artifacts: DataFrame, mappings: DataFrame, *,
    state: str, artifact_id: int, table: str, right_order: Sequence[str], **options,
) -> Reconciliation:
    """Look up the mapping, flatten the warehouse side and reconcile the two tables."""
    mapping = saved_mapping(artifacts, mappings, state, artifact_id, table)
    right = expand_json(clean_table(warehouse, state, drop=("state_code",)))
    return reconcile(published, right, mapping, right_order=right_order, **options)
