"""Writers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F, types as T

from ratetally.operators.compare import Reconciliation


def flat_columns(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """The chosen columns, nested values as JSON text."""
    nested = (T.ArrayType, T.MapType, T.StructType)
    fields = {f.name: f.dataType for f in df.schema.fields}
    return df.select(*[
        F.to_json(F.col(f"`{c}`")).alias(c) if isinstance(fields[c], nested) else F.col(f"`{c}`") for c in columns or df.columns
    ])


def write_table(df: DataFrame, path: str, columns: Sequence[str] | None = None, fmt: str = "csv", mode: str = "overwrite") -> None:
    """Whole table as CSV with a header and doubled quotes, or as parquet."""
    if fmt == "csv":
        flat_columns(df, columns).write.mode(mode).csv(path, header=True, quote='"', escape='"', emptyValue="", lineSep="\n")
    elif fmt == "parquet":
        (df.select(*columns) if columns else df).write.mode(mode).parquet(path)
    else:
        raise ValueError(f"Unknown format {fmt!r}")


def export_bucket(result: Reconciliation, bucket: str) -> DataFrame:
    """Mapped cells of one bucket: ``modified`` and ``added`` under left names, ``right_only`` under right names."""
    status = {"modified": "mismatch", "added": "left_only", "right_only": "right_only"}[bucket]
    side = "right" if bucket == "right_only" else "left"
    cells = []
    for i, (l, r) in enumerate(result.pairs):
        cells.append(F.col("diffs")[i][f"{side}_value"].alias(r if side == "right" else l))
    return result.rows.where(F.col("status") == status).select(*cells)


def export_compare(result: Reconciliation, path: str, fmt: str = "csv") -> None:
    """Three folders below ``path``: modified, added, right_only."""
    for bucket in ("modified", "added", "right_only"):
        write_table(export_bucket(result, bucket), f"{path}/{bucket}", fmt=fmt)
