"""Removing repeats and putting tables together."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ratetally.functions.text import strip, text
from ratetally.operators.spread import first_per_group


def row_signature(cells: Column, links: Column | None = None) -> Column:
    """Hash of the cells of a MAP row and of its link URLs, whatever their order."""
    parts = [F.to_json(F.array_sort(F.map_entries(cells)))]
    if links is not None:
        parts.append(F.to_json(F.array_sort(F.transform(links, lambda l: text(l["url"])))))
    return F.sha2(F.concat_ws("\x1f", *parts), 256)


def dedupe_rows(rows: DataFrame, scope: Sequence[str], order: Sequence[Column], links: str | None = "links") -> DataFrame:
    """Rows with the same cells and links are kept once per scope, where they come first."""
    sig = row_signature(F.col("cells"), F.col(links) if links else None)
    return first_per_group(rows.withColumn("_sig", sig), [*scope, "_sig"], order).drop("_sig")


def dedupe_by_id(rows: DataFrame, id_column: str, order: Sequence[Column], scope: Sequence[str] = ()) -> DataFrame:
    """First row per id; rows without an id are all kept and take no part in the shuffle."""
    named = rows.where(strip(F.col(id_column)) != "")
    return first_per_group(named, [*scope, id_column], order).unionByName(rows.where(strip(F.col(id_column)) == ""))


def dedupe_tables(tables: DataFrame, scope: Sequence[str], fingerprint: str, order: Sequence[Column]) -> DataFrame:
    """First table per fingerprint; tables with an empty fingerprint are all kept."""
    return dedupe_by_id(tables, fingerprint, order, scope)


def table_fingerprint(first_row: Column) -> Column:
    """All cells of the first row."""
    return F.array_join(F.transform(first_row, strip), "|")


def union_tables(tables: Sequence[DataFrame], placeholder: DataFrame | None = None) -> DataFrame:
    """Union by column name, missing columns null. Rows of ``placeholder`` count only when there are no others."""
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    if placeholder is None:
        return out
    none = out.agg(F.count(F.lit(1)) == 0).scalar()
    return out.unionByName(placeholder.where(none), allowMissingColumns=True)
