"""Warehouse tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from ratetally.functions.names import resolve_column, validate_table_name

# Technical columns that are not part of a warehouse row.
TECHNICAL_COLUMNS = ["dst_row_id", "row_id", "state_code", "inserted_at"]


def clean_table(df: DataFrame, state: str | None = None, limit: int | None = None, drop: Sequence[str] = TECHNICAL_COLUMNS, state_column: str = "state_code") -> DataFrame:
    """Rows of one state without technical columns. Without a state column all rows are kept."""
    col = resolve_column(df.columns, state_column)
    if state and state.strip() and col:
        df = df.where(F.col(f"`{col}`") == state.strip().upper())
    if limit is not None:
        df = df.limit(limit)
    hidden = {d.lower() for d in drop}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in hidden])


def scan_table(spark: SparkSession, name: str, state: str | None = None, limit: int | None = None, jdbc: Mapping[str, str] | None = None, **kw) -> DataFrame:
    """A catalog table, or a JDBC table when connection options are given. The state filter is pushed to the source."""
    validate_table_name(name)
    reader = spark.read.format("jdbc").options(**jdbc).option("dbtable", name).load() if jdbc else spark.read.table(name)
    return clean_table(reader, state, limit, **kw)


def tables_with_rows(tables: Mapping[str, DataFrame], column: str, value: str) -> DataFrame:
    """(table_name) of the tables that have the column and at least one row with the value.

    Every table is one pushed-down probe that stops at its first hit.
    """
    probes = []
    for name, df in sorted(tables.items()):
        col = resolve_column(df.columns, column)
        if col:
            hit = F.col(f"`{col}`") == F.lit(value)
            probes.append(df.where(hit).limit(1).select(F.lit(name).alias("table_name")))
    if not probes:
        raise ValueError(f"No table has a column {column!r}.")
    out = probes[0]
    for p in probes[1:]:
        out = out.unionAll(p)
    return out


def list_tables(spark: SparkSession, column: str | None = None, value: str | None = None) -> DataFrame:
    """Tables of the current database, or those with a row whose ``column`` is ``value``."""
    names = sorted(t.name for t in spark.catalog.listTables())
    if column is None:
        return spark.createDataFrame([(n,) for n in names], "table_name string")
    return tables_with_rows({n: spark.read.table(n) for n in names}, column, value or "")
