"""Finding JSON held in text columns and turning its members into columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F, types as T

from ratetally.functions.jsontext import flatten_json, has_nested_object, parse_json_cell, read_repeated_names
from ratetally.functions.text import strip

MIN_OBJECT_SHARE = 0.5
MAX_COLUMNS = 10_000


def text_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]


def json_columns(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """One row per text column: filled cells, cells that hold a JSON object, objects with an object inside,
    and whether the column is to be expanded (any nested object, or objects in at least half of the cells).

    One aggregation over all columns; nothing but the counts leaves the tasks.
    """
    read_repeated_names(df.sparkSession)
    names = list(columns) if columns is not None else text_columns(df)
    # Each object text is computed once below the aggregation rather than once per aggregate.
    parsed = df.select(
        *[F.col(f"`{c}`") for c in names],
        *[parse_json_cell(F.col(f"`{c}`")).alias(f"_obj_{i}") for i, c in enumerate(names)],
    )
    aggs = []
    for i, c in enumerate(names):
        obj = F.col(f"_obj_{i}")
        aggs.append(
            F.struct(
                F.lit(c).alias("column_name"),
                F.count_if(strip(F.col(f"`{c}`")) != "").alias("filled"),
                F.count(obj).alias("objects"),
                F.count_if(F.when(obj.isNotNull(), has_nested_object(obj)).otherwise(False)).alias("nested"),
            )
        )
    if not aggs:
        raise ValueError("There is no text column to look at.")
    one = parsed.agg(F.array(*aggs).alias("a")).select(F.inline("a"))
    expand = (F.col("nested") >= 1) | ((F.col("objects") >= 1) & (F.col("objects") >= F.col("filled") * MIN_OBJECT_SHARE))
    return one.withColumn("expand", expand)


def json_keys(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Distinct member names of the JSON objects in the given columns."""
    keys = F.concat(*[
        F.coalesce(F.json_object_keys(parse_json_cell(F.col(f"`{c}`"))), F.array().cast("array<string>")) for c in columns
    ])
    return df.select(F.explode(keys).alias("key")).distinct()


def expand_json(df: DataFrame, columns: Sequence[str] | None = None, keys: Sequence[str] | None = None) -> DataFrame:
    """Replace JSON columns by one text column per member name, in name order after the other columns.

    Columns and names are looked up in the data unless given. A member hides a plain column of the same
    name; of two JSON columns the later one wins where it has a value, and of a repeated member name the last
    member. Only names reach the driver.
    """
    read_repeated_names(df.sparkSession)
    if columns is None:
        columns = [r["column_name"] for r in json_columns(df).where("expand").collect()] if text_columns(df) else []
        columns = [c for c in df.columns if c in set(columns)]
    if not columns:
        return df
    if keys is None:
        keys = [r["key"] for r in json_keys(df, columns).limit(MAX_COLUMNS + 1).collect()]
        if len(keys) > MAX_COLUMNS:
            raise ValueError(f"More than {MAX_COLUMNS} member names; pass the wanted ones as keys.")
    keys = sorted(keys)
    plain = [c for c in df.columns if c not in columns and c not in keys]
    hidden = {c for c in df.columns if c not in columns and c in keys}
    flat = df.select(
        *[F.col(f"`{c}`") for c in df.columns if c not in columns],
        *[flatten_json(parse_json_cell(F.col(f"`{c}`"))).alias(f"_json_{i}") for i, c in enumerate(columns)],
    )
    sources = [F.col(f"_json_{i}") for i in reversed(range(len(columns)))]

    def member(k):
        values = [F.element_at(m, F.lit(k)) for m in sources]
        if k in hidden:
            values.append(F.col(f"`{k}`").cast("string"))
        return F.coalesce(*values).alias(k)

    return flat.select(*[F.col(f"`{c}`") for c in plain], *[member(k) for k in keys])
