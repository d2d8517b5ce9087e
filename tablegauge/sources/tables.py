"""Listing a table's columns and showing its first rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablegauge.functions.columns import col, kinds, value_of
from tablegauge.functions.scalars import mask_if
from tablegauge.operators.column_stats import column_stats, storage_type

PREVIEW_ROWS = 100


def schema_listing(df: DataFrame) -> DataFrame:
    """(position, name, type, nullable): nullable means a cell is missing, not that one may be."""
    types = F.create_map(*[F.lit(x) for c in df.columns for x in (c, storage_type(df, c))])
    return column_stats(df).select(
        "position",
        F.col("column_name").alias("name"),
        F.element_at(types, F.col("column_name")).alias("type"),
        (F.col("n_missing") > 0).alias("nullable"),
    )


def preview(
    df: DataFrame, order: list[str], sensitive: list[str] | None = None, rows: int = PREVIEW_ROWS
) -> DataFrame:
    """The first rows in `order`, NaN as null and sensitive values masked."""
    by_kind = kinds(df)
    shown = [mask_if(value_of(c, by_kind[c]), c, sensitive).alias(c) for c in df.columns]
    return df.orderBy(*[col(c) for c in order]).limit(rows).select(*shown)
