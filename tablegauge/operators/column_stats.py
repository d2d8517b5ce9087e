"""Per-column aggregates of a table in one scan, laid out one row per column."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablegauge.functions.columns import (
    is_numeric_kind,
    kinds,
    present,
    sql_name,
    sql_text,
    value_sql,
)

# Measures are SQL aggregates: {v} stands for a cell's value and {x} for it as a double. One that
# uses {x} is null for a column that is not numeric.
NULLS = {"n_valid": "count({v})"}
CENTRE = {"min": "min({x})", "max": "max({x})", "mean": "avg({x})"}
MOMENTS = {**CENTRE, "std": "stddev_samp({x})"}


def _applies(template: str, kind: str) -> bool:
    return "{x}" not in template or is_numeric_kind(kind)


def wide_aggregates(
    columns: list[str], by_kind: dict[str, str], measures: dict[str, str]
) -> list[Column]:
    """One aggregate expression per column and measure, for a single `df.agg`."""
    out = []
    for position, name in enumerate(columns):
        value = value_sql(name, by_kind[name])
        for measure, template in measures.items():
            if _applies(template, by_kind[name]):
                aggregate = template.replace("{v}", value).replace("{x}", f"double({value})")
                out.append(F.expr(aggregate).alias(f"{measure}__{position}"))
    return out


def to_long(
    wide: DataFrame,
    columns: list[str],
    by_kind: dict[str, str],
    measures: dict[str, str],
    shared: list[str] = (),
) -> DataFrame:
    """Turn the one aggregated row into one row per column, `shared` fields repeated."""
    rows = []
    for position, name in enumerate(columns):
        fields = [
            f"{sql_text(name)} AS column_name",
            f"{sql_text(by_kind[name])} AS kind",
            f"{position} AS position",
            *[f"{sql_name(s)} AS {sql_name(s)}" for s in shared],
        ]
        for measure, template in measures.items():
            known = _applies(template, by_kind[name])
            fields.append(f"{f'{measure}__{position}' if known else 'double(NULL)'} AS {measure}")
        rows.append(f"struct({', '.join(fields)})")
    return wide.selectExpr(f"inline(array({', '.join(rows)}))")


def row_count() -> Column:
    return F.count(F.lit(1)).alias("n_rows")


def column_stats(
    df: DataFrame, columns: list[str] | None = None, measures: dict[str, str] | None = None
) -> DataFrame:
    """One row per column: counts of rows, valid and missing cells, and the asked measures."""
    names = present(df, columns)
    by_kind = kinds(df)
    wanted = {**NULLS, **(measures or {})}
    wide = df.agg(row_count(), *wide_aggregates(names, by_kind, wanted))
    return with_missing(to_long(wide, names, by_kind, wanted, ["n_rows"]))


def with_missing(long: DataFrame) -> DataFrame:
    return long.withColumn("n_missing", F.col("n_rows") - F.col("n_valid")).withColumn(
        "completeness", 1 - F.try_divide(F.col("n_missing"), F.col("n_rows"))
    )


def shape(df: DataFrame, columns: list[str], stats: DataFrame) -> DataFrame:
    """(column_name, std, skewness, kurtosis) from sums of powers around the means in `stats`.

    A second scan with plain sums stays small enough to compile well for many columns, where one
    scan with Spark's moment aggregates does not, and centred sums lose no digits. Skewness and
    kurtosis are bias-corrected: null below three and four values, 0 for a constant column.
    """
    by_kind = kinds(df)
    means = {row["column_name"]: row["mean"] for row in stats.select("column_name", "mean").collect()}
    sums = []
    for i, name in enumerate(columns):
        mean = means.get(name)
        gap = f"(double({value_sql(name, by_kind[name])}) - double('{mean if mean is not None else 0.0!r}'))"
        for power in (2, 3, 4):
            sums.append(F.expr(f"sum({' * '.join([gap] * power)})").alias(f"m{power}__{i}"))
    rows = [
        f"struct({sql_text(name)} AS column_name, "
        + ", ".join(f"m{power}__{i} AS m{power}" for power in (2, 3, 4))
        + ")"
        for i, name in enumerate(columns)
    ]
    long = df.agg(*sums).selectExpr(f"inline(array({', '.join(rows)}))")
    n = F.col("n_valid").cast("double")
    m2, m3, m4 = (F.col(f"m{power}") / n for power in (2, 3, 4))
    skewness = m3 / F.pow(m2, 1.5) * F.sqrt(n * (n - 1)) / (n - 2)
    kurtosis = (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * (m4 / (m2 * m2) - 3) + 6)
    return long.join(F.broadcast(stats.select("column_name", "n_valid")), "column_name").select(
        "column_name",
        F.when(n > 1, F.sqrt(F.col("m2") / (n - 1))).alias("std"),
        F.when(n < 3, None).when(m2 == 0, 0.0).otherwise(skewness).alias("skewness"),
        F.when(n < 4, None).when(m2 == 0, 0.0).otherwise(kurtosis).alias("kurtosis"),
    )


def moment_shape(n: int, s2: float | None, s3: float | None, s4: float | None) -> tuple[float | None, ...]:
    """Deviation, skewness and kurtosis as `shape` gives them, from sums of powers around the mean."""
    if not n or s2 is None:
        return None, None, None
    m2, m3, m4 = s2 / n, s3 / n, s4 / n
    std = math.sqrt(s2 / (n - 1)) if n > 1 else None
    skewness = None if n < 3 else m3 / m2**1.5 * math.sqrt(n * (n - 1)) / (n - 2) if m2 else 0.0
    kurtosis = None if n < 4 else (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * (m4 / (m2 * m2) - 3) + 6) if m2 else 0.0
    return std, skewness, kurtosis


def storage_type(df: DataFrame, name: str) -> str:
    return df.schema[name].dataType.simpleString()
