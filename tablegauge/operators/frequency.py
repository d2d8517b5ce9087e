"""Value and row frequencies: the counts most checks are derived from."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablegauge.functions.columns import col, kinds, present, sql_text, value_sql
from tablegauge.functions.scalars import float_text


def text_key_sql(value: str) -> str:
    """The SHA-256 of a text, whatever its length: keys move through a shuffle at bounded width."""
    return f"sha2({value}, 256)"


def unpivoted(
    df: DataFrame, columns: list[str], data_type: str, digested: set[str] = frozenset()
) -> DataFrame:
    """The named columns as (column_no, value) rows of one type, missing cells dropped.

    The number keeps grouping keys short; `with_names` turns it into the name after grouping.
    """
    by_kind = kinds(df)
    cells = [
        f"struct({i} AS column_no, {_in_type(c, by_kind[c], data_type, c in digested)} AS value)"
        for i, c in enumerate(columns)
    ]
    return df.selectExpr(f"inline(array({', '.join(cells)}))").where(F.col("value").isNotNull())


def with_names(rows: DataFrame, columns: list[str]) -> DataFrame:
    """`column_no` replaced by `column_name`."""
    names = F.expr(f"element_at(array({', '.join(sql_text(c) for c in columns)}), column_no + 1)")
    others = [F.col(c) for c in rows.columns if c != "column_no"]
    return rows.select(names.alias("column_name"), *others)


def with_numbers(rows: DataFrame, columns: list[str]) -> DataFrame:
    """`column_no` beside `column_name`."""
    names = f"array({', '.join(sql_text(c) for c in columns)})"
    return rows.withColumn("column_no", F.expr(f"int(array_position({names}, column_name)) - 1"))


def _in_type(name: str, kind: str, data_type: str, digested: bool) -> str:
    value = f"CAST({value_sql(name, kind)} AS {data_type})"
    if kind == "boolean" and data_type == "string":
        # Truth values read True and False, the way class names are written in a configuration.
        return f"initcap({value})"
    return text_key_sql(value) if kind == "string" and digested else value


def value_frequency(
    df: DataFrame, columns: list[str] | None = None, whole_text: list[str] | None = None
) -> DataFrame:
    """(column_name, value, number, cnt): every distinct value of every column with its count.

    `whole_text` names the columns whose values will be shown; the texts of other columns are only
    told apart, by their digest. All texts are kept whole when it is not given.

    Columns are unpivoted in their own storage type, so distinct values are counted natively and
    only they, not the rows, are turned into text. Each type group reads only its own columns.
    The counts combine inside each task first, so a frequent value costs no more than a rare one.
    """
    by_kind = kinds(df)
    names = [c for c in present(df, columns) if by_kind[c] != "nested"]
    groups: dict[str, list[str]] = {}
    for name in names:
        native = {"integer": "bigint", "fraction": "double", "time": df.schema[name].dataType.simpleString()}
        groups.setdefault(native.get(by_kind[name], "string"), []).append(name)
    decimals = [c for c in names if by_kind[c] == "decimal"]
    digested = set() if whole_text is None else set(names) - set(whole_text)
    parts = []
    for data_type, members in groups.items():
        counted = with_names(
            unpivoted(df, members, data_type, digested)
            .groupBy("column_no", "value")
            .agg(F.count(F.lit(1)).alias("cnt")),
            members,
        )
        value = F.col("value")
        if data_type == "double":
            text, number = float_text(value), value
        elif data_type == "bigint":
            text, number = value.cast("string"), value.cast("double")
        elif data_type != "string":
            text, number = value.cast("string"), F.lit(None).cast("double")
        else:
            text = value
            number = F.when(F.col("column_name").isin(*decimals), value.try_cast("double"))
            if not decimals:
                number = F.lit(None).cast("double")
        parts.append(
            counted.select("column_name", text.alias("value"), number.alias("number"), "cnt")
        )
    if not parts:
        empty = "column_name string, value string, number double, cnt bigint"
        return df.sparkSession.createDataFrame([], empty)
    return reduce(DataFrame.unionByName, parts)


def distinct_counts(frequency: DataFrame) -> DataFrame:
    """(column_name, n_unique, n_values) from a value frequency."""
    return frequency.groupBy("column_name").agg(
        F.count(F.lit(1)).alias("n_unique"), F.sum("cnt").alias("n_values")
    )


def complete_distinct_counts(frequency: DataFrame, stats: DataFrame) -> DataFrame:
    """Column stats with `n_unique`, zero for a column that holds no value at all."""
    counts = distinct_counts(frequency).select("column_name", "n_unique")
    return stats.join(F.broadcast(counts), "column_name", "left").withColumn(
        "n_unique", F.coalesce("n_unique", F.lit(0).cast("bigint"))
    )


def top_values(frequency: DataFrame, k: int) -> DataFrame:
    """The k most frequent values of each column, ties by value, with their rank.

    `row_number() <= k` lets Spark keep k rows per column inside each task before the shuffle.
    """
    order = Window.partitionBy("column_name").orderBy(F.col("cnt").desc(), F.col("value"))
    return frequency.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def row_key(df: DataFrame, columns: list[str] | None = None) -> list[Column]:
    """Grouping columns that stand for a whole row, texts by their digest."""
    by_kind = kinds(df)
    keys = []
    for name in present(df, columns):
        value = value_sql(name, by_kind[name])
        key = text_key_sql(value) if by_kind[name] == "string" else value
        keys.append(F.expr(key).alias(name))
    return keys


def row_frequency(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Every distinct row with its count; nulls are equal to each other."""
    keys = row_key(df, columns)
    names = present(df, columns)
    return df.select(*keys).groupBy(*[col(n) for n in names]).agg(F.count(F.lit(1)).alias("cnt"))


def duplicate_totals(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """One row: rows, distinct rows, surplus rows, rows in duplicate groups, such groups, missing cells."""
    names = present(df, columns)
    missing = sum((F.col("r." + f"`{n}`").isNull().cast("bigint") for n in names), F.lit(0))
    repeated = F.col("cnt") > 1
    return (
        row_frequency(df, columns)
        .alias("r")
        .agg(
            F.coalesce(F.sum("cnt"), F.lit(0)).cast("bigint").alias("n_rows"),
            F.count(F.lit(1)).alias("n_distinct"),
            F.coalesce(F.sum(F.col("cnt") - 1), F.lit(0)).cast("bigint").alias("n_surplus"),
            F.coalesce(F.sum(F.when(repeated, F.col("cnt"))), F.lit(0))
            .cast("bigint")
            .alias("n_in_groups"),
            F.count_if(repeated).alias("n_groups"),
            F.coalesce(F.sum(F.col("cnt") * missing), F.lit(0)).cast("bigint").alias("n_missing"),
        )
    )
