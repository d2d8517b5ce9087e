"""The rows behind a finding: violations, text search and paging."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablegauge.functions.columns import col
from tablegauge.functions.patterns import cells
from tablegauge.functions.scalars import mask_if
from tablegauge.operators.rules import prepare_rules
from tablegauge.operators.syntax import is_invalid, value_text

INVALID_VALUE = "__invalid_value"
DEFAULT_PAGE_SIZE, MAX_PAGE_SIZE = 50, 200


def missing_rows(df: DataFrame, column: str, null_patterns: dict | None = None) -> DataFrame:
    """Rows without a value in a column."""
    _require(df, column)
    return df.where(cells(df, null_patterns, [column])[column].isNull())


def format_violations(df: DataFrame, column: str, pattern: str) -> DataFrame:
    """Rows whose value breaks a format, with the offending text."""
    _require(df, column)
    return df.where(is_invalid(df, column, pattern)).withColumn(INVALID_VALUE, value_text(df, column))


def rule_violations(df: DataFrame, rule: dict) -> DataFrame:
    """Rows that break a rule."""
    prepared = prepare_rules(df, [rule])
    if not prepared or prepared[0].violates is None:
        reason = prepared[0].error or "forbidden word" if prepared else "empty rule"
        raise ValueError(f"rule cannot be evaluated: {reason}")
    return df.where(prepared[0].violates)


def search(df: DataFrame, text: str, regex: bool = False) -> DataFrame:
    """Rows where any data column holds the text, whatever its case."""
    wanted = text.strip()
    if not wanted:
        return df
    names = [c for c in df.columns if not c.startswith("__")]
    texts = [col(c).cast("string") for c in names]
    # a pattern stays as it is: in lower case \D would mean \d
    hits = [t.rlike(f"(?i){wanted}") if regex else F.lower(t).contains(wanted.lower()) for t in texts]
    return df.where(reduce(lambda a, b: a | b, [F.coalesce(h, F.lit(False)) for h in hits]))


def _follows(order: list[str], after: list) -> Column:
    """Rows that come after the given order values."""
    later, same = F.lit(False), F.lit(True)
    for name, value in zip(order, after, strict=True):
        down, name = name.startswith("-"), name.removeprefix("-")
        if value is None:
            beyond = F.lit(False) if down else col(name).isNotNull()
        elif down:
            beyond = (col(name) < F.lit(value)) | col(name).isNull()
        else:
            beyond = col(name) > F.lit(value)
        later = later | (same & F.coalesce(beyond, F.lit(False)))
        same = same & col(name).eqNullSafe(F.lit(value))
    return later


def page(
    df: DataFrame,
    order: list[str],
    number: int = 1,
    size: int = DEFAULT_PAGE_SIZE,
    sensitive: list[str] | None = None,
    after: list | None = None,
) -> DataFrame:
    """One page of rows in `order`, sensitive values masked; a name after a minus sign goes backwards.

    Nulls come first going up and last going down. Spark keeps page number x size rows per task for a numbered page. To walk deep into a large
    result, pass the last page's order values as `after`: only `size` rows are kept then.
    """
    number, size = max(1, number), min(max(1, size), MAX_PAGE_SIZE)
    if after is not None:
        df = df.where(_follows(order, after))
        number = 1
    rows = df.orderBy(*[col(c[1:]).desc() if c.startswith("-") else col(c) for c in order]).offset((number - 1) * size).limit(size)
    return rows.select(*[mask_if(col(c), c, sensitive).alias(c) for c in df.columns])


def page_info(df: DataFrame, number: int = 1, size: int = DEFAULT_PAGE_SIZE) -> DataFrame:
    """One row: total rows, pages, and whether there is a page before and after this one."""
    number, size = max(1, number), min(max(1, size), MAX_PAGE_SIZE)
    pages = F.greatest(F.lit(1).cast("bigint"), F.ceil(F.col("total") / size))
    return df.agg(F.count(F.lit(1)).alias("total")).select(
        F.lit(number).alias("page"),
        F.lit(size).alias("per_page"),
        "total",
        pages.alias("total_pages"),
        (F.lit(number) < pages).alias("has_next"),
        F.lit(number > 1).alias("has_prev"),
    )


def violations(
    df: DataFrame,
    check: dict,
    order: list[str],
    text: str = "",
    number: int = 1,
    size: int = DEFAULT_PAGE_SIZE,
    sensitive: list[str] | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(page of violating rows, page info) for a check {metric, column, pattern, rule}."""
    metric = check.get("metric")
    if metric == "completeness":
        rows = missing_rows(df, check["column"], check.get("null_patterns"))
    elif metric == "syntactic_accuracy":
        rows = format_violations(df, check["column"], check["pattern"])
        if check["column"] in (sensitive or []):
            sensitive = [*sensitive, INVALID_VALUE]
    elif metric == "logical_consistency":
        rows = rule_violations(df, check["rule"])
    else:
        raise ValueError(f"no drill-down for metric: {metric}")
    rows = search(rows, text)
    return page(rows, order, number, size, sensitive), page_info(rows, number, size)


def _require(df: DataFrame, column: str) -> None:
    if column not in df.columns:
        raise ValueError(f"no such column: {column}")
