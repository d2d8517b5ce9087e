"""Stable issue fingerprints: a short SHA-256 over what an issue is about, not its numbers."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FINGERPRINT_LENGTH = 16
ROWS_IN_FINGERPRINT = 10
_WHITESPACE = " \t\n\r\f\x0b"


def _text(value: Any) -> Column:
    """One part of the hashed text: trimmed and lower-cased, empty when missing."""
    if isinstance(value, Column):
        trimmed = F.btrim(value.cast("string"), F.lit(_WHITESPACE))
        return F.coalesce(F.lower(trimmed), F.lit(""))
    if value is None:
        return F.lit("")
    if isinstance(value, (list, tuple)):
        return F.lit(",".join(sorted(str(item).lower().strip() for item in value)))
    if isinstance(value, dict):
        return F.lit(",".join(f"{key}:{value[key]}" for key in sorted(value)))
    return F.lit(str(value).lower().strip())


def fingerprint(
    issue_type: Any,
    column_name: Any = None,
    row: Any = None,
    rule: Any = None,
    params: dict[str, Any] | None = None,
) -> Column:
    """First 16 hex digits of the SHA-256 of `type|column|row|rule|key=value|...`."""
    parts = [_text(issue_type), _text(column_name), _text(row), _text(rule)]
    for key in sorted(params or {}):
        parts.append(F.concat(_text(key), F.lit("="), _text(params[key])))
    digest = F.sha2(F.concat_ws("|", *parts), 256)
    return F.substring(digest, 1, FINGERPRINT_LENGTH)


def column_fingerprint(issue_type: str, column_name: Any, threshold: float | None = None) -> Column:
    params = None if threshold is None else {"threshold": round(threshold, 4)}
    return fingerprint(issue_type, column_name, rule=f"{issue_type}_column_check", params=params)


def pattern_fingerprint(column_name: Any, pattern: Any) -> Column:
    return fingerprint(
        "consistency_pattern", column_name, rule="pattern_check", params={"pattern": pattern}
    )


def duplicate_rows_fingerprint() -> Column:
    return fingerprint("uniqueness", rule="row_duplicate_check")


def duplicate_values_fingerprint(column_name: Any) -> Column:
    return fingerprint("uniqueness", column_name, rule="column_duplicate_check")


def variability_fingerprint(column_name: Any, threshold: Any) -> Column:
    return fingerprint(
        "low_variability", column_name, rule="adaptive_threshold", params={"threshold": threshold}
    )


def expected_unique_fingerprint(column_name: Any, threshold: Any) -> Column:
    return fingerprint(
        "non_unique_identifier",
        column_name,
        rule="expected_unique",
        params={"threshold": threshold},
    )


def syntactic_fingerprint(column_name: Any, expected_type: Any, pattern: Any = None) -> Column:
    params = {"expected_type": expected_type}
    if pattern is not None:
        params["pattern"] = pattern
    return fingerprint(
        "syntactic_accuracy", column_name, rule="type_conformance_check", params=params
    )


def rule_fingerprint(expression: Any) -> Column:
    return fingerprint(
        "logical_consistency", rule="cross_field_check", params={"expression": expression}
    )


def balance_fingerprint(column_name: Any, imbalance: str, class_name: Any = None) -> Column:
    params = None if class_name is None else {"class_name": class_name}
    return fingerprint("class_balance", column_name, rule=f"balance_{imbalance}", params=params)


def staleness_fingerprint(column_name: Any, threshold_days: int) -> Column:
    return fingerprint(
        "currentness", column_name, rule="staleness_check", params={"threshold_days": threshold_days}
    )


def parse_rate_fingerprint(column_name: Any) -> Column:
    return fingerprint("currentness", column_name, rule="parse_quality_check")


def diversity_fingerprint(column_name: Any, finding: str, expected_value: Any = None) -> Column:
    params = {"diversity_type": finding}
    if expected_value is not None:
        params["expected_value"] = expected_value
    return fingerprint("diversity", column_name, rule=f"diversity_{finding}", params=params)


def outlier_fingerprint(column_name: Any, method: str, factor: float) -> Column:
    return fingerprint(
        "outliers",
        column_name,
        rule=f"outlier_{method}_check",
        params={"method": method, "factor": round(factor, 2)},
    )


def numeric_code_fingerprint(column_name: Any) -> Column:
    return fingerprint("consistency", column_name, rule="categorical_as_numeric")


def row_fingerprints(
    violations: DataFrame, issue_type: str, group: str, row_id: str
) -> DataFrame:
    """One fingerprint per group of offending rows: its ten smallest ids and, beyond ten, how many.

    The window filter keeps ten rows per group inside each task before anything is shuffled, so
    a group of any size reaches the last step as ten ids and one count.
    """
    smallest = (
        violations.select(group, row_id)
        .withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(row_id)))
        .where(F.col("rank") <= ROWS_IN_FINGERPRINT)
        .groupBy(group)
        .agg(F.sort_array(F.collect_list(row_id)).alias("ids"))
    )
    totals = violations.groupBy(group).agg(F.count(F.lit(1)).alias("total_rows"))
    row = F.array_join(F.transform("ids", lambda i: i.cast("string")), ",")
    rule = f"{issue_type}_row_check"
    short = fingerprint(issue_type, F.col(group), row, rule)
    long = fingerprint(issue_type, F.col(group), row, rule, {"total_rows": F.col("total_rows")})
    return totals.join(smallest, group).select(
        group,
        "total_rows",
        F.when(F.col("total_rows") > ROWS_IN_FINGERPRINT, long).otherwise(short).alias("fingerprint"),
    )
