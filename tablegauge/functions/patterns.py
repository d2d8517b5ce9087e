"""Regex predicates: named value formats, null patterns, and pattern resolution."""

from __future__ import annotations

import re

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tablegauge.functions.columns import col, kinds, present, value_of

# The named formats a text value can be checked against.
VALUE_FORMATS = {
    "email": r"^[a-zA-Z0-9._%+\-]+@[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,}$",
    "url": r"^https?://[^\s]+$",
    "phone_es": r"^(\+34)?[6-9]\d{8}$",
    "phone_intl": r"^\+?\d{1,4}[\s\-]?\(?\d{1,4}\)?[\s\-]?\d{4,14}$",
    "dni_es": r"^\d{8}[A-Za-z]$",
    "date_iso": r"^\d{4}-\d{2}-\d{2}$",
    "date_eu": r"^\d{2}/\d{2}/\d{4}$",
    "integer": r"^-?\d+$",
    "decimal": r"^-?\d+[.,]?\d*$",
    "uuid": r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",
    "ip_v4": r"^(?:(?:25[0-5]|2[0-4]\d|[01]?\d\d?)\.){3}(?:25[0-5]|2[0-4]\d|[01]?\d\d?)$",
    "postal_code_es": r"^\d{5}$",
    "credit_card": r"^\d{4}[\s\-]?\d{4}[\s\-]?\d{4}[\s\-]?\d{4}$",
}

# Preset texts that stand for a missing value.
NULL_PRESETS = {
    "empty_string": r"^$",
    "null_word": r"^null$",
    "na": r"^n/?a$",
    "nan": r"^nan$",
    "none": r"^none$",
    "dash": r"^[-–—]$",
    "whitespace_only": r"^\s+$",
}


def anchored(pattern: str, ignore_case: bool = False) -> str:
    """A pattern tried at the start of the text, with Unicode character classes."""
    named = re.sub(r"\(\?P<([A-Za-z0-9_]+)>", r"(?<\1>", pattern)
    named = re.sub(r"\(\?P=([A-Za-z0-9_]+)\)", r"\\k<\1>", named)
    flags = "(?Ui)" if ignore_case else "(?U)"
    return f"{flags}^(?:{named})"


def matches(text: Column, pattern: str) -> Column:
    return text.rlike(anchored(pattern))


def is_valid_pattern(spark: SparkSession, pattern: str) -> bool:
    """Whether the pattern compiles, tried on one constant."""
    try:
        spark.sql("SELECT '' RLIKE :p AS ok", args={"p": anchored(pattern)}).collect()
        return True
    except PySparkException:
        return False


def null_pattern(null_patterns: dict | None) -> str | None:
    """Presets and custom patterns as one alternation; unknown presets are left out."""
    if not null_patterns:
        return None
    parts = [NULL_PRESETS[p] for p in null_patterns.get("presets") or [] if p in NULL_PRESETS]
    parts += list(null_patterns.get("custom") or [])
    return "|".join(f"(?:{part})" for part in parts) if parts else None


def cells(
    df: DataFrame, null_patterns: dict | None = None, columns: list[str] | None = None
) -> dict[str, Column]:
    """Each column's value with NaN and null-like text read as null; other types as they are."""
    pattern = null_pattern(null_patterns)
    if pattern is not None and not is_valid_pattern(df.sparkSession, pattern):
        pattern = None
    by_kind = kinds(df)
    out = {}
    for name in present(df, columns):
        value = value_of(name, by_kind[name])
        if pattern is not None and by_kind[name] == "string":
            value = F.when(~value.rlike(anchored(pattern, ignore_case=True)), value)
        out[name] = value
    return out


def apply_null_patterns(
    df: DataFrame, null_patterns: dict | None, columns: list[str] | None = None
) -> DataFrame:
    """The table with null-like text of the chosen columns set to null, in one projection."""
    if null_pattern(null_patterns) is None:
        return df
    cleaned = cells(df, null_patterns, columns)
    return df.select(*[cleaned.get(c, col(c)).alias(c) for c in df.columns])


def resolve_patterns(patterns: DataFrame, owner_id: int | None) -> DataFrame:
    """System patterns plus the owner's; the owner's regex wins on a shared key."""
    visible = patterns.where(F.col("owner_id").isNull() | (F.col("owner_id") == F.lit(owner_id)))
    own_first = Window.partitionBy("key").orderBy(F.col("owner_id").isNull(), F.col("regex"))
    return (
        visible.withColumn("rank", F.row_number().over(own_first))
        .where("rank = 1")
        .select("key", "regex")
    )


def named_formats(patterns: DataFrame | None, owner_id: int | None) -> dict[str, str]:
    """The formats a run can name: the built-in ones, overridden by stored patterns.

    The pattern table is configuration, entered by hand, so reading it is a small collect.
    """
    formats = dict(VALUE_FORMATS)
    if patterns is not None:
        for row in resolve_patterns(patterns, owner_id).collect():
            formats[row["key"]] = row["regex"]
    return formats
