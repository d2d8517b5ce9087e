"""Syntactic accuracy: do text values follow the format their column should have."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablegauge.functions.columns import kinds, number_of, string_columns, value_of
from tablegauge.functions.fingerprints import syntactic_fingerprint
from tablegauge.functions.patterns import VALUE_FORMATS, is_valid_pattern, matches, named_formats
from tablegauge.functions.scalars import integral_text, mask_where, percent_text
from tablegauge.functions.severity import severity
from tablegauge.operators.findings import (
    SAMPLE_ROWS,
    Metric,
    MetricFrames,
    details,
    first_rows_per_group,
    issues_of,
    order_columns,
    ordered_sample,
    score_frame,
)
from tablegauge.session import local_rows

DEFAULT_THRESHOLD = 0.95
# Fixed value: share of values a format must match to be taken as a column's own.
DETECT_MIN_MATCH = 0.85

CHECK_SCHEMA = "column_name string, expected_type string, pattern string, n_checked bigint, n_conforming bigint"


def value_text(df: DataFrame, name: str) -> Column:
    """The text a format is checked against; whole numbers carry no decimal point."""
    kind = kinds(df)[name]
    if kind == "fraction":
        return integral_text(number_of(name, kind))
    return value_of(name, kind).cast("string")


def is_invalid(df: DataFrame, name: str, pattern: str) -> Column:
    text = value_text(df, name)
    return text.isNotNull() & ~matches(text, pattern)


class SyntacticAccuracy(Metric):
    """params: columns [{column, expected_type, pattern}], custom_patterns, auto_detect_types, threshold."""

    metric_id = "syntactic_accuracy"

    def configured(self, df, params, context) -> list[tuple[str, str, str]]:
        """(column, type, pattern) named by the caller; a pattern that does not compile is left out."""
        formats = named_formats(context.patterns, context.owner_id)
        checks: dict[str, tuple[str, str]] = {}
        for entry in params.get("columns") or []:
            if not isinstance(entry, dict) or entry.get("column") not in df.columns:
                continue
            if entry.get("pattern"):
                checks[entry["column"]] = (entry.get("expected_type") or "custom", entry["pattern"])
            elif entry.get("expected_type") in formats:
                checks[entry["column"]] = (entry["expected_type"], formats[entry["expected_type"]])
        for name, pattern in (params.get("custom_patterns") or {}).items():
            if name in df.columns:
                checks.setdefault(name, ("custom", pattern))
        return [(name, kind, pattern) for name, (kind, pattern) in checks.items()]

    def detectable(self, df, params, context) -> list[str]:
        if not params.get("auto_detect_types", True):
            return []
        taken = {name for name, _, _ in self.configured(df, params, context)}
        return [c for c in string_columns(df) if c not in taken]

    def aggregates(self, df, params, context):
        out = []
        for i, (name, _, pattern) in enumerate(self.configured(df, params, context)):
            if not is_valid_pattern(df.sparkSession, pattern):
                continue
            text = value_text(df, name)
            out += [
                F.count(text).alias(f"syntax_n__{i}"),
                F.count_if(matches(text, pattern)).alias(f"syntax_ok__{i}"),
            ]
        for j, name in enumerate(self.detectable(df, params, context)):
            text = value_of(name, "string")
            out.append(F.count(text).alias(f"detect_n__{j}"))
            out += [
                F.count_if(matches(text, pattern)).alias(f"detect_ok__{j}__{k}")
                for k, pattern in enumerate(VALUE_FORMATS.values())
            ]
        return out

    def _checked(self, df, wide, params, context) -> DataFrame:
        rows = [
            _check_row(name, kind, pattern, f"syntax_n__{i}", f"syntax_ok__{i}")
            for i, (name, kind, pattern) in enumerate(self.configured(df, params, context))
            if f"syntax_n__{i}" in wide.columns
        ]
        return _checks(df, wide, rows)

    def detection(self, df, wide, params, context) -> DataFrame:
        """(column, type, pattern, rate, n_qualifying) for every format that fits a column."""
        rows = [
            _check_row(name, kind, pattern, f"detect_n__{j}", f"detect_ok__{j}__{k}")
            for j, name in enumerate(self.detectable(df, params, context))
            for k, (kind, pattern) in enumerate(VALUE_FORMATS.items())
        ]
        rate = F.try_divide("n_conforming", "n_checked")
        fitting = _checks(df, wide, rows).where(rate >= DETECT_MIN_MATCH)
        per_column = fitting.groupBy("column_name").agg(F.count(F.lit(1)).alias("n_qualifying"))
        return fitting.withColumn("match_rate", rate).join(F.broadcast(per_column), "column_name")

    def frames(self, df, shared, params, context) -> MetricFrames:
        threshold = float(params.get("threshold", DEFAULT_THRESHOLD))
        # At most one row per column and format.
        detected = local_rows(self.detection(df, shared.wide, params, context))
        checks = self._checked(df, shared.wide, params, context).unionByName(
            detected.where("n_qualifying = 1").drop("match_rate", "n_qualifying")
        )
        # At most one row per column: running it here tells which values to sample.
        checks = local_rows(checks.where("n_checked > 0"))
        columns = checks.select(
            "*",
            (F.col("n_checked") - F.col("n_conforming")).alias("n_invalid"),
            (F.col("n_conforming") / F.col("n_checked")).alias("conformance"),
        )
        score = score_frame(columns, self.metric_id, F.coalesce(F.avg("conformance"), F.lit(1.0)))
        failing = columns.where(F.col("conformance") < threshold)
        samples = self.invalid_samples(df, failing, context)
        failing = failing.join(F.broadcast(samples), "column_name", "left")
        share = percent_text(F.col("conformance"))
        issues = issues_of(
            failing,
            self.metric_id,
            issue_type="syntactic_accuracy",
            severity=severity("ratio", F.col("conformance"), threshold),
            column_name=F.col("column_name"),
            rule_key="type_conformance_check",
            description=F.concat(
                F.col("n_invalid").cast("string"), F.lit(" values of column "), "column_name",
                F.lit(" do not look like "), "expected_type",
            ),
            actual_value=share,
            affected_row_count=F.col("n_invalid"),
            details=details(
                expected_type=F.col("expected_type"), conformance_rate=F.col("conformance")
            ),
            sample=F.col("sample"),
            fingerprint=syntactic_fingerprint(
                F.col("column_name"), F.col("expected_type"), F.col("pattern")
            ),
        )
        return MetricFrames(score, columns, issues.unionByName(self._mixed_issues(detected)))

    def mixed(self, detected: DataFrame) -> DataFrame:
        """(column_name, formats): columns that fit several formats, best match first."""
        entry = F.struct(
            (-F.col("match_rate")).alias("order"),
            F.concat("expected_type", F.lit(" "), percent_text(F.col("match_rate"), 0)).alias("text"),
            F.col("expected_type").alias("type"),
        )
        ordered = F.sort_array(F.collect_list(entry))
        return (
            detected.where("n_qualifying > 1")
            .groupBy("column_name")
            .agg(F.array_join(F.transform(ordered, lambda e: e["text"]), ", ").alias("formats"))
        )

    def _mixed_issues(self, detected):
        return issues_of(
            self.mixed(detected),
            self.metric_id,
            issue_type="mixed_format",
            severity="medium",
            column_name=F.col("column_name"),
            rule_key="type_conformance_check",
            description=F.concat(F.lit("Several formats fit column "), "column_name"),
            details=details(detected_types=F.col("formats")),
            fingerprint=syntactic_fingerprint(F.col("column_name"), "mixed_format"),
        )

    def invalid_samples(self, df, checks: DataFrame, context) -> DataFrame:
        """(column_name, sample): up to five offending texts per column, all columns in one scan."""
        found = [
            F.when(
                is_invalid(df, row["column_name"], row["pattern"]),
                F.struct(
                    F.lit(row["column_name"]).alias("column_name"),
                    mask_where(
                        value_text(df, row["column_name"]),
                        F.lit(row["column_name"] in context.sensitive),
                    ).alias("text"),
                ),
            )
            for row in checks.collect()
        ]
        if not found:
            return df.sparkSession.createDataFrame([], "column_name string, sample array<string>")
        place = F.struct(*order_columns(df, context.id_columns)).alias("place")
        exploded = df.select(place, F.inline(F.array_compact(F.array(*found))))
        first = first_rows_per_group(exploded, "column_name", [F.col("place")], SAMPLE_ROWS)
        return first.groupBy("column_name").agg(ordered_sample("sample_rank", "text").alias("sample"))


def _check_row(name, kind, pattern, n_checked, n_conforming) -> Column:
    return F.struct(
        F.lit(name).alias("column_name"),
        F.lit(kind).alias("expected_type"),
        F.lit(pattern).alias("pattern"),
        F.col(n_checked).alias("n_checked"),
        F.col(n_conforming).alias("n_conforming"),
    )


def _checks(df, wide, rows) -> DataFrame:
    if not rows:
        return df.sparkSession.createDataFrame([], CHECK_SCHEMA)
    return wide.select(F.inline(F.array(*rows)))
