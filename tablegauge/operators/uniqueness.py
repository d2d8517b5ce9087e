"""Uniqueness: duplicate rows, column variability, and columns expected to be unique."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablegauge.functions.columns import kinds, present, semantic_type
from tablegauge.functions.fingerprints import (
    duplicate_rows_fingerprint,
    expected_unique_fingerprint,
    variability_fingerprint,
)
from tablegauge.functions.scalars import percent_text
from tablegauge.functions.severity import severity, variability_severity
from tablegauge.operators.column_stats import NULLS, to_long, wide_aggregates
from tablegauge.operators.duplicates import duplicate_rows
from tablegauge.operators.findings import (
    SAMPLE_ROWS,
    Metric,
    MetricFrames,
    details,
    issues_of,
    ordered_sample,
)
from tablegauge.operators.frequency import complete_distinct_counts
from tablegauge.session import local_rows

DEFAULT_THRESHOLD = 1.0

# Lowest expected share of distinct values by column type, and the row count
# a table must exceed before low variability is reported.
ID_VARIABILITY, CATEGORICAL_VARIABILITY, OTHER_VARIABILITY = 0.95, 0.05, 0.30
VARIABILITY_MIN_ROWS = 10

# Weights of row uniqueness and identifier health in the score.
ROW_WEIGHT, ID_WEIGHT = 0.7, 0.3


class Uniqueness(Metric):
    """params: columns expected to be unique, threshold."""

    metric_id = "uniqueness"
    shows_values = False

    def _names(self, df):
        return [c for c, kind in kinds(df).items() if kind != "nested"]

    def aggregates(self, df, params, context):
        return wide_aggregates(self._names(df), kinds(df), NULLS)

    def frequency_columns(self, df, params, context):
        return self._names(df)

    def needs_rows(self):
        return True

    def frames(self, df, shared, params, context) -> MetricFrames:
        threshold = params.get("threshold", DEFAULT_THRESHOLD)
        # One row per column, and one row: score and issues are drawn from them without a scan.
        columns = local_rows(self._variability(df, shared))
        rows = local_rows(shared.rows).select(
            "*", F.coalesce(F.try_divide("n_distinct", "n_rows"), F.lit(1.0)).alias("row_uniqueness")
        )
        health = columns.where(F.col("column_type") == "ID").agg(
            F.avg(F.least(F.lit(1.0), F.col("variability") / F.col("threshold_used"))).alias("health")
        )
        row_score = F.col("row_uniqueness")
        score = rows.withColumn("health", health.scalar()).select(
            F.lit(self.metric_id).alias("metric"),
            F.coalesce(ROW_WEIGHT * row_score + ID_WEIGHT * F.col("health"), row_score).alias("score"),
        )
        issues = (
            self._variability_issues(columns)
            .unionByName(self._row_issue(df, rows, threshold, context))
            .unionByName(self._expected_unique_issues(columns, params, df, threshold))
        )
        return MetricFrames(score, columns, issues)

    def _variability(self, df, shared):
        stats = to_long(shared.wide, self._names(df), kinds(df), NULLS, ["n_rows"])
        counted = complete_distinct_counts(shared.frequency, stats).where(F.col("n_valid") > 0)
        typed = counted.select(
            "*",
            semantic_type(F.col("column_name"), F.col("kind"), F.col("n_unique")).alias("column_type"),
            (F.col("n_unique") / F.col("n_valid")).alias("variability"),
        )
        limit = (
            F.when(F.col("column_type") == "ID", ID_VARIABILITY)
            .when(F.col("column_type") == "categorical", CATEGORICAL_VARIABILITY)
            .otherwise(OTHER_VARIABILITY)
        )
        flagged = (F.col("variability") < limit) & (F.col("n_rows") > VARIABILITY_MIN_ROWS)
        return typed.select("*", limit.alias("threshold_used"), flagged.alias("is_low"))

    def _variability_issues(self, columns):
        share = percent_text(F.col("variability"))
        return issues_of(
            columns.where("is_low"),
            self.metric_id,
            issue_type="low_variability",
            severity=variability_severity(
                F.col("variability"), F.col("threshold_used"), F.col("column_type")
            ),
            column_name=F.col("column_name"),
            rule_key="adaptive_threshold",
            description=F.concat(
                F.lit("Low variability in "), "column_type", F.lit(" column "), "column_name",
                F.lit(": "), share, F.lit(" distinct"),
            ),
            actual_value=share,
            details=details(
                unique_values=F.col("n_unique"),
                non_null_count=F.col("n_valid"),
                threshold_used=F.col("threshold_used"),
            ),
            fingerprint=variability_fingerprint(F.col("column_name"), F.col("threshold_used")),
        )

    def _row_issue(self, df, rows, threshold, context):
        found = rows.where((F.col("row_uniqueness") < threshold) & (F.col("n_surplus") > 0))
        # Surplus rows are equal to their group's first row, so five groups yield the sample.
        copies = (
            duplicate_rows(
                df, None, context.id_columns, context.sensitive, SAMPLE_ROWS, SAMPLE_ROWS + 1
            )
            .where("copy > 1")
            .orderBy("group_id", "copy")
            .limit(SAMPLE_ROWS)
            .select(F.struct("group_id", "copy").alias("place"), "row")
        )
        share = percent_text(1 - F.col("row_uniqueness"))
        return issues_of(
            found,
            self.metric_id,
            issue_type="duplicate_rows",
            severity=severity("ratio", F.col("row_uniqueness"), float(threshold)),
            rule_key="row_duplicate_check",
            description=F.concat(F.col("n_surplus").cast("string"), F.lit(" duplicate rows, "), share),
            actual_value=share,
            affected_row_count=F.col("n_surplus"),
            sample=copies.agg(ordered_sample("place", "row")).scalar(),
            fingerprint=duplicate_rows_fingerprint(),
        )

    def _expected_unique_issues(self, columns, params, df, threshold):
        wanted = present(df, params.get("columns")) if params.get("columns") else []
        surplus = F.col("n_valid") - F.col("n_unique")
        found = columns.where(
            F.col("column_name").isin(*wanted) & (F.col("variability") < threshold) & (surplus > 0)
        ) if wanted else columns.where(F.lit(False))
        share = percent_text(F.col("variability"))
        return issues_of(
            found,
            self.metric_id,
            issue_type="non_unique_identifier",
            severity=severity("ratio", F.col("variability"), float(threshold)),
            column_name=F.col("column_name"),
            rule_key="expected_unique",
            description=F.concat(
                F.lit("Column "), "column_name", F.lit(" should be unique but repeats values: "), share
            ),
            actual_value=share,
            details=details(duplicate_count=surplus, uniqueness=F.col("variability")),
            fingerprint=expected_unique_fingerprint(F.col("column_name"), threshold),
        )
