"""Completeness: share of cells that hold a value."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablegauge.functions.columns import kinds, present
from tablegauge.functions.fingerprints import column_fingerprint
from tablegauge.functions.patterns import cells
from tablegauge.functions.scalars import percent_text
from tablegauge.functions.severity import severity
from tablegauge.operators.column_stats import NULLS, to_long, with_missing
from tablegauge.operators.findings import (
    Metric,
    MetricFrames,
    details,
    fixed_score,
    issues_of,
    no_issues,
    score_frame,
)
from tablegauge.session import local_rows

DEFAULT_THRESHOLD = 0.95
WHOLE_DATASET = "_dataset_"


class Completeness(Metric):
    """params: columns, threshold, null_patterns."""

    metric_id = "completeness"

    def _cells(self, df, params) -> dict[str, Column]:
        return cells(df, params.get("null_patterns"), params.get("columns"))

    def aggregates(self, df, params, context):
        counted = enumerate(self._cells(df, params).values())
        return [F.count(value).alias(f"n_valid__{i}") for i, value in counted]

    def frames(self, df, shared, params, context) -> MetricFrames:
        spark = df.sparkSession
        threshold = float(params.get("threshold", DEFAULT_THRESHOLD))
        names = present(df, params.get("columns"))
        if not names:
            empty = spark.createDataFrame([], "column_name string, completeness double")
            return MetricFrames(fixed_score(spark, self.metric_id, 1.0), empty, no_issues(spark))
        # One row per column; score and issues are then drawn from it without another scan.
        long = local_rows(with_missing(to_long(shared.wide, names, kinds(df), NULLS, ["n_rows"])))
        issues = self._dataset_issue(df, long, params, threshold).unionByName(
            self._column_issues(long, threshold)
        )
        return MetricFrames(
            score_frame(long, self.metric_id, F.avg("completeness")), long, issues
        )

    def _column_issues(self, long: DataFrame, threshold: float) -> DataFrame:
        share = percent_text(F.col("completeness"))
        return issues_of(
            long.where(F.col("completeness") < threshold),
            self.metric_id,
            issue_type="completeness",
            severity=severity("ratio", F.col("completeness"), threshold),
            column_name=F.col("column_name"),
            rule_key="completeness_column_check",
            description=F.concat(F.lit("Low completeness in column "), "column_name", F.lit(": "), share),
            actual_value=share,
            affected_row_count=F.col("n_missing"),
            details=details(null_rate=F.try_divide("n_missing", "n_rows")),
            fingerprint=column_fingerprint("completeness", F.col("column_name")),
        )

    def _dataset_issue(self, df, long, params, threshold: float) -> DataFrame:
        score = long.agg(F.avg("completeness")).first()[0]
        if score is None or score >= threshold:
            return no_issues(df.sparkSession)
        rate = F.try_divide("n_missing", "n_rows")
        problem = [
            row["column_name"]
            for row in long.where(rate > F.lit(1 - threshold)).orderBy("column_name").collect()
        ]
        summary = self._rows_missing(df, problem, params).withColumn("score", F.lit(score))
        share = percent_text(F.col("score"))
        return issues_of(
            summary,
            self.metric_id,
            issue_type="completeness",
            severity=severity("ratio", F.col("score"), threshold),
            column_name=WHOLE_DATASET,
            rule_key="completeness_column_check",
            description=F.concat(F.lit("Low completeness of the dataset: "), share),
            actual_value=share,
            affected_row_count=F.col("n_missing"),
            details=details(problem_columns=",".join(problem)),
            fingerprint=column_fingerprint("completeness", WHOLE_DATASET, threshold),
        )

    def _rows_missing(self, df: DataFrame, problem: list[str], params: dict) -> DataFrame:
        """One row: how many rows miss a value in a problem column; reads only those columns."""
        values = self._cells(df, params)
        missing = reduce(lambda a, b: a | b, [values[name].isNull() for name in problem], F.lit(False))
        return df.agg(F.count_if(missing).alias("n_missing"))
