"""Outliers of numeric columns: quartile fences or distance from the mean."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablegauge.functions.columns import col, kinds, number_of, numeric_columns
from tablegauge.functions.fingerprints import outlier_fingerprint
from tablegauge.functions.scalars import mask_where, percent_text
from tablegauge.functions.severity import severity
from tablegauge.operators.column_stats import MOMENTS, NULLS, to_long, wide_aggregates
from tablegauge.operators.findings import (
    SAMPLE_ROWS,
    Metric,
    MetricFrames,
    details,
    first_rows_per_group,
    fixed_score,
    issues_of,
    order_columns,
)
from tablegauge.operators.frequency import unpivoted, with_names, with_numbers
from tablegauge.operators.quantiles import quartiles
from tablegauge.session import local_rows

DEFAULT_FACTOR = 1.5
STATISTICS = ("q1", "q3", "iqr", "median", "min", "max", "mean", "std", "lower", "upper")


def fences(q1: Column, q3: Column, factor: float) -> tuple[Column, Column]:
    return q1 - F.lit(float(factor)) * (q3 - q1), q3 + F.lit(float(factor)) * (q3 - q1)


class Outliers(Metric):
    """params: columns, method iqr|zscore, factor. Informs only: its score is always null."""

    metric_id = "outliers"
    informs_only = True

    def aggregates(self, df, params, context):
        names = numeric_columns(df, params.get("columns"))
        return wide_aggregates(names, kinds(df), {**NULLS, **MOMENTS})

    def bounds(self, df, shared, params) -> DataFrame:
        """Statistics of each numeric column and the limits beyond which a value is an outlier."""
        method, factor = params.get("method", "iqr"), params.get("factor", DEFAULT_FACTOR)
        names = numeric_columns(df, params.get("columns"))
        stats = to_long(shared.wide, names, kinds(df), {**NULLS, **MOMENTS}, ["n_rows"])
        if method == "iqr":
            lower, upper = fences(F.col("q1"), F.col("q3"), factor)
            return stats.join(F.broadcast(quartiles(df, names)), "column_name").select(
                "*",
                (F.col("q3") - F.col("q1")).alias("iqr"),
                lower.alias("lower"),
                upper.alias("upper"),
            )
        if method != "zscore":
            raise ValueError(f"unknown outlier method: {method}")
        missing = [F.lit(None).cast("double").alias(n) for n in ("q1", "median", "q3", "iqr", "lower", "upper")]
        return stats.select("*", *missing)

    def is_outlier(self, params) -> Column:
        if params.get("method", "iqr") == "iqr":
            return (F.col("value") < F.col("lower")) | (F.col("value") > F.col("upper"))
        distance = F.abs((F.col("value") - F.col("mean")) / F.col("std"))
        return (F.col("std") > 0) & (distance > F.lit(float(params.get("factor", DEFAULT_FACTOR))))

    def counts(self, df, bounds, params) -> DataFrame:
        """Column rows with outlier_count and proportion; the limits are one broadcast row per column."""
        names = numeric_columns(df, params.get("columns"))
        limits = with_numbers(bounds, names).select("column_no", "lower", "upper", "mean", "std")
        found = with_names(
            unpivoted(df, names, "double")
            .join(F.broadcast(limits), "column_no")
            .groupBy("column_no")
            .agg(F.count_if(self.is_outlier(params)).alias("outlier_count")),
            names,
        )
        return bounds.join(F.broadcast(found), "column_name").withColumn(
            "proportion", F.col("outlier_count") / F.col("n_valid")
        )

    def samples(self, df, bounds, params, context, k: int = SAMPLE_ROWS) -> DataFrame:
        """(column_name, position, value): the first k outliers of each column in id order."""
        names = [c for c in params["columns"] if c in numeric_columns(df)]
        if not names:
            return df.sparkSession.createDataFrame([], "column_name string, position int, value double")
        by_kind = kinds(df)
        cells = F.array(
            *[
                F.struct(F.lit(n).alias("column_name"), number_of(n, by_kind[n]).alias("value"))
                for n in names
            ]
        )
        rows = df.select(
            F.struct(*order_columns(df, context.id_columns)).alias("place"), F.inline(cells)
        )
        outliers = rows.join(F.broadcast(bounds), "column_name").where(
            self.is_outlier(params)
        )
        first = first_rows_per_group(
            outliers.select("column_name", "place", "value"), "column_name", [F.col("place")], k
        )
        return first.select("column_name", F.col("sample_rank").alias("position"), "value")

    def frames(self, df, shared, params, context) -> MetricFrames:
        method, factor = params.get("method", "iqr"), params.get("factor", DEFAULT_FACTOR)
        bounds = local_rows(self.bounds(df, shared, params))
        # One row per numeric column.
        columns = local_rows(self.counts(df, bounds, params))
        sensitive = F.col("column_name").isin(*context.sensitive) if context.sensitive else F.lit(False)
        hidden = sensitive & (F.col("outlier_count") > 0)
        for name in STATISTICS:
            columns = columns.withColumn(name, F.when(~hidden, col(name)))
        with_outliers = [row["column_name"] for row in columns.where("outlier_count > 0").collect()]
        ranked = self.samples(df, bounds, {**params, "columns": with_outliers}, context)
        texts = ranked.groupBy("column_name").agg(
            F.transform(
                F.sort_array(F.collect_list(F.struct("position", "value"))),
                lambda s: s["value"].cast("string"),
            ).alias("sample")
        )
        found = columns.where("outlier_count > 0").join(F.broadcast(texts), "column_name", "left")
        share = percent_text(F.col("proportion"), 1)
        issues = issues_of(
            found,
            self.metric_id,
            issue_type="outliers",
            severity=severity("outliers", F.col("proportion")),
            column_name=F.col("column_name"),
            rule_key=f"outlier_{method}_check",
            description=F.concat(
                F.col("outlier_count").cast("string"), F.lit(" outliers in column "), "column_name"
            ),
            actual_value=share,
            affected_row_count=F.col("outlier_count"),
            details=details(outlier_proportion=F.col("proportion")),
            sample=F.transform("sample", lambda v: mask_where(v, sensitive)),
            fingerprint=outlier_fingerprint(F.col("column_name"), method, factor),
        )
        return MetricFrames(fixed_score(df.sparkSession, self.metric_id, None), columns, issues)
