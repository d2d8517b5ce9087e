"""Exploratory profile of a table: overview, statistics, distributions, duplicates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablegauge.functions.columns import (
    col,
    kinds,
    numeric_columns,
    present,
    profile_category,
    profile_sub_type,
)
from tablegauge.functions.fingerprints import numeric_code_fingerprint
from tablegauge.operators.column_stats import CENTRE, MOMENTS, NULLS, column_stats, moment_shape, row_count, to_long, wide_aggregates, with_missing
from tablegauge.operators.findings import Context, Shared, issues_of
from tablegauge.operators.frequency import (
    complete_distinct_counts,
    duplicate_totals,
    top_values,
)
from tablegauge.operators.histogram import DEFAULT_BINS, adaptive_bins, bin_bounds, histogram
from tablegauge.operators.outliers import Outliers
from tablegauge.operators.quantiles import QUARTILES, quartiles, two_scans
from tablegauge.session import local_rows

TOP_COMMON, TOP_BARS = 5, 20
BOXPLOT_SAMPLE = 50
MIN_IQR_FACTOR, MAX_IQR_FACTOR = 0.5, 10.0
CONSTANT_CONSISTENCY = 0.95

# An integer column with so few distinct values on so many rows may be a code.
NUMERIC_CODE_MAX_DISTINCT, NUMERIC_CODE_MIN_ROWS = 10, 20

VALUE_STATISTICS = (
    "mean", "median", "std", "min", "max", "q1", "q3", "iqr", "skewness", "kurtosis", "mode",
)


def percent(part: Column, whole: Column) -> Column:
    return F.round(F.coalesce(F.try_divide(part, whole), F.lit(0.0)) * 100, 2)


def overview(df: DataFrame, size_bytes: int | None = None) -> DataFrame:
    """One row: rows, columns, cells, missing cells, duplicate rows, size. One pass over row counts."""
    n_columns = len(df.columns)
    cells = F.col("n_rows") * n_columns
    return duplicate_totals(df).select(
        F.col("n_rows").alias("total_rows"),
        F.lit(n_columns).alias("total_columns"),
        cells.alias("total_cells"),
        F.col("n_missing").alias("total_missing"),
        percent(F.col("n_missing"), cells).alias("missing_percent"),
        F.col("n_surplus").alias("duplicate_rows"),
        percent(F.col("n_surplus"), F.col("n_rows")).alias("duplicate_percent"),
        F.lit(size_bytes).cast("bigint").alias("estimated_size_bytes"),
    )


def column_types(df: DataFrame, frequency: DataFrame, stats: DataFrame | None = None) -> DataFrame:
    """Per column: category, sub-type, missing and distinct counts."""
    stats = column_stats(df) if stats is None else stats
    counted = complete_distinct_counts(frequency, stats)
    return counted.select(
        "*",
        profile_category(F.col("kind")).alias("category"),
        profile_sub_type(F.col("kind"), F.col("n_unique")).alias("sub_type"),
        percent(F.col("n_missing"), F.col("n_rows")).alias("missing_percent"),
        F.when(F.col("n_valid") > 0, F.col("n_unique") / F.col("n_rows")).alias("uniqueness"),
    )


def type_summary(types: DataFrame) -> DataFrame:
    """(category, cnt, names): at most one name per column is gathered."""
    return types.groupBy("category").agg(
        F.count(F.lit(1)).alias("cnt"),
        F.array_join(F.sort_array(F.collect_list("column_name")), ",").alias("names"),
    )


def numeric_summary(df: DataFrame, columns: list[str] | None = None, digits: int = 4) -> DataFrame:
    """Moments, quartiles, skewness and kurtosis of each numeric column."""
    names = numeric_columns(df, columns)
    measures = {**NULLS, **CENTRE}
    found = two_scans(df, names, QUARTILES, [row_count(), *wide_aggregates(names, kinds(df), measures)], powers=True)
    rows = []
    for i, name in enumerate(names):
        n, low, high, mean = (found.row[f"{m}__{i}"] for m in ("n_valid", "min", "max", "mean"))
        quarters = [found.quantiles.get((name, p)) for p in QUARTILES]
        rows.append((name, n, mean, low, high, *quarters, *moment_shape(n, *found.powers.get(name, (None,) * 3))))
    schema = "column_name string, n_valid bigint, mean double, min double, max double, q1 double, median double, q3 double, std double, skewness double, kurtosis double"
    stats = df.sparkSession.createDataFrame(rows, schema)

    def rounded(value: Column, name: str) -> Column:
        return F.round(value, digits).alias(name)

    return stats.select(
        "column_name",
        "n_valid",
        rounded(F.col("mean"), "mean"),
        rounded(F.col("median"), "median"),
        rounded(F.col("std"), "std"),
        "min",
        "max",
        rounded(F.col("q1"), "q1"),
        rounded(F.col("q3"), "q3"),
        rounded(F.col("q3") - F.col("q1"), "iqr"),
        rounded(F.col("skewness"), "skewness"),
        rounded(F.col("kurtosis"), "kurtosis"),
    )


def upload_schema(df: DataFrame, frequency: DataFrame) -> DataFrame:
    """Per column: stored type, distinct and missing counts, and moments of numeric columns."""
    stats = column_stats(df, None, MOMENTS)
    counted = complete_distinct_counts(frequency, stats)
    medians = quartiles(df).select("column_name", "median")
    return counted.join(F.broadcast(medians), "column_name", "left").select(
        "column_name",
        "kind",
        "position",
        F.col("n_unique").alias("unique_count"),
        F.col("n_missing").alias("missing_count"),
        percent(F.col("n_missing"), F.col("n_rows")).alias("missing_percentage"),
        "min",
        "max",
        "mean",
        "median",
        "std",
    )


def most_common(df: DataFrame, frequency: DataFrame, k: int = TOP_COMMON) -> DataFrame:
    """(column_name, rank, value, cnt): the most frequent values of text columns."""
    texts = [c for c, kind in kinds(df).items() if kind == "string"]
    return top_values(frequency.where(F.col("column_name").isin(*texts)), k)


def bar_chart(df: DataFrame, frequency: DataFrame, sensitive: list[str] | None = None) -> DataFrame:
    """Top categories of the columns that are not numeric; sensitive columns are left out."""
    by_kind = kinds(df)
    numeric = ("integer", "fraction", "decimal", "nested")
    shown = [c for c, k in by_kind.items() if k not in numeric and c not in (sensitive or [])]
    return top_values(frequency.where(F.col("column_name").isin(*shown)), TOP_BARS)


def modes(df: DataFrame, frequency: DataFrame, sensitive: list[str] | None = None) -> DataFrame:
    """(column_name, mode): most frequent category, the smallest among equals."""
    return bar_chart(df, frequency, sensitive).where("rank = 1").select(
        "column_name", F.col("value").alias("mode")
    )


def adaptive_histogram(df: DataFrame, frequency: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Histogram with as many bins as distinct values, within 10 and 30."""
    names = numeric_columns(df, columns)
    stats = complete_distinct_counts(frequency, column_stats(df, names, CENTRE))
    return histogram(df, names, bounds=bin_bounds(stats, adaptive_bins(F.col("n_unique"))))


def boxplot(
    df: DataFrame, columns: list[str] | None = None, factor: float = 1.5, digits: int = 4
) -> DataFrame:
    """Quartiles, fences and outlier count per numeric column."""
    check_iqr_factor(factor)
    params = {"columns": numeric_columns(df, columns), "factor": factor}
    metric = Outliers()
    bounds = local_rows(metric.bounds(df, Shared.lazily(metric, df, params, Context()), params))
    return metric.counts(df, bounds, params).select(
        "column_name",
        "min",
        F.round("q1", digits).alias("q1"),
        F.round("median", digits).alias("median"),
        F.round("q3", digits).alias("q3"),
        "max",
        F.round("lower", digits).alias("lower_fence"),
        F.round("upper", digits).alias("upper_fence"),
        "outlier_count",
    )


def boxplot_outliers(
    df: DataFrame, columns: list[str], id_columns: list[str], factor: float = 1.5
) -> DataFrame:
    """(column_name, position, value): the outliers shown beside a boxplot."""
    check_iqr_factor(factor)
    params = {"columns": columns, "factor": factor}
    metric, context = Outliers(), Context(id_columns=id_columns)
    bounds = metric.bounds(df, Shared.lazily(metric, df, params, context), params)
    return metric.samples(df, local_rows(bounds), params, context, BOXPLOT_SAMPLE)


def check_iqr_factor(factor: float) -> None:
    if not MIN_IQR_FACTOR <= factor <= MAX_IQR_FACTOR:
        raise ValueError(f"iqr factor must be within {MIN_IQR_FACTOR} and {MAX_IQR_FACTOR}")


def redact(statistics: DataFrame, sensitive: list[str] | None) -> DataFrame:
    """Statistics with the value-derived ones of sensitive columns removed, and a `redacted` flag."""
    hidden = F.col("column_name").isin(*sensitive) if sensitive else F.lit(False)
    kept = [
        F.when(~hidden, col(c)).alias(c) if c in VALUE_STATISTICS else col(c)
        for c in statistics.columns
    ]
    return statistics.select(*kept, hidden.alias("redacted"))


def run_column_metrics(df: DataFrame, frequency: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """What a run stores per column: completeness, uniqueness, counts, type, moments and the histogram.

    `histogram` holds the counts of ten equal bins from `min` to `max` of a numeric column with values.
    """
    names, by_kind, measures = present(df, columns), kinds(df), {**NULLS, **MOMENTS}
    numeric = numeric_columns(df, names)
    found = two_scans(df, numeric, (0.5,), [row_count(), *wide_aggregates(names, by_kind, measures)])
    wanted = [c for c in found.row.asDict() if not c.startswith("sketch__")]
    wide = df.agg(row_count(), *wide_aggregates(names, by_kind, measures)).schema
    row = df.sparkSession.createDataFrame([tuple(found.row[c] for c in wanted)], wide)
    stats = local_rows(with_missing(to_long(row, names, by_kind, measures, ["n_rows"])))
    medians = df.sparkSession.createDataFrame([(c, found.quantiles.get((c, 0.5))) for c in names], "column_name string, median double")
    bars = histogram(df, numeric, bounds=bin_bounds(stats, F.lit(DEFAULT_BINS))) if numeric else None
    counted = complete_distinct_counts(frequency, stats).join(F.broadcast(medians), "column_name", "left")
    if bars is None:
        counted = counted.withColumn("histogram", F.lit(None).cast("array<bigint>"))
    else:
        in_order = F.transform(F.array_sort(F.collect_list(F.struct("bin", "cnt"))), lambda b: b["cnt"])
        counted = counted.join(F.broadcast(bars.groupBy("column_name").agg(in_order.alias("histogram"))), "column_name", "left")
    return counted.select(
        "column_name",
        "kind",
        "completeness",
        F.coalesce(F.try_divide("n_unique", "n_rows"), F.lit(1.0)).alias("uniqueness"),
        F.col("n_missing").alias("n_nulls"),
        F.col("n_valid").alias("n_non_nulls"),
        "n_unique",
        "min",
        "max",
        "mean",
        "median",
        "std",
        "histogram",
    )


def quick_column_metrics(df: DataFrame, frequency: DataFrame) -> DataFrame:
    """The column part of a quick analysis: shares, type, and of numeric columns moments and histogram."""
    return run_column_metrics(df, frequency).drop("n_nulls", "n_non_nulls", "n_unique")


def quick_analysis(df: DataFrame) -> DataFrame:
    """One row: completeness, row uniqueness, a constant consistency, and the mean of the three."""
    completeness = column_stats(df).agg(F.avg("completeness"))
    row = duplicate_totals(df).select(
        completeness.scalar().alias("completeness"),
        F.coalesce(F.try_divide("n_distinct", "n_rows"), F.lit(1.0)).alias("uniqueness"),
        F.lit(CONSTANT_CONSISTENCY).alias("consistency"),
    )
    total = F.col("completeness") + F.col("uniqueness") + F.col("consistency")
    return row.withColumn("quality_score", total / 3)


def numeric_code_issues(df: DataFrame, frequency: DataFrame, stats: DataFrame) -> DataFrame:
    """Low issues for integer columns that look like categories."""
    counted = complete_distinct_counts(frequency, stats).where(
        (F.col("kind") == "integer")
        & (F.col("n_unique") < NUMERIC_CODE_MAX_DISTINCT)
        & (F.col("n_rows") > NUMERIC_CODE_MIN_ROWS)
    )
    return issues_of(
        counted,
        "consistency",
        issue_type="consistency",
        severity="low",
        column_name=F.col("column_name"),
        rule_key="categorical_as_numeric",
        description=F.concat(F.lit("Numeric column "), "column_name", F.lit(" may hold categories")),
        fingerprint=numeric_code_fingerprint(F.col("column_name")),
    )


def restrict_profile(types: DataFrame, selected: list[str] | None = None) -> DataFrame:
    """One row: completeness over the chosen columns of a profile."""
    rows = types.where(F.col("column_name").isin(*selected)) if selected else types
    valid, missing = F.sum("n_valid"), F.sum("n_missing")
    return rows.agg(
        F.count(F.lit(1)).alias("n_columns"),
        valid.alias("n_valid"),
        missing.alias("n_missing"),
        F.coalesce(F.try_divide(valid, valid + missing), F.lit(1.0)).alias("completeness"),
    )


def restrict_pairs(pairs: DataFrame, selected: list[str]) -> DataFrame:
    """Correlations among the chosen columns."""
    return pairs.where(F.col("column_a").isin(*selected) & F.col("column_b").isin(*selected))


def completeness_rollup(columns: DataFrame, threshold: float) -> DataFrame:
    """One row over column metrics: missing cells, cells, columns below the threshold and with gaps."""
    return columns.agg(
        F.sum("n_missing").alias("total_nulls"),
        F.sum(F.col("n_missing") + F.col("n_valid")).alias("total_cells"),
        F.count_if(F.col("completeness") < threshold).alias("columns_below"),
        F.count_if(F.col("n_missing") > 0).alias("columns_with_nulls"),
        F.round((1 - F.avg("completeness")) * 100, 1).alias("missing_percent"),
    )


def conformance_rollup(columns: DataFrame, threshold: float) -> DataFrame:
    """One row over conformance results: invalid values, columns below the threshold, overall."""
    return columns.agg(
        F.sum("n_invalid").alias("total_invalid"),
        F.count_if(F.col("conformance") < threshold).alias("columns_below"),
        F.round(F.avg("conformance") * 100, 1).alias("overall_percent"),
    )


def worst_first(columns: DataFrame, measure: str) -> DataFrame:
    return columns.orderBy(col(measure), "column_name")
