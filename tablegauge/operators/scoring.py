"""Quality score, gate verdict and issue counters of runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Score penalty of one issue, and its limits.
PENALTY = {"critical": 0.12, "high": 0.05, "medium": 0.01, "low": 0.003}
REFERENCE_COLUMNS = 10
MAX_PENALTY = 0.97

# Gate thresholds in points, used where a project sets none.
GATE_DEFAULTS = {"min_score": 70, "warning_margin": 10, "max_critical_issues": 0, "max_new_issues": 10}
BLOCKING = ("critical", "blocker")


def severity_counts(issues: DataFrame, *keys: str) -> DataFrame:
    """Issue counts per severity; an unknown severity counts nowhere."""
    counts = [F.count_if(F.col("severity") == s).alias(f"n_{s}") for s in PENALTY]
    return issues.groupBy(*keys).agg(*counts) if keys else issues.agg(*counts)


def raw_penalty() -> Column:
    return (
        F.col("n_critical") * PENALTY["critical"]
        + F.col("n_high") * PENALTY["high"]
        + F.col("n_medium") * PENALTY["medium"]
        + F.col("n_low") * PENALTY["low"]
    )


def column_scale(n_columns: Column) -> Column:
    """Wider tables raise more issues, so the penalty shrinks with the root of their width."""
    return F.sqrt(F.greatest(F.lit(REFERENCE_COLUMNS), n_columns).cast("double") / REFERENCE_COLUMNS)


def quality_score(counts: DataFrame, n_columns: Column) -> DataFrame:
    """Severity counts with the score in [0, 1] and the steps that led to it."""
    steps = counts.withColumn("raw_penalty", raw_penalty()).withColumn(
        "column_scale", column_scale(n_columns)
    )
    penalty = F.least(F.lit(MAX_PENALTY), F.col("raw_penalty") / F.col("column_scale"))
    return steps.withColumn("issue_penalty", penalty).withColumn(
        "quality_score", F.greatest(F.lit(0.0), 1.0 - F.col("issue_penalty"))
    )


def diagnostic_base(scores: DataFrame, *keys: str) -> DataFrame:
    """Plain mean of the metric scores that exist, 0 without any; not part of the grade."""
    mean = F.coalesce(F.avg("score"), F.lit(0.0)).alias("diagnostic_base")
    return scores.groupBy(*keys).agg(mean) if keys else scores.agg(mean)


def blocking_count(severity: Column, description: Column) -> Column:
    """Aggregate: issues the gate treats as critical."""
    lowered = F.lower(severity)
    named = (lowered == "high") & F.coalesce(F.lower(description).contains("critical"), F.lit(False))
    return F.count_if(lowered.isin(*BLOCKING) | named)


def gate_status(
    score: Column,
    n_critical: Column,
    n_new: Column,
    min_score: Column | float = GATE_DEFAULTS["min_score"],
    warning_margin: Column | float = GATE_DEFAULTS["warning_margin"],
    max_critical: Column | float = GATE_DEFAULTS["max_critical_issues"],
    max_new: Column | float = GATE_DEFAULTS["max_new_issues"],
) -> Column:
    """FAILED, WARNING or PASSED for a score in [0, 1] and thresholds in points."""

    def column(value):
        return value if isinstance(value, Column) else F.lit(value)

    lowest = column(min_score) / F.lit(100.0)
    comfortable = lowest + column(warning_margin) / F.lit(100.0)
    return (
        F.when(n_critical > column(max_critical), "FAILED")
        .when(score < lowest, "FAILED")
        .when(score < comfortable, "WARNING")
        .when(F.coalesce(n_new, F.lit(0)) > column(max_new), "WARNING")
        .otherwise("PASSED")
    )


def evaluate_gates(runs: DataFrame, gates: DataFrame) -> DataFrame:
    """`runs` (project_id, quality_score, n_critical, n_new) with `gate_status`.

    An active gate row of the project sets thresholds; those it leaves null, and projects without
    a gate, use the defaults.
    """
    names = list(GATE_DEFAULTS)
    active = gates.where("is_active").select(
        "project_id", *[F.col(n).cast("double").alias(f"gate__{n}") for n in names]
    )
    limits = [F.coalesce(f"gate__{n}", F.lit(float(GATE_DEFAULTS[n]))) for n in names]
    status = gate_status(F.col("quality_score"), F.col("n_critical"), F.col("n_new"), *limits)
    return (
        runs.join(active, "project_id", "left")
        .withColumn("gate_status", status)
        .drop(*[f"gate__{n}" for n in names])
    )


def affected_share(affected: Column, n_rows: Column) -> Column:
    return F.coalesce(F.try_divide(affected, n_rows), F.lit(0.0))


def issue_counters(issues: DataFrame, *keys: str) -> DataFrame:
    """Total, critical (with blockers) and major issues."""
    counts = [
        F.count(F.lit(1)).alias("total_issues"),
        F.count_if(F.col("severity").isin(*BLOCKING)).alias("critical_issues"),
        F.count_if(F.col("severity") == "high").alias("major_issues"),
    ]
    return issues.groupBy(*keys).agg(*counts) if keys else issues.agg(*counts)
