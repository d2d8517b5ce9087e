"""Severity scales as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Lower bounds of critical, high and medium where a larger value is worse.
WORSE_WHEN_LARGER = {
    "outliers": (0.20, 0.10, 0.05),
    "class_balance": (0.99, 0.95, 0.90),
    "class_balance_deviation": (0.20, 0.10, 0.05),
    "currentness_ratio": (10, 3, 1),
}

# Scales where a larger value is better.
DIVERSITY_CRITICAL, DIVERSITY_HIGH = 0.20, 0.40
RATIO_CRITICAL, RATIO_HIGH = 0.50, 0.70
GAP_HIGH, GAP_MEDIUM = 0.15, 0.05

# Relative gaps below a variability threshold.
RELATIVE_GAP_HIGH, RELATIVE_GAP_MEDIUM = 0.50, 0.20


def severity(kind: str, value: Column, threshold: Column | float = 0.0) -> Column:
    """critical, high, medium or low for a measured value on the named scale."""
    limit = threshold if isinstance(threshold, Column) else F.lit(float(threshold))
    if kind in WORSE_WHEN_LARGER:
        critical, high, medium = WORSE_WHEN_LARGER[kind]
        return (
            F.when(value >= critical, "critical")
            .when(value >= high, "high")
            .when(value >= medium, "medium")
            .otherwise("low")
        )
    if kind == "diversity":
        return (
            F.when(value <= DIVERSITY_CRITICAL, "critical")
            .when(value <= DIVERSITY_HIGH, "high")
            .when(value < limit, "medium")
            .otherwise("low")
        )
    if kind == "ratio":
        gap = limit - value
        return (
            F.when(gap <= 0, "low")
            .when(value < RATIO_CRITICAL, "critical")
            .when((value < RATIO_HIGH) | (gap > GAP_HIGH), "high")
            .when(gap > GAP_MEDIUM, "medium")
            .otherwise("low")
        )
    return F.lit("medium")


def variability_severity(value: Column, threshold: Column, semantic_type: Column) -> Column:
    """Identifiers use the ratio scale; other columns the relative gap below the threshold."""
    relative_gap = (threshold - value) / threshold
    return (
        F.when(semantic_type == "ID", severity("ratio", value, threshold))
        .when(threshold <= 0, "low")
        .when(relative_gap >= RELATIVE_GAP_HIGH, "high")
        .when(relative_gap >= RELATIVE_GAP_MEDIUM, "medium")
        .otherwise("low")
    )
