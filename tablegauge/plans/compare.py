"""Comparing two versions of a dataset, or two runs."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablegauge.operators.versions import (
    compare_categories,
    compare_issues,
    compare_scores,
    latest_completed_runs,
    schema_diff,
    trend,
    version_deltas,
    with_root,
)


@dataclass
class VersionComparison:
    deltas: DataFrame
    issues: DataFrame
    schema: DataFrame


def compare_versions(
    datasets: DataFrame, runs: DataFrame, issues: DataFrame, a_id: int, b_id: int
) -> VersionComparison:
    """What changed from version `a_id` to `b_id` of one dataset."""
    roots = {
        row["dataset_id"]: row["root_id"]
        for row in with_root(datasets).where(F.col("dataset_id").isin(a_id, b_id)).collect()
    }
    if roots.get(a_id) is None or roots.get(a_id) != roots.get(b_id):
        raise ValueError("only versions of the same dataset can be compared")
    both = runs.where(F.col("dataset_id").isin(a_id, b_id))
    latest = latest_completed_runs(both, "dataset_id").select("dataset_id", "run_id", "quality_score", "total_issues")
    sides = datasets.where(F.col("dataset_id").isin(a_id, b_id)).join(latest, "dataset_id", "left")

    def side(dataset_id: int) -> DataFrame:
        return sides.where(F.col("dataset_id") == dataset_id)

    def found(dataset_id: int) -> DataFrame:
        return issues.where(F.col("run_id") == side(dataset_id).select("run_id").scalar())

    before = side(a_id).withColumn("pair", F.lit(1))
    after = side(b_id).withColumn("pair", F.lit(1))
    names = "columns.name" if dict(datasets.dtypes)["columns"].startswith("array<struct") else "columns"
    added, removed = schema_diff(F.col("a_names"), F.col("b_names"))
    schema = (
        before.select("pair", F.col(names).alias("a_names"))
        .join(after.select("pair", F.col(names).alias("b_names")), "pair")
        .select(added.alias("added"), removed.alias("removed"))
    )
    return VersionComparison(
        deltas=version_deltas(before, after, ["pair"]).drop("pair"),
        issues=compare_issues(found(a_id), found(b_id)),
        schema=schema,
    )


@dataclass
class RunComparison:
    metrics: DataFrame
    categories: DataFrame
    overall: DataFrame


def compare_runs(runs: DataFrame, scores: DataFrame, first_id: int, second_id: int) -> RunComparison:
    """Metric, category and overall scores of two runs."""
    metrics = compare_scores(
        scores.where(F.col("run_id") == first_id), scores.where(F.col("run_id") == second_id)
    )

    def score(run_id: int):
        return F.coalesce(F.max(F.when(F.col("run_id") == run_id, F.col("quality_score"))), F.lit(0.0))

    gap = score(first_id) - score(second_id)
    overall = runs.where(F.col("run_id").isin(first_id, second_id)).agg(
        F.abs(gap).alias("overall_difference"), trend(gap).alias("overall_trend")
    )
    return RunComparison(metrics, compare_categories(metrics), overall)
