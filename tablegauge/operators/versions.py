"""Dataset version trees and the comparison of two versions or two runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablegauge.operators.lineage import follow_links

COMPLETED = "COMPLETED"

# Category of a metric by the start of its id.
METRIC_CATEGORIES = {"completeness": "completeness", "uniqueness": "uniqueness", "outliers": "accuracy"}


def with_root(datasets: DataFrame) -> DataFrame:
    """Datasets with `root_id`, the first version of their tree."""
    links = datasets.select(F.col("dataset_id").alias("id"), F.col("parent_dataset_id").alias("target"))
    roots = follow_links(links).select(F.col("id").alias("dataset_id"), F.col("end").alias("root_id"))
    return datasets.join(roots, "dataset_id")


def version_history(rooted: DataFrame, dataset_id: int) -> DataFrame:
    """The whole tree a dataset belongs to, by version."""
    root = rooted.where(F.col("dataset_id") == dataset_id).select("root_id")
    return rooted.where(F.col("root_id") == root.scalar()).orderBy(
        F.coalesce("version", F.lit(1)), "dataset_id"
    )


def latest_versions(rooted: DataFrame) -> DataFrame:
    """(root_id, latest_id): the version marked latest, else the highest."""
    place = F.struct(F.coalesce("is_latest", F.lit(False)), F.coalesce("version", F.lit(1)), "dataset_id")
    return rooted.groupBy("root_id").agg(F.max_by("dataset_id", place).alias("latest_id"))


def version_facts(rooted: DataFrame) -> DataFrame:
    """Per dataset: tree size, previous version, number of next versions, and whether it is a root."""
    sizes = rooted.groupBy("root_id").agg(F.count(F.lit(1)).alias("version_count"))
    children = (
        rooted.where(F.col("parent_dataset_id").isNotNull())
        .groupBy(F.col("parent_dataset_id").alias("dataset_id"))
        .agg(F.count(F.lit(1)).alias("next_count"))
    )
    return (
        rooted.join(sizes, "root_id")
        .join(children, "dataset_id", "left")
        .select(
            "dataset_id",
            "root_id",
            "version_count",
            F.col("parent_dataset_id").alias("previous_id"),
            F.coalesce("next_count", F.lit(0)).cast("bigint").alias("next_count"),
            F.col("parent_dataset_id").isNull().alias("is_root"),
        )
    )


def next_versions(datasets: DataFrame, dataset_id: int) -> DataFrame:
    return datasets.where(F.col("parent_dataset_id") == dataset_id)


def next_version_numbers(rooted: DataFrame) -> DataFrame:
    """(root_id, next_version): the number a new version of each tree would get."""
    return rooted.groupBy("root_id").agg(
        (F.max(F.coalesce("version", F.lit(1))) + 1).alias("next_version")
    )


def add_version(rooted: DataFrame, parent_id: int, dataset_id: int, changes: dict | None = None) -> DataFrame:
    """The dataset table with a new version of `parent_id`: numbered, inheriting, and the only latest."""
    parent = rooted.where(F.col("dataset_id") == parent_id)
    root = parent.select("root_id")
    number = rooted.where(F.col("root_id") == root.scalar()).agg(F.max(F.coalesce("version", F.lit(1))) + 1)
    latest = F.when(F.col("root_id") == root.scalar(), F.lit(False)).otherwise(F.col("is_latest"))
    kept = rooted.withColumn("is_latest", latest)
    fixed = {
        "dataset_id": F.lit(dataset_id),
        "parent_dataset_id": F.lit(parent_id),
        "version": number.scalar(),
        "is_latest": F.lit(True),
        **{name: F.lit(value) for name, value in (changes or {}).items()},
    }
    added = parent.select(
        *[
            fixed.get(f.name, F.col(f.name)).cast(f.dataType).alias(f.name)
            for f in rooted.schema.fields
        ]
    )
    return kept.unionByName(added)


def latest_completed_runs(runs: DataFrame, key: str) -> DataFrame:
    """The newest completed run per key; combined inside each task, so a hot key costs nothing."""
    place = F.struct("completed_at", "run_id")
    return (
        runs.where(F.col("status") == COMPLETED)
        .groupBy(key)
        .agg(F.max_by(F.struct(*[c for c in runs.columns if c != key]), place).alias("latest"))
        .select(key, "latest.*")
    )


def versions_with_latest_run(rooted: DataFrame, runs: DataFrame) -> DataFrame:
    latest = latest_completed_runs(runs, "dataset_id").select(
        "dataset_id", "run_id", "quality_score", "gate_status", "total_issues", "completed_at"
    )
    return rooted.join(latest, "dataset_id", "left")


def issue_key() -> Column:
    """What two versions' issues are matched by: fingerprint, or description where there is none."""
    known = F.nullif("fingerprint", F.lit(""))
    return F.coalesce(F.concat(F.lit("fp:"), known), F.concat(F.lit("d:"), F.col("description")))


def compare_issues(before: DataFrame, after: DataFrame, on: list[str] | None = None) -> DataFrame:
    """Issues as resolved, new or common. `on` names further keys when many pairs are compared at once.

    Common issues carry the earlier value, row count and severity. The lookup side holds one row
    per key, so a key that is frequent on the other side only repeats a lookup.
    """
    keys = [*(on or []), "issue_key"]
    old = before.withColumn("issue_key", issue_key())
    new = after.withColumn("issue_key", issue_key())
    carried = F.struct("actual_value", "affected_row_count", "severity")
    lookup = (
        old.groupBy(*keys)
        .agg(F.max_by(carried, F.col("issue_id")).alias("previous"))
        .withColumn("found", F.lit(True))
    )
    fields = [*(on or []), "issue_id", "issue_key", "severity", "actual_value", "affected_row_count"]
    paired = new.join(lookup, keys, "left").select(
        F.when(F.col("found"), "common").otherwise("new").alias("status"),
        *fields,
        F.col("previous.actual_value").alias("previous_actual_value"),
        F.col("previous.affected_row_count").alias("previous_affected_row_count"),
        F.col("previous.severity").alias("previous_severity"),
        (F.col("affected_row_count") - F.col("previous.affected_row_count")).alias("row_count_delta"),
    )
    gone = old.join(new.select(*keys).distinct(), keys, "left_anti").select(
        F.lit("resolved").alias("status"), *fields
    )
    return paired.unionByName(gone, allowMissingColumns=True)


def version_deltas(before: DataFrame, after: DataFrame, on: list[str]) -> DataFrame:
    """Differences in rows, columns, score (two decimals) and issues of paired versions."""
    a, b = before.alias("a"), after.alias("b")

    def delta(name: str) -> Column:
        return F.coalesce(F.col(f"b.{name}"), F.lit(0)) - F.coalesce(F.col(f"a.{name}"), F.lit(0))

    return a.join(b, on).select(
        *on,
        delta("row_count").alias("rows_diff"),
        delta("column_count").alias("columns_diff"),
        F.round(F.col("b.quality_score") - F.col("a.quality_score"), 2).alias("quality_score_diff"),
        delta("total_issues").alias("issues_diff"),
    )


def schema_diff(before: Column, after: Column) -> tuple[Column, Column]:
    """(added, removed) column names of two name arrays, sorted."""
    return (
        F.array_sort(F.array_except(after, before)),
        F.array_sort(F.array_except(before, after)),
    )


def same_tree(rooted: DataFrame, pairs: DataFrame) -> DataFrame:
    """Pairs (a_id, b_id) with whether both versions belong to one tree."""
    roots = rooted.select("dataset_id", "root_id")
    a = roots.select(F.col("dataset_id").alias("a_id"), F.col("root_id").alias("a_root"))
    b = roots.select(F.col("dataset_id").alias("b_id"), F.col("root_id").alias("b_root"))
    return pairs.join(a, "a_id").join(b, "b_id").withColumn(
        "same_tree", F.col("a_root") == F.col("b_root")
    )


def trend(difference: Column) -> Column:
    return F.when(difference > 0, "improvement").when(difference < 0, "decline").otherwise("unchanged")


def metric_category(metric: Column) -> Column:
    category = F.lit(None).cast("string")
    for start, name in reversed(METRIC_CATEGORIES.items()):
        category = F.when(metric.startswith(start), F.lit(name)).otherwise(category)
    return category


def compare_scores(first: DataFrame, second: DataFrame, on: list[str] | None = None) -> DataFrame:
    """Scores of the metrics both sides have, their absolute difference and trend."""
    keys = [*(on or []), "metric"]
    left = first.where(F.col("score").isNotNull()).select(*keys, F.col("score").alias("score_1"))
    right = second.where(F.col("score").isNotNull()).select(*keys, F.col("score").alias("score_2"))
    return _with_difference(left.join(right, keys))


def compare_categories(metrics: DataFrame, on: list[str] | None = None) -> DataFrame:
    """Category means of a metric comparison."""
    means = (
        metrics.withColumn("category", metric_category(F.col("metric")))
        .where(F.col("category").isNotNull())
        .groupBy(*(on or []), "category")
        .agg(F.avg("score_1").alias("score_1"), F.avg("score_2").alias("score_2"))
    )
    return _with_difference(means)


def _with_difference(scores: DataFrame) -> DataFrame:
    gap = F.col("score_1") - F.col("score_2")
    return scores.select("*", F.abs(gap).alias("difference"), trend(gap).alias("trend"))
