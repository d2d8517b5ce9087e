"""Run listings and rollups of run history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablegauge.operators.lineage import follow_links
from tablegauge.operators.tree_tour import preorder
from tablegauge.operators.versions import COMPLETED, latest_completed_runs

# Severities of stored issues in listing order.
STORED_ORDER = ("critical", "major", "minor", "info")
GATE_NAMES = {"PASSED": "passed", "WARNING": "warning", "FAILED": "failed"}
HISTORY_LIMIT, MAX_HISTORY_LIMIT = 50, 500
TREND_MARGIN = 2
ATTENTION_SCORE, ATTENTION_LIMIT = 70, 8
TOP_PROJECTS = 10
STALL_SECONDS = 300
OPEN_STATUSES = ("pending", "processing")
SLOW_MS = 500


def run_list(
    runs: DataFrame,
    datasets: DataFrame,
    projects: DataFrame,
    status: str | None = None,
    dataset_id: int | None = None,
) -> DataFrame:
    """Runs with dataset and project names, newest first."""
    if status:
        runs = runs.where(F.col("status") == status)
    if dataset_id is not None:
        runs = runs.where(F.col("dataset_id") == dataset_id)
    names = datasets.select("dataset_id", "dataset_name")
    joined = runs.join(names, "dataset_id").join(projects.select("project_id", "project_name"), "project_id")
    return joined.orderBy(F.col("created_at").desc(), F.col("run_id").desc())


def severity_rank(severity: Column) -> Column:
    """1 critical, 2 major, 3 minor, 4 anything else."""
    rank = F.lit(len(STORED_ORDER))
    for place, name in reversed(list(enumerate(STORED_ORDER[:-1], start=1))):
        rank = F.when(severity == name, F.lit(place)).otherwise(rank)
    return rank


def issue_list(
    issues: DataFrame, run_id: int, severity: str | None = None, issue_type: str | None = None
) -> DataFrame:
    """A run's issues, worst first."""
    rows = issues.where(F.col("run_id") == run_id)
    if severity:
        rows = rows.where(F.col("severity") == severity)
    if issue_type:
        rows = rows.where(F.col("issue_type") == issue_type)
    return rows.withColumn("rank", severity_rank(F.col("severity"))).orderBy("rank", "issue_id")


def severity_pivot(issues: DataFrame) -> DataFrame:
    """(run_id, critical, major, minor, info): issue counts of each run."""
    return issues.groupBy("run_id").agg(
        *[F.count_if(F.col("severity") == s).alias(s) for s in STORED_ORDER]
    )


def run_history(
    runs: DataFrame, issues: DataFrame, dataset_id: int | None = None, status: str | None = None
) -> DataFrame:
    """Runs with their severity counts, newest first."""
    if dataset_id is not None:
        runs = runs.where(F.col("dataset_id") == dataset_id)
    if status:
        runs = runs.where(F.col("status") == status)
    counted = runs.join(severity_pivot(issues), "run_id", "left")
    zero = {s: 0 for s in STORED_ORDER}
    return counted.fillna(zero).orderBy(F.col("created_at").desc(), F.col("run_id").desc())


def issues_by_severity(issues: DataFrame, run_id: int | None = None) -> DataFrame:
    rows = issues if run_id is None else issues.where(F.col("run_id") == run_id)
    return rows.groupBy("run_id", "severity").agg(F.count(F.lit(1)).alias("cnt"))


def run_payload(runs: DataFrame) -> DataFrame:
    """Runs with the recurrent issue count implied by total and new."""
    recurrent = F.greatest(
        F.coalesce("total_issues", F.lit(0)) - F.coalesce("new_issues", F.lit(0)), F.lit(0)
    )
    return runs.withColumn("recurrent_issues", recurrent.cast("bigint"))


def project_snapshots(
    projects: DataFrame, datasets: DataFrame, runs: DataFrame, issues: DataFrame
) -> DataFrame:
    """Per project: dataset count, newest completed run and its severity counts."""
    sizes = datasets.groupBy("project_id").agg(F.count(F.lit(1)).alias("dataset_count"))
    latest = latest_completed_runs(runs, "project_id").select(
        "project_id",
        "run_id",
        "quality_score",
        "gate_status",
        "total_issues",
        "critical_issues",
        "new_issues",
        "fixed_issues",
        "completed_at",
    )
    # Only the newest runs' issues are counted; there is one such run per project.
    counts = severity_pivot(issues.join(latest.select("run_id"), "run_id", "left_semi"))
    return (
        projects.join(sizes, "project_id", "left")
        .join(latest, "project_id", "left")
        .join(counts, "run_id", "left")
        .fillna({"dataset_count": 0})
        .fillna({s: 0 for s in STORED_ORDER})
    )


def global_kpis(snapshots: DataFrame) -> DataFrame:
    return snapshots.agg(
        F.count(F.lit(1)).alias("total_projects"),
        F.sum("dataset_count").alias("total_datasets"),
        F.round(F.avg("quality_score"), 1).alias("avg_quality_score"),
        F.coalesce(F.sum("total_issues"), F.lit(0)).alias("total_issues"),
        F.coalesce(F.sum("critical_issues"), F.lit(0)).alias("critical_issues"),
    )


def gate_distribution(snapshots: DataFrame) -> DataFrame:
    named = [F.count_if(F.col("gate_status") == s).alias(n) for s, n in GATE_NAMES.items()]
    other = F.col("gate_status").isNull() | ~F.col("gate_status").isin(*GATE_NAMES)
    return snapshots.agg(*named, F.count_if(other).alias("no_analysis"))


def severity_distribution(snapshots: DataFrame) -> DataFrame:
    return snapshots.agg(*[F.sum(s).alias(s) for s in STORED_ORDER])


def recent_runs(runs: DataFrame, limit: int = HISTORY_LIMIT) -> DataFrame:
    """The newest completed runs of each project, oldest of them first (`position`).

    `row_number() <= limit` keeps that many rows per project inside each task before the shuffle.
    """
    limit = max(1, min(limit, MAX_HISTORY_LIMIT))
    newest = Window.partitionBy("project_id").orderBy(F.col("created_at").desc(), F.col("run_id").desc())
    kept = (
        runs.where(F.col("status") == COMPLETED)
        .withColumn("rank", F.row_number().over(newest))
        .where(F.col("rank") <= limit)
    )
    oldest = Window.partitionBy("project_id").orderBy(F.col("rank").desc())
    return kept.withColumn("position", F.row_number().over(oldest)).drop("rank")


def score_trend(runs: DataFrame, chain: str, gate: float) -> DataFrame:
    """Per version chain: last score, change to the one before, extremes, and runs at the gate."""
    scored = runs.where((F.col("status") == COMPLETED) & F.col("quality_score").isNotNull())
    when = F.coalesce("completed_at", "created_at")
    totals = scored.groupBy(chain).agg(
        F.min("quality_score").alias("min_score"),
        F.max("quality_score").alias("max_score"),
        F.count_if(F.col("quality_score") >= gate).alias("passing"),
        F.count(F.lit(1)).alias("total"),
    )
    newest = Window.partitionBy(chain).orderBy(when.desc(), F.col("run_id").desc())
    last_two = (
        scored.select(chain, "quality_score", F.row_number().over(newest).alias("place"))
        .where("place <= 2")
        .groupBy(chain)
        .agg(
            F.max(F.when(F.col("place") == 1, F.col("quality_score"))).alias("last_score"),
            F.max(F.when(F.col("place") == 2, F.col("quality_score"))).alias("previous_score"),
        )
    )
    return totals.join(last_two, chain).select(
        chain,
        "last_score",
        (F.col("last_score") - F.col("previous_score")).alias("trend"),
        "min_score",
        "max_score",
        "passing",
        "total",
    )


def version_trend(versions: DataFrame, chain: str) -> DataFrame:
    """Per chain: last minus first known score by version, and what it means."""
    known = versions.where(F.col("quality_score").isNotNull())
    place = F.struct("version", "dataset_id")
    ends = known.groupBy(chain).agg(
        F.min_by("quality_score", place).alias("first_score"),
        F.max_by("quality_score", place).alias("last_score"),
    )
    change = F.coalesce("last_score", F.lit(0.0)) - F.coalesce("first_score", F.lit(0.0))
    label = (
        F.when(change > TREND_MARGIN, "improving").when(change < -TREND_MARGIN, "worsening").otherwise("stable")
    )
    return (
        versions.select(chain)
        .distinct()
        .join(ends, chain, "left")
        .select(chain, change.alias("score_diff"), label.alias("trend"))
    )


def attention_list(snapshots: DataFrame) -> DataFrame:
    """Projects whose newest run failed, warned or scored low, worst first."""
    low = F.coalesce(F.col("quality_score") < ATTENTION_SCORE, F.lit(False))
    troubled = F.coalesce(F.col("gate_status").isin("FAILED", "WARNING"), F.lit(False)) | low
    return (
        snapshots.where(F.col("run_id").isNotNull() & troubled)
        .orderBy(F.coalesce("quality_score", F.lit(100.0)), "project_id")
        .limit(ATTENTION_LIMIT)
    )


def top_projects(snapshots: DataFrame) -> DataFrame:
    """Projects with most issues in their newest run."""
    return (
        snapshots.where(F.col("run_id").isNotNull())
        .orderBy(F.col("total_issues").desc(), "project_id")
        .limit(TOP_PROJECTS)
    )


def health_timeline(runs: DataFrame, limit: int = HISTORY_LIMIT) -> DataFrame:
    """Per project with runs: its recent runs in time order, at most `limit` of them."""
    recent = recent_runs(runs, limit)
    slot = F.struct("created_at", "run_id", F.coalesce("completed_at", "created_at").alias("at"), "gate_status")
    return recent.groupBy("project_id").agg(F.sort_array(F.collect_list(slot)).alias("slots"))


def stalled_runs(runs: DataFrame, as_of, seconds: int = STALL_SECONDS) -> DataFrame:
    """Open runs without an update for too long."""
    cutoff = F.lit(as_of).cast("timestamp") - F.make_dt_interval(secs=F.lit(float(seconds)))
    return runs.where(
        F.lower("status").isin(*OPEN_STATUSES) & (F.col("updated_at").cast("timestamp") < cutoff)
    )


def latency_stats(calls: DataFrame, keys: list[str], duration: str, slow_ms: float = SLOW_MS) -> DataFrame:
    """Calls, mean, shortest and longest duration per key, and how many were slow."""
    return calls.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("count"),
        F.round(F.avg(duration), 2).alias("avg_ms"),
        F.round(F.min(duration), 2).alias("min_ms"),
        F.round(F.max(duration), 2).alias("max_ms"),
        F.count_if(F.col(duration) > slow_ms).alias("slow"),
    )


def tree_order(datasets: DataFrame) -> DataFrame:
    """Datasets with `root_id`, `depth` and `position`; by root and position, a tree reads parents first.

    Positions count from 0 in each tree; siblings follow one another by creation time, then id. A
    version on a cycle of parents is a root.
    """
    links = datasets.select(F.col("dataset_id").alias("id"), F.col("parent_dataset_id").alias("target"))
    ends = follow_links(links).select("id", F.col("end").alias("root"))
    age = F.unix_micros(F.col("created_at").cast("timestamp"))
    rows = datasets.select(F.col("dataset_id").alias("id"), F.col("parent_dataset_id").alias("parent"), age.alias("age"))
    parent = F.when(F.col("id") != F.col("root"), F.col("parent"))
    placed = preorder(rows.join(ends, "id").select("id", parent.alias("parent"), "age", "root"))
    facts = ends.join(placed, "id").select(F.col("id").alias("dataset_id"), F.col("root").alias("root_id"), "depth", "position")
    return datasets.join(facts, "dataset_id")
