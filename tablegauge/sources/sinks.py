"""Writing results: JSON and CSV exports, and the run and issue tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablegauge.functions.columns import col
from tablegauge.functions.scalars import score_label, stored_severity
from tablegauge.operators.scoring import affected_share
from tablegauge.sources.run_store import RunStore


def stored_issues(issues: DataFrame, run_id: int, project_id: int, n_rows: int) -> DataFrame:
    """Issue rows of one run as stored: stored severity names, affected share, and the run they belong to."""
    owned = issues.withColumns({"run_id": F.lit(run_id), "project_id": F.lit(project_id)})
    return _as_stored(owned, F.lit(float(n_rows)))


def stored_issues_of(issues: DataFrame, runs: DataFrame) -> DataFrame:
    """Issue rows of many runs as stored; `runs` gives the `project_id` and `n_rows` of each `run_id`."""
    owned = issues.drop("project_id").join(runs.select("run_id", "project_id", F.col("n_rows").alias("__rows")), "run_id")
    return _as_stored(owned, F.col("__rows").cast("double")).drop("__rows")


def _as_stored(issues: DataFrame, n_rows: Column) -> DataFrame:
    made = ("run_id", "project_id", "severity", "affected_row_count")
    affected = F.coalesce("affected_row_count", F.lit(0)).cast("bigint")
    return issues.select(
        F.col("run_id").cast("bigint").alias("run_id"),
        F.col("project_id").cast("bigint").alias("project_id"),
        *[col(c) for c in issues.columns if c not in made],
        stored_severity(F.col("severity")).alias("severity"),
        affected.alias("affected_row_count"),
        affected_share(affected.cast("double"), n_rows).alias("affected_rows_pct"),
    )


def append_run(run: DataFrame, issues: DataFrame, folder: str) -> None:
    """Add runs and their issues to the store at `folder`; a run that is there already is replaced."""
    RunStore(run.sparkSession, folder).write(run, issues)


def result_json(run: DataFrame, scores: DataFrame, columns: DataFrame) -> DataFrame:
    """One JSON document per run: the run, its metric scores and its column metrics.

    Scores and column metrics hold one row per metric and column of the schema.
    """
    metric_rows = scores.agg(F.sort_array(F.collect_list(F.struct("metric", "score"))))
    fields = F.struct(*[col(c) for c in columns.columns])
    column_rows = columns.agg(F.sort_array(F.collect_list(fields)))
    return run.select(
        F.to_json(
            F.struct(
                F.struct(*[col(c) for c in run.columns]).alias("run"),
                metric_rows.scalar().alias("metrics"),
                column_rows.scalar().alias("column_metrics"),
            )
        ).alias("value")
    )


def export_json(run: DataFrame, scores: DataFrame, columns: DataFrame, path: str) -> None:
    result_json(run, scores, columns).write.mode("overwrite").text(path)


def metric_rows(scores: DataFrame) -> DataFrame:
    """(metric, score, status) rows of the CSV export."""
    return scores.select("metric", "score", score_label(F.col("score")).alias("status"))


def column_metric_pivot(columns: DataFrame, names: list[str]) -> DataFrame:
    """Metric by column: one row per column metric, one text cell per column."""
    measures = [c for c in columns.columns if c != "column_name"]
    texts = columns.select("column_name", *[col(m).cast("string").alias(m) for m in measures])
    long = texts.unpivot("column_name", [col(m) for m in measures], "metric", "value")
    return long.groupBy("metric").pivot("column_name", names).agg(F.first("value"))


def export_csv(run: DataFrame, scores: DataFrame, columns: DataFrame, names: list[str], path: str) -> None:
    """Three CSV folders: the run, its metrics, and the metric by column table."""
    parts = {
        "run": run,
        "metrics": metric_rows(scores),
        "column_metrics": column_metric_pivot(columns, names),
    }
    for name, part in parts.items():
        part.write.mode("overwrite").csv(f"{path}/{name}", header=True)
