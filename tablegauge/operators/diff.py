"""Baselines of runs, and which issues are new, recurrent or fixed against them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablegauge.operators.lineage import follow_links
from tablegauge.operators.versions import COMPLETED, latest_completed_runs
from tablegauge.session import dealt


#: Rows that cannot find a match are dealt by so many numbers in a join.
SPREAD = 1024


def _spread(lost: Column, by: str) -> Column:
    """0, but a number by hash for rows that cannot find a match: their keys are alike, and would meet in one task."""
    return F.when(lost, F.pmod(F.xxhash64(by), F.lit(SPREAD)) + 1).otherwise(0).cast("bigint")


def _not_spread(by: str) -> Column:
    """The 0 of the other side, from a column: a literal would not be a key of the join."""
    return F.xxhash64(by).bitwiseAND(F.lit(0).cast("bigint"))


def choose_baselines(runs: DataFrame, current: DataFrame | None = None) -> DataFrame:
    """(run_id, chosen_baseline_id): the named completed run, else the project's newest other one.

    Only the two newest completed runs of a project can be anyone's default, and the window keeps
    two rows per project inside each task, so a project with most of the runs stays cheap. Runs that
    name no baseline are spread over the tasks.
    """
    current = runs if current is None else current
    completed = runs.where(F.col("status") == COMPLETED)
    newest = Window.partitionBy("project_id").orderBy(F.col("completed_at").desc(), F.col("run_id").desc())
    top_two = (
        completed.select("project_id", "run_id", F.row_number().over(newest).alias("place"))
        .where("place <= 2")
        .groupBy("project_id")
        .agg(
            F.max(F.when(F.col("place") == 1, F.col("run_id"))).alias("newest_id"),
            F.max(F.when(F.col("place") == 2, F.col("run_id"))).alias("second_id"),
        )
    )
    named = completed.select(F.col("run_id").alias("named_id"), _not_spread("run_id").alias("named_spread"))
    same = (F.col("baseline_run_id") == F.col("named_id")) & (F.col("spread") == F.col("named_spread"))
    default = F.when(F.col("newest_id") != F.col("run_id"), F.col("newest_id")).otherwise(
        F.col("second_id")
    )
    return (
        current.join(top_two, "project_id", "left")
        .withColumn("spread", _spread(F.col("baseline_run_id").isNull(), "run_id"))
        .join(named, same, "left")
        .select("run_id", F.coalesce("named_id", default).alias("chosen_baseline_id"))
    )


def lineage_baselines(datasets: DataFrame, runs: DataFrame) -> DataFrame:
    """(dataset_id, chosen_baseline_id): newest completed run of the nearest ancestor that has one."""
    latest = latest_completed_runs(runs, "dataset_id").select(
        F.col("dataset_id").alias("run_dataset"), F.col("run_id").alias("latest_run")
    )
    marked = datasets.join(latest, F.col("dataset_id") == F.col("run_dataset"), "left")
    # A dataset with a run ends the walk, so each parent's end is the ancestor looked for.
    links = marked.select(
        F.col("dataset_id").alias("id"),
        F.when(F.col("latest_run").isNull(), F.col("parent_dataset_id")).alias("target"),
    )
    ends = follow_links(links).select(F.col("id").alias("parent_dataset_id"), F.col("end").alias("run_dataset"))
    return (
        datasets.select("dataset_id", "parent_dataset_id")
        .join(ends, "parent_dataset_id", "left")
        .join(latest, "run_dataset", "left")
        .select("dataset_id", F.col("latest_run").alias("chosen_baseline_id"))
    )


def mark_new_issues(issues: DataFrame, baselines: DataFrame) -> DataFrame:
    """Issues with `is_new`: without fingerprint, without baseline, or unknown to the baseline.

    `baselines` is (run_id, chosen_baseline_id). The baseline side is reduced to distinct
    fingerprints first, so the join never multiplies issues. Issues that can have no match there are
    spread over the tasks.
    """
    known = (
        issues.where(F.col("fingerprint").isNotNull() & (F.col("fingerprint") != ""))
        .select(F.col("run_id").alias("chosen_baseline_id"), "fingerprint")
        .distinct()
        .withColumns({"known": F.lit(True), "__spread": _not_spread("fingerprint")})
    )
    lost = F.col("chosen_baseline_id").isNull() | F.col("fingerprint").isNull() | (F.col("fingerprint") == "")
    return (
        issues.join(baselines, "run_id", "left")
        .withColumn("__spread", _spread(lost, "run_id"))
        .join(known, ["chosen_baseline_id", "fingerprint", "__spread"], "left")
        .withColumn("is_new", F.col("known").isNull())
        .drop("known", "__spread")
    )


def fixed_fingerprints(
    issues: DataFrame, baselines: DataFrame, runs: list[int] | None = None
) -> DataFrame:
    """(run_id, fingerprint): distinct baseline fingerprints a run no longer has.

    Runs that share a baseline each list its fingerprints, so a listing over many runs should name
    them; `diff_summary` counts without listing.
    """
    if runs is not None:
        baselines = baselines.where(F.col("run_id").isin(runs))
    prints = (
        issues.where(F.col("fingerprint").isNotNull() & (F.col("fingerprint") != ""))
        .select("run_id", "fingerprint")
        .distinct()
    )
    expected = baselines.join(
        prints.withColumnRenamed("run_id", "chosen_baseline_id"), "chosen_baseline_id"
    ).select("run_id", "fingerprint")
    return expected.join(prints, ["run_id", "fingerprint"], "left_anti")


def diff_summary(issues: DataFrame, baselines: DataFrame) -> DataFrame:
    """Per run: baseline, and how many issues are new, recurrent and fixed.

    Fixed issues are counted, not listed: the baseline's distinct fingerprints less those the run
    still has. Many runs may share one baseline, and no run is paired with all its fingerprints.
    """
    marked = mark_new_issues(issues, baselines).select("run_id", "fingerprint", "is_new")
    prints = dealt(marked, "run_id").groupBy("run_id", "fingerprint").agg(
        F.count_if("is_new").alias("n_new"), F.count_if(~F.col("is_new")).alias("n_recurrent")
    )
    counts = prints.groupBy("run_id").agg(
        F.sum("n_new").alias("new_issues"),
        F.sum("n_recurrent").alias("recurrent_issues"),
        F.count_if(F.col("n_recurrent") > 0).alias("n_kept"),
    )
    named = issues.where(F.col("fingerprint").isNotNull() & (F.col("fingerprint") != ""))
    known = (
        dealt(named.select(F.col("run_id").alias("chosen_baseline_id"), "fingerprint"), "chosen_baseline_id")
        .distinct()
        .groupBy("chosen_baseline_id")
        .agg(F.count(F.lit(1)).alias("n_known"))
    )

    def or_zero(name: str) -> Column:
        return F.coalesce(name, F.lit(0)).cast("bigint")

    return (
        baselines.join(counts, "run_id", "left")
        .join(known, "chosen_baseline_id", "left")
        .select(
            "run_id",
            "chosen_baseline_id",
            F.col("chosen_baseline_id").isNotNull().alias("has_baseline"),
            or_zero("new_issues").alias("new_issues"),
            or_zero("recurrent_issues").alias("recurrent_issues"),
            (or_zero("n_known") - or_zero("n_kept")).alias("fixed_issues"),
        )
    )
