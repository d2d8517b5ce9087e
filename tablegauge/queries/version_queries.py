"""Baselines, issue diffs and dataset versions over derived run, issue and dataset tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablegauge.operators import diff, history, versions
from tablegauge.plans.compare import compare_runs
from tablegauge.queries.support import Query, rounded, view, with_views
from tablegauge.session import rewritten


def _runs(spark, sf_dir):
    return view(spark, sf_dir, "runs")


def _baselines(spark, sf_dir):
    return diff.choose_baselines(_runs(spark, sf_dir))


BASELINE = (
    "n AS (SELECT project_id, run_id, row_number() OVER (PARTITION BY project_id ORDER BY completed_at DESC, run_id DESC) AS rn FROM runs WHERE status = 'COMPLETED'), "
    "t AS (SELECT project_id, max(run_id) FILTER (WHERE rn = 1) AS a, max(run_id) FILTER (WHERE rn = 2) AS b FROM n WHERE rn <= 2 GROUP BY 1), "
    "b AS (SELECT r.run_id, coalesce(e.run_id, CASE WHEN t.a <> r.run_id THEN t.a ELSE t.b END) AS chosen_baseline_id FROM runs r "
    "LEFT JOIN t ON t.project_id = r.project_id LEFT JOIN runs e ON e.run_id = r.baseline_run_id AND e.status = 'COMPLETED')"
)


def baseline_choice(spark, sf_dir):
    return _baselines(spark, sf_dir)


BASELINE_SQL = with_views(f"{BASELINE} SELECT run_id, chosen_baseline_id FROM b", "runs")


def lineage_baseline(spark, sf_dir):
    return diff.lineage_baselines(view(spark, sf_dir, "datasets"), _runs(spark, sf_dir))


LATEST_PER_DATASET = (
    "SELECT dataset_id, run_id FROM runs WHERE status = 'COMPLETED' "
    "QUALIFY row_number() OVER (PARTITION BY dataset_id ORDER BY completed_at DESC, run_id DESC) = 1"
)
LINEAGE_SQL = with_views(
    f"l AS ({LATEST_PER_DATASET}), w(dataset_id, ancestor, depth) AS (SELECT dataset_id, parent_dataset_id, 1 FROM datasets "
    "UNION ALL SELECT w.dataset_id, d.parent_dataset_id, w.depth + 1 FROM w JOIN datasets d ON d.dataset_id = w.ancestor), "
    "f AS (SELECT w.dataset_id, arg_min(l.run_id, w.depth) AS run_id FROM w JOIN l ON l.dataset_id = w.ancestor GROUP BY 1) "
    "SELECT d.dataset_id, f.run_id AS chosen_baseline_id FROM datasets d LEFT JOIN f ON f.dataset_id = d.dataset_id",
    "datasets", "runs",
)


def issue_diff(spark, sf_dir):
    issues = view(spark, sf_dir, "issues")
    marked = diff.mark_new_issues(issues, _baselines(spark, sf_dir))
    return marked.select("issue_id", "run_id", "is_new")


MARKED = (
    f"{BASELINE}, f AS (SELECT DISTINCT run_id, fingerprint FROM issues WHERE fingerprint <> ''), "
    "m AS (SELECT i.issue_id, i.run_id, i.fingerprint, f.fingerprint IS NULL AS is_new FROM issues i LEFT JOIN b ON b.run_id = i.run_id "
    "LEFT JOIN f ON f.run_id = b.chosen_baseline_id AND f.fingerprint = i.fingerprint)"
)
ISSUE_DIFF_SQL = with_views(f"{MARKED} SELECT issue_id, run_id, is_new FROM m", "runs", "issues")


def fixed_issues(spark, sf_dir):
    return diff.fixed_fingerprints(view(spark, sf_dir, "issues"), _baselines(spark, sf_dir))


FIXED = (
    "x AS (SELECT b.run_id, f.fingerprint FROM b JOIN f ON f.run_id = b.chosen_baseline_id "
    "WHERE NOT EXISTS (SELECT 1 FROM f g WHERE g.run_id = b.run_id AND g.fingerprint = f.fingerprint))"
)
FIXED_SQL = with_views(f"{MARKED}, {FIXED} SELECT run_id, fingerprint FROM x", "runs", "issues")


def diff_summary(spark, sf_dir):
    return diff.diff_summary(view(spark, sf_dir, "issues"), _baselines(spark, sf_dir))


DIFF_SUMMARY_SQL = with_views(
    f"{MARKED}, {FIXED}, c AS (SELECT run_id, count(*) FILTER (WHERE is_new) AS n, count(*) FILTER (WHERE NOT is_new) AS r FROM m GROUP BY 1), "
    "y AS (SELECT run_id, count(*) AS k FROM x GROUP BY 1) "
    "SELECT b.run_id, chosen_baseline_id, chosen_baseline_id IS NOT NULL AS has_baseline, coalesce(n, 0) AS new_issues, coalesce(r, 0) AS recurrent_issues, "
    "coalesce(k, 0) AS fixed_issues FROM b LEFT JOIN c ON c.run_id = b.run_id LEFT JOIN y ON y.run_id = b.run_id",
    "runs", "issues",
)

# ---- versions -------------------------------------------------------------------------------

ROOTS = (
    "w(dataset_id, root_id, depth) AS (SELECT dataset_id, dataset_id, 0 FROM datasets WHERE parent_dataset_id IS NULL "
    "UNION ALL SELECT d.dataset_id, w.root_id, w.depth + 1 FROM datasets d JOIN w ON d.parent_dataset_id = w.dataset_id), "
    "g AS (SELECT d.*, w.root_id, w.depth FROM datasets d JOIN w ON w.dataset_id = d.dataset_id)"
)


def _rooted(spark, sf_dir):
    return versions.with_root(view(spark, sf_dir, "datasets"))


def root_datasets(spark, sf_dir):
    return _rooted(spark, sf_dir).select("dataset_id", "root_id")


ROOT_SQL = with_views(f"{ROOTS} SELECT dataset_id, root_id FROM g", "datasets")


def version_history(spark, sf_dir):
    return versions.version_history(_rooted(spark, sf_dir), 37).select("dataset_id", "root_id", "version")


HISTORY_SQL = with_views(
    f"{ROOTS} SELECT dataset_id, root_id, version FROM g WHERE root_id = (SELECT root_id FROM g WHERE dataset_id = 37)", "datasets"
)


def latest_version(spark, sf_dir):
    return versions.latest_versions(_rooted(spark, sf_dir))


LATEST_VERSION_SQL = with_views(
    f"{ROOTS} SELECT root_id, dataset_id AS latest_id FROM g QUALIFY row_number() OVER (PARTITION BY root_id ORDER BY is_latest DESC, version DESC) = 1",
    "datasets",
)


def version_facts(spark, sf_dir):
    return versions.version_facts(_rooted(spark, sf_dir))


FACT_SQL = with_views(
    f"{ROOTS} SELECT dataset_id, root_id, count(*) OVER (PARTITION BY root_id) AS version_count, parent_dataset_id AS previous_id, "
    "(SELECT count(*) FROM datasets c WHERE c.parent_dataset_id = g.dataset_id) AS next_count, parent_dataset_id IS NULL AS is_root FROM g",
    "datasets",
)


def next_version_numbers(spark, sf_dir):
    numbers = versions.next_version_numbers(_rooted(spark, sf_dir))
    return numbers.withColumn("next_version", F.col("next_version").cast("bigint"))


NEXT_SQL = with_views(f"{ROOTS} SELECT root_id, CAST(max(version) + 1 AS BIGINT) AS next_version FROM g GROUP BY 1", "datasets")


def added_version(spark, sf_dir):
    """The dataset table after a new version of dataset 37 is added."""
    rooted = _rooted(spark, sf_dir).select("dataset_id", "root_id", "parent_dataset_id", "dataset_name", "version", "is_latest")
    after = versions.add_version(rooted, 37, -1)
    return after.withColumn("version", F.col("version").cast("bigint"))


ADDED_SQL = with_views(
    f"{ROOTS}, t AS (SELECT root_id FROM g WHERE dataset_id = 37) "
    "SELECT dataset_id, root_id, parent_dataset_id, dataset_name, CAST(version AS BIGINT) AS version, is_latest AND root_id <> (SELECT root_id FROM t) AS is_latest FROM g "
    "UNION ALL SELECT -1, root_id, 37, dataset_name, (SELECT max(version) + 1 FROM g WHERE root_id = (SELECT root_id FROM t)), true FROM g WHERE dataset_id = 37",
    "datasets",
)


def versions_with_latest_run(spark, sf_dir):
    joined = versions.versions_with_latest_run(view(spark, sf_dir, "datasets"), _runs(spark, sf_dir))
    return joined.select("dataset_id", "version", "run_id", "quality_score", "gate_status", "total_issues").withColumn(
        "version", F.col("version").cast("bigint")
    )


LAST = (
    "l AS (SELECT * FROM runs WHERE status = 'COMPLETED' QUALIFY row_number() OVER (PARTITION BY dataset_id ORDER BY completed_at DESC, run_id DESC) = 1)"
)
VERSION_RUN_SQL = with_views(
    f"{LAST} SELECT d.dataset_id, CAST(d.version AS BIGINT) AS version, l.run_id, l.quality_score, l.gate_status, l.total_issues FROM datasets d LEFT JOIN l ON l.dataset_id = d.dataset_id",
    "runs", "datasets",
)


def _sides(spark, sf_dir):
    """Every dataset with a parent, and that parent, each with the issues of its newest run.

    All issues are shuffled once, for both sides; those of the runs compared are written, as each side is read twice.
    """
    latest = versions.latest_completed_runs(_runs(spark, sf_dir), "dataset_id").select("dataset_id", "run_id")
    pairs = view(spark, sf_dir, "datasets").where("parent_dataset_id IS NOT NULL").select("dataset_id", "parent_dataset_id")
    issues = view(spark, sf_dir, "issues").select(
        "run_id", "issue_id", "severity", "description", "actual_value", "affected_row_count", "fingerprint"
    )
    after = pairs.select(F.col("dataset_id").alias("pair"), "dataset_id", F.lit(True).alias("is_after"))
    before = pairs.select(F.col("dataset_id").alias("pair"), F.col("parent_dataset_id").alias("dataset_id"), F.lit(False).alias("is_after"))
    compared = after.unionByName(before).join(latest, "dataset_id").select("pair", "is_after", "run_id")
    sides = rewritten(issues.join(compared, "run_id"))
    return sides.where("NOT is_after").drop("is_after"), sides.where("is_after").drop("is_after")


def version_issue_compare(spark, sf_dir):
    before, after = _sides(spark, sf_dir)
    compared = versions.compare_issues(before, after, ["pair"])
    return compared.select(
        "pair", "status", "issue_id", "previous_actual_value", "previous_severity", "row_count_delta"
    )


ISSUE_COMPARE_SQL = with_views(
    f"{LAST}, p AS (SELECT dataset_id AS pair, parent_dataset_id AS parent FROM datasets WHERE parent_dataset_id IS NOT NULL), "
    "k AS (SELECT *, CASE WHEN fingerprint <> '' THEN concat('fp:', fingerprint) ELSE concat('d:', description) END AS key FROM issues), "
    "a AS (SELECT p.pair, k.* FROM p JOIN l ON l.dataset_id = p.parent JOIN k ON k.run_id = l.run_id), "
    "z AS (SELECT p.pair, k.* FROM p JOIN l ON l.dataset_id = p.pair JOIN k ON k.run_id = l.run_id), "
    "u AS (SELECT * FROM a QUALIFY row_number() OVER (PARTITION BY pair, key ORDER BY issue_id DESC) = 1) "
    "SELECT z.pair, CASE WHEN u.key IS NULL THEN 'new' ELSE 'common' END AS status, z.issue_id, u.actual_value AS previous_actual_value, "
    "u.severity AS previous_severity, z.affected_row_count - u.affected_row_count AS row_count_delta FROM z LEFT JOIN u ON u.pair = z.pair AND u.key = z.key "
    "UNION ALL SELECT a.pair, 'resolved', a.issue_id, NULL, NULL, NULL FROM a WHERE NOT EXISTS (SELECT 1 FROM z WHERE z.pair = a.pair AND z.key = a.key)",
    "runs", "datasets", "issues",
)


def version_deltas(spark, sf_dir):
    sized = versions.versions_with_latest_run(view(spark, sf_dir, "datasets"), _runs(spark, sf_dir)).select(
        "dataset_id", "parent_dataset_id", "row_count", "column_count", "quality_score", "total_issues"
    )
    after = sized.where("parent_dataset_id IS NOT NULL").withColumn("pair", F.col("dataset_id"))
    links = after.select("pair", F.col("parent_dataset_id").alias("dataset_id"))
    before = links.join(sized.drop("parent_dataset_id"), "dataset_id")
    deltas = versions.version_deltas(before, after, ["pair"])
    return deltas.withColumn("columns_diff", F.col("columns_diff").cast("bigint")).withColumn(
        "quality_score_diff", F.col("quality_score_diff") + F.lit(0.0)
    )


DELTA_SQL = with_views(
    f"{LAST}, s AS (SELECT d.*, l.quality_score, l.total_issues FROM datasets d LEFT JOIN l ON l.dataset_id = d.dataset_id) "
    "SELECT b.dataset_id AS pair, b.row_count - a.row_count AS rows_diff, CAST(b.column_count - a.column_count AS BIGINT) AS columns_diff, "
    "round(b.quality_score - a.quality_score, 2) + 0.0 AS quality_score_diff, coalesce(b.total_issues, 0) - coalesce(a.total_issues, 0) AS issues_diff "
    "FROM s b JOIN s a ON a.dataset_id = b.parent_dataset_id",
    "runs", "datasets",
)


def schema_diff(spark, sf_dir):
    datasets = view(spark, sf_dir, "datasets")
    before = datasets.select(F.col("dataset_id").alias("parent_dataset_id"), F.col("column_names").alias("old_names"))
    added, removed = versions.schema_diff(F.col("old_names"), F.col("column_names"))
    joined = datasets.join(before, "parent_dataset_id")
    return joined.select("dataset_id", F.array_join(added, ",").alias("added"), F.array_join(removed, ",").alias("removed"))


SCHEMA_DIFF_SQL = with_views(
    "SELECT b.dataset_id, array_to_string(list_sort(list_filter(b.column_names, lambda x: NOT list_contains(a.column_names, x))), ',') AS added, "
    "array_to_string(list_sort(list_filter(a.column_names, lambda x: NOT list_contains(b.column_names, x))), ',') AS removed "
    "FROM datasets b JOIN datasets a ON a.dataset_id = b.parent_dataset_id",
    "datasets",
)


def same_chain(spark, sf_dir):
    datasets = view(spark, sf_dir, "datasets")
    pairs = datasets.select(F.col("dataset_id").alias("a_id"), F.floor(F.col("dataset_id") / 3).alias("b_id"))
    return versions.same_tree(_rooted(spark, sf_dir), pairs).select("a_id", "b_id", "same_tree")


SAME_SQL = with_views(
    f"{ROOTS} SELECT a.dataset_id AS a_id, b.dataset_id AS b_id, a.root_id = b.root_id AS same_tree FROM g a JOIN g b ON b.dataset_id = a.dataset_id // 3",
    "datasets",
)


def _score_sides(spark, sf_dir):
    """Every run beside the run before it in number."""
    scores = view(spark, sf_dir, "metric_scores")
    first = scores.withColumnRenamed("run_id", "pair")
    second = scores.select((F.col("run_id") + 1).alias("pair"), "metric", "score")
    return first, second


def run_compare_metrics(spark, sf_dir):
    first, second = _score_sides(spark, sf_dir)
    return rounded(versions.compare_scores(first, second, ["pair"]), "score_1", "score_2", "difference")


COMPARED = (
    "c AS (SELECT a.run_id AS pair, a.metric, a.score AS s1, b.score AS s2 FROM metric_scores a JOIN metric_scores b ON b.run_id = a.run_id - 1 AND b.metric = a.metric "
    "WHERE a.score IS NOT NULL AND b.score IS NOT NULL)"
)
_TREND = "CASE WHEN {d} > 0 THEN 'improvement' WHEN {d} < 0 THEN 'decline' ELSE 'unchanged' END AS trend"
RUN_COMPARE_SQL = with_views(
    f"{COMPARED} SELECT pair, metric, round(s1, 6) + 0.0 AS score_1, round(s2, 6) + 0.0 AS score_2, round(abs(s1 - s2), 6) + 0.0 AS difference, "
    + _TREND.replace("{d}", "s1 - s2")
    + " FROM c",
    "metric_scores",
)


def run_compare_overall(spark, sf_dir):
    """The first and the last scored run."""
    runs = view(spark, sf_dir, "runs")
    ends = runs.where("quality_score IS NOT NULL").agg(F.min("run_id"), F.max("run_id")).first()
    compared = compare_runs(runs, view(spark, sf_dir, "metric_scores"), ends[0], ends[1])
    return rounded(compared.overall, "overall_difference")


OVERALL_SQL = with_views(
    "e AS (SELECT arg_min(quality_score, run_id) - arg_max(quality_score, run_id) AS gap FROM runs WHERE quality_score IS NOT NULL) "
    "SELECT round(abs(gap), 6) + 0.0 AS overall_difference, CASE WHEN gap > 0 THEN 'improvement' WHEN gap < 0 THEN 'decline' ELSE 'unchanged' END "
    "AS overall_trend FROM e",
    "runs",
)


def run_compare_categories(spark, sf_dir):
    first, second = _score_sides(spark, sf_dir)
    compared = versions.compare_categories(versions.compare_scores(first, second, ["pair"]), ["pair"])
    return rounded(compared, "score_1", "score_2", "difference")


CATEGORY_SQL = with_views(
    f"{COMPARED}, k AS (SELECT pair, CASE WHEN metric LIKE 'outliers%' THEN 'accuracy' ELSE metric END AS category, s1, s2 FROM c WHERE metric <> 'currentness'), "
    "v AS (SELECT pair, category, avg(s1) AS s1, avg(s2) AS s2 FROM k GROUP BY 1, 2) "
    "SELECT pair, category, round(s1, 6) + 0.0 AS score_1, round(s2, 6) + 0.0 AS score_2, round(abs(s1 - s2), 6) + 0.0 AS difference, "
    + _TREND.replace("{d}", "s1 - s2")
    + " FROM v",
    "metric_scores",
)


def tree_order(spark, sf_dir):
    """Depth and pre-order path of every dataset version."""
    return history.tree_order(view(spark, sf_dir, "datasets")).select("dataset_id", "root_id", "depth", "position")


TREE_SQL = with_views(
    "s AS (SELECT dataset_id, parent_dataset_id, concat(lpad(CAST(epoch_us(created_at) AS VARCHAR), 20, '0'), lpad(CAST(dataset_id AS VARCHAR), 20, '0')) AS step FROM datasets), "
    "w(dataset_id, root_id, depth, path) AS (SELECT dataset_id, dataset_id, CAST(0 AS BIGINT), step FROM s WHERE parent_dataset_id IS NULL "
    "UNION ALL SELECT s.dataset_id, w.root_id, w.depth + 1, concat(w.path, s.step) FROM s JOIN w ON s.parent_dataset_id = w.dataset_id) "
    "SELECT dataset_id, root_id, depth, row_number() OVER (PARTITION BY root_id ORDER BY path) - 1 AS position FROM w",
    "datasets",
)

QUERIES = [
    Query("baseline_choice", "D1", baseline_choice, BASELINE_SQL),
    Query("lineage_baseline", "D2", lineage_baseline, LINEAGE_SQL),
    Query("issue_diff", "D3", issue_diff, ISSUE_DIFF_SQL),
    Query("fixed_issues", "D3", fixed_issues, FIXED_SQL),
    Query("diff_summary", "D4", diff_summary, DIFF_SUMMARY_SQL),
    Query("run_compare_overall", "V11", run_compare_overall, OVERALL_SQL),
    Query("root_datasets", "V1", root_datasets, ROOT_SQL),
    Query("version_history", "V2", version_history, HISTORY_SQL),
    Query("latest_versions", "V3", latest_version, LATEST_VERSION_SQL),
    Query("version_facts", "V4", version_facts, FACT_SQL),
    Query("next_version_numbers", "V5", next_version_numbers, NEXT_SQL),
    Query("added_version", "V5", added_version, ADDED_SQL),
    Query("versions_with_latest_run", "V6", versions_with_latest_run, VERSION_RUN_SQL),
    Query("version_issue_compare", "V7", version_issue_compare, ISSUE_COMPARE_SQL),
    Query("version_deltas", "V8", version_deltas, DELTA_SQL),
    Query("schema_diff", "V9", schema_diff, SCHEMA_DIFF_SQL),
    Query("same_chain_check", "V10", same_chain, SAME_SQL),
    Query("run_compare_metrics", "V11", run_compare_metrics, RUN_COMPARE_SQL),
    Query("run_compare_categories", "V11", run_compare_categories, CATEGORY_SQL),
    Query("version_tree_order", "H13", tree_order, TREE_SQL),
]
