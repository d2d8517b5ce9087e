"""Scoring, gates, fingerprints, run listings and history over derived run and issue tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablegauge.functions.fingerprints import fingerprint, outlier_fingerprint, row_fingerprints
from tablegauge.functions.severity import WORSE_WHEN_LARGER, severity
from tablegauge.operators import history, scoring
from tablegauge.operators.drilldown import page
from tablegauge.operators.versions import with_root
from tablegauge.plans.evaluate import EvaluationContext, evaluate
from tablegauge.queries.rule_queries import RULES
from tablegauge.queries.support import (
    Query,
    fingerprint_sql,
    ladder_sql,
    ratio_severity_sql,
    rounded,
    table,
    view,
    with_views,
)
from tablegauge.queries.version_queries import ROOTS

# ---- scoring --------------------------------------------------------------------------------


def severity_scales(spark, sf_dir):
    """All scales over every line's discount, tax and quantity."""
    lines = table(spark, sf_dir, "lineitem")
    value = F.col("l_discount") + F.col("l_quantity") / 50
    scales = {kind: severity(kind, value) for kind in WORSE_WHEN_LARGER}
    scales["diversity"] = severity("diversity", value, 0.6)
    scales["ratio"] = severity("ratio", value, 0.95)
    scales["other"] = severity("other", value)
    return lines.groupBy(*[s.alias(f"{k}_severity") for k, s in scales.items()]).agg(F.count(F.lit(1)).alias("cnt"))


_V = "(l_discount + l_quantity / 50)"
SEVERITY_SQL = (
    "SELECT "
    + ", ".join(f"{ladder_sql(_V, *bounds)} AS {kind}_severity" for kind, bounds in WORSE_WHEN_LARGER.items())
    + f", CASE WHEN {_V} <= 0.2 THEN 'critical' WHEN {_V} <= 0.4 THEN 'high' WHEN {_V} < 0.6 THEN 'medium' ELSE 'low' END AS diversity_severity, "
    + f"{ratio_severity_sql(_V, 0.95)} AS ratio_severity, 'medium' AS other_severity, count(*) AS cnt FROM lineitem GROUP BY ALL"
)


def _levels(spark, sf_dir):
    return view(spark, sf_dir, "issues").withColumn("severity", F.col("level"))


def _scored(spark, sf_dir):
    counts = scoring.severity_counts(_levels(spark, sf_dir), "run_id")
    return scoring.quality_score(counts, (F.col("run_id") % 20).cast("int"))


LEVEL_COUNTS = (
    "k AS (SELECT run_id, count(*) FILTER (WHERE level = 'critical') AS n_critical, count(*) FILTER (WHERE level = 'high') AS n_high, "
    "count(*) FILTER (WHERE level = 'medium') AS n_medium, count(*) FILTER (WHERE level = 'low') AS n_low FROM issues GROUP BY 1), "
    "p AS (SELECT *, n_critical * CAST(0.12 AS DOUBLE) + n_high * CAST(0.05 AS DOUBLE) + n_medium * CAST(0.01 AS DOUBLE) + n_low * CAST(0.003 AS DOUBLE) AS raw, sqrt(greatest(10, run_id % 20) / 10.0) AS scale FROM k), "
    "q AS (SELECT *, CAST(least(0.97, raw / scale) AS DOUBLE) AS penalty FROM p)"
)


def quality_scores(spark, sf_dir):
    return rounded(_scored(spark, sf_dir), "raw_penalty", "column_scale", "issue_penalty", "quality_score")


QUALITY_SQL = with_views(
    f"{LEVEL_COUNTS} SELECT run_id, n_critical, n_high, n_medium, n_low, round(CAST(raw AS DOUBLE), 6) + 0.0 AS raw_penalty, round(scale, 6) + 0.0 AS column_scale, "
    "round(penalty, 6) + 0.0 AS issue_penalty, round(greatest(0.0, 1 - penalty), 6) + 0.0 AS quality_score FROM q",
    "issues",
)


def diagnostic_base(spark, sf_dir):
    scores = view(spark, sf_dir, "metric_scores")
    return rounded(scoring.diagnostic_base(scores, "run_id"), "diagnostic_base")


DIAGNOSTIC_SQL = with_views(
    "SELECT run_id, round(coalesce(avg(score), 0.0), 6) + 0.0 AS diagnostic_base FROM metric_scores GROUP BY 1",
    "metric_scores",
)

GATES = """SELECT CAST(r_regionkey AS BIGINT) * 5 AS project_id, 60 + r_regionkey AS min_score,
    CASE WHEN r_regionkey % 2 = 0 THEN 20 END AS warning_margin, r_regionkey AS max_critical_issues,
    CAST(NULL AS INT) AS max_new_issues, r_regionkey <> 3 AS is_active FROM region"""


def gate_verdicts(spark, sf_dir):
    """Verdict of every run with issues under its project's thresholds."""
    from tablegauge.queries.support import run_sql

    issues = _levels(spark, sf_dir)
    critical = issues.groupBy("run_id").agg(
        scoring.blocking_count(F.col("severity"), F.col("description")).alias("n_blocking")
    )
    runs = view(spark, sf_dir, "runs").select("run_id", "project_id", F.col("new_issues").alias("n_new"))
    scored = _scored(spark, sf_dir).select("run_id", "quality_score")
    facts = runs.join(critical, "run_id").join(scored, "run_id").withColumnRenamed("n_blocking", "n_critical")
    judged = scoring.evaluate_gates(facts, run_sql(spark, sf_dir, GATES))
    return judged.select("run_id", "project_id", "n_critical", "gate_status")


GATE_SQL = with_views(
    f"{LEVEL_COUNTS}, g AS ({GATES}), b AS (SELECT run_id, count(*) FILTER (WHERE level = 'critical' OR (level = 'high' AND lower(description) LIKE '%critical%')) AS n "
    "FROM issues GROUP BY 1), f AS (SELECT r.run_id, r.project_id, b.n, r.new_issues, greatest(0.0, 1 - q.penalty) AS score, "
    "CAST(coalesce(g.min_score, 70) AS DOUBLE) / 100.0 AS lo, CAST(coalesce(g.warning_margin, 10) AS DOUBLE) / 100.0 AS margin, coalesce(g.max_critical_issues, 0) AS maxc "
    "FROM runs r JOIN b ON b.run_id = r.run_id JOIN q ON q.run_id = r.run_id LEFT JOIN g ON g.project_id = r.project_id AND g.is_active) "
    "SELECT run_id, project_id, n AS n_critical, CASE WHEN n > maxc THEN 'FAILED' WHEN score < lo THEN 'FAILED' WHEN score < lo + margin THEN 'WARNING' "
    "WHEN new_issues > 10 THEN 'WARNING' ELSE 'PASSED' END AS gate_status FROM f",
    "issues", "runs",
)


def fingerprints(spark, sf_dir):
    """General fingerprints of every customer: mixed case, blanks, missing parts, ordered params."""
    customer = table(spark, sf_dir, "customer")
    padded = F.concat(F.lit("  "), F.col("c_name"), F.lit(" "))
    value = fingerprint(
        F.col("c_mktsegment"), padded, None, "  Rule_Key ", {"zeta": F.col("c_custkey"), "Alpha": ["b ", "A"], "limit": 0.95}
    )
    return customer.select("c_custkey", value.alias("fingerprint"))


FINGERPRINT_SQL = (
    "SELECT c_custkey, "
    + fingerprint_sql("concat(lower(c_mktsegment), '|', lower(c_name), '||rule_key|alpha=a,b|limit=0.95|zeta=', CAST(c_custkey AS VARCHAR))")
    + " AS fingerprint FROM customer"
)


def row_fingerprint(spark, sf_dir):
    """Fingerprint of the negative-priced orders per status: ten ids and, beyond ten, their number."""
    bad = view(spark, sf_dir, "dirty_orders").where("o_totalprice < 0")
    return row_fingerprints(bad, "outliers", "o_orderstatus", "o_orderkey")


ROW_FINGERPRINT_SQL = with_views(
    "b AS (SELECT o_orderstatus, o_orderkey, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey) AS rn, "
    "count(*) OVER (PARTITION BY o_orderstatus) AS n FROM dirty_orders WHERE o_totalprice < 0) "
    "SELECT o_orderstatus, n AS total_rows, "
    + fingerprint_sql(
        "concat('outliers|', lower(o_orderstatus), '|', string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY rn) FILTER (WHERE rn <= 10), "
        "'|outliers_row_check', CASE WHEN n > 10 THEN '|total_rows=' || CAST(n AS VARCHAR) ELSE '' END)"
    )
    + " AS fingerprint FROM b GROUP BY 1, 2",
    "dirty_orders",
)


def special_fingerprints(spark, sf_dir):
    """Fingerprints of every special kind, for each distinct brand as the column name."""
    from tablegauge.functions import fingerprints as fp

    brand = F.col("p_brand")
    brands = table(spark, sf_dir, "part").groupBy("p_brand").agg(F.count(F.lit(1)).alias("cnt"))
    return brands.select(
        "p_brand", "cnt",
        fp.column_fingerprint("completeness", brand, 0.95).alias("column_fp"),
        fp.pattern_fingerprint(brand, r"^\d+$").alias("pattern_fp"),
        fp.duplicate_values_fingerprint(brand).alias("duplicate_fp"),
        fp.syntactic_fingerprint(brand, "email").alias("syntactic_fp"),
        fp.rule_fingerprint(F.concat(brand, F.lit(" > 1"))).alias("rule_fp"),
        fp.balance_fingerprint(brand, "dominant_class").alias("balance_fp"),
        fp.staleness_fingerprint(brand, 30).alias("staleness_fp"),
        fp.diversity_fingerprint(brand, "missing_value", "DE").alias("diversity_fp"),
        outlier_fingerprint(brand, "iqr", 1.5).alias("outlier_fp"),
    )


_B = "lower(p_brand)"
SPECIAL_SQL = (
    "SELECT p_brand, count(*) AS cnt, "
    + ", ".join(
        f"{fingerprint_sql(text)} AS {name}"
        for name, text in {
            "column_fp": f"concat('completeness|', {_B}, '||completeness_column_check|threshold=0.95')",
            "pattern_fp": f"concat('consistency_pattern|', {_B}, '||pattern_check|pattern=^\\d+$')",
            "duplicate_fp": f"concat('uniqueness|', {_B}, '||column_duplicate_check')",
            "syntactic_fp": f"concat('syntactic_accuracy|', {_B}, '||type_conformance_check|expected_type=email')",
            "rule_fp": f"concat('logical_consistency|||cross_field_check|expression=', {_B}, ' > 1')",
            "balance_fp": f"concat('class_balance|', {_B}, '||balance_dominant_class')",
            "staleness_fp": f"concat('currentness|', {_B}, '||staleness_check|threshold_days=30')",
            "diversity_fp": f"concat('diversity|', {_B}, '||diversity_missing_value|diversity_type=missing_value|expected_value=de')",
            "outlier_fp": f"concat('outliers|', {_B}, '||outlier_iqr_check|factor=1.5|method=iqr')",
        }.items()
    )
    + " FROM part GROUP BY p_brand"
)


def affected_shares(spark, sf_dir):
    issues = view(spark, sf_dir, "issues")
    n_rows = (F.col("run_id") % 60).cast("double")
    share = scoring.affected_share(F.col("affected_row_count").cast("double"), n_rows)
    return rounded(issues.select("issue_id", share.alias("share")), "share")


SHARE_SQL = with_views(
    "SELECT issue_id, round(CASE WHEN run_id % 60 = 0 THEN 0.0 ELSE affected_row_count * 1.0 / (run_id % 60) END, 6) + 0.0 AS share FROM issues",
    "issues",
)


def issue_counters(spark, sf_dir):
    return scoring.issue_counters(_levels(spark, sf_dir), "run_id")


COUNTER_SQL = with_views(
    "SELECT run_id, count(*) AS total_issues, count(*) FILTER (WHERE level = 'critical') AS critical_issues, "
    "count(*) FILTER (WHERE level = 'high') AS major_issues FROM issues GROUP BY 1",
    "issues",
)

# ---- a whole evaluation ---------------------------------------------------------------------

EVALUATION = {
    "metrics": [
        {"id": "completeness", "parameters": {"columns": ["o_totalprice", "o_orderpriority"]}},
        {"id": "logical_consistency", "parameters": {"rules": RULES[:2]}},
        {"id": "diversity", "parameters": {"columns": {"o_orderstatus": {"expected_values": ["F", "O", "P", "X"]}}}},
    ]
}


def evaluated_run(spark, sf_dir):
    """A table through the shared scan: scores, issues, grade and verdict of one run."""
    context = EvaluationContext(as_of="2001-10-01", id_columns=["o_orderkey"], run_id=1)
    result = evaluate(view(spark, sf_dir, "dirty_orders"), EVALUATION, context)
    return rounded(
        result.run.select("gate_status", "quality_score", "diagnostic_base", "n_rows", "total_issues", "critical_issues", "new_issues"),
        "quality_score", "diagnostic_base",
    )


EVALUATED_SQL = with_views(
    "m AS (SELECT count(o_totalprice) * 1.0 / count(*) AS a, count(o_orderpriority) * 1.0 / count(*) AS b, count(*) AS n, "
    "1 - count(*) FILTER (WHERE o_totalprice <= 0) * 1.0 / count(*) AS r0, "
    "1 - count(*) FILTER (WHERE o_orderstatus = 'O' AND NOT coalesce(o_totalprice >= 250000, false)) * 1.0 / count(*) FILTER (WHERE o_orderstatus = 'O') AS r1, "
    "(count(DISTINCT o_orderstatus) FILTER (WHERE o_orderstatus IN ('F', 'O', 'P'))) / 4.0 AS d FROM dirty_orders), "
    "i(severity) AS ("
    f"SELECT {ratio_severity_sql('(a + b) / 2', 0.95)} FROM m WHERE (a + b) / 2 < 0.95 UNION ALL "
    f"SELECT {ratio_severity_sql('a', 0.95)} FROM m WHERE a < 0.95 UNION ALL SELECT {ratio_severity_sql('b', 0.95)} FROM m WHERE b < 0.95 UNION ALL "
    f"SELECT {ratio_severity_sql('r0', 1.0)} FROM m WHERE r0 < 1 UNION ALL SELECT {ratio_severity_sql('r1', 1.0)} FROM m WHERE r1 < 1 UNION ALL "
    "SELECT CASE WHEN d <= 0.2 THEN 'critical' WHEN d <= 0.4 THEN 'high' WHEN d < 0.6 THEN 'medium' ELSE 'low' END FROM m), "
    "s AS (SELECT greatest(0.0, 1 - least(0.97, count(*) FILTER (WHERE severity = 'critical') * 0.12 + count(*) FILTER (WHERE severity = 'high') * 0.05 + "
    "count(*) FILTER (WHERE severity = 'medium') * 0.01 + count(*) FILTER (WHERE severity = 'low') * 0.003)) AS q, count(*) AS t, "
    "count(*) FILTER (WHERE severity = 'critical') AS c FROM i) "
    "SELECT CASE WHEN c > 0 OR q < 0.7 THEN 'FAILED' WHEN q < 0.8 OR t > 10 THEN 'WARNING' ELSE 'PASSED' END AS gate_status, "
    "round(CAST(q AS DOUBLE) * 100, 6) + 0.0 AS quality_score, round(CAST(((a + b) / 2 + (r0 + r1) / 2 + d) / 3 AS DOUBLE), 6) + 0.0 AS diagnostic_base, n AS n_rows, t AS total_issues, "
    "c AS critical_issues, t AS new_issues FROM s, m",
    "dirty_orders",
)

# ---- listings -------------------------------------------------------------------------------


def run_list(spark, sf_dir):
    listed = history.run_list(
        view(spark, sf_dir, "runs"), view(spark, sf_dir, "datasets"), view(spark, sf_dir, "projects"), "COMPLETED"
    )
    return listed.select("run_id", "dataset_name", "project_name", "status")


RUN_LIST_SQL = with_views(
    "SELECT r.run_id, d.dataset_name, p.project_name, r.status FROM runs r JOIN datasets d ON d.dataset_id = r.dataset_id "
    "JOIN projects p ON p.project_id = r.project_id WHERE r.status = 'COMPLETED'",
    "runs", "datasets", "projects",
)


def run_list_pages(spark, sf_dir):
    """The third page of the list, newest first, reached by the last row of the second."""
    listed = history.run_list(
        view(spark, sf_dir, "runs"), view(spark, sf_dir, "datasets"), view(spark, sf_dir, "projects"), "COMPLETED"
    ).select("run_id", "dataset_name", "project_name", "completed_at")
    order = ["-completed_at", "-run_id"]
    last = page(listed, order, 2, 25).orderBy("completed_at", "run_id").first()
    after = [last["completed_at"], last["run_id"]] if last else None
    return page(listed, order, 1, 25, after=after).select("run_id", "dataset_name", "project_name")


RUN_PAGE_SQL = with_views(
    "SELECT r.run_id, d.dataset_name, p.project_name FROM runs r JOIN datasets d ON d.dataset_id = r.dataset_id "
    "JOIN projects p ON p.project_id = r.project_id WHERE r.status = 'COMPLETED' ORDER BY r.completed_at DESC, r.run_id DESC LIMIT 25 OFFSET 50",
    "runs", "datasets", "projects",
)


def issue_list(spark, sf_dir):
    issues = view(spark, sf_dir, "issues")
    busiest = issues.groupBy("run_id").agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "run_id").first()
    listed = history.issue_list(issues, busiest["run_id"])
    return listed.select("run_id", "issue_id", "severity", "issue_type", F.col("rank").cast("bigint").alias("rank"))


ISSUE_LIST_SQL = with_views(
    "t AS (SELECT run_id FROM issues GROUP BY 1 ORDER BY count(*) DESC, run_id LIMIT 1) "
    "SELECT run_id, issue_id, severity, issue_type, CAST(CASE severity WHEN 'critical' THEN 1 WHEN 'major' THEN 2 WHEN 'minor' THEN 3 ELSE 4 END AS BIGINT) AS rank "
    "FROM issues WHERE run_id = (SELECT run_id FROM t)",
    "issues",
)


def run_history(spark, sf_dir):
    listed = history.run_history(view(spark, sf_dir, "runs"), view(spark, sf_dir, "issues"))
    return listed.select("run_id", "dataset_id", "status", "critical", "major", "minor", "info")


SEVERITY_COUNTS = "v AS (SELECT run_id, " + ", ".join(
    f"count(*) FILTER (WHERE severity = '{s}') AS {s}" for s in ("critical", "major", "minor", "info")
) + " FROM issues GROUP BY 1)"
RUN_HISTORY_SQL = with_views(
    f"{SEVERITY_COUNTS} SELECT r.run_id, dataset_id, status, coalesce(critical, 0) AS critical, coalesce(major, 0) AS major, "
    "coalesce(minor, 0) AS minor, coalesce(info, 0) AS info FROM runs r LEFT JOIN v ON v.run_id = r.run_id",
    "runs", "issues",
)


def latest_run(spark, sf_dir):
    from tablegauge.operators.versions import latest_completed_runs

    latest = latest_completed_runs(view(spark, sf_dir, "runs"), "project_id")
    return latest.select("project_id", "run_id", "quality_score", "gate_status")


LATEST = (
    "l AS (SELECT * FROM runs WHERE status = 'COMPLETED' "
    "QUALIFY row_number() OVER (PARTITION BY project_id ORDER BY completed_at DESC, run_id DESC) = 1)"
)
LATEST_SQL = with_views(f"{LATEST} SELECT project_id, run_id, quality_score, gate_status FROM l", "runs")


def issues_by_severity(spark, sf_dir):
    return history.issues_by_severity(view(spark, sf_dir, "issues"))


BY_SEVERITY_SQL = with_views("SELECT run_id, severity, count(*) AS cnt FROM issues GROUP BY 1, 2", "issues")


def run_payload(spark, sf_dir):
    payload = history.run_payload(view(spark, sf_dir, "runs"))
    return payload.select("run_id", "total_issues", "new_issues", "recurrent_issues")


PAYLOAD_SQL = with_views(
    "SELECT run_id, total_issues, new_issues, greatest(total_issues - new_issues, 0) AS recurrent_issues FROM runs", "runs"
)

# ---- history --------------------------------------------------------------------------------


def _snapshots(spark, sf_dir):
    return history.project_snapshots(
        view(spark, sf_dir, "projects"),
        view(spark, sf_dir, "datasets"),
        view(spark, sf_dir, "runs"),
        view(spark, sf_dir, "issues"),
    )


SNAPSHOT = (
    f"{SEVERITY_COUNTS}, {LATEST}, d AS (SELECT project_id, count(*) AS dataset_count FROM datasets GROUP BY 1), "
    "h AS (SELECT p.project_id, p.project_name, coalesce(d.dataset_count, 0) AS dataset_count, l.run_id, l.quality_score, l.gate_status, "
    "l.total_issues, l.critical_issues, coalesce(v.critical, 0) AS critical, coalesce(v.major, 0) AS major, coalesce(v.minor, 0) AS minor, "
    "coalesce(v.info, 0) AS info FROM projects p LEFT JOIN d USING (project_id) LEFT JOIN l USING (project_id) LEFT JOIN v ON v.run_id = l.run_id)"
)
SNAPSHOT_VIEWS = ("projects", "datasets", "runs", "issues")


def project_snapshots(spark, sf_dir):
    return _snapshots(spark, sf_dir).select(
        "project_id", "project_name", "dataset_count", "run_id", "quality_score", "gate_status", "total_issues",
        "critical_issues", "critical", "major", "minor", "info",
    )


SNAPSHOT_SQL = with_views(f"{SNAPSHOT} SELECT * FROM h", *SNAPSHOT_VIEWS)


def global_kpis(spark, sf_dir):
    return history.global_kpis(_snapshots(spark, sf_dir))


KPI_SQL = with_views(
    f"{SNAPSHOT} SELECT count(*) AS total_projects, CAST(sum(dataset_count) AS BIGINT) AS total_datasets, round(avg(quality_score), 1) AS avg_quality_score, "
    "CAST(coalesce(sum(total_issues), 0) AS BIGINT) AS total_issues, CAST(coalesce(sum(critical_issues), 0) AS BIGINT) AS critical_issues FROM h",
    *SNAPSHOT_VIEWS,
)


def gate_distribution(spark, sf_dir):
    return history.gate_distribution(_snapshots(spark, sf_dir))


GATE_DISTRIBUTION_SQL = with_views(
    f"{SNAPSHOT} SELECT count(*) FILTER (WHERE gate_status = 'PASSED') AS passed, count(*) FILTER (WHERE gate_status = 'WARNING') AS warning, "
    "count(*) FILTER (WHERE gate_status = 'FAILED') AS failed, count(*) FILTER (WHERE gate_status IS NULL) AS no_analysis FROM h",
    *SNAPSHOT_VIEWS,
)


def severity_distribution(spark, sf_dir):
    return history.severity_distribution(_snapshots(spark, sf_dir))


SEVERITY_DISTRIBUTION_SQL = with_views(
    f"{SNAPSHOT} SELECT " + ", ".join(f"CAST(sum({s}) AS BIGINT) AS {s}" for s in ("critical", "major", "minor", "info")) + " FROM h",
    *SNAPSHOT_VIEWS,
)


def recent_runs(spark, sf_dir):
    recent = history.recent_runs(view(spark, sf_dir, "runs"), 20)
    return recent.select("project_id", "run_id", F.col("position").cast("bigint").alias("position"), "quality_score")


RECENT = (
    "n AS (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY created_at DESC, run_id DESC) AS rn FROM runs WHERE status = 'COMPLETED'), "
    "o AS (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY rn DESC) AS position FROM n WHERE rn <= 20)"
)
RECENT_SQL = with_views(f"{RECENT} SELECT project_id, run_id, position, quality_score FROM o", "runs")


def score_trend(spark, sf_dir):
    rooted = with_root(view(spark, sf_dir, "datasets")).select("dataset_id", "root_id")
    trend = history.score_trend(view(spark, sf_dir, "runs").join(rooted, "dataset_id"), "root_id", 70.0)
    return rounded(trend, "last_score", "trend", "min_score", "max_score")


SCORE_TREND_SQL = with_views(
    f"{ROOTS}, c AS (SELECT r.*, g.root_id, row_number() OVER (PARTITION BY root_id ORDER BY completed_at DESC, run_id DESC) AS rn FROM runs r "
    "JOIN g ON g.dataset_id = r.dataset_id WHERE status = 'COMPLETED' AND quality_score IS NOT NULL) "
    "SELECT root_id, round(max(quality_score) FILTER (WHERE rn = 1), 6) + 0.0 AS last_score, "
    "round(max(quality_score) FILTER (WHERE rn = 1) - max(quality_score) FILTER (WHERE rn = 2), 6) + 0.0 AS trend, "
    "round(min(quality_score), 6) + 0.0 AS min_score, round(max(quality_score), 6) + 0.0 AS max_score, "
    "count(*) FILTER (WHERE quality_score >= 70) AS passing, count(*) AS total FROM c GROUP BY 1",
    "datasets", "runs",
)


def version_trend(spark, sf_dir):
    from tablegauge.operators.versions import latest_completed_runs

    latest = latest_completed_runs(view(spark, sf_dir, "runs"), "dataset_id").select("dataset_id", "quality_score")
    rooted = with_root(view(spark, sf_dir, "datasets"))
    return rounded(history.version_trend(rooted.join(latest, "dataset_id", "left"), "root_id"), "score_diff")


VERSION_TREND_SQL = with_views(
    f"{ROOTS}, l AS (SELECT dataset_id, quality_score FROM runs WHERE status = 'COMPLETED' QUALIFY row_number() OVER (PARTITION BY dataset_id ORDER BY completed_at DESC, run_id DESC) = 1), "
    "c AS (SELECT d.root_id, arg_min(l.quality_score, d.version) FILTER (WHERE l.quality_score IS NOT NULL) AS a, "
    "arg_max(l.quality_score, d.version) FILTER (WHERE l.quality_score IS NOT NULL) AS b FROM g d LEFT JOIN l ON l.dataset_id = d.dataset_id GROUP BY 1) "
    "SELECT root_id, round(coalesce(b, 0) - coalesce(a, 0), 6) + 0.0 AS score_diff, CASE WHEN coalesce(b, 0) - coalesce(a, 0) > 2 THEN 'improving' "
    "WHEN coalesce(b, 0) - coalesce(a, 0) < -2 THEN 'worsening' ELSE 'stable' END AS trend FROM c",
    "datasets", "runs",
)


def attention_list(spark, sf_dir):
    return history.attention_list(_snapshots(spark, sf_dir)).select("project_id", "quality_score", "gate_status")


ATTENTION_SQL = with_views(
    f"{SNAPSHOT} SELECT project_id, quality_score, gate_status FROM h WHERE run_id IS NOT NULL AND (gate_status IN ('FAILED', 'WARNING') OR quality_score < 70) "
    "ORDER BY coalesce(quality_score, 100), project_id LIMIT 8",
    *SNAPSHOT_VIEWS,
)


def top_projects(spark, sf_dir):
    return history.top_projects(_snapshots(spark, sf_dir)).select("project_id", "total_issues")


TOP_PROJECT_SQL = with_views(
    f"{SNAPSHOT} SELECT project_id, total_issues FROM h WHERE run_id IS NOT NULL ORDER BY total_issues DESC, project_id LIMIT 10",
    *SNAPSHOT_VIEWS,
)


def health_timeline(spark, sf_dir):
    slots = history.health_timeline(view(spark, sf_dir, "runs"), 20)
    ids = F.array_join(F.transform("slots", lambda s: F.concat(s["run_id"].cast("string"), F.lit(":"), s["gate_status"])), ",")
    return slots.select("project_id", F.size("slots").cast("bigint").alias("n_slots"), ids.alias("slots"))


TIMELINE_SQL = with_views(
    f"{RECENT} SELECT project_id, count(*) AS n_slots, string_agg(CAST(run_id AS VARCHAR) || ':' || gate_status, ',' ORDER BY created_at, run_id) AS slots FROM o GROUP BY 1",
    "runs",
)

STALL_AS_OF = "2001-01-01 00:00:00"


def stalled_runs(spark, sf_dir):
    return history.stalled_runs(view(spark, sf_dir, "runs"), STALL_AS_OF).select("run_id", "status")


STALLED_SQL = with_views(
    f"SELECT run_id, status FROM runs WHERE lower(status) IN ('pending', 'processing') AND updated_at < TIMESTAMP '{STALL_AS_OF}' - INTERVAL 300 SECOND",
    "runs",
)


def latency_stats(spark, sf_dir):
    """Event values as durations per event type and per type and weekday."""
    events = table(spark, sf_dir, "events")
    per_type = history.latency_stats(events, ["event_type"], "value", 100.0).withColumn("user", F.lit(None).cast("bigint"))
    per_user = history.latency_stats(
        events.withColumn("user", F.col("user_id") % 50), ["event_type", "user"], "value", 100.0
    )
    return per_type.unionByName(per_user)


_LATENCY = "count(*) AS count, round(avg(value), 2) AS avg_ms, round(min(value), 2) AS min_ms, round(max(value), 2) AS max_ms, count(*) FILTER (WHERE value > 100) AS slow"
LATENCY_SQL = (
    f"SELECT event_type, NULL AS user, {_LATENCY} FROM events GROUP BY 1 UNION ALL "
    f"SELECT event_type, user_id % 50 AS user, {_LATENCY} FROM events GROUP BY 1, 2"
)

QUERIES = [
    Query("severity_scales", "K1", severity_scales, SEVERITY_SQL),
    Query("quality_scores", "K2", quality_scores, QUALITY_SQL),
    Query("diagnostic_base", "K3", diagnostic_base, DIAGNOSTIC_SQL),
    Query("gate_verdicts", "K4", gate_verdicts, GATE_SQL),
    Query("fingerprints", "K6", fingerprints, FINGERPRINT_SQL),
    Query("row_fingerprints", "K6b", row_fingerprint, ROW_FINGERPRINT_SQL),
    Query("special_fingerprints", "K6a K6c-K6j", special_fingerprints, SPECIAL_SQL),
    Query("affected_shares", "K7", affected_shares, SHARE_SQL),
    Query("issue_counters", "K8", issue_counters, COUNTER_SQL),
    Query("evaluated_run", "lifecycle", evaluated_run, EVALUATED_SQL),
    Query("run_list", "L6", run_list, RUN_LIST_SQL),
    Query("issue_list", "L7", issue_list, ISSUE_LIST_SQL),
    Query("run_history", "L8", run_history, RUN_HISTORY_SQL),
    Query("latest_completed_run", "L9", latest_run, LATEST_SQL),
    Query("issues_by_severity", "L10", issues_by_severity, BY_SEVERITY_SQL),
    Query("run_payload", "L11", run_payload, PAYLOAD_SQL),
    Query("project_snapshots", "H1", project_snapshots, SNAPSHOT_SQL),
    Query("global_kpis", "H2", global_kpis, KPI_SQL),
    Query("gate_distribution", "H3", gate_distribution, GATE_DISTRIBUTION_SQL),
    Query("severity_distribution", "H4", severity_distribution, SEVERITY_DISTRIBUTION_SQL),
    Query("recent_runs", "H5", recent_runs, RECENT_SQL),
    Query("run_list_pages", "L6 L8", run_list_pages, RUN_PAGE_SQL),
    Query("score_trend", "H6", score_trend, SCORE_TREND_SQL),
    Query("version_trend", "H7", version_trend, VERSION_TREND_SQL),
    Query("attention_list", "H8", attention_list, ATTENTION_SQL),
    Query("top_projects", "H9", top_projects, TOP_PROJECT_SQL),
    Query("health_timeline", "H10", health_timeline, TIMELINE_SQL),
    Query("stalled_runs", "H11", stalled_runs, STALLED_SQL),
    Query("latency_stats", "H12", latency_stats, LATENCY_SQL),
]
