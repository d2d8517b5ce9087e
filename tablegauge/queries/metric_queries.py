"""Completeness, uniqueness, class balance, currentness and diversity."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablegauge.operators.balance import ClassBalance
from tablegauge.operators.completeness import Completeness
from tablegauge.operators.currentness import Currentness
from tablegauge.operators.diversity import Diversity
from tablegauge.operators.findings import Context, Shared
from tablegauge.operators.frequency import value_frequency
from tablegauge.operators.uniqueness import Uniqueness
from tablegauge.queries.scalar_queries import AS_OF, TEXT_DATES, text_dates
from tablegauge.queries.support import (
    FLAT_ISSUE,
    Query,
    fingerprint_sql,
    ladder_sql,
    ratio_severity_sql,
    rounded,
    table,
    union_sql,
    view,
    with_views,
)

# ---- completeness ---------------------------------------------------------------------------

DOC_COLUMNS = ["doc_id", "text", "lang", "source", "n_chars", "quality", "toxic"]
NULLS = {"presets": ["na", "dash"]}
DIRTY_COLUMNS = ["o_orderkey", "o_totalprice", "o_orderpriority"]


def completeness_score(spark, sf_dir):
    docs = Completeness().run(view(spark, sf_dir, "docs_labels")).score
    params = {"columns": [*DIRTY_COLUMNS, "no_such_column"], "null_patterns": NULLS}
    dirty = Completeness().run(view(spark, sf_dir, "dirty_orders"), params).score
    named = docs.withColumn("source", F.lit("docs")).unionByName(dirty.withColumn("source", F.lit("orders")))
    return rounded(named.select("source", "score"), "score")


_CLEAN_PRIORITY = "CASE WHEN o_orderpriority IN ('N/A', '-') THEN NULL ELSE o_orderpriority END"
CLEAN_ORDERS = (
    f"clean AS (SELECT o_orderkey, o_totalprice, {_CLEAN_PRIORITY} AS o_orderpriority FROM dirty_orders)"
)
_DOC_SCORE = "(" + " + ".join(f"count({c}) * 1.0 / count(*)" for c in DOC_COLUMNS) + ") / 7"
_DIRTY_SCORE = "(" + " + ".join(f"count({c}) * 1.0 / count(*)" for c in DIRTY_COLUMNS) + ") / 3"
COMPLETENESS_SCORE_SQL = with_views(
    f"{CLEAN_ORDERS} SELECT 'docs' AS source, round({_DOC_SCORE}, 6) + 0.0 AS score FROM docs_labels "
    f"UNION ALL SELECT 'orders', round({_DIRTY_SCORE}, 6) + 0.0 FROM clean",
    "docs_labels", "dirty_orders",
)


def completeness_dataset_issue(spark, sf_dir):
    params = {"columns": DIRTY_COLUMNS, "null_patterns": NULLS, "threshold": 0.95}
    issues = Completeness().run(view(spark, sf_dir, "dirty_orders"), params).issues
    return issues.where("column_name = '_dataset_'").select(
        *FLAT_ISSUE, F.col("details")["problem_columns"].alias("problem_columns")
    )


DATASET_ISSUE_SQL = with_views(
    f"{CLEAN_ORDERS}, r AS (SELECT {_DIRTY_SCORE} AS s, 1 - count(o_totalprice) * 1.0 / count(*) AS rp, "
    "1 - count(o_orderpriority) * 1.0 / count(*) AS rq, count(*) FILTER (WHERE o_totalprice IS NULL) AS np, "
    "count(*) FILTER (WHERE o_orderpriority IS NULL) AS nq, "
    "count(*) FILTER (WHERE o_totalprice IS NULL OR o_orderpriority IS NULL) AS nb FROM clean) "
    f"SELECT 'completeness' AS issue_type, {ratio_severity_sql('s', 0.95)} AS severity, '_dataset_' AS column_name, "
    "CASE WHEN rp > 0.05 AND rq > 0.05 THEN nb WHEN rp > 0.05 THEN np WHEN rq > 0.05 THEN nq ELSE 0 END AS affected_row_count, "
    f"{fingerprint_sql(chr(39) + 'completeness|_dataset_||completeness_column_check|threshold=0.95' + chr(39))} AS fingerprint, "
    "concat_ws(',', CASE WHEN rq > 0.05 THEN 'o_orderpriority' END, CASE WHEN rp > 0.05 THEN 'o_totalprice' END) AS problem_columns "
    "FROM r WHERE s < 0.95",
    "dirty_orders",
)


def completeness_column_issues(spark, sf_dir):
    issues = Completeness().run(view(spark, sf_dir, "docs_labels")).issues
    return issues.where("column_name <> '_dataset_'").select(*FLAT_ISSUE)


COLUMN_ISSUE_SQL = with_views(
    union_sql(
        DOC_COLUMNS,
        f"SELECT 'completeness' AS issue_type, {ratio_severity_sql('count({c}) * 1.0 / count(*)', 0.95)} AS severity, "
        "'{c}' AS column_name, count(*) - count({c}) AS affected_row_count, "
        + fingerprint_sql("'completeness|{c}||completeness_column_check'")
        + " AS fingerprint FROM docs_labels HAVING count({c}) * 1.0 / count(*) < 0.95",
    ),
    "docs_labels",
)

# ---- uniqueness -----------------------------------------------------------------------------

DOC_ROW = ["text", "lang", "n_chars"]
CONVERSATION = ["conv_id", "turn", "role", "text"]


def row_uniqueness(spark, sf_dir):
    from tablegauge.operators.frequency import duplicate_totals

    rows = duplicate_totals(table(spark, sf_dir, "documents"), DOC_ROW)
    return rounded(
        rows.select("n_rows", "n_distinct", (F.col("n_distinct") / F.col("n_rows")).alias("row_uniqueness")),
        "row_uniqueness",
    )


ROW_UNIQUENESS_SQL = (
    "SELECT count(*) AS n_rows, (SELECT count(*) FROM (SELECT DISTINCT text, lang, n_chars FROM documents)) AS n_distinct, "
    "round((SELECT count(*) FROM (SELECT DISTINCT text, lang, n_chars FROM documents)) * 1.0 / count(*), 6) + 0.0 AS row_uniqueness FROM documents"
)


def column_variability(spark, sf_dir):
    columns = Uniqueness().run(table(spark, sf_dir, "conversations")).columns
    return rounded(
        columns.select(
            "column_name", "n_valid", "n_unique", "variability", "column_type", "threshold_used", "is_low"
        ),
        "variability",
    )


def _variability_sql(name: str, numeric: bool, identifier: bool, source: str) -> str:
    n, v = f"count(DISTINCT {name})", f"count({name})"
    if identifier:
        kind, limit = "'ID'", "0.95"
    elif numeric:
        kind, limit = "'numeric'", "0.3"
    else:
        kind = f"CASE WHEN {n} <= 20 THEN 'categorical' ELSE 'text' END"
        limit = f"CASE WHEN {n} <= 20 THEN 0.05 ELSE 0.3 END"
    return (
        f"SELECT '{name}' AS column_name, {v} AS n_valid, {n} AS n_unique, round({n} * 1.0 / {v}, 6) + 0.0 AS variability, "
        f"{kind} AS column_type, CAST({limit} AS DOUBLE) AS threshold_used, "
        f"{n} * 1.0 / {v} < {limit} AND count(*) > 10 AS is_low, {n} * 1.0 / {v} AS share, count(*) AS n_rows FROM {source}"
    )


CONVERSATION_SQL = " UNION ALL ".join(
    _variability_sql(c, c == "turn", c == "conv_id", "conversations") for c in CONVERSATION
)
VARIABILITY_SQL = (
    "SELECT column_name, n_valid, n_unique, variability, column_type, threshold_used, is_low "
    f"FROM ({CONVERSATION_SQL})"
)


def low_variability_issues(spark, sf_dir):
    issues = Uniqueness().run(table(spark, sf_dir, "conversations")).issues
    return issues.where("issue_type = 'low_variability'").select(
        "severity", "column_name", "fingerprint", F.col("details")["unique_values"].alias("unique_values")
    )


LOW_VARIABILITY_SQL = (
    "SELECT CASE WHEN column_type = 'ID' THEN " + ratio_severity_sql("share", 0.95) + " "
    "WHEN (threshold_used - share) / threshold_used >= 0.5 THEN 'high' "
    "WHEN (threshold_used - share) / threshold_used >= 0.2 THEN 'medium' ELSE 'low' END AS severity, column_name, "
    + fingerprint_sql("concat('low_variability|', column_name, '||adaptive_threshold|threshold=', CAST(threshold_used AS VARCHAR))")
    + f" AS fingerprint, CAST(n_unique AS VARCHAR) AS unique_values FROM ({CONVERSATION_SQL}) WHERE is_low"
)


def duplicate_rows_issue(spark, sf_dir):
    documents = table(spark, sf_dir, "documents").select(*DOC_ROW)
    issues = Uniqueness().run(documents, context=Context(sensitive=["text"])).issues
    return issues.where("issue_type = 'duplicate_rows'").select(
        "severity", "affected_row_count", "fingerprint",
        F.size("sample").cast("bigint").alias("n_sampled"),
        F.exists("sample", lambda row: F.get_json_object(row, "$.text") != "***").alias("shows_text"),
    )


DUPLICATE_ISSUE_SQL = (
    "WITH s AS (SELECT count(*) AS n, (SELECT count(*) FROM (SELECT DISTINCT text, lang, n_chars FROM documents)) AS u FROM documents) "
    f"SELECT {ratio_severity_sql('u * 1.0 / n', 1.0)} AS severity, n - u AS affected_row_count, "
    + fingerprint_sql("'uniqueness|||row_duplicate_check'")
    + " AS fingerprint, least(5, n - u) AS n_sampled, false AS shows_text FROM s WHERE u < n"
)


def expected_unique_columns(spark, sf_dir):
    params = {"columns": ["o_custkey", "o_orderkey", "o_orderpriority"], "threshold": 1.0}
    issues = Uniqueness().run(view(spark, sf_dir, "dirty_orders"), params).issues
    return issues.where("issue_type = 'non_unique_identifier'").select(
        "severity", "column_name", "fingerprint", F.col("details")["duplicate_count"].alias("duplicate_count")
    )


EXPECTED_UNIQUE_SQL = with_views(
    union_sql(
        ["o_custkey", "o_orderkey", "o_orderpriority"],
        f"SELECT {ratio_severity_sql('count(DISTINCT {c}) * 1.0 / count({c})', 1.0)} AS severity, '{{c}}' AS column_name, ".replace("{{c}}", "{c}")
        + fingerprint_sql("'non_unique_identifier|{c}||expected_unique|threshold=1.0'")
        + " AS fingerprint, CAST(count({c}) - count(DISTINCT {c}) AS VARCHAR) AS duplicate_count FROM dirty_orders "
        "HAVING count(DISTINCT {c}) < count({c})",
    ),
    "dirty_orders",
)


def uniqueness_score(spark, sf_dir):
    with_ids = Uniqueness().run(table(spark, sf_dir, "conversations")).score
    without = Uniqueness().run(table(spark, sf_dir, "documents").select(*DOC_ROW)).score
    named = with_ids.withColumn("source", F.lit("conversations")).unionByName(
        without.withColumn("source", F.lit("documents"))
    )
    return rounded(named.select("source", "score"), "score")


UNIQUENESS_SCORE_SQL = (
    "SELECT 'conversations' AS source, round(0.7 * (SELECT count(*) FROM (SELECT DISTINCT * FROM conversations)) / count(*) "
    "+ 0.3 * least(1.0, (count(DISTINCT conv_id) * 1.0 / count(conv_id)) / 0.95), 6) + 0.0 AS score FROM conversations UNION ALL "
    "SELECT 'documents', round((SELECT count(*) FROM (SELECT DISTINCT text, lang, n_chars FROM documents)) * 1.0 / count(*), 6) + 0.0 FROM documents"
)

# ---- class balance --------------------------------------------------------------------------

BALANCE = {
    "columns": ["o_orderstatus", "o_orderpriority"],
    "expected_distribution": {
        "o_orderstatus": {"F": [30, 35], "O": [40, 60], "X": [1, 5]},
        "o_orderpriority": {"1-URGENT": [10, 20], "N/A": [0, 3]},
    },
    "imbalance_threshold_low": 0.05,
}
CLASS_COLUMNS = ["o_orderstatus", "o_orderpriority"]
CLASSES_SQL = "c AS (" + union_sql(
    CLASS_COLUMNS,
    "SELECT '{c}' AS column_name, {c} AS value, count(*) AS cnt, count(*) * 1.0 / sum(count(*)) OVER () AS p, "
    "sum(count(*)) OVER () AS n_values, count(*) OVER () AS n_classes FROM dirty_orders WHERE {c} IS NOT NULL GROUP BY {c}",
) + ")"


def _dirty(spark, sf_dir):
    return view(spark, sf_dir, "dirty_orders")


def balance_targets(spark, sf_dir):
    metric, orders = ClassBalance(), _dirty(spark, sf_dir)
    params = {"columns": ["o_custkey"]}
    counts = value_frequency(orders, metric.frequency_columns(orders, params, Context()))
    return metric.targets(orders, counts, params).select("column_name", "n_classes", "n_values")


TARGET_SQL = with_views(
    "SELECT column_name, n_classes, n_values FROM ("
    + union_sql(
        ["o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"],
        "SELECT '{c}' AS column_name, count(DISTINCT {c}) AS n_classes, count({c}) AS n_values, "
        "'{c}' IN ('o_orderkey', 'o_custkey') AS is_int FROM dirty_orders",
    )
    + ") WHERE column_name = 'o_custkey' OR (n_classes > 1 AND n_classes * 1.0 / n_values <= 0.25 "
    "AND n_classes <= 50 AND (NOT is_int OR n_classes <= 20))",
    "dirty_orders",
)


def balance_index(spark, sf_dir):
    columns = ClassBalance().run(_dirty(spark, sf_dir), {"columns": CLASS_COLUMNS}).columns
    return rounded(
        columns.select("column_name", "n_classes", "n_values", "entropy", "max_entropy", "balance_index"),
        "entropy", "max_entropy", "balance_index",
    )


BALANCE_SQL = with_views(
    f"{CLASSES_SQL} SELECT column_name, n_classes, CAST(n_values AS BIGINT) AS n_values, "
    "round(-sum(p * log2(p + 1e-12)), 6) + 0.0 AS entropy, round(log2(n_classes), 6) + 0.0 AS max_entropy, "
    "round(-sum(p * log2(p + 1e-12)) / log2(n_classes) * 100, 6) + 0.0 AS balance_index FROM c GROUP BY column_name, n_classes, n_values",
    "dirty_orders",
)


def balance_frequency_table(spark, sf_dir):
    """Top twenty classes of each column and one entry for the rest; the nation key is masked."""
    customer = table(spark, sf_dir, "customer")
    metric, params = ClassBalance(), {"columns": ["c_nationkey", "c_mktsegment"], "auto_detect": False}
    supplier = table(spark, sf_dir, "part").select("p_brand")
    shown = metric.frequency_table(
        metric.classes(supplier, value_frequency(supplier), {"columns": ["p_brand"]}), Context()
    )
    counts = value_frequency(customer, ["c_nationkey", "c_mktsegment"])
    masked = metric.frequency_table(
        metric.classes(customer, counts, params), Context(sensitive=["c_nationkey"])
    )
    return rounded(shown.unionByName(masked), "proportion")


def _table_sql(name: str, source: str) -> str:
    return (
        f"SELECT '{name}' AS column_name, CASE WHEN rn > 20 THEN '__others__' ELSE value END AS value, CAST(sum(cnt) AS BIGINT) AS cnt, "
        f"CASE WHEN min(rn) > 20 THEN count(*) END AS n_merged, round(sum(cnt) / (SELECT count(*) FROM {source}), 6) + 0.0 AS proportion "
        f"FROM (SELECT CAST({name} AS VARCHAR) AS value, count(*) AS cnt, row_number() OVER (ORDER BY count(*) DESC, CAST({name} AS VARCHAR)) AS rn "
        f"FROM {source} GROUP BY 1) GROUP BY 2"
    )


FREQUENCY_TABLE_SQL = (
    _table_sql("p_brand", "part")
    + " UNION ALL "
    + _table_sql("c_mktsegment", "customer")
    + " UNION ALL SELECT 'c_nationkey', '***', count(*), CASE WHEN count(DISTINCT c_nationkey) > 20 THEN count(DISTINCT c_nationkey) - 20 END, 1.0 FROM customer"
)


def dominant_minority(spark, sf_dir):
    columns = ClassBalance().run(_dirty(spark, sf_dir), {"columns": CLASS_COLUMNS}).columns
    return rounded(
        columns.select(
            "column_name", "dominant_class", "dominant_proportion", "minority_class", "minority_proportion",
            F.col("n_alerts").cast("bigint").alias("n_alerts"),
        ),
        "dominant_proportion", "minority_proportion",
    )


DOMINANT = (
    "d AS (SELECT column_name, n_classes, arg_max(value, (cnt, -rn)) AS dominant_class, max(p) AS dominant_proportion, "
    "arg_max(value, rn) AS minority_class, min(p) AS minority_proportion FROM "
    "(SELECT *, row_number() OVER (PARTITION BY column_name ORDER BY cnt DESC, value) AS rn FROM c) GROUP BY 1, 2)"
)
DOMINANT_SQL = with_views(
    f"{CLASSES_SQL}, {DOMINANT} SELECT column_name, dominant_class, round(dominant_proportion, 6) + 0.0 AS dominant_proportion, "
    "minority_class, round(minority_proportion, 6) + 0.0 AS minority_proportion, "
    "CAST(dominant_proportion >= 0.9 AS BIGINT) + CAST(minority_proportion <= 0.05 AND n_classes > 1 AS BIGINT) AS n_alerts FROM d",
    "dirty_orders",
)


def dominant_class_issues(spark, sf_dir):
    """Label quality and toxicity: any class above seventy percent is reported."""
    labels = table(spark, sf_dir, "labels")
    params = {"columns": ["toxic", "quality"], "auto_detect": False, "imbalance_threshold_high": 0.3}
    issues = ClassBalance().run(labels, params).issues.where("rule_key = 'balance_dominant_class'")
    return issues.select("severity", "column_name", "fingerprint", F.col("details")["dominant_class"].alias("dominant_class"))


DOMINANT_ISSUE_SQL = union_sql(
    ["toxic", "quality"],
    f"SELECT {ladder_sql('m.p', 0.99, 0.95, 0.90)} AS severity, '{{c}}' AS column_name, ".replace("{{c}}", "{c}")
    + fingerprint_sql("'class_balance|{c}||balance_dominant_class'")
    + " AS fingerprint, m.value AS dominant_class FROM (SELECT CAST({c} AS VARCHAR) AS value, "
    "count(*) * 1.0 / sum(count(*)) OVER () AS p FROM labels GROUP BY {c} ORDER BY count(*) DESC, 1 LIMIT 1) m WHERE m.p >= 0.3",
)


def minority_class_issues(spark, sf_dir):
    params = {"columns": CLASS_COLUMNS, "imbalance_threshold_low": 0.2, "auto_detect": False}
    issues = ClassBalance().run(_dirty(spark, sf_dir), params).issues.where("rule_key = 'balance_minority_class'")
    return issues.select("severity", "column_name", "fingerprint", F.col("details")["minority_class"].alias("minority_class"))


MINORITY_ISSUE_SQL = with_views(
    f"{CLASSES_SQL}, {DOMINANT} SELECT CASE WHEN minority_proportion < 0.02 THEN 'medium' ELSE 'low' END AS severity, column_name, "
    + fingerprint_sql("concat('class_balance|', column_name, '||balance_minority_class')")
    + " AS fingerprint, minority_class FROM d WHERE minority_proportion <= 0.2 AND n_classes > 1",
    "dirty_orders",
)

EXPECTED_VALUES = ", ".join(
    f"('{name}', '{value}', {low}.0, {high}.0)"
    for name, classes in BALANCE["expected_distribution"].items()
    for value, (low, high) in classes.items()
)
CONFORMITY = (
    f"e(column_name, class, min_pct, max_pct) AS (SELECT * FROM (VALUES {EXPECTED_VALUES})), "
    "k AS (SELECT e.*, coalesce(c.p, 0.0) * 100 AS pct FROM e LEFT JOIN c ON e.column_name = c.column_name AND e.class = c.value), "
    "f AS (SELECT *, pct BETWEEN min_pct AND max_pct AS in_range, CASE WHEN pct BETWEEN min_pct AND max_pct THEN 0.0 "
    "ELSE least(abs(pct - min_pct), abs(pct - max_pct)) END AS deviation FROM k)"
)


def expected_distribution(spark, sf_dir):
    metric, orders = ClassBalance(), _dirty(spark, sf_dir)
    counts = value_frequency(orders, metric.frequency_columns(orders, BALANCE, Context()))
    classes = metric.conformity(orders, counts, BALANCE, Context())
    return rounded(classes, "min_pct", "max_pct", "actual_pct", "deviation_pp")


CONFORMITY_SQL = with_views(
    f"{CLASSES_SQL}, {CONFORMITY} SELECT column_name, class, CAST(min_pct AS DOUBLE) AS min_pct, CAST(max_pct AS DOUBLE) AS max_pct, "
    "round(pct, 6) + 0.0 AS actual_pct, in_range, round(deviation, 6) + 0.0 AS deviation_pp FROM f",
    "dirty_orders",
)


def expected_distribution_issues(spark, sf_dir):
    issues = ClassBalance().run(_dirty(spark, sf_dir), BALANCE).issues
    found = issues.where("rule_key = 'balance_distribution_deviation'")
    return found.select("severity", "column_name", "fingerprint", F.col("details")["class_name"].alias("class"))


DEVIATION_SQL = with_views(
    f"{CLASSES_SQL}, {CONFORMITY} SELECT {ladder_sql('deviation / 100', 0.20, 0.10, 0.05)} AS severity, column_name, "
    + fingerprint_sql("concat('class_balance|', column_name, '||balance_distribution_deviation|class_name=', lower(class))")
    + " AS fingerprint, class FROM f WHERE NOT in_range",
    "dirty_orders",
)


def class_balance_score(spark, sf_dir):
    orders = _dirty(spark, sf_dir)
    asked = ClassBalance().run(orders, BALANCE).score.withColumn("mode", F.lit("expected"))
    explicit = ClassBalance().run(orders, {"columns": CLASS_COLUMNS}).score.withColumn("mode", F.lit("explicit"))
    detected = ClassBalance().run(orders, {}).score.withColumn("mode", F.lit("detected"))
    return rounded(asked.unionByName(explicit).unionByName(detected).select("mode", "score"), "score")


BALANCE_SCORE_SQL = with_views(
    f"{CLASSES_SQL}, {CONFORMITY}, b AS (SELECT column_name, round(-sum(p * log2(p + 1e-12)) / log2(n_classes) * 100, 2) / 100 AS i "
    "FROM c GROUP BY column_name, n_classes), q AS (SELECT column_name, round(avg(CAST(in_range AS INT)) * 100, 2) / 100 AS s FROM f GROUP BY 1) "
    "SELECT 'expected' AS mode, round(avg(0.5 * i + 0.5 * s), 6) + 0.0 AS score FROM b JOIN q USING (column_name) "
    "UNION ALL SELECT 'explicit', round(avg(i), 6) + 0.0 FROM b UNION ALL SELECT 'detected', NULL FROM b WHERE column_name = 'o_orderstatus'",
    "dirty_orders",
)

# ---- currentness ----------------------------------------------------------------------------

CURRENT = {"columns": ["date_text"], "staleness_threshold_days": 30}


def _dated(spark, sf_dir):
    return text_dates(spark, sf_dir).select("o_orderkey", "date_text", "o_orderstatus")


PARSED = (
    f"t AS ({TEXT_DATES}), p AS (SELECT *, coalesce(try_strptime(date_text, '%Y-%m-%d %H:%M:%S'), "
    "try_strptime(date_text, '%Y-%m-%d'), try_strptime(date_text, '%d/%m/%Y')) AS d FROM t)"
)


def date_columns(spark, sf_dir):
    metric, rows = Currentness(), _dated(spark, sf_dir)
    wide = Shared.lazily(metric, rows, CURRENT, Context()).wide
    return metric.detection(rows, wide, CURRENT).select("column_name", "n_valid", "n_parsed", "is_date")


DATE_COLUMN_SQL = (
    f"WITH {PARSED} SELECT 'date_text' AS column_name, count(date_text) AS n_valid, count(d) AS n_parsed, "
    "count(d) * 1.0 / count(*) >= 0.5 AS is_date FROM p UNION ALL "
    "SELECT 'o_orderstatus', count(o_orderstatus), CAST(0 AS BIGINT), false FROM p"
)


def freshness(spark, sf_dir):
    columns = Currentness().run(_dated(spark, sf_dir), CURRENT, Context(as_of=AS_OF)).columns
    return rounded(
        columns.select(
            "column_name",
            F.date_format("max_date", "yyyy-MM-dd").alias("max_date"),
            F.date_format("min_date", "yyyy-MM-dd").alias("min_date"),
            "age_days", "date_range_days", "parse_rate", "is_stale", "freshness", "age_text",
        ),
        "parse_rate", "freshness",
    )


_AGE_OF = f"CAST(floor(epoch(TIMESTAMP '{AS_OF}' - max(d)) / 86400) AS BIGINT)"
FRESH = f"a AS (SELECT max(d) AS hi, min(d) AS lo, {_AGE_OF} AS age, count(d) * 1.0 / count(*) AS rate, count(*) AS n FROM p)"
_FRESHNESS = "CASE WHEN age <= 30 THEN 1.0 ELSE greatest(0.0, 1 - (age - 30) / 90.0) END"
FRESHNESS_SQL = (
    f"WITH {PARSED}, {FRESH} SELECT 'date_text' AS column_name, strftime(hi, '%Y-%m-%d') AS max_date, "
    "strftime(lo, '%Y-%m-%d') AS min_date, age AS age_days, CAST(floor(epoch(hi - lo) / 86400) AS BIGINT) AS date_range_days, "
    f"round(rate, 6) + 0.0 AS parse_rate, age > 30 AS is_stale, round({_FRESHNESS}, 6) + 0.0 AS freshness, "
    "CAST(age // 30 AS VARCHAR) || CASE WHEN age // 30 > 1 THEN ' meses' ELSE ' mes' END || CASE WHEN age % 30 > 0 THEN ' y ' || "
    "CAST(age % 30 AS VARCHAR) || CASE WHEN age % 30 > 1 THEN ' dias' ELSE ' dia' END ELSE '' END AS age_text FROM a"
)


def stale_issues(spark, sf_dir):
    issues = Currentness().run(_dated(spark, sf_dir), {**CURRENT, "staleness_threshold_days": 20}, Context(as_of=AS_OF)).issues
    return issues.where("rule_key = 'staleness_check'").select("severity", "column_name", "fingerprint")


STALE_SQL = (
    f"WITH {PARSED}, {FRESH} SELECT {ladder_sql('age / 20.0', 10, 3, 1)} AS severity, 'date_text' AS column_name, "
    + fingerprint_sql("'currentness|date_text||staleness_check|threshold_days=20'")
    + " AS fingerprint FROM a WHERE age > 20"
)


def parse_rate_issues(spark, sf_dir):
    """Every order text is a date except one in five, and an event table with few dates among its texts."""
    issues = Currentness().run(_dated(spark, sf_dir), CURRENT, Context(as_of=AS_OF)).issues
    docs = view(spark, sf_dir, "docs_labels").select(
        "lang", F.when(F.col("doc_id") % 3 == 0, F.col("source")).otherwise(F.lit("2024-01-05")).alias("seen")
    )
    more = Currentness().run(docs, {}, Context(as_of="2024-01-20")).issues
    return (
        issues.unionByName(more)
        .where("rule_key = 'parse_quality_check'")
        .select("severity", "column_name", "fingerprint")
    )


def _parse_issue_sql(column: str, source: str) -> str:
    return (
        f"SELECT 'low' AS severity, '{column}' AS column_name, "
        + fingerprint_sql(f"'currentness|{column}||parse_quality_check'")
        + f" AS fingerprint FROM {source} WHERE rate < 0.8 AND n > 10"
    )


PARSE_RATE_SQL = with_views(
    f"{PARSED}, {FRESH}, b AS (SELECT count(*) AS n, count(*) FILTER (WHERE doc_id % 3 <> 0) * 1.0 / count(*) AS rate FROM docs_labels) "
    + _parse_issue_sql("date_text", "a") + " UNION ALL " + _parse_issue_sql("seen", "b"),
    "docs_labels",
)


def currentness_score(spark, sf_dir):
    dated = Currentness().run(_dated(spark, sf_dir), CURRENT, Context(as_of=AS_OF)).score
    events = Currentness().run(table(spark, sf_dir, "events"), {}, Context(as_of="2024-03-15 00:00:00")).score
    undated = Currentness().run(table(spark, sf_dir, "part"), {}, Context(as_of=AS_OF)).score
    parts = [
        dated.withColumn("source", F.lit("orders")),
        events.withColumn("source", F.lit("events")),
        undated.withColumn("source", F.lit("part")),
    ]
    return rounded(parts[0].unionByName(parts[1]).unionByName(parts[2]).select("source", "score"), "score")


CURRENT_SCORE_SQL = (
    f"WITH {PARSED}, {FRESH}, v AS (SELECT CAST(floor(epoch(TIMESTAMP '2024-03-15 00:00:00' - max(ts)) / 86400) AS BIGINT) AS age FROM events) "
    f"SELECT 'orders' AS source, round({_FRESHNESS}, 6) + 0.0 AS score FROM a UNION ALL "
    f"SELECT 'events', round({_FRESHNESS}, 6) + 0.0 FROM v UNION ALL SELECT 'part', avg(1.0) FROM part"
)

# ---- diversity ------------------------------------------------------------------------------

DIVERSITY = {
    "columns": {
        "role": {"expected_values": ["user", "assistant", "system", "tool", "critic"], "min_representation": 0.06},
        "turn": {"type": "numeric", "expected_range": [0, 40], "num_bins": 8},
    },
    "threshold": 0.9,
}
ROLES = "e(value) AS (SELECT unnest(['user', 'assistant', 'system', 'tool', 'critic']))"
ROLE_SHARES = (
    f"{ROLES}, r AS (SELECT e.value, count(c.role) AS cnt, count(c.role) * 1.0 / (SELECT count(role) FROM conversations) AS p "
    "FROM e LEFT JOIN conversations c ON c.role = e.value GROUP BY 1), "
    "s AS (SELECT (count(*) FILTER (WHERE cnt > 0 AND p >= 0.06) + 0.5 * count(*) FILTER (WHERE cnt > 0 AND p < 0.06)) / count(*) AS score FROM r)"
)
RANGE_BINS = (
    "b AS (SELECT i AS bin, i * 5.0 AS lo, (i + 1) * 5.0 AS hi, "
    "(SELECT count(*) FROM conversations WHERE least(greatest(turn, 0), 40) >= i * 5.0 AND (least(greatest(turn, 0), 40) < (i + 1) * 5.0 OR i = 7)) AS cnt "
    "FROM (SELECT unnest(range(8)) AS i))"
)


def _diversity(spark, sf_dir):
    return Diversity().run(table(spark, sf_dir, "conversations"), DIVERSITY)


def categorical_diversity(spark, sf_dir):
    columns = _diversity(spark, sf_dir).columns.where("type = 'categorical'")
    return rounded(columns.select("column_name", F.col("n_expected").cast("bigint").alias("n_expected"), "n_present", "n_under", "score", "below_threshold"), "score")


CATEGORICAL_SQL = (
    f"WITH {ROLE_SHARES} SELECT 'role' AS column_name, count(*) AS n_expected, count(*) FILTER (WHERE cnt > 0) AS n_present, "
    "count(*) FILTER (WHERE cnt > 0 AND p < 0.06) AS n_under, (SELECT round(score, 6) + 0.0 FROM s) AS score, (SELECT score < 0.9 FROM s) AS below_threshold FROM r"
)


def diversity_value_issues(spark, sf_dir):
    issues = _diversity(spark, sf_dir).issues.where("rule_key <> 'diversity_low_range_coverage'")
    return issues.select("severity", "column_name", "rule_key", "fingerprint")


_DIVERSITY_SEVERITY = "CASE WHEN {s} <= 0.2 THEN 'critical' WHEN {s} <= 0.4 THEN 'high' WHEN {s} < 0.9 THEN 'medium' ELSE 'low' END"
VALUE_ISSUE_SQL = (
    f"WITH {ROLE_SHARES} SELECT {_DIVERSITY_SEVERITY.replace('{s}', 'score')} AS severity, 'role' AS column_name, 'diversity_missing_value' AS rule_key, "
    + fingerprint_sql("concat('diversity|role||diversity_missing_value|diversity_type=missing_value|expected_value=', value)")
    + " AS fingerprint FROM r, s WHERE cnt = 0 UNION ALL SELECT CASE WHEN round(p, 6) < 0.03 THEN 'medium' ELSE 'low' END, 'role', 'diversity_underrepresented', "
    + fingerprint_sql("concat('diversity|role||diversity_underrepresented|diversity_type=underrepresented|expected_value=', value)")
    + " FROM r WHERE cnt > 0 AND p < 0.06"
)


def numeric_diversity(spark, sf_dir):
    metric, rows = Diversity(), table(spark, sf_dir, "conversations")
    wide = Shared.lazily(metric, rows, DIVERSITY, Context()).wide
    return metric.bins(rows, wide, DIVERSITY).select(
        "column_name", F.col("bin").cast("bigint").alias("bin"), "low", "high", "cnt"
    )


NUMERIC_DIVERSITY_SQL = f"WITH {RANGE_BINS} SELECT 'turn' AS column_name, bin, CAST(lo AS DOUBLE) AS low, CAST(hi AS DOUBLE) AS high, cnt FROM b"


def range_coverage_issues(spark, sf_dir):
    issues = _diversity(spark, sf_dir).issues.where("rule_key = 'diversity_low_range_coverage'")
    return issues.select("severity", "column_name", "fingerprint", F.col("details")["empty_bins"].alias("empty_bins"))


RANGE_ISSUE_SQL = (
    f"WITH {RANGE_BINS}, s AS (SELECT count(*) FILTER (WHERE cnt > 0) / 8.0 AS score FROM b) "
    f"SELECT {_DIVERSITY_SEVERITY.replace('{s}', 's.score')} AS severity, 'turn' AS column_name, "
    + fingerprint_sql("'diversity|turn||diversity_low_range_coverage|diversity_type=low_range_coverage'")
    + " AS fingerprint, (SELECT string_agg(printf('[%.1f, %.1f)', lo, hi), ' ' ORDER BY bin) FROM "
    "(SELECT * FROM b WHERE cnt = 0 ORDER BY bin LIMIT 5)) AS empty_bins FROM s WHERE s.score < 0.9"
)


def diversity_score(spark, sf_dir):
    asked = _diversity(spark, sf_dir)
    none = Diversity().run(table(spark, sf_dir, "conversations"), {}).score
    counted = asked.score.withColumn("mode", F.lit("expected")).unionByName(none.withColumn("mode", F.lit("none")))
    below = asked.columns.agg(F.count_if("below_threshold").alias("n_below"))
    return rounded(counted.select("mode", "score", below.scalar().alias("n_below")), "score")


DIVERSITY_SCORE_SQL = (
    f"WITH {ROLE_SHARES}, {RANGE_BINS}, t AS (SELECT count(*) FILTER (WHERE cnt > 0) / 8.0 AS score FROM b), "
    "u AS (SELECT score FROM s UNION ALL SELECT score FROM t) "
    "SELECT 'expected' AS mode, round(avg(score), 6) + 0.0 AS score, count(*) FILTER (WHERE score < 0.9) AS n_below FROM u "
    "UNION ALL SELECT 'none', NULL, count(*) FILTER (WHERE score < 0.9) FROM u"
)

QUERIES = [
    Query("completeness_score", "Q1", completeness_score, COMPLETENESS_SCORE_SQL),
    Query("completeness_dataset_issue", "Q2 K6a", completeness_dataset_issue, DATASET_ISSUE_SQL),
    Query("completeness_column_issues", "Q3 K6a", completeness_column_issues, COLUMN_ISSUE_SQL),
    Query("row_uniqueness", "Q4", row_uniqueness, ROW_UNIQUENESS_SQL),
    Query("column_variability", "Q5", column_variability, VARIABILITY_SQL),
    Query("low_variability_issues", "Q6", low_variability_issues, LOW_VARIABILITY_SQL),
    Query("duplicate_rows_issue", "Q7 K6d", duplicate_rows_issue, DUPLICATE_ISSUE_SQL),
    Query("expected_unique_columns", "Q8", expected_unique_columns, EXPECTED_UNIQUE_SQL),
    Query("uniqueness_score", "Q9", uniqueness_score, UNIQUENESS_SCORE_SQL),
    Query("balance_targets", "Q21", balance_targets, TARGET_SQL),
    Query("balance_index", "Q22", balance_index, BALANCE_SQL),
    Query("balance_frequency_table", "Q23", balance_frequency_table, FREQUENCY_TABLE_SQL),
    Query("dominant_minority_classes", "Q24", dominant_minority, DOMINANT_SQL),
    Query("dominant_class_issues", "Q25 K6g", dominant_class_issues, DOMINANT_ISSUE_SQL),
    Query("minority_class_issues", "Q26 K6g", minority_class_issues, MINORITY_ISSUE_SQL),
    Query("expected_distribution", "Q27", expected_distribution, CONFORMITY_SQL),
    Query("expected_distribution_issues", "Q27 K6g", expected_distribution_issues, DEVIATION_SQL),
    Query("class_balance_score", "Q28", class_balance_score, BALANCE_SCORE_SQL),
    Query("date_columns", "Q29", date_columns, DATE_COLUMN_SQL),
    Query("freshness", "Q30", freshness, FRESHNESS_SQL),
    Query("stale_issues", "Q31 K6h", stale_issues, STALE_SQL),
    Query("parse_rate_issues", "Q32", parse_rate_issues, PARSE_RATE_SQL),
    Query("currentness_score", "Q33", currentness_score, CURRENT_SCORE_SQL),
    Query("categorical_diversity", "Q34", categorical_diversity, CATEGORICAL_SQL),
    Query("diversity_value_issues", "Q35 K6i", diversity_value_issues, VALUE_ISSUE_SQL),
    Query("numeric_diversity", "Q36", numeric_diversity, NUMERIC_DIVERSITY_SQL),
    Query("range_coverage_issues", "Q37 K6i", range_coverage_issues, RANGE_ISSUE_SQL),
    Query("diversity_score", "Q38", diversity_score, DIVERSITY_SCORE_SQL),
]
