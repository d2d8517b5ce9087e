"""Formats, rules and the rows behind them."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablegauge.functions.patterns import VALUE_FORMATS
from tablegauge.operators import drilldown
from tablegauge.operators.findings import Context, Shared
from tablegauge.operators.rules import LogicalConsistency
from tablegauge.operators.syntax import SyntacticAccuracy
from tablegauge.queries.support import (
    FLAT_ISSUE,
    Query,
    fingerprint_sql,
    ratio_severity_sql,
    rounded,
    run_sql,
    table,
    view,
    with_views,
)

# ---- syntactic accuracy ---------------------------------------------------------------------

DETECT_VIEW = """
    SELECT o_orderkey, concat('user', CAST(o_custkey AS STRING), CASE WHEN o_orderkey % 10 = 0 THEN '' ELSE '@example.com' END) AS mail,
           CAST(o_custkey + 10000 AS STRING) AS zip, o_orderpriority,
           CASE WHEN o_orderkey % 4 = 0 THEN 'bad' ELSE '2024-01-05' END AS day
    FROM orders"""
DETECT_COLUMNS = ["mail", "zip", "o_orderpriority", "day"]


def _detectable(spark, sf_dir):
    return run_sql(spark, sf_dir, DETECT_VIEW)


def format_detection(spark, sf_dir):
    metric, rows = SyntacticAccuracy(), _detectable(spark, sf_dir)
    wide = Shared.lazily(metric, rows, {}, Context()).wide
    detected = metric.detection(rows, wide, {}, Context())
    return rounded(
        detected.select("column_name", "expected_type", "match_rate", "n_qualifying"), "match_rate"
    )


DETECT_RATES = "r AS (" + " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, '{name}' AS expected_type, "
    f"count(*) FILTER (WHERE regexp_matches({c}, '^(?:{p})')) * 1.0 / count({c}) AS rate FROM t"
    for c in DETECT_COLUMNS
    for name, p in VALUE_FORMATS.items()
) + "), q AS (SELECT *, count(*) OVER (PARTITION BY column_name) AS n FROM r WHERE rate >= 0.85)"
DETECT_SQL = (
    f"WITH t AS ({DETECT_VIEW}), {DETECT_RATES} SELECT column_name, expected_type, round(rate, 6) + 0.0 AS match_rate, "
    "n AS n_qualifying FROM q"
)


def mixed_formats(spark, sf_dir):
    metric, rows = SyntacticAccuracy(), _detectable(spark, sf_dir)
    issues = metric.run(rows, {}, Context(id_columns=["o_orderkey"])).issues.where("issue_type = 'mixed_format'")
    return issues.select("severity", "column_name", "fingerprint", F.col("details")["detected_types"].alias("formats"))


MIXED_SQL = (
    f"WITH t AS ({DETECT_VIEW}), {DETECT_RATES} SELECT 'medium' AS severity, column_name, "
    + fingerprint_sql("concat('syntactic_accuracy|', column_name, '||type_conformance_check|expected_type=mixed_format')")
    + " AS fingerprint, string_agg(concat(expected_type, ' ', CAST(CAST(round(rate * 100) AS BIGINT) AS VARCHAR), '%'), ', ' "
    "ORDER BY rate DESC, concat(expected_type, ' ', CAST(CAST(round(rate * 100) AS BIGINT) AS VARCHAR), '%')) AS formats FROM q WHERE n > 1 GROUP BY column_name"
)

CHECKS = {
    "columns": [
        {"column": "url", "expected_type": "url"},
        {"column": "html", "expected_type": "html", "pattern": r"^<!DOCTYPE html><html lang=.en."},
        {"column": "no_such_column", "expected_type": "url"},
    ],
    "custom_patterns": {"page_id": r"^[1-9]\d*$", "url": "^never used"},
    "auto_detect_types": False,
}
CHECK_LIST = [
    ("url", "url", VALUE_FORMATS["url"]),
    ("html", "html", r"^<!DOCTYPE html><html lang=.en."),
    ("page_id", "custom", r"^[1-9]\d*$"),
]


def conformance(spark, sf_dir):
    columns = SyntacticAccuracy().run(table(spark, sf_dir, "pages"), CHECKS, Context(id_columns=["page_id"])).columns
    return rounded(
        columns.select("column_name", "expected_type", "n_checked", "n_conforming", "n_invalid", "conformance"),
        "conformance",
    )


CONFORMANCE = "k AS (" + " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, '{kind}' AS expected_type, '{p}' AS pattern, count({c}) AS n, "
    f"count(*) FILTER (WHERE regexp_matches(CAST({c} AS VARCHAR), '^(?:{p})')) AS ok FROM pages"
    for c, kind, p in CHECK_LIST
) + ")"
CONFORMANCE_SQL = (
    f"WITH {CONFORMANCE} SELECT column_name, expected_type, n AS n_checked, ok AS n_conforming, n - ok AS n_invalid, "
    "round(ok * 1.0 / n, 6) + 0.0 AS conformance FROM k"
)


def invalid_samples(spark, sf_dir):
    """Up to five offending values per column, in id order."""
    metric, rows = SyntacticAccuracy(), view(spark, sf_dir, "dirty_orders")
    context = Context(id_columns=["o_orderkey"])
    checks = rows.sparkSession.createDataFrame(
        [("o_orderpriority", "^[0-9]-"), ("o_totalprice", r"^\d+(\.\d+)?$")], "column_name string, pattern string"
    )
    samples = metric.invalid_samples(rows, checks, context)
    return samples.select("column_name", F.array_join("sample", ";").alias("sample"))


SAMPLE_SQL = with_views(
    "v AS (SELECT 'o_orderpriority' AS column_name, o_orderkey, o_orderpriority AS value FROM dirty_orders WHERE NOT regexp_matches(o_orderpriority, '^[0-9]-') "
    "UNION ALL SELECT 'o_totalprice', o_orderkey, CASE WHEN o_totalprice = floor(o_totalprice) THEN CAST(CAST(o_totalprice AS BIGINT) AS VARCHAR) ELSE CAST(o_totalprice AS VARCHAR) END "
    "FROM dirty_orders WHERE o_totalprice < 0), "
    "w AS (SELECT * FROM v QUALIFY row_number() OVER (PARTITION BY column_name ORDER BY o_orderkey) <= 5) "
    "SELECT column_name, string_agg(value, ';' ORDER BY o_orderkey) AS sample FROM w GROUP BY 1",
    "dirty_orders",
)


def conformance_issues(spark, sf_dir):
    issues = SyntacticAccuracy().run(table(spark, sf_dir, "pages"), CHECKS, Context(id_columns=["page_id"])).issues
    return issues.select(*FLAT_ISSUE)


CONFORMANCE_ISSUE_SQL = (
    f"WITH {CONFORMANCE} SELECT 'syntactic_accuracy' AS issue_type, {ratio_severity_sql('ok * 1.0 / n', 0.95)} AS severity, column_name, "
    "n - ok AS affected_row_count, "
    + fingerprint_sql("concat('syntactic_accuracy|', column_name, '||type_conformance_check|expected_type=', expected_type, '|pattern=', lower(pattern))")
    + " AS fingerprint FROM k WHERE ok * 1.0 / n < 0.95"
)


def syntactic_score(spark, sf_dir):
    checked = SyntacticAccuracy().run(table(spark, sf_dir, "pages"), CHECKS, Context(id_columns=["page_id"])).score
    detected = SyntacticAccuracy().run(_detectable(spark, sf_dir), {}, Context(id_columns=["o_orderkey"])).score
    both = checked.withColumn("source", F.lit("pages")).unionByName(detected.withColumn("source", F.lit("orders")))
    return rounded(both.select("source", "score"), "score")


SYNTACTIC_SCORE_SQL = (
    f"WITH t AS ({DETECT_VIEW}), {CONFORMANCE}, {DETECT_RATES} SELECT 'pages' AS source, round(avg(ok * 1.0 / n), 6) + 0.0 AS score FROM k "
    "UNION ALL SELECT 'orders', round(coalesce(avg(rate), 1.0), 6) + 0.0 FROM q WHERE n = 1"
)

# ---- rules ----------------------------------------------------------------------------------

RULES = [
    {"name": "positive price", "type": "violation", "expression": "o_totalprice <= 0"},
    {"name": "open orders cost", "type": "if_then", "condition": "o_orderstatus == 'O'", "assertion": "o_totalprice >= 250000"},
    {"name": "urgent is open", "type": "if_then", "expression": "IF o_orderpriority = '1-URGENT' THEN not (o_orderstatus = 'F')"},
    {"name": "nothing in scope", "type": "if_then", "condition": "o_orderkey < 0", "assertion": "o_totalprice > 0"},
    {"name": "missing column", "type": "violation", "expression": "no_such_column > 1"},
    {"name": "forbidden", "type": "violation", "expression": "reflect('java.lang.System', 'lineSeparator') = 'x'"},
    {"name": "empty", "type": "violation", "expression": ""},
]
RULE_IDENTITY = [
    "o_totalprice <= 0",
    "o_orderstatus == 'O' => o_totalprice >= 250000",
    "IF o_orderpriority = '1-URGENT' THEN not (o_orderstatus = 'F')",
    "o_orderkey < 0 => o_totalprice > 0",
    "no_such_column > 1",
    "reflect('java.lang.System', 'lineSeparator') = 'x'",
]


def _rules(spark, sf_dir):
    context = Context(id_columns=["o_orderkey"], sensitive=["o_orderdate"])
    return LogicalConsistency().run(view(spark, sf_dir, "dirty_orders"), {"rules": RULES}, context)


RULE_COUNTS = (
    "r AS (SELECT 0 AS rule_index, count(*) AS scope, count(*) FILTER (WHERE o_totalprice <= 0) AS bad FROM dirty_orders UNION ALL "
    "SELECT 1, count(*) FILTER (WHERE o_orderstatus = 'O'), count(*) FILTER (WHERE o_orderstatus = 'O' AND NOT coalesce(o_totalprice >= 250000, false)) FROM dirty_orders UNION ALL "
    "SELECT 2, count(*) FILTER (WHERE o_orderpriority = '1-URGENT'), count(*) FILTER (WHERE o_orderpriority = '1-URGENT' AND o_orderstatus = 'F') FROM dirty_orders UNION ALL "
    "SELECT 3, 0, 0 FROM (SELECT 1))"
)


def violation_rule(spark, sf_dir):
    columns = _rules(spark, sf_dir).columns.where("type = 'violation' AND error IS NULL AND NOT blocked")
    return rounded(columns.select("name", "n_scope", "n_violations", "compliance", "affected_columns"), "compliance")


VIOLATION_SQL = with_views(
    f"{RULE_COUNTS} SELECT 'positive price' AS name, scope AS n_scope, bad AS n_violations, "
    "round(1 - bad * 1.0 / scope, 6) + 0.0 AS compliance, 'o_totalprice' AS affected_columns FROM r WHERE rule_index = 0",
    "dirty_orders",
)


def if_then_rules(spark, sf_dir):
    columns = _rules(spark, sf_dir).columns.where("type = 'if_then'")
    return rounded(
        columns.select(F.col("rule_index").cast("bigint").alias("rule_index"), "n_scope", "n_violations", "compliance"),
        "compliance",
    )


IF_THEN_SQL = with_views(
    f"{RULE_COUNTS} SELECT CAST(rule_index AS BIGINT) AS rule_index, CAST(scope AS BIGINT) AS n_scope, CAST(bad AS BIGINT) AS n_violations, "
    "round(CASE WHEN scope = 0 THEN 1.0 ELSE 1 - bad * 1.0 / scope END, 6) + 0.0 AS compliance FROM r WHERE rule_index > 0",
    "dirty_orders",
)


def rule_issues(spark, sf_dir):
    issues = _rules(spark, sf_dir).issues
    shown = F.get_json_object(F.element_at("sample", 1), "$.o_orderkey").cast("bigint")
    return issues.select(
        "severity", "column_name", "affected_row_count", "fingerprint",
        F.size("sample").cast("bigint").alias("n_sampled"), shown.alias("first_key"),
    )


def _rule_fp(index: int) -> str:
    text = f"logical_consistency|||cross_field_check|expression={RULE_IDENTITY[index].lower()}"
    return fingerprint_sql("'" + text.replace("'", "''") + "'")


_RULE_HITS = {
    0: ("o_totalprice", "o_totalprice <= 0"),
    1: ("o_orderstatus,o_totalprice", "o_orderstatus = 'O' AND NOT coalesce(o_totalprice >= 250000, false)"),
    2: ("o_orderstatus,o_orderpriority", "o_orderpriority = '1-URGENT' AND o_orderstatus = 'F'"),
}
RULE_ISSUE_SQL = with_views(
    f"{RULE_COUNTS} "
    + " UNION ALL ".join(
        f"SELECT {ratio_severity_sql('1 - bad * 1.0 / scope', 1.0)} AS severity, '{columns}' AS column_name, bad AS affected_row_count, "
        f"{_rule_fp(i)} AS fingerprint, least(bad, 5) AS n_sampled, (SELECT min(o_orderkey) FROM dirty_orders WHERE {hit}) AS first_key "
        f"FROM r WHERE rule_index = {i} AND bad > 0"
        for i, (columns, hit) in _RULE_HITS.items()
    )
    + f" UNION ALL SELECT 'high', NULL, NULL, {_rule_fp(5)}, NULL, NULL FROM r WHERE rule_index = 3",
    "dirty_orders",
)


def consistency_score(spark, sf_dir):
    scored = _rules(spark, sf_dir).score.withColumn("mode", F.lit("rules"))
    none = LogicalConsistency().run(table(spark, sf_dir, "orders"), {}).score.withColumn("mode", F.lit("none"))
    return rounded(scored.unionByName(none).select("mode", "score"), "score")


CONSISTENCY_SQL = with_views(
    f"{RULE_COUNTS} SELECT 'rules' AS mode, round(avg(CASE WHEN scope = 0 THEN 1.0 ELSE 1 - bad * 1.0 / scope END), 6) + 0.0 AS score FROM r "
    "UNION ALL SELECT 'none', NULL FROM r WHERE rule_index = 3",
    "dirty_orders",
)

# ---- drill-down -----------------------------------------------------------------------------


def missing_rows(spark, sf_dir):
    rows = drilldown.missing_rows(
        view(spark, sf_dir, "dirty_orders"), "o_orderpriority", {"presets": ["na", "dash"]}
    )
    return rows.select("o_orderkey", "o_orderpriority", "o_totalprice")


MISSING_SQL = with_views(
    "SELECT o_orderkey, o_orderpriority, o_totalprice FROM dirty_orders WHERE o_orderpriority IS NULL OR o_orderpriority IN ('N/A', '-')",
    "dirty_orders",
)


def format_violations(spark, sf_dir):
    rows = drilldown.format_violations(view(spark, sf_dir, "dirty_orders"), "o_orderpriority", "^[0-9]-")
    return rows.select("o_orderkey", F.col(drilldown.INVALID_VALUE).alias("invalid_value"))


FORMAT_VIOLATION_SQL = with_views(
    "SELECT o_orderkey, o_orderpriority AS invalid_value FROM dirty_orders WHERE o_orderpriority IS NOT NULL AND NOT regexp_matches(o_orderpriority, '^[0-9]-')",
    "dirty_orders",
)


def rule_violations(spark, sf_dir):
    orders = view(spark, sf_dir, "dirty_orders")
    a = drilldown.rule_violations(orders, RULES[0]).select(F.lit("violation").alias("rule"), "o_orderkey")
    b = drilldown.rule_violations(orders, RULES[1]).select(F.lit("if_then").alias("rule"), "o_orderkey")
    return a.unionByName(b)


RULE_VIOLATION_SQL = with_views(
    f"SELECT 'violation' AS rule, o_orderkey FROM dirty_orders WHERE {_RULE_HITS[0][1]} UNION ALL "
    f"SELECT 'if_then', o_orderkey FROM dirty_orders WHERE {_RULE_HITS[1][1]}",
    "dirty_orders",
)


def text_search(spark, sf_dir):
    customer = table(spark, sf_dir, "customer")
    literal = drilldown.search(customer, "Build").select(F.lit("literal").alias("mode"), "c_custkey")
    regex = drilldown.search(customer, "^machi|00[0-9]7$", regex=True).select(F.lit("regex").alias("mode"), "c_custkey")
    number = drilldown.search(customer, "-99").select(F.lit("number").alias("mode"), "c_custkey")
    return literal.unionByName(regex).unionByName(number)


_SEARCHED = [f"lower(CAST({c} AS VARCHAR))" for c in ("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment")]
SEARCH_SQL = " UNION ALL ".join(
    f"SELECT '{mode}' AS mode, c_custkey FROM customer WHERE " + " OR ".join(hit.format(c) for c in _SEARCHED)
    for mode, hit in (("literal", "contains({}, 'build')"), ("regex", "regexp_matches({}, '^machi|00[0-9]7$')"), ("number", "contains({}, '-99')"))
)


def paging(spark, sf_dir):
    """The second page of the offending rows of a rule, with the page facts beside each row."""
    rows, info = drilldown.violations(
        view(spark, sf_dir, "dirty_orders"),
        {"metric": "logical_consistency", "rule": RULES[1]},
        ["o_orderkey"],
        number=2,
        size=50,
        sensitive=["o_custkey"],
    )
    facts = info.select(F.struct("*")).scalar()
    return rows.select("o_orderkey", "o_custkey", facts.alias("f")).select(
        "o_orderkey", "o_custkey", F.col("f.total").alias("total"), F.col("f.total_pages").alias("total_pages"),
        F.col("f.has_next").alias("has_next"), F.col("f.has_prev").alias("has_prev"),
    )


PAGING_SQL = with_views(
    f"v AS (SELECT o_orderkey FROM dirty_orders WHERE {_RULE_HITS[1][1]}), t AS (SELECT count(*) AS total FROM v) "
    "SELECT o_orderkey, '***' AS o_custkey, total, greatest(1, CAST(ceil(total / 50.0) AS BIGINT)) AS total_pages, "
    "2 < ceil(total / 50.0) AS has_next, true AS has_prev FROM v, t ORDER BY o_orderkey LIMIT 50 OFFSET 50",
    "dirty_orders",
)


def keyset_paging(spark, sf_dir):
    """The same rows reached by the last key of the page before."""
    rows = drilldown.rule_violations(view(spark, sf_dir, "dirty_orders"), RULES[1]).select("o_orderkey", "o_totalprice")
    return drilldown.page(rows, ["o_orderkey"], size=50, after=[100])


KEYSET_SQL = with_views(
    f"SELECT o_orderkey, o_totalprice FROM dirty_orders WHERE {_RULE_HITS[1][1]} AND o_orderkey > 100 ORDER BY 1 LIMIT 50",
    "dirty_orders",
)

QUERIES = [
    Query("format_detection", "Q11", format_detection, DETECT_SQL),
    Query("mixed_formats", "Q12", mixed_formats, MIXED_SQL),
    Query("conformance", "Q13 C12", conformance, CONFORMANCE_SQL),
    Query("invalid_samples", "Q13", invalid_samples, SAMPLE_SQL),
    Query("conformance_issues", "Q14 K6c K6e", conformance_issues, CONFORMANCE_ISSUE_SQL),
    Query("syntactic_score", "Q14", syntactic_score, SYNTACTIC_SCORE_SQL),
    Query("violation_rule", "Q15", violation_rule, VIOLATION_SQL),
    Query("if_then_rules", "Q16", if_then_rules, IF_THEN_SQL),
    Query("rule_issues", "Q18 K6f", rule_issues, RULE_ISSUE_SQL),
    Query("consistency_score", "Q20", consistency_score, CONSISTENCY_SQL),
    Query("missing_rows", "L1", missing_rows, MISSING_SQL),
    Query("format_violations", "L2", format_violations, FORMAT_VIOLATION_SQL),
    Query("rule_violations", "L3", rule_violations, RULE_VIOLATION_SQL),
    Query("text_search", "L4", text_search, SEARCH_SQL),
    Query("paging", "L5", paging, PAGING_SQL),
    Query("keyset_paging", "L5", keyset_paging, KEYSET_SQL),
]
