"""What the registered queries share: tables, derived tables, and SQL text helpers."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablegauge.session import apply_session_settings

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem",
    "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)


@dataclass
class Query:
    """`operators` lists the ids of the inventory rows a query shows."""

    name: str
    operators: str
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None = None


# Derived tables, in SQL both engines read. The driver tables hold no nulls and no history, so
# nulls, bad values, runs, issues and version trees are derived from every row of them.
VIEWS = {
    "dirty_orders": """
        SELECT o_orderkey, o_custkey, o_orderstatus,
               CASE WHEN o_orderkey % 13 = 0 THEN NULL
                    WHEN o_orderkey % 17 = 0 THEN -o_totalprice ELSE o_totalprice END AS o_totalprice,
               o_orderdate,
               CASE WHEN o_orderkey % 7 = 0 THEN NULL
                    WHEN o_orderkey % 11 = 0 THEN 'N/A'
                    WHEN o_orderkey % 19 = 0 THEN '-' ELSE o_orderpriority END AS o_orderpriority
        FROM orders""",
    "docs_labels": """
        SELECT d.doc_id, d.text, d.lang, d.source, d.n_chars, l.quality, l.toxic
        FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""",
    "order_facts": """
        SELECT o_orderstatus, o_orderpriority, o_custkey % 100 AS bucket FROM orders""",
    "runs": """
        SELECT o_orderkey AS run_id, o_custkey AS dataset_id, o_custkey % 25 AS project_id,
               CASE WHEN o_orderstatus IN ('F', 'O') THEN 'COMPLETED'
                    WHEN o_orderkey % 2 = 0 THEN 'PENDING' ELSE 'FAILED' END AS status,
               CASE WHEN o_orderstatus IN ('F', 'O') THEN o_totalprice / 5000.0 END AS quality_score,
               CASE WHEN o_totalprice / 5000.0 < 70 THEN 'FAILED'
                    WHEN o_totalprice / 5000.0 < 80 THEN 'WARNING' ELSE 'PASSED' END AS gate_status,
               o_orderkey % 40 AS total_issues, o_orderkey % 3 AS critical_issues,
               o_orderkey % 11 AS new_issues, o_orderkey % 5 AS fixed_issues,
               CASE WHEN o_orderkey % 10 = 3 THEN o_orderkey - 1 END AS baseline_run_id,
               o_orderdate AS created_at, o_orderdate AS updated_at,
               CASE WHEN o_orderstatus IN ('F', 'O') THEN o_orderdate END AS completed_at
        FROM orders""",
    "issues": """
        SELECT l_orderkey AS run_id,
               ((l_orderkey * 100000 + l_partkey) * 10000 + l_suppkey) * 10 + l_linenumber AS issue_id,
               CASE WHEN l_returnflag = 'A' THEN 'completeness'
                    WHEN l_returnflag = 'N' THEN 'uniqueness' ELSE 'outliers' END AS issue_type,
               CASE WHEN l_quantity >= 45 THEN 'critical' WHEN l_quantity >= 30 THEN 'major'
                    WHEN l_quantity >= 15 THEN 'minor' ELSE 'info' END AS severity,
               CASE WHEN l_quantity >= 45 THEN 'critical' WHEN l_quantity >= 30 THEN 'high'
                    WHEN l_quantity >= 15 THEN 'medium' WHEN l_quantity >= 3 THEN 'low'
                    ELSE 'unknown' END AS level,
               concat('finding on part ', CAST(l_partkey % 20 AS STRING),
                      CASE WHEN l_partkey % 5 = 0 THEN ' critical' ELSE '' END) AS description,
               CAST(l_linenumber AS STRING) AS actual_value,
               CAST(floor(l_quantity) AS BIGINT) AS affected_row_count,
               CASE WHEN l_linenumber = 7 THEN NULL WHEN l_linenumber = 6 THEN ''
                    ELSE concat(l_returnflag, l_linestatus, '-', CAST(l_partkey % 50 AS STRING))
               END AS fingerprint
        FROM lineitem""",
    "datasets": """
        SELECT c_custkey AS dataset_id, c_custkey % 25 AS project_id, c_name AS dataset_name,
               CASE WHEN c_custkey % 16 = 0 THEN NULL
                    WHEN c_custkey % 16 IN (5, 11) THEN c_custkey - 3
                    ELSE c_custkey - 1 END AS parent_dataset_id,
               CAST(c_custkey % 16 + 1 AS INT) AS version,
               c_custkey % 16 = 15 AS is_latest,
               CAST(floor(c_acctbal) AS BIGINT) AS row_count,
               CAST(5 + c_custkey % 7 AS INT) AS column_count,
               split(concat('id,name,c', CAST(c_custkey % 3 AS STRING), ',d',
                            CAST(c_custkey % 4 AS STRING)), ',') AS column_names,
               CASE WHEN c_custkey % 2 = 0 THEN TIMESTAMP '2024-01-02 00:00:00'
                    ELSE TIMESTAMP '2024-01-01 00:00:00' END AS created_at
        FROM customer""",
    "projects": """
        SELECT CAST(n_nationkey AS BIGINT) AS project_id, n_name AS project_name FROM nation""",
    "metric_scores": """
        SELECT l_orderkey AS run_id,
               CASE WHEN l_linenumber IN (1, 5) THEN 'completeness' WHEN l_linenumber IN (2, 6) THEN 'uniqueness'
                    WHEN l_linenumber = 3 THEN 'outliers' ELSE 'currentness' END AS metric,
               CASE WHEN max(l_discount) < 0.02 THEN NULL ELSE max(l_discount) * 10 END AS score
        FROM lineitem GROUP BY 1, 2""",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    apply_session_settings(spark)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A derived table; Spark reads only the columns its SQL names."""
    return run_sql(spark, sf_dir, VIEWS[name])


def run_sql(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    for name in TABLES:
        if f" {name}" in sql:
            table(spark, sf_dir, name).createOrReplaceTempView(name)
    return spark.sql(sql)


def with_views(sql: str, *names: str) -> str:
    """SQL with the named derived tables in front of it, joined to its own `name AS (` tables."""
    head = ", ".join(f"{name} AS ({VIEWS[name].strip()})" for name in names)
    own_tables = re.match(r"\w+(\([^)]*\))? AS \(", sql)
    return f"WITH RECURSIVE {head}{',' if own_tables else ''} {sql}"


def union_sql(columns: list[str], template: str) -> str:
    """One SELECT per column; `{c}` is the column name."""
    return " UNION ALL ".join(template.replace("{c}", c) for c in columns)


def r6(column: str | Column) -> Column:
    """Rounded for comparison; adding zero turns -0.0 into 0.0."""
    value = F.col(column) if isinstance(column, str) else column
    return F.round(value, 6) + F.lit(0.0)


def rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({name: r6(name) for name in names})


def ratio_severity_sql(value: str, threshold: str | float) -> str:
    return (
        f"CASE WHEN {threshold} - ({value}) <= 0 THEN 'low' WHEN ({value}) < 0.5 THEN 'critical' "
        f"WHEN ({value}) < 0.7 OR {threshold} - ({value}) > 0.15 THEN 'high' "
        f"WHEN {threshold} - ({value}) > 0.05 THEN 'medium' ELSE 'low' END"
    )


def ladder_sql(value: str, critical: float, high: float, medium: float) -> str:
    return (
        f"CASE WHEN ({value}) >= {critical} THEN 'critical' WHEN ({value}) >= {high} THEN 'high' "
        f"WHEN ({value}) >= {medium} THEN 'medium' ELSE 'low' END"
    )


def fingerprint_sql(text: str) -> str:
    """`text` is an SQL expression of the hashed text."""
    return f"substr(sha256({text}), 1, 16)"


def scratch_folder(spark: SparkSession) -> str:
    """A new folder below the session's shared checkpoint folder."""
    from tablegauge.session import checkpoint_folder

    return f"{checkpoint_folder(spark)}/tablegauge-{uuid.uuid4().hex}"


FLAT_ISSUE = ["issue_type", "severity", "column_name", "affected_row_count", "fingerprint"]
