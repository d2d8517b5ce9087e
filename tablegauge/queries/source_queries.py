"""Sources and sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablegauge.operators.frequency import value_frequency
from tablegauge.operators.profiling import run_column_metrics
from tablegauge.queries.support import Query, r6, run_sql, scratch_folder, table, union_sql, view, with_views
from tablegauge.session import checkpointed
from tablegauge.sources import csv_files, sinks, tables
from tablegauge.sources.run_store import RunStore

TEXT_ORDERS = """
    SELECT CAST(o_orderkey AS STRING) AS key_text,
           CASE WHEN o_orderkey % 9 = 0 THEN 'NA' ELSE CAST(o_custkey AS STRING) END AS cust_text,
           CASE WHEN o_orderkey % 8 = 0 THEN '' ELSE CAST(o_totalprice AS STRING) END AS price_text,
           concat('0', CAST(o_custkey AS STRING)) AS code_text,
           CASE WHEN o_orderstatus = 'F' THEN 'True' ELSE 'False' END AS flag_text,
           o_orderpriority AS priority_text
    FROM orders"""
TEXT_COLUMNS = ["key_text", "cust_text", "price_text", "code_text", "flag_text", "priority_text"]


def csv_scan(spark, sf_dir):
    """Customers written as a `;` CSV file set and read back through the sniffing reader."""
    folder = scratch_folder(spark)
    table(spark, sf_dir, "customer").write.csv(folder, header=True, sep=";")
    return csv_files.read_csv(spark, folder).withColumn("c_acctbal", r6("c_acctbal"))


def csv_quoted_lines(spark, sf_dir):
    """Documents, whose texts hold line breaks, as one CSV file read back from its splits."""
    folder = scratch_folder(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang").where("text IS NOT NULL")
    docs.coalesce(1).write.csv(folder, header=True, escape='"', quoteAll=True, lineSep="\n")
    back = csv_files.read_csv(spark, folder)
    return back.select("doc_id", "lang", F.char_length("text").alias("n_chars"), F.sha2("text", 256).alias("digest"))


def csv_type_choice(spark, sf_dir):
    text = run_sql(spark, sf_dir, TEXT_ORDERS)
    blanks = csv_files.blank_to_null(text)
    missing = blanks.agg(
        *[F.count_if(F.col(c).isNull()).alias(c) for c in TEXT_COLUMNS]
    ).unpivot([], TEXT_COLUMNS, "column_name", "n_missing")
    chosen = spark.createDataFrame(
        list(csv_files.type_choices(text).items()), "column_name string, type string"
    )
    return missing.join(F.broadcast(chosen), "column_name")


NA_SQL = ", ".join("'" + t + "'" for t in csv_files.NA_TOKENS)

CSV_TYPE_SQL = f"WITH t AS ({TEXT_ORDERS}), n AS (SELECT " + ", ".join(
    f"CASE WHEN {c} IN ({NA_SQL}) THEN NULL ELSE {c} END AS {c}" for c in TEXT_COLUMNS
) + " FROM t) " + union_sql(
    TEXT_COLUMNS,
    "SELECT '{c}' AS column_name, count(*) - count({c}) AS n_missing, "
    "CASE WHEN bool_and(regexp_full_match({c}, '[+-]?[0-9]+') AND NOT regexp_matches({c}, '^0[0-9]')) THEN 'bigint' "
    "WHEN bool_and({c} IS NULL OR (TRY_CAST({c} AS DOUBLE) IS NOT NULL AND NOT regexp_matches({c}, '^0[0-9]'))) THEN 'double' "
    "WHEN bool_and(lower({c}) IN ('true', 'false')) THEN 'boolean' ELSE 'string' END AS type FROM n",
)

DOC_COLUMNS = ["doc_id", "text", "lang", "source", "n_chars", "quality", "toxic"]


def schema_listing(spark, sf_dir):
    return tables.schema_listing(view(spark, sf_dir, "docs_labels"))


SCHEMA_SQL = with_views(
    " UNION ALL ".join(
        f"SELECT {i} AS position, '{c}' AS name, CASE any_value(typeof({c})) WHEN 'VARCHAR' THEN 'string' WHEN 'INTEGER' THEN 'int' "
        f"ELSE lower(any_value(typeof({c}))) END AS type, count(*) > count({c}) AS nullable FROM docs_labels"
        for i, c in enumerate(DOC_COLUMNS)
    ),
    "docs_labels",
)


def preview(spark, sf_dir):
    return tables.preview(table(spark, sf_dir, "customer"), ["c_custkey"], ["c_name"])


def _orders_metrics(spark, sf_dir):
    orders = view(spark, sf_dir, "dirty_orders").select("o_orderkey", "o_totalprice", "o_orderpriority")
    metrics = run_column_metrics(orders, value_frequency(orders))
    return metrics.select("column_name", "n_nulls", "n_non_nulls", "n_unique"), orders.columns


def column_metric_pivot(spark, sf_dir):
    metrics, names = _orders_metrics(spark, sf_dir)
    return sinks.column_metric_pivot(metrics, names)


PIVOT_COLUMNS = ["o_orderkey", "o_totalprice", "o_orderpriority"]


def _pivot_row(metric: str, expression: str) -> str:
    cells = ", ".join(f"CAST({expression.replace('{c}', c)} AS VARCHAR) AS {c}" for c in PIVOT_COLUMNS)
    return f"SELECT '{metric}' AS metric, {cells} FROM dirty_orders"


PIVOT_SQL = with_views(
    _pivot_row("n_nulls", "(count(*) - count({c}))")
    + " UNION ALL "
    + _pivot_row("n_non_nulls", "count({c})")
    + " UNION ALL "
    + _pivot_row("n_unique", "count(DISTINCT {c})"),
    "dirty_orders",
)


def export_round_trip(spark, sf_dir):
    """Run, metric and column results written as CSV folders, and the column table read back."""
    metrics, names = _orders_metrics(spark, sf_dir)
    runs = view(spark, sf_dir, "runs").select("run_id", "status", "quality_score")
    scores = view(spark, sf_dir, "metric_scores").select("run_id", "metric", "score")
    folder = scratch_folder(spark)
    sinks.export_csv(runs, scores, metrics, names, folder)
    return spark.read.csv(f"{folder}/column_metrics", header=True)


def export_run_rows(spark, sf_dir):
    """The run and metric folders of the same export, read back and counted."""
    metrics, names = _orders_metrics(spark, sf_dir)
    runs = view(spark, sf_dir, "runs").select("run_id", "status", "quality_score")
    folder = scratch_folder(spark)
    sinks.export_csv(runs, view(spark, sf_dir, "metric_scores").select("run_id", "metric", "score"), metrics, names, folder)
    read = lambda part: spark.read.csv(f"{folder}/{part}", header=True)
    total = lambda value: r6(F.sum(F.col(value).cast("double"))).alias("total")
    run_rows = read("run").groupBy(F.lit("run").alias("part"), "status").agg(F.count(F.lit(1)).alias("cnt"), total("quality_score"))
    rows = read("metrics").groupBy(F.col("metric").alias("part"), "status").agg(F.count(F.lit(1)).alias("cnt"), total("score"))
    return run_rows.unionByName(rows)


EXPORT_ROWS_SQL = with_views(
    "SELECT 'run' AS part, status, count(*) AS cnt, round(CAST(sum(quality_score) AS DOUBLE), 6) + 0.0 AS total FROM runs GROUP BY 2 UNION ALL "
    "SELECT metric, CASE WHEN score IS NULL THEN NULL WHEN score >= 0.98 THEN 'Excellent' WHEN score >= 0.95 THEN 'Good' WHEN score >= 0.90 THEN 'Acceptable' ELSE 'Poor' END, "
    "count(*), round(CAST(sum(score) AS DOUBLE), 6) + 0.0 FROM metric_scores GROUP BY 1, 2",
    "runs", "metric_scores",
)


def json_export(spark, sf_dir):
    """One JSON document with a run, its metric scores and its column metrics, read back."""
    metrics, _ = _orders_metrics(spark, sf_dir)
    run = view(spark, sf_dir, "runs").agg(
        F.count(F.lit(1)).alias("n_runs"), F.max("run_id").alias("last_run_id")
    )
    scores = (
        view(spark, sf_dir, "metric_scores").groupBy("metric").agg(F.round(F.avg("score"), 6).alias("score"))
    )
    folder = scratch_folder(spark)
    sinks.export_json(run, scores, metrics, folder)
    document = spark.read.json(folder)
    return document.select(
        F.col("run.n_runs").alias("n_runs"),
        F.col("run.last_run_id").alias("last_run_id"),
        F.explode("column_metrics").alias("m"),
        F.size("metrics").cast("bigint").alias("n_metrics"),
    ).select("n_runs", "last_run_id", "n_metrics", "m.column_name", "m.n_nulls", "m.n_unique")


JSON_SQL = with_views(
    union_sql(
        PIVOT_COLUMNS,
        "SELECT (SELECT count(*) FROM runs) AS n_runs, (SELECT max(run_id) FROM runs) AS last_run_id, "
        "(SELECT count(DISTINCT metric) FROM metric_scores) AS n_metrics, '{c}' AS column_name, "
        "count(*) - count({c}) AS n_nulls, count(DISTINCT {c}) AS n_unique FROM dirty_orders",
    ),
    "dirty_orders", "runs", "metric_scores",
)


def _stored_runs(spark, sf_dir):
    """All runs with a row count of their own, and their issues as stored."""
    runs = view(spark, sf_dir, "runs").select(
        "run_id", "project_id", "status", "quality_score", (F.col("dataset_id") % 900 + 100).alias("n_rows")
    )
    issues = view(spark, sf_dir, "issues").withColumn("severity", F.col("level")).drop("level")
    return runs, sinks.stored_issues_of(issues, runs)


def run_sink(spark, sf_dir):
    """The runs of all projects in one commit; one in seven written again with other rows, that commit
    retried; a write of one in five that fails before it is published. Each run is read back once."""
    store = RunStore(spark, scratch_folder(spark))
    runs, issues = _stored_runs(spark, sf_dir)
    store.write(runs, issues, "first")
    again, kept = runs.where("run_id % 7 = 0"), issues.where("run_id % 7 = 0 AND severity <> 'info'")
    for _ in range(2):
        store.write(again.withColumn("status", F.lit("REPEATED")), kept, "second")
    failed = runs.where("run_id % 5 = 0")
    store.stage(failed.withColumn("status", F.lit("LOST")), issues.where("run_id % 5 = 0"), "third")
    reader = RunStore(spark, store.folder)
    counted = reader.issues().groupBy("run_id").agg(
        F.count(F.lit(1)).alias("n_issues"),
        F.count_if(F.col("severity") == "critical").alias("n_critical"),
        F.sum("affected_rows_pct").alias("share"),
    )
    return (
        reader.runs()
        .join(counted, "run_id", "left")
        .groupBy("project_id", "status")
        .agg(
            F.count(F.lit(1)).alias("n_runs"),
            r6(F.sum("quality_score")).alias("score_sum"),
            F.sum(F.coalesce("n_issues", F.lit(0))).alias("n_issues"),
            F.sum(F.coalesce("n_critical", F.lit(0))).alias("n_critical"),
            r6(F.sum(F.coalesce("share", F.lit(0.0)))).alias("share_sum"),
        )
    )


SINK_SQL = with_views(
    "r AS (SELECT run_id, project_id, CASE WHEN run_id % 7 = 0 THEN 'REPEATED' ELSE status END AS status, quality_score, dataset_id % 900 + 100 AS n_rows FROM runs), "
    "i AS (SELECT i.run_id, count(*) AS n, count(*) FILTER (WHERE level = 'critical') AS c, "
    "sum(CAST(affected_row_count AS DOUBLE) / n_rows) AS s FROM issues i JOIN r ON i.run_id = r.run_id "
    "WHERE i.run_id % 7 <> 0 OR level <> 'low' GROUP BY 1) "
    "SELECT project_id, status, count(*) AS n_runs, round(CAST(sum(quality_score) AS DOUBLE), 6) + 0.0 AS score_sum, CAST(sum(coalesce(n, 0)) AS BIGINT) AS n_issues, "
    "CAST(sum(coalesce(c, 0)) AS BIGINT) AS n_critical, round(sum(coalesce(s, 0)), 6) + 0.0 AS share_sum FROM r LEFT JOIN i ON r.run_id = i.run_id GROUP BY 1, 2",
    "runs", "issues",
)


def _long_where_it_fits(df, name):
    """The integral decimal column `name` as long if all its values fit, else as it is: none is wrapped or lost."""
    kept = checkpointed(df)
    beyond = F.col(name).isNotNull() & F.col(name).try_cast("bigint").isNull()
    return kept if kept.where(beyond).limit(1).count() else kept.withColumn(name, F.col(name).cast("bigint"))


def run_store_compaction(spark, sf_dir):
    """A store of one commit a project group, compacted: files a project before and after, and the same rows.

    The sum of a project's ids may be over a long; then `id_sum` is a decimal.
    """
    store = RunStore(spark, scratch_folder(spark))
    runs, issues = _stored_runs(spark, sf_dir)
    for part in range(3):
        mine = f"run_id % 3 = {part}"
        store.write(runs.where(mine), issues.where(mine), f"part{part}")
    store.write(runs.where("run_id % 2 = 0"), issues.where("run_id % 2 = 0 AND affected_row_count > 10"), "newer")
    base = store.compact()
    files = spark.read.parquet(f"{store.folder}/issues/commit={base}").select("project_id", F.col("_metadata.file_path").alias("file"))
    id_sum = F.sum(F.col("issue_id").cast("decimal(20,0)")).alias("id_sum")
    return (
        store.issues()
        .groupBy("project_id")
        .agg(F.count(F.lit(1)).alias("n_issues"), F.count_distinct("run_id").alias("n_runs"), id_sum)
        .transform(_long_where_it_fits, "id_sum")
        .join(files.groupBy(F.col("project_id").cast("bigint").alias("project_id")).agg(F.count_distinct("file").alias("n_files")), "project_id")
        .withColumn("commits", F.lit(store.commits().count()))
    )


COMPACTION_SQL = with_views(
    "SELECT project_id, count(*) AS n_issues, count(DISTINCT i.run_id) AS n_runs, CAST(1 AS BIGINT) AS n_files, CAST(sum(issue_id) AS BIGINT) AS id_sum, 1 AS commits "
    "FROM issues i JOIN runs r ON i.run_id = r.run_id WHERE i.run_id % 2 = 1 OR affected_row_count > 10 GROUP BY 1",
    "runs", "issues",
)

QUERIES = [
    Query("csv_scan", "S1", csv_scan, "SELECT c_custkey, c_name, c_nationkey, round(c_acctbal, 6) + 0.0 AS c_acctbal, c_mktsegment FROM customer"),
    Query("csv_quoted_lines", "S1", csv_quoted_lines, "SELECT doc_id, lang, length(text) AS n_chars, sha256(text) AS digest FROM documents WHERE text IS NOT NULL"),
    Query("csv_type_choice", "S4", csv_type_choice, CSV_TYPE_SQL),
    Query("schema_listing", "S5", schema_listing, SCHEMA_SQL),
    Query("table_preview", "S6 C4", preview, "SELECT c_custkey, '***' AS c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer ORDER BY c_custkey LIMIT 100"),
    Query("result_export_json", "S7", json_export, JSON_SQL),
    Query("result_export_csv", "S8", export_round_trip, PIVOT_SQL),
    Query("result_export_csv_rows", "S8", export_run_rows, EXPORT_ROWS_SQL),
    Query("column_metric_pivot", "S8", column_metric_pivot, PIVOT_SQL),
    Query("run_issue_sink", "S9 C18 K7", run_sink, SINK_SQL),
    Query("run_store_compaction", "S9", run_store_compaction, COMPACTION_SQL),
]
