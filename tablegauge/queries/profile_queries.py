"""Profiling queries."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import functions as F

from tablegauge.operators import correlation, histogram, profiling, quantiles
from tablegauge.operators.duplicates import duplicate_groups, duplicate_rows
from tablegauge.operators.findings import Context
from tablegauge.operators.frequency import value_frequency
from tablegauge.operators.outliers import Outliers
from tablegauge.operators.syntax import SyntacticAccuracy
from tablegauge.queries.support import (
    FLAT_ISSUE,
    Query,
    fingerprint_sql,
    ladder_sql,
    rounded,
    table,
    union_sql,
    view,
    with_views,
)

LINE_NUMBERS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
LINE_NUMERIC = ["l_orderkey", "l_linenumber", *LINE_NUMBERS]
PART_COLUMNS = ["p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice"]
PART_TEXT = ["p_name", "p_brand", "p_type"]
PART_NUMERIC = ["p_partkey", "p_size", "p_retailprice"]


def upload_schema(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    schema = profiling.upload_schema(part, value_frequency(part, whole_text=[]))
    return rounded(schema, "mean", "median", "std").drop("position")


def _moments(c: str, source: str, extra: str) -> str:
    return (
        f"SELECT '{c}' AS column_name, {extra}, CAST(min({c}) AS DOUBLE) AS min, CAST(max({c}) AS DOUBLE) AS max, "
        f"round(avg({c}), 6) + 0.0 AS mean, round(quantile_cont({c}, 0.5), 6) + 0.0 AS median, "
        f"round(stddev_samp({c}), 6) + 0.0 AS std FROM {source}"
    )


def _no_moments(c: str, source: str, extra: str) -> str:
    nulls = ", ".join(f"NULL AS {m}" for m in ("min", "max", "mean", "median", "std"))
    return f"SELECT '{c}' AS column_name, {extra}, {nulls} FROM {source}"


_KIND = (
    "CASE any_value(typeof({c})) WHEN 'VARCHAR' THEN 'string' WHEN 'DOUBLE' THEN 'fraction' WHEN 'TIMESTAMP' THEN 'time' "
    "WHEN 'DATE' THEN 'time' ELSE 'integer' END AS kind, "
)
_UPLOAD = _KIND + "count(DISTINCT {c}) AS unique_count, count(*) - count({c}) AS missing_count, round(100.0 * (count(*) - count({c})) / count(*), 2) AS missing_percentage"
UPLOAD_SQL = " UNION ALL ".join(
    (_moments if c in PART_NUMERIC else _no_moments)(c, "part", _UPLOAD.replace("{c}", c))
    for c in PART_COLUMNS
)


def upload_top_values(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    return profiling.most_common(part, value_frequency(part, PART_TEXT)).select(
        "column_name", F.col("rank").cast("bigint").alias("rank"), "value", "cnt"
    )


def _top_sql(columns: list[str], source: str, k: int) -> str:
    return (
        f"SELECT column_name, rank, value, cnt FROM ("
        + union_sql(
            columns,
            "SELECT '{c}' AS column_name, row_number() OVER (ORDER BY count(*) DESC, CAST({c} AS VARCHAR)) AS rank, "
            f"CAST({{c}} AS VARCHAR) AS value, count(*) AS cnt FROM {source} WHERE {{c}} IS NOT NULL GROUP BY {{c}}",
        )
        + f") WHERE rank <= {k}"
    )


def overview(spark, sf_dir):
    return profiling.overview(view(spark, sf_dir, "docs_labels"), 1000)


DOC_CELLS = ["doc_id", "text", "lang", "source", "n_chars", "quality", "toxic"]
_DOC_MISSING = " + ".join(f"count(*) - count({c})" for c in DOC_CELLS)
OVERVIEW_SQL = with_views(
    "d AS (SELECT doc_id, text, lang, source, n_chars, quality, toxic FROM docs_labels), "
    f"s AS (SELECT count(*) AS n, {_DOC_MISSING} AS m, (SELECT count(*) FROM (SELECT DISTINCT * FROM d)) AS u FROM d) "
    "SELECT n AS total_rows, 7 AS total_columns, n * 7 AS total_cells, m AS total_missing, "
    "round(100.0 * m / (n * 7), 2) AS missing_percent, n - u AS duplicate_rows, "
    "round(100.0 * (n - u) / n, 2) AS duplicate_percent, CAST(1000 AS BIGINT) AS estimated_size_bytes FROM s",
    "docs_labels",
)


def numeric_summary(spark, sf_dir):
    return profiling.numeric_summary(table(spark, sf_dir, "lineitem"), LINE_NUMERIC).withColumns(
        {c: F.col(c) + F.lit(0.0) for c in ("skewness", "kurtosis")}
    )


SUMMARY_SQL = union_sql(
    LINE_NUMERIC,
    "SELECT '{c}' AS column_name, count({c}) AS n_valid, round(avg({c}), 4) AS mean, "
    "round(quantile_cont({c}, 0.5), 4) AS median, round(stddev_samp({c}), 4) AS std, CAST(min({c}) AS DOUBLE) AS min, "
    "CAST(max({c}) AS DOUBLE) AS max, round(quantile_cont({c}, 0.25), 4) AS q1, round(quantile_cont({c}, 0.75), 4) AS q3, "
    "round(quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25), 4) AS iqr, round(skewness({c}), 4) + 0.0 AS skewness, "
    "round(kurtosis({c}), 4) + 0.0 AS kurtosis FROM lineitem",
)


def narrowed_quantiles(spark, sf_dir):
    """Quantiles by narrowing brackets, the way of tables too large for one task."""
    lines = table(spark, sf_dir, "lineitem")
    return rounded(
        quantiles.quantiles(lines, LINE_NUMERIC, (0.01, 0.25, 0.5, 0.75, 0.99), limit=1000), "quantile"
    )


NARROWED_SQL = " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, CAST({p} AS DOUBLE) AS probability, round(quantile_cont({c}, {p}), 6) + 0.0 AS quantile FROM lineitem"
    for c in LINE_NUMERIC
    for p in (0.01, 0.25, 0.5, 0.75, 0.99)
)


def histograms(spark, sf_dir):
    return rounded(histogram.histogram(table(spark, sf_dir, "lineitem"), LINE_NUMBERS), "bin_start")


def adaptive_histograms(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    counts = value_frequency(part, ["p_size", "p_retailprice"])
    return rounded(
        profiling.adaptive_histogram(part, counts, ["p_size", "p_retailprice"]), "bin_start"
    )


def _histogram_sql(columns: list[str], source: str, bins: str) -> str:
    """Bins counted between their edges; the last one is closed."""
    return union_sql(
        columns,
        "SELECT '{c}' AS column_name, b.bin, round(b.lo, 6) + 0.0 AS bin_start, count(v.x) AS cnt FROM ("
        "SELECT e.i AS bin, s.n, s.low + e.i * ((s.high - s.low) / s.n) AS lo, "
        "CASE WHEN e.i = s.n - 1 THEN s.high ELSE s.low + (e.i + 1) * ((s.high - s.low) / s.n) END AS hi "
        "FROM (SELECT CASE WHEN min({c}) = max({c}) THEN min({c}) - 0.5 ELSE min({c}) END AS low, "
        "CASE WHEN min({c}) = max({c}) THEN max({c}) + 0.5 ELSE max({c}) END AS high, "
        f"{bins} AS n FROM {source}) s, (SELECT unnest(range(30)) AS i) e WHERE e.i < s.n) b "
        f"LEFT JOIN (SELECT CAST({{c}} AS DOUBLE) AS x FROM {source}) v "
        "ON v.x >= b.lo AND (v.x < b.hi OR (b.bin = b.n - 1 AND v.x <= b.hi)) GROUP BY 2, 3",
    )


def boxplots(spark, sf_dir):
    return profiling.boxplot(table(spark, sf_dir, "lineitem"), ["l_extendedprice", "l_quantity"], 0.5)


def _fences(c: str, f: float) -> str:
    return (
        f"SELECT quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.5) AS median, quantile_cont({c}, 0.75) AS q3, "
        f"quantile_cont({c}, 0.25) - {f} * (quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25)) AS lower_fence, "
        f"quantile_cont({c}, 0.75) + {f} * (quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25)) AS upper_fence FROM "
    )


BOXPLOT_SQL = " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, min({c}) AS min, round(q1, 4) AS q1, round(median, 4) AS median, round(q3, 4) AS q3, "
    f"max({c}) AS max, round(lower_fence, 4) AS lower_fence, round(upper_fence, 4) AS upper_fence, "
    f"count(*) FILTER (WHERE {c} < lower_fence OR {c} > upper_fence) AS outlier_count "
    f"FROM lineitem, ({_fences(c, 0.5)} lineitem) GROUP BY q1, median, q3, lower_fence, upper_fence"
    for c in ("l_extendedprice", "l_quantity")
)


def boxplot_outliers(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    return profiling.boxplot_outliers(events, ["value"], ["event_id"]).select(
        "column_name", F.col("position").cast("bigint").alias("position"), "value"
    )


BOX_SAMPLE_SQL = (
    f"WITH f AS ({_fences('value', 1.5)} events) SELECT 'value' AS column_name, "
    "row_number() OVER (ORDER BY event_id) AS position, value FROM events, f "
    "WHERE value < lower_fence OR value > upper_fence QUALIFY position <= 50"
)


def modes(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    return profiling.modes(part, value_frequency(part, PART_TEXT))


MODE_SQL = f"SELECT column_name, value AS mode FROM ({_top_sql(PART_TEXT, 'part', 1)})"


def bar_charts(spark, sf_dir):
    documents = table(spark, sf_dir, "documents")
    return profiling.bar_chart(documents, value_frequency(documents, ["lang", "source", "text"])).select(
        "column_name", F.col("rank").cast("bigint").alias("rank"), "value", "cnt"
    )


def type_summary(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    return profiling.type_summary(profiling.column_types(part, value_frequency(part, whole_text=[])))


TYPE_SUMMARY_SQL = (
    "WITH t AS ("
    + " UNION ALL ".join(f"SELECT '{c}' AS name, any_value(typeof({c})) AS type FROM part" for c in PART_COLUMNS)
    + ") SELECT CASE WHEN type = 'VARCHAR' THEN 'categorical' ELSE 'numeric' END AS category, count(*) AS cnt, "
    "string_agg(name, ',' ORDER BY name) AS names FROM t GROUP BY 1"
)


def pearson(spark, sf_dir):
    pairs = correlation.pearson(table(spark, sf_dir, "lineitem"), LINE_NUMBERS, ["l_tax"])
    dirty = correlation.pearson(
        view(spark, sf_dir, "dirty_orders"), ["o_orderkey", "o_custkey", "o_totalprice"]
    )
    return rounded(pairs.unionByName(dirty), "coefficient")


def _pairs_sql(columns, source, expression) -> str:
    return " UNION ALL ".join(
        f"SELECT '{a}' AS column_a, '{b}' AS column_b, round({expression.format(a=a, b=b)}, 6) + 0.0 AS coefficient FROM {source.format(a=a, b=b)}"
        for a, b in combinations(columns, 2)
    )


PEARSON_SQL = with_views(
    _pairs_sql(["l_quantity", "l_extendedprice", "l_discount"], "lineitem", "corr({a}, {b})")
    + " UNION ALL "
    + _pairs_sql(["o_orderkey", "o_custkey", "o_totalprice"], "dirty_orders", "corr({a}, {b})"),
    "dirty_orders",
)


def spearman(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    dirty = view(spark, sf_dir, "dirty_orders")
    pairs = correlation.spearman(lines, ["l_quantity", "l_extendedprice", "l_discount"])
    gaps = correlation.spearman(dirty, ["o_custkey", "o_totalprice"])
    return rounded(pairs.unionByName(gaps), "coefficient")


def spearman_range_ranks(spark, sf_dir):
    """The same by range-partitioned ranks and salted lookups, the way of tables beyond one task."""
    lines = table(spark, sf_dir, "lineitem")
    pairs = correlation.spearman(lines, ["l_quantity", "l_extendedprice", "l_discount"])
    return rounded(pairs, "coefficient")


_RANK = "rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0"


def _spearman_sql(columns, source) -> str:
    return _pairs_sql(
        columns,
        f"(SELECT {_RANK.replace('{c}', '{a}')} AS ra, {_RANK.replace('{c}', '{b}')} AS rb FROM {source} "
        "WHERE {a} IS NOT NULL AND {b} IS NOT NULL)",
        "corr(ra, rb)",
    )


LINE_SPEARMAN_SQL = _spearman_sql(["l_quantity", "l_extendedprice", "l_discount"], "lineitem")
SPEARMAN_SQL = with_views(
    LINE_SPEARMAN_SQL + " UNION ALL " + _spearman_sql(["o_custkey", "o_totalprice"], "dirty_orders"),
    "dirty_orders",
)


def correlation_matrix(spark, sf_dir):
    names = ["p_partkey", "p_size", "p_retailprice"]
    pairs = correlation.pearson(table(spark, sf_dir, "part"), names)
    return correlation.as_matrix(pairs, names)


def _matrix_row(name: str) -> str:
    names = ["p_partkey", "p_size", "p_retailprice"]
    cells = ", ".join(
        f"1.0 AS {other}" if other == name else f"round(corr({name}, {other}), 4) AS {other}" for other in names
    )
    return f"SELECT '{name}' AS column_a, {cells} FROM part"


MATRIX_SQL = " UNION ALL ".join(_matrix_row(n) for n in ("p_partkey", "p_size", "p_retailprice"))

DIRTY = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority"]
DIRTY_NUMERIC = ["o_orderkey", "o_custkey", "o_totalprice"]


def run_column_metrics(spark, sf_dir):
    orders = view(spark, sf_dir, "dirty_orders").select(*DIRTY)
    metrics = profiling.run_column_metrics(orders, value_frequency(orders, whole_text=[]))
    return _with_bars(rounded(metrics, "completeness", "uniqueness", "mean", "median", "std"))


def _with_bars(metrics):
    return metrics.withColumn("histogram", F.array_join(F.transform("histogram", lambda n: n.cast("string")), ","))


def _bars(c: str, source: str) -> str:
    return f"(SELECT string_agg(CAST(cnt AS VARCHAR), ',' ORDER BY bin) FROM ({_histogram_sql([c], source, '10')})) AS histogram"


_RUN_METRIC = (
    _KIND + "round(count({c}) * 1.0 / count(*), 6) + 0.0 AS completeness, round(count(DISTINCT {c}) * 1.0 / count(*), 6) + 0.0 AS uniqueness, "
    "count(*) - count({c}) AS n_nulls, count({c}) AS n_non_nulls, count(DISTINCT {c}) AS n_unique"
)
RUN_METRIC_SQL = with_views(
    " UNION ALL ".join(
        (_moments if c in DIRTY_NUMERIC else _no_moments)(
            c, "dirty_orders", _RUN_METRIC.replace("{c}", c) + ", " + (_bars(c, "dirty_orders") if c in DIRTY_NUMERIC else "NULL AS histogram")
        )
        for c in DIRTY
    ),
    "dirty_orders",
)


def quick_analysis(spark, sf_dir):
    row = profiling.quick_analysis(view(spark, sf_dir, "docs_labels"))
    return rounded(row, "completeness", "uniqueness", "quality_score")


def quick_column_metrics(spark, sf_dir):
    docs = view(spark, sf_dir, "docs_labels")
    metrics = profiling.quick_column_metrics(docs, value_frequency(docs, whole_text=[]))
    return _with_bars(rounded(metrics, "completeness", "uniqueness", "mean", "median", "std"))


DOC_NUMERIC = ["doc_id", "n_chars", "quality", "toxic"]
_QUICK = _KIND + "round(count({c}) * 1.0 / count(*), 6) + 0.0 AS completeness, round(count(DISTINCT {c}) * 1.0 / count(*), 6) + 0.0 AS uniqueness, "
QUICK_COLUMN_SQL = with_views(
    " UNION ALL ".join(
        (_moments if c in DOC_NUMERIC else _no_moments)(
            c, "docs_labels", _QUICK.replace("{c}", c) + (_bars(c, "docs_labels") if c in DOC_NUMERIC else "NULL AS histogram")
        )
        for c in DOC_CELLS
    ),
    "docs_labels",
)

_DOC_SHARES = " + ".join(f"count({c}) * 1.0 / count(*)" for c in DOC_CELLS)
QUICK_SQL = with_views(
    "d AS (SELECT doc_id, text, lang, source, n_chars, quality, toxic FROM docs_labels), "
    f"s AS (SELECT ({_DOC_SHARES}) / 7 AS c, (SELECT count(*) FROM (SELECT DISTINCT * FROM d)) * 1.0 / count(*) AS u FROM d) "
    "SELECT round(c, 6) + 0.0 AS completeness, round(u, 6) + 0.0 AS uniqueness, CAST(0.95 AS DOUBLE) AS consistency, "
    "round((c + u + 0.95) / 3, 6) + 0.0 AS quality_score FROM s",
    "docs_labels",
)


def duplicate_group_counts(spark, sf_dir):
    """The first fifty groups of equal order facts, in key order."""
    facts = view(spark, sf_dir, "order_facts")
    groups = duplicate_groups(facts)
    return groups.select(
        "group_id",
        F.col("key__0").alias("o_orderstatus"),
        F.col("key__1").alias("o_orderpriority"),
        F.col("key__2").alias("bucket"),
        "cnt",
    )


DUPLICATE_GROUP_SQL = with_views(
    "SELECT row_number() OVER (ORDER BY o_orderstatus, o_orderpriority, bucket) AS group_id, o_orderstatus, "
    "o_orderpriority, bucket, count(*) AS cnt FROM order_facts GROUP BY 2, 3, 4 HAVING count(*) > 1 "
    "ORDER BY 1 LIMIT 50",
    "order_facts",
)


def duplicate_row_samples(spark, sf_dir):
    """Up to five documents of each of the first fifty groups of equal status and priority."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    rows = duplicate_rows(orders, ["o_orderstatus", "o_orderpriority"], ["o_orderkey"], ["o_orderpriority"])
    return rows.select(
        "group_id", "cnt", "copy", F.get_json_object("row", "$.o_orderkey").cast("bigint").alias("o_orderkey"),
        F.get_json_object("row", "$.o_orderpriority").alias("o_orderpriority"),
    )


DUPLICATE_ROW_SQL = (
    "WITH g AS (SELECT o_orderstatus, o_orderpriority, count(*) AS cnt, "
    "row_number() OVER (ORDER BY o_orderstatus, o_orderpriority) AS group_id FROM orders GROUP BY 1, 2 HAVING count(*) > 1) "
    "SELECT group_id, cnt, row_number() OVER (PARTITION BY group_id ORDER BY o.o_orderkey) AS copy, o.o_orderkey, "
    "'***' AS o_orderpriority FROM orders o JOIN g USING (o_orderstatus, o_orderpriority) WHERE group_id <= 50 QUALIFY copy <= 5"
)


def duplicate_totals(spark, sf_dir):
    from tablegauge.operators.frequency import duplicate_totals as totals

    return totals(table(spark, sf_dir, "documents"), ["text", "lang"]).drop("n_missing")


DUPLICATE_TOTAL_SQL = (
    "WITH g AS (SELECT text, lang, count(*) AS c FROM documents GROUP BY 1, 2) "
    "SELECT CAST(sum(c) AS BIGINT) AS n_rows, count(*) AS n_distinct, CAST(sum(c - 1) AS BIGINT) AS n_surplus, "
    "CAST(coalesce(sum(c) FILTER (WHERE c > 1), 0) AS BIGINT) AS n_in_groups, count(*) FILTER (WHERE c > 1) AS n_groups FROM g"
)

OUTLIER_COLUMNS = ["l_extendedprice", "l_quantity"]


def _outliers(spark, sf_dir, params, context=None):
    return Outliers().run(table(spark, sf_dir, "lineitem"), params, context)


def iqr_outliers(spark, sf_dir):
    columns = _outliers(spark, sf_dir, {"columns": OUTLIER_COLUMNS, "factor": 0.5}).columns
    return rounded(
        columns.select(
            "column_name", "n_valid", "outlier_count", "proportion", "q1", "q3", "iqr", "median", "lower",
            "upper", "min", "max", "mean",
        ),
        "proportion", "q1", "q3", "iqr", "median", "lower", "upper", "mean",
    )


IQR_SQL = " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, count({c}) AS n_valid, count(*) FILTER (WHERE {c} < lower_fence OR {c} > upper_fence) AS outlier_count, "
    f"round(count(*) FILTER (WHERE {c} < lower_fence OR {c} > upper_fence) * 1.0 / count({c}), 6) + 0.0 AS proportion, "
    f"round(q1, 6) + 0.0 AS q1, round(q3, 6) + 0.0 AS q3, round(q3 - q1, 6) + 0.0 AS iqr, round(median, 6) + 0.0 AS median, "
    f"round(lower_fence, 6) + 0.0 AS lower, round(upper_fence, 6) + 0.0 AS upper, min({c}) AS min, max({c}) AS max, "
    f"round(avg({c}), 6) + 0.0 AS mean FROM lineitem, ({_fences(c, 0.5)} lineitem) GROUP BY q1, q3, median, lower_fence, upper_fence"
    for c in OUTLIER_COLUMNS
)


def zscore_outliers(spark, sf_dir):
    params = {"columns": ["value", "user_id"], "method": "zscore", "factor": 1.7}
    columns = Outliers().run(table(spark, sf_dir, "events"), params).columns
    return rounded(
        columns.select("column_name", "n_valid", "outlier_count", "proportion", "mean", "std"),
        "proportion", "mean", "std",
    )


ZSCORE_SQL = union_sql(
    ["value", "user_id"],
    "SELECT '{c}' AS column_name, count({c}) AS n_valid, count(*) FILTER (WHERE abs(({c} - m) / s) > 1.7) AS outlier_count, "
    "round(count(*) FILTER (WHERE abs(({c} - m) / s) > 1.7) * 1.0 / count({c}), 6) + 0.0 AS proportion, "
    "round(m, 6) + 0.0 AS mean, round(s, 6) + 0.0 AS std FROM events, "
    "(SELECT avg({c}) AS m, stddev_samp({c}) AS s FROM events) GROUP BY m, s",
)


def outlier_issues(spark, sf_dir):
    context = Context(sensitive=["value"], id_columns=["event_id"])
    issues = Outliers().run(table(spark, sf_dir, "events"), {"columns": ["value"]}, context).issues
    return issues.select(*FLAT_ISSUE, F.array_join("sample", ",").alias("sample"))


OUTLIER_ISSUE_SQL = (
    f"WITH f AS ({_fences('value', 1.5)} events), c AS (SELECT count(*) FILTER (WHERE value < lower_fence OR value > upper_fence) AS n, "
    "count(*) AS t FROM events, f) SELECT 'outliers' AS issue_type, "
    + ladder_sql("n * 1.0 / t", 0.20, 0.10, 0.05)
    + " AS severity, 'value' AS column_name, n AS affected_row_count, "
    + fingerprint_sql("'outliers|value||outlier_iqr_check|factor=1.5|method=iqr'")
    + " AS fingerprint, substr('***,***,***,***,***', 1, CAST(least(n, 5) * 4 - 1 AS INT)) AS sample FROM c WHERE n > 0"
)


def numeric_code_issues(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select("l_linenumber", "l_orderkey", "l_returnflag")
    issues = profiling.numeric_code_issues(
        lines, value_frequency(lines, ["l_linenumber", "l_orderkey"]), profiling.column_stats(lines)
    )
    return issues.select("issue_type", "severity", "column_name", "fingerprint")


NUMERIC_CODE_SQL = union_sql(
    ["l_linenumber", "l_orderkey"],
    "SELECT 'consistency' AS issue_type, 'low' AS severity, '{c}' AS column_name, "
    + fingerprint_sql("'consistency|{c}||categorical_as_numeric'")
    + " AS fingerprint FROM lineitem HAVING count(DISTINCT {c}) < 10 AND count(*) > 20",
)


def restricted_profile(spark, sf_dir):
    docs = view(spark, sf_dir, "docs_labels")
    chosen = ["lang", "quality", "toxic"]
    types = profiling.column_types(docs, value_frequency(docs, chosen), profiling.column_stats(docs, chosen))
    return rounded(profiling.restrict_profile(types, chosen), "completeness")


RESTRICTED_SQL = with_views(
    "SELECT CAST(3 AS BIGINT) AS n_columns, count(lang) + count(quality) + count(toxic) AS n_valid, "
    "3 * count(*) - count(lang) - count(quality) - count(toxic) AS n_missing, "
    "round((count(lang) + count(quality) + count(toxic)) / (3.0 * count(*)), 6) + 0.0 AS completeness FROM docs_labels",
    "docs_labels",
)


def restricted_correlation(spark, sf_dir):
    pairs = correlation.pearson(table(spark, sf_dir, "lineitem"), LINE_NUMBERS)
    return rounded(profiling.restrict_pairs(pairs, ["l_quantity", "l_tax"]), "coefficient")


def completeness_rollup(spark, sf_dir):
    docs = view(spark, sf_dir, "docs_labels")
    return profiling.completeness_rollup(profiling.column_stats(docs), 0.95)


COMPLETENESS_ROLLUP_SQL = with_views(
    "c AS ("
    + union_sql(DOC_CELLS, "SELECT count(*) - count({c}) AS m, count(*) AS n FROM docs_labels")
    + ") SELECT CAST(sum(m) AS BIGINT) AS total_nulls, CAST(sum(n) AS BIGINT) AS total_cells, "
    "count(*) FILTER (WHERE 1 - m * 1.0 / n < 0.95) AS columns_below, count(*) FILTER (WHERE m > 0) AS columns_with_nulls, "
    "round((1 - avg(1 - m * 1.0 / n)) * 100, 1) AS missing_percent FROM c",
    "docs_labels",
)

ROLLUP_CHECKS = {"columns": [
    {"column": "o_orderpriority", "pattern": "^[0-9]-"}, {"column": "o_orderstatus", "pattern": "^[FO]$"},
], "auto_detect_types": False}


def conformance_rollup(spark, sf_dir):
    orders = view(spark, sf_dir, "dirty_orders")
    columns = SyntacticAccuracy().run(orders, ROLLUP_CHECKS, Context(id_columns=["o_orderkey"])).columns
    return profiling.conformance_rollup(columns, 0.95)


CONFORMANCE_ROLLUP_SQL = with_views(
    "c AS (SELECT count(o_orderpriority) AS n, count(*) FILTER (WHERE regexp_matches(o_orderpriority, '^[0-9]-')) AS ok FROM dirty_orders "
    "UNION ALL SELECT count(o_orderstatus), count(*) FILTER (WHERE regexp_matches(o_orderstatus, '^[FO]$')) FROM dirty_orders) "
    "SELECT CAST(sum(n - ok) AS BIGINT) AS total_invalid, count(*) FILTER (WHERE ok * 1.0 / n < 0.95) AS columns_below, "
    "round(avg(ok * 1.0 / n) * 100, 1) AS overall_percent FROM c",
    "dirty_orders",
)

def worst_columns(spark, sf_dir):
    """Columns from the least complete on, with their place in that order."""
    stats = profiling.column_stats(view(spark, sf_dir, "docs_labels"))
    ordered = profiling.worst_first(rounded(stats.select("column_name", "completeness"), "completeness"), "completeness")
    # one row per column; numbered as they are listed
    rows = [(r["column_name"], r["completeness"], at + 1) for at, r in enumerate(ordered.collect())]
    return spark.createDataFrame(rows, "column_name string, completeness double, place bigint")


WORST_SQL = with_views(
    "c AS (" + union_sql(DOC_CELLS, "SELECT '{c}' AS column_name, round(count({c}) * 1.0 / count(*), 6) + 0.0 AS completeness FROM docs_labels")
    + ") SELECT column_name, completeness, row_number() OVER (ORDER BY completeness, column_name) AS place FROM c",
    "docs_labels",
)

RESTRICTED_PAIR_SQL = _pairs_sql(["l_quantity", "l_tax"], "lineitem", "corr({a}, {b})")

QUERIES = [
    Query("upload_schema", "P1", upload_schema, UPLOAD_SQL),
    Query("upload_top_values", "P1", upload_top_values, _top_sql(PART_TEXT, "part", 5)),
    Query("overview", "P2", overview, OVERVIEW_SQL),
    Query("numeric_summary", "P3", numeric_summary, SUMMARY_SQL),
    Query("quantiles_by_narrowing", "P3", narrowed_quantiles, NARROWED_SQL),
    Query("histograms", "P4", histograms, _histogram_sql(LINE_NUMBERS, "lineitem", "10")),
    Query("adaptive_histograms", "P5", adaptive_histograms, _histogram_sql(["p_size", "p_retailprice"], "part", "least(30, greatest(10, count(DISTINCT {c})))")),
    Query("boxplots", "P6", boxplots, BOXPLOT_SQL),
    Query("boxplot_outliers", "P6", boxplot_outliers, BOX_SAMPLE_SQL),
    Query("modes", "P7", modes, MODE_SQL),
    Query("bar_charts", "P8", bar_charts, _top_sql(["lang", "source", "text"], "documents", 20)),
    Query("type_summary", "P9", type_summary, TYPE_SUMMARY_SQL),
    Query("pearson", "P10", pearson, PEARSON_SQL),
    Query("correlation_matrix", "P10", correlation_matrix, MATRIX_SQL),
    Query("spearman", "P11", spearman, SPEARMAN_SQL),
    Query("spearman_range_ranks", "P11", spearman_range_ranks, LINE_SPEARMAN_SQL),
    Query("run_column_metrics", "P12", run_column_metrics, RUN_METRIC_SQL),
    Query("quick_analysis", "P14", quick_analysis, QUICK_SQL),
    Query("quick_column_metrics", "P14", quick_column_metrics, QUICK_COLUMN_SQL),
    Query("worst_columns", "P21", worst_columns, WORST_SQL),
    Query("duplicate_totals", "P15 Q4 Q7", duplicate_totals, DUPLICATE_TOTAL_SQL),
    Query("duplicate_groups", "P15", duplicate_group_counts, DUPLICATE_GROUP_SQL),
    Query("duplicate_row_samples", "P15", duplicate_row_samples, DUPLICATE_ROW_SQL),
    Query("iqr_outliers", "P16", iqr_outliers, IQR_SQL),
    Query("zscore_outliers", "P17", zscore_outliers, ZSCORE_SQL),
    Query("outlier_issues", "P18 K6j", outlier_issues, OUTLIER_ISSUE_SQL),
    Query("numeric_code_issues", "P19", numeric_code_issues, NUMERIC_CODE_SQL),
    Query("restricted_profile", "P20", restricted_profile, RESTRICTED_SQL),
    Query("restricted_correlation", "P20", restricted_correlation, RESTRICTED_PAIR_SQL),
    Query("completeness_rollup", "P21", completeness_rollup, COMPLETENESS_ROLLUP_SQL),
    Query("conformance_rollup", "P21", conformance_rollup, CONFORMANCE_ROLLUP_SQL),
]
