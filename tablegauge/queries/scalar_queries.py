"""Column typing, cleaning and scalar expressions, applied to whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablegauge.functions import patterns, scalars
from tablegauge.operators.column_stats import column_stats
from tablegauge.operators.frequency import value_frequency
from tablegauge.operators.profiling import column_types, numeric_summary, redact
from tablegauge.operators.uniqueness import Uniqueness
from tablegauge.queries.support import Query, run_sql, table, union_sql, view, with_views

PRESETS = {"presets": ["na", "dash", "no_such_preset"], "custom": ["^4-"]}


def null_patterns(spark, sf_dir):
    return patterns.apply_null_patterns(
        view(spark, sf_dir, "dirty_orders"), PRESETS, ["o_orderpriority"]
    ).select("o_orderkey", "o_orderpriority")


NULL_PATTERN_SQL = with_views(
    "SELECT o_orderkey, CASE WHEN regexp_matches(o_orderpriority, '^(?:(?:^n/?a$)|(?:^[-–—]$)|(?:^4-))', 'i') "
    "THEN NULL ELSE o_orderpriority END AS o_orderpriority FROM dirty_orders",
    "dirty_orders",
)


def semantic_types(spark, sf_dir):
    columns = Uniqueness().run(table(spark, sf_dir, "events")).columns
    return columns.select("column_name", "n_unique", "column_type")


SEMANTIC_SQL = (
    "SELECT 'event_id' AS column_name, count(DISTINCT event_id) AS n_unique, 'ID' AS column_type FROM events "
    "UNION ALL SELECT 'user_id', count(DISTINCT user_id), 'ID' FROM events "
    "UNION ALL SELECT 'value', count(DISTINCT value), 'numeric' FROM events UNION ALL "
) + union_sql(
    ["ts", "event_type", "props"],
    "SELECT '{c}' AS column_name, count(DISTINCT {c}) AS n_unique, "
    "CASE WHEN count(DISTINCT {c}) <= 20 THEN 'categorical' ELSE 'text' END AS column_type FROM events",
)

PART_KINDS = {
    "p_partkey": "integer", "p_name": "string", "p_brand": "string", "p_type": "string",
    "p_size": "integer", "p_retailprice": "fraction",
}


def profile_types(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    types = column_types(part, value_frequency(part, whole_text=[]))
    return types.select("column_name", "n_unique", "n_missing", "category", "sub_type")


def _part_type_sql(name: str, kind: str) -> str:
    n = f"count(DISTINCT {name})"
    if kind == "fraction":
        category, sub = "'numeric'", "'continuous'"
    elif kind == "integer":
        category, sub = "'numeric'", f"CASE WHEN {n} > 20 THEN 'continuous' ELSE 'discrete' END"
    else:
        category = "'categorical'"
        sub = f"CASE WHEN {n} <= 2 THEN 'binary' WHEN {n} <= 30 THEN 'nominal' ELSE 'text' END"
    return (
        f"SELECT '{name}' AS column_name, {n} AS n_unique, count(*) - count({name}) AS n_missing, "
        f"{category} AS category, {sub} AS sub_type FROM part"
    )


PROFILE_TYPE_SQL = " UNION ALL ".join(_part_type_sql(n, k) for n, k in PART_KINDS.items())


def mask_sensitive(spark, sf_dir):
    customer = table(spark, sf_dir, "customer")
    sensitive = ["c_name", "c_mktsegment"]
    shown = [scalars.mask_if(F.col(c), c, sensitive).alias(c) for c in customer.columns]
    return customer.select(*shown)


def redact_statistics(spark, sf_dir):
    statistics = numeric_summary(table(spark, sf_dir, "customer"), ["c_custkey", "c_acctbal"])
    return redact(statistics, ["c_acctbal"]).select(
        "column_name", "n_valid", "mean", "median", "min", "max", "redacted"
    )


REDACT_SQL = (
    "SELECT 'c_custkey' AS column_name, count(*) AS n_valid, round(avg(c_custkey), 4) AS mean, "
    "round(quantile_cont(c_custkey, 0.5), 4) AS median, CAST(min(c_custkey) AS DOUBLE) AS min, "
    "CAST(max(c_custkey) AS DOUBLE) AS max, false AS redacted FROM customer UNION ALL "
    "SELECT 'c_acctbal', count(*), NULL, NULL, NULL, NULL, true FROM customer"
)


def integral_text(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    text = scalars.integral_text(F.col("l_quantity"))
    other = scalars.integral_text(F.col("l_extendedprice"))
    return lines.groupBy(text.alias("quantity_text"), F.length(other).cast("bigint").alias("price_length")).agg(
        F.count(F.lit(1)).alias("cnt")
    )


_INTEGRAL = "CASE WHEN {x} = floor({x}) THEN CAST(CAST({x} AS BIGINT) AS VARCHAR) ELSE CAST({x} AS VARCHAR) END"
INTEGRAL_SQL = (
    f"SELECT {_INTEGRAL.replace('{x}', 'l_quantity')} AS quantity_text, "
    f"length({_INTEGRAL.replace('{x}', 'l_extendedprice')}) AS price_length, count(*) AS cnt "
    "FROM lineitem GROUP BY 1, 2"
)

MIXED_TEXT = """
    SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN concat('x', CAST(o_custkey AS STRING))
                            ELSE CAST(o_custkey AS STRING) END AS mixed FROM orders"""


def to_number(spark, sf_dir):
    rows = run_sql(spark, sf_dir, MIXED_TEXT)
    return rows.select("o_orderkey", scalars.to_number(F.col("mixed")).alias("number"))


def text_dates(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    day = F.col("o_orderdate")
    text = (
        F.when(F.col("o_orderkey") % 5 == 0, F.lit("no-date"))
        .when(F.col("o_orderkey") % 5 == 1, F.date_format(day, "dd/MM/yyyy"))
        .when(F.col("o_orderkey") % 5 == 2, F.date_format(day, "yyyy-MM-dd HH:mm:ss"))
        .otherwise(F.date_format(day, "yyyy-MM-dd"))
    )
    return orders.select("o_orderkey", "o_orderstatus", text.alias("date_text"))


TEXT_DATES = """
    SELECT o_orderkey, o_orderstatus, CASE WHEN o_orderkey % 5 = 0 THEN 'no-date'
        WHEN o_orderkey % 5 = 1 THEN strftime(o_orderdate, '%d/%m/%Y')
        WHEN o_orderkey % 5 = 2 THEN strftime(o_orderdate, '%Y-%m-%d %H:%M:%S')
        ELSE strftime(o_orderdate, '%Y-%m-%d') END AS date_text FROM orders"""


def to_timestamp(spark, sf_dir):
    parsed = scalars.to_timestamp(F.col("date_text"))
    return text_dates(spark, sf_dir).select(
        "o_orderkey", F.date_format(parsed, "yyyy-MM-dd HH:mm:ss").alias("parsed")
    )


TIMESTAMP_SQL = (
    f"WITH t AS ({TEXT_DATES}) SELECT o_orderkey, strftime(coalesce(try_strptime(date_text, '%Y-%m-%d %H:%M:%S'), "
    "try_strptime(date_text, '%Y-%m-%d'), try_strptime(date_text, '%d/%m/%Y')), '%Y-%m-%d %H:%M:%S') AS parsed FROM t"
)

AS_OF = "2001-10-01 06:00:00"


def age_days(spark, sf_dir):
    age = scalars.age_days(F.col("o_orderdate"), F.lit(AS_OF).cast("timestamp"))
    return table(spark, sf_dir, "orders").select("o_orderkey", age.alias("age_days"))


_AGE = f"CAST(floor(epoch(TIMESTAMP '{AS_OF}' - o_orderdate) / 86400) AS BIGINT)"


def age_text(spark, sf_dir):
    age = scalars.age_days(F.col("o_orderdate"), F.lit(AS_OF).cast("timestamp"))
    return table(spark, sf_dir, "orders").groupBy(age.alias("age_days")).agg(
        F.count(F.lit(1)).alias("cnt")
    ).withColumn("age_text", scalars.age_text(F.col("age_days")))


def _plural_sql(n: str, one: str, many: str) -> str:
    return f"CAST({n} AS VARCHAR) || CASE WHEN {n} > 1 THEN ' {many}' ELSE ' {one}' END"


AGE_TEXT_SQL = (
    f"WITH a AS (SELECT {_AGE} AS age_days, count(*) AS cnt FROM orders GROUP BY 1) "
    "SELECT age_days, cnt, CASE WHEN age_days = 0 THEN 'Hoy' WHEN age_days = 1 THEN '1 dia' "
    "WHEN age_days < 30 THEN CAST(age_days AS VARCHAR) || ' dias' "
    f"WHEN age_days < 365 THEN {_plural_sql('(age_days // 30)', 'mes', 'meses')} || "
    f"CASE WHEN age_days % 30 > 0 THEN ' y ' || {_plural_sql('(age_days % 30)', 'dia', 'dias')} ELSE '' END "
    f"ELSE {_plural_sql('(age_days // 365)', 'año', 'años')} || "
    f"CASE WHEN (age_days % 365) // 30 > 0 THEN ' y ' || {_plural_sql('((age_days % 365) // 30)', 'mes', 'meses')} "
    "ELSE '' END END AS age_text FROM a"
)


def clip_range(spark, sf_dir):
    return table(spark, sf_dir, "customer").select(
        "c_custkey", scalars.clip(F.col("c_acctbal"), 0, 5000).alias("clipped")
    )


FORMAT_TEXTS = {
    "page_url": ("pages", "url"),
    "page_id_text": ("pages", "CAST(page_id AS STRING)"),
    "supplier_mail": ("supplier", "concat(replace(s_name, '#', '.'), '@example.com')"),
    "customer_phone": ("customer", "concat('6', substr(c_name, 11, 8))"),
    "customer_dni": ("customer", "concat(substr(c_name, 11, 8), 'X')"),
    "customer_card": ("customer", "concat('4000 1234 5678 ', substr(c_name, 16, 4))"),
    "customer_ip": ("customer", "concat('10.0.', CAST(c_nationkey AS STRING), '.', CAST(c_custkey % 300 AS STRING))"),
    "order_price": ("orders", "CAST(o_totalprice AS STRING)"),
    "order_day": ("orders", "substr(CAST(o_orderdate AS STRING), 1, 10)"),
    "order_zip": ("orders", "substr(concat('0000', CAST(o_custkey AS STRING)), -5)"),
    "order_eu_day": ("orders", "concat(substr(CAST(o_orderdate AS STRING), 9, 2), '/', substr(CAST(o_orderdate AS STRING), 6, 2), '/', substr(CAST(o_orderdate AS STRING), 1, 4))"),
    "document_text": ("documents", "text"),
}
FORMAT_TEXT_SQL = " UNION ALL ".join(
    f"SELECT '{name}' AS source_column, {expression} AS value FROM {source}"
    for name, (source, expression) in FORMAT_TEXTS.items()
)


def format_predicates(spark, sf_dir):
    """Matches of all named formats over twelve text columns, one aggregate."""
    counts = [
        F.count_if(patterns.matches(F.col("value"), p)).alias(name)
        for name, p in patterns.VALUE_FORMATS.items()
    ]
    return run_sql(spark, sf_dir, FORMAT_TEXT_SQL).groupBy("source_column").agg(
        F.count("value").alias("n_values"), *counts
    )


FORMAT_SQL = (
    f"WITH t AS ({FORMAT_TEXT_SQL}) SELECT source_column, count(value) AS n_values, "
    + ", ".join(
        f"count(*) FILTER (WHERE regexp_matches(value, '^(?:{p})')) AS {name}"
        for name, p in patterns.VALUE_FORMATS.items()
    )
    + " FROM t GROUP BY 1"
)

STORED_PATTERNS = """
    SELECT CASE WHEN p_size <= 25 THEN NULL WHEN p_size <= 40 THEN 7 ELSE 8 END AS owner_id,
           p_name AS key, concat('^', p_brand, '$') AS regex FROM part"""


def pattern_resolution(spark, sf_dir):
    return patterns.resolve_patterns(run_sql(spark, sf_dir, STORED_PATTERNS), 7)


PATTERN_SQL = (
    f"WITH p AS ({STORED_PATTERNS}) SELECT key, regex FROM p WHERE owner_id IS NULL OR owner_id = 7 "
    "QUALIFY row_number() OVER (PARTITION BY key ORDER BY owner_id IS NULL, regex) = 1"
)


def score_labels(spark, sf_dir):
    label = scalars.score_label(F.col("l_discount") * 2 + 0.85)
    return table(spark, sf_dir, "lineitem").groupBy(label.alias("label")).agg(F.count(F.lit(1)).alias("cnt"))


LABEL_SQL = (
    "SELECT CASE WHEN l_discount * 2 + 0.85 >= 0.98 THEN 'Excellent' WHEN l_discount * 2 + 0.85 >= 0.95 THEN 'Good' "
    "WHEN l_discount * 2 + 0.85 >= 0.90 THEN 'Acceptable' ELSE 'Poor' END AS label, count(*) AS cnt "
    "FROM lineitem GROUP BY 1"
)


def duration_texts(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    finished = F.when(F.col("event_type") != "error", F.col("ts"))
    started = F.lit("2024-01-01 00:00:00").cast("timestamp")
    return events.select("event_id", scalars.duration_text(started, finished).alias("duration"))


_SECONDS = "CAST(floor(epoch(ts - TIMESTAMP '2024-01-01 00:00:00')) AS BIGINT)"
DURATION_SQL = (
    f"WITH e AS (SELECT event_id, CASE WHEN event_type <> 'error' THEN {_SECONDS} END AS s FROM events) "
    "SELECT event_id, CASE WHEN s IS NULL THEN 'N/A' WHEN s < 60 THEN s || ' seconds' "
    "WHEN s < 3600 THEN (s // 60) || ' minutes ' || (s % 60) || ' seconds' "
    "ELSE (s // 3600) || ' hours ' || ((s % 3600) // 60) || ' minutes' END AS duration FROM e"
)


def severity_remap(spark, sf_dir):
    return (
        view(spark, sf_dir, "issues")
        .groupBy("level", scalars.stored_severity(F.col("level")).alias("stored"))
        .agg(F.count(F.lit(1)).alias("cnt"))
    )


REMAP_SQL = with_views(
    "SELECT level, CASE level WHEN 'critical' THEN 'critical' WHEN 'high' THEN 'major' WHEN 'low' THEN 'info' "
    "ELSE 'minor' END AS stored, count(*) AS cnt FROM issues GROUP BY 1, 2",
    "issues",
)

DESCRIPTIONS = """
    SELECT l_orderkey, concat(CASE WHEN l_partkey % 6 = 0 THEN 'Low COMPLETENESS '
        WHEN l_partkey % 6 = 1 THEN 'duplicate rows ' WHEN l_partkey % 6 = 2 THEN 'bad Pattern '
        WHEN l_partkey % 6 = 3 THEN 'an Outlier ' WHEN l_partkey % 6 = 4 THEN 'uniqueness and outlier '
        ELSE 'something ' END, l_returnflag) AS description FROM lineitem"""


def issue_type_inference(spark, sf_dir):
    rows = run_sql(spark, sf_dir, DESCRIPTIONS)
    kind = scalars.issue_type_from_text(F.col("description"))
    return rows.groupBy("description", kind.alias("issue_type")).agg(F.count(F.lit(1)).alias("cnt"))


ISSUE_TYPE_SQL = (
    f"WITH t AS ({DESCRIPTIONS}) SELECT description, CASE WHEN lower(description) LIKE '%completeness%' THEN 'completeness' "
    "WHEN lower(description) LIKE '%uniqueness%' OR lower(description) LIKE '%duplicate%' THEN 'uniqueness' "
    "WHEN lower(description) LIKE '%consistency%' OR lower(description) LIKE '%pattern%' THEN 'consistency' "
    "WHEN lower(description) LIKE '%outlier%' THEN 'outliers' ELSE 'general' END AS issue_type, count(*) AS cnt "
    "FROM t GROUP BY 1, 2"
)


def array_column_nulls(spark, sf_dir):
    """Missing cells of a table with an array column; nested columns are counted, not compared."""
    stats = column_stats(table(spark, sf_dir, "embeddings"))
    return stats.select("column_name", "kind", "n_rows", "n_valid", "n_missing")


ARRAY_SQL = " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, '{k}' AS kind, count(*) AS n_rows, count({c}) AS n_valid, "
    f"count(*) - count({c}) AS n_missing FROM embeddings"
    for c, k in {"vec_id": "integer", "embedding": "nested", "label": "integer"}.items()
)

QUERIES = [
    Query("null_patterns", "C1", null_patterns, NULL_PATTERN_SQL),
    Query("semantic_column_types", "C2", semantic_types, SEMANTIC_SQL),
    Query("profile_column_types", "C3", profile_types, PROFILE_TYPE_SQL),
    Query("mask_sensitive", "C4", mask_sensitive, "SELECT c_custkey, '***' AS c_name, c_nationkey, c_acctbal, '***' AS c_mktsegment FROM customer"),
    Query("redact_statistics", "C5", redact_statistics, REDACT_SQL),
    Query("integral_number_text", "C6", integral_text, INTEGRAL_SQL),
    Query("to_number", "C7", to_number, f"WITH t AS ({MIXED_TEXT}) SELECT o_orderkey, TRY_CAST(mixed AS DOUBLE) AS number FROM t"),
    Query("to_timestamp", "C8", to_timestamp, TIMESTAMP_SQL),
    Query("age_days", "C9", age_days, f"SELECT o_orderkey, {_AGE} AS age_days FROM orders"),
    Query("age_text", "C10", age_text, AGE_TEXT_SQL),
    Query("clip_range", "C11", clip_range, "SELECT c_custkey, least(greatest(c_acctbal, 0.0), 5000.0) AS clipped FROM customer"),
    Query("format_predicates", "C12", format_predicates, FORMAT_SQL),
    Query("pattern_resolution", "C13", pattern_resolution, PATTERN_SQL),
    Query("score_labels", "C16", score_labels, LABEL_SQL),
    Query("duration_texts", "C17", duration_texts, DURATION_SQL),
    Query("severity_remap", "C18", severity_remap, REMAP_SQL),
    Query("issue_type_inference", "C19", issue_type_inference, ISSUE_TYPE_SQL),
    Query("array_column_nulls", "S5 Q1", array_column_nulls, ARRAY_SQL),
]
