"""Evaluating a table: metrics, issues, score, diff against a baseline, and gate verdict."""

from __future__ import annotations

import logging
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablegauge.functions.columns import kinds
from tablegauge.functions.patterns import apply_null_patterns
from tablegauge.operators.balance import ClassBalance
from tablegauge.operators.column_stats import NULLS, row_count, to_long, wide_aggregates
from tablegauge.operators.completeness import Completeness
from tablegauge.operators.currentness import Currentness
from tablegauge.operators.diversity import Diversity
from tablegauge.operators.findings import Context, Metric, MetricFrames, Shared, no_issues
from tablegauge.operators.frequency import duplicate_totals, value_frequency
from tablegauge.operators.outliers import Outliers
from tablegauge.operators.profiling import numeric_code_issues, run_column_metrics
from tablegauge.operators.rules import LogicalConsistency
from tablegauge.operators.scoring import (
    GATE_DEFAULTS,
    blocking_count,
    diagnostic_base,
    gate_status,
    issue_counters,
    quality_score,
    severity_counts,
)
from tablegauge.operators.syntax import SyntacticAccuracy
from tablegauge.operators.uniqueness import Uniqueness
from tablegauge.session import local_rows

logger = logging.getLogger(__name__)

MetricFunction = Callable[[DataFrame, dict, Context], MetricFrames]

_METRICS: dict[str, Metric | MetricFunction] = {
    metric.metric_id: metric
    for metric in (
        Completeness(),
        Uniqueness(),
        SyntacticAccuracy(),
        LogicalConsistency(),
        ClassBalance(),
        Currentness(),
        Diversity(),
        Outliers(),
    )
}

# Ids a configuration may name although nothing computes them.
ACCEPTED_WITHOUT_METRIC = ("validity", "integrity", "conformity", "correlation")


def register_metric(metric_id: str, metric: Metric | MetricFunction) -> None:
    """Add a metric: a `Metric`, or a function (df, params, context) -> MetricFrames."""
    _METRICS[metric_id] = metric


@dataclass
class EvaluationContext(Context):
    """A run's identity, baseline issues and gate thresholds beside what metrics need."""

    run_id: int = 0
    project_id: int = 0
    baseline_issues: DataFrame | None = None
    gate: dict = field(default_factory=dict)


@dataclass
class Evaluation:
    """The frames of one run."""

    run: DataFrame
    scores: DataFrame
    issues: DataFrame
    column_metrics: DataFrame
    details: dict[str, DataFrame]
    skipped: dict[str, str]


def check_config(config: dict) -> list[dict]:
    """The metric entries of a configuration: at least one, known, none twice."""
    entries = config.get("metrics") or []
    if not entries:
        raise ValueError("a configuration needs at least one metric")
    ids = [entry.get("id") for entry in entries]
    unknown = sorted({str(i) for i in ids if i not in _METRICS and i not in ACCEPTED_WITHOUT_METRIC})
    if unknown:
        raise ValueError(f"unknown metrics: {', '.join(unknown)}")
    if len(set(ids)) != len(ids):
        raise ValueError("a metric is configured twice")
    return entries


def referenced_columns(df: DataFrame, entries: list[dict]) -> list[str]:
    """Columns any metric names; all columns when a metric names none."""
    named: set[str] = set()
    for entry in entries:
        columns = (entry.get("parameters") or {}).get("columns") or []
        if not columns:
            return list(df.columns)
        named.update(c["column"] if isinstance(c, dict) else c for c in columns)
    return [c for c in df.columns if c in named] or list(df.columns)


def evaluate(df: DataFrame, config: dict, context: EvaluationContext | None = None) -> Evaluation:
    """Run the configured metrics over a table.

    All metrics share one aggregate scan and one value-frequency table. What leaves it is bounded
    by the schema and the configuration (one row per column, rule or expected value), never by the
    number of rows, and the steps after it work on those few rows.
    """
    context = context or EvaluationContext()
    spark = df.sparkSession
    entries = check_config(config)
    chosen: list[tuple[str, Metric, dict]] = []
    functions: list[tuple[str, MetricFunction, dict]] = []
    skipped: dict[str, str] = {}
    for entry in entries:
        metric, params = _METRICS.get(entry["id"]), entry.get("parameters") or {}
        if metric is None:
            skipped[entry["id"]] = "no metric computes this"
        elif isinstance(metric, Metric):
            chosen.append((entry["id"], metric, params))
        else:
            functions.append((entry["id"], metric, params))

    aggregates = {"base": F.struct(*wide_aggregates(_flat(df), kinds(df), NULLS)).alias("base")}
    counted: set[str] = set()
    shown: set[str] = set()
    needs_rows = False
    for metric_id, metric, params in list(chosen):
        try:
            own = metric.aggregates(df, params, context)
            names = metric.frequency_columns(df, params, context)
            counted.update(names)
            if metric.shows_values:
                shown.update(names)
            needs_rows = needs_rows or metric.needs_rows()
            if own:
                aggregates[metric_id] = F.struct(*own).alias(metric_id)
        except (PySparkException, ValueError, TypeError, KeyError) as error:
            skipped[metric_id] = str(error)
            chosen = [c for c in chosen if c[0] != metric_id]
    apart: set[str] = set()
    try:
        wide = local_rows(df.agg(row_count(), *aggregates.values()))
    except PySparkException:
        # some metric fails on a row: it gets a scan of its own, in which it may go on without that part
        apart = {name for name, own in aggregates.items() if name != "base" and _fails(df, own)}
        wide = local_rows(df.agg(row_count(), *[a for name, a in aggregates.items() if name not in apart]))

    profiled = referenced_columns(df, entries)
    null_patterns = next(
        ((e.get("parameters") or {}).get("null_patterns") for e in entries if e["id"] == "completeness"), None
    )
    cleaned = apply_null_patterns(df, null_patterns, profiled)
    integers = [c for c, k in kinds(df).items() if k == "integer"]
    counted.update(integers)
    if cleaned is df:
        counted.update(c for c in profiled if c in _flat(df))
    frequency = value_frequency(df, [c for c in df.columns if c in counted], list(shown)).persist()
    rows = local_rows(duplicate_totals(df)) if needs_rows else None

    scores, issues, details = [], [], {}
    try:
        for metric_id, metric, params in chosen:
            names = metric.frequency_columns(df, params, context)
            own = wide.select("n_rows", f"`{metric_id}`.*") if metric_id in wide.columns else wide.select("n_rows")
            shared = Shared(
                own, frequency.where(F.col("column_name").isin(*names)) if names else None, rows
            )
            try:
                if metric_id in apart:
                    shared.wide = df.agg(row_count(), *metric.aggregates(df, params, context))
                frames = metric.frames(df, shared, params, context)
                scores.append(local_rows(frames.score))
                if not metric.informs_only:
                    issues.append(local_rows(frames.issues))
                details[metric_id] = frames.columns
            except (PySparkException, ValueError, TypeError, KeyError) as error:
                logger.warning("metric %s skipped: %s", metric_id, error)
                skipped[metric_id] = str(error)
        for metric_id, function, params in functions:
            frames = function(df, params, context)
            scores.append(local_rows(frames.score))
            issues.append(local_rows(frames.issues))
            details[metric_id] = frames.columns
        base = to_long(wide.select("n_rows", "base.*"), _flat(df), kinds(df), NULLS, ["n_rows"])
        late = local_rows(numeric_code_issues(df, frequency, base)) if scores else no_issues(spark)
        own_counts = frequency if cleaned is df else value_frequency(cleaned, profiled, [])
        column_metrics = local_rows(
            run_column_metrics(cleaned, own_counts.where(F.col("column_name").isin(*profiled)), profiled)
        )
    finally:
        frequency.unpersist()

    graded = reduce(DataFrame.unionByName, issues, no_issues(spark))
    found = graded.unionByName(late)
    known = context.baseline_issues
    if known is None:
        found = found.withColumn("is_new", F.lit(True))
    else:
        prints = known.where(F.coalesce("fingerprint", F.lit("")) != "").select("fingerprint").distinct()
        found = found.join(prints.withColumn("known", F.lit(True)), "fingerprint", "left").select(
            *no_issues(spark).columns, F.col("known").isNull().alias("is_new")
        )
    found = local_rows(found)
    score_rows = reduce(DataFrame.unionByName, scores) if scores else spark.createDataFrame(
        [], "metric string, score double"
    )
    run = _run_row(df, graded, found, score_rows, known, wide.first()["n_rows"], context)
    return Evaluation(run, score_rows, found, column_metrics, details, skipped)


def _fails(df: DataFrame, aggregate: Column) -> bool:
    try:
        df.agg(aggregate).collect()
    except PySparkException:
        return True
    return False


def _flat(df: DataFrame) -> list[str]:
    return [c for c, kind in kinds(df).items() if kind != "nested"]


def _run_row(df, graded, found, scores, known, n_rows, context) -> DataFrame:
    """One row: score, counters, diff and verdict of the run."""
    graded_counts = quality_score(severity_counts(graded), F.lit(len(df.columns)))
    counters = issue_counters(found).first()
    new, recurrent = found.agg(F.count_if("is_new"), F.count_if(~F.col("is_new"))).first()
    fixed = 0
    if known is not None:
        prints = known.where(F.coalesce("fingerprint", F.lit("")) != "").select("fingerprint").distinct()
        fixed = prints.join(found.select("fingerprint"), "fingerprint", "left_anti").count()
    blocking = found.agg(blocking_count(F.col("severity"), F.col("description"))).first()[0]
    limits = {**GATE_DEFAULTS, **context.gate}
    verdict = gate_status(
        F.col("quality_score"),
        F.lit(blocking),
        F.lit(new),
        limits["min_score"],
        limits["warning_margin"],
        limits["max_critical_issues"],
        limits["max_new_issues"],
    )
    base = diagnostic_base(scores).first()[0]
    return local_rows(
        graded_counts.select(
            F.lit(context.run_id).cast("bigint").alias("run_id"),
            F.lit(context.project_id).cast("bigint").alias("project_id"),
            F.lit("COMPLETED").alias("status"),
            verdict.alias("gate_status"),
            (F.col("quality_score") * 100).alias("quality_score"),
            F.lit(base).alias("diagnostic_base"),
            F.lit(n_rows).cast("bigint").alias("n_rows"),
            F.lit(counters["total_issues"]).cast("bigint").alias("total_issues"),
            F.lit(counters["critical_issues"]).cast("bigint").alias("critical_issues"),
            F.lit(new).cast("bigint").alias("new_issues"),
            F.lit(recurrent).cast("bigint").alias("recurrent_issues"),
            F.lit(fixed).cast("bigint").alias("fixed_issues"),
        )
    )
