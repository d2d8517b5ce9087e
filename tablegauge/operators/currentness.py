"""Currentness: how old the newest date of a column is."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablegauge.functions.columns import kinds, value_of
from tablegauge.functions.fingerprints import parse_rate_fingerprint, staleness_fingerprint
from tablegauge.functions.scalars import (
    DATE_LAYOUTS,
    age_days,
    age_text,
    mask_where,
    percent_text,
    to_timestamp,
)
from tablegauge.functions.severity import severity
from tablegauge.operators.findings import Metric, MetricFrames, details, issues_of, score_frame
from tablegauge.session import local_rows

# Parameter defaults and limits.
STALENESS_DAYS = 30
DECAY_SCALE = 3
MIN_PARSE_RATE = 0.50
LOW_PARSE_RATE, LOW_PARSE_MIN_ROWS = 0.80, 10
RATIO_WITHOUT_THRESHOLD = 10.0


class Currentness(Metric):
    """params: columns, auto_detect, staleness_threshold_days, date_layouts. `as_of` is in the context."""

    metric_id = "currentness"

    def candidates(self, df, params) -> list[tuple[str, bool]]:
        """(column, named by the caller). Numbers are never read as dates."""
        by_kind = kinds(df)
        named = [
            c for c in params.get("columns") or [] if by_kind.get(c) in ("string", "time")
        ]
        out = [(c, True) for c in named]
        if params.get("auto_detect", True):
            out += [(c, False) for c, k in by_kind.items() if k in ("string", "time") and c not in named]
        return out

    def _parsed(self, df, name, params) -> Column:
        if kinds(df)[name] == "time":
            return value_of(name, "time").cast("timestamp")
        return to_timestamp(value_of(name, "string"), tuple(params.get("date_layouts", DATE_LAYOUTS)))

    def aggregates(self, df, params, context):
        out = []
        for i, (name, _) in enumerate(self.candidates(df, params)):
            parsed = self._parsed(df, name, params)
            out += [
                F.count(value_of(name, kinds(df)[name])).alias(f"date_valid__{i}"),
                F.count(parsed).alias(f"date_parsed__{i}"),
                F.min(parsed).alias(f"date_min__{i}"),
                F.max(parsed).alias(f"date_max__{i}"),
            ]
        return out

    def detection(self, df, wide, params) -> DataFrame:
        """One row per candidate: parse counts, range, and whether it counts as a date column."""
        by_kind = kinds(df)
        rows = [
            F.struct(
                F.lit(name).alias("column_name"),
                F.lit(by_kind[name]).alias("kind"),
                F.lit(named).alias("is_named"),
                F.col("n_rows").alias("n_rows"),
                *[
                    F.col(f"date_{part}__{i}").alias(f"{part}_date" if part in ("min", "max") else f"n_{part}")
                    for part in ("valid", "parsed", "min", "max")
                ],
            )
            for i, (name, named) in enumerate(self.candidates(df, params))
        ]
        if not rows:
            return df.sparkSession.createDataFrame(
                [],
                "column_name string, kind string, is_named boolean, n_rows bigint, n_valid bigint, "
                "n_parsed bigint, min_date timestamp, max_date timestamp, is_date boolean",
            )
        long = wide.select(F.inline(F.array(*rows)))
        of_rows = F.coalesce(F.try_divide("n_parsed", "n_rows") >= MIN_PARSE_RATE, F.lit(False))
        of_valid = F.coalesce(F.try_divide("n_parsed", "n_valid") >= MIN_PARSE_RATE, F.lit(False))
        is_date = (F.col("is_named") & of_rows) | (F.col("kind") == "time") | of_valid
        if not params.get("auto_detect", True):
            is_date = F.col("is_named") & of_rows
        return long.withColumn("is_date", is_date & (F.col("n_parsed") > 0))

    def frames(self, df, shared, params, context) -> MetricFrames:
        limit = params.get("staleness_threshold_days", STALENESS_DAYS)
        as_of = F.current_timestamp() if context.as_of is None else F.lit(context.as_of).cast("timestamp")
        age = F.col("age_days")
        window = max(1, limit * DECAY_SCALE)
        # One row per candidate column.
        columns = (
            local_rows(self.detection(df, shared.wide, params))
            .where("is_date")
            .withColumn("age_days", age_days(F.col("max_date"), as_of))
            .withColumn("date_range_days", age_days(F.col("min_date"), F.col("max_date")))
            .withColumn("parse_rate", F.col("n_parsed") / F.col("n_rows"))
            .withColumn("is_stale", age > limit)
            .withColumn(
                "freshness",
                F.when(age <= limit, 1.0).otherwise(
                    F.greatest(F.lit(0.0), 1.0 - (age - limit) / F.lit(float(window)))
                ),
            )
            .withColumn("age_text", age_text(age))
        )
        score = score_frame(columns, self.metric_id, F.coalesce(F.avg("freshness"), F.lit(1.0)))
        issues = self._stale_issues(columns, limit, context).unionByName(
            self._parse_issues(columns)
        )
        return MetricFrames(score, columns, issues)

    def _stale_issues(self, columns, limit, context):
        age = F.col("age_days")
        ratio = age / F.lit(float(limit)) if limit > 0 else F.lit(RATIO_WITHOUT_THRESHOLD)
        sensitive = F.col("column_name").isin(*context.sensitive) if context.sensitive else F.lit(False)
        newest = F.date_format("max_date", "yyyy-MM-dd'T'HH:mm:ss")
        return issues_of(
            columns.where("is_stale"),
            self.metric_id,
            issue_type="currentness",
            severity=severity("currentness_ratio", ratio),
            column_name=F.col("column_name"),
            rule_key="staleness_check",
            description=F.concat(
                F.lit("Newest date of column "), "column_name", F.lit(" is old: "), "age_text"
            ),
            actual_value=F.col("age_text"),
            details=details(
                age_days=age,
                max_date=mask_where(newest, sensitive),
                freshness_score=F.round("freshness", 4),
            ),
            fingerprint=staleness_fingerprint(F.col("column_name"), limit),
        )

    def _parse_issues(self, columns):
        low = (F.col("parse_rate") < LOW_PARSE_RATE) & (F.col("n_rows") > LOW_PARSE_MIN_ROWS)
        return issues_of(
            columns.where(low),
            self.metric_id,
            issue_type="currentness",
            severity="low",
            column_name=F.col("column_name"),
            rule_key="parse_quality_check",
            description=F.concat(
                F.lit("Only "), percent_text(F.col("parse_rate"), 1),
                F.lit(" of column "), "column_name", F.lit(" reads as a date"),
            ),
            details=details(parse_success_rate=F.round("parse_rate", 4)),
            fingerprint=parse_rate_fingerprint(F.col("column_name")),
        )
