"""The common shape of a metric's output and of an issue row."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablegauge.functions.columns import col, kinds
from tablegauge.functions.scalars import mask_if
from tablegauge.operators.column_stats import row_count
from tablegauge.operators.frequency import duplicate_totals, value_frequency

SAMPLE_ROWS = 5

ISSUE_SCHEMA = T.StructType(
    [
        T.StructField("metric", T.StringType()),
        T.StructField("issue_type", T.StringType()),
        T.StructField("severity", T.StringType()),
        T.StructField("column_name", T.StringType()),
        T.StructField("rule_key", T.StringType()),
        T.StructField("description", T.StringType()),
        T.StructField("actual_value", T.StringType()),
        T.StructField("affected_row_count", T.LongType()),
        T.StructField("details", T.MapType(T.StringType(), T.StringType())),
        T.StructField("sample", T.ArrayType(T.StringType())),
        T.StructField("fingerprint", T.StringType()),
    ]
)


@dataclass
class Context:
    """What a run knows besides the data."""

    as_of: Any = None
    sensitive: list[str] = field(default_factory=list)
    id_columns: list[str] = field(default_factory=list)
    patterns: DataFrame | None = None
    owner_id: int | None = None


@dataclass
class MetricFrames:
    """A metric's result: one score row, one row per checked column or rule, and its issues."""

    score: DataFrame
    columns: DataFrame
    issues: DataFrame


class Metric:
    """A check. `aggregates` joins the one shared scan; `frequency_columns` the shared counts."""

    metric_id = ""
    # A metric that only informs adds no issues to a run, so it cannot lower its score.
    informs_only = False
    # Whether the metric shows the values it counts; else long texts are counted by digest.
    shows_values = True

    def aggregates(self, df: DataFrame, params: dict, context: Context) -> list[Column]:
        return []

    def frequency_columns(self, df: DataFrame, params: dict, context: Context) -> list[str]:
        return []

    def needs_rows(self) -> bool:
        return False

    def frames(self, df: DataFrame, shared: "Shared", params: dict, context: Context) -> MetricFrames:
        raise NotImplementedError

    def run(self, df: DataFrame, params: dict | None = None, context: Context | None = None):
        """The metric by itself, with its own scan."""
        params, context = params or {}, context or Context()
        return self.frames(df, Shared.lazily(self, df, params, context), params, context)


@dataclass
class Shared:
    """Intermediates several metrics read: one aggregated row, value counts, row totals."""

    wide: DataFrame
    frequency: DataFrame | None
    rows: DataFrame | None

    @classmethod
    def lazily(cls, metric: Metric, df: DataFrame, params: dict, context: Context) -> "Shared":
        names = metric.frequency_columns(df, params, context)
        return cls(
            df.agg(row_count(), *metric.aggregates(df, params, context)),
            value_frequency(df, names, names if metric.shows_values else []) if names else None,
            duplicate_totals(df) if metric.needs_rows() else None,
        )


def issues_of(rows: DataFrame, metric: str, **fields: Column | str | None) -> DataFrame:
    """Issue rows from finding rows; fields not given are null."""
    out = []
    for target in ISSUE_SCHEMA.fields:
        value = metric if target.name == "metric" else fields.get(target.name)
        column = value if isinstance(value, Column) else F.lit(value)
        out.append(column.cast(target.dataType).alias(target.name))
    return rows.select(*out)


def no_issues(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], ISSUE_SCHEMA)


def details(**values: Column | str | float) -> Column:
    pairs = []
    for key, value in values.items():
        column = value if isinstance(value, Column) else F.lit(value)
        pairs += [F.lit(key), column.cast("string")]
    return F.create_map(*pairs)


def score_frame(rows: DataFrame, metric: str, score: Column) -> DataFrame:
    """One row (metric, score), the score an aggregate over `rows`."""
    return rows.agg(score.cast("double").alias("score")).select(F.lit(metric).alias("metric"), "score")


def fixed_score(spark: SparkSession, metric: str, score: float | None) -> DataFrame:
    return spark.createDataFrame([(metric, score)], "metric string, score double")


def row_sample(df: DataFrame, sensitive: list[str]) -> Column:
    """The row as JSON text, sensitive values masked before anything leaves the executors."""
    fields = [mask_if(col(name), name, sensitive).alias(name) for name in df.columns]
    return F.to_json(F.struct(*fields))


def ordered_sample(rank: str, text: str) -> Column:
    """Aggregate: the texts of a few sample rows in rank order."""
    return F.transform(F.sort_array(F.collect_list(F.struct(rank, text))), lambda s: s[text])


def order_columns(df: DataFrame, id_columns: list[str]) -> list[Column]:
    """What samples are ordered by: the caller's id columns, else all sortable columns."""
    return [col(c) for c in id_columns or [c for c, k in kinds(df).items() if k != "nested"]]


def first_rows_per_group(rows: DataFrame, group: str, order: list[Column], k: int) -> DataFrame:
    """The first k rows of each group; kept to k per group inside every task before the shuffle."""
    rank = F.row_number().over(Window.partitionBy(group).orderBy(*order))
    return rows.withColumn("sample_rank", rank).where(F.col("sample_rank") <= k)
