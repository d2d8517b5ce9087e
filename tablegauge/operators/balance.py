"""Class balance: how evenly the values of a categorical column are spread."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablegauge.functions.columns import kinds
from tablegauge.functions.fingerprints import balance_fingerprint
from tablegauge.functions.scalars import mask_where, percent_text
from tablegauge.functions.severity import severity
from tablegauge.operators.findings import Metric, MetricFrames, details, issues_of
from tablegauge.operators.frequency import distinct_counts, top_values
from tablegauge.session import local_rows

# Parameter defaults and limits.
MAX_CARDINALITY = 50
MAX_INTEGER_CLASSES = 20
MAX_UNIQUE_RATIO = 0.25
HIGH_SHARE, LOW_SHARE = 0.90, 0.05
RARE_MINORITY = 0.02
TABLE_SIZE = 20
OTHERS = "__others__"
LOG_OFFSET = 1e-12


class ClassBalance(Metric):
    """params: columns, auto_detect, max_cardinality, imbalance_threshold_high/_low,
    expected_distribution {column: {class: [min %, max %]}}."""

    metric_id = "class_balance"

    def explicit(self, df, params) -> list[str]:
        return [c for c in params.get("columns") or [] if c in df.columns]

    def expectations(self, df, params) -> list[tuple[str, str, float, float]]:
        out = []
        for name, classes in (params.get("expected_distribution") or {}).items():
            for value, bounds in classes.items():
                if not isinstance(bounds, (list, tuple)) or len(bounds) != 2:
                    raise ValueError(f"expected range of {name}={value} must be [min, max]")
                if name in df.columns:
                    out.append((name, str(value), float(bounds[0]), float(bounds[1])))
        return out

    def frequency_columns(self, df, params, context):
        chosen = self.explicit(df, params)
        if params.get("auto_detect", True):
            chosen += [
                c for c, k in kinds(df).items() if k in ("string", "integer") and c not in chosen
            ]
        return chosen

    def targets(self, df, frequency, params) -> DataFrame:
        """(column_name, n_classes, n_values) of the columns to check."""
        explicit = self.explicit(df, params)
        integers = [c for c, k in kinds(df).items() if k == "integer"]
        n = F.col("n_unique")
        fits = (
            (n > 1)
            & (n / F.col("n_values") <= MAX_UNIQUE_RATIO)
            & (n <= params.get("max_cardinality", MAX_CARDINALITY))
        )
        if integers:
            fits = fits & (~F.col("column_name").isin(*integers) | (n <= MAX_INTEGER_CLASSES))
        if not params.get("auto_detect", True):
            fits = F.lit(False)
        wanted = F.col("column_name").isin(*explicit) | fits if explicit else fits
        return distinct_counts(frequency).where(wanted).withColumnRenamed("n_unique", "n_classes")

    def classes(self, df, frequency, params) -> DataFrame:
        """(column_name, value, cnt, proportion, n_classes, n_values) of the checked columns."""
        targets = self.targets(df, frequency, params)
        return frequency.join(F.broadcast(targets), "column_name").withColumn(
            "proportion", F.col("cnt") / F.col("n_values")
        )

    def balance(self, classes: DataFrame, context) -> DataFrame:
        """One row per column: entropy, balance index, dominant and minority class."""
        p = F.col("proportion")
        place = F.struct((-F.col("cnt")).alias("order"), F.col("value"), p.alias("proportion"))
        summary = classes.groupBy("column_name", "n_classes", "n_values").agg(
            (-F.sum(p * F.log2(p + LOG_OFFSET))).alias("raw_entropy"),
            F.min(place).alias("dominant"),
            F.max(place).alias("minority"),
        )
        several = F.col("n_classes") > 1
        sensitive = F.col("column_name").isin(*context.sensitive) if context.sensitive else F.lit(False)
        return summary.select(
            "column_name",
            "n_classes",
            "n_values",
            F.when(several, F.col("raw_entropy")).otherwise(0.0).alias("entropy"),
            F.when(several, F.log2(F.col("n_classes").cast("double"))).otherwise(0.0).alias("max_entropy"),
            F.when(several, F.col("raw_entropy") / F.log2(F.col("n_classes").cast("double")) * 100)
            .otherwise(0.0)
            .alias("balance_index"),
            mask_where(F.col("dominant.value"), sensitive).alias("dominant_class"),
            F.col("dominant.proportion").alias("dominant_proportion"),
            mask_where(F.col("minority.value"), sensitive).alias("minority_class"),
            F.col("minority.proportion").alias("minority_proportion"),
        )

    def conformity(self, df, frequency, params, context) -> DataFrame:
        """One row per expected class: its share, whether it is in range, and how far off."""
        expected = df.sparkSession.createDataFrame(
            self.expectations(df, params),
            "column_name string, class string, min_pct double, max_pct double",
        )
        checked = self.targets(df, frequency, params).select("column_name", "n_values")
        counts = frequency.select("column_name", F.col("value").alias("class"), "cnt")
        actual = F.coalesce(F.col("cnt") / F.col("n_values"), F.lit(0.0)) * 100.0
        below, above = F.abs(actual - F.col("min_pct")), F.abs(actual - F.col("max_pct"))
        in_range = (actual >= F.col("min_pct")) & (actual <= F.col("max_pct"))
        # The expectations come from the configuration, so they are the broadcast side.
        found = counts.join(F.broadcast(expected), ["column_name", "class"], "inner").select(
            "column_name", "class", "cnt"
        )
        return (
            expected.join(F.broadcast(checked), "column_name")
            .join(F.broadcast(found), ["column_name", "class"], "left")
            .select(
                "column_name",
                "class",
                "min_pct",
                "max_pct",
                actual.alias("actual_pct"),
                in_range.alias("in_range"),
                F.when(in_range, 0.0).otherwise(F.least(below, above)).alias("deviation_pp"),
            )
        )

    def frequency_table(self, classes: DataFrame, context) -> DataFrame:
        """Top classes of each column and one entry for the rest; one masked entry if sensitive."""
        sensitive = F.col("column_name").isin(*context.sensitive) if context.sensitive else F.lit(False)
        shown = mask_where(F.col("value"), sensitive)
        top = top_values(classes, TABLE_SIZE)
        listed = top.groupBy("column_name", shown.alias("value"), "n_classes", "n_values").agg(
            F.sum("cnt").alias("cnt")
        )
        rest = (
            top.groupBy("column_name", "n_classes", "n_values")
            .agg(F.sum("cnt").alias("listed"))
            .where(F.col("n_classes") > TABLE_SIZE)
        )
        n_rest = (F.col("n_classes") - TABLE_SIZE).alias("n_merged")
        others = rest.select(
            "column_name",
            mask_where(F.lit(OTHERS), sensitive).alias("value"),
            (F.col("n_values") - F.col("listed")).alias("cnt"),
            "n_values",
            n_rest,
        )
        rows = listed.select(
            "column_name", "value", "cnt", "n_values", F.lit(None).cast("bigint").alias("n_merged")
        ).unionByName(others)
        return (
            rows.groupBy("column_name", "value", "n_values")
            .agg(F.sum("cnt").alias("cnt"), F.max("n_merged").alias("n_merged"))
            .withColumn("proportion", F.col("cnt") / F.col("n_values"))
            .drop("n_values")
        )

    def frames(self, df, shared, params, context) -> MetricFrames:
        high = params.get("imbalance_threshold_high", HIGH_SHARE)
        low = params.get("imbalance_threshold_low", LOW_SHARE)
        # One row per checked column.
        columns = local_rows(self.balance(self.classes(df, shared.frequency, params), context))
        issues = [self._dominant_issues(columns, high), self._minority_issues(columns, low)]
        conformity_score = None
        if self.expectations(df, params):
            classes = local_rows(self.conformity(df, shared.frequency, params, context))
            issues.append(self._deviation_issues(classes, context))
            conformity_score = classes.groupBy("column_name").agg(
                F.round(F.avg(F.col("in_range").cast("double")) * 100, 2).alias("conformity_score")
            )
            columns = columns.join(F.broadcast(conformity_score), "column_name", "left")
        else:
            columns = columns.withColumn("conformity_score", F.lit(None).cast("double"))
        alerts = F.when(F.col("dominant_proportion") >= high, 1).otherwise(0) + F.when(
            (F.col("minority_proportion") <= low) & (F.col("n_classes") > 1), 1
        ).otherwise(0)
        columns = columns.withColumn("n_alerts", alerts)
        return MetricFrames(
            self._score(df, columns, params), columns, reduce(DataFrame.unionByName, issues)
        )

    def _score(self, df, columns, params) -> DataFrame:
        """Only columns the caller asked about count; detected ones inform but do not score."""
        expected = {name for name, *_ in self.expectations(df, params)}
        asked = sorted(set(self.explicit(df, params)) | expected)
        part = F.round("balance_index", 2) / 100.0
        both = 0.5 * part + 0.5 * F.col("conformity_score") / 100.0
        if not asked:
            score: Column = F.lit(None)
        elif self.explicit(df, params):
            score = F.coalesce(F.avg("part"), F.lit(1.0))
        else:
            score = F.avg("part")
        counted = columns.where(F.col("column_name").isin(*asked) if asked else F.lit(False))
        return counted.select(F.coalesce(both, part).alias("part")).agg(
            score.cast("double").alias("score")
        ).select(F.lit(self.metric_id).alias("metric"), "score")

    def _dominant_issues(self, columns, high):
        share = percent_text(F.col("dominant_proportion"), 1)
        return issues_of(
            columns.where(F.col("dominant_proportion") >= high),
            self.metric_id,
            issue_type="class_balance",
            severity=severity("class_balance", F.col("dominant_proportion")),
            column_name=F.col("column_name"),
            rule_key="balance_dominant_class",
            description=F.concat(
                F.lit("Class "), "dominant_class", F.lit(" dominates column "), "column_name"
            ),
            actual_value=share,
            details=details(
                dominant_class=F.col("dominant_class"),
                dominant_proportion=F.round("dominant_proportion", 4),
                balance_index=F.round("balance_index", 2),
            ),
            fingerprint=balance_fingerprint(F.col("column_name"), "dominant_class"),
        )

    def _minority_issues(self, columns, low):
        share = percent_text(F.col("minority_proportion"))
        return issues_of(
            columns.where((F.col("minority_proportion") <= low) & (F.col("n_classes") > 1)),
            self.metric_id,
            issue_type="class_balance",
            severity=F.when(F.col("minority_proportion") < RARE_MINORITY, "medium").otherwise("low"),
            column_name=F.col("column_name"),
            rule_key="balance_minority_class",
            description=F.concat(
                F.lit("Class "), "minority_class", F.lit(" is rare in column "), "column_name"
            ),
            actual_value=share,
            details=details(
                minority_class=F.col("minority_class"),
                minority_proportion=F.round("minority_proportion", 4),
                balance_index=F.round("balance_index", 2),
            ),
            fingerprint=balance_fingerprint(F.col("column_name"), "minority_class"),
        )

    def _deviation_issues(self, classes, context):
        sensitive = F.col("column_name").isin(*context.sensitive) if context.sensitive else F.lit(False)
        label = mask_where(F.col("class"), sensitive)
        share = percent_text(F.col("actual_pct") / 100, 1)
        return issues_of(
            classes.where(~F.col("in_range")),
            self.metric_id,
            issue_type="class_balance",
            severity=severity("class_balance_deviation", F.col("deviation_pp") / 100.0),
            column_name=F.col("column_name"),
            rule_key="balance_distribution_deviation",
            description=F.concat(
                F.lit("Class "), label, F.lit(" of column "), "column_name",
                F.when(F.col("actual_pct") < F.col("min_pct"), " is below its expected range").otherwise(
                    " is above its expected range"
                ),
            ),
            actual_value=share,
            details=details(
                class_name=label,
                actual_pct=F.round("actual_pct", 2),
                deviation_pp=F.round("deviation_pp", 2),
            ),
            fingerprint=balance_fingerprint(
                F.col("column_name"), "distribution_deviation", F.col("class")
            ),
        )
