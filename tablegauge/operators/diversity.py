"""Diversity: are the values or ranges a caller expects present in a column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablegauge.functions.columns import kinds, number_of, value_of
from tablegauge.functions.fingerprints import diversity_fingerprint
from tablegauge.functions.scalars import MASK, clip, percent_text, to_number
from tablegauge.functions.severity import severity
from tablegauge.operators.findings import Metric, MetricFrames, details, issues_of
from tablegauge.operators.frequency import distinct_counts
from tablegauge.session import local_rows

# Parameter defaults.
THRESHOLD = 0.60
MIN_REPRESENTATION = 0.01
NUM_BINS = 10
EMPTY_BINS_SHOWN = 5

COLUMN_SCHEMA = (
    "column_name string, type string, n_expected int, n_present bigint, n_under bigint, "
    "n_values bigint, score double"
)


class Diversity(Metric):
    """params: columns {name: {type, expected_values, min_representation, expected_range, num_bins}}, threshold."""

    metric_id = "diversity"

    def _configs(self, df, params) -> dict[str, dict]:
        columns = params.get("columns") or {}
        if not isinstance(columns, dict):
            columns = {str(name): {} for name in columns}
        return {
            name: config
            for name, config in columns.items()
            if name in df.columns and config.get("type", "categorical") in ("categorical", "numeric")
        }

    def categorical(self, df, params) -> dict[str, dict]:
        configs = self._configs(df, params).items()
        return {n: c for n, c in configs if c.get("type", "categorical") == "categorical"}

    def numeric(self, df, params) -> dict[str, dict]:
        return {n: c for n, c in self._configs(df, params).items() if c.get("type") == "numeric"}

    def frequency_columns(self, df, params, context):
        return list(self.categorical(df, params))

    def _number(self, df, name) -> Column:
        kind = kinds(df)[name]
        if kind == "string":
            number = to_number(value_of(name, kind))
            return F.when(~F.isnan(number), number)
        return number_of(name, kind)

    def aggregates(self, df, params, context):
        out = []
        for i, (name, config) in enumerate(self.numeric(df, params).items()):
            number = self._number(df, name)
            out += [
                F.count(number).alias(f"range_n__{i}"),
                F.min(number).alias(f"range_min__{i}"),
                F.max(number).alias(f"range_max__{i}"),
            ]
            for b, (low, high, last) in enumerate(bin_edges(config)):
                inside = clip(number, *config["expected_range"])
                upper = inside <= high if last else inside < high
                out.append(F.count_if((inside >= low) & upper).alias(f"range_bin__{i}__{b}"))
        return out

    def expected_values(self, df, frequency, params) -> DataFrame:
        """One row per expected value: its share, and whether it is present and well represented."""
        rows = []
        for name, config in self.categorical(df, params).items():
            least = float(config.get("min_representation", MIN_REPRESENTATION))
            for value in config.get("expected_values") or []:
                rows.append((name, str(value), least))
        expected = df.sparkSession.createDataFrame(
            rows, "column_name string, value string, min_representation double"
        )
        # The expected values come from the configuration, so they are the broadcast side.
        found = frequency.join(
            F.broadcast(expected.select("column_name", "value").distinct()), ["column_name", "value"]
        ).select("column_name", "value", "cnt")
        totals = distinct_counts(frequency).select("column_name", "n_values")
        share = F.coalesce(F.col("cnt") / F.col("n_values"), F.lit(0.0))
        present = F.col("cnt").isNotNull()
        return (
            expected.join(F.broadcast(totals), "column_name", "left")
            .join(F.broadcast(found), ["column_name", "value"], "left")
            .select(
                "column_name",
                "value",
                "min_representation",
                F.coalesce("n_values", F.lit(0)).alias("n_values"),
                share.alias("proportion"),
                present.alias("is_present"),
                (present & (share < F.col("min_representation"))).alias("is_under"),
            )
        )

    def bins(self, df, wide, params) -> DataFrame:
        """One row per bin of each expected range, with its count."""
        rows = []
        for i, (name, config) in enumerate(self.numeric(df, params).items()):
            for b, (low, high, _) in enumerate(bin_edges(config)):
                rows.append(
                    F.struct(
                        F.lit(name).alias("column_name"),
                        F.lit(b).alias("bin"),
                        F.lit(low).alias("low"),
                        F.lit(high).alias("high"),
                        F.col(f"range_bin__{i}__{b}").alias("cnt"),
                        F.col(f"range_n__{i}").alias("n_values"),
                    )
                )
        if not rows:
            return df.sparkSession.createDataFrame(
                [], "column_name string, bin int, low double, high double, cnt bigint, n_values bigint"
            )
        return wide.select(F.inline(F.array(*rows))).where("n_values > 0")

    def column_scores(self, df, values, bins, params) -> DataFrame:
        spark = df.sparkSession
        parts = spark.createDataFrame(
            [
                (name, config.get("type", "categorical"), 0, 0, 0, None, 1.0)
                for name, config in self._configs(df, params).items()
            ],
            COLUMN_SCHEMA,
        )
        scored = []
        if values is not None:
            n_under = F.count_if("is_under")
            credit = F.count_if("is_present") - n_under + 0.5 * n_under
            scored.append(
                values.groupBy("column_name", "n_values").agg(
                    F.count(F.lit(1)).cast("int").alias("n_expected"),
                    F.count_if("is_present").alias("n_present"),
                    n_under.alias("n_under"),
                    (credit / F.count(F.lit(1))).alias("score"),
                )
            )
        scored.append(
            bins.groupBy("column_name", "n_values")
            .agg(
                F.count(F.lit(1)).cast("int").alias("n_expected"),
                F.count_if(F.col("cnt") > 0).alias("n_present"),
                F.lit(0).cast("bigint").alias("n_under"),
                (F.count_if(F.col("cnt") > 0) / F.count(F.lit(1))).alias("score"),
            )
        )
        measured = scored[0] if len(scored) == 1 else scored[0].unionByName(scored[1])
        fields = ["n_expected", "n_present", "n_under", "n_values", "score"]
        joined = parts.alias("p").join(F.broadcast(measured.alias("m")), "column_name", "left")
        return joined.select(
            "column_name",
            "type",
            *[F.coalesce(F.col(f"m.{f}"), F.col(f"p.{f}")).alias(f) for f in fields],
        )

    def frames(self, df, shared, params, context) -> MetricFrames:
        threshold = float(params.get("threshold", THRESHOLD))
        # One row per expected value and per bin, both set by the configuration.
        bins = local_rows(self.bins(df, shared.wide, params))
        values = None
        if shared.frequency is not None:
            values = local_rows(self.expected_values(df, shared.frequency, params))
        columns = local_rows(
            self.column_scores(df, values, bins, params).withColumn(
                "below_threshold", F.col("score") < threshold
            )
        )
        score = columns.agg(F.avg("score").alias("score")).select(
            F.lit(self.metric_id).alias("metric"), "score"
        )
        issues = self._range_issues(bins, columns, threshold)
        if values is not None:
            values = values.join(
                F.broadcast(columns.select("column_name", "score", "n_present", "n_expected")),
                "column_name",
            )
            issues = (
                self._missing_issues(values, threshold, context)
                .unionByName(self._under_issues(values, context))
                .unionByName(issues)
            )
        return MetricFrames(score, columns, issues)

    def _label(self, context, value="value") -> Column:
        if not context.sensitive:
            return F.col(value)
        return F.when(F.col("column_name").isin(*context.sensitive), F.lit(MASK)).otherwise(F.col(value))

    def _missing_issues(self, values, threshold, context):
        return issues_of(
            values.where(~F.col("is_present")),
            self.metric_id,
            issue_type="diversity",
            severity=severity("diversity", F.col("score"), threshold),
            column_name=F.col("column_name"),
            rule_key="diversity_missing_value",
            description=F.concat(
                F.lit("Expected value "), self._label(context), F.lit(" is absent from column "), "column_name"
            ),
            actual_value=F.concat_ws("/", F.col("n_present").cast("string"), F.col("n_expected").cast("string")),
            details=details(missing_value=self._label(context)),
            fingerprint=diversity_fingerprint(F.col("column_name"), "missing_value", F.col("value")),
        )

    def _under_issues(self, values, context):
        share = F.round("proportion", 6)
        return issues_of(
            values.where("is_under"),
            self.metric_id,
            issue_type="diversity",
            severity=F.when(share < F.col("min_representation") / 2, "medium").otherwise("low"),
            column_name=F.col("column_name"),
            rule_key="diversity_underrepresented",
            description=F.concat(
                F.lit("Value "), self._label(context), F.lit(" is rare in column "), "column_name"
            ),
            actual_value=percent_text(share),
            details=details(value=self._label(context), proportion=share),
            fingerprint=diversity_fingerprint(F.col("column_name"), "underrepresented", F.col("value")),
        )

    def _range_issues(self, bins, columns, threshold):
        interval = F.format_string("[%.1f, %.1f)", "low", "high")
        empty = (
            bins.where("cnt = 0")
            .groupBy("column_name")
            .agg(F.sort_array(F.collect_list(F.struct("bin", interval.alias("text")))).alias("bins"))
        )
        shown = F.array_join(F.transform(F.slice("bins", 1, EMPTY_BINS_SHOWN), lambda b: b["text"]), " ")
        low = columns.where((F.col("type") == "numeric") & (F.col("score") < threshold)).join(
            F.broadcast(empty), "column_name", "left"
        )
        return issues_of(
            low,
            self.metric_id,
            issue_type="diversity",
            severity=severity("diversity", F.col("score"), threshold),
            column_name=F.col("column_name"),
            rule_key="diversity_low_range_coverage",
            description=F.concat(
                F.lit("Column "), "column_name", F.lit(" covers little of its expected range")
            ),
            actual_value=percent_text(F.col("score"), 0),
            details=details(
                bins_covered=F.col("n_present"), total_bins=F.col("n_expected"), empty_bins=shown
            ),
            fingerprint=diversity_fingerprint(F.col("column_name"), "low_range_coverage"),
        )


def bin_edges(config: dict) -> list[tuple[float, float, bool]]:
    """(low, high, is last) of the bins of an expected range; none when the range is not usable."""
    bounds = config.get("expected_range") or []
    count = int(config.get("num_bins", NUM_BINS))
    if len(bounds) != 2 or float(bounds[0]) >= float(bounds[1]):
        return []
    low, high = float(bounds[0]), float(bounds[1])
    step = (high - low) / count
    edges = [low + i * step for i in range(count)] + [high]
    return [(edges[i], edges[i + 1], i == count - 1) for i in range(count)]
