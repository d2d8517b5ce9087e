"""Equal-width histograms over every numeric column at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablegauge.functions.columns import numeric_columns
from tablegauge.operators.column_stats import CENTRE, column_stats
from tablegauge.operators.frequency import unpivoted, with_names, with_numbers

DEFAULT_BINS = 10
MIN_ADAPTIVE_BINS, MAX_ADAPTIVE_BINS = 10, 30


def adaptive_bins(n_unique: Column) -> Column:
    """One bin per distinct value, within 10 and 30."""
    return F.least(
        F.lit(MAX_ADAPTIVE_BINS).cast("bigint"),
        F.greatest(F.lit(MIN_ADAPTIVE_BINS).cast("bigint"), n_unique),
    )


def edge(index: Column) -> Column:
    """Left edge of bin `index`; the last edge is the upper bound itself."""
    inner = F.col("low") + index * ((F.col("high") - F.col("low")) / F.col("bins"))
    return F.when(index >= F.col("bins"), F.col("high")).otherwise(inner)


def bin_index(value: Column) -> Column:
    """Bin holding a value: the last bin is closed, and the edges themselves decide near ties."""
    scaled = (value - F.col("low")) / (F.col("high") - F.col("low")) * F.col("bins")
    guess = F.least(F.floor(scaled).cast("bigint"), F.col("bins") - 1)
    lowered = F.when(value < edge(guess), guess - 1).otherwise(guess)
    raise_it = (value >= edge(lowered + 1)) & (lowered != F.col("bins") - 1)
    return F.when(raise_it, lowered + 1).otherwise(lowered)


def bin_bounds(stats: DataFrame, bins: Column) -> DataFrame:
    """(column_name, low, high, bins); a constant column gets half a unit on each side."""
    flat = F.col("min") == F.col("max")
    return stats.where(F.col("min").isNotNull()).select(
        "column_name",
        F.when(flat, F.col("min") - 0.5).otherwise(F.col("min")).alias("low"),
        F.when(flat, F.col("max") + 0.5).otherwise(F.col("max")).alias("high"),
        bins.cast("bigint").alias("bins"),
    )


def histogram(
    df: DataFrame,
    columns: list[str] | None = None,
    bins: int = DEFAULT_BINS,
    bounds: DataFrame | None = None,
) -> DataFrame:
    """(column_name, bin, bin_start, cnt), empty bins included.

    `bounds` holds one row per numeric column, so it is broadcast; the rows are counted per
    column and bin inside each task before the shuffle.
    """
    names = numeric_columns(df, columns)
    if not names:
        return df.sparkSession.createDataFrame(
            [], "column_name string, bin bigint, bin_start double, cnt bigint"
        )
    if bounds is None:
        bounds = bin_bounds(column_stats(df, names, CENTRE), F.lit(bins))
    counted = with_names(
        unpivoted(df, names, "double")
        .join(F.broadcast(with_numbers(bounds, names).drop("column_name")), "column_no")
        .groupBy("column_no", bin_index(F.col("value")).alias("bin"))
        .agg(F.count(F.lit(1)).alias("cnt")),
        names,
    )
    all_bins = bounds.withColumn(
        "bin", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("bins") - 1))
    ).select("column_name", "bin", edge(F.col("bin")).alias("bin_start"))
    return (
        all_bins.join(F.broadcast(counted), ["column_name", "bin"], "left")
        .select("column_name", "bin", "bin_start", F.coalesce("cnt", F.lit(0)).cast("bigint").alias("cnt"))
    )
