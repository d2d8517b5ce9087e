"""The whole exploratory profile of a table."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from tablegauge.functions.columns import kinds
from tablegauge.operators import profiling
from tablegauge.operators.correlation import pearson, spearman
from tablegauge.operators.frequency import value_frequency


@dataclass
class Profile:
    """Lazy frames; `frequency` is the shared, persisted intermediate — unpersist it when done."""

    overview: DataFrame
    columns: DataFrame
    statistics: DataFrame
    type_summary: DataFrame
    histogram: DataFrame
    boxplot: DataFrame
    modes: DataFrame
    bar_chart: DataFrame
    pearson: DataFrame
    spearman: DataFrame
    frequency: DataFrame


def profile(
    df: DataFrame,
    iqr_factor: float = 1.5,
    sensitive: list[str] | None = None,
    size_bytes: int | None = None,
) -> Profile:
    """Overview, column types, statistics, distributions and correlations.

    Sensitive columns keep their counts and lose everything derived from their values.
    """
    profiling.check_iqr_factor(iqr_factor)
    sensitive = sensitive or []
    open_columns = [c for c, k in kinds(df).items() if k != "nested" and c not in sensitive]
    visible = df.select(*[df[f"`{c}`"] for c in open_columns])
    # Sensitive columns are only counted, so their long texts need not be carried.
    frequency = value_frequency(df, None, open_columns).persist()
    types = profiling.column_types(df, frequency)
    return Profile(
        overview=profiling.overview(df, size_bytes),
        columns=types,
        statistics=profiling.redact(profiling.numeric_summary(df), sensitive),
        type_summary=profiling.type_summary(types),
        histogram=profiling.adaptive_histogram(visible, frequency),
        boxplot=profiling.boxplot(visible, factor=iqr_factor),
        modes=profiling.modes(visible, frequency),
        bar_chart=profiling.bar_chart(visible, frequency),
        pearson=pearson(visible),
        spearman=spearman(visible),
        frequency=frequency,
    )
