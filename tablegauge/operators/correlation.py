"""Pearson and Spearman correlation of numeric columns, pairwise complete."""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tablegauge.functions.columns import col, kinds, number_of, numeric_columns, value_sql
from tablegauge.session import checkpointed

# Pairs of one aggregate: with many more its code grows too large to be compiled.
PAIRS_AT_ONCE = 300

PAIR_SCHEMA = "column_a string, column_b string, coefficient double"


def _pair_rows(wide: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    rows = [
        F.struct(
            F.lit(a).alias("column_a"), F.lit(b).alias("column_b"), F.col(f"c{i}").alias("coefficient")
        )
        for i, (a, b) in enumerate(pairs)
    ]
    return wide.select(F.inline(F.array(*rows)))


def pearson(
    df: DataFrame, columns: list[str] | None = None, sensitive: list[str] | None = None
) -> DataFrame:
    """(column_a, column_b, coefficient) of every column pair, in one aggregate per block of pairs."""
    names = [c for c in numeric_columns(df, columns) if c not in (sensitive or [])]
    pairs = list(combinations(names, 2))
    if not pairs:
        return df.sparkSession.createDataFrame([], PAIR_SCHEMA)
    blocks = [pairs[i : i + PAIRS_AT_ONCE] for i in range(0, len(pairs), PAIRS_AT_ONCE)]
    return reduce(DataFrame.unionByName, [_pearson_block(df, block) for block in blocks])


def _pearson_block(df: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    by_kind = kinds(df)
    number = {n: f"double({value_sql(n, by_kind[n])})" for pair in pairs for n in pair}
    # A null on either side leaves the row out of that pair only. `corr` itself fails on a
    # constant column, so the quotient is taken here.
    sums = [
        F.expr(f"regr_{kind}({number[a]}, {number[b]})").alias(f"{kind}{i}")
        for i, (a, b) in enumerate(pairs)
        for kind in ("sxy", "sxx", "syy")
    ]
    quotients = [
        f"try_divide(sxy{i}, sqrt(sxx{i}) * sqrt(syy{i})) AS c{i}" for i in range(len(pairs))
    ]
    return _pair_rows(df.agg(*sums).selectExpr(*quotients), pairs)


def spearman(
    df: DataFrame,
    columns: list[str] | None = None,
    sensitive: list[str] | None = None,
) -> DataFrame:
    """Correlation of average ranks.

    Columns without missing values are ranked once and correlated together. A pair with missing
    values is ranked over the rows that hold both.
    """
    names = [c for c in numeric_columns(df, columns) if c not in (sensitive or [])]
    if len(names) < 2:
        return df.sparkSession.createDataFrame([], PAIR_SCHEMA)
    by_kind = kinds(df)
    numbers = df.select(*[number_of(c, by_kind[c]).alias(c) for c in names])
    valid = numbers.agg(
        F.count(F.lit(1)).alias("n"), *[F.count(col(c)).alias(f"v{i}") for i, c in enumerate(names)]
    ).first()
    whole = [c for i, c in enumerate(names) if valid[f"v{i}"] == valid["n"]]
    parts = []
    if len(whole) > 1:
        parts.append(_rank_and_correlate(numbers.select(*[col(c) for c in whole])))
    for a, b in combinations(names, 2):
        if a not in whole or b not in whole:
            both = numbers.select(col(a), col(b)).where(col(a).isNotNull() & col(b).isNotNull())
            parts.append(_rank_and_correlate(both))
    return reduce(DataFrame.unionByName, parts)


def _rank_and_correlate(numbers: DataFrame) -> DataFrame:
    """Correlate the average ranks of columns that hold no missing value.

    Equal rows are merged into one row with a weight first, so no combination of values, however
    frequent, meets a join more than once. Each value has one rank row, so only the side of the
    rows can be skewed, and that side adaptive execution splits.
    """
    names = numbers.columns
    ranked = numbers.groupBy(*[col(n) for n in names]).agg(F.count(F.lit(1)).alias("weight"))
    for i, name in enumerate(names):
        ranks = average_ranks(numbers.select(col(name).alias("value")))
        ranks = ranks.select(F.col("value").alias("rank_key"), F.col("rank").alias(f"rank__{i}"))
        ranked = ranked.join(ranks, col(name) == F.col("rank_key")).drop("rank_key")
    pairs = list(combinations(range(len(names)), 2))
    weight = F.col("weight")
    sums = [F.sum(weight).alias("n")]
    for i in range(len(names)):
        rank = F.col(f"rank__{i}")
        sums += [F.sum(weight * rank * rank).alias(f"s{i}"), (F.min(rank) < F.max(rank)).alias(f"x{i}")]
    for i, j in pairs:
        sums.append(F.sum(weight * F.col(f"rank__{i}") * F.col(f"rank__{j}")).alias(f"s{i}_{j}"))
    # The mean of average ranks is (n + 1) / 2 whatever the ties.
    centre = F.col("n") * ((F.col("n") + 1) / 2) * ((F.col("n") + 1) / 2)
    coefficients = []
    for k, (i, j) in enumerate(pairs):
        spread = F.sqrt((F.col(f"s{i}") - centre) * (F.col(f"s{j}") - centre))
        coefficient = F.try_divide(F.col(f"s{i}_{j}") - centre, spread)
        coefficients.append(F.when(F.col(f"x{i}") & F.col(f"x{j}"), coefficient).alias(f"c{k}"))
    return _pair_rows(
        ranked.agg(*sums).select(*coefficients), [(names[i], names[j]) for i, j in pairs]
    )


def average_ranks(values: DataFrame) -> DataFrame:
    """(value, cnt, rank) of each distinct value; ties share the mean of their positions.

    The distinct values are range-partitioned, each partition's total is shifted by the totals
    before it, and running counts are taken inside the partitions. The partition number is stored
    before it is used twice, so a retried task cannot move a value.
    """
    counted = values.groupBy("value").agg(F.count(F.lit(1)).alias("cnt"))
    stored = checkpointed(
        counted.repartitionByRange("value").withColumn("part", F.spark_partition_id())
    )
    totals = stored.groupBy("part").agg(F.sum("cnt").alias("total"))
    # One row per shuffle partition, a number the session sets.
    before = F.sum("total").over(Window.orderBy("part")) - F.col("total")
    offsets = totals.select("part", before.alias("offset"))
    inside = F.sum("cnt").over(Window.partitionBy("part").orderBy("value")) - F.col("cnt")
    ranked = stored.join(F.broadcast(offsets), "part").withColumn("below", F.col("offset") + inside)
    return ranked.select("value", "cnt", (F.col("below") + (F.col("cnt") + 1) / 2).alias("rank"))


def as_matrix(pairs: DataFrame, columns: list[str], digits: int = 4) -> DataFrame:
    """One row per column with a coefficient per column, from the pair list."""
    spark = pairs.sparkSession
    diagonal = spark.createDataFrame([(c, c, 1.0) for c in columns], PAIR_SCHEMA)
    flipped = pairs.select(
        F.col("column_b").alias("column_a"), F.col("column_a").alias("column_b"), "coefficient"
    )
    return (
        pairs.unionByName(flipped)
        .unionByName(diagonal)
        .groupBy("column_a")
        .pivot("column_b", columns)
        .agg(F.round(F.first("coefficient"), digits))
    )
