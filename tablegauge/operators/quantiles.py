"""Exact linear-interpolated quantiles in two scans, the same way at every size.

The first scan sketches each column (KLL, whose rank error is known); the sketch brackets every wanted
rank between two values. The second counts the values below, between and in the brackets, the latter
one by one: running counts then give the values at the ranks, and tell a bracket that missed its rank,
which is widened and counted again. Only while a bracket would hold more distinct values than one
task should order, a further scan sketches the inside of it. A column is never sorted, shuffled or held
by one task as a whole. Other aggregates, and sums of powers around the mean, ride on the two scans.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from tablegauge.functions.columns import kinds, numeric_columns, value_sql

QUARTILES = (0.25, 0.5, 0.75)

# Distinct values of one bracket that are ordered in one task.
BRACKET_VALUES = 200_000

# Size of a sketch: 8 bytes times a small multiple of this, for each column and task.
SKETCH_SIZE = 4096
# A bracket is narrowed at so many steps, by sketches of this size (rank error 0.5 %).
INNER_STEPS, INNER_SIZE = 64, 1024
# Half widths of the brackets a sketch is asked for, as multiples of its rank error.
WIDTHS = (1.5, 6.0, 24.0, 96.0)


def quantiles(
    df: DataFrame,
    columns: list[str] | None = None,
    probabilities: tuple[float, ...] = QUARTILES,
    limit: int = BRACKET_VALUES,
    size: int = SKETCH_SIZE,
) -> DataFrame:
    """(column_name, probability, quantile) for each numeric column."""
    found = two_scans(df, numeric_columns(df, columns), probabilities, limit=limit, size=size).quantiles
    rows = [(name, float(p), value) for (name, p), value in found.items()]
    return df.sparkSession.createDataFrame(rows, "column_name string, probability double, quantile double")


def quartiles(df: DataFrame, columns: list[str] | None = None, **options) -> DataFrame:
    """(column_name, q1, median, q3)."""
    names = numeric_columns(df, columns)
    found = two_scans(df, names, QUARTILES, **options).quantiles
    rows = [(c, *[found[c, p] for p in QUARTILES]) for c in names if (c, QUARTILES[0]) in found]
    return df.sparkSession.createDataFrame(rows, "column_name string, q1 double, median double, q3 double")


@dataclass
class TwoScans:
    """What the scans found: the row of the added aggregates, (column, probability) to quantile, and
    column to its sums of the second, third and fourth power of the distance from the mean."""

    row: Row | None = None
    quantiles: dict[tuple[str, float], float] = field(default_factory=dict)
    powers: dict[str, tuple[float, float, float]] = field(default_factory=dict)


@dataclass
class _Bracket:
    """A value range that should hold one wanted rank, and what is known of it."""

    column: int
    probability: float
    rank: int
    fraction: float
    ranges: list[tuple[float, float]]  # from narrow to wide, as the sketches gave them
    level: int
    estimate: float  # distinct values in the range, from above
    settled: bool = False

    @property
    def span(self) -> tuple[float, float]:
        return self.ranges[self.level]

    def widen(self) -> None:
        self.level = min(self.level + 1, len(self.ranges) - 1)


def _half_widths(size: int) -> list[float]:
    """Half widths in normalised ranks; a KLL sketch of size k has a rank error of 2.296 / k^0.9021 (at 99 %)."""
    return [w * 2.296 / size**0.9021 for w in WIDTHS]


def _sketched(value: str, at: list[float], size: int) -> list[Column]:
    """Count, distinct count, and for each rank of `at` the values at all half widths around it."""
    ranks = [min(1.0, max(0.0, p + side * w)) for p in at for w in _half_widths(size) for side in (-1, 1)]
    sketch = F.kll_sketch_agg_double(F.expr(value), size)
    return [
        F.count(F.expr(value)).alias("n"),
        F.approx_count_distinct(F.expr(value)).alias("n_distinct"),
        F.when(F.count(F.expr(value)) > 0, F.kll_sketch_get_quantile_double(sketch, F.array(*map(F.lit, ranks)))).alias("values"),
    ]


def _ranges(values: list[float], at: float, rows: int, size: int) -> tuple[list[tuple[float, float]], int]:
    """The ranges around a rank from narrow to wide, the last being all values, and the first to trust.

    A range that reaches the first or last rank is open on that side; one of a few rows' width may miss
    the neighbour of its rank.
    """
    out = []
    for i, width in enumerate(_half_widths(size)):
        low = float("-inf") if at - width <= 0 else values[2 * i]
        out.append((low, float("inf") if at + width >= 1 else values[2 * i + 1]))
    level = next((i for i, width in enumerate(_half_widths(size)) if width * rows >= 4), len(out))
    return [*out, (float("-inf"), float("inf"))], level


def two_scans(
    df: DataFrame,
    names: list[str],
    probabilities: tuple[float, ...] = QUARTILES,
    aggregates: list[Column] = (),
    powers: bool = False,
    limit: int = BRACKET_VALUES,
    size: int = SKETCH_SIZE,
) -> TwoScans:
    """Quantiles of the named numeric columns, with other aggregates of the table in the first scan and,
    on request, sums of powers in the second. What reaches the driver is bounded by columns and ranks."""
    by_kind = kinds(df)
    values = [f"double({value_sql(c, by_kind[c])})" for c in names]
    at = [float(p) for p in probabilities]
    sketches = [F.struct(*_sketched(v, at, size), F.expr(f"avg({v})").alias("mean")).alias(f"sketch__{i}") for i, v in enumerate(values)]
    if not sketches and not aggregates:
        return TwoScans()
    out = TwoScans(df.agg(*aggregates, *sketches).first())
    brackets, means = [], {}
    for i in range(len(names)):
        seen = out.row[f"sketch__{i}"]
        if not seen["n"]:
            continue
        means[i] = seen["mean"]
        for j, p in enumerate(at):
            position = (seen["n"] - 1) * p
            ranges, level = _ranges(seen["values"][2 * len(WIDTHS) * j :], p, seen["n"], size)
            share = min(1.0, 2 * _half_widths(size)[level]) if level < len(WIDTHS) else 1.0
            estimate = min(seen["n_distinct"], seen["n"] * share)
            brackets.append(_Bracket(i, p, int(position), position - int(position), ranges, level, estimate))
    _narrow(df, values, brackets, limit)
    open_brackets = brackets
    while open_brackets:
        counted = _count(df, values, open_brackets, means if powers and not out.powers else None)
        missed = []
        for b in open_brackets:
            row = counted.get(b.column)
            found, after = row[f"a{b.probability}"], row[f"b{b.probability}"]
            inside = found["region"] % 2 == 1 and (b.fraction == 0 or after["region"] % 2 == 1)
            if inside:
                step = (after["value"] - found["value"]) * b.fraction if b.fraction > 0 else 0.0
                out.quantiles[names[b.column], b.probability] = found["value"] + step
            else:
                b.widen()
                missed.append(b)
        if powers and not out.powers:
            out.powers = {names[i]: (row["m2"], row["m3"], row["m4"]) for i, row in counted.items()}
        open_brackets = missed
    return out


def _literal(value: float) -> str:
    return f"double('{value!r}')"


def _narrow(df: DataFrame, values: list[str], brackets: list[_Bracket], limit: int) -> None:
    """Sketch the inside of brackets with too many values until they have few; exact counts check each one."""
    steps = [j / INNER_STEPS for j in range(INNER_STEPS + 1)]
    while wide := [b for b in brackets if not b.settled and b.estimate > limit and b.span[0] < b.span[1]]:
        aggregates = []
        for i, b in enumerate(wide):
            low, high = map(_literal, b.span)
            x = values[b.column]
            inner = F.expr(f"CASE WHEN {x} BETWEEN {low} AND {high} THEN {x} END")
            grid = F.kll_sketch_get_quantile_double(F.kll_sketch_agg_double(inner, INNER_SIZE), F.array(*map(F.lit, steps)))
            counts = (F.count_if(F.expr(f"{x} < {low}")).alias("below"), F.count(inner).alias("n"), F.approx_count_distinct(inner).alias("n_distinct"))
            aggregates.append(F.struct(*counts, F.when(F.count(inner) > 0, grid).alias("grid")).alias(f"s{i}"))
        row = df.agg(*aggregates).first()
        for i, b in enumerate(wide):
            seen, (low, high) = row[f"s{i}"], b.span
            if not seen["below"] <= b.rank <= b.rank + (b.fraction > 0) < seen["below"] + seen["n"]:
                b.widen()
                b.settled = True
                continue
            # a step of the grid to either side is far wider than the error of the sketch
            at = int((b.rank - seen["below"]) / seen["n"] * INNER_STEPS)
            inner = (low if at < 2 else seen["grid"][at - 1], high if at + 2 >= INNER_STEPS else seen["grid"][at + 2])
            b.estimate = min(seen["n_distinct"], seen["n"] * 4 / INNER_STEPS)
            if inner == (low, high) or seen["n_distinct"] <= limit:
                b.settled = True
            else:
                b.ranges, b.level = [inner, *b.ranges[b.level :]], 0


def _count(df: DataFrame, values: list[str], brackets: list[_Bracket], means: dict[int, float] | None) -> dict[int, Row]:
    """Per column: the first value whose running count passes each rank, and the next rank, with its region.

    Region 2 i + 1 is the i-th bracket (brackets that overlap are one), even regions lie between them;
    values are told apart in brackets only.
    """
    by_column: dict[int, list[_Bracket]] = {}
    for b in brackets:
        by_column.setdefault(b.column, []).append(b)
    cells, targets = [], []
    every = sorted({b.probability for b in brackets})
    for column, own in by_column.items():
        spans: list[list[float]] = []
        for low, high in sorted(b.span for b in own):
            if spans and low <= spans[-1][1]:
                spans[-1][1] = max(spans[-1][1], high)
            else:
                spans.append([low, high])
        x = values[column]
        steps = " ".join(f"WHEN {x} < {_literal(a)} THEN {2 * i} WHEN {x} <= {_literal(b)} THEN {2 * i + 1}" for i, (a, b) in enumerate(spans))
        mean = means.get(column) if means else None
        gap = f"{x} - {_literal(mean)}" if mean is not None else "double(NULL)"
        cells.append(f"struct({column} AS column_no, CASE WHEN {x} IS NULL THEN NULL {steps} ELSE {2 * len(spans)} END AS region, {x} AS x, {gap} AS gap)")
        rank_of = {b.probability: b.rank for b in own}
        targets.append((column, *[rank_of.get(p) for p in every]))
    rows = df.selectExpr(f"inline(array({', '.join(cells)}))").where("region IS NOT NULL")
    rows = rows.withColumn("value", F.when(F.col("region") % 2 == 1, F.col("x")))
    sums = [F.sum(F.expr(" * ".join(["gap"] * power))).alias(f"m{power}") for power in (2, 3, 4)] if means else []
    counted = rows.groupBy("column_no", "region", "value").agg(F.count(F.lit(1)).alias("cnt"), *sums)
    upto = F.sum("cnt").over(Window.partitionBy("column_no").orderBy("region", "value"))
    ranks = df.sparkSession.createDataFrame(targets, "column_no int, " + ", ".join(f"r{i} bigint" for i in range(len(every))))
    ranked = counted.withColumn("upto", upto).join(F.broadcast(ranks), "column_no")
    place = F.struct("region", "value")
    found = []
    for i, p in enumerate(every):
        found += [F.min(F.when(F.col("upto") > F.col(f"r{i}") + after, place)).alias(f"{name}{p}") for name, after in (("a", 0), ("b", 1))]
    sums = [F.sum(f"m{power}").alias(f"m{power}") for power in (2, 3, 4)] if means else []
    return {row["column_no"]: row for row in ranked.groupBy("column_no").agg(*found, *sums).collect()}
