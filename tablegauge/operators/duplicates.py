"""Groups of identical rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tablegauge.functions.columns import kinds, present, value_sql
from tablegauge.operators.findings import SAMPLE_ROWS, first_rows_per_group, order_columns, row_sample
from tablegauge.operators.frequency import row_key

MAX_GROUPS = 50


def duplicate_groups(
    df: DataFrame, columns: list[str] | None = None, max_groups: int = MAX_GROUPS
) -> DataFrame:
    """The first duplicate groups in the order of their values: group_id, cnt and the key columns.

    Rows are grouped by keys in which texts are digests, so no text is shuffled for a row that has
    no duplicate. The values of the groups found are then read back, one row from each task that
    holds a group, and the listing is a top-k report over them.
    """
    names = present(df, columns)
    by_kind = kinds(df)
    values = [F.expr(value_sql(n, by_kind[n])).alias(f"value__{i}") for i, n in enumerate(names)]
    digests = [k.alias(f"digest__{i}") for i, k in enumerate(row_key(df, names))]
    group = F.struct(*[F.col(f"digest__{i}") for i in range(len(names))])
    whole = df.select(F.struct(*values).alias("key"), *digests).select("key", group.alias("group"))
    groups = whole.groupBy("group").agg(F.count(F.lit(1)).alias("cnt")).where(F.col("cnt") > 1)
    listed = whole.join(groups, "group").groupBy("group").agg(F.min("key").alias("key"), F.first("cnt").alias("cnt"))
    first = listed.select(*[F.col(f"key.value__{i}").alias(f"key__{i}") for i in range(len(names))], "cnt")
    keys = [F.col(f"key__{i}") for i in range(len(names))]
    first = first.orderBy(*keys).limit(max_groups)
    return first.withColumn("group_id", F.row_number().over(Window.orderBy(*keys)).cast("bigint"))


def duplicate_rows(
    df: DataFrame,
    columns: list[str] | None = None,
    id_columns: list[str] | None = None,
    sensitive: list[str] | None = None,
    max_groups: int = MAX_GROUPS,
    rows_per_group: int = SAMPLE_ROWS,
) -> DataFrame:
    """(group_id, cnt, copy, row): up to `rows_per_group` rows of each listed group.

    At most `max_groups` group rows are joined back by broadcast, and each task keeps only the
    first rows of a group before the shuffle, so a group of any size stays cheap.
    """
    names = present(df, columns)
    groups = duplicate_groups(df, names, max_groups)
    by_kind = kinds(df)
    keys = [F.expr(value_sql(n, by_kind[n])) for n in names]
    same = [keys[i].eqNullSafe(F.col(f"key__{i}")) for i in range(len(names))]
    condition = same[0]
    for part in same[1:]:
        condition = condition & part
    matched = df.join(F.broadcast(groups), condition)
    sample = first_rows_per_group(matched, "group_id", order_columns(df, id_columns or []), rows_per_group)
    return sample.select(
        "group_id",
        "cnt",
        F.col("sample_rank").cast("bigint").alias("copy"),
        row_sample(df, sensitive or []).alias("row"),
    )
