"""Column typing: storage kinds, semantic types, and null normalisation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# A column whose lower-cased name matches one of these is an identifier.
ID_NAME_PATTERNS = (r"_id$", r"^id$", r"_uuid$", r"^uuid$", r"_guid$", r"_key$")

# Distinct-count limits of the semantic types.
CATEGORICAL_MAX_DISTINCT = 20
DISCRETE_MAX_DISTINCT = 20
BINARY_MAX_DISTINCT = 2
NOMINAL_MAX_DISTINCT = 30

_INTEGER = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
_FRACTION = (T.FloatType, T.DoubleType)
_TIME = (T.DateType, T.TimestampType, T.TimestampNTZType)


def kind_of(data_type: T.DataType) -> str:
    """Storage kind: integer, fraction, decimal, boolean, string, time, or nested."""
    if isinstance(data_type, _INTEGER):
        return "integer"
    if isinstance(data_type, _FRACTION):
        return "fraction"
    if isinstance(data_type, T.DecimalType):
        return "decimal"
    if isinstance(data_type, T.BooleanType):
        return "boolean"
    if isinstance(data_type, (T.StringType, T.CharType, T.VarcharType)):
        return "string"
    if isinstance(data_type, _TIME):
        return "time"
    return "nested"


def kinds(df: DataFrame) -> dict[str, str]:
    return {field.name: kind_of(field.dataType) for field in df.schema.fields}


def is_numeric_kind(kind: str) -> bool:
    return kind in ("integer", "fraction", "decimal")


def numeric_columns(df: DataFrame, columns: list[str] | None = None) -> list[str]:
    chosen = set(columns) if columns else None
    return [c for c, k in kinds(df).items() if is_numeric_kind(k) and (chosen is None or c in chosen)]


def string_columns(df: DataFrame) -> list[str]:
    return [c for c, k in kinds(df).items() if k == "string"]


def present(df: DataFrame, columns: list[str] | None) -> list[str]:
    """The named columns that exist, in the order named; all columns when none is named."""
    if not columns:
        return list(df.columns)
    return [c for c in columns if c in df.columns]


def col(name: str) -> Column:
    """A column by its literal name, also when the name holds dots or spaces."""
    return F.col(sql_name(name))


def sql_name(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def sql_text(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def value_sql(name: str, kind: str) -> str:
    """SQL of the column with NaN read as null, so every operator counts the same missing cells."""
    quoted = sql_name(name)
    return f"nullif({quoted}, double('NaN'))" if kind == "fraction" else quoted


def value_of(name: str, kind: str) -> Column:
    return F.expr(value_sql(name, kind))


def number_of(name: str, kind: str) -> Column:
    return F.expr(f"double({value_sql(name, kind)})")


def semantic_type(column_name: Column, kind: Column, distinct: Column) -> Column:
    """ID by name, categorical when non-numeric and few values, else numeric or text."""
    numeric = kind.isin("integer", "fraction", "decimal", "boolean")
    return (
        F.when(F.lower(column_name).rlike("|".join(ID_NAME_PATTERNS)), "ID")
        .when(~numeric & (distinct <= CATEGORICAL_MAX_DISTINCT), "categorical")
        .when(numeric, "numeric")
        .otherwise("text")
    )


def profile_category(kind: Column) -> Column:
    return F.when(kind.isin("integer", "fraction", "decimal"), "numeric").otherwise("categorical")


def profile_sub_type(kind: Column, distinct: Column) -> Column:
    """continuous/discrete for numbers, binary/nominal/text for the rest."""
    return (
        F.when(kind == "boolean", "binary")
        .when(kind.isin("fraction", "decimal"), "continuous")
        .when((kind == "integer") & (distinct > DISCRETE_MAX_DISTINCT), "continuous")
        .when(kind == "integer", "discrete")
        .when(distinct <= BINARY_MAX_DISTINCT, "binary")
        .when(distinct <= NOMINAL_MAX_DISTINCT, "nominal")
        .otherwise("text")
    )
