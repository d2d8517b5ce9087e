"""CSV files: the delimiter from the head, the encoding from all lines, then a distributed read."""

from __future__ import annotations

import csv

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablegauge.functions.columns import col
from tablegauge.sources import split_csv

DELIMITERS = ",;\t|"
HEAD_LINES = 100
HEAD_CHARACTERS = 8192
MALFORMED = "_malformed"

# Spark reads Latin-1 but not Windows-1252, which differs in these 32 code points.
LATIN_CONTROLS = "".join(map(chr, range(0x80, 0xA0)))
WINDOWS_LETTERS = "".join(
    bytes([code]).decode("cp1252", errors="ignore") or chr(code) for code in range(0x80, 0xA0)
)

# Texts that stand for a missing cell in a CSV file.
NA_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND",
    "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "n/a", "nan", "null",
)

# Texts read as truth values.
TRUE_TOKENS = ("True", "TRUE", "true")
FALSE_TOKENS = ("False", "FALSE", "false")

INTEGER_TEXT = r"^\s*[+-]?\d+\s*$"
NUMBER_TEXT = r"^\s*[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?\s*$|^\s*[+-]?(?i:inf|infinity)\s*$"
LEADING_ZERO_TEXT = r"^\s*[+-]?0\d"


def sniff(spark: SparkSession, path: str) -> dict[str, str]:
    """Delimiter from the first lines of the data, encoding from every line of it."""
    text = spark.read.text(path)
    first = text.limit(HEAD_LINES).select(F.make_valid_utf8(F.substring("value", 1, HEAD_CHARACTERS)))
    head = "\n".join(row[0] for row in first.collect())[:HEAD_CHARACTERS]
    if not head.strip():
        raise ValueError(f"no data in {path}")
    if head.startswith("PK\x03\x04"):
        raise ValueError(f"{path} looks like an Excel workbook, not a CSV file")
    if head.startswith("\x1f"):
        raise ValueError(f"{path} is gzip data; name it .gz so it is decompressed on reading")
    try:
        delimiter = csv.Sniffer().sniff(head, delimiters=DELIMITERS).delimiter
    except csv.Error:
        counts = {d: head.splitlines()[0].count(d) for d in DELIMITERS}
        delimiter = max(counts, key=counts.get)
    readable = text.agg(F.bool_and(F.is_valid_utf8("value"))).first()[0]
    return {"sep": delimiter, "encoding": "UTF-8" if readable else "ISO-8859-1"}


def read_csv(
    spark: SparkSession,
    path: str,
    multi_line: bool = True,
    typed: bool = True,
    malformed: str = "fail",
) -> DataFrame:
    """A CSV file or folder as a table.

    A row with more cells than the header has would lose them: with `malformed` "fail" such rows end
    the read with their number and one of them, with "keep" the column `_malformed` holds their text.
    A row with fewer cells ends in missing ones.

    `multi_line` allows line breaks inside quotes; records are assembled from split files, over as many
    tasks as without them, and line breaks in cells stay as they are. Only files whose quotes stand in unquoted cells are then read by one task
    each, as their records cannot be found by counting quotes. With `typed` off every column stays text.
    """
    layout = sniff(spark, path)
    options = {"sep": layout["sep"], "escape": '"', "nullValue": "", "mode": "PERMISSIVE"}
    reader = spark.read.options(**options, header=True, encoding=layout["encoding"], multiLine=multi_line)
    names = reader.csv(path).columns
    schema = T.StructType([T.StructField(c, T.StringType()) for c in [*names, MALFORMED]])
    found = _split_records(spark, path, layout) if multi_line else None
    if found is None:
        text = reader.schema(schema).option("columnNameOfCorruptRecord", MALFORMED).csv(path)
    else:
        cells = F.from_csv(F.col("record"), schema.toDDL(), {**options, "multiLine": "true", "columnNameOfCorruptRecord": MALFORMED})
        text = found.select(cells.alias("cells")).select(*[F.col("cells").getField(c).alias(c) for c in [*names, MALFORMED]])
    # Spark marks short rows, too; one cell beyond the header tells the long ones
    wider = ", ".join(f"c{i} STRING" for i in range(len(names) + 1))
    beyond = F.from_csv(col(MALFORMED), wider, options)[f"c{len(names)}"]
    text = text.withColumn(MALFORMED, F.when(beyond.isNotNull(), col(MALFORMED)))
    if malformed != "keep":
        # Spark reads the marks only together with another column
        found = text.agg(F.count(MALFORMED).alias("n"), F.min(MALFORMED).alias("row"), F.count(col(names[0]))).first()
        if found["n"]:
            raise ValueError(f"{found['n']} rows of {path} have more cells than its header, such as: {found['row'][:200]}")
        text = text.drop(MALFORMED)
    if layout["encoding"] != "UTF-8":
        letters = str.maketrans(LATIN_CONTROLS, WINDOWS_LETTERS)
        text = text.select(
            *[
                F.translate(col(c), LATIN_CONTROLS, WINDOWS_LETTERS).alias(c.translate(letters))
                for c in text.columns
            ]
        )
    return choose_types(text) if typed else blank_to_null(text)


def _split_records(spark: SparkSession, path: str, layout: dict[str, str]) -> DataFrame | None:
    """`record` texts read in parallel; None where quotes do not tell records apart."""
    line_sep = split_csv.line_separator(spark, path)
    lines = split_csv.text_lines(spark, path, layout["encoding"], line_sep)
    header = split_csv.header_line(lines)
    states = split_csv.block_states(lines, header)
    if split_csv.is_misquoted(lines, states, layout["sep"]):
        return None
    return split_csv.records(lines, states, header, line_sep)


def blank_to_null(text: DataFrame) -> DataFrame:
    """Text columns with the missing-value tokens set to null."""
    return text.select(*[_cell(c).alias(c) for c in text.columns])


def _cell(name: str) -> Column:
    return F.when(~col(name).isin(*NA_TOKENS), col(name))


def _all(condition: Column) -> Column:
    return F.coalesce(F.bool_and(condition), F.lit(False))


def type_choices(text: DataFrame, leading_zeros_are_text: bool = True) -> dict[str, str]:
    """Column to type, from one aggregate over all columns: integer, number, truth value or text."""
    tests = []
    for i, name in enumerate(text.columns):
        cell = _cell(name)
        whole = cell.rlike(INTEGER_TEXT) & cell.try_cast("bigint").isNotNull()
        number = cell.rlike(NUMBER_TEXT)
        if leading_zeros_are_text:
            # Codes such as 08001 lose their first digit when read as numbers.
            whole = whole & ~cell.rlike(LEADING_ZERO_TEXT)
            number = number & (~cell.rlike(LEADING_ZERO_TEXT))
        truth = cell.isin(*TRUE_TOKENS, *FALSE_TOKENS)
        tests += [
            _all(F.when(cell.isNotNull(), whole)).alias(f"bigint__{i}"),
            _all(F.when(cell.isNotNull(), number)).alias(f"double__{i}"),
            _all(F.when(cell.isNotNull(), truth)).alias(f"boolean__{i}"),
        ]
    found = text.agg(*tests).first()
    choices = {}
    for i, name in enumerate(text.columns):
        fitting = [t for t in ("bigint", "double", "boolean") if found[f"{t}__{i}"]]
        choices[name] = fitting[0] if fitting else "string"
    return choices


def choose_types(text: DataFrame, leading_zeros_are_text: bool = True) -> DataFrame:
    """Text columns in the narrowest type that holds all their values."""
    choices = type_choices(text, leading_zeros_are_text)
    return text.select(*[_cell(c).try_cast(choices[c]).alias(c) for c in text.columns])
