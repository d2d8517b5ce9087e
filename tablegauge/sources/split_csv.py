"""CSV records with line breaks in quotes, read from split files.

Text lines are read by file block, as Spark splits a file over tasks. A quoted cell is open after a line
if the number of quotes up to there is odd, so one scan counts the lines with an odd number of quotes
in each block; their running sum over the blocks of a file tells for every block whether it starts inside
quotes. A block without such lines that starts outside holds one record a line and is used as it is.
Only the lines of the other blocks are shuffled, a block to a task, where running sums number their
records. A record that goes on in the next blocks is joined from its parts.

Counting quotes is exact where quotes stand as RFC 4180 has them; `is_misquoted` tells other files apart.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from tablegauge.session import checkpointed

#: Blocks to assemble are broadcast as 8-byte numbers up to this many, else joined by shuffle.
BROADCAST_BLOCKS = 1_000_000

BLOCK = ["file", "block"]


def _in_block() -> WindowSpec:
    return Window.partitionBy(*BLOCK).orderBy("at")


def _earlier_blocks() -> WindowSpec:
    return Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)


def line_separator(spark: SparkSession, path: str, characters: int = 8192) -> str:
    """A line feed, or a carriage return for files that only have those."""
    head = spark.read.option("lineSep", "\n").text(path).select(F.substring("value", 1, characters)).first()
    return "\r" if head and "\r" in head[0].removesuffix("\r") else "\n"


def text_lines(spark: SparkSession, path: str, encoding: str, line_sep: str) -> DataFrame:
    """`file`, `block` (its first byte), `at` (ascending within a block), `line` and `is_odd` (its number of quotes).

    Between line feeds, a carriage return stays at the end of a line; within quotes it is part of the cell.
    """
    value = F.col("value") if encoding == "UTF-8" else F.decode(F.col("value").cast("binary"), encoding)
    lines = spark.read.option("lineSep", line_sep).text(path).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("at"),
        value.alias("line"),
    )
    quotes = F.char_length("line") - F.char_length(F.replace("line", F.lit('"'), F.lit("")))
    return lines.withColumn("is_odd", (quotes % 2).cast("int"))


def header_line(lines: DataFrame) -> str:
    """The first line of a file."""
    first = lines.where("block = 0").select("line").first()
    return first[0] if first else ""


def block_states(lines: DataFrame, header: str) -> DataFrame:
    """Per block: its lines with an odd number of quotes, whether it starts inside quotes, and whether
    it can be used line by line. A short row a block, written once."""
    counted = lines.groupBy(*BLOCK).agg(
        F.sum("is_odd").alias("n_odd"),
        F.min_by("line", "at").alias("first"),
        F.count_if(F.col("line") == F.lit(header)).alias("n_headers"),
    )
    inside = F.coalesce(F.sum("n_odd").over(_earlier_blocks()), F.lit(0)) % 2
    # a header is known by its text where it comes first and no other line of the block is like it
    has_header = (F.col("first") == F.lit(header)) & (F.col("n_headers") == 1) & F.lit(bool(header.strip()))
    plain = (F.col("n_odd") == 0) & (F.col("inside") == 0) & ((F.col("block") > 0) | has_header)
    return checkpointed(counted.withColumn("inside", inside).select(*BLOCK, "n_odd", "inside", plain.alias("is_plain")))


def is_misquoted(lines: DataFrame, states: DataFrame, sep: str) -> bool:
    """Whether some quote neither opens nor closes a cell, so that counting quotes does not find the records.

    A quote that is not next to another must be next to a separator or an end of its line, a line that
    opens quotes must do so at the start of a cell, one that closes them at an end, and no file
    may end inside quotes.
    """
    s = "\\" + sep
    lone = rf'[^{s}"]"[^{s}"\r]'
    # possessive and without alternatives: Java matches other loops a stack frame a character, which long lines overflow
    cell = r'[^"]*+(?:""[^"]*+)*+'
    opens = F.col("line").rlike(rf'(?:^|{s})"{cell}$')
    closes = F.col("line").rlike(rf'^{cell}"(?:{s}|\r?$)')
    odd = lines.where("is_odd = 1").select(*BLOCK, "at", opens.alias("opens"), closes.alias("closes"))
    numbered = odd.withColumn("n", F.row_number().over(_in_block())).join(states.select(*BLOCK, "inside"), BLOCK)
    inside = (F.col("n") - 1 + F.col("inside")) % 2 == 1
    wrong = (
        lines.where(F.col("line").rlike(lone)).select("file"),
        numbered.where(F.when(inside, ~F.col("closes")).otherwise(~F.col("opens"))).select("file"),
        states.groupBy("file").agg(F.sum("n_odd").alias("n")).where("n % 2 = 1").select("file"),
    )
    return any(found.limit(1).count() for found in wrong)


def records(lines: DataFrame, states: DataFrame, header: str, line_sep: str) -> DataFrame:
    """`record`: the text of each record of the files but their headers and empty lines, in no order."""

    def whole(text: str, frame: DataFrame) -> DataFrame:
        trimmed = F.regexp_replace(text, r"\r$", "") if line_sep == "\n" else F.col(text)
        return frame.select(trimmed.alias("record")).where("record <> ''")

    def data_lines(frame: DataFrame) -> DataFrame:
        return whole("line", frame.where((F.col("block") > 0) | (F.col("line") != F.lit(header))))

    numbers = states.where("NOT is_plain").select(F.xxhash64(*BLOCK).alias("number")).distinct()
    n = numbers.count()
    if not n:
        return data_lines(lines)
    numbers = F.broadcast(numbers) if n <= BROADCAST_BLOCKS else numbers
    numbered = lines.withColumn("number", F.xxhash64(*BLOCK))
    # quotes are open before a line if the odd lines before it say so; other lines start a record
    facts = states.where("NOT is_plain").select(*BLOCK, "n_odd", "inside")
    within = numbered.join(numbers, "number", "left_semi").join(facts, BLOCK)
    opened = (F.sum("is_odd").over(_in_block()) - F.col("is_odd") + F.col("inside")) % 2
    within = within.withColumn("opened", opened).where((F.col("opened") == 1) | ~F.col("line").isin("", "\r"))
    within = within.withColumn("record_no", F.sum(1 - F.col("opened")).over(_in_block()))
    # records are grouped where their block is already
    parts = within.groupBy(*BLOCK, "record_no", "n_odd", "inside").agg(_joined("at", "line", line_sep).alias("line"))
    parts = checkpointed(parts)
    counts = parts.groupBy(*BLOCK).agg(F.max("record_no").alias("n_records"))
    places = counts.withColumn("earlier", F.coalesce(F.sum("n_records").over(_earlier_blocks()), F.lit(0)))
    # record 0 of a block is the end of the last record before it
    placed = parts.join(places, BLOCK).withColumn("of_file", F.col("earlier") + F.col("record_no"))
    ends_inside = (F.col("inside") + F.col("n_odd")) % 2 == 1
    crosses = (F.col("record_no") == 0) | ((F.col("record_no") == F.col("n_records")) & ends_inside)
    is_header = (F.col("block") == 0) & (F.col("record_no") == 1)
    single = placed.where(~crosses & ~is_header)
    spread = placed.where(crosses).groupBy("file", "of_file").agg(F.max(is_header).alias("is_header"), _joined("block", "line", line_sep).alias("line"))
    assembled = whole("line", single).unionByName(whole("line", spread.where("NOT is_header")))
    return data_lines(numbered.join(numbers, "number", "left_anti")).unionByName(assembled)


def _joined(order: str, text: str, line_sep: str) -> Column:
    lines = F.array_sort(F.collect_list(F.struct(order, text)))
    return F.array_join(F.transform(lines, lambda x: x[text]), line_sep)
