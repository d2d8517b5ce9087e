"""The training-data pipeline: five stages over `documents`, each written as Parquet and read again.

1. quality classifier: documents that are unlikely to have the highest grade go;
2. line dedup: boilerplate lines that many sites share are removed but for their first occurrence;
3. n-gram Jaccard join: of documents with equal or similar n-grams, one stays;
4. mixing: rows are put in the order of the mixture, file by file, so that any stretch of them holds
   the sources by their target weights; no row is dropped;
5. packing: documents are packed into sequences in that order, a stretch of the mixture at a time.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablegauge.llm.common import read_table
from tablegauge.llm.line_dedup import remove_boilerplate
from tablegauge.llm.mixing import mix
from tablegauge.llm.ngram_join import drop_near_duplicates
from tablegauge.llm.ordinal import graded_labels, select_documents, train
from tablegauge.llm.packing import document_pieces, pack
from tablegauge.llm.queries import KEEP_CHANCE, WORD_VOCABULARY
from tablegauge.llm.tokens import vocabulary_path
from tablegauge.session import checkpoint_folder

END_ID = 0
#: Consecutive rows of the mixture that are packed together in the first round.
STRETCH_ROWS = 4096


def _columns(df: DataFrame, docs: DataFrame) -> DataFrame:
    return df.select(*[F.col(f"`{c}`") for c in docs.columns])


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = train(graded_labels(docs, read_table(spark, sf_dir, "labels")), n_grades=3)
    return select_documents(docs, model, KEEP_CHANCE)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts change, so `n_chars` is counted again where a line was removed."""
    cleaned = remove_boilerplate(docs, count="__removed")
    counted = F.when(F.col("__removed") > 0, F.char_length("text").cast("long")).otherwise(F.col("n_chars"))
    return _columns(cleaned.withColumn("n_chars", counted), docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_near_duplicates(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, in the order of the mixture over the files and within each."""
    order = ["__mix_slot", "__mix_place"]
    return _columns(mix(docs, prefix="__mix_").repartitionByRange(*order).sortWithinPartitions(*order), docs)


def _stretch(docs: DataFrame) -> DataFrame:
    """Number of the stretch of rows a row was read in; rows that are not from files are dealt by hash."""
    place = F.concat_ws("/", F.col("_metadata.file_name"), F.floor(F.col("_metadata.row_index") / STRETCH_ROWS).cast("string"))
    try:
        return docs.select("doc_id", "text", F.pmod(F.xxhash64(place), F.lit(1 << 33)).alias("stretch"))
    except AnalysisException:
        parts = F.lit(-(-max(1, docs.count()) // STRETCH_ROWS))
        return docs.select("doc_id", "text", F.pmod(F.xxhash64("doc_id", "text"), parts).alias("stretch"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces with their sequence and place. `docs` is read from files, whose row order is the mixture."""
    pieces = document_pieces(_stretch(docs), vocabulary_path(WORD_VOCABULARY), END_ID, carry="stretch")
    return pack(pieces, first_group=F.col("stretch")).drop("stretch")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", quality),
    ("line dedup", line_dedup),
    ("n-gram Jaccard join", near_duplicates),
    ("mixing sources to target weights", mixing),
    ("best-fit packing", packing),
]

#: Fitting a classifier, components of a graph and packing are not SQL; tests compare with brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    folder = f"{checkpoint_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for i, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{i}")
        docs = spark.read.parquet(f"{folder}/{i}")
    return docs
