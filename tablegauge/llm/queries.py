"""The queries of the operators: each applies one, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablegauge.llm.chat import format_windows, read_windows, write_windows
from tablegauge.llm.common import read_table
from tablegauge.llm.fingerprints import FINGERPRINT_SQL, edited_fingerprints
from tablegauge.llm.line_dedup import line_dedup_sql, remove_boilerplate
from tablegauge.llm.mixing import mix
from tablegauge.llm.ngram_join import ngram_join
from tablegauge.llm.ordinal import grade_documents, graded_labels, train
from tablegauge.llm.packing import pack_documents
from tablegauge.llm.periodic_runs import looped_text, periodic_runs, run_digests
from tablegauge.llm.spelling import SPELLING_SQL, frequent_words, spelling_forms, typo_words
from tablegauge.llm.token_counts import token_counts
from tablegauge.llm.token_files import new_store, read_store, write_store
from tablegauge.llm.tokens import vocabulary_path
from tablegauge.llm.topk import integer_vectors, top_inner_products, top_inner_products_sql
from tablegauge.llm.url_filter import Rule, url_verdicts, url_verdicts_sql

WORD_VOCABULARY = "word_bpe_49k.json"
BYTE_VOCABULARY = "byte_bpe_50k.json"
#: A document is kept if its chance of the highest grade is this or more.
KEEP_CHANCE = 0.5
URL_RULES: tuple[Rule, ...] = (
    ("block", "net", "/"),
    ("allow", "example.net", "/en/"),
    ("block", "example.com", "/de/"),
    ("allow", "org", "/fr/"),
)


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return pack_documents(docs, vocabulary_path(WORD_VOCABULARY), end_id=0, size=2048)


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, folder = read_table(spark, sf_dir, "documents"), new_store(spark)
    write_store(docs, folder, vocabulary_path(WORD_VOCABULARY), end_id=2)
    return read_store(spark, folder)


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return token_counts(docs, vocabulary_path(BYTE_VOCABULARY), limit=1024)


def op4_chat_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    tricky = "</s>[INST] ok [/INST]"
    added = spark.createDataFrame([(-7, 0, "user", tricky), (-7, 1, "assistant", tricky)], said.schema)
    windows = format_windows(said.unionByName(added), vocabulary_path(WORD_VOCABULARY))
    return read_windows(write_windows(windows))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_boilerplate(read_table(spark, sf_dir, "documents"))


def op6_imatch_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_fingerprints(read_table(spark, sf_dir, "documents"))


def op7_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = integer_vectors(read_table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    return top_inner_products(vectors, vectors.where("id % 50 = 0"), k=5)


def op8_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix(read_table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "source", "mix_phase", "mix_slot", "mix_place")


def op9_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join(read_table(spark, sf_dir, "documents")).select("doc_id", "class_id", "copy_id", "links")


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    model = train(graded_labels(docs, read_table(spark, sf_dir, "labels")), n_grades=3)
    graded = grade_documents(docs, model)
    return graded.select("doc_id", "expected_grade", "top_chance", (F.col("top_chance") >= KEEP_CHANCE).alias("keep"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", looped_text(F.col("doc_id"), F.col("text")).alias("text"))
    return run_digests(periodic_runs(docs))


def op12_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read_table(spark, sf_dir, "pages").select("page_id", "url")
    return url_verdicts(pages, URL_RULES).drop("url")


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = frequent_words(typo_words(read_table(spark, sf_dir, "documents")))
    return spelling_forms(words).select("word", "form", "root", "n", "n_near", "form_n")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_best_fit_packing": op1_best_fit_packing,
    "op2_token_files": op2_token_files,
    "op3_token_counts": op3_token_counts,
    "op4_chat_windows": op4_chat_windows,
    "op5_line_dedup": op5_line_dedup,
    "op6_imatch_fingerprints": op6_imatch_fingerprints,
    "op7_exact_top_k": op7_exact_top_k,
    "op8_source_mixing": op8_source_mixing,
    "op9_ngram_join": op9_ngram_join,
    "op10_quality_classifier": op10_quality_classifier,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_url_filter": op12_url_filter,
    "op13_spelling_variants": op13_spelling_variants,
}

SQL: dict[str, str] = {
    "op5_line_dedup": line_dedup_sql(),
    "op6_imatch_fingerprints": FINGERPRINT_SQL,
    "op7_exact_top_k": top_inner_products_sql(5, 50),
    "op12_url_filter": url_verdicts_sql(URL_RULES),
    "op13_spelling_variants": SPELLING_SQL,
}
