"""The pipeline over a small corpus, stage by stage, and the contract of the queries."""

import random

import numpy as np
import pytest

import __spark_entry__ as contract
import corpus_pipeline as pipeline
from tablegauge.llm.mixing import mix
from tablegauge.llm.queries import QUERIES, SQL
from tablegauge.llm.tokens import load_tokenizer, vocabulary_path
from tests.llm.test_text_ops import brute_join, brute_lines, near_copies, words

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, top_chance int, __removed int"


def corpus():
    rng = random.Random(8)
    rows, labels = [], []
    footer = "read more on this site and share it with all of your friends today"
    for i in range(1500):
        text = words(rng, rng.randint(15, 60), 3000)
        if i % 5 == 0:
            text += " vile nasty"
        if i % 7 == 0:
            text += "\n" + footer
        rows.append((i, text, f"site{i % 12}" if i % 3 else "big"))
        if i < 1200:
            labels.append((i, 1, int(i % 5 == 0)))
    base = [r[1] for r in rows if r[0] % 5 and r[0] % 7][:10]
    for text in base:
        for copy in near_copies(rng, text + " " + words(rng, 80), 3, 2):
            rows.append((len(rows), copy, f"site{len(rows) % 12}"))
    rows += [(len(rows), None, None), (len(rows) + 1, "", "big")]
    return rows, labels


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("corpus"))
    rows, labels = corpus()
    docs = spark.createDataFrame([(i, t, "en", s, len(t or ""), 1, 2) for i, t, s in rows], SCHEMA)
    docs.repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def three(rows):
    return [(r.doc_id, r.text, r.source) for r in rows]


def test_stages(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, stages = docs.columns, []
    for i, (_, stage) in enumerate(pipeline.STAGES):
        stages.append(docs.collect())
        stage(spark, docs, folder).write.parquet(f"{tmp_path}/{i}")
        docs = spark.read.parquet(f"{tmp_path}/{i}")
        if i < len(pipeline.STAGES) - 1:
            assert docs.columns == columns
    start, chosen, cleaned, single, mixed = stages
    vile = {r.doc_id for r in start if "vile" in (r.text or "")}
    kept = {r.doc_id for r in chosen}
    assert len(kept & vile) <= 0.03 * len(vile) and len(kept - vile) >= 0.97 * (len(start) - len(vile))
    assert sorted(three(cleaned), key=str) == sorted(((i, t, s) for (i, t), (_, _, s) in zip(brute_lines(three(chosen), 5), three(chosen), strict=True)), key=str)
    assert all(r.n_chars == len(r.text or "") for r in cleaned)
    assert {r.doc_id for r in single} == {c for c, _, _ in brute_join(three(cleaned)).values()}
    assert sorted(three(mixed), key=str) == sorted(three(single), key=str)
    # the order of the mixture is the order of the files
    wanted = {r.doc_id: (r.mix_slot, r.mix_place) for r in mix(spark.read.parquet(f"{tmp_path}/2")).collect()}
    read = spark.read.parquet(f"{tmp_path}/3").selectExpr("doc_id", "_metadata.file_name AS f", "_metadata.row_index AS r").collect()
    assert [r.doc_id for r in sorted(read, key=lambda r: (r.f, r.r))] == sorted(wanted, key=wanted.get)
    library = load_tokenizer(vocabulary_path("word_bpe_49k.json"))
    sizes = {r.doc_id: len(library.encode(r.text or "", add_special_tokens=False).ids) + 1 for r in mixed}
    got, levels = {}, {}
    for r in docs.collect():
        got[r.doc_id] = got.get(r.doc_id, 0) + r.length
        levels.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert got == sizes
    for parts in levels.values():
        ends = np.cumsum([n for _, n in sorted(parts)])
        assert [o for o, _ in sorted(parts)] == [0, *ends[:-1].tolist()] and ends[-1] <= 2048
    assert len(levels) <= 1.03 * sum(sizes.values()) / 2048 + 1


def test_run_and_rows_that_are_not_from_files(spark, folder):
    result = pipeline.run(spark, folder)
    assert result.count() > 0 and "sequence_id" in result.columns
    memory = spark.createDataFrame([(1, "a b", "s"), (None, None, None)], "doc_id long, text string, source string")
    assert pipeline.packing(spark, memory, folder).count() == 2
    assert pipeline.packing(spark, memory.limit(0), folder).count() == 0


def test_contract():
    registered = contract.queries()
    assert set(QUERIES) | {"pipeline"} <= set(registered)
    assert [sum(n.startswith(f"op{i}_") for n in QUERIES) for i in range(1, 11)] == [1] * 10
    assert set(SQL) <= set(QUERIES) and set(SQL) <= set(contract.oracle_sql())


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, name):
    from tests.oracle import connect, difference

    class Pair:
        run, sql = staticmethod(QUERIES[name]), SQL[name]

    assert difference(Pair, spark, connect("/root/testdata/sf0.001"), "/root/testdata/sf0.001") is None
