"""Encoders, packing, token stores and counts against the plain library and brute force."""

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tablegauge.llm import tokens
from tablegauge.llm.common import text_batches, text_slices
from tablegauge.llm.packing import document_pieces, pack, pack_documents, sum_of_squares
from tablegauge.llm.token_counts import token_counts
from tablegauge.llm.token_files import read_document, read_store, write_store
from tablegauge.llm.tokens import PreTokenizer, WordEncoder, load_tokenizer, vocabulary_path

WORDS = vocabulary_path("word_bpe_49k.json")
BYTES = vocabulary_path("byte_bpe_50k.json")

HARD_TEXTS = [
    None,
    "",
    " ",
    "\n\n",
    "  two  spaces \t tab\n\nlines \n",
    "It's WE'LL they're 'twas don''t",
    "a\x1cb\x1d c!\x1f!",
    "x<|endoftext|>y <|startoftext|> <|endoftext|><|endoftext|>",
    "naïve Straße İstanbul ŒUVRE ſ ŉ Ÿ ½ x² ª",
    "日本語 текст עברית é ́x",
    " nbsp em　wide​zero\x85nel",
    "1234 5,678.90 --- ... ?!?! $#@",
    "word " * 3000,
    "�\u0000end",
]
DOCS = "doc_id long, text string, source string, piece string, __key int"


def frame(spark, texts):
    return spark.createDataFrame([(i, t, "s", "clash", 1) for i, t in enumerate(texts)], DOCS)


@pytest.fixture(scope="module")
def word_library():
    return load_tokenizer(WORDS)


@pytest.fixture(scope="module")
def byte_library():
    return load_tokenizer(BYTES)


def ids(library, text):
    return library.encode(text or "", add_special_tokens=False).ids


POOL = "   \n\tsabAB.,!éÉßñ09²\x1c<|>'  "


def random_texts(count, seed):
    rng = random.Random(seed)
    anything = [chr(c) for c in range(1, 0x3000)] + [chr(c) for c in range(0x1F600, 0x1F640)]
    return ["".join(rng.choices(POOL, k=rng.randint(0, 40)) + rng.choices(anything, k=rng.randint(0, 4)) + rng.choices(POOL, k=8)) for _ in range(count)]


def token_sums(parter, texts):
    names, token, owner, often, special = parter.frequencies(pa.array(texts, pa.string()))
    pieces = np.array(parter.pieces(names), dtype=np.int64)
    return (special + np.bincount(owner, weights=often * pieces[token], minlength=len(texts))).astype(int).tolist()


@pytest.mark.parametrize("seed", range(4))
def test_random_texts_encode_as_the_library(word_library, seed):
    encoder, texts = WordEncoder(WORDS), random_texts(400, seed)
    assert encoder.encode(pa.array(texts)) == [np.array(ids(word_library, t), dtype="<u4").tobytes() for t in texts]


@pytest.mark.parametrize("seed", range(4))
def test_random_texts_count_as_the_library(byte_library, seed):
    texts = random_texts(400, seed + 10)
    assert token_sums(PreTokenizer(BYTES), texts) == [len(ids(byte_library, t)) for t in texts]


def test_every_character(word_library, byte_library):
    """Any character beside letters, digits, marks and spaces, so that no class is taken for another."""
    texts = [f"a{chr(c)}b {chr(c)}1{chr(c)} .{chr(c)} {chr(c)}{chr(c)}" for c in [*range(1, 0x800), *range(0x2000, 0x2070), 0x3000, 0xFEFF]]
    assert WordEncoder(WORDS).encode(pa.array(texts)) == [np.array(ids(word_library, t), dtype="<u4").tobytes() for t in texts]
    assert token_sums(PreTokenizer(BYTES), texts) == [len(ids(byte_library, t)) for t in texts]


def test_tables_of_known_parts_are_bounded(word_library, monkeypatch):
    monkeypatch.setattr(tokens, "GENERATION", 50)
    encoder, texts = WordEncoder(WORDS), [f"w{i} w{i // 3} x{i}" for i in range(600)]
    for at in range(0, 600, 20):
        part = texts[at : at + 20]
        assert encoder.encode(pa.array(part)) == [np.array(ids(word_library, t), dtype="<u4").tobytes() for t in part]
    assert len(encoder.words.young) + len(encoder.words.old) < 300


def test_words_share_their_pieces(word_library):
    """Case and punctuation make no words of their own: what is looked up, and encoded, are the distinct pieces."""
    encoder = WordEncoder(WORDS)
    texts = [f"{w}{end}" for w in ("stone", "Stone", "STONE", "sand", "Sand") for end in ("", ".", ",", "!", "'s", "42")]
    assert encoder.encode(pa.array(texts)) == [np.array(ids(word_library, t), dtype="<u4").tobytes() for t in texts]
    assert sorted(x for x in encoder.words.young if x) == sorted(["stone", "sand", ".", ",", "!", "'s", "4", "2"])


def test_parts_in_pieces_of_a_sliced_array(word_library):
    """Arrays with an offset, nulls, and more pieces than go to the library at once."""
    texts = [None, "", *(f"a{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676)}x, {i}" for i in range(9000)), None]
    found = WordEncoder(WORDS).encode(pa.array(texts).slice(1, 9001), 7)
    assert found == [np.array([*ids(word_library, t), 7], dtype="<u4").tobytes() for t in texts[1:9002]]


def test_long_parts_are_not_kept(word_library):
    encoder = WordEncoder(WORDS)
    texts = [f"{i} short {c * 5000}{i} {c * 10}" for i in range(20) for c in "x本"]
    assert encoder.encode(pa.array(texts)) == [np.array(ids(word_library, t), dtype="<u4").tobytes() for t in texts]
    assert max(map(len, encoder.words.young)) <= tokens.KEPT_CHARACTERS
    assert "short" in encoder.words.young and "本" * 10 in encoder.words.young


def test_texts_are_worked_on_by_bytes(spark):
    """Batches and slices are bounded by the bytes of their texts; no row is lost."""
    docs = frame(spark, ["long " * 20_000] * 150 + [None, "", "short"]).coalesce(1).select("doc_id", "text")
    before = spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")
    sizes = docs.mapInArrow(lambda batches: (pa.RecordBatch.from_pydict({"n": [b.nbytes], "rows": [b.num_rows]}) for b in batches), "n long, rows long")
    with text_batches(spark):
        found = sizes.collect()
    assert max(r.n for r in found) < 8 << 20 and sum(r.rows for r in found) == 153
    assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == before
    batch = pa.record_batch({"doc_id": list(range(8)), "text": ["a" * 10, None, "b" * 30, "", "c", "d" * 20, "e" * 5, "f" * 5]})
    parts = list(text_slices([batch], 1, most_bytes=20))
    assert [p.column(0).to_pylist() for p in parts] == [[0, 1], [2], [3, 4], [5], [6, 7]]
    assert list(text_slices([batch.slice(0, 0)], 1)) == []


def test_hard_texts(word_library, byte_library):
    encoder, parter = WordEncoder(WORDS), PreTokenizer(BYTES)
    for texts in ([t] for t in HARD_TEXTS), [HARD_TEXTS]:
        for part in texts:
            assert encoder.encode(pa.array(part, pa.string())) == [np.array(ids(word_library, t), dtype="<u4").tobytes() for t in part]
            assert token_sums(parter, part) == [len(ids(byte_library, t)) for t in part]


@pytest.mark.parametrize("seed", range(40))
def test_sum_of_squares_is_the_best_place(seed):
    rng = np.random.default_rng(seed)
    lengths = rng.integers(1, 17, rng.integers(0, 50))
    bins, offsets = sum_of_squares(lengths, 16)
    levels: list[int] = []

    def squares(after):
        counts = np.bincount([x for x in after if 0 < x < 16], minlength=17)
        return int((counts**2).sum())

    for length, bin_, offset in zip(lengths.tolist(), bins, offsets, strict=True):
        options = [squares([*levels, length])]
        options += [squares([*levels[:i], x + length, *levels[i + 1 :]]) for i, x in enumerate(levels) if x + length <= 16]
        if bin_ == len(levels):
            levels.append(0)
        assert levels[bin_] == offset
        levels[bin_] += length
        assert levels[bin_] <= 16 and squares(levels) == min(options)


def check_packing(rows, size):
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= size
    return len(by)


def test_packing_of_documents(spark, word_library):
    texts = [*HARD_TEXTS, *HARD_TEXTS, "some more words here " * 900]
    rows = pack_documents(frame(spark, texts), WORDS, 0, 64).collect()
    check_packing(rows, 64)
    wanted = []
    for i, t in enumerate(texts):
        whole = [*ids(word_library, t), 0]
        for k, at in enumerate(range(0, len(whole), 64)):
            part = np.array(whole[at : at + 64], dtype="<u4")
            wanted.append((i, k, at, len(part), zlib.crc32(part.tobytes())))
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == sorted(wanted)


def test_packing_in_rounds_is_near_the_bound(spark):
    rng = np.random.default_rng(3)
    lengths = rng.integers(1, 2048, 6000).tolist()
    pieces = spark.createDataFrame([(i, int(x), 5) for i, x in enumerate(lengths)], "doc_id long, length long, offset int")
    rows = pack(pieces, group_pieces=500).collect()
    assert len(rows) == 6000
    assert check_packing(rows, 2048) <= 1.02 * sum(lengths) / 2048 + 1


def test_stretches_meet_in_the_next_round(spark):
    """Few pieces in many small groups: their badly filled sequences are packed again, however few pieces there are."""
    rng = random.Random(9)
    rows = [(i, rng.randint(1, 700), i // 10) for i in range(3000)]
    pieces = spark.createDataFrame(rows, "doc_id long, length long, stretch long")
    bound = -(-sum(r[1] for r in rows) // 2048)
    count = lambda packed: len({r.sequence_id for r in packed.collect()})
    alone, stretched = count(pack(pieces)), count(pack(pieces, first_group=F.col("stretch")))
    assert bound <= alone <= 1.01 * bound + 1 and stretched <= 1.01 * alone + 1


def test_pieces_that_never_fill_end_in_groups(spark):
    """Pieces of over half a sequence: rounds stop when they settle nothing, in groups of bounded size."""
    pieces = spark.createDataFrame([(i, 1100) for i in range(900)], "doc_id long, length long")
    packed = pack(pieces, group_pieces=50).collect()
    assert len(packed) == len({r.sequence_id for r in packed}) == 900


def test_packing_edges(spark):
    empty = frame(spark, [])
    assert pack_documents(empty, WORDS, 0).collect() == []
    nulls = spark.createDataFrame([(None, None, 1), (None, None, 1), (2, "x", 1)], "doc_id long, text string, sequence_id int")
    rows = pack_documents(nulls, WORDS, 0).collect()
    assert sorted((r.doc_id or -1, r.length) for r in rows) == [(-1, 1), (-1, 1), (2, 2)]
    assert check_packing(rows, 2048) == 1
    assert document_pieces(nulls, WORDS, 0).count() == 3


def test_store_round_trip(spark, word_library, tmp_path):
    texts = [*HARD_TEXTS, *(f"document {i} with words and more words {i * i}" for i in range(300))]
    docs = frame(spark, texts).repartition(5)
    write_store(docs, str(tmp_path), WORDS, 2)
    rows = sorted(read_store(spark, str(tmp_path), with_ids=True).collect())
    start = 0
    for i, (text, row) in enumerate(zip(texts, rows, strict=True)):
        wanted = [*ids(word_library, text), 2]
        raw = np.array(wanted, dtype="<u4").tobytes()
        assert (row.doc_id, row.start, row.n_tokens, row.ids_crc32) == (i, start, len(wanted), zlib.crc32(raw))
        assert row.ids == wanted
        start += len(wanted)
    assert read_document(spark, str(tmp_path), 7) == [[*ids(word_library, texts[7]), 2]]
    assert read_document(spark, str(tmp_path), 10_000) == []
    assert spark.read.parquet(f"{tmp_path}/dictionary").first().dictionary


def test_store_of_several_ranges_and_shards(spark, tmp_path, monkeypatch):
    from tablegauge.llm import token_files

    monkeypatch.setattr(token_files, "RANGE_DOCUMENTS", 40)
    monkeypatch.setattr(token_files, "SHARD_BYTES", 200)
    docs = frame(spark, [f"text {i} " * (i % 7 + 1) for i in range(200)]).repartition(3)
    write_store(docs, str(tmp_path), WORDS, 2)
    assert spark.read.parquet(f"{tmp_path}/shards").selectExpr("count(distinct range) > 3", "max(shard) > 0").first() == (True, True)
    rows = sorted(read_store(spark, str(tmp_path)).collect())
    at = 0
    for i, row in enumerate(rows):
        assert (row.doc_id, row.start) == (i, at)
        at += row.n_tokens


def test_store_edges(spark, tmp_path):
    write_store(frame(spark, []), f"{tmp_path}/none", WORDS, 2)
    assert read_store(spark, f"{tmp_path}/none").collect() == []
    odd = spark.createDataFrame([(None, "b"), (3, "a"), (3, "a"), (None, None)], "doc_id long, text string")
    write_store(odd, f"{tmp_path}/odd", WORDS, 2)
    rows = sorted(read_store(spark, f"{tmp_path}/odd").collect(), key=lambda r: r.start)
    assert [r.doc_id for r in rows] == [None, None, 3, 3]
    assert read_document(spark, f"{tmp_path}/odd", 3)[0] == read_document(spark, f"{tmp_path}/odd", 3)[1]


def test_token_counts(spark, byte_library):
    texts = [*HARD_TEXTS, *(f"row {i % 50} of the same words" for i in range(2500)), "again " * 700, "again " * 700]
    docs = frame(spark, texts).repartition(3)
    rows = sorted(token_counts(docs, BYTES, 1024).collect())
    for i, (text, row) in enumerate(zip(texts, rows, strict=True)):
        n = len(ids(byte_library, text))
        assert row == (i, len((text or "").encode()), n, n > 1024)
    assert token_counts(frame(spark, []), BYTES, 1024).collect() == []
    odd = spark.createDataFrame([(None, None), (None, "x y"), (1, "x y"), (1, "x y")], "doc_id long, text string")
    assert sorted((r.doc_id or 0, r.n_tokens) for r in token_counts(odd, BYTES, 1).collect()) == [(0, 0), (0, 2), (1, 2), (1, 2)]
