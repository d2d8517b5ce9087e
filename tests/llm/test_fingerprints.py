"""Neighbours of repeated ids, and how well the fingerprints tell an edited text from the next one."""

import hashlib
import os

import pytest

from tablegauge.llm import fingerprints as fp
from tablegauge.llm.queries import op6_imatch_fingerprints

SF_DIR = "/root/testdata/sf0.01"


@pytest.mark.parametrize("repeated", [0, 40, 99])
def test_neighbours_of_repeated_ids(spark, monkeypatch, repeated):
    """So many rows of the smallest, largest or a middle id that it is a range bound itself."""
    monkeypatch.setattr(fp, "RANGE_DOCUMENTS", 20)
    rows = [(repeated, f"copy {i:03d} of the repeated id") for i in range(90)] + [(i, f"text number {i} alone") for i in range(100) if i != repeated]
    ordered = sorted(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = fp.edited_fingerprints(docs, (1, 1000)).collect()
    expected = []
    for at, (i, text) in enumerate(ordered):
        following = ordered[(at + 1) % len(ordered)][1]
        half = len(text) // 2
        edited = text[: len(text) - half] + following[:half]
        expected.append((i, len(text), hashlib.sha256(edited.encode()).hexdigest()))
    assert sorted((r.doc_id, r.n_chars, r.edited_sha256) for r in got) == sorted(expected)
    assert all(r.near_next is not None and 0 <= r.near_next <= 1 for r in got)


def test_texts_without_terms(spark):
    """Nothing in the lexicon: only equal texts are alike."""
    rows = [(0, ""), (1, "..."), (2, "..."), (3, None), (4, "!")]
    got = {r.doc_id: r for r in fp.edited_fingerprints(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[i].near_next for i in range(5)] == [0.0, 1.0, 0.0, 0.0, 0.0]
    assert got[0].fingerprint == got[3].fingerprint != got[1].fingerprint == got[2].fingerprint


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="driver tables not present")
def test_edited_texts_are_nearer_than_the_next(spark):
    got = {r.doc_id: r for r in op6_imatch_fingerprints(spark, SF_DIR).collect()}
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "text").collect()
    long = [r.doc_id for r in docs if len((r.text or "").split()) >= 50]
    assert sum(got[i].near_edited > got[i].near_next for i in long) >= 0.9 * len(long)
