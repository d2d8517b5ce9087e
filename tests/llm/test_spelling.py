"""Spelling variants against a comparison of all words, and the filters by themselves."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from tablegauge.llm import spelling as sp
from tablegauge.llm.queries import op13_spelling_variants


def near(u, v):
    if u == v or abs(len(u) - len(v)) > 1:
        return False
    if len(u) == len(v):
        return sum(a != b for a, b in zip(u, v, strict=True)) == 1
    short, long = sorted((u, v), key=len)
    return any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def brute(counts, ratio=5):
    out = {}
    for w, n in counts.items():
        others = [v for v in counts if near(w, v)]
        form = min(others, key=lambda v: (-counts[v], v), default=None)
        form = form if form is not None and counts[form] >= ratio * n else None
        out[w] = [form, n, len(others), counts.get(form)]
    for w in out:
        root = w
        while out[root][0] is not None:
            root = out[root][0]
        out[w].append(root)
    return {w: tuple(v) for w, v in out.items()}


def forms(table):
    return {r.word: (r.form, r.n, r.n_near, r.form_n, r.root) for r in table.collect()}


def vocabulary(rng, n, letters="abé"):
    counts = {}
    while len(counts) < n:
        word = "".join(rng.choice(letters) for _ in range(rng.randint(1, 9)))
        counts[word] = rng.choice([1, 5, 5, 24, 25, 120, 125, 700, 4000])
    return counts


@pytest.mark.parametrize("rounds", [1, 4])
def test_all_pairs(spark, monkeypatch, rounds):
    """The same with all blocks at once as with a few at a time, and with edits made in small parts."""
    rng = random.Random(rounds)
    counts = vocabulary(rng, 700) | {"a" * 90: 7, "a" * 91: 40, "a" * 89 + "b": 8, "b" * 300: 1, "b" * 301: 5, "": 3, "😀": 5, "😀a": 30, "z": 2}
    if rounds > 1:
        monkeypatch.setattr(sp, "BITS_PER_WORD", 64)
        blocks = sum(-(-n * 64 // 512) for n in Counter(min(len(w), 64) for w in counts).values())
        monkeypatch.setattr(sp, "ROUND_BLOCKS", -(-blocks // rounds))
        monkeypatch.setattr(sp, "EDITS_AT_ONCE", 1000)
    table = spark.createDataFrame([(w, n, 1) for w, n in counts.items()] + [(None, 9, 1)], "word string, n long, root int")
    assert forms(sp.spelling_forms(table.repartition(3))) == brute(counts)


def test_long_chains_and_ties(spark):
    chain = {"a" * i: 5**i for i in range(1, 20)}
    ties = {"tests": 1, "zests": 5, "rests": 5, "éests": 5}
    table = spark.createDataFrame(list((chain | ties).items()), "word string, n long")
    got = forms(sp.spelling_forms(table))
    assert got == brute(chain | ties)
    assert got["a"][4] == "a" * 19 and got["tests"][0] == "rests"


def test_filter_holds_what_was_set():
    """Edits of a word are hashed as the edited words are; a filter never loses a word and passes few others."""
    rng = random.Random(4)
    words = ["".join(rng.choice("abcd") for _ in range(7)) for _ in range(50)]
    points = sp.code_points(words, 7)
    alphabet = np.array([ord(c) for c in "abcd"], dtype=np.uint64)
    parts = list(sp.edit_hashes(points, alphabet))
    hashed = lambda ws: set(zip(*(h.tolist() for h in sp.word_hashes(sp.code_points(ws, len(ws[0])))), strict=True))
    shorter = [w[:i] + w[i + 1 :] for w in words for i in range(7)]
    replaced = [w[:i] + c + w[i + 1 :] for w in words for i in range(7) for c in "abcd" if c > w[i]]
    assert set(zip(parts[0][2].tolist(), parts[0][3].tolist(), strict=True)) == hashed(shorter)
    assert len(parts[0][1]) == sum(len({w[:i] + w[i + 1 :] for i in range(7)}) for w in words)
    assert {x for p in parts[1:] for x in zip(p[2].tolist(), p[3].tolist(), strict=True)} == hashed(replaced)


def expected(rows):
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-z\u00c0-\u00ff]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{doc_id}:{run}".encode())
            if doc_id is not None and h % 199 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            counts[run] += 1
    return brute({w: n for w, n in counts.items() if len(w) >= 6 and n >= 5})


def test_query(spark, tmp_path):
    rng = random.Random(6)
    words = ["Spelling"] * 9 + ["writings"] * 40 + ["variante", "ÉCOLES", "écoles", "speling", "Spellings", "spellin", "writing", "writtings", "ÉcOLES", "straße", "strasse", "ÿÿÿÿÿÿ", "a_b", "short"]
    rows = [(i, rng.choice([" ", "-", "1", "\u00d7"]).join(rng.choice(words) for _ in range(rng.randrange(80)))) for i in range(400)]
    rows += [(5, rows[5][1]), (None, "spelling " * 9), (3, None), (4, ""), (900, "x" * 300_000 + " writing")]
    table = spark.createDataFrame([(*r, 2) for r in rows], "doc_id long, text string, word int")
    table.repartition(6).write.parquet(f"{tmp_path}/documents.parquet")
    got = forms(op13_spelling_variants(spark, str(tmp_path)))
    assert got == expected(rows)
    assert sum(v[0] is not None for v in got.values()) >= 5


def test_empty_tables(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert op13_spelling_variants(spark, str(tmp_path)).collect() == []
    one = spark.createDataFrame([("alone", 3)], "word string, n long")
    assert forms(sp.spelling_forms(one)) == {"alone": (None, 3, 0, None, "alone")}
    with pytest.raises(ValueError, match="frequent"):
        sp.spelling_forms(one, ratio=1)
