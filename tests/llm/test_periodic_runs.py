"""Periodic runs against a search by every period, and their query against the same."""

import hashlib
import random
import re
import zlib

import pytest

from tablegauge.llm import periodic_runs as pr
from tablegauge.llm.queries import op11_periodic_runs


def brute_runs(words, least_words=24, least_times=3):
    found, n = [], len(words)
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            length = j + q - i
            if j > i and length >= max(least_words, least_times * q):
                part = words[i : j + q]
                if not any(part[d:] == part[:-d] for d in range(1, q)):
                    found.append((i, length, q))
            i = max(j, i + 1)
    return sorted(found, key=lambda r: (r[0], r[2]))


def looped(rng, words):
    n = len(words)
    a = rng.randrange(n)
    p = 1 + (n - a) // (3 + rng.randrange(8))
    return [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]


@pytest.mark.parametrize("least", [(24, 3), (4, 2), (1, 2), (10, 4), (2, 5)])
def test_runs_of_random_words(least):
    rng = random.Random(least[0])
    for _ in range(500):
        words = [rng.randrange(rng.choice([1, 2, 3, 6])) for _ in range(rng.randrange(60))]
        if words and rng.random() < 0.5:
            words = looped(rng, words)
        assert pr.runs_of(words, *least) == brute_runs(words, *least)
        assert pr.text_runs(" ".join(map(str, words)), *least)[1] == brute_runs(words, *least)


def test_runs_side_by_side_and_nested():
    inner = ["a", "b"] * 14
    words = (inner + ["c"]) * 4 + ["x"] + ["y"] * 30 + ["z"] * 24 + ["t"] * 23
    found = pr.runs_of(words)
    assert found == brute_runs(words)
    assert (0, 116, 29) in found and (117, 30, 1) in found and (147, 24, 1) in found and len(found) == 7


def test_fibonacci_words_hold_many_runs():
    a, b = [0], [0, 1]
    while len(b) < 1500:
        a, b = b, b + a
    assert pr.runs_of(b) == brute_runs(b)


def test_hash_collisions_only_widen(monkeypatch):
    """All words of one hash: the stretches are then the whole text, and the runs stay the same."""

    class Same(bytes):
        def __hash__(self):
            return 1

    rng = random.Random(3)
    words = [Same(b"%d" % rng.randrange(4)) for _ in range(200)] + [Same(b"x"), Same(b"y")] * 15
    assert pr.recurring_stretches(words, 24, 3) == [(0, 230)]
    assert pr.runs_of([bytes(w) for w in words]) == brute_runs([bytes(w) for w in words])


def expected(doc_id, text):
    words = re.findall("[^ \t-\r]+", text or "")
    n = len(words)
    h = zlib.crc32(str(doc_id).encode())
    g = h // 10
    if doc_id is not None and h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = brute_runs(words)
    gone = {i for s, c, p in runs for i in range(s + p, s + c)}
    best = None
    for r in runs:
        if best is None or r[1] * best[2] > best[1] * r[2]:
            best = r
    lines = "".join(f"{s},{c},{p}\n" for s, c, p in runs)
    kept = " ".join(w for i, w in enumerate(words) if i not in gone)
    head = (*best, best[1] * 1000 // best[2]) if best else (None,) * 4
    return (doc_id, len(runs), *head, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest())


def test_query_against_every_period(spark, tmp_path):
    rng = random.Random(5)
    rows = []
    for i in range(300):
        n = rng.choice([0, 1, 5, 40, 120, 300])
        rows.append((i, rng.choice([" ", "\n", "\t \x0b"]).join(f"wörd{rng.randrange(50)}\u00a0\x1c" for _ in range(n))))
    rows += [(7, rows[7][1]), (7, "a " * 100), (None, "b c " * 50), (None, None), (400, None), (401, ""), (402, " \n "), (10**15, "z\u2003z " * 60)]
    table = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, runs int, n_words string")
    table.repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    got = op11_periodic_runs(spark, str(tmp_path)).drop("n_words").collect()
    key = lambda r: tuple((x is None, x or 0) if not isinstance(x, str) else (0, x) for x in r)
    assert sorted(map(tuple, got), key=key) == sorted((expected(*r) for r in rows), key=key)
    assert sum(r.n_runs > 0 for r in got) > 10


def test_operator_keeps_rows_and_columns(spark):
    rows = [(1, "a b " * 20 + "end", 3), (1, "a b " * 20 + "end", 3), (None, None, None), (2, "", 4)]
    docs = spark.createDataFrame(rows, "doc_id long, body string, collapsed int").withColumnRenamed("doc_id", "a.b")
    made = pr.periodic_runs(docs, text="body", least_words=6, least_times=2)
    assert made.columns == ["a.b", "body", "n_words", "runs", "collapsed"]
    got = sorted(map(tuple, made.select("`a.b`", "n_words", "runs", "collapsed").collect()), key=str)
    assert [(r[1], [tuple(x) for x in r[2]], r[3]) for r in got] == [(41, [(0, 40, 2)], "a b end")] * 2 + [(0, [], "")] * 2
    assert pr.periodic_runs(docs.limit(0), text="body").collect() == []
    with pytest.raises(ValueError, match="twice"):
        pr.periodic_runs(docs, text="body", least_times=1)


def test_a_long_text(spark):
    """A text of 200,000 words that is periodic almost from its start."""
    rng = random.Random(8)
    base = [f"w{rng.randrange(3000)}" for _ in range(5000)]
    text = " ".join(["head"] + [base[i % 5000] for i in range(200_000)])
    n, runs, collapsed = pr.text_runs(text)
    assert (n, runs) == (200_001, [(1, 200_000, 5000)])
    assert collapsed == " ".join(["head", *base])
