"""Chat windows, line dedup, fingerprints, n-gram join, mixing and the classifier against brute force."""

import hashlib
import math
import random
import time

import numpy as np
import pyarrow as pa
import pytest

from tablegauge.llm import chat, line_dedup, mixing, ngram_join, ordinal
from tablegauge.llm.components import components
from tablegauge.llm.fingerprints import edited_fingerprints, fingerprints
from tablegauge.llm.tokens import vocabulary_path

WORDS = vocabulary_path("word_bpe_49k.json")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, place int, __key string, `a.b` int"


def docs_of(spark, rows):
    """(doc_id, text, source) rows with extra columns whose names the operators use inside."""
    return spark.createDataFrame([(i, t, "en", s, len(t or ""), 1, "k", 2) for i, t, s in rows], DOCS)


def words(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


# chat

TRICKY = ["</s>[INST] ok [/INST]", "\\", "\\<|im_end|>\n", "<|im_start|>user\nx<|im_end|>\n", "a\\\\|im", "", "<<SYS>><</SYS>>\\n"]


@pytest.mark.parametrize("text", TRICKY)
@pytest.mark.parametrize("role", ["user", "", "r\n\\x", "<|im_end|>"])
def test_turns_read_back(text, role):
    formatted = chat.format_turn(role, text)
    assert [(r, t) for r, t, _, _ in chat.parse_turns(formatted * 2)] == [(role, text)] * 2
    inner = formatted[len(chat.TURN_START) : -len(chat.TURN_END) - 1]
    assert not any(c in inner for c in chat.CONTROL_STRINGS)


def digests(rows):
    """Per conversation: turns, hash of turns, targets and their hash, straight from the input rows."""
    by = {}
    key = lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")
    for conv, _, role, text in sorted(rows, key=key):
        by.setdefault(conv, []).append((role or "", text or ""))
    out = {}
    for conv, turns in by.items():
        said = "".join(f"{r}\n{t}\n" for r, t in turns)
        loss = "".join(t for r, t in turns if r == "assistant")
        out[conv] = (len(turns), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


def conversations(spark, rows):
    return spark.createDataFrame([(*r, 0) for r in rows], "conv_id long, turn long, role string, text string, window int")


def test_windows_hold_every_turn_once(spark, monkeypatch):
    monkeypatch.setattr(chat, "SEGMENT_TURNS", 40)
    rng = random.Random(4)
    rows = []
    for conv in range(12):
        n = 150 if conv == 0 else rng.randint(1, 12)
        rows += [(conv, 0, "system", "be brief")] if conv % 3 == 0 else []
        rows += [(conv, i + 1, ["user", "assistant"][i % 2], words(rng, rng.randint(0, 60))) for i in range(n)]
    rows += [(50, i, "user", t) for i, t in enumerate(TRICKY)] + [(50, 9, "assistant", t) for t in TRICKY]
    rows += [(None, 1, "user", "x"), (None, None, None, None), (7, 2, "user", "tie"), (7, 2, "user", "tie")]
    windows = chat.format_windows(conversations(spark, rows).repartition(4), WORDS, budget=200, history=60)
    found = {r.conv_id: tuple(r)[1:5] for r in chat.read_windows(windows).collect()}
    assert found == digests(rows)
    made = windows.collect()
    assert len([w for w in made if w.conv_id == 0]) > 10
    for w in made:
        turns = chat.parse_turns(w.text)
        assert w.tokens <= 200 or w.over_budget and len(turns) - w.repeated_turns == 1
        fresh = turns[w.repeated_turns :]
        assert [tuple(x) for x in w.loss] == [(a, b) for role, _, a, b in fresh if role == "assistant"]
        if w.conv_id == 0:
            assert turns[0][:2] == ("system", "be brief")
            if w.window:
                before = next(x for x in made if (x.conv_id, x.segment, x.window) == (0, w.segment, w.window - 1))
                last = [t[:2] for t in chat.parse_turns(before.text)]
                repeated = [t[:2] for t in turns[1 : w.repeated_turns]]
                assert not repeated or last[-len(repeated) :] == repeated


def test_every_window_has_the_system_turn(spark, monkeypatch):
    """A system turn of over half of the budget stays, in later segments too; with a long turn the window is over budget."""
    monkeypatch.setattr(chat, "SEGMENT_TURNS", 20)
    rng = random.Random(11)
    system = words(rng, 60)
    rows = [(1, 0, "system", system)] + [(1, i, ["user", "assistant"][i % 2], words(rng, 8)) for i in range(1, 50)]
    rows.append((1, 50, "user", words(rng, 50)))
    made = chat.format_windows(conversations(spark, rows), WORDS, budget=400, history=60).collect()
    size = next(w.tokens for w in chat.format_windows(conversations(spark, rows[:1]), WORDS).collect())
    assert 200 < size < 300 and len(made) > 5
    for w in made:
        turns = chat.parse_turns(w.text)
        assert turns[0][:2] == ("system", system)
        assert w.over_budget == (w.tokens > 400) == (len(turns) == 2 and turns[1][0] == "user" and len(turns[1][1].split()) == 50)
    found = {r.conv_id: tuple(r)[1:5] for r in chat.read_windows(chat.format_windows(conversations(spark, rows), WORDS, budget=400, history=60)).collect()}
    assert found == digests(rows)


def test_windows_go_by_position_of_turns(spark):
    """Turn numbers far apart, and a null, give the windows of consecutive ones."""
    rng = random.Random(12)
    rows = [(1, i, ["system", "assistant", "user"][i and 1 + i % 2], words(rng, 20)) for i in range(60)]
    made = {}
    for step in (1, 10_000):
        sparse = [(c, i * step if i else None, role, text) for c, i, role, text in rows]
        windows = chat.format_windows(conversations(spark, sparse), WORDS, budget=300, history=100)
        made[step] = sorted((w.segment, w.window, w.text, w.repeated_turns) for w in windows.collect())
    assert made[1] == made[10_000] and len(made[1]) > 3


@pytest.mark.parametrize("system", [True, False])
def test_history_and_system_turn_reach_over_segments(spark, monkeypatch, system):
    monkeypatch.setattr(chat, "SEGMENT_TURNS", 45)
    rng = random.Random(13)
    rows = [(c, i * 7, "system" if system and not i else ["user", "assistant"][i % 2], words(rng, rng.randint(1, 4))) for c in (1, None) for i in range(200)]
    rows += [(3, i, "user", "the same") for i in range(2)] * 60  # repeated rows, exactly one turn over two segments at 45
    rows += [(4, i, "user", "one segment") for i in range(45)]
    windows = chat.format_windows(conversations(spark, rows).repartition(5), WORDS, budget=150, history=40)
    assert {r.conv_id: tuple(r)[1:5] for r in chat.read_windows(windows).collect()} == digests(rows)
    made = sorted(windows.collect(), key=lambda w: (w.conv_id or 0, w.segment, w.window))
    assert {c: max(w.segment for w in made if w.conv_id == c) for c in (1, None, 3, 4)} == {1: 4, None: 4, 3: 2, 4: 0}
    for before, w in zip(made, made[1:], strict=False):
        if before.conv_id != w.conv_id:
            continue
        turns, earlier = ([t[:2] for t in chat.parse_turns(x.text)] for x in (w, before))
        repeated = turns[: w.repeated_turns]
        if w.conv_id in (1, None) and system:
            assert repeated[0] == ("system", rows[0 if w.conv_id else 200][3])
            repeated = repeated[1:]
        assert repeated and earlier[-len(repeated) :] == repeated


def test_windows_of_nothing(spark):
    assert chat.read_windows(chat.format_windows(conversations(spark, []), WORDS)).collect() == []


# line dedup


def brute_lines(rows, min_sites):
    sites, first = {}, {}
    for i, text, site in rows:
        for at, line in enumerate((text or "").split("\n")):
            if line.strip(" \t\n\x0b\f\r"):
                sites.setdefault(line, set()).add(site)
                first.setdefault(line, []).append((i is not None, i or 0, at))
    out = []
    for i, text, _ in rows:
        if text is None:
            out.append((i, None))
            continue
        kept = [
            line
            for at, line in enumerate(text.split("\n"))
            if len(sites.get(line, ())) < min_sites or min(first[line]) == (i is not None, i or 0, at)
        ]
        out.append((i, "\n".join(kept)))
    return out


@pytest.mark.parametrize("broadcast", [500_000, 0])
def test_lines(spark, monkeypatch, broadcast):
    monkeypatch.setattr(line_dedup, "BROADCAST_LINES", broadcast)
    rng = random.Random(1)
    lines = [f"line {i}" for i in range(40)] + ["", "  ", "\t"]
    rows = []
    for i in range(400):
        text = "\n".join(rng.choice(lines) if rng.random() < 0.3 else words(rng, 6) for _ in range(rng.randint(0, 8)))
        rows.append((i, text, f"site{rng.randrange(3 if i % 2 else 40)}"))
    rows += [(900, None, "s"), (901, "", None), (902, "line 1\nline 1", None), (903, "line 2\n" * 5000, "s")]
    found = line_dedup.remove_boilerplate(docs_of(spark, rows).repartition(3), min_sites=5)
    assert set(found.columns) == {*docs_of(spark, []).columns, "lines_removed"}
    got = {r.doc_id: (r.text, r.lines_removed) for r in found.collect()}
    assert {i: t for i, (t, _) in got.items()} == dict(brute_lines(rows, 5))
    assert sum(n for _, n in got.values()) > 100


def test_texts_of_many_removed_lines(spark):
    """Six texts of 64,000 shared lines: removing them takes time in proportion to the lines."""
    text = "\n".join(f"line {i}" for i in range(64_000))
    rows = [(i, text + f"\nown {i}", f"s{i}") for i in range(6)]
    started = time.monotonic()
    got = {r.doc_id: (r.text, r.lines_removed) for r in line_dedup.remove_boilerplate(docs_of(spark, rows)).collect()}
    assert time.monotonic() - started < 60
    assert got == {i: (t if i == 0 else f"own {i}", 64_000 * (i > 0)) for i, t, _ in rows}


def test_whole_texts_are_neither_sorted_nor_split_for_the_join(spark):
    """Texts pass by the small table of removed places; only those that lose a line are split, after the join."""
    rows = [(i, f"own {i}\nshared\n\n", f"s{i}") for i in range(6)] + [(7, "a\n\nb\n", "s"), (8, "shared", "s"), (9, None, "s"), (10, "", "s")]
    found = line_dedup.remove_boilerplate(docs_of(spark, rows), min_sites=5)
    got = {r.doc_id: (r.text, r.lines_removed) for r in found.collect()}
    gone = {i: (f"own {i}\n\n", 1) for i in range(1, 6)} | {8: ("", 1)}
    assert got == gone | {0: (rows[0][1], 0), 7: ("a\n\nb\n", 0), 9: (None, 0), 10: ("", 0)}
    plan = found._jdf.queryExecution().sparkPlan().toString()
    join = plan.index("Join")
    assert "SortMergeJoin" not in plan and "ShuffledHashJoin" in plan
    texts = plan[join:].split("ObjectHashAggregate")[0]  # the documents' side of the join
    assert "split(" not in texts


def test_lines_of_repeated_rows(spark):
    rows = [(1, "a\nb", f"s{i}") for i in range(6)] + [(None, "a", "z"), (2, "a\nc", "y")]
    got = sorted((r.doc_id or -1, r.text) for r in line_dedup.remove_boilerplate(docs_of(spark, rows), min_sites=5).collect())
    assert got == [(-1, "a")] + [(1, "b")] * 6 + [(2, "c")]  # the null id comes first
    assert line_dedup.remove_boilerplate(docs_of(spark, [])).collect() == []


# fingerprints


def test_fingerprints_of_edited_texts(spark, monkeypatch):
    from tablegauge.llm import fingerprints as module

    monkeypatch.setattr(module, "RANGE_DOCUMENTS", 20)
    rng = random.Random(5)
    texts = [words(rng, rng.randint(1, 80), 150) for _ in range(90)] + ["", None, "é" * 7, "x " * 9000]
    texts[11] = texts[10]
    texts[12] = texts[10] + " extra"
    rows = [(3 * i, t, "s") for i, t in enumerate(texts)]
    out = {r.doc_id: r for r in edited_fingerprints(docs_of(spark, rows).repartition(4), (10, 500)).collect()}
    assert len(out) == len(rows)
    for at, (i, text, _) in enumerate(rows):
        text, following = text or "", rows[(at + 1) % len(rows)][1] or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + following[:half]
        assert (out[i].n_chars, out[i].edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        if edited == text:
            assert out[i].near_edited == 1.0
    assert out[30].fingerprint == out[33].fingerprint and out[30].near_next == 1.0
    assert 0 < out[33].near_next and out[6].near_next < 0.5
    plain = {r.text: "".join(r.fingerprint) for r in fingerprints(docs_of(spark, rows), (10, 500)).collect()}
    assert all(out[i].fingerprint == plain[t or ""] for i, t, _ in rows)


def test_fingerprint_edges(spark):
    assert edited_fingerprints(docs_of(spark, [])).collect() == []
    one = edited_fingerprints(docs_of(spark, [(4, "abcd", "s")])).first()
    assert (one.near_next, one.edited_sha256) == (1.0, hashlib.sha256(b"abab").hexdigest())
    odd = [(None, "x y", "s"), (None, None, "s"), (1, "x y", "s"), (1, "x y", "s")]
    assert sorted(r.n_chars for r in edited_fingerprints(docs_of(spark, odd)).collect()) == [0, 3, 3, 3]


# n-gram join


def gram_set(text):
    parts = (text or "").lower().split()
    return frozenset(tuple(parts[i : i + 5]) for i in range(max(1, len(parts) - 4))) if parts else frozenset()


def brute_join(rows):
    sets = {}
    for i, t, _ in rows:
        sets.setdefault(gram_set(t), []).append(i)
    nodes = list(sets)
    links = {s: {o for o in nodes if o != s and s and 5 * len(s & o) >= 4 * len(s | o)} for s in nodes}
    out = {}
    for s in nodes:
        seen, todo = {s}, [s]
        while todo:
            more = links[todo.pop()] - seen
            seen |= more
            todo += more
        least = min(i for o in seen for i in sets[o])
        for i in sets[s]:
            out[i] = (least, min(sets[s]), len(links[s]))
    return out


def near_copies(rng, base, count, edits):
    out = []
    for _ in range(count):
        parts = base.split()
        for _ in range(rng.randint(0, edits)):
            parts[rng.randrange(len(parts))] = f"e{rng.randrange(10**6)}"
        out.append(" ".join(parts))
    return out


@pytest.mark.parametrize("block", [256, 12])
def test_join_finds_every_link(spark, monkeypatch, block):
    monkeypatch.setattr(ngram_join, "BLOCK_CLASSES", block)
    rng = random.Random(7)
    texts = [words(rng, rng.randint(0, 60)) for _ in range(150)]
    for edits in (1, 2, 4, 6):
        texts += near_copies(rng, words(rng, 120, 5000), 40, edits)
    texts += [texts[3], texts[3].upper(), texts[160], None, "", " \n ", "one two", "One  two", "one two three four five", words(rng, 5000)]
    order = list(range(len(texts)))
    rng.shuffle(order)
    rows = [(i, t, "s") for i, t in zip(order, texts, strict=True)]
    found = ngram_join.ngram_join(docs_of(spark, rows).repartition(4)).collect()
    assert {r.doc_id: (r.class_id, r.copy_id, r.links) for r in found} == brute_join(rows)
    kept = sorted(r.doc_id for r in ngram_join.drop_near_duplicates(docs_of(spark, rows)).collect())
    assert kept == sorted({c for c, _, _ in brute_join(rows).values()})


def test_join_edges(spark):
    assert ngram_join.ngram_join(docs_of(spark, [])).collect() == []
    assert ngram_join.drop_near_duplicates(docs_of(spark, [])).collect() == []
    odd = [(None, "a b c d e f", "s"), (None, "a b c d e f", "s"), (None, "other words here now", "s"), (5, "x", "s"), (5, "x", "t")]
    assert sorted((r.doc_id or -1, r.text) for r in ngram_join.drop_near_duplicates(docs_of(spark, odd)).collect()) == [
        (-1, "a b c d e f"), (-1, "other words here now"), (5, "x"),
    ]


def test_band_choice_reaches_the_recall():
    bands, rows = ngram_join.choose_bands()
    assert 1 - (1 - 0.8**rows) ** bands >= ngram_join.RECALL


@pytest.mark.parametrize("share", [1000, 5, 0])
def test_components(spark, monkeypatch, share):
    monkeypatch.setattr("tablegauge.llm.components.HOT_SHARE", share)
    chain = [(i, i + 1) for i in range(0, 60)] + [(100, 200), (200, 300), (300, 100), (7, 7)]
    star = [(500, 500 + i) for i in range(1, 300)]
    got = {r.node: r.root for r in components(spark.createDataFrame(chain + star, "x long, y long")).collect()}
    assert got == {**{i: 0 for i in range(1, 61)}, 200: 100, 300: 100, **{500 + i: 500 for i in range(1, 300)}}
    assert components(spark.createDataFrame([], "x long, y long")).collect() == []


# mixing


@pytest.mark.parametrize("weights", [{"a": 1}, {"a": 3, "b": 2, "c": 1}, {"a": 97, "b": 2, "c": 1, "d": 50}, {str(i): 5 for i in range(7)}])
def test_a_period_is_fair(weights):
    total, slots = sum(weights.values()), mixing.period_slots(weights)
    assert sorted(s for x in slots.values() for s in x) == list(range(total))
    for name, w in weights.items():
        for t in range(total + 1):
            assert abs(sum(s < t for s in slots[name]) - w * t / total) < 1


def test_mixture(spark):
    rng = random.Random(2)
    rows = [(i, words(rng, 3), "big" if i % 3 else rng.choice(["x", "y", None])) for i in range(3000)]
    docs = docs_of(spark, rows).repartition(5)
    targets = {"big": 0.5, "x": 0.3, None: 0.1}
    got = mixing.mix(docs, targets, block_rows=8).collect()
    assert sorted(r.doc_id for r in got) == list(range(3000))
    assert len({(r.mix_slot, r.mix_place) for r in got}) == 3000
    by_slot = {}
    for r in got:
        by_slot.setdefault(r.mix_slot, set()).add(r.source if r.source in ("big", "x", None) else "others")
    assert all(len(s) == 1 for s in by_slot.values()) and set(by_slot) == set(range(len(by_slot)))
    first = max(r.mix_slot for r in got if r.mix_phase == 0) + 1
    shares = {"big": 0.5, "x": 0.3, None: 0.1, "others": 0.3}
    for name, share in shares.items():
        seen = 0
        for t in range(first):
            seen += by_slot[t] == {name}
            assert abs(seen - share / 1.2 * (t + 1)) < 1.2  # weights are rounded to the period
    again = mixing.mix(docs.repartition(2), targets, block_rows=8).collect()
    assert {(r.doc_id, r.mix_slot, r.mix_place) for r in got} == {(r.doc_id, r.mix_slot, r.mix_place) for r in again}


def test_mixture_edges(spark):
    assert mixing.mix(docs_of(spark, [])).collect() == []
    odd = [(None, None, None), (1, "a", None), (1, "a", "s"), (1, "a", "s"), (2, "", "null")]
    got = mixing.mix(docs_of(spark, odd).withColumnRenamed("place", "mix_slot")).collect()
    assert len(got) == 5 and len({(r.mix_slot, r.mix_place) for r in got}) == 5


@pytest.mark.parametrize("ends", [False, True])
def test_schedule_keeps_to_the_true_targets(ends):
    """Roots of sizes as weights, one of them far below 1/4000; over 30,000 slots no source is a block away from its flow."""
    shares = [math.sqrt(2), math.sqrt(3), 1 / 3, 1e-4, 5.7]
    weights = [round(x / sum(shares) * mixing.WEIGHT_SUM) for x in shares]
    blocks = [300, 9000, 40, 2, 20_000] if ends else [max(1, math.ceil(30_000 * x / sum(shares))) for x in shares]
    dealt = list(mixing.schedule(blocks, weights))
    assert sorted((j, i) for j, i, _, _ in dealt) == [(j, i) for j, n in enumerate(blocks) for i in range(n)]
    assert [slot for *_, slot in dealt] == list(range(sum(blocks)))
    flown, seen = [0.0] * len(blocks), [0] * len(blocks)
    for j, i, _, _ in dealt:
        assert i == seen[j]
        seen[j] += 1
        left = 1.0
        while left > 1e-12:
            active = [k for k, n in enumerate(blocks) if flown[k] < n - 1e-9]
            if not active:
                break
            total = sum(shares[k] for k in active)
            step = min(left, *((blocks[k] - flown[k]) * total / shares[k] for k in active))
            for k in active:
                flown[k] += step * shares[k] / total
            left -= step
        assert all(abs(a - b) < 1 + 1e-6 for a, b in zip(flown, seen, strict=True))


def test_mixture_of_many_sources(spark):
    """More sources than 500, of which the small ones hold most rows: each has its own even places."""
    rows = [(i, f"t{i}", f"s{i % 700}" if i % 5 else "big") for i in range(7000)]
    got = mixing.mix(docs_of(spark, rows), block_rows=1).collect()
    assert sorted(r.mix_slot for r in got) == list(range(7000))
    assert len({r.mix_phase for r in got}) > 500
    sizes, slots = {}, {}
    for r in got:
        slots.setdefault(r.source, []).append(r.mix_slot)
    sizes = {s: len(x) for s, x in slots.items()}
    total = sum(math.sqrt(n) for n in sizes.values())
    first = max(r.mix_slot for r in got if r.mix_phase == 0) + 1
    for name, n in sizes.items():
        share = math.sqrt(n) / total
        assert all(abs(sum(x < t for x in slots[name]) - share * t) <= 1 for t in range(0, first, 50))


# classifier


def test_gradient_finds_ordered_grades():
    rng = random.Random(3)
    texts, grades = [], []
    for _ in range(3000):
        grade = rng.choice([0, 1, 2, 2])
        texts.append(words(rng, 40) + {0: " nasty vile", 1: " " + "!!! " * 12, 2: ""}[grade])
        grades.append(grade)
    rows = [ordinal.features(t) for t in texts]
    model = ordinal.fit(rows[:2400], np.array(grades[:2400]), 3)
    tails = model.tails(np.array([model.score(t) for t in texts[2400:]]))
    held = np.array(grades[2400:])
    assert (np.diff(model.thresholds) >= 0).all() and (tails[:, 0] >= tails[:, 1]).all()
    assert ((tails[:, 1] >= 0.5) == (held == 2)).mean() > 0.97
    assert abs(tails.sum(axis=1) - held).mean() < 0.3


def test_training_and_selection(spark):
    rng = random.Random(6)
    rows = [(i, words(rng, 30) + (" vile" if i % 4 == 0 else ""), "s") for i in range(2400)] + [(2400, None, "s"), (2401, "", "s"), (None, "x", None)]
    docs = docs_of(spark, rows)
    labels = [(i, 1, int(i % 4 == 0)) for i in range(2000)] + [(None, 0, 0), (299, None, None), (5000, 0, 0)]
    labels = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = ordinal.train(ordinal.graded_labels(docs, labels), 3)
    kept = {r.doc_id for r in ordinal.select_documents(docs, model, 0.5).collect()}
    held = range(2000, 2400)
    assert sum(i in kept for i in held if i % 4 == 0) <= 5
    assert sum(i in kept for i in held if i % 4) >= 285
    graded = ordinal.grade_documents(docs.withColumnRenamed("place", "top_chance"), model)
    assert graded.count() == len(rows) and graded.columns.count("top_chance") == 1
    untrained = ordinal.train(ordinal.graded_labels(docs, labels.limit(0)), 3)
    assert not math.isnan(untrained.score("any"))
    assert ordinal.grade_documents(docs_of(spark, []), model).collect() == []


def test_features_are_of_the_whole_text():
    index, value = ordinal.features("word " * 10_000 + "last")
    assert len(index) == len(value) and len(pa.array(index)) == len(set(index.tolist()))
    assert ordinal.features(None)[0].tolist() == ordinal.features("")[0].tolist()


def test_training_reads_all_words_of_a_text(spark, monkeypatch):
    """What makes a long text toxic comes after thousands of clean words; blocks are much smaller than the sample."""
    monkeypatch.setattr(ordinal, "BLOCK_FEATURES", 20_000)
    rng = random.Random(9)
    vocabulary = [f"w{i}" for i in range(6000)]
    long = lambda toxic: " ".join(rng.sample(vocabulary, 2600)) + (" vile nasty" if toxic else "")
    rows = [(i, long(i % 4 == 0), "s") for i in range(400)]
    labels = spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(300)], "doc_id long, quality int, toxic int")
    model = ordinal.train(ordinal.graded_labels(docs_of(spark, rows), labels), 3)
    chance = lambda text: float(model.tails(np.array([model.score(text)]))[0, 1])
    assert all((chance(t) >= 0.5) == (i % 4 > 0) for i, t, _ in rows[300:])
    index = ordinal.features("vile nasty")[0][:2]
    assert (model.weights[index] < 3 * model.weights[: ordinal.WORD_FEATURES].min() / 4).all()


def test_fit_does_not_depend_on_blocks(monkeypatch):
    rng = random.Random(10)
    grades = [rng.randrange(3) for _ in range(300)]
    rows = [ordinal.features(words(rng, 30) + " vile" * (g == 0) + " !!" * (g == 1)) for g in grades]
    whole = ordinal.fit(rows, grades, 3)
    monkeypatch.setattr(ordinal, "BLOCK_FEATURES", 500)
    parts = ordinal.fit(rows, grades, 3)
    assert np.allclose(whole.weights, parts.weights, atol=1e-4) and np.allclose(whole.thresholds, parts.thresholds)
