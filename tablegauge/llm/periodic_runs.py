"""Periodic runs of words in a text, from a suffix automaton whose last occurrences are kept by link-cut access.

Words are appended one by one to a suffix automaton. In its tree of suffix links, the path from the
new state to the root holds all suffixes of the words read so far; a link-cut forest keeps the tree as
paths of one colour, the place where the strings of the path ended last. Access of the new state cuts
its path into segments by colour and recolours them. A segment of colour `e` whose longest suffix has
`l` words says that this suffix, and no longer one, ended at `e` before. If the distance `p` from `e` to
the new end is at most `l`, the last l + p words have the smallest period p at least twice: a square.
Every run shows in this way where its first square ends. It begins l + p words before, as no longer
suffix recurs at that distance, and goes on to the right as long as the period holds.
"""

from __future__ import annotations

from array import array
from collections.abc import Hashable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Shortest run in words, and how often it must hold its period.
LEAST_WORDS = 24
LEAST_TIMES = 3

WHITE_SPACE = r"[\x20\x09-\x0D]+"
RUNS_TYPE = "struct<n_words: long, runs: array<struct<start: long, length: long, period: long>>, collapsed: string>"


def squares(words: Sequence[Hashable]) -> Iterator[tuple[int, int, int]]:
    """(`end`, `earlier`, `common`) of each segment met: the longest common suffix, of `common` words, of
    the words up to `end` and up to `earlier`, where end - earlier <= common.

    State 1 is the automaton's root; 0 is no state. `up`, `left` and `right` are the splay trees of the
    paths, ordered by depth; the topmost state of a tree points up to the state its path hangs from. The
    colour of a path stands at the top of its tree.
    """
    most = 2 * len(words) + 2
    length, link, up, left, right = (array("i", bytes(4 * most)) for _ in range(5))
    colour = array("i", [-1]) * most
    step: list[dict] = [{}, {}]
    last, made = 1, 2

    def splay(x: int) -> None:
        """Bring `x` to the top of the tree of its path."""
        while True:
            y = up[x]
            if y == 0:
                return
            on_left = left[y] == x
            if not on_left and right[y] != x:
                return
            z = up[y]
            y_left = left[z] == y if z else False
            y_right = right[z] == y if z and not y_left else False
            if not y_left and not y_right:  # y is the top
                colour[x] = colour[y]
                if on_left:
                    b = right[x]
                    left[y], right[x] = b, y
                else:
                    b = left[x]
                    right[y], left[x] = b, y
                if b:
                    up[b] = y
                up[y], up[x] = x, z
                return
            above = up[z]
            z_left = left[above] == z if above else False
            z_right = right[above] == z if above and not z_left else False
            if on_left and y_left:
                b, c = right[y], right[x]
                left[z], right[y], left[y], right[x] = b, z, c, y
                if b:
                    up[b] = z
                if c:
                    up[c] = y
                up[z], up[y] = y, x
            elif not on_left and y_right:
                b, c = left[y], left[x]
                right[z], left[y], right[y], left[x] = b, z, c, y
                if b:
                    up[b] = z
                if c:
                    up[c] = y
                up[z], up[y] = y, x
            else:
                b, c = left[x], right[x]
                if y_left:  # x is between y (above) and z (below)
                    right[y], left[z], left[x], right[x] = b, c, y, z
                    if b:
                        up[b] = y
                    if c:
                        up[c] = z
                else:
                    right[z], left[y], left[x], right[x] = b, c, z, y
                    if b:
                        up[b] = z
                    if c:
                        up[c] = y
                up[y] = up[z] = x
            up[x] = above
            if z_left:
                left[above] = x
            elif z_right:
                right[above] = x
            else:
                colour[x] = colour[z]
                return

    for end, word in enumerate(words):
        new = made
        made += 1
        step.append({})
        length[new] = end + 1
        p = last
        while p and word not in step[p]:
            step[p][word] = new
            p = link[p]
        if not p:
            link[new] = 1
        else:
            q = step[p][word]
            if length[q] != length[p] + 1:
                clone = made
                made += 1
                step.append(step[q].copy())
                length[clone] = length[p] + 1
                while p and step[p].get(word) == q:
                    step[p][word] = clone
                    p = link[p]
                # the clone lies on the path of q, right above it
                splay(q)
                above = left[q]
                left[clone] = above
                if above:
                    up[above] = clone
                left[q], up[clone] = clone, q
                link[clone], link[q] = link[q], clone
                q = clone
            link[new] = q
        up[new] = link[new]
        last = new
        # access: the path from the new state to the root gets the colour `end`
        x, below = new, 0
        while x:
            splay(x)
            earlier, cut = colour[x], right[x]
            if cut:
                colour[cut] = earlier
            if earlier >= 0 and end - earlier <= length[x]:
                yield end, earlier, length[x]
            right[x] = below
            below, x = x, up[x]
        colour[below] = end


def runs_of(words: Sequence[Hashable], least_words: int = LEAST_WORDS, least_times: int = LEAST_TIMES) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of `least_words` words and `least_times` periods, by start, then period."""
    found, reached, n = [], {}, len(words)
    for end, earlier, common in squares(words):
        period = end - earlier
        if reached.get(period, -1) >= end:
            continue
        start, stop = end - common - period + 1, end + 1
        while stop < n and words[stop] == words[stop - period]:
            stop += 1
        reached[period] = stop - 1
        if stop - start >= max(least_words, least_times * period):
            found.append((start, stop - start, period))
    return sorted(found, key=lambda r: (r[0], r[2]))


def recurring_stretches(words: Sequence[Hashable], least_words: int, least_times: int) -> list[tuple[int, int]]:
    """Stretches (from, to) of the words, of `least_words` words or more, in which all runs lie whole.

    In a run of l words and period q, each of its l - k + 1 grams of k words recurs q words on or back if
    l - k + 1 >= 2 q. Take k so that this holds for the shortest run of each period: then runs lie in the
    stretches of consecutive grams that occur twice in the text. Grams are told apart by a hash; grams
    that share one can only make a stretch longer.
    """
    n, turn = len(words), max(1, least_words // least_times)
    k = max(1, min(max(least_words, least_times * q) - 2 * q + 1 for q in (turn, turn + 1)))
    if n < max(least_words, k):
        return []
    hashes = np.fromiter(map(hash, words), dtype=np.int64, count=n).view(np.uint64)
    grams = np.zeros(n - k + 1, dtype=np.uint64)
    for j in range(k):
        grams = grams * np.uint64(0x9E3779B97F4A7C15) + hashes[j : n - k + 1 + j]
    order = np.sort(grams)
    twice = order[1:][order[1:] == order[:-1]]
    if not len(twice):
        return []
    edges = np.flatnonzero(np.diff(np.concatenate(([False], np.isin(grams, twice), [False])).astype(np.int8)))
    ends = edges[1::2] + k - 1
    return [(int(a), int(b)) for a, b in zip(edges[::2], ends, strict=True) if b - a >= least_words]


def text_runs(text: str | None, least_words: int = LEAST_WORDS, least_times: int = LEAST_TIMES) -> tuple[int, list[tuple[int, int, int]], str]:
    """Number of words of a text, its runs, and the words joined by spaces, of each run only the first period."""
    words = (text or "").encode().split()  # bytes are split at exactly the six ASCII white spaces
    found = []
    for a, b in recurring_stretches(words, least_words, least_times):
        numbers: dict[bytes, int] = {}
        part = [numbers.setdefault(w, len(numbers)) for w in words[a:b]]
        found += [(a + start, length, period) for start, length, period in runs_of(part, least_words, least_times)]
    found.sort(key=lambda r: (r[0], r[2]))
    if found:
        kept = np.ones(len(words), dtype=bool)
        for start, length, period in found:
            kept[start + period : start + length] = False
        collapsed = [w for w, keep in zip(words, kept.tolist(), strict=True) if keep]
    else:
        collapsed = words
    return len(words), found, b" ".join(collapsed).decode()


def runs_column(text: Column, least_words: int = LEAST_WORDS, least_times: int = LEAST_TIMES) -> Column:
    """`n_words`, `runs` and `collapsed` of a text, as a struct."""
    if least_times < 2:
        raise ValueError("a run holds its period twice at least")

    @F.arrow_udf(RUNS_TYPE)
    def find(texts: pa.Array) -> pa.Array:
        made = (text_runs(t.as_py(), least_words, least_times) for t in texts)
        rows = [{"n_words": n, "runs": [{"start": s, "length": c, "period": p} for s, c, p in runs], "collapsed": kept} for n, runs, kept in made]
        run = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
        return pa.array(rows, pa.struct([("n_words", pa.int64()), ("runs", pa.list_(run)), ("collapsed", pa.string())]))

    return find(text)


def periodic_runs(docs: DataFrame, text: str = "text", least_words: int = LEAST_WORDS, least_times: int = LEAST_TIMES) -> DataFrame:
    """`docs` with all rows and columns plus `n_words`, `runs` (start, length, period) and `collapsed`.

    Words are split at ASCII white space and compared as they are. A run is a stretch of words with a
    smallest period, of `least_words` words and `least_times` periods at least, that neither neighbour
    extends. `collapsed` leaves out each run's words after its first period. A null or empty text has no
    words and no runs, and collapses to an empty text. Rows are independent; columns of these names are replaced.
    """
    names = [F.col(f"`{c}`") for c in docs.columns if c not in ("n_words", "runs", "collapsed")]
    found = docs.select(*names, runs_column(F.col(f"`{text}`"), least_words, least_times).alias("__runs"))
    return found.select(*names, "__runs.n_words", "__runs.runs", "__runs.collapsed")


def looped_text(doc_id: Column, text: Column) -> Column:
    """A text of which one in ten, by the checksum of the id, ends in a repeated stretch of its own words.

    With h = crc32(id) and g = h div 10, words from a = g mod n on repeat those of [a, a + p) where
    p = 1 + (n - a) div (3 + g mod 8). A null id leaves the text as it is.
    """
    checksum = F.crc32(doc_id.cast("long").cast("string"))
    words = F.filter(F.split(text, WHITE_SPACE), lambda w: w != "")
    n = F.size(words)
    g = F.floor(checksum / 10)
    a = (g % F.greatest(n, F.lit(1))).cast("int")
    p = F.lit(1) + F.floor((n - a) / (F.lit(3) + g % 8)).cast("int")
    repeated = F.flatten(F.array_repeat(F.slice(words, a + 1, p), F.ceil((n - a) / p).cast("int")))
    looped = F.array_join(F.slice(F.concat(F.slice(words, F.lit(1), a), repeated), F.lit(1), n), " ")
    return F.when((checksum % 10 == 0) & (n > 0), looped).otherwise(F.coalesce(text, F.lit("")))


def run_digests(docs: DataFrame) -> DataFrame:
    """Per document of `periodic_runs`: number of runs, the one of greatest exponent, digests of all runs and the collapsed text."""
    stronger = lambda best, r: F.when(r["length"] * best["period"] > best["length"] * r["period"], r).otherwise(best)
    best = F.reduce("runs", F.try_element_at("runs", F.lit(1)), stronger)
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    return docs.withColumn("best", best).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        "best.start",
        "best.length",
        "best.period",
        F.expr("best.length * 1000 div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
        "n_words",
    )
