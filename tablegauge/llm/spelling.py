"""Grouping of spelling variants: words one edit apart, found by probing Bloom filters with generated edits.

Every word of the vocabulary sets a few bits of one 64-byte block of a Bloom filter; blocks are dealt to
shards by the word's length. Edits of a word are probed as hashes: a hash of a word is a polynomial of its
code points, so that of an edited word follows from prefix sums, without spelling it. Only edits that the
filter may hold are shuffled, to a join with the vocabulary by hash, and each pair found is compared as
text, so neither the filter nor the hash leaves a trace in the result.

Nearness is symmetric, so a word probes its deletions and its replacements by greater code points only;
insertions and the other replacements are the same pairs seen from the other word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablegauge.llm.common import checkpointed

#: What separates runs of letters.
NO_LETTERS = "[^A-Za-z\u00c0-\u00ff]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LEAST_LETTERS = 6
LEAST_COUNT = 5
#: A word is a variant of a near word that is so many times as frequent.
FORM_RATIO = 5

#: Odd multipliers of the two hash polynomials; with an inverse, a deletion shifts what follows it back.
MULTIPLIERS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
BITS_PER_WORD = 16
BLOCK_BITS = 512
PROBES = 7
#: Shards by length; longer words share the last one.
LONGEST_SHARD = 64
#: Blocks that are broadcast at once: 32 MB. A larger vocabulary is probed in several rounds, each
#: with the next range of blocks.
ROUND_BLOCKS = 1 << 19
#: Hashes a task makes at a time.
EDITS_AT_ONCE = 1 << 20

KEY = ["a", "b"]


def _powers(multiplier: int, n: int) -> np.ndarray:
    out = np.ones(n, dtype=np.uint64)
    out[1:] = multiplier
    return np.multiply.accumulate(out)


def _mixed(x: np.ndarray, salt: int) -> np.ndarray:
    x = x ^ np.uint64(salt)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def code_points(words: list[str], n: int) -> np.ndarray:
    """A row of code points for each word of `n` code points."""
    return np.frombuffer("".join(words).encode("utf-32-le"), dtype="<u4").reshape(len(words), n).astype(np.uint64)


def word_hashes(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return tuple((points * _powers(m, points.shape[1])).sum(axis=1, dtype=np.uint64) for m in MULTIPLIERS)


def edit_hashes(points: np.ndarray, alphabet: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(length, row, hash a, hash b) of each word's deletions, then of its replacements by greater letters, in bounded parts.

    Of a stretch of one letter only the first is deleted, since the others give the same word.
    """
    rows, n = points.shape
    powers = [_powers(m, n + 1) for m in MULTIPLIERS]
    terms = [points * p[:n] for p in powers]
    totals = [t.sum(axis=1, dtype=np.uint64) for t in terms]
    fresh = np.ones((rows, n), dtype=bool)
    fresh[:, 1:] = points[:, 1:] != points[:, :-1]
    row, at = np.nonzero(fresh)
    deleted = []
    for m, term, total in zip(MULTIPLIERS, terms, totals, strict=True):
        upto = np.add.accumulate(term, axis=1, dtype=np.uint64)
        after = (total[:, None] - upto) * np.uint64(pow(m, -1, 1 << 64))
        deleted.append((upto - term + after)[row, at])
    yield n - 1, row, *deleted
    places = max(1, EDITS_AT_ONCE // (rows * len(alphabet)))
    for start in range(0, n, places):
        here = points[:, start : start + places]
        row, at, letter = np.nonzero(alphabet[None, None, :] > here[:, :, None])
        change = alphabet[letter] - here[row, at]
        yield n, row, *[total[row] + change * p[start + at] for total, p in zip(totals, powers, strict=True)]


def _bits(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return _mixed(a ^ (b << np.uint64(1)), 0x5851F42D4C957F2D)


class Shards:
    """Where the block of a word is: the first block and number of blocks of each shard, by the words' numbers."""

    def __init__(self, words: dict[int, int]):
        sizes = np.zeros(LONGEST_SHARD + 1, dtype=np.int64)
        for shard, n in words.items():
            sizes[shard] = -(-n * BITS_PER_WORD // BLOCK_BITS)
        self.sizes = sizes.astype(np.uint64)
        self.first = np.concatenate(([0], np.cumsum(sizes)[:-1]))
        self.blocks = int(sizes.sum())

    def block(self, length: int, a: np.ndarray, b: np.ndarray) -> np.ndarray | None:
        """Block numbers of words of a length; None if the vocabulary has no word of the shard."""
        shard = min(length, LONGEST_SHARD)
        if not self.sizes[shard]:
            return None
        return (_mixed(a ^ (b >> np.uint64(1)), 0x14057B7EF767814F) % self.sizes[shard]).astype(np.int64) + self.first[shard]


def _groups(batches: Iterator[pa.RecordBatch], rows: int = 8192) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Parts of the batches whose words (the first column) have one length, with their code points.

    A part holds few words if they are long, so that what is made of it stays bounded.
    """
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            part = batch.slice(at, rows)
            words = part.column(0).to_pylist()
            lengths = np.array([len(w) for w in words], dtype=np.int64)
            order = np.argsort(lengths, kind="stable")
            for group in np.split(order, np.flatnonzero(np.diff(lengths[order])) + 1):
                if len(group):
                    n = int(lengths[group[0]])
                    step = max(1, EDITS_AT_ONCE // (64 * max(n, 1)))
                    for i in range(0, len(group), step):
                        some = group[i : i + step]
                        yield part, some, code_points([words[j] for j in some], n)


def _hashed(vocabulary: DataFrame) -> DataFrame:
    """`word`, `n` and its hashes `a`, `b`."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, rows, points in _groups(batches):
            a, b = word_hashes(points)
            chosen = part.take(pa.array(rows))
            yield pa.RecordBatch.from_arrays([*chosen.columns, pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["word", "n", *KEY])

    return vocabulary.select("word", "n").mapInArrow(make, "word string, n long, a long, b long")


def _filter_blocks(hashed: DataFrame, shards: Shards) -> DataFrame:
    """`block` and its eight words of bits `w0` to `w7`: the parts of all tasks merged by a bitwise or."""
    words = BLOCK_BITS // 64

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = batch.column(0).to_numpy()
            a, b = (batch.column(i).to_numpy().view(np.uint64) for i in (1, 2))
            block = np.zeros(len(a), dtype=np.int64)
            for n in np.unique(lengths):
                of = lengths == n
                block[of] = shards.block(int(n), a[of], b[of])
            numbers, place = np.unique(block, return_inverse=True)
            bits = np.zeros((len(numbers), words), dtype=np.uint64)
            mixed = _bits(a, b)
            for i in range(PROBES):
                bit = (mixed >> np.uint64(9 * i)) & np.uint64(BLOCK_BITS - 1)
                np.bitwise_or.at(bits, (place, (bit >> np.uint64(6)).astype(np.int64)), np.uint64(1) << (bit & np.uint64(63)))
            columns = [pa.array(numbers), *[pa.array(np.ascontiguousarray(bits[:, i]).view(np.int64)) for i in range(words)]]
            yield pa.RecordBatch.from_arrays(columns, names=["block", *[f"w{i}" for i in range(words)]])

    schema = "block long, " + ", ".join(f"w{i} long" for i in range(words))
    parts = hashed.select(_shard("word").alias("shard"), *KEY).mapInArrow(build, schema)
    return parts.groupBy("block").agg(*[F.bit_or(f"w{i}").alias(f"w{i}") for i in range(words)])


def _shard(word: str) -> Column:
    return F.least(F.char_length(word), F.lit(LONGEST_SHARD))


def held(bits: np.ndarray, low: int, block: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Places of the hashes that the blocks from `low` on may hold."""
    left = np.flatnonzero((block >= low) & (block < low + len(bits)))
    mixed = _bits(a[left], b[left])
    for i in range(PROBES):
        bit = (mixed >> np.uint64(9 * i)) & np.uint64(BLOCK_BITS - 1)
        found = (bits[block[left] - low, (bit >> np.uint64(6)).astype(np.int64)] >> (bit & np.uint64(63))) & np.uint64(1)
        keep = found.astype(bool)
        left, mixed = left[keep], mixed[keep]
    return left


def _positives(hashed: DataFrame, shards: Shards, filter_blocks: DataFrame, low: int, alphabet: np.ndarray) -> DataFrame:
    """Key `a`, `b` of a word and key `ea`, `eb` of an edit of it that a block from `low` on may hold."""
    rows = filter_blocks.where((F.col("block") >= low) & (F.col("block") < low + ROUND_BLOCKS)).toPandas()
    bits = np.zeros((min(ROUND_BLOCKS, shards.blocks - low), BLOCK_BITS // 64), dtype=np.uint64)
    bits[rows["block"].to_numpy() - low] = np.ascontiguousarray(rows.drop(columns="block").to_numpy(dtype=np.int64)).view(np.uint64)
    shared = hashed.sparkSession.sparkContext.broadcast(bits)

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = shared.value
        for part, rows, points in _groups(batches):
            key = [part.column(i).to_numpy()[rows] for i in (1, 2)]
            for length, row, a, b in edit_hashes(points, alphabet):
                block = shards.block(length, a, b)
                if block is not None:
                    at = held(bits, low, block, a, b)
                    arrays = [key[0][row[at]], key[1][row[at]], a[at].view(np.int64), b[at].view(np.int64)]
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in arrays], names=["a", "b", "ea", "eb"])

    return hashed.select("word", *KEY).mapInArrow(probe, "a long, b long, ea long, eb long")


def near_pairs(vocabulary: DataFrame) -> DataFrame:
    """`word`, `n`, `near`, `near_n`: all words of `vocabulary` (`word`, `n`; distinct, not null) one edit apart, both ways round.

    One edit inserts, deletes or replaces one code point. An empty vocabulary gives no pairs.
    """
    hashed = checkpointed(_hashed(vocabulary))
    lengths = hashed.groupBy(_shard("word").alias("shard")).count().collect()  # a row a shard
    shards = Shards({r["shard"]: r["count"] for r in lengths})
    letters = hashed.select(F.explode(F.array_distinct(F.split("word", ""))).alias("c")).where("c <> ''").distinct()
    # a character class bounds the alphabet; there are 1,114,112 code points at most in any case
    alphabet = np.array(sorted(ord(r[0]) for r in letters.collect()), dtype=np.uint64)
    blocks = checkpointed(_filter_blocks(hashed, shards)) if shards.blocks > ROUND_BLOCKS else _filter_blocks(hashed, shards)
    positives = None
    for low in range(0, max(1, shards.blocks), ROUND_BLOCKS):
        found = _positives(hashed, shards, blocks, low, alphabet)
        positives = found if positives is None else positives.unionByName(found)
    edited = hashed.select(F.col("a").alias("ea"), F.col("b").alias("eb"), F.col("word").alias("near"), F.col("n").alias("near_n"))
    pairs = positives.join(edited, ["ea", "eb"]).join(hashed, KEY).where(F.levenshtein("word", "near", 1) == 1)
    pairs = checkpointed(pairs.select("word", "n", "near", "near_n"))
    return pairs.unionByName(pairs.select(F.col("near").alias("word"), F.col("near_n").alias("n"), F.col("word").alias("near"), F.col("n").alias("near_n")))


def roots(forms: DataFrame) -> DataFrame:
    """`word` and `root`, the end of its chain of forms, for the rows (`word`, `form`) of words that have one.

    Chains are halved in each round. Forms must not run in circles; a form is more frequent than its word here.
    """
    current = checkpointed(forms.select("word", F.col("form").alias("root")))
    while True:
        ahead = current.select(F.col("word").alias("root"), F.col("root").alias("__next"))
        moved = current.join(ahead, "root", "left").select("word", F.coalesce("__next", "root").alias("root"), F.col("__next").isNotNull().alias("moved"))
        moved = checkpointed(moved)
        if not moved.where("moved").limit(1).count():
            return moved.select("word", "root")
        current = moved.select("word", "root")


def spelling_forms(vocabulary: DataFrame, ratio: int = FORM_RATIO) -> DataFrame:
    """`word`, `n`, `n_near`, `form`, `form_n` and `root` of every row of `vocabulary` (`word`, `n`).

    `form` is the near word (one inserted, deleted or replaced code point) of largest `n`, ties to the
    smallest in code-point order, if that is `ratio` (2 or more) times the word's `n`; else null. `root`
    follows forms to the last. Words are distinct; null words are left out. An empty table gives none.
    """
    if ratio < 2:
        raise ValueError("a form must be more frequent than its word")
    words = checkpointed(vocabulary.where("word IS NOT NULL").select("word", F.col("n").cast("long").alias("n")))
    near = near_pairs(words).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("n"), F.col("near").alias("near"))).alias("best"))
    is_form = -F.col("best.n") >= ratio * F.col("n")
    found = checkpointed(
        words.join(near, "word", "left").select(
            "word",
            "n",
            F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
            F.when(is_form, F.col("best.near")).alias("form"),
            F.when(is_form, -F.col("best.n")).alias("form_n"),
        )
    )
    last = roots(found.where("form IS NOT NULL"))
    return found.join(last, "word", "left").withColumn("root", F.coalesce("root", "word"))


def typo_words(docs: DataFrame) -> DataFrame:
    """`word` for every run of at least `LEAST_LETTERS` letters of `docs`, A-Z in lower case, one code point short where 199 divides the
    checksum of `doc_id:word`. A null text has none; a null id leaves its words as they are."""
    run = F.explode(F.filter(F.split("text", NO_LETTERS), lambda w: F.char_length(w) >= LEAST_LETTERS))
    words = docs.select(F.col("doc_id").cast("long").alias("doc_id"), run.alias("run")).select("doc_id", F.translate("run", UPPER, LOWER).alias("run"))
    checksum = F.crc32(F.concat_ws(":", F.col("doc_id").cast("string"), "run"))
    at = (checksum % F.char_length("run")).cast("int")
    shorter = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.char_length("run")))
    return words.select(F.when(F.col("doc_id").isNotNull() & (checksum % 199 == 0), shorter).otherwise(F.col("run")).alias("word"))


def frequent_words(words: DataFrame, least_letters: int = LEAST_LETTERS, least_count: int = LEAST_COUNT) -> DataFrame:
    """`word` and its number of rows `n`, of the words with enough code points and rows; counted before the shuffle."""
    long_enough = words.where(F.char_length("word") >= least_letters)
    return long_enough.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least_count)


# The checksum is linear over its bytes with a table of 256 numbers; near words share a pattern with one
# place left open (a replacement), or one is a deletion of the other.
SPELLING_SQL = f"""
WITH RECURSIVE bits AS (
    SELECT list_transform(range(256), lambda x: list_reduce([x, 1, 2, 3, 4, 5, 6, 7, 8],
           lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
runs AS (
    SELECT doc_id, translate(run, '{UPPER}', '{LOWER}') AS run, count(*) AS c
    FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')) AS run FROM documents)
    WHERE length(run) >= {LEAST_LETTERS} GROUP BY ALL),
hexed AS (SELECT *, hex(encode(doc_id || ':' || run)) AS h FROM runs),
checked AS (
    SELECT doc_id, run, c, xor(4294967295, list_reduce(
        list_transform(range(length(h) // 2), lambda i: CAST('0x' || substr(h, 2 * i + 1, 2) AS BIGINT)),
        lambda x, y: xor(x >> 8, t[(xor(x, y) & 255) + 1]), CAST(4294967295 AS BIGINT))) AS crc
    FROM hexed, bits),
words AS (
    SELECT word, CAST(sum(c) AS BIGINT) AS n FROM (
        SELECT c, CASE WHEN crc % 199 = 0 THEN left(run, crc % length(run)) || substr(run, crc % length(run) + 2) ELSE run END AS word FROM checked)
    WHERE length(word) >= {LEAST_LETTERS} GROUP BY word HAVING sum(c) >= {LEAST_COUNT}),
places AS (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words),
parts AS (SELECT DISTINCT word, n, left(word, i - 1) || substr(word, i + 1) AS short FROM places),
opened AS (SELECT word, n, i, left(word, i - 1) || substr(word, i + 1) AS short FROM places),
pairs AS (
    SELECT x.word, y.word AS near, y.n AS near_n FROM opened x JOIN opened y ON x.short = y.short AND x.i = y.i AND x.word <> y.word
    UNION SELECT p.word, w.word, w.n FROM parts p JOIN words w ON p.short = w.word
    UNION SELECT w.word, p.word, p.n FROM parts p JOIN words w ON p.short = w.word),
best AS (
    SELECT word, count(*) AS n_near, max(near_n) AS near_n, min_by(near, struct_pack(n := -near_n, near := near)) AS near FROM pairs GROUP BY word),
formed AS (
    SELECT w.word, w.n, CAST(coalesce(b.n_near, 0) AS BIGINT) AS n_near,
           CASE WHEN b.near_n >= {FORM_RATIO} * w.n THEN b.near END AS form, CASE WHEN b.near_n >= {FORM_RATIO} * w.n THEN b.near_n END AS form_n
    FROM words w LEFT JOIN best b ON w.word = b.word),
chain AS (
    SELECT word, word AS root FROM formed
    UNION ALL SELECT c.word, f.form FROM chain c JOIN formed f ON c.root = f.word WHERE f.form IS NOT NULL)
SELECT f.word, f.form, c.root, f.n, f.n_near, f.form_n
FROM formed f JOIN chain c ON f.word = c.word JOIN formed e ON c.root = e.word WHERE e.form IS NULL
"""
