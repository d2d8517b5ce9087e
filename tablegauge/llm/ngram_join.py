"""Similarity join of documents on word n-grams: MinHash bands find pairs, whole n-gram sets verify them.

Documents with equal n-gram sets are one class and enter the join once. Classes that share a band's
hash meet in a bucket. Buckets with the same members are visited once, large ones in blocks, a pair of
blocks to a task. A pair counts only in the first band that its classes share, so it is counted once,
and a task returns numbers of links and a spanning forest rather than pairs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablegauge.llm.common import checkpointed, free_worker_table, row_key, worker_table
from tablegauge.llm.components import components

WORDS = 5
SIMILARITY = 0.8
#: Chance that a pair just at the threshold shares a band; above it the chance is higher.
RECALL = 0.9995
#: Pairs this far below the threshold should seldom share a band: at most at NOISE.
FAR_SIMILARITY, NOISE = 0.4, 0.3
#: A block of a bucket has about so many classes, and so many n-grams in all.
BLOCK_CLASSES = 256
BLOCK_NGRAMS = 1 << 18
KNOWN_WORDS = 250_000

_MIX = np.uint64(0x9E3779B97F4A7C15)


def choose_bands(similarity: float = SIMILARITY, recall: float = RECALL) -> tuple[int, int]:
    """Bands and rows per band: the shortest signature with the recall that keeps far pairs apart."""
    found = []
    for rows in range(1, 17):
        bands = int(np.ceil(np.log(1 - recall) / np.log(1 - similarity**rows)))
        if 1 - (1 - FAR_SIMILARITY**rows) ** bands <= NOISE:
            found.append((bands * rows, bands, rows))
    _, bands, rows = min(found)
    return bands, rows


class _WordHashes(dict):
    def __missing__(self, word: str) -> int:
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def _word_hashes() -> _WordHashes:
    return worker_table(("word hashes",), _WordHashes)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def ngram_hashes(text: str | None, words: int = WORDS) -> np.ndarray:
    """Distinct hashes of all runs of `words` lower-case words, ascending; a shorter text is one run."""
    known = _word_hashes()
    if len(known) > KNOWN_WORDS:
        known.clear()
    parts = (text or "").lower().split()
    if not parts:
        return np.zeros(0, dtype=np.uint64)
    hashes = np.fromiter(map(known.__getitem__, parts), dtype=np.uint64, count=len(parts))
    n = max(1, len(hashes) - words + 1)
    out = np.full(n, len(hashes[:words]), dtype=np.uint64)
    for i in range(min(words, len(hashes))):
        out = out * _MIX + hashes[i : i + n]
    return np.unique(_mixed(out))


def _permutations(count: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20)
    draw = rng.integers(0, 1 << 63, size=(2, count), dtype=np.int64).astype(np.uint64)
    return draw[0] * np.uint64(2) + np.uint64(1), draw[1]


def band_hashes(ngrams: np.ndarray, bands: int, rows: int) -> np.ndarray:
    if not len(ngrams):
        return np.zeros(0, dtype=np.int64)
    scale, shift = _permutations(bands * rows)
    least = np.full(bands * rows, np.iinfo(np.uint64).max, dtype=np.uint64)
    for i in range(0, len(ngrams), 1024):
        least = np.minimum(least, (ngrams[i : i + 1024, None] * scale + shift).min(axis=0))
    out = np.zeros(bands, dtype=np.uint64)
    for column in least.reshape(bands, rows).T:
        out = _mixed(out * _MIX + column)
    return out.view(np.int64)


def _sign(words: int, bands: int, rows: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [ngram_hashes(t, words) for t in batch.column(2).to_pylist()]
            arrays = [
                batch.column(0),
                batch.column(1),
                pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary()),
                pa.array([len(s) for s in sets], pa.int64()),
                pa.array([band_hashes(s, bands, rows) for s in sets], pa.list_(pa.int64())),
            ]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "key", "node", "n_grams", "bands"])

    return sign


def _read_sets(words: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [ngram_hashes(t, words).tobytes() for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary())], names=["node", "ngrams"])

    return sets


def _shared(sets: list[np.ndarray]) -> np.ndarray:
    """Number of n-grams in common, for all pairs of a block of sets."""
    n = len(sets)
    owner = np.repeat(np.arange(n), [len(s) for s in sets])
    every = np.concatenate(sets)
    order = np.argsort(every, kind="stable")
    owner, every = owner[order], every[order]
    number = np.cumsum(np.concatenate([[0], every[1:] != every[:-1]]))
    common = np.bincount(number) > 1
    column = (np.cumsum(common) - 1)[number]
    owner, column = owner[common[number]], column[common[number]]
    out, width = np.zeros((n, n), dtype=np.float32), 8192
    for at in range(0, int(common.sum()), width):
        low, high = np.searchsorted(column, [at, at + width])
        part = np.zeros((n, width), dtype=np.float32)
        part[owner[low:high], column[low:high] - at] = 1
        out += part @ part.T
    return out.astype(np.int64)


def _verify(similarity: float) -> Callable[[tuple, pa.Table], pa.Table]:
    millionths = round(similarity * 1_000_000)

    def verify(key: tuple, rows: pa.Table) -> pa.Table:
        free_worker_table()
        band, _, low, high = (k.as_py() for k in key)
        nodes = rows.column("node").to_pylist()
        sets = [np.frombuffer(x, dtype=np.uint64) for x in rows.column("ngrams").to_pylist()]
        shared = _shared(sets)
        size = np.array([len(s) for s in sets])
        linked = shared * 1_000_000 >= millionths * (size[:, None] + size[None, :] - shared)
        np.fill_diagonal(linked, False)
        if low != high:
            block = rows.column("block").to_numpy()
            linked &= block[:, None] != block[None, :]
        bands = np.array(rows.column("bands").to_pylist(), dtype=np.int64)
        for k in range(band):
            linked &= bands[:, k][:, None] != bands[:, k][None, :]
        root = np.arange(len(nodes))
        while True:
            least = np.minimum(root, np.where(linked, root[None, :], len(nodes)).min(axis=1))
            if (least == root).all():
                break
            root = least
        links = linked.sum(axis=1)
        has = np.flatnonzero(links)
        arrays = [pa.array([nodes[i] for i in has], pa.binary()), pa.array([nodes[root[i]] for i in has], pa.binary()), pa.array(links[has], pa.int64())]
        return pa.Table.from_arrays(arrays, names=["node", "root", "links"])

    return verify


def ngram_join(docs: DataFrame, words: int = WORDS, similarity: float = SIMILARITY, recall: float = RECALL) -> DataFrame:
    """A row per row of `docs`: `doc_id`, `key`, `root`, `class_id`, `copy_id`, `links`.

    `key` (see `row_key`) is of id and text. `copy_id` is the smallest id of the documents with the
    same n-gram set. `links` counts the other n-gram sets with a Jaccard similarity of `similarity` or
    more. `class_id` is the smallest id of all documents reached over copies and links, null if all
    their ids are null; `root` tells classes apart in any case. A text of fewer words than `words` is
    one n-gram; null, empty and blank texts have none and are copies of each other.
    """
    bands, rows = choose_bands(similarity, recall)
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), row_key("doc_id", "text").alias("key"), "text")
    signed = checkpointed(
        keyed.mapInArrow(
            _sign(words, bands, rows), "doc_id long, key struct<a: long, b: long>, node binary, n_grams long, bands array<long>"
        )
    )
    classes = signed.groupBy("node").agg(
        F.min("doc_id").alias("copy_id"), F.min("key").alias("key"), F.first("n_grams").alias("n_grams"), F.first("bands").alias("bands")
    )
    classes = checkpointed(classes)
    in_band = classes.select("node", "n_grams", F.posexplode("bands").alias("band", "value"))
    buckets = (
        in_band.groupBy("band", "value")
        .agg(
            F.count(F.lit(1)).alias("members"),
            F.sum("n_grams").alias("n_grams"),
            F.min("node").alias("least"),
            F.bit_xor(F.xxhash64("node")).alias("x"),
            F.bit_xor(F.xxhash64(F.lit(1), "node")).alias("y"),
        )
        .where("members > 1")
        .groupBy("members", "n_grams", "least", "x", "y")
        .agg(F.min(F.struct("band", "value")).alias("at"))
        .select(
            "at.band",
            "at.value",
            F.expr(f"int(least(members, greatest(ceil(members / {BLOCK_CLASSES}), ceil(n_grams / {BLOCK_NGRAMS}))))").alias("blocks"),
        )
    )
    members = checkpointed(in_band.join(buckets, ["band", "value"]).select("band", "value", "blocks", "node"))
    wanted = members.select("node").distinct().join(classes, "node").select("node", "key", "bands")
    # one row per key: rows equal in id and text are the same text
    texts = keyed.select("key", "text").join(wanted.select("key", "node"), "key").dropDuplicates(["node"])
    sets = texts.select("node", "text").mapInArrow(_read_sets(words), "node binary, ngrams binary").join(wanted.select("node", "bands"), "node")
    block = F.pmod(F.xxhash64(F.lit(2), "node"), F.col("blocks")).cast("int")
    verified = checkpointed(
        members.withColumn("block", block)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("band", "value", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block", "node")
        .join(sets, "node")
        .groupBy("band", "value", "low", "high")
        .applyInArrow(_verify(similarity), "node binary, root binary, links long")
    )
    links = verified.groupBy("node").agg(F.sum("links").alias("links"))
    roots = components(verified.select("node", "root"))
    labelled = classes.select("node", "copy_id").join(roots, "node", "left").join(links, "node", "left")
    labelled = labelled.select("node", "copy_id", F.coalesce("root", "node").alias("root"), F.coalesce("links", F.lit(0)).alias("links"))
    least = labelled.groupBy("root").agg(F.min("copy_id").alias("class_id"))
    found = labelled.join(least, "root").select("node", "root", "class_id", "copy_id", "links")
    return signed.select("doc_id", "key", "node").join(found, "node").select("doc_id", "key", "root", "class_id", "copy_id", "links")


def drop_near_duplicates(docs: DataFrame, words: int = WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """`docs` with one row of each class: the smallest id, of rows with that id the smallest key.

    Rows equal in id and text count as one row, whatever their other columns hold.
    """
    found = ngram_join(docs, words, similarity)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key"))
    kept = checkpointed(found.groupBy("root").agg(first.alias("first")).select("first.key"))
    names = [F.col(f"`{c}`") for c in docs.columns]
    keyed = docs.withColumn("__key", row_key("doc_id", "text"))
    return keyed.join(kept.withColumnRenamed("key", "__key"), "__key", "left_semi").dropDuplicates(["__key"]).select(*names)
