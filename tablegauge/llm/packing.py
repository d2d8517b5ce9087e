"""Best-fit packing of token sequences by the sum-of-squares rule.

A document is encoded, ended by one id, and cut into pieces only where it is longer than a sequence.
Pieces are packed in groups of bounded size, a group to a task: each piece, longest first, goes where
the squared counts of open sequences per residual gap become smallest. A group leaves a few badly
filled sequences; their pieces meet those of other groups in the next round, until one group is left.
So no round has more than one group's pieces in a task, and the loss at the ends of groups vanishes.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablegauge.llm.common import checkpointed, free_worker_table, text_slices
from tablegauge.llm.tokens import word_encoder

SEQUENCE_TOKENS = 2048
GROUP_PIECES = 4096
#: A sequence filled to this share or more is left as it is in the next rounds.
GOOD_FILL = 0.995
#: Sequence numbers have room for so many rounds; each of them settles a tenth of its pieces or is the last.
MOST_ROUNDS = 30

PIECE_SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long"


def document_pieces(docs: DataFrame, vocabulary: str, end_id: int, size: int = SEQUENCE_TOKENS, carry: str = "") -> DataFrame:
    """One row per piece of each document: place and length in ids, and the checksum of its ids.

    A null or empty text is the end id alone. Repeated rows give their pieces again. `carry` names a
    long column of `docs` that is kept on every piece.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, 1):
            row, piece, start, length, crc = [], [], [], [], []
            for i, ids in enumerate(word_encoder(vocabulary).encode(batch.column(1), end_id)):
                for k, at in enumerate(range(0, len(ids), 4 * size)):
                    part = ids[at : at + 4 * size]
                    row.append(i)
                    piece.append(k)
                    start.append(at // 4)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
            row = pa.array(row, pa.int64())
            columns = [batch.column(0).take(row), pa.array(piece, pa.int32())]
            columns += [pa.array(x, pa.int64()) for x in (start, length, crc)]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if carry:
                columns.append(batch.column(2).take(row))
                names.append(carry)
            yield pa.RecordBatch.from_arrays(columns, names=names)

    wanted = [F.col("doc_id").cast("long"), F.col("text"), *([F.col(carry).cast("long")] if carry else [])]
    return docs.select(*wanted).mapInArrow(cut, PIECE_SCHEMA + (f", {carry} long" if carry else ""))


def sum_of_squares(lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Sequence number and offset of each length, placed one after another in the order given.

    Putting a piece on a sequence of level h moves one sequence from the count of level h to that of
    h + length; the place with the smallest sum of squared counts wins, on a tie the fuller one.
    Levels 0 and `size` (no sequence yet, no gap left) do not count.
    """
    count = np.zeros(size + 1, dtype=np.int64)
    open_at: list[list[int]] = [[] for _ in range(size + 1)]
    bins, offsets, made = np.zeros(len(lengths), dtype=np.int64), np.zeros(len(lengths), dtype=np.int64), 0
    for i, length in enumerate(lengths.tolist()):
        before = count[: size - length + 1]
        change = 2 * (count[length:] - before) + 2
        change[-1] -= 1  # a sequence that becomes full leaves the sum
        change[before == 0] = np.iinfo(np.int64).max
        fresh = 2 * int(count[length]) + 1 if length < size else 0
        level = size - length - int(np.argmin(change[::-1]))
        if change[level] > fresh:
            level = 0
        if level == 0:
            made += 1
            bins[i] = made - 1
        else:
            bins[i] = open_at[level].pop()
            count[level] -= 1
            offsets[i] = level
        to = level + length
        if to < size:
            open_at[to].append(int(bins[i]))
            count[to] += 1
    return bins, offsets


def _place(prefix: int, last: bool, size: int) -> Callable[[tuple, pa.Table], pa.Table]:
    """Packs the pieces of a group; `last` keeps all of them, else only well filled sequences are good."""

    def place(key: tuple, pieces: pa.Table) -> pa.Table:
        free_worker_table()
        pieces = pieces.take(pc.sort_indices(pieces, [("length", "descending"), ("__tie", "ascending")]))
        lengths = pieces.column("length").to_numpy()
        bins, offsets = sum_of_squares(lengths, size)
        filled = np.bincount(bins, weights=lengths)
        return (
            pieces.drop_columns(["__group", "__tie"])
            .append_column("sequence_id", pa.array(prefix + (key[0].as_py() << 24) + bins))
            .append_column("offset", pa.array(offsets))
            .append_column("__good", pa.array(last | (filled[bins] >= GOOD_FILL * size)))
        )

    return place


def pack(pieces: DataFrame, size: int = SEQUENCE_TOKENS, group_pieces: int = GROUP_PIECES, first_group: Column | None = None) -> DataFrame:
    """`pieces` (with a `length` of 1 to `size`) plus `sequence_id` and `offset`, gapless from 0.

    The result does not depend on how rows are spread over tasks: groups are made by a hash of the
    piece, or by `first_group` (a long) in the first round, and ordered by length and identity
    within. Rounds go on until one group is left, or until one settles less than a tenth of its pieces
    (or `MOST_ROUNDS` are done), as further ones would change little. An empty input gives an empty result.
    """
    names = [c for c in pieces.columns if c not in ("sequence_id", "offset")]
    left = checkpointed(pieces.select(*names))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in left.schema.fields)
    done, level, before = None, 0, math.inf
    identity = F.xxhash64(*[c for c in names if c != "length"])
    while True:
        rows = left.count()
        groups = max(1, -(-rows // group_pieces))
        by = first_group if level == 0 and first_group is not None else F.pmod(F.xxhash64(F.lit(level), identity), F.lit(groups))
        # groups that the caller made leave badly filled sequences each, which meet in the rounds after
        last = (groups == 1 or 10 * rows > 9 * before or level == MOST_ROUNDS) and not (level == 0 and first_group is not None)
        placed = checkpointed(
            left.withColumn("__group", by)
            .withColumn("__tie", identity)
            .groupBy("__group")
            .applyInArrow(_place(level << 58, last, size), schema + ", sequence_id long, offset long, __good boolean")
        )
        good = placed.where("__good").drop("__good")
        done = good if done is None else done.unionByName(good)
        if last:
            return done
        left, before = placed.where("NOT __good").select(*names), rows if level else math.inf
        level += 1


def pack_documents(docs: DataFrame, vocabulary: str, end_id: int, size: int = SEQUENCE_TOKENS) -> DataFrame:
    """Every document of `docs` in as few sequences of at most `size` ids as the rule finds."""
    return pack(document_pieces(docs, vocabulary, end_id, size), size)
