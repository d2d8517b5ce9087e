"""Token counts of texts without making their ids.

Documents are taken in chunks. A chunk turns into one row per distinct pre-token, with the
documents that hold it and how often. The rows are shuffled by pre-token and sorted, so each distinct
pre-token is encoded once where its rows meet; that count times the frequency, summed per document, is
its number of tokens. What is shuffled is the frequencies, three bytes an entry, and the sums; the texts are not.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablegauge.llm.common import worker_table
from tablegauge.llm.tokens import PreTokenizer

CHUNK_DOCUMENTS = 4096
CHUNK_CHARACTERS = 16_000_000
#: A pre-token in one of FREQUENT documents of a chunk is spread over SPREAD tasks by chunk, each of which
#: encodes it once. There are at most FREQUENT times as many as a text has distinct pre-tokens on average.
FREQUENT = 16
SPREAD = 61
HELD_CHUNKS = 256

ENTRY = np.dtype([("doc", "<u2"), ("count", "u1")])
DOCUMENT = np.dtype([("doc_id", "<i8"), ("is_null", "u1"), ("n_bytes", "<i8"), ("special", "<i8")])

_ROWS = "pre_token string, chunk long, entries binary"


def _pre_tokenizer(path: str) -> PreTokenizer:
    return worker_table(("pre-tokens", path), lambda: PreTokenizer(path))


def _bytes_of(values: np.ndarray, ends: np.ndarray) -> pa.Array:
    """A binary array of consecutive stretches of `values`."""
    offsets = np.concatenate([[0], ends * values.dtype.itemsize]).astype(np.int64)
    return pa.Array.from_buffers(pa.large_binary(), len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(values.tobytes())]).cast(pa.binary())


def _frequency_rows(vocabulary: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def chunk_rows(number: int, ids: pa.Array, texts: pa.Array) -> pa.RecordBatch:
        names, token, owner, often, special = _pre_tokenizer(vocabulary).frequencies(texts)
        # a count has one byte; a larger one takes several entries
        times = -(-often // 255)
        token, owner = np.repeat(token, times), np.repeat(owner, times)
        count = np.full(len(token), 255, dtype=np.int64)
        last = np.cumsum(times) - 1
        count[last] = often - 255 * (times - 1)
        order = np.argsort(token, kind="stable")
        entries = np.empty(len(token), dtype=ENTRY)
        entries["doc"], entries["count"] = owner[order], count[order]
        ends = np.cumsum(np.bincount(token, minlength=len(names))).astype(np.int64)
        head = np.zeros(len(texts), dtype=DOCUMENT)
        head["doc_id"], head["is_null"] = pc.fill_null(ids, 0).to_numpy(), ids.is_null().to_numpy(zero_copy_only=False)
        head["n_bytes"], head["special"] = pc.fill_null(pc.binary_length(texts), 0).to_numpy(), special
        binary = pa.concat_arrays([_bytes_of(entries, ends), pa.array([head.tobytes()], pa.binary())])
        chunk = pa.array(np.full(len(names) + 1, number, dtype=np.int64))
        return pa.RecordBatch.from_arrays([pa.array([*names, None], pa.string()), chunk, binary], names=["pre_token", "chunk", "entries"])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            ids, texts = batch.columns
            size = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy())
            at = 0
            while at < len(ids):
                room = CHUNK_CHARACTERS + (size[at - 1] if at else 0)
                end = min(max(at + 1, int(np.searchsorted(size, room, side="right"))), at + CHUNK_DOCUMENTS)
                yield chunk_rows(number, ids[at:end], texts[at:end])
                number, at = number + 1, end

    return rows


def _count_pieces(vocabulary: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows sorted by pre-token in; sums per chunk, and the chunks' lists of documents, out."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        last: tuple[str | None, int] = (None, 0)

        def flush() -> pa.RecordBatch:
            rows = pa.RecordBatch.from_arrays(
                [pa.array(list(held), pa.int64()), pa.array([x.tobytes() for x in held.values()], pa.binary()), pa.array([False] * len(held))],
                names=["chunk", "entries", "is_head"],
            )
            held.clear()
            return rows

        for batch in batches:
            heads = batch.filter(batch.column(0).is_null())
            if heads.num_rows:
                yield pa.RecordBatch.from_arrays([*heads.columns[1:], pa.array([True] * heads.num_rows)], names=["chunk", "entries", "is_head"])
                batch = batch.filter(batch.column(0).is_valid())
            if not batch.num_rows:
                continue
            tokens = batch.column(0).dictionary_encode()
            names = tokens.dictionary.to_pylist()
            new = names[1:] if names[0] == last[0] else names
            pieces = ([last[1]] if names[0] == last[0] else []) + _pre_tokenizer(vocabulary).pieces(new)
            last = (names[-1], pieces[-1])
            pieces = np.array(pieces, dtype=np.int64)[tokens.indices.to_numpy()]
            entries = batch.column(2).cast(pa.large_binary())
            offsets = np.frombuffer(entries.buffers()[1], dtype=np.int64)[entries.offset : entries.offset + len(entries) + 1]
            flat = np.frombuffer(entries.buffers()[2], dtype=ENTRY, count=(offsets[-1] - offsets[0]) // ENTRY.itemsize, offset=offsets[0])
            each = np.diff(offsets) // ENTRY.itemsize
            tokens_of = flat["count"] * np.repeat(pieces, each)
            chunks, of = np.unique(batch.column(1).to_numpy(), return_inverse=True)
            place = np.repeat(of, each) * CHUNK_DOCUMENTS + flat["doc"]
            found = np.bincount(place, weights=tokens_of, minlength=len(chunks) * CHUNK_DOCUMENTS).astype(np.int64)
            for chunk, total in zip(chunks.tolist(), found.reshape(len(chunks), CHUNK_DOCUMENTS), strict=True):
                if chunk in held:
                    held[chunk] += total
                else:
                    if len(held) == HELD_CHUNKS:
                        yield flush()
                    held[chunk] = total.copy()
        if held:
            yield flush()

    return sums


def _sum_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by chunk in, documents out; one chunk is held."""
    at, total, head = None, None, None

    def documents() -> pa.RecordBatch:
        doc_id = pa.array(head["doc_id"], pa.int64(), mask=head["is_null"].astype(bool))
        tokens = total[: len(head)] + head["special"]
        return pa.RecordBatch.from_arrays([doc_id, pa.array(head["n_bytes"]), pa.array(tokens)], names=["doc_id", "n_bytes", "n_tokens"])

    for batch in batches:
        for i in range(batch.num_rows):
            chunk, entries, is_head = (c[i].as_py() for c in batch.columns)
            if chunk != at:
                if at is not None:
                    yield documents()
                at, total, head = chunk, np.zeros(CHUNK_DOCUMENTS, dtype=np.int64), None
            if is_head:
                head = np.frombuffer(entries, dtype=DOCUMENT)
            else:
                total += np.frombuffer(entries, dtype=np.int64)
    if at is not None:
        yield documents()


def token_counts(docs: DataFrame, vocabulary: str, limit: int) -> DataFrame:
    """`doc_id`, `n_bytes`, `n_tokens` and `over_limit` of every row; a null or empty text has 0 tokens.

    Repeated rows are counted each. The numbers are those of the library for the whole text.
    """
    rows = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_frequency_rows(vocabulary), _ROWS)
    frequent = F.octet_length("entries") >= ENTRY.itemsize * CHUNK_DOCUMENTS // FREQUENT
    salt = F.when(frequent | F.col("pre_token").isNull(), F.col("chunk") % SPREAD).otherwise(F.lit(0))
    sums = rows.repartition("pre_token", salt).sortWithinPartitions("pre_token")
    return (
        sums.mapInArrow(_count_pieces(vocabulary), "chunk long, entries binary, is_head boolean")
        .repartition("chunk")
        .sortWithinPartitions("chunk")
        .mapInArrow(_sum_chunks, "doc_id long, n_bytes long, n_tokens long")
        .withColumn("over_limit", F.col("n_tokens") > limit)
    )
