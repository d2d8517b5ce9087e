"""Token-id files: each document compressed by itself under one shared dictionary.

A store is a folder with two Parquet tables, so that it lives wherever Spark can write and a task
that is run again replaces its own output:

* `dictionary`: `hash` (of the bytes), `dictionary` (zstandard, trained on serialized id arrays);
* `shards`: one row per shard of consecutive documents, with `range`, `shard` and `ids_before`
  (shards and ids of the range before it), `first_id`, `last_id`, `n_docs`, `n_ids`,
  `dictionary_hash`, `doc_ids` and `index`, which lets a reader cut one document out of `payload`
  and unpack only that. `index` holds three
  little-endian numbers a document: offset and length in `payload`, and its number of ids.

Ids are serialized as unsigned 16-bit numbers if the vocabulary fits, else as 32-bit ones.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tablegauge.llm.common import bound_bucket, free_worker_table, id_bounds, text_batches, text_slices
from tablegauge.llm.tokens import word_encoder
from tablegauge.session import checkpoint_folder

DICTIONARY_BYTES = 32 * 1024
#: The dictionary is trained on this many documents, those with the smallest hash of their text,
#: and on so many ids of each; this bounds the training, not what is written.
TRAINING_DOCUMENTS = 1_000
TRAINING_IDS = 4_096
LEVEL = 3
SHARD_BYTES = 4 << 20
RANGE_DOCUMENTS = 8_192

INDEX = np.dtype([("offset", "<u8"), ("length", "<u4"), ("n_ids", "<u4")])
SHARD_SCHEMA = (
    "range int, shard int, ids_before long, first_id long, last_id long, n_docs long, n_ids long, dictionary_hash string,"
    " doc_ids array<long>, index binary, payload binary"
)


def _narrow(ids: bytes, wide: bool) -> bytes:
    return ids if wide else np.frombuffer(ids, dtype="<u4").astype("<u2").tobytes()


def _widen(raw: bytes, wide: bool) -> bytes:
    return raw if wide else np.frombuffer(raw, dtype="<u2").astype("<u4").tobytes()


def train_dictionary(docs: DataFrame, vocabulary: str, end_id: int, wide: bool) -> bytes:
    """A dictionary of at most DICTIONARY_BYTES; empty if there is too little to train on."""
    texts = docs.where("length(text) > 0").select(F.xxhash64("text").alias("hash"), "text")
    hashes = texts.select("hash").distinct().orderBy("hash").limit(TRAINING_DOCUMENTS)
    last = hashes.agg(F.max("hash")).first()[0]
    start = F.first(F.substring("text", 1, 4 * TRAINING_IDS)).alias("start")
    rows = texts.where(F.col("hash") <= F.lit(last)).groupBy("hash").agg(start).orderBy("hash").collect()
    encoded = word_encoder(vocabulary).encode(pa.array([r.start for r in rows], pa.string()), end_id)
    samples = [_narrow(x[: 4 * TRAINING_IDS], wide) for x in encoded]
    free_worker_table()
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except zstandard.ZstdError:
        return b""


def _compressor(dictionary: bytes) -> zstandard.ZstdCompressor:
    shared = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
    return zstandard.ZstdCompressor(level=LEVEL, dict_data=shared, write_checksum=False)


def _decompressor(dictionary: bytes) -> zstandard.ZstdDecompressor:
    return zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)


def write_store(docs: DataFrame, folder: str, vocabulary: str, end_id: int) -> None:
    """Encode every whole text (null: empty), end it with `end_id`, and write the store.

    Documents are in ascending `doc_id` order, a null id first; repeated ids stay apart, in the
    order of their bytes. An empty table gives a store without shards.
    """
    spark = docs.sparkSession
    wide = max(end_id + 1, word_encoder(vocabulary).tokenizer.get_vocab_size()) > 1 << 16
    dictionary = train_dictionary(docs, vocabulary, end_id, wide)
    name = hashlib.sha256(dictionary + bytes([wide])).hexdigest()
    stored = spark.createDataFrame([(name, wide, bytearray(dictionary))], "hash string, wide boolean, dictionary binary")
    stored.coalesce(1).write.mode("overwrite").parquet(f"{folder}/dictionary")

    def compress(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = _compressor(dictionary)
        for batch in text_slices(batches, 1):
            ids = word_encoder(vocabulary).encode(batch.column(1), end_id)
            sizes = pa.array([len(x) // 4 for x in ids], pa.int64())
            blobs = pa.array([pack.compress(_narrow(x, wide)) for x in ids], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), sizes, blobs], names=["doc_id", "n_ids", "blob"])

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        free_worker_table()
        held: list[tuple] = []
        at, number, before, held_bytes = None, 0, 0, 0

        def row() -> dict:
            index = np.zeros(len(held), dtype=INDEX)
            index["length"], index["n_ids"] = [len(b) for _, _, b in held], [n for _, n, _ in held]
            index["offset"] = np.cumsum(index["length"], dtype="<u8") - index["length"]
            ids = [d for d, _, _ in held]
            return {
                "range": at, "shard": number, "ids_before": before, "first_id": ids[0], "last_id": ids[-1], "n_docs": len(held),
                "n_ids": sum(n for _, n, _ in held), "dictionary_hash": name, "doc_ids": ids,
                "index": index.tobytes(), "payload": b"".join(b for _, _, b in held),
            }

        schema = pa.schema(
            [("range", pa.int32()), ("shard", pa.int32())]
            + [(n, pa.int64()) for n in ("ids_before", "first_id", "last_id", "n_docs", "n_ids")]
            + [("dictionary_hash", pa.string()), ("doc_ids", pa.list_(pa.int64())), ("index", pa.binary()), ("payload", pa.binary())]
        )
        for batch in batches:
            for place, doc_id, n, blob in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and (place != at or held_bytes + len(blob) > SHARD_BYTES):
                    yield pa.RecordBatch.from_pylist([row()], schema=schema)
                    number, before = (number + 1, before + sum(n for _, n, _ in held)) if place == at else (0, 0)
                    held, held_bytes = [], 0
                at = place
                held.append((doc_id, n, blob))
                held_bytes += len(blob)
        if held:
            yield pa.RecordBatch.from_pylist([row()], schema=schema)

    bounds = id_bounds(docs, "doc_id", RANGE_DOCUMENTS)
    stored = (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
        .mapInArrow(compress, "doc_id long, n_ids long, blob binary")
        .withColumn("range", bound_bucket("doc_id", bounds))
        .repartition(max(1, len(bounds) + 1), "range")
        .sortWithinPartitions("range", F.col("doc_id").asc_nulls_first(), "blob")
        .select("range", "doc_id", "n_ids", "blob")
        .mapInArrow(shards, SHARD_SCHEMA)
    )
    with text_batches(spark):
        stored.write.mode("overwrite").parquet(f"{folder}/shards")


def _dictionary(spark: SparkSession, folder: str) -> tuple[str, bool, bytes]:
    row = spark.read.parquet(f"{folder}/dictionary").first()
    found = hashlib.sha256(bytes(row.dictionary) + bytes([row.wide])).hexdigest()
    if found != row.hash:
        raise ValueError(f"the dictionary of {folder} is damaged")
    return row.hash, row.wide, bytes(row.dictionary)


def _unpack(unpacker: zstandard.ZstdDecompressor, blob: bytes, n_ids: int, wide: bool) -> bytes:
    return _widen(unpacker.decompress(blob, max_output_size=max(1, n_ids * (4 if wide else 2))), wide)


def read_store(spark: SparkSession, folder: str, with_ids: bool = False) -> DataFrame:
    """Every document of a store: `doc_id`, `start` (ids before it), `n_tokens`, `ids_crc32`, and `ids` on request."""
    name, wide, dictionary = _dictionary(spark, folder)
    found = spark.read.parquet(f"{folder}/shards")
    ranges = found.groupBy("range").agg(F.sum("n_ids").alias("n"))  # a row per range, 4,096 at most
    before = ranges.select("range", (F.sum("n").over(Window.orderBy("range")) - F.col("n")).alias("range_start"))
    kept = "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids array<long>" if with_ids else "")

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        free_worker_table()
        unpacker = _decompressor(dictionary)
        for batch in batches:
            for i in range(batch.num_rows):
                first, used, doc_ids, index, payload = (c[i].as_py() for c in batch.columns)
                if used != name:
                    raise ValueError(f"a shard of {folder} was written with dictionary {used}")
                table = np.frombuffer(index, dtype=INDEX)
                raw = [
                    _unpack(unpacker, payload[o : o + size], n, wide)
                    for o, size, n in zip(table["offset"].tolist(), table["length"].tolist(), table["n_ids"].tolist(), strict=True)
                ]
                if [len(x) // 4 for x in raw] != table["n_ids"].tolist():
                    raise ValueError(f"a document of {folder} has another length than its index says")
                sizes = table["n_ids"].astype("i8")
                columns = [doc_ids, first + np.cumsum(sizes) - sizes, sizes, [zlib.crc32(x) for x in raw]]
                arrays = [pa.array(c, pa.int64()) for c in columns]
                names = ["doc_id", "start", "n_tokens", "ids_crc32"]
                if with_ids:
                    arrays.append(pa.array([np.frombuffer(x, dtype="<u4") for x in raw], pa.list_(pa.int64())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(arrays, names=names)

    return (
        found.join(F.broadcast(before), "range")
        .select((F.col("range_start") + F.col("ids_before")).alias("first"), "dictionary_hash", "doc_ids", "index", "payload")
        .mapInArrow(unpack, kept)
    )


def read_document(spark: SparkSession, folder: str, doc_id: int) -> list[list[int]]:
    """The ids of one document (of each row with that id): only its shards are read, only it is unpacked."""
    name, wide, dictionary = _dictionary(spark, folder)
    unpacker, out = _decompressor(dictionary), []
    place = F.posexplode("doc_ids").alias("place", "found")
    rows = (
        spark.read.parquet(f"{folder}/shards")
        .where((F.col("first_id").isNull() | (F.col("first_id") <= doc_id)) & (F.col("last_id") >= doc_id))
        .select("range", "shard", "dictionary_hash", "index", "payload", place)
        .where(F.col("found") == doc_id)
        .withColumn("entry", F.expr(f"substring(index, place * {INDEX.itemsize} + 1, {INDEX.itemsize})"))
        .orderBy("range", "shard", "place")
        .collect()
    )
    for row in rows:
        entry = np.frombuffer(bytes(row.entry), dtype=INDEX)[0]
        blob = bytes(row.payload)[int(entry["offset"]) : int(entry["offset"]) + int(entry["length"])]
        out.append(np.frombuffer(_unpack(unpacker, blob, int(entry["n_ids"]), wide), dtype="<u4").tolist())
    return out


def new_store(spark: SparkSession) -> str:
    """A folder for a store in the shared folder of the cluster."""
    return f"{checkpoint_folder(spark)}/token-store-{uuid.uuid4().hex}"
