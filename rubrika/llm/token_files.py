"""Token ids in binary files: one zstandard frame per document, all with one shared dictionary.

A folder holds ``dictionary``, a manifest table and any number of shards. A shard is

    magic "RBTF0001" | dictionary hash (32 bytes) | frames | index | footer

where the index has, per document, id (int64), null mark (uint8), frame offset (uint64) and number
of ids (uint32), column after column, and the footer is index offset (uint64) and document count
(uint64), little-endian all. A short document is read by its offset alone: footer, index, frame.

Cases: null text is an empty text; a document always has its end id, so none is without ids; null
ids come first and stay null; equal ids are ordered by a hash of the text; repeated rows are kept;
an empty table gives an empty folder with a manifest; columns other than id and text are not read.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator
from uuid import uuid4

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rubrika.llm.tokenizing import WORD_LEVEL, encode_column, encode_texts

MAGIC = b"RBTF0001"
END_ID = 2
LEVEL = 3
DICTIONARY_BYTES = 64 << 10
SAMPLE_ROWS = 512  # documents the dictionary is trained on, the first by a hash of their id
SAMPLE_CHARS = 20_000  # of a longer document in that sample a window of so many characters is read
PIECE_BYTES = 4 << 10  # ids are given to the training in pieces up to this size
DECODE_BYTES = 8 << 20
MANIFEST = "shard int, path string, n_docs long, n_tokens long"
DOCUMENTS = "doc_id long, start long, n_tokens long, ids binary"


def _with_end(ids: bytes) -> bytes:
    return ids + struct.pack("<I", END_ID)


def train_dictionary(docs: DataFrame, tokenizer: str = WORD_LEVEL) -> bytes:
    """A dictionary from serialized id arrays of a bounded sample of documents of any length; of a
    long one a window is read, at a place that a hash of its text gives. The sample is chosen by
    hashes alone, and only the chosen windows reach the driver. Empty when there is too little to
    train on: frames are then compressed without one."""
    facts = docs.where(F.length("text") > 0).select("doc_id", F.xxhash64("text").alias("h"))
    chosen = facts.orderBy(F.xxhash64("doc_id"), "doc_id", "h").limit(SAMPLE_ROWS).distinct()
    keys = [(row["doc_id"], row["h"]) for row in chosen.collect()]
    if not keys:
        return b""
    number = facts.schema["doc_id"].dataType.simpleString()
    keys = docs.sparkSession.createDataFrame(keys, f"key {number}, h long")
    spare = F.greatest(F.length("text") - SAMPLE_CHARS, F.lit(0)) + 1
    window = F.substring("text", (F.pmod(F.xxhash64("text"), spare) + 1).cast("int"), F.lit(SAMPLE_CHARS))
    same = F.col("doc_id").eqNullSafe(F.col("key")) & (F.xxhash64("text") == F.col("h"))
    sample = docs.select("doc_id", "text").join(F.broadcast(keys), same, "inner")
    sample = sample.select("key", "h", window.alias("text")).dropDuplicates(["key", "h"])
    sample = sorted(sample.collect(), key=lambda row: (row["h"], str(row["key"])))
    ids = [_with_end(x) for x in encode_texts(tokenizer, [row["text"] for row in sample])]
    arrays = [x[i : i + PIECE_BYTES] for x in ids for i in range(0, len(x), PIECE_BYTES)]
    total = sum(map(len, arrays))
    try:
        size = min(DICTIONARY_BYTES, total // 8)
        return zstandard.train_dictionary(size, arrays).as_bytes() if size >= 1024 else b""
    except zstandard.ZstdError:
        return b""


def _dictionary(raw: bytes) -> zstandard.ZstdCompressionDict | None:
    return zstandard.ZstdCompressionDict(raw) if raw else None


def _write_shard(batches, folder: str, tokenizer: str, dictionary: bytes) -> Iterator:
    """One task's documents as one shard. A repeated attempt writes another file; the manifest
    names the one that counts."""
    from pyspark import TaskContext

    fs, root = pafs.FileSystem.from_uri(folder)
    packer = zstandard.ZstdCompressor(level=LEVEL, dict_data=_dictionary(dictionary))
    shard = TaskContext.get().partitionId()
    name = f"shard-{shard:06d}-{uuid4().hex}"
    out, keys, nulls, places, counts, at = None, [], [], [], [], len(MAGIC) + 32
    for batch in batches:
        if not batch.num_rows:
            continue
        if out is None:
            out = fs.open_output_stream(f"{root}/{name}")
            out.write(MAGIC + hashlib.sha256(dictionary).digest())
        ids = batch.column(0)
        keys.append(ids.fill_null(0).to_numpy(zero_copy_only=False))
        nulls.append(ids.is_null().to_numpy(zero_copy_only=False))
        for raw in encode_column(tokenizer, batch.column(1)):
            frame = packer.compress(_with_end(raw))
            out.write(frame)
            places.append(at)
            counts.append(len(raw) // 4 + 1)
            at += len(frame)
    if out is None:
        return
    out.write(np.concatenate(keys).astype("<i8").tobytes())
    out.write(np.concatenate(nulls).astype("u1").tobytes())
    out.write(np.array(places, "<u8").tobytes())
    out.write(np.array(counts, "<u4").tobytes())
    out.write(struct.pack("<QQ", at, len(counts)))
    out.close()
    yield pa.RecordBatch.from_pydict(
        {
            "shard": pa.array([shard], pa.int32()),
            "path": [f"{folder}/{name}"],
            "n_docs": [len(counts)],
            "n_tokens": [int(sum(counts))],
        }
    )


def write_token_files(
    docs: DataFrame, folder: str, shards: int, tokenizer: str = WORD_LEVEL
) -> DataFrame:
    """Write the ids of ``docs`` (doc_id, text) in ascending order of doc_id. ``folder`` is a URI
    that all executors reach. Returns the manifest as stored."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    dictionary = train_dictionary(docs, tokenizer)
    uri = folder if "://" in folder else f"file://{folder.removeprefix('file:')}"
    fs, root = pafs.FileSystem.from_uri(uri)
    fs.create_dir(root, recursive=True)
    with fs.open_output_stream(f"{root}/dictionary") as out:
        out.write(dictionary)
    (
        docs.withColumn("tie", F.xxhash64("text"))
        .repartitionByRange(shards, "doc_id", "tie")
        .sortWithinPartitions("doc_id", "tie")
        .select("doc_id", "text")
        .mapInArrow(lambda batches: _write_shard(batches, uri, tokenizer, dictionary), MANIFEST)
        .write.parquet(f"{uri}/manifest")
    )
    return spark.read.schema(MANIFEST).parquet(f"{uri}/manifest")


def _open(path: str, fs=None):
    fs, at = pafs.FileSystem.from_uri(path) if fs is None else (fs, path)
    return fs.open_input_file(at)


def _index(file) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]:
    size = file.size()
    place, n = struct.unpack("<QQ", file.read_at(16, size - 16))
    raw = file.read_at(size - 16 - place, place)
    keys = np.frombuffer(raw, "<i8", n)
    nulls = np.frombuffer(raw, "u1", n, 8 * n)
    places = np.frombuffer(raw, "<u8", n, 9 * n)
    counts = np.frombuffer(raw, "<u4", n, 17 * n)
    return keys, nulls.astype(bool), places, counts, place


def _checked(file, dictionary: bytes) -> None:
    head = file.read_at(len(MAGIC) + 32, 0)
    if head != MAGIC + hashlib.sha256(dictionary).digest():
        raise ValueError("not a shard of this dictionary")


def _read_shards(batches, dictionary: bytes) -> Iterator:
    unpacker = zstandard.ZstdDecompressor(dict_data=_dictionary(dictionary))
    for batch in batches:
        for path, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            with _open(path) as file:
                _checked(file, dictionary)
                keys, nulls, places, counts, end = _index(file)
                limits = np.append(places, np.uint64(end)).astype(np.int64)
                starts = start + np.cumsum(counts, dtype=np.int64) - counts
                i = 0
                while i < len(keys):
                    j = int(np.searchsorted(limits, limits[i] + DECODE_BYTES, side="right")) - 1
                    j = min(max(j, i + 1), len(keys))
                    raw = file.read_at(int(limits[j] - limits[i]), int(limits[i]))
                    cut = limits[i : j + 1] - limits[i]
                    ids = [
                        unpacker.decompress(raw[cut[k] : cut[k + 1]], 4 * int(counts[i + k]))
                        for k in range(j - i)
                    ]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(keys[i:j], mask=nulls[i:j]),
                            pa.array(starts[i:j]),
                            pa.array(counts[i:j].astype(np.int64)),
                            pa.array(ids, pa.binary()),
                        ],
                        names=["doc_id", "start", "n_tokens", "ids"],
                    )
                    i = j


def _stored_dictionary(spark: SparkSession, folder: str) -> bytes:
    """A few kB; read by Spark, so any store it knows will do."""
    rows = spark.read.format("binaryFile").load(f"{folder}/dictionary").select("content").collect()
    return bytes(rows[0]["content"]) if rows else b""  # an empty file gives no row


def read_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """All documents of a folder with the number of ids before each (``start``) and their ids as
    little-endian unsigned 32-bit integers. The manifest has one row per shard, so its running sum
    in one task is as small as the list of files."""
    dictionary = _stored_dictionary(spark, folder)
    shards = spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")
    before = W.orderBy("shard").rowsBetween(W.unboundedPreceding, -1)
    placed = shards.select("path", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).alias("at"))
    spread = placed.repartition(max(2, int(spark.sparkContext.defaultParallelism)) * 4, "path")
    return spread.mapInArrow(lambda batches: _read_shards(batches, dictionary), DOCUMENTS)


def read_one(path: str, doc_id: int, dictionary: bytes) -> list[np.ndarray]:
    """Ids of the documents with this id in one shard: footer, index and the frames alone."""
    unpacker = zstandard.ZstdDecompressor(dict_data=_dictionary(dictionary))
    with _open(path) as file:
        _checked(file, dictionary)
        keys, nulls, places, counts, end = _index(file)
        limits = np.append(places, np.uint64(end)).astype(np.int64)
        return [
            np.frombuffer(
                unpacker.decompress(
                    file.read_at(int(limits[k + 1] - limits[k]), int(limits[k])), 4 * int(counts[k])
                ),
                "<u4",
            )
            for k in np.flatnonzero((keys == doc_id) & ~nulls)
        ]
