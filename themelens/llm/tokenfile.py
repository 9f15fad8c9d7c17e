"""Token ids in patched frame-of-reference blocks.

A file is a Parquet table that Spark writes, so it works on any store and a lost task leaves nothing behind. Each row is
a segment: whole documents in order, their lengths, and one packed payload:

    magic "PFR1" | ids | blocks | exceptions          4 x uint32
    minimum of each block                             uint32
    width of each block                               uint8
    start of each block in the packed words           uint32 (the index: any block is read alone)
    start of each block's exceptions, and their end   uint32
    exceptions: place in the block, value             uint8, uint32
    packed words                                      uint64

A width's block is two lanes of 64 values; value ``j`` of a lane lies at bit ``j * width`` of its ``width`` words.

A block holds 128 ids less their minimum, in the width that ``FITTING`` of 128 fit in; the others are exceptions.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructField, StructType, BinaryType

from themelens.llm.common import body, broadcast_if_small, chunks, stored
from themelens.llm.tokens import TOKENIZER, encoder, end_of

BLOCK = 128
FITTING = 115  # nine tenths
MAGIC = 0x31524650
END = 2

#: A segment is closed once it has this many ids; a longer document is a segment alone.
SEGMENT = 1 << 18


def _packed(values: np.ndarray, width: int) -> np.ndarray:
    """Words (blocks x 2 * width) of blocks of values, in two lanes that are shifted together for all blocks."""
    blocks = len(values)
    mask = np.uint64((1 << width) - 1)
    lanes = np.ascontiguousarray((values.astype(np.uint64) & mask).reshape(2 * blocks, 64).T)
    words = np.zeros((width, 2 * blocks), np.uint64)
    for j, lane in enumerate(lanes):
        word, shift = divmod(j * width, 64)
        words[word] |= lane << np.uint64(shift)
        if shift + width > 64:
            words[word + 1] |= lane >> np.uint64(64 - shift)
    return np.ascontiguousarray(words.T).reshape(blocks, 2 * width)


def _unpacked(words: np.ndarray, width: int) -> np.ndarray:
    """Blocks of values from their words."""
    blocks = len(words)
    words = np.ascontiguousarray(words.reshape(2 * blocks, width).T)
    lanes = np.empty((64, 2 * blocks), np.uint32)
    mask = np.uint64((1 << width) - 1)
    for j in range(64):
        word, shift = divmod(j * width, 64)
        value = words[word] >> np.uint64(shift)
        if shift + width > 64:
            value |= words[word + 1] << np.uint64(64 - shift)
        lanes[j] = value & mask
    return np.ascontiguousarray(lanes.T).reshape(blocks, BLOCK)


def pack(ids: np.ndarray) -> bytes:
    """Blocks of a sequence of unsigned 32-bit ids."""
    n, blocks = len(ids), -(-len(ids) // BLOCK)
    padded = np.concatenate([ids, np.repeat(ids[-1:], blocks * BLOCK - n)]).astype(np.uint32).reshape(blocks, BLOCK)
    least = padded.min(axis=1)
    rest = padded - least[:, None]
    fitting = np.partition(rest, FITTING - 1, axis=1)[:, FITTING - 1]
    width = np.frexp(fitting.astype(np.float64))[1].astype(np.uint8)
    most = ((np.uint64(1) << width.astype(np.uint64)) - np.uint64(1)).astype(np.uint32)
    block, place = np.divmod(np.flatnonzero(rest > most[:, None]), BLOCK)
    exceptions = np.concatenate([[0], np.cumsum(np.bincount(block, minlength=blocks))])
    start = np.concatenate([[0], np.cumsum(width.astype(np.int64) * (BLOCK // 64))])
    packed = np.zeros(int(start[-1]), "<u8")
    for w in np.unique(width[width > 0]).tolist():
        own = np.flatnonzero(width == w)
        packed[start[own][:, None] + np.arange(w * BLOCK // 64)] = _packed(rest[own], w)
    return b"".join(
        x.tobytes()
        for x in (
            np.array([MAGIC, n, blocks, len(block)], "<u4"),
            least.astype("<u4"),
            width,
            start[:-1].astype("<u4"),
            exceptions.astype("<u4"),
            place.astype(np.uint8),
            rest[block, place].astype("<u4"),
            packed,
        )
    )


def unpack(data: bytes, first: int = 0, end: int | None = None) -> np.ndarray:
    """The ids from place ``first`` up to ``end``; only the blocks that hold them are unpacked."""
    magic, n, blocks, many = (int(x) for x in np.frombuffer(data, "<u4", 4))
    if magic != MAGIC:
        raise ValueError("not a packed sequence of ids")
    at = 16
    parts = []
    for kind, count in (("<u4", blocks), ("u1", blocks), ("<u4", blocks), ("<u4", blocks + 1), ("u1", many), ("<u4", many)):
        parts.append(np.frombuffer(data, kind, count, at))
        at += parts[-1].nbytes
    least, width, start, exceptions, place, value = parts
    packed = np.frombuffer(data, "<u8", (len(data) - at) // 8, at)
    end = n if end is None else min(end, n)
    a, b = first // BLOCK, -(-end // BLOCK)
    if first >= end:
        return np.zeros(0, np.uint32)
    out = np.zeros((b - a, BLOCK), np.uint32)
    for w in np.unique(width[a:b]).tolist():
        if w:
            own = np.flatnonzero(width[a:b] == w)
            raw = packed[start[a:b][own].astype(np.int64)[:, None] + np.arange(w * BLOCK // 64)]
            out[own] = _unpacked(raw, w)
    kept = slice(int(exceptions[a]), int(exceptions[b]))
    out[np.repeat(np.arange(b - a), np.diff(exceptions[a : b + 1].astype(np.int64))), place[kept]] = value[kept]
    out += least[a:b, None]
    return out.reshape(-1)[first - a * BLOCK : end - a * BLOCK]


def segments(docs: DataFrame, tokenizer: str = TOKENIZER, end: int = END) -> DataFrame:
    """shard, segment, start (ids of the shard before it), doc_ids, lengths and payload, in ascending doc_id order.

    Null ids come first. Rows of one id are in the order of their texts' hash, which also spreads an id that many rows
    share. A null or empty text is the end id alone.
    """
    ordered = (
        docs.select("doc_id", body().alias("text"))
        .withColumn("tie", F.xxhash64("text"))
        .repartitionByRange("doc_id", "tie")
        .sortWithinPartitions("doc_id", "tie")
        .select("doc_id", "text")
    )
    id_type = docs.schema["doc_id"].dataType
    schema = StructType(
        [
            StructField("shard", IntegerType()),
            StructField("segment", IntegerType()),
            StructField("start", LongType()),
            StructField("doc_ids", ArrayType(id_type)),
            StructField("lengths", ArrayType(IntegerType())),
            StructField("payload", BinaryType()),
        ]
    )
    stop = end_of(end)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, own = TaskContext.get().partitionId(), encoder(tokenizer)
        segment, start = 0, 0
        ids: list[pa.Array] = []
        encoded: list[bytes] = []

        def close() -> pa.RecordBatch:
            lengths = [len(x) // 4 for x in encoded]
            columns = [
                pa.array([shard], pa.int32()),
                pa.array([segment], pa.int32()),
                pa.array([start], pa.int64()),
                pa.ListArray.from_arrays(pa.array([0, len(lengths)], pa.int32()), pa.concat_arrays(ids)),
                pa.array([lengths], pa.list_(pa.int32())),
                pa.array([pack(np.frombuffer(b"".join(encoded), "<u4"))], pa.binary()),
            ]
            return pa.RecordBatch.from_arrays(columns, schema.names)

        for batch in chunks(batches, rows=256, size=1 << 20):
            encoded += [x + stop for x in own.encode(batch.column(1).to_pylist())]
            ids.append(batch.column(0))
            size = sum(map(len, encoded)) // 4
            if size >= SEGMENT:
                yield close()
                segment, start, ids, encoded = segment + 1, start + size, [], []
        if encoded:
            yield close()

    return ordered.mapInArrow(write, schema)


def documents_of(file: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, from a table of segments that was read back."""
    totals = file.groupBy("shard").agg(F.sum(F.aggregate("lengths", F.lit(0).cast("long"), lambda s, x: s + x)).alias("n"))
    # One row a shard.
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    bases = stored(totals.select("shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base")), "bases")
    id_type = file.schema["doc_ids"].dataType.elementType
    schema = StructType(
        [
            StructField("doc_id", id_type),
            StructField("start", LongType()),
            StructField("n_tokens", LongType()),
            StructField("ids_crc32", LongType()),
        ]
    )

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, rows=8):
            for row in range(batch.num_rows):
                base, start, doc_ids, lengths, payload = (batch.column(k)[row] for k in range(5))
                lengths = lengths.values.to_numpy(zero_copy_only=False).astype(np.int64)
                ends = np.cumsum(lengths)
                data = memoryview(unpack(payload.as_py()).astype("<u4").tobytes())
                crc = [zlib.crc32(data[4 * (b - n) : 4 * b]) for b, n in zip(ends.tolist(), lengths.tolist(), strict=True)]
                columns = [
                    doc_ids.values,
                    pa.array(base.as_py() + start.as_py() + ends - lengths),
                    pa.array(lengths),
                    pa.array(crc, pa.int64()),
                ]
                yield pa.RecordBatch.from_arrays(columns, schema.names)

    rows = file.join(broadcast_if_small(bases), "shard").select("base", "start", "doc_ids", "lengths", "payload")
    return rows.mapInArrow(read, schema)


def write_and_read(docs: DataFrame) -> DataFrame:
    """Documents' digests from the written and reread file. An empty table gives a file without segments."""
    return documents_of(stored(segments(docs), "token_file"))
