"""Repeated byte strings by suffix arrays of the difference-cover kind, distributed over shards.

``repeats`` sends all places where a string could repeat to one shard. A shard builds the suffix array of its snippets:
it sorts the triples at places not divisible by three, names them, recurses on the names until they are distinct, merges
the remaining suffixes by rank, and compares the 200-byte prefixes of neighbours.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from themelens.llm.common import chunks
from themelens.llm.repeats import HOT, Pieces, Units, covered, cut_at, with_spans

#: Fixed value of the contract.
WINDOW = 200
GRAM = 48

_CODES = np.random.default_rng(8).integers(1, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)

#: Rows of neighbours compared at once; bytes hashed at once.
ROWS = 1 << 14
BYTES_AT_ONCE = 1 << 20


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Places of the suffixes of ``text`` (values of 1 and more, fewer than 2**21 of them) in ascending order."""
    n = len(text)
    if n < 3:
        return np.array(sorted(range(n), key=lambda i: text[i:].tolist()), np.int64)
    s = np.concatenate([text.astype(np.int64), np.zeros(3, np.int64)])
    width = int(s.max()) + 1
    # Sample: places 1 and 2 modulo 3; one more if n is 1 modulo 3, so that every place divisible by 3 has a successor.
    ones, twos = np.arange(1, n + (n % 3 == 1), 3), np.arange(2, n, 3)
    sample = np.concatenate([ones, twos])
    triples = (s[sample] * width + s[sample + 1]) * width + s[sample + 2]
    distinct, names = np.unique(triples, return_inverse=True)
    if len(distinct) == len(sample):
        order = np.argsort(names)
    else:
        order = suffix_array(names + 1)
    rank = np.zeros(n + 3, np.int64)
    rank[sample[order]] = np.arange(1, len(sample) + 1)
    sample = sample[order]
    sample = sample[sample < n]
    # The rest: places 0 modulo 3, by their value and the rank that follows.
    span = len(rank) + 1
    rest = np.arange(0, n, 3)
    by_one = s[rest] * span + rank[rest + 1]
    turn = np.argsort(by_one, kind="stable")
    rest, by_one = rest[turn], by_one[turn]
    by_two = (s[rest] * width + s[rest + 1]) * span + rank[rest + 2]
    one, two = sample[sample % 3 == 1], sample[sample % 3 == 2]
    before = np.searchsorted(s[one] * span + rank[one + 1], by_one)
    before += np.searchsorted((s[two] * width + s[two + 1]) * span + rank[two + 2], by_two)
    place = before + np.arange(len(rest))
    out = np.full(n, -1, np.int64)
    out[place] = rest
    out[out < 0] = sample
    return out


class Bytes(Units):
    window, gram = WINDOW, GRAM

    def pieces(self, batch: pa.BinaryArray) -> Iterator[Pieces]:
        offsets = np.frombuffer(batch.buffers()[1], np.int32)[batch.offset : batch.offset + len(batch) + 1].astype(np.int64)
        data = np.frombuffer(batch.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
        if len(data) <= BYTES_AT_ONCE:
            yield Raw(data, offsets[:-1] - offsets[0], np.arange(len(batch)), np.zeros(len(batch), np.int64))
            return
        for row, (a, b) in enumerate(zip(offsets[:-1] - offsets[0], offsets[1:] - offsets[0], strict=True)):
            for start, end in cut_at(data[a:b], WINDOW):
                yield Raw(data[a + start : a + end], np.zeros(1, np.int64), np.array([row]), np.array([start]))

    def content(self, pieces: Pieces, start: int, end: int) -> bytes:
        return pieces.data[start:end].tobytes()

    def repeated(self, snippets: list[bytes], weights: list[int]) -> Iterable[np.ndarray]:
        data = np.frombuffer(b"".join(snippets), np.uint8)
        lengths = np.array([len(x) for x in snippets])
        ends = np.cumsum(lengths)
        owner = np.repeat(np.arange(len(snippets)), lengths)
        order = suffix_array(data.astype(np.int64) + 1)
        order = order[order + WINDOW <= ends[owner[order]]]  # suffixes that begin a window
        view = np.lib.stride_tricks.sliding_window_view(data, WINDOW)
        same = np.zeros(len(order), bool)
        for k in range(1, len(order), ROWS):
            part = order[k - 1 : k + ROWS]
            same[k : k + len(part) - 1] = (view[part[1:]] == view[part[:-1]]).all(axis=1)
        group = np.cumsum(~same) - 1
        times = np.bincount(group, np.array(weights)[owner[order]])
        flags = np.zeros(len(data), bool)
        flags[order] = times[group] > 1
        return [flags[end - n : end - WINDOW + 1] for end, n in zip(ends.tolist(), lengths.tolist(), strict=True)]


class Raw(Pieces):
    def __init__(self, data: np.ndarray, starts: np.ndarray, rows: np.ndarray, offsets: np.ndarray):
        keep = np.append(starts[1:], len(data)) > starts  # empty texts have no place of their own
        super().__init__(_CODES[data], starts[keep], rows[keep], offsets[keep])
        self.data = data


def remove_repeats(docs: DataFrame, hot: int = HOT) -> DataFrame:
    """doc_id, n_bytes, removed (maximal runs of removed bytes) and kept (the remaining bytes) of every row.

    A null text has no bytes. Texts shorter than the window stay. Equal rows repeat each other and lose all windows.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            kept, removed, size = [], [], []
            for text, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                runs = covered(spans, WINDOW)
                edges = [0, *(x for run in runs for x in run), len(text)]
                kept.append(b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)))
                removed.append([{"start": a, "end": b} for a, b in runs])
                size.append(len(text))
            run = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(size, pa.int64()), pa.array(removed, run), pa.array(kept, pa.binary())],
                ["doc_id", "n_bytes", "removed", "kept"],
            )

    rows = with_spans(docs, Bytes(), hot)
    schema = rows.select(
        "doc_id",
        F.lit(0).cast("long").alias("n_bytes"),
        F.lit(None).cast("array<struct<start:long,end:long>>").alias("removed"),
        F.col("text").alias("kept"),
    ).schema
    return rows.mapInArrow(cut, schema)


def report(docs: DataFrame, hot: int = HOT) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256."""
    total = F.aggregate("removed", F.lit(0).cast("long"), lambda n, run: n + run["end"] - run["start"])
    return remove_repeats(docs, hot).select(
        "doc_id",
        "n_bytes",
        total.alias("n_removed"),
        F.size("removed").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )
