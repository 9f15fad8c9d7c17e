"""Best-fit packing by a configuration linear program over the length histogram.

Packing needs only how many pieces have each of the at most 2048 lengths, so the program is as small for 100 TB as for a
megabyte. Its columns are configurations: lengths with copies that fit in one sequence. Multiplicative weights give the
lengths prices; a knapsack dynamic program finds, for every length, the dearest configuration that holds it. The amounts
are rounded down, and pieces that no whole configuration takes are placed by best fit. The pieces then look up their
place by rank.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from themelens.llm.common import body, chunks, stored
from themelens.llm.tokens import TOKENIZER, encoder, end_of

CAPACITY = 2048
END = 0

#: Price rounds, price step, and share of the best configuration's price that a configuration may fall short by.
ROUNDS = 120
STEP = 0.2
SHORT = 0.05

Configuration = tuple[tuple[int, int], ...]


def knapsack(lengths: np.ndarray, prices: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Highest price that fits in each capacity, and the last length taken (-1: none) to reach it."""
    best = np.zeros(capacity + 1)
    taken = np.full(capacity + 1, -1)
    for room in range(1, capacity + 1):
        fit = int(np.searchsorted(lengths, room, "right"))
        best[room] = best[room - 1]
        if fit:
            value = best[room - lengths[:fit]] + prices[:fit]
            k = int(value.argmax())
            if value[k] > best[room] + 1e-12:
                best[room], taken[room] = value[k], k
    return best, taken


def configuration(first: int, lengths: np.ndarray, taken: np.ndarray, room: int) -> Configuration:
    """Copies by index of length in the dearest configuration with one copy of ``first``."""
    copies = Counter([first])
    room -= int(lengths[first])
    while room > 0:
        if taken[room] < 0:
            room -= 1
        else:
            copies[int(taken[room])] += 1
            room -= int(lengths[taken[room]])
    return tuple(sorted(copies.items(), reverse=True))


def fractional(lengths: np.ndarray, counts: np.ndarray, capacity: int) -> dict[Configuration, float]:
    """Amounts of configurations that cover every length's count, by multiplicative weights.

    A length's price falls exponentially with how often it has been covered. Each round raises, in proportion to the
    counts, the dearest configurations by length that come near the dearest of all, until the length that gains most is
    covered once more. At the end amounts are divided by the coverage of the length covered least.
    """
    covered = np.zeros(len(lengths))
    amounts: Counter[Configuration] = Counter()
    for _ in range(ROUNDS):
        prices = lengths / capacity * np.exp(-STEP * (covered - covered.min()))
        _, taken = knapsack(lengths, prices, capacity)
        found = [configuration(k, lengths, taken, capacity) for k in range(len(lengths))]
        value = np.array([sum(prices[k] * c for k, c in x) for x in found])
        step: dict[Configuration, float] = {}
        for k in np.flatnonzero(value >= (1 - SHORT) * value.max()).tolist():
            step[found[k]] = max(step.get(found[k], 0.0), counts[k] / dict(found[k])[k])
        gain = np.zeros(len(lengths))
        for x, amount in step.items():
            for k, c in x:
                gain[k] += amount * c / counts[k]
        scale = 1 / gain.max()
        for x, amount in step.items():
            amounts[x] += amount * scale
        covered += gain * scale
    least = max(covered.min(), 1.0)
    return {x: amount / least for x, amount in amounts.items()}


def best_fit(lengths: np.ndarray, counts: np.ndarray, capacity: int) -> Counter[Configuration]:
    """Longest first, each into the open sequences with the least sufficient room; equal sequences are counted."""
    open_: dict[int, Counter[Configuration]] = {}
    for k in np.argsort(-lengths, kind="stable").tolist():
        size, n = int(lengths[k]), int(counts[k])
        while n:
            room = min((r for r in open_ if r >= size), default=None)
            if room is None:
                each = min(capacity // size, n)
                times, n = n // each, n % each
                open_.setdefault(capacity - each * size, Counter())[((k, each),)] += times
                continue
            held, times = open_[room].popitem()
            each = min(room // size, n)
            used = min(times, n // each)
            if times > used:
                open_[room][held] = times - used
            if not open_[room]:
                del open_[room]
            open_.setdefault(room - each * size, Counter())[(*held, (k, each))] += used
            n -= each * used
    total: Counter[Configuration] = Counter()
    for some in open_.values():
        total.update(some)
    return total


def solve(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[Configuration, int]]:
    """(configuration as (length, copies), times): together exactly the pieces of the histogram."""
    if not histogram:
        return []
    lengths = np.array(sorted(histogram), np.int64)
    left = np.array([histogram[k] for k in lengths.tolist()], np.int64)
    whole: Counter[Configuration] = Counter()
    for found, amount in sorted(fractional(lengths, left, capacity).items(), key=lambda x: (-x[1], x[0])):
        times = min([int(amount), *(int(left[k]) // c for k, c in found)])
        if times:
            whole[found] += times
            for k, c in found:
                left[k] -= times * c
    whole.update(best_fit(lengths, left, capacity))
    # Rounding can cost more than the program gains where few pieces have many lengths.
    plain = best_fit(lengths, np.array([histogram[k] for k in lengths.tolist()], np.int64), capacity)
    whole = min(whole, plain, key=Counter.total)
    named: Counter[Configuration] = Counter()
    for found, times in whole.items():
        named[tuple((int(lengths[k]), c) for k, c in found)] += times
    return sorted(named.items())


@dataclass(frozen=True)
class Places:
    """Where the pieces of each length go, by rank: for each run of ranks its first (length, rank), sequence, copies in a
    sequence and offset of the first copy."""

    key: np.ndarray
    sequence: np.ndarray
    copies: np.ndarray
    offset: np.ndarray

    @classmethod
    def of(cls, plan: list[tuple[Configuration, int]]) -> Places:
        ranks: Counter[int] = Counter()
        rows, sequence = [], 0
        for found, times in plan:
            offset = 0
            for length, copies in found:
                rows.append(((length << 48) | ranks[length], sequence, copies, offset))
                ranks[length] += copies * times
                offset += length * copies
            sequence += times
        columns = np.array(sorted(rows), np.int64).reshape(-1, 4).T
        return cls(*columns)

    def find(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """sequence_id and offset of pieces."""
        key = (length << 48) | rank
        at = np.searchsorted(self.key, key, "right") - 1
        nth = key - self.key[at]
        return self.sequence[at] + nth // self.copies[at], self.offset[at] + nth % self.copies[at] * length


def pieces(docs: DataFrame, tokenizer: str = TOKENIZER, end: int = END, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32; part and nth number the pieces of a length within a task."""
    rows = docs.select("doc_id", body().alias("text"))
    schema = StructType(
        [
            docs.schema["doc_id"],
            StructField("piece", IntegerType()),
            *(StructField(name, LongType()) for name in ("start", "length", "ids_crc32", "part", "nth")),
        ]
    )
    stop = end_of(end)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, own = TaskContext.get().partitionId(), encoder(tokenizer)
        seen: Counter[int] = Counter()
        for batch in chunks(batches, rows=256, size=1 << 20):
            source, rows_ = [], []
            for row, data in enumerate(own.encode(batch.column(1).to_pylist())):
                data = memoryview(data + stop)
                n = len(data) // 4
                first = (n - 1) % capacity + 1  # only the first piece may be shorter
                bounds = [0, *range(first, n + 1, capacity)]
                for piece, (a, b) in enumerate(zip(bounds, bounds[1:], strict=False)):
                    source.append(row)
                    rows_.append((piece, a, b - a, zlib.crc32(data[4 * a : 4 * b]), part, seen[b - a]))
                    seen[b - a] += 1
            columns = np.array(rows_, np.int64).T
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(source)), pa.array(columns[0].astype(np.int32)), *map(pa.array, columns[1:])],
                schema.names,
            )

    return rows.mapInArrow(cut, schema)


def pack(docs: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id and offset of every piece.

    Null and empty texts are the end id alone, a piece of length 1. Repeated rows are packed each. No rows, no pieces.
    """
    cut = stored(pieces(docs, capacity=capacity), "pieces")
    # Rank of a piece among those of its length: pieces in tasks before its own, and those before it in its task.
    counts = cut.groupBy("part", "length").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    histogram = {row["length"]: row["n"] for row in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}
    places = docs.sparkSession.sparkContext.broadcast(Places.of(solve(histogram, capacity)))
    ranked = cut.join(bases, ["part", "length"]).select(
        "doc_id", "piece", "start", "length", "ids_crc32", (F.col("base") + F.col("nth")).alias("rank")
    )
    schema = StructType([*ranked.drop("rank").schema, StructField("sequence_id", LongType()), StructField("offset", LongType())])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sequence, offset = places.value.find(batch.column(3).to_numpy(), batch.column(5).to_numpy())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:5], pa.array(sequence), pa.array(offset)], schema.names
            )

    return ranked.mapInArrow(place, schema)
