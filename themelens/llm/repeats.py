"""Finding windows of units (bytes or words) that start at least twice anywhere: what both substring operators share.

Every window names one of its grams, the one with the least hash (rightmost of equals), as its anchor. Equal windows have
equal anchors at equal distance, so they only need to be looked for among windows of the same anchor gram, and each window
is looked for once. The windows of a document with one anchor are consecutive: a snippet, named by the gram's hash and a
128-bit hash of its content. Grams' hashes only bring together what may be equal: two grams of one hash share a shard.

1. All documents' (gram, snippet) hashes are counted. Grams that occur once are done: none of their windows repeats.
2. Grams whose snippets are all equal are done too: all of their windows repeat.
3. The different snippets of other grams are shipped with their numbers, all of a gram to one shard, and resolved there
   exactly (suffix array or automaton). A gram with more than ``HOT`` different snippets would make a large shard: each of
   its windows names a second, longer gram, by another order of hashes, and the snippets' parts that share both go on to a
   shard of their own. Equal windows name equal grams every time, so they stay together; grams grow half-way to the whole
   window each time, so that after a few times only equal windows are left together.

Counting combines before it shuffles; texts travel only for the last step of a document, with its spans.
"""

from __future__ import annotations

from abc import ABC, abstractmethod
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from themelens.llm.common import Bitmap, body, chunks, row_key, stored

#: Different snippets of a gram above which they are parted by a second gram (1.8 MB of bytes at most below).
HOT = 5000
#: Units handled at once, and the bytes of a batch of texts.
STEP = 1 << 19
BATCH = 1 << 19

_BASE = 0x9E3779B97F4A7C15
_PLACE = np.uint64((1 << 21) - 1)


def _powers(base: int) -> np.ndarray:
    return np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full((1 << 21) - 1, base, np.uint64))])


_POWER = _powers(_BASE)
_INVERSE = _powers(pow(_BASE, -1, 1 << 64))


def mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def sums(codes: np.ndarray) -> np.ndarray:
    return np.concatenate([np.zeros(1, np.uint64), np.cumsum(codes * _POWER[: len(codes)])])


def hashes(total: np.ndarray, start: np.ndarray | slice, end: np.ndarray | slice) -> np.ndarray:
    """Hashes of units from start to end, places apart, of the sequence that ``total`` are the sums of."""
    return mixed((total[end] - total[start]) * _INVERSE[: len(total)][start])


def sliding_least(values: np.ndarray, size: int) -> np.ndarray:
    """Least of each ``size`` neighbours, from prefix and suffix minima of blocks."""
    n = len(values)
    padded = np.concatenate([values, np.full(-n % size, ~np.uint64(0))]).reshape(-1, size)
    prefix = np.minimum.accumulate(padded, axis=1).reshape(-1)
    suffix = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(suffix[: n - size + 1], prefix[size - 1 : n])


class Pieces:
    """Units of several texts behind each other: codes, and first place and row of each text (or part of one)."""

    def __init__(self, codes: np.ndarray, starts: np.ndarray, rows: np.ndarray, offsets: np.ndarray):
        self.codes, self.starts, self.rows, self.offsets = codes, starts, rows, offsets

    def snippets(self, window: int, gram: int, seed: int = 0) -> tuple[np.ndarray, ...]:
        """(piece, start in the pieces, number of windows, gram hash) of every anchor; ``seed`` chooses the hash's order."""
        n = len(self.codes)
        if n < window:
            return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),)
        total = sums(self.codes)
        grams = hashes(total, slice(0, n - gram + 1), slice(gram, n + 1))
        if seed:
            grams = mixed(grams ^ mixed(np.full(1, seed, np.uint64)))
        places = _PLACE - np.arange(len(grams), dtype=np.uint64)
        least = sliding_least((grams & ~_PLACE) | places, window - gram + 1)
        anchor = (_PLACE - (least & _PLACE)).astype(np.int64)
        ends = np.append(self.starts[1:], n)
        valid = np.zeros(len(anchor) + 1, np.int64)
        long = ends - self.starts >= window
        np.add.at(valid, self.starts[long], 1)
        np.add.at(valid, ends[long] - window + 1, -1)
        inside = np.cumsum(valid[:-1]) > 0
        # A text's windows never touch the next text's: at least window - 1 places lie between.
        change = np.append(True, (anchor[1:] != anchor[:-1]) | (inside[1:] != inside[:-1]))
        first = np.flatnonzero(change)
        count = np.diff(np.append(first, len(anchor)))
        first, count = first[inside[first]], count[inside[first]]
        piece = np.searchsorted(self.starts, first, "right") - 1
        return piece, first, count, grams[anchor[first]]


class Units(ABC):
    """What a window is made of."""

    window: int
    gram: int

    @abstractmethod
    def pieces(self, batch: pa.BinaryArray) -> Iterator[Pieces]:
        """All units of the texts, cut so that a window lies in exactly one piece."""

    @abstractmethod
    def content(self, pieces: Pieces, start: int, end: int) -> bytes:
        """The units between two places of a piece, as bytes that are equal if and only if the units are."""

    @abstractmethod
    def repeated(self, snippets: list[bytes], weights: list[int]) -> Iterable[np.ndarray]:
        """For each distinct snippet: which of its windows occur twice or more; weights are the snippets' occurrences."""


def cut_at(codes: np.ndarray, window: int) -> Iterator[tuple[int, int]]:
    """Bounds of parts of a long text that together hold each window once."""
    for start in range(0, max(len(codes) - window + 1, 0), STEP):
        yield start, min(start + STEP + window - 1, len(codes))


def _snippets(units: Units, batch: pa.RecordBatch, seed: int = 0) -> Iterator[tuple]:
    """(pieces, row, place in the row, windows, start, end, gram, name) by piece array: columns as arrays, the name in two
    halves."""
    for pieces in units.pieces(batch.column(batch.num_columns - 1)):
        piece, first, count, gram = pieces.snippets(units.window, units.window - (units.window - units.gram >> seed), seed)
        ends = first + count + units.window - 1
        named = [xxhash.xxh3_128_digest(units.content(pieces, a, b)) for a, b in zip(first.tolist(), ends.tolist(), strict=True)]
        names = np.frombuffer(b"".join(named), np.int64).reshape(-1, 2)
        place = first - pieces.starts[piece] + pieces.offsets[piece]
        yield pieces, pieces.rows[piece], place, count, first, ends, gram.view(np.int64), names


def halves(names: np.ndarray) -> tuple[pa.Array, pa.Array]:
    return pa.array(names[:, 0].copy()), pa.array(names[:, 1].copy())


def _runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the runs of true values."""
    edges = np.diff(np.concatenate([[0], flags.astype(np.int8), [0]]))
    starts = np.flatnonzero(edges == 1)
    return starts, np.flatnonzero(edges == -1) - starts


def repeated_windows(docs: DataFrame, units: Units, hot: int = HOT) -> DataFrame:
    """key (of doc_id and text) and spans (start, n: windows that begin at n consecutive units) of the rows with any."""
    texts = docs.select(row_key("doc_id", "text").alias("key"), body().cast("binary").alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, size=BATCH):
            for *_, gram, names in _snippets(units, batch):
                yield pa.RecordBatch.from_arrays([pa.array(gram), *halves(names)], ["gram", "a", "b"])

    counted = (
        texts.select("text")
        .mapInArrow(count, "gram long, a long, b long")
        .groupBy("gram")
        .agg(F.count("*").alias("n"), *(end(name).alias(f"{end.__name__}_{name}") for end in (F.min, F.max) for name in "ab"))
        .where("n > 1")
        .select("gram", "n", ((F.col("min_a") == F.col("max_a")) & (F.col("min_b") == F.col("max_b"))).alias("same"))
    )
    grams = stored(counted, "grams")
    repeated = Bitmap(grams, "gram")
    shipped = Bitmap(grams.where("not same"), "gram")

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, size=BATCH):
            for pieces, row, place, number, first, ends, gram, names in _snippets(units, batch):
                at = np.flatnonzero(repeated.holds(gram))
                ships = shipped.holds(gram[at])
                content = [
                    units.content(pieces, a, b) if ship else None
                    for a, b, ship in zip(first[at].tolist(), ends[at].tolist(), ships.tolist(), strict=True)
                ]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(pa.array(row[at])),
                        pa.array(place[at]),
                        pa.array(number[at].astype(np.int32)),
                        pa.array(gram[at]),
                        *halves(names[at]),
                        pa.array(content, pa.binary()),
                    ],
                    ["key", "start", "n", "gram", "a", "b", "content"],
                )

    found = stored(
        texts.mapInArrow(emit, "key string, start long, n int, gram long, a long, b long, content binary"), "snippets"
    )
    status = grams.select("gram", "same")
    # Equal snippets are one, with a weight, before they meet their gram: copies of a passage do not make a gram large,
    # different contexts do. Without content are grams of one snippet (all windows repeat) and what a bitmap let through.
    distinct = stored(found.groupBy("gram", "a", "b", "n", "content").agg(F.count("*").alias("weight")), "distinct")
    alone = distinct.where("content is null and weight > 1").select(
        "gram", "a", "b", F.array(F.struct(F.lit(0).alias("start"), "n")).alias("spans")
    )
    known = alone.unionByName(resolved(distinct.where("content is not null").drop("n"), units, hot))
    parts = (
        found.select("key", F.col("start").alias("first"), "gram", "a", "b")
        .join(known, ["gram", "a", "b"])
        .select("key", "first", F.explode("spans").alias("span"))
        .select("key", (F.col("first") + F.col("span.start")).alias("start"), F.col("span.n").alias("n"))
    )
    # Equal rows have one key; each start counts once.
    return (
        parts.groupBy("key", "start")
        .agg(F.max("n").alias("n"))
        .groupBy("key")
        .agg(F.sort_array(F.collect_list(F.struct("start", "n"))).alias("spans"))
    )


def resolved(distinct: DataFrame, units: Units, hot: int, seed: int = 1) -> DataFrame:
    """gram, a, b and spans (runs of windows that occur twice or more) of different snippets with weights; ``distinct`` is
    stored. Grams of more than ``hot`` snippets are parted by a second gram of each window, and so on."""
    result = "gram long, a long, b long, spans array<struct<start:int,n:int>>"

    def resolve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come by gram; whole grams are resolved together, about STEP bytes at a time."""
        span = pa.list_(pa.struct([("start", pa.int32()), ("n", pa.int32())]))

        def shard(rows: list[tuple]) -> pa.RecordBatch:
            flags = units.repeated([row[4] for row in rows], [row[3] for row in rows])
            spans = [
                [{"start": a, "n": n} for a, n in zip(*(x.tolist() for x in _runs(own)), strict=True)] for own in flags
            ]
            return pa.RecordBatch.from_arrays(
                [*(pa.array([row[k] for row in rows], pa.int64()) for k in range(3)), pa.array(spans, span)],
                ["gram", "a", "b", "spans"],
            )

        rows: list[tuple] = []
        size = 0
        for batch in chunks(batches, rows=4096, size=STEP):
            for row in zip(*(column.to_pylist() for column in batch.columns), strict=True):
                if size > STEP and row[0] != rows[-1][0]:
                    yield shard(rows)
                    rows, size = [], 0
                rows.append(row)
                size += len(row[4])
        if rows:
            yield shard(rows)

    ordered = distinct.select("gram", "a", "b", "weight", "content")
    large = stored(distinct.groupBy("gram").agg(F.count("*").alias("many")).where(F.col("many") > hot).select("gram"), "large")
    small = (
        ordered.join(large, "gram", "left_anti")
        .repartition("gram")
        .sortWithinPartitions("gram")
        .mapInArrow(resolve, result)
        .where(F.size("spans") > 0)
    )
    if large.isEmpty():
        return small

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, size=BATCH):
            for pieces, row, place, _, first, ends, second, names in _snippets(units, batch, seed):
                content = [units.content(pieces, a, b) for a, b in zip(first.tolist(), ends.tolist(), strict=True)]
                taken = [batch.column(k).take(pa.array(row)) for k in range(4)]
                below = mixed(taken[0].to_numpy().view(np.uint64) ^ mixed(second.view(np.uint64) + np.uint64(seed)))
                yield pa.RecordBatch.from_arrays(
                    [*taken, pa.array(place.astype(np.int32)), pa.array(below.view(np.int64)), *halves(names), pa.array(content, pa.binary())],
                    ["gram", "a", "b", "weight", "first", "below", "c", "d", "content"],
                )

    columns = "gram long, a long, b long, weight long, first int, below long, c long, d long, content binary"
    parted = stored(ordered.join(large, "gram", "left_semi").mapInArrow(part, columns), "parted")
    inner = parted.groupBy(F.col("below").alias("gram"), F.col("c").alias("a"), F.col("d").alias("b"), "content")
    found = resolved(stored(inner.agg(F.sum("weight").alias("weight")), "inner"), units, hot, seed + 1)
    found = found.select(F.col("gram").alias("below"), F.col("a").alias("c"), F.col("b").alias("d"), "spans")
    # The windows of a snippet are few; its parts' runs are put behind each other.
    shifted = F.transform("spans", lambda x: F.struct((x["start"] + F.col("first")).alias("start"), x["n"].alias("n")))
    above = parted.drop("content").join(found, ["below", "c", "d"]).select("gram", "a", "b", shifted.alias("spans"))
    above = above.groupBy("gram", "a", "b").agg(F.sort_array(F.flatten(F.collect_list("spans"))).alias("spans"))
    return small.unionByName(above)


def covered(spans: list[dict] | None, window: int) -> list[tuple[int, int]]:
    """Maximal runs of units inside windows that begin in the spans."""
    runs: list[list[int]] = []
    for span in spans or ():
        start, end = span["start"], span["start"] + span["n"] - 1 + window
        if runs and start <= runs[-1][1]:
            runs[-1][1] = max(end, runs[-1][1])
        else:
            runs.append([start, end])
    return [(a, b) for a, b in runs]


def with_spans(docs: DataFrame, units: Units, hot: int = HOT) -> DataFrame:
    """doc_id, text (binary) and spans of every row."""
    rows = docs.select("doc_id", row_key("doc_id", "text").alias("key"), body().cast("binary").alias("text"))
    return rows.join(repeated_windows(docs, units, hot), "key", "left").select("doc_id", "text", "spans")
