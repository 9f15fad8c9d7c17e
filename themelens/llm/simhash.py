"""Near-duplicates by SimHash: tiled exact comparison with numpy exclusive-or and bit counts.

Fingerprints are made in the tasks from the XXH64 of every shingle. Distinct ones are compared exactly in tiles. Two
fingerprints within 3 bits agree in at least one of their four 16-bit words, so tiles are cut by (word, value), and
pairs of tiles that share no word are never formed. Inside a word's value, fingerprints are ordered by population count,
and tiles whose counts differ by more than 3 are skipped. A value with more than ``TILE`` fingerprints is cut into
tiles by population count and hash, and the pairs of tiles become groups of their own. A tile pair hands on a spanning
forest of its links, not all pairs; components of the forests are those of the links.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from themelens.llm.common import body, chunks, row_key, select_rows, stored
from themelens.llm.components import components

#: Fixed values of the contract.
SHINGLE = 3
SEED = 42
RADIUS = 3

#: Fingerprints in a tile; rows compared at once.
TILE = 512
BLOCK = 1 << 14
#: Hashes whose bits are counted at once.
STEP = 1 << 16


def fingerprint(text: str) -> int:
    """64 bits: set where over half of the shingles' hashes have them set. 0 without words."""
    data = text.encode("utf-8", "surrogatepass").lower().split()
    if not data:
        return 0
    size = min(SHINGLE, len(data))
    ends = np.cumsum([len(w) + 1 for w in data])
    whole = b" ".join(data)
    starts = np.concatenate([[0], ends[: len(data) - size]])
    hashes = np.array(
        [xxhash.xxh64_intdigest(whole[a:b], SEED) for a, b in zip(starts.tolist(), (ends[size - 1 :] - 1).tolist(), strict=True)],
        np.uint64,
    )
    counts = np.zeros(64, np.int64)
    for k in range(0, len(hashes), STEP):
        part = hashes[k : k + STEP].astype(">u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes)).view(">u8")[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, key and fingerprint (as a signed long) of every row."""
    rows = docs.select("doc_id", row_key("doc_id", "text").alias("key"), body().alias("text"))

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            found = np.array([fingerprint(text) for text in batch.column(2).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(found)], ["doc_id", "key", "fingerprint"]
            )

    return rows.mapInArrow(make, rows.select("doc_id", "key", F.lit(0).cast("long").alias("fingerprint")).schema)


def forest(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The smallest index that each of ``n`` indexes reaches over the links a-b."""
    label = np.arange(n)
    while len(a):
        least = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, least)
        np.minimum.at(new, b, least)
        new = new[new]
        if np.array_equal(new, label):
            break
        label = new
    return label


def linked(values: np.ndarray, a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    """Links (a, b) of a spanning forest over the positions' values."""
    label = forest(a, b, len(values))
    moved = np.flatnonzero(label != np.arange(len(values)))
    out = values.view(np.int64)
    return pa.RecordBatch.from_arrays([pa.array(out[moved]), pa.array(out[label[moved]])], ["a", "b"])


def close(left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the pairs within the radius of two tiles."""
    return np.nonzero(np.bitwise_count(left[:, None] ^ right[None, :]) <= RADIUS)


def compare_sorted(group: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs within the radius of rows of one group, all groups of the block at a time. Rows are in the order of group
    and population count: row i meets row i + 1, then i + 2 and so on, until none is left whose counts are near."""
    count = np.bitwise_count(values).astype(np.int16)
    alive = np.arange(len(values))
    found: list[tuple[np.ndarray, np.ndarray]] = []
    step = 1
    while len(alive):
        alive = alive[alive + step < len(values)]
        other = alive + step
        near = (group[alive] == group[other]) & (count[other] - count[alive] <= RADIUS)
        alive, other = alive[near], other[near]
        hit = np.bitwise_count(values[alive] ^ values[other]) <= RADIUS
        found.append((alive[hit], other[hit]))
        step += 1
    return tuple(np.concatenate(x) if found else np.zeros(0, np.int64) for x in zip(*found, strict=True)) if found else (
        alive,
        alive,
    )


def links(distinct: DataFrame) -> DataFrame:
    """Links (a, b) of spanning forests over all pairs of distinct fingerprints within the radius."""
    word = "cast(shiftrightunsigned(fingerprint, 16 * w) & 65535 as int)"
    rows = distinct.select("fingerprint", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("w")).select(
        "fingerprint", F.expr(f"w * 65536 + {word}").alias("cell"), F.bit_count("fingerprint").alias("ones")
    )
    sizes = rows.groupBy("cell", "ones").agg(F.count("*").alias("n"))
    large = sizes.groupBy("cell").agg(F.sum("n").alias("total")).where(F.col("total") > TILE)
    tiles = stored(
        sizes.join(large, "cell").select("cell", "ones", F.ceil(F.col("n") / TILE).cast("int").alias("parts")), "tiles"
    )

    def compare_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def finish(cell: np.ndarray, values: np.ndarray) -> pa.RecordBatch:
            return linked(values, *compare_sorted(cell, values))

        cell, values = np.zeros(0, np.int64), np.zeros(0, np.uint64)
        for batch in batches:
            cell = np.concatenate([cell, batch.column(0).to_numpy().astype(np.int64)])
            values = np.concatenate([values, batch.column(1).to_numpy().view(np.uint64)])
            while len(cell) > BLOCK:  # up to the last cell that begins within the block; a cell has at most TILE rows
                cut = int(np.searchsorted(cell, cell[BLOCK]))
                yield finish(cell[:cut], values[:cut])
                cell, values = cell[cut:], values[cut:]
        yield finish(cell, values)

    small = (
        rows.join(large.select("cell"), "cell", "left_anti")
        .repartition("cell")
        .sortWithinPartitions("cell", "ones")
        .select("cell", "fingerprint")
        .mapInArrow(compare_cells, "a long, b long")
    )

    # Large cells: tiles by population count and hash, and the pairs of tiles whose counts are near.
    named = tiles.select("cell", "ones", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    one = named.select("cell", F.struct("ones", "part").alias("x"))
    two = named.select("cell", F.struct("ones", "part").alias("y"))
    pairs = one.join(two, "cell").where((F.col("x") <= F.col("y")) & (F.col("y.ones") - F.col("x.ones") <= RADIUS))
    sides = pairs.select("cell", "x", "y", F.explode(F.array(F.lit(0), F.lit(1))).alias("side")).where(
        (F.col("side") == 0) | (F.col("x") != F.col("y"))
    )
    sides = sides.select(
        "cell", F.xxhash64("cell", "x", "y").alias("pair"), "side", F.when(F.col("side") == 0, F.col("x")).otherwise(F.col("y")).alias("t")
    ).select("cell", F.col("t.ones").alias("ones"), F.col("t.part").alias("part"), "pair", "side")
    placed = rows.join(tiles, ["cell", "ones"]).select(
        "cell", "ones", F.pmod(F.xxhash64("fingerprint"), F.col("parts")).cast("int").alias("part"), "fingerprint"
    )

    def compare_tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def finish(parts: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
            side, values = (np.concatenate(x) for x in zip(*parts, strict=True))
            at = [np.flatnonzero(side == k) for k in (0, 1)]
            a, b = close(values[at[0]], values[at[1] if len(at[1]) else at[0]])
            return linked(values, at[0][a], (at[1] if len(at[1]) else at[0])[b])

        open_pair, parts = None, []
        for batch in batches:
            pair, side, values = (batch.column(k).to_numpy() for k in range(3))
            starts = np.flatnonzero(np.append(True, pair[1:] != pair[:-1]))
            for start, end in zip(starts, np.append(starts[1:], len(pair)), strict=True):
                if pair[start] != open_pair and parts:
                    yield finish(parts)
                    parts = []
                open_pair = pair[start]
                parts.append((side[start:end], values[start:end].view(np.uint64)))
        if parts:
            yield finish(parts)

    split = (
        placed.join(sides, ["cell", "ones", "part"])
        .repartition("pair")
        .sortWithinPartitions("pair")
        .select("pair", "side", "fingerprint")
        .mapInArrow(compare_tiles, "a long, b long")
    )
    return small.unionByName(split)


def near_duplicates(rows: DataFrame) -> DataFrame:
    """fingerprint and component (a fingerprint that names it) of every distinct fingerprint of ``rows``."""
    distinct = stored(rows.select("fingerprint").distinct(), "distinct")
    found = components(stored(links(distinct), "links"))
    return distinct.join(found.withColumnRenamed("node", "fingerprint"), "fingerprint", "left").select(
        "fingerprint", F.coalesce("component", "fingerprint").alias("component")
    )


def label(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint and component_id of every row.

    Texts without words, null ones included, have fingerprint zero. A component's id is its smallest doc_id; null only if
    all its ids are null. Repeated rows are repeated.
    """
    rows = stored(fingerprints(docs), "fingerprints")
    found = stored(near_duplicates(rows), "components")
    least = rows.groupBy("fingerprint").agg(F.min("doc_id").alias("least"))
    ids = found.join(least, "fingerprint").groupBy("component").agg(F.min("least").alias("component_id"))
    named = stored(found.join(ids, "component").select("fingerprint", "component_id"), "ids")
    return rows.join(named, "fingerprint").select(
        "doc_id", F.lpad(F.lower(F.hex("fingerprint")), 16, "0").alias("fingerprint"), "component_id"
    )


def keep_one(docs: DataFrame) -> DataFrame:
    """One document of each component, all columns: the smallest doc_id (null last), then the smallest row key."""
    rows = stored(fingerprints(docs), "fingerprints")
    order = F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("key"))
    counted = rows.groupBy("fingerprint", "doc_id", "key").agg(F.count("*").alias("copies"))
    best = counted.groupBy("fingerprint").agg(F.min(F.struct(order.alias("o"), "key", "copies")).alias("best"))
    chosen = (
        near_duplicates(rows).join(best, "fingerprint").groupBy("component").agg(F.min("best").alias("best"))
    ).select("best.key", "best.copies")
    return select_rows(docs, row_key("doc_id", "text"), chosen)
