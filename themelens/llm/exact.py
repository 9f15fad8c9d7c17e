"""Exact duplicates by counting quotient filters and byte verification.

Each task builds counting quotient filters of its documents' 64-bit fingerprints, one for each range of fingerprints.
Filters of a range merge without loss, since their runs are sorted by remainder and remainders are kept whole. Copies of
one text are one entry with a counter in each task, so a text that a third of all rows share is no hot key. Fingerprints
counted more than once route their documents to byte verification: grouping by the normalised text itself.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from themelens.llm.common import SPACE, Bitmap, body, broadcast_if_small, row_key, select_rows, stored


class CountingQuotientFilter:
    """Fingerprints of ``bits`` bits with counts, as runs of sorted remainders.

    The upper ``q`` bits of a fingerprint choose a run, marked in ``occupied``; the last slot of a run is marked in
    ``run_end``. A slot holds a remainder, or, marked in ``counter``, a digit (least first) of the count of the remainder
    before it, less one. Runs follow each other without gaps, and no bit of a fingerprint is given up.
    """

    def __init__(self, bits: int, fingerprints: np.ndarray, counts: np.ndarray):
        """``fingerprints`` ascending and distinct, uint64."""
        self.bits = bits
        self.q = min(max(int(len(fingerprints) * 4 // 3).bit_length(), 1), bits - 1)
        self.r = bits - self.q
        shift = np.uint64(self.r)
        quotient = (fingerprints >> shift).astype(np.int64)
        remainder = fingerprints & ((np.uint64(1) << shift) - np.uint64(1))
        extra = (counts - 1).astype(np.uint64)
        digits = np.zeros(len(extra), np.int64)
        rest = extra.copy()
        while rest.any():
            digits += rest > 0
            rest = rest >> shift
        first = np.cumsum(digits + 1) - digits - 1
        size = int((digits + 1).sum())
        self.slots = np.zeros(size, np.uint64)
        self.slots[first] = remainder
        self.counter = np.ones(size, bool)
        self.counter[first] = False
        for k in range(int(digits.max(initial=0))):
            has = digits > k
            self.slots[first[has] + k + 1] = (extra[has] >> np.uint64(k * self.r)) & ((np.uint64(1) << shift) - np.uint64(1))
        self.occupied = np.zeros(1 << self.q, bool)
        self.occupied[quotient] = True
        self.run_end = np.zeros(size, bool)
        ends = np.flatnonzero(np.append(quotient[1:] != quotient[:-1], True)) if len(quotient) else []
        self.run_end[(first + digits)[ends]] = True

    def items(self) -> tuple[np.ndarray, np.ndarray]:
        """Fingerprints in ascending order and their counts."""
        first = np.flatnonzero(~self.counter)
        run = np.concatenate([[0], np.cumsum(self.run_end)[:-1]]).astype(np.int64) if len(self.slots) else first
        quotient = np.flatnonzero(self.occupied)[run[first]].astype(np.uint64)
        counts = np.ones(len(first), np.int64)
        length = np.diff(np.append(first, len(self.slots))) - 1
        for k in range(int(length.max(initial=0))):
            has = length > k
            counts[has] += (self.slots[first[has] + k + 1] << np.uint64(k * self.r)).astype(np.int64)
        return (quotient << np.uint64(self.r)) | self.slots[first], counts

    @classmethod
    def merged(cls, filters: list[CountingQuotientFilter]) -> CountingQuotientFilter:
        """One filter with the counts added up. Slots of a run stay in the order of their remainders."""
        parts = [f.items() for f in filters]
        values, at = np.unique(np.concatenate([v for v, _ in parts]), return_inverse=True)
        counts = np.zeros(len(values), np.int64)
        np.add.at(counts, at, np.concatenate([n for _, n in parts]))
        return cls(filters[0].bits, values, counts)

    def to_bytes(self) -> bytes:
        width = -(-self.r // 8)
        slots = self.slots.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]
        head = np.array([self.bits, self.q, len(self.slots)], "<u4")
        flags = [np.packbits(x).tobytes() for x in (self.occupied, self.run_end, self.counter)]
        return b"".join([head.tobytes(), *flags, slots.tobytes()])

    @classmethod
    def from_bytes(cls, data: bytes) -> CountingQuotientFilter:
        own = cls.__new__(cls)
        own.bits, own.q, size = (int(x) for x in np.frombuffer(data, "<u4", 3))
        own.r = own.bits - own.q
        at = 12
        flags = []
        for n in (1 << own.q, size, size):
            flags.append(np.unpackbits(np.frombuffer(data, np.uint8, -(-n // 8), at), count=n).astype(bool))
            at += -(-n // 8)
        own.occupied, own.run_end, own.counter = flags
        width = -(-own.r // 8)
        slots = np.zeros((size, 8), np.uint8)
        slots[:, :width] = np.frombuffer(data, np.uint8, size * width, at).reshape(size, width)
        own.slots = slots.view("<u8").reshape(-1).astype(np.uint64)
        return own


def repeated_fingerprints(rows: DataFrame, column: str = "fingerprint") -> DataFrame:
    """fingerprint and n of the fingerprints counted more than once, from merged filters."""
    ranges = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")) - 1, 1).bit_length()
    low = np.uint64(64 - ranges)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = [batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64) for batch in batches]
        if not seen:
            return
        values, counts = np.unique(np.concatenate(seen), return_counts=True)
        parts, starts = np.unique(values >> low, return_index=True)
        for part, start, end in zip(parts, starts, np.append(starts[1:], len(values)), strict=True):
            own = values[start:end] & ((np.uint64(1) << low) - np.uint64(1))
            data = CountingQuotientFilter(int(low), own, counts[start:end]).to_bytes()
            yield pa.RecordBatch.from_arrays([pa.array([int(part)], pa.int64()), pa.array([data])], ["part", "filter"])

    def merge(key: tuple, filters: pd.DataFrame) -> pd.DataFrame:
        whole = CountingQuotientFilter.merged([CountingQuotientFilter.from_bytes(x) for x in filters["filter"]])
        values, counts = whole.items()
        values = values | (np.uint64(key[0]) << low)
        more = counts > 1
        return pd.DataFrame({"fingerprint": values[more].view(np.int64), "n": counts[more]})

    filters = rows.select(F.col(column)).mapInArrow(build, "part long, filter binary")
    return filters.groupBy("part").applyInPandas(merge, "fingerprint long, n long")


def normalised(text: str = "text") -> Column:
    return F.regexp_replace(body(text), SPACE, "")


def classes(docs: DataFrame) -> DataFrame:
    """key, doc_id, sha (hex SHA-256 of the normalised text), copies (equal rows), keep_id, group_size and chosen for
    every distinct (doc_id, text)."""
    norm = normalised()
    keys = stored(
        docs.select(
            "doc_id",
            row_key("doc_id", "text").alias("key"),
            F.length(body()).alias("length"),
            F.xxhash64(norm).alias("fingerprint"),
            F.sha2(norm.cast("binary"), 256).alias("sha"),
        ),
        "keys",
    )
    repeated = stored(repeated_fingerprints(keys), "repeated")
    maybe = Bitmap(repeated, "fingerprint")

    @F.pandas_udf("boolean")
    def routed(fingerprint: pd.Series) -> pd.Series:
        return pd.Series(maybe.holds(fingerprint.to_numpy(np.int64)))

    # Texts are equal byte by byte inside a group; the digest only names the group.
    groups = stored(
        docs.select(norm.alias("bytes"), F.xxhash64(norm).alias("fingerprint"))
        .where(routed("fingerprint"))
        .groupBy("bytes")
        .agg(F.count("*").alias("group_size"))
        .where(F.col("group_size") > 1)
        .select(F.sha2(F.col("bytes").cast("binary"), 256).alias("sha"), "group_size"),
        "groups",
    )
    # The first of a group by its digest: minima combine before the shuffle, so the copies of a text do not meet.
    order = F.struct(-F.col("length"), F.col("doc_id").isNull(), F.col("doc_id"), "key")
    often = keys.where(routed("fingerprint")).groupBy("sha").agg(F.min(F.struct(order.alias("o"), "doc_id", "key")).alias("first"))
    first = stored(
        often.join(groups, "sha").select(
            "sha", "group_size", F.col("first.doc_id").alias("keep_id"), F.col("first.key").alias("keep_key")
        ),
        "first",
    )
    distinct = keys.groupBy("doc_id", "key", "sha").agg(F.count("*").alias("copies"))
    found = distinct.join(broadcast_if_small(first), "sha", "left")
    return found.select(
        "key",
        "doc_id",
        "sha",
        "copies",
        F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).alias("group_size"),
        (F.col("group_size").isNull() | (F.col("key") == F.col("keep_key"))).alias("chosen"),
    )


def duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, keep_id, group_size, kept and text_sha256 of every row.

    Null, empty and blank texts are equal to each other. Of a group the row with the longest text stays, then the
    smallest doc_id, null last; of rows equal in both doc_id and text one is kept.
    """
    found = classes(docs).select("*", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy"))
    return found.select(
        "doc_id",
        "keep_id",
        "group_size",
        (F.col("chosen") & (F.col("copy") == 1)).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )


def drop_duplicates(docs: DataFrame) -> DataFrame:
    """The kept rows, all columns."""
    return select_rows(docs, row_key("doc_id", "text"), classes(docs).where("chosen").select("key", "copies"))


#: The same groups in DuckDB, by the normalised text itself.
ORACLE = """
WITH docs AS (
  SELECT doc_id, length(coalesce(text, '')) AS size, regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]', '', 'g') AS own
  FROM {documents})
SELECT doc_id, first(doc_id) OVER same AS keep_id, count(*) OVER (PARTITION BY own) AS group_size,
  row_number() OVER same = 1 AS kept, sha256(own) AS text_sha256
FROM docs WINDOW same AS (PARTITION BY own ORDER BY size DESC, doc_id NULLS LAST)
"""
