"""Reading, storing and cutting texts: what the operators of this subpackage share.

Conventions of every operator here:

* a null text counts as the empty text; a null ``doc_id`` is an ordinary value and keeps its row;
* repeated rows are rows of their own unless an operator says otherwise;
* an empty table gives an empty result with the same columns;
* only the named input columns are read, so further columns, whatever their names, cannot clash. Operators that return
  whole rows carry them in one struct while they work.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from themelens.session import scratch_dir

#: What separates words everywhere in this subpackage: the ASCII white space that ``bytes.split`` also splits at.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"

#: Rows of a dimension table up to which it is broadcast; beyond, the join is left to the optimiser.
BROADCAST_ROWS = 20_000


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written below the shared checkpoint folder and read back: evaluated once, with no lineage."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{name}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def broadcast_if_small(table: DataFrame) -> DataFrame:
    """A stored table with a broadcast hint where its counted rows are within ``BROADCAST_ROWS``."""
    return F.broadcast(table) if table.count() <= BROADCAST_ROWS else table


def body(text: str = "text") -> Column:
    return F.coalesce(F.col(text), F.lit(""))


def row_key(*columns: str) -> Column:
    """A 96-bit name of a row's content, as text. Rows with equal content share it."""
    values = [F.coalesce(F.col(c).cast("string"), F.lit("\0")) for c in columns]
    return F.concat(F.hex(F.xxhash64(*values)), F.lit("-"), F.hex(F.hash(*values)))


def select_rows(docs: DataFrame, key: Column, chosen: DataFrame) -> DataFrame:
    """Rows of ``docs`` whose ``key`` is in ``chosen`` (key, copies), all columns. Of rows that share a key, which are
    equal in what decides, one stays."""
    rows = docs.select(F.struct("*").alias("row"), key.alias("key")).join(chosen, "key")
    single = rows.where(F.col("copies") == 1).select("row")
    repeated = rows.where(F.col("copies") > 1).dropDuplicates(["key"]).select("row")
    return single.unionByName(repeated).select("row.*")


class Bitmap:
    """A set of 64-bit numbers as ``2**bits`` bits, whatever their number: no member is missed, others may pass.

    It is put together in Spark and broadcast; its size is fixed by ``bits`` (26: 8 MB). Whatever passes is decided
    exactly afterwards, so a full bitmap costs time, never rows.
    """

    def __init__(self, members: DataFrame, column: str, bits: int = 26):
        # The low bits: members that were chosen for a small hash differ in them alone.
        place = F.col(column).bitwiseAND(F.lit((1 << bits) - 1))
        packed = (
            members.groupBy(F.shiftright(place, 6).cast("int").alias("word"))
            .agg(F.expr(f"bit_or(shiftleft(1L, cast({column} & 63 as int)))").alias("mask"))
            .toArrow()
        )
        words_ = np.zeros(1 << (bits - 6), np.uint64)
        words_[packed["word"].to_numpy()] = packed["mask"].to_numpy().view(np.uint64)
        self.bits = bits
        self.shared = members.sparkSession.sparkContext.broadcast(words_)

    def holds(self, numbers: np.ndarray) -> np.ndarray:
        place = numbers.view(np.uint64) & np.uint64((1 << self.bits) - 1)
        return (self.shared.value[place >> np.uint64(6)] >> (place & np.uint64(63))) & np.uint64(1) == 1


def words(text: Column) -> Column:
    return F.filter(F.split(text, SPACE), lambda w: w != "")


def n_words(text: Column) -> Column:
    """Number of words without making them: word ends are counted."""
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def chunks(batches: Iterator[pa.RecordBatch], rows: int = 512, size: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Arrow batches cut so that one holds at most ``rows`` rows and, unless a single row is larger, ``size`` bytes."""
    for batch in batches:
        start = 0
        step = max(1, min(rows, int(batch.num_rows * size / max(batch.nbytes, 1))))
        while start < batch.num_rows:
            yield batch.slice(start, step)
            start += step
