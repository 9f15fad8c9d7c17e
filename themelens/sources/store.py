"""Period tables: Parquet partitioned by period, replaced by Spark's dynamic partition overwrite.

A period is (scope_name, cadence, period_start, period_end), so scopes and cadences that begin on one day are replaced
apart. A write commits all of its periods together or none; target periods without rows are cleared after it by removing
their folders. Replacing is idempotent: a failed run is repeated. Concurrent writers are a table format's business.
"""

from __future__ import annotations

from collections.abc import Collection, Iterable, Mapping, Sequence
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from themelens.constants import PERIOD

#: (scope_name, cadence, period_start, period_end), dates as ISO text or date.
Period = tuple

_PERIODS = "scope_name string, cadence string, period_start date, period_end date"


def period_frame(spark: SparkSession, periods: Iterable[Period]) -> DataFrame:
    """The periods as rows; they number months times scopes, never rows of data."""
    named = [tuple(map(str, period)) for period in periods]
    rows = spark.createDataFrame(named, ", ".join(f"{c} string" for c in PERIOD))
    return rows.select("scope_name", "cadence", F.col("period_start").cast("date"), F.col("period_end").cast("date"))


def only_periods(rows: DataFrame, periods: Collection[Period]) -> DataFrame:
    """Rows of the given periods. The months prune the folders of a partitioned table, the join tells scopes apart."""
    months = sorted({str(period[2]) for period in periods})
    inside = rows.where(F.col("period_start").isin(*[F.lit(m).cast("date") for m in months]))
    return inside.join(F.broadcast(period_frame(rows.sparkSession, periods)), PERIOD, "left_semi")


class PeriodTable:
    """A table below one folder. Its schema is the writer's, so a scope named ``7`` stays text."""

    def __init__(self, spark: SparkSession, path: str, schema: StructType):
        self.spark, self.path = spark, path.rstrip("/")
        own = [f for f in schema.fields if f.name not in PERIOD]
        self.schema = StructType([*own, *[schema[c] for c in PERIOD]])
        self.columns = schema.names

    def write(self, rows: DataFrame, periods: Collection[Period] | None = None) -> None:
        """Replace the periods that ``rows`` hold. With ``periods``, a row of another one fails the write before anything
        is visible."""
        if periods is not None:
            wanted = period_frame(self.spark, periods).withColumn("_wanted", F.lit(True))
            named = F.concat_ws(" ", *[F.col(c).cast("string") for c in PERIOD])
            refused = F.raise_error(F.concat(F.lit(f"{self.path}: a period outside the target range: "), named))
            rows = (
                rows.join(F.broadcast(wanted), PERIOD, "left")
                .withColumn("cadence", F.when(F.col("_wanted"), F.col("cadence")).otherwise(refused))
                .drop("_wanted")
            )
        # Rebalancing sizes the files: small periods share a task, a hot period is split over many.
        rows = rows.select(*self.schema.names).hint("rebalance", *PERIOD)
        writer = rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "zstd")
        writer.partitionBy(*PERIOD).parquet(self.path)

    def clear(self, periods: Iterable[Period]) -> None:
        wanted = {tuple(map(str, period)) for period in periods}
        for period, folder in self._folders().items() if wanted else ():
            if period in wanted:
                own = self.spark._jvm.org.apache.hadoop.fs.Path(folder)
                own.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(own, True)

    def _folders(self) -> dict[Period, str]:
        """Folders of the stored periods, by one listing."""
        pattern = self.spark._jvm.org.apache.hadoop.fs.Path("/".join([self.path, *(f"{c}=*" for c in PERIOD)]))
        found = pattern.getFileSystem(self.spark._jsc.hadoopConfiguration()).globStatus(pattern)
        paths = [status.getPath().toString() for status in found or ()]
        return {tuple(unquote(part.partition("=")[2]) for part in p.split("/")[-len(PERIOD) :]): p for p in paths}

    def periods(self) -> list[Period]:
        """The stored periods, from the folders alone."""
        return sorted(self._folders())

    def read(self, periods: Collection[Period] | None = None) -> DataFrame:
        """All rows, or those of some periods (other folders are skipped)."""
        own = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        if not own.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(own):
            return self.spark.createDataFrame([], self.schema).select(*self.columns)
        rows = self.spark.read.schema(self.schema).parquet(self.path).select(*self.columns)
        return rows if periods is None else only_periods(rows, periods)


def replace_range(tables: Mapping[PeriodTable, DataFrame], periods: Collection[Period]) -> None:
    """Replace the given periods in each of the tables.

    Rows outside of ``periods`` are refused; a period without rows is cleared. Each row set should be stored or cheap: it is
    read for its periods and once more for the write.
    """
    targets = {tuple(map(str, period)) for period in periods}
    for table, rows in tables.items():
        held = {tuple(map(str, row)) for row in rows.select(*PERIOD).distinct().collect()}
        table.write(rows, targets)
        table.clear(targets - held)


def replace_period(table: PeriodTable, rows: DataFrame, period: Period) -> None:
    replace_range({table: rows}, [period])


def upsert_metadata(stored: DataFrame, new: DataFrame, position: str | None = None) -> DataFrame:
    """Stored rows with new ones on top; the latest fetched row of an id wins, other ids stay.

    Of new rows fetched at the same time the one last in the payload wins, ``position`` naming the column of ``new``
    that holds the place in it; without one, the greatest row by its columns, so that reruns agree.
    """
    columns = [c for c in stored.columns if c != "unified_app_id"]
    place = F.lit(0).cast("long") if position is None else F.col(position).cast("long")
    ranked = stored.withColumns({"_new": F.lit(0), "_place": F.lit(0).cast("long")}).unionByName(
        new.withColumns({"_new": F.lit(1), "_place": place}).select("unified_app_id", *columns, "_new", "_place")
    )
    return (
        ranked.groupBy("unified_app_id")
        .agg(F.max_by(F.struct(*columns), F.struct("_new", "fetched_at", "_place", *columns)).alias("_row"))
        .select("unified_app_id", "_row.*")
    )


def export_sorted(rows: DataFrame, path: str, columns: Sequence[str], order: Sequence, single_file: bool = False) -> None:
    """Fixed column order and total sort as ZSTD Parquet; rows are range-partitioned unless one file is asked for."""
    ordered = rows.select(*columns).orderBy(*order)
    if single_file:
        ordered = ordered.coalesce(1)
    ordered.write.mode("overwrite").option("compression", "zstd").parquet(path)


def readback_differences(expected: DataFrame, stored: DataFrame) -> DataFrame:
    """Rows present on one side only, duplicates counted; empty when the stored rows equal the payload."""
    columns = expected.columns
    lost = expected.exceptAll(stored.select(*columns)).withColumn("violation", F.lit("not_stored"))
    extra = stored.select(*columns).exceptAll(expected).withColumn("violation", F.lit("not_expected"))
    return lost.unionByName(extra)


def period_digests(rows: DataFrame) -> DataFrame:
    """Rows and two sums of row hashes of each period: equal for equal multisets of rows, in whatever order they lie."""
    columns = sorted(rows.columns)
    # A hash passes NULL over, so where they stand is hashed too.
    nulls = [F.col(c).isNull() for c in columns]
    sums = [F.sum(F.xxhash64(F.lit(salt), *columns, *nulls).cast("decimal(20,0)")).alias(f"_digest_{salt}") for salt in (1, 2)]
    return rows.groupBy(*PERIOD).agg(F.count(F.lit(1)).alias("_rows"), *sums)


def damaged_periods(expected: DataFrame, table: PeriodTable) -> list[Period]:
    """Periods whose stored rows are not the expected ones. Their number is bounded by that of the periods."""
    own = ("_rows", "_digest_1", "_digest_2")
    stored = period_digests(table.read().select(*expected.columns)).select(*PERIOD, F.struct(*own).alias("_stored"))
    wanted = period_digests(expected).select(*PERIOD, F.struct(*own).alias("_wanted"))
    found = wanted.join(stored, PERIOD, "full").where(~F.col("_wanted").eqNullSafe(F.col("_stored")))
    return sorted(tuple(map(str, row)) for row in found.select(*PERIOD).collect())


def verified(expected: DataFrame, table: PeriodTable) -> DataFrame:
    """:func:`readback_differences` of all columns, compared row by row only in the periods whose digests differ."""
    damaged = damaged_periods(expected, table)
    return readback_differences(only_periods(expected, damaged), table.read(damaged))
