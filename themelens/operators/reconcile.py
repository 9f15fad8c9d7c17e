"""Score table against an external record table: keys, projection, cell diff and write batches."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from themelens.constants import NUMERIC_TOLERANCE, PERIOD, SYNC_FIELDS
from themelens.functions.text import is_managed_key, managed_key

SYNC_COLUMNS = [name for name, _ in SYNC_FIELDS]


def desired_records(scores: DataFrame) -> DataFrame:
    """Managed key and the 21 projected fields per score row; dates become epoch milliseconds."""
    series = ["scope_name", "cadence"]
    latest = scores.groupBy(*series).agg(F.max("period_start").alias("_latest"))
    rows = scores.join(latest, series).withColumn(
        "is_latest_month", F.col("period_start") == F.col("_latest")
    )
    fields = []
    for name, kind in SYNC_FIELDS:
        column = F.col(name)
        if kind in ("date", "date-time"):
            column = F.unix_millis(column.cast("timestamp"))
        elif kind == "number":
            column = column.cast("double")
        fields.append(column.alias(f"field_{name}"))
    return rows.select(managed_key().alias("managed_key"), *PERIOD, "game_theme", *fields)


def normalize_text_cell(pieces: Column) -> Column:
    """Rich text cell (array of pieces with ``text``) as one string, blank as NULL."""
    joined = F.array_join(F.transform(pieces, lambda piece: piece["text"]), "")
    return F.when(F.trim(joined) != "", joined)


def normalize_number_cell(value: Column) -> Column:
    """Number given as text; blanks, digit separators and non-finite values are NULL."""
    cleaned = F.trim(value)
    number = F.when(~cleaned.contains("_"), cleaned.try_cast("double"))
    return F.when(~F.isnan(number) & (F.abs(number) != float("inf")), number)


def classify_existing(existing: DataFrame) -> DataFrame:
    """Mark each external record managed, blank or other by its primary value."""
    key = F.col("primary_value")
    return existing.withColumn(
        "status",
        F.when(key.isNull() | (F.trim(key) == ""), "unmanaged_blank")
        .when(is_managed_key(key), "managed")
        .otherwise("unmanaged_nonblank"),
    )


def changed_fields(desired: str = "d", existing: str = "e") -> Column:
    """Names of the fields whose values differ; numbers within the tolerance are equal, NULL equals NULL."""
    tests = []
    for name, kind in SYNC_FIELDS:
        left, right = F.col(f"{desired}.field_{name}"), F.col(f"{existing}.field_{name}")
        if kind == "number":
            same = (left.isNull() & right.isNull()) | F.coalesce(F.abs(left - right) <= NUMERIC_TOLERANCE, F.lit(False))
        else:
            same = left.eqNullSafe(right)
        tests.append(F.when(~same, F.lit(name)))
    return F.array_compact(F.array(*tests))


def changed_values(desired: str = "d", existing: str = "e") -> Column:
    """(field, number, text) of the fields that differ, with the new value: what an update has to write."""
    wanted = [
        F.struct(
            F.lit(name).alias("field"),
            (F.col(f"{desired}.field_{name}") if kind == "number" else F.lit(None)).cast("double").alias("number"),
            (F.lit(None) if kind == "number" else F.col(f"{desired}.field_{name}")).cast("string").alias("text"),
        )
        for name, kind in SYNC_FIELDS
    ]
    names = changed_fields(desired, existing)
    return F.filter(F.array(*wanted), lambda x: F.array_contains(names, x["field"]))


def reconcile(desired: DataFrame, existing: DataFrame) -> DataFrame:
    """create / update / unchanged / stale per managed key.

    A key that occurs several times outside is reported as duplicate. While any duplicate exists no
    create or update is planned, as in a dry run of the synchronisation.
    """
    managed = classify_existing(existing).where(F.col("status") == "managed")
    fields = F.struct(*[F.col(f"field_{name}") for name in SYNC_COLUMNS])
    grouped = managed.groupBy(F.col("primary_value").alias("managed_key")).agg(
        F.count(F.lit(1)).alias("_n"),
        F.min(F.struct("record_id", fields.alias("fields"))).alias("_first"),
    )
    duplicates = grouped.where(F.col("_n") > 1).agg(F.count(F.lit(1))).scalar()
    ours = desired.select("managed_key", F.struct(*[f"field_{name}" for name in SYNC_COLUMNS]).alias("d"))
    pairs = ours.join(grouped, "managed_key", "full_outer").withColumn("e", F.col("_first.fields"))
    pairs = pairs.withColumns({"_changed": changed_fields(), "_values": changed_values(), "_duplicates": duplicates})
    action = (
        F.when(F.col("d").isNull(), "stale")
        .when(F.col("_n") > 1, "duplicate")
        .when(F.col("_duplicates") > 0, "blocked")
        .when(F.col("_n").isNull(), "create")
        .when(F.size("_changed") > 0, "update")
        .otherwise("unchanged")
    )
    return pairs.select(
        "managed_key",
        F.coalesce("_n", F.lit(0)).alias("record_count"),
        F.col("_first.record_id").alias("record_id"),
        action.alias("action"),
        F.when(action == "update", F.array_join("_changed", ",")).alias("changed"),
        F.when(action == "update", F.col("_values")).alias("changes"),
    )


def reconciliation_summary(plan: DataFrame, existing: DataFrame) -> DataFrame:
    """Counts of the plan and of the external records by class."""
    actions = plan.groupBy("action").agg(F.count(F.lit(1)).alias("row_count"))
    classes = classify_existing(existing).groupBy(F.col("status").alias("action")).agg(
        F.count(F.lit(1)).alias("row_count")
    )
    return actions.unionByName(classes)


def write_batches(
    rows: DataFrame, groups: Sequence[str], order: Sequence[str], size: int = 100, within: Sequence[str] = ()
) -> DataFrame:
    """Number fixed-size batches in (groups, order) order, for each value of ``within`` (scope, action) apart.

    Positions are the row number inside a group plus the sizes of the groups before it, so only one row per group is
    ordered for a value of ``within``. ``groups`` are periods; with others the number of groups must stay as small.
    """
    if not 1 <= size <= 1000:
        raise ValueError("batch size must be between 1 and 1000")
    keys = [*within, *(name for name in groups if name not in within)]
    before = Window.partitionBy(*within).orderBy(*groups).rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        rows.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_offset", F.coalesce(F.sum("_n").over(before), F.lit(0)))
        .drop("_n")
    )
    inside = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return (
        rows.join(offsets, keys)
        .withColumn("batch_number", F.floor((F.col("_offset") + inside - 1) / size) + 1)
        .drop("_offset")
    )
