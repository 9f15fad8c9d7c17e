"""Month arithmetic, month lists and gap checks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from themelens.constants import PERIOD


def month_start(value: Column) -> Column:
    return F.trunc(value, "month")


def month_bounds(df: DataFrame, column: str) -> DataFrame:
    """First and last day of the month of ``column``."""
    return df.withColumn("period_start", month_start(F.col(column))).withColumn(
        "period_end", F.last_day(F.col(column))
    )


def is_natural_month(start: Column, end: Column) -> Column:
    return (start == F.trunc(start, "month")) & (end == F.last_day(start))


def shift_month(value: Column, months: int | Column) -> Column:
    return F.add_months(value, months)


def months_between(start: Column, end: Column) -> Column:
    """Whole calendar months from start to end."""
    return (F.year(end) - F.year(start)) * 12 + F.month(end) - F.month(start)


def completed_months(ranges: DataFrame, as_of: str) -> DataFrame:
    """Inclusive month list of each ``start`` .. ``end`` row; months not finished at ``as_of`` are left out."""
    months = F.sequence(F.trunc("start", "month"), F.trunc("end", "month"), F.expr("interval 1 month"))
    return (
        ranges.withColumn("period_start", F.explode(months))
        .where(F.col("period_start") < F.trunc(F.lit(as_of).cast("date"), "month"))
        .withColumn("period_end", F.last_day("period_start"))
        .drop("start", "end")
    )


def stored_months(snapshots: DataFrame) -> DataFrame:
    """Distinct periods with a flag telling whether the calendar month before is stored as well."""
    previous = F.lag("period_start").over(Window.partitionBy("scope_name", "cadence").orderBy("period_start"))
    return (
        snapshots.select(*PERIOD)
        .distinct()
        .withColumn(
            "has_previous_month", F.coalesce(previous == F.add_months("period_start", -1), F.lit(False))
        )
    )


def month_gaps(df: DataFrame) -> DataFrame:
    """Periods whose predecessor in the series is not the month before; empty for a contiguous history."""
    previous = F.lag("period_start").over(Window.partitionBy("scope_name", "cadence").orderBy("period_start"))
    return (
        df.select("scope_name", "cadence", "period_start")
        .distinct()
        .withColumn("previous_start", previous)
        .where(F.col("previous_start") != F.add_months("period_start", -1))
    )


def require_contiguous(df: DataFrame) -> DataFrame:
    """Return the input unchanged; fail when a month is missing inside a series."""
    if not month_gaps(df).isEmpty():
        raise ValueError("month history has a gap; missing months are not zero-filled")
    return df


def missing_months(wanted: DataFrame, stored: DataFrame, refresh: bool = False) -> DataFrame:
    """Wanted months of a scope and cadence that hold no stored row, or all of them when refreshing."""
    if refresh:
        return wanted
    key = ["scope_name", "cadence", "period_start"]
    return wanted.join(stored.select(*key).distinct(), key, "left_anti")


def planned_target_counts(periods: DataFrame, outcome_horizons: Sequence[int] = (1, 2, 3)) -> DataFrame:
    """How many target months a history of n months yields per feature window and outcome horizon."""
    series = ["scope_name", "cadence"]
    per_scope = periods.select(*series, "period_start").distinct().groupBy(*series).agg(F.count(F.lit(1)).alias("n"))
    plans = F.array(
        *[
            F.struct(F.lit(window).alias("window_months"), F.lit(horizon).alias("outcome_horizon_months"))
            for window in (6, 12, 24, 36)
            for horizon in (0, *outcome_horizons)
        ]
    )
    return per_scope.select(*series, "n", F.explode(plans).alias("p")).select(
        *series,
        "p.window_months",
        "p.outcome_horizon_months",
        F.greatest(F.col("n") - F.col("p.window_months") + 1 - F.col("p.outcome_horizon_months"), F.lit(0)).alias(
            "target_count"
        ),
    )


def theme_month_grid(
    months: DataFrame, facts: DataFrame, month_columns: Sequence[str], fact_columns: Sequence[str]
) -> DataFrame:
    """Every theme of a scope times every month of the scope, left-joined with its facts.

    The month list of a scope is one short array, so themes meet it in an equi-join and expand it
    locally. ``month_index`` is the calendar distance from the scope's first month plus one, so that a missing
    month cannot shift a lag; ``is_present`` marks stored rows.
    """
    month_entry = F.struct("period_start", "period_end", *month_columns)
    calendars = months.groupBy("scope_name", "cadence").agg(F.sort_array(F.collect_list(month_entry)).alias("_m"))
    cells = (
        facts.select("scope_name", "cadence", "game_theme")
        .distinct()
        .join(calendars, ["scope_name", "cadence"])
        .select("scope_name", "cadence", "game_theme", F.get("_m", F.lit(0))["period_start"].alias("_f"), F.explode("_m").alias("_m"))
        .select(
            "scope_name",
            "cadence",
            "game_theme",
            (months_between(F.col("_f"), F.col("_m.period_start")) + 1).cast("int").alias("month_index"),
            "_m.period_start",
            "_m.period_end",
            *[f"_m.{name}" for name in month_columns],
        )
    )
    stored = facts.select(
        "scope_name", "cadence", "game_theme", "period_start", *fact_columns, F.lit(True).alias("is_present")
    )
    return cells.join(stored, ["scope_name", "cadence", "game_theme", "period_start"], "left").withColumn(
        "is_present", F.coalesce("is_present", F.lit(False))
    )
