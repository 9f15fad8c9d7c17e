"""Monthly market totals and theme metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from themelens.constants import PERIOD, THEME
from themelens.functions.numeric import count_where, share, total
from themelens.operators.calendar import stored_months
from themelens.operators.ordering import label_medians


def _with_product(rows: DataFrame) -> DataFrame:
    """``rows`` with the id of their product. A row without an id is no product that could have a neighbour or metadata:
    such rows get a key each, which spreads them out."""
    alone = F.concat(F.lit("\n"), F.xxhash64("period_start", "rank_position", "source_app_id").cast("string"))
    return rows.withColumn("_product", F.coalesce("unified_app_id", alone))


def _join_metadata(rows: DataFrame, metadata: DataFrame) -> DataFrame:
    # A row for each product, so the list grows with the market and is not broadcast, whatever its files weigh.
    columns = metadata.where(F.col("unified_app_id").isNotNull()).select(
        F.col("unified_app_id").alias("_product"),
        F.col("name").alias("game_name"),
        "publisher_display_name",
        F.lit(True).alias("_matched"),
    )
    return rows.join(columns.hint("merge"), "_product", "left").withColumn(
        "has_metadata", F.coalesce("_matched", F.lit(False))
    ).drop("_matched")


def attach_metadata(snapshots: DataFrame, metadata: DataFrame) -> DataFrame:
    """Left-enrich facts with product name and publisher; unmatched facts stay."""
    return _join_metadata(_with_product(snapshots), metadata).drop("_product")


def _neighbours(rows: DataFrame) -> DataFrame:
    """Columns ``previous`` and ``following`` by one window over each product's months."""
    product = Window.partitionBy("_product", "scope_name", "cadence").orderBy("period_start")
    state = F.struct("period_start", "game_theme", "rank_position", "units_absolute", "revenue_absolute")
    placed = rows.withColumns({"_before": F.lag(state).over(product), "_after": F.lead(state).over(product)})
    return placed.withColumns(
        {
            "previous": F.when(F.col("_before.period_start") == F.add_months("period_start", -1), F.col("_before")),
            "following": F.when(F.col("_after.period_start") == F.add_months("period_start", 1), F.col("_after")),
        }
    ).drop("_before", "_after")


def _with_month_flags(rows: DataFrame, months: DataFrame) -> DataFrame:
    """``months`` has a row for each month of a scope, however many products there are, so it is broadcast."""
    return rows.join(F.broadcast(months), PERIOD).withColumn(
        "is_market_new", F.when(F.col("has_previous_month"), F.col("previous").isNull())
    )


def with_neighbour_months(facts: DataFrame, months: DataFrame | None = None) -> DataFrame:
    """Add to each product row the same product's row of the calendar month before and after.

    One window per product (as long as its month list) replaces two month-shifted self joins: every
    previous-month and exit statistic reads these columns. ``months`` are the stored months of the scopes if they
    are known already.
    """
    months = stored_months(facts) if months is None else months
    return _with_month_flags(_neighbours(_with_product(facts)).drop("_product"), months)


def product_facts(snapshots: DataFrame, metadata: DataFrame, months: DataFrame) -> DataFrame:
    """:func:`attach_metadata` and :func:`with_neighbour_months` in one: rows are shuffled and sorted by product once, for
    the window and the join."""
    rows = _neighbours(_with_product(snapshots).repartition("_product"))
    return _with_month_flags(_join_metadata(rows, metadata).drop("_product"), months)


def monthly_market_totals(facts: DataFrame) -> DataFrame:
    """Month-wide counts, coverage and sums; the denominator of every market share."""
    return facts.groupBy(*PERIOD).agg(
        F.count(F.lit(1)).alias("snapshot_count"),
        F.count("game_theme").alias("theme_present_count"),
        count_where(F.col("game_theme").isNull()).alias("theme_missing_count"),
        count_where(F.col("has_metadata")).alias("metadata_coverage_count"),
        F.count("units_absolute").alias("units_absolute_coverage_count"),
        total(F.col("units_absolute")).alias("units_absolute_sum"),
        F.count("revenue_absolute").alias("revenue_absolute_coverage_count"),
        total(F.col("revenue_absolute")).alias("revenue_absolute_sum"),
    )


def new_and_returning(facts: DataFrame) -> DataFrame:
    """Products of a theme that the whole previous month's market had, or had not."""
    has_previous = F.first("has_previous_month")
    new = count_where(F.col("is_market_new"))
    returning = count_where(~F.col("is_market_new"))
    return (
        facts.where(F.col("game_theme").isNotNull())
        .groupBy(*THEME)
        .agg(
            has_previous.alias("has_previous_month"),
            F.when(has_previous, new).alias("new_entry_count"),
            F.when(has_previous, returning).alias("returning_product_count"),
            F.when(has_previous, new / F.count(F.lit(1))).alias("new_entry_share"),
        )
    )


def publisher_totals(facts: DataFrame) -> DataFrame:
    """Products and measures per (theme, publisher); rows without a publisher are not covered."""
    return (
        facts.where(F.col("game_theme").isNotNull() & F.col("publisher_display_name").isNotNull())
        .groupBy(*THEME, "publisher_display_name")
        .agg(
            F.count(F.lit(1)).alias("products"),
            F.count("units_absolute").alias("units_coverage"),
            total(F.col("units_absolute")).alias("units"),
            F.count("revenue_absolute").alias("revenue_coverage"),
            total(F.col("revenue_absolute")).alias("revenue"),
        )
    )


def age_days() -> Column:
    return F.when(
        F.col("release_date_ww") <= F.col("period_end"), F.datediff("period_end", "release_date_ww")
    )


def theme_medians(facts: DataFrame) -> DataFrame:
    """Every median over the products of a theme, by one shuffle of the rows."""
    return label_medians(
        facts.where(F.col("game_theme").isNotNull()),
        THEME,
        (),
        {
            "median_rank": F.col("rank_position"),
            "downloads_median_per_covered_product": F.col("units_absolute"),
            "revenue_usd_median_per_covered_product": F.col("revenue_absolute"),
            "median_product_age_days": age_days(),
        },
    )


def publisher_concentration(facts: DataFrame, publishers: DataFrame | None = None) -> DataFrame:
    """Covered products, distinct publishers and the largest publisher's share of covered products; ``publishers`` may hold
    the stored :func:`publisher_totals`."""
    return (
        (publisher_totals(facts) if publishers is None else publishers)
        .groupBy(*THEME)
        .agg(
            F.sum("products").alias("publisher_coverage_count"),
            F.count(F.lit(1)).alias("publisher_count"),
            (F.max("products") / F.sum("products")).alias("top_publisher_product_share"),
        )
    )


def theme_monthly_metrics(
    facts: DataFrame, totals: DataFrame, publishers: DataFrame | None = None, middles: DataFrame | None = None
) -> DataFrame:
    """Size, rank, coverage, share, entry and publisher metrics of each raw theme label per month; ``publishers`` and
    ``middles`` may hold the stored :func:`publisher_totals` and :func:`theme_medians`."""
    themed = facts.where(F.col("game_theme").isNotNull())
    has_previous = F.first("has_previous_month")
    new = count_where(F.col("is_market_new"))
    basics = themed.groupBy(*THEME).agg(
        F.count(F.lit(1)).alias("product_count"),
        count_where(F.col("rank_position") <= 100).alias("top_100_count"),
        count_where(F.col("rank_position") <= 500).alias("top_500_count"),
        F.avg("rank_position").alias("average_rank"),
        F.count("units_absolute").alias("units_absolute_coverage_count"),
        total(F.col("units_absolute")).alias("units_absolute_sum"),
        F.count("revenue_absolute").alias("revenue_absolute_coverage_count"),
        total(F.col("revenue_absolute")).alias("revenue_absolute_sum"),
        has_previous.alias("has_previous_month"),
        F.when(has_previous, new).alias("new_entry_count"),
        F.when(has_previous, count_where(~F.col("is_market_new"))).alias("returning_product_count"),
        F.when(has_previous, new / F.count(F.lit(1))).alias("new_entry_share"),
    )
    ranks = (theme_medians(facts) if middles is None else middles).select(*THEME, "median_rank")
    month = totals.select(
        *PERIOD,
        "snapshot_count",
        F.col("units_absolute_sum").alias("_units_total"),
        F.col("revenue_absolute_sum").alias("_revenue_total"),
    )
    return (
        basics.join(ranks, THEME)
        .join(publisher_concentration(facts, publishers), THEME, "left")
        .join(month, PERIOD)
        .select(
            *THEME,
            "product_count",
            (F.col("product_count") / F.col("snapshot_count")).alias("product_share"),
            "top_100_count",
            "top_500_count",
            "average_rank",
            "median_rank",
            "units_absolute_coverage_count",
            "units_absolute_sum",
            share(F.col("units_absolute_sum"), F.col("_units_total")).alias("units_absolute_share"),
            "revenue_absolute_coverage_count",
            "revenue_absolute_sum",
            share(F.col("revenue_absolute_sum"), F.col("_revenue_total")).alias("revenue_absolute_share"),
            "has_previous_month",
            "new_entry_count",
            "returning_product_count",
            "new_entry_share",
            F.coalesce("publisher_coverage_count", F.lit(0)).alias("publisher_coverage_count"),
            F.coalesce("publisher_count", F.lit(0)).alias("publisher_count"),
            "top_publisher_product_share",
        )
    )
