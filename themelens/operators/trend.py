"""Six-month momentum score of each theme month."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from themelens.constants import (
    ACCELERATION_WEIGHT,
    CONCENTRATION_WEIGHT,
    CONFIDENCE_WEIGHTS,
    GROWTH_WEIGHT,
    LABELS_WITHOUT_MEANING,
    MIN_ACTIONABLE_PRODUCTS,
    MIN_ACTIVE_MONTHS,
    NEW_PRODUCT_WEIGHT,
    PERIOD,
    SERIES,
    THEME,
)
from themelens.functions.numeric import first_match, mean_of_available, share
from themelens.operators.calendar import theme_month_grid
from themelens.operators.ordering import average_rank_percentiles

SHARES = ("product_share", "units_absolute_share", "revenue_absolute_share")
PERCENTILE_FEATURES = (
    *[f"{name}_gain_3m" for name in SHARES],
    *[f"{name.removesuffix('_share')}_share_acceleration" for name in SHARES],
    "recent3_new_entry_share",
    "latest_product_share",
    "latest_top_publisher_product_share",
)
GRID_FACTS = (
    "product_count",
    "product_share",
    "units_absolute_coverage_count",
    "units_absolute_share",
    "revenue_absolute_coverage_count",
    "revenue_absolute_share",
    "new_entry_share",
    "median_rank",
    "publisher_count",
    "publisher_coverage_count",
    "top_publisher_product_share",
)


def _series() -> Window:
    return Window.partitionBy(*SERIES).orderBy("month_index")


def score_grid(totals: DataFrame, themes: DataFrame) -> DataFrame:
    """Theme x month grid with the score's zero-fill: an absent theme has zero products and entries, and a
    zero share only when that month's total is there to divide by."""
    grid = theme_month_grid(totals, themes, ("units_absolute_sum", "revenue_absolute_sum"), GRID_FACTS)
    absent = ~F.col("is_present")
    filled = {
        name: F.when(absent, F.lit(0)).otherwise(F.col(name))
        for name in ("product_count", "units_absolute_coverage_count", "revenue_absolute_coverage_count")
    }
    filled |= {
        name: F.when(absent, F.lit(0.0)).otherwise(F.col(name)) for name in ("product_share", "new_entry_share")
    }
    for prefix in ("units_absolute", "revenue_absolute"):
        filled[f"{prefix}_share"] = F.when(absent, F.when(F.col(f"{prefix}_sum") != 0, F.lit(0.0))).otherwise(
            F.col(f"{prefix}_share")
        )
    return grid.withColumns(filled)


def complete_average(value: Column, first_lag: int) -> Column:
    """Mean of three consecutive months ending ``first_lag`` months ago, NULL if one is missing."""
    window = _series()
    oldest, middle, newest = [
        F.lag(value, lag).over(window) if lag else value for lag in (first_lag + 2, first_lag + 1, first_lag)
    ]
    return (oldest + middle + newest) / 3


def active_average(value: Column, start: int, end: int) -> Column:
    """Mean of the months that have a value."""
    return F.avg(value).over(_series().rowsBetween(start, end))


def six_month_features(totals: DataFrame, themes: DataFrame) -> DataFrame:
    """Recent three against prior three months for every present theme from the sixth month on."""
    window = _series()
    recent, prior = (-2, 0), (-5, -3)

    def lag(name: str, n: int) -> Column:
        return F.lag(name, n).over(window) if n else F.col(name)

    gains, speed = {}, {}
    for name in SHARES:
        value = F.col(name)
        gains[f"{name}_gain_3m"] = complete_average(value, 0) - complete_average(value, 3)
        speed[f"{name.removesuffix('_share')}_share_acceleration"] = (value - lag(name, 2)) / 2.0 - (
            lag(name, 3) - lag(name, 5)
        ) / 2.0

    def coverage(name: str) -> Column:
        frame = window.rowsBetween(*recent)
        products = F.sum("product_count").over(frame)
        return F.coalesce(share(F.sum(name).over(frame), products), F.lit(0.0))

    rank, publishers = F.col("median_rank"), F.col("publisher_count")
    grid = score_grid(totals, themes).withColumns(
        {
            "window_start": lag("period_start", 5),
            "window_month_count": F.lit(6),
            "active_months_6m": F.sum(F.col("is_present").cast("int")).over(window.rowsBetween(-5, 0)),
            **gains,
            **speed,
            "recent3_new_entry_share": complete_average(F.col("new_entry_share"), 0),
            "median_rank_improvement": active_average(rank, *prior) - active_average(rank, *recent),
            "publisher_count_gain_3m": active_average(publishers, *recent) - active_average(publishers, *prior),
            "recent3_units_coverage_ratio": coverage("units_absolute_coverage_count"),
            "recent3_revenue_coverage_ratio": coverage("revenue_absolute_coverage_count"),
        }
    )
    latest = {
        "product_count": "latest_product_count",
        "product_share": "latest_product_share",
        "units_absolute_share": "latest_units_absolute_share",
        "revenue_absolute_share": "latest_revenue_absolute_share",
        "new_entry_share": "latest_new_entry_share",
        "median_rank": "latest_median_rank",
        "publisher_count": "latest_publisher_count",
        "top_publisher_product_share": "latest_top_publisher_product_share",
    }
    return grid.where((F.col("month_index") >= 6) & F.col("is_present")).select(
        *THEME,
        "window_start",
        "window_month_count",
        "active_months_6m",
        *[F.col(name).alias(alias) for name, alias in latest.items()],
        *gains,
        *speed,
        "recent3_new_entry_share",
        "median_rank_improvement",
        "publisher_count_gain_3m",
        share(F.col("units_absolute_share"), F.col("product_share")).alias("units_absolute_overindex"),
        share(F.col("revenue_absolute_share"), F.col("product_share")).alias("revenue_absolute_overindex"),
        "recent3_units_coverage_ratio",
        "recent3_revenue_coverage_ratio",
        F.coalesce(share(F.col("publisher_coverage_count"), F.col("product_count")), F.lit(0.0)).alias(
            "latest_publisher_coverage_ratio"
        ),
    )


def exclusion_reason() -> Column:
    return first_match(
        (F.col("game_theme").isin(*LABELS_WITHOUT_MEANING), "non_actionable_source_label"),
        (F.col("latest_product_count") < MIN_ACTIONABLE_PRODUCTS, "insufficient_latest_product_count"),
        (F.col("active_months_6m") < MIN_ACTIVE_MONTHS, "insufficient_active_history"),
        (
            F.col("latest_product_share").isNull() | F.col("recent3_new_entry_share").isNull(),
            "insufficient_metric_coverage",
        ),
    )


def confidence_score() -> Column:
    w = CONFIDENCE_WEIGHTS
    return 100.0 * (
        w["history"] * (F.col("active_months_6m") / 6)
        + w["size"] * F.least(F.col("latest_product_count") / 20.0, F.lit(1.0))
        + w["units"] * F.col("recent3_units_coverage_ratio")
        + w["revenue"] * F.col("recent3_revenue_coverage_ratio")
        + w["publisher"] * F.col("latest_publisher_coverage_ratio")
    )


def with_eligibility(features: DataFrame) -> DataFrame:
    return features.withColumns(
        {
            "exclusion_reason": exclusion_reason(),
            "is_actionable": exclusion_reason().isNull(),
            "confidence_score": confidence_score(),
        }
    )


def feature_percentiles(eligible: DataFrame) -> DataFrame:
    """0..100 average-rank percentiles of nine features among the actionable themes of a month."""
    return average_rank_percentiles(
        eligible.where("is_actionable"),
        PERIOD,
        THEME,
        {f"pct_{name}": F.col(name) for name in PERCENTILE_FEATURES},
        scale=100.0,
    )


def trend_scores(totals: DataFrame, themes: DataFrame) -> DataFrame:
    """Component scores, base score, confidence-weighted score and rank."""
    eligible = with_eligibility(six_month_features(totals, themes))
    scored = eligible.join(feature_percentiles(eligible), THEME, "left")

    def pct(*names: str) -> Column:
        return mean_of_available(*[F.col(f"pct_{name}") for name in names])

    scored = scored.withColumns(
        {
            "growth_score": pct(*PERCENTILE_FEATURES[:3]),
            "acceleration_score": pct(*PERCENTILE_FEATURES[3:6]),
            "new_product_score": F.col("pct_recent3_new_entry_share"),
            "concentration_penalty": pct("latest_product_share", "latest_top_publisher_product_share"),
        }
    )
    raw = (
        GROWTH_WEIGHT * F.col("growth_score")
        + ACCELERATION_WEIGHT * F.col("acceleration_score")
        + NEW_PRODUCT_WEIGHT * F.col("new_product_score")
        - CONCENTRATION_WEIGHT * F.col("concentration_penalty")
    )
    base = F.when(raw.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(100.0), raw)))
    scored = scored.withColumn("base_trend_score", base).withColumn(
        "trend_score", F.col("base_trend_score") * F.col("confidence_score") / 100.0
    )
    return with_trend_rank(scored).drop(*[f"pct_{name}" for name in PERCENTILE_FEATURES])


def with_trend_rank(scored: DataFrame, tie_digits: int = 12) -> DataFrame:
    """1..n among the actionable themes of a month by (-score, -base, -confidence, theme)."""

    def high(name: str) -> Column:
        return F.round(name, tie_digits).desc()

    order = Window.partitionBy(*PERIOD, "is_actionable").orderBy(
        high("trend_score"), high("base_trend_score"), high("confidence_score"), "game_theme"
    )
    return scored.withColumn("trend_rank", F.when(F.col("is_actionable"), F.row_number().over(order)))


def latest_ranking(scores: DataFrame, top_n: int) -> DataFrame:
    """The first ``top_n`` ranked themes of each scope's latest month."""
    latest = scores.groupBy("scope_name", "cadence").agg(F.max("period_start").alias("period_start"))
    return scores.join(latest, ["scope_name", "cadence", "period_start"]).where(F.col("trend_rank") <= top_n)
