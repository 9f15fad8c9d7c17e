"""Revenue-based class proxy of products and themes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from themelens.constants import PERIOD, PROXY_CLASSES, PROXY_POLICY, THEME
from themelens.functions.numeric import count_where, positive_share, total


def classify_observable_revenue(revenue: Column) -> Column:
    """(state, proxy, reason) of one revenue value; invalid values have no class."""
    valid = revenue.isNull() | ((revenue >= 0) & ~F.isnan(revenue) & (revenue != float("inf")))

    def named(state: str, proxy: str, reason: str) -> Column:
        return F.struct(
            F.lit(state).alias("observable_revenue_state"),
            F.lit(proxy).alias("monetization_proxy"),
            F.lit(reason).alias("classification_reason"),
        )

    return F.when(
        valid,
        F.when(revenue.isNull(), named("unavailable", "unknown", "observable_revenue_unavailable"))
        .when(revenue == 0, named("zero", "iaa_candidate", "observable_revenue_zero"))
        .otherwise(named("positive", "iap_or_hybrid_candidate", "observable_revenue_positive")),
    )


def is_invalid_revenue() -> Column:
    return classify_observable_revenue(F.col("revenue_absolute")).isNull()


def invalid_revenue(snapshots: DataFrame) -> DataFrame:
    """Rows whose revenue is negative, NaN or infinite."""
    return snapshots.where(is_invalid_revenue())


def product_revenue_profiles(snapshots: DataFrame) -> DataFrame:
    """One profile per product row, themes without a label included.

    Invalid revenue, which has no class, is not left out: it is a violation that stops the run before this stage."""
    return (
        snapshots.withColumn("_class", classify_observable_revenue(F.col("revenue_absolute")))
        .select(
            *PERIOD,
            "source_app_id",
            "unified_app_id",
            "game_theme",
            "game_product_model",
            F.lit(PROXY_POLICY).alias("monetization_policy_version"),
            F.col("revenue_absolute").alias("observable_revenue_usd"),
            "_class.*",
        )
    )


def theme_proxy_metrics(snapshots: DataFrame) -> DataFrame:
    """Product counts, coverage and download weight of each class per theme month."""
    proxy = classify_observable_revenue(F.col("revenue_absolute"))["monetization_proxy"]
    rows = snapshots.where(F.col("game_theme").isNotNull()).withColumn("_proxy", proxy)
    grouped = rows.groupBy(*THEME).agg(
        F.count(F.lit(1)).alias("product_count"),
        F.count("revenue_absolute").alias("observable_revenue_usd_coverage_count"),
        total(F.col("revenue_absolute")).alias("observable_revenue_usd_sum"),
        F.count("units_absolute").alias("downloads_coverage_count"),
        total(F.col("units_absolute")).alias("downloads_sum"),
        *[
            column
            for name in PROXY_CLASSES
            for own in [F.col("_proxy") == name]
            for column in (
                count_where(own).alias(f"{name}_product_count"),
                total(F.when(own, F.col("units_absolute"))).alias(f"{name}_downloads_sum"),
            )
        ],
    )
    products = F.col("product_count")
    return grouped.select(
        *THEME,
        F.lit(PROXY_POLICY).alias("monetization_policy_version"),
        "product_count",
        "observable_revenue_usd_coverage_count",
        (F.col("observable_revenue_usd_coverage_count") / products).alias("observable_revenue_usd_coverage_ratio"),
        "observable_revenue_usd_sum",
        *[
            column
            for name in PROXY_CLASSES
            for column in (
                F.col(f"{name}_product_count"),
                (F.col(f"{name}_product_count") / products).alias(f"{name}_product_share"),
            )
        ],
        "downloads_coverage_count",
        (F.col("downloads_coverage_count") / products).alias("downloads_coverage_ratio"),
        "downloads_sum",
        *[
            column
            for name in PROXY_CLASSES
            for column in (
                F.col(f"{name}_downloads_sum"),
                positive_share(F.col(f"{name}_downloads_sum"), F.col("downloads_sum")).alias(f"{name}_downloads_share"),
            )
        ],
    )


def profile_coverage_violations(snapshots: DataFrame, profiles: DataFrame) -> DataFrame:
    """Product rows and profiles that do not match one to one on id, theme, model and revenue."""
    keys = [*PERIOD, "unified_app_id"]
    left = snapshots.select(
        *keys,
        F.struct("source_app_id", "game_theme", "game_product_model", F.col("revenue_absolute").alias("r")).alias("fact"),
    )
    right = profiles.select(
        *keys,
        F.struct("source_app_id", "game_theme", "game_product_model", F.col("observable_revenue_usd").alias("r")).alias(
            "profile"
        ),
    )
    reason = (
        F.when(F.col("profile").isNull(), "missing_profile")
        .when(F.col("fact").isNull(), "profile_without_snapshot")
        .when(~F.col("fact").eqNullSafe(F.col("profile")), "source_reference_mismatch")
    )
    return left.join(right, keys, "full_outer").select(*keys, reason.alias("violation")).where("violation is not null")


def theme_identity_violations(proxies: DataFrame, others: dict[str, DataFrame]) -> DataFrame:
    """Theme months that the proxy table and another stage do not share, within months both hold."""
    found = None
    for name, other in others.items():
        ours, theirs = proxies.select(*THEME), other.select(*THEME)
        shared = ours.select(*PERIOD).distinct().join(theirs.select(*PERIOD).distinct(), PERIOD)
        ours = ours.join(shared, PERIOD, "left_semi")
        theirs = theirs.join(shared, PERIOD, "left_semi")
        for kind, left, right in (("only_in_proxy", ours, theirs), ("missing_in_proxy", theirs, ours)):
            part = left.join(right, THEME, "left_anti").select(
                *THEME, F.lit(name).alias("compared_table"), F.lit(kind).alias("violation")
            )
            found = part if found is None else found.unionByName(part)
    return found
