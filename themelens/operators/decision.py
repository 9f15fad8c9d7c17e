"""Rule-based theme decisions with explained risks, for every target month at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from themelens.constants import (
    DECISION_POLICY,
    GROWTH_QUALITY,
    LABELS_WITHOUT_MEANING,
    OUTCOME_HORIZONS,
    PERIOD,
    PROXY_POLICY,
    SOURCE_POLICIES,
    THEME,
)
from themelens.functions.numeric import count_where, first_match
from themelens.operators.ordering import average_rank_percentiles

MARKET = {
    "product_share": "market_size_product_share_percentile",
    "downloads_share": "market_size_downloads_share_percentile",
    "revenue_usd_share": "market_size_observable_revenue_share_percentile",
}
COMPETITION = {
    "downloads_product_hhi": "competitive_downloads_hhi_percentile",
    "revenue_usd_product_hhi": "competitive_observable_revenue_hhi_percentile",
    "downloads_top_10_positive_contribution_share": "competitive_downloads_top10_growth_percentile",
    "revenue_usd_top_10_positive_contribution_share": "competitive_observable_revenue_top10_growth_percentile",
}
SEASONALITY = {
    "downloads_seasonality_amplitude": "_season_downloads",
    "revenue_usd_seasonality_amplitude": "_season_revenue_usd",
}
POSITIVE_GROWTH = ("balanced_growth", "observable_revenue_growth_support")
STEADY_GROWTH = ("durable_established", "cautious_recovery")
BANDS = ("stability_band_6m", "stability_band_12m", "stability_band_36m")
HIGH = 0.80


def population_violations(
    structure: DataFrame, summaries: DataFrame, optional: dict[str, DataFrame]
) -> DataFrame:
    """Theme months that structure and summaries do not share, and optional evidence outside of them."""
    ours, theirs = structure.select(*THEME), summaries.select(*THEME)
    found = (
        ours.join(theirs, THEME, "left_anti")
        .withColumn("violation", F.lit("structure_without_summary"))
        .unionByName(
            theirs.join(ours, THEME, "left_anti").withColumn("violation", F.lit("summary_without_structure"))
        )
    )
    for name, table in optional.items():
        extra = table.select(*THEME).distinct().join(theirs, THEME, "left_anti")
        found = found.unionByName(extra.withColumn("violation", F.lit(f"{name}_outside_population")))
    return found


def decision_population(
    structure: DataFrame, summaries: DataFrame, growth: DataFrame, proxies: DataFrame, scores: DataFrame
) -> DataFrame:
    """One row per target theme month with the evidence every rule reads; optional parts may be missing."""
    return (
        structure.select(
            *THEME,
            "product_count",
            *MARKET,
            "downloads_product_hhi",
            "revenue_usd_product_hhi",
            "revenue_usd_coverage_count",
            "revenue_usd_sum",
        )
        .join(
            summaries.select(
                *THEME,
                "lifecycle_stage",
                "has_12m_history",
                *BANDS,
                *[f"median_normalized_slope_{h}m" for h in (6, 12, 36)],
                *SEASONALITY,
            ),
            THEME,
        )
        .join(
            growth.select(
                *THEME,
                F.lit(True).alias("_has_growth"),
                "market_new_entry_share",
                "top_500_turnover_rate",
                "downloads_top_10_positive_contribution_share",
                "revenue_usd_top_10_positive_contribution_share",
                F.col("revenue_usd_current_coverage_count").alias("_growth_coverage"),
                F.col("revenue_usd_current_sum").alias("_growth_sum"),
            ),
            THEME,
            "left",
        )
        .join(
            proxies.select(
                *THEME,
                F.lit(True).alias("_has_proxy"),
                F.col("observable_revenue_usd_coverage_count").alias("_proxy_coverage"),
                F.col("product_count").alias("_proxy_products"),
            ),
            THEME,
            "left",
        )
        .join(scores.select(*THEME, F.col("trend_score").alias("legacy_6m_momentum_score")), THEME, "left")
        .withColumn("_has_proxy", F.coalesce("_has_proxy", F.lit(False)))
    )


def cross_theme_percentiles(population: DataFrame) -> DataFrame:
    """0..1 percentiles among the themes of a month: market size, competition, seasonality."""
    features = {alias: F.col(name) for name, alias in {**MARKET, **COMPETITION, **SEASONALITY}.items()}
    return average_rank_percentiles(population, PERIOD, THEME, features)


def _count(columns: list[Column], test) -> Column:
    parts = [F.coalesce(test(column), F.lit(False)).cast("int") for column in columns]
    added = parts[0]
    for part in parts[1:]:
        added = added + part
    return added


def market_size_band() -> Column:
    values = [F.col(alias) for alias in MARKET.values()]
    return first_match(
        (_count(values, lambda v: v.isNotNull()) < 2, "insufficient_evidence"),
        (_count(values, lambda v: v >= HIGH) >= 2, "strong"),
        (_count(values, lambda v: v >= 0.50) >= 2, "moderate"),
        otherwise="limited",
    )


def competitive_risk_band() -> Column:
    values = [F.col(alias) for alias in COMPETITION.values()]
    available = _count(values, lambda v: v.isNotNull())
    high = _count(values, lambda v: v >= HIGH)
    return first_match(
        (high >= 2, "higher_structural_risk"),
        ((available >= 3) & (high == 0) & (_count(values, lambda v: v <= 0.50) >= 2), "lower_structural_risk"),
        (available >= 2, "mixed_structural_risk"),
        otherwise="insufficient_evidence",
    )


def growth_quality() -> Column:
    return first_match(*[(F.col("lifecycle_stage") == stage, state) for stage, state in GROWTH_QUALITY.items()])


def decision_confidence() -> Column:
    market = _count([F.col(name) for name in MARKET], lambda v: v.isNotNull())
    competition = _count([F.col(name) for name in COMPETITION], lambda v: v.isNotNull())
    known = F.col("lifecycle_stage") != "insufficient_history"
    return first_match(
        (
            (market == 3)
            & F.col("has_12m_history")
            & known
            & (competition >= 3)
            & (F.col("category_fit_summary") == "validated_fit"),
            "high",
        ),
        ((market >= 2) & known & (competition >= 2), "medium"),
        otherwise="low",
    )


def volatile_source() -> Column:
    """Name of the first volatile stability band, NULL when none is."""
    return F.coalesce(*[F.when(F.col(band) == "volatile", F.lit(band)) for band in BANDS])


def recommendation() -> Column:
    size, growth, risk = F.col("market_size_band"), F.col("growth_quality_state"), F.col("competitive_structure_risk_band")
    stage = F.col("lifecycle_stage")
    higher = risk == "higher_structural_risk"
    return first_match(
        ((stage == "declining") & ((size == "limited") | higher), "deprioritize"),
        (
            (size == "insufficient_evidence")
            | (growth == "insufficient_evidence")
            | (stage == "mixed")
            | F.col("_volatile")
            | F.col("_meaningless"),
            "monitor",
        ),
        (growth == "experimental_emerging", "small_experiment"),
        (
            (size == "strong") & growth.isin(*POSITIVE_GROWTH) & ~higher & (F.col("confidence") != "low"),
            "prioritize_validation",
        ),
        (
            ((size == "strong") & growth.isin(*STEADY_GROWTH))
            | ((size == "moderate") & growth.isin(*POSITIVE_GROWTH)),
            "selective_validation",
        ),
        otherwise="monitor",
    )


def primary_reason() -> Column:
    size, stage = F.col("market_size_band"), F.col("lifecycle_stage")
    return first_match(
        ((size == "insufficient_evidence") | (stage == "insufficient_history"), "insufficient_evidence"),
        ((stage == "mixed") | F.col("_volatile"), "mixed_or_volatile_evidence"),
        (stage == "declining", "declining_evidence"),
        (stage == "emerging", "emerging_requires_experiment"),
        (stage == "accelerating", "observable_revenue_growth_evidence"),
        (stage == "growing", "balanced_growing_evidence"),
        (stage == "mature", "durable_established_market"),
        (stage == "recovering", "recovery_requires_validation"),
        (size == "strong", "strong_current_market_scale"),
        otherwise="insufficient_evidence",
    )


def next_action() -> Column:
    advice = F.col("recommendation")
    return first_match(
        (advice == "prioritize_validation", "prioritize_theme_validation"),
        (advice == "selective_validation", "run_selective_concept_validation"),
        (advice == "small_experiment", "run_small_controlled_experiment"),
        (advice == "deprioritize", "deprioritize_current_theme"),
        (F.col("_has_migration"), "validate_migration_hypothesis"),
        (F.col("category_fit_summary") != "validated_fit", "validate_category_fit"),
        otherwise="monitor_next_completed_month",
    )


def launch_state() -> Column:
    size, growth = F.col("market_size_band"), F.col("growth_quality_state")
    stage = F.col("lifecycle_stage")
    blocked = (
        (size == "insufficient_evidence")
        | (F.col("competitive_structure_risk_band") == "higher_structural_risk")
        | F.col("_volatile")
        | F.col("_meaningless")
    )
    return first_match(
        ((stage == "emerging") & ~blocked, "experimental_window"),
        (blocked | stage.isin("declining", "mixed", "insufficient_history"), "caution_or_monitor"),
        ((size == "strong") & growth.isin(*POSITIVE_GROWTH), "supported_validation_window"),
        ((size == "moderate") | growth.isin(*STEADY_GROWTH), "selective_validation_window"),
        otherwise="caution_or_monitor",
    )


def launch_reason() -> Column:
    stage = F.col("lifecycle_stage")
    return first_match(
        (F.col("evidence_state") != "caution_or_monitor", F.col("primary_reason_code")),
        (stage == "declining", "declining_evidence"),
        (stage == "insufficient_history", "insufficient_evidence"),
        (stage == "mixed", "mixed_or_volatile_evidence"),
        otherwise=F.col("primary_reason_code"),
    )


def category_fits(
    summaries: DataFrame, dimensions: DataFrame, leaders: DataFrame
) -> DataFrame:
    """Sub-genre fit of each target theme from its trailing twelve months of label rows.

    Each label row serves the twelve target months that can see it, so one grouped pass covers all targets.
    """
    targets = summaries.select(*THEME)
    twelve = F.sequence(F.lit(0), F.lit(11))
    observed = (
        dimensions.where(F.col("dimension_type") == "game_subgenre")
        .select(
            "scope_name",
            "cadence",
            "game_theme",
            F.col("dimension_value").alias("game_subgenre"),
            F.explode(twelve).alias("_age"),
            F.col("period_start").alias("_seen"),
            "product_count",
            "downloads_coverage_count",
            "downloads_sum",
            "revenue_usd_coverage_count",
            "revenue_usd_sum",
        )
        .withColumn("period_start", F.add_months("_seen", F.col("_age")))
        .join(targets, ["scope_name", "cadence", "game_theme", "period_start"])
    )
    keys = [*THEME, "game_subgenre"]
    now = F.col("_age") == 0

    def current(name: str) -> Column:
        return F.max(F.when(now, F.col(name)))

    # A label row is unique per month, so counting rows counts distinct months.
    grouped = observed.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("observation_month_count"),
        count_where(now).alias("_now"),
        F.coalesce(current("product_count"), F.lit(0)).alias("target_month_product_count"),
        current("downloads_coverage_count").alias("target_month_downloads_coverage_count"),
        current("downloads_sum").alias("target_month_downloads_sum"),
        current("revenue_usd_coverage_count").alias("target_month_observable_revenue_coverage_count"),
        current("revenue_usd_sum").alias("target_month_observable_revenue_usd_sum"),
    )
    supporting = (
        leaders.where(F.col("game_subgenre").isNotNull())
        .select(*keys, "unified_app_id")
        .distinct()
        .groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("_supporting"))
    )
    # Leader rows of any target theme within the trailing year make leader evidence available.
    available = (
        leaders.select("scope_name", "cadence", "game_theme", F.col("period_start").alias("_seen"))
        .distinct()
        .withColumn("_age", F.explode(twelve))
        .withColumn("period_start", F.add_months("_seen", F.col("_age")))
        .join(targets, ["scope_name", "cadence", "game_theme", "period_start"], "left_semi")
        .select("scope_name", "cadence", "period_start", F.lit(True).alias("_available"))
        .distinct()
    )
    products, months = F.col("target_month_product_count"), F.col("observation_month_count")
    downloads, added = F.col("target_month_downloads_coverage_count"), F.col("target_month_downloads_sum")
    revenue = F.col("target_month_observable_revenue_coverage_count")
    revenue_sum = F.col("target_month_observable_revenue_usd_sum")
    has_downloads = F.coalesce((downloads > 0) & (added > 0), F.lit(False))
    no_revenue = revenue.isNull() | revenue_sum.isNull()
    limits = F.array_compact(
        F.array(
            F.when(F.col("_now") == 0, F.lit("target_month_not_observed")),
            F.when(months < 3, F.lit("insufficient_observation_history")),
            F.when(products < 2, F.lit("insufficient_target_product_count")),
            F.when(~has_downloads, F.lit("insufficient_downloads_evidence")),
            F.when(no_revenue, F.lit("observable_revenue_unavailable")).when(
                revenue < products, F.lit("observable_revenue_coverage_gap")
            ),
            F.when(F.col("supporting_representative_product_count").isNull(), F.lit("representative_evidence_unavailable")),
        )
    )
    valid = (F.col("_now") > 0) & (products >= 2) & (months >= 3) & has_downloads
    return (
        grouped.join(supporting, keys, "left")
        .join(available, ["scope_name", "cadence", "period_start"], "left")
        .withColumn(
            "supporting_representative_product_count",
            F.when(F.col("_available"), F.coalesce("_supporting", F.lit(0))),
        )
        .select(
            *THEME,
            F.lit(DECISION_POLICY).alias("decision_policy_version"),
            "game_subgenre",
            F.when(valid, "validated_fit").otherwise("observed_fit").alias("fit_state"),
            "observation_month_count",
            "target_month_product_count",
            "target_month_downloads_coverage_count",
            "target_month_downloads_sum",
            "target_month_observable_revenue_coverage_count",
            "target_month_observable_revenue_usd_sum",
            "supporting_representative_product_count",
            limits.alias("evidence_limitations"),
        )
    )


def category_fit_summary(fits: DataFrame) -> DataFrame:
    """Best fit state of a theme month, and whether its rows carry revenue evidence."""
    validated = count_where(F.col("fit_state") == "validated_fit")
    return fits.groupBy(*THEME).agg(
        F.when(validated > 0, "validated_fit").otherwise("observed_fit").alias("category_fit_summary"),
        ((validated > 0) & (validated < F.count(F.lit(1)))).alias("_has_migration"),
        (
            count_where(
                F.col("target_month_observable_revenue_coverage_count").isNotNull()
                | F.col("target_month_observable_revenue_usd_sum").isNotNull()
            )
            > 0
        ).alias("_fit_revenue"),
    )


def migration_hypotheses(fits: DataFrame) -> DataFrame:
    """Validated sub-genre -> observed sub-genre of the same theme month, each needing product validation."""
    source = fits.where(F.col("fit_state") == "validated_fit").select(
        *THEME, F.col("game_subgenre").alias("validated_source_game_subgenre")
    )
    target = fits.where(F.col("fit_state") == "observed_fit").select(
        *THEME, F.col("game_subgenre").alias("target_observed_game_subgenre")
    )
    return source.join(target, THEME).select(
        *THEME,
        F.lit(DECISION_POLICY).alias("decision_policy_version"),
        "validated_source_game_subgenre",
        "target_observed_game_subgenre",
        F.lit("requires_product_validation").alias("hypothesis_status"),
        F.array(F.lit("validated_source_fit"), F.lit("observed_target_fit")).alias("supporting_evidence_codes"),
        F.array(F.lit("migration_not_validated")).alias("risk_limitation_codes"),
        F.lit(False).alias("is_validated_fit"),
        F.lit(True).alias("requires_product_validation"),
    )


def revenue_evidence_used() -> Column:
    """Whether any evidence of the theme month uses observable revenue."""
    structure = (
        (F.col("revenue_usd_coverage_count") > 0)
        | F.col("revenue_usd_sum").isNotNull()
        | F.col("revenue_usd_share").isNotNull()
        | F.col("revenue_usd_product_hhi").isNotNull()
    )
    growth = (
        F.coalesce(F.col("_growth_coverage") > 0, F.lit(False))
        | F.col("_growth_sum").isNotNull()
        | F.col("revenue_usd_top_10_positive_contribution_share").isNotNull()
    )
    return F.col("_has_proxy") | structure | growth | F.col("_fit_revenue")


def policy_references() -> Column:
    base = [F.lit(name) for name in SOURCE_POLICIES]
    return F.when(F.col("revenue_evidence_used"), F.array(*base, F.lit(PROXY_POLICY))).otherwise(F.array(*base))


def assess(population: DataFrame, fits: DataFrame) -> DataFrame:
    """Every band, gate and reason of a theme month in one wide row; the output tables select from it."""
    return (
        population.join(cross_theme_percentiles(population), THEME, "left")
        .join(category_fit_summary(fits), THEME, "left")
        .withColumns(
            {
                "category_fit_summary": F.coalesce("category_fit_summary", F.lit("insufficient_evidence")),
                "_has_migration": F.coalesce("_has_migration", F.lit(False)),
                "_fit_revenue": F.coalesce("_fit_revenue", F.lit(False)),
                "_volatile": volatile_source().isNotNull(),
                "_meaningless": F.col("game_theme").isin(*LABELS_WITHOUT_MEANING),
                "market_size_band": market_size_band(),
                "competitive_structure_risk_band": competitive_risk_band(),
                "growth_quality_state": growth_quality(),
            }
        )
        .withColumns({"confidence": decision_confidence(), "revenue_evidence_used": revenue_evidence_used()})
        .withColumns(
            {
                "recommendation": recommendation(),
                "primary_reason_code": primary_reason(),
                "evidence_state": launch_state(),
                "source_policy_references": policy_references(),
            }
        )
        .withColumns({"next_validation_action_code": next_action(), "reason_code": launch_reason()})
    )


def decision_summaries(assessed: DataFrame) -> DataFrame:
    return assessed.select(
        *THEME,
        F.lit(DECISION_POLICY).alias("decision_policy_version"),
        "market_size_band",
        "growth_quality_state",
        "competitive_structure_risk_band",
        "category_fit_summary",
        "confidence",
        "recommendation",
        "primary_reason_code",
        "next_validation_action_code",
        "source_policy_references",
        *MARKET.values(),
        *COMPETITION.values(),
        F.col("market_new_entry_share").alias("current_market_new_entry_share"),
        F.col("top_500_turnover_rate").alias("current_top_500_turnover_rate"),
        *[F.col(f"median_normalized_slope_{h}m").alias(f"downloads_trend_slope_{h}m") for h in (6, 12, 36)],
        "downloads_seasonality_amplitude",
        F.col("revenue_usd_seasonality_amplitude").alias("observable_revenue_seasonality_amplitude"),
        "legacy_6m_momentum_score",
    )


def launch_window_assessments(assessed: DataFrame) -> DataFrame:
    """Three rows per theme month, one per horizon; evidence states, never forecasts."""
    return assessed.select(
        *THEME,
        F.lit(DECISION_POLICY).alias("decision_policy_version"),
        F.explode(F.array(*[F.lit(h) for h in OUTCOME_HORIZONS])).alias("horizon_months"),
        "evidence_state",
        "confidence",
        "reason_code",
        F.lit(False).alias("is_forecast"),
        "source_policy_references",
    )


def _first_high(names: list[str], reported: list[str] | None = None) -> Column:
    labels = reported or names
    return F.coalesce(*[F.when(F.col(n) >= HIGH, F.lit(label)) for n, label in zip(names, labels)])


def risk_rows(assessed: DataFrame) -> DataFrame:
    """Up to thirteen coded risks per theme month with severity, availability and source metric."""
    stage = F.col("lifecycle_stage")
    competition = list(COMPETITION.values())
    hhi, top10 = _first_high(competition[:2]), _first_high(competition[2:])
    season = _first_high(list(SEASONALITY.values()), list(SEASONALITY))
    market = _count([F.col(name) for name in MARKET], lambda v: v.isNotNull())
    used, has_proxy = F.col("revenue_evidence_used"), F.col("_has_proxy")
    gap = (F.col("revenue_usd_coverage_count") < F.col("product_count")) | F.coalesce(
        F.col("_proxy_coverage") < F.col("_proxy_products"), F.lit(False)
    )

    def risk(condition: Column, code: str, severity, availability, source) -> Column:
        def column(value):
            return value if isinstance(value, Column) else F.lit(value).cast("string")

        return F.when(
            condition,
            F.struct(
                F.lit(code).alias("risk_code"),
                column(severity).alias("severity"),
                column(availability).alias("evidence_availability"),
                column(source).alias("source_metric_name"),
            ),
        )

    risks = F.array(
        risk(F.col("_volatile"), "volatile_evidence", "high", "observed", volatile_source()),
        risk(stage == "mixed", "mixed_lifecycle", "medium", "observed", "lifecycle_stage"),
        risk(stage == "declining", "declining_lifecycle", "high", "observed", "lifecycle_stage"),
        risk(hhi.isNotNull(), "high_product_concentration", "high", "observed", hhi),
        risk(top10.isNotNull(), "top10_growth_concentration", "medium", "observed", top10),
        risk(season.isNotNull(), "seasonality_timing_dependence", "medium", "observed", season),
        risk(
            F.col("market_size_band") == "insufficient_evidence",
            "insufficient_market_evidence",
            F.when(market == 0, "high").otherwise("medium"),
            F.when(market == 0, "unavailable").otherwise("partial"),
            None,
        ),
        risk(
            (stage == "insufficient_history") | ~F.col("has_12m_history"),
            "insufficient_model_history",
            "medium",
            "partial",
            "has_12m_history",
        ),
        risk(F.col("_meaningless"), "non_actionable_theme_label", "medium", "observed", "game_theme"),
        risk(
            used,
            "observable_revenue_only",
            "low",
            "observed",
            F.when(F.col("revenue_usd_share").isNotNull(), "revenue_usd_share").otherwise("revenue_absolute"),
        ),
        risk(
            used,
            "monetization_type_unverified",
            "medium",
            F.when(has_proxy, "partial").otherwise("unavailable"),
            F.when(has_proxy, "monetization_proxy").otherwise("revenue_absolute"),
        ),
        risk(
            used & gap,
            "observable_revenue_coverage_gap",
            "medium",
            "partial",
            "observable_revenue_coverage_count",
        ),
        risk(F.col("_has_migration"), "migration_not_validated", "medium", "partial", "game_subgenre_fit"),
    )
    return assessed.select(
        *THEME,
        F.lit(DECISION_POLICY).alias("decision_policy_version"),
        F.explode(risks).alias("_r"),
    ).where(F.col("_r").isNotNull()).select(*THEME, "decision_policy_version", "_r.*")


def decision_distributions(summaries: DataFrame) -> DataFrame:
    """Row counts per recommendation, confidence, market size and growth quality of each month."""
    kinds = {
        "recommendation": "recommendation",
        "confidence": "confidence",
        "market_size": "market_size_band",
        "growth_quality": "growth_quality_state",
    }
    entries = F.array(*[F.struct(F.lit(k).alias("distribution"), F.col(c).alias("value")) for k, c in kinds.items()])
    return (
        summaries.select(*PERIOD, F.explode(entries).alias("_e"))
        .groupBy(*PERIOD, "_e.distribution", "_e.value")
        .agg(F.count(F.lit(1)).alias("row_count"))
    )
