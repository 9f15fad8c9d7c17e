"""Fixed values of the analytics contract (thresholds, labels, policy names)."""

from __future__ import annotations

# Period and grouping keys.
PERIOD = ["scope_name", "cadence", "period_start", "period_end"]
THEME = [*PERIOD, "game_theme"]
SERIES = ["scope_name", "cadence", "game_theme"]

# The two measures: (source column, output prefix).
MEASURES = (("units_absolute", "downloads"), ("revenue_absolute", "revenue_usd"))

DIMENSIONS = ("game_subgenre", "game_product_model", "game_art_style", "game_setting")
LABELS_WITHOUT_MEANING = ("", "Unknown", "N/A")

# Keys of the free-form tag map and the fact column each one fills.
TAG_COLUMNS = {
    "Game Theme": "game_theme",
    "Game Genre": "game_genre",
    "Game Sub-genre": "game_subgenre",
    "Game Product Model": "game_product_model",
    "Game Art Style": "game_art_style",
    "Game Setting": "game_setting",
    "Publisher Country": "publisher_country",
    "Most Popular Country by Revenue": "most_popular_country_by_revenue",
    "Is Unified": "is_unified_source_value",
}
TAG_DATES = {
    "Earliest Release Date": "earliest_release_date",
    "Release Date (WW)": "release_date_ww",
}
NUMERIC_MEASURES = (
    "current_units_value",
    "units_absolute",
    "comparison_units_value",
    "units_delta",
    "units_transformed_delta",
    "current_revenue_value",
    "revenue_absolute",
    "comparison_revenue_value",
    "revenue_delta",
    "revenue_transformed_delta",
    "absolute",
    "delta",
    "transformed_delta",
)

# Six-month score.
GROWTH_WEIGHT, ACCELERATION_WEIGHT, NEW_PRODUCT_WEIGHT, CONCENTRATION_WEIGHT = 0.45, 0.30, 0.25, 0.20
CONFIDENCE_WEIGHTS = {"history": 0.25, "size": 0.25, "units": 0.20, "revenue": 0.20, "publisher": 0.10}
MIN_ACTIONABLE_PRODUCTS = 5
MIN_ACTIVE_MONTHS = 3

# Multi-horizon model.
HORIZONS = (6, 12, 36)
MODEL_METRICS = (
    "product_count",
    "product_share",
    "downloads_sum",
    "downloads_share",
    "revenue_usd_sum",
    "revenue_usd_share",
)
SHARE_METRICS = ("product_share", "downloads_share", "revenue_usd_share")
FLAT_SLOPE = 0.005
MIN_R_SQUARED = 0.20
STABLE_CV, VARIABLE_CV = 0.15, 0.35
ACCELERATION_MARGIN = 0.005
SEASON_MIN_MONTHS, SEASON_MAX_MONTHS = 24, 36
MODEL_POLICY = "MODEL002_V1"

# Backtest.
OUTCOME_HORIZONS = (1, 2, 3)
BACKTEST_POLICY = "BACKTEST001_V1"
TOP_FRACTION = 0.20
MIN_COHORT = 5
LOW_SAMPLE_ROWS, LOW_SAMPLE_MONTHS = 30, 6
WILSON_Z = 1.959963984540054
OUTCOMES = (
    "future_downloads_share",
    "future_revenue_usd_share",
    "downloads_share_absolute_change",
    "revenue_usd_share_absolute_change",
)
CHANGE_OUTCOMES = OUTCOMES[2:]
# (feature name, group, higher or lower is better, column of the outcome table)
FEATURES = (
    ("decision_product_share", "market_size_baseline", "higher_better", "decision_product_share"),
    ("decision_downloads_share", "market_size_baseline", "higher_better", "decision_downloads_share"),
    ("decision_revenue_usd_share", "market_size_baseline", "higher_better", "decision_revenue_usd_share"),
    ("legacy_6m_momentum_score", "legacy_baseline", "higher_better", "legacy_6m_momentum_score"),
    ("median_normalized_slope_6m", "model_trend", "higher_better", "median_normalized_slope_6m"),
    ("median_normalized_slope_12m", "model_trend", "higher_better", "median_normalized_slope_12m"),
    ("median_normalized_slope_36m", "model_trend", "higher_better", "median_normalized_slope_36m"),
    ("stability_cv_median_6m", "model_stability", "lower_better", "stability_cv_median_6m"),
    ("stability_cv_median_12m", "model_stability", "lower_better", "stability_cv_median_12m"),
    ("stability_cv_median_36m", "model_stability", "lower_better", "stability_cv_median_36m"),
    ("downloads_product_hhi", "competition", "lower_better", "decision_downloads_product_hhi"),
    ("revenue_usd_product_hhi", "competition", "lower_better", "decision_revenue_usd_product_hhi"),
    ("top_500_turnover_rate", "competition", "higher_better", "decision_top_500_turnover_rate"),
    (
        "downloads_market_new_entry_share_of_current",
        "new_entry",
        "higher_better",
        "decision_downloads_market_new_entry_share_of_current",
    ),
    (
        "revenue_usd_market_new_entry_share_of_current",
        "new_entry",
        "higher_better",
        "decision_revenue_usd_market_new_entry_share_of_current",
    ),
    (
        "downloads_top_10_positive_contribution_share",
        "growth_breadth",
        "lower_better",
        "decision_downloads_top_10_positive_contribution_share",
    ),
    (
        "revenue_usd_top_10_positive_contribution_share",
        "growth_breadth",
        "lower_better",
        "decision_revenue_usd_top_10_positive_contribution_share",
    ),
    (
        "downloads_expected_seasonal_index",
        "seasonality",
        "higher_better",
        "decision_downloads_expected_seasonal_index",
    ),
    (
        "revenue_usd_expected_seasonal_index",
        "seasonality",
        "higher_better",
        "decision_revenue_usd_expected_seasonal_index",
    ),
)
SEGMENTS = (
    "legacy_actionability",
    "direction_6m",
    "direction_12m",
    "direction_36m",
    "stability_band_6m",
    "stability_band_12m",
    "stability_band_36m",
    "lifecycle_stage",
)

# Revenue proxy.
PROXY_CLASSES = ("iaa_candidate", "iap_or_hybrid_candidate", "unknown")
PROXY_POLICY = "MONETIZATION001_OBSERVABLE_REVENUE_PROXY_V1"

# Decisions.
DECISION_POLICY = "DECISION001_V1"
SOURCE_POLICIES = ("AGG002_V1", MODEL_POLICY, BACKTEST_POLICY)
GROWTH_QUALITY = {
    "growing": "balanced_growth",
    "accelerating": "observable_revenue_growth_support",
    "mature": "durable_established",
    "emerging": "experimental_emerging",
    "recovering": "cautious_recovery",
    "declining": "declining",
    "mixed": "mixed_or_uncertain",
    "insufficient_history": "insufficient_evidence",
}
LEADER_TYPES = (
    "downloads_leader",
    "revenue_leader",
    "market_new_entry_downloads_leader",
    "market_new_entry_revenue_leader",
    "downloads_growth_leader",
    "revenue_growth_leader",
)

# Table reconciliation.
MANAGED_KEY_PREFIX = "managed:v1"
NUMERIC_TOLERANCE = 1e-9
SYNC_FIELDS = (
    ("period_start", "date"),
    ("game_theme", "text"),
    ("is_latest_month", "checkbox"),
    ("is_actionable", "checkbox"),
    ("exclusion_reason", "text"),
    ("trend_rank", "number"),
    ("trend_score", "number"),
    ("confidence_score", "number"),
    ("growth_score", "number"),
    ("acceleration_score", "number"),
    ("new_product_score", "number"),
    ("concentration_penalty", "number"),
    ("latest_product_count", "number"),
    ("latest_product_share", "number"),
    ("latest_units_absolute_share", "number"),
    ("latest_revenue_absolute_share", "number"),
    ("recent3_new_entry_share", "number"),
    ("median_rank_improvement", "number"),
    ("units_absolute_overindex", "number"),
    ("revenue_absolute_overindex", "number"),
    ("calculated_at", "date-time"),
)

# Members of enumerated columns.
_DIRECTIONS = ("up", "down", "flat", "mixed", "insufficient_history")
_STABILITY = ("stable", "variable", "volatile", "insufficient_history")
_CHANGES = ("up", "down", "unchanged", "unavailable")
_FITS = ("validated_fit", "observed_fit", "insufficient_evidence")
_CONFIDENCE = ("low", "medium", "high")
MEMBERS: dict[str, tuple[str | int, ...]] = {
    "cadence": ("monthly",),
    "dimension_type": DIMENSIONS,
    "evidence_type": LEADER_TYPES,
    "metric_name": MODEL_METRICS,
    "horizon_month_count": HORIZONS,
    "outcome_horizon_months": OUTCOME_HORIZONS,
    "horizon_months": OUTCOME_HORIZONS,
    "window_month_count": (6,),
    "outcome_name": OUTCOMES,
    "segment_name": SEGMENTS,
    "feature_hypothesis": ("higher_better", "lower_better"),
    "model_policy_version": (MODEL_POLICY,),
    "backtest_policy_version": (BACKTEST_POLICY,),
    "monetization_policy_version": (PROXY_POLICY,),
    "decision_policy_version": (DECISION_POLICY,),
    "lifecycle_stage": tuple(GROWTH_QUALITY),
    "growth_quality_state": tuple(dict.fromkeys(GROWTH_QUALITY.values())),
    **{f"direction_{horizon}m": _DIRECTIONS for horizon in HORIZONS},
    **{f"stability_band_{horizon}m": _STABILITY for horizon in HORIZONS},
    **{f"{metric}_change_direction": _CHANGES for metric in SHARE_METRICS},
    "observable_revenue_state": ("unavailable", "zero", "positive"),
    "monetization_proxy": PROXY_CLASSES,
    "classification_reason": (
        "observable_revenue_unavailable",
        "observable_revenue_zero",
        "observable_revenue_positive",
    ),
    "fit_state": _FITS,
    "category_fit_summary": _FITS,
    "market_size_band": ("strong", "moderate", "limited", "insufficient_evidence"),
    "competitive_structure_risk_band": (
        "lower_structural_risk",
        "mixed_structural_risk",
        "higher_structural_risk",
        "insufficient_evidence",
    ),
    "confidence": _CONFIDENCE,
    "severity": _CONFIDENCE,
    "recommendation": (
        "prioritize_validation",
        "selective_validation",
        "small_experiment",
        "monitor",
        "deprioritize",
    ),
    "evidence_availability": ("observed", "partial", "unavailable"),
    "evidence_state": (
        "supported_validation_window",
        "selective_validation_window",
        "experimental_window",
        "caution_or_monitor",
    ),
}
