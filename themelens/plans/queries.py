"""Registered queries: one Spark plan per operator, each with its reference SQL."""

from __future__ import annotations

import datetime
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from themelens.constants import MEASURES, PERIOD, SHARE_METRICS, THEME
from themelens.functions import text
from themelens.operators import (
    backtest,
    calendar,
    decision,
    model,
    monthly,
    opportunity,
    proxy,
    quality,
    reconcile,
    rules,
    trend,
)
from themelens.plans import oracle as sql
from themelens.plans import refresh
from themelens.plans.stages import Stages, run_for
from themelens.session import scratch_dir
from themelens.sources import driver_tables, market_json
from themelens.sources.store import PeriodTable, export_sorted, only_periods, replace_period, replace_range, upsert_metadata, verified


@dataclass(frozen=True)
class Query:
    build: Callable[[Stages, SparkSession, str], DataFrame]
    reference: str | None


QUERIES: dict[str, Query] = {}


def stages_for(spark: SparkSession, sf_dir: str) -> Stages:
    return run_for(
        spark,
        sf_dir,
        lambda: (driver_tables.market_snapshots(spark, sf_dir), driver_tables.app_metadata(spark, sf_dir)),
    )


def comparable(df: DataFrame) -> DataFrame:
    """Round doubles, widen integers and join string arrays so that results compare across engines.

    Rounding is spelled out as one formula because the engines' own ``round`` treat halves differently.
    """

    def column(field: T.StructField):
        name = F.col(f"`{field.name}`")
        if isinstance(field.dataType, (T.DoubleType, T.FloatType)):
            name = F.floor(name * 1000000.0 + 0.5) / F.lit(1000000.0)
        elif isinstance(field.dataType, (T.IntegerType, T.ShortType, T.ByteType)):
            name = name.cast("bigint")
        elif isinstance(field.dataType, T.ArrayType):
            name = F.array_join(name, ",")
        return name.alias(field.name)

    return df.select(*[column(field) for field in df.schema.fields])


def simple(
    name: str,
    build: Callable[[Stages], DataFrame],
    columns: str,
    tail: str,
    *blocks: str,
    merge: str = "",
    changed: str = "",
) -> None:
    """Query over the stage tables, cut to the columns the reference SQL selects."""
    names = columns.split()
    text = sql.query(columns, tail, *blocks, merge=merge, changed=changed)
    QUERIES[name] = Query(lambda run, spark, sf_dir: build(run).select(*names), text)


TC, PC = sql.THEME_COLUMNS, sql.PERIOD_COLUMNS

# Sources of the run.
simple(
    "market_snapshots",
    lambda run: run.snapshots,
    f"{PC} rank_position source_app_id unified_app_id scope_country device_type category data_model units_absolute revenue_absolute"
    " game_theme game_genre game_subgenre game_product_model game_art_style game_setting release_date_ww",
    "FROM snap",
)
simple(
    "attach_metadata",
    lambda run: monthly.attach_metadata(run.snapshots, run.metadata),
    f"{PC} unified_app_id rank_position game_name publisher_display_name has_metadata",
    "FROM facts",
)

# Calendar.
simple("stored_months", lambda run: calendar.stored_months(run.snapshots), f"{PC} has_previous_month", "FROM months")
simple(
    "month_bounds",
    lambda run: calendar.month_bounds(
        driver_tables.table(run.spark, run.source, "orders").select("o_orderkey", "o_orderdate"), "o_orderdate"
    ).select(
        F.col("o_orderkey").alias("order_id"),
        F.col("period_start").cast("date").alias("period_start"),
        "period_end",
        calendar.is_natural_month(F.col("period_start"), F.col("period_end")).alias("is_natural_month"),
    ),
    "order_id period_start period_end is_natural_month",
    """FROM (SELECT o_orderkey AS order_id, date_trunc('month', o_orderdate)::DATE AS period_start, last_day(o_orderdate::DATE) AS period_end,
      TRUE AS is_natural_month FROM orders)""",
)
simple(
    "month_shift",
    lambda run: run.totals.select(
        *PERIOD,
        calendar.shift_month(F.col("period_start"), -1).alias("previous_start"),
        calendar.shift_month(F.col("period_start"), 3).alias("outcome_start"),
    ),
    f"{PC} previous_start outcome_start",
    "FROM (SELECT *, (period_start - INTERVAL 1 MONTH)::DATE AS previous_start, (period_start + INTERVAL 3 MONTH)::DATE AS outcome_start FROM totals)",
)
simple(
    "completed_months",
    lambda run: calendar.completed_months(
        run.totals.groupBy("scope_name").agg(
            F.min("period_start").alias("start"), F.add_months(F.max("period_start"), 6).alias("end")
        ),
        "2001-11-15",
    ),
    "scope_name period_start period_end",
    """FROM (SELECT scope_name, m::DATE AS period_start, last_day(m::DATE) AS period_end FROM
      (SELECT scope_name, unnest(generate_series(min(period_start)::TIMESTAMP, (max(period_start) + INTERVAL 6 MONTH)::TIMESTAMP, INTERVAL 1 MONTH)) AS m
       FROM totals GROUP BY 1) WHERE m < TIMESTAMP '2001-11-01')""",
)
simple(
    "month_gaps",
    lambda run: calendar.month_gaps(run.snapshots.where(F.month("period_start") != 6)),
    "scope_name cadence period_start previous_start",
    """FROM (SELECT scope_name, cadence, period_start, lag(period_start) OVER (ORDER BY period_start) AS previous_start
      FROM (SELECT DISTINCT scope_name, cadence, period_start FROM snap WHERE month(period_start) <> 6))
    WHERE previous_start <> period_start - INTERVAL 1 MONTH""",
)
simple(
    "theme_month_grid",
    lambda run: trend.score_grid(run.totals, run.themes).select(
        *THEME, "month_index", F.col("is_present"), "product_count", "product_share", "units_absolute_share", "revenue_absolute_share", "new_entry_share"
    ),
    f"{TC} month_index is_present product_count product_share units_absolute_share revenue_absolute_share new_entry_share",
    """FROM (SELECT * EXCLUDE (present), present AS is_present, pc AS product_count, ps AS product_share, us AS units_absolute_share,
      rs AS revenue_absolute_share, ns AS new_entry_share FROM cells)""",
)
simple(
    "previous_month_pair",
    lambda run: run.facts.select(
        *PERIOD,
        "unified_app_id",
        "has_previous_month",
        F.col("previous.rank_position").alias("previous_rank_position"),
        F.col("previous.units_absolute").alias("previous_downloads"),
        F.col("is_market_new").alias("is_market_new_entry"),
    ),
    f"{PC} unified_app_id has_previous_month previous_rank_position previous_downloads is_market_new_entry",
    "FROM (SELECT *, prev_rank AS previous_rank_position, prev_units AS previous_downloads, is_new AS is_market_new_entry FROM facts)",
)
simple(
    "planned_target_counts",
    lambda run: calendar.planned_target_counts(
        run.totals.unionByName(run.totals.where("year(period_start) = 1995").withColumn("cadence", F.lit("weekly")))
    ),
    "scope_name cadence window_months outcome_horizon_months target_count",
    """FROM (SELECT scope_name, cadence, w AS window_months, h AS outcome_horizon_months, greatest(0, n - w + 1 - h) AS target_count
      FROM (SELECT scope_name, cadence, count(*) AS n FROM totals GROUP BY 1, 2
        UNION ALL SELECT scope_name, 'weekly', count(*) FROM totals WHERE year(period_start) = 1995 GROUP BY 1), (SELECT unnest([6, 12, 24, 36]) AS w), (SELECT unnest([0, 1, 2, 3]) AS h))""",
)

# Monthly aggregation.
TOTAL_COLUMNS = (
    f"{PC} snapshot_count theme_present_count theme_missing_count metadata_coverage_count units_absolute_coverage_count"
    " units_absolute_sum revenue_absolute_coverage_count revenue_absolute_sum"
)
simple("monthly_market_totals", lambda run: monthly.monthly_market_totals(run.facts), TOTAL_COLUMNS, "FROM totals")
THEME_METRICS = (
    f"{TC} product_count product_share top_100_count top_500_count average_rank median_rank units_absolute_coverage_count units_absolute_sum"
    " units_absolute_share revenue_absolute_coverage_count revenue_absolute_sum revenue_absolute_share has_previous_month new_entry_count"
    " returning_product_count new_entry_share publisher_coverage_count publisher_count top_publisher_product_share"
)
simple("theme_monthly_metrics", lambda run: monthly.theme_monthly_metrics(run.facts, run.totals), THEME_METRICS, "FROM themes")
simple(
    "new_vs_returning",
    lambda run: monthly.new_and_returning(run.facts),
    f"{TC} has_previous_month new_entry_count returning_product_count new_entry_share",
    "FROM themes",
)
simple(
    "publisher_concentration",
    lambda run: monthly.publisher_concentration(run.facts),
    f"{TC} publisher_coverage_count publisher_count top_publisher_product_share",
    "FROM publisher_heads",
)

# Opportunity evidence.
simple("market_structure", lambda run: opportunity.market_structure(run.facts, run.totals), sql.STRUCTURE_COLUMNS, "FROM structure")
simple("top_k_share", lambda run: opportunity.top_k_share(run.facts), f"{TC} {sql.PRODUCT_COLUMNS}", "FROM product_stats")
simple(
    "product_hhi", lambda run: opportunity.herfindahl(run.facts), f"{TC} downloads_product_hhi revenue_usd_product_hhi", "FROM product_stats"
)
simple(
    "publisher_metric_concentration",
    lambda run: opportunity.publisher_concentrations(run.facts),
    f"{TC} " + " ".join(f"top_1_publisher_{m}_share top_3_publisher_{m}_share publisher_{m}_hhi" for _, m in MEASURES),
    "FROM publisher_stats",
)
simple(
    "publisher_product_concentration",
    lambda run: opportunity.publisher_concentrations(run.facts),
    f"{TC} publisher_coverage_count publisher_count top_1_publisher_product_share top_3_publisher_product_share publisher_product_hhi",
    f"FROM publisher_stats JOIN publisher_heads USING ({sql.KT})",
)
simple(
    "product_age",
    lambda run: opportunity.product_age(run.facts),
    f"{TC} release_date_ww_coverage_count release_date_ww_coverage_ratio release_date_ww_valid_age_count release_date_ww_future_count"
    " median_product_age_days downloads_top_10_median_product_age_days revenue_usd_top_10_median_product_age_days",
    f"FROM ages LEFT JOIN product_stats USING ({sql.KT})",
)
simple(
    "top_metric_rows",
    lambda run: opportunity.leaders(run.facts).select(
        *THEME, "unified_app_id", F.col("measure").alias("metric_name"), F.col("value").alias("amount"), "leader_rank"
    ),
    f"{TC} unified_app_id metric_name amount leader_rank",
    "FROM (SELECT *, measure AS metric_name, v AS amount FROM ordered) WHERE leader_rank <= 10",
)
MEMBERSHIP = " ".join(opportunity.MEMBERSHIP_COLUMNS)
simple("growth_membership", lambda run: opportunity.growth_membership(run.facts), f"{TC} {MEMBERSHIP}", "FROM growth")
simple("turnover", lambda run: opportunity.turnover(run.facts), f"{TC} {' '.join(opportunity.TURNOVER_COLUMNS)}", "FROM growth")
simple("top10_retention", lambda run: opportunity.top_ten_retention(run.facts), f"{TC} {' '.join(opportunity.RETENTION_COLUMNS)}", "FROM growth")
simple(
    "growth_decomposition",
    lambda run: opportunity.growth_decomposition(run.facts),
    f"{TC} {' '.join(opportunity.DECOMPOSITION_COLUMNS)}",
    "FROM growth",
)
simple(
    "growth_sources",
    lambda run: opportunity.growth_sources(run.facts),
    f"{TC} {MEMBERSHIP} {' '.join(opportunity.TURNOVER_COLUMNS + opportunity.RETENTION_COLUMNS + opportunity.DECOMPOSITION_COLUMNS)}",
    "FROM growth",
)
DIMENSION_METRICS = (
    f"{TC} dimension_type dimension_value product_count product_share_within_theme product_share_within_market top_100_count top_500_count"
    " average_rank median_rank "
    + " ".join(
        f"{m}_coverage_count {m}_sum {m}_share_within_theme {m}_share_within_market {m}_mean_per_covered_product"
        f" {m}_median_per_covered_product {m}_top_1_product_share"
        for _, m in MEASURES
    )
    + " has_previous_month market_new_entry_count market_new_entry_share market_new_entry_top_100_count market_new_entry_top_100_rate"
    " market_new_entry_top_500_count market_new_entry_top_500_rate publisher_coverage_count publisher_count top_1_publisher_product_share"
)
simple(
    "theme_dimension_metrics",
    lambda run: opportunity.dimension_metrics(run.facts, run.totals, run.themes),
    DIMENSION_METRICS,
    "FROM dims",
)
simple(
    "representative_leaders",
    lambda run: opportunity.representative_leaders(run.facts),
    sql.LEADER_COLUMNS + " evidence_type evidence_rank",
    "FROM leaders",
)
simple("representative_rows", lambda run: opportunity.representative_rows(run.facts), sql.LEADER_COLUMNS, "FROM product_rows")

# Six-month score.
simple(
    "six_month_features", lambda run: trend.six_month_features(run.totals, run.themes), sql.FEATURE_COLUMNS, "FROM features"
)
simple(
    "share_gain_and_acceleration",
    lambda run: trend.six_month_features(run.totals, run.themes),
    f"{TC} product_share_gain_3m units_absolute_share_gain_3m revenue_absolute_share_gain_3m product_share_acceleration"
    " units_absolute_share_acceleration revenue_absolute_share_acceleration recent3_new_entry_share",
    "FROM features",
)
simple(
    "rank_and_publisher_gain",
    lambda run: trend.six_month_features(run.totals, run.themes),
    f"{TC} median_rank_improvement publisher_count_gain_3m units_absolute_overindex revenue_absolute_overindex"
    " recent3_units_coverage_ratio recent3_revenue_coverage_ratio latest_publisher_coverage_ratio",
    "FROM features",
)
simple(
    "exclusion_and_confidence",
    lambda run: trend.with_eligibility(trend.six_month_features(run.totals, run.themes)),
    f"{TC} exclusion_reason is_actionable confidence_score",
    "FROM eligible",
)
PERCENTILES = " ".join(f"pct_{name}" for name in trend.PERCENTILE_FEATURES)
simple(
    "average_rank_percentile",
    lambda run: trend.feature_percentiles(trend.with_eligibility(trend.six_month_features(run.totals, run.themes))),
    f"{TC} {PERCENTILES}",
    "FROM percentiles WHERE is_actionable",
)
simple("trend_scores", lambda run: trend.trend_scores(run.totals, run.themes), sql.SCORE_COLUMNS, "FROM scores")
simple(
    "trend_rank",
    lambda run: trend.with_trend_rank(run.scores.drop("trend_rank")),
    f"{TC} trend_score base_trend_score trend_rank",
    "FROM scores",
)
simple(
    "latest_ranking",
    lambda run: trend.latest_ranking(run.scores, 10),
    f"{TC} trend_rank trend_score confidence_score",
    "FROM scores WHERE trend_rank <= 10 AND period_start = (SELECT max(period_start) FROM scores)",
)

# Multi-horizon model.
simple("horizon_metrics", lambda run: model.horizon_metrics(run.grid), sql.HORIZON_COLUMNS, "FROM horizons")
for _name, _columns in {
    "linear_and_normalized_slope": "linear_slope normalized_slope",
    "r_squared": "r_squared",
    "dispersion": "standard_deviation coefficient_of_variation latest_to_mean_ratio",
    "maximum_drawdown": "maximum_drawdown",
    "months_since_peak": "months_since_peak",
    "transition_counts": "transition_count transition_coverage_count positive_change_count negative_change_count unchanged_change_count positive_change_ratio",
}.items():
    simple(_name, lambda run: run.horizons, f"{TC} metric_name horizon_month_count {_columns}", "FROM horizons")
simple(
    "theme_activity",
    lambda run: model.model_grid(run.totals, run.structure).where("is_present"),
    f"{TC} active_months_to_date first_active_month history_start",
    "FROM (SELECT a.*, m.scope_name, m.cadence, m.period_end FROM activity a JOIN months m USING (period_start)) WHERE present",
)
EVIDENCE = f"{TC} horizon_month_count"
simple(
    "direction_vote",
    lambda run: model.horizon_evidence(run.horizons).withColumnRenamed("direction", "direction_state"),
    f"{EVIDENCE} direction_state direction_evidence_count median_normalized_slope median_r_squared",
    "FROM (SELECT *, direction AS direction_state FROM evidence)",
)
simple(
    "stability_band",
    lambda run: model.horizon_evidence(run.horizons),
    f"{EVIDENCE} stability_band stability_cv_median",
    "FROM evidence",
)
simple(
    "lifecycle_stage",
    lambda run: run.summaries.drop("lifecycle_stage").withColumn("lifecycle_stage", model.lifecycle_stage()),
    f"{TC} lifecycle_stage direction_6m direction_12m months_since_first_active",
    "FROM summaries",
)
simple("seasonality_profiles", lambda run: model.seasonality_profiles(run.grid), sql.SEASON_COLUMNS, "FROM season")
simple("seasonality_summary", lambda run: model.seasonality_summary(run.seasonality), f"{TC} {sql.SEASON_HEAD_COLUMNS}", "FROM season_heads")
simple(
    "model_summaries",
    lambda run: model.model_summaries(run.grid, run.horizons, run.seasonality),
    sql.SUMMARY_COLUMNS,
    "FROM summaries",
)

# Backtest.
simple(
    "backtest_population",
    lambda run: backtest.decision_population(run.scores, run.summaries, run.totals),
    TC,
    "FROM population",
)
simple(
    "backtest_population_violations",
    lambda run: backtest.population_violations(
        backtest.decision_population(run.scores, run.summaries, run.totals),
        # Each table lacks rows of its own.
        {
            "structure": run.structure.where(F.col("game_theme") != "N/A"),
            "growth": run.growth.where(F.col("game_theme") != "Unknown"),
            "scores": run.scores.where(F.month("period_start") != 3),
            "summaries": run.summaries.where((F.col("game_theme") != "Unknown") | (F.month("period_start") < 7)),
        },
    ),
    f"{TC} missing_table",
    """FROM (SELECT *, 'structure' AS missing_table FROM population WHERE game_theme = 'N/A'
      UNION ALL SELECT *, 'growth' FROM population WHERE game_theme = 'Unknown'
      UNION ALL SELECT *, 'scores' FROM population WHERE month(period_start) = 3
      UNION ALL SELECT *, 'summaries' FROM population WHERE game_theme = 'Unknown' AND month(period_start) >= 7)""",
)
simple(
    "launch_window_outcomes",
    lambda run: backtest.launch_window_outcomes(
        run.totals, run.structure, run.growth, run.scores, run.summaries, run.seasonality
    ),
    sql.OUTCOME_COLUMNS,
    "FROM outcomes",
)
IDENTITY = "scope_name cadence decision_period_start decision_period_end outcome_horizon_months game_theme"
simple("expected_seasonal_index", lambda run: run.outcomes, f"{IDENTITY} {sql.SEASON_INDEX_COLUMNS}", "FROM outcomes")
simple(
    "outcome_changes",
    lambda run: run.outcomes,
    f"{IDENTITY} {sql.CHANGE_COLUMNS} {' '.join(f'{c}_change_direction' for c in SHARE_METRICS)}",
    "FROM outcomes",
)
simple(
    "future_percentile",
    lambda run: backtest.future_percentiles(run.outcomes.drop(*[f"future_{c}_percentile" for c in SHARE_METRICS])),
    f"{IDENTITY} {' '.join(f'future_{c}_percentile' for c in SHARE_METRICS)}",
    "FROM outcomes",
)
simple(
    "top_quintile_flag",
    lambda run: run.outcomes,
    f"{IDENTITY} {' '.join(f'future_{c}_top_quintile' for c in SHARE_METRICS)}",
    "FROM outcomes",
)
simple(
    "feature_registry",
    lambda run: backtest.feature_registry(run.totals),
    "scope_name cadence backtest_start backtest_end outcome_horizon_months feature_name feature_group feature_hypothesis outcome_name",
    "FROM registry",
)
PAIR = sql.PAIR_COLUMNS
simple(
    "oriented_spearman",
    lambda run: backtest.oriented_spearman(run.table("ranked_pairs")),
    f"{PAIR} decision_period_start spearman",
    "FROM (SELECT $scope AS scope_name, 'monthly' AS cadence, * FROM correlations)",
)
simple(
    "spearman_distribution",
    lambda run: backtest.spearman_distribution(backtest.oriented_spearman(run.table("ranked_pairs"))),
    f"{PAIR} correlation_cohort_count {sql.SPEARMAN_COLUMNS}",
    "FROM correlation_heads",
)
simple(
    "top_quintile_lift",
    lambda run: backtest.top_quintile_lift(run.table("ranked_pairs")),
    f"{PAIR} {sql.LIFT_COLUMNS}",
    f"FROM (SELECT $scope AS scope_name, 'monthly' AS cadence, *, {sql._lift} FROM pair_counts)",
)
simple(
    "positive_change_rate",
    lambda run: backtest.positive_change_rates(run.table("ranked_pairs")),
    f"{PAIR} {sql.POSITIVE_COLUMNS}",
    f"FROM (SELECT $scope AS scope_name, 'monthly' AS cadence, *, {sql._positives} FROM pair_counts) WHERE outcome_name LIKE '%absolute_change'",
)
simple(
    "backtest_feature_metrics",
    lambda run: backtest.feature_metrics(run.outcomes, run.totals, run.table("ranked_pairs")),
    sql.FEATURE_METRIC_COLUMNS,
    "FROM feature_results",
)
simple(
    "backtest_segment_metrics",
    lambda run: backtest.segment_metrics(run.outcomes, run.totals),
    sql.SEGMENT_COLUMNS,
    "FROM segment_results",
)

# Revenue proxy.
simple("product_revenue_profiles", lambda run: proxy.product_revenue_profiles(run.snapshots), sql.PROFILE_COLUMNS, "FROM profile_rows")
simple("theme_proxy_metrics", lambda run: proxy.theme_proxy_metrics(run.snapshots), sql.PROXY_COLUMNS, "FROM proxies")
simple(
    "classify_observable_revenue",
    lambda run: proxy.product_revenue_profiles(run.snapshots)
    .groupBy(*PERIOD, "observable_revenue_state", "monetization_proxy", "classification_reason")
    .agg(F.count(F.lit(1)).alias("product_count")),
    f"{PC} observable_revenue_state monetization_proxy classification_reason product_count",
    f"FROM (SELECT {sql.K}, observable_revenue_state, monetization_proxy, classification_reason, count(*) AS product_count FROM profile_rows GROUP BY ALL)",
)
simple(
    "profile_coverage_check",
    lambda run: proxy.profile_coverage_violations(
        run.snapshots, run.profiles.where(F.col("observable_revenue_state") != "zero")
    ),
    f"{PC} unified_app_id violation",
    "FROM (SELECT *, 'missing_profile' AS violation FROM snap WHERE revenue_absolute = 0)",
)
simple(
    "theme_identity_check",
    lambda run: proxy.theme_identity_violations(
        run.proxies, {"themes": run.themes, "summaries": run.summaries.where(F.col("game_theme") != "Unknown")}
    ),
    f"{TC} compared_table violation",
    "FROM (SELECT *, 'summaries' AS compared_table, 'only_in_proxy' AS violation FROM proxies WHERE game_theme = 'Unknown')",
)

# Decisions.
simple(
    "category_fit",
    lambda run: decision.category_fits(run.summaries, run.dimensions, run.leaders),
    sql.FIT_COLUMNS,
    "FROM fits",
)
simple(
    "category_fit_summary",
    lambda run: decision.category_fit_summary(run.fits),
    f"{TC} category_fit_summary",
    "FROM fit_heads",
)
simple("migration_hypotheses", lambda run: decision.migration_hypotheses(run.fits), sql.MIGRATION_COLUMNS, "FROM migrations")
simple(
    "decision_population_violations",
    lambda run: decision.population_violations(
        run.structure, run.summaries.where(F.col("game_theme") != "N/A"), {"growth": run.growth}
    ),
    f"{TC} violation",
    f"""FROM (SELECT {sql.KT}, unnest(['structure_without_summary', 'growth_outside_population']) AS violation FROM structure WHERE game_theme = 'N/A')""",
)
simple(
    "cross_theme_percentiles",
    lambda run: decision.cross_theme_percentiles(
        decision.decision_population(run.structure, run.summaries, run.growth, run.proxies, run.scores)
    ),
    f"{TC} {sql.PERCENTILE_COLUMNS}",
    "FROM evidence_rows",
)
for _name, _columns in {
    "market_size_band": "market_size_band",
    "competitive_risk_band": "competitive_structure_risk_band",
    "growth_quality": "growth_quality_state",
    "decision_confidence": "confidence",
    "recommendation": "recommendation primary_reason_code next_validation_action_code",
    "launch_state": "evidence_state reason_code",
}.items():
    simple(_name, lambda run: run.assessed, f"{TC} {_columns}", "FROM decisions")
simple(
    "evidence_flags",
    lambda run: run.assessed.withColumn("is_revenue_evidence_used", decision.revenue_evidence_used()).withColumn(
        "source_policy_references", decision.policy_references()
    ),
    f"{TC} is_revenue_evidence_used source_policy_references",
    "FROM decisions",
)
simple(
    "launch_window_assessments",
    lambda run: decision.launch_window_assessments(run.assessed),
    f"{TC} decision_policy_version horizon_months evidence_state confidence reason_code is_forecast source_policy_references",
    "FROM (SELECT *, unnest([1, 2, 3]) AS horizon_months, FALSE AS is_forecast FROM decisions)",
)
simple(
    "decision_risks",
    lambda run: decision.risk_rows(run.assessed),
    f"{TC} decision_policy_version risk_code severity evidence_availability source_metric_name",
    "FROM risks",
)
simple("decision_summaries", lambda run: decision.decision_summaries(run.assessed), sql.DECISION_COLUMNS, "FROM decisions")
simple(
    "decision_distributions",
    lambda run: decision.decision_distributions(decision.decision_summaries(run.assessed)),
    f"{PC} distribution value row_count",
    "FROM ("
    + " UNION ALL ".join(
        f"SELECT {sql.K}, '{k}' AS distribution, {c} AS value, count(*) AS row_count FROM decisions GROUP BY ALL"
        for k, c in {
            "recommendation": "recommendation",
            "confidence": "confidence",
            "market_size": "market_size_band",
            "growth_quality": "growth_quality_state",
        }.items()
    )
    + ")",
)

# Ingestion: JSON responses built from the part table and parsed back.
_KEY = "SELECT *, p_partkey AS k, p_partkey // 100 AS response_id, p_partkey % 100 + 1 AS position FROM part"
_PARSED = f"""SELECT *,
    CASE WHEN k = 0 OR k % 40 = 3 THEN NULL WHEN k % 4 = 2 THEN 'com.app.' || k ELSE k::VARCHAR END AS source_app_id,
    CASE WHEN k % 6 = 0 THEN 'u-' || k WHEN k % 40 = 3 THEN NULL WHEN k % 4 = 2 THEN 'com.app.' || k ELSE k::VARCHAR END AS unified_app_id,
    p_size::DOUBLE AS units_absolute, CASE WHEN k % 13 <> 0 THEN p_retailprice END AS revenue_absolute,
    CASE WHEN k % 100 <> 98 THEN p_brand END AS game_theme,
    CASE WHEN k % 100 <> 98 THEN CASE k % 5 WHEN 0 THEN ' Puzzle ' WHEN 1 THEN 'STRATEGY' WHEN 2 THEN 'Arcade' ELSE 'puzzle' END END AS game_genre,
    CASE WHEN k % 100 <> 98 THEN CASE WHEN k % 7 = 0 THEN 'China' ELSE 'US' END END AS game_country,
    CASE WHEN k % 100 <> 98 THEN CASE k % 3 WHEN 0 THEN DATE '2020-01-05' WHEN 1 THEN DATE '2020-02-29' END END AS release_date_ww,
    CASE WHEN k % 100 <> 98 AND k % 3 = 2 THEN 'Release Date (WW)' ELSE '' END AS date_note_codes,
    concat_ws(',', CASE WHEN k = 0 OR k % 40 = 3 THEN 'invalid_app_id' END, CASE WHEN k % 50 = 7 THEN 'invalid_date' END,
      CASE WHEN k % 100 = 98 THEN 'missing_tags' END) AS error_codes
  FROM ({_KEY})"""
_SELECTED = f"""SELECT *, row_number() OVER (PARTITION BY response_id ORDER BY position) AS rank_position FROM ({_PARSED})
  WHERE error_codes = '' AND lower(trim(game_genre)) IN ('puzzle', 'strategy') AND game_country IS DISTINCT FROM 'China'"""


def _parsed(run: Stages) -> DataFrame:
    rows = market_json.parse_market_payloads(driver_tables.market_responses(run.spark, run.source))
    return rows.withColumns(
        {
            "game_country": F.col("most_popular_country_by_revenue"),
            "date_note_codes": F.array_join("date_notes", ","),
            "error_codes": F.array_join("errors", ","),
        }
    )


def _with_bad_payloads(run: Stages) -> DataFrame:
    """Responses of which some are cut off, some are an object, and some have one item more that is none."""
    kind, payload = F.col("response_id") % 5, F.col("payload")
    broken = F.when(kind == 1, F.expr("left(payload, length(payload) - 1)")).when(kind == 2, F.concat(F.lit('{"rows": '), payload, F.lit("}")))
    broken = broken.when(kind == 3, F.expr("concat(left(payload, length(payload) - 1), ', 7, {\"units_absolute\": \"many\"}]')"))
    return driver_tables.market_responses(run.spark, run.source).withColumn("payload", broken.otherwise(payload))


def _read_back(run: Stages) -> DataFrame:
    """The responses written as files, one each, and read by path."""
    path = scratch_dir(run.spark)
    responses = driver_tables.market_responses(run.spark, run.source)
    responses.repartition("response_id").write.partitionBy("response_id").text(path)
    return market_json.read_market_json(run.spark, path).withColumn("error_codes", F.array_join("errors", ","))


def _selected(run: Stages) -> DataFrame:
    return market_json.select_market_records(_parsed(run), ["response_id"], ["Puzzle", " strategy "], 30, "China")


for _name, _columns in {
    "merge_custom_tags": "game_theme game_genre game_country",
    "parse_tag_dates": "release_date_ww date_note_codes",
    "resolve_unified_id": "source_app_id unified_app_id",
}.items():
    simple(_name, _parsed, f"response_id position {_columns}", f"FROM ({_PARSED})")
simple(
    "read_market_json",
    _read_back,
    "response_id position source_app_id units_absolute revenue_absolute error_codes",
    f"FROM ({_PARSED})",
)
simple(
    "rejected_market_rows",
    lambda run: market_json.rejected_market_rows(_with_bad_payloads(run)).select(
        "response_id", F.coalesce("position", F.lit(0)).alias("position"), F.col("error").alias("violation")
    ),
    "response_id position violation",
    f"""FROM (SELECT response_id, position, unnest(string_split(error_codes, ',')) AS violation FROM ({_PARSED}) WHERE error_codes <> '' AND response_id % 5 NOT IN (1, 2)
      UNION ALL SELECT DISTINCT response_id, 0, 'invalid_payload' FROM ({_PARSED}) WHERE response_id % 5 IN (1, 2)
      UNION ALL SELECT response_id, count(*) + 1, 'not_an_object' FROM ({_PARSED}) WHERE response_id % 5 = 3 GROUP BY 1
      UNION ALL SELECT response_id, count(*) + 2, unnest(['invalid_app_id', 'invalid_date', 'missing_tags', 'malformed_field'])
        FROM ({_PARSED}) WHERE response_id % 5 = 3 GROUP BY 1)""",
)
simple(
    "normalize_opaque_id",
    lambda run: driver_tables.table(run.spark, run.source, "orders").select(
        F.col("o_orderkey").alias("order_id"),
        text.normalize_opaque_id(
            F.when(F.col("o_orderkey") % 5 == 0, F.concat(F.lit(" 000"), "o_orderkey"))
            .when(F.col("o_orderkey") % 5 == 1, F.concat(F.lit("-"), "o_orderkey"))
            .when(F.col("o_orderkey") % 5 == 2, F.concat(F.col("o_orderkey"), F.lit(".5")))
            .when(F.col("o_orderkey") % 5 == 3, F.concat(F.lit("app-"), "o_orderkey"))
            .otherwise(F.lit("  "))
        ).alias("source_app_id"),
    ),
    "order_id source_app_id",
    """FROM (SELECT o_orderkey AS order_id, CASE WHEN o_orderkey % 5 = 0 AND o_orderkey > 0 THEN o_orderkey::VARCHAR
      WHEN o_orderkey % 5 = 3 THEN 'app-' || o_orderkey END AS source_app_id FROM orders)""",
)
simple(
    "select_market_records",
    _selected,
    "response_id position rank_position source_app_id game_genre",
    f"FROM ({_SELECTED}) WHERE rank_position <= 30",
)
simple(
    "selection_counts",
    lambda run: market_json.selection_counts(
        _parsed(run), market_json.select_market_records(_parsed(run), ["response_id"], ["PUZZLE"], 10), ["response_id"]
    ),
    "response_id candidate_count selected_count status",
    f"""FROM (SELECT response_id, count(*) AS candidate_count, least(10, count(*) FILTER (error_codes = '' AND lower(trim(game_genre)) = 'puzzle')) AS selected_count,
      CASE WHEN count(*) FILTER (error_codes = '' AND lower(trim(game_genre)) = 'puzzle') = 0 THEN 'no_eligible_record' ELSE 'selected' END AS status
      FROM ({_PARSED}) GROUP BY 1)""",
)
simple(
    "build_market_snapshots",
    lambda run: market_json.build_market_snapshots(
        _selected(run).withColumn("scope_name", F.concat(F.lit("response-"), "response_id")),
        cadence="monthly",
        period_start=datetime.date(2024, 1, 1),
        period_end=datetime.date(2024, 1, 31),
        scope_country="WW",
        device_type="total",
        category=7003,
        data_model="DM",
    ),
    f"{PC} rank_position source_app_id unified_app_id scope_country device_type category data_model units_absolute revenue_absolute game_theme"
    " game_genre release_date_ww",
    f"""FROM (SELECT *, 'response-' || response_id AS scope_name, 'monthly' AS cadence, DATE '2024-01-01' AS period_start, DATE '2024-01-31' AS period_end,
      'WW' AS scope_country, 'total' AS device_type, 7003 AS category, 'DM' AS data_model FROM ({_SELECTED}) WHERE rank_position <= 30)""",
)
simple(
    "normalize_metadata",
    lambda run: market_json.normalize_metadata(driver_tables.metadata_items(run.spark, run.source)),
    "unified_app_id name publisher_display_name publisher_resolution_source android_app_id",
    """FROM (SELECT CASE WHEN p_partkey > 0 THEN p_partkey::VARCHAR END AS unified_app_id, CASE WHEN p_partkey % 9 <> 0 THEN p_name END AS name,
      CASE p_partkey % 4 WHEN 1 THEN 'Pub No ' || p_partkey WHEN 2 THEN p_brand WHEN 0 THEN 'it-' || p_partkey END AS publisher_display_name,
      CASE p_partkey % 4 WHEN 1 THEN 'android_publisher_ids' WHEN 2 THEN 'publisher_name' WHEN 0 THEN 'itunes_publisher_ids' ELSE 'unavailable' END
        AS publisher_resolution_source, CASE WHEN p_partkey % 2 = 0 THEN p_partkey::VARCHAR END AS android_app_id FROM part)""",
)


def _ids(run: Stages) -> DataFrame:
    return run.snapshots.select("unified_app_id").distinct()


simple(
    "metadata_integrity",
    lambda run: market_json.metadata_integrity(
        run.metadata.unionByName(run.metadata.where(F.col("ios_app_id").isNull() & (F.col("name").isNull()))),
        _ids(run).where(F.length("unified_app_id") > 1),
    ),
    "unified_app_id violation",
    """FROM (SELECT unified_app_id, 'unrequested' AS violation FROM meta WHERE length(unified_app_id) <= 1
      UNION ALL SELECT unified_app_id, 'duplicate' FROM meta WHERE ios_app_id IS NULL AND name IS NULL
      UNION ALL SELECT DISTINCT unified_app_id, 'missing' FROM snap ANTI JOIN meta USING (unified_app_id) WHERE length(unified_app_id) > 1)""",
    merge="distinct",
)
simple(
    "distinct_ids_first_seen",
    lambda run: market_json.first_seen_ids(
        driver_tables.table(run.spark, run.source, "lineitem").select(
            F.col("l_partkey").cast("string").alias("unified_app_id"),
            (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("position"),
        )
    ),
    "unified_app_id position",
    "FROM (SELECT l_partkey::VARCHAR AS unified_app_id, min(l_orderkey * 8 + l_linenumber) AS position FROM lineitem GROUP BY 1)",
)
simple(
    "metadata_cache_lookup",
    lambda run: market_json.metadata_cache_lookup(_ids(run), run.metadata, "2001-12-31 00:00:00", 14),
    "unified_app_id status",
    """FROM (SELECT i.unified_app_id, CASE WHEN fetched_at IS NULL THEN 'missing' WHEN fetched_at >= TIMESTAMP '2001-12-17 00:00:00' THEN 'fresh' ELSE 'stale' END AS status
      FROM (SELECT DISTINCT unified_app_id FROM snap) i LEFT JOIN meta m USING (unified_app_id))""",
    merge="distinct",
)


def _combined(run: Stages) -> tuple[DataFrame, DataFrame]:
    """Fresh cache rows meet a fetch of the stale ids that repeats the ids fetched exactly two weeks before."""
    status = market_json.metadata_cache_lookup(_ids(run), run.metadata, "2001-12-31 00:00:00", 14)
    fresh = run.metadata.join(status.where(F.col("status") == "fresh"), "unified_app_id", "left_semi")
    fetched = run.metadata.where(F.col("fetched_at") <= F.lit("2001-12-17 00:00:00").cast("timestamp"))
    return market_json.combine_metadata(fresh, fetched, _ids(run))


simple(
    "combine_metadata",
    lambda run: _combined(run)[1],
    "unified_app_id violation",
    """FROM (SELECT unified_app_id, 'supplied_twice' AS violation FROM meta WHERE fetched_at = TIMESTAMP '2001-12-17 00:00:00'
      UNION ALL SELECT DISTINCT unified_app_id, 'unresolved' FROM snap ANTI JOIN meta USING (unified_app_id))""",
    merge="distinct",
)
simple(
    "combined_metadata",
    lambda run: _combined(run)[0],
    "unified_app_id name publisher_display_name publisher_resolution_source android_app_id ios_app_id",
    """FROM meta WHERE fetched_at < TIMESTAMP '2001-12-17 00:00:00'
      OR (fetched_at > TIMESTAMP '2001-12-17 00:00:00' AND unified_app_id IN (SELECT unified_app_id FROM snap))""",
    merge="distinct",
)
simple(
    "read_range",
    lambda run: market_json.read_range(run.structure, "1996-01-01", "1997-12-31", scope_name="niche", game_theme="Brand#7"),
    f"{TC} product_count downloads_sum",
    "FROM structure WHERE period_start BETWEEN DATE '1996-01-01' AND DATE '1997-12-31' AND game_theme = 'Brand#7' AND scope_name = 'niche'",
)
simple("latest_period", lambda run: market_json.latest_period(run.snapshots), PC, f"FROM (SELECT {sql.K} FROM months ORDER BY period_start DESC LIMIT 1)")
simple(
    "read_by_ids",
    lambda run: market_json.read_by_ids(run.metadata, run.snapshots.where(F.col("game_theme") == "Unknown")),
    "unified_app_id name publisher_display_name",
    "FROM meta WHERE unified_app_id IN (SELECT unified_app_id FROM snap WHERE game_theme = 'Unknown')",
    merge="distinct",
)

# Table maintenance: written, replaced and read back.
_REPLACED = [datetime.date(1995, 2, 1), datetime.date(1995, 3, 1)]


def _periods(totals: DataFrame) -> list[tuple]:
    """Periods of a table with one row a month and scope."""
    return [tuple(row) for row in totals.select(*PERIOD).collect()]


def _period_table(run: Stages, rows: DataFrame) -> PeriodTable:
    """``rows`` as a table of their own, partitioned by period."""
    table = PeriodTable(run.spark, scratch_dir(run.spark), rows.schema)
    table.write(rows)
    return table


def _replaced(run: Stages) -> DataFrame:
    """All months of two cadences stored, then two months of one replaced: February by fewer rows, March by none."""
    table = _period_table(run, run.themes.unionByName(run.themes.withColumn("cadence", F.lit("weekly"))))
    target = (F.col("scope_name") == "market") & (F.col("cadence") == "monthly") & F.col("period_start").isin(*_REPLACED)
    kept = (F.month("period_start") == 2) & (F.col("product_count") >= 20)
    replace_range({table: run.themes.where(target & kept)}, _periods(run.totals.where(target)))
    return table.read()


simple(
    "replace_range",
    _replaced,
    f"{TC} product_count units_absolute_sum",
    """FROM (SELECT * FROM themes WHERE scope_name <> 'market' OR period_start NOT IN (DATE '1995-02-01', DATE '1995-03-01')
        OR (period_start = DATE '1995-02-01' AND product_count >= 20)
      UNION ALL SELECT * REPLACE ('weekly' AS cadence) FROM themes)""",
)


def _replaced_snapshots(run: Stages) -> DataFrame:
    table = _period_table(run, run.snapshots)
    period = ("market", "monthly", "1995-03-01", "1995-03-31")
    replace_period(table, only_periods(run.snapshots, [period]).withColumn("units_absolute", F.lit(1.0)), period)
    return table.read().groupBy(*PERIOD).agg(
        F.count(F.lit(1)).alias("snapshot_count"), F.round(F.sum("units_absolute"), 6).alias("downloads_sum")
    )


simple(
    "replace_period",
    _replaced_snapshots,
    f"{PC} snapshot_count downloads_sum",
    f"""FROM (SELECT {sql.K}, count(*) AS snapshot_count, round(sum(CASE WHEN scope_name = 'market' AND period_start = DATE '1995-03-01' THEN 1.0 ELSE units_absolute END), 6) AS downloads_sum
      FROM snap GROUP BY {sql.K})""",
)
# The range run: two months of one scope sell twice as much, a label leaves them, and what they reach is recomputed.
_CHANGED = "scope_name = 'market' AND period_start IN (DATE '1995-03-01', DATE '1995-06-01')"
_PATCH = f"""SELECT * REPLACE (CASE WHEN {_CHANGED} THEN 2 * units_absolute ELSE units_absolute END AS units_absolute,
    CASE WHEN {_CHANGED} AND game_theme = 'Unknown' THEN NULL ELSE game_theme END AS game_theme) FROM {{snap}}"""
_CHAIN = ("totals", "themes", "top_ten", "structure", "growth", "scores")
_REFRESHED: dict[tuple[str, str], tuple[refresh.RangeRun, dict]] = {}


def _refreshed(run: Stages) -> tuple[refresh.RangeRun, dict]:
    """The stage tables after the change, refreshed once for all queries of an application."""
    key = (run.spark.sparkContext.applicationId, run.root)
    if key not in _REFRESHED:
        stored = refresh.RangeRun(run.spark, run.metadata)
        stored.load(run, _CHAIN)
        there = F.expr(_CHANGED)
        rows = run.snapshots.where(there).withColumns(
            {
                "units_absolute": 2 * F.col("units_absolute"),
                "game_theme": F.when(F.col("game_theme") != "Unknown", F.col("game_theme")),
            }
        )
        _REFRESHED[key] = stored, stored.refresh(rows, _periods(run.totals.where(there)))
    return _REFRESHED[key]


simple(
    "range_run",
    lambda run: refresh.summary(
        run.spark, refresh.stale_periods(_periods(run.totals.where(F.expr(_CHANGED))), _periods(run.totals))
    ),
    f"stage_name {PC}",
    f"""FROM (SELECT DISTINCT stage_name, {sql.K} FROM months CROSS JOIN (VALUES ('snapshots', 0, 0), ('totals', 0, 0), ('themes', 0, 1), ('top_ten', 0, 0),
        ('structure', 0, 0), ('growth', 0, 1), ('dimensions', 0, 1), ('leaders', 0, 1), ('scores', 0, 6), ('horizons', 0, 35), ('seasonality', 0, 35), ('summaries', 0, 9999), ('outcomes', 3, 9999)) r(stage_name, before, after)
      JOIN (VALUES (DATE '1995-03-01'), (DATE '1995-06-01')) c(month) ON scope_name = 'market'
        AND period_start BETWEEN month - to_months(before) AND month + to_months(after))""",
)
simple(
    "range_run_structure",
    lambda run: _refreshed(run)[0].table("structure"),
    sql.STRUCTURE_COLUMNS,
    "FROM structure",
    changed=_PATCH,
)
simple(
    "range_run_scores",
    lambda run: _refreshed(run)[0].table("scores"),
    sql.SCORE_COLUMNS,
    "FROM scores",
    changed=_PATCH,
)
simple(
    "range_run_growth",
    lambda run: _refreshed(run)[0].table("growth"),
    f"{TC} {MEMBERSHIP} {' '.join((*opportunity.TURNOVER_COLUMNS, *opportunity.RETENTION_COLUMNS, *opportunity.DECOMPOSITION_COLUMNS))}",
    "FROM growth",
    changed=_PATCH,
)
simple(
    "upsert_metadata",
    lambda run: upsert_metadata(
        run.metadata,
        run.metadata.where(F.col("android_app_id").isNotNull()).withColumn("name", F.concat(F.lit("new "), "name")),
    ),
    "unified_app_id name publisher_display_name",
    "FROM (SELECT unified_app_id, CASE WHEN android_app_id IS NOT NULL THEN 'new ' || name ELSE name END AS name, publisher_display_name FROM meta)",
)


def _exported(run: Stages) -> DataFrame:
    path = scratch_dir(run.spark)
    columns = f"{TC} trend_rank trend_score is_actionable".split()
    order = ["period_start", F.col("trend_rank").asc_nulls_last(), "game_theme"]
    export_sorted(run.scores, path, columns, order)
    return run.spark.read.parquet(path)


simple("export_sorted_parquet", _exported, f"{TC} trend_rank trend_score is_actionable", "FROM scores")


_READ_BACK = ("totals", "themes", "structure", "growth", "scores")
_DAMAGED = "scope_name = 'market' AND period_start = DATE '1995-05-01'"


def _stored_differently(run: Stages) -> DataFrame:
    """Stage tables with all columns against what is read back after one period of each was damaged."""
    found = None
    for name in _READ_BACK:
        rows = run.table(name)
        table = _period_table(run, rows)
        count = "snapshot_count" if name == "totals" else "latest_product_count" if name == "scores" else None
        count = count or next(c for c in rows.columns if c.endswith("_count"))
        table.write(rows.where(_DAMAGED).withColumn(count, F.col(count) + 1))
        part = verified(rows, table).groupBy(*PERIOD, "violation").agg(F.count(F.lit(1)).alias("row_count"))
        part = part.withColumn("table_name", F.lit(name))
        found = part if found is None else found.unionByName(part)
    return found


simple(
    "verify_readback",
    _stored_differently,
    f"table_name {PC} violation row_count",
    "FROM (" + " UNION ALL ".join(
        f"SELECT '{name}' AS table_name, {sql.K}, unnest(['not_stored', 'not_expected']) AS violation, row_count"
        f" FROM (SELECT {sql.K}, count(*) AS row_count FROM {name} WHERE {_DAMAGED} GROUP BY ALL)"
        for name in _READ_BACK
    ) + ")",
)
simple(
    "missing_months",
    lambda run: calendar.missing_months(
        run.totals.select(*PERIOD),
        run.snapshots.where((F.month("period_start") != 2) | (F.col("scope_name") != "market")),
    ),
    PC,
    "FROM months WHERE month(period_start) = 2 AND scope_name = 'market'",
)

# Quality.
_GENRES = ["puzzle", "strategy", "arcade"]
_PROVENANCE = ["WW", "total", 7003, "DM_2025_Q2"]
_LABELS = ("game_theme", "game_genre", "game_subgenre", "game_product_model", "game_art_style", "game_setting", "earliest_release_date", "release_date_ww")
_COVERED = ("downloads", "revenue_usd", *_LABELS, "metadata", "name", "publisher")
_PARTS = " ".join(f"{m}_{p}" for m in ("downloads", "revenue_usd") for p in ("null_count", "zero_count", "negative_count", "sum"))
QUALITY_COLUMNS = (
    f"{PC} status snapshot_count exceeds_configured_cap unique_unified_app_count duplicate_unified_app_count unique_rank_count duplicate_rank_count"
    f" ranks_are_contiguous provenance_variant_count provenance_mismatch_count structural_issue_count {_PARTS} "
    + " ".join(f"{c}_coverage_count {c}_coverage_ratio" for c in _COVERED)
)
_source_of = {"downloads": "units_absolute", "revenue_usd": "revenue_absolute", "metadata": "m.unified_app_id", "name": "m.name", "publisher": "m.publisher_display_name"}
sql.BLOCKS["quality"] = f"""
  SELECT *, {', '.join(f"{c}_coverage_count / snapshot_count::DOUBLE AS {c}_coverage_ratio" for c in _COVERED)},
    snapshot_count - unique_unified_app_count AS duplicate_unified_app_count, snapshot_count - unique_rank_count AS duplicate_rank_count,
    snapshot_count > 600 AS exceeds_configured_cap, (snapshot_count > 600)::INT + bad_genre + excluded AS structural_issue_count
  FROM (SELECT {', '.join('s.' + c for c in sql.K.split(', '))}, 'present' AS status, count(*) AS snapshot_count, count(DISTINCT s.unified_app_id) AS unique_unified_app_count,
      count(DISTINCT rank_position) AS unique_rank_count, max(rank_position) = count(*) AND min(rank_position) = 1 AS ranks_are_contiguous,
      count(DISTINCT (scope_country, device_type, category, data_model)) AS provenance_variant_count,
      count(*) FILTER (data_model <> 'DM_2025_Q2') AS provenance_mismatch_count,
      bool_or(game_genre IS NULL)::INT AS bad_genre, bool_or(most_popular_country_by_revenue = 'China')::INT AS excluded,
      {', '.join(f"count(*) - count({c}) AS {m}_null_count, count(*) FILTER ({c} = 0) AS {m}_zero_count, count(*) FILTER ({c} < 0) AS {m}_negative_count, {sql.s(c)} AS {m}_sum"
                 for m, c in (('downloads', 'units_absolute'), ('revenue_usd', 'revenue_absolute')))},
      {', '.join(f"count({_source_of.get(c, c)}) AS {c}_coverage_count" for c in _COVERED)}
    FROM snap s LEFT JOIN meta m USING (unified_app_id) GROUP BY 1, 2, 3, 4)"""


def _quality(run: Stages) -> DataFrame:
    return quality.month_quality(run.snapshots, run.metadata, _GENRES, 600, _PROVENANCE, "China")


simple("month_quality", _quality, QUALITY_COLUMNS, "FROM quality")
simple("structural_issue_count", _quality, f"{PC} structural_issue_count", "FROM quality")


def _with_missing(run: Stages) -> DataFrame:
    """Two months more than are stored are asked for, of either scope."""
    months = F.explode(F.array("period_start", F.add_months("period_start", 2))).alias("period_start")
    wanted = run.totals.select("scope_name", "cadence", months).distinct()
    return quality.with_missing_months(_quality(run), wanted.withColumn("period_end", F.last_day("period_start")))


simple(
    "missing_month_rows",
    _with_missing,
    f"{PC} status snapshot_count downloads_coverage_ratio downloads_sum ranks_are_contiguous",
    """FROM (SELECT scope_name, cadence, period_start, period_end, status, snapshot_count, downloads_coverage_ratio, downloads_sum, ranks_are_contiguous FROM quality
      UNION ALL SELECT $scope, 'monthly', m::DATE, last_day(m::DATE), 'missing', 0, NULL, NULL, FALSE
      FROM (SELECT max(period_start) + to_months(unnest([1, 2])) AS m FROM quality))""",
)
simple(
    "range_summary",
    lambda run: quality.range_summary(_with_missing(run), run.snapshots),
    "scope_name cadence requested_month_count present_month_count missing_month_count total_snapshot_count minimum_snapshot_count maximum_snapshot_count"
    " average_snapshots structural_issue_count provenance_variant_count structurally_complete",
    """FROM (SELECT $scope AS scope_name, 'monthly' AS cadence, count(*) + 2 AS requested_month_count, count(*) AS present_month_count, 2 AS missing_month_count,
      sum(snapshot_count) AS total_snapshot_count, min(snapshot_count) AS minimum_snapshot_count, max(snapshot_count) AS maximum_snapshot_count,
      avg(snapshot_count) AS average_snapshots, sum(structural_issue_count) AS structural_issue_count, 1 AS provenance_variant_count, FALSE AS structurally_complete FROM quality)""",
)
simple(
    "period_constraints",
    lambda run: quality.period_violations(
        run.snapshots.unionByName(run.snapshots.where(F.col("game_theme") == "N/A").withColumn("data_model", F.lit("other")))
    ),
    f"{PC} rule row_count",
    f"""FROM (SELECT {sql.K}, unnest(['duplicate_product', 'duplicate_rank']) AS rule, count(*) AS row_count FROM snap WHERE game_theme = 'N/A' GROUP BY 1, 2, 3, 4, 5
      UNION ALL SELECT {sql.K}, 'mixed_provenance', 1 FROM snap WHERE game_theme = 'N/A' GROUP BY 1, 2, 3, 4)""",
)


# Each check gets tables of which rows were taken or changed, so that every rule finds some.
def _theme(name: str) -> Column:
    return F.col("game_theme") == name


def _in_month(number: int) -> Column:
    return F.month("period_start") == number


simple(
    "referential_checks",
    lambda run: quality.referential_checks(
        run.themes.where(~_theme("Unknown")),
        run.structure.where(~_theme("N/A")),
        run.growth.where(~_in_month(3)),
        run.dimensions,
        run.leaders.where((F.col("evidence_rank") != 2) | (F.col("evidence_type") != "revenue_leader")).withColumn(
            "evidence_type",
            F.when(_in_month(5) & (F.col("evidence_type") == "downloads_growth_leader"), "other").otherwise(
                F.col("evidence_type")
            ),
        ),
    ),
    "rule row_count",
    f"""FROM (SELECT 'theme_without_structure' AS rule, count(*) AS row_count FROM themes WHERE game_theme = 'N/A'
      UNION ALL SELECT 'structure_without_theme', count(*) FROM structure WHERE game_theme = 'Unknown'
      UNION ALL SELECT 'theme_without_growth', count(*) FROM themes WHERE game_theme <> 'Unknown' AND month(period_start) = 3
      UNION ALL SELECT 'growth_without_theme', count(*) FROM growth WHERE game_theme = 'Unknown' AND month(period_start) <> 3
      UNION ALL SELECT 'dimension_without_theme', count(DISTINCT ({sql.KT})) FROM dims WHERE game_theme = 'Unknown'
      UNION ALL SELECT 'leader_without_theme', count(DISTINCT ({sql.KT})) FROM leaders WHERE game_theme = 'Unknown'
        AND NOT (evidence_type = 'revenue_leader' AND evidence_rank = 2)
      UNION ALL SELECT 'unknown_leader_type', count(*) FROM leaders WHERE evidence_type = 'downloads_growth_leader' AND month(period_start) = 5
      UNION ALL SELECT 'leader_ranks_not_contiguous', count(*) FROM leaders WHERE evidence_type = 'revenue_leader' AND evidence_rank = 3)""",
    merge="sum",
)
#: Season profiles without June, as the check below gets them.
_SEASON_LEFT = f"""SELECT count(*) FILTER (is_peak_month) AS peaks, count(*) FILTER (is_trough_month) AS troughs, avg(seasonal_index) AS mean
  FROM season WHERE calendar_month <> 6 GROUP BY {sql.KT}, metric_name"""
simple(
    "model_checks",
    lambda run: quality.model_checks(
        run.horizons,
        run.seasonality.where(F.col("calendar_month") != 6),
        run.summaries.where(~_in_month(2)),
        run.scores.where(~_theme("Unknown")),
    ),
    "rule row_count",
    f"""FROM (SELECT 'horizon_without_summary' AS rule, count(DISTINCT ({sql.KT})) AS row_count FROM horizons WHERE month(period_start) = 2
      UNION ALL SELECT 'season_without_summary', count(DISTINCT ({sql.KT})) FROM season WHERE month(period_start) = 2
      UNION ALL SELECT 'score_without_history', count(*) FROM scores WHERE month(period_start) = 2 AND game_theme <> 'Unknown'
      UNION ALL SELECT 'history_without_score', count(*) FROM summaries WHERE has_6m_history AND game_theme = 'Unknown' AND month(period_start) <> 2
      UNION ALL SELECT 'season_not_twelve_months', count(*) FROM (SELECT DISTINCT {sql.KT}, metric_name FROM season)
      UNION ALL SELECT 'season_without_one_peak_and_trough', count(*) FROM ({_SEASON_LEFT}) WHERE peaks <> 1 OR troughs <> 1
      UNION ALL SELECT 'season_mean_not_one', count(*) FROM ({_SEASON_LEFT}) WHERE abs(mean - 1) > 1e-9 * greatest(abs(mean), 1))""",
    merge="sum",
)
simple(
    "backtest_checks",
    lambda run: quality.backtest_checks(
        run.outcomes.withColumn(
            "outcome_period_start",
            F.when(_theme("Unknown") & (F.col("outcome_horizon_months") == 3), F.col("decision_period_start")).otherwise(
                F.col("outcome_period_start")
            ),
        ),
        run.table("feature_metrics").where(F.col("feature_name") != "legacy_6m_momentum_score"),
        run.totals.where(~_in_month(9)),
        run.structure.where(~_theme("N/A")),
    ),
    "rule row_count",
    """FROM (SELECT 'feature_registry_incomplete' AS rule, 1 AS row_count
      UNION ALL SELECT 'outcome_month_not_stored', count(DISTINCT CASE WHEN game_theme = 'Unknown' AND outcome_horizon_months = 3
        THEN decision_period_start ELSE outcome_period_start END) FROM outcomes
        WHERE month(CASE WHEN game_theme = 'Unknown' AND outcome_horizon_months = 3 THEN decision_period_start ELSE outcome_period_start END) = 9
      UNION ALL SELECT 'outcome_month_not_at_horizon', count(*) FROM outcomes WHERE game_theme = 'Unknown' AND outcome_horizon_months = 3
      UNION ALL SELECT 'outcome_without_decision_theme', count(DISTINCT decision_period_start) FROM outcomes WHERE game_theme = 'N/A')""",
    merge="sum",
)


def _faulty_decisions(run: Stages) -> DataFrame:
    """Decision tables of one stamp but for the risks of one scope."""
    stamp = F.lit("2002-01-01 00:00:00").cast("timestamp")
    summaries = decision.decision_summaries(run.assessed).where(~_in_month(11))
    windows = decision.launch_window_assessments(run.assessed).where(~_theme("N/A") & ~(_theme("Unknown") & (F.col("horizon_months") == 2)))
    late = F.when(F.col("scope_name") == "niche", stamp + F.expr("INTERVAL 1 SECOND")).otherwise(stamp)
    return quality.decision_checks(
        summaries.unionByName(summaries.where(_theme("Unknown") & _in_month(3))).withColumn("calculated_at", stamp),
        windows.withColumns({"is_forecast": _in_month(5) & (F.col("horizon_months") == 1), "calculated_at": stamp}),
        decision.risk_rows(run.assessed).withColumn("calculated_at", late),
        run.fits.where(~_in_month(6)),
        decision.migration_hypotheses(run.fits),
    )


simple(
    "decision_checks",
    _faulty_decisions,
    "rule row_count",
    f"""FROM (SELECT 'duplicate_decision' AS rule, count(*) AS row_count FROM decisions WHERE game_theme = 'Unknown' AND month(period_start) = 3
      UNION ALL SELECT 'not_three_windows', count(*) FROM decisions WHERE game_theme = 'Unknown'
      UNION ALL SELECT 'window_marked_as_forecast', count(*) FROM decisions WHERE game_theme <> 'N/A' AND month(period_start) = 5
      UNION ALL SELECT 'decision_without_windows', count(*) FROM decisions WHERE game_theme = 'N/A' AND month(period_start) <> 11
      UNION ALL SELECT 'window_without_decision', count(*) FROM decisions WHERE game_theme <> 'N/A' AND month(period_start) = 11
      UNION ALL SELECT 'risk_without_decision', count(DISTINCT ({sql.KT})) FROM risks WHERE month(period_start) = 11
      UNION ALL SELECT 'migration_source_not_validated', count(DISTINCT ({sql.KT}, validated_source_game_subgenre)) FROM migrations WHERE month(period_start) = 6
      UNION ALL SELECT 'migration_target_not_observed', count(DISTINCT ({sql.KT}, target_observed_game_subgenre)) FROM migrations WHERE month(period_start) = 6
      UNION ALL SELECT 'more_than_one_calculated_at', ($scope = 'niche')::INTEGER)""",
    merge="sum",
)
#: Tables of the value rules: (relation of the run, columns, relation of the reference SQL).
CHECKED_TABLES: dict[str, tuple[Callable[[Stages], DataFrame], str, str]] = {
    "snapshots": (lambda run: run.snapshots, f"{PC} rank_position", "snap"),
    "totals": (lambda run: run.totals, TOTAL_COLUMNS, "totals"),
    "themes": (lambda run: run.themes, THEME_METRICS, "themes"),
    "structure": (lambda run: run.structure, sql.STRUCTURE_COLUMNS, "structure"),
    "growth": (
        lambda run: run.growth,
        f"{TC} {MEMBERSHIP} {' '.join(opportunity.TURNOVER_COLUMNS + opportunity.RETENTION_COLUMNS + opportunity.DECOMPOSITION_COLUMNS)}",
        "growth",
    ),
    "dimensions": (lambda run: run.dimensions, DIMENSION_METRICS, "dims"),
    "leaders": (lambda run: run.leaders, f"{TC} evidence_type evidence_rank rank_position previous_rank_position", "leaders"),
    "scores": (lambda run: run.scores, sql.SCORE_COLUMNS, "scores"),
    "horizons": (lambda run: run.horizons, sql.HORIZON_COLUMNS, "horizons"),
    "seasonality": (lambda run: run.seasonality, sql.SEASON_COLUMNS, "season"),
    "summaries": (lambda run: run.summaries, sql.SUMMARY_COLUMNS, "summaries"),
    "outcomes": (lambda run: run.outcomes, sql.OUTCOME_COLUMNS, "outcomes"),
    "feature_metrics": (lambda run: run.table("feature_metrics"), sql.FEATURE_METRIC_COLUMNS, "feature_results"),
    "segment_metrics": (lambda run: run.table("segment_metrics"), sql.SEGMENT_COLUMNS, "segment_results"),
    "profiles": (lambda run: _valid_profiles(run), sql.PROFILE_COLUMNS, "profile_rows"),
    "proxies": (lambda run: run.proxies, sql.PROXY_COLUMNS, "proxies"),
    "fits": (lambda run: run.fits, sql.FIT_COLUMNS, "fits"),
    "migrations": (lambda run: decision.migration_hypotheses(run.fits), sql.MIGRATION_COLUMNS, "migrations"),
    "decisions": (lambda run: decision.decision_summaries(run.assessed), sql.DECISION_COLUMNS, "decisions"),
    "windows": (
        lambda run: decision.launch_window_assessments(run.assessed),
        f"{TC} decision_policy_version horizon_months evidence_state confidence",
        "(SELECT *, unnest([1, 2, 3]) AS horizon_months FROM decisions)",
    ),
    "risks": (
        lambda run: decision.risk_rows(run.assessed),
        f"{TC} decision_policy_version risk_code severity evidence_availability",
        "risks",
    ),
}


#: Tables that are built and written at the same time, so that small jobs and planning do not leave the cluster idle.
TABLES_AT_ONCE = 4


def _valid_profiles(run: Stages) -> DataFrame:
    """The rows of the stage, not stored a second time before they are written with their faulty copies."""
    run.require_valid_input()
    return proxy.product_revenue_profiles(run.snapshots)


def _chosen(columns: str) -> str:
    """Rows whose copies are broken: one month, or one horizon where a table has no months."""
    names = columns.split()
    month = next((name for name in ("period_start", "decision_period_start") if name in names), None)
    return f"{month} = DATE '1995-03-01'" if month else "outcome_horizon_months = 2"


def _value_checks(run: Stages) -> DataFrame:
    """Rows without each rule: of the tables as they are, and of the copies made to break it."""
    root = scratch_dir(run.spark)

    def counted(table: str) -> list[tuple[str, str, str, int]]:
        build, columns, _ = CHECKED_TABLES[table]
        names = columns.split()
        own = rules.value_rules(table, names)
        stored, fault = F.col("fault_rule").isNull(), F.col("fault_rule").isNotNull()
        counts = {("stored", rule.name): rules.broken(rule, stored) for rule in own}
        counts |= {("faulty", rule.name): rules.broken(rule, fault) for rule in own}
        frame = rules.with_faults(build(run).select(*names), own, F.expr(_chosen(columns)))
        return [(table, *key, number) for key, number in rules.write_checked(frame, f"{root}/{table}", counts).items()]

    with ThreadPoolExecutor(TABLES_AT_ONCE) as pool:
        inherit = inheritable_thread_target(run.spark)
        started = [pool.submit(inherit(counted), table) for table in CHECKED_TABLES]
        rows = [row for future in started for row in future.result()]
    return run.spark.createDataFrame(rows, "table_name string, source string, rule string, row_count long")


def _value_checks_sql() -> str:
    return "FROM (" + "\nUNION ALL ".join(
        sql.rule_counts(table, relation, columns.split(), rules.value_rules(table, columns.split()), _chosen(columns), rules.fault)
        for table, (_, columns, relation) in CHECKED_TABLES.items()
    ) + ")"


simple("value_checks", _value_checks, "table_name source rule row_count", _value_checks_sql(), merge="sum")


def _with_bad_rows(run: Stages) -> DataFrame:
    """One scope without its Julys, negative revenue, and products of a label without id and with ranks below one."""
    other = F.col("game_theme") == "N/A"
    strange = (F.col("game_theme") == "Unknown") & (F.month("period_start") == 4)
    return run.snapshots.where((F.month("period_start") != 7) | (F.col("scope_name") == "market")).withColumns(
        {
            "revenue_absolute": F.when(strange, -1.0).otherwise(F.col("revenue_absolute")),
            "unified_app_id": F.when(other, None).otherwise(F.col("unified_app_id")),
            "rank_position": F.when(other, -F.col("rank_position")).otherwise(F.col("rank_position")),
        }
    )


simple(
    "input_violations",
    lambda run: quality.input_violations(_with_bad_rows(run)),
    f"{PC} rule row_count",
    f"""FROM (SELECT {sql.K}, 'invalid_revenue' AS rule, count(*) AS row_count FROM snap WHERE game_theme = 'Unknown' AND month(period_start) = 4 GROUP BY ALL
      UNION ALL SELECT {sql.K}, 'product_without_id', count(*) FROM snap WHERE game_theme = 'N/A' GROUP BY ALL
      UNION ALL SELECT {sql.K}, 'rank_not_positive', count(*) FROM snap WHERE game_theme = 'N/A' GROUP BY ALL
      UNION ALL SELECT {sql.K}, 'duplicate_product', 1 FROM snap WHERE game_theme = 'N/A' GROUP BY ALL HAVING count(*) > 1
      UNION ALL SELECT {sql.K}, 'month_before_missing', 1 FROM months WHERE month(period_start) = 8 AND scope_name = 'niche' AND has_previous_month)
    WHERE NOT (month(period_start) = 7 AND scope_name = 'niche')""",
)
simple(
    "run_summary",
    lambda run: quality.run_summary(run.totals, {"themes": run.themes, "structure": run.structure, "leaders": run.leaders}, run.dimensions),
    "name row_count",
    """FROM (SELECT 'source_snapshots' AS name, sum(snapshot_count) AS row_count FROM totals UNION ALL SELECT 'source_missing_theme', sum(theme_missing_count) FROM totals
      UNION ALL SELECT 'source_units_coverage', sum(units_absolute_coverage_count) FROM totals UNION ALL SELECT 'source_revenue_coverage', sum(revenue_absolute_coverage_count) FROM totals
      UNION ALL SELECT 'themes', count(*) FROM themes UNION ALL SELECT 'structure', count(*) FROM structure UNION ALL SELECT 'leaders', count(*) FROM leaders
      UNION ALL SELECT 'dimension_' || dimension_type, count(*) FROM dims GROUP BY 1)""",
    merge="sum",
)

# Reconciliation of the score table with an external record table.
_STAMP = "2002-01-01 00:00:00"
sql.BLOCKS["desired"] = f"""
  SELECT *, 'managed:v1:' || strftime(period_start, '%Y-%m') || ':' || sha256(concat_ws(chr(31), scope_name, cadence, strftime(period_start, '%Y-%m-%d'),
      strftime(period_end, '%Y-%m-%d'), game_theme)) AS managed_key, period_start = (SELECT max(period_start) FROM scores) AS is_latest_month,
    epoch_ms(period_start::TIMESTAMP) AS period_millis, epoch_ms(TIMESTAMP '{_STAMP}') AS calculated_millis,
    row_number() OVER (ORDER BY period_start, game_theme) AS place FROM scores"""


def _desired(run: Stages) -> DataFrame:
    return reconcile.desired_records(run.scores.withColumn("calculated_at", F.lit(_STAMP).cast("timestamp")))


def _existing(run: Stages, duplicates: bool) -> DataFrame:
    """External records: January is not there yet, June scores moved, Unknown is stale or listed twice."""
    desired = _desired(run)
    fields = [c for c in desired.columns if c.startswith("field_")]
    month, theme = F.month("period_start"), F.col("game_theme")
    known = desired.where(month != 1).select(
        F.concat(F.lit("rec-"), "managed_key").alias("record_id"),
        F.when(theme == "N/A", F.lit(" ")).otherwise(F.col("managed_key")).alias("primary_value"),
        *[
            F.when(month == 6, F.col(c) + 0.5).otherwise(F.col(c) + 1e-12).alias(c) if c == "field_confidence_score" else F.col(c)
            for c in fields
        ],
    )
    if not duplicates:
        return known
    again = desired.where((month != 1) & (theme == "Unknown")).select(
        F.concat(F.lit("zzz-"), "managed_key").alias("record_id"), F.col("managed_key").alias("primary_value"), *fields
    )
    return known.unionByName(again)


simple(
    "managed_key",
    _desired,
    f"{TC} managed_key",
    "FROM desired",
)
#: Fields whose values are numbers here and dates or whole numbers in the score table.
_FIELD_NAMES = {
    "period_start": "period_millis",
    "calculated_at": "calculated_millis",
    "trend_rank": "rank_value",
    "latest_product_count": "product_count_value",
}
simple(
    "desired_records",
    lambda run: _desired(run).select("managed_key", *[F.col(f"field_{c}").alias(_FIELD_NAMES.get(c, c)) for c in reconcile.SYNC_COLUMNS]),
    "managed_key " + " ".join(_FIELD_NAMES.get(c, c) for c in reconcile.SYNC_COLUMNS),
    "FROM (SELECT *, trend_rank AS rank_value, latest_product_count AS product_count_value FROM desired)",
)
_MOVED = "CASE WHEN month(period_start) = 6 THEN 'confidence_score' END"
simple(
    "reconcile",
    lambda run: reconcile.reconcile(_desired(run).where(F.col("game_theme") != "Unknown"), _existing(run, False)),
    "managed_key record_count action changed",
    f"""FROM (SELECT managed_key, CASE WHEN month(period_start) = 1 OR game_theme = 'N/A' THEN 0 ELSE 1 END AS record_count,
        CASE WHEN month(period_start) = 1 OR game_theme = 'N/A' THEN 'create' WHEN game_theme = 'Unknown' THEN 'stale' WHEN month(period_start) = 6 THEN 'update' ELSE 'unchanged' END AS action,
        CASE WHEN game_theme NOT IN ('N/A', 'Unknown') THEN {_MOVED} END AS changed
      FROM desired WHERE NOT (game_theme = 'Unknown' AND month(period_start) = 1))""",
)
simple(
    "reconcile_with_duplicates",
    lambda run: reconcile.reconciliation_summary(
        reconcile.reconcile(_desired(run), _existing(run, True)), _existing(run, True)
    ),
    "action row_count",
    """FROM (SELECT CASE WHEN game_theme = 'Unknown' AND month(period_start) <> 1 THEN 'duplicate' ELSE 'blocked' END AS action, count(*) AS row_count FROM desired GROUP BY 1
      UNION ALL SELECT 'managed', count(*) + count(*) FILTER (game_theme = 'Unknown') FROM desired WHERE month(period_start) <> 1 AND game_theme <> 'N/A'
      UNION ALL SELECT 'unmanaged_blank', count(*) FROM desired WHERE month(period_start) <> 1 AND game_theme = 'N/A')""",
    merge="sum",
)
simple(
    "changed_fields",
    lambda run: reconcile.reconcile(_desired(run), _existing(run, False))
    .select("managed_key", "changed", F.explode("changes").alias("c"))
    .select("managed_key", "changed", F.col("c.number").alias("new_number"), F.col("c.text").alias("name")),
    "managed_key changed new_number name",
    """FROM (SELECT managed_key, 'confidence_score' AS changed, confidence_score AS new_number, NULL::VARCHAR AS name
      FROM desired WHERE month(period_start) = 6 AND game_theme <> 'N/A')""",
)
simple(
    "normalize_cells",
    lambda run: driver_tables.table(run.spark, run.source, "part").select(
        F.col("p_partkey").alias("part_id"),
        reconcile.normalize_text_cell(
            F.transform(F.split("p_name", " "), lambda word: F.named_struct(F.lit("text"), word))
        ).alias("name"),
        reconcile.normalize_number_cell(
            F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit(" "), F.col("p_retailprice")))
            .when(F.col("p_partkey") % 3 == 1, F.lit("1_000"))
            .otherwise(F.lit("NaN"))
        ).alias("amount"),
    ),
    "part_id name amount",
    "FROM (SELECT p_partkey AS part_id, replace(p_name, ' ', '') AS name, CASE WHEN p_partkey % 3 = 0 THEN p_retailprice END AS amount FROM part)",
)


def _batches(run: Stages) -> DataFrame:
    """Batches over what is to be written: the rows to create and the rows to update of each scope."""
    desired = _desired(run)
    plan = reconcile.reconcile(desired, _existing(run, False)).where(F.col("action").isin("create", "update"))
    rows = desired.join(plan.select("managed_key", "action"), "managed_key")
    return reconcile.write_batches(rows, PERIOD, ["game_theme"], 100, ["scope_name", "action"])


simple(
    "write_batches",
    _batches,
    f"{TC} managed_key action batch_number",
    """FROM (SELECT *, (row_number() OVER (PARTITION BY scope_name, action ORDER BY period_start, game_theme) - 1) // 100 + 1 AS batch_number FROM
      (SELECT *, CASE WHEN month(period_start) = 1 OR game_theme = 'N/A' THEN 'create' ELSE 'update' END AS action
       FROM desired WHERE game_theme = 'N/A' OR month(period_start) IN (1, 6)))""",
)
