"""Leakage-safe outcomes one to three months after each decision month, and how features predicted them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from themelens.constants import (
    BACKTEST_POLICY,
    CHANGE_OUTCOMES,
    FEATURES,
    LOW_SAMPLE_MONTHS,
    LOW_SAMPLE_ROWS,
    MIN_COHORT,
    MODEL_METRICS,
    OUTCOME_HORIZONS,
    OUTCOMES,
    SEGMENTS,
    SHARE_METRICS,
    THEME,
    TOP_FRACTION,
)
from themelens.functions.numeric import count_where, is_close, is_positive_change, share, wilson_bounds
from themelens.operators.ordering import average_rank_percentiles, quantiles

IDENTITY = [
    "scope_name",
    "cadence",
    "decision_period_start",
    "decision_period_end",
    "outcome_horizon_months",
    "game_theme",
]
COHORT = ["scope_name", "cadence", "decision_period_start", "outcome_horizon_months"]
TIE_DIGITS = 12
QUARTILES = {"_p25": 0.25, "_p50": 0.5, "_p75": 0.75}


def decision_population(scores: DataFrame, summaries: DataFrame, totals: DataFrame) -> DataFrame:
    """Theme months with a score or six months of history whose T+1, T+2 or T+3 month is stored."""
    candidates = (
        scores.select(*THEME).unionByName(summaries.where("has_6m_history").select(*THEME)).distinct()
    )
    reachable = totals.select(
        "scope_name",
        "cadence",
        F.explode(F.array(*[F.add_months("period_start", -h) for h in OUTCOME_HORIZONS])).alias("period_start"),
    ).distinct()
    return candidates.join(reachable, ["scope_name", "cadence", "period_start"], "left_semi")


def population_violations(population: DataFrame, evidence: dict[str, DataFrame]) -> DataFrame:
    """Decision theme months that lack a row in one of the evidence tables."""
    found = None
    for name, table in evidence.items():
        part = population.join(table.select(*THEME), THEME, "left_anti").withColumn("missing_table", F.lit(name))
        found = part if found is None else found.unionByName(part)
    return found


def _renamed_decision(df: DataFrame) -> DataFrame:
    return df.withColumnRenamed("period_start", "decision_period_start").withColumnRenamed(
        "period_end", "decision_period_end"
    )


def expected_seasonal_index(profiles: DataFrame) -> DataFrame:
    """Seasonal index of both measures per theme month and calendar month."""
    rows = profiles.where(F.col("metric_name").isin("downloads_sum", "revenue_usd_sum"))
    return rows.groupBy(*THEME, "calendar_month").agg(
        *[
            F.max(F.when(F.col("metric_name") == f"{prefix}_sum", F.col("seasonal_index"))).alias(
                f"decision_{prefix}_expected_seasonal_index"
            )
            for prefix in ("downloads", "revenue_usd")
        ]
    )


def change_direction(before: Column, after: Column) -> Column:
    return (
        F.when(before.isNull() | after.isNull(), "unavailable")
        .when(is_close(after, before), "unchanged")
        .when(after > before, "up")
        .otherwise("down")
    )


SUMMARY_COLUMNS = (
    *[f"has_{h}m_history" for h in (6, 12, 36)],
    *[f"direction_{h}m" for h in (6, 12, 36)],
    *[f"direction_evidence_count_{h}m" for h in (6, 12, 36)],
    *[f"median_normalized_slope_{h}m" for h in (6, 12, 36)],
    *[f"stability_cv_median_{h}m" for h in (6, 12, 36)],
    *[f"stability_band_{h}m" for h in (6, 12, 36)],
    "lifecycle_stage",
    "first_active_left_censored",
    "months_since_first_active",
)
STRUCTURE_COLUMNS = (
    *MODEL_METRICS,
    "downloads_product_hhi",
    "revenue_usd_product_hhi",
    "publisher_downloads_hhi",
    "publisher_revenue_usd_hhi",
)
GROWTH_COLUMNS = (
    "top_500_turnover_rate",
    "market_new_entry_share",
    "downloads_market_new_entry_share_of_current",
    "revenue_usd_market_new_entry_share_of_current",
    "downloads_top_10_positive_contribution_share",
    "revenue_usd_top_10_positive_contribution_share",
)


def launch_window_outcomes(
    totals: DataFrame,
    structure: DataFrame,
    growth: DataFrame,
    scores: DataFrame,
    summaries: DataFrame,
    profiles: DataFrame,
) -> DataFrame:
    """Decision-month evidence next to the exact values of month T+h; an absent future theme is six zeros."""
    decisions = (
        decision_population(scores, summaries, totals)
        .join(structure.select(*THEME, *STRUCTURE_COLUMNS), THEME)
        .join(growth.select(*THEME, *GROWTH_COLUMNS), THEME)
        .join(
            scores.select(
                *THEME,
                F.col("is_actionable").alias("legacy_is_actionable"),
                F.col("exclusion_reason").alias("legacy_exclusion_reason"),
                F.col("confidence_score").alias("legacy_confidence_score"),
                F.col("trend_score").alias("legacy_6m_momentum_score"),
                F.col("trend_rank").alias("legacy_6m_momentum_rank"),
            ),
            THEME,
        )
        .join(
            summaries.select(
                *THEME,
                "model_policy_version",
                *SUMMARY_COLUMNS,
                "downloads_seasonality_amplitude",
                "revenue_usd_seasonality_amplitude",
            ),
            THEME,
        )
    )
    for name in (*STRUCTURE_COLUMNS, *GROWTH_COLUMNS):
        decisions = decisions.withColumnRenamed(name, f"decision_{name}")
    expanded = _renamed_decision(decisions).withColumn(
        "outcome_horizon_months", F.explode(F.array(*[F.lit(h) for h in OUTCOME_HORIZONS]))
    )
    expanded = expanded.withColumn(
        "outcome_period_start", F.add_months("decision_period_start", F.col("outcome_horizon_months"))
    ).withColumn("outcome_period_end", F.last_day("outcome_period_start"))
    months = totals.select("scope_name", "cadence", F.col("period_start").alias("outcome_period_start"))
    future = structure.select(
        "scope_name",
        "cadence",
        "game_theme",
        F.col("period_start").alias("outcome_period_start"),
        F.lit(True).alias("_future"),
        *[F.col(name).alias(f"_future_{name}") for name in MODEL_METRICS],
    )
    seasonal = _renamed_decision(expected_seasonal_index(profiles)).withColumnRenamed("calendar_month", "_month")
    joined = (
        expanded.join(months, ["scope_name", "cadence", "outcome_period_start"])
        .join(future, ["scope_name", "cadence", "game_theme", "outcome_period_start"], "left")
        .withColumn("_month", F.month("outcome_period_start"))
        .join(
            seasonal,
            ["scope_name", "cadence", "decision_period_start", "decision_period_end", "game_theme", "_month"],
            "left",
        )
        .withColumn("future_theme_present", F.coalesce("_future", F.lit(False)))
    )
    futures, changes, directions = {}, {}, {}
    for name in MODEL_METRICS:
        zero = F.lit(0) if name == "product_count" else F.lit(0.0)
        futures[f"future_{name}"] = F.when(F.col("future_theme_present"), F.col(f"_future_{name}")).otherwise(zero)
        before, after = F.col(f"decision_{name}").cast("double"), F.col(f"future_{name}").cast("double")
        changes[f"{name}_absolute_change"] = after - before
        changes[f"{name}_relative_change"] = F.when(before > 0, (after - before) / before)
        if name in SHARE_METRICS:
            directions[f"{name}_change_direction"] = change_direction(before, after)
    amplitudes = {
        f"decision_{prefix}_seasonality_amplitude": F.when(
            F.col(f"decision_{prefix}_expected_seasonal_index").isNotNull(), F.col(f"{prefix}_seasonality_amplitude")
        )
        for prefix in ("downloads", "revenue_usd")
    }
    rows = joined.withColumns(futures).withColumns({**changes, **directions, **amplitudes})
    rows = with_future_ranks(rows)
    return rows.select(
        *IDENTITY[:4],
        "outcome_horizon_months",
        "outcome_period_start",
        "outcome_period_end",
        "game_theme",
        F.lit(BACKTEST_POLICY).alias("backtest_policy_version"),
        "model_policy_version",
        "legacy_is_actionable",
        "legacy_exclusion_reason",
        "legacy_confidence_score",
        "legacy_6m_momentum_score",
        "legacy_6m_momentum_rank",
        *SUMMARY_COLUMNS,
        *[f"decision_{name}" for name in (*STRUCTURE_COLUMNS, *GROWTH_COLUMNS)],
        *[f"decision_{prefix}_expected_seasonal_index" for prefix in ("downloads", "revenue_usd")],
        *amplitudes,
        "future_theme_present",
        *futures,
        *changes,
        *directions,
        *[f"future_{name}_percentile" for name in SHARE_METRICS],
        *[f"future_{name}_top_quintile" for name in SHARE_METRICS],
    )


def with_future_ranks(rows: DataFrame) -> DataFrame:
    """Add 0..1 percentiles and top-quintile flags of the three future shares per decision month and horizon."""
    percentiles = future_percentiles(rows)
    flags = top_quintile_flags(rows, {f"future_{name}": F.col(f"future_{name}") for name in SHARE_METRICS})
    flags = flags.select(
        *IDENTITY, *[F.col(f"future_{name}").alias(f"future_{name}_top_quintile") for name in SHARE_METRICS]
    )
    return (
        rows.join(percentiles, IDENTITY, "left")
        .join(flags, IDENTITY, "left")
        .withColumn("future_product_share_percentile", F.coalesce("future_product_share_percentile", F.lit(0.5)))
    )


def future_percentiles(rows: DataFrame) -> DataFrame:
    return average_rank_percentiles(
        rows, COHORT, IDENTITY, {f"future_{name}_percentile": F.col(f"future_{name}") for name in SHARE_METRICS}
    )


def top_count(size: Column) -> Column:
    return F.greatest(F.lit(1), F.ceil(size * F.lit(TOP_FRACTION)))


def top_quintile_flags(rows: DataFrame, values: dict[str, Column]) -> DataFrame:
    """TRUE for the top fifth of a cohort by (-value, theme), NULL in cohorts below five rows.

    One boolean column per value name; a row without any value is absent.
    """
    entries = F.array(
        *[F.struct(F.lit(n).alias("_name"), F.round(v, TIE_DIGITS).alias("_v")) for n, v in values.items()]
    )
    long = rows.select(*IDENTITY, F.explode(entries).alias("_e")).select(*IDENTITY, "_e.*").where("_v is not null")
    cohort = Window.partitionBy(*COHORT, "_name")
    size = F.count(F.lit(1)).over(cohort)
    place = F.row_number().over(cohort.orderBy(F.col("_v").desc(), "game_theme"))
    flagged = long.withColumn("_top", F.when(size >= MIN_COHORT, place <= top_count(size)))
    return flagged.groupBy(*IDENTITY).agg(
        *[F.max(F.when(F.col("_name") == name, F.col("_top"))).alias(name) for name in values]
    )


def _ranges(totals: DataFrame) -> DataFrame:
    return totals.groupBy("scope_name", "cadence").agg(
        F.min("period_start").alias("backtest_start"), F.max("period_start").alias("backtest_end")
    )


def _literal_rows(names: list[str], rows: list[tuple]) -> Column:
    return F.explode(F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(names, row)]) for row in rows]))


def feature_registry(totals: DataFrame) -> DataFrame:
    """Every (horizon, feature, outcome) combination of each scope, so that empty pairs still get a row."""
    rows = [
        (h, name, group, hypothesis, outcome)
        for h in OUTCOME_HORIZONS
        for name, group, hypothesis, _ in FEATURES
        for outcome in OUTCOMES
    ]
    names = ["outcome_horizon_months", "feature_name", "feature_group", "feature_hypothesis", "outcome_name"]
    return _ranges(totals).withColumn("_r", _literal_rows(names, rows)).select("*", "_r.*").drop("_r")


def feature_pairs(outcomes: DataFrame) -> DataFrame:
    """Complete (feature, outcome) value pairs; features where lower is better change their sign."""
    features = F.array(
        *[
            F.struct(
                F.lit(name).alias("feature_name"),
                (F.col(column) if hypothesis == "higher_better" else -F.col(column)).cast("double").alias("feature"),
            )
            for name, _, hypothesis, column in FEATURES
        ]
    )
    results = F.array(*[F.struct(F.lit(n).alias("outcome_name"), F.col(n).alias("outcome")) for n in OUTCOMES])
    return (
        outcomes.select(*IDENTITY, *OUTCOMES, F.explode(features).alias("_f"))
        .where(F.col("_f.feature").isNotNull())
        .withColumn("_o", F.explode(results))
        .where(F.col("_o.outcome").isNotNull())
        .select(*IDENTITY, "_f.*", "_o.*")
    )


PAIR = ["scope_name", "cadence", "outcome_horizon_months", "feature_name", "outcome_name"]


def ranked_pairs(pairs: DataFrame) -> DataFrame:
    """Average ranks and top-fifth membership of both sides inside each decision month."""
    month = Window.partitionBy(*PAIR, "decision_period_start")
    rows = pairs.withColumns({"_fr": F.round("feature", TIE_DIGITS), "_or": F.round("outcome", TIE_DIGITS)})

    def average_rank(column: str) -> Column:
        ordered = month.orderBy(column)
        ties = ordered.rangeBetween(Window.currentRow, Window.currentRow)
        return F.rank().over(ordered) + (F.count(F.lit(1)).over(ties) - 1) / 2

    def is_top(column: str) -> Column:
        place = F.row_number().over(month.orderBy(F.col(column).desc(), "game_theme"))
        return place <= top_count(F.col("pair_count"))

    return (
        rows.withColumn("pair_count", F.count(F.lit(1)).over(month))
        .withColumns(
            {
                "feature_rank": average_rank("_fr"),
                "outcome_rank": average_rank("_or"),
                "feature_top": is_top("_fr"),
                "outcome_top": is_top("_or"),
            }
        )
        .drop("_fr", "_or")
    )


def oriented_spearman(ranked: DataFrame) -> DataFrame:
    """Rank correlation per decision month of at least five pairs; no row when one side is constant."""
    x, y = F.col("feature_rank"), F.col("outcome_rank")
    n = F.count(F.lit(1))
    # Ranks are multiples of one half, so these sums are exact and need no second pass.
    co = n * F.sum(x * y) - F.sum(x) * F.sum(y)
    xx = n * F.sum(x * x) - F.sum(x) * F.sum(x)
    yy = n * F.sum(y * y) - F.sum(y) * F.sum(y)
    return (
        ranked.where(F.col("pair_count") >= MIN_COHORT)
        .groupBy(*PAIR, "decision_period_start")
        .agg(co.alias("_co"), xx.alias("_xx"), yy.alias("_yy"))
        .where((F.col("_xx") > 0) & (F.col("_yy") > 0))
        .select(*PAIR, "decision_period_start", (F.col("_co") / (F.sqrt("_xx") * F.sqrt("_yy"))).alias("spearman"))
    )


def spearman_distribution(spearman: DataFrame) -> DataFrame:
    """Mean, quartiles and positive share of the monthly correlations with its Wilson interval."""
    count, positive = F.count(F.lit(1)), count_where(F.round("spearman", TIE_DIGITS) > 0)
    # One correlation per decision month, so the built-in exact quantiles are bounded by the month count.
    quartiles = F.percentile("spearman", F.array(*[F.lit(q) for q in QUARTILES.values()]))
    low, high = wilson_bounds(F.col("positive_spearman_cohort_count"), F.col("correlation_cohort_count"))
    return (
        spearman.groupBy(*PAIR)
        .agg(
            count.alias("correlation_cohort_count"),
            F.avg("spearman").alias("mean_spearman"),
            positive.alias("positive_spearman_cohort_count"),
            quartiles.alias("_q"),
        )
        .select(
            *PAIR,
            "correlation_cohort_count",
            "mean_spearman",
            F.get("_q", F.lit(1)).alias("median_spearman"),
            F.get("_q", F.lit(0)).alias("p25_spearman"),
            F.get("_q", F.lit(2)).alias("p75_spearman"),
            "positive_spearman_cohort_count",
            share(F.col("positive_spearman_cohort_count"), F.col("correlation_cohort_count")).alias(
                "positive_spearman_cohort_ratio"
            ),
            low.alias("positive_spearman_ci_low"),
            high.alias("positive_spearman_ci_high"),
        )
    )


def _pair_counts(ranked: DataFrame) -> DataFrame:
    """Eligible rows, top-fifth selection, hits and positive changes per (horizon, feature, outcome)."""
    cohort = F.col("pair_count") >= MIN_COHORT
    selected = cohort & F.col("feature_top")
    value = F.col("outcome")
    positive = is_positive_change(value)
    per_month = ranked.groupBy(*PAIR, "decision_period_start").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(value).alias("total"),
        F.max(cohort.cast("int")).alias("cohort"),
        count_where(selected).alias("selected"),
        count_where(selected & F.col("outcome_top")).alias("hits"),
        count_where(cohort & F.col("outcome_top")).alias("outcome_top"),
        count_where(cohort).alias("population"),
        F.sum(F.when(selected, value)).alias("selected_total"),
        count_where(positive).alias("positive"),
        count_where(selected & positive).alias("selected_positive"),
    )
    return per_month.groupBy(*PAIR).agg(
        F.count(F.lit(1)).alias("decision_month_count"),
        *[
            F.sum(name).alias(f"_{name}")
            for name in (
                "n",
                "total",
                "cohort",
                "selected",
                "hits",
                "outcome_top",
                "population",
                "selected_total",
                "positive",
                "selected_positive",
            )
        ],
    )


def top_quintile_lift(ranked: DataFrame) -> DataFrame:
    """Hit rate of the feature's top fifth against the outcome's base rate."""
    counts = _pair_counts(ranked)
    return counts.select(*PAIR, *_lift_columns())


def _lift_columns() -> list[Column]:
    rate = share(F.col("_hits"), F.col("_selected"))
    base = share(F.col("_outcome_top"), F.col("_population"))
    low, high = wilson_bounds(F.col("_hits"), F.col("_selected"))
    some = F.col("_cohort") > 0
    return [
        F.when(some, F.col("_cohort")).alias("top_quintile_cohort_count"),
        F.when(some, F.col("_selected")).alias("top_quintile_selected_count"),
        F.when(some, F.col("_hits")).alias("top_quintile_hit_count"),
        rate.alias("top_quintile_hit_rate"),
        low.alias("top_quintile_hit_ci_low"),
        high.alias("top_quintile_hit_ci_high"),
        base.alias("future_top_quintile_base_rate"),
        F.when(base != 0, rate / base).alias("top_quintile_lift"),
    ]


def positive_change_rates(ranked: DataFrame) -> DataFrame:
    """Share of outcomes above zero among all pairs and among the selected ones, change outcomes only."""
    counts = _pair_counts(ranked).where(F.col("outcome_name").isin(*CHANGE_OUTCOMES))
    return counts.select(*PAIR, *_positive_columns())


def _positive_columns() -> list[Column]:
    is_change = F.col("outcome_name").isin(*CHANGE_OUTCOMES)
    columns = []
    for prefix, hits, trials in (
        ("top_quintile_positive_change", F.col("_selected_positive"), F.col("_selected")),
        ("all_positive_change", F.col("_positive"), F.col("_n")),
    ):
        usable = is_change & (trials > 0)
        low, high = wilson_bounds(hits, trials)
        columns += [
            F.when(usable, hits).alias(f"{prefix}_count"),
            F.when(usable, share(hits, trials)).alias(f"{prefix}_rate"),
            F.when(usable, low).alias(f"{prefix}_ci_low"),
            F.when(usable, high).alias(f"{prefix}_ci_high"),
        ]
    return columns


def low_sample_warning(rows: Column, months: Column) -> Column:
    return (rows < LOW_SAMPLE_ROWS) | (months < LOW_SAMPLE_MONTHS)


def feature_metrics(outcomes: DataFrame, totals: DataFrame, ranked: DataFrame) -> DataFrame:
    """All 228 feature / outcome / horizon rows of each scope, from the ranked pairs of ``outcomes``."""
    candidates = outcomes.groupBy("scope_name", "cadence", "outcome_horizon_months").agg(
        F.count(F.lit(1)).alias("_candidates")
    )
    selected = (F.col("pair_count") >= MIN_COHORT) & F.col("feature_top")
    middle = quantiles(
        ranked,
        PAIR,
        {"_all": F.col("outcome"), "_picked": F.when(selected, F.col("outcome"))},
        {"": 0.5},
        candidates.withColumnRenamed("_candidates", "_n"),
    )
    joined = (
        feature_registry(totals)
        .join(candidates, ["scope_name", "cadence", "outcome_horizon_months"], "left")
        .join(_pair_counts(ranked), PAIR, "left")
        .join(spearman_distribution(oriented_spearman(ranked)), PAIR, "left")
        .join(middle, PAIR, "left")
    )

    def zero(name: str) -> Column:
        return F.coalesce(F.col(name), F.lit(0))

    eligible, months = zero("_n"), zero("decision_month_count")
    return joined.select(
        "scope_name",
        "cadence",
        "backtest_start",
        "backtest_end",
        "outcome_horizon_months",
        "feature_name",
        "feature_group",
        "feature_hypothesis",
        "outcome_name",
        F.lit(BACKTEST_POLICY).alias("backtest_policy_version"),
        zero("_candidates").alias("candidate_row_count"),
        eligible.alias("eligible_row_count"),
        F.coalesce(share(eligible, zero("_candidates")), F.lit(0.0)).alias("coverage_ratio"),
        months.alias("decision_month_count"),
        zero("correlation_cohort_count").alias("correlation_cohort_count"),
        "mean_spearman",
        "median_spearman",
        "p25_spearman",
        "p75_spearman",
        "positive_spearman_cohort_count",
        "positive_spearman_cohort_ratio",
        "positive_spearman_ci_low",
        "positive_spearman_ci_high",
        *_lift_columns(),
        share(F.col("_selected_total"), F.col("_selected")).alias("top_quintile_outcome_mean"),
        F.col("_picked").alias("top_quintile_outcome_median"),
        share(F.col("_total"), F.col("_n")).alias("all_eligible_outcome_mean"),
        F.col("_all").alias("all_eligible_outcome_median"),
        *_positive_columns(),
        low_sample_warning(eligible, months).alias("low_sample_warning"),
    )


def segment_metrics(outcomes: DataFrame, totals: DataFrame) -> DataFrame:
    """Outcome distribution and top-fifth rate per observed segment value."""
    flags = top_quintile_flags(outcomes, {name: F.col(name) for name in OUTCOMES})
    flags = flags.select(*IDENTITY, *[F.col(name).alias(f"_top_{name}") for name in OUTCOMES])
    values = {
        name: (
            F.when(F.col("legacy_is_actionable"), "actionable").otherwise("non_actionable")
            if name == "legacy_actionability"
            else F.col(name)
        )
        for name in SEGMENTS
    }
    segments = F.array(*[F.struct(F.lit(n).alias("segment_name"), v.alias("segment_value")) for n, v in values.items()])
    results = F.array(
        *[
            F.struct(F.lit(n).alias("outcome_name"), F.col(n).alias("outcome"), F.col(f"_top_{n}").alias("is_top"))
            for n in OUTCOMES
        ]
    )
    by_outcome = (
        outcomes.join(flags, IDENTITY, "left")
        .select(*IDENTITY, segments.alias("_s"), F.explode(results).alias("_o"))
        .select(*IDENTITY, "_s", "_o.*")
    )
    horizon = ["scope_name", "cadence", "outcome_horizon_months"]
    base = by_outcome.groupBy(*horizon, "outcome_name").agg(
        F.count(F.lit(1)).alias("_all_rows"),
        F.count("is_top").alias("_all_population"),
        count_where(F.col("is_top")).alias("_all_top"),
    )
    rows = by_outcome.withColumn("_s", F.explode("_s")).select(
        *horizon, "decision_period_start", "outcome_name", "outcome", "is_top", "_s.*"
    )
    keys = [*horizon, "segment_name", "segment_value", "outcome_name"]
    counts = (
        rows.groupBy(*keys, "decision_period_start")
        .agg(
            F.count(F.lit(1)).alias("rows"),
            F.count("outcome").alias("n"),
            F.sum("outcome").alias("total"),
            F.count("is_top").alias("flagged"),
            count_where(F.col("is_top")).alias("top"),
            count_where(is_positive_change(F.col("outcome"))).alias("positive"),
        )
        .groupBy(*keys)
        .agg(
            count_where(F.col("n") > 0).alias("decision_month_count"),
            *[F.sum(c).alias(f"_{c}") for c in ("rows", "n", "total", "flagged", "top", "positive")],
        )
    )
    # No segment of a horizon has more rows than the horizon.
    sizes = outcomes.groupBy(*horizon).agg(F.count(F.lit(1)).alias("_n"))
    middle = quantiles(rows, keys, {"_q": F.col("outcome")}, QUARTILES, sizes)
    rate = share(F.col("_top"), F.col("_flagged"))
    base_rate = share(F.col("_all_top"), F.col("_all_population"))
    top_low, top_high = wilson_bounds(F.col("_top"), F.col("_flagged"))
    positive_low, positive_high = wilson_bounds(F.col("_positive"), F.col("_n"))
    is_change = F.col("outcome_name").isin(*CHANGE_OUTCOMES) & (F.col("_n") > 0)
    return (
        counts.join(middle, keys, "left")
        .join(base, [*horizon, "outcome_name"])
        .join(_ranges(totals), ["scope_name", "cadence"])
        .select(
            "scope_name",
            "cadence",
            "backtest_start",
            "backtest_end",
            "outcome_horizon_months",
            "segment_name",
            "segment_value",
            "outcome_name",
            F.lit(BACKTEST_POLICY).alias("backtest_policy_version"),
            F.col("_rows").alias("candidate_row_count"),
            F.col("_n").alias("eligible_row_count"),
            share(F.col("_n"), F.col("_rows")).alias("coverage_ratio"),
            "decision_month_count",
            share(F.col("_rows"), F.col("_all_rows")).alias("segment_row_share"),
            share(F.col("_total"), F.col("_n")).alias("outcome_mean"),
            F.col("_q_p50").alias("outcome_median"),
            F.col("_q_p25").alias("outcome_p25"),
            F.col("_q_p75").alias("outcome_p75"),
            F.col("_flagged").alias("future_top_quintile_eligible_count"),
            F.col("_top").alias("future_top_quintile_count"),
            rate.alias("future_top_quintile_rate"),
            top_low.alias("future_top_quintile_ci_low"),
            top_high.alias("future_top_quintile_ci_high"),
            base_rate.alias("future_top_quintile_base_rate"),
            F.when(base_rate != 0, rate / base_rate).alias("future_top_quintile_lift"),
            F.when(is_change, F.col("_positive")).alias("positive_change_count"),
            F.when(is_change, share(F.col("_positive"), F.col("_n"))).alias("positive_change_rate"),
            F.when(is_change, positive_low).alias("positive_change_ci_low"),
            F.when(is_change, positive_high).alias("positive_change_ci_high"),
            low_sample_warning(F.col("_n"), F.col("decision_month_count")).alias("low_sample_warning"),
        )
    )
