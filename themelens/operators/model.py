"""Trend, stability, lifecycle and seasonality evidence over 6, 12 and 36 months.

A target month reads only its own and earlier months: every statistic is a trailing window over the
series of one theme and metric, so later data cannot change an earlier row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from themelens.constants import (
    ACCELERATION_MARGIN,
    FLAT_SLOPE,
    HORIZONS,
    MIN_R_SQUARED,
    MODEL_METRICS,
    MODEL_POLICY,
    SEASON_MAX_MONTHS,
    SEASON_MIN_MONTHS,
    SERIES,
    SHARE_METRICS,
    STABLE_CV,
    THEME,
    VARIABLE_CV,
)
from themelens.functions.numeric import count_where, first_match, is_close, share
from themelens.operators.calendar import months_between, theme_month_grid

TIE_DIGITS = 12


def model_grid(totals: DataFrame, structure: DataFrame) -> DataFrame:
    """Theme x month grid, absent themes zero in all six metrics, with activity columns."""
    grid = theme_month_grid(totals, structure, (), MODEL_METRICS)
    filled = grid.withColumns(
        {
            name: F.when(F.col("is_present"), F.col(name).cast("double")).otherwise(F.lit(0.0))
            for name in MODEL_METRICS
        }
    )
    series = Window.partitionBy(*SERIES).orderBy("month_index")
    prefix = series.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    active = F.col("product_count") > 0
    activity = {
        f"active_months_{h}m": F.count(F.when(active, 1)).over(series.rowsBetween(-(h - 1), 0)) for h in HORIZONS
    }
    return filled.withColumns(
        {
            **activity,
            "active_months_to_date": F.count(F.when(active, 1)).over(prefix),
            "first_active_month": F.min(F.when(active, F.col("period_start"))).over(prefix),
            "history_start": F.first("period_start").over(prefix),
        }
    )


def metric_series(grid: DataFrame) -> DataFrame:
    """Long form: one row per theme, month and metric; missing values stay as NULL rows."""
    entries = F.array(*[F.struct(F.lit(name).alias("metric_name"), F.col(name).alias("value")) for name in MODEL_METRICS])
    return grid.select(
        "scope_name",
        "cadence",
        "game_theme",
        "period_start",
        "period_end",
        "month_index",
        "is_present",
        *[f"active_months_{h}m" for h in HORIZONS],
        F.explode(entries).alias("_e"),
    ).select("*", "_e.*").drop("_e")


def maximum_drawdown(values: Column) -> Column:
    """Largest relative fall below the running peak of an array."""
    start = F.struct(F.lit(0.0).alias("peak"), F.lit(0.0).alias("worst"))

    def step(state: Column, value: Column) -> Column:
        peak = F.greatest(state["peak"], value)
        fall = F.when(peak > 0, (peak - value) / peak).otherwise(F.lit(0.0))
        return F.named_struct(F.lit("peak"), peak, F.lit("worst"), F.greatest(state["worst"], fall))

    return F.aggregate(values, start, step, lambda state: F.greatest(F.lit(0.0), F.least(F.lit(1.0), state["worst"])))


def horizon_metrics(grid: DataFrame) -> DataFrame:
    """One row per theme month, horizon and metric once the history is as long as the horizon."""
    series = Window.partitionBy(*SERIES, "metric_name").orderBy("month_index")
    rows = metric_series(grid)
    before = F.lag("value").over(series)
    same = is_close(F.col("value"), before)
    rows = rows.withColumn(
        "_step",
        F.when(before.isNotNull() & F.col("value").isNotNull(), F.when(same, 0).when(F.col("value") > before, 1).otherwise(-1)),
    )
    value, index = F.col("value"), F.col("month_index")
    blocks = []
    for h in HORIZONS:
        frame = series.rowsBetween(-(h - 1), 0)
        steps = series.rowsBetween(-(h - 2), 0)
        covered = F.count(value).over(frame)
        complete = covered == h
        mean, low, high = [f(value).over(frame) for f in (F.avg, F.min, F.max)]
        deviation = F.when(low == high, F.lit(0.0)).otherwise(F.stddev_pop(value).over(frame))
        first = F.first(value).over(frame)
        slope = F.when(low == high, F.lit(0.0)).otherwise(F.regr_slope(value, index).over(frame))
        fit = F.when(low != high, F.round(F.regr_r2(value, index).over(frame), TIE_DIGITS))
        change = value - first
        peak_index = F.max_by(index, F.struct(value, index)).over(frame)
        up, down, flat = [count_where(F.col("_step") == s).over(steps) for s in (1, -1, 0)]

        def when_complete(column: Column, complete: Column = complete) -> Column:
            return F.when(complete, column)

        blocks.append(
            F.struct(
                F.lit(h).alias("horizon_month_count"),
                F.add_months("period_start", -(h - 1)).alias("window_start"),
                F.lit(h).alias("expected_month_count"),
                covered.alias("metric_coverage_count"),
                F.col(f"active_months_{h}m").alias("active_month_count"),
                complete.alias("is_complete"),
                first.alias("first_value"),
                value.alias("latest_value"),
                mean.alias("mean_value"),
                F.percentile(value, F.lit(0.5)).over(frame).alias("median_value"),
                low.alias("minimum_value"),
                high.alias("maximum_value"),
                when_complete(change).alias("absolute_change"),
                when_complete(F.when(first > 0, change / first)).alias("relative_change"),
                when_complete(slope).alias("linear_slope"),
                when_complete(F.when(mean > 0, slope / mean)).alias("normalized_slope"),
                when_complete(fit).alias("r_squared"),
                when_complete(F.when(mean > 0, value / mean)).alias("latest_to_mean_ratio"),
                F.lit(h - 1).alias("transition_count"),
                (up + down + flat).alias("transition_coverage_count"),
                up.alias("positive_change_count"),
                down.alias("negative_change_count"),
                flat.alias("unchanged_change_count"),
                share(up, up + down + flat).alias("positive_change_ratio"),
                deviation.alias("standard_deviation"),
                when_complete(F.when(mean > 0, deviation / mean)).alias("coefficient_of_variation"),
                when_complete(maximum_drawdown(F.collect_list(value).over(frame))).alias("maximum_drawdown"),
                when_complete((index - peak_index).cast("int")).alias("months_since_peak"),
            )
        )
    return (
        rows.withColumn("_h", F.array(*blocks))
        .where(F.col("is_present") & (F.col("month_index") >= min(HORIZONS)))
        .select(*THEME, "month_index", "metric_name", F.explode_outer("_h").alias("_h"))
        .where(F.col("_h.horizon_month_count") <= F.col("month_index"))
        .select(*THEME, "metric_name", "_h.*")
    )


def direction_vote(up: Column, down: Column, flat: Column, available: Column) -> Column:
    return first_match(
        (available < 2, "insufficient_history"),
        (up >= 2, "up"),
        (down >= 2, "down"),
        (flat >= 2, "flat"),
        otherwise="mixed",
    )


def stability_band(values: Column, middle: Column) -> Column:
    return first_match(
        (values < 2, "insufficient_history"),
        (middle <= STABLE_CV, "stable"),
        (middle <= VARIABLE_CV, "variable"),
        otherwise="volatile",
    )


def horizon_evidence(horizons: DataFrame) -> DataFrame:
    """Per theme month and horizon: direction vote, slope and fit medians, stability over the share metrics."""
    rows = horizons.where(F.col("metric_name").isin(*SHARE_METRICS))
    slope, fit = F.col("normalized_slope"), F.col("r_squared")
    is_flat = F.abs(slope) < FLAT_SLOPE
    votes = ~is_flat & (fit >= MIN_R_SQUARED)
    # Three rows per group at most, so the exact medians are bounded.
    return (
        rows.groupBy(*THEME, "horizon_month_count")
        .agg(
            F.max("active_month_count").alias("active_months"),
            count_where(votes & (slope > 0)).alias("_up"),
            count_where(votes & (slope <= 0)).alias("_down"),
            count_where(is_flat).alias("_flat"),
            F.count(slope).alias("direction_evidence_count"),
            F.median(slope).alias("median_normalized_slope"),
            F.median(fit).alias("median_r_squared"),
            F.count("coefficient_of_variation").alias("_cvs"),
            F.median("coefficient_of_variation").alias("stability_cv_median"),
        )
        .select(
            *THEME,
            "horizon_month_count",
            "active_months",
            direction_vote(F.col("_up"), F.col("_down"), F.col("_flat"), F.col("direction_evidence_count")).alias(
                "direction"
            ),
            "direction_evidence_count",
            "median_normalized_slope",
            "median_r_squared",
            "stability_cv_median",
            stability_band(F.col("_cvs"), F.col("stability_cv_median")).alias("stability_band"),
        )
    )


def seasonality_profiles(grid: DataFrame) -> DataFrame:
    """Average month index of whole trailing years, per theme month and metric.

    A year is a block of twelve months counted back from the target; blocks with a missing month or a
    mean of zero are dropped, and at least two must remain. Block sums and the trailing months (at most
    36) come from one window pass, and only surviving profiles expand to twelve rows.
    """
    series = Window.partitionBy(*SERIES, "metric_name").orderBy("month_index")
    blocks = range(SEASON_MAX_MONTHS // 12)
    window_columns = {"_months": F.collect_list(F.struct("value")).over(series.rowsBetween(-(SEASON_MAX_MONTHS - 1), 0))}
    for b in blocks:
        frame = series.rowsBetween(-(12 * b + 11), -12 * b)
        window_columns[f"_sum_{b}"] = F.when(F.count("value").over(frame) == 12, F.sum("value").over(frame))
    years = F.least(F.floor(F.col("month_index") / 12), F.lit(len(blocks))).cast("int")
    rows = (
        metric_series(grid)
        .withColumns(window_columns)
        .where(F.col("is_present") & (F.col("month_index") >= SEASON_MIN_MONTHS))
        .withColumns(
            {
                "complete_year_count": years,
                "history_month_count": years * 12,
                "history_start": F.add_months("period_start", -(years * 12 - 1)),
                **{f"_mean_{b}": F.when(F.col(f"_sum_{b}") > 0, F.col(f"_sum_{b}") / 12) for b in blocks},
            }
        )
        .withColumn(
            "observation_count", sum((F.col(f"_mean_{b}").isNotNull().cast("int") for b in blocks), F.lit(0))
        )
        .where(F.col("observation_count") >= 2)
    )

    def index_at(position: int) -> Column:
        """Mean over the usable blocks of month value / block mean, ``position`` months into the year."""
        added = F.lit(0.0)
        for b in blocks:
            value = F.get("_months", F.size("_months") - 12 * b - 12 + position)["value"]
            added = added + F.coalesce(value / F.col(f"_mean_{b}"), F.lit(0.0))
        return added / F.col("observation_count")

    profile = F.array(
        *[
            F.struct(
                F.month(F.add_months("history_start", position)).alias("calendar_month"),
                index_at(position).alias("seasonal_index"),
                F.round(index_at(position), TIE_DIGITS).alias("_key"),
            )
            for position in range(12)
        ]
    )

    def extreme(sign: int) -> Column:
        """Calendar month of the largest (sign -1) or smallest index, the earlier month on ties."""
        ordered = F.transform(
            "_profile",
            lambda e: F.named_struct(F.lit("v"), sign * e["_key"], F.lit("m"), e["calendar_month"]),
        )
        return F.array_min(ordered)["m"]

    # The outer explode keeps Spark from evaluating the whole array a second time in an inferred filter.
    return (
        rows.withColumn("_profile", profile)
        .withColumns({"_peak": extreme(-1), "_trough": extreme(1)})
        .select(
            *THEME,
            "metric_name",
            "history_start",
            "history_month_count",
            "complete_year_count",
            "observation_count",
            "_peak",
            "_trough",
            F.explode_outer("_profile").alias("_e"),
        )
        .select(
            *THEME,
            "metric_name",
            "_e.calendar_month",
            "history_start",
            "history_month_count",
            "complete_year_count",
            "observation_count",
            "_e.seasonal_index",
            (F.col("_e.seasonal_index") - 1).alias("index_deviation"),
            (F.col("_e.calendar_month") == F.col("_peak")).alias("is_peak_month"),
            (F.col("_e.calendar_month") == F.col("_trough")).alias("is_trough_month"),
        )
    )


def seasonality_summary(profiles: DataFrame) -> DataFrame:
    """Peak month, trough month and amplitude of both measures."""
    columns = []
    for prefix in ("downloads", "revenue_usd"):
        own = F.col("metric_name") == f"{prefix}_sum"
        index = F.when(own, F.col("seasonal_index"))
        columns += [
            F.max(F.when(own & F.col("is_peak_month"), F.col("calendar_month"))).alias(f"{prefix}_peak_calendar_month"),
            F.max(F.when(own & F.col("is_trough_month"), F.col("calendar_month"))).alias(
                f"{prefix}_trough_calendar_month"
            ),
            (F.max(index) - F.min(index)).alias(f"{prefix}_seasonality_amplitude"),
        ]
    rows = profiles.where(F.col("metric_name").isin("downloads_sum", "revenue_usd_sum"))
    return rows.groupBy(*THEME).agg(*columns)


def lifecycle_stage() -> Column:
    up6 = F.col("direction_6m") == "up"
    d12 = F.col("direction_12m")
    return first_match(
        (d12 == "insufficient_history", "insufficient_history"),
        (~F.col("first_active_left_censored") & (F.col("months_since_first_active") < 12) & up6, "emerging"),
        (
            up6
            & (d12 == "up")
            & (F.col("median_normalized_slope_6m") >= F.col("median_normalized_slope_12m") + ACCELERATION_MARGIN),
            "accelerating",
        ),
        (up6 & d12.isin("down", "flat", "mixed"), "recovering"),
        ((d12 == "down") & ~up6, "declining"),
        (
            (d12 == "flat")
            & (F.col("active_months_12m") == 12)
            & F.col("stability_band_12m").isin("stable", "variable"),
            "mature",
        ),
        (d12 == "up", "growing"),
        otherwise="mixed",
    )


EVIDENCE = {
    "active_months": None,
    "direction": "insufficient_history",
    "direction_evidence_count": 0,
    "median_normalized_slope": None,
    "median_r_squared": None,
    "stability_cv_median": None,
    "stability_band": "insufficient_history",
}


def model_summaries(grid: DataFrame, horizons: DataFrame, profiles: DataFrame) -> DataFrame:
    """One wide row per theme month: history flags, evidence per horizon, lifecycle, seasonality."""
    evidence = horizon_evidence(horizons)
    pivoted = evidence.groupBy(*THEME).agg(
        *[
            F.max(F.when(F.col("horizon_month_count") == h, F.col(name))).alias(f"_{name}_{h}m")
            for name in EVIDENCE
            for h in HORIZONS
        ]
    )
    present = grid.where("is_present").select(
        *THEME,
        "month_index",
        "history_start",
        "first_active_month",
        "active_months_to_date",
    )
    joined = present.join(pivoted, THEME, "left").join(seasonality_summary(profiles), THEME, "left")
    filled = [
        (F.col(f"_{name}_{h}m") if default is None else F.coalesce(F.col(f"_{name}_{h}m"), F.lit(default))).alias(
            f"{name}_{h}m"
        )
        for name, default in EVIDENCE.items()
        for h in HORIZONS
    ]
    years = F.least(F.floor(F.col("month_index") / 12), F.lit(SEASON_MAX_MONTHS // 12)).cast("int")
    enough = F.col("month_index") >= SEASON_MIN_MONTHS
    wide = joined.select(
        *THEME,
        F.lit(MODEL_POLICY).alias("model_policy_version"),
        "history_start",
        F.col("month_index").alias("history_month_count"),
        "first_active_month",
        F.coalesce(F.col("first_active_month") == F.col("history_start"), F.lit(False)).alias(
            "first_active_left_censored"
        ),
        months_between(F.col("first_active_month"), F.col("period_start")).alias("months_since_first_active"),
        "active_months_to_date",
        *[(F.col("month_index") >= h).alias(f"has_{h}m_history") for h in HORIZONS],
        *filled,
        F.when(enough, years * 12).alias("seasonality_history_month_count"),
        F.when(enough, years).alias("seasonality_complete_year_count"),
        "downloads_peak_calendar_month",
        "downloads_trough_calendar_month",
        "downloads_seasonality_amplitude",
        "revenue_usd_peak_calendar_month",
        "revenue_usd_trough_calendar_month",
        "revenue_usd_seasonality_amplitude",
    )
    return wide.withColumn("lifecycle_stage", lifecycle_stage())
