import datetime
from types import SimpleNamespace

import pytest
from builders import frames, metadata, month, rows_by, snapshot
from pyspark.sql import functions as F

from themelens.operators import calendar, model, monthly, opportunity, trend
from themelens.plans.queries import QUERIES


def months_from(year, number, count):
    return [((year * 12 + number - 1 + i) // 12, (year * 12 + number - 1 + i) % 12 + 1) for i in range(count)]


@pytest.fixture(scope="module")
def history(spark):
    """Thirty months: a steady theme, a growing one, and one that is absent in the first month."""
    snapshots = []
    for i, period in enumerate(months_from(2021, 1, 30)):
        rank = 0
        for theme, count, units in (("steady", 6, 10.0), ("growing", 5, 5.0 + i), ("late", 5 if i else 0, 3.0)):
            for j in range(count):
                rank += 1
                snapshots.append(snapshot(period, f"{theme}-{j}", rank, theme, units, units * 2))
    rows, names = frames(spark, snapshots, [metadata(f"steady-{j}", "P") for j in range(6)])
    facts = monthly.with_neighbour_months(monthly.attach_metadata(rows, names))
    totals = monthly.monthly_market_totals(facts).cache()
    themes = monthly.theme_monthly_metrics(facts, totals).cache()
    return totals, themes, opportunity.market_structure(facts, totals).cache()


def test_scores_start_in_the_sixth_month_and_fill_absent_months(history):
    totals, themes, _ = history
    got = rows_by(trend.trend_scores(totals, themes), "period_start", "game_theme")
    assert min(k[0] for k in got) == datetime.date(2021, 6, 1)
    late = got[datetime.date(2021, 6, 1), "late"]
    assert late["active_months_6m"] == 5
    share = 5 / 16
    assert late["product_share_gain_3m"] == pytest.approx(share - (0 + share + share) / 3)
    # The second month of the theme is its first with products: all entries there are new.
    assert late["recent3_new_entry_share"] == 0.0
    assert late["product_share_acceleration"] == pytest.approx(0 - share / 2)
    # The first month has no predecessor, so the prior window's new-entry share cannot matter.
    assert {r["trend_rank"] for k, r in got.items() if k[0] == datetime.date(2021, 6, 1)} == {1, 2, 3}


def test_score_is_confidence_weighted(history):
    totals, themes, _ = history
    for row in trend.trend_scores(totals, themes).where("is_actionable").collect():
        assert row.trend_score == pytest.approx(row.base_trend_score * row.confidence_score / 100)
        raw = 0.45 * row.growth_score + 0.3 * row.acceleration_score + 0.25 * row.new_product_score - 0.2 * row.concentration_penalty
        assert row.base_trend_score == pytest.approx(max(0.0, min(100.0, raw)))


@pytest.mark.parametrize(
    "theme, products, active, share, new, expected",
    [
        ("Unknown", 1, 1, None, None, "non_actionable_source_label"),
        ("T", 4, 1, None, None, "insufficient_latest_product_count"),
        ("T", 5, 2, None, None, "insufficient_active_history"),
        ("T", 5, 3, 0.1, None, "insufficient_metric_coverage"),
        ("T", 5, 3, 0.1, 0.0, None),
    ],
)
def test_exclusion_reasons_in_order(spark, theme, products, active, share, new, expected):
    df = spark.createDataFrame(
        [(theme, products, active, share, new)],
        "game_theme string, latest_product_count int, active_months_6m int, latest_product_share double, recent3_new_entry_share double",
    )
    assert df.select(trend.exclusion_reason().alias("r")).first().r == expected


def test_the_latest_ranking_is_of_the_last_month_of_all(spark):
    scores = spark.createDataFrame(
        [("s", "monthly", *month(year, 3), f"{year}-{rank}", rank, 50.0, 90.0) for year in (1996, 2021) for rank in range(1, 13)],
        "scope_name string, cadence string, period_start date, period_end date, game_theme string, trend_rank int,"
        " trend_score double, confidence_score double",
    )
    found = QUERIES["latest_ranking"].build(SimpleNamespace(scores=scores), spark, "").collect()
    assert {r.game_theme for r in found} == {f"2021-{rank}" for rank in range(1, 11)}
    assert "DATE '" not in QUERIES["latest_ranking"].reference.rsplit("FROM scores", 2)[1]


def test_gap_in_history_is_refused(history):
    totals, *_ = history
    holed = totals.where(F.col("period_start") != datetime.date(2021, 5, 1))
    assert [str(r.period_start) for r in calendar.month_gaps(holed).collect()] == ["2021-06-01"]
    with pytest.raises(ValueError):
        calendar.require_contiguous(holed)


def test_horizons_of_constant_and_rising_series(history):
    totals, _, structure = history
    grid = model.model_grid(totals, structure)
    got = rows_by(model.horizon_metrics(grid).where("metric_name = 'downloads_sum'"), "period_start", "game_theme", "horizon_month_count")
    flat = got[datetime.date(2021, 12, 1), "steady", 12]
    assert (flat["linear_slope"], flat["r_squared"], flat["coefficient_of_variation"], flat["unchanged_change_count"]) == (0.0, None, 0.0, 11)
    assert (flat["maximum_drawdown"], flat["months_since_peak"]) == (0.0, 0)
    rising = got[datetime.date(2021, 12, 1), "growing", 12]
    assert rising["linear_slope"] == pytest.approx(5.0) and rising["r_squared"] == pytest.approx(1.0)
    assert rising["relative_change"] == pytest.approx(55 / 25) and rising["median_value"] == pytest.approx(52.5)
    late = got[datetime.date(2021, 6, 1), "late", 6]
    assert late["first_value"] == 0.0 and late["relative_change"] is None and late["active_month_count"] == 5
    assert (datetime.date(2021, 11, 1), "steady", 12) not in got


def test_first_activity_and_left_censoring(history):
    totals, _, structure = history
    grid = model.model_grid(totals, structure)
    horizons, profiles = model.horizon_metrics(grid), model.seasonality_profiles(grid)
    got = rows_by(model.model_summaries(grid, horizons, profiles), "period_start", "game_theme")
    late, steady = got[datetime.date(2021, 6, 1), "late"], got[datetime.date(2021, 6, 1), "steady"]
    assert (late["first_active_left_censored"], late["months_since_first_active"], late["active_months_to_date"]) == (False, 4, 5)
    assert steady["first_active_left_censored"] is True
    assert steady["direction_12m"] == "insufficient_history" and steady["lifecycle_stage"] == "insufficient_history"
    last = got[datetime.date(2023, 6, 1), "steady"]
    assert last["seasonality_history_month_count"] == 24 and last["downloads_seasonality_amplitude"] == pytest.approx(0.0)
    # Every calendar month has index one, so the earliest month is peak and trough.
    assert (last["downloads_peak_calendar_month"], last["downloads_trough_calendar_month"]) == (1, 1)


def test_later_months_never_change_earlier_rows(history):
    totals, themes, structure = history
    cut = F.col("period_start") <= datetime.date(2023, 2, 1)

    def run(a, b, c):
        grid = model.model_grid(a, c)
        horizons, profiles = model.horizon_metrics(grid), model.seasonality_profiles(grid)
        return [horizons, profiles, model.model_summaries(grid, horizons, profiles), trend.trend_scores(a, b)]

    full = run(totals, themes, structure)
    past = run(totals.where(cut), themes.where(cut), structure.where(cut))
    for whole, part in zip(full, past):
        assert whole.where(cut).exceptAll(part).isEmpty() and part.exceptAll(whole.where(cut)).isEmpty()


@pytest.mark.parametrize(
    "values, expected",
    [([0.0, 0.0], 0.0), ([10.0, 5.0, 8.0, 2.0], 0.8), ([1.0, 2.0, 3.0], 0.0), ([0.0, 4.0, 0.0], 1.0)],
)
def test_maximum_drawdown(spark, values, expected):
    df = spark.createDataFrame([(values,)], "v array<double>").select(model.maximum_drawdown(F.col("v")).alias("d"))
    assert df.first().d == pytest.approx(expected)


@pytest.mark.parametrize(
    "d6, d12, s6, s12, censored, since, active, band, expected",
    [
        ("up", "insufficient_history", 1.0, 0.0, False, 3, 6, "stable", "insufficient_history"),
        ("up", "up", 0.1, 0.0, False, 11, 12, "stable", "emerging"),
        ("up", "up", 0.1, 0.0, True, 11, 12, "stable", "accelerating"),
        ("up", "up", 0.1, 0.0, False, 12, 12, "stable", "accelerating"),
        ("up", "up", 0.004, 0.0, True, 50, 12, "stable", "growing"),
        ("up", "flat", 0.1, 0.0, True, 50, 12, "stable", "recovering"),
        ("flat", "down", 0.0, -0.1, True, 50, 12, "stable", "declining"),
        ("flat", "flat", 0.0, 0.0, True, 50, 12, "variable", "mature"),
        ("flat", "flat", 0.0, 0.0, True, 50, 12, "volatile", "mixed"),
        ("flat", "flat", 0.0, 0.0, True, 50, 11, "stable", "mixed"),
        ("mixed", "up", 0.0, 0.1, True, 50, 12, "stable", "growing"),
        ("mixed", "mixed", None, None, True, None, 12, "stable", "mixed"),
    ],
)
def test_lifecycle_rules(spark, d6, d12, s6, s12, censored, since, active, band, expected):
    df = spark.createDataFrame(
        [(d6, d12, s6, s12, censored, since, active, band)],
        "direction_6m string, direction_12m string, median_normalized_slope_6m double, median_normalized_slope_12m double,"
        " first_active_left_censored boolean, months_since_first_active int, active_months_12m int, stability_band_12m string",
    )
    assert df.select(model.lifecycle_stage().alias("s")).first().s == expected


def test_season_needs_two_usable_years(spark):
    start = [month(*p) for p in months_from(2020, 1, 36)]
    rows = []
    for i, (a, b) in enumerate(start):
        value = None if i == 14 else float(1 + a.month)
        rows.append(("s", "monthly", a, b, i + 1, "T", True, *[value] * 6, *[0] * 5))
    columns = ", ".join(f"{c} double" for c in model.MODEL_METRICS)
    grid = spark.createDataFrame(
        rows,
        "scope_name string, cadence string, period_start date, period_end date, month_index int, game_theme string, is_present boolean, "
        + columns + ", active_months_6m int, active_months_12m int, active_months_36m int, active_months_to_date int, x int",
    )
    got = rows_by(model.seasonality_profiles(grid).where("metric_name = 'downloads_sum'"), "period_start", "calendar_month")
    # Two whole years are not enough while the second holds a gap; with three, two usable ones remain.
    assert min(k[0] for k in got) > datetime.date(2021, 12, 1)
    last = got[datetime.date(2022, 12, 1), 12]
    assert (last["observation_count"], last["complete_year_count"], last["is_peak_month"]) == (2, 3, True)
    assert last["seasonal_index"] == pytest.approx(13 / 7.5)
    assert got[datetime.date(2022, 12, 1), 1]["is_trough_month"]
