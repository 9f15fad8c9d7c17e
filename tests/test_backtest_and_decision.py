import datetime

import pytest
from builders import frames, metadata, rows_by, snapshot
from pyspark.sql import functions as F

from themelens.constants import FEATURES, OUTCOMES
from themelens.functions.numeric import is_close, wilson_bounds
from themelens.operators import decision
from themelens.plans.stages import Stages
from themelens.session import scratch_dir


@pytest.fixture(scope="module")
def run(spark):
    snapshots = []
    for i in range(16):
        period = ((2021 * 12 + i) // 12, i % 12 + 1)
        rank = 0
        for t in range(7):
            if t == 6 and i == 14:
                continue  # theme-6 is absent in one month
            for j in range(5):
                rank += 1
                units = float((t + 1) * 10 + (i * (t - 3)) + j)
                snapshots.append(
                    snapshot(period, f"{t}-{j}", rank, f"theme-{t}", max(units, 1.0), None if t == 5 and i == 15 else max(units + 2, 0.0), subgenre=f"g{j % 2}")
                )
    rows, names = frames(spark, snapshots, [metadata(f"{t}-{j}", f"P{j}") for t in range(7) for j in range(5)])
    return Stages(spark, rows, names, root=scratch_dir(spark))


def test_registry_is_whole_and_outcomes_use_exact_months(run):
    features = run.table("feature_metrics")
    assert features.count() == 3 * len(FEATURES) * len(OUTCOMES) == 228
    outcomes = rows_by(run.outcomes, "decision_period_start", "outcome_horizon_months", "game_theme")
    gone = outcomes[datetime.date(2022, 2, 1), 1, "theme-6"]
    assert gone["future_theme_present"] is False and gone["future_downloads_share"] == 0.0 and gone["future_product_count"] == 0
    assert gone["downloads_share_change_direction"] == "down"
    unknown = outcomes[datetime.date(2022, 3, 1), 1, "theme-5"]
    assert unknown["future_theme_present"] is True and unknown["future_revenue_usd_share"] is None
    assert unknown["revenue_usd_share_change_direction"] == "unavailable" and unknown["future_revenue_usd_share_percentile"] is None
    # The last stored month has no future month.
    assert max(k[0] for k in outcomes) == datetime.date(2022, 3, 1)


def test_top_fifth_flags_and_empty_pairs(run):
    cohort = [r for r in run.outcomes.where("decision_period_start = '2021-08-01' and outcome_horizon_months = 1").collect()]
    assert len(cohort) == 7 and sum(r.future_downloads_share_top_quintile for r in cohort) == 2
    empty = run.table("feature_metrics").where("feature_name = 'median_normalized_slope_36m'").collect()
    assert len(empty) == 12
    for row in empty:
        assert (row.eligible_row_count, row.coverage_ratio, row.mean_spearman, row.top_quintile_cohort_count) == (0, 0.0, None, None)
        assert row.low_sample_warning


def test_segments_cover_every_row_once(run):
    segments = run.table("segment_metrics")
    total = run.outcomes.where("outcome_horizon_months = 2").count()
    added = segments.where("outcome_horizon_months = 2 and outcome_name = 'future_downloads_share'").groupBy("segment_name").agg(F.sum("candidate_row_count").alias("n"))
    assert {r.n for r in added.collect()} == {total}


@pytest.mark.parametrize("hits, trials, low, high", [(5, 10, 0.2366, 0.7634), (0, 4, 0.0, 0.4899), (4, 4, 0.5101, 1.0), (0, 0, None, None)])
def test_wilson(spark, hits, trials, low, high):
    df = spark.createDataFrame([(hits, trials)], "h int, n int")
    row = df.select(*[c.alias(n) for c, n in zip(wilson_bounds(F.col("h"), F.col("n")), ("low", "high"))]).first()
    if low is None:
        assert row.low is None and row.high is None
    else:
        assert (row.low, row.high) == (pytest.approx(low, abs=1e-4), pytest.approx(high, abs=1e-4))


def test_closeness_is_relative_and_absolute(spark):
    df = spark.createDataFrame([(1e9, 1e9 + 0.5), (0.0, 1e-13), (1.0, 1.00001)], "a double, b double")
    assert [r.c for r in df.select(is_close(F.col("a"), F.col("b")).alias("c")).collect()] == [True, True, False]


RULE_INPUT = (
    "lifecycle_stage string, market_size_band string, growth_quality_state string, competitive_structure_risk_band string,"
    " confidence string, _volatile boolean, _meaningless boolean"
)


@pytest.mark.parametrize(
    "stage, size, risk, confidence, volatile, meaningless, advice, window",
    [
        ("declining", "limited", "mixed_structural_risk", "medium", False, False, "deprioritize", "caution_or_monitor"),
        ("declining", "strong", "higher_structural_risk", "medium", True, False, "deprioritize", "caution_or_monitor"),
        ("growing", "insufficient_evidence", "mixed_structural_risk", "medium", False, False, "monitor", "caution_or_monitor"),
        ("growing", "strong", "mixed_structural_risk", "medium", True, False, "monitor", "caution_or_monitor"),
        ("growing", "strong", "mixed_structural_risk", "high", False, True, "monitor", "caution_or_monitor"),
        ("emerging", "limited", "mixed_structural_risk", "low", False, False, "small_experiment", "experimental_window"),
        ("emerging", "limited", "higher_structural_risk", "low", False, False, "small_experiment", "caution_or_monitor"),
        ("accelerating", "strong", "lower_structural_risk", "medium", False, False, "prioritize_validation", "supported_validation_window"),
        ("growing", "strong", "lower_structural_risk", "low", False, False, "monitor", "supported_validation_window"),
        ("mature", "strong", "lower_structural_risk", "low", False, False, "selective_validation", "selective_validation_window"),
        ("growing", "moderate", "lower_structural_risk", "low", False, False, "selective_validation", "selective_validation_window"),
        ("mature", "limited", "lower_structural_risk", "low", False, False, "monitor", "selective_validation_window"),
        ("growing", "limited", "lower_structural_risk", "low", False, False, "monitor", "caution_or_monitor"),
        ("mixed", "strong", "lower_structural_risk", "high", False, False, "monitor", "caution_or_monitor"),
    ],
)
def test_recommendation_and_window_gates(spark, stage, size, risk, confidence, volatile, meaningless, advice, window):
    from themelens.constants import GROWTH_QUALITY

    df = spark.createDataFrame([(stage, size, GROWTH_QUALITY[stage], risk, confidence, volatile, meaningless)], RULE_INPUT)
    row = df.select(decision.recommendation().alias("a"), decision.launch_state().alias("w")).first()
    assert (row.a, row.w) == (advice, window)


@pytest.mark.parametrize(
    "values, expected",
    [
        ((0.9, None, None), "insufficient_evidence"),
        ((0.8, 0.8, None), "strong"),
        ((0.8, 0.5, 0.1), "moderate"),
        ((0.79, 0.49, 0.49), "limited"),
    ],
)
def test_market_size_band(spark, values, expected):
    df = spark.createDataFrame([values], ", ".join(f"{c} double" for c in decision.MARKET.values()))
    assert df.select(decision.market_size_band().alias("b")).first().b == expected


@pytest.mark.parametrize(
    "values, expected",
    [
        ((0.8, 0.8, None, None), "higher_structural_risk"),
        ((0.5, 0.5, 0.7, None), "lower_structural_risk"),
        ((0.5, 0.5, 0.8, None), "mixed_structural_risk"),
        ((0.5, 0.5, None, None), "mixed_structural_risk"),
        ((0.1, None, None, None), "insufficient_evidence"),
    ],
)
def test_competitive_band(spark, values, expected):
    df = spark.createDataFrame([values], ", ".join(f"{c} double" for c in decision.COMPETITION.values()))
    assert df.select(decision.competitive_risk_band().alias("b")).first().b == expected


def test_category_fit_and_migration(run):
    fits = rows_by(run.fits, "period_start", "game_theme", "game_subgenre")
    first = fits[datetime.date(2021, 2, 1), "theme-0", "g0"]
    assert first["fit_state"] == "observed_fit" and "insufficient_observation_history" in first["evidence_limitations"]
    later = fits[datetime.date(2021, 6, 1), "theme-0", "g0"]
    assert (later["fit_state"], later["observation_month_count"], later["target_month_product_count"]) == ("validated_fit", 6, 3)
    assert later["supporting_representative_product_count"] >= 1 and later["evidence_limitations"] == []
    assert fits[datetime.date(2022, 4, 1), "theme-0", "g0"]["observation_month_count"] == 12
    for row in decision.migration_hypotheses(run.fits).collect():
        assert row.validated_source_game_subgenre != row.target_observed_game_subgenre


def test_three_windows_and_backed_risks(run):
    assessed = run.assessed
    windows = decision.launch_window_assessments(assessed)
    assert windows.count() == 3 * assessed.count()
    risks = rows_by(decision.risk_rows(assessed), "period_start", "game_theme", "risk_code")
    gap = risks[datetime.date(2022, 4, 1), "theme-5", "observable_revenue_coverage_gap"]
    assert (gap["severity"], gap["evidence_availability"]) == ("medium", "partial")
    assert (datetime.date(2021, 3, 1), "theme-0", "insufficient_model_history") in risks
