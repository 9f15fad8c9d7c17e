import datetime

import pytest
from builders import frames, metadata, rows_by, snapshot

from themelens.operators import calendar, monthly, opportunity, proxy, quality

JAN, FEB = (2024, 1), (2024, 2)


def facts_of(spark, snapshots, metadatas):
    rows, names = frames(spark, snapshots, metadatas)
    return monthly.with_neighbour_months(monthly.attach_metadata(rows, names))


@pytest.fixture(scope="module")
def worked(spark):
    """Ranks on both sides of 100 and 500, an empty and a NULL label, a NULL measure, a product without metadata."""
    snapshots = [
        snapshot(FEB, "p-one", 2, "Farm", 8.0, 50.0),
        snapshot(FEB, "p-two", 100, "Farm", 24.0, None),
        snapshot(FEB, "p-three", 101, "Farm", None, 70.0),
        snapshot(FEB, "p-four", 500, "", 8.0, 80.0),
        snapshot(FEB, "p-five", 501, None, 40.0, 0.0),
        snapshot(JAN, "p-one", 5, "Farm", None, None),
        snapshot(JAN, "p-old", 6, "Farm", None, None),
    ]
    names = [metadata("p-one", "Pub A"), metadata("p-two", "Pub A"), metadata("p-three", "Pub B"), metadata("p-four", None)]
    return facts_of(spark, snapshots, names)


def test_totals_keep_null_apart_from_zero(worked):
    totals = rows_by(monthly.monthly_market_totals(worked), "period_start")
    feb = totals[datetime.date(2024, 2, 1)]
    assert [feb[f"{n}_count"] for n in ("snapshot", "theme_present", "theme_missing", "metadata_coverage")] == [5, 4, 1, 4]
    assert (feb["units_absolute_coverage_count"], feb["units_absolute_sum"]) == (4, 80.0)
    assert (feb["revenue_absolute_coverage_count"], feb["revenue_absolute_sum"]) == (4, 200.0)
    jan = totals[datetime.date(2024, 1, 1)]
    assert (jan["units_absolute_coverage_count"], jan["units_absolute_sum"]) == (0, None)


def test_theme_metrics_of_raw_labels(worked):
    themes = monthly.theme_monthly_metrics(worked, monthly.monthly_market_totals(worked))
    got = rows_by(themes, "period_start", "game_theme")
    assert {theme for start, theme in got if start.month == 2} == {"Farm", ""}
    farm, blank = got[datetime.date(2024, 2, 1), "Farm"], got[datetime.date(2024, 2, 1), ""]
    assert (farm["product_count"], farm["top_100_count"], farm["top_500_count"]) == (3, 2, 3)
    assert (farm["average_rank"], farm["median_rank"]) == (pytest.approx(203 / 3), 100.0)
    assert [farm[f"{n}_share"] for n in ("product", "units_absolute", "revenue_absolute")] == pytest.approx([0.6, 0.4, 0.6])
    assert (farm["new_entry_count"], farm["returning_product_count"], farm["new_entry_share"]) == (2, 1, pytest.approx(2 / 3))
    assert (farm["publisher_count"], farm["top_publisher_product_share"]) == (2, pytest.approx(2 / 3))
    assert (blank["top_500_count"], blank["units_absolute_share"], blank["publisher_count"]) == (1, pytest.approx(0.1), 0)
    january = got[datetime.date(2024, 1, 1), "Farm"]
    assert january["has_previous_month"] is False and january["new_entry_count"] is None
    assert january["units_absolute_share"] is None


def test_products_without_id_are_no_neighbours(spark):
    rows = [snapshot(m, None, k, "T", 1.0, 1.0) for m in (JAN, FEB) for k in (1, 2)] + [snapshot(FEB, "a", 3, "T", 1.0, 1.0)]
    got = facts_of(spark, rows, [metadata("a", None)]).where("period_start = '2024-02-01'").collect()
    assert len(got) == 3 and all(r.previous is None and r.is_market_new for r in got)


@pytest.fixture(scope="module")
def moving(spark):
    """Theme T in two months: one stays, one leaves the market, one comes from theme U, one is market-new."""
    old, new = datetime.date(2023, 1, 31), datetime.date(2030, 1, 1)
    snapshots = [
        snapshot(JAN, "stay", 1, "T", 10.0, 5.0, subgenre="x"),
        snapshot(JAN, "gone", 2, "T", 4.0, 1.0, subgenre="x"),
        snapshot(JAN, "mover", 3, "U", 8.0, None),
        snapshot(FEB, "stay", 120, "T", 7.0, 9.0, subgenre="x", released=old),
        snapshot(FEB, "mover", 1, "T", 9.0, 2.0, subgenre="y", released=new),
        snapshot(FEB, "fresh", 2, "T", 6.0, 0.0, subgenre="x"),
    ]
    return facts_of(spark, snapshots, [metadata("stay", "P"), metadata("mover", "Q"), metadata("fresh", "P")])


def test_growth_roles_and_decomposition(moving):
    row = rows_by(opportunity.growth_sources(moving), "period_start", "game_theme")[datetime.date(2024, 2, 1), "T"]
    assert (row["previous_product_count"], row["current_product_count"], row["product_count_change"]) == (2, 3, 1)
    assert (row["market_new_entry_count"], row["theme_entry_count"], row["theme_exit_count"], row["continuing_theme_product_count"]) == (1, 2, 1, 1)
    assert row["downloads_decomposition_complete"] is True
    assert (row["downloads_mom_change"], row["downloads_theme_entry_contribution"]) == (8.0, 15.0)
    assert (row["downloads_continuing_contribution"], row["downloads_theme_exit_contribution"]) == (-3.0, -4.0)
    assert row["downloads_market_new_entry_sum"] == 6.0
    assert row["downloads_top_1_positive_contribution_share"] == pytest.approx(9 / 15)
    assert row["downloads_continuing_positive_contribution_share"] == 0.0
    assert row["downloads_mom_growth_rate"] == pytest.approx(8 / 14)
    assert (row["top_100_current_count"], row["top_100_previous_count"], row["top_100_entry_count"], row["top_100_exit_count"], row["top_100_retained_count"]) == (2, 2, 2, 2, 0)
    assert (row["downloads_top_10_retained_count"], row["downloads_top_10_retention_rate"]) == (1, pytest.approx(1 / 3))


def test_theme_gone_now_has_no_growth_row_and_missing_measure_is_incomplete(moving, spark):
    got = rows_by(opportunity.growth_sources(moving), "period_start", "game_theme")
    assert (datetime.date(2024, 2, 1), "U") not in got
    broken = facts_of(spark, [snapshot(JAN, "a", 1, "T", None, 1.0), snapshot(FEB, "a", 1, "T", 3.0, 1.0)], [metadata("a", "P")])
    row = rows_by(opportunity.growth_sources(broken), "period_start")[datetime.date(2024, 2, 1)]
    assert row["downloads_decomposition_complete"] is False and row["downloads_mom_change"] is None
    assert (row["downloads_current_sum"], row["downloads_previous_sum"], row["downloads_previous_coverage_count"]) == (3.0, None, 0)
    assert row["revenue_usd_decomposition_complete"] is True and row["revenue_usd_unchanged_contributor_count"] == 1


def test_growth_leaders_compare_with_the_whole_market(moving):
    leaders = [
        r for r in opportunity.representative_leaders(moving).collect()
        if r.period_start == datetime.date(2024, 2, 1)
    ]
    growth = [(r.unified_app_id, r.downloads_change) for r in sorted(leaders, key=lambda r: r.evidence_rank) if r.evidence_type == "downloads_growth_leader"]
    # The mover had 8 in another theme, so its change is 1, not 9.
    assert growth == [("fresh", 6.0), ("mover", 1.0)]
    revenue = [r.unified_app_id for r in leaders if r.evidence_type == "revenue_growth_leader"]
    assert revenue == ["stay"]  # the mover's previous revenue is unknown, so it is skipped
    new = [r.unified_app_id for r in leaders if r.evidence_type == "market_new_entry_downloads_leader"]
    assert new == ["fresh"]


def test_structure_concentration_and_ages(moving):
    row = rows_by(opportunity.market_structure(moving, monthly.monthly_market_totals(moving)), "period_start", "game_theme")[datetime.date(2024, 2, 1), "T"]
    assert row["downloads_top_1_product_share"] == pytest.approx(9 / 22)
    assert row["downloads_product_hhi"] == pytest.approx((49 + 81 + 36) / 22**2)
    assert row["downloads_median_per_covered_product"] == 7.0
    assert (row["publisher_count"], row["top_1_publisher_product_share"]) == (2, pytest.approx(2 / 3))
    assert row["top_1_publisher_downloads_share"] == pytest.approx(13 / 22)
    assert (row["release_date_ww_valid_age_count"], row["release_date_ww_future_count"]) == (1, 1)
    assert row["median_product_age_days"] == (datetime.date(2024, 2, 29) - datetime.date(2023, 1, 31)).days


def test_dimensions_drop_null_labels(moving):
    totals = monthly.monthly_market_totals(moving)
    got = rows_by(opportunity.dimension_metrics(moving, totals, monthly.theme_monthly_metrics(moving, totals)), "period_start", "game_theme", "dimension_value")
    assert set(got) == {(datetime.date(2024, 1, 1), "T", "x"), (datetime.date(2024, 2, 1), "T", "x"), (datetime.date(2024, 2, 1), "T", "y")}
    row = got[datetime.date(2024, 2, 1), "T", "x"]
    assert (row["product_count"], row["market_new_entry_count"], row["market_new_entry_top_100_rate"]) == (2, 1, 1.0)
    assert row["downloads_share_within_theme"] == pytest.approx(13 / 22)


def test_scopes_do_not_mix(spark):
    snapshots = [snapshot(JAN, "a", 1, "T", 1.0, 1.0, scope="one"), snapshot(FEB, "a", 1, "T", 2.0, 2.0, scope="two")]
    facts = facts_of(spark, snapshots, [])
    rows = rows_by(opportunity.growth_sources(facts), "scope_name")
    assert rows["two"]["has_previous_month"] is False and rows["two"]["theme_entry_count"] is None


def test_row_order_and_partitions_do_not_matter(spark, moving):
    totals = monthly.monthly_market_totals(moving)
    one = opportunity.market_structure(moving.coalesce(1), totals)
    eight = opportunity.market_structure(moving.orderBy("unified_app_id").repartition(8), totals)
    assert one.exceptAll(eight).isEmpty() and eight.exceptAll(one).isEmpty()


@pytest.mark.parametrize(
    "value, expected",
    [(None, ("unavailable", "unknown")), (0.0, ("zero", "iaa_candidate")), (12.5, ("positive", "iap_or_hybrid_candidate"))],
)
def test_revenue_classes(spark, value, expected):
    rows, _ = frames(spark, [snapshot(JAN, "a", 1, None, 1.0, value)], [metadata("a", None)])
    (row,) = proxy.product_revenue_profiles(rows).collect()
    assert (row.observable_revenue_state, row.monetization_proxy) == expected


@pytest.mark.parametrize("value", [-1.0, float("nan"), float("inf")])
def test_invalid_revenue_is_rejected(spark, value):
    rows, _ = frames(spark, [snapshot(JAN, "a", 1, "T", 1.0, value)], [metadata("a", None)])
    assert proxy.invalid_revenue(rows).count() == 1
    assert [r.monetization_proxy for r in proxy.product_revenue_profiles(rows).collect()] == [None]  # no class, but no lost row


def test_proxy_share_needs_a_covered_class(spark):
    rows, _ = frames(
        spark,
        [snapshot(JAN, "a", 1, "T", 3.0, 0.0), snapshot(JAN, "b", 2, "T", 1.0, 5.0), snapshot(JAN, "c", 3, "T", None, None)],
        [metadata("a", None)],
    )
    (row,) = proxy.theme_proxy_metrics(rows).collect()
    assert (row.iaa_candidate_downloads_share, row.unknown_downloads_share, row.unknown_product_count) == (0.75, None, 1)


def test_month_quality_counts_structural_issues(spark):
    snapshots = [snapshot(JAN, "a", 1, "T", -1.0, 1.0), snapshot(JAN, "a", 3, "T", 0.0, None)]
    rows, names = frames(spark, snapshots, [metadata("a", None)])
    (row,) = quality.month_quality(rows, names, ["PUZZLE "], 1000, ["WW", "total", 1, "DM"], "China").collect()
    # duplicate product, ranks not contiguous, negative downloads
    assert row.structural_issue_count == 3 and row.duplicate_unified_app_count == 1 and not row.ranks_are_contiguous
    assert (row.downloads_negative_count, row.downloads_zero_count, row.name_coverage_count, row.publisher_coverage_count) == (1, 1, 2, 0)
    assert {r.rule for r in quality.period_violations(rows).collect()} == {"duplicate_product"}


def test_only_product_counts_are_shuffled_by_publisher(spark):
    snapshots = [snapshot((2024, m), f"p{k}", k, "T", float(k), 2.0 * k, subgenre="s") for m in (1, 2) for k in range(1, 7)]
    rows, names = frames(spark, snapshots, [metadata(f"p{k}", f"P{k % 2}") for k in range(1, 5)])
    facts = monthly.with_neighbour_months(monthly.attach_metadata(rows, names))
    totals = monthly.monthly_market_totals(facts)
    found = opportunity.dimension_metrics(facts, totals, monthly.theme_monthly_metrics(facts, totals))
    plan = found._jdf.queryExecution().optimizedPlan().toString().splitlines()
    grouped = [line for line in plan if "Aggregate [" in line and "dimension_value" in line and "publisher_display_name" in line]
    assert grouped and not any("rank_position" in line for line in grouped)
    for row in found.where("dimension_value = 's'").collect():
        assert (row.product_count, row.publisher_coverage_count, row.publisher_count) == (6, 4, 2)
        assert row.top_1_publisher_product_share == 0.5


def test_facts_are_shuffled_by_product_once(spark):
    snapshots = [snapshot(m, f"p{k}", k, "T", float(k), 2.0) for m in (JAN, FEB) for k in range(1, 7)]
    snapshots += [snapshot(m, None, k, "T", 1.0, 1.0) for m in (JAN, FEB) for k in (7, 8)]
    rows, names = frames(spark, snapshots, [metadata(f"p{k}", f"P{k % 2}") for k in range(1, 5)])
    months = calendar.stored_months(rows)
    got = monthly.product_facts(rows, names, months)
    plan = got._jdf.queryExecution().executedPlan().toString().splitlines()
    by_product = [line for line in plan if "Exchange hashpartitioning(_product" in line]
    assert len(by_product) == 2 and sum("REPARTITION_BY_COL" in line for line in by_product) == 1  # the facts, the metadata
    assert len([line for line in plan if "BroadcastExchange" in line]) == 1  # the months
    one = monthly.with_neighbour_months(monthly.attach_metadata(rows, names)).select(*got.columns)
    assert one.exceptAll(got).isEmpty() and got.exceptAll(one).isEmpty() and got.count() == 16
    alone = got.where("unified_app_id IS NULL").collect()
    assert [(r.previous, r.following, r.has_metadata) for r in alone] == [(None, None, False)] * 4


def test_stored_medians_and_publishers_give_the_same_rows(moving):
    totals = monthly.monthly_market_totals(moving)
    publishers, middles = monthly.publisher_totals(moving).cache(), monthly.theme_medians(moving).cache()
    pairs = [
        (opportunity.market_structure(moving, totals), opportunity.market_structure(moving, totals, None, publishers, middles)),
        (monthly.theme_monthly_metrics(moving, totals), monthly.theme_monthly_metrics(moving, totals, publishers, middles)),
    ]
    for own, stored in pairs:
        assert own.exceptAll(stored).isEmpty() and stored.exceptAll(own).isEmpty()
