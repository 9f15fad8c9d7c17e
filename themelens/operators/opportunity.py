"""Concentration, growth sources, label breakdowns and leaders of each theme month.

Input is the enriched fact table of ``monthly.with_neighbour_months``. Both measures run through the same
long-form passes, so each statistic is one expression and one shuffle.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from themelens.constants import DIMENSIONS, MEASURES, PERIOD, THEME
from themelens.functions.numeric import count_where, positive_share, share, total
from themelens.operators.monthly import age_days, publisher_totals, theme_medians
from themelens.operators.ordering import by_label, label_medians, leading_values, top_rows

MEASURE_OF = {prefix: column for column, prefix in MEASURES}


def themed(facts: DataFrame) -> DataFrame:
    return facts.where(F.col("game_theme").isNotNull())


def _long(df: DataFrame, keep: Sequence[str], values: Mapping[str, Column]) -> DataFrame:
    """One row per non-NULL value: kept columns, ``measure``, ``value``."""
    entries = F.array(
        *[F.struct(F.lit(name).alias("measure"), value.cast("double").alias("value")) for name, value in values.items()]
    )
    long = df.select(*keep, F.explode(entries).alias("_e")).select(*keep, "_e.measure", "_e.value")
    return long.where(F.col("value").isNotNull())


def _largest(
    df: DataFrame,
    keys: Sequence[str],
    keep: Sequence[str],
    values: Mapping[str, Column],
    limit: int,
    name: str,
    *ties: Column,
) -> DataFrame:
    """First ``limit`` rows of each group and measure by (-value, ``ties``) in long form, with their position."""
    near = leading_values(df, keys, values, limit)
    rows = _long(near, keep, {n: F.col(f"_top_{n}") for n in values})
    return top_rows(rows, [*keys, "measure"], [F.col("value").desc(), *ties], limit, name)


def concentration(
    df: DataFrame, keys: Sequence[str], values: Mapping[str, Column], limits: Sequence[int]
) -> DataFrame:
    """Top-k shares and Herfindahl index of several value columns per group.

    Shares are NULL when the total is NULL or not above zero. The index uses sum(v^2) / sum(v)^2, which
    aggregates before the shuffle; top-k keeps at most max(limits) rows per group and map task.
    Output columns: ``<name>_top_<k>`` and ``<name>_hhi``.
    """
    keys = list(keys)
    sums = df.groupBy(*keys).agg(
        *[
            expression
            for name, value in values.items()
            for expression in (total(value).alias(f"_sum_{name}"), F.sum(value * value).alias(f"_square_{name}"))
        ]
    )
    largest = _largest(df, keys, keys, values, max(limits), "leader_rank")
    tops = largest.groupBy(*keys).agg(*_top_sums(values, limits))
    return sums.join(tops, keys, "left").select(*keys, *_concentration_columns(values, limits))


def _top_sums(names: Iterable[str], limits: Sequence[int]) -> list[Column]:
    return [
        total(F.when((F.col("measure") == name) & (F.col("leader_rank") <= limit), F.col("value"))).alias(
            f"_top_{name}_{limit}"
        )
        for name in names
        for limit in limits
    ]


def _concentration_columns(names: Iterable[str], limits: Sequence[int]) -> list[Column]:
    outputs: list[Column] = []
    for name in names:
        whole = F.col(f"_sum_{name}")
        outputs += [
            positive_share(F.col(f"_top_{name}_{limit}"), whole).alias(f"{name}_top_{limit}") for limit in limits
        ]
        outputs.append(F.when(whole > 0, F.col(f"_square_{name}") / (whole * whole)).alias(f"{name}_hhi"))
    return outputs


def top_k_share(facts: DataFrame) -> DataFrame:
    """Share of the 1, 3 and 10 largest products in each measure of a theme."""
    result = product_concentration(facts)
    return result.select(*THEME, *[c for c in result.columns if "_top_" in c])


def herfindahl(facts: DataFrame) -> DataFrame:
    """Product Herfindahl index of each measure of a theme."""
    return product_concentration(facts).select(*THEME, "downloads_product_hhi", "revenue_usd_product_hhi")


def product_concentration(facts: DataFrame) -> DataFrame:
    stats = concentration(
        themed(facts), THEME, {prefix: F.col(column) for column, prefix in MEASURES}, (1, 3, 10)
    )
    return stats.select(
        *THEME,
        *[
            F.col(f"{prefix}_top_{k}").alias(f"{prefix}_top_{k}_product_share")
            for _, prefix in MEASURES
            for k in (1, 3, 10)
        ],
        *[F.col(f"{prefix}_hhi").alias(f"{prefix}_product_hhi") for _, prefix in MEASURES],
    )


def publisher_concentrations(facts: DataFrame, publishers: DataFrame | None = None) -> DataFrame:
    """Publisher coverage plus top-1, top-3 and Herfindahl over product counts and both measures; ``publishers`` may hold
    the stored totals."""
    publishers = publisher_totals(facts) if publishers is None else publishers
    stats = concentration(
        publishers,
        THEME,
        {"product": F.col("products"), "downloads": F.col("units"), "revenue_usd": F.col("revenue")},
        (1, 3),
    )
    coverage = publishers.groupBy(*THEME).agg(
        F.sum("products").alias("publisher_coverage_count"),
        F.count(F.lit(1)).alias("publisher_count"),
        F.sum("units_coverage").alias("publisher_downloads_coverage_count"),
        F.sum("revenue_coverage").alias("publisher_revenue_usd_coverage_count"),
    )
    shares = [
        F.col(f"{name}_top_{k}").alias(f"top_{k}_publisher_{name}_share")
        for name in ("product", "downloads", "revenue_usd")
        for k in (1, 3)
    ]
    indexes = [F.col(f"{name}_hhi").alias(f"publisher_{name}_hhi") for name in ("product", "downloads", "revenue_usd")]
    return coverage.join(stats, THEME).select(
        *THEME,
        "publisher_coverage_count",
        "publisher_count",
        "publisher_downloads_coverage_count",
        "publisher_revenue_usd_coverage_count",
        *shares,
        *indexes,
    )


def leaders(facts: DataFrame, limit: int = 10) -> DataFrame:
    """The first ``limit`` covered products per theme and measure by (-value, rank, id)."""
    return _largest(
        themed(facts),
        THEME,
        [*THEME, "unified_app_id", "rank_position", "release_date_ww"],
        {prefix: F.col(column) for column, prefix in MEASURES},
        limit,
        "leader_rank",
        F.col("rank_position"),
        F.col("unified_app_id"),
    )


def product_age(facts: DataFrame) -> DataFrame:
    """Age in days at period end: coverage, future releases, median overall and of the top 10."""
    rows = themed(facts)
    counts = rows.groupBy(*THEME).agg(
        F.count("release_date_ww").alias("release_date_ww_coverage_count"),
        (F.count("release_date_ww") / F.count(F.lit(1))).alias("release_date_ww_coverage_ratio"),
        F.count(age_days()).alias("release_date_ww_valid_age_count"),
        count_where(F.col("release_date_ww") > F.col("period_end")).alias("release_date_ww_future_count"),
    )
    overall = theme_medians(facts).select(*THEME, "median_product_age_days")
    return counts.join(overall, THEME, "left").join(
        leaders(facts).groupBy(*THEME).agg(*_leader_age_medians()), THEME, "left"
    )


def _leader_age_medians() -> list[Column]:
    # At most ten ages per group and measure, so the built-in exact median is bounded.
    return [
        F.median(F.when(F.col("measure") == prefix, age_days())).alias(f"{prefix}_top_10_median_product_age_days")
        for _, prefix in MEASURES
    ]


def market_structure(
    facts: DataFrame,
    totals: DataFrame,
    best: DataFrame | None = None,
    publishers: DataFrame | None = None,
    middles: DataFrame | None = None,
) -> DataFrame:
    """The full structure row of each theme month; ``best``, ``publishers`` and ``middles`` may hold the stored
    :func:`leaders`, publisher totals and medians."""
    rows = themed(facts)
    basics = rows.groupBy(*THEME).agg(
        F.count(F.lit(1)).alias("product_count"),
        count_where(F.col("rank_position") <= 100).alias("top_100_count"),
        count_where(F.col("rank_position") <= 500).alias("top_500_count"),
        F.avg("rank_position").alias("average_rank"),
        *[
            expression
            for column, prefix in MEASURES
            for expression in (
                F.count(column).alias(f"{prefix}_coverage_count"),
                total(F.col(column)).alias(f"{prefix}_sum"),
                F.sum(F.col(column) * F.col(column)).alias(f"_square_{prefix}"),
            )
        ],
        F.count("release_date_ww").alias("release_date_ww_coverage_count"),
        F.count(age_days()).alias("release_date_ww_valid_age_count"),
        count_where(F.col("release_date_ww") > F.col("period_end")).alias("release_date_ww_future_count"),
    )
    middle = theme_medians(facts) if middles is None else middles
    best = leaders(facts) if best is None else best
    top_ten = best.groupBy(*THEME).agg(*_top_sums(MEASURE_OF, (1, 3, 10)), *_leader_age_medians())
    month = totals.select(
        *PERIOD,
        "snapshot_count",
        F.col("units_absolute_sum").alias("_downloads_total"),
        F.col("revenue_absolute_sum").alias("_revenue_usd_total"),
    )
    joined = (
        basics.join(middle, THEME)
        .join(top_ten, THEME, "left")
        .join(publisher_concentrations(facts, publishers), THEME, "left")
        .join(month, PERIOD)
    )
    products = F.col("product_count")

    def top_share(prefix: str, k: int) -> Column:
        return positive_share(F.col(f"_top_{prefix}_{k}"), F.col(f"{prefix}_sum"))

    def measure_columns(prefix: str) -> list[Column]:
        covered = F.col(f"{prefix}_coverage_count")
        return [
            covered,
            (covered / products).alias(f"{prefix}_coverage_ratio"),
            F.col(f"{prefix}_sum"),
            positive_share(F.col(f"{prefix}_sum"), F.col(f"_{prefix}_total")).alias(f"{prefix}_share"),
            share(F.col(f"{prefix}_sum"), covered).alias(f"{prefix}_mean_per_covered_product"),
            F.col(f"{prefix}_median_per_covered_product"),
            *[top_share(prefix, k).alias(f"{prefix}_top_{k}_product_share") for k in (1, 3, 10)],
            F.when(
                F.col(f"{prefix}_sum") > 0,
                F.col(f"_square_{prefix}") / (F.col(f"{prefix}_sum") * F.col(f"{prefix}_sum")),
            ).alias(f"{prefix}_product_hhi"),
        ]

    def covered_count(name: str) -> list[Column]:
        count = F.coalesce(F.col(f"{name}_coverage_count"), F.lit(0))
        return [count.alias(f"{name}_coverage_count"), (count / products).alias(f"{name}_coverage_ratio")]

    return joined.select(
        *THEME,
        "product_count",
        (products / F.col("snapshot_count")).alias("product_share"),
        "top_100_count",
        "top_500_count",
        "average_rank",
        "median_rank",
        *measure_columns("downloads"),
        *measure_columns("revenue_usd"),
        *covered_count("publisher"),
        F.coalesce("publisher_count", F.lit(0)).alias("publisher_count"),
        "top_1_publisher_product_share",
        "top_3_publisher_product_share",
        "publisher_product_hhi",
        *covered_count("publisher_downloads"),
        "top_1_publisher_downloads_share",
        "top_3_publisher_downloads_share",
        "publisher_downloads_hhi",
        *covered_count("publisher_revenue_usd"),
        "top_1_publisher_revenue_usd_share",
        "top_3_publisher_revenue_usd_share",
        "publisher_revenue_usd_hhi",
        *covered_count("release_date_ww"),
        "release_date_ww_valid_age_count",
        "release_date_ww_future_count",
        "median_product_age_days",
        "downloads_top_10_median_product_age_days",
        "revenue_usd_top_10_median_product_age_days",
    )


def theme_membership(facts: DataFrame) -> DataFrame:
    """One row per (theme month, product) that the theme holds now or held the month before.

    A stored row counts as current in its own month and, when the product does not continue in the same
    theme, as an exit in the next month. No join is needed: the neighbouring rows are already attached.
    """
    stays = F.col("previous.game_theme") == F.col("game_theme")
    leaves = ~F.coalesce(F.col("following.game_theme") == F.col("game_theme"), F.lit(False))
    next_start = F.add_months("period_start", 1)
    no_number = F.lit(None).cast("double")
    no_rank = F.lit(None).cast("int")

    def entry(start, end, current, before, is_new):
        now = [F.lit(True), F.col("rank_position"), F.col("units_absolute"), F.col("revenue_absolute")]
        none = [F.lit(False), no_rank, no_number, no_number]
        names = ("present", "rank", "downloads", "revenue_usd")
        return F.struct(
            start.alias("period_start"),
            end.alias("period_end"),
            is_new.alias("is_market_new"),
            *[value.alias(f"cur_{name}") for value, name in zip(now if current else none, names)],
            *[value.alias(f"prev_{name}") for value, name in zip(before, names)],
        )

    kept = F.coalesce(stays, F.lit(False))
    current = entry(
        F.col("period_start"),
        F.col("period_end"),
        True,
        [
            kept,
            F.when(kept, F.col("previous.rank_position")),
            F.when(kept, F.col("previous.units_absolute")),
            F.when(kept, F.col("previous.revenue_absolute")),
        ],
        F.col("is_market_new"),
    )
    gone = entry(
        next_start,
        F.last_day(next_start),
        False,
        [F.lit(True), F.col("rank_position"), F.col("units_absolute"), F.col("revenue_absolute")],
        F.lit(False),
    )
    members = (
        themed(facts)
        .select(
            "scope_name",
            "cadence",
            "game_theme",
            "unified_app_id",
            F.explode(F.array(current, F.when(leaves, gone))).alias("_m"),
        )
        .where(F.col("_m").isNotNull())
        .select("scope_name", "cadence", "game_theme", "unified_app_id", "_m.*")
    )
    return members.select(
        *THEME,
        "unified_app_id",
        *[c for c in members.columns if c not in (*THEME, "unified_app_id")],
        (F.col("cur_present") & ~F.col("prev_present")).alias("is_entry"),
        (F.col("prev_present") & ~F.col("cur_present")).alias("is_exit"),
        (F.col("cur_present") & F.col("prev_present")).alias("is_continuing"),
    )


def _month_flags(facts: DataFrame) -> DataFrame:
    return facts.select(*PERIOD, "has_previous_month").distinct()


def _present_now(grouped: DataFrame, facts: DataFrame) -> DataFrame:
    """Themes present in the month get a row; the month flag decides whether previous values exist."""
    return grouped.where(F.col("current_product_count") > 0).join(_month_flags(facts), PERIOD)


def _if_previous(column: Column) -> Column:
    return F.when(F.col("has_previous_month"), column)


def growth_membership(facts: DataFrame) -> DataFrame:
    """Product count change, market and theme entries, exits and continuing products."""
    return _growth_aggregate(facts).select(*THEME, *MEMBERSHIP_COLUMNS)


def turnover(facts: DataFrame) -> DataFrame:
    """Entry, exit and retention of the products ranked within 100 and within 500."""
    return _growth_aggregate(facts).select(*THEME, *TURNOVER_COLUMNS)


MEMBERSHIP_COLUMNS = (
    "has_previous_month",
    "previous_product_count",
    "current_product_count",
    "product_count_change",
    "market_new_entry_count",
    "market_returning_product_count",
    "theme_entry_count",
    "theme_exit_count",
    "continuing_theme_product_count",
    "market_new_entry_share",
    "theme_entry_share",
    "market_new_entry_top_100_count",
    "market_new_entry_top_100_rate",
    "market_new_entry_top_500_count",
    "market_new_entry_top_500_rate",
)
TURNOVER_COLUMNS = tuple(
    f"top_{t}_{part}"
    for t in (100, 500)
    for part in ("current_count", "previous_count", "entry_count", "exit_count", "retained_count", "turnover_rate")
)
RETENTION_COLUMNS = tuple(
    f"{prefix}_top_10_{part}"
    for _, prefix in MEASURES
    for part in ("current_count", "retained_count", "retention_rate")
)
DECOMPOSITION_PARTS = (
    "current_coverage_count",
    "previous_coverage_count",
    "decomposition_complete",
    "current_sum",
    "previous_sum",
    "mom_change",
    "mom_growth_rate",
    "market_new_entry_sum",
    "market_new_entry_share_of_current",
    "theme_entry_contribution",
    "continuing_contribution",
    "theme_exit_contribution",
    "positive_contribution_sum",
    "negative_contribution_sum",
    "positive_contributor_count",
    "negative_contributor_count",
    "unchanged_contributor_count",
    "market_new_entry_positive_contribution_share",
    "continuing_positive_contribution_share",
    "top_1_positive_contribution_share",
    "top_3_positive_contribution_share",
    "top_10_positive_contribution_share",
)
DECOMPOSITION_COLUMNS = tuple(f"{prefix}_{part}" for _, prefix in MEASURES for part in DECOMPOSITION_PARTS)


def _growth_aggregate(facts: DataFrame) -> DataFrame:
    """Every growth statistic that one grouped pass over the membership rows can produce."""
    members = theme_membership(facts)
    new = F.col("is_market_new") & F.col("cur_present")
    counts = [
        count_where(F.col("cur_present")).alias("current_product_count"),
        count_where(F.col("prev_present")).alias("_previous"),
        count_where(new).alias("_new"),
        count_where(F.col("is_entry")).alias("_entry"),
        count_where(F.col("is_exit")).alias("_exit"),
        count_where(F.col("is_continuing")).alias("_continuing"),
        count_where(new & (F.col("cur_rank") <= 100)).alias("_new_100"),
        count_where(new & (F.col("cur_rank") <= 500)).alias("_new_500"),
    ]
    for t in (100, 500):
        now = F.coalesce(F.col("cur_rank") <= t, F.lit(False))
        before = F.coalesce(F.col("prev_rank") <= t, F.lit(False))
        counts += [
            count_where(now).alias(f"_now_{t}"),
            count_where(before).alias(f"_before_{t}"),
            count_where(now & ~before).alias(f"_in_{t}"),
            count_where(before & ~now).alias(f"_out_{t}"),
            count_where(now & before).alias(f"_kept_{t}"),
        ]
    for _, prefix in MEASURES:
        cur, prev = F.col(f"cur_{prefix}"), F.col(f"prev_{prefix}")
        missing = (F.col("cur_present") & cur.isNull()) | (F.col("prev_present") & prev.isNull())
        delta = _delta(prefix)
        gain = F.greatest(delta, F.lit(0.0))
        counts += [
            F.count(cur).alias(f"_{prefix}_cur_n"),
            F.count(prev).alias(f"_{prefix}_prev_n"),
            count_where(missing).alias(f"_{prefix}_missing"),
            total(cur).alias(f"_{prefix}_cur_sum"),
            total(prev).alias(f"_{prefix}_prev_sum"),
            total(delta).alias(f"_{prefix}_change"),
            total(F.when(new, delta)).alias(f"_{prefix}_new"),
            total(F.when(F.col("is_entry"), delta)).alias(f"_{prefix}_entry"),
            total(F.when(F.col("is_continuing"), delta)).alias(f"_{prefix}_continuing"),
            total(F.when(F.col("is_exit"), delta)).alias(f"_{prefix}_exit"),
            total(F.when(delta > 0, delta)).alias(f"_{prefix}_up"),
            total(F.when(delta < 0, delta)).alias(f"_{prefix}_down"),
            count_where(delta > 0).alias(f"_{prefix}_up_n"),
            count_where(delta < 0).alias(f"_{prefix}_down_n"),
            count_where(delta == 0).alias(f"_{prefix}_same_n"),
            total(F.when(new, gain)).alias(f"_{prefix}_new_up"),
            total(F.when(F.col("is_continuing"), gain)).alias(f"_{prefix}_continuing_up"),
        ]
    grouped = _present_now(members.groupBy(*THEME).agg(*counts), facts)
    current, new_count = F.col("current_product_count"), F.col("_new")
    columns = [
        _if_previous(F.col("_previous")).alias("previous_product_count"),
        current,
        _if_previous(current - F.col("_previous")).alias("product_count_change"),
        _if_previous(new_count).alias("market_new_entry_count"),
        _if_previous(current - new_count).alias("market_returning_product_count"),
        _if_previous(F.col("_entry")).alias("theme_entry_count"),
        _if_previous(F.col("_exit")).alias("theme_exit_count"),
        _if_previous(F.col("_continuing")).alias("continuing_theme_product_count"),
        _if_previous(new_count / current).alias("market_new_entry_share"),
        _if_previous(F.col("_entry") / current).alias("theme_entry_share"),
    ]
    for t in (100, 500):
        columns += [
            _if_previous(F.col(f"_new_{t}")).alias(f"market_new_entry_top_{t}_count"),
            _if_previous(share(F.col(f"_new_{t}"), new_count)).alias(f"market_new_entry_top_{t}_rate"),
        ]
    for t in (100, 500):
        columns += [
            F.col(f"_now_{t}").alias(f"top_{t}_current_count"),
            _if_previous(F.col(f"_before_{t}")).alias(f"top_{t}_previous_count"),
            _if_previous(F.col(f"_in_{t}")).alias(f"top_{t}_entry_count"),
            _if_previous(F.col(f"_out_{t}")).alias(f"top_{t}_exit_count"),
            _if_previous(F.col(f"_kept_{t}")).alias(f"top_{t}_retained_count"),
            _if_previous(share(F.col(f"_in_{t}"), F.col(f"_now_{t}"))).alias(f"top_{t}_turnover_rate"),
        ]
    for _, prefix in MEASURES:
        columns += _decomposition_columns(prefix)
    return grouped.select(*THEME, "has_previous_month", *columns)


def _delta(prefix: str) -> Column:
    """Current minus previous value, an absent side counting as zero, a missing measure as NULL."""
    cur = F.when(F.col("cur_present"), F.col(f"cur_{prefix}")).otherwise(F.lit(0.0))
    prev = F.when(F.col("prev_present"), F.col(f"prev_{prefix}")).otherwise(F.lit(0.0))
    return F.round(cur - prev, 6)


def _decomposition_columns(prefix: str) -> list[Column]:
    def raw(name: str) -> Column:
        return F.col(f"_{prefix}_{name}")

    complete = raw("missing") == 0
    usable = F.col("has_previous_month") & complete

    def sum_or_zero(name: str) -> Column:
        return F.when(usable, F.coalesce(raw(name), F.lit(0.0)))

    up = F.coalesce(raw("up"), F.lit(0.0))
    values = {
        "current_coverage_count": raw("cur_n"),
        "previous_coverage_count": _if_previous(raw("prev_n")),
        "decomposition_complete": _if_previous(complete),
        "current_sum": raw("cur_sum"),
        "previous_sum": _if_previous(raw("prev_sum")),
        "mom_change": sum_or_zero("change"),
        "mom_growth_rate": F.when(usable, positive_share(raw("change"), raw("prev_sum"))),
        "market_new_entry_sum": sum_or_zero("new"),
        "market_new_entry_share_of_current": F.when(
            usable, positive_share(F.coalesce(raw("new"), F.lit(0.0)), raw("cur_sum"))
        ),
        "theme_entry_contribution": sum_or_zero("entry"),
        "continuing_contribution": sum_or_zero("continuing"),
        "theme_exit_contribution": sum_or_zero("exit"),
        "positive_contribution_sum": sum_or_zero("up"),
        "negative_contribution_sum": sum_or_zero("down"),
        "positive_contributor_count": F.when(usable, raw("up_n")),
        "negative_contributor_count": F.when(usable, raw("down_n")),
        "unchanged_contributor_count": F.when(usable, raw("same_n")),
        "market_new_entry_positive_contribution_share": F.when(
            usable, positive_share(F.coalesce(raw("new_up"), F.lit(0.0)), up)
        ),
        "continuing_positive_contribution_share": F.when(
            usable, positive_share(F.coalesce(raw("continuing_up"), F.lit(0.0)), up)
        ),
    }
    return [value.alias(f"{prefix}_{name}") for name, value in values.items()]


def _top_gains(facts: DataFrame) -> DataFrame:
    """Sums of the 1, 3 and 10 largest positive deltas per theme and measure."""
    gains = {prefix: F.when(_delta(prefix) > 0, _delta(prefix)) for _, prefix in MEASURES}
    best = _largest(theme_membership(facts), THEME, THEME, gains, 10, "_rank")
    return best.groupBy(*THEME).agg(
        *[
            total(F.when((F.col("measure") == prefix) & (F.col("_rank") <= k), F.col("value"))).alias(
                f"_{prefix}_gain_{k}"
            )
            for _, prefix in MEASURES
            for k in (1, 3, 10)
        ]
    )


def growth_decomposition(facts: DataFrame) -> DataFrame:
    """Month-over-month change of each measure split by where it came from."""
    base = _growth_aggregate(facts).join(_top_gains(facts), THEME, "left")
    shares = [
        F.when(
            F.col("has_previous_month") & F.col(f"{prefix}_decomposition_complete"),
            positive_share(
                F.coalesce(F.col(f"_{prefix}_gain_{k}"), F.lit(0.0)), F.col(f"{prefix}_positive_contribution_sum")
            ),
        ).alias(f"{prefix}_top_{k}_positive_contribution_share")
        for _, prefix in MEASURES
        for k in (1, 3, 10)
    ]
    computed = {f"{prefix}_top_{k}_positive_contribution_share" for _, prefix in MEASURES for k in (1, 3, 10)}
    wide = base.select(*[c for c in base.columns if "_gain_" not in c], *shares)
    return wide.select(*THEME, *[c for c in DECOMPOSITION_COLUMNS if c in wide.columns or c in computed])


def top_ten_retention(facts: DataFrame, best: DataFrame | None = None) -> DataFrame:
    """Overlap of this month's and last month's top ten products per measure."""
    best = leaders(facts) if best is None else best
    one = Window.partitionBy("scope_name", "cadence", "game_theme", "measure", "unified_app_id").orderBy(
        "period_start"
    )
    marked = best.withColumn(
        "_kept",
        F.coalesce(F.lag("period_start").over(one) == F.add_months("period_start", -1), F.lit(False)),
    )
    counts = marked.groupBy(*THEME).agg(
        *[
            expression
            for _, prefix in MEASURES
            for own in [F.col("measure") == prefix]
            for expression in (
                count_where(own).alias(f"_{prefix}_now"),
                count_where(own & F.col("_kept")).alias(f"_{prefix}_kept"),
            )
        ]
    )
    present = themed(facts).select(*THEME, "has_previous_month").distinct()

    def zero(name: str) -> Column:
        return F.coalesce(F.col(name), F.lit(0))

    return present.join(counts, THEME, "left").select(
        *THEME,
        *[
            column
            for _, prefix in MEASURES
            for column in (
                zero(f"_{prefix}_now").alias(f"{prefix}_top_10_current_count"),
                _if_previous(zero(f"_{prefix}_kept")).alias(f"{prefix}_top_10_retained_count"),
                _if_previous(share(zero(f"_{prefix}_kept"), zero(f"_{prefix}_now"))).alias(
                    f"{prefix}_top_10_retention_rate"
                ),
            )
        ],
    )


def growth_sources(facts: DataFrame, best: DataFrame | None = None) -> DataFrame:
    """Membership, turnover, retention and decomposition in one row per theme month."""
    aggregate = _growth_aggregate(facts)
    gains = _top_gains(facts)
    shares = {
        f"{prefix}_top_{k}_positive_contribution_share": F.when(
            F.col("has_previous_month") & F.col(f"{prefix}_decomposition_complete"),
            positive_share(
                F.coalesce(F.col(f"_{prefix}_gain_{k}"), F.lit(0.0)), F.col(f"{prefix}_positive_contribution_sum")
            ),
        )
        for _, prefix in MEASURES
        for k in (1, 3, 10)
    }
    return (
        aggregate.join(gains, THEME, "left")
        .withColumns(shares)
        .join(top_ten_retention(facts, best), THEME)
        .select(*THEME, *MEMBERSHIP_COLUMNS, *TURNOVER_COLUMNS, *RETENTION_COLUMNS, *DECOMPOSITION_COLUMNS)
    )


def dimension_metrics(facts: DataFrame, totals: DataFrame, themes: DataFrame) -> DataFrame:
    """Metrics of each label value inside a theme, for four label columns at once."""
    keys = [*THEME, "dimension_type", "dimension_value"]
    rows = by_label(
        themed(facts),
        DIMENSIONS,
        [
            *THEME,
            "rank_position",
            "units_absolute",
            "revenue_absolute",
            "has_previous_month",
            "is_market_new",
        ],
    )
    new = F.col("is_market_new")
    # Combined before the shuffle; only the products of a publisher, which hardly combine, are shuffled by publisher, a row
    # each, and repeated for their labels behind the shuffle.
    basics = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("product_count"),
        F.avg("rank_position").alias("average_rank"),
        count_where(F.col("rank_position") <= 100).alias("top_100_count"),
        count_where(F.col("rank_position") <= 500).alias("top_500_count"),
        *[
            expression
            for column, prefix in MEASURES
            for expression in (
                F.count(column).alias(f"{prefix}_coverage_count"),
                total(F.col(column)).alias(f"{prefix}_sum"),
                F.max(column).alias(f"_{prefix}_max"),
            )
        ],
        F.max("has_previous_month").alias("has_previous_month"),
        count_where(new).alias("_new"),
        count_where(new & (F.col("rank_position") <= 100)).alias("_new_100"),
        count_where(new & (F.col("rank_position") <= 500)).alias("_new_500"),
    )
    publisher = [*THEME, "publisher_display_name"]
    covered = themed(facts).where(F.col("publisher_display_name").isNotNull()).select(*publisher, *DIMENSIONS)
    publishers = (
        by_label(covered.repartition(*publisher), DIMENSIONS, publisher)
        .groupBy(*keys, "publisher_display_name")
        .agg(F.count(F.lit(1)).alias("_covered"))
        .groupBy(*keys)
        .agg(
            F.sum("_covered").alias("publisher_coverage_count"),
            F.count(F.lit(1)).alias("publisher_count"),
            (F.max("_covered") / F.sum("_covered")).alias("top_1_publisher_product_share"),
        )
    )
    middle = label_medians(
        themed(facts),
        THEME,
        DIMENSIONS,
        {
            "median_rank": F.col("rank_position"),
            "downloads_median_per_covered_product": F.col("units_absolute"),
            "revenue_usd_median_per_covered_product": F.col("revenue_absolute"),
        },
        themes.select(*THEME, F.col("product_count").alias("_n")),
    )
    theme = themes.select(
        *THEME,
        F.col("product_count").alias("_theme_products"),
        F.col("units_absolute_sum").alias("_downloads_theme"),
        F.col("revenue_absolute_sum").alias("_revenue_usd_theme"),
    )
    month = totals.select(
        *PERIOD,
        "snapshot_count",
        F.col("units_absolute_sum").alias("_downloads_total"),
        F.col("revenue_absolute_sum").alias("_revenue_usd_total"),
    )
    products = F.col("product_count")

    def measure_columns(prefix: str) -> list[Column]:
        added, covered = F.col(f"{prefix}_sum"), F.col(f"{prefix}_coverage_count")
        return [
            covered,
            added,
            share(added, F.col(f"_{prefix}_theme")).alias(f"{prefix}_share_within_theme"),
            share(added, F.col(f"_{prefix}_total")).alias(f"{prefix}_share_within_market"),
            share(added, covered).alias(f"{prefix}_mean_per_covered_product"),
            F.col(f"{prefix}_median_per_covered_product"),
            positive_share(F.col(f"_{prefix}_max"), added).alias(f"{prefix}_top_1_product_share"),
        ]

    return (
        basics.join(middle, keys)
        .join(publishers, keys, "left")
        .join(theme, THEME)
        .join(month, PERIOD)
        .select(
            *keys,
            "product_count",
            (products / F.col("_theme_products")).alias("product_share_within_theme"),
            (products / F.col("snapshot_count")).alias("product_share_within_market"),
            "top_100_count",
            "top_500_count",
            "average_rank",
            "median_rank",
            *measure_columns("downloads"),
            *measure_columns("revenue_usd"),
            "has_previous_month",
            _if_previous(F.col("_new")).alias("market_new_entry_count"),
            _if_previous(F.col("_new") / products).alias("market_new_entry_share"),
            _if_previous(F.col("_new_100")).alias("market_new_entry_top_100_count"),
            _if_previous(share(F.col("_new_100"), F.col("_new"))).alias("market_new_entry_top_100_rate"),
            _if_previous(F.col("_new_500")).alias("market_new_entry_top_500_count"),
            _if_previous(share(F.col("_new_500"), F.col("_new"))).alias("market_new_entry_top_500_rate"),
            F.coalesce("publisher_coverage_count", F.lit(0)).alias("publisher_coverage_count"),
            F.coalesce("publisher_count", F.lit(0)).alias("publisher_count"),
            "top_1_publisher_product_share",
        )
    )


def representative_rows(facts: DataFrame) -> DataFrame:
    """Product rows with previous-month values of the whole market, changes and entry flags."""
    absent = F.when(F.col("has_previous_month") & F.col("previous").isNull(), F.lit(0.0))
    previous_downloads = F.when(F.col("previous").isNotNull(), F.col("previous.units_absolute")).otherwise(absent)
    previous_revenue = F.when(F.col("previous").isNotNull(), F.col("previous.revenue_absolute")).otherwise(absent)
    stays = F.coalesce(F.col("previous.game_theme") == F.col("game_theme"), F.lit(False))
    return themed(facts).select(
        *THEME,
        "source_app_id",
        "unified_app_id",
        "game_name",
        "publisher_display_name",
        *DIMENSIONS,
        "release_date_ww",
        "rank_position",
        F.col("previous.rank_position").alias("previous_rank_position"),
        F.col("units_absolute").alias("downloads"),
        previous_downloads.alias("previous_downloads"),
        F.round(F.col("units_absolute") - previous_downloads, 6).alias("downloads_change"),
        F.col("revenue_absolute").alias("revenue_usd"),
        previous_revenue.alias("previous_revenue_usd"),
        F.round(F.col("revenue_absolute") - previous_revenue, 6).alias("revenue_usd_change"),
        F.col("is_market_new").alias("is_market_new_entry"),
        _if_previous(~stays).alias("is_theme_entry"),
    )


def representative_leaders(facts: DataFrame, limit: int = 3) -> DataFrame:
    """Six kinds of leading products per theme month, the first three of each."""
    rows = representative_rows(facts)
    new = F.coalesce(F.col("is_market_new_entry"), F.lit(False))
    gain, revenue_gain = F.col("downloads_change"), F.col("revenue_usd_change")
    kinds = {
        "downloads_leader": F.col("downloads"),
        "revenue_leader": F.col("revenue_usd"),
        "market_new_entry_downloads_leader": F.when(new, F.col("downloads")),
        "market_new_entry_revenue_leader": F.when(new, F.col("revenue_usd")),
        "downloads_growth_leader": F.when(gain > 0, gain),
        "revenue_growth_leader": F.when(revenue_gain > 0, revenue_gain),
    }
    best = _largest(
        rows, THEME, rows.columns, kinds, limit, "evidence_rank", F.col("rank_position"), F.col("unified_app_id")
    ).withColumnRenamed("measure", "evidence_type")
    return best.select(*THEME, "evidence_type", "evidence_rank", *[c for c in rows.columns if c not in THEME])
