"""Value rules of every stage table, counted while the table is written.

A rule names columns and what holds for them in each row: a range, a set of members, one column at most another, parts
that add up, a sum that is NULL if and only if nothing is covered, a value that needs a flag. Rules of single columns
follow from the column's name, the others are listed by table. They are counted as observed metrics of the write itself,
so no table is scanned a second time and nothing is shuffled. A rule holds where a compared value is NULL.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from themelens.constants import MEMBERS
from themelens.functions.numeric import count_where

#: Room for the rounding of ratios at the ends of a range.
MARGIN = 1e-9


@dataclass(frozen=True)
class Rule:
    """``kind`` says how ``column`` and ``others`` (columns, limits or members) stand to each other."""

    kind: str
    column: str
    others: tuple = ()

    @property
    def name(self) -> str:
        if self.kind in ("at_most", "covered_by", "only_with"):
            return f"{self.column}_{self.kind}_{self.others[0]}"
        return f"{self.column}_{self.kind}"


_UNIT = re.compile(r"(_share|_ratio|_rate|_hhi|_ci_low|_ci_high|_share_within_(theme|market)|_share_of_current)$")
_NOT_UNIT = re.compile(r"(_to_mean_ratio|_growth_rate)$")
_COUNT = re.compile(r"(_count(_\d+m)?|^active_months_\w+|^months_since_\w+|_amplitude|^seasonal_index|^standard_deviation|^stability_cv_\w+)$")
_RANK = re.compile(r"(rank_position|_rank)$")

#: Column at most another column: table -> limit -> columns.
AT_MOST: dict[str, dict[str, tuple[str, ...]]] = {
    "totals": {
        "snapshot_count": ("metadata_coverage_count", "units_absolute_coverage_count", "revenue_absolute_coverage_count"),
    },
    "themes": {
        "product_count": (
            "top_100_count", "top_500_count", "publisher_coverage_count", "units_absolute_coverage_count",
            "revenue_absolute_coverage_count", "new_entry_count", "returning_product_count",
        ),
        "publisher_coverage_count": ("publisher_count",),
    },
    "structure": {
        "product_count": (
            "top_100_count", "top_500_count", "downloads_coverage_count", "revenue_usd_coverage_count",
            "publisher_coverage_count", "publisher_downloads_coverage_count", "publisher_revenue_usd_coverage_count",
            "release_date_ww_coverage_count",
        ),
        "publisher_coverage_count": ("publisher_count",),
        "release_date_ww_coverage_count": ("release_date_ww_valid_age_count", "release_date_ww_future_count"),
        **{
            f"{prefix}_top_{wide}_product_share": (f"{prefix}_top_{narrow}_product_share",)
            for prefix in ("downloads", "revenue_usd")
            for narrow, wide in ((1, 3), (3, 10))
        },
    },
    "growth": {
        "current_product_count": (
            "market_new_entry_count", "theme_entry_count", "continuing_theme_product_count", "top_500_current_count",
            "downloads_current_coverage_count", "revenue_usd_current_coverage_count",
        ),
        "previous_product_count": ("theme_exit_count", "top_500_previous_count"),
        "top_500_current_count": ("top_100_current_count", "top_500_retained_count"),
        "market_new_entry_count": ("market_new_entry_top_100_count", "market_new_entry_top_500_count"),
        "downloads_top_10_current_count": ("downloads_top_10_retained_count",),
        "revenue_usd_top_10_current_count": ("revenue_usd_top_10_retained_count",),
    },
    "dimensions": {
        "product_count": (
            "top_100_count", "top_500_count", "downloads_coverage_count", "revenue_usd_coverage_count",
            "publisher_coverage_count", "market_new_entry_count",
        ),
        "publisher_coverage_count": ("publisher_count",),
    },
    "horizons": {
        "horizon_month_count": ("metric_coverage_count", "active_month_count"),
        "transition_count": ("transition_coverage_count",),
        "maximum_value": ("minimum_value", "mean_value", "median_value"),
    },
    "feature_metrics": {
        "candidate_row_count": ("eligible_row_count",),
        "eligible_row_count": ("decision_month_count", "top_quintile_selected_count", "all_positive_change_count"),
        "top_quintile_selected_count": ("top_quintile_hit_count",),
        "correlation_cohort_count": ("positive_spearman_cohort_count",),
        "top_quintile_hit_ci_high": ("top_quintile_hit_ci_low",),
        "positive_spearman_ci_high": ("positive_spearman_ci_low",),
        "p75_spearman": ("p25_spearman", "median_spearman"),
    },
    "segment_metrics": {
        "candidate_row_count": ("eligible_row_count",),
        "eligible_row_count": ("decision_month_count", "positive_change_count"),
        "future_top_quintile_eligible_count": ("future_top_quintile_count",),
        "future_top_quintile_ci_high": ("future_top_quintile_ci_low",),
        "outcome_p75": ("outcome_p25", "outcome_median"),
    },
    "proxies": {
        "product_count": ("observable_revenue_usd_coverage_count", "downloads_coverage_count"),
    },
    "fits": {
        "target_month_product_count": (
            "target_month_downloads_coverage_count", "target_month_observable_revenue_coverage_count",
        ),
    },
}

#: Whole and its parts.
ADDS_UP: dict[str, tuple[tuple[str, ...], ...]] = {
    "totals": (("snapshot_count", "theme_present_count", "theme_missing_count"),),
    "themes": (("product_count", "new_entry_count", "returning_product_count"),),
    "growth": (
        ("current_product_count", "market_new_entry_count", "market_returning_product_count"),
        ("current_product_count", "theme_entry_count", "continuing_theme_product_count"),
        ("previous_product_count", "theme_exit_count", "continuing_theme_product_count"),
        ("top_100_current_count", "top_100_entry_count", "top_100_retained_count"),
        ("top_500_current_count", "top_500_entry_count", "top_500_retained_count"),
    ),
    "horizons": (("transition_coverage_count", "positive_change_count", "negative_change_count", "unchanged_change_count"),),
    "proxies": (
        (
            "product_count", "iaa_candidate_product_count", "iap_or_hybrid_candidate_product_count",
            "unknown_product_count",
        ),
    ),
}

#: Columns that are NULL unless a flag is set.
ONLY_WITH: dict[str, dict[str, tuple[str, ...]]] = {
    "themes": {"has_previous_month": ("new_entry_count", "returning_product_count", "new_entry_share")},
    "growth": {
        "has_previous_month": (
            "product_count_change", "theme_entry_count", "theme_exit_count", "market_new_entry_share",
            "top_100_turnover_rate", "top_500_turnover_rate",
        ),
        "downloads_decomposition_complete": ("downloads_theme_entry_contribution", "downloads_theme_exit_contribution"),
        "revenue_usd_decomposition_complete": ("revenue_usd_theme_entry_contribution", "revenue_usd_theme_exit_contribution"),
    },
    "dimensions": {"has_previous_month": ("market_new_entry_count", "market_new_entry_share")},
    "scores": {"is_actionable": ("trend_rank", "trend_score", "base_trend_score")},
}


def value_rules(table: str, columns: Sequence[str]) -> list[Rule]:
    """The rules of a table with these columns, in the order of the columns, then those across columns."""
    rules = []
    for name in columns:
        if name in MEMBERS:
            rules.append(Rule("one_of", name, MEMBERS[name]))
        elif name.endswith("calendar_month"):
            rules.append(Rule("between", name, (1, 12)))
        elif name.startswith("direction_evidence_count"):
            rules.append(Rule("between", name, (0, 3)))
        elif name.endswith("_spearman"):
            rules.append(Rule("between", name, (-1, 1)))
        elif _UNIT.search(name) and not _NOT_UNIT.search(name):
            rules.append(Rule("between", name, (0, 1)))
        elif name.endswith("confidence_score"):
            rules.append(Rule("between", name, (0, 100)))
        elif name == "product_count" and table in AT_MOST:
            rules.append(Rule("at_least", name, (1,)))
        elif _RANK.search(name) and not name.startswith(("average", "median", "latest")):
            rules.append(Rule("at_least", name, (1,)))
        elif _COUNT.search(name):
            rules.append(Rule("at_least", name, (0,)))
        coverage = f"{name.removesuffix('_sum')}_coverage_count"
        if name.endswith("_sum") and coverage in columns:
            rules.append(Rule("covered_by", name, (coverage,)))
        end = f"{name.removesuffix('_start')}_end"
        if name.endswith("_start") and end in columns:
            rules.append(Rule("at_most", name, (end,)))
    rules += [
        Rule("at_most", name, (limit,)) for limit, names in AT_MOST.get(table, {}).items() for name in names
    ]
    rules += [Rule("adds_up", f"{whole}_{parts[0]}", (whole, *parts)) for whole, *parts in ADDS_UP.get(table, ())]
    rules += [Rule("only_with", name, (flag,)) for flag, names in ONLY_WITH.get(table, {}).items() for name in names]
    return rules


def holds(rule: Rule) -> Column:
    """Whether a row keeps the rule; NULL where a compared value is NULL."""
    value = F.col(rule.column) if rule.kind != "adds_up" else None
    match rule.kind:
        case "one_of":
            return value.isin(*rule.others)
        case "between":
            return value.between(rule.others[0] - MARGIN, rule.others[1] + MARGIN)
        case "at_least":
            return value >= rule.others[0]
        case "at_most":
            limit = F.col(rule.others[0])
            return value <= (limit if rule.column.endswith("_start") else limit + MARGIN * F.greatest(F.abs(limit), F.lit(1)))
        case "covered_by":
            return value.isNull() == (F.col(rule.others[0]) == 0)
        case "adds_up":
            whole, *parts = map(F.col, rule.others)
            return whole == reduce(lambda added, part: added + part, parts)
        case "only_with":
            return F.col(rule.others[0]) | value.isNull()
    raise ValueError(rule.kind)


def broken(rule: Rule, where: Column | None = None) -> Column:
    """Number of rows (that ``where`` selects) without the rule."""
    wrong = ~F.coalesce(holds(rule), F.lit(True))
    return count_where(wrong if where is None else where & wrong)


def fault(rule: Rule) -> dict[str, str]:
    """Columns to set, and SQL of the values, so that a row without NULL in what is compared breaks the rule."""
    first = rule.others[0]
    match rule.kind:
        case "one_of":
            return {rule.column: "'other'" if isinstance(first, str) else "-1"}
        case "between":
            return {rule.column: f"{rule.others[1]} + 1"}
        case "at_least":
            return {rule.column: f"{first} - 1"}
        case "at_most":
            dates = rule.column.endswith("_start")
            return {rule.column: f"{first} + INTERVAL 1 DAY" if dates else f"{first} + 1"}
        case "covered_by":
            return {rule.column: f"CASE WHEN {first} = 0 THEN 1.0 END"}
        case "adds_up":
            return {rule.others[1]: f"{rule.others[1]} + 1"}
        case "only_with":
            return {first: "FALSE", rule.column: "1"}
    raise ValueError(rule.kind)


def with_faults(rows: DataFrame, rules: Sequence[Rule], where: Column) -> DataFrame:
    """``rows`` (``fault_rule`` NULL), and for each rule the rows that ``where`` selects, changed to break it."""
    copies = rows.where(where).withColumn("fault_rule", F.explode(F.array(*[F.lit(rule.name) for rule in rules])))
    changes: dict[str, Column] = {}
    for rule in rules:
        for name, value in fault(rule).items():
            kept = changes.get(name, F.col(name))
            new = F.expr(value).cast(rows.schema[name].dataType)
            changes[name] = F.when(F.col("fault_rule") == rule.name, new).otherwise(kept)
    return rows.withColumn("fault_rule", F.lit(None).cast("string")).unionByName(copies.withColumns(changes))


def write_checked(rows: DataFrame, path: str, counts: Mapping[str, Column]) -> dict[str, int]:
    """Write ``rows`` as Parquet and return the counts, taken in the same pass."""
    if not counts:
        rows.write.mode("overwrite").parquet(path)
        return {}
    # Metric names are columns of one row; positions keep names of any kind apart.
    observed = Observation()
    named = [column.alias(f"m{place}") for place, column in enumerate(counts.values())]
    rows.observe(observed, *named).write.mode("overwrite").parquet(path)
    found = observed.get
    return {name: found[f"m{place}"] for place, name in enumerate(counts)}


class ValueRuleError(ValueError):
    """Rows of a written table break rules; ``args`` are the table and the number of rows by rule."""


def write_valid(rows: DataFrame, path: str, table: str) -> None:
    """Write a stage table; rows that break one of its rules raise ``ValueRuleError`` after the write."""
    counts = write_checked(rows, path, {rule.name: broken(rule) for rule in value_rules(table, rows.columns)})
    bad = {name: number for name, number in counts.items() if number}
    if bad:
        raise ValueRuleError(table, bad)
