"""Data quality of stored months, and constraint checks over every stage table."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from themelens.constants import DIMENSIONS, LEADER_TYPES, PERIOD, THEME
from themelens.functions.numeric import count_where, is_close, total
from themelens.functions.text import normalize_genre
from themelens.operators.calendar import is_natural_month
from themelens.operators.presence import missing_keys, mixed_stamps, rule_counts
from themelens.operators.proxy import is_invalid_revenue

PROVENANCE = ("scope_country", "device_type", "category", "data_model")
LABEL_COLUMNS = ("game_theme", "game_genre", *DIMENSIONS, "earliest_release_date", "release_date_ww")
METADATA_COLUMNS = {"metadata": "_matched", "name": "name", "publisher": "publisher_display_name"}


def month_quality(
    snapshots: DataFrame,
    metadata: DataFrame,
    allowed_genres: Sequence[str],
    final_top_n: int,
    expected_provenance: Sequence[object],
    exclude_country: str | None = None,
) -> DataFrame:
    """Counts, duplicates, provenance, measure and label coverage per stored month.

    Distinct counts come from a first grouping by the counted key, so no month is collected in one place.
    """
    extra = metadata.select("unified_app_id", "name", "publisher_display_name", F.lit(True).alias("_matched"))
    rows = snapshots.join(extra, "unified_app_id", "left")
    genres = sorted({genre.strip().casefold() for genre in allowed_genres})
    expected = F.lit(True)
    for name, value in zip(PROVENANCE, expected_provenance):
        expected = expected & F.col(name).eqNullSafe(F.lit(value))
    bad_genre = ~F.coalesce(normalize_genre(F.col("game_genre")).isin(*genres), F.lit(False))
    excluded = (
        F.col("most_popular_country_by_revenue").eqNullSafe(F.lit(exclude_country))
        if exclude_country is not None
        else F.lit(False)
    )
    measures = {"downloads": F.col("units_absolute"), "revenue_usd": F.col("revenue_absolute")}
    counts = rows.groupBy(*PERIOD).agg(
        F.count(F.lit(1)).alias("snapshot_count"),
        F.max("rank_position").alias("_max_rank"),
        F.min("rank_position").alias("_min_rank"),
        count_where(~expected).alias("provenance_mismatch_count"),
        count_where(bad_genre).alias("_bad_genre"),
        count_where(excluded).alias("_excluded"),
        *[
            column
            for prefix, value in measures.items()
            for column in (
                F.count(value).alias(f"{prefix}_coverage_count"),
                count_where(value.isNull()).alias(f"{prefix}_null_count"),
                count_where(value == 0).alias(f"{prefix}_zero_count"),
                count_where(value < 0).alias(f"{prefix}_negative_count"),
                total(value).alias(f"{prefix}_sum"),
            )
        ],
        *[F.count(name).alias(f"{name}_coverage_count") for name in LABEL_COLUMNS],
        *[F.count(column).alias(f"{name}_coverage_count") for name, column in METADATA_COLUMNS.items()],
    )

    def distinct(columns: Sequence[str], name: str) -> DataFrame:
        return rows.select(*PERIOD, *columns).distinct().groupBy(*PERIOD).agg(F.count(F.lit(1)).alias(name))

    joined = (
        counts.join(distinct(["unified_app_id"], "unique_unified_app_count"), PERIOD)
        .join(distinct(["rank_position"], "unique_rank_count"), PERIOD)
        .join(distinct(PROVENANCE, "provenance_variant_count"), PERIOD)
    )
    size = F.col("snapshot_count")
    contiguous = (F.col("_min_rank") == 1) & (F.col("_max_rank") == F.col("unique_rank_count"))
    contiguous_full = contiguous & (F.col("unique_rank_count") == size)
    issues = [
        size == 0,
        size > final_top_n,
        F.col("unique_unified_app_count") != size,
        F.col("unique_rank_count") != size,
        ~contiguous_full,
        F.col("provenance_variant_count") != 1,
        F.col("cadence") != "monthly",
        ~is_natural_month(F.col("period_start"), F.col("period_end")),
        F.col("downloads_negative_count") > 0,
        F.col("revenue_usd_negative_count") > 0,
        F.col("_bad_genre") > 0,
        F.col("_excluded") > 0,
        F.col("provenance_mismatch_count") > 0,
    ]
    added = issues[0].cast("int")
    for issue in issues[1:]:
        added = added + issue.cast("int")
    covered = ("downloads", "revenue_usd", *LABEL_COLUMNS, *METADATA_COLUMNS)
    return joined.select(
        *PERIOD,
        F.lit("present").alias("status"),
        "snapshot_count",
        (size > final_top_n).alias("exceeds_configured_cap"),
        "unique_unified_app_count",
        (size - F.col("unique_unified_app_count")).alias("duplicate_unified_app_count"),
        "unique_rank_count",
        (size - F.col("unique_rank_count")).alias("duplicate_rank_count"),
        contiguous_full.alias("ranks_are_contiguous"),
        "provenance_variant_count",
        "provenance_mismatch_count",
        added.alias("structural_issue_count"),
        *[
            F.col(f"{prefix}_{part}")
            for prefix in measures
            for part in ("null_count", "zero_count", "negative_count", "sum")
        ],
        *[F.col(f"{name}_coverage_count") for name in covered],
        *[(F.col(f"{name}_coverage_count") / size).alias(f"{name}_coverage_ratio") for name in covered],
    )


def with_missing_months(quality: DataFrame, wanted: DataFrame) -> DataFrame:
    """One row per wanted period of a scope; those without data get zero counts and NULL ratios."""
    joined = wanted.select(*PERIOD).join(quality, PERIOD, "left")
    fills = {}
    for field in quality.schema.fields:
        if field.name.endswith("_count"):
            fills[field.name] = F.coalesce(F.col(field.name), F.lit(0))
        elif field.name in ("exceeds_configured_cap", "ranks_are_contiguous"):
            fills[field.name] = F.coalesce(F.col(field.name), F.lit(False))
    return joined.withColumns({**fills, "status": F.coalesce("status", F.lit("missing"))})


def range_summary(months: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Present and missing months, row statistics and whether the range is structurally complete."""
    present = F.col("status") == "present"
    rows = F.when(present, F.col("snapshot_count"))
    series = ["scope_name", "cadence"]
    variants = (
        snapshots.select(*series, *PROVENANCE)
        .distinct()
        .groupBy(*series)
        .agg(F.count(F.lit(1)).alias("provenance_variant_count"))
    )
    summary = months.groupBy(*series).agg(
        F.count(F.lit(1)).alias("requested_month_count"),
        count_where(present).alias("present_month_count"),
        count_where(~present).alias("missing_month_count"),
        F.sum("snapshot_count").alias("total_snapshot_count"),
        F.min(rows).alias("minimum_snapshot_count"),
        F.max(rows).alias("maximum_snapshot_count"),
        F.avg(rows).alias("average_snapshots"),
        F.sum("structural_issue_count").alias("structural_issue_count"),
        F.sum("provenance_mismatch_count").alias("_mismatches"),
    )
    complete = (
        (F.col("missing_month_count") == 0)
        & (F.col("structural_issue_count") == 0)
        & (F.col("provenance_variant_count") == 1)
        & (F.col("_mismatches") == 0)
    )
    return (
        summary.join(variants, series, "left")
        .withColumn("provenance_variant_count", F.coalesce("provenance_variant_count", F.lit(0)))
        .withColumn("structurally_complete", complete)
        .drop("_mismatches")
    )


def period_violations(
    snapshots: DataFrame, rows: Mapping[str, Column] | None = None, periods: Mapping[str, Column] | None = None
) -> DataFrame:
    """Periods that break a rule every aggregation relies on, with the number of offending rows; further rules of single
    ``rows`` and of ``periods`` (a condition over one row for each period) are counted in the same pass."""
    ids = snapshots.groupBy(*PERIOD, "unified_app_id").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > 1)
    ranks = snapshots.groupBy(*PERIOD, "rank_position").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > 1)

    def counted(df: DataFrame, rule: str) -> DataFrame:
        return df.groupBy(*PERIOD).agg(F.count(F.lit(1)).alias("row_count")).withColumn("rule", F.lit(rule))

    return (
        counted(ids, "duplicate_product")
        .unionByName(counted(ranks, "duplicate_rank"))
        .unionByName(_by_period(snapshots, rows or {}, periods or {}))
    )


def _by_period(snapshots: DataFrame, rows: Mapping[str, Column], periods: Mapping[str, Column]) -> DataFrame:
    """(period, rule, row_count) of all rules that need no more than one row, or the list of periods: one pass over the
    rows, which are combined by period and provenance before the shuffle."""
    conditions = {
        "not_a_natural_month": (F.col("cadence") != "monthly") | ~is_natural_month(F.col("period_start"), F.col("period_end")),
        "rank_not_positive": F.col("rank_position") <= 0,
        **rows,
    }
    variants = snapshots.groupBy(*PERIOD, *PROVENANCE).agg(*[count_where(c).alias(rule) for rule, c in conditions.items()])
    months = variants.groupBy(*PERIOD).agg(
        F.count(F.lit(1)).alias("_variants"), *[F.sum(rule).alias(rule) for rule in conditions]
    )
    of_period = {"mixed_provenance": F.col("_variants") > 1, **periods}
    months = months.withColumns({rule: F.when(wrong, F.lit(1)).otherwise(F.lit(0)).cast("long") for rule, wrong in of_period.items()})
    entries = [F.struct(F.lit(rule).alias("rule"), F.col(rule).alias("row_count")) for rule in (*conditions, *of_period)]
    return months.select(*PERIOD, F.explode(F.array(*entries)).alias("_r")).select(*PERIOD, "_r.*").where("row_count > 0")


class InvalidInputError(ValueError):
    """The stored snapshots break a rule; ``args[0]`` lists violations (scope, period, rule, rows)."""


def input_violations(snapshots: DataFrame) -> DataFrame:
    """(period, rule, row_count) of everything that scores, models, backtests and classes must not be computed from:
    a month missing before a stored one, the period rules, products without an id and invalid revenue."""

    series = Window.partitionBy("scope_name", "cadence").orderBy(F.unix_date("period_start"))
    previous = F.max("period_start").over(series.rangeBetween(Window.unboundedPreceding, -1))
    return period_violations(
        snapshots,
        {"product_without_id": F.col("unified_app_id").isNull(), "invalid_revenue": is_invalid_revenue()},
        {"month_before_missing": previous != F.add_months("period_start", -1)},
    ).select(*PERIOD, "rule", "row_count")


def _all(parts: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts).select("rule", "row_count")


def referential_checks(themes: DataFrame, structure: DataFrame, growth: DataFrame, dimensions: DataFrame, leaders: DataFrame) -> DataFrame:
    """Theme sets of all opportunity tables agree; leader ranks run 1..n up to three."""
    tables = {"themes": themes, "structure": structure, "growth": growth, "dimensions": dimensions, "leaders": leaders}
    ranks = leaders.groupBy(*THEME, "evidence_type").agg(
        F.count(F.lit(1)).alias("_n"), F.max("evidence_rank").alias("_max"), F.min("evidence_rank").alias("_min")
    )
    unknown = ~F.col("evidence_type").isin(*LEADER_TYPES)
    return _all(
        [
            missing_keys(
                tables,
                THEME,
                {
                    "theme_without_structure": ("themes", "structure"),
                    "structure_without_theme": ("structure", "themes"),
                    "theme_without_growth": ("themes", "growth"),
                    "growth_without_theme": ("growth", "themes"),
                    "dimension_without_theme": ("dimensions", "themes"),
                    "leader_without_theme": ("leaders", "themes"),
                },
            ),
            rule_counts(
                ranks,
                {"leader_ranks_not_contiguous": (F.col("_min") != 1) | (F.col("_max") != F.col("_n")) | (F.col("_max") > 3)},
            ),
            rule_counts(leaders, {"unknown_leader_type": unknown}),
        ]
    )


def model_checks(horizons: DataFrame, profiles: DataFrame, summaries: DataFrame, scores: DataFrame) -> DataFrame:
    """Horizon, season and score rows belong to a summary; a season profile is complete and averages one."""
    tables = {
        "horizons": horizons,
        "profiles": profiles,
        "summaries": summaries,
        "scores": scores,
        "history": summaries.where("has_6m_history"),
    }
    seasons = profiles.groupBy(*THEME, "metric_name").agg(
        F.count(F.lit(1)).alias("_n"),
        count_where(F.col("is_peak_month")).alias("_peaks"),
        count_where(F.col("is_trough_month")).alias("_troughs"),
        F.avg("seasonal_index").alias("_mean"),
    )
    return _all(
        [
            missing_keys(
                tables,
                THEME,
                {
                    "horizon_without_summary": ("horizons", "summaries"),
                    "season_without_summary": ("profiles", "summaries"),
                    "score_without_history": ("scores", "history"),
                    "history_without_score": ("history", "scores"),
                },
            ),
            rule_counts(
                seasons,
                {
                    "season_not_twelve_months": F.col("_n") != 12,
                    "season_without_one_peak_and_trough": (F.col("_peaks") != 1) | (F.col("_troughs") != 1),
                    "season_mean_not_one": ~is_close(F.col("_mean"), F.lit(1.0), 1e-9, 1e-9),
                },
            ),
        ]
    )


def backtest_checks(outcomes: DataFrame, features: DataFrame, totals: DataFrame, structure: DataFrame) -> DataFrame:
    """The registry is whole per scope; outcome months and decision theme months exist."""
    registry = features.groupBy("scope_name", "cadence").agg(F.count(F.lit(1)).alias("_n"))
    months = totals.select("scope_name", "cadence", F.col("period_start").alias("outcome_period_start"))
    decisions = structure.select(
        "scope_name", "cadence", F.col("period_start").alias("decision_period_start"), "game_theme"
    )
    shifted = F.add_months("decision_period_start", F.col("outcome_horizon_months"))
    tables = {"outcomes": outcomes, "months": months, "decisions": decisions}
    return _all(
        [
            rule_counts(registry, {"feature_registry_incomplete": F.col("_n") != 228}),
            *[
                missing_keys({"outcomes": outcomes, name: tables[name]}, tables[name].columns, {rule: ("outcomes", name)})
                for name, rule in (
                    ("months", "outcome_month_not_stored"),
                    ("decisions", "outcome_without_decision_theme"),
                )
            ],
            rule_counts(outcomes, {"outcome_month_not_at_horizon": F.col("outcome_period_start") != shifted}),
        ]
    )


def decision_checks(summaries: DataFrame, windows: DataFrame, risks: DataFrame, fits: DataFrame, migrations: DataFrame) -> DataFrame:
    """Unique decisions, three windows each, risks and migrations backed by their parents, one stamp for all tables.

    The stamp is checked over the tables that carry ``calculated_at``.
    """
    twice = summaries.groupBy(*THEME).agg(F.count(F.lit(1)).alias("_n"))
    per_theme = windows.groupBy(*THEME).agg(
        F.count(F.lit(1)).alias("_n"), F.min("horizon_months").alias("_a"), F.max("horizon_months").alias("_b")
    )
    part = [*THEME, "game_subgenre"]
    parts = {
        "sources": migrations.withColumnRenamed("validated_source_game_subgenre", "game_subgenre"),
        "targets": migrations.withColumnRenamed("target_observed_game_subgenre", "game_subgenre"),
        "validated": fits.where(F.col("fit_state") == "validated_fit"),
        "observed": fits.where(F.col("fit_state") == "observed_fit"),
    }
    stamped = [rows for rows in (summaries, windows, risks, fits, migrations) if "calculated_at" in rows.columns]
    return _all(
        [
            rule_counts(twice, {"duplicate_decision": F.col("_n") > 1}),
            rule_counts(
                per_theme, {"not_three_windows": (F.col("_n") != 3) | (F.col("_a") != 1) | (F.col("_b") != 3)}
            ),
            rule_counts(windows, {"window_marked_as_forecast": F.col("is_forecast")}),
            missing_keys(
                {"summaries": summaries, "windows": windows, "risks": risks},
                THEME,
                {
                    "decision_without_windows": ("summaries", "windows"),
                    "window_without_decision": ("windows", "summaries"),
                    "risk_without_decision": ("risks", "summaries"),
                },
            ),
            missing_keys(
                parts,
                part,
                {
                    "migration_source_not_validated": ("sources", "validated"),
                    "migration_target_not_observed": ("targets", "observed"),
                },
            ),
            *([mixed_stamps(stamped)] if stamped else []),
        ]
    )


def run_summary(totals: DataFrame, outputs: Mapping[str, DataFrame], dimensions: DataFrame) -> DataFrame:
    """Source, coverage and output row counts of one aggregation run as (name, row_count)."""
    sums = {
        "source_snapshots": "snapshot_count",
        "source_missing_theme": "theme_missing_count",
        "source_units_coverage": "units_absolute_coverage_count",
        "source_revenue_coverage": "revenue_absolute_coverage_count",
    }
    source = totals.agg(*[F.sum(column).alias(name) for name, column in sums.items()])
    entries = F.array(*[F.struct(F.lit(n).alias("name"), F.col(n).alias("row_count")) for n in sums])
    found = source.select(F.explode(entries).alias("_e")).select("_e.*")
    for name, table in outputs.items():
        found = found.unionByName(table.agg(F.count(F.lit(1)).alias("row_count")).withColumn("name", F.lit(name)))
    return found.unionByName(
        dimensions.groupBy(F.concat(F.lit("dimension_"), F.col("dimension_type")).alias("name")).agg(
            F.count(F.lit(1)).alias("row_count")
        )
    )
