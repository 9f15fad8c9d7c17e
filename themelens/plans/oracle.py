"""Reference SQL: the same results stated as plain joins and windows for DuckDB.

Each named block is one common table expression; a query lists the blocks it needs, in order of use.
"""

from __future__ import annotations

import re

from themelens.constants import (
    DIMENSIONS,
    FEATURES,
    MODEL_METRICS,
    OUTCOMES,
    SEGMENTS,
    SHARE_METRICS,
)

_INTEGER = re.compile(
    r"(_count(_\d+m)?|^rank_position|_rank_position|^evidence_rank|^leader_rank|trend_rank|momentum_rank|^calendar_month|_calendar_month|horizon_months|window_months"
    r"|^months_since_\w+|^active_months_\w+|^month_index|^batch_number|^position|^category|^response_id|^order_id|^part_id|_millis|_issues)$"
)
_OTHER = re.compile(
    r"^(scope_name|scope_country|cadence|game_\w+|device_type|data_model|\w+_start|\w+_end|\w+_id|is_\w+|has_\w+|direction_\d+m"
    r"|stability_band_\d+m|lifecycle_stage|exclusion_reason|legacy_exclusion_reason|legacy_is_actionable"
    r"|first_active_month|first_active_left_censored|\w+_policy_version|metric_name|feature_\w+|outcome_name"
    r"|segment_name|segment_value|low_sample_warning|\w+_change_direction|\w+_top_quintile|future_theme_present"
    r"|evidence_type|evidence_state|publisher_display_name|release_date_ww|\w+_decomposition_complete|dimension_\w+"
    r"|monetization_proxy|classification_reason|observable_revenue_state|\w+_band|\w+_state|category_fit_summary"
    r"|confidence|recommendation|\w+_code|\w+_references|risk_code|severity|evidence_availability|source_metric_name"
    r"|fit_state|evidence_limitations|\w+_game_subgenre|hypothesis_status|\w+_codes|requires_product_validation"
    r"|name|status|violation|\w+_key|distribution|value|month|compared_table|missing_table|table_name|stage_name|rule|source"
    r"|android_app_id|publisher_resolution_source|action|changed|ranks_are_contiguous|exceeds_configured_cap|structurally_complete)$"
)


def column_expression(name: str) -> str:
    if _INTEGER.search(name):
        return f"{name}::BIGINT AS {name}"
    if _OTHER.match(name):
        return name
    return f"floor({name}::DOUBLE * 1000000.0::DOUBLE + 0.5::DOUBLE) / 1000000.0::DOUBLE AS {name}"


#: Scopes of the test data, and the parameter of the scope that a query's text is computed for.
SCOPES = ("market", "niche")
SCOPE = "$scope"


def query(columns: str, tail: str, *blocks: str, merge: str = "", changed: str = "") -> str:
    """``columns`` (blank separated) of ``tail`` on top of the named blocks and everything they need.

    Results of the scopes are put together: all rows, or with ``merge`` the distinct ones or sums of ``row_count``.
    ``changed`` selects from ``{snap}``, the snapshots, what everything is computed from instead.
    """
    needed: list[str] = []

    def add(name: str) -> None:
        for other in BLOCKS:
            if other == name:
                break
            if other not in needed and re.search(rf"\b{other}\b", BLOCKS[name]):
                add(other)
        if name not in needed:
            needed.append(name)

    for name in blocks or [b for b in BLOCKS if re.search(rf"\b{b}\b", tail)]:
        add(name)
    texts = {name: BLOCKS[name] for name in needed}
    if changed:
        texts["snap"] = changed.format(snap=f"({texts['snap']})")
    ctes = ",\n".join(f"{name} AS MATERIALIZED ({text})" for name, text in texts.items())
    selected = ",\n  ".join(column_expression(c) for c in columns.split())
    if not needed:
        return f"SELECT {selected}\n{tail}"
    one = f"WITH {ctes}\nSELECT {selected}\n{tail}"
    if "snap" not in needed:
        return one
    # Scopes have nothing to do with each other, so the reference computes each alone.
    both = "\nUNION ALL\n".join(f"SELECT * FROM ({one.replace(SCOPE, f"'{scope}'")})" for scope in SCOPES)
    if merge == "distinct":
        return f"SELECT DISTINCT * FROM ({both})"
    if merge == "sum":
        rest = ", ".join(c for c in columns.split() if c != "row_count")
        return f"SELECT {rest}, sum(row_count)::BIGINT AS row_count FROM ({both}) GROUP BY ALL"
    return both


K = "scope_name, cadence, period_start, period_end"
KT = f"{K}, game_theme"
PERIOD_COLUMNS = K.replace(",", "")
THEME_COLUMNS = KT.replace(",", "")


def s(value: str) -> str:
    """Money and unit totals, rounded like the engine's."""
    return f"round(sum({value}), 6)"


BLOCKS: dict[str, str] = {}
BLOCKS["sold"] = """
  SELECT date_trunc('month', l_shipdate)::DATE AS period_start, l_partkey,
         round(sum(l_quantity), 2) AS units, round(sum(l_extendedprice), 2) AS revenue
  FROM lineitem WHERE (l_suppkey % 3 = 0) = ($scope = 'niche') GROUP BY 1, 2"""
BLOCKS["shipped"] = "SELECT l_partkey, min(l_shipdate)::DATE AS first_shipped, min(l_suppkey) AS s FROM lineitem GROUP BY 1"
BLOCKS["snap"] = """
  SELECT $scope AS scope_name, 'monthly' AS cadence, period_start, last_day(period_start) AS period_end,
    row_number() OVER (PARTITION BY period_start ORDER BY units DESC, k) AS rank_position,
    k::VARCHAR AS source_app_id, k::VARCHAR AS unified_app_id,
    'WW' AS scope_country, 'total' AS device_type, 7003 AS category, 'DM_2025_Q2' AS data_model,
    CASE WHEN shifted % 17 = 0 AND brand % 2 = 0 THEN NULL WHEN shifted % 23 = 0 THEN 0.0 ELSE units END AS units_absolute,
    CASE WHEN shifted % 13 = 0 AND brand % 3 = 0 THEN NULL WHEN shifted % 11 = 0 THEN 0.0 ELSE revenue END AS revenue_absolute,
    CASE WHEN k % 19 = 0 THEN NULL WHEN k % 29 = 0 THEN 'Unknown' WHEN shifted % 31 = 0 THEN 'N/A' ELSE p_brand END AS game_theme,
    CASE WHEN k % 50 = 49 THEN NULL WHEN k % 5 = 0 THEN ' Puzzle ' WHEN k % 5 = 1 THEN 'PUZZLE' WHEN k % 5 = 2 THEN 'strategy'
         WHEN k % 5 = 3 THEN 'Strategy' ELSE 'Arcade' END AS game_genre,
    CASE WHEN k % 13 <> 0 THEN p_type END AS game_subgenre,
    split_part(p_name, ' ', 2) AS game_product_model, split_part(p_name, ' ', 1) AS game_art_style,
    CASE WHEN k % 11 <> 0 THEN 'size-' || (p_size // 10)::VARCHAR END AS game_setting,
    CASE WHEN k % 9 <> 0 THEN first_shipped END AS earliest_release_date,
    CASE WHEN k % 7 = 0 THEN NULL WHEN k % 43 = 0 THEN (first_shipped + INTERVAL 120 MONTH)::DATE ELSE first_shipped END AS release_date_ww,
    CASE WHEN k % 37 = 0 THEN 'China' WHEN k % 3 = 0 THEN 'Japan' ELSE 'US' END AS most_popular_country_by_revenue
  FROM (SELECT sold.*, p.*, p_partkey AS k, p_partkey + year(period_start) * 12 + month(period_start) AS shifted,
               substr(p_brand, 7)::INT AS brand, first_shipped
        FROM sold JOIN part p ON l_partkey = p_partkey JOIN shipped USING (l_partkey))"""
BLOCKS["meta"] = """
  SELECT p_partkey::VARCHAR AS unified_app_id, CASE WHEN p_partkey % 47 <> 0 THEN p_name END AS name,
    CASE WHEN p_partkey % 23 <> 0 THEN s_name END AS publisher_display_name,
    CASE WHEN p_partkey % 23 <> 0 THEN 'publisher_name' ELSE 'unavailable' END AS publisher_resolution_source,
    CASE WHEN p_partkey % 2 = 0 THEN 'com.app.' || p_partkey END AS android_app_id,
    CASE WHEN p_partkey % 3 = 0 THEN p_partkey::VARCHAR END AS ios_app_id,
    TIMESTAMP '2001-12-31 00:00:00' - to_days((p_partkey % 30)::INT) AS fetched_at
  FROM part JOIN shipped ON l_partkey = p_partkey JOIN supplier ON s_suppkey = s WHERE p_partkey % 41 <> 0"""
BLOCKS["months"] = f"""
  SELECT m.*, p.period_start IS NOT NULL AS has_previous_month, row_number() OVER (ORDER BY m.period_start) AS month_index
  FROM (SELECT DISTINCT {K} FROM snap) m LEFT JOIN (SELECT DISTINCT period_start FROM snap) p
    ON p.period_start = m.period_start - INTERVAL 1 MONTH"""
BLOCKS["facts"] = """
  SELECT c.*, m.name AS game_name, m.publisher_display_name, m.unified_app_id IS NOT NULL AS has_metadata,
    months.has_previous_month, b.unified_app_id IS NOT NULL AS was_present, b.game_theme AS prev_theme,
    b.rank_position AS prev_rank, b.units_absolute AS prev_units, b.revenue_absolute AS prev_revenue,
    CASE WHEN months.has_previous_month THEN b.unified_app_id IS NULL END AS is_new
  FROM snap c LEFT JOIN meta m USING (unified_app_id)
  LEFT JOIN snap b ON b.unified_app_id = c.unified_app_id AND b.period_start = c.period_start - INTERVAL 1 MONTH
  JOIN months ON months.period_start = c.period_start"""
BLOCKS["totals"] = f"""
  SELECT {K}, count(*) AS snapshot_count, count(game_theme) AS theme_present_count,
    count(*) - count(game_theme) AS theme_missing_count, count(*) FILTER (has_metadata) AS metadata_coverage_count,
    count(units_absolute) AS units_absolute_coverage_count, {s('units_absolute')} AS units_absolute_sum,
    count(revenue_absolute) AS revenue_absolute_coverage_count, {s('revenue_absolute')} AS revenue_absolute_sum
  FROM facts GROUP BY {K}"""
BLOCKS["publishers"] = f"""
  SELECT {KT}, publisher_display_name, count(*) AS products, count(units_absolute) AS un, {s('units_absolute')} AS u,
    count(revenue_absolute) AS rn, {s('revenue_absolute')} AS r
  FROM facts WHERE game_theme IS NOT NULL AND publisher_display_name IS NOT NULL GROUP BY {KT}, publisher_display_name"""
BLOCKS["publisher_heads"] = f"""
  SELECT {KT}, sum(products) AS publisher_coverage_count, count(*) AS publisher_count,
    max(products) / sum(products)::DOUBLE AS top_publisher_product_share FROM publishers GROUP BY {KT}"""
BLOCKS["themes"] = f"""
  SELECT f.*, f.product_count / t.snapshot_count::DOUBLE AS product_share,
    f.units_absolute_sum / nullif(t.units_absolute_sum, 0) AS units_absolute_share,
    f.revenue_absolute_sum / nullif(t.revenue_absolute_sum, 0) AS revenue_absolute_share,
    CASE WHEN has_previous_month THEN n END AS new_entry_count,
    CASE WHEN has_previous_month THEN product_count - n END AS returning_product_count,
    CASE WHEN has_previous_month THEN n / product_count::DOUBLE END AS new_entry_share,
    coalesce(h.publisher_coverage_count, 0) AS publisher_coverage_count, coalesce(h.publisher_count, 0) AS publisher_count,
    h.top_publisher_product_share
  FROM (SELECT {KT}, count(*) AS product_count, count(*) FILTER (rank_position <= 100) AS top_100_count,
          count(*) FILTER (rank_position <= 500) AS top_500_count, avg(rank_position) AS average_rank,
          median(rank_position) AS median_rank, count(units_absolute) AS units_absolute_coverage_count,
          {s('units_absolute')} AS units_absolute_sum, count(revenue_absolute) AS revenue_absolute_coverage_count,
          {s('revenue_absolute')} AS revenue_absolute_sum, bool_or(has_previous_month) AS has_previous_month,
          count(*) FILTER (is_new) AS n
        FROM facts WHERE game_theme IS NOT NULL GROUP BY {KT}) f
  JOIN totals t USING ({K}) LEFT JOIN publisher_heads h USING ({KT})"""
_long = f"""
  SELECT {KT}, unified_app_id, rank_position, period_end AS pe, release_date_ww, 'downloads' AS measure, units_absolute AS v
  FROM facts WHERE game_theme IS NOT NULL AND units_absolute IS NOT NULL
  UNION ALL SELECT {KT}, unified_app_id, rank_position, period_end, release_date_ww, 'revenue_usd', revenue_absolute
  FROM facts WHERE game_theme IS NOT NULL AND revenue_absolute IS NOT NULL"""
BLOCKS["ordered"] = f"""
  SELECT *, row_number() OVER (PARTITION BY {KT}, measure ORDER BY v DESC, rank_position, unified_app_id) AS leader_rank,
    CASE WHEN release_date_ww <= pe THEN datediff('day', release_date_ww, pe) END AS age
  FROM ({_long})"""


def _top(prefix: str, k: int, measure: str = "measure", value: str = "v", rank: str = "leader_rank") -> str:
    own = f"{measure} = '{prefix}'"
    whole = f"round(sum({value}) FILTER ({own}), 6)"
    part = f"round(sum({value}) FILTER ({own} AND {rank} <= {k}), 6)"
    return f"CASE WHEN {whole} > 0 THEN {part} / {whole} END"


def _hhi(prefix: str, measure: str = "measure", value: str = "v") -> str:
    own = f"{measure} = '{prefix}'"
    whole = f"round(sum({value}) FILTER ({own}), 6)"
    return f"CASE WHEN {whole} > 0 THEN sum({value} * {value}) FILTER ({own}) / ({whole} * {whole}) END"


BLOCKS["product_stats"] = (
    f"SELECT {KT}, "
    + ", ".join(
        [f"{_top(m, k)} AS {m}_top_{k}_product_share" for m in ("downloads", "revenue_usd") for k in (1, 3, 10)]
        + [f"{_hhi(m)} AS {m}_product_hhi" for m in ("downloads", "revenue_usd")]
        + [f"median(v) FILTER (measure = '{m}') AS {m}_median_per_covered_product" for m in ("downloads", "revenue_usd")]
        + [
            f"median(age) FILTER (measure = '{m}' AND leader_rank <= 10) AS {m}_top_10_median_product_age_days"
            for m in ("downloads", "revenue_usd")
        ]
    )
    + f" FROM ordered GROUP BY {KT}"
)
BLOCKS["publisher_stats"] = (
    f"SELECT {KT}, "
    + ", ".join(
        [f"{_top(m, k)} AS top_{k}_publisher_{m}_share" for m in ("product", "downloads", "revenue_usd") for k in (1, 3)]
        + [f"{_hhi(m)} AS publisher_{m}_hhi" for m in ("product", "downloads", "revenue_usd")]
    )
    + f""" FROM (SELECT *, row_number() OVER (PARTITION BY {KT}, measure ORDER BY v DESC) AS leader_rank FROM (
      SELECT {KT}, 'product' AS measure, products::DOUBLE AS v FROM publishers
      UNION ALL SELECT {KT}, 'downloads', u FROM publishers WHERE u IS NOT NULL
      UNION ALL SELECT {KT}, 'revenue_usd', r FROM publishers WHERE r IS NOT NULL)) GROUP BY {KT}"""
)
BLOCKS["publisher_cover"] = f"""
  SELECT {KT}, sum(un) AS pdn, sum(rn) AS prn FROM publishers GROUP BY {KT}"""
BLOCKS["ages"] = f"""
  SELECT {KT}, count(release_date_ww) AS release_date_ww_coverage_count,
    count(release_date_ww) / count(*)::DOUBLE AS release_date_ww_coverage_ratio,
    count(*) FILTER (release_date_ww <= period_end) AS release_date_ww_valid_age_count,
    count(*) FILTER (release_date_ww > period_end) AS release_date_ww_future_count,
    median(datediff('day', release_date_ww, period_end)) FILTER (release_date_ww <= period_end) AS median_product_age_days
  FROM facts WHERE game_theme IS NOT NULL GROUP BY {KT}"""
BLOCKS["structure"] = f"""
  SELECT {', '.join('g.' + c for c in KT.split(', '))}, g.product_count, g.product_share, top_100_count, top_500_count, average_rank, median_rank,
    g.units_absolute_coverage_count AS downloads_coverage_count,
    g.units_absolute_coverage_count / product_count::DOUBLE AS downloads_coverage_ratio,
    g.units_absolute_sum AS downloads_sum,
    CASE WHEN t.units_absolute_sum > 0 THEN g.units_absolute_sum / t.units_absolute_sum END AS downloads_share,
    g.units_absolute_sum / nullif(g.units_absolute_coverage_count, 0) AS downloads_mean_per_covered_product,
    g.revenue_absolute_coverage_count AS revenue_usd_coverage_count,
    g.revenue_absolute_coverage_count / product_count::DOUBLE AS revenue_usd_coverage_ratio,
    g.revenue_absolute_sum AS revenue_usd_sum,
    CASE WHEN t.revenue_absolute_sum > 0 THEN g.revenue_absolute_sum / t.revenue_absolute_sum END AS revenue_usd_share,
    g.revenue_absolute_sum / nullif(g.revenue_absolute_coverage_count, 0) AS revenue_usd_mean_per_covered_product,
    ps.* EXCLUDE ({KT}), g.publisher_coverage_count, g.publisher_coverage_count / product_count::DOUBLE AS publisher_coverage_ratio,
    g.publisher_count, pb.* EXCLUDE ({KT}),
    coalesce(pdn, 0) AS publisher_downloads_coverage_count, coalesce(pdn, 0) / product_count::DOUBLE AS publisher_downloads_coverage_ratio,
    coalesce(prn, 0) AS publisher_revenue_usd_coverage_count, coalesce(prn, 0) / product_count::DOUBLE AS publisher_revenue_usd_coverage_ratio,
    a.* EXCLUDE ({KT})
  FROM themes g JOIN totals t USING ({K}) LEFT JOIN product_stats ps USING ({KT}) LEFT JOIN publisher_stats pb USING ({KT})
  LEFT JOIN publisher_cover pc USING ({KT}) JOIN ages a USING ({KT})"""
PRODUCT_COLUMNS = " ".join(
    [f"{m}_top_{k}_product_share" for m in ("downloads", "revenue_usd") for k in (1, 3, 10)]
)
STRUCTURE_COLUMNS = f"""{THEME_COLUMNS} product_count product_share top_100_count top_500_count average_rank median_rank
 {' '.join(f"{m}_coverage_count {m}_coverage_ratio {m}_sum {m}_share {m}_mean_per_covered_product {m}_median_per_covered_product {m}_product_hhi" for m in ("downloads", "revenue_usd"))}
 {PRODUCT_COLUMNS} publisher_coverage_count publisher_coverage_ratio publisher_count
 {' '.join(f"top_1_publisher_{m}_share top_3_publisher_{m}_share publisher_{m}_hhi" for m in ("product", "downloads", "revenue_usd"))}
 publisher_downloads_coverage_count publisher_downloads_coverage_ratio publisher_revenue_usd_coverage_count publisher_revenue_usd_coverage_ratio
 release_date_ww_coverage_count release_date_ww_coverage_ratio release_date_ww_valid_age_count release_date_ww_future_count
 median_product_age_days downloads_top_10_median_product_age_days revenue_usd_top_10_median_product_age_days"""

# Membership of a theme now or one month before, as a full outer join of the two months.
BLOCKS["pairs"] = f"""
  SELECT coalesce(c.period_start, p.next_start) AS period_start, coalesce(c.game_theme, p.game_theme) AS game_theme,
    c.unified_app_id IS NOT NULL AS now, p.unified_app_id IS NOT NULL AS was, coalesce(c.is_new, FALSE) AS is_new,
    c.rank_position AS cr, p.rank_position AS pr, c.units_absolute AS cu, p.units_absolute AS pu,
    c.revenue_absolute AS cv, p.revenue_absolute AS pv,
    CASE WHEN c.unified_app_id IS NULL THEN 0.0 ELSE c.units_absolute END AS cu0,
    CASE WHEN p.unified_app_id IS NULL THEN 0.0 ELSE p.units_absolute END AS pu0,
    CASE WHEN c.unified_app_id IS NULL THEN 0.0 ELSE c.revenue_absolute END AS cv0,
    CASE WHEN p.unified_app_id IS NULL THEN 0.0 ELSE p.revenue_absolute END AS pv0
  FROM (SELECT * FROM facts WHERE game_theme IS NOT NULL) c
  FULL OUTER JOIN (SELECT *, (period_start + INTERVAL 1 MONTH)::DATE AS next_start FROM snap WHERE game_theme IS NOT NULL) p
    ON c.unified_app_id = p.unified_app_id AND c.game_theme = p.game_theme AND c.period_start = p.next_start"""
BLOCKS["deltas"] = """
  SELECT *, round(cu0 - pu0, 6) AS du, round(cv0 - pv0, 6) AS dv,
    row_number() OVER (PARTITION BY period_start, game_theme ORDER BY round(cu0 - pu0, 6) DESC NULLS LAST) AS ku,
    row_number() OVER (PARTITION BY period_start, game_theme ORDER BY round(cv0 - pv0, 6) DESC NULLS LAST) AS kv
  FROM pairs"""


def _rate(part: str, whole: str) -> str:
    return f"{part} / nullif({whole}, 0)::DOUBLE"


def _growth_measure(prefix: str, c: str, p: str, d: str, k: str) -> list[str]:
    missing = f"count(*) FILTER ((now AND {c} IS NULL) OR (was AND {p} IS NULL))"
    usable = f"bool_or(has_previous_month) AND {missing} = 0"
    up = f"round(coalesce(sum({d}) FILTER ({d} > 0), 0), 6)"
    gain = f"greatest({d}, 0.0)"

    def part(condition: str, value: str = d) -> str:
        return f"round(coalesce(sum({value}) FILTER ({condition}), 0), 6)"

    def when(expression: str) -> str:
        return f"CASE WHEN {usable} THEN {expression} END"

    cur, prev = f"round(sum({c}), 6)", f"round(sum({p}), 6)"
    columns = {
        "current_coverage_count": f"count({c})",
        "previous_coverage_count": f"CASE WHEN bool_or(has_previous_month) THEN count({p}) END",
        "decomposition_complete": f"CASE WHEN bool_or(has_previous_month) THEN {missing} = 0 END",
        "current_sum": cur,
        "previous_sum": f"CASE WHEN bool_or(has_previous_month) THEN {prev} END",
        "mom_change": when(f"round(coalesce(sum({d}), 0), 6)"),
        "mom_growth_rate": when(f"CASE WHEN {prev} > 0 THEN round(sum({d}), 6) / {prev} END"),
        "market_new_entry_sum": when(part("now AND is_new")),
        "market_new_entry_share_of_current": when(f"CASE WHEN {cur} > 0 THEN {part('now AND is_new')} / {cur} END"),
        "theme_entry_contribution": when(part("now AND NOT was")),
        "continuing_contribution": when(part("now AND was")),
        "theme_exit_contribution": when(part("was AND NOT now")),
        "positive_contribution_sum": when(up),
        "negative_contribution_sum": when(part(f"{d} < 0")),
        "positive_contributor_count": when(f"count(*) FILTER ({d} > 0)"),
        "negative_contributor_count": when(f"count(*) FILTER ({d} < 0)"),
        "unchanged_contributor_count": when(f"count(*) FILTER ({d} = 0)"),
        "market_new_entry_positive_contribution_share": when(
            f"CASE WHEN {up} > 0 THEN {part('now AND is_new', gain)} / {up} END"
        ),
        "continuing_positive_contribution_share": when(
            f"CASE WHEN {up} > 0 THEN {part('now AND was', gain)} / {up} END"
        ),
    }
    for n in (1, 3, 10):
        columns[f"top_{n}_positive_contribution_share"] = when(
            f"CASE WHEN {up} > 0 THEN {part(f'{d} > 0 AND {k} <= {n}')} / {up} END"
        )
    return [f"{expression} AS {prefix}_{name}" for name, expression in columns.items()]


def _if_previous(expression: str) -> str:
    return f"CASE WHEN bool_or(has_previous_month) THEN {expression} END"


_new = "count(*) FILTER (now AND is_new)"
_now = "count(*) FILTER (now)"
_growth_columns = [
    f"{_if_previous('count(*) FILTER (was)')} AS previous_product_count",
    f"{_now} AS current_product_count",
    f"{_if_previous(_now + ' - count(*) FILTER (was)')} AS product_count_change",
    f"{_if_previous(_new)} AS market_new_entry_count",
    f"{_if_previous(_now + ' - ' + _new)} AS market_returning_product_count",
    f"{_if_previous('count(*) FILTER (now AND NOT was)')} AS theme_entry_count",
    f"{_if_previous('count(*) FILTER (was AND NOT now)')} AS theme_exit_count",
    f"{_if_previous('count(*) FILTER (now AND was)')} AS continuing_theme_product_count",
    f"{_if_previous(_rate(_new, _now))} AS market_new_entry_share",
    f"{_if_previous(_rate('count(*) FILTER (now AND NOT was)', _now))} AS theme_entry_share",
]
for _t in (100, 500):
    _hit = f"count(*) FILTER (now AND is_new AND cr <= {_t})"
    _in = f"count(*) FILTER (coalesce(cr <= {_t}, FALSE) AND NOT coalesce(pr <= {_t}, FALSE))"
    _growth_columns += [
        f"{_if_previous(_hit)} AS market_new_entry_top_{_t}_count",
        f"{_if_previous(_rate(_hit, _new))} AS market_new_entry_top_{_t}_rate",
        f"count(*) FILTER (cr <= {_t}) AS top_{_t}_current_count",
        f"{_if_previous(f'count(*) FILTER (pr <= {_t})')} AS top_{_t}_previous_count",
        f"{_if_previous(_in)} AS top_{_t}_entry_count",
        f"{_if_previous(f'count(*) FILTER (coalesce(pr <= {_t}, FALSE) AND NOT coalesce(cr <= {_t}, FALSE))')} AS top_{_t}_exit_count",
        f"{_if_previous(f'count(*) FILTER (cr <= {_t} AND pr <= {_t})')} AS top_{_t}_retained_count",
        f"{_if_previous(_rate(_in, f'count(*) FILTER (cr <= {_t})'))} AS top_{_t}_turnover_rate",
    ]
BLOCKS["retention"] = f"""
  SELECT c.game_theme, c.period_start, {', '.join(
      f"count(*) FILTER (c.measure = '{m}') AS {m}_now, count(*) FILTER (c.measure = '{m}' AND p.unified_app_id IS NOT NULL) AS {m}_kept"
      for m in ('downloads', 'revenue_usd'))}
  FROM (SELECT * FROM ordered WHERE leader_rank <= 10) c LEFT JOIN (SELECT * FROM ordered WHERE leader_rank <= 10) p
    ON p.game_theme = c.game_theme AND p.measure = c.measure AND p.unified_app_id = c.unified_app_id
   AND p.period_start = c.period_start - INTERVAL 1 MONTH
  GROUP BY 1, 2"""
BLOCKS["growth"] = f"""
  SELECT g.*, {', '.join(
      f"coalesce({m}_now, 0) AS {m}_top_10_current_count, CASE WHEN has_previous_month THEN coalesce({m}_kept, 0) END AS {m}_top_10_retained_count,"
      f" CASE WHEN has_previous_month THEN {_rate(f'coalesce({m}_kept, 0)', f'{m}_now')} END AS {m}_top_10_retention_rate"
      for m in ('downloads', 'revenue_usd'))}
  FROM (SELECT m.scope_name, m.cadence, d.period_start, m.period_end, d.game_theme, bool_or(has_previous_month) AS has_previous_month,
          {', '.join(_growth_columns + _growth_measure('downloads', 'cu', 'pu', 'du', 'ku') + _growth_measure('revenue_usd', 'cv', 'pv', 'dv', 'kv'))}
        FROM deltas d JOIN months m USING (period_start) GROUP BY 1, 2, 3, 4, 5 HAVING {_now} > 0) g
  LEFT JOIN retention r USING (game_theme, period_start)"""
BLOCKS["labelled"] = "\n UNION ALL ".join(
    f"SELECT *, '{d}' AS dimension_type, {d} AS dimension_value FROM facts WHERE game_theme IS NOT NULL AND {d} IS NOT NULL"
    for d in DIMENSIONS
)
KD = f"{KT}, dimension_type, dimension_value"
BLOCKS["label_publishers"] = f"""
  SELECT {KD}, sum(n) AS pc, count(*) AS pn, max(n) / sum(n)::DOUBLE AS ps
  FROM (SELECT {KD}, publisher_display_name, count(*) AS n FROM labelled WHERE publisher_display_name IS NOT NULL
        GROUP BY {KD}, publisher_display_name) GROUP BY {KD}"""


def _dimension_measure(prefix: str, column: str) -> str:
    return f"""count({column}) AS {prefix}_coverage_count, {s(column)} AS {prefix}_sum,
      {s(column)} / nullif(count({column}), 0) AS {prefix}_mean_per_covered_product,
      median({column}) AS {prefix}_median_per_covered_product,
      CASE WHEN {s(column)} > 0 THEN max({column}) / {s(column)} END AS {prefix}_top_1_product_share"""


BLOCKS["dims"] = f"""
  SELECT d.*, d.product_count / g.product_count::DOUBLE AS product_share_within_theme,
    d.product_count / t.snapshot_count::DOUBLE AS product_share_within_market,
    downloads_sum / nullif(g.units_absolute_sum, 0) AS downloads_share_within_theme,
    downloads_sum / nullif(t.units_absolute_sum, 0) AS downloads_share_within_market,
    revenue_usd_sum / nullif(g.revenue_absolute_sum, 0) AS revenue_usd_share_within_theme,
    revenue_usd_sum / nullif(t.revenue_absolute_sum, 0) AS revenue_usd_share_within_market,
    coalesce(pc, 0) AS publisher_coverage_count, coalesce(pn, 0) AS publisher_count, ps AS top_1_publisher_product_share
  FROM (SELECT {KD}, count(*) AS product_count, count(*) FILTER (rank_position <= 100) AS top_100_count,
      count(*) FILTER (rank_position <= 500) AS top_500_count, avg(rank_position) AS average_rank, median(rank_position) AS median_rank,
      {_dimension_measure('downloads', 'units_absolute')}, {_dimension_measure('revenue_usd', 'revenue_absolute')},
      bool_or(has_previous_month) AS has_previous_month,
      {_if_previous('count(*) FILTER (is_new)')} AS market_new_entry_count,
      {_if_previous('count(*) FILTER (is_new) / count(*)::DOUBLE')} AS market_new_entry_share,
      {', '.join(f"{_if_previous(f'count(*) FILTER (is_new AND rank_position <= {t})')} AS market_new_entry_top_{t}_count, "
                 f"{_if_previous(_rate(f'count(*) FILTER (is_new AND rank_position <= {t})', 'count(*) FILTER (is_new)'))} AS market_new_entry_top_{t}_rate"
                 for t in (100, 500))}
    FROM labelled GROUP BY {KD}) d
  JOIN themes g USING ({KT}) JOIN totals t USING ({K}) LEFT JOIN label_publishers lp USING ({KD})"""
BLOCKS["product_rows"] = f"""
  SELECT {KT}, source_app_id, unified_app_id, game_name, publisher_display_name, {', '.join(DIMENSIONS)}, release_date_ww,
    rank_position, prev_rank AS previous_rank_position, units_absolute AS downloads, pd AS previous_downloads,
    round(units_absolute - pd, 6) AS downloads_change, revenue_absolute AS revenue_usd, pv AS previous_revenue_usd,
    round(revenue_absolute - pv, 6) AS revenue_usd_change, is_new AS is_market_new_entry,
    CASE WHEN has_previous_month THEN NOT coalesce(was_present AND prev_theme = game_theme, FALSE) END AS is_theme_entry
  FROM (SELECT *, CASE WHEN was_present THEN prev_units WHEN has_previous_month THEN 0.0 END AS pd,
          CASE WHEN was_present THEN prev_revenue WHEN has_previous_month THEN 0.0 END AS pv FROM facts WHERE game_theme IS NOT NULL)"""
_kinds = (
    ("downloads_leader", "downloads", "TRUE"),
    ("revenue_leader", "revenue_usd", "TRUE"),
    ("market_new_entry_downloads_leader", "downloads", "is_market_new_entry"),
    ("market_new_entry_revenue_leader", "revenue_usd", "is_market_new_entry"),
    ("downloads_growth_leader", "downloads_change", "downloads_change > 0"),
    ("revenue_growth_leader", "revenue_usd_change", "revenue_usd_change > 0"),
)
BLOCKS["leaders"] = "\n UNION ALL ".join(
    f"""SELECT * FROM (SELECT *, '{kind}' AS evidence_type,
      row_number() OVER (PARTITION BY {KT} ORDER BY {value} DESC, rank_position, unified_app_id) AS evidence_rank
    FROM product_rows WHERE {value} IS NOT NULL AND {condition}) WHERE evidence_rank <= 3"""
    for kind, value, condition in _kinds
)
LEADER_COLUMNS = (
    f"{THEME_COLUMNS} source_app_id unified_app_id game_name publisher_display_name {' '.join(DIMENSIONS)} release_date_ww rank_position"
    " previous_rank_position downloads previous_downloads downloads_change revenue_usd previous_revenue_usd revenue_usd_change"
    " is_market_new_entry is_theme_entry"
)

# Six-month score.
BLOCKS["cells"] = """
  SELECT m.scope_name, m.cadence, m.period_start, m.period_end, m.month_index, n.game_theme, g.game_theme IS NOT NULL AS present,
    coalesce(g.product_count, 0) AS pc, CASE WHEN g.game_theme IS NULL THEN 0.0 ELSE g.product_share END AS ps,
    CASE WHEN g.game_theme IS NULL THEN CASE WHEN t.units_absolute_sum <> 0 THEN 0.0 END ELSE g.units_absolute_share END AS us,
    CASE WHEN g.game_theme IS NULL THEN CASE WHEN t.revenue_absolute_sum <> 0 THEN 0.0 END ELSE g.revenue_absolute_share END AS rs,
    CASE WHEN g.game_theme IS NULL THEN 0.0 ELSE g.new_entry_share END AS ns,
    coalesce(g.units_absolute_coverage_count, 0) AS uc, coalesce(g.revenue_absolute_coverage_count, 0) AS rc,
    g.median_rank, g.publisher_count, g.publisher_coverage_count, g.top_publisher_product_share
  FROM months m JOIN totals t USING (period_start) JOIN (SELECT DISTINCT game_theme FROM themes) n ON TRUE
  LEFT JOIN themes g ON g.period_start = m.period_start AND g.game_theme = n.game_theme"""


def _gain(x: str) -> str:
    return f"({x}2 + {x}1 + {x}) / 3 - ({x}5 + {x}4 + {x}3) / 3"


_lags = ", ".join(f"lag({x}, {n}) OVER w AS {x}{n}" for x in ("ps", "us", "rs", "ns") for n in range(1, 6))
BLOCKS["features"] = f"""
  SELECT scope_name, cadence, period_start, period_end, game_theme, (period_start - INTERVAL 5 MONTH)::DATE AS window_start,
    6 AS window_month_count, active AS active_months_6m, pc AS latest_product_count, ps AS latest_product_share,
    us AS latest_units_absolute_share, rs AS latest_revenue_absolute_share, ns AS latest_new_entry_share,
    median_rank AS latest_median_rank, publisher_count AS latest_publisher_count,
    top_publisher_product_share AS latest_top_publisher_product_share,
    {_gain('ps')} AS product_share_gain_3m, {_gain('us')} AS units_absolute_share_gain_3m, {_gain('rs')} AS revenue_absolute_share_gain_3m,
    (ps - ps2) / 2 - (ps3 - ps5) / 2 AS product_share_acceleration, (us - us2) / 2 - (us3 - us5) / 2 AS units_absolute_share_acceleration,
    (rs - rs2) / 2 - (rs3 - rs5) / 2 AS revenue_absolute_share_acceleration, (ns2 + ns1 + ns) / 3 AS recent3_new_entry_share,
    prior_rank - recent_rank AS median_rank_improvement, recent_pub - prior_pub AS publisher_count_gain_3m,
    us / nullif(ps, 0) AS units_absolute_overindex, rs / nullif(ps, 0) AS revenue_absolute_overindex,
    coalesce(uc3 / nullif(pc3, 0)::DOUBLE, 0) AS recent3_units_coverage_ratio,
    coalesce(rc3 / nullif(pc3, 0)::DOUBLE, 0) AS recent3_revenue_coverage_ratio,
    publisher_coverage_count / pc::DOUBLE AS latest_publisher_coverage_ratio
  FROM (SELECT *, {_lags}, count(*) FILTER (present) OVER (w ROWS 5 PRECEDING) AS active,
          avg(median_rank) OVER (w ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS recent_rank,
          avg(median_rank) OVER (w ROWS BETWEEN 5 PRECEDING AND 3 PRECEDING) AS prior_rank,
          avg(publisher_count) OVER (w ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS recent_pub,
          avg(publisher_count) OVER (w ROWS BETWEEN 5 PRECEDING AND 3 PRECEDING) AS prior_pub,
          sum(pc) OVER (w ROWS 2 PRECEDING) AS pc3, sum(uc) OVER (w ROWS 2 PRECEDING) AS uc3, sum(rc) OVER (w ROWS 2 PRECEDING) AS rc3
        FROM cells WINDOW w AS (PARTITION BY game_theme ORDER BY period_start))
  WHERE present AND month_index >= 6"""
BLOCKS["eligible"] = """
  SELECT *, exclusion_reason IS NULL AS is_actionable,
    100.0 * (0.25 * (active_months_6m / 6.0::DOUBLE) + 0.25 * least(latest_product_count / 20.0::DOUBLE, 1.0) + 0.2 * recent3_units_coverage_ratio
      + 0.2 * recent3_revenue_coverage_ratio + 0.1 * latest_publisher_coverage_ratio)::DOUBLE AS confidence_score
  FROM (SELECT *, CASE WHEN game_theme IN ('', 'Unknown', 'N/A') THEN 'non_actionable_source_label'
      WHEN latest_product_count < 5 THEN 'insufficient_latest_product_count' WHEN active_months_6m < 3 THEN 'insufficient_active_history'
      WHEN latest_product_share IS NULL OR recent3_new_entry_share IS NULL THEN 'insufficient_metric_coverage' END AS exclusion_reason
    FROM features)"""


def percentile(value: str, cohort: str, scale: float, condition: str = "TRUE") -> str:
    """Average-rank percentile as a correlated count over the cohort; values compared at 12 decimals."""
    v = f"round({value}, 12)"
    part = f"PARTITION BY {cohort}, ({value} IS NOT NULL AND {condition})"
    n = f"count(*) OVER ({part})"
    rank = f"(rank() OVER ({part} ORDER BY {v}) + (count(*) OVER ({part}, {v}) - 1) / 2.0::DOUBLE)"
    return (
        f"CASE WHEN {value} IS NOT NULL AND {condition} THEN CASE WHEN {n} = 1 THEN {scale / 2}::DOUBLE "
        f"ELSE {scale}::DOUBLE * ({rank} - 1) / ({n} - 1) END END"
    )


_pct = {
    "g1": "product_share_gain_3m",
    "g2": "units_absolute_share_gain_3m",
    "g3": "revenue_absolute_share_gain_3m",
    "a1": "product_share_acceleration",
    "a2": "units_absolute_share_acceleration",
    "a3": "revenue_absolute_share_acceleration",
    "n1": "recent3_new_entry_share",
    "c1": "latest_product_share",
    "c2": "latest_top_publisher_product_share",
}
BLOCKS["percentiles"] = (
    "SELECT *, "
    + ", ".join(f"{percentile(c, 'period_start', 100.0, 'is_actionable')} AS pct_{c}" for c in _pct.values())
    + " FROM eligible"
)


def _mean(*names: str) -> str:
    added = " + ".join(f"coalesce({n}, 0)" for n in names)
    count = " + ".join(f"({n} IS NOT NULL)::INT" for n in names)
    return f"({added}) / nullif({count}, 0)"


BLOCKS["scores"] = f"""
  SELECT * EXCLUDE (raw), CASE WHEN is_actionable THEN row_number() OVER (PARTITION BY period_start, is_actionable
      ORDER BY round(trend_score, 12) DESC, round(base_trend_score, 12) DESC, round(confidence_score, 12) DESC, game_theme) END AS trend_rank
  FROM (SELECT *, base_trend_score * confidence_score / 100.0::DOUBLE AS trend_score
    FROM (SELECT *, CASE WHEN raw IS NOT NULL THEN greatest(0.0, least(100.0, raw))::DOUBLE END AS base_trend_score
      FROM (SELECT *, 0.45::DOUBLE * growth_score + 0.3::DOUBLE * acceleration_score + 0.25::DOUBLE * new_product_score
                - 0.2::DOUBLE * concentration_penalty AS raw
        FROM (SELECT *, {_mean('pct_product_share_gain_3m', 'pct_units_absolute_share_gain_3m', 'pct_revenue_absolute_share_gain_3m')} AS growth_score,
          {_mean('pct_product_share_acceleration', 'pct_units_absolute_share_acceleration', 'pct_revenue_absolute_share_acceleration')} AS acceleration_score,
          pct_recent3_new_entry_share AS new_product_score,
          {_mean('pct_latest_product_share', 'pct_latest_top_publisher_product_share')} AS concentration_penalty FROM percentiles))))"""
FEATURE_COLUMNS = (
    f"{THEME_COLUMNS} window_start window_month_count active_months_6m latest_product_count latest_product_share"
    " latest_units_absolute_share latest_revenue_absolute_share latest_new_entry_share latest_median_rank latest_publisher_count"
    " latest_top_publisher_product_share product_share_gain_3m units_absolute_share_gain_3m revenue_absolute_share_gain_3m"
    " product_share_acceleration units_absolute_share_acceleration revenue_absolute_share_acceleration recent3_new_entry_share"
    " median_rank_improvement publisher_count_gain_3m units_absolute_overindex revenue_absolute_overindex"
    " recent3_units_coverage_ratio recent3_revenue_coverage_ratio latest_publisher_coverage_ratio"
)
SCORE_COLUMNS = (
    FEATURE_COLUMNS + " exclusion_reason is_actionable confidence_score growth_score acceleration_score new_product_score"
    " concentration_penalty base_trend_score trend_score trend_rank"
)

# Multi-horizon model.
BLOCKS["model_cells"] = f"""
  SELECT m.scope_name, m.cadence, m.period_start, m.period_end, m.month_index, n.game_theme, g.game_theme IS NOT NULL AS present,
    {', '.join(f"CASE WHEN g.game_theme IS NULL THEN 0.0 ELSE g.{c}::DOUBLE END AS {c}" for c in MODEL_METRICS)}
  FROM months m JOIN (SELECT DISTINCT game_theme FROM structure) n ON TRUE
  LEFT JOIN structure g ON g.period_start = m.period_start AND g.game_theme = n.game_theme"""
BLOCKS["activity"] = """
  SELECT game_theme, period_start, present, month_index, count(*) FILTER (product_count > 0) OVER w AS active_months_to_date,
    min(period_start) FILTER (product_count > 0) OVER w AS first_active_month, min(period_start) OVER w AS history_start,
    count(*) FILTER (product_count > 0) OVER (w ROWS 5 PRECEDING) AS a6, count(*) FILTER (product_count > 0) OVER (w ROWS 11 PRECEDING) AS a12,
    count(*) FILTER (product_count > 0) OVER (w ROWS 35 PRECEDING) AS a36
  FROM model_cells WINDOW w AS (PARTITION BY game_theme ORDER BY month_index)"""
BLOCKS["series"] = "\n UNION ALL ".join(
    f"SELECT {KT}, month_index, present, '{m}' AS metric_name, {m} AS v FROM model_cells" for m in MODEL_METRICS
)
BLOCKS["spans"] = """
  SELECT t.scope_name, t.cadence, t.period_start, t.period_end, t.game_theme, t.metric_name, t.month_index AS target, h.h, x.month_index AS i, x.v,
    x.period_start AS month, lag(x.v) OVER (PARTITION BY t.game_theme, t.metric_name, t.month_index, h.h ORDER BY x.month_index) AS pv,
    max(x.v) OVER (PARTITION BY t.game_theme, t.metric_name, t.month_index, h.h ORDER BY x.month_index) AS peak
  FROM series t JOIN (SELECT unnest([6, 12, 36]) AS h) h ON t.month_index >= h.h
  JOIN series x ON x.game_theme = t.game_theme AND x.metric_name = t.metric_name AND x.month_index BETWEEN t.month_index - h.h + 1 AND t.month_index
  WHERE t.present"""


def close(a: str, b: str) -> str:
    return f"(abs({a} - {b}) <= greatest(1e-9 * greatest(abs({a}), abs({b})), 1e-12))"


_same = close("v", "pv")
BLOCKS["horizons"] = f"""
  SELECT s.*, CASE h WHEN 6 THEN a6 WHEN 12 THEN a12 ELSE a36 END AS active_month_count, h AS horizon_month_count, h AS expected_month_count,
    h - 1 AS transition_count, n AS metric_coverage_count, n = h AS is_complete, up + down + flat AS transition_coverage_count,
    up AS positive_change_count, down AS negative_change_count, flat AS unchanged_change_count,
    up / nullif(up + down + flat, 0)::DOUBLE AS positive_change_ratio,
    CASE WHEN n = h THEN latest_value - first_value END AS absolute_change,
    CASE WHEN n = h AND first_value > 0 THEN (latest_value - first_value) / first_value END AS relative_change,
    CASE WHEN n = h THEN slope END AS linear_slope, CASE WHEN n = h AND mean_value > 0 THEN slope / mean_value END AS normalized_slope,
    CASE WHEN n = h AND minimum_value <> maximum_value THEN fit END AS r_squared,
    CASE WHEN n = h AND mean_value > 0 THEN latest_value / mean_value END AS latest_to_mean_ratio,
    CASE WHEN n = h AND mean_value > 0 THEN standard_deviation / mean_value END AS coefficient_of_variation,
    CASE WHEN n = h THEN least(1.0, greatest(0.0, coalesce(drawdown, 0.0)))::DOUBLE END AS maximum_drawdown,
    CASE WHEN n = h THEN target - peak_index END AS months_since_peak
  FROM (SELECT {KT}, metric_name, target, h, min(month) AS window_start, count(v) AS n, avg(v) AS mean_value, median(v) AS median_value,
      min(v) AS minimum_value, max(v) AS maximum_value,
      CASE WHEN min(v) = max(v) THEN 0.0 ELSE stddev_pop(v) END AS standard_deviation,
      max(CASE WHEN i = target - h + 1 THEN v END) AS first_value, max(CASE WHEN i = target THEN v END) AS latest_value,
      CASE WHEN min(v) = max(v) THEN 0.0 ELSE regr_slope(v, i) END AS slope, CASE WHEN min(v) <> max(v) THEN round(regr_r2(v, i), 12) END AS fit,
      max(CASE WHEN peak > 0 THEN (peak - v) / peak END) AS drawdown,
      arg_max(i, (v, i)) FILTER (v IS NOT NULL) AS peak_index,
      count(*) FILTER (v IS NOT NULL AND pv IS NOT NULL AND {_same}) AS flat,
      count(*) FILTER (v IS NOT NULL AND pv IS NOT NULL AND NOT {_same} AND v > pv) AS up,
      count(*) FILTER (v IS NOT NULL AND pv IS NOT NULL AND NOT {_same} AND v < pv) AS down
    FROM spans GROUP BY {KT}, metric_name, target, h) s
  JOIN activity a ON a.game_theme = s.game_theme AND a.month_index = s.target"""
HORIZON_COLUMNS = (
    f"{THEME_COLUMNS} metric_name horizon_month_count window_start expected_month_count metric_coverage_count active_month_count"
    " is_complete first_value latest_value mean_value median_value minimum_value maximum_value absolute_change relative_change"
    " linear_slope normalized_slope r_squared latest_to_mean_ratio transition_count transition_coverage_count positive_change_count"
    " negative_change_count unchanged_change_count positive_change_ratio standard_deviation coefficient_of_variation maximum_drawdown"
    " months_since_peak"
)
BLOCKS["evidence"] = f"""
  SELECT {KT}, h AS horizon_month_count, active_months, direction_evidence_count, median_normalized_slope, median_r_squared, stability_cv_median,
    CASE WHEN direction_evidence_count < 2 THEN 'insufficient_history' WHEN up >= 2 THEN 'up' WHEN down >= 2 THEN 'down'
         WHEN flat >= 2 THEN 'flat' ELSE 'mixed' END AS direction,
    CASE WHEN cvs < 2 THEN 'insufficient_history' WHEN stability_cv_median <= 0.15 THEN 'stable' WHEN stability_cv_median <= 0.35 THEN 'variable'
         ELSE 'volatile' END AS stability_band
  FROM (SELECT {KT}, h, max(active_month_count) AS active_months, count(normalized_slope) AS direction_evidence_count,
      count(*) FILTER (abs(normalized_slope) < 0.005) AS flat,
      count(*) FILTER (abs(normalized_slope) >= 0.005 AND r_squared >= 0.2 AND normalized_slope > 0) AS up,
      count(*) FILTER (abs(normalized_slope) >= 0.005 AND r_squared >= 0.2 AND normalized_slope < 0) AS down,
      median(normalized_slope) AS median_normalized_slope, median(r_squared) AS median_r_squared,
      count(coefficient_of_variation) AS cvs, median(coefficient_of_variation) AS stability_cv_median
    FROM horizons WHERE metric_name IN ({', '.join(repr(m) for m in SHARE_METRICS)}) GROUP BY {KT}, h)"""
BLOCKS["season_months"] = """
  SELECT t.scope_name, t.cadence, t.period_start, t.period_end, t.game_theme, t.metric_name, t.years,
    (x.month_index - (t.month_index - 12 * t.years + 1)) // 12 AS block, x.v, month(x.period_start) AS calendar_month, x.period_start AS month
  FROM (SELECT *, least(3, month_index // 12) AS years FROM series WHERE present AND month_index >= 24) t
  JOIN series x ON x.game_theme = t.game_theme AND x.metric_name = t.metric_name AND x.month_index BETWEEN t.month_index - 12 * t.years + 1 AND t.month_index"""
BLOCKS["season_blocks"] = f"""
  SELECT {KT}, metric_name, block, sum(v) / 12 AS block_mean FROM season_months GROUP BY {KT}, metric_name, block
  HAVING count(v) = 12 AND sum(v) > 0"""
BLOCKS["season"] = f"""
  SELECT *, row_number() OVER (PARTITION BY {KT}, metric_name ORDER BY round(seasonal_index, 12) DESC, calendar_month) = 1 AS is_peak_month,
    row_number() OVER (PARTITION BY {KT}, metric_name ORDER BY round(seasonal_index, 12), calendar_month) = 1 AS is_trough_month,
    seasonal_index - 1 AS index_deviation, years * 12 AS history_month_count, years AS complete_year_count,
    (period_start - to_months((years * 12 - 1)::INT))::DATE AS history_start
  FROM (SELECT {KT}, metric_name, calendar_month, years, count(*) AS observation_count, avg(v / block_mean) AS seasonal_index
        FROM season_months JOIN season_blocks USING ({KT}, metric_name, block) GROUP BY {KT}, metric_name, calendar_month, years)
  WHERE observation_count >= 2"""
BLOCKS["season_heads"] = f"""
  SELECT {KT}, {', '.join(
      f"max(calendar_month) FILTER (metric_name = '{m}_sum' AND is_peak_month) AS {m}_peak_calendar_month,"
      f" max(calendar_month) FILTER (metric_name = '{m}_sum' AND is_trough_month) AS {m}_trough_calendar_month,"
      f" max(seasonal_index) FILTER (metric_name = '{m}_sum') - min(seasonal_index) FILTER (metric_name = '{m}_sum') AS {m}_seasonality_amplitude"
      for m in ('downloads', 'revenue_usd'))}
  FROM season WHERE metric_name IN ('downloads_sum', 'revenue_usd_sum') GROUP BY {KT}"""
_joined = " ".join(
    f"LEFT JOIN evidence e{h} ON e{h}.period_start = a.period_start AND e{h}.game_theme = a.game_theme AND e{h}.horizon_month_count = {h}"
    for h in (6, 12, 36)
)
BLOCKS["summaries"] = f"""
  SELECT *, CASE WHEN direction_12m = 'insufficient_history' THEN 'insufficient_history'
      WHEN NOT first_active_left_censored AND months_since_first_active < 12 AND direction_6m = 'up' THEN 'emerging'
      WHEN direction_6m = 'up' AND direction_12m = 'up' AND median_normalized_slope_6m >= median_normalized_slope_12m + 0.005::DOUBLE THEN 'accelerating'
      WHEN direction_6m = 'up' AND direction_12m IN ('down', 'flat', 'mixed') THEN 'recovering'
      WHEN direction_12m = 'down' AND direction_6m <> 'up' THEN 'declining'
      WHEN direction_12m = 'flat' AND active_months_12m = 12 AND stability_band_12m IN ('stable', 'variable') THEN 'mature'
      WHEN direction_12m = 'up' THEN 'growing' ELSE 'mixed' END AS lifecycle_stage
  FROM (SELECT m.scope_name, m.cadence, a.period_start, m.period_end, a.game_theme, 'MODEL002_V1' AS model_policy_version, a.history_start,
      a.month_index AS history_month_count, a.first_active_month, coalesce(a.first_active_month = a.history_start, FALSE) AS first_active_left_censored,
      datediff('month', a.first_active_month, a.period_start) AS months_since_first_active, a.active_months_to_date,
      {', '.join(f"a.month_index >= {h} AS has_{h}m_history, e{h}.active_months AS active_months_{h}m, "
                 f"coalesce(e{h}.direction, 'insufficient_history') AS direction_{h}m, coalesce(e{h}.direction_evidence_count, 0) AS direction_evidence_count_{h}m, "
                 f"e{h}.median_normalized_slope AS median_normalized_slope_{h}m, e{h}.median_r_squared AS median_r_squared_{h}m, "
                 f"e{h}.stability_cv_median AS stability_cv_median_{h}m, coalesce(e{h}.stability_band, 'insufficient_history') AS stability_band_{h}m"
                 for h in (6, 12, 36))},
      CASE WHEN a.month_index >= 24 THEN least(3, a.month_index // 12) * 12 END AS seasonality_history_month_count,
      CASE WHEN a.month_index >= 24 THEN least(3, a.month_index // 12) END AS seasonality_complete_year_count,
      sh.* EXCLUDE ({KT})
    FROM activity a JOIN months m USING (period_start) {_joined}
    LEFT JOIN season_heads sh ON sh.period_start = a.period_start AND sh.game_theme = a.game_theme WHERE a.present)"""
_by_horizon = " ".join(
    f"has_{h}m_history active_months_{h}m direction_{h}m direction_evidence_count_{h}m median_normalized_slope_{h}m"
    f" median_r_squared_{h}m stability_cv_median_{h}m stability_band_{h}m"
    for h in (6, 12, 36)
)
SEASON_HEAD_COLUMNS = " ".join(
    f"{m}_peak_calendar_month {m}_trough_calendar_month {m}_seasonality_amplitude" for m in ("downloads", "revenue_usd")
)
SUMMARY_COLUMNS = (
    f"{THEME_COLUMNS} model_policy_version history_start history_month_count first_active_month first_active_left_censored"
    f" months_since_first_active active_months_to_date {_by_horizon} seasonality_history_month_count seasonality_complete_year_count"
    f" {SEASON_HEAD_COLUMNS} lifecycle_stage"
)
SEASON_COLUMNS = (
    f"{THEME_COLUMNS} metric_name calendar_month history_start history_month_count complete_year_count observation_count"
    " seasonal_index index_deviation is_peak_month is_trough_month"
)

# Backtest.
BLOCKS["population"] = f"""
  SELECT DISTINCT {KT} FROM (SELECT {KT} FROM scores UNION ALL SELECT {KT} FROM summaries WHERE has_6m_history) c
  WHERE EXISTS (SELECT 1 FROM totals t WHERE t.period_start > c.period_start AND t.period_start <= c.period_start + INTERVAL 3 MONTH)"""
_summary_part = (
    [f"has_{h}m_history" for h in (6, 12, 36)]
    + [f"{c}_{h}m" for c in ("direction", "direction_evidence_count", "median_normalized_slope", "stability_cv_median", "stability_band") for h in (6, 12, 36)]
    + ["lifecycle_stage", "first_active_left_censored", "months_since_first_active"]
)
_structure_part = [*MODEL_METRICS, "downloads_product_hhi", "revenue_usd_product_hhi", "publisher_downloads_hhi", "publisher_revenue_usd_hhi"]
_growth_part = [
    "top_500_turnover_rate",
    "market_new_entry_share",
    "downloads_market_new_entry_share_of_current",
    "revenue_usd_market_new_entry_share_of_current",
    "downloads_top_10_positive_contribution_share",
    "revenue_usd_top_10_positive_contribution_share",
]
BLOCKS["raw_outcomes"] = f"""
  SELECT p.scope_name, p.cadence, p.period_start AS decision_period_start, p.period_end AS decision_period_end, h.h AS outcome_horizon_months,
    t.period_start AS outcome_period_start, t.period_end AS outcome_period_end, p.game_theme, 'BACKTEST001_V1' AS backtest_policy_version,
    su.model_policy_version, sc.is_actionable AS legacy_is_actionable, sc.exclusion_reason AS legacy_exclusion_reason,
    sc.confidence_score AS legacy_confidence_score, sc.trend_score AS legacy_6m_momentum_score, sc.trend_rank AS legacy_6m_momentum_rank,
    {', '.join('su.' + c for c in _summary_part)}, {', '.join(f'd.{c} AS decision_{c}' for c in _structure_part)},
    {', '.join(f'gr.{c} AS decision_{c}' for c in _growth_part)},
    {', '.join(f"{m}.seasonal_index AS decision_{m}_expected_seasonal_index, CASE WHEN {m}.seasonal_index IS NOT NULL THEN su.{m}_seasonality_amplitude END AS decision_{m}_seasonality_amplitude" for m in ('downloads', 'revenue_usd'))},
    f.game_theme IS NOT NULL AS future_theme_present,
    {', '.join(f"CASE WHEN f.game_theme IS NULL THEN 0 ELSE f.{c} END AS future_{c}" for c in MODEL_METRICS)}
  FROM population p JOIN (SELECT unnest([1, 2, 3]) AS h) h ON TRUE
  JOIN totals t ON t.period_start = p.period_start + to_months(h.h::INT)
  JOIN structure d ON d.period_start = p.period_start AND d.game_theme = p.game_theme
  JOIN growth gr ON gr.period_start = p.period_start AND gr.game_theme = p.game_theme
  JOIN scores sc ON sc.period_start = p.period_start AND sc.game_theme = p.game_theme
  JOIN summaries su ON su.period_start = p.period_start AND su.game_theme = p.game_theme
  LEFT JOIN structure f ON f.period_start = t.period_start AND f.game_theme = p.game_theme
  LEFT JOIN season downloads ON downloads.metric_name = 'downloads_sum' AND downloads.period_start = p.period_start
    AND downloads.game_theme = p.game_theme AND downloads.calendar_month = month(t.period_start)
  LEFT JOIN season revenue_usd ON revenue_usd.metric_name = 'revenue_usd_sum' AND revenue_usd.period_start = p.period_start
    AND revenue_usd.game_theme = p.game_theme AND revenue_usd.calendar_month = month(t.period_start)"""


def top_flag(value: str, cohort: str) -> str:
    part = f"PARTITION BY {cohort}, {value} IS NOT NULL"
    return (
        f"CASE WHEN {value} IS NOT NULL AND count(*) OVER ({part}) >= 5 THEN row_number() OVER ({part} ORDER BY round({value}, 12) DESC, game_theme)"
        f" <= greatest(1, ceil(count(*) OVER ({part}) * 0.2::DOUBLE)) END"
    )


_cohort = "decision_period_start, outcome_horizon_months"
BLOCKS["changed"] = f"""
  SELECT *, {', '.join(f"future_{c}::DOUBLE - decision_{c}::DOUBLE AS {c}_absolute_change, CASE WHEN decision_{c} > 0 THEN (future_{c}::DOUBLE - decision_{c}::DOUBLE) / decision_{c}::DOUBLE END AS {c}_relative_change" for c in MODEL_METRICS)},
    {', '.join(f"CASE WHEN future_{c} IS NULL OR decision_{c} IS NULL THEN 'unavailable' WHEN {close(f'future_{c}', f'decision_{c}')} THEN 'unchanged' WHEN future_{c} > decision_{c} THEN 'up' ELSE 'down' END AS {c}_change_direction" for c in SHARE_METRICS)}
  FROM raw_outcomes"""
BLOCKS["outcomes"] = f"""
  SELECT *, coalesce({percentile('future_product_share', _cohort, 1.0)}, 0.5) AS future_product_share_percentile,
    {', '.join(f"{percentile(f'future_{c}', _cohort, 1.0)} AS future_{c}_percentile" for c in SHARE_METRICS[1:])},
    {', '.join(f"{top_flag(f'future_{c}', _cohort)} AS future_{c}_top_quintile" for c in SHARE_METRICS)}
  FROM changed"""
IDENTITY_COLUMNS = (
    "scope_name cadence decision_period_start decision_period_end outcome_horizon_months outcome_period_start outcome_period_end game_theme"
)
FUTURE_COLUMNS = " ".join(f"future_{c}" for c in MODEL_METRICS)
CHANGE_COLUMNS = " ".join(f"{c}_absolute_change {c}_relative_change" for c in MODEL_METRICS)
SEASON_INDEX_COLUMNS = " ".join(
    f"decision_{m}_expected_seasonal_index decision_{m}_seasonality_amplitude" for m in ("downloads", "revenue_usd")
)
OUTCOME_COLUMNS = (
    f"{IDENTITY_COLUMNS} backtest_policy_version model_policy_version legacy_is_actionable legacy_exclusion_reason legacy_confidence_score"
    f" legacy_6m_momentum_score legacy_6m_momentum_rank {' '.join(_summary_part)} {' '.join(f'decision_{c}' for c in _structure_part + _growth_part)}"
    f" {SEASON_INDEX_COLUMNS} future_theme_present {FUTURE_COLUMNS} {CHANGE_COLUMNS}"
    f" {' '.join(f'{c}_change_direction future_{c}_percentile future_{c}_top_quintile' for c in SHARE_METRICS)}"
)
_feature_rows = ", ".join(f"('{n}', '{g}', '{h}')" for n, g, h, _ in FEATURES)
BLOCKS["registry"] = f"""
  SELECT x.scope_name, x.cadence, backtest_start, backtest_end, h AS outcome_horizon_months, f.feature_name, f.feature_group, f.feature_hypothesis, o AS outcome_name
  FROM (SELECT scope_name, cadence, min(period_start) AS backtest_start, max(period_start) AS backtest_end FROM totals GROUP BY 1, 2) x,
    (SELECT unnest([1, 2, 3]) AS h), (VALUES {_feature_rows}) f(feature_name, feature_group, feature_hypothesis),
    (SELECT unnest([{', '.join(repr(o) for o in OUTCOMES)}]) AS o)"""
BLOCKS["feature_values"] = "\n UNION ALL ".join(
    f"SELECT decision_period_start, outcome_horizon_months, game_theme, '{n}' AS feature_name,"
    f" {'' if h == 'higher_better' else '-'}({c})::DOUBLE AS x FROM outcomes WHERE {c} IS NOT NULL"
    for n, _, h, c in FEATURES
)
BLOCKS["outcome_values"] = "\n UNION ALL ".join(
    f"SELECT decision_period_start, outcome_horizon_months, game_theme, '{o}' AS outcome_name, {o} AS y, {top_flag(o, _cohort)} AS is_top,"
    f" {', '.join(SEGMENTS[1:])}, CASE WHEN legacy_is_actionable THEN 'actionable' ELSE 'non_actionable' END AS legacy_actionability FROM outcomes"
    for o in OUTCOMES
)
BLOCKS["tested"] = """
  SELECT decision_period_start, outcome_horizon_months, game_theme, feature_name, outcome_name, x, y, n,
    rank() OVER (m ORDER BY xr) + (count(*) OVER (PARTITION BY outcome_horizon_months, feature_name, outcome_name, decision_period_start, xr) - 1) / 2.0::DOUBLE AS rx,
    rank() OVER (m ORDER BY yr) + (count(*) OVER (PARTITION BY outcome_horizon_months, feature_name, outcome_name, decision_period_start, yr) - 1) / 2.0::DOUBLE AS ry,
    n >= 5 AND row_number() OVER (m ORDER BY xr DESC, game_theme) <= greatest(1, ceil(n * 0.2::DOUBLE)) AS tx,
    n >= 5 AND row_number() OVER (m ORDER BY yr DESC, game_theme) <= greatest(1, ceil(n * 0.2::DOUBLE)) AS ty
  FROM (SELECT *, round(x, 12) AS xr, round(y, 12) AS yr, count(*) OVER (PARTITION BY outcome_horizon_months, feature_name, outcome_name, decision_period_start) AS n
        FROM feature_values JOIN outcome_values USING (decision_period_start, outcome_horizon_months, game_theme) WHERE y IS NOT NULL)
  WINDOW m AS (PARTITION BY outcome_horizon_months, feature_name, outcome_name, decision_period_start)"""
BLOCKS["correlations"] = """
  SELECT outcome_horizon_months, feature_name, outcome_name, decision_period_start, corr(rx, ry) AS spearman FROM tested WHERE n >= 5
  GROUP BY 1, 2, 3, 4 HAVING min(rx) <> max(rx) AND min(ry) <> max(ry)"""


def wilson(hits: str, trials: str, low: bool) -> str:
    z = "1.959963984540054::DOUBLE"
    p, n = f"({hits} / nullif({trials}, 0)::DOUBLE)", f"nullif({trials}, 0)::DOUBLE"
    margin = f"{z} * sqrt(({p} * (1 - {p}) + {z} * {z} / (4 * {n})) / {n})"
    centre = f"({p} + {z} * {z} / (2 * {n}))"
    scale = f"(1 + {z} * {z} / {n})"
    value = f"({centre} {'-' if low else '+'} {margin}) / {scale}"
    guard = "greatest(0.0" if low else "least(1.0"
    return f"CASE WHEN {trials} > 0 THEN {guard}, {value}) END"


BLOCKS["correlation_heads"] = f"""
  SELECT *, positive_spearman_cohort_count / correlation_cohort_count::DOUBLE AS positive_spearman_cohort_ratio,
    {wilson('positive_spearman_cohort_count', 'correlation_cohort_count', True)} AS positive_spearman_ci_low,
    {wilson('positive_spearman_cohort_count', 'correlation_cohort_count', False)} AS positive_spearman_ci_high
  FROM (SELECT $scope AS scope_name, 'monthly' AS cadence, outcome_horizon_months, feature_name, outcome_name, count(*) AS correlation_cohort_count, avg(spearman) AS mean_spearman,
      quantile_cont(spearman, 0.5) AS median_spearman, quantile_cont(spearman, 0.25) AS p25_spearman, quantile_cont(spearman, 0.75) AS p75_spearman,
      count(*) FILTER (round(spearman, 12) > 0) AS positive_spearman_cohort_count FROM correlations GROUP BY ALL)"""
_positive = "y > 0 AND NOT abs(y) <= greatest(1e-9 * abs(y), 1e-12)"
BLOCKS["pair_counts"] = f"""
  SELECT outcome_horizon_months, feature_name, outcome_name, count(*) AS n, count(DISTINCT decision_period_start) AS months_seen,
    count(DISTINCT CASE WHEN n >= 5 THEN decision_period_start END) AS cohorts, count(*) FILTER (tx) AS picked, count(*) FILTER (tx AND ty) AS hits,
    count(*) FILTER (ty) AS tops, count(*) FILTER (n >= 5) AS popn, avg(y) AS mean_y, median(y) AS median_y, avg(y) FILTER (tx) AS mean_picked,
    median(y) FILTER (tx) AS median_picked, count(*) FILTER ({_positive}) AS pos, count(*) FILTER (tx AND {_positive}) AS picked_pos
  FROM tested GROUP BY 1, 2, 3"""
_lift = f"""CASE WHEN cohorts > 0 THEN cohorts END AS top_quintile_cohort_count, CASE WHEN cohorts > 0 THEN picked END AS top_quintile_selected_count,
    CASE WHEN cohorts > 0 THEN hits END AS top_quintile_hit_count, hits / nullif(picked, 0)::DOUBLE AS top_quintile_hit_rate,
    {wilson('hits', 'picked', True)} AS top_quintile_hit_ci_low, {wilson('hits', 'picked', False)} AS top_quintile_hit_ci_high,
    tops / nullif(popn, 0)::DOUBLE AS future_top_quintile_base_rate,
    (hits / nullif(picked, 0)::DOUBLE) / nullif(tops / nullif(popn, 0)::DOUBLE, 0) AS top_quintile_lift"""
_is_change = "outcome_name LIKE '%absolute_change'"
_positives = ", ".join(
    f"CASE WHEN {_is_change} AND {n} > 0 THEN {h} END AS {p}_count, CASE WHEN {_is_change} THEN {h} / nullif({n}, 0)::DOUBLE END AS {p}_rate,"
    f" CASE WHEN {_is_change} THEN {wilson(h, n, True)} END AS {p}_ci_low, CASE WHEN {_is_change} THEN {wilson(h, n, False)} END AS {p}_ci_high"
    for p, h, n in (("top_quintile_positive_change", "picked_pos", "picked"), ("all_positive_change", "pos", "n"))
)
BLOCKS["feature_results"] = f"""
  SELECT r.*, 'BACKTEST001_V1' AS backtest_policy_version, coalesce(c.candidates, 0) AS candidate_row_count, coalesce(n, 0) AS eligible_row_count,
    coalesce(n / candidates::DOUBLE, 0) AS coverage_ratio, coalesce(months_seen, 0) AS decision_month_count,
    h.* EXCLUDE (scope_name, cadence, outcome_horizon_months, feature_name, outcome_name, correlation_cohort_count),
    coalesce(h.correlation_cohort_count, 0) AS correlation_cohort_count, {_lift}, mean_picked AS top_quintile_outcome_mean,
    median_picked AS top_quintile_outcome_median, mean_y AS all_eligible_outcome_mean, median_y AS all_eligible_outcome_median, {_positives},
    coalesce(n, 0) < 30 OR coalesce(months_seen, 0) < 6 AS low_sample_warning
  FROM registry r LEFT JOIN (SELECT outcome_horizon_months, count(*) AS candidates FROM outcomes GROUP BY 1) c USING (outcome_horizon_months)
  LEFT JOIN pair_counts USING (outcome_horizon_months, feature_name, outcome_name)
  LEFT JOIN correlation_heads h USING (outcome_horizon_months, feature_name, outcome_name)"""
PAIR_COLUMNS = "scope_name cadence outcome_horizon_months feature_name outcome_name"
SPEARMAN_COLUMNS = (
    "mean_spearman median_spearman p25_spearman p75_spearman positive_spearman_cohort_count positive_spearman_cohort_ratio"
    " positive_spearman_ci_low positive_spearman_ci_high"
)
LIFT_COLUMNS = (
    "top_quintile_cohort_count top_quintile_selected_count top_quintile_hit_count top_quintile_hit_rate top_quintile_hit_ci_low"
    " top_quintile_hit_ci_high future_top_quintile_base_rate top_quintile_lift"
)
POSITIVE_COLUMNS = " ".join(
    f"{p}_count {p}_rate {p}_ci_low {p}_ci_high" for p in ("top_quintile_positive_change", "all_positive_change")
)
FEATURE_METRIC_COLUMNS = (
    "scope_name cadence backtest_start backtest_end outcome_horizon_months feature_name feature_group feature_hypothesis outcome_name"
    " backtest_policy_version candidate_row_count eligible_row_count coverage_ratio decision_month_count correlation_cohort_count"
    f" {SPEARMAN_COLUMNS} {LIFT_COLUMNS} top_quintile_outcome_mean top_quintile_outcome_median all_eligible_outcome_mean"
    f" all_eligible_outcome_median {POSITIVE_COLUMNS} low_sample_warning"
)
BLOCKS["segment_rows"] = "\n UNION ALL ".join(
    f"SELECT outcome_horizon_months, decision_period_start, outcome_name, y, is_top, '{x}' AS segment_name, {x} AS segment_value FROM outcome_values"
    for x in SEGMENTS
)
BLOCKS["segment_results"] = f"""
  SELECT $scope AS scope_name, 'monthly' AS cadence, (SELECT min(period_start) FROM totals) AS backtest_start,
    (SELECT max(period_start) FROM totals) AS backtest_end, s.*, 'BACKTEST001_V1' AS backtest_policy_version,
    eligible_row_count / candidate_row_count::DOUBLE AS coverage_ratio, candidate_row_count / all_rows::DOUBLE AS segment_row_share,
    top / nullif(flagged, 0)::DOUBLE AS future_top_quintile_rate, flagged AS future_top_quintile_eligible_count, top AS future_top_quintile_count,
    {wilson('top', 'flagged', True)} AS future_top_quintile_ci_low, {wilson('top', 'flagged', False)} AS future_top_quintile_ci_high,
    all_top / nullif(all_flagged, 0)::DOUBLE AS future_top_quintile_base_rate,
    (top / nullif(flagged, 0)::DOUBLE) / nullif(all_top / nullif(all_flagged, 0)::DOUBLE, 0) AS future_top_quintile_lift,
    CASE WHEN {_is_change} AND eligible_row_count > 0 THEN pos END AS positive_change_count,
    CASE WHEN {_is_change} THEN pos / nullif(eligible_row_count, 0)::DOUBLE END AS positive_change_rate,
    CASE WHEN {_is_change} THEN {wilson('pos', 'eligible_row_count', True)} END AS positive_change_ci_low,
    CASE WHEN {_is_change} THEN {wilson('pos', 'eligible_row_count', False)} END AS positive_change_ci_high,
    eligible_row_count < 30 OR decision_month_count < 6 AS low_sample_warning
  FROM (SELECT outcome_horizon_months, segment_name, segment_value, outcome_name, count(*) AS candidate_row_count, count(y) AS eligible_row_count,
      count(DISTINCT CASE WHEN y IS NOT NULL THEN decision_period_start END) AS decision_month_count, avg(y) AS outcome_mean,
      quantile_cont(y, 0.5) AS outcome_median, quantile_cont(y, 0.25) AS outcome_p25, quantile_cont(y, 0.75) AS outcome_p75,
      count(is_top) AS flagged, count(*) FILTER (is_top) AS top, count(*) FILTER ({_positive}) AS pos FROM segment_rows GROUP BY 1, 2, 3, 4) s
  JOIN (SELECT outcome_horizon_months, outcome_name, count(*) AS all_rows, count(is_top) AS all_flagged, count(*) FILTER (is_top) AS all_top
        FROM outcome_values GROUP BY 1, 2) b USING (outcome_horizon_months, outcome_name)"""
SEGMENT_COLUMNS = (
    "scope_name cadence backtest_start backtest_end outcome_horizon_months segment_name segment_value outcome_name backtest_policy_version"
    " candidate_row_count eligible_row_count coverage_ratio decision_month_count segment_row_share outcome_mean outcome_median outcome_p25"
    " outcome_p75 future_top_quintile_eligible_count future_top_quintile_count future_top_quintile_rate future_top_quintile_ci_low"
    " future_top_quintile_ci_high future_top_quintile_base_rate future_top_quintile_lift positive_change_count positive_change_rate"
    " positive_change_ci_low positive_change_ci_high low_sample_warning"
)

# Revenue proxy.
_class = "CASE WHEN revenue_absolute IS NULL THEN 'unknown' WHEN revenue_absolute = 0 THEN 'iaa_candidate' ELSE 'iap_or_hybrid_candidate' END"
_CLASSES = ("iaa_candidate", "iap_or_hybrid_candidate", "unknown")
_proxy_policy = "'MONETIZATION001_OBSERVABLE_REVENUE_PROXY_V1'"
BLOCKS["profile_rows"] = f"""
  SELECT {K}, source_app_id, unified_app_id, game_theme, game_product_model, {_proxy_policy} AS monetization_policy_version,
    revenue_absolute AS observable_revenue_usd, units_absolute, {_class} AS monetization_proxy,
    CASE WHEN revenue_absolute IS NULL THEN 'unavailable' WHEN revenue_absolute = 0 THEN 'zero' ELSE 'positive' END AS observable_revenue_state,
    CASE WHEN revenue_absolute IS NULL THEN 'observable_revenue_unavailable' WHEN revenue_absolute = 0 THEN 'observable_revenue_zero'
         ELSE 'observable_revenue_positive' END AS classification_reason FROM snap"""
PROFILE_COLUMNS = (
    f"{PERIOD_COLUMNS} source_app_id unified_app_id game_theme game_product_model monetization_policy_version observable_revenue_usd"
    " observable_revenue_state monetization_proxy classification_reason"
)
BLOCKS["proxies"] = f"""
  SELECT *, observable_revenue_usd_coverage_count / product_count::DOUBLE AS observable_revenue_usd_coverage_ratio,
    downloads_coverage_count / product_count::DOUBLE AS downloads_coverage_ratio,
    {', '.join(f"{c}_product_count / product_count::DOUBLE AS {c}_product_share, CASE WHEN downloads_sum > 0 THEN {c}_downloads_sum / downloads_sum END AS {c}_downloads_share" for c in _CLASSES)}
  FROM (SELECT {KT}, {_proxy_policy} AS monetization_policy_version, count(*) AS product_count, count(observable_revenue_usd) AS observable_revenue_usd_coverage_count,
      {s('observable_revenue_usd')} AS observable_revenue_usd_sum, count(units_absolute) AS downloads_coverage_count, {s('units_absolute')} AS downloads_sum,
      {', '.join(f"count(*) FILTER (monetization_proxy = '{c}') AS {c}_product_count, round(sum(units_absolute) FILTER (monetization_proxy = '{c}'), 6) AS {c}_downloads_sum" for c in _CLASSES)}
    FROM profile_rows WHERE game_theme IS NOT NULL GROUP BY {KT})"""
PROXY_COLUMNS = (
    f"{THEME_COLUMNS} monetization_policy_version product_count observable_revenue_usd_coverage_count observable_revenue_usd_coverage_ratio"
    " observable_revenue_usd_sum downloads_coverage_count downloads_coverage_ratio downloads_sum "
    + " ".join(f"{c}_product_count {c}_product_share {c}_downloads_sum {c}_downloads_share" for c in _CLASSES)
)

# Decisions.
BLOCKS["fits"] = f"""
  SELECT *, CASE WHEN seen_now AND target_month_product_count >= 2 AND observation_month_count >= 3 AND has_downloads THEN 'validated_fit' ELSE 'observed_fit' END AS fit_state,
    concat_ws(',', CASE WHEN NOT seen_now THEN 'target_month_not_observed' END, CASE WHEN observation_month_count < 3 THEN 'insufficient_observation_history' END,
      CASE WHEN target_month_product_count < 2 THEN 'insufficient_target_product_count' END, CASE WHEN NOT has_downloads THEN 'insufficient_downloads_evidence' END,
      CASE WHEN target_month_observable_revenue_coverage_count IS NULL OR target_month_observable_revenue_usd_sum IS NULL THEN 'observable_revenue_unavailable'
           WHEN target_month_observable_revenue_coverage_count < target_month_product_count THEN 'observable_revenue_coverage_gap' END,
      CASE WHEN supporting_representative_product_count IS NULL THEN 'representative_evidence_unavailable' END) AS evidence_limitations
  FROM (SELECT g.*, 'DECISION001_V1' AS decision_policy_version,
      CASE WHEN EXISTS (SELECT 1 FROM leaders l JOIN summaries su ON su.game_theme = l.game_theme AND su.period_start = g.period_start
                        WHERE l.period_start BETWEEN g.period_start - INTERVAL 11 MONTH AND g.period_start)
           THEN coalesce(n, 0) END AS supporting_representative_product_count
    FROM (SELECT su.scope_name, su.cadence, su.period_start, su.period_end, su.game_theme, d.dimension_value AS game_subgenre,
        count(DISTINCT d.period_start) AS observation_month_count, bool_or(d.period_start = su.period_start) AS seen_now,
        coalesce(max(d.product_count) FILTER (d.period_start = su.period_start), 0) AS target_month_product_count,
        max(d.downloads_coverage_count) FILTER (d.period_start = su.period_start) AS target_month_downloads_coverage_count,
        max(d.downloads_sum) FILTER (d.period_start = su.period_start) AS target_month_downloads_sum,
        max(d.revenue_usd_coverage_count) FILTER (d.period_start = su.period_start) AS target_month_observable_revenue_coverage_count,
        max(d.revenue_usd_sum) FILTER (d.period_start = su.period_start) AS target_month_observable_revenue_usd_sum,
        coalesce(max(d.downloads_coverage_count) FILTER (d.period_start = su.period_start) > 0
             AND max(d.downloads_sum) FILTER (d.period_start = su.period_start) > 0, FALSE) AS has_downloads
      FROM summaries su JOIN dims d ON d.game_theme = su.game_theme AND d.dimension_type = 'game_subgenre'
        AND d.period_start BETWEEN su.period_start - INTERVAL 11 MONTH AND su.period_start
      GROUP BY 1, 2, 3, 4, 5, 6) g
    LEFT JOIN (SELECT period_start, game_theme, game_subgenre, count(DISTINCT unified_app_id) AS n FROM leaders GROUP BY 1, 2, 3) l
      USING (period_start, game_theme, game_subgenre))"""
FIT_COLUMNS = (
    f"{THEME_COLUMNS} decision_policy_version game_subgenre fit_state observation_month_count target_month_product_count"
    " target_month_downloads_coverage_count target_month_downloads_sum target_month_observable_revenue_coverage_count"
    " target_month_observable_revenue_usd_sum supporting_representative_product_count evidence_limitations"
)
BLOCKS["fit_heads"] = f"""
  SELECT {KT}, CASE WHEN bool_or(fit_state = 'validated_fit') THEN 'validated_fit' ELSE 'observed_fit' END AS category_fit_summary,
    bool_or(fit_state = 'validated_fit') AND bool_or(fit_state = 'observed_fit') AS can_migrate FROM fits GROUP BY {KT}"""
BLOCKS["migrations"] = f"""
  SELECT {', '.join('a.' + c for c in KT.split(', '))}, 'DECISION001_V1' AS decision_policy_version, a.game_subgenre AS validated_source_game_subgenre,
    b.game_subgenre AS target_observed_game_subgenre, 'requires_product_validation' AS hypothesis_status,
    'validated_source_fit,observed_target_fit' AS supporting_evidence_codes, 'migration_not_validated' AS risk_limitation_codes,
    FALSE AS is_validated_fit, TRUE AS requires_product_validation
  FROM fits a JOIN fits b ON a.period_start = b.period_start AND a.game_theme = b.game_theme AND a.fit_state = 'validated_fit' AND b.fit_state = 'observed_fit'"""
MIGRATION_COLUMNS = (
    f"{THEME_COLUMNS} decision_policy_version validated_source_game_subgenre target_observed_game_subgenre hypothesis_status"
    " supporting_evidence_codes risk_limitation_codes is_validated_fit requires_product_validation"
)
_market = ("product_share", "downloads_share", "revenue_usd_share")
_compete = ("downloads_product_hhi", "revenue_usd_product_hhi", "downloads_top_10_positive_contribution_share", "revenue_usd_top_10_positive_contribution_share")
_names = {
    "product_share": "market_size_product_share_percentile",
    "downloads_share": "market_size_downloads_share_percentile",
    "revenue_usd_share": "market_size_observable_revenue_share_percentile",
    "downloads_product_hhi": "competitive_downloads_hhi_percentile",
    "revenue_usd_product_hhi": "competitive_observable_revenue_hhi_percentile",
    "downloads_top_10_positive_contribution_share": "competitive_downloads_top10_growth_percentile",
    "revenue_usd_top_10_positive_contribution_share": "competitive_observable_revenue_top10_growth_percentile",
    "downloads_seasonality_amplitude": "season_1",
    "revenue_usd_seasonality_amplitude": "season_2",
}


def _counted(names, test: str) -> str:
    return " + ".join(f"coalesce(({n} {test}), FALSE)::INT" for n in names)


_m = [_names[c] for c in _market]
_c = [_names[c] for c in _compete]
BLOCKS["evidence_rows"] = f"""
  SELECT *, {', '.join(f"{percentile(c, 'period_start', 1.0)} AS {n}" for c, n in _names.items())}
  FROM (SELECT {', '.join('d.' + c for c in KT.split(', '))}, d.product_count, d.product_share, d.downloads_share, d.revenue_usd_share, d.downloads_product_hhi,
      d.revenue_usd_product_hhi, d.revenue_usd_coverage_count, gr.market_new_entry_share, gr.top_500_turnover_rate,
      gr.downloads_top_10_positive_contribution_share, gr.revenue_usd_top_10_positive_contribution_share,
      su.lifecycle_stage, su.has_12m_history, su.stability_band_6m, su.stability_band_12m, su.stability_band_36m,
      su.median_normalized_slope_6m, su.median_normalized_slope_12m, su.median_normalized_slope_36m,
      su.downloads_seasonality_amplitude, su.revenue_usd_seasonality_amplitude, sc.trend_score, coalesce(fh.category_fit_summary, 'insufficient_evidence') AS category_fit_summary,
      coalesce(fh.can_migrate, FALSE) AS can_migrate
    FROM structure d JOIN summaries su USING ({KT}) LEFT JOIN growth gr USING ({KT}) LEFT JOIN scores sc USING ({KT}) LEFT JOIN fit_heads fh USING ({KT}))"""
BLOCKS["bands"] = f"""
  SELECT *, CASE WHEN ({_counted(_m, 'IS NOT NULL')}) < 2 THEN 'insufficient_evidence' WHEN ({_counted(_m, '>= 0.8')}) >= 2 THEN 'strong'
      WHEN ({_counted(_m, '>= 0.5')}) >= 2 THEN 'moderate' ELSE 'limited' END AS market_size_band,
    CASE WHEN ({_counted(_c, '>= 0.8')}) >= 2 THEN 'higher_structural_risk'
      WHEN ({_counted(_c, 'IS NOT NULL')}) >= 3 AND ({_counted(_c, '>= 0.8')}) = 0 AND ({_counted(_c, '<= 0.5')}) >= 2 THEN 'lower_structural_risk'
      WHEN ({_counted(_c, 'IS NOT NULL')}) >= 2 THEN 'mixed_structural_risk' ELSE 'insufficient_evidence' END AS competitive_structure_risk_band,
    CASE lifecycle_stage WHEN 'growing' THEN 'balanced_growth' WHEN 'accelerating' THEN 'observable_revenue_growth_support' WHEN 'mature' THEN 'durable_established'
      WHEN 'emerging' THEN 'experimental_emerging' WHEN 'recovering' THEN 'cautious_recovery' WHEN 'declining' THEN 'declining' WHEN 'mixed' THEN 'mixed_or_uncertain'
      WHEN 'insufficient_history' THEN 'insufficient_evidence' END AS growth_quality_state,
    CASE WHEN ({_counted(_market, 'IS NOT NULL')}) = 3 AND has_12m_history AND lifecycle_stage <> 'insufficient_history' AND ({_counted(_compete, 'IS NOT NULL')}) >= 3
           AND category_fit_summary = 'validated_fit' THEN 'high'
      WHEN ({_counted(_market, 'IS NOT NULL')}) >= 2 AND lifecycle_stage <> 'insufficient_history' AND ({_counted(_compete, 'IS NOT NULL')}) >= 2 THEN 'medium' ELSE 'low' END AS confidence,
    CASE WHEN stability_band_6m = 'volatile' THEN 'stability_band_6m' WHEN stability_band_12m = 'volatile' THEN 'stability_band_12m'
         WHEN stability_band_36m = 'volatile' THEN 'stability_band_36m' END AS volatile_source,
    game_theme IN ('', 'Unknown', 'N/A') AS meaningless, ({_counted(_market, 'IS NOT NULL')}) AS market_available
  FROM evidence_rows"""
_up = "growth_quality_state IN ('balanced_growth', 'observable_revenue_growth_support')"
_steady = "growth_quality_state IN ('durable_established', 'cautious_recovery')"
_higher = "competitive_structure_risk_band = 'higher_structural_risk'"
_none = "market_size_band = 'insufficient_evidence'"
BLOCKS["gates"] = f"""
  SELECT *, CASE WHEN lifecycle_stage = 'declining' AND (market_size_band = 'limited' OR {_higher}) THEN 'deprioritize'
      WHEN {_none} OR growth_quality_state = 'insufficient_evidence' OR lifecycle_stage = 'mixed' OR volatile_source IS NOT NULL OR meaningless THEN 'monitor'
      WHEN growth_quality_state = 'experimental_emerging' THEN 'small_experiment'
      WHEN market_size_band = 'strong' AND {_up} AND NOT {_higher} AND confidence <> 'low' THEN 'prioritize_validation'
      WHEN (market_size_band = 'strong' AND {_steady}) OR (market_size_band = 'moderate' AND {_up}) THEN 'selective_validation' ELSE 'monitor' END AS recommendation,
    CASE WHEN {_none} OR lifecycle_stage = 'insufficient_history' THEN 'insufficient_evidence' WHEN lifecycle_stage = 'mixed' OR volatile_source IS NOT NULL THEN 'mixed_or_volatile_evidence'
      WHEN lifecycle_stage = 'declining' THEN 'declining_evidence' WHEN lifecycle_stage = 'emerging' THEN 'emerging_requires_experiment'
      WHEN lifecycle_stage = 'accelerating' THEN 'observable_revenue_growth_evidence' WHEN lifecycle_stage = 'growing' THEN 'balanced_growing_evidence'
      WHEN lifecycle_stage = 'mature' THEN 'durable_established_market' WHEN lifecycle_stage = 'recovering' THEN 'recovery_requires_validation'
      WHEN market_size_band = 'strong' THEN 'strong_current_market_scale' ELSE 'insufficient_evidence' END AS primary_reason_code,
    CASE WHEN NOT {_none} AND lifecycle_stage = 'emerging' AND volatile_source IS NULL AND NOT meaningless AND NOT {_higher} THEN 'experimental_window'
      WHEN {_none} OR {_higher} OR lifecycle_stage IN ('declining', 'mixed', 'insufficient_history') OR volatile_source IS NOT NULL OR meaningless THEN 'caution_or_monitor'
      WHEN market_size_band = 'strong' AND {_up} THEN 'supported_validation_window'
      WHEN market_size_band = 'moderate' OR {_steady} THEN 'selective_validation_window' ELSE 'caution_or_monitor' END AS evidence_state
  FROM bands"""
BLOCKS["decisions"] = """
  SELECT *, CASE recommendation WHEN 'prioritize_validation' THEN 'prioritize_theme_validation' WHEN 'selective_validation' THEN 'run_selective_concept_validation'
      WHEN 'small_experiment' THEN 'run_small_controlled_experiment' WHEN 'deprioritize' THEN 'deprioritize_current_theme'
      ELSE CASE WHEN can_migrate THEN 'validate_migration_hypothesis' WHEN category_fit_summary <> 'validated_fit' THEN 'validate_category_fit'
                ELSE 'monitor_next_completed_month' END END AS next_validation_action_code,
    CASE WHEN evidence_state <> 'caution_or_monitor' THEN primary_reason_code WHEN lifecycle_stage = 'declining' THEN 'declining_evidence'
      WHEN lifecycle_stage = 'insufficient_history' THEN 'insufficient_evidence' WHEN lifecycle_stage = 'mixed' THEN 'mixed_or_volatile_evidence'
      ELSE primary_reason_code END AS reason_code,
    'AGG002_V1,MODEL002_V1,BACKTEST001_V1,MONETIZATION001_OBSERVABLE_REVENUE_PROXY_V1' AS source_policy_references,
    TRUE AS is_revenue_evidence_used, 'DECISION001_V1' AS decision_policy_version, market_new_entry_share AS current_market_new_entry_share,
    top_500_turnover_rate AS current_top_500_turnover_rate, median_normalized_slope_6m AS downloads_trend_slope_6m,
    median_normalized_slope_12m AS downloads_trend_slope_12m, median_normalized_slope_36m AS downloads_trend_slope_36m,
    revenue_usd_seasonality_amplitude AS observable_revenue_seasonality_amplitude, trend_score AS legacy_6m_momentum_score
  FROM gates"""
PERCENTILE_COLUMNS = " ".join(_m + _c)
DECISION_COLUMNS = (
    f"{THEME_COLUMNS} decision_policy_version market_size_band growth_quality_state competitive_structure_risk_band category_fit_summary confidence"
    f" recommendation primary_reason_code next_validation_action_code source_policy_references {PERCENTILE_COLUMNS} current_market_new_entry_share"
    " current_top_500_turnover_rate downloads_trend_slope_6m downloads_trend_slope_12m downloads_trend_slope_36m downloads_seasonality_amplitude"
    " observable_revenue_seasonality_amplitude legacy_6m_momentum_score"
)
# The proxy table covers every theme of these tables, so revenue evidence is always in use.
_risks = (
    ("volatile_source IS NOT NULL", "volatile_evidence", "'high'", "'observed'", "volatile_source"),
    ("lifecycle_stage = 'mixed'", "mixed_lifecycle", "'medium'", "'observed'", "'lifecycle_stage'"),
    ("lifecycle_stage = 'declining'", "declining_lifecycle", "'high'", "'observed'", "'lifecycle_stage'"),
    (f"{_c[0]} >= 0.8 OR {_c[1]} >= 0.8", "high_product_concentration", "'high'", "'observed'", f"CASE WHEN {_c[0]} >= 0.8 THEN '{_c[0]}' ELSE '{_c[1]}' END"),
    (f"{_c[2]} >= 0.8 OR {_c[3]} >= 0.8", "top10_growth_concentration", "'medium'", "'observed'", f"CASE WHEN {_c[2]} >= 0.8 THEN '{_c[2]}' ELSE '{_c[3]}' END"),
    ("season_1 >= 0.8 OR season_2 >= 0.8", "seasonality_timing_dependence", "'medium'", "'observed'",
     "CASE WHEN season_1 >= 0.8 THEN 'downloads_seasonality_amplitude' ELSE 'revenue_usd_seasonality_amplitude' END"),
    (_none, "insufficient_market_evidence", "CASE WHEN market_available = 0 THEN 'high' ELSE 'medium' END",
     "CASE WHEN market_available = 0 THEN 'unavailable' ELSE 'partial' END", "NULL"),
    ("lifecycle_stage = 'insufficient_history' OR NOT has_12m_history", "insufficient_model_history", "'medium'", "'partial'", "'has_12m_history'"),
    ("meaningless", "non_actionable_theme_label", "'medium'", "'observed'", "'game_theme'"),
    ("TRUE", "observable_revenue_only", "'low'", "'observed'", "CASE WHEN revenue_usd_share IS NOT NULL THEN 'revenue_usd_share' ELSE 'revenue_absolute' END"),
    ("TRUE", "monetization_type_unverified", "'medium'", "'partial'", "'monetization_proxy'"),
    ("revenue_usd_coverage_count < product_count", "observable_revenue_coverage_gap", "'medium'", "'partial'", "'observable_revenue_coverage_count'"),
    ("can_migrate", "migration_not_validated", "'medium'", "'partial'", "'game_subgenre_fit'"),
)
BLOCKS["risks"] = "\n UNION ALL ".join(
    f"SELECT {KT}, decision_policy_version, '{code}' AS risk_code, {severity} AS severity, {available} AS evidence_availability, {source} AS source_metric_name"
    f" FROM decisions WHERE {condition}"
    for condition, code, severity, available, source in _risks
)


def rule_test(rule) -> str:
    """SQL that is FALSE in rows without the rule."""
    column, others = rule.column, rule.others
    if rule.kind == "one_of":
        return f"{column} IN ({', '.join(repr(member) for member in others)})"
    if rule.kind == "between":
        return f"({column} >= {others[0]} - 1e-9 AND {column} <= {others[1]} + 1e-9)"
    if rule.kind == "at_least":
        return f"{column} >= {others[0]}"
    if rule.kind == "at_most" and column.endswith("_start"):
        return f"{column} <= {others[0]}"
    if rule.kind == "at_most":
        return f"{column} - {others[0]} <= 1e-9 * greatest(abs({others[0]}), 1)"
    if rule.kind == "covered_by":
        return f"NOT (({others[0]} = 0 AND {column} IS NOT NULL) OR ({others[0]} <> 0 AND {column} IS NULL))"
    if rule.kind == "adds_up":
        return f"{others[0]} - {' - '.join(others[1:])} = 0"
    return f"NOT (NOT {others[0]} AND {column} IS NOT NULL)"


def rule_counts(table: str, relation: str, columns, rules, chosen: str, fault) -> str:
    """Rows of ``relation`` without each rule, and of copies of the chosen rows with each rule's ``fault``."""
    changes: dict[str, str] = {}
    for rule in rules:
        for name, value in fault(rule).items():
            changes[name] = f"CASE WHEN fault_rule = '{rule.name}' THEN {value} ELSE {changes.get(name, name)} END"
    names = ", ".join(f"'{rule.name}'" for rule in rules)
    listed = ", ".join(columns)
    changed = ", ".join(f"{changes[name]} AS {name}" if name in changes else name for name in columns)

    def counted(source: str, test: str) -> str:
        counts = ", ".join(f"count(*) FILTER (WHERE {test} AND NOT ({rule_test(rule)}))" for rule in rules)
        return f"SELECT '{table}' AS table_name, '{source}' AS source, unnest([{names}]) AS rule, unnest([{counts}]) AS row_count"

    return f"""{counted('stored', 'TRUE')} FROM {relation}
      UNION ALL {counted('faulty', 'TRUE')} FROM (SELECT {changed}, fault_rule FROM
        (SELECT {listed}, unnest([{names}]) AS fault_rule FROM {relation} WHERE {chosen}))"""
