"""Small hand-made inputs."""

from __future__ import annotations

import calendar
import datetime

SNAPSHOT = (
    "scope_name string, cadence string, period_start date, period_end date, rank_position int, source_app_id string,"
    " unified_app_id string, scope_country string, device_type string, category int, data_model string,"
    " units_absolute double, revenue_absolute double, game_theme string, game_genre string, game_subgenre string,"
    " game_product_model string, game_art_style string, game_setting string, earliest_release_date date,"
    " release_date_ww date, most_popular_country_by_revenue string"
)
METADATA = (
    "unified_app_id string, name string, publisher_display_name string, publisher_resolution_source string,"
    " android_app_id string, ios_app_id string, fetched_at timestamp"
)


def month(year: int, number: int) -> tuple[datetime.date, datetime.date]:
    start = datetime.date(year, number, 1)
    return start, start.replace(day=calendar.monthrange(year, number)[1])


def snapshot(
    period, app, rank, theme, units, revenue, scope="s", subgenre=None, model=None, style=None, setting=None, released=None
):
    start, end = month(*period)
    return (
        scope, "monthly", start, end, rank, app, app, "WW", "total", 1, "DM", units, revenue, theme, "Puzzle",
        subgenre, model, style, setting, None, released, "US",
    )


def metadata(app, publisher):
    return (app, f"name {app}", publisher, "publisher_name", None, None, datetime.datetime(2024, 1, 1))


def frames(spark, snapshots, metadatas):
    return (
        spark.createDataFrame(snapshots, SNAPSHOT),
        spark.createDataFrame(metadatas, METADATA),
    )


def rows_by(df, *keys):
    """Collected rows as dictionaries, keyed by one or more columns."""
    found = {}
    for row in df.collect():
        key = tuple(row[k] for k in keys)
        found[key[0] if len(keys) == 1 else key] = row.asDict(recursive=True)
    return found
