import datetime
import json

import pytest
from builders import frames, metadata, snapshot
from pyspark.sql import functions as F

from themelens.constants import PERIOD
from themelens.functions.text import is_managed_key, managed_key, normalize_opaque_id
from themelens.operators import calendar, quality, reconcile
from themelens.plans.stages import Stages
from themelens.session import scratch_dir
from themelens.sources import market_json
from themelens.sources.store import (
    PeriodTable,
    damaged_periods,
    export_sorted,
    readback_differences,
    replace_period,
    replace_range,
    upsert_metadata,
    verified,
)

FLAT = [
    {"app_id": 7, "country": "US", "date": "2024-01-31T00:00:00Z", "units_absolute": 5, "custom_tags": {"Game Theme": "Farm", "Game Genre": " Puzzle", "Release Date (WW)": "2020/02/30"}},
    {"app_id": "0012", "date": "2024-01-31T00:00:00+00:00", "custom_tags": {"Game Genre": "PUZZLE", "Most Popular Country by Revenue": "China", "Earliest Release Date": "2020-1-2"}},
    {"app_id": "abc", "date": "2024-01-31T00:00:00", "custom_tags": {"Game Genre": "Racing"}},
]
NESTED = [
    {"app_id": "x1", "country": None, "date": "2024-01-31T00:00:00Z", "extra": 1, "revenue_absolute": 2.5,
     "entities": [{"custom_tags": {"Game Theme": "Entity Decoration", "Game Genre": "puzzle", "Game Setting": "City"}}],
     "aggregate_tags": {"Game Theme": "Decoration"}},
    {"app_id": "x2", "date": "2024-01-31T00:00:00Z", "entities": []},
]


@pytest.fixture(scope="module")
def parsed(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("responses")
    (folder / "a.json").write_text(json.dumps(FLAT, indent=1))
    (folder / "b.json").write_text(json.dumps(NESTED, indent=1))
    return market_json.read_market_json(spark, str(folder)).cache()


def test_both_tag_layouts_and_row_errors(parsed):
    rows = {r.source_app_id: r for r in parsed.collect()}
    assert set(rows) == {"7", "12", "abc", "x1", "x2"}
    assert (rows["7"].game_theme, rows["7"].units_absolute, rows["7"].release_date_ww) == ("Farm", 5.0, None)
    assert rows["7"].date_notes == ["Release Date (WW)"] and rows["7"].errors == []
    assert rows["12"].earliest_release_date == datetime.date(2020, 1, 2)
    assert rows["abc"].errors == ["invalid_date"] and rows["x2"].errors == ["missing_tags"]
    assert (rows["x1"].game_theme, rows["x1"].game_setting) == ("Decoration", "City")
    assert [r.position for r in parsed.orderBy("source", "position").collect()] == [1, 2, 3, 1, 2]


def test_selection_keeps_source_order_and_cuts_after_filtering(parsed, spark):
    picked = market_json.select_market_records(parsed, ["source"], ["puzzle "], 5, exclude_country="China")
    assert [(r.source_app_id, r.rank_position) for r in picked.orderBy("source").collect()] == [("7", 1), ("x1", 1)]
    many = spark.range(1200).select(
        F.lit("r").alias("source"), (F.col("id") + 1).alias("position"), F.when(F.col("id") % 12 != 0, "Puzzle").alias("game_genre"),
        F.lit(None).cast("string").alias("most_popular_country_by_revenue"),
    )
    chosen = market_json.select_market_records(many, ["source"], ["PUZZLE"], 1000)
    assert chosen.count() == 1000 and chosen.agg(F.max("position")).first()[0] == 1091
    with pytest.raises(ValueError):
        market_json.select_market_records(many, ["source"], [" "], 10)


@pytest.mark.parametrize(
    "value, expected",
    [("007", "7"), (" 5 ", "5"), ("0", None), ("000", None), ("-1", None), ("1.5", None), (".5", None), ("com.a", "com.a"), ("", None), ("  ", None), (None, None)],
)
def test_opaque_ids(spark, value, expected):
    df = spark.createDataFrame([(value,)], "v string").select(normalize_opaque_id(F.col("v")).alias("v"))
    assert df.first().v == expected


def test_cache_age_limit_is_inclusive(spark):
    ids = spark.createDataFrame([("a",), ("b",), ("c",)], "unified_app_id string")
    at = datetime.datetime(2024, 1, 15)
    cache = spark.createDataFrame([("a", at - datetime.timedelta(days=14)), ("b", at - datetime.timedelta(days=14, seconds=1))], "unified_app_id string, fetched_at timestamp")
    got = market_json.metadata_cache_lookup(ids, cache, "2024-01-15 00:00:00")
    assert {r.unified_app_id: r.status for r in got.collect()} == {"a": "fresh", "b": "stale", "c": "missing"}


def test_replacing_a_range_is_repeatable_and_clears_empty_periods(spark):
    rows, _ = frames(spark, [snapshot((2024, m), f"a{i}", i + 1, "T", 1.0, 1.0) for m in (1, 2, 3) for i in range(3)], [metadata("a", None)])
    rows = rows.unionByName(rows.where("period_start < '2024-02-15'").withColumn("scope_name", F.lit("7 a/b=%")))
    rows = rows.unionByName(rows.withColumn("cadence", F.lit("weekly")))
    table = PeriodTable(spark, scratch_dir(spark), rows.schema)
    assert table.read().isEmpty() and table.periods() == []
    everything = [tuple(row) for row in rows.select(*PERIOD).distinct().collect()]
    for _ in range(2):
        replace_range({table: rows}, everything)
    assert readback_differences(rows, table.read()).isEmpty() and table.read().dtypes == rows.dtypes
    assert table.periods() == sorted(tuple(map(str, p)) for p in everything)
    months = {p[2].month: p for p in everything if p[:2] == ("s", "monthly")}
    less = rows.where("period_start = '2024-02-01' and rank_position = 1 and scope_name = 's' and cadence = 'monthly'")
    replace_range({table: less}, [months[2], months[3]])
    counts = table.read().groupBy("scope_name", "cadence", F.month("period_start").alias("m")).agg(F.count(F.lit(1)).alias("n"))
    kept = {tuple(r) for r in counts.where("scope_name = 's'").collect()}
    weekly = {("s", "weekly", m, 3) for m in (1, 2, 3)}
    assert kept == weekly | {("s", "monthly", 1, 3), ("s", "monthly", 2, 1)}  # the other cadence survives
    assert table.read([months[2]]).count() == 1 and table.read([months[3]]).isEmpty()
    before = table.read().count()
    with pytest.raises(Exception, match="outside the target range"):
        replace_range({table: rows}, [months[1]])
    assert table.read().count() == before  # the refused write changed nothing
    replace_period(table, less.limit(0), months[2])
    assert months[2] not in {tuple(p) for p in table.read().select(*PERIOD).distinct().collect()}


def test_only_periods_whose_digests_differ_are_compared(spark):
    rows, _ = frames(spark, [snapshot((2024, m), f"a{i}", i + 1, "T", None, 1.0) for m in (1, 2, 3, 4) for i in range(3)], [metadata("a", None)])
    table = PeriodTable(spark, scratch_dir(spark), rows.schema)
    table.write(rows.orderBy(F.rand(1)))
    assert damaged_periods(rows, table) == [] and verified(rows, table).isEmpty()
    one = F.col("period_start") == F.lit("2024-02-01").cast("date")
    # A value for a NULL and a NULL for a value in one row, a row that stands twice, a lost month.
    first = F.col("rank_position") == 1
    swapped = rows.where(one).withColumns(
        {
            "units_absolute": F.when(first, F.col("revenue_absolute")).otherwise(F.col("units_absolute")),
            "revenue_absolute": F.when(~first, F.col("revenue_absolute")),
        }
    )
    third = rows.where("month(period_start) = 3")
    later = [tuple(r) for r in rows.where("month(period_start) > 1").select(*PERIOD).distinct().collect()]
    replace_range({table: swapped.unionByName(third).unionByName(third.limit(1))}, later)
    assert [p[2] for p in damaged_periods(rows, table)] == ["2024-02-01", "2024-03-01", "2024-04-01"]
    found = verified(rows, table)
    counts = {(r.m, r.violation): r["count"] for r in found.groupBy(F.month("period_start").alias("m"), "violation").count().collect()}
    assert counts == {(2, "not_stored"): 1, (2, "not_expected"): 1, (3, "not_expected"): 1, (4, "not_stored"): 3}
    assert table.read(damaged_periods(rows, table)).where("month(period_start) = 1").isEmpty()


def test_only_folders_of_the_wanted_periods_are_read(spark):
    rows, _ = frames(spark, [snapshot((2024, m), "a", 1, "T", 1.0, 1.0) for m in range(1, 13)], [metadata("a", None)])
    table = PeriodTable(spark, scratch_dir(spark), rows.schema)
    table.write(rows)
    wanted = [tuple(row) for row in rows.where("month(period_start) in (3, 4)").select(*PERIOD).collect()]
    read = table.read(wanted)
    assert read.count() == 2
    assert "PartitionFilters: [period_start" in read._jdf.queryExecution().executedPlan().toString()


def test_upsert_export_and_missing_months(spark):
    _, old = frames(spark, [snapshot((2024, 1), "a", 1, None, None, None)], [metadata("a", "P"), metadata("b", "Q")])
    new = old.where("unified_app_id = 'a'").withColumn("publisher_display_name", F.lit(None).cast("string"))
    merged = {r.unified_app_id: r.publisher_display_name for r in upsert_metadata(old, new).collect()}
    assert merged == {"a": None, "b": "Q"}
    twice = new.withColumn("place", F.lit(1)).unionByName(new.withColumns({"place": F.lit(2), "publisher_display_name": F.lit("last")}))
    assert {r.unified_app_id: r.publisher_display_name for r in upsert_metadata(old, twice, "place").collect()}["a"] == "last"
    path = scratch_dir(spark)
    export_sorted(old, path, ["unified_app_id", "name"], [F.col("unified_app_id").desc()], single_file=True)
    assert [r.unified_app_id for r in spark.read.parquet(path).collect()] == ["b", "a"]
    ranges = spark.createDataFrame([(datetime.date(2024, 1, 15), datetime.date(2024, 6, 1))], "start date, end date")
    wanted = calendar.completed_months(ranges, "2024-04-30")
    assert [str(r.period_start) for r in wanted.orderBy("period_start").collect()] == ["2024-01-01", "2024-02-01", "2024-03-01"]
    wanted = wanted.withColumns({"scope_name": F.lit("a"), "cadence": F.lit("monthly")})
    stored = spark.createDataFrame(
        [("a", "monthly", datetime.date(2024, 2, 1)), ("b", "monthly", datetime.date(2024, 1, 1)), ("a", "weekly", datetime.date(2024, 3, 1))],
        "scope_name string, cadence string, period_start date",
    )
    assert calendar.missing_months(wanted, stored).count() == 2 and calendar.missing_months(wanted, stored, refresh=True).count() == 3


SCORE = (
    "scope_name string, cadence string, period_start date, period_end date, game_theme string, is_actionable boolean, exclusion_reason string,"
    " trend_rank int, trend_score double, confidence_score double, growth_score double, acceleration_score double, new_product_score double,"
    " concentration_penalty double, latest_product_count int, latest_product_share double, latest_units_absolute_share double,"
    " latest_revenue_absolute_share double, recent3_new_entry_share double, median_rank_improvement double, units_absolute_overindex double,"
    " revenue_absolute_overindex double, calculated_at timestamp"
)


def scores(spark, *themes):
    rows = [
        ("s", "monthly", datetime.date(2024, m, 1), datetime.date(2024, m, 28), t, True, None, 1, 50.0, 90.0, *[1.0] * 4, 7, *[0.1] * 3, 0.0, None, None, 1.0, datetime.datetime(2024, 5, 1))
        for m in (1, 2)
        for t in themes
    ]
    return spark.createDataFrame(rows, SCORE)


def test_reconciliation_plan(spark):
    desired = reconcile.desired_records(scores(spark, "A", "B", "C"))
    assert desired.where(is_managed_key(F.col("managed_key"))).count() == 6
    fields = [c for c in desired.columns if c.startswith("field_")]
    assert len(fields) == 21
    existing = desired.where("game_theme <> 'C'").select(
        F.concat(F.lit("r-"), "managed_key").alias("record_id"),
        F.col("managed_key").alias("primary_value"),
        *[F.when(F.col("game_theme") == "B", F.col(c) + 1e-8).otherwise(F.col(c) + 1e-10).alias(c) if c == "field_trend_score" else F.col(c) for c in fields],
    )
    blank = existing.limit(1).withColumn("primary_value", F.lit("  "))
    other = existing.limit(1).withColumn("primary_value", F.lit("note"))
    plan = reconcile.reconcile(desired.where("game_theme <> 'A' or period_start > '2024-01-15'"), existing.unionByName(blank).unionByName(other))
    counts = {r.action: r.row_count for r in reconcile.reconciliation_summary(plan, existing.unionByName(blank).unionByName(other)).collect()}
    assert counts == {"unchanged": 1, "update": 2, "create": 2, "stale": 1, "managed": 4, "unmanaged_blank": 1, "unmanaged_nonblank": 1}
    assert {r.changed for r in plan.where("action = 'update'").collect()} == {"trend_score"}
    doubled = reconcile.reconcile(desired, existing.unionByName(existing.where("primary_value = record_id or true").limit(1)))
    assert {r.action for r in doubled.collect()} == {"duplicate", "blocked"}


def test_managed_key_depends_on_every_identity_part(spark):
    one = scores(spark, "A", "A|")
    assert one.select(managed_key().alias("k")).distinct().count() == 4


@pytest.mark.parametrize("size, batches", [(1, 7), (3, 3), (7, 1), (1000, 1)])
def test_write_batches(spark, size, batches):
    df = spark.createDataFrame([(g, i) for g, n in (("a", 4), ("b", 3)) for i in range(n)], "g string, i int").repartition(3)
    got = reconcile.write_batches(df, ["g"], ["i"], size).orderBy("g", "i").collect()
    assert [r.batch_number for r in got] == [k // size + 1 for k in range(7)] and got[-1].batch_number == batches
    with pytest.raises(ValueError):
        reconcile.write_batches(df, ["g"], ["i"], 1001)


def test_broken_payloads_and_items_are_reported_and_not_selected(spark):
    good = '{"app_id": "1", "date": "2024-01-31T00:00:00Z", "units_absolute": 2, "custom_tags": {"Game Genre": "Puzzle"}}'
    payloads = [(1, f"[{good}, 7]"), (2, f"[{good}"), (3, "oops"), (4, good), (5, None), (6, "[]"), (7, f"[{good.replace('2,', chr(34) + 'two' + chr(34) + ',')}]")]
    documents = spark.createDataFrame(payloads, "response_id int, payload string")
    rejected = {(r.response_id, r.position, r.error) for r in market_json.rejected_market_rows(documents).collect()}
    assert rejected == {
        (1, 2, "not_an_object"), *((k, None, "invalid_payload") for k in (2, 3, 4, 5)), (7, 1, "malformed_field")
    }
    rows = market_json.parse_market_payloads(documents)
    assert {(r.response_id, r.position) for r in rows.collect()} == {(1, 1), (1, 2), (7, 1)}
    chosen = market_json.select_market_records(rows, ["response_id"], ["puzzle"], 5)
    assert [(r.response_id, r.rank_position, r.units_absolute) for r in chosen.collect()] == [(1, 1, 2.0)]


def test_input_rules_stop_the_run(spark):
    rows, meta = frames(
        spark,
        [snapshot((2024, m), "a", 1, "T", 1.0, -1.0 if m == 1 else 1.0) for m in (1, 2, 4)] + [snapshot((2024, 1), None, 2, "T", 1.0, 1.0)],
        [metadata("a", None)],
    )
    found = {(r.period_start.month, r.rule) for r in quality.input_violations(rows).collect()}
    assert found == {(1, "invalid_revenue"), (1, "product_without_id"), (4, "month_before_missing")}
    with pytest.raises(quality.InvalidInputError):
        Stages(spark, rows, meta).table("scores")
