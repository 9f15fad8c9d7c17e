"""Value rules counted during the write, and the presence masks of the tables' keys."""

import re
import threading
import time
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from builders import frames, metadata, snapshot
from themelens.operators import opportunity, presence, quality, rules
from themelens.plans import queries
from themelens.plans.queries import CHECKED_TABLES
from themelens.plans.stages import Stages
from themelens.session import scratch_dir
from themelens.sources import driver_tables


@pytest.fixture(scope="module")
def tables(spark):
    facts = [
        snapshot((2024, month), f"a{k}", k + 1, "T" if k % 2 else "U", 10.0 * k, 5.0 + k, subgenre="g", released=None)
        for month in (1, 2, 3)
        for k in range(month - 1, 8)
    ]
    rows, names = frames(spark, facts, [metadata(f"a{k}", f"p{k % 3}") for k in range(8)])
    return Stages(spark, rows, names, check_values=True)


def test_own_tables_keep_every_rule(tables):
    for name in ("snapshots", "totals", "themes", "structure", "growth", "dimensions", "leaders", "proxies"):
        assert rules.value_rules(name, tables.table(name).columns)


@pytest.mark.parametrize("name", ["totals", "themes", "structure", "growth", "dimensions"])
def test_every_rule_is_seen_broken(spark, tables, name):
    rows = tables.table(name)
    own = rules.value_rules(name, rows.columns)
    faulty = rules.with_faults(rows, own, F.month("period_start") >= 2)
    found = rules.write_checked(
        faulty,
        f"{scratch_dir(spark)}/t",
        {rule.name: rules.broken(rule, F.col("fault_rule") == rule.name) for rule in own},
    )
    assert len({rule.name for rule in own}) == len(own)
    empty = {name for name, number in found.items() if not number}
    # Products without a release date have no ages, so there is nothing to compare.
    assert all(name.startswith(("release_date", "median_product_age")) for name in empty), empty


def test_a_broken_row_stops_the_run(spark, tables):
    rows = tables.table("themes").withColumn("product_share", F.lit(1.5))
    with pytest.raises(rules.ValueRuleError) as error:
        rules.write_valid(rows, f"{scratch_dir(spark)}/t", "themes")
    assert error.value.args == ("themes", {"product_share_between": rows.count()})


def test_no_rows_break_nothing(spark, tables):
    rules.write_valid(tables.table("growth").limit(0), f"{scratch_dir(spark)}/t", "growth")


def test_presence_masks_tell_every_missing_key(spark):
    tables = {
        "a": spark.createDataFrame([(1,), (1,), (2,), (None,)], "k int"),
        "b": spark.createDataFrame([(2,), (3,)], "k int"),
        "c": spark.createDataFrame([], "k int"),
    }
    pairs = {"a_b": ("a", "b"), "b_a": ("b", "a"), "b_c": ("b", "c"), "c_a": ("c", "a")}
    found = presence.missing_keys(tables, ["k"], pairs)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert {row.rule: row.row_count for row in found.collect()} == {"a_b": 2, "b_a": 1, "b_c": 2, "c_a": 0}
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan


def test_one_stamp_a_series(spark):
    schema = "scope_name string, cadence string, calculated_at timestamp"
    first = spark.createDataFrame([("s", "monthly", None), ("t", "monthly", None)], schema)
    stamped = first.withColumn("calculated_at", F.lit("2024-01-01").cast("timestamp"))
    late = stamped.where("scope_name = 't'").withColumn("calculated_at", F.lit("2024-01-02").cast("timestamp"))
    for tables, number in (([first], 0), ([stamped], 0), ([stamped, late], 1), ([stamped, first], 2), ([first.limit(0)], 0)):
        assert presence.mixed_stamps(tables).first().row_count == number


def test_a_stage_is_built_once_however_many_threads_ask(spark):
    built = []

    class Counted(Stages):
        def _months(self):
            built.append(1)
            time.sleep(0.3)
            return self.snapshots.select("period_start").distinct()

    run = Counted(spark, *frames(spark, [snapshot((2024, 1), "a", 1, "T", 1.0, 1.0)], [metadata("a", None)]))
    with ThreadPoolExecutor(4) as pool:
        found = [future.result().count() for future in [pool.submit(run.table, "months") for _ in range(4)]]
    assert found == [1] * 4 and len(built) == 1


def test_checked_profiles_are_written_once_with_their_faults(tables):
    build, columns, _ = CHECKED_TABLES["profiles"]
    assert build(tables).select(*columns.split()).count() == tables.snapshots.count()
    assert "profiles" not in tables._tables


def test_tables_are_checked_at_the_same_time(spark, tables, monkeypatch):
    met = threading.Barrier(2, timeout=60)

    def build(run):
        met.wait()
        return run.totals

    # The second name has no rules of its own besides those of its columns.
    pair = {name: (build, queries.TOTAL_COLUMNS, "") for name in ("totals", "second")}
    monkeypatch.setattr(queries, "CHECKED_TABLES", pair)
    rows = queries._value_checks(tables).collect()
    assert {r.table_name for r in rows} == {"totals", "second"}
    assert {r.row_count for r in rows if r.source == "stored"} == {0}


def test_input_rules_scan_the_rows_three_times(spark, tables):
    plan = quality.input_violations(tables.snapshots)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [") == 3


def test_rules_of_one_pass_keep_their_counts(spark):
    facts = [snapshot((2024, m), f"a{k}", k - 1, "T", 1.0, -1.0 if k else None) for m in (1, 2, 5) for k in range(3)]
    rows, _ = frames(spark, facts, [])
    other = F.when((F.month("period_start") == 2) & (F.col("rank_position") == 0), "other").otherwise(F.col("data_model"))
    late = F.when(F.month("period_start") == 5, F.date_sub("period_end", 1)).otherwise(F.col("period_end"))
    found = quality.input_violations(rows.withColumns({"data_model": other, "period_end": late}))
    counts = {(r.period_start.month, r.rule): r.row_count for r in found.collect()}
    assert counts == {
        **{(m, "rank_not_positive"): 2 for m in (1, 2, 5)}, **{(m, "invalid_revenue"): 2 for m in (1, 2, 5)},
        (2, "mixed_provenance"): 1, (5, "not_a_natural_month"): 3, (5, "month_before_missing"): 1,
    }


def test_parts_are_merged_and_line_items_read_for_the_rank_alone(spark):
    plan = driver_tables.market_snapshots(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"SortMergeJoin \[l_partkey#\d+L\], \[p_partkey#", plan)
    # Once for the rows, twice for the offsets of the rank.
    assert plan.count("FileScan parquet [l_") == 3


def test_publisher_rows_of_dimensions_are_shuffled_before_their_labels(spark, tables):
    plan = opportunity.dimension_metrics(tables.facts, tables.totals, tables.themes)
    text = plan._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression" in text
