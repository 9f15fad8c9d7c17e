"""The range run: what a changed month reaches, and that recomputing only that equals the full run."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from tests.builders import frames, metadata, snapshot
from themelens.plans import refresh
from themelens.plans.stages import Stages


def month(k: int, scope: str = "market") -> tuple:
    return refresh.shifted((scope, "monthly", "2020-01-01", "2020-01-31"), k)


def test_months_shift_over_years():
    assert month(1)[2:] == ("2020-02-01", "2020-02-29") and month(-1)[2:] == ("2019-12-01", "2019-12-31")


def test_a_change_reaches_as_far_as_the_stages_look():
    known = [month(k) for k in range(60)] + [month(k, "other") for k in range(60)]
    stale = refresh.stale_periods([month(10)], known)
    reach = {name: (months[0], months[-1]) for name, months in ((n, sorted(int(p[2][:4]) * 12 + int(p[2][5:7]) - 1 - 2020 * 12 for p in s)) for n, s in stale.items())}
    assert reach == {
        "snapshots": (10, 10), "totals": (10, 10), "themes": (10, 11), "top_ten": (10, 10), "structure": (10, 10), "growth": (10, 11),
        "dimensions": (10, 11), "leaders": (10, 11), "scores": (10, 16), "horizons": (10, 45), "seasonality": (10, 45),
        "summaries": (10, 59), "outcomes": (7, 59),
    }
    assert all(p[0] == "market" for periods in stale.values() for p in periods)


def test_a_new_first_month_moves_every_month_of_the_model():
    stale = refresh.stale_periods([month(-1)], [month(k) for k in range(60)])
    assert len(stale["horizons"]) == len(stale["seasonality"]) == 61 and len(stale["scores"]) == 7


def test_the_end_of_a_series_is_not_passed():
    stale = refresh.stale_periods([month(59)], [month(k) for k in range(60)])
    assert stale["themes"] == {month(59)} and stale["outcomes"] == {month(k) for k in range(56, 60)}


def test_recomputing_the_stale_months_equals_the_full_run(spark):
    rng = random.Random(5)
    rows = [
        snapshot((2023 + k // 12, k % 12 + 1), f"a{i}", i + 1, rng.choice("TUV"), float(rng.randrange(90)), float(rng.randrange(90)))
        for k in range(9)
        for i in range(8)
    ]
    snapshots, meta = frames(spark, rows, [metadata(f"a{i}", f"p{i % 3}") for i in range(7)])
    there = F.col("period_start").isin("2023-03-01", "2023-04-01")
    # April is replaced by other numbers, March has no rows of one label any more.
    changed = snapshots.where(there & (F.col("game_theme") != "T")).withColumn("units_absolute", 3 * F.col("units_absolute"))
    changed = changed.unionByName(snapshots.where((F.col("period_start") == "2023-04-01") & (F.col("game_theme") == "T")))
    stages = ("totals", "themes", "top_ten", "structure", "growth", "scores")
    run = refresh.RangeRun(spark, meta)
    run.load(Stages(spark, snapshots, meta), stages)
    periods = [tuple(r) for r in snapshots.where(there).select("scope_name", "cadence", "period_start", "period_end").distinct().collect()]
    stale = run.refresh(changed, periods)
    assert len(stale["themes"]) == 3 and len(stale["scores"]) == 7
    full = Stages(spark, snapshots.where(~there).unionByName(changed), meta)
    full.require_valid_input = lambda: None  # a label's rows are gone, ranks have holes
    for name in stages:
        own, whole = run.table(name), full.table(name)
        assert own.columns == whole.columns and own.exceptAll(whole).isEmpty() and whole.exceptAll(own).isEmpty(), name
