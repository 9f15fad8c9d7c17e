import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from themelens.operators import ordering


def sample(seed=7, n=400):
    random.seed(seed)
    rows = []
    for i in range(n):
        group = "hot" if i % 3 else random.choice("abc")
        value = random.choice([None, 0.0, 5.0, round(random.lognormvariate(3, 2), 2), -random.random()])
        rows.append((i, group, value, random.randint(1, 9)))
    return pd.DataFrame(rows, columns=["id", "g", "v", "w"])


@pytest.mark.parametrize("gathered", [1 << 18, 150, 0])
@pytest.mark.parametrize("sizes", [None, "id >= 0"])
def test_quantiles_equal_pandas(spark, gathered, sizes):
    pdf = sample()
    df = spark.createDataFrame(pdf.astype(object).where(pdf.notna(), None), "id int, g string, v double, w int")
    got = ordering.quantiles(
        df,
        ["g"],
        {"v": F.col("v"), "w": F.col("w")},
        {"_p25": 0.25, "_p50": 0.5, "_p75": 0.75},
        sizes and df.where(sizes).groupBy("g").agg((2 * F.count("*")).alias("_n")),
        gathered,
    ).toPandas()
    want = pdf.groupby("g")[["v", "w"]].quantile([0.25, 0.5, 0.75])
    assert len(got) == pdf.g.nunique()
    for row in got.to_dict("records"):
        for name in ("v", "w"):
            for suffix, q in (("_p25", 0.25), ("_p50", 0.5), ("_p75", 0.75)):
                assert row[name + suffix] == pytest.approx(want.loc[(row["g"], q), name], abs=1e-9)


def test_a_group_without_values_keeps_its_row(spark):
    df = spark.createDataFrame([("a", None), ("a", None), ("b", 2.0), (None, 4.0)], "g string, v double")
    for gathered in (10, 1, 0):
        got = [(r.g, r.m) for r in ordering.quantiles(df, ["g"], {"m": F.col("v")}, {"": 0.5}, None, gathered).collect()]
        assert sorted(got, key=str) == sorted([("a", None), ("b", 2.0), (None, 4.0)], key=str)


def test_a_narrow_band_of_values_is_split(spark):
    """200,000 values in few logarithmic buckets: no part that is ordered holds more than a few hundred."""
    df = spark.range(200_000).select(F.lit("g").alias("g"), (100 + F.col("id") / 200_000).alias("v"))
    assert df.select(ordering.value_bucket(F.col("v"))).distinct().count() <= 4
    got = ordering.spread_quantiles(df, ["g"], {"v": F.col("v")}, {"_a": 0.25, "_b": 0.5}).first()
    assert (got.v_a, got.v_b) == (pytest.approx(100 + 0.25 * 199_999 / 200_000), pytest.approx(100 + 0.5 * 199_999 / 200_000))


def test_value_bucket_never_decreases(spark):
    values = sorted([-1e9, -3.5, -0.001, 0.0, 1e-9, 0.5, 1.0, 1.001, 2.0, 1e3, 1e3 + 1e-6, 1e12])
    df = spark.createDataFrame([(v,) for v in values], "v double").select("v", ordering.value_bucket(F.col("v")).alias("b"))
    buckets = [r.b for r in sorted(df.collect())]
    assert buckets == sorted(buckets)


@pytest.mark.parametrize("block", [1 << 20, 4])
def test_row_numbers_split_equal_values(spark, block):
    rows = [("m1", 7.0, i) for i in range(40)] + [("m1", float(i), 100 + i) for i in range(20)] + [("m2", 1.0, 3)]
    df = spark.createDataFrame(rows, "g string, v double, k bigint").repartition(5)
    got = ordering.position_by_value_desc(df, ["g"], "v", "k", "pos", tie_block=block).collect()
    want = sorted(rows, key=lambda r: (r[0], -r[1], r[2]))
    ordered = [(r.g, r.v, r.k) for r in sorted(got, key=lambda r: (r.g, r.pos))]
    assert ordered == want
    assert sorted(r.pos for r in got if r.g == "m1") == list(range(1, 61))


def test_percentiles_average_ties_and_single_rows(spark):
    df = spark.createDataFrame(
        [("m", "a", 1.0, 3.0), ("m", "b", 1.0, None), ("m", "c", 5.0, None), ("n", "d", 2.0, 1.0)],
        "p string, t string, x double, y double",
    )
    got = {
        r.t: (r.x, r.y)
        for r in ordering.average_rank_percentiles(
            df, ["p"], ["p", "t"], {"x": F.col("x"), "y": F.col("y")}, scale=100.0
        ).collect()
    }
    assert got == {"a": (25.0, 50.0), "b": (25.0, None), "c": (100.0, None), "d": (50.0, 50.0)}


def test_top_rows_limits_before_the_shuffle(spark):
    df = spark.range(1000).select((F.col("id") % 2).alias("g"), F.col("id").alias("v"))
    top = ordering.top_rows(df, ["g"], [F.col("v").desc()], 3, "r")
    plan = top._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2 and "Partial" in plan
    assert sorted((r.g, r.v) for r in top.collect()) == [(0, 994), (0, 996), (0, 998), (1, 995), (1, 997), (1, 999)]


def test_few_rows_of_a_large_group_are_left_to_be_sorted(spark):
    df = spark.range(100_000).select(
        F.when(F.col("id") % 100 > 0, F.lit("hot")).alias("g"),
        (F.col("id") * 7919 % 100_003).cast("double").alias("v"),
        F.when(F.col("id") % 1000 == 5, F.col("id")).alias("w"),
        F.when(F.col("id") < 2, 1).alias("few"),
    )
    values = {name: F.col(name) for name in ("v", "w", "few")}
    near = ordering.leading_values(df, ["g"], values, 5).cache()
    assert near.count() < 100
    for name in values:
        for group in ("hot", None):
            top = lambda rows, c: [r[0] for r in rows.where(F.col("g").eqNullSafe(group)).select(c).dropna().orderBy(F.desc(c)).limit(5).collect()]  # noqa: B023, E731
            assert top(near, f"_top_{name}") == top(df, name)


@pytest.mark.parametrize("gathered", [1 << 18, 150, 0])
def test_medians_by_label_equal_pandas_and_shuffle_a_row_once(spark, gathered):
    """Two label columns, NULL labels, labels and groups without a value; groups above and below the limit."""
    pdf = sample().assign(x=lambda f: ["a" if i % 4 else None for i in f.id], y=lambda f: [f"y{i % 3}" for i in f.id])
    pdf.loc[pdf.y == "y2", "v"] = None
    df = spark.createDataFrame(pdf.astype(object).where(pdf.notna(), None), "id int, g string, v double, w int, x string, y string")
    values = {"v": F.col("v"), "w": F.col("w")}
    found = ordering.label_medians(df, ["g"], ["x", "y"], values, None, gathered)
    if gathered == 1 << 18:
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "Generate" not in plan and plan.count("Exchange") == 1
    got = {(r.g, r.dimension_type, r.dimension_value, n): r[n] for r in found.collect() for n in values}
    want = {
        (group, label, value, n): None if rows[n].isna().all() else rows[n].median()
        for label in ("x", "y")
        for (group, value), rows in pdf.dropna(subset=[label]).groupby(["g", label])
        for n in values
    }
    assert None in want.values() and got == pytest.approx(want)
    whole = {r.g: r.v for r in ordering.label_medians(df, ["g"], (), {"v": F.col("v")}, None, gathered).collect()}
    assert whole == pytest.approx(pdf.groupby("g").v.median().to_dict())
