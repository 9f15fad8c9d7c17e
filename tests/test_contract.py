import os

import duckdb
import pytest

import __spark_entry__ as contract
from themelens.plans.oracle import column_expression
from themelens.plans.queries import QUERIES
from tools.compare import difference

SF = "/root/testdata/sf0.001"
CHECKED = [
    "market_snapshots",
    "theme_monthly_metrics",
    "growth_sources",
    "representative_leaders",
    "trend_scores",
    "model_summaries",
    "backtest_feature_metrics",
    "decision_risks",
    "month_quality",
    "select_market_records",
    "replace_range",
    "reconcile",
]


def test_every_query_has_reference_sql():
    assert set(QUERIES) <= set(contract.oracle_sql()) <= set(contract.queries())
    assert set(contract.corpus_queries()[0]) == set(contract.queries()) - set(QUERIES)


def test_column_kinds():
    assert column_expression("product_count").endswith("::BIGINT AS product_count")
    assert column_expression("game_theme") == "game_theme"
    assert column_expression("product_share").startswith("floor(")


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables not present")
@pytest.mark.parametrize("name", CHECKED)
def test_query_equals_reference(spark, name):
    db = duckdb.connect()
    for file in os.listdir(SF):
        db.execute(f"CREATE VIEW {file.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{file}'")
    ours = contract.queries()[name](spark, SF).toPandas()
    theirs = db.execute(contract.oracle_sql()[name]).df()
    assert difference(ours, theirs) is None
