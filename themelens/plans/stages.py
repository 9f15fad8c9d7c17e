"""Stage order of the analytics run, with every stage kept as a table.

Later stages read many earlier results several times. Each stage is therefore written once to the shared
scratch folder and read back: the lineage stays short, plans stay small, a lost executor costs one stage,
and every reader prunes to the columns it needs.
"""

from __future__ import annotations

import threading
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from themelens.operators import backtest, calendar, decision, model, monthly, opportunity, proxy, quality, rules, trend
from themelens.session import scratch_dir


class Stages:
    """Lazily written stage tables over one snapshot and one metadata relation.

    With ``check_values`` the value rules of each table are counted during its write, and a broken one stops the run.
    Threads may ask for tables at the same time: each is written by the first that asks, the others wait for it.
    """

    def __init__(
        self,
        spark: SparkSession,
        snapshots: DataFrame,
        metadata: DataFrame,
        root: str | None = None,
        source: str = "",
        check_values: bool = False,
    ):
        self.spark = spark
        self.source = source
        self.root = root or scratch_dir(spark)
        self.check_values = check_values
        self._sources = {"snapshots": snapshots, "metadata": metadata}
        self._tables: dict[str, DataFrame] = {}
        self._locks: dict[str, threading.Lock] = {}

    def table(self, name: str) -> DataFrame:
        # A stage asks only for stages before it, so waiting threads cannot wait for each other.
        with self._locks.setdefault(name, threading.Lock()):
            if name not in self._tables:
                path = f"{self.root}/{name}"
                build = self._sources[name] if name in self._sources else getattr(self, f"_{name}")()
                if self.check_values:
                    rules.write_valid(build, path, name)
                else:
                    build.write.mode("overwrite").parquet(path)
                self._tables[name] = self.spark.read.parquet(path)
            return self._tables[name]

    def hold(self, name: str, rows: DataFrame) -> None:
        """Take ``rows`` as the table of a stage instead of computing it."""
        self._tables[name] = rows

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.table(name)

    # AGG: monthly totals, theme metrics, opportunity evidence.
    def _facts(self) -> DataFrame:
        return monthly.product_facts(self.snapshots, self.metadata, calendar.stored_months(self.snapshots))

    def _violations(self) -> DataFrame:
        return quality.input_violations(self.snapshots)

    def require_valid_input(self) -> None:
        """Stop with the violations if the snapshots break a rule that scores, models and classes rely on."""
        found = self.violations.limit(20).collect()
        if found:
            raise quality.InvalidInputError(found)

    def _totals(self) -> DataFrame:
        return monthly.monthly_market_totals(self.facts)

    def _publishers(self) -> DataFrame:
        return monthly.publisher_totals(self.facts)

    def _middles(self) -> DataFrame:
        return monthly.theme_medians(self.facts)

    def _themes(self) -> DataFrame:
        return monthly.theme_monthly_metrics(self.facts, self.totals, self.publishers, self.middles)

    def _top_ten(self) -> DataFrame:
        return opportunity.leaders(self.facts)

    def _structure(self) -> DataFrame:
        return opportunity.market_structure(self.facts, self.totals, self.top_ten, self.publishers, self.middles)

    def _growth(self) -> DataFrame:
        return opportunity.growth_sources(self.facts, self.top_ten)

    def _dimensions(self) -> DataFrame:
        return opportunity.dimension_metrics(self.facts, self.totals, self.themes)

    def _leaders(self) -> DataFrame:
        return opportunity.representative_leaders(self.facts)

    # Score and model.
    def _scores(self) -> DataFrame:
        self.require_valid_input()
        return trend.trend_scores(self.totals, self.themes)

    def _grid(self) -> DataFrame:
        self.require_valid_input()
        return model.model_grid(self.totals, self.structure)

    def _horizons(self) -> DataFrame:
        return model.horizon_metrics(self.grid)

    def _seasonality(self) -> DataFrame:
        return model.seasonality_profiles(self.grid)

    def _summaries(self) -> DataFrame:
        return model.model_summaries(self.grid, self.horizons, self.seasonality)

    # Backtest.
    def _outcomes(self) -> DataFrame:
        return backtest.launch_window_outcomes(
            self.totals, self.structure, self.growth, self.scores, self.summaries, self.seasonality
        )

    def _ranked_pairs(self) -> DataFrame:
        return backtest.ranked_pairs(backtest.feature_pairs(self.outcomes))

    def _feature_metrics(self) -> DataFrame:
        return backtest.feature_metrics(self.outcomes, self.totals, self.table("ranked_pairs"))

    def _segment_metrics(self) -> DataFrame:
        return backtest.segment_metrics(self.outcomes, self.totals)

    # Proxy and decisions.
    def _profiles(self) -> DataFrame:
        self.require_valid_input()
        return proxy.product_revenue_profiles(self.snapshots)

    def _proxies(self) -> DataFrame:
        self.require_valid_input()
        return proxy.theme_proxy_metrics(self.snapshots)

    def _fits(self) -> DataFrame:
        return decision.category_fits(self.summaries, self.dimensions, self.leaders)

    def _assessed(self) -> DataFrame:
        population = decision.decision_population(
            self.structure, self.summaries, self.growth, self.proxies, self.scores
        )
        return decision.assess(population, self.fits)


_RUNS: dict[tuple[str, str], Stages] = {}


def run_for(spark: SparkSession, source: str, build: Callable[[], tuple[DataFrame, DataFrame]]) -> Stages:
    """The run of this application over ``source``; its stage tables are shared by all callers."""
    key = (spark.sparkContext.applicationId, source)
    if key not in _RUNS:
        _RUNS[key] = Stages(spark, *build(), source=source)
    return _RUNS[key]
