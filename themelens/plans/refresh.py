"""The range run: bring stored stage tables up to date for changed months, computing no more than those reach.

``REACH`` tells for each stage how many months of an input lie behind and ahead of an output month that is computed from
them. A changed month of the input makes stale what lies so many months after and before it; closed over the stages, that is
what a refresh recomputes. Each stage reads only the input months of its stale periods (folders of other months are not
opened) and replaces these periods.
"""

from __future__ import annotations

import datetime
from collections import defaultdict
from collections.abc import Collection, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from themelens.constants import HORIZONS, OUTCOME_HORIZONS, PERIOD
from themelens.operators import model
from themelens.plans.stages import Stages
from themelens.session import scratch_dir
from themelens.sources.store import Period, PeriodTable, only_periods, replace_range

#: Months without end.
ALWAYS = 10_000
WINDOW = max(HORIZONS) - 1
FUTURE = max(OUTCOME_HORIZONS)

#: stage: {input: (months behind, months ahead)}, in the order of computation.
REACH: dict[str, dict[str, tuple[int, int]]] = {
    "totals": {"snapshots": (0, 0)},
    "themes": {"snapshots": (1, 0), "totals": (0, 0)},
    "top_ten": {"snapshots": (0, 0)},
    "structure": {"snapshots": (0, 0), "totals": (0, 0), "top_ten": (0, 0)},
    "growth": {"snapshots": (1, 0), "top_ten": (1, 0)},
    "dimensions": {"snapshots": (1, 0), "totals": (0, 0), "themes": (0, 0)},
    "leaders": {"snapshots": (1, 0)},
    "scores": {"totals": (5, 0), "themes": (5, 0)},
    "horizons": {"totals": (WINDOW, 0), "structure": (WINDOW, 0)},
    "seasonality": {"totals": (WINDOW, 0), "structure": (WINDOW, 0)},
    # The first active month and the active months to date look back to the first month.
    "summaries": {"structure": (ALWAYS, 0), "horizons": (0, 0), "seasonality": (0, 0)},
    "outcomes": {
        "totals": (0, FUTURE),
        "structure": (0, FUTURE),
        "growth": (0, 0),
        "scores": (0, 0),
        "summaries": (0, 0),
        "seasonality": (0, 0),
    },
}
#: Stages whose periods carry another name.
RENAMED = {"outcomes": {"period_start": "decision_period_start", "period_end": "decision_period_end"}}


def shifted(period: Period, months: int) -> Period:
    start = datetime.date.fromisoformat(str(period[2]))
    index = start.year * 12 + start.month - 1 + months
    first = datetime.date(index // 12, index % 12 + 1, 1)
    after = datetime.date((index + 1) // 12, (index + 1) % 12 + 1, 1)
    return (*period[:2], str(first), str(after - datetime.timedelta(days=1)))


def reached(changed: Collection[Period], behind: int, ahead: int, known: Collection[Period]) -> set[Period]:
    """The known periods that read a changed one of the same scope and cadence within the given distance."""
    months: dict[tuple, list[int]] = defaultdict(list)

    def index(period: Period) -> int:
        return int(str(period[2])[:4]) * 12 + int(str(period[2])[5:7])

    for period in changed:
        months[tuple(period[:2])].append(index(period))
    return {
        p for p in known if any(-ahead <= index(p) - m <= behind for m in months.get(tuple(p[:2]), ()))
    }


def stale_periods(changed: Iterable[Period], known: Iterable[Period]) -> dict[str, set[Period]]:
    """For the changed months of ``snapshots``: the periods to recompute of each stage. Months times scopes, no data.

    If the first month of a scope is among the changed ones, the model's month numbers move: all its months are stale.
    """
    changed = {tuple(map(str, p)) for p in changed}
    known = {tuple(map(str, p)) for p in known} | changed
    stale = {"snapshots": changed}
    first = {scope: min(p for p in known if p[:2] == scope) for scope in {p[:2] for p in known}}
    moved = {scope for scope, period in first.items() if period in changed}
    for stage, inputs in REACH.items():
        found: set[Period] = set()
        for name, (behind, ahead) in inputs.items():
            found |= reached(stale[name], behind, ahead, known)
        if stage in ("horizons", "seasonality"):
            found |= {p for p in known if p[:2] in moved}
        stale[stage] = found
    return stale


class _Part(Stages):
    """Stages over some months of the inputs; the whole input has been validated before."""

    def require_valid_input(self) -> None:
        return


class RangeRun:
    """Stage tables partitioned by period below one folder.

    ``load`` writes the tables of a whole run the first time. ``refresh`` takes new rows of some months.
    """

    def __init__(self, spark: SparkSession, metadata: DataFrame, root: str | None = None):
        self.spark, self.metadata = spark, metadata
        self.root = root or scratch_dir(spark)
        self._stored: dict[str, PeriodTable] = {}
        self._known: set[Period] = set()

    def load(self, run: Stages, stages: Iterable[str]) -> None:
        for name in ("snapshots", *stages):
            rows = self._keyed(name, run.table(name))
            self._stored[name] = PeriodTable(self.spark, f"{self.root}/{name}", rows.schema)
            self._stored[name].write(rows)

    def _keyed(self, name: str, rows: DataFrame) -> DataFrame:
        return rows.withColumnsRenamed({own: period for period, own in RENAMED.get(name, {}).items()})

    def table(self, name: str, periods: Collection[Period] | None = None) -> DataFrame:
        return self._stored[name].read(periods).withColumnsRenamed(RENAMED.get(name, {}))

    def refresh(self, snapshots: DataFrame, changed: Collection[Period]) -> dict[str, set[Period]]:
        """Replace the changed months of the snapshots, then the stale periods of every loaded stage, in order.

        Returns what was recomputed. A refresh that fails half-way is repeated: it replaces the same periods again.
        """
        store = self._stored["snapshots"]
        fresh = scratch_dir(self.spark)
        snapshots.write.parquet(fresh)
        before = store.periods()
        replace_range({store: self.spark.read.schema(snapshots.schema).parquet(fresh)}, changed)
        self._known = set(store.periods())
        stale = stale_periods(changed, {*before, *self._known})
        for name in [stage for stage in REACH if stage in self._stored]:
            if stale[name]:
                replace_range({self._stored[name]: self._computed(name, stale[name])}, stale[name])
        return {name: stale[name] for name in self._stored}

    def _computed(self, name: str, periods: set[Period]) -> DataFrame:
        """The stored rows of a stage's stale periods, from the input months that they read."""
        part = _Part(self.spark, self._needed("snapshots", name, periods), self.metadata)
        for source in REACH[name]:
            if source != "snapshots":
                part.hold(source, self._needed(source, name, periods))
        if name in ("horizons", "seasonality", "summaries"):
            # Month numbers and activity need every month of the small theme-month table, the windows behind it do not.
            grid = model.model_grid(self.table("totals"), self.table("structure"))
            part.hold("grid", only_periods(grid, self._window(name, periods)))
        rows = self._keyed(name, part.table(name))
        return only_periods(rows, periods)

    def _window(self, name: str, periods: set[Period]) -> set[Period]:
        if name == "summaries":
            return periods
        return reached(periods, 0, WINDOW, self._known)

    def _needed(self, source: str, name: str, periods: set[Period]) -> DataFrame:
        if source not in REACH[name]:
            return self.table(source)
        behind, ahead = REACH[name][source]
        return self.table(source, reached(periods, ahead, behind, self._known))


def summary(spark: SparkSession, stale: dict[str, set[Period]]) -> DataFrame:
    """(stage_name, period) of everything recomputed."""
    rows = [(name, *map(str, period)) for name, periods in stale.items() for period in periods]
    listed = spark.createDataFrame(rows, "stage_name string, scope_name string, cadence string, s string, e string")
    return listed.select(
        "stage_name", "scope_name", "cadence", F.col("s").cast("date").alias(PERIOD[2]), F.col("e").cast("date").alias(PERIOD[3])
    )
