"""Guarded ratios, tolerant comparison and interval expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from themelens.constants import WILSON_Z


def total(value: Column) -> Column:
    """Sum that stays NULL over no covered row.

    A distributed float sum depends on the order in which partial sums meet. Rounding to six decimals
    makes money and unit totals repeatable, so ties in later rankings do not move between runs.
    """
    return F.round(F.sum(value), 6)


def count_where(condition: Column) -> Column:
    return F.count(F.when(condition, F.lit(1)))


def share(part: Column, whole: Column) -> Column:
    """part / whole, NULL when the denominator is NULL or zero."""
    return F.when(whole != 0, part.cast("double") / whole)


def positive_share(part: Column, whole: Column) -> Column:
    """part / whole, NULL unless the denominator is above zero."""
    return F.when(whole > 0, part.cast("double") / whole)


def is_close(left: Column, right: Column, relative: float = 1e-9, absolute: float = 1e-12) -> Column:
    bound = F.greatest(F.lit(relative) * F.greatest(F.abs(left), F.abs(right)), F.lit(absolute))
    return F.abs(left - right) <= bound


def is_positive_change(value: Column) -> Column:
    return (value > 0) & ~is_close(value, F.lit(0.0))


def mean_of_available(*values: Column) -> Column:
    """Mean of the non-NULL arguments."""
    present = F.filter(F.array(*values), lambda item: item.isNotNull())
    added = F.aggregate(present, F.lit(0.0), lambda acc, item: acc + item)
    return F.when(F.size(present) > 0, added / F.size(present))


def wilson_bounds(successes: Column, trials: Column) -> tuple[Column, Column]:
    """Wilson score interval clamped to 0..1; NULL when there are no trials."""
    n = trials.cast("double")
    rate = successes / n
    z2 = WILSON_Z * WILSON_Z
    scale = 1 + F.lit(z2) / n
    centre = rate + F.lit(z2) / (2 * n)
    margin = F.lit(WILSON_Z) * F.sqrt((rate * (1 - rate) + F.lit(z2) / (4 * n)) / n)
    usable = (trials > 0) & successes.isNotNull()
    return (
        F.when(usable, F.greatest(F.lit(0.0), (centre - margin) / scale)),
        F.when(usable, F.least(F.lit(1.0), (centre + margin) / scale)),
    )


def first_match(*rules: tuple[Column, object], otherwise: object = None) -> Column:
    """Ordered rule list: value of the first rule whose condition holds."""
    expression = None
    for condition, value in rules:
        branch = value if isinstance(value, Column) else F.lit(value)
        expression = F.when(condition, branch) if expression is None else expression.when(condition, branch)
    return expression.otherwise(otherwise if isinstance(otherwise, Column) else F.lit(otherwise))
