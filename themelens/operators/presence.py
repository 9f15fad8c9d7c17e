"""Which tables hold a key: one bit a table, combined by key, and every "a without b" rule read off the mask.

All tables that share a key are shuffled once, by that key, and combine their bits before the shuffle; further rules
cost no further join.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from themelens.functions.numeric import count_where


def presence(tables: Mapping[str, DataFrame], keys: Sequence[str]) -> DataFrame:
    """``keys`` and ``mask``: bit k is set if the k-th table has the key. Keys with NULLs are keys like others."""
    if len(tables) > 63:
        raise ValueError("a mask has 63 bits")
    marked = [rows.select(*keys, F.lit(1 << bit).alias("mask")) for bit, rows in enumerate(tables.values())]
    return reduce(DataFrame.unionByName, marked).groupBy(*keys).agg(F.bit_or("mask").alias("mask"))


def without(tables: Sequence[str], present: str, absent: str) -> Column:
    """Condition on ``mask``: the key is in one table and not in the other."""
    names = list(tables)
    one, other = 1 << names.index(present), 1 << names.index(absent)
    return F.col("mask").bitwiseAND(one | other) == one


def rule_counts(rows: DataFrame, rules: Mapping[str, Column]) -> DataFrame:
    """(rule, row_count) of the rows that meet each condition, in one pass."""
    counts = rows.agg(*[count_where(condition).alias(rule) for rule, condition in rules.items()])
    entries = F.array(*[F.struct(F.lit(rule).alias("rule"), F.col(f"`{rule}`").alias("row_count")) for rule in rules])
    return counts.select(F.explode(entries).alias("_rule")).select("_rule.*")


def missing_keys(tables: Mapping[str, DataFrame], keys: Sequence[str], rules: Mapping[str, tuple[str, str]]) -> DataFrame:
    """(rule, number of distinct keys) for rules of the form (table with the key, table without it)."""
    masks = presence(tables, keys)
    return rule_counts(masks, {rule: without(list(tables), *pair) for rule, pair in rules.items()})


def mixed_stamps(tables: Sequence[DataFrame], rule: str = "more_than_one_calculated_at") -> DataFrame:
    """(rule, number of series) whose rows, over all tables together, do not have one ``calculated_at``; NULL is one."""
    stamps = [rows.select("scope_name", "cadence", "calculated_at") for rows in tables]
    series = (
        reduce(DataFrame.unionByName, stamps)
        .groupBy("scope_name", "cadence")
        .agg(
            F.min("calculated_at").alias("_first"),
            F.max("calculated_at").alias("_last"),
            count_where(F.col("calculated_at").isNull()).alias("_none"),
        )
    )
    return rule_counts(series, {rule: (F.col("_first") != F.col("_last")) | ((F.col("_none") > 0) & F.col("_first").isNotNull())})
