"""Ordering inside groups of any size.

A plain window over (month) or (month, theme) sends the whole group to one task, and one month or one
theme may hold a third of all rows. The operators here split a group into value buckets first, so the
largest unit of work is one bucket, and only bucket counts are ordered per group.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

BUCKETS_PER_E_FOLD = 256

#: Parts into which a bucket that holds a wanted position is cut.
CELLS = 4096

#: Rows of a group up to which its values are gathered in one aggregation buffer.
GATHERED = 1 << 18


def value_bucket(value: Column) -> Column:
    """Non-decreasing bucket number: logarithmic, so heavy-tailed measures spread evenly.

    The formula uses no data-dependent bounds; recomputed tasks always agree on it, and a group has at
    most a few tens of thousands of buckets over the whole double range that counts and money can take.
    """
    magnitude = F.floor(F.log1p(F.abs(value)) * BUCKETS_PER_E_FOLD).cast("int")
    return F.when(value < 0, -magnitude).otherwise(magnitude)


def top_rows(df: DataFrame, keys: Sequence[str], order: Sequence[Column], limit: int, name: str) -> DataFrame:
    """First ``limit`` rows per group with their position.

    Spark plans this as a group limit before and after the shuffle, so every map task forwards at most
    ``limit`` rows of a group and a hot group never meets in one place.
    """
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(name, F.row_number().over(window)).where(F.col(name) <= limit)


def leading_values(df: DataFrame, keys: Sequence[str], values: Mapping[str, Column], limit: int) -> DataFrame:
    """``df`` with a column ``_top_<name>`` for each value: NULL where ``limit`` rows of the group are surely larger. Rows
    without any are left out, so what is sorted afterwards is little more than ``limit`` rows of a group, ties aside.

    A group is dealt into parts by a hash of its values; the parts' greatest values belong to different rows, so the
    ``limit``-th of them is at most the ``limit``-th value of the group. The parts are aggregated without a sort. The bounds
    are a row for each group, however many rows it has, so they are broadcast.
    """
    names = list(values)
    cast = {name: value.cast("double") for name, value in values.items()}
    part = F.pmod(F.xxhash64(*cast.values()), F.lit(4 * limit)).alias("_part")
    parts = df.select(*keys, part, *[cast[n].alias(n) for n in names]).groupBy(*keys, "_part").agg(*[F.max(n).alias(n) for n in names])
    bounds = parts.groupBy(*keys).agg(*[F.get(F.sort_array(F.collect_list(n), False), F.lit(limit - 1)).alias(n) for n in names])
    bounds = bounds.select(F.struct(*keys).alias("_group"), *[F.col(n).alias(f"_least_{n}") for n in names])
    # Structs with equal fields are equal, NULL fields included.
    joined = df.join(F.broadcast(bounds), F.struct(*keys) == F.col("_group"), "left")
    tops = {f"_top_{n}": F.when(F.coalesce(cast[n] >= F.col(f"_least_{n}"), F.lit(True)), cast[n]) for n in names}
    some = F.coalesce(*[F.col(name) for name in tops]).isNotNull()
    return joined.withColumns(tops).where(some).drop("_group", *[f"_least_{n}" for n in names])


def quantiles(
    df: DataFrame,
    keys: Sequence[str],
    values: Mapping[str, Column],
    fractions: Mapping[str, float],
    sizes: DataFrame | None = None,
    gathered: int = GATHERED,
) -> DataFrame:
    """Exact linear quantiles of several columns per group, for groups of any size.

    ``values`` maps a name to a column and ``fractions`` a suffix to a fraction; the result has one column
    ``name + suffix`` each. NULL values are left out; a group without any value keeps its row, with NULLs.

    Groups of up to ``gathered`` rows are aggregated in one pass: their buffers are bounded. Larger ones, of which there
    are at most rows / ``gathered``, are taken by :func:`spread_quantiles`. ``sizes`` (some of the keys and ``_n``, at
    least the rows of each such group) tells them apart without a count, if it is at hand.
    """
    if sizes is None:
        sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    known = [c for c in sizes.columns if c != "_n"]
    large = sizes.where(F.col("_n") > gathered).select(F.struct(*known).alias("_large"))
    names = [f"{n}{x}" for n in values for x in fractions]
    columns = [
        F.percentile(column.cast("double"), F.lit(float(fraction))).alias(f"{name}{suffix}")
        for name, column in values.items()
        for suffix, fraction in fractions.items()
    ]
    if large.isEmpty():
        return df.groupBy(*keys).agg(*columns).select(*keys, *names)
    same = F.struct(*known) == F.col("_large")
    small = df.join(large, same, "left_anti").groupBy(*keys).agg(*columns)
    return small.select(*keys, *names).unionByName(spread_quantiles(df.join(large, same, "left_semi"), keys, values, fractions))


def spread_quantiles(
    df: DataFrame, keys: Sequence[str], values: Mapping[str, Column], fractions: Mapping[str, float]
) -> DataFrame:
    """The same as :func:`quantiles` without a bound on the rows of a group or on its different values.

    Equal values are counted (combined before the shuffle). The counts of logarithmic buckets tell which buckets hold a
    wanted position; those buckets are cut again into ``CELLS`` equal parts between their least and greatest value, so a
    narrow band of values is split as well, and values are ordered only inside the parts that hold a wanted position.
    """
    # The keys travel as one struct: structs with equal fields are equal, NULL fields included.
    group = ["_g", "_name"]
    entries = F.array(*[F.struct(F.lit(n).alias("_name"), c.cast("double").alias("_v")) for n, c in values.items()])
    counted = (
        df.select(F.struct(*keys).alias("_g"), F.explode(entries).alias("_e"))
        .groupBy("_g", "_e._name", "_e._v")
        .agg(F.count(F.lit(1)).alias("_c"))
        .withColumn("_b", value_bucket(F.col("_v")))
    )
    found = counted.where(F.col("_v").isNotNull())

    def position(fraction: float) -> Column:
        return (F.col("_total") - 1) * F.lit(float(fraction))

    def lower(fraction: float) -> Column:
        return F.floor(position(fraction))

    def upper(fraction: float) -> Column:
        return F.least(lower(fraction) + 1, F.col("_total") - 1)

    def inside(wanted: Column, start: Column, size: Column) -> Column:
        return (start <= wanted) & (wanted < start + size)

    def holds_wanted(start: Column, size: Column) -> Column:
        wanted = [end(fraction) for fraction in sorted(set(fractions.values())) for end in (lower, upper)]
        return reduce(lambda x, y: x | y, [inside(w, start, size) for w in wanted])

    def before(partition: Sequence[str], order: str) -> Column:
        """Sum of ``_c`` over the rows in front."""
        rows = Window.partitionBy(*partition).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        return F.sum("_c").over(rows) - F.col("_c")

    buckets = (
        found.groupBy(*group, "_b")
        .agg(F.sum("_c").alias("_c"), F.min("_v").alias("_low"), F.max("_v").alias("_high"))
        .withColumns({"_start": before(group, "_b"), "_total": F.sum("_c").over(Window.partitionBy(*group))})
        .where(holds_wanted(F.col("_start"), F.col("_c")))
        .drop("_c")
    )
    part = F.floor((F.col("_v") - F.col("_low")) / F.nullif(F.col("_high") - F.col("_low"), F.lit(0.0)) * CELLS)
    inner = found.join(buckets, [*group, "_b"]).withColumn("_p", F.coalesce(part, F.lit(0)))
    cell = [*group, "_b", "_p"]
    cells = (
        inner.groupBy(*cell)
        .agg(F.sum("_c").alias("_c"), F.first("_start").alias("_start"), F.first("_total").alias("_total"))
        .withColumn("_start", F.col("_start") + before([*group, "_b"], "_p"))
        .where(holds_wanted(F.col("_start"), F.col("_c")))
        .select(*cell, F.col("_start").alias("_cell_start"))
    )
    placed = inner.join(cells, cell).withColumn("_start", F.col("_cell_start") + before(cell, "_v"))
    picks = []
    for name in values:
        own = F.col("_name") == name
        for suffix, fraction in fractions.items():
            for end, wanted in (("lo", lower(fraction)), ("hi", upper(fraction))):
                hit = own & inside(wanted, F.col("_start"), F.col("_c"))
                picks.append(F.max(F.when(hit, F.col("_v"))).alias(f"_{end}_{name}{suffix}"))
            picks.append(F.max(F.when(own, position(fraction) - lower(fraction))).alias(f"_at_{name}{suffix}"))

    def between(name: str) -> Column:
        low, high = F.col(f"_lo_{name}"), F.col(f"_hi_{name}")
        return (low + (high - low) * F.col(f"_at_{name}")).alias(name)

    names = [f"{n}{x}" for n in values for x in fractions]
    outputs = placed.groupBy("_g").agg(*picks).select("_g", *map(between, names))
    return counted.select("_g").distinct().join(outputs, "_g", "left").select("_g.*", *names)


def _medians_of_group(group: Sequence[str], labels: Sequence[str], names: Sequence[str]) -> Callable[[pa.Table], pa.Table]:
    """Task function of :func:`label_medians`. It holds all it needs, so workers need not find this package."""

    def ascending(values: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
        """Places and values of what is not NULL, by value."""
        there = np.flatnonzero(values.is_valid().to_numpy())
        found = values.fill_null(0.0).to_numpy()[there]
        order = np.argsort(found)
        return there[order], found[order]

    def medians_by_code(codes: np.ndarray, size: int, places: np.ndarray, found: np.ndarray) -> pa.Array:
        own = codes[places]
        if size > 1 or len(own) and own.min() < 0:
            # The values are in order already; a stable sort of short codes is a counting sort.
            kept = own >= 0
            own, found = own[kept].astype(np.int16 if size < 1 << 15 else np.int32), found[kept]
            ordered = found[np.argsort(own, kind="stable")]
        else:
            ordered = found
        counts = np.bincount(own, minlength=size)
        starts = np.cumsum(counts) - counts
        last = max(len(ordered) - 1, 0)
        ordered = ordered if len(ordered) else np.zeros(1)
        low = ordered[np.minimum(starts + np.maximum(counts - 1, 0) // 2, last)]
        high = ordered[np.minimum(starts + counts // 2, last)]
        return pa.array(np.where(low == high, low, 0.5 * low + 0.5 * high), mask=counts == 0)

    def of_group(rows: pa.Table) -> pa.Table:
        parts = []
        sorted_values = {name: ascending(rows.column(name)) for name in names}
        for label in labels or (None,):
            if label is None:
                codes, found = np.zeros(rows.num_rows, dtype=np.int32), pa.array([None], pa.string())
            else:
                coded = rows.column(label).combine_chunks().dictionary_encode()
                codes, found = coded.indices.fill_null(-1).to_numpy(zero_copy_only=False), coded.dictionary
            own = {c: pa.repeat(rows.column(c)[0], len(found)) for c in group}
            if label is not None:
                own |= {"dimension_type": pa.repeat(label, len(found)), "dimension_value": found}
            own |= {name: medians_by_code(codes, len(found), *sorted_values[name]) for name in names}
            parts.append(pa.table(own))
        return pa.concat_tables(parts)

    return of_group


def label_medians(
    df: DataFrame,
    group: Sequence[str],
    labels: Sequence[str],
    values: Mapping[str, Column],
    sizes: DataFrame | None = None,
    gathered: int = GATHERED,
) -> DataFrame:
    """Exact medians of several columns for each value of each label column inside a group; without labels, of the group.

    The result has the columns ``group``, ``dimension_type`` and ``dimension_value`` (only with labels) and the names of
    ``values``. NULL labels are left out. A row is shuffled once, however many labels it has, and a group of up to ``gathered``
    rows is taken in one piece by a task; rows of larger groups go through :func:`spread_quantiles`. ``sizes`` as in
    :func:`quantiles`.
    """
    group, names = list(group), list(values)
    keys = [*group, "dimension_type", "dimension_value"] if labels else group
    cast = [column.cast("double").alias(name) for name, column in values.items()]
    narrow = df.select(*group, *labels, *cast)
    schema = T.StructType(
        [narrow.schema[c] for c in group]
        + [T.StructField(c, T.StringType()) for c in keys[len(group) :]]
        + [T.StructField(c, T.DoubleType()) for c in names]
    )

    of_group = _medians_of_group(group, tuple(labels), names)
    if sizes is None:
        sizes = narrow.groupBy(*group).agg(F.count(F.lit(1)).alias("_n"))
    known = [c for c in sizes.columns if c != "_n"]
    large = sizes.where(F.col("_n") > gathered).select(F.struct(*known).alias("_large"))
    if large.isEmpty():
        return narrow.groupBy(*group).applyInArrow(of_group, schema)
    same = F.struct(*known) == F.col("_large")
    small = narrow.join(large, same, "left_anti").groupBy(*group).applyInArrow(of_group, schema)
    rest = narrow.join(large, same, "left_semi")
    if labels:
        rest = by_label(rest, labels, [*group, *names])
    spread = spread_quantiles(rest, keys, {name: F.col(name) for name in names}, {"": 0.5})
    return small.unionByName(spread.select(*keys, *names))


def by_label(df: DataFrame, labels: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """A row for each label column that is not NULL: kept columns, ``dimension_type`` and ``dimension_value``."""
    entries = F.array(*[F.struct(F.lit(c).alias("dimension_type"), F.col(c).alias("dimension_value")) for c in labels])
    rows = df.select(*keep, F.explode(entries).alias("_d")).select(*keep, "_d.dimension_type", "_d.dimension_value")
    return rows.where(F.col("dimension_value").isNotNull())


def position_by_value_desc(
    df: DataFrame, keys: Sequence[str], value: str, tie: str, name: str, tie_block: int = 1 << 20
) -> DataFrame:
    """Row number by (value descending, integer ``tie`` ascending) for groups of any size.

    Positions are offset(bucket) + offset(exact value, block of tie ids) + row number inside the block;
    equal values are split by blocks of ids, so even one value shared by a whole month is spread out.
    """
    keys = list(keys)
    placed = df.withColumn("_b", value_bucket(F.col(value))).withColumn(
        "_block", F.floor(F.col(tie) / tie_block)
    )
    blocks = placed.groupBy(*keys, "_b", value, "_block").agg(F.count(F.lit(1)).alias("_n"))
    before = (Window.unboundedPreceding, Window.currentRow)
    over_buckets = Window.partitionBy(*keys).orderBy(F.col("_b").desc()).rowsBetween(*before)
    over_blocks = (
        Window.partitionBy(*keys, "_b").orderBy(F.col(value).desc(), F.col("_block")).rowsBetween(*before)
    )
    bucket_offsets = (
        blocks.groupBy(*keys, "_b")
        .agg(F.sum("_n").alias("_n"))
        .select(*keys, "_b", (F.sum("_n").over(over_buckets) - F.col("_n")).alias("_bucket_offset"))
    )
    offsets = (
        blocks.withColumn("_offset", F.sum("_n").over(over_blocks) - F.col("_n"))
        .join(bucket_offsets, [*keys, "_b"])
        .select(*keys, value, "_block", (F.col("_offset") + F.col("_bucket_offset")).alias("_offset"))
    )
    inside = Window.partitionBy(*keys, value, "_block").orderBy(tie)
    return (
        placed.drop("_b")
        .join(offsets, [*keys, value, "_block"])
        .withColumn(name, (F.col("_offset") + F.row_number().over(inside)).cast("int"))
        .drop("_block", "_offset")
    )


def average_rank_percentiles(
    df: DataFrame,
    cohort: Sequence[str],
    identity: Sequence[str],
    features: Mapping[str, Column],
    scale: float = 1.0,
    tie_digits: int = 12,
) -> DataFrame:
    """scale * (average rank - 1) / (n - 1) per cohort and feature, ties averaged, half of scale for n = 1.

    Input is one row per theme of a cohort month, so a cohort is as large as the label list. All features
    share one shuffle in long form. Values are compared after rounding to ``tie_digits`` decimals, which
    keeps float noise from splitting ties.
    """
    entries = F.array(
        *[F.struct(F.lit(name).alias("_name"), F.round(column, tie_digits).alias("_v")) for name, column in features.items()]
    )
    long = df.select(*identity, F.explode(entries).alias("_e"))
    long = long.select(*identity, "_e._name", "_e._v").where(F.col("_v").isNotNull())
    ordered = Window.partitionBy(*cohort, "_name").orderBy("_v")
    ties = ordered.rangeBetween(Window.currentRow, Window.currentRow)
    size = F.count(F.lit(1)).over(Window.partitionBy(*cohort, "_name"))
    average_rank = F.rank().over(ordered) + (F.count(F.lit(1)).over(ties) - 1) / 2
    percentile = F.when(size == 1, F.lit(scale / 2)).otherwise(
        F.lit(float(scale)) * (average_rank - 1) / F.greatest(size - 1, F.lit(1))
    )
    return (
        long.withColumn("_p", percentile)
        .groupBy(*identity)
        .agg(*[F.max(F.when(F.col("_name") == name, F.col("_p"))).alias(name) for name in features])
    )
