"""Mixing sources to target weights by hash-threshold histograms.

Every document has a uniform 48-bit hash of its id and text. A source whose target is r times its size takes every
document floor(r) times and, of the rest of the budget, once more those below a hash threshold. The threshold comes from
histograms: sizes are summed by source and the next ``BITS`` bits of the hash, the bucket in which the running sum
crosses the budget is found, and only that bucket's documents are read for the next level. No level sorts documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from themelens.llm.common import body, broadcast_if_small, n_words, stored

#: Fixed values of the contract: source weights in code-point order of the names, repeating, and the repeat limit.
WEIGHTS = (5.0, 2.0, 1.0)
REPEATS = 3

#: Hash bits by level; 4 x 12 = 48.
LEVELS = 4
BITS = 12
SPAN = 1 << (LEVELS * BITS)


def sizes(docs: DataFrame) -> DataFrame:
    """doc_id, source, size and a name of each row, without texts."""
    return docs.select(
        "doc_id",
        F.col("source").cast("string").alias("source"),
        n_words(body()).alias("size"),
        name_of().alias("name"),
    )


def name_of() -> Column:
    return F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.md5(body().cast("binary")))


def hash_of(name: Column, copy: Column) -> Column:
    digest = F.sha2(F.concat_ws(":", name, copy.cast("string")), 256)
    return F.conv(F.substring(digest, 1, LEVELS * BITS // 4), 16, 10).cast("long")


def numbered(rows: DataFrame) -> DataFrame:
    """Rows with a hash each; equal rows are counted and numbered, so that they do not share one."""
    groups = rows.groupBy("doc_id", "source", "size", "name").agg(F.count("*").alias("copies"))
    copies = groups.select(
        "doc_id", "source", "size", "name", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy")
    )
    return copies.select("doc_id", "source", "size", hash_of(F.col("name"), F.col("copy")).alias("hash"))


def source_targets(rows: DataFrame) -> DataFrame:
    """source, source_size and target: the water level at which the weighted shares, each at most REPEATS times its
    source's size, hold all words. Resharing the excess by weight ends at the same level. One row a source."""
    weights = F.array(*map(F.lit, WEIGHTS))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    totals = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = totals.withColumn("weight", F.element_at(weights, ((F.row_number().over(by_name) - 1) % 3 + 1).cast("int")))
    limit = F.lit(REPEATS) * F.col("source_size")
    # Sources reach their limit in ascending order of limit / weight. With the first k full, the level is what is left
    # for the others over their weight; the right k is the first whose next source stays within its limit.
    by_limit = Window.orderBy(limit / F.col("weight"), F.col("source").asc_nulls_last())
    before = by_limit.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    level = (F.sum("source_size").over(everything) - F.coalesce(F.sum(limit).over(before), F.lit(0))) / (
        F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    )
    levelled = ranked.withColumn("level", level).withColumn("place", F.row_number().over(by_limit))
    fits = F.when(F.col("level") * F.col("weight") <= limit, F.struct("place", "level"))
    found = levelled.withColumn("level", F.min(fits).over(everything)["level"])
    return found.select(
        "source",
        "source_size",
        F.least(limit.cast("double"), F.coalesce(F.col("level"), F.lit(float(REPEATS))) * F.col("weight")).alias("target"),
    )


def plan(rows: DataFrame) -> DataFrame:
    """source, source_size, target, whole (times every document is taken) and bound: documents with a hash below it are
    taken once more. Of the last bucket, all or none, whichever is nearer to the target."""
    targets = source_targets(rows)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    current = stored(
        targets.withColumn("whole", F.least(whole, F.lit(REPEATS)).cast("int"))
        .withColumn("left", F.col("target") - F.col("whole") * F.col("source_size"))
        .withColumn("bound", F.lit(0).cast("long")),
        "targets",
    )
    for depth in range(LEVELS):
        width = SPAN >> (BITS * (depth + 1))
        step = current.select(F.col("source").alias("s"), "left", "bound")
        inside = rows.join(broadcast_if_small(step), F.col("source").eqNullSafe(F.col("s"))).where(
            (F.col("left") > 0) & (F.col("hash") >= F.col("bound")) & (F.col("hash") < F.col("bound") + width * (1 << BITS))
        )
        buckets = inside.groupBy("source", ((F.col("hash") - F.col("bound")) / width).cast("int").alias("bucket")).agg(
            F.sum("size").alias("size"), F.first("left").alias("left")
        )
        running = F.sum("size").over(Window.partitionBy("source").orderBy("bucket"))
        last = depth == LEVELS - 1
        # A bucket is taken if it stays within the budget; the last crossing bucket also where that comes nearer.
        limit = F.col("left") + (F.col("size") / 2 if last else F.lit(0))
        taken = (
            buckets.withColumn("running", running)
            .groupBy("source")
            .agg(
                F.max(F.when(F.col("running") <= limit, F.col("running"))).alias("used"),
                F.min(F.when(F.col("running") > limit, F.col("bucket"))).alias("crossing"),
            )
            .select(F.col("source").alias("s"), "used", "crossing")
        )
        moved = current.join(taken, F.col("source").eqNullSafe(F.col("s")), "left").select(
            "source",
            "source_size",
            "target",
            "whole",
            (F.col("left") - F.coalesce(F.col("used"), F.lit(0))).alias("left"),
            # No crossing bucket: everything inside is taken.
            F.when(F.col("left") <= 0, F.col("bound"))
            .otherwise(F.col("bound") + F.coalesce(F.col("crossing"), F.lit(1 << BITS)).cast("long") * width)
            .alias("bound"),
            F.col("crossing").isNull().alias("done"),
        )
        # Sources without a crossing bucket are through: nothing of theirs is left to refine.
        moved = moved.withColumn("left", F.when(F.col("done"), F.lit(0.0)).otherwise(F.col("left"))).drop("done")
        current = stored(moved, f"level{depth}")
    return current.select("source", "source_size", "target", "whole", "bound")


def apply_plan(rows: DataFrame, plan_: DataFrame) -> DataFrame:
    """``rows`` (with source and hash) and the plan's columns, and ``times``: how often each row is taken."""
    table = broadcast_if_small(plan_).withColumnRenamed("source", "s")
    joined = rows.join(table, F.col("source").eqNullSafe(F.col("s"))).drop("s")
    return joined.withColumn("times", F.col("whole") + (F.col("hash") < F.col("bound")).cast("int"))


def mix(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target and taken of every document. Texts without words have size and taken 0; equal
    rows count one by one; all sources of size 0 have target 0."""
    rows = stored(numbered(sizes(docs)), "rows")
    return apply_plan(rows, plan(rows)).select(
        "doc_id",
        "size",
        "source_size",
        "target",
        (F.col("size") * F.col("times")).alias("taken"),
    )


def repeat_to_mix(docs: DataFrame) -> DataFrame:
    """Each document as often as the mix takes it, all columns. Texts without words, of which any number weighs
    nothing, are kept once. Equal rows share a hash here and are taken alike."""
    rows = docs.select(
        F.struct("*").alias("row"),
        F.col("source").cast("string").alias("source"),
        n_words(body()).alias("size"),
        hash_of(name_of(), F.lit(1)).alias("hash"),
    )
    narrow = stored(rows.select("source", "size", "hash"), "rows")
    times = F.when(F.col("size") == 0, F.lit(1)).otherwise(F.col("times"))
    taken = apply_plan(rows, plan(narrow)).withColumn("times", times).where(F.col("times") > 0)
    return taken.select("row", F.explode(F.sequence(F.lit(1), F.col("times").cast("int")))).select("row.*")


#: The same mix in DuckDB: sources fill up to the common level, and the 48-bit hashes are taken in order.
ORACLE = """
WITH docs AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS size,
    concat_ws(':', coalesce(doc_id::VARCHAR, ''), md5(coalesce(text, ''))) AS name
  FROM {documents}),
hashed AS (
  SELECT doc_id, source, size, ('0x' || left(sha256(concat_ws(':', name, copy::VARCHAR)), 12))::BIGINT AS hash
  FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, source, size, name) AS copy FROM docs)),
ranked AS (
  SELECT source, sum(size) AS source_size,
    CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE
      ELSE 1.0::DOUBLE END AS weight
  FROM docs GROUP BY source),
levels AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER (ORDER BY 3 * source_size / weight,
      source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / (sum(weight) OVER () - coalesce(sum(weight) OVER (ORDER BY 3 * source_size / weight,
      source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS level,
    row_number() OVER (ORDER BY 3 * source_size / weight, source NULLS LAST) AS place
  FROM ranked),
chosen AS (SELECT arg_min(level, place) AS level FROM levels WHERE level * weight <= 3 * source_size),
targets AS (
  SELECT source, source_size, least(3.0 * source_size, coalesce((SELECT level FROM chosen), 3.0) * weight) AS target
  FROM levels),
budgets AS (
  SELECT *, CASE WHEN source_size > 0 THEN least(3, floor(target / source_size)) ELSE 0 END AS whole FROM targets),
ties AS (
  SELECT source, hash, sum(size) AS tied, sum(sum(size)) OVER (PARTITION BY source ORDER BY hash) AS running
  FROM hashed GROUP BY source, hash),
firsts AS (
  SELECT t.source, min(hash) AS bound FROM ties t JOIN budgets b ON t.source IS NOT DISTINCT FROM b.source
  WHERE running > target - whole * source_size + tied / 2 OR target - whole * source_size <= 0 GROUP BY t.source)
SELECT doc_id, size::BIGINT AS size, source_size::BIGINT AS source_size, target::DOUBLE AS target,
  (size * (whole + CASE WHEN hash < coalesce(bound, 281474976710656) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM hashed h JOIN budgets b ON h.source IS NOT DISTINCT FROM b.source
LEFT JOIN firsts f ON f.source IS NOT DISTINCT FROM h.source
"""
