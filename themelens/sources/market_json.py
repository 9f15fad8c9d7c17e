"""Reader of ranked market responses and product metadata responses stored as JSON.

A response is one JSON array of product objects whose position is the rank order. Files are read whole
(a response is one page of a ranking), the work after parsing is per row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from themelens.constants import NUMERIC_MEASURES, TAG_COLUMNS, TAG_DATES
from themelens.functions.text import blank_to_null, normalize_genre, normalize_opaque_id, parse_tag_date

_TAGS = T.MapType(T.StringType(), T.StringType())
MARKET_ITEM = T.StructType(
    [
        T.StructField("app_id", T.StringType()),
        T.StructField("unified_app_id", T.StringType()),
        T.StructField("country", T.StringType()),
        T.StructField("date", T.StringType()),
        *[T.StructField(name, T.DoubleType()) for name in NUMERIC_MEASURES],
        T.StructField("custom_tags", _TAGS),
        T.StructField("entities", T.ArrayType(T.StructType([T.StructField("custom_tags", _TAGS)]))),
        T.StructField("aggregate_tags", _TAGS),
    ]
)
_APPS = T.ArrayType(T.StructType([T.StructField("app_id", T.StringType())]))
METADATA_ITEM = T.StructType(
    [
        T.StructField("unified_app_id", T.StringType()),
        T.StructField("name", T.StringType()),
        T.StructField("publisher", T.StructType([T.StructField("name", T.StringType())])),
        T.StructField("android_publisher_ids", T.ArrayType(T.StringType())),
        T.StructField("itunes_publisher_ids", T.ArrayType(T.StringType())),
        T.StructField("android_apps", _APPS),
        T.StructField("itunes_apps", _APPS),
    ]
)


def read_payloads(spark: SparkSession, path: str) -> DataFrame:
    """One response per file -> its payload, file name and the columns of partition folders."""
    files = spark.read.text(path, wholetext=True)
    folders = [c for c in files.columns if c != "value"]
    return files.select(F.col("value").alias("payload"), F.input_file_name().alias("source"), *folders)


def read_market_json(spark: SparkSession, path: str) -> DataFrame:
    """One response per file -> one row per product with its position in the response."""
    return parse_market_payloads(read_payloads(spark, path))


def _payload_items() -> Column:
    """The items of a JSON array as JSON texts; NULL unless the whole payload is one array."""
    is_array = F.col("payload").rlike(r"(?s)^\s*\[.*\]\s*$")
    return F.when(is_array, F.from_json("payload", T.ArrayType(T.StringType())))


def parse_market_payloads(documents: DataFrame) -> DataFrame:
    """``payload`` JSON array text -> typed rows; other columns are kept, positions start at 1.

    Every item gives a row: what is no object, or has a field of the wrong type, is marked in ``errors``. Payloads that
    are no array give no row here; :func:`rejected_market_rows` lists them.
    """
    keep = [c for c in documents.columns if c != "payload"]
    checked = T.StructType([*MARKET_ITEM.fields, T.StructField("_corrupt", T.StringType())])
    parsed = F.from_json("_text", checked, {"columnNameOfCorruptRecord": "_corrupt"})
    is_object = F.coalesce(F.col("_text").rlike(r"(?s)^\s*\{"), F.lit(False))
    items = (
        documents.select(*keep, F.posexplode(_payload_items()).alias("_p", "_text"))
        .select(*keep, (F.col("_p") + 1).alias("position"), is_object.alias("_object"), F.when(is_object, parsed).alias("_item"))
        .select(*keep, "position", "_object", "_item.*")
        .withColumn(
            "_broken", F.when(~F.col("_object"), "not_an_object").when(F.col("_corrupt").isNotNull(), "malformed_field")
        )
    )
    return normalize_market_items(items.drop("_object", "_corrupt"))


def rejected_market_rows(documents: DataFrame) -> DataFrame:
    """What ingestion does not let through: the other columns of ``documents``, position and error.

    One row without a position for a payload that is no JSON array, and one for each error of an item.
    """
    keep = [c for c in documents.columns if c != "payload"]
    payloads = documents.where(_payload_items().isNull()).select(
        *keep, F.lit(None).cast("int").alias("position"), F.lit("invalid_payload").alias("error")
    )
    items = parse_market_payloads(documents).select(*keep, "position", F.explode("errors").alias("error"))
    return payloads.unionByName(items)


def merged_tags() -> Column:
    """Top-level tags if present, else the first entity's tags overlaid by the aggregate tags."""
    entity = F.get("entities", F.lit(0))["custom_tags"]
    overlay = F.col("aggregate_tags")
    untouched = F.map_filter(entity, lambda key, _: ~F.map_contains_key(overlay, key))
    merged = F.when(overlay.isNull(), entity).otherwise(F.map_concat(untouched, overlay))
    return F.coalesce(F.col("custom_tags"), F.when(entity.isNotNull(), merged))


def normalize_market_items(items: DataFrame) -> DataFrame:
    """Ids, merged tags, label columns and dates; ``errors`` lists what makes a row invalid and
    ``date_notes`` the optional dates that did not parse."""
    if "_broken" not in items.columns:
        items = items.withColumn("_broken", F.lit(None).cast("string"))
    zoned = F.col("date").rlike(r"(Z|[+-]\d{2}:?\d{2})$")
    source_date = F.when(zoned, F.try_to_timestamp("date"))
    rows = items.withColumn("tags", merged_tags()).withColumns(
        {"source_app_id": normalize_opaque_id(F.col("app_id")), "source_date": source_date}
    )
    dates = {column: parse_tag_date(F.col("tags")[tag]) for tag, column in TAG_DATES.items()}
    rows = rows.withColumns({column: F.col("tags")[tag] for tag, column in TAG_COLUMNS.items()} | dates)
    errors = F.array_compact(
        F.array(
            F.when(F.col("source_app_id").isNull(), F.lit("invalid_app_id")),
            F.when(F.col("source_date").isNull(), F.lit("invalid_date")),
            F.when(F.col("tags").isNull(), F.lit("missing_tags")),
            F.col("_broken"),
        )
    )
    # An item that could not be read says so alone.
    errors = F.when(F.col("_broken") == "not_an_object", F.array("_broken")).otherwise(errors)
    notes = F.array_compact(
        F.array(
            *[
                F.when(F.col("tags")[tag].isNotNull() & F.col(column).isNull(), F.lit(tag))
                for tag, column in TAG_DATES.items()
            ]
        )
    )
    explicit = F.coalesce(F.col("unified_app_id"), F.col("app_id"))
    return (
        rows.withColumns({"errors": errors, "date_notes": notes})
        .withColumn("unified_app_id", normalize_opaque_id(explicit))
        .withColumnRenamed("country", "source_country")
        .drop("app_id", "date", "custom_tags", "entities", "aggregate_tags", "_broken")
    )


def select_market_records(
    rows: DataFrame,
    response: Sequence[str],
    allowed_genres: Sequence[str],
    final_top_n: int,
    exclude_country: str | None = None,
) -> DataFrame:
    """First ``final_top_n`` eligible rows of each response in source order, with their rank position.

    Rows with errors are not eligible.

    Spark keeps at most ``final_top_n`` rows per response and map task, so the ranking never gathers a
    whole response list.
    """
    if final_top_n <= 0:
        raise ValueError("final_top_n must be positive")
    genres = sorted({genre.strip().casefold() for genre in allowed_genres})
    if not genres or "" in genres:
        raise ValueError("allowed genre names must be non-empty")
    valid = rows.where(F.size("errors") == 0) if "errors" in rows.columns else rows
    eligible = valid.where(normalize_genre(F.col("game_genre")).isin(*genres))
    if exclude_country is not None:
        eligible = eligible.where(~F.col("most_popular_country_by_revenue").eqNullSafe(F.lit(exclude_country)))
    window = Window.partitionBy(*response).orderBy("position")
    return eligible.withColumn("rank_position", F.row_number().over(window)).where(
        F.col("rank_position") <= final_top_n
    )


def selection_counts(candidates: DataFrame, selected: DataFrame, response: Sequence[str]) -> DataFrame:
    """Candidates and selected rows per response; a response without any eligible row is an error."""
    wanted = candidates.groupBy(*response).agg(F.count(F.lit(1)).alias("candidate_count"))
    found = selected.groupBy(*response).agg(F.count(F.lit(1)).alias("selected_count"))
    return (
        wanted.join(found, list(response), "left")
        .withColumn("selected_count", F.coalesce("selected_count", F.lit(0)))
        .withColumn("status", F.when(F.col("selected_count") == 0, "no_eligible_record").otherwise("selected"))
    )


def build_market_snapshots(selected: DataFrame, **constants: object) -> DataFrame:
    """Selected rows -> fact rows: raw labels and measures, constants for scope, period and provenance."""
    missing = [
        name
        for name in ("scope_name", "cadence", "period_start", "period_end")
        if name not in constants and name not in selected.columns
    ]
    if missing:
        raise ValueError(f"missing period columns: {missing}")
    fixed = {name: F.lit(value) for name, value in constants.items()}
    with_constants = selected.withColumns(fixed) if fixed else selected
    wanted = [
        "scope_name",
        "cadence",
        "period_start",
        "period_end",
        "rank_position",
        "source_app_id",
        "unified_app_id",
        "scope_country",
        "device_type",
        "category",
        "data_model",
        "source_date",
        "source_country",
        *NUMERIC_MEASURES,
        *TAG_COLUMNS.values(),
        *TAG_DATES.values(),
        "collected_at",
    ]
    return with_constants.select(*[name for name in wanted if name in with_constants.columns])


def first_seen_ids(rows: DataFrame) -> DataFrame:
    """Distinct non-blank ids with the first position they appear at."""
    return (
        rows.where(F.col("unified_app_id").isNotNull() & (F.trim("unified_app_id") != ""))
        .groupBy("unified_app_id")
        .agg(F.min("position").alias("position"))
    )


def normalize_metadata(items: DataFrame) -> DataFrame:
    """Product metadata with the publisher fallback chain and the source that won."""

    def first_id(column: str) -> Column:
        return blank_to_null(F.get(column, F.lit(0)))

    android = first_id("android_publisher_ids")
    named = blank_to_null(F.col("publisher")["name"])
    itunes = first_id("itunes_publisher_ids")
    return items.select(
        normalize_opaque_id(F.col("unified_app_id")).alias("unified_app_id"),
        blank_to_null(F.col("name")).alias("name"),
        F.when(android.isNotNull(), blank_to_null(F.translate(android, "+", " ")))
        .otherwise(F.coalesce(named, itunes))
        .alias("publisher_display_name"),
        F.when(android.isNotNull(), "android_publisher_ids")
        .when(named.isNotNull(), "publisher_name")
        .when(itunes.isNotNull(), "itunes_publisher_ids")
        .otherwise("unavailable")
        .alias("publisher_resolution_source"),
        blank_to_null(F.get("android_apps", F.lit(0))["app_id"]).alias("android_app_id"),
        blank_to_null(F.get("itunes_apps", F.lit(0))["app_id"]).alias("ios_app_id"),
    )


def metadata_integrity(returned: DataFrame, requested: DataFrame) -> DataFrame:
    """Unrequested, duplicate and missing ids of one metadata exchange."""
    got = returned.groupBy("unified_app_id").agg(F.count(F.lit(1)).alias("_n"))
    wanted = requested.select("unified_app_id").distinct()

    def tagged(df: DataFrame, violation: str) -> DataFrame:
        return df.select("unified_app_id", F.lit(violation).alias("violation"))

    return (
        tagged(got.join(wanted, "unified_app_id", "left_anti"), "unrequested")
        .unionByName(tagged(got.where(F.col("_n") > 1), "duplicate"))
        .unionByName(tagged(wanted.join(got, "unified_app_id", "left_anti"), "missing"))
    )


def metadata_cache_lookup(ids: DataFrame, cache: DataFrame, as_of: str, max_age_days: float = 14) -> DataFrame:
    """fresh / stale / missing per id; metadata exactly at the maximum age is fresh."""
    limit = F.lit(as_of).cast("timestamp") - F.make_dt_interval(secs=F.lit(float(max_age_days) * 86400))
    return ids.join(cache.select("unified_app_id", "fetched_at"), "unified_app_id", "left").withColumn(
        "status",
        F.when(F.col("fetched_at").isNull(), "missing").when(F.col("fetched_at") >= limit, "fresh").otherwise("stale"),
    )


def combine_metadata(fresh: DataFrame, fetched: DataFrame, selected: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(usable metadata, problems): ids supplied by both sides, which are not usable, and selected ids nobody supplied."""
    both = fresh.select("unified_app_id").join(fetched, "unified_app_id", "left_semi")
    supplied = fresh.unionByName(fetched)
    open_ids = selected.select("unified_app_id").distinct().join(supplied, "unified_app_id", "left_anti")
    combined = supplied.join(both.distinct(), "unified_app_id", "left_anti")
    problems = both.withColumn("violation", F.lit("supplied_twice")).unionByName(
        open_ids.withColumn("violation", F.lit("unresolved"))
    )
    return combined, problems


def read_range(
    table: DataFrame, start: str | None = None, end: str | None = None, **equal: object
) -> DataFrame:
    """Rows of a month range with equality filters; pushed down to partition and file pruning."""
    rows = table
    if start is not None:
        rows = rows.where(F.col("period_start") >= F.lit(start).cast("date"))
    if end is not None:
        rows = rows.where(F.col("period_start") <= F.lit(end).cast("date"))
    for name, value in equal.items():
        rows = rows.where(F.col(name) == F.lit(value))
    return rows


def latest_period(table: DataFrame) -> DataFrame:
    """Newest stored period of each scope."""
    return (
        table.groupBy("scope_name", "cadence")
        .agg(F.max(F.struct("period_start", "period_end")).alias("_p"))
        .select("scope_name", "cadence", "_p.period_start", "_p.period_end")
    )


def read_by_ids(table: DataFrame, ids: DataFrame) -> DataFrame:
    return table.join(ids.select("unified_app_id").distinct(), "unified_app_id", "left_semi")
