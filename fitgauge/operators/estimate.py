"""Column statistics guessed from the catalog, without reading data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fitgauge import settings as s
from fitgauge.functions.names import (
    COLUMN_KEYS,
    TABLE_KEYS,
    base_type,
    is_numeric_like,
    is_text_like,
)
from fitgauge.settings import DEFAULTS, Settings
from fitgauge.sources.catalog import latest_version, top_rows


def guessed_length(declared: Column, settings: Settings = DEFAULTS) -> Column:
    """A share of the declared length, capped; a constant when no length is declared."""
    share = F.least(declared * settings.length_share_guess, F.lit(settings.length_guess_cap))
    return F.when(declared > 0, F.round(share, 2)).otherwise(settings.length_guess)


def column_metadata_stats(columns: DataFrame, tables: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """One row of estimates per column."""
    rows = tables.select(*TABLE_KEYS, "row_count")
    declared, data_type = F.col("character_maximum_length"), F.col("data_type")
    count = F.coalesce(F.col("row_count"), F.lit(0).cast("bigint"))
    required = F.coalesce(F.col("is_nullable") == "NO", F.lit(False))
    text = is_text_like(data_type)
    number = ~text & is_numeric_like(data_type)
    filled = 1 - settings.nullable_guess / 100
    return columns.join(rows, TABLE_KEYS, "left").select(
        *COLUMN_KEYS,
        F.upper(F.coalesce(data_type, F.lit(""))).alias("data_type"),
        count.alias("row_count"),
        F.when(required, count).otherwise(F.floor(count * filled)).alias("non_null_count"),
        F.when(required, 0.0).otherwise(settings.nullable_guess).alias("null_percentage"),
        F.when(text, 0).cast("bigint").alias("min_length"),
        F.when(text, F.when(declared > 0, declared).otherwise(settings.max_text_length))
        .cast("bigint")
        .alias("max_length"),
        F.when(text, guessed_length(declared, settings)).alias("avg_length"),
        F.when(number, F.col("numeric_precision")).alias("numeric_precision"),
        F.when(number, F.col("numeric_scale")).alias("numeric_scale"),
        (~text & ~number & base_type(data_type).isin(*s.SEMI_STRUCTURED_TYPES)).alias("is_semi_structured"),
        "is_nullable",
        F.coalesce(F.col("column_comment").rlike(r"\S"), F.lit(False)).alias("has_comment"),
    )


def catalog_order() -> list[Column]:
    return [*[F.col(k) for k in TABLE_KEYS], F.col("ordinal_position"), F.col("column_name")]


def first_per_table(columns: DataFrame) -> DataFrame:
    return latest_version(columns, TABLE_KEYS, [F.col("ordinal_position"), F.col("column_name")])


def estimated_text_profile(rich: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """First rich text column of each table, with a guessed length; ``estimated_profiles`` limits the columns looked at."""
    limit = settings.estimated_profiles
    listed = rich if limit is None else rich.orderBy(*catalog_order()).limit(limit)
    declared = F.col("character_maximum_length")
    return first_per_table(listed).select(
        *COLUMN_KEYS,
        "data_type",
        F.lit(0).cast("bigint").alias("total_rows_sampled"),
        F.lit(0).cast("bigint").alias("non_null_count"),
        guessed_length(declared, settings).alias("avg_length"),
        F.when(declared > 0, declared).otherwise(settings.max_text_length).cast("bigint").alias("max_length"),
        F.lit(0).cast("bigint").alias("min_length"),
    )


def estimated_json_profile(extract: DataFrame, settings: Settings = DEFAULTS, keys: DataFrame | None = None) -> DataFrame:
    """Semi-structured candidates with their most frequent keys; ``json_columns`` limits the rows.

    ``keys`` holds measured counts (``COLUMN_KEYS``, ``json_key``, ``n``; see ``json_key_counts``); ``top_json_keys`` of them are listed for each
    column, ties by name. Without it the catalog alone is known, and the lists are empty.
    """
    limit = settings.json_columns
    listed = extract if limit is None else extract.orderBy(*COLUMN_KEYS).limit(limit)
    nothing = F.array().cast("array<string>")
    if keys is None:
        return listed.select(*COLUMN_KEYS, "data_type", nothing.alias("top_keys"))
    best = top_rows(keys, COLUMN_KEYS, [F.col("n").desc(), F.col("json_key")], settings.top_json_keys)
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("rank", "json_key"))), lambda x: x["json_key"])
    found = best.groupBy(*COLUMN_KEYS).agg(ordered.alias("found_keys"))
    return listed.join(found, COLUMN_KEYS, "left").select(*COLUMN_KEYS, "data_type", F.coalesce("found_keys", nothing).alias("top_keys"))
