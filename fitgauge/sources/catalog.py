"""Catalog views as DataFrames: live rows, newest version per name.

The views hold one row per version of an object. ``latest_version`` ranks inside the key; Spark
turns the ``= 1`` filter into a window group limit, so each map task keeps one row per key before the
shuffle and an object with very many versions does not weigh on one reducer.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fitgauge.functions.names import COLUMN_KEYS, TABLE_KEYS
from fitgauge.settings import DEFAULTS, Settings

TABLE_FIELDS = [
    *TABLE_KEYS, "table_type", "row_count", "bytes", "table_comment", "created", "last_altered",
    "clustering_key",
]
COLUMN_FIELDS = [
    *COLUMN_KEYS, "ordinal_position", "data_type", "character_maximum_length", "numeric_precision",
    "numeric_scale", "is_nullable", "column_comment",
]
CONSTRAINT_FIELDS = [*TABLE_KEYS, "constraint_type", "constraint_name"]
STORAGE_FIELDS = [
    *TABLE_KEYS, "active_bytes", "time_travel_bytes", "failsafe_bytes", "retained_for_clone_bytes",
]
STAGE_FIELDS = [
    "database_name", "schema_name", "stage_name", "stage_url", "stage_type", "comment", "created",
]


def live_rows(df: DataFrame) -> DataFrame:
    return df.filter(F.col("deleted").isNull())


def filter_databases(df: DataFrame, settings: Settings = DEFAULTS, name: str = "database_name") -> DataFrame:
    """Include list first, else exclude list, in any letter case; null names pass neither list."""
    upper = F.upper(F.col(name))
    if settings.include_databases:
        return df.filter(upper.isin([d.upper() for d in settings.include_databases]))
    if settings.exclude_databases:
        return df.filter(~upper.isin([d.upper() for d in settings.exclude_databases]))
    return df


def not_system_schema(df: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    return df.filter(F.col("schema_name") != settings.system_schema)


def top_rows(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int) -> DataFrame:
    """First ``n`` rows of each key, with their ``rank``."""
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(window)).filter(F.col("rank") <= n)


def latest_version(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    return top_rows(df, keys, order, 1).drop("rank")


def _live(df: DataFrame, settings: Settings) -> DataFrame:
    return filter_databases(live_rows(df), settings)


def catalog_tables(tables: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    newest = [F.col("created").desc(), F.col("last_altered").desc_nulls_last(), *map(F.col, TABLE_FIELDS)]
    return latest_version(_live(tables, settings).select(TABLE_FIELDS), TABLE_KEYS, newest)


def catalog_columns(columns: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    first = [F.col("ordinal_position"), F.col("data_type"), *map(F.col, COLUMN_FIELDS)]
    return latest_version(_live(columns, settings).select(COLUMN_FIELDS), COLUMN_KEYS, first)


def catalog_constraints(constraints: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    live = _live(constraints, settings).select(CONSTRAINT_FIELDS)
    return latest_version(live, [*TABLE_KEYS, "constraint_name"], [F.col("constraint_type")])


def catalog_storage(storage: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    known = filter_databases(storage.filter(F.col("database_name").isNotNull()), settings)
    largest = [F.col("active_bytes").desc_nulls_last(), F.col("time_travel_bytes").desc_nulls_last(), *map(F.col, STORAGE_FIELDS)]
    return latest_version(known.select(STORAGE_FIELDS), TABLE_KEYS, largest)


def catalog_stages(stages: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    newest = [F.col("created").desc(), F.col("stage_url"), *map(F.col, STAGE_FIELDS)]
    keys = ["database_name", "schema_name", "stage_name"]
    return latest_version(_live(stages, settings).select(STAGE_FIELDS), keys, newest)


def catalog_databases(tables: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """Taken from the tables view: the databases view can list databases that are gone."""
    return _live(tables, settings).select("database_name").distinct()


def catalog_schemas(tables: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    return _live(tables, settings).select("database_name", "schema_name").distinct()
