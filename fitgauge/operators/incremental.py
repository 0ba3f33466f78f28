"""Work that adds to earlier results instead of repeating it."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence
from datetime import datetime
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fitgauge.functions.names import COLUMN_KEYS, TABLE_KEYS
from fitgauge.functions.times import instant
from fitgauge.operators.in_flight import in_flight
from fitgauge.operators.profile import profile_table
from fitgauge.operators.score import is_analyzable
from fitgauge.settings import DEFAULTS, Settings
from fitgauge.sources.catalog import latest_version
from fitgauge.sources.store import PROFILE_SCHEMA, load_profile_cache, save_part

TableKey = tuple[str, str, str]
Resolve = Callable[[TableKey], DataFrame]

#: What a failed job raises: errors that PySpark knows, and others, such as those of damaged files, as the JVM gives them.
JOB_FAILURES = (PySparkException, Py4JJavaError)
MERGE_KEYS = [*COLUMN_KEYS, "feature"]


def _null_safe_key(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys with the empty text for null, so table-level rows match each other in an equi-join."""
    return df.select([F.coalesce(F.col(k), F.lit("")).alias(f"key_{k}") for k in keys]).distinct()


def new_candidates(existing: DataFrame, found: DataFrame) -> DataFrame:
    """Found candidates whose key is not stored yet, once each."""
    keyed = found.withColumns({f"key_{k}": F.coalesce(F.col(k), F.lit("")) for k in MERGE_KEYS})
    names = [f"key_{k}" for k in MERGE_KEYS]
    fresh = keyed.join(_null_safe_key(existing, MERGE_KEYS), names, "left_anti")
    return latest_version(fresh, names, [F.col(c) for c in found.columns]).drop(*names)


def merge_candidates(existing: DataFrame, found: DataFrame, *, update: bool = False) -> DataFrame:
    """Stored rows stay as they are and new keys are added; ``update`` lets found rows win instead."""
    kept, added = (found, existing) if update else (existing, found)
    return kept.unionByName(new_candidates(kept, added), allowMissingColumns=True)


def add_candidates(existing: DataFrame, found: DataFrame) -> DataFrame:
    """Plain append, keys may repeat."""
    return existing.unionByName(found, allowMissingColumns=True)


def analyzable(candidates: DataFrame) -> DataFrame:
    """Candidates that name a column whose data can be read."""
    return candidates.filter(is_analyzable())


def cache_miss(wanted: DataFrame, cache: DataFrame) -> DataFrame:
    """Wanted columns without a stored profile."""
    return wanted.select(*COLUMN_KEYS).distinct().join(cache.select(*COLUMN_KEYS), COLUMN_KEYS, "left_anti")


def _stored_form(df: DataFrame, key: TableKey, analysis: str, at: datetime) -> DataFrame:
    given = {**dict(zip(TABLE_KEYS, key)), "status": "success", "error": None, "analysis_type": analysis}
    named = {k: F.lit(v) for k, v in given.items()} | {"analyzed_at": instant(at)}
    return df.select([named.get(f.name, F.col(f.name)).cast(f.dataType).alias(f.name) for f in PROFILE_SCHEMA.fields])


def error_rows(
    spark: SparkSession, key: TableKey, columns: Iterable[str], message: str, analysis: str, at: datetime
) -> DataFrame:
    """One row per column that could not be profiled, with at most 200 characters of the cause."""
    fields = [f.name for f in PROFILE_SCHEMA.fields]
    known = dict(zip(TABLE_KEYS, key)) | {
        "status": "error", "error": message[:200], "analysis_type": analysis,
    }
    rows = [tuple((known | {"column_name": c}).get(name) for name in fields) for c in columns]
    return spark.createDataFrame(rows, PROFILE_SCHEMA).withColumn("analyzed_at", instant(at))


def cause(error: Exception) -> str:
    """The first line of what went wrong, from the innermost Java exception where there is one."""
    if isinstance(error, Py4JJavaError):
        inner = error.java_exception
        while inner.getCause() is not None:
            inner = inner.getCause()
        return inner.toString().split("\n")[0]
    return str(error)


def table_profile(
    spark: SparkSession,
    key: TableKey,
    columns: Sequence[str],
    resolve: Resolve,
    analysis: str,
    at: datetime,
    settings: Settings = DEFAULTS,
) -> DataFrame:
    """Profiles of one table's columns; error rows for a table or column that is gone and for a table that can't be read."""

    def failed(names: Iterable[str], message: str) -> DataFrame:
        return error_rows(spark, key, names, message, analysis, at)

    try:
        df = resolve(key)
    except PySparkException as error:
        return failed(columns, f"table not found: {error.getCondition()}")
    present = [c for c in columns if c in df.columns]
    gone = [c for c in columns if c not in df.columns]
    if not present:
        return failed(gone, "column not found")
    try:
        rows = _stored_form(profile_table(df, present, settings, rows=df.count()), key, analysis, at)
    except JOB_FAILURES as error:
        rows = failed(present, f"table not readable: {cause(error)}")
    return rows.unionByName(failed(gone, "column not found")) if gone else rows


def profile_tables(
    spark: SparkSession,
    wanted: Iterable[tuple[TableKey, list[str]]],
    resolve: Resolve,
    analysis: str,
    at: datetime,
    settings: Settings = DEFAULTS,
) -> DataFrame:
    """Profiles of a few tables as one DataFrame, whose scans run side by side in one job."""
    names: dict[TableKey, list[str]] = {}
    for key, columns in wanted:
        names.setdefault(key, []).extend(columns)
    parts = [table_profile(spark, key, columns, resolve, analysis, at, settings) for key, columns in names.items()]
    return reduce(DataFrame.unionByName, parts, spark.createDataFrame([], PROFILE_SCHEMA))


def tables_wanted(missing: DataFrame) -> Iterator[tuple[TableKey, list[str]]]:
    """Column names per table, streamed to the driver one partition at a time. Names only, no data."""
    per_table = missing.groupBy(*TABLE_KEYS).agg(F.array_sort(F.collect_set("column_name")).alias("names"))
    for row in per_table.toLocalIterator():
        yield (row.database_name, row.schema_name, row.table_name), list(row.names)


def incremental_profile(
    spark: SparkSession,
    wanted: DataFrame,
    resolve: Resolve,
    store: str,
    at: datetime,
    *,
    force: bool = False,
    analysis: str = "full_scan",
    settings: Settings = DEFAULTS,
) -> DataFrame:
    """Profiles what the store lacks, adds it to the store, and returns every wanted profile.

    Each table is stored as soon as it is done, so a run that stops goes on where it stopped.
    """
    missing = cache_miss(wanted, load_profile_cache(spark, store, force=force))
    store_profiles(spark, missing, resolve, store, at, analysis=analysis, settings=settings)
    keys = wanted.select(*COLUMN_KEYS).distinct()
    return load_profile_cache(spark, store).join(keys, COLUMN_KEYS, "left_semi")


def store_profiles(
    spark: SparkSession,
    wanted: DataFrame,
    resolve: Resolve,
    store: str,
    at: datetime,
    *,
    analysis: str = "full_scan",
    settings: Settings = DEFAULTS,
) -> None:
    """Adds a row for every wanted column to the store. ``jobs_in_flight`` tables are read at a time, each by a job and a commit of its own:
    a slow table delays no other, and one that can't be read gets error rows without a second look at the others."""

    def one(item: tuple[TableKey, list[str]]) -> None:
        key, columns = item
        try:
            save_part(table_profile(spark, key, columns, resolve, analysis, at, settings), store)
        except JOB_FAILURES as error:
            save_part(error_rows(spark, key, columns, cause(error), analysis, at), store)

    in_flight(spark, tables_wanted(wanted), one, settings.jobs_in_flight, "fitgauge-profiles")
