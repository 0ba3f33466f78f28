"""Reading data tables: scans and deterministic samples."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from typing import TypeVar

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from fitgauge.settings import DEFAULTS, Settings


def scan_table(spark: SparkSession, path: str, columns: Sequence[str] | None = None) -> DataFrame:
    """A Parquet table; only the named columns are read."""
    df = spark.read.parquet(path)
    return df if columns is None else df.select(*columns)


Key = TypeVar("Key")
#: Above every hexadecimal hash.
ALL = "g"
#: Up to so many sampled keys are compared by the reader itself.
MOST_KEYS = 1000


def row_counts(tables: Mapping[Key, DataFrame]) -> dict[Key, int]:
    """Rows of each table, from file footers, for all tables in one job."""
    if not tables:
        return {}
    parts = [
        df.agg(F.count("*").alias("rows")).select(F.lit(i).alias("i"), "rows")
        for i, df in enumerate(tables.values())
    ]
    counted = {r.i: r.rows for r in reduce(DataFrame.unionByName, parts).collect()}
    return {key: counted[i] for i, key in enumerate(tables)}


def sample_hash(key: Sequence[str]) -> Column:
    return F.md5(F.concat_ws("|", *[F.col(k).cast("string") for k in key]))


def sample_order(key: Sequence[str]) -> list[Column]:
    """A fixed pseudo-random order of rows, from a unique key."""
    return [sample_hash(key), *[F.col(k) for k in key]]


def sample_rows(
    df: DataFrame, n: int, key: Sequence[str], settings: Settings = DEFAULTS, *, rows: int | None = None
) -> DataFrame:
    """``n`` rows, the same on every run: those with the smallest hash of their key.

    Spark's own ``TABLESAMPLE (n ROWS)`` is a plain limit, so it would favour the first files. Of a table in files the key columns alone are read
    to choose the rows; the other columns are read only in the files, and as far as the key is clustered in the row groups and
    pages, that hold chosen ones. So what is read of a long text follows ``n``, not the table. The places of the ``n`` rows come to the driver.
    Other tables are sorted and limited as a whole. A bound on the hash, widened until it lets ``n`` rows through, keeps each
    task from handing its ``n`` best rows to the last one.
    """
    rows = df.count() if rows is None else rows
    try:
        places = df.select(*key, F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("at"))
    except AnalysisException:  # no table in files
        return _below(df, _hash_bound(df.select(*key), n, rows, key), key).orderBy(*sample_order(key)).limit(n)
    share = _share(n, rows)
    while True:
        chosen = _below(places, _bound(share), key).orderBy(*sample_order(key)).limit(n).collect()
        if len(chosen) >= n or share >= 1:
            break
        share *= 4
    return _at(df, chosen, key)


def _at(df: DataFrame, chosen: Sequence[Row], key: Sequence[str]) -> DataFrame:
    """The rows of a table in files at the chosen places. Filters on files and keys are there to read less; the places decide."""
    if not chosen:
        return df.limit(0)
    place = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("at"))
    found = df.withColumn("_place", place).filter(F.col("_metadata.file_path").isin(sorted({r.file for r in chosen})))
    values = sorted({r[key[0]] for r in chosen if r[key[0]] is not None})
    if len(values) <= MOST_KEYS and len(values) == len({r[key[0]] for r in chosen}):
        # lists of up to ten values reach the reader as single comparisons
        lists = [F.col(key[0]).isin(values[i : i + 10]) for i in range(0, len(values), 10)]
        found = found.filter(reduce(lambda a, b: a | b, lists))
    spark = df.sparkSession
    wanted = spark.createDataFrame([(r.file, r.at) for r in chosen], "wanted_file string, wanted_at bigint")
    same = (F.col("_place.file") == F.col("wanted_file")) & (F.col("_place.at") == F.col("wanted_at"))
    return found.join(F.broadcast(wanted), same, "left_semi").drop("_place")


def _below(df: DataFrame, bound: str, key: Sequence[str]) -> DataFrame:
    return df if bound == ALL else df.filter(sample_hash(key) < bound)


def _share(n: int, rows: int) -> float:
    """The share of hashes that n rows pass nearly always."""
    return (n + 10 * n**0.5 + 10) / max(rows, 1)


def _bound(share: float) -> str:
    return f"{int(share * 16**8):08x}" if share < 1 else ALL


def _hash_bound(keys: DataFrame, n: int, rows: int, key: Sequence[str]) -> str:
    """A hexadecimal bound that n or a few more rows pass; all pass when the hashes are lumpy."""
    share = _share(n, rows)
    while share < 1:
        if _below(keys, _bound(share), key).count() >= n:
            return _bound(share)
        share *= 4
    return ALL


def choose_sample_size(rows: int, total_bytes: int, settings: Settings = DEFAULTS) -> int:
    """Largest sample size whose expected bytes fit the budget; the smallest when none does."""
    per_row = total_bytes / rows if rows else 0.0
    for size in sorted(settings.sample_sizes, reverse=True):
        if size * per_row <= settings.sample_bytes_budget:
            return size
    return min(settings.sample_sizes)
