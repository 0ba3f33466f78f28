"""Stored results: inventory, candidates, profiles, run history.

Results are written by Spark as Parquet (JSON and CSV for exchange) and read with explicit schemas.
A store that later runs extend is only ever appended to; readers keep the newest row per key, so no job
overwrites what it reads and a rerun after a lost executor or driver is safe.
"""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence
from datetime import datetime

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fitgauge.functions.names import COLUMN_KEYS, TABLE_KEYS
from fitgauge.functions.times import instant
from fitgauge.operators.profile import LENGTH_FIELDS, VALUE_FIELDS
from fitgauge.settings import DEFAULTS, Settings
from fitgauge.sources.catalog import latest_version
from fitgauge.sources.folders import until_end, work_dir  # noqa: F401

INVENTORY_SCHEMA = (
    "database_name string, schema_name string, table_name string, column_name string, "
    "data_type string, character_maximum_length bigint, column_comment string"
)
CANDIDATE_SCHEMA = (
    "database_name string, schema_name string, table_name string, column_name string, feature string, "
    "data_type string, max_length bigint, comment string, reason string, "
    "numeric_columns array<string>, text_columns array<string>, business_potential double, "
    "data_readiness double, metadata_quality double, governance_risk double, total_score double, "
    "is_confirmed boolean, confirmation_reasons array<string>, priority string"
)
PROFILE_SCHEMA = T.StructType(
    [T.StructField(k, T.StringType()) for k in COLUMN_KEYS]
    + [T.StructField("kind", T.StringType())]
    + [T.StructField(n, T.LongType()) for n in ("total_rows", "non_null_count")]
    + [T.StructField("null_percentage", T.DoubleType()), T.StructField("approx_distinct", T.LongType())]
    + [T.StructField("spaced_share", T.DoubleType())]
    + [
        T.StructField(n, T.LongType() if n in ("min_length", "max_length") else T.DoubleType())
        for n in LENGTH_FIELDS
    ]
    + [T.StructField(n, T.DoubleType()) for n in VALUE_FIELDS]
    + [T.StructField(n, T.StringType()) for n in ("status", "error", "analysis_type")]
    + [T.StructField("analyzed_at", T.TimestampType())]
)
SCORE_SCHEMA = (
    "database_name string, schema_name string, table_name string, column_name string, feature string, data_readiness double, "
    "total_score double, run_at timestamp"
)
HISTORY_SCHEMA = "run_at timestamp, mode string, database_name string, filter string"


def read_or_empty(
    spark: SparkSession, path: str, schema: T.StructType | str, fmt: str = "parquet", *, parts: bool = False
) -> DataFrame:
    """Stored rows; none when nothing was stored yet. ``parts``: of a store that ``save_part`` adds to."""
    try:
        return spark.read.schema(schema).format(fmt).option("recursiveFileLookup", parts).load(path)
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return spark.createDataFrame([], schema)
        raise


def save(df: DataFrame, path: str, *, run_mode: str = "fresh", fmt: str = "parquet") -> None:
    """A fresh run replaces what is stored, an append run adds to it."""
    modes = {"fresh": "overwrite", "append": "append"}
    writer = df.write.mode(modes[run_mode])
    if fmt == "csv":
        writer = writer.option("header", True).option("escape", '"')
    writer.format(fmt).save(path)


def save_part(df: DataFrame, path: str, *, one_file: bool = True) -> None:
    """Adds rows to a store as a part with a folder of its own, so that several jobs can add to one store at the same time: writers
    of one folder would clear each other's unfinished files. Readers see a part once it is whole. ``one_file`` is for few rows: one
    task makes them all."""
    rows = df.coalesce(1) if one_file else df
    rows.write.parquet(f"{path}/part={uuid.uuid4().hex}")


def write_outputs(
    outputs: Mapping[str, DataFrame], root: str, *, run_mode: str = "fresh", formats: Sequence[str] = ("parquet",)
) -> dict[str, str]:
    """Each named result under the root folder; CSV holds nested columns as JSON text. Returns the paths."""
    paths = {}
    for name, df in outputs.items():
        for fmt in formats:
            path = f"{root}/{name}" if fmt == "parquet" else f"{root}/{name}_{fmt}"
            save(as_flat(df) if fmt == "csv" else df, path, run_mode=run_mode, fmt=fmt)
            paths[f"{name}.{fmt}"] = path
    return paths


def as_flat(df: DataFrame) -> DataFrame:
    """Nested columns as JSON text."""
    nested = (T.ArrayType, T.StructType, T.MapType, T.VariantType)
    return df.withColumns({f.name: F.to_json(f.name) for f in df.schema.fields if isinstance(f.dataType, nested)})


def save_inventory(columns: DataFrame, path: str) -> None:
    names = [*COLUMN_KEYS, "data_type", "character_maximum_length", "column_comment"]
    save(columns.select(names), path, fmt="csv")


def load_inventory(spark: SparkSession, path: str) -> DataFrame:
    """Column inventory from CSV; what the file does not hold gets position 0 and nullable."""
    options = {"header": True, "escape": '"', "multiLine": True}
    read = spark.read.schema(INVENTORY_SCHEMA).options(**options).csv(path)
    return read.select(
        *COLUMN_KEYS,
        F.lit(0).cast("bigint").alias("ordinal_position"),
        "data_type",
        "character_maximum_length",
        F.lit(None).cast("bigint").alias("numeric_precision"),
        F.lit(None).cast("bigint").alias("numeric_scale"),
        F.lit("YES").alias("is_nullable"),
        F.coalesce("column_comment", F.lit("")).alias("column_comment"),
    )


def inventory_sets(columns: DataFrame) -> dict[str, DataFrame]:
    """Distinct databases, schemas and tables of an inventory."""
    return {
        "databases": columns.select("database_name").distinct(),
        "schemas": columns.select("database_name", "schema_name").distinct(),
        "tables": columns.select(*TABLE_KEYS).distinct(),
    }


def load_candidates(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    return read_or_empty(spark, path, CANDIDATE_SCHEMA, fmt)


def load_profile_cache(spark: SparkSession, path: str, *, force: bool = False) -> DataFrame:
    """Newest good profile per column; none when reuse is switched off."""
    if force:
        return spark.createDataFrame([], PROFILE_SCHEMA)
    stored = read_or_empty(spark, path, PROFILE_SCHEMA, parts=True).filter("status = 'success'")
    return latest_version(stored, COLUMN_KEYS, [F.col("analyzed_at").desc(), F.col("analysis_type"), *map(F.col, stored.columns)])


def append_run(
    candidates: DataFrame, path: str, run_at: datetime, run_mode: str, settings: Settings = DEFAULTS
) -> None:
    """One history row per database of this run."""
    scope = ",".join(settings.include_databases) or "ALL"
    rows = candidates.select("database_name").filter("database_name is not null").distinct()
    save(
        rows.select(
            instant(run_at).alias("run_at"),
            F.lit(run_mode).alias("mode"),
            "database_name",
            F.lit(scope).alias("filter"),
        ),
        path,
        run_mode="append",
    )


def run_history(spark: SparkSession, path: str) -> DataFrame:
    """Runs with their databases, oldest first."""
    rows = read_or_empty(spark, path, HISTORY_SCHEMA)
    return (
        rows.groupBy("run_at", "mode", "filter")
        .agg(F.array_sort(F.collect_set("database_name")).alias("databases"))
        .orderBy("run_at")
    )


def databases_analyzed(spark: SparkSession, path: str) -> DataFrame:
    return read_or_empty(spark, path, HISTORY_SCHEMA).select("database_name").distinct()


def save_scores(scored: DataFrame, path: str, run_at: datetime) -> None:
    """Adds the readiness and total of every candidate as of a run."""
    names = [f.split(" ")[0] for f in SCORE_SCHEMA.split(", ")][:-1]
    save_part(scored.select(*names, instant(run_at).alias("run_at")), path, one_file=False)


def scores_before(spark: SparkSession, path: str, run_at: datetime) -> DataFrame:
    """Of every candidate the scores of the last run before ``run_at`` that had it; a run stored twice counts once."""
    stored = read_or_empty(spark, path, SCORE_SCHEMA, parts=True).filter(F.col("run_at") < instant(run_at))
    keys = [*COLUMN_KEYS, "feature"]
    return latest_version(stored, keys, [F.col("run_at").desc(), F.col("data_readiness"), F.col("total_score")])
