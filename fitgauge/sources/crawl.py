"""Catalog rows made from the tables themselves, for lakes without a catalog view."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce
from itertools import islice
from urllib.parse import unquote

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fitgauge.operators.in_flight import in_flight
from fitgauge.settings import DEFAULTS, Settings
from fitgauge.sources.catalog import COLUMN_FIELDS, TABLE_FIELDS, not_system_schema
from fitgauge.sources.folders import work_dir

Tables = Mapping[tuple[str, str], DataFrame]
Batch = list[tuple[tuple[str, str], DataFrame]]

# Catalog names of Spark types.
TYPE_NAMES = {
    "string": "VARCHAR", "byte": "INTEGER", "short": "INTEGER", "integer": "INTEGER", "long": "INTEGER",
    "decimal": "NUMBER", "float": "FLOAT", "double": "DOUBLE", "date": "DATE",
    "timestamp": "TIMESTAMP_LTZ", "timestamp_ntz": "TIMESTAMP_NTZ", "binary": "BINARY",
    "array": "ARRAY", "map": "OBJECT", "struct": "OBJECT", "variant": "VARIANT", "boolean": "BOOLEAN",
}
COLUMN_SCHEMA = T.StructType(
    [
        T.StructField(
            name,
            T.LongType()
            if name in ("ordinal_position", "character_maximum_length", "numeric_precision", "numeric_scale")
            else T.StringType(),
        )
        for name in COLUMN_FIELDS
    ]
)


def list_tables(spark: SparkSession, database: str) -> dict[tuple[str, str], DataFrame]:
    """The session catalog's tables of one database, by (schema, table)."""
    return {
        (database, t.name): spark.table(f"`{database}`.`{t.name}`")
        for t in spark.catalog.listTables(database)
        if not t.isTemporary
    }


# Spark's own description of a schema; the type of a nested column stays text.
DESCRIBED = (
    "struct<fields array<struct<name string, type string, nullable boolean, "
    "metadata struct<comment string, __CHAR_VARCHAR_TYPE_STRING string>>>>"
)


def _column_fields(settings: Settings) -> dict[str, Column]:
    """The catalog's columns from a described ``field``. A plain string can be as long as a text may be."""
    kind = F.col("field.type")
    name = F.when(kind.startswith("{"), F.get_json_object(kind, "$.type")).otherwise(F.regexp_extract(kind, r"^[^(]*", 0))
    name = F.when(name.isin("varchar", "char"), "string").otherwise(name)
    names = F.create_map(*[F.lit(part) for pair in TYPE_NAMES.items() for part in pair])
    declared = F.coalesce("field.metadata.__CHAR_VARCHAR_TYPE_STRING", kind)
    length = F.regexp_extract(declared, r"^(?:var)?char\((\d+)\)$", 1).try_cast("bigint")
    return {
        "column_name": F.col("field.name"),
        "ordinal_position": F.col("position") + 1,
        "data_type": F.coalesce(F.try_element_at(names, name), F.upper(name)),
        "character_maximum_length": F.coalesce(length, F.when(name == "string", settings.max_text_length)),
        "numeric_precision": F.regexp_extract(kind, r"^decimal\((\d+)", 1).try_cast("bigint"),
        "numeric_scale": F.regexp_extract(kind, r"^decimal\(\d+, *(-?\d+)", 1).try_cast("bigint"),
        "is_nullable": F.when(F.col("field.nullable"), "YES").otherwise("NO"),
        "column_comment": F.col("field.metadata.comment"),
    }


def crawl_columns(
    spark: SparkSession, database: str, tables: Tables, settings: Settings = DEFAULTS
) -> DataFrame:
    """One row per column, from schemas only; no data is read.

    The driver hands on one text for each table, its schema; tasks make the column rows of it.
    """
    rows = [(schema, table, df.schema.json()) for (schema, table), df in tables.items()]
    described = spark.createDataFrame(rows, "schema_name string, table_name string, described string")
    fields = described.select(
        F.lit(database).alias("database_name"), "schema_name", "table_name",
        F.posexplode(F.from_json("described", DESCRIBED)["fields"]).alias("position", "field"),
    ).withColumns(_column_fields(settings))
    typed = [F.col(f.name).cast(f.dataType).alias(f.name) for f in COLUMN_SCHEMA.fields]
    return not_system_schema(fields.select(typed), settings)


def _measured(df: DataFrame) -> DataFrame:
    """Rows from the file footers, bytes and file times from the file listing; no column is read. Views have rows only."""
    counted = df.agg(F.count("*").alias("row_count"))
    files = df.inputFiles()
    if not files:
        unknown = {"bytes": "bigint", "created": "timestamp", "last_altered": "timestamp"}
        return counted.select("row_count", *[F.lit(None).cast(kind).alias(name) for name, kind in unknown.items()])
    listed = df.sparkSession.read.format("binaryFile").load([unquote(f) for f in files]).agg(
        F.struct(
            F.sum("length").alias("bytes"), F.min("modificationTime").alias("created"),
            F.max("modificationTime").alias("last_altered"),
        )
    )
    return counted.withColumn("files", listed.scalar()).select("row_count", "files.*")


def _table_row(database: str, schema: str, table: str, measured: DataFrame) -> DataFrame:
    return measured.select(
        F.lit(database).alias("database_name"),
        F.lit(schema).alias("schema_name"),
        F.lit(table).alias("table_name"),
        F.lit("BASE TABLE").alias("table_type"),
        "row_count",
        "bytes",
        F.lit(None).cast("string").alias("table_comment"),
        "created",
        "last_altered",
        F.lit(None).cast("string").alias("clustering_key"),
    )


def crawl_tables(database: str, tables: Tables, settings: Settings = DEFAULTS) -> DataFrame:
    """One row per table with its exact row count.

    ``tables_per_crawl`` tables are measured by one job and committed together, ``jobs_in_flight`` jobs at a time, so that plans
    stay small however many tables there are. A table that can't be read has a row without counts; the others of its batch are
    measured again, one by one.
    """
    spark = SparkSession.active()
    root = work_dir(spark)
    unknown = spark.sql(
        "select cast(null as bigint) as row_count, cast(null as bigint) as bytes, cast(null as timestamp) as created, "
        "cast(null as timestamp) as last_altered"
    )
    schema = _table_row(database, "", "", unknown).schema

    def measure(batch: Batch, path: str) -> None:
        rows = [_table_row(database, s, t, _measured(df)) for (s, t), df in batch]
        reduce(DataFrame.unionByName, rows).coalesce(1).write.mode("overwrite").parquet(path)

    def work(numbered: tuple[int, Batch]) -> None:
        number, batch = numbered
        try:
            measure(batch, f"{root}/batch={number}/table=all")
        except (PySparkException, Py4JJavaError):
            for i, one in enumerate(batch):
                path = f"{root}/batch={number}/table={i}"
                try:
                    measure([one], path)
                except (PySparkException, Py4JJavaError):
                    _table_row(database, *one[0], unknown).write.mode("overwrite").parquet(path)

    every = iter(tables.items())
    batches = iter(lambda: list(islice(every, settings.tables_per_crawl)), [])
    in_flight(spark, enumerate(batches), work, settings.jobs_in_flight, "crawl")
    if not tables:
        return spark.createDataFrame([], schema).select(TABLE_FIELDS)
    found = spark.read.schema(schema).option("recursiveFileLookup", True).parquet(root)
    return not_system_schema(found, settings).select(TABLE_FIELDS)
