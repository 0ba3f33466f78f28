"""Profiles kept by file: a file is read once, whatever is added, changed or removed beside it.

For every data file the store holds one row per column with states that merge: counts, extremes, moments, a distinct-count sketch and a
quantile sketch. A file is known by path, size and time of change. A run lists the files of a table, which reads no data, reads those that
the store does not know in that form, and merges the states of those that are there now. So a new file costs its
own size, a changed one too, and a removed one nothing.

Everything but ``approx_distinct``, the medians and the 95th percentiles is exact; those come from the sketches.
"""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fitgauge.functions.names import TABLE_KEYS
from fitgauge.operators.in_flight import in_flight
from fitgauge.operators.incremental import JOB_FAILURES, TableKey, cause
from fitgauge.operators.profile import LENGTH_FIELDS, QUANTILES, VALUE_FIELDS, Measure, column_kind, merged_deviation
from fitgauge.settings import DEFAULTS, Settings
from fitgauge.sources.store import read_or_empty, save_part

FILE_KEYS = [*TABLE_KEYS, "path", "size", "modified"]
STATE_SCHEMA = (
    "database_name string, schema_name string, table_name string, path string, size bigint, modified timestamp, rows bigint, error string, "
    "column_name string, kind string, n bigint, min double, max double, sum double, real bigint, longer bigint, spaced bigint, var double, seen binary, ranks binary"
)
STATES = [f.split(" ")[0] for f in STATE_SCHEMA.split(", ")][8:]
#: What has no partial aggregation of its own name.
PROFILE = [*TABLE_KEYS, "column_name", "kind", "total_rows", "non_null_count", "null_percentage", "approx_distinct", "spaced_share", *LENGTH_FIELDS, *VALUE_FIELDS]


def list_files(spark: SparkSession, location: str, suffix: str = ".parquet") -> DataFrame:
    """``path``, ``size``, ``modified`` of every data file below a location, from its listing alone."""
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", f"*{suffix}").load(location)
    return listed.select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"), F.col("_metadata.file_path").alias("url"))


def _states(spark: SparkSession, paths: Sequence[str], schema: T.StructType, settings: Settings) -> DataFrame:
    """``url``, ``rows`` and an array of one state per column for each file that has rows."""
    measures = [Measure(f.name, column_kind(f.dataType), f"c{i}", settings.content_min_length) for i, f in enumerate(schema.fields)]
    exprs, structs = ["count(*) as file_rows"], []
    for m in measures:
        t = m.tag
        exprs += [
            *m.base(), f"count_if(not isnan({m.value})) as {t}_real", f"var_pop({m.value}) as {t}_var",
            f"{m.sketch.format(bits=settings.sketch_bits)} as {t}_seen", f"kll_sketch_agg_double({m.value}, {settings.quantile_sketch}) as {t}_ranks"]
        label = m.name.replace("\\", "\\\\").replace("'", "\\'")
        fields = ", ".join(f"{t}_{s} as {s}" for s in STATES[2:])
        structs.append(f"struct('{label}' as column_name, '{m.kind}' as kind, {fields})")
    rows = spark.read.schema(schema).parquet(*paths).withColumn("url", F.col("_metadata.file_path"))
    found = rows.groupBy("url").agg(*map(F.expr, exprs))
    states = f"array({', '.join(structs)})" if structs else "array()"
    return found.selectExpr("url", "file_rows as rows", f"{states} as states")


def _batch(spark: SparkSession, key: TableKey, files: DataFrame, paths: Sequence[str], schema: T.StructType, settings: Settings) -> DataFrame:
    """Rows of the store for some files; a file without rows has one, without a column."""
    listed = files.where(F.col("path").isin(list(paths)))
    found = listed.join(_states(spark, paths, schema, settings), "url", "left")
    rows = found.select(
        *(F.lit(v).alias(k) for k, v in zip(TABLE_KEYS, key)), "path", "size", "modified", F.coalesce("rows", F.lit(0)).alias("rows"),
        F.lit(None).cast("string").alias("error"), F.explode_outer("states").alias("s"))
    return rows.select(*FILE_KEYS, "rows", "error", *(F.col(f"s.{s}").alias(s) for s in STATES))


def _failed(spark: SparkSession, key: TableKey, files: DataFrame, path: str, message: str) -> DataFrame:
    rows = files.where(F.col("path") == path).select(
        *(F.lit(v).alias(k) for k, v in zip(TABLE_KEYS, key)), "path", "size", "modified", F.lit(0).cast("bigint").alias("rows"),
        F.lit(message[:200]).alias("error"))
    return rows.unionByName(spark.createDataFrame([], STATE_SCHEMA), allowMissingColumns=True)


def add_states(spark: SparkSession, key: TableKey, location: str, store: str, settings: Settings = DEFAULTS) -> None:
    """Reads the files of a table that the store does not know as they are now, ``files_per_job`` at a time, and stores their states.

    Each batch is stored before the next starts. When one fails its files are read one by one, and those that can't be read get a row with the
    error; they are tried again by the next run. The names of new files come to the driver, as a reader takes names.
    """
    files = list_files(spark, location)
    known = table_states(spark, store, key).where("error is null").select("path", "size", "modified").distinct()
    new = files.join(known, ["path", "size", "modified"], "left_anti").select("path").orderBy("path")
    batch: list[str] = []

    def flush() -> None:
        schema = _schema(spark, location, batch)
        try:
            save_part(_batch(spark, key, files, batch, schema, settings), store)
        except JOB_FAILURES:
            for path in batch:
                try:
                    save_part(_batch(spark, key, files, [path], schema, settings), store)
                except JOB_FAILURES as error:
                    save_part(_failed(spark, key, files, path, cause(error)), store)
        batch.clear()

    for row in new.toLocalIterator():
        batch.append(row.path)
        if len(batch) == settings.files_per_job:
            flush()
    if batch:
        flush()


def _schema(spark: SparkSession, location: str, paths: Sequence[str]) -> T.StructType:
    """The table's schema with the columns that new files add. Damaged files add none."""
    read = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").option("ignoreCorruptFiles", True)
    fields: dict[str, T.StructField] = {}
    for some in ([location], paths):
        try:
            found = read.option("mergeSchema", some is paths).parquet(*some).schema
        except AnalysisException as error:
            if error.getCondition() != "UNABLE_TO_INFER_SCHEMA":
                raise
        else:
            fields |= {f.name: f for f in found.fields if f.name not in fields}
    return T.StructType(list(fields.values()))


def table_states(spark: SparkSession, store: str, key: TableKey) -> DataFrame:
    """The stored states of one table, for all files it ever had."""
    states = read_or_empty(spark, store, STATE_SCHEMA, parts=True)
    return states.where(reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(v) for k, v in zip(TABLE_KEYS, key)]))


def current_states(spark: SparkSession, key: TableKey, location: str, store: str) -> DataFrame:
    """The states of the files that are there now, each once, however often a run that stopped has stored it."""
    files = list_files(spark, location).select("path", "size", "modified")
    states = table_states(spark, store, key).join(files, ["path", "size", "modified"], "left_semi")
    return states.where("error is null").dropDuplicates([*FILE_KEYS, "column_name"])


def merged_profile(states: DataFrame) -> DataFrame:
    """One row of statistics for each table and column, as ``profile_table`` gives them, with ``files``, the number of files merged."""
    numeric = F.col("kind") == "numeric"
    files = states.select(*FILE_KEYS, "rows").distinct().groupBy(*TABLE_KEYS).agg(F.sum("rows").alias("total_rows"), F.count("*").alias("files"))
    ranks = ", ".join(f"{q!r}D" for q in QUANTILES)
    quantiles = f"if(sum(real) > 0, kll_sketch_get_quantile_double(kll_merge_agg_double(ranks), array({ranks})), null) as q"
    merged = states.where("column_name is not null").withColumnsRenamed({s: f"s_{s}" for s in ("n", "sum", "var")}).groupBy(*TABLE_KEYS, "column_name", "kind").agg(
        F.sum("s_n").alias("n"), F.min("min").alias("low"), F.max("max").alias("high"), F.sum("s_sum").alias("total"), F.sum("longer").alias("longer"),
        F.sum("spaced").alias("spaced"), F.expr(f"{merged_deviation('s')} as dev"), F.expr("hll_sketch_estimate(hll_union_agg(seen)) as approx_distinct"), F.expr(quantiles))
    merged = merged.join(files, TABLE_KEYS)
    stats = ["low", "high", "if(n > 0, total / n, null)", "q[0]", "q[1]", "dev"]
    shown = [*TABLE_KEYS, "column_name", "kind", "total_rows", "n as non_null_count",
             "if(total_rows > 0, round((1 - n / total_rows) * 100, 2), 100D) as null_percentage", "approx_distinct", "if(longer > 0, spaced / longer, null) as spaced_share"]
    merged = merged.withColumn("numeric", numeric)
    for name, stat in zip(LENGTH_FIELDS, stats):
        whole = name in ("min_length", "max_length")
        shown.append(f"cast(if(numeric, null, {stat if whole else f'round({stat}, 2)'}) as {'bigint' if whole else 'double'}) as {name}")
    shown += [f"cast(if(numeric, {stat}, null) as double) as {name}" for name, stat in zip(VALUE_FIELDS, stats)]
    return merged.selectExpr(*shown, "files")


def profile_by_file(
    spark: SparkSession, tables: Mapping[TableKey, str], store: str, settings: Settings = DEFAULTS
) -> DataFrame:
    """Profiles of whole tables, of which only new and changed files are read. ``tables`` maps names to the folder or file of each.

    ``jobs_in_flight`` tables are read at a time. A table whose files all are damaged or empty of columns has no rows in the result.
    """

    def one(item: tuple[TableKey, str]) -> None:
        add_states(spark, *item, store, settings)

    in_flight(spark, tables.items(), one, settings.jobs_in_flight, f"fitgauge-files-{uuid.uuid4().hex[:8]}")
    return reduce(DataFrame.unionByName, [merged_profile(current_states(spark, key, location, store)) for key, location in tables.items()])


def unreadable_files(spark: SparkSession, key: TableKey, location: str, store: str) -> DataFrame:
    """``path``, ``error`` of the files that are there and could not be read."""
    files = list_files(spark, location).select("path", "size", "modified")
    failed = table_states(spark, store, key).where("error is not null").join(files, ["path", "size", "modified"], "left_semi")
    good = table_states(spark, store, key).where("error is null").select("path", "size", "modified").distinct()
    return failed.join(good, ["path", "size", "modified"], "left_anti").groupBy("path").agg(F.max("error").alias("error"))
