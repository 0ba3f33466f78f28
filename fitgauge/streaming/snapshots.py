"""Append runs over catalog snapshots as they arrive.

Each micro-batch adds its live columns to a store of columns, in a folder of its own, and then derives the candidates of
every schema that it touched anew from all columns stored. The result depends on the snapshots alone, not on how many files
a batch holds or how often one ran.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from fitgauge.functions.names import COLUMN_KEYS
from fitgauge.operators.candidates import all_candidates
from fitgauge.settings import DEFAULTS, Settings
from fitgauge.sources import store
from fitgauge.sources.catalog import latest_version
from fitgauge.sources.crawl import COLUMN_SCHEMA


def publish_snapshots(
    spark: SparkSession,
    snapshots: str,
    published: str,
    checkpoint: str,
    settings: Settings = DEFAULTS,
    *,
    files_per_batch: int = 100,
) -> StreamingQuery:
    """Reads every snapshot not seen before and stops when there is none left.

    Snapshots are Parquet files of live columns. ``checkpoint`` must be a folder all executors reach. Published candidates
    are partitioned by database and schema; a batch replaces the partitions that it touches. The columns themselves are
    kept beside them, in a folder with the suffix ``_columns``.
    """
    columns = f"{published.rstrip('/')}_columns"
    place = ["database_name", "schema_name"]

    def add(batch: DataFrame, number: int) -> None:
        store.save(batch, f"{columns}/batch={number}")
        touched = spark.read.parquet(f"{columns}/batch={number}").select(*[F.coalesce(k, F.lit("")).alias(f"t_{k}") for k in place]).distinct()
        known = spark.read.schema(COLUMN_SCHEMA).option("recursiveFileLookup", True).parquet(columns)
        same = [F.coalesce(F.col(k), F.lit("")) == F.col(f"t_{k}") for k in place]
        live = latest_version(known.join(touched, same, "left_semi"), COLUMN_KEYS, [F.col(c) for c in COLUMN_SCHEMA.names])
        found = all_candidates(live, settings)
        found.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*place).parquet(published)

    return (
        spark.readStream.schema(COLUMN_SCHEMA)
        .option("maxFilesPerTrigger", files_per_batch)
        .parquet(snapshots)
        .writeStream.foreachBatch(add)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
