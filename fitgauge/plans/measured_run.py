"""A run over real tables: crawl, find candidates, measure them, score, confirm, store."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fitgauge.functions import classify
from fitgauge.functions.names import COLUMN_KEYS
from fitgauge.operators import candidates as c
from fitgauge.operators import score
from fitgauge.operators.incremental import (
    TableKey,
    analyzable,
    incremental_profile,
    new_candidates,
    store_profiles,
)
from fitgauge.settings import DEFAULTS, Settings
from fitgauge.sources import crawl, store


def step(
    spark: SparkSession, root: str, name: str, build: Callable[[], DataFrame], *, resume: bool = False
) -> DataFrame:
    """A step's result, by way of a stored table; a resumed run reads it instead of building it."""
    path = f"{root}/{name}"
    if not resume:
        store.save(build(), path)
    return spark.read.parquet(path)


def as_profiles(stored: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """Stored statistics in the form the scores read."""
    text = F.col("kind") == "text"
    average = F.when(text, F.col("avg_length"))
    by_length = classify.content_is_natural(average, settings)
    by_words = F.col("spaced_share") >= 0.5
    return stored.filter("status = 'success'").select(
        *COLUMN_KEYS,
        F.col("total_rows").alias("total_rows_sampled"),
        "non_null_count",
        "null_percentage",
        average.alias("avg_length"),
        F.when(text, F.col("max_length")).alias("max_length"),
        F.when(average.isNotNull(), by_length & F.coalesce(by_words, F.lit(True))).alias("is_natural_language"),
        # A nested type cannot hold a broken structure.
        F.when((F.col("kind") == "semi_structured") & (F.col("non_null_count") > 0), True).alias(
            "is_valid_structure"
        ),
    )


def _finish(candidates: DataFrame, profiles: DataFrame, settings: Settings) -> DataFrame:
    scored = score.rescored(score.score_candidate(candidates, profiles, settings), settings)
    return score.with_tier(score.confirm(scored, settings), settings)


def full_scan_top_n(
    spark: SparkSession,
    scored: DataFrame,
    resolve: Callable[[TableKey], DataFrame],
    at: datetime,
    n: int | None = None,
    settings: Settings = DEFAULTS,
) -> DataFrame:
    """Exact statistics of the best column candidates, and their readiness from those.

    The list is at most n rows long; each table in it is scanned once for all its listed columns, in batches of tables that
    are stored one after the other. A table that can't be read leaves its candidates without statistics.
    """
    top = score.top_candidates(scored.filter(F.col("column_name").isNotNull()), n, settings)
    path = f"{store.work_dir(spark)}/profiles"
    store_profiles(spark, top.select(*COLUMN_KEYS).distinct(), resolve, path, at, settings=settings)
    stored = store.load_profile_cache(spark, path)
    plain = top.drop("profile", *score.SCORES, "total_score")
    return score.rescored(score.score_candidate(plain, as_profiles(stored, settings), settings), settings)


def measured_run(
    spark: SparkSession,
    database: str,
    tables: Mapping[tuple[str, str], DataFrame],
    root: str,
    at: datetime,
    *,
    run_mode: str = "fresh",
    merge: bool = True,
    resume_from: str | None = None,
    force: bool = False,
    settings: Settings = DEFAULTS,
) -> DataFrame:
    """All steps. Each stores its result under ``root``; ``resume_from`` reads the steps before it.

    Steps: columns, candidates, scored. Profiles live in a store that append runs extend.
    """
    order = ["columns", "candidates", "scored"]
    start = order.index(resume_from) if resume_from else 0

    def resolve(key: TableKey) -> DataFrame:
        return tables[key[1], key[2]]

    columns = step(
        spark, root, "columns", lambda: crawl.crawl_columns(spark, database, tables, settings),
        resume=start > 0,
    )
    found = step(
        spark, root, "candidates", lambda: c.all_candidates(columns, settings), resume=start > 1
    )
    profiles = incremental_profile(
        spark, analyzable(found), resolve, f"{root}/profiles", at, force=force, settings=settings
    )
    scored = step(
        spark, root, "scored",
        lambda: _finish(found, as_profiles(profiles, settings), settings).drop("profile"),
    )
    return publish(spark, scored, root, at, run_mode=run_mode, merge=merge, settings=settings)


def publish(
    spark: SparkSession,
    scored: DataFrame,
    root: str,
    at: datetime,
    *,
    run_mode: str = "fresh",
    merge: bool = True,
    settings: Settings = DEFAULTS,
) -> DataFrame:
    """Adds this run's candidates to the published ones.

    A fresh run replaces them. An append run adds only rows with a new key (``merge``) or all rows; the
    rows published before are not read into the write, so nothing is overwritten while it is read.
    """
    path = f"{root}/published"
    names = [f.split()[0] for f in store.CANDIDATE_SCHEMA.split(", ")]
    rows = scored.select(names)
    if run_mode == "append" and merge:
        rows = new_candidates(store.load_candidates(spark, path), rows)
    store.save(rows, path, run_mode=run_mode)
    store.append_run(scored, f"{root}/history", at, run_mode, settings)
    return store.load_candidates(spark, path)
