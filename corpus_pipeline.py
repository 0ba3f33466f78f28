"""The corpus pipeline: from raw documents to shards. Each stage reads what its predecessor wrote.

All stages take empty tables, repeated rows, nulls in any column and extra columns of any names, which they keep; ``shard``, ``slot``,
``copy`` and ``shuffle_key`` are replaced where a stage adds them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from fitgauge.llm import decontamination, mixing, quality, sharding, simhash_dedup
from fitgauge.llm.shared import stored, table

SHARDS = 40


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and are no outliers of their language and source.

    Null and empty texts go. A null language or source is a value like others; rows equal in id, text, language and source share a fate.
    """
    return quality.accepted(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose SimHash fingerprints are linked at 4 or fewer bits: the least id, then the least text key.

    Rows without id come last; wordless texts are one group; of repeated rows one stays.
    """
    return simhash_dedup.representatives(docs, shingle_words=4, max_bits=4)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage that holds a benchmark item. Null and empty texts stay; an empty benchmark removes nothing."""
    return decontamination.clean(docs, table(spark, sf_dir, "benchmark"))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents replicated to tempered source weights, in a global random order.

    The count follows from id and source, so that repeated rows get equal counts; a null id counts as empty, a null source is a source.
    """
    added = [c for c in ("copy", "shuffle_key") if c not in docs.columns]
    return mixing.replicated(docs, mixing.tempered_rates(docs)).drop(*added)


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document copy with its shard of equal bytes and its slot. Equal texts are neighbours; a null text has no bytes but 16."""
    return sharding.sharded(docs, SHARDS)


STAGES = [
    ("quality rules", quality_rules),
    ("SimHash near-dedup", near_duplicates),
    ("benchmark decontamination", benchmark_decontamination),
    ("mixing sources to target weights", source_mixing),
    ("sharding", shards),
]

#: XXH64 fingerprints, covariance descents and WAND are beyond SQL; a test runs the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order. Each result is Parquet in the shared folder, and goes when the application ends."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES[:-1]):
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{i}")
    return STAGES[-1][1](spark, docs, sf_dir)
