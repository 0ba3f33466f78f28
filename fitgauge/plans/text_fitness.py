"""How fit for text work is each column of a table?"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fitgauge.functions import classify
from fitgauge.functions.points import data_readiness
from fitgauge.operators.profile import profile_table
from fitgauge.settings import DEFAULTS, Settings


def text_fitness(
    df: DataFrame,
    columns: Sequence[str],
    settings: Settings = DEFAULTS,
    *,
    declared_length: int | None = None,
) -> DataFrame:
    """Measured lengths and null share of each column, its classes and its readiness; one scan."""
    profiled = profile_table(df, columns, settings, distinct=False)
    nulls, average = F.col("null_percentage"), F.col("avg_length")
    declared = F.lit(declared_length).cast("bigint")
    return profiled.select(
        "column_name",
        "total_rows",
        "non_null_count",
        nulls,
        "min_length",
        "max_length",
        average,
        "median_length",
        "p95_length",
        classify.sparsity_class(nulls, settings).alias("sparsity"),
        classify.content_class(average, settings).alias("content_class"),
        classify.content_is_natural(average, settings).alias("is_natural_language"),
        data_readiness(
            F.col("total_rows") > 0, nulls, average, F.col("max_length"), declared, settings
        ).alias("data_readiness"),
    )
