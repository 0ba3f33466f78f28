"""Classes for measured columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from fitgauge.functions.names import name_matches_any
from fitgauge.settings import DEFAULTS, Settings


def sparsity_class(null_percentage: Column, settings: Settings = DEFAULTS) -> Column:
    low, medium, high = settings.sparsity_cuts
    return (
        F.when(null_percentage.isNull(), "unknown")
        .when(null_percentage <= low, "low")
        .when(null_percentage <= medium, "medium")
        .when(null_percentage <= high, "high")
        .otherwise("very_high")
    )


def cardinality_class(unique_ratio: Column, settings: Settings = DEFAULTS) -> Column:
    low, high = settings.cardinality_cuts
    return (
        F.when(unique_ratio.isNull(), "unknown")
        .when(unique_ratio <= low, "low")
        .when(unique_ratio >= high, "high")
        .otherwise("medium")
    )


def content_class(average_length: Column, settings: Settings = DEFAULTS) -> Column:
    return (
        F.when(average_length.isNull(), "unknown")
        .when(average_length < settings.code_length, "code")
        .when(average_length < settings.meaningful_length, "short_text")
        .when(average_length < settings.rich_length, "meaningful_text")
        .otherwise("rich_content")
    )


def content_is_natural(average_length: Column, settings: Settings = DEFAULTS) -> Column:
    return F.coalesce(average_length >= settings.meaningful_length, F.lit(False))


def content_is_structured(average_length: Column, settings: Settings = DEFAULTS) -> Column:
    return F.coalesce(average_length < settings.code_length, F.lit(False))


def fill_sparsity(non_null: Column, total: Column) -> Column:
    """Percentage of sampled rows that hold no value; 100 when nothing was sampled."""
    return F.when(total > 0, 100 - F.coalesce(non_null, F.lit(0)) / total * 100).otherwise(F.lit(100.0))


def text_quality_grade(sparsity: Column, average_length: Column) -> Column:
    # The cut-offs and names of the grades.
    return (
        F.when((sparsity < 30) & (F.coalesce(average_length, F.lit(0.0)) > 50), "Good")
        .when(sparsity < 60, "Fair")
        .otherwise("Poor")
    )


def recommended_functions(column_name: Column, average_length: Column, max_length: Column) -> Column:
    """Names of the text functions worth trying on a column."""
    length = F.coalesce(average_length, max_length.cast("double"), F.lit(100.0))
    return F.array_compact(
        F.array(
            F.when(length > 200, F.lit("summarize")),
            F.lit("sentiment"),
            F.lit("classify"),
            F.when(name_matches_any(column_name, ["DESCRIPTION", "CONTENT"]), F.lit("translate")),
        )
    )
