"""Point rules for data readiness on the 0-5 scale."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from fitgauge.settings import DEFAULTS, Settings


def null_points(null_percentage: Column, settings: Settings = DEFAULTS) -> Column:
    best, good, fair, poor = settings.null_cuts
    return (
        F.when(null_percentage <= best, 2.0)
        .when(null_percentage <= good, 1.5)
        .when(null_percentage <= fair, 1.0)
        .when(null_percentage <= poor, 0.5)
        .otherwise(0.0)
    )


def length_points(average_length: Column) -> Column:
    return (
        F.when(average_length >= 200, 2.0)
        .when(average_length >= 100, 1.5)
        .when(average_length >= 50, 1.0)
        .when(average_length > 0, 0.5)
        .otherwise(0.0)
    )


def metadata_readiness(
    has_stats: Column,
    null_percentage: Column,
    average_length: Column,
    has_comment: Column,
    is_nullable: Column,
    settings: Settings = DEFAULTS,
) -> Column:
    """Readiness from catalog estimates; unknown null share counts as 50 percent."""
    comment = F.coalesce(has_comment, F.lit(False)).cast("int")
    required = F.coalesce(is_nullable == "NO", F.lit(False)).cast("int")
    points = (
        null_points(F.coalesce(null_percentage, F.lit(50.0)), settings)
        + length_points(average_length)
        + (comment + required) * 0.5
    )
    return F.when(has_stats, F.round(F.least(points, F.lit(5.0)), 2)).otherwise(F.lit(1.0))


def data_readiness(
    has_stats: Column,
    null_percentage: Column,
    average_length: Column,
    max_length: Column,
    declared_length: Column,
    settings: Settings = DEFAULTS,
) -> Column:
    """Readiness from measured data; unknown null share counts as 100 percent."""
    used = F.when(declared_length > 0, max_length / declared_length * 100)
    points = (
        null_points(F.coalesce(null_percentage, F.lit(100.0)), settings)
        + length_points(average_length)
        + F.when(used > 50, 1.0).when(used >= 25, 0.5).otherwise(0.0)
    )
    return F.when(has_stats, F.round(points, 2)).otherwise(F.lit(1.0))
