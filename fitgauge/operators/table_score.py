"""Table readiness, 0-100, from catalog views alone.

Columns and constraints are reduced to one row per table first (partial aggregation), so the joins
meet small sides that share one partitioning. No join is hinted: Spark broadcasts a side only when
its measured size allows it and otherwise sorts and merges.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fitgauge.functions.names import TABLE_KEYS, fqn, present, type_family
from fitgauge.functions.times import instant
from fitgauge.settings import DEFAULTS, Settings
from fitgauge.sources.catalog import top_rows

DIMENSIONS = ["comments", "data_types", "freshness", "clustering", "constraints"]


def table_keys(tables: DataFrame, columns: DataFrame) -> DataFrame:
    """Every table seen in either view."""
    return tables.select(*TABLE_KEYS).union(columns.select(*TABLE_KEYS)).distinct()


def column_summary(columns: DataFrame) -> DataFrame:
    family = type_family(F.col("data_type"))
    return columns.groupBy(*TABLE_KEYS).agg(
        F.count("*").alias("total_columns"),
        F.count_if(present(F.col("column_comment"))).alias("commented_columns"),
        F.count_if(family == "unsupported").alias("unsupported_columns"),
        F.count_if(family == "semi_structured").alias("semi_structured_columns"),
    )


def constraint_summary(constraints: DataFrame) -> DataFrame:
    kind = F.upper("constraint_type")
    return constraints.groupBy(*TABLE_KEYS).agg(
        F.bool_or(kind == "PRIMARY KEY").alias("has_primary_key"),
        F.bool_or(kind == "FOREIGN KEY").alias("has_foreign_key"),
        F.bool_or(kind == "UNIQUE").alias("has_unique"),
        F.array_sort(F.collect_set("constraint_type")).alias("constraint_types"),
    )


def readiness_inputs(
    tables: DataFrame, columns: DataFrame, constraints: DataFrame, storage: DataFrame
) -> DataFrame:
    """One row per table key, with what each dimension needs; absent parts are null or zero."""
    known = tables.select(
        *TABLE_KEYS, "table_type", "row_count", "bytes", "table_comment", "created", "last_altered",
        "clustering_key",
    )
    sizes = storage.select(*TABLE_KEYS, "active_bytes")
    zero = ["total_columns", "commented_columns", "unsupported_columns", "semi_structured_columns"]
    return (
        known.join(column_summary(columns), TABLE_KEYS, "full")
        .join(constraint_summary(constraints), TABLE_KEYS, "left")
        .join(sizes, TABLE_KEYS, "left")
        .fillna(0, zero)
    )


def score_comments(df: DataFrame) -> Column:
    share = F.when(
        F.col("total_columns") > 0, F.col("commented_columns") / F.col("total_columns") * 60.0
    ).otherwise(0.0)
    table = F.when(present(F.col("table_comment")), 40.0).otherwise(0.0)
    return F.round(F.least(table + share, F.lit(100.0)), 2)


def score_data_types(df: DataFrame) -> Column:
    partial = F.col("semi_structured_columns") * 0.5
    full = F.col("total_columns") - F.col("unsupported_columns") - F.col("semi_structured_columns")
    return F.when(
        F.col("total_columns") > 0, F.round((full + partial) / F.col("total_columns") * 100, 2)
    ).otherwise(0.0)


def as_timestamp(df: DataFrame, name: str) -> Column:
    """Dates and timestamps as they are; text that cannot be read becomes null."""
    col = F.col(name)
    return F.try_to_timestamp(col) if df.schema[name].dataType.simpleString() == "string" else col.cast(
        "timestamp"
    )


def score_freshness(df: DataFrame, as_of: datetime, settings: Settings = DEFAULTS) -> Column:
    """By whole days since the last change; a change in the future counts as fresh."""
    age = F.timestamp_diff("DAY", as_timestamp(df, "last_altered"), instant(as_of))
    steps = F.when(age.isNull(), 0.0)
    for days, points in settings.freshness_steps:
        steps = steps.when(age <= days, points)
    return steps.otherwise(10.0)


def score_clustering(df: DataFrame, settings: Settings = DEFAULTS) -> Column:
    key = present(F.col("clustering_key"))
    large = F.coalesce(F.col("active_bytes") > settings.large_table_bytes, F.lit(False))
    return F.when(key & large, 100.0).when(key, 70.0).when(large, 10.0).otherwise(0.0)


def score_constraints(df: DataFrame) -> Column:
    def points(name: str, value: float) -> Column:
        return F.when(F.col(name), value).otherwise(0.0)

    return points("has_primary_key", 50.0) + points("has_foreign_key", 30.0) + points("has_unique", 20.0)


def dimension_scores(inputs: DataFrame, as_of: datetime, settings: Settings = DEFAULTS) -> DataFrame:
    return inputs.withColumns(
        {
            "comments": score_comments(inputs),
            "data_types": score_data_types(inputs),
            "freshness": score_freshness(inputs, as_of, settings),
            "clustering": score_clustering(inputs, settings),
            "constraints": score_constraints(inputs),
        }
    )


def table_readiness(
    tables: DataFrame,
    columns: DataFrame,
    constraints: DataFrame,
    storage: DataFrame,
    as_of: datetime,
    settings: Settings = DEFAULTS,
) -> DataFrame:
    """Five dimension scores, their weighted total and the facts behind them, per table."""
    scored = dimension_scores(readiness_inputs(tables, columns, constraints, storage), as_of, settings)
    total = sum(
        (F.col(name) * weight for name, weight in zip(DIMENSIONS, settings.table_weights)), F.lit(0.0)
    )
    coverage = F.when(
        F.col("total_columns") > 0,
        F.round(F.col("commented_columns") / F.col("total_columns") * 100, 1),
    ).otherwise(0.0)
    return scored.select(
        *TABLE_KEYS,
        F.round(total, 2).alias("total_score"),
        *DIMENSIONS,
        present(F.col("table_comment")).alias("has_table_comment"),
        "commented_columns",
        "total_columns",
        coverage.alias("comment_coverage"),
        "unsupported_columns",
        F.coalesce("constraint_types", F.array().cast("array<string>")).alias("constraint_types"),
        "table_type",
        "row_count",
        "bytes",
        "created",
        "last_altered",
        F.coalesce("clustering_key", F.lit("")).alias("clustering_key"),
    )


def by_score() -> list[Column]:
    return [F.col("total_score").desc(), *[F.col(k) for k in TABLE_KEYS]]


def all_readiness(readiness: DataFrame) -> DataFrame:
    """Best tables first."""
    return readiness.orderBy(*by_score())


def ranked(df: DataFrame, order: list[Column], n: int) -> DataFrame:
    """First ``n`` rows with their rank. The sort keeps n rows per task, so the window sees n rows."""
    top = df.orderBy(*order).limit(n)
    return top.withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(*order)))


def readiness_summary(readiness: DataFrame, constraints: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    score = F.col("total_score")
    high, medium = settings.high_readiness, settings.medium_readiness
    by_table = readiness.agg(
        F.count("*").alias("total_tables"),
        F.coalesce(F.round(F.avg(score), 2), F.lit(0.0)).alias("average_score"),
        F.count_if(score >= high).alias("high_readiness"),
        F.count_if((score >= medium) & (score < high)).alias("medium_readiness"),
        F.count_if(score < medium).alias("low_readiness"),
        F.coalesce(F.sum("total_columns"), F.lit(0)).alias("total_columns"),
    )
    found = constraints.agg(F.count("*").alias("n")).scalar()
    return by_table.withColumn("total_constraints", found)


def top_tables(readiness: DataFrame, n: int = 30) -> DataFrame:
    return ranked(readiness, by_score(), n).select(
        "rank", fqn(*TABLE_KEYS, width=55).alias("name"), "total_score", *DIMENSIONS, "row_count"
    )


def missing_comments(readiness: DataFrame, n: int = 15) -> DataFrame:
    return ranked(readiness.filter(F.col("comments") < 20), by_score(), n).select(
        "rank", fqn(*TABLE_KEYS, width=50).alias("name"), "comments", "commented_columns", "total_columns"
    )


def stale_tables(readiness: DataFrame, n: int = 15) -> DataFrame:
    return ranked(readiness.filter(F.col("freshness") <= 25), by_score(), n).select(
        "rank", fqn(*TABLE_KEYS, width=50).alias("name"), "freshness", "last_altered"
    )


def unsupported_columns(columns: DataFrame) -> DataFrame:
    """Every column of a type that AI functions cannot read."""
    found = columns.filter(type_family(F.col("data_type")) == "unsupported")
    label = F.concat(F.col("column_name"), F.lit(" ("), F.upper("data_type"), F.lit(")"))
    return found.select(*TABLE_KEYS, "column_name", "ordinal_position", "data_type", label.alias("label"))


def unsupported_types(readiness: DataFrame, columns: DataFrame, n: int = 15, names: int = 3) -> DataFrame:
    """Best tables that hold such columns, with the first few of them.

    The table list is cut to ``n`` first; the join then keeps only their columns.
    """
    top = ranked(readiness.filter(F.col("unsupported_columns") > 0), by_score(), n).select(
        "rank", *TABLE_KEYS, "total_score"
    )
    found = unsupported_columns(columns).join(top.select(*TABLE_KEYS), TABLE_KEYS, "left_semi")
    first = top_rows(found, TABLE_KEYS, [F.col("ordinal_position"), F.col("column_name")], names)
    listed = first.groupBy(*TABLE_KEYS).agg(
        F.array_sort(F.collect_list(F.struct("rank", "label"))).alias("found")
    )
    return top.join(listed, TABLE_KEYS).select(
        "rank",
        fqn(*TABLE_KEYS, width=50).alias("name"),
        "total_score",
        F.array_join(F.transform("found", lambda x: x["label"]), ", ").alias("columns"),
    )


def scan_savings(readiness: DataFrame) -> DataFrame:
    """Scans a per-table method needs against the four catalog reads used here."""
    tables = F.count("*")
    return readiness.agg(
        tables.alias("tables"),
        (tables * 3).alias("table_scans"),
        F.lit(4).cast("bigint").alias("metadata_queries"),
    )
