"""Candidate columns and tables, found in the catalog.

Table-level rules never collect a table's columns: counts are partial aggregates, and the few names a
candidate shows come from a ranked filter, so a table with millions of columns costs no more memory
than any other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fitgauge import settings as s
from fitgauge.functions.names import (
    COLUMN_KEYS,
    TABLE_KEYS,
    joined_on,
    name_like_any,
    name_matches_any,
    name_regex_any,
)
from fitgauge.settings import DEFAULTS, Settings
from fitgauge.sources.catalog import filter_databases, live_rows, top_rows

CANDIDATE_FIELDS = [
    *COLUMN_KEYS, "feature", "data_type", "max_length", "comment", "reason", "numeric_columns",
    "text_columns",
]


def _name_order() -> list[Column]:
    return [F.col("ordinal_position"), F.col("column_name")]


def _long_enough(length: int) -> Column:
    return F.coalesce(F.col("character_maximum_length") >= length, F.lit(False))


def _first_names(df: DataFrame, keys: list[str], n: int) -> DataFrame:
    """The first ``n`` column names of each group, in column order, as an array."""
    ranked = top_rows(df, keys, _name_order(), n)
    ordered = F.array_sort(F.collect_list(F.struct("rank", "column_name")))
    return ranked.groupBy(*keys).agg(F.transform(ordered, lambda x: x["column_name"]).alias("names"))


def column_candidates(columns: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """Text and semi-structured candidates, both found in one pass."""
    is_text = name_matches_any(F.col("data_type"), s.TEXT_TYPE_PARTS)
    is_long = _long_enough(settings.min_text_length)
    named = name_matches_any(F.col("column_name"), settings.text_words)
    nested = F.upper("data_type").isin(*s.SEMI_STRUCTURED_TYPES)
    feature = F.when(is_text & (is_long | named), "llm").when(nested, "extract")
    # Wording of the reasons, here and below.
    text_reason = F.concat(
        F.lit("Text column ("),
        F.col("data_type"),
        F.lit(") - "),
        F.when(is_long, "long text").otherwise("semantic name"),
    )
    nested_reason = F.concat(F.lit("Semi-structured "), F.col("data_type"), F.lit(" column"))
    return (
        columns.withColumn("feature", feature)
        .filter(F.col("feature").isNotNull())
        .select(
            *COLUMN_KEYS,
            "feature",
            "data_type",
            F.when(F.col("feature") == "llm", F.col("character_maximum_length")).alias("max_length"),
            F.col("column_comment").alias("comment"),
            F.when(F.col("feature") == "llm", text_reason).otherwise(nested_reason).alias("reason"),
        )
    )


def llm_candidates(columns: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """Text columns that are long, or whose name says they hold prose."""
    return column_candidates(columns, settings).filter("feature = 'llm'")


def extract_candidates(columns: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """Semi-structured columns; the type must match without parameters."""
    return column_candidates(columns, settings).filter("feature = 'extract'")


def table_candidates(columns: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """Forecast and search candidates together.

    A column counts for the role it can play in its table: time, number or text. One aggregation counts
    the roles of every table and one ranked filter keeps the first names of each.
    """
    roles = F.array_compact(
        F.array(
            F.when(name_matches_any(F.col("data_type"), s.TIME_TYPE_PARTS), "time"),
            F.when(name_matches_any(F.col("data_type"), s.FORECAST_NUMERIC_PARTS), "number"),
            F.when(
                name_matches_any(F.col("data_type"), s.SEARCH_TYPE_PARTS)
                & _long_enough(settings.min_search_length),
                "text",
            ),
        )
    )
    played = columns.select(*COLUMN_KEYS, "ordinal_position", F.explode(roles).alias("role"))
    counts = played.groupBy(*TABLE_KEYS).agg(
        *[F.count_if(F.col("role") == role).alias(role) for role in ("time", "number", "text")]
    )
    named = played.filter("role <> 'time'")
    names = _first_names(named, [*TABLE_KEYS, "role"], settings.names_per_candidate)
    forecast = (F.col("role") == "number") & (F.col("time") > 0)
    search = (F.col("role") == "text") & (F.col("text") >= settings.min_search_columns)
    return joined_on(names, counts, TABLE_KEYS).filter(forecast | search).select(
        *TABLE_KEYS,
        F.when(forecast, "forecast").otherwise("search").alias("feature"),
        F.when(forecast, F.format_string("Has timestamp + %d numeric columns", "number"))
        .otherwise(F.format_string("%d substantial text columns", "text"))
        .alias("reason"),
        F.when(forecast, F.col("names")).alias("numeric_columns"),
        F.when(search, F.col("names")).alias("text_columns"),
    )


def forecast_candidates(columns: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """Tables with a time column and at least one numeric column."""
    return table_candidates(columns, settings).filter("feature = 'forecast'").drop("text_columns")


def search_candidates(columns: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """Tables with several substantial text columns."""
    return table_candidates(columns, settings).filter("feature = 'search'").drop("numeric_columns")


def all_candidates(columns: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    return (
        column_candidates(columns, settings)
        .unionByName(table_candidates(columns, settings), allowMissingColumns=True)
        .select(CANDIDATE_FIELDS)
    )


def text_rich_columns(columns: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    named = name_matches_any(F.col("column_name"), settings.rich_text_words)
    return columns.filter(
        F.col("data_type").isin(*s.RICH_TEXT_TYPES) & (_long_enough(settings.min_rich_length) | named)
    ).select(
        *COLUMN_KEYS, "ordinal_position", "data_type", "character_maximum_length", "column_comment"
    )


def enhanced_llm(rich: DataFrame) -> DataFrame:
    return rich.select(
        *COLUMN_KEYS,
        F.lit("llm").alias("feature"),
        "data_type",
        F.col("character_maximum_length").alias("max_length"),
        F.col("column_comment").alias("comment"),
        F.format_string("Text column '%s'", "column_name").alias("reason"),
    )


def enhanced_search(rich: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """Tables with several rich text columns."""
    counts = rich.groupBy(*TABLE_KEYS).agg(F.count("*").alias("texts"))
    names = _first_names(rich, TABLE_KEYS, settings.names_per_rich_candidate)
    several = counts.filter(F.col("texts") >= settings.min_search_columns)
    return joined_on(several, names, TABLE_KEYS).select(
        *TABLE_KEYS,
        F.lit("search").alias("feature"),
        F.format_string("%d text columns", "texts").alias("reason"),
        F.col("names").alias("text_columns"),
    )


def domain_tables(columns: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """Distinct tables whose name has a word of the domain list."""
    named = name_matches_any(F.col("table_name"), settings.domain_words)
    return columns.filter(named).select(*TABLE_KEYS).distinct()


def domain_subset(tables: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """How many domain tables mention the subset word anywhere in their full name."""
    text = F.concat_ws(" ", *TABLE_KEYS)
    hit = name_matches_any(text, [settings.domain_subset_word])
    return tables.agg(F.count("*").alias("domain_tables"), F.count_if(hit).alias("subset_tables"))


def document_columns(columns: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """Columns whose name suggests a file."""
    hit = name_like_any(F.col("column_name"), settings.document_patterns)
    return columns.filter(hit).select(*COLUMN_KEYS, "data_type")


def pii_columns(columns: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """Columns whose name suggests personal data."""
    hit = name_like_any(F.col("column_name"), settings.pii_patterns)
    return columns.filter(hit).select(*COLUMN_KEYS, "data_type")


def pii_category(settings: Settings = DEFAULTS) -> Column:
    """First matching category. The whole row is searched, so a table name counts too."""
    text = F.concat_ws(" ", *COLUMN_KEYS, "data_type")
    (name, words), *rest = settings.pii_categories
    chain = F.when(name_matches_any(text, words), name)
    for name, words in rest:
        chain = chain.when(name_matches_any(text, words), name)
    return chain.otherwise("Other")


def pii_categories(pii: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    return pii.groupBy(pii_category(settings).alias("category")).agg(F.count("*").alias("columns"))


def custom_pii(columns: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """Columns matched by the caller's own patterns, one row per category matched."""
    hits = [
        F.when(name_regex_any(F.col("column_name"), patterns), F.lit(category))
        for category, patterns in settings.custom_pii
    ]
    matched = F.array_compact(F.array(*hits)) if hits else F.array().cast("array<string>")
    return columns.select(*COLUMN_KEYS, F.explode(matched).alias("category"))


def scope_estimate(tables: DataFrame, columns: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """Size of a run before it starts, as (metric, value) rows; raw live rows are counted."""
    live_tables = filter_databases(live_rows(tables), settings)
    live_columns = filter_databases(live_rows(columns), settings)
    guess = name_matches_any(F.col("data_type"), s.SCOPE_TYPE_PARTS) & name_matches_any(
        F.col("column_name"), settings.text_words[: settings.scope_words]
    )
    by_table = live_tables.agg(
        F.count_distinct("database_name").alias("databases"), F.count("*").alias("tables")
    )
    by_column = live_columns.agg(F.count("*").alias("columns"), F.count_if(guess).alias("candidates"))
    profiled = F.least(F.col("candidates"), F.lit(settings.top_candidates))
    return by_table.select(
        F.explode(
            F.create_map(
                F.lit("databases"), F.col("databases"),
                F.lit("tables"), F.col("tables"),
                F.lit("discovery_seconds"), F.col("databases") * settings.seconds_per_database,
            )
        ).alias("metric", "value")
    ).unionByName(
        by_column.select(
            F.explode(
                F.create_map(
                    F.lit("columns"), F.col("columns"),
                    F.lit("estimated_candidates"), F.col("candidates"),
                    F.lit("profiling_seconds"), profiled * settings.seconds_per_candidate,
                )
            ).alias("metric", "value")
        )
    )


def stage_opportunities(stages: DataFrame) -> DataFrame:
    """Every live stage is a chance for document processing."""
    return stages.agg(F.count("*").alias("stages"))
