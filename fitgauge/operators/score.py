"""Candidate scores, confirmation and priority."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fitgauge.functions.names import COLUMN_KEYS, TABLE_KEYS, name_matches_any
from fitgauge.functions.points import data_readiness, metadata_readiness
from fitgauge.operators.estimate import column_metadata_stats
from fitgauge.settings import DEFAULTS, Settings
from fitgauge.sources.catalog import latest_version

CANDIDATE_KEYS = [*COLUMN_KEYS, "feature"]
SCORES = ["business_potential", "data_readiness", "metadata_quality", "governance_risk"]
PROFILE_FIELDS = [
    "total_rows_sampled", "non_null_count", "null_percentage", "avg_length", "max_length",
    "is_natural_language", "is_valid_structure",
]


def first_match(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row per key: the first in the given order."""
    return latest_version(df, keys, [F.col(name).asc_nulls_last() for name in order])


def candidate_stats(
    candidates: DataFrame, columns: DataFrame, tables: DataFrame, settings: Settings = DEFAULTS
) -> DataFrame:
    """Catalog estimates beside each candidate; table-level candidates have none."""
    known = first_match(columns, COLUMN_KEYS, ["ordinal_position", "data_type"])
    stats = column_metadata_stats(known, tables, settings)
    renamed = stats.select(
        *COLUMN_KEYS,
        "row_count",
        "non_null_count",
        "null_percentage",
        "avg_length",
        "min_length",
        F.col("max_length").alias("estimated_max_length"),
        "is_nullable",
        "has_comment",
        F.lit("metadata_only").alias("source"),
    )
    return candidates.join(renamed, COLUMN_KEYS, "left")


def candidate_profile(candidates: DataFrame, profiles: DataFrame) -> DataFrame:
    """Measured profile beside each candidate, in a struct; null where nothing was measured."""
    order = [name for name in ("total_rows_sampled", "non_null_count", "avg_length") if name in profiles.columns]
    one = first_match(profiles, COLUMN_KEYS, order)
    packed = one.select(*COLUMN_KEYS, F.struct(*PROFILE_FIELDS).alias("profile"))
    return candidates.join(packed, COLUMN_KEYS, "left")


def business_points(settings: Settings = DEFAULTS) -> Column:
    (feature, points), *rest = settings.business
    chain = F.when(F.col("feature") == feature, points)
    for feature, points in rest:
        chain = chain.when(F.col("feature") == feature, points)
    return chain.otherwise(settings.default_business).cast("double")


def total_score(settings: Settings = DEFAULTS) -> Column:
    """Plain sum of the four scores; ``invert_risk`` counts low risk as good instead."""
    risk = F.col("governance_risk")
    if settings.invert_risk:
        risk = F.lit(6.0) - risk
    return F.col("business_potential") + F.col("data_readiness") + F.col("metadata_quality") + risk


def score_candidate(candidates: DataFrame, profiles: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """First scores of every candidate; expects one row per column in ``profiles`` at most."""
    with_profile = candidate_profile(candidates, profiles)
    non_null, total = F.col("profile.non_null_count"), F.col("profile.total_rows_sampled")
    filled = F.when((non_null > 0) & (total > 0), non_null / total)
    readiness = (
        F.when(filled > 0.9, 5)
        .when(F.col("profile.avg_length") > 100, 4)
        .otherwise(settings.default_readiness)
        .cast("double")
    )
    commented = F.coalesce(F.col("comment") != "", F.lit(False))
    risky = name_matches_any(F.col("column_name"), settings.risk_words) | name_matches_any(
        F.col("table_name"), settings.risk_words
    )
    return with_profile.withColumns(
        {
            "business_potential": business_points(settings),
            "data_readiness": readiness,
            "metadata_quality": F.when(commented, 4).otherwise(settings.default_metadata).cast("double"),
            "governance_risk": F.when(risky, 5).otherwise(settings.default_risk).cast("double"),
        }
    ).withColumn("total_score", total_score(settings))


def _replace_readiness(scored: DataFrame, has_stats: Column, value: Column, settings: Settings) -> DataFrame:
    kept = F.when(has_stats, value).otherwise(F.col("data_readiness"))
    return scored.withColumn("data_readiness", kept).withColumn("total_score", total_score(settings))


def rescored(scored: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """Puts measured readiness in place of the first guess, where a profile exists."""
    p = F.col("profile")
    value = data_readiness(
        F.lit(True), p["null_percentage"], p["avg_length"], p["max_length"], F.col("max_length"), settings
    )
    return _replace_readiness(scored, p.isNotNull(), value, settings)


def rescored_from_metadata(scored_with_stats: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """The same from catalog estimates, for candidates that went through ``candidate_stats``."""
    value = metadata_readiness(
        F.lit(True), F.col("null_percentage"), F.col("avg_length"), F.col("has_comment"),
        F.col("is_nullable"), settings,
    )
    return _replace_readiness(scored_with_stats, F.col("source").isNotNull(), value, settings)


def rolled_up(scored: DataFrame, profiles: DataFrame, columns: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """Gives table-level candidates the mean of their member columns: null share, lengths and readiness, so that they can be confirmed.

    Members are the columns a candidate names; those without a profile don't count, and a candidate without any stays as it is. It is
    natural language if half of its members are; readiness is the mean of what each member would get as a candidate. Not
    part of ``rescored``: without this step table-level candidates are never confirmed.
    """
    kind = dict(scored.dtypes)["profile"]
    keys = [*TABLE_KEYS, "feature"]
    named = F.concat(F.coalesce("numeric_columns", F.array()), F.coalesce("text_columns", F.array()))
    members = scored.filter("column_name is null").select(*keys, F.explode(named).alias("column_name")).distinct()
    declared = first_match(columns, COLUMN_KEYS, ["ordinal_position", "data_type"]).select(*COLUMN_KEYS, "character_maximum_length")
    found = candidate_profile(members, profiles).filter("profile is not null").join(declared, COLUMN_KEYS, "left")
    p = F.col("profile")
    ready = data_readiness(F.lit(True), p["null_percentage"], p["avg_length"], p["max_length"], F.col("character_maximum_length"), settings)

    def exact_mean(name: str) -> Column:
        return F.avg(F.col(name).cast("decimal(18,6)")).cast("double")  # whatever the order of the rows

    mean = found.withColumn("ready", ready).groupBy(*(F.col(k).alias(f"of_{k}") for k in keys)).agg(
        F.struct(
            F.sum("profile.total_rows_sampled"), F.sum("profile.non_null_count"), exact_mean("profile.null_percentage"),
            exact_mean("profile.avg_length"), F.max("profile.max_length"),
            F.avg(F.col("profile.is_natural_language").cast("double")) >= 0.5, F.lit(None).cast("boolean"),
        ).cast(kind).alias("mean"),
        F.avg("ready").alias("ready"),
    )
    same = F.col("column_name").isNull()
    for k in keys:
        same &= F.col(k).eqNullSafe(F.col(f"of_{k}"))
    joined = scored.join(mean, same, "left")
    joined = joined.withColumns({"profile": F.coalesce("mean", "profile"), "data_readiness": F.coalesce("ready", "data_readiness")})
    return joined.withColumn("total_score", total_score(settings)).select(*scored.columns)


def candidate_order() -> list[Column]:
    return [F.col("total_score").desc(), *[F.col(k).asc_nulls_first() for k in CANDIDATE_KEYS]]


def _names_column() -> Column:
    named = F.lit(True)
    for key in COLUMN_KEYS:
        named &= F.col(key).isNotNull()
    return named


def is_scorable() -> Column:
    """Whether a candidate can be chosen for a full scan."""
    return F.col("total_score").isNotNull() & _names_column()


def is_analyzable() -> Column:
    """Whether a candidate names a column whose data can be read."""
    return F.col("feature").isin("llm", "extract") & _names_column()


def top_candidates(scored: DataFrame, n: int | None = None, settings: Settings = DEFAULTS) -> DataFrame:
    """Best column-level candidates; runs as one top-n operator, without a full sort."""
    n = settings.top_candidates if n is None else n
    return scored.filter(is_scorable()).orderBy(*candidate_order()).limit(n)


def _checks(settings: Settings) -> dict[str, Column]:
    p = F.col("profile")
    null_percentage = F.coalesce(p["null_percentage"], F.lit(100.0))
    average = p["avg_length"]
    if not settings.strict_empty:
        average = F.nullif(average, F.lit(0.0))
    reads_text = F.col("feature").isin("llm", "search")
    structured = F.col("feature") == "extract"
    return {
        "null_percentage": null_percentage,
        "average": average,
        "dense": null_percentage <= settings.max_null_percentage,
        "short": reads_text & F.coalesce(average < settings.min_average_length, F.lit(False)),
        "long": reads_text & F.coalesce(average >= settings.min_average_length, F.lit(False)),
        "codes": reads_text & F.coalesce(~p["is_natural_language"], F.lit(False)),
        "prose": reads_text & F.coalesce(p["is_natural_language"], F.lit(False)),
        "broken": structured & F.coalesce(~p["is_valid_structure"], F.lit(False)),
        "valid": structured & F.coalesce(p["is_valid_structure"], F.lit(False)),
        "ready": F.coalesce(F.col("data_readiness") >= settings.min_readiness, F.lit(False)),
    }


def is_confirmed(settings: Settings = DEFAULTS) -> Column:
    c = _checks(settings)
    return c["dense"] & ~c["short"] & ~c["codes"] & ~c["broken"] & c["ready"]


def confirmation_reasons(settings: Settings = DEFAULTS) -> Column:
    """One text per check, with the number it looked at."""
    c = _checks(settings)
    missing, average, readiness = c["null_percentage"], c["average"], F.col("data_readiness")
    # The wording and number formats of the reasons.
    return F.array_compact(
        F.array(
            F.when(c["dense"], F.format_string("Good completeness (%.1f%% populated)", 100 - missing))
            .otherwise(F.format_string("High sparsity (%.1f%% NULL)", missing)),
            F.when(c["short"], F.format_string("Short content (avg %.1f chars)", average))
            .when(c["long"], F.format_string("Substantial content (avg %.1f chars)", average)),
            F.when(c["codes"], F.lit("Content appears to be codes/structured, not natural language"))
            .when(c["prose"], F.lit("Natural language content detected")),
            F.when(c["broken"], F.lit("Invalid JSON structure detected"))
            .when(c["valid"], F.lit("Valid JSON structure confirmed")),
            F.when(c["ready"], F.format_string("Good data readiness (%.2f)", readiness))
            .otherwise(F.format_string("Low data readiness score (%.2f)", readiness)),
        )
    )


def confirm(scored: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """Flags the candidates whose data supports what the catalog suggested."""
    return scored.withColumns(
        {"is_confirmed": is_confirmed(settings), "confirmation_reasons": confirmation_reasons(settings)}
    )


def confirmed_only(confirmed: DataFrame) -> DataFrame:
    return confirmed.filter("is_confirmed")


def confirmed_flag(candidates: DataFrame, confirmed: DataFrame) -> DataFrame:
    """Flag by membership of the key in a list of confirmed candidates; null-safe for table rows."""
    keys = confirmed.select(CANDIDATE_KEYS).distinct().withColumn("hit", F.lit(True))
    joined = candidates.alias("c").join(
        keys.alias("k"),
        [F.col(f"c.{k}") == F.col(f"k.{k}") for k in [*TABLE_KEYS, "feature"]]
        + [F.col("c.column_name").eqNullSafe(F.col("k.column_name"))],
        "left",
    )
    return joined.select("c.*", F.col("k.hit").isNotNull().alias("in_confirmed"))


def search_confirmed(search: DataFrame, confirmed: DataFrame) -> DataFrame:
    """Search candidates whose table holds a confirmed candidate of any kind."""
    return search.join(confirmed.select(*TABLE_KEYS), TABLE_KEYS, "left_semi")


def priority_tier(settings: Settings = DEFAULTS) -> Column:
    low_risk = F.coalesce(F.col("governance_risk"), F.lit(5.0)) <= settings.first_tier_risk
    return (
        F.when((F.col("total_score") >= settings.first_tier) & low_risk, "P1")
        .when(F.col("total_score") >= settings.second_tier, "P2")
        .otherwise("P3")
    )


def with_tier(scored: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    return scored.withColumn("priority", priority_tier(settings))


def priority_counts(tiered: DataFrame) -> DataFrame:
    """Candidates and confirmed candidates per tier."""
    return tiered.groupBy("priority").agg(
        F.count("*").alias("candidates"), F.count_if("is_confirmed").alias("confirmed")
    )


def feature_by_tier(tiered: DataFrame) -> DataFrame:
    counts = tiered.groupBy("feature").pivot("priority", ["P1", "P2", "P3"]).count()
    return counts.fillna(0, ["P1", "P2", "P3"])


def dimension_assessment(scored: DataFrame) -> DataFrame:
    # Cut-offs and labels.
    def label(name: str, cut: int, good: str, other: str) -> Column:
        return F.when(F.col(name) >= cut, good).otherwise(other)

    return scored.select(
        *CANDIDATE_KEYS,
        label("business_potential", 4, "High value", "Moderate value").alias("business"),
        label("data_readiness", 4, "Ready", "Needs validation").alias("readiness"),
        label("metadata_quality", 3, "Well documented", "Limited docs").alias("documentation"),
        F.when(F.col("governance_risk") <= 3, "Low risk").otherwise("Review needed").alias("risk"),
    )
