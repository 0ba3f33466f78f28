"""Report tables over scored candidates and profiles.

Each is one aggregation, or one top-n: sort and limit run as a single operator that keeps n rows per
task, so no report sorts all candidates. Ties end on the candidate's key.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fitgauge.functions.classify import fill_sparsity, recommended_functions, text_quality_grade
from fitgauge.functions.names import COLUMN_KEYS, TABLE_KEYS, fqn
from fitgauge.operators.score import CANDIDATE_KEYS, candidate_order, is_analyzable, is_scorable
from fitgauge.operators.table_score import ranked
from fitgauge.settings import DEFAULTS, Settings
from fitgauge.sources.catalog import top_rows


def _key_order() -> list[Column]:
    return [F.col(k).asc_nulls_first() for k in CANDIDATE_KEYS]


def _share(part: Column, whole: Column, digits: int = 1) -> Column:
    return F.when(whole > 0, F.round(part / whole * 100, digits)).otherwise(0.0)


def _name(width: int) -> Column:
    return fqn(*COLUMN_KEYS, width=width).alias("name")


def _analyzed() -> Column:
    return F.col("profile").isNotNull()


def quality_overview(scored: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """Counts of all candidates in one pass: measured, good, poor, chosen for full scans, and readable ones that have no profile."""
    readiness = F.col("data_readiness")
    counts = scored.agg(
        F.count("*").alias("total"),
        F.count_if(_analyzed()).alias("analyzed"),
        F.count_if(readiness >= settings.high_quality).alias("high_quality"),
        F.count_if(readiness <= settings.low_quality).alias("low_quality"),
        F.least(F.count_if(is_scorable()), F.lit(settings.top_candidates)).cast("bigint").alias("full_scans"),
        F.count_if(is_analyzable() & ~_analyzed()).alias("errors"),
    )
    return counts.withColumn("analysis_rate", _share(F.col("analyzed"), F.col("total")))


def over_provisioned(scored: DataFrame, n: int = 20) -> DataFrame:
    """Columns whose values fill little of the declared length, worst first."""
    average, declared = F.col("profile.avg_length"), F.col("max_length")
    efficiency = F.when((declared > 0) & (average > 0), average / declared * 100)
    found = scored.withColumn("efficiency", efficiency).filter(F.col("efficiency") < 25)
    return ranked(found, [F.col("efficiency"), *_key_order()], n).select(
        "rank",
        _name(60),
        F.col("max_length").alias("declared_length"),
        average.alias("avg_length"),
        F.round("efficiency", 4).alias("efficiency"),
        F.floor(average * 2).alias("suggested_length"),
    )


def high_quality(scored: DataFrame, n: int = 30, settings: Settings = DEFAULTS) -> DataFrame:
    good = scored.filter(F.col("data_readiness") >= settings.high_quality)
    return ranked(good, candidate_order(), n).select(
        "rank",
        _name(60),
        "total_score",
        F.coalesce("profile.avg_length", F.lit(0.0)).alias("avg_length"),
        F.coalesce("profile.null_percentage", F.lit(100.0)).alias("null_percentage"),
        "feature",
    )


def reconsider(scored: DataFrame, n: int = 20, settings: Settings = DEFAULTS) -> DataFrame:
    nulls = F.coalesce(F.col("profile.null_percentage"), F.lit(100.0))
    average = F.col("profile.avg_length")
    short = (average > 0) & (average < 50)
    poor = scored.filter(F.col("data_readiness") <= settings.low_quality)
    # Names of the issues.
    return ranked(poor, _key_order(), n).select(
        "rank",
        _name(60),
        "total_score",
        "data_readiness",
        F.when(nulls > 50, "High NULL rate").when(short, "Short content").otherwise("Low quality").alias("issue"),
        F.when(nulls > 50, F.format_string("%.1f%% NULLs", nulls))
        .when(short, F.format_string("Avg %.1f chars", average))
        .otherwise("Multiple factors")
        .alias("detail"),
    )


def quality_by_feature(scored: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    counts = scored.groupBy("feature").agg(
        F.count("*").alias("total"),
        F.count_if(_analyzed()).alias("analyzed"),
        F.count_if(F.col("data_readiness") >= settings.high_quality).alias("high_quality"),
        F.round(F.avg("data_readiness"), 2).alias("average_readiness"),
    )
    return counts.withColumn("analysis_rate", _share(F.col("analyzed"), F.col("total")))


def score_movers(scored: DataFrame, n: int = 15, settings: Settings = DEFAULTS, earlier: DataFrame | None = None) -> DataFrame:
    """Largest changes of readiness, up and down: against the scores of an earlier run (``store.scores_before``), or else against the
    baseline readiness. Candidates that an earlier run did not have have not moved."""
    nulls = F.coalesce(F.col("profile.null_percentage"), F.lit(100.0))
    average = F.coalesce(F.col("profile.avg_length"), F.lit(0.0))
    moved = scored.filter(_analyzed())
    if earlier is None:
        moved = moved.withColumn("before", F.lit(settings.baseline_readiness))
    else:
        past = earlier.select(*(F.col(k).alias(f"past_{k}") for k in CANDIDATE_KEYS), F.col("data_readiness").alias("before"))
        same = [F.col(k).eqNullSafe(F.col(f"past_{k}")) for k in CANDIDATE_KEYS]
        moved = moved.join(past, reduce(lambda a, b: a & b, same))
    moved = moved.withColumn("change", F.col("data_readiness") - F.col("before"))
    # Wording of the reasons.
    rose = (
        F.when((nulls <= 10) & (average >= 200), "High quality + rich content")
        .when(nulls <= 10, "Excellent completeness")
        .when(average >= 200, "Rich content")
        .otherwise("Good data quality")
    )
    fell = (
        F.when(nulls > 70, F.format_string("High NULLs (%.1f%%)", nulls))
        .when(average < 50, F.format_string("Short content (%.1f chars)", average))
        .when(nulls > 50, F.format_string("Many NULLs (%.1f%%)", nulls))
        .otherwise("Data quality issues")
    )

    def side(direction: str, rows: DataFrame, order: Column, reason: Column) -> DataFrame:
        return ranked(rows, [order, *_key_order()], n).select(
            F.lit(direction).alias("direction"),
            "rank",
            _name(55),
            "before",
            F.col("data_readiness").alias("after"),
            "change",
            reason.alias("reason"),
        )

    up = side("up", moved.filter("change > 0"), F.col("change").desc(), rose)
    return up.unionByName(side("down", moved.filter("change < 0"), F.col("change"), fell))


def score_shift_summary(scored: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """Readiness of candidates with measured data, and how many moved."""
    after = F.when(_analyzed(), F.col("data_readiness"))
    base = settings.baseline_readiness
    counts = scored.agg(
        F.count("*").alias("total"),
        F.count(after).alias("with_data"),
        F.round(F.avg(after), 2).alias("average_readiness"),
        F.count_if(after >= settings.high_quality).alias("high"),
        F.count_if(after <= settings.low_quality).alias("low"),
        F.count_if(after > base).alias("improved"),
        F.count_if(after < base).alias("declined"),
    )
    return counts.select(
        "*",
        (F.col("total") - F.col("with_data")).alias("without_data"),
        _share(F.col("high"), F.col("with_data")).alias("high_rate"),
        _share(F.col("low"), F.col("with_data")).alias("low_rate"),
    )


def feature_distribution(candidates: DataFrame) -> DataFrame:
    counts = candidates.groupBy("feature").agg(F.count("*").alias("candidates"))
    return counts.orderBy(F.col("candidates").desc(), "feature")


def feature_confirmation(confirmed: DataFrame) -> DataFrame:
    return confirmed.groupBy("feature").agg(
        F.count("*").alias("candidates"),
        F.count_if("is_confirmed").alias("confirmed"),
        F.max("total_score").alias("top_score"),
    )


def top_opportunities(scored: DataFrame, n: int = 10) -> DataFrame:
    return ranked(scored, candidate_order(), n).select(
        "rank", _name(60), "feature", "total_score", F.substring("reason", 1, 50).alias("rationale")
    )


def top_k_per_group(scored: DataFrame, n: int = 20) -> DataFrame:
    """Best candidates of each schema and feature; the rank filter is applied before the shuffle."""
    order = [F.col("total_score").desc(), *[F.col(k).asc_nulls_first() for k in ("table_name", "column_name")]]
    return top_rows(scored, ["database_name", "schema_name", "feature"], order, n)


def schema_profiles(scored: DataFrame, n: int = 20) -> DataFrame:
    """The best candidates of each schema and feature beside the size of the whole group."""
    keys = ["database_name", "schema_name", "feature"]
    sizes = scored.groupBy(*keys).agg(F.count("*").alias("group_size"))
    best = top_k_per_group(scored, n).select(
        *CANDIDATE_KEYS, "rank", "total_score", "reason", "data_type", "business_potential",
        "data_readiness", "metadata_quality", "governance_risk",
    )
    return best.join(sizes, keys)


def database_breakdown(confirmed: DataFrame) -> DataFrame:
    counts = confirmed.groupBy("database_name").agg(
        F.count_distinct("schema_name", "table_name").alias("tables"),
        F.count("*").alias("candidates"),
        F.count_if("is_confirmed").alias("confirmed"),
    )
    return counts.withColumn("confirmation_rate", _share(F.col("confirmed"), F.col("candidates")))


def _longest_first(profiles: DataFrame, n: int) -> DataFrame:
    order = [F.col("avg_length").desc_nulls_last(), *[F.col(k) for k in COLUMN_KEYS]]
    return ranked(profiles, order, n)


def text_quality(profiles: DataFrame, n: int = 20) -> DataFrame:
    sparsity = fill_sparsity(F.col("non_null_count"), F.col("total_rows_sampled"))
    return _longest_first(profiles, n).select(
        "rank",
        fqn("table_name", "column_name", width=40).alias("name"),
        "avg_length",
        "max_length",
        F.round(sparsity, 4).alias("sparsity"),
        text_quality_grade(sparsity, F.col("avg_length")).alias("quality"),
    )


def graded_profiles(profiles: DataFrame) -> DataFrame:
    """The grade of every profile, without the report's cut."""
    sparsity = fill_sparsity(F.col("non_null_count"), F.col("total_rows_sampled"))
    return profiles.select(
        *COLUMN_KEYS,
        F.round(sparsity, 4).alias("sparsity"),
        text_quality_grade(sparsity, F.col("avg_length")).alias("quality"),
    )


def best_text_column(profiles: DataFrame, n: int = 5) -> DataFrame:
    return _longest_first(profiles, n).select("rank", fqn(*COLUMN_KEYS).alias("name"), "avg_length")


def text_functions(scored: DataFrame) -> DataFrame:
    """Functions worth trying on each text column."""
    names = recommended_functions(F.col("column_name"), F.col("profile.avg_length"), F.col("max_length"))
    return scored.filter("feature = 'llm'").select(*COLUMN_KEYS, names.alias("functions"))


def environment_counts(
    tables: DataFrame, columns: DataFrame, stages: DataFrame, candidates: DataFrame
) -> DataFrame:
    """What was analysed, as (metric, value) rows."""

    def count(metric: str, df: DataFrame) -> DataFrame:
        return df.agg(F.count("*").alias("value")).select(F.lit(metric).alias("metric"), "value")

    parts = [
        count("databases", tables.select("database_name").distinct()),
        count("schemas", tables.select("database_name", "schema_name").distinct()),
        count("tables", tables),
        count("columns", columns),
        count("stages", stages),
        count("candidates", candidates),
    ]
    return reduce(DataFrame.unionByName, parts)


def enhanced_counts(
    llm: DataFrame,
    search: DataFrame,
    domain: DataFrame,
    documents: DataFrame,
    pii: DataFrame,
    listed_llm: int = 1000,
    listed_search: int = 500,
) -> DataFrame:
    """Full list sizes beside the sizes the exchange file shows."""

    def count(metric: str, df: DataFrame, cap: int | None = None) -> DataFrame:
        n = F.count("*")
        shown = n if cap is None else F.least(n, F.lit(cap).cast("bigint"))
        return df.agg(n.alias("total"), shown.alias("listed")).select(F.lit(metric).alias("metric"), "total", "listed")

    parts = [
        count("llm_candidates", llm, listed_llm),
        count("search_candidates", search, listed_search),
        count("domain_tables", domain),
        count("document_columns", documents),
        count("pii_columns", pii),
    ]
    return reduce(DataFrame.unionByName, parts)


def confirmation_rate(confirmed: DataFrame) -> DataFrame:
    counts = confirmed.agg(F.count("*").alias("candidates"), F.count_if("is_confirmed").alias("confirmed"))
    return counts.withColumn("confirmation_rate", _share(F.col("confirmed"), F.col("candidates")))


def rank_column(df: DataFrame, order: list[Column], n: int) -> DataFrame:
    """1-based rank of the first ``n`` rows."""
    return ranked(df, order, n)
