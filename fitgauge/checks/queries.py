"""One query per operator: each takes a session and a data folder and returns a DataFrame.

Lists become comma-separated text and dates become text, so that any engine can compare the rows.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace
from datetime import datetime
from functools import partial, reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fitgauge.checks.fixtures import AS_OF, NESTED, Data
from fitgauge.functions import classify
from fitgauge.functions.names import COLUMN_KEYS, TABLE_KEYS, fqn, name_like_any, name_matches_any, type_family
from fitgauge.functions.points import data_readiness, metadata_readiness
from fitgauge.operators import candidates as c
from fitgauge.operators import estimate as e
from fitgauge.operators import file_states as fs
from fitgauge.operators import incremental as inc
from fitgauge.operators import profile as p
from fitgauge.operators import reports as r
from fitgauge.operators import score as s
from fitgauge.operators import table_score as ts
from fitgauge.plans import catalog_run, measured_run
from fitgauge.plans.text_fitness import text_fitness
from fitgauge.settings import DEFAULTS, PII_PATTERNS, TEXT_WORDS
from fitgauge.sources import catalog, crawl, store
from fitgauge.sources.tables import row_counts, sample_rows, scan_table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
DATABASE, SCHEMA = "LAKE", "PUBLIC"
ALL_TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
    "embeddings", "pages", "benchmark", "labels", "conversations",
)
NUMBERS = {
    "customer": ["c_custkey", "c_nationkey", "c_acctbal"],
    "supplier": ["s_suppkey", "s_nationkey", "s_acctbal"],
    "part": ["p_partkey", "p_size", "p_retailprice"],
    "orders": ["o_orderkey", "o_custkey", "o_totalprice"],
    "lineitem": [
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
        "l_discount", "l_tax",
    ],
    "events": ["event_id", "user_id", "value"],
    "labels": ["doc_id", "quality", "toxic"],
}
TEXTS = {
    "part": ["p_name", "p_brand", "p_type"],
    "orders": ["o_orderstatus", "o_orderpriority"],
    "events": ["event_type", "props"],
    "documents": ["text", "lang", "source"],
    "pages": ["url", "html"],
    "benchmark": ["text"],
    "conversations": ["role", "text"],
}
UNIQUE = {
    "documents": ["doc_id"], "pages": ["page_id"], "benchmark": ["item_id"], "events": ["event_id"],
    "conversations": ["conv_id", "turn"],
}
#: Tables that are profiled by file, with the columns that deal their rows out to files.
UNIQUE_KEYS = {
    "customer": ["c_custkey"], "orders": ["o_orderkey"], "part": ["p_partkey"], "events": ["event_id"], "documents": ["doc_id"],
}
CUSTOM_PII = (("money", ("^amount", "score")), ("place", ("^geo_", "address")))
INCLUDED = replace(DEFAULTS, include_databases=("db_0", "DB_3"), exclude_databases=("DB_0",))
EXCLUDED = replace(DEFAULTS, exclude_databases=("db_0", "DB_3"))
SMALL_BUDGET = replace(DEFAULTS, sample_bytes_budget=1_000_000)


def query(function: Callable[[Data], DataFrame]) -> Callable[[Data], DataFrame]:
    """Registers a query under its function name."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return flat(function(Data(spark, sf_dir)))

    QUERIES[function.__name__] = run
    return function


def flat(df: DataFrame) -> DataFrame:
    def plain(field: T.StructField) -> Column:
        if isinstance(field.dataType, T.ArrayType):
            return F.array_join(field.name, ",").alias(field.name)
        if isinstance(field.dataType, T.DateType):
            return F.col(field.name).cast("string").alias(field.name)
        return F.col(field.name)

    return df.select([plain(f) for f in df.schema.fields])


def settle(df: DataFrame, names: list[str]) -> DataFrame:
    """Rounds measured doubles, pushed off exact halves: engines add numbers up in different orders."""
    return df.withColumns({n: F.round(F.col(n) + 1e-7, 5) for n in names})


def union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def live_tables(d: Data) -> DataFrame:
    return catalog.catalog_tables(d.tables)


def live_columns(d: Data) -> DataFrame:
    return catalog.catalog_columns(d.columns)


def lake(d: Data) -> dict[tuple[str, str], DataFrame]:
    return {(SCHEMA, t): d.table(t) for t in ALL_TABLES}


def kept(d: Data, name: str, df: DataFrame) -> DataFrame:
    """A table by way of files, as an operator that reads it twice meets it in a run."""
    return measured_run.step(d.spark, store.work_dir(d.spark), name, lambda: df)


def rich(d: Data) -> DataFrame:
    return c.text_rich_columns(live_columns(d))


def found(d: Data) -> DataFrame:
    return c.all_candidates(live_columns(d))


def scored(d: Data) -> DataFrame:
    return catalog_run.scored_candidates(live_columns(d), d.profiles)


def table_scores(d: Data) -> DataFrame:
    return ts.table_readiness(
        live_tables(d), live_columns(d), catalog.catalog_constraints(d.constraints),
        catalog.catalog_storage(d.storage), AS_OF,
    )


def inputs(d: Data) -> DataFrame:
    return ts.readiness_inputs(
        live_tables(d), live_columns(d), catalog.catalog_constraints(d.constraints),
        catalog.catalog_storage(d.storage),
    )


def tagged(d: Data, columns: dict[str, list[str]], profile: Callable[..., DataFrame]) -> DataFrame:
    counts = row_counts({t: d.table(t) for t in columns})
    parts = [
        profile(d.table(t), cols, rows=counts[t]).withColumn("table_name", F.lit(t))
        for t, cols in columns.items()
    ]
    return union(parts)


# Catalog and sources


@query
def catalog_tables(d: Data) -> DataFrame:
    return live_tables(d)


@query
def catalog_columns(d: Data) -> DataFrame:
    return live_columns(d)


@query
def catalog_constraints(d: Data) -> DataFrame:
    return catalog.catalog_constraints(d.constraints)


@query
def catalog_storage(d: Data) -> DataFrame:
    return catalog.catalog_storage(d.storage)


@query
def catalog_stages(d: Data) -> DataFrame:
    return catalog.catalog_stages(d.stages)


@query
def catalog_databases(d: Data) -> DataFrame:
    return catalog.catalog_databases(d.tables)


@query
def catalog_schemas(d: Data) -> DataFrame:
    return catalog.catalog_schemas(d.tables)


@query
def crawl_columns(d: Data) -> DataFrame:
    return crawl.crawl_columns(d.spark, DATABASE, lake(d)).select(
        *COLUMN_KEYS, "ordinal_position", "data_type", "is_nullable"
    )


@query
def crawl_tables(d: Data) -> DataFrame:
    return crawl.crawl_tables(DATABASE, lake(d)).select(*TABLE_KEYS, "table_type", "row_count")


@query
def scan_table_column(d: Data) -> DataFrame:
    return scan_table(d.spark, f"{d.sf_dir}/documents.parquet", ["doc_id", "lang"])


@query
def sample_rows_by_key(d: Data) -> DataFrame:
    return sample_rows(d.table("events").select("event_id", "event_type", "value"), 1000, ["event_id"])


@query
def load_inventory(d: Data) -> DataFrame:
    path = f"{store.work_dir(d.spark)}/inventory"
    store.save_inventory(live_columns(d), path)
    return store.load_inventory(d.spark, path)


@query
def inventory_sets(d: Data) -> DataFrame:
    path = f"{store.work_dir(d.spark)}/inventory"
    store.save_inventory(live_columns(d), path)
    sets = store.inventory_sets(store.load_inventory(d.spark, path))
    counts = [df.agg(F.count("*").alias("value")).withColumn("metric", F.lit(n)) for n, df in sets.items()]
    return union(counts)


@query
def load_candidates(d: Data) -> DataFrame:
    path = f"{store.work_dir(d.spark)}/candidates"
    store.save(found(d), path, fmt="json")
    loaded = store.load_candidates(d.spark, path, "json")
    return loaded.select(*COLUMN_KEYS, "feature", "data_type", "max_length", "reason", "numeric_columns", "text_columns")


@query
def load_profile_cache(d: Data) -> DataFrame:
    """Stored twice; the newer run must win for each column."""
    path = f"{store.work_dir(d.spark)}/profiles"
    wanted = [((DATABASE, SCHEMA, t), cols) for t, cols in TEXTS.items()]
    for analysis, at in (("sample", datetime(2001, 1, 1)), ("full_scan", datetime(2001, 2, 1))):
        rows = inc.profile_tables(d.spark, wanted, lambda key: d.table(key[2]), analysis, at)
        store.save(rows, path, run_mode="append")
    loaded = store.load_profile_cache(d.spark, path)
    return loaded.select(*COLUMN_KEYS, "total_rows", "max_length", "analysis_type")


# Filters and name rules


@query
def live_rows(d: Data) -> DataFrame:
    return catalog.live_rows(d.columns).select(*COLUMN_KEYS, "ordinal_position", "data_type")


@query
def filter_databases_include(d: Data) -> DataFrame:
    return catalog.filter_databases(d.tables, INCLUDED).select(*TABLE_KEYS, "created")


@query
def filter_databases_exclude(d: Data) -> DataFrame:
    return catalog.filter_databases(d.tables, EXCLUDED).select(*TABLE_KEYS, "created")


@query
def not_system_schema(d: Data) -> DataFrame:
    system = replace(DEFAULTS, system_schema="S_3")
    return catalog.not_system_schema(d.tables, system).select(*TABLE_KEYS, "created")


@query
def analyzable(d: Data) -> DataFrame:
    return inc.analyzable(found(d)).select(*COLUMN_KEYS, "feature")


@query
def name_matches(d: Data) -> DataFrame:
    name = F.col("column_name")
    return live_columns(d).select(
        *COLUMN_KEYS,
        name_matches_any(name, TEXT_WORDS).alias("has_text_word"),
        name_like_any(name, PII_PATTERNS).alias("like_pii"),
    )


@query
def type_families(d: Data) -> DataFrame:
    return live_columns(d).select(*COLUMN_KEYS, type_family(F.col("data_type")).alias("family"))


@query
def full_names(d: Data) -> DataFrame:
    return live_columns(d).select(fqn(*COLUMN_KEYS).alias("name"), fqn(*COLUMN_KEYS, width=20).alias("clipped"))


@query
def content_sample(d: Data) -> DataFrame:
    return p.content_sample(d.table("documents"), "text", ["doc_id"])


# Joins


@query
def readiness_inputs(d: Data) -> DataFrame:
    return inputs(d).drop("table_type", "table_comment", "created")


@query
def table_keys(d: Data) -> DataFrame:
    return ts.table_keys(live_tables(d), live_columns(d))


@query
def candidate_stats(d: Data) -> DataFrame:
    stats = s.candidate_stats(found(d), live_columns(d), live_tables(d))
    return stats.select(
        *COLUMN_KEYS, "feature", "row_count", "non_null_count", "null_percentage", "avg_length",
        "estimated_max_length", "is_nullable", "has_comment", "source",
    )


@query
def candidate_profile(d: Data) -> DataFrame:
    return s.candidate_profile(found(d), d.profiles).select(*COLUMN_KEYS, "feature", "profile.*").drop("max_length")


@query
def confirmed_flag(d: Data) -> DataFrame:
    all_scored = scored(d)
    flagged = s.confirmed_flag(all_scored.drop("profile"), s.confirmed_only(all_scored))
    return flagged.select(*COLUMN_KEYS, "feature", "in_confirmed")


@query
def json_explode(d: Data) -> DataFrame:
    keys = F.explode(F.json_object_keys("props")).alias("json_key")
    return d.table("events").select("event_id", keys)


@query
def search_confirmed(d: Data) -> DataFrame:
    all_scored = scored(d)
    search = all_scored.filter("feature = 'search'")
    return s.search_confirmed(search, s.confirmed_only(all_scored)).select(*TABLE_KEYS, "reason")


@query
def new_candidates(d: Data) -> DataFrame:
    """Stored: candidates of the first-version catalog; found: those of the live one."""
    return inc.new_candidates(_stored(d), found(d)).select(*COLUMN_KEYS, "feature", "reason")


@query
def cache_miss(d: Data) -> DataFrame:
    return inc.cache_miss(inc.analyzable(found(d)), d.profiles)


def _stored(d: Data) -> DataFrame:
    """An earlier catalog: only the text and semi-structured candidates of two databases."""
    columns = catalog.catalog_columns(d.columns, INCLUDED)
    return c.llm_candidates(columns).unionByName(c.extract_candidates(columns))


# Candidates


@query
def llm_candidates(d: Data) -> DataFrame:
    return c.llm_candidates(live_columns(d))


@query
def extract_candidates(d: Data) -> DataFrame:
    return c.extract_candidates(live_columns(d)).drop("max_length")


@query
def forecast_candidates(d: Data) -> DataFrame:
    return c.forecast_candidates(live_columns(d))


@query
def search_candidates(d: Data) -> DataFrame:
    return c.search_candidates(live_columns(d))


@query
def all_candidates(d: Data) -> DataFrame:
    return found(d)


@query
def text_rich_columns(d: Data) -> DataFrame:
    return rich(d)


@query
def enhanced_llm(d: Data) -> DataFrame:
    return c.enhanced_llm(rich(d))


@query
def enhanced_search(d: Data) -> DataFrame:
    return c.enhanced_search(rich(d))


@query
def domain_tables(d: Data) -> DataFrame:
    return c.domain_tables(live_columns(d))


@query
def domain_subset(d: Data) -> DataFrame:
    return c.domain_subset(c.domain_tables(live_columns(d)))


@query
def document_columns(d: Data) -> DataFrame:
    return c.document_columns(live_columns(d))


@query
def pii_columns(d: Data) -> DataFrame:
    return c.pii_columns(live_columns(d))


@query
def pii_category(d: Data) -> DataFrame:
    return c.pii_columns(live_columns(d)).withColumn("category", c.pii_category())


@query
def pii_categories(d: Data) -> DataFrame:
    return c.pii_categories(c.pii_columns(live_columns(d)))


@query
def custom_pii(d: Data) -> DataFrame:
    return c.custom_pii(live_columns(d), replace(DEFAULTS, custom_pii=CUSTOM_PII))


@query
def scope_estimate(d: Data) -> DataFrame:
    return c.scope_estimate(d.tables, d.columns)


@query
def stage_opportunities(d: Data) -> DataFrame:
    return c.stage_opportunities(catalog.catalog_stages(d.stages))


# Profiling


@query
def numeric_profile(d: Data) -> DataFrame:
    return settle(tagged(d, NUMBERS, p.numeric_profile), p.VALUE_FIELDS)


@query
def text_profile(d: Data) -> DataFrame:
    return tagged(d, TEXTS, p.text_profile)


@query
def sparsity_cardinality(d: Data) -> DataFrame:
    columns = {t: [*TEXTS.get(t, []), *NUMBERS.get(t, [])] for t in (*TEXTS, "labels")}
    return tagged(d, columns, partial(p.sparsity_cardinality, exact=True))


def _within(d: Data, columns: dict[str, list[str]], profile: Callable, counted: str) -> DataFrame:
    """Are estimated distinct counts within three standard errors of the exact ones, which are returned?"""
    exact = tagged(d, columns, lambda df, names, rows: p.exact_distinct(df, names))
    estimates = tagged(d, columns, profile).select("table_name", "column_name", F.col(counted).alias("estimate"))
    error = 3 * 1.04 / 2 ** (DEFAULTS.sketch_bits / 2)
    close = F.abs(F.col("estimate") - F.col("distinct_count")) <= F.ceil(F.col("distinct_count") * error)
    return exact.join(estimates, ["table_name", "column_name"]).select(
        "table_name", "column_name", "distinct_count", close.alias("is_close"))


@query
def sparsity_cardinality_approx(d: Data) -> DataFrame:
    columns = {t: [*TEXTS.get(t, []), *NUMBERS.get(t, [])] for t in (*TEXTS, "labels")}
    return _within(d, columns, p.sparsity_cardinality, "distinct_count")


@query
def content_profile(d: Data) -> DataFrame:
    return tagged(d, TEXTS, p.content_profile)


def _props_with_errors(d: Data) -> DataFrame:
    broken = F.when(F.col("event_id") % 10 == 0, "oops").when(F.col("event_id") % 7 != 0, F.col("props"))
    return d.table("events").select("event_id", broken.alias("props"))


@query
def json_profile(d: Data) -> DataFrame:
    return p.json_profile(_props_with_errors(d), "props", ["event_id"])


@query
def json_profile_whole(d: Data) -> DataFrame:
    return p.json_profile(_props_with_errors(d), "props")


@query
def natural_language(d: Data) -> DataFrame:
    columns = {"documents": "text", "pages": "url", "benchmark": "text", "conversations": "text"}
    parts = [
        p.natural_language(d.table(t), col, UNIQUE[t]).withColumn("table_name", F.lit(t))
        for t, col in columns.items()
    ]
    return union(parts)


@query
def natural_language_whole(d: Data) -> DataFrame:
    named = {"documents": "text", "pages": "html"}
    parts = [
        p.natural_language(d.table(t), col).withColumn("table_name", F.lit(t)) for t, col in named.items()
    ]
    return union(parts)


def _text_targets(d: Data) -> dict:
    named = {"documents": "text", "benchmark": "text", "conversations": "text", "pages": "html"}
    return {(DATABASE, SCHEMA, t): (d.table(t), col, UNIQUE[t]) for t, col in named.items()}


@query
def sampled_text_profile(d: Data) -> DataFrame:
    return settle(p.sampled_text_profile(_text_targets(d)), ["avg_length"])


@query
def json_top_keys(d: Data) -> DataFrame:
    return p.json_top_keys(d.table("events"), "props", ["event_id"])


@query
def sampled_text_profile_whole(d: Data) -> DataFrame:
    whole = {names: (df, column, None) for names, (df, column, _) in _text_targets(d).items()}
    return settle(p.sampled_text_profile(whole), ["avg_length"])


@query
def json_top_keys_whole(d: Data) -> DataFrame:
    return p.json_top_keys(d.table("events"), "props")


@query
def json_path_types(d: Data) -> DataFrame:
    return p.json_path_types(d.table("events"), "props")


def _nested(d: Data) -> DataFrame:
    return d.table("events").select("event_id", "props", F.expr(NESTED).alias("nested"))


@query
def json_path_types_nested(d: Data) -> DataFrame:
    return p.json_path_types(_nested(d), "nested")


@query
def json_key_counts(d: Data) -> DataFrame:
    return p.json_key_counts(_nested(d), ["props", "nested"])


@query
def measured_json_profile(d: Data) -> DataFrame:
    """The most frequent keys of each semi-structured column, in the form of the estimated profile."""
    columns = d.spark.createDataFrame([(DATABASE, SCHEMA, "events", c, "VARIANT") for c in ("props", "nested")], [*COLUMN_KEYS, "data_type"])
    keys = p.json_key_counts(_nested(d), ["props", "nested"])
    named = keys.select(*(F.lit(v).alias(k) for k, v in zip(TABLE_KEYS, (DATABASE, SCHEMA, "events"))), "column_name", "json_key", "n")
    return e.estimated_json_profile(columns, keys=named)


@query
def adaptive_sample(d: Data) -> DataFrame:
    """The size comes from row and byte counts taken before the sample is read."""
    parts = []
    for t in ("documents", "pages", "benchmark"):
        df, column = d.table(t), TEXTS[t][-1] if t != "documents" else "text"
        rows, size = df.agg(F.count("*"), F.sum(F.octet_length(column))).first()
        sampled = p.adaptive_sample(df, [column], UNIQUE[t], rows, size, SMALL_BUDGET)
        parts.append(
            sampled.select(F.lit(t).alias("table_name"), "column_name", "total_rows", *p.LENGTH_FIELDS, "sample_size")
        )
    return union(parts)


@query
def full_scan_top_n(d: Data) -> DataFrame:
    columns = crawl.crawl_columns(d.spark, DATABASE, lake(d))
    first = s.score_candidate(c.all_candidates(columns), d.profiles)
    done = measured_run.full_scan_top_n(d.spark, first, lambda key: d.table(key[2]), AS_OF)
    return done.select(
        *COLUMN_KEYS, "feature", "profile.null_percentage", "profile.avg_length",
        F.col("profile.max_length").alias("longest"), *s.SCORES, "total_score",
    )


@query
def json_extract_text(d: Data) -> DataFrame:
    return p.json_extract_text(d.table("events"), "props", "$.k", ["event_id"], "k")


def _all_columns(d: Data) -> dict[str, list[str]]:
    """Every column but the vectors, whose text form differs between engines."""
    return {t: [n for n in d.table(t).columns if n != "embedding"] for t in ALL_TABLES}


@query
def profile_table(d: Data) -> DataFrame:
    whole = tagged(d, _all_columns(d), partial(p.profile_table, distinct=False))
    return settle(whole.drop("approx_distinct", "kind"), [*p.VALUE_FIELDS, "spaced_share"])


@query
def profile_status(d: Data) -> DataFrame:
    """Asks for every column of the lake, for one column that is not there, and for a missing table."""
    wanted = [((DATABASE, SCHEMA, t), d.table(t).columns) for t in ALL_TABLES]
    wanted += [((DATABASE, SCHEMA, "documents"), ["summary"]), ((DATABASE, SCHEMA, "archive"), ["text"])]
    rows = inc.profile_tables(d.spark, wanted, lambda key: d.table(key[2]), "full_scan", AS_OF)
    return rows.select(*COLUMN_KEYS, "status", F.substring_index("error", ":", 1).alias("error"), "non_null_count")


@query
def approx_distinct(d: Data) -> DataFrame:
    return _within(d, _all_columns(d), partial(p.profile_table, quantiles=False), "approx_distinct")


# Classifiers


def _ratio() -> Column:
    return F.col("non_null_count") / F.col("total_rows_sampled")


@query
def sparsity_class(d: Data) -> DataFrame:
    return d.profiles.select(*COLUMN_KEYS, classify.sparsity_class(F.col("null_percentage")).alias("sparsity"))


@query
def cardinality_class(d: Data) -> DataFrame:
    return d.profiles.select(*COLUMN_KEYS, classify.cardinality_class(_ratio()).alias("cardinality"))


@query
def content_class(d: Data) -> DataFrame:
    average = F.col("avg_length")
    return d.profiles.select(
        *COLUMN_KEYS,
        classify.content_class(average).alias("content_class"),
        classify.content_is_natural(average).alias("is_natural_language"),
        classify.content_is_structured(average).alias("is_structured"),
    )


@query
def text_quality_grade(d: Data) -> DataFrame:
    return r.graded_profiles(d.profiles)


@query
def recommended_functions(d: Data) -> DataFrame:
    return r.text_functions(scored(d))


# Estimates


@query
def column_metadata_stats(d: Data) -> DataFrame:
    return e.column_metadata_stats(live_columns(d), live_tables(d)).drop("numeric_precision", "numeric_scale")


@query
def metadata_readiness_points(d: Data) -> DataFrame:
    stats = s.candidate_stats(found(d), live_columns(d), live_tables(d))
    value = metadata_readiness(
        F.col("source").isNotNull(), F.col("null_percentage"), F.col("avg_length"), F.col("has_comment"),
        F.col("is_nullable"),
    )
    return stats.select(*COLUMN_KEYS, "feature", value.alias("readiness"))


@query
def data_readiness_points(d: Data) -> DataFrame:
    measured = s.candidate_profile(found(d), d.profiles)
    prof = F.col("profile")
    value = data_readiness(
        prof.isNotNull(), prof["null_percentage"], prof["avg_length"], prof["max_length"], F.col("max_length")
    )
    return measured.select(*COLUMN_KEYS, "feature", value.alias("readiness"))


@query
def estimated_text_profile(d: Data) -> DataFrame:
    return e.estimated_text_profile(rich(d))


@query
def estimated_json_profile(d: Data) -> DataFrame:
    return e.estimated_json_profile(c.extract_candidates(live_columns(d)))


@query
def document_text_fitness(d: Data) -> DataFrame:
    return text_fitness(d.table("documents"), ["text", "lang", "source"])


# Table readiness


def _dimension(name: str) -> Callable[[Data], DataFrame]:
    return lambda d: ts.dimension_scores(inputs(d), AS_OF).select(*TABLE_KEYS, name)


for _name in ts.DIMENSIONS:
    _one = _dimension(_name)
    _one.__name__ = f"score_{_name}"
    query(_one)


@query
def table_readiness(d: Data) -> DataFrame:
    return table_scores(d)


@query
def all_readiness(d: Data) -> DataFrame:
    return ts.all_readiness(table_scores(d)).select(*TABLE_KEYS, "total_score")


@query
def readiness_summary(d: Data) -> DataFrame:
    return ts.readiness_summary(table_scores(d), catalog.catalog_constraints(d.constraints))


@query
def top_tables(d: Data) -> DataFrame:
    return ts.top_tables(table_scores(d))


@query
def missing_comments(d: Data) -> DataFrame:
    return ts.missing_comments(table_scores(d))


@query
def stale_tables(d: Data) -> DataFrame:
    return ts.stale_tables(table_scores(d))


@query
def unsupported_columns(d: Data) -> DataFrame:
    return ts.unsupported_columns(live_columns(d))


@query
def unsupported_types(d: Data) -> DataFrame:
    return ts.unsupported_types(table_scores(d), live_columns(d))


@query
def scan_savings(d: Data) -> DataFrame:
    return ts.scan_savings(table_scores(d))


# Candidate scores


SCORED = [*COLUMN_KEYS, "feature", *s.SCORES, "total_score"]


@query
def score_candidate(d: Data) -> DataFrame:
    return s.score_candidate(found(d), d.profiles).select(SCORED)


@query
def score_candidate_inverted(d: Data) -> DataFrame:
    inverted = replace(DEFAULTS, invert_risk=True)
    return s.score_candidate(found(d), d.profiles, inverted).select(SCORED)


@query
def rescored(d: Data) -> DataFrame:
    return s.rescored(s.score_candidate(found(d), d.profiles)).select(SCORED)


@query
def rescored_from_metadata(d: Data) -> DataFrame:
    with_stats = s.candidate_stats(found(d), live_columns(d), live_tables(d))
    first = s.score_candidate(with_stats, d.profiles)
    return s.rescored_from_metadata(first).select(SCORED)


@query
def top_candidates(d: Data) -> DataFrame:
    return s.top_candidates(scored(d)).select(SCORED)


@query
def confirm_tables(d: Data) -> DataFrame:
    """Table-level candidates by the mean of their member columns."""
    rolled = s.rolled_up(scored(d).drop("is_confirmed", "confirmation_reasons", "priority"), d.profiles, live_columns(d))
    shown = s.confirm(rolled).filter("column_name is null").select(
        *TABLE_KEYS, "feature", "profile.null_percentage", "profile.avg_length", "data_readiness", "total_score", "is_confirmed")
    return settle(shown, ["null_percentage", "avg_length", "data_readiness", "total_score"])


@query
def confirm(d: Data) -> DataFrame:
    return scored(d).select(*COLUMN_KEYS, "feature", "is_confirmed")


@query
def confirm_reasons(d: Data) -> DataFrame:
    reasons = F.array_join("confirmation_reasons", "; ").alias("reasons")
    return scored(d).select(*COLUMN_KEYS, "feature", reasons)


@query
def confirmed_only(d: Data) -> DataFrame:
    return s.confirmed_only(scored(d)).select(SCORED)


@query
def priority_tier(d: Data) -> DataFrame:
    return scored(d).select(*COLUMN_KEYS, "feature", "priority")


@query
def priority_counts(d: Data) -> DataFrame:
    return s.priority_counts(scored(d))


@query
def feature_by_tier(d: Data) -> DataFrame:
    return s.feature_by_tier(scored(d))


@query
def dimension_assessment(d: Data) -> DataFrame:
    return s.dimension_assessment(scored(d))


# Reports


@query
def quality_overview(d: Data) -> DataFrame:
    return r.quality_overview(scored(d))


@query
def over_provisioned(d: Data) -> DataFrame:
    return r.over_provisioned(scored(d))


@query
def high_quality(d: Data) -> DataFrame:
    return r.high_quality(scored(d))


@query
def reconsider(d: Data) -> DataFrame:
    return r.reconsider(scored(d))


@query
def quality_by_feature(d: Data) -> DataFrame:
    return r.quality_by_feature(scored(d))


@query
def score_movers(d: Data) -> DataFrame:
    return r.score_movers(scored(d))


@query
def score_movers_since(d: Data) -> DataFrame:
    """Two runs store their scores, the first guesses and then those without risky names; what moved since the last run before."""
    path = f"{store.work_dir(d.spark)}/scores"
    first = kept(d, "first", s.score_candidate(found(d), d.profiles))
    store.save_scores(first, path, datetime(2001, 1, 1))
    store.save_scores(s.rescored(first).filter("governance_risk < 5"), path, datetime(2001, 2, 1))
    store.save_scores(s.rescored(first), path, AS_OF)
    return r.score_movers(scored(d), earlier=store.scores_before(d.spark, path, AS_OF))


@query
def score_shift_summary(d: Data) -> DataFrame:
    return r.score_shift_summary(scored(d))


@query
def feature_distribution(d: Data) -> DataFrame:
    return r.feature_distribution(found(d))


@query
def feature_confirmation(d: Data) -> DataFrame:
    return r.feature_confirmation(scored(d))


@query
def top_opportunities(d: Data) -> DataFrame:
    return r.top_opportunities(scored(d))


@query
def schema_profiles(d: Data) -> DataFrame:
    return r.schema_profiles(kept(d, "scored", scored(d).drop("profile")))


@query
def database_breakdown(d: Data) -> DataFrame:
    return r.database_breakdown(scored(d))


@query
def text_quality(d: Data) -> DataFrame:
    return r.text_quality(d.profiles)


@query
def best_text_column(d: Data) -> DataFrame:
    return r.best_text_column(d.profiles)


@query
def environment_counts(d: Data) -> DataFrame:
    return r.environment_counts(live_tables(d), live_columns(d), catalog.catalog_stages(d.stages), found(d))


@query
def enhanced_counts(d: Data) -> DataFrame:
    columns, texts = live_columns(d), rich(d)
    return r.enhanced_counts(
        c.enhanced_llm(texts), c.enhanced_search(texts), c.domain_tables(columns),
        c.document_columns(columns), c.pii_columns(columns),
    )


@query
def confirmation_rate(d: Data) -> DataFrame:
    return r.confirmation_rate(scored(d))


# Windows, sorts, sets


@query
def latest_version(d: Data) -> DataFrame:
    newest = [F.col("created").desc()]
    live = catalog.live_rows(d.stages)
    return catalog.latest_version(live, ["database_name", "schema_name", "stage_name"], newest).drop("deleted")


@query
def first_per_table(d: Data) -> DataFrame:
    return e.first_per_table(live_columns(d)).select(*COLUMN_KEYS, "ordinal_position")


@query
def top_k_per_group(d: Data) -> DataFrame:
    return r.top_k_per_group(scored(d)).select(*COLUMN_KEYS, "feature", "total_score", "rank")


@query
def rank_column(d: Data) -> DataFrame:
    order = [F.col("l_extendedprice").desc(), F.col("l_orderkey"), F.col("l_linenumber"), F.col("l_partkey")]
    lines = d.table("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")
    return r.rank_column(lines, order, 30)


@query
def first_match(d: Data) -> DataFrame:
    live = catalog.live_rows(d.columns)
    return s.first_match(live, COLUMN_KEYS, ["ordinal_position"]).select(*COLUMN_KEYS, "ordinal_position")


@query
def order_limit(d: Data) -> DataFrame:
    order = [F.col("o_totalprice").desc(), F.col("o_orderkey")]
    return d.table("orders").select("o_orderkey", "o_totalprice").orderBy(*order).limit(200)


@query
def union_all(d: Data) -> DataFrame:
    columns = live_columns(d)
    parts = c.llm_candidates(columns).unionByName(c.search_candidates(columns), allowMissingColumns=True)
    return parts.select(*COLUMN_KEYS, "feature", "reason")


@query
def distinct_sets(d: Data) -> DataFrame:
    return d.columns.select(*TABLE_KEYS).distinct()


# Incremental work and stored results


@query
def incremental_profile(d: Data) -> DataFrame:
    """A first run profiles two tables, a second one all; the first run's rows are reused."""
    path = f"{store.work_dir(d.spark)}/profiles"
    columns = crawl.crawl_columns(d.spark, DATABASE, lake(d))
    wanted = columns.filter("data_type <> 'ARRAY'").select(*COLUMN_KEYS)

    def run(keys: DataFrame, analysis: str, at: datetime) -> DataFrame:
        return inc.incremental_profile(
            d.spark, keys, lambda key: d.table(key[2]), path, at, analysis=analysis
        )

    run(wanted.filter("table_name in ('documents', 'part')"), "first", datetime(2001, 1, 1))
    done = run(wanted, "second", datetime(2001, 2, 1))
    return done.select(*COLUMN_KEYS, "total_rows", "non_null_count", "max_length", "analysis_type")


@query
def incremental_by_file(d: Data) -> DataFrame:
    """Each table is written as four files and profiled; after two more files a second run reads only those. Values from sketches
    are compared with exact ones around them."""
    work = store.work_dir(d.spark)
    # a sixth of the rows for each of the six files
    tables = {t: d.table(t).withColumn("at", F.pmod(F.xxhash64(*UNIQUE_KEYS[t]), F.lit(6))) for t in UNIQUE_KEYS}
    places = {(DATABASE, SCHEMA, t): f"{work}/{t}" for t in tables}
    for share, parts in ("at < 4", 4), ("at >= 4", 2):
        for t, df in tables.items():
            df.filter(share).drop("at").repartition(parts).write.mode("append").parquet(f"{work}/{t}")
        done = fs.profile_by_file(d.spark, places, f"{work}/states")
    states = store.read_or_empty(d.spark, f"{work}/states", fs.STATE_SCHEMA, parts=True)
    read = states.groupBy("table_name", "column_name").agg(F.count("*").alias("files_read"))
    exact = union([
        p.quantile_bounds(d.table(t), settings=DEFAULTS).withColumn("table_name", F.lit(t)) for t in tables])
    done = done.join(read, ["table_name", "column_name"]).join(exact, ["table_name", "column_name"], "left")
    near = F.lit(True)
    for name in ("median", "p95"):
        value = F.coalesce(F.col(f"{name}_value"), F.col(f"{name}_length"))
        near &= F.coalesce(value.between(F.col(f"{name}_low") - 0.01, F.col(f"{name}_high") + 0.01), F.lit(True))
    exact_fields = [*TABLE_KEYS, "column_name", "kind", "total_rows", "non_null_count", "null_percentage", "min_length", "max_length", "avg_length", "min_value", "max_value"]
    return settle(done.withColumn("is_near", near).select(*exact_fields, "files", "files_read", "is_near"), ["min_value", "max_value"])


@query
def merge_candidates(d: Data) -> DataFrame:
    existing, new = kept(d, "existing", _stored(d)), kept(d, "found", found(d))
    return inc.merge_candidates(existing, new).select(*COLUMN_KEYS, "feature", "reason")


@query
def add_candidates(d: Data) -> DataFrame:
    return inc.add_candidates(_stored(d), found(d)).select(*COLUMN_KEYS, "feature", "reason")


@query
def run_history(d: Data) -> DataFrame:
    path = f"{store.work_dir(d.spark)}/history"
    store.append_run(_stored(d), path, datetime(2001, 1, 1), "fresh", INCLUDED)
    store.append_run(found(d), path, datetime(2001, 2, 1), "append")
    return store.run_history(d.spark, path).withColumn("run_at", F.date_format("run_at", "yyyy-MM-dd"))


@query
def resume_from_step(d: Data) -> DataFrame:
    """The columns step is stored by one run and read back by the next."""
    root = store.work_dir(d.spark)
    measured_run.step(d.spark, root, "columns", lambda: live_columns(d))
    columns = measured_run.step(d.spark, root, "columns", lambda: live_columns(d), resume=True)
    return c.all_candidates(columns).groupBy("feature").agg(F.count("*").alias("candidates"))


@query
def write_outputs(d: Data) -> DataFrame:
    """Row counts read back from every format."""
    root = store.work_dir(d.spark)
    ready = kept(d, "scored", scored(d).drop("profile"))
    outputs = {"confirmed": s.confirmed_only(ready), "top": s.top_candidates(ready)}
    paths = store.write_outputs(outputs, root, formats=("parquet", "json", "csv"))

    def count(name: str, path: str) -> DataFrame:
        fmt = name.split(".")[1]
        reader = d.spark.read.schema("database_name string") if fmt != "parquet" else d.spark.read
        options = {"header": True, "enforceSchema": True} if fmt == "csv" else {}
        read = reader.options(**options).format(fmt).load(path)
        return read.agg(F.count("*").alias("rows")).select(F.lit(name).alias("output"), "rows")

    return union([count(n, path) for n, path in paths.items()])


@query
def run_mode(d: Data) -> DataFrame:
    """A fresh run, then an append run over more databases; old rows stay, new keys are added."""
    root = store.work_dir(d.spark)
    whole = kept(d, "scored", scored(d).drop("profile"))
    first = catalog.filter_databases(whole, INCLUDED)
    measured_run.publish(d.spark, first, root, datetime(2001, 1, 1))
    done = measured_run.publish(d.spark, whole, root, datetime(2001, 2, 1), run_mode="append")
    return done.select(*COLUMN_KEYS, "feature", "total_score", "is_confirmed", "priority")


@query
def measured_candidates(d: Data) -> DataFrame:
    """The whole run over the lake's own tables, from crawl to tier."""
    root = store.work_dir(d.spark)
    done = measured_run.measured_run(d.spark, DATABASE, lake(d), root, AS_OF)
    return done.select(*SCORED, "is_confirmed", "priority")


@query
def catalog_run_results(d: Data) -> DataFrame:
    """A whole catalog run: the number of rows of each of its results."""
    views = catalog_run.CatalogViews(d.tables, d.columns, d.constraints, d.storage, d.stages)
    results = catalog_run.catalog_run(views, d.profiles, AS_OF, store.work_dir(d.spark))
    counts = [
        df.agg(F.count("*").alias("rows")).select(F.lit(name).alias("result"), "rows")
        for name, df in results.items()
    ]
    return union(counts)
