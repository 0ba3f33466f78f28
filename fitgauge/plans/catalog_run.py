"""A run over catalog views alone: table readiness, candidates, scores, tiers."""

from __future__ import annotations

from dataclasses import dataclass, fields
from datetime import datetime

from pyspark.sql import DataFrame

from fitgauge.operators import candidates as c
from fitgauge.operators import reports as r
from fitgauge.operators import score
from fitgauge.operators import table_score as ts
from fitgauge.settings import DEFAULTS, Settings
from fitgauge.sources import catalog, store


@dataclass(frozen=True)
class CatalogViews:
    """Raw views, with dropped objects and old versions still in them."""

    tables: DataFrame
    columns: DataFrame
    constraints: DataFrame
    storage: DataFrame
    stages: DataFrame


def current(views: CatalogViews, settings: Settings = DEFAULTS) -> CatalogViews:
    """Live objects in their newest version."""
    return CatalogViews(
        catalog.catalog_tables(views.tables, settings),
        catalog.catalog_columns(views.columns, settings),
        catalog.catalog_constraints(views.constraints, settings),
        catalog.catalog_storage(views.storage, settings),
        catalog.catalog_stages(views.stages, settings),
    )


def readiness(views: CatalogViews, as_of: datetime, settings: Settings = DEFAULTS) -> DataFrame:
    """Readiness of every table, from current views."""
    return ts.table_readiness(
        views.tables, views.columns, views.constraints, views.storage, as_of, settings
    )


def scored_candidates(columns: DataFrame, profiles: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """Candidates with scores from measured profiles, confirmation and tier.

    Scores come first, so that the best candidates can be picked from them.
    """
    found = c.all_candidates(columns, settings)
    scored = score.rescored(score.score_candidate(found, profiles, settings), settings)
    return score.with_tier(score.confirm(scored, settings), settings)


def stored(views: CatalogViews, root: str) -> CatalogViews:
    """The views by way of tables under ``root``. A run reads them many times, each time a few columns;
    from files that is a pruned scan, from the raw views it would rank all versions again."""

    def one(name: str) -> DataFrame:
        df = getattr(views, name)
        store.save(df, f"{root}/{name}")
        return df.sparkSession.read.parquet(f"{root}/{name}")

    return CatalogViews(**{f.name: one(f.name) for f in fields(CatalogViews)})


def catalog_run(
    views: CatalogViews, profiles: DataFrame, as_of: datetime, root: str, settings: Settings = DEFAULTS
) -> dict[str, DataFrame]:
    """Every result of a run by name, from raw views and measured profiles.

    The current views, table readiness and scored candidates are stored under ``root``; the reports are
    read from those.
    """
    now = stored(current(views, settings), root)
    spark = now.columns.sparkSession
    for name, df in (
        ("readiness", readiness(now, as_of, settings)),
        ("candidates", scored_candidates(now.columns, profiles, settings)),
    ):
        store.save(df, f"{root}/{name}")
    scores, found = spark.read.parquet(f"{root}/readiness"), spark.read.parquet(f"{root}/candidates")
    rich = c.text_rich_columns(now.columns, settings)
    pii = c.pii_columns(now.columns, settings)
    domain, documents = c.domain_tables(now.columns, settings), c.document_columns(now.columns, settings)
    top = score.top_candidates(found, settings=settings)
    return {
        "readiness": scores,
        "readiness_summary": ts.readiness_summary(scores, now.constraints, settings),
        "top_tables": ts.top_tables(scores),
        "missing_comments": ts.missing_comments(scores),
        "stale_tables": ts.stale_tables(scores),
        "unsupported_types": ts.unsupported_types(scores, now.columns),
        "scan_savings": ts.scan_savings(scores),
        "candidates": found,
        "confirmed": score.confirmed_only(found),
        "top_candidates": top,
        "domain_tables": domain,
        "document_columns": documents,
        "pii_columns": pii,
        "pii_categories": c.pii_categories(pii, settings),
        "stage_opportunities": c.stage_opportunities(now.stages),
        "environment_counts": r.environment_counts(now.tables, now.columns, now.stages, found),
        "enhanced_counts": r.enhanced_counts(
            c.enhanced_llm(rich), c.enhanced_search(rich, settings), domain, documents, pii
        ),
        "quality_overview": r.quality_overview(found, settings),
        "quality_by_feature": r.quality_by_feature(found, settings),
        "over_provisioned": r.over_provisioned(found),
        "high_quality": r.high_quality(found, settings=settings),
        "reconsider": r.reconsider(found, settings=settings),
        "score_movers": r.score_movers(found, settings=settings),
        "score_shift_summary": r.score_shift_summary(found, settings),
        "priority_counts": score.priority_counts(found),
        "feature_by_tier": score.feature_by_tier(found),
        "feature_confirmation": r.feature_confirmation(found),
        "top_opportunities": r.top_opportunities(found),
        "schema_profiles": r.schema_profiles(found),
        "database_breakdown": r.database_breakdown(found),
        "confirmation_rate": r.confirmation_rate(found),
        "text_quality": r.text_quality(profiles),
        "best_text_column": r.best_text_column(profiles),
    }
