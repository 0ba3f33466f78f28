"""All thresholds, weights and word lists, in one immutable object."""

from __future__ import annotations

from dataclasses import dataclass, field

# Type names, word lists and cut-offs that define the results.

UNSUPPORTED_TYPES = ("BINARY", "VARBINARY", "GEOGRAPHY", "GEOMETRY")
SEMI_STRUCTURED_TYPES = ("VARIANT", "OBJECT", "ARRAY")
TEXT_TYPES = ("VARCHAR", "TEXT", "STRING", "CHAR", "CHARACTER")
NUMERIC_TYPES = (
    "NUMBER", "DECIMAL", "NUMERIC", "INT", "INTEGER", "BIGINT", "SMALLINT", "TINYINT",
    "BYTEINT", "FLOAT", "FLOAT4", "FLOAT8", "DOUBLE", "DOUBLE PRECISION", "REAL",
)
TEMPORAL_TYPES = (
    "DATE", "DATETIME", "TIME", "TIMESTAMP", "TIMESTAMP_LTZ", "TIMESTAMP_NTZ", "TIMESTAMP_TZ",
)

# Parts of a type name, looked for anywhere in it. They differ from the families above on purpose.
TEXT_TYPE_PARTS = ("VARCHAR", "TEXT", "STRING", "CHAR")
SEARCH_TYPE_PARTS = ("VARCHAR", "TEXT", "STRING")
SCOPE_TYPE_PARTS = ("VARCHAR", "TEXT")
TIME_TYPE_PARTS = ("TIMESTAMP", "DATE")
FORECAST_NUMERIC_PARTS = ("NUMBER", "FLOAT", "DECIMAL", "INTEGER", "DOUBLE")
NUMERIC_TYPE_PARTS = ("NUMBER", "INT", "FLOAT", "DOUBLE", "DECIMAL")
RICH_TEXT_TYPES = ("TEXT", "VARCHAR", "STRING")

TEXT_WORDS = (
    "DESCRIPTION", "CONTENT", "MESSAGE", "NOTE", "SUMMARY", "DETAIL", "BODY", "TEXT", "COMMENT",
    "FEEDBACK", "REVIEW", "ABSTRACT", "BIO", "NARRATIVE", "TITLE", "SUBJECT",
)
RICH_TEXT_WORDS = (
    "DESCRIPTION", "CONTENT", "MESSAGE", "NOTE", "SUMMARY", "DETAIL", "BODY", "TEXT", "COMMENT",
    "FEEDBACK", "REVIEW", "ABSTRACT", "NARRATIVE",
)
DOMAIN_WORDS = (
    "CURRICULUM", "LESSON", "COURSE", "STUDENT", "LEARNING", "ASSESSMENT", "QUESTION", "ANSWER",
    "CONTENT", "RESOURCE", "FEEDBACK", "SKILL", "GRADE", "SCORE", "TEST",
)
DOCUMENT_PATTERNS = (
    "%FILE%PATH%", "%FILE%URL%", "%DOCUMENT%", "%PDF%", "%ATTACHMENT%", "%S3%", "%BLOB%", "%IMAGE%",
)
PII_PATTERNS = (
    "%EMAIL%", "%SSN%", "%SOCIAL%SECURITY%", "%PHONE%", "%ADDRESS%", "%FIRST%NAME%",
    "%LAST%NAME%", "%BIRTH%", "%DOB%", "%PASSWORD%", "%SECRET%", "%CREDENTIAL%",
)
PII_CATEGORIES = (
    ("Email", ("EMAIL",)),
    ("Name", ("NAME", "FIRST", "LAST")),
    ("Phone", ("PHONE", "MOBILE")),
    ("Address", ("ADDRESS", "STREET", "CITY")),
    ("Date of Birth", ("DOB", "BIRTH")),
    ("SSN", ("SSN", "SOCIAL")),
)
RISK_WORDS = (
    "EMAIL", "SSN", "PHONE", "ADDRESS", "NAME", "DOB", "BIRTH", "PASSWORD", "SECRET",
)


@dataclass(frozen=True)
class Settings:
    # A limit of None keeps everything.

    # scope
    include_databases: tuple[str, ...] = ()
    exclude_databases: tuple[str, ...] = ()
    system_schema: str = "INFORMATION_SCHEMA"

    # candidate rules
    text_words: tuple[str, ...] = TEXT_WORDS
    rich_text_words: tuple[str, ...] = RICH_TEXT_WORDS
    domain_words: tuple[str, ...] = DOMAIN_WORDS
    domain_subset_word: str = "STUDENT"
    document_patterns: tuple[str, ...] = DOCUMENT_PATTERNS
    pii_patterns: tuple[str, ...] = PII_PATTERNS
    pii_categories: tuple[tuple[str, tuple[str, ...]], ...] = PII_CATEGORIES
    custom_pii: tuple[tuple[str, tuple[str, ...]], ...] = ()
    risk_words: tuple[str, ...] = RISK_WORDS
    min_text_length: int = 500
    min_search_length: int = 200
    min_search_columns: int = 2
    min_rich_length: int = 1000
    names_per_candidate: int = 5
    names_per_rich_candidate: int = 10

    # scope estimate
    scope_words: int | None = None
    seconds_per_database: int = 2
    seconds_per_candidate: int = 5

    # profiling
    sample_sizes: tuple[int, ...] = (10000, 1000, 100)
    sample_bytes_budget: int = 64 * 1024 * 1024
    json_sample: int = 1000
    json_key_sample: int = 100
    json_key_limit: int | None = None
    json_columns: int | None = None
    top_json_keys: int = 20
    content_sample: int = 100
    content_values: int = 10
    content_min_length: int = 20
    text_profile_tables: int | None = None
    text_profile_sample: int = 1000
    estimated_profiles: int | None = None
    sketch_bits: int = 12
    columns_per_scan: int = 100
    rank_values: int = 4_000_000
    quantile_sketch: int = 1000
    profile_fan_in: int = 256
    jobs_in_flight: int = 8
    tables_per_crawl: int = 32
    files_per_job: int = 1000

    # classifiers
    sparsity_cuts: tuple[float, float, float] = (10.0, 30.0, 70.0)
    cardinality_cuts: tuple[float, float] = (0.01, 0.90)
    code_length: float = 10.0
    meaningful_length: float = 50.0
    rich_length: float = 200.0

    # readiness 0-5
    null_cuts: tuple[float, float, float, float] = (10.0, 30.0, 50.0, 70.0)
    nullable_guess: float = 20.0
    length_share_guess: float = 0.3
    length_guess_cap: float = 5000.0
    length_guess: float = 100.0
    max_text_length: int = 16777216

    # table readiness 0-100: comments, data types, freshness, clustering, constraints
    table_weights: tuple[float, float, float, float, float] = (0.25, 0.20, 0.25, 0.15, 0.15)
    freshness_steps: tuple[tuple[int, float], ...] = ((7, 100.0), (30, 80.0), (90, 50.0), (180, 25.0))
    large_table_bytes: int = 1024 * 1024 * 1024
    high_readiness: float = 70.0
    medium_readiness: float = 40.0

    # candidate scoring, confirmation, priority
    business: tuple[tuple[str, int], ...] = field(
        default=(("forecast", 5), ("llm", 4), ("search", 4), ("extract", 3))
    )
    default_business: int = 3
    default_readiness: int = 3
    default_metadata: int = 2
    default_risk: int = 2
    invert_risk: bool = False
    strict_empty: bool = False
    max_null_percentage: float = 50.0
    min_average_length: float = 30.0
    min_readiness: float = 3.5
    high_quality: float = 4.0
    low_quality: float = 1.5
    baseline_readiness: float = 3.0
    first_tier: float = 15.0
    second_tier: float = 12.0
    first_tier_risk: float = 3.0
    top_candidates: int = 200


DEFAULTS = Settings()
