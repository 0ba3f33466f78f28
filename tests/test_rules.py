"""Threshold rules: the value at, just below and just above each cut, expected by hand."""

from dataclasses import replace
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from fitgauge.functions import classify
from fitgauge.functions.names import base_type, name_like_any, name_matches_any, present, type_family
from fitgauge.functions.points import data_readiness, metadata_readiness
from fitgauge.operators import candidates as c
from fitgauge.operators import estimate, incremental, score
from fitgauge.operators import table_score as ts
from fitgauge.settings import DEFAULTS, DOCUMENT_PATTERNS, PII_PATTERNS
from fitgauge.sources import catalog
from fitgauge.sources.tables import choose_sample_size

AS_OF = datetime(2024, 1, 1, 12)
KEYS = "database_name string, schema_name string, table_name string"


def values(spark, schema, rows, expr):
    df = spark.createDataFrame([(i, *((r,) if not isinstance(r, tuple) else r)) for i, r in enumerate(rows)], "i int, " + schema)
    return [r[0] for r in df.select("i", expr.alias("x")).orderBy("i").select("x").collect()]


def test_sparsity(spark):
    got = values(spark, "x double", [0.0, 10.0, 10.01, 30.0, 30.01, 70.0, 70.01, None], classify.sparsity_class(F.col("x")))
    assert got == ["low", "low", "medium", "medium", "high", "high", "very_high", "unknown"]


def test_cardinality(spark):
    got = values(spark, "x double", [0.01, 0.0101, 0.8999, 0.90, None], classify.cardinality_class(F.col("x")))
    assert got == ["low", "medium", "medium", "high", "unknown"]


def test_content_class(spark):
    cuts = [9.99, 10.0, 49.99, 50.0, 199.99, 200.0, None]
    assert values(spark, "x double", cuts, classify.content_class(F.col("x"))) == [
        "code", "short_text", "short_text", "meaningful_text", "meaningful_text", "rich_content", "unknown",
    ]
    natural = values(spark, "x double", cuts, classify.content_is_natural(F.col("x")))
    structured = values(spark, "x double", cuts, classify.content_is_structured(F.col("x")))
    assert natural == [False, False, False, True, True, True, False]
    assert structured == [True] + [False] * 6


def test_grade_counts_an_empty_sample_as_empty(spark):
    rows = [(710, 1000, 51.0), (700, 1000, 51.0), (710, 1000, 50.0), (400, 1000, 99.0), (401, 1000, 99.0), (0, 0, 99.0)]
    expr = classify.text_quality_grade(classify.fill_sparsity(F.col("n"), F.col("t")), F.col("a"))
    assert values(spark, "n int, t int, a double", rows, expr) == ["Good", "Fair", "Fair", "Poor", "Fair", "Poor"]


def test_recommended_functions(spark):
    rows = [("DESCRIPTION", 201.0, None), ("NOTE", 200.0, None), ("NOTE", None, 201), ("my_content", None, None)]
    expr = classify.recommended_functions(F.col("c"), F.col("a"), F.col("m"))
    assert values(spark, "c string, a double, m bigint", rows, expr) == [
        ["summarize", "sentiment", "classify", "translate"],
        ["sentiment", "classify"],
        ["summarize", "sentiment", "classify"],
        ["sentiment", "classify", "translate"],
    ]


def test_types_and_names(spark):
    types = ["number(38,0)", "VARIANT", " geography ", "Timestamp_ntz(9)", "BOOLEAN", None, "text"]
    assert values(spark, "x string", types, type_family(F.col("x"))) == [
        "numeric", "semi_structured", "unsupported", "temporal", "other", "other", "text",
    ]
    assert values(spark, "x string", ["double precision (1)"], base_type(F.col("x"))) == ["DOUBLE PRECISION"]
    names = ["user_email", "FirstName", "first_x", "social_x_security", "s3_key", None]
    assert values(spark, "x string", names, name_like_any(F.col("x"), PII_PATTERNS)) == [True, True, False, True, False, False]
    assert values(spark, "x string", names, name_like_any(F.col("x"), DOCUMENT_PATTERNS)) == [False] * 4 + [True, False]
    assert values(spark, "x string", names, name_matches_any(F.col("x"), ["MAIL"])) == [True] + [False] * 5
    assert values(spark, "x string", ["", " \t\n", "a", None], present(F.col("x"))) == [False, False, True, False]


def test_freshness(spark):
    day = [
        datetime(2023, 12, 25, 12), datetime(2023, 12, 24, 13), datetime(2023, 12, 24, 12), datetime(2023, 12, 2, 12),
        datetime(2023, 12, 1, 12), datetime(2023, 10, 3, 12), datetime(2023, 10, 2, 12), datetime(2023, 7, 5, 12),
        datetime(2023, 7, 4, 12), datetime(2025, 1, 1), None,
    ]
    df = spark.createDataFrame([(i, d) for i, d in enumerate(day)], "i int, last_altered timestamp")
    got = [r[0] for r in df.select("i", ts.score_freshness(df, AS_OF).alias("x")).orderBy("i").select("x").collect()]
    assert got == [100.0, 100.0, 80.0, 80.0, 50.0, 50.0, 25.0, 25.0, 10.0, 100.0, 0.0]


def test_freshness_of_text_dates(spark):
    df = spark.createDataFrame(
        [(0, "2023-12-30T00:00:00Z"), (1, "2023-12-20"), (2, "soon"), (3, "")], "i int, last_altered string"
    )
    got = [r[0] for r in df.select("i", ts.score_freshness(df, AS_OF).alias("x")).orderBy("i").select("x").collect()]
    assert got == [100.0, 80.0, 0.0, 0.0]


def tables_of(spark, *rows):
    schema = KEYS + ", table_type string, row_count bigint, bytes bigint, table_comment string, created date, last_altered timestamp, clustering_key string"
    return spark.createDataFrame(list(rows), schema)


def columns_of(spark, *rows):
    """(table, column, type, length, nullable, comment)"""
    schema = KEYS + ", column_name string, ordinal_position bigint, data_type string, character_maximum_length bigint, numeric_precision bigint, numeric_scale bigint, is_nullable string, column_comment string"
    return spark.createDataFrame(
        [("D", "S", t, n, i, d, size, None, None, nullable, comment) for i, (t, n, d, size, nullable, comment) in enumerate(rows)],
        schema,
    )


def days_before(n):
    return datetime(2024, 1, 1, 12) - (datetime(2024, 1, 1) - datetime.fromordinal(datetime(2024, 1, 1).toordinal() - n))


def test_whole_tables(spark):
    gib = 1024**3
    tables = tables_of(
        spark,
        ("D", "S", "T1", "BASE TABLE", 1, 1, "about", date(2020, 1, 1), days_before(20), "LINEAR(a)"),
        ("D", "S", "T3", "BASE TABLE", 1, 1, "about", date(2020, 1, 1), days_before(3), None),
        ("D", "S", "T4", "BASE TABLE", 1, 1, "  ", date(2020, 1, 1), days_before(90), "LINEAR(a)"),
    )
    columns = columns_of(
        spark,
        ("T1", "a", "VARCHAR", 10, "YES", "x"), ("T1", "b", "NUMBER(38,0)", None, "YES", "y"),
        ("T1", "c", "VARIANT", None, "YES", None), ("T1", "d", "BINARY", None, "YES", ""),
        ("T2", "a", "VARCHAR", 10, "YES", None), ("T2", "b", "VARCHAR", 10, "YES", None), ("T2", "c", "VARCHAR", 10, "YES", None),
        ("T4", "a", "DATE", None, "YES", "x"), ("T4", "b", "BOOLEAN", None, "YES", "y"),
    )
    constraints = spark.createDataFrame(
        [("D", "S", "T1", "PRIMARY KEY", "k0"), ("D", "S", "T1", "foreign key", "k1"), ("D", "S", "T3", "UNIQUE", "k2"),
         ("D", "S", "GONE", "UNIQUE", "k2")],
        KEYS + ", constraint_type string, constraint_name string",
    )
    storage = spark.createDataFrame(
        [("D", "S", "T1", 2 * gib), ("D", "S", "T3", 2 * gib), ("D", "S", "T4", gib), ("D", "S", "GONE", gib)],
        KEYS + ", active_bytes bigint",
    )
    got = {
        r.table_name: ([r.comments, r.data_types, r.freshness, r.clustering, r.constraints], r.total_score)
        for r in ts.table_readiness(tables, columns, constraints, storage, AS_OF).collect()
    }
    assert got == {
        "T1": ([70.0, 62.5, 80.0, 100.0, 80.0], 77.0),
        "T2": ([0.0, 100.0, 0.0, 0.0, 0.0], 20.0),
        "T3": ([40.0, 0.0, 100.0, 10.0, 20.0], 39.5),
        "T4": ([60.0, 100.0, 50.0, 70.0, 0.0], 58.0),
    }


def test_constraint_points(spark):
    rows = {"A": ["PRIMARY KEY"], "B": ["FOREIGN KEY"], "C": ["UNIQUE"], "D": ["PRIMARY KEY", "PRIMARY KEY"],
            "E": ["primary key", "Foreign Key", "unique"], "F": ["CHECK"]}
    df = spark.createDataFrame(
        [("D", "S", t, k) for t, kinds in rows.items() for k in kinds], KEYS + ", constraint_type string"
    )
    summary = ts.constraint_summary(df)
    got = {r[0]: r[1] for r in summary.select("table_name", ts.score_constraints(summary)).collect()}
    assert got == {"A": 50.0, "B": 30.0, "C": 20.0, "D": 50.0, "E": 100.0, "F": 0.0}


def test_metadata_stats(spark):
    columns = columns_of(
        spark,
        ("T", "required", "VARCHAR", 1000, "NO", None), ("T", "optional", "VARCHAR(10)", 1000, "YES", "x"),
        ("T", "unknown", "TEXT", None, "YES", " "), ("T", "empty", "STRING", 0, "YES", None),
        ("T", "long", "char", 20000, "YES", None), ("T", "number", "INT", None, "NO", None), ("T", "json", "OBJECT", None, None, None),
    )
    tables = tables_of(spark, ("D", "S", "T", "BASE TABLE", 101, 1, None, None, None, None))
    got = {r.column_name: r for r in estimate.column_metadata_stats(columns, tables).collect()}
    assert (got["required"].null_percentage, got["required"].non_null_count, got["required"].avg_length) == (0.0, 101, 300.0)
    assert (got["optional"].null_percentage, got["optional"].non_null_count, got["optional"].has_comment) == (20.0, 80, True)
    for name in ("unknown", "empty"):
        assert (got[name].avg_length, got[name].max_length, got[name].has_comment) == (100.0, 16777216, False)
    assert got["long"].avg_length == 5000.0
    assert got["number"].avg_length is None and not got["number"].is_semi_structured
    assert got["json"].is_semi_structured and got["json"].null_percentage == 20.0


def test_metadata_readiness(spark):
    rows = [(True, 0.0, 300.0, False, "NO"), (True, 20.0, 100.0, True, "YES"), (True, 0.0, None, True, "NO"),
            (False, None, None, None, None), (True, None, None, None, None)]
    expr = metadata_readiness(F.col("h"), F.col("n"), F.col("a"), F.col("c"), F.col("y"))
    got = values(spark, "h boolean, n double, a double, c boolean, y string", rows, expr)
    assert got == [4.5, 3.5, 3.0, 1.0, 1.0]


def test_data_readiness(spark):
    rows = [(True, 5.0, 150.0, 600, 1000), (True, 5.0, 150.0, 500, 1000), (True, 5.0, 150.0, 250, 1000),
            (True, 5.0, 150.0, 249, 1000), (False, None, None, None, None), (True, 0.0, 250.0, 9, 0), (True, None, 0.0, 9, None)]
    expr = data_readiness(F.col("h"), F.col("n"), F.col("a"), F.col("m"), F.col("d"))
    got = values(spark, "h boolean, n double, a double, m bigint, d bigint", rows, expr)
    assert got == [4.5, 4.0, 4.0, 3.5, 1.0, 4.0, 0.0]


CANDIDATE = KEYS + ", column_name string, feature string, data_type string, max_length bigint, comment string, reason string"
PROFILE = KEYS + ", column_name string, total_rows_sampled bigint, non_null_count bigint, null_percentage double, avg_length double, max_length bigint, is_natural_language boolean, is_valid_structure boolean"


def test_candidate_scores(spark):
    found = spark.createDataFrame(
        [
            ("D", "S", "T", "BODY", "llm", "VARCHAR", None, "c", "r"),
            ("D", "S", "T", "EMAIL_BODY", "llm", "VARCHAR", None, "c", "r"),
            ("D", "S", "T", None, "forecast", None, None, None, "r"),
            ("D", "S", "T", None, "search", None, None, None, "r"),
            ("D", "S", "T", "V", "extract", "VARIANT", None, "", "r"),
            ("D", "S", "T", "LONG", "llm", "VARCHAR", None, None, "r"),
        ],
        CANDIDATE,
    )
    profiles = spark.createDataFrame(
        [("D", "S", "T", n, 100, filled, 100.0 - filled, avg, 10, None, None)
         for n, filled, avg in (("BODY", 95, 150.0), ("EMAIL_BODY", 95, 150.0), ("LONG", 90, 150.0))],
        PROFILE,
    )
    scored = score.with_tier(score.score_candidate(found, profiles))
    got = {(r.feature, r.column_name): (r.total_score, r.priority) for r in scored.collect()}
    assert got == {
        ("llm", "BODY"): (15.0, "P1"), ("llm", "EMAIL_BODY"): (18.0, "P2"), ("forecast", None): (12.0, "P2"),
        ("search", None): (11.0, "P3"), ("extract", "V"): (10.0, "P3"), ("llm", "LONG"): (12.0, "P2"),
    }
    inverted = score.score_candidate(found, profiles, replace(DEFAULTS, invert_risk=True))
    totals = {r.column_name: r.total_score for r in inverted.filter("feature = 'llm'").collect()}
    assert totals["BODY"] == 17.0 and totals["EMAIL_BODY"] == 14.0


@pytest.mark.parametrize(
    "feature,nulls,average,natural,valid,readiness,expected",
    [
        ("llm", 0.0, 30.0, True, None, 3.5, True),
        ("llm", 50.0, 30.0, None, None, 3.5, True),
        ("llm", 50.01, 30.0, None, None, 3.5, False),
        ("llm", 0.0, 29.99, None, None, 3.5, False),
        ("llm", 0.0, 0.0, None, None, 3.5, True),
        ("llm", 0.0, 30.0, False, None, 3.5, False),
        ("llm", 0.0, 30.0, None, None, 3.49, False),
        ("extract", 0.0, 5.0, False, True, 3.5, True),
        ("extract", 0.0, 5.0, None, False, 3.5, False),
        ("search", 0.0, 5.0, None, None, 5.0, False),
        ("forecast", 0.0, 5.0, False, False, 5.0, True),
        ("llm", None, None, None, None, 5.0, False),
    ],
)
def test_confirmation(spark, feature, nulls, average, natural, valid, readiness, expected):
    schema = "feature string, data_readiness double, profile struct<null_percentage: double, avg_length: double, is_natural_language: boolean, is_valid_structure: boolean>"
    df = spark.createDataFrame([(feature, readiness, (nulls, average, natural, valid))], schema)
    assert score.confirm(df).first().is_confirmed is expected


def test_confirmation_without_a_profile_and_with_strict_empty(spark):
    schema = "feature string, data_readiness double, profile struct<null_percentage: double, avg_length: double, is_natural_language: boolean, is_valid_structure: boolean>"
    missing, empty = spark.createDataFrame([("llm", 5.0, None), ("llm", 5.0, (0.0, 0.0, None, None))], schema).collect()
    rows = spark.createDataFrame([missing, empty], schema)
    done = score.confirm(rows, replace(DEFAULTS, strict_empty=True)).collect()
    assert [r.is_confirmed for r in done] == [False, False]
    assert done[0].confirmation_reasons == ["High sparsity (100.0% NULL)", "Good data readiness (5.00)"]


@pytest.mark.parametrize("total,risk,tier", [(15.0, 2.0, "P1"), (18.0, 5.0, "P2"), (15.0, None, "P2"), (12.0, 2.0, "P2"), (11.99, 2.0, "P3")])
def test_tiers(spark, total, risk, tier):
    df = spark.createDataFrame([(total, risk)], "total_score double, governance_risk double")
    assert df.select(score.priority_tier()).first()[0] == tier


def test_database_filter(spark):
    df = spark.createDataFrame([("DB_0",), ("db_1",), (None,)], "database_name string")

    def names(**lists):
        return {r[0] for r in catalog.filter_databases(df, replace(DEFAULTS, **lists)).collect()}

    assert names() == {"DB_0", "db_1", None}
    assert names(include_databases=("db_0",), exclude_databases=("db_0",)) == {"DB_0"}
    assert names(exclude_databases=("db_0",)) == {"db_1"}


def test_candidate_rules(spark):
    columns = columns_of(
        spark,
        ("T", "x", "VARCHAR", 500, "YES", None), ("T", "y", "VARCHAR", 499, "YES", None), ("T", "my_note", "Text", None, "YES", None),
        ("T", "j", "variant", None, "YES", None), ("T", "k", "VARIANT(1)", None, "YES", None), ("T", "when", "DATE", None, "YES", None),
        ("T", "n1", "INT", None, "YES", None), ("T", "n2", "INTEGER", None, "YES", None),
        ("U", "a", "STRING", 200, "YES", None), ("U", "b", "STRING", 199, "YES", None), ("U", "n", "NUMBER", None, "YES", None),
        ("W", "when", "TIMESTAMP_LTZ", None, "YES", None), *[("W", f"n{i}", "FLOAT", None, "YES", None) for i in range(7)],
        ("Z", None, None, None, None, None),
    )
    got = {(r.feature, r.table_name, r.column_name): r for r in c.all_candidates(columns).collect()}
    assert set(got) == {
        ("llm", "T", "x"), ("llm", "T", "my_note"), ("extract", "T", "j"), ("forecast", "T", None),
        ("search", "T", None), ("forecast", "W", None),
    }
    assert got["llm", "T", "x"].reason == "Text column (VARCHAR) - long text"
    assert got["llm", "T", "my_note"].reason == "Text column (Text) - semantic name"
    assert got["forecast", "T", None].numeric_columns == ["n2"]
    assert got["forecast", "W", None].reason == "Has timestamp + 7 numeric columns"
    assert got["forecast", "W", None].numeric_columns == [f"n{i}" for i in range(5)]
    assert got["search", "T", None].text_columns == ["x", "y"]


def test_merge_keeps_old_rows_and_is_idempotent(spark):
    schema = KEYS + ", column_name string, feature string, reason string"
    old = spark.createDataFrame([("D", "S", "T", "a", "llm", "old"), ("D", "S", "T", None, "search", "old")], schema)
    new = spark.createDataFrame(
        [("D", "S", "T", "a", "llm", "new"), ("D", "S", "T", "b", "llm", "new"), ("D", "S", "T", "b", "llm", "new"),
         ("D", "S", "T", None, "search", "new"), ("D", "S", "T", None, "forecast", "new")],
        schema,
    )

    def rows(df):
        return sorted((r.column_name or "", r.feature, r.reason) for r in df.collect())

    once = incremental.merge_candidates(old, new)
    assert rows(once) == [("", "forecast", "new"), ("", "search", "old"), ("a", "llm", "old"), ("b", "llm", "new")]
    assert rows(incremental.merge_candidates(once, new)) == rows(once)
    assert rows(incremental.merge_candidates(old, new, update=True))[1:3] == [("", "search", "new"), ("a", "llm", "new")]
    assert incremental.add_candidates(old, new).count() == 7


def test_sample_size():
    assert choose_sample_size(100, 100 * 1000) == 10000
    assert choose_sample_size(100, 100 * 50_000) == 1000
    assert choose_sample_size(100, 100 * 10_000_000) == 100
    assert choose_sample_size(0, 0) == 10000


def test_table_candidates_of_a_null_database_are_kept(spark):
    from fitgauge.operators import candidates as c

    rows = [(None, "S", "T", f"C{i}", i, t, 500, None) for i, t in enumerate(("DATE", "NUMBER", "VARCHAR", "VARCHAR"))]
    columns = spark.createDataFrame(
        rows, "database_name string, schema_name string, table_name string, column_name string, ordinal_position int, data_type string, "
        "character_maximum_length bigint, column_comment string")
    assert {(r.database_name, r.feature) for r in c.table_candidates(columns).collect()} == {(None, "forecast"), (None, "search")}
    assert [r.text_columns for r in c.enhanced_search(columns).collect()] == [["C0", "C1", "C2", "C3"]]


def test_table_level_confirmation_needs_measured_members(spark):
    from fitgauge.operators import score as s

    keys = "database_name string, schema_name string, table_name string, "
    found = spark.createDataFrame(
        [("D", "S", t, None, "search", None, None, None, "", None, [f"C{i}" for i in range(3)]) for t in ("good", "poor", "unknown")],
        keys + "column_name string, feature string, data_type string, max_length bigint, comment string, reason string, numeric_columns array<string>, text_columns array<string>")
    profiles = spark.createDataFrame(
        [("D", "S", t, f"C{i}", 100, 100 - n, float(n), a, 900, True, None) for t, n, a in (("good", 4, 250.0), ("poor", 80, 20.0)) for i in range(2)],
        keys + "column_name string, total_rows_sampled bigint, non_null_count bigint, null_percentage double, avg_length double, max_length bigint, "
        "is_natural_language boolean, is_valid_structure boolean")
    columns = spark.createDataFrame(
        [("D", "S", t, f"C{i}", i, "VARCHAR", 1000) for t in ("good", "poor", "unknown") for i in range(3)],
        keys + "column_name string, ordinal_position int, data_type string, character_maximum_length bigint")
    first = s.score_candidate(found, profiles)
    assert not any(r.is_confirmed for r in s.confirm(s.rescored(first)).collect())
    rolled = {r.table_name: r for r in s.confirm(s.rolled_up(first, profiles, columns)).collect()}
    assert [rolled[t].is_confirmed for t in ("good", "poor", "unknown")] == [True, False, False]
    assert rolled["good"].profile.null_percentage == 4.0 and rolled["good"].data_readiness == 5.0
    assert rolled["unknown"].profile is None and rolled["unknown"].data_readiness == 3.0


def test_key_counts_fill_the_estimated_profile(spark):
    from fitgauge.operators import estimate as e, profile as p

    df = spark.createDataFrame([('{"a": 1, "b": 2}', '{"x": {}}'), ('{"b": 1, "c d": 0}', "[1]"), ("oops", None), ("{}", '{"x": 1}')], "j string, k string")
    counts = {(r.column_name, r.json_key): r.n for r in p.json_key_counts(df, ["j", "k"]).collect()}
    assert counts == {("j", "a"): 1, ("j", "b"): 2, ("j", "c d"): 1, ("k", "x"): 2}
    keys = p.json_key_counts(df, ["j", "k"]).selectExpr("'D' as database_name", "'S' as schema_name", "'T' as table_name", "*")
    columns = spark.createDataFrame([("D", "S", "T", c, "VARIANT") for c in "jkl"], "database_name string, schema_name string, table_name string, column_name string, data_type string")
    got = {r.column_name: r.top_keys for r in e.estimated_json_profile(columns, keys=keys).collect()}
    assert got == {"j": ["b", "a", "c d"], "k": ["x"], "l": []}
    assert all(r.top_keys == [] for r in e.estimated_json_profile(columns).collect())


def test_json_paths_go_as_deep_as_the_data(spark):
    from fitgauge.operators import profile as p

    deep = "7"
    for i in range(40):
        deep = f'{{"k{i}": {deep}}}' if i % 3 else f"[{deep}]"
    df = spark.createDataFrame([(deep,), ('{"a": 1}',), ("no json",), (None,), ('"text"',), ("{}",)], "j string")
    found = {(r.path, r.type): r.n for r in p.json_path_types(df, "j").collect()}
    assert len(found) == 41 and found["a", "INTEGER"] == 1
    assert max(path.count(".") for path, _ in found) == 39
    assert p.json_path_types(df.limit(0), "j").collect() == []
