"""Profiles: the two ways to compute them agree, and with numpy, on skewed, empty and null data."""

import hashlib
import math
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from fitgauge.operators import profile as p, quantiles
from fitgauge.settings import DEFAULTS
from fitgauge.sources.tables import sample_rows

running = quantiles._running
TINY = replace(DEFAULTS, rank_values=20, columns_per_scan=2, profile_fan_in=3)


@pytest.fixture(scope="module")
def skewed(spark):
    """A third of all rows hold one value; the rest are spread out, some null."""
    x = F.when(F.col("id") % 3 == 0, 7.0).when(F.col("id") % 11 != 0, F.sin("id") * 1000)
    return spark.range(0, 20000, 1, 5).select(
        "id", x.alias("x"), F.repeat(F.lit("a b "), (F.col("id") % 50).cast("int")).alias("odd `name"),
        F.lit(None).cast("double").alias("nothing"), F.array("id").alias("list"),
    )


def close(a, b):
    if isinstance(a, float) and isinstance(b, float):
        return math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-9)
    return a == b


def test_both_ways_agree(skewed):
    plain = {r.column_name: r.asDict() for r in p.profile_table(skewed).collect()}
    large = {r.column_name: r.asDict() for r in p.profile_table(skewed, settings=TINY).collect()}
    assert plain.keys() == large.keys() == set(skewed.columns)
    for name, row in plain.items():
        assert [k for k, v in row.items() if not close(v, large[name][k])] == [], name


@pytest.mark.parametrize("settings", [DEFAULTS, TINY])
def test_numbers_match_numpy(skewed, settings):
    values = np.array([r.x for r in skewed.filter("x is not null").select("x").collect()])
    row = p.numeric_profile(skewed, ["x"], settings).first()
    assert row.non_null_count == len(values)
    assert close(row.median_value, float(np.quantile(values, 0.5)))
    assert close(row.p95_value, float(np.quantile(values, 0.95)))
    assert math.isclose(row.stddev_value, float(values.std(ddof=1)), rel_tol=1e-9)
    assert row.null_percentage == round((1 - len(values) / 20000) * 100, 2)


@pytest.mark.parametrize("values", [10**9, 0])
def test_empty_and_null_columns(spark, values):
    settings = replace(DEFAULTS, rank_values=values)
    empty = spark.createDataFrame([], "t string, n double")
    for row in p.profile_table(empty, settings=settings, rows=1).collect():
        assert (row.total_rows, row.non_null_count, row.null_percentage) == (0, 0, 100.0)
        assert row.avg_length is None and row.median_value is None
    nulls = spark.createDataFrame([(None, None)], "t string, n double")
    for row in p.profile_table(nulls, settings=settings, rows=1).collect():
        assert (row.total_rows, row.non_null_count, row.null_percentage) == (1, 0, 100.0)
        assert row.stddev_value is None and row.approx_distinct == 0


def test_approximate_distinct_is_close(skewed):
    rows = {r.column_name: r for r in p.profile_table(skewed).collect()}
    exact = {r.column_name: r.distinct_count for r in p.exact_distinct(skewed, skewed.columns).collect()}
    for name, n in exact.items():
        assert abs(rows[name].approx_distinct - n) <= max(1, 3 * 0.02 * n), name


def test_json_profile_and_types(spark):
    texts = ['{"a": 1}', "[1]", "7", "oops", None, '{"a": {"b": [1, {"c": null}]}, "d": "x"}']
    df = spark.createDataFrame(list(enumerate(texts)), "id int, j string")
    row = p.json_profile(df, "j", ["id"]).first()
    assert (row.sampled_values, row.valid_json_rate, row.object_rate, row.array_rate) == (5, 80.0, 40.0, 20.0)
    assert row.is_valid_structure is False
    paths = {(r.path, r.type): r.n for r in p.json_path_types(df, "j", depth=4).collect()}
    assert paths == {
        ("a", "INTEGER"): 1, ("a", "OBJECT"): 1, ("a.b", "ARRAY"): 1, ("a.b.[]", "INTEGER"): 1,
        ("a.b.[]", "OBJECT"): 1, ("a.b.[].c", "NULL_VALUE"): 1, ("d", "VARCHAR"): 1, ("[]", "INTEGER"): 1,
    }
    nothing = p.json_profile(df.filter("j is null"), "j", ["id"]).first()
    assert (nothing.sampled_values, nothing.valid_json_rate, nothing.is_valid_structure) == (0, 0.0, False)
    assert {r.json_key for r in p.json_top_keys(df, "j", ["id"]).collect()} == {"a", "d"}


def test_whole_json_and_texts_have_no_limits(spark):
    rows = [(i, "{}") for i in range(1200)] + [(1200, '{"rare": {"b": {"c": {"d": {"e": {"f": {"g": 1}}}}}}}')]
    df = spark.createDataFrame(rows, "id int, j string")
    assert {r.path for r in p.json_path_types(df, "j").collect()} >= {"rare.b.c.d", "rare.b.c.d.e.f.g"}
    assert [r.json_key for r in p.json_top_keys(df, "j").collect()] == ["rare"]
    row = p.sampled_text_profile({("a", "b", "c"): (df, "j", None)}).first()
    assert (row.total_rows_sampled, row.max_length) == (1201, len(rows[-1][1]))


def test_natural_language_needs_spaces(spark):
    codes = spark.createDataFrame([(i, "x" * 60) for i in range(20)], "id int, t string")
    prose = spark.createDataFrame([(i, "some words " * 6) for i in range(20)], "id int, t string")
    short = spark.createDataFrame([(i, "ab cd") for i in range(20)], "id int, t string")
    found = [p.natural_language(df, "t", ["id"]).first() for df in (codes, prose, short)]
    assert [r.is_natural_language for r in found] == [False, True, False]
    assert [r.sample_with_spaces_rate for r in found] == [0.0, 100.0, None]
    assert [r.checked_values for r in found] == [10, 10, 0]


def test_samples_of_files_and_of_other_tables_are_the_same(spark, tmp_path):
    df = spark.range(0, 50000, 1, 7).withColumn("v", F.col("id") * 2)
    order = sorted(range(50000), key=lambda i: hashlib.md5(str(i).encode()).hexdigest())
    df.write.parquet(f"{tmp_path}/t")
    stored = spark.read.parquet(f"{tmp_path}/t")
    for n in (0, 1, 300, 5000):
        for rows in (df, stored, stored.select("id"), stored.filter("id >= 0")):
            assert {r.id for r in sample_rows(rows, n, ["id"]).collect()} == set(order[:n])
    assert sample_rows(stored, 60000, ["id"]).count() == 50000
    for one_key in (df.withColumn("id", F.lit(1)), stored.withColumn("id", F.lit(1)), stored.withColumn("id", F.lit(None).cast("long"))):
        assert sample_rows(one_key, 300, ["id"]).count() == 300


def test_only_files_with_sampled_rows_are_read(spark, tmp_path):
    """Three of a hundred files, and of those only the row groups that can hold a chosen key."""
    rows = spark.range(0, 20000, 1, 100).withColumn("text", F.repeat(F.lit("x"), 50))
    rows.write.option("parquet.block.size", 1024).parquet(f"{tmp_path}/t")
    stored = spark.read.parquet(f"{tmp_path}/t")
    sample = sample_rows(stored, 3, ["id"])
    plan = sample._jdf.queryExecution().executedPlan().toString()
    assert plan.count("part-") <= 3 * 4 and "PushedFilters: [In(id" in plan and "PartitionFilters: [" in plan
    scanned = stored.filter(F.col("_metadata.file_path").isin([r.f for r in sample.select(F.col("_metadata.file_path").alias("f")).distinct().collect()]))
    assert scanned.rdd.getNumPartitions() <= 3 and sample.count() == 3


def test_all_columns_are_read_together(data):
    """Once for what merges, once more for ranks; distinct counts of all columns once."""

    def scans(df):
        return df._jdf.queryExecution().optimizedPlan().toString().count("parquet")

    table = data.table("lineitem")
    assert scans(p.profile_table(table, quantiles=False)) == 1
    assert scans(p.profile_table(table)) == 2
    assert scans(p.exact_distinct(table, table.columns)) == 1


def test_only_named_columns_are_read(data):
    plan = p.text_profile(data.table("documents"), ["lang"])._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<lang:string>" in plan


@pytest.mark.parametrize("scale", ["even", "tail", "steps", "odd"])
def test_narrowed_quantiles_are_exact(spark, scale):
    """Ranges are narrowed down to 3 rows, for values spread evenly, over 600 orders of magnitude, in steps, and among numbers that are none."""
    rng = np.random.default_rng(7)
    n = 4000
    values = {
        "even": rng.normal(size=n), "tail": rng.choice([-1, 1], n) * 10.0 ** rng.uniform(-300, 300, n), "steps": rng.integers(0, 9, n).astype(float),
        "odd": np.r_[rng.normal(size=n), [np.nan] * 60, [np.inf] * 150, [-np.inf] * 2200, [5e-324] * 40, [1e308, -1e308]],
    }[scale]
    df = spark.createDataFrame([(float(v),) for v in values], "x double").repartition(5)
    for rank_values in (3, 10**6):
        row = p.numeric_profile(df, ["x"], replace(DEFAULTS, rank_values=rank_values)).first()
        order = np.sort(values)  # NaN is the largest
        for q, got in ((0.5, row.median_value), (0.95, row.p95_value)):
            place = q * (len(order) - 1)
            low, high = order[int(np.floor(place))], order[int(np.ceil(place))]
            assert close(got, low if low == high else (1 - place % 1) * low + place % 1 * high), (rank_values, q)


def test_narrowing_counts_a_column_once_by_code_of_one_length(spark, monkeypatch):
    """Both quantiles of a column share its pairs, and the bins' code doesn't repeat for each column: the JVM leaves long methods uncompiled."""
    plans = []
    monkeypatch.setattr(quantiles, "_running", lambda counts, by: plans.append(counts) or running(counts, by))
    df = spark.range(500).select(*(((F.col("id") * (i + 7)) % 499).cast("double").alias(f"x{i}") for i in range(9)))
    found = quantiles.narrowed(df, [quantiles.Target(c, c, (0.5, 0.95)) for c in df.columns], replace(DEFAULTS, rank_values=20))
    plan = plans[0]._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("isnan(") == 1
    assert plans[0].agg(F.sum("n")).first()[0] == 9 * 500 and len(found) == 18


def test_parts_can_be_left_out(skewed):
    full = {r.column_name: r.asDict() for r in p.profile_table(skewed).collect()}
    for settings in (DEFAULTS, TINY):
        for row in p.profile_table(skewed, settings=settings, distinct=False, quantiles=False).collect():
            left_out = {"approx_distinct", "median_length", "p95_length", "median_value", "p95_value"}
            for name, value in row.asDict().items():
                expected = None if name in left_out else full[row.column_name][name]
                assert close(value, expected), (row.column_name, name)


def test_nan_and_infinity_both_ways(spark):
    df = spark.sql("""select double('NaN') as nan, if(id < 3, double('NaN'), double(id)) as some, if(id = 5, double('inf'), double(id)) as inf,
                        cast(null as double) as none from range(0, 20, 1, 4)""")
    plain = {r.column_name: r.asDict() for r in p.profile_table(df).collect()}
    large = {r.column_name: r.asDict() for r in p.profile_table(df, settings=TINY).collect()}
    for name, row in plain.items():
        for k in ("min_value", "max_value", "median_value", "p95_value", "non_null_count"):
            assert str(row[k]) == str(large[name][k]), (name, k)


def test_every_type_is_profiled_both_ways(spark):
    df = spark.sql(
        """select cast(id as decimal(12, 2)) as dec, cast(id as tinyint) as tiny, cast(id as float) as flt,
             date_add(date '2000-01-01', cast(id as int)) as day, timestamp '2000-01-01 00:00:00' as ts,
             id % 2 = 0 as flag, cast(cast(id as string) as binary) as bin, array(id, id) as arr,
             map('k', id) as dict, struct(id as a, 'x' as b) as rec, parse_json('{"a": ' || id || '}') as var,
             if(id % 4 = 0, null, repeat('x', cast(id % 7 as int))) as txt
           from range(0, 60, 1, 4)"""
    )
    plain = {r.column_name: r.asDict() for r in p.profile_table(df).collect()}
    large = {r.column_name: r.asDict() for r in p.profile_table(df, settings=TINY).collect()}
    for name, row in plain.items():
        assert [k for k, v in row.items() if not close(v, large[name][k])] == [], name
    kinds = {n: r["kind"] for n, r in plain.items()}
    assert {n for n, k in kinds.items() if k == "numeric"} == {"dec", "tiny", "flt"}
    assert {n for n, k in kinds.items() if k == "semi_structured"} == {"arr", "dict", "rec", "var"}
    assert plain["rec"]["approx_distinct"] == 60 and plain["day"]["max_length"] == 10
    assert plain["txt"]["null_percentage"] == 25.0
    exact = {r.column_name: r.distinct_count for r in p.exact_distinct(df, df.columns).collect()}
    assert exact["var"] == 60 and exact["flag"] == 2 and exact["txt"] == 7
