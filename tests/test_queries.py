"""Every registered query: against its SQL counterpart, and its plan."""

from concurrent.futures import ThreadPoolExecutor

import duckdb
import pytest

import __spark_entry__ as entry
from conftest import SMALL
from fitgauge.checks import oracle
from fitgauge.checks.queries import ALL_TABLES, QUERIES

SQL = oracle.oracle_sql()
TYPES = {"string": "VARCHAR", "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "boolean": "BOOLEAN"}


@pytest.fixture(scope="module")
def results(spark):
    def run(name):
        try:
            df = QUERIES[name](spark, SMALL)
            plan = df._jdf.queryExecution().executedPlan().toString()
            return name, (df.columns, dict(df.dtypes), [tuple(r) for r in df.collect()], plan)
        except Exception as error:  # noqa: BLE001
            return name, error

    with ThreadPoolExecutor(6) as pool:
        return dict(pool.map(run, QUERIES))


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ALL_TABLES:
        con.execute(f"create view {t} as select * from '{SMALL}/{t}.parquet'")
    return con


def rows_of(columns, rows):
    order = [columns.index(c) for c in sorted(columns)]
    return sorted(repr(tuple(r[i] for i in order)) for r in rows)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(results, duck, name):
    found = results[name]
    if isinstance(found, Exception):
        raise found
    columns, types, rows, plan = found
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    if name not in SQL:
        assert rows
        return
    result = duck.sql(SQL[name])
    names, sql_types = list(result.columns), [str(t) for t in result.types]
    assert {n: TYPES.get(t, t) for n, t in types.items()} == dict(zip(names, sql_types))
    assert rows_of(columns, rows) == rows_of(names, result.fetchall())


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)


def test_every_query_is_registered():
    assert set(QUERIES) <= set(entry.queries()) and set(SQL) <= set(entry.oracle_sql())
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert {r.column_name for r in entry.entry(spark).collect()} == {"text", "lang", "source"}


def test_versions_are_cut_before_the_shuffle(results):
    plan = results["catalog_columns"][3]
    assert plan.count("WindowGroupLimit") == 2


def test_scores_stay_in_range(results):
    columns, _, rows, _ = results["table_readiness"]
    for name in ("total_score", "comments", "data_types", "freshness", "clustering", "constraints"):
        values = [r[columns.index(name)] for r in rows]
        assert 0 <= min(values) and max(values) <= 100
    columns, _, rows, _ = results["rescored"]
    assert all(0 <= r[columns.index("data_readiness")] <= 5 for r in rows)
    tiers = results["priority_counts"]
    assert sum(r[tiers[0].index("candidates")] for r in tiers[2]) == len(rows)
