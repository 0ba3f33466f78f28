"""Profiles by file: only new files are read, and the result is that of the whole table."""

import math
import os
import shutil
import time
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from fitgauge.operators import file_states as fs
from fitgauge.operators import incremental as inc
from fitgauge.operators import profile as p
from fitgauge.operators.in_flight import in_flight
from fitgauge.settings import DEFAULTS

KEY = ("LAKE", "PUBLIC", "T")
SKETCHED = {"approx_distinct", "median_length", "p95_length", "median_value", "p95_value"}


def parts_of(store):
    return {f for f in os.listdir(store)} if os.path.exists(store) else set()


def read_files(spark, store, before):
    """The files whose states the parts added since ``before`` hold."""
    new = [f"{store}/{f}" for f in parts_of(store) - before]
    return {r.path.rsplit("/", 1)[1] for r in spark.read.schema(fs.STATE_SCHEMA).parquet(*new).collect()} if new else set()


def agrees(found, df):
    whole = {r.column_name: r.asDict() for r in p.profile_table(df).collect()}
    found = {r.column_name: r.asDict() for r in found.collect()}
    assert found.keys() == whole.keys()
    for name, row in whole.items():
        for field, value in row.items():
            got = found[name][field]
            if field not in SKETCHED:
                same = math.isclose(got, value, rel_tol=1e-9, abs_tol=0.011) if isinstance(value, float) else got == value
                assert same, (name, field, got, value)
        assert abs(found[name]["approx_distinct"] - row["approx_distinct"]) <= max(1, 0.06 * row["approx_distinct"])


def rows(spark, low, high):
    return spark.range(low, high, 1, 1).select(
        "id", F.when(F.col("id") % 3 != 0, F.sin("id") * 100).alias("x"), F.repeat(F.lit("a b "), (F.col("id") % 40).cast("int")).alias("t"),
        F.array("id").alias("list"))


def test_added_changed_and_removed_files(spark, tmp_path):
    folder, store = f"{tmp_path}/t", f"{tmp_path}/store"

    def write(name, low, high):
        rows(spark, low, high).coalesce(1).write.parquet(f"{tmp_path}/{name}-{low}")
        source = next(f for f in os.listdir(f"{tmp_path}/{name}-{low}") if f.endswith(".parquet"))
        os.makedirs(folder, exist_ok=True)
        shutil.copy(f"{tmp_path}/{name}-{low}/{source}", f"{folder}/{name}.parquet")

    def run():
        before = parts_of(store)
        found = fs.profile_by_file(spark, {KEY: folder}, store)
        agrees(found, spark.read.parquet(folder))
        return read_files(spark, store, before), found.first().files

    write("a", 0, 3000)
    write("b", 3000, 3100)
    assert run() == ({"a.parquet", "b.parquet"}, 2)
    write("c", 9000, 9500)
    assert run() == ({"c.parquet"}, 3)
    assert run() == (set(), 3)
    time.sleep(1.1)
    write("b", 5000, 5300)
    assert run() == ({"b.parquet"}, 3)
    os.remove(f"{folder}/a.parquet")
    assert run() == (set(), 2)
    rows(spark, 0, 0).coalesce(1).write.mode("append").parquet(folder)
    read, files = run()
    assert len(read) == 1 and files == 3 and run() == (set(), 3)


def test_a_new_column_and_a_damaged_file(spark, tmp_path):
    folder, store = f"{tmp_path}/t", f"{tmp_path}/store"
    rows(spark, 0, 100).coalesce(1).write.parquet(folder)
    fs.profile_by_file(spark, {KEY: folder}, store).count()
    rows(spark, 100, 150).withColumn("extra", F.lit("new")).coalesce(1).write.mode("append").parquet(folder)
    with open(f"{folder}/bad.parquet", "wb") as f:
        f.write(b"no parquet file")
    found = {r.column_name: r for r in fs.profile_by_file(spark, {KEY: folder}, store).collect()}
    assert found["extra"].non_null_count == 50 and found["extra"].null_percentage == 66.67
    assert found["id"].total_rows == 150 and found["id"].files == 2
    bad = fs.unreadable_files(spark, KEY, folder, store).collect()
    assert [r.path.rsplit("/", 1)[1] for r in bad] == ["bad.parquet"] and bad[0].error
    before = parts_of(store)
    os.remove(f"{folder}/bad.parquet")
    assert fs.profile_by_file(spark, {KEY: folder}, store).count() == 5
    assert parts_of(store) == before and fs.unreadable_files(spark, KEY, folder, store).count() == 0


def test_states_of_files_come_in_batches(spark, tmp_path):
    folder, store = f"{tmp_path}/t", f"{tmp_path}/store"
    rows(spark, 0, 500).repartition(5).write.parquet(folder)
    from dataclasses import replace

    found = fs.profile_by_file(spark, {KEY: folder}, store, replace(DEFAULTS, files_per_job=2))
    agrees(found, spark.read.parquet(folder))
    assert len(parts_of(store)) == 3 and found.first().files == 5


def test_in_flight_runs_side_by_side_and_reports_errors(spark):
    seen, begun = [], time.time()

    def work(i):
        time.sleep(0.4)
        seen.append((i, spark.range(i).count()))

    in_flight(spark, range(8), work, 8, "test")
    assert sorted(seen) == [(i, i) for i in range(8)] and time.time() - begun < 8 * 0.4
    with pytest.raises(ZeroDivisionError):
        in_flight(spark, [1, 0, 2], lambda i: 1 / i, 2, "test")
    in_flight(spark, [], work, 2, "test")


def test_a_slow_table_holds_up_no_other(spark, tmp_path):
    """Each table is stored by itself, while another is still being resolved; a broken one is not retried."""
    store, asked = f"{tmp_path}/profiles", []

    def resolve(key):
        asked.append(key[2])
        if key[2] == "slow":
            while len(parts_of(store)) < 2:
                time.sleep(0.05)
        if key[2] == "broken":
            return spark.range(3).select(F.expr("raise_error('no')").cast("string").alias("x"))
        return spark.range(3).withColumn("x", F.lit("y"))

    wanted = spark.createDataFrame([("A", "B", t, "x") for t in ("broken", "slow", "quick")], "database_name string, schema_name string, table_name string, column_name string")
    found = inc.incremental_profile(spark, wanted, resolve, store, datetime(2001, 1, 1))
    assert {r.table_name for r in found.collect()} == {"slow", "quick"}
    assert sorted(asked) == ["broken", "quick", "slow"] and len(parts_of(store)) == 3
