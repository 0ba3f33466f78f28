"""Stored results: reuse, append, resume, errors, streams."""

from dataclasses import replace
from datetime import datetime
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from fitgauge.checks import queries as registered
from fitgauge.checks.queries import lake
from fitgauge.functions.names import COLUMN_KEYS
from fitgauge.operators import file_states
from fitgauge.operators import incremental as inc
from fitgauge.operators.candidates import all_candidates
from fitgauge.plans import measured_run
from fitgauge.settings import DEFAULTS
from fitgauge.sources import catalog, crawl, folders, store
from fitgauge.streaming.snapshots import publish_snapshots

AT = datetime(2024, 1, 1)
SCHEMA = "database_name string, schema_name string, table_name string, column_name string"


def wanted(spark, *pairs):
    return spark.createDataFrame([("L", "P", t, c) for t, c in pairs], SCHEMA)


def test_profiles_are_reused_unless_forced(spark, data, tmp_path):
    path, asked = str(tmp_path / "profiles"), []

    def resolve(key):
        asked.append(key[2])
        return data.table(key[2])

    first = inc.incremental_profile(spark, wanted(spark, ("part", "p_name")), resolve, path, AT)
    assert [r.column_name for r in first.collect()] == ["p_name"]
    both = wanted(spark, ("part", "p_name"), ("region", "r_name"))
    second = inc.incremental_profile(spark, both, resolve, path, datetime(2024, 2, 1), analysis="second")
    assert {r.column_name: r.analysis_type for r in second.collect()} == {"p_name": "full_scan", "r_name": "second"}
    assert asked == ["part", "region"]
    forced = inc.incremental_profile(spark, both, resolve, path, datetime(2024, 3, 1), force=True, analysis="third")
    assert {r.analysis_type for r in forced.collect()} == {"third"}
    assert second.count() == 2


def test_one_broken_table_does_not_stop_the_others(spark, data, tmp_path):
    path = str(tmp_path / "profiles")
    broken = data.table("part").withColumn("p_name", F.raise_error(F.lit("bad file " + "x" * 300)).cast("string"))

    def resolve(key):
        return broken if key[2] == "part" else spark.read.parquet(f"{data.sf_dir}/{key[2]}.parquet")

    keys = wanted(spark, ("part", "p_name"), ("region", "r_name"), ("region", "torn"), ("missing", "x"))
    good = inc.incremental_profile(spark, keys, resolve, path, AT)
    assert [r.column_name for r in good.collect()] == ["r_name"]
    rows = {r.column_name: r for r in spark.read.parquet(path).collect()}
    assert {n: r.status for n, r in rows.items()} == {"p_name": "error", "r_name": "success", "torn": "error", "x": "error"}
    assert len(rows["p_name"].error) == 200 and rows["torn"].error == "column not found"
    assert rows["x"].error.startswith("table not found")


def test_measured_run_resumes_and_appends(spark, data, tmp_path):
    root, tables = str(tmp_path), lake(data)
    first = measured_run.measured_run(spark, "L", tables, root, AT)
    assert first.count() == 34
    assert {r.priority for r in first.collect()} <= {"P1", "P2", "P3"}
    resumed = measured_run.measured_run(spark, "L", {k: v for k, v in tables.items() if k[1] == "documents"}, root, AT,
                                        resume_from="scored", run_mode="append")
    assert resumed.count() == 34
    again = measured_run.measured_run(spark, "M", tables, root, AT, run_mode="append")
    assert again.count() == 68
    doubled = measured_run.measured_run(spark, "M", tables, root, AT, run_mode="append", merge=False)
    assert doubled.count() == 102
    history = store.run_history(spark, f"{root}/history").collect()
    assert {db for r in history for db in r.databases} == {"L", "M"}
    assert {r[0] for r in store.databases_analyzed(spark, f"{root}/history").collect()} == {"L", "M"}


def test_missing_stores_are_empty(spark, tmp_path):
    assert store.load_candidates(spark, str(tmp_path / "none")).count() == 0
    assert store.load_profile_cache(spark, str(tmp_path / "none")).count() == 0
    assert store.run_history(spark, str(tmp_path / "none")).count() == 0


def test_inventory_survives_quotes_and_line_breaks(spark, tmp_path):
    rows = [("D", "S", "T", "a", "VARCHAR", 5, 'say "hi",\nthen go'), ("D", "S", "T", "b", "NUMBER", None, None)]
    columns = spark.createDataFrame(rows, store.INVENTORY_SCHEMA)
    store.save_inventory(columns, str(tmp_path / "inv"))
    loaded = {r.column_name: r for r in store.load_inventory(spark, str(tmp_path / "inv")).collect()}
    assert loaded["a"].column_comment == 'say "hi",\nthen go'
    assert (loaded["b"].column_comment, loaded["b"].ordinal_position, loaded["b"].is_nullable) == ("", 0, "YES")


def test_work_dir_is_the_shared_folder(monkeypatch):
    monkeypatch.setattr(folders, "until_end", lambda _, path: path)

    def session(shared, master):
        conf = SimpleNamespace(get=lambda key, default: shared if key == "spark.checkpoint.dir" else default)
        return SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master=master))

    cluster = session("hdfs://shared/", "yarn")
    assert store.work_dir(cluster).startswith("hdfs://shared/fitgauge-")
    assert store.work_dir(cluster) != store.work_dir(cluster)
    assert "fitgauge-" in store.work_dir(session(None, "local[2]"))
    with pytest.raises(ValueError):
        store.work_dir(session(None, "yarn"))


def test_crawl_of_the_session_catalog(spark, tmp_path):
    spark.sql(f"create database if not exists shop location '{tmp_path}/shop'")
    spark.sql("create table shop.item (id int not null, name varchar(20) comment 'shown name', price decimal(10,2), tags array<string>) using parquet")
    spark.sql("insert into shop.item values (1, 'a', 1.5, array('x')), (2, 'b', null, null)")
    try:
        tables = crawl.list_tables(spark, "shop")
        found = {r.column_name: r for r in crawl.crawl_columns(spark, "lake", tables).collect()}
        assert {n: r.data_type for n, r in found.items()} == {"id": "INTEGER", "name": "VARCHAR", "price": "NUMBER", "tags": "ARRAY"}
        assert found["name"].character_maximum_length == 20 and found["name"].column_comment == "shown name"
        assert (found["price"].numeric_precision, found["price"].numeric_scale) == (10, 2)
        table = crawl.crawl_tables("lake", tables).first()
        assert table.row_count == 2 and table.bytes > 0 and table.last_altered is not None
    finally:
        spark.sql("drop database shop cascade")


def test_crawl_counts_views_and_empty_tables(spark):
    tables = {("P", "v"): spark.range(5), ("P", "e"): spark.createDataFrame([], "a int"), ("INFORMATION_SCHEMA", "x"): spark.range(1)}
    assert {r.table_name: r.row_count for r in crawl.crawl_tables("L", tables).collect()} == {"v": 5, "e": 0}
    assert {r.table_name for r in crawl.crawl_columns(spark, "L", tables).collect()} == {"v", "e"}


def test_crawl_in_batches_survives_a_damaged_table(spark, tmp_path):
    for name in ("a", "b", "torn", "c"):
        spark.range(3).write.parquet(f"{tmp_path}/{name}")
    tables = {("P", n): spark.read.parquet(f"{tmp_path}/{n}") for n in ("a", "b", "torn", "c")} | {("P", "v"): spark.range(5)}
    for file in (tmp_path / "torn").glob("*.parquet"):
        file.write_bytes(b"no footer")
    expected = {"a": 3, "b": 3, "torn": None, "c": 3, "v": 5}
    for size in (1, 2, 50):
        found = crawl.crawl_tables("L", tables, replace(DEFAULTS, tables_per_crawl=size)).collect()
        assert len(found) == 5 and {r.table_name: r.row_count for r in found} == expected
        assert {r.table_name for r in found if r.bytes is None} == {"torn", "v"}
    assert crawl.crawl_tables("L", {}).count() == crawl.crawl_columns(spark, "L", {}).count() == 0


def test_crawled_columns_of_all_types(spark):
    df = spark.sql(
        "select cast(1 as tinyint) a, 1L b, 1.5BD c, cast(2 as float) d, true e, date'2024-01-01' f, timestamp'2024-01-01' g, "
        "timestamp_ntz'2024-01-01' h, x'00' i, array(1) j, map('k', 1) k, named_struct('type', 'x') l, parse_json('1') m, 'x' `n.o``p`, null q")
    found = crawl.crawl_columns(spark, "L", {("P", "t"): df}).orderBy("ordinal_position").collect()
    assert [r.column_name for r in found] == df.columns and [r.ordinal_position for r in found] == list(range(1, 16))
    assert [r.data_type for r in found] == [
        "INTEGER", "INTEGER", "NUMBER", "FLOAT", "BOOLEAN", "DATE", "TIMESTAMP_LTZ", "TIMESTAMP_NTZ", "BINARY", "ARRAY", "OBJECT", "OBJECT",
        "VARIANT", "VARCHAR", "VOID"]
    assert (found[2].numeric_precision, found[2].numeric_scale) == (2, 1) and found[1].numeric_precision is None


def test_snapshots_add_each_candidate_once(spark, data, tmp_path):
    live = catalog.catalog_columns(data.columns)
    snapshots, published = str(tmp_path / "in"), str(tmp_path / "published")
    part = live.filter("database_name in ('DB_0', 'DB_1')")
    part.coalesce(1).write.parquet(snapshots)

    def run():
        query = publish_snapshots(spark, snapshots, published, str(tmp_path / "checkpoint"))
        query.awaitTermination(120)
        return store.load_candidates(spark, published)

    assert run().count() == all_candidates(part).count()
    live.coalesce(1).write.mode("append").parquet(snapshots)
    after = run()
    assert after.count() == all_candidates(live).count()
    assert after.select(*COLUMN_KEYS, "feature").distinct().count() == after.count()


@pytest.mark.parametrize("files", [1, 2, 100])
def test_snapshots_do_not_depend_on_the_batch(spark, tmp_path, files):
    rows = [("D", "S", "T", f"C{i}", i, "VARCHAR", 4000, None, None, "YES", None) for i in range(4)]
    for row in rows:
        spark.createDataFrame([row], crawl.COLUMN_SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    query = publish_snapshots(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "checkpoint"), files_per_batch=files)
    query.awaitTermination(120)
    found = [r for r in store.load_candidates(spark, str(tmp_path / "out")).collect() if r.feature == "search"]
    assert [(r.reason, r.text_columns) for r in found] == [("4 substantial text columns", ["C0", "C1", "C2", "C3"])]


def test_a_damaged_file_gives_error_rows(spark, data, tmp_path):
    (tmp_path / "bad.parquet").write_bytes(b"PAR1 this is no table PAR1")
    schema = data.table("part").schema

    def resolve(key):
        return spark.read.schema(schema).parquet(str(tmp_path / "bad.parquet")) if key[2] == "part" else data.table(key[2])

    path = str(tmp_path / "profiles")
    keys = wanted(spark, ("part", "p_name"), ("region", "r_name"))
    assert [r.column_name for r in inc.incremental_profile(spark, keys, resolve, path, AT).collect()] == ["r_name"]
    assert {r.column_name: r.status for r in spark.read.parquet(path).collect()} == {"p_name": "error", "r_name": "success"}


def test_nested_columns_survive_csv(spark, tmp_path):
    df = spark.sql("select 1 as a, array('x', 'y') as b, map('k', 2) as c, parse_json('[1]') as d")
    path = store.write_outputs({"n": df}, str(tmp_path), formats=["csv"])["n.csv"]
    assert tuple(spark.read.option("header", True).option("escape", '"').csv(path).first()) == ("1", '["x","y"]', '{"k":2}', "[1]")


def test_lengths_of_crawled_texts(spark):
    df = spark.sql("select 'a' as plain, cast('b' as varchar(20)) as short, array(cast('c' as varchar(10))) as many, 1 as number")
    found = {r.column_name: r.character_maximum_length for r in crawl.crawl_columns(spark, "L", {("P", "t"): df}).collect()}
    assert found == {"plain": 16777216, "short": 20, "many": None, "number": None} or found["plain"] == 16777216 and found["many"] is None


@pytest.mark.parametrize("fmt", ["parquet", "json", "csv"])
def test_formats(spark, data, tmp_path, fmt):
    found = all_candidates(catalog.catalog_columns(data.columns))
    paths = store.write_outputs({"found": found}, str(tmp_path), formats=[fmt])
    read = spark.read.option("header", True).format(fmt).load(paths[f"found.{fmt}"])
    assert read.count() == found.count()


def test_scores_are_stored_by_many_tasks(spark, tmp_path):
    path, names = str(tmp_path / "scores"), [f.split(" ")[0] for f in store.SCORE_SCHEMA.split(", ")][:-1]
    text = [F.lit("t").alias(n) for n in names[:3]]
    rows = spark.range(1000, numPartitions=4).select(
        *text, F.col("id").cast("string").alias("column_name"), F.lit("llm").alias("feature"), F.lit(3.0).alias("data_readiness"), F.lit(9.0).alias("total_score"))
    store.save_scores(rows, path, AT)
    assert len(list((tmp_path / "scores").glob("part=*/*.parquet"))) == 4
    assert store.scores_before(spark, path, datetime(2024, 2, 1)).count() == 1000


def test_runs_publish_and_write_what_is_stored(spark, data, monkeypatch):
    """The scores are made once, however often a run reads them."""
    seen = []
    publish, write = measured_run.publish, store.write_outputs

    def published(spark, scored, *args, **options):
        seen.append(scored)
        return publish(spark, scored, *args, **options)

    def written(outputs, *args, **options):
        seen.extend(outputs.values())
        return write(outputs, *args, **options)

    monkeypatch.setattr(measured_run, "publish", published)
    monkeypatch.setattr(store, "write_outputs", written)
    assert registered.QUERIES["run_mode"](spark, data.sf_dir).count()
    assert len(registered.QUERIES["write_outputs"](spark, data.sf_dir).collect()) == 6
    assert len(seen) == 4
    for df in seen:
        assert {f.split("/")[-2] for f in df.inputFiles()} == {"scored"}


def test_files_of_a_table_are_alike_in_size(spark, data, monkeypatch):
    places, profiled = {}, file_states.profile_by_file

    def noted(spark, tables, *args):
        places.update(tables)
        return profiled(spark, tables, *args)

    monkeypatch.setattr(file_states, "profile_by_file", noted)
    registered.QUERIES["incremental_by_file"](spark, data.sf_dir)
    assert len(places) == 5
    for key, place in places.items():
        rows = [r["count"] for r in spark.read.parquet(place).groupBy(F.input_file_name()).count().collect()]
        assert len(rows) == 6 and sum(rows) == data.table(key[2]).count()
        assert max(rows) <= 0.25 * sum(rows)
