"""Staging, key maps, resolution, runs and resets on small data."""

import pytest
from pyspark.sql import functions as F

from loadwright.operators import skew
from loadwright.operators.graph import load_tiers
from loadwright.operators.keymap import build_key_map, key_map_entries, merge_key_map
from loadwright.operators.report import profile_staged, unresolved_report
from loadwright.operators.resolve import deferred_update, resolve_lookups, resolve_polymorphic
from loadwright.operators.staging import StagedColumn, split_rejects, stage_rows, table_columns
from loadwright.options import PlanOptions
from loadwright.plans.run import TableLoad, run_plan
from loadwright.sources.tables import (CREATE_IF_MISSING, DROP_AND_RECREATE, accumulate_key_map, clustered_lookup,
                                       cluster_by_match_key, publish, rebuild_key_map, reset_staging, teardown,
                                       write_staging)
from tests.helpers import plan_of, rows
from workloads.fleet import new_database

COLUMNS = [StagedColumn("Name", "NVARCHAR(5)"), StagedColumn("amount", "NVARCHAR(100)"), StagedColumn("n", "INT"),
           StagedColumn("at", "DATETIME2(7)"), StagedColumn("flag", "BIT"), StagedColumn("statecode", "INT")]


@pytest.fixture(scope="module")
def database(spark):
    return new_database(spark)


@pytest.fixture(scope="module")
def source(spark):
    return spark.createDataFrame(
        [(1, "short", 1e7, "12", "2020-01-02 03:04:05", "true"), (2, "too long", 0.125, "x", None, "maybe"),
         (3, None, None, None, "no date", None)],
        "id int, NAME string, Amount double, N string, at string, flag string")


def test_stage_rows(source):
    staged = stage_rows(source, COLUMNS, {"AMOUNT": 2})
    assert staged.dtypes == [("Name", "string"), ("amount", "string"), ("n", "int"), ("at", "timestamp_ntz"),
                             ("flag", "boolean"), ("statecode", "int")]
    got = staged.collect()
    assert [r.amount for r in got] == ["10000000.00", "0.13", None]
    assert [r.n for r in got] == [12, None, None] and got[0].statecode is None
    assert "Exchange" not in plan_of(staged)


def test_source_columns_that_differ_only_in_case(spark):
    with pytest.raises(ValueError, match="only in case"):
        stage_rows(spark.sql("SELECT 1 AS a").withColumnRenamed("a", "Name").withColumn("x", F.lit(1)).toDF("Name", "NAME"),
                   COLUMNS)


def test_split_rejects(source):
    split = split_rejects(source, COLUMNS, ["id"])
    assert {(r.id, r.column, r.reason, r.value) for r in split.rejects.collect()} == {
        (2, "Name", "length", "too long"), (2, "n", "type", "x"), (2, "flag", "type", "maybe"),
        (3, "at", "type", "no date")}
    assert [r.Name for r in split.clean.collect()] == ["short"]
    assert "Exchange" not in plan_of(split.clean) and "Exchange" not in plan_of(split.rejects)


def test_length_counts_code_points(spark):
    df = spark.createDataFrame([(1, "😀" * 5), (2, "😀" * 6)], "id int, name string")
    assert [r.id for r in split_rejects(df, COLUMNS[:1], ["id"]).rejects.collect()] == [2]


def test_table_columns(spark):
    layout = spark.createDataFrame([("o", "T", 2, "b", "INT"), ("o", "T", 1, "a", "BIT"), ("o", "u", 1, "c", "INT")],
                                   "org_key string, table string, ordinal int, name string, sql_type string")
    assert table_columns(layout, "o", "t") == [StagedColumn("a", "BIT"), StagedColumn("b", "INT")]


def test_staging_modes(spark, source, database):
    clean = split_rejects(source, COLUMNS, ["id"]).clean
    for mode, n in ((DROP_AND_RECREATE, 1), (CREATE_IF_MISSING, 2)):
        write_staging(clean, f"{database}.modes", COLUMNS, mode)
        assert spark.table(f"{database}.modes").count() == n
    with pytest.raises(ValueError, match="unknown"):
        write_staging(clean, f"{database}.modes", COLUMNS, "other")
    with pytest.raises(Exception, match="EXCEED_LIMIT_LENGTH"):
        write_staging(stage_rows(source, COLUMNS), f"{database}.modes", COLUMNS)


def test_key_map(spark):
    target = spark.createDataFrame(
        [("t3", "k1", "c"), ("t1", "k1", "a"), ("t2", "k1", "b"), ("t4", "k2", "d"), ("t5", None, "e"), ("t6", "", "f")],
        "id string, key string, name string")
    entries, conflicts = build_key_map(target, "id", "key", ["name"])
    want = {("t1", "k1", "a"): 1, ("t4", "k2", "d"): 1}
    assert rows(entries) == want and rows(key_map_entries(target, "id", "key", ["name"])) == want
    assert {tuple(r) for r in conflicts.collect()} == {
        ("t2", "k1", "t1", "duplicate"), ("t3", "k1", "t1", "duplicate"), ("t5", None, None, "missing"),
        ("t6", None, None, "missing")}


def test_merge_protects_what_is_there(spark, database):
    first = spark.createDataFrame([("a", "1"), ("b", "2")], "target_id string, legacy_key string")
    second = spark.createDataFrame([("3", "z"), ("2", "y")], "legacy_key string, target_id string")
    assert rows(merge_key_map(first, second)) == {("a", "1"): 1, ("b", "2"): 1, ("z", "3"): 1}
    name = f"{database}.guid_merge"
    accumulate_key_map(first, name)
    for _ in range(2):
        assert rows(accumulate_key_map(second, name)) == {("a", "1"): 1, ("b", "2"): 1, ("z", "3"): 1}
    assert rows(rebuild_key_map(second, name), "target_id", "legacy_key") == {("z", "3"): 1, ("y", "2"): 1}


def test_publish_may_read_its_own_table(spark, database):
    name = f"{database}.versions"
    publish(spark.range(3).toDF("x"), name)
    assert rows(publish(spark.table(name).selectExpr("x + 10 AS x"), name)) == {(10,): 1, (11,): 1, (12,): 1}


@pytest.mark.parametrize("small_rows", [10**6, 0])
def test_resolve_lookups(spark, small_rows, monkeypatch):
    monkeypatch.setattr(skew, "SMALL_ROWS", small_rows)
    staged = spark.range(900).selectExpr(
        "id", "CASE WHEN id % 3 = 0 THEN '7' WHEN id % 3 = 1 THEN CAST(id % 40 AS STRING) END AS a",
        "CASE WHEN id % 2 = 0 THEN '' ELSE CAST(id AS STRING) END AS b")
    maps = {"ta": spark.range(30).selectExpr("concat('A', id) AS target_id", "CAST(id AS STRING) AS legacy_key"),
            "tb": spark.range(600).selectExpr("concat('B', id) AS target_id", "CAST(id AS STRING) AS legacy_key")}
    got = resolve_lookups(staged, {"a": "ta", "b": "tb"}, maps)
    assert got.columns == ["id", "a", "b", "a_id", "a_status", "b_id", "b_status"]
    seen = got.collect()
    assert len(seen) == 900
    for r in seen:
        assert (r.a_id, r.a_status) == ((None, "empty") if r.a is None else (f"A{r.a}", "resolved") if int(r.a) < 30
                                        else (None, "unresolved"))
        assert (r.b_id, r.b_status) == ((None, "empty") if r.b == "" else (f"B{r.b}", "resolved") if int(r.b) < 600
                                        else (None, "unresolved"))
    report = {r["lookup"]: r for r in unresolved_report(got, "t", ["a", "b"], sample=3).collect()}
    assert (report["a"].n_rows, report["a"].n_empty, report["a"].n_resolved + report["a"].n_unresolved) == (900, 300, 600)
    assert report["a"].n_missing_keys == 10 and report["a"].missing_sample == "30, 31, 32"
    assert report["b"].n_unresolved == 150 and report["b"].missing_sample == "601, 603, 605"


def test_report_ranks_few_keys_per_task(spark):
    staged = spark.range(50).selectExpr("CAST(id AS STRING) AS a", "'unresolved' AS a_status")
    assert "WindowGroupLimit" in plan_of(unresolved_report(staged, "t", ["a"]))


@pytest.mark.parametrize("small_rows", [10**6, 0])
def test_resolve_polymorphic(spark, small_rows, monkeypatch):
    monkeypatch.setattr(skew, "SMALL_ROWS", small_rows)
    staged = spark.createDataFrame([("1", "Account"), ("1", "contact"), ("2", "contact"), ("1", "other"), (None, "contact"),
                                    ("1", None)], "owner string, ownertype string")
    one = spark.createDataFrame([("A1", "1")], "target_id string, legacy_key string")
    two = spark.createDataFrame([("C1", "1")], "target_id string, legacy_key string")
    assert rows(resolve_polymorphic(staged, "owner", {"account": one, "Contact": two})) == {
        ("1", "Account", "A1", "resolved"): 1, ("1", "contact", "C1", "resolved"): 1, ("2", "contact", None, "unresolved"): 1,
        ("1", "other", None, "unresolved"): 1, (None, "contact", None, "empty"): 1, ("1", None, None, "unresolved"): 1}


def test_deferred_update(spark):
    loaded = spark.createDataFrame([(1, "1", None, None), (2, "2", "old", "resolved"), (3, "9", None, None), (4, None, None, None)],
                                   "id int, a string, a_id string, a_status string")
    maps = {"t": spark.createDataFrame([("A1", "1"), ("A2", "2")], "target_id string, legacy_key string")}
    got = deferred_update(loaded, {"a": "t"}, maps)
    assert got.columns == loaded.columns
    assert rows(got) == {(1, "1", "A1", "resolved"): 1, (2, "2", "old", "resolved"): 1, (3, "9", None, "unresolved"): 1,
                         (4, None, None, "empty"): 1}


def test_clustered_join_has_no_exchange(spark, database):
    facts = spark.range(4000).selectExpr("id", "CAST(id % 90 AS STRING) AS k")
    entries = spark.range(80).selectExpr("concat('T', id) AS target_id", "CAST(id AS STRING) AS legacy_key")
    a = cluster_by_match_key(facts, "k", f"{database}.c_facts", 4, hot=[])
    b = cluster_by_match_key(entries, "legacy_key", f"{database}.c_map", 4, hot=[])
    got = clustered_lookup(a, b, spark)
    near = plan_of(spark.table(a.bucketed).join(spark.table(b.bucketed).hint("merge"), F.expr("k = legacy_key"), "left"))
    assert "Exchange hashpartitioning" not in near
    assert "Exchange hashpartitioning" not in plan_of(got)
    assert rows(got.selectExpr("id", "target_id")) == {
        (i, f"T{i % 90}" if i % 90 < 80 else None): 1 for i in range(4000)}


def test_clustered_join_with_hot_keys(spark, database):
    facts = spark.range(3000).selectExpr("id", "CAST(if(id % 3 = 0, 5, id % 700) AS STRING) AS k")
    entries = spark.range(80).selectExpr("concat('T', id) AS target_id", "CAST(id AS STRING) AS legacy_key")
    a = cluster_by_match_key(facts, "k", f"{database}.h_facts", 4)
    b = cluster_by_match_key(entries, "legacy_key", f"{database}.h_map", 4, a.hot)
    assert spark.table(a.spread).count() >= 1000 and spark.table(b.spread).count() == 1
    want = facts.join(entries, F.expr("k = legacy_key"), "left").select("id", "target_id")
    assert rows(clustered_lookup(a, b, spark), "id", "target_id") == rows(want)
    with pytest.raises(ValueError, match="same hot keys"):
        clustered_lookup(a, b._replace(hot=[]), spark)


def test_run_defers_cycles_and_reset_keeps_key_maps(spark, database):
    """emp -> dept and dept -> emp; emp also names its manager."""
    emp = spark.createDataFrame([("e1", "d1", None), ("e2", "d1", "e1"), ("e3", "d9", "e2")], "ekey string, dept string, boss string")
    dept = spark.createDataFrame([("d1", "e2"), ("d2", None)], "dkey string, head string")
    pairs = spark.createDataFrame([("o", "emp", "dept"), ("o", "dept", "emp")], "org_key string, src string, dst string")
    tables = spark.createDataFrame([("o", "emp"), ("o", "dept")], "org_key string, table string")
    plan = load_tiers(tables, pairs)
    assert {(r.src, r.dst) for r in plan.dropped.collect()} == {("dept", "emp")}

    def load(prefix, key):
        return lambda df: df.withColumn("target_id", F.concat(F.lit(prefix), key))

    text = "NVARCHAR(100)"
    loads = {
        "emp": TableLoad(emp, [StagedColumn(c, text) for c in ("ekey", "dept", "boss")], "ekey", load("E-", "ekey"),
                         {"dept": "dept", "boss": "emp"}),
        "dept": TableLoad(dept, [StagedColumn(c, text) for c in ("dkey", "head")], "dkey", load("D-", "dkey"), {"head": "emp"}),
    }
    done = run_plan(spark, plan.tiers, plan.dropped, loads, database)
    assert rows(done.loaded["emp"], "ekey", "dept_id", "dept_status", "boss_id", "boss_status") == {
        ("e1", "D-d1", "resolved", None, "empty"): 1, ("e2", "D-d1", "resolved", "E-e1", "resolved"): 1,
        ("e3", None, "unresolved", "E-e2", "resolved"): 1}
    assert rows(done.loaded["dept"], "dkey", "head_id", "head_status") == {
        ("d1", "E-e2", "resolved"): 1, ("d2", None, "empty"): 1}
    reset_staging(spark, [done.staging["emp"], done.staging["dept"]])
    assert [spark.table(done.staging[t]).count() for t in ("emp", "dept")] == [0, 0]
    assert [spark.table(f"{database}.guid_{t}").count() for t in ("emp", "dept")] == [3, 2]
    reset_staging(spark, [], [f"{database}.guid_emp"])
    assert spark.table(f"{database}.guid_emp").count() == 0
    teardown(spark, [done.staging["emp"]])
    assert not spark.catalog.tableExists(done.staging["emp"]) and spark.catalog.tableExists(f"{database}.guid_dept")


def test_run_with_polymorphic_lookups_and_rejects(spark, database):
    """note -> account, contact and note -> task (postponed); task -> note."""
    plan = load_tiers(
        spark.createDataFrame([("o", t) for t in ("account", "contact", "note", "task")], "org_key string, table string"),
        spark.createDataFrame([("o", "note", "account"), ("o", "note", "contact"), ("o", "note", "task"), ("o", "task", "note")],
                              "org_key string, src string, dst string"))
    assert {(r.src, r.dst) for r in plan.dropped.collect()} == {("note", "task")}

    def job(rows, schema, key, **more):
        columns = [StagedColumn(c.split()[0], "NVARCHAR(8)") for c in schema.split(", ")]
        return TableLoad(spark.createDataFrame(rows, schema), columns, key,
                         lambda df: df.withColumn("target_id", F.concat(F.lit("T-"), key)), **more)

    loads = {
        "account": job([("a1",), ("a2-is-too-long",)], "k string", "k"),
        "contact": job([("c1",)], "k string", "k"),
        "note": job([("n1", "a1", "account"), ("n2", "c1", "Contact"), ("n3", "t1", "task"), ("n4", "c9", "contact")],
                    "k string, about string, abouttype string", "k", polymorphic={"about": ["account", "contact", "task"]}),
        "task": job([("t1", "n1")], "k string, note string", "k", lookups={"note": "note"}),
    }
    done = run_plan(spark, plan.tiers, plan.dropped, loads, database, PlanOptions(staging_prefix="in_", key_map_prefix="ids_"))
    assert rows(done.loaded["note"], "k", "about_id", "about_status") == {
        ("n1", "T-a1", "resolved"): 1, ("n2", "T-c1", "resolved"): 1, ("n3", "T-t1", "resolved"): 1,
        ("n4", None, "unresolved"): 1}
    assert rows(done.loaded["task"], "note_id") == {("T-n1",): 1}
    assert rows(done.rejects["account"].drop("source_row")) == {("a2-is-too-long", "k", "length", "a2-is-too-long"): 1}
    assert spark.table(f"{database}.in_account").count() == 1 and spark.table(f"{database}.ids_account").count() == 1


def test_profile(spark):
    staged = spark.createDataFrame([("ab", 1), ("abc", None), ("ab", 1)], "Name string, n int")
    dictionary = spark.createDataFrame([("name", "NVARCHAR(5)"), ("n", "INT")], "name string, sql_type string")
    for approximate in (False, True):
        assert {tuple(r) for r in profile_staged(staged, dictionary, approximate).collect()} == {
            ("Name", "NVARCHAR(5)", 3, 0, 2, 3), ("n", "INT", 3, 1, 1, 1)}
