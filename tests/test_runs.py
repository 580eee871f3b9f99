"""Runs that load wave by wave, go on after an end, fill links of earlier runs, and share key maps."""

from concurrent.futures import ThreadPoolExecutor
from dataclasses import replace

import pytest
from pyspark import inheritable_thread_target
from pyspark.sql import functions as F

from loadwright.operators import skew
from loadwright.operators.graph import load_tiers
from loadwright.operators.identity import with_row_identity
from loadwright.operators.staging import StagedColumn
from loadwright.operators.waves import with_waves
from loadwright.options import PlanOptions
from loadwright.plans.run import TableLoad, run_plan
from loadwright.sources import tables as stored
from loadwright.sources.commits import commits, newest, version_store
from loadwright.sources.journal import journal
from loadwright.sources.tables import accumulate_key_map, publish, rebuild_key_map, remove_old_versions, rewrite_parts, add_parts
from tests.helpers import plan_of, rows
from workloads.fleet import new_database

TEXT = "NVARCHAR(100)"


@pytest.fixture
def database(spark):
    return new_database(spark)


def plan(spark, *names, edges=()):
    tables = spark.createDataFrame([("o", t) for t in names], "org_key string, table string")
    return load_tiers(tables, spark.createDataFrame([("o", *e) for e in edges], "org_key string, src string, dst string"))


class Target:
    """A target system that keeps the rows it is given, one folder for each call."""

    def __init__(self, spark, path):
        self.spark, self.path, self.calls, self.fail_at = spark, str(path), 0, None

    def loader(self, table, key):
        def load(df):
            if self.fail_at == table:
                raise RuntimeError("killed")
            self.calls += 1
            path = f"{self.path}/{table}/{self.calls}"
            name = F.coalesce(F.col(key), F.col("source_row"))
            df.withColumn("target_id", F.concat(F.lit(f"{table}-"), name)).write.parquet(path)
            return self.spark.read.parquet(path)
        return load

    def rows(self, table, *columns):
        return rows(self.spark.read.parquet(f"{self.path}/{table}/*"), *columns)


def people(spark, data):
    return spark.createDataFrame(data, "k string, boss string")


def job(source, target, table, lookups=None, **more):
    return TableLoad(source, [StagedColumn(c, TEXT) for c in source.columns], source.columns[0],
                     target.loader(table, source.columns[0]), lookups or {}, **more)


def run(spark, database, p, loads, **more):
    return run_plan(spark, p.tiers, p.dropped, loads, database, **more)


@pytest.mark.parametrize("small_rows", [10**6, 0])
def test_waves_of_rows(spark, monkeypatch, small_rows):
    monkeypatch.setattr(skew, "SMALL_ROWS", small_rows)
    data = [("a", None), ("b", "a"), ("c", "b"), ("c", "a"), (None, "c"), ("", "nowhere"), ("s", "s"),
            ("r1", "r2"), ("r2", "r3"), ("r3", "r1"), ("t", "r3"), ("d", "")]
    found = with_waves(people(spark, data), "k", "boss", "wave")
    # of the rows with key c the smaller parent is a: the other follows b, which is in wave 1
    assert rows(found) == {
        ("a", None, 0): 1, ("b", "a", 1): 1, ("c", "b", 2): 1, ("c", "a", 1): 1, (None, "c", 2): 1, ("", "nowhere", 0): 1,
        ("s", "s", 0): 1, ("r1", "r2", 0): 1, ("r3", "r1", 1): 1, ("r2", "r3", 2): 1, ("t", "r3", 2): 1, ("d", "", 0): 1}
    assert with_waves(people(spark, []), "k", "boss", "wave").count() == 0


def test_rows_without_key_keep_their_identity(spark, monkeypatch):
    data = [(None, "x"), (None, "x"), (None, None), (None, "null"), ("", "x")]
    one = with_row_identity(people(spark, data), ["k", "boss"], "id")
    monkeypatch.setattr(skew, "BIG_GROUP", 1)
    other = with_row_identity(people(spark, data[::-1]).repartition(3), ["k", "boss"], "id")
    assert rows(one) == rows(other) and len(rows(one, "id")) == 5


def test_chain_of_fifty_and_ring_load_in_waves(spark, database, tmp_path):
    chain = [(f"c{i:02d}", f"c{i - 1:02d}" if i else None) for i in range(50)]
    ring = [(f"r{i}", f"r{(i + 1) % 3}") for i in range(3)]
    target, p = Target(spark, tmp_path), plan(spark, "emp")
    done = run(spark, database, p, {"emp": job(people(spark, chain + ring), target, "emp", {"boss": "emp"})})
    want = {(k, b, f"emp-{b}" if b else None) for k, b in chain + ring}
    # the target got every parent's id with the row, but for the one link that opens the ring
    assert set(target.rows("emp", "k", "boss", "boss_id")) == (want - {("r0", "r1", "emp-r1")}) | {("r0", "r1", None)}
    assert target.calls == 50
    assert set(rows(done.loaded["emp"], "k", "boss", "boss_id")) == want
    assert rows(spark.table(f"{database}.guid_emp"), "legacy_key") == {(k,): 1 for k, _ in chain + ring}
    assert spark.table(f"{database}.pending_emp").count() == 0


def test_conflicts_of_waves_name_the_row_in_the_map(spark, database, tmp_path):
    data = [("a", None), ("b", "a"), ("c", "b"), ("c", None), (None, "c")]
    target, p = Target(spark, tmp_path), plan(spark, "emp")
    emp = job(people(spark, data), target, "emp", {"boss": "emp"})

    def load(df):  # later waves have the smaller ids
        return df.withColumn("target_id", F.concat_ws("-", F.when(F.col("boss").isNull(), "z").otherwise("m"), "k", "boss"))

    done = run(spark, database, p, {"emp": replace(emp, load=load)})
    assert rows(spark.table(f"{database}.guid_emp").where("legacy_key = 'c'"), "target_id") == {("z-c",): 1}
    assert rows(done.conflicts["emp"], "target_id", "kept_id", "reason") == {
        ("m-c-b", "z-c", "duplicate"): 1, ("m-c", None, "missing"): 1}


def test_waves_beyond_the_most_are_loaded_together(spark, database, tmp_path):
    chain = [(f"c{i}", f"c{i - 1}" if i else None) for i in range(9)]
    target, p = Target(spark, tmp_path), plan(spark, "emp")
    done = run(spark, database, p, {"emp": job(people(spark, chain), target, "emp", {"boss": "emp"})},
               options=PlanOptions(most_waves=3))
    assert target.calls == 3
    assert rows(done.loaded["emp"], "k", "boss_id") == {(k, f"emp-{b}" if b else None): 1 for k, b in chain}


def test_run_goes_on_after_each_table(spark, database, tmp_path):
    """dept <- emp (to itself) <- task; the run ends before each of them in turn."""
    dept = spark.createDataFrame([("d1", "x"), (None, "loose"), (None, "loose"), ("", "loose")], "k string, name string")
    emp = people(spark, [("e1", None), ("e2", "e1"), (None, "e2"), (None, "e2")]).withColumn("dept", F.lit("d1"))
    task = spark.createDataFrame([("t1", "e2"), (None, "e1")], "k string, emp string")
    p = plan(spark, "dept", "emp", "task", edges=[("emp", "dept"), ("task", "emp")])
    target = Target(spark, tmp_path)

    def loads():
        return {"dept": job(dept, target, "dept"), "emp": job(emp, target, "emp", {"boss": "emp", "dept": "dept"}),
                "task": job(task, target, "task", {"emp": "emp"})}

    for table in ("dept", "emp", "task"):
        target.fail_at = table
        with pytest.raises(RuntimeError, match="killed"):
            run(spark, database, p, loads(), run_id="one")
    target.fail_at = None
    done = run(spark, database, p, loads(), run_id="one")
    calls = target.calls
    again = run(spark, database, p, loads(), run_id="one")
    assert target.calls == calls and rows(again.loaded["emp"]) == rows(done.loaded["emp"])
    for got in (done, again):
        assert rows(got.loaded["task"], "k", "emp_id") == {("t1", "emp-e2"): 1, (None, "emp-e1"): 1}
        assert rows(got.conflicts["dept"], "reason") == {("missing",): 3}
    # a later run finds everything loaded, rows without a key included
    later = run(spark, database, p, loads(), run_id="two")
    assert [later.loaded[t].count() for t in ("dept", "emp", "task")] == [0, 0, 0]
    assert target.rows("dept", "k", "name") == {("d1", "x"): 1, (None, "loose"): 2, ("", "loose"): 1}
    assert target.rows("emp", "k", "boss_id") == {("e1", None): 1, ("e2", "emp-e1"): 1, (None, "emp-e2"): 2}
    # one more of the equal rows is one more row
    more = dept.union(spark.createDataFrame([(None, "loose")], dept.schema))
    last = run(spark, database, p, loads() | {"dept": job(more, target, "dept")})
    assert last.loaded["dept"].count() == 1
    steps = rows(journal(spark, database).where("run_id = 'one'"), "table", "stage")
    assert steps == {(t, s): 1 for t in ("dept", "emp", "task") for s in ("staged", "loaded", "updated")
                     if (t, s) != ("dept", "updated")}


def test_run_ended_between_publishing_and_the_map(spark, database, tmp_path, monkeypatch):
    target, p = Target(spark, tmp_path), plan(spark, "emp")
    emp = people(spark, [("e1", None), ("e2", "e1"), (None, "e1")])

    def killed(*_):
        raise RuntimeError("killed")

    monkeypatch.setattr("loadwright.plans.run.accumulate_key_map", killed)
    with pytest.raises(RuntimeError, match="killed"):
        run(spark, database, p, {"emp": job(emp, target, "emp", {"boss": "emp"})}, run_id="r")
    monkeypatch.setattr("loadwright.plans.run.accumulate_key_map", accumulate_key_map)
    done = run(spark, database, p, {"emp": job(emp, target, "emp", {"boss": "emp"})}, run_id="r")
    assert target.rows("emp", "k", "boss_id") == {("e1", None): 1, ("e2", "emp-e1"): 1, (None, "emp-e1"): 1}
    assert rows(done.loaded["emp"], "k", "boss_id") == target.rows("emp", "k", "boss_id")


def test_links_of_an_earlier_run_are_filled(spark, database, tmp_path):
    target = Target(spark, tmp_path)
    p = plan(spark, "emp", "dept", edges=[("emp", "dept")])
    first = spark.createDataFrame([(f"e{i}", "d1" if i % 40 else "d2") for i in range(80)], "k string, dept string").repartition(4)
    d1, d2 = (spark.createDataFrame([(d,)], "k string") for d in ("d1", "d2"))
    run(spark, database, p, {"emp": job(first, target, "emp", {"dept": "dept"}), "dept": job(d1, target, "dept")})
    name = f"{database}.loaded_emp"

    def files():
        return {r.part: r.file for r in spark.table(name).groupBy("part").agg(
            F.concat_ws(",", F.sort_array(F.collect_set("_metadata.file_path"))).alias("file")).collect()}

    before = files()
    waiting = rows(spark.table(f"{database}.pending_emp"), "part", "lookup", "target", "legacy_key")
    assert {w[1:] for w in waiting} == {("dept", "dept", "d2")} and len(waiting) < len(before)
    new = spark.createDataFrame([("e99", "d9")], "k string, dept string")
    done = run(spark, database, p, {"emp": job(new, target, "emp", {"dept": "dept"}), "dept": job(d2, target, "dept")})
    assert rows(spark.table(name), "k", "dept_id") == {
        **{(f"e{i}", f"dept-d{1 if i % 40 else 2}"): 1 for i in range(80)}, ("e99", None): 1}
    assert rows(done.loaded["emp"], "k", "dept_id", "dept_status") == {("e99", None, "unresolved"): 1}
    after = files()
    changed = {part for part in before if before[part] != after[part]}
    assert changed == {w[0] for w in waiting}
    assert rows(spark.table(f"{database}.pending_emp"), "legacy_key") == {("d9",): 1}


def test_parts_may_change_side_by_side(spark, database):
    name = f"{database}.loaded_x"
    add_parts(spark.range(4).repartition(1), name, "a")
    add_parts(spark.range(4, 8).repartition(1), name, "b")
    parts = sorted(r.part for r in spark.table(name).select("part").distinct().collect())
    tasks = [inheritable_thread_target(spark)(
        lambda part: rewrite_parts(name, spark, [part], lambda df: df.withColumn("id", F.col("id") + 100))) for _ in parts]
    with ThreadPoolExecutor(2) as pool:
        list(pool.map(lambda t, p: t(p), tasks, parts))
    assert rows(spark.table(name), "id") == {(i + 100,): 1 for i in range(8)}
    # the two versions that were replaced, and what a writer that came second wrote in vain
    assert remove_old_versions(spark, name) in (2, 3) and spark.table(name).count() == 8


def entries(spark, prefix, ids):
    return spark.createDataFrame([(f"{prefix}{i}", f"k{i}") for i in ids], "target_id string, legacy_key string")


def test_two_writers_keep_all_ids(spark, database):
    name = f"{database}.guid_x"
    accumulate_key_map(entries(spark, "o", range(5)), name)
    given = [entries(spark, f"w{w}-", [*range(3), *range(10 * w + 10, 10 * w + 20), 99]) for w in range(4)]
    add = inheritable_thread_target(spark)(lambda df: accumulate_key_map(df, name))
    with ThreadPoolExecutor(4) as pool:
        list(pool.map(add, given))
    found = {r.legacy_key: r.target_id for r in spark.table(name).collect()}
    assert spark.table(name).count() == len(found) == 5 + 40 + 1
    assert all(found[f"k{i}"] == f"o{i}" for i in range(5)) and found["k99"][:1] == "w"
    assert stored.stored_rows(spark, name) == 46


def test_writer_that_lost_builds_on_the_winner(spark, database, monkeypatch):
    """Between reading the map and taking the next number another writer is faster."""
    name = f"{database}.guid_x"
    accumulate_key_map(entries(spark, "o", [1]), name)
    write, calls = stored._write_version, []

    def slow(df, *args):
        calls.append(1)
        result = write(df, *args)
        if len(calls) == 1:
            accumulate_key_map(entries(spark, "fast", [2, 3]), name)
        return result

    monkeypatch.setattr(stored, "_write_version", slow)
    accumulate_key_map(entries(spark, "slow", [3, 4]), name)
    assert rows(spark.table(name)) == {("o1", "k1"): 1, ("fast2", "k2"): 1, ("fast3", "k3"): 1, ("slow4", "k4"): 1}
    assert len(calls) == 3


def test_commit_that_was_not_shown_is_shown_by_the_next(spark, database, monkeypatch):
    name = f"{database}.guid_x"
    accumulate_key_map(entries(spark, "o", [1]), name)
    show = stored.commit.__globals__["show"]

    def killed(*_):
        raise RuntimeError("killed")

    monkeypatch.setitem(stored.commit.__globals__, "show", lambda s, n, e: killed() if e.get("files") else show(s, n, e))
    with pytest.raises(RuntimeError, match="killed"):
        accumulate_key_map(entries(spark, "o", [2]), name)
    monkeypatch.setitem(stored.commit.__globals__, "show", show)
    accumulate_key_map(entries(spark, "x", [2, 3]), name)
    assert rows(spark.table(name)) == {("o1", "k1"): 1, ("o2", "k2"): 1, ("x3", "k3"): 1}


def test_few_new_keys_write_few_files(spark, database):
    name = f"{database}.guid_x"
    accumulate_key_map(entries(spark, "o", range(2000)), name, buckets=16)
    store = version_store(spark, name)

    def files():
        return {f for f in store.names(newest(spark, name)[1]["version"]) if f.endswith(".parquet")}

    before = files()
    assert {stored._bucket_of(f) for f in before} == set(range(16))
    bucket = F.pmod(F.hash("legacy_key"), F.lit(16))
    few = entries(spark, "n", range(5000)).where(bucket.isin(3, 7)).orderBy("legacy_key").limit(700)
    unseen = few.join(spark.table(name), "legacy_key", "left_anti").count()
    accumulate_key_map(few, name)
    new = files() - before
    assert before <= files() and {stored._bucket_of(f) for f in new} == {3, 7} and 0 < unseen < 700
    assert spark.table(name).count() == 2000 + unseen == stored.stored_rows(spark, name)
    n_commits = len(commits(spark, name))
    accumulate_key_map(few, name)
    assert len(commits(spark, name)) == n_commits
    assert rows(spark.table(name).where("legacy_key = 'k17'")) == {("o17", "k17"): 1}
    # joined again into one file for each bucket
    rebuild_key_map(spark.table(name), name)
    assert len(files()) == 16 and spark.table(name).count() == 2000 + unseen


def test_maps_meet_bucketed_rows_without_exchange(spark, database):
    name = f"{database}.guid_x"
    accumulate_key_map(entries(spark, "o", range(500)), name, buckets=4)
    accumulate_key_map(entries(spark, "n", range(400, 600)), name)
    facts = f"{database}.facts"
    (spark.range(3000).selectExpr("id", "concat('k', id % 700) AS k").repartition(4, "k")
     .write.bucketBy(4, "k").format("parquet").saveAsTable(facts))
    met = spark.table(facts).join(spark.table(name).hint("merge"), F.expr("k = legacy_key"), "left")
    assert "Exchange" not in plan_of(met)
    assert met.where("target_id IS NOT NULL").count() == sum(i % 700 < 600 for i in range(3000))


def test_publish_keeps_readers_and_buckets(spark, database):
    name = f"{database}.guid_x"
    accumulate_key_map(entries(spark, "o", range(50)), name, buckets=4)
    started = spark.table(name)
    publish(spark.table(name).where("legacy_key < 'k3'"), name)
    assert newest(spark, name)[1]["buckets"] == 4 and started.count() == 50
    assert spark.table(name).count() < 50


def test_stored_maps_are_not_shuffled_in_a_run(spark, database, tmp_path, monkeypatch):
    """Beyond the size of a broadcast, the resolution join of a run moves the staged rows only."""
    monkeypatch.setattr(skew, "SMALL_ROWS", 0)
    plans = []
    target = Target(spark, tmp_path)
    p = plan(spark, "dept", "emp", edges=[("emp", "dept")])
    dept = spark.range(300).selectExpr("concat('d', id) AS k")
    emp = spark.range(3000).selectExpr("concat('e', id) AS k", "concat('d', id % 400) AS dept")

    def seen(df):
        plans.append(plan_of(df))
        return target.loader("emp", "k")(df)

    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        done = run(spark, database, p, {"dept": job(dept, target, "dept"), "emp": replace(
            job(emp, target, "emp", {"dept": "dept"}), load=seen)})
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plans[0].count("SortMergeJoin") == 1 and plans[0].count("Exchange hashpartitioning") == 1
    assert "SelectedBucketsCount" in plans[0] or "Bucketed: true" in plans[0]
    assert done.loaded["emp"].where("dept_id IS NOT NULL").count() == sum(i % 400 < 300 for i in range(3000))
