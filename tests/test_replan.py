"""Plans kept over snapshots, and profiles kept over loads."""

import json

from pyspark.sql import functions as F

from loadwright.operators.profile import column_sketches, combine_profiles
from loadwright.operators.report import profile_staged
from loadwright.options import PlanOptions
from loadwright.plans import replan as kept
from loadwright.plans.replan import environment_digests, replan
from loadwright.sources.commits import newest
from loadwright.sources.tables import add_parts
from tests.helpers import rows
from workloads.fleet import new_database


def write(path, catalog, turned=False):
    documents = [{"org_key": org, "entity_id": f"{org}{t}", "logical_name": t, "schema_name": t, "is_intersect": False, "attributes": [
        {"attribute_id": f"{t}{a}", "logical_name": a, "attr_type": "String", "max_length": 50} for a in attributes]}
        for org, tables in catalog.items() for t, attributes in tables.items()]
    path.mkdir()
    for i, d in enumerate(documents[::-1] if turned else documents):
        (path / f"{i}.json").write_text(json.dumps(d) + "\n")
    return str(path)


def test_only_changed_environments_are_planned_again(spark, tmp_path, monkeypatch):
    database = new_database(spark)
    catalog = {"a": {"t": ["x"], "u": ["y"]}, "b": {"t": ["x"]}, "c": {"t": ["x"]}}
    first = replan(spark, write(tmp_path / "1", catalog), database)
    assert rows(first.states) == {(o, "new"): 1 for o in "abc"}
    planned = []
    plan_migration = kept.plan_migration
    monkeypatch.setattr(kept, "plan_migration", lambda c, **kw: planned.append(
        {r.org_key for r in c.entities.collect()}) or plan_migration(c, **kw))
    # the same documents in other files and another order
    same = replan(spark, write(tmp_path / "2", catalog, turned=True), database)
    assert rows(same.states) == {(o, "unchanged"): 1 for o in "abc"} and not planned
    version = newest(spark, f"{database}.plan_staging")
    other = {"a": {"t": ["x", "z"], "u": ["y"]}, "c": {"t": ["x"]}, "d": {"v": ["w"]}}
    last = replan(spark, write(tmp_path / "3", other), database)
    assert rows(last.states) == {("a", "changed"): 1, ("b", "gone"): 1, ("c", "unchanged"): 1, ("d", "new"): 1}
    assert planned == [{"a", "d"}] and newest(spark, f"{database}.plan_staging") != version
    assert rows(last.frames["plan_columns"], "org_key", "table", "name", "planned") == {
        ("a", "t", "x", 2): 1, ("a", "t", "z", 2): 1, ("a", "u", "y", 2): 1, ("c", "t", "x", 1): 1, ("d", "v", "w", 2): 1}
    assert rows(last.frames["plan_tiers"], "org_key", "table") == {("a", "t"): 1, ("a", "u"): 1, ("c", "t"): 1, ("d", "v"): 1}
    # other options are another plan
    again = replan(spark, str(tmp_path / "3"), database, PlanOptions(batch_size=1))
    assert rows(again.states) == {(o, "changed"): 1 for o in "acd"}
    assert rows(again.frames["plan_batches"].where("org_key = 'a'"), "file_no") == {(1,): 1, (2,): 1}


def test_equal_documents_do_not_cancel_out(spark, tmp_path):
    one = {"a": {"t": ["x"]}}
    path = tmp_path / "twice"
    write(path, one)
    once = environment_digests(spark, str(path)).collect()
    for name in ("8.json", "9.json"):
        (path / name).write_text((path / "0.json").read_text())
    assert environment_digests(spark, str(path)).first().digest != once[0].digest


def test_profiles_of_two_loads_add_up(spark):
    database = new_database(spark)
    name = f"{database}.profiles"
    load = spark.range(60_000).selectExpr(
        "CAST(id AS STRING) AS key", "CASE WHEN id % 3 > 0 THEN CAST(id % 7 AS STRING) END AS kind",
        "concat(repeat('x', 40), CAST(id % 9000 AS STRING)) AS text", "CAST(NULL AS STRING) AS nothing")
    loads = [load.where("key < '4'"), load.where("key >= '3'")]
    for i, rows_ in enumerate(loads):
        add_parts(column_sketches(rows_), name, f"load{i}")
    found = {r.name: r for r in combine_profiles(spark.table(name)).collect()}
    both = loads[0].unionByName(loads[1])
    dictionary = spark.createDataFrame([(c, "T") for c in load.columns], "name string, sql_type string")
    for want in profile_staged(both, dictionary).collect():
        got = found[want.name]
        assert (got.n_rows, got.n_null, got.max_length) == (want.n_rows, want.n_null, want.max_length)
        assert abs(got.n_distinct - want.n_distinct) <= 0.03 * want.n_distinct
    counts = both.where("kind IS NOT NULL").groupBy("kind").count().orderBy(F.desc("count"), "kind").limit(3).collect()
    assert {(t["item"], t["count"]) for t in found["kind"].top_values if t["item"] is not None} >= {
        (c["kind"], c["count"]) for c in counts[:2]}
