"""From catalog documents to loaded rows, and what the output switches write."""

import json
import os
import shutil
import subprocess
import sys
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from loadwright.options import PlanOptions
from loadwright.plans.migrate import plan_migration, run_migration, table_loads, write_outputs
from loadwright.sources.snapshots import flatten_snapshot, read_snapshot
from tests.helpers import rows
from workloads.fleet import new_database

OPTIONS = PlanOptions(match_key_suffixes="legacyid", staging=False, key_maps=False)
SWITCHES = ("staging", "key_maps", "truncate", "teardown", "dictionary", "diagram")


def attribute(name, kind="String", targets=None):
    return {"attribute_id": name, "logical_name": name, "attr_type": kind, "max_length": 50, "targets": targets, "is_custom": True}


@pytest.fixture(scope="module")
def catalog(spark, tmp_path_factory):
    tables = {
        "Account": [attribute("acc_legacyid"), attribute("name"), attribute("contact", "Lookup", ["contact"])],
        "contact": [attribute("con_legacyid"), attribute("parent", "Customer", ["Account", "contact"]),
                    attribute("boss", "Lookup", ["contact"]), attribute("born", "DateTime")],
        "note": [attribute("legacyid"), attribute("about", "Lookup", ["elsewhere"])],
    }
    path = tmp_path_factory.mktemp("catalog") / "documents.json"
    path.write_text("\n".join(json.dumps({
        "org_key": org, "entity_id": f"{org}{t}", "logical_name": t, "schema_name": t, "display_name": t, "is_intersect": False,
        "attributes": a}) for org in ("one", "two") for t, a in tables.items()))
    return flatten_snapshot(read_snapshot(spark, str(path)))


@pytest.fixture(scope="module")
def plan(catalog):
    return plan_migration(catalog, options=OPTIONS)


def outputs(path):
    return sorted(os.listdir(path)) if os.path.isdir(path) else []


@pytest.mark.parametrize("on", [(), *((s,) for s in SWITCHES), SWITCHES])
def test_switches_write_their_outputs_and_no_others(plan, tmp_path, on):
    path = str(tmp_path / "out")
    done = write_outputs(plan, path, replace(OPTIONS, **dict.fromkeys(on, True)))
    assert sorted(done) == outputs(path) == sorted(on)
    for kind in set(on) - {"dictionary"}:
        assert {"org_key=one", "org_key=two"} <= set(outputs(f"{path}/{kind}"))


def test_scripts_are_in_order(spark, plan, tmp_path):
    path = str(tmp_path / "out")
    write_outputs(plan, path, replace(OPTIONS, truncate=True, diagram=True))
    text = spark.read.text(f"{path}/truncate/org_key=one/file_name=truncate.sql").collect()
    # what is loaded last is emptied first; key maps come after that, commented out
    order = [r.table for r in plan.batches.where("org_key = 'one'").orderBy("reverse_no").collect()]
    assert [r.value.split("].[")[-1].lower() for r in text] == [f"{kind}_{t}];" for kind in ("stage", "guid") for t in order]
    assert [r.value.startswith("--") for r in text] == [False] * 3 + [True] * 3
    assert spark.read.text(f"{path}/diagram/org_key=two").first().value == "flowchart TD"
    write_outputs(plan, path, replace(OPTIONS, dictionary=True))
    listed = spark.read.option("header", True).csv(f"{path}/dictionary/columns")
    assert rows(listed.where("org_key = 'one'"), "table") == {("Account",): 3, ("contact",): 5, ("note",): 2}


def test_loads_follow_the_catalog(spark, plan, tmp_path):
    def sources(**changed):
        frames = {
            "account": spark.createDataFrame([("a1", "A", "c2"), ("a2", None, None)], "ACC_LegacyId string, name string, contact string"),
            "Contact": spark.createDataFrame(
                [("c1", "a1", "Account", None, "2020-01-02"), ("c2", "c1", "contact", "c1", None), ("c3", "x", "account", "c2", "no")],
                "con_legacyid string, parent string, parenttype string, boss string, born string"),
            "note": spark.createDataFrame([("n1", "e1")], "legacyid string, about string")}
        return frames | changed

    def loader(table, key):
        return lambda df: df.withColumn("target_id", F.concat(F.lit(f"{table}:"), key))

    loads = table_loads(plan, "one", sources(), loader, OPTIONS)
    assert {t: j.match_key for t, j in loads.items()} == {"account": "acc_legacyid", "contact": "con_legacyid", "note": "legacyid"}
    assert loads["account"].lookups == {"contact": "contact"} and loads["contact"].lookups == {"boss": "contact"}
    assert loads["contact"].polymorphic == {"parent": ["account", "contact"]} and loads["note"].lookups == {}
    done = run_migration(spark, plan, "one", loads, new_database(spark), OPTIONS)
    assert rows(done.loaded["account"], "acc_legacyid", "contact_id") == {("a1", "contact:c2"): 1, ("a2", None): 1}
    assert rows(done.loaded["contact"], "con_legacyid", "parent_id", "boss_id") == {
        ("c1", "account:a1", None): 1, ("c2", "contact:c1", "contact:c1"): 1}
    assert rows(done.rejects["contact"], "con_legacyid", "column", "reason") == {("c3", "born", "type"): 1}
    assert rows(done.loaded["note"], "legacyid", "about") == {("n1", "e1"): 1}
    with pytest.raises(ValueError, match="of one without a match key or a source: account"):
        table_loads(plan, "one", {k: v for k, v in sources().items() if k != "account"}, loader, OPTIONS)
    with pytest.raises(ValueError, match="account, contact, note"):
        table_loads(plan, "one", sources(), loader, replace(OPTIONS, match_key_suffixes="code"))


def test_selection_restricts_the_plan(spark, catalog):
    chosen = spark.createDataFrame([("one", "ACCOUNT"), ("one", "gone")], "org_key string, table string")
    plan = plan_migration(catalog, chosen, options=OPTIONS)
    assert rows(plan.tiers.tiers, "org_key", "table", "tier") == {("one", "account", 0): 1}
    assert {r["table"] for r in plan.columns.collect()} == {"Account"}


def test_entry_without_the_other_package(tmp_path):
    """The rest of the library imports and runs a query in a copy that has neither the subpackage nor its tests."""
    home = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    copy = tmp_path / "copy"
    skipped = {"llm", ".git", "__pycache__", "spark-warehouse"}
    shutil.copytree(home, copy, ignore=lambda _, names: skipped & set(names))
    for pipeline in (True, False):
        if not pipeline and (copy / "corpus_pipeline.py").exists():
            (copy / "corpus_pipeline.py").unlink()
        found = subprocess.run(
            [sys.executable, "-c", "import __spark_entry__ as e; print(*sorted(e.queries())); assert e.oracle_sql().keys() <= e.queries().keys()"],
            cwd=copy, capture_output=True, text=True, timeout=120, env={**os.environ, "PYTHONPATH": str(copy)})
        assert found.returncode == 0, found.stderr
        names = found.stdout.split()
        assert "tiered_load" in names and "pipeline" not in names and not [n for n in names if n.startswith("op")]
