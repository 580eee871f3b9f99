"""Script text of a small plan."""

from loadwright.operators.graph import dependency_diagram_edges, load_tiers
from loadwright.options import PlanOptions
from loadwright.plans.batches import load_batches
from loadwright.plans.scripts import KEY_MAP, create_statements, diagram_lines, reset_statements
from loadwright.sources.exports import export_rows, export_scripts


def small_plan(spark):
    entities = spark.createDataFrame(
        [("o", "a", "A", 'The "A" [x]'), ("o", "b", "B", "b")],
        "org_key string, logical_name string, schema_name string, display_name string")
    tables = entities.selectExpr("org_key", "logical_name AS table")
    edges = spark.createDataFrame([("o", "b", "a"), ("o", "a", "b")], "org_key string, src string, dst string")
    plan = load_tiers(tables, edges)
    return entities, edges, plan, load_batches(plan.tiers)


def test_statements(spark):
    entities, _, _, batches = small_plan(spark)
    layout = spark.createDataFrame(
        [("o", "a", 1, "id", "INT", None), ("o", "a", 2, "new_legacyid", "BIT", "lookup: b"), ("o", "b", 1, "c", "DATE", None)],
        "org_key string, table string, ordinal int, name string, sql_type string, comment string")
    options = PlanOptions(staging_drop_recreate=False, index_match_keys=True)
    rows = {r["table"]: r for r in create_statements(layout, entities, batches, options=options).collect()}
    assert (rows["a"]["file_name"], rows["b"]["file_name"]) == ("01_create_staging.sql", "02_create_staging.sql")
    assert rows["a"]["statement"] == (
        "IF OBJECT_ID(N'[dbo].[stage_A]', N'U') IS NULL\nBEGIN\nCREATE TABLE [dbo].[stage_A](\n    [id] INT,\n"
        "    [new_legacyid] BIT    -- lookup: b\n);\nEND\n"
        "IF NOT EXISTS (SELECT 1 FROM sys.indexes WHERE [name] = N'IX_stage_A_new_legacyid' AND [object_id] = "
        "OBJECT_ID(N'[dbo].[stage_A]'))\n    CREATE NONCLUSTERED INDEX [IX_stage_A_new_legacyid] ON [dbo].[stage_A]([new_legacyid]);")
    rebuilt = create_statements(layout, entities, batches, KEY_MAP, PlanOptions(key_map_drop_recreate=True))
    assert {r["table"]: r["statement"] for r in rebuilt.collect()}["b"] == (
        "DROP TABLE IF EXISTS [dbo].[guid_B];\nCREATE TABLE [dbo].[guid_B](\n    [c] DATE NULL\n);")


def test_resets_run_backwards_and_spare_key_maps(spark):
    entities, _, _, batches = small_plan(spark)
    rows = reset_statements(entities, batches, "teardown").orderBy("block", "reverse_no").collect()
    assert [r["statement"] for r in rows] == [
        "DROP TABLE IF EXISTS [dbo].[stage_B];", "DROP TABLE IF EXISTS [dbo].[stage_A];",
        "-- DROP TABLE IF EXISTS [dbo].[guid_B];", "-- DROP TABLE IF EXISTS [dbo].[guid_A];"]


def test_diagram_and_its_file(spark, tmp_path):
    entities, edges, plan, batches = small_plan(spark)
    lines = diagram_lines(entities, batches, dependency_diagram_edges(edges, plan.dropped, plan.tiers))
    want = [
        "flowchart TD", '    subgraph tier0["Tier 0"]', "        a[\"The 'A' (x)<br/><small>a</small>\"]", "    end",
        '    subgraph tier1["Tier 1"]', '        b["b<br/><small>b</small>"]', "    end", "    a -.-> b", "    b --> a"]
    assert [r["line"] for r in lines.orderBy("line_no").collect()] == want
    export_scripts(lines, str(tmp_path / "out"), "line", "line_no")
    parts = sorted((tmp_path / "out" / "org_key=o" / "file_name=diagram.mmd").glob("part-*"))
    assert "".join(p.read_text() for p in parts).splitlines() == want


def test_rows_by_environment(spark, tmp_path):
    rows = spark.createDataFrame([("o", 2, "b"), ("o", 1, "a"), ("p", 1, "c")], "org_key string, position int, name string")
    for format in ("csv", "parquet"):
        path = str(tmp_path / format)
        export_rows(rows, path, "position", format=format)
        back = spark.read.schema(rows.schema).option("header", True).format(format).load(path)
        assert sorted(map(tuple, back.select(*rows.columns).collect())) == [("o", 1, "a"), ("o", 2, "b"), ("p", 1, "c")]
