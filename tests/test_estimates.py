"""Frames that an explode makes of few rows: their sides are not broadcast, and they are dealt out before they are grouped."""

import re

import pytest
from pyspark.sql import functions as F

from loadwright.operators.dictionary import dictionary_index
from loadwright.operators.graph import dependency_diagram_edges, dependency_edges
from loadwright.operators.scope import categories
from loadwright.operators.skew import lookup_join
from loadwright.plans.scripts import reset_statements
from tests.helpers import plan_of, rows


@pytest.fixture(scope="module")
def fleet(spark, tmp_path_factory):
    """Three environments of three tables from a file of three rows, which the planner takes to be small."""
    path = str(tmp_path_factory.mktemp("fleet") / "orgs")
    spark.range(3).select(F.col("id").cast("string").alias("org_key")).coalesce(1).write.parquet(path)
    orgs = spark.read.parquet(path)
    names = F.explode(F.array(F.lit("a_x"), F.lit("a_y"), F.lit("b")))
    entities = orgs.select("org_key", names.alias("logical_name")).withColumns({
        "schema_name": F.col("logical_name"), "display_name": F.upper("logical_name")})
    return entities, entities.select("org_key", F.col("logical_name").alias("table"))


def columns(tables):
    return tables.select("org_key", "table", F.lit("ref").alias("name"), F.lit(True).alias("is_lookup"),
                         F.array(F.lit("b"), F.lit("gone")).alias("targets"))


def test_exploded_sides_are_not_broadcast(fleet):
    entities, tables = fleet
    edges = dependency_edges(columns(tables), tables)
    placed = tables.select("org_key", "table", F.lit(0).alias("tier"), F.lit(1).alias("file_no"),
                           *(F.length("table").alias(n) for n in ("order_no", "reverse_no")))
    dropped = edges.where("src = 'a_x'")
    found = {
        "join": lookup_join(tables, entities.withColumnRenamed("logical_name", "table"), ["org_key", "table"], "inner"),
        "edges": edges, "diagram": dependency_diagram_edges(edges, dropped, placed),
        "reset": reset_statements(entities, placed), "index": dictionary_index(entities, placed, dropped)}
    for name, df in found.items():
        assert "Broadcast" not in plan_of(df), name
    assert rows(edges) == {(str(o), t, "b"): 1 for o in range(3) for t in ("a_x", "a_y")}
    assert sorted(r.status for r in found["diagram"].collect()) == ["deferred"] * 3 + ["kept"] * 3
    assert found["reset"].count() == 18 and found["index"].count() == 9


@pytest.mark.parametrize("grouped", ["edges", "categories"])
def test_nothing_is_grouped_in_the_task_that_explodes(fleet, grouped):
    entities, tables = fleet
    df = dependency_edges(columns(tables), tables) if grouped == "edges" else categories(entities)
    # the plan from the last exchange down, which is what one task of the scan does
    for scan in re.split(r"FileScan", plan_of(df))[:-1]:
        assert "Aggregate" not in scan[scan.rindex("Exchange"):]
    assert len(df.collect()) == 6
