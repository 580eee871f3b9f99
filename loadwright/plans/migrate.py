"""From catalog documents to loaded rows: one plan for a fleet, its outputs, and the run of one environment."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loadwright.functions.names import fold
from loadwright.operators import layout as lay
from loadwright.operators import scope
from loadwright.operators.dictionary import dictionary_columns, dictionary_index, dictionary_tables
from loadwright.operators.graph import LoadTiers, dependency_diagram_edges, dependency_edges, load_tiers
from loadwright.operators.skew import lookup_join
from loadwright.operators.staging import StagedColumn
from loadwright.options import PlanOptions
from loadwright.plans.batches import load_batches
from loadwright.plans.run import LoadedTables, TableLoad, run_plan
from loadwright.plans.scripts import KEY_MAP, STAGING, create_statements, diagram_lines, reset_statements
from loadwright.sources.exports import export_rows, export_scripts
from loadwright.sources.scratch import cut
from loadwright.sources.snapshots import Catalog


class MigrationPlan(NamedTuple):
    """All that follows from the catalogs of a fleet; each frame is written."""

    entities: DataFrame
    columns: DataFrame
    staging: DataFrame
    key_maps: DataFrame
    edges: DataFrame
    tiers: LoadTiers
    batches: DataFrame


def plan_migration(catalog: Catalog, selection: DataFrame | None = None, membership: scope.Membership | None = None,
                   options: PlanOptions = PlanOptions()) -> MigrationPlan:
    """Scope, layouts, edges, tiers and batches of every environment.

    ``selection`` (org_key, table) names the tables to take, without it all in scope are taken; ``membership`` restricts
    the attributes to those of a solution.
    """
    entities = scope.tables_in_scope(catalog.entities)
    if selection is not None:
        wanted = selection.select("org_key", F.lower("table").alias("_key")).distinct()
        entities = lookup_join(entities.withColumn("_key", F.lower("logical_name")), wanted, ["org_key", "_key"],
                               "left_semi").drop("_key")
    entities, _ = cut(entities, "plan-entities")
    tables = entities.select("org_key", F.col("logical_name").alias("table"))
    kept = scope.attributes_in_scope(catalog.attributes, entities, membership)
    columns, _ = cut(lay.add_companions(lay.map_types(kept)), "plan-columns")
    edges, _ = cut(dependency_edges(columns, tables, options.dependency_exclusions), "plan-edges")
    tiers = load_tiers(tables, edges)
    batches, _ = cut(load_batches(tiers.tiers, options.batch_size), "plan-batches")
    staging, _ = cut(lay.staging_layout(columns, tables).columns, "plan-staging")
    key_maps, _ = cut(lay.key_map_layout(columns, entities, options.match_key_suffixes).columns, "plan-key-maps")
    return MigrationPlan(entities, columns, staging, key_maps, edges, tiers, batches)


def write_outputs(plan: MigrationPlan, path: str, options: PlanOptions = PlanOptions()) -> list[str]:
    """Write what the switches of ``options`` ask for, a folder for each kind; returns the kinds that were written.

    Below a folder there is one for each environment.  Nothing is written, or worked out, for a switch that is off.
    """
    done = []

    def scripts(kind: str, rows: DataFrame, text: str, *order: str) -> None:
        export_scripts(rows, f"{path}/{kind}", text, *order)
        done.append(kind)

    if options.staging:
        scripts("staging", create_statements(plan.staging, plan.entities, plan.batches, STAGING, options), "statement", "pos")
    if options.key_maps:
        scripts("key_maps", create_statements(plan.key_maps, plan.entities, plan.batches, KEY_MAP, options), "statement", "pos")
    for action in ("truncate", "teardown"):
        if getattr(options, action):
            rows = reset_statements(plan.entities, plan.batches, action, options)
            scripts(action, rows, "statement", "block", "reverse_no")
    if options.dictionary:
        export_rows(dictionary_index(plan.entities, plan.batches, plan.tiers.dropped), f"{path}/dictionary/index", "position")
        export_rows(dictionary_tables(plan.entities, plan.tiers.tiers), f"{path}/dictionary/tables", "logical_name")
        planned = plan.tiers.tiers.select("org_key", F.col("table").alias("_key"))
        listed = lookup_join(plan.columns.withColumn("_key", fold("table")), planned, ["org_key", "_key"], "left_semi")
        export_rows(dictionary_columns(listed), f"{path}/dictionary/columns", "table", "position")
        done.append("dictionary")
    if options.diagram:
        edges, _ = cut(dependency_diagram_edges(plan.edges, plan.tiers.dropped, plan.tiers.tiers), "plan-diagram")
        scripts("diagram", diagram_lines(plan.entities, plan.batches, edges), "line", "line_no")
    return done


def table_loads(plan: MigrationPlan, org_key: str, sources: Mapping[str, DataFrame],
                load: Callable[[str, str], Callable[[DataFrame], DataFrame]], options: PlanOptions = PlanOptions(),
                scales: Mapping[str, Mapping[str, int]] | None = None) -> dict[str, TableLoad]:
    """What ``run_plan`` needs for the tables of one environment, from its layouts and lookups.

    ``sources`` has the rows of each planned table, ``load`` makes the loader of a table from its name and match key,
    ``scales`` gives decimal places by table and column.  The match key is the first column by name that ends with one
    of the suffixes; a table without one, or without a source, is an error that names all such tables.  A lookup with
    one target in the plan is a plain one, one with several is polymorphic; targets outside the plan are not resolved.

    The driver reads the columns of one environment, as it does to create its staging tables.
    """
    here = F.col("org_key") == org_key
    layout: dict[str, list[StagedColumn]] = {}
    for r in plan.staging.where(here).orderBy("table", "ordinal").collect():
        layout.setdefault(r["table"].lower(), []).append(StagedColumn(r["name"], r["sql_type"]))
    given = {table.lower(): rows for table, rows in sources.items()}
    planned = {r["table"].lower() for r in plan.tiers.tiers.where(here).select("table").collect()}
    keys: dict[str, str] = {}
    for r in lay.match_keys(plan.columns.where(here), options.match_key_suffixes).select("table", "name").collect():
        table = r["table"].lower()
        keys[table] = min(keys.get(table, r["name"]), r["name"])
    wrong = sorted(t for t in planned if t not in keys or t not in given)
    if wrong:
        raise ValueError(f"tables of {org_key} without a match key or a source: {', '.join(wrong)}")
    single: dict[str, dict[str, str]] = {}
    mixed: dict[str, dict[str, list[str]]] = {}
    links = plan.columns.where(here & F.col("is_lookup")).select("table", "name", "targets", "is_polymorphic")
    for r in links.collect():
        targets = [t.lower() for t in r["targets"] if t.lower() in planned]
        if targets and r["is_polymorphic"]:
            mixed.setdefault(r["table"].lower(), {})[r["name"]] = targets
        elif targets:
            single.setdefault(r["table"].lower(), {})[r["name"]] = targets[0]
    return {
        t: TableLoad(given[t], layout[t], keys[t], load(t, keys[t]), single.get(t, {}), mixed.get(t, {}),
                     (scales or {}).get(t, {}))
        for t in planned}


def run_migration(spark: SparkSession, plan: MigrationPlan, org_key: str, loads: Mapping[str, TableLoad], database: str,
                  options: PlanOptions = PlanOptions(), run_id: str | None = None) -> LoadedTables:
    """Run the load of one environment in the order of its tiers."""
    here = F.col("org_key") == org_key
    return run_plan(spark, plan.tiers.tiers.where(here), plan.tiers.dropped.where(here), loads, database, options,
                    run_id=run_id)
