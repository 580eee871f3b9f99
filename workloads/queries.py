"""The registered queries: (spark, sf_dir) -> DataFrame over the whole given tables."""

from __future__ import annotations

from collections.abc import Callable
from contextlib import suppress
from dataclasses import replace
from functools import reduce
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loadwright.operators import layout as lay
from loadwright.operators import scope
from loadwright.operators.dictionary import dictionary_columns, dictionary_index, dictionary_tables
from loadwright.operators.graph import (LoadTiers, cycle_warnings, dependency_diagram_edges, dependency_edges,
                                        load_tiers)
from loadwright.operators.keymap import build_key_map, key_map_entries
from loadwright.operators.profile import column_sketches, combine_profiles
from loadwright.operators.report import profile_staged, unresolved_report
from loadwright.operators.resolve import deferred_update, resolve_lookups, resolve_polymorphic
from loadwright.operators.skew import lookup_join, number_rows, previous_in_group
from loadwright.operators.staging import StagedColumn, split_rejects, stage_rows
from loadwright.operators.waves import row_waves
from loadwright.options import PlanOptions
from loadwright.plans.batches import load_batches, load_order, plan_summary
from loadwright.plans.migrate import plan_migration, run_migration, table_loads, write_outputs
from loadwright.plans.replan import replan
from loadwright.plans.run import TableLoad, run_plan
from loadwright.plans.scripts import KEY_MAP, STAGING, create_statements, diagram_lines, reset_statements
from loadwright.sources.scratch import cut, new_path, settle
from loadwright.sources.snapshots import attribute_targets, flatten_snapshot, read_snapshot
from loadwright.sources.tables import (CREATE_IF_MISSING, DROP_AND_RECREATE, accumulate_key_map, add_parts,
                                       clustered_lookup, cluster_by_match_key, rebuild_key_map, remove_old_versions,
                                       reset_staging, write_staging)
from workloads import fleet
from workloads.fleet import read

Query = Callable[[SparkSession, str], DataFrame]

# Fixed value: tables per batch in the registered plans.
BATCH_SIZE = 2

TEXT = "NVARCHAR(100)"


# ---------------------------------------------------------------- catalog

def flatten(spark: SparkSession, sf_dir: str):
    return flatten_snapshot(read_snapshot(spark, fleet.case_documents(spark, sf_dir)))


def flatten_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flatten(spark, sf_dir).entities


def flatten_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    attributes = flatten(spark, sf_dir).attributes
    return attributes.withColumn("targets", F.array_join("targets", ","))


def flatten_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return attribute_targets(flatten(spark, sf_dir).attributes)


def tables_in_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scope.tables_in_scope(fleet.crm_entities(spark, sf_dir)).select("org_key", "logical_name", "display_name")


def table_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scope.with_category(fleet.crm_entities(spark, sf_dir)).select("org_key", "logical_name", "category")


def category_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scope.categories(scope.tables_in_scope(fleet.crm_entities(spark, sf_dir)))


def visible_solutions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scope.visible_solutions(fleet.solutions(spark, sf_dir))


def chosen_solutions(spark: SparkSession, sf_dir: str) -> DataFrame:
    picks = fleet.suppliers(spark, sf_dir).select("org_key", F.expr(
        "element_at(array(NULL, 'ZETA', 'patch1', 'gamma', ''), CAST(key % 5 + 1 AS INT))").alias("solution"))
    visible = scope.visible_solutions(fleet.solutions(spark, sf_dir))
    without_default = visible.where("NOT (unique_name = 'Default' AND CAST(org_key AS INT) % 2 = 1)")
    return scope.chosen_solutions(without_default, picks)


def membership(spark: SparkSession, sf_dir: str) -> scope.Membership:
    return scope.solution_membership(fleet.components(spark, sf_dir), fleet.chosen_solutions(spark, sf_dir))


def solution_membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = membership(spark, sf_dir)
    return found.entities.select("org_key", F.lit("entity").alias("kind"), F.col("entity_id").alias("object_id"),
                                 "behavior").unionByName(
        found.attributes.select("org_key", F.lit("attribute").alias("kind"),
                                F.col("attribute_id").alias("object_id"), F.lit(None).cast("int").alias("behavior")))


def find_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = scope.tables_in_scope(fleet.crm_entities(spark, sf_dir))
    found = scope.find_tables(tables, fleet.crm_membership(spark, sf_dir), term=" Se ", in_category="X")
    return found.select("org_key", "logical_name", "display_name", "category")


def find_checked_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = scope.tables_in_scope(fleet.crm_entities(spark, sf_dir))
    found = scope.find_tables(tables, None, fleet.crm_selections(spark, sf_dir), term="a", checked_only=True)
    return found.select("org_key", "logical_name", "display_name", "category")


def effective_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = scope.tables_in_scope(fleet.crm_entities(spark, sf_dir))
    orgs = fleet.customers(spark, sf_dir).select("org_key")
    return scope.effective_selection(orgs, fleet.crm_selections(spark, sf_dir), ["Contact", "x_site", "gone"], tables,
                                     fleet.crm_membership(spark, sf_dir))


def case_catalog(spark: SparkSession, sf_dir: str):
    return flatten_snapshot(fleet.case_snapshot(spark, sf_dir))


def attributes_in_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    catalog = case_catalog(spark, sf_dir)
    kept = scope.attributes_in_scope(catalog.attributes, catalog.entities, membership(spark, sf_dir))
    return kept.select("org_key", "table", "logical_name", "attr_type", "is_primary_id", "is_primary_name")


def all_attributes_in_scope(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    catalog = case_catalog(spark, sf_dir)
    return scope.attributes_in_scope(catalog.attributes, catalog.entities), catalog.entities


def case_columns(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    kept, entities = all_attributes_in_scope(spark, sf_dir)
    return lay.add_companions(lay.map_types(kept)), entities


def map_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    typed = lay.map_types(all_attributes_in_scope(spark, sf_dir)[0])
    return typed.withColumn("targets", F.array_join("targets", ","))


def untyped_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lay.untyped_attributes(all_attributes_in_scope(spark, sf_dir)[0])


def companions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return case_columns(spark, sf_dir)[0].select(
        "org_key", "table", "name", "sql_type", "is_lookup", "is_polymorphic", "is_type_companion", "display_name",
        "attr_type", "additional_info", "is_custom")


def staging_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns, entities = case_columns(spark, sf_dir)
    return lay.staging_layout(columns, _tables(entities)).columns


def _tables(entities: DataFrame) -> DataFrame:
    return entities.select("org_key", F.col("logical_name").alias("table"))


def match_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lay.match_keys(case_columns(spark, sf_dir)[0], "LegacyId, , code")
    return found.select("org_key", "table", "name", "sql_type")


def key_map_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns, entities = case_columns(spark, sf_dir)
    return lay.key_map_layout(columns, entities).columns


def layout_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns, entities = case_columns(spark, sf_dir)
    return lay.key_map_layout(columns, entities, "legacyid,title,orderid,tYPE").conflicts


# ---------------------------------------------------------------- load plan

def crm_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dependency_edges(fleet.crm_columns(spark, sf_dir), fleet.crm_planned(spark, sf_dir))


def crm_plan(spark: SparkSession, sf_dir: str) -> LoadTiers:
    return load_tiers(fleet.crm_planned(spark, sf_dir), crm_edges(spark, sf_dir))


def crm_batches(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    plan = crm_plan(spark, sf_dir)
    return settle(load_batches(plan.tiers, BATCH_SIZE))[0], plan.dropped


def dependency_edges_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crm_edges(spark, sf_dir)


def excluded_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dependency_edges(fleet.crm_columns(spark, sf_dir), fleet.crm_planned(spark, sf_dir),
                            "CustomerId; x_regionid\n,\r\n nothing ")


def load_tiers_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crm_plan(spark, sf_dir).tiers


def dropped_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crm_plan(spark, sf_dir).dropped.select("org_key", "src", "dst")


def cycle_warnings_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cycle_warnings(crm_plan(spark, sf_dir).dropped).select("org_key", "table", "warning")


def load_tiers_order_graphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load_tiers(*fleet.order_graphs(spark, sf_dir)).tiers


def dropped_edges_order_graphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load_tiers(*fleet.order_graphs(spark, sf_dir)).dropped.select("org_key", "src", "dst")


# Lookups between the given tables as 'source target'.
TPCH_EDGES = ("nation region", "customer nation", "supplier nation", "orders customer", "lineitem orders",
              "lineitem part", "lineitem supplier")
TPCH_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem")


def load_tiers_acyclic(spark: SparkSession, sf_dir: str) -> DataFrame:
    orgs = fleet.suppliers(spark, sf_dir).select("org_key")
    tables = orgs.select("org_key", F.explode(F.array(*map(F.lit, TPCH_TABLES))).alias("table"))
    pairs = F.array(*(F.struct(F.lit(s).alias("src"), F.lit(d).alias("dst"))
                      for s, d in (e.split() for e in TPCH_EDGES)))
    return load_tiers(tables, orgs.select("org_key", F.inline(pairs))).tiers


def load_batches_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crm_batches(spark, sf_dir)[0].drop("order_no", "reverse_no")


def load_order_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load_order(crm_batches(spark, sf_dir)[0])


def diagram_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = crm_plan(spark, sf_dir)
    return dependency_diagram_edges(crm_edges(spark, sf_dir), plan.dropped, plan.tiers)


def plan_summary_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plan_summary(*crm_batches(spark, sf_dir), PlanOptions(truncate=True, dictionary=True, diagram=True))


def dictionary_index_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dictionary_index(fleet.crm_entities(spark, sf_dir), *crm_batches(spark, sf_dir))


def dictionary_tables_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    entities = case_catalog(spark, sf_dir).entities
    tables = _tables(entities)
    edges = dependency_edges(case_columns(spark, sf_dir)[0], tables)
    return dictionary_tables(entities, load_tiers(tables, edges).tiers)


def dictionary_columns_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dictionary_columns(case_columns(spark, sf_dir)[0])


def _case_scripts(spark: SparkSession, sf_dir: str, kind: str, options: PlanOptions) -> DataFrame:
    columns, entities = case_columns(spark, sf_dir)
    tables = _tables(entities)
    batches = load_batches(load_tiers(tables, dependency_edges(columns, tables)).tiers)
    layout = lay.staging_layout(columns, tables) if kind == STAGING else lay.key_map_layout(columns, entities)
    return create_statements(layout.columns, entities, batches, kind, options)


def staging_scripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _case_scripts(spark, sf_dir, STAGING, PlanOptions())


def key_map_scripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _case_scripts(spark, sf_dir, KEY_MAP, PlanOptions(index_match_keys=True, key_map_prefix="ids_"))


def truncate_script(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reset_statements(fleet.crm_entities(spark, sf_dir), crm_batches(spark, sf_dir)[0])


def teardown_script(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reset_statements(fleet.crm_entities(spark, sf_dir), crm_batches(spark, sf_dir)[0], "teardown",
                            PlanOptions(schema_name="mig"))


def diagram_script(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = crm_plan(spark, sf_dir)
    edges = dependency_diagram_edges(crm_edges(spark, sf_dir), plan.dropped, plan.tiers)
    batches, _ = settle(load_batches(plan.tiers, BATCH_SIZE))
    return diagram_lines(fleet.crm_entities(spark, sf_dir), batches, settle(edges)[0])


def replan_changed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A plan of every supplier's environment, then one of new documents: every tenth has a wider title, every eleventh is
    gone.  Per environment, in which replanning it was planned, and what its title is staged as.
    """
    database, later = fleet.new_database(spark), new_path(spark, "later")
    documents = fleet.case_documents(spark, sf_dir)
    key = F.col("org_key").cast("long")
    wider = F.expr("transform(attributes, a -> if(a.logical_name = 'x_title', named_struct("
                   "'attribute_id', a.attribute_id, 'logical_name', a.logical_name, 'attr_type', a.attr_type, "
                   "'attribute_of', a.attribute_of, 'max_length', 300, 'date_format', a.date_format, "
                   "'is_multi_select', a.is_multi_select, 'targets', a.targets, 'display_name', a.display_name, "
                   "'description', a.description, 'is_custom', a.is_custom), a))")
    fleet.case_snapshot(spark, sf_dir).where(key % 11 != 0).withColumn(
        "attributes", F.when(key % 10 == 0, wider).otherwise(F.col("attributes"))).write.json(later)
    replan(spark, documents, database)
    stored = replan(spark, later, database).frames["plan_staging"]
    return stored.where("name = 'x_title'").select("org_key", "sql_type", "planned")


# ---------------------------------------------------------------- data

def target_id(table: str, key: str):
    """The id the target system is taken to have given a row."""
    return F.md5(F.concat_ws("|", F.lit(table), F.col(key).cast("string")))


def loaded(spark: SparkSession, sf_dir: str, table: str, key: str) -> DataFrame:
    return read(spark, sf_dir, table).withColumn("target_id", target_id(table, key))


ORDER_COLUMNS = [
    StagedColumn("O_CustKey", TEXT), StagedColumn("o_orderdate", "DATETIME2(7)"), StagedColumn("o_orderkey", TEXT),
    StagedColumn("o_orderpriority", "NVARCHAR(15)"), StagedColumn("o_orderstatus", TEXT),
    StagedColumn("o_remark", "NVARCHAR(MAX)"), StagedColumn("o_totalprice", TEXT),
    StagedColumn("overriddencreatedon", "DATETIME2(7)"), StagedColumn("ownerid", TEXT),
    StagedColumn("owneridtype", TEXT), StagedColumn("statecode", "INT"),
]


def stage_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stage_rows(read(spark, sf_dir, "orders"), ORDER_COLUMNS, {"o_totalprice": 2})


def stage_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = split_rejects(
        read(spark, sf_dir, "documents"),
        [StagedColumn("doc_id", "BIGINT"), StagedColumn("lang", TEXT), StagedColumn("text", "NVARCHAR(4000)")], ["doc_id"])
    events = split_rejects(
        read(spark, sf_dir, "events"), [StagedColumn("event_id", "BIGINT"), StagedColumn("props", "INT")], ["event_id"])
    parts = [df.withColumnRenamed(key, "row_key").withColumn("table", F.lit(table))
             for table, key, df in (("documents", "doc_id", documents.rejects), ("events", "event_id", events.rejects))]
    return parts[0].unionByName(parts[1]).select("table", "row_key", "column", "reason", F.md5("value").alias("value_md5"))


def stage_rejects_lossy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values that a target type would change or cannot hold."""
    parts = (
        ("orders", "o_orderkey", [StagedColumn("o_totalprice", "INT"), StagedColumn("o_orderdate", "DATE")], {}),
        ("events", "event_id", [StagedColumn("ts", "DATE"), StagedColumn("user_id", "SMALLINT")], {}),
        ("documents", "doc_id", [StagedColumn("text", "NVARCHAR(MAX)")], {"text": 2}))
    out = None
    for table, key, columns, scales in parts:
        rejects = split_rejects(read(spark, sf_dir, table), columns, [key], scales).rejects
        part = rejects.select(F.lit(table).alias("table"), F.col(key).alias("row_key"), "column", "reason")
        out = part if out is None else out.unionByName(part)
    return out


def stage_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = [StagedColumn("doc_id", "BIGINT"), StagedColumn("lang", "NVARCHAR(2)"),
               StagedColumn("text", "NVARCHAR(4000)"), StagedColumn("statecode", "INT")]
    return split_rejects(read(spark, sf_dir, "documents"), columns, ["doc_id"]).clean


CUSTOMER_COLUMNS = [StagedColumn("c_custkey", TEXT), StagedColumn("c_mktsegment", TEXT), StagedColumn("c_name", TEXT)]


def staging_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    staged = stage_rows(read(spark, sf_dir, "customer"), CUSTOMER_COLUMNS)
    database = fleet.new_database(spark)
    tables = []
    for mode in (DROP_AND_RECREATE, CREATE_IF_MISSING):
        for _ in range(2):
            table = write_staging(staged, f"{database}.stage_{mode}", CUSTOMER_COLUMNS, mode)
        tables.append(table.groupBy("c_custkey", "c_mktsegment").agg(F.count(F.lit(1)).alias("copies"))
                      .withColumn("mode", F.lit(mode)))
    return tables[0].unionByName(tables[1])


def customer_map(spark: SparkSession, sf_dir: str):
    rows = loaded(spark, sf_dir, "customer", "c_custkey").select(
        "target_id", "c_custkey", F.col("c_name").alias("name"), F.col("c_nationkey").cast("string").alias("nation"))
    return build_key_map(rows, "target_id", "c_custkey", ["name", "nation"])


def part_map(spark: SparkSession, sf_dir: str):
    rows = loaded(spark, sf_dir, "part", "p_partkey").withColumnRenamed("p_brand", "name")
    return build_key_map(rows, "target_id", "p_name", ["name"])


def key_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return customer_map(spark, sf_dir).entries


def key_map_shared_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return part_map(spark, sf_dir).entries


def key_map_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return part_map(spark, sf_dir).conflicts


def _map_runs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """An earlier run that knew the even keys under other ids, and a later one with all keys."""
    later = loaded(spark, sf_dir, "customer", "c_custkey").select(
        "target_id", F.col("c_custkey").cast("string").alias("legacy_key"))
    earlier = read(spark, sf_dir, "customer").where("c_custkey % 2 = 0").select(
        target_id("earlier", "c_custkey").alias("target_id"), F.col("c_custkey").cast("string").alias("legacy_key"))
    return earlier, later


def key_map_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = f"{fleet.new_database(spark)}.guid_customer"
    earlier, later = _map_runs(spark, sf_dir)
    accumulate_key_map(earlier, name)
    accumulate_key_map(later, name)
    return accumulate_key_map(later, name)


def key_map_rebuild(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = f"{fleet.new_database(spark)}.guid_customer"
    earlier, later = _map_runs(spark, sf_dir)
    accumulate_key_map(earlier, name)
    return rebuild_key_map(later, name)


def key_map_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A map of an earlier run, merged with a later one that carries a further column, and merged again."""
    name = f"{fleet.new_database(spark)}.guid_customer"
    earlier, _ = _map_runs(spark, sf_dir)
    named = loaded(spark, sf_dir, "customer", "c_custkey").select(
        "target_id", F.col("c_custkey").cast("string").alias("legacy_key"), F.col("c_name").alias("name"))
    accumulate_key_map(earlier, name)
    accumulate_key_map(named, name)
    merged = accumulate_key_map(named, name)
    remove_old_versions(spark, name)
    return merged


def partial_customer_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Key map without every tenth customer, so that some lookups find nothing."""
    return loaded(spark, sf_dir, "customer", "c_custkey").where("c_custkey % 10 != 0").select(
        "target_id", F.col("c_custkey").cast("string").alias("legacy_key"))


def _resolved_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = read(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").cast("string").alias("o_custkey"))
    return resolve_lookups(orders, {"o_custkey": "customer"}, {"customer": partial_customer_map(spark, sf_dir)})


def resolve_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _resolved_orders(spark, sf_dir)


LINE_LOOKUPS = {"l_orderkey": "orders", "l_partkey": "part", "l_suppkey": "supplier"}


def resolve_lineitems(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = {"orders": "o_orderkey", "part": "p_partkey", "supplier": "s_suppkey"}
    maps = {
        table: loaded(spark, sf_dir, table, key).select("target_id", F.col(key).cast("string").alias("legacy_key"))
        for table, key in keys.items()}
    rows = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity")
    return resolve_lookups(rows, LINE_LOOKUPS, maps)


def unresolved_report_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return unresolved_report(_resolved_orders(spark, sf_dir), "orders", ["o_custkey"])


def unresolved_report_lineitems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three lookups; every tenth key of each target is missing."""
    keys = {"orders": "o_orderkey", "part": "p_partkey", "supplier": "s_suppkey"}
    maps = {
        table: loaded(spark, sf_dir, table, key).where(F.col(key) % 10 != 0).select(
            "target_id", F.col(key).cast("string").alias("legacy_key"))
        for table, key in keys.items()}
    rows = resolve_lookups(read(spark, sf_dir, "lineitem").select(*LINE_LOOKUPS), LINE_LOOKUPS, maps)
    return unresolved_report(rows, "lineitem", list(LINE_LOOKUPS))


def resolve_event_owner(spark: SparkSession, sf_dir: str) -> DataFrame:
    staged = read(spark, sf_dir, "events").select(
        "event_id", F.col("user_id").cast("string").alias("owner"),
        F.when(F.col("event_type").isin("purchase", "signup"), "Customer").otherwise("supplier").alias("ownertype"))
    maps = {
        table: loaded(spark, sf_dir, table, key).select("target_id", F.col(key).cast("string").alias("legacy_key"))
        for table, key in (("customer", "c_custkey"), ("supplier", "s_suppkey"))}
    return resolve_polymorphic(staged, "owner", maps)


def polymorphic_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events, whose owner is a customer or a supplier, loaded after both."""
    edges = ("nation region", "customer nation", "supplier nation", "events customer", "events supplier")
    plan = _one_plan(spark, edges, ("region", "nation", "customer", "supplier", "events"))
    events = read(spark, sf_dir, "events").select(
        "event_id", F.col("user_id").alias("owner"),
        F.when(F.col("event_type").isin("purchase", "signup"), "Customer").otherwise("supplier").alias("ownertype"))
    loads = {table: _table_load(spark, sf_dir, table) for table in ("region", "nation", "customer", "supplier")}
    loads["events"] = TableLoad(
        events, _columns(["event_id", "owner", "ownertype"]), "event_id",
        lambda rows: rows.withColumn("target_id", target_id("events", "event_id")),
        polymorphic={"owner": ["customer", "supplier"]})
    done = run_plan(spark, plan.tiers, plan.dropped, loads, fleet.new_database(spark))
    return done.loaded["events"].select("event_id", "owner", "ownertype", "owner_id", "owner_status", "target_id")


# Staged columns of the given tables; the key comes first.
LOADS = {
    "region": (["r_regionkey", "r_name"], {}),
    "nation": (["n_nationkey", "n_name", "n_regionkey"], {"n_regionkey": "region"}),
    "customer": (["c_custkey", "c_name", "c_nationkey"], {"c_nationkey": "nation"}),
    "supplier": (["s_suppkey", "s_name", "s_nationkey"], {"s_nationkey": "nation"}),
    "part": (["p_partkey", "p_name"], {}),
    "orders": (["o_orderkey", "o_custkey", "o_orderdate"], {"o_custkey": "customer"}),
    "lineitem": (["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"], LINE_LOOKUPS),
}


def _columns(names: list[str]) -> list[StagedColumn]:
    return [StagedColumn(n, "DATETIME2(7)" if n.endswith("date") else TEXT) for n in names]


def _table_load(spark: SparkSession, sf_dir: str, table: str) -> TableLoad:
    names, lookups = LOADS[table]
    return TableLoad(read(spark, sf_dir, table), _columns(names), names[0],
                     lambda rows: rows.withColumn("target_id", target_id(table, names[0])), lookups)


def _one_plan(spark: SparkSession, edges: tuple[str, ...], names: tuple[str, ...] = TPCH_TABLES) -> LoadTiers:
    tables = spark.sql(f"SELECT 'here' AS org_key, explode(array({', '.join(map(fleet.literal, names))})) AS table")
    pairs = ", ".join(f"struct({fleet.literal(s)} AS src, {fleet.literal(d)} AS dst)"
                      for s, d in (e.split() for e in edges))
    return load_tiers(tables, spark.sql(f"SELECT 'here' AS org_key, inline(array({pairs}))"))


def _long_form(tables: dict[str, DataFrame]) -> DataFrame:
    """One row per (row, lookup) of all loaded tables."""
    out = None
    for table, (names, lookups) in LOADS.items():
        for column in lookups:
            part = tables[table].select(
                F.lit(table).alias("table"), F.col(names[0]).alias("row_key"), F.lit(column).alias("lookup"),
                F.col(column).alias("legacy_key"), F.col(f"{column}_id").alias("resolved_id"),
                F.col(f"{column}_status").alias("status"))
            out = part if out is None else out.unionByName(part)
    return out


def tiered_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = _one_plan(spark, TPCH_EDGES)
    loads = {table: _table_load(spark, sf_dir, table) for table in LOADS}
    return _long_form(run_plan(spark, plan.tiers, plan.dropped, loads, fleet.new_database(spark)).loaded)


def load_twice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Even customers loaded by an earlier run, then all: the second run loads the others only."""
    plan = _one_plan(spark, TPCH_EDGES, ("customer",))
    database = fleet.new_database(spark)
    names, again = LOADS["customer"][0], PlanOptions(staging_drop_recreate=False)

    def load(rows: DataFrame, origin: str) -> TableLoad:
        return TableLoad(rows, _columns(names), names[0],
                         lambda staged: staged.withColumn("target_id", target_id(origin, names[0])))

    customers = read(spark, sf_dir, "customer")
    run_plan(spark, plan.tiers, plan.dropped, {"customer": load(customers.where("c_custkey % 2 = 0"), "earlier")}, database)
    done = run_plan(spark, plan.tiers, plan.dropped, {"customer": load(customers, "customer")}, database, again)
    ids = done.loaded["customer"].select(F.lit("loaded").alias("kind"), F.col(names[0]).alias("legacy_key"), "target_id")
    return ids.unionByName(done.key_maps["customer"].select(F.lit("map").alias("kind"), "legacy_key", "target_id"))


def load_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts loaded under their names, which some share."""
    plan = _one_plan(spark, TPCH_EDGES, ("part",))
    job = TableLoad(read(spark, sf_dir, "part"), _columns(["p_partkey", "p_name"]), "p_name",
                    lambda rows: rows.withColumn("target_id", target_id("part", "p_partkey")))
    return run_plan(spark, plan.tiers, plan.dropped, {"part": job}, fleet.new_database(spark)).conflicts["part"]


def with_first_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers with a lookup to their first order, which closes a cycle."""
    first = read(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(
        F.min(F.struct("o_orderdate", "o_orderkey")).alias("_first"))
    return read(spark, sf_dir, "customer").join(first, "c_custkey", "left").select(
        "c_custkey", "c_name", "c_nationkey", F.col("_first.o_orderkey").alias("first_order"))


def deferred_update_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = _one_plan(spark, (*TPCH_EDGES, "customer orders"))
    loads = {table: _table_load(spark, sf_dir, table) for table in LOADS}
    names = ["c_custkey", "c_name", "c_nationkey", "first_order"]
    loads["customer"] = TableLoad(
        with_first_order(spark, sf_dir), _columns(names), "c_custkey",
        lambda rows: rows.withColumn("target_id", target_id("customer", "c_custkey")),
        {"c_nationkey": "nation", "first_order": "orders"})
    done = run_plan(spark, plan.tiers, plan.dropped, loads, fleet.new_database(spark)).loaded
    orders = done["orders"].select(F.lit("orders").alias("table"), F.col("o_orderkey").alias("row_key"),
                                   F.col("o_custkey_id").alias("resolved_id"), F.col("o_custkey_status").alias("status"))
    return orders.unionByName(done["customer"].select(
        F.lit("customer").alias("table"), F.col("c_custkey").alias("row_key"),
        F.col("first_order_id").alias("resolved_id"), F.col("first_order_status").alias("status")))


def ringed_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order refers to the customer's one before, six in a chain; chains of every tenth customer close to rings."""
    orders = read(spark, sf_dir, "orders").select("o_custkey", "o_orderdate", "o_orderkey")
    numbered = number_rows(orders, ["o_custkey"], ["o_orderdate", "o_orderkey"], "pos")
    chain = numbered.withColumn("chain", F.floor((F.col("pos") - 1) / 6)).drop("pos")
    chained = previous_in_group(chain, ["o_custkey", "chain"], ["o_orderdate", "o_orderkey"], "o_orderkey", "parent")
    last = chain.groupBy("o_custkey", "chain").agg(F.max(F.struct("o_orderdate", "o_orderkey"))["o_orderkey"].alias("last"))
    return chained.join(last, ["o_custkey", "chain"]).select(
        "o_orderkey", F.coalesce("parent", F.when(F.col("o_custkey") % 10 == 0, F.col("last"))).alias("parent"))


def wave_load_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders loaded in waves along the orders they refer to; ``first_id`` is what the target was given."""
    plan = _one_plan(spark, TPCH_EDGES, ("orders",))
    job = TableLoad(ringed_chains(spark, sf_dir), _columns(["o_orderkey", "parent"]), "o_orderkey",
                    lambda rows: rows.withColumns({"target_id": target_id("orders", "o_orderkey"), "first_id": F.col("parent_id")}),
                    {"parent": "orders"})
    done = run_plan(spark, plan.tiers, plan.dropped, {"orders": job}, fleet.new_database(spark))
    return done.loaded["orders"].select("o_orderkey", "parent", "first_id", "parent_id", "parent_status", "target_id")


class Ended(RuntimeError):
    """A run that is ended on purpose."""


def load_resumed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers and orders, every seventh without a key, loaded by a run that ends before orders, goes on, and is followed
    by another: how often the target was given each row.
    """
    plan = _one_plan(spark, TPCH_EDGES, ("customer", "orders"))
    database, received = fleet.new_database(spark), new_path(spark, "received")
    ended = [True]

    def load(table: str, key: str, other: str):
        def send(rows: DataFrame) -> DataFrame:
            if table == "orders" and ended[0]:
                raise Ended(table)
            named = rows.withColumn("target_id", F.when(F.col(key).isNull(), F.md5("source_row")).otherwise(target_id(table, key)))
            path = f"{received}/table={table}/{uuid4().hex}"
            named.select("target_id", F.col(key).alias("legacy_key"), F.col(other).alias("other")).write.parquet(path)
            return named
        return send

    loads = {}
    for table, key, other in (("customer", "c_custkey", "c_name"), ("orders", "o_orderkey", "o_custkey")):
        rows = read(spark, sf_dir, table)
        keyless = rows.withColumn(key, F.when(F.col(key) % 7 != 0, F.col(key)))
        loads[table] = TableLoad(keyless, _columns([key, other]), key, load(table, key, other),
                                 {other: "customer"} if table == "orders" else {})
    with suppress(Ended):
        run_plan(spark, plan.tiers, plan.dropped, loads, database, run_id="first")
    ended[0] = False
    run_plan(spark, plan.tiers, plan.dropped, loads, database, run_id="first")
    run_plan(spark, plan.tiers, plan.dropped, loads, database, run_id="second")
    return spark.read.parquet(f"{received}/*/*").groupBy("legacy_key", "other").agg(
        F.count(F.lit(1)).alias("n_loads"), F.count_distinct("target_id").alias("n_ids"))


def key_map_incremental(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A map of most customers, then keys of one bucket in eight: which rows lie in a file that was there before."""
    name = f"{fleet.new_database(spark)}.guid_customer"
    entries = loaded(spark, sf_dir, "customer", "c_custkey").select(
        "target_id", F.col("c_custkey").cast("string").alias("legacy_key"))
    few = (F.col("legacy_key").cast("long") % 100 == 7) & (F.pmod(F.hash("legacy_key"), F.lit(32)) % 8 == 0)
    first = accumulate_key_map(entries.where(~few), name, 32)
    old, _ = cut(first.select(F.col("_metadata.file_name").alias("file")).distinct(), "old-files")
    merged = accumulate_key_map(entries.where(few), name)
    # one row for each file
    return merged.select("*", F.col("_metadata.file_name").alias("file")).join(
        F.broadcast(old.withColumn("is_old", F.lit(True))), "file", "left").select(
        "target_id", "legacy_key", F.when(few, F.col("is_old").isNull()).otherwise(F.col("is_old")).alias("as_expected"))


def deferred_over_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders and even customers in one run, the other customers in the next: every link is filled then."""
    plan = _one_plan(spark, TPCH_EDGES, ("customer", "orders"))
    database = fleet.new_database(spark)
    customers, orders = read(spark, sf_dir, "customer"), _table_load(spark, sf_dir, "orders")
    first = replace(_table_load(spark, sf_dir, "customer"), source=customers.where("c_custkey % 2 = 0"))
    run_plan(spark, plan.tiers, plan.dropped, {"customer": first, "orders": orders}, database)
    second = replace(first, source=customers.where("c_custkey % 2 = 1"))
    none = replace(orders, source=orders.source.where("false"))
    run_plan(spark, plan.tiers, plan.dropped, {"customer": second, "orders": none}, database)
    return spark.table(f"{database}.loaded_orders").select(
        "o_orderkey", "o_custkey", "o_custkey_id", "o_custkey_status")


def catalog_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From the documents of a shop in every region to loaded rows of the one in ASIA, its outputs and the dictionary."""
    options = PlanOptions(match_key_suffixes=fleet.SHOP_KEYS, staging=False, truncate=True, dictionary=True)
    catalog = flatten_snapshot(read_snapshot(spark, fleet.shop_documents(spark, sf_dir)))
    plan = plan_migration(catalog, options=options)
    out = new_path(spark, "outputs")
    written = write_outputs(plan, out, options)
    first = with_first_order(spark, sf_dir).withColumnRenamed("first_order", "c_first")
    chained = previous_in_group(read(spark, sf_dir, "orders").select("o_custkey", "o_orderdate", "o_orderkey"),
                                ["o_custkey"], ["o_orderdate", "o_orderkey"], "o_orderkey", "o_before")
    events = read(spark, sf_dir, "events").select("event_id", "ts", F.col("user_id").alias("owner"), F.when(
        F.col("event_type").isin("purchase", "signup"), "Customer").otherwise("supplier").alias("ownertype"))
    sources = {t: read(spark, sf_dir, t) for t in ("region", "nation", "supplier")} | {
        "customer": first, "orders": chained, "events": events}
    loads = table_loads(plan, "ASIA", sources, lambda table, key: lambda rows: rows.withColumn("target_id", target_id(table, key)),
                        options)
    done = run_migration(spark, plan, "ASIA", loads, fleet.new_database(spark), options)
    parts = [
        done.loaded[table].select(F.lit(table).alias("name"), F.col(job.match_key).alias("row_key"), F.lit(column).alias("item"),
                                  F.col(f"{column}_id").alias("value"), F.col(f"{column}_status").alias("status"))
        for table, job in loads.items() for column in (*job.lookups, *job.polymorphic)]
    listed = spark.read.option("header", True).csv(f"{out}/dictionary/columns")
    parts.append(listed.select(F.col("table").alias("name"), F.col("org_key").alias("row_key"), F.col("name").alias("item"),
                               F.col("sql_type").alias("value"), F.col("lookup_target").alias("status")))
    parts.append(spark.sql(f"SELECT explode(array({', '.join(map(fleet.literal, written))})) AS name").select(
        "name", *(F.lit(None).cast("string").alias(c) for c in ("row_key", "item", "value", "status"))))
    return reduce(DataFrame.unionByName, parts)


def deferred_update_keeps_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of even customers were resolved before, under ids of an earlier run."""
    loaded_orders = read(spark, sf_dir, "orders").select(
        "o_orderkey", F.col("o_custkey").cast("string").alias("o_custkey"),
        F.when(F.col("o_custkey") % 2 == 0, target_id("earlier", "o_custkey")).alias("o_custkey_id"))
    return deferred_update(loaded_orders, {"o_custkey": "customer"}, {"customer": partial_customer_map(spark, sf_dir)})


def reset_keeps_key_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = _one_plan(spark, TPCH_EDGES)
    loads = {table: _table_load(spark, sf_dir, table) for table in LOADS}
    done = run_plan(spark, plan.tiers, plan.dropped, loads, fleet.new_database(spark))
    order = load_order(load_batches(plan.tiers)).select("table", "reverse_no").collect()
    reset_staging(spark, [done.staging[r["table"]] for r in sorted(order, key=lambda r: r["reverse_no"])])
    out = None
    for table, name in done.staging.items():
        for kind, df in (("staging", spark.table(name)), ("key_map", done.key_maps[table])):
            counted = df.agg(F.count(F.lit(1)).alias("n_rows")).select(
                F.lit(table).alias("table"), F.lit(kind).alias("kind"), "n_rows")
            out = counted if out is None else out.unionByName(counted)
    return out


def clustered_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    database = fleet.new_database(spark)
    orders = read(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").cast("string").alias("o_custkey"))
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    facts = cluster_by_match_key(orders, "o_custkey", f"{database}.stage_orders", buckets)
    entries = cluster_by_match_key(partial_customer_map(spark, sf_dir), "legacy_key", f"{database}.guid_customer",
                                   buckets, facts.hot)
    return clustered_lookup(facts, entries, spark).select(
        "o_orderkey", "o_custkey", F.col("target_id").alias("o_custkey_id"),
        F.when(F.col("target_id").isNull(), "unresolved").otherwise("resolved").alias("o_custkey_status"))


def _chained_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = read(spark, sf_dir, "orders").select("o_custkey", "o_orderdate", "o_orderkey")
    return previous_in_group(orders, ["o_custkey"], ["o_orderdate", "o_orderkey"], "o_orderkey", "parent")


def row_waves_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return row_waves(_chained_orders(spark, sf_dir), "o_orderkey", "parent").waves


def row_waves_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = read(spark, sf_dir, "conversations").select(
        F.concat_ws("/", "conv_id", "turn").alias("id"),
        F.concat_ws("/", "conv_id", F.col("turn") - 1).alias("parent"))
    return row_waves(turns, "id", "parent").waves


def ringed_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order keys in rings of five, each row's parent the next key of its ring."""
    key = F.col("o_orderkey")
    return read(spark, sf_dir, "orders").select(
        "o_orderkey", F.when(key % 5 == 4, key - 4).otherwise(key + 1).alias("parent"))


def row_waves_cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return row_waves(ringed_orders(spark, sf_dir), "o_orderkey", "parent").waves


def row_waves_dropped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return row_waves(ringed_orders(spark, sf_dir), "o_orderkey", "parent").dropped


def staged_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    dictionary = spark.createDataFrame(ORDER_COLUMNS, "name string, sql_type string")
    return profile_staged(stage_orders(spark, sf_dir), dictionary)


def profile_of_loads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders staged by three loads, profiled from the stored sketches of each; distinct values within 5 % of those counted."""
    name = f"{fleet.new_database(spark)}.profiles"
    staged = stage_orders(spark, sf_dir)
    for i in range(3):
        add_parts(column_sketches(staged.where(F.col("o_orderkey").cast("long") % 3 == i)), name, f"load{i}")
    found = combine_profiles(spark.table(name)).select("name", "n_rows", "n_null", "n_distinct", "max_length")
    exact = staged_profile(spark, sf_dir).select("name", F.col("n_distinct").alias("exact"))
    # one row for each column on either side
    return found.join(exact, "name").select(
        "name", "n_rows", "n_null", "max_length",
        (F.abs(F.col("n_distinct") - F.col("exact")) <= 0.05 * F.col("exact")).alias("close"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with the id of their customer, and the tier in which the plan loads them."""
    plan = load_batches(_one_plan(spark, TPCH_EDGES).tiers)
    customers = loaded(spark, sf_dir, "customer", "c_custkey")
    maps = {"customer": key_map_entries(customers, "target_id", "c_custkey")}
    rows = resolve_lookups(stage_orders(spark, sf_dir), {"O_CustKey": "customer"}, maps)
    place = plan.select(F.col("table"), "tier", "file_no")
    marked = rows.select("o_orderkey", "O_CustKey_id", "O_CustKey_status", F.lit("orders").alias("table"))
    return lookup_join(marked, place, ["table"], right_rows=len(TPCH_TABLES))


QUERIES: dict[str, Query] = {
    "flatten_entities": flatten_entities,
    "flatten_attributes": flatten_attributes,
    "flatten_targets": flatten_targets,
    "tables_in_scope": tables_in_scope,
    "table_categories": table_categories,
    "category_counts": category_counts,
    "visible_solutions": visible_solutions,
    "chosen_solutions": chosen_solutions,
    "solution_membership": solution_membership,
    "find_tables": find_tables,
    "find_checked_tables": find_checked_tables,
    "effective_selection": effective_selection,
    "attributes_in_scope": attributes_in_scope,
    "map_types": map_types,
    "untyped_attributes": untyped_attributes,
    "companions": companions,
    "staging_layout": staging_layout,
    "match_keys": match_keys,
    "key_map_layout": key_map_layout,
    "layout_conflicts": layout_conflicts,
    "dictionary_columns": dictionary_columns_query,
    "dictionary_tables": dictionary_tables_query,
    "dictionary_index": dictionary_index_query,
    "dependency_edges": dependency_edges_query,
    "excluded_edges": excluded_edges,
    "load_tiers": load_tiers_query,
    "dropped_edges": dropped_edges,
    "cycle_warnings": cycle_warnings_query,
    "load_tiers_acyclic": load_tiers_acyclic,
    "load_tiers_order_graphs": load_tiers_order_graphs,
    "dropped_edges_order_graphs": dropped_edges_order_graphs,
    "load_batches": load_batches_query,
    "load_order": load_order_query,
    "diagram_edges": diagram_edges,
    "plan_summary": plan_summary_query,
    "staging_scripts": staging_scripts,
    "key_map_scripts": key_map_scripts,
    "truncate_script": truncate_script,
    "teardown_script": teardown_script,
    "diagram_script": diagram_script,
    "stage_orders": stage_orders,
    "stage_rejects": stage_rejects,
    "stage_rejects_lossy": stage_rejects_lossy,
    "stage_clean": stage_clean,
    "staging_modes": staging_modes,
    "key_map": key_map,
    "key_map_shared_keys": key_map_shared_keys,
    "key_map_conflicts": key_map_conflicts,
    "key_map_merge": key_map_merge,
    "key_map_rebuild": key_map_rebuild,
    "key_map_versions": key_map_versions,
    "resolve_orders": resolve_orders,
    "resolve_lineitems": resolve_lineitems,
    "resolve_event_owner": resolve_event_owner,
    "unresolved_report": unresolved_report_query,
    "unresolved_report_lineitems": unresolved_report_lineitems,
    "tiered_load": tiered_load,
    "load_twice": load_twice,
    "load_conflicts": load_conflicts,
    "polymorphic_load": polymorphic_load,
    "deferred_update": deferred_update_query,
    "deferred_update_keeps_ids": deferred_update_keeps_ids,
    "deferred_over_runs": deferred_over_runs,
    "wave_load_orders": wave_load_orders,
    "load_resumed": load_resumed,
    "key_map_incremental": key_map_incremental,
    "catalog_load": catalog_load,
    "reset_keeps_key_maps": reset_keeps_key_maps,
    "clustered_resolve": clustered_resolve,
    "row_waves_orders": row_waves_orders,
    "row_waves_turns": row_waves_turns,
    "row_waves_cycles": row_waves_cycles,
    "row_waves_dropped": row_waves_dropped,
    "staged_profile": staged_profile,
    "profile_of_loads": profile_of_loads,
    "replan_changed": replan_changed,
}
