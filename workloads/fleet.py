"""Catalogs of whole fleets of environments, derived from the given tables.

Every customer is an environment with the tables and lookups of a small CRM, one edge
less each; every supplier one with a table that has an attribute for each mapping rule;
every customer's orders make up the lookups of one more environment.
"""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loadwright.operators.scope import Membership
from loadwright.sources.scratch import new_path

# CRM tables as (logical name, display name, is link table).
CRM_TABLES = (
    ("account", "Account", False), ("contact", "", False), ("lead", "Lead", None),
    ("opportunity", "Opportunity", False), ("x_case", "Case", False), ("x_order", "Order", False),
    ("x_region", "Region", None), ("x_site", "Site", False), ("X_survey", "Survey", False),
    ("_local", "Local", False), ("accountleads", "Account leads", True),
)

# The tables a plan is made for.
CRM_PLANNED = ("account", "contact", "lead", "opportunity", "x_case", "x_order", "x_region", "x_site")

# Lookups as (table, column, target, number of the edge; None for a self reference).
CRM_LOOKUPS = (
    ("account", "primarycontactid", "contact", 0),
    ("contact", "parentcustomerid", "account", 1),
    ("contact", "parentcustomerid", "contact", None),
    ("lead", "parentaccountid", "account", 2),
    ("lead", "parentcontactid", "contact", 3),
    ("opportunity", "customerid", "account", 4),
    ("opportunity", "customerid", "contact", 5),
    ("opportunity", "originatingleadid", "lead", 6),
    ("x_order", "x_opportunityid", "opportunity", 7),
    ("x_case", "customerid", "account", 8),
    ("x_case", "customerid", "contact", 9),
    ("x_case", "x_orderid", "x_order", 10),
    ("x_site", "x_regionid", "x_region", 11),
    ("lead", "qualifyingopportunityid", "opportunity", 12),
    ("account", "parentaccountid", "account", None),
)

# Tiers per variant (one removed edge each), tables as in CRM_PLANNED, and the dropped edges.
CRM_TIERS = (
    ((0, 1, 3, 2, 4, 3, 0, 1), ("opportunity lead",)),
    ((1, 0, 3, 2, 4, 3, 0, 1), ("opportunity lead",)),
    ((1, 0, 3, 2, 4, 3, 0, 1), ("contact account", "opportunity lead")),
    ((0, 1, 3, 2, 4, 3, 0, 1), ("account contact", "opportunity lead")),
    ((1, 0, 2, 1, 3, 2, 0, 1), ("contact account", "opportunity lead")),
    ((0, 1, 2, 1, 3, 2, 0, 1), ("account contact", "opportunity lead")),
    ((0, 1, 3, 2, 4, 3, 0, 1), ("account contact",)),
    ((0, 1, 2, 3, 2, 0, 0, 1), ("account contact", "lead opportunity")),
    ((1, 0, 3, 2, 4, 3, 0, 1), ("contact account", "opportunity lead")),
    ((0, 1, 3, 2, 4, 3, 0, 1), ("account contact", "opportunity lead")),
    ((0, 1, 3, 2, 2, 3, 0, 1), ("account contact", "opportunity lead")),
    ((0, 1, 3, 2, 4, 3, 0, 0), ("account contact", "opportunity lead")),
    ((0, 1, 2, 3, 5, 4, 0, 1), ("account contact",)),
)

# Attributes of x_case as (name, type, max length, date format, multi-select, targets, attribute of).
CASE_ATTRIBUTES = (
    ("x_caseid", "Uniqueidentifier", None, None, None, None, None),
    ("x_title", "String", 200, None, None, None, None),
    ("x_code", "String", None, None, None, None, None),
    ("x_edge", "String", 4000, None, None, None, None),
    ("x_body", "String", 4001, None, None, None, None),
    ("x_zero", "String", 0, None, None, None, None),
    ("x_legacyid", "String", 50, None, None, None, None),
    ("x_notes", "Memo", 2000, None, None, None, None),
    ("x_plain", "Memo", None, None, None, None, None),
    ("x_count", "Integer", None, None, None, None, None),
    ("x_big", "BigInt", None, None, None, None, None),
    ("x_flag", "Boolean", None, None, None, None, None),
    ("x_rate", "Decimal", None, None, None, None, None),
    ("x_ratio", "Double", None, None, None, None, None),
    ("x_kind", "Picklist", None, None, None, None, None),
    ("x_fee", "Money", None, None, None, None, None),
    ("x_fee_base", "Money", None, None, None, None, None),
    ("x_data_base", "String", 10, None, None, None, None),
    ("x_due", "DateTime", None, "DateOnly", None, None, None),
    ("x_at", "DateTime", None, "DateAndTime", None, None, None),
    ("x_when", "DateTime", None, None, None, None, None),
    ("x_orderid", "Lookup", None, None, None, ("x_order",), None),
    ("customerid", "Customer", None, None, None, ("account", "contact"), None),
    ("x_loose", "Lookup", None, None, None, (), None),
    ("x_parentid", "Lookup", None, None, None, ("x_case",), None),
    ("x_ownerid", "Owner", None, None, None, ("systemuser", "team"), None),
    ("x_regarding", "Lookup", None, None, None,
     ("account", "contact", "lead", "opportunity", "x_order", "x_region", "x_site"), None),
    ("x_tags", "Virtual", None, None, True, None, None),
    ("x_virtual", "Virtual", None, None, False, None, None),
    ("x_kindname", "String", None, None, None, None, "x_kind"),
    ("address1_addressid", "Uniqueidentifier", None, None, None, None, None),
    ("createdon", "DateTime", None, None, None, None, None),
    ("ownerid", "Owner", None, None, None, ("systemuser",), None),
    ("STATUSCODE", "Status", None, None, None, None, None),
    ("x_party", "PartyList", None, None, None, None, None),
    ("x_entity", "EntityName", None, None, None, None, None),
    ("x_image", "Image", None, None, None, None, None),
    ("x_file", "File", None, None, None, None, None),
    ("x_null", None, None, None, None, None, None),
)

# Solutions as (unique name, friendly name, managed, visible, parent).
SOLUTIONS = (
    ("Default", "Default Solution", False, True, None),
    ("zeta", "Alpha", True, True, None),
    ("beta", "beta", False, True, None),
    ("gamma", "", False, True, None),
    ("patch1", "Patch", False, True, "zeta"),
    ("hidden", "Hidden", False, False, None),
)

# Components as (solution, object, component type, number of the copy).
COMPONENTS = (
    ("zeta", "x_case", 1, 1), ("zeta", "x_case", 1, 2), ("zeta", "x_legacyid", 2, None),
    ("zeta", "customerid", 2, None), ("zeta", "x_fee", 2, None), ("zeta", "x_form", 60, None),
    ("zeta", "x_odd", None, None), ("beta", "x_count", 2, None),
)

# Table names of the order graphs; upper- and lower-casing sort them differently.
GRAPH_NAMES = ("b_x", "bx", "Ba", "c", "c_1", "cz", "d")


# Tables of a shop as (logical name, attributes), these as (name, type, targets).
SHOP_TABLES = (
    ("region", (("r_regionkey", "String", None), ("r_name", "String", None))),
    ("nation", (("n_nationkey", "String", None), ("n_name", "String", None), ("n_regionkey", "Lookup", ("region",)))),
    ("customer", (("c_custkey", "String", None), ("c_name", "String", None), ("c_nationkey", "Lookup", ("nation",)),
                  ("c_first", "Lookup", ("orders",)))),
    ("supplier", (("s_suppkey", "String", None), ("s_nationkey", "Lookup", ("nation",)))),
    ("orders", (("o_orderkey", "String", None), ("o_custkey", "Lookup", ("customer",)), ("o_orderdate", "DateTime", None),
                ("o_before", "Lookup", ("orders",)))),
    ("events", (("event_id", "String", None), ("owner", "Customer", ("customer", "supplier")),
                ("ts", "DateTime", None))),
)
SHOP_KEYS = "r_regionkey, n_nationkey, c_custkey, s_suppkey, o_orderkey, event_id"


def literal(value) -> str:
    """A value as a literal both SQL dialects read."""
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return str(value).lower()
    if isinstance(value, int):
        return str(value)
    return "'" + value.replace("'", "''") + "'"


def _structs(rows, fields: str) -> str:
    """Rows as an array-of-structs literal with the given field types."""
    def item(v):
        return f"array({', '.join(map(literal, v))})" if isinstance(v, tuple) else literal(v)

    items = ", ".join(f"struct({', '.join(map(item, row))})" for row in rows)
    return f"CAST(array({items}) AS ARRAY<STRUCT<{fields}>>)"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "customer").select(
        F.col("c_custkey").cast("string").alias("org_key"), F.col("c_custkey").alias("key"))


def suppliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").cast("string").alias("org_key"), F.col("s_suppkey").alias("key"))


def crm_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The CRM tables of every customer's environment."""
    rows = customers(spark, sf_dir).select(
        "org_key", F.expr(f"inline({_structs(CRM_TABLES, 'logical_name: STRING, display: STRING, link: BOOLEAN')})"))
    return rows.select(
        "org_key", F.concat_ws("|", "org_key", "logical_name").alias("entity_id"), "logical_name",
        F.initcap("logical_name").alias("schema_name"),
        F.coalesce(F.nullif("display", F.lit("")), F.col("logical_name")).alias("display_name"),
        F.concat("logical_name", F.lit("id")).alias("primary_id"), F.lit("name").alias("primary_name"),
        F.col("link").alias("is_intersect"))


def crm_planned(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ", ".join(map(literal, CRM_PLANNED))
    return customers(spark, sf_dir).select("org_key", F.expr(f"explode(array({names}))").alias("table"))


def crm_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lookup columns of every customer's environment, without the edge of its variant."""
    fields = "table: STRING, name: STRING, target: STRING, edge: INT"
    lookups = customers(spark, sf_dir).select("org_key", "key", F.expr(f"inline({_structs(CRM_LOOKUPS, fields)})"))
    left = lookups.where(F.col("edge").isNull() | (F.col("edge") != F.col("key") % len(CRM_TIERS)))
    return left.select("org_key", "table", "name", F.lit(True).alias("is_lookup"), F.array("target").alias("targets"))


def case_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One document per supplier: the table ``x_case`` with an attribute for each rule."""
    fields = ("logical_name: STRING, attr_type: STRING, max_length: INT, date_format: STRING, "
              "is_multi_select: BOOLEAN, targets: ARRAY<STRING>, attribute_of: STRING")
    varying = "struct('x_vary' AS logical_name, 'String' AS attr_type, CAST(key * 45 AS INT) AS max_length, " \
              "CAST(NULL AS STRING) AS date_format, CAST(NULL AS BOOLEAN) AS is_multi_select, " \
              "CAST(NULL AS ARRAY<STRING>) AS targets, CAST(NULL AS STRING) AS attribute_of)"
    attributes = F.expr(f"""transform(array_append({_structs(CASE_ATTRIBUTES, fields)}, {varying}), a -> struct(
        concat_ws('|', org_key, a.logical_name) AS attribute_id, a.logical_name, a.attr_type, a.attribute_of,
        a.max_length, a.date_format, a.is_multi_select, a.targets,
        CASE WHEN a.logical_name IN ('x_zero', 'x_notes') THEN '' ELSE concat('Label ', a.logical_name) END
            AS display_name,
        CASE WHEN a.logical_name = 'x_title' THEN 'about the title' END AS description,
        startswith(a.logical_name, 'x_') AS is_custom))""")
    return suppliers(spark, sf_dir).select(
        "org_key", F.concat_ws("|", "org_key", F.lit("x_case")).alias("entity_id"),
        F.lit("x_case").alias("logical_name"), F.lit("x_Case").alias("schema_name"),
        F.when(F.col("key") % 2 == 0, "Case").otherwise("").alias("display_name"), F.lit("Cases").alias("plural_name"),
        F.lit(None).cast("string").alias("description"), F.lit("x_caseid").alias("primary_id"),
        F.lit("x_title").alias("primary_name"), F.lit(10042).alias("object_type_code"),
        F.lit(True).alias("is_custom"), F.lit(False).alias("is_intersect"), F.lit("UserOwned").alias("ownership"),
        F.lit("1.0").alias("introduced_version"), attributes.alias("attributes"))


def shop_documents(spark: SparkSession, sf_dir: str) -> str:
    """The catalog of a shop in every region, exported as JSON lines; returns where it lies."""
    fields = ("logical_name: STRING, attrs: ARRAY<STRUCT<logical_name: STRING, attr_type: STRING, targets: ARRAY<STRING>>>")

    def attribute(name, kind, targets):
        listed = "NULL" if targets is None else f"array({', '.join(map(literal, targets))})"
        return f"struct({literal(name)}, {literal(kind)}, {listed})"

    tables = ", ".join(
        f"struct({literal(t)}, array({', '.join(attribute(*a) for a in attrs)}))" for t, attrs in SHOP_TABLES)
    rows = read(spark, sf_dir, "region").select(
        F.trim("r_name").alias("org_key"), F.expr(f"inline(CAST(array({tables}) AS ARRAY<STRUCT<{fields}>>))"))
    attributes = F.expr("""transform(attrs, a -> struct(concat_ws('|', org_key, logical_name, a.logical_name) AS attribute_id,
        a.logical_name, a.attr_type, 100 AS max_length, a.targets, a.logical_name AS display_name, true AS is_custom))""")
    path = new_path(spark, "shops")
    rows.select(
        "org_key", F.concat_ws("|", "org_key", "logical_name").alias("entity_id"), "logical_name",
        F.initcap("logical_name").alias("schema_name"), F.col("logical_name").alias("display_name"),
        F.concat("logical_name", F.lit("id")).alias("primary_id"), F.lit("name").alias("primary_name"),
        F.lit(False).alias("is_intersect"), attributes.alias("attributes")).write.json(path)
    return path


def case_documents(spark: SparkSession, sf_dir: str) -> str:
    """The snapshot exported as JSON lines; returns where it lies."""
    path = new_path(spark, "snapshot")
    case_snapshot(spark, sf_dir).write.json(path)
    return path


def solutions(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields = "unique_name: STRING, friendly_name: STRING, is_managed: BOOLEAN, is_visible: BOOLEAN, parent: STRING"
    return suppliers(spark, sf_dir).select(
        "org_key", F.expr(f"inline({_structs(SOLUTIONS, fields)})")).select(
        "org_key", F.concat_ws("|", "org_key", "unique_name").alias("solution_id"), "unique_name", "friendly_name",
        "is_managed", "is_visible", F.col("parent").alias("parent_solution_id"))


def components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of solution ``zeta`` (and one of ``beta``) in every supplier's environment.

    By ``key % 4``: 0 the table whole (unknown behavior), 1 and 2 only listed attributes,
    3 listed attributes without the table.
    """
    rows = suppliers(spark, sf_dir).select("org_key", "key", F.expr(
        f"inline({_structs(COMPONENTS, 'solution: STRING, object: STRING, type: INT, copy: INT')})")).withColumn(
        "behavior", F.expr("CASE WHEN type = 1 AND key % 4 IN (1, 2) THEN if(key % 4 = copy, 1, 2) END"))
    return rows.where("NOT (type <=> 1 AND key % 4 = 3)").select(
        "org_key", F.concat_ws("|", "org_key", "solution").alias("solution_id"),
        F.concat_ws("|", "org_key", "object").alias("object_id"), F.col("type").alias("component_type"),
        F.col("behavior").cast("int").alias("root_behavior"))


def chosen_solutions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two of three suppliers' environments use solution ``zeta``, the others all tables."""
    return suppliers(spark, sf_dir).where("key % 3 != 0").select(
        "org_key", F.concat_ws("|", "org_key", F.lit("zeta")).alias("solution_id"))


def crm_membership(spark: SparkSession, sf_dir: str) -> Membership:
    """Every second customer's environment is restricted, to tables by its key."""
    names = ", ".join(literal(name) for name, _, _ in CRM_TABLES)
    orgs = customers(spark, sf_dir).where("key % 2 = 0")
    tables = orgs.select("org_key", "key", F.expr(f"posexplode(array({names}))").alias("pos", "name")).where(
        "(key + pos) % 3 != 0")
    entities = tables.select("org_key", F.concat_ws("|", "org_key", "name").alias("entity_id"),
                             F.lit(1).alias("behavior"))
    return Membership(orgs.select("org_key"), entities,
                      entities.select("org_key", F.col("entity_id").alias("attribute_id")).where("false"))


def crm_selections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By ``key % 5``: 0 no entry, 1 an empty entry, else some tables, one of them unknown."""
    picked = ("account", "LEAD", "x_case", "x_survey", "nowhere")
    names = ", ".join(map(literal, picked))
    return customers(spark, sf_dir).select("org_key", "key", F.expr(
        f"explode(CASE key % 5 WHEN 0 THEN array() WHEN 1 THEN array(CAST(NULL AS STRING)) "
        f"ELSE slice(array({names}), 1, CAST(key % 5 + 1 AS INT)) END)").alias("table")).select("org_key", "table")


def order_graphs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Tables and edges of one environment per customer with orders; edges by order key and day."""
    names = F.array(*map(F.lit, GRAPH_NAMES))
    n = len(GRAPH_NAMES)
    orders = read(spark, sf_dir, "orders")
    edges = orders.select(
        F.col("o_custkey").cast("string").alias("org_key"),
        F.get(names, (F.col("o_orderkey") % n).cast("int")).alias("src"),
        F.get(names, F.dayofmonth("o_orderdate") % n).alias("dst"))
    tables = orders.select(F.col("o_custkey").cast("string").alias("org_key")).distinct().select(
        "org_key", F.explode(names).alias("table"))
    return tables, edges


def new_database(spark: SparkSession) -> str:
    """An empty database whose tables lie in the shared folder."""
    name = f"lw_{uuid4().hex[:12]}"
    spark.sql(f"CREATE DATABASE {name} LOCATION '{new_path(spark, name)}'")
    return name


