"""Schemas of the catalog tables, as DDL."""

ATTRIBUTE_FIELDS = (
    "attribute_id STRING, logical_name STRING, attr_type STRING, attribute_of STRING, max_length INT, "
    "date_format STRING, is_multi_select BOOLEAN, targets ARRAY<STRING>, display_name STRING, "
    "description STRING, is_custom BOOLEAN"
)

ENTITIES = (
    "org_key STRING, entity_id STRING, logical_name STRING, schema_name STRING, display_name STRING, "
    "plural_name STRING, description STRING, primary_id STRING, primary_name STRING, object_type_code INT, "
    "is_custom BOOLEAN, is_intersect BOOLEAN, ownership STRING, introduced_version STRING"
)

SNAPSHOT = f"{ENTITIES}, attributes ARRAY<STRUCT<{ATTRIBUTE_FIELDS}>>"

ATTRIBUTES = f"org_key STRING, table STRING, {ATTRIBUTE_FIELDS}"

SOLUTIONS = (
    "org_key STRING, solution_id STRING, unique_name STRING, friendly_name STRING, "
    "is_managed BOOLEAN, is_visible BOOLEAN, parent_solution_id STRING"
)

SOLUTION_COMPONENTS = (
    "org_key STRING, solution_id STRING, object_id STRING, component_type INT, root_behavior INT"
)

SELECTIONS = "org_key STRING, table STRING"
