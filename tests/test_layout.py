"""One attribute per rule, scope under a solution, layouts and their conflicts."""

import pytest
from pyspark.sql import functions as F

from loadwright import schemas
from loadwright.functions.lists import excluded_columns, match_key_suffixes
from loadwright.functions.types import spark_type, text_limit
from loadwright.operators import layout as lay
from loadwright.operators import scope
from loadwright.operators.graph import dependency_edges

ENTITY = [("o", "e1", "x_case", "x_Case", "Case", "", "", "x_caseid", "x_title", 1, True, False, "", "")]


def attribute(name, kind, max_length=None, date_format=None, multi=None, targets=None, of=None, table="x_case"):
    return ("o", table, f"id-{name}", name, kind, of, max_length, date_format, multi, targets, name.upper(), "", False)


ATTRIBUTES = [
    attribute("x_caseid", "Uniqueidentifier"), attribute("x_title", "String", 200), attribute("x_code", "String"),
    attribute("x_edge", "String", 4000), attribute("x_body", "String", 4001), attribute("x_zero", "String", 0),
    attribute("x_legacyid", "String", 50), attribute("x_notes", "Memo", 2000), attribute("x_count", "Integer"),
    attribute("x_big", "BigInt"), attribute("x_flag", "Boolean"), attribute("x_rate", "Decimal"),
    attribute("x_ratio", "Double"), attribute("x_kind", "Picklist"), attribute("x_fee", "Money"),
    attribute("x_fee_base", "Money"), attribute("x_data_base", "String", 10),
    attribute("x_due", "DateTime", None, "DateOnly"), attribute("x_at", "DateTime", None, "DateAndTime"),
    attribute("x_when", "DateTime"), attribute("x_orderid", "Lookup", targets=["x_order"]),
    attribute("customerid", "Customer", targets=["account", "contact"]), attribute("x_loose", "Lookup", targets=[]),
    attribute("x_parentid", "Lookup", targets=["X_Case"]), attribute("x_ownerid", "Owner", targets=["systemuser", "team"]),
    attribute("x_tags", "Virtual", multi=True), attribute("x_virtual", "Virtual", multi=False),
    attribute("x_kindname", "String", of="x_kind"), attribute("address1_addressid", "Uniqueidentifier"),
    attribute("createdon", "DateTime"), attribute("ownerid", "Owner", targets=["systemuser"]),
    attribute("STATUSCODE", "Status"), attribute("x_party", "PartyList"), attribute("x_entity", "EntityName"),
    attribute("x_image", "Image"), attribute("x_file", "File"), attribute("x_null", None),
]

STAGED = {
    "x_caseid": "NVARCHAR(100)", "x_title": "NVARCHAR(200)", "x_code": "NVARCHAR(100)", "x_edge": "NVARCHAR(4000)",
    "x_body": "NVARCHAR(MAX)", "x_zero": "NVARCHAR(MAX)", "x_legacyid": "NVARCHAR(50)", "x_notes": "NVARCHAR(MAX)",
    "x_count": "INT", "x_big": "BIGINT", "x_flag": "BIT", "x_rate": "NVARCHAR(100)", "x_ratio": "NVARCHAR(100)",
    "x_kind": "NVARCHAR(100)", "x_fee": "NVARCHAR(100)", "x_fee_base": "NVARCHAR(100)", "x_due": "DATE",
    "x_at": "DATETIME2(7)", "x_when": "DATETIME2(7)", "x_orderid": "NVARCHAR(100)", "customerid": "NVARCHAR(100)",
    "customeridtype": "NVARCHAR(100)", "x_loose": "NVARCHAR(100)", "x_loosetype": "NVARCHAR(100)",
    "x_parentid": "NVARCHAR(100)", "x_ownerid": "NVARCHAR(100)", "x_owneridtype": "NVARCHAR(100)",
    "x_tags": "NVARCHAR(MAX)",
}


def frames(spark, attributes=ATTRIBUTES):
    return spark.createDataFrame(attributes, schemas.ATTRIBUTES), spark.createDataFrame(ENTITY, schemas.ENTITIES)


@pytest.fixture(scope="module")
def columns(spark):
    attributes, entities = frames(spark)
    return lay.add_companions(lay.map_types(scope.attributes_in_scope(attributes, entities))).cache()


def ordered(layout):
    return [r["name"] for r in layout.orderBy("ordinal").collect()]


def test_types_and_companions(columns):
    assert {r["name"]: r["sql_type"] for r in columns.collect()} == STAGED


def test_flags(columns):
    found = {r["name"]: r for r in columns.collect()}
    assert [n for n, r in found.items() if r["is_primary_id"]] == ["x_caseid"]
    assert [n for n, r in found.items() if r["is_primary_name"]] == ["x_title"]
    assert {n for n, r in found.items() if r["is_lookup"]} == {"x_orderid", "customerid", "x_loose", "x_parentid", "x_ownerid"}
    assert {n for n, r in found.items() if r["is_polymorphic"]} == {"customerid", "x_loose", "x_ownerid"}
    assert found["x_fee_base"]["display_name"] == "X_FEE (Base)"
    assert found["x_notes"]["additional_info"] == "Max length: 2000"
    assert found["x_due"]["additional_info"] == "Format: DateOnly"
    assert found["x_when"]["additional_info"] == "Format: DateAndTime"


def test_untyped_attribute_is_reported(spark):
    assert [r["logical_name"] for r in lay.untyped_attributes(frames(spark)[0]).collect()] == ["x_null"]


def test_staging_order(columns):
    result = lay.staging_layout(columns)
    assert ordered(result.columns) == sorted(STAGED, key=str.upper) + [
        "overriddencreatedon", "ownerid", "owneridtype", "statecode"]
    assert result.conflicts.count() == 0
    comments = {r["name"]: r["comment"] for r in result.columns.collect()}
    assert comments["customerid"] == "polymorphic lookup: account, contact"
    assert comments["x_orderid"] == "lookup: x_order"
    assert comments["x_loose"] == "lookup (no targets reported)"


def test_table_without_columns_has_the_fixed_ones(spark, columns):
    tables = spark.createDataFrame([("o", "empty")], "org_key string, table string")
    everything = tables.union(columns.select("org_key", "table"))
    assert ordered(lay.staging_layout(columns, everything).columns.where("table = 'x_case'"))[:3] == [
        "customerid", "customeridtype", "x_at"]
    assert ordered(lay.staging_layout(columns, everything).columns.where("table = 'empty'")) == [
        "overriddencreatedon", "ownerid", "owneridtype", "statecode"]


def test_key_map_order(spark, columns):
    result = lay.key_map_layout(columns, frames(spark)[1])
    assert ordered(result.columns) == [
        "x_caseid", "x_title", "x_legacyid", "customerid", "customeridtype", "x_loose", "x_loosetype", "x_orderid",
        "x_ownerid", "x_owneridtype", "x_parentid"]
    assert {r["name"]: r["sql_type"] for r in result.columns.collect()}["x_caseid"] == "VARCHAR(100)"


def test_key_map_repeats_are_conflicts(spark, columns):
    result = lay.key_map_layout(columns, frames(spark)[1], "title, orderid")
    assert ordered(result.columns)[:3] == ["x_caseid", "x_title", "x_orderid"]
    assert {(r["name"], r["block"]) for r in result.conflicts.collect()} == {("x_title", 3), ("x_orderid", 4)}


def test_key_map_without_primary_columns(spark):
    attributes, entities = frames(spark, [attribute("x_title", "Memo")])
    columns = lay.map_types(scope.attributes_in_scope(attributes, entities))
    rows = lay.key_map_layout(columns, entities).columns.orderBy("ordinal").collect()
    assert [(r["name"], r["sql_type"]) for r in rows] == [("x_caseid", "VARCHAR(100)"), ("x_title", "NVARCHAR(100)")]


def test_companion_that_meets_a_real_column(spark):
    attributes, entities = frames(spark, [attribute("y", "Lookup", targets=[]), attribute("YTYPE", "String", 7)])
    columns = lay.add_companions(lay.map_types(scope.attributes_in_scope(attributes, entities)))
    result = lay.staging_layout(columns)
    assert ordered(result.columns)[:2] == ["y", "ytype"]
    assert [r["name"] for r in result.conflicts.collect()] == ["YTYPE"]


def test_many_targets_are_shortened(spark):
    attributes, entities = frames(spark, [attribute("r", "Lookup", targets=list("abcdefg"))])
    columns = lay.map_types(scope.attributes_in_scope(attributes, entities))
    assert columns.select(lay.column_comment()).first()[0] == "polymorphic lookup: a, b, c, d, e, ... (+2 more)"


def test_edges(spark, columns):
    tables = ["x_case", "X_Order", "account", "contact", "systemuser"]
    selection = spark.createDataFrame([("o", t) for t in tables], "org_key string, table string")

    def edges(exclusions=""):
        return {r["dst"] for r in dependency_edges(columns, selection, exclusions).collect()}

    assert edges() == {"x_order", "account", "contact", "systemuser"}
    assert edges("X_OwnerId;\r\ncustomerid,") == {"x_order"}


@pytest.mark.parametrize("behavior, whole", [(0, True), (None, True), (1, False), (2, False), ("absent", False)])
def test_scope_of_a_solution(spark, behavior, whole):
    attributes, entities = frames(spark)
    parts = [("o", "s", "id-x_fee", 2, None), ("o", "s", "id-x_title", 9, None), ("o", "other", "id-x_big", 2, None)]
    if behavior != "absent":
        parts.append(("o", "s", "e1", 1, behavior))
    components = spark.createDataFrame(parts, schemas.SOLUTION_COMPONENTS)
    chosen = spark.createDataFrame([("o", "s")], "org_key string, solution_id string")
    membership = scope.solution_membership(components, chosen)
    kept = {r["logical_name"] for r in scope.attributes_in_scope(attributes, entities, membership).collect()}
    assert {"x_caseid", "x_title", "x_fee"} <= kept
    assert ("x_big" in kept) == whole
    assert whole or kept == {"x_caseid", "x_title", "x_fee"}


def test_lists():
    assert match_key_suffixes(" LegacyId, ,code ") == ["legacyid", "code"]
    assert match_key_suffixes("a;b") == ["a;b"]
    assert match_key_suffixes(None) == []
    assert excluded_columns("A;b\r\n a ,, C\n") == ["a", "b", "c"]


def test_spark_types():
    assert [spark_type(t) for t in ("NVARCHAR(50)", "NVARCHAR(MAX)", "BIT", "DATETIME2(7)", "VARCHAR(100)", "INT")] == [
        "VARCHAR(50)", "STRING", "BOOLEAN", "TIMESTAMP_NTZ", "VARCHAR(100)", "INT"]
    assert (text_limit("NVARCHAR(MAX)"), text_limit("INT"), text_limit("NVARCHAR(12)")) == (None, None, 12)


def test_categories_and_search(spark):
    names = ["account", "new_a", "NEW_b", "_x", "a_", "link_t"]
    tables = spark.createDataFrame(
        [("o", n, n, "Größe" if n == "account" else None, n == "link_t" or None) for n in names],
        "org_key string, entity_id string, logical_name string, display_name string, is_intersect boolean")
    shown = scope.tables_in_scope(tables)
    assert {r["logical_name"] for r in shown.collect()} == set(names) - {"link_t"}
    assert {r["logical_name"]: r["category"] for r in scope.with_category(tables).collect()} == {
        "account": "oob", "new_a": "new", "NEW_b": "NEW", "_x": "oob", "a_": "a", "link_t": "link"}
    assert {(r["category"], r["n_tables"]) for r in scope.categories(shown).collect()} == {("NEW", 2), ("oob", 2), ("a", 1)}

    def found(**how):
        return {r["logical_name"] for r in scope.find_tables(shown, **how).collect()}

    assert found(term=" ew_") == {"new_a", "NEW_b"}
    assert found(term="GRÖ") == {"account"}
    assert found(in_category="new") == {"new_a", "NEW_b"}


def test_selection_falls_back_only_without_an_entry(spark):
    tables = spark.createDataFrame([(o, f"{o}{t}", t) for o in "ABC" for t in ("x", "y", "z")],
                                   "org_key string, entity_id string, logical_name string")
    orgs = tables.select("org_key").distinct()
    picks = spark.createDataFrame([("a", "X"), ("a", "nowhere"), ("b", None)], schemas.SELECTIONS)
    got = scope.effective_selection(orgs, picks, ["Y", "gone"], tables)
    assert {tuple(r) for r in got.collect()} == {("A", "x"), ("C", "y")}
    nothing = scope.effective_selection(orgs, picks, [], tables)
    assert {tuple(r) for r in nothing.collect()} == {("A", "x")}
