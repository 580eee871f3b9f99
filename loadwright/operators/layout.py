"""Columns of the staging tables and key maps, from attribute metadata."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loadwright.functions.lists import match_key_suffixes
from loadwright.functions.names import order_key
from loadwright.functions.types import LOOKUP_TYPES, SHORT_TEXT, declared_type, type_notes
from loadwright.operators.skew import lookup_join

COLUMNS = [
    "org_key", "table", "name", "sql_type", "is_lookup", "is_polymorphic", "targets", "is_primary_id",
    "is_primary_name", "is_type_companion", "display_name", "description", "attr_type", "additional_info",
    "is_custom",
]

# Columns every staging table ends with, in this order.
FIXED_COLUMNS = (
    ("overriddencreatedon", "DATETIME2(7)"),
    ("ownerid", SHORT_TEXT),
    ("owneridtype", SHORT_TEXT),
    ("statecode", "INT"),
)

# A lookup's comment names this many targets; the key map's id type.
COMMENT_TARGETS = 5
KEY_MAP_ID_TYPE = "VARCHAR(100)"

# A generated table belongs to one (org_key, table) and has at most the 1,024 columns a
# target table may have, so the windows below sort short groups whatever the fleet's skew.
_TABLE = ["org_key", "table"]


class Layout(NamedTuple):
    columns: DataFrame
    conflicts: DataFrame


def map_types(attributes: DataFrame) -> DataFrame:
    """Attributes in scope -> column definitions; attributes of unmapped types are left out."""
    kind = F.col("attr_type")
    is_lookup = kind.isin(*LOOKUP_TYPES)
    targets = F.when(is_lookup, F.coalesce("targets", F.array().cast("array<string>")))
    typed = attributes.withColumns({
        "sql_type": declared_type(kind, F.col("max_length"), F.col("date_format"),
                                  F.coalesce("is_multi_select", F.lit(False)), F.col("is_primary_id")),
        "name": F.col("logical_name"),
        "targets": targets,
        "is_lookup": is_lookup,
        "is_polymorphic": F.when(is_lookup, F.size(targets) != 1).otherwise(False),
        "is_primary_id": (kind == "Uniqueidentifier") & F.col("is_primary_id"),
        "is_primary_name": (kind == "String") & F.col("is_primary_name"),
        "is_type_companion": F.lit(False),
        "additional_info": type_notes(kind, F.col("max_length"), F.col("date_format")),
        "display_name": F.coalesce("display_name", F.lit("")),
        "description": F.coalesce("description", F.lit("")),
        "is_custom": F.coalesce("is_custom", F.lit(False)),
    })
    return typed.where(F.col("sql_type").isNotNull()).select(*COLUMNS)


def untyped_attributes(attributes: DataFrame) -> DataFrame:
    """Attributes in scope that have no type at all: reported, never staged."""
    return attributes.where(F.col("attr_type").isNull()).select("org_key", "table", "logical_name")


def add_companions(columns: DataFrame) -> DataFrame:
    """Each column, plus ``<name>_base`` for money and ``<name>type`` for polymorphic lookups."""
    kinds = {f.name: f.dataType.simpleString() for f in columns.schema.fields}

    def row(**changed: Column) -> Column:
        return F.struct(*(changed.get(c, F.col(c)).cast(kinds[c]).alias(c) for c in COLUMNS))

    # Names and wording of the companions.
    plain = dict(is_lookup=F.lit(False), is_polymorphic=F.lit(False), targets=F.lit(None), description=F.lit(""),
                 is_primary_id=F.lit(False), is_primary_name=F.lit(False), sql_type=F.lit(SHORT_TEXT))
    base = row(**plain, name=F.concat("name", F.lit("_base")), is_type_companion=F.lit(False),
               display_name=F.concat("display_name", F.lit(" (Base)")), attr_type=F.lit("Money"),
               additional_info=F.lit("generated base-currency companion"))
    target_type = row(**plain, name=F.concat("name", F.lit("type")), is_type_companion=F.lit(True),
                      display_name=F.lit(""), attr_type=F.lit("EntityName"),
                      additional_info=F.concat(F.lit("generated target-table companion for "), F.col("name")))
    rows = F.array(row(), F.when(F.col("attr_type") == "Money", base), F.when(F.col("is_polymorphic"), target_type))
    return columns.select(F.inline(F.filter(rows, lambda r: r.isNotNull())))


def column_comment() -> Column:
    """What is known about a lookup, for readers of the table definition."""
    # The wording of the comment.
    more = F.size("targets") - COMMENT_TARGETS
    listed = F.concat(
        F.when(F.col("is_polymorphic"), "polymorphic lookup: ").otherwise("lookup: "),
        F.array_join(F.slice("targets", 1, COMMENT_TARGETS), ", "),
        F.when(more > 0, F.concat(F.lit(", ... (+"), more.cast("string"), F.lit(" more)"))).otherwise(""))
    return (
        F.when(F.col("is_lookup") & (F.size("targets") > 0), listed)
        .when(F.col("is_lookup"), F.lit("lookup (no targets reported)"))
        .when(F.col("is_type_companion"), F.lit("target table name for the polymorphic lookup above"))
    )


def _first_of_each_name(blocks: DataFrame, extra: list[str]) -> Layout:
    """Number the columns of each table; a repeated name keeps its first place.

    One shuffle by table serves both windows.
    """
    place = [F.col("block"), order_key("name"), F.desc("is_type_companion"), F.col("name")]
    marked = blocks.repartition(*_TABLE).withColumn(
        "_copy", F.row_number().over(Window.partitionBy(*_TABLE, order_key("name")).orderBy(*place)))
    kept = marked.where(F.col("_copy") == 1).withColumn(
        "ordinal", F.row_number().over(Window.partitionBy(*_TABLE).orderBy(*place)))
    repeated = marked.where(F.col("_copy") > 1)
    return Layout(kept.select(*_TABLE, "ordinal", "name", "sql_type", *extra),
                  repeated.select(*_TABLE, "name", "sql_type", "block"))


def staging_layout(columns: DataFrame, tables: DataFrame | None = None) -> Layout:
    """Staging columns by name, then the fixed columns; 1-based ordinals.

    ``tables`` (org_key, table) lists the tables; without it they are read off the columns,
    which takes those a second time and misses a table of which no attribute is kept.
    """
    own = columns.select(*_TABLE, "name", "sql_type", "is_type_companion",
                         column_comment().alias("comment"), F.lit(1).alias("block"))
    owners = (columns if tables is None else tables).select(*_TABLE)
    fixed = F.array(*(
        F.struct(F.lit(name).alias("name"), F.lit(kind).alias("sql_type"), F.lit(False).alias("is_type_companion"),
                 F.lit(None).cast("string").alias("comment"), F.lit(2 + i).alias("block"))
        for i, (name, kind) in enumerate(FIXED_COLUMNS)))
    tail = owners.distinct().select(*_TABLE, F.inline(fixed))
    return _first_of_each_name(own.unionByName(tail), ["comment"])


def is_match_key(name: Column | str, suffixes: str | None) -> Column:
    name = F.lower(name)
    hit = F.lit(False)
    for suffix in match_key_suffixes(suffixes):
        hit = hit | name.endswith(suffix)
    return hit


def match_keys(columns: DataFrame, suffixes: str | None = "legacyid") -> DataFrame:
    """Columns whose name ends with one of the suffixes."""
    return columns.where(is_match_key("name", suffixes))


def key_map_layout(columns: DataFrame, entities: DataFrame, suffixes: str | None = "legacyid") -> Layout:
    """Key-map columns: target id, name, match keys, then lookups with their companions."""
    heads = entities.select("org_key", F.col("logical_name").alias("table"), "primary_id", "primary_name")
    picked = columns.groupBy(*_TABLE).agg(
        F.min(F.when(F.col("is_primary_id"), F.col("name"))).alias("_id"),
        F.min(F.when(F.col("is_primary_name"), F.struct("name", "sql_type"))).alias("_name"))
    named = lookup_join(heads, picked, _TABLE)

    def entry(name: Column, kind: Column, block: int) -> Column:
        return F.struct(name.alias("name"), kind.alias("sql_type"), F.lit(False).alias("is_type_companion"),
                        F.lit(block).alias("block"))

    declared_name = F.nullif(F.col("primary_name"), F.lit(""))
    head = F.array(
        entry(F.coalesce("_id", "primary_id"), F.lit(KEY_MAP_ID_TYPE), 1),
        entry(F.coalesce("_name.name", declared_name), F.coalesce("_name.sql_type", F.lit(SHORT_TEXT)), 2))
    first = named.select(*_TABLE, F.inline(F.filter(head, lambda e: e["name"].isNotNull())))
    tables = heads.select(*_TABLE)
    owned = lookup_join(columns, tables, _TABLE, "left_semi")
    rest = owned.select(
        *_TABLE, "name",
        F.inline(F.filter(F.array(
            F.when(is_match_key("name", suffixes), F.struct(
                F.col("sql_type"), F.col("is_type_companion"), F.lit(3).alias("block"))),
            F.when(F.col("is_lookup") | F.col("is_type_companion"), F.struct(
                F.lit(SHORT_TEXT).alias("sql_type"), F.col("is_type_companion"), F.lit(4).alias("block")))),
            lambda e: e.isNotNull())))
    return _first_of_each_name(first.unionByName(rest), [])
