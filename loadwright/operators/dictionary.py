"""The data dictionary: what every planned table and column is."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loadwright.functions.names import fold, joined_names, order_key
from loadwright.operators.skew import lookup_join, number_rows


def _deferred(dropped: DataFrame) -> DataFrame:
    # one table's lookup targets: a short list
    return dropped.groupBy("org_key", F.col("src").alias("_key")).agg(
        joined_names(F.collect_set("dst")).alias("dropped_dependencies"))


def dictionary_index(entities: DataFrame, batches: DataFrame, dropped: DataFrame) -> DataFrame:
    """One row per planned table, in order of display name."""
    places = batches.select("org_key", fold("table").alias("_key"), "tier", "file_no", "order_no")
    planned = lookup_join(entities.withColumn("_key", fold("logical_name")), places, ["org_key", "_key"], "inner")
    rows = (
        lookup_join(planned, _deferred(dropped), ["org_key", "_key"])
        .withColumn("dropped_dependencies", F.coalesce("dropped_dependencies", F.lit("")))
        .withColumn("_name", order_key("display_name"))
    )
    numbered = number_rows(rows, ["org_key"], ["_name", "order_no"], "position", bounded=True)
    return numbered.select(
        "org_key", F.col("position").cast("int").alias("position"), "display_name", "logical_name", "schema_name", "tier",
        F.format_string("%02d", "file_no").alias("file"), "dropped_dependencies")


def dictionary_tables(entities: DataFrame, tiers: DataFrame) -> DataFrame:
    """The facts listed above the columns of each table."""
    places = tiers.select("org_key", fold("table").alias("_key"), "tier")
    return lookup_join(entities.withColumn("_key", fold("logical_name")), places, ["org_key", "_key"], "inner").select(
        "org_key", F.col("display_name").alias("entity"), "plural_name", "description", "schema_name",
        "logical_name", F.coalesce(F.col("object_type_code").cast("string"), F.lit("")).alias("object_type_code"),
        F.when(F.col("is_custom"), "TRUE").otherwise("FALSE").alias("is_custom_entity"),
        "ownership", "introduced_version", "tier")


def dictionary_columns(columns: DataFrame) -> DataFrame:
    """One row per column of each table, in name order; fixed columns are not listed."""
    # one table's columns: a short group
    place = Window.partitionBy("org_key", "table").orderBy(order_key("name"), F.desc("is_type_companion"), "name")
    return columns.select(
        "org_key", "table", F.row_number().over(place).alias("position"), "name", "display_name", "attr_type",
        F.coalesce(F.array_join("targets", ", "), F.lit("")).alias("lookup_target"), "description",
        F.when(F.col("is_custom"), "True").otherwise("False").alias("custom_attribute"),
        F.col("additional_info").alias("additional_data"), "sql_type")
