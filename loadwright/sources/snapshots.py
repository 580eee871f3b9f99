"""Catalog snapshots: one document per table, its attributes nested."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loadwright import schemas
from loadwright.functions.names import label


class Catalog(NamedTuple):
    entities: DataFrame
    attributes: DataFrame


def read_snapshot(spark: SparkSession, path: str, format: str = "json") -> DataFrame:
    """Exported documents with the declared schema; nothing is inferred."""
    return spark.read.schema(schemas.SNAPSHOT).format(format).load(path)


def flatten_snapshot(raw: DataFrame) -> Catalog:
    """Documents -> one row per table and one row per attribute.

    An empty table label becomes the logical name, other empty texts become ``''``.
    """
    blank = F.lit("")
    texts = {
        "display_name": label("display_name", F.col("logical_name")),
        "plural_name": label("plural_name", blank),
        "description": label("description", blank),
        "ownership": F.coalesce("ownership", blank),
        "introduced_version": F.coalesce("introduced_version", blank),
        "is_custom": F.coalesce("is_custom", F.lit(False)),
    }
    entities = raw.drop("attributes").withColumns(texts)
    attributes = (
        raw.select("org_key", F.col("logical_name").alias("table"), F.inline("attributes"))
        .withColumns({
            "display_name": label("display_name", blank),
            "description": label("description", blank),
            "is_custom": F.coalesce("is_custom", F.lit(False)),
        })
    )
    return Catalog(entities, attributes)


def attribute_targets(attributes: DataFrame) -> DataFrame:
    """One row per lookup target, with its position."""
    return attributes.select(
        "org_key", "table", "logical_name", F.posexplode("targets").alias("position", "target"))
