"""Batches, load order and the summary of a plan."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loadwright.functions.names import order_key
from loadwright.operators.skew import lookup_join, merge_join, number_rows
from loadwright.options import PlanOptions


def load_batches(tiers: DataFrame, batch_size: int = PlanOptions.batch_size) -> DataFrame:
    """Cut every tier into parts of at most ``batch_size`` tables, numbered through all tiers.

    Also gives each table its place in the load order and in the reverse order for resets.
    ``tiers`` is read several times: pass a written frame.
    """
    size = max(1, batch_size)
    per_tier = tiers.groupBy("org_key", "tier").agg(F.count(F.lit(1)).cast("int").alias("n"))
    # an environment has no more tiers than the load plan had rounds: short groups
    through = Window.partitionBy("org_key").orderBy("tier")
    whole = Window.partitionBy("org_key")
    parts = F.ceil(F.col("n") / size).cast("int")
    offsets = per_tier.select(
        "org_key", "tier", "n", parts.alias("total_parts"),
        (F.sum(parts).over(through) - parts).alias("files_before"),
        (F.sum("n").over(through) - F.col("n")).alias("tables_before"),
        F.sum("n").over(whole).alias("n_tables"))
    numbered = number_rows(tiers.withColumn("_name", order_key("table")), ["org_key", "tier"], ["_name", "table"], "rn", bounded=True)
    part = F.floor((F.col("rn") - 1) / size).cast("int") + 1
    placed = lookup_join(numbered, offsets, ["org_key", "tier"], "inner").withColumn("part", part)
    in_part = F.least(F.lit(size), F.col("n") - (F.col("part") - 1) * size)
    return placed.select(
        "org_key",
        (F.col("files_before") + F.col("part")).cast("int").alias("file_no"),
        "tier", "part", "total_parts",
        (F.pmod(F.col("rn") - 1, F.lit(size)) + 1).cast("int").alias("pos"),
        "table",
        F.concat(
            F.lit("tier "), F.col("tier").cast("string"),
            F.when(F.col("total_parts") > 1, F.concat_ws(
                "", F.lit(" pt "), F.col("part").cast("string"), F.lit("/"), F.col("total_parts").cast("string")))
            .otherwise(""),
            F.lit(", "), in_part.cast("string"), F.when(in_part == 1, " table").otherwise(" tables")).alias("label"),
        (F.col("tables_before") + F.col("rn")).cast("int").alias("order_no"),
        (F.col("n_tables") - F.col("tables_before") - F.col("rn") + 1).cast("int").alias("reverse_no"))


def load_order(batches: DataFrame) -> DataFrame:
    """Place of every table when loading, and when resetting."""
    return batches.select("org_key", "table", "order_no", "reverse_no")


def output_count(n_files, options: PlanOptions):
    """Outputs of the enabled kinds: two are written per batch file, the others once."""
    per_file = int(options.staging) + int(options.key_maps)
    once = sum(map(int, (options.truncate, options.teardown, options.dictionary, options.diagram)))
    return (n_files * per_file + once).cast("int")


def plan_summary(batches: DataFrame, dropped: DataFrame, options: PlanOptions = PlanOptions()) -> DataFrame:
    """Per environment: tables, tiers, batches, outputs and warnings."""
    counts = batches.groupBy("org_key").agg(
        F.count(F.lit(1)).cast("int").alias("n_tables"),
        (F.max("tier") + 1).cast("int").alias("n_tiers"),
        F.max("file_no").cast("int").alias("n_batches"))
    warned = (
        dropped.groupBy("org_key", "src").agg(F.lit(1).alias("one"))
        .groupBy("org_key").agg(F.sum("one").cast("int").alias("n_warnings")))
    return merge_join(counts, warned, ["org_key"], "left").select(
        "org_key", "n_tables", "n_tiers", "n_batches", output_count(F.col("n_batches"), options).alias("n_outputs"),
        F.coalesce("n_warnings", F.lit(0)).alias("n_warnings"))
