"""Checks on staged and resolved data."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loadwright.operators.resolve import EMPTY, RESOLVED, UNRESOLVED
from loadwright.sources.scratch import cut

# Values of more bytes are counted by their digest.
_SHORT = 32


def unresolved_report(resolved: DataFrame, table: str, lookups: Sequence[str], sample: int = 5) -> DataFrame:
    """Per lookup: rows by status, distinct missing keys, and the first few of them.

    Rows are combined per key before anything is grouped by lookup; the result of that is
    written once and read for the counts and the samples.  Only ``sample`` keys per task
    are ranked.
    """
    entries = F.array(*(
        F.struct(F.lit(name).alias("lookup"), F.col(f"{name}_status").alias("status"),
                 F.when(F.col(f"{name}_status") == UNRESOLVED, F.col(name).cast("string")).alias("missing"))
        for name in lookups))
    per_key, _ = cut(resolved.select(F.inline(entries)).groupBy("lookup", "status", "missing").agg(
        F.count(F.lit(1)).alias("n")), "unresolved")

    def rows(status: str):
        return F.sum(F.when(F.col("status") == status, F.col("n")).otherwise(0))

    counts = per_key.groupBy("lookup").agg(
        F.sum("n").alias("n_rows"), rows(EMPTY).alias("n_empty"), rows(RESOLVED).alias("n_resolved"),
        rows(UNRESOLVED).alias("n_unresolved"), F.count("missing").alias("n_missing_keys"))
    first = Window.partitionBy("lookup").orderBy("missing")
    examples = (
        per_key.where(F.col("missing").isNotNull()).select("lookup", "missing")
        .withColumn("_rank", F.row_number().over(first)).where(F.col("_rank") <= sample)
        .groupBy("lookup").agg(F.array_join(F.array_sort(F.collect_list("missing")), ", ").alias("missing_sample")))
    # one row per lookup column on either side
    return counts.join(examples, "lookup", "left").select(
        F.lit(table).alias("table"), "lookup", "n_rows", "n_empty", "n_resolved", "n_unresolved", "n_missing_keys",
        F.coalesce("missing_sample", F.lit("")).alias("missing_sample"))


def profile_staged(staged: DataFrame, dictionary: DataFrame, approximate: bool = False) -> DataFrame:
    """Observed nulls, distinct values and longest text of each column, next to its declared type.

    ``dictionary`` lists the columns of this table (name, sql_type).  Exact distinct counts
    shuffle every column's values once, values of more than ``_SHORT`` bytes as a digest of 128
    bits; ``approximate`` counts them in one pass instead.
    """
    def entry(c: str) -> Column:
        value = F.col(c).cast("string")
        # the mark keeps a digest apart from a short value that reads the same
        key = F.when(F.octet_length(value) > _SHORT, F.concat(F.lit("#"), F.md5(value))).otherwise(F.concat(F.lit("="), value))
        return F.struct(F.lit(c).alias("name"), key.alias("value"), F.char_length(value).alias("length"))

    values = staged.select(F.inline(F.array(*map(entry, staged.columns))))
    nulls = F.count_if(F.col("value").isNull())
    longest = F.max("length")
    if approximate:
        found = values.groupBy("name").agg(
            F.count(F.lit(1)).alias("n_rows"), nulls.alias("n_null"),
            F.approx_count_distinct("value").alias("n_distinct"), longest.alias("max_length"))
    else:
        per_value = values.groupBy("name", "value").agg(F.count(F.lit(1)).alias("n"), longest.alias("length"))
        found = per_value.groupBy("name").agg(
            F.sum("n").alias("n_rows"),
            F.sum(F.when(F.col("value").isNull(), F.col("n")).otherwise(0)).alias("n_null"),
            F.count("value").alias("n_distinct"), longest.alias("max_length"))
    declared = dictionary.select(F.lower("name").alias("_key"), "sql_type").distinct()
    # one row per column of one table on either side
    return found.withColumn("_key", F.lower("name")).join(declared, "_key", "left").select(
        "name", "sql_type", "n_rows", "n_null", "n_distinct", "max_length")
