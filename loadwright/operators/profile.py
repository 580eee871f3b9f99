"""Profiles that add up: what is known of each load is kept as sketches, and read together without the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Size of the distinct counts: 2^14 buckets, a standard error of about 0.8 %.
BUCKETS = 14
# Values that the most frequent ones are picked from, and how many are reported.
TRACKED, TOP = 1_000, 3


def column_sketches(staged: DataFrame, buckets: int = BUCKETS, tracked: int = TRACKED) -> DataFrame:
    """One row for each column of ``staged``: rows, nulls, longest text, and sketches of its distinct and frequent values.

    One pass; sketches are merged before the shuffle, so what is shuffled and stored follows the columns, not the rows.
    """
    def entry(c: str) -> Column:
        value = F.col(f"`{c}`").cast("string")
        # long values count by their digest, so that a sketch stays small
        short = F.when(F.octet_length(value) > 32, F.concat(F.lit("#"), F.md5(value))).otherwise(value)
        return F.struct(F.lit(c).alias("name"), short.alias("value"), F.char_length(value).alias("length"))

    values = staged.select(F.inline(F.array(*map(entry, staged.columns))))
    return values.groupBy("name").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col("value").isNull()).alias("n_null"),
        F.max("length").alias("max_length"), F.hll_sketch_agg("value", buckets).alias("distinct_sketch"),
        F.expr(f"approx_top_k_accumulate(value, {tracked})").alias("top_sketch"))


def combine_profiles(sketches: DataFrame, top: int = TOP, tracked: int = TRACKED) -> DataFrame:
    """The profile of several loads from their ``column_sketches`` alone.

    ``n_distinct`` is off by a standard error of 0.8 % with the default size; ``top_values`` are frequent values and their
    counts, which are exact where a column has no more than three quarters of ``tracked`` values.
    """
    merged = sketches.groupBy("name").agg(
        F.sum("n_rows").alias("n_rows"), F.sum("n_null").alias("n_null"), F.max("max_length").alias("max_length"),
        F.hll_sketch_estimate(F.hll_union_agg("distinct_sketch")).alias("n_distinct"),
        F.expr(f"approx_top_k_combine(top_sketch, {tracked})").alias("_top"))
    return merged.select("name", "n_rows", "n_null", "n_distinct", "max_length",
                         F.expr(f"approx_top_k_estimate(_top, {top})").alias("top_values"))
