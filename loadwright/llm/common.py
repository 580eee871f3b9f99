"""Helpers shared by the operators: columns, running sums over a global order, connected components."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loadwright.operators.skew import merge_join
from loadwright.sources.scratch import cut

# Words are maximal runs of anything but the six ASCII space characters.
WORD = r"[^\x20\x09-\x0D]+"


def needed(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns, so that further columns of the input cannot clash with derived ones."""
    return df.select(*(df[name] for name in names))


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` stored in the shared folder and read back."""
    return cut(df, label, codec=None)[0]


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def running_sums(df: DataFrame, order: Sequence[Column], sums: dict[str, Column]) -> DataFrame:
    """Adds, for each name, the sum over all rows before this one in a global order.

    ``order`` should tell rows apart, or rows that tie must be interchangeable.  Rows are cut into sorted
    ranges, which also split groups of any size; only the totals of the ranges, one row a partition, are added
    across them.
    """
    placed = (
        df.withColumns({f"_add_{n}": c for n, c in sums.items()})
        .repartitionByRange(*order).sortWithinPartitions(*order)
        .withColumn("_pos", F.monotonically_increasing_id())
    )
    rows = written(placed, "ordered").withColumn("_part", F.shiftright("_pos", 33))
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    ranges = (
        rows.groupBy("_part").agg(*(F.sum(f"_add_{n}").alias(f"_all_{n}") for n in sums))
        .select("_part", *(F.coalesce(F.sum(f"_all_{n}").over(earlier), F.lit(0)).alias(f"_from_{n}") for n in sums))
    )
    before = Window.partitionBy("_part").orderBy("_pos").rowsBetween(Window.unboundedPreceding, -1)
    here = rows.withColumns({f"_here_{n}": F.coalesce(F.sum(f"_add_{n}").over(before), F.lit(0)) for n in sums})
    # one row for each partition
    met = here.join(F.broadcast(ranges), "_part")
    return met.select(*df.columns, *((F.col(f"_from_{n}") + F.col(f"_here_{n}")).alias(n) for n in sums))


def components(edges: DataFrame, label: str) -> DataFrame:
    """(node, root) for every node of the undirected ``edges`` (a, b); root is the smallest node it reaches.

    Large-star and small-star steps in turn, each on the edges alone: stars are built of minima, which combine
    before the shuffle, so no neighbourhood is ever gathered.  Every step is written to the shared folder.
    """
    pairs = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
    state = {"mark": F.bit_xor(F.xxhash64("a", "b")), "total": F.count(F.lit(1))}
    current, seen = cut(pairs, label, codec=None, **state)
    while seen["total"]:
        both = current.union(current.select("b", "a"))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = (
            merge_join(both.where("b > a"), low, ["a"], "inner").select(F.col("b").alias("a"), F.col("m").alias("b"))
            .where("a <> b").distinct()
        )
        large = written(large, label)
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (
            merge_join(large, least, ["a"], "inner").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
            .union(least.select("a", F.col("m").alias("b"))).distinct()
        )
        after, now = cut(small, label, codec=None, **state)
        done = now == seen
        current, seen = after, now
        if done:
            break
    tops = current.select(F.col("b").alias("node")).distinct().select("node", F.col("node").alias("root"))
    return current.select(F.col("a").alias("node"), F.col("b").alias("root")).union(tops)
