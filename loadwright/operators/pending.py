"""Links of loaded rows that still wait for their target."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loadwright.operators.skew import lookup_join

def is_open(lookup: str) -> Column:
    """The row names a key that has no id yet."""
    return F.coalesce(F.col(lookup).cast("string") != "", F.lit(False)) & F.col(f"{lookup}_id").isNull()


def open_links(loaded: DataFrame, lookups: Mapping[str, str], polymorphic: Iterable[str] = ()) -> DataFrame:
    """part, lookup, target, legacy_key: each missing key once for every part of a loaded table that waits for it.

    Reads the columns of the lookups only; keys are combined before the shuffle.
    """
    targets = {c: F.lit(t.lower()) for c, t in lookups.items()} | {c: F.lower(f"{c}type") for c in polymorphic}
    found = [
        loaded.where(is_open(c)).select("part", F.lit(c).alias("lookup"), target.alias("target"),
                                        F.col(c).cast("string").alias("legacy_key"))
        for c, target in targets.items()]
    return reduce(DataFrame.unionByName, found).distinct()


def parts_to_fill(links: DataFrame, key_maps: Mapping[str, DataFrame], sizes: Mapping[str, int | None]) -> list[str]:
    """The parts with a link that a key map resolves now: names, not rows, and no more than the table has parts."""
    found = [
        lookup_join(links.where(F.col("target") == t.lower()), m.select("legacy_key"), ["legacy_key"], "left_semi",
                    right_rows=sizes.get(t))
        for t, m in key_maps.items()]
    if not found:
        return []
    return [r[0] for r in reduce(DataFrame.unionByName, found).select("part").distinct().collect()]
