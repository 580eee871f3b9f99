"""Replacing legacy keys by target ids."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loadwright.operators import skew
from loadwright.operators.skew import hot_hashes, lookup_join

# What became of a lookup.
EMPTY, RESOLVED, UNRESOLVED = "empty", "resolved", "unresolved"


def link_status(key: Column, found: Column) -> Column:
    return F.when(key.isNull() | (key == ""), EMPTY).when(found.isNotNull(), RESOLVED).otherwise(UNRESOLVED)


def _size(table: str, key_map: DataFrame, sizes: Mapping[str, int | None] | None) -> int:
    known = (sizes or {}).get(table)
    return key_map.count() if known is None else known


def resolve_lookups(staged: DataFrame, lookups: Mapping[str, str], key_maps: Mapping[str, DataFrame],
                    sizes: Mapping[str, int | None] | None = None) -> DataFrame:
    """Adds ``<lookup>_id`` and ``<lookup>_status`` for each single-target lookup.

    ``lookups`` names the target table of each lookup column, ``key_maps`` the map of each
    table, unique on legacy_key.  The staged key itself is kept, for reports and repeats.
    Maps whose row count ``sizes`` does not give are counted.  Small maps are broadcast.  For the others the hot keys of all lookups are found in one
    pass over the staged rows, and each lookup is one shuffled join; broadcasts come last, so that what they find is not shuffled.
    """
    sizes = {table: _size(table, key_maps[table], sizes) for table in set(lookups.values())}
    large = [name for name, table in lookups.items() if sizes[table] > skew.SMALL_ROWS]
    keys = {name: F.col(name).cast("string") for name in lookups}
    hot = {}
    if large:
        narrow = staged.select(*(keys[name].alias(name) for name in large))
        hot = dict(zip(large, hot_hashes(narrow, *([name] for name in large))))
    rows = staged
    for name in sorted(lookups, key=lambda n: (n not in large, sizes[lookups[n]])):
        entries = key_maps[lookups[name]].select(F.col("legacy_key").alias("_key"), F.col("target_id").alias("_id"))
        rows = lookup_join(rows.withColumn("_key", keys[name]), entries, ["_key"],
                           right_rows=sizes[lookups[name]], hot=hot.get(name))
        rows = rows.withColumn(f"{name}_id", F.col("_id")).drop("_key", "_id")
    rows = rows.withColumns({f"{name}_status": link_status(keys[name], F.col(f"{name}_id")) for name in lookups})
    added = [f"{name}_{part}" for name in lookups for part in ("id", "status")]
    return rows.select(*staged.columns, *added)


def resolve_polymorphic(staged: DataFrame, lookup: str, key_maps: Mapping[str, DataFrame],
                        type_column: str | None = None, sizes: Mapping[str, int | None] | None = None) -> DataFrame:
    """As ``resolve_lookups`` for one lookup whose target table is named in its own row.

    The name is read from ``<lookup>type``; names of tables without a map stay unresolved.
    """
    kind = type_column or f"{lookup}type"
    entries = reduce(DataFrame.unionByName, (
        key_map.select(F.lit(table.lower()).alias("_table"), F.col("legacy_key").alias("_key"),
                       F.col("target_id").alias("_id"))
        for table, key_map in key_maps.items()))
    key = F.col(lookup).cast("string")
    size = sum(_size(table, key_map, sizes) for table, key_map in key_maps.items())
    rows = lookup_join(staged.withColumns({"_table": F.lower(kind), "_key": key}), entries, ["_table", "_key"],
                       right_rows=size)
    return rows.select(*staged.columns, F.col("_id").alias(f"{lookup}_id"),
                       link_status(key, F.col("_id")).alias(f"{lookup}_status"))


def _fill(loaded: DataFrame, lookups: Iterable[str], resolve: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Resolve again, and keep every id that is there already."""
    lookups = list(lookups)
    before = loaded.drop(*(f"{name}_status" for name in lookups)).withColumnsRenamed(
        {f"{name}_id": f"_was_{name}" for name in lookups})
    filled = {name: F.coalesce(f"_was_{name}", f"{name}_id") for name in lookups}
    rows = resolve(before).withColumns({
        **{f"{name}_id": found for name, found in filled.items()},
        **{f"{name}_status": link_status(F.col(name), found) for name, found in filled.items()},
    })
    added = [f"{name}_status" for name in lookups if f"{name}_status" not in loaded.columns]
    return rows.select(*loaded.columns, *added)


def deferred_update(loaded: DataFrame, lookups: Mapping[str, str], key_maps: Mapping[str, DataFrame],
                    sizes: Mapping[str, int | None] | None = None) -> DataFrame:
    """Fills ``<lookup>_id`` of lookups that were left null to break a cycle.

    ``lookups`` are those on dropped edges.  An id that is there already is not changed.
    """
    return _fill(loaded, lookups, lambda rows: resolve_lookups(rows, lookups, key_maps, sizes))


def deferred_polymorphic(loaded: DataFrame, lookup: str, key_maps: Mapping[str, DataFrame],
                         sizes: Mapping[str, int | None] | None = None) -> DataFrame:
    """As ``deferred_update`` for a lookup of which some targets were loaded later."""
    return _fill(loaded, [lookup], lambda rows: resolve_polymorphic(rows, lookup, key_maps, sizes=sizes))
