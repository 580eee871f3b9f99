"""Legacy key -> target id maps."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loadwright.operators.skew import lookup_join
from loadwright.sources.scratch import cut


class KeyMap(NamedTuple):
    """``entries`` is unique on the match key; ``conflicts`` holds the rows left out, and why."""

    entries: DataFrame
    conflicts: DataFrame


def _keyed(target_rows: DataFrame, id_col: str, match_key: str, carried: Sequence[str]) -> DataFrame:
    return target_rows.select(F.col(id_col).cast("string").alias("target_id"),
                              F.nullif(F.col(match_key).cast("string"), F.lit("")).alias("legacy_key"), *carried)


def _best(rows: DataFrame, carried: Sequence[str]) -> DataFrame:
    return rows.where(F.col("legacy_key").isNotNull()).groupBy("legacy_key").agg(
        F.min(F.struct("target_id", *carried)).alias("_best"), F.max("target_id").alias("_last"))


def key_map_entries(target_rows: DataFrame, id_col: str, match_key: str, carried: Sequence[str] = ()) -> DataFrame:
    """Map from the loaded rows of one table: target_id, legacy_key, then the carried columns.

    Of several rows with one match key the lowest target id wins; rows without a match key
    cannot be looked up and are left out.  The winner is an aggregate, so a key shared by
    very many rows is combined before the shuffle.
    """
    best = _best(_keyed(target_rows, id_col, match_key, carried), carried)
    return best.select("_best.target_id", "legacy_key", *(f"_best.{c}" for c in carried))


def build_key_map(target_rows: DataFrame, id_col: str, match_key: str, carried: Sequence[str] = ()) -> KeyMap:
    """``key_map_entries``, and the rows that lost to another row or have no match key.

    The aggregate is written once and read for both; only keys that several target ids
    share take part in the search for conflicts.
    """
    rows = _keyed(target_rows, id_col, match_key, carried)
    # the second id tells only whether there is one, and is not written
    found = _best(rows, carried).select("_best", "legacy_key", (F.col("_best.target_id") != F.col("_last")).alias("_shared"))
    best, seen = cut(found, "key-map", shared=F.count_if("_shared"))
    entries = best.select("_best.target_id", "legacy_key", *(f"_best.{c}" for c in carried))
    winners = best.where("_shared").select("legacy_key", F.col("_best.target_id").alias("kept_id"))
    return KeyMap(entries, _left_out(rows, winners, seen["shared"]))


def _left_out(rows: DataFrame, kept: DataFrame, n_kept: int | None) -> DataFrame:
    losers = lookup_join(rows.where(F.col("legacy_key").isNotNull()), kept, ["legacy_key"], "inner",
                         right_rows=n_kept).where(F.col("target_id") != F.col("kept_id"))
    return losers.select("target_id", "legacy_key", "kept_id", F.lit("duplicate").alias("reason")).unionByName(
        rows.where(F.col("legacy_key").isNull()).select(
            "target_id", "legacy_key", F.lit(None).cast("string").alias("kept_id"), F.lit("missing").alias("reason")))


def key_map_conflicts(target_rows: DataFrame, id_col: str, match_key: str, entries: DataFrame,
                      n_entries: int | None = None) -> DataFrame:
    """The rows that a given map leaves out: as the conflicts of ``build_key_map``, whichever row of a key the map has."""
    kept = entries.select("legacy_key", F.col("target_id").alias("kept_id"))
    return _left_out(_keyed(target_rows, id_col, match_key, ()), kept, n_entries)


def merge_key_map(existing: DataFrame, new: DataFrame) -> DataFrame:
    """The existing map, unchanged, and the entries of ``new`` for keys it does not have.

    Columns that only one of the two has are null in the rows of the other.
    """
    unseen = lookup_join(new, existing.select("legacy_key"), ["legacy_key"], "left_anti")
    return existing.unionByName(unseen, allowMissingColumns=True)
