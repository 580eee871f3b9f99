"""Joins and row numbers that hold when one key has a third of all rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loadwright.sources.scratch import cut

# A lookup side of plain columns (ids, names and keys) is broadcast up to this many rows.  Sides with
# arrays, maps or structs, whose size rows do not tell, are never broadcast from here.
SMALL_ROWS = 200_000

# Keys that the sketch follows at least; it follows ten for each partition beyond that.
_TRACKED, _MOST_TRACKED = 50_000, 1_000_000

# A group of at most this many rows is numbered by a plain window.
BIG_GROUP = 1_000_000


def _key_hash(keys: Sequence[str]) -> Column:
    return F.xxhash64(*(F.col(k) for k in keys))


def hot_hashes(df: DataFrame, *key_sets: Sequence[str]) -> list[list[int]]:
    """For each set of key columns, the hashes of its hot keys; one pass, no shuffle of rows.

    A key is hot when it alone outweighs an average shuffle partition, so there are no more hot keys
    than partitions, and as many are asked for.  Frequent-item sketches are merged map-side.
    """
    partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tracked = min(max(_TRACKED, 10 * partitions), _MOST_TRACKED)
    sketches = [
        F.expr(f"approx_top_k(xxhash64({', '.join(f'`{k}`' for k in keys)}), {min(partitions, tracked)}, {tracked})").alias(f"hot_{i}")
        for i, keys in enumerate(key_sets)
    ]
    row = df.agg(F.count(F.lit(1)).alias("rows"), *sketches).first()
    return [
        [item["item"] for item in row[f"hot_{i}"] or [] if item["count"] * partitions > row["rows"]]
        for i in range(len(key_sets))
    ]


def _plain(df: DataFrame) -> bool:
    return not any(isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType)) for f in df.schema)


def merge_join(left: DataFrame, right: DataFrame, on: Sequence[str], how: str) -> DataFrame:
    """A join that never gathers a side: the planner's estimate leaves out how many rows an explode makes of one, so
    that it broadcasts sides of any size.
    """
    return left.join(right.hint("merge"), list(on), how)


def lookup_join(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "left", *,
                right_rows: int | None = None, hot: list[int] | None = None,
                small_rows: int | None = None) -> DataFrame:
    """Join rows to the at most one right row with the same key.

    ``how`` is left, inner, left_semi or left_anti; ``right`` must be unique on ``on``.
    ``right_rows`` is its row count, or an upper bound, where the caller knows it.

    A small right side is broadcast.  Where its size is not given it is not counted here: both sides
    are sorted by key, and the adaptive planner splits hot partitions.  Of a large right side hot keys,
    null keys among them, meet their few right rows by broadcast and are spread over the shuffle by
    a hash of the row without its maps; only the other rows are shuffled by key.
    """
    on = list(on)
    if right_rows is None and hot is None and small_rows is None:
        return merge_join(left, right, on, how)
    limit = SMALL_ROWS if small_rows is None else small_rows
    if _plain(right) and (right.count() if right_rows is None else right_rows) <= limit:
        return left.join(F.broadcast(right), on, how)
    if hot is None:
        hot = hot_hashes(left, on)[0]
    if not hot:
        return left.join(right, on, how)

    payload = [c for c in right.columns if c not in on]
    is_hot = _key_hash(on).isin(hot)
    found = F.struct(F.lit(True).alias("_hit"), *(F.col(c) for c in payload))
    # hashes in the list are no more than partitions, and right is unique on the key
    hot_right = right.where(is_hot).select(*on, found.alias("_hot"))
    cold_right = right.where(~is_hot).select(
        *(F.col(k).alias(f"_cold_{k}") for k in on), F.lit(0).alias("_right_spread"), found.alias("_cold"))
    slices = 4 * int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    hashed = [F.col(f.name) for f in left.schema if "map<" not in f.dataType.simpleString()]
    spread = F.when(is_hot, F.pmod(F.xxhash64(*hashed), F.lit(slices)).cast("int") + 1)
    keyed = left.withColumn("_left_spread", F.coalesce(spread, F.lit(0)))
    met = F.col("_left_spread") == F.col("_right_spread")
    for k in on:
        met = met & (F.col(k) == F.col(f"_cold_{k}"))
    both = (
        keyed.join(cold_right, met, "left")
        .join(F.broadcast(hot_right), on, "left")
        .withColumn("_found", F.coalesce("_hot", "_cold"))
    )
    if how in ("inner", "left_semi"):
        both = both.where(F.col("_found").isNotNull())
    elif how == "left_anti":
        both = both.where(F.col("_found").isNull())
    if how in ("left_semi", "left_anti"):
        return both.select(*left.columns)
    rest = [c for c in left.columns if c not in on]
    return both.select(*on, *rest, *(F.col(f"_found.{c}").alias(c) for c in payload))


def _is_big(df: DataFrame, group: Sequence[str], big_group: int) -> bool:
    largest = df.groupBy(*group).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0]
    return (largest or 0) > big_group


def _ranged(df: DataFrame, group: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Rows in global order, cut into ranges that split any large group.

    Written out, so that every reader sees the same ranges: ``_part`` and ``_pos``.
    """
    placed = (
        df.repartitionByRange(*group, *order).sortWithinPartitions(*group, *order)
        .withColumn("_pos", F.monotonically_increasing_id())
    )
    written, _ = cut(placed, "ranged")
    return written.withColumn("_part", F.shiftright("_pos", 33))


def _spanning(pieces: DataFrame, group: Sequence[str]) -> DataFrame:
    """The pieces of groups that cross a range border: at most two per range."""
    crossing = (
        pieces.groupBy(*group).agg(F.min("_part").alias("_first"), F.max("_part").alias("_last"))
        .where(F.col("_first") < F.col("_last"))
    )
    same = F.lit(True)
    for g in group:
        same = same & pieces[g].eqNullSafe(crossing[g])
    return pieces.join(F.broadcast(crossing), same, "left_semi")


def number_rows(df: DataFrame, group: Sequence[str], order: Sequence[str], name: str, *,
                big_group: int | None = None, bounded: bool = False) -> DataFrame:
    """1-based position of each row in its group, in ascending order of ``order``.

    ``order`` must be unique inside a group.  Groups too big for one task are numbered
    range by range, with the sizes of the earlier ranges added.  ``bounded`` says that a group fits
    one task by what it is, such as the tables of one environment; nothing is counted then.
    """
    if bounded or not _is_big(df, group, BIG_GROUP if big_group is None else big_group):
        return df.withColumn(name, F.row_number().over(Window.partitionBy(*group).orderBy(*order)).cast("long"))
    rows = _ranged(df, group, order)
    pieces = rows.groupBy("_part", *group).agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        _spanning(pieces, group).withColumn("_before", F.sum("_n").over(earlier))
        .where(F.col("_before") > 0).select("_part", *(F.col(g).alias(f"_g_{g}") for g in group), "_before")
    )
    local = F.row_number().over(Window.partitionBy("_part", *group).orderBy("_pos"))
    here = rows.withColumn("_local", local)
    same = here["_part"] == offsets["_part"]
    for g in group:
        same = same & F.col(g).eqNullSafe(F.col(f"_g_{g}"))
    # one offset per range at most: only its first group can come from an earlier range
    return here.join(F.broadcast(offsets), same, "left").select(
        *df.columns, (F.col("_local") + F.coalesce("_before", F.lit(0))).cast("long").alias(name))


def previous_in_group(df: DataFrame, group: Sequence[str], order: Sequence[str], value: str, name: str, *,
                      big_group: int | None = None) -> DataFrame:
    """``value`` of the row before this one in its group, null for the first.

    Same conditions and same treatment of big groups as ``number_rows``.
    """
    if not _is_big(df, group, BIG_GROUP if big_group is None else big_group):
        return df.withColumn(name, F.lag(value).over(Window.partitionBy(*group).orderBy(*order)))
    rows = _ranged(df, group, order)
    pieces = rows.groupBy("_part", *group).agg(F.max_by(value, "_pos").alias("_end"))
    before = Window.partitionBy(*group).orderBy("_part")
    borders = (
        _spanning(pieces, group).withColumn("_before", F.lag("_end").over(before))
        .where(F.col("_before").isNotNull())
        .select("_part", *(F.col(g).alias(f"_g_{g}") for g in group), "_before")
    )
    inside = Window.partitionBy("_part", *group).orderBy("_pos")
    here = rows.withColumn("_lag", F.lag(value).over(inside)).withColumn("_local", F.row_number().over(inside))
    same = (here["_part"] == borders["_part"]) & (F.col("_local") == 1)
    for g in group:
        same = same & F.col(g).eqNullSafe(F.col(f"_g_{g}"))
    return here.join(F.broadcast(borders), same, "left").select(
        *df.columns, F.coalesce("_lag", "_before").alias(name))
