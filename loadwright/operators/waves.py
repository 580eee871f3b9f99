"""Load order inside one table whose rows refer to other rows of it."""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loadwright.operators.identity import has_key
from loadwright.operators.skew import lookup_join
from loadwright.sources.scratch import cut


class RowWaves(NamedTuple):
    """``waves`` (id, wave) and ``dropped`` (id, parent), under the caller's column names."""

    waves: DataFrame
    dropped: DataFrame


def row_waves(rows: DataFrame, id_col: str, parent_col: str) -> RowWaves:
    """Wave of every row: how many rows must be loaded before it, one after the other.

    A parent outside the set and a row naming itself count as no parent.  Each cycle is
    opened at its smallest id; that link is returned as dropped.

    Each row knows an ancestor and its distance, and every round both double, so rounds
    grow with the logarithm of the longest chain or cycle.  Fails on repeated ids.
    """
    ids = rows.groupBy(F.col(id_col).alias("id")).agg(
        F.count(F.lit(1)).alias("_n"), F.min(parent_col).alias("parent"))
    repeated = F.raise_error(F.concat_ws(" ", F.lit("row id is missing or repeated:"), F.col("id").cast("string")))
    links, found = cut(ids.select("id", F.when((F.col("_n") > 1) | F.col("id").isNull(), repeated.cast(
        ids.schema["parent"].dataType)).otherwise(F.nullif("parent", F.col("id"))).alias("parent")), "links")
    known = links.select(F.col("id").alias("parent"), F.lit(True).alias("_known"))
    inside = lookup_join(links, known, ["parent"], right_rows=found["rows"]).select(
        "id", F.when(F.col("_known"), F.col("parent")).alias("parent"))

    settled, looped = _double(inside, found["rows"])
    dropped = inside.select("id", "parent").where("false")
    if looped is not None:
        cyclic, n_cyclic = cut(lookup_join(links, looped, ["id"], "inner"), "cyclic")
        dropped = cyclic.where("is_root").select("id", "parent")
        opened = cyclic.select("id", F.when(~F.col("is_root"), F.col("parent")).alias("parent"))
        rest, _ = _double(opened, n_cyclic["rows"])
        settled = settled + rest
    waves = reduce(DataFrame.unionByName, settled).select(F.col("id").alias(id_col), F.col("dist").alias("wave"))
    return RowWaves(waves, dropped.select(F.col("id").alias(id_col), F.col("parent").alias(parent_col)))


def _double(links: DataFrame, n_rows: int) -> tuple[list[DataFrame], DataFrame | None]:
    """Pointer doubling: settled rows (id, dist), and the rows that lead into a cycle, if any.

    ``lo`` is the smallest id met on the way.  When a round settles no row, no chain has an
    end left to reach; when it also lowers no ``lo``, every row on a cycle knows the
    cycle's smallest id, and the row that finds itself again as that id is its root.
    """
    start = links.select(
        "id", F.col("parent").alias("anc"), F.when(F.col("parent").isNull(), 0).otherwise(1).cast("long").alias("dist"),
        F.col("id").alias("lo"), F.lit(False).alias("is_root"), F.lit(True).alias("lowered"))
    active = F.count_if(F.col("anc").isNotNull())
    state, seen = cut(start, "waves", active=active)
    settled = [state.where(F.col("anc").isNull()).select("id", "dist")]
    while seen["active"]:
        moving = state.where(F.col("anc").isNotNull())
        ends = reduce(DataFrame.unionByName, settled).select(
            F.col("id").alias("anc"), F.lit(None).cast(moving.schema["anc"].dataType).alias("next"),
            F.col("dist").alias("step"), F.col("id").alias("low"))
        ahead = moving.select(
            F.col("id").alias("anc"), F.col("anc").alias("next"), F.col("dist").alias("step"), F.col("lo").alias("low"))
        met = lookup_join(moving.select("id", "anc", "dist", "lo"), ahead.unionByName(ends), ["anc"], "inner",
                          right_rows=n_rows)
        before = seen["active"]
        state, seen = cut(met.select(
            "id", F.col("next").alias("anc"), (F.col("dist") + F.col("step")).alias("dist"),
            F.least("lo", "low").alias("lo"),
            ((F.col("lo") == F.col("id")) & (F.col("low") == F.col("id"))).alias("is_root"),
            (F.col("low") < F.col("lo")).alias("lowered")), "waves",
            active=active, lowered=F.count_if("lowered"))
        settled.append(state.where(F.col("anc").isNull()).select("id", "dist"))
        if seen["active"] == before and not seen["lowered"]:
            return settled, state.where(F.col("anc").isNotNull()).select("id", "is_root")
    return settled, None


def with_waves(rows: DataFrame, key: str, parent: str, name: str) -> DataFrame:
    """Adds ``name``, the wave of each row: one more than that of the key it names, 0 where none in ``rows`` has that key.

    Of rows that share a key the smallest parent places the key; the others follow their own parents.  The link
    that opens a cycle, and a row that names itself, wait for nothing: such rows are in wave 0.
    """
    as_text = rows.select(F.col(key).cast("string").alias("id"), F.col(parent).cast("string").alias("parent"))
    links, seen = cut(as_text.where(has_key("id")).groupBy("id").agg(
        F.min(F.nullif("parent", F.lit(""))).alias("parent")), "wave-links")
    found = row_waves(links, "id", "parent")
    waves, _ = cut(found.waves, "wave-places")
    dropped, opened = cut(found.dropped, "wave-dropped")
    placed = rows.withColumns({"_own": F.col(key).cast("string"), "_up": F.col(parent).cast("string")})
    placed = lookup_join(placed, waves.select(F.col("id").alias("_up"), F.col("wave").alias("_above")), ["_up"],
                         right_rows=seen["rows"])
    free = F.col("_up").eqNullSafe(F.col("_own"))
    if opened["rows"]:
        placed = lookup_join(placed, dropped.select(F.col("id").alias("_own"), F.col("parent").alias("_opened")), ["_own"],
                             right_rows=opened["rows"])
        free = free | F.coalesce(F.col("_opened") == F.col("_up"), F.lit(False))
    wave = F.when(free, F.lit(0)).otherwise(F.coalesce(F.col("_above") + 1, F.lit(0))).cast("int")
    return placed.withColumn(name, wave).select(*rows.columns, name)
