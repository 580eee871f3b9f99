"""Lookup dependencies of a fleet: edges, cycle breaking, load tiers."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Mapping
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loadwright.functions.lists import excluded_columns
from loadwright.functions.names import fold, joined_names
from loadwright.operators.skew import lookup_join, merge_join
from loadwright.sources.scratch import cut


# An environment of at most this many tables is ordered as one row.
MOST_TABLES = 20_000

_ORDERED = "org_key string, t string, tier int, given_up array<string>, wave int"
# No table has this name: it stands for all that wait for nothing.
_FREE = ""


class LoadTiers(NamedTuple):
    """``tiers`` (org_key, table, tier) and ``dropped`` (org_key, src, dst, round)."""

    tiers: DataFrame
    dropped: DataFrame


def dependency_edges(columns: DataFrame, selection: DataFrame, exclusions: str | None = "") -> DataFrame:
    """Distinct lookup edges between selected tables, self references left out.

    Every target of every lookup counts; columns named in ``exclusions`` do not.
    """
    skipped = excluded_columns(exclusions)
    lookups = columns.where(F.col("is_lookup"))
    if skipped:
        lookups = lookups.where(~F.lower("name").isin(skipped))
    pairs = (
        lookups.select("org_key", fold("table").alias("src"), F.explode("targets").alias("target"))
        .select("org_key", "src", fold("target").alias("dst"))
        .where(F.col("src") != F.col("dst"))
    )
    members = selection.select("org_key", fold("table").alias("t"))
    return _inside(_spread(pairs, "org_key", "src", "dst").distinct(), members)


def _spread(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` dealt out before it is grouped by these keys: hardly any rows combine, and an exploded file may be one task."""
    return df.repartition(*keys)


def _inside(edges: DataFrame, members: DataFrame) -> DataFrame:
    for end in ("dst", "src"):
        tables = members.select("org_key", F.col("t").alias(end))
        edges = merge_join(edges, tables, ["org_key", end], "left_semi")
    return edges.select("org_key", "src", "dst")


def load_tiers(tables: DataFrame, edges: DataFrame) -> LoadTiers:
    """Tier of every table: the longest chain of kept dependencies below it.

    A wave is every table without unmet dependencies.  Where there is none such, it is the hub
    alone: the table most others wait for (then the one with the fewest unmet dependencies, then
    the first by name), which gives up its unmet dependencies; these edges are returned as dropped,
    with the number of the wave.

    Environments do not depend on each other.  Each that has at most ``MOST_TABLES`` tables comes together as one row and
    is ordered in one go, all of them in one job.  Of a larger one only the core does: its free tables stand as one, and
    tables that nobody waits for and that wait for the same ones stand as one that counts for all.  A core that is
    still larger fails, with the name of its environment.

    Fails on two tables of one environment whose names differ only in case.
    """
    key = ["org_key", "t"]
    same = F.concat_ws(" ", F.lit("table listed twice:"), "org_key", "t")
    members = (
        _spread(tables.select("org_key", fold("table").alias("t")), *key).groupBy(*key).agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("t", F.when(F.col("_n") > 1, F.raise_error(same)).otherwise(F.col("t"))).select(*key)
    )
    pairs = edges.select("org_key", fold("src").alias("src"), fold("dst").alias("dst")).where("src <> dst").distinct()
    sizes, seen = cut(members.groupBy("org_key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > MOST_TABLES), "big")
    if not seen["rows"]:
        return _as_tiers(_ordered(members, pairs))
    big = sizes.select("org_key")
    plain = _ordered(*(df.join(big, "org_key", "left_anti") for df in (members, pairs)))
    large = _ordered_cores(*(df.join(big, "org_key", "left_semi") for df in (members, pairs)))
    return _as_tiers(plain.unionByName(large))


def _as_tiers(ordered: DataFrame) -> LoadTiers:
    tiers = ordered.select("org_key", F.col("t").alias("table"), "tier")
    dropped = ordered.select("org_key", F.col("t").alias("src"), F.explode("given_up").alias("dst"), F.col("wave").alias("round"))
    return LoadTiers(tiers, dropped)


def _ordered(members: DataFrame, pairs: DataFrame) -> DataFrame:
    """One row for each environment, ordered in one go; ends outside its tables are left out there.

    Members may have ``weight``, how many tables one stands for.
    """
    weight = F.col("weight") if "weight" in members.columns else F.lit(1)
    waiting = pairs.groupBy("org_key").agg(F.collect_list(F.struct("src", "dst")).alias("edges"))
    catalogs = members.groupBy("org_key").agg(F.collect_list(F.struct("t", weight.cast("long").alias("weight"))).alias("tables"))
    return cut(merge_join(catalogs, waiting, ["org_key"], "left").mapInPandas(_order, _ORDERED), "load-tiers")[0]


def _ordered_cores(members: DataFrame, pairs: DataFrame) -> DataFrame:
    """As ``_ordered`` for environments too large for one row: only what can differ in its place is gathered."""
    here = ["org_key", "t"]
    members, _ = cut(members, "graph-tables")
    inside, _ = cut(_inside(pairs, members), "graph-edges")
    waits = inside.select("org_key", F.col("src").alias("t")).distinct()
    needed = inside.select("org_key", F.col("dst").alias("t")).distinct()
    free = members.join(waits, here, "left_anti")
    # all free tables are placed first, whichever they are: one name stands for them
    marked = free.select("org_key", F.col("t").alias("dst"), F.lit(True).alias("_free"))
    short = inside.join(marked, ["org_key", "dst"], "left").select(
        "org_key", "src", F.when(F.col("_free"), _FREE).otherwise(F.col("dst")).alias("dst")).distinct()
    short, _ = cut(short, "graph-short")
    leaves = waits.join(needed, here, "left_anti").select("org_key", F.col("t").alias("src"))
    # what one table waits for is bounded by its columns, free targets being one
    kinds, _ = cut(short.join(leaves, ["org_key", "src"], "left_semi").groupBy("org_key", "src").agg(
        F.array_sort(F.collect_list("dst")).alias("dsts")), "graph-leaves")
    stands = kinds.groupBy("org_key", "dsts").agg(F.min("src").alias("t"), F.count(F.lit(1)).alias("weight"))
    inner = waits.join(needed, here, "left_semi").withColumn("weight", F.lit(1).cast("long"))
    first = free.select("org_key").distinct().select("org_key", F.lit(_FREE).alias("t"), F.lit(1).cast("long").alias("weight"))
    core, _ = cut(inner.unionByName(stands.select(*here, "weight")).unionByName(first), "graph-core")
    large = core.groupBy("org_key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > MOST_TABLES).orderBy("org_key").first()
    if large:
        raise ValueError(f"environment {large['org_key']}: {large['n']} tables that wait for each other in different ways; "
                         f"at most {MOST_TABLES} can be ordered")
    inner_pairs = short.join(inner.select("org_key", F.col("t").alias("src")), ["org_key", "src"], "left_semi")
    ordered = _ordered(core, inner_pairs.unionByName(stands.select("org_key", F.col("t").alias("src"), F.explode("dsts").alias("dst"))))
    nothing = F.array().cast("array<string>")
    named = kinds.join(stands.select("org_key", "dsts", F.col("t").alias("_stand")), ["org_key", "dsts"])
    placed = ordered.select("org_key", F.col("t").alias("_stand"), "tier", "wave")
    rest = named.join(placed, ["org_key", "_stand"]).select("org_key", F.col("src").alias("t"), "tier", nothing.alias("given_up"), "wave")
    at_start = free.select("org_key", "t", F.lit(0).alias("tier"), nothing.alias("given_up"), F.lit(1).alias("wave"))
    return ordered.join(inner, here, "left_semi").unionByName(rest).unionByName(at_start)


def _order(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = ["org_key", "t", "tier", "given_up", "wave"]
    for batch in batches:
        rows = []
        for org, tables, edges in zip(batch["org_key"], batch["tables"], batch["edges"]):
            pairs = [] if edges is None else [(e["src"], e["dst"]) for e in edges]
            rows += [(org, *placed) for placed in order_tables({t["t"]: t["weight"] for t in tables}, pairs)]
        yield pd.DataFrame(rows, columns=names)


def order_tables(tables: Mapping[str, int], edges: Iterable[tuple[str, str]]) -> list[tuple[str, int, list[str], int]]:
    """(table, tier, dependencies given up, wave) of one environment, wave by wave; each table counts by its weight."""
    unmet = {t: set() for t in tables}
    needed_by = {t: set() for t in tables}
    waiting = dict.fromkeys(tables, 0)
    for src, dst in edges:
        if src in unmet and dst in unmet and dst not in unmet[src]:
            unmet[src].add(dst)
            needed_by[dst].add(src)
            waiting[dst] += tables[src]
    tier = dict.fromkeys(tables, 0)
    placed, wave, free = [], 0, [t for t in tables if not unmet[t]]
    while unmet:
        wave += 1
        hub = None
        if not free:
            hub = min(unmet, key=lambda t: (-waiting[t], len(unmet[t]), t.upper(), t))
            free = [hub]
        for t in free:
            given_up = sorted(unmet.pop(t))
            placed.append((t, tier[t], given_up, wave))
            for d in given_up:
                needed_by[d].discard(t)
                waiting[d] -= tables[t]
        ready = []
        for t in free:
            for src in needed_by[t]:
                tier[src] = max(tier[src], tier[t] + 1)
                unmet[src].discard(t)
                if not unmet[src]:
                    ready.append(src)
        free = ready
    return placed


def break_cycles(tables: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges to give up so that the rest has no cycle."""
    return load_tiers(tables, edges).dropped


def cycle_warnings(dropped: DataFrame) -> DataFrame:
    """One text per table that is placed before some of its lookup targets."""
    # one table's lookup targets: a short list
    per_table = dropped.groupBy("org_key", "round", F.col("src").alias("table")).agg(
        joined_names(F.collect_set("dst")).alias("targets"))
    # Fixed value: the wording of the warning.
    text = "Cycle: [%s] placed before its lookup target(s) [%s] - resolve those lookups with a deferred update pass."
    return per_table.select("org_key", "round", "table", F.format_string(text, "table", "targets").alias("warning"))


def dependency_diagram_edges(edges: DataFrame, dropped: DataFrame, tiers: DataFrame) -> DataFrame:
    """Edges with their status (kept, or deferred to the update pass) and the tiers they join."""
    given_up = dropped.select("org_key", "src", "dst", F.lit("deferred").alias("_status")).distinct()
    levels = tiers.select("org_key", fold("table").alias("t"), "tier")
    pairs = edges.select("org_key", fold("src").alias("src"), fold("dst").alias("dst")).distinct()
    rows = lookup_join(pairs, given_up, ["org_key", "src", "dst"])
    for end in ("src", "dst"):
        rows = lookup_join(rows, levels.select("org_key", F.col("t").alias(end), F.col("tier").alias(f"{end}_tier")),
                           ["org_key", end], "inner")
    return rows.select("org_key", "src", "dst", F.coalesce("_status", F.lit("kept")).alias("status"),
                       "src_tier", "dst_tier")
