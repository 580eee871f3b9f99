"""Mixing sources to target weights by systematic sampling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loadwright.llm.common import running_sums, word_count, written

# Source weights by rank of the source, repeating; the mix in parts of all words; the most copies of a source.
WEIGHTS, SHARE, MOST = (3, 1, 2), 1.5, 2.0

# Offsets tried for each source.
PHASES = 32


def source_targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE,
                   most: float = MOST) -> DataFrame:
    """Adds ``target`` to one row per source (source, source_size).

    Sources take weights in code point order, null last, and divide ``share`` of all words by weight.  None gets
    more than ``most`` times its words: what is over goes to the others by weight until none is above.  That end
    is a level: each gets the lesser of its limit and level x weight, and the level follows from the sources
    in order of limit / weight.  A source without words has target 0.

    The windows below run over one row per source.
    """
    ranked = Window.orderBy(F.col("source").isNull(), "source")
    turn = (F.row_number().over(ranked) - 1) % len(weights)
    listed = F.array(*(F.lit(float(w)) for w in weights))
    limits = sizes.withColumn("_weight", F.get(listed, turn)).withColumn("_limit", F.col("source_size") * F.lit(most))
    everything = Window.partitionBy()
    by_limit = Window.orderBy(F.col("_limit") / F.col("_weight"), F.col("source").isNull(), "source")
    earlier = by_limit.rowsBetween(Window.unboundedPreceding, -1)
    left = F.sum("source_size").over(everything) * F.lit(share) - F.coalesce(F.sum("_limit").over(earlier), F.lit(0.0))
    open_weight = F.sum("_weight").over(everything) - F.coalesce(F.sum("_weight").over(earlier), F.lit(0.0))
    # the level if just the earlier sources stopped at their limits: never above the true one, and equal for one
    level = limits.withColumn("_level", left / open_weight)
    return level.withColumn("_top", F.max("_level").over(everything)).select(
        "source", "source_size", F.least(F.col("_limit"), F.col("_top") * F.col("_weight")).alias("target"))


def offset(source: Column, seed: str) -> Column:
    """One number in [0, 1) for a source, the same in every run."""
    text = F.concat(F.lit(seed), F.coalesce(F.concat(F.lit("s"), source), F.lit("n")))
    return F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def plan_copies(docs: DataFrame, seed: str = "mix", **how) -> DataFrame:
    """doc_id, source, size, source_size, target, copies: how often the mix takes each row of ``docs``.

    Rows of a source stand in order of size, then id, then hash; each expects target / source_size copies.
    Their running sum starts at one random offset for the source, and a row is taken once for each integer that
    its own share crosses.  Of ``PHASES`` offsets, spread evenly from a random one, the source has that which
    brings its words nearest to the target.
    Null texts have size 0; null sources are one source.
    """
    slim = written(_keyed(docs).select("doc_id", "source", word_count(docs["text"]).alias("size"), "_key"), "mixing-sizes")
    sizes = slim.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = source_targets(sizes, **how)
    order = [F.col("source").isNull(), F.col("source"), F.col("size"), F.col("doc_id"), F.col("_key")]
    placed = written(running_sums(slim, order, {"_before": F.lit(1).cast("long")}), "mixing-order")
    starts = placed.groupBy("source").agg(F.min("_before").alias("_start"))
    known = targets.join(starts.withColumnRenamed("source", "_named"), F.col("source").eqNullSafe(F.col("_named"))).select(
        F.col("source").alias("_source"), "source_size", "target", "_start",
        (F.col("target") / F.greatest("source_size", F.lit(1))).alias("_rate"), offset(F.col("source"), seed).alias("_offset"))
    same = F.col("source").eqNullSafe(F.col("_source"))
    rank = F.col("_before") - F.col("_start")

    def copies(phase: Column) -> Column:
        at = lambda n: F.floor(F.col("_offset") + phase / F.lit(float(PHASES)) + n * F.col("_rate"))
        return (at(rank + 1) - at(rank)).cast("int")

    tried = placed.join(known, same).groupBy("_source", "target").agg(
        *(F.sum(copies(F.lit(float(k))) * F.col("size")).alias(f"_taken_{k}") for k in range(PHASES)))
    misses = F.array(*(F.struct(F.abs(F.col(f"_taken_{k}") - F.col("target")), F.lit(float(k)).alias("phase"))
                       for k in range(PHASES)))
    phases = tried.select(F.col("_source").alias("_tried"), F.array_min(misses)["phase"].alias("_phase"))
    chosen = known.join(phases, F.col("_source").eqNullSafe(F.col("_tried")))
    return placed.join(chosen, same).select(
        "doc_id", "source", "_key", "size", "source_size", "target", copies(F.col("_phase")).alias("copies"))


def mix(docs: DataFrame, seed: str = "mix", **how) -> DataFrame:
    """``docs`` with each row repeated as often as the mix takes it, rows that it does not take left out.

    Rows that agree in all of id, source and text share their copies evenly.
    """
    copies = plan_copies(docs, seed, **how).where("copies > 0").groupBy("_key", F.col("doc_id").alias("_id")).agg(
        F.sum("copies").alias("_copies"))
    alike = Window.partitionBy("_key", "_id")
    dealt = (
        _keyed(docs).join(copies, "_key").where(F.col("doc_id").eqNullSafe(F.col("_id")))
        .withColumn("_rows", F.count(F.lit(1)).over(alike))
        .withColumn("_nth", F.row_number().over(alike.orderBy("_key")))
    )
    share = lambda n: F.floor(n * F.col("_copies") / F.col("_rows"))
    each = (share(F.col("_nth")) - share(F.col("_nth") - 1)).cast("int")
    return dealt.withColumn("_each", each).where("_each > 0").withColumn(
        "_copy", F.explode(F.sequence(F.lit(1), F.col("_each")))).select(*docs.columns)


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.withColumn("_key", F.xxhash64("doc_id", "source", "text"))
