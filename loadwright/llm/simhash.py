"""SimHash fingerprints, and near duplicates by covering locality-sensitive hashing."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import accumulate, combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loadwright.llm.common import components, needed, written
from loadwright.operators.skew import merge_join

SHINGLE, RADIUS, SEED = 4, 4, 42

# Members of a bucket are compared with each other up to this size.  Beyond it they meet at shared midpoints,
# which finds the same links and grows with the members, not with their pairs.
DENSE = 4096

_BLOCK = 255 * 256


def simhash(data: bytes | None, shingle: int = SHINGLE) -> int:
    """Bit i is set if it is set in over half of the shingles' hashes; 0 without words.  Signed 64 bits."""
    words = (data or b"").lower().split()
    if not words:
        return 0
    joined, ends = b" ".join(words), list(accumulate(len(w) + 1 for w in words))
    last = ends[shingle - 1:] or ends[-1:]
    digest = xxhash.xxh64_intdigest
    return _majority([digest(joined[a:b - 1], SEED) for a, b in zip([0, *ends], last)])


def _majority(hashes: Sequence[int] | np.ndarray) -> int:
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), _BLOCK):
        block = np.array(hashes[at:at + _BLOCK], ">u8")
        bits = np.unpackbits(block.view(np.uint8)).reshape(-1, 64)
        parts = np.add.reduceat(bits, np.arange(0, len(bits), 255), axis=0, dtype=np.uint8)
        counts += parts.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > len(hashes)).tobytes(), "big", signed=True)


def add_fingerprint(docs: DataFrame, name: str, shingle: int = SHINGLE) -> DataFrame:
    """Whole texts' fingerprints in a long column; a null text has no words."""

    @F.pandas_udf("long")
    def of_batch(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([simhash(t, shingle) for t in texts], dtype="int64")

    return docs.withColumn(name, of_batch(F.col("text").cast("binary")))


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def covering_masks(radius: int) -> list[int]:
    """2^(radius+1) - 1 masks; for any set of at most ``radius`` bits some mask holds none of them.

    Bit i has a nonzero vector m(i) of radius + 1 bits, and mask v holds the bits whose m(i) has odd overlap with
    v.  The vectors of ``radius`` bits span less than the space, so some v is orthogonal to all of them.
    """
    full = (1 << (radius + 1)) - 1
    return [sum(1 << i for i in range(64) if (v & (1 + i % full)).bit_count() % 2) for v in range(1, full + 1)]


def fingerprint_links(prints: DataFrame, radius: int = RADIUS, dense: int = DENSE) -> DataFrame:
    """(a, b): links that connect the distinct fingerprints ``fp`` just as all pairs within ``radius`` bits do.

    Each pair within the radius agrees on the bits of some mask.  Buckets of more than ``dense`` fingerprints,
    which agree on some 32 bits, give star links around shared midpoints in place of their pairs.
    """
    masks = covering_masks(radius)
    table = F.array(*(F.lit(_signed(m)) for m in masks))
    keyed = prints.select("fp", F.posexplode(table).alias("t", "mask")).select(
        "fp", F.col("t").cast("tinyint").alias("t"), F.col("fp").bitwiseAND(F.col("mask")).alias("key"))
    sizes = keyed.groupBy("t", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    shared = written(merge_join(keyed, sizes, ["t", "key"], "inner"), "simhash-buckets")

    few = shared.where(F.col("n") <= dense)
    left, right = few.select("t", "key", F.col("fp").alias("a")), few.select("t", "key", F.col("fp").alias("b"))
    close = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius
    same = (left["t"] == right["t"]) & (left["key"] == right["key"]) & (F.col("a") < F.col("b"))
    compared = left.join(right.hint("merge"), same & close).select("a", "b")

    # at most 2^(radius+1) - 1 rows, each with the ways to flip half the radius of the bits outside its mask
    reach = [(radius + 1) // 2, radius // 2]
    flips = prints.sparkSession.createDataFrame(
        [(t, _flips(mask, reach[0])) for t, mask in enumerate(masks)], "t tinyint, flips array<bigint>")
    met = shared.where(F.col("n") > dense).join(F.broadcast(flips), "t").select(
        "t", "key", "fp", F.explode("flips").alias("flip")).select(
        "fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("middle"),
        (F.bit_count("flip") <= reach[1]).alias("near"))
    # all within the larger half are within the radius of any one within the smaller half
    centre = met.where("near").groupBy("middle").agg(F.min("fp").alias("b"))
    stars = merge_join(met, centre, ["middle"], "inner").where("fp <> b").select(F.col("fp").alias("a"), "b")
    return compared.union(stars)


def _flips(mask: int, reach: int) -> list[int]:
    free = [i for i in range(64) if not mask >> i & 1]
    return [_signed(sum(1 << i for i in bits)) for n in range(reach + 1) for bits in combinations(free, n)]


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS, dense: int = DENSE) -> DataFrame:
    """doc_id, fp (long), component_id: the smallest doc_id reachable over fingerprints ``radius`` bits apart or less.

    Keeps one row for each input row.  Null and empty texts have fingerprint 0.  Null ids take part in their
    class but never name it, unless all ids of the class are null.  An empty table gives no rows.
    """
    prints = written(add_fingerprint(needed(docs, "doc_id", "text"), "fp", shingle).select("doc_id", "fp"), "simhash")
    return classes(prints, radius, dense)


def classes(prints: DataFrame, radius: int = RADIUS, dense: int = DENSE) -> DataFrame:
    """``near_duplicates`` for written rows (doc_id, fp)."""
    return _classed(prints, radius, dense).select("doc_id", "fp", "component_id")


def _classed(prints: DataFrame, radius: int, dense: int) -> DataFrame:
    distinct = written(prints.groupBy("fp").agg(F.min("doc_id").alias("first")), "simhash-distinct")
    roots = components(fingerprint_links(distinct.select("fp"), radius, dense), "simhash-components")
    linked = merge_join(distinct, roots.withColumnRenamed("node", "fp"), ["fp"], "left").select(
        "fp", "first", F.coalesce("root", "fp").alias("root"))
    named = linked.groupBy("root").agg(F.min("first").alias("component_id"))
    known = merge_join(linked, named, ["root"], "inner").select("fp", "root", "component_id")
    return merge_join(prints, known, ["fp"], "inner")


def keep_one(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS, dense: int = DENSE) -> DataFrame:
    """``docs`` with one row of each class left: that of the smallest id, of several such rows the one whose text
    has the smallest hash.  Null ids come last, so a class whose ids are all null keeps one row as well.
    """
    hashed = docs.withColumn("_text", F.xxhash64("text"))
    prints = written(add_fingerprint(hashed.select("doc_id", "text", "_text"), "fp", shingle).select(
        "doc_id", "_text", "fp"), "simhash")
    best = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "_text"))
    kept = _classed(prints, radius, dense).groupBy("root").agg(best.alias("best")).select(
        F.col("best.doc_id").alias("_id"), F.col("best._text").alias("_kept"))
    met = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_text") == F.col("_kept"))
    repeats = Window.partitionBy("doc_id", "_text").orderBy("_text")
    return (hashed.join(kept, met, "left_semi").withColumn("_nth", F.row_number().over(repeats))
            .where("_nth = 1").select(*docs.columns))


# The pipeline's stage: near copies have this Jaccard similarity of their sets of shingles of so many words.
STAGE_SHINGLE, STAGE_SIMILARITY = 5, 0.8

# (shingles in a sample, samples): at 0.8 two sets agree in none of the samples once in 5,000 pairs.
SAMPLES = (4, 16)

_PART = 4096
_STEP = np.uint64(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(31)) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ x >> np.uint64(29)


def _shingles(data: bytes | None, shingle: int) -> np.ndarray:
    """The different hashes of all runs of ``shingle`` words in lower case, or of all words if there are fewer."""
    words = (data or b"").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined, ends = b" ".join(words), list(accumulate(len(w) + 1 for w in words))
    last = ends[shingle - 1:] or ends[-1:]
    digest = xxhash.xxh64_intdigest
    return np.unique(np.array([digest(joined[a:b - 1], SEED) for a, b in zip([0, *ends], last)], np.uint64))


def _sample_keys(found: np.ndarray) -> np.ndarray:
    size, samples = SAMPLES
    salt = _mixed(np.arange(1, 2 * size * samples + 1, dtype=np.uint64)).reshape(2, -1, 1)
    least = np.full(size * samples, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(found), _PART):
        # the low bits of a product are weak; shifted out
        hashed = (found[at:at + _PART] * (salt[0] | np.uint64(1)) + salt[1]) >> np.uint64(16)
        np.minimum(least, hashed.min(axis=1), out=least)
    key = np.arange(samples, dtype=np.uint64)
    for one in least.reshape(samples, size).T:
        key = _mixed(key * _STEP ^ one)
    return key.view(np.int64)


def _similar(pairs: DataFrame, docs: DataFrame, sets: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """(a, b): those pairs of sets that have the similarity; texts are fetched for these only."""

    @F.pandas_udf("array<long>")
    def of_batch(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([_shingles(t, shingle).view(np.int64) for t in texts])

    pairs = written(pairs.distinct(), "simhash-pairs")
    wanted = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    texts = docs.select("_text", "text").join(sets.join(wanted, "node").select("node", "_text"), "_text").dropDuplicates(["node"])
    found = written(texts.select("node", of_batch(F.col("text").cast("binary")).alias("s")), "simhash-shingles")
    both = pairs.join(found.toDF("a", "x"), "a").join(found.toDF("b", "y"), "b").withColumn(
        "common", F.size(F.array_intersect("x", "y")))
    return both.where(F.col("common") >= (F.size("x") + F.size("y") - F.col("common")) * similarity - 1e-9).select("a", "b")


def _similar_links(docs: DataFrame, sets: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """(a, b): links that connect the sets just as all compared pairs at the similarity do.

    A bucket holds the sets of one sample's key or of one class of fingerprints.  Each set is compared with the smallest of
    each of its buckets first; then pairs of a bucket that are still apart.
    """
    classed = classes(sets.select(F.col("node").alias("doc_id"), "fp"))
    keyed = sets.select("node", F.explode("keys").alias("key")).union(classed.select("doc_id", F.xxhash64("component_id")))
    sizes = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("lead")).where("n > 1")
    shared = written(keyed.join(sizes, "key"), "simhash-shared")
    stars = shared.where("node <> lead").select(F.col("node").alias("a"), F.col("lead").alias("b"))
    links = written(_similar(stars, docs, sets, shingle, similarity), "simhash-links")
    roots = components(links, "simhash-stars")
    rooted = written(shared.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")), "simhash-rooted")
    mixed = rooted.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high")
    apart, parts = rooted.join(mixed, "key", "left_semi"), F.ceil(F.col("n") / _PART)
    left = apart.select("key", F.col("node").alias("a"), F.col("root").alias("p"),
                        F.pmod(F.xxhash64("node"), parts).cast("int").alias("part"))
    right = apart.select("key", F.col("node").alias("b"), F.col("root").alias("q"),
                         F.explode(F.sequence(F.lit(0), (parts - 1).cast("int"))).alias("part"))
    rest = left.join(right, ["key", "part"]).where("a < b AND p <> q").select("a", "b")
    return links.union(_similar(rest, docs, sets, shingle, similarity))


def keep_one_similar(docs: DataFrame, shingle: int = STAGE_SHINGLE, similarity: float = STAGE_SIMILARITY) -> DataFrame:
    """``docs`` with one row left of each class of texts that hang together at the Jaccard similarity of their shingles.

    Texts meet by the SimHash of their different shingles, within ``RADIUS`` bits as in ``near_duplicates``.  At the
    similarity most fingerprints are further apart than that, so they also meet in samples of shingles; what meets is
    compared exactly.  The row is chosen as by ``keep_one``.  Texts without words are one class.
    """

    @F.pandas_udf("node binary, fp long, keys array<long>")
    def of_batch(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            found = [_shingles(t, shingle) for t in texts]
            yield pd.DataFrame({"node": [xxhash.xxh128_digest(f.tobytes()) for f in found],
                                "fp": np.array([_majority(f) if len(f) else 0 for f in found], np.int64),
                                "keys": [_sample_keys(f) if len(f) else np.zeros(0, np.int64) for f in found]})

    hashed = docs.withColumn("_text", F.xxhash64("text"))
    rows = written(hashed.select("doc_id", "_text", of_batch(F.col("text").cast("binary")).alias("_set")).select(
        "doc_id", "_text", "_set.*"), "simhash-sets")
    sets = written(rows.dropDuplicates(["node"]).select("node", "_text", "fp", "keys"), "simhash-distinct-sets")
    texts = hashed.select("_text", "text")
    roots = components(_similar_links(texts, sets, shingle, similarity), "simhash-similar")
    best = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "_text"))
    kept = rows.select("doc_id", "_text", "node").join(roots, "node", "left").groupBy(
        F.coalesce("root", "node").alias("root")).agg(best.alias("best")).select(
        F.col("best.doc_id").alias("_id"), F.col("best._text").alias("_kept"))
    met = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_text") == F.col("_kept"))
    repeats = Window.partitionBy("doc_id", "_text").orderBy("_text")
    return (hashed.join(kept, met, "left_semi").withColumn("_nth", F.row_number().over(repeats))
            .where("_nth = 1").select(*docs.columns))
