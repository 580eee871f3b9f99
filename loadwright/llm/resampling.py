"""Resampling towards a target: n-gram spans by overlapped regex scans, hashed importance weights, a draw without replacement."""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loadwright.llm.common import needed, running_sums, written

BUCKETS = 10_000
LONGEST = 3
MIN_WORDS = 20
PERCENT = 5
SEED = 42
HASHES = 1 << 32

# Bytes that end a word; what is left of ASCII are digits and lower-case letters.
_SEPARATORS = bytes([*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)])
_UPPER = bytes(range(0x41, 0x5B))
_TABLE = bytes.maketrans(_SEPARATORS + _UPPER, b" " * len(_SEPARATORS) + _UPPER.lower())
# One pattern for each length.  A run starts after a space, which \K looks back over sooner than a lookbehind would, and
# ends before one; no word gives back a part of itself.
_RUNS = [regex.compile(rb" \K[^ ]++" + rb" [^ ]++" * more + rb"(?= )") for more in range(LONGEST)]


class Grams(NamedTuple):
    n_words: int
    buckets: np.ndarray


def grams(text: bytes | None) -> Grams:
    """Words of a UTF-8 text, and the bucket of each run of 1 to 3 of them, repeats included."""
    words = (text or b"").translate(_TABLE).split()
    flat = b" " + b" ".join(words) + b" "
    runs = [
        np.fromiter((zlib.crc32(m[0]) for m in run.finditer(flat, overlapped=True)), np.uint32, max(len(words) - more, 0))
        for more, run in enumerate(_RUNS)]
    return Grams(len(words), (np.concatenate(runs) % BUCKETS).astype("<u2"))


def with_grams(df: DataFrame) -> DataFrame:
    """Adds n_words, n_features and ``buckets``, two bytes a feature, by ``text``; one scan of every whole text."""

    @F.pandas_udf("n_words long, n_features long, buckets binary")
    def scan(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            found = [grams(t) for t in texts]
            yield pd.DataFrame({
                "n_words": [g.n_words for g in found], "n_features": [len(g.buckets) for g in found],
                "buckets": [g.buckets.tobytes() for g in found]}, columns=["n_words", "n_features", "buckets"])

    return df.select(*df.columns, scan(F.col("text").cast("binary")).alias("_g")).select(*df.columns, "_g.*")


def bucket_counts(scanned: DataFrame) -> np.ndarray:
    """Features of all rows in each bucket.  A task sends one row for each bucket that it met, and the driver gets
    one for each bucket there is.
    """

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for buckets in batch["buckets"]:
                total += np.bincount(np.frombuffer(buckets, "<u2"), minlength=BUCKETS)
        met = np.flatnonzero(total)
        yield pd.DataFrame({"bucket": met.astype(np.int32), "n": total[met]})

    rows = scanned.select("buckets").mapInPandas(count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    found = rows.toPandas()
    counts = np.zeros(BUCKETS, np.int64)
    counts[found["bucket"].to_numpy(np.int64)] = found["n"].to_numpy(np.int64)
    return counts


def bucket_gains(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of the two smoothed distributions, rounded down."""
    all_raw, all_target = int(raw.sum()), int(target.sum())
    return np.array([
        math.floor(1000 * math.log((float(t + 1) * float(all_target_side)) / (float(s + 1) * float(all_raw_side))))
        for s, t, all_target_side, all_raw_side in (
            (int(s), int(t), all_raw + BUCKETS, all_target + BUCKETS) for s, t in zip(raw, target))], np.int64)


def score_documents(docs: DataFrame, target: DataFrame) -> DataFrame:
    """doc_id, n_features, weight, score and rank for every row of ``docs``, drawn towards the texts of ``target``.

    Weight is the sum of the gains of a document's features, score adds a Gumbel number made of the id, so the highest
    scores are a draw without replacement.  Of the rows with at least ``MIN_WORDS`` words ``PERCENT`` in a hundred
    get a rank.  Null and empty texts have no features and weight 0; a null id counts as an empty one, and comes first among ties.
    Repeated rows are drawn one by one.  An empty ``target`` or ``docs`` counts as no features at all.

    Texts are scanned once; the features are stored, counted, and summed again once the gains are known.
    """
    scanned = written(with_grams(needed(docs, "doc_id", "text")).drop("text"), "importance-features")
    aimed = with_grams(needed(target, "text")).drop("text")
    gains = bucket_gains(bucket_counts(scanned), bucket_counts(aimed))

    @F.pandas_udf("long")
    def weigh(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for rows in batches:
            yield pd.Series([int(gains[np.frombuffer(b, "<u2")].sum()) for b in rows], dtype="int64")

    name = F.concat(F.lit(f"{SEED}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(name, 256), 1, 8), 16, 10).cast("long")
    noise = F.floor(-1000 * F.log(-F.log((h + F.lit(0.5)) / F.lit(float(HASHES)))))
    scored = scanned.select(
        "doc_id", "n_features", (F.col("n_words") >= MIN_WORDS).alias("enough"), weigh("buckets").alias("weight")
    ).withColumn("score", F.col("weight") + noise)
    order = [F.col("enough").desc(), F.col("score").desc(), F.col("doc_id"), F.col("n_features"), F.col("weight")]
    placed = running_sums(scored, order, {"before": F.lit(1).cast("long")})
    # one row
    drawn = scanned.agg((F.count_if(F.col("n_words") >= MIN_WORDS) * PERCENT / 100).cast("long").alias("drawn"))
    chosen = F.col("enough") & (F.col("before") < F.col("drawn"))
    return placed.join(F.broadcast(drawn)).select(
        "doc_id", "n_features", "weight", "score", F.when(chosen, F.col("before") + 1).alias("rank"))


def resample(docs: DataFrame, target: DataFrame) -> DataFrame:
    """The rows of ``docs``, with all their columns, whose ids are drawn; rows that share a drawn id stay together."""
    drawn = score_documents(docs, target).where("rank IS NOT NULL").select(F.col("doc_id").alias("_drawn")).distinct()
    return docs.join(drawn, docs["doc_id"].eqNullSafe(drawn["_drawn"]), "left_semi")
