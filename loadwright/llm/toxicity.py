"""Toxicity scores: FTRL-proximal logistic regression over hashed word n-grams and skip-grams."""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loadwright.llm.common import needed, written

# At most this many labelled documents are learned from: those whose ids have the smallest hashes.
SAMPLE = 20_000
EPOCHS = 4
BITS = 20
THRESHOLD = 0.7
ALPHA, BETA, L1, L2 = 4.0, 1.0, 4.0, 0.0

_WORD = re.compile(r"[^\W_]+")
_CACHED = 300_000
# Fixed odd multipliers that mix the hashes of words that stand together.
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], np.uint64)


class _Hashes(dict):
    """Word to 64-bit hash; forgets everything when it has grown to its bound."""

    def __missing__(self, word: str) -> int:
        if len(self) >= _CACHED:
            self.clear()
        self[word] = found = xxhash.xxh64_intdigest(word)
        return found


def features(text: str | None, hashes: _Hashes) -> np.ndarray:
    """Hashed single words, neighbours, and words one apart; repeats included, in lower case without punctuation."""
    h = np.array(list(map(hashes.__getitem__, _WORD.findall((text or "").lower()))), np.uint64)
    a, b, c, d = _MIX
    pairs = h[:-1] * a ^ h[1:] * b
    skips = h[:-2] * c ^ h[2:] * d
    return (np.concatenate([h * a, pairs * c, skips * b]) >> np.uint64(64 - BITS)).astype(np.int32)


class Weights(NamedTuple):
    """The nonzero weights, at most 2^BITS of them, and the intercept."""

    index: np.ndarray
    value: np.ndarray
    bias: float


def fit_stream(examples: Iterator[tuple[str | None, int]]) -> Weights:
    """One pass of FTRL-proximal; a feature counts once in a document.  Memory is that of the weights."""
    z, n = np.zeros(1 << BITS), np.zeros(1 << BITS)
    z0 = n0 = 0.0
    hashes = _Hashes()

    def weight(zi, ni):
        step = (BETA + np.sqrt(ni)) / ALPHA + L2
        return np.where(np.abs(zi) <= L1, 0.0, (np.sign(zi) * L1 - zi) / step)

    for text, label in examples:
        i = np.unique(features(text, hashes))
        zi, ni = z[i], n[i]
        w = weight(zi, ni)
        w0 = -z0 * ALPHA / (BETA + np.sqrt(n0))
        g = _sigmoid(w.sum() + w0) - label
        z[i] = zi + g - (np.sqrt(ni + g * g) - np.sqrt(ni)) / ALPHA * w
        n[i] = ni + g * g
        z0 += g - (np.sqrt(n0 + g * g) - np.sqrt(n0)) / ALPHA * w0
        n0 += g * g
    w = weight(z, n)
    index = np.flatnonzero(w)
    return Weights(index, w[index], float(-z0 * ALPHA / (BETA + np.sqrt(n0))))


def _sigmoid(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -40.0, 40.0)))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, epochs: int = EPOCHS) -> Weights:
    """Learn ``labels`` (doc_id, toxic) from ``docs`` (doc_id, text).

    Labels that are neither 0 nor 1 and null ids are left out; an id labelled twice is toxic if one label says so,
    and of several texts with one id the one with the smallest hash is learned.  The sample is bounded by its
    rows, so it is broadcast to find its texts and learned from in one task, as a stream.
    """
    spark = docs.sparkSession
    chosen = (
        needed(labels, "doc_id", "toxic").where("doc_id IS NOT NULL AND toxic IN (0, 1)")
        .groupBy("doc_id").agg(F.max("toxic").alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    )
    texts = (
        needed(docs, "doc_id", "text").join(F.broadcast(chosen), "doc_id")
        .groupBy("doc_id", "label").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    )
    rounds = F.explode(F.sequence(F.lit(1), F.lit(epochs))).alias("round")
    ordered = (
        texts.select("doc_id", "label", "text", rounds).repartition(1)
        .sortWithinPartitions("round", F.xxhash64("doc_id", "round"), "doc_id")
    )

    def learn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found = fit_stream(pair for b in batches for pair in zip(b["text"], b["label"]))
        yield pd.DataFrame({"index": [-1, *found.index], "value": [found.bias, *found.value]})

    learned = ordered.select("text", "label").mapInPandas(learn, "index int, value double")
    # at most 2^BITS + 1 rows
    table = written(learned, "toxicity-weights").toPandas().sort_values("index")
    bias = table.loc[table["index"] < 0, "value"].sum()
    table = table[table["index"] >= 0]
    return Weights(table["index"].to_numpy(np.int32), table["value"].to_numpy(float), float(bias))


def score(text: Column, weights: Weights) -> Column:
    """Probability of label 1 for whole texts; a text without words gets that of the intercept, as does null."""

    @F.pandas_udf("double")
    def of_batch(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        dense, hashes = np.zeros(1 << BITS), _Hashes()
        dense[weights.index] = weights.value
        for texts in batches:
            yield pd.Series([one(t, dense, hashes) for t in texts], dtype="float64")

    def one(text: str | None, dense: np.ndarray, hashes: _Hashes) -> float:
        i = features(text, hashes)
        hit = np.unique(i[dense[i] != 0.0])
        return _sigmoid(dense[hit].sum() + weights.bias)

    return of_batch(text)


def is_held_out(doc_id: Column) -> Column:
    """Ids whose labels are never learned."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted for every row of ``docs``, ids null or repeated included.

    Without any usable label all scores are 0.5.
    """
    weights = fit(docs, labels.where(~is_held_out(labels["doc_id"])))
    scored = needed(docs, "doc_id", "text").withColumn("score", score(F.col("text"), weights))
    return scored.select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), "score",
                         (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose score stays below the threshold, with all their columns."""
    weights = fit(docs, labels.where(~is_held_out(labels["doc_id"])))
    return docs.where(score(docs["text"], weights) < THRESHOLD)
