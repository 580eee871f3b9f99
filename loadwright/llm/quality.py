"""Quality scores: learned vectors of hashed words and character n-grams, averaged over a document, under a softmax."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loadwright.llm.common import needed, written

# At most this many labelled documents are learned from: those whose ids have the smallest hashes.
SAMPLE = 6_000
EPOCHS = 3
BITS = 18
DIM = 16
# Lengths of character n-grams; the space on either side of a word belongs to it.
SHORTEST, LONGEST = 2, 4
# The bucket of a pair of neighbours that are the same word, whichever word it is.
AGAIN = 0
RATE = 0.5
THRESHOLD = 0.7
# Code points that are looked at together: bounds the memory that a very long text takes.
STRETCH = 1 << 20

# Fixed odd numbers that mix hashes; the last is the base of the words' polynomial.
_SPREAD, _STEP, _BASE = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), 0x165667B19E3779F9
_INVERSE = pow(_BASE, -1, 1 << 64)


def _stretches(text: str | None) -> Iterator[np.ndarray]:
    """Code points, space between words, of whole words; about ``STRETCH`` of them at a time."""
    words, size = [], 0
    for word in (text or "").split():
        words.append(word)
        size += len(word) + 1
        if size >= STRETCH:
            yield _codes(words)
            words, size = [], 0
    if words:
        yield _codes(words)


def _codes(words: list[str]) -> np.ndarray:
    flat = f" {' '.join(words)} "
    return np.frombuffer(flat.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)


def _bucket(hashes: np.ndarray) -> np.ndarray:
    return ((hashes ^ hashes >> np.uint64(29)) * _SPREAD >> np.uint64(64 - BITS)).astype(np.int32)


def _stretch_features(codes: np.ndarray) -> np.ndarray:
    space = codes == 32
    starts = np.flatnonzero(space[:-1]) + 1
    powers = np.cumprod(np.full(len(codes), _BASE, np.uint64), dtype=np.uint64)
    back = np.cumprod(np.full(len(codes), _INVERSE, np.uint64), dtype=np.uint64)
    words = np.add.reduceat(np.where(space, np.uint64(0), codes + np.uint64(1)) * powers, starts) * back[starts]
    again = np.count_nonzero(words[1:] == words[:-1])
    out = [_bucket(words * _STEP), np.full(again, AGAIN, np.int32)]
    h = (codes + np.uint64(1)) * _SPREAD
    for n in range(2, LONGEST + 1):
        h = (h[:-1] ^ h[:-1] >> np.uint64(31)) * _STEP + codes[n - 1:]
        if n >= SHORTEST:
            # inside there is no space: an n-gram belongs to one word
            inside = np.ones(len(h), bool)
            for k in range(1, n - 1):
                inside &= ~space[k:k + len(h)]
            if n == 2:
                inside &= ~(space[:-1] & space[1:])
            out.append(_bucket(h[inside] + np.uint64(n)))
    return np.concatenate(out)


class Features(NamedTuple):
    """Distinct buckets, how often each occurs, and all occurrences."""

    index: np.ndarray
    count: np.ndarray
    total: int


def features(text: str | None) -> Features:
    """Hashed words, repeats of the word before and character n-grams of a whole text, case and punctuation included."""
    index, count = np.zeros(0, np.int32), np.zeros(0, np.int64)
    for codes in _stretches(text):
        more, n = np.unique(_stretch_features(codes), return_counts=True)
        if len(index):
            index, at = np.unique(np.concatenate([index, more]), return_inverse=True)
            count = np.bincount(at, np.concatenate([count, n])).astype(np.int64)
        else:
            index, count = more, n
    return Features(index, count, int(count.sum()))


class Model(NamedTuple):
    """Per bucket, what one occurrence adds to the log odds of label 1 before they are averaged; and the intercept."""

    index: np.ndarray
    value: np.ndarray
    bias: float


def fit_stream(examples: Iterator[tuple[str | None, int]], steps: int) -> Model:
    """Stochastic gradient descent over ``steps`` examples, at a rate that falls to zero.

    A document is the average of its features' vectors, the output a softmax over two classes.  Memory is that of the
    vectors.  The model that comes back is folded: averaging and output are linear, so of each vector only its
    product with the difference of the two output vectors is needed.
    """
    rng = np.random.default_rng(0)
    vectors = rng.uniform(-1 / DIM, 1 / DIM, (1 << BITS, DIM))
    output, bias = rng.uniform(-1 / DIM, 1 / DIM, (2, DIM)), np.zeros(2)
    seen = np.zeros(1 << BITS, bool)
    for step, (text, label) in enumerate(examples):
        found = features(text)
        rate = RATE * max(1 - step / steps, 0.0)
        share = found.count / max(found.total, 1)
        hidden = share @ vectors[found.index]
        odds = output @ hidden + bias
        p = np.exp(odds - odds.max())
        wrong = p / p.sum() - np.array([label == 0, label == 1], float)
        toward = wrong @ output
        output -= rate * np.outer(wrong, hidden)
        bias -= rate * wrong
        # scaled so that the average moves by the rate, however many features share it: long texts teach as much
        vectors[found.index] -= np.outer(share * (rate / max(share @ share, 1e-12)), toward)
        seen[found.index] = True
    index = np.flatnonzero(seen)
    return Model(index, vectors[index] @ (output[1] - output[0]), float(bias[1] - bias[0]))


def _sigmoid(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -40.0, 40.0)))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, epochs: int = EPOCHS) -> Model:
    """Learn ``labels`` (doc_id, quality) from ``docs`` (doc_id, text).

    Labels that are neither 0 nor 1 and null ids are left out; an id labelled twice is of low quality if one label
    says so, and of several texts with one id the one with the smallest hash is learned.  The sample is bounded by its
    rows, so it is broadcast to find its texts and learned from in one task, as a stream.
    """
    chosen = (
        needed(labels, "doc_id", "quality").where("doc_id IS NOT NULL AND quality IN (0, 1)")
        .groupBy("doc_id").agg(F.min("quality").alias("label"))
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
    steps = epochs * max(chosen.count(), 1)

    def learn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found = fit_stream((pair for b in batches for pair in zip(b["text"], b["label"])), steps)
        yield pd.DataFrame({"index": [-1, *found.index], "value": [found.bias, *found.value]})

    learned = ordered.select("text", "label").mapInPandas(learn, "index int, value double")
    # at most 2^BITS + 1 rows
    table = written(learned, "quality-model").toPandas().sort_values("index")
    bias = table.loc[table["index"] < 0, "value"].sum()
    table = table[table["index"] >= 0]
    return Model(table["index"].to_numpy(np.int32), table["value"].to_numpy(float), float(bias))


def score(text: Column, model: Model) -> Column:
    """Probability of label 1 for whole texts; a text without words gets that of the intercept, as does null."""

    @F.pandas_udf("double")
    def of_batch(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        dense = np.zeros(1 << BITS)
        dense[model.index] = model.value
        for texts in batches:
            yield pd.Series([one(t, dense) for t in texts], dtype="float64")

    def one(text: str | None, dense: np.ndarray) -> float:
        total, n = 0.0, 0
        for codes in _stretches(text):
            index = _stretch_features(codes)
            total, n = total + dense[index].sum(), n + len(index)
        return _sigmoid(total / max(n, 1) + model.bias)

    return of_batch(text)


def is_held_out(doc_id: Column) -> Column:
    """Ids whose labels are never learned."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted for every row of ``docs``, ids null or repeated included.

    Without any usable label all scores are 0.5.  An empty ``docs`` gives no rows.
    """
    model = fit(docs, labels.where(~is_held_out(labels["doc_id"])))
    scored = needed(docs, "doc_id", "text").withColumn("score", score(F.col("text"), model))
    return scored.select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), "score",
                         (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose score reaches the threshold, with all their columns."""
    model = fit(docs, labels.where(~is_held_out(labels["doc_id"])))
    return docs.where(score(docs["text"], model) >= THRESHOLD)
