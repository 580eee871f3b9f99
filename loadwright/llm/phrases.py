"""Phrases that stand together more often than chance: counts by prefix-free parsing, cuts scored exactly."""

from __future__ import annotations

import re
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loadwright.llm.common import needed, written
from loadwright.sources.scratch import cut

LONGEST = 5
LEAST = 100
TOP = 2_000
NO_LANG = "und"
# One word in this many, by its hash, begins a new chunk.
TRIGGER = 20
# A chunk shows the words of every n-gram that starts in it, so it overlaps the next one by so many.
OVERLAP = LONGEST - 1
# A bit table of frequent hashes has 16 bits for each, between these bounds: 8 KB and 16 MB.
LEAST_BITS, MOST_BITS = 16, 27

_BREAK = re.compile(rb"[.,;:!?\x0A-\x0D]+")
# What a task holds before it hands it on: counted texts, and hashes; chunks that it looks at together; and words whose
# hashes it remembers.
_HELD, _HASHES_HELD, _TOGETHER = 100_000, 2_000_000, 8_192
_CACHED = 300_000
_PARTS = 64
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def chunks(text: bytes | None) -> Iterator[bytes]:
    """Prefix-free parse of every piece of a UTF-8 text: its chunks, each the words that are its own, then, after a tab,
    up to ``OVERLAP`` words of the next ones, if any.

    A chunk begins at the start of its piece and at each trigger, whatever stands before, so equal passages fall into
    equal chunks.  Every word is an own word of one chunk.
    """
    for piece in _BREAK.split((text or b"").lower()):
        words = piece.split()
        start = 0
        for i in [i for i, w in enumerate(words) if zlib.crc32(w) % TRIGGER == 0 and i]:
            yield b" ".join(words[start:i]) + b"\t" + b" ".join(words[i:i + OVERLAP])
            start = i
        if words:
            yield b" ".join(words[start:] if start else words)


def parse(docs: DataFrame) -> DataFrame:
    """The dictionary of the parse: lang, chunk and ``freq``, how often the chunk occurs in that language."""

    def cut_up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[str, Counter] = defaultdict(Counter)
        for batch in batches:
            for lang, text in zip(batch["lang"], batch["text"]):
                held[lang].update(chunks(text))
                if len(held[lang]) >= _HELD:
                    yield _rows(lang, held.pop(lang))
        for lang, counts in held.items():
            yield _rows(lang, counts)

    def _rows(lang: str, counts: Counter) -> pd.DataFrame:
        return pd.DataFrame({"lang": lang, "chunk": list(counts.keys()), "freq": list(counts.values())})

    texts = docs.select(F.coalesce("lang", F.lit(NO_LANG)).alias("lang"), F.col("text").cast("binary").alias("text"))
    found = texts.mapInPandas(cut_up, "lang string, chunk binary, freq long")
    return found.groupBy("lang", "chunk").agg(F.sum("freq").alias("freq"))


class _Hashes(dict):
    """Word to 64-bit hash; forgets everything when it has grown to its bound."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= _CACHED:
            self.clear()
        self[word] = found = xxhash.xxh64_intdigest(word)
        return found


def _mixed(*words: np.ndarray) -> np.ndarray:
    h = words[0]
    for w in words[1:]:
        h = (h ^ h >> np.uint64(32)) * _M2 + w
    return (h ^ h >> np.uint64(29)) * _M1


def _seed(lang: str) -> np.uint64:
    return np.uint64(xxhash.xxh64_intdigest(lang.encode()))


class Bits:
    """A bit for each hash that counts.  Other hashes may hit a set bit; none that counts misses its own."""

    def __init__(self, log: int, words: np.ndarray):
        self.log, self.words = log, words

    def hit(self, hashes: np.ndarray) -> np.ndarray:
        slot = hashes >> np.uint64(64 - self.log)
        return (self.words[(slot >> np.uint64(6)).astype(np.int64)] >> (slot & np.uint64(63)) & np.uint64(1)).astype(bool)


def bit_table(hashes: DataFrame, n_rows: int) -> Bits:
    """Of (hash).  The table is as large as 16 bits a row ask for, up to ``MOST_BITS``, where more hashes share a bit."""
    log = min(max((16 * max(n_rows, 1)).bit_length(), LEAST_BITS), MOST_BITS)
    slot = F.shiftrightunsigned("hash", 64 - log)
    # at most 2^(MOST_BITS - 6) rows of two numbers, moved as Arrow
    found = hashes.groupBy(F.shiftright(slot, 6).alias("word")).agg(
        F.bit_or(F.expr(f"shiftleft(1L, CAST(shiftrightunsigned(hash, {64 - log}) & 63 AS INT))")).alias("bits")).toPandas()
    words = np.zeros(1 << (log - 6), np.uint64)
    words[found["word"].to_numpy(np.int64)] = found["bits"].to_numpy(np.int64).view(np.uint64)
    return Bits(log, words)


def _signed(hashes: np.ndarray) -> np.ndarray:
    return hashes.view(np.int64)


class Runs:
    """The runs of words in some chunks of one language, by place: which belong to a chunk, and their hashes."""

    def __init__(self, lang: str, chunks: list[bytes], freq: np.ndarray, hashes: _Hashes):
        heads = [c.partition(b"\t")[0] for c in chunks]
        self.words = b" ".join(chunks).replace(b"\t", b" ").split(b" ")
        sizes = np.array([c.count(b" ") + c.count(b"\t") + 1 for c in chunks])
        own = np.array([h.count(b" ") + 1 for h in heads])
        self.ends = np.repeat(np.cumsum(sizes), sizes)
        self.own = np.repeat(np.cumsum(sizes) - sizes + own, sizes) > np.arange(len(self.words))
        self.freq = np.repeat(freq, sizes)
        self.h = np.fromiter(map(hashes.__getitem__, self.words), np.uint64, len(self.words))
        self.seed = _seed(lang)

    def hashes(self, n: int) -> np.ndarray:
        m = max(len(self.h) - n + 1, 0)
        return _mixed(np.full(m, self.seed), *(self.h[k:k + m] for k in range(n)))

    def inside(self, n: int) -> np.ndarray:
        """Places where a run of n words begins in its own chunk and ends in it."""
        m = max(len(self.words) - n + 1, 0)
        return self.own[:m] & (np.arange(m) + n <= self.ends[:m])


def _all_runs(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[str, Runs]]:
    hashes = _Hashes()
    for batch in batches:
        for lang, rows in batch.groupby("lang", sort=False):
            chunks, freq = rows["chunk"].tolist(), rows["freq"].to_numpy()
            for at in range(0, len(chunks), _TOGETHER):
                yield lang, Runs(lang, chunks[at:at + _TOGETHER], freq[at:at + _TOGETHER], hashes)


def _candidates(runs: Runs, n: int, singles: Bits, pairs: Bits | None) -> np.ndarray:
    """Places of runs of n words of which no word, and no pair of neighbours, is known to be rare."""
    keep = runs.inside(n)
    if not len(keep):
        return np.zeros(0, np.int64)
    good = singles.hit(runs.hashes(1))
    linked = good[:-1] & good[1:]
    if pairs is not None:
        linked &= pairs.hit(runs.hashes(2))
    for k in range(n - 1):
        keep = keep & linked[k:k + len(keep)]
    return np.flatnonzero(keep)


def count_hashes(dictionary: DataFrame, lengths: range, singles: Bits, pairs: Bits | None, least: int) -> DataFrame:
    """hash, for the hashes of n-grams of those ``lengths`` that occur ``least`` times or more, in distinct chunks, each as
    often as the chunk occurs.  Numbers only: an n-gram that shares its hash is counted too often, none too rarely.
    """
    shared = dictionary.sparkSession.sparkContext.broadcast((singles, pairs))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, n_held = [], 0
        for _, runs in _all_runs(batches):
            for n in lengths:
                at = _candidates(runs, n, *shared.value)
                held.append((runs.hashes(n)[at], runs.freq[at]))
                n_held += len(at)
            if n_held >= _HASHES_HELD:
                yield _rows(held)
                held, n_held = [], 0
        if held:
            yield _rows(held)

    def _rows(held: list) -> pd.DataFrame:
        found = np.concatenate([h for h, _ in held])
        order = np.argsort(found)
        found, freq = found[order], np.concatenate([f for _, f in held])[order]
        first = np.flatnonzero(np.concatenate([[True], found[1:] != found[:-1]])) if len(found) else np.zeros(0, np.int64)
        return pd.DataFrame({"hash": _signed(found[first]), "f": np.add.reduceat(freq, first) if len(first) else freq})

    found = dictionary.mapInPandas(count, "hash long, f long")
    return found.groupBy("hash").agg(F.sum("f").alias("f")).where(F.col("f") >= least).select("hash")


def count_phrases(dictionary: DataFrame, singles: Bits, pairs: Bits, longer: Bits) -> DataFrame:
    """lang, phrase and f for the n-grams of two words or more whose hashes are in the tables.

    An n-gram belongs to the chunk that has its first word as its own, so overlaps count once.
    """
    shared = dictionary.sparkSession.sparkContext.broadcast((singles, pairs, longer))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        singles, pairs, longer = shared.value
        held: dict[str, Counter] = defaultdict(Counter)
        for lang, runs in _all_runs(batches):
            counts, words = held[lang], runs.words
            for n in range(2, LONGEST + 1):
                at = _candidates(runs, n, singles, pairs)
                if n > 2:
                    at = at[longer.hit(runs.hashes(n)[at])]
                freq = runs.freq[at]
                once = freq == 1
                counts.update([b" ".join(words[i:i + n]) for i in at[once].tolist()])
                for i, f in zip(at[~once].tolist(), freq[~once].tolist()):
                    counts[b" ".join(words[i:i + n])] += f
            if len(counts) >= _HELD:
                yield _rows(lang, held.pop(lang))
        for lang, counts in held.items():
            yield _rows(lang, counts)

    def _rows(lang: str, counts: Counter) -> pd.DataFrame:
        return pd.DataFrame({"lang": lang, "phrase": list(counts.keys()), "f": list(counts.values())})

    found = dictionary.mapInPandas(count, "lang string, phrase binary, f long")
    return found.groupBy("lang", "phrase").agg(F.sum("f").alias("f"))


def _word_hashes(words: DataFrame) -> DataFrame:
    def hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes = _Hashes()
        for batch in batches:
            h = np.fromiter((hashes[w.encode()] for w in batch["phrase"]), np.uint64, len(batch))
            seeds = np.fromiter((_seed(lang) for lang in batch["lang"]), np.uint64, len(batch))
            yield pd.DataFrame({"hash": _signed(_mixed(seeds, h))})

    return words.select("lang", "phrase").mapInPandas(hashed, "hash long")


def frequent_phrases(dictionary: DataFrame, least: int = LEAST) -> DataFrame:
    """lang, phrase, k (words) and f of all phrases of 1 to ``LONGEST`` words that occur ``least`` times or more.

    A phrase is no more frequent than its parts.  Words are counted first; then the hashes of pairs of frequent words, then
    those of longer runs of frequent pairs; in the end the phrases themselves, exactly, where no hash is known to be rare.
    """
    own_words = F.explode(F.split(F.split_part(F.col("chunk").cast("string"), F.lit("\t"), F.lit(1)), " ")).alias("phrase")
    words, n_words = cut(
        dictionary.select("lang", own_words, "freq").groupBy("lang", "phrase").agg(F.sum("freq").alias("f"))
        .where(F.col("f") >= least), "phrase-words")
    singles = bit_table(_word_hashes(words), n_words["rows"])
    two, n_two = cut(count_hashes(dictionary, range(2, 3), singles, None, least), "phrase-pairs")
    pairs = bit_table(two, n_two["rows"])
    more, n_more = cut(count_hashes(dictionary, range(3, LONGEST + 1), singles, pairs, least), "phrase-runs")
    longer = bit_table(more, n_more["rows"])
    found = written(count_phrases(dictionary, singles, pairs, longer).where(F.col("f") >= least), "phrases")
    both = words.unionByName(found.select("lang", F.col("phrase").cast("string").alias("phrase"), "f"))
    return both.select("lang", "phrase", F.size(F.split("phrase", " ")).alias("k"), "f")


def mine_phrases(docs: DataFrame, least: int = LEAST, top: int = TOP) -> DataFrame:
    """The best ``top`` phrases of each language: lang, rank, phrase, a, l, r, n and score.

    Texts are lower-cased in A-Z and cut at punctuation and line ends; null and empty ones have no words, documents
    without a language are one of their own, repeated rows count again.  ``a`` counts the phrase, ``l`` and ``r`` the
    two parts of its cut with the lowest score, which is the phrase's: 1000 a n / (l r), rounded down, in whole numbers
    of 38 digits.  A phrase inside a longer one that is as frequent is left out.  A table without frequent phrases
    gives no rows.
    """
    dictionary = written(parse(needed(docs, "lang", "text")), "phrase-dictionary")
    known = frequent_phrases(dictionary, least)
    n_own = F.regexp_count(F.split_part(F.col("chunk").cast("string"), F.lit("\t"), F.lit(1)), F.lit(" ")) + 1
    totals = dictionary.groupBy("lang").agg(F.sum(n_own * F.col("freq")).alias("n"))
    candidates = known.where("k > 1").select("lang", "phrase", "k", F.col("f").alias("a"), F.split("phrase", " ").alias("w"))

    def part(start, size):
        return F.array_join(F.slice("w", start, size), " ")

    cuts = candidates.select("lang", "phrase", "k", "a", "w", F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("cut")).select(
        "lang", "phrase", "a", "cut", part(F.lit(1), F.col("cut")).alias("first"),
        part(F.col("cut") + 1, F.col("k") - F.col("cut")).alias("rest"))
    left = known.select("lang", F.col("phrase").alias("first"), F.col("f").alias("l"))
    right = known.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r"))
    whole = "CAST({} AS DECIMAL(19, 0))".format
    score = F.expr(f"(1000 * {whole('a')} * {whole('n')}) DIV ({whole('l')} * {whole('r')})")
    scored = (
        cuts.join(left, ["lang", "first"]).join(right, ["lang", "rest"]).join(totals, "lang")
        .groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct(score.alias("score"), "cut", "l", "r")).alias("c"))
        .select("lang", "phrase", "a", "c.l", "c.r", "n", F.col("c.score").cast("long").alias("score"))
    )
    starts = F.explode(F.expr(
        "flatten(transform(sequence(2, k - 1), m -> transform(sequence(1, k - m + 1), i -> array_join(slice(w, i, m), ' '))))"))
    covered = (
        candidates.where("k > 2").select("lang", "a", starts.alias("phrase"))
        .groupBy("lang", "phrase").agg(F.max("a").alias("cover"))
    )
    kept = scored.join(covered, ["lang", "phrase"], "left").where("cover IS NULL OR cover < a").drop("cover")
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    # first within each of a language's parts, so that no more than top rows of each part meet
    spread = kept.withColumn("_part", F.pmod(F.xxhash64("phrase"), F.lit(_PARTS)))
    first = spread.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "_part").orderBy(*order)))
    best = first.where(F.col("rank") <= top).withColumn(
        "rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long"))
    return best.where(F.col("rank") <= top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
