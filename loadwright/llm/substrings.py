"""Repeated passages across documents: FM-indexes over wavelet trees, one for each shard of candidate stretches."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loadwright.llm.common import needed

# Words that must repeat; words whose hash chooses the stretch in which a window is looked up.
WINDOW, SHINGLE = 13, 5

# A shingle that more documents have is looked up window by window, so that no shard grows with it.
HOT = 4096

# An index answers about so many stretches, of at most 20 words each.
_STRETCHES = 1 << 16

_CACHED = 500_000
_STEP = np.uint64(0x9E3779B97F4A7C15)
_LAST = (1 << 63) - 1


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= _CACHED:
            self.clear()
        self[word] = found = xxhash.xxh64_intdigest(word)
        return found


# One for a Python worker, so that its tasks share what it remembers.
_known = _Hashes()


def _word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(_known.__getitem__, words), np.uint64, len(words))


def _rolling(h: np.ndarray, length: int) -> np.ndarray:
    """Hash of every run of ``length`` words."""
    out = np.zeros(len(h) - length + 1, np.uint64)
    for j in range(length):
        out = out * _STEP + h[j:len(out) + j]
    out = (out ^ out >> np.uint64(31)) * np.uint64(0xBF58476D1CE4E5B9)
    return out ^ out >> np.uint64(29)


def anchors(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each window, its start's anchor: the place of the shingle with the smallest hash in it, and that hash.

    Equal windows have equal anchors, wherever they stand.
    """
    shingles, width = _rolling(h, SHINGLE), WINDOW - SHINGLE + 1
    n = len(shingles) - width + 1
    least, span = shingles, 1
    while 2 * span <= width:
        least, span = np.minimum(least[:-span], least[span:]), 2 * span
    least = np.minimum(least[:n], least[width - span:width - span + n])
    place = np.zeros(n, np.int64)
    for i in range(width - 1, -1, -1):  # the first of equal ones is written last
        np.copyto(place, i, where=shingles[i:i + n] == least)
    return place + np.arange(n), least.view(np.int64)


def _anchor_sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        found = []
        for data in batch["data"]:
            words = (data or b"").split()
            if len(words) < WINDOW:
                found.append(np.zeros(0, np.int64))
                continue
            place, value = anchors(_word_hashes(words))
            found.append(np.unique(value[np.flatnonzero(np.diff(place, prepend=-1))]))
        yield pd.DataFrame({"_doc": batch["_doc"], "_order": batch["_order"], "anchors": found})


def _stretches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Words around each shared anchor: all consecutive windows that have it, or each window alone if it is hot."""
    for batch in batches:
        out: dict[str, list] = {c: [] for c in ("key", "hot", "_doc", "_order", "start", "stretch")}
        for doc, order, data, shared, hot in zip(batch["_doc"], batch["_order"], batch["data"], batch["shared"], batch["hot"]):
            words = data.split()
            whole = b" ".join(words)
            edges = [0, *accumulate(len(w) + 1 for w in words)]
            h = _word_hashes(words)
            place, value = anchors(h)
            begins = np.flatnonzero(np.diff(place, prepend=-1))
            values, ends = value[begins], np.append(begins[1:], len(place)) - 1 + WINDOW
            found = np.isin(values, shared)
            alone = np.flatnonzero(np.isin(value, hot)) if len(hot) else np.zeros(0, np.int64)
            starts = begins[found].tolist() + alone.tolist()
            stops = ends[found].tolist() + (alone + WINDOW).tolist()
            out["key"] += values[found].tolist()
            if len(alone):
                out["key"] += _rolling(h, WINDOW).view(np.int64)[alone].tolist()
            out["hot"] += [False] * int(found.sum()) + [True] * len(alone)
            out["_doc"] += [doc] * len(starts)
            out["_order"] += [order] * len(starts)
            out["start"] += starts
            out["stretch"] += [whole[edges[a]:edges[b] - 1] for a, b in zip(starts, stops)]
        yield pd.DataFrame(out)


class WaveletMatrix:
    """Ranks of symbols in a sequence, from one bit vector for each bit of a symbol, highest first."""

    def __init__(self, symbols: np.ndarray, bits: int):
        self.size, self.levels = len(symbols), []
        for shift in range(bits - 1, -1, -1):
            bit = (symbols >> shift & 1).astype(np.uint8)
            padded = np.zeros(-(-(self.size + 1) // 64) * 64, np.uint8)
            padded[:self.size] = bit
            words = np.packbits(padded, bitorder="little").view(np.uint64)
            before = np.concatenate([[0], np.cumsum(np.bitwise_count(words), dtype=np.int64)])[:-1]
            self.levels.append((shift, words, before, self.size - int(bit.sum())))
            symbols = np.concatenate([symbols[bit == 0], symbols[bit == 1]])

    def descend(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Where position ``at`` of the sequence comes to lie among the symbol's own; differences are ranks."""
        for shift, words, before, zeros in self.levels:
            word = at >> 6
            below = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
            ones = before[word] + np.bitwise_count(words[word] & below)
            at = np.where(symbol >> shift & 1, zeros + ones, at - ones)
        return at


def _joined(rank: np.ndarray, times: int, step: int) -> np.ndarray:
    """One number for the ranks of so many places, ``step`` apart; places beyond the end rank below all others."""
    base = int(rank.max(initial=0)) + 2
    out, values = rank + 1, base
    for i in range(1, times):
        if values * base >= 1 << 62:
            out = _dense(out)
            values = int(out.max(initial=0)) + 1
        out = out * base
        out[:max(len(rank) - i * step, 0)] += rank[i * step:] + 1
        values *= base
    return out


def _dense(numbers: np.ndarray) -> np.ndarray:
    """The numbers' ranks, from 0 without gaps."""
    order = np.argsort(numbers)
    ordered = numbers[order]
    out = np.empty(len(numbers), np.int64)
    out[order] = np.cumsum(ordered != np.concatenate([ordered[:1], ordered[:-1]]))
    return out


class FMIndex:
    """Backward search in a sequence of symbols from 1 on, with 0 between stretches.

    Suffixes are told apart by their first 16 symbols, which is enough for patterns up to that length.
    """

    def __init__(self, text: np.ndarray):
        rank = _dense(_joined(_dense(_joined(text, 3, 1)), 3, 3))
        # the first 9 symbols, and the 9 from the eighth on
        self.order = np.argsort(_joined(rank, 2, 7), kind="stable")
        bits = max(1, int(text.max()).bit_length())
        self.wavelet = WaveletMatrix(text[self.order - 1], bits)
        symbols = np.arange(int(text.max()) + 1)
        self.zero = self.wavelet.descend(symbols, np.zeros(len(symbols), np.int64))
        self.begin = np.concatenate([[0], np.cumsum(np.bincount(text))])

    def find(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each row of ``patterns``, which all stand in the text, the range of suffixes that begin with it.

        A range is extended word by word to the left until it has one suffix.  Such a pattern stands in the text once;
        its range stays with the suffix that begins further right in that place.
        """
        last, *others = patterns.T[::-1]
        low, high = self.begin[last], self.begin[last + 1]
        active = np.arange(len(low))
        for symbols in others:
            active = active[high[active] - low[active] > 1]
            symbol = symbols[active]
            first = self.begin[symbol] - self.zero[symbol]
            low[active] = first + self.wavelet.descend(symbol, low[active])
            high[active] = first + self.wavelet.descend(symbol, high[active])
        return low, high


def _least(values: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Minimum of each range; ranges are not empty."""
    tables, span = [values], 1
    longest = int((high - low).max(initial=1))
    while 2 * span <= longest:
        tables.append(np.minimum(tables[-1][:-span], tables[-1][span:]))
        span *= 2
    depth = np.frexp((high - low).astype(np.float64))[1] - 1
    out = np.empty(len(low), np.int64)
    for d, table in enumerate(tables):
        at = np.flatnonzero(depth == d)
        out[at] = np.minimum(table[low[at]], table[high[at] - (1 << d)])
    return out


class _Ids(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = found = len(self)
        return found


def first_orders(stretches: list[bytes], orders: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each window of each stretch, the smallest order of a stretch that holds the same words.

    Returns these for all windows in turn, and how many windows each stretch has.
    """
    ids = _Ids({b"\n": 0})  # stands between stretches; no word is a line feed
    text = np.array(list(map(ids.__getitem__, (b" \n ".join(stretches) + b" \n").split(b" "))), np.int64)
    ends = np.flatnonzero(text == 0)
    sizes = np.diff(ends, prepend=-1)
    of = np.repeat(orders, sizes)
    windows = sizes - WINDOW
    at = np.arange(len(text))
    begin = at[at + WINDOW <= np.repeat(ends, sizes)]
    index = FMIndex(text)
    low, high = index.find(np.lib.stride_tricks.sliding_window_view(text, WINDOW)[begin])
    return _least(of[index.order], low, high), windows


def covered_ranges(rows: pd.DataFrame) -> pd.DataFrame:
    """Word ranges that an earlier document has, for rows by key, stretch and order, the keys complete."""
    stretches, keys, orders = rows["stretch"].tolist(), rows["key"].to_numpy(), rows["_order"].to_numpy()
    new = np.ones(len(rows), bool)
    new[1:] = (keys[1:] != keys[:-1]) | np.array([a != b for a, b in zip(stretches, stretches[1:])], bool)
    firsts = np.flatnonzero(new)
    least, windows = first_orders([stretches[i] for i in firsts], orders[firsts])
    # all windows of all rows: those of the row's stretch
    which = np.cumsum(new) - 1
    count = windows[which]
    row = np.repeat(np.arange(len(rows)), count)
    offset = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    hit = least[(np.cumsum(windows) - windows)[which[row]] + offset] < orders[row]
    row, offset = row[hit], offset[hit]
    begins = np.flatnonzero((np.diff(row, prepend=-1) != 0) | (np.diff(offset, prepend=0) > WINDOW))
    ends = np.append(begins[1:], len(row)) - 1 if len(row) else begins
    at = rows["start"].to_numpy()[row] + offset
    return pd.DataFrame({"_doc": rows["_doc"].to_numpy()[row[begins]], "_order": orders[row[begins]],
                         "begin": at[begins], "end": at[ends] + WINDOW})


def _covered(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """``covered_ranges`` of rows by key, stretch and order, an index for some keys at a time.

    A key is never split, unless it is hot: then its stretches are single windows, each of which needs no other
    stretch than its own first row.
    """
    waiting: list[pd.DataFrame] = []
    n = 0
    for batch in batches:
        waiting.append(batch)
        n += len(batch)
        if n < _STRETCHES:
            continue
        rows = pd.concat(waiting, ignore_index=True)
        last = int(np.flatnonzero(rows["key"].to_numpy() == rows["key"].iat[-1])[0])
        if not last and not rows["hot"].iat[-1]:
            continue
        done, rest = (rows.iloc[:last], rows.iloc[last:]) if last else (rows, rows[rows["stretch"] == rows["stretch"].iat[-1]].iloc[:1])
        yield covered_ranges(done)
        waiting, n = [rest], len(rest)
    if waiting:
        yield covered_ranges(pd.concat(waiting, ignore_index=True))


def _without(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for data, ranges in zip(batch["data"], batch["ranges"]):
            words = (data or b"").split()
            gone = np.zeros(len(words), bool)
            for r in ranges if ranges is not None else ():
                gone[r["begin"]:r["end"]] = True
            kept = words if not gone.any() else [w for w, g in zip(words, gone.tolist()) if not g]
            rows.append((len(words), int(gone.sum()), b" ".join(kept)))
        out = pd.DataFrame(rows, columns=["n_words", "n_removed", "kept"])
        yield out.assign(doc_id=batch["doc_id"].array)[["doc_id", "n_words", "n_removed", "kept"]]


def remove_repeats(docs: DataFrame, hot: int = HOT) -> DataFrame:
    """doc_id, n_words, n_removed, kept (binary, words joined by one space) for each row of ``docs``.

    A word goes if a window of 13 words covers it that also starts in a document with a smaller id.  Null ids come
    after all others; rows with equal ids, or without, are no originals of each other.  Null texts have no words.

    Each window is looked up where its anchor leads.  Anchors that stand in documents of one order only are left
    aside; the stretches around the others are dealt to shards by anchor, and each shard's index is searched.
    """
    texts = needed(docs, "doc_id", "text").select(
        "doc_id", F.xxhash64("doc_id", "text").alias("_doc"), F.coalesce("doc_id", F.lit(_LAST)).cast("long").alias("_order"),
        F.col("text").cast("binary").alias("data"))
    sets = texts.select("_doc", "_order", "data").mapInPandas(_anchor_sets, "_doc long, _order long, anchors array<long>")
    # counted and joined from one shuffle, as both need the same columns; no anchor has more rows than documents
    each = sets.select("_doc", "_order", F.explode("anchors").alias("anchor"))
    # never null, and said to be so: else only one of the two would filter before the shuffle
    placed = each.select(*(F.coalesce(c, F.lit(0)).alias(c) for c in each.columns)).repartition("anchor")
    counts = placed.groupBy("anchor").agg(
        F.min("_order").alias("low"), F.max("_order").alias("high"), F.max("_doc").alias("some"),
        F.count(F.lit(1)).alias("n")).where("low < high AND some IS NOT NULL").drop("some")
    per_doc = placed.join(counts, "anchor").groupBy("_doc", "_order").agg(
        F.collect_list(F.when(F.col("n") <= hot, F.col("anchor"))).alias("shared"),
        F.collect_list(F.when(F.col("n") > hot, F.col("anchor"))).alias("hot"))
    # the documents are shuffled once for this join and the last one
    around = texts.join(per_doc, ["_doc", "_order"]).select("doc_id", "_doc", "_order", "data", "shared", "hot").mapInPandas(
        _stretches, "key long, hot boolean, _doc long, _order long, start long, stretch binary")
    sharded = around.repartition("key").sortWithinPartitions("key", "stretch", "_order")
    ranges = sharded.mapInPandas(_covered, "_doc long, _order long, begin long, end long")
    per_doc = ranges.groupBy("_doc", "_order").agg(F.collect_set(F.struct("begin", "end")).alias("ranges"))
    return texts.join(per_doc, ["_doc", "_order"], "left").select("doc_id", "data", "ranges").mapInPandas(
        _without, "doc_id long, n_words long, n_removed long, kept binary")
