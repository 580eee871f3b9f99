"""Packing token sequences by shortest-pack-first over the length histogram."""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain
from struct import pack as pack_ids
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loadwright.llm.common import needed, running_sums, written

LENGTH, END = 1024, 0

# Words whose ids are remembered by one Python worker at a time, and characters that are split at a time.
_CACHED, _STRETCH = 1_000_000, 1 << 20
# Words that are encoded as one text.
_JOINED = 2_000
_SPACED = re.compile(r"\s ")
_BOUNDARY = re.compile(r"(?<=\S) ")
_CUT = re.compile(r"(?<=\S)(?= )")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Tokens:
    """Ids of whole texts as little-endian unsigned 32-bit bytes.

    Text is cut before each space that follows anything but white space, where the tokenizer's own pattern always
    ends a token; the ids of what lies between are remembered.  Added tokens in a text become their ids, as the tokenizer
    does by default.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        # words are remembered here, each is asked for once
        if hasattr(self.tokenizer.model, "_resize_cache"):
            self.tokenizer.model._resize_cache(0)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        # byte-level vocabularies write each byte as one character
        self.sizes = np.array([len(self.tokenizer.id_to_token(i) or "") for i in range(self.tokenizer.get_vocab_size())], np.int64)
        # ids of parts as they stand, and of words with the space before them
        self.known: dict[str, bytes] = {}
        self.spaced: dict[str, bytes] = {}

    def _learn(self, parts: Iterable[str]) -> None:
        if len(self.known) > _CACHED:
            self.known.clear()
        missing = list(set(parts).difference(self.known))
        if missing:
            self.known.update(zip(missing, self._alone(missing)))

    def _alone(self, parts: list[str]) -> list[bytes]:
        return [pack_ids("<%dI" % len(found.ids), *found.ids)
                for found in self.tokenizer.encode_batch_fast(parts, add_special_tokens=False)]

    def _learn_spaced(self, words: Iterable[str]) -> None:
        if len(self.spaced) > _CACHED:
            self.spaced.clear()
        missing = set(words).difference(self.spaced)
        # these may stand one after the other: a space begins each, and no white space ends it
        joined = [w for w in missing if w and not w[-1].isspace()]
        alone = [] if len(joined) == len(missing) else list(missing.difference(joined))
        for at in range(0, len(joined), _JOINED):
            alone += self._learn_joined(joined[at:at + _JOINED])
        if alone:
            self.spaced.update(zip(alone, self._alone([" " + w for w in alone])))

    def _learn_joined(self, words: list[str]) -> list[str]:
        """Encode many words as one text and deal the ids back by their bytes; returns the words if that does not come
        out even, or if an added token is among them.
        """
        text = " " + " ".join(words)
        if any(a in text for a in self.added):
            return words
        ids = np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.int64)
        ends = np.cumsum(self.sizes[ids])
        want = np.cumsum([1 + len(w) for w in (words if text.isascii() else (w.encode("utf-8", "surrogatepass") for w in words))])
        last = np.searchsorted(ends, want)
        if not len(ids) or ends[-1] != want[-1] or (ends[last] != want).any():
            return words
        data, at = ids.astype("<u4").tobytes(), 0
        for word, end in zip(words, (4 * (last + 1)).tolist()):
            self.spaced[word] = data[at:end]
            at = end
        return []

    def encode(self, text: str) -> bytes:
        found, at = [], 0
        while at < len(text):
            edge = _BOUNDARY.search(text, at + _STRETCH)
            end = edge.start() if edge else len(text)
            stretch = text[at:end] if at or edge else text
            if _SPACED.search(stretch):
                parts = _CUT.split(stretch)
                self._learn(parts)
                found += map(self.known.__getitem__, parts)
            else:
                found += self._plain([stretch])
            at = end
        return b"".join(found)

    def encode_all(self, texts: Iterable[str]) -> Iterator[bytes]:
        """``encode`` of each text; what is new in short ones is learned for many of them at a time."""
        waiting, size = [], 0
        for text in texts:
            waiting.append(text)
            size += len(text)
            if size >= _STRETCH or len(waiting) >= _JOINED:
                yield from self._together(waiting)
                waiting, size = [], 0
        yield from self._together(waiting)

    def _together(self, texts: list[str]) -> Iterator[bytes]:
        short = [len(t) < _STRETCH and not _SPACED.search(t) for t in texts]
        plain = iter(self._plain([t for t, s in zip(texts, short) if s]))
        return iter([next(plain) if s else self.encode(t) for t, s in zip(texts, short)])

    def _plain(self, stretches: list[str]) -> list[bytes]:
        """Ids of texts in which no space follows white space."""
        words = [s.split(" ") for s in stretches]
        firsts = [w.pop(0) for w in words]
        self._learn(firsts)
        self._learn_spaced(chain.from_iterable(words))
        return [b"".join([self.known[first], *map(self.spaced.__getitem__, rest)]) for first, rest in zip(firsts, words)]


@lru_cache(1)
def _tokens(path: str) -> Tokens:
    """One for a Python worker, so that its tasks share what it remembers."""
    return Tokens(path)


def token_pieces(docs: DataFrame, path: str | None = None, length: int = LENGTH, end: int = END,
                 ids: bool = False) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens for each piece of at most ``length`` ids; on demand the ids.

    A document is the ids of its text and ``end``; a null text is empty.  It is cut every ``length`` ids, so only
    its last piece is shorter.
    """
    path = path or default_tokenizer()

    def cut_up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        tokens, last = _tokens(path), np.array([end], "<u4").tobytes()
        for batch in batches:
            rows = []
            texts = (text or "" for text in batch["text"])
            for doc, ids_of in zip(batch["doc_id"].array, tokens.encode_all(texts)):
                data = ids_of + last
                for at in range(0, len(data), 4 * length):
                    piece = data[at:at + 4 * length]
                    row = (doc, at // 4, len(piece) // 4, crc32(piece), len(data) // 4)
                    rows.append((*row, np.frombuffer(piece, "<u4").astype(np.int64)) if ids else row)
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"] + ["ids"] * ids
            out = pd.DataFrame(rows, columns=names)
            yield out.assign(doc_id=out["doc_id"].astype("Int64"))

    kinds = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long" + ", ids array<long>" * ids
    return needed(docs, "doc_id", "text").mapInPandas(cut_up, kinds)


def pack_histogram(counts: dict[int, int], length: int = LENGTH) -> list[tuple[tuple[int, ...], int]]:
    """Patterns of lengths, longest first, and how many packs each has, from how many pieces have each length.

    Lengths are placed from the longest to the shortest, each into the packs that are shortest so far, as many as
    a pattern has at once; what finds no room opens packs of its own.  Work and size follow the number of
    different lengths, not of pieces.
    """
    packs: dict[int, list[tuple[tuple[int, ...], int]]] = {}
    for size in sorted((n for n, c in counts.items() if c), reverse=True):
        left = counts[size]
        while left:
            filled = min(packs, default=length)
            if filled + size > length:
                packs.setdefault(size, []).append(((size,), left))
                break
            pattern, count = packs[filled].pop()
            taken = min(left, count)
            if count > taken:
                packs[filled].append((pattern, count - taken))
            elif not packs[filled]:
                del packs[filled]
            packs.setdefault(filled + size, []).append(((*pattern, size), taken))
            left -= taken
    return [found for filled in sorted(packs) for found in packs[filled]]


def _places(counts: dict[int, int], length: int) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, rank after the last, sequence of the first, offset): where ranks within a length go."""
    used, rows, sequence = defaultdict(int), [], 0
    for pattern, count in pack_histogram(counts, length):
        at = 0
        for size in pattern:
            rows.append((size, used[size], used[size] + count, sequence, at))
            used[size] += count
            at += size
        sequence += count
    return rows


def pack(pieces: DataFrame, length: int = LENGTH) -> DataFrame:
    """Adds sequence_id and offset to pieces (doc_id, start, length, ids_crc32, ...).

    Pieces of one length are ranked by id, start and checksum.  Only the histogram, at most ``length`` numbers,
    and the patterns made from it pass through the driver.
    """
    stored = written(pieces, "packing-pieces")
    counts = {r["length"]: r["count"] for r in stored.groupBy("length").count().collect()}
    spark, earlier, base = pieces.sparkSession, 0, {}
    for size in sorted(counts):
        base[size] = earlier
        earlier += counts[size]
    # bounded by the patterns, whose number follows the different lengths
    rows = [(size, base[size] + a, base[size] + b, seq, at) for size, a, b, seq, at in _places(counts, length)]
    places = spark.createDataFrame(rows, "_length long, _from long, _to long, _sequence long, offset long")
    order = [F.col("length"), F.col("doc_id"), F.col("start"), F.col("ids_crc32")]
    ranked = running_sums(stored, order, {"_rank": F.lit(1).cast("long")})
    met = (F.col("length") == F.col("_length")) & (F.col("_rank") >= F.col("_from")) & (F.col("_rank") < F.col("_to"))
    return ranked.join(F.broadcast(places), met).select(
        *pieces.columns, (F.col("_sequence") + F.col("_rank") - F.col("_from")).alias("sequence_id"), "offset")


def pack_documents(docs: DataFrame, path: str | None = None, length: int = LENGTH, end: int = END,
                   ids: bool = False) -> DataFrame:
    """``token_pieces`` of ``docs`` with their sequence and the place in it.  An empty table gives no rows."""
    return pack(token_pieces(docs, path, length, end, ids), length)
