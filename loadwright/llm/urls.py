"""URL filters: rule and host lists looked up in Bloom filter cascades, exact over the corpus's own keys."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loadwright.llm.common import written

# The rules, as (action, host and path).
RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"),
         ("block", "com/de/"))

# A host label with one of these words between hyphens lists that label's domain as blocked.
HOST_WORDS = ("ads", "adult", "bets", "casino", "pills", "spam")

BITS_PER_KEY, HASHES = 10, 7

# Cascades of more bytes are not broadcast; their keys are looked up by a join.
MOST_BYTES = 64 << 20

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def add_host_and_path(pages: DataFrame) -> DataFrame:
    """Host: after the first ``://`` up to ``/``, ``?`` or ``#``, A-Z in lower case; path: then up to ``?`` or ``#``.

    Both are empty where the url is null or has no ``://``.
    """
    at = F.coalesce(F.instr("url", "://"), F.lit(0))
    after = F.when(at > 0, F.expr("substring(url, instr(url, '://') + 3)")).otherwise("")
    host = F.regexp_extract("_after", r"^[^/?#]*", 0)
    path = F.regexp_extract(F.expr("substring(_after, length(_host) + 1)"), r"^[^?#]*", 0)
    return (
        pages.withColumn("_after", after).withColumn("_host", host).withColumn("path", path)
        .withColumn("host", F.translate("_host", _UPPER, _LOWER)).drop("_after", "_host")
    )


def _suffixes(host: str) -> Column:
    """The host and its parent domains, longest first; none for an empty host."""
    labels = F.split(host, r"\.")
    domains = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(
        F.slice(labels, i, F.size(labels)), "."))
    return F.when(F.col(host) == "", F.array().cast("array<string>")).otherwise(domains)


def url_keys(lengths: Sequence[int]) -> Column:
    """Domain and path prefix for each domain of ``host`` and each of the path ``lengths`` that ``path`` has."""
    prefixes = F.filter(F.array(*(F.when(F.length("path") >= n, F.substring("path", 1, n)) for n in sorted(lengths))),
                        lambda p: p.isNotNull())
    return F.flatten(F.transform(_suffixes("host"), lambda s: F.transform(prefixes, lambda p: F.concat(s, p))))


def _hashes(key: Column) -> list[Column]:
    # 52 bits, so that sums of their multiples stay within 63
    return [F.shiftrightunsigned(F.xxhash64(key), 12), F.shiftrightunsigned(F.xxhash64(key, F.lit(1)), 12)]


class Level(NamedTuple):
    """One Bloom filter: its bits, how many are in use, and its depth in the cascade.

    Multipliers and size differ from level to level, so keys that meet in one part in another.
    """

    bits: np.ndarray
    size: int
    depth: int


def _level(keys: DataFrame, count: int, depth: int) -> Level:
    """Built where the keys are: only words of the filter come to the driver, as numbers, at most twice its own size."""
    words = max(16, -(-count * BITS_PER_KEY // 64))
    size = 64 * words - 2 * depth - 1
    places = F.explode(F.transform(F.sequence(F.lit(depth * HASHES), F.lit(depth * HASHES + HASHES - 1)),
                                   lambda i: F.pmod(F.col("x") + i.cast("long") * F.col("y"), F.lit(size).cast("long"))))
    found = keys.select(places.alias("at")).groupBy(F.floor(F.col("at") / 64).alias("word")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(at % 64 AS int))")).alias("bits")).toPandas()
    bits = np.zeros(words, np.int64)
    bits[found["word"].to_numpy(np.int64)] = found["bits"].to_numpy(np.int64)
    return Level(bits.view(np.uint64), size, depth)


def _passes(level: Level, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    found = np.ones(len(x), bool)
    for i in range(level.depth * HASHES, (level.depth + 1) * HASHES):
        at = np.mod(x + np.int64(i) * y, np.int64(level.size))
        found &= (level.bits[at >> 6] >> (at & 63).astype(np.uint64) & np.uint64(1)).astype(bool)
    return found


def contains(levels: Sequence[Level], x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Whether keys of the universe, given by their two hashes, are listed: the first level to refuse one decides."""
    listed = np.zeros(len(x), bool)
    open_ = np.arange(len(x))
    for depth, level in enumerate(levels):
        passed = _passes(level, x[open_], y[open_])
        listed[open_[~passed]] = depth % 2 == 1
        open_ = open_[passed]
    listed[open_] = len(levels) % 2 == 1
    return listed


def cascade(listed: DataFrame, universe: DataFrame, most_bytes: int = MOST_BYTES) -> list[Level] | None:
    """Levels that answer for every key (key, x, y) of ``universe`` whether ``listed`` has it; None if too large.

    Level 0 holds the listed keys, level 1 those others of the universe that level 0 lets pass, level 2 the listed
    keys that level 1 lets pass, and so on until nothing passes wrongly.  Every level is a small part of the one
    two before it.
    """
    held = listed.select("key").distinct().withColumns(dict(zip("xy", _hashes(F.col("key")))))
    inside, outside = written(held, "urls-listed"), universe.join(held, "key", "left_anti")
    levels, sides, size = [], [inside, outside], 0
    while True:
        adding = sides[len(levels) % 2]
        count = adding.count()
        if not count and levels:
            return levels
        size += count * BITS_PER_KEY // 8
        if size > most_bytes:
            return None
        level = _level(adding, count, len(levels))
        levels.append(level)
        other = len(levels) % 2
        sides[other] = written(sides[other].where(_passing(level)("x", "y")), "urls-level")


def _passing(level: Level):
    @F.pandas_udf("boolean")
    def passing(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series(_passes(level, x.to_numpy(), y.to_numpy()))

    return passing


def _lookup(lists: dict[str, list[Level]]):
    """For arrays of hashes, the position of the first listed key in each list, null if there is none."""

    def find(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for xs, ys in batches:
            sizes = np.array([len(x) for x in xs], np.int64)
            x, y = (np.concatenate([*s, np.zeros(0, np.int64)]).astype(np.int64) for s in (xs, ys))
            row = np.repeat(np.arange(len(sizes)), sizes)
            place = np.arange(len(x)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            out = {}
            for name, levels in lists.items():
                hit = np.flatnonzero(contains(levels, x, y))[::-1]
                first = np.full(len(sizes), -1)
                first[row[hit]] = place[hit]
                out[name] = pd.array(np.where(first < 0, 0, first), "Int32")
                out[name][first < 0] = pd.NA
            yield pd.DataFrame(out)

    return F.pandas_udf(find, ", ".join(f"`{n}` int" for n in lists))


def listed_hosts(hosts: DataFrame, words: Sequence[str] = HOST_WORDS) -> DataFrame:
    """``key``: the domains from a label that has one of the words between hyphens."""
    pattern = r"^([^.]*-)?(" + "|".join(words) + r")(-[^.]*)?(\.|$)"
    return hosts.select(F.explode(_suffixes("host")).alias("key")).where(F.col("key").rlike(pattern)).distinct()


def judge(pages: DataFrame, rules: Sequence[tuple[str, str]] = RULES, words: Sequence[str] = HOST_WORDS,
          most_bytes: int = MOST_BYTES, listed: DataFrame | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict for every row of ``pages``.

    A rule fits its host and all subdomains if the path starts with the rule's; the longest wins, of equally long
    ones that with the longer host.  Where none fits the verdict is block for a listed host and its subdomains, else
    allow, so a page without host is allowed.  An empty table gives no rows.

    ``listed`` has the blocked hosts in a column ``host``, in any number; A-Z is lower-cased, nulls, empty hosts and
    repeats are left out.  Only hosts that the pages have are kept in filters.  Without it the hosts of the pages that
    have one of ``words`` in a label are blocked.
    """
    split = written(add_host_and_path(pages.select("page_id", "url")).select("page_id", "host", "path"), "urls-pages")
    parts = [rule.partition("/") for _, rule in rules]
    lengths = {len(slash + path) for _, slash, path in parts} | {0}
    keyed = split.withColumn("_keys", F.array_sort(url_keys(lengths), lambda a, b: F.length(b) - F.length(a)))
    universe = written(
        keyed.select(F.explode("_keys").alias("key")).distinct().withColumns(dict(zip("xy", _hashes(F.col("key"))))),
        "urls-universe")
    spark = pages.sparkSession
    if listed is None:
        hosts = listed_hosts(split.select("host").distinct(), words)
    else:
        given = listed.select(F.translate("host", _UPPER, _LOWER).alias("key")).where("key <> ''").distinct()
        hosts = given.join(universe.select("key"), "key", "left_semi")
    lists = {
        action: spark.createDataFrame([(rule,) for a, rule in rules if a == action], "key string")
        for action in ("allow", "block")
    } | {"host": written(hosts, "urls-hosts")}
    found = {name: cascade(keys, universe, most_bytes) for name, keys in lists.items()}
    small = {name: levels for name, levels in found.items() if levels is not None}
    hashes = [F.transform("_keys", lambda k: _hashes(k)[0]), F.transform("_keys", lambda k: _hashes(k)[1])]
    known = keyed.withColumn("_first", _lookup(small)(*hashes)) if small else keyed
    for name in found.keys() - small.keys():
        known = _joined(known, lists[name], name)
    first = {name: F.col(f"_first.{name}") if name in small else F.col(f"_{name}") for name in found}
    nearest = F.least(first["allow"], first["block"])
    rule = F.get("_keys", nearest)
    verdict = (
        F.when(nearest.isNotNull(), F.when(nearest.eqNullSafe(first["allow"]), "allow").otherwise("block"))
        .otherwise(F.when(first["host"].isNotNull(), "block").otherwise("allow"))
    )
    return known.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("verdict"))


def _joined(known: DataFrame, keys: DataFrame, name: str) -> DataFrame:
    """The same position by a join, for lists too large to broadcast."""
    rows = known.withColumn("_row", F.monotonically_increasing_id())
    hit = (
        rows.select("_row", F.posexplode("_keys").alias("_at", "key")).join(keys, "key", "left_semi")
        .groupBy("_row").agg(F.min("_at").alias(f"_{name}"))
    )
    return rows.join(hit, "_row", "left").drop("_row")
