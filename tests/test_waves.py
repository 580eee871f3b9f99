"""Load order inside one table."""

import random

import pytest
from pyspark.sql import functions as F

from loadwright.operators import skew
from loadwright.operators.waves import row_waves


def solve(spark, links, schema="id long, parent long"):
    result = row_waves(spark.createDataFrame(links, schema), "id", "parent")
    waves = {r.id: r.wave for r in result.waves.collect()}
    assert len(waves) == len(links)
    return waves, {(r.id, r.parent) for r in result.dropped.collect()}


def walk(links):
    """Brute force: open each cycle at its smallest id, then count ancestors."""
    parents = {i: (p if p in dict(links) and p != i else None) for i, p in links}
    dropped = set()
    for start in parents:
        path, at = [], start
        while at is not None and at not in path:
            path.append(at)
            at = parents[at]
        if at is not None:
            first = min(path[path.index(at):])
            dropped.add((first, parents[first]))
            parents[first] = None
    waves = {}
    for i in parents:
        n, at = 0, i
        while parents[at] is not None:
            n, at = n + 1, parents[at]
        waves[i] = n
    return waves, dropped


def test_long_chain(spark):
    waves, dropped = row_waves(spark.range(10_000).select("id", F.when(F.col("id") > 0, F.col("id") - 1).alias("parent")),
                               "id", "parent")
    assert waves.where("wave != id").count() == 0 and waves.count() == 10_000
    assert dropped.count() == 0


@pytest.mark.parametrize("small_rows", [None, 0])
def test_random_links(spark, small_rows, monkeypatch):
    if small_rows is not None:
        monkeypatch.setattr(skew, "SMALL_ROWS", small_rows)
    rng = random.Random(5)
    links = []
    for block in range(60 if small_rows is None else 12):
        n = rng.randint(1, 30)
        for i in range(n):
            parent = rng.choice([None, rng.randrange(n), rng.randrange(n), i, 10**6])
            links.append((block * 100 + i, None if parent is None else parent if parent == 10**6 else block * 100 + parent))
    assert solve(spark, links) == walk(links)


def test_rings_of_all_lengths_with_tails(spark):
    links, at = [], 0
    for size in range(2, 40):
        ring = list(range(at, at + size))
        links += [(i, ring[(k + 1) % size]) for k, i in enumerate(ring)]
        tail = list(range(at + size, at + size + 20))
        links += [(i, ring[-1] if k == 0 else tail[k - 1]) for k, i in enumerate(tail)]
        at += size + 20
    shuffled = random.Random(2).sample(range(at), at)
    renamed = [(shuffled[i], shuffled[p]) for i, p in links]
    assert solve(spark, renamed) == walk(renamed)


def test_one_parent_for_almost_all(spark, monkeypatch):
    monkeypatch.setattr(skew, "SMALL_ROWS", 0)
    links = [(0, None)] + [(i, 0) for i in range(1, 3000)] + [(i, i - 1) for i in range(3000, 3040)]
    assert solve(spark, links) == walk(links)


def test_text_ids(spark):
    assert solve(spark, [("b", "c"), ("c", "b"), ("a", "b"), ("d", "zz")], "id string, parent string") == (
        {"b": 0, "c": 1, "a": 1, "d": 0}, {("b", "c")})


@pytest.mark.parametrize("links", [[(1, None), (1, 2), (2, None)], [(None, 1), (1, None)]])
def test_bad_ids_fail(spark, links):
    with pytest.raises(Exception, match="missing or repeated"):
        solve(spark, links)
