"""Goldens and random graphs for edges, cycle breaking, tiers and batches."""

import random

import pytest
from pyspark.sql import functions as F

from loadwright.operators.graph import cycle_warnings, dependency_diagram_edges, load_tiers
from loadwright.plans.batches import load_batches, plan_summary

GOLDENS = {
    "HUB": (["b a", "a b", "h a", "c h", "d h", "e h"],
            {"a": 0, "h": 0, "b": 1, "c": 1, "d": 1, "e": 1}, {"h a", "a b"}),
    "RING": (["a b", "b c", "c a"], {"a": 0, "c": 1, "b": 2}, {"a b"}),
    "TPCH": (["nation region", "customer nation", "supplier nation", "orders customer", "lineitem orders",
              "lineitem part", "lineitem supplier"],
             {"region": 0, "part": 0, "nation": 1, "customer": 2, "supplier": 2, "orders": 3, "lineitem": 4}, set()),
    "TPCH2": (["nation region", "customer nation", "supplier nation", "orders customer", "lineitem orders",
               "lineitem part", "lineitem supplier", "customer orders"],
              {"region": 0, "part": 0, "orders": 0, "nation": 1, "customer": 2, "supplier": 2, "lineitem": 3},
              {"orders customer"}),
}


def plan(spark, graphs):
    """graphs: org -> (tables, edges as 'src dst')."""
    tables = spark.createDataFrame([(o, t) for o, (ts, _) in graphs.items() for t in ts], "org_key string, table string")
    edges = spark.createDataFrame(
        [(o, *e.split()) for o, (_, es) in graphs.items() for e in es], "org_key string, src string, dst string")
    return tables, edges, load_tiers(tables, edges)


def collected(result):
    tiers, dropped = {}, {}
    for r in result.tiers.collect():
        assert r.table not in tiers.setdefault(r.org_key, {})
        tiers[r.org_key][r.table] = r.tier
    for r in result.dropped.collect():
        dropped.setdefault(r.org_key, set()).add(f"{r.src} {r.dst}")
    return tiers, dropped


def greedy(tables, edges):
    """Plain model of the documented rule: give up edges, then longest chains."""
    unmet = {t: {e.split()[1] for e in edges if e.split()[0] == t} - {t} for t in tables}
    kept = {t: set(d) for t, d in unmet.items()}
    dropped = set()
    while unmet:
        free = {t for t, d in unmet.items() if not d}
        if free:
            unmet = {t: d - free for t, d in unmet.items() if t not in free}
            continue
        waiting = {t: sum(t in d for d in unmet.values()) for t in unmet}
        hub = min(unmet, key=lambda t: (-waiting[t], len(unmet[t]), t.upper()))
        dropped |= {f"{hub} {d}" for d in unmet[hub]}
        kept[hub] -= unmet[hub]
        unmet[hub] = set()
    tiers = {}
    while len(tiers) < len(kept):
        for t, deps in kept.items():
            if t not in tiers and all(d in tiers for d in deps):
                tiers[t] = 1 + max((tiers[d] for d in deps), default=-1)
    return tiers, dropped


def random_graphs(n, seed):
    rng = random.Random(seed)
    names = ["b_x", "bx", "ba", "c", "c_1", "cz", "d", "e"]
    graphs = {}
    for i in range(n):
        tables = rng.sample(names, rng.randint(1, len(names)))
        edges = {f"{a} {b}" for a in tables for b in tables if a != b and rng.random() < rng.choice((0.1, 0.25, 0.5))}
        graphs[f"g{i}"] = (tables, sorted(edges))
    return graphs


def test_goldens(spark):
    graphs = {o: (sorted(t), e) for o, (e, t, _) in GOLDENS.items()}
    tiers, dropped = collected(plan(spark, graphs)[2])
    for org, (_, want, lost) in GOLDENS.items():
        assert tiers[org] == want
        assert dropped.get(org, set()) == lost


def test_random_graphs_match_the_rule(spark):
    graphs = random_graphs(300, 7)
    _, edges, result = plan(spark, graphs)
    tiers, dropped = collected(result)
    for org, (tables, es) in graphs.items():
        want, lost = greedy(tables, es)
        assert tiers[org] == want, org
        assert dropped.get(org, set()) == lost, org
    status = dependency_diagram_edges(edges, result.dropped, result.tiers).collect()
    assert len(status) == sum(len(es) for _, es in graphs.values())
    for r in status:
        assert r.status == ("deferred" if f"{r.src} {r.dst}" in dropped.get(r.org_key, set()) else "kept")
        if r.status == "kept":
            assert r.src_tier > r.dst_tier


def test_shuffled_path_gives_the_same(spark, monkeypatch):
    from loadwright.operators import skew

    graphs = random_graphs(60, 11)
    graphs["star"] = (["hub"] + [f"t{i:03}" for i in range(400)], [f"t{i:03} hub" for i in range(400)])
    expected = {o: greedy(*g) for o, g in graphs.items()}
    monkeypatch.setattr(skew, "SMALL_ROWS", 0)
    tiers, dropped = collected(plan(spark, graphs)[2])
    for org in graphs:
        assert (tiers[org], dropped.get(org, set())) == expected[org]


@pytest.mark.parametrize("most", [0, 4])
def test_large_environments_give_the_same(spark, monkeypatch, most):
    from loadwright.operators import graph

    graphs = random_graphs(150, 5)
    # a core of two rings and a hub, with many alike around it
    graphs["star"] = (["hub", "a", "b", "c"] + [f"t{i:03}" for i in range(300)] + [f"s{i:03}" for i in range(300)],
                      ["a b", "b a", "a hub", "b c", "c b"] + [f"t{i:03} hub" for i in range(300)]
                      + [f"c s{i:03}" for i in range(300)] + [f"t{i:03} s{i % 2:03}" for i in range(300)])
    tables, edges, whole = plan(spark, graphs)
    want = collected(whole), sorted(map(tuple, whole.dropped.collect()))
    core = graph._ordered_cores
    monkeypatch.setattr(graph, "MOST_TABLES", most)

    def unchecked(*frames):
        monkeypatch.setattr(graph, "MOST_TABLES", 100)
        return core(*frames)

    monkeypatch.setattr(graph, "_ordered_cores", unchecked)
    result = load_tiers(tables, edges)
    assert (collected(result), sorted(map(tuple, result.dropped.collect()))) == want


def test_one_hub_of_many_tables_is_no_row(spark, monkeypatch):
    from loadwright.operators import graph

    gathered = []
    ordered = graph._ordered
    monkeypatch.setattr(graph, "_ordered", lambda m, p: gathered.append((m, p)) or ordered(m, p))
    n = 200_000
    names = spark.range(n).select(F.lit("o").alias("org_key"), F.concat(F.lit("t"), "id").alias("table"))
    tables = names.union(spark.createDataFrame([("o", "hub"), ("o", "ring")], "org_key string, table string"))
    edges = names.select("org_key", F.col("table").alias("src"), F.lit("hub").alias("dst")).union(
        spark.createDataFrame([("o", "hub", "ring"), ("o", "ring", "hub")], "org_key string, src string, dst string"))
    result = load_tiers(tables, edges)
    assert [m.where("org_key = 'o'").count() for m, _ in gathered] == [0, 3]
    assert {(r.tier, r["count"]) for r in result.tiers.groupBy("tier").count().collect()} == {(0, 1), (1, n + 1)}
    assert [tuple(r)[:3] for r in result.dropped.collect()] == [("o", "hub", "ring")]


def test_core_that_is_too_large_is_named(spark, monkeypatch):
    from loadwright.operators import graph

    monkeypatch.setattr(graph, "MOST_TABLES", 5)
    ring = [f"r{i}" for i in range(8)]
    with pytest.raises(ValueError, match="environment vast: 8 tables"):
        plan(spark, {"vast": (ring, [f"r{i} r{(i + 1) % 8}" for i in range(8)]), "small": (["a"], ["a b"])})


def test_order_of_rows_does_not_matter(spark):
    graphs = random_graphs(40, 3)
    turned = {o: (list(reversed(t)), list(reversed(e))) for o, (t, e) in reversed(graphs.items())}
    assert collected(plan(spark, graphs)[2]) == collected(plan(spark, turned)[2])


def test_table_named_twice_fails(spark):
    with pytest.raises(Exception, match="table listed twice"):
        plan(spark, {"x": (["a", "A"], [])})


def test_edges_outside_and_to_itself_are_ignored(spark):
    tiers, dropped = collected(plan(spark, {"x": (["a", "b"], ["a a", "a zz", "zz b", "B A"])})[2])
    assert tiers == {"x": {"a": 0, "b": 1}} and not dropped


def test_warnings(spark):
    graphs = {o: (sorted(t), e) for o, (e, t, _) in GOLDENS.items()}
    rows = cycle_warnings(plan(spark, graphs)[2].dropped).where("org_key = 'HUB'").orderBy("round").collect()
    assert [r.table for r in rows] == ["h", "a"]
    assert rows[0].warning == (
        "Cycle: [h] placed before its lookup target(s) [a] - resolve those lookups with a deferred update pass.")


def test_batches(spark):
    tables = [("o", t, 0) for t in "edcba"] + [("o", t, 1) for t in "xyz"]
    tiers = spark.createDataFrame(tables, "org_key string, table string, tier int")
    rows = load_batches(tiers, 2).orderBy("file_no", "pos").collect()
    assert [(r.file_no, r.part, r.total_parts, r.pos, r.table) for r in rows] == [
        (1, 1, 3, 1, "a"), (1, 1, 3, 2, "b"), (2, 2, 3, 1, "c"), (2, 2, 3, 2, "d"), (3, 3, 3, 1, "e"),
        (4, 1, 2, 1, "x"), (4, 1, 2, 2, "y"), (5, 2, 2, 1, "z")]
    assert [r.label for r in rows if r.pos == 1] == [
        "tier 0 pt 1/3, 2 tables", "tier 0 pt 2/3, 2 tables", "tier 0 pt 3/3, 1 table",
        "tier 1 pt 1/2, 2 tables", "tier 1 pt 2/2, 1 table"]
    assert [r.order_no for r in rows] == list(range(1, 9))
    assert [r.reverse_no for r in rows] == list(range(8, 0, -1))
    one = load_batches(tiers, 40).orderBy("order_no").collect()
    assert [r.label for r in one if r.pos == 1] == ["tier 0, 5 tables", "tier 1, 3 tables"]
    assert load_batches(tiers, 0).select("file_no").distinct().count() == 8
    none = spark.createDataFrame([], "org_key string, src string, dst string")
    assert plan_summary(load_batches(tiers, 2), none).first().asDict() == {
        "org_key": "o", "n_tables": 8, "n_tiers": 2, "n_batches": 5, "n_outputs": 10, "n_warnings": 0}
