"""Near-duplicate operators against brute force."""

import hashlib
import random
import re

import numpy as np
import pytest
import xxhash

from loadwright.llm import lattice, lines, simhash, spotsigs, substrings
from loadwright.llm.common import components
from tests.llm.data import COPY, DOCS, Groups, documents


def words(text):
    return (text or "").encode().split()


def brute_simhash(text):
    found = [w.lower() for w in words(text)]
    if not found:
        return 0
    hashes = [xxhash.xxh64_intdigest(b" ".join(found[i:i + 4]), 42) for i in range(max(1, len(found) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(1000 + i, 1001 + i) for i in range(40)]
    groups = Groups()
    for a, b in edges:
        if a != b:
            groups.join(a, b)
    found = components(spark.createDataFrame(edges, "a long, b long"), "test")
    assert {(r.node, r.root) for r in found.collect()} == {(x, groups.find(x)) for x in groups.up}
    assert components(spark.createDataFrame([], "a long, b long"), "test").count() == 0


def test_covering_masks_hold_for_all_small_sets():
    for radius in (1, 2, 4):
        masks = simhash.covering_masks(radius)
        rng = random.Random(radius)
        for _ in range(2000):
            bits = sum(1 << b for b in rng.sample(range(64), radius))
            assert any(not m & bits for m in masks)


@pytest.mark.parametrize("dense", [1, 4096])
@pytest.mark.parametrize("radius", [3, 4])
def test_fingerprint_links_connect_as_all_pairs(spark, dense, radius):
    rng = random.Random(5)
    prints = set()
    for _ in range(25):
        base = rng.getrandbits(64)
        for _ in range(8):
            prints.add(base ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(6))))
    signed = {p - (1 << 64) if p >> 63 else p for p in prints}
    want = Groups()
    for a in signed:
        for b in signed:
            if a < b and ((a ^ b) & (1 << 64) - 1).bit_count() <= radius:
                want.join(a, b)
    got = Groups()
    frame = spark.createDataFrame([(p,) for p in signed], "fp long")
    for a, b in simhash.fingerprint_links(frame, radius, dense).collect():
        assert ((a ^ b) & (1 << 64) - 1).bit_count() <= radius
        got.join(a, b)
    assert sorted(map(sorted, want.sets())) == sorted(map(sorted, got.sets()))


def test_simhash_documents(spark):
    found = simhash.near_duplicates(documents(spark)).collect()
    assert len(found) == len(DOCS)
    groups = Groups()
    prints = [(i, brute_simhash(t)) for i, t, *_ in DOCS]
    for a, x in prints:
        for b, y in prints:
            if a is not None and b is not None and (x ^ y).bit_count() <= 4:
                groups.join(a, b)
    by_id = {i: p for i, p in prints if i is not None}
    for r in found:
        if r.doc_id is not None:
            assert r.fp & (1 << 64) - 1 == by_id[r.doc_id] and r.component_id == groups.find(r.doc_id)
    assert {r.component_id for r in found if r.doc_id is None} == {0, 4}
    assert simhash.near_duplicates(documents(spark, [])).count() == 0


def test_simhash_keeps_one(spark):
    kept = simhash.keep_one(documents(spark)).collect()
    assert sorted(r.doc_id for r in kept) == sorted({simhash_component(i) for i, *_ in DOCS if i is not None})
    assert kept[0].fp == "x"


def simhash_component(doc_id):
    by_id = {i: brute_simhash(t) for i, t, *_ in DOCS if i is not None}
    groups = Groups()
    for a, x in by_id.items():
        for b, y in by_id.items():
            if (x ^ y).bit_count() <= 4:
                groups.join(a, b)
    return groups.find(doc_id)


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


def test_edits_within():
    rng = random.Random(8)
    for _ in range(3000):
        a = "".join(rng.choice("abcé ") for _ in range(rng.randrange(30)))
        b = list(a)
        for _ in range(rng.randrange(6)):
            at = rng.randrange(len(b) + 1)
            b[at:at + rng.randrange(2)] = rng.choice(["", "x", "a", "bb"])
        b = "".join(b) if rng.random() < 0.9 else "".join(rng.choice("abc") for _ in range(rng.randrange(30)))
        most = rng.randrange(8)
        assert lines.within(a, b, most) == (edit_distance(a, b) <= most), (a, b, most)


def test_lines(spark):
    rng = random.Random(3)
    vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(400)]
    line = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    shared = [line(60) for _ in range(6)]
    rows = list(DOCS[:3])
    for i in range(100, 140):
        base = shared[i % 6].split()
        base[rng.randrange(60)] = rng.choice(vocabulary)
        rows.append((i, "\n".join([line(12), " ".join(base), "", "- - -", shared[i % 5].upper() + "!"]), "en", "a"))
    normal = lambda t: re.sub(r"\d+", "0", re.sub(r"[\W_]+", " ", t.lower())).strip()
    places = [(i, n, normal(t)) for i, text, *_ in rows for n, t in enumerate((text or "").split("\n"))]
    places = sorted(p for p in places if p[2] and p[2].count(" ") >= 2)
    distinct = sorted({p[2] for p in places})
    prints = dict(zip(distinct, lines.fingerprints(distinct).tolist()))
    groups = Groups()
    for t in distinct:
        groups.find(t)
    for a in distinct:
        for b in distinct:
            if a < b and ((prints[a] ^ prints[b]) & (1 << 64) - 1).bit_count() <= 3:
                if edit_distance(a, b) <= 0.2 * max(len(a), len(b)):
                    groups.join(a, b)
    assert len(groups.sets()) < len(distinct)
    first, gone = {}, set()
    for i, n, t in places:
        if groups.find(t) in first:
            gone.add((i, n))
        first.setdefault(groups.find(t), (i, n))
    found = lines.drop_repeated(documents(spark, rows)).collect()
    assert len(found) == len(rows)
    for r in found:
        text = dict((i, t) for i, t, *_ in rows)[r.doc_id]
        kept = None if text is None else "\n".join(x for n, x in enumerate(text.split("\n")) if (r.doc_id, n) not in gone)
        assert r.text == kept and (kept == text or r.n_chars == len(kept))


def test_lines_of_awkward_documents(spark):
    found = {(r.doc_id, r.n_lines, r.n_removed) for r in lines.line_report(documents(spark)).collect()}
    assert {(0, 1, 0), (1, 0, 0), (4, 1, 0), (5, 1, 1), (9, 3, 2), (None, 1, 1), (None, 0, 0)} <= found
    assert lines.line_report(documents(spark, [])).count() == 0


def test_line_fingerprints_of_a_long_line():
    long = " ".join(f"w{i}" for i in range(450_000))
    assert lines.fingerprints([long, "a b c", long]).tolist()[::2] == [lines.fingerprints([long])[0]] * 2


def test_lattice_finds_pairs_at_the_threshold(spark):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(300, 64))
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    other = rng.normal(size=base.shape)
    other -= (other * base).sum(axis=1, keepdims=True) * base
    other /= np.linalg.norm(other, axis=1, keepdims=True)
    near = 0.9505 * base + np.sqrt(1 - 0.9505**2) * other
    family = base[0] + 0.02 * rng.normal(size=(60, 64))
    vectors = np.vstack([base, near, family]).tolist()
    odd = [None, [], [0.0] * 64, [float("nan")] + [1.0] * 63, [None] + [1.0] * 63, [1.0, 2.0], [2.0, 4.0], vectors[0], vectors[0]]
    rows = list(enumerate(vectors + odd)) + [(None, [3.0] * 64)]
    frame = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "vec_id long, embedding array<double>, key string, n int")
    found = lattice.near_duplicates(frame).collect()
    assert len(found) == len(rows)
    links = {r.vec_id: r.n_links for r in found}
    x = np.array([v if v and len(v) == 64 and None not in v else [0.0] * 64 for _, v in rows], float)
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    with np.errstate(all="ignore"):
        cos = np.nan_to_num((x / norm) @ (x / norm).T)
    np.fill_diagonal(cos, 0)
    want = (cos >= 0.95).sum(axis=1)
    n = len(vectors)
    assert all(links[i] <= want[i] for i in range(n)) and sum(links[i] for i in range(n)) >= 0.97 * want[:n].sum()
    assert [links[n + i] for i in range(5)] == [0] * 5 and links[n + 5] == links[n + 6] == 1
    component = {r.vec_id: r.component_id for r in found}
    assert component[n + 7] == component[n + 8] == component[0] == 0 and component[n + 2] == n + 2
    assert all(r.kept == (r.vec_id == r.component_id) for r in found if r.vec_id is not None)
    assert lattice.near_duplicates(frame.limit(0)).count() == 0


def test_lattice_blocks_give_the_same_links(spark, monkeypatch):
    rng = np.random.default_rng(4)
    vectors = (rng.normal(size=64) + 0.05 * rng.normal(size=(200, 64))).tolist()
    frame = spark.createDataFrame(list(enumerate(vectors)), "vec_id long, embedding array<double>")
    whole = {(r.vec_id, r.n_links, r.component_id) for r in lattice.near_duplicates(frame).collect()}
    monkeypatch.setattr(lattice, "_BLOCK", 16)
    assert whole == {(r.vec_id, r.n_links, r.component_id) for r in lattice.near_duplicates(frame).collect()}


def test_nearest_e8_is_the_nearest():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(200, 8)) * 2
    found = lattice.nearest_e8(x)
    assert ((2 * found) % 1 == 0).all() and (found.sum(axis=1) % 2 == 0).all()
    steps = [np.zeros(8)] + [s * np.eye(8)[i] + t * np.eye(8)[j] for i in range(8) for j in range(i) for s in (1, -1) for t in (1, -1)]
    steps += [np.array([0.5 if not m >> i & 1 else -0.5 for i in range(8)]) for m in range(256) if m.bit_count() % 2 == 0]
    around = found[:, None, :] + np.array(steps)
    assert (((x[:, None, :] - around) ** 2).sum(axis=2).argmin(axis=1) == 0).all()


def brute_repeats(rows):
    first = {}
    order = lambda i: (i is None, i or 0)
    for i, text in sorted(rows, key=lambda r: order(r[0])):
        w = words(text)
        for p in range(len(w) - 12):
            first.setdefault(tuple(w[p:p + 13]), i)
    for i, text in rows:
        w = words(text)
        gone = [False] * len(w)
        for p in range(len(w) - 12):
            if order(first[tuple(w[p:p + 13])]) < order(i):
                gone[p:p + 13] = [True] * 13
        yield i, len(w), sum(gone), b" ".join(x for x, g in zip(w, gone) if not g)


@pytest.mark.parametrize("hot", [2, 4096])
def test_substrings(spark, hot):
    rng = random.Random(7)
    vocabulary = ["a", "b", "c", "the", "of"] + [f"w{i}" for i in range(50)]
    text = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    passages = [text(rng.randrange(13, 80)) for _ in range(8)] + [["x"] * 40]
    rows = [(i, t) for i, t, *_ in DOCS if i != 3]
    for i in range(100, 180):
        parts = text(rng.randrange(40))
        for _ in range(rng.randrange(4)):
            p = rng.choice(passages)
            a = rng.randrange(len(p))
            parts += p[a:] + text(rng.randrange(20))
        rows.append((i, " ".join(parts)))
    rng.shuffle(rows)
    found = substrings.remove_repeats(documents(spark, [(i, t, "en", "a") for i, t in rows]), hot)
    got = sorted(((r.doc_id, r.n_words, r.n_removed, bytes(r.kept)) for r in found.collect()), key=str)
    assert got == sorted(brute_repeats(rows), key=str)


def test_substrings_empty_table_and_long_text(spark):
    assert substrings.remove_repeats(documents(spark, [])).count() == 0
    found = {r.doc_id: r for r in substrings.remove_repeats(documents(spark, [DOCS[3], (90, DOCS[3][1], "en", "a")])).collect()}
    assert found[90].n_removed == found[90].n_words == 120_000 and found[3].n_removed == 0


def test_index_over_several_shards(spark, monkeypatch):
    monkeypatch.setattr(substrings, "_STRETCHES", 5)
    test_substrings(spark, 2)


def test_spotsigs_with_next(spark):
    rows = [r for r in DOCS if r[0] is not None]
    found = spotsigs.compare_with_edits(documents(spark)).collect()
    assert len(found) == len(DOCS)
    once = {i: t or "" for i, t, *_ in rows}
    ids = sorted(once, reverse=True)
    by_id = {r.doc_id: r for r in found}
    # nulls stand last, so they come between the smallest id and the largest
    for i, following in zip(ids, ids[1:]):
        text, n = once[i], len(once[i]) // 3
        edited = text[:len(text) - n] + once[following][:n]
        assert by_id[i].n_chars == len(text) and by_id[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
    assert by_id[4].fingerprint == by_id[5].fingerprint != by_id[6].fingerprint and by_id[10].fingerprint != ""
    assert by_id[5].near_next == 1.0 and 0 < by_id[6].near_next < 1
    assert spotsigs.compare_with_edits(documents(spark, [])).count() == 0


def test_spotsigs_pairs(spark):
    rng = random.Random(9)
    sets = {}
    for i in range(60):
        base = sets.get(i - 1) if i % 3 else None
        new = {rng.randrange(10_000) for _ in range(rng.randrange(1, 40))} if not base else set(sorted(base)[rng.randrange(5):])
        sets[i] = new or {1}
    frame = spark.createDataFrame([(i, sorted(s)) for i, s in sets.items()], "id long, signatures array<int>")
    got = {(r.a, r.b) for r in spotsigs.near_pairs(frame).collect()}
    firsts = {}
    for i, s in sets.items():
        firsts.setdefault(frozenset(s), i)
    want = {(a, b) for s, a in firsts.items() for t, b in firsts.items() if a < b and len(s & t) >= 0.8 * len(s | t)}
    assert want == got and want


def test_copy_is_long_enough():
    assert len(COPY.split()) > 13
