"""Near copies that the candidate keys must not miss, against brute force on the similarity alone."""

import random

import pytest
import regex
from pyspark.sql import functions as F

import corpus_pipeline
from loadwright.llm import spotsigs
from loadwright.llm.queries import op2_line_dedup
from tests.llm.data import DOCS, Groups, documents
from tests.llm.test_near import edit_distance


def removed(spark, folder, texts):
    """Which of the lines, each a document of its own, are removed; the stage removes the same."""
    docs = documents(spark, [(i, t, "en", "a") for i, t in enumerate(texts)])
    docs.write.parquet(f"{folder}/documents.parquet")
    found = {r.doc_id for r in op2_line_dedup(spark, str(folder)).collect() if r.n_removed}
    stage = corpus_pipeline.drop_repeated_lines(spark, docs, str(folder)).collect()
    assert {r.doc_id for r in stage if r.text != texts[r.doc_id]} == found
    return found


@pytest.mark.parametrize("changed", [1, 0.1, 0.2])
def test_lines_with_changed_words_are_found(spark, tmp_path, changed):
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(3, 9)))
    texts, copies = [], set()
    for _ in range(150):
        base = [word() for _ in range(rng.randrange(5, 61))]
        near = list(base)
        for at in rng.sample(range(len(base)), changed if changed == 1 else max(1, int(changed * len(base)))):
            near[at] = word()
        a, b = " ".join(base), " ".join(near)
        texts += [a, b]
        if edit_distance(a, b) <= 0.2 * max(len(a), len(b)):
            copies.add(len(texts) - 1)
    found = removed(spark, tmp_path, texts)
    assert found <= copies and len(copies) > 50 and len(found) >= 0.97 * len(copies)


def test_short_lines_and_lines_without_spaces_are_removed(spark, tmp_path):
    texts = ["Ietzte.", "Stteen Erachtz.", "ietzte", "stteen erachtz!", "東京都は日本の首都であり世界最大の都市の一つである",
             "東京都は日本の首都であり世界最大の都市の一つである。", "東京都は日本の首部であり世界最大の都市の一つである", "a", "A!", "b", "abcdefg", "abcxefg"]
    assert removed(spark, tmp_path, texts) == {2, 3, 5, 6, 8, 11}


def test_stage_keeps_one_of_near_copies(spark):
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    rows = list(DOCS)
    for i in range(120):
        base = [word() for _ in range(rng.randrange(40, 300))]
        near = list(base)
        for at in rng.sample(range(len(base)), rng.randrange(1, 1 + len(base) // 30)):
            near[at] = word()
        rows += [(100 + 2 * i, " ".join(base), "en", "a"), (101 + 2 * i, " ".join(near), "en", "a")]
    sets = {}
    for i, text, *_ in rows:
        w = (text or "").lower().encode().split()
        sets[i] = {tuple(w[p:p + 5]) for p in range(max(1, len(w) - 4))} if w else set()
    ids = sorted(i for i in sets if i is not None)
    groups = Groups()
    for a in ids:
        groups.find(a)
        for b in ids:
            if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                groups.join(a, b)
    assert sum(len(g) > 1 for g in groups.sets()) > 50
    kept = corpus_pipeline.keep_one_of_near_copies(spark, documents(spark, rows), "").collect()
    assert sorted(r.doc_id for r in kept) == sorted(map(min, groups.sets())) and kept[0].fp == "x"


def test_spotsigs_reach_every_content_word(spark):
    plain = [f"word{i}x" for i in range(40)]
    mixed = ["der", *plain[:9], "the", *plain[9:20], "of", "the", *plain[20:]]
    texts = [" ".join(w) for w in (plain, mixed)]
    for w in (plain, mixed):
        texts += [" ".join([*w[:i], "other", *w[i + 1:]]) for i in range(len(w)) if w[i].startswith("word")]
    frame = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    found = {r.id: tuple(r.s) for r in spotsigs.add_signatures(frame, "text", "s").collect()}
    assert len(set(found.values())) == len(texts)
    assert len(set(found[0]) & set(found[2 + 39])) > 30


def spots(text):
    """Chains of a text by brute force: (anchor, words) of each signature."""
    words = regex.findall(r"[\p{L}\p{N}]+", (text or "").lower())
    content = [i for i, w in enumerate(words) if w not in spotsigs.ANCHORS] or list(range(len(words)))
    after = {i for i in content if i == 0 or words[i - 1] in spotsigs.ANCHORS}
    reached = {j for k, i in enumerate(content) if i in after for j in content[k:k + spotsigs.CHAIN]}
    out = set()
    for k, i in enumerate(content):
        if i in after or i not in reached:
            anchor = words[i - 1] if i and words[i - 1] in spotsigs.ANCHORS else None
            chain = [words[j] for j in content[k:k + spotsigs.CHAIN]]
            out.add((anchor, *chain, *[None] * (spotsigs.CHAIN - len(chain))))
    return out


def test_spotsigs_against_brute_force(spark):
    rng = random.Random(8)
    vocabulary = ["the", "a", "is", "der", "Und", "été", "Wort", "word", "x1", "日本", "fox", "dog", "hen", "cat"]
    rows = [r for r in DOCS if r[0] is not None and r[0] != 5] + [
        (100 + i, "".join(rng.choice(vocabulary) + rng.choice([" ", ", ", "\n"]) for _ in range(rng.randrange(40))), "en", "a") for i in range(150)]
    rows.append((400, rows[-1][1] + "end", "en", "a"))
    ids = sorted((i for i, *_ in rows), reverse=True)
    text = {i: t or "" for i, t, *_ in rows}
    edited = {}
    for i, j in zip(ids, ids[1:] + ids[:1]):
        cut = len(text[i]) // 3
        edited[i] = text[i][:len(text[i]) - cut] + text[j][:cut]
    chains = sorted({c for t in (*text.values(), *edited.values()) for c in spots(t)}, key=str)
    names = "anchor string, " + ", ".join(f"w{i} string" for i in range(spotsigs.CHAIN))
    hashed = spark.createDataFrame(list(enumerate_rows(chains)), "n int, " + names)
    number = {r.n: r.h for r in hashed.select("n", F.hash("anchor", *(f"w{i}" for i in range(spotsigs.CHAIN))).alias("h")).collect()}
    hash_of = {c: number[n] for n, c in enumerate(chains)}

    def prints(t):
        return sorted({hash_of[c] for c in spots(t)})

    def alike(x, y):
        x, y = set(x), set(y)
        return 1.0 if not x | y else len(x & y) / len(x | y)

    def shown(signatures):
        return "".join(f"{s & 0xFFFFFFFF:08x}" for s in signatures)

    after = dict(zip(ids, ids[1:] + ids[:1]))
    found = {r.doc_id: r for r in spotsigs.compare_with_edits(documents(spark, rows)).collect()}
    assert found.keys() == text.keys()
    for i, r in found.items():
        own, other = prints(text[i]), prints(edited[i])
        assert (r.fingerprint, r.edited_fingerprint) == (shown(own), shown(other)), i
        assert (r.near_edited, r.near_next) == (alike(own, other), alike(own, prints(text[after[i]]))), i


def enumerate_rows(chains):
    for n, chain in enumerate(chains):
        yield (n, *chain)
