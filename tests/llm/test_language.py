"""Phrases, quality and resampling against plain Python."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from loadwright.llm import phrases, quality, resampling
from tests.llm.data import DOCS, LONG, documents, labels

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def mined(rows, least, top):
    """Phrases by counting every run of every piece."""
    counts, totals = defaultdict(Counter), Counter()
    for _, text, lang, *_ in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", (text or "").translate(UPPER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(words)
            for k in range(1, 6):
                counts[lang].update(tuple(words[i:i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, f in counts.items():
        known = {p: n for p, n in f.items() if len(p) > 1 and n >= least}
        found = []
        for p, a in known.items():
            covered = any(
                len(q) > len(p) and b >= a and any(q[i:i + len(p)] == p for i in range(len(q) - len(p) + 1))
                for q, b in known.items())
            if not covered:
                score, _, l, r = min(
                    (1000 * a * totals[lang] // (f[p[:k]] * f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
                found.append((-score, -a, " ".join(p).encode(), l, r))
        for rank, (score, a, p, l, r) in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, p.decode(), -a, l, r, totals[lang], -score))
    return sorted(out)


def phrase_rows(seed):
    rng = random.Random(seed)
    words = ["a", "B", "c", "dd", "é", "日本", "x y", "\x1c"]
    rows = list(DOCS)
    for i in range(60):
        text = "".join(rng.choice(words) + rng.choice([" ", " ", " ", "\t", "  ", ". ", "\n", "!?"]) for _ in range(rng.randrange(120)))
        rows.append((100 + i, text, rng.choice(["en", "en", None, "und", "fr"]), "a"))
    return rows + [rows[-1]] * 5 + [(900, "b " * 3000 + "c", "en", "a")]


@pytest.mark.parametrize("least, top", [(1, 40), (3, 7), (20, 2000)])
def test_phrases_against_counting(spark, monkeypatch, least, top):
    rows = [r for r in phrase_rows(least) if r[1] is not LONG] if least < 20 else phrase_rows(least)
    monkeypatch.setattr(phrases, "_PARTS", 3)
    found = phrases.mine_phrases(documents(spark, rows), least, top)
    assert sorted(map(tuple, found.collect())) == mined(rows, least, top)


def test_phrases_hold_with_full_bit_tables(spark, monkeypatch):
    # bits that are all set prune nothing and change nothing
    rows = [r for r in phrase_rows(9) if r[1] is not LONG]
    monkeypatch.setattr(phrases, "LEAST_BITS", 6)
    monkeypatch.setattr(phrases, "MOST_BITS", 6)
    found = phrases.mine_phrases(documents(spark, rows), 5)
    assert sorted(map(tuple, found.collect())) == mined(rows, 5, phrases.TOP)
    assert phrases.mine_phrases(documents(spark, [])).count() == 0
    few = [(1, "b", "fr", "a"), (2, "a c", "en", "a"), (3, "a c", "en", "a"), (4, ".", "de", "a")]
    assert sorted(map(tuple, phrases.mine_phrases(documents(spark, few), 2).collect())) == mined(few, 2, 9)


def test_chunks_own_every_word_once():
    text = " ".join(f"w{i % 50}" for i in range(1000)).encode() + b". x y,z\nq"
    found = [c.split(b"\t") for c in phrases.chunks(text)]
    assert len(found) > 15 and all(len(c) < 3 for c in found)
    assert b" ".join(c[0] for c in found) == text.replace(b".", b"").replace(b",", b" ").replace(b"\n", b" ")
    assert {len(c[1].split()) for c in found if len(c) > 1} == {phrases.OVERLAP}
    assert list(phrases.chunks(None)) == list(phrases.chunks(b" \t\n.")) == []


def test_chunks_of_a_shared_passage_are_shared():
    shared = " ".join(f"w{i % 61}" for i in range(300))
    one, two = (Counter(phrases.chunks(f"{head} {shared}".encode())) for head in ("one start here", "two"))
    assert sum((one & two).values()) >= 0.8 * max(len(one), len(two))


def test_quality_on_held_out_labels(spark):
    rng = random.Random(3)
    rows, marks = list(DOCS), []
    for i in range(100, 1100):
        words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 9))) for _ in range(rng.randrange(20, 90))]
        bad = i % 4 == 0
        if bad:
            words = [w.upper() + "!!" if i % 8 else w + rng.choice(["&&&", "$$$"]) for w in words]
        rows.append((i, " ".join(words), "en", "a"))
        marks.append((i, int(not bad), None))
    marks += [(None, 1, 1), (4, None, 0), (5, 7, 0), (101, 1, 0), (101, 1, 0)]
    found = {r.doc_id: r for r in quality.score_documents(documents(spark, rows), labels(spark, marks)).collect()}
    held = [(found[i], q) for i, q, _ in marks[:1000] if zlib.crc32(str(i).encode()) % 4 == 2]
    assert len(held) > 100 and all(r.held_out and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r, _ in held)
    assert sum(r.predicted == q for r, q in held) >= 0.97 * len(held) and {0, 1, None} <= found.keys()
    kept = {r.doc_id for r in quality.keep_good(documents(spark, rows), labels(spark, marks)).collect()}
    assert kept - {None} == {i for i, r in found.items() if r.predicted and i is not None}


def test_quality_without_labels(spark):
    found = quality.score_documents(documents(spark), labels(spark, [])).collect()
    assert len(found) == len(DOCS) and {r.score for r in found} == {0.5}
    assert quality.score_documents(documents(spark, []), labels(spark, [(1, 1, 1)])).count() == 0


@pytest.mark.parametrize("text", ["one", "a bb a", "Éç 日本語 x", "퟿\U0001F600 yy", "aa aa aa", "", " \n"])
def test_quality_features_by_hand(text, monkeypatch):
    # each word once, one n-gram for each place inside " word ", one marker for each repeat
    words = text.split()
    grams = [f" {w} "[i:i + n] for w in words for n in (2, 3, 4) for i in range(len(w) + 3 - n)]
    repeats = sum(a == b for a, b in zip(words, words[1:]))
    found = quality.features(text)
    assert found.total == len(words) + len(grams) + repeats == found.count.sum()
    assert len(found.index) <= len(set(words)) + len(set(grams)) + (repeats > 0)
    whole = Counter(dict(zip(found.index.tolist(), found.count.tolist())))
    monkeypatch.setattr(quality, "STRETCH", 1)
    if not repeats:
        cut = quality.features(text)
        assert Counter(dict(zip(cut.index.tolist(), cut.count.tolist()))) == whole


def resampled(rows, target):
    def features(text):
        words = re.findall(r"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (text or "").translate(UPPER))
        return len(words), [zlib.crc32(" ".join(words[i:i + k]).encode()) % 10000
                            for k in (1, 2, 3) for i in range(len(words) - k + 1)]

    docs = [(i, *features(text)) for i, text, *_ in rows]
    raw, aim = Counter(b for _, _, f in docs for b in f), Counter(b for text in target for b in features(text)[1])
    s, t = sum(raw.values()), sum(aim.values())
    gain = {b: math.floor(1000 * math.log((aim[b] + 1) * (s + 10000) / ((raw[b] + 1) * (t + 10000)))) for b in raw}
    out = []
    for i, n, f in docs:
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in f)
        out.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n])
    enough = sorted((r for r in out if r[5] >= 20), key=lambda r: (-r[3], -1 if r[0] is None else r[0], r[1], r[2]))
    for rank, r in enumerate(enough[:5 * len(enough) // 100], 1):
        r[4] = rank
    return Counter(tuple(r[:5]) for r in out)


def test_resampling_against_plain_python(spark):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(60)] + ["Ä", "ß", "日本", "A-B", "x_y", "7.5", " ", " "]
    rows = list(DOCS) + [(100 + i, " ".join(rng.choice(words) for _ in range(rng.randrange(60))), "en", "a") for i in range(200)]
    rows += [rows[-1], rows[-2]]
    target = [None, "", "w1 w2 w3 W1 W2", "日本 ß w7 w8"]
    docs = documents(spark, rows)
    aim = spark.createDataFrame([(t, 1) for t in target], "text string, n_words int")
    want = resampled(rows, target)
    assert Counter(map(tuple, resampling.score_documents(docs, aim).collect())) == want
    drawn = {i for i, *_, rank in want if rank}
    kept = resampling.resample(docs, aim)
    assert kept.columns == docs.columns
    assert Counter(r.doc_id for r in kept.collect()) == Counter(r[0] for r in rows if r[0] in drawn)
    assert Counter(map(tuple, resampling.score_documents(docs, aim.limit(0)).collect())) == resampled(rows, [])
    assert resampling.score_documents(docs.limit(0), aim).count() == 0


def test_resampling_spans():
    found = resampling.grams("Ab  c-Ab\tc".encode())
    want = [zlib.crc32(g) % 10000 for g in (b"ab", b"c", b"ab", b"c", b"ab c", b"c ab", b"ab c", b"ab c ab", b"c ab c")]
    assert found.n_words == 4 and found.buckets.tolist() == want
    assert resampling.grams(b"...").n_words == 0 and len(resampling.grams(None).buckets) == 0
    assert np.array_equal(resampling.grams(b"one").buckets, [zlib.crc32(b"one") % 10000])
