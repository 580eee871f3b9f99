"""SimHash where sides come from an explode, and as a step of the pipeline's stage."""

import xxhash

from loadwright.llm import simhash
from tests.helpers import plan_of


def test_buckets_are_not_broadcast_by_an_estimate(spark, monkeypatch):
    plans, written = {}, simhash.written

    def noted(df, label):
        plans[label] = plan_of(df)
        return written(df, label)

    monkeypatch.setattr(simhash, "written", noted)
    prints = written(spark.sql("SELECT id * 1048577 AS fp FROM range(40) UNION ALL SELECT id * 1048577 ^ 1 FROM range(40)"), "prints")
    links = simhash.fingerprint_links(prints, dense=2)
    assert "Broadcast" not in plans["simhash-buckets"]
    # only the table of flips is, which has one row for each mask
    assert plan_of(links).count("BroadcastExchange") == plan_of(links).count("Scan ExistingRDD")
    # each has one that differs in the last bit
    assert {fp for link in links.collect() for fp in link} == {i * 1048577 ^ last for i in range(40) for last in (0, 1)}


def test_stage_links_sets_by_their_fingerprints(spark):
    base = [f"word{i * i % 1009}" for i in range(400)]
    texts = [" ".join(base), " ".join([*base, "end"]), " ".join(f"other{i}" for i in range(50))]
    sets = [simhash._shingles(t.encode(), 5) for t in texts]
    # without samples only fingerprints are left to meet by
    rows = [(bytearray(xxhash.xxh128_digest(s.tobytes())), simhash._majority(s), []) for s in sets]
    docs = spark.createDataFrame([(t,) for t in texts], "text string").selectExpr("xxhash64(text) AS _text", "text")
    of_text = {r.text: r._text for r in docs.collect()}
    frame = spark.createDataFrame([(n, of_text[t], f, k) for t, (n, f, k) in zip(texts, rows)],
                                  "node binary, _text long, fp long, keys array<long>")
    links = simhash._similar_links(docs, simhash.written(frame, "sets"), 5, 0.8).collect()
    assert {frozenset(map(bytes, r)) for r in links} == {frozenset(bytes(r[0]) for r in rows[:2])}


def test_stage_compares_all_texts_of_a_class_of_fingerprints(spark):
    base = [f"word{i * i % 1009}" for i in range(400)]
    texts = [" ".join(base), " ".join([*base, "end"]), *(" ".join(f"{x}{i}" for i in range(50)) for x in ("other", "further"))]
    sets = [simhash._shingles(t.encode(), 5) for t in texts]
    nodes = [xxhash.xxh128_digest(s.tobytes()) for s in sets]
    # one class, in which each of the others is the first in turn; the two near copies meet by it alone
    for first in range(4):
        names = [bytes([i != first]) + n for i, n in enumerate(nodes)]
        docs = spark.createDataFrame([(t,) for t in texts], "text string").selectExpr("xxhash64(text) AS _text", "text")
        of_text = {r.text: r._text for r in docs.collect()}
        rows = [(bytearray(n), of_text[t], i, []) for i, (n, t) in enumerate(zip(names, texts))]
        frame = spark.createDataFrame(rows, "node binary, _text long, fp long, keys array<long>")
        links = simhash._similar_links(docs, simhash.written(frame, "sets"), 5, 0.8).collect()
        assert {frozenset(map(bytes, r)) for r in links} == {frozenset(names[:2])}
