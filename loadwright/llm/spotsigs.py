"""SpotSigs fingerprints: chains of content words that follow common words, compared as sets."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loadwright.llm.common import needed, running_sums, written

# Common words of English, German, French and Spanish.
ANCHORS = tuple("""
a an and are as at be but by for from had has have he in is it of on or she that the they this to was were with you
aber auf aus bei das dem den der des die ein eine er es für ich im ist mit nicht sich sie sind und von war wie zu zum
au aux avec ce dans de du elle en est et il je la le les mais ne nous ou par pas pour que qui sur un une
al como con del el ella está los las lo más no o para pero por se sin su sus una y
""".split())

# Content words in a chain.
CHAIN = 3

# Documents are near copies at this Jaccard similarity of their signatures.
SIMILARITY = 0.8


def add_signatures(df: DataFrame, text: str, name: str, chain: int = CHAIN, anchors: tuple[str, ...] = ANCHORS) -> DataFrame:
    """Adds the sorted set of 32-bit signatures of a text column.

    Words are runs of letters and digits in lower case.  A content word that follows an anchor, or begins the
    text, starts a signature: the anchor, it and the content words after it, ``chain`` in all, fewer at the end.
    So does, without an anchor, each content word that these do not reach, so that no content word is left out.
    In a text of common words alone every word counts as one of content.  Null texts and texts without words
    have no signature.
    """
    def common(word: Column) -> Column:
        return word.isin(*anchors)

    plain = F.trim(F.regexp_replace(F.lower(F.coalesce(F.col(text), F.lit(""))), r"[^\p{L}\p{N}]+", " "))
    # each step is a column of its own, so that no lambda evaluates it again
    places = F.sequence(F.lit(0), F.size("_w") - 1)
    split = df.withColumn("_w", F.split(plain, " ")).withColumn("_at", F.filter(
        places, lambda i: ~common(F.get("_w", i)) & (F.get("_w", i) != ""))).withColumn("_at", F.when(
            (F.size("_at") == 0) & (F.get("_w", F.lit(0)) != ""), places).otherwise(F.col("_at")))
    # the chain words before it are content words too, so none of those that reach it follows an anchor
    left_out = lambda at, k: (k >= chain) & (at - F.get("_at", k - chain) == chain)
    spots = F.transform("_at", lambda at, k: F.when(
        (at == 0) | common(F.get("_w", at - 1)) | left_out(at, k),
        F.hash(F.when((at > 0) & common(F.get("_w", at - 1)), F.get("_w", at - 1)), F.get("_w", at),
               *(F.get("_w", F.get("_at", k + i)) for i in range(1, chain)))))
    return split.withColumn(name, F.array_sort(F.array_distinct(F.array_compact(spots)))).drop("_w", "_at")


def as_text(signatures: str) -> Column:
    """A fingerprint: eight hexadecimal digits for each signature, in the order of the set."""
    return F.array_join(F.transform(signatures, lambda s: F.lpad(F.lower(F.hex(s.cast("long").bitwiseAND(
        F.lit(0xFFFFFFFF)))), 8, "0")), "")


def likeness(a: str, b: str) -> Column:
    """Jaccard similarity of two sets; two empty sets are alike."""
    common = F.size(F.array_intersect(a, b))
    all_ = F.size(a) + F.size(b) - common
    return F.when(all_ == 0, 1.0).otherwise(common / all_)


def near_pairs(prints: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(a, b, likeness) for the distinct sets of ``prints`` (id, signatures) at ``similarity`` or more; a < b by id.

    Sets are partitioned by size in steps of 1 / similarity, so partners lie in one partition or the next.  There
    they meet in the rarest of their signatures, as many as a pair this similar must share one of.  Copies meet
    in their set, named by its smallest id; empty sets are one such class.
    """
    sets = written(prints.groupBy("signatures").agg(F.min("id").alias("id")), "spotsigs-sets")
    spread = sets.where(F.size("signatures") > 0).select("id", F.explode("signatures").alias("s"))
    rarity = spread.groupBy("s").agg(F.count(F.lit(1)).alias("n"))
    ranked = spread.join(rarity, "s").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("n", "s"))).alias("by_rarity"))
    size = F.size("by_rarity")
    first = F.slice("by_rarity", F.lit(1), (size - F.ceil(size * similarity - 1e-9) + 1).cast("int"))
    step = F.floor(F.log(size.cast("double")) / math.log(1 / similarity)).cast("int")
    keyed = written(ranked.select("id", size.alias("size"), step.alias("step"), F.explode(first).alias("e")).select(
        "id", "size", "step", "e.s"), "spotsigs-keys")
    left = keyed.select(F.col("id").alias("x"), F.col("size").alias("m"), "s", "step")
    right = keyed.select(F.col("id").alias("y"), F.col("size").alias("n"), "s",
                         F.explode(F.array("step", F.col("step") + 1)).alias("step"))
    fits = (F.col("n") >= F.col("m") * similarity - 1e-9) & ((F.col("n") < F.col("m")) | (
        (F.col("n") == F.col("m")) & (F.col("y") < F.col("x"))))
    met = (left["s"] == right["s"]) & (left["step"] == right["step"]) & fits
    pairs = left.join(right, met).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
    one, two = sets.toDF("_one", "a"), sets.toDF("_two", "b")
    return pairs.join(one, "a").join(two, "b").select("a", "b", likeness("_one", "_two").alias("likeness")).where(
        F.col("likeness") >= similarity)


def with_next(docs: DataFrame) -> DataFrame:
    """doc_id, text, signatures, next_start, next_signatures for each row of ``docs``.

    The next document is the one with the next smaller id, after the last the first; of documents with one id
    that with the next text hash, null ids last.  Rows that agree in id and text are one document, and have the
    same next.  ``next_start`` is as much of its text as a third of this one's characters.
    """
    own = add_signatures(needed(docs, "doc_id", "text").withColumn("_key", F.xxhash64("doc_id", "text")), "text", "signatures")
    slim = written(needed(docs, "doc_id", "text").select(
        "doc_id", F.xxhash64("doc_id", "text").alias("_key"),
        F.floor(F.coalesce(F.length("text"), F.lit(0)) / 3).cast("int").alias("_third")), "spotsigs-ids")
    order = [F.col("doc_id").desc_nulls_last(), F.col("_key")]
    places = written(running_sums(slim.distinct(), order, {"_place": F.lit(1).cast("long")}), "spotsigs-places")
    n = places.count()
    after = places.select(F.col("doc_id").alias("_to_id"), F.col("_key").alias("_to_key"), F.col("_third").alias("_length"),
                          F.pmod(F.col("_place") + 1, F.lit(max(n, 1))).alias("_place"))
    # who is to receive the start of a document: the one before it
    links = written(places.join(after, "_place").select(
        F.col("doc_id").alias("_from_id"), F.col("_key").alias("_from_key"), "_to_id", "_to_key", "_length"), "spotsigs-links")
    # both joins have the same kind of keys, so the documents are shuffled once for the two
    to_send = (own["_key"] == links["_from_key"]) & own["doc_id"].eqNullSafe(links["_from_id"])
    sent = own.join(links, to_send).select(
        "_to_id", "_to_key", F.expr("substring(text, 1, _length)").alias("next_start"),
        F.col("signatures").alias("next_signatures"))
    if slim.count() > n:
        sent = sent.dropDuplicates(["_to_id", "_to_key"])
    met = (own["_key"] == sent["_to_key"]) & own["doc_id"].eqNullSafe(sent["_to_id"])
    return own.join(sent, met).select("doc_id", "text", "signatures", "next_start", "next_signatures")


def compare_with_edits(docs: DataFrame) -> DataFrame:
    """Each document's fingerprint beside that of its edited text and of the next document.

    The edited text has its last third of characters, rounded down, replaced by the first as many of the next
    document, or all of it.  Null texts are empty.
    """
    whole = F.coalesce("text", F.lit(""))
    n = F.length(whole)
    edited = with_next(docs).withColumn("_edited", F.concat(
        F.substring(whole, F.lit(1), (n - F.floor(n / 3)).cast("int")), F.coalesce("next_start", F.lit(""))))
    both = add_signatures(edited, "_edited", "_after")
    return both.select(
        "doc_id", n.cast("long").alias("n_chars"), F.sha2("_edited", 256).alias("edited_sha256"),
        as_text("signatures").alias("fingerprint"), as_text("_after").alias("edited_fingerprint"),
        likeness("signatures", "_after").alias("near_edited"),
        likeness("signatures", "next_signatures").alias("near_next"))
