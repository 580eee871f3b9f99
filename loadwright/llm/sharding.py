"""Shards of near equal bytes: a consistent-hash ring with virtual nodes and bounded loads."""

from __future__ import annotations

from bisect import bisect_left
from zlib import crc32

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loadwright.llm.common import needed, running_sums, written

SHARDS, NODES = 40, 64

# A shard is full at this share above the mean.
SLACK = 0.0005

# The ring's arcs, and how many rows of mean size above which a row is placed alone fill a shard.
ARCS, HEAVY = 1 << 16, 256

# Bytes that a row has besides its text.
OVERHEAD = 16


class Ring:
    """Virtual nodes in clockwise order, the loads of their shards, and the bound on them."""

    def __init__(self, shards: int, nodes: int, bound: int):
        points = sorted((crc32(f"shard-{s}/{n}".encode()), s) for s in range(shards) for n in range(nodes))
        self.points, self.owner = [p for p, _ in points], [s for _, s in points]
        self.next = list(range(len(points) + 1))
        self.load, self.bound = [0] * shards, bound
        self.full = 0

    def _open(self, node: int) -> int:
        """The first node at or after this one whose shard is not full; a wrap counts as the end of the list."""
        path = []
        while node < len(self.owner) and (self.next[node] != node or self.load[self.owner[node]] >= self.bound):
            if self.next[node] == node:
                self.next[node] = node + 1
            path.append(node)
            node = self.next[node]
        for step in path:
            self.next[step] = node
        return node

    def clockwise(self, point: int):
        """Shards with room left, in the order in which a key at ``point`` meets them."""
        start = bisect_left(self.points, point)
        for first, end in ((start, len(self.owner)), (0, start)):
            node = self._open(first)
            while node < end:
                yield self.owner[node]
                node = self._open(node + 1)

    def place_whole(self, point: int, size: int) -> int:
        """The first shard that has room for all of it, or else the emptiest."""
        tried = set()
        for shard in self.clockwise(point):
            if self.load[shard] + size <= self.bound:
                break
            tried.add(shard)
            if len(tried) == len(self.load):
                shard = None
                break
        else:
            shard = None
        if shard is None:
            shard = min(range(len(self.load)), key=lambda s: (self.load[s], s))
        self.load[shard] += size
        return shard

    def place_parts(self, point: int, size: int) -> list[tuple[int, int]]:
        """(shard, bytes): the first shards take what they have room for, the rest goes on clockwise."""
        parts = []
        while size:
            shard = next(self.clockwise(point), None)
            taken = size if shard is None else min(size, self.bound - self.load[shard])
            shard = min(range(len(self.load)), key=lambda s: (self.load[s], s)) if shard is None else shard
            self.load[shard] += taken
            parts.append((shard, taken))
            size -= taken
        return parts


def shard(docs: DataFrame, shards: int = SHARDS, nodes: int = NODES, slack: float = SLACK) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot for each row of ``docs``.

    A row's place on the ring follows its text, so equal texts go to one shard as far as it has room.  Rows so
    large that only some thousands of them can exist go first, largest first; then the arcs of the ring, each to
    the shards clockwise of it up to their bound.  An arc may be cut at any row, so a text of which a third of all
    rows are copies fills one shard after the other.  What passes through the driver is the bytes of the arcs and
    the large rows, both of bounded number.

    A null text has no bytes.  Slots count from 0 in each shard without gaps.  An empty table gives no rows.
    """
    text = F.coalesce("text", F.lit(""))
    slim = written(
        needed(docs, "doc_id", "text").select(
            "doc_id", (F.octet_length(text) + OVERHEAD).cast("long").alias("size"),
            F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"), F.xxhash64(text).alias("_text"))
        .withColumn("_point", F.shiftrightunsigned("_text", 32)),
        "shard-rows")
    spark = docs.sparkSession
    total = slim.agg(F.sum("size")).first()[0] or 0
    ring = Ring(shards, nodes, -(-int(total * (1 + slack)) // shards) if total else 1)

    heavy = F.col("size") * (shards * HEAVY) > total
    arc = F.when(~heavy, F.floor(F.col("_point") / ((1 << 32) // ARCS)))
    flagged = slim.withColumn("_arc", arc).withColumn("_light", F.when(heavy, 0).otherwise(F.col("size")))
    order = [F.col("_arc").asc_nulls_first(), F.when(heavy, -F.col("size")), F.col("_text"), F.col("doc_id"), F.col("text_crc32")]
    placed = written(running_sums(flagged, order, {"_rank": F.lit(1).cast("long"), "_start": F.col("_light")}), "shard-order")

    # each is over total / (shards x HEAVY) bytes, so there are fewer than shards x HEAVY
    large = placed.where("_arc IS NULL").select("_rank", "size", "_point").orderBy("_rank").collect()
    slots, alone = [0] * shards, []
    for row in large:
        where = ring.place_whole(row["_point"], row["size"])
        alone.append((row["_rank"], where, slots[where]))
        slots[where] += 1
    # at most ARCS rows
    arcs = placed.where("_arc IS NOT NULL").groupBy("_arc").agg(F.sum("size").alias("bytes")).orderBy("_arc").collect()
    starts, begin = {}, 0
    for row in arcs:
        starts[row["_arc"]] = begin
        begin += row["bytes"]
    pieces = []
    # a fixed shuffle of the arcs, so that no part of the ring is served last
    for row in sorted(arcs, key=lambda r: (r["_arc"] * 40503 % ARCS, r["_arc"])):
        at = starts[row["_arc"]]
        for where, taken in ring.place_parts((row["_arc"] + 1) * ((1 << 32) // ARCS) - 1, row["bytes"]):
            pieces.append((row["_arc"], len(pieces), at, at + taken, where))
            at += taken

    ones = spark.createDataFrame(alone, "_large long, shard int, slot long")
    parts = spark.createDataFrame(pieces, "_of long, _piece long, _from long, _to long, shard int")
    first = spark.createDataFrame(list(enumerate(slots)), "shard int, _taken long")
    # both sides of the joins with large rows, pieces and shards are bounded as said above
    single = placed.where("_arc IS NULL").join(F.broadcast(ones), F.col("_rank") == F.col("_large"))
    within = (F.col("_arc") == F.col("_of")) & (F.col("_start") >= F.col("_from")) & (F.col("_start") < F.col("_to"))
    cut = placed.where("_arc IS NOT NULL").join(F.broadcast(parts), within)
    before = Window.partitionBy("shard").orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    bases = (
        cut.groupBy("_piece", "shard").agg(F.count(F.lit(1)).alias("_rows"), F.min("_rank").alias("_first"))
        .join(F.broadcast(first), "shard")
        .select("_piece", (F.col("_taken") + F.coalesce(F.sum("_rows").over(before), F.lit(0)) - F.col("_first")).alias("_base"))
    )
    many = cut.join(F.broadcast(bases), "_piece").withColumn("slot", F.col("_base") + F.col("_rank"))
    names = ["doc_id", "size", "text_crc32", "shard", "slot"]
    return single.select(*names).union(many.select(*names))
