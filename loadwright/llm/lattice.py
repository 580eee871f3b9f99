"""Near duplicates among embeddings: random projections decoded to E8 lattice points, neighbouring cells probed."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loadwright.llm.common import components, written

COSINE = 0.95

# Tables; lattice points that make up a cell; neighbours probed for each of them; width of a cell.
TABLES, POINTS, PROBES, WIDTH, SEED = 10, 4, 2, 2.5, 7

# Of a cell with more members, blocks of about this size are compared two at a time.
_BLOCK = 1024
_CHUNK = 2048


def _d8(x: np.ndarray) -> np.ndarray:
    """Nearest points with integer coordinates of even sum."""
    near = np.rint(x)
    off = x - near
    odd = np.flatnonzero(near.sum(axis=1).astype(np.int64) & 1)
    worst = np.abs(off[odd]).argmax(axis=1)
    near[odd, worst] += np.where(off[odd, worst] >= 0, 1.0, -1.0)
    return near


def nearest_e8(x: np.ndarray) -> np.ndarray:
    """Nearest points of E8: even integer sums, or the same shifted by one half."""
    whole, half = _d8(x), _d8(x - 0.5) + 0.5
    far = ((x - whole) ** 2).sum(axis=1) > ((x - half) ** 2).sum(axis=1)
    whole[far] = half[far]
    return whole


class Lattice:
    """Cells of unit vectors of one dimension.  Sums run in a fixed order, so a vector has the same cells anywhere."""

    def __init__(self, dim: int):
        draw = np.random.default_rng([SEED, dim])
        self.projection = draw.normal(size=(dim, TABLES * POINTS * 8)) / WIDTH
        self.shift = draw.random(TABLES * POINTS * 8)
        odd = lambda n: draw.integers(0, 1 << 62, n, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
        self.by_coordinate, self.by_point, self.by_table = odd(8), odd(POINTS), odd(TABLES)

    def cells(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Own cell for each table, and the probed cells for each table: (n, TABLES) and (n, TABLES, POINTS * PROBES)."""
        n = len(unit)
        y = np.tile(self.shift, (n, 1))
        for j, row in enumerate(self.projection):
            y += unit[:, j:j + 1] * row
        y = y.reshape(-1, 8)
        point = nearest_e8(y)
        code = self._code(2 * point).reshape(n, TABLES, POINTS)
        moved = self._steps(y - point).reshape(n, TABLES, POINTS, PROBES)
        whole = (code * self.by_point).sum(axis=2, dtype=np.uint64) + self.by_table
        changed = whole[:, :, None, None] + moved * self.by_point[:, None]
        return _mixed(whole), _mixed(changed.reshape(n, TABLES, POINTS * PROBES))

    def _code(self, doubled: np.ndarray) -> np.ndarray:
        return (doubled.astype(np.int64).astype(np.uint64) * self.by_coordinate).sum(axis=1, dtype=np.uint64)

    def _steps(self, off: np.ndarray) -> np.ndarray:
        """Codes of the steps to the two nearest neighbours among three: two of the form (+-1, +-1, 0, ...), one of +-1/2."""
        size, sign = np.abs(off), np.where(off >= 0, 1, -1)
        rank = np.argsort(size, axis=1, kind="stable")
        rows = np.arange(len(off))
        first, second, third, least = rank[:, 7], rank[:, 6], rank[:, 5], rank[:, 0]
        steps = np.zeros((3, *off.shape), np.int64)
        steps[0, rows, first] = steps[1, rows, first] = 2 * sign[rows, first]
        steps[0, rows, second] = 2 * sign[rows, second]
        steps[1, rows, third] = 2 * sign[rows, third]
        halves = sign.copy()
        odd = np.flatnonzero((sign < 0).sum(axis=1) & 1)
        halves[odd, least[odd]] *= -1
        steps[2] = halves
        total = size[:, 0].copy()
        for i in range(1, 8):
            total += size[:, i]
        total /= 2
        total[odd] -= size[odd, least[odd]]
        gain = np.stack([size[rows, first] + size[rows, second], size[rows, first] + size[rows, third], total])
        codes = np.stack([self._code(s) for s in steps])
        best = np.argsort(-gain, axis=0, kind="stable")[:PROBES]
        return np.take_along_axis(codes, best, axis=0).T


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ h >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ h >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return (h ^ h >> np.uint64(31)).view(np.int64)


def _units(vectors: pd.Series) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(positions, unit vectors in double precision) of chunks of one dimension each."""
    sizes = np.array([len(v) for v in vectors])
    for dim in np.unique(sizes):
        where = np.flatnonzero(sizes == dim)
        for at in range(0, len(where), _CHUNK):
            part = where[at:at + _CHUNK]
            x = np.stack([np.asarray(vectors.iloc[i], np.float64) for i in part])
            x /= np.abs(x).max(axis=1, keepdims=True)
            yield part, x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _keyed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    known: dict[int, Lattice] = {}
    for batch in batches:
        for part, unit in _units(batch["embedding"]):
            lattice = known.setdefault(unit.shape[1], Lattice(unit.shape[1]))
            own, probed = lattice.cells(unit)
            ids = batch["rid"].to_numpy()[part]
            per = TABLES * POINTS * PROBES
            yield pd.DataFrame({
                "key": np.concatenate([own.ravel(), probed.ravel()]),
                "rid": np.concatenate([np.repeat(ids, TABLES), np.repeat(ids, per)]),
                "home": np.repeat([True, False], [own.size, probed.size])}).drop_duplicates(["key", "rid"])


def _links(group: pd.DataFrame, unit: np.ndarray, own: np.ndarray, probed: np.ndarray, key: int, cosine: float):
    """Positions of linked pairs of one cell, or of two of its blocks, each only in the smallest cell that it shares."""
    home, block = group["home"].to_numpy(), group["block"].to_numpy()
    i, j = np.nonzero(unit @ unit.T >= cosine - 1e-9)
    ok = (i < j) & (home[i] | home[j])
    if group["first"].iat[0] != group["second"].iat[0]:
        ok &= block[i] != block[j]
    i, j = i[ok], j[ok]
    # in a fixed order of sums, so that a pair at the threshold is judged alike wherever it is met
    exact = np.zeros(len(i))
    for c in range(unit.shape[1]):
        exact += unit[i, c] * unit[j, c]
    i, j = i[exact >= cosine], j[exact >= cosine]
    largest = np.iinfo(np.int64).max
    least = np.full(len(i), largest)
    for t in range(TABLES):
        a, b = own[i, t], own[j, t]
        meets = (a == b) | (probed[j, t] == a[:, None]).any(axis=1)
        least = np.minimum(least, np.where(meets, a, largest))
        least = np.minimum(least, np.where((probed[i, t] == b[:, None]).any(axis=1), b, largest))
    return i[least == key], j[least == key]


def _verifier(cosine: float):
    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[int, Lattice] = {}

        def judge(rows: pd.DataFrame) -> pd.DataFrame:
            once = rows.drop_duplicates("rid").reset_index(drop=True)
            place = dict(zip(once["rid"], range(len(once))))
            units: list = [None] * len(once)
            for part, unit in _units(once["embedding"]):
                lattice = known.setdefault(unit.shape[1], Lattice(unit.shape[1]))
                for at, u, own, probed in zip(part, unit, *lattice.cells(unit)):
                    units[at] = (u, own, probed)
            out = []
            for (key, _, _), group in rows.groupby(["key", "first", "second"], sort=False):
                found = [units[place[r]] for r in group["rid"]]
                if len(found) < 2 or len({len(f[0]) for f in found}) > 1:
                    continue
                unit, own, probed = (np.stack([f[n] for f in found]) for n in range(3))
                i, j = _links(group, unit, own, probed, key, cosine)
                if len(i):
                    ids, copies = group["rid"].to_numpy(), group["copies"].to_numpy()
                    n = np.zeros(len(ids), np.int64)
                    np.add.at(n, i, copies[j])
                    np.add.at(n, j, copies[i])
                    label = ids.copy()
                    while True:
                        before = label.copy()
                        least = np.minimum(label[i], label[j])
                        np.minimum.at(label, i, least)
                        np.minimum.at(label, j, least)
                        if (before == label).all():
                            break
                    out.append(pd.DataFrame({"rid": ids, "label": label, "n": n})[n > 0])
            return pd.concat(out) if out else pd.DataFrame({"rid": [], "label": [], "n": []}, dtype="int64")

        kept = None
        for batch in batches:
            rows = batch if kept is None else pd.concat([kept, batch], ignore_index=True)
            last = rows[["key", "first", "second"]].iloc[-1]
            ends = (rows[["key", "first", "second"]] == last).all(axis=1).to_numpy()
            kept = rows[ends]
            if not ends.all():
                yield judge(rows[~ends])
        if kept is not None:
            yield judge(kept)

    return verify


def near_duplicates(embeddings: DataFrame, cosine: float = COSINE) -> DataFrame:
    """vec_id, n_links, component_id and kept for each row (vec_id, embedding).

    Links join rows whose cosine in double precision reaches the threshold and that share a cell: the own cell of
    one is the own or a probed cell of the other in some table.  Rows with the same components are compared once.
    Vectors that are null, empty or zero, or hold null or non-finite components, link with nothing, nor do
    vectors of different lengths.  The component is the smallest id reachable, itself included.
    """
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    usable = F.col("embedding").isNotNull() & ~F.coalesce(bad, F.lit(True)) & F.exists("embedding", lambda x: x != 0)
    rows = embeddings.select("vec_id", F.when(usable, F.col("embedding")).alias("embedding"))
    reps = written(
        rows.where("embedding IS NOT NULL").groupBy("embedding")
        .agg(F.min("vec_id").alias("first_id"), F.count(F.lit(1)).alias("copies"))
        .withColumn("rid", F.monotonically_increasing_id()), "lattice-vectors")
    keyed = written(reps.select("rid", "embedding").mapInPandas(_keyed, "key long, rid long, home boolean"), "lattice-cells")
    met = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.max("home").alias("any")).where("n > 1 AND any")
    blocks = F.ceil(F.col("n") / _BLOCK).cast("int")
    shared = keyed.join(met, "key").withColumn("blocks", blocks).withColumn(
        "block", F.pmod(F.xxhash64("rid"), F.col("blocks")).cast("int"))
    dealt = shared.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "key", "rid", "home", "block", F.least("block", "other").alias("first"), F.greatest("block", "other").alias("second"))
    placed = (
        dealt.join(reps.select("rid", "embedding", "copies"), "rid")
        .repartition("key", "first", "second").sortWithinPartitions("key", "first", "second", "rid")
    )
    found = written(placed.mapInPandas(_verifier(cosine), "rid long, label long, n long"), "lattice-links")
    roots = components(found.select(F.col("rid").alias("a"), F.col("label").alias("b")), "lattice-components")
    counts = found.groupBy("rid").agg(F.sum("n").alias("n"))
    known = (
        reps.join(counts, "rid", "left").join(roots.withColumnRenamed("node", "rid"), "rid", "left")
        .select("embedding", "first_id", "copies", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("root", "rid").alias("root"))
    )
    names = known.groupBy("root").agg(F.min("first_id").alias("component"))
    classed = known.join(names, "root").select(
        "embedding", (F.col("n") + F.col("copies") - 1).alias("links"), "component")
    linked = rows.join(classed, "embedding", "left")
    component = F.coalesce("component", "vec_id")
    return linked.select(
        "vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
        F.col("vec_id").eqNullSafe(component).alias("kept"))
