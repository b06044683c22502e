"""Near-duplicate vectors by epsilon grid order join.

Vectors of unit length whose cosine is at least c lie within epsilon = sqrt(2 - 2c) of each other. They are sorted by
the cells, of width epsilon, of a grid on their leading principal dimensions (epsilon grid order) and cut into
sequence intervals. Two intervals are joined recursively, cut between cells: parts whose boxes on the leading
dimensions, or whose balls around their means, lie further apart than epsilon are skipped; parts whose balls lie within
epsilon link as a whole, so a dense group costs no comparison of all its pairs; small ones are compared by matrix
product, and what comes within rounding of the threshold is decided in double precision.

An interval travels to each that it may meet, so intervals are as large as a task may hold; where vectors spread evenly
over many dimensions, no grid on a few of them keeps intervals apart, and work grows with the square of the vectors.

Equal vectors are one class with a count from the start, so a vector that a third of all rows repeat is one row. A
join of two intervals gives, for each vector, how many it linked to and a forest that connects what it linked: its
output grows with the vectors and not with the pairs.

Defined results: vectors that are null, zero, empty or hold null or non-finite components link with nothing and stand
alone; vectors of different length never link; copies link with each other; equal vec_ids are one vector for
components; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillnet.llm.common import connected_components, cut, ranked, shuffle_parts

#: Vectors of a leaf; bytes of an interval's vectors at most; leading dimensions at least, at most, and the share of the variance they are to explain.
LEAF, INTERVAL_BYTES = 256, 16 << 20
LEADING, EXPLAINED = (4, 24), 0.5
#: Pairs of intervals for each shuffle partition, if there are vectors enough for so many intervals.
PAIRS_EACH = 3
#: Single precision is trusted this far from the threshold.
MARGIN = 1e-4
#: Bytes of the partial covariances that meet on the driver, and their number for each length of vector at most.
FOLD_BYTES, FOLDS = 64 << 20, 32
CLASSES = "rep long, mult long, dim int, cells array<int>, lead array<double>, vector binary"
FOUND = pa.schema([("u", pa.int64()), ("v", pa.int64()), ("links", pa.int64())])


def unit(rows: list[list[float]]) -> np.ndarray:
    x = np.array(rows, np.float64)
    # Scaled first, so that squares neither overflow nor vanish.
    x /= np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def grouped(batch, columns):
    """The rows of a batch by the length of their vector."""
    rows = [batch.column(batch.schema.get_field_index(c)).to_pylist() for c in columns]
    by: dict[int, list[int]] = {}
    for k, v in enumerate(rows[0]):
        by.setdefault(len(v), []).append(k)
    return {n: [[col[k] for k in at] for col in rows] for n, at in by.items()}


def covariances(batches):
    """For each length of vector the sum of outer products, the sum and the count of a task."""
    total: dict[int, list] = {}
    for batch in batches:
        for n, (vectors,) in grouped(batch, ["vector"]).items():
            x = unit(vectors)
            now = total.setdefault(n, [np.zeros((n, n)), np.zeros(n), 0])
            now[0] += x.T @ x
            now[1] += x.sum(0)
            now[2] += len(x)
    for n, (outer, one, count) in total.items():
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int32()), pa.array([outer.tobytes()], pa.binary()), pa.array([one.tobytes()], pa.binary()), pa.array([count], pa.int64())], names=["dim", "outer", "one", "n"])


def added(batches):
    total: dict[int, list] = {}
    for batch in batches:
        for n, outer, one, count in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
            now = total.setdefault(n, [np.zeros((n, n)), np.zeros(n), 0])
            now[0] += np.frombuffer(outer).reshape(n, n)
            now[1] += np.frombuffer(one)
            now[2] += count
    for n, (outer, one, count) in total.items():
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int32()), pa.array([outer.tobytes()], pa.binary()), pa.array([one.tobytes()], pa.binary()), pa.array([count], pa.int64())], names=["dim", "outer", "one", "n"])


def principal(classes: DataFrame) -> dict[int, np.ndarray]:
    """For each length of vector the principal directions, from the first, that explain EXPLAINED of the variance.

    Partial sums are merged by tasks until those of one length take at most FOLD_BYTES; these come to the driver."""
    schema = "dim int, outer binary, one binary, n long"
    longest = classes.agg(F.max(F.size("vector"))).first()[0] or 1
    folds = max(1, min(FOLDS, FOLD_BYTES // (8 * longest * longest)))
    parts = classes.select("vector").mapInArrow(covariances, schema).withColumn("fold", F.spark_partition_id() % folds)
    rows = parts.repartition(folds, "fold").select("dim", "outer", "one", "n").mapInArrow(added, schema).collect()
    total: dict[int, list] = {}
    for r in rows:
        now = total.setdefault(r["dim"], [0, 0, 0])
        n = r["dim"]
        now[0], now[1], now[2] = now[0] + np.frombuffer(r["outer"]).reshape(n, n), now[1] + np.frombuffer(r["one"]), now[2] + r["n"]
    out = {}
    for n, (outer, one, count) in total.items():
        mean = one / count
        values, vectors = np.linalg.eigh(outer / count - np.outer(mean, mean))
        told = np.cumsum(np.maximum(values[::-1], 0))
        leading = max(LEADING[0], min(LEADING[1], int(np.searchsorted(told, EXPLAINED * told[-1])) + 1))
        out[n] = np.ascontiguousarray(vectors[:, ::-1][:, :leading])
    return out


def gridded(shared, epsilon: float):
    def run(batches):
        for batch in batches:
            for n, (vectors, reps, mults) in grouped(batch, ["vector", "rep", "mult"]).items():
                x = unit(vectors)
                lead = x @ shared.value[n]
                cells = np.floor(lead / epsilon).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(reps, pa.int64()), pa.array(mults, pa.int64()), pa.array([n] * len(x), pa.int32()), pa.array(cells.tolist(), pa.list_(pa.int32())), pa.array(lead.tolist(), pa.list_(pa.float64())), pa.array([r.tobytes() for r in x], pa.binary())],
                    names=["rep", "mult", "dim", "cells", "lead", "vector"],
                )

    return run


class Interval:
    """Vectors in epsilon grid order."""

    def __init__(self, rows):
        rows = sorted(rows, key=lambda r: (r[2], r[0]))
        self.reps, self.mult = np.array([r[0] for r in rows]), np.array([r[1] for r in rows])
        self.lead = np.array([r[3] for r in rows])
        self.x = np.stack([np.frombuffer(r[4]) for r in rows])
        self.single = self.x.astype(np.float32)
        self.links = np.zeros(len(rows), np.int64)
        self.bounds: dict[tuple[int, int], tuple] = {}
        # Cuts stand where the first leading dimensions step into another cell, near the middle.
        cells = np.array([r[2] for r in rows])
        step = (cells[1:] != cells[:-1]).argmax(1)
        self.step = np.r_[0, np.where((cells[1:] != cells[:-1]).any(1), step, cells.shape[1])]

    def bound(self, a: int, b: int):
        """The box of the leading dimensions, and the mean vector and the distance of the farthest from it."""
        if (a, b) not in self.bounds:
            mean = self.x[a:b].mean(0)
            far = np.sqrt(((self.x[a:b] - mean) ** 2).sum(1).max())
            self.bounds[a, b] = self.lead[a:b].min(0), self.lead[a:b].max(0), mean, far
        return self.bounds[a, b]

    def halves(self, a: int, b: int) -> list[tuple[int, int]]:
        """Two parts of a stretch, cut between cells: in its middle half, where the earliest dimension steps."""
        if b - a <= LEAF:
            return [(a, b)]
        low, high = a + (b - a) // 4, b - (b - a) // 4
        steps = self.step[low:high]
        best = np.flatnonzero(steps == steps.min())
        cut = low + int(best[np.abs(best - (b - a) // 4).argmin()])
        return [(a, cut), (cut, b)]


class Joined:
    """The recursive join of two intervals, or of one with itself."""

    def __init__(self, left: Interval, right: Interval, least: float, epsilon: float):
        self.l, self.r, self.same, self.least, self.reach = left, right, left is right, least, epsilon + 1e-6
        # Nearer than this every pair links, whatever rounding does.
        self.within = epsilon - 1e-6
        self.label = np.arange(len(left.reps) + (0 if self.same else len(right.reps)))
        self.shift = 0 if self.same else len(left.reps)
        self.join(0, len(left.reps), 0, len(right.reps))

    def join(self, a: int, b: int, c: int, d: int) -> None:
        if self.same and c < a:
            return
        (low, high, mean, far), (low2, high2, mean2, far2) = self.l.bound(a, b), self.r.bound(c, d)
        gap = np.maximum(0, np.maximum(low2 - high, low - high2))
        apart = np.sqrt(((mean - mean2) ** 2).sum())
        if (gap * gap).sum() > self.reach**2 or apart - far - far2 > self.reach:
            return
        if apart + far + far2 < self.within:
            return self.all(a, b, c, d)
        if b - a <= LEAF and d - c <= LEAF:
            return self.leaf(a, b, c, d)
        for p, q in self.l.halves(a, b):
            for s, t in self.r.halves(c, d):
                self.join(p, q, s, t)

    def all(self, a: int, b: int, c: int, d: int) -> None:
        """All pairs are provably close: they link without being compared."""
        same = self.same and a == c
        if same and b - a < 2:
            return
        left, right = self.l.mult[a:b], self.r.mult[c:d]
        self.l.links[a:b] += right.sum() - (left if same else 0)
        if not same:
            self.r.links[c:d] += left.sum()
        ends = np.unique(np.r_[self.label[a:b], self.label[self.shift + c : self.shift + d]])
        self.label[np.isin(self.label, ends)] = ends[0]

    def leaf(self, a: int, b: int, c: int, d: int) -> None:
        cosine = self.l.single[a:b] @ self.r.single[c:d].T
        link = cosine >= self.least
        near = np.argwhere(np.abs(cosine - np.float32(self.least)) < MARGIN)
        if len(near):
            exact = np.einsum("ij,ij->i", self.l.x[a + near[:, 0]], self.r.x[c + near[:, 1]])
            link[near[:, 0], near[:, 1]] = exact >= self.least
        if self.same and a == c:
            np.fill_diagonal(link, False)
        if not link.any():
            return
        self.l.links[a:b] += link @ self.r.mult[c:d]
        if not (self.same and a == c):
            self.r.links[c:d] += self.l.mult[a:b] @ link
        left, right = self.label[a:b], self.label[self.shift + c : self.shift + d]
        if (left[:, None] == right[None, :])[link].all():
            return
        # One edge for each row and column that links, until all that link have one label.
        while True:
            rows, cols = np.nonzero(link & (self.label[a:b][:, None] != self.label[self.shift + c : self.shift + d][None, :]))
            if not len(rows):
                return
            for r, k in {(int(r), int(k)) for r, k in zip(rows[np.unique(rows, return_index=True)[1]], cols[np.unique(rows, return_index=True)[1]], strict=True)}:
                x, y = self.label[a + r], self.label[self.shift + c + k]
                if x != y:
                    self.label[self.label == max(x, y)] = min(x, y)

    def forest(self):
        reps = self.l.reps if self.same else np.r_[self.l.reps, self.r.reps]
        for k in np.flatnonzero(self.label != np.arange(len(self.label))):
            yield int(reps[k]), int(reps[self.label[k]]), 0
        for side in (self.l,) if self.same else (self.l, self.r):
            for rep, n in zip(side.reps.tolist(), side.links.tolist(), strict=True):
                if n:
                    yield rep, rep, n


def pairs_joined(least: float, epsilon: float):
    """Joins the two intervals of each pair; their rows come together, sorted by pair."""

    def done(sides):
        left = Interval(sides[0])
        right = Interval(sides[1]) if sides[1] else left
        return list(Joined(left, right, least, epsilon).forest())

    def run(batches):
        now, sides, out = None, ([], []), []
        for batch in batches:
            for one, two, side, *row in zip(*(batch.column(k).to_pylist() for k in range(8)), strict=True):
                if (one, two) != now:
                    if now:
                        out += done(sides)
                    now, sides = (one, two), ([], [])
                    if len(out) > 8192:
                        yield batch_of(out)
                        out = []
                sides[side].append(row)
        if now:
            out += done(sides)
        yield batch_of(out)

    return run


def batch_of(rows):
    cols = list(zip(*rows, strict=True)) or [[], [], []]
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], schema=FOUND)


def vector_links(rows: DataFrame, least: float = 0.95) -> DataFrame:
    """vec_id, n_links, component_id and kept for each row of ``rows`` (vec_id, embedding)."""
    spark = rows.sparkSession
    epsilon = float(np.sqrt(max(0.0, 2 - 2 * least)))
    # The field must not be taken from the input's name: other columns may clash.
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("vector"))
    sound = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    valid = F.coalesce((F.size("vector") > 0) & F.forall("vector", sound) & F.exists("vector", lambda x: x != 0), F.lit(False))
    named = rows.withColumn("vector", F.when(valid, F.col("vector")))
    classes = cut(named.where("vector is not null").groupBy("vector").agg(F.min("vec_id").alias("rep"), F.count("*").alias("mult")))
    shared = spark.sparkContext.broadcast(principal(classes))  # at most LEADING[1] directions for each length of vector
    keyed = classes.withColumn("rep", F.coalesce("rep", F.lit(-(2**63)).cast("long")))
    grid = keyed.mapInArrow(gridded(shared, epsilon), CLASSES)
    # As few intervals as keep all tasks busy, as every interval travels to those it meets; more where their bytes ask for it.
    many = max(2, math.isqrt(2 * PAIRS_EACH * shuffle_parts(spark)))
    sizes = keyed.groupBy(F.size("vector").alias("dim")).agg(F.count("*").alias("n"))
    sizes = sizes.select("dim", F.greatest(F.lit(LEAF), F.least(F.ceil(F.col("n") / many), F.floor(F.lit(INTERVAL_BYTES) / (8 * F.col("dim"))))).cast("long").alias("interval"))
    placed = ranked(grid, ["dim"], ["cells", "rep"], "place").join(sizes, "dim").withColumn("block", F.floor((F.col("place") - 1) / F.col("interval")))
    placed = cut(placed.select("dim", "block", "rep", "mult", "cells", "lead", "vector"))
    # A row for each interval, with its box; only intervals whose first cells are neighbours meet.
    low = lambda k: F.min(F.coalesce(F.get("lead", F.lit(k)), F.lit(0.0)))
    high = lambda k: F.max(F.coalesce(F.get("lead", F.lit(k)), F.lit(0.0)))
    blocks = cut(placed.groupBy("dim", "block").agg(F.min(F.get("cells", F.lit(0))).alias("from"), F.max(F.get("cells", F.lit(0))).alias("to"), F.array(*map(low, range(LEADING[1]))).alias("low"), F.array(*map(high, range(LEADING[1]))).alias("high")))
    left = blocks.select("dim", F.col("block").alias("one"), "low", "high", F.explode(F.sequence(F.col("from"), F.col("to") + 1)).alias("cell"))
    right = blocks.select("dim", F.col("block").alias("two"), F.col("low").alias("low2"), F.col("high").alias("high2"), F.explode(F.sequence(F.col("from") - 1, F.col("to"))).alias("cell"))
    gap = F.aggregate(F.arrays_zip("low", "high", "low2", "high2"), F.lit(0.0), lambda s, z: s + F.pow(F.greatest(F.lit(0.0), z["low2"] - z["high"], z["low"] - z["high2"]), F.lit(2.0)))
    pairs = left.join(right, ["dim", "cell"]).where((F.col("one") <= F.col("two")) & (gap <= (epsilon + 1e-6) ** 2)).select("dim", "one", "two").distinct()
    sides = pairs.select("*", F.col("one").alias("block"), F.lit(0).alias("side")).unionByName(pairs.where("one < two").select("*", F.col("two").alias("block"), F.lit(1).alias("side")))
    together = placed.join(cut(sides), ["dim", "block"]).withColumn("pair", F.xxhash64("dim", "one", "two"))
    together = together.repartition("pair").sortWithinPartitions("dim", "one", "two").select(F.concat_ws("/", "dim", "one").alias("one"), "two", "side", "rep", "mult", "cells", "lead", "vector")
    found = cut(together.mapInArrow(pairs_joined(least, epsilon), "u long, v long, links long"))
    links = found.where("u = v").groupBy("u").agg(F.sum("links").alias("links"))
    parts = connected_components(found.where("u <> v").select("u", "v"))
    told = keyed.join(links.withColumnRenamed("u", "rep"), "rep", "left").join(parts.withColumnRenamed("node", "rep"), "rep", "left")
    told = told.select(F.col("vector").alias("__vector"), (F.coalesce("links", F.lit(0)) + F.col("mult") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    out = named.join(told, F.col("vector") == F.col("__vector"), "left").select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
