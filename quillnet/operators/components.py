"""Connected components and cycle peeling as loops over an edge table."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillnet.functions.lineage import cut


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component) for every node of ``edges`` (u, v); the component is its smallest node.

    Large-star and small-star steps by turns until the edge table is a set of stars. Minima are combined before the
    shuffle; each round is cut to the shared folder.
    """
    now = cut(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    mark = None
    for _ in range(rounds):
        seen = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if not seen["n"] or (seen["n"], seen["h"]) == mark:
            roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
            return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
        mark = (seen["n"], seen["h"])
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = cut(both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = cut(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct())
    raise RuntimeError(f"components did not settle in {rounds} rounds")


#: Edges that one task peels; the bound of a view. More are peeled by joins, with the same result.
ONE_TASK = 500_000


def peeled(batches):
    """The edges left of all that come, by counts of edges in and out: each edge is looked at a bounded number of times."""
    told = [b.to_pydict() for b in batches]
    src, dst = ([x for t in told for x in t[c]] for c in ("src", "dst"))
    number = {x: k for k, x in enumerate(dict.fromkeys([*src, *dst]))}
    ends = [(number[a], number[b]) for a, b in zip(src, dst, strict=True)]
    alive = [True] * len(ends)
    for near, far in ((1, 0), (0, 1)):  # first nodes without an edge in, then without an edge out
        count, at = [0] * len(number), [[] for _ in number]
        for k, e in enumerate(ends):
            if alive[k]:
                count[e[near]] += 1
                at[e[far]].append(k)
        todo = [x for x, c in enumerate(count) if not c]
        while todo:
            for k in at[todo.pop()]:
                alive[k] = False
                count[ends[k][near]] -= 1
                if not count[ends[k][near]]:
                    todo.append(ends[k][near])
    left = [k for k, yes in enumerate(alive) if yes]
    yield pa.RecordBatch.from_arrays([pa.array([src[k] for k in left], pa.string()), pa.array([dst[k] for k in left], pa.string())], names=["src", "dst"])


def cycle_remainder(edges: DataFrame, one_task: int = ONE_TASK) -> DataFrame:
    """The edges (src, dst) left after peeling sources and sinks until none is: empty if and only if there is no cycle.

    Up to ``one_task`` edges are peeled in one task, in time linear in them; beyond, by joins, a layer from each end a
    round. Every round takes edges away or is the last."""
    left = cut(edges.select(F.col("src").cast("string").alias("src"), F.col("dst").cast("string").alias("dst")).distinct())
    count = left.count()
    while count > one_task:
        kept = left.join(left.select(F.col("dst").alias("src")).distinct(), "src", "left_semi").join(left.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi").select("src", "dst")
        kept = cut(kept)
        now = kept.count()
        if now == count:
            return kept
        left, count = kept, now
    return left.coalesce(1).mapInArrow(peeled, "src string, dst string")
