"""Mixing sources to target weights by systematic sampling.

Within a source every document has the same expected number of copies, target / size of the source. Their running
sum, with one random offset for the source, passes an integer once for each copy the mix takes. Documents are
ordered by size, so the copies of every size come close to their share and the words taken come close to the
target; with at most 2 expected copies no document is taken more than twice.

Defined results: null text has size 0; a null source is a source of its own, last in order; sources of size 0 have
target 0 and take nothing; repeated rows are documents of their own; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillnet.llm.common import cut, numbered, ranked

#: Weights by the place of a source in code-point order, repeating.
WEIGHTS = (5.0, 2.0, 1.0)
#: Words that the mix takes for each word there is, and the most for each word of a source.
BUDGET, MOST = 1.5, 2.0
SEED = "quillnet-mix"
WORD = r"[^\x20\x09-\x0D]+"


def targets(sizes: DataFrame, weights=WEIGHTS, budget=BUDGET, most=MOST) -> DataFrame:
    """``sizes`` (source_key, source_size) with target, for any number of sources.

    Sharing by weight with a ceiling, and sharing the excess again until none is above, fills all open sources to one
    level: target = min(most * size, level * weight). The level rises while it closes sources, so the loop ends.
    """
    place = ranked(sizes, [], ["source_key"], "place").withColumn("place", F.col("place") - 1)
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.col("place"), F.lit(len(weights))) + 1).cast("int"))
    rows = cut(place.select("source_key", "source_size", weight.alias("weight"), (F.col("source_size") * F.lit(most)).alias("ceiling")))
    total = (rows.agg(F.sum("source_size")).first()[0] or 0) * budget
    level, closed = None, -1
    while True:
        full = F.lit(False) if level is None else F.lit(level) * F.col("weight") > F.col("ceiling")
        now = rows.agg(F.sum(F.when(full, F.col("ceiling"))).alias("filled"), F.sum(F.when(~full, F.col("weight"))).alias("rest"), F.count(F.when(full, 1)).alias("closed")).first()
        if now["closed"] == closed or not now["rest"]:
            break
        level, closed = (total - (now["filled"] or 0.0)) / now["rest"], now["closed"]
    if level is None or not now["rest"]:
        return rows.select("source_key", "source_size", F.col("ceiling").alias("target"))
    return rows.select("source_key", "source_size", F.least("ceiling", F.lit(level) * F.col("weight")).alias("target"))


def offset(source_key, seed: str = SEED):
    """A number in [0, 1) from the seed and the source: 32 bits of their MD5."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(seed + "/"), source_key).cast("binary")), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def mixed(docs: DataFrame, weights=WEIGHTS, budget=BUDGET, most=MOST, seed: str = SEED) -> DataFrame:
    """doc_id, size, source_size, target, copies, taken; a row for each row of ``docs``."""
    key = F.when(F.col("source").isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), F.col("source").cast("string")))
    size = F.when(F.col("text").isNull(), F.lit(0)).otherwise(F.regexp_count(F.col("text").cast("string"), F.lit(WORD))).cast("long")
    rows = cut(docs.select(F.col("doc_id").alias("doc_id"), key.alias("source_key"), size.alias("size")))
    sums = rows.groupBy("source_key").agg(F.sum("size").alias("source_size"))
    goals = targets(sums, weights, budget, most).withColumn("share", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)).withColumn("start", offset(F.col("source_key"), seed))
    placed = ranked(rows, ["source_key"], ["size", "doc_id"], "place")
    upto = lambda n: F.floor(F.col("start") + n * F.col("share"))
    return placed.join(goals, "source_key").select("doc_id", "size", "source_size", "target", (upto(F.col("place")) - upto(F.col("place") - 1)).alias("copies")).withColumn("taken", F.col("copies") * F.col("size"))


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that the mix takes, each as often as it takes them; rows that share a doc_id or have none are documents of their own."""
    rows = numbered(docs)
    copies = mixed(rows.select(F.col("__row").alias("doc_id"), "text", "source"), **options).where("copies > 0").select(F.col("doc_id").alias("__doc"), "copies")
    return rows.join(copies.withColumnRenamed("copies", "__copies"), F.col("__row") == F.col("__doc")).withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__copies").cast("int")))).select(*[rows[c] for c in docs.columns])
