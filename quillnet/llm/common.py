"""What several training-data operators share: shared-folder lineage cuts, distributed ranks, components."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillnet.functions.lineage import cut, shared_folder, shared_path
from quillnet.operators.components import components as connected_components

__all__ = ["WHITE", "by_class", "few_rows", "connected_components", "cut", "numbered", "ranked", "shared_folder", "shared_path", "shuffle_parts"]

#: Characters counted as white space by the contracts: \x20 and \x09-\x0D.
WHITE = " \t\n\x0b\x0c\r"


def few_rows(batches, rows: int = 512):
    """Record batches in slices, so that few texts at once become Python strings."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def ranked(df: DataFrame, groups: list[str], orders: list[str], rank: str) -> DataFrame:
    """Adds ``rank``: 1, 2, ... by ``orders`` within ``groups`` (columns without nulls).

    A window would gather a whole group in one task. Here the rows are sorted over range partitions, written
    once, numbered inside each partition, and moved by the counts of the partitions before; those counts are
    one row for each partition and group that meet. Rows alike in all keys get neighbouring ranks.
    """
    spark = df.sparkSession
    keys = [*groups, *orders]
    rows = cut(
        cut(df)
        .repartitionByRange(shuffle_parts(spark), *keys)
        .sortWithinPartitions(*keys)
        .withColumn("__part", F.spark_partition_id())
        .withColumn("__row", F.monotonically_increasing_id())
    )
    starts = rows.groupBy("__part", *groups).agg(F.count("*").alias("__n"), F.min("__row").alias("__first"))
    before = Window.partitionBy(*groups).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = starts.select("__part", *groups, "__first", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    return (
        rows.join(starts, ["__part", *groups])
        .withColumn(rank, F.col("__row") - F.col("__first") + F.col("__before") + 1)
        .drop("__part", "__row", "__first", "__before")
    )


#: A class is hot when it has more than one row in so many; there are fewer such classes than that.
MOST_HOT = 1000


def by_class(rows: DataFrame, classes: DataFrame, key: str, many: str) -> DataFrame:
    """``rows`` with the other columns of ``classes`` (a row for each ``key``, ``many`` its number of rows), as a left join.

    Hot classes are broadcast: by their size there are fewer than MOST_HOT. The rows that meet one need no other, and
    are spread in the join that follows, so a key of a third of all rows is in no one task.
    """
    total = classes.agg(F.sum(many)).first()[0] or 0
    large = F.col(many) * MOST_HOT > total
    held = F.struct(*[c for c in classes.columns if c != key])
    hot = classes.where(large).select(F.col(key).alias("__hot"), held.alias("__hot_class"))
    # Always 0, but no literal: that would be folded out of the join's keys, and with it the spreading.
    zero = F.pmod(F.col(many).cast("long"), F.lit(1))
    cold = classes.where(~large).select(F.col(key).alias("__key"), zero.alias("__zero"), held.alias("__cold_class"))
    met = rows.join(F.broadcast(hot), F.col(key) == F.col("__hot"), "left")
    met = met.withColumn("__salt", F.when(F.col("__hot").isNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64(*rows.columns), F.lit(1 << 20)) + 1).cast("long"))
    met = met.join(cold, (F.col(key) == F.col("__key")) & (F.col("__salt") == F.col("__zero")), "left").withColumn("__class", F.coalesce("__hot_class", "__cold_class"))
    return met.select(*rows.columns, *[F.col("__class")[c].alias(c) for c in classes.columns if c != key])


def numbered(docs: DataFrame) -> DataFrame:
    """``docs`` with __row, a number of its own for each row: the doc_id where no other row has it, else one from 2 ** 62 on.

    Only if some doc_ids are null or repeated are the rows written once, so that the new numbers stay what they are.
    """
    doc_id = F.col("doc_id").cast("long")
    odd = cut(docs.groupBy(doc_id.alias("__odd")).agg(F.count("*").alias("__n")).where("__odd is null or __n > 1").select("__odd"))
    if odd.isEmpty():
        return docs.withColumn("__row", doc_id)
    same = doc_id.eqNullSafe(F.col("__odd"))
    plain = docs.join(odd, same, "left_anti").withColumn("__row", doc_id)
    return cut(plain.unionByName(docs.join(odd, same, "left_semi").withColumn("__row", F.lit(1 << 62) + F.monotonically_increasing_id())))
