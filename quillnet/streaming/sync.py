"""Continuous synchronisation of files that arrive: an extension; batches run the same operators as a full scan."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quillnet.functions.text import text_digest
from quillnet.operators.scan import definitions, identities, references, scan
from quillnet.sources import store


def arrivals(spark: SparkSession, folder: str, schema: str = "path string, content string, ts timestamp") -> DataFrame:
    """Versions of files, as JSON lines that land in ``folder``; a version delivered twice within a day counts once."""
    rows = spark.readStream.schema(schema).json(folder).withColumn("digest", text_digest(F.col("content")))
    return rows.withWatermark("ts", "1 day").dropDuplicatesWithinWatermark(["path", "digest"])


def sync_batch(root: str) -> Callable[[DataFrame, int], None]:
    """Replaces what earlier versions of the batch's files said, and commits one generation for each batch."""

    def run(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        latest = batch.groupBy("path").agg(F.max_by("content", "ts").alias("content"))
        if latest.isEmpty():
            return
        found = scan(latest)
        old = store.load(spark, root) if store.current(spark, root) else None
        registry = old["definitions"].select("id", F.col("label").alias("name")) if old else None
        names = identities(found, registry)
        new = {"definitions": definitions(found, names), "references": references(found, names)}
        if old:
            new = {k: old[k].join(latest.select("path"), "path", "left_anti").unionByName(df) for k, df in new.items()}
        store.commit(spark, root, new)

    return run


def start(spark: SparkSession, folder: str, root: str, checkpoint: str, **trigger) -> StreamingQuery:
    return arrivals(spark, folder).writeStream.foreachBatch(sync_batch(root)).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def sessions(events: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """(user_id, start, n, total) of each user's sessions; works on streams with a watermark and on tables."""
    rows = events.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return rows.select("user_id", F.col("w.start").alias("start"), "n", "total")
