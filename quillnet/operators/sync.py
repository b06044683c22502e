"""Incremental synchronisation: what changed, upserts, orphans, staleness, deltas."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """(path, status) for ``old`` and ``new`` (path, digest): added, deleted or modified."""
    rows = old.select("path", F.col("digest").alias("was")).join(new.select("path", F.col("digest").alias("now")), "path", "full_outer")
    status = F.when(F.col("was").isNull(), "added").when(F.col("now").isNull(), "deleted").when(F.col("was") != F.col("now"), "modified")
    return rows.select("path", status.alias("status")).where("status is not null")


def renames(old: DataFrame, new: DataFrame) -> DataFrame:
    """(old_path, new_path): a path that is gone and one that is new, alike in a digest that no other gone or new path has."""
    gone, come = old.join(new.select("path"), "path", "left_anti"), new.join(old.select("path"), "path", "left_anti")
    single = lambda df, name: df.groupBy("digest").agg(F.min("path").alias(name), F.count("*").alias("n")).where("n = 1").drop("n")
    return single(gone, "old_path").join(single(come, "new_path"), "digest").select("old_path", "new_path")


def diff(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, status): rows added, removed or updated between two generations of one table; nulls count as values."""
    rest = [F.col(c) for c in new.columns if c not in keys]
    held = lambda df, name: df.select(*keys, F.struct(F.lit(True).alias("__there"), *rest).alias(name))
    rows = held(old, "was").join(held(new, "now"), keys, "full_outer")
    status = F.when(F.col("was").isNull(), "added").when(F.col("now").isNull(), "removed").when(~F.col("was").eqNullSafe(F.col("now")), "updated")
    return rows.select(*keys, status.alias("status")).where("status is not null")


def orphans(nodes: DataFrame, scanned: DataFrame, files: DataFrame) -> DataFrame:
    """``nodes`` with those marked orphaned and inactive whose file is among ``files`` (path) but which ``scanned`` (id) lacks."""
    lost = nodes.join(files.select(F.col("path").alias("authority")).distinct(), "authority", "left_semi").join(scanned.select("id").distinct(), "id", "left_anti").select("id", F.lit(True).alias("lost"))
    rows = nodes.join(lost, "id", "left")
    return rows.withColumns({"source_status": F.when(F.col("lost"), "orphaned").otherwise(F.col("source_status")), "active": F.when(F.col("lost"), F.lit(False)).otherwise(F.col("active"))}).drop("lost")


def upsert(nodes: DataFrame, scanned: DataFrame) -> DataFrame:
    """(id, label, aliases, digest, curation_status) after a scan (id, label, digest) of ``nodes`` of the same form.

    A node keeps its id; a label that changed becomes an alias. A new node is pending; a node whose text changed
    needs review unless it was pending; others keep their state.
    """
    now = scanned.select("id", F.col("label").alias("new_label"), F.col("digest").alias("new_digest"))
    rows = nodes.join(now, "id", "full_outer")
    relabelled = F.col("new_label").isNotNull() & F.col("label").isNotNull() & (F.col("new_label") != F.col("label"))
    had = F.coalesce("aliases", F.array().cast("array<string>"))
    names = F.when(relabelled, F.array_except(F.array_union(had, F.array("label")), F.array("new_label"))).otherwise(had)
    changed = F.col("new_digest").isNotNull() & ~F.col("digest").eqNullSafe(F.col("new_digest"))
    status = F.when(F.col("label").isNull(), "pending").when(changed & (F.col("curation_status") != "pending"), "needs-review").otherwise(F.col("curation_status"))
    return rows.select("id", F.coalesce("new_label", "label").alias("label"), F.array_sort(names).alias("aliases"), F.coalesce("new_digest", "digest").alias("digest"), status.alias("curation_status"))


def edge_curation(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges (src, rel, dst, curation_status, src_print, dst_print) checked against ``nodes`` (id, active, print).

    An end that is not active, or whose recorded print is not the node's now, is stale and the edge needs review; a
    print seen for the first time is recorded.
    """
    side = lambda s: nodes.select(F.col("id").alias(s), F.col("active").alias(f"{s}_active"), F.col("print").alias(f"{s}_now"))
    rows = edges.join(side("src"), "src", "left").join(side("dst"), "dst", "left")
    stale = lambda s: ~F.coalesce(f"{s}_active", F.lit(False)) | (F.col(f"{s}_print").isNotNull() & ~F.col(f"{s}_print").eqNullSafe(F.col(f"{s}_now")))
    ends = F.filter(F.array(F.when(stale("src"), F.col("src")), F.when(stale("dst"), F.col("dst"))), lambda x: x.isNotNull())
    rows = rows.withColumn("stale_endpoints", F.array_sort(F.array_distinct(ends)))
    return rows.select("src", "rel", "dst", F.when(F.size("stale_endpoints") > 0, "needs-review").otherwise(F.col("curation_status")).alias("curation_status"), "stale_endpoints", *[F.coalesce(f"{s}_print", f"{s}_now").alias(f"{s}_print") for s in ("src", "dst")])


def apply_delta(nodes: DataFrame, edges: DataFrame, remove_nodes: DataFrame, put_nodes: DataFrame, remove_edges: DataFrame, put_edges: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes and edges after a delta, and what it refused: (kind, id), nodes by id and edges as src rel dst.

    Only nodes that are not active may go, with their edges; an edge that the delta puts at a node that goes, or at one
    that is not there, is refused. Nodes and edges are put by key; of several rows with one key in the delta the last by
    ``n`` wins; edges are removed before others are put. What refers to nodes that went is for ``remaining_references``.
    """
    kept = nodes.where("coalesce(active, true)").join(remove_nodes.select("id"), "id", "left_semi").select("id")
    gone = remove_nodes.select("id").join(kept, "id", "left_anti")
    last = lambda df, keys: df.withColumn("__k", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("n")))).where("__k = 1").drop("__k", "n")
    new_nodes = last(put_nodes, ["id"])
    out = nodes.join(gone, "id", "left_anti").join(new_nodes.select("id"), "id", "left_anti").unionByName(new_nodes, allowMissingColumns=True)
    keys = ["src", "rel", "dst"]
    asked = last(put_edges, keys)
    there = lambda rows, how: rows.join(out.select(F.col("id").alias("src")), "src", how)
    new_edges = there(asked, "left_semi").join(out.select(F.col("id").alias("dst")), "dst", "left_semi")
    left = edges.join(remove_edges.select(*keys), keys, "left_anti").join(new_edges.select(*keys), keys, "left_anti")
    lost = gone.join(new_nodes.select("id"), "id", "left_anti")
    for side in ("src", "dst"):
        left = left.join(lost.withColumnRenamed("id", side), side, "left_anti")
    left = left.unionByName(new_edges, allowMissingColumns=True)
    bad = asked.select(*keys).join(new_edges.select(*keys), keys, "left_anti").select(F.lit("edge").alias("kind"), F.concat_ws(" ", *keys).alias("id"))
    return out, left.select(*edges.columns), kept.select(F.lit("node").alias("kind"), "id").unionByName(bad)


def remaining_references(refs: DataFrame, nodes: DataFrame, nodes_after: DataFrame) -> DataFrame:
    """``refs`` (target, ...) without those whose target a delta removed; references that named no node before stay as they were."""
    gone = nodes.select("id").join(nodes_after.select("id"), "id", "left_anti")
    return refs.join(gone.withColumnRenamed("id", "target"), "target", "left_anti").select(*refs.columns)


def taxonomy(definitions: DataFrame, topics: DataFrame, fields: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Field and topic nodes, and contains-edges, for ``definitions`` (id, source), ``topics`` (id, label, source, fields)
    and ``fields`` (id, label). Knowledge hangs below its source's topic, topics below their fields."""
    nodes = fields.select("id", F.lit("field").alias("typ"), "label").unionByName(topics.select("id", F.lit("topic").alias("typ"), "label")).dropDuplicates(["id"])
    upper = topics.select(F.explode("fields").alias("src"), F.lit("contains").alias("rel"), F.col("id").alias("dst"))
    lower = definitions.select(F.col("id").alias("dst"), "source").join(topics.select(F.col("id").alias("src"), "source"), "source").select("src", F.lit("contains").alias("rel"), "dst")
    return nodes, upper.unionByName(lower).distinct()
