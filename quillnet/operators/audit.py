"""Counts and reports over a graph."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillnet.operators.checks import memberships
from quillnet.operators.components import components
from quillnet.sources.projection import SEMANTIC


def manifest_counts(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(counter, value, n): node types, source and curation states, relations."""
    parts = [(nodes, "typ", "node_type"), (nodes, "source_status", "source_status"), (nodes, "curation_status", "curation_status"), (edges, "rel", "relation")]
    return reduce(DataFrame.unionByName, [df.where(F.col(c).isNotNull()).groupBy(F.col(c).alias("value")).agg(F.count("*").alias("n")).select(F.lit(name).alias("counter"), "value", "n") for df, c, name in parts])


def degrees(edges: DataFrame) -> DataFrame:
    """(id, degree) over semantic edges."""
    rows = edges.where(F.col("rel").isin(list(SEMANTIC)))
    return rows.select(F.explode(F.array("src", "dst")).alias("id")).groupBy("id").agg(F.count("*").alias("degree"))


def hubs(edges: DataFrame, limit: int = 12) -> DataFrame:
    """The ``limit`` nodes of highest degree, by id where equal."""
    return degrees(edges).orderBy(F.desc("degree"), "id").limit(limit)


def component_sizes(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(size, n): how many components of active knowledge have each size; nodes without edges are components of one."""
    ids = nodes.where("typ = 'knowledge' and coalesce(active, false)").select("id")
    kept = edges.where(F.col("rel").isin(list(SEMANTIC))).join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")
    found = components(kept.select(F.col("src").alias("u"), F.col("dst").alias("v")))
    named = ids.join(found.withColumnRenamed("node", "id"), "id", "left").select(F.coalesce("component", "id").alias("component"))
    return named.groupBy("component").agg(F.count("*").alias("size")).groupBy("size").agg(F.count("*").alias("n"))


def field_histogram(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(fields, n): how many knowledge nodes are in how many fields."""
    per_node = memberships(nodes, edges).groupBy(F.col("node").alias("id")).agg(F.count("*").alias("fields"))
    return nodes.where("typ = 'knowledge'").join(per_node, "id", "left").groupBy(F.coalesce("fields", F.lit(0)).alias("fields")).agg(F.count("*").alias("n"))


def coverage(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: knowledge, active, classified, connected, and their shares of the active to 6 places (1 where none is)."""
    fields = memberships(nodes, edges).select(F.col("node").alias("id")).distinct().withColumn("classified", F.lit(1))
    linked = degrees(edges).select("id", F.lit(1).alias("connected"))
    rows = nodes.where("typ = 'knowledge'").join(fields, "id", "left").join(linked, "id", "left").withColumn("on", F.coalesce("active", F.lit(False)).cast("int"))
    sums = rows.agg(F.count("*").alias("knowledge"), F.sum("on").alias("active"), F.sum(F.col("on") * F.coalesce("classified", F.lit(0))).alias("classified"), F.sum(F.col("on") * F.coalesce("connected", F.lit(0))).alias("connected"))
    share = lambda c: F.when(F.col("active") > 0, F.round(F.col(c) / F.col("active"), 6)).otherwise(1.0)
    return sums.withColumns({"classified_share": share("classified"), "connected_share": share("connected")})


def required_references(edges: DataFrame, refs: DataFrame, authorities: DataFrame) -> DataFrame:
    """(authority, target, relations, consumers, covered): what each document's nodes need, and whether it refers to it.

    ``authorities`` (id, authority) says where nodes are defined; a node needs what its incoming and outgoing semantic
    edges name in other documents.
    """
    rows = edges.where(F.col("rel").isin(list(SEMANTIC))).join(authorities.select(F.col("id").alias("dst"), "authority"), "dst").join(authorities.select(F.col("id").alias("src"), F.col("authority").alias("home")), "src")
    needed = rows.where("authority <> home").groupBy("authority", F.col("src").alias("target")).agg(F.array_sort(F.collect_set("rel")).alias("relations"), F.count("*").alias("consumers"))
    had = refs.select("authority", "target", F.lit(True).alias("has")).distinct()
    return needed.join(had, ["authority", "target"], "left").select("authority", "target", F.array_join("relations", ",").alias("relations"), "consumers", F.coalesce("has", F.lit(False)).alias("covered"))


def inventory(docs: DataFrame) -> DataFrame:
    """(source, documents, characters, bytes, texts): what each source holds."""
    return docs.groupBy("source").agg(F.count("*").alias("documents"), F.sum(F.length("text")).alias("characters"), F.sum(F.octet_length("text")).alias("bytes"), F.countDistinct(F.sha2(F.col("text").cast("binary"), 256)).alias("texts"))


def quality(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(counter, n): knowledge without parent, without field and in several fields."""
    fields = memberships(nodes, edges).groupBy(F.col("node").alias("id")).agg(F.count("*").alias("fields"))
    parents = edges.where("rel = 'contains'").select(F.col("dst").alias("id")).distinct().withColumn("parent", F.lit(1))
    rows = nodes.where("typ = 'knowledge'").join(fields, "id", "left").join(parents, "id", "left")
    one = rows.agg(F.count_if(F.col("parent").isNull()).alias("no-parent"), F.count_if(F.col("fields").isNull()).alias("no-field"), F.count_if(F.col("fields") > 1).alias("many-fields"))
    return one.select(F.explode(F.map_from_arrays(F.array(*map(F.lit, one.columns)), F.array(*[F.col(f"`{c}`") for c in one.columns]))).alias("counter", "n"))


def edge_quality(edges: DataFrame) -> DataFrame:
    """(counter, n): semantic edges whose evidence or confidence is missing: null, blank, or no such column."""
    rows = edges.where(F.col("rel").isin(list(SEMANTIC)))
    counts = []
    for c in ("evidence", "confidence"):
        blank = F.coalesce(F.col(c).cast("string"), F.lit("")).rlike(r"(?U)^\s*$") if c in edges.columns else F.lit(True)
        counts.append(F.struct(F.lit(f"missing-{c}").alias("counter"), F.count_if(blank).alias("n")))
    return rows.agg(F.array(*counts).alias("all")).select(F.inline("all"))


def active_knowledge(nodes: DataFrame) -> DataFrame:
    return nodes.where("typ = 'knowledge' and coalesce(active, false)").withColumn("entered", F.coalesce(F.col("text").rlike(r"(?U)\S"), F.lit(False)))


def file_coverage(nodes: DataFrame) -> DataFrame:
    """(authority, nodes, entries, state) of each file with active knowledge: complete, partial or pending as all, some or none
    of its nodes have a text that is not blank. ``nodes`` has the column authority; no authority is the file ''."""
    rows = active_knowledge(nodes).groupBy(F.coalesce("authority", F.lit("")).alias("authority")).agg(F.count("*").alias("nodes"), F.count_if("entered").alias("entries"))
    return rows.withColumn("state", F.when(F.col("entries") == F.col("nodes"), "complete").when(F.col("entries") > 0, "partial").otherwise("pending"))


def active_edges(active: DataFrame, edges: DataFrame) -> DataFrame:
    """(src, dst, src_course, dst_course): semantic edges whose ends are both active knowledge."""
    side = lambda c: active.select(F.col("id").alias(c), F.col("course").alias(f"{c}_course"))
    return edges.where("rel <> 'contains'").select("src", "dst").join(side("src"), "src").join(side("dst"), "dst")


def cross_course(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row, n: semantic edges between active knowledge of two courses, both named. ``nodes`` has the column course."""
    return active_edges(active_knowledge(nodes), edges).agg(F.count_if(F.expr("src_course <> '' and dst_course <> '' and src_course <> dst_course")).alias("n"))


def course_statistics(nodes: DataFrame, edges: DataFrame, refs: DataFrame) -> DataFrame:
    """(course, nodes, entries, entry_ratio, semantic_nodes, isolated_nodes, references) over active knowledge.

    ``nodes`` has the columns authority and course; no course is 'unknown'. A file's references count for the course of
    its node of smallest id. References are counted by file before they meet the files, so a large file is one row.
    """
    active = active_knowledge(nodes).withColumn("authority", F.coalesce("authority", F.lit("")))
    linked = active_edges(active, edges).select(F.explode(F.array("src", "dst")).alias("id")).distinct().withColumn("linked", F.lit(1))
    course = F.coalesce("course", F.lit("unknown")).alias("course")
    rows = active.join(linked, "id", "left").groupBy(course).agg(F.count("*").alias("nodes"), F.count_if("entered").alias("entries"), F.count("linked").alias("semantic_nodes"))
    homes = active.groupBy("authority").agg(F.min_by(course, "id").alias("course"))
    told = refs.groupBy("authority").agg(F.count("*").alias("n")).join(homes, "authority").groupBy("course").agg(F.sum("n").alias("references"))
    ratio = F.round(F.col("entries") / F.col("nodes"), 6)
    return rows.join(told, "course", "left").select("course", "nodes", "entries", ratio.alias("entry_ratio"), "semantic_nodes", (F.col("nodes") - F.col("semantic_nodes")).alias("isolated_nodes"), F.coalesce("references", F.lit(0)).alias("references"))
