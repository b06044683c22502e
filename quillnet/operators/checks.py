"""Constraint queries: each gives rows (severity, code, subject, detail) for what breaks a rule, and none if nothing does."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillnet.operators.components import cycle_remainder
from quillnet.sources.projection import ACYCLIC, NODE_TYPES, RELATIONS, SEMANTIC

# The form of an id, the longest label, curation states.
NODE_ID, LABEL_LENGTH = r"^[a-z0-9]+(?:-[a-z0-9]+)*$", 1024
STATES = ("current", "pending", "needs-review")
UNSAFE_HTML = r"(?i)<\s*(script|iframe|object|embed)|\son[a-z]+\s*=|javascript:"


def told(df: DataFrame, severity: str, code: str, subject, detail) -> DataFrame:
    return df.select(F.lit(severity).alias("severity"), F.lit(code).alias("code"), subject.cast("string").alias("subject"), detail.cast("string").alias("detail"))


def edge_name():
    return F.concat_ws(" ", "src", "rel", "dst")


def node_form(nodes: DataFrame) -> DataFrame:
    """Ids, labels and types that are not as they must be; labels with unsafe HTML."""
    ident, label = F.col("id"), F.col("label")
    return reduce(DataFrame.unionByName, [
        told(nodes.where(ident.isNull() | ~ident.rlike(NODE_ID) | (F.length(ident) > 256)), "error", "invalid-node-id", ident, label),
        told(nodes.where(label.isNull() | (F.length(F.trim(label)) == 0) | (F.length(label) > LABEL_LENGTH)), "error", "invalid-node-label", ident, label),
        told(nodes.where(~F.col("typ").isin(list(NODE_TYPES))), "error", "unknown-node-type", ident, F.col("typ")),
        told(nodes.where(label.rlike(UNSAFE_HTML)), "error", "unsafe-label-html", ident, label),
        told(nodes.where(F.col("curation_status").isNotNull() & ~F.col("curation_status").isin(list(STATES))), "error", "invalid-curation-status", ident, F.col("curation_status")),
    ])


def duplicates(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Ids and edges that stand more than once."""
    return told(nodes.groupBy("id").count().where("count > 1"), "error", "duplicate-node", F.col("id"), F.col("count")).unionByName(
        told(edges.groupBy("src", "rel", "dst").count().where("count > 1"), "error", "duplicate-edge", edge_name(), F.col("count"))
    )


def dangling(nodes: DataFrame, edges: DataFrame, refs: DataFrame | None = None) -> DataFrame:
    """Ends of edges, and targets of references, that are no nodes."""
    ids = nodes.select("id").distinct()
    ends = [told(edges.join(ids.withColumnRenamed("id", side), side, "left_anti"), "error", "dangling-edge", F.col(side), edge_name()) for side in ("src", "dst")]
    if refs is not None:
        ends.append(told(refs.join(ids.withColumnRenamed("id", "target"), "target", "left_anti"), "warning", "dangling-ref", F.col("target"), F.concat_ws(":", "authority", F.col("line").cast("string"))))
    return reduce(DataFrame.unionByName, ends)


def relations(edges: DataFrame) -> DataFrame:
    """Unknown relations, and semantic edges that wait for review."""
    return told(edges.where(~F.col("rel").isin(list(RELATIONS))), "error", "unknown-relation", edge_name(), F.col("rel")).unionByName(
        told(edges.where(F.col("rel").isin(list(SEMANTIC)) & (F.col("curation_status") == "needs-review")), "warning", "stale-semantic-edge", edge_name(), F.col("curation_status"))
    )


def taxonomy(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """contains-edges other than field to topic, field to knowledge and topic to knowledge."""
    typ = nodes.select("id", "typ")
    rows = edges.where("rel = 'contains'").join(typ.select(F.col("id").alias("src"), F.col("typ").alias("above")), "src").join(typ.select(F.col("id").alias("dst"), F.col("typ").alias("below")), "dst")
    pair = F.concat_ws(">", "above", "below")
    return told(rows.where(~pair.isin("field>topic", "field>knowledge", "topic>knowledge")), "error", "invalid-taxonomy-edge", edge_name(), pair)


def cycles(edges: DataFrame) -> DataFrame:
    """Edges of acyclic relations that peeling leaves."""
    return reduce(DataFrame.unionByName, [told(cycle_remainder(edges.where(F.col("rel") == r)).withColumn("rel", F.lit(r)), "error", "graph-cycle", F.col("src"), edge_name()) for r in ACYCLIC])


def memberships(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, field): knowledge below a field, directly or by a topic."""
    typ = nodes.select("id", "typ")
    rows = edges.where("rel = 'contains'").join(typ.select(F.col("id").alias("src"), F.col("typ").alias("above")), "src").join(typ.select(F.col("id").alias("dst"), F.col("typ").alias("below")), "dst")
    direct = rows.where("above = 'field' and below = 'knowledge'").select(F.col("dst").alias("node"), F.col("src").alias("field"))
    upper, lower = rows.where("above = 'field' and below = 'topic'").select(F.col("dst").alias("topic"), F.col("src").alias("field")), rows.where("above = 'topic' and below = 'knowledge'").select(F.col("src").alias("topic"), F.col("dst").alias("node"))
    return direct.unionByName(lower.join(upper, "topic").select("node", "field")).distinct()


def unclassified(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Active knowledge without a field. Here ``active`` must be set: checks do not take a missing one for true."""
    rows = nodes.where("typ = 'knowledge' and coalesce(active, false)")
    return told(rows.join(memberships(nodes, edges).select(F.col("node").alias("id")).distinct(), "id", "left_anti"), "error", "unclassified-knowledge", F.col("id"), F.col("label"))


def stale_nodes(nodes: DataFrame) -> DataFrame:
    """Knowledge that lost its source; else, knowledge whose entry is out of date."""
    orphaned = F.coalesce(F.col("source_status") == "orphaned", F.lit(False))
    stale = F.coalesce(F.col("curation_status") == "needs-review", F.lit(False))
    rows = nodes.where("typ = 'knowledge'").withColumn("why", F.when(orphaned, "orphaned-node").when(stale, "stale-node-entry")).where("why is not null")
    return rows.select(F.lit("warning").alias("severity"), F.col("why").alias("code"), F.col("id").alias("subject"), F.col("label").alias("detail"))


def validate(nodes: DataFrame, edges: DataFrame, refs: DataFrame) -> DataFrame:
    """All rules; errors block a generation, warnings are kept with it."""
    return reduce(DataFrame.unionByName, [node_form(nodes), duplicates(nodes, edges), dangling(nodes, edges, refs), relations(edges), taxonomy(nodes, edges), cycles(edges), unclassified(nodes, edges), stale_nodes(nodes)])


def candidate_faults(nodes: DataFrame, edges: DataFrame, namespace: str) -> DataFrame:
    """A candidate graph must not be personal, name a place for every node, and not say a contrast both ways."""
    swapped = edges.where("rel = 'contrasts-with'").select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    twice = edges.where("rel = 'contrasts-with' and src < dst").join(swapped, ["src", "dst"], "left_semi")
    parts = [duplicates(nodes, edges), dangling(nodes, edges), told(twice, "error", "symmetric-duplicate", edge_name(), F.col("rel"))]
    if namespace == "personal":
        parts.append(told(nodes.sparkSession.range(1), "error", "personal-namespace", F.lit(namespace), F.lit(None)))
    if "authority" in nodes.columns:
        parts.append(told(nodes.where("authority is null or coalesce(line, page, section, equation) is null"), "error", "unlocated-node", F.col("id"), F.col("label")))
    return reduce(DataFrame.unionByName, parts)


def alignment_faults(mappings: DataFrame) -> DataFrame:
    """Mappings (id, subject, object, subject_ns, object_ns, predicate, status, justification, evidence): wrong enums, maps to
    itself, decisions without grounds, more than one reviewed exact target in a namespace."""
    predicates = ["exact-match", "close-match", "broad-match", "narrow-match", "related-match", "different-from"]
    states = ["proposed", "reviewed", "rejected", "stale", "superseded"]
    key = F.concat_ws(" ", "subject", "predicate", "object")
    grounds = (F.coalesce(F.size("justification"), F.lit(0)) > 0) & (F.coalesce(F.size("evidence"), F.lit(0)) > 0)
    several = mappings.where("status = 'reviewed' and predicate = 'exact-match'").groupBy("subject_ns", "subject", "object_ns").agg(F.countDistinct("object").alias("n")).where("n > 1")
    return reduce(DataFrame.unionByName, [
        told(mappings.where(~F.col("predicate").isin(predicates) | ~F.col("status").isin(states)), "error", "unknown-mapping-value", key, F.concat_ws("/", "predicate", "status")),
        told(mappings.where("subject_ns = object_ns and subject = object"), "error", "self-mapping", key, F.col("id")),
        told(mappings.groupBy("id").count().where("count > 1"), "error", "duplicate-mapping", F.col("id"), F.col("count")),
        told(mappings.where(F.col("status").isin("reviewed", "rejected") & ~grounds), "error", "groundless-decision", key, F.col("status")),
        told(several, "error", "ambiguous-exact-match", F.concat_ws(" ", "subject_ns", "subject", "object_ns"), F.col("n")),
    ])
