"""The driver's tables seen as graph tables: nodes, edges, references, marked-up text.

nodes: id, typ, label, text, aliases, active, source_status, curation_status, entry_sources; edges: src, rel, dst,
evidence, curation_status; refs: id, authority, line, target, context.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RELATIONS = ("contains", "prerequisite-for", "implies", "generalizes", "contrasts-with", "derived-from")
SEMANTIC = RELATIONS[1:]
ACYCLIC = ("contains", "prerequisite-for")
NODE_TYPES = ("knowledge", "field", "topic")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def named(prefix: str, key) -> F.Column:
    return F.concat(F.lit(prefix + "-"), F.col(key).cast("string"))


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    none = F.lit(None)

    def shaped(df, ident, typ, label, text, aliases, active, source_status, curation):
        return df.select(ident.alias("id"), F.lit(typ).alias("typ"), label.alias("label"), text.cast("string").alias("text"), aliases.cast("array<string>").alias("aliases"), active.cast("boolean").alias("active"), source_status.cast("string").alias("source_status"), curation.cast("string").alias("curation_status"))

    region, nation, supplier, part = (table(spark, sf_dir, t) for t in ("region", "nation", "supplier", "part"))
    lost = F.col("s_acctbal") < 0
    return (
        shaped(region, named("region", "r_regionkey"), "field", F.col("r_name"), none, none, none, F.lit("meta"), none)
        .unionByName(shaped(nation, named("nation", "n_nationkey"), "topic", F.col("n_name"), none, none, none, F.lit("meta"), none))
        .unionByName(shaped(supplier, named("supplier", "s_suppkey"), "knowledge", F.col("s_name"), none, none, F.when(lost, F.lit(False)).when(F.col("s_suppkey") % 4 != 0, F.lit(True)), F.when(lost, "orphaned").otherwise("active"), F.lit("current")))
        .unionByName(shaped(part, named("part", "p_partkey"), "knowledge", F.col("p_name"), F.col("p_type"), F.array("p_brand"), F.lit(True), F.lit("active"), F.when(F.col("p_size") % 7 == 0, "needs-review").when(F.col("p_size") % 5 == 0, "pending").otherwise("current")))
    )


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    def shaped(df, src, rel, dst, curation="current"):
        status = F.lit(curation) if isinstance(curation, str) else curation
        return df.select(src.alias("src"), F.lit(rel).alias("rel"), dst.alias("dst"), status.alias("curation_status"))

    nation, supplier, part, lineitem = (table(spark, sf_dir, t) for t in ("nation", "supplier", "part", "lineitem"))
    late = lineitem.where(F.col("l_shipdate") >= F.lit("1998-06-01").cast("timestamp")).select("l_partkey", "l_suppkey").distinct()
    steps = part.where("p_partkey % 3 = 0").select("p_partkey", (F.col("p_partkey") + 7).alias("next")).join(part.select(F.col("p_partkey").alias("next")), "next", "left_semi")
    return (
        shaped(nation, named("region", "n_regionkey"), "contains", named("nation", "n_nationkey"))
        .unionByName(shaped(supplier, named("nation", "s_nationkey"), "contains", named("supplier", "s_suppkey")))
        .unionByName(shaped(late, named("part", "l_partkey"), "derived-from", named("supplier", "l_suppkey"), F.when(F.col("l_partkey") % 11 == 0, "needs-review").otherwise("current")))
        .unionByName(shaped(steps, named("part", "p_partkey"), "prerequisite-for", named("part", "next")))
    )


def references(spark: SparkSession, sf_dir: str) -> DataFrame:
    item = table(spark, sf_dir, "lineitem")
    return item.groupBy(F.concat(F.lit("orders/"), F.col("l_orderkey").cast("string"), F.lit(".md")).alias("authority"), F.col("l_linenumber").alias("line"), named("part", "l_partkey").alias("target")).agg(F.min("l_suppkey").alias("k"))


def marked_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as marked-up Markdown: links become references, headings definitions."""
    text = F.regexp_replace("html", r'<a href="/([^"]+)">([^<]+)</a>', "[[$1|$2]]")
    text = F.regexp_replace(text, r"<h1>(.*?)</h1>", "--[[$1]]--")
    return table(spark, sf_dir, "pages").select("page_id", F.concat(F.lit("pages/"), F.col("page_id").cast("string"), F.lit(".md")).alias("path"), text.alias("content"))
