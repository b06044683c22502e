"""Generations: immutable Parquet folders named by their digest, one pointer to the current one, receipts."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

POINTER, RECEIPTS = "CURRENT", "receipts"


def digest(tables: dict[str, DataFrame]) -> str:
    """A digest of the rows of all tables, whatever their order: per table the count and the sum of row hashes."""
    import hashlib

    parts = []
    for name in sorted(tables):
        df = tables[name]
        cols = sorted(df.columns)
        row = F.sha2(F.to_json(F.struct(*cols)).cast("binary"), 256)
        halves = [F.conv(F.substring(row, k, 15), 16, 10).cast("decimal(38,0)") for k in (1, 16, 31)]
        got = df.select(*[h.alias(f"h{k}") for k, h in enumerate(halves)]).agg(F.count("*"), *[F.sum(f"h{k}") for k in range(3)]).first()
        parts.append(f"{name}:{','.join(cols)}:{[str(x) for x in got]}")
    return hashlib.sha256("\n".join(parts).encode()).hexdigest()


def _files(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at, jvm


def _write(spark: SparkSession, path: str, text: str) -> None:
    """Writes beside and renames, so that a reader sees the old or the new text."""
    fs, at, jvm = _files(spark, path)
    beside = jvm.org.apache.hadoop.fs.Path(path + ".new")
    out = fs.create(beside, True)
    out.write(bytearray(text.encode()))
    out.close()
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(at.toUri(), spark.sparkContext._jsc.hadoopConfiguration())
    rename = getattr(jvm, "org.apache.hadoop.fs.Options$Rename")
    options = spark.sparkContext._gateway.new_array(rename, 1)
    options[0] = rename.OVERWRITE
    context.rename(context.makeQualified(beside), context.makeQualified(at), options)


def _read(spark: SparkSession, path: str) -> str | None:
    fs, at, jvm = _files(spark, path)
    if not fs.exists(at):
        return None
    stream = fs.open(at)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def current(spark: SparkSession, root: str) -> str | None:
    return _read(spark, f"{root}/{POINTER}")


def commit(spark: SparkSession, root: str, tables: dict[str, DataFrame], expected: str | None = None) -> str:
    """Writes a generation and makes it current, if ``expected`` is what was current. A generation that exists is reused."""
    name = digest(tables)
    fs, at, _ = _files(spark, f"{root}/gen={name}/_manifest.json")
    if not fs.exists(at):
        for table, df in tables.items():
            df.write.mode("overwrite").parquet(f"{root}/gen={name}/{table}")
        _write(spark, f"{root}/gen={name}/_manifest.json", json.dumps({"tables": sorted(tables), "digest": name}))
    if expected is not None and current(spark, root) not in (expected, name):
        raise RuntimeError("another generation became current")
    _write(spark, f"{root}/{POINTER}", name)
    return name


def load(spark: SparkSession, root: str, name: str | None = None) -> dict[str, DataFrame]:
    """The tables of one generation; the pointer is read once, so generations never mix."""
    name = name or current(spark, root)
    if name is None:
        raise FileNotFoundError(root)
    manifest = json.loads(_read(spark, f"{root}/gen={name}/_manifest.json") or "{}")
    return {t: spark.read.parquet(f"{root}/gen={name}/{t}") for t in manifest["tables"]}


def verify(spark: SparkSession, root: str, name: str | None = None) -> bool:
    """Whether a generation still has the digest that names it."""
    name = name or current(spark, root)
    return digest(load(spark, root, name)) == name


def apply_request(spark: SparkSession, root: str, request: str, change: Callable[[dict[str, DataFrame]], dict[str, DataFrame]], check: Callable[[dict[str, DataFrame]], DataFrame] | None = None) -> str:
    """A transaction: the tables that ``change`` makes of the current ones become current, once for each request id.

    ``check`` gives faults (severity, ...); an error leaves the pointer where it is. A request that is sent again
    gets the generation it got.
    """
    place = f"{root}/{RECEIPTS}/{request}"
    if done := _read(spark, place):
        return done
    base = current(spark, root)
    tables = change(load(spark, root, base))
    if check is not None and not (faults := check(tables).where("severity = 'error'")).isEmpty():
        raise ValueError(f"rejected: {faults.limit(5).collect()}")
    name = commit(spark, root, tables, base)
    _write(spark, place, name)
    return name


def public_view(nodes: DataFrame, edges: DataFrame, refs: DataFrame, published: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What an export shows of ``published`` fields (id): they, their topics, the active knowledge below, edges and references within."""
    from quillnet.operators.checks import memberships

    knowledge = memberships(nodes, edges).join(published.select(F.col("id").alias("field")), "field", "left_semi").select(F.col("node").alias("id"))
    topics = edges.where("rel = 'contains'").join(published.select(F.col("id").alias("src")), "src", "left_semi").select(F.col("dst").alias("id"))
    seen = published.select("id").unionByName(knowledge).unionByName(topics).distinct()
    shown = nodes.where("coalesce(active, true) and (typ <> 'knowledge' or curation_status <> 'needs-review')").join(seen, "id", "left_semi").select("id", "typ", "label")
    ids = shown.select("id")
    within = edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi").select("src", "rel", "dst")
    return shown, within, refs.join(ids.withColumnRenamed("id", "target"), "target", "left_semi")


def unique_names(rows: DataFrame) -> DataFrame:
    """(id, name) for ``rows`` (id, label): a file name for each note; names that are alike when folded get a hash of the id."""
    from pyspark.sql import Window

    from quillnet.functions.text import fold

    plain = F.trim(F.regexp_replace("label", r'[\\/:*?"<>|#^\[\]]', " "))
    named = rows.select("id", plain.alias("name")).withColumn("key", fold("name"))
    n = F.count("*").over(Window.partitionBy("key"))
    return named.select("id", F.when((n > 1) | (F.col("key") == ""), F.concat_ws("-", F.when(F.col("key") != "", F.col("name")), F.substring(F.sha2(F.col("id").cast("binary"), 256), 1, 8))).otherwise(F.col("name")).alias("name"))


def notes(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, name, body): a Markdown note for each active knowledge node, with links along its outgoing edges."""
    rows = nodes.where("typ = 'knowledge' and coalesce(active, true)").select("id", "label", "text")
    names = unique_names(rows)
    ends = edges.where("rel <> 'contains' and coalesce(curation_status, 'current') = 'current'").join(names.select(F.col("id").alias("dst"), F.col("name").alias("to")), "dst")
    links = ends.groupBy(F.col("src").alias("id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rel", "to"))), lambda x: F.concat(F.lit("- "), x["rel"], F.lit(" [["), x["to"], F.lit("]]"))), "\n").alias("links"))
    return rows.join(names, "id").join(links, "id", "left").select("id", "name", F.concat_ws("\n\n", F.concat(F.lit("# "), F.col("label")), "text", "links").alias("body"))
