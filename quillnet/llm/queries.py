"""The queries of the training-data operators and, where SQL can express them, their DuckDB oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from quillnet.llm.toxicity import fitted, scored

    docs = table(spark, sf_dir, "documents")
    held_out = lambda c: F.crc32(c.cast("string").cast("binary")) % 5 == 0
    model = fitted(docs, table(spark, sf_dir, "labels"), lambda c: ~held_out(c))
    return scored(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillnet.llm.secrets import secret_digests

    return secret_digests(table(spark, sf_dir, "documents"))


def op3_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillnet.llm.chat import rendered

    return rendered(table(spark, sf_dir, "conversations"))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillnet.llm.exact_dedup import exact_duplicates

    return exact_duplicates(table(spark, sf_dir, "documents"))


def op5_vector_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillnet.llm.vector_join import vector_links

    return vector_links(table(spark, sf_dir, "embeddings"), least=0.95)


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillnet.llm.pii import personal_digests

    return personal_digests(table(spark, sf_dir, "documents"))


def op7_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillnet.llm.mixing import mixed

    return mixed(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillnet.llm.warc import round_trip

    return round_trip(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op9_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillnet.llm.ngram_join import near_components

    return near_components(table(spark, sf_dir, "documents"), width=4, num=85, den=100)


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillnet.llm.packing import packed

    return packed(table(spark, sf_dir, "documents"))


OP3_SQL = r"""
WITH t AS (SELECT DISTINCT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations),
d AS (SELECT *, sha256(length(role)::VARCHAR || ':' || role || text) AS digest FROM t),
p AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, digest) AS place FROM d),
c AS (SELECT conv_id, list(digest ORDER BY place) AS turns FROM p GROUP BY conv_id),
b AS (SELECT DISTINCT turns[1:k] AS turns FROM (SELECT turns, unnest(range(1, len(turns))) AS k FROM c)),
m AS (SELECT min(conv_id) AS conv_id, count(*) AS copies FROM c WHERE turns NOT IN (SELECT turns FROM b) GROUP BY turns)
SELECT p.conv_id, ((place - 1) // 64)::INT AS piece, ((place - 1) // 64 * 64)::BIGINT AS first_turn, count(*)::BIGINT AS n_turns, copies::BIGINT AS copies,
       string_agg('<|im_start|>' || replace(role, '<|', '< |') || chr(10) || replace(text, '<|', '< |') || '<|im_end|>' || chr(10), '' ORDER BY place) AS rendered
FROM p JOIN m ON p.conv_id IS NOT DISTINCT FROM m.conv_id GROUP BY ALL
"""

OP4_SQL = r"""
WITH n AS (SELECT doc_id, length(coalesce(text, '')) AS chars, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS body FROM documents),
g AS (SELECT *, first_value(doc_id) OVER (PARTITION BY body ORDER BY chars DESC, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS keep_id,
             count(*) OVER (PARTITION BY body) AS group_size FROM n)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(body) AS text_sha256 FROM g
"""

OP7_SQL = r"""
WITH d AS (SELECT doc_id, source, CASE WHEN text IS NULL THEN 0 ELSE len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) END AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][((row_number() OVER (ORDER BY CASE WHEN source IS NULL THEN '1' ELSE '0' || source END) - 1) % 3 + 1)::INT] AS weight,
             source_size * 2.0::DOUBLE AS ceiling, CASE WHEN source IS NULL THEN '1' ELSE '0' || source END AS k FROM s),
f AS (SELECT *, coalesce(sum(ceiling) OVER (ORDER BY ceiling / weight, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0::DOUBLE) AS filled,
             sum(weight) OVER (ORDER BY ceiling / weight, k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest,
             sum(source_size) OVER () * 1.5::DOUBLE AS total, row_number() OVER (ORDER BY ceiling / weight, k) AS nth FROM w),
l AS (SELECT *, (total - filled) / rest AS level FROM f),
m AS (SELECT (SELECT arg_min(level, nth) FROM l WHERE level * weight <= ceiling) AS level),
t AS (SELECT l.source, l.source_size, l.k, least(l.ceiling, coalesce(m.level * l.weight, l.ceiling)) AS target FROM l, m),
p AS (SELECT d.doc_id, d.size, t.source_size, t.target, row_number() OVER (PARTITION BY t.k ORDER BY d.size, d.doc_id) AS place,
             CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS share,
             ('0x' || substr(md5('quillnet-mix/' || t.k), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS start
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size::BIGINT AS size, source_size, target,
       ((floor(start + place * share) - floor(start + (place - 1) * share)) * size)::BIGINT AS taken FROM p
"""

OP8_SQL = r"""
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS body FROM pages),
h AS (SELECT page_id, octet_length(body)::BIGINT AS payload_bytes, sha1(body) AS digits FROM p),
d AS (SELECT page_id, payload_bytes,
             list_aggregate(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(digits, (5 * (i // 4) + 1)::INT, 5))::INT >> (15 - 5 * (i % 4))::INT) & 31) + 1, 1)), 'string_agg', '') AS payload_digest
      FROM h),
g AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS chosen FROM d)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = chosen THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> chosen THEN chosen END AS refers_to FROM g
"""

OP9_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents),
s AS (SELECT doc_id, CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 4 THEN [array_to_string(words, ' ')]
             ELSE list_distinct(list_transform(range(1, len(words) - 2), lambda i: array_to_string(words[i:i + 3], ' '))) END AS grams FROM w),
n AS (SELECT doc_id, len(grams) AS n_shingles FROM s),
g AS (SELECT doc_id, unnest(grams) AS gram FROM s),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS shared FROM g a JOIN g b ON a.gram = b.gram AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * shared >= 85 * (a.n_shingles + b.n_shingles - shared)),
r AS (SELECT doc_id AS x, doc_id AS y FROM n UNION SELECT r.x, l.y FROM r JOIN l ON l.x = r.y)
SELECT n.doc_id, n.n_shingles::BIGINT AS n_shingles, min(r.y) AS component_id FROM n JOIN r ON r.x = n.doc_id GROUP BY ALL
"""

OP5_SQL = r"""
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings),
n AS (SELECT vec_id, x, sqrt(list_dot_product(x, x)) AS norm FROM v WHERE list_dot_product(x, x) > 0),
l AS (SELECT a.vec_id AS x, b.vec_id AS y FROM n a JOIN n b ON a.vec_id <> b.vec_id AND list_dot_product(a.x, b.x) >= 0.95::DOUBLE * a.norm * b.norm),
r AS (SELECT vec_id AS x, vec_id AS y FROM v UNION SELECT r.x, l.y FROM r JOIN l ON l.x = r.y),
c AS (SELECT x AS vec_id, min(y) AS component_id FROM r GROUP BY 1),
k AS (SELECT x AS vec_id, count(*) AS n_links FROM l GROUP BY 1)
SELECT c.vec_id, coalesce(k.n_links, 0)::BIGINT AS n_links, c.component_id, c.vec_id = c.component_id AS kept FROM c LEFT JOIN k USING (vec_id)
"""

QUERIES = {f.__name__: f for f in (op1_toxicity, op2_secret_scan, op3_chat_formatting, op4_exact_dedup, op5_vector_join, op6_pii, op7_source_mixing, op8_warc, op9_ngram_join, op10_best_fit_packing)}
ORACLES = {"op3_chat_formatting": OP3_SQL, "op4_exact_dedup": OP4_SQL, "op5_vector_join": OP5_SQL, "op7_source_mixing": OP7_SQL, "op8_warc": OP8_SQL, "op9_ngram_join": OP9_SQL}


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
