"""The engine's queries over the driver's tables, with an independent DuckDB oracle for each that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillnet.functions import text as T
from quillnet.operators import align as A
from quillnet.operators import audit, checks, lookup, policy, scan, sync, traverse
from quillnet.operators.components import components, cycle_remainder
from quillnet.plans.retrieval import LANE, Plan, execute, fused
from quillnet.sources import projection as P
from quillnet.sources import store
from quillnet.streaming.sync import sessions

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

# The graph tables of the projection, for oracles.
N = """
nodes AS (
 SELECT 'region-'||r_regionkey id,'field' typ,r_name label,NULL::VARCHAR txt,NULL::VARCHAR[] aliases,NULL::BOOLEAN active,'meta' source_status,NULL::VARCHAR curation_status FROM region
 UNION ALL SELECT 'nation-'||n_nationkey,'topic',n_name,NULL,NULL,NULL,'meta',NULL FROM nation
 UNION ALL SELECT 'supplier-'||s_suppkey,'knowledge',s_name,NULL,NULL,CASE WHEN s_acctbal<0 THEN false WHEN s_suppkey%4<>0 THEN true END,CASE WHEN s_acctbal<0 THEN 'orphaned' ELSE 'active' END,'current' FROM supplier
 UNION ALL SELECT 'part-'||p_partkey,'knowledge',p_name,p_type,[p_brand],true,'active',CASE WHEN p_size%7=0 THEN 'needs-review' WHEN p_size%5=0 THEN 'pending' ELSE 'current' END FROM part),
edges AS (
 SELECT 'region-'||n_regionkey src,'contains' rel,'nation-'||n_nationkey dst,'current' curation_status FROM nation
 UNION ALL SELECT 'nation-'||s_nationkey,'contains','supplier-'||s_suppkey,'current' FROM supplier
 UNION ALL SELECT DISTINCT 'part-'||l_partkey,'derived-from','supplier-'||l_suppkey,CASE WHEN l_partkey%11=0 THEN 'needs-review' ELSE 'current' END FROM lineitem WHERE l_shipdate>=TIMESTAMP '1998-06-01'
 UNION ALL SELECT 'part-'||a.p_partkey,'prerequisite-for','part-'||b.p_partkey,'current' FROM part a JOIN part b ON b.p_partkey=a.p_partkey+7 WHERE a.p_partkey%3=0),
refs AS (SELECT 'orders/'||l_orderkey||'.md' authority,l_linenumber line,'part-'||l_partkey target,min(l_suppkey) k FROM lineitem GROUP BY 1,2,3)"""
ALLOWED = "coalesce(active,true) AND coalesce(curation_status,'')<>'needs-review' AND coalesce(source_status,'')<>'orphaned'"
VISIBLE = f"vn AS (SELECT * FROM nodes WHERE {ALLOWED}), ve AS (SELECT * FROM edges WHERE curation_status<>'needs-review' AND rel<>'contains' AND src IN (SELECT id FROM vn) AND dst IN (SELECT id FROM vn))"
MEMBERS = """members AS (SELECT DISTINCT e.dst node, f.src field FROM edges e JOIN edges f ON f.dst=e.src AND f.rel='contains' AND f.src LIKE 'region-%' WHERE e.rel='contains' AND e.dst LIKE 'supplier-%')"""
TOKENS = r"list_distinct(regexp_extract_all(replace(lower({0}),'ß','ss'), '[\p{{L}}\p{{N}}]+(?:[-''][\p{{L}}\p{{N}}]+)*')[:128])"
QUERY = "the of und que"


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return put


def graph(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    return P.nodes(spark, sf), P.edges(spark, sf)


def document_nodes(spark: SparkSession, sf: str) -> DataFrame:
    return P.table(spark, sf, "documents").select(P.named("doc", "doc_id").alias("id"), F.lit("knowledge").alias("typ"), F.concat_ws(" ", "source", "lang").alias("label"), "text", F.array("lang").alias("aliases"))


SCORED = f"""d AS (SELECT 'doc-'||doc_id id, source||' '||lang label, lang alias, text FROM documents),
s AS (SELECT id,label, 8*len(list_intersect({TOKENS.format('label')},['the','of','und','que'])) + 6*len(list_intersect({TOKENS.format('alias')},['the','of','und','que']))
 + len(list_intersect({TOKENS.format('text')},['the','of','und','que'])) + CASE WHEN contains(lower(label),'{QUERY}') THEN 8 ELSE 0 END AS score FROM d)"""


@query(f"WITH {SCORED} SELECT row_number() OVER (ORDER BY score DESC, lower(label), id)::INT rank, id, label, score::INT score FROM s WHERE score>0 QUALIFY rank<=20")
def search_documents(spark, sf):
    return lookup.search(document_nodes(spark, sf), QUERY, 20)


@query(f"WITH {SCORED} SELECT id, score::BIGINT score FROM s WHERE score>0 ORDER BY score DESC, id LIMIT 50")
def search_postings(spark, sf):
    return lookup.search_postings(lookup.postings(document_nodes(spark, sf)), QUERY, 50)


@query("SELECT 'doc-'||doc_id id, source||' '||lang AS label, 10 + 20*(CASE WHEN contains(lower(source||' '||lang),'the') AND contains(lower(source||' '||lang),'en') THEN 1 ELSE 0 END) AS score FROM documents WHERE contains(lower('doc-'||doc_id||' '||source||' '||lang||' '||lang||' '||text),'the') AND contains(lower('doc-'||doc_id||' '||source||' '||lang||' '||lang||' '||text),'en') ORDER BY score DESC, label, id LIMIT 25")
def search_all_terms(spark, sf):
    return lookup.search_all_terms(document_nodes(spark, sf), "The EN", 25)


CONCEPTS = [(0, "part-5"), (1, "Supplier#000000003"), (2, "brand#11"), (3, "nothing of the kind"), (4, "asia"), (5, "supplier-9"), (6, "BRAND#99")]


@query(f"""WITH {N}, c(position, concept) AS (VALUES {','.join(f"({k},'{v}')" for k, v in CONCEPTS)}),
f AS (SELECT position, 0 way, id node FROM c JOIN nodes ON id=concept UNION SELECT position, 1, id FROM c JOIN nodes ON lower(label)=lower(concept) UNION SELECT position, 2, id FROM c JOIN (SELECT id, unnest(aliases) a FROM nodes) ON lower(a)=lower(concept)),
b AS (SELECT * FROM f QUALIFY way=min(way) OVER (PARTITION BY position)), m AS (SELECT position, min(way) way, count(*) n, list_sort(list(node))[:50] matches FROM b GROUP BY 1)
SELECT position, concept, CASE WHEN n IS NULL THEN 'missing' WHEN n>1 THEN 'ambiguous' WHEN way=2 THEN 'alias' ELSE 'exact' END status, coalesce(array_to_string(matches,','),'') matches FROM c LEFT JOIN m USING (position)""")
def resolve_labels(spark, sf):
    found = lookup.resolve(P.nodes(spark, sf), spark.createDataFrame(CONCEPTS, "position int, concept string"), 1_000_000)
    return found.withColumn("matches", F.array_join(F.slice("matches", 1, 50), ","))


@query(f"""WITH {N}, c(position, concept) AS (VALUES {','.join(f"({k},'{v}')" for k, v in CONCEPTS)}),
f AS (SELECT position, 0 way, id node FROM c JOIN nodes ON id=concept UNION SELECT position, 1, id FROM c JOIN nodes ON lower(label)=lower(concept) UNION SELECT position, 2, id FROM c JOIN (SELECT id, unnest(aliases) a FROM nodes) ON lower(a)=lower(concept)),
b AS (SELECT *, count(*) OVER (PARTITION BY position) n FROM (SELECT * FROM f QUALIFY way=min(way) OVER (PARTITION BY position)))
SELECT position, concept, CASE WHEN n IS NULL THEN 'missing' WHEN n>1 THEN 'ambiguous' WHEN way=2 THEN 'alias' ELSE 'exact' END status, node FROM c LEFT JOIN b USING (position)""")
def resolve_matches(spark, sf):
    return lookup.resolve_all(P.nodes(spark, sf), spark.createDataFrame(CONCEPTS, "position int, concept string"))


@query(f"""WITH {N} SELECT 'node' part, typ AS name, label other, NULL::VARCHAR place FROM nodes WHERE id='part-12' UNION ALL SELECT 'incoming',rel,src,NULL FROM edges WHERE dst='part-12'
UNION ALL SELECT 'outgoing',rel,dst,NULL FROM edges WHERE src='part-12' UNION ALL SELECT 'backlink','reference',authority,line::VARCHAR FROM refs WHERE target='part-12'""")
def node_get(spark, sf):
    return lookup.get(*graph(spark, sf), P.references(spark, sf), "part-12")


@query(f"WITH {N} SELECT id, typ, label FROM nodes WHERE {ALLOWED}")
def node_policy_filter(spark, sf):
    return P.nodes(spark, sf).where(policy.node_allowed()).select("id", "typ", "label")


@query(f"WITH {N}, {VISIBLE} SELECT src, rel, dst FROM ve")
def edge_policy_filter(spark, sf):
    return policy.visible(*graph(spark, sf))[1].select("src", "rel", "dst")


#: The two visible parts of lowest key, as seeds.
SEEDS = "sd AS (SELECT id, k FROM (SELECT id, row_number() OVER (ORDER BY substr(id,6)::INT)-1 k FROM vn WHERE id LIKE 'part-%') WHERE k<2)"


def first_parts(nodes: DataFrame) -> list[str]:
    return [r["id"] for r in nodes.where("id like 'part-%'").orderBy(F.substring("id", 6, 20).cast("int")).limit(2).select("id").collect()]


BOTH = "SELECT src a, dst b FROM edges WHERE rel<>'contains' UNION SELECT dst, src FROM edges WHERE rel<>'contains'"


@query(f"WITH RECURSIVE {N}, m AS ({BOTH}), r AS (SELECT 'part-0' id, 0 depth UNION SELECT m.b, r.depth+1 FROM r JOIN m ON m.a=r.id WHERE r.depth<2) SELECT id, min(depth) depth FROM r GROUP BY 1")
def reach_depth2(spark, sf):
    edges = P.edges(spark, sf).where("rel <> 'contains'")
    return traverse.reach(edges, spark.createDataFrame([("part-0",)], "id string"), 2)


@query(f"""WITH {N}, {VISIBLE}, {SEEDS}, s AS (SELECT id, k parent, id root FROM sd),
m AS (SELECT src near, dst far, rel, 'out' way FROM ve UNION ALL SELECT dst, src, rel, 'in' FROM ve),
f AS (SELECT far id, arg_min(s.root, (s.parent, m.rel, m.far, m.way)) root FROM m JOIN s ON m.near=s.id WHERE far NOT IN (SELECT id FROM s) GROUP BY 1)
SELECT x.id, vn.label, x.depth, x.root FROM (SELECT id, 0 depth, root FROM s UNION ALL SELECT id, 1, root FROM f) x JOIN vn USING (id)""")
def expand_depth1(spark, sf):
    nodes, edges = policy.visible(*graph(spark, sf))
    return traverse.expanded(nodes, edges, first_parts(nodes), depth=1, limit=500)


PPR_STEPS = 20


def ppr_sql() -> str:
    head = f"""WITH {N}, {VISIBLE}, {SEEDS}, w AS (SELECT src u, dst v, sum(CASE rel WHEN 'prerequisite-for' THEN 1.0::DOUBLE ELSE 0.9::DOUBLE END) w FROM ve GROUP BY 1,2),
p AS MATERIALIZED (SELECT u, v, w/sum(w) OVER (PARTITION BY u) p FROM w), n AS MATERIALIZED (SELECT id, coalesce((SELECT (2-k)/3.0::DOUBLE FROM sd WHERE sd.id=vn.id), 0::DOUBLE) r, id IN (SELECT u FROM p) flows FROM vn), s0 AS (SELECT id, r, flows, r s FROM n)"""
    for k in range(PPR_STEPS):
        head += f""",
s{k + 1} AS MATERIALIZED (SELECT a.id, a.r, a.flows, 0.15::DOUBLE*a.r + 0.85::DOUBLE*(coalesce(c.s,0) + l.s*a.r) s FROM s{k} a LEFT JOIN (SELECT v, sum(s*p) s FROM p JOIN s{k} ON u=id GROUP BY 1) c ON c.v=a.id, (SELECT coalesce(sum(s),0) s FROM s{k} WHERE NOT flows) l)"""
    return head + f" SELECT id, round(s,9) score FROM s{PPR_STEPS} WHERE s>1e-8"


@query(ppr_sql())
def ppr_20(spark, sf):
    nodes, edges = policy.visible(*graph(spark, sf))
    first, second = first_parts(nodes)
    return traverse.pagerank(nodes, edges, {first: 2.0, second: 1.0, "part-none": 1.0}, iterations=PPR_STEPS, tolerance=0.0, limit=None).where("score > 1e-8").withColumn("score", F.round("score", 9))


#: No path of visible edges is longer: prerequisites lead to parts without any, and suppliers lead nowhere.
@query(f"""WITH RECURSIVE {N}, {VISIBLE}, {SEEDS}, r AS (SELECT id, id seed, 0 d FROM sd UNION SELECT e.dst, r.seed, r.d+1 FROM r JOIN ve e ON e.src=r.id WHERE r.d<8)
SELECT id, arg_min(seed, (d, seed)) seed FROM r GROUP BY 1""")
def ppr_owners(spark, sf):
    nodes, edges = policy.visible(*graph(spark, sf))
    return traverse.seed_owners(nodes, edges, first_parts(nodes))


@query("WITH RECURSIVE m AS (SELECT p_partkey a, p_partkey+7 b FROM part WHERE p_partkey%3=0 AND p_partkey+7 IN (SELECT p_partkey FROM part)), e AS (SELECT a,b FROM m UNION SELECT b,a FROM m), r AS (SELECT a x, a y FROM e UNION SELECT r.x, e.b FROM r JOIN e ON e.a=r.y) SELECT 'part-'||x node, min('part-'||y) component FROM r GROUP BY 1")
def components_prerequisites(spark, sf):
    steps = P.edges(spark, sf).where("rel = 'prerequisite-for'")
    return components(steps.select(F.col("src").alias("u"), F.col("dst").alias("v")))


def looped(spark, sf):
    return P.edges(spark, sf).where("rel = 'prerequisite-for'").select("src", "dst").unionByName(spark.createDataFrame([("part-10", "part-3")], "src string, dst string"))


@query(f"WITH RECURSIVE {N}, e AS (SELECT src,dst FROM edges WHERE rel='prerequisite-for' UNION ALL SELECT 'part-10','part-3'), r AS (SELECT src x, dst y FROM e UNION SELECT r.x, e.dst FROM r JOIN e ON e.src=r.y), c AS (SELECT x FROM r WHERE x=y) SELECT src, dst FROM e WHERE src IN (FROM c) AND dst IN (FROM c)")
def cycle_members(spark, sf):
    return cycle_remainder(looped(spark, sf))


@query(f"WITH {N}, {MEMBERS} SELECT node, field FROM members")
def field_memberships(spark, sf):
    return checks.memberships(*graph(spark, sf))


@query(f"WITH {N}, {MEMBERS}, c AS (SELECT node, count(*) fields FROM members GROUP BY 1) SELECT coalesce(c.fields,0)::BIGINT fields, count(*) n FROM nodes LEFT JOIN c ON c.node=id WHERE typ='knowledge' GROUP BY 1")
def field_histogram(spark, sf):
    return audit.field_histogram(*graph(spark, sf))


@query(f"WITH {N} SELECT 'node_type' counter, typ AS \"value\", count(*) n FROM nodes GROUP BY ALL UNION ALL SELECT 'source_status', source_status, count(*) FROM nodes GROUP BY ALL UNION ALL SELECT 'curation_status', curation_status, count(*) FROM nodes WHERE curation_status IS NOT NULL GROUP BY ALL UNION ALL SELECT 'relation', rel, count(*) FROM edges GROUP BY ALL")
def manifest_counts(spark, sf):
    return audit.manifest_counts(*graph(spark, sf))


DEGREES = "deg AS (SELECT id, count(*) degree FROM (SELECT src id FROM edges WHERE rel<>'contains' UNION ALL SELECT dst FROM edges WHERE rel<>'contains') GROUP BY 1)"


@query(f"WITH {N}, {DEGREES} SELECT * FROM deg ORDER BY degree DESC, id LIMIT 12")
def audit_hubs(spark, sf):
    return audit.hubs(P.edges(spark, sf))


@query(f"""WITH {N}, {MEMBERS}, {DEGREES}, x AS (SELECT id, CASE WHEN coalesce(active,false) THEN 1 ELSE 0 END a, CASE WHEN id IN (SELECT node FROM members) THEN 1 ELSE 0 END c, CASE WHEN id IN (SELECT id FROM deg) THEN 1 ELSE 0 END d FROM nodes WHERE typ='knowledge'),
y AS (SELECT count(*) knowledge, sum(a)::BIGINT active, sum(a*c)::BIGINT classified, sum(a*d)::BIGINT connected FROM x) SELECT *, round(classified/active,6) classified_share, round(connected/active,6) connected_share FROM y""")
def audit_coverage(spark, sf):
    return audit.coverage(*graph(spark, sf))


@query(f"""WITH {N}, {MEMBERS}, c AS (SELECT node, count(*) f FROM members GROUP BY 1), x AS (SELECT id, c.f, id IN (SELECT dst FROM edges WHERE rel='contains') p FROM nodes LEFT JOIN c ON node=id WHERE typ='knowledge')
SELECT 'no-parent' counter, count(*) FILTER (NOT p) n FROM x UNION ALL SELECT 'no-field', count(*) FILTER (f IS NULL) FROM x UNION ALL SELECT 'many-fields', count(*) FILTER (f>1) FROM x""")
def audit_quality(spark, sf):
    return audit.quality(*graph(spark, sf))


@query(f"""WITH {N}, e AS (SELECT rel, CASE WHEN src LIKE '%7' THEN ' ' WHEN src LIKE '%9' THEN NULL ELSE src END evidence, CASE WHEN dst LIKE '%3' THEN '' ELSE '0.9' END confidence FROM edges WHERE rel<>'contains')
SELECT 'missing-evidence' counter, count(*) FILTER (trim(coalesce(evidence,''))='') n FROM e UNION ALL SELECT 'missing-confidence', count(*) FILTER (trim(confidence)='') FROM e""")
def audit_edge_quality(spark, sf):
    edges = P.edges(spark, sf).withColumns({"evidence": F.when(F.col("src").like("%7"), " ").when(~F.col("src").like("%9"), F.col("src")), "confidence": F.when(F.col("dst").like("%3"), "").otherwise("0.9")})
    return audit.edge_quality(edges)


#: Nodes with their file and course: parts by brand, every other size without an entry; suppliers in no course.
FILED = """filed AS (SELECT 'part-'||p_partkey id, CASE WHEN p_size%2=0 THEN ' ' ELSE p_type END txt, 'orders/'||(p_partkey%500)||'.md' authority, p_brand course FROM part
UNION ALL SELECT 'supplier-'||s_suppkey, NULL, 'suppliers/'||(s_suppkey%10)||'.md', NULL FROM supplier WHERE s_acctbal>=0 AND s_suppkey%4<>0),
linked AS (SELECT e.src, e.dst, a.course ac, b.course bc FROM edges e JOIN filed a ON a.id=e.src JOIN filed b ON b.id=e.dst WHERE rel<>'contains')"""


def filed(spark, sf):
    part, supplier = P.table(spark, sf, "part"), P.table(spark, sf, "supplier")
    homes = part.select(P.named("part", "p_partkey").alias("id"), F.when(F.col("p_size") % 2 == 0, " ").otherwise(F.col("p_type")).alias("text"), F.concat(F.lit("orders/"), (F.col("p_partkey") % 500).cast("string"), F.lit(".md")).alias("authority"), F.col("p_brand").alias("course")).unionByName(
        supplier.select(P.named("supplier", "s_suppkey").alias("id"), F.lit(None).cast("string").alias("text"), F.concat(F.lit("suppliers/"), (F.col("s_suppkey") % 10).cast("string"), F.lit(".md")).alias("authority"), F.lit(None).cast("string").alias("course"))
    )
    return P.nodes(spark, sf).drop("text").join(homes, "id", "left")


@query(f"WITH {N}, {FILED} SELECT authority, count(*) nodes, count(*) FILTER (trim(coalesce(txt,''))<>'') entries, CASE WHEN count(*) FILTER (trim(coalesce(txt,''))<>'')=count(*) THEN 'complete' WHEN count(*) FILTER (trim(coalesce(txt,''))<>'')>0 THEN 'partial' ELSE 'pending' END state FROM filed GROUP BY 1")
def audit_files(spark, sf):
    return audit.file_coverage(filed(spark, sf))


@query(f"WITH {N}, {FILED} SELECT count(*) n FROM linked WHERE ac<>bc")
def audit_cross_course(spark, sf):
    return audit.cross_course(filed(spark, sf), P.edges(spark, sf))


@query(f"""WITH {N}, {FILED}, met AS (SELECT src id FROM linked UNION SELECT dst FROM linked), home AS (SELECT authority, coalesce(arg_min(coalesce(course,'unknown'), id),'unknown') course FROM filed GROUP BY 1),
told AS (SELECT course, count(*) n FROM refs JOIN home USING (authority) GROUP BY 1),
per AS (SELECT coalesce(course,'unknown') course, count(*) nodes, count(*) FILTER (trim(coalesce(txt,''))<>'') entries, count(*) FILTER (id IN (SELECT id FROM met)) semantic_nodes FROM filed GROUP BY 1)
SELECT course, nodes, entries, round(entries/nodes,6) entry_ratio, semantic_nodes, nodes-semantic_nodes isolated_nodes, coalesce(n,0)::BIGINT AS "references" FROM per LEFT JOIN told USING (course)""")
def audit_courses(spark, sf):
    return audit.course_statistics(filed(spark, sf), P.edges(spark, sf), P.references(spark, sf))


@query("SELECT source, count(*) documents, sum(length(text))::BIGINT characters, sum(strlen(text))::BIGINT AS \"bytes\", count(DISTINCT sha256(text)) texts FROM documents GROUP BY 1")
def document_inventory(spark, sf):
    return audit.inventory(P.table(spark, sf, "documents"))


@query(f"""WITH {N}, h AS (SELECT 'part-'||p_partkey id, 'orders/'||(p_partkey%500)||'.md' authority FROM part UNION ALL SELECT 'supplier-'||s_suppkey, 'suppliers/'||(s_suppkey%10)||'.md' FROM supplier),
q AS (SELECT d.authority, e.src target, array_to_string(list_sort(list(DISTINCT e.rel)),',') relations, count(*) consumers FROM edges e JOIN h d ON d.id=e.dst JOIN h s ON s.id=e.src WHERE e.rel<>'contains' AND d.authority<>s.authority GROUP BY 1,2)
SELECT q.authority, q.target, relations, consumers, EXISTS (SELECT 1 FROM refs r WHERE r.authority=q.authority AND r.target=q.target) covered FROM q""")
def required_references(spark, sf):
    part, supplier = P.table(spark, sf, "part"), P.table(spark, sf, "supplier")
    homes = part.select(P.named("part", "p_partkey").alias("id"), F.concat(F.lit("orders/"), (F.col("p_partkey") % 500).cast("string"), F.lit(".md")).alias("authority")).unionByName(
        supplier.select(P.named("supplier", "s_suppkey").alias("id"), F.concat(F.lit("suppliers/"), (F.col("s_suppkey") % 10).cast("string"), F.lit(".md")).alias("authority"))
    )
    return audit.required_references(P.edges(spark, sf), P.references(spark, sf), homes)


def faulty(spark, sf):
    """The projection with faults: a part and a nation gone, a wrong taxonomy edge, a node and an edge twice."""
    nodes, edges = graph(spark, sf)
    nodes = nodes.where("id not in ('part-20', 'nation-3')").unionByName(nodes.where("id = 'part-21'"))
    wrong = spark.createDataFrame([("part-30", "contains", "region-1", "current"), ("part-30", "knows", "part-31", "current")], edges.schema)
    return nodes, edges.unionByName(wrong).unionByName(edges.where("rel = 'prerequisite-for' and src = 'part-33'"))


FAULTY = N + """, fn AS (SELECT * FROM nodes WHERE id NOT IN ('part-20','nation-3') UNION ALL SELECT * FROM nodes WHERE id='part-21'),
fe AS (SELECT * FROM edges UNION ALL VALUES ('part-30','contains','region-1','current'),('part-30','knows','part-31','current') UNION ALL SELECT * FROM edges WHERE rel='prerequisite-for' AND src='part-33')"""


@query(f"""WITH {FAULTY} SELECT 'error' severity, 'dangling-edge' code, src subject, src||' '||rel||' '||dst detail FROM fe WHERE src NOT IN (SELECT id FROM fn) UNION ALL SELECT 'error','dangling-edge',dst,src||' '||rel||' '||dst FROM fe WHERE dst NOT IN (SELECT id FROM fn)
UNION ALL SELECT 'warning','dangling-ref',target,authority||':'||line FROM refs WHERE target NOT IN (SELECT id FROM fn)""")
def check_dangling(spark, sf):
    return checks.dangling(*faulty(spark, sf), P.references(spark, sf))


@query(f"WITH {FAULTY} SELECT 'error' severity,'duplicate-node' code,id subject,count(*)::VARCHAR detail FROM fn GROUP BY id HAVING count(*)>1 UNION ALL SELECT 'error','duplicate-edge',src||' '||rel||' '||dst,count(*)::VARCHAR FROM fe GROUP BY src,rel,dst HAVING count(*)>1")
def check_duplicates(spark, sf):
    return checks.duplicates(*faulty(spark, sf))


@query(f"WITH {FAULTY} SELECT 'error' severity,'invalid-taxonomy-edge' code,src||' '||rel||' '||dst subject,a.typ||'>'||b.typ detail FROM fe JOIN fn a ON a.id=src JOIN fn b ON b.id=dst WHERE rel='contains' AND a.typ||'>'||b.typ NOT IN ('field>topic','field>knowledge','topic>knowledge')")
def check_taxonomy(spark, sf):
    return checks.taxonomy(*faulty(spark, sf))


@query(f"WITH {FAULTY} SELECT 'error' severity,'unknown-relation' code,src||' '||rel||' '||dst subject,rel detail FROM fe WHERE rel='knows' UNION ALL SELECT 'warning','stale-semantic-edge',src||' '||rel||' '||dst,'needs-review' FROM fe WHERE curation_status='needs-review'")
def check_relations(spark, sf):
    return checks.relations(faulty(spark, sf)[1])


@query(f"WITH {N}, {MEMBERS} SELECT 'error' severity,'unclassified-knowledge' code,id subject,label detail FROM nodes WHERE typ='knowledge' AND coalesce(active,false) AND id NOT IN (SELECT node FROM members)")
def check_unclassified(spark, sf):
    return checks.unclassified(*graph(spark, sf))


@query(f"WITH {N} SELECT 'warning' severity, CASE WHEN source_status='orphaned' THEN 'orphaned-node' ELSE 'stale-node-entry' END code, id subject, label detail FROM nodes WHERE typ='knowledge' AND (source_status='orphaned' OR curation_status='needs-review')")
def check_stale_nodes(spark, sf):
    return checks.stale_nodes(P.nodes(spark, sf))


@query("SELECT doc_id, length(text)-length(replace(text,chr(10),'')) line_breaks, length(substr(text,1,200))-length(replace(substr(text,1,200),chr(10),''))+1 line_at_200 FROM documents")
def line_numbers(spark, sf):
    text = F.col("text")
    return P.table(spark, sf, "documents").select("doc_id", (F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))).alias("line_breaks"), T.line_of(text, F.lit(200)).alias("line_at_200"))


@query(f"WITH {N} SELECT substr(sha256(authority||':'||line||':'||target||':'),1,20) id, authority, line, target FROM refs")
def reference_ids(spark, sf):
    return P.references(spark, sf).select(T.reference_id(F.col("authority"), F.col("line"), F.col("target"), F.lit("")).alias("id"), "authority", "line", "target")


@query("""SELECT 'pages/'||page_id||'.md' path, len(regexp_extract_all(html,'<a href="/[^"]+">[^<]+</a>')) n FROM pages WHERE len(regexp_extract_all(html,'<a href="/[^"]+">[^<]+</a>'))>0""")
def scan_references(spark, sf):
    return scan.scan(P.marked_pages(spark, sf)).where("role = 'reference'").groupBy("path").agg(F.count("*").alias("n"))


@query(r"""SELECT 'pages/'||page_id||'.md' path, trim(regexp_replace(regexp_replace(split_part(regexp_extract(html,'<h1>(.*?)</h1>',1),'|',1),'[*_`~$\\]','','g'),'\s+',' ','g'),' ,:;') label FROM pages WHERE regexp_matches(html,'<h1>.+?</h1>')""")
def scan_definitions(spark, sf):
    found = scan.scan(P.marked_pages(spark, sf))
    return scan.definitions(found, scan.identities(found)).select("path", "label")


@query()
def scan_contexts(spark, sf):
    found = scan.scan(P.marked_pages(spark, sf))
    return scan.references(found, scan.identities(found))


OLD, NEW = "o_orderdate < TIMESTAMP '1996-01-01'", "o_orderkey % 5 <> 0"


@query(f"""WITH a AS (SELECT o_orderkey, o_orderstatus s FROM orders WHERE {OLD}), b AS (SELECT o_orderkey, CASE WHEN o_orderkey%3=0 THEN 'X' ELSE o_orderstatus END s FROM orders WHERE {NEW})
SELECT coalesce(a.o_orderkey,b.o_orderkey) o_orderkey, CASE WHEN a.s IS NULL THEN 'added' WHEN b.s IS NULL THEN 'removed' ELSE 'updated' END status FROM a FULL JOIN b ON a.o_orderkey=b.o_orderkey WHERE a.s IS DISTINCT FROM b.s""")
def snapshot_diff(spark, sf):
    orders = P.table(spark, sf, "orders").select("o_orderkey", "o_orderdate", "o_orderstatus")
    new = orders.where(NEW).select("o_orderkey", F.when(F.col("o_orderkey") % 3 == 0, "X").otherwise(F.col("o_orderstatus")).alias("s"))
    return sync.diff(orders.where(OLD).select("o_orderkey", F.col("o_orderstatus").alias("s")), new, ["o_orderkey"])


DOCS = "a AS (SELECT 'old/'||doc_id path, sha256(text) digest FROM documents WHERE doc_id%3<>0 UNION ALL SELECT 'same/'||doc_id, sha256(text) FROM documents WHERE doc_id%3=0), b AS (SELECT 'new/'||doc_id path, sha256(text) digest FROM documents WHERE doc_id%3=1 UNION ALL SELECT 'same/'||doc_id, sha256(text||CASE WHEN doc_id%2=0 THEN '!' ELSE '' END) FROM documents WHERE doc_id%3=0)"


def versions(spark, sf):
    docs = P.table(spark, sf, "documents")
    digest, third = T.text_digest(F.col("text")), F.col("doc_id") % 3
    path = lambda p: F.concat(F.lit(p + "/"), F.col("doc_id").cast("string")).alias("path")
    same = docs.where(third == 0)
    old = docs.where(third != 0).select(path("old"), digest.alias("digest")).unionByName(same.select(path("same"), digest.alias("digest")))
    new = docs.where(third == 1).select(path("new"), digest.alias("digest")).unionByName(same.select(path("same"), T.text_digest(F.concat("text", F.when(F.col("doc_id") % 2 == 0, "!").otherwise(""))).alias("digest")))
    return old, new


@query(f"WITH {DOCS} SELECT coalesce(a.path,b.path) path, CASE WHEN a.path IS NULL THEN 'added' WHEN b.path IS NULL THEN 'deleted' ELSE 'modified' END status FROM a FULL JOIN b ON a.path=b.path WHERE a.digest IS DISTINCT FROM b.digest")
def source_changes(spark, sf):
    return sync.changes(*versions(spark, sf))


@query(f"WITH {DOCS}, g AS (SELECT digest, min(path) p FROM a WHERE path NOT IN (SELECT path FROM b) GROUP BY 1 HAVING count(*)=1), n AS (SELECT digest, min(path) p FROM b WHERE path NOT IN (SELECT path FROM a) GROUP BY 1 HAVING count(*)=1) SELECT g.p old_path, n.p new_path FROM g JOIN n USING (digest)")
def rename_pairs(spark, sf):
    return sync.renames(*versions(spark, sf))


@query("SELECT 'part-'||p_partkey id, CASE WHEN p_size<10 AND p_partkey%4=0 THEN 'orphaned' ELSE 'active' END source_status, NOT (p_size<10 AND p_partkey%4=0) active FROM part")
def orphan_nodes(spark, sf):
    part = P.table(spark, sf, "part")
    size = F.concat(F.lit("size/"), F.col("p_size").cast("string"))
    nodes = part.select(P.named("part", "p_partkey").alias("id"), size.alias("authority"), F.lit("active").alias("source_status"), F.lit(True).alias("active"))
    scanned = part.where("p_size < 10 and p_partkey % 4 <> 0").select(P.named("part", "p_partkey").alias("id"))
    return sync.orphans(nodes, scanned, part.where("p_size < 10").select(size.alias("path"))).select("id", "source_status", "active")


@query(f"""WITH {N}, e AS (SELECT *, CASE WHEN src LIKE '%7' THEN 'old' END sp FROM edges WHERE rel<>'contains'),
x AS (SELECT e.src, e.rel, e.dst, e.curation_status, (NOT coalesce(a.active,false) OR (sp IS NOT NULL AND sp<>a.label)) s, NOT coalesce(b.active,false) d FROM e JOIN nodes a ON a.id=e.src JOIN nodes b ON b.id=e.dst)
SELECT src, rel, dst, CASE WHEN s OR d THEN 'needs-review' ELSE curation_status END curation_status, CASE WHEN s AND d THEN least(src,dst)||','||greatest(src,dst) WHEN s THEN src WHEN d THEN dst ELSE '' END stale FROM x""")
def stale_edges(spark, sf):
    nodes, edges = graph(spark, sf)
    edges = edges.where("rel <> 'contains'").withColumns({"src_print": F.when(F.col("src").like("%7"), "old"), "dst_print": F.lit(None).cast("string")})
    return sync.edge_curation(edges, nodes.select("id", "active", F.col("label").alias("print"))).select("src", "rel", "dst", "curation_status", F.array_join("stale_endpoints", ",").alias("stale"))


@query(f"""WITH {N}, gone AS (SELECT id FROM nodes WHERE id LIKE 'supplier-%1' AND NOT coalesce(active,true)), put AS (SELECT 'part-'||p_partkey id FROM part WHERE p_partkey%50=0),
k AS (SELECT id, label, 'kept' what FROM nodes WHERE id NOT IN (FROM gone) AND id NOT IN (FROM put) UNION ALL SELECT id, 'Renamed', 'kept' FROM put)
SELECT id, label FROM k""")
def apply_delta(spark, sf):
    nodes, edges = graph(spark, sf)
    some = P.table(spark, sf, "part").where("p_partkey % 50 = 0").select(P.named("part", "p_partkey").alias("id"))
    put = some.select("id", F.lit("knowledge").alias("typ"), F.lit("First").alias("label"), F.lit(1).alias("n")).unionByName(some.select("id", F.lit("knowledge").alias("typ"), F.lit("Renamed").alias("label"), F.lit(2).alias("n")))
    none = edges.limit(0)
    return sync.apply_delta(nodes, edges, nodes.where("id like 'supplier-%1'"), put, none, none.withColumn("n", F.lit(0)))[0].select("id", "label")


def candidate(spark, sf):
    return P.table(spark, sf, "customer").select(F.concat(F.lit("supplier-"), F.col("c_custkey").cast("string")).alias("id"), F.regexp_replace(F.col("c_name"), "Customer", "SUPPLIER").alias("label"), F.array().cast("array<string>").alias("aliases"), F.lit(None).cast("string").alias("text"))


CANDIDATE = "c AS (SELECT 'supplier-'||c_custkey id, replace(c_name,'Customer','SUPPLIER') label FROM customer), t AS (SELECT 'supplier-'||s_suppkey id, s_name label FROM supplier WHERE s_suppkey%2=0)"
ALIGNED = CANDIDATE + """, f AS (SELECT c.id cand, t.id target, 1 way FROM c JOIN t ON c.id=t.id UNION SELECT c.id, t.id, 2 FROM c JOIN t ON lower(c.label)=lower(t.label)), b AS (SELECT * FROM f QUALIFY way=min(way) OVER (PARTITION BY cand)),
g AS (SELECT cand, min(target) target, count(*) n, min(way) way FROM b GROUP BY 1), al AS (SELECT c.id candidate, CASE WHEN n IS NULL THEN 'unmatched' WHEN n>1 THEN 'ambiguous' ELSE 'matched' END status, CASE way WHEN 1 THEN 'id' WHEN 2 THEN 'label' END via, CASE WHEN n=1 THEN target END target FROM c LEFT JOIN g ON g.cand=c.id)"""


def targets(spark, sf):
    return P.nodes(spark, sf).where("id like 'supplier-%' and cast(substring(id, 10) as int) % 2 = 0")


@query(f"WITH {ALIGNED} SELECT * FROM al")
def align_labels(spark, sf):
    return A.align(candidate(spark, sf), targets(spark, sf))


@query(f"WITH {N}, {ALIGNED}, ce AS (SELECT 'supplier-'||o_custkey src, 'implies' rel, 'supplier-'||(o_custkey%97) dst FROM orders GROUP BY ALL), te AS (SELECT 'supplier-'||s_suppkey src, 'implies' rel, 'supplier-'||(s_suppkey%97) dst FROM supplier WHERE s_suppkey%4=0) SELECT ce.src, ce.rel, ce.dst, CASE WHEN a.target IS NULL OR b.target IS NULL THEN 'unmatched' WHEN te.src IS NOT NULL THEN 'present' ELSE 'missing' END status FROM ce LEFT JOIN al a ON a.candidate=ce.src LEFT JOIN al b ON b.candidate=ce.dst LEFT JOIN te ON te.src=a.target AND te.rel=ce.rel AND te.dst=b.target")
def compare_edges(spark, sf):
    aligned = A.align(candidate(spark, sf), targets(spark, sf))
    edge = lambda df, key: df.select(P.named("supplier", key).alias("src"), F.lit("implies").alias("rel"), F.concat(F.lit("supplier-"), (F.col(key) % 97).cast("string")).alias("dst")).distinct()
    return A.compare(aligned, edge(P.table(spark, sf, "orders"), "o_custkey"), edge(P.table(spark, sf, "supplier").where("s_suppkey % 4 = 0"), "s_suppkey"))


def suppliers(spark, sf):
    return P.nodes(spark, sf).where("id like 'supplier-%'")


#: As ALIGNED, with every supplier as a target.
ALIGNED_ALL = ALIGNED.replace(" WHERE s_suppkey%2=0", "")
assert ALIGNED_ALL != ALIGNED


@query(f"WITH {ALIGNED_ALL} SELECT * FROM al")
def align_suppliers(spark, sf):
    return A.align(candidate(spark, sf), suppliers(spark, sf))


# Edges of suppliers in debt go elsewhere, so some are missing while every supplier has one.
@query(f"WITH {ALIGNED_ALL}, ce AS (SELECT 'supplier-'||o_custkey src, 'implies' rel, 'supplier-'||(o_custkey%97) dst FROM orders GROUP BY ALL), te AS (SELECT 'supplier-'||s_suppkey src, 'implies' rel, 'supplier-'||CASE WHEN s_acctbal<0 THEN (s_suppkey+1)%97 ELSE s_suppkey%97 END dst FROM supplier) SELECT ce.src, ce.rel, ce.dst, CASE WHEN a.target IS NULL OR b.target IS NULL THEN 'unmatched' WHEN te.src IS NOT NULL THEN 'present' ELSE 'missing' END status FROM ce LEFT JOIN al a ON a.candidate=ce.src LEFT JOIN al b ON b.candidate=ce.dst LEFT JOIN te ON te.src=a.target AND te.rel=ce.rel AND te.dst=b.target")
def compare_suppliers(spark, sf):
    aligned = A.align(candidate(spark, sf), suppliers(spark, sf))
    edge = lambda df, key, to: df.select(P.named("supplier", key).alias("src"), F.lit("implies").alias("rel"), F.concat(F.lit("supplier-"), (to % 97).cast("string")).alias("dst")).distinct()
    key = F.col("s_suppkey")
    return A.compare(aligned, edge(P.table(spark, sf, "orders"), "o_custkey", F.col("o_custkey")), edge(P.table(spark, sf, "supplier"), "s_suppkey", F.when(F.col("s_acctbal") < 0, key + 1).otherwise(key)))


@query()
def propose_additions(spark, sf):
    one, two = candidate(spark, sf), suppliers(spark, sf)
    return A.propose(one, A.align(one, two), A.candidates_ranked(one, two))


@query()
def scoped_aliases(spark, sf):
    docs = P.table(spark, sf, "documents").select(P.named("doc", "doc_id").alias("id"), F.lit(None).cast("string").alias("label"), "text")
    made = P.table(spark, sf, "part").select(P.named("part", "p_partkey").alias("id"), F.col("p_name").alias("label"), F.concat(F.lit("The "), F.initcap("p_name"), F.lit(" ("), T.acronym(F.col("p_name")), F.lit(") is sold.")).alias("text"))
    return A.scoped_aliases(docs.unionByName(made))


@query(f"WITH {SCORED}, l AS (SELECT 'lexical' lane, id, row_number() OVER (ORDER BY score DESC, id) AS rank FROM s WHERE score>0), m AS (SELECT 'size' lane, 'doc-'||doc_id id, row_number() OVER (ORDER BY n_chars DESC, doc_id) AS rank FROM documents), u AS (SELECT * FROM l WHERE rank<=100 UNION ALL SELECT * FROM m WHERE rank<=100) SELECT id, round(sum(1.0::DOUBLE/(60+rank)),12) score, string_agg(lane,',' ORDER BY lane) lanes FROM u GROUP BY id")
def rank_fusion(spark, sf):
    return fusion(spark, sf, 100)


@query(f"WITH {SCORED}, l AS (SELECT 'lexical' lane, id, row_number() OVER (ORDER BY score DESC, id) AS rank FROM s WHERE score>0), m AS (SELECT 'size' lane, 'doc-'||doc_id id, row_number() OVER (ORDER BY n_chars DESC, doc_id) AS rank FROM documents), u AS (SELECT * FROM l WHERE rank<={LANE} UNION ALL SELECT * FROM m WHERE rank<={LANE}) SELECT id, round(sum(1.0::DOUBLE/(60+rank)),12) score, string_agg(lane,',' ORDER BY lane) lanes FROM u GROUP BY id")
def rank_fusion_lanes(spark, sf):
    return fusion(spark, sf, LANE)


def fusion(spark, sf, most):
    """The lexical lane and the lane of sizes, ``most`` rows of each, fused."""
    docs = document_nodes(spark, sf)
    first = lookup.scores(docs, QUERY).select("id", "score").orderBy(F.desc("score"), "id").limit(most).withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "id")))
    size = P.table(spark, sf, "documents").orderBy(F.desc("n_chars"), "doc_id").limit(most).withColumn("rank", F.row_number().over(Window.orderBy(F.desc("n_chars"), "doc_id"))).select(P.named("doc", "doc_id").alias("id"), "rank")
    lanes = first.select(F.lit("lexical").alias("lane"), "id", "rank").unionByName(size.select(F.lit("size").alias("lane"), "id", "rank"))
    return fused(lanes).select("id", F.round("score", 12).alias("score"), "lanes")


@query()
def retrieval_plan(spark, sf):
    plan = Plan(question="which parts follow", identity_queries=[first_parts(policy.visible(*graph(spark, sf))[0])[0], "Supplier#000000003"], lexical_queries=["supplier#000000002 brand#12"], max_depth=1, limit=25)
    return execute(*graph(spark, sf), plan)[0].withColumn("score", F.round("score", 12))


@query(f"""WITH {N}, {MEMBERS}, p AS (SELECT unnest(['region-0','region-1','region-2']) id), s AS (SELECT id FROM p UNION SELECT node FROM members WHERE field IN (SELECT id FROM p) UNION SELECT dst FROM edges WHERE rel='contains' AND src IN (SELECT id FROM p)),
v AS (SELECT * FROM nodes WHERE id IN (SELECT id FROM s) AND coalesce(active,true) AND (typ<>'knowledge' OR curation_status<>'needs-review')) SELECT src, rel, dst FROM edges WHERE src IN (SELECT id FROM v) AND dst IN (SELECT id FROM v)""")
def public_view(spark, sf):
    published = spark.createDataFrame([(f"region-{k}",) for k in range(3)], "id string")
    return store.public_view(*graph(spark, sf), P.references(spark, sf), published)[1]


@query(f"WITH {N}, k AS (SELECT id, label, count(*) OVER (PARTITION BY lower(label)) n FROM nodes) SELECT id, CASE WHEN n>1 THEN replace(label,'#',' ')||'-'||substr(sha256(id),1,8) ELSE replace(label,'#',' ') END AS name FROM k")
def note_names(spark, sf):
    return store.unique_names(P.nodes(spark, sf))


@query("""WITH a AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END b FROM events), s AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY ts, event_id) k FROM a)
SELECT user_id, min(ts) AS start, count(*) n, round(sum(value),4) total FROM s GROUP BY user_id, k""")
def event_sessions(spark, sf):
    return sessions(P.table(spark, sf, "events")).withColumn("total", F.round("total", 4))


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
