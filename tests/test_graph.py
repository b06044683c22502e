"""Small literal graphs: the expectations of the survey's fixtures."""

import random

import pytest
from pyspark.sql import functions as F

from quillnet.functions import text as T
from quillnet.operators import align, audit, checks, lookup, scan, sync, traverse
from quillnet.operators.components import components, cycle_remainder
from quillnet.plans.retrieval import Plan, context, execute, simple_plan, size_of
from quillnet.sources import store

NODE = "id string, typ string, label string, text string, aliases array<string>, active boolean, source_status string, curation_status string"
EDGE = "src string, rel string, dst string, curation_status string"


@pytest.fixture(scope="module")
def graph(spark):
    nodes = spark.createDataFrame(
        [
            ("sigma-algebra", "knowledge", "Sigma Algebra", "A family closed under countable unions.", ["σ-algebra", "西格玛代数"], True, "active", "current"),
            ("measure", "knowledge", "Measure", "A countably additive set function.", ["测度"], None, "active", "current"),
            ("absolute-continuity", "knowledge", "Absolute Continuity", "Absolute continuity (AC) relates two measures.", [], True, "active", "current"),
        ],
        NODE,
    )
    edges = spark.createDataFrame([("sigma-algebra", "prerequisite-for", "measure", "current"), ("measure", "prerequisite-for", "absolute-continuity", "current")], EDGE)
    return nodes, edges


def test_resolve(spark, graph):
    asked = spark.createDataFrame(list(enumerate(["SIGMA ALGEBRA", "西格玛代数", "测度", "AC", "measure"])), "position int, concept string")
    assert [(r.status, r.matches) for r in lookup.resolve(graph[0], asked).orderBy("position").collect()] == [("exact", ["sigma-algebra"]), ("alias", ["sigma-algebra"]), ("alias", ["measure"]), ("missing", []), ("exact", ["measure"])]


def test_resolve_all(spark):
    nodes = spark.createDataFrame([(f"n{k:04}", "knowledge", f"N {k}", None, ["common"], True, None, None) for k in range(1200)], NODE)
    asked = spark.createDataFrame([(0, "Common"), (1, "n 7"), (2, "none")], "position int, concept string")
    rows = lookup.resolve_all(nodes, asked).collect()
    assert sorted(r.node for r in rows if r.position == 0) == [f"n{k:04}" for k in range(1200)]
    assert {(r.position, r.status) for r in rows} == {(0, "ambiguous"), (1, "exact"), (2, "missing")} and len(rows) == 1202


def test_search(graph):
    assert lookup.search(graph[0], "countably additive").first()["id"] == "measure"
    assert lookup.search_all_terms(graph[0], "").count() == 3


def test_expand_and_rank(graph):
    rows, edges = traverse.expand(*graph, ["sigma-algebra"], direction="out", depth=2)
    assert [r["id"] for r in rows] == ["sigma-algebra", "measure", "absolute-continuity"]
    assert len(edges) == 2 and rows[2]["root"] == "sigma-algebra" and len(rows[2]["path"]) == 2
    with pytest.raises(ValueError):
        traverse.expand(*graph, ["missing"])
    scores = {r["id"]: r["score"] for r in traverse.pagerank(*graph, {"sigma-algebra": 2.0, "measure": 0.0, "missing": 1.0}).collect()}
    assert abs(sum(scores.values()) - 1) < 1e-9 and scores["sigma-algebra"] > scores["measure"]
    loop = {r["id"]: r["score"] for r in traverse.pagerank(*graph, {"sigma-algebra": 2.0}, iterations=5, small=0).collect()}
    task = {r["id"]: r["score"] for r in traverse.pagerank(*graph, {"sigma-algebra": 2.0}, iterations=5).collect()}
    assert loop.keys() == task.keys() and all(abs(loop[k] - task[k]) < 1e-12 for k in task)


def first_owner(edges, seeds):
    """Breadth-first search one node at a time, seeds and neighbours by id."""
    owner = {s: s for s in sorted(seeds)}
    queue = list(owner)
    while queue:
        x = queue.pop(0)
        for y in sorted(v for u, v in edges if u == x):
            if y not in owner:
                owner[y] = owner[x]
                queue.append(y)
    return owner


def test_seed_owners(spark):
    rng = random.Random(5)
    ids = [f"n{k:02}" for k in range(40)]
    pairs = sorted({(rng.choice(ids), rng.choice(ids)) for _ in range(55)})
    nodes = spark.createDataFrame([(x,) for x in ids], "id string")
    edges = spark.createDataFrame([(u, "implies", v) for u, v in pairs], "src string, rel string, dst string")
    seeds = ["n31", "n04", "n17", "none"]
    want = first_owner(pairs, seeds[:3])
    for small in (0, 500_000):
        assert {r["id"]: r["seed"] for r in traverse.seed_owners(nodes, edges, seeds, small=small).collect()} == want


def test_files_and_courses(spark):
    rows = [("a", "x.md", "one", "said", True), ("b", "x.md", "two", " \n", True), ("c", "y.md", None, "said", True), ("d", "z.md", "", None, True), ("e", "z.md", "two", "said", None), ("f", None, "two", "", True)]
    nodes = spark.createDataFrame(rows, "id string, authority string, course string, text string, active boolean").withColumn("typ", F.lit("knowledge"))
    edges = spark.createDataFrame([("a", "implies", "b"), ("a", "implies", "c"), ("d", "implies", "a"), ("a", "implies", "e"), ("b", "contains", "f")], "src string, rel string, dst string")
    refs = spark.createDataFrame([("x.md",), ("x.md",), ("y.md",), ("gone.md",)], "authority string")
    assert {(r.authority, r.nodes, r.entries, r.state) for r in audit.file_coverage(nodes).collect()} == {("x.md", 2, 1, "partial"), ("y.md", 1, 1, "complete"), ("z.md", 1, 0, "pending"), ("", 1, 0, "pending")}
    assert audit.cross_course(nodes, edges).first()["n"] == 1
    assert {tuple(r) for r in audit.course_statistics(nodes, edges, refs).collect()} == {("one", 1, 1, 1.0, 1, 0, 2), ("two", 2, 0, 0.0, 1, 1, 0), ("unknown", 1, 1, 1.0, 1, 0, 1), ("", 1, 0, 0.0, 1, 0, 0)}
    none = nodes.limit(0)
    assert audit.file_coverage(none).isEmpty() and audit.course_statistics(none, edges, refs).isEmpty() and audit.cross_course(none, edges).first()["n"] == 0


def fifo(adjacent, seeds, depth, limit):
    """Breadth-first search one node at a time."""
    seen, queue, walked = {s: 0 for s in seeds}, list(seeds), set()
    while queue and len(seen) < limit:
        x = queue.pop(0)
        if seen[x] >= depth:
            continue
        for rel, far, way, edge in sorted(adjacent.get(x, [])):
            walked.add(edge)
            if far not in seen:
                seen[far] = seen[x] + 1
                queue.append(far)
                if len(seen) >= limit:
                    break
    return seen, walked


def test_expand_against_queue(spark):
    rng = random.Random(3)
    for _ in range(3):
        ids = [f"n{k}" for k in range(9)]
        edges = list({(rng.choice(ids), rng.choice(["implies", "derived-from"]), rng.choice(ids)) for _ in range(16)})
        adjacent = {}
        for s, r, d in edges:
            adjacent.setdefault(s, []).append((r, d, "out", (s, r, d)))
            adjacent.setdefault(d, []).append((r, s, "in", (s, r, d)))
        limit = rng.choice([3, 5, 9])
        want, walked = fifo(adjacent, ["n0", "n1"], 3, limit)
        nodes = spark.createDataFrame([(i, "knowledge", i.upper(), None, None, True, None, None) for i in ids], NODE)
        rows, got = traverse.expand(nodes, spark.createDataFrame([(*e, None) for e in edges], EDGE), ["n0", "n1"], depth=3, limit=limit)
        assert {r["id"]: r["depth"] for r in rows} == want
        assert set(got) == walked


def test_components_and_cycles(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(40) if k % 10] + [(3, 3)], "u long, v long")
    assert {r.node: r.component for r in components(edges).collect()} == {k: (k - 1) // 10 * 10 + 1 for k in range(1, 41)}
    assert components(edges.limit(0)).count() == 0
    arcs = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("z", "a")], "src string, dst string")
    assert cycle_remainder(arcs).count() == 3 and cycle_remainder(arcs.where("src <> 'c'")).count() == 0


def test_checks(spark, graph):
    nodes, edges = graph
    codes = {r.code for r in checks.validate(nodes, edges, spark.createDataFrame([("a.md", 1, "gone")], "authority string, line int, target string")).collect()}
    assert codes == {"dangling-ref", "unclassified-knowledge"}
    bad = nodes.unionByName(spark.createDataFrame([("Bad Id", "thing", "<script>", None, None, None, None, "odd")], NODE))
    assert {r.code for r in checks.node_form(bad).collect()} == {"invalid-node-id", "unknown-node-type", "unsafe-label-html", "invalid-curation-status"}


def test_edge_quality(spark):
    rows = [("a", "implies", "b", None, "0.5"), ("b", "implies", "c", " \t", ""), ("c", "derived-from", "d", "page 3", None), ("a", "contains", "d", None, None)]
    edges = spark.createDataFrame(rows, "src string, rel string, dst string, evidence string, confidence string")
    assert {r.counter: r.n for r in audit.edge_quality(edges).collect()} == {"missing-evidence": 2, "missing-confidence": 2}
    assert {r.counter: r.n for r in audit.edge_quality(edges.drop("confidence")).collect()} == {"missing-evidence": 2, "missing-confidence": 3}
    assert {r.n for r in audit.edge_quality(edges.limit(0)).collect()} == {0}


def test_scan(spark):
    files = spark.createDataFrame(
        [
            ("a.md", "**Definition.** --[[Sigma Algebra]]-- and [[measure|the measure]]\n\nnot \\[[this]] nor ![[that]]"),
            ("b.typ", '#definition("x")[A #kn[$sigma$-algebra] inside $[0,1)$] then #ref[measure space] #kn[open'),
            ("c.tex", "\\begin{lemma}\\kn{\\sigma-field} uses \\knref{measure}\\end{lemma}"),
            ("d.txt", "--[[no]]--"),
            ("e.md", None),
        ],
        "path string, content string",
    )
    found = scan.scan(files)
    names = scan.identities(found)
    assert {(r.id, r.kind, r.path) for r in scan.definitions(found, names).collect()} == {("sigma-algebra", "definition", "a.md"), ("sigma-algebra", "definition", "b.typ"), ("sigma-field", "lemma", "c.tex")}
    refs = {(r.target, r.context, r.line) for r in scan.references(found, names).collect()}
    assert refs == {("measure", "sigma-algebra", 1), ("measure-space", None, 1), ("measure", "sigma-field", 1)}
    assert {r.code for r in scan.scan_faults(found, names).collect()} == {"unclosed-marker", "duplicate-definition"}


def test_text(spark):
    assert T.new_id("μ-law") == "law" and T.new_id("测度").startswith("knowledge-") and T.keyed("Ω  Space") == "omega space"
    row = spark.createDataFrame([("Straße  ΑΒ", "a\r\nb\rc")], "a string, b string").select(T.fold("a").alias("f"), T.lf(F.col("b")).alias("l"), T.acronym(F.lit("graph data base")).alias("c")).first()
    assert tuple(row) == ("strasse αβ", "a\nb\nc", "GDB")
    assert T.glob_pattern("notes/**/*.md") == "^notes/(?:[^/]+/)*[^/]*\\.md$"


def test_scoped_aliases(graph):
    assert [(r.node, r.surface, r.expansion) for r in align.scoped_aliases(graph[0]).collect()] == [("absolute-continuity", "AC", "Absolute continuity")]


def test_plain_labels():
    assert T.strip_latex(r"  $\sigma$-\text{finite} \foo{x}, ") == "σ-finite x"
    assert T.strip_latex(r"\operatorname {ab}c\Omega*") == "abcΩ*" and T.strip_latex(r"a\b{c}") == "a c"
    assert T.strip_markdown(" <**Bold** `code` ~x~_y_> ") == "Bold code xy"
    assert T.strip_typst("#strong[Wide] $sigma$ #emph[pipe pi];") == "Wide σ pipe π"


def test_forms_of_introduction():
    told = lambda text: [(s, e) for s, e, _ in align.introduced(text)]
    assert told("We use QED (quantum electro dynamics) here.") == [("QED", "quantum electro dynamics")]
    assert told("LRU stands for least recently used - , and so on.") == [("LRU", "least recently used")]
    assert told("A write ahead log, abbreviated as WAL, helps.")[-1][0] == "WAL"
    assert told("no forms (here), not even (A) or (nothing at all)") == []


def test_diff_counts_nulls(spark):
    schema = "k long, a string, b string"
    old = spark.createDataFrame([(1, None, "x"), (2, None, None), (3, "x", "y"), (4, None, None)], schema)
    new = spark.createDataFrame([(1, "x", None), (2, None, None), (3, "x", "y"), (5, None, None)], schema)
    assert sorted(map(tuple, sync.diff(old, new, ["k"]).collect())) == [(1, "updated"), (4, "removed"), (5, "added")]


def test_delta_refuses(spark):
    nodes = spark.createDataFrame([("a", True), ("b", False), ("c", True)], "id string, active boolean")
    edge = "src string, rel string, dst string"
    edges = spark.createDataFrame([("a", "r", "b"), ("a", "r", "c")], edge)
    put = spark.createDataFrame([("c", "r", "b", 1), ("c", "r", "nowhere", 1), ("c", "r", "a", 1)], edge + ", n int")
    gone = spark.createDataFrame([("a",), ("b",)], "id string")
    out, left, refused = sync.apply_delta(nodes, edges, gone, nodes.limit(0).withColumn("n", F.lit(0)), edges.limit(0), put)
    assert sorted(r.id for r in out.collect()) == ["a", "c"]
    assert sorted(map(tuple, left.collect())) == [("a", "r", "c"), ("c", "r", "a")]
    assert sorted(map(tuple, refused.collect())) == [("edge", "c r b"), ("edge", "c r nowhere"), ("node", "a")]
    refs = spark.createDataFrame([(1, "b"), (2, "c"), (3, "unknown")], "n int, target string")
    assert sorted(r.n for r in sync.remaining_references(refs, nodes, out).collect()) == [2, 3]


def test_long_chain_is_peeled(spark):
    chain = spark.range(20_000).select(F.col("id").cast("string").alias("src"), (F.col("id") + 3).cast("string").alias("dst"))
    assert cycle_remainder(chain).count() == 0
    looped = chain.unionByName(spark.createDataFrame([("9", "3")], "src string, dst string"))
    for one_task in (500_000, 3):
        part = looped if one_task > 3 else looped.where("cast(src as int) < 20")
        assert sorted(map(tuple, cycle_remainder(part, one_task).collect())) == [("3", "6"), ("6", "9"), ("9", "3")]


def test_long_expansions():
    words = [c.lower() + "o" * 24 for c in "ABCDEFGHIJKLMNOP"]
    wide = "graph" + " " * 150 + "data" + "é " * 60 + "base"
    # A cut at 200 characters would start inside "xgraph" and fit "graph" to the G.
    cut = "xgraph" + " " * 186 + "data base"
    for text, short, long in ((" ".join(words), "ABCDEFGHIJKLMNOP", " ".join(words)), (wide, "GDB", wide), (cut, "GDB", cut)):
        assert [(s, e) for s, e, _ in align.introduced(f"It is so. {text} ({short}) is sold.")] == [(short, long)]


def test_align_order(spark, graph):
    one = spark.createDataFrame([("measure", "x", []), ("m2", "MEASURE", []), ("m3", "测度", []), ("m4", "none", []), ("m5", "Measure", [])], "id string, label string, aliases array<string>")
    maps = spark.createDataFrame([("m4", "sigma-algebra", "exact-match", "reviewed"), ("m5", "measure", "different-from", "reviewed")], "subject string, object string, predicate string, status string")
    got = {r.candidate: (r.status, r.via) for r in align.align(one, graph[0], maps).collect()}
    assert got == {"measure": ("matched", "id"), "m2": ("matched", "label"), "m3": ("matched", "alias"), "m4": ("matched", "mapping"), "m5": ("unmatched", None)}


def test_all_suppliers_are_targets(spark, sf):
    from quillnet.plans import queries as Q

    ids = {f"supplier-{r.s_suppkey}" for r in spark.read.parquet(f"{sf}/supplier.parquet").collect()}
    asked = {f"supplier-{r.c_custkey}" for r in spark.read.parquet(f"{sf}/customer.parquet").collect()}
    assert {r.candidate for r in Q.propose_additions(spark, sf).collect()} == asked - ids
    assert {r.candidate for r in Q.align_suppliers(spark, sf).where("status = 'matched'").collect()} == asked & ids


def join_rows(df):
    """Most rows that any join of an executed query has put out."""
    todo, most = [df._jdf.queryExecution().executedPlan()], 0
    while todo:
        node = todo.pop()
        kind = node.getClass().getSimpleName()
        if "Join" in kind:
            most = max(most, node.metrics().apply("numOutputRows").value())
        inner = [node.executedPlan()] if kind == "AdaptiveSparkPlanExec" else [node.plan()] if kind.endswith("QueryStageExec") else []
        todo += inner + [node.children().apply(k) for k in range(node.children().size())]
    return most


def test_ranking_makes_no_row_for_each_pair(spark):
    # Every candidate shares "supplier" with every target: 800,000 pairs.
    one = spark.range(2_000).select(F.format_string("c%d", "id").alias("id"), F.format_string("SUPPLIER#%06d", "id").alias("label"), F.array().cast("array<string>").alias("aliases"))
    two = spark.range(400).select(F.format_string("t%d", F.col("id") * 10).alias("id"), F.format_string("Supplier#%06d", F.col("id") * 10).alias("label"), F.array().cast("array<string>").alias("aliases"), F.lit(None).cast("string").alias("text"))
    ranked = align.candidates_ranked(one, two)
    got = {}
    for r in sorted(ranked.collect(), key=lambda r: r["rank"]):
        got.setdefault(r.candidate, []).append((r.score, r.target))
    others = sorted(f"t{k * 10}" for k in range(400))
    for k in range(2_000):
        own = [] if k % 10 else [f"t{k}"]
        assert got[f"c{k}"] == [(16, t) for t in own] + [(8, t) for t in [t for t in others if t not in own][: 10 - len(own)]]
    assert 0 < join_rows(ranked) <= 40_000


def test_ranking_of_common_tokens(spark):
    rng = random.Random(3)
    say = lambda n: " ".join(rng.choice("abcdefgh"[: rng.randint(1, 8)]) for _ in range(rng.randint(0, n)))
    one = [(f"c{k}", rng.choice([None, say(3), f"{say(2)} u{k % 9}"]), rng.choice([None, [], [say(2)]])) for k in range(60)]
    two = [(f"t{k}", rng.choice([None, say(3), f"{say(1)} u{k % 9}"]), rng.choice([None, [], [say(2)]]), rng.choice([None, say(6)])) for k in range(50)]
    words = lambda text: set((text or "").split())
    want = set()
    for node, label, aliases in one:
        asked = words(label) | words(" ".join(aliases or []))
        scores = [(-8 * len(asked & words(a)) - 6 * len(asked & words(" ".join(b or []))) - len(asked & words(c)), t) for t, a, b, c in two]
        want |= {(node, t, -s, k) for k, (s, t) in enumerate(sorted(x for x in scores if x[0])[:4], 1)}
    frames = spark.createDataFrame(one, "id string, label string, aliases array<string>"), spark.createDataFrame(two, "id string, label string, aliases array<string>, text string")
    # All tokens common, some, none; sets met by broadcast and by join.
    for common, hot in ((0, 3), (150, 2), (150, 100), (10**6, 100)):
        assert {tuple(r) for r in align.candidates_ranked(*frames, 4, common, hot).collect()} == want


def test_plan_and_context(graph):
    rows, state = execute(*graph, simple_plan("sigma algebra", max_depth=1))
    assert rows.orderBy(F.desc("priority"), F.desc("score")).first()["id"] == "sigma-algebra"
    assert set(state.values()) == {"enabled"}
    with pytest.raises(ValueError):
        Plan(question="")
    nodes = [{"id": "a", "text": "x" * 50}, {"id": "b", "text": "y" * 5000}, {"id": "c", "text": "z"}]
    bundle = context(nodes, [{"src": "a", "dst": "c"}, {"src": "a", "dst": "b"}], [{"target": "c"}], 300)
    assert [n["id"] for n in bundle["nodes"]] == ["a", "c"] and bundle["omitted"] == ["b"] and len(bundle["edges"]) == 1 and size_of(bundle) <= 300
    with pytest.raises(ValueError):
        context(nodes, [], [], 10)


def test_sync(spark):
    had = spark.createDataFrame([("a", "Old", ["x"], "1", "current"), ("b", "Same", None, "1", "current"), ("c", "P", None, "1", "pending")], "id string, label string, aliases array<string>, digest string, curation_status string")
    now = spark.createDataFrame([("a", "New", "1"), ("b", "Same", "2"), ("c", "P", "2"), ("d", "D", "1")], "id string, label string, digest string")
    got = {r.id: (r.label, r.aliases, r.curation_status) for r in sync.upsert(had, now).collect()}
    assert got == {"a": ("New", ["Old", "x"], "current"), "b": ("Same", [], "needs-review"), "c": ("P", [], "pending"), "d": ("D", [], "pending")}


def test_generations(spark, graph, tmp_path):
    nodes, edges = graph
    root = str(tmp_path / "store")
    first = store.commit(spark, root, {"nodes": nodes, "edges": edges})
    assert store.verify(spark, root) and store.current(spark, root) == first
    pinned = store.load(spark, root)
    more = lambda t: t | {"edges": t["edges"].where("src <> 'measure'")}
    second = store.apply_request(spark, root, "r1", more)
    assert second != first and store.apply_request(spark, root, "r1", more) == second
    assert pinned["edges"].count() == 2 and store.load(spark, root)["edges"].count() == 1
    broken = lambda t: t | {"nodes": t["nodes"].where("id <> 'measure'")}
    with pytest.raises(ValueError):
        store.apply_request(spark, root, "r2", broken, lambda t: checks.dangling(t["nodes"], t["edges"]))
    assert store.current(spark, root) == second


def test_fusion_takes_whole_lanes(spark, sf):
    from quillnet.plans import queries as Q

    n = spark.read.parquet(f"{sf}/documents.parquet").count()
    assert 100 < n <= 500 and Q.rank_fusion_lanes(spark, sf).where("lanes like '%size'").count() == n


def test_stream(spark, tmp_path):
    from quillnet.streaming.sync import start

    land, root = tmp_path / "land", str(tmp_path / "gen")
    land.mkdir()
    (land / "1.json").write_text('{"path":"a.md","content":"--[[One]]-- [[Two]]","ts":"2024-01-01T00:00:00Z"}\n' * 2)
    for k in (2, 3):
        start(spark, str(land), root, str(tmp_path / "cp")).awaitTermination()
        got = store.load(spark, root)
        assert {r.id for r in got["definitions"].collect()} == ({"one"} if k == 2 else {"one", "three"})
        (land / "2.json").write_text('{"path":"b.md","content":"--[[Three]]-- [[One]]","ts":"2024-01-01T01:00:00Z"}\n')
    assert {r.target for r in got["references"].collect()} == {"two", "one"}
