"""Golden values and plans of operators."""

import datetime
import random

import pytest
from pyspark.sql import functions as F
from verimill.operators import analytics, claims, conflicts, evaluation, filters, governance, graph, quality, retrieval, versions


def test_checks_of_a_document(spark):
    docs = spark.createDataFrame([(1, "", "t"), (2, "hi", "t"), (3, "x" * 30, "t"), (4, "x" * 100, None), (5, "same\n" * 20, "t")], "document_id long, text string, title string")
    chunks = spark.createDataFrame([(4, "word " * 30, True), (4, "w", False)], "document_id long, chunk_text string, embedded boolean")
    got = {}
    for r in quality.quality_findings(docs, chunks).collect():
        got.setdefault(r.document_id, set()).add(r.finding_type)
    assert got == {1: {"empty_content", "extremely_short_content"}, 2: {"extremely_short_content"}, 3: {"short_content"}, 4: {"no_title", "embedding_failures", "too_many_tiny_chunks"}, 5: {"high_boilerplate"}}


@pytest.mark.parametrize(
    "penalties,score,decision",
    [([], 1.0, "published"), ([("warning", 0.1)], 0.9, "published"), ([("warning", 0.15)] * 3, 0.55, "published_with_warnings"), ([("critical", 0.5)], 0.5, "needs_review"), ([("critical", 0.5), ("critical", 0.3)], 0.2, "quarantined"), ([("critical", 2.0)], 0.0, "quarantined")],
)
def test_score(spark, penalties, score, decision):
    docs = spark.createDataFrame([(1,)], "document_id long")
    f = spark.createDataFrame([(1, "x", s, p) for s, p in penalties], "document_id long, finding_type string, severity string, penalty double")
    r = quality.score(docs, f).first()
    assert (r.quality_score, r.review_status) == (score, decision)


def test_schema(spark):
    docs = spark.createDataFrame([(1, "skill", {"name": "n", "description": "d", "version": "x", "owner": "o", "executor": "e", "ampel": "a"}, "Zweck SOP DoD"), (2, None, {"type": "Skill"}, "nothing"), (3, "unknown", {}, "x")], "document_id long, doc_type string, frontmatter map<string,string>, content string")
    f = quality.schema_findings(docs, quality.schema_rules(spark))
    assert [(r.check, r.what) for r in f.filter("document_id = 1").collect()] == [("invalid_version", "version")]
    s = {r.document_id: (r.penalty, r.valid) for r in quality.schema_scores(f).collect()}
    assert s == {1: (0.05, True), 2: (0.5, False)}


@pytest.mark.parametrize("hits,answerable,sources", [([], False, 0), ([("a", 0.03), ("b", 0.02), ("c", 0.01)], True, 3), ([("a", 0.001)], False, 1)])
def test_confidence(spark, hits, answerable, sources):
    run = spark.createDataFrame([(1, d, s) for d, s in hits], "query_id long, document_id string, score double")
    r = retrieval.confidence(run, spark.createDataFrame([(1,)], "query_id long")).first()
    assert (r.answerable, r.source_count) == (answerable, sources)
    assert 0 <= r.retrieval_confidence <= 1


def test_metrics(spark):
    run = spark.createDataFrame([(1, "a", 1), (1, "x", 2), (2, "x", 1), (2, "b", 2), (3, "x", 1)], "query_id long, document_id string, rank int")
    gold = spark.createDataFrame([(1, "a", 3.0), (1, "b", 1.0), (2, "b", 1.0), (3, "a", 1.0)], "query_id long, document_id string, grade double")
    got = {r.query_id: r for r in evaluation.query_metrics(run, gold, 2).collect()}
    assert (got[1].recall, got[1].precision, got[1].mrr) == (0.5, 0.5, 1.0)
    assert got[2].mrr == 0.5 and got[3].mrr == 0.0 and not got[3].answerable
    ideal = spark.createDataFrame([(1, "a", 1), (1, "b", 2)], "query_id long, document_id string, rank int")
    swapped = spark.createDataFrame([(1, "b", 1), (1, "a", 2)], "query_id long, document_id string, rank int")
    graded = lambda r: evaluation.query_metrics(r, gold, 2, graded=True).filter("query_id = 1").first().ndcg
    assert graded(ideal) == 1.0 > graded(swapped)


def test_tiering(spark):
    now = F.expr("TIMESTAMP_NTZ '2024-06-01 00:00:00'")
    t = lambda d: datetime.datetime(2024, 6, 1) - datetime.timedelta(days=d) if d is not None else None
    docs = [(1, 0.2, "hot", 0, t(91)), (2, 0.2, "hot", 0, t(90)), (3, 0.6, "hot", 0, t(31)), (4, 0.6, "hot", 0, t(30)), (5, 0.9, "cold", 6, t(6)), (6, 0.9, "cold", 5, t(6)), (7, 0.2, "hot", 9, None), (8, None, "hot", 0, None)]
    df = spark.createDataFrame([(*d, "indexed") for d in docs], "document_id long, quality_score double, index_tier string, access_count int, last_accessed_at timestamp_ntz, status string")
    got = {r.document_id: r.new_tier for r in governance.tier_sweep(df, now).collect()}
    assert got == {1: "cold", 2: "warm", 3: "warm", 4: "hot", 5: "hot", 6: "cold", 7: "cold", 8: "hot"}


def test_claims(spark):
    replies = [(1, '```json\n[{"subject": "A", "predicate": "is", "object_value": "b"}, {"subject": "", "predicate": "x", "object_value": "y"}]\n```'), (2, "no list"), (3, '[{"subject": "A", "predicate": "is", "object_value": "c", "confidence": 0.9}, {"subject": "B", "pre')]
    got = {(r.reply_id, r.object_value, r.confidence) for r in claims.parse_claims(spark.createDataFrame(replies, "reply_id long, raw string")).collect()}
    assert got == {(1, "b", 0.5), (3, "c", 0.9)}


def test_lint_gap(spark):
    index = spark.createDataFrame([(1, s, p, "v") for s in "abc" for p in ("x", "y")] + [(1, "d", "x", "v")] + [(2, "e", "z", "v")], "tenant_id long, subject_normalized string, predicate_normalized string, value string")
    none = spark.createDataFrame([], "tenant_id long, subject string, predicate string, object_value string, status string, valid_from date")
    got = claims.lint(index, none, F.lit("2024-01-01").cast("timestamp_ntz")).filter("kind = 'gap'").collect()
    assert [(r.subject, r.predicate) for r in got] == [("d", "y")]


def test_resolution_precedence(spark):
    c = spark.createDataFrame([(1, 10, 20), (2, 20, 30)], "conflict_id long, document_a_id long, document_b_id long")
    d = spark.createDataFrame([(1, "keep_a"), (2, "reject_both")], "conflict_id long, resolution string")
    assert {tuple(r) for r in governance.document_states(c, d).collect()} == {(20, "rejected"), (30, "rejected")}


def test_line_changes_count_repeats(spark):
    """A last line without an end isn't the line that has one."""
    v = spark.createDataFrame([(1, 1, "a\na\nb\n"), (1, 2, "a\nb\nc\nc\n"), (2, 1, "a\na\nb"), (2, 2, "a\nb\nc\nc")], "document_id long, version long, content_snapshot string")
    got = {r.document_id: (r.added, r.removed) for r in versions.line_changes(versions.version_pairs(v)).collect()}
    assert got == {1: (2, 1), 2: (3, 2)}


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_disjunctive_join_is_an_equi_join(spark):
    c = spark.createDataFrame([(1, 1, 2)], "conflict_id long, document_a_id long, document_b_id long")
    d = spark.createDataFrame([(1,), (2,)], "document_id long")
    joined = d.join(analytics.by_document(c), "document_id")
    assert "NestedLoop" not in plan(joined)
    assert joined.count() == 2


def test_top_k_is_cut_before_the_shuffle(spark):
    df = spark.range(100).select((F.col("id") % 3).alias("k"), "id")
    assert "WindowGroupLimit" in plan(retrieval.ranked(df, ["k"], F.asc("id"), most=2))


def test_similar_predicates_have_no_cross_join(spark):
    c = spark.createDataFrame([(1, "return flag of part"), (1, "return flags of part"), (1, "other thing"), (2, "return flag of parts")], "tenant_id long, predicate string")
    df = conflicts.similar_predicates(c, 0.45)
    assert "NestedLoop" not in plan(df) and "Cartesian" not in plan(df)
    assert [(r.predicate_a, r.predicate_b) for r in df.collect()] == [("return flag of part", "return flags of part")]


def test_bucketed_neighbours_reach_the_exact_ones(spark):
    v = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").select(F.col("vec_id").alias("document_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    left = v.filter("document_id % 5 = 0")
    exact, near = conflicts.knn_join(left, v), conflicts.knn_join(left, v, planes=4)
    assert exact.join(near, ["left_id", "right_id"], "left_semi").count() / exact.count() >= 0.9


def small_corpus(spark):
    docs = spark.createDataFrame([(i, i % 2, "indexed", "published") for i in range(8)], "document_id long, tenant_id long, status string, review_status string")
    vectors = spark.createDataFrame([(i, [1.0, float(i)]) for i in range(8)], "document_id long, embedding array<double>")
    postings = spark.createDataFrame([(i, i, i % 2, w, 1) for i in range(8) for w in ("red", "fox")], "chunk_id long, document_id long, tenant_id long, term string, tf long")
    queries = spark.createDataFrame([(100 + t, t, "Red fox", [1.0, 1.0], 7) for t in (0, 1, 2)], "query_id long, tenant_id long, query_text string, embedding array<double>, principal_id long")
    return docs, vectors, postings, queries


def test_search_stays_inside_the_tenant_and_its_access_lists(spark):
    docs, vectors, postings, queries = small_corpus(spark)
    got = retrieval.hybrid_search(docs, vectors, postings, queries).collect()
    assert {r.query_id for r in got} == {100, 101}
    assert all(r.document_id % 2 == r.query_id - 100 and r.lexical_rank and r.semantic_rank for r in got) and len(got) == 8
    acl = spark.createDataFrame([(0, 7, "read"), (2, 8, "read"), (4, 7, "none"), (1, 8, "admin")], "document_id long, principal_id long, permission string")
    seen = {r.document_id for r in retrieval.hybrid_search(docs, vectors, postings, queries, acl=acl).collect()}
    assert seen == {0, 3, 5, 6, 7}
    index = spark.createDataFrame([(t, "s", "color of fox", "S", f"P{t}", "red", 0.9) for t in (0, 1)], "tenant_id long, subject_normalized string, predicate_normalized string, subject string, predicate string, value string, confidence double")
    asked = spark.createDataFrame([(1, 0, "color fox"), (2, 1, "fox"), (3, 2, "fox")], "query_id long, tenant_id long, query_text string")
    assert {(r.query_id, r.predicate) for r in retrieval.index_lookup(index, asked).collect()} == {(1, "P0"), (2, "P1")}


def test_a_batch_over_the_broadcast_limit_is_dealt_to_blocks(spark, monkeypatch):
    docs, vectors, _, queries = small_corpus(spark)
    rows = vectors.join(docs.select("document_id", "tenant_id"), "document_id")
    want = sorted(map(tuple, retrieval.semantic_distances(rows, queries).collect()))
    near = sorted(map(tuple, conflicts.knn_join(vectors, vectors).collect()))
    monkeypatch.setattr(retrieval, "BATCH_ROWS", 1)
    df = conflicts.knn_join(vectors, vectors)
    assert "Cartesian" not in plan(df) and "NestedLoop" not in plan(df)
    assert sorted(map(tuple, df.collect())) == near
    assert sorted(map(tuple, retrieval.semantic_distances(rows, queries).collect())) == want


def test_open_documents_are_one_row_each(spark):
    docs = spark.range(6).withColumnRenamed("id", "document_id")
    acl = spark.createDataFrame([(0, 1, "read"), (1, 2, "none"), (9, 1, "read"), (2, 3, "write")], "document_id long, principal_id long, permission string")
    got = {tuple(r) for r in filters.acl_visible(docs, acl, acl.filter("principal_id < 3")).collect()}
    assert got == {(None, 3), (None, 4), (None, 5), (1, 0)}


def test_similar_predicates_against_all_pairs(spark):
    rng = random.Random(3)
    names = sorted({" ".join(rng.choice(["return", "flag", "flags", "of", "the", "part", "parts", "é"]) for _ in range(rng.randint(1, 5))) for _ in range(120)})

    def grams(t):
        return {f"  {w} "[i : i + 3] for w in t.split() for i in range(len(w) + 1)}

    for least in (0.3, 0.45, 0.8):
        want = {(a, b) for a in names for b in names if a < b and round(len(grams(a) & grams(b)) / len(grams(a) | grams(b)), 6) > least}
        got = {(r.predicate_a, r.predicate_b) for r in conflicts.similar_predicates(spark.createDataFrame([(1, n) for n in names], "tenant_id long, predicate string"), least).collect()}
        assert got == want


def test_one_title_head_in_many_titles_pairs_only_what_matches(spark):
    """20,000 titles begin alike; those whose whole start another one has are met, and nothing else."""
    n = 20_000
    rows = spark.range(n).select(F.col("id").alias("document_id"), F.lit(1).alias("tenant_id"), F.concat(F.lit("The "), F.sha2(F.col("id").cast("string"), 256)).alias("title"), F.lit("indexed").alias("status"), F.timestamp_seconds("id").alias("created_at"))
    more = spark.createDataFrame([(n, "A guide to foxes"), (n + 1, "A guide to foxes, second edition")], "document_id long, title string").select("document_id", F.lit(1).alias("tenant_id"), "title", F.lit("indexed").alias("status"), F.timestamp_seconds("document_id").alias("created_at"))
    got = conflicts.supersession_conflicts(rows.unionByName(more)).collect()
    assert {(r.document_a_id, r.document_b_id) for r in got} == {(n, n + 1)}


@pytest.mark.parametrize("hot", [0, 1, 3, 1_000])
def test_chunk_overlap_against_all_pairs(spark, monkeypatch, hot):
    """Common chunk hashes meet by sets, rare ones by documents; repeated chunks, two tenants, and hashes that few documents hold."""
    monkeypatch.setattr(conflicts, "HOT_CHUNK", hot)
    rng = random.Random(6)
    held = {d: [rng.choice("hhffabcdefgijklmnop") for _ in range(rng.randint(0, 6))] for d in range(60)}
    docs = spark.createDataFrame([(d, d % 2, f"c{d}", max(len(c), 1), "indexed") for d, c in held.items()], "document_id long, tenant_id long, content_hash string, chunk_count long, status string")
    chunks = spark.createDataFrame([(d, d % 2, h) for d, c in held.items() for h in c], "document_id long, tenant_id long, chunk_hash string")
    want = set()
    for a in held:
        met = sorted((-sum(h in held[a] for h in held[b]), b) for b in held if a != b and a % 2 == b % 2)
        want |= {(a, b, -n, i + 1) for i, (n, b) in enumerate(x for x in met if x[0] < -1) if i < 5}
    got = conflicts.chunk_overlap(chunks, docs).collect()
    assert {(r.document_a_id, r.document_b_id, r.shared, r["rank"]) for r in got} == want and len(got) == len(want)


def test_one_chunk_and_one_predicate_in_many_documents(spark):
    """20,000 documents with one header and footer, and as many values of one predicate: no pair of all with all is made."""
    n = 20_000
    docs = spark.range(n).select(F.col("id").alias("document_id"), F.lit(1).alias("tenant_id"), F.col("id").alias("content_hash"), F.lit(3).alias("chunk_count"), F.lit("indexed").alias("status"))
    chunks = docs.select("document_id", "tenant_id", F.explode(F.array(F.lit("head"), F.lit("foot"), F.col("document_id").cast("string"))).alias("chunk_hash"))
    got = conflicts.chunk_overlap(chunks, docs)
    assert got.count() == 5 * n and got.filter("shared <> 2").count() == 0
    assert [r.document_b_id for r in got.filter("document_a_id = 2").orderBy("rank").collect()] == [0, 1, 3, 4, 5]
    claims_of = spark.range(n).select(F.lit(1).alias("tenant_id"), F.col("id").alias("document_id"), F.col("id").alias("claim_id"), F.lit("s").alias("subject"), F.lit("Owner").alias("predicate"), F.col("id").cast("string").alias("object_value"), (1 / (F.col("id") + 1)).alias("confidence"), F.lit("active").alias("status"))
    star = conflicts.claim_conflicts(claims_of)
    assert star.count() == n - 1 and star.filter(f"claim_a <> 0 OR variants <> {n}").count() == 0
    links = graph.claim_links(claims_of)
    assert links.count() == n and links.filter(f"agreeing <> 0 OR contradicting <> {n - 1}").count() == 0


def test_claim_links_count_what_edges_list(spark):
    rng = random.Random(8)
    rows = [(i % 2, rng.randint(0, 12), i, rng.choice(["p", " P", "q"]), rng.choice(["x", "X ", "y", None]), "active") for i in range(80)]
    df = spark.createDataFrame(rows, "tenant_id long, document_id long, claim_id long, predicate string, object_value string, status string")
    seen = {(t, p.strip().lower(), x.strip().lower(), d) for t, d, _, p, x, _ in rows if x is not None}
    want = {(*r, min(o[3] for o in seen if o[:3] == r[:3]), sum(o[:3] == r[:3] for o in seen) - 1, sum(o[:2] == r[:2] and o[2] != r[2] and o[3] != r[3] for o in seen)) for r in seen}
    assert {tuple(r) for r in graph.claim_links(df).collect()} == want


@pytest.mark.parametrize("stretch", [1, 7, 20_000])
def test_admission_in_stretches_is_that_of_the_whole(spark, monkeypatch, stretch):
    from verimill.streaming.admission import admit

    monkeypatch.setattr(governance, "STRETCH_ROWS", stretch)
    rng = random.Random(4)
    at, rows = 0, []
    for i in range(200):
        at += rng.choice([1, 2, 5, 61, 200])
        rows.append((1, i, datetime.datetime(2024, 1, 1) + datetime.timedelta(seconds=at)))
    want, _ = admit([r[2].timestamp() for r in rows], [], 3, 60)
    df = spark.createDataFrame(rows, "tenant_id long, request_id long, at timestamp_ntz")
    got = {r.request_id: r.accepted for r in governance.admitted(df, 3).collect()}
    assert [got[i] for i in range(200)] == list(want)


def test_rich_text_of_any_depth(spark):
    from verimill.sources import feeds

    node = '{"type": "text", "text": "deep"}'
    for _ in range(12):
        node = '{"type": "list", "content": [' + node + "]}"
    got = feeds.flatten_tree(spark.createDataFrame([(1, node)], "k long, tree string"), "k", "tree").first()
    assert (got["text"], got["too_deep"]) == ("deep", 0)


def test_support_decides_what_else_is_equal(spark):
    docs = spark.createDataFrame([(i, "2024-01-01", "same", 1) for i in (1, 2, 3)], "document_id long, created_at string, text string, authority int").withColumn("created_at", F.col("created_at").cast("timestamp"))
    claims = spark.createDataFrame([(0, 2, "Owner ", "Ann", "active"), (0, 3, "owner", "ann", "active"), (0, 1, "owner", "Bob", "active"), (0, 1, "owner", "ann", "superseded"), (1, 1, "owner", "ann", "active")], "tenant_id long, document_id long, predicate string, object_value string, status string")
    support = governance.claim_support(claims)
    assert {tuple(r) for r in support.collect()} == {(2, 1), (3, 1)}
    met = spark.createDataFrame([(1, 3, 2), (2, 2, 2), (3, 1, 2)], "conflict_id long, document_a_id long, document_b_id long")
    assert {tuple(r) for r in governance.heuristic_verdicts(met, docs, support).collect()} == {(1, "keep_both", 0.5), (2, "keep_both", 0.5), (3, "keep_b", 0.55)}


def test_erasure_takes_what_documents_own(spark):
    docs = spark.createDataFrame([(1, 3), (2, 4)], "document_id long, tenant_id long")
    owned = spark.createDataFrame([(1, "a"), (2, "b"), (None, "c")], "document_id long, note string")
    left = governance.erase_tenant({"docs": docs, "owned": owned, "free": owned.select("note")}, 3, {"document_id": docs})
    assert [r.document_id for r in left["docs"].collect()] == [2]
    assert {r.note for r in left["owned"].collect()} == {"b", "c"} and left["free"].count() == 3


def test_evidence_groups_versions_and_flags_conflicts(spark):
    docs = spark.createDataFrame([(1, "h1", "s", "T", 1, 0.9), (2, "h2", "s", "T", 2, 0.9), (3, "h2", "s", "U", 1, 0.9), (4, "h4", "r", "V", 1, None), (5, "h5", "r", "W", 1, 0.1)], "document_id long, content_hash string, source_id string, title string, version long, quality_score double")
    results = spark.createDataFrame([(7, d, d) for d in range(1, 6)], "query_id long, document_id long, rank long")
    conflicts = spark.createDataFrame([(4, 2, "new"), (1, 4, "new"), (2, 2, "new")], "document_a_id long, document_b_id long, status string")
    got = {(r.document_id, r.versions, r.conflicting) for r in retrieval.evidence(results, docs, conflicts).collect()}
    assert got == {(2, 2, True), (4, 1, True)}
    assert retrieval.evidence(results.limit(0), docs, conflicts).count() == 0


def test_title_search_is_literal_and_shares_equal_queries(spark):
    docs = spark.createDataFrame([(i, 0, f"100% Wool {i}", "indexed", 0.5, i) for i in range(30)] + [(99, 1, "100% wool", "indexed", 0.5, 99), (98, 0, None, "indexed", 0.5, 98)], "document_id long, tenant_id long, title string, status string, quality_score double, created_at long")
    queries = spark.createDataFrame([(1, 0, "0% WOOL"), (2, 0, "0% wool"), (3, 0, "1_0"), (4, 0, ""), (5, 0, None), (6, 1, "wo")], "query_id long, tenant_id long, query_text string")
    rows = retrieval.answer_documents(queries, docs).collect()
    of = lambda q: [r.document_id for r in sorted(rows, key=lambda r: r["rank"]) if r.query_id == q]
    assert of(1) == of(2) == list(range(29, 19, -1)) and of(6) == [99] and not of(3) + of(4) + of(5)


def test_one_predicate_of_very_many_claims(spark):
    """A cluster's row doesn't grow with its claims."""
    n = 20_000
    rows = spark.range(n).select(F.lit(0).alias("tenant_id"), F.col("id").alias("document_id"), F.col("id").alias("claim_id"), F.lit("s").alias("subject"), F.lit("Owner").alias("predicate"), (F.col("id") % 3).cast("string").alias("object_value"), (1 / (F.col("id") + 1)).alias("confidence"), F.lit("active").alias("status"))
    docs = spark.range(n).select(F.col("id").alias("document_id"), F.lit("indexed").alias("status"), F.lit("t").alias("title"))
    assert [tuple(r) for r in claims.claim_clusters(rows, docs).collect()] == [(0, "owner", 3, n, 0, "0")]
    assert claims.cluster_members(rows, docs).count() == n
    assert [tuple(r)[5:] for r in claims.build_index(rows, docs).collect()] == [("0", 1.0, n, n)]


def test_export_writes_a_folder_a_tenant(spark, tmp_path):
    from verimill.sources import feeds

    docs = spark.createDataFrame([(1, 3, "a"), (2, 4, None)], "document_id long, tenant_id long, title string")
    feeds.export_tenants({"docs": docs}, str(tmp_path))
    assert {tuple(r) for r in spark.read.json(str(tmp_path / "docs")).select("document_id", "tenant_id", "title").collect()} == {(1, 3, "a"), (2, 4, None)}


def test_only_searched_queries_show_documents(spark):
    q = spark.createDataFrame([(1, "How many documents are there?"), (2, "What does the travel policy say about trains?")], "query_id long, query_text string")
    kinds = {r.query_id: r.query_type for r in retrieval.route(q).collect()}
    found = lambda rag: rag.select("query_id", F.explode(F.sequence(F.lit(1), F.lit(12))).alias("rank")).withColumn("document_id", F.col("rank") * 10)
    got = {(r.query_id, r.document_id, r["rank"]) for r in retrieval.searched(q, found).collect()}
    assert kinds == {1: "structured", 2: "rag"}
    assert got == {(2, k * 10, k) for k in range(1, 11)}
