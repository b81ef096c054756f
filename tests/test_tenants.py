"""What two tenants have is never mixed."""

import pytest
from pyspark.sql import functions as F
from verimill.operators import analytics, claims, conflicts, governance, quality, retrieval


@pytest.fixture(scope="module")
def held(spark):
    rows = [(k, t, t, "Tax", "rate", v, c, "active") for k, (t, v, c) in enumerate([(1, "7", 0.9), (2, "19", 0.8), (2, "19", 0.7)])]
    return spark.createDataFrame(rows, "claim_id long, tenant_id long, document_id long, subject string, predicate string, object_value string, confidence double, status string").withColumn("valid_from", F.lit("2024-01-01").cast("date"))


def test_lint_and_topics(spark, held):
    docs = spark.createDataFrame([(1, "indexed"), (2, "indexed")], "document_id long, status string")
    assert claims.lint(claims.build_index(held, docs), held, F.lit("2024-02-01").cast("timestamp")).count() == 0
    both = held.withColumn("tenant_id", F.lit(1))
    assert [r.kind for r in claims.lint(claims.build_index(both, docs), both, F.lit("2024-02-01").cast("timestamp")).collect()] == ["contradiction"]
    got = {r.tenant_id: (r.claim_count, r.summary) for r in claims.synthesize_topics(held).collect()}
    assert got == {1: (1, "rate = 7"), 2: (2, "rate = 19; rate = 19")}


def test_similar_predicates_and_their_mapping(spark):
    rows = [(1, 1, "return flag"), (1, 2, "return flags"), (2, 3, "return flag"), (3, 4, "return flags")]
    c = spark.createDataFrame([(t, i, i, p, f"v{i}", 0.5, "active") for t, i, p in rows], "tenant_id long, claim_id long, document_id long, predicate string, object_value string, confidence double, status string")
    near = conflicts.similar_predicates(c)
    assert [(r.tenant_id, r.predicate_a, r.predicate_b) for r in near.collect()] == [(1, "return flag", "return flags")]
    changed = {r.claim_id: r.changed for r in claims.normalize_predicates(c, claims.propose_mapping(near)).collect()}
    assert changed == {1: False, 2: True, 3: False, 4: False}
    assert [(r.claim_a, r.claim_b) for r in conflicts.similar_claim_conflicts(c, near, 0.5).collect()] == [(1, 2)]


def test_title_search_finds_parts_of_words(spark):
    titles = ["Company policy", "accompany us", "other", "Company of another", "Company gone"]
    docs = spark.createDataFrame([(i, 2 if i == 3 else 1, t, "deleted" if i == 4 else "indexed", i) for i, t in enumerate(titles)], "document_id long, tenant_id long, title string, status string, created_at long")
    asked = spark.createDataFrame([(1, 1, "comp"), (2, 1, "company"), (3, 1, "any POL"), (4, 2, "comp"), (5, 1, ""), (6, 1, None), (7, 1, "100%")], "query_id long, tenant_id long, query_text string")
    got = sorted((r.query_id, r.rank, r.document_id) for r in retrieval.title_search(docs, asked).collect())
    assert got == [(1, 1, 1), (1, 2, 0), (2, 1, 1), (2, 2, 0), (3, 1, 0), (4, 1, 3)]


def test_quality_hotspots_and_stability(spark, held):
    docs = spark.createDataFrame([(1, 1, "s", "a", None, "indexed", "quarantined", 1, "/x"), (2, 2, "s", "b", 0.4, "quarantined", "published", 1, "f/x"), (3, 1, "s", "c", 0.9, "deleted", "published", 1, "f/y")], "document_id long, tenant_id long, source_id string, title string, quality_score double, status string, review_status string, chunk_count long, source_path string")
    sources = spark.createDataFrame([("s", 1, "S", "jira"), ("none", 2, "N", "jira")], "source_id string, tenant_id long, name string, source_type string")
    got = {r.tenant_id: (r.documents, r.avg_quality, r.low_quality, r.quarantined) for r in analytics.quality_by_source(docs, sources).collect()}
    assert got == {1: (1, None, 0, 1), 2: (1, 0.4, 1, 0)}
    edges = spark.createDataFrame([(1, 1, 1, 3, "resolved", 0.5), (2, 1, 1, 3, "resolved", 0.5), (3, 1, 2, 3, "new", 0.5), (4, 2, 2, 2, "new", 0.5)], "conflict_id long, tenant_id long, document_a_id long, document_b_id long, status string, confidence double")
    got = [(r.tenant_id, r["rank"], r.document_id, r.conflicts, r.unresolved) for r in analytics.hotspots(edges, docs, sources, 2).orderBy("tenant_id", "rank").collect()]
    assert got == [(1, 1, 3, 3, 1), (1, 2, 2, 1, 1), (2, 1, 2, 1, 1)]
    got = {r.tenant_id: (r.total, r.stability) for r in analytics.claim_stability(held, docs).collect()}
    assert got == {1: (1, 1.0), 2: (2, 1.0)}
    tree = {(r.source_id, r.folder): (r.documents, r.quarantined) for r in analytics.source_tree(sources, docs, edges).collect()}
    assert tree == {("s", None): (2, 1), ("s", "(root)"): (1, 1), ("s", "f"): (1, 0), ("none", None): (0, 0)}


def test_auto_resolve_takes_each_tenants_surest(spark):
    rows = [(t * 100 + i, t, "contradiction", "new", i / 100) for t in (1, 2) for i in range(5)]
    open_ = spark.createDataFrame(rows, "conflict_id long, tenant_id long, conflict_type string, status string, confidence double")
    verdicts = open_.select("conflict_id", F.lit("keep_a").alias("resolution"), F.lit(0.9).alias("confidence"))
    decided, stats = governance.auto_resolve(open_, verdicts, most=2)
    assert sorted(r.conflict_id for r in decided.collect()) == [103, 104, 203, 204]
    assert {r.tenant_id: r.auto_resolved for r in stats.collect()} == {1: 2, 2: 2}


def test_retention_follows_each_tenants_switch_and_days(spark):
    tenants = spark.createDataFrame([(1, 30, True), (2, None, True), (3, 30, False), (4, 30, None)], "tenant_id long, retention_days int, hard_delete_enabled boolean")
    now = F.expr("TIMESTAMP_NTZ '2024-06-30 00:00:00'")
    rows = [(t * 10 + k, t, status, day) for t in (1, 2, 3, 4, 5) for k, (status, day) in enumerate([("deleted", "2024-05-01"), ("deleted", "2024-06-20"), ("indexed", "2020-01-01"), ("deleted", "2023-01-01")])]
    docs = spark.createDataFrame(rows, "document_id long, tenant_id long, status string, d string").withColumn("created_at", F.col("d").cast("timestamp_ntz"))
    assert sorted(r.document_id for r in governance.retention_due(docs, tenants, now).collect()) == [10, 13, 23]


def test_duplicates_stay_in_their_tenant(spark):
    rows = [(1, 1, "h"), (2, 1, "h"), (3, 2, "h"), (4, 1, None), (5, 1, None), (6, 2, "g")] + [(n, 3, "many") for n in range(100, 400)]
    docs = spark.createDataFrame([(*r, "indexed") for r in rows] + [(7, 1, "h", "deleted")], "document_id long, tenant_id long, content_hash string, status string")
    got = {tuple(r) for r in quality.exact_duplicates(docs).collect()}
    assert got == {(1, 1, 2), (2, 1, 2), (4, 4, 2), (5, 4, 2)} | {(n, 100, 300) for n in range(100, 400)}
    pairs = {(r.document_a_id, r.document_b_id) for r in conflicts.duplicate_conflicts(docs).collect()}
    assert pairs == {(2, 1)} | {(a, b) for a in range(100, 400) for b in range(100, min(a, 105))}
