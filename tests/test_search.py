"""Block maxima against plain scores, the vector index against exact neighbours."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from verimill.operators import blocks, conflicts, graph, postings, retrieval, vectors
from verimill.operators.conflicts import checkpointed


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(10)
    words = [f"w{min(int(rng.paretovariate(0.8)), 60)}" for _ in range(30_000)]
    rows = [(c, c // 3, (c // 3) % 2, " ".join(rng.choice(words) for _ in range(rng.randrange(3, 40)))) for c in range(900)]
    chunks = spark.createDataFrame(rows, "chunk_id long, document_id long, tenant_id long, chunk_text string")
    found = chunks.select("chunk_id", "document_id", "tenant_id", F.explode(F.split("chunk_text", " ")).alias("term")).groupBy("chunk_id", "document_id", "tenant_id", "term").agg(F.count("*").alias("tf"))
    queries = [(q, q % 2, " ".join(f"W{rng.randrange(1, 8)}" for _ in range(rng.randrange(1, 4)))) for q in range(30)] + [(98, 0, None), (99, 0, "..."), (97, 1, "w1 absent"), (96, 5, "w1")]
    return checkpointed(found), spark.createDataFrame(queries, "query_id long, tenant_id long, query_text string")


@pytest.mark.parametrize("most,size", [(5, 8), (60, 8), (1000, 500)])
def test_block_maxima_lose_nothing(spark, corpus, most, size):
    found, queries = corpus
    plain = retrieval.lexical_scores(found, queries).groupBy("query_id", "document_id").agg(F.round(F.max("score"), 9).alias("score"))
    want = {(r.query_id, r["rank"]): (r.document_id, round(r.score, 7)) for r in retrieval.ranked(plain, ["query_id"], F.desc("score"), F.asc("document_id"), most=most).collect()}
    blocks = checkpointed(postings.build(found, size))
    got = {(r.query_id, r["rank"]): (r.document_id, round(r.score, 7)) for r in postings.top(blocks, queries, most).collect()}
    assert len(want) > 100
    assert got == want
    if most == 5:
        read = postings.skipped(blocks, queries, most).agg(F.sum("ranges"), F.sum("read")).first()
        assert read[1] < 0.9 * read[0]


def test_sets_of_terms_are_scored_once(spark, corpus, monkeypatch):
    """Queries with the same terms share their hits, also where the batch is too large to be broadcast; hybrid search asks so too."""
    found, queries = corpus
    queries = queries.unionByName(spark.createDataFrame([(200 + i, i % 2, "w3 W2 w3") for i in range(40)], queries.schema))
    plain = retrieval.lexical_scores(found, queries).groupBy("query_id", "document_id").agg(F.round(F.max("score"), 9).alias("score"))
    want = sorted(map(tuple, retrieval.ranked(plain, ["query_id"], F.desc("score"), F.asc("document_id"), most=7).select("query_id", "document_id", "score", "rank").collect()))
    sets, scores = [], retrieval.lexical_scores
    monkeypatch.setattr(retrieval, "lexical_scores", lambda held, batch: sets.append(batch.count()) or scores(held, batch))
    docs = found.select("tenant_id", "document_id").distinct().withColumns({"status": F.lit("indexed"), "review_status": F.lit("published")})
    vectors_, asked = docs.select("document_id", F.array(F.lit(1.0)).alias("embedding")), queries.withColumn("embedding", F.array(F.lit(1.0)))
    hybrid = retrieval.hybrid_search(docs, vectors_, found, asked, top_k=3).filter("lexical_rank <= 7").select("query_id", "document_id", F.col("lexical_rank").alias("rank"))
    assert sets.pop() < 30
    shown = {(q, d, r) for q, d, _, r in want}
    assert {tuple(r) for r in hybrid.collect()} <= shown and hybrid.filter("query_id >= 200").count() > 40
    assert sorted(map(tuple, retrieval.lexical_best(found, queries, 7).collect())) == want
    monkeypatch.setattr(retrieval, "BATCH_ROWS", 0)
    assert sorted(map(tuple, retrieval.lexical_best(found, queries, 7).collect())) == want


def test_block_maxima_in_many_shards(spark, corpus):
    """A rare term is in few shards, and equal queries are answered once; a shard gives its best documents only."""
    found, queries = corpus
    rare = spark.createDataFrame([(0, 0, 0, "rare", 1), (90, 30, 0, "rare", 2)], "chunk_id long, document_id long, tenant_id long, term string, tf long")
    found = found.unionByName(rare)
    queries = queries.unionByName(spark.createDataFrame([(200, 0, "rare"), (201, 0, "Rare rare"), (202, 1, "rare")], queries.schema))
    whole, parts = checkpointed(postings.build(found, 8)), checkpointed(postings.build(found, 8, 24))
    assert parts.select("tenant_id", "shard").distinct().count() > 5
    want = sorted(map(tuple, postings.top(whole, queries, 5).collect()))
    assert sorted(map(tuple, postings.top(parts, queries, 5).collect())) == want
    assert [(q, d) for q, d, *_ in want if q >= 200] == [(q, d) for q in (200, 201) for d in sorted({0, 30})]
    assert sorted(map(tuple, postings.skipped(parts, queries, 5).collect())) == sorted(map(tuple, postings.skipped(whole, queries, 5).collect()))


def test_blocks_are_made_from_rows_of_chunks(spark, corpus):
    """Postings are made inside a range's group, never as rows that are sorted; a shard is dealt the blocks of the terms that it is asked for."""
    found, queries = corpus
    made = postings.build(found.filter("chunk_id < 60"), 2, 2)
    assert "collect_list(struct(chunk_id" not in made._jdf.queryExecution().executedPlan().toString()
    held = checkpointed(made)
    rows = held.select("tenant_id", "term", "n", "most", F.explode("postings").alias("p")).groupBy("tenant_id", "term").agg(F.count("*").alias("n"), F.max("p.weight").alias("most"))
    want = found.filter("chunk_id < 60").groupBy("tenant_id", "term").agg(F.count("*").alias("n"))
    assert sorted(map(tuple, rows.drop("most").collect())) == sorted(map(tuple, want.collect()))
    assert held.filter("n <> size(postings) OR most <> array_max(transform(postings, p -> p.weight))").count() == 0
    holding = {(r.shard, r.term) for r in held.filter("tenant_id = 0 AND term IN ('w1', 'w2')").collect()}
    one_term = sorted((s, t) for s, t in holding if t == ("w1", "w2")[s % 2])
    assert {t for _, t in one_term} == {"w1", "w2"} and len(holding) > len(one_term)
    asked = spark.createDataFrame([(0, s, s, [(t, 1.0)]) for s, t in one_term], "tenant_id long, shard long, asked long, wanted array<struct<term: string, idf: double>>")
    each = postings.met(held, asked, ["most"], lambda shard, row: (np.array([len(shard.at)]),), "terms long")
    assert {tuple(r) for r in each.collect()} == {(0, s, s, 1) for s, _ in one_term}


def test_terms_of_a_chunk_are_counted_in_its_row(spark):
    chunks = spark.createDataFrame([(1, 7, 0, "Der der, DER Rat 12"), (2, 7, 0, "... --"), (3, 8, 1, "x"), (4, 8, 1, None)], "chunk_id long, document_id long, tenant_id long, chunk_text string")
    held = postings.count_terms(chunks)
    assert "Exchange" not in held._jdf.queryExecution().executedPlan().toString()
    assert sorted((r.chunk_id, r.length, r.words.split("\n"), r.tfs) for r in held.collect()) == [(1, 5, ["12", "der", "rat"], [1, 3, 1]), (3, 1, ["x"], [1])]
    rows = spark.createDataFrame([(1, 7, 0, t, n) for t, n in (("rat", 1), ("12", 1), ("der", 3))] + [(3, 8, 1, "x", 1)], "chunk_id long, document_id long, tenant_id long, term string, tf long")
    assert sorted(map(tuple, retrieval.by_chunk(rows).collect())) == sorted(map(tuple, held.collect()))


def test_vector_index(spark):
    rng = random.Random(11)
    centres = [[rng.gauss(0, 1) for _ in range(32)] for _ in range(20)]
    rows = [(i, i % 2, [x + rng.gauss(0, 0.5) for x in rng.choice(centres)]) for i in range(2400)]
    rows += [(5000, 0, [0.0] * 32), (5001, 0, rows[0][2]), (5002, 1, rows[0][2])]
    held = spark.createDataFrame(rows, "document_id long, tenant_id long, embedding array<double>").repartition(3)
    model = vectors.train(held, slices=8, entries=64)
    index = checkpointed(vectors.build(held, model, part_rows=50))
    assert index.count() == len(rows) and index.agg(F.max("part")).first()[0] > 0
    queries = held.filter("document_id % 40 = 0 OR document_id = 5000").withColumnRenamed("document_id", "query_id")
    exact = retrieval.ranked(retrieval.semantic_distances(held, queries), ["query_id"], F.asc("distance"), F.asc("document_id"), most=10)
    found = vectors.search(index, model, held, queries)
    assert vectors.recall(found, exact.filter("query_id < 5000")).first().recall >= 0.95
    assert model.usual < len(model.centroids)
    every = vectors.search(index, model, held, queries, probes=len(model.centroids), rerank=3000)
    assert sorted(map(tuple, every.collect())) == sorted(map(tuple, exact.select(*every.columns).collect()))


@pytest.mark.parametrize("dense", [False, True])
def test_cosine_join_against_all_pairs(spark, dense):
    rng = random.Random(12)
    make = lambda: [rng.gauss(0, 1) for _ in range(6)] if dense else [float(rng.choice([0, 0, 0, 0, 1, 2])) for _ in range(24)]
    rows = [(i % 2, i, make()) for i in range(160)] + [(0, 500, [0.0] * (6 if dense else 24)), (0, 501, None)]
    rows += [(0, 502, rows[0][2]), (1, 503, rows[0][2])]
    unit = lambda v: sum(x * x for x in v) ** 0.5
    want = {}
    for t, i, v in rows:
        for u, j, w in rows:
            if t == u and i < j and v and w and unit(v) and unit(w):
                c = round(sum(x * y for x, y in zip(v, w, strict=True)) / unit(v) / unit(w), 6)
                if c >= 0.7:
                    want[t, i, j] = c
    df = spark.createDataFrame(rows, "tenant_id long, key long, embedding array<double>")
    got = {(r.tenant_id, r.a, r.b): r.similarity for r in conflicts.cosine_join(df, 0.7).collect()}
    assert got.keys() == want.keys() and len(got) > 5
    assert all(abs(got[k] - want[k]) < 2e-6 for k in got)


def test_related_documents_of_one_predicate_stay_linear(spark):
    """20,000 documents share a predicate: 20 rows for each, not a pair of each two."""
    n = 20_000
    docs = spark.range(n).select(F.col("id").alias("document_id"), (F.col("id") % 2).alias("tenant_id"), F.lit("t").alias("title"), F.when(F.col("id") == 2, "deleted").otherwise("indexed").alias("status"))
    claims = docs.select("document_id", F.lit(9).alias("tenant_id"), F.lit("Retention").alias("predicate"), F.concat(F.lit("v"), F.col("document_id") % 3).alias("object_value"), F.lit("active").alias("status"))
    found = checkpointed(graph.related(claims, docs))
    assert found.count() == 20 * (n - 1)
    assert [r.related_id for r in found.filter("document_id = 6").orderBy("rank").collect()] == [x for x in range(0, 46, 2) if x not in (2, 6)][:20]
    assert found.filter("related_id % 2 <> document_id % 2").count() == 0


def test_equal_queries_are_looked_up_once(spark, monkeypatch):
    index = spark.createDataFrame([(t, f"s{i}", f"part {i}", f"s{i}", f"Part {i}", "v", 0.5) for t in range(2) for i in range(40)], "tenant_id long, subject_normalized string, predicate_normalized string, subject string, predicate string, value string, confidence double")
    queries = spark.createDataFrame([(q, q % 2, "Part 7" if q < 30 else "part of 1 9") for q in range(50)], "query_id long, tenant_id long, query_text string")
    sizes, plain = [], retrieval.meet
    monkeypatch.setattr(retrieval, "meet", lambda rows, *a: sizes.append(rows.count()) or plain(rows, *a))
    got = {(r.query_id, r.predicate, r.strategy, r["rank"]) for r in retrieval.index_lookup(index, queries).collect()}
    assert got == {(q, "Part 7", 1, 1) for q in range(30)} | {(q, "Part 19", 2, 1) for q in range(30, 50)}
    assert sizes == [4, 2]


def test_nearest_by_buckets_with_copies_parts_and_one_group_for_each_bucket(spark, monkeypatch):
    """300 copies of a vector are one row, and small groups and parts give what one large group gives."""
    rng = random.Random(5)
    rows = [(i, [rng.gauss(0, 1) for _ in range(8)]) for i in range(500)] + [(1000 + i, [1.0] * 8) for i in range(300)] + [(2000, [0.0] * 8), (2001, None)]
    v = spark.createDataFrame(rows, "document_id long, embedding array<double>")
    want = sorted(map(tuple, conflicts.knn_join(v, v, planes=4).collect()))
    assert [r[1:3] for r in want if r[0] in (1000, 1007)] == [(1001, 0.0), (1002, 0.0), (1003, 0.0), (1000, 0.0), (1001, 0.0), (1002, 0.0)]
    monkeypatch.setattr(blocks, "BLOCK_ROWS", 50)
    monkeypatch.setattr(blocks, "PART_ROWS", 60)
    assert sorted(map(tuple, conflicts.knn_join(v, v, planes=4).collect())) == want
    exact = sorted(map(tuple, conflicts.knn_join(v.filter("document_id % 50 = 0"), v).collect()))
    monkeypatch.setattr(blocks, "BLOCK_ROWS", 5000)
    assert sorted(map(tuple, conflicts.knn_join(v.filter("document_id % 50 = 0"), v).collect())) == exact
    few = blocks.distinct_vectors(v, 4)
    assert few.count() == 503 and few.agg(F.max(F.size("ids"))).first()[0] == 4


def test_pairs_are_not_shuffled(spark):
    """Only what is alike leaves a task: no join of candidates is left in the plans."""
    names = spark.createDataFrame([(1, f"part {i}") for i in range(20)], "tenant_id long, predicate string")
    vectors = spark.createDataFrame([(i, [1.0, float(i)]) for i in range(20)], "document_id long, embedding array<double>")
    for df in (conflicts.similar_predicates(names), conflicts.cosine_join(vectors.selectExpr("1 AS tenant_id", "document_id AS key", "embedding")), conflicts.knn_join(vectors, vectors)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "FlatMapCoGroupsInArrow" in plan and "SortMergeJoin" not in plan


def test_pairs_across_blocks(spark, monkeypatch):
    rng = random.Random(6)
    names = spark.createDataFrame([(t, " ".join(rng.choice(["red", "reds", "fox", "foxes", "\U0001f98a", "né", "x1"]) for _ in range(4))) for t in (1, 2) for _ in range(150)] + [(1, None), (1, "..."), (None, "red fox")], "tenant_id long, predicate string")
    want = sorted(map(tuple, conflicts.similar_predicates(names).collect()))
    monkeypatch.setattr(blocks, "BLOCK_ROWS", 20)
    monkeypatch.setattr(blocks, "PLACES", 8)
    assert sorted(map(tuple, conflicts.similar_predicates(names).collect())) == want and len(want) > 50


def test_rounding_is_that_of_spark(spark):
    rng = random.Random(7)
    x = [rng.random() * 2 - 1 for _ in range(2000)] + [k / 2e6 for k in range(-2001, 2001, 2)] + [1 - 1.0000000000000002, 0.0, 2.5e-7, -2.5e-7]
    want = [r.r for r in spark.createDataFrame([(i, a) for i, a in enumerate(x)], "i long, x double").orderBy("i").select(F.round("x", 6).alias("r")).collect()]
    assert blocks.rounded(np.array(x)).tolist() == want


def test_links_of_similar_claims_are_those_of_the_edges(spark):
    rng = random.Random(8)
    rows = [(rng.randrange(40), t, rng.choice(["red fox", "red foxes", "Red Fox ", "blue sea", "blue seas", "..."]), rng.choice(["x", "y", None]), rng.choice(["active", "active", "superseded"])) for t in (0, 1) for _ in range(120)]
    claims = spark.createDataFrame([(d * 2 + t, t, p, v, s) for d, t, p, v, s in rows], "document_id long, tenant_id long, predicate string, object_value string, status string")
    got = [(r.document_id, r.agreeing, r.contradicting, r.class_id) for r in graph.similar_claim_links(claims, 0.5).collect()]
    edges = graph.claim_edges(claims, 0.5).collect()
    per, kinds = {}, {}
    for d, agreeing, contradicting, _ in got:
        per[d], kinds[d] = per.get(d, 0) + agreeing + contradicting, kinds.get(d, 0) + contradicting
    want, bad = {d: 0 for d in per}, set()
    for e in edges:
        for end in (e.source, e.target):
            want[end] += e.shared
            if e.kind == "contradiction":
                bad.add(end)
    assert per == want and sum(want.values()) > 1000
    assert {d for d, n in kinds.items() if n} == bad
    assert all(c <= d for d, _, _, c in got)
