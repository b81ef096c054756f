"""Queries over stored search structures (block maxima, the vector index), cosine joins and related documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import terms
from ..operators import analytics as an
from ..operators import conflicts as cf
from ..operators import graph as gr
from ..operators import postings as po
from ..operators import retrieval as rt
from ..operators import vectors as ve
from ..operators.conflicts import checkpointed
from .q_knowledge import _SIM, _search_sql, _terms, open_terms, open_vectors, search_inputs, titles_as_claims
from .q_more import wide_claims
from .registry import query

#: Two words of each tenth document, which many of its tenant's others have too.
_PAIRS = "q AS (SELECT document_id AS query_id, tenant_id, concat(split_part(text, ' ', 3), ' ', split_part(text, ' ', 6)) AS query_text, CAST(NULL AS DOUBLE[]) AS embedding FROM {docs} WHERE document_id % 10 = 0)"


def word_pairs(v):
    return v("docs").filter("document_id % 10 = 0").select(F.col("document_id").alias("query_id"), "tenant_id", F.concat_ws(" ", F.split_part("text", F.lit(" "), F.lit(3)), F.split_part("text", F.lit(" "), F.lit(6))).alias("query_text"))


def blocks(v, range_docs=po.RANGE_DOCS):
    return checkpointed(po.build(open_terms(v), range_docs))


@query("f7_block_max_top", _search_sql(_PAIRS) + "SELECT query_id, document_id, s AS score, CAST(rank AS BIGINT) AS rank FROM lr")
def _(v):
    """Ranges of 16 documents, so that the fixture's tenants have many."""
    return po.top(blocks(v, 16), word_pairs(v)).select("query_id", "document_id", "score", "rank")


@query("f7_block_max_skipped")
def _(v):
    return po.skipped(blocks(v, 16), word_pairs(v), 10)


def index_of(v):
    rows = open_vectors(v).select("tenant_id", "document_id", "embedding")
    model = ve.train(rows)
    return rows, model, checkpointed(ve.build(rows, model))


@query("e1_vector_index")
def _(v):
    rows, model, index = index_of(v)
    return ve.search(index, model, rows, search_inputs(v), 60, rerank=300)


@query("e1_vector_index_recall")
def _(v):
    """Recall among the ten nearest, over all queries, against the exact scan."""
    rows, model, index = index_of(v)
    q = search_inputs(v)
    exact = rt.ranked(rt.semantic_distances(rows, q), ["query_id"], F.asc("distance"), F.asc("document_id"), most=10)
    return ve.recall(ve.search(index, model, rows, q, 10), exact)


@query("i22_indexed_search")
def _(v):
    """Hybrid search over both stored structures."""
    rows, model, index = index_of(v)
    q = search_inputs(v)
    semantic = ve.search(index, model, rows, q, 60, rerank=300)
    fused = rt.fuse(semantic, po.top(blocks(v), q), an.feedback_boost(v("feedback"))).withColumn("score", F.round("score", 9))
    return rt.ranked(fused, ["query_id"], F.desc("score"), F.asc("document_id"), most=20).select("query_id", "document_id", "semantic_rank", "lexical_rank", "score", "rank")


def md5_terms(c):
    """An embedder that SQL has too: each term adds 1 to the place that its MD5 names."""
    places = F.transform(terms(c), lambda t: F.conv(F.substring(F.md5(t), 1, 2), 16, 10).cast("int") % 64)
    return F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.size(F.filter(places, lambda p: p == i)).cast("double"))


_BY_MEANING = f"""tp AS (SELECT DISTINCT tenant_id, lower(trim(title)) AS p FROM {{docs}} WHERE title IS NOT NULL), te AS (SELECT tenant_id, p, list_transform(range(0, 64), lambda i: CAST(len(list_filter(list_transform({_terms('p')}, lambda t: CAST(concat('0x', substr(md5(t), 1, 2)) AS INT) % 64), lambda x: x = i)) AS DOUBLE)) AS e FROM tp),
near AS (SELECT a.tenant_id, a.p AS predicate_a, b.p AS predicate_b, round(list_cosine_similarity(a.e, b.e), 6) AS similarity FROM te a JOIN te b ON a.tenant_id = b.tenant_id AND a.p < b.p WHERE list_sum(a.e) > 0 AND list_sum(b.e) > 0 AND round(list_cosine_similarity(a.e, b.e), 6) >= 0.7)"""


@query("c7_predicates_by_meaning", f"WITH {_BY_MEANING} SELECT * FROM near")
def _(v):
    return cf.predicates_by_meaning(titles_as_claims(v).filter("predicate IS NOT NULL"), md5_terms).filter("predicate_a <> predicate_b")


@query("c7_conflicts_by_meaning", f"""WITH {_BY_MEANING}, sim AS (SELECT * FROM near UNION ALL SELECT tenant_id, p, p, 1 FROM tp), bs AS (SELECT tenant_id, lower(trim(title)) AS p, concat('d', document_id % 3) AS x, document_id AS claim_id FROM {{docs}} WHERE title IS NOT NULL QUALIFY row_number() OVER (PARTITION BY tenant_id, p, x ORDER BY coalesce(quality_score, 0) DESC, document_id) = 1)
SELECT a.claim_id AS claim_a, b.claim_id AS claim_b, predicate_a, predicate_b, round(similarity * 0.9, 6) AS confidence FROM sim JOIN bs a ON a.p = predicate_a AND a.tenant_id = sim.tenant_id JOIN bs b ON b.p = predicate_b AND b.tenant_id = sim.tenant_id WHERE a.x <> b.x AND (predicate_a <> predicate_b OR a.x < b.x)""")
def _(v):
    claims = titles_as_claims(v).filter("predicate IS NOT NULL").withColumn("object_value", F.concat(F.lit("d"), F.col("document_id") % 3))
    return cf.similar_claim_conflicts(claims, cf.predicates_by_meaning(claims, md5_terms), 0.7)


_RELATED = """SELECT document_id, related_id, title, predicate, this_value, related_value, similarity, CAST(row_number() OVER (PARTITION BY document_id ORDER BY related_id) AS BIGINT) AS rank FROM (
SELECT a.document_id, b.document_id AS related_id, d2.title, a.p AS predicate, a.x AS this_value, b.x AS related_value, similarity FROM cv a JOIN sb ON sb.tenant_id = a.tenant_id AND sb.a = trim(a.p) JOIN cv b ON b.tenant_id = sb.tenant_id AND trim(b.p) = sb.b AND a.document_id <> b.document_id JOIN live d2 ON d2.document_id = b.document_id
QUALIFY row_number() OVER (PARTITION BY a.document_id, b.document_id ORDER BY similarity DESC, a.p, a.x, b.x) = 1) QUALIFY rank <= 20"""


@query("i38_related_documents", f"WITH {_SIM}, live AS (SELECT * FROM {{docs}} WHERE status <> 'deleted'), cv AS (SELECT tenant_id, lower(title) AS p, document_id, lang AS x FROM live), sb AS (SELECT tenant_id, predicate_a AS a, predicate_b AS b, similarity FROM sim UNION ALL SELECT tenant_id, predicate_b, predicate_a, similarity FROM sim UNION ALL SELECT DISTINCT tenant_id, trim(p), trim(p), 1.0 FROM cv) {_RELATED}")
def _(v):
    return gr.related(titles_as_claims(v), v("docs"))


@query("i38_related_on_one_predicate", f"WITH live AS (SELECT * FROM {{claim_docs}} WHERE status <> 'deleted'), cv AS (SELECT l.tenant_id, concat('flag ', l.tenant_id) AS p, c.document_id, min(object_value) AS x FROM {{claims}} c JOIN live l ON l.document_id = c.document_id WHERE c.status = 'active' GROUP BY ALL), sb AS (SELECT DISTINCT tenant_id, p AS a, p AS b, CAST(1 AS DOUBLE) AS similarity FROM cv) {_RELATED}")
def _(v):
    """All documents of a tenant have claims on one predicate."""
    return gr.related(wide_claims(v), v("claim_docs"))
