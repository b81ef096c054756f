"""Queries: scans, filters, aggregates, orderings."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import analytics as an
from ..operators import filters as fl
from ..operators import governance as gv
from ..operators import retrieval as rt
from .registry import now, query


@query("a1_scan_tenant", "SELECT document_id, status, doc_type FROM {docs} WHERE tenant_id = 2")
def _(v):
    return fl.scan(v("docs"), 2).select("document_id", "status", "doc_type")


@query("b1_searchable", "SELECT document_id, title, review_status FROM {docs} WHERE status = 'indexed' AND review_status NOT IN ('quarantined', 'rejected', 'superseded')")
def _(v):
    return fl.searchable(v("docs")).select("document_id", "title", "review_status")


@query("b2_by_source_type", "SELECT document_id, source_id FROM {docs} WHERE source_id IN (SELECT source_id FROM {sources} WHERE source_type = 'jira')")
def _(v):
    return fl.by_source_type(v("docs"), v("sources"), "jira").select("document_id", "source_id")


@query("b3_by_doc_type", "SELECT document_id, doc_type FROM {docs} WHERE doc_type = 'de'")
def _(v):
    return fl.by_doc_type(v("docs"), "de").select("document_id", "doc_type")


@query("b4_by_metadata", "SELECT document_id FROM {docs} WHERE lang = 'en' AND source_id = 'src3'")
def _(v):
    docs = v("docs").withColumn("doc_metadata", F.create_map(F.lit("lang"), F.col("lang"), F.lit("source"), F.col("source_id")))
    return fl.by_metadata(docs, {"lang": "en", "source": "src3"}).select("document_id")


@query(
    "b5_acl_visible",
    """SELECT CAST(NULL AS BIGINT) AS principal_id, document_id FROM {docs} WHERE document_id NOT IN (SELECT document_id FROM {acl})
    UNION ALL SELECT DISTINCT principal_id, document_id FROM {acl} WHERE principal_id <> 5 AND permission IN ('read', 'write', 'admin') AND document_id IN (SELECT document_id FROM {docs})""",
)
def _(v):
    return fl.acl_visible(v("docs"), v("acl"), v("acl").filter("principal_id <> 5").select("principal_id"))


@query(
    "b6_validate_events",
    r"""SELECT document_id, reason IS NULL AS valid, reason FROM (SELECT document_id, CASE WHEN t = '' THEN 'Empty content'
    WHEN length(t) < CASE WHEN source = 'src0' THEN 200 ELSE 50 END THEN concat('Content too short (', length(t), ' < ', CASE WHEN source = 'src0' THEN 200 ELSE 50 END, ' chars)')
    WHEN source = 'src1' THEN 'Missing required metadata: owner' WHEN source = 'src2' AND lower(status) NOT IN ('indexed') THEN concat('Status ''', lower(status), ''' not in allowed')
    WHEN regexp_matches(text, '^This page is auto-generated', 'i') OR regexp_matches(text, '(?im)^\s*\[?TODO\]?\s*$') OR regexp_matches(text, '^Lorem ipsum', 'i') THEN 'Content matches blocklist pattern' END AS reason
    FROM (SELECT document_id, source_id AS source, status, text, regexp_replace(coalesce(text, ''), '^\s+|\s+$', '', 'g') AS t FROM {docs}))""",
)
def _(v):
    events = v("docs").select("document_id", F.col("source_id").alias("source"), F.col("text").alias("content"), F.create_map(F.lit("status"), F.col("status")).alias("metadata"))
    return fl.validate_events(events, required={"src1": ["status", "owner"]}, allowed={"src2": ["indexed"]}, minimum={"src0": 200}).select("document_id", "valid", "reason")


@query("b7_findings_listing", "SELECT finding_id, document_id, finding_type FROM {findings} WHERE severity = 'critical' AND finding_type = 'empty_content'")
def _(v):
    return fl.listing(v("findings"), severity="critical", finding_type="empty_content", tenant_id=None).select("finding_id", "document_id", "finding_type")


@query("b7_conflicts_listing", "SELECT conflict_id, conflict_type FROM {conflicts} WHERE status = 'new'")
def _(v):
    return fl.listing(v("conflicts"), status="new", conflict_type=None).select("conflict_id", "conflict_type")


@query("b7_audit_listing", "SELECT event_id, actor, action, resource_type, CAST(created_at AS STRING) AS created_at FROM {audit} WHERE resource_type = 'source' AND action = 'click'")
def _(v):
    return fl.listing(v("audit"), resource_type="source", action="click").select("event_id", "actor", "action", "resource_type", F.col("created_at").cast("string").alias("created_at"))


_TITLE_ASKED = "SELECT document_id AS query_id, tenant_id, upper(substr(title, 3, 3 + CAST(document_id % 7 AS INT))) AS query_text FROM {docs} WHERE document_id % 10 = 0"


@query(
    "b8_title_search",
    f"""SELECT query_id, document_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY created_at DESC, document_id) AS BIGINT) AS rank FROM ({_TITLE_ASKED}) q JOIN {{docs}} d ON d.tenant_id = q.tenant_id
    WHERE d.status <> 'deleted' AND query_text <> '' AND contains(lower(d.title), lower(query_text)) QUALIFY rank <= 10""",
)
def _(v):
    """Parts of titles, mostly of words, are sought in all titles of their tenant."""
    asked = v("docs").filter("document_id % 10 = 0").select(F.col("document_id").alias("query_id"), "tenant_id", F.upper(F.substring("title", F.lit(3), 3 + (F.col("document_id") % 7).cast("int"))).alias("query_text"))
    return rt.title_search(v("docs"), asked).select("query_id", "document_id", "rank")


@query(
    "b9_eligible_chunks",
    "SELECT chunk_id, document_id FROM (SELECT chunk_id, document_id, row_number() OVER (PARTITION BY document_id ORDER BY chunk_index) AS r FROM {chunks} WHERE length(trim(chunk_text)) >= 30) WHERE r <= 50",
)
def _(v):
    return fl.eligible_chunks(v("chunks")).select("chunk_id", "document_id")


@query(
    "b10_due_sources",
    """SELECT s.source_id, s.source_type FROM {sources} s LEFT JOIN {cursors} c ON s.source_id = c.source_id AND s.source_type = c.source_type
    WHERE auto_sync AND coalesce(sync_status, 'idle') <> 'running' AND (last_sync_at IS NULL OR last_sync_at + to_minutes(interval_minutes) < stamp('2024-01-31 00:00:00'))""",
)
def _(v):
    return fl.due_sources(v("sources"), v("cursors"), now()).select("source_id", "source_type")


@query(
    "c1_chunks_of_documents",
    "SELECT d.tenant_id, d.doc_type, CAST(count(*) AS BIGINT) AS chunks, CAST(sum(length(chunk_text)) AS BIGINT) AS chars FROM {chunks} c JOIN {docs} d ON c.document_id = d.document_id WHERE d.status = 'indexed' GROUP BY ALL",
)
def _(v):
    docs = v("docs").filter("status = 'indexed'").select("document_id", "doc_type")
    return v("chunks").join(docs, "document_id").groupBy("tenant_id", "doc_type").agg(F.count("*").alias("chunks"), F.sum(F.length("chunk_text")).alias("chars"))


@query("c2_documents_with_source", "SELECT document_id, s.name AS source_name, s.source_type, c.sync_status FROM {docs} d LEFT JOIN {sources} s ON d.source_id = s.source_id LEFT JOIN {cursors} c ON s.source_id = c.source_id AND s.source_type = c.source_type")
def _(v):
    return v("docs").join(v("sources").select("source_id", F.col("name").alias("source_name"), "source_type"), "source_id", "left").join(v("cursors"), ["source_id", "source_type"], "left").select("document_id", "source_name", "source_type", "sync_status")


@query("c5_conflicts_of_documents", "SELECT d.document_id, CAST(count(*) AS BIGINT) AS conflicts FROM {docs} d JOIN {conflicts} c ON d.document_id = c.document_a_id OR d.document_id = c.document_b_id GROUP BY d.document_id")
def _(v):
    return v("docs").select("document_id").join(an.by_document(v("conflicts")), "document_id").groupBy("document_id").agg(F.count("*").alias("conflicts"))


@query("c11_orphan_findings", "SELECT finding_id, document_id FROM {findings} f WHERE NOT EXISTS (SELECT 1 FROM {docs} d WHERE d.document_id = f.document_id)")
def _(v):
    return v("findings").join(v("docs"), "document_id", "left_anti").select("finding_id", "document_id")


@query("c12_retention_due", "SELECT d.document_id FROM {docs} d JOIN {tenants} t ON d.tenant_id = t.tenant_id WHERE d.status = 'deleted' AND t.hard_delete_enabled = true AND d.created_at < stamp('2024-01-31 00:00:00') - to_days(CAST(coalesce(t.retention_days, 365) AS INT))")
def _(v):
    return gv.retention_due(v("docs"), v("tenants"), now())


@query("c13_claims_per_document", "SELECT d.document_id, CAST(count(c.claim_id) AS BIGINT) AS claims FROM {claim_docs} d LEFT JOIN {claims} c ON c.document_id = d.document_id GROUP BY d.document_id")
def _(v):
    per = v("claims").groupBy("document_id").agg(F.count("*").alias("claims"))
    return v("claim_docs").select("document_id").join(per, "document_id", "left").fillna(0, ["claims"])


@query("d1_quality_by_source", """SELECT d.tenant_id, d.source_id, CAST(count(d.document_id) AS BIGINT) AS documents, round(avg(d.quality_score), 6) AS avg_quality, round(min(d.quality_score), 3) AS min_quality, CAST(count(*) FILTER (WHERE d.quality_score < 0.5) AS BIGINT) AS low_quality,
    CAST(count(*) FILTER (WHERE d.review_status = 'quarantined') AS BIGINT) AS quarantined, s.name, s.source_type FROM {docs} d JOIN {sources} s ON d.source_id = s.source_id WHERE d.status != 'deleted' GROUP BY d.tenant_id, d.source_id, s.name, s.source_type""")
def _(v):
    return an.quality_by_source(v("docs"), v("sources"))


@query("d2_hotspots", """SELECT cc.tenant_id, d.document_id, d.title, s.name AS source_name, CAST(count(cc.conflict_id) AS BIGINT) AS conflicts, CAST(count(*) FILTER (WHERE cc.status = 'new') AS BIGINT) AS unresolved, round(avg(cc.confidence), 6) AS avg_confidence,
    CAST(row_number() OVER (PARTITION BY cc.tenant_id ORDER BY count(*) FILTER (WHERE cc.status = 'new') DESC, count(cc.conflict_id) DESC, d.document_id) AS BIGINT) AS rank
    FROM {conflicts} cc JOIN {docs} d ON (cc.document_a_id = d.document_id OR cc.document_b_id = d.document_id) JOIN {sources} s ON d.source_id = s.source_id GROUP BY cc.tenant_id, d.document_id, d.title, s.name QUALIFY rank <= 20""")
def _(v):
    return an.hotspots(v("conflicts"), v("docs"), v("sources"))


@query("d3_claim_stability", """SELECT d.tenant_id, CAST(count(*) AS BIGINT) AS total, CAST(count(*) FILTER (WHERE c.status = 'active') AS BIGINT) AS active, CAST(count(*) FILTER (WHERE c.status = 'superseded') AS BIGINT) AS superseded, CAST(count(*) FILTER (WHERE c.status = 'rejected') AS BIGINT) AS rejected,
    CAST(count(DISTINCT c.document_id) AS BIGINT) AS documents, round(1.0 - count(*) FILTER (WHERE c.status = 'superseded') / count(*), 4) AS stability FROM {claims} c JOIN {claim_docs} d ON c.document_id = d.document_id GROUP BY d.tenant_id""")
def _(v):
    return an.claim_stability(v("claims"), v("claim_docs"))


for _period, _days in (("day", 1), ("week", 7), ("month", 30)):

    @query(f"d4_usage_{_period}", f"SELECT tenant_id, event_type, CAST(sum(quantity) AS BIGINT) AS quantity, CAST(count(*) AS BIGINT) AS events FROM {{usage}} WHERE created_at > stamp('2024-01-31 00:00:00') - to_days({_days}) AND created_at <= stamp('2024-01-31 00:00:00') GROUP BY ALL")
    def _(v, period=_period):
        return an.usage_summary(v("usage"), now(), period)


_QUOTA = """WITH d AS (SELECT tenant_id, count(*) AS n FROM {docs} WHERE status <> 'deleted' GROUP BY 1), q AS (SELECT tenant_id, count(*) AS n, sum(quantity) AS s FROM {usage} WHERE event_type = 'view' AND created_at >= stamp('2024-01-01 00:00:00') AND created_at <= stamp('2024-01-31 00:00:00') GROUP BY 1),
    s AS (SELECT tenant_id, count(*) AS n FROM {sources} GROUP BY 1), u AS (SELECT t.*, CAST(coalesce(d.n, 0) AS BIGINT) AS documents, CAST(coalesce(q.n, 0) AS BIGINT) AS queries, CAST(coalesce(q.s, 0) AS BIGINT) AS query_quantity, CAST(coalesce(s.n, 0) AS BIGINT) AS sources FROM {tenants} t LEFT JOIN d USING (tenant_id) LEFT JOIN q USING (tenant_id) LEFT JOIN s USING (tenant_id)) """


@query("d5_check_quota", _QUOTA + """SELECT tenant_id, reason IS NULL AS allowed, reason FROM (SELECT tenant_id, CASE WHEN documents >= max_documents THEN 'document limit reached' WHEN queries >= max_queries_per_month THEN 'query limit reached' WHEN sources >= max_sources THEN 'source limit reached' END AS reason FROM u)""")
def _(v):
    return an.check_quota(an.quota_view(v("tenants"), v("docs"), v("sources"), v("usage"), now())).select("tenant_id", "allowed", "reason")


@query("d6_month_to_date", _QUOTA + "SELECT tenant_id, plan, documents, queries, query_quantity, sources FROM u")
def _(v):
    return an.quota_view(v("tenants"), v("docs"), v("sources"), v("usage"), now()).select("tenant_id", "plan", "documents", "queries", "query_quantity", "sources")


_TREE = """WITH t AS (SELECT DISTINCT unnest([document_a_id, document_b_id]) AS document_id FROM {conflicts} WHERE status = 'new'), k AS (SELECT document_id, count(*) AS n FROM {claims} WHERE status = 'active' GROUP BY 1),
    own AS (SELECT * FROM {sources} UNION ALL SELECT 'src-empty', 3, 'Empty', 'notion', false, 15),
    r AS (SELECT d.*, CASE WHEN d.document_id % 10 = 3 THEN 'from/metadata' WHEN source_path LIKE '%/%' THEN regexp_replace(source_path, '/[^/]*$', '') ELSE '(root)' END AS folder, t.document_id AS hit, k.n FROM {docs} d LEFT JOIN t ON d.document_id = t.document_id LEFT JOIN k ON k.document_id = d.document_id),
    g AS (SELECT s.source_id, s.tenant_id, s.name, s.source_type, r.folder, GROUPING(r.folder) AS whole, CAST(count(r.document_id) AS BIGINT) AS documents, CAST(count(r.document_id) FILTER (WHERE r.status = 'indexed') AS BIGINT) AS indexed, CAST(count(r.document_id) FILTER (WHERE r.review_status = 'quarantined') AS BIGINT) AS quarantined, CAST(count(hit) AS BIGINT) AS conflicted,
    round(avg(quality_score), 6) AS avg_quality, min(quality_score) AS min_quality, CAST(coalesce(sum(chunk_count), 0) AS BIGINT) AS chunks, CAST(coalesce(sum(n), 0) AS BIGINT) AS active_claims FROM own s LEFT JOIN r ON r.source_id = s.source_id AND r.status != 'deleted' GROUP BY GROUPING SETS ((s.source_id, s.tenant_id, s.name, s.source_type, r.folder), (s.source_id, s.tenant_id, s.name, s.source_type)))
    SELECT * EXCLUDE (whole) FROM g WHERE whole = 1 OR folder IS NOT NULL"""


@query("d9_source_tree", _TREE)
def _(v):
    """With a source that has no document, and a folder in the metadata of each tenth document."""
    sources = v("sources").unionByName(v("sources").limit(1).select(F.lit("src-empty").alias("source_id"), F.lit(3).cast("long").alias("tenant_id"), F.lit("Empty").alias("name"), F.lit("notion").alias("source_type"), F.lit(False).alias("auto_sync"), F.lit(15).cast("long").alias("interval_minutes")))
    docs = v("docs").withColumn("doc_metadata", F.when(F.col("document_id") % 10 == 3, F.create_map(F.lit("folder_path"), F.lit("from/metadata"))))
    return an.source_tree(sources, docs, v("conflicts"), v("claims"))


@query("d10_feedback_boost", "SELECT document_id, sum(rating) / greatest(count(*), 1) * 0.1 AS boost FROM {feedback} GROUP BY 1")
def _(v):
    return an.feedback_boost(v("feedback"))


@query("d10_feedback_boost_by_chunk", "SELECT chunk_id, sum(rating) / greatest(count(*), 1) * 0.1 AS boost FROM {feedback} GROUP BY 1")
def _(v):
    return an.feedback_boost(v("feedback"), "chunk_id")


@query("d11_feedback_log_boost", "SELECT document_id, round(avg(rating) * ln(count(*) + 1) * 0.1, 9) AS boost FROM {feedback} GROUP BY 1")
def _(v):
    return an.feedback_log_boost(v("feedback")).withColumn("boost", F.round("boost", 9))


@query("d13_document_counts", "SELECT tenant_id, CAST(count(*) AS BIGINT) AS total, CAST(count(*) FILTER (status = 'indexed') AS BIGINT) AS indexed, CAST(count(*) FILTER (status = 'quarantined') AS BIGINT) AS quarantined FROM {docs} WHERE status <> 'deleted' GROUP BY 1")
def _(v):
    return an.document_counts(v("docs"))


@query("d13_quality_overview", """SELECT tenant_id, round(avg(quality_score), 2) AS avg_score, round(min(quality_score), 2) AS min_score, round(max(quality_score), 2) AS max_score, CAST(count(*) FILTER (quality_score >= 0.8) AS BIGINT) AS high_quality, CAST(count(*) FILTER (quality_score < 0.5) AS BIGINT) AS low_quality
    FROM {docs} WHERE status <> 'deleted' AND quality_score IS NOT NULL GROUP BY 1""")
def _(v):
    return an.quality_overview(v("docs"))


@query("d13_conflict_summary", "SELECT tenant_id, status, CAST(count(*) AS BIGINT) AS n FROM {conflicts} GROUP BY ALL")
def _(v):
    return an.conflict_summary(v("conflicts"))


@query("d14_dashboard", """WITH a AS (SELECT tenant_id, count(*) AS documents, count(*) FILTER (status = 'indexed') AS indexed, round(avg(quality_score), 6) AS avg_quality FROM {docs} WHERE status <> 'deleted' GROUP BY 1), b AS (SELECT tenant_id, count(*) AS n FROM {conflicts} WHERE status = 'new' GROUP BY 1), c AS (SELECT tenant_id, count(*) AS n FROM {reviews} WHERE status = 'new' GROUP BY 1)
    SELECT tenant_id, CAST(documents AS BIGINT) AS documents, CAST(indexed AS BIGINT) AS indexed, avg_quality, CAST(coalesce(b.n, 0) AS BIGINT) AS open_conflicts, CAST(coalesce(c.n, 0) AS BIGINT) AS pending_reviews FROM a LEFT JOIN b USING (tenant_id) LEFT JOIN c USING (tenant_id)""")
def _(v):
    return an.dashboard_totals(v("docs"), v("conflicts"), v("reviews"))


@query("d15_latency_last_hour", "SELECT tenant_id, round(avg(latency_ms), 6) AS avg_latency_ms, CAST(count(*) AS BIGINT) AS n FROM {usage} WHERE created_at > stamp('2024-01-30 00:00:00') - INTERVAL 1 HOUR AND created_at <= stamp('2024-01-30 00:00:00') GROUP BY 1")
def _(v):
    return an.latency_last_hour(v("usage"), F.expr("TIMESTAMP_NTZ '2024-01-30 00:00:00'"))


_EXPORT = """SELECT tenant_id, 'documents' AS kind, status AS name, CAST(count(*) AS BIGINT) AS n FROM {docs} GROUP BY ALL UNION ALL SELECT tenant_id, 'claims', 'total', count(*) FROM {claims} GROUP BY 1 UNION ALL SELECT tenant_id, 'claims', 'active', count(*) FILTER (status = 'active') FROM {claims} GROUP BY 1
    UNION ALL SELECT tenant_id, 'usage', event_type, CAST(sum(quantity) AS BIGINT) FROM {usage} GROUP BY ALL"""


@query("d16_export_summary", _EXPORT)
def _(v):
    return an.tenant_export_summary(v("docs"), v("claims"), v("usage"))


@query("d18_tier_distribution", "SELECT index_tier, CAST(count(*) AS BIGINT) AS documents, round(count(*) / sum(count(*)) OVER (), 4) AS share FROM {docs} GROUP BY 1")
def _(v):
    return an.tier_distribution(v("docs"))


@query("a17_metrics_snapshot", """SELECT 'documents_total' AS metric, CAST(count(*) FILTER (status <> 'deleted') AS DOUBLE) AS value FROM {docs} UNION ALL SELECT 'documents_indexed', count(*) FILTER (status = 'indexed') FROM {docs} UNION ALL SELECT 'documents_quarantined', count(*) FILTER (status = 'quarantined') FROM {docs}
    UNION ALL SELECT 'quality_avg', round(avg(quality_score), 4) FROM {docs} UNION ALL SELECT 'chunks_total', count(*) FROM {chunks} UNION ALL SELECT 'claims_total', count(*) FROM {claims} UNION ALL SELECT 'claims_active', count(*) FILTER (status = 'active') FROM {claims}
    UNION ALL SELECT 'conflicts_new', count(*) FILTER (status = 'new') FROM {conflicts} UNION ALL SELECT 'conflicts_resolved', count(*) FILTER (status = 'resolved') FROM {conflicts} UNION ALL SELECT 'reviews_pending', count(*) FILTER (status = 'new') FROM {reviews}
    UNION ALL SELECT 'requests_last_hour', count(*) FROM {usage} WHERE created_at > stamp('2024-01-30 00:00:00') - INTERVAL 1 HOUR AND created_at <= stamp('2024-01-30 00:00:00')
    UNION ALL SELECT 'latency_avg_last_hour', coalesce(round(avg(latency_ms), 6), 0) FROM {usage} WHERE created_at > stamp('2024-01-30 00:00:00') - INTERVAL 1 HOUR AND created_at <= stamp('2024-01-30 00:00:00')""")
def _(v):
    return an.metrics_snapshot(v("docs"), v("chunks"), v("claims"), v("conflicts"), v("reviews"), v("usage"), F.expr("TIMESTAMP_NTZ '2024-01-30 00:00:00'"))


@query("e4_top_hotspot_claims", "SELECT claim_id, confidence FROM {claims} ORDER BY confidence DESC, claim_id LIMIT 50")
def _(v):
    return v("claims").select("claim_id", "confidence").orderBy(F.desc("confidence"), "claim_id").limit(50)


@query("e5_keyset_page", """SELECT document_id, CAST(row_number() OVER (ORDER BY created_at DESC, document_id DESC) AS BIGINT) AS place, true AS has_more FROM (SELECT * FROM {docs} WHERE created_at < stamp('2024-01-01 08:00:00') OR (created_at = stamp('2024-01-01 08:00:00') AND document_id < 480) ORDER BY created_at DESC, document_id DESC LIMIT 20)""")
def _(v):
    import datetime

    return an.keyset_page(v("docs"), 20, (datetime.datetime(2024, 1, 1, 8), 480)).select("document_id", "place", "has_more")


@query("e6_offset_page", "SELECT conflict_id, confidence FROM {conflicts} ORDER BY confidence DESC, conflict_id LIMIT 25 OFFSET 50")
def _(v):
    return an.offset_page(v("conflicts").select("conflict_id", "confidence"), [F.desc("confidence"), F.col("conflict_id")], 25, 50)


@query("e7_review_queue", "SELECT task_id, status FROM {reviews} ORDER BY CASE WHEN status = 'new' THEN 0 ELSE 1 END, created_at DESC NULLS LAST, task_id LIMIT 100")
def _(v):
    return an.review_queue(v("reviews")).select("task_id", "status")
