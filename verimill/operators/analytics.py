"""Aggregates over documents, claims, conflicts and usage, orderings and pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def by_document(conflicts: DataFrame) -> DataFrame:
    """Conflicts once for each document they touch: an equi-join key in place of 'a or b'."""
    return conflicts.withColumn("document_id", F.explode(F.array_distinct(F.array("document_a_id", "document_b_id"))))


def quality_by_source(docs: DataFrame, sources: DataFrame) -> DataFrame:
    """(tenant_id, source_id, documents, avg_quality, min_quality, low_quality, quarantined, name, source_type), worst first in each tenant.

    Documents without a score count as documents; those without a known source are left out; quarantined is what review says.
    """
    per = docs.filter("status <> 'deleted'").groupBy("tenant_id", "source_id").agg(
        F.count("*").alias("documents"),
        F.round(F.avg("quality_score"), 6).alias("avg_quality"),
        F.round(F.min("quality_score"), 3).alias("min_quality"),
        F.count_if(F.col("quality_score") < 0.5).alias("low_quality"),
        F.count_if(F.col("review_status") == "quarantined").alias("quarantined"),
    )
    return per.join(sources.select("source_id", "name", "source_type"), "source_id").orderBy("tenant_id", F.asc_nulls_last("avg_quality"), "source_id")


def hotspots(conflicts: DataFrame, docs: DataFrame, sources: DataFrame, most: int = 20) -> DataFrame:
    """(tenant_id, document_id, title, source_name, conflicts, unresolved, avg_confidence, rank): each tenant's `most` documents with the most
    unresolved conflicts, then the most conflicts, ties by id. Conflicts are counted before documents are joined."""
    per = by_document(conflicts).groupBy("tenant_id", "document_id").agg(F.count("*").alias("conflicts"), F.count_if(F.col("status") == "new").alias("unresolved"), F.round(F.avg("confidence"), 6).alias("avg_confidence"))
    named = docs.select("document_id", "title", "source_id").join(sources.select("source_id", F.col("name").alias("source_name")), "source_id")
    order = Window.partitionBy("tenant_id").orderBy(F.desc("unresolved"), F.desc("conflicts"), "document_id")
    top = per.join(named, "document_id").withColumn("rank", F.row_number().over(order).cast("long")).filter(F.col("rank") <= most)
    return top.select("tenant_id", "document_id", "title", "source_name", "conflicts", "unresolved", "avg_confidence", "rank")


def claim_stability(claims: DataFrame, docs: DataFrame) -> DataFrame:
    """Per tenant of the claims' documents: claims in all and by state, documents that have any, and the share that wasn't superseded."""
    rows = claims.drop("tenant_id").join(docs.select("document_id", "tenant_id"), "document_id")
    state = lambda s: F.count_if(F.col("status") == s)
    per = rows.groupBy("tenant_id").agg(F.count("*").alias("total"), state("active").alias("active"), state("superseded").alias("superseded"), state("rejected").alias("rejected"), F.countDistinct("document_id").alias("documents"))
    return per.withColumn("stability", F.round(1 - F.col("superseded") / F.col("total"), 4))


def since(df: DataFrame, now: Column, period: str, at: str = "created_at") -> DataFrame:
    days = {"day": 1, "week": 7, "month": 30}[period]
    return df.filter((F.col(at) > now - F.make_dt_interval(F.lit(days))) & (F.col(at) <= now))


def usage_summary(usage: DataFrame, now: Column, period: str) -> DataFrame:
    return since(usage, now, period).groupBy("tenant_id", "event_type").agg(F.sum("quantity").alias("quantity"), F.count("*").alias("events"))


def month_to_date(usage: DataFrame, now: Column) -> DataFrame:
    return usage.filter((F.col("created_at") >= F.date_trunc("month", now)) & (F.col("created_at") <= now))


def quota_view(tenants: DataFrame, docs: DataFrame, sources: DataFrame, usage: DataFrame, now: Column, query_event: str = "view") -> DataFrame:
    """Per tenant: documents, queries this month (events and summed quantity) and sources, against the plan's limits."""
    documents = docs.filter("status <> 'deleted'").groupBy("tenant_id").agg(F.count("*").alias("documents"))
    month = month_to_date(usage, now).filter(F.col("event_type") == query_event).groupBy("tenant_id").agg(F.count("*").alias("queries"), F.sum("quantity").alias("query_quantity"))
    owned = sources.groupBy("tenant_id").agg(F.count("*").alias("sources"))
    out = tenants
    for side in (documents, month, owned):
        out = out.join(side, "tenant_id", "left")
    return out.fillna(0, ["documents", "queries", "query_quantity", "sources"])


def check_quota(quota: DataFrame) -> DataFrame:
    reason = F.when(F.col("documents") >= F.col("max_documents"), "document limit reached").when(F.col("queries") >= F.col("max_queries_per_month"), "query limit reached").when(F.col("sources") >= F.col("max_sources"), "source limit reached")
    return quota.withColumn("reason", reason).withColumn("allowed", F.col("reason").isNull())


def source_tree(sources: DataFrame, docs: DataFrame, conflicts: DataFrame, claims: DataFrame | None = None) -> DataFrame:
    """Counts for each source, also one without documents, and for each folder in it; folder NULL is the source's own row.

    A document's folder is metadata's folder_path (if there is a map doc_metadata), else what stands before the last slash of its path, else
    '(root)'. Quarantined is what review says; conflicted documents are named by an open conflict.
    """
    touched = by_document(conflicts.filter("status = 'new'")).select("document_id").distinct().withColumn("conflicted", F.lit(1))
    set_ = lambda c: F.nullif(c, F.lit(""))
    folder = [set_(F.regexp_extract("source_path", r"^(.*)/[^/]*$", 1)), F.lit("(root)")]
    if "doc_metadata" in docs.columns:
        at = F.coalesce(set_(F.col("doc_metadata")["source_path"]), set_(F.col("doc_metadata")["path"]), "source_path")
        folder = [set_(F.col("doc_metadata")["folder_path"]), set_(F.regexp_extract(at, r"^(.*)/[^/]*$", 1)), F.lit("(root)")]
    rows = docs.filter("status <> 'deleted'").withColumn("folder", F.coalesce(*folder)).join(touched, "document_id", "left")
    if claims is not None:
        active = claims.filter("status = 'active'").groupBy("document_id").agg(F.count("*").alias("active_claims"))
        rows = rows.join(active, "document_id", "left")
    else:
        rows = rows.withColumn("active_claims", F.lit(0).cast("long"))
    per = rows.rollup("source_id", "folder").agg(
        F.count("*").alias("documents"),
        F.count_if(F.col("status") == "indexed").alias("indexed"),
        F.count_if(F.col("review_status") == "quarantined").alias("quarantined"),
        F.count("conflicted").alias("conflicted"),
        F.round(F.avg("quality_score"), 6).alias("avg_quality"),
        F.min("quality_score").alias("min_quality"),
        F.sum("chunk_count").alias("chunks"),
        F.coalesce(F.sum("active_claims"), F.lit(0)).alias("active_claims"),
        F.grouping_id().alias("g"),
    ).filter("g < 3").drop("g")
    named = sources.select("source_id", "tenant_id", "name", "source_type")
    return named.join(per, "source_id", "left").fillna(0, ["documents", "indexed", "quarantined", "conflicted", "chunks", "active_claims"])


def feedback_boost(feedback: DataFrame, key: str = "document_id", weight: float = 0.1) -> DataFrame:
    return feedback.groupBy(key).agg((F.sum("rating") / F.greatest(F.count("*"), F.lit(1)) * weight).alias("boost"))


def feedback_log_boost(feedback: DataFrame, key: str = "document_id", weight: float = 0.1) -> DataFrame:
    return feedback.groupBy(key).agg((F.avg("rating") * F.log(F.count("*") + F.lit(1.0)) * weight).alias("boost"))


def document_counts(docs: DataFrame) -> DataFrame:
    return docs.filter("status <> 'deleted'").groupBy("tenant_id").agg(F.count("*").alias("total"), F.count_if(F.col("status") == "indexed").alias("indexed"), F.count_if(F.col("status") == "quarantined").alias("quarantined"))


def quality_overview(docs: DataFrame) -> DataFrame:
    rows = docs.filter("status <> 'deleted' AND quality_score IS NOT NULL")
    q = F.col("quality_score")
    return rows.groupBy("tenant_id").agg(F.round(F.avg(q), 2).alias("avg_score"), F.round(F.min(q), 2).alias("min_score"), F.round(F.max(q), 2).alias("max_score"), F.count_if(q >= 0.8).alias("high_quality"), F.count_if(q < 0.5).alias("low_quality"))


def conflict_summary(conflicts: DataFrame) -> DataFrame:
    return conflicts.groupBy("tenant_id", "status").agg(F.count("*").alias("n"))


def dashboard_totals(docs: DataFrame, conflicts: DataFrame, reviews: DataFrame) -> DataFrame:
    a = docs.filter("status <> 'deleted'").groupBy("tenant_id").agg(F.count("*").alias("documents"), F.count_if(F.col("status") == "indexed").alias("indexed"), F.round(F.avg("quality_score"), 6).alias("avg_quality"))
    b = conflicts.filter("status = 'new'").groupBy("tenant_id").agg(F.count("*").alias("open_conflicts"))
    c = reviews.filter("status = 'new'").groupBy("tenant_id").agg(F.count("*").alias("pending_reviews"))
    return a.join(b, "tenant_id", "left").join(c, "tenant_id", "left").fillna(0, ["open_conflicts", "pending_reviews"])


def latency_last_hour(usage: DataFrame, now: Column) -> DataFrame:
    return usage.filter((F.col("created_at") > now - F.expr("INTERVAL 1 HOUR")) & (F.col("created_at") <= now)).groupBy("tenant_id").agg(F.round(F.avg("latency_ms"), 6).alias("avg_latency_ms"), F.count("*").alias("n"))


def tier_distribution(docs: DataFrame) -> DataFrame:
    per = docs.groupBy("index_tier").agg(F.count("*").alias("documents"))
    return per.withColumn("share", F.round(F.col("documents") / F.sum("documents").over(Window.partitionBy()), 4))


def tenant_export_summary(docs: DataFrame, claims: DataFrame, usage: DataFrame) -> DataFrame:
    """Long form (tenant_id, kind, name, n): documents by status, claims in all and active, usage by type."""
    d = docs.groupBy("tenant_id", F.lit("documents").alias("kind"), F.col("status").alias("name")).agg(F.count("*").alias("n"))
    c = claims.groupBy("tenant_id").agg(F.count("*").alias("total"), F.count_if(F.col("status") == "active").alias("active")).select("tenant_id", F.lit("claims").alias("kind"), F.expr("stack(2, 'total', total, 'active', active) AS (name, n)"))
    u = usage.groupBy("tenant_id", F.lit("usage").alias("kind"), F.col("event_type").alias("name")).agg(F.sum("quantity").alias("n"))
    return d.unionByName(c).unionByName(u)


def metrics_snapshot(docs: DataFrame, chunks: DataFrame, claims: DataFrame, conflicts: DataFrame, reviews: DataFrame, usage: DataFrame, now: Column) -> DataFrame:
    """(metric, value): twelve gauges in long form, one pass a table."""

    def long(df: DataFrame, **metrics: Column) -> DataFrame:
        one = df.agg(*[F.coalesce(c.cast("double"), F.lit(0.0)).alias(k) for k, c in metrics.items()])
        return one.select(F.expr(f"stack({len(metrics)}, " + ", ".join(f"'{k}', {k}" for k in metrics) + ") AS (metric, value)"))

    hour = usage.filter((F.col("created_at") > now - F.expr("INTERVAL 1 HOUR")) & (F.col("created_at") <= now))
    status = F.col("status")
    parts = [
        long(docs, documents_total=F.count_if(status != "deleted"), documents_indexed=F.count_if(status == "indexed"), documents_quarantined=F.count_if(status == "quarantined"), quality_avg=F.round(F.avg("quality_score"), 4)),
        long(chunks, chunks_total=F.count("*")),
        long(claims, claims_total=F.count("*"), claims_active=F.count_if(status == "active")),
        long(conflicts, conflicts_new=F.count_if(status == "new"), conflicts_resolved=F.count_if(status == "resolved")),
        long(reviews, reviews_pending=F.count_if(status == "new")),
        long(hour, requests_last_hour=F.count("*"), latency_avg_last_hour=F.round(F.avg("latency_ms"), 6)),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def keyset_page(df: DataFrame, size: int, after: tuple | None = None) -> DataFrame:
    """A page of documents, newest first, behind the row (created_at, document_id); has_more tells whether another follows."""
    rows = df if after is None else df.filter((F.col("created_at") < F.lit(after[0])) | ((F.col("created_at") == F.lit(after[0])) & (F.col("document_id") < F.lit(after[1]))))
    top = rows.orderBy(F.desc("created_at"), F.desc("document_id")).limit(size + 1)
    n = Window.orderBy(F.desc("created_at"), F.desc("document_id"))  # over a page, size + 1 rows
    page = top.withColumn("place", F.row_number().over(n).cast("long")).withColumn("has_more", F.count("*").over(Window.partitionBy()) > size)
    return page.filter(F.col("place") <= size)


def offset_page(df: DataFrame, order: list[Column], size: int, offset: int) -> DataFrame:
    return df.orderBy(*order).offset(offset).limit(size)


def review_queue(reviews: DataFrame, most: int = 100) -> DataFrame:
    """Open tasks first, then the newest."""
    return reviews.orderBy(F.when(F.col("status") == "new", 0).otherwise(1), F.desc_nulls_last("created_at"), "task_id").limit(most)
