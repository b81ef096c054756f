"""Filters and predicates over documents, access lists, events and cursors."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Review states that search never shows.
HIDDEN = ("quarantined", "rejected", "superseded")
# Patterns of content that is refused.
BLOCKLIST = (r"(?i)^This page is auto-generated", r"(?im)^\s*\[?TODO\]?\s*$", r"(?i)^Lorem ipsum")
MIN_CONTENT = 50


def scan(df: DataFrame, tenant: int | None = None) -> DataFrame:
    """A table, of one tenant if one is named; tables at rest are partitioned by tenant_id."""
    return df if tenant is None else df.filter(F.col("tenant_id") == tenant)


def searchable(docs: DataFrame) -> DataFrame:
    return docs.filter((F.col("status") == "indexed") & ~F.col("review_status").isin(*HIDDEN))


def by_source_type(docs: DataFrame, sources: DataFrame, *source_types: str) -> DataFrame:
    return docs.join(sources.filter(F.col("source_type").isin(*source_types)).select("source_id"), "source_id", "left_semi")


def by_doc_type(docs: DataFrame, doc_type: str) -> DataFrame:
    return docs.filter(F.col("doc_type") == doc_type)


def by_metadata(docs: DataFrame, wanted: dict[str, str], column: str = "doc_metadata") -> DataFrame:
    """Documents whose metadata map has all the wanted values."""
    return docs.filter(reduce(Column.__and__, [F.col(column)[k] == v for k, v in wanted.items()], F.lit(True)))


def acl_visible(docs: DataFrame, acl: DataFrame, principals: DataFrame) -> DataFrame:
    """(principal_id, document_id) of what each principal may read: documents whose access list names it, and those without one, which are one
    row with a null principal_id: everyone's. Who asks for one principal's takes its rows and the null ones."""
    opened = docs.join(acl.select("document_id").distinct(), "document_id", "left_anti").select(F.lit(None).cast("long").alias("principal_id"), "document_id")
    named = acl.filter(F.col("permission").isin("read", "write", "admin")).join(principals.select("principal_id").distinct(), "principal_id", "left_semi").join(docs.select("document_id"), "document_id", "left_semi")
    return opened.unionByName(named.select("principal_id", "document_id").distinct())


def validate_events(events: DataFrame, content: str = "content", required: dict[str, list[str]] | None = None, allowed: dict[str, list[str]] | None = None, minimum: dict[str, int] | None = None) -> DataFrame:
    """events with valid and reason; the first failure decides. Rules may differ by `source`; metadata is a map column."""
    text = F.regexp_replace(F.coalesce(F.col(content), F.lit("")), r"^\s+|\s+$", "")
    least = F.lit(MIN_CONTENT)
    for source, n in (minimum or {}).items():
        least = F.when(F.col("source") == source, n).otherwise(least)
    reason = F.when(text == "", "Empty content").when(F.length(text) < least, F.concat(F.lit("Content too short ("), F.length(text), F.lit(" < "), least, F.lit(" chars)")))
    for source, keys in (required or {}).items():
        missing = F.array_except(F.array(*map(F.lit, keys)), F.map_keys("metadata"))
        reason = reason.when((F.col("source") == source) & (F.size(missing) > 0), F.concat(F.lit("Missing required metadata: "), F.array_join(missing, ", ")))
    for source, states in (allowed or {}).items():
        state = F.lower(F.col("metadata")["status"])
        reason = reason.when((F.col("source") == source) & (state != "") & ~state.isin(*states), F.concat(F.lit("Status '"), state, F.lit("' not in allowed")))
    for pattern in BLOCKLIST:
        reason = reason.when(F.col(content).rlike(pattern), F.lit("Content matches blocklist pattern"))
    return events.withColumn("reason", reason).withColumn("valid", F.col("reason").isNull())


def listing(df: DataFrame, **wanted: str | None) -> DataFrame:
    """Rows that match the filters that are given; a filter of None isn't applied."""
    return reduce(lambda d, kv: d if kv[1] is None else d.filter(F.col(kv[0]) == kv[1]), wanted.items(), df)


def eligible_chunks(chunks: DataFrame, least: int = 30, most: int = 50) -> DataFrame:
    """Chunks that claims are extracted from: long enough, and the first `most` of each document."""
    order = Window.partitionBy("document_id").orderBy("chunk_index")
    return chunks.filter(F.length(F.trim("chunk_text")) >= least).withColumn("__r", F.row_number().over(order)).filter(F.col("__r") <= most).drop("__r")


def due_sources(sources: DataFrame, cursors: DataFrame, now: Column) -> DataFrame:
    """Sources to synchronise: auto_sync, not running, and never synchronised or longer ago than their interval."""
    joined = sources.join(cursors.select("source_id", "source_type", "last_sync_at", "sync_status"), ["source_id", "source_type"], "left")
    late = F.col("last_sync_at").isNull() | (F.col("last_sync_at") + F.make_interval(mins=F.col("interval_minutes")) < now)
    return joined.filter(F.col("auto_sync") & late & (F.coalesce("sync_status", F.lit("idle")) != "running"))
