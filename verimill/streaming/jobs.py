"""Streaming operators: validated upserts, idempotent delivery, running boosts, usage windows, change capture, quality gate, audit."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import content_hash
from ..operators.filters import validate_events
from ..operators.quality import decide

#: Shape of an inbound document event.
EVENT = "event string, source string, source_object_id string, title string, content string, metadata map<string,string>, idempotency_key string, at timestamp"


def read_events(spark: SparkSession, path: str, per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(EVENT)
    return (reader.option("maxFilesPerTrigger", per_trigger) if per_trigger else reader).json(path)


def once(events: DataFrame, delay: str = "1 day", at: str = "at", key: str = "idempotency_key") -> DataFrame:
    """Events without repeats of their key inside the watermark."""
    return events.withWatermark(at, delay).dropDuplicatesWithinWatermark([key])


def checked(events: DataFrame) -> DataFrame:
    """events with valid and reason. Deletions need no content; unknown kinds of event are refused; the title heads content without frontmatter."""
    seen = validate_events(events)
    known = F.col("event").isin("created", "updated", "deleted")
    reason = F.when(~known, "Unknown event").when(F.col("event") == "deleted", F.lit(None)).otherwise(F.col("reason"))
    headed = F.when(F.col("title").isNotNull() & ~F.startswith("content", F.lit("---")), F.concat(F.lit("# "), "title", F.lit("\n\n"), "content")).otherwise(F.col("content"))
    return seen.withColumns({"reason": reason, "content": headed}).withColumn("valid", F.col("reason").isNull())


def latest(events: DataFrame) -> DataFrame:
    """The last event of each object in a batch."""
    w = Window.partitionBy("source", "source_object_id").orderBy(F.desc("at"), F.desc("idempotency_key"))
    return events.withColumn("__r", F.row_number().over(w)).filter("__r = 1").drop("__r")


def apply_changes(current: DataFrame, batch: DataFrame) -> DataFrame:
    """Next documents (source, source_object_id, content, content_hash, version, status, change) after a batch of valid events.

    Unchanged content keeps its version; a deleted object stays as a row with status deleted; what the batch doesn't name is untouched.
    """
    b = latest(batch).select("source", "source_object_id", F.col("event").alias("e"), F.col("content").alias("c1"), content_hash(F.col("content")).alias("h1"))
    a = current.select("source", "source_object_id", F.col("content").alias("c0"), F.col("content_hash").alias("h0"), F.col("version").alias("v0"), F.col("status").alias("s0"))
    both = a.join(b, ["source", "source_object_id"], "full_outer").filter("NOT (e <=> 'deleted' AND v0 IS NULL)")
    fresh = F.col("e").isin("created", "updated") & ((F.coalesce("h0", F.lit("")) != F.col("h1")) | (F.coalesce("s0", F.lit("")) == "deleted"))
    fresh = F.coalesce(fresh, F.lit(False))
    gone = F.coalesce(F.col("e") == "deleted", F.lit(False))
    change = F.when(F.col("e").isNull(), "untouched").when(gone, "deleted").when(F.col("v0").isNull(), "created").when(fresh, "updated").otherwise("unchanged")
    return both.select(
        "source",
        "source_object_id",
        F.when(fresh, F.col("c1")).otherwise(F.col("c0")).alias("content"),
        F.when(fresh, F.col("h1")).otherwise(F.col("h0")).alias("content_hash"),
        (F.coalesce("v0", F.lit(0)) + fresh.cast("int")).cast("long").alias("version"),
        F.when(gone, "deleted").when(fresh, "indexed").otherwise(F.col("s0")).alias("status"),
        change.alias("change"),
    )


def sync(events: DataFrame, load: Callable[[], DataFrame], store: Callable[[DataFrame, int], None], audit: Callable[[DataFrame], None] | None = None):
    """A stream writer that applies each batch to the stored table; start it with a checkpoint, which is the change cursor.

    store(df, batch_id) replaces the table as that batch's; a batch that is run again after a failure leads to the same table, and audit
    rows carry the batch, so repeats can be told.
    """

    def batch(df: DataFrame, batch_id: int) -> None:
        rows = checked(df)
        after = apply_changes(load(), rows.filter("valid"))
        store(after, batch_id)
        if audit is not None:
            audit(after.filter("change IN ('created', 'updated', 'deleted')").select(F.lit(batch_id).alias("batch"), F.col("change").alias("action"), F.lit("document").alias("resource_type"), F.col("source_object_id").alias("resource_id")))
            audit(rows.filter("NOT valid").select(F.lit(batch_id).alias("batch"), F.lit("rejected").alias("action"), F.col("reason").alias("resource_type"), F.col("source_object_id").alias("resource_id")))

    return events.writeStream.foreachBatch(batch)


def running_boost(feedback: DataFrame, weight: float = 0.1) -> DataFrame:
    """Sum of ratings by their number over all history, for each document; update mode."""
    return feedback.groupBy("document_id").agg((F.sum("rating") / F.greatest(F.count("*"), F.lit(1)) * weight).alias("boost"))


def usage_windows(usage: DataFrame, width: str = "1 day", delay: str = "1 day") -> DataFrame:
    """Quantity and events for each tenant, type and tumbling window; late rows behind the watermark are dropped by Spark and counted by it."""
    w = usage.withWatermark("created_at", delay).groupBy(F.window("created_at", width).alias("w"), "tenant_id", "event_type").agg(F.sum("quantity").alias("quantity"), F.count("*").alias("events"))
    return w.select(F.col("w.start").alias("start"), "tenant_id", "event_type", "quantity", "events")


def latency_windows(usage: DataFrame, width: str = "1 hour", slide: str = "10 minutes", delay: str = "1 day") -> DataFrame:
    """Mean latency over sliding windows."""
    w = usage.withWatermark("created_at", delay).groupBy(F.window("created_at", width, slide).alias("w")).agg(F.avg("latency_ms").alias("avg_latency_ms"), F.count("*").alias("n"))
    return w.select(F.col("w.start").alias("start"), "avg_latency_ms", "n")


def gate(docs: DataFrame) -> DataFrame:
    """Stateless checks of new documents: quality_score and review_status without what needs chunks or other documents."""
    text = F.regexp_replace(F.coalesce("text", F.lit("")), r"^\s+|\s+$", "")
    n = F.length(text)
    lines = F.filter(F.split(text, "\n"), lambda x: F.trim(x) != "")
    plate = (F.size(lines) >= 5) & (F.size(F.array_distinct(lines)) / F.greatest(F.size(lines), F.lit(1)) < 0.5)
    cost = F.when(n == 0, 0.9).when(n < 10, 0.4).when(n < 50, 0.15).otherwise(0.0) + F.when(F.coalesce("title", F.lit("")) == "", 0.1).otherwise(0.0) + F.when(plate, 0.15).otherwise(0.0)
    value = F.round(F.greatest(F.lit(0.0), 1 - cost), 3)
    return docs.withColumn("quality_score", value).withColumn("review_status", decide(F.col("quality_score"), n < 10))
