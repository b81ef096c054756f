"""Queries over changes: the index kept by deltas, aligned plans, changed buckets, replayed streams."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import claim_udtf
from ..operators import incremental as inc
from ..operators import versions as vs
from ..operators.claims import usable_claims
from ..operators.conflicts import checkpointed
from ..sources import delta_feed
from ..sources.buckets import Buckets, scratch
from ..streaming import stored as sd
from .q_knowledge import _EXTRACTED, _norm
from .q_more import _UPSERT, stored
from .registry import query

# Each third claim is withdrawn, each seventh surer than all, each eleventh part's claims are new; documents of one customer in nine go, of another come.
_CHANGED = f"""cc AS (SELECT c.*, c.tenant_id AS t, CAST(split_part(claim_id, '-', 3) AS BIGINT) AS part FROM {{claims}} c), cn AS (SELECT claim_id, document_id, tenant_id, subject, predicate, object_value, CASE WHEN part % 7 = 1 THEN 2 ELSE confidence END AS confidence FROM cc WHERE part % 3 <> 0 AND (CASE WHEN part % 7 = 1 THEN 'active' ELSE status END) = 'active'),
dn AS (SELECT document_id FROM {{claim_docs}} WHERE CASE document_id % 9 WHEN 0 THEN 'quarantined' WHEN 1 THEN 'indexed' ELSE status END NOT IN ('deleted', 'quarantined')),
i AS (SELECT tenant_id, s AS subject_normalized, p AS predicate_normalized, arg_min(subject, o) AS subject, arg_min(predicate, o) AS predicate, arg_min(object_value, o) AS value, max(confidence) AS confidence, count(*) AS claim_count, count(DISTINCT document_id) AS document_count
FROM (SELECT c.*, {_norm('subject')} AS s, {_norm('predicate')} AS p, row_number() OVER (ORDER BY confidence DESC, claim_id) AS o FROM cn c WHERE document_id IN (SELECT document_id FROM dn)) GROUP BY ALL)"""


@query("i18_incremental_index", "WITH " + _CHANGED + " SELECT tenant_id, subject_normalized, predicate_normalized, subject, predicate, value, CAST(confidence AS DOUBLE) AS confidence, CAST(claim_count AS BIGINT) AS claim_count, CAST(document_count AS BIGINT) AS document_count FROM i")
def _(v):
    """The index after a batch of changes, kept up from the index before; the SQL builds it anew."""
    part = F.split("claim_id", "-")[2].cast("long")
    now, docs = v("claims"), v("claim_docs").select("document_id", "status")
    claims = now.filter(part % 11 != 0)
    changed = now.filter((part % 3 == 0) | (part % 7 == 1) | (part % 11 == 0))
    surer = part % 7 == 1
    status = F.when(part % 3 == 0, F.lit(None)).when(surer, "active").otherwise(F.col("status"))
    changed = changed.withColumns({"status": status, "confidence": F.when(surer, 2.0).otherwise(F.col("confidence"))})
    states = docs.filter("document_id % 9 < 2").withColumn("status", F.when(F.col("document_id") % 9 == 0, "quarantined").otherwise("indexed"))
    rows = usable_claims(claims, docs)
    entries, support = checkpointed(inc.entries_of(rows)), checkpointed(inc.support_of(rows))
    claims, docs, gone, came = inc.claim_delta(claims, docs, changed, states)
    touched, _ = inc.apply_changes(entries, support, gone, came, claims, docs)
    return inc.shown(inc.merged(entries, checkpointed(touched)))


_EDITED = "ch AS (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY chunk_index) AS r, count(*) OVER (PARTITION BY document_id, chunk_hash) AS n FROM {chunks})"


@query("i49_aligned_plan", f"WITH {_EDITED} SELECT document_id, CAST(chunk_index + 1 AS BIGINT) AS chunk_index, chunk_index AS old_index, CASE WHEN r % 5 = 3 AND n = 1 THEN 'changed' ELSE 'unchanged' END AS action, r % 5 = 3 AND n = 1 AS embed FROM ch UNION ALL SELECT DISTINCT document_id, CAST(0 AS BIGINT), CAST(NULL AS BIGINT), 'new', true FROM ch")
def _(v):
    """A chunk put before all others, and each fifth one changed where its text is the document's only one."""
    w = Window.partitionBy("document_id")
    rows = v("chunks").select("document_id", "chunk_index", "chunk_hash").withColumn("r", F.row_number().over(w.orderBy("chunk_index")))
    rows = rows.withColumn("n", F.count("*").over(Window.partitionBy("document_id", "chunk_hash")))
    edited = F.when((F.col("r") % 5 == 3) & (F.col("n") == 1), F.concat(F.lit("edited "), "chunk_hash")).otherwise(F.col("chunk_hash"))
    after = rows.select("document_id", (F.col("chunk_index") + 1).alias("chunk_index"), edited.alias("chunk_hash"))
    first = v("chunks").select("document_id").distinct().select("document_id", F.lit(0).cast("long").alias("chunk_index"), F.lit("first").alias("chunk_hash"))
    return vs.aligned_plan(v("chunks").select("document_id", "chunk_index", "chunk_hash"), after.unionByName(first))


_OBJECT = "tenant_id long, source_id string, source_object_id string, content_hash string, content string, version long, change string"


@query("a18_changed_buckets", f"WITH {_UPSERT} SELECT tenant_id, source_id, source_object_id, content_hash, version FROM up")
def _(v):
    """The upsert of a18_upsert into a bucketed table, read back."""
    current, incoming = stored(v)
    table = Buckets(current.sparkSession, scratch(current.sparkSession), tuple(vs.KEY), _OBJECT)
    table.write(0, current.withColumn("change", F.lit("created")).select("tenant_id", "source_id", "source_object_id", "content_hash", "content", "version", "change"))
    table.write(1, vs.upsert_documents(table.read(table.touched(incoming)), incoming))
    return table.read().select("tenant_id", "source_id", "source_object_id", "content_hash", "version")


def in_parts(df, at="at", parts=3):
    """Rows by ten days; all that is later is in the last part."""
    place = F.least(F.floor((F.dayofyear(at) - 1) / 10), F.lit(parts - 1))
    return [df.filter(place == k) for k in range(parts)]


def document_events(v):
    kind = F.when(F.col("event_type") == "error", "deleted").when(F.col("event_type") == "signup", "created").when(F.col("event_type") == "click", "renamed").otherwise("updated")
    text = F.when(F.col("value") < 20, "short").otherwise(F.concat(F.lit("The value of this user was in the range "), F.floor(F.col("value") / 100), F.lit(" when the log was read")))
    return v("events").select(
        kind.alias("event"), F.lit("log").alias("source"), F.col("user_id").cast("string").alias("source_object_id"), F.lit(None).cast("string").alias("title"), F.when(kind == "deleted", F.lit(None)).otherwise(text).alias("content"),
        F.create_map(F.lit("type"), F.col("event_type")).alias("metadata"), F.col("event_id").cast("string").alias("idempotency_key"), F.col("ts").cast("timestamp").alias("at"),
    )


_STREAM = """ev AS (SELECT CASE event_type WHEN 'error' THEN 'deleted' WHEN 'signup' THEN 'created' WHEN 'click' THEN 'renamed' ELSE 'updated' END AS event, CAST(user_id AS VARCHAR) AS obj, CASE WHEN value < 20 THEN 'short' ELSE concat('The value of this user was in the range ', CAST(floor(value / 100) AS BIGINT), ' when the log was read') END AS content, CAST(event_id AS VARCHAR) AS k, ts, CAST(least(floor((dayofyear(ts) - 1) / 10), 2) AS BIGINT) AS part FROM {events}),
ok AS (SELECT *, CASE WHEN event NOT IN ('created', 'updated', 'deleted') THEN 'Unknown event' WHEN event <> 'deleted' AND content = 'short' THEN 'Content too short (5 < 50 chars)' END AS reason FROM ev),
lt AS (SELECT obj, part, event, CASE WHEN event <> 'deleted' THEN content END AS content FROM ok WHERE reason IS NULL QUALIFY row_number() OVER (PARTITION BY obj, part ORDER BY ts DESC, k DESC) = 1),
sq AS (SELECT *, last_value(content IGNORE NULLS) OVER (PARTITION BY obj ORDER BY part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS c0, lag(event) OVER (PARTITION BY obj ORDER BY part) AS e0 FROM lt),
fr AS (SELECT *, CASE WHEN event = 'deleted' THEN CASE WHEN c0 IS NOT NULL THEN 'deleted' END WHEN c0 IS NULL THEN 'created' WHEN c0 <> content OR e0 = 'deleted' THEN 'updated' ELSE 'unchanged' END AS change FROM sq)"""


def replayed_documents(v):
    events = document_events(v)
    at = scratch(events.sparkSession)
    table = Buckets(events.sparkSession, f"{at}/documents", ("source", "source_object_id"), sd.DOCUMENTS)
    sd.replay(in_parts(events), at, lambda rows: sd.sync_changed(rows, table, f"{at}/audit"))
    return table, events.sparkSession.read.schema(sd.AUDIT).parquet(*[f"{at}/audit/batch_{k}" for k in range(3)])


@query("j1_document_stream", f"WITH {_STREAM} SELECT obj AS source_object_id, sha256(arg_max(content, part) FILTER (content IS NOT NULL)) AS content_hash, CAST(count(*) FILTER (change IN ('created', 'updated')) AS BIGINT) AS version, CASE WHEN arg_max(event, part) = 'deleted' THEN 'deleted' ELSE 'indexed' END AS status FROM fr GROUP BY obj HAVING count(content) > 0")
def _(v):
    """Events as a stream of three batches with restarts, into a table of which each batch writes the buckets it touches."""
    return replayed_documents(v)[0].read().select("source_object_id", "content_hash", "version", "status")


@query("j8_audit_stream", f"WITH {_STREAM} SELECT part AS batch, change AS action, 'document' AS resource_type, obj AS resource_id FROM fr WHERE change IN ('created', 'updated', 'deleted') UNION ALL SELECT part, 'rejected', reason, obj FROM ok WHERE reason IS NOT NULL")
def _(v):
    return replayed_documents(v)[1]


@query("j3_boost_stream", "SELECT document_id, round(coalesce(sum(rating), 0) / count(*) * 0.1, 9) AS boost FROM {feedback} GROUP BY 1")
def _(v):
    given = v("feedback").select("document_id", "rating", F.col("created_at").cast("timestamp").alias("at"))
    at = scratch(given.sparkSession)
    table = Buckets(given.sparkSession, f"{at}/boosts", ("document_id",), "document_id long, boost double")
    sd.replay(in_parts(given), at, lambda rows: sd.keep_boosts(rows, table))
    return table.read().select("document_id", F.round("boost", 9).alias("boost"))


_DELIVERED = """dl AS (SELECT event_id * 4 AS delivery_id, true AS taken, ts AS tm, 0 AS later FROM {events} UNION ALL SELECT event_id * 4 + 1, false, ts + INTERVAL 2 HOUR, 0 FROM {events} WHERE event_id % 3 = 0 UNION ALL SELECT event_id * 4 + 2, true, ts + INTERVAL 30 HOUR, 0 FROM {events} WHERE event_id % 7 = 0 UNION ALL SELECT event_id * 4 + 3, false, ts, 1 FROM {events} WHERE event_id % 5 = 0),
pt AS (SELECT *, CAST(least(floor((dayofyear(tm) - 1) / 10), 2) AS BIGINT) + later AS part FROM dl), wm AS (SELECT p.part, max(epoch_us(a.tm)) AS top FROM (SELECT DISTINCT part FROM pt) p JOIN pt a ON a.part < p.part GROUP BY 1)"""


@query("j2_deliveries_once", f"WITH {_DELIVERED} SELECT CAST(delivery_id AS BIGINT) AS delivery_id, taken FROM pt LEFT JOIN wm ON wm.part = pt.part WHERE top IS NULL OR epoch_us(tm) > (top // 1000 - 3600000) * 1000")
def _(v):
    """Each event delivered, some again after two hours, some after thirty, some a batch too late; a key counts again after a day."""
    spark = v("events").sparkSession
    e = v("events").select("event_id", F.concat(F.lit("k"), "event_id").alias("idempotency_key"), F.col("ts").cast("timestamp").alias("at"))
    again = lambda k, every, hours: e.filter(F.col("event_id") % every == 0).select("idempotency_key", (F.col("event_id") * 4 + k).alias("delivery_id"), (F.col("at") + F.expr(f"INTERVAL {hours} HOURS")).alias("at"))
    parts = [*in_parts(again(0, 1, 0).unionByName(again(1, 3, 2)).unionByName(again(2, 7, 30))), None]
    late = [None, *in_parts(again(3, 5, 0))]
    rows = [a if b is None else b if a is None else a.unionByName(b) for a, b in zip(parts, late, strict=True)]
    at, name = scratch(spark), "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        sd.replay(rows, at, lambda r: sd.deliveries(r).writeStream.format("parquet").option("path", f"{at}/out"))
    finally:
        spark.conf.set(name, before)
    return spark.read.parquet(f"{at}/out").select("delivery_id", "taken")


@query("k3_claims_by_table_function", _EXTRACTED)
def _(v):
    """i16_extract_claims as SQL with a table function."""
    chunks = v("chunks").select("document_id", "chunk_id", "chunk_index", "chunk_text")
    claim_udtf.register(chunks.sparkSession, "extract_claims")
    return chunks.sparkSession.sql("SELECT document_id, chunk_id, subject, predicate, object_value FROM extract_claims(TABLE(SELECT * FROM {chunks}))", chunks=chunks)


_FEED = """WITH ff AS (SELECT *, CASE WHEN document_id % 6 = 3 THEN 'deleted' ELSE 'updated' END AS e FROM {docs} WHERE document_id IS NOT NULL)
SELECT CAST(document_id AS VARCHAR) AS source_object_id, CASE WHEN document_id % 3 = 0 AND e = 'updated' THEN CAST(2 AS BIGINT) ELSE CAST(1 AS BIGINT) END AS version, CASE WHEN document_id % 3 = 0 AND e = 'deleted' THEN 'deleted' ELSE 'indexed' END AS status FROM ff"""


@query("j6_feed_stream", _FEED)
def _(v):
    """Documents as a feed of pages of some hundred items: a first run with all, a second with the changed and the deleted."""
    docs = v("docs")
    spark = docs.sparkSession
    at = scratch(spark)
    text = F.concat(F.lit("A document with this content hash stands in the feed: "), F.coalesce("content_hash", F.lit("none")))
    item = docs.select(F.col("document_id").alias("id"), F.lit(False).alias("deleted"), text.alias("content"), F.lit("2024-01-01T00:00:00+00:00").alias("at"), F.floor(F.col("document_id") / 100).alias("page"))
    changed = item.filter("id % 3 = 0").withColumns({"deleted": F.col("id") % 6 == 3, "content": F.concat("content", F.lit(", revised")), "at": F.lit("2024-01-02T00:00:00+00:00")})
    delta_feed.register(spark)
    table = Buckets(spark, f"{at}/documents", ("source", "source_object_id"), sd.DOCUMENTS)
    for run, rows in ((1, item), (2, changed)):
        rows.repartition("page").write.partitionBy("page").json(f"{at}/feed/run={run}")
        events = spark.readStream.format("delta_feed").option("path", f"{at}/feed").load()
        run_on = sd.sync_changed(events, table).option("checkpointLocation", f"{at}/cursor").start()
        try:
            run_on.processAllAvailable()
        finally:
            run_on.stop()
    return table.read().select("source_object_id", "version", "status")
