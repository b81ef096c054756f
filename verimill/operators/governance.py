"""Governance: decisions applied to tables, verdicts, tiering, retention, erasure. Each transform returns the next version of a table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RESOLUTIONS = ("keep_a", "keep_b", "keep_both", "reject_both", "dismiss")


def document_states(conflicts: DataFrame, decisions: DataFrame) -> DataFrame:
    """(document_id, new_status) that decisions (conflict_id, resolution) lead to; rejected outranks superseded."""
    d = conflicts.join(decisions.select("conflict_id", "resolution"), "conflict_id")
    r = F.col("resolution")
    both = F.array(F.struct(F.col("document_a_id").alias("document_id"), F.when(r == "keep_b", "superseded").when(r == "reject_both", "rejected").alias("new_status")), F.struct(F.col("document_b_id").alias("document_id"), F.when(r == "keep_a", "superseded").when(r == "reject_both", "rejected").alias("new_status")))
    return d.select(F.inline(both)).filter("new_status IS NOT NULL").groupBy("document_id").agg(F.min("new_status").alias("new_status"))


def apply_resolutions(docs: DataFrame, claims: DataFrame, conflicts: DataFrame, tasks: DataFrame, decisions: DataFrame) -> dict[str, DataFrame]:
    """The next docs, claims, conflicts and review tasks. Claims follow their document; keep_both adds its contexts to evidence of active
    claims, if claims have an evidence column; resolved conflicts keep the resolution; their open tasks are approved."""
    states = document_states(conflicts, decisions)
    s = states.select(F.col("document_id").alias("__d"), F.col("new_status").alias("__s"))
    out = {"docs": docs.join(s, F.col("document_id") == F.col("__d"), "left").withColumn("review_status", F.coalesce("__s", "review_status")).drop("__d", "__s")}
    out["claims"] = claims.join(s, F.col("document_id") == F.col("__d"), "left").withColumn("status", F.when(F.col("status") == "active", F.coalesce("__s", "status")).otherwise(F.col("status"))).drop("__d", "__s")
    if "evidence" in claims.columns and "context_a" in decisions.columns:
        kept = conflicts.join(decisions.filter("resolution = 'keep_both'"), "conflict_id")
        notes = kept.select(F.inline(F.array(F.struct(F.col("document_a_id").alias("__d"), F.col("context_a").alias("__n")), F.struct(F.col("document_b_id").alias("__d"), F.col("context_b").alias("__n"))))).filter("__n IS NOT NULL")
        notes = notes.groupBy("__d").agg(F.array_join(F.array_sort(F.collect_set("__n")), "; ").alias("__n"))
        out["claims"] = out["claims"].join(notes, F.col("document_id") == F.col("__d"), "left").withColumn("evidence", F.when(F.col("__n").isNotNull() & (F.col("status") == "active"), F.concat("evidence", F.lit(" [Context: "), "__n", F.lit("]"))).otherwise(F.col("evidence"))).drop("__d", "__n")
    r = decisions.select(F.col("conflict_id").alias("__c"), F.col("resolution").alias("__r"))
    out["conflicts"] = conflicts.join(r, F.col("conflict_id") == F.col("__c"), "left").withColumns({"status": F.when(F.col("__r").isNotNull(), "resolved").otherwise(F.col("status")), "resolution": F.col("__r")}).drop("__c", "__r")
    out["tasks"] = tasks.join(r, F.col("conflict_id") == F.col("__c"), "left").withColumn("status", F.when(F.col("__r").isNotNull() & (F.col("status") == "new"), "approved").otherwise(F.col("status"))).drop("__c", "__r")
    return out


def apply_reviews(docs: DataFrame, tasks: DataFrame, decisions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Next docs and tasks for decisions (task_id, action): approve publishes, reject rejects."""
    d = tasks.join(decisions, "task_id").select("document_id", F.when(F.col("action") == "approve", "published").otherwise("rejected").alias("__s")).groupBy("document_id").agg(F.max("__s").alias("__s"))
    after = docs.join(d, "document_id", "left").withColumn("review_status", F.coalesce("__s", "review_status")).drop("__s")
    done = tasks.join(decisions, "task_id", "left").withColumn("status", F.when(F.col("action") == "approve", "approved").when(F.col("action") == "reject", "rejected").otherwise(F.col("status"))).drop("action")
    return after, done


def parse_verdicts(replies: DataFrame) -> DataFrame:
    """(reply_id, resolution, confidence, reason) of a judge's replies: an unknown resolution is keep_both, confidence 0.5 if absent, clamped."""
    body = F.regexp_extract(F.regexp_replace("raw", r"(?s)<think>.*?</think>", ""), r"(?s)(\{.*\})", 1)
    v = F.from_json(body, "resolution string, confidence double, reason string")
    return replies.select("reply_id", v.alias("v")).select("reply_id", F.when(F.col("v.resolution").isin("keep_a", "keep_b", "keep_both"), F.col("v.resolution")).otherwise("keep_both").alias("resolution"), F.least(F.greatest(F.coalesce("v.confidence", F.lit(0.5)), F.lit(0.0)), F.lit(1.0)).alias("confidence"), F.col("v.reason").alias("reason"))


def source_authority(docs: DataFrame, sources: DataFrame, *order: str) -> DataFrame:
    """docs with authority: the place of its source's type in `order`, the least trusted first; others and documents without a source 0."""
    place = F.array_position(F.array(*map(F.lit, order)), F.col("source_type"))
    known = sources.select("source_id", place.alias("authority"))
    return docs.join(known, "source_id", "left").withColumn("authority", F.coalesce("authority", F.lit(0)))


def claim_support(claims: DataFrame) -> DataFrame:
    """(document_id, support): how many statements (predicate and value) of a document's active claims another document of its tenant makes too."""
    said = claims.filter("status = 'active'").select("tenant_id", "document_id", F.lower(F.trim("predicate")).alias("p"), F.lower(F.trim("object_value")).alias("v")).distinct()
    shared = said.groupBy("tenant_id", "p", "v").agg(F.count("*").alias("n")).filter("n > 1")
    return said.join(shared, ["tenant_id", "p", "v"], "left_semi").groupBy("document_id").agg(F.count("*").alias("support"))


def heuristic_verdicts(conflicts: DataFrame, docs: DataFrame, support: DataFrame | None = None) -> DataFrame:
    """(conflict_id, resolution, confidence): recency, then source authority (docs.authority), then length as specificity, then consistency with
    what others claim (`support`: document_id, support; 0 where it lacks a document); equal documents are both kept.

    A deterministic stand-in for a model's judgement; a verdict table takes its place.
    """
    backed = docs.withColumn("support", F.lit(0)) if support is None else docs.join(support.select("document_id", "support"), "document_id", "left").fillna(0, ["support"])
    side = lambda s: backed.select(F.col("document_id").alias(f"document_{s}_id"), F.struct("created_at", "authority", F.length("text").alias("size"), "support").alias(s))
    j = conflicts.join(side("a"), "document_a_id").join(side("b"), "document_b_id")
    a, b = F.col("a"), F.col("b")
    days = F.abs(F.datediff(a["created_at"], b["created_at"]))
    newer = F.when(a["created_at"] > b["created_at"], "keep_a").otherwise("keep_b")
    out = F.when(days >= 1, newer).when(a["authority"] != b["authority"], F.when(a["authority"] > b["authority"], "keep_a").otherwise("keep_b")).when(a["size"] != b["size"], F.when(a["size"] > b["size"], "keep_a").otherwise("keep_b")).when(a["support"] != b["support"], F.when(a["support"] > b["support"], "keep_a").otherwise("keep_b")).otherwise("keep_both")
    sure = F.when(days >= 1, 0.9).when(a["authority"] != b["authority"], 0.85).when(a["size"] != b["size"], 0.6).when(a["support"] != b["support"], 0.55).otherwise(0.5)
    return j.select("conflict_id", out.alias("resolution"), sure.alias("confidence"))


def auto_resolve(conflicts: DataFrame, verdicts: DataFrame, most: int = 50, least: float = 0.85) -> tuple[DataFrame, DataFrame]:
    """Decisions for each tenant's surest `most` open contradictions whose verdict is keep_a or keep_b at `least` or more; and per tenant
    (judged, auto_resolved, kept_open)."""
    order = Window.partitionBy("tenant_id").orderBy(F.desc("confidence"), "conflict_id")
    top = conflicts.filter("status = 'new' AND conflict_type = 'contradiction'").withColumn("__r", F.row_number().over(order)).filter(F.col("__r") <= most).select("tenant_id", "conflict_id")
    judged = top.join(verdicts, "conflict_id")
    auto = F.col("resolution").isin("keep_a", "keep_b") & (F.col("confidence") >= least)
    stats = judged.groupBy("tenant_id").agg(F.count("*").alias("judged"), F.count_if(auto).alias("auto_resolved"), F.count_if(~auto).alias("kept_open"))
    return judged.filter(auto).select("tenant_id", "conflict_id", "resolution"), stats


def tier_sweep(docs: DataFrame, now: Column) -> DataFrame:
    """docs with new_tier: cold, then warm, then hot rules in turn, each on what the one before left; so a document may move twice."""
    q, seen, live = F.col("quality_score"), F.col("last_accessed_at"), F.col("status") == "indexed"
    ago = lambda n: now - F.make_dt_interval(F.lit(n))
    cold = live & (F.col("index_tier") != "cold") & (q < 0.3) & (seen.isNull() | (seen < ago(90)))
    one = F.when(F.coalesce(cold, F.lit(False)), "cold").otherwise(F.col("index_tier"))
    out = docs.withColumn("__1", one)
    warm = live & (F.col("__1") == "hot") & (q < 0.7) & (seen.isNull() | (seen < ago(30)))
    out = out.withColumn("__2", F.when(F.coalesce(warm, F.lit(False)), "warm").otherwise(F.col("__1")))
    hot = live & F.col("__2").isin("warm", "cold") & (F.col("access_count") > 5) & (seen > ago(7))
    return out.withColumn("new_tier", F.when(F.coalesce(hot, F.lit(False)), "hot").otherwise(F.col("__2"))).drop("__1", "__2")


def tier_embeddings(chunks: DataFrame, swept: DataFrame) -> DataFrame:
    """chunks (document_id, chunk_index, embedding): warm documents keep the first chunk's embedding, cold ones none."""
    t = swept.select(F.col("document_id").alias("__d"), F.col("new_tier").alias("__t"))
    keep = (F.col("__t") == "hot") | ((F.col("__t") == "warm") & (F.col("chunk_index") == 0))
    return chunks.join(t, F.col("document_id") == F.col("__d"), "left").withColumn("embedding", F.when(F.coalesce(keep, F.lit(True)), F.col("embedding"))).drop("__d", "__t")


def retention_due(docs: DataFrame, tenants: DataFrame, now: Column) -> DataFrame:
    """(document_id) of deleted documents older than their tenant's retention_days, 365 where it is null; only of tenants whose
    hard_delete_enabled is true."""
    kept = tenants.filter("hard_delete_enabled").select("tenant_id", F.coalesce(F.col("retention_days").cast("int"), F.lit(365)).alias("retention_days"))
    old = docs.filter("status = 'deleted'").join(kept, "tenant_id")
    return old.filter(F.col("created_at") < now - F.make_interval(days=F.col("retention_days"))).select("document_id")


def purge(tables: dict[str, DataFrame], due: DataFrame, key: str = "document_id") -> tuple[dict[str, DataFrame], DataFrame]:
    """The tables without the rows of `due`, and (table_name, purged)."""
    left = {name: df.join(due, key, "left_anti") for name, df in tables.items()}
    counts = [df.join(due, key, "left_semi").agg(F.count("*").alias("purged")).withColumn("table_name", F.lit(name)) for name, df in tables.items()]
    total = counts[0]
    for c in counts[1:]:
        total = total.unionByName(c)
    return left, total


def erase_tenant(tables: dict[str, DataFrame], tenant: int, owners: dict[str, DataFrame] | None = None) -> dict[str, DataFrame]:
    """Every table without a tenant's rows; at rest this drops partitions. Tables without tenant_id lose what belongs to the tenant's rows of
    an owner (`owners`: key column to a table with it and tenant_id, the first that fits counts); what has neither stays as it is."""

    def left(df: DataFrame) -> DataFrame:
        if "tenant_id" in df.columns:
            return df.filter(F.col("tenant_id") != tenant)
        for key, owner in (owners or {}).items():
            if key in df.columns:
                return df.join(owner.filter(F.col("tenant_id") == tenant).select(key).distinct(), key, "left_anti")
        return df

    return {name: left(df) for name, df in tables.items()}


def soft_delete(docs: DataFrame, claims: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Deleted documents and their claims rejected; `gone` has document_id."""
    g = gone.select(F.col("document_id").alias("__g")).distinct()
    on = F.col("document_id") == F.col("__g")
    d = docs.join(g, on, "left").withColumns({"status": F.when(F.col("__g").isNotNull(), "deleted").otherwise(F.col("status")), "review_status": F.when(F.col("__g").isNotNull(), "rejected").otherwise(F.col("review_status"))}).drop("__g")
    c = claims.join(g, on, "left").withColumn("status", F.when(F.col("__g").isNotNull(), "rejected").otherwise(F.col("status"))).drop("__g")
    return d, c


#: Requests of a stretch that admitted() looks at as one group, about.
STRETCH_ROWS = 20_000


def admitted(requests: DataFrame, limit: int, seconds: int = 60) -> DataFrame:
    """requests (tenant_id, request_id, at) with accepted: at most `limit` accepted in any trailing window; refused ones don't count.

    Sequential, so a state function over time-ordered batches; the batch twin of the streaming operator. A pause longer than the window leaves
    nothing in it, so a tenant's history is cut at the first pause after each STRETCH_ROWS requests, and
    the stretches are groups of their own.
    """
    import pandas as pd

    from ..streaming.admission import admit

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["at", "request_id"])
        pdf["accepted"], _ = admit([t.timestamp() for t in pdf["at"]], [], limit, seconds)
        return pdf

    own = Window.partitionBy("tenant_id").orderBy("at", "request_id")
    paused = F.col("at") > F.lag("at").over(own) + F.make_interval(secs=F.lit(seconds))
    numbered = requests.select("tenant_id", "request_id", "at").withColumns({"__n": F.row_number().over(own), "__paused": paused})
    begun = F.coalesce(F.max(F.when(F.col("__paused"), F.col("__n"))).over(own), F.lit(0))
    cut = numbered.withColumn("__stretch", F.floor(begun / STRETCH_ROWS)).drop("__n", "__paused")
    out = cut.groupBy("tenant_id", "__stretch").applyInPandas(run, "tenant_id long, request_id long, at timestamp_ntz, __stretch long, accepted boolean")
    return out.drop("__stretch")

