"""Claims: parsing, extraction, clusters, the knowledge index, canonical predicates, lint, topic synthesis."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import clean_reply, normalize_text
from .filters import eligible_chunks
from .retrieval import ranked

REPLY = "array<struct<subject:string,predicate:string,object_value:string,confidence:double,valid_from:string,valid_until:string>>"


def parse_claims(replies: DataFrame) -> DataFrame:
    """(reply_id, subject, predicate, object_value, confidence, valid_from, valid_until) of model replies; incomplete claims are dropped.

    A reply cut off in the middle is repaired by closing it behind its last whole object.
    """
    closed = F.concat(F.regexp_extract("raw", r"(?s)(\[.*\})", 1), F.lit("]"))
    text = F.coalesce(clean_reply(F.col("raw")), F.when(F.length(closed) > 1, closed))
    parsed = replies.select("reply_id", F.inline(F.from_json(text, REPLY)))
    whole = parsed.filter("coalesce(subject, '') <> '' AND coalesce(predicate, '') <> '' AND coalesce(object_value, '') <> ''")
    return whole.withColumn("confidence", F.coalesce("confidence", F.lit(0.5)))


def extract_claims(chunks: DataFrame, extractor: Callable[[DataFrame], DataFrame] | None = None, passes: int = 1) -> DataFrame:
    """(document_id, chunk_id, subject, predicate, object_value, confidence, evidence) of eligible chunks; later passes add what is new.

    An extractor maps chunks to such rows (a model behind mapInPandas, say). The default is a stand-in: sentences 'X is|was Y.'
    """
    rows = eligible_chunks(chunks)
    made = (extractor or pattern_extractor)(rows)
    key = ["document_id", "subject", "predicate", "object_value"]
    for _ in range(passes - 1):
        made = made.unionByName((extractor or pattern_extractor)(rows).join(made.select(key), key, "left_anti"))
    return first_claims(made)


def pattern_extractor(chunks: DataFrame) -> DataFrame:
    """A deterministic stand-in for a model: word before 'is', 'was', 'est', 'ist' or 'es', and the word behind it."""
    found = chunks.select("document_id", "chunk_id", F.substring("chunk_text", 1, 500).alias("evidence"), F.explode(F.regexp_extract_all("chunk_text", F.lit(r"([\p{L}]+ (?:is|was|est|ist|es) [\p{L}]+)"), F.lit(1))).alias("m"))
    w = F.split("m", " ")
    return found.select("document_id", "chunk_id", w[0].alias("subject"), w[1].alias("predicate"), w[2].alias("object_value"), F.lit(0.5).alias("confidence"), "evidence")


def first_claims(claims: DataFrame) -> DataFrame:
    """One claim for each document and claim text, letters of either case, white space around it ignored: the first chunk's."""
    key = [F.lower(F.trim(c)).alias(f"__{c}") for c in ("subject", "predicate", "object_value")]
    rows = claims.select("*", *key)
    return ranked(rows, ["document_id", "__subject", "__predicate", "__object_value"], F.asc("chunk_id"), F.asc("subject"), F.asc("predicate"), F.asc("object_value"), most=1, name="__r").drop("__r", "__subject", "__predicate", "__object_value")


def live_claims(claims: DataFrame, docs: DataFrame) -> DataFrame:
    """(tenant_id, predicate, value, claim_id, document_id, object_value, confidence, title): active claims of documents that aren't deleted."""
    rows = claims.filter("status = 'active'").join(docs.filter("status <> 'deleted'").select("document_id", "title"), "document_id")
    return rows.select("tenant_id", F.lower(F.trim("predicate")).alias("predicate"), F.lower(F.trim("object_value")).alias("value"), "claim_id", "document_id", "object_value", "confidence", "title")


def claim_clusters(claims: DataFrame, docs: DataFrame, min_variants: int = 2) -> DataFrame:
    """(tenant_id, predicate, variants, claims, best_claim_id, best_value): predicates of active claims with several values, one row each, and
    the surest claim. Values are counted where they are, so that a predicate of very many claims is no single group."""
    per = live_claims(claims, docs).groupBy("tenant_id", "predicate", "value").agg(F.count("*").alias("n"), F.min(F.struct((-F.col("confidence")).alias("c"), "claim_id", "object_value")).alias("b"))
    out = per.groupBy("tenant_id", "predicate").agg(F.count_if(F.col("value").isNotNull()).alias("variants"), F.sum("n").alias("claims"), F.min("b").alias("b"))
    return out.filter(F.col("variants") >= min_variants).select("tenant_id", "predicate", "variants", "claims", F.col("b.claim_id").alias("best_claim_id"), F.col("b.object_value").alias("best_value"))


def cluster_members(claims: DataFrame, docs: DataFrame, min_variants: int = 2) -> DataFrame:
    """(tenant_id, predicate, claim_id, object_value, confidence, title): the claims of each cluster, a row each, in no order."""
    clusters = claim_clusters(claims, docs, min_variants).select("tenant_id", "predicate")
    return live_claims(claims, docs).join(clusters, ["tenant_id", "predicate"], "left_semi").select("tenant_id", "predicate", "claim_id", "object_value", "confidence", "title")


def cluster_variants(claims: DataFrame) -> DataFrame:
    """(tenant_id, predicate, value, claim_id, confidence, claims): the surest claim of each value of each predicate."""
    rows = claims.filter("status = 'active'").withColumns({"p": F.lower(F.trim("predicate")), "value": F.lower(F.trim("object_value"))})
    best = rows.groupBy("tenant_id", "p", "value").agg(F.count("*").alias("claims"), F.min(F.struct((-F.col("confidence")).alias("c"), "claim_id")).alias("b"))
    return best.select("tenant_id", F.col("p").alias("predicate"), "value", F.col("b.claim_id").alias("claim_id"), (-F.col("b.c")).alias("confidence"), "claims")


def usable_claims(claims: DataFrame, docs: DataFrame) -> DataFrame:
    """Active claims of documents that are neither deleted nor quarantined, with subject_normalized and predicate_normalized."""
    usable = docs.filter("status NOT IN ('deleted', 'quarantined')").select("document_id")
    rows = claims.filter("status = 'active'").join(usable, "document_id", "left_semi")
    return rows.withColumns({"subject_normalized": normalize_text(F.col("subject")), "predicate_normalized": normalize_text(F.col("predicate"))})


def index_sources(claims: DataFrame, docs: DataFrame) -> DataFrame:
    """(tenant_id, subject_normalized, predicate_normalized, claim_id, document_id): the claims behind each entry of the index, a row each."""
    return usable_claims(claims, docs).select("tenant_id", "subject_normalized", "predicate_normalized", "claim_id", "document_id")


def build_index(claims: DataFrame, docs: DataFrame) -> DataFrame:
    """The knowledge index: active claims of documents that may be used, by normalised subject and predicate; the surest value stands. How many
    claims and documents an entry rests on is counted; index_sources lists them."""
    rows = usable_claims(claims, docs)
    best = F.min(F.struct((-F.col("confidence")).alias("c"), "claim_id", "subject", "predicate", "object_value"))
    per = rows.groupBy("tenant_id", "subject_normalized", "predicate_normalized").agg(best.alias("b"), F.count("*").alias("claim_count"), F.countDistinct("document_id").alias("document_count"))
    return per.select("tenant_id", "subject_normalized", "predicate_normalized", F.col("b.subject").alias("subject"), F.col("b.predicate").alias("predicate"), F.col("b.object_value").alias("value"), (-F.col("b.c")).alias("confidence"), "claim_count", "document_count")


def normalize_predicates(claims: DataFrame, mapping: DataFrame) -> DataFrame:
    """claims with the predicate of active ones replaced by their tenant's mapping (tenant_id, original, canonical), and changed."""
    m = mapping.select(F.col("tenant_id").alias("__t"), F.col("original").alias("__o"), F.col("canonical").alias("__c"))
    out = claims.join(m, (F.col("tenant_id") == F.col("__t")) & (F.lower(F.trim("predicate")) == F.col("__o")) & (F.col("status") == "active"), "left").drop("__t")
    return out.withColumn("changed", F.col("__c").isNotNull() & (F.col("__c") != F.col("predicate"))).withColumn("predicate", F.coalesce("__c", "predicate")).drop("__o", "__c")


def propose_mapping(similar: DataFrame) -> DataFrame:
    """(tenant_id, original, canonical): each predicate's smallest similar one in its tenant, a stand-in for a model's proposal."""
    return similar.groupBy("tenant_id", F.col("predicate_b").alias("original")).agg(F.min("predicate_a").alias("canonical"))


def lint(index: DataFrame, claims: DataFrame, now: Column, peers: float = 0.6) -> DataFrame:
    """(tenant_id, kind, subject, predicate) findings inside each tenant: contradiction (several values), duplicate (one subject and value under
    two predicates), stale (newest validity a year or more before now), gap (a predicate that `peers` of all subjects hold and this one lacks)."""
    active = claims.filter("status = 'active'").withColumns({"s": normalize_text(F.col("subject")), "p": normalize_text(F.col("predicate"))})
    per = active.groupBy("tenant_id", "s", "p").agg(F.countDistinct(F.lower(F.trim("object_value"))).alias("n"), F.max("valid_from").alias("latest"))
    named = lambda df, kind, s, p: df.select("tenant_id", F.lit(kind).alias("kind"), F.col(s).alias("subject"), F.col(p).alias("predicate"))
    contradiction = named(per.filter("n > 1"), "contradiction", "s", "p")
    stale = named(per.filter(F.col("latest") < F.add_months(now.cast("date"), -12)), "stale", "s", "p")
    own = ["tenant_id", "subject_normalized", "predicate_normalized"]
    entries = index.withColumn("v", F.lower(F.trim("value")))
    twins = entries.groupBy("tenant_id", "subject_normalized", "v").agg(F.countDistinct("predicate_normalized").alias("n")).filter("n > 1")
    duplicate = named(entries.join(twins, ["tenant_id", "subject_normalized", "v"], "left_semi"), "duplicate", *own[1:])
    subjects = index.select(*own[:2]).distinct()
    held = index.select(*own).distinct()
    usual = held.groupBy("tenant_id", "predicate_normalized").agg(F.count("*").alias("n")).join(subjects.groupBy("tenant_id").agg(F.count("*").alias("all")), "tenant_id").filter(F.col("n") >= F.col("all") * peers)
    # at most 1 / peers times as many rows as the index has: each usual predicate is held by that share of its tenant's subjects
    gap = subjects.join(usual.select("tenant_id", "predicate_normalized"), "tenant_id").join(held, own, "left_anti")
    return contradiction.unionByName(stale).unionByName(duplicate.distinct()).unionByName(named(gap, "gap", *own[1:]))


def synthesize_topics(claims: DataFrame, most: int = 20) -> DataFrame:
    """(tenant_id, topic, claim_count, documents, confidence, summary): a tenant's claims on each subject, surest first; the summary lists the
    first `most`."""
    rows, own = claims.filter("status = 'active'"), ["tenant_id", "subject"]
    top = ranked(rows, own, F.desc("confidence"), F.asc("claim_id"), most=most, name="r")
    text = top.groupBy(*own).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", F.concat_ws(" ", "predicate", F.lit("="), "object_value").alias("t")))), lambda x: x["t"]), "; ").alias("summary"))
    per = rows.groupBy(*own).agg(F.count("*").alias("claim_count"), F.countDistinct("document_id").alias("documents"), F.round(F.avg("confidence"), 6).alias("confidence"))
    return per.join(text, own).withColumnRenamed("subject", "topic")
