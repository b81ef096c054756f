"""Quality gate: checks, duplicates and overlaps, score and publishing decision, document-type schemas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import token_count

TINY_TOKENS, MAX_TINY_RATIO, MIN_LENGTH = 20, 0.3, 50
# What documents of a type need. (type, check, what, severity, penalty); a disabled rule ships for users to switch on.
SCHEMA_RULES = (
    ("skill", "missing_frontmatter", "name", "critical", 0.15),
    ("skill", "missing_frontmatter", "description", "critical", 0.15),
    ("skill", "missing_recommended_field", "version", "warning", 0.05),
    ("skill", "missing_recommended_field", "owner", "warning", 0.05),
    ("skill", "missing_recommended_field", "executor", "warning", 0.05),
    ("skill", "missing_recommended_field", "ampel", "warning", 0.05),
    ("skill", "missing_section", "zweck", "warning", 0.1),
    ("skill", "missing_section", "sop", "warning", 0.1),
    ("skill", "missing_section", "dod", "warning", 0.1),
    ("skill", "invalid_version", "version", "warning", 0.05),
    ("policy", "missing_frontmatter", "version", "warning", 0.1),
    ("policy", "missing_recommended_field", "effective_date", "info", 0.03),
    ("policy", "missing_recommended_field", "approved_by", "info", 0.03),
)
PENALTY_CAP = {"skill": 0.5, "policy": 0.3}


def finding(when: Column, kind: str, severity: str, penalty: float) -> Column:
    return F.when(when, F.struct(F.lit(kind).alias("finding_type"), F.lit(severity).alias("severity"), F.lit(penalty).alias("penalty")))


def quality_findings(docs: DataFrame, chunks: DataFrame) -> DataFrame:
    """(document_id, finding_type, severity, penalty) of the seven checks. chunks: document_id, chunk_text and embedded (boolean)."""
    per = chunks.groupBy("document_id").agg(F.count("*").alias("n"), F.count_if("embedded").alias("done"), F.count_if(token_count(F.col("chunk_text")) < TINY_TOKENS).alias("tiny"))
    rows = docs.join(per, "document_id", "left").fillna(0, ["n", "done", "tiny"])
    text = F.regexp_replace(F.coalesce("text", F.lit("")), r"^\s+|\s+$", "")
    lines = F.filter(F.transform(F.split(text, "\n"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")), lambda x: x != "")
    rows = rows.withColumns({"__len": F.length(text), "__lines": F.size(lines), "__distinct": F.size(F.array_distinct(lines))})
    size = F.col("__len")
    checks = F.array(
        finding(size == 0, "empty_content", "critical", 0.5),
        finding(size < 10, "extremely_short_content", "critical", 0.4),
        finding((size >= 10) & (size < MIN_LENGTH), "short_content", "warning", 0.15),
        finding(F.coalesce(F.col("title") == "", F.lit(True)), "no_title", "warning", 0.1),
        finding((F.col("__lines") >= 5) & (F.col("__distinct") / F.greatest("__lines", F.lit(1)) < 0.5), "high_boilerplate", "warning", 0.15),
        finding((F.col("n") > 0) & (F.col("done") < F.col("n")), "embedding_failures", "critical", 0.3),
        finding((F.col("n") > 0) & (F.col("tiny") / F.greatest("n", F.lit(1)) > MAX_TINY_RATIO), "too_many_tiny_chunks", "warning", 0.1),
        finding((size > 100) & (F.col("n") == 0), "no_chunks_from_content", "warning", 0.1),
    )
    return rows.select("document_id", F.inline(F.filter(checks, lambda x: x.isNotNull())))


def duplicate_findings(duplicates: DataFrame, overlaps: DataFrame) -> DataFrame:
    """Findings of exact duplicates (document_id) and of overlaps (document_id, ratio above 0.3)."""
    a = duplicates.select("document_id", F.lit("exact_duplicate").alias("finding_type"), F.lit("warning").alias("severity"), F.lit(0.15).alias("penalty"))
    b = overlaps.filter("ratio > 0.3").select("document_id", F.lit("chunk_overlap").alias("finding_type"), F.lit("warning").alias("severity"), F.lit(0.1).alias("penalty"))
    return a.unionByName(b)


def decide(score: Column, critical: Column) -> Column:
    return F.when(critical & (score < 0.3), "quarantined").when(critical, "needs_review").when(score >= 0.8, "published").when(score >= 0.5, "published_with_warnings").otherwise("needs_review")


def score(docs: DataFrame, findings: DataFrame) -> DataFrame:
    """(document_id, quality_score, review_status, n_findings); a document without findings has score 1."""
    per = findings.groupBy("document_id").agg(F.sum(F.col("penalty").cast("decimal(10,3)")).cast("double").alias("penalty"), F.max(F.col("severity") == "critical").alias("critical"), F.count("*").alias("n_findings"))
    rows = docs.select("document_id").join(per, "document_id", "left").fillna({"penalty": 0.0, "critical": False, "n_findings": 0})
    value = F.round(F.greatest(F.lit(0.0), 1 - F.col("penalty")), 3)
    return rows.select("document_id", value.alias("quality_score"), decide(value, F.col("critical")).alias("review_status"), "n_findings")


def apply_gate(docs: DataFrame, scores: DataFrame) -> DataFrame:
    """docs with the scores' quality_score and review_status, and status quarantined or indexed."""
    s = scores.select("document_id", F.col("quality_score").alias("__q"), F.col("review_status").alias("__r"))
    joined = docs.join(s, "document_id", "left")
    held = F.col("__r") == "quarantined"
    return joined.withColumns({"status": F.when(F.col("status") == "deleted", F.col("status")).when(held, "quarantined").otherwise("indexed"), "quality_score": F.coalesce("__q", "quality_score"), "review_status": F.coalesce("__r", "review_status")}).drop("__q", "__r")


def review_tasks(scores: DataFrame) -> DataFrame:
    return scores.filter(F.col("review_status").isin("needs_review", "quarantined")).select("document_id", F.lit("quality_review").alias("task_type"), F.lit("new").alias("status"))


def schema_rules(spark, extra=()) -> DataFrame:
    """The rule table; user rules are appended rows."""
    return spark.createDataFrame([*SCHEMA_RULES, *extra], "doc_type string, check string, what string, severity string, penalty double")


def schema_findings(docs: DataFrame, rules: DataFrame) -> DataFrame:
    """(document_id, doc_type, check, what, severity, penalty). docs: document_id, doc_type (hint), frontmatter (map), content."""
    fm = F.col("frontmatter")
    kind = F.lower(F.trim(F.coalesce("doc_type", fm["type"], fm["doc_type"], fm["schema"])))
    rows = docs.withColumn("doc_type", kind).join(rules, "doc_type")
    missing = ~F.coalesce(F.map_contains_key("frontmatter", F.col("what")), F.lit(False))
    version = fm["version"]
    broken = F.when(F.col("check") == "missing_section", ~F.contains(F.lower("content"), F.col("what"))).when(F.col("check") == "invalid_version", F.coalesce((version != "") & ~version.rlike(r"^\d+\.\d+"), F.lit(False))).otherwise(missing)
    return rows.filter(broken).select("document_id", "doc_type", "check", "what", "severity", "penalty")


def schema_scores(findings: DataFrame) -> DataFrame:
    """(document_id, doc_type, penalty, valid): the capped penalty; skills are valid below 0.3, policies always."""
    cap = F.coalesce(*[F.when(F.col("doc_type") == k, F.lit(v)) for k, v in PENALTY_CAP.items()], F.lit(1.0))
    per = findings.groupBy("document_id", "doc_type").agg(F.sum(F.col("penalty").cast("decimal(10,3)")).cast("double").alias("raw"))
    return per.select("document_id", "doc_type", F.least("raw", cap).alias("penalty"), ((F.col("doc_type") != "skill") | (F.col("raw") < 0.3)).alias("valid"))


def exact_duplicates(docs: DataFrame) -> DataFrame:
    """(document_id, first_id, copies) of live documents whose content another has too, in one tenant.

    Hashes are counted first, so only what repeats is joined, with one row a hash; a hash that very many share is partly counted before
    the shuffle, and its rows can be split among tasks of the join, which those of a window can't.
    """
    live = docs.filter("status <> 'deleted'").select("document_id", "tenant_id", "content_hash")
    groups = live.groupBy("tenant_id", "content_hash").agg(F.min("document_id").alias("first_id"), F.count("*").alias("copies")).filter("copies > 1")
    same = (F.col("l.tenant_id").eqNullSafe(F.col("g.tenant_id"))) & F.col("l.content_hash").eqNullSafe(F.col("g.content_hash"))
    return live.alias("l").join(groups.alias("g"), same).select("l.document_id", "first_id", "copies")
