"""Dependencies between documents: shared claims, siblings, and the graph of claim and conflict edges."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .conflicts import checkpointed, similar_predicates
from .retrieval import ranked


def claim_values(claims: DataFrame) -> DataFrame:
    """Active claims as (tenant_id, p, value, document_id), once each."""
    return claims.filter("status = 'active'").select("tenant_id", F.lower(F.trim("predicate")).alias("p"), F.lower(F.trim("object_value")).alias("value"), "document_id").distinct()


def claim_edges(claims: DataFrame, least: float | None = 0.5) -> DataFrame:
    """(source, target, kind, shared): pairs of documents with claims on equal predicates, or similar ones above `least`, one row a pair.

    kind is contradiction if some such claims differ in value, else agreement. None for `least` takes equal predicates only.
    """
    rows = claim_values(claims)
    same = rows.select("tenant_id", F.col("p").alias("a")).distinct().withColumn("b", F.col("a"))
    met = same
    if least is not None:
        near = similar_predicates(claims.filter("status = 'active'"), least).select("tenant_id", F.col("predicate_a").alias("a"), F.col("predicate_b").alias("b"))
        met = same.unionByName(near)
    left = rows.select("tenant_id", F.col("p").alias("a"), F.col("value").alias("va"), F.col("document_id").alias("da"))
    right = rows.select("tenant_id", F.col("p").alias("b"), F.col("value").alias("vb"), F.col("document_id").alias("db"))
    pairs = left.join(met, ["tenant_id", "a"]).join(right, ["tenant_id", "b"]).filter("da <> db AND (a <> b OR da < db)")
    ends = pairs.select(F.least("da", "db").alias("source"), F.greatest("da", "db").alias("target"), (F.col("va") != F.col("vb")).alias("differs"))
    return ends.groupBy("source", "target").agg(F.when(F.max("differs"), "contradiction").otherwise("agreement").alias("kind"), F.count("*").alias("shared"))


def claim_links(claims: DataFrame) -> DataFrame:
    """(tenant_id, predicate, value, document_id, class_id, agreeing, contradicting): what claim_edges() of equal predicates links, one row
    for each document, predicate and value instead of one for each pair.

    class_id is the smallest document of the predicate and value; all of these agree with each other, and contradict those of the predicate's
    other values. The counts are of other documents' rows. Claims without a value are left out. Counting starts before the shuffle, so a
    predicate that very many documents share costs no more than any others.
    """
    rows = claim_values(claims).filter("value IS NOT NULL")
    same = rows.groupBy("tenant_id", "p", "value").agg(F.count("*").alias("same"), F.min("document_id").alias("class_id"))
    whole = same.groupBy("tenant_id", "p").agg(F.sum("same").alias("whole"))
    own = rows.groupBy("tenant_id", "p", "document_id").agg(F.count("*").alias("own"))
    met = rows.join(same.join(whole, ["tenant_id", "p"]), ["tenant_id", "p", "value"]).join(own, ["tenant_id", "p", "document_id"])
    return met.select("tenant_id", F.col("p").alias("predicate"), "value", "document_id", "class_id", (F.col("same") - 1).alias("agreeing"), (F.col("whole") - F.col("same") - F.col("own") + 1).alias("contradicting"))


def similar_claim_links(claims: DataFrame, least: float = 0.5) -> DataFrame:
    """(tenant_id, predicate, value, document_id, class_id, agreeing, contradicting): what claim_edges() links, of equal and similar predicates,
    one row for each document, predicate and value instead of one for each pair of documents.

    class_id is the smallest document of the predicate and value. The counts are of other documents' rows on an equal predicate or one whose
    similarity is above `least`: contradicting those of another value, agreeing the rest, also where a value is null. Classes meet, not documents.
    """
    rows = checkpointed(claim_values(claims).withColumn("v", F.coalesce(F.concat(F.lit("="), "value"), F.lit(""))))
    near = similar_predicates(claims.filter("status = 'active'"), least).select("tenant_id", F.col("predicate_a").alias("p"), F.col("predicate_b").alias("q"))
    same = rows.select("tenant_id", "p", F.col("p").alias("q")).distinct()
    near = checkpointed(near.unionByName(near.select("tenant_id", F.col("q").alias("p"), F.col("p").alias("q"))).unionByName(same))
    classes = rows.groupBy("tenant_id", "p", "v").agg(F.count("*").alias("n"), F.min("document_id").alias("class_id"))
    met = near.join(classes.select("tenant_id", F.col("p").alias("q"), "v", "n"), ["tenant_id", "q"])
    blank = F.coalesce(F.sum(F.when(F.col("v") == "", F.col("n"))), F.lit(0))
    whole = met.groupBy("tenant_id", "p").agg(F.sum("n").alias("whole"), blank.alias("blank"))
    alike = met.groupBy("tenant_id", "p", "v").agg(F.sum("n").alias("alike"))
    agree = F.when(F.col("v") == "", F.col("whole")).otherwise(F.col("alike") + F.col("blank"))
    of_class = classes.drop("n").join(alike, ["tenant_id", "p", "v"]).join(whole, ["tenant_id", "p"]).withColumn("agree", agree)
    other = rows.select("tenant_id", "document_id", F.col("p").alias("q"), F.col("v").alias("w"))
    own = rows.join(other, ["tenant_id", "document_id"]).join(near, ["tenant_id", "p", "q"]).groupBy("tenant_id", "document_id", "p", "v").agg(F.count("*").alias("own"), F.count_if(F.expr("v = w OR v = '' OR w = ''")).alias("own_agree"))
    out = rows.join(of_class, ["tenant_id", "p", "v"]).join(own, ["tenant_id", "document_id", "p", "v"])
    return out.select("tenant_id", F.col("p").alias("predicate"), "value", "document_id", "class_id", (F.col("agree") - F.col("own_agree")).alias("agreeing"), (F.col("whole") - F.col("agree") - F.col("own") + F.col("own_agree")).alias("contradicting"))


def related(claims: DataFrame, docs: DataFrame, least: float = 0.45, most: int = 20) -> DataFrame:
    """(document_id, related_id, title, predicate, this_value, related_value, similarity, rank): the documents of a document's tenant with active
    claims on an equal predicate, or one whose trigram similarity is above `least`: the first `most` by id, each with its most similar
    predicate (ties by predicate and values).

    Of a predicate's documents only the first most + 1 by id can be among anyone's first `most`, and the same holds for what all predicates
    similar to one have together. So each predicate has most + 1 candidates, and no two documents of a class are paired beyond those: a
    predicate that very many documents share costs most + 1 rows for each of them.
    """
    live = docs.filter("status <> 'deleted'").select("document_id", "tenant_id", "title")
    held = claims.filter("status = 'active'").drop("tenant_id", "title").join(live, "document_id").select("tenant_id", F.lower("predicate").alias("p"), "document_id", F.col("object_value").alias("value"))
    own = checkpointed(held.groupBy("tenant_id", "p", "document_id").agg(F.min("value").alias("value")))
    heads = ranked(own, ["tenant_id", "p"], F.asc("document_id"), most=most + 1, name="place").select("tenant_id", F.col("p").alias("b"), F.col("document_id").alias("related_id"), F.col("value").alias("related_value"))
    names = own.select("tenant_id", F.col("p").alias("predicate")).distinct()
    near = checkpointed(similar_predicates(names, least).select("tenant_id", F.col("predicate_a").alias("a"), F.col("predicate_b").alias("b"), "similarity"))  # read twice
    trimmed = names.select("tenant_id", F.col("predicate").alias("p"), F.lower(F.trim("predicate")).alias("t"))
    ends = lambda df: df.join(trimmed.select("tenant_id", F.col("t").alias("a"), F.col("p").alias("pa")), ["tenant_id", "a"]).join(trimmed.select("tenant_id", F.col("t").alias("b"), F.col("p").alias("pb")), ["tenant_id", "b"]).select("tenant_id", F.col("pa").alias("a"), F.col("pb").alias("b"), "similarity")
    near = ends(near.unionByName(near.select("tenant_id", F.col("b").alias("a"), F.col("a").alias("b"), "similarity")).unionByName(trimmed.select("tenant_id", F.col("t").alias("a"), F.col("t").alias("b"), F.lit(1.0).alias("similarity")).distinct()))
    best = F.min(F.struct((-F.col("similarity")).alias("s"), "related_value")).alias("x")
    for_predicate = ranked(near.join(heads, ["tenant_id", "b"]).groupBy("tenant_id", "a", "related_id").agg(best), ["tenant_id", "a"], F.asc("related_id"), most=most + 1, name="place")
    met = own.join(for_predicate.select("tenant_id", F.col("a").alias("p"), "related_id", "x"), ["tenant_id", "p"]).filter("document_id <> related_id")
    per = met.groupBy("document_id", "related_id").agg(F.min(F.struct(F.col("x.s").alias("s"), "p", "value", F.col("x.related_value").alias("related_value"))).alias("y"))
    top = ranked(per, ["document_id"], F.asc("related_id"), most=most)
    named = top.join(live.select(F.col("document_id").alias("related_id"), "title"), "related_id")
    return named.select("document_id", "related_id", "title", F.col("y.p").alias("predicate"), F.col("y.value").alias("this_value"), F.col("y.related_value").alias("related_value"), (-F.col("y.s")).alias("similarity"), "rank")


def siblings(docs: DataFrame, most: int = 10) -> DataFrame:
    """(document_id, sibling_id, rank): the first other documents of the same source by title.

    Only a source's first most + 1 documents can be anyone's siblings, so a large source isn't joined with itself.
    """
    live = docs.filter("status <> 'deleted'").select("document_id", "source_id", "title")
    first = ranked(live, ["source_id"], F.asc("title"), F.asc("document_id"), most=most + 1, name="place").select("source_id", F.col("document_id").alias("sibling_id"), "place")
    met = live.join(first, "source_id").filter("document_id <> sibling_id")
    return ranked(met, ["document_id"], F.asc("place"), most=most).select("document_id", "sibling_id", "rank")


def graph(docs: DataFrame, claim_edge: DataFrame, conflicts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes (document_id, title) and edges (source, target, kind) among them: claims and open conflicts."""
    nodes = docs.filter("status <> 'deleted'").select("document_id", "title")
    more = conflicts.filter("status = 'new'").select(F.least("document_a_id", "document_b_id").alias("source"), F.greatest("document_a_id", "document_b_id").alias("target"), F.concat(F.lit("conflict:"), "conflict_type").alias("kind"))
    edges = claim_edge.select("source", "target", "kind").unionByName(more).filter("source <> target").distinct()
    ids = nodes.select("document_id")
    for end in ("source", "target"):
        edges = edges.join(ids, edges[end] == ids["document_id"], "left_semi")
    return nodes, edges


def dependencies(edges: DataFrame) -> DataFrame:
    """(document_id, neighbour_id, contradiction): both directions of the claim edges, contradictions first for each document."""
    both = edges.select(F.col("source").alias("document_id"), F.col("target").alias("neighbour_id"), (F.col("kind") == "contradiction").alias("contradiction"), "shared").unionByName(edges.select(F.col("target").alias("document_id"), F.col("source").alias("neighbour_id"), (F.col("kind") == "contradiction").alias("contradiction"), "shared"))
    w = Window.partitionBy("document_id").orderBy(F.desc("contradiction"), F.desc("shared"), "neighbour_id")
    return both.withColumn("rank", F.row_number().over(w).cast("long"))
