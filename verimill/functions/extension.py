"""Where users' models plug in: embedder, reranker, extractor, quality assessor, contradiction detector. Defaults are deterministic stand-ins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import terms

DIMENSION = 64
MAX_CHARS = 8000


def hashed_terms(text: Column, dimension: int = DIMENSION) -> Column:
    """A text's vector: each term adds 1 to the place its hash names."""
    places = F.transform(terms(F.substring(text, 1, MAX_CHARS)), lambda t: F.pmod(F.xxhash64(t), F.lit(dimension)).cast("int"))
    return F.transform(F.sequence(F.lit(0), F.lit(dimension - 1)), lambda i: F.size(F.filter(places, lambda p: p == i)).cast("double"))


def embed(df: DataFrame, embedder: Callable[[Column], Column] = hashed_terms, cache: DataFrame | None = None, text: str = "chunk_text") -> tuple[DataFrame, DataFrame]:
    """df with embedding, and the cache (text_hash, embedding) with what was new: each distinct text is embedded once, known ones not at all.

    An embedder maps a text column to a vector column; a model comes as a pandas_udf. Texts it fails on have null or zero vectors.
    """
    keyed = df.withColumn("text_hash", F.sha2(F.coalesce(text, F.lit("")), 256))
    distinct = keyed.groupBy("text_hash").agg(F.first(text).alias("t"))
    fresh = distinct if cache is None else distinct.join(cache.select("text_hash"), "text_hash", "left_anti")
    made = fresh.select("text_hash", embedder(F.col("t")).alias("embedding"))
    known = made if cache is None else cache.select("text_hash", "embedding").unionByName(made)
    return keyed.join(known, "text_hash"), known


def rerank_scores(results: DataFrame, texts: DataFrame, queries: DataFrame, scorer: Callable[[Column, Column], Column]) -> DataFrame:
    """(query_id, document_id, rerank_score) by a scorer of query and passage columns; a model comes as a pandas_udf. The results are computed
    once, and only the texts of their documents are shuffled."""
    from ..operators.retrieval import checkpointed, narrowed

    pairs = checkpointed(results.select("query_id", "document_id"))
    found = narrowed(texts.select("document_id", "text"), pairs.select("document_id").distinct(), ["document_id"])
    rows = pairs.join(found, "document_id").join(queries.select("query_id", "query_text"), "query_id")
    return rows.select("query_id", "document_id", scorer(F.col("query_text"), F.col("text")).alias("rerank_score"))


def assess(docs: DataFrame, *assessors: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(document_id, finding_type, severity, penalty): the findings of all assessors, each a function of the documents to such rows; a model
    comes as one that uses mapInPandas or a pandas_udf."""
    columns = ["document_id", "finding_type", "severity", "penalty"]
    out = assessors[0](docs).select(*columns)
    for assessor in assessors[1:]:
        out = out.unionByName(assessor(docs).select(*columns))
    return out


def contradictions(pairs: DataFrame, texts: DataFrame, detector: Callable[[Column, Column], Column], least: float = 0.0) -> DataFrame:
    """(document_a_id, document_b_id, confidence) of candidate pairs that a detector of two text columns gives `least` or more; a model comes as
    a pandas_udf. Pairs of a document that `texts` lacks are left out."""
    side = lambda s: texts.select(F.col("document_id").alias(f"document_{s}_id"), F.col("text").alias(s))
    scored = pairs.select("document_a_id", "document_b_id").distinct().join(side("a"), "document_a_id").join(side("b"), "document_b_id")
    return scored.select("document_a_id", "document_b_id", detector(F.col("a"), F.col("b")).alias("confidence")).filter(F.col("confidence") >= least)


def unlike_terms(a: Column, b: Column) -> Column:
    """Share of both texts' distinct terms that only one has; 0 for two texts without a term."""
    x, y = F.array_distinct(terms(a)), F.array_distinct(terms(b))
    every = F.size(F.array_union(x, y))
    return F.when(every > 0, 1 - F.size(F.array_intersect(x, y)) / every).otherwise(0.0)


def term_overlap(query: Column, passage: Column) -> Column:
    """Share of the query's distinct terms that the passage has."""
    q = F.array_distinct(terms(query))
    return F.when(F.size(q) > 0, F.size(F.array_intersect(q, terms(passage))) / F.size(q)).otherwise(0.0)
