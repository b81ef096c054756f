"""Conflicts between documents and between claims: duplicates, overlaps, supersession, contradiction."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import norm
from .blocks import bucketed_nearest, cosine_pairs, exact_nearest, padded_words, trigram_pairs
from .retrieval import checkpointed, ranked


def duplicate_conflicts(docs: DataFrame, most: int = 5) -> DataFrame:
    """Pass 1: (document_a_id, document_b_id, confidence): a later document and up to `most` earlier ones with its content.

    The earlier ones are the group's first, so a group of n copies gives at most n * most rows. Spark cuts each task's rows of a group to
    those before it shuffles them, and the join with them can split a group that very many share.
    """
    live = docs.filter("status <> 'deleted'").select("tenant_id", "content_hash", F.col("document_id").alias("document_a_id"))
    first = ranked(live.withColumnRenamed("document_a_id", "document_b_id"), ["tenant_id", "content_hash"], F.asc("document_b_id"), most=most, name="place")
    return live.join(first, ["tenant_id", "content_hash"]).filter("document_b_id < document_a_id").select("document_a_id", "document_b_id", F.lit(1.0).alias("confidence"))


#: A chunk hash that more documents of a tenant hold is met by sets of such hashes in chunk_overlap(), not by documents.
HOT_CHUNK = 256


def chunk_overlap(chunks: DataFrame, docs: DataFrame, most: int = 5) -> DataFrame:
    """Pass 2: (document_a_id, document_b_id, shared, ratio, rank): pairs of one tenant with more than one chunk of b in a, the first `most` for a.

    Each distinct hash of a is met with every chunk of b. Copies of documents are left to pass 1: they are one document here, the first.
    Documents meet on hashes that up to HOT_CHUNK of them hold. Those of the others, headers and footers, form a document's set; each two
    sets that occur meet once, and a set's first most + 1 documents by what they share and id stand for all that share no rarer hash:
    anything behind them is behind them for every document of the set. So nothing is lost, and a common line isn't all pairs.
    """
    live = docs.filter("status <> 'deleted'")
    once = live.groupBy("tenant_id", "content_hash").agg(F.min_by(F.struct("document_id", "chunk_count"), "document_id").alias("first")).select("first.document_id", "tenant_id", "first.chunk_count")
    rows = chunks.join(once.select("document_id"), "document_id", "left_semi").groupBy("tenant_id", "chunk_hash", "document_id").agg(F.count("*").alias("n"))
    rows = checkpointed(rows)  # read six times
    keys = ["tenant_id", "chunk_hash"]
    common = rows.groupBy(*keys).agg(F.count("*").alias("holders")).filter(F.col("holders") > HOT_CHUNK).select(*keys)
    rare = rows.join(common, keys, "left_anti")
    a, b = rare.select(*keys, F.col("document_id").alias("document_a_id")), rare.select(*keys, F.col("document_id").alias("document_b_id"), "n")
    met = a.join(b, keys).filter("document_a_id <> document_b_id").groupBy("tenant_id", "document_a_id", "document_b_id").agg(F.sum("n").alias("rarer"))

    held = rows.join(common, keys, "left_semi")
    sets = held.groupBy("tenant_id", "document_id").agg(F.sha2(F.concat_ws(",", F.array_sort(F.collect_list(F.concat_ws(":", "chunk_hash", "n")))), 256).alias("set"))
    items = held.join(sets.groupBy("tenant_id", "set").agg(F.min("document_id").alias("document_id")), ["tenant_id", "document_id"])
    both = items.select(*keys, F.col("set").alias("set_a")).join(items.select(*keys, F.col("set").alias("set_b"), "n"), keys).groupBy("tenant_id", "set_a", "set_b").agg(F.sum("n").alias("common"))
    of = lambda s: sets.select("tenant_id", F.col("document_id").alias(f"document_{s}_id"), F.col("set").alias(f"set_{s}"))
    heads = ranked(of("b"), ["tenant_id", "set_b"], F.asc("document_b_id"), most=most + 1, name="place").drop("place")
    heads = ranked(both.filter("common > 1").join(heads, ["tenant_id", "set_b"]), ["tenant_id", "set_a"], F.desc("common"), F.asc("document_b_id"), most=most + 1, name="place")
    by_sets = of("a").join(heads, ["tenant_id", "set_a"]).filter("document_a_id <> document_b_id").select("document_a_id", "document_b_id", F.col("common").alias("shared"))
    full = met.join(of("a"), ["tenant_id", "document_a_id"], "left").join(of("b"), ["tenant_id", "document_b_id"], "left").join(both, ["tenant_id", "set_a", "set_b"], "left")
    by_rows = full.select("document_a_id", "document_b_id", (F.col("rarer") + F.coalesce("common", F.lit(0))).alias("shared"))
    pairs = by_rows.unionByName(by_sets).groupBy("document_a_id", "document_b_id").agg(F.max("shared").alias("shared")).filter("shared > 1")
    sized = pairs.join(once.select(F.col("document_id").alias("document_b_id"), "chunk_count"), "document_b_id").withColumn("ratio", F.round(F.col("shared") / F.greatest("chunk_count", F.lit(1)), 6))
    return ranked(sized, ["document_a_id"], F.desc("shared"), F.asc("document_b_id"), most=most).select("document_a_id", "document_b_id", "shared", "ratio", "rank")


def overlap_conflicts(overlap: DataFrame) -> DataFrame:
    return overlap.filter("ratio > 0.3").select("document_a_id", "document_b_id", F.least("ratio", F.lit(1.0)).alias("confidence"))


def supersession_conflicts(docs: DataFrame, most: int = 5) -> DataFrame:
    """Pass 3: other documents of the tenant whose title begins, in either case, with the first 60 % of this one's, at least 5 characters.

    Titles are one row each before they meet: one's start with all beginnings of the other, so that only what matches meets. A title's
    documents are listed newest first.
    """
    live = docs.filter("status <> 'deleted'").select("document_id", "tenant_id", F.lower("title").alias("t"), "title", "created_at").filter(F.length("title") >= 5)
    named = live.select("tenant_id", "t", "title").distinct()
    own = named.select("tenant_id", F.expr("left(t, greatest(CAST(length(t) * 6 DIV 10 AS INT), 5))").alias("start"), F.col("title").alias("title_a"))
    other = named.select("tenant_id", F.explode(F.transform(F.sequence(F.lit(5), F.length("t")), lambda n: F.substring(F.col("t"), F.lit(1), n))).alias("start"), F.col("title").alias("title_b"))
    met = own.join(other, ["tenant_id", "start"]).filter("title_a <> title_b").select("tenant_id", "title_a", "title_b")
    newest = ranked(live.select("tenant_id", F.col("title").alias("title_b"), F.col("document_id").alias("document_b_id"), "created_at"), ["tenant_id", "title_b"], F.desc("created_at"), F.desc("document_b_id"), most=most, name="r")
    for_title = ranked(met.join(newest, ["tenant_id", "title_b"]), ["tenant_id", "title_a"], F.desc("created_at"), F.desc("document_b_id"), most=most)
    out = live.select("tenant_id", F.col("title").alias("title_a"), F.col("document_id").alias("document_a_id")).join(for_title, ["tenant_id", "title_a"])
    return out.select("document_a_id", "document_b_id", F.lit(0.6).alias("confidence"))


#: Vectors of a bucket of knn_join(), about, of which a vector meets one for each plane and one more.
BUCKET_ROWS = 64


def knn_join(left: DataFrame, right: DataFrame, k: int = 3, planes: int | None = None, tables: int = 6, seed: int = 7) -> DataFrame:
    """(left_id, right_id, distance, rank): the k nearest vectors of right for each of left, cosine, ids differing.

    Exact by default: blocks of left, a batch, meet those of right. With `planes`, both are bucketed in `tables` tables by that many seeded random
    hyperplanes each (0: one more for each doubling of right's counted rows), and meet inside a bucket and its neighbours at one flipped
    sign: approximate, without a scan of all pairs.
    """
    left, right = left.select("document_id", "embedding"), right.select("document_id", "embedding")
    if planes is None:
        return ranked(exact_nearest(left, right, k), ["left_id"], F.asc("distance"), F.asc("right_id"), most=k)
    seen = right.agg(F.count("*").alias("n"), F.max(F.size("embedding")).alias("width")).first()
    planes, width = planes or max(3, (seen["n"] // BUCKET_ROWS).bit_length()), max(seen["width"] or 1, 1)
    drawn = left.sparkSession.range(tables * planes * width).select("id", F.floor(F.col("id") / (planes * width)).alias("t"), (F.floor(F.col("id") / width) % planes).alias("p"), (F.col("id") % width + 1).alias("i"))
    drawn = drawn.orderBy("id").select(F.pmod(F.xxhash64(F.lit(seed), F.col("t").cast("int"), F.col("p").cast("int"), F.col("i").cast("int")), F.lit(2001)) / 1000.0 - 1.0)
    normals = np.array([x for (x,) in drawn.collect()]).reshape(tables, planes, width)
    return ranked(bucketed_nearest(left, right, k, planes, normals), ["left_id"], F.asc("distance"), F.asc("right_id"), most=k)


def contradiction_conflicts(neighbours: DataFrame, docs: DataFrame, reach: float = 0.15) -> DataFrame:
    """Pass 4: one row for each unordered pair of near documents with different content; confidence falls with distance."""
    live = docs.filter("status <> 'deleted'").select("document_id", "content_hash")
    near = neighbours.filter(F.col("distance") <= reach).select(F.least("left_id", "right_id").alias("document_a_id"), F.greatest("left_id", "right_id").alias("document_b_id"), "distance").groupBy("document_a_id", "document_b_id").agg(F.min("distance").alias("distance"))
    a = live.select(F.col("document_id").alias("document_a_id"), F.col("content_hash").alias("ha"))
    b = live.select(F.col("document_id").alias("document_b_id"), F.col("content_hash").alias("hb"))
    pairs = near.join(a, "document_a_id").join(b, "document_b_id").filter("ha <> hb")
    return pairs.select("document_a_id", "document_b_id", F.round(F.greatest(F.lit(0.0), 1 - F.col("distance") / reach), 3).alias("confidence"))


def all_conflicts(**passes: DataFrame) -> DataFrame:
    """Conflict candidates of all passes with an id that type and pair decide, status new."""
    out = None
    for kind, df in passes.items():
        rows = df.select("document_a_id", "document_b_id", "confidence").withColumn("conflict_type", F.lit(kind))
        out = rows if out is None else out.unionByName(rows)
    return out.withColumn("conflict_id", F.sha2(F.concat_ws("|", "conflict_type", "document_a_id", "document_b_id"), 256)).withColumn("status", F.lit("new"))


def flag_documents(docs: DataFrame, conflicts: DataFrame) -> DataFrame:
    """docs with conflict_status: 'conflicts_detected' where a candidate names them."""
    named = conflicts.select(F.explode(F.array("document_a_id", "document_b_id")).alias("document_id")).distinct().withColumn("__hit", F.lit(True))
    return docs.join(named, "document_id", "left").withColumn("conflict_status", F.when(F.col("__hit"), "conflicts_detected")).drop("__hit")


def conflict_tasks(conflicts: DataFrame, above: float = 0.5) -> DataFrame:
    return conflicts.filter(F.col("confidence") > above).select("conflict_id", F.lit("conflict_review").alias("task_type"), F.lit("new").alias("status"))


def similar_claim_conflicts(claims: DataFrame, similar: DataFrame, least: float = 0.7) -> DataFrame:
    """(claim_a, claim_b, predicate_a, predicate_b, confidence): active claims of one tenant on two predicates that `similar`
    (tenant_id, predicate_a, predicate_b, similarity; normalised, of whatever measure) finds alike from `least` on, with different values. Confidence is 0.9 times the
    similarity; each predicate and value is stood for by its surest claim."""
    p, v = F.lower(F.trim("predicate")).alias("p"), F.lower(F.trim("object_value")).alias("value")
    best = ranked(claims.filter("status = 'active'").select("tenant_id", p, v, "claim_id", "confidence"), ["tenant_id", "p", "value"], F.desc("confidence"), F.asc("claim_id"), most=1)
    a, b = (best.select("tenant_id", F.col("p").alias(f"predicate_{s}"), F.col("value").alias(f"value_{s}"), F.col("claim_id").alias(f"claim_{s}")) for s in "ab")
    near = similar.filter(F.col("similarity") >= least)
    met = near.join(a, ["tenant_id", "predicate_a"]).join(b, ["tenant_id", "predicate_b"]).filter("value_a <> value_b AND (predicate_a <> predicate_b OR value_a < value_b)")
    return met.select("claim_a", "claim_b", "predicate_a", "predicate_b", F.round(F.col("similarity") * 0.9, 6).alias("confidence"))


def claim_conflicts(claims: DataFrame, same_subject: bool = False) -> DataFrame:
    """(claim_a, claim_b, predicate, value_a, value_b, variants): active claims of one tenant with one normalised predicate and different values.

    Each value is stood for by its surest claim and meets that of the predicate's surest value: one row for each further value. The values of
    a predicate, `variants` many, all conflict with each other, so the predicate is the class and no two of its values need a row of their own.
    Claims without a value conflict with none; cluster_variants() has the claims of each value.
    """
    p, v = F.lower(F.trim("predicate")).alias("p"), F.lower(F.trim("object_value")).alias("value")
    keys = ["tenant_id", "p", *(["subject"] if same_subject else [])]
    best = claims.filter("status = 'active' AND object_value IS NOT NULL").select("tenant_id", "subject", p, v, "claim_id", "confidence")
    best = ranked(best, [*keys, "value"], F.desc("confidence"), F.asc("claim_id"), most=1)
    surest = F.struct((-F.col("confidence")).alias("below"), "claim_id", "value")
    heads = best.groupBy(*keys).agg(F.min(surest).alias("head"), F.count("*").alias("variants")).filter("variants > 1")
    met = best.join(heads, keys).filter(F.col("value") != F.col("head.value"))
    return met.select(F.col("head.claim_id").alias("claim_a"), F.col("claim_id").alias("claim_b"), F.col("p").alias("predicate"), F.col("head.value").alias("value_a"), F.col("value").alias("value_b"), "variants")


def similar_predicates(claims: DataFrame, least: float = 0.45) -> DataFrame:
    """(tenant_id, predicate_a, predicate_b, similarity): pairs of distinct predicates of a tenant whose trigram similarity is above `least`.

    Each two blocks of a tenant's distinct predicates are compared in a task (blocks.trigram_pairs): work grows with the square of their number,
    but memory doesn't, and only similar pairs are shuffled.
    """
    p = claims.select("tenant_id", F.lower(F.trim("predicate")).alias("key")).distinct().withColumn("words", padded_words(F.col("key"))).filter("words <> ''")
    return trigram_pairs(p, least).select("tenant_id", F.col("a").alias("predicate_a"), F.col("b").alias("predicate_b"), "similarity")


def cosine_join(vectors: DataFrame, least: float = 0.7) -> DataFrame:
    """(tenant_id, a, b, similarity): every pair a < b of a tenant's keys whose vectors have a cosine of `least` (above 0) or more; exact.

    vectors: tenant_id, key and embedding; zero vectors and null ones are like none. Each two blocks of a tenant's vectors are compared in a
    task: work grows with the square of their number, but memory doesn't, and only pairs of the result leave a task.
    """
    return cosine_pairs(vectors.filter(norm(F.col("embedding")) > 0), least)


def predicates_by_meaning(claims: DataFrame, embedder: Callable[[Column], Column], least: float = 0.7) -> DataFrame:
    """(tenant_id, predicate_a, predicate_b, similarity) for similar_claim_conflicts(): a tenant's distinct active predicates whose embeddings
    have a cosine of `least` or more, each with itself too, at 1: claims on one predicate conflict as well."""
    own = claims.filter("status = 'active'").select("tenant_id", F.lower(F.trim("predicate")).alias("key")).distinct()
    made = checkpointed(own.withColumn("embedding", embedder(F.col("key"))))
    near = cosine_join(made, least).select("tenant_id", F.col("a").alias("predicate_a"), F.col("b").alias("predicate_b"), "similarity")
    return near.unionByName(own.select("tenant_id", F.col("key").alias("predicate_a"), F.col("key").alias("predicate_b"), F.lit(1.0).alias("similarity")))
