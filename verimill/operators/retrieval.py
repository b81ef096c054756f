"""Batch retrieval: routing, index lookup, structured answers, hybrid search with rank fusion, confidence, logs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import dot, normalize_text, norm, rrf, terms
from ..sources.buckets import scratch
from .analytics import conflict_summary, document_counts, quality_overview
from .filters import searchable

# Patterns that decide how a query is answered, in order, with the reason given.
STRUCTURED_PATTERNS = (
    (r"\bhow many\b", "aggregation query"),
    (r"\bcount\b.*\bdocuments?\b", "document count query"),
    (r"\blist all\b", "listing query"),
    (r"\bwhat documents?\b.*\babout\b", "document search"),
    (r"\bwhich documents?\b", "document filter"),
    (r"\blatest\b.*\bdocuments?\b", "recency query"),
    (r"\brecent\b.*\bdocuments?\b", "recency query"),
    (r"\bstatus\b.*\bdocuments?\b", "status filter"),
    (r"\bquality score\b", "quality metric query"),
    (r"\bconflicts?\b.*\bbetween\b", "conflict query"),
    (r"\bwho (uploaded|created|modified)\b", "provenance query"),
)
RAG_PATTERNS = (
    (r"\bwhat is\b", "definition query"),
    (r"\bhow (do|does|to|can)\b", "how-to query"),
    (r"\bexplain\b", "explanation query"),
    (r"\bwhy\b", "reasoning query"),
    (r"\bdescribe\b", "description query"),
    (r"\bwhat.*\bmean\b", "meaning query"),
    (r"\bdifference between\b", "comparison query"),
    (r"\btell me about\b", "knowledge query"),
)
K1, B = 1.2, 0.75


def checkpointed(df: DataFrame) -> DataFrame:
    """df as written to the folder that spark.checkpoint.dir names, as compressed Parquet; only a local session may do without, and has a folder
    of its own. What was shuffled for it goes once it is written."""
    spark, path, freed = df.sparkSession, scratch(df.sparkSession), "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(freed, "false")
    spark.conf.set(freed, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(freed, before)
    return spark.read.schema(df.schema).parquet(path)


def ranked(df: DataFrame, keys: list[str], *order: Column, most: int | None = None, name: str = "rank") -> DataFrame:
    """Rank from 1 inside each group; with `most`, the first rows only, which Spark cuts before it shuffles."""
    out = df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("long"))
    return out if most is None else out.filter(F.col(name) <= most)


def route(queries: DataFrame) -> DataFrame:
    """queries with query_type, confidence and reason."""
    text = F.lower(F.trim("query_text"))
    reason, kind, sure = None, None, None
    for patterns, name, value in ((STRUCTURED_PATTERNS, "structured", 0.8), (RAG_PATTERNS, "rag", 0.9)):
        for pattern, why in patterns:
            hit = text.rlike(pattern)
            reason = F.when(hit, why) if reason is None else reason.when(hit, why)
            kind = F.when(hit, name) if kind is None else kind.when(hit, name)
            sure = F.when(hit, value) if sure is None else sure.when(hit, value)
    return queries.withColumns({"query_type": kind.otherwise("rag"), "confidence": sure.otherwise(0.5), "reason": reason.otherwise("default_rag")})


def grams_of(c: Column, sizes: Column) -> Column:
    """Distinct runs of characters of a text, of the given sizes."""
    of = lambda n: F.transform(F.sequence(F.lit(1), F.length(c) - n + 1), lambda i: F.substring(c, i, n))
    return F.array_distinct(F.flatten(F.transform(F.filter(sizes, lambda n: n <= F.length(c)), of)))


def threes(c: Column) -> Column:
    """Distinct runs of three characters; of a shorter text, itself."""
    return grams_of(c, F.array(F.least(F.length(c), F.lit(3))))


def meet(rows: DataFrame, grams: Column, texts: DataFrame, text: str) -> DataFrame:
    """rows (tenant_id, ...) with the texts of their tenant that hold the rarest of the row's `grams`, of up to three characters each. Of the
    texts' own grams only those that rows have are counted, before they are shuffled, and only the rarest ones meet."""
    have = texts.select("tenant_id", text, F.explode(grams_of(F.col(text), F.array(F.lit(1), F.lit(2), F.lit(3)))).alias("gram"))
    handle = rows.select("*", F.explode(grams).alias("gram"))
    often = narrowed(have.drop(text), handle.select("tenant_id", "gram").distinct(), ["tenant_id", "gram"]).groupBy("tenant_id", "gram").agg(F.count("*").alias("n"))
    known = handle.join(often, ["tenant_id", "gram"], "left")
    rarest = known.groupBy(*rows.columns).agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("g")).filter("g.n > 0")
    rarest = checkpointed(rarest.select(*rows.columns, F.col("g.gram").alias("gram")))
    return rarest.join(narrowed(have, rarest.select("tenant_id", "gram").distinct(), ["tenant_id", "gram"]), ["tenant_id", "gram"])


def index_lookup(index: DataFrame, queries: DataFrame, most: int = 5) -> DataFrame:
    """(query_id, subject, predicate, value, confidence, strategy, rank): entries of the query's tenant whose predicate holds the normalised
    query, or else its last two words in order.

    Queries and predicates meet on tenant and the query's rarest run of three characters (fewer, if a word has fewer), which whatever holds
    it has too; then the whole pattern is tested. Equal queries of a tenant are looked up once.
    """
    entries = checkpointed(index.select("tenant_id", "predicate_normalized", "subject", "predicate", "value", "confidence"))  # read three times
    asked = queries.select("query_id", "tenant_id", normalize_text(F.col("query_text")).alias("q")).filter("q <> ''")
    once, own = asked.select("tenant_id", "q").distinct(), ["tenant_id", "q"]
    predicates = checkpointed(entries.select("tenant_id", "predicate_normalized").distinct())
    one = checkpointed(meet(once, threes(F.col("q")), predicates, "predicate_normalized").filter(F.contains("predicate_normalized", F.col("q"))).select(*own, "predicate_normalized", F.lit(1).alias("strategy")))
    missed = once.join(one.select(*own).distinct(), own, "left_anti").withColumn("w", F.split("q", " ")).filter(F.size("w") >= 2).select(*own, F.element_at("w", -2).alias("a"), F.element_at("w", -1).alias("b"))
    two = meet(missed, F.concat(threes(F.col("a")), threes(F.col("b"))), predicates, "predicate_normalized").filter(F.expr("predicate_normalized LIKE concat('%', a, '%', b, '%')")).select(*own, "predicate_normalized", F.lit(2).alias("strategy"))
    hits = one.unionByName(two).join(entries, ["tenant_id", "predicate_normalized"])
    top = ranked(hits, own, F.desc("confidence"), F.asc("subject"), F.asc("predicate"), most=most)
    return asked.join(top, own).select("query_id", "subject", "predicate", "value", "confidence", "strategy", "rank")


def answer_kind(query_text: str = "query_text") -> Column:
    # The words that decide.
    q = F.lower(query_text)
    return F.when(q.contains("how many") & q.contains("document"), "document_count").when(q.contains("quality") & (q.contains("score") | q.contains("overview")), "quality_overview").when(q.contains("conflict"), "conflict_summary").when(q.contains("latest") | q.contains("recent"), "latest_documents").otherwise("title_search")


def title_search(docs: DataFrame, queries: DataFrame, most: int = 10) -> DataFrame:
    """docs with query_id and rank: the newest documents of the query's tenant, deleted ones left out, whose title holds the query anywhere,
    letters of either case. Equal queries of a tenant are searched once. Null and empty queries find nothing; % and _ stand for themselves."""
    asked = queries.select("query_id", "tenant_id", F.lower("query_text").alias("q")).filter("q <> ''")
    live = docs.filter("status <> 'deleted'").withColumn("t", F.lower("title"))
    wanted = asked.select("tenant_id", "q").distinct()
    held = meet(wanted, threes(F.col("q")), live.select("tenant_id", "t").distinct(), "t").filter(F.contains("t", F.col("q"))).select("tenant_id", "q", "t")
    top = ranked(held.join(live, ["tenant_id", "t"]), ["tenant_id", "q"], F.desc("created_at"), F.asc("document_id"), most=most)
    return asked.join(top, ["tenant_id", "q"]).drop("q", "t")


def answer_documents(queries: DataFrame, docs: DataFrame, most: int = 10) -> DataFrame:
    """(query_id, answer_type, document_id, title, status, quality_score, rank): the documents that answer a structured query, newest first.

    A query for the latest documents gets those of its tenant; a title search those whose title holds the query, whatever the case. Equal
    queries of a tenant are searched once. Null and empty queries find nothing.
    """
    asked = queries.select("query_id", "tenant_id", "query_text", answer_kind().alias("answer_type"))
    live = docs.select("tenant_id", "document_id", "title", "status", "quality_score", "created_at")
    newest = ranked(live.filter("status <> 'deleted'"), ["tenant_id"], F.desc("created_at"), F.asc("document_id"), most=most)
    latest = asked.filter("answer_type = 'latest_documents'").join(newest, "tenant_id")
    titles = title_search(live, asked.filter("answer_type = 'title_search'"), most).withColumn("answer_type", F.lit("title_search"))
    columns = ["query_id", "answer_type", "document_id", "title", "status", "quality_score", "rank"]
    return latest.select(*columns).unionByName(titles.select(*columns))


def structured_answers(queries: DataFrame, docs: DataFrame, conflicts: DataFrame) -> DataFrame:
    """(query_id, answer_type, answer) of structured queries of tenants: each aggregate is computed once and joined to who asks for it."""
    # The sentences of the answers.
    asked = queries.withColumn("answer_type", answer_kind())
    counts = document_counts(docs).select("tenant_id", F.lit("document_count").alias("answer_type"), F.format_string("Total: %d documents (%d indexed, %d quarantined)", "total", "indexed", "quarantined").alias("answer"))
    quality = quality_overview(docs).select("tenant_id", F.lit("quality_overview").alias("answer_type"), F.format_string("Average quality: %.2f (range: %.2f-%.2f, %d high quality, %d low quality)", "avg_score", "min_score", "max_score", "high_quality", "low_quality").alias("answer"))
    per = conflict_summary(conflicts).groupBy("tenant_id").agg(F.sum("n").alias("total"), F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), "status"))).alias("parts"))
    summary = per.select("tenant_id", F.lit("conflict_summary").alias("answer_type"), F.concat(F.col("total"), F.lit(" conflicts: "), F.array_join(F.transform("parts", lambda p: F.concat_ws(" ", -p["n"], p["status"])), ", ")).alias("answer"))
    latest = docs.filter("status <> 'deleted'").groupBy("tenant_id").agg(F.count("*").alias("n")).select("tenant_id", F.lit("latest_documents").alias("answer_type"), F.concat(F.lit("Latest "), F.least("n", F.lit(10)), F.lit(" documents retrieved")).alias("answer"))
    made = counts.unionByName(quality).unionByName(summary).unionByName(latest)
    found = answer_documents(asked.filter("answer_type = 'title_search'"), docs).groupBy("query_id").agg(F.count("*").alias("found"))
    title = F.when(F.col("answer_type") == "title_search", F.concat(F.lit("Found "), F.coalesce("found", F.lit(0)), F.lit(" documents matching query")))
    return asked.join(made, ["tenant_id", "answer_type"], "left").join(found, "query_id", "left").select("query_id", "answer_type", F.coalesce("answer", title).alias("answer"))


def evidence(results: DataFrame, docs: DataFrame, conflicts: DataFrame, per_source: int = 3, least: float = 0.2) -> DataFrame:
    """(query_id, document_id, rank, versions, conflicting): what of the results goes before a model.

    Documents below `least` quality are left out, of equal texts the best ranked stays, of the documents of one source and title the newest
    version (`versions` says how many there were), and of a source at most `per_source`. conflicting: an open conflict names this document and
    another of the same evidence.
    """
    d = docs.select("document_id", "content_hash", "source_id", "title", "version", "quality_score")
    found = results.select("query_id", "document_id", "rank").join(d, "document_id").filter(F.coalesce("quality_score", F.lit(1.0)) >= least)
    once = ranked(found, ["query_id", "content_hash"], F.asc("rank"), most=1, name="h")
    of_title = once.withColumn("versions", F.count("*").over(Window.partitionBy("query_id", "source_id", "title")))  # a query has top_k rows
    newest = ranked(of_title, ["query_id", "source_id", "title"], F.desc("version"), F.asc("rank"), most=1, name="v")
    kept = ranked(newest, ["query_id", "source_id"], F.asc("rank"), most=per_source, name="s").select("query_id", "document_id", "rank", "versions")
    sides = F.explode(F.array(F.struct(F.col("document_a_id").alias("document_id"), F.col("document_b_id").alias("other")), F.struct(F.col("document_b_id").alias("document_id"), F.col("document_a_id").alias("other")))).alias("x")
    open_ = conflicts.filter("status = 'new' AND document_a_id <> document_b_id").select(sides).select("x.*")
    met = kept.select("query_id", "document_id").join(open_, "document_id").join(kept.select("query_id", F.col("document_id").alias("other")), ["query_id", "other"], "left_semi")
    hit = met.select("query_id", "document_id").distinct().withColumn("conflicting", F.lit(True))
    return kept.join(hit, ["query_id", "document_id"], "left").fillna(False, ["conflicting"])


def by_chunk(postings: DataFrame) -> DataFrame:
    """Postings by chunk: (tenant_id, document_id, chunk_id, length, words, tfs), a chunk's distinct terms in order with a line end between
    each two, and how often each occurs. Postings (tenant_id, document_id, chunk_id, term, tf) are grouped; postings by chunk stay."""
    if "words" in postings.columns:
        return postings
    held = postings.groupBy("tenant_id", "document_id", "chunk_id").agg(F.sum("tf").alias("length"), F.array_sort(F.collect_list(F.struct("term", "tf"))).alias("h"))
    return held.select("tenant_id", "document_id", "chunk_id", "length", F.array_join(F.col("h.term"), "\n").alias("words"), F.col("h.tf").cast("array<int>").alias("tfs"))


#: Distinct terms of a batch that are broadcast.
TERM_ROWS = 200_000


def narrowed(rows: DataFrame, wanted: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose keys are wanted. Up to TERM_ROWS of these, counted, are broadcast."""
    return rows.join(F.broadcast(wanted) if wanted.limit(TERM_ROWS + 1).count() <= TERM_ROWS else wanted, keys, "left_semi")


def lexical_scores(postings: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, chunk_id, document_id, score): BM25 of the tenant's chunks that hold every term of the query.

    postings: as by_chunk() takes them. A chunk that holds all terms holds the rarest, so a chunk meets the queries whose rarest term it has,
    and its own row says whether the others are there and what they weigh. Number of chunks, their mean length and the terms' frequencies are
    the tenant's own. Frequencies are counted before they are shuffled; the chunks aren't shuffled unless the queries are too many to be
    broadcast, and then only those that have met.
    """
    held = by_chunk(postings)
    asked = queries.withColumn("q", F.array_distinct(terms(F.col("query_text")))).select("query_id", "tenant_id", F.size("q").alias("n_terms"), F.explode("q").alias("term"))
    # a chunk counts for its terms and, in the same pass, once for its tenant, under the empty term that no text has
    each = held.select("tenant_id", "length", F.explode(F.split(F.concat(F.lit("\n"), "words"), "\n")).alias("term"))
    wanted = asked.select("tenant_id", F.explode(F.array(F.lit(""), "term")).alias("term")).distinct()
    counts = checkpointed(narrowed(each, wanted, ["tenant_id", "term"]).groupBy("tenant_id", "term").agg(F.count("*").alias("df"), F.sum("length").alias("l")))
    total = counts.filter("term = ''").select("tenant_id", F.col("df").alias("chunks"), (F.col("l") / F.col("df")).alias("mean"))
    often = counts.filter("term <> ''").drop("l")
    known = asked.join(often, ["tenant_id", "term"]).join(total, "tenant_id")
    idf = F.log(1 + (F.col("chunks") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    per = known.groupBy("tenant_id", "query_id").agg(F.min(F.struct("df", "term")).alias("r"), F.count("*").alias("k"), F.first("n_terms").alias("n_terms"), F.first("mean").alias("mean"), F.collect_list(F.struct("term", idf.alias("idf"))).alias("wanted"))
    whole = checkpointed(per.filter("k = n_terms").select("tenant_id", F.col("r.term").alias("term"), "query_id", "mean", "wanted"))
    if whole.limit(BATCH_ROWS + 1).count() <= BATCH_ROWS:
        hits = held.select("*", F.explode(F.split("words", "\n")).alias("term")).join(F.broadcast(whole), ["tenant_id", "term"])
    else:
        met = narrowed(held.select("tenant_id", "chunk_id", F.explode(F.split("words", "\n")).alias("term")), whole.select("tenant_id", "term").distinct(), ["tenant_id", "term"])
        hits = met.join(whole, ["tenant_id", "term"]).drop("term").join(held, ["tenant_id", "chunk_id"])
    held_at = F.transform("wanted", lambda w: F.struct(w["idf"].alias("idf"), F.get("tfs", (F.array_position("w", w["term"]) - 1).cast("int")).alias("tf")))
    hits = hits.select("query_id", "chunk_id", "document_id", "length", "mean", "wanted", "tfs", F.split("words", "\n").alias("w")).select("query_id", "chunk_id", "document_id", "length", "mean", held_at.alias("found"))
    weight = lambda x: x["idf"] * x["tf"] * (K1 + 1) / (x["tf"] + K1 * (1 - B + B * F.col("length") / F.col("mean")))
    score = F.aggregate("found", F.lit(0.0), lambda s, x: s + weight(x))  # null if a term is missing
    return hits.select("query_id", "chunk_id", "document_id", score.alias("score")).filter("score IS NOT NULL")


def lexical_best(postings: DataFrame, queries: DataFrame, most: int = 60) -> DataFrame:
    """(query_id, document_id, score, rank): the `most` best documents of each query, by their best chunk in lexical_scores(), ties by id. Queries
    of a tenant with the same terms are answered once, so hits grow with the sets of terms that are asked for, not with the queries."""
    own = queries.select("query_id", "tenant_id", "query_text", F.array_sort(F.array_distinct(terms(F.col("query_text")))).alias("t")).filter(F.size("t") > 0)
    sets = checkpointed(own.groupBy("tenant_id", "t").agg(F.min(F.struct("query_id", "query_text")).alias("f")).select("tenant_id", "t", "f.*"))
    best = lexical_scores(postings, sets.drop("t")).groupBy("query_id", "document_id").agg(F.round(F.max("score"), 9).alias("score"))
    top = ranked(best, ["query_id"], F.desc("score"), F.asc("document_id"), most=most).withColumnRenamed("query_id", "asked")
    asking = own.select("query_id", "tenant_id", "t").join(sets.select("tenant_id", "t", F.col("query_id").alias("asked")), ["tenant_id", "t"])
    return asking.join(top, "asked").select("query_id", "document_id", "score", "rank")


#: Rows of a batch that is broadcast, and places that a larger one's partners are dealt to.
BATCH_ROWS, BLOCKS = 5000, 64


def with_batch(rows: DataFrame, batch: DataFrame, keys: list[str], spread: str) -> DataFrame:
    """Every row with every row of the batch that has its keys. A batch of up to BATCH_ROWS, counted, is broadcast; a larger one goes to each
    of BLOCKS blocks that the rows are dealt to by `spread`, so that no key is one task."""
    if batch.limit(BATCH_ROWS + 1).count() <= BATCH_ROWS:
        return rows.join(F.broadcast(batch), keys) if keys else rows.join(F.broadcast(batch))
    dealt = rows.withColumn("__block", F.pmod(F.xxhash64(spread), F.lit(BLOCKS)).cast("int"))
    return dealt.join(batch.withColumn("__block", F.explode(F.sequence(F.lit(0), F.lit(BLOCKS - 1)))), [*keys, "__block"]).drop("__block")


def semantic_distances(vectors: DataFrame, queries: DataFrame, digits: int = 6) -> DataFrame:
    """(query_id, document_id, distance): cosine distance of every query vector of the batch to every vector of its tenant's documents."""
    d = vectors.select("tenant_id", "document_id", "embedding", norm(F.col("embedding")).alias("dn"))
    q = queries.select("tenant_id", "query_id", F.col("embedding").alias("qe"), norm(F.col("embedding")).alias("qn"))
    n = F.col("dn") * F.col("qn")
    return with_batch(d, q, ["tenant_id"], "document_id").select("query_id", "document_id", F.round(1 - F.when(n > 0, dot(F.col("embedding"), F.col("qe")) / n).otherwise(0.0), digits).alias("distance"))


def fuse(semantic: DataFrame, lexical: DataFrame, boost: DataFrame | None = None, w_semantic: float = 1.0, w_lexical: float = 1.0, k: int = 60, boost_weight: float = 1.0) -> DataFrame:
    """Reciprocal rank fusion of two ranked lists (query_id, document_id, rank): full outer by one aggregation, then the feedback boost."""
    both = semantic.select("query_id", "document_id", F.col("rank").alias("semantic_rank"), F.lit(None).cast("long").alias("lexical_rank")).unionByName(lexical.select("query_id", "document_id", F.lit(None).cast("long").alias("semantic_rank"), F.col("rank").alias("lexical_rank")))
    out = both.groupBy("query_id", "document_id").agg(F.max("semantic_rank").alias("semantic_rank"), F.max("lexical_rank").alias("lexical_rank"))
    score = rrf(w_semantic, F.col("semantic_rank"), k) + rrf(w_lexical, F.col("lexical_rank"), k)
    if boost is None:
        return out.withColumn("score", score)
    return out.join(boost, "document_id", "left").withColumn("score", score + F.coalesce("boost", F.lit(0.0)) * F.lit(boost_weight)).drop("boost")


def hybrid_search(docs: DataFrame, vectors: DataFrame, postings: DataFrame, queries: DataFrame, boost: DataFrame | None = None, top_k: int = 20, w_semantic: float = 1.0, w_lexical: float = 1.0, k: int = 60, boost_weight: float = 1.0, acl: DataFrame | None = None, narrowed_postings: bool = False) -> DataFrame:
    """(query_id, document_id, semantic_rank, lexical_rank, score, rank) of the best documents of each query of the batch.

    queries: query_id, tenant_id, query_text and embedding. A query sees its tenant's documents only. What may not be searched is dropped before
    ranking, and so is what `docs` lacks: filters by source type, document type and metadata are applied to it by the caller. With `acl`
    (document_id, principal_id, permission), documents that have a list are seen by queries whose principal_id it names. Each list is cut at
    3 * top_k. postings: as lexical_scores() takes them; narrowed_postings says that they are of searchable documents of `docs` only, and saves
    the join that drops the others.
    """
    open_ = searchable(docs).select("document_id", "tenant_id")
    parts = [open_] if acl is None else [open_.join(acl, "document_id", "left_anti"), open_.join(acl, "document_id", "left_semi")]
    dense = [semantic_distances(vectors.select("document_id", "embedding").join(p, "document_id"), queries) for p in parts]
    held = postings if narrowed_postings else by_chunk(postings).join(open_.select("document_id"), "document_id", "left_semi")
    if acl is None:
        near, sparse = dense[0], lexical_best(held, queries, 3 * top_k)
    else:
        best = lexical_scores(held, queries).groupBy("query_id", "document_id").agg(F.round(F.max("score"), 9).alias("s"))
        granted = acl.filter(F.col("permission").isin("read", "write", "admin")).select("document_id", "principal_id").distinct()
        asking = queries.select("query_id", "principal_id")
        named = lambda pairs: pairs.join(asking, "query_id").join(granted, ["document_id", "principal_id"], "left_semi").select(*pairs.columns)
        near = dense[0].unionByName(named(dense[1]))
        best = best.join(acl, "document_id", "left_anti").unionByName(named(best.join(acl, "document_id", "left_semi")))
        sparse = ranked(best, ["query_id"], F.desc("s"), F.asc("document_id"), most=3 * top_k)
    semantic = ranked(near, ["query_id"], F.asc("distance"), F.asc("document_id"), most=3 * top_k)
    fused = fuse(semantic, sparse, boost, w_semantic, w_lexical, k, boost_weight).withColumn("score", F.round("score", 9))
    return ranked(fused, ["query_id"], F.desc("score"), F.asc("document_id"), most=top_k)


def provenance(results: DataFrame, docs: DataFrame, sources: DataFrame) -> DataFrame:
    """Results with what shows where a document comes from: title, path, document type, version, quality and source name and type."""
    d = docs.select("document_id", "title", "source_path", "doc_type", "version", "quality_score", "source_id")
    return results.join(d, "document_id").join(sources.select("source_id", F.col("name").alias("source_name"), "source_type"), "source_id", "left")


def rerank(results: DataFrame, scores: DataFrame | None = None, top_k: int = 5) -> DataFrame:
    """Results by an external score (query_id, document_id, text score), the fused rank breaking ties; without scores the first top_k stay."""
    if scores is None:
        return results.filter(F.col("rank") <= top_k)
    joined = results.join(scores, ["query_id", "document_id"], "left").fillna(0.0, ["rerank_score"])
    return ranked(joined.withColumnRenamed("rank", "fused_rank"), ["query_id"], F.desc("rerank_score"), F.asc("fused_rank"), most=top_k)


def confidence(results: DataFrame, queries: DataFrame) -> DataFrame:
    """Per query: confidence, source_count, top_score, answerable; queries without a result have 0, 0, 0 and false."""
    per = results.groupBy("query_id").agg(F.max("score").alias("top"), F.countDistinct("document_id").alias("source_count"), F.count("*").alias("hits"))
    sure = F.least(F.least(F.col("top") / 0.033, F.lit(1.0)) * 0.8 + F.least(F.col("source_count") / 3.0, F.lit(1.0)) * 0.2, F.lit(1.0))
    per = per.select("query_id", F.round(sure, 3).alias("retrieval_confidence"), "source_count", F.round("top", 6).alias("top_score"), ((sure > 0.3) & (F.col("hits") >= 2)).alias("answerable"))
    return queries.select("query_id").join(per, "query_id", "left").fillna({"retrieval_confidence": 0.0, "source_count": 0, "top_score": 0.0, "answerable": False})


def retrieve(queries: DataFrame, index: DataFrame, search: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Three layers for a batch: (query_id, routed_to, reason, index_hits, retrieval_confidence, answerable).

    An index hit sets the route to index; a structured query isn't searched; a RAG query is searched even after an index hit.
    """
    routed = route(queries)
    hits = index_lookup(index, queries).groupBy("query_id").agg(F.count("*").alias("index_hits"), F.max("confidence").alias("index_confidence"))
    rag = routed.filter("query_type = 'rag'")
    found = confidence(search(rag), rag)
    out = routed.select("query_id", "query_type", "reason").join(hits, "query_id", "left").join(found, "query_id", "left")
    hit = F.coalesce("index_hits", F.lit(0)) > 0
    return out.select(
        "query_id",
        F.when(hit, "index").otherwise(F.col("query_type")).alias("routed_to"),
        F.when(hit, "knowledge_index_hit").otherwise(F.col("reason")).alias("reason"),
        F.coalesce("index_hits", F.lit(0)).alias("index_hits"),
        F.when(hit, F.greatest(F.coalesce("retrieval_confidence", F.lit(0.0)), F.col("index_confidence"))).otherwise(F.coalesce("retrieval_confidence", F.lit(0.0))).alias("retrieval_confidence"),
        (hit | (F.col("query_type") == "structured") | F.coalesce("answerable", F.lit(False))).alias("answerable"),
    )


def searched(queries: DataFrame, search: Callable[[DataFrame], DataFrame], most: int = 10) -> DataFrame:
    """(query_id, document_id, rank): the first `most` documents that retrieve() would show. Structured queries are answered without documents,
    so they have none; an index hit doesn't take a RAG query's documents away."""
    return search(route(queries).filter("query_type = 'rag'")).filter(F.col("rank") <= most).select("query_id", "document_id", "rank")


def retrieval_log(answers: DataFrame, results: DataFrame, queries: DataFrame, now: Column) -> DataFrame:
    """Rows to append to the retrieval log: what was asked, where it went, and the documents returned in order."""
    returned = results.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "document_id"))), lambda x: x["document_id"]).alias("documents_returned"))
    return answers.join(queries.select("query_id", "query_text"), "query_id").join(returned, "query_id", "left").withColumn("created_at", now)


def accept_feedback(feedback: DataFrame) -> DataFrame:
    """Feedback with valid: rating from -1 to 1, and an outcome of those known, or none."""
    return feedback.withColumn("valid", F.coalesce(F.col("rating").between(-1, 1), F.lit(False)) & (F.col("outcome").isNull() | F.col("outcome").isin("resolved", "partially_resolved", "unresolved", "escalated")))


def embedded_search(docs: DataFrame, texts: DataFrame, postings: DataFrame, queries: DataFrame, embedder: Callable[[Column], Column], top_k: int = 20, narrowed_postings: bool = False) -> DataFrame:
    """hybrid_search() for texts (document_id, text) and queries that have no vectors yet: both are embedded, each distinct text once."""
    from ..functions.extension import embed

    vectors, cache = embed(texts.select("document_id", "text"), embedder, text="text")
    asked, _ = embed(queries.select("query_id", "tenant_id", "query_text"), embedder, cache, text="query_text")
    return hybrid_search(docs, vectors.select("document_id", "embedding"), postings, asked.select("query_id", "tenant_id", "query_text", "embedding"), top_k=top_k, narrowed_postings=narrowed_postings)
