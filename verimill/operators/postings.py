"""Postings by chunk, and stored postings with block maxima: BM25 top-k that reads only the blocks that can still matter.

A tenant's documents are dealt to ranges of at most about RANGE_DOCS: by the length of their shortest chunk, so that what can score high lies
together and bounds are tight, and inside a class of lengths by the hash of their ids. A block is a term's postings in one range, with the
largest weight among them. A query's bound in a range is the sum of its terms' largest impacts there; ranges that lack a term are skipped, the
best ranges are scored first, and what they give skips all others whose bound is below it.

Neighbouring ranges make a shard of about SHARD_DOCS documents. A shard meets the queries of its tenant in one task, so neither a query's
ranges nor its hits are shuffled, only its best documents of a shard.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import terms
from .retrieval import K1, TERM_ROWS, B, by_chunk, checkpointed, narrowed, ranked

#: Documents of a range, about; a block has at most their chunks. Documents of a shard, about.
RANGE_DOCS, SHARD_DOCS = 256, 4096


def count_terms(chunks: DataFrame) -> DataFrame:
    """Postings by chunk (see by_chunk()) of chunks (tenant_id, document_id, chunk_id, chunk_text), each counted in its own row: no shuffle."""
    t = chunks.filter(F.col("chunk_text").rlike(r"[\p{L}\p{N}]")).select("tenant_id", "document_id", "chunk_id", F.array_sort(terms(F.col("chunk_text"))).alias("t"))
    starts = F.filter(F.sequence(F.lit(0), F.size("t") - 1), lambda i: (i == 0) | (F.get("t", i) != F.get("t", i - 1)))
    t = t.withColumn("starts", starts)
    words = F.array_join(F.transform("starts", lambda s: F.get("t", s)), "\n")
    tfs = F.transform("starts", lambda s, k: F.coalesce(F.get("starts", k + 1), F.size("t")) - s)
    return t.select("tenant_id", "document_id", "chunk_id", F.size("t").cast("long").alias("length"), words.alias("words"), tfs.alias("tfs"))


def build(postings: DataFrame, range_docs: int = RANGE_DOCS, shard_docs: int = SHARD_DOCS) -> DataFrame:
    """Blocks (tenant_id, shard, term, range, chunks, n, most, postings array<struct<chunk_id, document_id, weight>>) of postings (tenant_id,
    chunk_id, document_id, term, tf) or postings by chunk, to be stored partitioned by tenant. A weight is the term's BM25 impact in the chunk
    without the term's rarity, which follows from `n` and the tenant's number of `chunks`.

    The rows of a range are a group in one task, so its blocks are made without shuffling, sorting or spilling their postings."""
    rows = by_chunk(postings)
    lengths = checkpointed(rows.groupBy("tenant_id", "document_id").agg(F.floor(4 * F.log2(F.min("length"))).alias("class"), F.count("*").alias("c"), F.sum("length").alias("l")))
    total = lengths.groupBy("tenant_id").agg(F.sum("c").alias("chunks"), (F.sum("l") / F.sum("c")).alias("mean"))
    earlier = Window.partitionBy("tenant_id").orderBy("class").rowsBetween(Window.unboundedPreceding, -1)  # a tenant has some ten classes
    sizes = lengths.groupBy("tenant_id", "class").agg(F.count("*").alias("docs")).withColumns({"ranges": F.ceil(F.col("docs") / range_docs), "before": F.coalesce(F.sum("docs").over(earlier), F.lit(0))})
    at = F.pmod(F.xxhash64("document_id"), F.col("ranges"))
    placed = lengths.join(F.broadcast(sizes.join(total, "tenant_id")), ["tenant_id", "class"])
    ranges = placed.select("tenant_id", "document_id", "chunks", "mean", (F.col("class") * (1 << 32) + at).alias("range"), F.floor((F.col("before") + at * range_docs) / shard_docs).alias("shard"))
    dealt = rows.join(ranges, ["tenant_id", "document_id"]).select("tenant_id", "shard", "range", "chunks", "mean", "length", "chunk_id", "document_id", "words", "tfs")
    schema = "tenant_id long, shard long, term string, range long, chunks long, n long, most double, postings array<struct<chunk_id: long, document_id: long, weight: double>>"
    return dealt.groupBy("tenant_id", "range").applyInArrow(lambda rows: blocks_of(rows), schema)


def blocks_of(rows: pa.Table) -> pa.Table:
    """The blocks of the chunks of one range, postings in order of chunks."""
    lists = pc.split_pattern(rows["words"].combine_chunks(), "\n")
    at = np.repeat(np.arange(rows.num_rows), np.diff(lists.offsets.to_numpy()))
    tf, length, mean = rows["tfs"].combine_chunks().flatten().to_numpy(), rows["length"].to_numpy()[at], rows["mean"].to_numpy()[at]
    weight = tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / mean))
    coded = lists.flatten().dictionary_encode()
    chunk, of = rows["chunk_id"].to_numpy()[at], coded.indices.to_numpy()
    order = np.lexsort((chunk, of))
    starts = np.searchsorted(of[order], np.arange(len(coded.dictionary) + 1))
    held = pa.StructArray.from_arrays([pa.array(x[order]) for x in (chunk, rows["document_id"].to_numpy()[at], weight)], ["chunk_id", "document_id", "weight"])
    one = lambda name: np.full(len(starts) - 1, rows[name][0].as_py())
    names = ["tenant_id", "shard", "term", "range", "chunks", "n", "most", "postings"]
    out = [one("tenant_id"), one("shard"), coded.dictionary, one("range"), one("chunks"), np.diff(starts), np.maximum.reduceat(weight[order], starts[:-1]), pa.ListArray.from_arrays(pa.array(starts, pa.int32()), held)]
    return pa.table(out, names=names)


def sets_of_terms(queries: DataFrame) -> DataFrame:
    """(query_id, tenant_id, asked, terms): queries with a term; `asked` numbers the distinct sets of terms of a tenant."""
    own = queries.select("query_id", "tenant_id", F.array_sort(F.array_distinct(terms(F.col("query_text")))).alias("terms")).filter(F.size("terms") > 0)
    return own.join(own.groupBy("tenant_id", "terms").agg(F.min("query_id").alias("asked")), ["tenant_id", "terms"])


def known_sets(blocks: DataFrame, sets: DataFrame) -> DataFrame:
    """(tenant_id, asked, wanted array<struct<term, idf>>): the sets whose terms all occur."""
    each = sets.select("tenant_id", "asked", "terms").distinct().select("tenant_id", "asked", F.size("terms").alias("k"), F.explode("terms").alias("term"))
    often = narrowed(blocks, each.select("tenant_id", "term").distinct(), ["tenant_id", "term"]).groupBy("tenant_id", "term").agg(F.sum("n").alias("df"), F.first("chunks").alias("chunks"))
    idf = F.log(1 + (F.col("chunks") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    per = each.join(often, ["tenant_id", "term"]).groupBy("tenant_id", "asked").agg(F.first("k").alias("k"), F.collect_list(F.struct("term", idf.alias("idf"))).alias("wanted"))
    return per.filter(F.size("wanted") == F.col("k")).drop("k")


class Shard:
    """Blocks of a shard in a task: for each term its ranges, in order, with their maxima; with postings, those in order of chunks too."""

    def __init__(self, blocks: pa.Table) -> None:
        coded = blocks["term"].combine_chunks().dictionary_encode()
        names, of = coded.dictionary.to_pylist(), coded.indices.to_numpy()
        order = np.lexsort((blocks["range"].to_numpy(), of))
        self.range, self.most = blocks["range"].to_numpy()[order], blocks["most"].to_numpy()[order]
        cuts = np.searchsorted(of[order], np.arange(len(names) + 1))
        self.at = {t: slice(a, b) for t, a, b in zip(names, cuts, cuts[1:], strict=False)}
        if "postings" in blocks.column_names:
            lists = blocks["postings"].combine_chunks()
            sizes, flat = np.diff(lists.offsets.to_numpy()), lists.flatten()
            chunk, term = flat.field("chunk_id").to_numpy(), np.repeat(of, sizes)
            order = np.lexsort((chunk, term))
            self.chunk, self.document, self.weight, self.within = chunk[order], flat.field("document_id").to_numpy()[order], flat.field("weight").to_numpy()[order], np.repeat(blocks["range"].to_numpy(), sizes)[order]
            cuts = np.searchsorted(term[order], np.arange(len(names) + 1))
            self.held = {t: slice(a, b) for t, a, b in zip(names, cuts, cuts[1:], strict=False)}

    def bounds(self, wanted: list[dict]) -> tuple[np.ndarray, np.ndarray]:
        """Ranges that have all terms, and the most that a chunk can score in each."""
        if any(w["term"] not in self.at for w in wanted):
            return np.empty(0, np.int64), np.empty(0)
        first, *others = [(self.at[w["term"]], w["idf"]) for w in wanted]
        ranges, bound = self.range[first[0]], self.most[first[0]] * first[1]
        for s, idf in others:
            ranges, i, j = np.intersect1d(ranges, self.range[s], assume_unique=True, return_indices=True)
            bound = bound[i] + self.most[s][j] * idf
        return ranges, bound

    def best(self, wanted: list[dict], ranges: np.ndarray, most: int, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(documents, scores, chunks) of the best documents in `ranges`, in order, of those that score `least`; each by its best chunk with all terms."""
        if not len(ranges):
            return np.empty(0, np.int64), np.empty(0), np.empty(0, np.int64)
        lists = sorted(((self.held[w["term"]], w["idf"]) for w in wanted), key=lambda x: x[0].stop - x[0].start)
        s, idf = lists[0]
        rows = np.flatnonzero(np.isin(self.within[s], ranges)) + s.start
        score = self.weight[rows] * idf
        for s, idf in lists[1:]:
            at = np.minimum(np.searchsorted(self.chunk[s], self.chunk[rows]), s.stop - s.start - 1) + s.start
            met = self.chunk[at] == self.chunk[rows]
            rows, score = rows[met], score[met] + self.weight[at[met]] * idf
        score = np.round(score, 9)
        rows, score = rows[score >= least], score[score >= least]
        order = np.lexsort((self.chunk[rows], -score, self.document[rows]))
        document = self.document[rows[order]]
        order = order[np.flatnonzero(np.r_[True, document[1:] != document[:-1]])] if len(order) else order
        order = order[np.lexsort((self.document[rows[order]], -score[order]))[:most]]
        return self.document[rows[order]], score[order], self.chunk[rows[order]]


def met(blocks: DataFrame, asked: DataFrame, columns: list[str], work, schema: str) -> DataFrame:
    """What work(shard, row) yields, a tuple of columns for each shard and row of `asked` (tenant_id, shard, asked, wanted, ...), with tenant_id,
    shard and asked before it. Only the blocks of terms that their shard is asked for are dealt (with over TERM_ROWS of these, that their tenant is),
    and only their `columns`."""
    asked = asked.toDF(*asked.columns)  # columns of its own: shards come from the blocks too
    each = asked.select("tenant_id", "shard", F.explode("wanted.term").alias("term")).distinct()
    keys = ["tenant_id", "shard", "term"] if each.limit(TERM_ROWS + 1).count() <= TERM_ROWS else ["tenant_id", "term"]
    held = narrowed(blocks, each.select(*keys).distinct(), keys).select("tenant_id", "shard", "term", "range", *columns)

    def run(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        shape = [pa.int64()] * 3 + [{"long": pa.int64(), "double": pa.float64()}[x.split()[1]] for x in schema.split(", ")]
        names = ["tenant_id", "shard", "asked", *[x.split()[0] for x in schema.split(", ")]]
        parts: list[list[np.ndarray]] = [[] for _ in names]
        if left.num_rows and right.num_rows:
            shard = Shard(left)
            for row in right.to_pylist():
                out = work(shard, row)
                for p, x in zip(parts, [np.full(len(out[0]), k.as_py()) for k in key] + [np.full(len(out[0]), row["asked"]), *out], strict=True):
                    p.append(x)
        return pa.table([pa.array(np.concatenate(p) if p else [], k) for p, k in zip(parts, shape, strict=True)], names=names)

    return held.groupBy("tenant_id", "shard").cogroup(asked.groupBy("tenant_id", "shard")).applyInArrow(run, f"tenant_id long, shard long, asked long, {schema}")


def first_ranges(blocks: DataFrame, known: DataFrame, first: int) -> tuple[DataFrame, DataFrame]:
    """(tenant_id, shard, asked, wanted): sets of terms with the shards that they go to; and (tenant_id, shard, asked, range, bound, place): the
    `first` ranges of each set, by their bounds, of those that have every term."""
    shards = blocks.select("tenant_id", "shard").distinct()
    dealt = known.join(F.broadcast(shards), "tenant_id")

    def work(shard, row):
        ranges, bound = shard.bounds(row["wanted"])
        order = np.lexsort((ranges, -bound))[:first]
        return ranges[order], bound[order]

    heads = met(blocks, dealt, ["most"], work, "range long, bound double")
    return dealt, checkpointed(ranked(heads, ["tenant_id", "asked"], F.desc("bound"), F.asc("range"), most=first, name="place"))


def top(blocks: DataFrame, queries: DataFrame, most: int = 60, first: int = 2) -> DataFrame:
    """(query_id, document_id, score, chunk_id, rank): the `most` best documents of each query (query_id, tenant_id, query_text), by their best
    chunk that holds every term, ties by id; exact. The shards of the `first` ranges with the highest bounds are scored, then of the others the
    ranges whose bound isn't below what the last of the best documents has by then. Queries with the same terms are answered once."""
    sets = sets_of_terms(queries)
    known = checkpointed(known_sets(blocks, sets))
    dealt, heads = first_ranges(blocks, known, first)
    keys, shape = ["tenant_id", "asked"], "document_id long, score double, chunk_id long"

    def work(shard, row):
        ranges, bound = shard.bounds(row["wanted"])
        bar = row.get("bar")
        return shard.best(row["wanted"], ranges if bar is None else ranges[bound >= bar - 1e-8], most, -np.inf if bar is None else bar)

    best = lambda df: ranked(df, keys, F.desc("score"), F.asc("document_id"), most=most)
    leading = heads.select(*keys, "shard").distinct()
    early = checkpointed(best(met(blocks, dealt.join(leading, [*keys, "shard"], "left_semi"), ["most", "postings"], work, shape)))
    bar = early.filter(F.col("rank") == most).select(*keys, F.col("score").alias("bar"))
    rest = dealt.join(leading, [*keys, "shard"], "left_anti").join(bar, keys, "left")
    late = met(blocks, rest, ["most", "postings"], work, shape)
    found = best(early.drop("rank").unionByName(late))
    return sets.select("query_id", *keys).join(found, keys).select("query_id", "document_id", "score", "chunk_id", "rank")


def skipped(blocks: DataFrame, queries: DataFrame, most: int = 60, first: int = 2) -> DataFrame:
    """(query_id, ranges, read): how many ranges have all terms of a query, and how many are read if its `first` ranges alone give the bar."""
    sets = sets_of_terms(queries)
    known = checkpointed(known_sets(blocks, sets))
    dealt, heads = first_ranges(blocks, known, first)
    keys = ["tenant_id", "asked"]
    chosen = heads.groupBy(*keys).agg(F.collect_list("range").alias("only"))
    here = dealt.join(heads.select(*keys, "shard").distinct(), [*keys, "shard"], "left_semi").join(chosen, keys)
    early = met(blocks, here, ["most", "postings"], lambda shard, row: shard.best(row["wanted"], np.array(row["only"]), most, -np.inf), "document_id long, score double, chunk_id long")
    bar = ranked(early, keys, F.desc("score"), F.asc("document_id"), most=most).filter(F.col("rank") == most).select(*keys, F.col("score").alias("bar"))

    def work(shard, row):
        ranges, bound = shard.bounds(row["wanted"])
        read = len(ranges) if row["bar"] is None else int(((bound >= row["bar"] - 1e-8) | np.isin(ranges, row["only"])).sum())
        return np.array([len(ranges)]), np.array([read])

    counts = met(blocks, dealt.join(chosen, keys).join(bar, keys, "left"), ["most"], work, "ranges long, read long").groupBy(*keys).agg(F.sum("ranges").alias("ranges"), F.sum("read").alias("read"))
    return sets.select("query_id", *keys).join(counts, keys).select("query_id", "ranges", "read")
