"""Recursive chunking: separators from paragraphs to words, greedy packing with overlap. Texts stay in Spark; counts are packed by numpy."""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import token_count

SEPARATORS = ("\n\n", "\n", ". ", " ")
SIZE, OVERLAP = 512, 80


def pieces(text: Column, size: int) -> Column:
    """Parts of a text, each of at most `size` tokens where separators allow: what is too large is cut by the next separator.

    A separator stays with the part before it, so that the parts joined are the text.
    """
    out = F.array(text)
    for sep in SEPARATORS:
        pattern = "(?<=" + sep.replace(".", "\\.") + ")"
        out = F.flatten(F.transform(out, split_large(pattern, size)))
    return F.filter(out, lambda x: F.length(x) > 0)


def split_large(pattern: str, size: int) -> Callable[[Column], Column]:
    return lambda x: F.when(token_count(x) > size, F.split(x, pattern)).otherwise(F.array(x))


def counted(parts: Column) -> Column:
    """Texts as structs of t, the text, and n, its tokens."""
    return F.transform(parts, lambda x: F.struct(x.alias("t"), token_count(x).cast("int").alias("n")))


def flat_runs(counts: np.ndarray, size: int, overlap: int) -> list[list[int]]:
    """[begin, end, 0] of the chunks of parts with these token counts, each end found by bisection of the running total."""
    total = np.r_[0, np.cumsum(counts, dtype=np.int64)]
    out, begin, fresh = [], 0, 0
    while fresh < len(counts):
        end = max(int(np.searchsorted(total, total[begin] + size, "right")) - 1, fresh + 1)
        out.append([begin, end, 0])
        tail = max(int(np.searchsorted(total, total[end] - overlap)), begin)
        # an overlap that leaves no room for the next part is left out, so that no chunk is only overlap
        begin, fresh = (tail if end < len(counts) and total[end + 1] - total[tail] <= size else end), end
    return out


def nested_runs(counts: np.ndarray, size: int, overlap: int) -> list[list[int]]:
    """As flat_runs(), with 1 for a part above `size`, which is a run of its own for the next separator. The overlap always opens the next
    chunk, so that one may pass `size` by it, and before a part above `size` it is a chunk itself."""
    total = np.r_[0, np.cumsum(counts, dtype=np.int64)]
    out, begin, fresh = [], 0, 0
    while fresh < len(counts):
        if counts[fresh] > size:
            out += [[begin, fresh, 0]] * (begin < fresh) + [[fresh, fresh + 1, 1]]
            begin = fresh = fresh + 1
            continue
        fresh = max(int(np.searchsorted(total, total[begin] + size, "right")) - 1, fresh + 1)
        out.append([begin, fresh, 0])
        begin = max(int(np.searchsorted(total, total[fresh] - overlap)), begin)
    return out


def packer(runs: Callable, size: int, overlap: int) -> Callable[[Column], Column]:
    """Runs of each array of token counts in an array of such; only the counts go to Python.

    Called nondeterministic, though it isn't, so that Spark evaluates it once, where it is written, and doesn't copy it into filters.
    """

    @F.pandas_udf("array<array<array<int>>>")
    def pack(counts: pd.Series) -> pd.Series:
        return counts.map(lambda rows: [runs(np.asarray(r, np.int64), size, overlap) for r in rows])

    return pack.asNondeterministic()


def split_deep(sep: str) -> Callable[[Column], Column]:
    """Parts of a deep text that have tokens; any other text is one part."""
    whole = lambda x: F.array(F.struct(x["t"].alias("t"), F.lit(0).alias("n")))
    return lambda x: F.when(x["deep"], F.filter(counted(F.split(x["t"], re.escape(sep))), lambda p: p["n"] > 0)).otherwise(whole(x))


def joined(parts: Column, runs: Column, sep: str) -> Column:
    """Structs of t, a run's parts joined by `sep`, and deep, whether it is to be split further. Parts are taken one by one, since a slice
    would copy the whole array for each run."""
    text = lambda r: F.array_join(F.transform(F.sequence(r[0], r[1] - 1), lambda i: parts[i]["t"]), sep)
    return F.transform(runs, lambda r: F.struct(text(r).alias("t"), (r[2] == 1).alias("deep")))


def chunk_rows(chunks: DataFrame) -> DataFrame:
    """(document_id, chunk_index, chunk_text, tokens) of (document_id, chunks); blank chunks are dropped, their numbers stay unused."""
    rows = chunks.select("document_id", F.posexplode("chunks").alias("chunk_index", "chunk"))
    rows = rows.select("document_id", F.col("chunk_index").cast("long").alias("chunk_index"), F.regexp_replace("chunk.t", r"^\s+|\s+$", "").alias("chunk_text"))
    return rows.filter("chunk_text <> ''").withColumn("tokens", token_count(F.col("chunk_text")))


def chunk_documents(docs: DataFrame, size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    """(document_id, chunk_index, chunk_text, tokens): parts packed greedily up to `size` tokens; a new chunk begins with the last parts of
    the one before that fit into `overlap`. Blank chunks are dropped, their numbers stay unused.

    Parts keep their separators, so chunks together are the whole text. Null and empty texts give no chunk. Linear in the text.
    """
    parts = docs.select("document_id", counted(pieces(F.coalesce("text", F.lit("")), size)).alias("parts"))
    packed = parts.withColumn("runs", packer(flat_runs, size, overlap)(F.array(F.transform("parts", lambda x: x["n"])))[0])
    return chunk_rows(packed.select("document_id", joined(F.col("parts"), F.col("runs"), "").alias("chunks")))


def split_documents(docs: DataFrame, size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    """(document_id, chunk_index, chunk_text, tokens) by recursion: a text above `size` tokens is split at its first separator that it holds,
    and its parts are packed, joined by it, up to `size`; each new chunk begins with the last parts that fit into `overlap`. A part above `size`
    is split by the separators that follow, on its own; what holds none is cut every `size` tokens.

    Separators at the ends of chunks are lost and aren't counted; parts without a token are left out. Null and blank texts give no chunk.
    All texts go through one level after the other, in arrays of their rows; linear in the text at each level.
    """
    text = F.coalesce("text", F.lit(""))
    out = docs.select("document_id", F.array(F.struct(text.alias("t"), (token_count(text) > size).alias("deep"))).alias("chunks"))
    pack = packer(nested_runs, size, overlap)
    for sep in SEPARATORS:
        out = out.withColumn("parts", F.transform("chunks", split_deep(sep))).withColumn("runs", pack(F.transform("parts", lambda p: F.transform(p, lambda x: x["n"]))))
        out = out.select("document_id", F.flatten(F.zip_with("parts", "runs", lambda p, r: joined(p, r, sep))).alias("chunks"))
    cut = lambda x: F.transform(F.regexp_extract_all(x["t"], F.lit(rf"(?:\s*+(?:[\p{{L}}\p{{N}}_]++|[^\p{{L}}\p{{N}}_\s])){{1,{size}}}+"), F.lit(0)), lambda t: F.struct(t.alias("t"), F.lit(False).alias("deep")))
    return chunk_rows(out.select("document_id", F.flatten(F.transform("chunks", lambda x: F.when(x["deep"], cut(x)).otherwise(F.array(x)))).alias("chunks")))


def locate_chunks(docs: DataFrame, chunks: DataFrame) -> DataFrame:
    """chunks with start: the chunk's place in its document's text, from 0; -1 if it isn't found."""
    return chunks.join(docs.select("document_id", "text"), "document_id").withColumn("start", (F.expr("locate(chunk_text, text)") - 1).cast("long")).drop("text")


def section_of(chunks: DataFrame, sections: DataFrame) -> DataFrame:
    """chunks (document_id, start) with the section (document_id, begin, end, section_title) that their start is in: a range join inside a document."""
    s = sections.select(F.col("document_id").alias("__d"), "begin", "end", "section_title")
    return chunks.join(s, (F.col("document_id") == F.col("__d")) & (F.col("start") >= F.col("begin")) & (F.col("start") < F.col("end")), "left").drop("__d", "begin", "end")


def hash_chunks(chunks: DataFrame) -> DataFrame:
    return chunks.withColumn("chunk_hash", F.sha2("chunk_text", 256))
