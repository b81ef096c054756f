"""Benchmark decontamination: phrases of test items are sought in an FM-index of each shard of the training texts.

A shard is a slice of a partition, some megabytes of whole documents. Its index has the words of the tests; every other word ends a run, since
no phrase holds it. Phrases are searched backwards through the ranks of a wavelet matrix, all at once; rows of the intervals that remain walk
back to sampled suffixes, and the places so found are merged to spans of each document. Nothing is shuffled but the results of several blocks
of test phrases, which come in blocks so that none that is sent to the tasks passes BLOCK_WORDS.

Words are runs of letters and digits of any script after A-Z is lower-cased. A null text has no words, and so has a blank one: such documents
come back with zeros, such items have no window. Repeated rows are judged alike and come back as often; documents may be of any length.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, slices
from .fm_index import Index, expand

WINDOW = 10
#: Characters of text of a shard, unless one document has more.
SHARD_CHARS = 4_000_000
#: Words of test items in a block, unless one item has more.
BLOCK_WORDS = 1_000_000
#: Of so many suffixes one has its place kept.
SAMPLED = 16
#: Ends a document; UTF-8 has no such byte.
END = b"\xff"
SPANS = "array<struct<first:int,past:int>>"
ARROW = pa.struct([("first", pa.int32()), ("past", pa.int32())])


def plain_table() -> bytes:
    """For bytes.translate(): A-Z become a-z, other ASCII characters but digits and letters become spaces."""
    table = bytearray(range(256))
    for c in range(128):
        table[c] = ord(chr(c).lower()) if chr(c).isalnum() else 32
    return bytes(table)


PLAIN = plain_table()


def plain_words(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(PLAIN).split()


def plain(text: Column) -> Column:
    """The words of plain_words() as a Column: an array, empty for null."""
    lowered = F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.filter(F.split(lowered, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), lambda w: w != "")


@dataclass
class Tests:
    """Windows of test items: rows of word numbers that end at the right; items[of[k] : of[k + 1]] have window k."""

    numbers: dict[bytes, int]
    windows: np.ndarray
    lengths: np.ndarray
    of: np.ndarray
    items: np.ndarray
    names: list[str | None]


def windows_of(items: list[tuple[str | None, list[bytes]]], window: int = WINDOW) -> Tests:
    """Distinct windows of items (name, words): runs of `window` words, or all of an item that has fewer."""
    numbers: dict[bytes, int] = {}
    rows, owners = [], []
    for k, (_, words) in enumerate(items):
        x = np.array([numbers.setdefault(w, len(numbers) + 1) for w in words], np.int64)
        if not len(x):
            continue
        x = x if len(x) >= window else np.concatenate([np.zeros(window - len(x), np.int64), x])
        own = np.unique(np.lib.stride_tricks.sliding_window_view(x, window), axis=0)
        rows.append(own)
        owners.append(np.full(len(own), k))
    if not rows:
        return Tests(numbers, np.empty((0, window), np.int64), np.empty(0, np.int64), np.zeros(1, np.int64), np.empty(0, np.int64), [n for n, _ in items])
    distinct, of_row = np.unique(np.concatenate(rows), axis=0, return_inverse=True)
    owner = np.concatenate(owners)[np.argsort(of_row.ravel(), kind="stable")]
    of = np.r_[0, np.cumsum(np.bincount(of_row.ravel(), minlength=len(distinct)))]
    return Tests(numbers, distinct, np.count_nonzero(distinct, axis=1), of, owner, [n for n, _ in items])


def test_blocks(benchmark: DataFrame, window: int = WINDOW, most: int = BLOCK_WORDS) -> Iterator[Tests]:
    """The items (item_id, text), dealt to blocks of about half of `most` words; each block is read when it is asked for."""
    items = benchmark.select(F.col("item_id").cast("string").alias("name"), "text").filter("text IS NOT NULL")
    total = items.agg(F.sum(F.size(plain(F.col("text"))))).first()[0] or 0
    blocks = 1 if total <= most else -(-2 * total // most)
    for block in range(blocks):
        mine = items if blocks == 1 else items.filter(F.pmod(F.xxhash64("name", "text"), F.lit(blocks)) == block)
        yield windows_of([(r["name"], plain_words(r["text"])) for r in mine.collect()], window)


def shard_index(texts: list[str | None], tests: Tests) -> tuple[Index, np.ndarray, np.ndarray]:
    """(index, token of each of its places, ends): the runs of test words that a window fits in; ends are the tokens behind each document."""
    data = (b" " + END + b" ").join(x.encode().translate(PLAIN) if x else b"" for x in texts)
    tokens = data.split()
    tokens.append(END)
    x = np.fromiter(map((tests.numbers | {END: -1}).get, tokens, repeat(0)), np.int64, len(tokens))
    ends = np.flatnonzero(x < 0)
    known = x > 0
    edge = np.flatnonzero(np.diff(known.astype(np.int8), prepend=0, append=0))
    first, past = edge[::2], edge[1::2]
    fits = past - first >= (tests.lengths.min() if len(tests.lengths) else len(x))
    _, at = expand(first[fits], past[fits] + 1)  # a run and what ends it
    kept = np.r_[np.maximum(x[at], 0), 0]
    return Index(kept, len(tests.numbers) + 1, None, SAMPLED), at, ends


def spans(texts: list[str | None], tests: Tests) -> list[tuple[int, list, list]]:
    """(words, merged spans of words that a window covers, indices of the items with windows there) of each document of a shard."""
    index, token, ends = shard_index(texts, tests)
    starts = np.r_[0, ends[:-1] + 1]
    window, row = expand(*index.search(tests.windows, tests.lengths))
    first = token[index.locate(row)]
    cover = np.cumsum(np.bincount(first, minlength=ends[-1] + 1) - np.bincount(first + tests.lengths[window], minlength=ends[-1] + 1)) > 0
    edge = np.flatnonzero(np.diff(cover.astype(np.int8), prepend=0, append=0))
    out = [(int(b - a), [], []) for a, b in zip(starts, ends, strict=True)]
    for a, b in zip(edge[::2], edge[1::2], strict=True):
        doc = np.searchsorted(ends, a)
        out[doc][1].append((int(a - starts[doc]), int(b - starts[doc])))
    # a document has each of its windows once, then each item of theirs once
    seen = np.unique(np.searchsorted(ends, first) * max(1, len(tests.windows)) + window)
    doc, window = seen // max(1, len(tests.windows)), seen % max(1, len(tests.windows))
    owner, at = expand(tests.of[window], tests.of[window + 1])
    seen = np.unique(doc[owner] * max(1, len(tests.names)) + tests.items[at])
    for d, item in zip(seen // max(1, len(tests.names)), seen % max(1, len(tests.names)), strict=True):
        out[d][2].append(int(item))
    return out


SCHEMA = f"row long, doc_id long, n_words long, spans {SPANS}, items array<string>"
ARROW_SCHEMA = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("n_words", pa.int64()), ("spans", pa.list_(ARROW)), ("items", pa.list_(pa.string()))])


def search(docs: DataFrame, tests: Tests) -> DataFrame:
    """SCHEMA for docs (row, doc_id, text): what one block of tests finds in each; items are their names, in order of strings."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, "text", SHARD_CHARS):
                row, doc_id, text = (piece.column(k) for k in range(3))
                found = spans(text.to_pylist(), tests)
                n, s, items = zip(*found, strict=True)
                names = [sorted({tests.names[i] for i in own} - {None}) for own in items]
                made = [pa.array(n, pa.int64()), pa.array([[{"first": a, "past": b} for a, b in own] for own in s], ARROW_SCHEMA.field("spans").type), pa.array(names, pa.list_(pa.string()))]
                yield pa.RecordBatch.from_arrays([row, doc_id, *made], schema=ARROW_SCHEMA)

    return docs.select("row", F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, SCHEMA)


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """(doc_id, n_words, spans, items) of docs (doc_id, text): the merged spans of words that windows of test items cover, counted from 0, the
    end behind the last word, and the items with such windows, as strings in order. An item without an id has spans but no name."""
    blocks = test_blocks(benchmark, window, block_words)
    tests = next(blocks)
    more = next(blocks, None)
    rows = docs.select(F.lit(0).cast("long").alias("row"), "doc_id", "text")
    if more is None:
        return search(rows, tests).drop("row")
    rows = cut(docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text"), "numbered")  # the same numbers for each block
    out = cut(search(rows, tests), "found")
    while more is not None:
        out = out.unionByName(cut(search(rows, more), "found"))
        more = next(blocks, None)
    per = out.groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"), F.array_sort(F.flatten(F.collect_list("spans"))).alias("s"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    return per.select("doc_id", "n_words", F.expr(f"""aggregate(s, CAST(array() AS {SPANS}), (done, x) -> CASE WHEN size(done) = 0 OR element_at(done, -1).past < x.first THEN array_append(done, x)
        ELSE array_append(slice(done, 1, size(done) - 1), named_struct('first', element_at(done, -1).first, 'past', greatest(element_at(done, -1).past, x.past))) END)""").alias("spans"), "items")


def removed(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, text, n_hit): what is left of each text when the words of its spans go: other words as they are looked at, joined by spaces; a text
    without a span stays as it is, a null one null."""
    numbered = cut(docs.select(F.monotonically_increasing_id().alias("doc_id"), F.col("doc_id").alias("__id"), "text"), "numbered")
    found = contamination(numbered, benchmark, window).select(F.col("doc_id").alias("__row"), "spans")
    joined = numbered.join(found, F.col("doc_id") == F.col("__row"))
    kept = F.expr("filter(w, (x, i) -> NOT exists(spans, s -> s.first <= i AND i < s.past))")
    text = F.when(F.size("spans") > 0, F.array_join(kept, " ")).otherwise(F.col("text"))
    return joined.withColumn("w", plain(F.col("text"))).select(F.col("__id").alias("doc_id"), text.alias("text"), hits().alias("n_hit"))


def hits() -> Column:
    return F.expr("aggregate(spans, 0L, (n, s) -> n + s.past - s.first)")


def op13_decontamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256 and contaminated of every row of docs; see the module for nulls, ties and repeated rows."""
    items = F.sha2(F.array_join("items", ","), 256)
    return contamination(docs, benchmark).select("doc_id", "n_words", hits().alias("n_hit"), F.size("items").cast("long").alias("n_items"), items.alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"))


_WORDS = "list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '')"
ORACLE = f"""WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents), b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
g AS (SELECT item_id, least(len(w), {WINDOW}) AS n, unnest(list_transform(range(1, len(w) - least(len(w), {WINDOW}) + 2), lambda i: array_to_string(w[i : i + least(len(w), {WINDOW}) - 1], ' '))) AS g FROM b WHERE len(w) > 0),
s AS (SELECT DISTINCT n FROM g), p AS (SELECT doc_id, n, unnest(range(1, len(w) - n + 2)) AS i, unnest(list_transform(range(1, len(w) - n + 2), lambda i: array_to_string(w[i : i + n - 1], ' '))) AS g FROM d, s WHERE len(w) >= n),
m AS (SELECT doc_id, p.n, i, item_id FROM p JOIN g ON p.g = g.g AND p.n = g.n),
h AS (SELECT doc_id, count(DISTINCT x) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(i, i + n)) AS x FROM (SELECT DISTINCT doc_id, i, n FROM m)) GROUP BY 1),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item_id FROM m) GROUP BY 1)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h ON d.doc_id = h.doc_id LEFT JOIN t ON d.doc_id = t.doc_id"""
