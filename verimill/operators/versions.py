"""Versions: upsert, version log, ordered line diffs, claim changes, re-embedding plan."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.linediff import hunks
from .conflicts import checkpointed

KEY = ["tenant_id", "source_id", "source_object_id"]


def upsert_documents(current: DataFrame, incoming: DataFrame) -> DataFrame:
    """Next documents by key: (KEY, content_hash, content, version, change). Equal hash: unchanged; other hash: version + 1; new: version 1."""
    a = current.select(*KEY, F.col("content_hash").alias("h0"), F.col("content").alias("c0"), F.col("version").alias("v0"))
    b = incoming.select(*KEY, F.col("content_hash").alias("h1"), F.col("content").alias("c1"))
    both = a.join(b, KEY, "full_outer")
    changed = F.col("h1").isNotNull() & (F.coalesce("h0", F.lit("")) != F.col("h1"))
    change = F.when(F.col("h1").isNull(), "untouched").when(F.col("v0").isNull(), "created").when(changed, "updated").otherwise("unchanged")
    return both.select(*KEY, F.when(changed, F.col("h1")).otherwise(F.col("h0")).alias("content_hash"), F.when(changed, F.col("c1")).otherwise(F.col("c0")).alias("content"), (F.coalesce("v0", F.lit(0)) + changed.cast("int")).cast("long").alias("version"), change.alias("change"))


def append_versions(versions: DataFrame, upserted: DataFrame) -> DataFrame:
    """The version log with a snapshot of each created or updated document."""
    fresh = upserted.filter(F.col("change").isin("created", "updated")).select(*KEY, "version", "content_hash", F.col("content").alias("content_snapshot"))
    return versions.select(*KEY, "version", "content_hash", "content_snapshot").unionByName(fresh)


def history(versions: DataFrame) -> DataFrame:
    """(document_id, versions, contents, latest): how many versions a document has, how many of them differ, and the latest."""
    return versions.groupBy("document_id").agg(F.count("*").alias("versions"), F.countDistinct(F.sha2("content_snapshot", 256)).alias("contents"), F.max("version").alias("latest"))


def version_pairs(versions: DataFrame) -> DataFrame:
    """(document_id, version, content_snapshot, previous): each version with the one before it."""
    w = Window.partitionBy("document_id").orderBy("version")
    return versions.withColumn("previous", F.lag("content_snapshot").over(w)).filter("previous IS NOT NULL")


HUNKS = "array<struct<old_first:int,old_lines:int,new_first:int,new_lines:int,lines:array<string>>>"


def line_diffs(pairs: DataFrame, context: int = 3) -> DataFrame:
    """(document_id, version, added, removed, hunks) of pairs (document_id, version, previous, content_snapshot): the ordered line diff of each
    pair, with the hunks of a unified diff. A line that moved is removed and added. Null texts are empty."""
    kinds = pa.schema([("added", pa.int64()), ("removed", pa.int64()), ("hunks", pa.list_(pa.struct([*[(c, pa.int32()) for c in ("old_first", "old_lines", "new_first", "new_lines")], ("lines", pa.list_(pa.string()))])))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):  # a row has two whole texts
                rows = batch.slice(at, 64)
                found = [hunks(a or "", b or "", context) for a, b in zip(rows.column(2).to_pylist(), rows.column(3).to_pylist(), strict=True)]
                made = [pa.array([f[k] for f in found], field.type) for k, field in enumerate(kinds)]
                yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), *made], ["document_id", "version", *kinds.names])

    return pairs.select(F.col("document_id").cast("long").alias("document_id"), F.col("version").cast("long").alias("version"), "previous", "content_snapshot").mapInArrow(run, f"document_id long, version long, added long, removed long, hunks {HUNKS}")


def unified(old: Column, new: Column) -> Column:
    """The text of a unified diff of the column `hunks`, between versions named `old` and `new`; empty without a change."""
    span = lambda h, s: F.concat(h[f"{s}_first"].cast("string"), F.when(h[f"{s}_lines"] != 1, F.concat(F.lit(","), h[f"{s}_lines"])).otherwise(""))
    line = lambda x: F.when(F.endswith(x, F.lit("\n")), x).otherwise(F.concat(x, F.lit("\n")))
    part = lambda h: F.concat(F.lit("@@ -"), span(h, "old"), F.lit(" +"), span(h, "new"), F.lit(" @@\n"), F.array_join(F.transform(h["lines"], line), ""))
    return F.when(F.size("hunks") == 0, "").otherwise(F.concat(F.lit("--- "), old, F.lit("\n+++ "), new, F.lit("\n"), F.array_join(F.transform("hunks", part), "")))


def line_changes(pairs: DataFrame) -> DataFrame:
    """(document_id, version, added, removed): lines of the ordered diff of each pair."""
    return line_diffs(pairs).drop("hunks")


def version_diffs(versions: DataFrame, claims: DataFrame) -> DataFrame:
    """(document_id, version, added, removed, claims_changed): lines that each version changed; the newest also has the number of claims whose
    value an active claim replaces, older ones 0."""
    lines = line_changes(version_pairs(versions))
    newest = versions.groupBy("document_id").agg(F.max("version").alias("version"))
    changed = claim_changes(claims).groupBy("document_id").agg(F.count("*").alias("claims_changed")).join(newest, "document_id")
    return lines.join(changed, ["document_id", "version"], "left").fillna(0, ["claims_changed"])


def replaced_claims(claims: DataFrame) -> DataFrame:
    """Superseded claims whose predicate is active in the same document."""
    active = claims.filter("status = 'active'").select("document_id", F.lower("predicate").alias("__p"))
    old = claims.filter("status = 'superseded'").withColumn("__p", F.lower("predicate"))
    return old.join(active, ["document_id", "__p"], "left_semi").drop("__p")


def claim_changes(claims: DataFrame) -> DataFrame:
    """(document_id, predicate, old_value, new_value): for each superseded claim the surest active one of its document and predicate, where values differ."""
    w = Window.partitionBy("document_id", "predicate").orderBy(F.desc("confidence"), "claim_id")
    now = claims.filter("status = 'active'").withColumn("r", F.row_number().over(w)).filter("r = 1").select("document_id", "predicate", F.col("object_value").alias("new_value"))
    return claims.filter("status = 'superseded'").select("document_id", "predicate", F.col("object_value").alias("old_value")).join(now, ["document_id", "predicate"]).filter("old_value <> new_value").distinct()


def reembedding_plan(before: DataFrame, after: DataFrame) -> DataFrame:
    """(document_id, chunk_index, action) for chunk tables (document_id, chunk_index, chunk_hash): unchanged, changed, new or removed."""
    a = before.select("document_id", "chunk_index", F.col("chunk_hash").alias("h0"))
    b = after.select("document_id", "chunk_index", F.col("chunk_hash").alias("h1"))
    action = F.when(F.col("h0").isNull(), "new").when(F.col("h1").isNull(), "removed").when(F.col("h0") == F.col("h1"), "unchanged").otherwise("changed")
    return a.join(b, ["document_id", "chunk_index"], "full_outer").select("document_id", "chunk_index", action.alias("action"))


def longest_rising(runs: list[tuple[int, int, int]]) -> list[int]:
    """Places of runs (start before, start after, chunks), by rising start after, whose starts before rise and that have the most chunks together.

    Of equally good choices, that whose last run starts earlier before, and so on back. O(n log n) in the number of runs.
    """
    place = {s: k + 1 for k, s in enumerate(sorted(r[0] for r in runs))}
    tree: list[tuple[int, int]] = [(0, -1)] * (len(runs) + 1)
    back = []
    for k, (start, _, n) in enumerate(runs):
        i, best = place[start] - 1, (0, -1)
        while i:
            best, i = max(best, tree[i], key=lambda x: x[0]), i & (i - 1)
        back.append(best[1])
        i, mine = place[start], (best[0] + n, k)
        while i < len(tree):
            if mine[0] > tree[i][0]:
                tree[i] = mine
            i += i & -i
    i, best = len(runs), (0, -1)
    while i:
        best, i = max(best, tree[i], key=lambda x: x[0]), i & (i - 1)
    out, k = [], best[1]
    while k >= 0:
        out.append(k)
        k = back[k]
    return out[::-1]


def aligned_plan(before: DataFrame, after: DataFrame) -> DataFrame:
    """(document_id, chunk_index, old_index, action, embed) for chunk tables (document_id, chunk_index, chunk_hash): one row for each chunk of the
    later version, and one with a null chunk_index for each removed chunk.

    The k-th chunk with a hash is met with the k-th of the version before; those that keep their order, the longest such sequence, are unchanged,
    the others moved. Between two unchanged chunks the k-th of the rest is the k-th rest of before, changed; what is over is new or removed.
    embed says that no vector of the document's version before has this hash. Chunks in a row are one run, so Python sees a document's runs,
    which follow its edits, not its chunks. Null hashes are never met. Hashes are compared by their MD5, 16 bytes, and windows by
    document take the place of joins of the two versions; only the chosen runs are joined.
    """
    own = lambda *c: Window.partitionBy("document_id", *c)
    side = lambda d, k: d.select("document_id", F.lit(k).alias("side"), F.col("chunk_index").alias("at"), F.unhex(F.md5("chunk_hash")).alias("h"))
    old, new = F.col("side") == 0, F.col("side") == 1
    rows = side(before, 0).unionByName(side(after, 1)).withColumn("pos", F.row_number().over(own("side").orderBy("at")))
    rows = rows.withColumn("k", F.row_number().over(own("side", "h").orderBy("pos")))
    other = lambda c: F.when(F.col("h").isNotNull(), F.when(new, F.max(F.when(old, F.col(c))).over(own("h", "k"))).otherwise(F.max(F.when(new, F.col(c))).over(own("h", "k"))))
    rows = rows.withColumns({"mate": other("pos"), "mate_at": other("at"), "known": F.max(old & F.col("h").isNotNull()).over(own("h"))}).drop("h", "k")
    p0, p1 = F.when(old, F.col("pos")).otherwise(F.col("mate")), F.when(new, F.col("pos")).otherwise(F.col("mate"))
    rows = rows.withColumns({"p0": p0, "p1": p1, "met": F.col("mate").isNotNull()}).drop("mate")
    order = own("side", "met").orderBy("pos")
    goes_on = F.coalesce((F.lag("p0").over(order) + 1 == F.col("p0")) & (F.lag("p1").over(order) + 1 == F.col("p1")), F.lit(False))
    rows = rows.withColumn("run", F.last(F.when(F.col("met") & ~goes_on, F.col("p1")), ignorenulls=True).over(order))
    rows = checkpointed(rows)
    runs = rows.filter(new & F.col("met")).groupBy("document_id", "run").agg(F.min("p0").alias("start0"), F.min("p1").alias("start1"), F.count("*").alias("n"))

    def pick(table: pa.Table) -> pa.Table:
        found = table.sort_by("start1")
        kept = longest_rising(list(zip(*(found.column(c).to_pylist() for c in ("start0", "start1", "n")), strict=True)))
        return found.take(pa.array(kept, pa.int64())).select(["document_id", "run"])

    runs = runs.withColumn("of", F.count("*").over(own()))
    kinds = "document_id long, run long"
    several = runs.filter("of > 1").select(F.col("document_id").cast("long").alias("document_id"), F.col("run").cast("long").alias("run"), "start0", "start1", "n")
    chosen = several.groupBy("document_id").applyInArrow(pick, kinds).unionByName(runs.filter("of = 1").select("document_id", F.col("run").cast("long").alias("run")))
    rows = rows.join(chosen.withColumn("stays", F.lit(True)), ["document_id", "run"], "left")

    rows = rows.withColumn("gap", F.count("stays").over(own("side").orderBy("pos")))
    rows = rows.withColumn("g", F.row_number().over(own("side", "met", "gap").orderBy("pos")))
    rows = rows.withColumns({"was": F.max(F.when(old, F.col("at"))).over(own("met", "gap", "g")), "paired": F.max(new).over(own("met", "gap", "g"))})
    action = F.when(F.col("stays"), "unchanged").when(F.col("met"), "moved").when(old, "removed").when(F.col("was").isNull(), "new").otherwise("changed")
    rows = rows.filter(new | (~F.col("met") & ~F.col("paired")))
    was = F.when(F.col("met"), F.col("mate_at")).otherwise(F.col("was"))
    return rows.select("document_id", F.when(new, F.col("at")).alias("chunk_index"), was.alias("old_index"), action.alias("action"), (new & ~F.coalesce("known", F.lit(False))).alias("embed"))
