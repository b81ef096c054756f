"""The knowledge index kept up to date: counts are taken back and added, and the best claim is looked for again only where it was withdrawn."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .claims import usable_claims
from .conflicts import checkpointed

ENTRY = ["tenant_id", "subject_normalized", "predicate_normalized"]
#: What decides between the claims of an entry, smallest first, and what the entry shows of the first.
BEST = "struct(-confidence AS c, claim_id, subject, predicate, object_value)"
ROW = [*ENTRY, "claim_id", "document_id", "confidence", "subject", "predicate", "object_value"]


def met(a: DataFrame, b: DataFrame, keys: list[str], how: str, only: Column | None = None) -> DataFrame:
    """a joined with b on equal keys, null with null too, and on `only`; still an equi-join. b's keys aren't in the result."""
    other = b.withColumnsRenamed({k: f"__{k}" for k in keys})
    on = reduce(lambda x, y: x & y, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys])
    return a.join(other, on if only is None else only & on, how).drop(*[f"__{k}" for k in keys])


def entries_of(rows: DataFrame) -> DataFrame:
    """(ENTRY, best, claim_count, document_count) of usable claims, as a state that apply_changes can go on with."""
    return support_of(rows).groupBy(*ENTRY).agg(F.min("best").alias("best"), F.sum("n").alias("claim_count"), F.count("*").alias("document_count"))


def support_of(rows: DataFrame) -> DataFrame:
    """(ENTRY, document_id, n, best): the claims of each document behind an entry. Partial sums of an entry that very many claims share."""
    return rows.groupBy(*ENTRY, "document_id").agg(F.count("*").alias("n"), F.min(F.expr(BEST)).alias("best"))


def shown(entries: DataFrame) -> DataFrame:
    """Entries in the shape of claims.build_index."""
    b = F.col("best")
    return entries.select(*ENTRY, b["subject"].alias("subject"), b["predicate"].alias("predicate"), b["object_value"].alias("value"), (-b["c"]).alias("confidence"), "claim_count", "document_count")


def claim_delta(claims: DataFrame, docs: DataFrame, claim_changes: DataFrame, doc_changes: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(claims after, docs after, withdrawn, added): both tables with their changes, and the usable claims that went and came.

    claim_changes has the columns of claims, one row a claim_id; a null status deletes the claim. doc_changes is (document_id, status) of
    documents, new ones included; a null status deletes the document. Only claims that are named or belong to a named document are compared;
    a claim that stays as it was is in neither result.
    """
    kept = claims.join(claim_changes.select("claim_id"), "claim_id", "left_anti")
    claims1 = kept.unionByName(claim_changes.filter("status IS NOT NULL").select(*claims.columns))
    state = docs.select("document_id", "status")
    docs1 = state.join(doc_changes.select("document_id"), "document_id", "left_anti").unionByName(doc_changes.filter("status IS NOT NULL").select("document_id", "status"))

    named = claim_changes.select("claim_id")
    moved = doc_changes.select("document_id").distinct()

    def touched(table: DataFrame, states: DataFrame) -> DataFrame:
        by_name = table.join(named, "claim_id", "left_semi")
        by_document = table.join(named, "claim_id", "left_anti").join(moved, "document_id", "left_semi")
        return usable_claims(by_name.unionByName(by_document), states).select(*ROW)

    before, after = touched(claims, state), touched(claims1, docs1)
    signed = before.withColumn("sign", F.lit(-1)).unionByName(after.withColumn("sign", F.lit(1))).groupBy(*ROW).agg(F.sum("sign").alias("sign"))
    repeated = checkpointed(signed).withColumn("sign", F.explode(F.array_repeat(F.signum("sign"), F.abs("sign").cast("int"))))
    return claims1, docs1, repeated.filter("sign < 0").drop("sign"), repeated.filter("sign > 0").drop("sign")


def apply_changes(entries: DataFrame, support: DataFrame, withdrawn: DataFrame, added: DataFrame, claims: DataFrame, docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(touched entries, touched support) after a delta; rows with a count of 0 are gone. merged() puts them into the tables.

    entries and support are the state before, claims and docs the tables after. Counts move by the delta alone. The best claim is the smaller of
    the old and the added ones, unless the old best was withdrawn: only the support of such a (entry, document) is taken from claims again, and
    only such an entry takes the best of its documents. Works with keys that are null. What is read
    more than once, tables of the size of the delta, is checkpointed.
    """
    keys = [*ENTRY, "document_id"]
    d = (
        withdrawn.withColumn("sign", F.lit(-1))
        .unionByName(added.withColumn("sign", F.lit(1)))
        .groupBy(*keys)
        .agg(F.sum("sign").alias("dn"), F.min(F.when(F.col("sign") > 0, F.expr(BEST))).alias("came"), F.min(F.when(F.col("sign") < 0, F.expr(BEST))).alias("went"))
    )
    moved = met(d, support.select(*keys, F.col("n").alias("n0"), F.col("best").alias("b0")), keys, "left")
    moved = moved.withColumn("n", F.coalesce("n0", F.lit(0)) + F.col("dn")).withColumn("lost", F.coalesce(F.col("went") <= F.col("b0"), F.lit(False)) & (F.col("n") > 0))
    moved = checkpointed(moved)
    again = moved.filter("lost").select(*keys)
    mine = usable_claims(claims.join(again.select("document_id").distinct(), "document_id", "left_semi"), docs).select(*ROW)
    fresh = support_of(met(mine, again, keys, "left_semi")).select(*keys, F.col("best").alias("b1"))
    best = F.when(F.col("n") > 0, F.when(F.col("lost"), F.col("b1")).otherwise(F.least("b0", "came")))
    after = met(moved, fresh, keys, "left", F.col("lost")).select(*keys, "n", best.alias("best"), "n0", "b0", "dn")
    after = checkpointed(after)

    step = after.groupBy(*ENTRY).agg(
        F.sum("dn").alias("dn"),
        F.sum((F.col("n") > 0).cast("long") - (F.coalesce("n0", F.lit(0)) > 0).cast("long")).alias("dd"),
        F.min("best").alias("came"),
        F.min(F.when((F.col("n") <= 0) | (F.col("best") > F.col("b0")), F.col("b0"))).alias("went"),
    )
    seen = met(step, entries.select(*ENTRY, F.col("claim_count").alias("c0"), F.col("document_count").alias("d0"), F.col("best").alias("b0")), ENTRY, "left")
    seen = seen.withColumn("claim_count", F.coalesce("c0", F.lit(0)) + F.col("dn")).withColumn("document_count", F.coalesce("d0", F.lit(0)) + F.col("dd"))
    seen = seen.withColumn("lost", F.coalesce(F.col("went") <= F.col("b0"), F.lit(False)) & (F.col("claim_count") > 0))
    seen = checkpointed(seen)
    unsure = seen.filter("lost").select(*ENTRY)
    documents = merged(met(support, unsure, ENTRY, "left_semi"), after.select(*keys, "n", "best"), keys, "n")
    first = met(documents, unsure, ENTRY, "left_semi").groupBy(*ENTRY).agg(F.min("best").alias("b1"))
    best = F.when(F.col("claim_count") > 0, F.when(F.col("lost"), F.col("b1")).otherwise(F.least("b0", "came")))
    out = met(seen, first, ENTRY, "left", F.col("lost"))
    return out.select(*ENTRY, best.alias("best"), "claim_count", "document_count"), after.select(*keys, "n", "best")


def merged(table: DataFrame, touched: DataFrame, keys: list[str] = ENTRY, count: str = "claim_count") -> DataFrame:
    """table with its touched rows replaced; rows whose count is 0 are left out."""
    return met(table, touched.select(*keys), keys, "left_anti").unionByName(touched.filter(F.col(count) > 0).select(*table.columns))
