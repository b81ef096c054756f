"""The corpus pipeline: language ID, SimHash near-dedup, suffix-array dedup, mixing to target weights, BPE.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next one's docs. All but
the last return the columns of `documents`. SQL can't express the stages (fingerprints, suffix sorting, BPE), so ORACLE_SQL is None.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verimill.llm import bpe, language_id, mixing, simhash, suffix_dedup
from verimill.llm.common import cut


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a letter (null texts too) and those that are far from the profile of every language learned here."""
    return language_id.accepted(docs, language_id.fit(docs.select("doc_id", "text", "lang")))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group of near copies: that of the smallest doc_id, nulls last, ties by the hash of the text; of equal rows one."""
    first = simhash.near_copies(docs).select(F.col("first.doc_id").alias("__kept"), F.col("first.text_hash").alias("__kept_hash")).distinct()
    once = docs.withColumn("__hash", F.xxhash64("text")).dropDuplicates(["doc_id", "__hash"])
    return once.join(first, F.col("doc_id").eqNullSafe(F.col("__kept")) & (F.col("__hash") == F.col("__kept_hash")), "left_semi").select(*docs.columns)


def suffix_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes the bytes of 200-byte strings that stand elsewhere too from the texts. Rows are addressed by a number of their own."""
    numbered = cut(docs.withColumn("__row", F.monotonically_increasing_id()), "numbered")
    texts = suffix_dedup.remove_repeats(numbered.select(F.col("__row").alias("doc_id"), "text")).select(F.col("doc_id").alias("__of"), F.col("text").alias("__text"))
    joined = numbered.select("__row", F.col("text").isNull().alias("__null"), *[c for c in docs.columns if c not in ("text", "n_chars")]).join(texts, F.col("__row") == F.col("__of"))
    text = F.when(~F.col("__null"), F.col("__text"))
    made = {"text": text, "n_chars": F.coalesce(F.length(text), F.lit(0)).cast("long")}
    return joined.select(*[made[c].alias(c) if c in made else F.col(c) for c in docs.columns])


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Emits each document as often as its source's target asks for."""
    return mixing.mix(docs)


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids (little-endian 32-bit integers) and the digests of ids and decoded text."""
    import public_tokenizers

    return bpe.digest(docs, public_tokenizers.path("word_bpe_49k.json"), with_ids=True)


STAGES = [
    ("language_id", language_stage),
    ("simhash_near_dedup", near_dedup_stage),
    ("suffix_array_dedup", suffix_dedup_stage),
    ("mixing", mixing_stage),
    ("bpe", bpe_stage),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table `documents`, each written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = cut(docs, name)
    return docs
