"""Scalar functions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

# Filler words that normalisation drops.
FILLERS = ("the", "a", "an", "of", "for", "in", "to", "and", "or", "is", "are", "was", "were", "our", "their", "its", "das", "die", "der", "ein", "eine", "und", "oder", "für", "von", "im", "am")


def normalize_text(c: Column) -> Column:
    """Lower case, punctuation to spaces, fillers dropped, white space collapsed."""
    parts = F.split(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}_\s]", " "), r"\s+")
    return F.array_join(F.filter(parts, lambda w: (w != "") & ~w.isin(*FILLERS)), " ")


def content_hash(c: Column) -> Column:
    return F.sha2(c, 256)


def terms(c: Column) -> Column:
    """Lexical tokens: lower case, runs of letters and digits, no stemming."""
    return F.filter(F.split(F.lower(c), r"[^\p{L}\p{N}]+"), lambda t: t != "")


def token_count(c: Column) -> Column:
    """Words and punctuation marks."""
    return F.size(F.regexp_extract_all(c, F.lit(r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]"), F.lit(0))).cast("long")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine_similarity(a: Column, b: Column) -> Column:
    """0 if a norm is 0."""
    n = norm(a) * norm(b)
    return F.when(n > 0, dot(a, b) / n).otherwise(0.0)


def is_zero_vector(a: Column) -> Column:
    return ~F.exists(a, lambda x: x != 0)


def trigrams(c: Column) -> Column:
    """Distinct trigrams of the words, each padded with two spaces before and one behind."""
    grams = F.flatten(F.transform(terms(c), lambda w: F.transform(F.sequence(F.lit(1), F.length(w) + 1), lambda i: F.substring(F.concat(F.lit("  "), w, F.lit(" ")), i, F.lit(3)))))
    return F.array_distinct(grams)


def set_similarity(a: Column, b: Column) -> Column:
    """Jaccard similarity of two arrays without repeats; 0 if both are empty."""
    both = F.size(F.array_intersect(a, b))
    union = F.size(a) + F.size(b) - both
    return F.when(union > 0, both / union).otherwise(0.0)


def trigram_similarity(a: Column, b: Column) -> Column:
    return set_similarity(trigrams(a), trigrams(b))


def rrf(weight: float, rank: Column, k: int = 60) -> Column:
    """A list's share of the fused score; 0 where the list doesn't have the row."""
    return F.coalesce(F.lit(float(weight)) / (F.lit(k) + rank), F.lit(0.0))


def clean_reply(c: Column) -> Column:
    """A model's reply without thinking, from the fenced block if there is one, from the first [ to the last ]; null if there is none."""
    bare = F.regexp_replace(c, r"(?s)<think>.*?</think>", "")
    fenced = F.regexp_extract(bare, r"(?s)```(?:json)?\s*(.*?)```", 1)
    text = F.when(fenced != "", fenced).otherwise(bare)
    return F.nullif(F.regexp_extract(text, r"(?s)(\[.*\])", 1), F.lit(""))


def first_score(c: Column) -> Column:
    """The first number in a text, clamped to [0, 1]; 0.5 if there is none."""
    number = F.regexp_extract(c, r"(\d+(?:\.\d+)?)", 1).try_cast("double")
    return F.when(number.isNull(), 0.5).otherwise(F.least(F.greatest(number, F.lit(0.0)), F.lit(1.0)))


def register(spark: SparkSession) -> None:
    """normalize_text, trigram_set, trigram_similarity, cosine_similarity and rrf as SQL functions of the session."""
    fill = ", ".join(f"'{w}'" for w in FILLERS)
    spark.sql(rf"CREATE OR REPLACE TEMPORARY FUNCTION normalize_text(x STRING) RETURNS STRING RETURN array_join(filter(split(regexp_replace(lower(x), '[^\\p{{L}}\\p{{N}}_\\s]', ' '), '\\s+'), w -> w <> '' AND w NOT IN ({fill})), ' ')")
    spark.sql(r"CREATE OR REPLACE TEMPORARY FUNCTION trigram_set(x STRING) RETURNS ARRAY<STRING> RETURN array_distinct(flatten(transform(filter(split(lower(x), '[^\\p{L}\\p{N}]+'), t -> t <> ''), w -> transform(sequence(1, length(w) + 1), i -> substr(concat('  ', w, ' '), i, 3)))))")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION trigram_similarity(x STRING, y STRING) RETURNS DOUBLE RETURN CASE WHEN size(array_union(trigram_set(x), trigram_set(y))) = 0 THEN 0 ELSE size(array_intersect(trigram_set(x), trigram_set(y))) / size(array_union(trigram_set(x), trigram_set(y))) END")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION rrf(w DOUBLE, r BIGINT) RETURNS DOUBLE RETURN coalesce(w / (60 + r), 0)")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION cosine_similarity(x ARRAY<DOUBLE>, y ARRAY<DOUBLE>) RETURNS DOUBLE RETURN coalesce(aggregate(zip_with(x, y, (a, b) -> a * b), 0D, (s, v) -> s + v) / nullif(sqrt(aggregate(x, 0D, (s, v) -> s + v * v)) * sqrt(aggregate(y, 0D, (s, v) -> s + v * v)), 0), 0)")
