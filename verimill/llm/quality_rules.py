"""Quality rules with adaptive thresholds: mergeable quantile sketches for each language and source replace fixed cutoffs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import BLANKS, cut, lookup, words

#: Characters counted as symbols.
SYMBOLS = "#*$%&|<>"
#: The sketch counts values in bins of equal width, so that sketches of parts add up to the sketch of the whole, exactly. A ratio has 2,000
#: bins. A mean word length has 50 for each character up to LONGEST, and the last bin holds all above: 10,000 at most, whatever the corpus.
RATIO_BINS = 2000
LENGTH_BINS = 50
LONGEST = 200
#: A document is far out beyond a quartile by FENCE times the distance between the quartiles, or by the least slack if that is more.
FENCE = 8.0
LEAST_SLACK = {"symbol_bin": 0.02 * RATIO_BINS, "line_bin": 0.3 * RATIO_BINS, "repeat_bin": 0.15 * RATIO_BINS, "length_bin": 1.75 * LENGTH_BINS}
#: Sketches of fewer documents than this are merged over their language, and those over everything.
LEAST_DOCS = 200


def features(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source and the word statistics of every whole text; a null text has no word and counts of 0."""
    base = docs.select("doc_id", "lang", "source", words(F.col("text")).alias("__w"), F.filter(F.split(F.col("text"), "\n"), lambda x: F.length(F.btrim(x, F.lit(BLANKS))) > 0).alias("__lines"), F.length(F.regexp_replace("text", f"[^{SYMBOLS}]+", "")).alias("__symbols"))
    n = F.size("__w").cast("long")
    return base.select(
        "doc_id",
        "lang",
        "source",
        n.alias("n_words"),
        F.length(F.array_join("__w", "")).cast("long").alias("word_chars"),
        F.coalesce(F.col("__symbols"), F.lit(0)).cast("long").alias("n_symbols"),
        F.coalesce(F.size("__lines"), F.lit(0)).cast("long").alias("n_lines"),
        F.coalesce(F.size("__lines") - F.size(F.array_distinct("__lines")), F.lit(0)).cast("long").alias("n_dup_lines"),
        repeat_words("__w").alias("n_repeat_words"),
    ).withColumn("n_lines", F.greatest("n_lines", F.lit(0))).withColumn("n_dup_lines", F.greatest("n_dup_lines", F.lit(0)))


def repeat_words(w: str) -> Column:
    """Words in 3-word windows that the array holds twice or more. Windows are sorted by hash with their places; equal neighbours repeat."""
    size = f"size({w})"
    windows = f"transform(sequence(1, {size} - 2), i -> named_struct('h', xxhash64(w[i - 1], w[i], w[i + 1]), 'i', i))"
    repeated = "filter(s, (x, j) -> x.h = try_element_at(s, j).h OR x.h = try_element_at(s, j + 2).h)"
    # places of s: x stands at j from 0, its left neighbour at j from 1, its right one at j + 2 from 1; place 0 is an error, so it's asked for as NULL
    repeated = repeated.replace("try_element_at(s, j).h", "try_element_at(s, nullif(j, 0)).h")
    places = f"flatten(transform({repeated}, x -> array(x.i, x.i + 1, x.i + 2)))"
    some = f"size(array_distinct(transform(t, x -> x.h))) < size(t)"
    counted = f"transform(array({windows}), t -> CASE WHEN {some} THEN transform(array(sort_array(t)), s -> size(array_distinct({places})))[0] ELSE 0 END)[0]"
    return F.expr(f"CAST(CASE WHEN {size} < 4 THEN 0 ELSE transform(array({w}), w -> {counted})[0] END AS BIGINT)")


def measures(df: DataFrame) -> DataFrame:
    """The measured bins; null where a document has no word. Integer arithmetic, so that every engine agrees."""
    ratio = lambda a, b: F.when(F.col(b) > 0, F.floor(F.col(a) * RATIO_BINS / F.col(b))).cast("long")
    return df.withColumns({"symbol_bin": ratio("n_symbols", "word_chars"), "line_bin": ratio("n_dup_lines", "n_lines"), "repeat_bin": ratio("n_repeat_words", "n_words"), "length_bin": F.when(F.col("n_words") > 0, F.least(F.floor(F.col("word_chars") * LENGTH_BINS / F.col("n_words")), F.lit(LONGEST * LENGTH_BINS))).cast("long")})


def fences(measured: DataFrame) -> DataFrame:
    """One row for each language and source: lowest and highest bin allowed for each measure.

    The sketch of a group is its bin counts; those of a language and of everything are sums of them. Quartiles come from the first of
    group, language and everything that holds LEAST_DOCS documents (everything, if none does).
    """
    bins = measured.select("lang", "source", F.expr("stack(4, " + ", ".join(f"'{k}', {k}" for k in LEAST_SLACK) + ") AS (measure, bin)")).filter("bin IS NOT NULL")
    sketch = bins.groupBy("lang", "source", "measure", "bin").agg(F.count("*").alias("n"))
    group = sketch.withColumn("level", F.lit(0))
    by_lang = sketch.groupBy("lang", "measure", "bin").agg(F.sum("n").alias("n")).select("lang", F.lit(None).cast("string").alias("source"), "measure", "bin", "n", F.lit(1).alias("level"))
    whole = sketch.groupBy("measure", "bin").agg(F.sum("n").alias("n")).select(F.lit(None).cast("string").alias("lang"), F.lit(None).cast("string").alias("source"), "measure", "bin", "n", F.lit(2).alias("level"))
    own = Window.partitionBy("level", "lang", "source", "measure")
    upto = own.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    ranked = group.unionByName(by_lang).unionByName(whole).withColumn("below", F.sum("n").over(upto)).withColumn("total", F.sum("n").over(own))
    quartiles = ranked.groupBy("level", "lang", "source", "measure").agg(F.max("total").alias("total"), F.min(F.when(F.col("below") * 4 >= F.col("total"), F.col("bin"))).alias("q1"), F.min(F.when(F.col("below") * 4 >= F.col("total") * 3, F.col("bin"))).alias("q3"))
    slack = F.expr("CASE measure " + " ".join(f"WHEN '{k}' THEN {v!r}D" for k, v in LEAST_SLACK.items()) + " END")
    reach = F.greatest((F.col("q3") - F.col("q1")) * F.lit(FENCE), slack)
    limits = quartiles.withColumns({"low": F.col("q1") - reach, "high": F.col("q3") + reach})
    at = lambda level: limits.filter(F.col("level") == level).drop("level", "q1", "q3")
    keys = at(0).select("lang", "source", "measure", F.col("total").alias("t0"), F.col("low").alias("l0"), F.col("high").alias("h0"))
    one = at(1).select(F.col("lang").alias("lang1"), F.col("measure").alias("m1"), F.col("total").alias("t1"), F.col("low").alias("l1"), F.col("high").alias("h1"))
    two = at(2).select(F.col("measure").alias("m2"), F.col("low").alias("l2"), F.col("high").alias("h2"))
    chosen = keys.join(one, keys["lang"].eqNullSafe(one["lang1"]) & (keys["measure"] == one["m1"]), "left").join(two, keys["measure"] == two["m2"], "left")
    pick = lambda x: F.when(F.col("t0") >= LEAST_DOCS, F.col(f"{x}0")).when(F.col("t1") >= LEAST_DOCS, F.col(f"{x}1")).otherwise(F.col(f"{x}2"))
    chosen = chosen.select("lang", "source", "measure", pick("l").alias("low"), pick("h").alias("high"))
    return chosen.groupBy("lang", "source").agg(*[F.max(F.when(F.col("measure") == k, F.col(side))).alias(f"{k}_{side}") for k in LEAST_SLACK for side in ("low", "high")])


def judge(docs: DataFrame) -> DataFrame:
    """features() of docs with base_failed and kept: inside the fences of its language and source, and not failed by the base rules.

    Null languages and sources are groups of their own. Documents without a word fail the base rules.
    """
    measured = measures(cut(features(docs), "features"))
    rows = lookup(measured, fences(measured), ["lang", "source"], F.col("doc_id"))
    inside = F.lit(True)
    for k in LEAST_SLACK:
        inside = inside & F.coalesce((F.col(k) <= F.col(f"{k}_high")) & ((F.col(k) >= F.col(f"{k}_low")) if k == "length_bin" else F.lit(True)), F.lit(True))
    failed = (F.col("n_words") < 50) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50)
    return rows.withColumn("base_failed", failed).withColumn("kept", ~failed & inside)


def op3_quality_rules(docs: DataFrame) -> DataFrame:
    """One row a row of docs, repeated ones too. Null, empty and blank texts have counts of 0 and fail the base rules; null languages and sources
    are groups like others; an empty table gives none; other columns are not read."""
    return judge(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def _oracle() -> str:
    bins = {"symbol_bin": ("n_symbols", "word_chars", RATIO_BINS), "line_bin": ("n_dup_lines", "n_lines", RATIO_BINS), "repeat_bin": ("n_repeat_words", "n_words", RATIO_BINS), "length_bin": ("word_chars", "n_words", LENGTH_BINS)}
    measured = ", ".join(f"CASE WHEN {b} > 0 THEN {f'least({a} * {k} // {b}, {LONGEST * LENGTH_BINS})' if m == 'length_bin' else f'{a} * {k} // {b}'} END AS {m}" for m, (a, b, k) in bins.items())
    stacked = " UNION ALL ".join(f"SELECT lang, source, '{m}' AS measure, {m} AS bin FROM m WHERE {m} IS NOT NULL" for m in bins)
    slack = "CASE measure " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in LEAST_SLACK.items()) + " END"
    wide = ", ".join(f"max(CASE WHEN measure = '{k}' THEN {s} END) AS {k}_{s}" for k in LEAST_SLACK for s in ("low", "high"))
    inside = " AND ".join(f"coalesce({k} <= {k}_high{f' AND {k} >= {k}_low' if k == 'length_bin' else ''}, true)" for k in LEAST_SLACK)
    return f"""
WITH w AS (
  SELECT doc_id, lang, source, text, CASE WHEN text IS NULL THEN [] ELSE regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') END AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines FROM documents),
g AS (SELECT *, row_number() OVER () AS r, list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) AS g FROM w),
e AS (SELECT r, unnest(g) AS gram, generate_subscripts(g, 1) AS i FROM g),
again AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, gram) AS n FROM e) WHERE n > 1),
covered AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS p FROM again) GROUP BY r),
f AS (
  SELECT doc_id, lang, source, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
    length(regexp_replace(coalesce(text, ''), '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, len(lines)::BIGINT AS n_lines,
    (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words FROM g LEFT JOIN covered USING (r)),
m AS (SELECT *, {measured} FROM f),
b AS (SELECT lang, source, measure, bin, count(*) AS n FROM ({stacked}) GROUP BY ALL),
s AS (SELECT 0 AS level, * FROM b UNION ALL SELECT 1, lang, NULL, measure, bin, sum(n) FROM b GROUP BY lang, measure, bin UNION ALL SELECT 2, NULL, NULL, measure, bin, sum(n) FROM b GROUP BY measure, bin),
k AS (SELECT *, sum(n) OVER (PARTITION BY level, lang, source, measure ORDER BY bin) AS below, sum(n) OVER (PARTITION BY level, lang, source, measure) AS total FROM s),
q AS (SELECT level, lang, source, measure, max(total) AS total, min(CASE WHEN below * 4 >= total THEN bin END) AS q1, min(CASE WHEN below * 4 >= total * 3 THEN bin END) AS q3 FROM k GROUP BY ALL),
l AS (SELECT level, lang, source, measure, total, q1 - greatest((q3 - q1) * {FENCE}, {slack}) AS low, q3 + greatest((q3 - q1) * {FENCE}, {slack}) AS high FROM q),
c AS (
  SELECT a.lang, a.source, a.measure, CASE WHEN a.total >= {LEAST_DOCS} THEN a.low WHEN o.total >= {LEAST_DOCS} THEN o.low ELSE t.low END AS low,
    CASE WHEN a.total >= {LEAST_DOCS} THEN a.high WHEN o.total >= {LEAST_DOCS} THEN o.high ELSE t.high END AS high
  FROM l a LEFT JOIN l o ON o.level = 1 AND o.lang IS NOT DISTINCT FROM a.lang AND o.measure = a.measure LEFT JOIN l t ON t.level = 2 AND t.measure = a.measure WHERE a.level = 0),
wide AS (SELECT lang, source, {wide} FROM c GROUP BY lang, source),
j AS (SELECT m.*, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, {inside} AS inside FROM m LEFT JOIN wide ON m.lang IS NOT DISTINCT FROM wide.lang AND m.source IS NOT DISTINCT FROM wide.source)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND inside AS kept FROM j
"""


ORACLE = _oracle()
