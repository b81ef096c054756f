"""Mixing sources to target weights: every document is emitted floor(rate) times plus one hash-seeded Bernoulli copy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, lookup, word_count

WEIGHTS = (1, 2, 3)
MOST_REPEATS = 3
SEED = "mix-1"
#: Draws have 52 bits: 13 hexadecimal digits of the MD5 of seed and id.
DRAW_DIGITS = 13
#: Documents of a size class whose draws are sorted; and rows of the table of classes, some 40 bytes each, that is broadcast.
RANKED, QUOTA_ROWS = 100, 200_000


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_REPEATS) -> DataFrame:
    """One row a source: source, source_size, target.

    `sizes` has source and size. Sources in code point order, null last, take the weights in turn. The whole size is shared out by weight;
    a share stops at `most` times its source's size, and what is left over goes to the others by weight. Sources by rising limit for each
    unit of weight: those that stop come first, so running sums give the level at which the rest stand. The windows run over one row a source.
    An empty table gives no row; sources of size 0 get target 0.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    everything = Window.partitionBy()
    turn = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (turn % len(weights) + 1).cast("int"))
    per = per.withColumn("__turn", turn).withColumn("__weight", weight).withColumn("__cap", F.col("source_size") * F.lit(float(most)))
    by_limit = Window.orderBy(F.col("__cap") / F.col("__weight"), "__turn")
    stopped = F.coalesce(F.sum("__cap").over(by_limit.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum("__weight").over(by_limit.rowsBetween(0, Window.unboundedFollowing))
    per = per.withColumn("__level", (F.sum("source_size").over(everything) - stopped) / rest).withColumn("__place", F.row_number().over(by_limit))
    free = F.when(F.col("__level") * F.col("__weight") <= F.col("__cap"), F.struct("__place", "__level"))
    per = per.withColumn("__at", F.min(free).over(everything)["__level"])
    return per.select("source", "source_size", F.least(F.col("__cap"), F.col("__at") * F.col("__weight")).alias("target"))


def draw(key: Column, seed: str = SEED) -> Column:
    """A number in [0, 1) that key and seed decide."""
    digest = F.md5(F.concat_ws("|", F.lit(seed), key).cast("binary"))
    return F.conv(F.substring(digest, 1, DRAW_DIGITS), 16, 10).cast("double") / F.lit(float(16**DRAW_DIGITS))


def sized(docs: DataFrame, seed: str = SEED, *others: str) -> DataFrame:
    """doc_id, source, size (words), any other columns, and u, the draw, which the id decides; where it is null, the text; where both are, the word null."""
    key = F.coalesce(F.col("doc_id").cast("string"), F.md5(F.col("text").cast("binary")), F.lit("null"))
    return docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), *others, draw(key, seed).alias("u"))


def size_class(size: Column) -> Column:
    """Sizes below 64 are a class each; above, one class holds sizes that agree in their length in bits and first six bits."""
    bits = F.length(F.bin(size))
    return F.when(size < 64, size).otherwise(bits * 100 + F.expr("shiftright(size, length(bin(size)) - 6)")).cast("int")


def quotas(classes: DataFrame, seed: str = SEED) -> DataFrame:
    """(source, cls, n, m): how many of the n documents of a size class get the Bernoulli copy; classes has source, cls, n, s (the sum of
    sizes) and fraction.

    Classes follow each other from large to small. One of n documents of mean size s gets floor(n * fraction + d / s + u) of them: u is a
    seeded draw of its own, d what the classes before are short of. So a document's probability is the fraction, and what a large document
    takes too much or too little is made up for by smaller ones. One row a source holds its classes, at most some 2,000.
    """
    u = draw(F.concat_ws("|", F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("null")), F.col("cls").cast("string")), seed)
    rows = classes.withColumn("u", u).groupBy("source").agg(F.reverse(F.array_sort(F.collect_list(F.struct("cls", "n", "s", "fraction", "u")))).alias("classes"))
    kind = "struct<d: double, out: array<struct<cls: int, n: bigint, m: bigint>>>"
    start = F.struct(F.lit(0.0).alias("d"), F.array().cast("array<struct<cls: int, n: bigint, m: bigint>>").alias("out")).cast(kind)

    def step(acc: Column, x: Column) -> Column:
        n, s, f = x["n"].cast("double"), x["s"].cast("double"), x["fraction"]
        wanted = F.when(s > 0, (f * s + acc["d"]) / (s / n)).otherwise(f * n)
        m = F.greatest(F.lit(0.0), F.least(n, F.floor(wanted + x["u"]).cast("double")))
        d = acc["d"] + f * s - m * (s / n)
        made = F.struct(x["cls"].alias("cls"), x["n"].alias("n"), m.cast("bigint").alias("m"))
        return F.struct(d.alias("d"), F.concat(acc["out"], F.array(made)).alias("out")).cast(kind)

    walked = rows.select("source", F.explode(F.aggregate("classes", start, step)["out"]).alias("x"))
    return walked.select("source", "x.cls", "x.n", "x.m")


def limits(stats: DataFrame, targets: DataFrame, seed: str = SEED) -> DataFrame:
    """(source, cls, limit): documents whose draw is at most the limit get the Bernoulli copy.

    In a class of up to RANKED documents it is the quota's last draw, so that the quota is met; in larger ones the quota's share.
    """
    classed = stats.withColumn("cls", size_class(F.col("size")))
    counts = classed.groupBy("source", "cls").agg(F.count("*").alias("n"), F.sum("size").alias("s"))
    given = cut(quotas(lookup(counts, targets.select("source", "fraction"), ["source"], F.col("cls")), seed), "quotas")
    small = given.filter((F.col("n") <= RANKED) & (F.col("m") > 0)).select("source", "cls", "m")
    ranked = lookup(classed.select("source", "cls", "u"), small, ["source", "cls"], F.col("u"), QUOTA_ROWS).filter("m IS NOT NULL")
    last = ranked.groupBy("source", "cls").agg(F.element_at(F.sort_array(F.collect_list("u")), F.first("m").cast("int")).alias("limit"))
    share = F.when(F.col("m") > 0, F.col("m") / F.col("n")).otherwise(F.lit(-1.0))
    return given.filter((F.col("n") > RANKED) | (F.col("m") == 0)).select("source", "cls", share.alias("limit")).unionByName(last)


def mix_plan(rows: DataFrame, stats: DataFrame, seed: str = SEED, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_REPEATS) -> DataFrame:
    """rows (source, size, u, any others) with source_size, target and copies (int, 0 to `most`); stats are the same rows' source, size and u.

    copies are floor(rate) and one more for those that the hash-seeded Bernoulli draw takes, with the rate's fraction as its probability; see
    quotas() for how the draws of a source balance. No row is lost: documents that the mix leaves out have 0 copies. Null sources are one
    source; rows of one doc_id have one draw, so repeated ones are taken or left together. Texts aren't shuffled, but where there are more
    sources or classes than are broadcast.
    """
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    targets = cut(source_targets(stats.select("source", "size"), weights, most).withColumn("rate", rate).withColumn("fraction", F.col("rate") - F.floor("rate")), "targets")
    table = targets.select("source", "source_size", "target", F.col("rate").alias("__rate"))
    known = lookup(rows.withColumn("__cls", size_class(F.col("size"))), table, ["source"], F.col("u"))
    chosen = lookup(known, limits(stats, targets, seed).withColumnRenamed("cls", "__cls"), ["source", "__cls"], F.col("u"), QUOTA_ROWS)
    copies = F.least(F.lit(most), F.floor("__rate") + (F.col("u") <= F.col("limit")).cast("long")).cast("int")
    return chosen.withColumn("copies", copies).drop("__rate", "__cls", "limit")


def mix(docs: DataFrame, seed: str = SEED, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_REPEATS) -> DataFrame:
    """The mixed documents themselves, with the columns of docs; needs doc_id, text and source."""
    stats = cut(sized(docs, seed).select("source", "size", "u"), "sizes")
    named = sized(docs.withColumn("__doc", F.struct(*docs.columns)), seed, "__doc")
    planned = mix_plan(named, stats, seed, weights, most).filter("copies > 0")
    return planned.select("__doc", F.explode(F.array_repeat(F.lit(1), F.col("copies")))).select("__doc.*")


def op1_mixing(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target and taken of every row. Null, empty and blank texts have size 0; null ids and sources, repeated rows and
    ties: see mix_plan(); whole texts are counted; an empty table gives none; other columns are not read."""
    rows = cut(sized(docs), "sizes")
    return mix_plan(rows, rows).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).cast("long").alias("taken"))


ORACLE = f"""
WITH RECURSIVE docs AS (
  SELECT doc_id, source, size, ('0x' || substr(md5('{SEED}|' || coalesce(doc_id::VARCHAR, md5(text), 'null')), 1, 13))::BIGINT / {16**DRAW_DIGITS}.0::DOUBLE AS u,
    CASE WHEN size < 64 THEN size ELSE length(bin(size)) * 100 + (size >> (length(bin(size)) - 6)) END::BIGINT AS cls
  FROM (SELECT doc_id, source, text, CASE WHEN text IS NULL THEN 0 ELSE len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) END::BIGINT AS size FROM documents)),
per AS (
  SELECT source, sum(size)::BIGINT AS source_size, ((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1)::DOUBLE AS weight FROM docs GROUP BY source),
whole AS (SELECT coalesce(sum(source_size), 0)::DOUBLE AS total FROM per),
rounds AS (
  SELECT 0 AS r, source, source_size, weight, false AS stopped, total, total * weight / sum(weight) OVER () AS target FROM per, whole
  UNION ALL
  SELECT r + 1, source, source_size, weight, halt, total,
    CASE WHEN halt THEN 3.0 * source_size ELSE (total - sum(CASE WHEN halt THEN 3.0 * source_size ELSE 0 END) OVER ()) * weight / sum(CASE WHEN halt THEN 0 ELSE weight END) OVER () END
  FROM (SELECT *, stopped OR target > 3.0 * source_size AS halt, bool_or(NOT stopped AND target > 3.0 * source_size) OVER () AS more FROM rounds) WHERE more),
final AS (SELECT source, source_size, target, CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0 END::DOUBLE AS rate FROM rounds WHERE r = (SELECT max(r) FROM rounds)),
classes AS (
  SELECT docs.source, cls, count(*)::DOUBLE AS n, sum(size)::DOUBLE AS s, any_value(rate - floor(rate)) AS f, row_number() OVER (PARTITION BY docs.source ORDER BY cls DESC) AS k,
    ('0x' || substr(md5('{SEED}|' || coalesce('s' || docs.source, 'null') || '|' || cls), 1, 13))::BIGINT / {16**DRAW_DIGITS}.0::DOUBLE AS u
  FROM docs JOIN final ON docs.source IS NOT DISTINCT FROM final.source GROUP BY docs.source, cls),
walk AS (
  SELECT 0::BIGINT AS k, source, NULL::BIGINT AS cls, 0::DOUBLE AS n, 0::DOUBLE AS m, 0::DOUBLE AS d FROM final
  UNION ALL
  SELECT k, source, cls, n, m, d + f * s - m * (s / n) FROM (
    SELECT c.*, w.d, greatest(0, least(c.n, floor(CASE WHEN s > 0 THEN (f * s + w.d) / (s / c.n) ELSE f * c.n END + u)))::DOUBLE AS m
    FROM walk w JOIN classes c ON c.source IS NOT DISTINCT FROM w.source AND c.k = w.k + 1)),
bounds AS (
  SELECT w.source, w.cls, CASE WHEN any_value(m) = 0 THEN -1 WHEN any_value(n) <= {RANKED} THEN list_sort(list(docs.u))[any_value(m)::BIGINT] ELSE any_value(m) / any_value(n) END AS bound
  FROM walk w JOIN docs ON docs.source IS NOT DISTINCT FROM w.source AND docs.cls = w.cls GROUP BY w.source, w.cls)
SELECT doc_id, size, source_size, target, (size * least(3, floor(rate) + CASE WHEN u <= bound THEN 1 ELSE 0 END))::BIGINT AS taken
FROM docs JOIN final ON docs.source IS NOT DISTINCT FROM final.source JOIN bounds ON docs.source IS NOT DISTINCT FROM bounds.source AND docs.cls = bounds.cls
"""
