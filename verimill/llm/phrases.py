"""Phrase collocations: FM-indexes of shards of words list the phrases of up to four words with their counts, which are summed over all shards.

A shard is some megabytes of documents of one language, as numbered words. A phrase that is to count `least` times has only words and pairs of
words that do, so each pass knows the frequent ones of the pass before by a Bloom filter of bounded size; what it lets through wrongly is
dropped by the counts. A shard's index reads both ways: intervals of words are extended to the right by ranks of the shard read backwards, and
again by a word at their left, so that one pass lists phrases of three and four words from those of two. Counts of parts are looked up by joins.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, drop_cut, slices
from .fm_index import TwoWay
from .segments import mixed

LONGEST = 4
#: Bytes of text of a shard; all languages that a task has open together hold four times as many.
SHARD_BYTES = 6_000_000
#: Bits of a filter for each phrase in it, and bits at most: 16 MB.
BLOOM_RATE, BLOOM_BITS = 16, 1 << 27
#: Ends a piece; UTF-8 has no such byte.
END = b"\xff"
LEFT_OUT = "und"


def piece_table() -> bytes:
    """For bytes.translate(): A-Z become a-z, what ends a piece becomes END."""
    table = bytearray(range(256))
    for c in b"ABCDEFGHIJKLMNOPQRSTUVWXYZ":
        table[c] = c + 32
    for c in b".,;:!?\n\x0b\x0c\r":
        table[c] = END[0]
    return bytes(table)


PIECES = piece_table()
SHARD = "lang string, words array<string>, counts array<long>, text binary"
SHARD_ARROW = pa.schema([("lang", pa.string()), ("words", pa.list_(pa.string())), ("counts", pa.list_(pa.int64())), ("text", pa.binary())])


def shards(docs: DataFrame, most: int = SHARD_BYTES) -> DataFrame:
    """SHARD rows of docs (lang, text): a shard's words, how often each occurs, and its texts as their numbers from 1, 0 behind each piece."""

    def packed(lang: str, texts: list[bytes]) -> pa.RecordBatch:
        import zstandard

        tokens = (b" " + END + b" ").join(texts).translate(PIECES).replace(END, b" " + END + b" ").split()
        tokens.append(END)
        numbers = {END: 0}
        x = np.fromiter((numbers.setdefault(t, len(numbers)) for t in tokens), np.int32, len(tokens))
        x = x[np.r_[True, (x[1:] > 0) | (x[:-1] > 0)]]  # one end is enough
        counts = np.bincount(x, minlength=len(numbers))[1:]
        values = [[lang], [[w.decode() for w in list(numbers)[1:]]], [counts.tolist()], [zstandard.compress(x.tobytes(), 3)]]
        return pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(values, SHARD_ARROW, strict=True)], schema=SHARD_ARROW)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_: dict[str, list[bytes]] = {}
        sizes: dict[str, int] = {}
        for batch in batches:
            for piece in slices(batch, "text", most):
                for lang, text in zip(piece.column(0).to_pylist(), piece.column(1).to_pylist(), strict=True):
                    data = text.encode()
                    open_.setdefault(lang, []).append(data)
                    sizes[lang] = sizes.get(lang, 0) + len(data) + 1
                    full = lang if sizes[lang] >= most else max(sizes, key=sizes.get) if sum(sizes.values()) > 4 * most else None
                    if full is not None:
                        yield packed(full, open_.pop(full))
                        del sizes[full]
        for lang, texts in open_.items():
            yield packed(lang, texts)

    return docs.filter("text <> ''").select(F.coalesce("lang", F.lit(LEFT_OUT)).alias("lang"), "text").mapInArrow(run, SHARD)


def word_hashes(lang: str, words: list[str]) -> np.ndarray:
    import xxhash

    seed = xxhash.xxh64_intdigest(lang)
    return np.fromiter((xxhash.xxh64_intdigest(w, seed) for w in words), np.uint64, len(words))


def pair_hashes(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mixed(a * np.uint64(0x9E3779B97F4A7C15) + (b ^ (b >> np.uint64(29))))


class Bloom:
    """Two bits for each hash."""

    def __init__(self, bits: int, words: np.ndarray):
        self.bits, self.words = bits, words

    @staticmethod
    def places(hashes: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
        mask = np.uint64(bits - 1)
        return hashes & mask, (hashes >> np.uint64(32)) & mask

    def has(self, hashes: np.ndarray) -> np.ndarray:
        out = np.ones(len(hashes), bool)
        for at in self.places(hashes, self.bits):
            out &= (self.words[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) != 0
        return out


def bloom(phrases: DataFrame) -> Bloom:
    """A filter of phrases (lang, phrase) of one word or of two, made where they are; the driver gets its words, at most BLOOM_BITS / 64."""
    bits = 1 << max(6, min(BLOOM_BITS, BLOOM_RATE * phrases.count()).bit_length())
    bits = min(bits, BLOOM_BITS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, rows = batch.column(0).to_pylist(), [p.split(" ") for p in batch.column(1).to_pylist()]
            hashes = np.empty(len(rows), np.uint64)
            for lang in set(langs):
                own = [k for k, x in enumerate(langs) if x == lang]
                h = word_hashes(lang, [rows[k][0] for k in own])
                two = [j for j, k in enumerate(own) if len(rows[k]) > 1]
                h[two] = pair_hashes(h[two], word_hashes(lang, [rows[own[j]][1] for j in two]))
                hashes[own] = h
            at = np.unique(np.concatenate(Bloom.places(hashes, bits)))
            word = (at >> np.uint64(6)).astype(np.int64)
            first = np.flatnonzero(np.r_[True, word[1:] != word[:-1]]) if len(word) else np.empty(0, np.int64)
            masks = np.bitwise_or.reduceat(np.uint64(1) << (at & np.uint64(63)), first) if len(word) else np.empty(0, np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(word[first]), pa.array(masks.view(np.int64))], ["word", "mask"])

    made = phrases.select("lang", "phrase").mapInArrow(run, "word long, mask long").groupBy("word").agg(F.bit_or("mask").alias("mask")).toArrow()
    words = np.zeros(bits // 64, np.uint64)
    words[made["word"].to_numpy()] = made["mask"].to_numpy().view(np.uint64)
    return Bloom(bits, words)


def joined(words: pa.Array, rows: np.ndarray) -> pa.Array:
    return pc.binary_join_element_wise(*[words.take(pa.array(rows[:, k] - 1)) for k in range(rows.shape[1])], " ")


def phrase_counts(table: DataFrame, frequent: Bloom, pairs: Bloom | None) -> DataFrame:
    """(key, n) of each shard: its phrases of two words; or, with `pairs`, those of three and four words all of whose pairs it has. A key is the
    language, a line feed, which no phrase has, and the phrase: one string makes the smallest rows to shuffle."""
    spark = table.sparkSession
    held = spark.sparkContext.broadcast((frequent.bits, frequent.words, *((pairs.bits, pairs.words) if pairs else ())))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        filters = [Bloom(held.value[k], held.value[k + 1]) for k in range(0, len(held.value), 2)]
        for batch in batches:
            for i in range(batch.num_rows):
                lang, words = batch.column(0)[i].as_py(), batch.column(1)[i].as_py()
                x = np.frombuffer(zstandard.decompress(batch.column(2)[i].as_py()), np.int32).astype(np.int64)
                hashes = word_hashes(lang, words)
                # only frequent words beside another stay, in runs; they are numbered anew
                common = np.r_[False, filters[0].has(hashes)][x]
                beside = common & (np.r_[False, common[:-1]] | np.r_[common[1:], False])
                kept = beside | np.r_[True, beside[:-1]]
                y = np.where(beside, x, 0)[kept]
                known = np.unique(y[y > 0])
                if not len(known):
                    continue
                hashes = np.r_[np.uint64(0), hashes[known - 1]]
                names = pa.array(words, pa.string()).take(pa.array(known - 1))
                number = np.zeros(len(words) + 1, np.int64)
                number[known] = np.arange(1, len(known) + 1)
                y = np.r_[number[y], 0]
                for rows, n in phrases_of(TwoWay(y, len(known) + 1, LONGEST), hashes, filters[1] if len(filters) > 1 else None):
                    for at in range(0, len(rows), 200_000):
                        part = rows[at : at + 200_000]
                        yield pa.RecordBatch.from_arrays([pc.binary_join_element_wise(lang, joined(names, part), "\n"), pa.array(n[at : at + 200_000])], ["key", "n"])

    return table.select("lang", "words", "text").mapInArrow(run, "key string, n long")


def phrases_of(index: TwoWay, hashes: np.ndarray, pairs: Bloom | None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows of word numbers, counts) of a shard's phrases: pairs, or those of three words and of four."""
    word, low, high = index.words()
    owner, right, low, high = index.extend(low, high, right=True)
    rows = np.stack([word[owner], right], axis=1)
    if pairs is None:
        yield rows, (high - low)[0]
        return

    def fits(rows: np.ndarray, low: np.ndarray, high: np.ndarray, first: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Those whose pair at `first` is frequent."""
        at = pairs.has(pair_hashes(hashes[rows[:, first]], hashes[rows[:, first + 1]]))
        return rows[at], low[:, at], high[:, at]

    rows, low, high = fits(rows, low, high, 0)
    owner, right, low, high = index.extend(low, high, right=True)
    rows, low, high = fits(np.concatenate([rows[owner], right[:, None]], axis=1), low, high, 1)
    yield rows, (high - low)[0]
    owner, left, low, high = index.extend(low, high, right=False)
    rows, low, high = fits(np.concatenate([left[:, None], rows[owner]], axis=1), low, high, 0)
    yield rows, (high - low)[0]


def frequent_phrases(docs: DataFrame, least: int = 30) -> tuple[DataFrame, DataFrame]:
    """(lang, words, phrase, n) of the phrases of one to LONGEST words that occur `least` times or more in a language, and (lang, n): all its words."""
    table = cut(shards(docs), "shards")
    one = cut(table.select("lang", F.explode(F.arrays_zip("words", "counts")).alias("x")).groupBy("lang", F.col("x.words").alias("phrase")).agg(F.sum("x.counts").alias("n")), "words")
    sizes = one.groupBy("lang").agg(F.sum("n").alias("n"))
    one = one.filter(F.col("n") >= least).select("lang", F.lit(1).alias("words"), "phrase", "n")
    frequent, found, pairs = bloom(one), [], None
    for name in ("pairs", "longer"):
        summed = phrase_counts(table, frequent, pairs).groupBy("key").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)
        summed = summed.withColumn("phrase", F.substring_index("key", "\n", -1))
        found.append(cut(summed.select(F.expr("left(key, length(key) - length(phrase) - 1)").alias("lang"), F.size(F.split("phrase", " ")).alias("words"), "phrase", "n"), name))
        pairs = pairs or bloom(found[0])
    drop_cut(table)
    return one.unionByName(found[0]).unionByName(found[1]), sizes


def collocations(phrases: DataFrame) -> DataFrame:
    """(lang, phrase, a, l, r, score) of the phrases of several words that no longer one stands for, from (lang, words, phrase, n) with all parts.

    score is the least of floor(2000000 * a / (l + r)) over the cuts into two parts, of equal scores that of the first cut. A phrase goes if a
    longer one that holds it occurs at least 0.8 times as often.
    """
    several = phrases.filter("words > 1").select("lang", "words", "phrase", F.col("n").alias("a"), F.split("phrase", " ").alias("w"))
    known = phrases.select("lang", "phrase", "n")
    cuts = several.select("lang", "phrase", "a", "w", "words", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", F.array_join(F.slice("w", F.lit(1), F.col("k")), " ").alias("left"), F.array_join(F.slice("w", F.col("k") + 1, F.col("words") - F.col("k")), " ").alias("right"))
    cuts = cuts.join(known.select("lang", F.col("phrase").alias("left"), F.col("n").alias("l")), ["lang", "left"])
    cuts = cuts.join(known.select("lang", F.col("phrase").alias("right"), F.col("n").alias("r")), ["lang", "right"])
    score = F.expr("CAST((CAST(a AS DECIMAL(20, 0)) * 2000000) DIV (CAST(l AS DECIMAL(20, 0)) + r) AS BIGINT)")
    least = cuts.groupBy("lang", "phrase", "a").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("x"))
    inside = several.filter("words > 2").select("lang", "a", F.explode(F.expr("flatten(transform(sequence(2, words - 1), m -> transform(sequence(1, words - m + 1), i -> array_join(slice(w, i, m), ' '))))")).alias("phrase"))
    longer = inside.groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    out = least.join(longer, ["lang", "phrase"], "left").filter("longer IS NULL OR 100 * CAST(longer AS DECIMAL(20, 0)) < 80 * CAST(a AS DECIMAL(20, 0))")
    return out.select("lang", "phrase", "a", "x.l", "x.r", "x.score")


def op12_phrases(docs: DataFrame, least: int = 30, most: int = 2000) -> DataFrame:
    """lang, rank, phrase, a, l, r, n and score of each language's first `most` collocations of docs (lang, text).

    A null language is `und`, as is one of that name. Null, empty and blank texts have no words; repeated rows count as often as they come.
    """
    phrases, sizes = frequent_phrases(docs, least)
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    top = collocations(cut(phrases, "phrases")).withColumn("rank", F.row_number().over(order).cast("long")).filter(F.col("rank") <= most)
    return top.join(sizes, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


ORACLE = """WITH p AS MATERIALIZED (SELECT lang, row_number() OVER () AS id, list_filter(string_split_regex(piece, '[\\x20\\x09]+'), lambda x: x <> '') AS w FROM (SELECT coalesce(lang, 'und') AS lang,
    unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents)),
u AS (SELECT lang, id, unnest(w) AS w1, generate_subscripts(w, 1) AS i FROM p WHERE len(w) > 0),
v AS MATERIALIZED (SELECT lang, w1, lead(w1, 1) OVER o AS w2, lead(w1, 2) OVER o AS w3, lead(w1, 3) OVER o AS w4 FROM u WINDOW o AS (PARTITION BY id ORDER BY i)),
g AS MATERIALIZED (SELECT lang, 1 AS k, w1 AS phrase, count(*) AS f FROM v GROUP BY ALL UNION ALL SELECT lang, 2, w1 || ' ' || w2, count(*) FROM v WHERE w2 IS NOT NULL GROUP BY ALL HAVING count(*) >= 30
    UNION ALL SELECT lang, 3, w1 || ' ' || w2 || ' ' || w3, count(*) FROM v WHERE w3 IS NOT NULL GROUP BY ALL HAVING count(*) >= 30 UNION ALL SELECT lang, 4, w1 || ' ' || w2 || ' ' || w3 || ' ' || w4, count(*) FROM v WHERE w4 IS NOT NULL GROUP BY ALL HAVING count(*) >= 30),
t AS (SELECT lang, sum(f) AS n FROM g WHERE k = 1 GROUP BY 1), c AS MATERIALIZED (SELECT *, string_split(phrase, ' ') AS w FROM g WHERE k > 1),
x AS MATERIALIZED (SELECT lang, phrase, k, f AS a, j, array_to_string(w[1:j], ' ') AS pre, array_to_string(w[j + 1 : k], ' ') AS post FROM c, (SELECT unnest([1, 2, 3]) AS j) WHERE j < k),
s AS (SELECT x.lang, x.phrase, j, a, l.f AS l, r.f AS r, CAST(2000000 * CAST(a AS HUGEINT) // (l.f + r.f) AS BIGINT) AS score FROM x JOIN g l ON l.lang = x.lang AND l.phrase = pre JOIN g r ON r.lang = x.lang AND r.phrase = post),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
i AS (SELECT lang, sub AS phrase, max(f) AS longer FROM (SELECT lang, f, array_to_string(w[i : i + m - 1], ' ') AS sub FROM c, (SELECT unnest([2, 2, 2, 3, 3]) AS m, unnest([1, 2, 3, 1, 2]) AS i) WHERE m < k AND i + m - 1 <= k) GROUP BY ALL),
o AS (SELECT b.lang, b.phrase, a, l, r, score FROM b LEFT JOIN i ON i.lang = b.lang AND i.phrase = b.phrase WHERE longer IS NULL OR 100 * longer < 80 * a)
SELECT o.lang, row_number() OVER (PARTITION BY o.lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, CAST(n AS BIGINT) AS n, score FROM o JOIN t ON o.lang = t.lang QUALIFY rank <= 2000"""
