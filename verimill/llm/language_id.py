"""Language ID with rank-order profiles: out-of-place distance between a document's most frequent n-grams and each language's."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import in_arrow

#: n-grams of a profile, of a language and of a document.
PROFILE = 300
#: Labelled documents that a language's profile is counted on, at most about so many: a seeded hash of the id picks them.
SAMPLE = 2000
#: accepted() rejects documents further than this share of the largest distance from every profile.
FAR = 0.85
#: Languages that are learned at most: those with most documents, ties by code point.
MOST_LANGUAGES = 4096


def grams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the 1-, 2- and 3-grams of a lower-cased text and their counts. What isn't a letter counts as one space; grams of spaces only are left out.

    A character has 21 bits, so three of them fill a 64-bit code without loss.
    """
    code = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.int64)
    if not len(code):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    low = code < 128
    letter = np.where(low, (code >= 97) & (code <= 122), True)
    if not low.all():
        odd = np.unique(code[~low])
        letter &= ~np.isin(code, odd[[not chr(c).isalpha() for c in odd]])
    code = np.where(letter, code, 32)
    code = np.r_[32, code[np.r_[True, (code[1:] != 32) | (code[:-1] != 32)]], 32]
    two = code[:-1] << 21 | code[1:]
    three = two[:-1] << 21 | code[2:]
    every = np.concatenate([code[code != 32], two[two != (32 << 21 | 32)], three])
    return np.unique(every, return_counts=True)


def ranked(codes: np.ndarray, counts: np.ndarray, most: int = PROFILE) -> np.ndarray:
    """The most frequent codes, largest count first, then smallest code."""
    if len(codes) > most:
        least = np.partition(counts, len(counts) - most)[len(counts) - most]
        keep = counts >= least
        codes, counts = codes[keep], counts[keep]
    return codes[np.lexsort((codes, -counts))][:most]


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def fit(labelled: DataFrame, sample: int = SAMPLE, most: int = PROFILE) -> dict[str, list[int]]:
    """Profiles of the languages in `labelled` (doc_id, text, lang): their `most` most frequent n-grams, in order.

    Counts are made on about `sample` documents a language, chosen by a seeded hash, and summed by Spark; rows with a null lang or text
    teach nothing. The model, `most` numbers a language, is all that reaches the driver.
    """
    known = labelled.filter("lang IS NOT NULL AND text IS NOT NULL")
    sizes = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(MOST_LANGUAGES).collect()}
    if not sizes:
        return {}
    share = F.element_at(F.create_map(*[F.lit(x) for lang, n in sizes.items() for x in (lang, min(1.0, sample / n))]), F.col("lang"))
    drawn = known.filter(F.pmod(F.xxhash64(F.lit("profile"), "doc_id"), F.lit(1_000_000)) < share * 1_000_000).select("lang", "text")
    schema = pa.schema([("lang", pa.string()), ("gram", pa.int64()), ("n", pa.int64())])

    def count(rows: dict[str, list]) -> dict[str, list]:
        by: dict[str, list] = {}
        for lang, text in zip(rows["lang"], rows["text"], strict=True):
            by.setdefault(lang, []).append(text)
        out: dict[str, list] = {"lang": [], "gram": [], "n": []}
        for lang, texts in by.items():
            codes, counts = grams("\n".join(texts))
            out["lang"] += [lang] * len(codes)
            out["gram"] += codes.tolist()
            out["n"] += counts.tolist()
        return out

    counted = in_arrow(drawn, "lang string, gram long, n long", count, schema).groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    first = counted.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))).filter(F.col("r") <= most)
    model: dict[str, list] = {}
    for r in first.collect():  # at most `most` rows a language
        model.setdefault(r["lang"], []).append((r["r"], r["gram"]))
    return {lang: [g for _, g in sorted(v)] for lang, v in sorted(model.items())}


def distances(text: str, table: np.ndarray, places: np.ndarray, most: int = PROFILE) -> np.ndarray:
    """Out-of-place distances of a text to all profiles, as a share of the largest possible one.

    `table` has the sorted codes of all profiles, `places` their rank in each language (`most`: absent). A code absent from a profile
    costs `most`, one that is there the difference of ranks.
    """
    own = ranked(*grams(text), most)
    at = np.minimum(np.searchsorted(table, own), len(table) - 1)
    rank = np.where((table[at] == own)[:, None], places[at], most)
    cost = np.where(rank == most, most, np.abs(rank - np.arange(len(own))[:, None]))
    return cost.sum(axis=0) / (most * max(1, len(own)))


def arrays(model: dict[str, list[int]], most: int = PROFILE) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Languages, the sorted codes of all profiles, and the rank of each code in each language."""
    names = sorted(model)
    table = np.unique(np.concatenate([np.asarray(model[x], dtype=np.int64) for x in names])) if names else np.empty(0, np.int64)
    places = np.full((len(table), len(names)), most)
    for k, x in enumerate(names):
        places[np.searchsorted(table, model[x]), k] = np.arange(len(model[x]))
    return names, table, places


def predicted(text: str | None, names: list[str], table: np.ndarray, places: np.ndarray, most: int = PROFILE) -> tuple[str, float, float]:
    """Language, score and distance of one text."""
    if not len(table) or not has_letter(text):
        return "und", 0.0, 1.0
    d = distances(text, table, places, most)
    best = int(np.argmin(d))
    far = float(d[best])
    other = float(np.partition(d, 1)[1]) if len(d) > 1 else 1.0
    return names[best], 1 - far / other if other > 0 else 0.0, far


def accepted(docs: DataFrame, model: dict[str, list[int]], most: int = PROFILE, far: float = FAR) -> DataFrame:
    """The rows of docs, with all their columns, whose text has a letter and is within `far` of some language. Without a model: those with a letter."""
    names, table, places = arrays(model, most)

    def run(batches):
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("text"))
            keep = [has_letter(x) if not names else predicted(x, names, table, places, most)[2] <= far and has_letter(x) for x in (t.as_py() for t in texts)]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def identify(docs: DataFrame, model: dict[str, list[int]], most: int = PROFILE) -> DataFrame:
    """doc_id, lang_pred, score and distance (to the predicted language) of every whole text, from the text alone.

    und with score 0 and distance 1 where the text is null or has no letter, or where nothing has been learned. Ties go to the first
    language by code point. score is 1 less the ratio of the smallest distance to the second smallest (of one language: 1 less distance).
    """
    names, table, places = arrays(model, most)
    schema = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64()), ("distance", pa.float64())])

    def work(rows: dict[str, list]) -> dict[str, list]:
        out: dict[str, list] = {k: [] for k in schema.names}
        for doc_id, text in zip(rows["doc_id"], rows["text"], strict=True):
            for k, v in zip(schema.names, (doc_id, *predicted(text, names, table, places, most)), strict=True):
                out[k].append(v)
        return out

    return in_arrow(docs.select("doc_id", "text"), "doc_id long, lang_pred string, score double, distance double", work, schema)


def held_out():
    """crc32 of the id as text, mod 4, is 2; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 4 == 2


def op6_language_id(docs: DataFrame) -> DataFrame:
    """One row a row of docs, repeated ones too. und for null texts and those without a letter; ties go to the first language by code point;
    null languages teach nothing; a null id is hashed as the empty text; an empty table gives none; other columns are not read."""
    model = fit(docs.filter(~held_out()))
    return identify(docs, model).withColumn("held_out", held_out())
