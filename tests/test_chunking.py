"""Chunking against a brute-force version that goes part by part, and texts that are hard to cut."""

import random
import re

import pytest
from verimill.operators import chunking


def tokens(text):
    return len(re.findall(r"\w+|[^\w\s]", text))


def brute(text, size, overlap, separators=chunking.SEPARATORS):
    """Every chunk by trying how far each one goes, counting anew each time."""
    if tokens(text) <= size:
        return [text]
    held = [s for s in separators if s in text]
    if not held:
        return re.findall(rf"(?:\s*(?:\w+|[^\w\s])){{1,{size}}}", text)
    sep, deeper = held[0], separators[separators.index(held[0]) + 1 :]
    parts = [p for p in text.split(sep) if tokens(p)]
    weigh = lambda a, b: sum(map(tokens, parts[a:b]))
    out, begin, at = [], 0, 0
    while at < len(parts):
        if tokens(parts[at]) > size:
            out += [sep.join(parts[begin:at])] if begin < at else []
            out += brute(parts[at], size, overlap, deeper)
            begin = at = at + 1
            continue
        at += 1
        while at < len(parts) and weigh(begin, at + 1) <= size:
            at += 1
        out.append(sep.join(parts[begin:at]))
        begin = min(j for j in range(begin, at + 1) if weigh(j, at) <= overlap)
    return out


def texts():
    rng = random.Random(5)
    yield from ["", "   \n\n ", "one", "a" * 5000, ",".join("x" * 400), "word " * 3000, "no end. " * 50 + "\n\n" + "y " * 70 + "\n" + "z.z" * 90]
    for _ in range(120):
        words = [rng.choice(["w", "long-word", "x.y", "é", "7"]) + rng.choice([" ", " ", " ", ". ", "\n", "\n\n", "  ", ""]) for _ in range(rng.randint(1, 300))]
        yield "".join(words)


@pytest.mark.parametrize("size,overlap", [(20, 5), (7, 3), (50, 0), (9, 9)])
def test_split_equals_brute_force(spark, size, overlap):
    given = list(texts())
    docs = spark.createDataFrame([*enumerate(given), (-1, None)], "document_id long, text string")
    got = {(r.document_id, r.chunk_index): (r.chunk_text, r.tokens) for r in chunking.split_documents(docs, size, overlap).collect()}
    want = {(d, i): (c.strip(), tokens(c)) for d, t in enumerate(given) for i, c in enumerate(brute(t, size, overlap)) if c.strip()}
    assert got == want


def test_a_chunk_of_overlap_alone_precedes_a_long_part(spark):
    docs = spark.createDataFrame([(1, "a a a\n\nb b\n\n" + "c " * 6)], "document_id long, text string")
    got = [r.chunk_text for r in chunking.split_documents(docs, 5, 2).orderBy("chunk_index").collect()]
    assert got == ["a a a\n\nb b", "b b", "c c c c c", "c c c"]


def test_no_documents(spark):
    docs = spark.createDataFrame([], "document_id long, text string")
    assert chunking.split_documents(docs).count() == chunking.chunk_documents(docs).count() == 0


def test_a_very_long_text_takes_linear_time(spark):
    import time

    def seconds(n):
        docs = spark.createDataFrame([(1, "Some words of a sentence. " * n)], "document_id long, text string")
        begun = time.monotonic()
        assert chunking.split_documents(docs, 50, 10).count() > n / 10
        return time.monotonic() - begun

    seconds(100)
    assert seconds(80_000) < 8 * max(seconds(20_000), 1)  # sixteen times as long, were it quadratic
