import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, fp long, seg long, copies int, kept string, __row long"


def odd_rows():
    """Small documents with every awkward case: nulls in every column, empty, blank, long and repeated texts, ties, repeated rows."""
    rng = random.Random(4)
    word = lambda: "".join(rng.choice(["an", "the", "or", "ti", "on", "es", "ß", "é"]) for _ in range(rng.randint(1, 4)))
    prose = lambda n: " ".join(word() for _ in range(n))
    shared = prose(80)
    texts = [prose(120) for _ in range(12)]
    texts += [texts[0], texts[0].replace(texts[0].split()[60], "changed"), f"{prose(30)} {shared} {prose(20)}", f"{shared}\n{prose(40)}", f"{prose(5)}\n{shared}"]
    texts += ["", " \t\n", None, "one", "one two", "One TWO", "a\x00b c\x0bd e f", "Licensed under CC BY-NC 4.0.", "x " * 300, "same line\n" * 40, "é" * 250, "12345 67890 !!!"]
    texts += [prose(30_000), "<|endoftext|> Hi <|startoftext|>", "This work is licensed under the GNU General Public License, version 3."]
    rows = [(i, t, ["en", "de", None][i % 3], ["s1", "s2", "s3", None][i % 4] if i % 5 else "s1", None if i % 7 == 0 else len(t or ""), 9, 9, 9, 9, "k", 9) for i, t in enumerate(texts)]
    rows += [rows[3], rows[3], (None, texts[1], None, None, None, None, None, None, None, None, None), (None, None, None, None, None, None, None, None, None, None, None)]
    rng.shuffle(rows)
    return rows


@pytest.fixture(scope="session")
def rows():
    return odd_rows()


@pytest.fixture(scope="session")
def odd(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
