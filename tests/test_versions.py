"""Ordered line diffs against the standard library's."""

import difflib
import random

import pytest
from verimill.functions.linediff import hunks
from verimill.operators import versions


def expected(a, b):
    x, y = a.splitlines(keepends=True), b.splitlines(keepends=True)
    codes = difflib.SequenceMatcher(None, x, y).get_opcodes()
    added = sum(j2 - j1 for tag, _, _, j1, j2 in codes if tag in ("insert", "replace"))
    removed = sum(i2 - i1 for tag, i1, i2, _, _ in codes if tag in ("delete", "replace"))
    return added, removed, [s if s.endswith("\n") else s + "\n" for s in difflib.unified_diff(x, y, "v1", "v2", lineterm="\n", n=3)]


def pairs():
    rng = random.Random(8)
    out = [("", ""), ("", "a"), ("a\n", ""), ("a\nb\nc\n", "b\nc\na\n"), ("a", "a\n"), ("same\n" * 300, "same\n" * 250 + "x\n" + "same\n" * 50)]
    for _ in range(150):
        n, words = rng.randrange(1, 40), rng.choice([2, 5, 60])
        a = [f"w{rng.randrange(words)}" for _ in range(n * rng.choice([1, 1, 12]))]
        b = list(a)
        for _ in range(rng.randrange(6)):
            at = rng.randrange(len(b) + 1)
            if rng.random() < 0.4:
                b[at:at] = [f"new{rng.randrange(9)}"]
            elif rng.random() < 0.5:
                del b[at : at + rng.randrange(4)]
            else:
                moved = b[at : at + 3]
                del b[at : at + 3]
                b += moved
        out.append(("\n".join(a), "\n".join(b) + rng.choice(["", "\n"])))
    return out


def test_changes_and_hunks(spark):
    cases = pairs()
    df = spark.createDataFrame([(i, 2, a, b) for i, (a, b) in enumerate(cases)] + [(900, 2, None, "a\n")], "document_id long, version long, previous string, content_snapshot string")
    from pyspark.sql import functions as F

    rows = versions.line_diffs(df).withColumn("diff", versions.unified(F.lit("v1"), F.lit("v2"))).collect()
    assert len(rows) == len(cases) + 1
    for r in rows:
        a, b = cases[r.document_id] if r.document_id < 900 else ("", "a\n")
        added, removed, diff = expected(a, b)
        assert (r.added, r.removed) == (added, removed), (a, b)
        assert r.diff == "".join(diff)


@pytest.mark.parametrize("moved", [1, 3])
def test_a_moved_line_counts_on_both_sides(moved):
    lines = [f"{i}\n" for i in range(20)]
    assert hunks("".join(lines), "".join(lines[moved:] + lines[:moved]))[:2] == (moved, moved)
