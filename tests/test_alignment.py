"""Aligned plans: the longest order-keeping sequence against all of them, and what an edit costs."""

import itertools
import random

import pytest
from verimill.operators import versions as vs

CHUNK = "document_id long, chunk_index long, chunk_hash string"


@pytest.mark.parametrize("seed", range(30))
def test_longest_rising(seed):
    rng = random.Random(seed)
    starts = rng.sample(range(20), rng.randrange(8))
    runs = [(s, k, rng.randrange(1, 4)) for k, s in enumerate(starts)]
    kept = vs.longest_rising(runs)
    rising = lambda c: all(x < y for x, y in itertools.pairwise([runs[i][0] for i in c]))
    most = max(sum(runs[i][2] for i in c) for n in range(len(runs) + 1) for c in itertools.combinations(range(len(runs)), n) if rising(c))
    assert rising(kept) and kept == sorted(kept) and sum(runs[i][2] for i in kept) == most


def test_edits(spark):
    base = [f"h{i}" for i in range(200)]
    cases = {
        1: (base, ["fresh", *base]),
        2: (base, base[:70] + ["other"] + base[71:]),
        3: (base, base[:50] + base[60:]),
        4: (base, base[:20] + base[30:100] + base[20:30] + base[100:]),
        5: (["x", "x", "a"], ["x", "a", "x", "x"]),
        6: ([], ["a", None]),
        7: (["a", None], []),
        8: (base, base[::-1]),
    }
    rows = lambda k: [(d, i, h) for d, c in cases.items() for i, h in enumerate(c[k])]
    out = vs.aligned_plan(spark.createDataFrame(rows(0), CHUNK), spark.createDataFrame(rows(1), CHUNK)).collect()
    count = lambda d: {a: n for a in ("unchanged", "moved", "changed", "new", "removed") if (n := sum(r.document_id == d and r.action == a for r in out))}
    assert count(1) == {"unchanged": 200, "new": 1} and count(2) == {"unchanged": 199, "changed": 1}
    assert count(3) == {"unchanged": 190, "removed": 10} and count(4) == {"unchanged": 190, "moved": 10}
    assert count(5) == {"unchanged": 2, "moved": 1, "new": 1} and count(6) == {"new": 2} and count(7) == {"removed": 2}
    assert count(8) == {"unchanged": 1, "moved": 199}
    assert sum(r.embed for r in out if r.document_id in (1, 2)) == 2 and not any(r.embed for r in out if r.document_id in (3, 4, 5, 7, 8))
    for d, (old, new) in cases.items():
        mine = [r for r in out if r.document_id == d]
        assert sorted(r.chunk_index for r in mine if r.chunk_index is not None) == list(range(len(new)))
        assert sorted(r.old_index for r in mine if r.old_index is not None) == list(range(len(old)))
        assert all(old[r.old_index] == new[r.chunk_index] for r in mine if r.action in ("unchanged", "moved"))
