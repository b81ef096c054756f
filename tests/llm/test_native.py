"""Mixing, quality rules, sharding."""

import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from verimill.llm import mixing, quality_rules, sharding

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def targets(sizes):
    names = sorted([s for s in sizes if s is not None]) + [None] * (None in sizes)
    weight = {s: 1 + i % 3 for i, s in enumerate(names)}
    total, capped = sum(sizes.values()), set()
    while True:
        free = [s for s in names if s not in capped]
        left = total - sum(3 * sizes[s] for s in capped)
        out = {s: left * weight[s] / sum(weight[x] for x in free) for s in free} | {s: 3 * sizes[s] for s in capped}
        more = {s for s in free if out[s] > 3 * sizes[s]}
        if not more:
            return out
        capped |= more


def test_mixing_targets_and_copies(odd, rows):
    got = mixing.op1_mixing(odd).collect()
    sizes = defaultdict(int)
    for r in rows:
        sizes[r[3]] += len(WORD.findall(r[1] or ""))
    want = targets(dict(sizes))
    by = {}
    for r, s in {(r[0], r[3]) for r in rows}:
        by.setdefault(r, set()).add(s)
    assert len(got) == len(rows)
    for r in got:
        if r.size:
            assert r.taken % r.size == 0
        assert r.taken <= 3 * r.size
        s = next(x for x in by[r.doc_id] if abs(want[x] - r.target) < 1e-6)
        assert sizes[s] == r.source_size
        assert int(r.target / r.source_size) * r.size <= r.taken <= (int(r.target / r.source_size) + 1) * r.size
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, mixing.op1_mixing(odd.repartition(5)).collect()), key=str)


def test_mixing_comes_near_its_targets(spark):
    """Long-tailed sizes: every source with 20 documents or more is within 5 % of its target, at a small scale too."""
    rng = random.Random(2)
    rows = [(i, " ".join(["w"] * min(500, int(rng.paretovariate(1.1) * 20))), f"s{rng.randrange(30)}") for i in range(1500)]
    got = mixing.op1_mixing(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    by, want = defaultdict(int), {}
    for r in got:
        by[rows[r.doc_id][2]] += r.taken
        want[rows[r.doc_id][2]] = r.target
    assert all(abs(by[s] / want[s] - 1) < 0.05 for s in want)


def test_mixing_probabilities(spark):
    """Over many seeds a document's extra copies come to the fraction of its source's rate."""
    rows = [(i, "w " * n, s) for i, (n, s) in enumerate([(n, s) for s in "ab" for n in (5, 9, 30, 31, 200, 900)])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").coalesce(1).cache()
    tries, extra, rate = 12, Counter(), {}
    for k in range(tries):
        stats = mixing.sized(docs, f"seed {k}").cache()
        for r in mixing.mix_plan(stats, stats, f"seed {k}").collect():
            extra[r.doc_id] += r.copies - int(r.target / r.source_size)
            rate[r.doc_id] = r.target / r.source_size % 1
    assert all(abs(extra[i] / tries - rate[i]) < 4 * (rate[i] * (1 - rate[i]) / tries) ** 0.5 + 0.1 for i in rate)


def test_mix_emits_whole_rows(odd):
    out = mixing.mix(odd)
    assert out.columns == odd.columns
    want = Counter({i: n for i, n in ((r.doc_id, r.taken // r.size) for r in mixing.op1_mixing(odd).collect() if r.size and r.doc_id not in (3, None))})
    got = Counter(r.doc_id for r in out.collect())
    assert all(got[i] == n for i, n in want.items())


def test_mixing_water_filling(spark):
    sizes = spark.createDataFrame([("a", 10), ("b", 1), ("c", 1), ("d", 300), (None, 5)], "source string, size long")
    got = {r.source: r.target for r in mixing.source_targets(sizes).collect()}
    want = targets({"a": 10, "b": 1, "c": 1, "d": 300, None: 5})
    assert got == pytest.approx(want)
    assert sum(got.values()) == pytest.approx(317)


def brute_features(t):
    w = WORD.findall(t or "")
    g = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    n = Counter(g)
    covered = {p for i, x in enumerate(g) if n[x] > 1 for p in (i, i + 1, i + 2)}
    lines = [x for x in (t or "").split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t or ""), len(lines) - len(set(lines)), len(covered)


def test_quality_counts(odd, rows):
    got = quality_rules.op3_quality_rules(odd).collect()
    want = Counter((r[0], *brute_features(r[1])) for r in rows)
    assert Counter(tuple(r)[:6] for r in got) == want
    for r in got:
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert not (r.base_failed and r.kept)


def test_quality_thresholds_follow_the_data(spark):
    plain = " ".join(f"word{i} of{i}" for i in range(60))
    noisy = " ".join(f"w{i}###" for i in range(120))
    docs = spark.createDataFrame([(i, f"{plain} {i}", "en", "s") for i in range(300)] + [(1000 + i, f"{noisy} {i}", "en", "s") for i in range(5)] + [(2000 + i, f"{noisy} {i}", "xx", "t") for i in range(300)], "doc_id long, text string, lang string, source string")
    kept = {r.doc_id: r.kept for r in quality_rules.op3_quality_rules(docs).collect()}
    assert all(kept[i] for i in range(300))
    assert not any(kept[1000 + i] for i in range(5))
    assert all(kept[2000 + i] for i in range(300))


def test_sharding(odd, rows):
    got = sharding.op10_sharding(odd).collect()
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == Counter((r[0], len((r[1] or "").encode()) + 1, zlib.crc32((r[1] or "").encode())) for r in rows)
    by = defaultdict(list)
    for r in got:
        by[r.shard].append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    sizes = [len(by[s]) for s in range(8)]
    assert max(sizes) - min(sizes) <= 1


def test_sharding_of_many_buckets_is_a_seeded_permutation(spark):
    df = spark.range(3000)
    place = lambda d: {r.id: r.slot * 5 + r.shard for r in d.collect()}
    a = place(sharding.shard(df, 5, 1, 200))
    assert sorted(a.values()) == list(range(3000))
    assert a == place(sharding.shard(df.repartition(7), 5, 1, 200))
    assert a != place(sharding.shard(df, 5, 2, 200))
    moved = sum(abs(a[i] - i) for i in a) / 3000
    assert 800 < moved < 1200  # a third of the length, for a random permutation


def test_sharding_writes_whole_documents_and_spreads_equal_rows(spark, monkeypatch):
    """Shards on disk hold the texts; a third of equal rows goes to many buckets, of which none is over its size by much."""
    made = []
    real = sharding.cut
    monkeypatch.setattr(sharding, "cut", lambda df, name, *by: made.append((name, real(df, name, *by))) or made[-1][1])
    monkeypatch.setattr(sharding.shard, "__defaults__", (8, sharding.SEED, 8192, 20_000))
    docs = spark.createDataFrame([(i, f"text {i} " * 40) for i in range(1000)] + [(-1, "same " * 60)] * 500, "doc_id long, text string")
    got = sharding.op10_sharding(docs).collect()
    assert Counter((r.doc_id, r.text_crc32) for r in got) == Counter((r.doc_id, zlib.crc32(r.text.encode())) for r in docs.collect())
    shards = dict(made)["shards"]
    assert Counter((r.doc_id, r.text) for r in shards.collect()) == Counter(map(tuple, docs.collect()))
    sizes = [r.b for r in dict(made)["scattered"].selectExpr("__bucket", "octet_length(__row.text) as n").groupBy("__bucket").agg({"n": "sum"}).toDF("k", "b").collect()]
    assert len(sizes) >= 20 and max(sizes) < 40_000
    place = lambda d: sorted((r.doc_id, r.shard, r.slot) for r in sharding.op10_sharding(d).collect())
    assert place(docs) == place(docs.repartition(7))


@pytest.mark.parametrize("op", [mixing.op1_mixing, quality_rules.op3_quality_rules, sharding.op10_sharding])
def test_empty(op, empty):
    assert op(empty).collect() == []
