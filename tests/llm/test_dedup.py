"""Substring dedup, suffix-array dedup, SimHash, and the pipeline."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
from verimill.llm import segments, simhash, substring_dedup, suffix_dedup

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_windows(rows, k=13):
    first = {}
    words = [WORD.findall(r[1] or "") for r in rows]
    for r, w in zip(rows, words, strict=True):
        if r[0] is not None:
            for i in range(len(w) - k + 1):
                g = tuple(w[i : i + k])
                first[g] = min(first.get(g, r[0]), r[0])
    out = []
    for r, w in zip(rows, words, strict=True):
        gone = [False] * len(w)
        for i in range(len(w) - k + 1):
            if r[0] is not None and first[tuple(w[i : i + k])] < r[0]:
                gone[i : i + k] = [True] * k
        out.append((r[0], len(w), sum(gone), hashlib.sha256(" ".join(x for x, g in zip(w, gone, strict=True) if not g).encode()).hexdigest()))
    return Counter(out)


def test_substring_dedup(odd, rows, monkeypatch):
    want = brute_windows(rows)
    assert sum(k[2] > 0 for k in want) > 3
    assert Counter(map(tuple, substring_dedup.op2_substring_dedup(odd).collect())) == want
    monkeypatch.setattr(substring_dedup, "SEGMENT_BYTES", 1500)
    monkeypatch.setattr(substring_dedup, "BUCKET_BYTES", 20_000)
    monkeypatch.setattr(substring_dedup, "RANGE_BYTES", 20_000)
    monkeypatch.setattr(substring_dedup, "BATCH_BYTES", 50_000)
    assert Counter(map(tuple, substring_dedup.op2_substring_dedup(odd).collect())) == want


def test_substring_dedup_texts(odd, rows):
    kept = {r.doc_id: r.kept for r in substring_dedup.dedup(odd).collect() if r.doc_id is not None}
    assert kept[0] == " ".join(WORD.findall(next(r[1] for r in rows if r[0] == 0)))


def thue_morse(n, flip=False):
    return "".join("ab"[(i.bit_count() + flip) % 2] for i in range(1 << n))


def test_words_that_polynomial_hashes_confuse(spark):
    """Thue-Morse words and their complements have equal polynomial hashes modulo 2^64; they are different words all the same."""
    for n in (10, 11, 12):
        lead = " ".join(f"w{i}" for i in range(12))
        rows = [(1, f"{lead} {thue_morse(n)}"), (2, f"{lead} {thue_morse(n, True)}"), (3, f"{lead} {thue_morse(n)}")]
        got = {r.doc_id: r.n_removed for r in substring_dedup.op2_substring_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
        assert got == {1: 0, 2: 0, 3: 13}


def test_clashing_hashes_are_told_apart(spark):
    """With a hash of 6 bits everything clashes; digests and settled ids give the right answer all the same."""
    rng = random.Random(5)
    words = [f"w{i}" for i in range(30)]
    texts = [" ".join(rng.choice(words) for _ in range(40)) for _ in range(9)]
    texts[4] = texts[4] + " " + texts[1]
    texts[7] = texts[2]
    rows = list(enumerate(texts))
    got = substring_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string"), digest=True, hash_bits=6)
    assert Counter(map(tuple, got.collect())) == brute_windows(rows)


def test_a_kept_index_is_opened_and_extended(spark, tmp_path):
    """Three calls, each on an index opened anew, give what one call on everything gives; ids that go back are refused."""
    rng = random.Random(6)
    shared = [" ".join(f"s{rng.randrange(999)}" for _ in range(20)) for _ in range(6)]
    rows = [(i, " ".join([*(f"t{rng.randrange(9999)}" for _ in range(15)), rng.choice(shared), rng.choice(shared)])) for i in range(60)]
    want = brute_windows(rows)
    folder = str(tmp_path / "index")
    substring_dedup.Index.create(spark, folder, 200_000).save()
    got = Counter()
    for part in (rows[:20], rows[20:40], rows[40:]):
        index = substring_dedup.Index.open(spark, folder)
        got += Counter(map(tuple, substring_dedup.dedup(spark.createDataFrame(part, "doc_id long, text string"), digest=True, index=index).collect()))
    assert got == want
    index = substring_dedup.Index.open(spark, folder)
    assert sorted(level for level, _ in index.runs) == [0, 1]
    with pytest.raises(ValueError):
        substring_dedup.dedup(spark.createDataFrame(rows[:2], "doc_id long, text string"), index=index)


def test_squeeze():
    for values in ([], [0], [5, 5, 9], [2**64 - 1], sorted(random.Random(1).randrange(2**64) for _ in range(1000))):
        a = np.array(values, np.uint64)
        assert (substring_dedup.unsqueeze(substring_dedup.squeeze(a)) == a).all() if len(a) else True


def brute_bytes(texts, n=200):
    count = Counter(t[i : i + n] for t in texts for i in range(len(t) - n + 1))
    out = []
    for t in texts:
        gone = np.zeros(len(t) + 1, int)
        for i in range(len(t) - n + 1):
            if count[t[i : i + n]] > 1:
                gone[i] += 1
                gone[i + n] -= 1
        out.append(np.cumsum(gone[:-1]) > 0)
    return out


def brute_removed(rows):
    short = [r for r in rows if len(r[1] or "") < 50_000]
    texts = [(r[1] or "").encode() for r in rows]
    gone = brute_bytes([t for t, r in zip(texts, rows, strict=True) if r in short or len(t) < 60_000])
    gone = dict(zip([i for i, (t, r) in enumerate(zip(texts, rows, strict=True)) if r in short or len(t) < 60_000], gone, strict=True))
    out = []
    for i, (r, t) in enumerate(zip(rows, texts, strict=True)):
        if i in gone:
            g = gone[i]
            spans = int((g[1:] & ~g[:-1]).sum() + (len(g) > 0 and g[0]))
            out.append((r[0], len(t), int(g.sum()), spans, hashlib.sha256(bytes(np.frombuffer(t, np.uint8)[~g])).hexdigest()))
    return Counter(out)


def test_suffix_dedup(odd, rows):
    got = Counter(map(tuple, suffix_dedup.op7_suffix_dedup(odd).collect()))
    want = brute_removed(rows)
    assert sum(want.values()) >= len(rows) - 1
    assert not want - got
    assert sum(got.values()) == len(rows)


def test_suffix_dedup_in_many_segments_and_buckets(odd, rows, monkeypatch):
    monkeypatch.setattr(segments.segments, "__defaults__", (1500, 0))
    monkeypatch.setattr(suffix_dedup, "BUCKET_SUFFIXES", 20)
    got = Counter(map(tuple, suffix_dedup.op7_suffix_dedup(odd).collect()))
    assert not brute_removed(rows) - got


@pytest.mark.parametrize("hot", [1, 3])
def test_suffix_dedup_of_grams_dealt_by_strings(odd, rows, spark, monkeypatch, hot):
    """Passages that many documents share in different surroundings, at a bound that makes their grams hot."""
    monkeypatch.setattr(segments.segments, "__defaults__", (1500, 0))
    monkeypatch.setattr(suffix_dedup, "HOT_GRAM", hot)
    monkeypatch.setattr(suffix_dedup, "HOT_CONTEXTS", 7)
    got = Counter(map(tuple, suffix_dedup.op7_suffix_dedup(odd).collect()))
    assert not brute_removed(rows) - got and sum(got.values()) == len(rows)
    rng = random.Random(hot)
    word = lambda n: "".join(rng.choice("abcd ") for _ in range(n))
    shared, other = word(330), word(199)
    more = [(i, word(rng.randint(0, 150)) + shared[rng.randint(0, 140) :] + word(rng.randint(0, 9)) + (other if i % 3 else "") + word(rng.randint(0, 150))) for i in range(60)]
    got = Counter(map(tuple, suffix_dedup.op7_suffix_dedup(spark.createDataFrame(more, "doc_id long, text string")).collect()))
    assert got == brute_removed(more) and any(r[2] for r in got)


@pytest.mark.parametrize("alphabet", [b"ab", b"abcdefghijklmnop", b"\0a"])
def test_reach_against_brute_force(alphabet):
    rng = random.Random(len(alphabet))
    for _ in range(8):
        base = [bytes(rng.choice(alphabet) for _ in range(rng.randint(0, 700))) for _ in range(5)]
        texts = []
        for _ in range(10):
            t = b""
            for _ in range(rng.randint(1, 3)):
                x = rng.choice(base)
                a = rng.randint(0, len(x))
                t += x[a : a + rng.randint(100, 400)] + bytes(rng.choice(alphabet) for _ in range(rng.randint(0, 40)))
            texts.append(t)
        s = segments.Segment(0, list(range(10)), np.cumsum([len(x) for x in texts]), b"".join(texts))
        at, _ = suffix_dedup.anchors(s)
        if not len(at):
            continue
        doc = np.searchsorted(s.ends, at, side="right")
        found = {}
        for p, d in zip(at.tolist(), doc.tolist(), strict=True):
            found.setdefault((s.data[max(p - 100, s.starts[d]) : p], s.data[p : min(p + 200, s.ends[d])]), []).append(p)
        before, behind = suffix_dedup.reach([a for a, _ in found], [b for _, b in found], np.array([len(v) for v in found.values()]))
        spans = [{"places": np.array(v, "<i4").tobytes(), "before": int(x), "behind": int(y)} for v, x, y in zip(found.values(), before, behind, strict=True) if y]
        assert (suffix_dedup.covered(s, spans) == np.concatenate(brute_bytes(texts))).all()


def test_remove_repeats_leaves_valid_texts(odd):
    out = {r.doc_id: r.text for r in suffix_dedup.remove_repeats(odd).collect()}
    assert all(isinstance(t, str) for t in out.values())


def brute_fingerprint(text):
    import xxhash

    w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    h = [xxhash.xxh64(" ".join(w[i : i + 3]).encode(), seed=42).intdigest() for i in range(max(1, len(w) - 2))] if w else []
    return sum(1 << k for k in range(64) if sum(x >> k & 1 for x in h) * 2 > len(h))


def test_simhash(odd, rows):
    got = simhash.op8_simhash(odd).collect()
    fps = [brute_fingerprint(r[1]) for r in rows]
    assert Counter((r.doc_id, r.fingerprint) for r in got) == Counter((r[0], f"{f:016x}") for r, f in zip(rows, fps, strict=True))
    label = list(range(len(rows)))
    for _ in range(len(rows)):
        for i in range(len(rows)):
            for j in range(len(rows)):
                if (fps[i] ^ fps[j]).bit_count() <= 3:
                    label[i] = label[j] = min(label[i], label[j])
    least = {}
    for r, x in zip(rows, label, strict=True):
        if r[0] is not None:
            least[x] = min(least.get(x, r[0]), r[0])
    assert Counter((r.doc_id, r.component_id) for r in got) == Counter((r[0], least.get(x)) for r, x in zip(rows, label, strict=True))


def test_link_against_all_pairs():
    rng = np.random.default_rng(5)
    for trial in range(9):
        n = int(rng.integers(1, 400))
        base = rng.integers(0, 1 << 63, max(1, n // 6), dtype=np.uint64)
        f = base[rng.integers(0, len(base), n)].copy()
        for i in range(n):
            for _ in range(int(rng.integers(0, 5))):
                f[i] ^= np.uint64(1) << np.uint64(rng.integers(0, 64))
        b = np.sort(rng.integers(0, [1, 3, n][trial % 3], n))
        for radius in (2, 3, 7):
            i, j = simhash.link(b, f, radius)
            label = np.arange(n)
            label[i] = j
            x, y = np.nonzero((np.bitwise_count(f[:, None] ^ f[None, :]) <= radius) & (b[:, None] == b[None, :]))
            assert (simhash.unite(np.arange(n), x, y) == label).all()


@pytest.mark.parametrize("limit", [4096, 20])
@pytest.mark.parametrize("radius,blocks", [(3, 4), (7, 9)])
def test_components_against_all_pairs(spark, monkeypatch, limit, radius, blocks):
    monkeypatch.setattr(simhash, "BLOCK_LIMIT", limit)
    rng = np.random.default_rng(radius)
    base = rng.integers(0, 1 << 63, 80, dtype=np.uint64)
    f = base[rng.integers(0, 80, 400)].copy()
    for i in range(400):
        for _ in range(int(rng.integers(0, 9))):
            f[i] ^= np.uint64(1) << np.uint64(rng.integers(0, 64))
    f[:120] &= ~np.uint64(0xFFFFFF)
    own = spark.createDataFrame([(i, int(v), 0) for i, v in enumerate(f.view(np.int64))], "doc_id long, fp long, more long")
    got = dict(simhash.components_of(own, radius, blocks).select("doc_id", "component_id").collect())
    x, y = np.nonzero(np.bitwise_count(f[:, None] ^ f[None, :]) <= radius)
    label = simhash.unite(np.arange(400), x, y)
    assert [got[i] for i in range(400)] == label.tolist()


def test_near_copies(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(2, 9)))
    clean = [[word() for _ in range(200)] for _ in range(40)]
    near = [[word() if k in (50, 120) else w for k, w in enumerate(t)] for t in clean[:10]]
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(clean + near)], "doc_id long, text string")
    got = dict(simhash.near_copies(docs).select("doc_id", "component_id").collect())
    assert all(got[i] == i for i in range(40))
    assert sum(got[40 + i] == i for i in range(10)) >= 9


def jaccard(a, b):
    sets = []
    for t in (a, b):
        w = t.lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    return len(sets[0] & sets[1]) / max(1, len(sets[0] | sets[1])) if any(sets) else 1.0


def test_near_copies_against_all_pairs(spark):
    """Groups are those that pairs with a shingle similarity of 0.8 or more form: none is missed and none is made of less similar texts."""
    rng = random.Random(9)
    common = [f"w{i}" for i in range(60)]
    texts = []
    for g in range(40):
        n = rng.choice([3, 5, 12, 60, 150, 400])
        base = [rng.choice(common) for _ in range(n)]
        texts.append(base)
        for _ in range(6):
            w = list(base)
            for _ in range(rng.randint(0, max(1, n // 25))):
                w[rng.randrange(n)] = rng.choice(common)
            texts.append(w[: n - rng.randint(0, n // 8)])
    texts = [" ".join(t) for t in texts] + ["", "  "]
    near = [(i, j) for i in range(len(texts)) for j in range(i) if jaccard(texts[i], texts[j]) >= 0.8]
    assert len(near) > 100
    label = simhash.unite(np.arange(len(texts)), *np.array(near).T)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = dict(simhash.near_copies(docs).select("doc_id", "component_id").collect())
    assert [got[i] for i in range(len(texts))] == label.tolist()


@pytest.mark.parametrize("tile_bytes", [16_000_000, 20_000])
def test_a_large_group_of_near_copies_against_all_pairs(spark, monkeypatch, tile_bytes):
    """Copies of one text, of which some pairs reach 0.8 and some don't: what no star joins is compared in tiles."""
    monkeypatch.setattr(simhash, "TILE_BYTES", tile_bytes)
    rng = random.Random(10)
    base = [f"w{rng.randrange(500)}" for _ in range(150)]
    texts = []
    for _ in range(300):
        w = list(base)
        for _ in range(rng.randint(1, 5)):
            w[rng.randrange(150)] = f"x{rng.randrange(99999)}"
        texts.append(" ".join(w))
    near = [(i, j) for i in range(len(texts)) for j in range(i) if jaccard(texts[i], texts[j]) >= 0.8]
    assert 0.1 < len(near) / (300 * 299 / 2) < 0.6
    label = simhash.unite(np.arange(len(texts)), *np.array(near).T)
    assert len(set(label.tolist())) > 3
    got = dict(simhash.near_copies(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).select("doc_id", "component_id").collect())
    assert [got[i] for i in range(len(texts))] == label.tolist()


def test_near_dedup_stage_against_all_pairs(spark):
    """Repeated ids, null ids and repeated rows: rows are what is kept or dropped, one of each group."""
    import corpus_pipeline as p

    rng = random.Random(12)
    prose = lambda n: [f"w{rng.randrange(9999)}" for _ in range(n)]
    t, u, v = prose(120), prose(120), prose(120)
    near = [*t[:60], "changed", *t[61:]]
    rows = [(3, t), (5, t), (5, u), (None, near), (None, v), (None, v), (5, u), (7, near), (9, None), (8, None), (None, None), (2, []), (11, prose(3))]
    docs = spark.createDataFrame([(i, None if x is None else " ".join(x), "en", "s", 1) for i, x in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = Counter((r.doc_id, r.text) for r in p.near_dedup_stage(spark, docs, "").collect())
    assert got == Counter([(3, " ".join(t)), (5, " ".join(u)), (None, " ".join(v)), (2, ""), (11, " ".join(rows[-1][1]))])


@pytest.mark.parametrize("op", [substring_dedup.op2_substring_dedup, suffix_dedup.op7_suffix_dedup, simhash.op8_simhash])
def test_empty(op, empty):
    assert op(empty).collect() == []


def test_pipeline(odd, empty, rows):
    import corpus_pipeline as p

    docs, spark = odd, odd.sparkSession
    counts = [docs.count()]
    for k, (name, stage) in enumerate(p.STAGES):
        out = p.cut(stage(spark, docs, ""), name)
        if k < len(p.STAGES) - 1:
            assert out.columns == docs.columns
        counts.append(out.count())
        docs = out
    assert counts[1] < counts[0] and counts[2] < counts[1] and counts[3] == counts[2]
    assert all(r.n_tokens * 4 == len(r.ids) for r in docs.collect())
    again = empty
    for _, stage in p.STAGES:
        again = stage(spark, again, "")
    assert again.collect() == []
