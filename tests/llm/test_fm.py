"""FM-index, decontamination and phrases, against brute force."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
from verimill.llm import decontamination, phrases
from verimill.llm.fm_index import Index, TwoWay

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def test_search_and_locate():
    rng = np.random.default_rng(1)
    for _ in range(100):
        n, sigma = rng.integers(1, 60), int(rng.integers(2, 6))
        x = np.r_[rng.integers(0, sigma, n), 0]
        index = Index(x, sigma, None, sampled=3)
        for length in (1, 2, 3, 5):
            phrases = rng.integers(1, sigma, (20, length))
            for p, a, b in zip(phrases, *index.search(phrases, np.full(20, length)), strict=True):
                want = [i for i in range(len(x) - length + 1) if (x[i : i + length] == p).all()]
                assert sorted(index.locate(np.arange(a, b))) == want


def test_long_repeats_are_sorted():
    for x in ([1] * 3000 + [0], ([1, 2, 3] * 500 + [0]) * 3, [0, 0, 0], [0]):
        x = np.array(x)
        order = Index(x, 4, None, 7)
        a, b = order.search(np.array([[1, 1]]), np.array([2]))
        want = [i for i in range(len(x) - 1) if x[i] == x[i + 1] == 1]
        assert sorted(order.locate(np.arange(a[0], b[0]))) == want


def test_extension_at_both_ends():
    rng = np.random.default_rng(2)
    for _ in range(60):
        sigma = int(rng.integers(2, 6))
        x = np.r_[rng.integers(0, sigma, rng.integers(1, 60)), 0]
        both = TwoWay(x, sigma, 4)
        word, low, high = both.words()
        phrases, got = word[:, None], Counter()
        for right in (None, True, False, True):
            if right is not None:
                owner, word, low, high = both.extend(low, high, right)
                phrases = np.concatenate([phrases[owner], word[:, None]] if right else [word[:, None], phrases[owner]], axis=1)
            assert ((high - low)[0] == (high - low)[1]).all()
            got.update({tuple(map(int, p)): int(n) for p, n in zip(phrases, (high - low)[0], strict=True)})
        assert got == Counter(tuple(map(int, x[i : i + k])) for k in (1, 2, 3, 4) for i in range(len(x) - k + 1) if (x[i : i + k] > 0).all())


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def contamination(docs, items, window=10):
    windows = {}
    for name, text in items:
        w = words(text)
        k = min(window, len(w))
        for i in range(len(w) - k + 1 if k else 0):
            windows.setdefault(tuple(w[i : i + k]), set()).add(name)
    sizes = {len(k) for k in windows}
    out = []
    for doc_id, text in docs:
        w = words(text)
        hit, names = set(), set()
        for i in range(len(w)):
            for k in sizes:
                if i + k <= len(w) and tuple(w[i : i + k]) in windows:
                    hit |= set(range(i, i + k))
                    names |= windows[tuple(w[i : i + k])]
        names = sorted(str(x) for x in names - {None})
        out.append((doc_id, len(w), len(hit), len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def test_decontamination(spark, odd, rows, empty):
    rng = random.Random(3)
    texts = [r[1] for r in rows if r[1]]
    items = []
    for k in range(40):
        w = words(rng.choice(texts))
        at, n = rng.randrange(max(1, len(w))), rng.choice([1, 5, 9, 10, 11, 30])
        items.append((k, " ".join(w[at : at + n])))
    items += [(99, "X"), (7, "one two"), (7, items[0][1]), (100, items[1][1]), (101, None), (102, " .\n"), (None, items[2][1]), (103, "é" * 250), (104, "x " * 40)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = contamination([(r[0], r[1]) for r in rows], items)
    got = decontamination.op13_decontamination(odd, bench).collect()
    assert sorted(map(tuple, got), key=str) == want
    assert sum(r.contaminated for r in got) > 10
    for block_words in (400,):  # several blocks
        found = decontamination.contamination(odd, bench, block_words=block_words)
        again = [(r.doc_id, r.n_words, sum(s.past - s.first for s in r.spans), len(r["items"])) for r in found.collect()]
        assert sorted(again, key=str) == [r[:4] for r in want]
    assert decontamination.op13_decontamination(empty, bench).count() == 0
    clean = decontamination.op13_decontamination(odd, bench.filter("item_id = 101")).collect()
    assert len(clean) == len(rows) and not any(r.n_hit or r.n_items for r in clean)


def test_spans_are_removed(spark):
    docs = spark.createDataFrame([(1, "Keep this, A b C d e f g h i j and That."), (2, "a b c"), (3, None)], "doc_id long, text string")
    bench = spark.createDataFrame([(1, "a b c d e f g h i j")], "item_id long, text string")
    got = {r.doc_id: (r.text, r.n_hit) for r in decontamination.removed(docs, bench).collect()}
    assert got == {1: ("keep this and that", 10), 2: ("a b c", 0), 3: (None, 0)}


def collocations(rows, least, most):
    counts, total = {}, Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(w)
            own = counts.setdefault(lang, Counter())
            for k in (1, 2, 3, 4):
                own.update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, own in counts.items():
        found = {p: a for p, a in own.items() if len(p) > 1 and a >= least}
        longer = Counter()
        for p, a in found.items():
            for sub in {p[i : i + m] for m in range(2, len(p)) for i in range(len(p) - m + 1)}:
                longer[sub] = max(longer[sub], a)
        kept = []
        for p, a in found.items():
            if 100 * longer[p] < 80 * a:
                score, k = min((2000000 * a // (own[p[:k]] + own[p[k:]]), k) for k in range(1, len(p)))
                kept.append((-score, -a, " ".join(p).encode(), own[p[:k]], own[p[k:]]))
        out += [(lang, r, p.decode(), -a, left, right, total[lang], -s) for r, (s, a, p, left, right) in enumerate(sorted(kept)[:most], 1)]
    return sorted(out, key=str)


def test_phrases(spark, odd, rows, empty):
    texts = [(r[2], r[1]) for r in rows]
    for least, most in ((30, 2000), (2, 40)):
        got = sorted(map(tuple, phrases.op12_phrases(odd, least, most).collect()), key=str)
        assert got == collocations(texts, least, most)
    assert phrases.op12_phrases(empty).count() == 0


def test_phrase_shards_and_languages(spark):
    """Many small shards of languages with odd names give the same counts, whatever a filter lets through."""
    rng = random.Random(5)
    texts = [(rng.choice(["en", "a\nb", "a", None, "und", ""]), " ".join(rng.choice("ab.cd") + rng.choice("xyz") for _ in range(rng.randrange(200)))) for _ in range(60)]
    docs = spark.createDataFrame(texts, "lang string, text string").repartition(3)
    assert phrases.shards(docs, 500).count() > 10
    got = sorted(map(tuple, phrases.op12_phrases(docs, 5, 100).collect()), key=str)
    assert got == collocations(texts, 5, 100)
