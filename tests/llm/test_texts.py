"""Matroska, license scans, language ID, BPE."""

import hashlib
import random
import re
import struct
import zlib
from collections import Counter

import public_tokenizers
import pytest
from verimill.llm import bpe, language_id, license_scan, matroska

BPE = public_tokenizers.path("word_bpe_49k.json")


def test_matroska_round_trip(odd, rows):
    got = matroska.op4_matroska(odd).collect()
    want = Counter()
    for r in rows:
        data = (r[1] or "").encode()
        full = data + b" " * ((-len(data)) % 192 if data else 192)
        want[r[0], len(data), len(full), hashlib.sha256(full).hexdigest(), zlib.crc32(full[-16:])] += 1
    assert Counter(tuple(r)[:5] for r in got) == want
    assert len({r.media_sha256 for r in got}) == len({r[1] or "" for r in rows})


def test_matroska_packet_table(odd):
    media = matroska.to_media(odd.filter("doc_id = 1"))
    p = matroska.packet_table(media).orderBy("offset").collect()
    data = media.first().media
    assert {r.lacing for r in p} == {"none", "xiph", "fixed", "ebml"} or len(p) < 11
    text = odd.filter("doc_id = 1").first().text.encode()
    assert b"".join(data[r.offset : r.offset + r.size] for r in p).startswith(text)
    assert [r.timestamp_ns for r in p] == sorted(r.timestamp_ns for r in p)


def test_matroska_lacing_against_plain_sizes():
    rng = random.Random(1)
    for _ in range(200):
        frames = [bytes(rng.randrange(256) for _ in range(rng.choice([0, 1, 3, 254, 255, 256, 700]))) for _ in range(rng.randint(2, 8))]
        for kind in (matroska.XIPH, matroska.EBML_LACING):
            body = matroska.laced(kind, frames)
            sizes, at = matroska.lace_sizes(body, kind, 0, len(body))
            assert sizes == [len(f) for f in frames]
            assert body[at:] == b"".join(frames)
    same = [b"abc"] * 5
    body = matroska.laced(matroska.FIXED, same)
    assert matroska.lace_sizes(body, matroska.FIXED, 0, len(body)) == ([3] * 5, 1)


def test_matroska_cues_and_unknown_sizes():
    data = matroska.mux(b"x" * 192 * 700)
    t = matroska.packets(data)
    assert len(t["clusters"]) > 1
    assert [p for _, p in t["cues"]] == t["clusters"]
    at = data.index((0x18538067).to_bytes(4, "big")) + 4
    size = 9 - data[at].bit_length()
    unknown = data[:at] + bytes([0xFF >> (size - 1)]) + b"\xff" * (size - 1) + data[at + size :]
    assert matroska.packets(unknown)["size"] == t["size"]
    with pytest.raises(ValueError):
        matroska.packets(data[:-5])
    group = matroska.element(matroska.CLUSTER, matroska.number(matroska.TIMESTAMP, 7) + matroska.element(matroska.BLOCK_GROUP, matroska.element(matroska.BLOCK, b"\x82" + struct.pack(">hB", -2, 0) + b"data")))
    p = matroska.packets(group)
    assert (p["track"], p["timestamp_ns"], p["size"]) == ([2], [5_000_000], [4])


def test_matroska_live_recordings_and_deep_nesting():
    """Clusters of unknown size end where the next begins, however many; masters nest to any depth."""
    block = matroska.element(matroska.SIMPLE_BLOCK, b"\x81" + struct.pack(">hB", 0, 0x80) + b"data")
    ident = lambda x: x.to_bytes((x.bit_length() + 7) // 8, "big")
    cluster = lambda k: ident(matroska.CLUSTER) + b"\x01" + b"\xff" * 7 + matroska.element(matroska.TIMESTAMP, k.to_bytes(4, "big")) + block
    data = ident(matroska.SEGMENT) + b"\x01" + b"\xff" * 7 + b"".join(cluster(k) for k in range(5000)) + matroska.element(matroska.CUES, b"")
    t = matroska.packets(data)
    assert t["cluster"] == list(range(5000)) and t["timestamp_ns"] == [k * 1_000_000 for k in range(5000)] and set(t["size"]) == {4}
    two = matroska.packets(data + data)
    assert two["cluster"] == list(range(10_000))
    deep = block
    for _ in range(5000):
        deep = matroska.element(matroska.BLOCK_GROUP, deep)
    assert matroska.packets(matroska.element(matroska.SEGMENT, deep))["size"] == [4]


def test_matroska_any_damage_is_a_row(spark):
    rng = random.Random(9)
    good = matroska.mux(b"y" * 192 * 30)
    files = []
    for k in range(300):
        data = bytearray(good)
        for _ in range(rng.randrange(1, 6)):
            at = rng.randrange(min(len(data), 400)) if rng.random() < 0.7 else rng.randrange(len(data))
            data[at : at + rng.randrange(3)] = rng.randbytes(rng.randrange(3))
        files.append((k, bytes(data[: rng.randrange(len(data))] if rng.random() < 0.2 else data)))
    table = matroska.packet_table(spark.createDataFrame(files, "doc_id long, media binary")).collect()
    assert {r.doc_id for r in table if r.error} and all((r.error is None) == (r.size is not None) for r in table)


def test_matroska_damaged_files_give_an_error(spark):
    whole = matroska.mux(b"x" * 192 * 20)
    uneven = matroska.element(matroska.CLUSTER, matroska.element(matroska.SIMPLE_BLOCK, b"\x81" + struct.pack(">hB", 0, 0x80 | matroska.FIXED << 1) + b"\x02abcd"))
    minus = matroska.element(matroska.CLUSTER, matroska.element(matroska.SIMPLE_BLOCK, b"\x81" + struct.pack(">hB", 0, 0x80 | matroska.XIPH << 1) + b"\x01\x09abcd"))
    rows = [(1, whole), (2, whole[:-5]), (3, b"no such thing"), (4, uneven), (5, minus), (6, None), (7, b"")]
    got = matroska.packet_table(spark.createDataFrame(rows, "doc_id long, media binary")).collect()
    assert {r.doc_id for r in got if r.error} == {2, 3, 4, 5}
    assert Counter(r.doc_id for r in got if r.error) == Counter([2, 3, 4, 5])
    assert sum(r.size for r in got if r.doc_id == 1) == 192 * 20 and {r.doc_id for r in got} == {1, 2, 3, 4, 5}


def brute_license(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    places, labels = [], set()
    for p, label in license_scan.PHRASES.items():
        p = p.split()
        for i in range(len(w)):
            if w[i : i + len(p)] == p:
                places.append(i)
                labels.add(label)
    return len(w), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


def test_license_base(odd, rows):
    got = license_scan.op5_license_scan(odd).collect()
    assert Counter(tuple(r)[:6] for r in got) == Counter((r[0], *brute_license(r[1])) for r in rows)
    for r in got:
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) | {""}
        assert 0 <= r.score <= 1
    assert "template:cc-by" in next(r.labels for r in got if "cc-by" in r.base_labels)


def regex_of(template):
    """The same language as a regular expression over words that each have a blank behind them."""
    out = ""
    for part in re.split(r"(<<[^>]*>>)", template):
        if part == "<<optional>>":
            out += "(?:"
        elif part == "<<end>>":
            out += ")?"
        elif part.startswith("<<any:"):
            out += rf"(?:\S+ ){{0,{part[6:-2]}}}"
        elif part.startswith("<<like:"):
            out += f"(?:{part[7:-2]}) "
        elif part.startswith("<<not:"):
            out += f"(?!(?:{part[6:-2]}) )"
        else:
            out += "".join(re.escape(w) + " " for w in license_scan.tokens(part))
    return re.compile(out)


def test_templates_against_regular_expressions():
    rng = random.Random(2)
    templates = [*license_scan.TEMPLATES.values(), "a <<optional>>b <<optional>>c <<end>>d <<end>><<any:2>> a b", "<<any:1>> x <<optional>>y<<end>> x", "a <<like:[0-9]+>><<optional>> b<<end>><<not:[bc]>><<any:1>>"]
    for t in templates:
        words = sorted({*license_scan.tokens(re.sub("<<[^>]*>>", " ", t)), "other", "2", "3", "v3", "0", "version"})
        auto, pattern = license_scan.Automaton(t), regex_of(t)
        for _ in range(400):
            text = [rng.choice(words) for _ in range(rng.randint(1, 12))]
            if rng.random() < 0.5:
                kept = re.sub(r"<<any:\d+>>", lambda m: " ".join(rng.choice(words) for _ in range(rng.randint(0, int(m[0][6:-2])))), t)
                kept = re.sub(r"<<like:[^>]*>>", lambda m: rng.choice(["1", "2", "3", "v3"]), kept)
                text = license_scan.tokens(re.sub("<<[^>]*>>", " ", kept))
            assert license_scan.matches_whole(" ".join(text), t) == bool(pattern.fullmatch("".join(w + " " for w in text)))


def test_template_rejects_changed_wording():
    t = license_scan.TEMPLATES["template:apache"]
    assert license_scan.matches_whole("Licensed under the Apache License, Version 2.0.", t)
    assert license_scan.matches_whole("licensed UNDER the Apache license", t)
    assert not license_scan.matches_whole("Licensed under an Apache License, Version 2.0", t)
    with pytest.raises(ValueError):
        license_scan.Automaton("a <<optional>> b")


@pytest.mark.parametrize(
    "text,labels",
    [
        ("Licensed under the Apache License, version 1.1", set()),
        ("Licensed under the Apache License, version 2.0.", {"apache"}),
        ("Licensed under the Apache License 2.0", {"apache"}),
        ("Licensed under the Apache License", {"apache"}),
        ("This work is licensed under the GNU General Public License, version 99", set()),
        ("This work is licensed under the GNU General Public License, version 3.", {"gpl-3"}),
        ("This work is licensed under the GNU General Public License v2.0", {"gpl-2"}),
        ("This work is licensed under the GNU General Public License version 2.1", set()),
        ("This work is licensed under the GNU Lesser General Public License, version 2.1", {"lgpl-2.1"}),
        ("This work is licensed under the GNU Affero General Public License", {"agpl"}),
        ("Licensed under CC BY-SA 3.0", {"cc-by-sa-3.0"}),
        ("Licensed under CC BY 4.0", {"cc-by"}),
        ("Licensed under CC BY 5.0", set()),
        ("Licensed under the Creative Commons CC0 1.0 Universal", {"cc0"}),
    ],
)
def test_versions_are_mandatory_wording(text, labels):
    automata = license_scan.compile_templates(license_scan.TEMPLATES)
    for t in (text, f"Before it. {text} and after"):
        assert set(license_scan.scan(license_scan.tokens(t), automata)[0]) == {f"template:{x}" for x in labels}


def test_a_template_begins_with_a_word():
    with pytest.raises(ValueError):
        license_scan.Automaton("<<optional>>a <<end>><<like:[0-9]>> b")


def test_language_id(spark, odd, rows):
    got = language_id.op6_language_id(odd).collect()
    assert len(got) == len(rows)
    texts = {r[0]: r[1] for r in rows if r[0] is not None}
    for r in got:
        if r.doc_id is not None:
            assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
            assert (r.lang_pred == "und") == (not any(map(str.isalpha, texts[r.doc_id] or "")))
        assert r.lang_pred in ("en", "de", "und")
        assert 0 <= r.score <= 1


def brute_distance(text, profile, most):
    low = "".join(c if c.isalpha() else " " for c in text.lower())
    low = " " + " ".join(low.split()) + " "
    code = lambda g: sum(ord(c) << 21 * (len(g) - 1 - i) for i, c in enumerate(g))
    n = Counter(low[i : i + k] for k in (1, 2, 3) for i in range(len(low) - k + 1))
    n = Counter({g: c for g, c in n.items() if g.strip()})
    own = [code(g) for g in sorted(n, key=lambda g: (-n[g], code(g)))[:most]]
    place = {g: i for i, g in enumerate(profile)}
    return sum(abs(place[g] - i) if g in place else most for i, g in enumerate(own)) / (most * len(own))


def test_out_of_place_distance():
    a, b = "the cat and the hat, über alles " * 3, "le chat et la souris"
    model = {x: language_id.ranked(*language_id.grams(t), 40).tolist() for x, t in (("a", a), ("b", b))}
    names, table, places = language_id.arrays(model, 40)
    for text in (a, b, "the chat", "zzz", "Ünder 12 le"):
        got = language_id.distances(text, table, places, 40)
        assert got == pytest.approx([brute_distance(text, model[x], 40) for x in names])


def test_language_id_learns_languages(spark):
    d = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    j = language_id.op6_language_id(d).join(d, "doc_id").filter("held_out")
    assert j.filter("lang = lang_pred").count() / j.count() > 0.95


def test_accepted_keeps_columns_and_drops_wordless_texts(odd):
    out = language_id.accepted(odd, language_id.fit(odd))
    assert out.columns == odd.columns
    texts = [r.text for r in out.collect()]
    assert None not in texts and "" not in texts and "12345 67890 !!!" not in texts
    assert language_id.accepted(odd, {}).count() == len(texts)


def test_bpe_is_the_tokenizer(odd, rows):
    from tokenizers import Tokenizer

    tool = Tokenizer.from_file(BPE)
    want = Counter()
    for r in rows:
        ids = tool.encode(r[1] or "", add_special_tokens=False).ids
        want[r[0], len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256(tool.decode(ids, skip_special_tokens=False).encode()).hexdigest()] += 1
    assert Counter(map(tuple, bpe.op9_bpe(odd).collect())) == want


def test_bpe_random_words_and_forgetting(monkeypatch):
    from tokenizers import Tokenizer

    monkeypatch.setattr(bpe, "REMEMBERED", 50)
    tool, v, rng = Tokenizer.from_file(BPE), bpe.Vocabulary(BPE), random.Random(3)
    for _ in range(300):
        text = " ".join("".join(rng.choice("aabcdeeinorst'1é😀") for _ in range(rng.randint(1, 15))) for _ in range(20))
        assert list(struct.unpack(f"<{v.encode(text)[2]}I", v.encode(text)[0])) == tool.encode(text, add_special_tokens=False).ids


def test_bpe_encode_decode_tables(odd):
    ids = bpe.encode(odd.filter("doc_id < 5"), BPE)
    back = {r.doc_id: r.text for r in bpe.decode(ids, BPE).collect()}
    v = bpe.vocabulary(BPE)
    for r in odd.filter("doc_id < 5").collect():
        assert back[r.doc_id] == v.encode(r.text)[1]


@pytest.mark.parametrize("op", [matroska.op4_matroska, license_scan.op5_license_scan, language_id.op6_language_id, bpe.op9_bpe])
def test_empty(op, empty):
    assert op(empty).collect() == []


MIT = """Copyright (c) 2020 Some One
Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to
deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or
sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN
THE SOFTWARE."""
GPL = """This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free
Software Foundation; either version 2 of the License, or (at your option) any later version."""
ISC = license_scan.TEMPLATES.get("template:isc-text", "").replace("<<any:6>>", "THE AUTHOR")
BSD3 = license_scan.TEMPLATES.get("template:bsd-3-text", "").replace("<<any:8>>", "THE COPYRIGHT HOLDER")
BSD2 = license_scan.TEMPLATES.get("template:bsd-2-text", "").replace("<<any:8>>", "THE COPYRIGHT HOLDER")


@pytest.mark.parametrize(
    "text,label,word",
    [(MIT, "mit-text", "sublicense"), (GPL, "gpl-notice", "modify"), (GPL.replace("GNU", "GNU Lesser"), "lgpl-notice", "redistribute"), (GPL.replace("GNU", "GNU Affero"), "agpl-notice", "redistribute")]
    + [(re.sub("<<[^>]*>>", "", x), label, w) for x, label, w in ((ISC, "isc-text", "purpose"), (BSD2, "bsd-2-text", "retain"), (BSD3, "bsd-3-text", "endorse"))],
)
def test_whole_license_texts(text, label, word):
    """A whole text gets the label of its license alone, and none with one mandatory word changed."""
    automata = license_scan.compile_templates(license_scan.TEMPLATES)
    found = lambda t: set(license_scan.scan(license_scan.tokens(f"Some words before. {t} And after."), automata)[0])
    assert found(text) == {f"template:{label}"}
    assert word in text
    assert not found(text.replace(word, "other"))


def test_restrictions_are_licenses_of_their_own():
    automata = license_scan.compile_templates(license_scan.TEMPLATES)
    for kind in ("", "-SA", "-NC", "-ND", "-NC-SA", "-NC-ND"):
        found = license_scan.scan(license_scan.tokens(f"Licensed under CC BY{kind} 4.0."), automata)[0]
        assert set(found) == {f"template:cc-by{kind.lower()}"}
