"""License scans: template markup is compiled into token automata, which accept texts whose mandatory wording matches exactly."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import in_arrow

#: A word: ASCII letters in lower case, digits, and everything outside ASCII.
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
#: Phrases of the base scan and their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: Templates by label. Text in <<optional>> ... <<end>> may be absent; <<any:n>> stands for up to n words that the licensor fills in: names,
#: titles and years; <<like:p>> for one word that the pattern p fits; <<not:p>> for no word, but the next mustn't fit p. Versions are
#: mandatory wording: a text that names another one is no match. Each restriction of Creative Commons is a license, and so a template, of
#: its own, and so is each version; a label without a version is 4.0, or for GNU's short form, that none is named.
CC = "Licensed under <<optional>>a <<end>><<optional>>the <<end>><<optional>>Creative Commons Attribution {0} <<end>>CC BY {1} {2}<<not:[0-9]>>"
OTHER_VERSION = r"<<not:v|version|v?[0-9]+>>"
GNU = "This <<any:1>> is licensed under the GNU {0} General Public License"
ZERO = "<<optional>> 0<<end>>"
GNU_VERSION = "<<optional>>, version <<end>><<like:v?{0}>>{1}<<not:[0-9]+>>"
NOTICE = """<<any:6>> is free software: you can redistribute it and/or modify it under the terms of the GNU {0} General Public License as published by
the Free Software Foundation<<optional>>, either<<end>><<optional>>;<<end>> version {1} of the License<<optional>>, or (at your option) any
later version<<end>>"""
AS_IS = """THIS SOFTWARE IS PROVIDED BY <<any:8>> "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF
MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL <<any:8>> BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL,
SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR
PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING
NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
<<optional>>1. <<end>>Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
<<optional>>2. <<end>>Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer
in the documentation and/or other materials provided with the distribution. """
#: Versions of Creative Commons and what labels say of them, and the restrictions in short and in full.
CC_VERSIONS = {"4.0": "", "3.0": "3.0", "2.5": "2.5", "2.0": "2.0", "1.0": "1.0"}
RESTRICTIONS = {"": "", "SA": "ShareAlike", "NC": "NonCommercial", "ND": "NoDerivatives", "NC-SA": "NonCommercial ShareAlike", "NC-ND": "NonCommercial NoDerivatives"}
TEMPLATES = {
    **{f"template:cc-by{'-' * bool(short) + short.lower()}{'-' * bool(label) + label}": CC.format(name, short, version) for version, label in CC_VERSIONS.items() for short, name in RESTRICTIONS.items()},
    "template:cc0": "Licensed under <<optional>>the <<end>><<optional>>Creative Commons <<end>>CC0 1.0<<optional>> Universal<<end>><<not:[0-9]>>",
    "template:gpl": GNU.format("") + OTHER_VERSION,
    "template:lgpl": GNU.format("Lesser") + OTHER_VERSION,
    "template:agpl": GNU.format("Affero") + OTHER_VERSION,
    **{f"template:gpl-{v}": GNU.format("") + GNU_VERSION.format(v, ZERO) for v in (1, 2, 3)},
    **{f"template:lgpl-{v}": GNU.format(name) + GNU_VERSION.format(v, ZERO) for v, name in ((2, "Library"), (3, "Lesser"))},
    "template:lgpl-2.1": GNU.format("Lesser") + GNU_VERSION.format(2, " 1"),
    "template:agpl-3": GNU.format("Affero") + GNU_VERSION.format(3, ZERO),
    "template:gpl-notice": "This " + NOTICE.format("", "<<like:[123]>>" + ZERO),
    "template:lgpl-notice": "This " + NOTICE.format("Lesser", "<<like:[23]>><<optional>><<like:[01]>><<end>>"),
    "template:agpl-notice": "This " + NOTICE.format("Affero", "<<like:[123]>>" + ZERO),
    "template:apache": "Licensed under the Apache License<<optional>><<optional>>, version <<end>>2.0<<end>>" + OTHER_VERSION,
    "template:apache-notice": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You
may obtain a copy of the License at <<optional>>http<<end>><<optional>>https<<end>>://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable
law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND,
either express or implied. See the License for the specific language governing permissions and limitations under the License.""",
    "template:mpl-notice": """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with
this file, You can obtain one at <<optional>>http<<end>><<optional>>https<<end>>://<<optional>>www.<<end>>mozilla.org/MPL/2.0""",
    "template:mit": "<<optional>>The <<end>>MIT License",
    "template:mit-text": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the
"Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute,
sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice <<optional>>(including the next paragraph) <<end>>shall be included in all copies or substantial
portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE
WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR
ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR
THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "template:isc-text": """Permission to use, copy, modify, and<<optional>>/or<<end>> distribute this software for any purpose with or without fee is hereby
granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND <<any:6>>
DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL <<any:6>> BE
LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN
ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "template:bsd-2-text": BSD + AS_IS,
    "template:bsd-3-text": BSD + """<<optional>>3. <<end>>Neither the name of <<any:8>> nor the names of its contributors may be used to endorse or promote products
derived from this software without specific prior written permission. """ + AS_IS,
    "template:reserved": "<<optional>>Copyright <<any:6>><<end>>All rights reserved",
}


def tokens(text: str | None) -> list[str]:
    """Words of a text with A-Z in lower case; other letters stay as they are."""
    return WORD.findall((text or "").encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass"))


class Automaton:
    """States are places in the template's token list: a word to read, by itself or by a pattern, an optional region to enter or skip, words
    to let pass, or a look at the next word. A template can't begin with a pattern, since starts are looked up by word."""

    def __init__(self, template: str):
        self.steps: list[tuple] = []  # ("word", w) | ("like", p) | ("skip", target) | ("any", n) | ("not", p)
        opened: list[int] = []
        for part in re.split(r"(<<[^>]*>>)", template):
            if part == "<<optional>>":
                opened.append(len(self.steps))
                self.steps.append(("skip", None))
            elif part == "<<end>>":
                self.steps[opened.pop()] = ("skip", len(self.steps))
            elif part.startswith("<<any:"):
                self.steps.append(("any", int(part[6:-2])))
            elif part.startswith(("<<like:", "<<not:")):
                kind, pattern = part[2:-2].split(":", 1)
                self.steps.append((kind, re.compile(pattern)))
            elif not part.startswith("<<"):
                self.steps += [("word", w) for w in tokens(part)]
        if opened:
            raise ValueError("an optional region has no end")
        #: Mandatory words on the way to each state: how far an unfinished match has come.
        self.depth = [0] * (len(self.steps) + 1)
        skips: list[int] = []
        for i, (kind, value) in enumerate(self.steps):
            skips = [s for s in skips if s > i]
            self.depth[i + 1] = self.depth[i] + (kind in ("word", "like") and not skips)
            if kind == "skip":
                skips.append(value)
        self.mandatory = self.depth[-1]
        begin = [self.steps[s] for s, _ in self.closure({(0, 0)}, None) if s < len(self.steps)]
        if any(kind == "like" for kind, _ in begin):
            raise ValueError("a template can't begin with a pattern")
        self.first = {value for kind, value in begin if kind == "word"}

    def closure(self, states: set[tuple[int, int]], ahead: str | None) -> set[tuple[int, int]]:
        """States reachable without reading the next word, `ahead` (None at the end). A state is (place, words already let pass there)."""
        todo, seen = list(states), set(states)
        while todo:
            place, _ = todo.pop()
            kind, value = self.steps[place] if place < len(self.steps) else ("end", 0)
            more = [(place + 1, 0), (value, 0)] if kind == "skip" else [(place + 1, 0)] if kind == "any" or kind == "not" and not (ahead and value.fullmatch(ahead)) else []
            for s in more:
                if s not in seen:
                    seen.add(s)
                    todo.append(s)
        return seen

    def run(self, words: list[str], at: int) -> tuple[int, float]:
        """End of the longest match from word `at` (-1: none), and the share of mandatory words that the best try has read."""
        ahead = lambda: words[at] if at < len(words) else None
        states, end, best = self.closure({(0, 0)}, ahead()), -1, 0
        while states:
            best = max(best, *(self.depth[p] for p, _ in states))
            if any(p == len(self.steps) for p, _ in states):
                end = at
            if at >= len(words):
                break
            after = set()
            for place, passed in states:
                kind, value = self.steps[place] if place < len(self.steps) else ("end", 0)
                if kind == "word" and value == words[at] or kind == "like" and value.fullmatch(words[at]):
                    after.add((place + 1, 0))
                elif kind == "any" and passed < value:
                    after.add((place, passed + 1))
            at += 1
            states = self.closure(after, ahead())
        return end, best / self.mandatory if self.mandatory else 1.0


def compile_templates(templates: dict[str, str]) -> dict[str, Automaton]:
    return {label: Automaton(text) for label, text in templates.items()}


def scan(words: list[str], automata: dict[str, Automaton]) -> tuple[dict[str, tuple[int, int]], float]:
    """First match (from, to) of each template that occurs in the words, and the best share of mandatory wording found (1 for a match)."""
    starts: dict[str, list[str]] = {}
    for label, a in automata.items():
        for w in a.first:
            starts.setdefault(w, []).append(label)
    found: dict[str, tuple[int, int]] = {}
    best = 0.0
    for at, w in enumerate(words):
        if w in starts:
            for label in starts[w]:
                if label not in found:
                    end, share = automata[label].run(words, at)
                    best = max(best, share)
                    if end >= 0:
                        found[label] = (at, end)
    return found, best


def matches_whole(text: str | None, template: str) -> bool:
    """Whether the whole text is the template's wording."""
    words = tokens(text)
    return Automaton(template).run(words, 0)[0] == len(words) > 0


def scan_licenses(docs: DataFrame, templates: dict[str, str] | None = None, phrases: dict[str, str] | None = None) -> DataFrame:
    """One row a document: words, places of the base phrases, and the labels of phrases and templates with the template matches' spans.

    A null or empty text has no word, no label and score 0. `score` is 1 where a template matches, else the largest share of some
    template's mandatory words that are read without a fault from one start. `spans` is label:from-to of each template's first match.
    """
    automata = compile_templates(TEMPLATES if templates is None else templates)
    base = {tuple(tokens(p)): label for p, label in (PHRASES if phrases is None else phrases).items()}
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()), ("spans", pa.string())])
    heads: dict[str, list[tuple]] = {}
    for p in base:
        heads.setdefault(p[0], []).append(p)
    watched = set(heads).union(*(a.first for a in automata.values()))

    def work(rows: dict[str, list]) -> dict[str, list]:
        out: dict[str, list] = {k: [] for k in schema.names}
        for doc_id, text in zip(rows["doc_id"], rows["text"], strict=True):
            w = tokens(text)
            places, labels, found, best = [], set(), {}, 0.0
            if not watched.isdisjoint(w):
                for i, x in enumerate(w):
                    if x in heads:
                        for p in heads[x]:
                            if tuple(w[i : i + len(p)]) == p:
                                places.append(i)
                                labels.add(base[p])
                found, best = scan(w, automata)
            row = (doc_id, len(w), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels)), ",".join(sorted(labels | set(found))), best, ",".join(f"{k}:{a}-{b}" for k, (a, b) in sorted(found.items())))
            for k, v in zip(schema.names, row, strict=True):
                out[k].append(v)
        return out

    return in_arrow(docs.select("doc_id", "text"), "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans string", work, schema)


def op5_license_scan(docs: DataFrame) -> DataFrame:
    """One row a row of docs, repeated ones too. Null and empty texts have no word and no label; whole texts are read, however long; an empty
    table gives none; other columns are not read."""
    return scan_licenses(docs)
