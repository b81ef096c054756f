"""BPE encoding by dynamic programming over prefixes, and decoding.

Each prefix of a word has exactly one last token in its BPE encoding. An automaton over the vocabulary gives the tokens that end at each
place; the one that fits the last token of what stands before it is stored, and back-pointers from the end give the ids.
"""

from __future__ import annotations

import hashlib
import json
import re
import sys
import unicodedata
from array import array

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import in_arrow

#: Words that a worker remembers with their ids, in two generations: when the newer one is full, it takes the older one's place.
REMEMBERED = 150_000
#: Stands for the mark of a word's end inside the automaton's strings.
END = "\x00"
# The word pattern of this vocabulary, in ASCII and in text whose white space has become single blanks.
ASCII_WORDS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\x09-\x0d a-z0-9]+")
#: Scripts whose letters and numbers every Unicode version knows: Latin, Greek, Cyrillic and common punctuation. Texts in others are left
#: to the tokenizers library's own splitting.
SETTLED = re.compile(r"[\x00-\u024f\u0391-\u03a1\u03a3-\u03ce\u0400-\u045f\u2010-\u2027\u2030-\u205e]*")
LETTERS, NUMBERS = ("".join(re.escape(chr(c)) for c in range(0x2060) if SETTLED.fullmatch(chr(c)) and unicodedata.category(chr(c))[0] == kind) for kind in "LN")
WORDS = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{LETTERS}]+|[{NUMBERS}]|[^ {LETTERS}{NUMBERS}]+")


def byte_alphabet() -> dict[int, str]:
    """The printable character that stands for each byte in byte-level vocabularies: printable Latin-1 for itself, the others from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Vocabulary:
    """A BPE vocabulary with word ends: `ids` by token, `rank` and `halves` of the merge that makes a token, `joined` by pair."""

    def __init__(self, path: str):
        import ahocorasick
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, mark = spec["model"], spec["model"]["end_of_word_suffix"]
        self.names = {i: t for t, i in model["vocab"].items()} | {x["id"]: x["content"] for x in spec["added_tokens"]}
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.splitter = re.compile("(" + "|".join(re.escape(x) for x in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        shape = lambda t: t.removesuffix(mark) + END if t.endswith(mark) else t
        ids = {shape(t): i for t, i in model["vocab"].items()}
        self.rank: dict[int, int] = {}
        self.halves: dict[int, tuple[int, int]] = {}
        self.joined: dict[tuple[int, int], int] = {}
        for r, (a, b) in enumerate(model["merges"]):
            left, right, whole = ids[shape(a)], ids[shape(b)], ids[shape(a + b)]
            if whole not in self.rank:
                self.rank[whole], self.halves[whole] = r, (left, right)
            self.joined.setdefault((left, right), r)
        self.automaton = ahocorasick.Automaton()
        for t, i in ids.items():
            if self.stands(i):
                self.automaton.add_word(t, (len(t), i))
        self.automaton.make_automaton()
        self.tool = Tokenizer.from_file(path)
        self.alphabet = byte_alphabet()
        self.fits: dict[int, bool] = {}
        self.known: dict[str, tuple[bytes, str]] = {}
        self.older: dict[str, tuple[bytes, str]] = {}

    def apart(self, a: int, b: int, before: int = sys.maxsize) -> bool:
        """Whether no merge joins the end of token a to the start of token b, of those made earlier than rank `before`.

        Undoes the merges inside a and b, latest first. `before` is the bound under which a merge over the border would have come first:
        of two merges of one rank the left one comes first, so a merge inside b is preceded by one of its own rank over the border.
        """
        while True:
            over = self.joined.get((a, b))
            if over is not None and over < before:
                return False
            ra, rb = self.rank.get(a, -1), self.rank.get(b, -1)
            if ra < 0 and rb < 0:
                return True
            if ra > rb:
                before, a = ra, self.halves[a][1]
            else:
                before, b = rb + 1, self.halves[b][0]

    def stands(self, token: int) -> bool:
        """Whether a token's own text is encoded as that token."""
        if token not in self.rank:
            return True
        a, b = self.halves[token]
        return self.stands(a) and self.stands(b) and self.apart(a, b, self.rank[token])

    def encode_word(self, word: str) -> list[int]:
        """Ids of one word. token_at[n] is the last token of its first n characters, in the bytes' alphabet, and start_at[n] where it begins."""
        text = (word if word.isascii() and word.isprintable() else "".join(self.alphabet[b] for b in word.encode())) + END
        bare = len(text) - 2  # no token may end at the last letter without the word's end
        token_at, start_at = [-1] * (len(text) + 1), [0] * (len(text) + 1)
        fits, apart = self.fits, self.apart
        for at, (size, token) in self.automaton.iter(text):
            end = at + 1
            if at == bare or token_at[end] >= 0:
                continue
            start = end - size
            if start:
                before = token_at[start]
                if before < 0:
                    continue
                pair = before << 32 | token
                fit = fits.get(pair)
                if fit is None:
                    if len(fits) > 3 * REMEMBERED:
                        fits.clear()
                    fit = fits[pair] = apart(before, token)
                if not fit:
                    continue
            token_at[end], start_at[end] = token, start
        out, at = [], len(text)
        while at:
            out.append(token_at[at])
            at = start_at[at]
        return out[::-1]

    def words(self, text: str) -> list[str]:
        """Words of a text: normalised, lower case, white space dropped."""
        if text.isascii():
            return ASCII_WORDS.findall(text.lower())
        plain = self.tool.normalizer.normalize_str(text)
        if SETTLED.fullmatch(plain):
            return WORDS.findall(plain)
        return [plain[a:b] for _, (a, b) in self.tool.pre_tokenizer.pre_tokenize_str(plain)]

    def encode(self, text: str) -> tuple[bytes, str, int]:
        """Ids as little-endian 32-bit integers, the decoded text, and the number of ids."""
        ids: list[bytes] = []
        names: list[str] = []
        for part in self.splitter.split(text) if self.splitter and "<" in text else [text]:
            if part in self.special:
                ids.append(self.special[part].to_bytes(4, "little"))
                names.append(part)
                continue
            words = self.words(part)
            got = list(map(self.known.get, words))
            if None in got:
                for i in [i for i, x in enumerate(got) if x is None]:
                    got[i] = self.remembered(words[i])
            ids += [x[0] for x in got]  # type: ignore[index]
            names += [x[1] for x in got]  # type: ignore[index]
        data = b"".join(ids)
        return data, " ".join(names), len(data) // 4

    def remembered(self, word: str) -> tuple[bytes, str]:
        got = self.known.get(word) or self.older.get(word) or self.encoded(word)
        if len(self.known) >= REMEMBERED:
            self.known, self.older = {}, self.known
        if len(word) < 100:
            self.known[word] = got
        return got

    def encoded(self, word: str) -> tuple[bytes, str]:
        ids = self.encode_word(word)
        numbers = array("I", ids)
        if sys.byteorder == "big":
            numbers.byteswap()
        return numbers.tobytes(), self.decode(ids)

    def decode(self, ids: list[int]) -> str:
        """The tokens' names with spaces between them, as this vocabulary, which has no decoder, gives them."""
        return " ".join(self.names[i] for i in ids)


_LOADED: dict[str, Vocabulary] = {}


def vocabulary(path: str) -> Vocabulary:
    """A worker loads each vocabulary once."""
    if path not in _LOADED:
        _LOADED[path] = Vocabulary(path)
    return _LOADED[path]


def encode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id and ids (array of long) of every whole text; null and empty texts have none. Special tokens' strings in a text are those tokens."""
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int64()))])

    def work(rows: dict[str, list]) -> dict[str, list]:
        v = vocabulary(path)
        return {"doc_id": rows["doc_id"], "ids": [array("I", v.encode(x or "")[0]).tolist() for x in rows["text"]]}

    return in_arrow(docs.select("doc_id", "text"), "doc_id long, ids array<long>", work, schema)


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id and text of encoded documents (doc_id, ids); null ids give an empty text."""
    schema = pa.schema([("doc_id", pa.int64()), ("text", pa.string())])

    def run(batches):
        for batch in batches:
            v = vocabulary(path)
            texts = [v.decode(x or []) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], schema=schema)

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def digest(docs: DataFrame, path: str, with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every whole text, encoded and decoded; with_ids adds ids, 4 bytes each."""
    fields = [("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())]
    sql = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    schema = pa.schema([*fields, ("ids", pa.binary())] if with_ids else fields)

    def work(rows: dict[str, list]) -> dict[str, list]:
        v = vocabulary(path)
        out: dict[str, list] = {k: [] for k in schema.names}
        for doc_id, text in zip(rows["doc_id"], rows["text"], strict=True):
            data, decoded, n = v.encode(text or "")
            made = (doc_id, n, hashlib.sha256(data).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest(), data)
            for k, x in zip(schema.names, made, strict=False):
                out[k].append(x)
        return out

    return in_arrow(docs.select("doc_id", "text"), sql + ", ids binary" * with_ids, work, schema)


def op9_bpe(docs: DataFrame, path: str | None = None) -> DataFrame:
    """One row a row of docs, repeated ones too. Null and empty texts have no token and the digests of nothing; whole texts are encoded, however
    long; an empty table gives none; null ids stay; other columns are not read."""
    import public_tokenizers

    return digest(docs, path or public_tokenizers.path("word_bpe_49k.json"))
