"""Substring dedup: words that a 13-word window covers which also starts in a document with a smaller id.

A log-structured index holds the hashes of all windows seen so far in sorted immutable runs, dealt by hash range. Documents come in batches
by rising id; each batch's sorted hashes are merge-joined with the runs, what matches is verified by a digest of the words themselves, the
batch becomes a new run, and runs of equal level are compacted into one. An index lives in a folder: a later call opens and extends it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, delete, scratch_dir, write_table
from .segments import Segment, mixed, segments, unpack

WORDS = 13
#: Batches that a whole table is cut into at least, and bytes of text of a batch at most: a window in all segments of a batch stays small.
BATCHES, BATCH_BYTES = 4, 1_000_000_000_000
#: Bytes of text of a range of ids, and of a hash range of the index; they set how many of each there are. Bytes of a segment.
RANGE_BYTES, BUCKET_BYTES, SEGMENT_BYTES = 32_000_000, 12_000_000, 800_000
#: Hashes that a task gathers from the segments of one range before it deals them to the hash ranges.
FLUSH = 2_000_000
#: Words whose hashes a worker remembers.
REMEMBERED = 300_000
#: Seeds of the words' hashes and of the window's.
SEED = 11
STEPS = np.random.Generator(np.random.PCG64(SEED + 1)).integers(0, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
RUN, REPEATED, WANTED, RESULT, PROOF = range(5)
PIECE = pa.struct([("kind", pa.int32()), ("seg", pa.int64()), ("hashes", pa.binary())])
#: seg is the first segment that a row is about. Answers are pieces for segments of one range, `grp`.
BLOB = "kind int, bucket int, seg long, hashes binary, more binary, grp long, pieces array<struct<kind int, seg long, hashes binary>>"
BLOB_SCHEMA = pa.schema([("kind", pa.int32()), ("bucket", pa.int32()), ("seg", pa.int64()), ("hashes", pa.binary()), ("more", pa.binary()), ("grp", pa.int64()), ("pieces", pa.list_(PIECE))])


def planes(values: np.ndarray) -> bytes:
    """64-bit numbers, equal bytes of all of them side by side, compressed."""
    import zstandard

    return zstandard.compress(np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8).T).tobytes(), 1)


def unplanes(data: bytes) -> np.ndarray:
    import zstandard

    flat = np.frombuffer(zstandard.decompress(data), np.uint8).reshape(8, -1)
    return np.ascontiguousarray(flat.T).view("<u8").ravel().astype(np.uint64)


def squeeze(values: np.ndarray) -> bytes:
    """Sorted 64-bit numbers as planes of their differences."""
    return planes(np.diff(values, prepend=np.zeros(1, values.dtype)))


def unsqueeze(data: bytes) -> np.ndarray:
    return np.cumsum(unplanes(data), dtype=np.uint64)


class WordHashes(dict):
    """XXH64 of words, remembered."""

    def __missing__(self, word: bytes) -> int:
        from xxhash import xxh64_intdigest

        if len(self) >= REMEMBERED:
            self.clear()
        h = self[word] = xxh64_intdigest(word, SEED)
        return h


_HASHES = WordHashes()


@dataclass
class Windows:
    """The words of a segment and their documents (places in the segment); and its windows' first words and hashes."""

    words: list[bytes]
    doc: np.ndarray
    first: np.ndarray
    hashes: np.ndarray

    def digests(self, which: np.ndarray) -> np.ndarray:
        """BLAKE2b, 64 bits of it, of the words of some windows."""
        data = b" ".join(self.words)
        starts = np.r_[0, np.cumsum(np.fromiter(map(len, self.words), np.int64, len(self.words)) + 1)]
        at = self.first[which]
        of = lambda a, b: int.from_bytes(hashlib.blake2b(data[a:b], digest_size=8).digest(), "little")
        return np.fromiter(map(of, starts[at].tolist(), (starts[at + WORDS] - 1).tolist()), np.uint64, len(at))


def windows(s: Segment, hash_bits: int = 64, k: int = WORDS) -> Windows:
    """Windows don't cross documents; those of documents without an id are left out. Fewer bits of the hash, for tests, make it clash."""
    split = [s.data[a:b].split() for a, b in zip(s.starts.tolist(), s.ends.tolist(), strict=True)]
    doc = np.repeat(np.arange(len(split)), [len(x) for x in split])
    words = [w for x in split for w in x]
    count = len(words) - k + 1
    if count <= 0:
        return Windows(words, doc, np.empty(0, np.int64), np.empty(0, np.uint64))
    word = np.fromiter(map(_HASHES.__getitem__, words), np.uint64, len(words))
    h = np.zeros(count, np.uint64)
    for j in range(k):
        h += word[j : j + count] * STEPS[j]
    named = np.array([x is not None for x in s.ids])
    first = np.flatnonzero((doc[:count] == doc[k - 1 :]) & named[doc[:count]])
    return Windows(words, doc, first, mixed(h[first]) >> np.uint64(64 - hash_bits) << np.uint64(64 - hash_bits))


def cuts_of(hashes: np.ndarray, bits: int) -> np.ndarray:
    """Where sorted hashes are cut into 2^bits ranges."""
    return np.searchsorted(hashes, np.arange(1, 1 << bits, dtype=np.uint64) << np.uint64(64 - bits)) if bits else np.empty(0, np.int64)


def blob_rows(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(BLOB_SCHEMA)], schema=BLOB_SCHEMA)


def fingerprint_rows(segs: DataFrame, bits: int, hash_bits: int) -> DataFrame:
    """The distinct window hashes of each segment: a row of BLOB for each hash range and up to FLUSH hashes of one range of ids, sorted by
    hash and segment, with the segments beside them. So rows stay large however many segments there are."""

    def dealt(held: list[tuple[int, np.ndarray]]) -> pa.RecordBatch:
        h = np.concatenate([x for _, x in held])
        first = held[0][0]
        seg = np.repeat(np.array([s - first for s, _ in held]), [len(x) for _, x in held])
        order = np.argsort(h, kind="stable")
        h, seg = h[order], seg[order]
        cuts = cuts_of(h, bits)
        parts = zip(np.split(h, cuts), np.split(seg, cuts), strict=True)
        return blob_rows([(REPEATED, i, first, squeeze(x), planes(y), first >> 24, None) for i, (x, y) in enumerate(parts) if len(x)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, np.ndarray]] = []
        n = 0
        for batch in batches:
            for s in unpack(batch):
                if held and (held[0][0] >> 24 != s.seg >> 24 or n >= FLUSH):
                    yield dealt(held)
                    held, n = [], 0
                x = np.unique(windows(s, hash_bits).hashes)
                if len(x):
                    held.append((s.seg, x))
                    n += len(x)
        if held:
            yield dealt(held)

    return segs.select("seg", "ids", "ends", "data").mapInArrow(run, BLOB)


def runs_of(values: np.ndarray) -> list[np.ndarray]:
    """Places of each run of equal values in sorted ones."""
    return np.split(np.arange(len(values)), np.flatnonzero(np.diff(values)) + 1) if len(values) else []


def merge_join(table: pa.Table, keep_run: bool = True) -> pa.Table:
    """One hash range: the batch's hashes with the runs'.

    Gives the new run, if it is kept; for each of the batch's segments which of its hashes repeat earlier ones (a bit each, in their order); and for each
    earlier segment which of its hashes were met. Answers for the segments of one range of ids come in one row.
    """
    rows = sorted(table.to_pylist(), key=lambda r: (r["kind"], r["seg"]))
    bucket = rows[0]["bucket"]
    batch = [(unsqueeze(r["hashes"]), unplanes(r["more"]).astype(np.int64) + r["seg"]) for r in rows if r["kind"] == REPEATED]
    if not batch:
        return pa.Table.from_batches([], schema=BLOB_SCHEMA)
    h, seg = (np.concatenate(x) for x in zip(*batch, strict=True))
    order = np.argsort(h, kind="stable")  # segments rise, so the first of equal hashes is the earliest
    first = np.r_[True, h[order[1:]] != h[order[:-1]]]
    distinct, group = h[order][first], np.cumsum(first) - 1
    owner, old = seg[order][first], np.zeros(len(distinct), bool)
    for r in rows:
        if r["kind"] == RUN:
            known = unsqueeze(r["hashes"])
            at = np.minimum(np.searchsorted(known, distinct), len(known) - 1)
            hit = known[at] == distinct
            owner = np.where(hit, unplanes(r["more"])[at].astype(np.int64), owner)
            old |= hit
    repeated = np.empty(len(h), bool)
    repeated[order] = ~first | old[group]
    pieces: dict[int, list] = {}
    by = np.argsort(seg, kind="stable")  # a segment's hashes in their order
    for part in runs_of(seg[by]):
        bits, s = repeated[by[part]], int(seg[by[part[0]]])
        if bits.any():
            pieces.setdefault(s >> 24, []).append({"kind": REPEATED, "seg": s, "hashes": np.packbits(bits).tobytes()})
    met = np.zeros(len(distinct), bool)
    met[group[repeated[order]]] = True
    by = np.argsort(owner[met], kind="stable")
    whose, wanted = owner[met][by], distinct[met][by]
    for part in runs_of(whose):
        s = int(whose[part[0]])
        pieces.setdefault(s >> 24, []).append({"kind": WANTED, "seg": s, "hashes": squeeze(wanted[part])})
    out = [(RUN, bucket, 0, squeeze(distinct[~old]), planes(owner[~old]), None, None)] if keep_run and not old.all() else []
    out += [(REPEATED, bucket, None, None, None, g, x) for g, x in pieces.items()]
    return pa.Table.from_batches([blob_rows(out)], schema=BLOB_SCHEMA)


def compact(table: pa.Table) -> pa.Table:
    """One hash range: its runs, which have no hash in common, as one."""
    rows = table.to_pylist()
    h = np.concatenate([unsqueeze(r["hashes"]) for r in rows])
    owner = np.concatenate([unplanes(r["more"]) for r in rows])
    order = np.argsort(h, kind="stable")
    return pa.Table.from_batches([blob_rows([(RUN, rows[0]["bucket"], 0, squeeze(h[order]), planes(owner[order]), None, None)])], schema=BLOB_SCHEMA)


@dataclass
class Index:
    """Runs by level (a run of level n comes from 2^n batches) and the segments they are about, in a folder.

    Tables never change; what belongs to the index is listed in a manifest, a new one for each call that extended it. Documents have to come
    by rising doc_id: `top_id` is the largest so far.
    """

    spark: SparkSession
    folder: str
    bits: int
    hash_bits: int = 64
    version: int = 0
    next_seg: int = 0
    top_id: int | None = None
    runs: list[tuple[int, str]] = field(default_factory=list)
    kept: list[str] = field(default_factory=list)
    answers: list[str] = field(default_factory=list)
    tables: int = 0

    @staticmethod
    def create(spark: SparkSession, folder: str, expected_bytes: int, hash_bits: int = 64) -> Index:
        """An empty index in a folder that the cluster shares; `expected_bytes` of text, in the end, set how many hash ranges there are."""
        return Index(spark, folder, max(2, (expected_bytes // BUCKET_BYTES).bit_length()), hash_bits)

    @staticmethod
    def open(spark: SparkSession, folder: str) -> Index:
        """The index as the last finished call left it."""
        rows = spark.read.json(f"{folder}/manifests", schema="version int, bits int, hash_bits int, next_seg long, top_id long, tables int, kind string, level int, name string")
        last = rows.filter(F.col("version") == rows.agg(F.max("version")).first()[0]).collect()  # a row for each table of the index
        r = last[0]
        index = Index(spark, folder, r.bits, r.hash_bits, r.version, r.next_seg, r.top_id, tables=r.tables)
        index.runs = sorted(((x.level, x.name) for x in last if x.kind == "run"), key=lambda x: -x[0])
        index.kept = [x.name for x in last if x.kind == "segments"]
        return index

    def save(self) -> None:
        named = [("run", level, name) for level, name in self.runs] + [("segments", 0, name) for name in self.kept]
        self.version += 1
        same = (self.version, self.bits, self.hash_bits, self.next_seg, self.top_id, self.tables)
        rows = self.spark.createDataFrame([(*same, *x) for x in named or [("none", 0, "")]], "version int, bits int, hash_bits int, next_seg long, top_id long, tables int, kind string, level int, name string")
        rows.coalesce(1).write.mode("append").json(f"{self.folder}/manifests")

    def write(self, df: DataFrame, *partition_by: str) -> str:
        self.tables += 1
        name = f"table-{self.version}-{self.tables}"
        write_table(df, f"{self.folder}/{name}", *partition_by)
        return name

    def read(self, name: str, schema) -> DataFrame:
        return self.spark.read.schema(schema).parquet(f"{self.folder}/{name}")

    def segments(self) -> DataFrame:
        """All segments, earlier calls' too."""
        return reduce(DataFrame.unionByName, [self.read(name, "seg long, ids array<long>, ends array<long>, data binary") for name in self.kept])

    def take_in(self, docs: DataFrame, total: int) -> DataFrame:
        """New documents as segments that follow the order of ids, so that an earlier segment means smaller ids."""
        ids = docs.agg(F.min("doc_id"), F.max("doc_id")).first()
        if ids[0] is not None and self.top_id is not None and ids[0] <= self.top_id:
            raise ValueError(f"documents come by rising doc_id: {ids[0]} isn't above {self.top_id}")
        ranges = max(BATCHES, -(-total // RANGE_BYTES))
        spread = F.when(F.col("doc_id").isNull(), F.xxhash64("text")).otherwise(0)  # rows without an id may be many, and go anywhere
        ordered = docs.select("doc_id", "text", spread.alias("spread")).repartitionByRange(ranges, "doc_id", "spread").sortWithinPartitions("doc_id")
        name = self.write(segments(ordered, SEGMENT_BYTES, self.next_seg))
        self.kept.append(name)
        self.top_id = ids[1] if ids[1] is not None else self.top_id
        return self.read(name, "seg long, ids array<long>, ends array<long>, data binary")

    def add(self, segs: DataFrame, keep_run: bool = True) -> DataFrame:
        """Merge-join a batch, whose ids are above those of earlier ones, and take it in as a run. Returns the batch's answers, rows of BLOB.

        The last batch of an index that is thrown away afterwards needs no run, and no run after it.
        """
        known = [self.run(name) for _, name in self.runs]
        rows = reduce(DataFrame.unionByName, [fingerprint_rows(segs, self.bits, self.hash_bits), *known])
        done = self.write(rows.groupBy("bucket").applyInArrow(lambda t: merge_join(t, keep_run), BLOB), "kind")
        self.answers.append(done)
        if not keep_run:
            for _, name in self.runs:
                delete(self.spark, f"{self.folder}/{name}/kind={RUN}")
            return self.read(done, BLOB).filter(F.col("kind") == REPEATED)
        self.runs.append((0, done))
        while len(self.runs) > 1 and self.runs[-1][0] == self.runs[-2][0]:
            (level, a), (_, b) = self.runs[-2:]
            self.runs[-2:] = [(level + 1, self.write(self.run(a).unionByName(self.run(b)).groupBy("bucket").applyInArrow(compact, BLOB), "kind"))]
            for x in (a, b):
                delete(self.spark, f"{self.folder}/{x}/kind={RUN}")
        return self.read(done, BLOB).filter(F.col("kind") == REPEATED)

    def run(self, name: str) -> DataFrame:
        return self.read(name, BLOB).filter(F.col("kind") == RUN)

    def forget_answers(self) -> None:
        for name in self.answers:
            delete(self.spark, f"{self.folder}/{name}/kind={REPEATED}")
        self.answers = []


def judge_segment(s: Segment, pieces: list[dict] | None, settled: list[dict] | None, bits: int, hash_bits: int) -> tuple[Windows, np.ndarray, np.ndarray]:
    """Removed words of a segment, and (hash, digest) of what has to be verified."""
    w = windows(s, hash_bits)
    distinct, group = np.unique(w.hashes, return_inverse=True)
    repeated, wanted = np.zeros(len(distinct), bool), np.zeros(len(distinct), bool)
    bounds = np.r_[0, cuts_of(distinct, bits), len(distinct)]
    for p in pieces or ():
        if p["kind"] == REPEATED:
            lo, hi = bounds[p["bucket"]], bounds[p["bucket"] + 1]
            repeated[lo:hi] |= np.unpackbits(np.frombuffer(p["hashes"], np.uint8), count=int(hi - lo)).astype(bool)
        else:
            wanted[np.searchsorted(distinct, unsqueeze(p["hashes"]))] = True
    ids = np.array([x if x is not None else 0 for x in s.ids], np.int64)
    own = ids[w.doc[w.first]]
    least = np.full(len(distinct), np.iinfo(np.int64).max)
    np.minimum.at(least, group, own)
    local = own > least[group]
    hit = repeated[group] | local
    told = np.flatnonzero((repeated | wanted | (np.bincount(group, local, len(distinct)) > 0))[group]) if len(group) else group
    digest = w.digests(told)
    if settled:
        first = {(x["h"] & MASK, x["v"] & MASK): x["least"] for x in settled}
        bad = np.isin(w.hashes, np.array([h for h, _ in first], np.uint64))
        for i, v in zip(np.flatnonzero(bad).tolist(), w.digests(np.flatnonzero(bad)).tolist(), strict=True):
            hit[i] = first[int(w.hashes[i]), v] < own[i]
    edge = np.zeros(len(w.words) + 1, np.int32)
    at = w.first[hit]
    np.add.at(edge, at, 1)
    np.add.at(edge, at + WORDS, -1)
    return w, np.cumsum(edge[:-1]) > 0, np.stack([w.hashes[told], digest], axis=1)


MASK = 0xFFFFFFFFFFFFFFFF
OUT = "kind int, bucket int, hashes binary, more binary, doc_id long, n_words long, n_removed long, kept string"
OUT_SCHEMA = pa.schema([("kind", pa.int32()), ("bucket", pa.int32()), ("hashes", pa.binary()), ("more", pa.binary()), ("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.string())])


def final_pass(answered: DataFrame, first_seg: int, bits: int, hash_bits: int, digest: bool) -> DataFrame:
    """A RESULT row for each document of the segments from first_seg on, and PROOF rows, one for each hash range and up to FLUSH hashes."""

    def table(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(OUT_SCHEMA)], schema=OUT_SCHEMA)

    def proofs(held: list[np.ndarray]) -> pa.RecordBatch:
        pairs = np.concatenate(held)
        pairs = pairs[np.lexsort((pairs[:, 1], pairs[:, 0]))]
        pairs = pairs[np.r_[True, (pairs[1:] != pairs[:-1]).any(axis=1)]]
        parts = enumerate(np.split(pairs, cuts_of(pairs[:, 0], bits)))
        return table([(PROOF, i, squeeze(x[:, 0]), planes(x[:, 1]), None, None, None, None) for i, x in parts if len(x)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        n = 0
        for batch in batches:
            pieces, settled = (batch.column(batch.schema.get_field_index(x)) for x in ("answers", "settled"))
            for i, s in enumerate(unpack(batch)):
                w, gone, proof = judge_segment(s, pieces[i].as_py(), settled[i].as_py(), bits, hash_bits)
                if len(proof):
                    held.append(proof)
                    n += len(proof)
                if n >= FLUSH // 4:
                    yield proofs(held)
                    held, n = [], 0
                if s.seg < first_seg:
                    continue
                edges = np.searchsorted(w.doc, np.arange(len(s.ids) + 1)).tolist()
                rows = []
                for doc_id, a, b in zip(s.ids, edges[:-1], edges[1:], strict=True):
                    gone_here = int(np.count_nonzero(gone[a:b]))
                    kept = b" ".join(compress(w.words[a:b], (~gone[a:b]).tolist()) if gone_here else w.words[a:b])
                    rows.append((RESULT, None, None, None, doc_id, b - a, gone_here, hashlib.sha256(kept).hexdigest() if digest else kept.decode()))
                yield table(rows)
        if held:
            yield proofs(held)

    return answered.select("seg", "ids", "ends", "data", "answers", "settled").mapInArrow(run, OUT)


def verify(proofs: DataFrame) -> DataFrame:
    """Hashes (h) that stand for more than one sequence of words."""

    def differing(table: pa.Table) -> pa.Table:
        pairs = [(unsqueeze(r["hashes"]), unplanes(r["more"])) for r in table.to_pylist()]
        h, v = (np.concatenate(x) for x in zip(*pairs, strict=True))
        order = np.argsort(h, kind="stable")
        h, v = h[order], v[order]
        clash = np.unique(h[1:][(h[1:] == h[:-1]) & (v[1:] != v[:-1])])
        return pa.table([pa.array(clash.view(np.int64))], names=["h"])

    return proofs.select("bucket", "hashes", "more").groupBy("bucket").applyInArrow(differing, "h long")


def settle(segs: DataFrame, clashes: DataFrame, hash_bits: int) -> DataFrame:
    """(seg, settled): for each segment with windows whose hashes clash, the smallest id of each of their word sequences, by hash and digest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in unpack(batch):
                w = windows(s, hash_bits)
                v = w.digests(np.arange(len(w.first)))
                yield pa.RecordBatch.from_arrays([pa.array(w.hashes.view(np.int64)), pa.array(v.view(np.int64)), pa.array(np.full(len(v), s.seg)), pa.array([s.ids[d] for d in w.doc[w.first]], pa.int64())], names=["h", "v", "seg", "doc_id"])

    met = cut(segs.mapInArrow(run, "h long, v long, seg long, doc_id long").join(clashes, "h", "left_semi").groupBy("h", "v", "seg").agg(F.min("doc_id").alias("doc_id")), "clashes")
    least = met.groupBy("h", "v").agg(F.min("doc_id").alias("least"))
    return met.join(least, ["h", "v"]).groupBy("seg").agg(F.collect_list(F.struct("h", "v", "least")).alias("settled"))


def dedup(docs: DataFrame, digest: bool = False, batches: int = BATCHES, index: Index | None = None, hash_bits: int = 64) -> DataFrame:
    """doc_id, n_words, n_removed and kept (the words that stay, joined by a space, or with digest their SHA-256) of every document.

    Null and empty texts have no word. Rows without a doc_id lose nothing and nothing is lost to them; rows of one doc_id don't count as
    earlier than each other, and repeated rows are such. Windows are judged on the input. An empty table gives an empty one; other columns
    are not read. With `index`, the documents are met with all that it holds too, and it holds them afterwards; without, an index is made for
    this call. Windows are equal if their hashes (of 64 bits, from XXH64 of the words) and digests (64 bits of BLAKE2b of the words) are;
    those with equal hashes and different digests are told apart.
    """
    spark = docs.sparkSession
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    own = index or Index.create(spark, scratch_dir(spark, "index"), total, hash_bits)
    first_seg = own.next_seg
    segs = own.take_in(docs, total)
    top = ((segs.agg(F.max("seg")).first()[0] or first_seg) - first_seg >> 24) + 1  # ranges of ids
    own.next_seg = first_seg + (top << 24)
    batches = max(batches, -(-total // BATCH_BYTES)) if index is None else max(1, -(-total // BATCH_BYTES))
    answers = []
    for b in range(batches):
        low, high = first_seg + ((top * b // batches) << 24), first_seg + ((top * (b + 1) // batches) << 24)
        answers.append(own.add(segs.filter((F.col("seg") >= low) & (F.col("seg") < high)), keep_run=index is not None or b < batches - 1))
    pieces = reduce(DataFrame.unionByName, answers).select("grp", "bucket", "pieces").repartition("grp").select("grp", "bucket", F.explode("pieces").alias("p"))
    told = pieces.groupBy("grp", F.col("p.seg").alias("seg")).agg(F.collect_list(F.struct("p.kind", "bucket", "p.hashes")).alias("answers")).drop("grp")
    everything = own.segments()
    answered = everything.join(told, "seg", "left").filter((F.col("seg") >= first_seg) | F.col("answers").isNotNull())
    bits = own.bits, own.hash_bits
    unsettled = F.lit(None).cast("array<struct<h: long, v: long, least: long>>").alias("settled")
    out = cut(final_pass(answered.select("*", unsettled), first_seg, *bits, digest), "deduped", "kind")
    clashes = cut(verify(out.filter(F.col("kind") == PROOF)), "clashing")
    if clashes.limit(1).count():
        again = answered.join(settle(everything, clashes, own.hash_bits), "seg", "left")
        out = cut(final_pass(again, first_seg, *bits, digest), "deduped", "kind")
    own.forget_answers()
    if index is None:
        delete(spark, own.folder)
    else:
        own.save()
    return out.filter(F.col("kind") == RESULT).select("doc_id", "n_words", "n_removed", "kept")


def op2_substring_dedup(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256. Null, empty, long and repeated texts, null ids, empty tables and other columns: see dedup()."""
    return dedup(docs, digest=True).withColumnRenamed("kept", "kept_sha256")
