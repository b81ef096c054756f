"""Suffix-array dedup: bytes that a 200-byte string covers which starts anywhere else too.

A sparse suffix array: suffixes start at anchors, which every 200-byte string holds and its own bytes decide, so that equal strings have
equal anchors. Sampled splitters deal the suffixes whose first GRAM bytes repeat to buckets by their leading tokens; a bucket sorts them,
and what stands before them read backwards, by multikey quicksort, and the common prefixes of neighbours give all common strings.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, drop_cut
from .segments import Segment, byte_values, mixed, powers, prefix_sums, segments, unpack

LENGTH = 200
#: Bytes of the gram that an anchor begins. A 200-byte string holds 101 grams; the smallest by hash are its anchors.
GRAM = 100
#: Suffixes of a bucket, about.
BUCKET_SUFFIXES = 40_000
#: Occurrences of a gram up to which its suffixes are one bucket's; those of a commoner one are dealt by their strings.
HOT_GRAM = 400_000
#: Contexts of which a task gathers the strings before it sends them.
HOT_CONTEXTS = 2_000
#: Contexts that a task gathers before it sends them.
GATHERED = 100_000
#: Leading tokens that splitters are drawn from: so many of each of so many segments. They balance the buckets and decide nothing else.
SAMPLE_SEGMENTS, SAMPLE_TOKENS = 48, 800


def sliding(values: np.ndarray, width: int, pick: np.ufunc) -> np.ndarray:
    """pick.reduce over values[i : i + width], for every i up to len(values) - width."""
    n = len(values)
    full = -(-n // width) * width
    v = np.concatenate([values, np.full(full - n, values[-1] if n else 0, values.dtype)]).reshape(-1, width)
    ahead = pick.accumulate(v, axis=1).ravel()
    behind = pick.accumulate(v[:, ::-1], axis=1)[:, ::-1].ravel()
    return pick(behind[: n - width + 1], ahead[width - 1 : n])


def anchors(s: Segment, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """Places and gram hashes of the anchors: grams that are smallest by hash in some string of `length` bytes inside one document."""
    n = len(s.data)
    none = np.empty(0, np.int64), np.empty(0, np.uint64)
    if n < length:
        return none
    sums = prefix_sums(byte_values(7)[np.frombuffer(s.data, np.uint8)])
    h = sums[gram:] - sums[:-gram]
    h *= powers(len(h))[1]
    h = mixed(h)
    inside = np.zeros(n + 1, np.int64)  # a string may begin where its document has `length` bytes left
    sizes = np.diff(np.r_[0, s.ends])
    long = sizes >= length
    if not long.any():
        return none
    np.add.at(inside, s.starts[long], 1)
    np.add.at(inside, s.ends[long] - length + 1, -1)
    inside = np.cumsum(inside[: n - length + 1]) > 0
    width = length - gram + 1
    least = sliding(h, width, np.minimum)
    least = np.where(inside, least, 0)
    # a gram is an anchor if it equals the least hash of a string that holds it, the largest of those at hand
    held = sliding(np.concatenate([np.zeros(width - 1, np.uint64), least, np.zeros(width - 1, np.uint64)]), width, np.maximum)
    at = np.flatnonzero((held == h) & (held > 0))
    return at, h[at]


def grouped(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A stable order of values and where each run of equal ones begins in it."""
    order = np.argsort(values, kind="stable")
    v = values[order]
    return order, np.flatnonzero(np.r_[True, v[1:] != v[:-1]]) if len(v) else np.empty(0, np.int64)


def tokens_of(strings: list[bytes], width: int) -> np.ndarray:
    """Strings as rows of big-endian 8-byte tokens, zeros behind their ends."""
    padded = b"".join(x.ljust(width, b"\0") for x in strings)
    return np.frombuffer(padded, ">u8").reshape(len(strings), width // 8).astype(np.uint64)


def multikey(tokens: np.ndarray) -> np.ndarray:
    """Order of the rows: by the first token, and runs of equal rows by each next one, as multikey quicksort splits them."""
    n, width = tokens.shape
    order = np.argsort(tokens[:, 0], kind="stable")
    run = np.cumsum(np.r_[False, tokens[order[1:], 0] != tokens[order[:-1], 0]])
    for t in range(1, width):
        equal = run[1:] == run[:-1]
        tied = np.flatnonzero(np.r_[False, equal] | np.r_[equal, False])
        if not len(tied):
            break
        rows = order[tied]
        inner = np.lexsort((tokens[rows, t], run[tied]))
        order[tied] = rows[inner]
        changed = np.zeros(n, bool)
        changed[1:] = tokens[order[1:], t] != tokens[order[:-1], t]
        run = np.cumsum(np.r_[False, ~equal | changed[1:]])
    return order


def common(tokens: np.ndarray, sizes: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Bytes that each row in order has in common with the one before; -1 for the first."""
    out = np.full(len(order), -1, np.int64)
    for at in range(1, len(order), 20_000):
        a, b = order[at - 1 : at + 19_999], order[at : at + 20_000]
        a = a[: len(b)]
        x = tokens[a] ^ tokens[b]
        first = (x != 0).argmax(axis=1)
        differ = x[np.arange(len(b)), first]
        same = np.where(differ == 0, tokens.shape[1] * 8, first * 8 + (64 - bit_lengths(differ)) // 8)
        out[at : at + len(b)] = np.minimum(same, np.minimum(sizes[a], sizes[b]))
    return out


def bit_lengths(x: np.ndarray) -> np.ndarray:
    out = np.zeros(len(x), np.int64)
    v = x.copy()
    for k in (32, 16, 8, 4, 2, 1):
        high = v >= np.uint64(1) << np.uint64(k)
        out += np.where(high, k, 0)
        v = np.where(high, v >> np.uint64(k), v)
    return out + (x > 0)


def reach(left: list[bytes], right: list[bytes], times: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """How far before and behind its place each suffix is covered by strings that start elsewhere too; (0, 0) for none.

    right[i] is the suffix from its anchor on, at most `length` bytes, left[i] what stands before it, at most `length - gram` bytes. Equal
    contexts in one segment come once, `times` counts them. A string that holds the gram at offset o is common if another suffix agrees in
    the o bytes before the anchor and in `length - o` bytes from it on; with both sides sorted, such agreement is a run of neighbours.
    """
    n, most = len(left), length - gram
    sizes_r, sizes_l = np.array([len(x) for x in right]), np.array([len(x) for x in left])
    width = lambda m: -(-m // 8) * 8
    tr, tl = tokens_of(right, width(length)), tokens_of([x[::-1] for x in left], width(max(most, 1)))
    order_r, order_l = multikey(np.column_stack([tr, sizes_r.astype(np.uint64)])), multikey(np.column_stack([tl, sizes_l.astype(np.uint64)]))  # a string before those that go on with zero bytes
    lcp_r, lcp_l = common(tr, sizes_r, order_r), common(tl, sizes_l, order_l)
    place_r, place_l = np.empty(n, np.int64), np.empty(n, np.int64)
    place_r[order_r], place_l[order_l] = np.arange(n), np.arange(n)
    before, behind = np.zeros(n, np.int64), np.zeros(n, np.int64)
    # whole contexts first: repeated ones are covered as a whole and need no further look, but others may still meet them
    same_r = np.cumsum(lcp_r < np.maximum(sizes_r[order_r], np.r_[0, sizes_r[order_r[:-1]]]))[place_r]
    same_l = np.cumsum(lcp_l < np.maximum(sizes_l[order_l], np.r_[0, sizes_l[order_l[:-1]]]))[place_l]
    order, start = grouped(same_r * (n + 1) + same_l)
    total = np.repeat(np.add.reduceat(times[order], start), np.diff(np.r_[start, n]))
    done = order[(total > 1)]
    done = done[sizes_l[done] + sizes_r[done] >= length]
    before[done], behind[done] = sizes_l[done], sizes_r[done]
    finished = np.zeros(n, bool)
    finished[done] = True
    by_gram = np.cumsum(lcp_r < gram)[place_r]
    waiting = np.zeros(by_gram.max() + 1, bool)
    waiting[by_gram[~finished]] = True
    once = np.ones(n, bool)  # of equal contexts that are finished, one can stand for all
    once[order] = False
    once[order[start]] = True
    open_ = np.flatnonzero(waiting[by_gram] & (once | ~finished))
    if len(open_) > 1:
        for o in range(most + 1):
            rows = open_[(sizes_l[open_] >= o) & (sizes_r[open_] >= length - o)]
            if len(rows) < 2:
                continue
            key = np.cumsum(lcp_r < length - o)[place_r[rows]] * (n + 1) + np.cumsum(lcp_l < o)[place_l[rows]]
            key_order, key_start = grouped(key)
            count = np.diff(np.r_[key_start, len(rows)])
            hit = rows[key_order[np.repeat(count > 1, count)]]
            before[hit] = np.maximum(before[hit], o)
            behind[hit] = np.maximum(behind[hit], length - o)
    return before, behind


def first_pass(segs: DataFrame) -> DataFrame:
    """(gram, seg, n): how often each anchor gram occurs in each segment."""
    schema = pa.schema([("gram", pa.int64()), ("seg", pa.int64()), ("n", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in unpack(batch):
                grams, n = np.unique(anchors(s)[1], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(grams.view(np.int64)), pa.array(np.full(len(grams), s.seg)), pa.array(n.astype(np.int32))], schema=schema)

    return segs.mapInArrow(run, "gram long, seg long, n int")


def flagged_at(s: Segment, grams: pa.Scalar) -> np.ndarray:
    """Places of the anchors whose gram is among `grams`."""
    at, h = anchors(s)
    return at[np.isin(h, np.asarray(grams.as_py(), dtype=np.int64).view(np.uint64))]


def splitters(flagged: DataFrame, buckets: int) -> list[bytes]:
    """Leading tokens, GRAM bytes each, that cut a sample of the suffixes that are dealt into equal parts, ascending; equal ones are one."""
    n = flagged.count()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            grams = batch.column(batch.schema.get_field_index("grams"))
            for i, s in enumerate(unpack(batch)):
                at = flagged_at(s, grams[i])
                at = at[:: max(1, len(at) // SAMPLE_TOKENS)].tolist()
                yield pa.RecordBatch.from_arrays([pa.array([s.data[p : p + GRAM] for p in at], pa.binary())], names=["lead"])

    drawn = flagged.filter(F.pmod(F.xxhash64(F.lit("splitters"), "seg"), F.lit(1000)) < max(1, min(1000, 1000 * SAMPLE_SEGMENTS // max(n, 1) + 1)))
    lead = sorted(bytes(r["lead"]) for r in drawn.mapInArrow(run, "lead binary").collect())  # of bounded size, see above
    return sorted({lead[k * len(lead) // buckets] for k in range(1, buckets)}) if lead else []


MEMBER = pa.struct([("seg", pa.int64()), ("places", pa.binary())])


def second_pass(flagged: DataFrame, cuts: list[bytes]) -> DataFrame:
    """The suffixes at anchors whose gram repeats: bucket, left and right context, and the places where segments have them.

    A context comes once for up to GATHERED of a task's, whatever segments they are in, so that a passage in very many documents is few rows.
    """
    schema = pa.schema([("bucket", pa.int32()), ("left", pa.binary()), ("right", pa.binary()), ("members", pa.list_(MEMBER))])

    def rows(found: dict[tuple[bytes, bytes], dict[int, list]]) -> pa.RecordBatch:
        columns = [
            pa.array([bisect_right(cuts, b[:GRAM]) for _, b in found], pa.int32()),
            pa.array([a for a, _ in found], pa.binary()),
            pa.array([b for _, b in found], pa.binary()),
            pa.array([[{"seg": s, "places": np.array(at, "<i4").tobytes()} for s, at in m.items()] for m in found.values()], pa.list_(MEMBER)),
        ]
        return pa.RecordBatch.from_arrays(columns, schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple[bytes, bytes], dict[int, list]] = {}
        for batch in batches:
            grams = batch.column(batch.schema.get_field_index("grams"))
            for i, s in enumerate(unpack(batch)):
                at = flagged_at(s, grams[i])
                doc = np.searchsorted(s.ends, at, side="right")
                lo, hi = np.maximum(at - (LENGTH - GRAM), s.starts[doc]), np.minimum(at + LENGTH, s.ends[doc])
                for a, b, p in zip(lo.tolist(), hi.tolist(), at.tolist(), strict=True):
                    found.setdefault((s.data[a:p], s.data[p:b]), {}).setdefault(s.seg, []).append(p)
                if len(found) >= GATHERED:
                    yield rows(found)
                    found = {}
        if found:
            yield rows(found)

    return flagged.mapInArrow(run, "bucket int, left binary, right binary, members array<struct<seg: long, places: binary>>")


def judged(suffixes: DataFrame) -> DataFrame:
    """(seg, places, before, behind) of the suffixes that repeated strings cover."""
    schema = pa.schema([("members", pa.list_(MEMBER)), ("before", pa.int32()), ("behind", pa.int32())])

    def work(table: pa.Table) -> pa.Table:
        members = table.column("members").combine_chunks()
        offsets = np.asarray(members.offsets)
        places = np.asarray(pc.binary_length(members.values.field("places")), np.int64) // 4
        times = np.diff(np.r_[0, np.cumsum(places)][offsets])
        before, behind = reach(table.column("left").to_pylist(), table.column("right").to_pylist(), times)
        hit = np.flatnonzero(behind)
        return pa.table([members.take(pa.array(hit)), pa.array(before[hit].astype(np.int32)), pa.array(behind[hit].astype(np.int32))], schema=schema)

    made = suffixes.groupBy("bucket").applyInArrow(work, "members array<struct<seg: long, places: binary>>, before int, behind int")
    return made.select(F.explode("members").alias("m"), "before", "behind").select("m.seg", "m.places", "before", "behind")


def judged_by_strings(suffixes: DataFrame) -> DataFrame:
    """As judged(), without a bucket: for grams so common that their contexts are too many for one task.

    Each of the up to 101 strings of LENGTH bytes that hold the gram in a context is dealt by its place and 128 bits of BLAKE2b of its bytes, and
    counted; a context is covered by those that come more than once. Equal strings of a task are one row.
    """
    schema = pa.schema([("o", pa.int32()), ("key", pa.binary()), ("times", pa.int64()), ("ids", pa.list_(pa.int64()))])
    hot = cut(suffixes.withColumn("id", F.monotonically_increasing_id()), "hot")
    contexts = hot.select("id", "left", "right", F.expr("aggregate(members, 0L, (a, m) -> a + octet_length(m.places) DIV 4)").alias("times"))

    def rows(found: dict[tuple[int, bytes], list]) -> pa.RecordBatch:
        columns = [pa.array([o for o, _ in found], pa.int32()), pa.array([k for _, k in found], pa.binary()), pa.array([t for t, _ in found.values()], pa.int64()), pa.array([i for _, i in found.values()], pa.list_(pa.int64()))]
        return pa.RecordBatch.from_arrays(columns, schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple[int, bytes], list] = {}
        seen = 0
        for batch in batches:
            for i, a, b, n in zip(*[batch.column(k).to_pylist() for k in range(4)], strict=True):
                whole = a + b
                for o in range(max(0, LENGTH - len(b)), len(a) + 1):
                    at = len(a) - o
                    entry = found.setdefault((o, hashlib.blake2b(whole[at : at + LENGTH], digest_size=16).digest()), [0, []])
                    entry[0] += n
                    entry[1].append(i)
                seen += 1
                if seen % HOT_CONTEXTS == 0:
                    yield rows(found)
                    found = {}
        if found:
            yield rows(found)

    met = contexts.mapInArrow(run, "o int, key binary, times long, ids array<long>")
    repeated = met.groupBy("o", "key").agg(F.sum("times").alias("n")).filter("n > 1").select("o", "key")
    hits = met.join(repeated, ["o", "key"], "left_semi").select(F.explode("ids").alias("id"), "o").groupBy("id").agg(F.max("o").alias("before"), F.max(LENGTH - F.col("o")).alias("behind"))
    return hot.join(hits, "id").select(F.explode("members").alias("m"), "before", "behind").select("m.seg", "m.places", "before", "behind")


def repeats(docs: DataFrame) -> DataFrame:
    """Segments of docs with `spans`: (places, before, behind) of what is repeated in them. For covered()."""
    segs = cut(segments(docs), "segments")
    counted = cut(first_pass(segs), "counted")
    often = counted.groupBy("gram").agg(F.sum("n").alias("m")).filter("m > 1").select("gram", (F.col("m") > HOT_GRAM).alias("hot"))
    of = lambda hot, c: F.when(F.col("hot") == hot, F.col(c))
    grams = cut(counted.join(often, "gram").groupBy("seg").agg(F.collect_list(of(False, "gram")).alias("grams"), F.collect_list(of(True, "gram")).alias("hot"), F.sum(of(False, "n")).alias("n")), "grams")
    drop_cut(counted)
    many = grams.agg(F.sum("n")).first()[0] or 0
    flagged = segs.join(grams.select("seg", "grams"), "seg")
    found = judged(second_pass(flagged, splitters(flagged, max(1, -(-many // BUCKET_SUFFIXES)))))
    hottest = grams.filter(F.size("hot") > 0).select("seg", F.col("hot").alias("grams"))
    if not hottest.isEmpty():
        found = found.unionByName(judged_by_strings(second_pass(segs.join(hottest, "seg"), [])))
    spans = cut(found.groupBy("seg").agg(F.collect_list(F.struct("places", "before", "behind")).alias("spans")), "spans")
    drop_cut(grams)
    return segs.join(spans, "seg", "left")


def covered(s: Segment, spans: list[dict] | None) -> np.ndarray:
    """Which bytes of the segment are removed."""
    edge = np.zeros(len(s.data) + 1, np.int32)
    for x in spans or ():
        at = np.frombuffer(x["places"], "<i4")
        np.add.at(edge, at - x["before"], 1)
        np.add.at(edge, at + x["behind"], -1)
    return np.cumsum(edge[:-1]) > 0


def per_document(repeated: DataFrame, schema: pa.Schema, sql: str, work) -> DataFrame:
    """work(doc_id, bytes, removed) makes a row for each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = batch.column(batch.schema.get_field_index("spans"))
            for i, s in enumerate(unpack(batch)):
                gone = covered(s, spans[i].as_py())
                rows = [work(d, s.data[a:b], gone[a:b]) for d, a, b in zip(s.ids, s.starts.tolist(), s.ends.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(schema)], schema=schema)

    return repeated.mapInArrow(run, sql)


def remove_repeats(docs: DataFrame) -> DataFrame:
    """doc_id and text without repeated bytes; a character stays if any of its bytes stays, so that texts remain UTF-8. Null texts become empty."""

    def work(doc_id, data, gone):
        if not gone.any():
            return doc_id, data.decode()
        b = np.frombuffer(data, np.uint8)
        char = np.cumsum((b & 0xC0) != 0x80) - 1
        stays = np.zeros(char[-1] + 1, bool)
        stays[char[~gone]] = True
        return doc_id, b[stays[char]].tobytes().decode()

    return per_document(repeats(docs), pa.schema([("doc_id", pa.int64()), ("text", pa.string())]), "doc_id long, text string", work)


def op7_suffix_dedup(docs: DataFrame) -> DataFrame:
    """Documents shorter than 200 bytes lose nothing; null texts are empty. Repeated rows are other places, so they lose what they share. Null
    ids stay; an empty table gives none; other columns are not read."""

    def work(doc_id, data, gone):
        n = int(np.count_nonzero(gone))
        spans = int(np.count_nonzero(gone[1:] & ~gone[:-1])) + bool(len(gone) and gone[0])
        kept = data if not n else np.frombuffer(data, np.uint8)[~gone].tobytes()
        return doc_id, len(data), n, spans, hashlib.sha256(kept).hexdigest()

    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())])
    return per_document(repeats(docs), schema, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string", work)
