"""SimHash near-dedup: fingerprints of word shingles, compared bit-sliced, and the components that links within the radius form."""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, drop_cut, in_arrow

SHINGLE = 3
SEED = 42
RADIUS = 3
#: Nodes that share a key and are more than this are told apart by further bits.
BLOCK_LIMIT = 4096
#: Rows that are compared at a time, and buckets that are small enough for comparison by offset.
ROWS, SMALL = 32_768, 48
#: Keys by which near copies meet, least values in each, and the seeded permutations of their hashes.
BANDS, BAND_ROWS = 16, 4
PERMUTATIONS = np.random.RandomState(SEED).randint(0, 1 << 63, (2, BANDS * BAND_ROWS), np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
#: Sets under this size have fingerprints too rough to go by.
SMALL_SET = 32
#: Bytes of shingles of a block of nodes that are compared with each other.
TILE_BYTES = 16_000_000


def shingle_hashes(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> np.ndarray:
    """XXH64 of the shingles of a text, A-Z in lower case, repeats included. With fewer words the whole sequence is one; without words, none."""
    from xxhash import xxh64_intdigest

    w = (text or "").encode().lower().split()  # of bytes: ASCII letters, and white space 9 to 13 and 32
    if not w:
        return np.empty(0, np.uint64)
    data = b" ".join(w)
    if len(w) <= shingle:
        return np.array([xxh64_intdigest(data, seed)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, w), np.int64, len(w)) + 1)
    starts = np.r_[0, ends[:-1]][: len(w) - shingle + 1].tolist()
    return np.fromiter((xxh64_intdigest(data[a:b], seed) for a, b in zip(starts, (ends[shingle - 1 :] - 1).tolist(), strict=True)), np.uint64, len(starts))


def fingerprint(hashes: np.ndarray) -> int:
    """The bits that are set in over half the hashes, as an unsigned number; 0 for none."""
    if not len(hashes):
        return 0
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 65_536):
        ones += np.unpackbits(hashes[at : at + 65_536].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """doc_id and fp (the fingerprint's 64 bits as a signed long) of every whole text."""
    schema = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())])

    def work(rows: dict[str, list]) -> dict[str, list]:
        fps = np.array([fingerprint(shingle_hashes(x, shingle, seed)) for x in rows["text"]], np.uint64)
        return {"doc_id": rows["doc_id"], "fp": fps.view(np.int64).tolist()}

    return in_arrow(docs.select("doc_id", "text"), "doc_id long, fp long", work, schema)


def planes(fps: np.ndarray) -> np.ndarray:
    """Bit planes: row p has bit p of all fingerprints, 64 of them in a word."""
    bits = np.unpackbits(fps.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    packed = np.packbits(bits.T, axis=1, bitorder="little")
    return np.ascontiguousarray(np.pad(packed, ((0, 0), (0, -packed.shape[1] % 8 + 8)))).view("<u8")


def within(a: np.ndarray, b: np.ndarray, ai: np.ndarray, bi: np.ndarray, valid: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Which of the pairs a[:, ai] to b[:, bi] differ in `radius` bits or fewer, 64 pairs a word: places of words, and their bits.

    Differences are added to carry-save counters, one bit plane after another; words whose pairs have all passed the radius are abandoned.
    """
    counter = [np.zeros(len(ai), np.uint64) for _ in range(radius.bit_length())]
    alive, place = valid.copy(), np.arange(len(ai))
    for p in range(64):
        carry = a[p, ai] ^ b[p, bi]
        for k in range(len(counter)):
            counter[k], carry = counter[k] ^ carry, counter[k] & carry
        alive &= ~carry  # more than the counters hold
        if p % 4 == 3:
            on = np.flatnonzero(alive)
            if len(on) < 0.7 * len(alive):
                ai, bi, alive, place, counter = ai[on], bi[on], alive[on], place[on], [c[on] for c in counter]
            if not len(on):
                break
    over, equal = np.zeros_like(alive), ~np.zeros_like(alive)
    for k in reversed(range(len(counter))):  # counts above the radius, from the highest bit
        if radius >> k & 1:
            equal &= counter[k]
        else:
            over |= equal & counter[k]
            equal &= ~counter[k]
    alive &= ~over
    on = np.flatnonzero(alive)
    return place[on], alive[on]


def pairs_of(word: np.ndarray, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row of `word`, place 0 to 63) of the set bits."""
    row, bit = np.nonzero(np.unpackbits(bits.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
    return word[row], bit


def unite(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Labels after joining the sets of i and j; a label is the smallest place of its set."""
    while True:
        a, b = label[i], label[j]
        apart = a != b
        if not apart.any():
            return label
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while not np.array_equal(up := label[label], label):
            label = up


def link(bucket: np.ndarray, fps: np.ndarray, radius: int = RADIUS, more: np.ndarray | None = None, more_radius: int = 64) -> tuple[np.ndarray, np.ndarray]:
    """Links that join what is linked inside the buckets: at most one for each row, from its place to that of its set's first row.

    bucket is sorted. Rows of small buckets are compared with the row 1, 2, ... places on, all at a time; a large bucket's rows block by
    block with the whole bucket. Linked pairs are never listed beyond one block. `more`, a second fingerprint, has to be near too.
    """
    n = len(fps)
    label = np.arange(n)
    start = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
    size = np.diff(np.r_[start, n])
    rows = np.flatnonzero(np.repeat(size <= SMALL, size))

    def joined(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        if more is not None:
            near = np.bitwise_count(more[i] ^ more[j]) <= more_radius
            i, j = i[near], j[near]
        return unite(label, i, j) if len(i) else label

    if len(rows) > 1:
        small = planes(fps[rows])
        words = -(-len(rows) // 64)
        own = bucket[rows]
        for step in range(1, int(size[size <= SMALL].max())):
            same = np.zeros(words * 64, bool)
            same[: len(rows) - step] = own[:-step] == own[step:]
            valid = np.packbits(same, bitorder="little").view("<u8")
            on = np.flatnonzero(valid)
            if not len(on):
                break
            q, r = divmod(step, 64)
            ahead = np.pad(small, ((0, 0), (0, q + 1)))
            shifted = ahead[:, q : q + words] >> np.uint64(r)
            if r:
                shifted = shifted | ahead[:, q + 1 : q + 1 + words] << np.uint64(64 - r)
            row, bit = pairs_of(*within(small, shifted, on, on, valid[on], radius))
            at = on[row] * 64 + bit
            label = joined(rows[at], rows[at + step])
    for s, m in zip(start[size > SMALL].tolist(), size[size > SMALL].tolist(), strict=True):
        whole = planes(fps[s : s + m])
        words = -(-m // 64)
        filled = np.packbits(np.pad(np.ones(m, bool), (0, words * 64 - m)), bitorder="little").view("<u8")
        bits = np.unpackbits(fps[s : s + m].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").T.astype(np.uint64) * ~np.uint64(0)
        for q in range(0, m, 64):
            from_word = q // 64  # pairs with earlier rows have been seen
            several = min(64, m - q)
            ai = np.tile(np.arange(from_word, words), several)
            bi = np.repeat(np.arange(several), words - from_word)
            row, bit = pairs_of(*within(whole, bits[:, q : q + several], ai, bi, filled[ai], radius))
            label = joined(s + q + bi[row], s + ai[row] * 64 + bit)
    moved = np.flatnonzero(label != np.arange(n))
    return moved, label[moved]


def bits_of(fp: Column, low: int, high: int) -> Column:
    """Bits low to high - 1, as a number."""
    return F.shiftrightunsigned(fp, low).bitwiseAND((1 << high - low) - 1)


def glued(fp: Column, ranges: list[tuple[int, int]]) -> tuple[Column, int]:
    """The bits of several ranges as one number, and how many they are."""
    out, width = F.lit(0).cast("long"), 0
    for low, high in ranges:
        out, width = out.bitwiseOR(F.shiftleft(bits_of(fp, low, high), width)), width + high - low
    return out, width


def links(distinct: DataFrame, radius: int = RADIUS, blocks: int = RADIUS + 1, more_radius: int = 64) -> DataFrame:
    """Links (a, b) between nodes (structs of fp and more) within the radius, enough to join every linked set; `distinct` has each node once.

    Of `blocks` blocks of bits, at most `radius` hold a difference, so linked fingerprints agree in some choice of the others. Those of a
    choice and value that more than BLOCK_LIMIT nodes share are dealt out anew by radius + 1 parts of the remaining bits, one of which linked
    ones share too: no pair is lost, and buckets stay small as the corpus grows. The counts of large buckets, which are broadcast, are at
    most as many as there are choices and values: 2^18 with four blocks.
    """
    if 64 * (blocks - radius) // blocks > 18:
        raise ValueError("too few blocks: keys are of 20 bits at most")
    edges = [64 * i // blocks for i in range(blocks + 1)]
    spans = list(zip(edges, edges[1:], strict=False))
    choices = list(combinations(range(blocks), blocks - radius))
    fp, entries = F.col("fp"), []
    for number, chosen in enumerate(choices):
        key, width = glued(fp, [spans[k] for k in chosen])
        rest, left = glued(fp, [x for k, x in enumerate(spans) if k not in chosen])
        entries.append(F.struct(key.bitwiseOR(F.lit(number << 20)).alias("key"), F.lit(left).alias("left"), rest.alias("rest")))
    of = distinct.select("fp", "more", F.explode(F.array(*entries)).alias("x")).select("fp", "more", "x.*")
    large = of.groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") > BLOCK_LIMIT).select("key", F.lit(True).alias("large"))
    cut_at = [F.floor(F.col("left") * u / (radius + 1)).cast("int") for u in range(radius + 2)]
    parts = F.array(*[F.struct(F.lit(u + 1).cast("long").alias("u"), F.expr("rest").alias("r"), cut_at[u].alias("low"), cut_at[u + 1].alias("high")) for u in range(radius + 1)])
    whole = F.array(F.struct(F.lit(0).cast("long").alias("u"), F.lit(0).cast("long").alias("r"), F.lit(0).alias("low"), F.lit(0).alias("high")))
    dealt = of.join(F.broadcast(large), "key", "left").select("fp", "more", "key", F.explode(F.when(F.col("large"), parts).otherwise(whole)).alias("y"))
    part = F.expr("shiftrightunsigned(y.r, y.low) & (shiftleft(1L, y.high - y.low) - 1)")
    bucket = F.shiftleft(F.col("key"), 20).bitwiseOR(F.shiftleft("y.u", 16)).bitwiseOR(part)
    rows = dealt.select(bucket.alias("bucket"), "fp", "more").repartition("bucket").sortWithinPartitions("bucket")
    schema = pa.schema([(k, pa.int64()) for k in ("a", "a_more", "b", "b_more")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, f, m in whole_buckets(batches):
            i, j = link(b, f.view(np.uint64), radius, m.view(np.uint64) if more_radius < 64 else None, more_radius)
            if len(i):
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (f[i], m[i], f[j], m[j])], schema=schema)

    found = rows.mapInArrow(run, "a long, a_more long, b long, b_more long")
    return found.select(F.struct(F.col("a").alias("fp"), F.col("a_more").alias("more")).alias("a"), F.struct(F.col("b").alias("fp"), F.col("b_more").alias("more")).alias("b"))


def whole_buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    """The columns in pieces of ROWS rows or more that end where a bucket ends, of a stream sorted by bucket, the first column."""
    held: list[list[np.ndarray]] = []
    n = 0
    for batch in batches:
        held.append([c.to_numpy(zero_copy_only=False) for c in batch.columns])
        n += batch.num_rows
        if n >= ROWS:
            whole = [np.concatenate(x) for x in zip(*held, strict=True)]
            end = int(np.searchsorted(whole[0], whole[0][-1]))
            if end:
                yield [x[:end] for x in whole]
            held, n = [[x[end:] for x in whole]], n - end
    if n:
        yield [np.concatenate(x) for x in zip(*held, strict=True)]


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root) of every node that isn't its component's smallest: alternating large and small stars until nothing changes.

    Each round halves the distance to the root or better, is written to the shared folder, and moves no more rows than there are links.
    """
    now = cut(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), "links")
    mark = state(now)
    for _ in range(most_rounds):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("at"), F.least("u", "m").alias("m"))
        big = both.join(least, F.col("u") == F.col("at")).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        under = big.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "at")
        small = big.join(under, F.col("u") == F.col("at")).select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").filter("u <> v").distinct()
        after = cut(small, "links")
        drop_cut(now)
        now, before = after, mark
        mark = state(now)
        if mark == before:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    raise RuntimeError("components haven't settled")


def state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.bit_xor(F.xxhash64("v", "u"))).first())


def components_of(own: DataFrame, radius: int, blocks: int, more_radius: int = 64) -> DataFrame:
    """own (doc_id, fp, more) with component_id. Rows of equal fingerprints are one node, so that copies cost nothing."""
    node = F.struct("fp", "more")
    nodes = cut(own.groupBy("fp", "more").agg(F.min("doc_id").alias("first")), "nodes")
    tree = components(links(nodes.select("fp", "more"), radius, blocks, more_radius))
    rooted = nodes.join(tree, node == F.col("node"), "left").select("fp", "more", "first", F.coalesce("root", node).alias("root"))
    named = rooted.groupBy("root").agg(F.min("first").alias("component_id")).withColumnRenamed("root", "of")
    table = rooted.join(named, F.col("root") == F.col("of")).select(F.col("fp").alias("is"), F.col("more").alias("is_more"), "component_id")
    return own.join(table, (F.col("fp") == F.col("is")) & (F.col("more") == F.col("is_more"))).drop("is", "is_more")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, seed: int = SEED, radius: int = RADIUS) -> DataFrame:
    """doc_id, fp and component_id of every document: the smallest doc_id that links within the radius reach, its own included.

    Texts without words have fingerprint 0 and are linked like any other. Rows with a null doc_id take part; the smallest id is that of the
    others, null if there is none. Repeated rows are copies like any other.
    """
    own = cut(fingerprints(docs, shingle, seed).withColumn("more", F.lit(0).cast("long")), "fingerprints")
    return components_of(own, radius, radius + 1).drop("more")


def band_keys(grams: np.ndarray) -> list[int]:
    """BANDS keys of a set of shingle hashes: each of the least values of BAND_ROWS seeded permutations. Two sets share a key with
    probability 1 - (1 - similarity ** BAND_ROWS) ** BANDS, which is 0.9998 at 0.8."""
    from xxhash import xxh64_intdigest

    least = np.full(BANDS * BAND_ROWS, ~np.uint64(0))
    factor, offset = PERMUTATIONS
    for at in range(0, len(grams), 4096):
        least = np.minimum(least, (grams[None, at : at + 4096] * factor[:, None] ^ offset[:, None]).min(axis=1))
    rows = least.astype("<u8").reshape(BANDS, BAND_ROWS)
    return np.array([xxh64_intdigest(r.tobytes(), k) for k, r in enumerate(rows)], np.uint64).view(np.int64).tolist()


def near_copies(docs: DataFrame, similarity: float = 0.8, shingle: int = 5, far: int = 20) -> DataFrame:
    """doc_id, text_hash, component_id and first (doc_id, text_hash) of every row: documents whose sets of five-word shingles have an exact
    Jaccard similarity of 0.8 or more are linked, and what links reach is a component. first is its row of the smallest doc_id, nulls last,
    ties by text_hash (XXH64 of the text), which tells rows of one doc_id apart; component_id is the smallest doc_id, null if all are.

    Rows of equal sets are one node; texts without words are one too. Candidates share a band key, their sizes allow the similarity, and
    their SimHash fingerprints differ in `far` bits at most: at 0.8 they differ in 10 with a deviation of 2.9 (sets under SMALL_SET are
    compared at any distance). Each is checked by the shingles themselves before it is a link. First every bucket's first node is checked
    with the others; where that leaves a bucket in parts, whoever isn't in its largest part is compared with all of it in tiles.
    """
    from xxhash import xxh3_128_digest

    whole, part = Fraction(str(similarity)).denominator, Fraction(str(similarity)).numerator
    schema = pa.schema([("doc_id", pa.int64()), ("id", pa.binary()), ("fp", pa.int64()), ("n", pa.int64()), ("keys", pa.list_(pa.int64())), ("text_hash", pa.int64())])
    sets_schema = pa.schema([("id", pa.binary()), ("grams", pa.list_(pa.int64()))])

    def named_set(text: str | None) -> tuple[bytes, np.ndarray]:
        g = np.unique(shingle_hashes(text, shingle))
        return xxh3_128_digest(g.astype("<u8").tobytes()), g

    def work(rows: dict[str, list]) -> dict[str, list]:
        out: dict[str, list] = {k: [] for k in schema.names}
        for doc_id, text, text_hash in zip(rows["doc_id"], rows["text"], rows["text_hash"], strict=True):
            name, g = named_set(text)
            fp = int(np.array([fingerprint(g)], np.uint64).view(np.int64)[0])
            for k, v in zip(schema.names, (doc_id, name, fp, len(g), band_keys(g) if len(g) else [], text_hash), strict=True):
                out[k].append(v)
        return out

    def work_sets(rows: dict[str, list]) -> dict[str, list]:
        found = [named_set(x) for x in rows["text"]]
        return {"id": [x for x, _ in found], "grams": [g.view(np.int64) for _, g in found]}

    texts = docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash"))
    own = cut(in_arrow(texts, "doc_id long, id binary, fp long, n long, keys array<long>, text_hash long", work, schema), "shingles")
    order = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "text_hash")
    nodes = cut(own.groupBy("id").agg(F.min(order).alias("first"), F.first("fp").alias("fp"), F.first("n").alias("n"), F.first("keys").alias("keys")), "nodes")
    dealt = nodes.select("id", "fp", "n", F.explode("keys").alias("bucket"))
    shared = dealt.groupBy("bucket").agg(F.min(F.struct("id", "fp", "n")).alias("pivot"), F.count("*").alias("of")).filter("of > 1").drop("of")
    met = cut(dealt.join(shared, "bucket"), "buckets")
    wanted = nodes.join(met.select("id").distinct(), "id", "left_semi").select(F.col("first.doc_id").alias("of"), F.col("first.text_hash").alias("of_hash"))
    asked = texts.join(wanted, F.col("doc_id").eqNullSafe(F.col("of")) & (F.col("text_hash") == F.col("of_hash")), "left_semi")
    sets = cut(in_arrow(asked.select("text"), "id binary, grams array<long>", work_sets, sets_schema).dropDuplicates(["id"]), "sets")

    near = f"bit_count(me.fp ^ pivot.fp) <= {far} or least(me.n, pivot.n) < {SMALL_SET}"
    possible = F.expr(f"({near}) and least(me.n, pivot.n) * {whole} >= greatest(me.n, pivot.n) * {part}")
    stars = met.withColumn("me", F.struct("id", "fp", "n")).filter("pivot.id <> id").filter(possible).select(F.col("pivot.id").alias("a"), F.col("id").alias("b")).distinct()
    one = stars.join(sets.select(F.col("id").alias("a"), F.col("grams").alias("x")), "a")
    two = one.join(sets.select(F.col("id").alias("b"), F.col("grams").alias("y")), "b")
    both = F.size(F.array_intersect("x", "y"))
    found = cut(two.filter(both * whole >= (F.size("x") + F.size("y") - both) * part).select("a", "b"), "stars")
    tree = cut(components(found), "tree")
    rooted = met.join(tree, met["id"] == tree["node"], "left").select("bucket", "id", "fp", "n", F.coalesce("root", "id").alias("root"))
    more = tile_links(rooted, sets, whole, part, far)
    tree = components(found.unionByName(more))
    named = nodes.select("id", "first").join(tree, F.col("id") == F.col("node"), "left").select("id", "first", F.coalesce("root", "id").alias("root"))
    least = named.groupBy("root").agg(F.min("first").alias("first")).withColumnRenamed("root", "of")
    table = named.select("id", "root").join(least, F.col("root") == F.col("of")).select(F.col("id").alias("is"), F.struct("first.doc_id", "first.text_hash").alias("first"))
    return own.select("doc_id", "text_hash", "id").join(table, F.col("id") == F.col("is")).select("doc_id", "text_hash", F.col("first.doc_id").alias("component_id"), "first")


def tile_links(rooted: DataFrame, sets: DataFrame, whole: int, part: int, far: int) -> DataFrame:
    """Links (a, b) that join what `rooted` (bucket, id, fp, n, root) leaves apart inside its buckets, by an exact similarity of part / whole.

    A bucket's nodes outside its commonest root (its minor ones) are compared with all its nodes. Both are cut into blocks of about
    TILE_BYTES of shingles, and each pair of blocks, a tile, is one group with its shingles, so a hot bucket is many small tasks. Pairs
    stay inside the tile: what leaves it are the links of a spanning tree.
    """
    size = F.col("n") * 8
    per = rooted.groupBy("bucket", "root").agg(F.count("*").alias("m"), F.sum(size).alias("bytes"))
    apart = per.groupBy("bucket").agg(F.count("*").alias("roots"), F.sum("bytes").alias("all_bytes"), F.max(F.struct("m", "root", "bytes")).alias("top")).filter("roots > 1")
    blocks = lambda b: F.ceil(b / TILE_BYTES).cast("int")
    apart = apart.select("bucket", F.col("top.root").alias("major"), F.greatest(blocks(F.col("all_bytes") - F.col("top.bytes")), F.lit(1)).alias("minors"), blocks(F.col("all_bytes")).alias("alls"))
    rows = rooted.join(apart, "bucket")
    place = lambda k: F.pmod(F.xxhash64("id"), F.col(k)).cast("int")
    minor = rows.filter("root <> major").select("bucket", "id", "fp", "n", "root", F.lit(True).alias("minor"), place("minors").alias("i"), F.explode(F.sequence(F.lit(0), F.col("alls") - 1)).alias("j"))
    every = rows.select("bucket", "id", "fp", "n", "root", F.lit(False).alias("minor"), F.explode(F.sequence(F.lit(0), F.col("minors") - 1)).alias("i"), place("alls").alias("j"))
    dealt = minor.unionByName(every).join(sets, "id")
    schema = pa.schema([("a", pa.binary()), ("b", pa.binary())])

    def work(table: pa.Table) -> pa.Table:
        made = tile(table, whole, part, far)
        return pa.table([pa.array([x for x, _ in made], pa.binary()), pa.array([y for _, y in made], pa.binary())], schema=schema)

    return dealt.groupBy("bucket", "i", "j").applyInArrow(work, "a binary, b binary")


def tile(table: pa.Table, whole: int, part: int, far: int) -> list[tuple[bytes, bytes]]:
    """Links of a tile, at most one for each two roots that it joins.

    Fingerprints are compared bit-sliced, 64 minor nodes at a time; of what is near and of fitting size, pairs of roots not joined yet are
    checked by their shingles.
    """
    ids, roots = table.column("id").to_pylist(), table.column("root").to_pylist()
    fp, n = table.column("fp").to_numpy().view(np.uint64), table.column("n").to_numpy()
    is_minor = np.asarray(table.column("minor"))
    grams = table.column("grams").combine_chunks()
    start = np.asarray(grams.offsets)
    values, codes = np.unique(np.asarray(grams.values)[start[0] : start[-1]], return_inverse=True)
    start = start - start[0]
    number = {r: k for k, r in enumerate(dict.fromkeys(roots))}
    label = np.array([number[r] for r in roots])
    ours, theirs = np.flatnonzero(is_minor), np.flatnonzero(~is_minor)
    if not len(ours) or not len(theirs):
        return []
    held = planes(fp[theirs])
    words = -(-len(theirs) // 64)
    filled = np.packbits(np.pad(np.ones(len(theirs), bool), (0, words * 64 - len(theirs))), bitorder="little").view("<u8")
    bits = np.unpackbits(fp[ours].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").T.astype(np.uint64) * ~np.uint64(0)
    inside = np.zeros(len(values), bool)
    out = []
    for q in range(0, len(ours), 64):
        several = min(64, len(ours) - q)
        near = np.zeros((several, words * 64), bool)
        ai, bi = np.tile(np.arange(words), several), np.repeat(np.arange(several), words)
        row, bit = pairs_of(*within(held, bits[:, q : q + several], ai, bi, filled[ai], far))
        near[bi[row], ai[row] * 64 + bit] = True
        for k in range(several):
            x = ours[q + k]
            fits = np.minimum(n[x], n[theirs]) * whole >= np.maximum(n[x], n[theirs]) * part
            ys = theirs[(near[k, : len(theirs)] | (np.minimum(n[x], n[theirs]) < SMALL_SET)) & fits & (label[theirs] != label[x])]
            if not len(ys):
                continue
            own = codes[start[x] : start[x + 1]]
            inside[own] = True
            for y in ys:
                if label[y] != label[x]:
                    both = int(np.count_nonzero(inside[codes[start[y] : start[y + 1]]]))
                    if both * whole >= (n[x] + n[y] - both) * part:
                        out.append((ids[x], ids[y]))
                        label[label == label[y]] = label[x]
            inside[own] = False
    return out


def op8_simhash(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint, component_id. Null, empty, long and repeated texts, null ids, ties and empty tables: see near_duplicates()."""
    return near_duplicates(docs).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
